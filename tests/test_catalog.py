import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.operators import catalog as C, navigation as G, quality as Q, sentences as N
from leafvoice.sources import library as B, readers as R
from tests import fixtures

T0 = dt.datetime(2024, 1, 1)
N_SENTENCES = 18  # of the harbour book


def sentence_rows(rng, docs=12):
    rows, texts = [], {}
    for d in range(docs):
        g = 0
        for c in range(rng.randint(1, 5)):
            for s in range(rng.randint(1, 6)):
                t = "x" * rng.randint(1, 60)
                rows.append((f"d{d}", c, f"ch_{c + 1}", s, g, t))
                texts.setdefault(f"d{d}", []).append((c, s, t))
                g += 1
    return rows, texts


def test_readers(spark):
    raw = spark.createDataFrame([
        ("d", 1, 0, "Hi", [1.0, 0.0, 0.0, -12.0, 5.0, 700.0], 9.0, 3.0, True),
        ("d", 1, 1, "", [1.0, 0.0, 0.0, 12.0, 5.0, 700.0], 9.0, 3.0, True),
        ("d", 1, 2, "x", None, None, 8.0, False)], schema.RAW_ITEMS)
    got = [tuple(r) for r in R.normalize_raw_items(raw).orderBy("run_idx").collect()]
    assert got == [("d", 1, 0, "Hi", 12.0, 5.0, 700.0, 9.0), ("d", 1, 1, "\n", 12.0, 5.0, 700.0, 0.0),
                   ("d", 1, 4, "x", 8.0, 0.0, 0.0, 0.0)]
    docs = spark.createDataFrame([("a", "A.PDF", "  ", 3), ("b", "b.pdf", " T ", 2), ("c", "c.txt", None, 3)], schema.DOCS)
    assert [r.title for r in R.resolve_title(docs).orderBy("doc_id").collect()] == ["A", "T", "c.txt"]
    ok, bad = R.accept_files(docs)
    assert ok.count() == 2 and [r.doc_id for r in bad.collect()] == ["c"]
    runs = spark.createDataFrame([("a", 1, 0, "x" * 149, 1.0, 0.0, 0.0, 0.0), ("b", 1, 0, "x", 1.0, 0.0, 0.0, 0.0)], schema.RUNS)
    ok, scanned = R.split_scanned(runs, docs)
    assert sorted(r.doc_id for r in scanned.collect()) == ["a", "c"] and [r.doc_id for r in ok.collect()] == ["b"]


def test_outline(spark):
    nodes = spark.createDataFrame([
        ("d", "1", None, 0, " One ", 1), ("d", "2", None, 1, "Two", None), ("d", "3", "1", 0, "One.a", 2),
        ("d", "4", "2", 0, "Two.a", 5), ("d", "5", "3", 0, None, 3), ("d", "6", "1", 1, "One.b", 4)], schema.OUTLINE_NODES)
    got = [tuple(r) for r in R.flatten_outline(nodes).orderBy("entry_idx").collect()]
    assert got == [("d", 0, "One", 1), ("d", 1, "One.a", 2), ("d", 2, "", 3), ("d", 3, "One.b", 4), ("d", 4, "Two.a", 5)]


def test_library(spark, tmp):
    path = tmp + "/lib"
    B.create_tables(spark, path)
    B.create_tables(spark, path)
    assert B.read_store(spark, path, "books").count() == 0
    runs = spark.createDataFrame(fixtures.book_runs("b", fixtures.HARBOUR_BOOK), schema.RUNS)
    docs = R.resolve_title(spark.createDataFrame([("b", "salt.pdf", "Salt and Lanterns", 5)], schema.DOCS))
    books = N.build_chapters(runs)
    B.write_library(spark, books, docs, path, "v1", batch="one")
    B.write_library(spark, books, docs, path, "v1", batch="one")
    spark.createDataFrame([("bk_x", "x")], "book_id string, doc_id string").write.parquet(f"{path}/chapters/batch=half/bucket=1")
    (row,) = B.read_store(spark, path, "books").collect()
    one = B.read_store(spark, path, "sentences", row.book_id)
    assert one.count() == N_SENTENCES and B.read_store(spark, path, "sentences", "bk_none").count() == 0
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert (row.title, row.chapter_count, row.sentence_count, row.detection_mode, row.voice) == (
        "Salt and Lanterns", 5, N_SENTENCES, "heading", "v1")
    assert len(row.book_id) == 14 and B.read_store(spark, path, "chapters").count() == 5
    store = B.read_store(spark, path, "sentences")
    assert B.get_content(store, B.get_book(B.read_store(spark, path, "books"), row.book_id)).count() == N_SENTENCES
    B.reset(spark, path)
    B.create_tables(spark, path)
    assert B.read_store(spark, path, "books").count() == 0


def test_changes(spark):
    books = spark.createDataFrame([("a", "v"), ("b", "v")], "book_id string, voice string")
    ch = spark.createDataFrame([("b", "w"), ("z", "w")], "book_id string, voice string")
    assert {tuple(r) for r in B.update_book_field(books, ch).collect()} == {("a", "v"), ("b", "w")}
    left = B.delete_books({"books": books, "c": books}, ch)
    assert [r.book_id for r in left["c"].collect()] == ["a"]
    chunk = lambda b, i, v, n: (b, "ch_1", i, v, 1.0, None, T0 + dt.timedelta(seconds=n))
    chunks = spark.createDataFrame([chunk("a", 0, "old", 9), chunk("a", 1, "old", 0)], schema.CHUNKS)
    new = spark.createDataFrame([chunk("a", 0, "n1", 1), chunk("a", 0, "n2", 2)], schema.CHUNKS)
    got = {(r.sentence_idx, r.voice) for r in B.upsert_chunks(chunks, new).collect()}
    assert got == {(0, "n2"), (1, "old")}
    assert {tuple(r) for r in B.count_chunks_by_book(books, chunks).collect()} == {("a", 2), ("b", 0)}
    assert B.get_chunk(chunks, "a", "ch_1", 1).count() == 1 and B.clear_chunks(chunks, ch).count() == 2


def test_overview(spark):
    books = spark.createDataFrame([(f"b{i}", f"d{i}", 4, T0 + dt.timedelta(days=i), i % 2) for i in range(6)],
                                  "book_id string, doc_id string, chapter_count int, added_at timestamp, owner int")
    ev = spark.createDataFrame([("b1", 1, "ch_3", 0, 0.0, 0, T0), ("b1", 2, "ch_2", 1, 2.0, 5, T0), ("b4", 3, "ch_1", 0, 0.0, 0, T0),
                                ("b5", 4, "ch_9", 0, 0.0, 0, T0), ("b2", 5, "ch_4", 0, 0.0, 0, T0)], schema.PROGRESS)
    over = C.library_overview(books, B.latest_progress(ev))
    assert {r.book_id: r.progress_pct for r in over.collect()} == {"b0": 0, "b1": 25, "b2": 75, "b3": 0, "b4": 0, "b5": 100}
    assert C.list_overview(over).first().book_id == "b5"
    assert [r.book_id for r in C.continue_reading(over).collect()] == ["b2"]
    assert {(r.owner, r.book_id) for r in C.continue_reading(over, "owner").collect()} == {(0, "b2"), (1, "b1")}


def test_first_content_and_voice(spark):
    ch = [("a", i, t) for i, t in enumerate(["Copyright", "Some title", "Chapter 1"])] + [("b", 0, "Contents"), ("b", 1, "Body")]
    ch += [("c", 0, "Index")]
    n = {("a", 0): 9, ("a", 1): 6, ("a", 2): 5, ("b", 0): 8, ("b", 1): 7, ("c", 0): 9}
    rows = []
    for d in "abc":
        g = 0
        for (dd, c), k in n.items():
            for s in range(k if dd == d else 0):
                rows.append((d, c, f"ch_{c + 1}", s, g, "t"))
                g += 1
    chapters = spark.createDataFrame(ch, "doc_id string, chapter_idx long, title string")
    got = {r.doc_id: r.global_idx for r in C.first_content_sentence(chapters, spark.createDataFrame(rows, schema.SENTENCES)).collect()}
    assert got == {"a": 15, "b": 8, "c": 0}
    voices = spark.createDataFrame([
        ("p", 0, "x", "Siri fr", "fr-FR", True), ("p", 1, "y", "Daniel", "en_GB", False), ("p", 2, "z", "Aria Neural", "en", False),
        ("q", 0, "x", "A", "fr", False), ("q", 1, "y", "B", "de", True), ("r", 0, "k", "A", "fr", False)], schema.VOICES)
    assert {r.device_id: r.voice_id for r in C.preferred_voice(voices).collect()} == {"p": "z", "q": "y", "r": "k"}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(G, "ROWS_PER_BLOCK", 4)


def test_navigation(spark, small_blocks):
    rng = random.Random(1)
    rows, texts = sentence_rows(rng)
    df = spark.createDataFrame(rows, schema.SENTENCES).repartition(4)
    got = {(r.doc_id, r.global_idx): r for r in G.neighbour_targets(df).collect()}
    starts = {(r.doc_id, r.global_idx): r for r in G.sentence_starts(df).collect()}
    for d, ss in texts.items():
        first = {}
        for g, (c, _, _) in enumerate(ss):
            first.setdefault(c, g)
        for g, (c, s, _) in enumerate(ss):
            r = got[d, g]
            assert (r.prev_sentence, r.next_sentence) == (max(0, g - 1), g + 1 if g + 1 < len(ss) else None)
            assert r.prev_chapter == (first[c] if g > first[c] else first.get(c - 1))
            assert r.next_chapter == first.get(c + 1)
            sec = lambda rows: sum(max(0.4, len(t) / 14) for _, _, t in rows)
            assert starts[d, g].book_sec == pytest.approx(sec(ss[:g]))
            assert starts[d, g].chapter_sec == pytest.approx(sec(ss[first[c]:g]))


def test_skip(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(G, "CHARS_PER_SLOT", 16)
    rng = random.Random(2)
    rows, texts = sentence_rows(rng)
    reqs, want = [], {}
    for i in range(600):
        d = rng.choice(list(texts))
        lens = [len(t) for _, _, t in texts[d]]
        g = rng.randrange(len(lens))
        ch, rate, delta = rng.randint(0, lens[g]), rng.choice([0.5, 1.0, 2.0]), rng.choice([-30.0, -5.0, -0.5, 0.0, 0.3, 5.0, 15.0, 90.0])
        idx, pos = g, ch + int((delta * 14 * rate + 0.5) // 1)
        while pos < 0 or pos > lens[idx]:
            if pos < 0 and idx == 0:
                pos = 0
            elif pos < 0:
                idx -= 1
                pos += lens[idx]
            elif idx == len(lens) - 1:
                pos = lens[idx]
            else:
                pos -= lens[idx]
                idx += 1
        reqs.append((i, d, g, ch, rate, delta))
        want[i] = (idx, pos)
    df = spark.createDataFrame(rows, schema.SENTENCES)
    rq = spark.createDataFrame(reqs, "req int, doc_id string, global_idx long, char_index long, rate double, delta double")
    got = {r.req: (r.to_global_idx, r.to_char_index) for r in G.skip_seconds(df, rq).collect()}
    assert got == want


def test_resume_seek_advance(spark):
    rows = [("a", 0, "ch_1", 0, 0, "Hello there world."), ("a", 0, "ch_1", 1, 1, "Second one."), ("b", 0, "ch_1", 0, 0, "Hi.")]
    s = spark.createDataFrame(rows, schema.SENTENCES)
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book_id string")
    prog = spark.createDataFrame([("a", 1, "ch_1", 1, 0.5, 0, T0), ("b", 2, "ch_7", 0, 0.0, 2, T0)], schema.PROGRESS)
    fc = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "book_id string, global_idx long")
    got = {tuple(r) for r in G.resolve_resume(books, s.withColumnRenamed("doc_id", "book_id"), prog, fc).collect()}
    assert got == {("a", 1, 7), ("b", 0, 2), ("c", 0, 0)}
    req = spark.createDataFrame([("a", 0, 0, 2), ("a", 0, 1, None), ("a", 5, 0, 1)], "doc_id string, chapter_idx long, sentence_idx long, word_idx int")
    assert {(r.global_idx, r.char_index) for r in G.seek_target(s, req).collect()} == {(0, 12), (1, 0)}
    req = spark.createDataFrame([("a", 0, 18), ("a", 0, 3), ("a", 1, 11)], "doc_id string, global_idx long, from_char long")
    assert {(r.speak_idx, r.speak_from) for r in G.advance_sequence(s, req).collect()} == {(1, 0), (0, 3), (None, None)}


def test_quality(spark):
    texts = ["lower start here.", "A broken- word and con- dence.", "X alone", "Ok.", "y" * 401, "two  gaps   here", "ends with un-", "certain then.", "Doubled.. and .spaced ."]
    s = spark.createDataFrame([("d", 0, "ch_1", i, i, t) for i, t in enumerate(texts)], schema.SENTENCES)
    a = Q.sentence_audit(s).first()
    assert (a.lowercase_start, a.broken_hyphen, a.orphan_capital, a.tiny, a.over_cap, a.double_blank) == (5, 3, 2, 1, 1, 2)
    rows = {r.check_name: r for r in Q.corpus_audit(s, k=2).collect()}
    assert rows["broken_hyphen"].n == 3 and rows["lowercase_start"].examples == ["lower start here.", "y" * 60]
    p = Q.punctuation_checks(s).first()
    assert p.doubled_period and p.blank_before_period
    ex = spark.createDataFrame([("ok", "d", ["un- certain", "alone Ok."], ["zzz"]), ("bad", "d", ["absent"], ["two  gaps"])],
                               "case_id string, doc_id string, must_contain array<string>, must_not_contain array<string>")
    assert {(r.case_id, r.passed, r.failures) for r in Q.integrity_checks(s, ex).collect()} == {("ok", True, 0), ("bad", False, 2)}
    # Strings over many sentences, in parts of any width.
    line = " ".join(texts)
    cuts = [line[a:b] for a in range(0, len(line), 37) for b in (a + 1, a + 90, a + 500) if b <= len(line)]
    ex = spark.createDataFrame([("all", "d", cuts + [line], [c + "#" for c in cuts]), ("not", "d", [" ".join(texts[::2])], [line]), ("no", "e", ["x"], ["y"]), ("null", "d", [None, "Ok."], [])],
                               "case_id string, doc_id string, must_contain array<string>, must_not_contain array<string>")
    for chars in (1, 7, 64, 65536):
        assert {tuple(r) for r in Q.integrity_checks(s, ex, chars).collect()} == {("all", True, 0), ("not", False, 2), ("no", False, 1), ("null", True, 0)}
    short = ex.where("case_id = 'null'").unionByName(spark.createDataFrame([("few", "d", ["alone Ok. y", "un- certain"], ["Ok. yx"])], ex.schema))
    for chars in (1, 7, 64):
        assert {tuple(r) for r in Q.integrity_checks(s, short, chars).collect()} == {("null", True, 0), ("few", True, 0)}
    runs = spark.createDataFrame([("d", 1, i * 2, f"run {i}", 11.0, 0.0, 0.0, 0.0) for i in range(10)], schema.RUNS)
    got = Q.runs_in_context(runs, "run 1").orderBy("match", "pos").collect()
    assert [(r.match, r.pos, r.is_match) for r in got] == [(1, p, p == 1) for p in range(0, 5)]


def test_voice_without_language_is_not_english(spark):
    from leafvoice.operators.catalog import preferred_voice

    rows = [("d", 0, "a", "plain", None, True), ("d", 1, "b", "plain", "en-US", False)]
    got = preferred_voice(spark.createDataFrame(rows, "device_id string, ord int, voice_id string, name string, lang string, is_default boolean"))
    assert [r.voice_id for r in got.collect()] == ["b"]


def test_book_without_chapters_is_kept(spark):
    from leafvoice.sources.library import book_counts, book_rows

    docs = spark.createDataFrame([("x", "t", "f", 1), ("y", "t", "f", 2)], "doc_id string, title string, file_name string, page_count int")
    chapters = spark.createDataFrame([("x", "outline")], "doc_id string, detection_mode string")
    got = book_rows(docs, book_counts(chapters, chapters.select("doc_id"))).collect()
    assert sorted((r.doc_id, r.chapter_count, r.sentence_count) for r in got) == [("x", 1, 1), ("y", 0, 0)]


def plain_outline(nodes):
    """(title, page) in reading order of (id, parent, ord, title, page)."""
    out = []

    def walk(parent):
        for i, _, _, title, page in sorted((n for n in nodes if n[1] == parent), key=lambda n: n[2]):
            if page is not None:
                out.append((title.strip(), page))
            walk(i)

    walk(None)
    return out


def test_outlines_of_any_shape(spark):
    rng = random.Random(6)
    docs = {}
    for d in range(25):
        nodes = []
        for k in range(rng.randint(0, 60)):
            parent = None if not nodes or rng.random() < 0.2 else rng.choice(nodes[-3:] if d % 2 else nodes)[0]
            nodes.append((f"n{k}", parent, k if rng.random() < 0.5 else 100 - k, f" t{k} ", rng.choice([k, k, None])))
        # Below a node that isn't there, and in a cycle: no root leads here.
        nodes += [("lost", "nowhere", 0, "lost", 1), ("below", "lost", 0, "below", 1), ("x", "y", 0, "x", 1), ("y", "x", 0, "y", 1), ("z", "z", 0, "z", 1)]
        docs[f"d{d}"] = nodes
    rows = [(d, *n) for d, ns in docs.items() for n in ns]
    df = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ord int, title string, page int").repartition(4)
    got = {}
    for r in R.flatten_outline(df).orderBy("doc_id", "entry_idx").collect():
        assert r.entry_idx == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.title, r.page))
    assert got == {d: w for d, ns in docs.items() if (w := plain_outline(ns))}


def test_deep_outline_takes_few_rounds(spark, monkeypatch):
    written = []
    real = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: written.append(name) or real(df, name))
    df = spark.range(500).select(F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("node_id"),
                                 F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(0).alias("ord"),
                                 F.concat(F.lit("t"), "id").alias("title"), F.col("id").cast("int").alias("page"))
    got = [r.page for r in R.flatten_outline(df).orderBy("entry_idx").collect()]
    assert got == list(range(500)) and len(written) <= 6
    assert R.flatten_outline(df.limit(0)).collect() == []
