import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.operators import sections as S, sentences as N
from leafvoice.plans.anchored import anchored_marks
from leafvoice.plans import anchored
from tests import fixtures, loops


def random_paragraphs(rng, n):
    words = ["alpha", "beta", "The", "end.", "Stop!", "why?", "con", "dence", "pur-", "suit", "Dr.", "U.S.", "and,", "it's"]
    out, page = [], 1
    for _ in range(n):
        page += rng.random() < 0.3
        kind = rng.random()
        if kind < 0.12:
            out.append((page, rng.choice(["Chapter 3", "Prologue", "Big Title", "Part iv of", "12 34"]), rng.choice([11.0, 16.0, 22.0])))
        elif kind < 0.17:
            out.append((page, rng.choice(["```", "$", "\\(", "\\) x", "$a$", "```x```", "\\begin{q}", "─"]), 11.0))
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
            out.append((page, text, rng.choice([11.0, 11.0, 11.5, 0.0])))
    return out


def frames(spark, docs, outlines):
    paras = [(d, i, p, t, s) for d, ps in docs.items() for i, (p, t, s) in enumerate(ps)]
    entries = [(d, i, t, p) for d, es in outlines.items() for i, (t, p) in enumerate(es)]
    return (spark.createDataFrame(paras, schema.PARAGRAPHS).repartition(5),
            spark.createDataFrame(entries, schema.OUTLINE).repartition(3))


def collect(books):
    out, last = {}, None
    for r in N.book_content(books).orderBy("doc_id", "chapter_idx", "passage").collect():
        mode, chapters = out.setdefault(r.doc_id, (r.detection_mode, []))
        if last == (r.doc_id, r.chapter_idx):
            chapters[-1][2].extend(r.sentences)
            continue
        last = (r.doc_id, r.chapter_idx)
        assert mode == r.detection_mode and r.chapter_id == f"ch_{len(chapters) + 1}"
        chapters.append((r.title, r.start_page, r.sentences))
    return out


@pytest.mark.parametrize("block,seed", [(256, 1), (2, 2), (1, 3)])
def test_chapters_match_loop(spark, monkeypatch, block, seed):
    monkeypatch.setattr(S, "PAGES_PER_BLOCK", block)
    rng = random.Random(seed)
    docs = {f"d{k}": random_paragraphs(rng, rng.randint(1, 70)) for k in range(80)}
    outlines = {d: [(rng.choice(["One", "Two", ""]), rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
                for d in docs if rng.random() < 0.5}
    paras, outline = frames(spark, docs, outlines)
    books = N.books_from_paragraphs(paras, outline, splitter="simple", max_words=60)
    want = {d: loops.chapters_of(ps, outlines.get(d), 60) for d, ps in docs.items()}
    got = collect(books)
    for d in docs:
        assert got[d] == want[d], d
    rows = books.sentences.orderBy("doc_id", "global_idx").collect()
    seen = {}
    for r in rows:
        assert r.global_idx == len(seen.setdefault(r.doc_id, []))
        seen[r.doc_id].append(r.text)
    assert seen == {d: s for d, (_, cs) in want.items() if (s := [x for c in cs for x in c[2]])}


def test_long_chapter_is_cut_into_passages(spark, monkeypatch):
    monkeypatch.setattr(S, "PAGES_PER_BLOCK", 1)
    paras = []
    for k in range(3):
        paras.append((1 + k * 40, f"Chapter {k + 1}", 20.0))
        paras += [(1 + k * 40 + j // 2, f"Sentence {j} runs on here.", 11.0) for j in range(40)]
    df, _ = frames(spark, {"d": paras}, {"d": []})
    sections = S.choose_sections(df)
    assert sections.members.select("passage").distinct().count() > 30
    got = collect(N.books_from_paragraphs(df, splitter="simple"))
    assert got["d"] == loops.chapters_of(paras)


def test_tiers_alone(spark):
    rng = random.Random(9)
    docs = {"a": [(k // 3 + 1, f"para number {k} is here", 11.0) for k in range(40)]}
    df, outline = frames(spark, docs, {"a": [("B", 5), ("A", 2), ("C", 2), ("D", 9)]})
    got = S.sections_from_outline(df, outline).chapters.orderBy("chapter_idx").collect()
    assert [(r.title, r.start_page) for r in got] == [("C", 2), ("B", 5), ("D", 9)]
    got = S.sections_by_word_count(df, 50).chapters.orderBy("chapter_idx").collect()
    assert [(r.title, r.start_page) for r in got] == [("Part 1", 1), ("Part 2", 4), ("Part 3", 7), ("Part 4", 11)]
    assert S.sections_from_headings(df).chapters.count() == 0


def test_median(spark):
    rng = random.Random(4)
    docs = {f"d{k}": random_paragraphs(rng, rng.randint(1, 30)) for k in range(100)}
    df, _ = frames(spark, docs, {"x": []})
    got = {r.doc_id: r.median_size for r in S.weighted_median_size(S.features(df)).collect()}
    for d, ps in docs.items():
        w = sorted(s for _, t, s in ps for _ in range(max(1, int(len(t) / 20 + 0.5))) if s > 0)
        assert got.get(d) == (w[len(w) // 2] if w else None)


@pytest.mark.parametrize("start", [0, None])
def test_anchored_marks(spark, monkeypatch, start):
    monkeypatch.setattr(anchored, "BLOCKS_PER_GROUP", 3)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(40):
        pos = np.cumsum(rng.integers(0, 9, rng.integers(1, 120)))
        anchor, n = start, 0
        for i, p in enumerate(pos):
            hit = anchor is None or p >= anchor + 20
            want[f"k{k}", i] = (bool(hit), n)
            anchor, n = (int(p), n + 1) if hit else (anchor, n)
            rows.append((f"k{k}", i // 7, i, int(p)))
    df = spark.createDataFrame(rows, "key string, block long, idx long, p long").repartition(4)
    got = anchored_marks(df, ["key"], "block", "idx", F.col("p"), 20, start)
    assert {(r.key, r.idx): (r.marked, r.marks_before) for r in got.collect()} == want


def test_word_integrity(spark):
    runs = [r for d, (lines, _, _) in fixtures.WORD_CASES.items() for r in fixtures.case_runs(d, lines)]
    books = N.build_chapters(spark.createDataFrame(runs, schema.RUNS))
    text = {}
    for r in books.sentences.orderBy("doc_id", "global_idx").collect():
        text[r.doc_id] = text.get(r.doc_id, "") + " " + r.text
    for d, (_, must, must_not) in fixtures.WORD_CASES.items():
        assert all(m in text[d] for m in must) and not any(m in text[d] for m in must_not), (d, text[d])


@pytest.mark.parametrize("splitter", ["unicode", "simple"])
def test_five_page_book(spark, splitter):
    runs = spark.createDataFrame(fixtures.book_runs("b", fixtures.HARBOUR_BOOK), schema.RUNS)
    mode, chapters = collect(N.build_chapters(runs, splitter=splitter))["b"]
    assert mode == "heading"
    assert [(t, p, [len(s) for s in ss]) for t, p, ss in chapters] == [
        ("SALT AND LANTERNS", 1, [62]), ("CONTENTS", 2, [89]), ("Chapter 1", 3, [10, 89, 77, 55, 117, 36]),
        ("Chapter 2", 4, [28, 57, 104, 45, 41]), ("Chapter 3", 5, [22, 339, 61, 29, 24])]
    text = " ".join(s for _, _, ss in chapters for s in ss)
    for word in ("wheelbarrow", "unpainted", "Mr. Pettigrew", "Dr. Sorrel", "6.40"):
        assert word in text
    assert ".." not in text and " ." not in text


def test_words(spark):
    df = spark.createDataFrame([("d", "a  bc d"), ("e", "é")], "doc_id string, text string")
    got = {(r.doc_id, r.word_idx, r.char_index, r.word) for r in N.explode_words(df).collect()}
    assert got == {("d", 0, 0, "a"), ("d", 1, 3, "bc"), ("d", 2, 6, "d"), ("e", 0, 0, "é")}


def test_sums_before(spark):
    rng = random.Random(3)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 8, 9, 26, 27, 28, 90)]
    df = spark.createDataFrame([(r,) for r in rows], "s array<int>")
    for levels, chunk in ((0, 64), (1, 2), (3, 3), (3, 64)):
        for r in df.select("s", N.sums_before(F.col("s"), levels, chunk).alias("o")).collect():
            assert r.o == [sum(r.s[:k]) for k in range(len(r.s))]


def spanning(rng, n):
    """Paragraphs of one long chapter with spans that open and close, overlap, stay open or never could."""
    marks = ["```", "``` x ```", "````", "\\( a", "b \\)", "\\(\\)", "\\begin{q}", "\\end{q}", "\\begin{}", "\\begin{q", "z} \\end{q", "\\[ a", "b \\]", "\\[ x \\]", "c ] d",
             "$", "$a$", "\\( ``` \\)", "``` \\( ```", "\\[ \\( \\]", "\\begin{a} \\( \\end{a} \\)", "\\begin{a} x \\end{a} \\( y", "\\be- gin{q}", "\\( a\nb \\)", "x\ny"]
    out = [(1, "Chapter 1", 20.0)]
    for j in range(n):
        near = rng.random()
        if near < 0.10:
            text = rng.choice(marks)
        elif near < 0.2:
            text = f"Words before {rng.choice(marks)} and {rng.choice(marks)} words after here."
        else:
            text = f"Sentence {j} runs on here and it goes on for a while. " * rng.choice([1, 1, 1, 25]) + "It ends well."
        out.append((1 + j // 3, text, 11.0))
    return out + [(400, "Chapter 2", 20.0), (400, "One more.", 11.0), (401, "Chapter 3", 20.0), (401, "Last one.", 11.0)]


@pytest.mark.parametrize("seed", range(3))
def test_cuts_fall_where_no_span_is_open(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "PAGES_PER_BLOCK", 1)
    rng = random.Random(seed + 50)
    docs = {f"d{k}": spanning(rng, 60) for k in range(25)}
    df, _ = frames(spark, docs, {"d": []})
    got = collect(N.books_from_paragraphs(df, splitter="simple"))
    for d, ps in docs.items():
        assert got[d] == loops.chapters_of(ps), d


def test_closed_fences_leave_short_passages(spark, monkeypatch):
    """Code and formulas over several paragraphs: a chapter of 1,500 paragraphs is cut in nearly every block."""
    monkeypatch.setattr(S, "PAGES_PER_BLOCK", 1)
    paras = [(1, "Chapter 1", 20.0)]
    for j in range(300):
        paras += [(1 + j, t, 11.0) for t in ("```", "x = 1", "``` That is code.", "\\begin{eq} a", "= b \\end{eq} so there.", f"Sentence {j} runs on here.", "Then it goes on.")]
    paras += [(900, "Chapter 2", 20.0), (900, "One more.", 11.0), (901, "Chapter 3", 20.0), (901, "Last one.", 11.0)]
    df, _ = frames(spark, {"d": paras}, {"d": []})
    assert S.choose_sections(df).members.select("passage").distinct().count() > 290
    assert collect(N.books_from_paragraphs(df, splitter="simple"))["d"] == loops.chapters_of(paras)


def test_open_fence_stops_cuts(spark, monkeypatch):
    monkeypatch.setattr(S, "PAGES_PER_BLOCK", 1)
    paras = [(1, "Chapter 1", 20.0)] + [(1 + j // 3, f"Sentence {j} runs on here." if j != 50 else "``` open", 11.0) for j in range(100)]
    paras += [(90, "Chapter 2", 20.0), (90, "One more.", 11.0), (91, "Chapter 3", 20.0), (91, "Last one.", 11.0)]
    df, _ = frames(spark, {"d": paras}, {"d": []})
    cut = [r.passage for r in S.choose_sections(df).members.select("passage").distinct().collect()]
    assert 14 < len([p for p in cut if 0 <= p <= 51]) and not [p for p in cut if 51 < p <= 100]
    assert collect(N.books_from_paragraphs(df, splitter="simple"))["d"] == loops.chapters_of(paras)


def test_states_before(spark, monkeypatch):
    from leafvoice.plans import automaton

    monkeypatch.setattr(automaton, "BLOCKS_PER_GROUP", 3)
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(30):
        state = 1
        for i in range(rng.randint(1, 200)):
            f = [rng.randrange(4) for _ in range(4)] if rng.random() < 0.4 else None
            rows.append((f"k{k}" if k else None, i // 5, i, f))
            if f:
                want[f"k{k}" if k else None, i] = state
                state = f[state]
    df = spark.createDataFrame(rows, "key string, block long, at long, f array<int>").where("key is not null").repartition(4)
    got = automaton.states_before(df, ["key"], "block", "at", "f", 4, start=1)
    assert {(r.key, r.at): r.state for r in got.collect()} == {k: v for k, v in want.items() if k[0]}


def test_only_english_documents_are_repaired(spark):
    text = "The con dence of le Havre was pur- suit of ash."
    docs = {d: [(1, text, 11.0)] for d in ("en", "us", "fr", "none", "unlisted")}
    df, _ = frames(spark, docs, {"x": []})
    languages = spark.createDataFrame([("en", "en"), ("us", "en-US"), ("fr", "fr"), ("none", None)], "doc_id string, language string")
    got = {d: " ".join(cs[0][2]) for d, (_, cs) in collect(N.books_from_paragraphs(df, splitter="simple", languages=languages)).items()}
    whole = " ".join(loops.chapters_of(docs["en"])[1][0][2])
    assert got["en"] == got["us"] == whole != text
    assert got["fr"] == got["none"] == got["unlisted"] == text
