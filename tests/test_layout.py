import random

from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.operators import layout as L
from leafvoice.plans import blocks
from tests import fixtures, loops


def random_doc(rng, pages):
    out = []
    for p in range(1, pages + 1):
        runs, y = [], 700.0
        if rng.random() < 0.7:
            runs += [("Running Head", 9.0, 50.0, 760.0, 60.0), ("\n", 9.0, 0.0, 760.0, 0.0)]
        for _ in range(rng.randint(0, 12)):
            x = 50.0
            for _ in range(rng.randint(1, 4)):
                t = rng.choice(["W", "hen ", "Alpha", "beta-", "or", "Zed", " gap", "-", "x-", " ", "12", "iv", "A", "lower case"])
                size = rng.choice([11.0, 11.0, 11.2, 12.4, 16.0, 22.0])
                width = rng.choice([None, 0.0, len(t) * 5.0])
                runs.append((t, size, x, y + rng.choice([0, 0, 0.9, -1.0, 1.5]), width))
                x += len(t) * rng.choice([4.0, 5.0, 7.0])
            if rng.random() < 0.85:
                runs.append(("\n", 11.0, x, y, 0.0))
            y -= rng.choice([0.0, 1.0, 14.0, 14.0, 16.0, 40.0])
        out.append((p, runs))
    return out


def frame(spark, docs):
    rows = [(d, p, i, t, s, x, y, w) for d, pages in docs.items() for p, runs in pages
            for i, (t, s, x, y, w) in enumerate(runs)]
    return spark.createDataFrame(rows, schema.RUNS).repartition(4)


def test_paragraphs_match_loop(spark, monkeypatch):
    rng = random.Random(5)
    docs = {f"d{k}": random_doc(rng, rng.randint(1, 9)) for k in range(60)}
    # Small blocks, so that carried totals and copied neighbours are exercised.
    monkeypatch.setattr(L, "PAGES_PER_BLOCK", 2)
    monkeypatch.setattr(L.with_halo, "__defaults__", (12,))
    raw = blocks.materialize(L.raw_paragraphs(frame(spark, docs)), "t")
    got = {}
    for r in raw.orderBy("doc_id", "page", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.text, r.font_size))
    want = {d: loops.paragraphs_of(pages) for d, pages in docs.items()}
    assert got == {d: w for d, w in want.items() if w}
    final = {}
    for r in L.refine_paragraphs(raw).orderBy("doc_id", "para_idx").collect():
        assert r.para_idx == len(final.setdefault(r.doc_id, []))
        final[r.doc_id].append((r.page, r.text, r.font_size))
    want = {d: loops.without_chrome(loops.with_caps(w)) for d, w in want.items()}
    assert final == {d: w for d, w in want.items() if w}


def test_drop_caps_match_loop(spark, monkeypatch):
    rng = random.Random(6)
    docs = {f"d{k}": [(1 + i // 3, rng.choice(["A", "B", "low", "mid one", "Other"]), 11.0)
                      for i in range(rng.randint(1, 60))] for k in range(150)}
    rows = [(d, p // 2, p, i, i, t, s) for d, ps in docs.items() for i, (p, t, s) in enumerate(ps)]
    df = spark.createDataFrame(rows, "doc_id string, block long, page int, seq int, idx long, text string, font_size double")
    monkeypatch.setattr(L.with_halo, "__defaults__", (13,))
    got = {}
    for r in L.merge_drop_caps(df).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.text, r.font_size))
    assert got == {d: loops.with_caps(ps) for d, ps in docs.items()}


def test_dominant_size_agrees(spark):
    rng = random.Random(8)
    lined = L.group_lines(frame(spark, {"d": random_doc(rng, 6)}))
    a = L.join_runs(lined).select("page", "line", "font_size")
    b = L.dominant_font_size(lined).select("page", "line", "font_size")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_one_hot_document(spark):
    """A document of many blocks is numbered densely and its header found."""
    pages = [[(11, "Header line"), (30, f"Heading {p}"), (11, f"body of page {p} here.")] for p in range(1, 700)]
    runs = spark.createDataFrame(fixtures.book_runs("hot", pages), schema.RUNS)
    out = L.to_paragraphs(runs)
    got = out.agg(F.count("*").alias("n"), F.max("para_idx").alias("m"), F.count_distinct("para_idx").alias("u"),
                  F.max(F.col("text") == "Header line").alias("h")).first()
    assert (got.n, got.m, got.u, got.h) == (2 * 699, 2 * 699 - 1, 2 * 699, False)


def test_scan_in_chunks(spark):
    from leafvoice.plans.folds import scan

    rng = random.Random(2)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 81, 200)]
    df = spark.createDataFrame([(r,) for r in rows], "xs array<int>")
    step = lambda s, x: F.struct((s * 3 + x).cast("long").alias("s"), (s % 7 + x).alias("o"))
    for chunk in (2, 3, 64):
        for r in df.select("xs", scan(F.col("xs"), F.lit(1).cast("long"), lambda s, x: F.struct(((s * 3 + x) % 1009).alias("s"), (s % 7 + x).alias("o")), "bigint", chunk).alias("o")).collect():
            state, want = 1, []
            for x in r.xs:
                want.append(state % 7 + x)
                state = (state * 3 + x) % 1009
            assert r.o == want


def test_pages_of_many_runs_take_linear_time(spark):
    """Drifting heights on one page, and lines to be put into paragraphs: four times the runs in about four times the time."""
    import time

    def once(n):
        ys = [1000.0 - 0.4 * (i % 5) - i * 0.02 for i in range(n)]
        runs = spark.createDataFrame([("d", 1, i, "word", 11.0, 0.0, y, 20.0) for i, y in enumerate(ys)], schema.RUNS)
        lined = [r.line for r in L.group_lines(runs).orderBy("run_idx").collect()]
        line, anchor, want = 0, ys[0], []
        for y in ys:
            line, anchor = (line, anchor) if abs(anchor - y) <= 1.5 else (line + 1, y)
            want.append(line)
        assert lined == want
        lines = spark.createDataFrame([("d", 0, 1, i, float(900 - 14 * i), f"line {i}.", 11.0 + i % 3) for i in range(n)],
                                      "doc_id string, block long, page int, line int, y double, text string, font_size double")
        assert L.lines_to_paragraphs(lines).count() > n / 2
        start = time.time()
        L.group_lines(runs).write.format("noop").mode("overwrite").save()
        L.lines_to_paragraphs(lines).write.format("noop").mode("overwrite").save()
        return time.time() - start

    once(500)
    few, many = once(4000), once(16000)
    assert many < 10 * few + 2


def test_words_of_a_line_are_split_once(spark):
    """A line's words are counted where they are split, not again for each of them."""
    from leafvoice.sources.adapters import paragraphs_as_raw_items

    text = " ".join(f"w{i}" for i in range(3000)) + "  "
    rows = paragraphs_as_raw_items(spark.createDataFrame([("a", 1, 0, text), ("a", 1, 3, "x y"), ("b", 1, 4, " z")], "doc_id string, page int, para_idx long, text string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {(r.doc_id, r.item_idx): (r.str, r.has_eol) for r in rows.collect()}
    assert len(got) == 3003 and [k for k, v in got.items() if v[1]] == [("a", 2999), ("b", 40000)]
    assert got["a", 2999][0] == "w2999" and got["a", 30001] == ("y", False) and got["b", 40000][0] == "z"
