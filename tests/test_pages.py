import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from leafvoice import schema
from leafvoice.functions.text import is_whitespace_gap
from leafvoice.operators import layout as L, quality as Q
from leafvoice.plans import pages
from leafvoice.plans.pages import by_page

SHUFFLED = 7


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_come_back_as_they_were(spark, monkeypatch):
    """Every kind of value, nulls and null keys included, by page and in order, also where a page comes in many pieces."""
    rng = random.Random(1)
    some = lambda x: None if rng.random() < 0.2 else x
    rows = [(rng.choice(["a", "b", None]), rng.randint(1, 4), some(rng.randint(-(2**40), 2**40)), some(rng.randint(-(2**31), 2**31 - 1)), some(rng.random() * 1e9),
             some(rng.choice(["", "déjà", "😀 x", "\n"])), some(rng.random() < 0.5), some(bytes(rng.randrange(256) for _ in range(rng.randint(0, 5)))))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc string, page int, at long, i int, d double, t string, b boolean, raw binary").repartition(SHUFFLED)
    monkeypatch.setattr(pages, "ROWS_AT_ONCE", 100)

    def work(table, page_no):
        place = pages.numbers(table["at"])
        assert all((page_no[k], place[k]) <= (page_no[k + 1], place[k + 1]) for k in range(len(page_no) - 1))
        n = [int((page_no == p).sum()) for p in page_no]
        return page_no, {"n": pa.array(n)} | {c: table[c] for c in table.column_names}

    out = [StructField("n", LongType()), *(df.schema[c] for c in ("at", "i", "d", "t", "b", "raw"))]
    got = by_page(df, ["doc", "page"], ["at"], work, out).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc, r.page, r.at, r.i, r.d, r.t, r.b, bytes(r.raw) if r.raw is not None else None) for r in got), key=key) == sorted(rows, key=key)
    sizes = {}
    for r in rows:
        sizes[r[:2]] = sizes.get(r[:2], 0) + 1
    assert all(r.n == sizes[r.doc, r.page] for r in got)


def odd_runs(rng, docs):
    some = lambda x: None if rng.random() < 0.1 else x
    return [(d, p, i, some(rng.choice(["one", "two ", " three", "\n", "", " ", "é"])), some(rng.choice([11.0, 11.2, 16.0, 0.0])), some(50.0 + i * rng.choice([10.0, 40.0])),
             some(700.0 - i // 5 * 14 + rng.choice([0.0, 0.9, 1.6, float("nan")])), some(rng.choice([0.0, 12.0, 30.0])))
            for d in range(docs) for p in range(1, 4) for i in range(rng.randint(1, 40))]


def test_lines_of_odd_runs(spark):
    """Missing texts, places and sizes: the lines are those that windows over the runs give."""
    from pyspark.sql import Window

    runs = spark.createDataFrame([(str(r[0]), *r[1:]) for r in odd_runs(random.Random(4), 60)], schema.RUNS).repartition(SHUFFLED)
    lined = L.group_lines(runs).cache()
    page = Window.partitionBy("doc_id", "page").orderBy("run_idx")
    opens = F.coalesce((F.lag("text").over(page) == "\n") | (F.abs(F.col("y") - F.lag("y").over(page)) > 3), F.lit(True))
    parts = runs.withColumn("part", F.sum(opens.cast("int")).over(page)).where("text != '\n'")
    places = lambda df, c: {(r.doc_id, r.page, r.run_idx): r[c] for r in df.collect()}
    part, line = places(parts, "part"), places(lined, "line")
    assert part.keys() == line.keys()
    before = None
    for k in sorted(part):
        if before and before[:2] == k[:2]:
            assert line[k] - line[before] in ((1,) if part[k] != part[before] else (0, 1)), k
        else:
            assert line[k] == 0
        before = k
    at = Window.partitionBy("doc_id", "page", "line").orderBy("run_idx")
    end = F.col("x") + F.coalesce(F.nullif("width", F.lit(0.0)), F.length("text") * F.col("font_size") * 0.5)
    gap = lined.withColumns({"gap": F.col("x") - F.lag(end).over(at), "prev": F.lag("text").over(at)})
    piece = F.when(is_whitespace_gap("gap", "font_size", "prev", "text"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    want = gap.groupBy("doc_id", "page", "line").agg(F.min_by("y", "run_idx").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_idx", piece.alias("p")))), lambda x: x["p"]), "").alias("text"))
    sized = want.join(L.dominant_font_size(lined), ["doc_id", "page", "line"])
    got = L.join_runs(lined).select("doc_id", "page", "line", "y", "text", "font_size")
    rows = lambda df: sorted(map(str, df.select("doc_id", "page", "line", "y", "text", "font_size").collect()))
    assert rows(got) == rows(sized)


def test_pages_of_line_ends_only_have_no_lines(spark):
    runs = spark.createDataFrame([("a", 1, i, "\n", 11.0, 0.0, 700.0, 0.0) for i in range(5)] + [("b", 1, 0, None, 11.0, 0.0, 0.0, 0.0)], schema.RUNS)
    assert L.raw_paragraphs(runs).count() == 0


def test_runs_are_exchanged_in_pages(spark):
    """No exchange, sort or window sees single runs: what a task holds doesn't follow the number of runs it gets."""
    runs = spark.createDataFrame([("a", 1, 0, "tion", 11.0, 0.0, 700.0, 0.0)], schema.RUNS).repartition(3)
    lines = L.join_runs(L.group_lines(runs))
    for df in (lines, L.group_lines(runs), Q.runs_in_context(runs, "tion")):
        plan = plan_of(df)
        assert "run_idx" not in "".join(x for x in plan.split("\n") if "Sort " in x or "hashpartitioning" in x or "Window" in x), plan
    assert "Window" not in plan_of(lines) and "ObjectHashAggregate" not in plan_of(lines)


def test_hits_in_context(spark):
    rng = random.Random(9)
    texts = ["tion", "x", "y", None, "nation", "z"]
    rows = [(d, p, i * 2, rng.choice(texts), 11.0, float(i), 0.0, 0.0) for d in (None, "a", "b", "c") for p in (1, 2, None, 3) for i in range(rng.choice([0, 1, 5, 60]))]
    rng.shuffle(rows)
    got = Q.runs_in_context(spark.createDataFrame(rows, schema.RUNS).repartition(SHUFFLED), "tion", 2, 4, 5)
    want = []
    for d in "abc":
        match = 0
        for p in (1, 2, 3):
            page = sorted((r for r in rows if r[:2] == (d, p)), key=lambda r: r[2])
            for i in (i for i, r in enumerate(page) if r[3] and "tion" in r[3]):
                match += 1
                want += [(d, match, p, k, k == i, page[k][3], page[k][5]) for k in range(max(0, i - 2), min(len(page), i + 5)) if match <= 5]
    assert want and sorted(map(str, want)) == sorted(str((r.doc_id, r.match, r.page, r.pos, r.is_match, r.text, r.x)) for r in got.collect())
