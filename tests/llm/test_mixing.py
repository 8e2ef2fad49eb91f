"""Mixing: who is taken, how often, and rows that are equal."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafvoice.llm import mixing

DOC = "doc_id long, text string, source string, _size long, _d string, rank double, copies int, _row string, whole int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, "d", 0.5, 9, "r", k) for k, (i, t, s) in enumerate(rows)], DOC)


def plain_copies(sizes, target, most=3):
    """Expected copies per measure, by cutting at ``most`` and sharing the rest until none is above."""
    measure = {n: len(f"{n:b}") for n in sizes if n}
    words = Counter()
    for n in sizes:
        if n:
            words[measure[n]] += n
    capped = set()
    while True:
        rest = target - most * sum(words[m] for m in capped)
        unit = rest / max(1e-12, sum(words[m] * m for m in words if m not in capped))
        over = {m for m in words if m not in capped and unit * m > most * (1 + 1e-12)}
        if not over:
            return {m: most if m in capped else unit * m for m in words}
        capped |= over


def test_expected_copies(spark):
    rows = [(i, "w " * (i * i % 700), "abcd"[i % 4] if i % 9 else None) for i in range(900)]
    docs = table(spark, rows)
    sizes = defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len(t.split()))
    classes = mixing.sized(docs, 1).groupBy("source", "measure").agg(F.sum("size").alias("words"))
    targets = mixing.source_targets(classes.select("source", F.col("words").alias("size")))
    got = mixing.expected_copies(classes, targets).collect()
    for s, of in sizes.items():
        target = next(r.target for r in got if r.source == s)
        want = plain_copies(of, target)
        for r in got:
            if r.source == s and r.words:
                assert math.isclose(r.whole + (r.p or 0), want[r.measure], abs_tol=1e-6)
        assert math.isclose(sum(r.words * (r.whole + (r.p or 0)) for r in got if r.source == s), target, rel_tol=1e-9)


def test_inclusion_frequencies_follow_the_probabilities(spark):
    """Over many seeds: documents of a class are taken once more as often as p says, and p differs between classes."""
    rows = [(i, "w " * (3 if i % 2 else 200), "ab"[i % 5 == 0]) for i in range(600)]
    docs = table(spark, rows).cache()
    seen, p = Counter(), {}
    seeds = 12
    for seed in range(seeds):
        steps = mixing.Steps(spark, "test")
        sized = mixing.sized(docs, seed, F.col("doc_id"))
        plan = mixing.sampling_plan(sized, steps)
        for r in plan.collect():
            p[r.source, r.measure] = (r.whole, r.p or 0.0)
        for r in mixing._decided(sized, plan, steps).collect():
            seen[r.source, r.measure] += r.copies - r.whole
    n = Counter((s, len(f"{len(t.split()):b}")) for _, t, s in rows)
    for k, (_, want) in p.items():
        trials = seeds * n[k]
        assert abs(seen[k] / trials - want) < 4 * math.sqrt(max(want * (1 - want), 0.01) / trials) + 2 / n[k]
    assert len({round(x, 3) for _, x in p.values() if x}) >= 2


def test_only_a_sliver_is_ordered(spark):
    """With a small probability, too, the range in which the cut lies holds few of a source's documents."""
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") < 40, "a").otherwise("b").alias("source"))
    rows = mixing.sized(docs, 3)
    for p in (0.001, 0.5, 0.999):
        plan = spark.createDataFrame([("b", 2, p), ("a", 2, p)], "source string, measure int, p double").withColumn("words", F.lit(1))
        ranges = mixing._ranked(rows, plan).where("source = 'b'").groupBy(F.floor(F.col("rank") * mixing.RANGES).alias("r")).count()
        at = ranges.where(F.abs(F.col("r") / mixing.RANGES - 0.5) < 0.01).agg(F.max("count")).first()[0] or 0
        assert at < 0.002 * n


@pytest.mark.parametrize("ids", [None, 7])
def test_equal_rows_are_decided_one_by_one(spark, ids):
    """4,000 equal rows, of which the mix takes a part: what is planned is what comes out."""
    rows = [(ids, "five words and two more here", "a")] * 4000 + [(i, "w " * 30, "b") for i in range(20)] + [(i, "w " * 9, "c") for i in range(4000)]
    docs = table(spark, rows).repartition(5)
    plan = mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in plan:
        taken[r.source] += r.copies * r.size
    for s in "abc":
        target = next(r.target for r in plan if r.source == s)
        assert abs(taken[s] - target) <= 30
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert (r._size, r._d, r.rank, r.copies, r._row) == (-1, "d", 0.5, 9, "r")
    assert words == taken


def test_reruns_agree_however_the_table_lies(spark):
    rows = [(i % 300 if i % 7 else None, f"w{i % 90} " * (i % 40), "abc"[i % 3]) for i in range(900)]
    docs = table(spark, rows)
    of = lambda d: Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(d).collect())
    assert of(docs) == of(docs.repartition(7).orderBy(F.desc("text")))


def test_nothing_to_take(spark):
    docs = table(spark, [(1, None, "a"), (2, "", None), (3, " \t", "a")])
    assert {r.copies for r in mixing.mix_sources(docs).collect()} == {0} and mixing.mixed_documents(docs).collect() == []
    assert mixing.mix_sources(docs.limit(0)).collect() == []
