"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafvoice.llm.tables import Steps, numbered, table, word_count

#: Ranges of rank whose words are counted per source; one of them is ordered.
RANGES = 1 << 14
CYCLE = (5, 2, 1)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights of ``cycle`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is above:
    ordered by most * size / weight, the capped ones are a prefix, found by running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy(F.lit(0))
    # One row per source from here on.
    named = F.row_number().over(everywhere.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((named - 1) % len(cycle) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    by_limit = everywhere.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "all": F.sum("source_size").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "capped": F.coalesce(F.sum("top").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
    })
    # What a unit of weight gets if exactly the sources before this one are capped.
    per = per.withColumn("unit", (F.col("all") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("unit") * F.col("weight") <= F.col("top"), F.col("unit"))
    unit = F.first(fits, ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("least", unit).select(
        "source", "source_size", F.coalesce(F.least(F.col("least") * F.col("weight"), F.col("top")), F.col("top")).alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``source, measure, source_size, target, whole, p`` from ``classes`` (source, measure, words): how often a document is
    taken for certain, and with which probability once more.

    Expected copies are in proportion to the measure, at most ``most``, and such that a source's words come to its target
    on average. With the largest measures first the capped ones are a prefix, found by running sums."""
    facts = classes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    falling = Window.partitionBy("source").orderBy(F.desc("measure"))
    capped = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("measure")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    # Copies per unit of measure if exactly the measures before this one are capped.
    facts = facts.withColumn("unit", F.try_divide(F.col("target") - most * capped, open_))
    fits = F.when(F.col("unit") * F.col("measure") <= most, F.col("unit"))
    facts = facts.withColumn("level", F.first(fits, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    highest = F.lit(float(most))
    facts = facts.withColumn("copies", F.greatest(F.least(F.coalesce(F.col("level") * F.col("measure"), highest), highest), F.lit(0.0)))
    # Rounding must not make a whole number a copy less.
    whole = F.floor(F.col("copies") + 1e-9)
    return facts.withColumn("whole", whole.cast("long")).withColumn("p", F.col("copies") - F.col("whole")).select(
        "source", "measure", "words", "source_size", "target", "whole", F.when(F.col("p") > 1e-9, F.col("p")).alias("p"))


def sized(docs: DataFrame, seed: int, *keep: Column) -> DataFrame:
    """``keep``, ``source``, ``size``, ``measure`` and ``draw`` of each row: a random number from id, source and text, so that reruns agree."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *keep, F.col("source").alias("source"), word_count("text").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("source").isNull(), text).alias("draw"),
    ).withColumn("measure", F.length(F.bin("size")))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their facts and ``rank``, the ratio r of random odds to inclusion odds as r / (1 + r); null for who can't be taken
    once more. About p of those with probability p rank below a half."""
    u = (F.pmod("draw", F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    plan = plan.withColumnsRenamed({"source": "s", "measure": "m"})
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m"))).drop("s", "m", "words")
    return joined.withColumn("rank", F.when((F.col("size") > 0) & F.col("p").isNotNull(), odds / (1 + odds)))


def sampling_plan(rows: DataFrame, steps: Steps, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """What decides on each document, one row per source and measure: ``expected_copies``, and where the source's order of
    ranks is cut: taken are ranks below (``cut``, ``cut_draw``) and, of the ``equals`` rows there, the first ``of_equals``.

    ``rows`` as from :func:`sized`. The words of ``RANGES`` ranges of rank say in which one the target is met; only that
    one, a thousandth of a source's documents at most, is ordered."""
    classes = steps.keep(rows.groupBy("source", "measure").agg(F.sum("size").alias("words")), "classes")
    targets = source_targets(classes.select("source", F.col("words").alias("size")), cycle, most)
    facts = steps.keep(expected_copies(classes, targets, most), "facts")
    rest = facts.groupBy("source").agg(F.greatest(F.max("target") - F.sum(F.col("whole") * F.col("words")), F.lit(0.0)).alias("rest"))
    ranked = _ranked(rows, facts).where("rank is not null").withColumn("range", F.least(F.floor(F.col("rank") * RANGES), F.lit(RANGES - 1)))
    sums = ranked.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = lambda column, *order: F.coalesce(
        F.sum(column).over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    null_safe = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sums = sums.withColumn("begin", before("n", "range")).join(rest.withColumnRenamed("source", "s"), null_safe("source", "s")).drop("s")
    met = sums.where("begin + n > rest and begin <= rest").groupBy("source", "rest").agg(F.min("range").alias("range"), F.min_by("begin", "range").alias("begin"))
    met = steps.keep(met.select(F.col("source").alias("s"), F.col("range").alias("r"), "rest", "begin"), "met")
    # Rows equal in all that matters are one from here on, however many they are.
    edge = ranked.join(met, null_safe("source", "s") & (F.col("range") == F.col("r"))).groupBy("source", "rank", "draw", "rest", "begin") \
        .agg(F.count("*").alias("equals"), F.first("size").alias("size"))
    ahead = F.col("begin") + before(F.col("equals") * F.col("size"), "rank", "draw")
    # One more row is taken as long as that brings the words taken nearer to the target.
    takes = F.least(F.floor((F.col("rest") - ahead) / F.col("size") + 0.5), F.col("equals"))
    last = edge.withColumn("takes", takes).where("takes > 0").groupBy("source").agg(F.max(F.struct("rank", "draw", "takes", "equals")).alias("last"))
    cuts = met.join(last, null_safe("s", "source"), "left").select(
        "s", F.coalesce("last.rank", F.col("r") / F.lit(float(RANGES))).alias("cut"), F.coalesce("last.draw", F.lit(-(1 << 63))).alias("cut_draw"),
        F.coalesce("last.takes", F.lit(0)).alias("of_equals"), F.coalesce("last.equals", F.lit(0)).alias("equals"))
    # No cut: all that can be taken once more is.
    return steps.keep(facts.join(cuts, null_safe("source", "s"), "left").drop("s").fillna({"cut": 2.0, "cut_draw": 0, "of_equals": 0, "equals": 0}), "plan")


def _decided(rows: DataFrame, plan: DataFrame, steps: Steps) -> DataFrame:
    """``rows`` (as from :func:`sized`) with ``copies``. Each row is decided where it is; rows that are equal at the cut are numbered."""
    ranked = _ranked(rows, plan)
    at_cut = F.coalesce((F.col("rank") == F.col("cut")) & (F.col("draw") == F.col("cut_draw")), F.lit(False))
    once_more = lambda taken: F.when(F.col("size") > 0, F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).otherwise(0).cast("long")
    below = (F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & (F.col("draw") < F.col("cut_draw")))
    some = F.col("of_equals") < F.col("equals")
    out = ranked.where(~(at_cut & some)).withColumn("copies", once_more(below | at_cut))
    if plan.where(some).limit(1).isEmpty():
        return out
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    split = numbered(ranked.where(at_cut & some).withColumn("_key", key), "_key", steps)
    return out.union(split.withColumn("copies", once_more(F.col("number") < F.col("of_equals"))).select(out.columns))


def mix_sources(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of each row of ``docs`` (doc_id, source, text).

    Size is the number of words; null and empty texts have size 0 and are never taken. A document's expected copies are
    in proportion to its measure, the number of binary digits of its size, so that long documents are preferred mildly.
    Their whole part is certain. With the fraction p as inclusion probability, documents are ranked by the ratio of random
    odds u / (1 - u) to inclusion odds p / (1 - p), and are taken once more in that order as long as this brings the
    source's words nearer to its target. Equal rows are decided one by one; null is a source like any other, the last one.
    """
    steps = Steps(docs.sparkSession, "mixing")
    rows = steps.keep(sized(docs, seed, F.col("doc_id")), "sizes")
    plan = sampling_plan(rows, steps, cycle, most)
    return _decided(rows, plan, steps).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. The plan is made of sizes; texts stay where they are."""
    steps = Steps(docs.sparkSession, "mixing")
    plan = sampling_plan(steps.keep(sized(docs, seed), "sizes"), steps, cycle, most)
    rows = _decided(sized(docs, seed, F.struct(*docs.columns).alias("_row")), plan, steps).where("copies > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op4_pareto_mixing(spark, sf_dir):
    """The mix of all documents; targets share all words 5 : 2 : 1 over the sources."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
