"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.tables import Steps


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """``node, label`` for each node of ``edges`` (a, b: long); the label is the smallest node reachable.

    In each round every node takes the least of its neighbours and itself, then that one's choice; edges are renamed by
    these choices, and those inside one name are gone. A star is done in one round, and edges only get fewer. Minima are
    summed up before the exchange, so a hub isn't gathered anywhere. Each round is written to the shared folder; only
    whether edges are left comes to the driver. Nulls and loops are left out; no edges: no rows."""
    left = steps.keep(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not left.limit(1).isEmpty():
        ends = left.select("a", "b").union(left.select("b", "a"))
        chosen = steps.keep(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("least")), "chosen")
        further = chosen.select(F.col("node").alias("n"), F.col("least").alias("label"))
        labels = steps.keep(chosen.join(further, F.col("least") == F.col("n")).select("node", "label"), "labels")
        rounds.append(labels)
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        renamed = left.join(of_a, "a").join(of_b, "b").where("la != lb")
        fewer = steps.keep(renamed.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        steps.free(chosen, left)
        left = fewer
    # A later round names the names of the one before.
    final = rounds[-1]
    for labels in reversed(rounds[:-1]):
        later = final.select(F.col("node").alias("n"), F.col("label").alias("l"))
        final = steps.keep(labels.join(later, F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label")), "labels")
    return final
