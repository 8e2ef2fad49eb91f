"""State machines that run along ordered rows of keys of any size.

A row's step is an array: the state after it for each state before it. Steps compose, so a block of rows is one step, too.
Blocks are composed per group of blocks, groups per key; then the start state is handed down again: to the groups, to the
blocks and to the rows. Each task sees the rows of a block, the blocks of a group, or the groups of a key, never the rows
of a key. Rows without a step leave the state as it is and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS_PER_GROUP = 256


def _composed(steps: Column, states: int) -> Column:
    """The step that consecutive steps make together."""
    nothing = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(steps, nothing, lambda acc, f: F.transform(acc, lambda s: F.element_at(f, s + 1)))


def _through(steps: Column, start: Column) -> Column:
    """The state before each of consecutive steps."""
    begin = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, f: F.struct(F.element_at(f, acc["s"] + 1).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    return F.aggregate(steps, begin, step, lambda acc: acc["out"])


def _listed(df: DataFrame, keys: list[str], order: str, step: str) -> DataFrame:
    """Keys and ``items``: (order, step) of their rows, in order."""
    item = F.struct(F.col(order).alias("at"), F.col(step).alias("f"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("items"))


def _handed_down(listed: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Keys, order and ``name``, the state before each item; ``entry`` is the state before the first."""
    steps = F.transform("items", lambda i: i["f"])
    each = listed.withColumn("_s", _through(steps, F.col("entry"))).select(*keys, F.explode(F.arrays_zip(F.transform("items", lambda i: i["at"]).alias("at"), "_s")).alias("_i"))
    return each.select(*keys, F.col("_i.at").alias(order), F.col("_i._s").alias(name))


def states_before(rows: DataFrame, keys: list[str], block: str, order: str, step: str, states: int, start: int = 0) -> DataFrame:
    """``keys, block, order, state`` of the rows that have a step, with the state before them.

    ``step`` is an array<int> of length ``states``; ``block``, a bigint, must grow along ``order``, which is unique in a key.
    """
    with_step = rows.where(F.col(step).isNotNull()).select(*keys, block, order, F.col(step).cast("array<int>").alias("_f"))
    in_block = _listed(with_step, [*keys, block], order, "_f")
    blocks = in_block.select(*keys, block, F.floor(F.col(block) / BLOCKS_PER_GROUP).cast("bigint").alias("_group"),
                             _composed(F.transform("items", lambda i: i["f"]), states).alias("_f"))
    in_group = _listed(blocks, [*keys, "_group"], block, "_f")
    groups = in_group.select(*keys, "_group", _composed(F.transform("items", lambda i: i["f"]), states).alias("_f"))
    in_key = _listed(groups, keys, "_group", "_f").withColumn("entry", F.lit(start))
    group_entry = _handed_down(in_key, keys, "_group", "entry")
    block_entry = _handed_down(in_group.join(group_entry, [*keys, "_group"]), keys, block, "entry")
    return _handed_down(in_block.join(block_entry, [*keys, block]), [*keys, block], order, "state")
