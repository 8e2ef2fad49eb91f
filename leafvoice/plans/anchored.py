"""Greedy windows over ordered positions: a row opens (or closes) a window when it lies at least
``width`` past the last row that did.

Where a window starts depends on the one before it, so a plain running total cannot express it. Inside
a block the rule is a short fold. Between blocks only the last mark matters, so every block of a long
key is reduced to a small table "first mark here → last mark here": tables are chained per group of
blocks and then per key, and each block is folded again from its true entry. Keys of one block take no part in that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafvoice.plans.blocks import only_long
from leafvoice.plans.folds import scan

BLOCKS_PER_GROUP = 256


def _table(pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that can be the block's first mark, and for each the last mark and the mark count."""
    nxt = np.searchsorted(pos, pos + width)
    last, count = pos.copy(), np.ones(len(pos), dtype=np.int64)
    for k in range(len(pos) - 1, -1, -1):
        if nxt[k] < len(pos):
            last[k], count[k] = last[nxt[k]], count[nxt[k]] + 1
    reach = min(len(pos), int(np.searchsorted(pos, pos[0] + width)) + 1)
    return pos[:reach], last[:reach], count[:reach]


def _enter(anchor, table, width: int):
    """Last mark and number of marks after a block entered with ``anchor`` as its last mark."""
    first, last, count = table
    k = 0 if anchor is None else int(np.searchsorted(first, anchor + width))
    return (anchor, 0) if k == len(first) else (int(last[k]), int(count[k]))


def _chain(a, b, width: int):
    """Table of block ``a`` followed by block ``b``."""
    after = [_enter(int(x), b, width) for x in a[1]]
    first = np.concatenate([a[0], b[0]])
    last = np.concatenate([[x for x, _ in after], b[1]]).astype(np.int64)
    count = np.concatenate([a[2] + np.array([n for _, n in after], dtype=np.int64), b[2]])
    reach = min(len(first), int(np.searchsorted(first, first[0] + width)) + 1)
    return first[:reach], last[:reach], count[:reach]


def _rows(pdf: pd.DataFrame):
    for f, l, c in zip(pdf["first"], pdf["last"], pdf["count"]):
        yield np.asarray(f, np.int64), np.asarray(l, np.int64), np.asarray(c, np.int64)


_TABLE = "first array<bigint>, last array<bigint>, count array<bigint>"


def _entries(arrays: DataFrame, keys: list[str], block: str, width: int, start: int | None, known: DataFrame | None) -> DataFrame:
    """``(keys, block, _anchor, _before)`` for the blocks of keys that have more than one."""
    types = dict(arrays.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in [*keys, block])
    group_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _group bigint"
    arrays = only_long(arrays, known)
    long = arrays.groupBy(*keys).count().where("count > 1").select(*keys)
    blocks = arrays.join(long, keys, "left_semi").select(
        *keys, block, F.transform("_items", lambda i: i["pos"]).alias("pos")
    )

    def tables(batches):
        for pdf in batches:
            cols = [_table(np.asarray(p, np.int64), width) for p in pdf.pop("pos")]
            yield pdf.assign(**{n: [list(c[i]) for c in cols] for i, n in enumerate(("first", "last", "count"))})

    def fold_group(pdf):
        pdf = pdf.sort_values(block)
        acc = None
        for t in _rows(pdf):
            acc = t if acc is None else _chain(acc, t, width)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "_group": pdf["_group"].iloc[0],
                              "first": list(acc[0]), "last": list(acc[1]), "count": list(acc[2])}])

    def walk(pdf, order, anchor, before):
        pdf = pdf.sort_values(order)
        anchors, counts = [], []
        for t in _rows(pdf):
            anchors.append(anchor)
            counts.append(before)
            anchor, n = _enter(anchor, t, width)
            before += n
        return pdf.drop(columns=["first", "last", "count"]).assign(
            _anchor=pd.array(anchors, dtype="Int64"), _before=counts
        )

    def enter_groups(pdf):
        return walk(pdf, "_group", start, 0)

    def enter_blocks(pdf):
        anchor = pdf["_in"].iloc[0]
        out = walk(pdf, block, None if pd.isna(anchor) else int(anchor), int(pdf["_done"].iloc[0]))
        return out[[*keys, block, "_anchor", "_before"]]

    per_block = blocks.mapInPandas(tables, f"{key_ddl}, {_TABLE}").withColumn(
        "_group", F.floor(F.col(block) / BLOCKS_PER_GROUP).cast("bigint")
    )
    groups = per_block.groupBy(*keys, "_group").applyInPandas(fold_group, f"{group_ddl}, {_TABLE}")
    entered = groups.groupBy(*keys).applyInPandas(enter_groups, f"{group_ddl}, _anchor bigint, _before bigint")
    return (
        per_block.join(
            entered.select(*keys, "_group", F.col("_anchor").alias("_in"), F.col("_before").alias("_done")),
            [*keys, "_group"],
        )
        .groupBy(*keys, "_group")
        .applyInPandas(enter_blocks, f"{key_ddl}, _anchor bigint, _before bigint")
    )


def anchored_marks(
    rows: DataFrame, keys: list[str], block: str, order: str, pos: Column, width: int,
    start: int | None = None, extra: list[str] | None = None, long: DataFrame | None = None,
) -> DataFrame:
    """Add ``marked`` (the row is a mark) and ``marks_before`` (marks earlier in the key).

    ``pos`` must not fall along ``order``; ``start`` is the position of a mark before the first row, or
    None when the first row is always a mark. Returns keys, block, order, ``extra`` columns and the two.
    ``long`` as for :func:`leafvoice.plans.blocks.running`.
    """
    extra = extra or []
    item = F.struct(F.col(order), pos.cast("bigint").alias("pos"), *[F.col(c) for c in extra])
    arrays = rows.groupBy(*keys, block).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    at = arrays.join(_entries(arrays, keys, block, width, start, long), [*keys, block], "left").withColumns({
        "_anchor": F.coalesce("_anchor", F.lit(start).cast("bigint")),
        "_before": F.coalesce("_before", F.lit(0).cast("bigint")),
    })

    # One running count per row; a row is a mark where it grows.
    begin = F.struct(F.col("_anchor").alias("a"), F.lit(0).alias("n"))

    def step(state: Column, it: Column) -> Column:
        hit = F.coalesce(it["pos"] >= state["a"] + width, F.lit(True))
        n = state["n"] + hit.cast("int")
        return F.struct(F.struct(F.when(hit, it["pos"]).otherwise(state["a"]).alias("a"), n.alias("n")).alias("s"), n.alias("o"))

    counted = at.withColumn("_counts", scan(F.col("_items"), begin, step, "int"))
    shifted = F.concat(F.array(F.lit(0)), F.slice("_counts", F.lit(1), F.size("_counts") - 1))
    rows_out = F.arrays_zip(F.col("_items").alias("it"), F.col("_counts").alias("n"), shifted.alias("m"))
    return counted.select(*keys, block, "_before", F.explode(rows_out).alias("_r")).select(
        *keys, block, F.col(f"_r.it.{order}").alias(order), *[F.col(f"_r.it.{c}").alias(c) for c in extra],
        (F.col("_r.n") > F.col("_r.m")).alias("marked"), (F.col("_before") + F.col("_r.m")).alias("marks_before"),
    )
