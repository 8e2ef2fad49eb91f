"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``NODES`` virtual nodes on a ring of ``PLACES`` places; where they lie depends on the shard's number alone.
A key belongs to the first node clockwise of its own place; the keys between two nodes are an *arc*. A shard takes no
more than its load: a key that finds it full goes on clockwise to the next node of a shard with room.

Keys are placed in a fixed order: the first key of every arc, then the second of every arc, and so on, with the keys of an
arc in the order of their fingerprints. So how many keys each arc has is all it takes to know when each shard fills up, and
with that the shard and the slot of number r of arc a. The driver gets one count per arc, and the rows get back a table of
runs (arc, from, to, shard, first slot): both depend on the numbers of shards and nodes, not on the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafvoice.llm.buffers import mix
from leafvoice.llm.tables import Steps, table

PLACE_BITS = 16
PLACES = 1 << PLACE_BITS
#: Virtual nodes of a shard.
NODES = 64
#: An arc of a hot key is numbered in blocks, as many as let a block of it hold some 65,536 different rows.
BLOCK_BITS = 16
_U = np.uint64


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Place and shard of each virtual node, clockwise."""
    shard, node = np.divmod(np.arange(shards * nodes, dtype=_U), _U(nodes))
    at = mix(mix(shard + _U(1)) + node + _U(1))
    order = np.lexsort((shard, at))
    return (at >> _U(64 - PLACE_BITS)).astype(np.int64)[order], shard.astype(np.int64)[order]


def loads(keys: int, shards: int, slack: float) -> np.ndarray:
    """Most keys of each shard: without slack the shards' loads are at most one apart and just hold all keys."""
    if slack <= 0:
        return keys // shards + (np.arange(shards) < keys % shards)
    return np.full(shards, int(np.ceil((1 + slack) * keys / shards)))


def place_arcs(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> pd.DataFrame:
    """Runs of equal fate: keys ``low`` to ``high`` (excluded) of ``arc`` go to ``shard``, the first of them into ``slot``.

    ``counts``: keys per arc; ``owner``: shard of the node that ends it; ``room``: most keys of each shard. Which shards are
    full changes ``len(room)`` times at most; in between every arc leads to one shard, so loads are sums of counts.
    """
    n, shards, room = len(owner), len(room), room.astype(np.int64)
    arcs = np.arange(n)
    held, out = np.zeros(shards, np.int64), []
    at, end = 0, int(counts.max(initial=0)) * n

    def passed(cursor: int) -> np.ndarray:
        """Keys of each arc among the first ``cursor`` (round, arc) turns."""
        return np.minimum(counts, cursor // n + (arcs < cursor % n))

    while at < end:
        node = np.where((room - held)[owner] > 0, arcs, 3 * n)
        nearest = np.minimum.accumulate(np.concatenate([node, node + n])[::-1])[::-1][:n] % n
        goes_to, before = owner[nearest], passed(at)
        load = lambda cursor: held + np.bincount(goes_to, passed(cursor) - before, shards).astype(np.int64)  # noqa: E731, B023
        full = lambda cursor: bool(((load(cursor) >= room) & (held < room)).any())  # noqa: E731, B023
        low, high = at, end
        if full(end):
            while low < high:  # the first turn after which one more shard is full
                middle = (low + high) // 2
                low, high = (low, middle) if full(middle) else (middle + 1, high)
        after = passed(high)
        some = np.flatnonzero(after > before)
        run = pd.DataFrame({"arc": some, "low": before[some], "high": after[some], "shard": goes_to[some]})
        size = run["high"] - run["low"]
        run["slot"] = held[run["shard"]] + size.groupby(run["shard"]).cumsum() - size
        out.append(run)
        held, at = load(high), high
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("arc", "low", "high", "shard", "slot")})


def _frame(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in rows.columns))


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes (null has none) and 16 more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def assign_shards(docs: DataFrame, shards: int, slack: float = 0.0, nodes: int = NODES, keep: list[str] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row of ``docs`` (doc_id, text), and as struct ``_row`` the columns
    named by ``keep``. Slots of a shard are gapless from 0.

    The ring's key is doc_id. ``slack`` 0 fills all shards to loads that are at most one apart; with a slack of 0.25 none
    holds more than 1.25 times the mean, and fewer keys move when a shard is added. Null is a key like any other; rows of
    one key, be they a third of the table, are ordered by text, and equal rows by the part of the table they lie in, so
    no window holds a key as a whole. A null text has no bytes. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "ring")
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 64 - PLACE_BITS).alias("place"),
        F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")), text.isNull()).alias("print"),
        *([F.struct(*keep).alias("_row")] if keep else []))
    place, owner = ring(shards, nodes)
    arc = np.searchsorted(place, np.arange(PLACES)) % len(place)
    arcs = _frame(spark, pd.DataFrame({"place": np.arange(PLACES), "arc": arc}))
    rows = steps.keep(rows.join(arcs, "place").drop("place").withColumn("part", F.spark_partition_id()), "rows")
    unit = ["arc", "print", "part"]
    units = steps.keep(rows.groupBy(*unit).agg(F.count("*").alias("rows")), "units")
    sums = units.groupBy("arc").agg(F.sum("rows").alias("n")).toPandas()
    counts = np.zeros(len(owner), np.int64)
    counts[sums["arc"]] = sums["n"]
    keys = int(counts.sum())
    runs = _frame(spark, place_arcs(counts, owner, loads(keys, shards, slack)))
    bits = max(1, (keys >> BLOCK_BITS).bit_length())
    # Numbers along (block, print): a block is the fingerprint's first bits.
    units = units.withColumn("block", F.shiftrightunsigned("print", 64 - bits))
    blocks = units.groupBy("arc", "block").agg(F.sum("rows").alias("n"))
    earlier = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("arc", "block", earlier("n", Window.partitionBy("arc").orderBy("block")).alias("before"))
    inside = earlier("rows", Window.partitionBy("arc", "block").orderBy("print", "part"))
    starts = units.withColumn("inside", inside).join(blocks, ["arc", "block"]).select(*unit, (F.col("before") + F.col("inside")).alias("start"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*unit).orderBy("size")) - 1).join(starts, unit)
    number = F.col("start") + F.col("number")
    rows = rows.select(*(c for c in rows.columns if c not in ("number", "start", "part", "print")), number.alias("number"))
    return rows.join(runs, "arc").where("number >= low and number < high").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("number") - F.col("low")).alias("slot"),
        *(["_row"] if keep else []))


def write_shards(docs: DataFrame, folder: str, shards: int, slack: float = 0.0, rows_per_file: int = 100_000) -> None:
    """Write ``docs`` as ``folder/shard=…/``, each row with its ``slot``; files hold runs of ``rows_per_file`` slots in order.
    The columns lie in a struct ``row``, so that theirs may have any names."""
    placed = assign_shards(docs, shards, slack, keep=docs.columns)
    run = F.floor(F.col("slot") / rows_per_file)
    out = placed.select("shard", "slot", F.col("_row").alias("row"), run.alias("_run"))
    out.repartition("shard", "_run").sortWithinPartitions("shard", "slot").drop("_run").write.partitionBy("shard").parquet(folder)


def op12_ring_shards(spark, sf_dir):
    """All documents on 40 shards whose numbers of rows are at most one apart."""
    out = assign_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
