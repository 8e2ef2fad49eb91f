"""Ordered work on keys of any size.

A window over a whole document or a whole reader would send a hot key to one task. Here a key is cut
into blocks along its order (pages, indexes, time slices). Rows are windowed inside ``(key, block)``;
only one summary row per block is combined over the key, and the result is joined back on
``(key, block)``, on which the rows are partitioned already. No key reaches one task with its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 8192
PAGES_PER_BLOCK = 256

#: A table with larger files than this isn't broadcast: what is 1 byte of a row in a file may be 200 in a hash table.
SMALL_FILES = 32768

_LOCAL = {"sum": F.sum, "max": F.max}


def block_of(index: str, size: int) -> Column:
    return F.floor(F.col(index) / F.lit(size)).cast("bigint")


def running(
    df: DataFrame, keys: list[str], block: str, order: list, specs: dict[str, tuple[str, Column]],
    long: DataFrame | None = None,
) -> DataFrame:
    """Add running totals along ``order`` inside ``keys``, the current row included.

    ``specs`` maps an output name to ``("sum" | "max", value)``; nulls are skipped. ``block`` must grow
    along the order. ``long``, a small table of some of ``keys``, says which keys may have more than one block: only
    these carry anything over. Without it all may.
    """
    values = {f"_v_{name}": value for name, (_, value) in specs.items()}
    base = df.withColumns(values)
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: _LOCAL[kind](f"_v_{n}").over(within) for n, (kind, _) in specs.items()})
    totals = only_long(base, long).groupBy(*keys, block).agg(*[_LOCAL[kind](f"_v_{n}").alias(f"_c_{n}") for n, (kind, _) in specs.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, block, *[_LOCAL[kind](f"_c_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in specs.items()]
    )
    joined = local.join(carry, [*keys, block], "left")
    merged = {
        n: (F.coalesce(F.col(n) + F.col(f"_c_{n}"), F.col(n), F.col(f"_c_{n}")) if kind == "sum"
            else F.greatest(F.col(n), F.col(f"_c_{n}")))
        for n, (kind, _) in specs.items()
    }
    return joined.withColumns(merged).drop(*values, *[f"_c_{n}" for n in specs])


def row_index(
    df: DataFrame, keys: list[str], block: str, order: list, name: str, long: DataFrame | None = None
) -> DataFrame:
    """Dense index from 0 along ``order`` inside ``keys``."""
    return running(df, keys, block, order, {name: ("sum", F.lit(1))}, long).withColumn(
        name, (F.col(name) - 1).cast("bigint")
    )


def previous(
    df: DataFrame, keys: list[str], block: str, order: list[str], cols: list[str], name: str, long: DataFrame | None = None
) -> DataFrame:
    """Add ``name``: a struct of ``cols`` of the row before, null at the first row of a key."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*cols).alias("v"))
    base = df.withColumn("_row", row)
    within = Window.partitionBy(*keys, block).orderBy(*order)
    ends = only_long(base, long).groupBy(*keys, block).agg(F.max_by("_row", F.struct(*order)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(block)
    carry = ends.select(*keys, block, F.lag("_end").over(before).alias("_end"))
    local = base.withColumn("_prev", F.lag("_row").over(within))
    return (
        local.join(carry, [*keys, block], "left")
        .withColumn(name, F.coalesce("_prev", "_end")["v"])
        .drop("_row", "_prev", "_end")
    )


def hand_out(rows: DataFrame, facts: DataFrame, keys: list[str], block: str, how: str = "inner") -> DataFrame:
    """Join one fact per key to the rows of keys of any size: the fact goes to every block first, so
    the rows meet it on ``(key, block)``."""
    places = rows.select(*keys, block).distinct().join(facts, keys, how)
    return rows.join(places, [*keys, block], how)


def with_halo(df: DataFrame, index: str, reach: int, size: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blocks over a dense index with ``reach`` rows of each neighbour copied in, so that ``lag`` and
    ``lead`` up to ``reach`` are right inside ``(key, _block)``. Keep ``_own`` rows afterwards."""
    b, at = block_of(index, size), F.col(index) % size
    # A block is far wider than the reach, so a row is copied to one neighbour at most.
    other = F.when(at < reach, b - 1).when(at >= size - reach, b + 1)
    return (
        df.withColumn("_block", F.explode(F.array_compact(F.array(b, other))))
        .withColumn("_own", F.col("_block") == b)
    )


def long_documents(df: DataFrame, index: str, size: int) -> DataFrame:
    """``doc_id`` of the documents with an index (from 0 or 1) past the first block, written. A pruned scan of what lies
    there; most corpora have few such documents or none."""
    return materialize(df.where(F.col(index) >= size).select("doc_id").distinct(), "long", few=True)


def only_long(rows: DataFrame, long: DataFrame | None) -> DataFrame:
    """The rows whose key is in ``long``. Adaptive execution broadcasts a small table of keys, and drops what hangs on an
    empty one before it runs."""
    return rows if long is None else rows.join(long, long.columns, "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over the cores when the input has fewer splits than cores, as one small or
    unsplittable file has. A large input keeps its splits and is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def busy_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Exchange before work that is heavy per row. The number of partitions is the session's, so that
    adaptive coalescing, which looks at bytes only, does not fold the work into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. There is no fallback to a local one: on a cluster each
    executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; ``drop_run`` removes it as a whole."""
    return f"{checkpoint_root(spark)}/leafvoice-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write an intermediate table once and read it back, for results that several branches use.
    The files are in the shared checkpoint folder, so a lost executor costs nothing, and each branch
    reads only its columns.

    The planner takes a table for as large as its files. Flags and indexes of millions of rows compress to a few megabytes
    there, so a table of all paragraphs would be collected by the driver to be broadcast. Joins with what isn't surely small
    are therefore merges. ``few`` says that the table is small in most corpora: then it goes to the rows it is joined to."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if stored_bytes(spark, path) > SMALL_FILES:
        return out.hint("merge")
    return out.hint("broadcast") if few else out


def stored_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_run(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results must have been written by then."""
    remove(spark, run_folder(spark))
