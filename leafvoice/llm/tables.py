"""Input tables and intermediate results of the operators here."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafvoice.plans.blocks import remove, run_folder

#: A word is a run of other characters than these.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones with clashing names can't get in the way."""
    return df.select(*names)


def word_count(text: str | Column) -> Column:
    """Number of words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def numbered(rows: DataFrame, key: str, steps: "Steps") -> DataFrame:
    """Adds ``number``, from 0, of each row among those of equal ``key`` (not null). Rows are counted per part of the written
    table first, so a key's rows are never in one task. Columns ``_part`` and ``number`` are taken."""
    rows = steps.keep(rows.withColumn("_part", F.spark_partition_id()), "numbered")
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_part")) - 1
    return rows.withColumn("_inside", inside).join(counts, [key, "_part"]).withColumn("number", F.col("_before") + F.col("_inside")) \
        .drop("_part", "_inside", "_before")


class Steps:
    """Intermediate tables of one run of an operator, in the shared folder; ``free`` deletes those that are used
    up, so that a long operator holds no more than it still needs."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{run_folder(self.spark)}/{self.name}-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self.collect()
        return out

    def bucketed(self, tables: Iterable[DataFrame], name: str, by: str) -> DataFrame:
        """One table, in buckets by ``by``, of all ``tables``, which are written one after the other: what groups by this column
        later needs no exchange of it. There are as many buckets as an exchange has partitions."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"leafvoice_{self.name}_{name}_{uuid.uuid4().hex}"
        path = f"{run_folder(self.spark)}/{table}"
        for df in tables:
            df.write.format("parquet").mode("append").option("path", path).bucketBy(buckets, by).saveAsTable(table)
            self.collect()
        out = self.spark.table(table)
        self.paths[id(out)] = (out, path, table)
        return out

    def collect(self) -> None:
        """Shuffle files go when the driver collects its garbage; the exchanges behind a written table are done."""
        gc.collect()
        self.spark._jvm.System.gc()

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path, *named = self.paths.pop(id(t))
            for table in named:
                self.spark.sql(f"DROP TABLE {table}")
            remove(self.spark, path)
