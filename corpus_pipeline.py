"""Documents to token packs: rules, near copies, test items, mix, packs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafvoice.llm.decontaminate import find_contamination
from leafvoice.llm.minhash import near_duplicates
from leafvoice.llm.mixing import mixed_documents
from leafvoice.llm.rules import kept_documents
from leafvoice.llm.tables import Steps, table
from leafvoice.llm.tokens import token_digests
from leafvoice.plans.blocks import run_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the one with the smallest doc_id, one without an id
    only where there is no other. Groups are of texts, so different texts that share a doc_id, or have none, are judged
    each on its own. Texts without words link with nothing. Of rows equal in doc_id and text one stays, the least by its columns.

    Texts are told apart by 64-bit fingerprints here."""
    steps = Steps(spark, "pipeline")
    own = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), own.alias("own"))
    found = near_duplicates(docs.select(own.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("own")) \
        .agg(F.first("component_id").alias("group"), F.first("n_shingles").alias("n"))
    members = steps.keep(rows.select("id", "own").distinct().join(found, "own"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("first")
    kept = members.where("n > 0").groupBy("group").agg(first).select("first.id", "first.own").union(members.where("n = 0").select("id", "own"))
    kept = steps.keep(kept.select(F.col("id").alias("kept_id"), F.col("own").alias("kept_own")), "kept")
    # Repeats are reduced before the exchange.
    once = rows.groupBy("own", "id").agg(F.min("row").alias("row"))
    return once.join(kept, (F.col("own") == F.col("kept_own")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a test item occurs."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns).where("n_hit = 0").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs of token ids, written and read back: one row per document and copy."""
    return token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix", mix),
    ("token_output", token_output),
]
#: Signatures, the learned list, hashed ranks and token ids are outside SQL; tests/llm/test_pipeline.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{run_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
