"""Reading decoder output and the documents' own metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.functions import fixed
from leafvoice.functions.text import js_trim
from leafvoice.plans.blocks import materialize, row_index


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema.RUNS).format(fmt).load(path)


def stream_runs(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema.RUNS).format(fmt).options(**options).load(path)


def normalize_raw_items(raw: DataFrame) -> DataFrame:
    """Decoder items to runs. Empty items go, and with them their line end; other line ends become a
    run of their own. ``run_idx`` keeps the order and leaves room for the line end."""
    t = F.col("transform")
    at = lambda i, default: F.when(t.isNotNull(), F.get(t, F.lit(i))).otherwise(F.lit(default))
    size = F.when(t.isNotNull(), F.abs(F.get(t, F.lit(3)))).otherwise(F.coalesce("height", F.lit(0.0)))
    run = lambda text, width: F.struct(text.alias("text"), width.alias("width"))
    item = run(F.col("str"), F.coalesce("width", F.lit(0.0)))
    runs = F.when(F.coalesce("has_eol", F.lit(False)), F.array(item, run(F.lit("\n"), F.lit(0.0)))).otherwise(F.array(item))
    return (
        raw.where("str != ''")
        .select("doc_id", "page", "item_idx", size.alias("font_size"), at(4, 0.0).alias("x"), at(5, 0.0).alias("y"),
                F.posexplode(runs).alias("pos", "run"))
        .select("doc_id", "page", (F.col("item_idx") * 2 + F.col("pos")).cast("int").alias("run_idx"),
                "run.text", "font_size", "x", "y", "run.width")
    )


def resolve_title(docs: DataFrame) -> DataFrame:
    """Adds ``title``: the metadata title, or the file name without its extension."""
    return docs.withColumn(
        "title",
        F.coalesce(F.nullif(js_trim("meta_title"), F.lit("")), F.regexp_replace("file_name", "(?i)\\.pdf\\z", "")),
    )


def accept_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to read, and the others with the reason."""
    is_pdf = F.coalesce(F.lower("file_name").endswith(".pdf"), F.lit(False))
    return files.where(is_pdf), files.where(~is_pdf).withColumn("reason", F.lit("Please choose a PDF file."))


def page_density(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``chars_per_page`` and ``scanned`` to ``docs``; pages without runs count too."""
    chars = runs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    mean = F.when(F.col("page_count") > 0, F.coalesce("chars", F.lit(0)) / F.col("page_count")).otherwise(F.lit(0.0))
    return docs.join(chars, "doc_id", "left").withColumn("chars_per_page", mean).drop("chars").withColumn(
        "scanned",
        (F.col("page_count") >= fixed.SCANNED_MIN_PAGES) & (F.col("chars_per_page") < fixed.SCANNED_CHARS_PER_PAGE),
    )


def split_scanned(runs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and those that look like scanned images."""
    rated = page_density(runs, docs)
    return rated.where(~F.col("scanned")), rated.where("scanned")


def _climbed(nodes: DataFrame) -> DataFrame:
    """Every node looks twice as far up: its path is put behind that of the node its own ends at. Nodes whose way up ends at
    no node go."""
    above = nodes.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
    more = nodes.where("up is not null").join(above, ["doc_id", "up"]).select(
        "doc_id", "node_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), "title", "page"
    )
    return nodes.where("up is null").unionByName(more)


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """Nested contents to ``(doc_id, entry_idx, title, page)`` in reading order; entries whose page is
    unknown go, their children stay. Nodes below no root, as in a cycle, go, too.

    By pointer doubling: after n rounds a node knows 4 ** n levels of the way up, so the number of rounds follows the
    logarithm of the depth, whatever the number of entries."""
    at = nodes.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.array("ord").alias("path"), "title", "page")
    most = nodes.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    known = 1
    while True:
        seen = Observation()
        at = materialize(at.observe(seen, F.count_if(F.col("up").isNotNull()).alias("open")), "outline")
        # No way up is longer than a document has nodes.
        if not seen.get["open"] or known >= most:
            break
        at, known = _climbed(_climbed(at)), known * 4
    flat = at.where("up is null")
    kept = flat.where("page is not null").withColumn("block", F.col("path")[0])
    return row_index(kept, ["doc_id"], "block", ["path"], "entry_idx").select(
        "doc_id", "entry_idx", js_trim(F.coalesce("title", F.lit(""))).alias("title"), "page"
    )
