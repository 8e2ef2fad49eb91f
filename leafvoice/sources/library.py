"""A library on shared storage: append-only stores, one folder per batch, and a manifest.

Spark has no transaction over several tables. A batch is written to its own folder in every store and
listed in the manifest last; readers see listed batches only, so a book and its content appear together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.functions.text import col
from leafvoice.operators.sentences import Books

BUCKETS = 64
MANIFEST = "batch string, written_at timestamp"


def book_id(doc_id) -> Column:
    """Short id that a replay gives again."""
    return F.concat(F.lit("bk_"), F.substring(F.sha2(col(doc_id).cast("string"), 256), 1, 11))


def chunk_key(book, chapter, sentence_idx) -> Column:
    return F.concat_ws("::", col(book), col(chapter), col(sentence_idx).cast("string"))


def book_counts(chapters: DataFrame, sentences: DataFrame, number: Column | None = None) -> DataFrame:
    """Chapters and sentences per document. ``sentences`` has a row per sentence, or ``number`` of them in each row."""
    n = chapters.groupBy("doc_id").agg(
        F.count("*").alias("chapter_count"), F.first("detection_mode").alias("detection_mode")
    )
    s = sentences.groupBy("doc_id").agg((F.count("*") if number is None else F.sum(number)).alias("sentence_count"))
    return n.join(s, "doc_id", "left").withColumn("sentence_count", F.coalesce("sentence_count", F.lit(0)))


def book_rows(docs: DataFrame, counts: DataFrame, voice: str | None = None, added_at: Column | None = None) -> DataFrame:
    """A book per document; one without chapters counts none."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return docs.join(counts, "doc_id", "left").select(
        book_id("doc_id").alias("book_id"), "doc_id", "title", "file_name", "page_count", none("chapter_count"),
        none("sentence_count"), F.lit(voice).cast("string").alias("voice"), "detection_mode",
        (F.current_timestamp() if added_at is None else added_at).alias("added_at"),
    )


# --- storage ---------------------------------------------------------------------------------


def create_tables(spark: SparkSession, path: str) -> None:
    """Make the stores that are missing."""
    for name, ddl in {**schema.STORES, "manifest": MANIFEST}.items():
        if _exists(spark, f"{path}/{name}"):
            continue
        if name == "manifest":
            spark.createDataFrame([], ddl).write.parquet(f"{path}/{name}")
        else:
            empty = spark.createDataFrame([], ddl + ", bucket int")
            empty.write.partitionBy("bucket").parquet(f"{path}/{name}/batch=none")


def bucket_of(book: Column) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(BUCKETS)).cast("int")


def append_batch(spark: SparkSession, path: str, tables: dict[str, DataFrame], batch: str | None = None) -> str:
    """Write the tables as one batch; readers see all of it or nothing.

    A caller that may come again with the same rows gives the ``batch`` a name: one that is listed already
    is left as it is, and what a broken attempt has written under that name is replaced.
    """
    if batch is not None and not spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("batch") == batch).isEmpty():
        return batch
    batch = batch or uuid.uuid4().hex
    for name, df in tables.items():
        bucket = bucket_of(F.col("book_id"))
        # Files of even size: rows of one bucket come together, a bucket that is too large is divided.
        rows = df.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("written_at")).coalesce(1).write.mode(
        "append"
    ).parquet(f"{path}/manifest")
    return batch


def read_store(spark: SparkSession, path: str, name: str, book: str | None = None) -> DataFrame:
    """The listed batches of a store; of one ``book``, from the folders of its bucket alone."""
    ddl = schema.STORES[name] + ", bucket int, batch string"
    committed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("batch")
    rows = spark.read.schema(ddl).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    if book is not None:
        rows = rows.where((F.col("bucket") == bucket_of(F.lit(book))) & (F.col("book_id") == book))
    return (
        rows.join(committed, "batch", "left_semi").drop("batch", "bucket")
    )


def write_library(
    spark: SparkSession, books: Books, docs: DataFrame, path: str, voice: str | None = None,
    added_at: Column | None = None, batch: str | None = None,
) -> str:
    """Add documents: the book row with its counts, the chapters and the sentences. A ``batch`` that is written
    already is not written again."""
    rows = book_rows(docs, book_counts(books.chapters, books.passages, F.col("n")), voice, added_at)
    owned = lambda df, name: df.withColumn("book_id", book_id("doc_id")).select(*_names(schema.STORES[name]))
    return append_batch(spark, path, {
        "sentences": owned(books.sentences, "sentences"), "chapters": owned(books.chapters, "chapters"),
        "books": rows.select(*_names(schema.BOOKS)),
    }, batch)


def reset(spark: SparkSession, path: str) -> None:
    """Remove the library's own stores and nothing else under ``path``."""
    for name in [*schema.STORES, "manifest"]:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


# --- reads and changes -----------------------------------------------------------------------


def list_books(books: DataFrame) -> DataFrame:
    return books.orderBy(F.desc("added_at"), "doc_id")


def get_book(books: DataFrame, key: str) -> DataFrame:
    return books.where(F.col("book_id") == key)


def get_content(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the books in ``keys(book_id)``."""
    return table.join(keys.select("book_id"), "book_id", "left_semi")


def update_book_field(books: DataFrame, changes: DataFrame, field: str = "voice") -> DataFrame:
    """Set a field on the books named in ``changes(book_id, field)``; unknown books are ignored."""
    new = changes.select("book_id", F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    return (
        books.join(new, "book_id", "left")
        .withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field)))
        .select(*books.columns)
    )


def delete_books(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the books in ``keys(book_id)``."""
    gone = keys.select("book_id").distinct()
    return {name: df.join(gone, "book_id", "left_anti") for name, df in tables.items()}


CHUNK = ["book_id", "chapter_id", "sentence_idx"]


def get_chunk(chunks: DataFrame, book: str, chapter: str, sentence_idx: int) -> DataFrame:
    return chunks.where(
        (F.col("book_id") == book) & (F.col("chapter_id") == chapter) & (F.col("sentence_idx") == sentence_idx)
    )


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed overwrite: of the rows of a key the newest of ``new`` wins, else the stored one. The
    choice is an aggregate, so repeated writes of one key are reduced before the exchange."""
    rest = [c for c in chunks.columns if c not in CHUNK]
    both = chunks.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*CHUNK).agg(F.max_by(F.struct(*rest), F.struct("_new", "added_at")).alias("_row"))
        .select(*CHUNK, "_row.*").select(*chunks.columns)
    )


def count_chunks_by_book(books: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("book_id").agg(F.count("*").alias("chunks"))
    return books.select("book_id").join(n, "book_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def clear_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    return chunks.join(keys.select("book_id").distinct(), "book_id", "left_anti")


def latest_progress(events: DataFrame, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """The last write per key; the higher event id wins a tie. Reduced before the exchange."""
    rest = [c for c in events.columns if c not in keys]
    return (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "event_id")).alias("_row"))
        .select(*keys, "_row.*")
    )


def save_progress(progress: DataFrame, at: Column | None = None) -> DataFrame:
    """Stamp positions with the time of the write, ready to append."""
    return progress.withColumn("updated_at", F.current_timestamp() if at is None else at)
