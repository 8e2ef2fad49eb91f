"""Books with their progress, where to start reading, which voice to use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.measures import est_sentence_seconds, progress_pct
from leafvoice.functions.text import (
    chapter_index_from_id, in_progress, is_content_start, is_english_voice, is_front_matter,
)


def books_with_progress(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Every book with its last position, if any. ``progress`` has one row per book."""
    return books.join(
        progress.select("book_id", "chapter_id", "sentence_idx", "offset_sec", "char_index", "updated_at"), "book_id", "left"
    )


def books_with_content(books: DataFrame, content: DataFrame) -> DataFrame:
    return books.join(content, "book_id")


def missing_content(books: DataFrame, content: DataFrame) -> DataFrame:
    return books.join(content, "book_id", "left_anti")


def place_progress(progress: DataFrame, sentences: DataFrame) -> DataFrame:
    """Global index of the stored sentence; the first one when it is not there any more."""
    at = sentences.select("book_id", "chapter_id", "sentence_idx", "global_idx")
    return progress.join(at, ["book_id", "chapter_id", "sentence_idx"], "left").withColumn(
        "global_idx", F.coalesce("global_idx", F.lit(0))
    )


def library_overview(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Books with chapter reached and percentage, unsorted; see :func:`list_overview`."""
    return books_with_progress(books, progress).withColumn(
        "chapter_idx", F.coalesce(chapter_index_from_id("chapter_id"), F.lit(0))
    ).withColumn("progress_pct", progress_pct("chapter_idx", "chapter_count"))


def list_overview(overview: DataFrame) -> DataFrame:
    return overview.orderBy(F.desc("added_at"), "doc_id")


def continue_reading(overview: DataFrame, owner: str | None = None) -> DataFrame:
    """The first listed book that is begun and not finished; one per ``owner`` if given."""
    started = overview.where(in_progress("progress_pct"))
    rank = F.struct((-F.unix_micros("added_at")).alias("newest"), F.col("doc_id"))
    keys = [owner] if owner else []
    rest = [c for c in overview.columns if c not in keys]
    out = started.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return out.where("b is not null").select(*keys, "b.*")


def chapter_seconds(sentences: DataFrame) -> DataFrame:
    """Estimated seconds per chapter from sentence rows."""
    return sentences.groupBy("doc_id", "chapter_idx").agg(F.sum(est_sentence_seconds("text")).alias("est_seconds"))


def book_duration(durations: DataFrame) -> DataFrame:
    return durations.groupBy("doc_id").agg(F.sum("est_seconds").alias("est_seconds"))


def first_content_sentence(chapters: DataFrame, sentences: DataFrame) -> DataFrame:
    """Where an unread book opens: a chapter of some length whose title begins a book, else one that
    is not front matter, else the start."""
    sizes = sentences.groupBy("doc_id", "chapter_idx").agg(
        F.count("*").alias("n"), F.min("global_idx").alias("first_idx")
    )
    rank = F.when(is_content_start("title"), 1).when(~is_front_matter("title"), 2)
    rated = chapters.join(sizes, ["doc_id", "chapter_idx"], "left").withColumn(
        "rank", F.when(F.col("n") >= fixed.MIN_CONTENT_SENTENCES, rank)
    )
    order = F.when(F.col("rank").isNotNull(), F.struct("rank", "chapter_idx"))
    return rated.groupBy("doc_id").agg(F.coalesce(F.min_by("first_idx", order), F.lit(0)).alias("global_idx"))


def preferred_voice(voices: DataFrame) -> DataFrame:
    """Best voice per device: English before others, then by name pattern, then the default, then the
    first listed."""
    named = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(fixed.VOICE_PATTERNS))):
        named = F.when(F.col("name").rlike(pattern), k).otherwise(named)
    n = len(fixed.VOICE_PATTERNS)
    priority = F.coalesce(named, F.when(F.col("is_default"), n).otherwise(n + 1))
    english = F.coalesce(is_english_voice("lang"), F.lit(False))  # a voice without a language isn't English
    rank = F.struct((~english).alias("foreign"), priority.alias("priority"), F.col("ord"))
    return voices.groupBy("device_id").agg(F.min_by("voice_id", rank).alias("voice_id"))
