"""From chapters to numbered sentences and words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.measures import est_sentence_seconds
from leafvoice.functions.segmenting import split_cleaned
from leafvoice.functions.text import clean_for_speech, is_english_voice, split_keeping_gaps
from leafvoice.operators.layout import to_paragraphs
from leafvoice.operators.sections import Sections, chapter_passages, choose_sections
from leafvoice.plans.blocks import ROWS_PER_BLOCK, block_of, materialize, running


@dataclass
class Books:
    chapters: DataFrame
    passages: DataFrame
    sentences: DataFrame


def split_passages(
    passages: DataFrame, splitter: str = "unicode", max_chars: int = fixed.MAX_SENTENCE_CHARS,
    repair: bool | Column = True,
) -> DataFrame:
    """Adds ``sentences``, an array; the text column goes. The repair of broken words is for English:
    switch it off for other languages, where its word list hits ordinary words, or give a condition on the
    columns of ``passages``."""
    cleaned = passages.withColumn("cleaned", clean_for_speech("text", repair)).drop("text")
    return cleaned.withColumn(
        "sentences",
        F.when(F.col("cleaned") == "", F.array().cast("array<string>")).otherwise(
            split_cleaned("cleaned", splitter, max_chars)
        ),
    ).drop("cleaned")


def chapter_sentences(
    paragraphs: DataFrame, sections: Sections, splitter: str = "unicode",
    max_chars: int = fixed.MAX_SENTENCE_CHARS, repair: bool = True, languages: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, chapter_key, passage, sentences)``: one array per passage. ``languages`` (doc_id, language) says which
    documents are English: only these are repaired then, an unlisted one isn't."""
    passages = chapter_passages(paragraphs, sections.members)
    if languages is None or not repair:
        return split_passages(passages, splitter, max_chars, repair)
    keys = ["doc_id", "chapter_key", "passage"]
    # The language meets a document's passages by their own keys, on which the texts are dealt already.
    english = languages.groupBy("doc_id").agg(F.bool_or(is_english_voice("language")).alias("_english"))
    places = sections.members.select(*keys).distinct().join(english, "doc_id", "left")
    known = passages.join(places.select(*keys, F.coalesce("_english", F.lit(False)).alias("_english")), keys, "left")
    return split_passages(known, splitter, max_chars, F.col("_english")).drop("_english")


def counted(passages: DataFrame) -> DataFrame:
    """Stores the number of sentences next to them, so that numbering reads no text."""
    return passages.withColumn("n", F.size("sentences").cast("bigint"))


def number_sentences(passages: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per sentence with its place in the chapter and in the document.

    Only the sentence counts per passage (``n``) are summed over a document; the sentences stay where
    they are.
    """
    places = chapters.select("doc_id", "chapter_key", "chapter_idx", "chapter_id", block_of("chapter_idx", ROWS_PER_BLOCK).alias("block"))
    sizes = passages.select("doc_id", "chapter_key", "passage", "n").join(places, ["doc_id", "chapter_key"])
    order = ["chapter_idx", "passage"]
    ahead = running(sizes, ["doc_id"], "block", order, {"through": ("sum", F.col("n"))}).withColumn(
        "before", F.col("through") - F.col("n")
    )
    begins = ahead.groupBy("doc_id", "chapter_key").agg(F.min("before").alias("chapter_from"))
    offsets = ahead.join(begins, ["doc_id", "chapter_key"]).select(
        "doc_id", "chapter_key", "passage", "chapter_idx", "chapter_id", "before", "chapter_from"
    )
    return (
        passages.join(offsets, ["doc_id", "chapter_key", "passage"])
        .select("doc_id", "chapter_idx", "chapter_id", "before", "chapter_from", F.posexplode("sentences").alias("pos", "text"))
        .select(
            "doc_id", "chapter_idx", "chapter_id",
            (F.col("before") + F.col("pos") - F.col("chapter_from")).alias("sentence_idx"),
            (F.col("before") + F.col("pos")).alias("global_idx"), "text",
        )
    )


def explode_sentences(chapters: DataFrame) -> DataFrame:
    """One row per sentence of ``(doc_id, chapter_idx, chapter_id, sentences)``."""
    passages = chapters.select(
        "doc_id", F.col("chapter_idx").alias("chapter_key"), F.lit(0).alias("passage"), "sentences"
    )
    stored = materialize(counted(passages), "passages")
    keys = chapters.select("doc_id", F.col("chapter_idx").alias("chapter_key"), "chapter_idx", "chapter_id")
    return number_sentences(stored, keys)


def sums_before(sizes: Column, levels: int = 3, chunk: int = 64) -> Column:
    """For each element the sum of those before it. Only folds over a chunk grow an array, so the time follows
    the length up to ``chunk ** levels`` elements and beyond."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs: F.aggregate(
        xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    if not levels:
        return fold(sizes)
    # Bound to a name first: an expression inside the lambda would be computed once per chunk.
    bound = lambda c, f: F.transform(F.array(c), f)[0]
    chunks = lambda xs: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(chunk)), lambda k: k < F.size(xs)), lambda k: F.slice(xs, k + 1, chunk)
    )
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    added = lambda cs: F.flatten(F.zip_with(
        cs, sums_before(F.transform(cs, total), levels - 1, chunk), lambda c, s: F.transform(fold(c), lambda x: x + s)
    ))
    return bound(sizes, lambda xs: bound(chunks(xs), added))


def explode_words(sentences: DataFrame) -> DataFrame:
    """One row per word with its index and character offset in the sentence. Filter sentences first."""
    offsets = sums_before(F.transform("pieces", lambda p: F.length(p["text"])))
    words = F.filter(F.arrays_zip("pieces", "offsets"), lambda p: p["pieces"]["is_word"])
    keep = [c for c in sentences.columns if c != "text"]
    return (
        sentences.withColumn("pieces", split_keeping_gaps("text")).withColumn("offsets", offsets)
        .select(*keep, F.posexplode(words).alias("word_idx", "w"))
        .select(*keep, "word_idx", F.col("w.offsets").alias("char_index"), F.col("w.pieces.text").alias("word"))
    )


def chapter_durations(passages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Sentences and estimated listening time per chapter, straight from the arrays."""
    secs = F.aggregate(F.transform("sentences", est_sentence_seconds), F.lit(0.0), lambda a, s: a + s)
    sums = passages.groupBy("doc_id", "chapter_key").agg(
        F.sum(F.size("sentences")).alias("sentences"), F.sum(secs).alias("seconds")
    )
    return chapters.join(sums, ["doc_id", "chapter_key"], "left").select(
        "doc_id", "chapter_idx", "chapter_id", "title", "start_page", "detection_mode",
        F.coalesce("sentences", F.lit(0)).alias("sentence_count"), F.coalesce("seconds", F.lit(0.0)).alias("est_seconds"),
    )


def books_from_paragraphs(
    paragraphs: DataFrame, outline: DataFrame | None = None, splitter: str = "unicode",
    max_words: int = fixed.PART_WORDS, max_chars: int = fixed.MAX_SENTENCE_CHARS, repair: bool = True,
    languages: DataFrame | None = None,
) -> Books:
    sections = choose_sections(paragraphs, outline, max_words)
    passages = materialize(counted(chapter_sentences(paragraphs, sections, splitter, max_chars, repair, languages)), "passages")
    return Books(sections.chapters, passages, number_sentences(passages, sections.chapters))


def build_chapters(
    runs: DataFrame, outline: DataFrame | None = None, splitter: str = "unicode",
    max_words: int = fixed.PART_WORDS, max_chars: int = fixed.MAX_SENTENCE_CHARS, repair: bool = True,
    languages: DataFrame | None = None,
) -> Books:
    """Text runs to chapters and sentences, end to end. With ``languages`` (doc_id, language) broken words are repaired in
    English documents only."""
    paragraphs = materialize(to_paragraphs(runs), "paragraphs")
    return books_from_paragraphs(paragraphs, outline, splitter, max_words, max_chars, repair, languages)


def book_content(books: Books) -> DataFrame:
    """Chapters with their sentences nested: one row per chapter, or per passage of a chapter that is
    kept in several."""
    keys = ["doc_id", "chapter_key"]
    return books.chapters.join(books.passages, keys, "left").select(
        "doc_id", "chapter_idx", "chapter_id", "title", "start_page", "detection_mode", "passage",
        F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences"),
    )
