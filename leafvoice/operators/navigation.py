"""Positions in a book: cumulative times, neighbours, seeking, skipping, resuming.

``sentences`` is (doc_id, chapter_idx, chapter_id, sentence_idx, global_idx, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.functions.measures import clamp, est_sentence_seconds, round_half_up, seek_char
from leafvoice.functions import fixed
from leafvoice.functions.text import char_index_of_word
from leafvoice.plans.blocks import ROWS_PER_BLOCK, block_of, hand_out, materialize, running

CHARS_PER_SLOT = 1024


def chapter_starts(durations: DataFrame) -> DataFrame:
    """Adds ``start_sec``: seconds of the chapters before. ``durations`` has ``est_seconds`` per chapter."""
    rows = durations.withColumn("block", block_of("chapter_idx", ROWS_PER_BLOCK))
    out = running(rows, ["doc_id"], "block", ["chapter_idx"], {"through": ("sum", F.col("est_seconds"))})
    return out.withColumn("start_sec", F.col("through") - F.col("est_seconds")).drop("block", "through")


def sentence_starts(sentences: DataFrame) -> DataFrame:
    """``(doc_id, chapter_idx, sentence_idx, global_idx, book_sec, chapter_sec)``: estimated seconds before
    the sentence, in its book and in its chapter."""
    rows = sentences.select(
        "doc_id", "chapter_idx", "sentence_idx", "global_idx", block_of("global_idx", ROWS_PER_BLOCK).alias("block"),
        est_sentence_seconds("text").alias("sec"),
    )
    # The text is read once; the totals work on numbers.
    rows = materialize(rows, "seconds")
    rows = running(rows, ["doc_id"], "block", ["global_idx"], {"through": ("sum", F.col("sec"))})
    rows = rows.withColumn("book_sec", F.col("through") - F.col("sec"))
    # Times only grow, so the latest chapter start is the largest one.
    begins = F.when(F.col("sentence_idx") == 0, F.col("book_sec"))
    rows = running(rows, ["doc_id"], "block", ["global_idx"], {"chapter_from": ("max", begins)})
    return rows.withColumn("chapter_sec", F.col("book_sec") - F.col("chapter_from")).drop(
        "block", "sec", "through", "chapter_from"
    )


def chapter_position(starts: DataFrame, positions: DataFrame) -> DataFrame:
    """Seconds into the chapter and the book for ``positions(doc_id, chapter_idx, sentence_idx,
    position_sec)``; ``starts`` is from :func:`sentence_starts`."""
    at = starts.select("doc_id", "chapter_idx", "sentence_idx", "chapter_sec", "book_sec")
    return positions.join(at, ["doc_id", "chapter_idx", "sentence_idx"], "left").withColumns({
        "chapter_pos_sec": F.coalesce("chapter_sec", F.lit(0.0)) + F.col("position_sec"),
        "book_pos_sec": F.coalesce("book_sec", F.lit(0.0)) + F.col("position_sec"),
    }).drop("chapter_sec", "book_sec")


def neighbour_targets(sentences: DataFrame) -> DataFrame:
    """Where the four step buttons lead from every sentence; null where there is nothing to go to."""
    begins = sentences.groupBy("doc_id", "chapter_idx").agg(F.min("global_idx").alias("chapter_start"))
    shifted = lambda by, name: begins.select("doc_id", (F.col("chapter_idx") - by).alias("chapter_idx"),
                                             F.col("chapter_start").alias(name))
    chapters = begins.join(shifted(-1, "before"), ["doc_id", "chapter_idx"], "left").join(
        shifted(1, "after"), ["doc_id", "chapter_idx"], "left"
    )
    ends = sentences.groupBy("doc_id").agg(F.max("global_idx").alias("last_idx"))
    chapters = chapters.join(ends, "doc_id")
    rows = sentences.select("doc_id", "chapter_idx", "sentence_idx", "global_idx").withColumn(
        "block", block_of("global_idx", ROWS_PER_BLOCK)
    )
    g = F.col("global_idx")
    return hand_out(rows, chapters, ["doc_id", "chapter_idx"], "block").select(
        "doc_id", "chapter_idx", "sentence_idx", "global_idx",
        F.greatest(F.lit(0), g - 1).alias("prev_sentence"),
        F.when(g < F.col("last_idx"), g + 1).alias("next_sentence"),
        F.when(g > F.col("chapter_start"), F.col("chapter_start")).otherwise(F.col("before")).alias("prev_chapter"),
        F.col("after").alias("next_chapter"),
    )


def char_spans(sentences: DataFrame) -> DataFrame:
    """``(doc_id, global_idx, len, start_char, end_char)`` in the running text of the book."""
    rows = sentences.select("doc_id", "global_idx", F.length("text").cast("bigint").alias("len")).withColumn(
        "block", block_of("global_idx", ROWS_PER_BLOCK)
    )
    out = running(materialize(rows, "lengths"), ["doc_id"], "block", ["global_idx"], {"end_char": ("sum", F.col("len"))})
    return out.withColumn("start_char", F.col("end_char") - F.col("len")).drop("block")


def skip_seconds(sentences: DataFrame, requests: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Move ``requests(doc_id, global_idx, char_index, rate, delta)`` by ``delta`` seconds.

    The target is a place in the running text of the book. It is looked up by slot: a sentence is listed
    in the few slots it touches, so each request meets only the sentences of its own slot.
    """
    spans = char_spans(sentences) if spans is None else spans
    ends = spans.groupBy("doc_id").agg(
        F.max("end_char").alias("total"), F.max("global_idx").alias("last_idx"), F.max_by("len", "global_idx").alias("last_len")
    )
    moved = F.col("char_index") + round_half_up(F.col("delta") * float(fixed.CHARS_PER_SEC) * F.col("rate"))
    # The book's end goes to its blocks of sentences first, so requests meet a sentence and never a whole book.
    here = hand_out(
        spans.select("doc_id", "global_idx", "len", "start_char", block_of("global_idx", ROWS_PER_BLOCK).alias("_block")),
        ends, ["doc_id"], "_block",
    ).drop("_block")
    asked = requests.join(here, ["doc_id", "global_idx"]).withColumn("pos", moved).withColumns({
        "target": F.col("start_char") + F.col("pos"),
        "way": F.when(F.col("pos") < 0, -1).when(F.col("pos") > F.col("len"), 1).otherwise(0),
    })
    slot = lambda c: F.floor(c / CHARS_PER_SLOT).cast("bigint")
    # Sentences without text are not listed: they cannot be landed on.
    listed = spans.where("len > 0").select(
        "doc_id", F.col("global_idx").alias("to_idx"), F.col("start_char").alias("to_start"),
        F.col("end_char").alias("to_end"),
        F.explode(F.sequence(slot(F.col("start_char")), slot(F.col("end_char")))).alias("slot"),
    )
    asked = asked.withColumn("slot", F.when(F.col("way") != 0, slot(F.col("target"))))
    inside = (
        ((F.col("way") == 1) & (F.col("target") > F.col("to_start")) & (F.col("target") <= F.col("to_end")))
        | ((F.col("way") == -1) & (F.col("target") >= F.col("to_start")) & (F.col("target") < F.col("to_end")))
    )
    a, l = asked.alias("a"), listed.alias("l")
    found = a.join(l, (F.col("a.doc_id") == F.col("l.doc_id")) & (F.col("a.slot") == F.col("l.slot")) & inside, "left")
    idx = (
        F.when(F.col("way") == 0, F.col("a.global_idx"))
        .when(F.col("target") < 0, F.lit(0))
        .when(F.col("target") > F.col("total"), F.col("last_idx"))
        .otherwise(F.col("to_idx"))
    )
    pos = (
        F.when(F.col("way") == 0, F.col("pos"))
        .when(F.col("target") < 0, F.lit(0))
        .when(F.col("target") > F.col("total"), F.col("last_len"))
        .otherwise(F.col("target") - F.col("to_start"))
    )
    return found.select(
        *[F.col(f"a.{c}") for c in requests.columns], idx.cast("bigint").alias("to_global_idx"),
        pos.cast("bigint").alias("to_char_index"),
    )


def resolve_resume(books: DataFrame, sentences: DataFrame, progress: DataFrame, first_content: DataFrame, rate: float = 1.0) -> DataFrame:
    """Sentence and character at which each book opens. ``sentences`` and ``first_content`` carry
    ``book_id``; ``progress`` has one row per book."""
    seen = progress.select("book_id", "chapter_id", "sentence_idx", "offset_sec", "char_index", F.lit(True).alias("read"))
    at = sentences.select("book_id", "chapter_id", "sentence_idx", F.col("global_idx").alias("stored_idx"))
    start = (
        books.select("book_id").join(seen, "book_id", "left")
        .join(at, ["book_id", "chapter_id", "sentence_idx"], "left")
        .join(first_content.select("book_id", F.col("global_idx").alias("content_idx")), "book_id", "left")
        .withColumn("global_idx", F.coalesce(F.when(F.col("read"), F.col("stored_idx")).otherwise(F.col("content_idx")), F.lit(0)))
    )
    text = sentences.select("book_id", "global_idx", "text")
    return start.join(text, ["book_id", "global_idx"], "left").select(
        "book_id", "global_idx",
        F.when(F.col("char_index") > 0, clamp("char_index", 0, F.length("text")))
        .when(F.col("offset_sec") != 0, seek_char("offset_sec", rate, "text"))
        .otherwise(F.lit(0)).cast("bigint").alias("char_index"),
    )


def seek_target(sentences: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(doc_id, chapter_idx, sentence_idx, word_idx)`` to sentence and character; taps outside
    the book are dropped."""
    at = sentences.select("doc_id", "chapter_idx", "sentence_idx", "global_idx", "text")
    place = F.when(F.col("word_idx") > 0, char_index_of_word("text", "word_idx")).otherwise(F.lit(0))
    return requests.join(at, ["doc_id", "chapter_idx", "sentence_idx"]).withColumn(
        "char_index", clamp(place, 0, F.length("text"))
    ).drop("text")


def advance_sequence(sentences: DataFrame, requests: DataFrame) -> DataFrame:
    """What is spoken next from ``requests(doc_id, global_idx, from_char)``: the rest of the sentence,
    or the next one when nothing is left; null at the end of the book."""
    text = sentences.select("doc_id", "global_idx", "text")
    nxt = sentences.select("doc_id", (F.col("global_idx") - 1).alias("global_idx"), F.lit(True).alias("more"))
    rest = F.substring(F.col("text"), (F.col("from_char") + 1).cast("int"), F.length("text"))
    left = F.trim(rest) != ""
    return requests.join(text, ["doc_id", "global_idx"]).join(nxt, ["doc_id", "global_idx"], "left").select(
        *[F.col(c) for c in requests.columns],
        F.when(left, F.col("global_idx")).when(F.col("more"), F.col("global_idx") + 1).alias("speak_idx"),
        F.when(left, F.col("from_char")).when(F.col("more"), F.lit(0)).cast("bigint").alias("speak_from"),
    )
