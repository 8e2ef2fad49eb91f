"""Numeric scalar functions: estimated times, positions, progress, run geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.text import col


def _num(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else col(x)


def clamp(x, lo, hi) -> Column:
    return F.greatest(_num(lo), F.least(_num(hi), _num(x)))


def clamp_rate(rate) -> Column:
    return clamp(rate, 0.1, 10.0)


def round_half_up(x) -> Column:
    return F.floor(_num(x) + 0.5).cast("bigint")


def est_sentence_seconds(text) -> Column:
    return F.greatest(F.lit(fixed.MIN_SENTENCE_SEC), F.length(col(text)) / F.lit(float(fixed.CHARS_PER_SEC)))


def position_seconds(char_index, rate) -> Column:
    per_sec = _num(rate) * float(fixed.CHARS_PER_SEC)
    return F.when(per_sec > 0, _num(char_index) / per_sec).otherwise(F.lit(0.0))


def duration_seconds(text, rate) -> Column:
    return position_seconds(F.length(col(text)), rate)


def seek_char(sec, rate, text) -> Column:
    """Character reached after ``sec`` seconds of the sentence, kept inside it."""
    return clamp(round_half_up(_num(sec) * float(fixed.CHARS_PER_SEC) * _num(rate)), 0, F.length(col(text)))


def progress_pct(chapter_idx, chapters) -> Column:
    n = _num(chapters)
    return F.when(n > 0, clamp(_num(chapter_idx) / n * 100, 0.0, 100.0)).otherwise(F.lit(0.0))


def run_end(x, width, text, size) -> Column:
    """Right edge of a run; a missing or zero width is estimated from the glyph count."""
    estimate = F.length(col(text)) * col(size) * fixed.GLYPH_EM
    return col(x) + F.coalesce(F.nullif(col(width), F.lit(0.0)), estimate)


def size_bucket(size) -> Column:
    return F.floor(col(size) * 2 + 0.5) / 2
