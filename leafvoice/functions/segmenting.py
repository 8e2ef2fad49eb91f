"""Sentence generators as array-valued native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.text import MARK, WIDE_MARK, WS, clean_for_speech, col, ends_with_abbreviation, js_trim



def _class(ranges: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


# Unicode sentence boundaries (rules SB5 to SB11) of cleaned text, whose only white space is the plain blank, in all scripts.
_TERM, _STOP, _GOES_ON = _class(fixed.SENTENCE_ENDS), _class(fixed.FULL_STOPS), _class(fixed.SENTENCE_CONTINUES)
# SB5: marks and format characters belong to what stands before them.
_MARKS = r"\p{M}\p{Cf}"
_FEW = f"[{_MARKS}]{{0,8}}"
_CLOSERS = r"\"'\p{Ps}\p{Pe}\p{Pi}\p{Pf}❛-❠\x{1F676}-\x{1F678}"
_CASED, _CAPITAL = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]", r"[\p{IsUppercase}\p{Lt}]"
# SB9, SB10: closing marks and blanks stay with the sentence.
_TAIL = f"[{_CLOSERS}{_MARKS}]*+[ {_MARKS}]*+"
_BOUNDARY = (
    # Ordinary letters fail at the first test; a run of end marks is looked at once.
    rf"((?=[!.?\x{{80}}-\x{{10FFFF}}])(?<![!.?])[{_TERM}{_STOP}][{_TERM}{_STOP}{_MARKS}]*+(?:(?<=[{_TERM}]{_FEW}){_TAIL}"
    # SB6: no end before a digit; SB7: nor between a letter's full stop and a capital; SB8: nor if small letters go on.
    rf"|(?<=[{_STOP}]{_FEW})(?!\p{{Nd}})(?!(?<={_CASED}{_FEW}[{_STOP}]{_FEW}){_CAPITAL}){_TAIL}"
    rf"(?![{_MARKS}[^\p{{IsAlphabetic}}{_TERM}{_STOP}]]*+\p{{IsLowercase}}))"
    # SB8a: nor before a mark that goes on, or another end mark.
    rf"(?![{_TERM}{_STOP}{_GOES_ON}]))"
)
_SIMPLE_BOUNDARY = f"([.!?]\\.*)(?={WS}*[A-Z\"'(\\[])"


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, MARK), js_trim), lambda s: s != "")


def segment_sentences(c) -> Column:
    """Sentences of cleaned text by the Unicode rules, before abbreviations are merged."""
    return _pieces(F.regexp_replace(col(c), _BOUNDARY, f"$1{MARK}"))


def merge_abbreviations(sentences) -> Column:
    """Append a piece to the one before it when that one ends in an abbreviation."""
    glued = F.array_join(
        F.transform(col(sentences), lambda s: F.concat(s, F.when(ends_with_abbreviation(s), " ").otherwise(MARK))),
        "",
    )
    return _pieces(glued)


def split_sentences_simple(c) -> Column:
    """Punctuation followed by a capital, quote or bracket ends a sentence unless it is an abbreviation.

    The word before a candidate may run on over candidates that were turned down (``Dr.A.``), but not over
    a blank. So the text is first cut at candidates before a blank; the few others are folded inside their
    stretch, and all the rest is linear.
    """
    marked = F.regexp_replace(col(c), _SIMPLE_BOUNDARY, f"$1{MARK}")
    stretches = F.split(F.regexp_replace(marked, f"{MARK}(?={WS})", WIDE_MARK), WIDE_MARK)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, piece: Column) -> Column:
        whole = F.concat(acc["buf"], piece)
        return F.when(
            ends_with_abbreviation(whole), F.struct(acc["out"].alias("out"), whole.alias("buf"))
        ).otherwise(F.struct(F.concat(acc["out"], whole, F.lit(MARK)).alias("out"), F.lit("").alias("buf")))

    def settle(stretch: Column) -> Column:
        pieces = F.split(stretch, MARK)
        inner = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)
        return F.when(F.size(pieces) == 1, stretch).otherwise(
            F.concat(inner["out"], inner["buf"], F.element_at(pieces, -1))
        )

    def close(stretch: Column) -> Column:
        last = F.substring_index(stretch, MARK, -1)
        return F.concat(stretch, F.when(ends_with_abbreviation(last), "").otherwise(MARK))

    return _pieces(F.array_join(F.transform(F.transform(stretches, settle), close), ""))


def _cap_pattern(n: int) -> str:
    body = f".{{0,{n - 1}}}"
    return (
        f"(?s){WS}*+(.{{1,{n}}}\\z|{body}[.!?](?={WS}|\\z)|{body}[;:—](?={WS}|\\z)"
        f"|{body},(?={WS})|{body}{WS}(?=[^{WS[1:-1]}])|.{{{n}}})"
    )


def enforce_max_length(sentences, max_chars: int = fixed.MAX_SENTENCE_CHARS) -> Column:
    """Cut longer pieces at the rightmost sentence, clause, comma or word boundary, else hard."""

    def cut(s: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(js_trim(s), F.lit(_cap_pattern(max_chars)), F.lit(1)), js_trim)
        return F.when(F.length(s) <= max_chars, F.array(s)).otherwise(F.filter(parts, lambda p: p != ""))

    return F.flatten(F.transform(col(sentences), cut))


def split_cleaned(c, splitter: str = "unicode", max_chars: int = fixed.MAX_SENTENCE_CHARS) -> Column:
    """Sentences of already cleaned text; ``splitter`` is ``unicode`` or ``simple``."""
    if splitter == "unicode":
        parts = merge_abbreviations(segment_sentences(c))
    elif splitter == "simple":
        parts = split_sentences_simple(c)
    else:
        raise ValueError(f"unknown splitter: {splitter}")
    return enforce_max_length(parts, max_chars)


def split_sentences(c, splitter: str = "unicode", max_chars: int = fixed.MAX_SENTENCE_CHARS) -> Column:
    return split_cleaned(clean_for_speech(c), splitter, max_chars)
