"""Spans that cleaning removes and that may run over paragraphs, as a state machine over paragraphs.

A code fence ends at the next fence mark, whatever stands between; what is left is searched for formulas. So a state says
whether a fence is open, and which formula is: none, ``\\begin{…}``, ``\\(``, or one that can't be told from what has been
read, which stays so to the end of the chapter. States are numbered ``fence * 4 + formula``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.text import col, let

STATES = 8
NONE, BEGIN, PAREN, UNSURE = range(4)

_LINE_END = "\\n\\r\\u0085\\u2028\\u2029"
#: What can open a formula at a paragraph's end, as far as the paragraph says: it must still be able to close.
_OPENERS = [
    r"\\begin\{(?:[^}]+\}|[^}]*\z)", rf"\\\((?=[^{_LINE_END}]*\z)", r"\\\[(?=[^\]]{0,500}\z)",
]
_FIRST_OPENER = "(?s)^.*?(" + "|".join(_OPENERS) + ")"
#: Also a command broken by a hyphen, which the repair may put together.
_ANY_MARK = "```|\\\\begin|\\\\end|\\\\[()]|\\\\[A-Za-z]*[-\u2010\u2011\u00ad](?: |$)"


def has_span_marks(c) -> Column:
    return col(c).rlike(_ANY_MARK)


def _after_none(text: Column) -> Column:
    """Formula state after ``text`` (no fences in it) if none is open before."""
    def judge(rest: Column) -> Column:
        first = F.regexp_extract(rest, _FIRST_OPENER, 1)
        crossing = rest.rlike(rf"(?s){_OPENERS[2]}.*(?:\\begin\{{|\\\()")
        return (
            F.when(first == "", NONE).when(first == "\\(", PAREN)
            .when(first == "\\[", F.when(crossing, UNSURE).otherwise(NONE))
            .otherwise(F.when(F.endswith(first, F.lit("}")), BEGIN).otherwise(UNSURE))
        )

    return let(F.regexp_replace(text, fixed.LATEX_BLOCK, " "), judge)


def _formula_steps(text: Column) -> list[Column]:
    """Formula state after ``text`` for each state before it."""
    closed = F.regexp_replace(text, r"(?s)^.*?\\end\{[^}]+\}", "")
    begin = (
        F.when(text.rlike(r"\\end\{[^}]+\}"), _after_none(closed)).when(text.rlike(r"\\end\{[^}]*\z"), UNSURE).otherwise(BEGIN)
    )
    paren = (
        F.when(text.rlike(rf"^[^{_LINE_END}]*?\\\)"), _after_none(F.regexp_replace(text, rf"^[^{_LINE_END}]*?\\\)", "")))
        .when(text.rlike(f"[{_LINE_END}]"), UNSURE).otherwise(PAREN)
    )
    return [_after_none(text), begin, paren, F.lit(UNSURE)]


def span_step(c) -> Column:
    """State after a paragraph for each state before it; null for a paragraph without any mark."""
    text = col(c)

    def from_fence(before: str) -> Column:
        def judge(rest: Column) -> Column:
            opens = F.contains(rest, F.lit("```"))
            outside = F.when(opens, F.substring_index(rest, "```", 1)).otherwise(rest)
            fence = F.when(opens, 4).otherwise(0)
            return let(outside, lambda t: F.transform(F.array(*_formula_steps(t)), lambda s: (s + fence).cast("int")))

        return let(F.regexp_replace(F.concat(F.lit(before), text), fixed.CODE_FENCE, " "), judge)

    # A command that the repair puts together isn't read here.
    broken = text.rlike("\\\\[A-Za-z]*[-\u2010\u2011\u00ad](?: |$)")
    lost = F.array(*[F.lit(UNSURE if s < 4 else 4 + UNSURE) for s in range(STATES)])
    return F.when(has_span_marks(text), F.when(broken, lost).otherwise(F.concat(from_fence(""), from_fence("```"))))
