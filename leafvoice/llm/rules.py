"""Quality rules as a learned decision list, in DataFrame operations only.

Sequential covering: a rule for low quality grows one threshold condition at a time by information gain on two thirds of
the labelled documents, is pruned on the rest, and what it covers is set aside before the next rule grows. The list is
emitted as one ordered conditional expression. Only counts by (feature, threshold) come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.tables import BLANKS, Steps, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Learning: thresholds per feature, conditions per rule, rules, least precision on the pruning set.
THRESHOLDS = 48
MOST_CONDITIONS = 4
MOST_RULES = 12
LEAST_PRECISION = 0.9
LEAST_COVER = 5

#: name -> value; 0 where there is nothing to measure.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word_chars": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "words": ("n_words", None),
}


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice, the first time included.

    Windows are sorted with their places; equal neighbours repeat. Each of their places covers three words, the next
    one's start cuts that short."""
    n = F.size(words) - 2
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    twice = _bind(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = _bind(places, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n >= 2, covered).otherwise(F.lit(0))


def measures(text: str = "text") -> dict[str, Column]:
    """Counts of one text, all of it; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    by_words = _bind(words, lambda w: F.struct(
        F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), repeat_words(w).alias("n_repeat_words")))
    by_lines = _bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return {
        "_w": by_words, "_l": by_lines, "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_upper": count(r"\p{Lu}"), "n_digits": count("[0-9]"), "n_marks": count(r"[!?]"),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks"]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of each text, under names that can't clash with them."""
    m = measures("_text")
    wide = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("_text")).select("_row", *[v.alias(k) for k, v in m.items()])
    return wide.select("_row", *[
        (F.col(f"_w.{c}") if c in ("n_words", "n_distinct", "n_repeat_words") else F.col(f"_l.{c}") if c in ("n_lines", "n_dup_lines") else F.col(c))
        .cast("long").alias(c) for c in COUNTS])


def features() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {k: (ratio(a, b) if b else F.col(a).cast("double")) for k, (a, b) in RATIOS.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    wrong: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, null if none does: the list as one conditional expression."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].column(), F.lit(i)).otherwise(out)
    return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn_rules(labelled: DataFrame, steps: Steps) -> list[Rule]:
    """Rules for low quality from ``labelled``: counts, ``bad`` (boolean) and ``grow`` (boolean, the set used for growing).

    Thresholds are quantiles of each feature. Empty input or input of one label only gives an empty list; ties go to the
    first feature and the lowest threshold, so reruns agree. The driver gets features x thresholds counts per step."""
    steps_at = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    rows = steps.keep(labelled.select(*COUNTS, "bad", "grow"), "labelled")
    named = features()
    cuts_row = rows.where("grow").groupBy().agg(*[
        F.percentile_approx(F.when(F.col("bad") == b, v), F.array(*map(F.lit, steps_at)), 1000).alias(f"{k}_{int(b)}") for k, v in named.items() for b in (True, False)]).first()
    cuts = {k: sorted({x for b in (0, 1) for x in (cuts_row[f"{k}_{b}"] or [])}) for k in named}
    cuts = {k: v for k, v in cuts.items() if v}
    if not cuts:
        return []
    below = lambda value, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda t: t < value))
    bins = [below(named[k], v).alias(f"b_{k}") for k, v in cuts.items()]
    binned = steps.keep(rows.select("*", *bins), "binned")
    names = list(cuts)
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{k}").alias("b")) for i, k in enumerate(names)])).alias("at")

    def counts(df: DataFrame) -> dict:
        got = df.select(stack, "bad", "grow").groupBy("at.f", "at.b", "bad", "grow").count().collect()
        return {(r["f"], r["b"], r["bad"], r["grow"]): r["count"] for r in got}

    def total(c: dict, bad: bool, grow: bool, f: int = 0) -> int:
        return sum(v for (g, _, x, y), v in c.items() if (g, x, y) == (f, bad, grow))

    def sides(c: dict, grow: bool):
        """Each possible condition with what it keeps."""
        for f, k in enumerate(names):
            every = [total(c, b, grow, f) for b in (True, False)]
            below = [0, 0]
            for i, t in enumerate(cuts[k]):
                # Bin i holds the values in (cut i-1, cut i].
                below = [below[j] + c.get((f, i, b, grow), 0) for j, b in enumerate((True, False))]
                yield Condition(k, False, t), *below
                yield Condition(k, True, t), every[0] - below[0], every[1] - below[1]

    rules: list[Rule] = []
    rest = binned
    while len(rules) < MOST_RULES:
        grown, inside, kept = [], rest, []
        c = counts(inside)
        p, n = total(c, True, True), total(c, False, True)
        while p and n and len(grown) < MOST_CONDITIONS:
            cond, p1, n1 = max(sides(c, True), key=lambda x: _gain(p, n, x[1], x[2]))
            if p1 < LEAST_COVER or _gain(p, n, p1, n1) <= 0:
                break
            grown.append(cond)
            inside = inside.where(cond.column())
            c = counts(inside)
            p, n = total(c, True, True), total(c, False, True)
            kept.append((total(c, True, False), total(c, False, False)))
        if not grown:
            break
        # Pruning drops the last conditions as long as the pruning set says so.
        best = max(range(len(grown)), key=lambda i: ((kept[i][0] - kept[i][1]) / max(1, sum(kept[i])), kept[i][0], -i))
        p, n = kept[best]
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(Rule(tuple(grown[: best + 1]), p + n, n))
        rest = rest.where(~rules[-1].column())
    return rules


def _labelled(rows: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    marks = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad")).distinct()
    return rows.join(marks, F.col(doc_id) == F.col("_id")).withColumn("grow", F.crc32(F.col("_id").cast("string")) % 3 != 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (number of the rule that rejects, null if none) and ``kept`` of each
    row of ``docs`` (doc_id, text). Null and empty texts have 0 words and fail; a null doc_id is judged, but not learnt
    from; documents labelled both ways count for both."""
    steps = Steps(docs.sparkSession, "rules")
    rows = steps.keep(measured(docs.select("doc_id", "text"), ["doc_id"]).select("_row.doc_id", *COUNTS), "counts")
    rules = learn_rules(_labelled(rows, labels, "doc_id"), steps)
    out = rows.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, in all their columns. Texts are measured once and stored with their counts; the
    counts alone meet the labels, and each row is judged where it is stored."""
    steps = Steps(docs.sparkSession, "rules")
    rows = steps.keep(measured(docs, docs.columns), "measured")
    rules = learn_rules(_labelled(rows.select("_row.doc_id", *COUNTS), labels, "doc_id"), steps)
    return rows.where(~base_failed() & decision(rules).isNull()).select("_row.*")


def op5_decision_rules(spark, sf_dir):
    """All documents judged by the base rules and the learned list."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
