"""Reports on what the pipeline made of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from leafvoice.functions import fixed
from leafvoice.functions.text import js_trim
from leafvoice.operators.sections import features, weighted_median_size
from leafvoice.plans.blocks import ROWS_PER_BLOCK, block_of, hand_out, materialize, running, with_halo
from leafvoice.plans.pages import by_page, whole

CHECKS = ["lowercase_start", "broken_hyphen", "orphan_capital", "tiny", "over_cap", "double_blank"]


def _with_next(sentences: DataFrame) -> DataFrame:
    """Sentences with the following one of the document as ``next1``."""
    near = Window.partitionBy("doc_id", "_block").orderBy("global_idx")
    out = with_halo(sentences.select("doc_id", "global_idx", "text"), "global_idx", 1)
    return out.withColumn("next1", F.lead("text").over(near)).where("_own")


def check_columns() -> dict[str, Column]:
    """How often each check hits in one sentence. A broken word may straddle two sentences."""
    t = js_trim("text")
    straddles = F.col("text").rlike("[A-Za-z0-9_]-\\z") & F.coalesce(F.col("next1").rlike("^[A-Za-z0-9_]"), F.lit(False))
    return {
        "lowercase_start": t.rlike("^[a-z]").cast("int"),
        "broken_hyphen": F.regexp_count("text", F.lit("\\b[A-Za-z0-9_]+- [A-Za-z0-9_]+\\b")) + straddles.cast("int"),
        "orphan_capital": (t.rlike("^[A-Z]\\s") & (F.length(t) < 60)).cast("int"),
        "tiny": (F.length(t) <= 3).cast("int"),
        "over_cap": (F.length("text") > 400).cast("int"),
        "double_blank": F.regexp_count("text", F.lit(" {2,}")),
    }


def checked_sentences(sentences: DataFrame) -> DataFrame:
    return _with_next(sentences).select("doc_id", "global_idx", "text", *[c.alias(n) for n, c in check_columns().items()])


def sentence_audit(sentences: DataFrame) -> DataFrame:
    """Hits per document and check, counted in full."""
    return checked_sentences(sentences).groupBy("doc_id").agg(
        F.count("*").alias("sentences"), *[F.sum(c).cast("bigint").alias(c) for c in CHECKS]
    )


def _by_check(checked: DataFrame, snippet: int = 60) -> DataFrame:
    """One row per sentence and check that hits, with the sentence's beginning."""
    pairs = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("bigint").alias("n")) for c in CHECKS])
    return checked.select("doc_id", "global_idx", F.substring("text", 1, snippet).alias("example"), F.inline(pairs)).where("n > 0")


def audit_examples(sentences: DataFrame, k: int = 4, snippet: int = 60) -> DataFrame:
    """The first ``k`` hits of every check. Each task keeps at most ``k`` per check before the exchange."""
    return _first_hits(_by_check(checked_sentences(sentences), snippet), k)


def _first_hits(hits: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("check_name").orderBy("doc_id", "global_idx")
    return (
        hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        .select("check_name", "rank", "doc_id", "global_idx", "example")
    )


def corpus_audit(sentences: DataFrame, k: int = 4) -> DataFrame:
    """``(check_name, n, examples)`` over the whole corpus, checks without hits included."""
    spark = sentences.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(CHECKS)], "ord int, check_name string")
    found = materialize(_by_check(checked_sentences(sentences)), "hits")
    hits = found.groupBy("check_name").agg(F.sum("n").alias("n"))
    shown = _first_hits(found, k).groupBy("check_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]).alias("examples")
    )
    return names.join(hits, "check_name", "left").join(shown, "check_name", "left").select(
        "check_name", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


def _spans(sentences: DataFrame, longest: DataFrame, chars: int) -> DataFrame:
    """``(doc_id, part, span)``: the running text of the documents in ``longest(doc_id, longest)``, sentences joined by a
    blank, in parts of about ``chars``. Each part goes on for ``longest`` characters into what follows, so
    whatever is no longer than that and begins in it lies in it."""
    rows = hand_out(
        sentences.select("doc_id", "global_idx", "text", block_of("global_idx", ROWS_PER_BLOCK).alias("block")), longest, ["doc_id"], "block"
    )
    size = F.length("text") + 1
    placed = running(rows, ["doc_id"], "block", ["global_idx"], {"through": ("sum", size)}).withColumn("at", F.col("through") - size)
    # A part is at least as wide as the longest string: the text after a part reaches into two parts at most.
    placed = placed.withColumn("part", F.floor(F.col("at") / F.greatest("longest", F.lit(chars))))
    along = Window.partitionBy("doc_id").orderBy("part")
    begins = placed.groupBy("doc_id", "part").agg(F.min("at").alias("first")).select(
        "doc_id", "part", "first", F.lag("first").over(along).alias("first1"),
        F.lag("part").over(along).alias("part1"), F.lag("part", 2).over(along).alias("part2"),
    )
    near = lambda first, part: F.when(F.col("at") < F.col(first) + F.col("longest"), F.col(part))
    copies = F.array_compact(F.array("part", near("first", "part1"), near("first1", "part2")))
    # A copy needs no more than the longest string's length of a sentence.
    return (
        placed.join(begins, ["doc_id", "part"])
        .select("doc_id", "global_idx", "text", "longest", F.col("part").alias("own"), F.explode(copies).alias("part"))
        .withColumn("text", F.when(F.col("part") == F.col("own"), F.col("text")).otherwise(F.left("text", F.col("longest").cast("int"))))
        .groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("global_idx", "text"))).alias("s"))
        .select("doc_id", "part", F.array_join(F.transform("s", lambda s: s["text"]), " ").alias("span"))
    )


def integrity_checks(sentences: DataFrame, expectations: DataFrame, chars: int = 65536) -> DataFrame:
    """Per case whether every wanted string occurs in the document's running text and no unwanted one does.

    ``expectations`` is (case_id, doc_id, must_contain, must_not_contain). A string may run over any number of
    sentence ends; a document is looked through in parts of about ``chars``. Null strings ask for nothing.
    """
    needles = lambda c, wanted: expectations.select("case_id", "doc_id", F.explode(c).alias("needle"), F.lit(wanted).alias("wanted")).where("needle is not null")
    asked = needles("must_contain", True).unionByName(needles("must_not_contain", False)).distinct()
    # A part is looked through for all strings of its document at once; only hits become rows.
    lists = asked.groupBy("doc_id").agg(F.collect_set("needle").alias("needles"), F.max(F.length("needle")).alias("longest"))
    spans = _spans(sentences, lists.select("doc_id", "longest"), chars)
    hits = (
        hand_out(spans, lists.select("doc_id", "needles"), ["doc_id"], "part")
        .select("doc_id", F.explode(F.filter("needles", lambda n: F.contains(F.col("span"), n))).alias("needle"))
        .distinct().withColumn("found", F.lit(True))
    )
    ok = F.coalesce("found", F.lit(False)) == F.col("wanted")
    return asked.join(hits, ["doc_id", "needle"], "left").groupBy("case_id").agg(
        F.bool_and(ok).alias("passed"), F.count_if(~ok).alias("failures")
    )


def punctuation_checks(sentences: DataFrame) -> DataFrame:
    """Doubled full stops and blanks before a full stop, per document."""
    t = F.col("text")
    return sentences.groupBy("doc_id").agg(
        F.bool_or(F.contains(t, F.lit(".."))).alias("doubled_period"),
        F.bool_or(F.contains(t, F.lit(" ."))).alias("blank_before_period"),
    )


def _near_hits(needle: str, before: int, after: int, first: int):
    """Of whole pages the runs around each page's first hits; a document's first hits are among them."""

    def work(rows: pa.Table, page_no: np.ndarray) -> tuple[np.ndarray, dict]:
        n, found = len(page_no), pc.match_substring(whole(rows["text"]), needle)
        hits = np.flatnonzero(pc.fill_null(found, False).to_numpy(zero_copy_only=False))
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), page_no[1:] != page_no[:-1]]))
        end, page = np.append(begin[1:], n), np.searchsorted(begin, hits, "right") - 1
        nth = np.arange(len(hits)) - np.searchsorted(hits, begin[page])
        hits, page = hits[nth < first], page[nth < first]
        low, high = np.maximum(hits - before, begin[page]), np.minimum(hits + after + 1, end[page])
        size = np.maximum(0, high - low)
        hit = np.repeat(hits, size)
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pos = lambda i: pa.array(i - np.repeat(begin[page], size), pa.int32())
        near = rows.take(pa.array(at))
        return page_no[at], {"hit_pos": pos(hit), "pos": pos(at)} | {c: near[c] for c in ("text", "x", "y", "width")}

    return work


def runs_in_context(runs: DataFrame, needle: str, before: int = 3, after: int = 3, first: int = 3) -> DataFrame:
    """The first runs of each document that contain ``needle``, with their neighbours on the page."""
    shown = ["text", "x", "y", "width"]
    pages = runs.where("doc_id is not null and page is not null").select("doc_id", "page", "run_idx", *shown)
    out = [StructField("hit_pos", IntegerType()), StructField("pos", IntegerType()), *(runs.schema[c] for c in shown)]
    near = by_page(pages, ["doc_id", "page"], ["run_idx"], _near_hits(needle, before, after, first), out)
    order = Window.partitionBy("doc_id").orderBy("page", "hit_pos")
    return near.withColumn("match", F.dense_rank().over(order)).where(F.col("match") <= first).select(
        "doc_id", "match", "page", "pos", (F.col("pos") == F.col("hit_pos")).alias("is_match"), *shown
    )


def detection_mode_summary(chapters: DataFrame, sentences: DataFrame) -> DataFrame:
    """Documents, chapters and sentences per detection mode."""
    n = sentences.groupBy("doc_id", "chapter_idx").agg(F.count("*").alias("n"))
    per_doc = chapters.join(n, ["doc_id", "chapter_idx"], "left").groupBy("doc_id", "detection_mode").agg(
        F.count("*").alias("chapters"), F.sum(F.coalesce("n", F.lit(0))).alias("sentences")
    )
    return per_doc.groupBy("detection_mode").agg(
        F.count("*").alias("documents"), F.sum("chapters").alias("chapters"), F.sum("sentences").alias("sentences")
    )


def font_size_profile(paragraphs: DataFrame) -> DataFrame:
    """Per document and size: paragraphs, characters' weight, the median, the heading threshold and
    whether the size reaches it."""
    rows = features(paragraphs)
    sizes = rows.where("font_size > 0").groupBy("doc_id", "font_size").agg(
        F.count("*").alias("paragraphs"), F.sum("weight").alias("weight")
    )
    median = weighted_median_size(rows).select("doc_id", "median_size")
    threshold = F.col("median_size") * fixed.HEADING_SCALE
    return sizes.join(median, "doc_id").withColumns({
        "threshold": threshold, "is_heading_size": F.col("font_size") >= threshold,
    })
