"""From positioned text runs to paragraphs.

A page is the unit that is ordered as a whole: it is bounded by paper. Everything that looks beyond a
page (drop caps, running headers, dense numbering) works on blocks of pages, see ``plans.blocks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from leafvoice.functions import fixed
from leafvoice.functions.measures import size_bucket
from leafvoice.functions.text import BLANK_CHARS, is_continuation, is_drop_cap, is_page_number, js_trim
from leafvoice.plans.blocks import PAGES_PER_BLOCK, block_of, materialize, row_index, with_halo
from leafvoice.plans.folds import scan
from leafvoice.plans.pages import by_page, numbers, whole

PAGE = ["doc_id", "block", "page"]


def _line_numbers(tolerance: float):
    """Line of every run of whole pages. A line end, or a step of more than twice the tolerance, certainly opens a line. Between
    two of these nearly always lies one line; only where heights drift is the stretch folded run by run: a run belongs to
    the open line while its height is within the tolerance of that line's first run."""

    def work(rows: pa.Table, page_no: np.ndarray) -> tuple[np.ndarray, dict]:
        text, y = whole(rows["text"]), pc.fill_null(whole(rows["y"]).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        ends = pc.fill_null(pc.equal(text, "\n"), True).to_numpy(zero_copy_only=False)
        opens = np.ones(len(y), bool)
        with np.errstate(invalid="ignore"):
            opens[1:] = (page_no[1:] != page_no[:-1]) | ends[:-1] | ~(np.abs(y[1:] - y[:-1]) <= 2 * tolerance)
        at = np.flatnonzero(~ends)
        part, y, page_no = np.cumsum(opens)[at], y[at], page_no[at]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), part[1:] != part[:-1]]))
        length = np.diff(np.append(begin, len(at)))
        sub = np.zeros(len(at), np.int64)
        with np.errstate(invalid="ignore"):
            drifts = np.abs(y - np.repeat(y[begin], length)) > tolerance
        for k in np.unique(np.searchsorted(begin, np.flatnonzero(drifts), "right") - 1):
            a, b = begin[k], begin[k] + length[k]
            line, anchor, subs = 0, y[a], []
            for height in y[a:b].tolist():
                if not abs(anchor - height) <= tolerance:
                    line, anchor = line + 1, height
                subs.append(line)
            sub[a:b] = subs
        lines = sub[begin + length - 1] + 1
        before = np.cumsum(lines) - lines
        # Numbers begin anew with each page.
        first = np.concatenate([np.ones(min(1, len(begin)), bool), page_no[begin][1:] != page_no[begin][:-1]])
        before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(begin))))
        kept = rows.take(pa.array(at))
        return page_no, {"line": pa.array(np.repeat(before, length) + sub, pa.int32())} | {c: kept[c] for c in kept.column_names}

    return work


RUN = ["run_idx", "text", "font_size", "x", "y", "width"]


def group_lines(runs: DataFrame, tolerance: float = fixed.LINE_TOLERANCE) -> DataFrame:
    """Runs with a ``line`` number per page; line ends are dropped."""
    if "block" not in runs.columns:
        runs = runs.withColumn("block", block_of("page", PAGES_PER_BLOCK))
    out = [StructField("line", IntegerType()), *(runs.schema[c] for c in RUN)]
    return by_page(runs.select(*PAGE, *RUN), PAGE, ["run_idx"], _line_numbers(tolerance), out)


def _joined(rows: pa.Table, page_no: np.ndarray) -> tuple[np.ndarray, dict]:
    """One row per line of whole pages, whose runs are in order."""
    n = len(page_no)
    text, line = whole(rows["text"]), numbers(rows["line"])
    opens = np.ones(n, bool)
    opens[1:] = (page_no[1:] != page_no[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(opens)
    line_no = np.cumsum(opens) - 1
    # A blank is restored where a gap is wide and neither side has one; like all comparisons here, a null says no.
    floats = lambda c: pc.fill_null(whole(rows[c]).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    known = lambda c: pc.is_valid(whole(rows[c])).to_numpy(zero_copy_only=False)
    blank = lambda c: pc.fill_null(pc.is_in(c, pa.array(list(BLANK_CHARS))), True).to_numpy(zero_copy_only=False)
    none = lambda c: pc.is_null(c).to_numpy(zero_copy_only=False)
    wide = np.zeros(n, bool)
    x, size, width, length = floats("x"), floats("font_size"), floats("width"), pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
    # As in ``run_end``.
    end, end_known = x + np.where(width != 0, width, length * size * fixed.GLYPH_EM), known("x") & ((width != 0) | (known("font_size") & ~none(text)))
    gap, least = x[1:] - end[:-1], size[1:] * fixed.SPACE_EM
    wide[1:] = (gap > least) | (np.isnan(gap) & ~np.isnan(least))
    wide[1:] &= (known("x") & known("font_size"))[1:] & end_known[:-1] & ~opens[1:]
    wide[1:] &= ~(blank(pc.utf8_slice_codeunits(text, -1)) | none(text))[:-1] & ~(blank(pc.utf8_slice_codeunits(text, 0, 1)) | none(text))[1:]
    plain = pc.fill_null(text, "")
    pieces = whole(pc.binary_join_element_wise(pc.if_else(pa.array(wide), " ", ""), plain, ""))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, n), pa.int32()), pieces), "")
    # The bucket of most characters; the first seen wins a tie.
    buckets = whole(rows["bucket"]).dictionary_encode(null_encoding="encode")
    code = buckets.indices.to_numpy(zero_copy_only=False)
    chars = np.maximum(1, pc.fill_null(pc.utf8_length(pc.utf8_trim(text, characters=BLANK_CHARS)), 1).to_numpy(zero_copy_only=False))
    by_bucket = np.lexsort((code, line_no))
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), (np.diff(line_no[by_bucket]) != 0) | (np.diff(code[by_bucket]) != 0)]))
    weight = np.add.reduceat(chars[by_bucket], starts) if n else chars
    first = by_bucket[starts]
    best = np.lexsort((first, -weight, line_no[first]))
    best = first[best[np.concatenate([np.ones(min(1, n), bool), np.diff(line_no[first][best]) != 0])]]
    return page_no[begin], {
        "line": rows["line"].take(pa.array(begin)), "y": rows["y"].take(pa.array(begin)), "text": joined,
        "font_size": rows["bucket"].take(pa.array(best)),
    }


def join_runs(lined: DataFrame) -> DataFrame:
    """One row per line: its text with dropped blanks restored, its height and its dominant size."""
    told = lined.select(*PAGE, "line", *RUN, size_bucket("font_size").alias("bucket"))
    out = [*(told.schema[c] for c in ("line", "y", "text")), StructField("font_size", told.schema["bucket"].dataType)]
    return by_page(told, PAGE, ["line", "run_idx"], _joined, out)


def dominant_font_size(lined: DataFrame) -> DataFrame:
    """Size bucket that covers the most characters of each line; the first seen wins a tie."""
    return (
        lined.withColumn("bucket", size_bucket("font_size"))
        .groupBy(*PAGE, "line", "bucket")
        .agg(F.sum(F.greatest(F.lit(1), F.length(js_trim("text")))).alias("chars"), F.min("run_idx").alias("first"))
        .groupBy(*PAGE, "line")
        .agg(F.max_by("bucket", F.struct("chars", (-F.col("first")).alias("f"))).alias("font_size"))
    )


def _join_wrapped(lines: Column) -> Column:
    """Fold the lines of one block. A hyphen at a line end goes, unless a capital or a conjunction follows."""
    followers = F.array(*[F.lit(w) for w in fixed.HYPHEN_FOLLOWERS])

    def step(acc: Column, nxt: Column) -> Column:
        word = F.lower(F.regexp_extract(nxt, "^([A-Za-z]+)", 1))
        broken = F.substring(acc, -2, 2).rlike("^[A-Za-z]-\\z") & ~F.array_contains(followers, word)
        return (
            F.when(acc.isNull(), nxt)
            .when(broken & nxt.rlike("^[A-Z]"), F.concat(acc, nxt))
            .when(broken, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), nxt))
            .otherwise(F.concat_ws(" ", acc, nxt))
        )

    return F.aggregate(lines, F.lit(None).cast("string"), step)


def _block_of_line(lines: Column, gap: float, share: float) -> Column:
    """Paragraph number of every line of a page, -1 for a blank line."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(-1).alias("para"), none.alias("y"), none.alias("size"))

    def step(state: Column, ln: Column) -> Column:
        height = F.when(ln["font_size"] * fixed.LINE_HEIGHT_EM == 0, F.lit(fixed.DEFAULT_LINE_HEIGHT)).otherwise(
            ln["font_size"] * fixed.LINE_HEIGHT_EM
        )
        far = F.coalesce(F.abs(state["y"] - ln["y"]) > height * gap, F.lit(False))
        resized = (state["size"] > 0) & (
            F.abs(ln["font_size"] - state["size"]) > F.greatest(F.lit(fixed.SIZE_CHANGE_MIN), state["size"] * share)
        )
        opens = state["size"].isNull() | far | resized
        para = F.when(~ln["blank"] & opens, state["para"] + 1).otherwise(state["para"])
        size = F.when(ln["blank"], none).when(opens, ln["font_size"]).otherwise(state["size"])
        after = F.struct(para.alias("para"), F.when(ln["blank"], none).otherwise(ln["y"]).alias("y"), size.alias("size"))
        return F.struct(after.alias("s"), F.when(ln["blank"], F.lit(-1)).otherwise(para).alias("o"))

    return scan(lines, start, step, "int")


def lines_to_paragraphs(
    lines: DataFrame, gap: float = fixed.PARAGRAPH_GAP, share: float = fixed.SIZE_CHANGE_SHARE
) -> DataFrame:
    """Paragraphs of each page: ``(doc_id, block, page, seq, text, font_size)``."""
    ln = F.struct(
        "line", F.col("y").cast("double").alias("y"), F.col("font_size").cast("double").alias("font_size"),
        js_trim("text").alias("text"),
    )
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(ln)).alias("lines"))
    shape = F.transform("lines", lambda l: F.struct(l["y"], l["font_size"], (l["text"] == "").alias("blank")))
    tagged = pages.withColumn("paras", _block_of_line(shape, gap, share))
    return (
        tagged.select(*PAGE, F.inline(F.arrays_zip("lines", "paras")))
        .where("paras >= 0")
        .groupBy(*PAGE, F.col("paras").alias("seq"))
        .agg(
            F.array_sort(F.collect_list(F.struct("lines.line", "lines.text"))).alias("parts"),
            F.min_by("lines.font_size", "lines.line").alias("font_size"),
        )
        .select(*PAGE, "seq", _join_wrapped(F.transform("parts", lambda p: p["text"])).alias("text"), "font_size")
    )


def merge_drop_caps(paras: DataFrame) -> DataFrame:
    """Give a lone capital back to the paragraph it opens.

    A paragraph that starts lowercase takes the nearest unused lone capital among the three before it.
    A capital can only be taken by the first lowercase paragraph that reaches it, so who takes which
    follows from the kinds of the three neighbours and needs no pass over the document. Only the flags
    travel; ``paras`` has a dense ``idx``.
    """
    text = js_trim("text")
    kinds = paras.select(
        *PAGE, "seq", "idx",
        F.when(is_drop_cap("text"), "cap").when(is_continuation("text"), "low").alias("kind"),
        F.when(is_drop_cap("text"), text).alias("letter"),
    ).where("kind is not null")
    near = Window.partitionBy("doc_id", "_block").orderBy("idx")

    def kind_at(by: int, shift) -> Column:
        """Kind of the paragraph ``by`` places away; rows of other kinds are absent here."""
        found = F.lit(None).cast("string")
        for k in (1, 2, 3):
            there = shift("idx", k).over(near)
            found = F.when(F.abs(there - F.col("idx")) == by, shift("kind", k).over(near)).otherwise(found)
        return found

    def letter_at(by: int) -> Column:
        found = F.lit(None).cast("string")
        for k in (1, 2, 3):
            there = F.lag("idx", k).over(near)
            found = F.when(F.col("idx") - there == by, F.lag("letter", k).over(near)).otherwise(found)
        return found

    n = with_halo(kinds, "idx", 6)
    for by in (1, 2, 3):
        n = n.withColumn(f"b{by}", F.coalesce(kind_at(by, F.lag), F.lit("other")))
        n = n.withColumn(f"l{by}", letter_at(by))
    b1, b2, b3 = F.col("b1"), F.col("b2"), F.col("b3")
    # The third neighbour is free when both capitals' nearer takers are ruled out.
    third = (b3 == "cap") & (((b1 == "low") & (b2 == "cap")) | ((b1 == "other") & (b2 == "other")))
    takes = F.when(F.col("kind") == "low", F.when(b1 == "cap", 1).when((b2 == "cap") & (b1 == "other"), 2).when(third, 3))
    n = n.withColumn("takes", takes)
    taken = F.lit(False)
    for k in (1, 2, 3):
        taken = taken | F.coalesce(
            F.lead("takes", k).over(near) == F.lead("idx", k).over(near) - F.col("idx"), F.lit(False)
        )
    effect = (
        n.withColumn("gone", (F.col("kind") == "cap") & taken)
        .where("_own and (gone or takes is not null)")
        .select(
            *PAGE, "idx",
            F.when(F.col("takes") == 1, F.col("l1")).when(F.col("takes") == 2, F.col("l2"))
            .when(F.col("takes") == 3, F.col("l3")).otherwise("").alias("cap"),
        )
        .groupBy(*PAGE)
        .agg(F.map_from_entries(F.collect_list(F.struct("idx", "cap"))).alias("caps"))
        .groupBy("doc_id", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("page", "caps"))).alias("pages"))
    )
    # The text keeps its partitioning by block; a row looks up its page, then its place on it.
    return (
        paras.join(effect, ["doc_id", "block"], "left")
        .withColumn("cap", F.col("pages")[F.col("page")][F.col("idx")])
        .where("cap is null or cap != ''")
        .withColumn("text", F.when(F.col("cap").isNotNull(), F.concat("cap", text)).otherwise(F.col("text")))
        .drop("pages", "cap")
    )


def drop_chrome(paras: DataFrame, share: float = fixed.CHROME_SHARE, max_chars: int = fixed.CHROME_MAX_CHARS) -> DataFrame:
    """Remove running headers and footers, then page numbers.

    Counts are summed per block first, so a header on every page of a huge document is a few rows. The
    texts found are few per document (each fills at least ``share`` of its pages); they are handed out
    per block of pages.
    """
    pages = paras.select("doc_id", "block", "page").distinct()
    per_block = pages.groupBy("doc_id", "block").count()
    doc_pages = per_block.groupBy("doc_id").agg(F.sum("count").alias("pages"))
    counts = (
        paras.where(F.length("text") <= max_chars)
        .groupBy("doc_id", "block", "text").count()
        .groupBy("doc_id", "text").agg(F.sum("count").alias("n"))
        .where("n >= 2")
    )
    chrome = (
        counts.join(doc_pages.where(F.col("pages") >= fixed.CHROME_MIN_PAGES), "doc_id")
        .where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share)))
        .groupBy("doc_id").agg(F.collect_list("text").alias("chrome"))
    )
    per_block_chrome = per_block.select("doc_id", "block").join(chrome, "doc_id")
    return (
        paras.join(per_block_chrome, ["doc_id", "block"], "left")
        .where(F.col("chrome").isNull() | ~F.array_contains("chrome", F.col("text")))
        .where(~is_page_number("text"))
        .drop("chrome")
    )


def raw_paragraphs(runs: DataFrame, tolerance: float = fixed.LINE_TOLERANCE, gap: float = fixed.PARAGRAPH_GAP) -> DataFrame:
    """Paragraphs as laid out, before drop caps and running headers."""
    return lines_to_paragraphs(join_runs(group_lines(runs, tolerance)), gap)


def to_paragraphs(runs: DataFrame, tolerance: float = fixed.LINE_TOLERANCE, gap: float = fixed.PARAGRAPH_GAP) -> DataFrame:
    """``(doc_id, para_idx, page, text, font_size)`` with dense ``para_idx`` per document."""
    raw = materialize(raw_paragraphs(runs, tolerance, gap), "layout")
    return refine_paragraphs(raw)


def refine_paragraphs(raw: DataFrame) -> DataFrame:
    raw = raw.repartition("doc_id", "block")
    order = ["page", "seq"]
    numbered = row_index(raw, ["doc_id"], "block", order, "idx")
    # Counting headers reads the merged paragraphs several times, a few columns each.
    kept = drop_chrome(materialize(merge_drop_caps(numbered), "merged").repartition("doc_id", "block"))
    return row_index(kept, ["doc_id"], "block", order, "para_idx").select(
        "doc_id", "para_idx", "page", "text", "font_size"
    )
