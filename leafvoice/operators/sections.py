"""From paragraphs to chapters: outline, else headings, else a split by words.

All decisions are taken on narrow rows (indexes, sizes, flags) in blocks of pages; the text is joined
once, when it is known which paragraph goes where. A chapter is handed on in passages: a chapter that
spans blocks is cut where a sentence certainly ends, so no chapter has to fit in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.spans import NONE, STATES, UNSURE, span_step
from leafvoice.functions.text import (
    clean_for_speech, ends_terminal, ends_with_abbreviation, heading_title, is_named_heading, js_trim, let,
    next_continues, title_or_untitled, word_count,
)
from leafvoice.plans.anchored import anchored_marks
from leafvoice.plans.automaton import states_before
from leafvoice.plans.blocks import (
    PAGES_PER_BLOCK, ROWS_PER_BLOCK, block_of, busy_partitions, hand_out, long_documents, materialize, row_index, running,
)

BLOCK = ["doc_id", "block"]
#: So many characters without marks lie further apart than any span of limited length reaches.
FAR_CHARS = 1000


@dataclass
class Sections:
    """``members``: (doc_id, para_idx, detection_mode, chapter_key, passage), headings left out.
    ``chapters``: (doc_id, chapter_idx, chapter_key, chapter_id, title, start_page, detection_mode)."""

    members: DataFrame
    chapters: DataFrame


def features(paragraphs: DataFrame) -> DataFrame:
    """The narrow row each paragraph is judged by."""
    text, trimmed = F.col("text"), js_trim("text")
    has = lambda s: F.contains(text, F.lit(s))
    return paragraphs.select(
        "doc_id", block_of("page", PAGES_PER_BLOCK).alias("block"), "page", "para_idx", "font_size",
        F.greatest(F.lit(1), F.floor(F.length("text") / 20 + 0.5)).cast("bigint").alias("weight"),
        word_count("text", trim=False).cast("bigint").alias("words"),
        ((F.length("text") < fixed.HEADING_MAX_CHARS) & (word_count("text") <= fixed.HEADING_MAX_WORDS)
         & text.rlike("[A-Za-z]")).alias("short"),
        is_named_heading("text").alias("named"),
        heading_title("text").alias("title"),
        # A chapter whose first character is ordinary cannot be cleaned away as a whole.
        trimmed.rlike("^[^`\\\\$\\-\\u00ad" + fixed.BOX_DRAWING[1:-2] + "]").alias("plain"),
        # Spans that cleaning may remove across paragraphs: unbounded ones, and ones of known length.
        (has("```") | has("\\(") | has("\\begin{")).alias("opens"),
        (has("$") | has("\\[")).alias("math"),
        span_step(text).alias("span_step"),
        let(trimmed, lambda t: t.rlike("[a-z]{2}[.!?]\\z") & ~ends_with_abbreviation(t)).alias("ends"),
        F.length("text").alias("chars"),
        trimmed.rlike("^[A-Z][a-z]").alias("begins"),
    )


def weighted_median_size(rows: DataFrame) -> DataFrame:
    """Upper median of the font size, each paragraph counted once per 20 characters. ``rows`` has
    ``font_size`` and ``weight``, as from :func:`features`."""
    sizes = rows.where("font_size > 0").groupBy("doc_id", "font_size").agg(F.sum("weight").alias("w"))
    doc = Window.partitionBy("doc_id")
    return (
        sizes.withColumns({"cum": F.sum("w").over(doc.orderBy("font_size")), "total": F.sum("w").over(doc)})
        .groupBy("doc_id")
        .agg(
            F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("font_size"))).alias("median_size"),
            F.max("total").alias("weight_total"),
        )
    )


def pick_headings(rows: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Accept a candidate that is at least two paragraphs after the last accepted one: within a run of
    candidates that is every other one. Adds ``accepted`` from ``candidate``."""
    last_other = ("max", F.when(~F.col("candidate"), F.col("para_idx")))
    out = running(rows, ["doc_id"], "block", ["para_idx"], {"_other": last_other}, long)
    place = F.col("para_idx") - F.coalesce("_other", F.lit(-1)) - 1
    return out.withColumn("accepted", F.col("candidate") & (place % 2 == 0)).drop("_other")


def heading_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidate``: large and short, or worded like a heading; none in a document too small."""
    per_block = rows.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    doc = per_block.groupBy("doc_id").agg(F.sum("n").alias("paragraphs")).join(weighted_median_size(rows), "doc_id", "left")
    facts = per_block.select(*BLOCK).join(doc, "doc_id", "left")
    enough = (F.col("paragraphs") >= 4) & (F.coalesce("weight_total", F.lit(0)) >= 4)
    big = F.col("font_size") >= F.col("median_size") * fixed.HEADING_SCALE
    return (
        rows.join(facts, BLOCK, "left")
        .withColumn("candidate", F.coalesce(enough & ((big & F.col("short")) | F.col("named")), F.lit(False)))
        .drop("paragraphs", "median_size", "weight_total")
    )


def outline_entries(outline: DataFrame, min_entries: int = fixed.MIN_SECTIONS) -> DataFrame:
    """One entry per page (of several on a page only the last has text) of outlines long enough."""
    enough = outline.groupBy("doc_id").count().where(F.col("count") >= min_entries).select("doc_id")
    return (
        outline.groupBy("doc_id", "page").agg(F.max_by("title", "entry_idx").alias("entry_title"))
        .join(enough, "doc_id", "left_semi")
    )


def mark_sections(paragraphs: DataFrame, outline: DataFrame | None = None, long: DataFrame | None = None) -> DataFrame:
    """Features plus, per paragraph, the heading and the outline page it falls under."""
    rows = features(paragraphs).repartition(*BLOCK)
    rows = pick_headings(heading_candidates(rows), long).withColumn("kind", F.lit(1))
    prev = Window.partitionBy(*BLOCK).orderBy("para_idx")
    # Characters that stay between here and the last paragraph with a mark; repairs may take a third of them.
    marks = F.sum((F.col("math") | F.col("span_step").isNotNull()).cast("int")).over(prev.rowsBetween(Window.unboundedPreceding, 0))
    since = Window.partitionBy(*BLOCK, "_marks").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    stays = F.when(~F.col("math") & F.col("span_step").isNull(), F.col("chars")).otherwise(0)
    rows = rows.withColumn("_marks", marks).withColumns({
        "clean_before": F.lag("ends").over(prev) & F.col("begins"), "_since": F.coalesce(F.sum(stays).over(since), F.lit(0)),
    })
    # A paragraph with a mark begins a count of its own; what counts for it is the one before.
    rows = rows.withColumn("far_before", F.when(F.col("math") | F.col("span_step").isNotNull(), F.lag(F.col("_since") + stays).over(prev))
                           .otherwise(F.col("_since")) >= FAR_CHARS).drop("_marks", "_since")
    order = ["page", "kind", "para_idx"]
    if outline is None:
        rows = rows.withColumn("entry", F.lit(None).cast("int"))
    else:
        entries = outline_entries(outline).select(
            "doc_id", block_of("page", PAGES_PER_BLOCK).alias("block"), "page",
            F.lit(0).alias("kind"), F.col("page").alias("entry"),
        )
        rows = rows.unionByName(entries, allowMissingColumns=True)
    at = lambda flag, what="para_idx": ("max", F.when(F.col(flag), F.col(what)))
    rows = running(rows, ["doc_id"], "block", order, {
        "heading_at": at("accepted"), "entry_page": ("max", F.col("entry")),
        "last_open": at("opens"), "last_math": at("math"),
        "open_page": at("opens", "page"), "math_page": at("math", "page"),
    }, long)
    # Pending is what the rows before opened; at the first row of a block the row itself counts too.
    held = Window.partitionBy(*BLOCK).orderBy(*order)
    before = lambda c: F.when(F.row_number().over(held) == 1, F.col(c)).otherwise(F.lag(c).over(held))
    rows = rows.withColumns({c: before(c) for c in ("last_open", "last_math", "open_page", "math_page")})
    return rows.where("kind = 1").select(
        "doc_id", "block", "page", "para_idx", "words", "title", "plain", "accepted", "heading_at", "entry_page",
        "clean_before", "far_before", "last_open", "last_math", "open_page", "math_page", "span_step",
    )


def _nothing_pending(tier: Column | str) -> Column:
    """No removable span that was opened earlier in the chapter can reach this paragraph."""
    tier = F.lit(tier) if isinstance(tier, str) else tier
    earlier = lambda para, page: F.coalesce(
        F.when(tier == "heading", F.col(para) <= F.col("heading_at")).otherwise(F.col(page) < F.col("entry_page")),
        F.col(para).isNull(),
    )
    return earlier("last_open", "open_page") & (
        earlier("last_math", "math_page") | F.coalesce("far_before", F.lit(False))
    )


def _survives(marked: DataFrame, paragraphs: DataFrame, key: str, bodies: Column) -> DataFrame:
    """``(doc_id, key)`` of the chapters that still have text once cleaned. Nearly all are known from a
    paragraph whose first character must survive; only the others are read."""
    survives = F.col("plain") & _nothing_pending("heading" if key == "heading_at" else "outline")
    chapters = marked.where(bodies).groupBy("doc_id", key).agg(F.bool_or(survives).alias("plain"))
    doubtful = chapters.where(~F.col("plain"))
    sure = chapters.where("plain").select("doc_id", key)
    if doubtful.limit(1).isEmpty():
        return sure
    # Written, so that it is known whether they are few.
    members = materialize(marked.where(bodies).join(doubtful.select("doc_id", key), ["doc_id", key], "left_semi").select(
        "doc_id", "para_idx", F.col(key).alias("chapter_key"), F.lit(0).alias("passage")
    ), "doubtful", few=True)
    kept = (
        chapter_passages(paragraphs, members)
        .where(clean_for_speech("text", repair=False) != "")
        .select("doc_id", F.col("chapter_key").alias(key))
    )
    return sure.unionByName(kept)


def _parts(rows: DataFrame, max_words: int, long: DataFrame) -> DataFrame:
    """Part number per paragraph: whole paragraphs until ``max_words`` are reached, then a new part."""
    counted = running(rows, ["doc_id"], "block", ["para_idx"], {"cum_words": ("sum", F.col("words"))}, long)
    return anchored_marks(
        counted, ["doc_id"], "block", "para_idx", F.col("cum_words"), max_words, start=0, long=long
    )


def _no_math_near() -> Column:
    """No paragraph with a dollar sign or an open display formula is close before this one in the document."""
    return F.col("last_math").isNull() | F.coalesce("far_before", F.lit(False))


def passage_cuts(rows: DataFrame) -> DataFrame:
    """``doc_id, block, cut, carried``: in every block after a document's first, the first place where a sentence certainly
    ends and no span is open is where a passage begins; ``carried`` is the last such place before the block. ``rows`` are
    members with what :func:`mark_sections` says of them; parts by word count are short and aren't cut."""
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    longs = sizes.groupBy("doc_id").agg(F.min("block").alias("first"), F.count("*").alias("blocks")).where("blocks > 1")
    body = hand_out(rows.where("detection_mode != 'wordSplit'"), longs.select("doc_id", "first"), ["doc_id"], "block")
    chapter = ["doc_id", "chapter_key"]
    # A formula that opens where display mathematics may still be open is one that can't be told.
    opens = F.element_at("span_step", 1) != NONE
    unsure = F.transform("span_step", lambda s: F.when(s % 4 == NONE, s).otherwise(s - s % 4 + UNSURE))
    body = body.withColumn("span_step", F.when(opens & ~_no_math_near(), unsure).otherwise(F.col("span_step")))
    states = states_before(body, chapter, "block", "para_idx", "span_step", STATES)
    stepped = body.join(states, [*chapter, "block", "para_idx"], "left")
    # Between paragraphs with marks the state is the one after the last of them.
    after = F.when(F.col("state").isNotNull(), F.struct("para_idx", F.element_at("span_step", F.col("state") + 1).alias("state")))
    stepped = running(stepped, chapter, "block", ["para_idx"], {"last_state": ("max", after)})
    state = F.coalesce("state", "last_state.state", F.lit(NONE))
    safe = F.coalesce("clean_before", F.lit(False)) & (state == NONE) & _no_math_near()
    cuts = stepped.where(safe & (F.col("block") > F.col("first"))).groupBy(*BLOCK).agg(F.min("para_idx").alias("cut"))
    ahead = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(longs, "doc_id", "left_semi").select(*BLOCK).join(cuts, BLOCK, "left")
    return places.withColumn("carried", F.max("cut").over(ahead)).where("cut is not null or carried is not null")


def _passages(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``passage``, the paragraph that begins it, or -1."""
    own = F.when(F.col("para_idx") >= F.col("cut"), F.col("cut"))
    return rows.join(cuts, BLOCK, "left").withColumn("passage", F.coalesce(own, "carried", F.lit(-1)).cast("bigint")).drop("cut", "carried")


def _bodies(tier: str) -> Column:
    if tier == "heading":
        return F.col("heading_at").isNotNull() & (F.col("heading_at") != F.col("para_idx"))
    return F.col("entry_page").isNotNull()


def choose_sections(
    paragraphs: DataFrame, outline: DataFrame | None = None, max_words: int = fixed.PART_WORDS,
    min_sections: int = fixed.MIN_SECTIONS,
) -> Sections:
    """The outline if it gives enough chapters with text, else the headings, else parts by word count."""
    long = long_documents(paragraphs, "page", PAGES_PER_BLOCK)
    marked = materialize(mark_sections(paragraphs, outline, long), "sections")
    docs = marked.groupBy(*BLOCK).agg(F.count_if("accepted").alias("headings"))
    per_doc = docs.groupBy("doc_id").agg(F.sum("headings").alias("headings"))

    def count_chapters(key: str, tier: str, name: str) -> tuple[DataFrame, DataFrame]:
        alive = _survives(marked, paragraphs, key, _bodies(tier))
        return alive, alive.groupBy("doc_id").agg(F.count("*").alias(name))

    by_heading, n_heading = count_chapters("heading_at", "heading", "by_heading")
    modes = per_doc.join(n_heading, "doc_id", "left")
    if outline is not None:
        by_entry, n_entry = count_chapters("entry_page", "outline", "by_entry")
        modes = modes.join(n_entry, "doc_id", "left")
    else:
        by_entry = None
        modes = modes.withColumn("by_entry", F.lit(0))
    modes = modes.select(
        "doc_id",
        F.when(F.col("by_entry") >= min_sections, "outline")
        .when((F.col("headings") >= min_sections) & (F.col("by_heading") >= min_sections), "heading")
        .otherwise("wordSplit").alias("detection_mode"),
    )
    block_modes = docs.select(*BLOCK).join(modes, "doc_id")
    rows = marked.repartition(*BLOCK).join(block_modes, BLOCK)
    worded = rows.where("detection_mode = 'wordSplit'")
    parts = _parts(worded, max_words, long).select(*BLOCK, "para_idx", F.col("marks_before").alias("part"))
    rows = rows.join(parts, [*BLOCK, "para_idx"], "left").withColumn(
        "chapter_key",
        F.when(F.col("detection_mode") == "outline", F.when(_bodies("outline"), F.col("entry_page")))
        .when(F.col("detection_mode") == "heading", F.when(_bodies("heading"), F.col("heading_at")))
        .otherwise(F.col("part")).cast("bigint"),
    )
    alive = by_heading.select("doc_id", F.lit("heading").alias("detection_mode"), F.col("heading_at").alias("chapter_key"))
    if by_entry is not None:
        alive = alive.unionByName(by_entry.select(
            "doc_id", F.lit("outline").alias("detection_mode"), F.col("entry_page").cast("bigint").alias("chapter_key")
        ))
    return _assemble(rows.where("chapter_key is not null"), marked, outline, alive)


def _assemble(
    rows: DataFrame, marked: DataFrame, outline: DataFrame | None, alive: DataFrame | None
) -> Sections:
    """Passages and numbered chapters from body paragraphs with their ``chapter_key``."""
    placed = materialize(rows.select(
        *BLOCK, "para_idx", "page", "detection_mode", "chapter_key", "clean_before", "far_before", "last_math", "span_step"), "placed")
    # A row per paragraph, which only looks small to the planner where there are no cuts.
    members = _passages(placed, materialize(passage_cuts(placed), "cuts", few=True)).select(
        "doc_id", "para_idx", "page", "detection_mode", "chapter_key", "passage").hint("merge")
    found = members.groupBy("doc_id", "detection_mode", "chapter_key").agg(F.min("page").alias("first_page"))
    kept = found.where("detection_mode = 'wordSplit'")
    if alive is not None:
        kept = kept.unionByName(
            found.where("detection_mode != 'wordSplit'")
            .join(alive, ["doc_id", "detection_mode", "chapter_key"], "left_semi")
        )
    heads = marked.where("accepted").select(
        "doc_id", F.lit("heading").alias("detection_mode"), F.col("para_idx").alias("chapter_key"), "title",
        F.col("page").alias("at_page"),
    )
    if outline is not None:
        heads = heads.unionByName(outline_entries(outline).select(
            "doc_id", F.lit("outline").alias("detection_mode"), F.col("page").cast("bigint").alias("chapter_key"),
            F.col("entry_title").alias("title"), F.col("page").alias("at_page"),
        ))
    titled = kept.join(heads, ["doc_id", "detection_mode", "chapter_key"], "left").withColumns({
        "title": F.when(F.col("detection_mode") == "wordSplit", F.concat(F.lit("Part "), F.col("chapter_key") + 1))
        .otherwise(title_or_untitled("title")),
        "start_page": F.coalesce("at_page", "first_page"),
        "block": block_of("chapter_key", ROWS_PER_BLOCK),
    })
    return Sections(members, materialize(renumber_chapters(titled), "chapters"))


def renumber_chapters(chapters: DataFrame) -> DataFrame:
    """Dense ``chapter_idx`` from 0 and ``ch_1``… in the order of ``chapter_key``."""
    if "block" not in chapters.columns:
        chapters = chapters.withColumn("block", block_of("chapter_key", ROWS_PER_BLOCK))
    return row_index(chapters, ["doc_id"], "block", ["chapter_key"], "chapter_idx").select(
        "doc_id", "chapter_idx", "chapter_key", F.concat(F.lit("ch_"), F.col("chapter_idx") + 1).alias("chapter_id"),
        "title", "start_page", "detection_mode",
    )


def _one_tier(paragraphs: DataFrame, outline: DataFrame | None, tier: str) -> Sections:
    long = long_documents(paragraphs, "page", PAGES_PER_BLOCK)
    marked = materialize(mark_sections(paragraphs, outline, long), "sections")
    key = "heading_at" if tier == "heading" else "entry_page"
    rows = marked
    if tier == "heading":
        enough = marked.groupBy("doc_id").agg(F.count_if("accepted").alias("n")).where(F.col("n") >= fixed.MIN_SECTIONS)
        rows = marked.join(enough, "doc_id", "left_semi")
    rows = rows.where(_bodies(tier)).withColumns({
        "detection_mode": F.lit(tier), "chapter_key": F.col(key).cast("bigint"),
    })
    alive = _survives(marked, paragraphs, key, _bodies(tier)).select(
        "doc_id", F.lit(tier).alias("detection_mode"), F.col(key).cast("bigint").alias("chapter_key")
    )
    return _assemble(rows, marked, outline, alive)


def sections_from_headings(paragraphs: DataFrame) -> Sections:
    return _one_tier(paragraphs, None, "heading")


def sections_from_outline(paragraphs: DataFrame, outline: DataFrame) -> Sections:
    return _one_tier(paragraphs, outline, "outline")


def sections_by_word_count(paragraphs: DataFrame, max_words: int = fixed.PART_WORDS) -> Sections:
    long = long_documents(paragraphs, "page", PAGES_PER_BLOCK)
    marked = materialize(mark_sections(paragraphs, None, long), "sections")
    parts = _parts(marked, max_words, long).select(*BLOCK, "para_idx", F.col("marks_before").alias("chapter_key"))
    rows = marked.join(parts, [*BLOCK, "para_idx"]).withColumn("detection_mode", F.lit("wordSplit"))
    return _assemble(rows, marked, None, None)


def join_blocks(blocks: Column) -> Column:
    """Join the ordered blocks ``(text, ends, continues)``: a full stop is added where one is missing,
    unless the next block goes on in lowercase."""
    def piece(b: Column, i: Column) -> Column:
        nxt = F.get(blocks, i + 1)
        sep = F.when(nxt.isNull(), "").when(b["ends"] | nxt["continues"], " ").otherwise(". ")
        return F.concat(b["text"], sep)

    return F.array_join(F.transform(blocks, piece), "")


def chapter_passages(paragraphs: DataFrame, members: DataFrame) -> DataFrame:
    """``(doc_id, chapter_key, passage, text)``; ``members`` says which paragraph goes where."""
    block = F.struct(
        "para_idx", "text", ends_terminal("text").alias("ends"), next_continues("text").alias("continues")
    )
    placed = paragraphs.select("doc_id", "para_idx", "text").join(
        members.select("doc_id", "para_idx", "chapter_key", "passage"), ["doc_id", "para_idx"]
    )
    return (
        busy_partitions(placed, "doc_id", "chapter_key", "passage")
        .withColumn("text", js_trim("text")).where("text != ''")
        .groupBy("doc_id", "chapter_key", "passage")
        .agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        .select("doc_id", "chapter_key", "passage", join_blocks(F.col("blocks")).alias("text"))
    )
