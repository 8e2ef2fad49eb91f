"""The registered queries, each next to the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafvoice.functions import measures as M, segmenting as N, text as T
from leafvoice.oracle import SQL
from leafvoice.operators import catalog as C, layout as L, navigation as G, playback as P, quality as Q
from leafvoice.operators import sections as S, sentences as X
from leafvoice.plans.blocks import PAGES_PER_BLOCK, block_of, run_folder
from leafvoice.sources import adapters as A, library as B, readers as R
from leafvoice.streaming import queries as SQ, stateful as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark, sf) -> DataFrame:
    return A.documents_as_paragraphs(table(spark, sf, "documents"))


def spoken(spark, sf) -> DataFrame:
    return A.paragraphs_as_sentences(lines(spark, sf))


def books(spark, sf) -> DataFrame:
    return A.documents_as_books(table(spark, sf, "documents"), spoken(spark, sf))


def positions(spark, sf) -> DataFrame:
    return A.events_as_positions(table(spark, sf, "events"))


def raw_items(spark, sf) -> DataFrame:
    return A.paragraphs_as_raw_items(lines(spark, sf))


def word_runs(spark, sf) -> DataFrame:
    return R.normalize_raw_items(raw_items(spark, sf))


def page_lines(spark, sf) -> DataFrame:
    return A.pages_as_paragraphs(table(spark, sf, "pages"))


def r6(c) -> F.Column:
    return F.round(c, 6)


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp")).alias(c)


# --- sources and sinks -----------------------------------------------------------------------


@query
def read_runs(spark, sf):
    path = f"{run_folder(spark)}/runs-{uuid4().hex}"
    A.paragraphs_as_runs(lines(spark, sf)).write.parquet(path)
    return R.read_runs(spark, path).groupBy("doc_id", "page").agg(
        F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), r6(F.sum("width")).alias("width")
    )


@query
def normalize_raw_items(spark, sf):
    return word_runs(spark, sf).select("doc_id", "page", "run_idx", "text", "font_size", "x", r6(F.col("y")).alias("y"), "width")


@query
def resolve_title(spark, sf):
    return R.resolve_title(A.documents_as_docs(table(spark, sf, "documents"))).select("doc_id", "file_name", "title")


@query
def accept_files(spark, sf):
    files = table(spark, sf, "pages").select(
        "page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".Pdf").otherwise("")).alias("file_name")
    )
    ok, bad = R.accept_files(files)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query
def split_scanned(spark, sf):
    runs = A.paragraphs_as_runs(lines(spark, sf))
    ok, scanned = R.split_scanned(runs, A.documents_as_docs(table(spark, sf, "documents")))
    return ok.unionByName(scanned).select("doc_id", "page_count", r6(F.col("chars_per_page")).alias("chars_per_page"), "scanned")


@query
def flatten_outline(spark, sf):
    p = F.col("page_id")
    nodes = table(spark, sf, "pages").select(
        F.floor(p / 10).cast("string").alias("doc_id"), p.cast("string").alias("node_id"),
        F.when(p % 10 % 3 != 0, (p - p % 10 % 3).cast("string")).alias("parent_id"), (p % 10).cast("int").alias("ord"),
        F.concat(F.lit(" "), "url", F.lit(" ")).alias("title"), F.when(p % 7 != 3, (p % 10 + 1).cast("int")).alias("page"),
    )
    return R.flatten_outline(nodes)


@query
def flatten_deep_outline(spark, sf):
    """Contents of hundred pages each, nested up to forty levels deep: every page stands below the one before it."""
    p = F.col("page_id")
    nodes = table(spark, sf, "pages").select(
        F.floor(p / 100).cast("string").alias("doc_id"), p.cast("string").alias("node_id"),
        F.when(p % 100 % 40 != 0, (p - 1).cast("string")).alias("parent_id"), (p % 100).cast("int").alias("ord"),
        "url", F.when(p % 7 != 3, (p % 100 + 1).cast("int")).alias("page"),
    )
    return R.flatten_outline(nodes.withColumnRenamed("url", "title"))


@query
def write_library(spark, sf):
    """Build chapters and sentences, write them with their book rows, and read the library back."""
    path = f"{run_folder(spark)}/library-{uuid4().hex}"
    B.create_tables(spark, path)
    built = X.books_from_paragraphs(page_lines(spark, sf), splitter="simple")
    docs = built.chapters.select("doc_id").distinct().select(
        "doc_id", F.concat(F.lit("book "), "doc_id").alias("title"), F.concat("doc_id", F.lit(".pdf")).alias("file_name"),
        F.lit(A.PAGES_PER_BOOK).alias("page_count"),
    )
    B.write_library(spark, built, docs, path, "v1", batch="first")
    B.write_library(spark, built, docs, path, "v1", batch="first")  # a replay adds nothing
    stored = lambda name, key: B.read_store(spark, path, name).groupBy("book_id").agg(
        F.count("*").alias(f"{name}_stored"), F.sum(F.length(key)).alias(f"{name}_chars"))
    return (
        B.read_store(spark, path, "books").select("book_id", "doc_id", "title", "chapter_count", "sentence_count", "detection_mode", "voice")
        .join(stored("chapters", "title"), "book_id", "left").join(stored("sentences", "text"), "book_id", "left")
    )


@query
def book_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", B.book_id("doc_id").alias("book_id"))


@query
def list_books(spark, sf):
    return B.list_books(books(spark, sf)).select("book_id", "doc_id", "title", "chapter_count", "sentence_count", ms("added_at"))


def _keys(spark, sf) -> DataFrame:
    """Books that were bought."""
    ev = table(spark, sf, "events").where("event_type = 'purchase' and value > 100")
    return ev.select(B.book_id(F.get_json_object("props", "$.k")).alias("book_id")).distinct()


@query
def get_content(spark, sf):
    rows = spoken(spark, sf).withColumn("book_id", B.book_id("doc_id"))
    return B.get_content(rows, _keys(spark, sf)).select("book_id", "global_idx", "text")


@query
def get_book(spark, sf):
    return B.get_book(books(spark, sf), "bk_6b86b273ff3").select("book_id", "doc_id", "title", "sentence_count")


@query
def update_book_field(spark, sf):
    changes = _keys(spark, sf).select("book_id", F.concat(F.lit("voice-"), F.substring("book_id", 4, 2)).alias("voice"))
    return B.update_book_field(books(spark, sf), changes).select("book_id", "voice", "title")


@query
def delete_books(spark, sf):
    """What is left of a book's rows in each table after a delete."""
    pos = positions(spark, sf)
    left = B.delete_books({"books": books(spark, sf), "sentences": spoken(spark, sf).withColumn("book_id", B.book_id("doc_id")),
                           "progress": pos}, _keys(spark, sf))
    rows = [df.groupBy("book_id").count().select(F.lit(n).alias("store"), "book_id", F.col("count").alias("n")) for n, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _chunks(spark, sf) -> DataFrame:
    return positions(spark, sf).select(
        "book_id", "chapter_id", "sentence_idx", F.concat(F.lit("v"), F.col("event_id")).alias("voice"),
        F.col("offset_sec").alias("duration"), F.lit(None).cast("binary").alias("data"), F.col("updated_at").cast("timestamp").alias("added_at"),
        "event_id",
    )


@query
def chunk_key(spark, sf):
    return _chunks(spark, sf).select("event_id", B.chunk_key("book_id", "chapter_id", "sentence_idx").alias("chunk_key"))


@query
def get_chunk(spark, sf):
    return B.get_chunk(_chunks(spark, sf), "bk_6b86b273ff3", "ch_2", 1).select("event_id", "voice", "duration")


@query
def upsert_chunks(spark, sf):
    rows = _chunks(spark, sf)
    old, new = rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")
    return B.upsert_chunks(old, new).select("book_id", "chapter_id", "sentence_idx", "voice", "duration")


@query
def count_chunks_by_book(spark, sf):
    return B.count_chunks_by_book(books(spark, sf), _chunks(spark, sf))


@query
def clear_chunks(spark, sf):
    return B.clear_chunks(_chunks(spark, sf), _keys(spark, sf)).select("event_id", "book_id")


@query
def latest_progress(spark, sf):
    return B.latest_progress(positions(spark, sf)).select("book_id", "event_id", "chapter_id", "sentence_idx", "offset_sec", "char_index")


# --- predicates, text and number functions ---------------------------------------------------


@query
def line_predicates(spark, sf):
    return lines(spark, sf).select(
        "doc_id", "para_idx", T.is_page_number("text").alias("page_number"), T.is_named_heading("text").alias("named_heading"),
        T.is_drop_cap("text").alias("drop_cap"), T.is_continuation("text").alias("continuation"),
        T.ends_terminal("text").alias("ends_terminal"), T.next_continues("text").alias("continues"),
        T.is_content_start("text").alias("content_start"), T.is_front_matter("text").alias("front_matter"),
        T.ends_with_abbreviation("text").alias("abbreviation"),
    )


@query
def word_predicates(spark, sf):
    words = lines(spark, sf).select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_if(T.is_page_number("word")).alias("page_numbers"),
        F.count_if(T.ends_with_abbreviation("word")).alias("abbreviations"), F.count_if(T.is_drop_cap("word")).alias("capitals"),
    )


def _broken(text):
    """Break words the way a bad decoder does."""
    t = F.regexp_replace(text, "([a-z]{4})([a-z]{3})", "$1- $2")
    t = F.regexp_replace(t, " (the|les|der|el) ", " con dence rst ")
    return F.regexp_replace(t, " (and|et|und|y) ", " dif cult (scienti c) $1- or ")


@query
def repair_hyphenation(spark, sf):
    return lines(spark, sf).select("doc_id", "para_idx", T.repair_hyphenation(_broken(F.col("text"))).alias("text"))


@query
def repair_ligatures(spark, sf):
    return lines(spark, sf).select("doc_id", "para_idx", T.repair_ligatures(_broken(F.col("text"))).alias("text"))


@query
def repair_text(spark, sf):
    return lines(spark, sf).select("doc_id", "para_idx", T.repair_text(_broken(F.col("text"))).alias("text"))


@query
def clean_for_speech(spark, sf):
    return A.spread(table(spark, sf, "documents"), "doc_id").select("doc_id", T.clean_for_speech("text").alias("text"))


@query
def strip_markup(spark, sf):
    """Cleaning alone, on text with fences, formulas and rules set into it."""
    t = F.regexp_replace("text", "\\. ", ".``` x\ny``` \\\\(a\\\\) \\\\[b\\\\] ")
    t = F.regexp_replace(t, ", ", " \\$q\\$ ─━ -\n")
    return lines(spark, sf).select("doc_id", "para_idx", T.clean_for_speech(t, repair=False).alias("text"))


@query
def word_functions(spark, sf):
    at = F.col("para_idx") * 7 + F.length("text") % 90
    return lines(spark, sf).select(
        "doc_id", "para_idx", T.word_count("text").alias("words"), T.word_index_at_char("text", at).alias("word_at"),
        T.char_index_of_word("text", F.col("para_idx") % 12).alias("char_of"), F.size(T.split_keeping_gaps("text")).alias("pieces"),
    )


@query
def label_functions(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.title_hash_bucket("text").alias("hue"), T.title_initial("text").alias("initial"),
        T.fmt_time(F.col("n_chars") / 3.0).alias("time"), T.fmt_mins(F.col("n_chars") / 7.0).alias("mins"),
        T.chapter_index_from_id(F.concat(F.lit("ch_"), F.col("n_chars") % 40)).alias("chapter"),
        T.voice_label(F.concat(F.lit("Google "), "source", F.lit(" - "), "lang")).alias("voice"),
        T.title_or_untitled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))).alias("title"),
        T.is_english_voice("lang").alias("english"), T.heading_title("text").alias("heading"),
    )


@query
def measure_functions(spark, sf):
    rate = (F.col("para_idx") % 4) * 0.5
    x = F.col("para_idx")
    return lines(spark, sf).select(
        "doc_id", "para_idx", r6(M.est_sentence_seconds("text")).alias("est_sec"),
        r6(M.position_seconds(x, rate)).alias("position_sec"), r6(M.duration_seconds("text", rate)).alias("duration_sec"),
        M.seek_char(x / 4, rate, "text").cast("bigint").alias("seek_char"), r6(M.clamp_rate(x - 3.0)).alias("rate"),
        r6(M.progress_pct(x, x % 7)).alias("pct"), r6(M.size_bucket(x / 3)).alias("size"),
        r6(M.run_end(F.lit(72.0), F.when(x % 2 == 0, x * 1.0), "text", F.lit(11.0))).alias("run_end"),
    )


# --- layout ----------------------------------------------------------------------------------


@query
def group_lines(spark, sf):
    return L.group_lines(word_runs(spark, sf)).groupBy("doc_id", "page", "line").agg(
        F.min("run_idx").alias("first_run"), F.count("*").alias("runs")
    )


@query
def join_runs(spark, sf):
    return L.join_runs(L.group_lines(word_runs(spark, sf))).select("doc_id", "page", "line", r6(F.col("y")).alias("y"), "text", "font_size")


@query
def dominant_font_size(spark, sf):
    return L.dominant_font_size(L.group_lines(word_runs(spark, sf))).select("doc_id", "page", "line", "font_size")


@query
def lines_to_paragraphs(spark, sf):
    return L.raw_paragraphs(word_runs(spark, sf)).select("doc_id", "page", "seq", "text", "font_size")


@query
def merge_drop_caps(spark, sf):
    return L.merge_drop_caps(A.words_as_paragraphs(lines(spark, sf))).select("doc_id", "idx", "text")


def _web_lines(spark, sf) -> DataFrame:
    return page_lines(spark, sf).withColumns({"seq": F.col("para_idx").cast("int"), "block": block_of("page", PAGES_PER_BLOCK)})


@query
def drop_chrome(spark, sf):
    return L.drop_chrome(_web_lines(spark, sf)).select("doc_id", "para_idx", "page", "text")


@query
def to_paragraphs(spark, sf):
    return L.to_paragraphs(A.paragraphs_as_runs(page_lines(spark, sf)))


# --- sections --------------------------------------------------------------------------------


@query
def weighted_median_size(spark, sf):
    return S.weighted_median_size(S.features(page_lines(spark, sf))).select("doc_id", "median_size", "weight_total")


@query
def pick_headings(spark, sf):
    rows = S.features(lines(spark, sf)).withColumn("candidate", F.length("title") < 80)
    return S.pick_headings(rows).where("accepted").select("doc_id", "para_idx")


def _outline(paras: DataFrame) -> DataFrame:
    """Only even books have one."""
    return A.pages_as_outline(paras).where(F.col("doc_id").cast("bigint") % 2 == 0)


def _chapter_rows(paras, sections) -> DataFrame:
    members = sections.members.groupBy("doc_id", "chapter_key").agg(F.count("*").alias("paragraphs"))
    return sections.chapters.join(members, ["doc_id", "chapter_key"], "left").select(
        "doc_id", "chapter_idx", "chapter_id", "title", "start_page", "detection_mode", "paragraphs"
    )


@query
def sections_from_headings(spark, sf):
    p = page_lines(spark, sf)
    return _chapter_rows(p, S.sections_from_headings(p))


@query
def sections_from_outline(spark, sf):
    p = page_lines(spark, sf)
    return _chapter_rows(p, S.sections_from_outline(p, A.pages_as_outline(p)))


@query
def sections_by_word_count(spark, sf):
    p = lines(spark, sf)
    return _chapter_rows(p, S.sections_by_word_count(p, 200))


@query
def choose_sections(spark, sf):
    p = page_lines(spark, sf)
    return _chapter_rows(p, S.choose_sections(p, _outline(p)))


@query
def join_blocks(spark, sf):
    p = lines(spark, sf)
    members = p.select("doc_id", "para_idx", F.col("page").cast("bigint").alias("chapter_key"), F.lit(0).alias("passage"))
    return S.chapter_passages(p, members).select("doc_id", "chapter_key", "text")


@query
def renumber_chapters(spark, sf):
    heads = page_lines(spark, sf).where("font_size > 11").select(
        "doc_id", F.col("para_idx").alias("chapter_key"), F.col("text").alias("title"), F.col("page").alias("start_page"),
        F.lit("heading").alias("detection_mode"),
    )
    return S.renumber_chapters(heads)


@query
def build_chapters(spark, sf):
    """Runs of plain documents to numbered sentences."""
    return X.build_chapters(A.paragraphs_as_runs(lines(spark, sf)), splitter="simple").sentences


@query
def build_web_chapters(spark, sf):
    """Web pages with headings and, for half of the books, a table of contents."""
    p = page_lines(spark, sf)
    return X.books_from_paragraphs(p, _outline(p), splitter="simple").sentences


@query
def book_content(spark, sf):
    """The same books as chapters with their sentences nested."""
    p = page_lines(spark, sf)
    nested = X.book_content(X.books_from_paragraphs(p, _outline(p), splitter="simple"))
    return nested.groupBy("doc_id", "chapter_idx", "chapter_id", "title", "start_page", "detection_mode").agg(
        F.sum(F.size("sentences")).alias("sentences"),
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("passage", "sentences"))), lambda x: x["sentences"])), "\n").alias("text"),
    )


@query
def build_chapters_unicode(spark, sf):
    """The same with Unicode sentence boundaries, the default."""
    p = page_lines(spark, sf)
    return X.books_from_paragraphs(p, _outline(p)).sentences


@query
def narration_chapters(spark, sf):
    """Estimated listening time per chapter of plain documents."""
    p = lines(spark, sf)
    sections = S.choose_sections(p)
    out = X.chapter_durations(X.chapter_sentences(p, sections, "simple"), sections.chapters)
    return out.withColumn("est_seconds", r6(F.col("est_seconds")))


@query
def build_mixed_language_chapters(spark, sf):
    """Chapters of a corpus in several languages: broken words are repaired in English documents only."""
    languages = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("language"))
    return X.books_from_paragraphs(lines(spark, sf), splitter="simple", languages=languages).sentences


# --- sentences -------------------------------------------------------------------------------


def _turns(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return A.spread(c, "conv_id", "turn").select("conv_id", "turn", T.collapse_whitespace("text").alias("text"))


@query
def segment_sentences(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(N.segment_sentences("text")).alias("pos", "text"))


@query
def merge_abbreviations(spark, sf):
    pieces = F.split(F.regexp_replace("text", "([a-z]) ([a-z]) ", "$1 $2. "), "(?<=[.]) ")
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(N.merge_abbreviations(pieces)).alias("pos", "text"))


@query
def split_sentences_simple(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(N.split_sentences_simple("text")).alias("pos", "text"))


@query
def enforce_max_length(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(N.enforce_max_length(F.array("text"))).alias("pos", "text"))


@query
def split_sentences(spark, sf):
    """Clean, split and cap every document as one text."""
    d = A.spread(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.posexplode(N.split_sentences("text", "simple")).alias("pos", "text"))


@query
def segment_other_scripts(spark, sf):
    """Sentences of texts whose end marks are those of other scripts: a full stop of Chinese, an exclamation mark of
    double width, an Arabic question mark."""
    marked = F.translate("text", ".!?", "。！؟")
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(N.segment_sentences(marked)).alias("pos", "text"))


@query
def split_sentences_unicode(spark, sf):
    d = A.spread(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.posexplode(N.split_sentences("text")).alias("pos", "text"))


@query
def explode_sentences(spark, sf):
    nested = _turns(spark, sf).select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("chapter_idx"),
        F.concat(F.lit("ch_"), F.col("turn") + 1).alias("chapter_id"), N.split_sentences_simple("text").alias("sentences"),
    )
    return X.explode_sentences(nested)


@query
def explode_words(spark, sf):
    return X.explode_words(spoken(spark, sf)).select("doc_id", "global_idx", "word_idx", "char_index", "word")


# --- catalog, joins, reports -----------------------------------------------------------------


@query
def book_counts(spark, sf):
    s = spoken(spark, sf)
    chapters = s.select("doc_id", "chapter_idx").distinct().withColumn("detection_mode", F.lit("wordSplit"))
    return B.book_counts(chapters, s)


@query
def chapter_seconds(spark, sf):
    return C.chapter_seconds(spoken(spark, sf)).withColumn("est_seconds", r6(F.col("est_seconds")))


@query
def book_duration(spark, sf):
    return C.book_duration(C.chapter_seconds(spoken(spark, sf))).withColumn("est_seconds", r6(F.col("est_seconds")))


@query
def books_with_progress(spark, sf):
    return C.books_with_progress(books(spark, sf), B.latest_progress(positions(spark, sf))).select(
        "book_id", "title", "chapter_id", "sentence_idx", "offset_sec", "char_index"
    )


@query
def books_with_content(spark, sf):
    n = spoken(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.count_if(F.col("chapter_idx") > 0).alias("later_sentences"))
    content = n.select(B.book_id("doc_id").alias("book_id"), "sentences", "later_sentences")
    b = books(spark, sf)
    none = F.lit(None).cast("bigint")
    return C.books_with_content(b, content).select("book_id", "sentences", "later_sentences").unionByName(
        C.missing_content(b, content).select("book_id", none.alias("sentences"), none.alias("later_sentences"))
    )


@query
def place_progress(spark, sf):
    s = spoken(spark, sf).withColumn("book_id", B.book_id("doc_id"))
    return C.place_progress(positions(spark, sf), s).select("event_id", "book_id", "global_idx")


@query
def library_overview(spark, sf):
    over = C.library_overview(books(spark, sf), B.latest_progress(positions(spark, sf)))
    return C.list_overview(over).select("book_id", "title", "chapter_idx", r6(F.col("progress_pct")).alias("progress_pct"))


@query
def continue_reading(spark, sf):
    """Per file source as the owner."""
    over = C.library_overview(books(spark, sf), B.latest_progress(positions(spark, sf))).withColumn(
        "owner", F.substring_index("file_name", "_", 1)
    )
    return C.continue_reading(over, "owner").select("owner", "book_id", r6(F.col("progress_pct")).alias("progress_pct"))


@query
def first_content_sentence(spark, sf):
    p = page_lines(spark, sf)
    s = A.paragraphs_as_sentences(p, 7)
    titles = s.where("sentence_idx = 0").select(
        "doc_id", "chapter_idx", F.when(F.col("global_idx") % 3 == 0, F.concat(F.lit("Contents "), "text"))
        .when(F.col("global_idx") % 5 == 0, F.concat(F.lit("Chapter "), "text")).otherwise(F.col("text")).alias("title")
    )
    return C.first_content_sentence(titles, s)


@query
def preferred_voice(spark, sf):
    return C.preferred_voice(A.nations_as_voices(table(spark, sf, "customer")))


@query
def sentence_audit(spark, sf):
    return Q.sentence_audit(spoken(spark, sf))


@query
def audit_examples(spark, sf):
    return Q.audit_examples(spoken(spark, sf), 6)


@query
def corpus_audit(spark, sf):
    out = Q.corpus_audit(spoken(spark, sf))
    return out.select("check_name", "n", F.concat_ws("|", "examples").alias("examples"))


@query
def integrity_checks(spark, sf):
    """Every document: its first five sentences are wanted in a row, the first and third side by side are not."""
    s = spoken(spark, sf)
    joined = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("global_idx", "text")))), lambda x: x["text"]), " ")
    ex = s.where("global_idx < 5").groupBy("doc_id").agg(joined(F.col("global_idx") < 5).alias("run"), joined(F.col("global_idx").isin(0, 2)).alias("gap"))
    ex = ex.select(
        F.col("doc_id").alias("case_id"), "doc_id", F.array("run", F.lit("and")).alias("must_contain"), F.array("gap", F.lit(", the")).alias("must_not_contain"),
    )
    return Q.integrity_checks(s, ex)


@query
def punctuation_checks(spark, sf):
    return Q.punctuation_checks(spoken(spark, sf))


@query
def runs_in_context(spark, sf):
    return Q.runs_in_context(word_runs(spark, sf), "tion").select("doc_id", "match", "page", "pos", "is_match", "text", "x")


@query
def detection_mode_summary(spark, sf):
    p = page_lines(spark, sf)
    built = X.books_from_paragraphs(p, _outline(p), splitter="simple")
    return Q.detection_mode_summary(built.chapters, built.sentences)


@query
def font_size_profile(spark, sf):
    return Q.font_size_profile(page_lines(spark, sf))


# --- navigation ------------------------------------------------------------------------------


@query
def chapter_starts(spark, sf):
    out = G.chapter_starts(C.chapter_seconds(spoken(spark, sf)))
    return out.select("doc_id", "chapter_idx", r6(F.col("est_seconds")).alias("est_seconds"), r6(F.col("start_sec")).alias("start_sec"))


@query
def chapter_position(spark, sf):
    s = spoken(spark, sf)
    at = s.select("doc_id", "chapter_idx", "sentence_idx", r6(F.length("text") / 28.0).alias("position_sec"))
    return G.chapter_position(G.sentence_starts(s), at).select(
        "doc_id", "chapter_idx", "sentence_idx", r6(F.col("chapter_pos_sec")).alias("chapter_pos_sec"),
        r6(F.col("book_pos_sec")).alias("book_pos_sec"),
    )


@query
def neighbour_targets(spark, sf):
    return G.neighbour_targets(spoken(spark, sf))


def _requests(spark, sf) -> DataFrame:
    """Every event asks in the book and sentence it names."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("doc_id"), (e % 9).alias("global_idx"), F.floor("value").alias("char_index"),
        (F.lit(0.5) + (e % 4) * 0.5).alias("rate"), ((e % 13 - 6) * 4.0).alias("delta"),
    )


@query
def skip_seconds(spark, sf):
    return G.skip_seconds(spoken(spark, sf), _requests(spark, sf)).select("event_id", "to_global_idx", "to_char_index")


@query
def resolve_resume(spark, sf):
    s = spoken(spark, sf)
    titles = s.where("sentence_idx = 0").select("doc_id", "chapter_idx", F.col("text").alias("title"))
    first = C.first_content_sentence(titles, s).withColumn("book_id", B.book_id("doc_id"))
    return G.resolve_resume(
        books(spark, sf), s.withColumn("book_id", B.book_id("doc_id")), B.latest_progress(positions(spark, sf)), first
    )


@query
def seek_target(spark, sf):
    req = _requests(spark, sf).select(
        "event_id", "doc_id", F.floor(F.col("global_idx") / 5).alias("chapter_idx"), (F.col("global_idx") % 5).alias("sentence_idx"),
        (F.col("event_id") % 6).cast("int").alias("word_idx"),
    )
    return G.seek_target(spoken(spark, sf), req).select("event_id", "global_idx", F.col("char_index").cast("bigint").alias("char_index"))


@query
def advance_sequence(spark, sf):
    req = _requests(spark, sf).select("event_id", "doc_id", "global_idx", F.col("char_index").alias("from_char"))
    return G.advance_sequence(spoken(spark, sf), req).select("event_id", "speak_idx", "speak_from")


# --- playback --------------------------------------------------------------------------------

TWO_DAYS = 2 * 24 * 3600 * 1000


def _saves(spark, sf) -> DataFrame:
    return A.events_as_progress(table(spark, sf, "events")).select(
        "reader_id", "event_id", "ts", F.when((F.col("kind") == "close") & (F.col("event_id") % 4 == 0), "close").otherwise("save").alias("kind"),
        F.col("offset_sec").alias("value"),
    )


@query
def coalesce_updates(spark, sf):
    return P.coalesce_updates(_saves(spark, sf), ["reader_id"], TWO_DAYS).select("reader_id", "fired_at_ms", "updates", "event_id", "value")


def _stream(spark, sf, end: bool = False) -> DataFrame:
    """The events as a stream; with ``end``, another reader's event long after all others, which moves the
    watermark past every timer."""
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if not end:
        return stream
    path = f"{run_folder(spark)}/end-{uuid4().hex}"
    last = batch.agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("r")).where("r is not null").select("r.*")
    last.withColumns({
        "ts": (F.col("ts") + F.expr("interval 400 days")).cast(batch.schema["ts"].dataType),
        "user_id": F.lit(-1).cast(batch.schema["user_id"].dataType),
    }).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(batch.schema).parquet(path))


def _drain(spark, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all of its input into files and read them."""
    root = f"{run_folder(spark)}/{name}-{uuid4().hex}"
    q = (
        df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query
def coalesce_updates_stream(spark, sf):
    """The stateful stream; what still waits at the end is written as well, as in the batch."""
    ST.use_rocksdb(spark)
    ev = _saves_of(A.events_as_progress(_stream(spark, sf, end=True)))
    out = _drain(spark, ST.coalesce_updates(ev, TWO_DAYS, "1 second"), "saves")
    return out.select(F.col("key").cast("bigint").alias("reader_id"), "fired_at_ms", "updates", "event_id", "value")


def _saves_of(progress: DataFrame) -> DataFrame:
    kind = F.when((F.col("kind") == "close") & (F.col("event_id") % 4 == 0), "close").otherwise("save")
    return progress.select(
        F.col("reader_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.col("offset_sec").alias("value"),
    )


@query
def latest_position_stream(spark, sf):
    """Last write per book: each micro-batch writes the books it has changed, and the newest row of a book counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = A.events_as_positions(_stream(spark, sf)).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    root = f"{run_folder(spark)}/latest-{uuid4().hex}"
    written = _changes(spark, SQ.latest_position(rows), root)
    newest = F.max_by(F.struct("event_id", "chapter_id", "sentence_idx", "offset_sec", "char_index"), "batch").alias("r")
    return written.groupBy("book_id").agg(newest).select("book_id", "r.*")


def _changes(spark, changing: DataFrame, root: str) -> DataFrame:
    """Run a stream in update mode; every micro-batch's changed rows with its number as ``batch``."""
    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = changing.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changing.schema)
    return spark.read.schema(f"{fields}, batch long").parquet(f"{root}/out")


@query
def furthest_position(spark, sf):
    """How far each utterance has come, kept by a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = A.events_as_playback(_stream(spark, sf)).withColumn("reported", F.col("position")).withColumn("ts", F.col("ts").cast("timestamp"))
    written = _changes(spark, SQ.furthest_position(ev, ["session_id", "book_id"]), f"{run_folder(spark)}/furthest-{uuid4().hex}")
    return written.groupBy("session_id", "book_id").agg(F.max("position").alias("position"))


@query
def monotonic_position(spark, sf):
    ev = A.events_as_playback(table(spark, sf, "events")).withColumn("reported", F.col("position"))
    return P.monotonic_position(ev, ["session_id", "book_id"]).select("event_id", "position")


@query
def interpolate_position(spark, sf):
    return P.interpolate_position(A.events_as_speech(table(spark, sf, "events")), ["session_id"]).select("event_id", "position")


def _arriving(spark, sf, late_ms: int, stream: Callable[[DataFrame], DataFrame], name: str, batches: int = 4) -> DataFrame:
    """What ``stream`` writes of the events as they arrive: in several micro-batches, out of order, up to ``late_ms`` after
    their time. Each batch is put there and then worked off by the same query, which goes on from its checkpoint. Last
    comes another reader's event long after all others, which moves the watermark past every timer."""
    events = table(spark, sf, "events")
    types, root = events.schema, f"{run_folder(spark)}/{name}-{uuid4().hex}"
    rows = events.withColumn("_arrival", P.millis("ts") + F.pmod(F.xxhash64("event_id"), F.lit(late_ms)))
    span = rows.agg(F.min("_arrival").alias("low"), F.max("_arrival").alias("high")).first()
    step = ((span["high"] or 0) - (span["low"] or 0)) // batches + 1
    parts = [rows.where(F.floor((F.col("_arrival") - (span["low"] or 0)) / step) == n).drop("_arrival") for n in range(batches)]
    last = events.agg(F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("r")).where("r is not null").select("r.*")
    parts.append(last.withColumns({
        "ts": (F.col("ts") + F.expr("interval 400 days")).cast(types["ts"].dataType), "user_id": F.lit(-1).cast(types["user_id"].dataType)}))
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        out = stream(spark.readStream.schema(types).parquet(f"{root}/in"))
        q = (
            out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _in_utc(spark) -> None:
    ST.use_rocksdb(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


SIX_HOURS = 6 * 3600 * 1000


@query
def interpolate_position_late(spark, sf):
    """Utterances also end with a silence of six hours."""
    ev = A.events_as_speech(table(spark, sf, "events"))
    return P.interpolate_position(ev, ["session_id"], idle_ms=SIX_HOURS).select("event_id", "position")


@query
def interpolate_position_stream(spark, sf):
    """The same from a stream of several micro-batches whose events come up to two days late."""
    _in_utc(spark)
    timed = lambda ev: A.events_as_speech(ev).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _arriving(spark, sf, TWO_DAYS, lambda ev: ST.interpolate_position(timed(ev), ["session_id"], idle_ms=SIX_HOURS, lateness="2 days"), "positions")
    return out.select("event_id", "position")


@query
def monotonic_position_stream(spark, sf):
    """The furthest position of a book at each event, from a stream whose events come up to two days late; the last reader's
    event, which ends the stream, isn't passed by the watermark."""
    _in_utc(spark)
    timed = lambda ev: A.events_as_playback(ev).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("reported", F.col("position"))
    out = _arriving(spark, sf, TWO_DAYS, lambda ev: ST.monotonic_position(timed(ev), ["session_id", "book_id"], idle_ms=None, lateness="2 days"), "furthest")
    return out.select("event_id", "position")


@query
def playback_sessions(spark, sf):
    return P.playback_sessions(A.events_as_playback(table(spark, sf, "events")), ["session_id"], SIX_HOURS).withColumn("listened_sec", r6(F.col("listened_sec")))


@query
def playback_sessions_stream(spark, sf):
    """Sessions with listened seconds, from a stream whose events, pauses too, come up to two days late."""
    _in_utc(spark)
    timed = lambda ev: A.events_as_playback(ev).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _arriving(spark, sf, TWO_DAYS, lambda ev: ST.playback_sessions(timed(ev), ["session_id"], SIX_HOURS, "2 days"), "spells")
    return out.withColumn("listened_sec", r6(F.col("listened_sec")))


@query
def detect_stalls(spark, sf):
    ev = A.events_as_playback(table(spark, sf, "events"))
    return P.detect_stalls(ev, ["session_id"], 8 * 3600 * 1000, 4 * 3600 * 1000).select("session_id", "event_id", "stalled_from_ms", "silence_ms")


@query
def detect_stalls_stream(spark, sf):
    ST.use_rocksdb(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = A.events_as_playback(_stream(spark, sf, end=True)).select(
        F.col("session_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind"
    )
    return _drain(spark, ST.watch_stalls(ev, seen_ms=8 * 3600 * 1000, unseen_ms=4 * 3600 * 1000), "stalls")


@query
def sessionize_playback(spark, sf):
    out = P.sessionize_playback(A.events_as_playback(table(spark, sf, "events")), ["session_id"])
    return out.withColumn("listened_sec", r6(F.col("listened_sec")))


@query
def listening_sessions_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = A.events_as_playback(_stream(spark, sf, end=True)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, SQ.listening_sessions(ev, "6 hours", "1 hour"), "sessions")
    return out.select("session_id", F.unix_millis("started").alias("started_ms"), "events", "plays", "furthest")


@query
def incremental_chapters(spark, sf):
    """Chapters and sentences of documents that arrive as a stream of runs, in two micro-batches."""
    root = f"{run_folder(spark)}/arrivals-{uuid4().hex}"
    A.paragraphs_as_runs(page_lines(spark, sf)).repartition("doc_id").write.parquet(f"{root}/runs")

    def sink(built: X.Books, n: int) -> None:
        built.chapters.write.mode("overwrite").parquet(f"{root}/chapters/batch={n}")
        built.sentences.write.mode("overwrite").parquet(f"{root}/sentences/batch={n}")

    files = -(-len(spark.read.parquet(f"{root}/runs").inputFiles()) // 2)  # two micro-batches
    SQ.incremental_chapters(R.stream_runs(spark, f"{root}/runs", maxFilesPerTrigger=files), sink, f"{root}/log", splitter="simple").awaitTermination()
    spoken_in = spark.read.parquet(f"{root}/sentences").groupBy("doc_id", "chapter_idx").agg(
        F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))
    return spark.read.parquet(f"{root}/chapters").join(spoken_in, ["doc_id", "chapter_idx"], "left").select(
        "doc_id", "chapter_idx", "title", "start_page", "detection_mode", F.coalesce("sentences", F.lit(0)).alias("sentences"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
    )


ORACLES: dict[str, str] = {name: text for name, text in SQL.items() if name in QUERIES}
