"""Table schemas. Order inside a document is always an explicit index column."""

RAW_ITEMS = (
    "doc_id string, page int, item_idx int, str string, transform array<double>, "
    "width double, height double, has_eol boolean"
)
RUNS = (
    "doc_id string, page int, run_idx int, text string, font_size double, x double, y double, width double"
)
DOCS = "doc_id string, file_name string, meta_title string, page_count int"
OUTLINE_NODES = "doc_id string, node_id string, parent_id string, ord int, title string, page int"
OUTLINE = "doc_id string, entry_idx bigint, title string, page int"
PARAGRAPHS = "doc_id string, para_idx bigint, page int, text string, font_size double"
CHAPTERS = (
    "doc_id string, chapter_idx bigint, chapter_id string, title string, start_page int, detection_mode string"
)
SENTENCES = (
    "doc_id string, chapter_idx bigint, chapter_id string, sentence_idx bigint, global_idx bigint, text string"
)
BOOKS = (
    "book_id string, doc_id string, title string, file_name string, page_count int, chapter_count bigint, "
    "sentence_count bigint, voice string, detection_mode string, added_at timestamp"
)
CHUNKS = (
    "book_id string, chapter_id string, sentence_idx bigint, voice string, duration double, data binary, "
    "added_at timestamp"
)
PROGRESS = (
    "book_id string, event_id bigint, chapter_id string, sentence_idx bigint, offset_sec double, "
    "char_index int, updated_at timestamp"
)
FILES = "book_id string, path string"
PLAYBACK = (
    "session_id string, event_id bigint, ts timestamp, kind string, global_idx bigint, char_index int, rate double"
)
VOICES = "device_id string, ord int, voice_id string, name string, lang string, is_default boolean"

# The stores a library keeps; order is the order of creation.
STORES = {
    "books": BOOKS,
    "chapters": "book_id string, " + CHAPTERS,
    "sentences": "book_id string, " + SENTENCES,
    "chunks": CHUNKS,
    "progress": PROGRESS,
    "files": FILES,
}

DETECTION_MODES = ["outline", "heading", "wordSplit"]
