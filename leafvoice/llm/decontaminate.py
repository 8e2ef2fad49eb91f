"""Benchmark decontamination: Aho-Corasick automata over the normalised windows of all test items.

Texts and items are normalised alike: A-Z lower-cased, everything in ASCII that is neither a letter nor a digit is a
separator, words joined by one space. Each automaton runs once over each normalised text; its hits are mapped back to
word numbers, united over the automata, and mapped to byte offsets in the original text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafvoice.llm.buffers import LOWER, text_slices, words
from leafvoice.llm.tables import Steps, table

#: Words of test items that one automaton holds, about 300 bytes each. More items are taken in several automata, which are
#: filled by half, as the items are dealt by hash.
AUTOMATON_WORDS = 200_000
#: Windows of an item that are dealt together.
CHUNK_WINDOWS = 1_000
#: Separators of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_NORMAL = bytes(0x20 if SEPARATOR[LOWER[b]] else int(LOWER[b]) for b in range(256))


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(items, width: int) -> dict[bytes, tuple[int, set[str]]]:
    """Normalised window -> (its number of words, items it occurs in)."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = normal_words((text or "").encode())
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            ids = out.setdefault(b" ".join(w[i: i + n]), (n, set()))[1]
            if item_id is not None:
                ids.add(item_id)
    return out


def automaton_of(items, width: int) -> ahocorasick.Automaton:
    """Each byte stands as one character, so that positions are byte positions."""
    a = ahocorasick.Automaton()
    for window, (n, ids) in windows_of(items, width).items():
        a.add_word(" " + window.decode("latin-1") + " ", (len(window), n, tuple(sorted(ids))))
    if len(a):
        a.make_automaton()
    return a


def _chunks(width: int, most: int):
    """Pieces of items that hold all their windows, of ``most`` windows at most."""
    def run(batches):
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = normal_words((text or "").encode())
                for i in range(0, max(1, len(w) - width + 1) if w else 0, most):
                    part = w[i: i + most + width - 1]
                    out.append((item_id, b" ".join(part).decode(), len(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["item_id", "text", "n"])
    return run


def _hits(automaton: ahocorasick.Automaton, norm: list[bytes]) -> tuple[np.ndarray, list[str]] | None:
    """Which words lie in a window, and the items; None if there are none."""
    line = b" " + b" ".join(norm) + b" "
    # A window's last blank ends the hit; the next window may begin with it.
    found = list(automaton.iter(line.decode("latin-1"))) if len(automaton) else []
    if not found:
        return None
    at = np.frombuffer(line, np.uint8) == 0x20
    word_at = np.cumsum(at) - 1
    hit = np.zeros(len(norm) + 1, np.int64)
    for end, (size, n, _) in found:
        w = word_at[end - size - 1]
        hit[w] += 1
        hit[w + n] -= 1
    return np.cumsum(hit[:-1]) > 0, sorted({i for _, (_, _, ids) in found for i in ids})


def _runs(inside: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def _found_rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found_of) -> pa.RecordBatch:
    """found_of: (row, normalised words) -> what ``_hits`` gives."""
    raw = data.tobytes()
    n_words, n_hit, items, spans = [], [], [], []
    for r in range(batch.num_rows):
        text = raw[offsets[r]: offsets[r + 1]]
        norm = normal_words(text)
        n_words.append(len(norm))
        found = found_of(r, norm)
        if found is None:
            n_hit.append(0)
            items.append([])
            spans.append([])
            continue
        inside, ids = found
        n_hit.append(int(inside.sum()))
        items.append(ids)
        own = np.frombuffer(text, np.uint8)
        starts, ends, _ = words(LOWER[own], np.array([0, len(own)]), SEPARATOR)
        spans.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in _runs(inside)])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        names=["key", "n_words", "n_hit", "items", "spans"])


def _scan(shared, width: int):
    """One automaton holds all items."""
    def run(batches):
        automaton = automaton_of(shared.value, width)
        for batch, data, offsets in text_slices(batches):
            yield _found_rows(batch, data, offsets, lambda _, norm: _hits(automaton, norm))
    return run


def _scan_part(shared, width: int):
    """Hit words and items of the texts that this automaton hits."""
    def run(batches):
        automaton = automaton_of(shared.value, width)
        for batch, data, offsets in text_slices(batches):
            raw, of, runs, items = data.tobytes(), [], [], []
            for r, of_text in enumerate(batch.column(0).to_pylist()):
                found = _hits(automaton, normal_words(raw[offsets[r]: offsets[r + 1]]))
                if found is not None:
                    of.append(of_text)
                    runs.append([{"begin": a, "stop": b} for a, b in _runs(found[0])])
                    items.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.string()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=["of", "runs", "items"])
    return run


def _unite(batches):
    """Rows of (key, text, runs, items): what the automata found in the text."""
    for batch, data, offsets in text_slices(batches):
        runs, items = batch.column(2), batch.column(3)

        def found_of(r, norm):
            if not runs[r].is_valid:
                return None
            hit = np.zeros(len(norm) + 1, np.int64)
            np.add.at(hit, np.asarray(runs[r].values.field(0)), 1)
            np.add.at(hit, np.asarray(runs[r].values.field(1)), -1)
            return np.cumsum(hit[:-1]) > 0, sorted(set(items[r].as_py()))
        yield _found_rows(batch, data, offsets, found_of)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of each row of ``docs`` (doc_id, text). With ``keep``, the struct ``_row`` of
    those columns takes the place of ``doc_id``.

    ``items`` are the ids (as strings) of the items of ``benchmark`` (item_id, text) of which a window occurs;
    ``spans`` are the hit words as byte offsets into the original UTF-8 text. An item of fewer than ``width`` words is one
    window; one without words hits nothing. Null texts have no words. Repeated items count once; a null ``item_id``
    hits words, but is in no list.

    The driver takes the test items up to ``AUTOMATON_WORDS`` words at once. More are dealt into parts: each part's
    automaton scans all texts, and what the parts hit is united per text before anything is counted.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    pieces = items.mapInArrow(_chunks(width, CHUNK_WINDOWS), "item_id string, text string, n long")
    key = F.struct(*keep) if keep else F.col("doc_id")
    rows = docs.select(key.alias("key"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL(_FOUND)])
    name = "_row" if keep else "doc_id"
    size = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    if size <= AUTOMATON_WORDS:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in pieces.collect()])
        return rows.mapInArrow(_scan(shared, width), schema).withColumnRenamed("key", name)
    parts, steps = -(-2 * size // AUTOMATON_WORDS), Steps(spark, "decontaminate")
    dealt = steps.keep(pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    # What is hit depends on the text only: equal texts are one.
    texts = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("of"), "text")
    hits = None
    for part in range(parts):
        own = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).collect()])
        found = texts.mapInArrow(_scan_part(own, width), "of string, runs array<struct<begin: long, stop: long>>, items array<string>")
        found = steps.keep(found.groupBy("of").agg(F.first("runs").alias("runs"), F.first("items").alias("items")), "part")
        own.destroy()
        hits = found if hits is None else hits.union(found)
    hits = steps.keep(hits.groupBy("of").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items")), "hits")
    joined = rows.withColumn("_of", F.md5(F.coalesce("text", F.lit("")))).join(hits, F.col("_of") == F.col("of"), "left")
    return joined.select("key", "text", "runs", "items").mapInArrow(_unite, schema).withColumnRenamed("key", name)


def op8_benchmark_decontamination(spark, sf_dir):
    """Words of whole documents inside windows of ten words of test items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")
