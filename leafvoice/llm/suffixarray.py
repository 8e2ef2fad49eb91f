"""Repeated byte strings by longest-previous-factor arrays.

Within a shard the windows are put into suffix order by prefix doubling. For each suffix the nearest ones above and below
that begin at a smaller position give the longest earlier match; where it has ``SIZE`` bytes the suffix is a later copy
and the match its source. Removing later copies keeps the first one of each string; the sources tell that one as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafvoice.llm.buffers import prefix_sums, span_hashes, text_slices
from leafvoice.llm.repeats import Kind, Shard, covered, keyed, repeated_spans
from leafvoice.llm.tables import table

SIZE, GRAM = 200, 96


def suffix_order(text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the ``size`` bytes that follow (equal ones by position), and the length, in steps of 8 up to
    ``size``, that each shares with the one before it."""
    padded = np.concatenate([text, np.zeros(size + 8, np.uint8)]).astype(np.uint64)
    n = len(text)
    word = np.zeros(n + size, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k: k + n + size]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    levels, reach = [(8, rank)], 8
    while 2 * reach <= size:
        key = rank * (rank.max() + 1)
        key[: len(rank) - reach] += rank[reach:]
        rank = np.unique(key, return_inverse=True)[1]
        reach *= 2
        levels.append((reach, rank))
    last = rank[starts] * (rank.max() + 1) + rank[starts + size - reach]
    order = np.lexsort((starts, last))
    pos, last = starts[order], last[order]
    share = np.zeros(len(pos), np.int64)
    for reach, rank in reversed(levels):
        equal = rank[pos[1:] + share[1:]] == rank[np.minimum(pos[:-1] + share[1:], len(rank) - 1)]
        share[1:] += reach * equal
    share[1:] = np.where(last[1:] == last[:-1], size, np.minimum(share[1:], size - 1))
    return pos, share


def _nearest_smaller(pos: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller position (-1: none), and what the two share. Pointers jump
    over places that are larger themselves."""
    at, least = np.arange(len(pos)) - 1, share.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[pos[at[open_]] > pos[open_]]
        over = at[open_]
        least[open_] = np.minimum(least[open_], least[over])
        at[open_] = at[over]
        open_ = open_[at[open_] >= 0]
    least[at < 0] = 0
    return at, least


def previous_factors(pos: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest match that begins earlier, and where it begins (-1: none), for each place of the suffix order."""
    up, long_up = _nearest_smaller(pos, share)
    down, long_down = _nearest_smaller(pos[::-1], np.append(0, share[1:][::-1]))
    down, long_down = len(pos) - 1 - down[::-1], long_down[::-1]
    down[down == len(pos)] = -1
    length = np.maximum(long_up, long_down)
    source = np.where(long_up >= long_down, up, down)
    return length, np.where((source >= 0) & (length > 0), pos[source], -1)


def _search(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin anywhere else, too; passed on is one of each different window."""
    _, first, inverse, count = np.unique(shard.print_, return_index=True, return_inverse=True, return_counts=True)
    removed = np.zeros(len(shard.window), bool)
    passed = np.zeros(len(shard.window), bool)
    passed[first] = True
    maybe = count[inverse] > 1
    if not maybe.any():
        return removed, passed
    # Equal contexts need one of them; contexts without a fingerprint seen twice need none.
    whole = span_hashes(prefix_sums(shard.symbols), shard.first[:-1], shard.first[1:])
    _, head, same, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    removed[copies[same][shard.of] > 1] = True
    some = np.zeros(len(shard.n), bool)
    some[shard.of[maybe]] = True
    some &= head[same] == np.arange(len(same))
    part = shard.pick(np.flatnonzero(some), SIZE)
    pos, share = suffix_order(part.symbols, part.window, SIZE)
    length, source = previous_factors(pos, share)
    again = np.zeros(len(part.symbols), bool)
    again[pos[length >= SIZE]] = True
    again[source[length >= SIZE]] = True
    removed[np.isin(shard.of, np.flatnonzero(some))] |= again[part.window]
    return removed, passed


def _bytes(data: np.ndarray, offsets: np.ndarray):
    return data, offsets


REPEATED_BYTES = Kind("suffixarray", SIZE, GRAM, np.uint8, _bytes, _search, ordered=False)


def _strip(with_text: bool):
    def run(batches):
        for batch, data, offsets in text_slices(batches):
            masks = covered(batch.column(batch.schema.get_field_index("spans")), np.diff(offsets))
            n, removed, runs, sha, kept = [], [], [], [], []
            for r, mask in enumerate(masks):
                own = data[offsets[r]: offsets[r + 1]]
                n.append(len(own))
                removed.append(0 if mask is None else int(mask.sum()))
                runs.append(0 if mask is None else int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
                rest = (own if mask is None else own[~mask]).tobytes()
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n), pa.array(removed), pa.array(runs), pa.array(sha), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeated_bytes(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of each row of ``docs`` (doc_id, text): each byte is removed
    that lies in a string of ``SIZE`` bytes which also begins anywhere else.

    Texts are UTF-8 bytes; null is empty; shorter texts than ``SIZE`` lose nothing. Repeated rows are copies of each other.
    What is kept may cut a character, so ``kept`` is binary (null unless ``with_text``).
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, REPEATED_BYTES)
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _strip(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_array_dedup(spark, sf_dir):
    """Whole documents without their repeated strings of 200 bytes."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
