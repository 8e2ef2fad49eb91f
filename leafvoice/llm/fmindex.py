"""Repeated word windows by a compressed FM-index per shard.

A shard's contexts are indexed by their Burrows-Wheeler transform in a wavelet matrix: one bit vector per level with
block counts. Texts are streamed against it by backward search; lanes of many texts step together. When a match has
``SIZE`` words its window is reported with its suffix interval, the interval is widened to the words that the next window
shares, and the search goes on one word to the left: matching statistics, cut at the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafvoice.llm.buffers import prefix_sums, span_hashes, text_slices, word_hashes, words
from leafvoice.llm.repeats import Kind, Shard, covered, keyed, repeated_spans
from leafvoice.llm.tables import table

SIZE, GRAM = 50, 16


class BitVector:
    """Packed bits with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - n % 64, bool)]), bitorder="little")
        self.blocks = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks))]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        low = self.blocks[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of symbols 0..sigma-1 in a sequence: one bit vector per bit of the symbol, the highest first."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (sequence >> bit) & 1 == 1
            self.levels.append((bit, BitVector(ones)))
            self.zeros.append(int(len(ones) - ones.sum()))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before lo and before hi, less those of smaller symbols' runs: both ends of the symbol's run in the
        last level's order, whose difference is the number of occurrences between."""
        for (bit, v), zeros in zip(self.levels, self.zeros):
            one = (symbol >> bit) & 1 == 1
            a, b = v.ones(lo), v.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo, hi


class FMIndex:
    """Index of sequences that stand one after another; matches don't cross their ends."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, size: int) -> None:
        self.alphabet, code = np.unique(symbols, return_inverse=True)
        # Sequence ends are symbol 0, smaller than all others.
        n_seq = len(first) - 1
        length = np.diff(first)
        self.first = first[:-1] + np.arange(n_seq)
        text = np.zeros(len(symbols) + n_seq, np.int64)
        own = np.repeat(np.arange(n_seq), length)
        text[np.arange(len(symbols)) + own] = code + 1
        n = len(text)
        at_end = np.repeat(self.first + length, length + 1)
        left = at_end - np.arange(n) + 1  # symbols up to the end, itself included
        rank, reach = text, 1
        shared: dict[int, np.ndarray] = {1: rank}
        while reach < length.max(initial=0) + 1:
            key = rank * (rank.max() + 1)
            more = np.flatnonzero(left > reach)
            key[more] += rank[more + reach]
            rank = np.unique(key, return_inverse=True)[1]
            reach *= 2
            shared[reach] = rank
        # Equal suffixes are ordered by sequence.
        order = np.argsort(rank, kind="stable")
        self.suffix = order
        previous = np.where(order > 0, text[order - 1], 0)
        start = np.zeros(n, bool)
        start[self.first] = True
        previous[start[order]] = 0
        self.sigma = len(self.alphabet) + 1
        self.bwt = WaveletMatrix(previous, self.sigma)
        # Where each symbol's run begins, in suffixes and in the wavelet matrix' last level.
        self.begin = np.searchsorted(np.sort(text), np.arange(self.sigma))
        zero = np.zeros(self.sigma, np.int64)
        self.origin = self.bwt.ranks(np.arange(self.sigma), zero, zero)[0]
        # Runs of suffixes that share size - 1 words: what an interval of size words is widened to.
        block = max(r for r in shared if r <= size - 1)
        a, b = shared[block][order], shared[block][np.minimum(order + size - 1 - block, n - 1)]
        long_ = left[order] > size - 1
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ~long_[1:] | ~long_[:-1]
        run = np.cumsum(new) - 1
        edges = np.append(np.flatnonzero(new), n)
        self.run_lo, self.run_hi = edges[run], edges[run + 1]

    def code(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols, 0 for those that don't occur."""
        if not len(self.alphabet):
            return np.zeros(len(symbols), np.int64)
        i = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == symbols, i + 1, 0)

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol before them."""
        a, b = self.bwt.ranks(code, lo, hi)
        base = self.begin[code] - self.origin[code]
        return base + a, base + b

    def windows(self, symbols: np.ndarray, first: np.ndarray, size: int):
        """(place in ``symbols``, interval) of every window of ``size`` symbols of the streamed texts that occurs here.

        A lane per text goes from its end to its beginning. A symbol that doesn't extend the match ends all windows that
        hold both: the search starts anew one place before the match's end."""
        code = self.code(symbols)
        n = len(self.suffix)
        lanes = np.flatnonzero(np.diff(first) >= size)
        floor, end = first[lanes].astype(np.int64), first[lanes + 1].astype(np.int64)
        depth, lo, hi = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), np.full(len(lanes), n)
        places, los, his = [], [], []
        while len(end):
            at = end - depth - 1
            c = code[at]
            a, b = self.extend(c, lo, hi)
            fits = (c > 0) & (a < b)
            lo, hi = np.where(fits, a, 0), np.where(fits, b, n)
            # After a miss the search begins again without the last symbol.
            end = np.where(fits, end, end - 1)
            depth = np.where(fits, depth + 1, 0)
            full = depth == size
            if full.any():
                places.append(at[full])
                los.append(lo[full])
                his.append(hi[full])
                lo[full], hi[full] = self.run_lo[los[-1]], self.run_hi[los[-1]]
                end[full] -= 1
                depth[full] -= 1
            go = end - floor >= size
            if not go.all():
                floor, end, depth, lo, hi = floor[go], end[go], depth[go], lo[go], hi[go]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(places), cat(los), cat(his)


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each interval (none empty)."""
    edges = np.column_stack([lo, hi]).reshape(-1)
    return np.minimum.reduceat(np.append(values, values[-1]), edges)[::2] if len(lo) else np.zeros(0, values.dtype)


def _search(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin in a document with a smaller doc_id; passed on are windows of the smallest one."""
    removed = np.zeros(len(shard.window), bool)
    _, inverse, count = np.unique(shard.print_, return_inverse=True, return_counts=True)
    # Of equal contexts all but those of the smallest document go whole.
    whole = span_hashes(prefix_sums(shard.symbols), shard.first[:-1], shard.first[1:])
    order = np.lexsort((shard.doc_id, whole))
    head = np.ones(len(order), bool)
    head[1:] = whole[order][1:] != whole[order][:-1]
    least = shard.doc_id[order][head][np.cumsum(head) - 1]
    later = np.zeros(len(order), bool)
    later[order] = shard.doc_id[order] > least
    is_head = np.zeros(len(order), bool)
    is_head[order[head]] = True
    removed[later[shard.of]] = True
    some = np.zeros(len(shard.n), bool)
    some[shard.of[count[inverse] > 1]] = True
    some &= is_head
    chosen = np.flatnonzero(some)
    if len(chosen) > 1:
        part = shard.pick(chosen, SIZE)
        index = FMIndex(part.symbols, part.first, SIZE)
        place, lo, hi = index.windows(part.symbols, part.first, SIZE)
        # Documents in suffix order; an interval's least one decides.
        doc_of = np.repeat(part.doc_id, np.diff(part.first) + 1)[index.suffix]
        first_doc = np.full(len(part.symbols), np.iinfo(np.int64).max)
        u, back = np.unique(lo, return_inverse=True)
        top = np.zeros(len(u), np.int64)
        top[back] = hi
        first_doc[place] = least_in(doc_of, u, top)[back]
        own = np.isin(shard.of, chosen)
        removed[own] |= first_doc[part.window] < part.doc_id[part.of]
    # Equal contexts of the smallest document share the fate of their head.
    head_of = np.empty(len(order), np.int64)
    head_of[order] = order[head][np.cumsum(head) - 1]
    base = np.cumsum(shard.n) - shard.n
    removed |= removed[base[head_of[shard.of]] + np.arange(len(shard.of)) - base[shard.of]]
    return removed, ~removed


def _words(data: np.ndarray, offsets: np.ndarray):
    return word_hashes(data, offsets)


REPEATED_WORDS = Kind("fmindex", SIZE, GRAM, np.uint64, _words, _search, ordered=True)


def _strip(with_text: bool):
    def run(batches):
        for batch, data, offsets in text_slices(batches):
            starts, ends, first = words(data, offsets)
            masks = covered(batch.column(batch.schema.get_field_index("spans")), np.diff(first))
            raw = data.tobytes()
            n, removed, sha, kept = [], [], [], []
            for r, mask in enumerate(masks):
                a, b = starts[first[r]: first[r + 1]], ends[first[r]: first[r + 1]]
                n.append(len(a))
                removed.append(0 if mask is None else int(mask.sum()))
                if mask is not None:
                    a, b = a[~mask], b[~mask]
                text = b" ".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist())])
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n), pa.array(removed), pa.array(sha), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def remove_repeated_words(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of each row of ``docs`` (doc_id, text): each word is removed that lies
    in a window of ``SIZE`` words which also begins in a document with a smaller doc_id.

    Null texts have no words; shorter texts than ``SIZE`` words lose nothing. Rows with one doc_id are one document, so
    none of them is removed for another; a null doc_id neither loses nor takes. ``kept`` is the words joined by one blank
    (null unless ``with_text``). Words are compared by 64-bit fingerprints.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, REPEATED_WORDS)
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _strip(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op9_fm_index_dedup(spark, sf_dir):
    """Whole documents without windows of 50 words that an earlier one holds."""
    return remove_repeated_words(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
