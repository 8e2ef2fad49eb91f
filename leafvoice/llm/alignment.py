"""Alignment of two tokenizers' ids over the same bytes, in windows between white-space anchors.

Both tokenizers encode a text as a whole. A place where a token of each ends and the next one of each is marked with a
space is an *anchor*; so is the text's end. Anchors cut a text into windows, most of them a word, and what a window's
ids look like aligned depends on these ids alone: it is found once per pair of id tuples and remembered.

Inside a window the tokens are cut into *groups* wherever one of each ends; two tokens whose bytes overlap are a *link*.
How often the corpus links a pair of ids is counted in two levels. Texts are handled in *segments* of a few megabytes: one
row each, with the segment's different windows, their pairs of ids, and the windows of each text as numbers. Pairs are
summed over all segments, and the sums go back to the segments, not to the texts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.buffers import mix, prefix_sums, span_hashes, text_slices
from leafvoice.llm.tables import Steps, table
from leafvoice.llm.tokens import byte_letters

SEGMENT_BYTES = 1 << 20
#: Texts are cut into pieces of about this size before they are encoded, so many bytes of them at once.
PIECE_BYTES, ENCODED_BYTES = 128, 1 << 18
#: Window alignments kept by a worker before it starts anew, in two generations of some 300 bytes each.
CACHE_WINDOWS = 60_000
#: Windows put together at once for a digest.
WINDOWS = 1 << 18
# --- fixed value: how byte-level BPE files of this kind cut a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: An id pair as a number; ids of B are below this.
B_IDS = 1 << 32


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """Bytes of each id of a byte-level BPE file, and a function from a list of texts to their lists of ids; strings of
    special tokens are ordinary text.

    Where ids are numbered in the order of the merges, and texts are cut by the usual pattern only, merging by least id
    is the file's own rule; ``tiktoken`` does so several times faster."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = {c: b for b, c in byte_letters().items()}
    special = {t["id"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
    held = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and not spec["model"].get("ignore_merges") and merged == sorted(merged) and min(merged, default=256) >= 256 and len(merged) + 256 == len(held):
        import tiktoken

        ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={b: i for i, b in held.items()}, special_tokens={})
        encode = lambda texts: [ranked.encode_ordinary(t) for t in texts]
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        encode = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    return [held.get(i, b"") for i in range(max(held) + 1)], encode


class Encoder:
    """The two tokenizers: A, byte-level BPE (a JSON file), over space + text; B, pieces (a model file), over the text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a_bytes, self.a = byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # How an id is written: of A before another one of its group or before those of B, of B before another one or at the end.
        self.written = [str(i).encode() + mark for ids, marks in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for mark in marks for i in range(len(ids))]
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_spaced, self.b_spaced = (np.array([t[:1] == b" " for t in x]) for x in (self.a_bytes, self.b_bytes))

    def _checked(self, pieces: list[bytes], ids: list[list[int]], held: list[bytes], flat_bytes: np.ndarray, sizes: np.ndarray):
        """Ids one after the other, how many each piece has, and whether they give back its bytes."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        size = sizes[flat]
        same = _sums(size, n) == np.fromiter(map(len, pieces), np.int64, len(pieces))
        if same.all() and (gathered(flat_bytes, (np.cumsum(sizes) - sizes)[flat], size) == np.frombuffer(b"".join(pieces), np.uint8)).all():
            return flat, n, same
        return flat, n, np.array([b"".join([held[i] for i in x]) == p for p, x in zip(pieces, ids)], bool)

    def encode_pieces(self, pieces: list[bytes]):
        """Ids of A and of B, one piece after the other, how many of each a piece has, and whether both give back its bytes.
        Pieces begin with a space, which B adds by itself."""
        parts, at = [], 0
        while at < len(pieces):
            end, size = at + 1, len(pieces[at])
            while end < len(pieces) and size + len(pieces[end]) <= ENCODED_BYTES:
                size += len(pieces[end])
                end += 1
            some = pieces[at:end]
            texts = [x.decode() for x in some]
            a = self._checked(some, self.a(texts), self.a_bytes, self.a_flat, self.a_sizes)
            b = self._checked(some, self.b.encode([t[1:] for t in texts], num_threads=1), self.b_bytes, self.b_flat, self.b_sizes)
            parts.append((a[0], b[0], a[1], b[1], a[2] & b[2]))
            at = end
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int32, np.int32, np.int64, np.int64, bool)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of the texts, one after the other, and how many each text has: none if it is empty or if one of
        the tokenizers doesn't give back its bytes.

        Neither tokenizer has a token across a single space between ASCII letters. So texts are cut there every
        ``PIECE_BYTES`` or so: short pieces are encoded several times faster, and a long text needs no more memory."""
        raw = b"".join([b" " + t for t in texts])
        whole = np.frombuffer(raw, np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        letter = _LETTER[whole]
        at = np.flatnonzero((whole[1:-1] == 0x20) & letter[:-2] & letter[2:]) + 1
        cuts = np.union1d(begins, at[np.diff(at // PIECE_BYTES, prepend=-1) > 0])
        a, b, n_a, n_b, good = self.encode_pieces([raw[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        of = np.searchsorted(begins, cuts[:-1], "right") - 1
        held = (np.bincount(of, ~good, len(texts)) == 0) & (np.diff(begins) > 1)
        if not held.all():
            a, b = a[np.repeat(held[of], n_a)], b[np.repeat(held[of], n_b)]
        return a, b, *((np.bincount(of, n, len(texts)) * held).astype(np.int64) for n in (n_a, n_b))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` for each, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def kinds_of(spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One item of each kind, and the kind of each item; items are equal if all their spans (symbols, starts, ends) are.
    Fingerprints find equal ones, the symbols confirm it."""
    prints = np.uint64(0)
    for x, start, end in spans:
        prints = mix(prints + span_hashes(prefix_sums(x), start, end))
    _, first, kind = np.unique(prints, return_index=True, return_inverse=True)
    same = all(bool(((end - start) == (end - start)[first[kind]]).all()) for _, start, end in spans)
    if same and all(bool((gathered(x, start, end - start) == gathered(x, start[first[kind]], end - start)).all()) for x, start, end in spans):
        return first, kind
    seen, first, kind = {}, [], np.empty(len(spans[0][1]), np.int64)
    for i in range(len(kind)):
        k = kind[i] = seen.setdefault(tuple(x[start[i]: end[i]].tobytes() for x, start, end in spans), len(first))
        if k == len(first):
            first.append(i)
    return np.array(first, np.int64), kind


def align(e: Encoder, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For windows that follow each other: their groups as text, each group with a ``;`` behind, and their linked pairs of
    ids, 64 bits each. A pair is linked where both tokens hold the byte before one of their ends."""
    ends_a, ends_b = np.cumsum(e.a_sizes[a]), np.cumsum(e.b_sizes[b])
    ends = np.union1d(ends_a, ends_b)
    links = a[np.searchsorted(ends_a, ends)].astype(np.int64) * B_IDS + b[np.searchsorted(ends_b, ends)]
    upto = (np.searchsorted(ends, ends_a[to_a - 1]) + 1) * 8
    cuts = ends_b[np.isin(ends_b, ends_a, assume_unique=True)]
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    # A group's tokens of A come first, then those of B.
    n_a, n_b = len(e.a_bytes), len(e.b_bytes)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + n_a * np.append(group_a[1:] != group_a[:-1], True)
    out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * n_a + n_b * np.append(group_b[1:] != group_b[:-1], True)
    text = b"".join(map(e.written.__getitem__, out.tolist()))
    text_ends = np.cumsum(e.written_sizes[out])[to_a + to_b - 1]
    pieces = lambda raw, ends: [raw[x:y] for x, y in zip([0, *ends], ends)]
    return pieces(text, text_ends.tolist()), pieces(links.tobytes(), upto.tolist())


def anchors(e: Encoder, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After how many tokens of A and of B windows end, and after how many of A groups do. Verified: the bytes before are
    the same."""
    ends_a, ends_b = np.cumsum(e.a_sizes[a]), np.cumsum(e.b_sizes[b])
    i = np.searchsorted(ends_a, ends_b)
    j = np.flatnonzero(ends_a[i] == ends_b)
    i, j = i[j] + 1, j + 1
    anchor = np.ones(len(i), bool)
    anchor[:-1] = e.a_spaced[a[i[:-1]]] & e.b_spaced[b[j[:-1]]]
    return i[anchor], j[anchor], i


class Windows:
    """Alignments of windows by their id tuples, remembered by a worker in two generations."""

    def __init__(self, e: Encoder) -> None:
        self.e, self.young, self.old = e, {}, {}

    def get(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, wanted: np.ndarray, often: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Groups and links of the windows number ``wanted``. Those that aren't remembered are aligned in one go; what is not
        ``often`` there isn't asked for nor remembered."""
        begin_a, begin_b = (np.concatenate([[0], x[:-1]])[wanted] for x in (to_a, to_b))
        size_a, size_b = to_a[wanted] - begin_a, to_b[wanted] - begin_b
        out, known = [None] * len(wanted), np.flatnonzero(often)
        raw_a, raw_b = a.tobytes(), b.tobytes()
        spans = zip(*((x[known] * 4).tolist() for x in (begin_a, begin_a + size_a, begin_b, begin_b + size_b)))
        keys = {i: (raw_a[w:x], raw_b[y:z]) for i, (w, x, y, z) in zip(known.tolist(), spans)}
        for i, key in keys.items():
            out[i] = self.young.get(key) or self.old.get(key)
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            at = np.array(new)
            size_a, size_b = size_a[at], size_b[at]
            for i, x in zip(new, zip(*align(self.e, gathered(a, begin_a[at], size_a), gathered(b, begin_b[at], size_b), np.cumsum(size_a), np.cumsum(size_b)))):
                out[i] = x
            if len(self.young) >= CACHE_WINDOWS:
                self.old, self.young = self.young, {}
            self.young.update([(keys[i], out[i]) for i in new if i in keys][:CACHE_WINDOWS])
        return out


def squeeze(x: np.ndarray) -> bytes:
    """Numbers below 2^32, one byte plane after the other, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_TEXTS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
_SEGMENT_TYPES = pa.schema([("segment", pa.string()), *((n, pa.list_(t)) for n, t in _TEXTS),
                            ("sizes", pa.binary()), ("windows", pa.binary()), ("link_counts", pa.binary()), ("links", pa.binary()),
                            ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])
_SEGMENTS = ("segment string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
             "sizes binary, windows binary, link_counts binary, links binary, a array<long>, b array<long>, often array<long>")


def _segment(e: Encoder, memo: Windows, texts: list[bytes]) -> list:
    """What a segment's row holds of its texts, see ``align_segments``."""
    a, b, n_a, n_b = e.encode(texts)
    good = n_a > 0
    n_groups, sizes, sha = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
    if not len(a):
        none = np.zeros(0, np.int64)
        return [n_a, n_b, n_groups, sha, sizes, none, none, none, none, none, none]
    # One text follows the other; each begins with a space, so that its beginning is an anchor, too.
    to_a, to_b, shared = anchors(e, a, b)
    first, kind = kinds_of([(x, np.concatenate([[0], to[:-1]]), to) for x, to in ((a, to_a), (b, to_b))])
    kinds = memo.get(a, b, to_a, to_b, first, np.bincount(kind) > 1)
    ends = np.cumsum(n_a[good])
    upto = np.searchsorted(to_a, ends) + 1
    sizes[good] = np.diff(upto, prepend=0)
    n_groups[good] = np.diff(np.searchsorted(shared, ends) + 1, prepend=0)
    groups, at = [k[0] for k in kinds], 0
    for r, end in zip(np.flatnonzero(good).tolist(), upto.tolist()):
        digest = hashlib.sha256()
        for c in range(at, end, WINDOWS):
            text = b"".join([groups[k] for k in kind[c: min(c + WINDOWS, end)].tolist()])
            digest.update(text if c + WINDOWS < end else text[:-1])
        sha[r], at = digest.hexdigest(), end
    counts = np.array([len(k[1]) // 8 for k in kinds], np.int64)
    pairs, links = np.unique(np.frombuffer(b"".join([k[1] for k in kinds]), np.int64), return_inverse=True)
    often = np.bincount(links, np.repeat(np.bincount(kind, minlength=len(kinds)), counts), len(pairs)).astype(np.int64)
    return [n_a, n_b, n_groups, sha, sizes, kind, counts, links, pairs // B_IDS, pairs % B_IDS, often]


def _aligned(paths: tuple[str, str]):
    """One row per segment: its texts' figures, how many windows each has, their kinds, each kind's links as numbers of
    pairs, and the pairs with how often the segment links them."""
    def run(batches):
        from pyspark import TaskContext

        e = Encoder(*paths)
        memo, task, number = Windows(e), TaskContext.get().partitionId(), 0
        for batch, data, offsets in text_slices(batches, most=SEGMENT_BYTES):
            raw = data.tobytes()
            found = _segment(e, memo, [raw[offsets[r]: offsets[r + 1]] for r in range(batch.num_rows)])
            found[4:8] = map(squeeze, found[4:8])
            row = [f"{task}-{number}", batch.column(0).cast(pa.int64()).to_pylist(), *found]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT_TYPES.types)], schema=_SEGMENT_TYPES)
    return run


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``sizes`` values."""
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _judged(batches):
    """Rows of a segment and, in the order of its pairs, how often the corpus links each and whether that is its B id's most."""
    for batch in batches:
        for s in range(batch.num_rows):
            doc_id, n_a, n_b, n_groups, sha = (batch.column(c)[s].values for c in range(5))
            sizes, windows, counts, links = (unsqueeze(batch.column(c)[s].as_py()).astype(np.int64) for c in range(5, 9))
            number, often, best = (np.asarray(batch.column(9)[s].values.field(f)) if batch.column(9)[s].is_valid else np.zeros(0, np.int64) for f in range(3))
            figures = np.zeros((3, len(number)), np.int64)
            figures[:, number] = np.ones(len(number), np.int64), best, often
            of_windows = [_sums(f[links], counts)[windows] for f in figures]
            yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, *(pa.array(_sums(x, sizes)) for x in of_windows), sha],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_segments(docs: DataFrame, a_path: str, b_path: str, steps: Steps) -> DataFrame:
    """The segments of ``docs`` (doc_id, text), written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return steps.keep(docs.mapInArrow(_aligned((a_path, b_path)), _SEGMENTS), "segments")


def pair_counts(segments: DataFrame) -> DataFrame:
    """``a, b, n, best``: how often each pair of ids is linked, and whether no other A id is linked with ``b`` more often."""
    pairs = segments.select(F.inline(F.arrays_zip("a", "b", "often"))).groupBy("a", "b").agg(F.sum("often").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    # One row per id of B.
    return pairs.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens, nor have texts of which either tokenizer doesn't give back all bytes: zeros and ''.
    A repeated row counts and is returned each time. A very long text is a segment of its own, encoded in pieces.
    """
    steps = Steps(docs.sparkSession, "alignment")
    segments = align_segments(docs, a_path, b_path, steps)
    counts = steps.keep(pair_counts(segments), "pairs")
    own = segments.select("segment", F.posexplode(F.arrays_zip("a", "b")).alias("number", "pair")).select("segment", "number", "pair.a", "pair.b")
    figures = own.join(counts, ["a", "b"]).groupBy("segment").agg(F.collect_list(F.struct(F.col("number").cast("long"), "n", "best")).alias("figures"))
    joined = segments.drop("a", "b", "often").join(figures, "segment", "left").drop("segment")
    return joined.mapInArrow(_judged, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _triples(batches, paths: tuple[str, str]):
    e = Encoder(*paths)
    for batch, data, offsets in text_slices(batches, most=SEGMENT_BYTES):
        raw, out = data.tobytes(), []
        a, b, n_a, n_b = e.encode([raw[offsets[r]: offsets[r + 1]] for r in range(batch.num_rows)])
        for own_a, own_b in zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])):
            to_a, to_b, _ = anchors(e, own_a, own_b) if len(own_a) else (own_a,) * 3
            out.append((own_a, own_b, [{"a": x, "b": y} for x, y in zip(to_a.tolist(), to_b.tolist())]))
        types = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))],
                                         names=["doc_id", "a_ids", "b_ids", "windows"])


def token_windows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, windows`` of each row of ``docs``: both encodings, and after how many ids of each a window ends."""
    paths = a_path, b_path
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: _triples(batches, paths), "doc_id long, a_ids array<int>, b_ids array<int>, windows array<struct<a: int, b: int>>")


def op11_token_alignment(spark, sf_dir):
    """All documents in byte-level BPE and in pieces."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
