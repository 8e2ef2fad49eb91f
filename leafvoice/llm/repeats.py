"""Windows of a fixed number of symbols that occur more than once in a corpus: what the two substring operators share.

A text is a sequence of symbols (bytes or word fingerprints). Each window of ``size`` symbols has an anchor: the ``gram``
symbols in it with the least fingerprint, the first of them on a tie. Equal windows have equal anchors at equal places, so:

1. anchors are counted over the corpus (summed up before the exchange); windows of single anchors can't repeat;
2. each repeated anchor brings its windows, as one short context, to one shard. An anchor with more than ``HELD``
   contexts is dealt over several shards by row, so no shard holds a hot passage;
3. each shard finds its repeated windows by the operator's own method;
4. shards of one anchor exchange fingerprints of their windows, one per different window.

Rows are known by a fingerprint of doc_id and text; equal rows are equal throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.buffers import prefix_sums, span_hashes, text_slices
from leafvoice.llm.tables import Steps

_U = np.uint64
HELD = 96
#: A task works on so many symbols of contexts at once, and one shard more at most.
BATCH_SYMBOLS = 1_500_000
_PLACE = 32


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and how a shard is searched. ``read`` turns bytes and offsets into symbols and the rows' first ones;
    ``search`` gets a ``Shard`` and tells for each window whether it is removed and whether it is passed on."""

    name: str
    size: int
    gram: int
    dtype: type
    read: Callable
    search: Callable
    #: Whether windows are compared with those of smaller doc_id only.
    ordered: bool


def anchors(symbols: np.ndarray, first: np.ndarray, kind: Kind):
    """Fingerprint of each anchor, its row, first window (from 0 in the slice) and number of windows; the prefix sums."""
    sums = prefix_sums(symbols)
    n, gram = len(symbols), kind.gram
    none = np.zeros(0, np.int64)
    length = np.diff(first)
    if not (length >= kind.size).any():
        return np.zeros(0, _U), none, none, none, sums
    at = np.arange(n - gram + 1)
    g = span_hashes(sums, at, at + gram)
    packed = (g >> _U(_PLACE) << _U(_PLACE)) | at.astype(_U)
    span, reach = kind.size - gram + 1, 1
    low = packed
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    # Windows that lie in one row.
    n_windows = np.maximum(length - kind.size + 1, 0)
    row = np.repeat(np.arange(len(length)), n_windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[row]
    place = (low[start] & _U((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return g[place[head]], row[head], start[head], np.diff(np.append(head, len(place))), sums


def _anchor_rows(kind: Kind):
    def run(batches):
        for batch, data, offsets in text_slices(batches):
            symbols, first = kind.read(data, offsets)
            a, row, *_ = anchors(symbols, first, kind)
            keys = np.asarray(batch.column(batch.schema.get_field_index("row")))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(keys[row])], names=["anchor", "row"])
    return run


def _contexts(kind: Kind):
    """Contexts of the anchors named in ``wanted`` (anchor, parts)."""
    def run(batches):
        for batch, data, offsets in text_slices(batches):
            symbols, first = kind.read(data, offsets)
            a, row, start, n, _ = anchors(symbols, first, kind)
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            flat = wanted.flatten()
            names, parts = np.asarray(flat.field(0)).view(_U), np.asarray(flat.field(1))
            ends = np.cumsum(np.asarray(wanted.value_lengths()))
            # Look each anchor up among those of its own row.
            order = np.lexsort((names, np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))))
            names, parts = names[order], parts[order]
            lo = np.concatenate([[0], ends[:-1]])
            at, ok = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
            edges = np.searchsorted(row, np.arange(len(ends) + 1))
            for r in range(len(ends)):
                x, y = edges[r], edges[r + 1]
                if x < y and lo[r] < ends[r]:
                    i = np.minimum(np.searchsorted(names[lo[r]: ends[r]], a[x:y]), ends[r] - lo[r] - 1) + lo[r]
                    at[x:y], ok[x:y] = i, names[i] == a[x:y]
            pick = np.flatnonzero(ok)
            if not len(pick):
                continue
            raw, width = symbols.astype(kind.dtype).tobytes(), np.dtype(kind.dtype).itemsize
            keys, docs = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id"))
            keys = np.asarray(keys)[row[pick]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[pick].view(np.int64)), pa.array((keys.view(_U) % parts[at[pick]].astype(_U)).astype(np.int64)), pa.array(parts[at[pick]]), docs.take(pa.array(row[pick])),
                 pa.array(keys), pa.array(start[pick] - first[row[pick]]), pa.array(n[pick]),
                 pa.array([raw[s * width: (s + c + kind.size - 1) * width] for s, c in zip(start[pick], n[pick])], pa.binary())],
                names=["anchor", "part", "parts", "doc_id", "row", "start", "n", "context"])
    return run


_CONTEXT = "anchor long, part long, parts long, doc_id long, row long, start long, n long, context binary"


@dataclass
class Shard:
    """Contexts as one sequence, each followed by nothing: ``first`` says where they begin. ``n``: windows of each; ``window``:
    place of each window in ``symbols``; ``of``: its context; ``print_``: its fingerprint."""

    symbols: np.ndarray
    first: np.ndarray
    n: np.ndarray
    doc_id: np.ndarray
    window: np.ndarray
    of: np.ndarray
    print_: np.ndarray

    def pick(self, contexts: np.ndarray, size: int) -> Shard:
        """The same for some contexts only (ascending)."""
        length = np.diff(self.first)[contexts]
        at = np.concatenate([[0], np.cumsum(length)])
        symbols = self.symbols[np.repeat(self.first[contexts] - at[:-1], length) + np.arange(at[-1])]
        keep = np.isin(self.of, contexts)
        n = self.n[contexts]
        of = np.repeat(np.arange(len(n)), n)
        return Shard(symbols, at, n, self.doc_id[contexts], at[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of, self.print_[keep])


def _shard(batch: pa.RecordBatch, kind: Kind) -> Shard:
    col = batch.column(batch.schema.get_field_index("context")).cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset: col.offset + len(col) + 1]
    symbols = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]].view(kind.dtype)
    first = (offsets - offsets[0]) // np.dtype(kind.dtype).itemsize
    n = np.asarray(batch.column(batch.schema.get_field_index("n")))
    of = np.repeat(np.arange(len(n)), n)
    window = first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    sums = prefix_sums(symbols)
    docs = np.asarray(batch.column(batch.schema.get_field_index("doc_id")).fill_null(np.iinfo(np.int64).max))
    return Shard(symbols, first, n, docs, window, of, span_hashes(sums, window, window + kind.size))


def _groups(batches, limit: int, width: int):
    """Batches that end where a shard ends, of about ``limit`` symbols."""
    held, size = [], 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, p = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        lengths = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index("n")))) * width
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
        new[0] = last is not None and (a[0], p[0]) != last
        last = (a[-1], p[-1])
        at, done = 0, 0
        for e in np.flatnonzero(new).tolist():
            if size + lengths[e - 1] * (e > 0) - done >= limit and (held or e > at):
                if e > at:
                    held.append(batch.slice(at, e - at))
                yield _joined(held)
                held, size, at, done = [], 0, e, int(lengths[e - 1]) if e else 0
        held.append(batch.slice(at))
        size += int(lengths[-1]) - done
    if held:
        yield _joined(held)


def _joined(batches: list) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _search(kind: Kind):
    def run(batches):
        for batch in _groups(batches, BATCH_SYMBOLS, 4):
            shard = _shard(batch, kind)
            removed, passed = kind.search(shard)
            rows = np.asarray(batch.column(batch.schema.get_field_index("row")))
            starts = np.asarray(batch.column(batch.schema.get_field_index("start")))
            parts = np.asarray(batch.column(batch.schema.get_field_index("parts")))
            place = starts[shard.of] + shard.window - shard.first[shard.of]
            # Runs end at a context's end, too.
            begin = removed & np.append(True, ~removed[:-1] | (shard.of[1:] != shard.of[:-1]))
            b = np.flatnonzero(begin)
            run_of = np.cumsum(begin) - 1
            size = np.bincount(run_of[removed], minlength=len(b)) if len(b) else np.zeros(0, np.int64)
            more = np.flatnonzero(passed & (parts[shard.of] > 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rows[shard.of[b]], rows[shard.of[more]]])), pa.array(np.concatenate([place[b], place[more]])),
                 pa.array(np.concatenate([size + kind.size - 1, np.full(len(more), kind.size)])),
                 pa.array(np.concatenate([np.zeros(len(b), _U), shard.print_[more]]).view(np.int64), mask=np.arange(len(b) + len(more)) < len(b)),
                 pa.array(np.concatenate([np.zeros(len(b), np.int64), shard.doc_id[shard.of[more]]])),
                 pa.array(np.concatenate([np.ones(len(b), bool), removed[more]]))],
                names=["row", "start", "length", "print", "doc_id", "removed"])
    return run


_FOUND = "row long, start long, length long, print long, doc_id long, removed boolean"


def keyed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: the row's fingerprint, and null texts as empty ones."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def repeated_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """``row, spans`` (start, length in symbols, may overlap) of the rows of ``docs`` (row, doc_id, text) that have windows to
    remove."""
    steps = Steps(docs.sparkSession, kind.name)
    eligible = docs.where("doc_id is not null") if kind.ordered else docs
    found = steps.keep(eligible.select("row", "text").mapInArrow(_anchor_rows(kind), "anchor long, row long"), "anchors")
    often = F.min("row") != F.max("row") if kind.ordered else F.count("*") > 1
    repeated = steps.keep(
        found.groupBy("anchor").agg(F.count("*").alias("n"), often.alias("often")).where("often")
        .select("anchor", F.ceil(F.col("n") / HELD).alias("parts")), "repeated")
    wanted = steps.keep(
        found.join(repeated, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "parts")).alias("wanted")), "wanted")
    steps.free(found, repeated)
    shards = (eligible.join(wanted, "row").mapInArrow(_contexts(kind), _CONTEXT)
              .repartition("anchor", "part").sortWithinPartitions("anchor", "part"))
    spans = steps.keep(shards.mapInArrow(_search(kind), _FOUND), "found")
    steps.free(wanted)
    passed = spans.where("print is not null")
    prints = steps.keep(
        passed.groupBy(F.col("print").alias("p")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "prints")
    late = F.col("doc_id") > F.col("least") if kind.ordered else F.lit(True)
    more = passed.where("not removed").join(prints, F.col("print") == F.col("p")).where(late).select("row", "start", "length")
    every = spans.where("print is null").select("row", "start", "length").union(more)
    return steps.keep(every.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")


def covered(spans: pa.ListArray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each row which of its symbols lie in a span, as a mask; None if there are no spans."""
    out = []
    for r, size in enumerate(sizes):
        s = spans[r].values if spans[r].is_valid else None
        if s is None or not len(s):
            out.append(None)
            continue
        start, length = np.asarray(s.field(0)), np.asarray(s.field(1))
        edge = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(start + length, minlength=size + 1)[: size + 1]
        out.append(np.cumsum(edge)[:size] > 0)
    return out
