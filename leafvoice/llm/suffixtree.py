"""Language-model scores with a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words before a token. A context is a candidate if it occurs ``LEAST_COUNT`` times; it
is kept if its next-word distribution diverges from that of its parent, the context without its first word, or if a
longer kept one needs it. Distributions are smoothed towards the parent's, and a token is scored in the state of the
longest kept suffix.

Every word is a symbol of its own, and so is the end of a text. Words that were never seen are one symbol, with the share
that words seen once suggest.

Smoothing takes one from each count and gives what it took to the parent: a state c with n occurrences and k different next
words gives p(x | c) = (max(n(c, x) - 1, 0) + k p(x | parent)) / n. So next words that followed once have no rows of their
own; how many there are is all that counts.

Contexts and their next words are tables keyed by 64-bit fingerprints, and grow with the corpus. A token's score
is a sum: log p(x), and for each kept suffix c the log of k / n, and for each (c, x) that was seen twice what the ratio of
p(x | c) to p(x | parent) is above that. These summands are what the tables hold; a text's are found by one join.

What is one row per token or so is exchanged as blocks: a task's rows for one part of the fingerprints are a row of byte
strings. The number of parts follows the corpus, so a part's blocks fit a task's memory. The summands are one table in
buckets of these parts, so that only the texts' keys are exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.buffers import mix, rows_of, text_slices, word_hashes
from leafvoice.llm.tables import Steps, fold_of, table

DEPTH = 3
#: Occurrences that make a context a candidate, in a corpus of any size.
LEAST_COUNT = 32
#: Bits by which the next symbol of a state must diverge from its parent's.
LEAST_DIVERGENCE = 0.02
#: Words of at least this share of all tokens are looked up where the text is: at most 1 / COMMON_SHARE of them (8 MB).
COMMON_SHARE = 2e-6
#: The same for contexts and for contexts with a next word, of each length (at most 8 MB each); all others by the join.
COMMON_CONTEXT_SHARE = 2e-6
#: Bits of the filter that says of most contexts that they are none of a table's. What passes it is decided by the table.
FILTER_BITS = 1 << 25
#: Documents are scored in so many parts, one after the other, so that their keys take less disk.
PARTS = 6
SLICE = 2 << 20
#: Tokens and bytes of text per part of the fingerprints, by which pairs are counted and keys are looked up.
PART_TOKENS, PART_BYTES = 500_000, 4_000_000
#: The next words of a context that occurs so often are dealt over the parts.
HOT_CONTEXT = 50_000
_U = np.uint64
#: As words: the end of a text (which stands before a text, too), any word, and words that followed once.
_END, _ANY, _ONCE = (int(mix(np.array([x], _U)).view(np.int64)[0]) for x in (0x656E64, 0x616E79, 0x6F6E6365))


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = x * p2
    h = (h + (p5 + _U(8))) ^ (((x << _U(31)) | (x >> _U(33))) * p1)
    h = ((h << _U(27)) | (h >> _U(37))) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


def pair_hash(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """F.xxhash64(c, x): fingerprint of a context with its next word, which is the longer context's."""
    return _step(_step(np.full(len(c), 42, _U), c), x)


@dataclass
class Vocabulary:
    """Common words (sorted) with counts; totals over the corpus; ``unseen``: the share of words that were never seen."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    ends: int
    unseen: float


def lookup(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there. Keys in order walk through the memory once."""
    if not len(sorted_) or not len(keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order = np.argsort(keys)
    i = np.empty(len(keys), np.int64)
    i[order] = np.minimum(np.searchsorted(sorted_, keys[order]), len(sorted_) - 1)
    return i, sorted_[i] == keys


def symbols_of(data: np.ndarray, offsets: np.ndarray):
    """Each row's words and its end, rows' offsets, the words alone, and the rows' first ones."""
    h, first = word_hashes(data, offsets, lower=True)
    at = first + np.arange(len(first))
    out = np.full(at[-1], _END, np.int64).view(_U)
    word = np.ones(at[-1], bool)
    word[at[1:] - 1] = False
    out[word] = h
    return out, at, h, first


def _shifted(s: np.ndarray, at: np.ndarray, fill) -> np.ndarray:
    """What stands one place before; ``fill`` at the rows' beginnings."""
    out = np.empty_like(s)
    out[1:] = s[:-1]
    out[at[:-1]] = fill
    return out


def context_ids(s: np.ndarray, at: np.ndarray, depth: int):
    """For each length 1, 2, ... the context that stands before each token, and whether there is one. Before a text stands
    an end."""
    before = _shifted(s, at, np.int64(_END).view(_U))
    ids, there = before, np.ones(len(s), bool)
    for k in range(depth):
        if k:
            ids, there = pair_hash(_shifted(ids, at, _U(0)), before), _shifted(there, at, False)
        yield ids, there


def make_filter(contexts: DataFrame) -> np.ndarray:
    """Bits of ``contexts`` (c); its size does not depend on the table's."""
    place = F.col("c").bitwiseAND(FILTER_BITS - 1)
    rows = contexts.select(F.shiftright(place, 6).alias("block"), F.expr("shiftleft(1L, cast(c & 63 as int))").alias("bit")) \
        .groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return out.view(_U)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (bits[(ids & _U(FILTER_BITS - 1)) >> _U(6)] >> (ids & _U(63))) & _U(1) > 0


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of fingerprints, in their order; ``_spark_part_of`` in numpy."""
    return ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _spark_part_of(key: Column, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(parts).cast("long"), 32)


def _borders(part: np.ndarray) -> np.ndarray:
    """Where each part begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))


def packed(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Byte strings of the values from one of ``begin`` to the next."""
    offsets = (begin * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all byte strings of a column, and how many each row has."""
    rows = [np.frombuffer(b, dtype) for b in column.to_pylist() if b is not None]
    return (np.concatenate(rows) if rows else np.zeros(0, dtype)), np.array([len(r) for r in rows], np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where each different one begins in it."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the values from each beginning to the next."""
    return np.add.reduceat(values, begin) if len(begin) else values[:0]


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if values.max(initial=0) < 1 << 16 else np.uint32)


def widened(column, sizes: np.ndarray) -> np.ndarray:
    """The values of byte strings that were made narrow, each by its own width; ``sizes``: how many each has."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, f"u{len(b) // k}").astype(np.int64) for b, k in zip(column.to_pylist(), sizes) if k)])


def _merged_pairs(c: np.ndarray, x: np.ndarray, often: np.ndarray):
    order, begin = runs(pair_hash(c, x))
    first = order[begin]
    return c[first], x[first], sums(often.astype(np.int64)[order], begin)


def _pair_counts(shared, length: int, parts: int):
    """Blocks of (context, next, count) over a task's texts of the contexts that pass the filter, summed up as far as memory
    allows. What follows the parent once in the corpus, by the second filter, is only counted. A context's rows are for one part,
    a hot one's are dealt by the next words."""
    def run(batches):
        bits, repeated, hot, *common = shared.value
        common = common[0] if common else np.zeros(0, _U)
        held, n = [], 0

        def merged():
            return _merged_pairs(*(np.concatenate([h[k] for h in held]) for k in range(3)))

        def out(rows):
            c, x, often = rows
            # Equal contexts in a row are sent once.
            order = np.argsort(c)
            c, x, often = c[order], x[order], often[order]
            own = mix(c)
            dealt = lookup(hot, c)[1]
            own[dealt] = mix(pair_hash(c[dealt], x[dealt]))
            part = part_of(own, parts)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            c, x, often, part = c[order], x[order], often[order], part[order]
            begin = _borders(part)
            first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (part[1:] != part[:-1])))
            i, there = lookup(common, x)
            rare = np.flatnonzero(~there)
            of_c = np.searchsorted(first, begin)
            return pa.RecordBatch.from_arrays(
                [pa.array(part[begin[:-1]]), pa.array(np.diff(begin)), packed(c[first], of_c), packed(narrow(np.diff(np.append(first, len(c)))), of_c),
                 packed(narrow(np.where(there, i, len(common))), begin), packed(x[rare], np.searchsorted(rare, begin)), packed(narrow(often), begin)],
                names=["part", "size", "c", "repeats", "x", "rare", "n"])

        for _, data, offsets in text_slices(batches, most=SLICE):
            s, at, *_ = symbols_of(data, offsets)
            *above, (ids, ok) = context_ids(s, at, length)
            ok = np.flatnonzero(ok & passes(bits, ids))
            x = s[ok]
            of_parent = pair_hash(above[-1][0][ok], x) if above else x
            held.append((ids[ok], np.where(passes(repeated, of_parent), x, np.int64(_ONCE).view(_U)), np.ones(len(ok), np.int64)))
            n += len(held[-1][0])
            if n > 1_000_000:
                held = [merged()]
                n = len(held[0][0])
                if n > 700_000:
                    yield out(held[0])
                    held, n = [], 0
        if n:
            yield out(merged())
    return run


def _repeated_pairs(blocks: pa.Table, common: np.ndarray = np.zeros(0, _U)) -> pa.Table:
    """A part's pairs that were seen twice; and for each context (x null) how often it was followed, and by how many words.
    Next words are places in ``common``; a place past its end stands for the next one of the rare."""
    sizes = blocks["size"].to_numpy()
    c, contexts = unpacked(blocks["c"], _U)
    place = widened(blocks["x"], sizes)
    x, there = np.empty(len(place), _U), place < len(common)
    x[there], x[~there] = common[place[there]], unpacked(blocks["rare"], _U)[0]
    c, x, n = _merged_pairs(np.repeat(c, widened(blocks["repeats"], contexts)), x, widened(blocks["n"], sizes))
    twice = (n > 1) & (x != np.int64(_ONCE).view(_U))
    order, begin = runs(c)
    own, total, kinds = c[order[begin]], sums(n[order], begin), sums(np.where(twice, 1, n)[order], begin)
    c, x, n = c[twice], x[twice], n[twice]
    null = lambda size: pa.nulls(size, pa.int64())
    return pa.table({
        "c": np.concatenate([c, own]).view(np.int64), "x": pa.chunked_array([pa.array(x.view(np.int64)), null(len(own))]),
        "n": np.concatenate([n, total]), "kinds": pa.chunked_array([null(len(c)), pa.array(kinds)])})


def _part(df: DataFrame, by: Column, part: int, parts: int) -> DataFrame:
    return df.where(F.pmod(by, F.lit(parts)) == part)


@dataclass
class SuffixTree:
    """``summands`` (key, value, n): of contexts with any word, and of contexts with a next word that was seen twice, per length;
    ``filters`` of the kept contexts and of these pairs, per length; keys (sorted) and values of the common ones."""

    summands: list[DataFrame]
    filters: list[tuple[np.ndarray, np.ndarray]]
    keys: np.ndarray
    values: np.ndarray


def _count_pairs(docs: DataFrame, contexts: DataFrame, repeated: np.ndarray, common: np.ndarray, length: int, parts: int, steps: Steps) -> DataFrame:
    """``c, x, n`` of what followed a context twice or more; x null: ``n`` words of so many ``kinds`` followed it in one part.
    ``common`` (sorted) are the words that are exchanged as their places there."""
    hot = np.sort(np.asarray(contexts.where(F.col("often") >= HOT_CONTEXT).select("c").toArrow().column(0)).view(_U))
    shared = docs.sparkSession.sparkContext.broadcast((make_filter(contexts), repeated, hot, common))
    blocks = docs.select("text").mapInArrow(_pair_counts(shared, length, parts), "part long, size long, c binary, repeats binary, x binary, rare binary, n binary")
    repeated_pairs = lambda rows: _repeated_pairs(rows, shared.value[3])
    out = steps.keep(blocks.groupBy("part").applyInArrow(repeated_pairs, "c long, x long, n long, kinds long"), "pairs")
    shared.destroy()
    return out


def grow(docs: DataFrame, v: Vocabulary, counts: DataFrame, steps: Steps, depth: int = DEPTH) -> SuffixTree:
    """One pass over all texts per length, as long as there are candidates. ``counts``: word, n of all of ``docs``."""
    spark = docs.sparkSession
    n_all = float(max(1, v.tokens))
    end = spark.range(1 if v.ends else 0).select(F.lit(_END).alias("word"), F.lit(v.ends).cast("long").alias("n"))
    words = counts.select("word", "n").union(end)
    above = words.where("n > 1").select(F.col("word").alias("up"), (F.col("n") * ((1 - v.unseen) / n_all)).alias("q"))
    contexts = steps.keep(words.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("c"), F.lit(None).cast("long").alias("parent"), F.col("n").alias("often")), "contexts")
    parts = 1 + v.tokens // PART_TOKENS
    common_words = np.sort(np.append(v.words, np.array([_END, _ONCE], np.int64).view(_U)))
    levels = []
    for length in range(1, depth + 1):
        if contexts.limit(1).isEmpty():
            break
        pairs = _count_pairs(docs, contexts, make_filter(above.select(F.col("up").alias("c"))), common_words, length, parts, steps)
        stats = pairs.where("x is null").groupBy("c").agg(F.sum("n").alias("total"), F.sum("kinds").alias("kinds"))
        facts = steps.keep(contexts.drop("often").join(stats, "c"), "facts")
        up = F.col("x") if length == 1 else F.xxhash64("parent", "x")
        known = pairs.where("x is not null").drop("kinds").join(facts, "c").select(
            "c", F.xxhash64("c", "x").alias("key"), up.alias("up"), "n", "total", "kinds", (F.col("x") == _END).alias("last"))
        # What follows a context twice has followed its parent twice, too.
        p = (F.col("n") - 1 + F.col("kinds") * F.col("q")) / F.col("total")
        level = steps.keep(known.join(above, "up").select("c", "key", "up", "n", "q", p.alias("p"), "last"), "level")
        steps.free(pairs, contexts)
        # All other words have k / n of what the parent gives them.
        share = F.col("kinds") / F.col("total")
        sums = level.groupBy("c").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("seen"), F.sum("q").alias("q"))
        diverges = F.col("seen") + share * F.greatest(1 - F.col("q"), F.lit(0.0)) * F.log2(share) >= LEAST_DIVERGENCE
        judged = steps.keep(facts.join(sums, "c").select("c", "parent", "total", F.log10(share).alias("alone"), diverges.alias("kept")), "judged")
        steps.free(facts)
        levels.append((level, judged))
        above = level.select(F.col("key").alias("up"), F.col("p").alias("q"))
        # w1 .. wk x is as frequent as x after w1 .. wk; its parent leaves out w1.
        longer = level.where((F.col("n") >= LEAST_COUNT) & ~F.col("last")).select(F.col("key").alias("c"), F.col("up").alias("parent"), F.col("n").alias("often"))
        contexts = steps.keep(longer, "contexts")
    summands, filters, needed = [], [], None
    for level, judged in reversed(levels):
        kept = judged.where("kept")
        if needed is not None:
            kept = judged.join(needed.withColumn("needed", F.lit(True)), "c", "left").where("kept or needed")
        kept = steps.keep(kept.select("c", "parent", "total", "alone"), "kept")
        needed = kept.select(F.col("parent").alias("c")).where("c is not null").distinct()
        alone = kept.select(F.xxhash64("c", F.lit(_ANY)).alias("key"), F.col("alone").alias("value"), F.col("total").alias("n"), F.lit(False).alias("pair"))
        gains = level.select("c", "key", "n", F.log10(F.col("p") / F.col("q")).alias("gain"))
        seen = gains.join(kept.select("c", "alone"), "c").select("key", (F.col("gain") - F.col("alone")).alias("value"), "n", F.lit(True).alias("pair"))
        own = steps.keep(alone.union(seen), "summands")
        steps.free(level, judged)
        filters.append((make_filter(kept), make_filter(own.where("pair").select(F.col("key").alias("c")))))
        summands.append(own)
    common = [d.where(F.col("n") >= max(1.0, COMMON_CONTEXT_SHARE * v.tokens)).select("key", "value").toArrow() for d in summands]
    keys = np.concatenate([np.zeros(0, np.int64), *(np.asarray(c.column(0)) for c in common)]).view(_U)
    values = np.concatenate([np.zeros(0), *(np.asarray(c.column(1)) for c in common)])
    order = np.argsort(keys)
    return SuffixTree(summands, filters[::-1], keys[order], values[order])


def _word_counts(batches):
    """(word, count) over a task's texts, summed up as far as memory allows."""
    held, n = [], 0

    def merged():
        k, inv = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return k, np.bincount(inv, np.concatenate([h[1] for h in held]), len(k)).astype(np.int64)

    def out(pair):
        return pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1])], names=["word", "n"])

    for _, data, offsets in text_slices(batches, most=SLICE):
        held.append(np.unique(word_hashes(data, offsets, lower=True)[0], return_counts=True))
        n += len(held[-1][0])
        if n > 1_000_000:
            held = [merged()]
            n = len(held[0][0])
            if n > 1_000_000:
                yield out(held[0])
                held, n = [], 0
    if held:
        yield out(merged())


def _counted(rows: np.ndarray, keys: np.ndarray):
    """The different pairs of row and key with how often each occurs; keys are and stay in order."""
    # Rows ascend among equal keys.
    same = keys[1:] == keys[:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same)[: len(keys)]) if len(keys) else np.zeros(0, np.int64)
    rows[at] = rows[at][np.lexsort((rows[at], keys[at]))]
    start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)])
    return rows[start], keys[start], np.diff(np.append(start, len(keys)))


def _scored(shared, parts: int):
    """Blocks of a slice's keys: of each other than common word and context, alone and with its next word, the row and how often
    it occurs there. One more block holds the rows themselves: doc_id and whether there is one, tokens; of common words: how
    many, sum of log10(c + 1) and of log10 c; the common summands of the tree."""
    def run(batches):
        v, filters, tree_keys, tree_values = shared.value
        logs, plain = np.log10(v.counts + 1.0), np.log10(np.maximum(v.counts, 1))
        task = TaskContext.get().partitionId() << 32
        for number, (batch, data, offsets) in enumerate(text_slices(batches, most=SLICE)):
            s, at, h, first = symbols_of(data, offsets)
            own, row, n = rows_of(first), rows_of(at), len(first) - 1
            i, common = lookup(v.words, h)
            of_common = lambda values: np.bincount(own[common], values[i[common]], n).astype(float) if common.any() else np.zeros(n)
            rows, keys = [], []
            # What the tree has of a context it has of the parent, too, so what the parent's filters rule out needs no key.
            kept = paired = np.ones(len(s), bool)
            for (bits, pair_bits), (ids, ok) in zip(filters, context_ids(s, at, len(filters))):
                kept = kept & ok & passes(bits, ids)
                at_ = np.flatnonzero(kept)
                c = ids[at_]
                pair = pair_hash(c, s[at_])
                seen = paired[at_] & passes(pair_bits, pair)
                paired = np.zeros(len(s), bool)
                paired[at_[seen]] = True
                rows += [row[at_], row[at_[seen]]]
                keys += [pair_hash(c, np.full(len(c), _ANY, np.int64).view(_U)), pair[seen]]
            rows, keys = np.concatenate([own[~common], *rows]), np.concatenate([h[~common], *keys])
            order = np.argsort(keys)
            rows, keys = rows[order], keys[order]
            j = np.minimum(np.searchsorted(tree_keys, keys), max(0, len(tree_keys) - 1))
            there = tree_keys[j] == keys if len(tree_keys) else np.zeros(len(keys), bool)
            tree = np.bincount(rows[there], tree_values[j[there]], n).astype(float)
            rows, keys, often = _counted(rows[~there], keys[~there])
            part = part_of(keys, parts)
            begin = _borders(part)
            ids = batch.column(0).cast(pa.int64())
            docs = np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int64), np.diff(at), np.bincount(own[common], minlength=n),
                             of_common(logs).view(np.int64), of_common(plain).view(np.int64), tree.view(np.int64)])
            size = len(begin) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(part[begin[:-1]], number % parts)), pa.array(np.full(size + 1, task + number)),
                 *(pa.concat_arrays([packed(a, begin), pa.array([b""])]) for a in (keys, narrow(rows), narrow(often))),
                 pa.array([None] * size + [docs.tobytes()], pa.binary())],
                names=["part", "slice", "keys", "rows", "often", "docs"])
    return run


def _packed_weights(rows: pa.Table) -> pa.Table:
    """One row per part."""
    keys = rows["key"].to_numpy().view(_U)
    one = lambda values: packed(values, np.array([0, len(keys)]))
    return pa.table({"part": rows["part"][:1], "keys": one(keys), "values": one(rows["value"].to_numpy()), "counts": one(rows["n"].to_numpy())})


def _summed(blocks: pa.Table, weights: pa.Table) -> pa.Table:
    """What a part's weights (a word has a count) add to the rows of each slice; blocks of rows themselves pass."""
    keys, sizes = unpacked(blocks["keys"], _U)
    of, often = widened(blocks["rows"], sizes), widened(blocks["often"], sizes)
    own = unpacked(weights["keys"], _U)[0]
    in_order = np.argsort(own)
    i, there = lookup(own[in_order], keys)
    # A row of a block: their numbers side by side.
    row = (np.repeat(np.arange(len(sizes)), sizes)[there] << 32) + of[there]
    order, first = runs(row)
    row, i, often = row[order[first]], in_order[i[there][order]], often[there][order]
    values, counts = unpacked(weights["values"], np.float64)[0], unpacked(weights["counts"], np.int64)[0]
    total = lambda w: sums(w[i] * often, first)
    word = total((counts > 0).astype(np.int64))
    more = total(np.where(counts > 0, np.log10(counts + 1.0), 0.0))
    begin = np.searchsorted(row, np.arange(len(sizes) + 1) << 32)
    row = narrow(row & 0xFFFFFFFF)
    # Few rows have a rare word here.
    has = np.flatnonzero(word)
    of_word = np.searchsorted(has, begin)
    return pa.table({
        "slice": blocks["slice"], "rows": packed(row, begin), "value": packed(total(values), begin), "word_rows": packed(row[has], of_word),
        "more": packed(more[has], of_word), "word": packed(word[has].astype(np.uint32), of_word), "docs": blocks["docs"]})


def _documents(blocks: pa.Table) -> pa.Table:
    """The rows of one slice with all that was added to them."""
    docs = np.frombuffer(next(b for b in blocks["docs"].to_pylist() if b is not None), np.int64).reshape(7, -1)

    def total(rows, name, dtype):
        values, sizes = unpacked(blocks[name], dtype)
        return np.bincount(widened(blocks[rows], sizes), values, docs.shape[1]).astype(float)

    return pa.table({
        "doc_id": pa.array(docs[0], mask=docs[1] == 0), "n_tokens": docs[2], "n_common": docs[3], "base": docs[4].view(float), "plain": docs[5].view(float),
        "tree": docs[6].view(float), "more": total("word_rows", "more", float), "value": total("rows", "value", float),
        "word": total("word_rows", "word", np.uint32).astype(np.int64)})


_BLOCKS = "part long, slice long, keys binary, rows binary, often binary, docs binary"
_SUMMED = "slice long, rows binary, value binary, word_rows binary, more binary, word binary, docs binary"
_DOCUMENTS = "doc_id long, n_tokens long, n_common long, base double, plain double, tree double, more double, value double, word long"


def learn_vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    """``counts``: word, n of all of ``docs``. Only words of a least share come to the driver."""
    ends = docs.count()
    t = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens = t["n"] + ends
    top = counts.where(F.col("n") >= max(1.0, COMMON_SHARE * tokens)).toArrow()
    words, often = np.asarray(top.column(0)).view(_U), np.asarray(top.column(1))
    order = np.argsort(words)
    return Vocabulary(words[order], often[order], tokens, t["v"] + (ends > 0), ends, float(np.clip(t["once"] / max(1, tokens), 1e-6, 0.5)))


def score_documents(docs: DataFrame, learn_from: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (doc_id, text), learnt from all
    rows of ``learn_from`` (text).

    Null and empty texts are the end alone. ``base_score`` is the add-one unigram score over words and end. Counts of all
    words come from one aggregation; common words and contexts are looked up in lists of bounded size, all others by a
    join. A repeated row is scored like the first; nothing to learn from makes all symbols equally likely.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "suffixtree")
    counts = steps.keep(learn_from.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    v = learn_vocabulary(learn_from, counts)
    tree = grow(learn_from, v, counts, steps, depth)
    shared = spark.sparkContext.broadcast((v, tree.filters, tree.keys, tree.values))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = 1 + size // PART_BYTES

    def weights_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", _spark_part_of(F.col("key"), parts)).groupBy("part").applyInArrow(
            _packed_weights, "part long, keys binary, values binary, counts binary")

    def all_weights():
        # The largest first, so that least is left when the table is whole.
        for d in reversed(tree.summands):
            yield weights_of(d.select("key", "value", F.lit(0).cast("long").alias("n")))
            steps.free(d)
        yield weights_of(counts.select(F.col("word").alias("key"), F.log10("n").alias("value"), "n"))
        steps.free(counts)

    steps.collect()
    weights = steps.bucketed(all_weights(), "weights", "part")
    log = lambda x: float(np.log10(x)) if x > 0 else 0.0
    # The end counts as a word here.
    known = F.col("n_common") + F.col("word") + int(v.ends > 0)
    score = F.col("plain") + log(v.ends) + F.col("tree") + F.col("value") + known * log((1 - v.unseen) / max(1, v.tokens)) + (F.col("n_tokens") - known) * log(v.unseen)

    def scores_of(part: int) -> DataFrame:
        own = _part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.xxhash64("doc_id", "text"), part, PARTS)
        asked = own.mapInArrow(_scored(shared, parts), _BLOCKS)
        found = asked.groupBy("part").cogroup(weights.groupBy("part")).applyInArrow(_summed, _SUMMED)
        return steps.keep(found.groupBy("slice").applyInArrow(_documents, _DOCUMENTS).select(
            "doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.col("more") + log(v.ends + 1.0) - F.col("n_tokens") * log(v.tokens + v.kinds + 1.0)).alias("base_score"),
            score.alias("score")), "scores")

    out = []
    for part in range(PARTS):
        out.append(scores_of(part))
        # The part's exchanges are of no more use, and no frame holds them now.
        steps.collect()
    steps.free(weights)
    return reduce(DataFrame.union, out)


def op10_suffix_tree_scores(spark, sf_dir):
    """All documents, learnt from the folds other than 2 of 7."""
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, docs.where(fold_of("doc_id", 7) != 2))
    return out.withColumn("held_out", F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False)))
