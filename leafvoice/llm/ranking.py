"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time with skipping over long ones.

Texts are read once, into *segments*: small inverted files of some million postings, one row each, of the queries' terms.
A segment is searched on its own, and the best of all segments are merged. Its documents are numbered by doc_id, so what
comes later in a list never wins a tie.

For one query the segment's lists are split by length. Short ones are summed term by term into accumulators (document,
sum); from there on these are one list like any other, with their greatest sum as its bound. Over them and the long lists
the documents are visited in order, some hundred to thousand at a time. Lists whose bounds together can't beat the k-th
best score so far bring up no candidates; they are only looked into, from the highest bound down, for candidates that may
still get there. All figures are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafvoice.llm.buffers import rows_of, text_slices, word_hashes
from leafvoice.llm.tables import Steps, table

#: Bytes between terms: ASCII other than letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
#: A segment is closed at so many postings or documents.
POSTINGS, DOCUMENTS = 1_000_000, 200_000
#: Characters of queries that the driver and each task hold at once; more are searched for in parts.
QUERY_CHARS = 4_000_000
#: Lists are short as long as theirs together hold no more postings than this share of a segment's documents, and some.
SHORT_SHARE, SHORT_LEAST = 0.125, 1024
#: Documents visited at once: few, until there is something to beat.
FIRST_STRIDE, MOST_STRIDE = 256, 8192
_SEGMENTS = "docs long, words long, doc_id array<long>, n array<long>, term array<int>, df array<long>, ord array<int>, tf array<int>"
_SEGMENT_TYPES = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                            ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("ord", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """Fingerprints of each text's distinct terms."""
    out = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        out.append(np.unique(word_hashes(raw, np.array([0, len(raw)]), lower=True, blank=BETWEEN)[0]))
    return out


class _Building:
    """A segment while texts are read."""

    def __init__(self, kinds: int) -> None:
        self.kinds = kinds
        self.docs = self.words = self.held = self.postings = 0
        self.ids, self.nulls, self.lengths, self.keys, self.counts = [], [], [], [], []

    def add(self, ids: pa.Array, lengths: np.ndarray, row: np.ndarray, term: np.ndarray) -> None:
        """``row, term``: one per occurrence of a query's term."""
        self.docs += int((lengths > 0).sum())
        self.words += int(lengths.sum())
        key, often = np.unique(row * self.kinds + term, return_counts=True)
        row, term = np.divmod(key, self.kinds)
        own, number = np.unique(row, return_inverse=True)
        ids = ids.take(pa.array(own))
        self.nulls.append(np.asarray(ids.is_null()))
        self.ids.append(np.asarray(ids.fill_null(0)))
        self.lengths.append(lengths[own])
        self.keys.append(term * (1 << 32) + self.held + number)
        self.counts.append(often)
        self.held += len(own)
        self.postings += len(key)

    def close(self) -> pa.RecordBatch:
        ids, nulls, lengths, keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.nulls, self.lengths, self.keys, self.counts))
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, number = keys >> 32, place[keys & 0xFFFFFFFF]
        by = np.lexsort((number, term))
        kinds, df = np.unique(term, return_counts=True)
        row = [self.docs, self.words, pa.array(ids[order], pa.int64(), mask=nulls[order].astype(bool)), lengths[order], kinds, df, number[by], counts[by]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT_TYPES.types)], schema=_SEGMENT_TYPES)


def _segments(shared):
    def run(batches):
        vocabulary = shared.value
        now = _Building(max(1, len(vocabulary)))
        for batch, data, offsets in text_slices(batches):
            h, first = word_hashes(data, offsets, lower=True, blank=BETWEEN)
            i = np.searchsorted(vocabulary, h)
            known = np.flatnonzero(vocabulary[np.minimum(i, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
            now.add(batch.column(0).cast(pa.int64()), np.diff(first), rows_of(first)[known], i[known])
            if now.postings >= POSTINGS or now.held >= DOCUMENTS:
                yield now.close()
                now = _Building(max(1, len(vocabulary)))
        if now.docs:
            yield now.close()
    return run


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of documents in order, with the sums over ``lists``."""
    if len(lists) == 1:
        return lists[0]
    docs, values = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    start = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[start], (np.add.reduceat(values, start) if len(start) else values)


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, beat: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best of those that score more than ``beat``, by falling score, then document.
    ``lists``: documents in order and their (positive) parts of the score, per term."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    most, short = SHORT_LEAST + int(SHORT_SHARE * n_docs), 0
    while short < len(lists) and (most := most - len(lists[short][0])) >= 0:
        short += 1
    iterators = ([_summed(lists[:short])] if short else []) + lists[short:]
    bounds = np.array([int(v.max()) for _, v in iterators], np.int64)
    order = np.argsort(bounds)
    iterators, upto = [iterators[i] for i in order], np.cumsum(bounds[order])
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, stride = 0, FIRST_STRIDE
    while at < n_docs:
        # The first ``idle`` lists together can't beat what there is: they bring up no candidates.
        idle = int(np.searchsorted(upto, beat, "right"))
        active = iterators[idle:]
        if not active:
            break
        begins = [int(np.searchsorted(d, at)) for d, _ in active]
        following = [int(d[b]) for (d, _), b in zip(active, begins) if b < len(d)]
        if not following:
            break
        at = min(following)
        end = at + stride
        cand, sums = _summed([(d[b:e], v[b:e]) for (d, v), b, e in ((x, b, int(np.searchsorted(x[0], end))) for x, b in zip(active, begins))])
        for i in range(idle - 1, -1, -1):
            open_ = sums + upto[i] > beat
            cand, sums = cand[open_], sums[open_]
            if not len(cand):
                break
            d, v = iterators[i]
            x = np.minimum(np.searchsorted(d, cand), len(d) - 1)
            sums = sums + np.where(d[x] == cand, v[x], 0)
        better = sums > beat
        if better.any():
            docs, scores = np.concatenate([docs, cand[better]]), np.concatenate([scores, sums[better]])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            if len(docs) == k:
                beat = max(beat, int(scores[-1]))
        at, stride = end, min(2 * stride, MOST_STRIDE)
    return docs, scores


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Parts of the score: weight of the term times its saturated count, with the document's length ``n`` taken into account."""
    m = 100 - 90 + (90 * n * docs) // max(1, words)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _search(shared, k: int):
    def run(batches):
        queries, weights, docs, words = shared.value
        # The k-th best of a task's earlier segments must be reached by the later ones.
        reached = [0] * len(queries)
        for batch in batches:
            for s in range(batch.num_rows):
                ids, n, kinds, df, number, tf = (batch.column(c)[s].values for c in range(6))
                n, kinds, df, number, tf = (np.asarray(x).astype(np.int64) for x in (n, kinds, df, number, tf))
                at = np.concatenate([[0], np.cumsum(df)])
                value = impacts(tf, n[number], np.repeat(weights[kinds], df), docs, words)
                found_q, found_d, found_s = [], [], []
                for q, wanted in enumerate(queries):
                    i = np.searchsorted(kinds, wanted)
                    i = i[kinds[np.minimum(i, len(kinds) - 1)] == wanted] if len(kinds) else i[:0]
                    i = i[weights[kinds[i]] > 0]
                    d, v = best_of([_positive(number[at[t]: at[t + 1]], value[at[t]: at[t + 1]]) for t in i], len(n), k, max(0, reached[q] - 1))
                    if len(d) == k:
                        reached[q] = max(reached[q], int(v[-1]))
                    found_q.append(np.full(len(d), q))
                    found_d.append(d)
                    found_s.append(v)
                if found_d:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q), pa.int32()), ids.take(pa.array(np.concatenate(found_d), pa.int64())),
                                                      pa.array(np.concatenate(found_s), pa.int64())], names=["query", "doc_id", "score"])
    return run


def _positive(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Very long documents may round a part down to nothing."""
    some = values > 0
    return (docs, values) if some.all() else (docs[some], values[some])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` (item_id, text) the ``k`` rows of ``docs`` (doc_id, text)
    that score highest, if above 0.

    Equal scores are ranked by doc_id, null last; equal rows are documents of their own, in any order. A null or empty text
    has no terms: such a document is not counted, such an item has no rows. Rows of ``items`` with equal texts are searched
    for once and get the same rows. Terms are told apart by 64-bit fingerprints.

    Queries are held by the driver and the tasks, ``QUERY_CHARS`` at once; each further part of them reads the texts anew.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "ranking")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text", F.sha2("text", 256).alias("query_key")).where("text is not null")
    queries = steps.keep(items.groupBy("query_key").agg(F.first("text").alias("text")), "queries")
    parts = 1 + (queries.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // QUERY_CHARS
    found = [_rank_part(docs, queries.where(F.pmod(F.xxhash64("query_key"), F.lit(parts)) == part), k, steps) for part in range(parts)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.join(items.select("item_id", "query_key"), "query_key").select("item_id", "rank", "doc_id", "score")


def _rank_part(docs: DataFrame, queries: DataFrame, k: int, steps: Steps) -> DataFrame:
    spark = docs.sparkSession
    own = queries.collect()
    terms = terms_of([r["text"] for r in own])
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
    held = spark.sparkContext.broadcast(vocabulary)
    segments = steps.keep(docs.mapInArrow(_segments(held), _SEGMENTS), "segments")
    held.destroy()
    total = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n = total["docs"]
    df = np.zeros(len(vocabulary), np.int64)
    # One count per term of the queries.
    counted = segments.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[np.asarray(counted.column(0))] = np.asarray(counted.column(1))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = spark.sparkContext.broadcast(([np.searchsorted(vocabulary, t) for t in terms], weights, n, total["words"]))
    best = segments.drop("docs", "words").mapInArrow(_search(shared, k), "query int, doc_id long, score long")
    best = best.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    ranked = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*ranked))
    # In two levels: a query's finds grow with the number of segments.
    best = best.withColumn("rank", number("query", "deal")).where(F.col("rank") <= k).withColumn("rank", number("query")).where(F.col("rank") <= k)
    keys = spark.createDataFrame([(i, r["query_key"]) for i, r in enumerate(own)], "query int, query_key string")
    return steps.keep(best.join(keys, "query").select("query_key", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "best")


def op13_hybrid_search(spark, sf_dir):
    """The 10 best documents for each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
OP13_SQL = rf"""
with words as (select doc_key, doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) as term
               from (select row_number() over () as doc_key, doc_id, text from documents)),
wanted as (select distinct item_key, item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) as term
           from (select row_number() over () as item_key, item_id, text from benchmark)),
lengths as (select doc_key, any_value(doc_id) as doc_id, count(*)::bigint as n from words group by doc_key),
total as (select count(*)::bigint as docs, sum(n)::bigint as words from lengths),
counts as (select doc_key, term, count(*)::bigint as tf from words group by doc_key, term),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from counts, total group by term),
scores as (select item_key, any_value(item_id) as item_id, counts.doc_key, any_value(lengths.doc_id) as doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::bigint as score
           from wanted join counts using (term) join weights using (term) join lengths using (doc_key), total
           group by item_key, counts.doc_key)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_key order by score desc, doc_id nulls last)::integer as rank from scores where score > 0)
where rank <= 10
"""
