"""Ranked search against a plain scorer over all pairs of a small set."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from leafvoice.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOC = "doc_id long, text string, rank int, score long, query string, item_id long"


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            n = sum(b.values())
            m = 100 - 90 + 90 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(f"W{int(x)}é" if x % 5 == 0 else f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 3000))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    docs = [(i, prose(rng, int(rng.integers(1, 120)))) for i in range(700)]
    docs += [(7, None), (None, "w1 w2 w77 lonely"), (None, None), (8, ""), (9, "-- ,.!"), (10, prose(rng, 20000)), (11, docs[3][1]), (11, docs[3][1])]
    docs += [(1000 + i, "exact copy of w9 with zebra") for i in range(40)]
    items = [(i, prose(rng, 12)) for i in range(30)] + [(100, None), (101, ""), (102, "ZEBRA"), (102, "zebra"), (None, "unheard-of zebra"), (103, "..."), (104, prose(rng, 900))]
    return docs, items


@pytest.mark.parametrize("postings, short", [(1_000_000, 1024), (900, 0)])
def test_ranking(spark, corpus, monkeypatch, postings, short):
    """Also with many small segments and without short lists."""
    monkeypatch.setattr(ranking, "SHORT_LEAST", short)
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, 2, "q", 3) for i, t in docs], DOC).repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.rank_documents(d, q).collect()), key=repr)
    assert got == plain(docs, items)


def test_queries_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_CHARS", 500)
    docs, items = corpus
    got = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), k=3)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr) == plain(docs, items, 3)


def test_empty(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert ranking.rank_documents(none, some.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert ranking.rank_documents(some, none.withColumnRenamed("doc_id", "item_id")).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_best_of_equals_full_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9000))
    lists = []
    for _ in range(int(rng.integers(1, 9))):
        d = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.02, 0.5, 0.9]))
        lists.append((d, rng.integers(1, rng.choice([3, 50, 100000]), len(d))))
    total = np.zeros(n, np.int64)
    for d, v in lists:
        total[d] += v
    best = np.lexsort((np.arange(n), -total))[:10]
    best = best[total[best] > 0]
    d, v = ranking.best_of(lists, n, 10)
    assert d.tolist() == best.tolist() and v.tolist() == total[best].tolist()
    if len(best) == 10:
        d, v = ranking.best_of(lists, n, 10, int(total[best[4]]) - 1)
        more = best[total[best] >= total[best[4]]]
        assert d[: len(more)].tolist() == more.tolist()


def test_long_lists_are_skipped(monkeypatch):
    """A rare term decides: of the common terms' lists, only what the candidates need is looked at."""
    n = 100_000
    rare = np.arange(500, n, 1000)
    common = np.arange(n)
    summed = []
    real = ranking._summed
    monkeypatch.setattr(ranking, "_summed", lambda lists: summed.append(sum(len(x[0]) for x in lists)) or real(lists))
    d, v = ranking.best_of([(rare, np.full(len(rare), 1000)), (common, common % 7 + 1), (common, common % 5 + 1)], n, 10)
    assert len(d) == 10 and sum(summed) < 0.05 * n
