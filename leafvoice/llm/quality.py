"""Quality scores from positive and unlabelled documents.

A linear model on measures of the text minimises the non-negative unbiased risk

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f))

with the logistic loss l, trusted positives P, unlabelled documents U and the class prior estimated from both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.llm.buffers import lists, mix, text_slices, word_hashes, words
from leafvoice.llm.tables import Steps, fold_of, table

#: Kinds of bytes whose shares are measured.
KINDS = np.full(256, 7, np.int64)
KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
KINDS[[*b"0123456789"]] = 2
KINDS[[*b" \t\r\n\x0b\x0c"]] = 3
KINDS[[*b".,;:'\"()-"]] = 4
KINDS[[*b"!?"]] = 5
KINDS[[*b"#*$%&|<>{}[]=+_~^@/\\"]] = 6
HINGES = (0.02, 0.1, 0.3, 0.6)
RIDGE = 3e-4
MOST_STEPS = 16
#: Sums of so many groups of partitions come to the driver, whatever the number of partitions.
SUM_TASKS = 32
SCORE_BINS = 200


def text_measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares in 0..1 for each row, all of its text; the empty text has zeros."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    kinds = np.bincount(rows * 8 + KINDS[data], minlength=8 * len(n)).reshape(-1, 8).astype(float)
    kinds /= np.maximum(n, 1)[:, None]
    h, first = word_hashes(data, offsets)
    starts, ends, _ = words(data, offsets)
    n_words = np.diff(first)
    own = np.repeat(np.arange(len(n)), n_words)
    size = (ends - starts).astype(float)
    per = lambda v: np.bincount(own, v, len(n)) / np.maximum(n_words, 1)
    mean = per(size)
    spread = np.sqrt(np.maximum(per(size ** 2) - mean ** 2, 0))
    twin = np.zeros(len(h))
    twin[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    line = np.zeros(256, bool)
    line[10] = True
    lh, lfirst = word_hashes(data, offsets, blank=line)
    distinct, lines, triples = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    three = mix(mix(h[:-2]) + mix(h[1:-1] * np.uint64(3)) + h[2:] * np.uint64(5)) if len(h) > 2 else np.zeros(0, np.uint64)
    for r in range(len(n)):
        a, b = first[r], first[r + 1]
        if b > a:
            distinct[r] = 1 - len(np.unique(h[a:b])) / (b - a)
        if b - a > 2:
            triples[r] = 1 - len(np.unique(three[a: b - 2])) / (b - a - 2)
        c, d = lfirst[r], lfirst[r + 1]
        if d > c:
            lines[r] = 1 - len(np.unique(lh[c:d])) / (d - c)
    log = np.minimum(np.log1p(n_words) / 10, 1)
    return np.column_stack([kinds, np.minimum(mean / 12, 1), np.minimum(spread / 12, 1), per(twin), distinct, triples, lines, log])


def expand(x: np.ndarray) -> np.ndarray:
    """Measures, their hinges and a constant."""
    return np.column_stack([np.ones(len(x)), x, *(np.maximum(x - h, 0) for h in HINGES)])


def _measured(batches):
    for batch, data, offsets in text_slices(batches):
        x = text_measures(data, offsets).astype(np.float32)
        at = np.arange(len(x) + 1) * x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists(pa.array(x.reshape(-1)), at)], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return expand(flat.reshape(len(column), -1).astype(float)) if len(column) else np.zeros((0, 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(weights: np.ndarray):
    """Per set (positive or unlabelled): rows, losses of both signs, gradients and curvature, as one flat list."""
    def run(batches):
        total = 0
        for batch in batches:
            x, positive = _matrix(batch.column(0)), np.asarray(batch.column(1)).astype(bool)
            z = x @ weights
            p = _sigmoid(z)
            out = []
            for mask in (positive, ~positive):
                xm, pm, zm = x[mask], p[mask], z[mask]
                out += [[mask.sum()], [np.logaddexp(0, -zm).sum()], [np.logaddexp(0, zm).sum()], xm.sum(0), pm @ xm, ((xm * (pm * (1 - pm))[:, None]).T @ xm).ravel()]
            total = total + np.concatenate(out)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])
    return run


def _added(batches):
    total = 0
    for batch in batches:
        if batch.num_rows:
            total = total + np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1).sum(0)
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])


def _collect_sums(rows: DataFrame, weights: np.ndarray):
    parts = rows.mapInArrow(_sums(weights), "v array<double>").repartition(SUM_TASKS).mapInArrow(_added, "v array<double>").collect()
    if not parts:
        return None
    v, d = np.sum([r["v"] for r in parts], axis=0), len(weights)
    step = 3 + 2 * d + d * d
    cut = lambda s: (s[0], s[1], s[2], s[3: 3 + d], s[3 + d: 3 + 2 * d], s[3 + 2 * d:].reshape(d, d))
    return cut(v[:step]), cut(v[step:])


def fit(rows: DataFrame, prior: float, weights: np.ndarray) -> np.ndarray:
    """Newton steps on the non-negative risk over ``rows`` (x, positive: labelled ones; the others are unlabelled), with a
    little ridge. While the second part of the risk is below zero it counts as zero and only the first part is
    followed; a step that doesn't lower the risk is halved, so the search settles where the two meet."""
    best, least, move = weights, np.inf, np.zeros(len(weights))
    for _ in range(MOST_STEPS):
        got = _collect_sums(rows, weights)
        if got is None or not got[0][0] or not got[1][0]:
            return weights
        (np_, lp_pos, lp_neg, xp, pxp, hp), (nu, _, lu_neg, _, pxu, hu) = got
        negative = lu_neg / nu - prior * lp_neg / np_
        risk = prior * lp_pos / np_ + max(0.0, negative) + RIDGE / 2 * weights @ weights
        if risk >= least:
            move = move / 2
        else:
            best, least = weights, risk
            if negative >= 0:
                # l(z) - l(-z) = -z: the positives enter linearly and the whole is convex.
                gradient, curve = pxu / nu - prior * xp / np_, hu / nu
            else:
                gradient, curve = prior * (pxp - xp) / np_, prior * hp / np_
            move = np.linalg.solve(curve + RIDGE * np.eye(len(weights)), gradient + RIDGE * weights)
            move *= min(1.0, 4.0 / np.abs(move).max())
        if np.abs(move).max() < 2e-3:
            break
        weights = best - move
    return best


def _score(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            # No weights: nothing was learnt.
            at = _matrix(batch.column(1)) @ weights if batch.num_rows and len(weights) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(at))], names=["doc_id", "score"])
    return run


def estimate_prior(scored: DataFrame, marks: DataFrame) -> float:
    """Least ratio of unlabelled to positive documents among the best-scored ones: positives are spread alike in both,
    so the ratio can't fall below the prior but by chance; the sets hold a fifth of the positives at least, and one
    standard error is added."""
    b = F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).alias("b")
    counts = scored.join(marks, "doc_id", "left").groupBy(b, F.col("positive").isNotNull().alias("p")).count().collect()
    pos, unl = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for r in counts:
        (pos if r["p"] else unl)[int(r["b"])] += r["count"]
    unl += pos  # the positives are documents of the corpus, too
    if not pos.sum():
        return 0.5
    p, u = np.cumsum(pos[::-1]) / pos.sum(), np.cumsum(unl[::-1]) / unl.sum()
    ok = p >= 0.2
    error = np.sqrt(1 / np.maximum(np.cumsum(pos[::-1]), 1))
    return float(np.clip(np.min((u[ok] / p[ok]) * (1 + error[ok])), 0.05, 0.98))


@dataclass
class QualityModel:
    weights: np.ndarray
    prior: float


def train(measured: DataFrame, positives: DataFrame) -> QualityModel:
    """``measured``: doc_id, x of the documents to learn from; ``positives``: doc_id of the trusted ones. Without any
    document or positive the model scores everything alike, 0.5."""
    marks = positives.select("doc_id").where("doc_id is not null").distinct().withColumn("positive", F.lit(True))
    row = measured.select("x").first()
    if row is None:
        return QualityModel(np.zeros(0), 0.5)
    d = expand(np.zeros((1, len(row["x"])))).shape[1]
    joined = measured.join(marks, "doc_id", "left")
    # Positives are counted in both sets, as they are part of the corpus.
    rows = Steps(measured.sparkSession, "quality").keep(
        joined.select("x", F.lit(False).alias("positive")).union(joined.where("positive").select("x", "positive")), "rows")
    prior, weights = 0.5, np.zeros(d)
    for _ in range(2):
        weights = fit(rows, prior, weights)
        prior = estimate_prior(measured.select("doc_id", "x").mapInArrow(_score(weights), "doc_id long, score double"), marks)
    return QualityModel(fit(rows, prior, weights), prior)


def score(measured: DataFrame, model: QualityModel) -> DataFrame:
    return measured.select("doc_id", "x").mapInArrow(_score(model.weights), "doc_id long, score double")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of each row of ``docs`` (doc_id, text), from the whole text; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, x array<float>")


def op1_pu_quality(spark, sf_dir):
    """Scores of all documents, learnt from the folds other than 0."""
    measured = Steps(spark, "quality").keep(measure(table(spark, sf_dir, "documents")), "measures")
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    model = train(measured.where(fold_of("doc_id", 5) != 0), labels.where("quality = 1"))
    return score(measured, model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
