"""MinHash near-duplicates with circulant permutations.

One permutation scatters the shingles over 2^32 places, the second, shifted by one place per coordinate, gives
every coordinate of the signature. Bands of the signature make buckets; a bucket links its members to its smallest
one, so that n members give n - 1 rows. Exact Jaccard similarity on the full shingle sets decides every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafvoice.llm import graph
from leafvoice.llm.buffers import lists, mix, text_slices, word_hashes
from leafvoice.llm.tables import Steps, table

_U = np.uint64
#: Members of a group that one task holds at once, and sets it compares with them.
TILE = 64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each row, sorted, and the rows' first ones."""
    h, first = word_hashes(data, offsets, lower=True)
    n = len(h)
    whole = h * _U(3)
    for k in range(1, min(width, n)):
        whole[: n - k] = mix(whole[: n - k]) + h[k:] * _U(2 * k + 3)
    whole = mix(whole)
    out, at = [], np.zeros(len(first), np.int64)
    for r in range(len(first) - 1):
        a, b = first[r], first[r + 1]
        if b - a >= width:
            s = np.unique(whole[a: b - width + 1])
        elif b > a:
            # Fewer words than a shingle has: the whole sequence is the only one.
            s = mix(np.bitwise_xor.reduce(mix(h[a:b] + np.arange(b - a, dtype=_U)), keepdims=True) + _U(b - a))
        else:
            s = np.zeros(0, _U)
        out.append(s)
        at[r + 1] = at[r] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, _U)), at


def _permute(x: np.ndarray, tmp: np.ndarray) -> None:
    """A permutation of 32 bits, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def circulant(values: np.ndarray, first: np.ndarray, n_coordinates: int) -> np.ndarray:
    """Signatures, one row for each non-empty set: coordinate k is the least place under the second permutation,
    shifted k places, of what the first one makes of the set."""
    start = first[:-1][np.diff(first) > 0]
    out = np.empty((len(start), n_coordinates), np.uint32)
    if not len(start):
        return out
    placed = (values >> _U(32)).astype(np.uint32)
    x, tmp = np.empty_like(placed), np.empty_like(placed)
    _permute(placed, tmp)
    for k in range(n_coordinates):
        np.add(placed, np.uint32(k), out=x)
        _permute(x, tmp)
        out[:, k] = np.minimum.reduceat(x, start)
    return out


def _profile(width: int, bands: int, rows: int):
    def run(batches):
        for batch, data, offsets in text_slices(batches):
            values, first = shingles(data, offsets, width)
            n = np.diff(first)
            sums = np.zeros((2, len(values) + 1), _U)
            np.cumsum(values, out=sums[0, 1:])
            np.cumsum(mix(values + _U(11)), out=sums[1, 1:])
            h = mix(sums[:, first[1:]] - sums[:, first[:-1]])
            sig = circulant(values, first, bands * rows).astype(_U).reshape(-1, bands, rows)
            key = np.zeros(sig.shape[:2], _U) + np.arange(bands, dtype=_U)
            for r in range(rows):
                key = mix(key * _U(31) + sig[:, :, r])
            at = np.concatenate([[0], np.cumsum((n > 0) * bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                 lists(pa.array(key.reshape(-1).view(np.int64)), at)],
                names=["doc_id", "n_shingles", "h1", "h2", "keys"],
            )
    return run


def _groups(batches, keys: list[str]):
    """Runs of rows that agree in ``keys``, which the rows are sorted by; a run may come in several pieces."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        at = np.flatnonzero(new).tolist() + [n]
        for a, b in zip(at, at[1:]):
            yield tuple(int(c[a]) for c in cols), batch.slice(a, b - a)


def _sets(batch: pa.RecordBatch, width: int):
    """(row, shingle set) of each text."""
    row = 0
    for part, data, offsets in text_slices([batch]):
        values, first = shingles(data, offsets, width)
        for r in range(part.num_rows):
            yield row, values[first[r]: first[r + 1]]
            row += 1


def _linked(common: np.ndarray, a: np.ndarray, b: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _against_leader(width: int, percent: int):
    """Rows sorted by (cluster, tile, role): the leader first, then the members."""
    def run(batches):
        key, leader = None, None
        for k, part in _groups(batches, ["cluster", "tile"]):
            nodes, roles = part.column("node").to_pylist(), part.column("role").to_pylist()
            out = []
            for r, s in _sets(part, width):
                if k != key:
                    key, leader = k, None
                if roles[r] == 0:
                    if leader is None:
                        leader = s
                else:
                    common = np.isin(s, leader, assume_unique=True).sum() if leader is not None else 0
                    out.append((nodes[r], bool(_linked(common, len(leader), len(s), percent)) if leader is not None else False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out]) for i in (0, 1)], names=["node", "linked"])
    return run


def _against_tiles(width: int, percent: int):
    """Rows sorted by (cluster, tile, part, role): a tile's members, then the documents left over, one by one."""
    def run(batches):
        key, members = None, []
        tile = None
        for k, part in _groups(batches, ["cluster", "tile", "part"]):
            if k != key:
                key, members, tile = k, [], None
            nodes, roles, linked = (part.column(c).to_pylist() for c in ("node", "role", "linked"))
            found = []
            for r, s in _sets(part, width):
                if roles[r] == 0:
                    members.append((nodes[r], linked[r], s))
                    continue
                if tile is None:
                    v = np.concatenate([m[2] for m in members])
                    own = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
                    order = np.argsort(v, kind="stable")
                    tile = v[order], own[order], np.array([len(m[2]) for m in members])
                v, own, sizes = tile
                a, b = np.searchsorted(v, s, "left"), np.searchsorted(v, s, "right")
                n = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(own[at], minlength=len(members))
                done = False
                for m in np.flatnonzero(_linked(common, sizes, len(s), percent)):
                    node, with_leader, _ = members[m]
                    # Members linked with the leader are one component already: one link to them says all.
                    if node != nodes[r] and not (with_leader and done):
                        found.append((nodes[r], node))
                        done |= with_leader
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 48, rows: int = 6
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. ``bands`` of ``rows``
    coordinates miss a pair at 0.8 with probability (1 - 0.8^6)^48 = 5e-7, closer ones far less.

    * Null and empty texts have no shingles and link with nothing; fewer words than ``width`` are one shingle.
    * Each row is judged by its own text, so repeated rows get equal answers. A null ``doc_id`` links with nothing:
      its ``component_id`` is null and it is kept.
    * Equal sets are one class before any bucket is made, however many there are.
    * In a cluster (what buckets connect) each member is compared with the leader, in tiles of ``TILE`` members; those
      not linked with it are compared with all tiles. No task holds a cluster, no pair is left out.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = steps.keep(docs.mapInArrow(
        _profile(width, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "profile")
    live = profile.where("n_shingles > 0 and doc_id is not null")
    classes = steps.keep(live.groupBy("h1", "h2").agg(F.min("doc_id").alias("cls")), "classes")
    heads = live.join(classes, (live.doc_id == classes.cls) & (live.h1 == classes.h1) & (live.h2 == classes.h2), "left_semi")
    entries = steps.keep(heads.select("doc_id", F.explode("keys").alias("key")), "entries")
    buckets = steps.keep(
        entries.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    stars = steps.keep(
        entries.join(buckets, "key").where("doc_id != head").groupBy(F.col("doc_id").alias("a"), F.col("head").alias("b"))
        .agg(F.count("*").alias("n")), "stars")
    steps.free(entries, buckets)

    clusters = graph.components(stars.select("a", "b"), steps)
    degree = stars.select(F.explode(F.array("a", "b")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    members = steps.keep(clusters.select("node", F.col("label").alias("cluster")).join(degree, "node"), "members")
    facts = steps.keep(
        members.groupBy("cluster").agg(F.count("*").alias("size"), F.max_by("node", F.struct("n", -F.col("node"))).alias("leader"))
        .withColumn("tiles", F.ceil(F.col("size") / TILE)), "facts")
    placed = members.join(facts, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    with_text = steps.keep(
        docs.join(placed, docs.doc_id == placed.node).select("cluster", "tile", "tiles", "size", "leader", "node", "text"), "texts")
    of_tile = ["cluster", "tile", "role", "node", "text"]
    lead = with_text.where("node = leader").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rest = with_text.where("node != leader")
    first = lead.withColumn("role", F.lit(0)).select(of_tile).union(rest.withColumn("role", F.lit(1)).select(of_tile))
    verdicts = steps.keep(
        first.repartition("cluster", "tile").sortWithinPartitions("cluster", "tile", "role")
        .mapInArrow(_against_leader(width, percent), "node long, linked boolean")
        .groupBy("node").agg(F.max("linked").alias("linked"))
        .join(members.select("node", "cluster"), "node").join(facts, "cluster").select("node", "cluster", "leader", "linked"), "verdicts")

    # Who isn't linked with the leader may still be linked with any other member.
    open_ = steps.keep(
        verdicts.where("not linked").groupBy("cluster").agg(F.count("*").alias("left_over"))
        .join(facts.where("size > 2"), "cluster").select("cluster", F.ceil(F.col("left_over") / TILE).alias("parts")), "open")
    known = with_text.where("node != leader").join(verdicts.select("node", "linked"), "node").join(open_, "cluster")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["cluster", "tile", "part", "role", "node", "linked", "text"]
    held = known.withColumn("part", spread("parts")).withColumn("role", F.lit(0)).select(cols)
    asked = (known.where("not linked").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), "parts"))
             .withColumn("tile", spread("tiles")).withColumn("role", F.lit(1)).select(cols))
    more = (held.union(asked).repartition("cluster", "tile", "part").sortWithinPartitions("cluster", "tile", "part", "role")
            .mapInArrow(_against_tiles(width, percent), "a long, b long"))
    links = steps.keep(
        verdicts.where("linked").select(F.col("node").alias("a"), F.col("leader").alias("b")).union(more), "links")
    steps.free(with_text)
    found = graph.components(links, steps)
    return (
        profile.drop("keys").join(classes, ["h1", "h2"], "left")
        .join(found, F.col("cls") == F.col("node"), "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", F.when(F.col("n_shingles") > 0, F.col("cls")), "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def op3_minhash_near_dedup(spark, sf_dir):
    """Near copies of the whole table on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
