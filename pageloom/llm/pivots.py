"""Embedding near-duplicates by a pivot-permutation index with exact verification.

Reference points are chosen far apart from a bounded sample of the vectors, so that a dense group of near copies holds
few of them and its members agree on the points around them. Each distinct vector is described by its ``near`` nearest
reference points in order and posted in their inverted lists. Two vectors of one list are candidates when they
share at least ``shared`` points (and counted in the least shared list only); the cosine in double precision then decides.
Long lists are cut into pairs of blocks. Tasks give each vector's number of links and a spanning forest, never the pairs.

Exact copies form one class that is posted once and counted with its size. Null, zero and non-finite vectors link with nothing and
are kept. Repeated rows count as other vectors. Vectors of different lengths never link. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_map, bounded_sample, components, paired_blocks, stored, table
from pageloom.operators.skew import spread_join

COSINE, PIVOTS, NEAR, SHARED, BLOCK, DRAWN = 0.95, 256, 8, 1, 4_096, 16


def _pivots(distinct: DataFrame, pivots: int) -> np.ndarray:
    rows = bounded_sample(distinct.select("cid", "v"), DRAWN * pivots, "cid").orderBy("cid").limit(2 * DRAWN * pivots).collect()
    width = max([len(r.v) for r in rows], default=0)
    found = [r.v for r in rows if len(r.v) == width]
    return spread(np.array(found, dtype=np.float64).reshape(len(found), width), pivots)


def spread(drawn: np.ndarray, pivots: int) -> np.ndarray:
    """``pivots`` rows of ``drawn``: the first, then always the one whose nearest chosen row is farthest."""
    if len(drawn) <= pivots:
        return drawn
    unit = drawn / np.abs(drawn).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < pivots:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return drawn[chosen]


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
           pivots: int = PIVOTS, near: int = NEAR, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    good = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(good, F.col(embedding).cast("array<double>")).alias("v"))
    rows = rows.withColumn("content", F.sha2(F.to_json(F.struct("v")), 256))
    distinct = stored(rows.where("v is not null").groupBy("content").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    points = spark.sparkContext.broadcast(_pivots(distinct, pivots))

    def describe(batch):
        p = points.value
        unit = p / np.linalg.norm(p, axis=1, keepdims=True) if len(p) else p
        lists = batch.column(2).to_pylist()
        out = []
        for at in range(0, len(lists), 1024):
            part = lists[at : at + 1024]
            if all(len(x) == unit.shape[1] for x in part):
                sims = np.array(part) / np.abs(part).max(axis=1, keepdims=True) @ unit.T
                out += np.argsort(-sims, axis=1, kind="stable")[:, :near].tolist()
            else:
                out += [np.argsort(-(unit @ np.array(x)), kind="stable")[:near].tolist() if len(x) == unit.shape[1] else [-len(x)] * min(near, shared) for x in part]
        yield {"cid": batch.column(0), "n": batch.column(1), "raw": [np.array(x, "<f8").tobytes() for x in lists], "perm": out}

    described = arrow_map(distinct.select("cid", "n", "v"), describe, "cid bigint, n bigint, raw binary, perm array<int>")
    posted = described.withColumn("pivot", F.explode(F.array_distinct("perm")))
    items = paired_blocks(posted, "pivot", "cid", block).select("item", "cid", "n", "raw", "perm", "pivot", "mine", "other")
    got = stored(_verify(items, cosine, shared))
    counts = got.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(got.where("n = 0").select("a", "b")).withColumnRenamed("node", "cid")
    known = distinct.select("content", "cid", F.col("n").alias("size")).join(counts.withColumnRenamed("a", "cid"), "cid", "left").join(roots, "cid", "left")
    known = known.select("content", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("root", "cid").alias("root"))
    out = spread_join(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("content")).alias("content")), known, ["content"], ["vec_id"], rows=2_000)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _verify(items: DataFrame, cosine: float, shared: int) -> DataFrame:
    """``a, b, n``: links of class ``a`` found in an item (b null, n > 0), or a forest edge (n = 0)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def solve(rest: pa.Table):
        rest = rest.sort_by("cid")
        cid, n = rest.column("cid").to_numpy(), rest.column("n").to_numpy()
        raw = rest.column("raw").to_pylist()
        pivot, mine, other = rest.column("pivot")[0].as_py(), rest.column("mine").to_numpy(), rest.column("other").to_numpy()
        width = max(map(len, raw))
        ok = np.array([len(x) == width for x in raw])
        v = np.zeros((len(raw), width // 8))
        v[ok] = np.frombuffer(b"".join(x for x in raw if len(x) == width), "<f8").reshape(-1, width // 8)
        v /= np.maximum(np.abs(v).max(axis=1, keepdims=True), 5e-324)
        norm = np.sqrt((v * v).sum(axis=1))
        norm[norm == 0] = np.inf
        perms = rest.column("perm").to_pylist()
        names = {p: i for i, p in enumerate(sorted({x for q in perms for x in q}))}
        has = np.zeros((len(raw), len(names)), dtype=np.float32)
        for i, q in enumerate(perms):
            has[i, [names[x] for x in q]] = 1
        lower = has[:, : names[pivot]]
        links, label = np.zeros(len(raw), dtype=np.int64), np.arange(len(raw))
        whole = bool((mine == other).all())
        need = shared if pivot >= 0 else 1
        for at in range(0, len(raw), 512):
            cut = slice(at, at + 512)
            hit = (v[cut] @ v.T) / norm[cut, None] / norm >= cosine
            hit &= lower[cut] @ lower.T == 0
            if need > 1:
                hit &= has[cut] @ has.T >= need
            if not whole:
                hit &= mine[cut, None] != mine
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            links[cut] = [int(n[row].sum()) for row in hit]
            # A row whose links lead to its own label already costs no merge.
            for i in np.flatnonzero((hit & (label[cut, None] != label)).any(axis=1)).tolist():
                found = np.unique(np.append(label[hit[i]], label[at + i]))
                if len(found) > 1:
                    label[np.isin(label, found[1:])] = found[0]
        a = np.flatnonzero(label != np.arange(len(raw)))
        b = label[a]
        some = np.flatnonzero(links)
        return (pa.array(np.concatenate([cid[some], cid[a]])), pa.array([None] * len(some) + cid[b].tolist(), pa.int64()),
                pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])))

    def run(batches):
        held: list = []
        key = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and ids[lo] != key:
                    if sum(map(len, held)) > 1:
                        yield pa.RecordBatch.from_arrays(list(solve(pa.Table.from_batches(held))), schema=schema)
                    held = []
                key = ids[lo]
                held.append(batch.slice(lo, hi - lo))
        if held and sum(map(len, held)) > 1:
            yield pa.RecordBatch.from_arrays(list(solve(pa.Table.from_batches(held))), schema=schema)

    return items.repartition("item").sortWithinPartitions("item").mapInArrow(run, "a bigint, b bigint, n bigint")


def op5_pivots(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
