"""Exact top-k by inner product: exhaustive term-at-a-time accumulation into dense score arrays.

Components become floor(1024 * x). Queries and candidates are dealt into blocks of about ``rows`` rows by a hash, and every pair
of a query block and a candidate block is one group: it scatters the block's postings of each term, times the queries' weights,
into dense score arrays, from which a partition selection takes the k best, ties to the smaller id. The few rows each pair selects
are merged by a ranking per query. Nothing passes through the driver but two counts; a group holds two blocks.

Vectors that are null or hold null or non-finite components, and null ids, take no part. Vectors of other lengths count as
padded with zeros; empty ones score 0. Equal candidate rows are sent once with their number and answer as often as they occur. Of the rows of a
repeated query id the least vector asks, and no row of that id answers. Products that may leave 64 bits are summed as Python
integers; components and scores beyond a long are held at its limits. Fewer than k candidates: all. Other columns are not read.
Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm.common import table

TOP, ROWS, BLOCK, LIMIT = 10, 8_192, 2_048, 2**63 - 1


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("v"))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    if rows and all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def accumulate(queries: list[list[tuple[int, int]]], block: np.ndarray) -> np.ndarray:
    """Scores of each sparse query (term, weight) against the rows of ``block``, a term at a time."""
    terms: dict[int, list[tuple[int, int]]] = {}
    for i, row in enumerate(queries):
        for term, weight in row:
            terms.setdefault(term, []).append((i, weight))
    highest = np.abs(block.astype(np.float64)).max(axis=0, initial=0.0)
    most = max((sum(abs(w) * highest[t] for t, w in row) for row in queries), default=0.0)
    kind = np.int64 if most < 2.0**62 else object
    if kind is object:
        block = block.astype(object)
    scores = np.zeros((len(queries), len(block)), dtype=kind)
    for term, users in terms.items():
        posting = np.flatnonzero(block[:, term])
        if not len(posting):
            continue
        who, weights = np.array([u for u, _ in users]), np.array([w for _, w in users], dtype=kind)
        part = weights[:, None] * block[posting, term][None, :]
        if len(posting) == len(block) and len(who) == len(queries):
            scores += part
        else:
            scores[np.ix_(who, posting)] += part
    return scores if kind is np.int64 else np.clip(scores, -LIMIT, LIMIT).astype(np.int64)


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _pair(asked: pa.Table, offered: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one candidate block for each query of one query block, copies included."""
    qids = asked["vec_id"].to_numpy()
    ids, copies = offered["vec_id"].to_numpy(), np.minimum(offered["n"].to_numpy(), k)
    vectors = asked["v"].to_pylist()
    sparse = [[(t, w) for t, w in enumerate(v) if w] for v in vectors]
    width = max(map(len, vectors))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
    for at in range(0, len(ids), BLOCK):
        part = slice(at, at + BLOCK)
        block = _dense(offered["v"].slice(at, BLOCK), width)
        for q in range(0, len(qids), 512):
            for i, line in enumerate(accumulate(sparse[q : q + 512], block), q):
                other = np.flatnonzero(ids[part] != qids[i])
                best = other[select(ids[part][other], line[other], k)]
                times = copies[part][best]
                both = np.concatenate([held[i][0], np.repeat(ids[part][best], times)]), np.concatenate([held[i][1], np.repeat(line[best], times)])
                keep = select(*both, k)
                held[i] = both[0][keep], both[1][keep]
    sizes = [len(a) for a, _ in held]
    return np.repeat(qids, sizes), np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def top(queries: DataFrame, candidates: DataFrame, k: int = TOP, rows: int = ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` from frames of ``vec_id, v`` (array<bigint>)."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    offered = candidates.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda df: max(1, -(-df.count() // rows))
    n_asked, n_offered = blocks(queries.select("vec_id").distinct()), blocks(candidates)

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        mine = df.withColumn(names[0], F.pmod(F.xxhash64("vec_id", "v"), F.lit(own)))
        return mine.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1)).cast("array<bigint>")))

    def search(asked: pa.Table, offered: pa.Table) -> pa.Table:
        if not asked.num_rows or not offered.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        return pa.table([pa.array(x, pa.int64()) for x in _pair(asked, offered, k)], names=["query_id", "vec_id", "score"])

    left, right = dealt(asked, n_asked, n_offered, ("q", "c")), dealt(offered, n_offered, n_asked, ("c", "q"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_search(spark, sf_dir: str) -> DataFrame:
    ready = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top(ready.where("vec_id % 100 = 0"), ready)


OP8_SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
