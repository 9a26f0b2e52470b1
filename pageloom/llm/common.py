"""Helpers the operators share: tables, stored intermediates, samples, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.session import cut_lineage

#: Bytes of a batch and of a part of one, fineness of a sample's share, edges to a part of a round of ``components``.
BYTES, SHARES, EDGES = 4 << 20, 1 << 50, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Compressed, splittable and free of lineage; used for wide intermediates that are read
    more than once. Without ``spark.checkpoint.dir`` (tests) it is a reliable checkpoint.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        return cut_lineage(df)
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator], schema: str, rows: int | None = None) -> DataFrame:
    """Apply ``work`` to each Arrow batch, cut to ``rows`` rows if given; it yields dicts of column name to values."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for out in (out for batch in batches for part in sliced(batch, rows) for out in work(part)):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for f, v in ((f, out[f.name]) for f in target)], schema=target)

    return in_batches(df, run, schema)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, by the session's setting in batches of at most ``BYTES`` bytes, or one row.

    Spark's own bound is 64 MB, which the executor and its Python worker both hold for each task.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and ``BYTES`` bytes (or one row), which bound what a task holds of long texts at once."""
    if not batch.num_rows or rows is None or (batch.num_rows <= rows and batch.nbytes <= BYTES) or batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from sliced(batch.slice(0, half), rows)
    yield from sliced(batch.slice(half), rows)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    fields = [part.strip().split(" ") for part in ddl.split(",")]
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in fields])


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``by``: the same ones in every run. Rows that agree in ``by`` count once in a sample."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(SHARES)) < SHARES * rows // total).dropDuplicates(list(by))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``gone``: doc_id and ``h``, the xxhash64 of id and text."""
    named = gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("doc_id").cast("bigint"), "text") == F.col("_h"))
    return docs.join(named, same, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node reachable) for every node of ``edges`` (a, b: bigint).

    Alternating large-star and small-star steps; each is an aggregate that combines before
    the shuffle and one join, and each round's edges are checkpointed, in as many parts as their
    number asks for: a part is a file, and a task of the next round. Hubs are left to the
    adaptive skew join. Self loops and repeated edges are allowed.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        # A round makes at most two edges of one.
        parts = max(cores, -(-2 * mark[0] // EDGES))
        e = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().coalesce(parts))
    leaf = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return leaf.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over positions of one task's block; keeps only a spanning forest."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        own = [(i, self.find(i)) for i in range(len(self.parent))]
        return [i for i, r in own if i != r], [r for i, r in own if i != r]


def paired_blocks(df: DataFrame, key: str, row: str, size: int) -> DataFrame:
    """Deal the rows of each ``key`` into pairs of blocks of about ``size`` rows.

    A key of at most ``size`` rows is one item. A larger one is cut into c blocks by a hash
    of ``row``; each row goes to the c items that pair its block with each block, so that every
    two rows of a key meet in an item and no item outgrows two blocks. The keys that are cut are
    broadcast: one for ``size`` rows at most. Adds ``item`` (bigint) and ``mine`` / ``other`` (the
    row's block and the block it is paired with).
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    c = F.coalesce(F.ceil(F.col("_n") / size).cast("int"), F.lit(1))
    dealt = df.join(F.broadcast(counts), key, "left").withColumn("_c", c).drop("_n")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(row), F.col("_c")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_c")
    return dealt.withColumn("item", F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")))
