"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are words, runs of marks, and pairs of neighbours, hashed to ``BUCKETS`` buckets. The raw model counts all
documents, the target model a bounded sample of documents labelled good. A document's log ratio is the mean over its features of
log target - log raw frequency. ``k`` is the number of documents at or above the cut that best separates the labelled sample
(true rate less false rate); the k largest of log ratio / ``TEMPERATURE`` plus Gumbel noise, drawn from a hash of id and text, are kept.

Documents without features (null, empty) have ratio 0 and take part. Equal keys at the cut (repeated rows) are all kept. Without
labels of both kinds everything is kept. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_map, bounded_sample, in_batches, stored, table, without
from pageloom.llm.hashing import mixed, span_hashes

BUCKETS, SAMPLE, TEMPERATURE = 1 << 16, 20_000, 0.002
#: Classes of bytes: 0 space, 1 word (letters, digits, bytes of other alphabets), 2 marks.
KIND = np.full(256, 2, dtype=np.int8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[np.r_[48:58, 65:91, 97:123, 128:256]] = 1


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    kind = np.zeros(len(raw) + 2, dtype=np.int8)
    kind[1:-1] = KIND[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(kind))
    if not len(edge):
        return np.zeros(0, dtype=np.int64)
    starts = edge[kind[edge + 1] != 0]
    ends = edge[kind[edge] != 0]
    one = span_hashes(raw, starts, ends)
    two = mixed(one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:])
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Feature counts over all of ``docs``: one dense array per task, summed by bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at, n = np.unique(features(t, buckets), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    out = np.zeros(buckets)
    for r in in_batches(docs.select("text"), run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def ratios(docs: DataFrame, target: np.ndarray, raw: np.ndarray) -> DataFrame:
    """``doc_id, log_ratio, gumbel`` of every row of ``docs``."""
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + len(c)))
    shared = docs.sparkSession.sparkContext.broadcast(smooth(target) - smooth(raw))

    def work(batch):
        weights, out = shared.value, []
        for t in batch.column(1).to_pylist():
            f = features(t, len(weights))
            out.append(float(weights[f].mean()) if len(f) else 0.0)
        yield {"doc_id": batch.column(0), "log_ratio": out, "h": batch.column(2)}

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("h"))
    out = arrow_map(rows, work, "doc_id bigint, log_ratio double, h bigint")
    uniform = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    return out.select("doc_id", "log_ratio", "h", (-F.log(-F.log(uniform))).alias("gumbel"))


def cut_of(labelled: DataFrame) -> float:
    """The log ratio that best separates good from bad in a bounded sample; minus infinity without both kinds."""
    rows = labelled.select("log_ratio", "quality").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    if not len(x) or y.min() == y.max():
        return float("-inf")
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    gain = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()
    i = int(np.argmax(gain))
    return float((x[i] + x[min(i + 1, len(x) - 1)]) / 2)


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, log_ratio, key, kept, h`` of every row; ``h`` tells repeated ids with other texts apart."""
    marks = bounded_sample(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), SAMPLE, "doc_id")
    good = docs.join(marks.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    found = stored(ratios(docs, counts(good), counts(docs)).withColumn("key", F.col("log_ratio") / TEMPERATURE + F.col("gumbel")))
    cut = cut_of(found.join(marks, "doc_id"))
    k = found.where(F.col("log_ratio") >= cut).count()
    return found.withColumn("kept", F.col("key") >= threshold(found, k)).select("doc_id", "log_ratio", "key", "kept", "h")


def threshold(found: DataFrame, k: int) -> float:
    """The k-th largest ``key``, exactly, from counts of ever finer ranges: no sort, no single task."""
    low, high = found.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    if k >= found.count():
        return float("-inf")
    while True:
        inside = found.where(F.col("key").between(low, high))
        if high <= low:
            return low
        step = (high - low) / 1024
        slot = F.least(F.floor((F.col("key") - low) / step), F.lit(1023)) if step > 0 else F.lit(0)
        rows = sorted(inside.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True)
        above = found.where(F.col("key") > high).count()
        for r in rows:
            if above + r.n >= k:
                if r.a == r.b or (r.a, r.b) == (low, high):
                    return r.a
                low, high = r.a, r.b
                break
            above += r.n


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the resampling rejects."""
    return without(docs, resampled(docs.select("doc_id", "text"), labels).where(~F.col("kept")).select("doc_id", "h"))


def op1_importance(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")
