"""Apply the reuse-or-drift decision to pages as they land in a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import ExtractionTarget
from ..operators import registry as reg
from ..operators.fingerprint import fingerprints
from ..session import cut_lineage

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def decide_landed(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    output: str,
    target: ExtractionTarget,
    current_registry: Callable[[], DataFrame],
) -> StreamingQuery:
    """Decide newly landed Parquet pages and append ``page_id, url, fingerprint, cache_status``.

    Every trigger reads the registry generation of that moment. Output files are named
    by the batch id, so a batch that is retried after a failure replaces itself.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        found = reg.lookup(fingerprints(batch), current_registry(), target.name)
        decided = reg.decide(batch, found, target)
        decided.select("page_id", "url", "fingerprint", "cache_status").write.mode("overwrite").parquet(
            f"{output}/batch={batch_id}"
        )

    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(landing)
    return (
        stream.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def learn_landed(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    output: str,
    target: ExtractionTarget,
    store: str,
    propose: Callable[[DataFrame, DataFrame], DataFrame],
    clock: Callable[[], dt.datetime],
) -> StreamingQuery:
    """Decide landed pages and write back what was learnt, so that a url missed in one batch can be hit in the next.

    ``propose(pages, open)`` gives, for pages that are no hits, rows as ``registry.stored`` takes them. The stored registry at ``store``
    belongs to the stream: version n + 1 is what batch n left. A retried batch therefore decides on the version it saw the first
    time, and commits only if it had not, also after a restart from the checkpoint.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        known = reg.read_store(spark, store, batch_id)
        decided = cut_lineage(reg.decide(batch, reg.lookup(fingerprints(batch), known, target.name), target))
        decided.select("page_id", "url", "fingerprint", "cache_status").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        last = reg.head(spark, store)
        if last is None or last.version <= batch_id:
            working = propose(batch, decided.where("cache_status <> 'hit'"))
            now = clock()
            reg.commit_store(spark, store, reg.touched(decided, now), reg.stored(working, known, target.name, now))

    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(landing)
    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
