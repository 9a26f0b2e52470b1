"""The spec registry: lookups, the reuse-or-drift decision, and upserts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import sha_prefix
from ..functions.transforms import TRANSFORMS
from ..model import SELECTOR_TYPES, SPEC_SCHEMA, ExtractionTarget
from ..session import cut_lineage, written
from .extract import extract_assigned
from .programs import compiled
from .skew import latest, spread_join
from .validate import check_rows, run_quality

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("spec_json", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
    ]
)


def cache_key(url: Column, target: Column) -> Column:
    """Registry key of a page url and a target; NULL when the page has no url."""
    return F.when(
        F.coalesce(url, F.lit("")) != "", sha_prefix(F.concat(url, F.char(F.lit(0)), target))
    )


def readable_spec(spec_json: Column) -> Column:
    """Does the stored JSON hold a spec that would load?"""
    spec = F.from_json(spec_json, SPEC_SCHEMA, {"mode": "PERMISSIVE"})
    rule_ok = lambda r: (
        r["field"].isNotNull() & r["selector"].isNotNull() & F.coalesce(r["selector_type"].isin(*SELECTOR_TYPES), F.lit(False))
    )
    return (
        F.coalesce(F.forall(spec["field_rules"], rule_ok), F.lit(False))
        & F.coalesce(spec["container_selector_type"], F.lit("css")).isin(*SELECTOR_TYPES)
        & F.coalesce(spec["next_page_selector_type"], F.lit("css")).isin("css", "xpath")
        & F.coalesce(F.forall(F.coalesce(spec["detail_field_rules"], F.expr("array()").cast(SPEC_SCHEMA["detail_field_rules"].dataType)), rule_ok), F.lit(True))
    )


def lookup(prints: DataFrame, registry: DataFrame, target_name: str) -> DataFrame:
    """Attach the registry entry of every page as ``entry`` (NULL on a miss).

    ``prints`` is narrow (page_id, url, fingerprint, …). An unreadable entry is a miss.
    A url that holds a large share of the pages is salted.
    """
    # Checkpointed: the hot-key count and the join both read it, and it ends a heavy plan.
    keyed = cut_lineage(prints.withColumn("cache_key", cache_key(F.col("url"), F.lit(target_name))))
    rest = [c for c in registry.columns if c != "cache_key"]
    entries = registry.where((F.col("target_name") == target_name) & readable_spec(F.col("spec_json"))).select(
        "cache_key", F.struct(*rest).alias("entry")
    )
    return spread_join(keyed, entries, ["cache_key"], by=["page_id"])


def cache_status(
    validates: Column, fingerprint: Column, entry: Column, use_cache: bool = True, refresh: bool = False
) -> Column:
    """'disabled', 'miss', 'hit' or 'drift_regenerated' for one page."""
    if not use_cache:
        return F.lit("disabled")
    return (
        F.when(entry.isNull(), F.lit("miss"))
        .when(F.lit(refresh) | ~entry["fingerprint"].eqNullSafe(fingerprint), F.lit("drift_regenerated"))
        .when(F.coalesce(validates, F.lit(False)), F.lit("hit"))
        .otherwise(F.lit("drift_regenerated"))
    )


def with_spec_id(df: DataFrame) -> DataFrame:
    return df.withColumn("spec_id", sha_prefix(F.col("spec_json")))


def spec_errors(assigned: DataFrame, target: ExtractionTarget) -> DataFrame:
    """``spec_id, spec_error`` of the distinct specs that cannot be run."""
    return compiled(assigned, target.cardinality, SELECTOR_TYPES, tuple(TRANSFORMS)).where("spec_error is not null").select("spec_id", "spec_error")


def evaluate_assigned(
    pages: DataFrame,
    assigned: DataFrame,
    target: ExtractionTarget,
    keys: tuple[str, ...] = (),
    as_of: dt.date | None = None,
) -> DataFrame:
    """Run the spec assigned to each page and judge the page's rows.

    ``assigned`` has ``page_id, spec_id, spec_json`` and the ``keys`` that tell apart
    several assignments of one page. One verdict per (page_id, *keys); a spec that cannot be
    run yields no rows.
    """
    run_keys = ("page_id", *keys)
    rows = extract_assigned(pages, assigned, [f.name for f in target.fields], target.cardinality, as_of, keep=keys)
    checked = check_rows(rows, target, run_keys)
    return run_quality(checked, assigned, target, run_keys)


def decide(
    pages: DataFrame,
    found: DataFrame,
    target: ExtractionTarget,
    use_cache: bool = True,
    refresh: bool = False,
    as_of: dt.date | None = None,
) -> DataFrame:
    """``found`` (see ``lookup``) with ``cache_status``; only unchanged pages are re-run."""
    if not use_cache or refresh:
        return found.withColumn(
            "cache_status", cache_status(F.lit(None).cast("boolean"), F.col("fingerprint"), F.col("entry"), use_cache, refresh)
        )
    found = cut_lineage(found)
    unchanged = with_spec_id(
        found.where(F.col("entry.fingerprint") == F.col("fingerprint")).select(
            "page_id", F.col("entry.spec_json").alias("spec_json")
        )
    )
    verdicts = evaluate_assigned(pages, unchanged, target, as_of=as_of).select("page_id", F.col("ok").alias("_ok"))
    return found.join(verdicts, "page_id", "left").withColumn(
        "cache_status", cache_status(F.col("_ok"), F.col("fingerprint"), F.col("entry"))
    ).drop("_ok")


def touched(decided: DataFrame, now: dt.datetime) -> DataFrame:
    """Registry rows of the hits with ``last_seen_at`` moved to ``now``."""
    hits = decided.where(F.col("cache_status") == "hit").select("cache_key", "entry.*")
    return hits.withColumn("last_seen_at", F.lit(now)).select(*REGISTRY_SCHEMA.names)


def stored(working: DataFrame, registry: DataFrame, target_name: str, now: dt.datetime) -> DataFrame:
    """Registry rows for newly found specs that validate (``ok``).

    ``working``: page_id, url, fingerprint, model, spec_json, run_id, tokens_in,
    tokens_out, ok. A known key keeps its ``created_at``; a page without url is not stored.
    """
    good = working.where("ok").withColumn("cache_key", cache_key(F.col("url"), F.lit(target_name))).where(
        F.col("cache_key").isNotNull()
    )
    known = registry.select("cache_key", F.col("created_at").alias("_created"))
    return (
        spread_join(good, known, ["cache_key"], by=["page_id"])
        .withColumn("target_name", F.lit(target_name))
        .withColumn("created_at", F.coalesce(F.col("_created"), F.lit(now)))
        .withColumn("last_seen_at", F.lit(now))
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REGISTRY_SCHEMA.fields])
    )


def upsert(registry: DataFrame, *changes: DataFrame) -> DataFrame:
    """Merge changes into the registry; the latest ``last_seen_at`` per key wins, then the latest change."""
    frames = [registry, *changes]
    merged = None
    for generation, frame in enumerate(frames):
        part = frame.select(*REGISTRY_SCHEMA.names, F.lit(generation).alias("_gen"))
        merged = part if merged is None else merged.unionByName(part)
    newest = latest(merged, ["cache_key"], [F.col("last_seen_at"), F.col("_gen"), F.col("run_id")])
    return newest.drop("_gen")


def write_registry(registry: DataFrame, path: str, version: int) -> None:
    """Write a full registry generation beside the older ones."""
    registry.write.mode("errorifexists").parquet(f"{path}/version={version:08d}")


def read_registry(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path}/version={version:08d}")


#: One row per committed version: the parts of every bucket, oldest first.
COMMIT_SCHEMA = "version bigint, buckets int, parts array<struct<bucket: int, part: string>>"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def head(spark, path: str, version: int | None = None):
    """The newest commit (not above ``version``), or None: ``version, buckets, parts``; as many parts as ``buckets`` times ``depth`` at most."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is not None:
        commits = commits.where(F.col("version") <= version)
    return commits.orderBy(F.desc("version"), "parts").first()


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key out of several parts; part names begin with their version."""
    return latest(rows, ["cache_key"], [F.col("last_seen_at"), F.col("part"), F.col("run_id")])


def _parts(spark, path: str, parts: list) -> DataFrame:
    schema = T.StructType([*REGISTRY_SCHEMA.fields, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/part={p.part}/bucket={p.bucket}" for p in parts]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)


def _split(parts: list) -> tuple[list, list]:
    """The parts of buckets that have one, and of those that have several."""
    count: dict[int, int] = {}
    for p in parts:
        count[p.bucket] = count.get(p.bucket, 0) + 1
    return [p for p in parts if count[p.bucket] == 1], [p for p in parts if count[p.bucket] > 1]


def read_store(spark, path: str, version: int | None = None) -> DataFrame:
    """The registry as of a committed version (the newest if none is given).

    Buckets of one part are read as they are; only those with several are merged by key.
    """
    commit = head(spark, path, version)
    single, several = _split(commit.parts if commit else [])
    rows = _parts(spark, path, single)
    return rows.unionByName(_newest(_parts(spark, path, several))).select(*REGISTRY_SCHEMA.names) if several else rows.select(*REGISTRY_SCHEMA.names)


def commit_store(spark, path: str, *changes: DataFrame, buckets: int = 64, depth: int = 8) -> int:
    """Add changes to a stored registry and return the new version; the precedence is that of ``upsert``.

    Only changed rows are written, as a new part of each bucket they fall into. A bucket that has ``depth`` parts is merged
    into one instead, so a row is rewritten once in ``depth`` commits that touch its bucket. Files come first and the commit, one row
    in one file, last: what a lost writer leaves is named by no commit, and a repeated call starts a new part. The number of
    ``buckets`` is that of the first commit for good. Writers take turns; readers need not wait, since a part never changes.
    """
    last = head(spark, path)
    version, parts, buckets = (last.version + 1, list(last.parts), last.buckets) if last else (1, [], buckets)
    name = f"{version:012d}-{uuid.uuid4().hex}"
    keyed = upsert(spark.createDataFrame([], REGISTRY_SCHEMA), *changes).withColumn("bucket", bucket_of(F.col("cache_key"), buckets))
    fresh = written(keyed)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    held: dict[int, int] = {}
    for p in parts:
        held[p.bucket] = held.get(p.bucket, 0) + 1
    full = sorted(b for b in touched if held.get(b, 0) >= depth)
    rows = fresh
    if full:
        whole = F.col("bucket").isin(full)
        merged = _newest(_parts(spark, path, [p for p in parts if p.bucket in full]).unionByName(fresh.where(whole).withColumn("part", F.lit(name))))
        rows = fresh.where(~whole).unionByName(merged.select(*fresh.columns))
    rows.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "cache_key"), F.lit(4))).write.partitionBy("bucket").parquet(f"{path}/data/part={name}")
    kept = [(p.bucket, p.part) for p in parts if p.bucket not in full] + [(b, name) for b in sorted(touched)]
    spark.createDataFrame([(version, buckets, kept)], COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/commits")
    return version
