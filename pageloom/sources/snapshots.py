"""Stored pages: run directories as written by a crawler, and page tables.

A run directory holds ``page.html`` and ``meta.json``, crawled pages under
``pages/NNN.html``, detail pages under ``detail/<hash>.html`` (each with a
``.meta.json``), an ordered ``manifest.json`` and the run record ``run.json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import sha_prefix
from ..model import SPEC_SCHEMA

META_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("requested_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("rendered", T.BooleanType()),
    ]
)
_ENTRY = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("file", T.StringType())]))
MANIFEST_SCHEMA = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("pages", _ENTRY), T.StructField("detail", _ENTRY)]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("spec", SPEC_SCHEMA),
    ]
)
_PAGE_FILE = r"/([^/]+)/(page\.html|pages/[^/]+\.html|detail/[^/]+\.html)\z"


def _files(spark: SparkSession, root: str, glob: str, schema: T.StructType) -> DataFrame:
    found = spark.read.schema(schema).json(
        root, multiLine=True, recursiveFileLookup=True, pathGlobFilter=glob
    )
    return found.select("*", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))


def _kind(file: Column) -> Column:
    return F.when(F.startswith(file, F.lit("detail/")), F.lit("detail")).otherwise(F.lit("page"))


def read_run_pages(spark: SparkSession, root: str) -> DataFrame:
    """Every stored page below ``root`` with its fetch metadata.

    ``page_id, run_id, kind, file, html`` and the metadata columns; a page without a
    metadata file has NULLs there. ``page_id`` hashes run and file.
    """
    html = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    pages = html.select(
        F.col("value").alias("html"),
        F.regexp_extract(path, _PAGE_FILE, 1).alias("run_id"),
        F.regexp_extract(path, _PAGE_FILE, 2).alias("file"),
    ).where(F.col("file") != "")
    meta = _files(spark, root, "*meta.json", META_SCHEMA)
    meta_file = r"/([^/]+)/(meta\.json|pages/[^/]+\.meta\.json|detail/[^/]+\.meta\.json)\z"
    name = F.regexp_extract("path", meta_file, 2)
    meta = meta.select(
        *META_SCHEMA.names,
        F.regexp_extract("path", meta_file, 1).alias("run_id"),
        F.when(name == "meta.json", F.lit("page.html")).otherwise(F.regexp_replace(name, r"\.meta\.json\z", ".html")).alias("file"),
    )
    return pages.join(meta, ["run_id", "file"], "left").select(
        F.xxhash64("run_id", "file").alias("page_id"), "run_id", _kind(F.col("file")).alias("kind"), "file",
        "html", *META_SCHEMA.names,
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Ordered crawl entries of all manifests: ``run_id, kind, seq, url, file``."""
    raw = _files(spark, root, "manifest.json", MANIFEST_SCHEMA).withColumn(
        "run_id", F.regexp_extract("path", r"/([^/]+)/manifest\.json\z", 1)
    )

    def entries(column: str, kind: str) -> DataFrame:
        return raw.select("run_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("seq", "e")).select(
            "run_id", "kind", "seq", "e.url", "e.file"
        )

    return entries("pages", "page").unionByName(entries("detail", "detail"))


def crawl_entries(run_pages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifest entries, or the single stored page for a run without a manifest."""
    have = manifests.select("run_id").distinct()
    single = run_pages.where(F.col("file") == "page.html").join(have, "run_id", "left_anti")
    return manifests.unionByName(
        single.select("run_id", F.lit("page").alias("kind"), F.lit(0).alias("seq"), "url", "file")
    )


def replay_limits(entries: DataFrame) -> DataFrame:
    """Page and detail limits of a replay: the stored counts, ``run_id, max_pages, max_detail``."""
    return entries.groupBy("run_id").agg(
        F.greatest(F.count_if(F.col("kind") == "page"), F.lit(1)).alias("max_pages"),
        F.count_if(F.col("kind") == "detail").alias("max_detail"),
    )


def replay_pages(entries: DataFrame, run_pages: DataFrame) -> DataFrame:
    """Entries with their stored html; an entry whose file is gone has ``missing_page``."""
    stored = run_pages.select("run_id", "file", "page_id", "html")
    joined = entries.join(stored, ["run_id", "file"], "left")
    return joined.withColumn("missing_page", F.col("html").isNull())


def stored_specs(spark: SparkSession, root: str) -> DataFrame:
    """Specs kept in run records: ``run_id, target_name, model, spec_json`` (NULL without a spec)."""
    runs = _files(spark, root, "run.json", RUN_SCHEMA)
    return runs.select(
        F.coalesce("run_id", F.regexp_extract("path", r"/([^/]+)/run\.json\z", 1)).alias("run_id"),
        "target_name", "model", F.to_json("spec").alias("spec_json"),
    )


def page_file(kind: Column, seq: Column, url: Column) -> Column:
    """File name of a stored page: page.html, pages/NNN.html or detail/<hash>.html (seq from 0)."""
    number = (seq + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return (
        F.when(kind == "detail", F.concat(F.lit("detail/"), sha_prefix(url, 8), F.lit(".html")))
        .when(seq == 0, F.lit("page.html"))
        .otherwise(F.concat(F.lit("pages/"), padded, F.lit(".html")))
    )


def manifest_entries(crawled: DataFrame) -> DataFrame:
    """Manifest rows of a crawl: ``run_id, kind, seq, url, file`` from run_id, kind, seq, url.

    Kept as rows, not as one list per run, so the size of a crawl does not matter.
    """
    return crawled.select(
        "run_id", "kind", "seq", "url", page_file(F.col("kind"), F.col("seq"), F.col("url")).alias("file")
    )


def save_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Append pages as Parquet, one directory per fetch day.

    A directory per run would mean millions of tiny files; run_id stays a column,
    and rows are clustered by it inside each file for statistics-based skipping.
    """
    day = F.coalesce(F.to_date(F.substring(F.col("fetched_at"), 1, 10)), F.lit("1970-01-01").cast("date"))
    pages.withColumn("day", day).sortWithinPartitions("day", "run_id").write.mode(mode).partitionBy("day").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append run records, rows, links or verdicts as Parquet."""
    df.write.mode(mode).parquet(path)


def save_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Valid rows as JSON lines, NULL fields kept."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
