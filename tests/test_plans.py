"""Plans keep their shape: page-local work does not shuffle, scans read what they need."""

from pyspark.sql import functions as F

from pageloom.operators.extract import extract
from pageloom.operators import jsonld
from pageloom.operators.fingerprint import fingerprints
from pageloom.operators.rendering import needs_render
from pageloom.operators.summary import page_summary
from pageloom.operators.validate import check_rows
from pageloom.model import JOB_POSTINGS
from pageloom.plans.board import CSS_SPEC, JSONLD_SPEC, cards, render

PAGES = "/root/testdata/sf0.001/pages.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_local_work_has_no_shuffle(spark):
    pages = spark.read.parquet(PAGES)
    checked = check_rows(extract(pages, CSS_SPEC), JOB_POSTINGS, ("page_id", "row_no"))
    for df in (checked, extract(pages, JSONLD_SPEC), fingerprints(pages), page_summary(pages), needs_render(pages)):
        text = plan(df)
        assert "Exchange" not in text and text.count("FileScan") == 1


def test_structured_data_needs_no_python(spark):
    assert "MapInArrow" not in plan(extract(spark.read.parquet(PAGES), JSONLD_SPEC))


def test_blocks_of_a_page_are_looked_for_once(spark):
    pages = spark.read.parquet(PAGES)
    for df in (jsonld.explode_objects(pages), extract(pages, JSONLD_SPEC)):
        assert plan(df).count("regexp_extract_all") == 1


def test_pages_without_structured_data_do_not_move_it(spark):
    assert "JobPosting" not in plan(render(cards(spark, "/root/testdata/sf0.001"), with_jsonld=False))


def test_filters_and_columns_reach_the_scan(spark):
    pages = spark.read.parquet(PAGES).withColumn("extra", F.lit(1))
    text = plan(fingerprints(pages.where("page_id > 7")))
    assert "GreaterThan(page_id,7)" in text and "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text
