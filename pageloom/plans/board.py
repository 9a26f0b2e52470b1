"""Job-board pages rendered from relational rows with Spark.

The given pages have no structured data, cards or next links. Rendering orders as a
job board and reading them back gives pages whose right answer is a plain query on
the orders. A page is one priority and one block of 100 order keys; ten blocks form a
chain of next links. No row number is needed, so no task sees a whole board.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import html_escape
from ..model import ExtractionSpec, FieldRule

SITE = "https://jobs.example.com"
BLOCK = 100
CHAIN = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A scan with fewer splits than cores is spread out first: the
    page jobs spend their time on computing, not on reading. Large tables are left alone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job card per order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("o_orderkey")
    day = F.col("o_orderdate")
    low = F.floor("o_totalprice")
    layouts = ["yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy"]
    posted = F.date_format(day, layouts[0])
    for i in (1, 2, 3):
        posted = F.when(key % 4 == i, F.date_format(day, layouts[i])).otherwise(posted)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("key"),
        F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "-")).alias("board"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("board_no"),
        F.floor(key / BLOCK).alias("block"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(" & "), F.col("o_orderstatus"), F.lit(" <ops>")).alias("title"),
        F.col("c_name").alias("company"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("location"),
        low.alias("salary_min"),
        (low + 1000).alias("salary_max"),
        posted.alias("posted"),
        F.date_format(day, "yyyy-MM-dd").alias("posted_day"),
        F.concat(F.lit("/jobs/"), key.cast("string")).alias("path"),
    )


def _tag(name: str, cls: str, text: Column) -> Column:
    return F.concat(F.lit(f'<{name} class="{cls}">'), text, F.lit(f"</{name}>"))


def card_html(card_class: Column | None = None, company: Column | None = None, title: Column | None = None,
              link: Column | None = None) -> Column:
    """Markup of one card; the arguments replace parts of it for damaged or changed pages."""
    salary = F.concat(
        F.lit("from $"), F.format_number("salary_min", 0), F.lit(" to $"), F.format_number("salary_max", 0)
    )
    default_link = F.concat(F.lit('<a class="more" href="'), F.col("path"), F.lit('">Details</a>'))
    return F.concat(
        F.lit('<li class="'), card_class if card_class is not None else F.lit("opening"),
        F.lit('" data-no="'), F.col("key").cast("string"), F.lit('">'),
        _tag("h2", "role", F.concat(F.lit("\n  "), title if title is not None else html_escape(F.col("title")), F.lit(" "))),
        _tag("b", "employer", company if company is not None else html_escape(F.col("company"))),
        F.coalesce(_tag("em", "place", html_escape(F.col("location"))), F.lit("")),
        _tag("small", "pay", salary),
        _tag("div", "note", F.concat(F.lit("No. "), F.col("key").cast("string"), F.lit(", listed "), F.col("posted"))),
        link if link is not None else default_link,
    )


def card_jsonld() -> Column:
    return F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        F.col("title"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.array(F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address"))).alias("jobLocation"),
        F.struct(F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue")).alias("baseSalary"),
        F.col("path").alias("url"),
        F.col("posted_day").alias("datePosted"),
    )


def board_url(board: Column, block: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/"), board, F.lit("/page/"), block.cast("string"))


def render(job_cards: DataFrame, markup: Column | None = None, with_jsonld: bool = True) -> DataFrame:
    """Board pages ``page_id, url, html, board, block`` from cards.

    A page lists its cards by key. Odd blocks wrap their JSON-LD in a graph. The last
    page of a chain has no next link.
    """
    parts = [(markup if markup is not None else card_html()).alias("html"), *([card_jsonld().alias("ld")] if with_jsonld else [])]
    packed = job_cards.select("board", "board_no", "block", F.struct("key", *parts).alias("card"))
    pages = packed.groupBy("board", "board_no", "block").agg(F.sort_array(F.collect_list("card")).alias("cards"))
    script = F.lit("")
    if with_jsonld:
        ld = F.transform("cards", lambda c: c["ld"])
        block_text = F.when(F.col("block") % 2 == 0, F.to_json(ld)).otherwise(
            F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), ld.alias("@graph")))
        )
        script = F.concat(F.lit('<script type="application/ld+json">'), block_text, F.lit("</script>"))
    following = F.when(
        F.col("block") % CHAIN != CHAIN - 1,
        F.concat(F.lit('<a class="next" href="/'), F.col("board"), F.lit("/page/"), (F.col("block") + 1).cast("string"), F.lit('">Next</a>')),
    ).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Jobs  – '), F.col("board"),
        F.lit("</title><style>.x{margin:0}</style><script>var t='<li class=\"opening\">';</script>"), script,
        F.lit('</head><body><nav><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><!-- <li class="opening">old</li> --><ol class="openings" id="board">'),
        F.array_join(F.transform("cards", lambda c: c["html"]), ""),
        F.lit("</ol>"), following, F.lit("<footer>&copy; jobs.example.com</footer></body></html>"),
    )
    return pages.select(
        (F.col("block") * 10 + F.col("board_no")).alias("page_id"),
        board_url(F.col("board"), F.col("block")).alias("url"), html.alias("html"), "board", "block",
    )


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(cards(spark, sf_dir))


def detail_pages(job_cards: DataFrame) -> DataFrame:
    """One detail page per card: ``page_id, url, html``."""
    text = F.concat(
        F.lit('<html><head><title>'), html_escape(F.col("title")),
        F.lit('</title></head><body><h1>'), html_escape(F.col("title")),
        F.lit('</h1><div class="about">Work for <b>'), F.col("company"), F.lit("</b> on request "),
        F.col("key").cast("string"), F.lit('.</div><em class="place">Remote</em></body></html>'),
    )
    return job_cards.select(
        F.col("key").alias("page_id"), F.concat(F.lit(SITE), F.col("path")).alias("url"), text.alias("html")
    )


R = FieldRule
CSS_SPEC = ExtractionSpec(
    field_rules=(
        R("title", "h2.role", "css", transform="collapse_ws"),
        R("company", "b.employer", "css", "text", "trim"),
        R("location", "em.place", "css", transform="trim", optional=True),
        R("salary_min", "small.pay", "css", transform="int"),
        R("salary_max", r"to \$([\d,]+)", "regex", transform="int"),
        R("url", "a.more", "css", "href", "abs_url"),
        R("posted_at", r"listed ([^<]+)<", "regex", transform="iso_date"),
    ),
    container_selector="ol.openings > li.opening",
    next_page_selector="a.next",
)
XPATH_SPEC = ExtractionSpec(
    field_rules=(
        R("title", ".//h2[@class='role']", "xpath", transform="collapse_ws"),
        R("company", "./b[1]", "xpath", transform="trim"),
        R("location", ".//em[@class='place']", "xpath"),
        R("salary_min", ".//small[contains(@class,'pay')]", "xpath", transform="int"),
        R("salary_max", r"to \$([\d,]+)", "regex", transform="int"),
        R("url", ".//a[@class='more']/@href", "xpath", transform="abs_url"),
        R("posted_at", r"listed (?P<day>[^<]+)<", "regex", transform="iso_date"),
    ),
    container_selector="//ol[@id='board']/li",
    container_selector_type="xpath",
    next_page_selector="//a[@class='next']",
    next_page_selector_type="xpath",
)
JSONLD_SPEC = ExtractionSpec(
    field_rules=(
        R("title", "title", "json_ld"),
        R("company", "hiringOrganization.name", "json_ld"),
        R("location", "jobLocation.address.addressLocality", "json_ld"),
        R("salary_min", "baseSalary.minValue", "json_ld", transform="int"),
        R("salary_max", "baseSalary.maxValue", "json_ld", transform="int"),
        R("url", "url", "json_ld", transform="abs_url"),
        R("posted_at", "datePosted", "json_ld", transform="iso_date"),
    ),
    container_selector="JobPosting",
    container_selector_type="json_ld",
)
DETAIL_RULES = (
    R("description", "div.about", "css", transform="collapse_ws"),
    R("location", "em.place", "css"),
)
#: Specs that fail on the boards: one finds nothing, one lacks the company.
BROKEN_SPEC = ExtractionSpec(CSS_SPEC.field_rules, "div.nothing")
WEAK_SPEC = ExtractionSpec(tuple(R("company", "b.nobody", "css") if r.field == "company" else r for r in CSS_SPEC.field_rules), "ol.openings > li")
