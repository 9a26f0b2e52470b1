"""The named queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions import transforms as tf
from ..functions.urls import host_of, http_url
from ..model import JOB_POSTINGS, ExtractionSpec, ExtractionTarget, FieldRule, ItemField
from ..operators import candidates as cand
from ..operators import crawl as cr
from ..operators import jsonld, policy
from ..operators import registry as reg
from ..operators import summary as sm
from ..operators.extract import extract, extract_assigned, extract_by_spec, next_links
from ..operators.fingerprint import fingerprints, template_census
from ..operators.rendering import needs_render
from ..operators.shred import dom_nodes
from ..operators.validate import check_rows, rejected_rows, row_errors, run_quality, valid_rows
from ..session import scratch, tune, written
from ..sources.snapshots import manifest_entries, replay_limits
from . import board as bd
from . import runs as rn

R = FieldRule
ITEM = ["title", "company", "location", "salary_min", "salary_max", "url", "posted_at"]
NOW = dt.datetime(2024, 6, 1, 12, 0, 0)
EARLIER = dt.datetime(2024, 1, 1, 0, 0, 0)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return bd.table(spark, sf, "pages")


def _time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ------------------------------------------------------------- given pages
def page_title(spark, sf):
    return sm.summary_source(_pages(spark, sf)).select("page_id", sm.title(F.col("nodes")).alias("title"))


def nav_links_abs(spark, sf):
    spec = ExtractionSpec(
        (R("label", "a", "css"), R("href", "a", "css", "href"), R("target", "a", "css", "href", "abs_url")), "nav li > a"
    )
    rows = extract(_pages(spark, sf).select("page_id", "url", "html"), spec)
    return rows.select("page_id", _long("row_no"), "label", "href", "target")


def regex_track_id(spark, sf):
    spec = ExtractionSpec((R("track", r"track\((\d+)\)", "regex", transform="int"),
                           R("lang", r'<html lang="(?P<l>\w+)"', "regex", transform="upper")))
    return extract(_pages(spark, sf), spec, "one").select("page_id", "track", "lang")


def ad_text(spark, sf):
    spec = ExtractionSpec((R("ad", ".ad", "css", transform="collapse_ws"),), "body > div.ad")
    return extract(_pages(spark, sf), spec).select("page_id", "ad")


def node_census(spark, sf):
    tags = ["a", "article", "b", "br", "div", "footer", "h1", "li", "nav", "p", "title", "ul"]
    nodes = dom_nodes(_pages(spark, sf), ("node_id", "tag"))
    return nodes.where(F.col("tag").isin(tags)).groupBy("tag").agg(F.count(F.lit(1)).alias("n_nodes"))


def repeating_groups(spark, sf):
    tree = sm.summary_source(_pages(spark, sf))
    groups = tree.select("page_id", F.posexplode(sm.repeating_groups(F.col("nodes"))).alias("rank", "g"))
    return groups.where(F.col("g.signature") == "li").select(
        "page_id", F.col("g.signature").alias("signature"), F.col("g.count").cast("bigint").alias("n_members"),
        F.get("g.exemplars", F.lit(0)).alias("first_exemplar"), F.get("g.exemplars", F.lit(1)).alias("second_exemplar"),
    )


def shell_pages(spark, sf):
    """Documents wrapped as application pages of three kinds."""
    docs = bd.table(spark, sf, "documents").select("doc_id", "text")
    body = F.concat(F.lit("<p>"), tx.html_escape(F.col("text")), F.lit("</p>"))
    kind = F.col("doc_id") % 3
    inner = (
        F.when(kind == 0, F.concat(F.lit('<div id="root"></div>'), body))
        .when(kind == 1, F.concat(F.lit('<div id="app">'), body, F.lit("</div>")))
        .otherwise(F.concat(F.lit('<div id="main"></div><noscript>Enable scripts</noscript><style>p{}</style>'), body))
    )
    return docs.select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://app.example.com/d/"), F.col("doc_id")).alias("url"),
        F.concat(F.lit("<html><head><title>Shell</title></head><body>"), inner, F.lit("<script>run()</script></body></html>")).alias("html"),
    )


def render_check(spark, sf):
    return needs_render(shell_pages(spark, sf)).select("page_id", "empty_mount", _long("text_chars"), "needs_render")


# ------------------------------------------------------------------- scalars
def transform_values(spark, sf):
    """All nine transforms over texts made from every order."""
    c = bd.cards(spark, sf)
    key, base = F.col("key"), F.lit("https://h.ex/a/b?q=1#f")
    price = F.concat(F.lit("from $"), F.format_number("salary_min", 0), F.lit(".75 – up"))
    refs = ["../up", "./here/../x", "?z=2", "//o.ex/p", "mailto:a@h.ex", "/root", ""]
    flags = ["Yes", " off ", "maybe", "TRUE", "0"]
    ref, flag = F.get(F.array(*map(F.lit, refs)), (key % len(refs)).cast("int")), F.get(F.array(*map(F.lit, flags)), (key % len(flags)).cast("int"))
    apply = lambda name, v: tf.apply_transform(name, v, base)
    return c.select(
        "key",
        apply("trim", F.concat(F.lit(" \t "), F.col("title"), F.lit(" \n"))).alias("trim"),
        apply("collapse_ws", F.concat(F.lit("  a\n\n"), F.col("company"), F.lit("\t b "))).alias("collapse_ws"),
        apply("lower", F.col("company")).alias("lower"),
        apply("upper", F.col("board")).alias("upper"),
        apply("int", price).alias("int"),
        apply("float", price).alias("float"),
        apply("iso_date", F.col("posted")).alias("iso_date"),
        apply("abs_url", ref).alias("abs_url"),
        apply("bool", flag).alias("bool"),
    )


def normalized_urls(spark, sf):
    """Output form of page urls written with odd case, a default port and raw spaces."""
    p = _pages(spark, sf)
    loud = F.concat(
        F.upper(F.regexp_extract("url", r"\A(https?://[^/?#]+)", 1)),
        F.when(F.startswith("url", F.lit("https:")), F.lit(":443")).otherwise(F.lit(":80")),
        F.regexp_extract("url", r"(?s)\Ahttps?://[^/?#]+(.*)\z", 1), F.lit(" x"),
    )
    checked = http_url(loud)
    bad = http_url(F.concat(F.lit("/"), F.col("page_id").cast("string")))
    return p.select("page_id", checked["value"].alias("value"), bad["error"].alias("relative_error"), host_of(F.col("url")).alias("host"))


HOSTS = ("Bücher.example", "müNCHEN.Bücher.example", "日本語.example", "пример.example", "plain.example")


def international_hosts(spark, sf):
    """Output form of page urls moved to hosts of several scripts."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    moved = F.concat(F.regexp_extract("url", r"\A(https?://)", 1), host, F.regexp_extract("url", r"(?s)\Ahttps?://[^/?#]+(.*)\z", 1))
    return _pages(spark, sf).select("page_id", http_url(moved)["value"].alias("value"))


def hashed_tokens(spark, sf):
    words = bd.table(spark, sf, "documents").select("source", F.explode(F.split("text", r"[^A-Za-z0-9]+")).alias("token"))
    return words.where(F.col("token") != "").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(tx.looks_hashed(F.col("token"))).alias("n_hashed")
    )


# --------------------------------------------------------------------- boards
def _cards(spark, sf, spec):
    renamed = ExtractionSpec(
        tuple(R("job_url", r.selector, r.selector_type, r.attribute, r.transform) if r.field == "url" else r for r in spec.field_rules),
        spec.container_selector, spec.container_selector_type,
    )
    rows = extract(bd.board_pages(spark, sf), renamed)
    return rows.select("page_id", _long("row_no"), *[c for c in ITEM if c != "url"], "job_url")


def cards_css(spark, sf):
    return _cards(spark, sf, bd.CSS_SPEC)


def cards_xpath(spark, sf):
    return _cards(spark, sf, bd.XPATH_SPEC)


def cards_jsonld(spark, sf):
    return _cards(spark, sf, bd.JSONLD_SPEC)


def cards_by_spec(spark, sf):
    """Each board read by its own spec in one pass; fields come with their kinds."""
    name = F.element_at(F.array(F.lit("css"), F.lit("xpath"), F.lit("jsonld")), (F.col("page_id") % 3 + 1).cast("int"))
    pages = bd.board_pages(spark, sf).withColumn("assigned", F.array(F.struct(name.alias("spec_id"))))
    specs = {"css": bd.CSS_SPEC, "xpath": bd.XPATH_SPEC, "jsonld": bd.JSONLD_SPEC}
    rows = extract_by_spec(pages, specs, ["title", "salary_min", "missing"])
    return rows.select(
        "page_id", "spec_id", _long("row_no"), F.col("title.v").alias("title"), F.col("salary_min.v").alias("salary_min"),
        F.col("salary_min.k").alias("kind"), F.col("missing.k").alias("missing_kind"),
    )


def jsonld_in_dom_row(spark, sf):
    spec = ExtractionSpec(
        (R("req", "li", "css", "data-no", "int"), R("first_title", "title", "json_ld"),
         R("first_place", "jobLocation.address.addressLocality", "json_ld", transform="lower")),
        "li.opening",
    )
    return extract(bd.board_pages(spark, sf), spec).select("page_id", "req", "first_title", "first_place")


def jsonld_objects(spark, sf):
    objects = jsonld.explode_objects(bd.board_pages(spark, sf))
    o = F.col("obj")
    return objects.select(
        "page_id", _long("seq"), F.try_variant_get(o, "$['@type']", "string").alias("type"),
        jsonld.path_text(o, "title").alias("title"), jsonld.path_text(o, "baseSalary.minValue").alias("min_value"),
        jsonld.path_text(o, "hiringOrganization").alias("not_scalar"), jsonld.type_matches(o, "JobPosting").alias("is_job"),
    )


def jsonld_types(spark, sf):
    """Types of pages that also carry an unreadable block on every third page."""
    broken = F.when(F.col("page_id") % 3 == 0, F.lit('<script type="application/ld+json">{"@type": oops</script>')).otherwise(F.lit(""))
    pages = bd.board_pages(spark, sf).withColumn("html", F.concat("html", broken))
    return pages.select(
        "page_id", F.array_join(jsonld.ld_types(F.col("html")), ",").alias("types"),
        F.size(jsonld.surfaced_blocks(F.col("html"))).cast("bigint").alias("n_blocks"),
        F.element_at(jsonld.surfaced_blocks(F.col("html")), -1).alias("last_block"),
    ).withColumn("last_block", F.substring("last_block", 1, 14))


def board_outline(spark, sf):
    tree = sm.summary_source(bd.board_pages(spark, sf))
    return tree.select("page_id", sm.outline(F.col("nodes")).alias("outline"))


def _plain_summaries(spark, sf):
    return sm.page_summary(bd.render(bd.cards(spark, sf), with_jsonld=False))


def board_prompt(spark, sf):
    return _plain_summaries(spark, sf).select(
        "page_id", sm.prompt_text().alias("prompt"), F.length(sm.prompt_text(50)).cast("bigint").alias("short_chars")
    )


# ----------------------------------------------------------------- validation
def _damaged(spark, sf):
    """Boards with blank titles, missing links and, on one board, no company at all."""
    markup = bd.card_html(
        title=F.when(F.col("key") % 5 == 0, F.lit(" ")).otherwise(tx.html_escape(F.col("title"))),
        company=F.when(F.col("board_no") == 5, F.lit("")).otherwise(F.col("company")),
        link=F.when(F.col("key") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit('<a class="more" href="'), F.col("path"), F.lit('">Details</a>'))),
    )
    return bd.render(bd.cards(spark, sf), markup)


def _damaged_checked(spark, sf):
    pages = _damaged(spark, sf)
    rows = extract(pages, bd.CSS_SPEC)
    return pages, check_rows(rows, JOB_POSTINGS, ("page_id", "row_no"))


def validate_quality(spark, sf):
    pages, checked = _damaged_checked(spark, sf)
    strict = ExtractionTarget("strict", JOB_POSTINGS.fields, "many", 15, JOB_POSTINGS.required_fields)
    q = run_quality(checked, pages, strict, ("page_id",))
    return q.select(
        "page_id", "n_rows", "valid_count", "n_row_errors", F.col("null_rates")["company"].alias("company_nulls"),
        F.round(F.col("null_rates")["url"], 6).alias("url_nulls"), "floor_ok", "null_ok", "ok",
        F.array_join("gate_errors", "; ").alias("gates"), "n_errors",
    )


def validation_errors(spark, sf):
    _, checked = _damaged_checked(spark, sf)
    return row_errors(checked, ("page_id",)).select("page_id", _long("row_no"), "field", "message")


def valid_items(spark, sf):
    _, checked = _damaged_checked(spark, sf)
    v = valid_rows(checked, JOB_POSTINGS, ("page_id", "row_no"))
    return v.select("page_id", _long("row_no"), "title", "company", "location", "salary_min", "salary_max", F.col("url").alias("job_url"), _time("posted_at"), "posted_at_iso")


def rejected_items(spark, sf):
    _, checked = _damaged_checked(spark, sf)
    r = rejected_rows(checked, JOB_POSTINGS, ("page_id", "row_no"))
    return r.select("page_id", _long("row_no"), "title", "salary_min", F.size("errors").cast("bigint").alias("n_errors"))


COERCE_TARGET = ExtractionTarget(
    "texts", (ItemField("name", "str"), ItemField("amount", "int", False), ItemField("link", "url"), ItemField("seen", "datetime", False))
)


def coerce_values(spark, sf):
    """Accepted and refused spellings of integers, urls and dates, made from every order."""
    c = bd.cards(spark, sf)
    k, n, day = F.col("key"), F.col("salary_min").cast("string"), F.col("posted_day")
    pick = lambda *alts: F.get(F.array(*alts), (k % len(alts)).cast("int"))
    texts = c.select(
        "key",
        F.when(k % 11 != 0, F.col("company")).alias("name"),
        pick(n, F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit("+"), n), F.concat(n, F.lit(".0")), F.concat(n, F.lit(".5")), F.lit("1e3"), F.lit("")).alias("amount"),
        pick(F.concat(F.lit("HTTPS://Jobs.Example.COM:443/j?id="), n), F.lit("ftp://x/y"), F.lit("/j/1"), F.lit("http://a.example"), F.lit("")).alias("link"),
        pick(day, F.concat(day, F.lit("T10:20:30Z")), F.concat(day, F.lit(" 10:20+02:00")), F.lit("May 1, 2024"), F.lit("1714521600"), F.lit("2024-02-30")).alias("seen"),
    )
    checked = check_rows(texts, COERCE_TARGET, ("key",))
    return checked.select(
        "key", "name", "amount", "link", "seen_iso", "valid",
        F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ").alias("problems"),
    )


# ------------------------------------------------------- templates and drift
def template_fingerprint(spark, sf):
    """Board templates: hashed class noise, a second card class, optional parts."""
    noise = F.concat(F.lit("opening css-"), F.lpad(F.lower(F.hex("block")), 5, "0"), F.lit("9"))
    card_class = F.when(F.col("board_no") == 5, F.lit("posting")).when(F.col("board_no") == 4, noise).otherwise(F.lit("opening"))
    prints = fingerprints(bd.render(bd.cards(spark, sf), bd.card_html(card_class=card_class)))
    return template_census(prints).select("n_pages", F.col("n_hosts").cast("bigint").alias("n_hosts"), "sample_url")


def page_templates(spark, sf):
    """How the given pages and the boards fall into templates: no template holds both."""
    given = _pages(spark, sf).select("page_id", "url", "html", F.lit("given").alias("origin"))
    boards = bd.board_pages(spark, sf).select("page_id", "url", "html", F.lit("board").alias("origin"))
    prints = fingerprints(given.unionByName(boards), ("origin",))
    per = prints.groupBy("fingerprint").agg(
        F.count_if(F.col("origin") == "given").alias("given"), F.count_if(F.col("origin") == "board").alias("board")
    )
    return per.agg(
        F.sum("given").alias("n_given"), F.sum("board").alias("n_board"),
        F.count_if((F.col("given") > 0) & (F.col("board") > 0)).alias("n_mixed"),
        F.count_if(F.col("board") > 0).alias("n_board_templates"),
    )


def _spec_json(spec: ExtractionSpec) -> Column:
    return F.lit(spec.to_json())


def _first_registry(spark, sf):
    """Registry after a first visit: the boards of blocks 0, 1 and 2 modulo 4."""
    # Written, as the registry itself: what is below parses pages, and storing as well as every reader of the registry would do it again.
    prints = written(fingerprints(bd.board_pages(spark, sf).where(F.col("block") % 4 != 3)))
    working = prints.select(
        "page_id", "url", "fingerprint", F.lit("model-a").alias("model"), _spec_json(bd.CSS_SPEC).alias("spec_json"),
        F.lit("run-1").alias("run_id"), F.lit(100).cast("bigint").alias("tokens_in"), F.lit(10).cast("bigint").alias("tokens_out"), F.lit(True).alias("ok"),
    )
    empty = spark.createDataFrame([], reg.REGISTRY_SCHEMA)
    return written(reg.stored(working, empty, JOB_POSTINGS.name, EARLIER))


def _second_visit(spark, sf):
    """The boards later on: new titles everywhere; block 1 mod 4 renamed its card class, 2 mod 4 lost its companies."""
    phase = F.col("block") % 4
    markup = bd.card_html(
        card_class=F.when(phase == 1, F.lit("tile")).otherwise(F.lit("opening")),
        company=F.when(phase == 2, F.lit("")).otherwise(F.col("company")),
        title=F.concat(F.lit("Updated "), tx.html_escape(F.col("title"))),
    )
    return bd.render(bd.cards(spark, sf), markup)


def drift_status(spark, sf):
    # Read by the fingerprints and by the decision: the pages are rendered once.
    pages = written(_second_visit(spark, sf))
    found = reg.lookup(fingerprints(pages), _first_registry(spark, sf), JOB_POSTINGS.name)
    return reg.decide(pages, found, JOB_POSTINGS).select("page_id", "url", "cache_status")


TILE_SPEC = ExtractionSpec(bd.CSS_SPEC.field_rules, "ol.openings > li")


def _proposals(pages):
    """Three proposed specs per page: one that finds nothing, one that lacks a field on odd pages, one from structured data."""
    odd = F.col("page_id") % 2 == 1
    specs = [_spec_json(bd.BROKEN_SPEC), F.when(odd, _spec_json(bd.WEAK_SPEC)).otherwise(_spec_json(TILE_SPEC)), _spec_json(bd.JSONLD_SPEC)]
    tries = F.array(*[
        F.struct(F.lit(i + 1).alias("attempt"), s.alias("spec_json"), F.lit(f"model-{i + 1}").alias("model"),
                 (F.col("page_id") % 100 + i).alias("tokens_in"), F.lit(10 * (i + 1)).cast("bigint").alias("tokens_out"))
        for i, s in enumerate(specs)
    ])
    return pages.select("url", F.explode(tries).alias("t")).select("url", "t.*")


def _two_proposals(pages):
    """Only the first two: odd pages end without a valid spec."""
    return _proposals(pages).where(F.col("attempt") <= 2)


def candidate_choice(spark, sf):
    pages = bd.board_pages(spark, sf)
    chosen = cand.choose(cand.evaluate_candidates(pages, _proposals(pages), JOB_POSTINGS))
    return chosen.select("page_id", "model", _long("attempt"), "ok", "valid_count", "n_errors", _long("attempts"), "tokens_in", "tokens_out")


def best_effort_choice(spark, sf):
    pages = bd.board_pages(spark, sf)
    chosen = cand.choose(cand.evaluate_candidates(pages, _two_proposals(pages), JOB_POSTINGS))
    return chosen.select("page_id", "model", _long("attempt"), "ok", "valid_count", _long("attempts"), "tokens_in", "tokens_out")


def spec_faults(spark, sf):
    """Four specs that cannot be run and a good one per page: each fails alone, with its reason."""
    pages, good = bd.board_pages(spark, sf), bd.CSS_SPEC.to_json()
    title = bd.CSS_SPEC.field_rules[0].selector
    texts = [good[:-9], good.replace(title, title + ":hover"), good.replace("listed (", "listed (("), good.replace('"collapse_ws"', '"eval"'), good]
    tries = F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(t).alias("spec_json")) for i, t in enumerate(texts)])
    one = F.lit(1).cast("bigint")
    proposals = pages.select("url", F.explode(tries).alias("t")).select("url", "t.*", F.lit("m").alias("model"), one.alias("tokens_in"), one.alias("tokens_out"))
    scored = cand.evaluate_candidates(pages, proposals, JOB_POSTINGS)
    return scored.select("page_id", _long("attempt"), "ok", "valid_count", F.substring_index("spec_error", ":", 1).alias("fault"))


def own_specs(spark, sf):
    """Every page with a spec of its own: titles from one of its first three cards on, as many specs as pages."""
    pages = bd.board_pages(spark, sf)
    first = (F.col("page_id") % 3 + 1).cast("string")
    rules = ')", "field_rules": [{"field": "title", "selector": "h2", "selector_type": "css", "transform": "trim"}], "notes": "'
    text = F.concat(F.lit('{"container_selector": "li.opening:nth-child(n+'), first, F.lit(rules), F.col("url"), F.lit('"}'))
    assigned = reg.with_spec_id(pages.select("page_id", text.alias("spec_json")))
    rows = extract_assigned(pages, assigned, ["title"])
    return rows.select("page_id", "spec_id", _long("row_no"), F.col("title.v").alias("title"))


def attempt_log(spark, sf):
    pages = bd.board_pages(spark, sf)
    return cand.attempt_log(cand.evaluate_candidates(pages, _proposals(pages), JOB_POSTINGS)).select("page_id", _long("attempt"), "line")


def spec_requests(spark, sf):
    """Request texts for the pages of blocks that are not a multiple of three."""
    summaries = _plain_summaries(spark, sf)
    decided = bd.cards(spark, sf).select(
        (F.col("block") * 10 + F.col("board_no")).alias("page_id"),
        F.when(F.col("block") % 3 == 0, F.lit("hit")).otherwise(F.lit("miss")).alias("cache_status"),
    ).distinct()
    request = cand.spec_requests(summaries, decided, JOB_POSTINGS)
    return request.select(
        "page_id", "cache_status", F.get_json_object("request", "$.page.text").alias("page"), F.get_json_object("request", "$.task.target").alias("target"),
        F.sha2(F.get_json_object("request", "$.task").cast("binary"), 256).alias("task_sha"), F.length("request").cast("bigint").alias("chars"),
    )


def repair_requests(spark, sf):
    # Read by the verdicts and by the messages: the pages are rendered once.
    pages = written(bd.board_pages(spark, sf))
    evaluated = cand.evaluate_candidates(pages, _two_proposals(pages), JOB_POSTINGS)
    # Only failed attempts with faulty rows have messages to repeat: no other page is parsed again.
    assigned = evaluated.where("not ok and n_errors > size(gate_errors)").select("page_id", "attempt", "spec_id", "spec_json")
    rows = extract_assigned(pages, assigned, [f.name for f in JOB_POSTINGS.fields], keep=("attempt",))
    messages = row_errors(check_rows(rows, JOB_POSTINGS, ("page_id", "attempt", "row_no")), ("page_id", "attempt"))
    texts = cand.repair_requests(_plain_summaries(spark, sf), evaluated, messages, JOB_POSTINGS)
    return texts.select(
        "page_id", _long("attempt"), F.get_json_object("request", "$.faults").alias("faults"), F.get_json_object("request", "$.tried.attempt").alias("tried"),
        F.sha2(F.get_json_object("request", "$.tried.spec").cast("binary"), 256).alias("spec_sha"), F.get_json_object("request", "$.page.text").alias("page"),
    )


def _generations(spark, sf):
    """Two generations of entries over orders: every third key seen again, some new."""
    o = bd.table(spark, sf, "orders")
    url = F.concat(F.lit("https://shop.example.com/o/"), F.col("o_orderkey").cast("string"))

    def entries(rows, model, created, seen, run):
        return rows.select(
            reg.cache_key(url, F.lit("job_postings")).alias("cache_key"), url.alias("url"), F.lit("job_postings").alias("target_name"),
            F.lit("f" * 16).alias("fingerprint"), F.lit(model).alias("model"), F.lit("{}").alias("spec_json"),
            F.lit(created).alias("created_at"), F.lit(seen).alias("last_seen_at"), F.lit(run).alias("run_id"),
            F.col("o_custkey").alias("tokens_in"), F.lit(1).cast("bigint").alias("tokens_out"),
        )

    old = entries(o.where(F.col("o_orderkey") % 5 != 0), "model-a", EARLIER, EARLIER, "run-1")
    working = o.where((F.col("o_orderkey") % 3 == 0)).select(
        F.col("o_orderkey").alias("page_id"), url.alias("url"), F.lit("0" * 16).alias("fingerprint"), F.lit("model-b").alias("model"),
        F.lit("{}").alias("spec_json"), F.lit("run-2").alias("run_id"), F.col("o_custkey").alias("tokens_in"),
        F.lit(2).cast("bigint").alias("tokens_out"), (F.col("o_orderstatus") != "P").alias("ok"),
    )
    late = entries(o.where(F.col("o_orderkey") % 7 == 0), "model-c", EARLIER, EARLIER - dt.timedelta(days=1), "run-0")
    return old, working, late


def _registry_rows(rows):
    return rows.select("cache_key", "url", "fingerprint", "model", _time("created_at"), _time("last_seen_at"), "run_id", "tokens_in", "tokens_out")


def registry_upsert(spark, sf):
    """Two generations: the later change wins."""
    old, working, _ = _generations(spark, sf)
    return _registry_rows(reg.upsert(old, reg.stored(working, old, "job_postings", NOW)))


def registry_commits(spark, sf):
    """Three commits to a stored registry, the last one with entries seen before the others: they only fill gaps."""
    old, working, late = _generations(spark, sf)
    path = scratch(spark, "registry")
    reg.commit_store(spark, path, old)
    reg.commit_store(spark, path, reg.stored(working, reg.read_store(spark, path), "job_postings", NOW), depth=1)
    reg.commit_store(spark, path, late)
    return _registry_rows(reg.read_store(spark, path))


# ----------------------------------------------------------------------- crawl
def _seeds(pages):
    return pages.where(F.col("block") % bd.CHAIN == 0).select(F.col("url").alias("seed"), "url")


def pagination_walk(spark, sf):
    pages = bd.board_pages(spark, sf)
    walked = cr.walk(_seeds(pages), next_links(pages, bd.CSS_SPEC), max_pages=7)
    return cr.mark_missing(walked, pages).select("seed", _long("seq"), "url", "missing_page")


def crawl_items(spark, sf):
    """Rows of whole walks, numbered across pages."""
    pages = bd.board_pages(spark, sf)
    rows = cr.crawl(pages, _seeds(pages), bd.XPATH_SPEC, JOB_POSTINGS, bd.CHAIN)["rows"]
    return rows.select("seed", _long("seq"), _long("row_no"), _long("run_row"), "title")


def detail_enrich(spark, sf):
    job_cards = bd.cards(spark, sf)
    pages, details = bd.render(job_cards), bd.detail_pages(job_cards.where(F.col("key") % 13 != 0))
    spec = ExtractionSpec(
        (R("title", "h2", "css", transform="trim"), R("location", "em.place", "css"), R("link", "a.more", "css", "href", "abs_url")),
        "li.opening", next_page_selector="a.next", detail_url_field="link", detail_field_rules=bd.DETAIL_RULES,
    )
    rows = cr.crawl(pages, _seeds(pages), spec, JOB_POSTINGS, None, details)["rows"]
    return rows.select("seed", _long("seq"), _long("row_no"), "title", "location", "description")


def crawl_counters(spark, sf):
    job_cards = bd.cards(spark, sf)
    pages, details = bd.render(job_cards), bd.detail_pages(job_cards)
    spec = ExtractionSpec(
        (R("link", "a.more", "css", "href", "abs_url"),), "li.opening", next_page_selector="a.next",
        detail_url_field="link", detail_field_rules=bd.DETAIL_RULES,
    )
    counters = cr.crawl(pages, _seeds(pages), spec, JOB_POSTINGS, bd.CHAIN, details, 30)["counters"]
    return counters.select("seed", "pages_crawled", "detail_pages_fetched", F.element_at("page_urls", -1).alias("last_page"))


def crawl_quality(spark, sf):
    """One verdict per walk over its merged rows."""
    pages = _damaged(spark, sf)
    out = rn.replay(pages, bd.CSS_SPEC, JOB_POSTINGS, _seeds(pages), bd.CHAIN)
    return out["quality"].select("run_id", "n_rows", "valid_count", "n_row_errors", "ok")


def crawl_manifest(spark, sf):
    """Manifest rows and file names of every walk and its detail pages, with the replay limits."""
    job_cards = bd.cards(spark, sf)
    walked = job_cards.select(
        F.concat("board", F.lit("-"), F.floor(F.col("block") / bd.CHAIN).cast("string")).alias("run_id"), F.lit("page").alias("kind"),
        F.pmod("block", F.lit(bd.CHAIN)).alias("seq"), bd.board_url(F.col("board"), F.col("block")).alias("url"),
    ).distinct()
    details = job_cards.select(
        F.concat("board", F.lit("-"), F.floor(F.col("block") / bd.CHAIN).cast("string")).alias("run_id"), F.lit("detail").alias("kind"),
        F.col("key").alias("seq"), F.concat(F.lit(bd.SITE), F.col("path")).alias("url"),
    )
    entries = manifest_entries(walked.unionByName(details))
    return entries.join(replay_limits(entries), "run_id").select("run_id", "kind", "seq", "url", "file", "max_pages", "max_detail")


ROBOTS = {
    0: (200, "# rules\nUser-agent: *\nDisallow: /en/\nDisallow: /es/3 # comment\nAllow: /\n"),
    1: (404, "User-agent: *\nDisallow: /\n"),
    2: (200, "User-agent: loom\nUser-agent: other\nAllow: /en/1\nDisallow: /en\n\nUser-agent: *\nDisallow: /\n"),
    3: (200, "User-agent: *\nDisallow:\n\nUser-agent: elsewhere\nDisallow: /\n"),
}


def url_policy(spark, sf):
    """Page urls against made robots files; the host's length picks its file."""
    urls = _pages(spark, sf).select("page_id", "url")
    hosts = urls.select(host_of(F.col("url")).alias("host")).distinct()
    which = (F.length("host") % 5).cast("int")
    status = F.create_map(*[F.lit(x) for k, v in ROBOTS.items() for x in (k, v[0])])
    body = F.create_map(*[F.lit(x) for k, v in ROBOTS.items() for x in (k, v[1])])
    robots = hosts.where(which < 4).select("host", F.try_element_at(status, which).alias("status"), F.try_element_at(body, which).alias("body"))
    return policy.url_policy(urls, robots, "loom/1.0", ("page_id",)).select("page_id", "url", "allowed")


def robots_as_of(spark, sf):
    """Page urls, each fetched on some day of a month, against three made copies of every host's robots file."""
    urls = _pages(spark, sf).select("page_id", "url", F.timestamp_seconds(F.lit(86400) * F.pmod("page_id", F.lit(31))).alias("fetched_at"))
    copies = F.array(*[
        F.struct(F.timestamp_seconds(F.lit(86400 * day)).alias("fetched_at"), F.lit(status).alias("status"), F.lit(body).alias("body"))
        for day, status, body in ((2, 200, "User-agent: *\nDisallow: /en/\n"), (10, 404, "User-agent: *\nDisallow: /\n"), (20, 200, "User-agent: *\nDisallow: /es/\n"))
    ])
    robots = urls.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().select("host", F.explode(copies).alias("c")).select("host", "c.*")
    return policy.url_policy(urls, robots, "loom/1.0", ("page_id",)).select("page_id", "url", "allowed")


# ------------------------------------------------------------------------ runs
def _run_second_visit(spark, sf):
    # Every step of the run reads the pages: they are rendered once.
    pages = written(_second_visit(spark, sf)).withColumn("run_id", F.concat(F.lit("run-2-"), F.col("page_id").cast("string"))).withColumn("rendered", F.lit(False))
    return rn.run(pages, JOB_POSTINGS, _first_registry(spark, sf), _two_proposals(pages), NOW)


def run_records(spark, sf):
    runs = _run_second_visit(spark, sf)["runs"]
    return runs.select(
        "page_id", "run_id", "cache_status", "model", "rows_extracted", "final_status", _long("attempts"), "tokens_in", "tokens_out",
        _long("pages_crawled"), F.array_join("validation_errors", "; ").alias("gates"),
    )


def crawl_runs(spark, sf):
    """Runs that walk the second visit's boards from three places of every chain, each by the spec it settled on."""
    # Every round of the walks reads the pages: they are rendered once.
    pages = written(_second_visit(spark, sf))
    begin = pages.where((F.col("block") % bd.CHAIN).isin(0, 3, 5))
    seeds = begin.select("page_id", F.concat(F.lit("run-2-"), F.col("page_id").cast("string")).alias("run_id"), F.lit(False).alias("rendered"))
    follow = F.array(*[
        F.struct(F.lit(i).alias("attempt"), _spec_json(replace(s, next_page_selector="a.next")).alias("spec_json"), F.lit(f"model-{i}").alias("model"),
                 F.lit(10 * i).cast("bigint").alias("tokens_in"), F.lit(i).cast("bigint").alias("tokens_out"))
        for i, s in ((1, bd.BROKEN_SPEC), (2, TILE_SPEC))
    ])
    proposals = begin.select("url", F.explode(follow).alias("t")).select("url", "t.*")
    runs = rn.run_crawls(pages, seeds, JOB_POSTINGS, _first_registry(spark, sf), proposals, NOW)["runs"]
    return runs.select(
        "page_id", "run_id", "cache_status", "model", "rows_extracted", "final_status", _long("attempts"), "tokens_in", "tokens_out", _long("n_errors"),
        _long("pages_crawled"), F.element_at("crawl_page_urls", -1).alias("last_page"), F.array_join("validation_errors", "; ").alias("gates"),
        F.array_join("repair_log", "; ").alias("tried"),
    )


def run_rollup(spark, sf):
    return rn.status_rollup(_run_second_visit(spark, sf)["runs"])


def run_registry(spark, sf):
    merged = _run_second_visit(spark, sf)["registry"]
    return merged.select("cache_key", "url", "model", _time("created_at"), _time("last_seen_at"), "run_id", "tokens_in", "tokens_out")


def refetch_queue(spark, sf):
    """Failed, unrendered runs whose page is a script shell; every fourth run was rendered already."""
    pages = shell_pages(spark, sf)
    runs = pages.select(
        F.concat(F.lit("run-"), F.col("page_id").cast("string")).alias("run_id"), "page_id", "url",
        F.when(F.col("page_id") % 2 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("final_status"),
        (F.col("page_id") % 4 == 0).alias("rendered"),
    )
    return rn.refetch_queue(runs, pages).select("run_id", "page_id", "url")


_QUERIES = [
    page_title, nav_links_abs, regex_track_id, ad_text, node_census, repeating_groups, render_check, transform_values,
    normalized_urls, international_hosts, hashed_tokens, cards_css, cards_xpath, cards_jsonld, cards_by_spec, jsonld_in_dom_row, jsonld_objects,
    jsonld_types, board_outline, board_prompt, validate_quality, validation_errors, valid_items, rejected_items, coerce_values,
    template_fingerprint, page_templates, drift_status, candidate_choice, best_effort_choice, spec_faults, own_specs, attempt_log, spec_requests,
    repair_requests, registry_upsert, registry_commits, pagination_walk, crawl_items, detail_enrich, crawl_counters, crawl_quality,
    crawl_manifest, url_policy, robots_as_of, run_records, crawl_runs, run_rollup, run_registry, refetch_queue,
]


def _tuned(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    call.__name__ = fn.__name__
    call.__doc__ = fn.__doc__
    return call


QUERIES = {fn.__name__: _tuned(fn) for fn in _QUERIES}
