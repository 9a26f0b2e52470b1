"""Selectors, field rules, structured data and specs on small pages."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pageloom import ExtractionSpec, FieldRule as R
from pageloom.operators import jsonld
from pageloom.functions.transforms import TRANSFORMS
from pageloom.model import SELECTOR_TYPES
from pageloom.operators.extract import extract, extract_assigned, extract_by_spec, next_links
from pageloom.operators.programs import compiled
from pageloom.operators.selectors import SelectorError, parse_css, parse_selector, parse_xpath
from pageloom.operators.shred import dom_nodes, parse_page

LIST = """<html><body><ul class="roles"><li class="role x" data-n="1"><h3> Baker </h3><a href="/r/1">see</a></li>
<li class="role" data-n="2"><h3>Pilot &amp; Co</h3><a class="z" href="r/2">see2</a><p>Pay 1,200</p></li>
<li class="role"><h3>Clerk</h3></li></ul><a rel="next" href="?p=2">more</a></body></html>"""
PAGE = ("https://h.example/a/b", LIST)


def rows(pages, spec, cardinality="many"):
    found = extract(pages, spec, cardinality).orderBy("page_id", "row_no").collect()
    skip = {"page_id", "page_url", "row_no"}
    return [{k: v for k, v in r.asDict().items() if k not in skip} for r in found]


def first(pages_of, selector, kind="css", attribute=None, container=None, ckind="css"):
    spec = ExtractionSpec((R("v", selector, kind, attribute),), container, ckind)
    return [r["v"] for r in rows(pages_of(PAGE), spec, "many" if container else "one")]


@pytest.mark.parametrize(
    "css, want",
    [
        ("h3", " Baker "), ("li:nth-child(2) h3", "Pilot & Co"), ("li.role:last-child > h3", "Clerk"), ("li + li h3", "Pilot & Co"),
        ("h3 ~ p", "Pay 1,200"), ("li:not(.x) h3", "Pilot & Co"), ("[data-n='2'] a", "see2"), ("a[href^='r/']", "see2"),
        ("a[href$='1']", "see"), ("li[data-n*='2'] > h3", "Pilot & Co"), ("p, h3", " Baker "), ("ul.roles li.x", " Baker see"), ("a[rel=next]", "more"),
        ("li[class~='x'] a", "see"), ("table", None), ("li:nth-child(2n+1):not(.x) h3", "Clerk"),
    ],
)
def test_css(pages_of, css, want):
    assert first(pages_of, css) == [want]


@pytest.mark.parametrize(
    "xpath, want",
    [
        ("//h3", " Baker "), ("//li[2]/h3", "Pilot & Co"), ("//li[@data-n='2']/a/@href", "r/2"), ("//a[contains(@href,'/2')]", "see2"),
        (".//p", "Pay 1,200"), ("/html/body/ul/li/h3", " Baker "), ("//ul/*[3]/h3", "Clerk"), ("//li[@class]/a[@class='z']", "see2"), ("//nav", None),
    ],
)
def test_xpath(pages_of, xpath, want):
    assert first(pages_of, xpath, "xpath") == [want]


def test_fields_are_relative_to_their_container(pages_of):
    assert first(pages_of, "a", attribute="href", container="li.role") == ["/r/1", "r/2", None]
    assert first(pages_of, "li", attribute="data-n", container="li.role") == ["1", "2", None]      # a container matches itself
    assert first(pages_of, ".//h3", "xpath", container="//li", ckind="xpath") == [" Baker ", "Pilot & Co", "Clerk"]
    assert first(pages_of, "//h3", "xpath", container="li") == [" Baker "] * 3                      # an absolute path leaves the container
    assert first(pages_of, "ul h3", container="li") == [None] * 3                                   # ancestors outside do not count
    assert first(pages_of, "a", container="li.none") == []


def test_nested_containers_each_give_a_row(pages_of):
    page = pages_of("<div class=b><i>1</i><div class=b><i>2</i></div></div>")
    assert [r["v"] for r in rows(page, ExtractionSpec((R("v", "i", "css"),), "div.b"))] == ["1", "2"]


def test_attribute_of_first_match_only(pages_of):
    page = pages_of("<a>x</a><a href=/y>y</a>")
    assert rows(page, ExtractionSpec((R("v", "a", "css", "href"),)), "one") == [{"v": None}]


def test_regex_rules(pages_of):
    spec = ExtractionSpec((R("pay", r"Pay\s([\d,]+)", "regex", transform="int"), R("whole", r"data-n=.\d", "regex"), R("named", r"(?P<t><h3>.+?)</h3>", "regex")), "li.role")
    assert rows(pages_of(PAGE), spec) == [
        {"pay": None, "whole": 'data-n="1', "named": "<h3> Baker "},
        {"pay": 1200, "whole": 'data-n="2', "named": "<h3>Pilot &amp; Co"},
        {"pay": None, "whole": None, "named": "<h3>Clerk"},
    ]


def test_last_rule_of_a_field_wins_and_bad_data_is_null(pages_of):
    spec = ExtractionSpec((R("v", "a", "css"), R("v", "h3", "css", transform="int")), "li.role")
    assert rows(pages_of(PAGE), spec) == [{"v": None}] * 3


def test_bad_specs_are_refused_when_built():
    with pytest.raises(ValueError, match="is not one of"):
        R("v", "a", "css", transform="eval")
    with pytest.raises(ValueError, match="selector type"):
        R("v", "a", "sql")
    with pytest.raises(ValueError, match="css or xpath"):
        ExtractionSpec((), next_page_selector_type="regex")
    for bad in ("a >", "a::before", ":hover", "a[", "li:nth-child(x)", ""):
        with pytest.raises(SelectorError):
            parse_css(bad)
    for bad in ("//li[position()<3]", "//h3 | .//h4", "//a[text()=x]", "count(//a)"):
        with pytest.raises(SelectorError):
            parse_xpath(bad)
    with pytest.raises(SelectorError):
        parse_selector("x", "regex")


def test_spec_json_round_trip_and_defaults():
    spec = ExtractionSpec((R("a", "b", "css", "href", "trim", True),), "li", notes="é", detail_url_field="a")
    assert ExtractionSpec.from_json(spec.to_json()) == spec
    plain = ExtractionSpec.from_json('{"field_rules": [{"field": "a", "selector": "b", "selector_type": "css"}], "extra": 1}')
    assert (plain.container_selector_type, plain.next_page_attribute, plain.detail_field_rules) == ("css", "href", ())


LD = """<html><head><!-- <script type="application/ld+json">{"@type":"Role","name":"hidden"}</script> -->
<script>var s = '<script type="application/ld+json">';</script>
<script type="application/ld+json">[{"@type":"Role","name":"A","n":1.0,"ok":true,"at":[{"in":{"city":"X"}}]},{"@type":["Role","T"],"n":12}]</script>
<script id=q type='application/ld+json'>{"@graph":[{"@type":"Role","name":"B","n":0}],"@type":"Set","name":"W"}</script>
<script type="application/ld+json">{broken</script><script type="application/ld+json">{"a":1} x</script></head><body><p>t</p></body></html>"""


def test_jsonld_rows(pages_of):
    rules = (R("name", "name", "json_ld"), R("n", "n", "json_ld"), R("ok", "ok", "json_ld"), R("city", "at.in.city", "json_ld"), R("at", "at", "json_ld"), R("p", "p", "css"))
    got = rows(pages_of(LD), ExtractionSpec(rules, "Role", "json_ld"))
    blank = dict(name=None, n=None, ok=None, city=None, at=None, p=None)
    assert got == [
        {**blank, "name": "A", "n": "1.0", "ok": "True", "city": "X"}, {**blank, "n": "12"}, {**blank, "name": "B", "n": "0"},
    ]
    everything = rows(pages_of(LD), ExtractionSpec((R("name", "name", "json_ld"),), None, "json_ld"))
    assert [r["name"] for r in everything] == ["A", None, "B", "W"]


def test_jsonld_value_inside_tree_rows_and_whole_page(pages_of):
    spec = ExtractionSpec((R("t", "p", "css"), R("name", "name", "json_ld")), "p")
    assert rows(pages_of(LD), spec) == [{"t": "t", "name": "A"}]
    assert rows(pages_of(LD), ExtractionSpec((R("name", "name", "json_ld"),)), "one") == [{"name": "A"}]


def test_jsonld_deeper_than_the_depth_is_an_error_not_a_loss(pages_of):
    page = pages_of('<script type="application/ld+json">[[[[[[{"name":"deep"}]]]]]]</script>')
    assert jsonld.explode_objects(page, depth=7).count() == 1
    with pytest.raises(Exception, match="nested deeper"):
        jsonld.explode_objects(page, depth=2).collect()


def test_jsonld_unfolds_any_depth(pages_of):
    deep = '{"name":"deep"}'
    for i in range(40):
        deep = f"[{deep}]" if i % 2 else f'{{"@graph":[{deep}],"name":"g{i}"}}'
    page = pages_of(f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">[1,{{"name":"flat"}}]</script>', "<p>none</p>", LD)
    got = [(r.page_id, r.n) for r in jsonld.explode_objects(page).select("page_id", "seq", jsonld.path_text(F.col("obj"), "name").alias("n")).orderBy("page_id", "seq").collect()]
    assert got == [(0, "deep"), *[(0, f"g{i}") for i in range(0, 40, 2)], (0, "flat"), (2, "A"), (2, None), (2, "B"), (2, "W")]


def test_ld_types(pages_of):
    page = pages_of('<script type="application/ld+json">{"@type":"A","x":{"@type":["C","B"]},"t":"\\"@type\\":\\"no\\""}</script><script type="application/ld+json">oops</script>')
    assert page.select(jsonld.ld_types(F.col("html")).alias("t")).first().t == ["<unparsed-ld>", "A", "B", "C"]


def test_many_specs_share_a_pass(pages_of):
    specs = {f"s{i}": ExtractionSpec((R("v", f"li:nth-child({i % 3 + 1}) h3", "css", transform="trim"),), "ul") for i in range(40)}
    pages = pages_of(*[LIST] * 40).withColumn("assigned", F.array(F.struct(F.concat(F.lit("s"), F.col("page_id")).alias("spec_id"))))
    got = extract_by_spec(pages, specs, ["v", "w"]).orderBy("page_id").collect()
    assert [r.v.v for r in got] == [["Baker", "Pilot & Co", "Clerk"][i % 3] for i in range(40)]
    assert {r.w.k for r in got} == {"absent"}


def test_next_links(pages_of):
    spec = ExtractionSpec((), next_page_selector="a[rel=next]")
    assert next_links(pages_of(PAGE, "<p>none</p>"), spec).collect()[0].dst_url == "https://h.example/a/b?p=2"
    assert next_links(pages_of(PAGE, "<p>none</p>"), spec).count() == 1
    assert next_links(pages_of(PAGE), ExtractionSpec(())).count() == 0


def tags(html):
    t = parse_page(html.encode())
    return list(zip(t.tags, [o[1] for o in t.opened]))


def test_implied_structure():
    assert [x for x, _ in tags("<p>a<p>b<div>c")] == ["html", "body", "p", "p", "div"]
    assert [p for _, p in tags("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")][3:] == [2, 2, 4, 5, 2]
    assert [x for x, _ in tags("<title>t</title>x")] == ["html", "head", "title", "body"]
    assert [p for _, p in tags("<table><tr><td>1<td>2<tr><td>3</table>")] == [-1, 0, 1, 2, 3, 3, 2, 6]
    assert [x for x, _ in tags("<script>if (a<b) '</p>'</script><br><img src=x>z")] == ["html", "head", "script", "body", "br", "img"]
    assert [x for x, _ in tags("")] == ["html", "body"]
    assert [x for x, _ in tags("<div>cut <a href='/x")] == ["html", "body", "div"]


def test_source_and_text_spans_hold_for_every_given_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    nodes = dom_nodes(pages).where(F.col("tag").isin("a", "li", "h1")).join(pages, "page_id")
    raw = F.expr("cast(substring(cast(html as binary), h0 + 1, h1 - h0) as string)")
    bad = nodes.select("tag", raw.alias("raw")).where(
        ~F.startswith("raw", F.concat(F.lit("<"), F.col("tag"))) | (F.endswith("raw", F.lit(">")) & ~F.endswith("raw", F.concat(F.lit("</"), F.col("tag"), F.lit(">"))))
    )
    assert bad.count() == 0 and nodes.count() > 500


SMALL = """<html><body><div id="a" class="x"><p>one<b>two</b>three</p><p lang="en">  four  five </p><i></i><p>last</p></div>
<div class="y"><a href="/u" title="t">link</a><a>bare</a><!-- c --></div></body></html>"""


def _evaluated(pages_of, rules, container=None, kind="css", cardinality="one", html=SMALL):
    """Values of a stored spec run by the evaluator."""
    spec = ExtractionSpec(tuple(rules), container, kind)
    pages = pages_of(html)
    assigned = pages.selectExpr("page_id", "'s' as spec_id").withColumn("spec_json", F.lit(spec.to_json()))
    out = extract_assigned(pages, assigned, [r.field for r in rules], cardinality).orderBy("row_no").collect()
    return [[r[x.field].v for x in rules] for r in out]


@pytest.mark.parametrize("selector,kind,want", [
    ("./text()", "xpath", None), ("//p/text()", "xpath", "one"), ("//p[2]/@lang", "xpath", "en"), ("//a/@title", "xpath", "t"), ("p::text", "css", "one"), ("i::text", "css", None),
    ("a::attr(href)", "css", "/u"), ("p:last-of-type", "css", "last"), ("p:nth-of-type(2)", "css", "  four  five "), ("p:only-of-type", "css", None),
    ("i:empty ~ p", "css", "last"), ("div:not(.x, .z) a", "css", "link"), (":is(i, b)", "css", "two"), ("i + p", "css", "last"), ("#a > p ~ p", "css", "  four  five "),
    ("//p[normalize-space()='four five']/@lang", "xpath", "en"), ("//p[contains(., 'two') and not(@lang)]", "xpath", "onetwothree"),
    ("//a[@title='t' or text()='bare']/@href", "xpath", "/u"), ("//a[text()='bare']", "xpath", "bare"), ("//p[last()]", "xpath", "last"), ("//b | //i", "xpath", "two"),
    ("//div[@class='y']//a[position()=2]", "xpath", "bare"), ("//a[starts-with(., 'ba')]", "xpath", "bare"),
])
def test_selectors_by_the_evaluator_and_by_columns(pages_of, selector, kind, want):
    rule = R("v", selector, kind)
    assert _evaluated(pages_of, [rule]) == [[want]]
    assert [r.v for r in extract(pages_of(SMALL), ExtractionSpec((rule,)), "one").collect()] == [want]


def test_a_group_that_stays_out_of_a_match_is_null(pages_of):
    rules = [R("a", r"one(x)?<b>", "regex"), R("b", r"(one)|(two)", "regex"), R("c", r"two()", "regex"), R("d", "no such (x)", "regex")]
    assert _evaluated(pages_of, rules) == [[None, "one", "", None]]
    got = extract(pages_of(SMALL), ExtractionSpec(tuple(rules)), "one").collect()
    assert [(r.a, r.b, r.c, r.d) for r in got] == [(None, "one", "", None)]


def test_bad_specs_fail_alone(pages_of):
    pages = pages_of(*[SMALL] * 9)
    good = ExtractionSpec((R("v", "p", "css"),), "div")
    rule = {"field": "v", "selector": "p", "selector_type": "css"}
    bad = ["{oops", "[]", "{}", json.dumps({"field_rules": [rule | {"selector": "b:hover"}]}), json.dumps({"field_rules": [rule | {"selector": "(", "selector_type": "regex"}]}),
           json.dumps({"field_rules": [rule | {"transform": "eval"}]}), json.dumps({"field_rules": [rule], "container_selector_type": "regex"}), "[" * 100_000]
    texts = [good.to_json(), *bad]
    assigned = pages.select("page_id", F.concat(F.lit("s"), "page_id").alias("spec_id"), F.get(F.array(*map(F.lit, texts)), F.col("page_id").cast("int")).alias("spec_json"))
    rows = extract_assigned(pages, assigned, ["v"]).collect()
    assert [(r.page_id, r.row_no, r.v.v) for r in sorted(rows, key=lambda r: r.row_no)] == [(0, 0, "onetwothree"), (0, 1, None)]
    errors = compiled(assigned, "many", SELECTOR_TYPES, tuple(TRANSFORMS)).where("spec_error is not null")
    assert sorted(r.spec_id for r in errors.collect()) == [f"s{i}" for i in range(1, 9)]


def test_the_plan_does_not_grow_with_the_specs(spark, pages_of):
    def plan(n):
        pages = pages_of(*[SMALL] * 3)
        assigned = spark.range(n).selectExpr("id % 3 as page_id", "concat('s', id) as spec_id", "concat('{\"field_rules\": [], \"notes\": \"', id, '\"}') as spec_json", "id as attempt")
        out = extract_assigned(pages, assigned, ["v"], keep=("attempt",))
        return re.sub(r"#\d+|plan_id=\d+|\d+", "", out._jdf.queryExecution().executedPlan().toString())

    few, many = plan(10), plan(10_000)
    assert few.count("MapInArrow") == many.count("MapInArrow") == 2 and "Union" not in many and abs(len(few.splitlines()) - len(many.splitlines())) <= 4


def test_json_ld_by_the_evaluator(pages_of):
    html = """<script type="application/ld+json">[{"@type": ["A", "B"], "n": [{"v": 1.5}], "t": true}, {"@graph": [{"@type": "A", "n": {"v": "x"}}], "@type": "G"}]</script>
    <script type="application/ld+json">{broken</script>"""
    rules = [R("n", "n.v", "json_ld"), R("t", "t", "json_ld"), R("c", "p", "css")]
    assert _evaluated(pages_of, rules, "A", "json_ld", "many", html) == [["1.5", "True", None], ["x", None, None]]
    assert _evaluated(pages_of, rules, None, "json_ld", "many", html)[-1] == [None, None, None]
    assert _evaluated(pages_of, rules, html=html) == [["1.5", "True", None]]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_spec_leaves_the_parser_as_rows(pages_of):
    """Not as the elements of the whole page; Columns and evaluator read alike."""
    html = '<ul><li class="x" id="a"><b>1</b> to 5</li><li class="x"><b> 2 </b> to 6</li><li>no</li></ul><a href="/n">n</a>'
    rules = (R("n", "b", "css", transform="int"), R("id", ".", "xpath", "id"), R("top", r"to (\d)", "regex", transform="int"))
    rows = extract(pages_of(html, ""), ExtractionSpec(rules, "ul > li.x"))
    assert [tuple(r) for r in rows.select("page_id", "row_no", "n", "id", "top").orderBy("page_id", "row_no").collect()] == [(0, 0, 1, "a", 5), (0, 1, 2, None, 6)]
    assert "nodes" not in _plan(rows)
    beside = ExtractionSpec((R("after", "b + i, li + li", "css"),), "li")
    out = extract(pages_of("<ul><li>1</li><li>2</li></ul>"), beside).orderBy("row_no").collect()
    assert [r.after for r in out] == [None, "2"]


def test_checks_run_once_a_row(pages_of):
    from pageloom.model import JOB_POSTINGS
    from pageloom.operators.validate import check_rows, valid_rows

    spec = ExtractionSpec((R("title", "b", "css"), R("url", "a", "css", "href", "abs_url"), R("posted_at", "i", "css")), "li")
    checked = check_rows(extract(pages_of("<li><b>t</b><a href='/x'>y</a><i>2024-05-01</i></li>"), spec), JOB_POSTINGS, ("page_id", "row_no"))
    assert _plan(valid_rows(checked, JOB_POSTINGS, ("page_id", "row_no"))).count("Input should be a valid datetime or date") == 1


def test_a_memo_of_tags_keeps_quotes_apart():
    """A tag that ends at its first '>' in one page may go on in another."""
    first = parse_page(b"<p title='a>b>c</p>")
    second = parse_page(b"<p title='a>b'>c</p><P CLASS=x>d<p class=x>e")
    assert first.columns(("attrs",))[0][-1] != [("title", "a>b")]
    assert [dict(a) for a in second.columns(("attrs",))[0][2:]] == [{"title": "a>b"}, {"class": "x"}, {"class": "x"}]


def test_plain_elements_are_read_without_calls():
    """Elements that close nothing but themselves cost no Python call each, and reading a rule stops at the first match."""
    import sys

    from pageloom.operators import programs

    source = b"<ul>" + b"".join(b'<li class="c" id="n%d"><b>t%d</b><i>u</i></li>' % (i, i) for i in range(200)) + b"</ul>"
    calls = []

    def count(act):
        calls.clear()
        sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
        try:
            got = act()
        finally:
            sys.setprofile(None)
        return got, len(calls)

    parse_page(source)
    tree, n = count(lambda: parse_page(source))
    assert n < 100 and len(tree.tags) == 603 and tree.columns(("t1",))[0][-1] == 890
    page = programs.Page(source)
    finder = programs.Finder(programs._selector("b", "css"))
    page.by_tag, page.t0, page.classes
    got, n = count(lambda: finder.read(page, 0, None))
    assert got == "t0" and n < 10


def test_tags_read_by_their_form_equal_a_closer_reading():
    from pageloom.operators import shred

    for token in (b'a href="x&amp;y" CLASS="b  c"', b'img src="a" alt=""/', b'p id="1"\n data-x="\xc3\xa9"', b'p a="1"b="2"', b'p a="1" A="2"', b"p a='\"' b=\"c\"", b'p a="'):
        made = shred._read_form(token)
        if made is not None:
            assert made == shred._read_tag(shred._TOKEN.match(b"<" + token + b">"))
    assert shred._read_form(b'a href="x"') is not None and shred._read_form(b'p a="1"b="2"') is None


def test_columns_of_the_fields_own_type_are_checked_plainly(spark):
    """Text and whole numbers can only be missing: no lambda runs for them, and the verdict is that of the tagged form."""
    from pageloom.model import ExtractionTarget, ItemField
    from pageloom.operators.validate import check_rows

    target = ExtractionTarget("t", (ItemField("a", "str"), ItemField("n", "int"), ItemField("b", "str", False)))
    rows = spark.createDataFrame([(1, "x", 5, " "), (2, None, None, None), (3, "", -(2**63), "y")], "k long, a string, n long, b string")
    plain = check_rows(rows, target, ("k",))
    tag = lambda c, kind: F.struct(F.col(c).cast("string").alias("v"), F.lit(kind).alias("k")).alias(c)
    tagged = check_rows(rows.select("k", tag("a", "str"), tag("n", "int"), tag("b", "str")), target, ("k",))
    assert "transform(" not in _plan(plain) and "transform(" in _plan(tagged) and sorted(plain.collect(), key=lambda r: r.k) == sorted(tagged.collect(), key=lambda r: r.k)


def test_iso_days_take_the_short_way_to_the_same_text(spark):
    from pageloom.functions.dates import _free_form, iso_date

    days = ["2024-05-01", "1000-01-01", "9999-12-31", "2024-02-30", "2024-13-01", "0999-01-01", "2024-5-1", "2024-02-29", " 2024-05-01", None, "", "1899-12-31"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", iso_date(F.col("d")).alias("short"), _free_form(F.col("d"), None).alias("long")).collect()
    assert [r.short for r in rows] == [r.long for r in rows] and rows[0].short == "2024-05-01T00:00:00"
