"""Summaries, fingerprints, validation, registry, candidates, crawl, policy, storage."""

import datetime as dt
import json
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pageloom import ExtractionSpec, ExtractionTarget, FieldRule as R, ItemField
from pageloom.operators import candidates as cand
from pageloom.operators import crawl as cr
from pageloom.operators import registry as reg
from pageloom.operators import summary as sm
from pageloom.operators.jsonld import ld_types
from pageloom.operators.fingerprint import fingerprints
from pageloom.operators.policy import url_policy
from pageloom.operators.rendering import needs_render
from pageloom.operators.skew import as_of_join, hot_keys, latest, running_offsets, spread_join
from pageloom.operators.validate import check_rows, row_errors, run_quality
from pageloom.plans import runs as rn
from pageloom.sources import snapshots as sn

TARGET = ExtractionTarget(
    "roles", (ItemField("title", "str"), ItemField("pay", "int", False), ItemField("url", "url")), "many", 1, ("title", "url")
)


def listing(titles, cls="role", next_url=None, ld=True, nested=False, extra=""):
    items = "".join(
        f'<li class="{cls}"><h3>{t}</h3>{"<div>" if nested else ""}<a href="/r/{t}">open</a>{"</div>" if nested else ""}{extra}</li>' for t in titles
    )
    block = f'<script type="application/ld+json">{json.dumps([{"@type": "Role", "title": t} for t in titles])}</script>' if ld else ""
    link = f'<a class="next" href="{next_url}">next</a>' if next_url else ""
    return f"<html><head><title>x</title>{block}</head><body><ul>{items}</ul>{link}</body></html>"


SPEC = ExtractionSpec(
    (R("title", "h3", "css", transform="trim"), R("url", "a", "css", "href", "abs_url")), "li.role", next_page_selector="a.next"
)


# ---------------------------------------------------------------- summaries
def test_summary_and_prompt(pages_of):
    html = (
        "<html><head><title> Open \n roles</title><style>p{}</style></head><body><!-- <p>gone</p> --><ul id=u class='a b'>"
        + "".join(f"<li><b>n{i}</b><script>x</script></li>" for i in range(4))
        + "</ul><div></div><div></div><div></div><svg><g></g></svg><section>" + "".join(f"<p>{'w' * 90} {i}</p>" for i in range(3)) + "</section></body></html>"
    )
    row = sm.page_summary(pages_of(html)).withColumn("prompt", sm.prompt_text()).withColumn("short", sm.prompt_text(5)).first()
    assert row.title == "Open roles" and row.json_ld_blocks == []
    assert [(g.signature, g["count"], len(g.exemplars)) for g in row.repeating] == [("li", 4, 2), ("p", 3, 2)]
    assert row.repeating[0].exemplars == ["<li> n0", "<li> n1"]
    assert row.outline.split("\n") == [
        "body", "  ul #u .a .b", "    li", '      b: "n0"', "    (+3 more `li`)", "  div", "  (+2 more `div`)", "  section",
        f'    p: "{"w" * 80}…"', "    (+2 more `p`)",
    ]
    assert row.prompt.startswith("[title]\nOpen roles\n\n[groups]\n`li` x4\n<li> n0\n<li> n1\n\n`p")
    assert len(row.short) == 20 and row.prompt.startswith(row.short)


def test_outline_stops_at_depth_eight(pages_of):
    html = "<body>" + "<div>" * 12 + "<i>a</i>" + "</div>" * 12
    assert sm.page_summary(pages_of(html)).first().outline.count("\n") == 8


def test_earliest_group_of_a_signature_wins_and_textless_groups_do_not_count(pages_of):
    small, big = "<ul><li>a<li>b<li>c</ul>", "<ol><li>d<li>e<li>f<li>g</ol>"
    blank = "<div><li></li><li></li><li></li></div>"
    groups = sm.page_summary(pages_of(f"<body>{blank}{small}{big}")).first().repeating
    assert [(g.signature, g["count"], g.exemplars[0]) for g in groups] == [("li", 3, "<li> a")]


def test_fingerprint_follows_structure_not_content(pages_of):
    base = listing(["a", "b", "c"])
    same = [
        listing(["other", "words", "here"]), listing(["a", "b", "c", "d", "e"]), base.replace("/r/a", "https://else.example/x"),
    ]
    hashed = [listing(["a", "b", "c"], cls="role css-1a2b3c"), listing(["a", "b", "c"], cls="role css-9f8e7d")]
    different = [
        listing(["a", "b", "c"], cls="tile"), listing(["a", "b", "c"], ld=False), base.replace("Role", "Event"),
        listing(["a", "b", "c"], nested=True), listing(["a", "b"]),
    ]
    prints = [r.fingerprint for r in fingerprints(pages_of(base, *same, *hashed, *different)).orderBy("page_id").collect()]
    assert set(prints[1:4]) == {prints[0]} and prints[4] == prints[5] != prints[0]
    assert len(set(prints[6:]) - {prints[0], prints[4]}) == len(different)
    assert all(len(p) == 16 for p in prints)


def test_fingerprint_mutations_over_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where(F.contains("html", F.lit("</body>")))
    prints = lambda html: fingerprints(pages.withColumn("html", html)).select("page_id", "fingerprint")
    base, html = prints(F.col("html")), F.col("html")
    text = prints(F.regexp_replace(html, r"(?<=<h1>)[^<]+", "Other words"))
    links = prints(F.regexp_replace(html, 'href="/', 'href="/moved/'))
    wrapped = prints(F.replace(F.replace(html, F.lit("<article>"), F.lit("<main><article>")), F.lit("</article>"), F.lit("</article></main>")))
    renamed = prints(F.replace(html, F.lit('class="ad"'), F.lit('class="promo"')))
    changed = lambda other: base.join(other.withColumnRenamed("fingerprint", "f2"), "page_id").where("fingerprint <> f2").count()
    n = pages.count()
    assert (changed(text), changed(links), changed(wrapped), changed(renamed)) == (0, 0, n, n)


def test_needs_render(pages_of):
    long = "<p>" + "word " * 60 + "</p>"
    pages = pages_of(
        f"<body><div id=root></div>{long}", f"<body><div id=root>text</div>{long}", f"<body><div id=app><p>x</p></div>{long}", "<body><p>short</p>",
        f"<body>{long}", f"<body><noscript>{long}</noscript>", f"<body><iframe>{long}</iframe>",
    )
    assert [r.needs_render for r in needs_render(pages).orderBy("page_id").collect()] == [True, True, False, True, False, True, False]


# --------------------------------------------------------------- validation
def test_quality_gates(spark):
    data = [(1, 0, "a", "http://x.ex", 5), (1, 1, None, "http://x.ex/1", 6), (1, 2, "c", None, 7), (2, 0, " ", "http://y.ex", 1), (2, 1, "", "http://y.ex", 2), (2, 2, "t", "http://y.ex", 3)]
    rows = spark.createDataFrame(data, "run_id int, row_no int, title string, url string, pay long").withColumn("ignored", F.lit(1))
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    checked = check_rows(rows, TARGET, ("run_id", "row_no"))
    q = {r.run_id: r for r in run_quality(checked, runs, TARGET, ("run_id",)).collect()}
    assert (q[1].valid_count, q[1].n_row_errors, q[1].ok, q[1].gate_errors) == (1, 2, True, [])
    assert (q[2].valid_count, q[2].ok) == (3, False)
    assert q[2].gate_errors == ["null_rate title: 67% over 50%"]
    assert q[3].gate_errors[0] == "min_rows: 0 of 1"
    assert (q[3].n_errors, q[3].null_rates["pay"], q[3].ok) == (3, 1.0, False)
    lines = [r.message for r in row_errors(checked, ("run_id",)).orderBy("run_id", "row_no").collect()]
    assert lines == ["title[1]: Input should be a valid string", "url[2]: URL input should be a string or URL"]
    assert "ignored" not in checked.columns


# ------------------------------------------------------------------ registry
NOW, EARLIER = dt.datetime(2024, 6, 1), dt.datetime(2024, 1, 1)


def entry(spark, pages, spec=SPEC, **changes):
    row = fingerprints(pages).select(
        reg.cache_key(F.col("url"), F.lit("roles")).alias("cache_key"), "url", F.lit("roles").alias("target_name"), "fingerprint", F.lit("m0").alias("model"),
        F.lit(spec.to_json()).alias("spec_json"), F.lit(EARLIER).alias("created_at"), F.lit(EARLIER).alias("last_seen_at"), F.lit("r0").alias("run_id"),
        F.lit(5).cast("bigint").alias("tokens_in"), F.lit(1).cast("bigint").alias("tokens_out"),
    )
    for name, value in changes.items():
        row = row.withColumn(name, F.lit(value))
    return row


def status(spark, page, registry, **kw):
    found = reg.lookup(fingerprints(page), registry, "roles")
    return reg.decide(page, found, TARGET, **kw).first().cache_status


def test_reuse_or_drift(spark, pages_of):
    base = pages_of(listing("abc"))
    known, none = entry(spark, base), spark.createDataFrame([], reg.REGISTRY_SCHEMA)
    assert status(spark, base, none) == "miss"
    assert status(spark, base, none, refresh=True) == "miss"
    assert status(spark, pages_of(listing("xyz")), known) == "hit"
    assert status(spark, pages_of(listing("abc", cls="tile")), known) == "drift_regenerated"
    assert status(spark, pages_of(listing("   ")), known) == "drift_regenerated"          # same shape, no titles left
    assert status(spark, base, known, refresh=True) == "drift_regenerated"
    assert status(spark, base, known, use_cache=False) == "disabled"
    assert status(spark, base, entry(spark, base, spec_json="{oops")) == "miss"
    assert status(spark, base, entry(spark, base, spec_json='{"field_rules":[{"field":"a","selector":"b","selector_type":"sql"}]}')) == "miss"
    assert status(spark, base, entry(spark, base, target_name="other")) == "miss"
    assert status(spark, pages_of(("", listing("abc"))), known) == "miss"


def test_run_keeps_only_working_specs_and_bumps_hits(spark, pages_of):
    pages = pages_of(listing("abc"), listing("abc", cls="tile"), listing("abc", cls="tile")).withColumn("run_id", F.concat(F.lit("r"), F.col("page_id"))).withColumn("rendered", F.lit(False))
    known = entry(spark, pages.where("page_id = 0")).unionByName(entry(spark, pages_of(("https://h.example/p/1", listing("abc")))))
    tile = ExtractionSpec(SPEC.field_rules, "li.tile")
    tries = [("https://h.example/p/1", 1, SPEC.to_json()), ("https://h.example/p/1", 2, tile.to_json()), ("https://h.example/p/1", 3, SPEC.to_json()), ("https://h.example/p/2", 1, SPEC.to_json())]
    proposals = spark.createDataFrame([(u, a, s, "m1", 10, 2) for u, a, s in tries], "url string, attempt int, spec_json string, model string, tokens_in long, tokens_out long")
    out = rn.run(pages, TARGET, known, proposals, NOW)
    records = {r.run_id: r for r in out["runs"].collect()}
    assert [(records[k].cache_status, records[k].final_status, records[k].rows_extracted, records[k].attempts, records[k].tokens_in) for k in ("r0", "r1", "r2")] == [
        ("hit", "ok", 3, 1, 0), ("drift_regenerated", "ok", 3, 2, 20), ("miss", "failed", 0, 1, 10),
    ]
    after = {r.url[-1]: r for r in out["registry"].collect()}
    assert set(after) == {"0", "1"}
    assert (after["0"].model, after["0"].last_seen_at, after["0"].created_at) == ("m0", NOW, EARLIER)
    assert (after["1"].model, after["1"].last_seen_at, after["1"].created_at, after["1"].run_id) == ("m1", NOW, EARLIER, "r1")
    assert out["valid"].count() == 6
    rollup = {r.cache_status: (r.n_runs, r.n_failed) for r in rn.status_rollup(out["runs"]).collect()}
    assert rollup == {"hit": (1, 0), "drift_regenerated": (1, 0), "miss": (1, 1)}
    assert [r.page_id for r in rn.refetch_queue(out["runs"], pages).collect()] == [2]
    lines = {(r.page_id, r.attempt): r.line for r in out["attempt_log"].collect()}
    assert lines[(1, 2)] == "m1 attempt 2: ok" and lines[(2, 1)] == "m1 attempt 1: 3 error(s), 0 valid rows"


def test_best_effort_choice(spark):
    data = [(1, 1, False, 2, 5), (1, 2, False, 4, 9), (1, 3, False, 4, 7), (1, 4, False, 4, 7), (2, 1, False, 0, 1), (2, 2, True, 1, 0), (2, 3, True, 9, 0)]
    evaluated = spark.createDataFrame(data, "page_id int, attempt int, ok boolean, valid_count long, n_errors long").select(
        "*", F.lit("s").alias("spec_id"), F.lit("{}").alias("spec_json"), F.lit("m").alias("model"), F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"))
    got = {r.page_id: (r.attempt, r.ok, r.attempts, r.tokens_in) for r in cand.choose(evaluated).collect()}
    assert got == {1: (3, False, 4, 4), 2: (2, True, 2, 2)}


def test_registry_generations(spark, pages_of, tmp_path):
    first = entry(spark, pages_of(listing("abc")))
    reg.write_registry(first, str(tmp_path), 1)
    newer = entry(spark, pages_of(listing("abc")), last_seen_at=NOW, model="m9")
    reg.write_registry(reg.upsert(reg.read_registry(spark, str(tmp_path), 1), newer, entry(spark, pages_of(listing("abc")), model="older")), str(tmp_path), 2)
    rows = reg.read_registry(spark, str(tmp_path), 2).collect()
    assert [(r.model, r.last_seen_at) for r in rows] == [("m9", NOW)]


def registry_rows(spark, first, last, model, seen=EARLIER):
    k = F.col("id").cast("string")
    values = {"cache_key": F.substring(F.sha2(k, 256), 1, 16), "url": k, "target_name": F.lit("roles"), "model": F.lit(model), "spec_json": F.sha2(k, 512),
              "last_seen_at": F.lit(seen), "run_id": F.lit("r")}
    return spark.range(first, last).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in reg.REGISTRY_SCHEMA.fields])


def stored_bytes(path):
    return {p: p.stat().st_size for p in path.glob("data/**/*.parquet")}


def test_a_commit_writes_what_changed(spark, tmp_path):
    path = str(tmp_path)
    assert reg.read_store(spark, path).count() == 0
    assert reg.commit_store(spark, path, registry_rows(spark, 0, 20_000, "a"), buckets=4) == 1
    before = stored_bytes(tmp_path)
    assert reg.commit_store(spark, path, registry_rows(spark, 100, 300, "b", NOW), registry_rows(spark, 100, 200, "old"), buckets=99) == 2
    after = stored_bytes(tmp_path)
    assert all(after[p] == n for p, n in before.items()) and sum(after.values()) - sum(before.values()) < 0.05 * sum(before.values())
    models = {r.model: r["count"] for r in reg.read_store(spark, path).groupBy("model").count().collect()}
    assert models == {"a": 19_800, "b": 200}
    assert reg.read_store(spark, path, 1).where("model = 'a'").count() == 20_000
    assert reg.commit_store(spark, path, registry_rows(spark, 0, 0, "none")) == 3 and reg.read_store(spark, path).count() == 20_000


def test_what_a_lost_writer_leaves_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    reg.commit_store(spark, path, registry_rows(spark, 0, 50, "a"), buckets=2)
    with monkeypatch.context() as m:
        m.setattr(reg, "head", lambda *_, known=reg.head(spark, path): known)
        m.setattr(reg, "COMMIT_SCHEMA", "no such schema")
        with pytest.raises(Exception):
            reg.commit_store(spark, path, registry_rows(spark, 0, 50, "lost", NOW))
    assert len(list(tmp_path.glob("data/part=*"))) == 2
    assert {r.model for r in reg.read_store(spark, path).select("model").collect()} == {"a"}
    assert reg.commit_store(spark, path, registry_rows(spark, 0, 10, "again", NOW)) == 2
    assert reg.read_store(spark, path).where("model = 'again'").count() == 10 and reg.read_store(spark, path).count() == 50


def test_buckets_of_many_parts_are_merged(spark, tmp_path):
    path = str(tmp_path)
    for i in range(5):
        reg.commit_store(spark, path, registry_rows(spark, 0, 10 + i, f"m{i}", dt.datetime(2024, 1, 1 + i)), buckets=1, depth=2)
    parts = reg.head(spark, path).parts
    assert len(parts) <= 2 and {r.model for r in reg.read_store(spark, path).collect()} == {"m4"}
    assert [reg.read_store(spark, path, v).count() for v in range(1, 6)] == [10, 11, 12, 13, 14]


# --------------------------------------------------------------------- crawl
def crawl_pages(pages_of):
    site = {f"https://h.example/l/{i}": listing([f"{i}{c}" for c in "ab"], next_url=f"/l/{i + 1}") for i in range(5)}
    site["https://h.example/l/5"] = listing(["5a"], next_url="/l/3")       # a loop back
    site["https://h.example/gone"] = listing(["g"], next_url="/nowhere")
    site["https://h.example/self"] = listing(["s"], next_url="/self")
    return pages_of(*site.items())


def walk(spark, pages_of, start, limit):
    pages = crawl_pages(pages_of)
    seeds = spark.createDataFrame([(start, start)], "seed string, url string")
    from pageloom.operators.extract import next_links

    walked = cr.mark_missing(cr.walk(seeds, next_links(pages, SPEC), limit), pages).orderBy("seq").collect()
    return [(r.seq, r.url.rsplit("/", 1)[-1], r.missing_page) for r in walked]


def test_walk_stops_at_loops_limits_and_missing_pages(spark, pages_of):
    at = "https://h.example/"
    assert walk(spark, pages_of, at + "l/0", 10) == [(i, str(i), False) for i in range(6)]
    assert walk(spark, pages_of, at + "l/0", 3) == [(i, str(i), False) for i in range(3)]
    assert walk(spark, pages_of, at + "l/4", 0) == [(0, "4", False)]
    assert walk(spark, pages_of, at + "self", 10) == [(0, "self", False)]
    assert walk(spark, pages_of, at + "gone", 10) == [(0, "gone", False), (1, "nowhere", True)]
    assert walk(spark, pages_of, at + "l/4", 100) == [(0, "4", False), (1, "5", False), (2, "3", False)]


def test_detail_enrichment(spark, pages_of):
    pages = crawl_pages(pages_of)
    seeds = spark.createDataFrame([("s", "https://h.example/l/0")], "seed string, url string")
    details = pages_of(*[(f"https://h.example/r/{i}{c}", f"<h3>Detail {i}{c}</h3><p class=d>about {i}{c}</p>") for i in range(5) for c in "ab" if (i, c) != (1, "a")])
    spec = ExtractionSpec((*SPEC.field_rules, R("note", "em", "css")), "li.role", next_page_selector="a.next", detail_url_field="url",
                          detail_field_rules=(R("about", "p.d", "css"), R("title", "h3", "css"), R("note", "h3", "css")))
    out = cr.crawl(pages, seeds, spec, TARGET, 3, details, 5)
    got = [(r.run_row, r.title, r.about, r.note) for r in out["rows"].orderBy("run_row").collect()]
    assert got == [(0, "0a", "about 0a", None), (1, "0b", "about 0b", None), (2, "1a", None, None), (3, "1b", "about 1b", None), (4, "2a", "about 2a", None), (5, "2b", None, None)]
    c = out["counters"].first()
    assert (c.pages_crawled, c.detail_pages_fetched, c.page_urls[-1]) == (3, 5, "https://h.example/l/2")
    filled, _ = cr.enrich(out["rows"].drop("about"), details, spec, 5, fill_nulls=True)
    assert [r.note for r in filled.orderBy("run_row").collect()][:2] == ["Detail 0a", "Detail 0b"]
    replayed = rn.replay(pages, spec, TARGET, seeds, 3, details, 5)
    assert replayed["quality"].first().valid_count == 6 and replayed["counters"].first().pages_crawled == 3
    assert rn.replay(pages, SPEC, TARGET)["quality"].where("ok").count() == pages.count()


def test_walks_and_details_have_no_limit_of_their_own(spark):
    seeds = spark.createDataFrame([("s", "0"), ("t", "30"), ("u", "loop0")], "seed string, url string")
    ends = [(str(i), str(i + 1)) for i in range(34)] + [(f"loop{i}", f"loop{(i + 1) % 12}") for i in range(12)]
    walked = cr.walk(seeds, spark.createDataFrame(ends, "src_url string, dst_url string"))
    got = sorted((r.seed, r.seq, r.url) for r in walked.collect())
    assert got == [("s", i, str(i)) for i in range(35)] + [("t", i, str(30 + i)) for i in range(5)] + [("u", i, f"loop{i}") for i in range(12)]
    rows = walked.withColumn("row_no", F.lit(0))
    assert cr.detail_picks(rows, "url").count() == 52 and cr.detail_picks(rows, "url", 3).count() == 9


def test_copies_of_a_url_are_walked_once(spark, pages_of):
    pages = pages_of(("https://h.example/l", listing("ab")), ("https://h.example/l", listing("cde")))
    seeds = spark.createDataFrame([("s", "https://h.example/l")], "seed string, url string")
    out = cr.crawl(pages, seeds, SPEC, TARGET, 2)
    assert sorted((r.run_row, r.title) for r in out["rows"].collect()) == [(0, "c"), (1, "d"), (2, "e")]


# -------------------------------------------------------------------- policy
ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n", "User-agent: *\nAllow: /a/b\nDisallow: /a\n", "User-agent: loom\nDisallow: /\n\nUser-agent: *\nAllow: /\n",
    "User-agent: other\nUser-agent: LOOM\nDisallow: /a # note\n\nUser-agent: *\nDisallow: /\n", "User-agent: *\nDisallow:\n", "# nothing\n\n", "Disallow: /\nUser-agent: *\nDisallow: /q?x\n",
    "User-agent: *\n\nDisallow: /\n", "User-agent: *\nCrawl-delay: 3\nDisallow: /a%20b\n\nUser-agent: *\nDisallow: /\n",
]


def test_url_policy_agrees_with_the_standard_parser(spark):
    paths = ["", "/", "/a", "/a/b/c", "/ab", "/q?x=1", "/a%20b/c", "/other"]
    urls, want = [], {}
    for i, body in enumerate(ROBOTS):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for p in paths:
            url = f"https://h{i}.example{p}"
            urls.append((url,))
            want[url] = parser.can_fetch("loom/2.0", url)
    urls += [("https://closed.example/x",), ("https://unknown.example/x",)]
    want |= {"https://closed.example/x": True, "https://unknown.example/x": True}
    robots = [(f"h{i}.example", 200, b) for i, b in enumerate(ROBOTS)] + [("closed.example", 403, "User-agent: *\nDisallow: /\n")]
    got = url_policy(spark.createDataFrame(urls, "url string"), spark.createDataFrame(robots, "host string, status int, body string"), "loom/2.0")
    assert {r.url: r.allowed for r in got.collect()} == want


# ---------------------------------------------------------------------- skew
def test_spread_join_equals_a_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 97).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(60)], "k string, v int")
    assert [r.k for r in hot_keys(left, ["k"], 100).collect()] == ["hot"]
    for how in ("left", "inner"):
        got = spread_join(left, right, ["k"], by=["id"], how=how, salts=8, rows=100)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=str)


def test_offsets_and_latest(spark):
    counts = spark.range(5000).select(F.lit("r").alias("g"), F.col("id").alias("seq"), (F.col("id") % 3).alias("n"))
    got = {r.seq: r.offset for r in running_offsets(counts, "g", "seq", "n", chunk=64).collect()}
    total = 0
    for i in range(5000):
        assert got[i] == total
        total += i % 3
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k int, t int, v string")
    assert sorted(map(tuple, latest(df, ["k"], [F.col("t")]).collect())) == [(1, 7, "b"), (2, 1, None)]


# ------------------------------------------------------------------- storage
def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_run_directories(spark, tmp_path):
    root = tmp_path / "runs"
    for run, files in {"r 1": ["page.html", "pages/002.html", "detail/abcd1234.html"], "r2": ["page.html"]}.items():
        for f in files:
            write(root / run / f, f"<p>{run}\n{f}</p>")
            meta = {"url": f"https://h.example/{run}/{f}", "status_code": 200, "fetched_at": "2024-05-01T00:00:00+00:00", "rendered": False}
            write(root / run / ("meta.json" if f == "page.html" else f.replace(".html", ".meta.json")), json.dumps(meta, indent=2))
    entries = [{"url": "u1", "file": "page.html"}, {"url": "u2", "file": "pages/002.html"}, {"url": "u3", "file": "pages/003.html"}]
    write(root / "r 1" / "manifest.json", json.dumps({"version": 1, "pages": entries, "detail": [{"url": "d", "file": "detail/abcd1234.html"}]}, indent=2))
    write(root / "r 1" / "run.json", json.dumps({"run_id": "r 1", "target_name": "roles", "model": "m", "spec": json.loads(SPEC.to_json())}, indent=2))
    write(root / "r2" / "run.json", json.dumps({"run_id": "r2", "target_name": "roles", "model": "m", "spec": None}))
    pages = sn.read_run_pages(spark, str(root))
    assert sorted((r.run_id, r.kind, r.file, r.html, r.status_code) for r in pages.collect())[0] == ("r 1", "detail", "detail/abcd1234.html", "<p>r 1\ndetail/abcd1234.html</p>", 200)
    crawl = sn.crawl_entries(pages, sn.read_manifests(spark, str(root)))
    assert sorted((r.run_id, r.max_pages, r.max_detail) for r in sn.replay_limits(crawl).collect()) == [("r 1", 3, 1), ("r2", 1, 0)]
    missing = sn.replay_pages(crawl, pages).where("missing_page").collect()
    assert [(r.run_id, r.url) for r in missing] == [("r 1", "u3")]
    specs = {r.run_id: r.spec_json for r in sn.stored_specs(spark, str(root)).collect()}
    assert ExtractionSpec.from_json(specs["r 1"]).container_selector == "li.role" and specs["r2"] is None
    sn.save_pages(pages, str(tmp_path / "table"))
    assert sn.read_pages(spark, str(tmp_path / "table")).count() == 4
    sn.save_json(spark.sql("select 1 a, cast(null as string) b"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == '{"a":1,"b":null}'


def test_landed_pages_are_decided_per_batch(spark, pages_of, tmp_path):
    from pageloom.streaming.landing import decide_landed

    base = pages_of(listing("abc"), listing("abc"))
    known = entry(spark, base.where("page_id = 0"))
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    start = lambda: decide_landed(spark, land, str(tmp_path / "cp"), out, TARGET, lambda: known).awaitTermination()
    base.write.parquet(land)
    start()
    pages_of(("https://h.example/p/0", listing("abc", cls="tile"))).write.mode("append").parquet(land)
    start()
    got = sorted((r.batch, r.page_id, r.cache_status) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0, "hit"), (0, 1, "miss"), (1, 0, "drift_regenerated")]


def test_landed_pages_are_learnt_once(spark, pages_of, tmp_path):
    from pageloom.streaming.landing import learn_landed

    land, out, store = (str(tmp_path / n) for n in ("land", "out", "store"))

    def propose(pages, open_pages):
        return open_pages.select("page_id", "url", "fingerprint", F.lit("m").alias("model"), F.lit(SPEC.to_json()).alias("spec_json"), F.lit("r").alias("run_id"),
                                 F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"), F.lit(True).alias("ok"))

    def start():
        learn_landed(spark, land, str(tmp_path / "cp"), out, TARGET, store, propose, lambda: NOW).awaitTermination()
        return sorted((r.batch, r.page_id, r.cache_status) for r in spark.read.parquet(out).collect())

    base = pages_of(listing("abc"))
    base.write.parquet(land)
    assert start() == [(0, 0, "miss")]
    pages_of(listing("xyz"), listing("new")).write.mode("append").parquet(land)
    want = [(0, 0, "miss"), (1, 0, "hit"), (1, 1, "miss")]
    assert start() == want and reg.head(spark, store).version == 2
    for name in ("1", ".1.crc"):                                   # the stream ends before it notes its second batch
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    assert start() == want and reg.head(spark, store).version == 2
    assert reg.read_store(spark, store).count() == 2


def test_types_at_any_depth(pages_of):
    deep = '{"@type":"Leaf"}'
    for _ in range(60):
        deep = '{"x":[' + deep + "]}"
    blocks = {
        '{"@type":["A[1]","B"]}': ["A[1]", "B"],
        '{"@type":["C",["D"]]}': ["C"],
        '{"@type":["E",{"@type":"F"},3,null]}': ["E", "F"],
        '[{"@type":7},{"a":{"@type":"G"}},"@type"]': ["G"],
        deep: ["Leaf"],
        '{"note":"{\\"@type\\":\\"H\\"}"}': [],
        "{broken": ["<unparsed-ld>"],
        '"text"': [],
    }
    pages = pages_of(*[f'<script type="application/ld+json">{b}</script>' for b in blocks], "<p>none</p>")
    got = [r.t for r in pages.select("page_id", ld_types(F.col("html")).alias("t")).orderBy("page_id").collect()]
    assert got == [*blocks.values(), []]


def test_newest_robots_copy_decides_before_its_status(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    closed, news = "User-agent: *\nDisallow: /\n", "User-agent: *\nDisallow: /news\n"
    robots = spark.createDataFrame(
        [("a.example", day(2), 200, closed), ("a.example", day(4), 404, closed), ("a.example", day(6), None, news),
         ("b.example", day(1), 404, closed), ("b.example", day(3), 200, closed), ("a.example", None, 200, closed)],
        "host string, fetched_at timestamp, status int, body string")
    urls = spark.createDataFrame(
        [(i, u, t) for i, (u, t) in enumerate([
            ("http://a.example/news", day(1)), ("http://a.example/news", day(2)), ("http://a.example/x", day(3)), ("http://a.example/news", day(5)),
            ("http://a.example/news", day(7)), ("http://a.example/x", day(7)), ("http://a.example/news", None), ("http://b.example/", day(9)),
            ("http://c.example/", day(9)), (None, day(9))])],
        "n int, url string, fetched_at timestamp")
    timed = {r.n: r.allowed for r in url_policy(urls, robots, "loom/1.0", ("n",)).collect()}
    assert [timed[i] for i in range(10)] == [True, False, False, True, False, True, False, False, True, True]
    last = {r.n: r.allowed for r in url_policy(urls.drop("fetched_at"), robots, "loom/1.0", ("n",)).collect()}
    assert [last[i] for i in range(10)] == [False, False, True, False, False, True, False, False, True, True]


def test_hot_hosts_are_swept_in_parts(spark):
    left = spark.range(300).select("id", F.lit("h").alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([("h", 100, "x"), ("h", 200, "y"), ("g", 0, "z")], "k string, t long, v string")
    got = as_of_join(left, right, ["k"], "t", ["id"], "seen", salts=4, rows=10).select("id", "seen.v").collect()
    assert {r.id: r.v for r in got} == {i: None if i < 100 else "x" if i < 200 else "y" for i in range(300)}


def test_walks_follow_the_spec_of_their_run(pages_of):
    page = lambda title, **links: f"<h1>{title}</h1>" + "".join(f'<a class="{c}" href="{u}">x</a>' for c, u in links.items())
    pages = pages_of(
        ("http://w.example/0", page("zero", on="/1", up="/2")), ("http://w.example/1", page("one", on="/2")), ("http://w.example/2", page("two", on="/0", up="/gone")))
    spec = lambda cls: ExtractionSpec((R("title", "h1", "css"),), "body", next_page_selector=f"a.{cls}").to_json()
    starts = pages.sparkSession.createDataFrame(
        [("a", "http://w.example/0", 0, "on", spec("on")), ("b", "http://w.example/0", 0, "up", spec("up")), ("c", "http://w.example/1", 1, "on", spec("on")),
         ("d", "http://w.example/1", 1, "bad", "{")],
        "seed string, url string, page_id long, spec_id string, spec_json string")
    for limit in (None, 2):
        walked, rows = cr.walk_by_spec(pages, starts, ["title"], max_pages=limit)
        seen = {}
        for r in sorted(walked.collect(), key=lambda r: r.seq):
            seen.setdefault(r.seed, []).append((r.url[-1], r.missing_page))
        whole = {"a": [("0", False), ("1", False), ("2", False)], "b": [("0", False), ("2", False), ("e", True)],
                 "c": [("1", False), ("2", False), ("0", False)], "d": [("1", False)]}
        assert seen == {k: v[:limit] for k, v in whole.items()}
        merged = {}
        for r in sorted(cr.merged_rows(walked, rows).collect(), key=lambda r: r.run_row):
            merged.setdefault(r.seed, []).append((r.run_row, r.title.v))
        names = {"0": "zero", "1": "one", "2": "two"}
        assert merged == {k: [(i, names[u]) for i, (u, gone) in enumerate(v[:limit]) if not gone] for k, v in whole.items() if k != "d"}


def test_a_round_of_walks_reads_only_its_pages(pages_of, monkeypatch):
    sizes, whole = [], cr.extract_assigned
    monkeypatch.setattr(cr, "extract_assigned", lambda pages, *args, **more: sizes.append(pages.count()) or whole(pages, *args, **more))
    pages = pages_of(*[(f"http://r.example/{i}", f'<h1>{i}</h1><a href="/{i + 1}">x</a>') for i in range(3)], *[(f"http://s.example/{i}", "<h1>s</h1>") for i in range(5)])
    spec = ExtractionSpec((R("title", "h1", "css"),), "body", next_page_selector="a").to_json()
    starts = pages.sparkSession.createDataFrame([("a", "http://r.example/0", 0, "s", spec)], "seed string, url string, page_id long, spec_id string, spec_json string")
    walked, rows = cr.walk_by_spec(pages, starts, ["title"])
    assert sorted(r.title.v for r in rows.collect()) == ["0", "1", "2"] and walked.count() == 4
    assert sizes[:3] == [1, 1, 1] and max(sizes) == 1


def test_messages_are_made_for_failed_attempts_only(spark, monkeypatch):
    from pageloom.plans import queries as q

    asked, whole = [], q.extract_assigned
    monkeypatch.setattr(q, "extract_assigned", lambda pages, assigned, *args, **more: asked.append(assigned) or whole(pages, assigned, *args, **more))
    q.repair_requests(spark, "/root/testdata/sf0.001")
    assert asked[0].where("page_id % 2 = 0 and attempt = 2").isEmpty() and not asked[0].where("page_id % 2 = 1 and attempt = 2").isEmpty()


def test_a_summary_gets_only_what_it_shows(pages_of):
    from pageloom.operators.summary import outline, repeating_groups, summary_source

    pages = pages_of("<title> a  b </title><div>" + "<p class=k>x <b>y</b></p>" * 500 + "</div>", "<i>z</i>")
    nodes = F.col("nodes")
    out = summary_source(pages).select("page_id", F.size(nodes["shown"]).alias("n"), outline(nodes).alias("o"), repeating_groups(nodes).alias("g")).orderBy("page_id").collect()
    assert [r.n for r in out] == [4, 2]
    assert out[0].o == 'body\n  div\n    p .k: "x"\n      b: "y"\n    (+499 more `p.k`)'
    assert [(g.signature, g["count"], g.exemplars) for g in out[0].g] == [("p.k", 500, ["<p .k> x y"] * 2)]


def test_types_in_lists_and_escapes_are_found_at_any_depth(pages_of):
    from pageloom.operators.jsonld import ld_types

    block = '<script type="application/ld+json">%s</script>'
    pages = pages_of(block % r'{"@type":"A","x":[{"@type":["B",5,{"@type":"C"}]},{"y":{"@type":"D\"q"}}]}', block % r'{"@type":"A","n":"{\"@type\":\"No\"}","m":{"@type":"E"}}')
    assert [r.t for r in pages.select("page_id", ld_types(F.col("html")).alias("t")).orderBy("page_id").collect()] == [["A", "B", "C", 'D"q'], ["A", "E"]]


def _small_tables(spark, folder):
    """Forty orders of three customers on two boards, as the queries read them."""
    import datetime as dt

    day = dt.datetime(2024, 1, 5)
    orders = [(i * 10, i % 3, "O", 100.0 + i, day, ("1-URGENT", "2-HIGH")[i % 2]) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, f"C{i}", "M") for i in range(3)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_the_steps_of_a_run_read_written_pages_and_a_written_registry(spark, monkeypatch, tmp_path):
    from pageloom.plans import queries as q

    sf, seen = _small_tables(spark, tmp_path), []
    monkeypatch.setattr(q.rn, "run", lambda pages, target, registry, *rest: seen.extend([pages, registry]) or {})
    q._run_second_visit(spark, sf)
    whole = q.reg.decide
    monkeypatch.setattr(q.reg, "decide", lambda pages, *rest: seen.append(pages) or whole(pages, *rest))
    q.drift_status(spark, sf)
    assert len(seen) == 3 and seen[0].count() == seen[2].count() == 8 and seen[1].count() == 6
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_attempts_without_faulty_rows_are_not_run_again_for_messages(spark, monkeypatch, tmp_path):
    from pageloom.plans import queries as q

    asked, whole = [], q.extract_assigned
    monkeypatch.setattr(q, "extract_assigned", lambda pages, assigned, *args, **more: asked.append(assigned) or whole(pages, assigned, *args, **more))
    out = {(r.page_id, r.attempt): r.faults for r in q.repair_requests(spark, _small_tables(spark, tmp_path)).collect()}
    # The first attempt finds no row on any page, the second lacks the company of every row of the odd pages.
    odd, every = {1, 11, 21, 31}, {10 * block + board for block in range(4) for board in (1, 2)}
    assert {(r.page_id, r.attempt) for r in asked[0].collect()} == {(page, 2) for page in odd}
    assert set(out) == {(page, 1) for page in every} | {(page, 2) for page in odd}
    assert all('"rows":[]' in out[page, 1] for page in every) and all('"company[4]: Input should be a valid string"' in out[page, 2] for page in odd)


def test_types_are_read_off_the_text_of_a_block_without_escapes(pages_of):
    from pageloom.operators.jsonld import ld_types

    block = '<script type="application/ld+json">%s</script>'
    texts = ['{ "@type"\n:\t"X y", "a": ", ", "b": [{"@type":{"@type":"In"}}]}', '{"@type":["L",{"@type":"M"}]}', r'{"\u0040type":"U","x":{"@type":"a\/b"}}', '{"@type":"A"} x', '"@type"']
    out = pages_of(*[block % t for t in texts]).select("page_id", ld_types(F.col("html")).alias("t"))
    assert [r.t for r in out.orderBy("page_id").collect()] == [["In", "X y"], ["L", "M"], ["U", "a/b"], ["<unparsed-ld>"], []]
    assert "Contains(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_numbers_of_their_own_kind_are_checked_without_lambdas(spark):
    import re

    from pageloom.functions.coerce import check_value
    from pageloom.model import ItemField

    cells = spark.createDataFrame([(0, "1", "str"), (1, None, "str"), (2, "7", "int"), (3, "x", "absent"), (4, "2.0", "float"), (5, None, None)], "i int, v string, k string")
    for kind, own, want in (
        ("str", "str", [("1", None), (None, "Input should be a valid string"), (None, "Input should be a valid string"), (None, "Input should be a valid string"),
                        (None, "Input should be a valid string"), (None, "Input should be a valid string")]),
        ("int", "int", [(1, None), (None, "Input should be a valid integer"), (7, None), (None, "Unable to parse input string as an integer, exceeded maximum size"),
                        (2, None), (None, "Input should be a valid integer")]),
    ):
        out = cells.select("i", check_value(ItemField("f", kind), F.col("v"), F.col("k")).alias("c"))
        assert [tuple(r.c) for r in out.orderBy("i").collect()] == want
        assert re.search(rf"\(k#\d+ = {own}\)", out._jdf.queryExecution().analyzed().toString())
