"""robots.txt rules applied to a table of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lets import let
from ..functions.urls import host_of, split_url
from .skew import as_of_join, latest, spread_join

_STATE = "struct<state:int,agents:array<string>,rules:array<struct<allow:boolean,path:string>>,groups:array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>>"


def _lines(body: Column) -> Column:
    """(key, value) per line; a line with neither is a group break, others are skipped."""
    raw = F.split(body, r"\r\n|\n|\r")
    parsed = F.transform(
        raw,
        lambda line: F.struct(
            (F.trim(line) == "").alias("blank"),
            F.trim(F.regexp_replace(line, r"#.*\z", "")).alias("text"),
        ),
    )
    kept = F.filter(parsed, lambda p: p["blank"] | (p["text"] != ""))
    return F.transform(
        kept,
        lambda p: F.struct(
            p["blank"].alias("blank"),
            F.lower(F.trim(F.regexp_extract(p["text"], r"\A([^:]*):", 1))).alias("key"),
            let(F.trim(F.regexp_extract(p["text"], r"\A[^:]*:(.*)\z", 1)), _decoded).alias("value"),
        ),
    )


def _close(acc: Column) -> Column:
    group = F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules"))
    return F.concat(acc["groups"], F.array(group))


def rule_groups(body: Column) -> Column:
    """Agent groups of a robots.txt body, in file order: ``array<struct<agents, rules>>``.

    State 0: no agent line yet, 1: agent lines so far, 2: rule lines seen.
    """
    no_agents = F.array().cast("array<string>")
    no_rules = F.array().cast("array<struct<allow:boolean,path:string>>")

    def state(s, agents, rules, groups):
        return F.struct(
            (F.lit(s) if isinstance(s, int) else s).cast("int").alias("state"), agents.alias("agents"), rules.alias("rules"), groups.alias("groups")
        ).cast(_STATE)

    def step(acc: Column, line: Column) -> Column:
        closed = F.when(acc["state"] == 2, _close(acc)).otherwise(acc["groups"])
        agents = F.when(acc["state"] == 2, no_agents).otherwise(acc["agents"])
        rules = F.when(acc["state"] == 2, no_rules).otherwise(acc["rules"])
        # An empty Disallow allows everything.
        allow = (line["key"] == "allow") | (line["value"] == "")
        rule = F.struct(allow.alias("allow"), line["value"].alias("path"))
        return (
            F.when(line["blank"] & (acc["state"] == 0), acc)
            .when(line["blank"], state(0, no_agents, no_rules, closed))
            .when(line["key"] == "user-agent", state(1, F.concat(agents, F.array(line["value"])), rules, closed))
            .when(
                line["key"].isin("allow", "disallow") & (acc["state"] != 0),
                state(2, acc["agents"], F.concat(acc["rules"], F.array(rule)), acc["groups"]),
            )
            .when(
                line["key"].isin("crawl-delay", "request-rate") & (acc["state"] != 0),
                state(2, acc["agents"], acc["rules"], acc["groups"]),
            )
            .otherwise(acc)
        )

    start = state(0, no_agents, no_rules, F.array().cast("array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>"))
    return F.aggregate(_lines(body), start, step, lambda acc: F.when(acc["state"] == 2, _close(acc)).otherwise(acc["groups"]))


def rules_for_agent(body: Column, user_agent: str) -> Column:
    """The rules that apply to an agent: its first matching group, else the first '*' group."""
    name = user_agent.split("/")[0].lower()
    groups = rule_groups(body)
    is_default = lambda g: F.array_contains(g["agents"], F.lit("*"))
    own = lambda g: ~is_default(g) & F.exists(g["agents"], lambda a: F.contains(F.lit(name), F.lower(a)))
    return let(
        groups,
        lambda gs: F.coalesce(
            F.get(F.filter(gs, own), F.lit(0))["rules"], F.get(F.filter(gs, is_default), F.lit(0))["rules"]
        ),
    )


def _decoded(text: Column) -> Column:
    """Percent-decoded text; text that does not decode stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _request_path(url: Column) -> Column:
    """Decoded path and query of a url, '/' when empty."""
    whole = let(
        split_url(url),
        lambda p: F.concat(p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))),
    )
    return let(let(whole, _decoded), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def url_policy(urls: DataFrame, robots: DataFrame, user_agent: str, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """``urls`` with ``allowed``; every url is checked on its own.

    ``robots``: host, status, body. A missing file or a status of 400 and above allows
    everything. The rules of a host travel as one array per host, so a url meets them
    once, and a host with a large share of the urls is salted.

    With ``fetched_at`` in ``robots`` a host may have many copies, and the newest one counts whatever its status. Where
    ``urls`` has ``fetched_at`` too, the newest is the newest at that time: before the first copy everything is allowed,
    and a url without time sees the last one. Copies of one time: the higher status, then the greater rules.
    """
    found = F.when(F.coalesce(F.col("status"), F.lit(200)) < 400, rules_for_agent(F.col("body"), user_agent))
    hosted = urls.withColumn("host", host_of(F.col("url")))
    if "fetched_at" not in robots.columns:
        # Copies without a time: any readable one, the same in every run.
        known = robots.where(F.coalesce(F.col("status"), F.lit(200)) < 400).groupBy("host").agg(F.max("body").alias("body"))
        rules = known.select("host", rules_for_agent(F.col("body"), user_agent).alias("rules"))
        joined = spread_join(hosted, rules, ["host"], by=by)
    else:
        copies = robots.select("host", "fetched_at", F.coalesce("status", F.lit(200)).alias("status"), found.alias("rules"))
        if "fetched_at" in urls.columns:
            timed = hosted.withColumn("_time", F.coalesce("fetched_at", F.lit("9999-12-31").cast("timestamp")))
            swept = as_of_join(timed, copies.withColumnRenamed("fetched_at", "_time"), ["host"], "_time", by, "_copy")
            joined = swept.withColumn("rules", F.col("_copy.rules")).drop("_copy", "_time")
        else:
            newest = latest(copies, ["host"], [F.col("fetched_at"), F.col("status"), F.col("rules")])
            joined = spread_join(hosted, newest.select("host", "rules"), ["host"], by=by)
    path = _request_path(F.col("url"))
    verdict = let(
        path,
        lambda p: F.get(
            F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(p, r["path"])), F.lit(0)
        )["allow"],
    )
    return joined.withColumn("allowed", F.coalesce(verdict, F.lit(True))).drop("rules")
