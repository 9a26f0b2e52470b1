"""Run extraction specs over a table of pages.

A spec becomes one Column that builds the page's array of raw rows; exploding that
array is the only thing left to do. The plan has no join and no shuffle, whatever
the selectors are, so its cost is the scan, the shredding and the output.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lets import let
from ..functions.text import float_text
from ..functions.transforms import KIND, TRANSFORMS, apply_transform
from ..functions.urls import resolve_url
from ..model import SELECTOR_TYPES, ExtractionSpec, FieldRule
from . import jsonld
from .programs import compile_spec, compiled, run_one, run_programs
from .selectors import Selector, SelectorError, first_match, parse_selector, select_nodes, text_slice
from .shred import EXTRACT_FIELDS, shred
from .skew import spread_join


@dataclass(frozen=True)
class _Needs:
    tree: bool
    objects: bool


def _container_selector(spec: ExtractionSpec) -> Selector | None:
    kind = spec.container_selector_type
    if kind == "regex":
        raise ValueError("a regex cannot select containers")
    return parse_selector(spec.container_selector or "*", kind)


def _iterates_objects(spec: ExtractionSpec, cardinality: str) -> bool:
    return cardinality == "many" and spec.container_selector_type == "json_ld"


def _needs(spec: ExtractionSpec, cardinality: str) -> _Needs:
    if _iterates_objects(spec, cardinality):
        return _Needs(tree=False, objects=True)
    kinds = {r.selector_type for r in spec.effective_rules().values()}
    return _Needs(tree=cardinality == "many" or bool(kinds & {"css", "xpath"}), objects="json_ld" in kinds)


def java_regex(pattern: str) -> tuple[str, int]:
    """The pattern for ``regexp_extract`` and the group that holds the value."""
    groups = re.compile(pattern, re.DOTALL).groups
    translated = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    translated = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", translated)
    return "(?sU)" + translated, 1 if groups else 0


def _regex_value(source: Column, pattern: str) -> Column:
    java, group = java_regex(pattern)
    if group == 0:
        return F.regexp_substr(source, F.lit(java))
    return F.when(source.rlike(java), F.regexp_extract(source, java, group))


def _tree_value(rule: FieldRule, nodes: Column, text: Column, root: Column) -> Column:
    sel = parse_selector(rule.selector, rule.selector_type)
    attribute = rule.attribute if rule.attribute and rule.attribute != "text" else None
    if sel.reads and sel.reads.startswith("@"):
        attribute = sel.reads[1:].lower()

    def read(n: Column) -> Column:
        if sel.reads == "text()":
            return n["first_text"]
        if attribute:
            return F.try_element_at(n["attrs"], F.lit(attribute))
        return F.when(n.isNotNull(), text_slice(text, n["t0"], n["t1"]))

    return let(first_match(sel, nodes, root), read)


def _dom_row(spec: ExtractionSpec, root: Column, page: dict[str, Column], slice_html: bool) -> Column:
    values = []
    for name, rule in spec.effective_rules().items():
        if rule.selector_type in ("css", "xpath"):
            value = _tree_value(rule, F.col("nodes"), page["text"], root)
        elif rule.selector_type == "regex":
            source = text_slice(page["html"], root["h0"], root["h1"]) if slice_html else F.col("html")
            value = _regex_value(source, rule.selector)
        else:
            value = F.try_element_at(page["values"], F.lit(rule.selector))
        values.append(value.alias(name))
    return F.struct(*values) if values else F.struct(F.lit(None).cast("string").alias("_"))


def _with_page(spec: ExtractionSpec, tree: bool, body: Callable[[dict[str, Column]], Column]) -> Column:
    """Bind the page-level values the rules read, once per page.

    Reading a binary column copies it, and a projected column may be inlined where it
    is used; inside a lambda over containers either would repeat per container.
    """
    kinds = {r.selector_type for r in spec.effective_rules().values()}
    wanted = {}
    if tree and kinds & {"css", "xpath"}:
        wanted["text"] = F.col("text")
    if tree and "regex" in kinds:
        wanted["html"] = F.col("html").cast("binary")
    if "json_ld" in kinds:
        wanted["values"] = F.col("page_values")

    def bind(names: list[str], page: dict[str, Column]) -> Column:
        if not names:
            return body(page)
        return let(wanted[names[0]], lambda v: bind(names[1:], {**page, names[0]: v}))

    return bind(list(wanted), {})


def _raw_rows(spec: ExtractionSpec, cardinality: str) -> Column:
    """``array<struct<field: string>>``: the untransformed rows of one page."""
    rules = spec.effective_rules()
    if _iterates_objects(spec, cardinality):
        chosen = F.filter(F.col("objects"), lambda o: jsonld.type_matches(o, spec.container_selector))
        return F.transform(
            chosen,
            lambda o: F.struct(
                *[
                    (jsonld.path_text(o, r.selector) if r.selector_type == "json_ld" else F.lit(None).cast("string"))
                    .alias(name)
                    for name, r in rules.items()
                ]
            ),
        )
    if cardinality == "many":
        containers = select_nodes(_container_selector(spec), F.col("nodes"))
        return _with_page(
            spec, True, lambda page: F.transform(containers, lambda c: _dom_row(spec, c, page, slice_html=True))
        )
    if not _needs(spec, cardinality).tree:
        return _with_page(spec, False, lambda page: F.array(_dom_row(spec, F.lit(None), page, slice_html=False)))
    whole = F.slice(F.col("nodes"), 1, 1)
    return _with_page(
        spec, True, lambda page: F.transform(whole, lambda c: _dom_row(spec, c, page, slice_html=False))
    )


def _reads_text(selector: str, kind: str) -> bool:
    return kind in ("css", "xpath") and parse_selector(selector, kind).reads == "text()"


def _page_values(specs: list[ExtractionSpec]) -> Column:
    """Page-level JSON-LD values by path, for json_ld rules inside tree rows."""
    paths = sorted(
        {r.selector for s in specs for r in s.effective_rules().values() if r.selector_type == "json_ld"}
    )
    return let(
        F.col("objects"),
        lambda objects: F.create_map(*[c for p in paths for c in (F.lit(p), jsonld.first_path_text(objects, p))]),
    )


def _prepare(pages: DataFrame, specs: list[ExtractionSpec], cardinality: str, tree: bool = False) -> DataFrame:
    """Add the page-level columns the specs read: nodes and text, objects, page_values."""
    needs = [_needs(s, cardinality) for s in specs]
    out = pages
    if tree or any(n.tree for n in needs):
        regex = any(r.selector_type == "regex" for s in specs for r in s.field_rules)
        keep = regex or any(n.objects for n in needs)
        own = any(_reads_text(r.selector, r.selector_type) for s in specs for r in s.field_rules)
        own = own or any(_reads_text(s.next_page_selector, s.next_page_selector_type) for s in specs if s.next_page_selector)
        out = shred(out, EXTRACT_FIELDS + (("first_text",) if own else ()), keep_html=keep)
    if any(n.objects for n in needs):
        out = out.withColumn("objects", jsonld.jsonld_objects(F.col("html")))
        mixed = [s for s in specs if not _iterates_objects(s, cardinality) and _needs(s, cardinality).objects]
        if mixed:
            out = out.withColumn("page_values", _page_values(mixed))
    return out


def _value(rule: FieldRule, raw: Column, as_of: dt.date | None) -> Column:
    return apply_transform(rule.transform, raw, F.col("page_url"), as_of)


def _next_value(spec: ExtractionSpec) -> Column:
    """Absolute next-page url of a page, NULL without one."""
    if not spec.next_page_selector:
        return F.lit(None).cast("string")
    rule = FieldRule("next", spec.next_page_selector, spec.next_page_selector_type, spec.next_page_attribute)
    root = F.get(F.col("nodes"), F.lit(0))
    return let(
        _tree_value(rule, F.col("nodes"), F.col("text"), root),
        lambda v: F.when(v != "", resolve_url(F.col("page_url"), v)),
    )


def extract_pages(
    pages: DataFrame, spec: ExtractionSpec, cardinality: str = "many", keep: tuple[str, ...] = (), links: bool = True
) -> DataFrame:
    """One row per page from a single shred: ``page_id, page_url, *keep, next_url, raw_rows``."""
    clash = {"page_id", "page_url", "row_no", *keep} & set(spec.effective_rules())
    if clash:
        raise ValueError(f"field names {sorted(clash)} are taken by row keys")
    source = pages.select("page_id", F.col("url").alias("page_url"), "html", *keep)
    tree = links and spec.next_page_selector is not None
    if (tree or _needs(spec, cardinality).tree) and _runs_as_program(spec):
        return _by_program(source, spec, cardinality, keep, tree)
    prepared = _prepare(source, [spec], cardinality, tree)
    link = _next_value(spec) if tree else F.lit(None).cast("string")
    return prepared.select(
        "page_id", "page_url", *keep, link.alias("next_url"), _raw_rows(spec, cardinality).alias("raw_rows")
    )


def _runs_as_program(spec: ExtractionSpec) -> bool:
    """Whether the evaluator gives the tree values of a spec exactly as the Columns do.

    They differ in siblings of a rule's own element, in words of an attribute cut at control characters, and in text tests.
    """
    rules = [(r.selector, r.selector_type) for r in spec.effective_rules().values() if r.selector_type in ("css", "xpath")]
    container = [(spec.container_selector or "*", spec.container_selector_type)] if spec.container_selector_type in ("css", "xpath") else []
    link = [(spec.next_page_selector, spec.next_page_selector_type)] if spec.next_page_selector else []
    if link and not spec.next_page_attribute:
        return False
    for steps in (chain for text, kind in rules + container + link for chain in parse_selector(text, kind).chains):
        tests = [t for step in steps for t in _all_tests(step.tests)]
        if any(step.link in ("+", "~") for step in steps) or any(t[0] in ("text", "space") or (t[0] == "attr" and t[2] == "~=") for t in tests):
            return False
    return True


def _by_program(source: DataFrame, spec: ExtractionSpec, cardinality: str, keep: tuple[str, ...], tree: bool) -> DataFrame:
    """``extract_pages`` with the tree read by the evaluator; regexes and JSON-LD stay Columns."""
    rules = spec.effective_rules()
    objects = _iterates_objects(spec, cardinality)
    if cardinality == "many" and not objects:
        _container_selector(spec)
    kinds = {r.selector_type for r in rules.values()}
    made = replace(spec, next_page_selector=spec.next_page_selector if tree else None)
    if objects:
        made = replace(made, field_rules=(), container_selector=None, container_selector_type="css")
    program = compile_spec(made.to_json(), "one" if objects else cardinality, SELECTOR_TYPES, tuple(TRANSFORMS))
    whole = cardinality != "many"
    regex = "regex" in kinds and not objects
    found = run_one(source, program, keep_html="json_ld" in kinds or objects or (regex and whole), sources=regex and not whole)
    if objects or "json_ld" in kinds:
        found = found.withColumn("objects", jsonld.jsonld_objects(F.col("html")))
    if "json_ld" in kinds and not objects:
        found = found.withColumn("page_values", _page_values([spec]))

    def row(c: Column, values: Column | None) -> Column:
        cells = []
        for i, (name, rule) in enumerate(rules.items()):
            if rule.selector_type in ("css", "xpath"):
                cell = c[f"f{i}"]
            elif rule.selector_type == "regex":
                cell = _regex_value(F.col("html") if whole else c["source"], rule.selector)
            else:
                cell = F.try_element_at(values, F.lit(rule.selector))
            cells.append(cell.alias(name))
        return F.struct(*cells) if cells else F.struct(F.lit(None).cast("string").alias("_"))

    if objects:
        rows = _raw_rows(spec, cardinality)
    else:
        each = lambda values: F.transform("found", lambda c: row(c, values))
        if not _needs(spec, cardinality).tree:
            each = lambda values: F.array(row(F.get(F.col("found"), F.lit(0)), values))
        rows = let(F.col("page_values"), each) if "json_ld" in kinds else each(None)
    link = let(F.col("next_raw"), lambda v: F.when(v != "", resolve_url(F.col("page_url"), v))) if tree else F.lit(None).cast("string")
    return found.select("page_id", "page_url", *keep, link.alias("next_url"), rows.alias("raw_rows"))


def rows_of(
    extracted: DataFrame, spec: ExtractionSpec, as_of: dt.date | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Explode the raw rows of ``extract_pages`` and apply the transforms."""
    # The inner form would also ask for the size of the list below the projection that makes it, and so make it twice.
    rows = extracted.select("page_id", "page_url", *keep, F.posexplode_outer("raw_rows").alias("row_no", "raw")).where(F.col("row_no").isNotNull())
    return rows.select(
        "page_id", "page_url", *keep, "row_no",
        *[_value(rule, F.col("raw")[name], as_of).alias(name) for name, rule in spec.effective_rules().items()],
    )


def _beyond_columns(spec: ExtractionSpec) -> bool:
    """Whether a spec tests the text of elements, or has a group that may stay out of a match: work for the evaluator."""
    groups = [r.selector for r in spec.field_rules if r.selector_type == "regex" and re.compile(r.selector, re.DOTALL).groups]
    if any("|" in g or re.search(r"\)(?:[?*]|\{0?,)", g) for g in groups):
        return True
    chosen = [(r.selector, r.selector_type) for r in spec.field_rules] + [(spec.container_selector or "*", spec.container_selector_type)]
    kinds = {t[0] for text, kind in chosen if kind in ("css", "xpath") for chain in parse_selector(text, kind).chains for step in chain for t in _all_tests(step.tests)}
    return bool(kinds & {"text", "space"})


def _all_tests(tests) -> list[tuple]:
    return [t for test in tests for t in ([test] if test[0] not in ("is", "not") else [x for group in test[1] for x in _all_tests(group)])]


def extract(
    pages: DataFrame,
    spec: ExtractionSpec,
    cardinality: str = "many",
    as_of: dt.date | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of every page: ``page_id, page_url, *keep, row_no`` and one column per field.

    ``pages`` has ``page_id``, ``url`` and ``html``. ``row_no`` counts from 0 in
    document order within the page. Field columns take the type of their transform.
    """
    if not _beyond_columns(spec):
        return rows_of(extract_pages(pages, spec, cardinality, keep, links=False), spec, as_of, keep)
    rules = spec.effective_rules()
    program = compile_spec(spec.to_json(), cardinality, SELECTOR_TYPES, tuple(TRANSFORMS))
    source = pages.select("page_id", F.col("url").alias("page_url"), "html", *keep, F.array(F.lit(program)).alias("programs"))
    rows = run_programs(source, list(rules))
    return rows.select(
        "page_id", "page_url", *keep, "row_no", *[_value(rule, F.col("cells")[i]["raw"], as_of).alias(name) for i, (name, rule) in enumerate(rules.items())])


def _tagged(cell: Column, as_of: dt.date | None) -> Column:
    """A raw cell through the transform it names, as text together with its kind, so that rows of all specs line up."""
    text = F.when(cell["raw"].isNull() | (cell["how"] == ""), cell["raw"])
    kind = F.when(cell["how"] == "absent", F.lit("absent"))
    for name in TRANSFORMS:
        value = apply_transform(name, cell["raw"], F.col("page_url"), as_of)
        text = text.when(cell["how"] == name, float_text(value) if KIND[name] == "float" else value.cast("string"))
        if KIND[name] != "str":
            kind = kind.when(cell["how"] == name, F.lit(KIND[name]))
    return F.struct(text.otherwise(cell["raw"]).alias("v"), kind.otherwise(F.lit("str")).alias("k"))


def extract_assigned(
    pages: DataFrame,
    assigned: DataFrame,
    fields: list[str],
    cardinality: str = "many",
    as_of: dt.date | None = None,
    keep: tuple[str, ...] = (),
    links: bool = False,
) -> DataFrame:
    """Rows of pages by the specs assigned to them: any number of specs, one scan and one shred.

    ``assigned`` (page_id, spec_id, spec_json and the ``keep`` fields that tell apart several specs of a page) is compiled as data; a
    bad spec yields no rows (``compiled`` has its error). Fields come out as ``struct<v: string, k: string>`` (value and kind;
    kind 'absent' when the spec has no such field). With ``links``, ``next_url`` is set on the row of a page's next link, numbered -1.
    """
    programs = compiled(assigned, cardinality, SELECTOR_TYPES, tuple(TRANSFORMS)).drop("spec_error")
    named = spread_join(assigned.select("page_id", "spec_id", *keep), programs, ["spec_id"], by=["page_id", *keep])
    lists = named.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*keep, "spec_id", "program"))).alias("specs"))
    source = pages.select("page_id", F.col("url").alias("page_url"), "html").join(lists, "page_id").select(
        "page_id", "page_url", "html", F.transform("specs", lambda s: F.struct(s["spec_id"].alias("spec_id"), *[s[k].alias(k) for k in keep])).alias("specs"),
        F.col("specs.program").alias("programs"))
    rows = run_programs(source, fields, links).withColumn("s", F.get("specs", F.col("slot")))
    cells = F.when(F.col("row_no") >= 0, F.transform("cells", lambda c: _tagged(c, as_of)))
    following = [resolve_url(F.col("page_url"), F.when(F.col("row_no") < 0, F.get("cells", F.lit(0))["raw"])).alias("next_url")] if links else []
    made = rows.select("page_id", "page_url", F.col("s.spec_id").alias("spec_id"), *[F.col(f"s.{k}").alias(k) for k in keep], "row_no", cells.alias("cells"), *following)
    return made.select(
        "page_id", "page_url", "spec_id", *keep, "row_no", *[F.get("cells", F.lit(i)).alias(f) for i, f in enumerate(fields)], *(["next_url"] if links else []))


def extract_by_spec(
    pages: DataFrame,
    specs: Mapping[str, ExtractionSpec],
    fields: list[str],
    cardinality: str = "many",
    as_of: dt.date | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``extract_assigned`` for pages that list their specs in ``assigned`` (structs of spec_id and the ``keep`` fields), with given specs."""
    if not specs:
        raise ValueError("no specs given")
    known = pages.sparkSession.createDataFrame([(n, s.to_json()) for n, s in specs.items()], "spec_id string, spec_json string")
    listed = pages.select("page_id", F.explode("assigned").alias("a")).select("page_id", "a.spec_id", *[F.col(f"a.{k}").alias(k) for k in keep])
    return extract_assigned(pages, spread_join(listed, known, ["spec_id"], ["page_id"], "inner"), fields, cardinality, as_of, keep)


def links_of(extracted: DataFrame) -> DataFrame:
    """Next links among the pages of ``extract_pages``: ``page_id, src_url, dst_url``."""
    return extracted.where(F.col("next_url").isNotNull()).select(
        "page_id", F.col("page_url").alias("src_url"), F.col("next_url").alias("dst_url")
    )


def next_links(pages: DataFrame, spec: ExtractionSpec) -> DataFrame:
    """``page_id, src_url, dst_url`` for every page whose spec finds a next-page link."""
    only_link = replace(spec, field_rules=(), container_selector=None, container_selector_type="css")
    return links_of(extract_pages(pages, only_link, "one"))
