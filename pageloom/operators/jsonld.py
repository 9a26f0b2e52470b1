"""JSON-LD blocks and objects of a page, as arrays of text and VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lets import let, shared
from ..functions.text import float_text, trim_ws

# One pass over the source: comments and other raw-text elements are consumed whole,
# so that only real JSON-LD script elements leave text in group 1.
_BLOCKS = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script(?=\s)(?=[^>]*?\stype\s*=\s*(?:\"application/ld\+json\"|'application/ld\+json'"
    r"|application/ld\+json(?=[\s>])))[^>]*>((?:[^<]++|<(?!/script\s*>))*+)(?:</script\s*>|\z)"
    r"|(?:script|style|textarea|title)(?=[\s>])[^>]*>.*?(?:</(?:script|style|textarea|title)\s*>|\z))"
)


def jsonld_blocks(html: Column) -> Column:
    """Text of every ``script[type="application/ld+json"]`` of a page, in order."""
    return F.filter(F.regexp_extract_all(html, F.lit(_BLOCKS), F.lit(1)), lambda b: b != "")


def parse_block(block: Column) -> Column:
    """VARIANT of a block, NULL when the whole block is not exactly one JSON value."""
    values = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), block, F.lit("]"))), "$", "array<variant>"
    )
    return let(values, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


# Shallow casts: the schema of a container would describe everything below it as well.
def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _graph(v: Column) -> Column:
    return F.try_variant_get(v, "$['@graph']", "array<variant>")


def _unfold(entry: Column) -> Column:
    """Children of an array; children of '@graph' followed by the wrapper itself."""
    v = entry["v"]
    todo = lambda items: F.transform(items, lambda i: F.struct(i.alias("v"), F.lit(False).alias("done")))
    own = F.array(F.struct(v.alias("v"), F.lit(True).alias("done")))
    inside = let(_graph(v), lambda g: F.when(g.isNotNull(), F.concat(todo(g), own)).otherwise(own))
    listed = let(F.try_variant_get(v, "$", "array<variant>"), lambda items: F.when(items.isNotNull(), todo(items)).otherwise(inside))
    return F.when(entry["done"], F.array(entry)).otherwise(listed)


def _unfold_all(entries: Column, blocks: Column) -> Column:
    """``entries`` unfolded until none is left to do; each level opens a bracket of its own."""
    text = F.array_join(blocks, "")
    levels = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("["), F.lit(""))))
    step = lambda found, _: F.when(F.exists(found, lambda e: ~e["done"]), F.flatten(F.transform(found, _unfold))).otherwise(found)
    return F.aggregate(levels, entries, step)


def jsonld_objects(html: Column, depth: int | None = None) -> Column:
    """All JSON-LD objects of a page in document order, as ``array<variant>``.

    Blocks that are not JSON are skipped. Arrays and @graph wrappers are unfolded however
    deep they nest; where ``depth`` is given, a deeper page raises an error instead of losing objects.
    """

    def entries_of(blocks: Column) -> Column:
        parsed = F.filter(F.transform(blocks, parse_block), lambda v: v.isNotNull())
        return F.transform(parsed, lambda v: F.struct(v.alias("v"), F.lit(False).alias("done")))

    if depth is None:
        unfolded = let(jsonld_blocks(html), lambda blocks: _unfold_all(entries_of(blocks), blocks))
        return F.filter(F.transform(unfolded, lambda e: e["v"]), is_object)
    entries = entries_of(jsonld_blocks(html))
    for _ in range(depth):
        entries = F.flatten(F.transform(entries, _unfold))
    objects = F.transform(
        entries,
        lambda e: F.when(
            ~e["done"] & (is_array(e["v"]) | (is_object(e["v"]) & _graph(e["v"]).isNotNull())),
            F.raise_error(F.lit(f"JSON-LD nested deeper than {depth} levels; raise the depth")).cast("variant"),
        ).otherwise(e["v"]),
    )
    return F.filter(objects, is_object)


def type_matches(obj: Column, wanted: str | None) -> Column:
    """'@type' equals ``wanted`` or lists it; every object matches None."""
    if wanted is None:
        return F.lit(True)
    named = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    listed = lambda t: F.exists(F.transform(F.try_variant_get(t, "$", "array<variant>"), named), lambda n: n == wanted)
    judged = lambda t: F.when(_kind(t) == "STRING", F.try_variant_get(t, "$", "string") == wanted).otherwise(F.coalesce(listed(t), F.lit(False)))
    return let(F.try_variant_get(obj, "$['@type']", "variant"), judged)


@shared
def scalar_text(v: Column) -> Column:
    """Text of a JSON scalar: numbers and booleans spelled out, anything else NULL."""
    number = F.try_variant_get(v, "$", "double")
    precision = lambda kind: F.regexp_extract(kind, r"\ADECIMAL\((\d+),0\)", 1).try_cast("int")
    return let(
        _kind(v),
        lambda kind: F.when(kind.isin("STRING", "BIGINT") | (precision(kind) > 18), F.try_variant_get(v, "$", "string"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .when(kind.rlike(r"\A(?:DECIMAL|DOUBLE|FLOAT)"), float_text(number)),
    )


def _member(v: Column, step: str, through_lists: bool) -> Column:
    direct = lambda c: F.try_variant_get(c, "$" + step, "variant")
    if not through_lists:
        return direct(v)
    return let(v, lambda c: F.coalesce(F.try_variant_get(c, "$[0]" + step, "variant"), direct(c)))


def path_text(obj: Column, dotted: str) -> Column:
    """Value at a dotted path; the first element of any list on the way is taken."""
    current = obj
    for i, part in enumerate(dotted.split(".")):
        key = part.replace("\\", "\\\\").replace("'", "\\'")
        current = _member(current, f"['{key}']", through_lists=i > 0)
    leaf = let(current, lambda c: F.when(is_array(c), F.try_variant_get(c, "$[0]", "variant")).otherwise(c))
    return scalar_text(leaf)


def first_path_text(objects: Column, dotted: str) -> Column:
    """First non-NULL value of a path over the objects of a page."""
    values = F.transform(objects, lambda o: path_text(o, dotted))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def surfaced_blocks(html: Column) -> Column:
    """Blocks as shown in a page summary: JSON without layout, or the trimmed raw text."""
    return F.transform(
        jsonld_blocks(html),
        lambda b: F.coalesce(F.when(parse_block(b).isNotNull(), F.get_json_object(b, "$")), trim_ws(b)),
    )


def _own_types(v: Column) -> Column:
    """Names in the '@type' of an object: the string, or the strings of a list; none for other values."""
    own = F.try_variant_get(v, "$['@type']", "variant")
    listed = let(own, lambda t: F.coalesce(F.try_variant_get(t, "$", "array<variant>"), F.array(t)))
    return F.transform(F.filter(listed, lambda t: _kind(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))


def _below(v: Column) -> Column:
    """Containers right below a value."""
    none = F.array().cast("array<variant>")
    children = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), none)
    return F.filter(children, lambda c: is_object(c) | is_array(c))


#: In JSON without escapes, an '@type' key with a string, and one with a list.
_TYPE = r'[{,][ \t\r\n]*+"@type"[ \t\r\n]*+:[ \t\r\n]*+"([^"]*)"'
_TYPE_LIST = r'[{,][ \t\r\n]*+"@type"[ \t\r\n]*+:[ \t\r\n]*+\['
#: In JSON as VARIANT spells it, the second of them or one with a string that holds an escape.
_TYPE_ELSE = r'[{,]"@type":(?:\[|"[^"\\]*+\\)'


def _types_at_any_depth(blocks: Column, html: Column) -> Column:
    """Type names of blocks (structs of text and parsed value). Plain strings are read off the JSON text, where an unescaped quote
    always ends a string; blocks with lists of types or escapes in them are walked. A text with any escape is spelled anew first."""
    spelled = lambda b: F.when(F.contains(b["text"], F.lit("\\")), F.to_json(b["v"])).otherwise(b["text"])
    other = lambda t: F.when(F.contains(t, F.lit("\\")), t.rlike(_TYPE_ELSE)).otherwise(t.rlike(_TYPE_LIST))
    plain = lambda texts: F.when(F.exists(texts, other), _walked_types(F.transform(blocks, lambda b: b["v"]), html)).otherwise(
        F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(_TYPE), F.lit(1))))))
    return let(F.transform(blocks, spelled), plain)


def _walked_types(blocks: Column, html: Column) -> Column:
    """A worklist that goes one level down a step, until no container is left."""
    start = F.struct(F.array().cast("array<string>").alias("names"), blocks.alias("todo")).cast(_WORK)
    text = F.array_join(jsonld_blocks(html), "")
    deepest = F.length(text) - F.length(F.regexp_replace(text, r"[\[{]", ""))
    step = lambda acc, _: F.when(F.size(acc["todo"]) == 0, acc).otherwise(
        F.struct(
            F.array_distinct(F.concat(acc["names"], F.flatten(F.transform(acc["todo"], _own_types)))).alias("names"),
            F.flatten(F.transform(acc["todo"], _below)).alias("todo"),
        ).cast(_WORK)
    )
    return F.aggregate(F.sequence(F.lit(0), deepest), start, step, lambda acc: acc["names"])


_WORK = "struct<names:array<string>,todo:array<variant>>"


def ld_types(html: Column) -> Column:
    """Sorted distinct '@type' names at any depth, with a marker for unreadable blocks."""
    block = lambda b: F.struct(b.alias("text"), parse_block(b).alias("v"))
    marked = lambda parsed: F.array_sort(F.array_distinct(F.concat(
        _types_at_any_depth(F.filter(parsed, lambda b: b["v"].isNotNull()), html),
        F.when(F.exists(parsed, lambda b: b["v"].isNull()), F.array(F.lit("<unparsed-ld>"))).otherwise(F.array().cast("array<string>")),
    )))
    return let(F.transform(jsonld_blocks(html), block), marked)


def explode_objects(pages: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per JSON-LD object: ``page_id, seq, obj``."""
    objects = pages.select("page_id", jsonld_objects(F.col("html"), depth).alias("objects"))
    # The inner form would also ask for the size of the list below the projection that makes it, and so make it twice.
    return objects.select("page_id", F.posexplode_outer("objects").alias("seq", "obj")).where(F.col("seq").isNotNull())
