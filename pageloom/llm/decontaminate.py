"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned along the documents' words.

A-Z are lower-cased; words are runs of ASCII letters and digits and of all characters beyond ASCII. A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one window. The distinct windows are hashed into a
set that is broadcast while its counted size is within ``bound``; a larger one is joined by its hash, hot hashes spread.
The windows of a document are looked up by the hash of a half, and a hit counts once its words equal the
window's words, so colliding hashes add nothing. Everything runs as DataFrame functions: no Python touches the rows.

Null and empty texts have no words: such documents are clean and such items have no window. Repeated rows, and several rows of
one id, give one result row each; a null doc_id is a row like any other. Null item_ids stand in no list of items, but
their windows still hit. Repeated items are one item. Very long texts are read whole; their words are one array.
Empty documents give an empty result; an empty benchmark leaves all clean. Extra columns, whatever their names, pass through
``without_documents`` and ``without_spans``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.lets import let
from pageloom.llm.common import table
from pageloom.operators.skew import spread_join
from pageloom.session import cut_lineage

WIDTH, BOUND = 10, 100_000
#: ASCII characters that separate words.
MARKS = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)
KEY = ["_a", "_b"]


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + MARKS, string.ascii_lowercase + " " * len(MARKS))
    return F.array_remove(F.split(plain, " ", -1), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``k, size, window, items``: each distinct window of the items, its hash, and the ids of the items that hold it."""
    listed = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    cut = listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("window").alias("k"), F.size("window").alias("size"), "window", "items")


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``_a`` and ``_b``: 128 bits that name a row by its id and text, nulls included."""
    name = ["doc_id", "text"]
    return docs.withColumn("_a", F.xxhash64(F.lit(0), *name)).withColumn("_b", F.xxhash64(F.lit(1), F.col("text").isNull(), *name))


def _parts(size: Column | int) -> tuple[Column, Column]:
    """Words to a part of a window of ``size`` words, and how many parts it has: one of them starts at a multiple of that number."""
    part = F.ceil(F.lit(size) / 2).cast("int")
    return part, F.lit(size) - part + 1


def occurrences(docs: DataFrame, listed: DataFrame, bound: int = BOUND) -> DataFrame:
    """``_a, _b, pos, size, items`` of every place in ``docs`` (keyed) where a listed window stands.

    Documents are looked up at every ``step``-th word only, by the hash of half a window: each occurrence has exactly
    one such place inside, and the windows that hold this half there are compared word by word.
    """
    listed = cut_lineage(listed)
    sizes = sorted(r.size for r in listed.select("size").distinct().collect())
    if not sizes:
        return docs.select(*KEY, F.lit(0).alias("pos"), F.lit(0).alias("size"), F.lit(None).cast(listed.schema["items"].dataType).alias("items")).where("false")

    def hashes(w: Column, size: Column | int, step: Column | int) -> Column:
        part, parts = _parts(size)
        count = F.floor((F.size(w) - part) / step).cast("int")
        return F.when(F.size(w) >= part, F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(F.slice(w, i * step + 1, part), F.lit(size)))).otherwise(
            F.array().cast("array<bigint>"))

    size = F.col("size")
    parts = listed.select("k", "size", F.posexplode(hashes(F.slice("window", F.lit(1), size), size, F.lit(1))).alias("inside", "part"))
    parts = parts.select("part", F.col("k").alias("wanted"), F.col("size").alias("n"), "inside")
    text = docs.select(*KEY, let(words(F.col("text")), lambda w: F.struct(w.alias("w"), F.array(*[
        F.struct(F.lit(n).alias("n"), hashes(w, F.lit(n), _parts(n)[1]).alias("part")) for n in sizes]).alias("p"))).alias("t"))
    dealt = text.select(*KEY, F.col("t.w").alias("w"), F.explode("t.p").alias("p")).select(
        *KEY, "w", F.col("p.n").alias("n"), F.posexplode("p.part").alias("at", "part"))
    whole = listed.select(F.col("k").alias("wanted"), "window", "items")
    if listed.count() <= bound:
        met = dealt.join(F.broadcast(parts), ["part", "n"]).join(F.broadcast(whole), "wanted")
    else:
        near = spread_join(dealt.select(*KEY, "n", "at", "part"), parts, ["part", "n"], ["_a", "at"], "inner")
        met = spread_join(near, whole, ["wanted"], ["_a", "at"], "inner").join(text.select(*KEY, F.col("t.w").alias("w")).dropDuplicates(KEY), KEY)
    pos = (F.col("at") * _parts(F.col("n"))[1] - F.col("inside")).cast("int")
    placed = met.select(*KEY, "w", "window", "items", F.col("n").alias("size"), pos.alias("pos"))
    return placed.where((F.col("pos") >= 0) & (F.slice("w", F.greatest("pos", F.lit(0)) + 1, size) == F.col("window"))).select(*KEY, "pos", "size", "items")


def merged(spans: Column) -> Column:
    """Disjoint ``start, end`` of the union of sorted (pos, size) spans, last first."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last, end = F.get(acc, F.lit(0)), s["pos"] + s["size"]
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
        return F.when((F.size(acc) > 0) & (s["pos"] <= last["end"]), F.concat(joined, F.slice(acc, 2, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(
            F.concat(F.array(F.struct(s["pos"].alias("start"), end.alias("end"))), acc))

    return F.aggregate(spans, start, step)


def hit_words(spans: Column) -> Column:
    """How many words sorted (pos, size) spans cover."""
    begin = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["size"]
        fresh = F.greatest(end - F.greatest(acc["reach"], s["pos"]), F.lit(0)).cast("bigint")
        return F.struct(F.greatest(acc["reach"], end).alias("reach"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, begin, step, lambda acc: acc["n"])


def marked(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """``row`` (the columns of ``docs``), ``spans`` (sorted pos, size) and ``items`` of every row."""
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))).drop("doc_id", "text")
    found = occurrences(keyed(docs.select("doc_id", "text")).select(*KEY, "text"), windows(benchmark, width), bound)
    met = found.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("pos", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return rows.join(cut_lineage(met), KEY, "left").drop(*KEY)


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items`` (ids as sorted strings), ``contaminated`` of every row."""
    # Only the words are counted here: the text itself does not travel to the join.
    narrow = keyed(docs.select("doc_id", "text")).select("doc_id", *KEY, F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    found = occurrences(keyed(docs.select("doc_id", "text")).select(*KEY, "text"), windows(benchmark, width), bound)
    met = cut_lineage(found.groupBy(*KEY).agg(
        hit_words(F.array_sort(F.collect_set(F.struct("pos", "size")))).alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    joined = narrow.join(met, KEY, "left")
    items = F.array_sort(F.transform(F.coalesce("items", F.array().cast(met.schema["items"].dataType)), lambda i: i.cast("string")))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        items.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, width: int = WIDTH) -> DataFrame:
    """``docs`` less those of which more than ``share`` of the words stand in test windows."""
    out = marked(docs, benchmark, width)
    hit = F.coalesce(hit_words(F.col("spans")), F.lit(0))
    return out.where(hit <= F.size(words(F.col("row.text"))) * F.lit(share)).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the words of every hit span cut from ``text``, each with the separators after it; clean texts unchanged."""
    word, other = "[^%s]", "[%s]"
    word, other = (x % "".join(f"\\x{ord(c):02x}" for c in MARKS) for x in (word, other))
    out, text = marked(docs, benchmark, width), F.col("row.text")
    head = F.regexp_extract(text, f"^{other}*+", 0)
    parts = F.regexp_extract_all(text, F.lit(f"{word}++{other}*+"), F.lit(0))
    gone = F.flatten(F.transform(merged(F.col("spans")), lambda s: F.sequence(s["start"], s["end"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(words(text)) - 1), gone)
    cut = let(parts, lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), ""))
    whole = F.when(F.col("spans").isNull(), text).otherwise(F.concat(head, cut))
    return out.select(*[whole.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM t),
p AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT p.r, p.i, p.n, t.item_id FROM p JOIN t ON p.s = t.s AND p.n = t.n),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
