"""Substring dedup by relative Lempel-Ziv parsing against an index of reference passages.

The reference of a passage is its first place: smallest id, then position. The index is sampled: every window of ``WIDTH`` words
is represented by the least hash of its ``GRAM``-word parts, so equal windows have equal representatives, and
neighbouring windows of one representative form a passage. A document is factored in these steps.

1. Representatives that stand under one id only are left out, by a Bloom filter of those under two or more.
2. A passage whose whole text has a first place under a smaller id is matched whole.
3. Passages that are first of their kind, but share their representative with others, are cut into windows, and
   each window looks for its own first place. That settles passages at factor boundaries.
4. Matches of one reference that continue each other become one factor, and neighbouring factors overlap where
   passages meet, so no window across a boundary is missed. Both texts are read again: a factor whose words
   are the reference's words, by a 128-bit BLAKE2 digest of them, becomes a span that is removed.

Bloom filters have a bounded size: a fuller one passes more, never fewer. Keys are pairs of 64-bit hashes (representative and
passage); the words decide in the end. Keys with many rows, found in a sample by hash of the id, are salted.

Null and empty texts have no words. Rows without id neither lose words nor serve as reference. Rows of one id (repeated
rows too) are no references for each other. Among places of one id the first counts. An empty table gives an empty result; whole texts are
read, however long. Extra columns pass through, those named ``kept, n_words, n_removed`` or ``spans`` only through ``cleaned``.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pageloom.llm.common import arrow_map, in_batches, sliced, stored, table
from pageloom.llm.hashing import mixed, window_hashes
from pageloom.operators.skew import spread_join

WIDTH, GRAM, BLOCKS, OTHER, MIX = 13, 5, 1 << 19, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15
#: One of SAMPLE ids is looked at for keys with at least HOT rows in the sample; at most HOT_KEYS keys get SALTS parts. Texts to a step of a task.
SAMPLE, HOT, HOT_KEYS, SALTS, ROWS = 32, 200, 1_000, 64, 500


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Passages:
    """The passages of several texts at once.

    ``m, span, at, n``: representative, hash, first window and number of windows; ``text``: position of its text;
    ``windows``: hashes of all windows, of which passage i has those from ``begin[i]`` on.
    """

    def __init__(self, texts: list[str | None], width: int = WIDTH, gram: int = GRAM) -> None:
        words = [split(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        n = len(h) - width + 1
        owner = np.repeat(np.arange(len(words)), sizes)
        own = np.flatnonzero(owner[: max(n, 0)] == owner[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(own):
            none = np.zeros(0, np.int64)
            self.m = self.span = self.windows = none.view(np.uint64)
            self.at = self.n = self.text = self.begin = none
            return
        parts, self.windows = window_hashes(h, gram, OTHER), window_hashes(h, width)
        least, place = parts[:n].copy(), np.arange(n)
        for j in range(1, width - gram + 1):
            less = parts[j : j + n] < least
            np.copyto(least, parts[j : j + n], where=less)
            np.copyto(place, np.arange(j, j + n), where=less)
        # Windows of one text follow one another; those of two texts never share a place.
        new = np.flatnonzero(np.diff(place[own], prepend=-1))
        self.begin = own[new]
        self.n = np.diff(np.append(new, len(own)))
        self.m, self.text = least[self.begin], owner[self.begin]
        self.at = self.begin - (np.cumsum(sizes) - sizes)[self.text]
        # The first and the last window of a passage overlap, so together they hold all of its words.
        first, last = self.windows[self.begin], self.windows[self.begin + self.n - 1]
        self.span = mixed(first * np.uint64(MIX) + last) ^ self.n.astype(np.uint64)


def _probe(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each 64-bit value."""
    h, mask = mixed(x ^ np.uint64(OTHER)), np.zeros(len(x), dtype=np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), mask


def passes(bloom: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, mask = _probe(x, len(bloom))
    return bloom[at] & mask == mask


def filled(values: DataFrame, blocks: int = BLOCKS, named=None) -> np.ndarray:
    """Blocked Bloom filter of ``named(batch)`` (or of the first bigint column) of ``values``; never more than ``blocks`` blocks."""

    def fill(batch):
        at, mask = _probe(named(batch) if named else batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
        order = np.argsort(at, kind="stable")
        at, mask = at[order], mask[order]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        yield {"b": at[cut], "bits": (np.bitwise_or.reduceat(mask, cut) if len(cut) else mask).view(np.int64)}

    rows = arrow_map(values, fill, "b bigint, bits bigint").groupBy("b").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks, dtype=np.uint64)
    out[rows.column("b").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _owner(span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mixed(span + doc.view(np.uint64) * np.uint64(MIX))


def represented(docs: DataFrame, blocks: int) -> np.ndarray:
    """Bloom filter of the representatives that stand under two ids or more."""

    def work(batch):
        p = Passages(batch.column(1).to_pylist())
        yield {"m": p.m.view(np.int64), "doc_id": batch.column(0).to_numpy()[p.text]}

    seen = arrow_map(docs, work, "m bigint, doc_id bigint", ROWS).groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return filled(seen.where("a < b").select("m"), blocks)


def with_first(rows: DataFrame, key: list[str], hot: int, columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, h, pos, ...) that are not the first of their key, or are it: ``columns``, ``ref_doc, ref_pos, own`` (it is the first).

    One exchange: the first place is a window's minimum; salted keys take the minimum of their parts in a second step,
    whose broadcast holds at most ``HOT_KEYS`` rows.
    """
    seen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).groupBy(*key).count()
    often = seen.where(F.col("count") >= hot).orderBy(F.desc("count"), *key).limit(HOT_KEYS).select(*key, F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(stored(often)), key, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)))
    place = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy(*key, "salt"))
    mine = F.col("first") == F.struct("doc_id", "pos")
    found = dealt.withColumn("first", place).where(F.col("hot") | (F.col("first.doc_id") < F.col("doc_id")) | mine)
    keys = [F.when(F.col("hot") | mine, F.col(k)).alias(k) for k in key]
    found = stored(found.select(*[c for c in columns if c not in key], *keys, "hot", "first"))
    least = found.where("hot").groupBy(*key).agg(F.min("first").alias("least"))
    whole = found.join(F.broadcast(least), key, "left").withColumn("first", F.coalesce("least", "first"))
    return whole.select(*columns, F.col("first.doc_id").alias("ref_doc"), F.col("first.pos").alias("ref_pos"), mine.alias("own")).where("ref_doc < doc_id or own")


def matches(docs: DataFrame, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """``doc_id, h, pos, n, ref_doc, ref_pos``: runs of ``n`` windows that stand at the reference too; ``docs`` has doc_id, text, h."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(represented(docs.select("doc_id", "text"), blocks))

    def whole(batch):
        p = Passages(batch.column(1).to_pylist())
        hit = passes(shared.value, p.m)
        text = p.text[hit]
        yield {"m": p.m[hit].view(np.int64), "span": p.span[hit].view(np.int64), "doc_id": batch.column(0).to_numpy()[text],
               "h": batch.column(2).to_numpy()[text], "pos": p.at[hit].astype(np.int32), "n": p.n[hit].astype(np.int32)}

    rows = arrow_map(docs, whole, "m bigint, span bigint, doc_id bigint, h int, pos int, n int", ROWS)
    placed = with_first(stored(rows), ["m", "span"], hot, ["doc_id", "h", "pos", "n", "m", "span"])
    first = placed.where("own").select("m", "span", "doc_id")
    several = sc.broadcast(filled(first.groupBy("m").agg(F.min("span").alias("a"), F.max("span").alias("b")).where("a < b").select("m"), blocks))

    def owners(batch):
        m, span, doc = (batch.column(i).to_numpy() for i in range(3))
        hit = passes(several.value, m.view(np.uint64))
        return _owner(span[hit].view(np.uint64), doc[hit])

    cut = sc.broadcast(filled(first, blocks, owners))

    def windows(batch):
        p, ids = Passages(batch.column(1).to_pylist()), batch.column(0).to_numpy()
        hit = np.flatnonzero(passes(shared.value, p.m) & passes(several.value, p.m) & passes(cut.value, _owner(p.span, ids[p.text])))
        n = p.n[hit]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(p.text[hit], n)
        yield {"m": np.repeat(p.m[hit], n).view(np.int64), "w": p.windows[np.repeat(p.begin[hit], n) + step].view(np.int64), "doc_id": ids[text],
               "h": batch.column(2).to_numpy()[text], "pos": (np.repeat(p.at[hit], n) + step).astype(np.int32)}

    single = stored(arrow_map(docs, windows, "m bigint, w bigint, doc_id bigint, h int, pos int", ROWS))
    for used in (shared, several, cut):
        used.destroy()
    one = with_first(single, ["m", "w"], hot, ["doc_id", "h", "pos"]).where("not own")
    columns = ["doc_id", "h", "pos", "n", "ref_doc", "ref_pos"]
    return placed.where("not own").select(*columns).unionByName(one.withColumn("n", F.lit(1)).select(*columns))


def factors(places: list[tuple[int, int, int, int]], width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """Greedy factors ``start, length, reference id, reference position`` of sorted ``pos, n, reference id, reference position``."""
    out: list[list[int]] = []
    for pos, n, doc, at in places:
        last = out[-1] if out else None
        if last and last[2] == doc and pos - at == last[0] - last[3] and pos <= last[0] + last[1] - width + 1:
            last[1] = max(last[1], pos + n - 1 + width - last[0])
        else:
            out.append([pos, n - 1 + width, doc, at])
    return [tuple(x) for x in out]


def repeats(found: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int], list[int]]:
    """Starts of the factors that cite the same passage, by its length, reference id and reference position."""
    out: dict[tuple[int, int, int], list[int]] = {}
    for start, *cited in found:
        out.setdefault(tuple(cited), []).append(start)
    return out


def _named(batch: pa.RecordBatch, bloom: np.ndarray, doc: int, h: int | None = None) -> np.ndarray:
    """Which rows of a batch have their id (and hash) in the filter; not those without id."""
    ids = batch.column(doc)
    x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    if h is not None:
        x = x * np.uint64(MIX) + batch.column(h).to_numpy().astype(np.int64).view(np.uint64)
    return passes(bloom, mixed(x)) & ids.is_valid().to_numpy(zero_copy_only=False)


def spans(docs: DataFrame, blocks: int = BLOCKS, hot: int = HOT) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, h, claims`` (starts, length and the digest of the reference's words of each cited passage) and a filter of the rows named."""
    sc = docs.sparkSession.sparkContext
    flat = F.flatten(F.sort_array(F.collect_list(F.array(F.col("pos").cast("bigint"), F.col("n").cast("bigint"), "ref_doc", F.col("ref_pos").cast("bigint")))))
    listed = matches(docs, blocks, hot).groupBy("doc_id", "h").agg(flat.alias("places"))

    def parse(batch):
        # A passage that a document repeats is one row with its places: what is looked up is looked up once a document.
        found = [repeats(factors(list(zip(x[::4], x[1::4], x[2::4], x[3::4])))) for x in batch.column(2).to_pylist()]
        sizes = [len(x) for x in found]
        length, ref, at = (np.array([f[i] for x in found for f in x], dtype=np.int64) for i in range(3))
        yield {"doc_id": np.repeat(batch.column(0).to_numpy(), sizes), "h": np.repeat(batch.column(1).to_numpy(), sizes),
               "starts": [starts for x in found for starts in x.values()], "length": length.astype(np.int32), "ref_doc": ref, "ref_pos": at.astype(np.int32)}

    parsed_rows = stored(arrow_map(listed, parse, "doc_id bigint, h int, starts array<int>, length int, ref_doc bigint, ref_pos int"))

    def mixed_ids(batch):
        return mixed(batch.column(0).to_numpy().view(np.uint64))

    def mixed_rows(batch):
        return mixed(batch.column(0).to_numpy().view(np.uint64) * np.uint64(MIX) + batch.column(1).to_numpy().astype(np.int64).view(np.uint64))

    references = sc.broadcast(filled(parsed_rows.select("ref_doc").distinct(), blocks, mixed_ids))
    named = filled(parsed_rows.select("doc_id", "h").distinct(), blocks, mixed_rows)

    def referred(batch):
        kept = batch.filter(pa.array(_named(batch, references.value, 0)))
        yield {"ref_doc": kept.column(0), "ref_text": kept.column(1)}

    texts = arrow_map(docs.select("doc_id", "text"), referred, "ref_doc bigint, ref_text string", ROWS)
    # What is asked of a reference is asked once, in lists that its own text bounds.
    part = F.pmod("ref_pos", F.lit(8))
    asked = parsed_rows.select("ref_doc", "ref_pos", "length").distinct().groupBy("ref_doc", part).agg(F.collect_list(F.struct("ref_pos", "length")).alias("cuts"))

    def quoted(batch):
        out: list[list] = [[], [], [], []]
        for doc, t, cuts in zip(*(c.to_pylist() for c in batch.columns)):
            words = split(t)
            for cut in cuts:
                at, length = cut["ref_pos"], cut["length"]
                for column, value in zip(out, (doc, at, length, quote(words, at, length))):
                    column.append(value)
        yield dict(zip(("ref_doc", "ref_pos", "length", "digest"), out))

    quotes = arrow_map(asked.join(texts, "ref_doc").select("ref_doc", "ref_text", "cuts"), quoted, "ref_doc bigint, ref_pos int, length int, digest binary", 64)
    told = spread_join(parsed_rows, quotes, ["ref_doc", "ref_pos", "length"], ["doc_id", "h"], "inner", rows=5_000)
    return told.groupBy("doc_id", "h").agg(F.collect_list(F.struct("starts", "length", "digest")).alias("claims")), named


def quote(words: list[bytes], at: int, length: int) -> bytes:
    """Digest of ``length`` words; words hold no space, so joined ones tell them apart."""
    return hashlib.blake2b(b" ".join(words[at : at + length]), digest_size=16).digest()


def parsed(docs: DataFrame, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """``docs`` with ``kept`` (text), ``n_words, n_removed`` and ``spans`` (start, length of each factor, flat).

    Only rows that the filter names go to the join with their factors; the others are counted where they are read.
    """
    keyed = docs.withColumn("_id", F.col("doc_id").cast("bigint")).withColumn("_h", F.hash("text"))
    claims, named = spans(keyed.where("_id is not null and text is not null").select(F.col("_id").alias("doc_id"), "text", F.col("_h").alias("h")), blocks, hot)
    bloom = docs.sparkSession.sparkContext.broadcast(named)
    names, width = docs.columns, len(docs.columns)
    extra = [StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(LongType()))]
    schema, text_at = StructType([*docs.schema.fields, *extra]), names.index("text")

    def cut(batch: pa.RecordBatch, listed: list) -> pa.RecordBatch:
        kept, n_words, n_removed, found = [], [], [], []
        for t, claimed in zip(batch.column(text_at).to_pylist(), listed):
            words, good = split(t), []
            gone = np.zeros(len(words), dtype=bool)
            for start, length, digest in sorted((start, c["length"], c["digest"]) for c in claimed or () for start in c["starts"]):
                if digest == quote(words, start, length):
                    gone[start : start + length] = True
                    good += [start, length]
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if good else words).decode("utf-8", "replace"))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            found.append(good)
        arrays = [*(batch.column(i) for i in range(width)), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
                  pa.array(n_removed, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def whole(batches):
        for batch in (part for batch in batches for part in sliced(batch, ROWS)):
            rest = batch.filter(pa.array(~_named(batch, bloom.value, width, width + 1)))
            yield cut(rest, [None] * len(rest))

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(_named(batch, bloom.value, width, width + 1)))

    def claimed(batches):
        for batch in (part for batch in batches for part in sliced(batch, ROWS)):
            yield cut(batch, batch.column(width).to_pylist())

    rows = keyed.select(*names, "_id", "_h")
    met = in_batches(rows, asked, rows.schema).join(claims.withColumnsRenamed({"doc_id": "_id", "h": "_h", "claims": "_claims"}), ["_id", "_h"], "left")
    return in_batches(rows, whole, schema).unionByName(in_batches(met.select(*names, "_claims"), claimed, schema))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed words gone from ``text`` (untouched where nothing is removed)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    narrow = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_none"), *rest).alias("_rest"))
    out = parsed(narrow).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("_rest.n_chars")) if "n_chars" in rest else None
    return out.select(*(c if c not in rest else chars.alias(c) if c == "n_chars" else F.col(f"_rest.{c}").alias(c) for c in docs.columns))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    out = parsed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
