"""The operators against brute force on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pageloom.llm import bpe, importance, langid, packing, pivots, queries, search, simhash, substrings, toxicity, urls
from tests.compare import differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n", "one two", "A b c d e f g h i j k l m n o p", "x A b c d e f g h i j k l m n o p y", "A b c d e f g h i j k l m n o p",
         "naïve ՙtext ✓ <|endoftext|> it's  1²3\u00a0end\n\n ", "word " * 3000, "one two"]
DDL = "doc_id long, text string, lang string, h string, kept string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "clash", "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "A b c d e f g h i j k l m n", "fr", None, None, None)], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def plain_fp(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_and_components(docs, empty):
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fp(text)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.classes(docs).collect())
    assert len(got) == docs.count()
    by = {d: c for null, d, c in got if not null}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[9] == 3 and by[4] == by[6] == 4
    assert simhash.classes(empty).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def plain_kept(rows, width=4, budget=4):
    """The rows that stay: the smallest (id, hash) of each class of fingerprints linked at ``budget`` bits or fewer."""
    fps = np.array([plain_fp(t) for _, t, _ in rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label[None, :], len(rows)).min(axis=1)
    least = {}
    for (d, _, h), c in zip(rows, label.tolist()):
        least[c] = min(least.get(c, (d, h)), (d, h))
    return sorted((d, t or "") for (d, t, h), c in zip(rows, label.tolist()) if least[c] == (d, h))


def test_near_duplicate_stage_against_brute_force(spark, docs, empty):
    rng, rows = np.random.default_rng(4), [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 900, 120)]
        for _ in range(9):
            w = list(words)
            for at in rng.integers(0, 120, int(rng.integers(0, 3))):
                w[at] = f"x{rng.integers(0, 900)}"
            rows.append((100 + len(rows), " ".join(w)))
    rows += [(100, "another text under an id that is taken"), (50, rows[-1][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [(r.doc_id, r.text, r.h) for r in table.withColumn("h", F.xxhash64("doc_id", "text")).collect()]
    kept = sorted((r.doc_id, r.text or "") for r in simhash.keep_first(table).collect())
    assert kept == plain_kept(hashed) and len(kept) < len(rows) - 30
    assert simhash.keep_first(docs).where("doc_id is null").count() == 1 and simhash.keep_first(empty).count() == 0


def test_trie_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (5, 2))], dtype=np.uint64)
    fps, found = np.unique(np.concatenate([base, near])), set()
    simhash.trie_links(fps, 4, lambda i, js: found.update((i, int(j)) for j in js), leaf=2)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert found == want


def test_trie_labels_reach_what_links_reach():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(i) for i in set(ones)) for b in base for ones in rng.integers(0, 64, (12, 3))], dtype=np.uint64))
    want, before = np.arange(len(fps)), None
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while before is None or (want != before).any():
        before, want = want, np.where(near, want[None, :], len(fps)).min(axis=1)
    for leaf in (2, 16, 512):
        assert simhash.trie_labels(fps, 4, leaf).tolist() == want.tolist()


def test_field_marginals_against_all_taggings():
    from itertools import product

    field = toxicity.Field(["a", "b", "c"])
    rng = np.random.default_rng(3)
    field.at, field.before, field.after, field.move = rng.normal(size=4), rng.normal(size=4), rng.normal(size=4), rng.normal(size=(2, 2))
    ids, sizes = field.padded([[1, 2, 3, 0], [3, 1]])
    p, moves = field.marginals(ids, sizes, pairs=True)
    odds, want = field.odds(ids), np.zeros((2, 2))
    for row, size in enumerate(sizes):
        ways = [(y, np.exp(sum(odds[row, t] * y[t] for t in range(size)) + sum(field.move[a, b] for a, b in zip(y, y[1:])))) for y in product((0, 1), repeat=int(size))]
        total = sum(w for _, w in ways)
        for y, w in ways:
            for a, b in zip(y, y[1:]):
                want[a, b] += w / total
        assert np.allclose(p[row, :size], [sum(w for y, w in ways if y[t]) / total for t in range(size)])
    assert np.allclose(moves, want)


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encoded(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(empty).count() == 0
    v = bpe.vocabulary(bpe.default_path())
    for word in (b"unseenword" * 40, b"a" * 300, "é✓".encode() * 90):
        assert v.merge(word) == v._merge_long(word)


def test_transducer_shares_suffixes_and_finds_words():
    words = {w: [i, i + 1] for i, w in enumerate([b"walking", b"talking", b"walk", b"talk", b"king"])}
    lex = bpe.Lexicon.mapped(bpe.Lexicon.compile(words).pack())
    asked = [*words, b"wal", b"walkings", b"", b"zzz"]
    assert [lex.ids_of(n).tolist() if n >= 0 else None for n in lex.numbers(asked)] == [*words.values(), None, None, None, None]
    assert len(lex.final) < 1 + sum(map(len, words))


def test_packing_covers_every_id_once(docs, empty):
    rows = packing.pieces(docs.repartition(3)).collect()
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        at += r.length
    assert at == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pieces(empty).count() == 0
    whole = packing.sequences(packing.pieces(docs)).collect()
    assert all(len(r.ids) == 4096 for r in whole)


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rows = [*enumerate(TEXTS), (20, " " * 2_000_000), (21, "a" * 300_000), (22, ".,;:!?-" * 40_000), (23, "\n \t" * 30_000 + "end" + " " * 60_000),
            (24, "ﬁn " + "✓" * 50_000), (25, "a\u00a0" * 70_000 + " " * 49_999), (None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {}
    for r in packing.pieces(table).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d for d, _ in rows}
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = sorted(got[d], key=lambda r: r.start)
        assert [r.start for r in cut] == np.cumsum([0, *(r.length for r in cut)])[:-1].tolist() and b"".join(r.ids for r in cut) == ids.tobytes()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in cut)


def plain_substrings(rows):
    """``doc_id, text, n_words, n_removed, kept`` of every row, windows compared word by word."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12 if d is not None else 0):
            cut = tuple(w[i : i + 13])
            first[cut] = min(first.get(cut, d), d)
    out = []
    for (d, w), (_, t) in zip(words, rows):
        gone = {k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        out.append((d, t, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def substring_rows(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in substrings.parsed(table, **options).drop("spans").select("doc_id", "text", "n_words", "n_removed", "kept").collect()), key=str)


def test_substrings_against_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.parsed(docs.drop("kept")).select("doc_id", "text", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain_substrings(rows)
    assert substrings.parsed(empty.drop("kept")).count() == 0
    same = substrings.cleaned(docs)
    assert same.columns == docs.columns and same.where("n > 0 and kept <> 'clash'").count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 1, "blocks": 1}])
def test_substrings_of_passages_in_many_contexts(spark, options):
    rng = np.random.default_rng(8)
    lines = [[f"p{k}w{x}" for x in rng.integers(0, 9, int(rng.integers(13, 30)))] for k in range(6)]
    rows = []
    for d in rng.permutation(150).tolist():
        words = []
        for _ in range(int(rng.integers(1, 5))):
            words += [f"n{x}" for x in rng.integers(0, 40, int(rng.integers(0, 20)))]
            line = lines[int(rng.integers(0, 6))]
            words += line[int(rng.integers(0, 3)) : len(line) - int(rng.integers(0, 3))]
        rows.append((d, " ".join(words)))
    rows += [(d, rows[0][1]) for d in (3, 200, 201)] + [(7, "x " * 50), (9, "x " * 20), (201, rows[1][1]), (None, rows[2][1])]
    assert substring_rows(spark, rows, **options) == plain_substrings(rows)


def test_words_that_collide_modulo_a_power_of_two_are_told_apart(spark):
    even = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    odd = even.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join([*rest[:7], even, *rest[7:]])), (2, " ".join([*rest[:7], odd, *rest[7:]]))]
    assert [r[3] for r in substring_rows(spark, rows)] == [0, 0]


def test_a_reference_with_other_words_removes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "matches", lambda docs, *_: docs.select(
        "doc_id", "h", F.lit(0).alias("pos"), F.lit(2).alias("n"), F.lit(1).cast("bigint").alias("ref_doc"), F.lit(1).alias("ref_pos")).where("doc_id > 1"))
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "first " + text), (2, text), (3, text.replace("w5", "v5"))]
    assert [r[3] for r in substring_rows(spark, rows)] == [0, 14, 0]


def test_a_passage_that_a_document_repeats_is_looked_up_once(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, "a " + passage), (2, " ".join(f"{passage} own{i}" for i in range(30)))]
    sizes, whole = [], substrings.spread_join
    monkeypatch.setattr(substrings, "spread_join", lambda left, *args, **more: sizes.append(left.count()) or whole(left, *args, **more))
    assert substring_rows(spark, rows) == plain_substrings(rows)
    assert sizes == [1]


def test_substrings_of_a_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert substring_rows(spark, rows) == plain_substrings(rows)


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + 0.02 * rng.normal(size=(10, 16)), base[:5]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (91, [0.0] * 16), (92, [float("nan")] * 16), (93, [])]
    got = {r.vec_id: r for r in pivots.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=8).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert {i: int(n) - 1 for i, n in enumerate((u @ u.T >= 0.95).sum(1))} == {i: got[i].n_links for i in range(len(v))}
    assert all(got[i].kept and got[i].n_links == 0 for i in (90, 91, 92, 93))


def test_pivots_find_every_link_of_a_dense_third(spark):
    rng = np.random.default_rng(5)
    base, noise = rng.normal(size=64), rng.normal(size=(500, 64))
    group = np.sqrt(0.97) * base / np.linalg.norm(base) + np.sqrt(0.03) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    v = np.concatenate([group, rng.normal(size=(1000, 64))])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.linked(rows, block=200).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert got == {i: (int(near[i].sum()) - 1, int(near[i].argmax())) for i in range(len(v))}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_its_oracle(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == []


def test_search_and_urls_take_odd_rows(spark):
    v = search.usable(spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("inf")]), (4, [-1.0]), (4, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert [tuple(r) for r in search.top(v.where("vec_id = 1"), v).orderBy("rank").collect()] == [(1, 1, 4, 1 << 20), (1, 2, 4, -(1 << 20))]
    pages = spark.createDataFrame([(1, None), (2, "nothing"), (3, "HTTP://A.Net/es/x?y"), (4, "x://net/es/"), (5, "x://com")], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, rules).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/es/x", "net/es/", "block"),
                   4: ("net", "/es/", "net/es/", "block"), 5: ("com", "", None, "allow")}


def test_language_and_toxicity_held_out(spark, docs, empty):
    model = langid.fitted(docs)
    out = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    assert out[0].lang_pred == "und" and out[1].score == 0.0
    field, words = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not words and {r.score for r in toxicity.scored(docs, field, False).collect()} == {0.0}
    got = langid.op7_langid(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_importance_keeps_good_documents(spark, docs):
    out = importance.op1_importance(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good, bad = (out.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert importance.keep_good(docs, none).count() == docs.count()


def test_pipeline_packs_kept_documents(spark):
    out = queries.QUERIES["pipeline"](spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_search_by_block_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in rng.integers(0, 260, 300)] + [(7, [0.5] * 5)] * 40 + [(9, [0.25]), (11, [])]
    v = search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0")
    got: dict = {}
    for r in search.top(asked, v, k=6, rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    scaled = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows]
    want = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        weights = min(e for i, e in scaled if i == q)
        scores = [(i, sum(a * b for a, b in zip(weights, e))) for i, e in scaled if i != q]
        want[q] = sorted(scores, key=lambda x: (-x[1], x[0]))[:6]
    assert got == want


def test_search_beyond_64_bits_and_without_rows(spark):
    big = spark.createDataFrame([(0, [2.0**21, 2.0**30]), (1, [2.0**21, 1.0]), (2, [2.0**40, 2.0**40]), (3, [-(2.0**40)] * 2), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    v = search.usable(big, "vec_id", "embedding")
    got = [(r.vec_id, r.score) for r in search.top(v.where("vec_id = 0"), v).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (4, 2**63 - 1), (1, 2**62 + 2**50), (3, 1 - 2**63)]
    none = v.where("false")
    assert search.top(none, v).count() == search.top(v, none).count() == 0


def test_parts_of_a_batch_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    from pageloom.llm import common

    monkeypatch.setattr(common, "BYTES", 1_000)
    batch = pa.RecordBatch.from_pydict({"n": list(range(200)), "text": ["x" * (i % 7 * 90) for i in range(199)] + ["y" * 5_000]})
    parts = list(common.sliced(batch, 50))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))
    assert all(p.num_rows == 1 or (p.num_rows <= 50 and p.nbytes <= 1_000) for p in parts) and list(common.sliced(batch, None)) == [batch]


def test_batches_are_bounded_by_bytes(spark):
    from pageloom.llm import common

    def work(batch):
        yield {"n": [batch.num_rows], "size": [batch.nbytes]}

    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        texts = spark.range(0, 6_000, 1, 1).select(F.repeat(F.lit("abcdefgh"), F.lit(300)).alias("text"))
        got = common.arrow_map(texts, work, "n bigint, size bigint").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in got) == 6_000 and max(r["size"] for r in got) < 1.5 * common.BYTES


def test_rounds_of_components_have_as_many_parts_as_their_edges_ask_for(spark, monkeypatch):
    from pageloom.llm import common

    parts, cut, cores = [], common.cut_lineage, spark.sparkContext.defaultParallelism

    def counted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "cut_lineage", counted)
    ways = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in ways}
    pairs = [(i, i + 1) for i in range(0, 40) if i % 8 != 7] + [(100 + i, 100) for i in range(20)] + [(3, 3), (1, 0)]
    forest = common.Forest(121)
    for a, b in pairs:
        forest.union(a, b)
    want = {n: forest.find(n) for pair in pairs for n in pair}
    try:
        for k, v in ways.items():
            spark.conf.set(k, v)
        for edges in (50_000, 1):
            parts.clear()
            monkeypatch.setattr(common, "EDGES", edges)
            got = common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
            assert sorted((r.node, r.root) for r in got) == sorted(want.items())
            assert len(parts) > 2 and set(parts[1:]) == {cores if edges > 1 else 24}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blocks_are_dealt_without_moving_rows_by_key(spark):
    from pageloom.llm.common import paired_blocks

    rows = spark.range(0, 3_000, 1, 3).select((F.col("id") % 20 * (F.col("id") % 3)).alias("key"), F.col("id").alias("row"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        dealt = paired_blocks(rows, "key", "row", 100)
        assert "SortMergeJoin" not in dealt._jdf.queryExecution().executedPlan().toString()
        items = {}
        for r in dealt.collect():
            items.setdefault(r.item, set()).add((r.key, r.row))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    by = {}
    for r in rows.collect():
        by.setdefault(r.key, []).append(r.row)
    met = {(k, a, b) for found in items.values() for k, a in found for j, b in found if j == k}
    assert met == {(k, a, b) for k, own in by.items() for a in own for b in own}
    assert all(len({k for k, _ in found}) == 1 for found in items.values())


def test_samples_stay_small_where_keys_repeat(spark):
    from pageloom.llm.common import bounded_sample

    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    taken = bounded_sample(rows, 300, "k")
    assert 100 < taken.count() < 400 and taken.where("k = -1").count() <= 1
    assert bounded_sample(rows, 3_000, "k").count() == 3_000


def test_language_of_long_unseen_words(spark):
    docs = spark.createDataFrame([(i, w * 3, lang) for i in range(4) for lang, w in (("aa", "abcab" * 20 + " "), ("bb", "xyzxy" * 20 + " "))], "doc_id long, text string, lang string")
    model = langid.fitted(docs)
    assert [model.predict(t)[0] for t in ("abcab" * 500, "xyzxy" * 500, "q" * 9 + "xyz" * 80)] == ["aa", "bb", "bb"]
    assert model.word("abcab" * 500).max() == 0.0


def test_training_sentences_stay_whole_and_agree(spark):
    rows = spark.createDataFrame([(bytes([i]), [1] * (i + 1), [0] * (i + 1)) for i in range(20)], "line binary, ids array<int>, tags array<int>")
    kept = sorted(len(r.ids) for r in toxicity.whole_sentences(rows, 10, 30).collect())
    assert kept == [1, 2, 3, 4, 5, 6, 7]
    one, other = toxicity.Field(["a", "b"]), toxicity.Field(["a", "b"])
    rng = np.random.default_rng(6)
    lines = [rng.integers(0, 3, int(n)).tolist() for n in rng.integers(1, 60, 40)]
    tags = [[int(x == 2) for x in line] for line in lines]
    one.train(lines, tags, 20)
    toxicity.CELLS, before = 90, toxicity.CELLS
    other.train(lines, tags, 20)
    toxicity.CELLS = before
    assert np.allclose(one.at, other.at) and np.allclose(one.move, other.move)


def test_words_of_the_lexicon_are_counted_over_all_documents(spark):
    from pageloom.llm.bpe import default_path, frequent_words

    docs = spark.range(25_000).selectExpr("id as doc_id", "concat('word', id) as text")
    assert len(frequent_words(docs, default_path(), size=100_000)) > 25_000
