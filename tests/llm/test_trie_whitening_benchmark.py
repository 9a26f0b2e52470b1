"""Prefix trie, whitening and benchmark decontamination against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pageloom.llm import decontaminate, prefixes, whitening

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


# ------------------------------------------------------------------ prefix trie
def plain_trie(rows, spliced=True):
    """Nodes of the trie by their whole sequences of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, prefixes.digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if spliced else 0
        whole[c] = turns.get(c - c % 100, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
        ends[tuple(whole[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        out.append((
            m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), sum(not children[x] for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng, rows = random.Random(1), []
    for c in [*range(0, 40), 100, 103, 104, 105, 207, 208]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc ✓", "", None])))
    rows += [(7, None, "system", "first"), (7, None, "system", "first"), (8, 2, "user", "tie"), (8, 2, "user", "other"), (None, 1, "user", "nobody")]
    rows += [(300 + c, t, "user", f"turn {t // 2}") for c in range(3) for t in range(40 + c)]
    return rows


@pytest.mark.parametrize("limit,held", [(prefixes.LIMIT, prefixes.HELD), (25, 2)])
def test_trie_against_brute_force(spark, limit, held):
    rows = conversations()
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, f string")
    for spliced in (True, False):
        got = prefixes.trie(table, spliced, limit, held).drop("node", "parent").collect()
        assert sorted(map(tuple, got), key=str) == plain_trie(rows, spliced)
    assert prefixes.trie(table.where("conv_id is null")).count() == 0 and prefixes.trie(table.where("false")).count() == 0


def test_a_conversation_may_span_partitions(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(300)] + [(2, t, "user", str(t % 3)) for t in range(5)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = prefixes.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv, n in ((1, 300), (2, 5)):
        mine = sorted((r.d, r.f) for r in got if r.conv_id == conv)
        x = 1
        for (d, f), t in zip(mine, range(n)):
            x = (x * prefixes.BASE + int.from_bytes(prefixes.digest("user", str(t % 3)), "big")) % prefixes.PRIME
            assert (d, int.from_bytes(f, "big")) == (t + 1, x)
        assert len(mine) == n


def test_messages_come_back_in_order_when_they_spill():
    rng = random.Random(2)
    queue, sent = prefixes.Messages(held=4), []
    for _ in range(500):
        entry = (-rng.randrange(1, 6), bytes([rng.randrange(4)]) * 16, rng.randrange(9), rng.randrange(9))
        sent.append(entry)
        queue.push(entry)
    got = [e for key in sorted({e[:2] for e in sent}) for e in queue.take(*key)]
    assert got == sorted(sent)


# -------------------------------------------------------------------- whitening
def plain_whitening(rows, kept=4):
    x = {i: np.floor(256 * np.array(v, dtype=float)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    return x, fit, values[::-1][:kept], vectors[:, ::-1][:, :kept]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 7)) * [3, 2, 1, 0.5, 0.2, 0.1, 0.1])]
    rows += [(90, rows[0][1]), (91, rows[0][1])]
    odd = [(70, None), (71, []), (72, [float("nan")] * 7), (73, [1.0] * 6 + [None]), (74, [1.0, 2.0]), (75, [float("inf")] * 7)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], "vec_id long, embedding array<double>, x string")
    got = whitening.whitened(table).collect()
    x, fit, values, vectors = plain_whitening(rows)
    n, sums = len(fit), fit.sum(0)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k) for i, _ in rows for k in (1, 2, 3, 4))
    for r in got:
        k = r.component - 1
        want = (x[r.vec_id] - fit.mean(0)) @ vectors[:, k] / np.sqrt(values[k])
        sign = np.sign(next(s.whitened for s in got if s.vec_id == 0 and s.component == r.component) * ((x[0] - fit.mean(0)) @ vectors[:, k]))
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum()) and abs(r.whitened - sign * want) < 1e-9
        assert abs(r.explained - values[k] / np.trace(np.cov(fit.T, bias=True))) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_repeated_roots_and_few_rows(spark):
    square = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    got = whitening.whitened(spark.createDataFrame(square, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-9 for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(one).count() == 0 and whitening.whitened(one.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [3.0, 2e12])], "vec_id long, embedding array<double>")
    got = whitening.whitened(huge).collect()
    assert len(got) == 6 and all(r.deviation is None and r.identity_error < 1e-6 for r in got)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (9, 6)).astype(object)
    a = (x.T @ x).tolist()
    poly = whitening.characteristic(spark, a)
    for point in (0, 1, -3, 50):  # det(point - a) by exact fractions
        from fractions import Fraction

        m, det = [[Fraction(point * (i == j) - v) for j, v in enumerate(line)] for i, line in enumerate(a)], Fraction(1)
        for k in range(6):
            at = next(i for i in range(k, 6) if m[i][k])
            if at != k:
                m[k], m[at], det = m[at], m[k], -det
            det *= m[k][k]
            for i in range(k + 1, 6):
                f = m[i][k] / m[k][k]
                m[i] = [u - f * v for u, v in zip(m[i], m[k])]
        assert sum(c * point**i for i, c in enumerate(poly)) == det
    roots = whitening.largest_roots(poly, 6, sum(a[i][i] for i in range(6)))
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(np.array(a, dtype=float))[::-1], rtol=1e-9)


# ------------------------------------------------------- benchmark decontamination
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, " ,;. "), (5, "SHORT-item!"),
         (6, "a a a a a a a a a a a"), (7, "straße ÉTÉ x"), (None, "nobody owns these words here"), (10, "one two three four five six seven eight nine ten")]
DOCS = [(1, "ONE two, three four five six seven eight nine ten eleven twelve thirteen"), (2, "a short  item and a short\titem."), (3, None), (4, ""),
        (5, "nothing to see"), (6, "a " * 30), (7, "Straße ÉTÉ X; straße été x"), (8, "nobody owns these words here"), (1, "short item"),
        (None, "short item"), (None, None), (5, "nothing to see"), (9, "x one two three four five six seven eight nine"), (11, "word " * 20_000 + "short item"),
        (2, "a short  item and a short\titem.")]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_hits(text, items):
    words, hit, met = WORD.findall(low(text)), set(), set()
    for item, other in items:
        w = WORD.findall(low(other))
        n = min(len(w), 10)
        for cut in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == cut:
                    hit.update(range(i, i + n))
                    met.add(item)
    return len(words), len(hit), sorted(str(m) for m in met if m is not None), bool(hit)


@pytest.mark.parametrize("bound", [decontaminate.BOUND, 0])
def test_decontamination_against_brute_force(spark, bound):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in DOCS], "doc_id long, text string, k string, _a int")
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, w string")
    got = decontaminate.judged(docs, items, bound=bound).collect()
    want = [(d, n, hit, len(ids), ids, bad) for d, t in DOCS for n, hit, ids, bad in [plain_hits(t, ITEMS)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = decontaminate.judged(docs, items.where("false"), bound=bound).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated or r.n_hit or r.items for r in none)
    assert decontaminate.judged(docs.where("false"), items, bound=bound).count() == 0


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in DOCS], "doc_id long, text string, k string, _a int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(d), t or "") for d, t in DOCS if not plain_hits(t, ITEMS)[3])
    cut = decontaminate.without_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert {(1, "thirteen"), (2, "a and a "), (3, None), (4, ""), (5, "nothing to see"), (9, "x one two three four five six seven eight nine")} <= texts
    assert decontaminate.judged(cut, items).where("contaminated").count() == 0
