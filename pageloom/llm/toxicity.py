"""Toxicity by a linear-chain conditional random field over the words of each sentence.

Document labels become token labels first: a word of toxic training documents is labelled toxic if it stands there
in at least ``CONTEXTS`` different contexts (its two neighbours, so that copies count once) and clearly more often than
chance. The field (states clean and toxic; features: the word, its neighbours, a bias) is then trained on a bounded sample
of those sentences. Forward-backward marginals of every sentence give a document's score, its highest
marginal, and the offsets of the words above one half.

Null and empty texts score 0, as do all when no labelled row is toxic. Repeated rows are scored alike; of repeated or contradicting
labels the larger counts, and of the taggings of a repeated sentence the toxic one. Very long sentences are handled whole, in training too, unless
they alone pass the sample's bound of ``WORDS`` words. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm.common import arrow_map, bounded_sample, fold, stored, table, without
from pageloom.llm.hashing import mixed
from pageloom.session import cut_lineage

DOCS, SENTENCES, FEATURES, CONTEXTS, STEPS = 20_000, 20_000, 20_000, 3, 80
#: Words of all sampled sentences of a kind, and positions of a block in training.
WORDS, CELLS = 1_000_000, 200_000
WORD, LINE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence that has words."""
    for m in LINE.finditer(text or ""):
        found = WORD.findall(m.group())
        if found:
            yield m.start(), m.end(), " ".join(found).lower().split(" ")


class Field:
    """Weights of the chain: words (at, before, after the position), bias, transitions."""

    def __init__(self, features: list[str]) -> None:
        self.index = {w: i + 1 for i, w in enumerate(features)}
        n = len(features) + 1
        self.at, self.before, self.after, self.bias = np.zeros(n), np.zeros(n), np.zeros(n), np.array([-4.0])
        self.move = np.zeros((2, 2))

    def padded(self, lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ids = np.zeros((len(lines), sizes.max() + 2), dtype=np.int64)
        live = np.arange(sizes.max())[None, :] < sizes[:, None]
        ids[:, 1:-1][live] = np.fromiter(chain.from_iterable(lines), np.int64, int(sizes.sum()))
        return ids, sizes

    def odds(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids[:, 1:-1]] + self.before[ids[:, :-2]] + self.after[ids[:, 2:]] + self.bias[0]

    def marginals(self, ids: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) at each position and, where asked for, the expected transitions, by forward-backward in odds."""
        e, width = self.odds(ids), ids.shape[1] - 2
        live = np.arange(width)[:, None] < sizes[None, :]
        e = np.where(live, e.T, 0.0)
        (w00, w01), (w10, w11) = np.exp(self.move).tolist()
        forward, backward, odds = e.copy(), np.zeros_like(e), np.ones_like(e)
        for t in range(1, width):
            x = odds[t - 1] = np.exp(np.clip(forward[t - 1], -300, 300))
            forward[t] += np.log((w01 + w11 * x) / (w00 + w10 * x))
        for t in range(width - 2, -1, -1):
            x = np.exp(np.clip(backward[t + 1] + e[t + 1], -300, 300))
            backward[t] = np.where(live[t + 1], np.log((w10 + w11 * x) / (w00 + w01 * x)), 0.0)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        moves = np.zeros((2, 2))
        if pairs and width > 1:
            inner, x = live[1:], odds[:-1]
            both = (p[1:] * (w11 * x / (w01 + w11 * x)))[inner].sum()
            first, second = p[:-1][inner].sum(), p[1:][inner].sum()
            moves = np.array([[inner.sum() - first - second + both, second - both], [first - both, both]])
        return p.T, moves

    def train(self, lines: list[list[int]], labels: list[list[int]], steps: int = STEPS) -> None:
        """Gradient ascent of the penalised log likelihood with per-weight step sizes; sentences of like length form one block."""
        order, blocks, count, at = sorted(range(len(lines)), key=lambda i: len(lines[i])), [], np.zeros((2, 2)), 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * len(lines[order[at + size]]) <= CELLS:
                size += 1
            part = order[at : at + size]
            ids, sizes = self.padded([lines[i] for i in part])
            gold, live = self.padded([labels[i] for i in part])[0][:, 1:-1], np.arange(ids.shape[1] - 2)[None, :] < sizes[:, None]
            for a in (0, 1):
                for b in (0, 1):
                    count[a, b] += ((gold[:, :-1] == a) & (gold[:, 1:] == b) & live[:, 1:]).sum()
            blocks.append((ids, sizes, gold, live))
            at += size
        weights = [self.at, self.before, self.after, self.bias, self.move]
        sums = [np.full_like(w, 1e-6) for w in weights]
        for _ in range(steps):
            grads = [np.zeros_like(w) for w in weights]
            grads[4] += count
            for ids, sizes, gold, live in blocks:
                p, pairs = self.marginals(ids, sizes, pairs=True)
                gap = np.where(live, gold - p, 0.0)
                for g, k in zip(grads, (ids[:, 1:-1], ids[:, :-2], ids[:, 2:])):
                    g += np.bincount(k.ravel(), gap.ravel(), len(self.at))
                grads[3] += gap.sum()
                grads[4] -= pairs
            grads[0][0] = grads[1][0] = grads[2][0] = 0
            for w, g, s in zip(weights, grads, sums):
                g = g - 0.05 * w
                s += g * g
                w += 0.5 * g / np.sqrt(s)


def telling(t: int, n: int, share: float, words: int) -> bool:
    """Whether ``t`` toxic contexts of ``n`` are too many for chance, even among so many words."""
    rate = t / n
    if rate < 0.6 or not 0 < share < rate:
        return False
    excess = rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return bool(n * excess > np.log(100.0 * words))


def _contexts(batch):
    """Distinct (word, context, label) of a batch; a context is the hash of both neighbours."""
    vocabulary: dict[str, int] = {"": 0}
    flat, marks, texts, labels = [], [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for text, toxic in zip(texts, labels):
        before = len(flat)
        for _, _, words in sentences(text):
            flat.append(0)
            flat.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        marks.append((len(flat) - before, toxic))
    flat.append(0)
    ids = np.array(flat, dtype=np.int64)
    toxic = np.append(np.repeat([t for _, t in marks], [n for n, _ in marks]), 0).astype(np.int64)
    names = list(vocabulary)
    h = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
    at = np.flatnonzero(ids)
    context = mixed(h[ids[at - 1]] * ODD + h[ids[at + 1]])
    _, one = np.unique(mixed(context * ODD + h[ids[at]]) * np.uint64(2) + toxic[at].astype(np.uint64), return_index=True)
    yield {"word": pa.array(names).take(pa.array(ids[at][one])), "context": context[one].view(np.int64), "toxic": toxic[at][one].astype(np.int32)}


def fitted(docs: DataFrame, labels: DataFrame, sample: int = DOCS) -> tuple[Field, set[str]]:
    """Field and toxic words from labelled documents: a bounded sample of them and of their sentences."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(bounded_sample(marks, sample, "doc_id"), "doc_id").where("text is not null").select("text", "toxic")
    rows = rows.dropDuplicates(["text", "toxic"])
    counted = arrow_map(rows, _contexts, "word string, context bigint, toxic int").groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
    words = cut_lineage(counted.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= CONTEXTS))
    kept = words.orderBy(F.desc("n"), "word").limit(FEATURES).unionByName(
        words.where("t >= 0.6 * n").orderBy(F.desc("t"), "word").limit(FEATURES)).distinct().collect()
    total, hits = sum(r.n for r in kept), sum(r.t for r in kept)
    share = hits / total if total else 0.0
    toxic = {r.word for r in kept if r.t >= CONTEXTS and telling(r.t, r.n, share, len(kept))}
    field = Field(sorted({r.word for r in kept}))
    if not toxic:
        return field, toxic

    def chosen(batch):
        index, lines = field.index, {}
        for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for _, _, words in sentences(text):
                tags = [int(bool(mark) and w in toxic) for w in words]
                key = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in lines or lines[key][2] < any(tags):
                    lines[key] = ([index.get(w, 0) for w in words], tags, int(any(tags)))
        yield {"line": list(lines), "ids": [x[0] for x in lines.values()], "tags": [x[1] for x in lines.values()], "any": [x[2] for x in lines.values()]}

    found = arrow_map(rows, chosen, "line binary, ids array<int>, tags array<int>, any int").groupBy("line")
    picked = stored(found.agg(F.max(F.struct("any", "ids", "tags")).alias("s")).select("line", "s.*"))
    lines = [r for k in (1, 0) for r in whole_sentences(picked.where(F.col("any") == k)).collect()]
    field.train([r.ids for r in lines], [r.tags for r in lines])
    return field, toxic


def whole_sentences(picked: DataFrame, rows: int = SENTENCES // 2, words: int = WORDS) -> DataFrame:
    """``ids, tags`` of the first ``rows`` sentences by their digest; of them the shorter ones, up to ``words`` words together: never a part of one."""
    first = picked.select("line", F.size("ids").alias("n")).orderBy("line").limit(rows)
    running = F.sum("n").over(Window.orderBy("n", "line").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("sum", running).where(F.col("sum") <= words).select("line")
    return picked.join(F.broadcast(kept), "line", "left_semi").select("ids", "tags")


def scored(docs: DataFrame, field: Field, some: bool) -> DataFrame:
    """``doc_id, score, spans`` (starts of toxic words, in characters) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((field, some))

    def work(batch):
        field, some = shared.value
        texts = batch.column(1).to_pylist()
        best, spans = np.zeros(len(texts)), [[] for _ in texts]
        group: list = []

        def flush():
            group.sort(key=lambda x: len(x[1]))
            at = 0
            while at < len(group):
                size = max(1, min(4096, 200_000 // max(1, len(group[min(at + 4095, len(group) - 1)][1]))))
                part = group[at : at + size]
                ids, sizes = field.padded([x[1] for x in part])
                p, _ = field.marginals(ids, sizes)
                p = np.where(np.arange(p.shape[1])[None, :] < sizes[:, None], p, 0.0)
                most = p.max(axis=1)
                np.maximum.at(best, [x[0] for x in part], most)
                for k in np.flatnonzero(most >= 0.5).tolist():
                    doc, _, start, end = part[k]
                    starts = [m.start() for m in WORD.finditer(texts[doc], start, end)]
                    spans[doc] += [starts[i] for i in np.flatnonzero(p[k] >= 0.5).tolist()]
                at += size
            group.clear()

        held = 0
        get = field.index.get
        for i, text in enumerate(texts if some else []):
            for start, end, words in sentences(text):
                group.append((i, [get(w, 0) for w in words], start, end))
                held += len(words)
            if held > 500_000:
                flush()
                held = 0
        flush()
        yield {"doc_id": batch.column(0), "h": batch.column(2), "score": np.clip(best, 0, 1), "spans": [sorted(s) for s in spans]}

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("h"))
    return arrow_map(rows, work, "doc_id bigint, h bigint, score double, spans array<bigint>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score one half or more."""
    field, words = fitted(docs, labels)
    gone = scored(docs.select("doc_id", "text"), field, bool(words)).where("score >= 0.5").select("doc_id", "h")
    return without(docs, gone)


def model(spark, sf_dir: str) -> tuple[Field, set[str]]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fitted(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    field, words = model(spark, sf_dir)
    out = scored(table(spark, sf_dir, "documents"), field, bool(words))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
