"""Language identification, words first: known words score by their log frequency in each language, unseen words by
progressively shorter character n-grams.

Fitted on at most about ``sample`` labelled training documents (whole texts), chosen by a hash. A word is known
if it was seen at least twice; the most frequent ``words`` are kept, and as many n-grams of each length. An unseen word is cut into the longest
known n-grams, from ``LONGEST`` characters down to one; it counts against a language by 12 at most, however long it is.

Null texts and texts without letters give ``und`` and score 0. Ties go to the first language by name. Repeated rows give
one result row each; with no labelled row every text is ``und``. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm.common import arrow_map, bounded_sample, fold, table
from pageloom.session import cut_lineage

SAMPLE, WORDS, LONGEST, NONE = 4_000, 30_000, 4, "und"
WORD = re.compile(r"[^\W\d_]+")


def _words(batch):
    total: Counter = Counter()
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            total[lang, w] += n
    yield {"lang": [k[0] for k in total], "gram": [k[1] for k in total], "n": list(total.values())}


def _grams(batch):
    """Counts of the n-grams of words, whose edges are marked by blanks."""
    total: Counter = Counter()
    for lang, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
        edged = f" {w} "
        for size in range(1, LONGEST + 1):
            for i in range(len(edged) - size + 1):
                total[lang, size, edged[i : i + size]] += n
    keys = list(total)
    yield {"lang": [k[0] for k in keys], "size": [k[1] for k in keys], "gram": [k[2] for k in keys], "n": list(total.values())}


class Model:
    """Log frequency per language of words and n-grams."""

    def __init__(self, rows: list[tuple[str, int, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, size, gram, n in rows:
            counts[size].setdefault(gram, np.zeros(len(self.langs)))[at[lang]] += n
        self.tables: list[dict[str, np.ndarray]] = []
        for held in counts:
            total = sum(held.values(), np.zeros(len(self.langs))) + 0.5 * (len(held) + 1)
            self.tables.append({g: np.log((n + 0.5) / total) for g, n in held.items()})
        self.memo: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        known = self.tables[0].get(w)
        if known is not None:
            return known - known.max()
        edged, i, out = f" {w} ", 0, np.zeros(len(self.langs))
        while i < len(edged):
            for size in range(min(LONGEST, len(edged) - i), 0, -1):
                hit = self.tables[size].get(edged[i : i + size])
                if hit is not None:
                    out = out + hit - hit.max()
                    break
            else:
                size = 1
            i += max(1, size - 1) if i + size < len(edged) else size
        return np.maximum(out - out.max(initial=-np.inf), -12.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall((text or "").lower()))
        if not counts or not self.langs:
            return NONE, 0.0
        if len(self.memo) > 200_000:
            self.memo.clear()
        memo, rows = self.memo, []
        for w in counts:
            if (v := memo.get(w)) is None:
                v = memo[w] = self.word(w)
            rows.append(v)
        total = np.fromiter(counts.values(), float, len(counts)) @ np.array(rows)
        odds = np.exp(np.maximum(total - total.max(), -700))
        return self.langs[int(np.argmax(total))], float(1 / odds.sum())


def fitted(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Model:
    """Model of labelled rows of ``docs`` (doc_id, text, lang): a bounded sample, a bounded table."""
    rows = bounded_sample(docs.where("lang is not null and text is not null"), sample, "doc_id", "text", "lang").select("text", "lang")
    found = arrow_map(rows, _words, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = cut_lineage(found)
    grams = arrow_map(found, _grams, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    least = found.where("n > 1").select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(grams)
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    kept = least.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words).drop("r")
    return Model([(r.lang, r["size"], r.gram, r.n) for r in kept.collect()])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        out = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "lang_pred": [x for x, _ in out], "score": [s for _, s in out]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), work, "doc_id bigint, lang_pred string, score double")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predicted(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
