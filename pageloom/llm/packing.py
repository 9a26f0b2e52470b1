"""Concatenate and cut: global offsets from prefix sums over partition token totals.

Pass one tokenizes each document once and keeps its place inside its partition in a stored table. Partition
totals (one row per task) are summed in order, which gives each partition its base. Pass two cuts every document
at multiples of the window: pieces that share a window across documents or partitions are its boundary records.
Every window but the last is full; the last is padded.

Null and empty texts consist of the end id alone. Repeated rows, and rows of one or no id, are packed as often as they occur.
An empty table gives no pieces. Very long texts, of any one character too, span any number of windows. The order is
that of the partitions; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm.bpe import BEYOND, VOCABULARY, default_path, vocabulary
from pageloom.llm.common import arrow_schema, in_batches, stored, table

WINDOW, END = 1024, 0
#: White space of twice this many characters may exhaust the faster library's splitter; blocks of it are looked for.
BLANK = 25_000


def long_blank(text: str) -> bool:
    """Whether ``text`` may hold a run of ``2 * BLANK`` characters of white space: such a run covers a whole block."""
    return any(text[at : at + BLANK].isspace() for at in range(0, len(text) - BLANK + 1, BLANK))


def _tokenizer(path: str):
    """Text to ids. Texts beyond Latin letters or with very long white space go to the file's own library, others to a faster one with the same ranks."""
    import public_tokenizers
    import tiktoken

    v = vocabulary(path)
    quick = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens=v.special)
    allowed = set(v.special)

    def ids(text: str) -> np.ndarray:
        if (text.isascii() or not BEYOND.search(text)) and not long_blank(text):
            return np.asarray(quick.encode_to_numpy(text, allowed_special=allowed), dtype="<u4")
        return np.array(v.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return ids


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """``part, local`` (tokens of the partition before it), ``doc_id, n, ids`` with the end id, in partition order."""
    path = path or default_path()
    schema = "part bigint, local bigint, doc_id bigint, n bigint, ids binary"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        encode, local, part = _tokenizer(path), 0, TaskContext.get().partitionId()
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                ids = [encode(t or "").tobytes() + tail for t in texts[at : at + 256]]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                before = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(before), batch.column(0).slice(at, 256), pa.array(n), pa.array(ids, pa.binary())],
                    schema=target)

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def placed(tokens: DataFrame) -> DataFrame:
    """Add ``at``, the document's offset in the whole corpus. One total per task is summed in order."""
    totals = tokens.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("local"))


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32``."""
    schema = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, "
              "ids_crc32 bigint")
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    cut = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, n, seq, offset, cut, zlib.crc32(cut)))
                    start += length
            columns = zip(*rows) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)

    ready = placed(stored(tokenized(docs, path)))
    return in_batches(ready.select("doc_id", "at", "n", "ids"), run, schema)


def sequences(cut: DataFrame, window: int = WINDOW, pad: int = END) -> DataFrame:
    """``sequence_id, ids`` (binary, padded to the window), ``bounds``: the pieces of each window in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    whole = cut.groupBy("sequence_id").agg(parts.alias("p"))
    zero = F.lit(np.array([pad], "<u4").tobytes())
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.select(
        "sequence_id", F.rpad(joined, F.lit(4 * window), zero).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"], x["length"])).alias("bounds"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents")).drop("ids")
