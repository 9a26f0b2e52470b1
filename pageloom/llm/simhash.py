"""SimHash near-duplicates: a binary trie self-join within blocks that share exact bits.

Fingerprints at most ``budget`` bits apart agree on at least one of ``budget + 1`` bit fields, so each
distinct fingerprint is dealt once per field. Inside a field value a binary trie (a sorted
array whose nodes are ranges) is joined with itself: node pairs are traversed together, the bits in which
their paths differ are counted, and a pair is dropped once it exceeds the budget. Only a spanning
forest of the links leaves a task, never all pairs of a group.

Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and
are handled once. Repeated rows give one result row each. An empty table gives an empty result.

``keep_first``, the stage of the pipeline, keeps one document of each class: the one with the smallest id, and
of several texts under that id the one with the smallest hash. Rows that repeat both id and text are one document
and stay together; rows without an id belong to no class and stay. Extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_map, components, paired_blocks, table, without
from pageloom.operators.skew import spread_join
from pageloom.session import cut_lineage

SHINGLE, BUDGET, SEED, BLOCK, LEAF = 4, 4, 42, 4096, 128


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of all ``width``-word shingles in order; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id, h, fp`` of every row: the 64 bits as a signed bigint; ``h`` as in ``without``."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield {"doc_id": batch.column(0), "h": batch.column(1), "fp": fps}

    return arrow_map(named.select("doc_id", F.xxhash64("doc_id", "text"), "text"), work, "doc_id bigint, h bigint, fp bigint")


def trie_ranges(fps: np.ndarray, budget: int, leaf: int = LEAF):
    """Pairs of ranges ``a, b, c, d`` of the sorted ``fps`` whose nodes may hold links; each pair of rows is in one."""
    stack = [(0, len(fps), 0, len(fps), 63, 0)]
    while stack:
        a, b, c, d, bit, off = stack.pop()
        if b <= a or d <= c:
            continue
        if bit < 0 or (b - a) <= leaf or (d - c) <= leaf:
            yield a, b, c, d
            continue
        mask = np.uint64(1 << bit)
        m = a + int(np.count_nonzero((fps[a:b] & mask) == 0))
        if a == c:
            stack += [(a, m, a, m, bit - 1, off), (m, b, m, b, bit - 1, off)]
            if off < budget:
                stack.append((a, m, m, b, bit - 1, off + 1))
            continue
        n = c + int(np.count_nonzero((fps[c:d] & mask) == 0))
        stack += [(a, m, c, n, bit - 1, off), (m, b, n, d, bit - 1, off)]
        if off < budget:
            stack += [(a, m, n, d, bit - 1, off + 1), (m, b, c, n, bit - 1, off + 1)]


def trie_links(fps: np.ndarray, budget: int, link, leaf: int = LEAF) -> None:
    """Call ``link(i, j array)`` for positions of the sorted ``fps`` at most ``budget`` bits apart."""
    for a, b, c, d in trie_ranges(fps, budget, leaf):
        for i in range(a, b):
            lo = max(c, i + 1) if a == c else c
            near = np.flatnonzero(np.bitwise_count(fps[lo:d] ^ fps[i]) <= budget)
            if len(near):
                link(i, near + lo)


def trie_labels(fps: np.ndarray, budget: int, leaf: int = LEAF) -> np.ndarray:
    """The smallest position reachable by links from each position of the sorted ``fps``.

    Rows whose links lead to their own label already cost no step of their own, so a dense group
    costs as many merges as it has rows, not as it has pairs.
    """
    labels = np.arange(len(fps))
    for a, b, c, d in trie_ranges(fps, budget, leaf):
        step = max(1, (1 << 20) // (d - c))
        for lo in range(a, b, step):
            hi = min(b, lo + step)
            near = np.bitwise_count(fps[lo:hi, None] ^ fps[None, c:d]) <= budget
            differ = near & (labels[lo:hi, None] != labels[None, c:d])
            for i in np.flatnonzero(differ.any(axis=1)).tolist():
                found = np.unique(np.append(labels[c:d][near[i]], labels[lo + i]))
                if len(found) > 1:
                    labels[np.isin(labels, found[1:])] = found[0]
    return labels


def links(distinct: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """``a, b``: a spanning forest per block of the links among distinct fingerprints ``fp``."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    fields = [F.struct(F.lit(i).alias("f"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
              for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    keyed = distinct.select("fp", F.explode(F.array(*fields)).alias("s")).select("fp", F.xxhash64("s.f", "s.v").alias("key"))
    items = paired_blocks(keyed, "key", "fp", block).select("item", "fp")

    def solve(rest: pa.Table):
        fps = np.unique(rest.column("fp").to_numpy().view(np.uint64))
        labels = trie_labels(fps, budget)
        x = np.flatnonzero(labels != np.arange(len(fps)))
        return fps[x].view(np.int64), fps[labels[x]].view(np.int64)

    return by_item(items, solve)


def by_item(items: DataFrame, solve) -> DataFrame:
    """Run ``solve`` on the rows of each ``item``, many items to a task, one item in memory."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held, key, out = [], None, []

        def close():
            if sum(map(len, held)) > 1:
                a, b = solve(pa.Table.from_batches(held))
                if len(a):
                    out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and ids[lo] != key:
                    close()
                    held = []
                key = ids[lo]
                held.append(batch.slice(lo, hi - lo))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
        close()
        yield from out

    return items.repartition("item").sortWithinPartitions("item").mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """``doc_id, h, fp, component_id, first_h`` of every row.

    The component is the smallest id reachable; ``first_h`` is the smallest hash of a text under that id in the class.
    """
    own = cut_lineage(fingerprints(docs, doc_id, text, width))
    first = cut_lineage(own.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")))
    roots = components(links(first.select("fp"), budget)).withColumnRenamed("node", "fp")
    joined = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    known = spread_join(joined.select("fp", "root"), least, ["root"], ["fp"], rows=5_000).select("fp", "least")
    return spread_join(own, known, ["fp"], ["doc_id"], rows=5_000).select(
        "doc_id", "h", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("first_h"))


def keep_first(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates; null ids stay."""
    found = classes(docs.where("doc_id is not null").select("doc_id", "text"), budget=budget, width=width)
    return without(docs, found.where("component_id <> doc_id or first_h <> h").select("doc_id", "h"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
