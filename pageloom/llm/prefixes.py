"""Conversation prefix trie by time-forward processing.

A node is a distinct sequence of first turns (role, text). It is named by a polynomial hash of its turns' 128-bit digests
modulo 2**127 - 1, which is carried along a conversation, also from one partition of the sorted turns to the next, so that no
conversation has to fit one task. A node's members, smallest member and subtree bound (members' remaining turns) are
aggregates that combine before the shuffle.

Subtree totals go from children to parents. Nodes whose bound is within ``limit`` belong to the shard of their highest such
ancestor. A task reads the nodes of its shards in reverse level order and keeps a priority queue of messages addressed
to parents: a node takes what its children sent, adds its own share and sends on. A queue that outgrows ``held`` entries
spills sorted runs to unnamed files. Shard roots' totals are summed per parent and the few nodes above (``limit`` turns or
more below each) take part in one last pass of the same kind: at most turns / ``limit`` nodes a level.

Rows without conv_id belong to no conversation. Null turns come first, null roles and texts are empty; turns of one number
are ordered by the digest of role and text, repeated rows are turns of their own. A table without
conversations has no nodes. Long texts are digested whole and never shuffled. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import arrow_map, stored, table
from pageloom.operators.skew import spread_join

PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
BACK = pow(BASE, -1, PRIME)
ROOT = (1).to_bytes(16, "big")
#: Turns below a shard root, queue entries in memory, conversation ids (as a power of two) to a part of a list of ends.
LIMIT, HELD, PART = 50_000, 200_000, 13
#: Turns that a conversation may take from the first of its hundred.
SHARED = 6


def digest(role: str, text: str) -> bytes:
    first = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(first).to_bytes(8, "big") + first + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(x: int) -> bytes:
    return (x % PRIME).to_bytes(16, "big")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, d`` (place from 1), ``token, chars, f`` (the prefix that ends here) of every turn."""

    def tokens(batch):
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield {"conv_id": batch.column(0), "turn": batch.column(1), "token": [digest(r or "", t or "") for r, t in zip(roles, texts)],
               "chars": [len(t or "") for t in texts]}

    def runs(batches):
        part, conv, k, acc = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            ids, tokens, ks, accs = batch.column(0).to_pylist(), batch.column(2), [], []
            for c, t in zip(ids, tokens.to_pylist()):
                if c != conv:
                    conv, k, acc = c, 0, 0
                k, acc = k + 1, (acc * BASE + _number(t)) % PRIME
                ks.append(k)
                accs.append(_bytes(acc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), batch.column(0), pa.array(ks, pa.int64()), tokens, batch.column(3), pa.array(accs, pa.binary())],
                names=["part", "conv_id", "k", "token", "chars", "acc"])

    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    ready = stored(arrow_map(rows, tokens, "conv_id bigint, turn bigint, token binary, chars bigint"))
    order = ["conv_id", "turn", "token"]
    cut = stored(ready.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        runs, "part bigint, conv_id bigint, k bigint, token binary, chars bigint, acc binary"))
    # One row per partition: what the last conversation of a partition hands to the next one.
    ends = cut.groupBy("part").agg(
        F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), F.max_by(F.struct("k", "acc"), F.struct("conv_id", "k")).alias("last"))
    carry: dict[int, tuple[int, int, int]] = {}
    before = None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        k, acc = r.last.k, _number(r.last.acc)
        if before and before[0] == r.lo:
            carry[r.part] = before
            if r.hi == r.lo:
                k, acc = before[1] + k, before[2] * pow(BASE, k, PRIME) + acc
        before = (r.hi, k, acc % PRIME)

    def whole(batch):
        out: tuple[list, list] = ([], [])
        for part, c, k, acc in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
            more, acc, known = 0, _number(acc), carry.get(part)
            if known and known[0] == c:
                more, acc = known[1], known[2] * pow(BASE, k, PRIME) + acc
            out[0].append(k + more)
            out[1].append(_bytes(pow(BASE, k + more, PRIME) + acc))
        yield {"conv_id": batch.column(1), "d": out[0], "token": batch.column(3), "chars": batch.column(4), "f": out[1]}

    return stored(arrow_map(cut, whole, "conv_id bigint, d bigint, token binary, chars bigint, f binary"))


def own(conv: Column) -> Column:
    """How many first turns conversation ``conv`` takes from the first conversation of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def paths(turns: DataFrame, spliced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, n, end`` if they end above their own turns) and their nodes ``f, parent, depth, chars, conv_id, n``.

    ``spliced``: the first ``own`` turns come from the first conversation of each hundred, the rest from its own later ones.
    """
    root = F.lit(ROOT)
    h = own(F.col("conv_id")) if spliced else F.lit(0)
    convs = turns.withColumn("h", h).groupBy("conv_id", "h").agg(
        F.max("d").alias("m"), F.max(F.when(F.col("d") == F.col("h"), F.col("f"))).alias("left"))
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("d") < SHARED)).groupBy(F.col("conv_id").alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("d", "f", "chars"))).alias("head"))
    named = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "first", "left")
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest(F.col("h"), F.lit(0)).cast("int")))
    none = F.array().cast("array<struct<d:bigint,f:binary,chars:bigint>>")
    known = named.withColumn("head", F.coalesce(head, none)).select(
        "conv_id", "h", "m", "head", F.size("head").cast("bigint").alias("taken"), F.coalesce("left", root).alias("left"),
        F.coalesce(F.get("head", F.size("head") - 1)["f"], root).alias("begin"))
    known = stored(known.withColumn("n", F.col("taken") + F.greatest(F.col("m") - F.col("h"), F.lit(0))))
    above = known.select("conv_id", "n", "head", F.posexplode("head").alias("i", "x")).select(
        F.col("x.f").alias("f"), F.when(F.col("i") > 0, F.get("head", F.col("i") - 1)["f"]).otherwise(root).alias("parent"),
        F.col("x.d").alias("depth"), F.col("x.chars").alias("chars"), "conv_id", "n")

    def moved(batch):
        fs, parents = [], []
        for d, token, f, h, begin, left in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 7, 8))):
            x = (_number(f) + (_number(begin) - _number(left)) * pow(BASE, d - h, PRIME)) % PRIME
            fs.append(_bytes(x))
            parents.append(_bytes((x - _number(token)) * BACK))
        yield {"f": fs, "parent": parents, "depth": [t + d - h for d, h, t in zip(*(batch.column(i).to_pylist() for i in (1, 5, 6)))],
               "chars": batch.column(3), "conv_id": batch.column(0), "n": batch.column(9)}

    joined = spread_join(turns, known.select("conv_id", "h", "taken", "begin", "left", "n"), ["conv_id"], ["d"], "inner").where("d > h")
    below = arrow_map(joined.select("conv_id", "d", "token", "chars", "f", F.col("h").cast("bigint"), "taken", "begin", "left", "n"), moved,
                      "f binary, parent binary, depth bigint, chars bigint, conv_id bigint, n bigint")
    return known.select("conv_id", "n"), stored(above.unionByName(below))


class Messages:
    """Priority queue of (level, node, leaves, saved); beyond ``held`` entries it spills sorted runs to unnamed files."""

    ENTRY = struct.Struct(">q16sqq")

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.heads = held, [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self._open(sorted(self.heap))
            self.heap = []
            if len(self.heads) > 32:
                runs, self.heads = self.heads, []
                self._open(heapq.merge(*([e, *rest] if isinstance(rest, list) else self._chain(e, rest) for e, _, rest in runs)))

    @staticmethod
    def _chain(first: tuple, rest: Iterator) -> Iterator:
        yield first
        yield from rest

    def _open(self, entries) -> None:
        file = tempfile.TemporaryFile()
        for e in entries:
            file.write(self.ENTRY.pack(*e))
        file.seek(0)

        def read():
            while data := file.read(self.ENTRY.size * 4096):
                yield from self.ENTRY.iter_unpack(data)
            file.close()

        rest = read()
        if (first := next(rest, None)) is not None:
            heapq.heappush(self.heads, (first, id(rest), rest))

    def take(self, level: int, node: bytes) -> Iterator[tuple]:
        """Remove and yield the messages to a node; nodes ask in the order of the queue."""
        key = (level, node)
        while True:
            spilled = self.heads and (not self.heap or self.heads[0][0] < self.heap[0])
            least = self.heads[0][0] if spilled else self.heap[0] if self.heap else None
            if least is None or least[:2] != key:
                return
            if spilled:
                _, mark, rest = heapq.heappop(self.heads)
                if (following := next(rest, None)) is not None:
                    heapq.heappush(self.heads, (following, mark, rest))
            else:
                heapq.heappop(self.heap)
            yield least


OUT = "f binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"


def passed_up(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Run the queue over partitions sorted by falling depth and node.

    ``nodes``: f, parent, depth, conv_id, n_convs, share (saved by the node itself), top (its parent is elsewhere) and
    what has come from elsewhere: children, leaves, saved.
    """

    def run(batches):
        queue = Messages(held)
        for batch in batches:
            out: list[list] = [[], [], []]
            for f, parent, depth, share, top, children, leaves, saved in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7, 8, 9))):
                saved += share
                for _, _, more, below in queue.take(-depth, f):
                    children, leaves, saved = children + 1, leaves + more, saved + below
                leaves = leaves or 1
                if not top:
                    queue.push((1 - depth, parent, leaves, saved))
                for column, value in zip(out, (children, leaves, saved)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), *(pa.array(x, pa.int64()) for x in out), batch.column(6)],
                names=[part.split(" ")[0] for part in OUT.split(", ")])

    columns = ["f", "parent", "depth", "conv_id", "n_convs", "share", "top", "children", "leaves", "saved"]
    return nodes.select(*columns).mapInArrow(run, OUT)


def totalled(convs: DataFrame, rows: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """Every node with its subtree totals (the columns of ``OUT``)."""
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") + 1).alias("work")).where("n_convs > 0").select(
        F.lit(ROOT).alias("f"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("chars"), "conv_id", "n_convs", "work")
    below = rows.groupBy("f").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("work"))
    nodes = stored(below.unionByName(root).withColumn("share", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"))
    high = nodes.where(F.col("work") > limit)
    low = nodes.where(F.col("work") <= limit)
    # The depth below the last high node on a conversation's path, and the node there: the shard of what lies under it.
    depths = spread_join(rows.select("f", "depth", "conv_id"), high.select("f"), ["f"], ["conv_id"], "inner").groupBy("conv_id").agg(F.max("depth").alias("d"))
    first = F.when(F.lit(high.where("depth = 0").count() > 0), F.lit(1)).otherwise(F.lit(0))
    cuts = convs.join(depths, "conv_id", "left").select("conv_id", F.coalesce(F.col("d") + 1, first).alias("cut"))
    shards = spread_join(rows.select("conv_id", "depth", "f"), cuts, ["conv_id"], ["depth"], "inner").where("depth = cut").select(
        "conv_id", F.col("f").alias("shard"))
    placed = spread_join(low, shards, ["conv_id"], ["f"]).withColumn("shard", F.coalesce("shard", F.lit(ROOT)))
    nothing = {name: zero for name in ("children", "leaves", "saved")}
    ready = placed.withColumns(nothing | {"top": F.col("f") == F.col("shard")})
    order = [F.desc("depth"), "f"]
    lower = stored(passed_up(ready.repartition("shard").sortWithinPartitions(*order), held))
    sent = lower.where("top and parent is not null").groupBy("parent").agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("parent", "f")
    upper = high.join(sent, "f", "left").withColumns({name: F.coalesce(name, zero) for name in nothing} | {"top": F.col("depth") == 0})
    return lower.unionByName(passed_up(upper.repartition(1).sortWithinPartitions(*order), held))


def hashed_ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``f, ends_sha256``: lists are joined in parts of a range of ids each, which one pass hashes in order."""
    ends = rows.where("depth = n").select("f", "conv_id").unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("f"), "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("f", F.shiftright("conv_id", PART).alias("part")).agg(ids.alias("ids"))

    def run(batches):
        node, sha = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for f, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if f != node:
                    if sha is not None:
                        done[0].append(node), done[1].append(sha.hexdigest())
                    node, sha = f, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["f", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["f", "ends_sha256"])

    return parts.repartition("f").sortWithinPartitions("f", "part").mapInArrow(run, "f binary, ends_sha256 string")


def trie(conversations: DataFrame, spliced: bool = True, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """One row per node: ``node, parent`` (their names), ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, rows = paths(numbered(conversations), spliced)
    nodes = stored(totalled(convs, rows, limit, held))
    above = nodes.select(F.col("f").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = spread_join(nodes, above, ["parent"], ["f"])
    out = named.join(hashed_ends(convs, rows), "f", "left")
    return out.select(
        F.col("f").alias("node"), "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_prefixes(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


OP11_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, max(d) AS m, xor(list_reduce(
    [4294967295] || flatten([[CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
g AS (SELECT k.*, (SELECT count(*) FROM t WHERE t.conv_id = k.b AND t.d <= k.h) AS taken FROM k),
r AS (SELECT c, d AS depth, role, text FROM g JOIN t ON t.conv_id = b AND d <= h
  UNION ALL SELECT c, taken + d - h, role, text FROM g JOIN t ON t.conv_id = c AND d > h),
q AS (SELECT c, depth, length(text) AS chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER
  (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS f FROM r),
p AS (SELECT c, depth, chars, f, lag(f, 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS parent FROM q UNION ALL SELECT c, 0, 0, 'root', NULL FROM g),
n AS (SELECT f, min(c) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY f),
w AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.f) AS n_children FROM n),
s AS (SELECT p.f, sum((w.n_convs - 1) * w.chars) AS saved, count(*) FILTER (w.n_children = 0) AS leaves
  FROM w JOIN p ON p.c = w.conv_id AND p.depth <= w.depth GROUP BY p.f),
e AS (SELECT f, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM p
  WHERE depth = (SELECT max(x.depth) FROM p x WHERE x.c = p.c) GROUP BY f)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s USING (f) LEFT JOIN e USING (f) LEFT JOIN n u ON u.f = w.parent
"""
