"""The prefix trie of conversations: which beginnings they share.

A turn is the digest of its role and text; a conversation is the array of its turns.  Arrays are
range-sorted over the whole corpus, so the conversations below a node are neighbours.  A task
sweeps its range with a stack of open nodes: what a conversation shares with the one before it
(their longest common prefix) stays open, deeper nodes close and add their sums to their parents,
the rest of the conversation is opened.

Nodes on the first and on the last path of a range may go on in the ranges beside it.  A task
sends these with what it knows of them, and the stacks are stitched: one stream over the ranges
in order, of two paths a range at most, sweeps them in the same way.

Texts stay where they are read; sorted and swept are 16 bytes and a length for each turn.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

TURN = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
MOST = (1 << 63) - 1
#: Of the sums of a node: those that add up over its parts, and over its children.
KINDS = "kind string, range int, side int, node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string"
NAMES = [k.split()[0] for k in KINDS.split(", ")]


def arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (placed, turn, code, chars) in order of turn, null first.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation. Turns with one
    number follow each other by their digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("placed"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), code.alias("code"), F.length(text).cast("long").alias("chars"))
    return conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Rebuilds conversation c: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % (most + 1)."""
    heads = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    tail = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = convs.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), tail).alias("turns"))


class Node:
    """An open node; ends holds the conversations that end at it, as far as their digest is still to be made."""

    __slots__ = ("chars", "conv_id", "depth", "ends", "first_path", "name", "n_children", "n_convs", "n_leaves", "parent", "saved")

    def __init__(self, name: bytes, parent: bytes | None, depth: int, chars: int, first_path: bool = False):
        self.name, self.parent, self.depth, self.chars, self.first_path = name, parent, depth, chars, first_path
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = MOST, 0, 0, 0, 0
        self.ends = array("q")

    def closed(self) -> None:
        """All its children are in."""
        self.n_leaves += not self.n_children
        self.saved += (self.n_convs - 1) * self.chars

    def take(self, child: Node) -> None:
        self.n_children += 1
        self.n_convs += child.n_convs
        self.n_leaves += child.n_leaves
        self.saved += child.saved
        self.conv_id = min(self.conv_id, child.conv_id)

    def row(self, kind: str, at: int, side: int, ends: str | None) -> tuple:
        return kind, at, side, self.name, self.parent, self.depth, self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved, self.chars, ends


ROOT = hashlib.blake2b(b"", digest_size=TURN).digest()


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    if a == b:
        return len(a) // TURN
    i, n = 0, min(len(a), len(b))
    while i < n and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


def _digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _flushed(rows: list, least: int):
    """The rows as a batch once they are as many."""
    if len(rows) >= max(least, 1):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
        rows.clear()


TYPES = [{"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}[k.split()[1]] for k in KINDS.split(", ")]
FLUSH = 10_000


def sweep(batches):
    """Rows of a range in order of key and conv_id -> its closed nodes (`node`), those that may go on beside it (`open`), and which conversations end at the latter (`end`)."""
    at, stack, before, out = TaskContext.get().partitionId(), [], None, []

    def leave(node: Node, side: int) -> None:
        out.append(node.row("open", at, side, None))
        out.extend(("end", at, side, node.name, None, node.depth, c, 0, 0, 0, 0, 0, None) for c in node.ends)

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node.first_path:
                leave(node, 0)
                continue
            node.closed()
            stack[-1].take(node)
            out.append(node.row("node", at, 0, _digest(node.ends)))

    for batch in batches:
        for conv_id, key, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "chars")), strict=True):
            if before is None:
                stack.append(Node(ROOT, None, 0, 0, True))
            common = 0 if before is None else shared(before, key)
            close(common + 1)
            for d in range(common, len(key) // TURN):
                above = stack[-1]
                name = hashlib.blake2b(above.name + key[d * TURN : (d + 1) * TURN], digest_size=TURN).digest()
                stack.append(Node(name, above.name, d + 1, chars[d], before is None))
            top, before = stack[-1], key
            top.n_convs += 1
            top.conv_id = min(top.conv_id, conv_id)
            top.ends.append(conv_id)
            yield from _flushed(out, FLUSH)
    while stack:
        node = stack.pop()
        leave(node, int(not node.first_path))
    yield from _flushed(out, 1)


def stitch(batches):
    """Open nodes of all ranges, by range, side and depth -> the nodes they are parts of. One stack is held."""
    stack, out = [], []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.closed()
            if stack:
                stack[-1].take(node)
            out.append(node.row("node", 0, 0, None))

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            r = dict(zip(NAMES, r, strict=True))
            depth = r["depth"]
            if depth >= len(stack) or stack[depth].name != r["node"]:
                close(depth)
                stack.append(Node(r["node"], r["parent"], depth, r["chars"]))
            node = stack[depth]
            node.n_convs += r["n_convs"]
            node.n_children += r["n_children"]
            node.n_leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            node.conv_id = min(node.conv_id, r["conv_id"])
            yield from _flushed(out, FLUSH)
    close(0)
    yield from _flushed(out, 1)


def digests(batches):
    """Rows (node, conv_id) in that order -> node, ends_sha256. The ids pass one by one; a digest of a list has no parts that could be put together."""
    name, running = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for node, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != name:
                if name is not None:
                    yield made()
                name, running = node, hashlib.sha256(str(conv_id).encode())
            else:
                running.update(f",{conv_id}".encode())
    if name is not None:
        yield made()


def _key(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: t["code"]), ""))


def trie(convs: DataFrame, range_convs: int = 50_000) -> DataFrame:
    """The nodes of convs (conv_id, turns as `arrays` gives them; conv_id is a key): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The bounds of ranges come from a sample of 100 keys a range, as Spark takes it.  No conversations give no nodes.
    """
    spark = convs.sparkSession
    keyed = checkpoint(convs.select("conv_id", _key(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.count() // range_convs)
    swept = checkpoint(keyed.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(sweep, KINDS))
    edges = swept.filter("kind = 'open'").select(*NAMES).repartition(1).sortWithinPartitions("range", "side", "depth").mapInArrow(stitch, KINDS)
    ends = swept.filter("kind = 'end'").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ends.mapInArrow(digests, "node binary, ends_sha256 string")
    stitched = edges.drop("ends_sha256").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    nodes = checkpoint(swept.filter("kind = 'node'").unionByName(stitched.select(*NAMES)))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(with_shared_heads(arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = r"""
WITH steps AS (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b))
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), cut AS (
  SELECT own.*, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 6 AS BIGINT) AS h FROM own, steps
), c AS (
  SELECT cut.conv_id, list_concat(coalesce(b.turns, [])[1:h], cut.turns[h + 1:]) AS path FROM cut LEFT JOIN own AS b ON b.conv_id = cut.conv_id - cut.conv_id % 100
), n AS (
  SELECT path[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(c.path) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM c) AS c GROUP BY ALL
), k AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children
  FROM n LEFT JOIN n AS p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
), s AS (
  SELECT path[1:d] AS path, d AS depth, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves,
         sum((n_convs - 1) * CASE WHEN depth > 0 THEN length(path[depth].text) ELSE 0 END) AS saved_tokens
  FROM (SELECT path, depth, n_convs, n_children, unnest(range(depth + 1)) AS d FROM k) GROUP BY 1, 2
)
SELECT k.conv_id, k.depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN s ON k.depth = s.depth AND k.path = s.path
"""
