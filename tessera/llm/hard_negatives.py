"""Hard-negative mining by blocked dense products.

Anchors are broadcast in blocks of at most `BLOCK_BYTES`; tasks multiply each with blocks of
candidate rows in float64, which is exact below 2^53 (longer vectors are multiplied as integers
of any size).  A task holds, for each anchor, the first positives of all rows it has seen, and
sends those alone; the first of these states are the positives of the corpus.  A second pass
keeps in the same way, for each positive, the first rows of another label whose score lies in
the window below it.  Every anchor meets every row; nothing is sampled or cut.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint

#: Bytes of anchors that are broadcast at a time, and rows of each side that a task multiplies at a time.
BLOCK_BYTES, ANCHOR_ROWS, ROWS = 8 << 20, 256, 4096
#: Products are exact where lengths multiply to less.
EXACT = 2.0**52
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def usable(embeddings: DataFrame, shifted_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and embedding of the rows that take part: none of them null, all components finite.

    The label of every vec_id divisible by `shifted_every` is the next one of `labels`."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % shifted_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")


def _arrays(batch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_ids, labels and scaled vectors of a batch, by the length of the vectors; ids ascend, equal rows are one."""
    ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths, out = np.diff(ends, prepend=0), []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        vectors = values[(ends[rows] - n)[:, None] + np.arange(n)]
        order = np.lexsort((*vectors.T[::-1], labels[rows], ids[rows])) if len(np.unique(ids[rows])) < len(rows) else np.argsort(ids[rows])
        rows, vectors = rows[order], vectors[order]
        new = np.ones(len(rows), bool)
        new[1:] = (ids[rows][1:] != ids[rows][:-1]) | (labels[rows][1:] != labels[rows][:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        out.append((ids[rows][new], labels[rows][new], vectors[new]))
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers; those beyond a long are held at its ends."""
    longest = np.sqrt((anchors**2).sum(axis=1)), np.sqrt((rows**2).sum(axis=1))
    with np.errstate(invalid="ignore", over="ignore"):
        far = np.outer(*longest) >= EXACT if longest[0].max(initial=0) * longest[1].max(initial=0) >= EXACT else None
        found = anchors @ rows.T
    if far is None:
        return found.astype(np.int64)
    found[far] = 0
    found = found.astype(np.int64)
    for i, j in zip(*np.nonzero(far), strict=True):
        exact = sum(int(x) * int(y) for x, y in zip(anchors[i], rows[j], strict=True))
        found[i, j] = min(max(exact, NONE + 1), MOST)
    return found


class Best:
    """For each of n queries the first k (score, id) seen: higher scores first, then smaller ids, equal pairs once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), MOST)

    def offer(self, queries: np.ndarray, masked: np.ndarray, ids: np.ndarray) -> None:
        """masked: a row of scores for each query, NONE where a candidate does not count; ids ascend."""
        open_ = masked.max(axis=1, initial=NONE) >= np.maximum(self.score[queries, -1], NONE + 1)
        queries, masked = queries[open_], masked[open_]
        if not len(queries):
            return
        every = np.arange(len(queries))
        score, found = [self.score[queries]], [self.id[queries]]
        for _ in range(self.k):
            at = masked.argmax(axis=1)  # the first of a tie has the smallest id
            best = masked[every, at]
            score.append(best[:, None])
            found.append(np.where(best > NONE, ids[at], MOST)[:, None])
            masked[every, at] = NONE
        s, i = np.concatenate(score, axis=1), np.concatenate(found, axis=1)
        for again in (True, False):
            order = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > NONE]).max(initial=0) < EXACT else np.where(s == NONE, MOST, -s)), axis=-1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            if again:
                twice = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])
                s[:, 1:][twice], i[:, 1:][twice] = NONE, MOST
        self.score[queries], self.id[queries] = s[:, : self.k], i[:, : self.k]


def _candidates(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield from _arrays(batch.slice(start, ROWS))


def _positives(batches, block, k: int):
    """The first k rows of an anchor's label in what a task sees."""
    best = Best(block.value["n"], k)
    for ids, labels, vectors in _candidates(batches):
        for at, own, own_label, anchors in block.value["parts"].get(vectors.shape[1], ()):
            found = scores(anchors, vectors)
            found[(own_label[:, None] != labels) | (own[:, None] == ids)] = NONE
            best.offer(at, found, ids)
    a, j = np.nonzero(best.score > NONE)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best.score[a, j]), pa.array(best.id[a, j])], ["a", "score", "vec_id"])


def _negatives(batches, block, windows, k: int):
    """The first k rows of another label in the window below each positive."""
    low, high, positive = windows.value
    n = low.shape[1]
    best = Best(low.size, k)
    for ids, labels, vectors in _candidates(batches):
        for at, _, own_label, anchors in block.value["parts"].get(vectors.shape[1], ()):
            found = scores(anchors, vectors)
            found[own_label[:, None] == labels] = NONE
            for p in range(n):
                inside = (found >= low[at, p, None]) & (found <= high[at, p, None])
                some = np.flatnonzero(inside.any(axis=1))
                best.offer(at[some] * n + p, np.where(inside[some], found[some], NONE), ids)
    w, j = np.nonzero(best.score > NONE)
    a, p = w // n, w % n
    columns = [w, block.value["ids"][a], positive[a, p], high[a, p], best.score[w, j], best.id[w, j]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "anchor_id", "positive_id", "positive_score", "score", "vec_id"])


def _first(found: DataFrame, k: int, *more: str) -> DataFrame:
    """Merges the states of tasks: the first k of each `a`, with their rank; pairs that tasks share count once."""
    by_score = Window.partitionBy("a").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(by_score)).filter(F.col("rank") <= k).groupBy("a", "rank", "score", "vec_id", *more).agg(F.lit(1).alias("one")).drop("one")


def _block(anchors: DataFrame) -> dict:
    """Anchors as arrays, in pieces by the length of their vectors."""
    parts, ids, n = {}, [], 0
    for own, labels, vectors in _arrays(anchors.toArrow()):
        for start in range(0, len(own), ANCHOR_ROWS):
            piece = slice(start, start + ANCHOR_ROWS)
            size = len(own[piece])
            parts.setdefault(vectors.shape[1], []).append((np.arange(n, n + size), own[piece], labels[piece], vectors[piece]))
            ids.append(own[piece])
            n += size
    return {"n": n, "parts": parts, "ids": np.concatenate(ids) if ids else np.zeros(0, np.int64)}


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors as `usable` gives them.

    A negative's score is between low_percent of the positive's and the positive's own.  Equal rows
    are one; rows that share vec_id and score count once; no row is its anchor's positive under the
    anchor's vec_id.  Rows only meet anchors with vectors of the same length.  An anchor without
    positives, a positive without negatives and an empty table give no rows.
    """
    spark = rows.sparkSession
    anchors = checkpoint(anchors.select("vec_id", "label", "embedding").dropDuplicates())
    n, longest = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-n * 8 * (longest + 2) // BLOCK_BYTES))
    out = []
    for i in range(blocks):
        block = _block(anchors.filter(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)) == i))
        shared = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(lambda b, shared=shared: _positives(b, shared, positives), "a long, score long, vec_id long")
        first = _first(found, positives).toArrow()
        low, high = np.full((block["n"], positives), MOST), np.full((block["n"], positives), NONE)
        positive = np.zeros((block["n"], positives), np.int64)
        a, p = first.column("a").to_numpy(), first.column("rank").to_numpy() - 1
        high[a, p], positive[a, p] = first.column("score").to_numpy(), first.column("vec_id").to_numpy()
        low[a, p] = [-(-low_percent * x // 100) for x in first.column("score").to_pylist()]
        windows = spark.sparkContext.broadcast((low, high, positive))
        kinds = "a long, anchor_id long, positive_id long, positive_score long, score long, vec_id long"
        found = rows.mapInArrow(lambda b, shared=shared, windows=windows: _negatives(b, shared, windows, negatives), kinds)
        best = _first(found, negatives, "anchor_id", "positive_id", "positive_score")
        best = best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(checkpoint(best) if blocks > 1 else best)
    return reduce(DataFrame.unionByName, out)


def query(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
