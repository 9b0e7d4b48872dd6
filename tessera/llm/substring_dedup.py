"""Exact substring de-duplication by level-wise doubling.

A window is `window` consecutive words of one text.  Every word that lies in a window
whose word sequence also starts anywhere else (in the same text too) is removed.

The levels are window, window/2, ... down to `shortest`, taken from the short end: a
sequence of twice the length can repeat only if its parts do, so at each level only
windows whose part was found to repeat are extended.  Levels below the last judge a window
by the part with the least hash, which lies at the same place in each of its copies; the
last level counts every window that is left.

Rows are dealt into buckets of about 2 MB of text by a hash of the whole row.  A bucket
sends each of its hashes once, with a mark if it saw it twice, so a sequence that a third
of all texts share costs one row a bucket.  Counting is a window function over the hash;
what repeats goes back to the buckets that sent it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import BLANKS, U64, flat, mix, window_hashes, words

BUCKET_BYTES = 2 << 20
_SENT = "h long, g long, tag long"
_BUCKET = "__bucket"


def level_lengths(window: int, shortest: int = 9) -> list[int]:
    """Lengths in ascending order, each at most twice the one before.

    >>> level_lengths(35)
    [9, 18, 35]
    """
    lengths = [window]
    while (lengths[0] + 1) // 2 >= shortest:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width], as far as there are so many."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def least_parts(at: np.ndarray, hashes: np.ndarray, fit: np.ndarray, length: int, window: int) -> np.ndarray:
    """The least hash of the short windows inside each full window that starts where `fit` says."""
    width = window - length + 1
    full = np.full(len(fit) + width, np.iinfo(np.uint64).max, U64)
    full[at] = hashes
    return _extreme(full, width, np.minimum)[: len(fit)][fit]


class _Text:
    """The words of a bucket, and what each level does to its candidate windows."""

    def __init__(self, column, window: int):
        self.words = words(*flat(column), BLANKS)
        self.hashes = self.words.hashes()
        self.window, self.n = window, len(self.hashes)
        ends = np.repeat(self.words.first[1:], self.words.counts)
        self.fit = np.arange(self.n) + window <= ends

    def looked_at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where candidate windows start, and the hash by which this level judges each."""
        at, hashes = window_hashes(self.hashes, self.words.first, length)
        if length == self.window:
            keep = self.fit[at]
            return at[keep], hashes[keep]
        return np.flatnonzero(self.fit), least_parts(at, hashes, self.fit, length, self.window)

    def narrow(self, length: int, found: np.ndarray) -> None:
        """Keeps the full windows whose hash at this level is among `found`."""
        at, hashes = self.looked_at(length)
        self.fit[at[~np.isin(hashes, found)]] = False

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another hash of the full windows at these places."""
        where, hashes = window_hashes(mix(self.hashes ^ U64(0x5851F42D4C957F2D)), self.words.first, self.window)
        return hashes[np.searchsorted(where, at)]

    def removed(self) -> np.ndarray:
        edge = np.zeros(self.n + self.window + 1, np.int64)
        starts = np.flatnonzero(self.fit)
        edge[starts] += 1
        edge[starts + self.window] -= 1
        return np.cumsum(edge)[: self.n] > 0


def kept_text(w, removed: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, for each row."""
    keep = np.flatnonzero(~removed)
    sizes = w.ends[keep] - w.starts[keep] + 1
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    source = np.arange(total) + np.repeat(w.starts[keep] - (stops - sizes), sizes)
    out = w.data[np.minimum(source, max(len(w.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[stops - 1] = 0x20
    edges = np.concatenate([[0], stops])[np.searchsorted(keep, w.first)]
    # the space after a row's last word goes
    gone = edges[1:][edges[1:] > edges[:-1]] - 1
    mask = np.ones(total, bool)
    mask[gone] = False
    lengths = np.diff(edges) - (edges[1:] > edges[:-1])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(out[mask].tobytes()))


def _narrowed(table: pa.Table, found: list[np.ndarray], lengths: list[int], text: str) -> _Text:
    t = _Text(table.column(text), lengths[-1])
    for length, hashes in zip(lengths, found, strict=False):
        t.narrow(length, hashes)
    return t


def _send(t: _Text, bucket: int, length: int) -> pa.Table:
    at, hashes = t.looked_at(length)
    if length < t.window:  # one place of a short window is the least part of many full ones
        part_at, part = window_hashes(t.hashes, t.words.first, length)
        chosen = np.isin(part, hashes)
        at, hashes = part_at[chosen], part[chosen]
    hashes, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    other = t.second(at[first]) if length == t.window else np.zeros(len(first), U64)
    columns = [hashes.view(np.int64), other.view(np.int64), bucket * 2 + (counts > 1)]
    return pa.table([pa.array(c) for c in columns], names=["h", "g", "tag"])


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", shortest: int = 9) -> DataFrame:
    """Adds n_words, n_removed (long) and kept_text to the rows; each row is judged on the input as it is.

    Nulls count as empty texts: no words, and kept_text is empty.  Texts shorter than a window
    keep all words.  Repeated rows repeat each other.  Ties do not arise.  An input column with
    the name of an output column is replaced.  An empty table gives an empty table.
    """
    lengths = level_lengths(window, shortest)
    docs = docs.drop("n_words", "n_removed", "kept_text", _BUCKET)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    others = [c for c in docs.columns if docs.schema[c].dataType.typeName() in ("long", "integer", "string")]
    dealt = docs.withColumn(_BUCKET, F.pmod(F.xxhash64(*others), F.lit(buckets)))

    def first_level(table: pa.Table) -> pa.Table:
        return _send(_narrowed(table, [], lengths, text), table.column(_BUCKET)[0].as_py(), lengths[0])

    def repeated(sent: DataFrame) -> DataFrame:
        of_hash = Window.partitionBy("h", "g")
        times = F.sum(1 + F.col("tag") % 2).over(of_hash)
        return sent.withColumn("n", times).filter("n > 1").select("h", F.shiftright("tag", 1).alias(_BUCKET))

    def parts(table: pa.Table, n: int) -> list[np.ndarray]:
        level = table.column("level").to_numpy()
        hashes = table.column("h").to_numpy().view(U64)
        return [hashes[level == i] for i in range(n)]

    def extend(level: int):
        def send(table: pa.Table, found: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({"h": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "tag": pa.array([], pa.int64())})
            return _send(_narrowed(table, parts(found, level), lengths, text), table.column(_BUCKET)[0].as_py(), lengths[level])

        return send

    found = repeated(dealt.groupBy(_BUCKET).applyInArrow(first_level, _SENT)).withColumn("level", F.lit(0))
    for level in range(1, len(lengths)):
        sent = dealt.groupBy(_BUCKET).cogroup(found.groupBy(_BUCKET)).applyInArrow(extend(level), _SENT)
        found = found.unionByName(repeated(sent).withColumn("level", F.lit(level)))

    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        out = table.drop_columns([_BUCKET])
        t = _narrowed(table, parts(found, len(lengths)), lengths, text)
        gone = t.removed()
        before = np.concatenate([[0], np.cumsum(gone)])
        out = out.append_column("n_words", pa.array(t.words.counts))
        out = out.append_column("n_removed", pa.array(before[t.words.first[1:]] - before[t.words.first[:-1]]))
        return out.append_column("kept_text", kept_text(t.words, gone).cast(pa.string()))

    return dealt.groupBy(_BUCKET).cogroup(found.groupBy(_BUCKET)).applyInArrow(cut, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(js), 0) AS m, [ws[j] FOR j IN range(1, len(ws) + 1) IF js IS NULL OR NOT list_contains(js, j)] AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
