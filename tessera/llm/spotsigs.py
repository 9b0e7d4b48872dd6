"""Document fingerprints by SpotSigs.

An anchor is a common word of `ANCHORS`; its signature is the anchor with the chain of the
next `chain` content words (words that are no anchors).  Words are runs of letters of the
lower-cased text, so case, digits and punctuation do not count.  A text too poor in anchors
to have a signature gets the chains that start at each of its words, or all its words as one
chain.  The signature set, as sorted 32-bit hashes in hex, is the fingerprint.

Likeness is the Jaccard similarity of two sets, 0 at once where the lengths rule out a given
threshold.  `near_classes` finds all near-duplicates of a corpus: sets are partitioned by length,
candidates share a rare signature in a partition, and lengths and overlaps that cannot suffice
are left out before sets are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import NON_LETTERS, U64, flat, mix, slices, words
from .jaccard_join import jaccard_components

# The most common function words of four languages.
ANCHORS = """
the of and to a in is it that was for on with as be by at from this an are or have not
le la les de des du un une et est en que qui dans pour par sur pas au avec il ce ne se
der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an
el los las del y que en un una por con para su al lo como se no es
""".split()

#: Bounds that the driver holds at most.
MOST_RUNS = 20_000


def _anchor_hashes() -> np.ndarray:
    column = pa.array([" ".join(sorted(set(ANCHORS)))])
    return np.unique(words(*flat(column), NON_LETTERS, lower=True).hashes())


ANCHOR_HASHES = _anchor_hashes()


def signatures(data: np.ndarray, offsets: np.ndarray, chain: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct signature, by row and hash."""
    w = words(data, offsets, NON_LETTERS, lower=True)
    hashes, rows = w.hashes(), w.rows
    n = len(hashes)
    at = np.minimum(np.searchsorted(ANCHOR_HASHES, hashes), len(ANCHOR_HASHES) - 1)
    is_anchor = ANCHOR_HASHES[at] == hashes

    def chains(starts: np.ndarray, links: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the words at `starts` with the next words among `links`, inside a row."""
        first = np.searchsorted(links, starts, side="right")
        whole = first + length <= len(links)
        starts, first = starts[whole], first[whole]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, U64)
        whole = rows[links[first + length - 1]] == rows[starts]
        starts, first = starts[whole], first[whole]
        value = hashes[starts]
        for k in range(length):
            value = mix(value * U64(0x9E3779B97F4A7C15) + hashes[links[first + k]])
        return rows[starts], value

    row, value = chains(np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor), chain)
    poor = (np.bincount(row, minlength=len(offsets) - 1) == 0) & (w.counts > 0)
    if poor.any():
        every = np.arange(n)
        row2, value2 = chains(every[poor[rows]], every, chain)
        short = np.flatnonzero(poor & (w.counts <= chain))
        row3 = short
        value3 = np.array([int(np.bitwise_xor.reduce(mix(hashes[w.first[i] : w.first[i + 1]] + np.arange(w.counts[i], dtype=U64)))) for i in short], U64)
        row, value = np.concatenate([row, row2, row3]), np.concatenate([value, value2, value3])
    packed = np.unique((row.astype(U64) << U64(32)) | (value >> U64(32)))
    return (packed >> U64(32)).astype(np.int64), (packed & U64(0xFFFFFFFF)).astype(np.uint32)


def fingerprints(rows: np.ndarray, values: np.ndarray, n: int) -> list[str]:
    """The sets of n rows in hex, eight digits a signature, ascending."""
    text = values.astype(">u4").tobytes().hex()
    edges = (np.searchsorted(rows, np.arange(n + 1)) * 8).tolist()
    return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 1 for two empty ones; 0 where their lengths rule out `least`."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = np.intersect1d(a, b, assume_unique=True).size
    return shared / (len(a) + len(b) - shared)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of each text; null counts as empty, whose fingerprint is empty."""

    @F.pandas_udf("string")
    def made(texts):
        import pandas as pd

        column, out = pa.array(texts, pa.large_string(), from_pandas=True), []
        for batch in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
            out += fingerprints(*signatures(*flat(batch.column("text"))), batch.num_rows)
        return pd.Series(out, dtype=object)

    return made(text)


def in_order(docs: DataFrame, run_rows: int = 200) -> DataFrame:
    """docs (doc_id, text) in ascending order, cut into short runs: __run, and __end on one more row
    than the run has, the one that follows it (after the last run: the first row).

    Bounds are doc_ids of the table, one for about `run_rows` rows, `MOST_RUNS` at most: runs are read
    as streams, so longer ones need no more memory.  Rows of one doc_id follow
    each other by text; null comes first.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("__at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, low = docs.agg(F.count("*"), F.min("__at")).first()
    if not n:
        return docs.select(F.lit(0).alias("__run"), F.lit(False).alias("__end"), "__at", "doc_id", "text")
    runs = min(max(1, -(-n // run_rows)), MOST_RUNS)
    part = docs.agg(F.percentile_approx("__at", [i / runs for i in range(1, runs)] or [0.5], F.lit(min(runs * 50, 1_000_000))).alias("p")).first().p if runs > 1 else []
    bounds = sorted({low, *part})
    starts = np.array(bounds, np.int64)

    @F.pandas_udf("array<struct<run:int,end:boolean>>")
    def places(ids):
        import pandas as pd

        at = np.searchsorted(starts, ids.to_numpy(), side="right") - 1
        first = starts[at] == ids.to_numpy()
        return pd.Series([[(int(i), False), (int(i - 1) % len(starts), True)] if f else [(int(i), False)] for i, f in zip(at, first, strict=True)])

    spread = docs.withColumn("__p", F.explode(places("__at"))).select(F.col("__p.run").alias("__run"), F.col("__p.end").alias("__end"), "__at", "doc_id", "text")
    return spread.repartition("__run").sortWithinPartitions("__run", "__end", "__at", "text")


def _point_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def _compared(batches, chain: int):
    """Of each row and the row that follows it in its run."""
    held = None  # the last row seen, whose next one has not come
    for batch in slices(batches, "text"):
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        n = table.num_rows
        run = table.column("__run").to_numpy()
        end = table.column("__end").to_numpy()
        data, offsets = flat(table.column("text"))
        rows, values = signatures(data, offsets, chain)
        prints = fingerprints(rows, values, n)
        edges = np.searchsorted(rows, np.arange(n + 1))
        here = [i for i in range(n - 1) if not end[i] and run[i + 1] == run[i]]
        points = _point_starts(data)
        first_point = np.searchsorted(points, offsets)
        counts, edited = [], []
        for i in here:
            a, b, c = first_point[i], first_point[i + 1], first_point[i + 2]
            cut = (b - a) // 4
            head = data[offsets[i] : points[b - cut] if cut else offsets[i + 1]]
            stop = offsets[i + 2] if b + cut >= c else points[b + cut]
            edited.append(head.tobytes() + data[offsets[i + 1] : stop].tobytes())
            counts.append(int(b - a))
        if here:
            stops = np.concatenate([[0], np.cumsum([len(x) for x in edited])]).astype(np.int64)
            edited_rows, edited_values = signatures(np.frombuffer(b"".join(edited), np.uint8), stops, chain)
            edited_edges = np.searchsorted(edited_rows, np.arange(len(here) + 1))
            sets = [values[edges[i] : edges[i + 1]] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").take(pa.array(here)).combine_chunks(),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    pa.array([prints[i] for i in here]),
                    pa.array(fingerprints(edited_rows, edited_values, len(here))),
                    pa.array([likeness(sets[i], edited_values[edited_edges[k] : edited_edges[k + 1]]) for k, i in enumerate(here)]),
                    pa.array([likeness(sets[i], sets[i + 1]) for i in here]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        held = table.slice(n - 1)


def compare_with_next(docs: DataFrame, chain: int = 2) -> DataFrame:
    """For each row: its fingerprint, that of its edited text (the last quarter replaced by as much of
    the beginning of the next row's text), and the likeness of its fingerprint to both."""
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(lambda b: _compared(b, chain), kinds)


def spot_sets(column, chain: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of the rows; row and signature of each member, by row and signature."""
    rows, values = signatures(*flat(column), chain)
    return np.bincount(rows, minlength=len(column)), rows, mix(values.astype(U64))


def near_classes(docs: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles (signatures) and component_id: the least doc_id reached by likeness of num/den or more.

    Sets are parted by their lengths such that only neighbouring partitions can hold links; in a partition they
    are compared where they share a signature of their prefixes in order of rarity, and only as far as lengths and
    overlap can still suffice."""
    return jaccard_components(docs, num, den, sets_of=spot_sets, by_length=True)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
