"""Benchmark decontamination with an FM-index per shard of training text.

Texts are lower-cased (A-Z) and split into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.  A test
phrase is `size` consecutive words of a benchmark item, or all words of a shorter one.

Each shard (about 1 MB of whole texts) is indexed where phrases can occur at all: in runs of
words that the benchmark knows, each closed by its own separator.  The index is the
Burrows-Wheeler transform of the word numbers in a wavelet matrix, with the suffix positions
of every eighth word and of each run's first word.  All phrases are searched backwards at
once, their occurrences located by stepping to a sampled position, and their word ranges
merged into removal spans.  Nothing is shuffled.  The benchmark is sent to the tasks in
blocks of `BLOCK_BYTES` at most; texts pass through one block after the other.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import NON_ALNUM, U64, flat, slices, words

#: Bytes of benchmark text that one task holds at a time.
BLOCK_BYTES = 2 << 20
SAMPLE_EVERY = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2^bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many of the first `upto` symbols are `symbol`, for arrays of both."""
        start = np.zeros_like(upto)
        for b, ones, zeros in self.levels:
            high = ((symbol >> b) & 1).astype(bool)
            start_ones, upto_ones = ones[start], ones[upto]
            start = np.where(high, zeros + start_ones, start - start_ones)
            upto = np.where(high, zeros + upto_ones, upto - upto_ones)
        return upto - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbol 0 is a separator, and each one counts as a letter of its own."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    key = symbols + len(separators)
    key[separators] = np.arange(len(separators))
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        step *= 2


class FmIndex:
    """Backward search and location of word sequences in runs of symbols that end in 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]).astype(np.int64)
        self.ranks = WaveletMatrix(self.last, max(1, int(alphabet).bit_length()))
        run_start = np.ones(len(symbols), bool)
        run_start[1:] = symbols[:-1] == 0
        self.is_sampled = ((order % SAMPLE_EVERY) == 0) | run_start[order]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.is_sampled)])
        self.samples = order[self.is_sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index rows that start with each phrase, all of one length: from, to."""
        low, high = self.below[phrases[:, -1]], self.below[phrases[:, -1] + 1]
        for i in range(phrases.shape[1] - 2, -1, -1):
            alive = np.flatnonzero(high > low)
            if not len(alive):
                break
            symbol = phrases[alive, i]
            low[alive], high[alive] = self.step(symbol, low[alive]), self.step(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of index rows."""
        row, back = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_sampled[row])
        while len(walking):
            row[walking] = self.step(self.last[row[walking]], row[walking])
            back[walking] += 1
            walking = walking[~self.is_sampled[row[walking]]]
        return self.samples[self.sampled_before[row]] + back


class Phrases:
    """The distinct test phrases of a block of items, by length, and the items of each."""

    def __init__(self, items: pa.Table, size: int):
        w = words(*flat(items.column("text")), NON_ALNUM, lower=True)
        hashes = w.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        ids = np.array([str(x) for x in items.column("item_id").to_pylist()], object)
        found: dict[int, dict[tuple, set]] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            length = min(size, b - a)
            for at in range(a, b - length + 1 if length else a):
                found.setdefault(length, {}).setdefault(tuple(symbols[at : at + length].tolist()), set()).add(ids[i])
        self.by_length = [(n, np.array(list(p), np.int64), [sorted(x) for x in p.values()]) for n, p in sorted(found.items())]
        self.shortest = min(found, default=0)

    def occurrences(self, w, hashes: np.ndarray):
        """First word, length and items of each place where a phrase occurs in the words of a shard."""
        if not self.shortest or not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        breaks = np.zeros(len(hashes) + 1, bool)
        breaks[w.first] = True
        starts = np.flatnonzero(known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long_enough = ends - starts >= self.shortest
        starts, ends = starts[long_enough], ends[long_enough]
        if not len(starts):
            return
        sizes = ends - starts + 1
        stops = np.cumsum(sizes)
        place = np.arange(stops[-1]) + np.repeat(starts - (stops - sizes), sizes)
        symbols = np.zeros(stops[-1], np.int64)
        inner = np.ones(stops[-1], bool)
        inner[stops - 1] = False
        symbols[inner] = at[place[inner]] + 1
        index = FmIndex(symbols, len(self.vocabulary))
        for length, phrases, items in self.by_length:
            low, high = index.search(phrases)
            times = np.maximum(high - low, 0)
            hit = np.flatnonzero(times)
            if not len(hit):
                continue
            total = np.cumsum(times[hit])
            rows = np.arange(total[-1]) + np.repeat(low[hit] - (total - times[hit]), times[hit])
            for word, phrase in zip(place[index.locate(rows)].tolist(), np.repeat(hit, times[hit]).tolist(), strict=True):
                yield word, length, items[phrase]


_FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string()), "clean_text": pa.string()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(w, first: int, spans: list[tuple[int, int]], low: int, high: int) -> str:
    """A text's bytes from low to high, without the words of the spans and what lies between them."""
    parts, at = [], low
    for a, b in spans:
        parts.append(w[0][at : w[1].starts[first + a]].tobytes())
        at = w[1].ends[first + b - 1]
    return b"".join([*parts, w[0][at:high].tobytes()]).decode()


def _search(batches, phrases: Phrases, text: str, names: list[str], cut: bool):
    for batch in slices(batches, text):
        data, offsets = flat(batch.column(text))
        w = words(data, offsets, NON_ALNUM, lower=True)
        spans: dict[int, set] = {}
        items: dict[int, set] = {}
        if "spans" in batch.schema.names:
            for i, (s, x) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                if s:
                    spans[i], items[i] = {(y["start"], y["end"]) for y in s}, set(x)
        for word, length, ids in phrases.occurrences(w, w.hashes()):
            row = int(np.searchsorted(w.first, word, side="right")) - 1
            start = word - int(w.first[row])
            spans.setdefault(row, set()).add((start, start + length))
            items.setdefault(row, set()).update(ids)
        n = batch.num_rows
        whole = {i: merged(list(s)) for i, s in spans.items()}
        found = {
            "n_words": pa.array(w.counts.astype(np.int64)),
            "n_hit": pa.array([sum(b - a for a, b in whole.get(i, ())) for i in range(n)], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in whole.get(i, ())] for i in range(n)], _FOUND["spans"]),
            "items": pa.array([sorted(items.get(i, ())) for i in range(n)], _FOUND["items"]),
        }
        if cut:
            given = batch.column(text)
            found["clean_text"] = pa.array([_without((data, w), int(w.first[i]), whole[i], offsets[i], offsets[i + 1]) if i in whole else given[i].as_py() for i in range(n)], pa.string())
        yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in names], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", cut: bool = True) -> DataFrame:
    """Adds n_words, n_hit (long), spans (merged word ranges), items (ids as strings, sorted) and,
    with `cut`, clean_text: the text without its spans.

    Null and empty texts have no words and no hits (clean_text is the text as it was); a null
    item text has no phrase; a null item_id counts as the string None.  Repeated items and rows
    give repeated phrases and rows.  An empty benchmark hits nothing.  Input columns with the
    names of output columns are replaced.
    """
    added = [c for c in _FOUND if c != "clean_text" or cut]
    docs = docs.drop(*_FOUND)
    benchmark = benchmark.select("item_id", "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    context = docs.sparkSession.sparkContext
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kinds = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"
    for i in range(blocks):
        items = benchmark.filter(block == i).toArrow()
        phrases = context.broadcast(Phrases(items, size))
        last = cut and i == blocks - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _FOUND]
        schema = ", ".join([*fields, kinds, *["clean_text string"] * last])
        names = [f.name for f in docs.schema.fields if f.name not in _FOUND] + [c for c in added if c != "clean_text" or last]
        docs = docs.mapInArrow(lambda batches, p=phrases, names=names, last=last: _search(batches, p.value, text, names, last), schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, cut=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
