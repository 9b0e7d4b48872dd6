"""Toxicity by noisy-channel deobfuscation and scoring of the restored text.

A word that may be disguised (letters with digits or symbols at any place, a letter three times
over, separators inside, single letters set apart by blanks; of any length) spans a lattice:
each symbol may stand for some letters, a run may be one letter or two, a separator or a blank
nothing or a word break, each at a channel cost.  Viterbi decoding under a character trigram
model of the corpus picks the likeliest reading, which replaces the word; a worker keeps what it
has decoded.

The restored text is scored by its words and word beginnings.  Those that a bounded sample of
labelled rows singles out carry a weight; a logistic model takes the greatest weight, the
number of such words and their share.  It is fitted crosswise: each half of the sample is
weighed by what the other half singles out, and its intercept puts the threshold where it
parts these rows best.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import BLANKS, BYTE_VALUES, LOWER, NON_LETTERS, U64, Words, byte_table, flat, lower_latin, mix, slices, word_powers, words
from .lineage import checkpoint

# Letters that a digit or symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*"
#: Channel symbols that are punctuation at the start or the end of a word as well.
OPENING, CLOSING = "(", "!"
SPACED_LETTERS = 4
GAPS = re.compile(r"([\x20\x09-\x0D]+)")
#: Channel costs, natural logarithms: a symbol read as a letter, as itself, dropped; a run read as one letter or two.
SWAPPED, KEPT, DROPPED, RUN_AS_ONE, RUN_AS_TWO, PAIR_AS_ONE = -1.0, -4.0, -3.0, -0.5, -1.0, -2.0

#: Rows of labels that learning uses at most, taken in the order of a hash of doc_id.
LABELLED_ROWS = 20_000
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
PREFIXES = (4, 5, 6, 7, 8, 9)
THRESHOLD = 0.7

_LETTER = byte_table((0x61, 0x7A))
_SYMBOL = byte_table(*((ord(c), ord(c)) for c in LEET if ord(c) < 128))
_SEPARATOR = byte_table(*((ord(c), ord(c)) for c in SEPARATORS))
SYMBOLS = 28  # blank or anything else in ASCII, a-z, beyond ASCII


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0


def _trigrams(batches):
    table = np.zeros(SYMBOLS**3, np.int64)
    code = np.full(256, 27, np.int64)
    code[0x61:0x7B] = np.arange(1, 27)
    code[NON_LETTERS] = 0
    for batch in slices(batches, "text"):
        data, offsets = flat(batch.column("text"))
        s = code[np.insert(LOWER[data], offsets, 0x20)]
        if len(s) > 2:
            table += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    found = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(table[found])], ["trigram", "times"])


class CharacterModel:
    """Log probabilities of a symbol after two others, smoothed with those after one."""

    def __init__(self, trigram: np.ndarray, times: np.ndarray):
        counts = np.zeros(SYMBOLS**3)
        counts[trigram] = times
        counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = counts.sum(0) + 0.5
        two /= two.sum(1, keepdims=True)
        three = counts + 2 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True)).tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the readings and what they cost."""
    out, i = [], 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        c, n = word[i], j - i
        i = j
        if c not in LEET and not c.isalpha():
            out.append([("", 0.0 if c in SEPARATORS else DROPPED), (c * n, 0.0)])
            continue
        single = [(x, SWAPPED) for x in LEET[c]] if c in LEET else [(c, 0.0)]
        if n == 1:
            out.append(single)
        elif n == 2:
            out.append([(x * 2, cost) for x, cost in single] + [(x, cost + PAIR_AS_ONE) for x, cost in single])
        else:
            out.append([(x, cost + RUN_AS_ONE) for x, cost in single] + [(x * 2, cost + RUN_AS_TWO) for x, cost in single])
        if c in LEET:
            out[-1].append((c * n, KEPT))
    return out


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The same of single letters with blanks between, where each gap may be a word break; one wider than others hardly is none."""
    parts = GAPS.split(run)
    least = min(map(len, parts[1::2]))
    out = []
    for i, part in enumerate(parts):
        out += [[("", 0.0 if len(part) == least else DROPPED), (" ", 0.0)]] if i % 2 else lattice(part)
    return out


def likeliest(steps: list[list[tuple[str, float]]], log: list) -> tuple[float, str]:
    """Score and text of the best way through a lattice (Viterbi over the last two symbols), in time linear in its length."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in steps:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, way) in best.items():
            for letters, cost in readings:
                x, y, total = a, b, score + cost
                for c in letters:
                    s = _symbol(c)
                    total += log[x][y][s]
                    x, y = y, s
                if total > after.get((x, y), (-math.inf,))[0]:
                    after[(x, y)] = (total, (way, letters) if letters else way)
        best = after
    ends = [(score + log[a][b][0], way) for (a, b), (score, way) in best.items()]
    top, texts = max(score for score, _ in ends), []
    for score, way in ends:
        if score == top:
            parts = []
            while way is not None:
                way, letters = way
                parts.append(letters)
            texts.append("".join(reversed(parts)))
    return top, max(texts)


def decode(word: str, log: list) -> str:
    """The likeliest reading of a disguised word."""
    return likeliest(lattice(word), log)[1]


class Restorer:
    """Disguised words -> readings, kept up to a number of entries and of bytes."""

    def __init__(self, model: CharacterModel, entries: int = 200_000, most_bytes: int = 16 << 20):
        self.log, self.entries, self.most_bytes, self.known, self.bytes = model.log, entries, most_bytes, {}, 0

    def __call__(self, raw: bytes) -> bytes:
        if raw not in self.known:
            if len(self.known) >= self.entries or self.bytes > self.most_bytes:
                self.known.clear()
                self.bytes = 0
            self.known[raw] = self._read(raw.decode())
            self.bytes += len(raw) + len(self.known[raw])
        return self.known[raw]

    def _read(self, word: str) -> bytes:
        if not any(c.isalpha() for c in word):
            return word.encode()
        if GAPS.search(word):
            return likeliest(spaced_lattice(word), self.log)[1].encode()

        def bounds(opening: str, closing: str) -> tuple[int, int]:
            """The word without what is punctuation at its edges."""
            low, high = 0, len(word)
            while low < high and not (word[low].isalpha() or word[low] in LEET and word[low] not in opening):
                low += 1
            while high > low and not (word[high - 1].isalpha() or word[high - 1] in LEET and word[high - 1] not in closing):
                high -= 1
            return low, high

        best = None
        for low, high in sorted({bounds(x, y) for x in ("", OPENING) for y in ("", CLOSING)}):
            score, text = likeliest(lattice(word[low:high]), self.log)
            best = max(best or (-math.inf,), (score, word[:low] + text + word[high:]))
        return best[1].encode()

    def restore(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts in lower case (Latin-1) with disguised words as read."""
        w = words(lower_latin(data), offsets, BLANKS)
        d = w.data
        n = len(d)
        if n < 3:
            return d, offsets
        letter, symbol, parted = _LETTER[d], _SYMBOL[d], _SEPARATOR[d]
        beyond = d > 127
        odd = symbol.copy()
        odd[:-1] |= (d[:-1] == 0xC2) & (d[1:] == 0xA3)  # pound
        odd[:-2] |= (d[:-2] == 0xE2) & (d[1:-1] == 0x82) & (d[2:] == 0xAC)  # euro
        odd[:-2] |= letter[:-2] & (d[:-2] == d[1:-1]) & (d[1:-1] == d[2:])
        odd[1:-1] |= parted[1:-1] & ~BLANKS[d[:-2]] & (letter | beyond)[2:]
        sizes = w.ends - w.starts

        def some(of: np.ndarray) -> np.ndarray:
            before = np.concatenate([[0], np.cumsum(of)])
            return before[w.ends] > before[w.starts]

        flagged = some(odd) & some(letter | beyond) & (sizes > 1)
        single = (sizes == 1) & (letter[w.starts] | symbol[w.starts])
        edits = [(int(w.starts[i]), int(w.ends[i])) for i in np.flatnonzero(flagged)]
        edits += self._spaced(w, single)
        if not edits:
            return d, offsets
        edits.sort()
        raw, parts, at, moved = d.tobytes(), [], 0, []
        for start, stop in edits:
            new = self(raw[start:stop])
            parts += [raw[at:start], new]
            moved.append((stop, len(new) - (stop - start)))
            at = stop
        parts.append(raw[at:])
        shift = np.concatenate([[0], np.cumsum([x for _, x in moved])])
        return np.frombuffer(b"".join(parts), np.uint8), offsets + shift[np.searchsorted([x for x, _ in moved], offsets, side="right")]

    def _spaced(self, w: Words, single: np.ndarray) -> list[tuple[int, int]]:
        """Runs of single letters with blanks between: from and to."""
        inner = np.zeros(len(single) + 1, bool)
        inner[: len(single)] = single
        breaks = np.zeros(len(single) + 1, bool)
        breaks[w.first] = True
        begin = np.flatnonzero(inner[:-1] & (breaks[:-1] | ~np.concatenate([[False], inner[:-2]])))
        end = np.flatnonzero(inner[:-1] & (breaks[1:] | ~inner[1:])) + 1
        long = np.flatnonzero(end - begin >= SPACED_LETTERS)
        return [(int(w.starts[begin[i]]), int(w.ends[end[i] - 1])) for i in long]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of restored texts; a hash for each word and for each of its PREFIXES (0: word too short)."""
    w = words(data, offsets, NON_LETTERS)
    n = len(w.starts)
    out = np.zeros((1 + len(PREFIXES), n), U64)
    if n:
        out[0] = w.hashes()
        up, down = word_powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=sums[1:])
        for k, size in enumerate(PREFIXES):
            long = np.flatnonzero(w.ends - w.starts > size)
            s = w.starts[long]
            out[k + 1, long] = mix((sums[s + size] - sums[s]) * down[s] + U64(0xABCD00 + size))
    return w, out


def _pairs(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature, each once a row."""
    rows = np.tile(w.rows, len(hashes))
    flat_hashes = hashes.ravel()
    keep = flat_hashes != 0
    order = np.lexsort((flat_hashes[keep], rows[keep]))
    r, h = rows[keep][order], flat_hashes[keep][order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def _document_counts(batches, model: CharacterModel, among: np.ndarray | None):
    restore = Restorer(model).restore
    for batch in slices(batches, "text"):
        rows, h = _pairs(*features(*restore(*flat(batch.column("text")))))
        halves = batch.column("half").to_numpy()[rows]
        for half in (0, 1):
            mine = h[halves == half]
            if among is not None:
                mine = mine[np.isin(mine, among)]
            values, counts = np.unique(mine, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), half, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["half", "feature", "docs"])


class Weights:
    """Weights of features, and what they make of a text."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray):
        order = np.argsort(feature.view(U64))
        self.feature, self.weight = feature.view(U64)[order], weight[order]

    def inputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Greatest weight, log number of weighty words and of those in a thousand, for each restored text."""
        w, hashes = features(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, 3))
        if not len(self.feature) or not len(w.starts):
            return out
        best = np.zeros(len(w.starts))
        for h in hashes:
            at = np.minimum(np.searchsorted(self.feature, h), len(self.feature) - 1)
            np.maximum(best, np.where(self.feature[at] == h, self.weight[at], 0.0), out=best)
        hits = np.flatnonzero(best)
        rows = w.rows[hits]
        np.maximum.at(out[:, 0], rows, best[hits])
        many = np.bincount(rows, minlength=n)
        out[:, 1] = np.log1p(many)
        out[:, 2] = np.log1p(1000 * many / np.maximum(w.counts, 1))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the last one is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def parting(logits: np.ndarray, toxic: np.ndarray) -> float:
    """Where a cut leaves the fewest rows on the wrong side, in the middle of the widest such gap; the threshold's own place without rows of both kinds."""
    place = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if not 0 < toxic.sum() < len(toxic):
        return place
    order = np.argsort(logits, kind="stable")
    at, kind = logits[order], toxic[order]
    wrong = np.cumsum(kind) + (1 - kind).sum() - np.cumsum(1 - kind)  # toxic ones below, clean ones above, of a cut after each row
    gap = np.append(np.diff(at), 0.0)
    if not (gap > 0).any():
        return place
    best = int(np.lexsort((-gap, np.where(gap > 0, wrong, np.inf)))[0])
    return float(at[best] + gap[best] / 2)


class Scorer:
    def __init__(self, model: CharacterModel, weights: Weights, coefficients: np.ndarray):
        self.model, self.weights, self.coefficients = model, weights, coefficients

    def score(self, restorer: Restorer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.weights.inputs(*restorer.restore(data, offsets))
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Scorer:
    """A scorer from the texts of all docs (characters) and at most `rows` rows of labels (doc_id, toxic).

    Rows of labels without a doc_id or toxic are not used; of several rows for one doc_id the
    greatest toxic counts.  Without labels of both kinds every text scores one half or near it.
    """
    spark = docs.sparkSession
    trigrams = docs.select("text").mapInArrow(_trigrams, "trigram long, times long").groupBy("trigram").agg(F.sum("times").alias("times")).toPandas()
    model = CharacterModel(trigrams.trigram.to_numpy(), trigrams.times.to_numpy())
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    sample = checkpoint(sample.dropDuplicates(["text"]))
    totals = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}

    def counts(part: DataFrame, among: np.ndarray | None) -> pd.DataFrame:
        found = part.select("text", "half").mapInArrow(lambda b: _document_counts(b, model, among), "half int, feature long, docs long")
        docs_of = found.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col("docs"))), F.lit(0)).alias(f"half{h}") for h in (0, 1)])
        return (docs_of.filter(F.col("half0") + F.col("half1") >= LEAST_DOCS) if among is None else docs_of).toPandas()

    toxic = counts(sample.filter("toxic"), None)
    clean = counts(sample.filter("NOT toxic"), np.sort(toxic.feature.to_numpy(np.int64).view(U64)))
    found = toxic.merge(clean, "left", on="feature", suffixes=("", "_clean")).fillna(0)

    def weights(halves: tuple[int, ...]) -> Weights:
        """From the counts of these halves."""
        of = [sum(totals.get((h, t), 0) for h in halves) for t in (True, False)]
        seen, clean = sum(found[f"half{h}"] for h in halves), sum(found[f"half{h}_clean"] for h in halves)
        weight = np.log((seen + 0.5) / (of[0] + 1)) - np.log((clean + 0.5) / (of[1] + 1))
        kept = ((seen >= (LEAST_DOCS * len(halves)) // 2) & (weight >= LEAST_WEIGHT)).to_numpy()
        return Weights(found.feature.to_numpy(np.int64)[kept], weight.to_numpy(float)[kept])

    other = {0: weights((1,)), 1: weights((0,))}

    def inputs(batches):
        restore = Restorer(model).restore
        for batch in slices(batches, "text"):
            data, offsets = restore(*flat(batch.column("text")))
            half = batch.column("half").to_numpy()[:, None]
            x = np.where(half == 0, other[0].inputs(data, offsets), other[1].inputs(data, offsets))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), batch.column("toxic")], ["a", "b", "c", "toxic"])

    fit = sample.select("text", "half", "toxic").mapInArrow(inputs, "a double, b double, c double, toxic boolean").toPandas()
    x, y = fit[["a", "b", "c"]].to_numpy(float), fit.toxic.to_numpy(float)
    coefficients = logistic(x, y) if len(fit) else np.zeros(4)
    # the threshold stands where it parts the sample best
    coefficients[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - parting(x @ coefficients[:-1] + coefficients[-1], y)
    return Scorer(model, weights((0, 1)), coefficients)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", added: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic. Nulls count as empty texts, which have a score too.

    Repeated rows get equal scores; an empty table stays empty; an input column of the added
    name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        restorer, out = Restorer(sent.value.model), []
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        for batch in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
            out.append(sent.value.score(restorer, *flat(batch.column("text"))))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn(added, scored(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    found = score(docs, scorer).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
