"""Language identification with bit-sliced Bloom filters of n-grams.

An n-gram is four consecutive bytes of the lower-cased text (Latin-1) whose ASCII non-letters
are spaces, with no space inside.  Their counts by language cover all learning documents.
A language's filter holds the n-grams that make up at least `least_share` of its text and are
there at least `least_ratio` times as frequent as where they are most frequent.

The filters lie side by side: slot i is a bitmask of the languages whose filter has bit i
set, so the AND of an n-gram's slots is the set of all languages that contain it.  A text's
popcount of each language, less what its false-positive rate explains, decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import LOWER, U64, flat, lower_latin, mix, slices

UNDETERMINED = "und"
PROBES = 3
SLOTS_PER_NGRAM = 16
_CLEAN = LOWER.copy()
_CLEAN[:0x41] = 0x20
_CLEAN[0x5B:0x61] = 0x20
_CLEAN[0x7B:0x80] = 0x20


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each n-gram, in order."""
    rows = len(offsets) - 1
    padded = np.insert(_CLEAN[lower_latin(data)], offsets, 0x20)
    inside = padded != 0x20
    at = np.flatnonzero(inside[1:-2] & inside[2:-1]) if len(padded) > 3 else np.zeros(0, np.int64)
    p = padded.astype(np.uint32)
    values = p[at] | p[at + 1] << np.uint32(8) | p[at + 2] << np.uint32(16) | p[at + 3] << np.uint32(24)
    return np.searchsorted(offsets + np.arange(rows + 1), at, side="right") - 1, values


def _counted(batches, languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}
    kept: list[list[tuple]] = [[] for _ in languages]

    def merge(i: int) -> None:
        values = np.concatenate([v for v, _ in kept[i]])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([c for _, c in kept[i]])[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        kept[i] = [(values[first], np.add.reduceat(counts, first))]

    for batch in slices(batches, "text"):
        rows, values = ngrams(*flat(batch.column("text")))
        of_row = np.array([number[x] for x in batch.column("lang").to_pylist()])
        language = of_row[rows]
        for i in range(len(languages)):
            found = values[language == i]
            if len(found):
                kept[i].append(np.unique(found, return_counts=True))
                if len(kept[i]) > 16:
                    merge(i)
    for i in range(len(languages)):
        if kept[i]:
            merge(i)
            values, counts = kept[i][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values.astype(np.int64)), pa.array(counts)], ["language", "ngram", "times"])


class LanguageFilters:
    """The bit-sliced filters of some languages."""

    def __init__(self, languages: list[str], language: np.ndarray, ngram: np.ndarray):
        self.languages = languages
        most = int(np.bincount(language, minlength=1).max(initial=1))
        self.bits = max(10, int(most * SLOTS_PER_NGRAM - 1).bit_length())
        self.masks = np.zeros((-(-len(languages) // 64), 1 << self.bits), U64)
        slots = self._slots(ngram)
        for i in range(len(languages)):
            own = slots[:, language == i].ravel()
            self.masks[i // 64, own] |= U64(1 << (i % 64))
        fill = [np.count_nonzero(self.masks[i // 64] >> U64(i % 64) & U64(1)) / (1 << self.bits) for i in range(len(languages))]
        self.false_rate = np.array(fill) ** PROBES

    def _slots(self, ngram: np.ndarray) -> np.ndarray:
        h = mix(ngram.astype(U64))
        return np.stack([(h >> U64(21 * k)).astype(np.int64) & ((1 << self.bits) - 1) for k in range(PROBES)])

    def popcounts(self, ngram: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Texts by languages: n-grams that the language's filter contains."""
        out = np.zeros((n_rows, len(self.languages)))
        edges = np.searchsorted(rows, np.arange(n_rows + 1))
        slots = self._slots(ngram)
        for word, masks in enumerate(self.masks):
            found = masks[slots[0]]
            for s in slots[1:]:
                found &= masks[s]
            for i in range(word * 64, min(word * 64 + 64, len(self.languages))):
                sums = np.concatenate([[0], np.cumsum((found >> U64(i % 64)).astype(np.uint8) & 1, dtype=np.int64)])
                out[:, i] = sums[edges[1:]] - sums[edges[:-1]]
        return out

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of texts; language 0 with score 0 where no filter knows an n-gram."""
        rows, ngram = ngrams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(rows, minlength=n)[:, None]
        true = np.maximum(0, (self.popcounts(ngram, rows, n) - total * self.false_rate) / (1 - self.false_rate))
        best = true.argmax(1)
        everything = true.sum(1)
        return best, np.where(everything > 0, true[np.arange(n), best] / np.maximum(everything, 1e-9), 0.0)


def learn(labelled: DataFrame, least_share: float = 2e-5, least_ratio: float = 0.25) -> LanguageFilters | None:
    """Filters of the languages in lang (null: not used), from all rows of text and lang; most frequent language first.

    A language has at most 1 / least_share n-grams, so what reaches the driver is bounded."""
    labelled = labelled.filter("lang IS NOT NULL").select("lang", "text")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r.lang for r in sizes]
    if not languages:
        return None
    counts = labelled.mapInArrow(lambda b: _counted(b, languages), "language int, ngram long, times long").groupBy("language", "ngram").agg(F.sum("times").alias("times"))
    totals = counts.groupBy("language").agg(F.sum("times").alias("all"))
    shares = counts.join(F.broadcast(totals), "language").withColumn("share", F.col("times") / F.col("all"))
    most = F.max("share").over(Window.partitionBy("ngram"))
    chosen = shares.withColumn("most", most).filter((F.col("share") >= least_share) & (F.col("share") >= least_ratio * F.col("most"))).select("language", "ngram").toPandas()
    return LanguageFilters(languages, chosen.language.to_numpy(), chosen.ngram.to_numpy())


def identify(docs: DataFrame, filters: LanguageFilters | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1).

    Null texts, and texts without a letter, are `und` with score 0, as is all text if nothing was
    learned.  Texts of letters that no filter knows get the most frequent language, score 0;
    ties go to the more frequent one.  Repeated rows get equal answers, empty tables stay empty,
    and input columns named as the added ones are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def decided(texts: pa.Array) -> pa.Array:
        filters, names, scores = sent.value, [], []
        for batch in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
            data, offsets = flat(batch.column("text"))
            letters = np.concatenate([[0], np.cumsum((LOWER[data] >= 0x61) & (data < 0x7B))])
            plain = letters[offsets[1:]] > letters[offsets[:-1]]
            best, score = filters.decide(data, offsets) if filters else (np.zeros(len(plain), int), np.zeros(len(plain)))
            for i, known in enumerate(plain):
                known = filters is not None and (known or any(c.isalpha() for c in batch.column("text")[i].as_py() or ""))
                names.append(filters.languages[best[i]] if known else UNDETERMINED)
                scores.append(float(score[i]) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = docs.drop("lang_pred", "score").withColumn("__found", decided(F.col(text)))
    return found.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "__found.lang_pred", "__found.score")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    filters = learn(docs.filter("NOT held_out"))
    return identify(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score")
