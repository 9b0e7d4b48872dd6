"""Token counts of a SentencePiece BPE model by map-side two-tier lookup.

No piece of such a model holds the space mark anywhere but at its start, or a line break, so
no merge crosses from one pre-token (spaces and the characters up to the next space or line
break, or a line break and what follows) into the next, and a text has as many tokens as its
pre-tokens together.  `check_pieces` proves this for a given model; without it, texts are
encoded whole.

Tier one is a table of the lengths of frequent pre-tokens, made from a bounded sample of the
rows and broadcast as one string and one small array; it changes the speed, never a count.
Tier two is each Python worker's cache of what it had to encode, kept from task to task and
emptied at `CACHE_ENTRIES`.  No text is shuffled, and of pre-tokens only those of the sample.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose pre-tokens make the table, on average, and the entries it may have at most.
SAMPLE_ROWS, TABLE_ENTRIES = 2000, 50_000
CACHE_ENTRIES = 400_000
LONGEST_KEPT = 64
PRE_TOKEN = r" +[^ \n]*|\n[^ \n]*"
MARK = "▁"

_find = re.compile(PRE_TOKEN).findall


def check_pieces(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether pre-tokens can be counted one by one."""
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not model.is_byte(i)]
    plain = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces)
    return plain and model.encode("a  b ", out_type=str)[0].startswith(MARK) and "".join(model.encode(" a  b ", out_type=str)) == MARK * 2 + "a" + MARK * 2 + "b" + MARK


class Lengths(dict):
    """Pre-token -> tokens; what is missing is encoded and kept."""

    def __init__(self, proto: bytes, joined: str = "", lengths: np.ndarray | None = None):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.separable = check_pieces(self.model)
        self.frequent = dict(zip(joined.split("\0"), lengths.tolist(), strict=True)) if joined else {}
        super().__init__(self.frequent)

    def measure(self, pre_token: str) -> int:
        if pre_token[0] == "\n":
            return len(self.model.encode(pre_token)) - 1  # without the mark put before a text
        return len(self.model.encode(pre_token[1:])) if len(pre_token) > 1 else 1

    def __missing__(self, pre_token: str) -> int:
        n = self.measure(pre_token)
        if len(pre_token) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text))
        return sum(map(self.__getitem__, _find(" " + text.replace(MARK, " "))))


_of_worker: dict[str, Lengths] = {}


def frequent_pre_tokens(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent pre-tokens of a sample of about `rows` rows, `entries` at most."""
    n = docs.count()
    taken = docs.select(text).sample(fraction=min(1.0, rows / max(n, 1)), seed=1)
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.replace(F.col(text), F.lit(MARK), F.lit(" "))), F.lit(PRE_TOKEN), F.lit(0))
    counts = taken.select(F.explode(found).alias("p")).filter((F.length("p") <= LONGEST_KEPT) & ~F.contains("p", F.lit("\0"))).groupBy("p").count()
    return [r.p for r in counts.orderBy(F.desc("count"), "p").limit(entries).select("p").collect()]


def count_tokens(docs: DataFrame, proto: bytes, text: str = "text", added: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text, without begin, end or added special tokens.

    Nulls and empty texts have none.  Repeated rows are counted alike; an empty table stays
    empty; an input column named as the added one is replaced.
    """
    lengths = Lengths(proto)
    table = frequent_pre_tokens(docs, text) if lengths.separable else []
    counts = np.array([lengths.measure(p) for p in table], np.uint16)
    joined = "\0".join(table)
    sent = docs.sparkSession.sparkContext.broadcast((proto, joined, counts))
    made_of = hashlib.sha256(proto + joined.encode()).hexdigest()

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if made_of not in _of_worker:
            _of_worker.clear()
            _of_worker[made_of] = Lengths(*sent.value)
        of = _of_worker[made_of].of
        for series in texts:
            yield pd.Series([of(t) for t in series], dtype="int64")

    return docs.withColumn(added, tokens(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, proto)
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
