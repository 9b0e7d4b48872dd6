"""A corpus pipeline of five training-data operators, each stage reading what the one before it wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate as decontamination
from tessera.llm import jaccard_join, language_id, mixing
from tessera.llm.lineage import checkpoint, remove, shared_folder
from tessera.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language has a smaller share of what the filters know is in none of them.
LEAST_LANGUAGE_SCORE = 0.3
#: As many doc_ids are broadcast at most (1 MB).
MOST_BROADCAST = 100_000


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another column as text."""
    changed = docs.drop("text").withColumnRenamed(text, "text")
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; those without letters, or near no language, go."""
    filters = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.select(*COLUMNS), filters)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group (five words, a similarity of 0.8); texts without words are alone.

    Rows with the same doc_id and text become one; different texts of one doc_id, which are one document, stay."""
    docs = docs.select(*COLUMNS)
    groups = jaccard_join.jaccard_components(docs, 8, 10, partial(jaccard_join.shingle_sets, size=5))
    seen = checkpoint(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("first")))
    again = seen.filter("n > 1 AND first = doc_id").select("doc_id")
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    single = docs.filter("doc_id IS NOT NULL").join(seen.filter("n > 1 OR first <> doc_id"), "doc_id", "left_anti")
    repeated = docs.join(again, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 35 words and more that occur more than once; texts that lose all words go."""
    cut = remove_repeats(docs.select(*COLUMNS), window=35)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    kept = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("kept_text", text)
    return _with_text(kept, "kept_text")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out ten-word passages of the benchmark; texts that are nothing else go."""
    found = decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return _with_text(found.filter("n_hit = 0 OR n_hit < n_words"), "clean_text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of documents that the mix takes, in training order, with what it takes of each."""
    return mixing.training_order(mixing.mix(docs.select(*COLUMNS)))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", benchmark_passages),
    ("mixing", mixture),
]

#: Not expressible: the language filters are Bloom filters.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again, and its input goes."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
