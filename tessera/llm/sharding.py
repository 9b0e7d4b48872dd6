"""Sharding by rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

A key draws a number in (0, 1) for each shard from the digest of key and shard, and goes to the
shard with the greatest weight / -ln(draw).  Neither other keys nor the number of shards change a
draw, so a further shard takes records from all others and moves nothing else, and a shard
that grows in weight only gains.  The law is called `key`: equal keys are in one shard.

`assign` also numbers the records of each shard from 0 without gaps.  They follow a digest of
the record, which spreads evenly whatever the keys are: equal records become one row with their
number before anything is shuffled, that row is cut into chunks with digests of their own, and
ranges of the digest are numbered apart and put one after the other.  No task sees a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint

LAW = "key"
#: Digits of a draw: the middle of one of 2^52 parts, which a double holds exactly.
DIGITS = 13


def _bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _preference(key: Column, shard: int, weight: float) -> Column:
    draw = (_bits(F.concat(key, F.lit(f"/{shard}")), DIGITS).cast("double") + 0.5) / float(16**DIGITS)
    return F.lit(float(weight)) / -F.log(draw)


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """A struct of the greatest preference and, negated, the shard that has it; the first of a tie. A null key is an empty one."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_max(F.array(*[F.struct(_preference(text, i, w).alias("preference"), F.lit(-i).alias("negated")) for i, w in enumerate(weights)]))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, from 0; no other row has a say in it."""
    return -best_shard(key, weights)["negated"]


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, added: float = 1.0, chunk: int = 10_000, range_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard with one more of weight `added`) of each row.

    size: UTF-8 bytes of text plus 1; a null text has none, so its size is 1 and its checksum 0, as of an
    empty one.  A null doc_id is an empty key: such rows share a shard.  Repeated rows each have a slot.
    Other columns are left out.  An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    several = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(n - 1) div {chunk}")), lambda i: F.least(F.lit(chunk).cast("long"), F.col("n") - i * chunk))
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "piece")
    chosen = several.withColumn("best", best_shard(F.col("doc_id"), weights)).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    grown = F.when(_preference(F.col("key"), len(weights), added) > F.col("best.preference"), len(weights)).otherwise(-F.col("best.negated"))
    chosen = chosen.select("doc_id", "size", "text_crc32", (-F.col("best.negated")).alias("shard"), grown.alias("grown_shard"), F.posexplode(pieces).alias("piece", "rows"))
    placed = checkpoint(chosen.withColumn("at", _bits(name, 15)))
    ranges = max(1, placed.count() // range_rows)
    placed = placed.withColumn("range", F.shiftright(F.shiftright("at", 28) * F.lit(ranges).cast("long"), 32))
    in_shard = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    in_range = Window.partitionBy("shard", "range").orderBy("at", "doc_id", "size", "text_crc32", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "range").agg(F.sum("rows").alias("rows")).select("shard", "range", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("start"))
    numbered = placed.withColumn("before", F.coalesce(F.sum("rows").over(in_range), F.lit(0))).join(starts, ["shard", "range"])
    slot = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.col("start") + F.col("before") + i))
    return numbered.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, weights: Sequence[float], files: int = 1) -> None:
    """Writes the rows of docs as Parquet, a folder shard=i for each shard, in about `files` files each.

    A shard's rows are dealt over its files by their content; of equal rows, however many, a file is as long as they are."""
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), weights))
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    placed.repartition(len(weights) * files, "shard", part).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum is CRC-32 with the polynomial EDB88320, byte by byte.
ORACLE = r"""
WITH steps AS (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b))
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS BIGINT) AS text_crc32, coalesce(CAST(doc_id AS VARCHAR), '') AS key
  FROM documents, steps
), p AS (
  SELECT key, i, -1.0 / ln((CAST('0x' || substr(md5(key || '/' || i), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496.0) AS preference
  FROM (SELECT DISTINCT key FROM d), (SELECT unnest(range(17)) AS i)
), s AS (
  SELECT key, arg_max(i, preference) FILTER (WHERE i < 16) AS shard, arg_max(i, preference) AS grown_shard FROM p GROUP BY key
), c AS (
  SELECT doc_id, size, text_crc32, key, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 10000 AS piece FROM d
), a AS (
  SELECT *, CAST('0x' || substr(md5(key || '/' || size || '/' || text_crc32 || '/' || piece), 1, 15) AS BIGINT) AS place FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32, piece) - 1 AS BIGINT) AS slot
FROM a JOIN s USING (key)
"""
