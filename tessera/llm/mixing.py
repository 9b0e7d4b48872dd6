"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Sources share `share` times all words in proportion to their weights; a target stops at
`cap` times its source's size, and what is left over is shared again by weight until no
target is above.  A source's weight changes over training time t in [0, 1] as
target * (1 + slope * (2t - 1)).  Its integral is the words the source has given by t; a
document whose words begin at offset o of its source is placed at the t that solves
integral(t) = o, and the mix is range-sorted by that position.

A source is read in the order of a hash of doc_id, up to `cap` times over, and stops at its
target, inside a document if need be.  Offsets are prefix sums in two steps: ranges of the
hash hold about `range_rows` rows of a source, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "position", "position_again")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source_key, source, source_size -> with rank (by code point, null last) and target.

    One row a source; the table of sources alone is sorted in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", left / open_weight)
        .withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    )
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)).select("source_key", "source_size", "rank", "target")


def _within(low: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(low, size))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, slopes: tuple[float, ...] = (0.5, 0.0, -0.5), range_rows: int = 300) -> DataFrame:
    """Adds size, source_size, target, taken, position and position_again (of a second reading).

    size counts words of text (null: 0).  A null source is a source.  A document of no words, or
    one the mix does not reach, takes 0 and has no position.  Rows with equal doc_id are read in
    the order of their size; equal rows may swap, which no column shows.  Input columns with
    names of output columns are replaced.  An empty table gives an empty table.
    """
    if share > cap or any(abs(s) >= 1 for s in slopes) or min(weights) <= 0:
        raise ValueError("share must be at most cap, weights above 0, slopes between -1 and 1")
    docs = docs.drop(*ADDED)
    n = docs.count()
    ranges = max(1, -(-n // range_rows))
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = (
        docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__key", key)
        .withColumn("__range", F.shiftright(F.shiftright(F.col("__key"), 36) * F.lit(ranges), 24))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    )
    parts = checkpoint(sized.groupBy("source_key", "source", "__range").agg(F.sum("size").alias("part")))
    sizes = parts.groupBy("source_key", "source").agg(F.sum("part").alias("source_size"))
    in_source = Window.partitionBy("source_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source_key", "__range", F.coalesce(F.sum("part").over(in_source), F.lit(0)).alias("__offset")).join(targets(sizes, weights, share, cap), "source_key")
    in_range = Window.partitionBy("source_key", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__before", F.coalesce(F.sum("size").over(in_range), F.lit(0))).join(offsets, ["source_key", "__range"])
    start = F.col("__offset") + F.col("__before")
    whole = F.round("target").cast("long")
    slope = F.element_at(F.array(*[F.lit(s) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))

    def at(words: Column) -> Column:
        y = words / F.col("target")
        return F.round(2 * y / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y)), 9)

    reads = [_within(whole - start - i * F.col("source_size"), F.col("size")) for i in range(cap)]
    taken = sum(reads[1:], reads[0])
    again = F.when(reads[1] > 0, at(start + F.col("source_size"))) if cap > 1 else F.lit(None).cast("double")
    return placed.select(*docs.columns, "size", "source_size", "target", taken.alias("taken"), F.when(reads[0] > 0, at(start)).alias("position"), again.alias("position_again"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each reading of what the mix takes, range-sorted by its position; doc_id and size break ties.

    Takes the rows of mix() of at most two readings.  Adds reading (1, 2) and words (how many the reading takes),
    position is that of the reading, and position_again goes.  Input columns with names of added ones are replaced."""
    first = F.least("taken", "size")
    reads = F.array(
        F.struct(F.lit(1).alias("reading"), F.col("position").alias("at"), first.alias("words")),
        F.struct(F.lit(2).alias("reading"), F.col("position_again").alias("at"), (F.col("taken") - first).alias("words")),
    )
    names = [c for c in mixed.columns if c not in ("position", "position_again", "reading", "words", "__read")]
    spread = mixed.select(*names, F.explode(reads).alias("__read")).filter("__read.words > 0")
    return spread.select(*names, "__read.reading", F.col("__read.at").alias("position"), "__read.words").orderBy("position", "doc_id", "size", "reading")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3.0, 1.0, 2.0][rank % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS most, CAST([0.5, 0.0, -0.5][rank % 3 + 1] AS DOUBLE) AS slope FROM s
), f AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN most / weight <= level THEN most ELSE weight * (SELECT min_by(level, most / weight) FROM f WHERE most / weight > level) END AS target FROM f
), c AS (
  SELECT d.doc_id, size, source_size, target, slope,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, greatest(0, least(CAST(round(target) AS BIGINT) - o, size)) AS r0, greatest(0, least(CAST(round(target) AS BIGINT) - o - source_size, size)) AS r1,
         o / target AS y0, (o + source_size) / target AS y1 FROM c
)
SELECT doc_id, size, source_size, target, CAST(r0 + r1 AS BIGINT) AS taken,
       CASE WHEN r0 > 0 THEN round(2 * y0 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y0)), 9) END AS position,
       CASE WHEN r1 > 0 THEN round(2 * y1 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y1)), 9) END AS position_again
FROM r
"""
