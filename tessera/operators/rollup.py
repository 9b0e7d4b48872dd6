"""Rollups by container hierarchy: counts, conditional counts and sorted distinct labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .project import row_numbers


def labels(value: Column, separator: str = " | ") -> Column:
    """An aggregate: distinct non-empty values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(value != "", value))), separator)


def level_counts(rows: DataFrame, keys: list[str], level: str, separator: str = ", ") -> DataFrame:
    """keys -> n_rows and `level:count` pairs by level. Counts come first, so one hot key is combined before it is joined up."""
    counts = rows.groupBy(*keys, level).agg(F.count("*").alias("n"))
    pair = F.concat_ws(":", F.col(level).cast("string"), F.col("n").cast("string"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(pair)), separator).alias("levels"))


def conditional_counts(rows: DataFrame, keys: list[str], conditions: dict[str, Column], *more: Column) -> DataFrame:
    """keys -> how many rows meet each condition, and further aggregates."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], *more)


def shards(rows: DataFrame, groups: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds shard (from 0): `size` rows each, in order within a group."""
    numbered = row_numbers(rows, groups, order, "__number")
    return numbered.withColumn("shard", F.floor((F.col("__number") - 1) / size).cast("long")).drop("__number")
