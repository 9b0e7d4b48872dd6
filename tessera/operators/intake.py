"""Intake rules for drafts: slot numbers, exactly-one constraints and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permutation(rows: DataFrame, group: str, number: str) -> DataFrame:
    """group -> n_slots and whether its numbers are 1..n, each once."""
    found = rows.groupBy(group).agg(F.count("*").alias("n_slots"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    holds = (F.col("d") == F.col("n_slots")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n_slots"))
    return found.select(group, "n_slots", F.coalesce(holds, F.lit(False)).alias("is_permutation"))


def exactly(rows: DataFrame, group: str, condition: Column, n: int = 1) -> DataFrame:
    """group -> how many rows meet the condition, and whether they are n."""
    return rows.groupBy(group).agg(F.count_if(condition).alias("n_met")).withColumn("holds", F.col("n_met") == n)


def exact_decimal(text: Column, digits: int = 9) -> Column:
    """A decimal of at most `digits` fraction digits that text spells exactly; null otherwise."""
    fits = F.trim(text).rlike(rf"^-?[0-9]{{1,16}}(\.[0-9]{{1,{digits}}})?$")
    return F.when(fits, F.trim(text).cast(f"decimal(25,{digits})"))
