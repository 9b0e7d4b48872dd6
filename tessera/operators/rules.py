"""Constraint rules: each gives issue rows, and issue rows add up to a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "info")


def issues(rows: DataFrame, severity: str, code: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), key.cast("string").alias("entity_key"), detail.cast("string").alias("detail"))


def dangling(rows: DataFrame, key: str, reference: str, targets: DataFrame, target: str, code: str, severity: str = "error") -> DataFrame:
    """References that name no target."""
    known = targets.select(F.col(target).alias(reference)).distinct()
    lost = rows.filter(F.col(reference).isNotNull()).join(known, reference, "left_anti")
    return issues(lost, severity, code, F.col(key), F.col(reference))


def repeated(rows: DataFrame, keys: list[str], code: str, severity: str = "error") -> DataFrame:
    """Keys that occur more than once."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return issues(found, severity, code, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def violating(rows: DataFrame, key: str, holds: Column, code: str, detail: Column, severity: str = "warning") -> DataFrame:
    """Rows for which a condition is known not to hold."""
    return issues(rows.filter(~holds), severity, code, F.col(key), detail)


def gaps(rows: DataFrame, keys: list[str], number: str, code: str, first: int = 0) -> DataFrame:
    """Groups whose numbers are not first, first + 1, ... each once: by counts and extremes, without a window."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("low"), F.max(number).alias("high"))
    broken = found.filter((F.col("n") != F.col("d")) | (F.col("low") != first) | (F.col("high") != F.col("n") + (first - 1)))
    return issues(broken, "error", code, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.concat_ws("/", "n", "low", "high"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def report(found: DataFrame) -> DataFrame:
    """Counts by severity and code, with the rank of the severity and whether anything blocks."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    return found.groupBy("severity", "code").agg(F.count("*").alias("n_issues"), F.min("entity_key").alias("first_key")).withColumn("rank", rank).withColumn("blocks", F.col("severity") == "error")
