"""Projections for review: running order, and lanes of what needs a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

MISSING = 1_000_000_000


def ordered(rows: DataFrame, group: str, keys: list[Column], added: str = "running") -> DataFrame:
    """Numbers rows of a group from 1 by the keys; a missing or zero key comes last."""
    order = [F.when(F.coalesce(k, F.lit(0)) == 0, MISSING).otherwise(k) for k in keys[:-1]] + [keys[-1].asc_nulls_last()]
    return rows.withColumn(added, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def lanes(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """One row for each lane that a row belongs to, numbered by the lane's place in `tests`."""
    found = F.array(*[F.when(test, F.struct(F.lit(i).alias("lane_order"), F.lit(name).alias("lane"))) for i, (name, test) in enumerate(tests.items(), 1)])
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("l")).select(key, "l.lane_order", "l.lane")


def row_numbers(rows: DataFrame, groups: list[str], order: list[Column], added: str) -> DataFrame:
    """Numbers the rows of each group from 1 in order. Rows are dealt into ranges and numbered in each; the counts of the
    ranges before give where its numbers start, so no task sees a whole group."""
    dealt = kept(rows.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    starts = counts.select(*[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__at")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    own = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(starts, same).select(*rows.columns, (F.col("__before") + F.col("__own")).alias(added))


def numbered(rows: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """Numbers all rows from 1, kind after kind, in order within each."""
    return row_numbers(rows, [], [F.col(kind), *order], "number")


def placed(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Adds place: 1 for the first row of each group in order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def nested(rows: DataFrame, key: str, order: list[Column], columns: list[str], part_rows: int = 1000) -> DataFrame:
    """key, part, n_rows, first_number, rows: the rows of each key in order as structs of `columns`, cut into parts of `part_rows`.

    Most keys have one part, 0; of a key with very many rows no task holds more than a part."""
    numbered = row_numbers(rows, [key], order, "__n").withColumn("part", F.floor((F.col("__n") - 1) / part_rows))
    parts = numbered.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("__n", *columns))).alias("__rows"))
    return parts.select(key, "part", F.size("__rows").cast("long").alias("n_rows"), F.element_at("__rows", 1)["__n"].cast("long").alias("first_number"), F.transform("__rows", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("rows"))


def linked_views(entities: DataFrame, occurrences: DataFrame, key: str, order: list[Column], columns: list[str], part_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Entities with their occurrences nested (in parts, as `nested` cuts them), and what does not fit.

    The view has the columns of entities, part, n_rows and rows; an entity without occurrences has one part without rows.
    Issues: key, code, n. `orphaned` occurrences name no entity, `unplaced` entities have no occurrence, `repeated` keys
    stand for several entities, whose occurrences then appear with each."""
    view = entities.join(nested(occurrences.filter(F.col(key).isNotNull()), key, order, columns, part_rows).drop("first_number"), key, "left")
    view = view.withColumns({"part": F.coalesce("part", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0))})
    known, used = entities.groupBy(key).agg(F.count("*").alias("n_known")), occurrences.groupBy(key).agg(F.count("*").alias("n_used"))
    both = known.join(used, known[key].eqNullSafe(used[key]), "full_outer").select(F.coalesce(known[key], used[key]).alias(key), "n_known", "n_used")
    found = {"orphaned": (F.col("n_known").isNull(), "n_used"), "unplaced": (F.col("n_used").isNull(), "n_known"), "repeated": (F.col("n_known") > 1, "n_known")}
    each = F.explode(F.filter(F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), F.col(n).alias("n"))) for code, (holds, n) in found.items()]), lambda x: x.isNotNull()))
    return view, both.select(key, each.alias("v")).select(key, "v.code", "v.n")
