"""Collecting, promoting and ranking changes, and comparing snapshots."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_way(base: DataFrame, current: DataFrame, edited: DataFrame, key: str, fields: list[str], protected: list[str]) -> DataFrame:
    """One row for each field an edit changes: key, field, base, current and edited value, and the decision.

    unchanged fields are left out. `accept`: only the edit changed it. `same`: both changed it alike.
    `conflict`: both changed it. `refuse`: the field is protected. A key on one side only is `added` or `removed`."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("p")
        return df.select(key, pairs).select(key, "p.field", f"p.{name}")

    joined = long(base, "base_value").join(long(edited, "edited_value"), [key, "field"], "full_outer").join(long(current, "current_value"), [key, "field"], "left")
    b, c, e = F.col("base_value"), F.col("current_value"), F.col("edited_value")
    held = base.select(key).distinct().withColumn("__in_base", F.lit(True))
    kept = edited.select(key).distinct().withColumn("__in_edit", F.lit(True))
    joined = joined.join(held, key, "left").join(kept, key, "left")
    decision = (
        F.when(F.col("__in_base").isNull(), "added")
        .when(F.col("__in_edit").isNull(), "removed")
        .when(b.eqNullSafe(e), None)
        .when(F.col("field").isin(protected), "refuse")
        .when(c.eqNullSafe(b), "accept")
        .when(c.eqNullSafe(e), "same")
        .otherwise("conflict")
    )
    return joined.withColumn("decision", decision).filter("decision IS NOT NULL").select(key, "field", "base_value", "current_value", "edited_value", "decision")


def promotable(changes: DataFrame, target: list[str], value: str) -> DataFrame:
    """For each target: its one value, or a conflict where changes disagree. Adds n_changes, n_values, state and value."""
    found = changes.groupBy(*target).agg(F.count("*").alias("n_changes"), F.countDistinct(value).alias("n_values"), F.min(value).alias("value"))
    return found.withColumn("state", F.when(F.col("n_values") > 1, "conflict").otherwise("promoted")).withColumn("value", F.when(F.col("n_values") == 1, F.col("value")))


def precedence(rows: DataFrame, keys: list[str], rank: Column, order: Column, value: str) -> DataFrame:
    """The value of the highest layer, the latest of equals: keys, rank, value, and how many layers it overrides."""
    best = F.max(F.struct(rank.alias("rank"), order.alias("o"), F.col(value).alias("v"))).alias("b")
    found = rows.groupBy(*keys).agg(best, F.countDistinct(rank).alias("n_layers"))
    return found.select(*keys, F.col("b.rank").alias("rank"), F.col("b.v").alias("value"), (F.col("n_layers") - 1).alias("n_overridden"))


def pair_by(a: DataFrame, b: DataFrame, identities: list[str], key_a: str, key_b: str) -> DataFrame:
    """Pairs rows whose identity value is unique on both sides, one identity after the other: key_a, key_b, matched_by."""
    left, right, found = a, b, []
    for name in identities:

        def alone(df: DataFrame, key: str, name: str = name) -> DataFrame:
            return df.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != "")).groupBy(name).agg(F.count("*").alias("n"), F.min(key).alias(key)).filter("n = 1").drop("n")

        pairs = alone(left, key_a).join(alone(right, key_b), name).select(key_a, key_b, F.lit(name).alias("matched_by"))
        found.append(pairs)
        left, right = left.join(pairs, key_a, "left_anti"), right.join(pairs, key_b, "left_anti")
    return reduce(DataFrame.unionByName, found)


def title_classes(a: DataFrame, b: DataFrame, title: str) -> DataFrame:
    """How titles of two snapshots pair: one to one, missing, added or ambiguous, with counts on both sides."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(title).agg(F.count("*").alias(name))

    both = counts(a, "n_a").join(counts(b, "n_b"), title, "full_outer").fillna(0, ["n_a", "n_b"])
    kind = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), "paired").when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "added").otherwise("ambiguous")
    return both.withColumn("pairing", kind)


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], key: str, record: str) -> DataFrame:
    """Left keys with the right records that any of the column pairs joins.

    Adds n_matches, the least record and a state: absent, resolved or ambiguous, for each row of left. Records are counted for
    each value and for each combination of values before they are joined, and a union's size follows from these (inclusion and
    exclusion): a row of left is joined with one row for each combination of pairs, never with its records."""
    names = [f"__k{i}" for i in range(len(pairs))]
    out = left.select(key, *[F.col(a).alias(n) for n, (a, _) in zip(names, pairs, strict=True)])
    sides = [right.filter(F.col(b).isNotNull()).select(F.col(record).alias("__r"), F.col(b).alias(n)).distinct() for n, (_, b) in zip(names, pairs, strict=True)]
    total, least = F.lit(0).cast("long"), []
    for size in range(1, len(pairs) + 1):
        for some in itertools.combinations(range(len(pairs)), size):
            on, c = [names[i] for i in some], "__n" + "_".join(map(str, some))
            both = reduce(lambda x, y: x.join(y.withColumnRenamed("__r", "__s"), F.col("__r").eqNullSafe(F.col("__s"))).drop("__s"), [sides[i] for i in some])
            counted = both.groupBy(*on).agg(F.count("*").alias(c), *([F.min("__r").alias(f"{c}r")] if size == 1 else []))
            out = out.join(counted, on, "left")
            total = total + F.coalesce(F.col(c), F.lit(0)) * (1 if size % 2 else -1)
            least += [f"{c}r"] if size == 1 else []
    first = F.col(least[0]) if len(least) == 1 else F.least(*least)
    found = out.select(key, total.alias("n_matches"), first.alias("__first"))
    state = F.when(F.col("n_matches") == 0, "absent").when(F.col("n_matches") == 1, "resolved").otherwise("ambiguous")
    return found.select(key, "n_matches", F.when(F.col("n_matches") == 1, F.col("__first")).alias(record), state.alias("state"))
