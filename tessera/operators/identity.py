"""Duplicate classes, key collisions and alias lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def star_edges(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """An edge from every member of a class of equal content to its least key; classes of one have none.

    The class's least key comes from an aggregate and a join, so a class of any size is spread over tasks."""
    given = rows.select(key, content.alias("digest"))
    least = given.groupBy("digest").agg(F.min(key).alias("representative"), F.count("*").alias("class_size")).filter("class_size > 1")
    return given.join(least, "digest").filter(F.col(key) != F.col("representative")).select(key, "representative", "digest", "class_size")


def collisions(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Keys that name more than one content: keys, n_rows, n_variants, state."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(content).alias("n_variants"))
    return found.withColumn("state", F.when(F.col("n_variants") > 1, "collapsed").otherwise("clean"))


def first_hit(rows: DataFrame, key: str, aliases: list[Column], facts: DataFrame, alias: str, fact_order: str, fact: str) -> DataFrame:
    """The fact of the first alias that any fact has; of several facts for an alias the first in order wins."""
    ranked = facts.groupBy(alias).agg(F.min(F.struct(fact_order, fact)).alias("__f")).select(alias, F.col("__f")[fact].alias(fact))
    spread = rows.select(key, F.posexplode(F.array(*aliases)).alias("alias_rank", alias)).filter(F.col(alias).isNotNull())
    best = spread.join(ranked, alias).groupBy(key).agg(F.min(F.struct("alias_rank", alias, fact)).alias("__b"))
    return rows.select(key).join(best, key, "left").select(key, F.col("__b.alias_rank").alias("alias_rank"), F.col(f"__b.{alias}").alias(alias), F.col(f"__b.{fact}").alias(fact))


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row for each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def first_unique(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, identity, basis: the first of some names that no other row has, else the key itself.

    Counts come from aggregates and joins, so a name that many rows share gathers nowhere."""
    out = rows
    for n in names:
        alone = rows.filter(F.col(n).isNotNull()).groupBy(n).agg(F.count("*").alias("__c")).filter("__c = 1").select(n, F.lit(True).alias(f"__one_{n}"))
        out = out.join(alone, n, "left")
    identity = F.coalesce(*[F.when(F.col(f"__one_{n}"), F.col(n)) for n in names], F.col(key).cast("string"))
    basis = F.coalesce(*[F.when(F.col(f"__one_{n}"), F.lit(n)) for n in names], F.lit(key))
    return out.select(key, identity.alias("identity"), basis.alias("basis"))


def alias_classes(rows: DataFrame, key: str, aliases: dict[str, Column]) -> DataFrame:
    """key, entity, n_aliases, basis: rows that share the value of an alias, whichever way round, are one entity.

    aliases: columns by namespace; values of different namespaces never meet. The entity is the least key of its class,
    n_aliases its distinct aliases, basis the first namespace in which the row meets another (`own` where it does in none).
    Null and empty values are no aliases. A value that many rows share joins each of them to it, never to each other."""
    given = _aliases(rows, key, aliases)
    token = F.concat_ws("\u001f", F.lit("a"), "namespace", "value")
    classes = graph.components(given.select(F.concat_ws("\u001f", F.lit("k"), F.col(key).cast("string")).alias("src"), token.alias("dst")))
    named = rows.select(key).distinct().withColumn("node", F.concat_ws("\u001f", F.lit("k"), F.col(key).cast("string")))
    placed = graph.kept(named.join(classes, "node", "left").select(key, F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min(key).alias("entity"))
    met = given.groupBy("namespace", "value").agg(F.countDistinct(key).alias("n")).filter("n > 1")
    basis = given.join(met, ["namespace", "value"]).groupBy(key).agg(F.min(F.struct("rank", "namespace"))["namespace"].alias("basis"))
    n_aliases = given.join(placed, key).groupBy("component").agg(F.countDistinct("namespace", "value").alias("n_aliases"))
    out = placed.join(least, "component").join(n_aliases, "component", "left").join(basis, key, "left")
    return out.select(key, "entity", F.coalesce("n_aliases", F.lit(0)).cast("long").alias("n_aliases"), F.coalesce("basis", F.lit("own")).alias("basis"))


def alias_conflicts(rows: DataFrame, key: str, aliases: dict[str, Column], identity: Column) -> DataFrame:
    """entity, n_rows, n_identities, identities, namespaces: classes of `alias_classes` that several identities claim, and the
    namespaces whose values rows of different identities share. Up to five identities are shown, the least ones."""
    claimed = rows.select(key, identity.alias("claim")).filter("claim IS NOT NULL").distinct()
    classes = graph.kept(alias_classes(rows, key, aliases).select(key, "entity"))
    each = classes.join(claimed, key, "left").groupBy("entity", "claim").agg(F.countDistinct(key).alias("n"))
    several = each.groupBy("entity").agg(F.sum("n").alias("n_rows"), F.count("claim").alias("n_identities")).filter("n_identities > 1")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("claim"))
    shown = each.filter("claim IS NOT NULL").withColumn("r", rank).filter("r <= 5").groupBy("entity").agg(F.array_sort(F.collect_list(F.col("claim").cast("string"))).alias("identities"))
    split = _aliases(rows, key, aliases).join(claimed, key).groupBy("namespace", "value").agg(F.countDistinct("claim").alias("n"), F.min(key).alias(key)).filter("n > 1")
    namespaces = split.join(classes, key).groupBy("entity").agg(F.array_sort(F.collect_set("namespace")).alias("namespaces"))
    out = several.join(shown, "entity").join(namespaces, "entity", "left")
    return out.select("entity", "n_rows", "n_identities", F.array_join("identities", ",").alias("identities"), F.coalesce(F.array_join("namespaces", ","), F.lit("")).alias("namespaces"))


def _aliases(rows: DataFrame, key: str, aliases: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("namespace"), c.cast("string").alias("value")) for i, (n, c) in enumerate(aliases.items())])
    return rows.select(key, F.explode(pairs).alias("a")).select(key, "a.*").filter("value IS NOT NULL AND value <> ''").distinct()
