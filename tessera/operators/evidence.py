"""What evidence says of records: single facts, pairs, overlaps, sources and references, as aggregates and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_key(kind: str, source_kind: str, from_key: Column, to_key: Column, ordinal: Column, evidence: Column) -> Column:
    """A lasting key of a relation: the SHA-256 of all that makes it; a null counts as an empty text."""
    parts = [F.lit(kind), F.lit(source_kind), from_key, to_key, ordinal, evidence]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def single_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_values and the value of keys that have one only: a repeated one is none, even if it is the same."""
    found = rows.groupBy(*keys).agg(F.count(value).alias("n_values"), F.min(value).alias(value))
    return found.withColumn(value, F.when(F.col("n_values") == 1, F.col(value)))


def paired_once(left: DataFrame, left_key: str, right: DataFrame, right_key: str, on: str) -> DataFrame:
    """Rows of two tables whose evidence is that of one row on each side: on, left_key, right_key. Null evidence pairs nothing."""

    def alone(rows: DataFrame, key: str) -> DataFrame:
        return rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__n"), F.min(key).alias(key)).filter("__n = 1").drop("__n")

    return alone(left, left_key).join(alone(right, right_key), on)


def applies(evidence: Column, about: Column) -> Column:
    """Whether a diagnostic about some evidence concerns a record: one of them names none, or they share some."""
    e, a = F.coalesce(evidence, F.array().cast("array<string>")), F.coalesce(about, F.array().cast("array<string>"))
    return (F.size(e) == 0) | (F.size(a) == 0) | F.arrays_overlap(e, a)


def first_existing(wanted: DataFrame, key: str, candidates: list[Column], expected: str, files: DataFrame, roots: list[str]) -> DataFrame:
    """key, place (of the first candidate, from 0), path and state of what stands for each wanted file.

    files (path, digest); paths outside the roots are never taken. `absent`: no candidate is there; `mismatch`:
    the first one has another digest than the expected one, which may be null; `resolved` otherwise."""
    allowed = F.split_part(F.col("path"), F.lit("/"), F.lit(1)).isin(roots) & ~F.array_contains(F.split("path", "/"), "..")
    tried = wanted.select(key, F.posexplode(F.array(*candidates)).alias("place", "path")).filter(allowed)
    found = tried.join(files.groupBy("path").agg(F.min("digest").alias("digest")), "path").groupBy(key).agg(F.min(F.struct("place", "path", "digest")).alias("f"))
    state = F.when(F.col("f").isNull(), "absent").when(F.col("f.digest") != F.col(expected), "mismatch").otherwise("resolved")
    return wanted.select(key, expected).join(found, key, "left").select(key, F.col("f.place").alias("place"), F.col("f.path").alias("path"), state.alias("state"))


def unique_attributes(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """keys and attributes, a map; null where a name occurs twice, whatever its values."""
    by_name = rows.groupBy(*keys, name).agg(F.count("*").alias("__n"), F.min(value).alias(value))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))
    return by_name.groupBy(*keys).agg(F.max("__n").alias("__n"), entries.alias("attributes")).select(*keys, F.when(F.col("__n") == 1, F.col("attributes")).alias("attributes"))


def references(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, kind, path and reference of all fields (kind: column) that name other records; nulls name none. A column may hold a list."""

    def named(kind: str, column: str) -> Column:
        listed = rows.schema[column].dataType.typeName() == "array"
        values = F.col(column).cast("array<string>") if listed else F.array(F.col(column).cast("string"))
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"$.{column}"), F.format_string("[%s]", i) if listed else F.lit("")).alias("path"), v.alias("reference")))

    spread = F.flatten(F.array(*[F.coalesce(named(k, c), F.array().cast("array<struct<kind:string,path:string,reference:string>>")) for k, c in fields.items()]))
    return rows.select(key, F.explode(spread).alias("r")).filter("r.reference IS NOT NULL").select(key, "r.kind", "r.path", "r.reference")


def missing_of(held: DataFrame, key: str, name: str, required: list[str]) -> DataFrame:
    """key and name of what each key should have and has not."""
    wanted = held.select(key).distinct().select(key, F.explode(F.array(*[F.lit(x) for x in required])).alias(name))
    return wanted.join(held.select(key, name).distinct(), [key, name], "left_anti")


def json_value(value: Column) -> tuple[Column, Column]:
    """Kind and value of a setting: what its JSON says, or the text as it is."""
    parsed = F.try_parse_json(value)
    kind = F.when(parsed.isNull(), "text").otherwise(F.regexp_extract(F.lower(F.schema_of_variant(parsed)), "^[a-z]+", 0))
    return kind, F.when(parsed.isNull(), value).otherwise(F.coalesce(F.try_variant_get(parsed, "$", "string"), F.to_json(parsed)))
