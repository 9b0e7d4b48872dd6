"""Keys and digests as column expressions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slug


def digest(*parts: Column, length: int = 64) -> Column:
    """SHA-256 (hex, shortened to `length`) of a JSON array of strings; null counts as empty."""
    array = F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(F.to_json(array), 256), 1, length)


def entity_key(kind: str, lineage: Column, code: Column, namespace: Column, alias: Column) -> Column:
    """A key that lasts through refreshes: from the permanent code where there is one, else from the alias."""
    coded = F.concat_ws(":", F.lit("key"), F.lit(kind), slug(code), digest(F.lit(kind), code, length=8))
    aliased = F.concat_ws(":", F.lit("key"), F.lit(kind), slug(lineage), F.concat(F.lit("source-"), digest(lineage, F.lit(kind), namespace, alias, length=24)))
    return F.when(F.coalesce(code, F.lit("")) != "", coded).otherwise(aliased)


def first_alias(pairs: list[tuple[str, Column]]) -> Column:
    """struct<namespace, value> of the first pair whose value is not empty; null if none is."""
    chosen = [F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(n).alias("namespace"), v.alias("value"))) for n, v in pairs]
    return F.coalesce(*chosen)


def file_set_digest(path: Column, size: Column, sha: Column) -> Column:
    """An aggregate: one digest of a set of files, whatever their order; for small groups, whose lines it holds."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(_line(path, size, sha))), "\n"), 256)


def _line(path: Column, size: Column, sha: Column) -> Column:
    return F.concat_ws("\t", path, size.cast("string"), sha)


def _digested(batches):
    """Rows of one group follow each other, by line."""
    last, files, total, state = None, 0, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([files], pa.int64()), pa.array([total], pa.int64()), pa.array([state.hexdigest()])], ["g", "n_files", "n_bytes", "digest"])

    for batch in batches:
        for group, size, line in zip(*(batch.column(k).to_pylist() for k in ("g", "size", "line")), strict=True):
            if state is None or group != last:
                if state is not None:
                    yield row()
                last, files, total, state = group, 0, None, hashlib.sha256()
            state.update((("\n" if files else "") + line).encode())
            files += 1
            total = total if size is None else (total or 0) + size
    if state is not None:
        yield row()


def file_set_digests(rows: DataFrame, group: str, path: Column, size: Column, sha: Column) -> DataFrame:
    """group (string) -> n_files, n_bytes and the digest of file_set_digest, for groups of any size: sorted lines stream
    through the hash, so no task holds a group's lines."""
    lines = rows.select(F.col(group).alias("g"), size.cast("long").alias("size"), _line(path, size, sha).alias("line"))
    found = lines.repartition("g").sortWithinPartitions("g", "line").mapInArrow(_digested, "g string, n_files long, n_bytes long, digest string")
    return found.withColumnRenamed("g", group)
