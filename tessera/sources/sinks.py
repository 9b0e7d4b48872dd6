"""Writing row sets: sharded JSON with a manifest, one folder for each table, staging, published versions, and checks of what was written.

`publish` is for folders that are read while they are written anew: a version is a folder of its own and never
changes, and a pointer file that only one writer can make says which is current. `commit` moves one folder to
its place and is not atomic for a reader."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keys, text
from tessera.operators import rollup

from . import archives

#: Bytes that are read of a file at a time.
PIECE = 8 << 20
FILES = "path string, bytes long, sha256 string, is_link boolean"


def write_shards(rows: DataFrame, path: str, groups: list[str], order: list[Column], size: int) -> DataFrame:
    """Writes JSON lines by shard of `size` rows in order within a group; returns the manifest: shard, rows and digest."""
    body = F.to_json(F.struct(*rows.columns))
    sharded = rollup.shards(rows.withColumn("__line", body), groups, order, size)
    sharded.select(*groups, "shard", "__line").write.mode("overwrite").partitionBy(*groups, "shard").text(path)
    return sharded.groupBy(*groups, "shard").agg(F.count("*").alias("n_rows"), keys.file_set_digest(F.lit("row"), F.length("__line"), F.sha2("__line", 256)).alias("digest"))


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder for each table. `form`: parquet, json or csv (with a header)."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").options(header="true").format(form).save(f"{path}/{name}")


def commit(spark, staging: str, path: str) -> None:
    """Moves a finished staging folder to its place. What was there is put aside first, and deleted when the new
    folder is in place, or put back if it is not: a reader finds the old folder, for a moment none, or the new one,
    never a part, and a crash loses neither. Works on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.before-{uuid.uuid4().hex}")
    had = system.exists(target)
    if had and not system.rename(target, aside):
        raise OSError(f"could not put {path} aside")
    if not system.rename(source, target):
        if had:
            system.rename(aside, target)
        raise OSError(f"could not move {staging} to {path}")
    if had:
        system.delete(aside, True)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and version of each pointer that is written to its end, ascending."""
    system, make = _hadoop(spark, path)
    folder = make(f"{path}/pointers")
    found = []
    for status in system.listStatus(folder) if system.exists(folder) else []:
        name = status.getPath().getName()
        if name.isdigit():
            stream = system.open(status.getPath())
            try:
                content = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if content.endswith("\n"):
                found.append((int(name), content.strip()))
    return sorted(found)


def publish(spark: SparkSession, staging: str, path: str) -> int:
    """Makes a finished staging folder the current version of path; returns the version's number.

    The folder becomes path/versions/<name>, which no reader looks for yet. Then the pointer of the next number is
    created, which fails where it is there already: of two writers one gets the number, the other the one after it.
    A crash in between leaves a version without a pointer, which `collect_versions` deletes."""
    system, make = _hadoop(spark, path)
    name = uuid.uuid4().hex
    system.mkdirs(make(f"{path}/versions"))
    if not system.exists(make(staging)) or not system.rename(make(staging), make(f"{path}/versions/{name}")):
        raise OSError(f"could not move {staging} to {path}/versions")
    number = max([n for n, _ in _pointers(spark, path)], default=0) + 1
    while True:
        try:
            stream = system.create(make(f"{path}/pointers/{number:012}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName() and not system.exists(make(f"{path}/pointers/{number:012}")):
                raise
            number += 1
            continue
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        return number


def current(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The folder of the current version, or of a number: resolve it once, and all that is read from it is one version."""
    found = [(n, v) for n, v in _pointers(spark, path) if number in (None, n)]
    if not found:
        raise FileNotFoundError(f"{path} has no version" + ("" if number is None else f" {number}"))
    return f"{path}/versions/{found[-1][1]}"


def collect_versions(spark: SparkSession, path: str, keep: int = 2, grace_s: float = 86_400) -> list[str]:
    """Deletes versions that are not among the last `keep`, nor younger than the grace that readers and writers have; returns their names."""
    if keep < 1:
        raise ValueError("the current version stays")
    system, make = _hadoop(spark, path)
    pointers = _pointers(spark, path)
    kept, before, gone = {v for _, v in pointers[-keep:]}, (time.time() - grace_s) * 1000, []
    for status in system.listStatus(make(f"{path}/versions")) if system.exists(make(f"{path}/versions")) else []:
        name = status.getPath().getName()
        if name not in kept and status.getModificationTime() <= before:
            for n, v in pointers:
                if v == name:
                    system.delete(make(f"{path}/pointers/{n:012}"), False)
            system.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def file_digests(spark: SparkSession, path: str, opener: Callable = archives.open_at) -> DataFrame:
    """path (from the folder on), bytes, sha256 and is_link of every file below a folder, hidden and empty ones aside.

    Files are read in pieces of `PIECE`, so a task never holds a whole one. Links are seen on local file systems."""
    system, make = _hadoop(spark, path)
    root = system.makeQualified(make(path)).toUri().toString().rstrip("/")

    def digested(frames):
        for frame in frames:
            for p in frame.path:
                digest, n = hashlib.sha256(), 0
                with opener(p) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        n += len(piece)
                relative = unquote(urlsplit(p).path).removeprefix(unquote(urlsplit(root).path)).lstrip("/")
                base = unquote(urlsplit(root).path)
                parts = relative.split("/")
                links = p.startswith("file:") and any(os.path.islink("/".join([base, *parts[:k]])) for k in range(1, len(parts) + 1))
                yield pd.DataFrame([(relative, n, digest.hexdigest(), links)], columns=["path", "bytes", "sha256", "is_link"])

    return archives.listing(spark, path).select("path").mapInPandas(digested, FILES)


def verify_files(manifest: DataFrame, found: DataFrame, also: list[str] | None = None) -> DataFrame:
    """path and state of whatever a manifest (path, bytes, sha256) and the files found (as `file_digests` has them) do not agree on.

    `repeated`: the manifest has the path more than once; `unsafe`: it leads out of the folder; `missing`, `extra`;
    `link`; `size`; `digest` where it is another or no SHA-256 in lower-case hex. `also` names files that the manifest
    need not have. No rows: what was written is what is there."""
    listed = manifest.groupBy("path").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    there = found.select(F.col("path").alias("there"), F.col("bytes").alias("n_bytes"), F.col("sha256").alias("digest"), "is_link")
    both = listed.join(there, F.col("path").eqNullSafe(F.col("there")), "full_outer")
    state = (
        F.when(F.col("n").isNull(), F.when(~F.col("there").isin(also or [""]), "extra"))
        .when(F.col("n") > 1, "repeated")
        .when(F.col("path").isNull() | ~text.safe_member(F.col("path")), "unsafe")
        .when(F.col("there").isNull(), "missing")
        .when(F.col("is_link"), "link")
        .when(~F.col("bytes").eqNullSafe(F.col("n_bytes")), "size")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | (F.col("sha256") != F.col("digest")), "digest")
    )
    return both.select(F.coalesce("path", "there").alias("path"), state.alias("state")).filter("state IS NOT NULL")
