"""Files and archives for scanning: every file and archive member once, as text, image bytes or cells, or with the reason why it is not read.

Folders are listed as a table.  An archive is read at random: one task reads its central directory
by a few ranged reads, its members are then dealt over tasks, and each task reads the bytes of
its own members alone.  So neither an archive nor its members pass through one task or one row,
and an archive may be longer than 2 GB.  What is nested is opened where it was read, up to
so many archives deep as the limits say; its bytes are bounded by the limit of a member.

Ranged reads go through `opener`, a function from a path to a file object that can seek.  The
one given reads what `pyarrow.fs` reads: local and mounted folders, HDFS and object stores.
"""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scan


class Limits(NamedTuple):
    """Bytes of a member or file, bytes of an archive's members up to one, archives inside archives."""

    member: int = 20 << 20
    archive: int = 200 << 20
    depth: int = 2


#: Members of an archive that a task reads in a row.
MEMBERS_A_TASK = 64

# What is read as text, as the bytes of an image, as an archive and as a workbook.
TEXT = ".cfg .css .csv .htm .html .ini .js .json .jsonl .md .mjs .py .qmd .rels .rst .svg .toml .tsv .txt .xml .yaml .yml".split()
TEXT_NAMES = [".gitignore", ".gitattributes"]
IMAGES = ".bmp .gif .ico .jpeg .jpg .png .webp".split()
ARCHIVES = [".zip", ".docx", ".pptx"]
WORKBOOKS = [".xlsx"]

ARTIFACTS = "artifact string, kind string, content binary, location string, text string, reason string"
_COLUMNS = [c.split()[0] for c in ARTIFACTS.split(", ")]
_MEMBERS = "path string, n int, member string, size long, total long, reason string"
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)


def open_at(path: str):
    """A file object for ranged reads of a path or URI."""
    from urllib.parse import unquote, urlsplit

    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return open(unquote(urlsplit(path).path), "rb")
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def kind_of(name: str) -> str | None:
    base = name.rpartition("/")[2].lower()
    suffix = posixpath.splitext(base)[1]
    kinds = (("text", TEXT), ("image", IMAGES), ("archive", ARCHIVES), ("workbook", WORKBOOKS))
    return "text" if base in TEXT_NAMES else next((kind for kind, suffixes in kinds if suffix in suffixes), None)


def kind_column(path: Column) -> Column:
    """The same of a column."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(base, r"[^.].*?(\.[^.]*)$", 1)
    kinds = (("text", TEXT), ("image", IMAGES), ("archive", ARCHIVES), ("workbook", WORKBOOKS))
    return F.coalesce(F.when(base.isin(TEXT_NAMES), "text"), *[F.when(suffix.isin(suffixes), kind) for kind, suffixes in kinds])


def unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or name[1:2] == ":" or ".." in re.split(r"[/\\]", name)


def directory(archive: zipfile.ZipFile, limits: Limits) -> Iterator[tuple[int, str, int, int, str | None]]:
    """Number, name, size, bytes so far and what speaks against reading it, of each member that is no folder."""
    total = 0
    for n, info in enumerate(archive.infolist()):
        if info.is_dir():
            continue
        if unsafe(info.filename):
            yield n, info.filename, info.file_size, total, "unsafe_archive_member_name"
            continue
        total += info.file_size
        too_large = info.file_size > limits.member or total > limits.archive
        reason = "link" if stat.S_ISLNK(info.external_attr >> 16) else "archive_scan_size_limit" if too_large else None
        yield n, info.filename, info.file_size, total, reason


def _member(archive: zipfile.ZipFile, n: int) -> bytes:
    """The bytes of a member: no more than its entry says, whatever its stream holds."""
    info = archive.infolist()[n]
    with archive.open(info) as f:
        found = f.read(info.file_size + 1)
    if len(found) != info.file_size:
        raise zipfile.BadZipFile("a member is not as long as its entry says")
    return found


def contents(artifact: str, content: bytes, depth: int, limits: Limits) -> Iterator[tuple]:
    """The rows of a file or member that was read, `depth` archives deep, and of all that is nested in it."""
    kind = kind_of(artifact)
    if kind is None:
        yield artifact, None, None, None, None, "unsupported_file_type" if not depth else "unsupported_archive_member_type"
    elif kind == "archive":
        if depth > limits.depth:
            yield artifact, kind, None, None, None, "nested_archive_depth_exceeded"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                yield artifact, kind, None, None, None, None
                for n, name, _, _, reason in directory(archive, limits):
                    yield from _read(archive, f"{artifact}!/{name}", n, reason, depth + 1, limits)
        except zipfile.BadZipFile:
            yield artifact, kind, None, None, None, "zip_open_failed"
    elif kind == "workbook":
        try:
            yield from [(artifact, kind, None, location, text, None) for location, text in cells(content, limits)] or [(artifact, kind, None, None, None, None)]
        except (*BROKEN, KeyError, ElementTree.ParseError):
            yield artifact, kind, None, None, None, "xlsx_open_failed"
    elif kind == "text":
        yield artifact, kind, None, None, content.decode("utf-8", "replace"), None
    else:
        yield artifact, kind, content, None, None, None


def _read(archive: zipfile.ZipFile, artifact: str, n: int, reason: str | None, depth: int, limits: Limits) -> Iterator[tuple]:
    if reason is None:
        try:
            found = _member(archive, n)
        except BROKEN:
            reason = "member_read_failed"
    if reason is not None:
        yield artifact, kind_of(artifact), None, None, None, reason
        return
    yield from contents(artifact, found, depth, limits)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def cells(content: bytes, limits: Limits = Limits()) -> Iterator[tuple[str, str]]:
    """Where and what: the filled cells of a workbook (formulas as written), link targets and properties.

    Raises what zipfile and ElementTree raise, on any part that is broken or over the limits."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = {}
        for n, name, _, _, reason in directory(archive, limits):
            if reason is not None:
                raise zipfile.BadZipFile(reason)
            if name.endswith((".xml", ".rels")):
                parts[name] = ElementTree.fromstring(_member(archive, n))
    strings = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in parts.get("xl/sharedStrings.xml", ())]
    targets = {r.get("Id"): r.get("Target", "") for r in parts.get("xl/_rels/workbook.xml.rels", ())}
    for sheet in [s for s in parts["xl/workbook.xml"].iter() if _local(s.tag) == "sheet"]:
        target = targets.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None), "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        for cell in [c for c in parts.get(path, ()) and parts[path].iter() if _local(c.tag) == "c"]:
            inner = {_local(x.tag): x for x in cell}
            value = inner["v"].text if "v" in inner else None
            if cell.get("t") == "s" and value is not None:
                value = strings[int(value)]
            elif "is" in inner:
                value = "".join(t.text or "" for t in inner["is"].iter() if _local(t.tag) == "t")
            if "f" in inner and inner["f"].text:
                value = f"={inner['f'].text}"
            if value:
                yield f"{sheet.get('name')}!{cell.get('r')}", value
        folder, _, base = path.rpartition("/")
        for r in parts.get(f"{folder}/_rels/{base}.rels", ()):
            if r.get("TargetMode") == "External":
                yield f"{sheet.get('name')} (hyperlink)", r.get("Target", "")
    for x in parts.get("docProps/core.xml", ()):
        if x.text and _local(x.tag) in ("creator", "lastModifiedBy", "title", "subject", "description"):
            yield f"workbook.properties.{_local(x.tag)}", x.text


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file below a path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def members(archives: DataFrame, opener: Callable = open_at, limits: Limits = Limits()) -> DataFrame:
    """path of an archive, n, member, size, total and reason of each of its members; one row without member where it does not open."""

    def read(frames):
        for frame in frames:
            for path in frame.path:
                try:
                    with opener(path) as f, zipfile.ZipFile(f) as archive:
                        rows = [(path, *r) for r in directory(archive, limits)]
                except BROKEN:
                    rows = [(path, None, None, None, None, "zip_open_failed")]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")]).astype({"n": "Int32", "size": "Int64", "total": "Int64"})

    return archives.select("path").mapInPandas(read, _MEMBERS)


def artifacts(spark: SparkSession, path: str, opener: Callable = open_at, limits: Limits = Limits()) -> DataFrame:
    """artifact, kind, content (of images), location (of cells), text, and the reason where it was not read, of all files and members below a path.

    An artifact is named from the path on, members after `!/`. Spark lists no empty files, and there is nothing in them to read."""
    files = listing(spark, path).withColumn("kind", kind_column(F.col("path")))
    large = F.col("length") > limits.member
    reason = F.when(F.col("kind").isNull(), "unsupported_file_type").when(large & (F.col("kind") == "workbook"), "xlsx_open_failed").when(large, F.concat("kind", F.lit("_scan_size_limit")))
    whole = files.filter("kind IS NULL OR kind <> 'archive'").withColumn("reason", reason).select("path", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("member"), "reason")
    zips = files.filter("kind = 'archive'")
    inside = members(zips, opener, limits).select("path", "n", "member", "reason")
    tops = inside.groupBy("path").agg(F.max(F.when(F.col("member").isNull(), F.col("reason"))).alias("reason"))
    opened = zips.join(tops, "path", "left").select("path", F.lit(-2).alias("n"), F.lit(None).cast("string").alias("member"), "reason")
    todo = whole.unionByName(opened).unionByName(inside.filter("member IS NOT NULL"))
    dealt = todo.withColumn("part", F.floor(F.col("n") / MEMBERS_A_TASK)).repartition("path", "part").sortWithinPartitions("path", "n")

    def read(frames):
        held = (None, None, None)
        for frame in frames:
            for path, n, member, why in zip(frame.path, frame.n, frame.member, frame.reason, strict=True):
                artifact = path if n < 0 else f"{path}!/{member}"
                if n == -2 or (n == -1 and why is not None):
                    rows = [(artifact, kind_of(artifact), None, None, None, why)]
                elif n == -1:
                    with opener(path) as f:
                        rows = contents(artifact, f.read(), 0, limits)
                elif why is not None:
                    rows = [(artifact, kind_of(artifact), None, None, None, why)]
                else:
                    if held[0] != path:  # the directory is read once for each archive that a task has members of
                        if held[0] is not None:
                            held[1].close(), held[2].close()
                        f = opener(path)
                        held = (path, zipfile.ZipFile(f), f)
                    rows = _read(held[1], artifact, int(n), None, 1, limits)
                for row in rows:
                    yield pd.DataFrame([row], columns=_COLUMNS)
        if held[0] is not None:
            held[1].close(), held[2].close()

    return dealt.mapInPandas(read, ARTIFACTS)


def findings(found: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """artifact, location, rule, n_found: rules that match names, lines of text, cells, or the bytes of images read as text."""
    names = found.select("artifact").distinct().select("artifact", F.lit("artifact name").alias("location"), F.col("artifact").alias("text"))
    lines = found.filter("kind = 'text' AND text IS NOT NULL").select("artifact", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("at", "text"))
    lines = lines.select("artifact", F.concat(F.lit("line:"), F.col("at") + 1).alias("location"), "text")
    filled = found.filter("kind = 'workbook' AND text IS NOT NULL").select("artifact", "location", "text")
    counted = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n_found")) for k, p in (rules or scan.RULES).items()])
    matched = names.unionByName(lines).unionByName(filled).withColumn("r", F.explode(counted)).filter("r.n_found > 0").select("artifact", "location", "r.rule", "r.n_found")
    images = scan.scan_bytes(found.filter("kind = 'image' AND content IS NOT NULL"), "artifact", "content", rules)
    return matched.unionByName(images.select("artifact", F.lit("image bytes").alias("location"), "rule", "n_found"))


def verdict(found: DataFrame, matched: DataFrame, allow_unscanned: bool = False) -> DataFrame:
    """One row: n_scanned, n_unscanned, n_findings, and status: `fail` where something was found or, unless that is allowed, not scanned; else `pass`."""
    read = found.groupBy("artifact").agg(F.max("reason").alias("reason"), F.max("kind").alias("kind"))
    scanned = F.col("reason").isNull() & (F.col("kind") != "archive")
    each = read.select(scanned.cast("long").alias("scanned"), F.col("reason").isNotNull().cast("long").alias("unscanned"), F.lit(0).cast("long").alias("n"))
    each = each.unionByName(matched.select(F.lit(0).cast("long").alias("scanned"), F.lit(0).cast("long").alias("unscanned"), F.col("n_found").cast("long").alias("n")))
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(to) for c, to in (("scanned", "n_scanned"), ("unscanned", "n_unscanned"), ("n", "n_findings"))])
    fails = (F.col("n_findings") > 0) | ((F.col("n_unscanned") > 0) & ~F.lit(allow_unscanned))
    return total.withColumn("status", F.when(fails, "fail").otherwise("pass"))
