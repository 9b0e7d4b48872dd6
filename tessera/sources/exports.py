"""Nested XML exports as tables: folders or ZIP archives of XML files, walked into one row for each element.

Files are read with Spark's binary source; members of archives are read at random and documents
walked inside the tasks, so each document is one unit of work.  A file that does not parse gives one row with `error`.
"""

from __future__ import annotations

import stat
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import markup, mathtext, text
from tessera.operators import identity, link

from . import archives

#: Limits of an archive, and of a member.
MOST_MEMBERS, MOST_BYTES, MOST_MEMBER = 100_000, 20 << 30, 1 << 30

FILES = "snapshot string, file string, content binary, error string"
NODES = "snapshot string, file string, node_id long, parent_id long, depth int, tag string, attrs map<string,string>, text string, tail string, section_path string, section_ident string, section_node long, item_node long, condition_node long, negated boolean, feedback string, block_node long, is_blank boolean, in_presentation boolean, choice_node long, group_node long, string_node long, error string"

_COLUMNS = [field.split()[0] for field in NODES.split(", ")]
_KINDS = {c: "Int64" for c in _COLUMNS if c.endswith(("parent_id", "_node"))} | {"depth": "Int32"} | {c: "boolean" for c in ("negated", "is_blank", "in_presentation")}
_TEXTS = ["tag", "text", "tail", "section_path", "section_ident", "feedback", "error"]


def member_error(info: zipfile.ZipInfo) -> str | None:
    """Why a member of an archive is not read."""
    name = info.filename
    if name.startswith(("/", "\\")) or "\\" in name or ".." in name.split("/") or name[1:2] == ":":
        return "unsafe_path"
    if stat.S_ISLNK(info.external_attr >> 16):
        return "link"
    return None


def listed(archive: zipfile.ZipFile, name: str) -> list[tuple[int | None, str, str | None]]:
    """Number, name and error of an archive's members in the order of their names; one row with the archive's own name where it is too large."""
    members = [(n, m) for n, m in enumerate(archive.infolist()) if not m.is_dir()]
    if len(members) > MOST_MEMBERS or sum(m.file_size for _, m in members) > MOST_BYTES:
        return [(None, name, "too_large")]
    return [(n, m.filename, member_error(m) or ("too_large" if m.file_size > MOST_MEMBER else None)) for n, m in sorted(members, key=lambda x: x[1].filename)]


def walk(content: bytes) -> Iterator[dict]:
    """Elements in document order, with what encloses them: titled sections, the nearest section, item, scoring
    condition (and whether an odd number of negations is between), feedback block, choice, response group and string.

    block_node is the material that stands in a presentation itself or in its flows: a block of the prompt.  A
    response_str that stands there is a blank of the prompt."""
    number = 0
    outside = {"section_path": "", "section_ident": "", "section_node": None, "item_node": None, "condition_node": None, "negated": False, "feedback": None}
    outside |= {"block_node": None, "in_presentation": False, "choice_node": None, "group_node": None, "string_node": None, "flows": False}
    stack = [(markup.parsed(content), None, 0, outside)]
    while stack:
        node, parent, depth, around = stack.pop()
        number += 1
        tag = node.tag.rpartition("}")[2]
        if tag == "section":
            path = " > ".join(x for x in (around["section_path"], (node.get("title") or "").strip()) if x)
            around = {**around, "section_path": path, "section_ident": node.get("ident") or around["section_ident"], "section_node": number}
        elif tag == "item":
            around = {**around, "item_node": number}
        elif tag == "respcondition":
            around = {**around, "condition_node": number, "negated": False}
        elif tag == "not":
            around = {**around, "negated": not around["negated"]}
        elif tag == "itemfeedback":
            around = {**around, "feedback": node.get("ident")}
        elif tag in ("response_label", "response_grp", "response_str"):
            around = {**around, {"response_label": "choice_node", "response_grp": "group_node", "response_str": "string_node"}[tag]: number}
        is_blank = tag == "response_str" and around["flows"]
        if tag == "presentation":
            around = {**around, "in_presentation": True, "flows": True}
        elif tag == "material" and around["flows"]:
            around = {**around, "block_node": number, "flows": False}
        elif tag != "flow":
            around = {**around, "flows": False}
        placed = {k: v for k, v in around.items() if k != "flows"}
        yield {"node_id": number, "parent_id": parent, "depth": depth, "tag": tag, "attrs": {k.rpartition("}")[2]: v for k, v in node.attrib.items()}, "text": node.text, "tail": node.tail, "is_blank": is_blank, **placed}
        stack += [(child, number, depth + 1, around) for child in reversed(node)]


def read_files(spark: SparkSession, path: str, opener: Callable = archives.open_at) -> DataFrame:
    """snapshot, file, content, error of every file below a path, archives opened.

    An archive is read at random: its directory first, then its members, dealt over tasks; it may be as long as its limits let it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_archive = F.lower("path").endswith(".zip")
    folder, base = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    plain = found.filter(~is_archive).select(folder.alias("snapshot"), base.alias("file"), "content", F.lit(None).cast("string").alias("error"))

    def directories(frames):
        for frame in frames:
            for p in frame.path:
                name = p.rpartition("/")[2]
                try:
                    with opener(p) as f, zipfile.ZipFile(f) as archive:
                        rows = listed(archive, name)
                except archives.BROKEN:
                    rows = [(None, name, "bad_archive")]
                if rows:
                    yield pd.DataFrame([(p, *r) for r in rows], columns=["snapshot", "n", "file", "error"]).astype({"n": "Int32"})

    def opened(frames):
        at, archive, f = None, None, None
        for frame in frames:
            for p, n, name, error in frame[["snapshot", "n", "file", "error"]].itertuples(index=False, name=None):
                content = None
                if pd.isna(error):
                    error = None
                    if at != p:
                        if at is not None:
                            archive.close(), f.close()
                        f = opener(p)
                        at, archive = p, zipfile.ZipFile(f)
                    try:
                        content = archive.read(archive.infolist()[int(n)])
                    except archives.BROKEN:
                        error = "bad_member"
                yield pd.DataFrame([(p, name, content, error)], columns=["snapshot", "file", "content", "error"])
        if at is not None:
            archive.close(), f.close()

    members = found.filter(is_archive).select("path").mapInPandas(directories, "snapshot string, n int, file string, error string")
    dealt = members.withColumn("part", F.floor(F.coalesce("n", F.lit(0)) / archives.MEMBERS_A_TASK)).repartition("snapshot", "part").sortWithinPartitions("snapshot", "n")
    return plain.unionByName(dealt.mapInPandas(opened, FILES))


def read_nodes(files: DataFrame) -> DataFrame:
    """The node table of XML files."""

    def walked(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.error or not row.file.lower().endswith(".xml"):
                    continue
                try:
                    nodes = pd.DataFrame(list(walk(bytes(row.content))))
                except ElementTree.ParseError as e:
                    nodes = pd.DataFrame([{"node_id": 0, "attrs": {}, "error": str(e)}])
                nodes["snapshot"], nodes["file"] = row.snapshot, row.file
                nodes = nodes.reindex(columns=_COLUMNS).astype(_KINDS)
                yield nodes.astype({c: object for c in _TEXTS}).replace({c: {float("nan"): None} for c in _TEXTS})

    return files.mapInPandas(walked, NODES)


def fields(nodes: DataFrame) -> DataFrame:
    """Label and entry pairs of items as one map for each: the last entry of a label wins."""
    key = ["snapshot", "file", "item_node"]
    own = nodes.filter("item_node IS NOT NULL")
    label = own.filter("tag = 'fieldlabel'").select(*key, "parent_id", F.col("text").alias("label"))
    entry = own.filter("tag = 'fieldentry'").select(*key, "parent_id", F.col("node_id").alias("at"), F.coalesce("text", F.lit("")).alias("entry"))
    pairs = label.join(entry, [*key, "parent_id"]).groupBy(*key, "label").agg(F.max_by("entry", "at").alias("entry"))
    return pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("label", "entry"))).alias("fields"))


def _in_order(value: str) -> Column:
    """An aggregate: the values by node_id."""
    return F.transform(F.array_sort(F.collect_list(F.struct("node_id", value))), lambda x: x[value])


def texts_of(nodes: DataFrame, node: str, named: str) -> DataFrame:
    """What the material below each `node` (a column of enclosing nodes) says: its texts in order, rendered."""
    html = F.array_join(_in_order("t"), " ")
    told = nodes.filter(F.col(node).isNotNull() & (F.col("tag") == "mattext")).withColumn("t", F.trim(F.coalesce("text", F.lit("")))).filter("t <> ''")
    return told.groupBy("snapshot", "file", "item_node", node).agg(html.alias("h")).select("snapshot", "file", "item_node", node, markup.html_text(F.col("h")).alias(named))


def prompts(nodes: DataFrame) -> DataFrame:
    """snapshot, file, item_node, prompt: the blocks of each item's presentation in order, blanks as [Blank n];
    without any, its first text."""
    key = ["snapshot", "file", "item_node"]
    blocks = texts_of(nodes, "block_node", "part").filter("part <> ''").withColumnRenamed("block_node", "node_id")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("node_id"))
    blanks = nodes.filter("is_blank AND item_node IS NOT NULL").select(*key, "node_id", F.concat(F.lit("[Blank "), number.cast("string"), F.lit("]")).alias("part"))
    whole = blocks.unionByName(blanks).groupBy(*key).agg(F.array_join(_in_order("part"), " ").alias("p")).select(*key, mathtext.inline(F.col("p")).alias("prompt"))
    first = nodes.filter("in_presentation AND tag = 'mattext' AND item_node IS NOT NULL").groupBy(*key).agg(F.min_by("text", "node_id").alias("h"))
    return whole.join(first, key, "full_outer").select(*key, F.coalesce("prompt", markup.html_text(F.col("h")), F.lit("")).alias("prompt"))


def choices(nodes: DataFrame) -> DataFrame:
    """snapshot, file, item_node, choice_node, ident, choice: the options of each item that say something."""
    labels = nodes.filter("tag = 'response_label' AND item_node IS NOT NULL").select("snapshot", "file", "item_node", F.col("node_id").alias("choice_node"), "group_node", F.col("attrs.ident").alias("ident"))
    return labels.join(texts_of(nodes, "choice_node", "choice"), ["snapshot", "file", "item_node", "choice_node"]).filter("choice <> ''")


def items(nodes: DataFrame) -> DataFrame:
    """One row for each item and item reference: identity, prompt, choices and keys, and its place in the file."""
    key = ["snapshot", "file", "item_node"]
    options = choices(nodes).withColumnRenamed("choice_node", "node_id").groupBy(*key).agg(_in_order("choice").alias("choices"))
    told = prompts(nodes).join(options, key, "full_outer")
    heads = nodes.filter("tag IN ('item', 'itemref')").select(
        "snapshot", "file", "node_id", F.col("node_id").alias("item_node"), "tag", F.col("attrs.ident").alias("ident"), F.col("attrs.label").alias("label"), F.col("attrs.linkrefid").alias("linkrefid"), "section_path", "section_ident"
    )
    out = heads.join(told, key, "left").join(fields(nodes), key, "left")
    number = F.row_number().over(Window.partitionBy("snapshot", "file").orderBy("node_id"))
    named = out.withColumn("item_number", number).withColumn("prompt", F.coalesce("prompt", F.lit("")))
    said = F.array_join(F.coalesce("choices", F.array().cast("array<string>")), " || ")
    kind = F.coalesce(F.col("fields")["qmd_questiontype"], F.lit(""))
    return named.select(
        "snapshot", "file", "item_number", "tag", "ident", "label", "linkrefid", "section_path", "section_ident", "prompt", F.coalesce(F.size("choices"), F.lit(0)).alias("n_choices"), kind.alias("kind"),
        F.nullif(F.col("fields")["qmd_displayid"], F.lit("")).alias("displayid"), F.nullif(F.col("fields")["qmd_globalid"], F.lit("")).alias("globalid"),
        text.exact_key(F.col("prompt")).alias("exact_key"), text.similarity_key(F.col("prompt")).alias("similarity_key"),
        F.concat_ws("|", kind, text.exact_key(F.col("prompt")), text.exact_key(said)).alias("signature"),
    )


def link_items(catalogue: DataFrame, placed: DataFrame) -> DataFrame:
    """Items of quizzes to library records: references by label or ident; inline items by permanent ids, then by
    equal content, then by bounded similarity within their kind. Ambiguous evidence links nothing."""
    records = catalogue.withColumn("record", F.concat_ws("#", "snapshot", "file", F.lpad("item_number", 8, "0"))).withColumn("pool", F.col("section_path"))

    def gate(name: str) -> DataFrame:
        return link.unique_gate(records, name, "pool", "record")

    refs = placed.filter("tag = 'itemref'").withColumn("by_label", F.col("linkrefid")).withColumn("by_ident", F.col("linkrefid"))
    label, ident = gate("label").withColumnRenamed("label", "by_label"), gate("ident").withColumnRenamed("ident", "by_ident")
    refs = link.ladder(refs, "item_number", [("source_evidence", "label", label, "by_label"), ("source_evidence", "ident", ident, "by_ident")], "record").drop("by_label", "by_ident")
    inline = placed.filter("tag = 'item'")
    rungs = [("source_evidence", "displayid"), ("source_evidence", "globalid"), ("inferred_exact", "signature"), ("inferred_exact", "exact_key")]
    inline = link.ladder(inline, "item_number", [(level, name, gate(name), name) for level, name in rungs], "record")
    key = F.concat_ws("#", "snapshot", "file", F.lpad("item_number", 8, "0"))
    # an item is compared with the records of its kind, or with all where the kind has none; of these only with
    # records of as many choices, or of none, where there are any
    rest = inline.filter("record IS NULL").withColumn("item", key)
    near = link.similarity_candidates(rest, records, "item", "record", "similarity_key")
    known = records.select("kind", "n_choices").distinct()
    kinds = rest.select(F.col("kind").alias("k"), F.col("n_choices").alias("n")).distinct()
    own = kinds.join(known.select(F.col("kind").alias("k")).distinct().withColumn("has_kind", F.lit(True)), "k", "left").fillna(False, ["has_kind"])
    # two small tables: kinds by numbers of choices
    fitting = own.join(known, (~F.col("has_kind") | (F.col("k") == F.col("kind"))) & ((F.col("n_choices") == F.col("n")) | (F.col("n_choices") == 0)), "left_semi").withColumn("has_count", F.lit(True))
    scope = own.join(fitting, ["k", "n", "has_kind"], "left").fillna(False, ["has_count"])
    near = near.join(rest.select("item", F.col("kind").alias("k"), F.col("n_choices").alias("n")), "item").join(scope, ["k", "n"]).join(records.select("record", "kind", "n_choices"), "record")
    near = near.filter((~F.col("has_kind") | (F.col("k") == F.col("kind"))) & (~F.col("has_count") | (F.col("n_choices") == F.col("n")) | (F.col("n_choices") == 0)))
    best = identity.first_per(near, ["item"], [F.desc("score"), F.col("record")]).select("item", "record", "score")
    second = near.join(best.select("item", F.col("record").alias("top")), "item").filter("record <> top").groupBy("item").agg(F.max("score").alias("second"))
    sure = best.join(second, "item", "left").filter((F.col("score") >= link.SIMILAR) & (F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 6) >= link.LEAD)).select("item", F.col("record").alias("similar"))
    inline = inline.withColumn("item", key).join(sure, "item", "left").drop("item")
    by_similarity = F.col("similar").isNotNull()
    inline = inline.withColumns({"evidence_level": F.when(by_similarity, "inferred_similarity").otherwise(F.col("evidence_level")), "match_basis": F.when(by_similarity, "similarity_key").otherwise(F.col("match_basis")), "record": F.coalesce("record", "similar")}).drop("similar")
    return refs.unionByName(inline)
