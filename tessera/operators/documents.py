"""JSON documents: strict reading with places of faults, and keys for the nodes of trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import keys

from .graph import kept

LEAVES = "leaves array<struct<path:string,kind:string,value:string,lexeme:string>>, fault string, at long"
_TOKEN = re.compile(
    r"""[ \t\r\n]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9.A-Za-z])"""
    r"""|(?P<word>-?[A-Za-z]+)|(?P<mark>[{}\[\],:]))"""
)
WORDS = {"true": "boolean", "false": "boolean", "null": "null"}
#: What may not be in JSON though some parsers take it.
NO_NUMBERS = ("NaN", "Infinity", "-Infinity")


class Fault(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.at = at


def leaves(text: str) -> Iterator[tuple[str, str, str, str]]:
    """path, kind, value and lexeme (as written) of each leaf in order; empty objects and arrays are leaves.

    Raises Fault at the first character that is no JSON, at a number that is not finite, and at a key that its object
    has already. Open objects and arrays are held on a stack of our own, so depth is no limit."""
    at, end = 0, len(text)
    open_ = []  # [is object, keys of the object so far or None, number of the next value, path]
    path, wants = "$", "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            rest = re.match(r"[ \t\r\n]*", text[at : at + 1000]).end() + at
            if rest >= end and wants == "end":
                return
            raise Fault("unexpected_end" if rest >= end else "unexpected_character", rest)
        kind, token, start = m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)
        at = m.end()
        if wants == "end":
            raise Fault("unexpected_character", start)
        if wants in ("key", "first key") and kind == "string":
            name = json.loads(token)
            if name in open_[-1][1]:
                raise Fault("repeated_key", start)
            open_[-1][1].add(name)
            path, wants = f"{open_[-1][3]}.{name}", "colon"
            continue
        if wants == "colon" and token == ":":
            wants = "value"
            continue
        if wants in ("value", "first value") and kind != "mark":
            if kind == "word" and token not in WORDS:
                raise Fault("not_finite" if token in NO_NUMBERS else "unexpected_character", start)
            yield path, WORDS.get(token, kind) if kind == "word" else kind, json.loads(token) if kind == "string" else token, token
        elif wants in ("value", "first value") and token in "{[":
            is_object = token == "{"
            open_.append([is_object, set() if is_object else None, 0, path])
            path, wants = (path, "first key") if is_object else (f"{path}[0]", "first value")
            continue
        elif token in "}]" and open_ and (token == "}") == open_[-1][0] and wants in ("comma", "first key" if token == "}" else "first value"):
            closed = open_.pop()
            if wants != "comma":
                yield closed[3], "object" if closed[0] else "array", "{}" if closed[0] else "[]", "{}" if closed[0] else "[]"
        elif wants == "comma" and token == ",":
            top = open_[-1]
            if top[0]:
                wants = "key"
            else:
                top[2] += 1
                path, wants = f"{top[3]}[{top[2]}]", "value"
            continue
        else:
            raise Fault("unexpected_character", start)
        wants = "comma" if open_ else "end"


def strict(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, leaves, fault, at: the leaves of each document, or its first fault and the character it is at (from 0).

    document: a string, or bytes, which must be UTF-8 without a mark in front. Null has neither leaves nor a fault."""

    @F.pandas_udf(f"struct<{', '.join(re.sub(r'^(\w+) ', r'\1: ', c) for c in LEAVES.split(', '))}>")
    def read(documents):
        import pandas as pd

        def one(text):
            if text is None:
                return None, None, None
            if isinstance(text, bytes | bytearray):
                try:
                    text = bytes(text).decode("utf-8")
                except UnicodeDecodeError as e:
                    return None, "not_utf8", e.start
            try:
                return list(leaves(text)), None, None
            except Fault as e:
                return None, str(e), e.at

        return pd.DataFrame([one(d) for d in documents], columns=["leaves", "fault", "at"], dtype=object)

    return rows.select(key, read(F.col(document)).alias("r")).select(key, "r.*")


def tree_keys(rows: DataFrame, key: str, tree: str, aliases: tuple[str, ...] = ("identifier", "rcode", "resource_code", "identifierref", "href"), children: str = "children") -> DataFrame:
    """key, path, depth, kind, title, basis, alias, entity_key, parent_key of every object in a forest.

    tree: a VARIANT array of objects that hold arrays of objects under `children`; what is no object has no key, and
    keeps its place. A node's path is the places from the root on. Its entity key comes from the first alias that it
    has, else from path, kind and title. Each round opens one level of all trees; the depth is not fixed, and a level
    is a table, so neither a wide nor a deep tree is held in one task."""
    level = rows.select(key, F.posexplode(F.expr(f"try_variant_get(`{tree}`, '$', 'array<variant>')")).alias("at", "node")).select(
        key, F.col("at").cast("string").alias("path"), F.lit(0).alias("depth"), "node", F.lit(None).cast("string").alias("parent_key")
    )

    def named(level: DataFrame) -> DataFrame:
        def field(name: str) -> Column:
            return F.coalesce(F.trim(F.expr(f"try_variant_get(node, '$.{name}', 'string')")), F.lit(""))

        objects = level.filter("schema_of_variant(node) LIKE 'OBJECT<%'").withColumns({"kind": field("kind"), "title": field("title")})
        fallback = F.struct(F.lit("path").alias("namespace"), F.concat_ws("|", "path", "kind", "title").alias("value"))
        first = F.coalesce(keys.first_alias([(a, field(a)) for a in aliases]), fallback)
        kind = F.concat(F.lit("structure:"), F.when(F.col("kind") == "", "unknown").otherwise(F.col("kind")))
        of = objects.withColumn("a", first).withColumn("entity_key", keys.digest(F.col(key).cast("string"), kind, F.col("a.namespace"), F.col("a.value"), length=24))
        return kept(of.select(key, "path", "depth", "kind", "title", F.col("a.namespace").alias("basis"), F.col("a.value").alias("alias"), "entity_key", "parent_key", "node"))

    out = found = named(level)
    while True:
        opened = found.select(key, "path", "depth", "entity_key", F.posexplode(F.expr(f"try_variant_get(node, '$.{children}', 'array<variant>')")).alias("at", "child"))
        level = opened.select(key, F.concat_ws("/", "path", F.col("at").cast("string")).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("child").alias("node"), F.col("entity_key").alias("parent_key"))
        found = named(level)
        if found.isEmpty():
            return out.drop("node")
        out = out.unionByName(found)
