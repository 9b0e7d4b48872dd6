"""Scans for sensitive content: text by lines, JSON by paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rules and their patterns, which RE2 and Java read alike.
RULES = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ \-][0-9]{3}[ \-][0-9]{4}",
    "secret": r"(?:password|api_key|secret|token) ?[=:] ?[^ ]{6,}",
    "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def scan_lines(rows: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """One row for each line and rule that matches it: key, line_number (from 1), rule, n_found."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    counted = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count("line", F.lit(p)).alias("n_found")) for k, p in (rules or RULES).items()])
    return lines.withColumn("r", F.explode(counted)).filter("r.n_found > 0").select(key, (F.col("at") + 1).alias("line_number"), "r.rule", "r.n_found")


def scan_bytes(rows: DataFrame, key: str, content: str, rules: dict[str, str] | None = None) -> DataFrame:
    """One row for each file and rule that matches its bytes, read as UTF-8 or as UTF-16; what is no text in either is passed over."""

    @F.pandas_udf("struct<narrow:string,wide:string>")
    def readings(contents):
        import pandas as pd

        held = [b"" if c is None else bytes(c) for c in contents]
        return pd.DataFrame({"narrow": [c.decode("utf-8", "ignore") for c in held], "wide": [c.decode("utf-16-le", "ignore") for c in held]})

    read = rows.select(key, readings(F.col(content)).alias("t"))
    counted = F.array(*[F.struct(F.lit(k).alias("rule"), F.greatest(F.regexp_count("t.narrow", F.lit(p)), F.regexp_count("t.wide", F.lit(p))).alias("n_found")) for k, p in (rules or RULES).items()])
    return read.withColumn("r", F.explode(counted)).filter("r.n_found > 0").select(key, "r.rule", "r.n_found")


def json_leaves(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, value of every leaf of JSON documents, at any depth; documents that do not parse have one row with path null."""
    schema = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))

    @F.pandas_udf(schema)
    def leaves(documents):
        import json

        import pandas as pd

        def walk(value, path: str):
            if isinstance(value, dict):
                for name, inner in value.items():
                    yield from walk(inner, f"{path}.{name}")
            elif isinstance(value, list):
                for i, inner in enumerate(value):
                    yield from walk(inner, f"{path}[{i}]")
            else:
                yield path, value if isinstance(value, str) else json.dumps(value)

        def one(text):
            if text is None:
                return []
            try:
                return list(walk(json.loads(text), "$"))
            except ValueError:
                return [(None, text)]

        return pd.Series([one(d) for d in documents], dtype=object)

    return rows.select(key, F.explode(leaves(F.col(document))).alias("l")).select(key, "l.path", "l.value")
