"""Plain Python versions of what the operators compute, and awkward documents."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, segment string, h long, level int, taken string"


def frame(spark, texts, schema: str = SCHEMA, **more):
    """documents with extra columns whose names clash with what operators use inside; texts: (doc_id, text)."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, f"s{(i or 0) % 3}"), len(t or ""), "x", 1, 2, None) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def awkward() -> list[tuple]:
    """Null and empty texts, blanks, ties, repeated rows, a long text, non-ASCII text."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    base = [f"alpha{i} beta{i % 7} gamma" for i in range(60)]
    texts = [None, "", "   \n\t", "one", "one two", "ONE two", "Ünï çödé ß 漢字 🙂", long, " ".join(base), " ".join(base), " ".join(base[:-1] + ["edited"])]
    return [(i, t) for i, t in enumerate(texts)] + [(8, " ".join(base)), (None, "no id here")]


def components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
