"""Functions over markup that the JVM has no built-in for: Arrow-batched scalar UDFs."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mathlines

# Elements whose edges separate words.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "header", "footer"}


def unescape_all(text: str | None) -> str:
    """Entities decoded until nothing changes."""
    current = text or ""
    while (after := html.unescape(current)) != current:
        current = after
    return current


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "img":
            self.parts.append(f" {image_text(given)} ")
        elif tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        self.parts.append(data)


def image_text(attributes: dict) -> str:
    """What an image of a formula says: its MathML, else its alternative or title text."""
    formula = attributes.get("data-mathml") or ""
    return linear_math(formula) or mathlines.spoken(attributes.get("alt") or attributes.get("title") or attributes.get("data-original-title"))


def render_html(text: str | None) -> str:
    parser = _Text()
    parser.feed(unescape_all(text))
    parser.close()
    return mathlines.inline(" ".join(parser.parts))


def parsed(markup: str | bytes) -> ElementTree.Element:
    """The root of XML that declares no entities, so that nothing in it can grow."""
    if b"<!DOCTYPE" in (markup if isinstance(markup, bytes) else markup.encode()).upper():
        raise ElementTree.ParseError("document type declarations are not read")
    return ElementTree.fromstring(markup)


def linear_math(markup: str | None) -> str:
    """MathML on one line, typed with its own brackets or with substitutes for them; empty if it is not well-formed."""
    typed = (markup or "").translate({ord("«"): "<", ord("»"): ">", ord("¨"): '"'})
    try:
        return _math(parsed(html.unescape(re.sub(r"§(?=#|lt;|gt;|amp;)", "&", typed))))
    except ElementTree.ParseError:
        return ""


def _fenced(node, parts: list[str]) -> str:
    separator = node.get("separators", ",")[:1]
    return node.get("open", "(") + (f"{separator} " if separator else ", ").join(filter(None, parts)) + node.get("close", ")")


def _low(base: str, text: str, form: str = "lowered") -> str:
    """base with text as an index or an exponent."""
    return base + (mathlines.script(text, form) or ("_" if form == "lowered" else "^") + mathlines.bracketed(text))


def _exponent(base: str, text: str) -> str:
    return base + raised if (raised := mathlines.script(text, "raised")) else f"{mathlines.bracketed(base)}^{mathlines.bracketed(text)}"


#: What an element of so many parts says; others say their parts in a row.
_LAYOUTS = {
    ("mfrac", 2): lambda a, b: f"{mathlines.bracketed(a)}/{mathlines.bracketed(b)}",
    ("msup", 2): _exponent,
    ("msub", 2): _low,
    ("msubsup", 3): lambda a, b, c: _low(_low(a, b), c, "raised"),
    ("mroot", 2): lambda a, b: f"{mathlines.bracketed(b)}√{mathlines.bracketed(a)}",
    ("mover", 2): lambda a, b: f"{a}^{mathlines.bracketed(b)}",
    ("munder", 2): lambda a, b: f"{a}_{mathlines.bracketed(b)}",
    ("munderover", 3): lambda a, b, c: f"{a}_{mathlines.bracketed(b)}^{mathlines.bracketed(c)}",
}


def _math(node) -> str:
    name = node.tag.rpartition("}")[2]
    if name.startswith("annotation"):
        return ""
    if name == "mo":
        return mathlines.operator("".join(node.itertext()))
    if name in ("mi", "mn", "mtext", "ms") or not len(node):
        return mathlines.inline("".join(node.itertext()))
    if name == "mtable":
        rows = [[_math(cell) for cell in row if cell.tag.endswith("mtd")] for row in node if row.tag.endswith("mtr")]
        return mathlines.inline("[" + " ; ".join(", ".join(filter(None, row)) for row in rows) + "]")
    parts = [_math(child) for child in node]
    if name == "semantics":
        return next(filter(None, parts), "")
    if name == "mfenced":
        return mathlines.inline(_fenced(node, parts))
    if name == "msqrt":
        return mathlines.inline(f"√{mathlines.bracketed(' '.join(filter(None, parts)))}")
    layout = _LAYOUTS.get((name, len(parts)))
    return mathlines.inline(layout(*parts) if layout else " ".join(filter(None, parts)))


#: Texts of a batch that are Python's strings at a time; the rest stays in Arrow's buffers.
AT_ONCE = 64


def _over_strings(function):
    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        pieces = (texts.slice(i, AT_ONCE).to_pylist() for i in range(0, len(texts), AT_ONCE))
        done = [pa.array([None if t is None else function(t) for t in piece], pa.string()) for piece in pieces]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return apply


def unescaped(text: Column) -> Column:
    return _over_strings(unescape_all)(text)


def html_text(text: Column) -> Column:
    return _over_strings(render_html)(text)


def math_text(text: Column) -> Column:
    return _over_strings(linear_math)(text)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Gestalt similarity of two texts (not symmetric), 0 to 1; 0 where the characters alone rule out `least`."""

    def score(p: str, q: str) -> float:
        compared = SequenceMatcher(None, p, q)
        return compared.ratio() if compared.real_quick_ratio() >= least and compared.quick_ratio() >= least else 0.0

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype=float)

    return apply(a, b)
