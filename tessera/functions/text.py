"""Text normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken forms and what they stand for, applied in this order.
SPOKEN_FORMS = [
    ("open parentheses", "("),
    ("close parentheses", ")"),
    ("left parenthesis", "("),
    ("right parenthesis", ")"),
    ("x-axis", "x axis"),
    ("y-axis", "y axis"),
    ("one third", "1 third"),
    ("1 third", "1/3"),
    ("equals", "="),
    ("plus", "+"),
    ("minus", "-"),
    ("times", "x"),
    ("multiplied by", "x"),
    ("squared", "^2"),
    ("cubed", "^3"),
]
CURLY, STRAIGHT = "‘’“”–— ", "''\"\"-- "
YES = ("TRUE", "YES", "Y", "1")


def squeeze(text: Column) -> Column:
    """Runs of white space (Unicode) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def exact_key(text: Column) -> Column:
    """Lower case, straight quotes and dashes, squeezed: equal keys mean equal content."""
    return squeeze(F.translate(F.lower(text), CURLY, STRAIGHT))


def similarity_key(text: Column) -> Column:
    """The exact key with spoken forms as symbols, then only a-z, 0-9 and single blanks."""
    key = exact_key(text)
    for spoken, symbol in SPOKEN_FORMS:
        key = F.replace(key, F.lit(spoken), F.lit(symbol))
    return F.trim(F.regexp_replace(key, "[^a-z0-9]+", " "))


def without_tags(html: Column, scripts: bool = True) -> Column:
    """Markup as plain text, entities as they are; without `scripts`, script and style bodies go first."""
    if not scripts:
        html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def local_refs(html: Column) -> Column:
    """Distinct sorted src and href values that stay inside the package, without query and fragment."""
    refs = F.regexp_extract_all(html, F.lit(r"(?i)(?:src|href)\s*=\s*\"([^\"]*)\""), F.lit(1))
    cut = F.transform(refs, lambda x: F.regexp_replace(x, r"[?#].*$", ""))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda x: (x != "") & ~x.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)"))))


def values(text: Column, separator: str = " || ") -> Column:
    """Parts between separators, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, "\\Q" + separator.strip() + "\\E"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def unique_values(array: Column) -> Column:
    """Non-empty values once each, in their first order."""
    return F.array_distinct(F.filter(array, lambda x: x != ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truthy(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin(*YES), F.lit(False))


def plain_number(text: Column) -> Column:
    """Trimmed; an integer written with .0 loses it."""
    return F.regexp_replace(F.trim(text), r"^(-?\d+)\.0$", "$1")


def scalar_kind(text: Column) -> Column:
    """boolean, integer, decimal, text or empty, by the first reading that fits."""
    value = F.lower(F.trim(text))
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(value.isin("yes", "true", "no", "false"), "boolean")
        .when(value.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(value.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal")
        .otherwise("text")
    )


def scalar_value(text: Column) -> Column:
    """The value in one spelling: true or false, a number without its plus sign, else the trimmed text."""
    value = F.trim(text)
    low = F.lower(value)
    return F.when(low.isin("yes", "true"), "true").when(low.isin("no", "false"), "false").when(scalar_kind(text).isin("integer", "decimal"), F.regexp_replace(value, r"^\+", "")).otherwise(value)


def package_path(ref: Column) -> Column:
    """A reference as a path inside the package: no scheme, host, query or fragment, single slashes."""
    path = F.regexp_replace(F.replace(F.trim(ref), F.lit("\\"), F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    path = F.regexp_replace(F.regexp_replace(path, r"[#?].*$", ""), "/+", "/")
    return F.regexp_replace(path, r"^(\./)?/?", "")


def safe_member(path: Column) -> Column:
    """Whether a path stays inside its archive."""
    return (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|%2[fF]|%5[cC]|%00")
