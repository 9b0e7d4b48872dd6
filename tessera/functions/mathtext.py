"""Spoken and typed mathematics as columns: Arrow-batched functions over `mathlines`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mathlines


def _over(function, text: Column) -> Column:
    """function over the texts; null stays null."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return apply(text)


def inline(text: Column) -> Column:
    """Blanks as print has them: none before , . ; : ! ? or inside brackets, one around operators, none at a sign."""
    return _over(mathlines.inline, text)


def symbols(text: Column) -> Column:
    """Spoken mathematics in symbols, fractions of any depth."""
    return _over(mathlines.spoken, text)


def operator(text: Column) -> Column:
    """One sign for each operator."""
    return F.translate(F.trim(text), "".join(mathlines.OPERATORS), "".join(mathlines.OPERATORS.values()))


def _script(text: Column, forms: str) -> Column:
    return F.when(text.rlike(r"^[0-9+\-=()n]+$"), F.translate(text, mathlines.PLAIN, forms))


def raised(text: Column) -> Column:
    """Superscript characters; null where some character has none."""
    return _script(text, mathlines.RAISED)


def lowered(text: Column) -> Column:
    return _script(text, mathlines.LOWERED)


def bracketed(text: Column) -> Column:
    """In parentheses unless it is one word or has them."""
    t = F.trim(text)
    return F.when((t == "") | t.rlike(r"^[A-Za-z0-9_.]+$") | t.rlike(r"^\(.*\)$"), t).otherwise(F.concat(F.lit("("), t, F.lit(")")))
