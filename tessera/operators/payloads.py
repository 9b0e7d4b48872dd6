"""Typed payloads of questions: options, accepted answers, blanks, pairs and order of a flat row, by its kind, as a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import values

# Which parts a kind's payload must have, and which it may not.
CHOICE_KINDS = ["multiple_choice", "multi_select", "true_false"]
ACCEPTING_KINDS = ["short_answer", "multi_short_answer", "fill_in_blanks"]
SHAPES = {
    "multiple_choice": ("options", "one_correct"), "true_false": ("options", "one_correct"), "multi_select": ("options", "some_correct"), "short_answer": ("accepted_responses",),
    "multi_short_answer": ("accepted_responses",), "fill_in_blanks": ("blanks",), "matching": ("match_pairs",), "ordering": ("correct_order",), "long_answer": (),
}


def option_key(place: Column) -> Column:
    """A to Z, then OPT_27 and so on; place counts from 0."""
    return F.when(place < 26, F.chr(place + 65)).otherwise(F.concat(F.lit("OPT_"), (place + 1).cast("string")))


def typed(rows: DataFrame, kind: str, choices: str, answers: str, blanks: str, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Adds payload (a VARIANT), shape_issues (an array of codes) and key_basis.

    choices, answers, blanks: texts of values separated by ` || `. A pair is written `left -> right`, a blank `name: answer`;
    what has no mark is no pair, or a bare answer. keys: `key` and right_places, an array of the right choices' places from 0,
    where the scoring has a closed form; elsewhere a choice's correct is null, and an issue tells of it. Without keys a choice
    is right where its text is an answer. Choices repeated in a row stay apart by their places."""
    text = {n: F.coalesce(values(F.col(c)), F.array().cast("array<string>")) for n, c in (("choices", choices), ("answers", answers), ("blanks", blanks))}
    out = rows.withColumns({f"__{n}": c for n, c in text.items()})
    if keys is None:
        right = lambda x, i: F.array_contains("__answers", x)
        out = out.withColumn("key_basis", F.lit("text"))
    else:
        out = out.join(keys.select(key, F.col("right_places").alias("__right")), key, "left").withColumn("key_basis", F.when(F.col("__right").isNotNull(), "scoring").otherwise("unresolved"))
        right = lambda x, i: F.array_contains("__right", i)
    a, k = F.col("__answers"), F.col(kind)
    none = lambda c: F.slice(c, 1, 0)
    option = F.transform("__choices", lambda x, i: F.struct(option_key(i).alias("option_key"), x.alias("content"), right(x, i).alias("correct")))
    accepted = F.transform(F.when(k.isin(ACCEPTING_KINDS), a).otherwise(none(a)), lambda x: F.struct(x.alias("value")))
    blank = F.transform("__blanks", lambda x, i: F.struct(F.concat(F.lit("blank-"), (i + 1).cast("string")).alias("blank_key"), F.trim(F.when(x.contains(":"), F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).otherwise(x)).alias("answer")))
    paired = F.filter(F.when(k == "matching", a).otherwise(none(a)), lambda x: x.contains(" -> "))
    pair = F.transform(paired, lambda x: F.struct(F.regexp_extract(x, r"(?s)^(.*?) -> (.*)$", 1).alias("left_key"), F.regexp_extract(x, r"(?s)^(.*?) -> (.*)$", 2).alias("right_key")))
    order = F.transform(F.when(k == "ordering", a).otherwise(none(a)), lambda x, i: F.struct(x.alias("option_key"), (i + 1).alias("position")))
    out = out.withColumn("__p", F.struct(option.alias("options"), accepted.alias("accepted_responses"), blank.alias("blanks"), pair.alias("match_pairs"), order.alias("correct_order")))
    n_right = F.size(F.filter("__p.options", lambda x: F.coalesce(x["correct"], F.lit(False))))
    holds = {"one_correct": n_right == 1, "some_correct": n_right > 0} | {part: F.size(f"__p.{part}") > 0 for part in ("options", "accepted_responses", "blanks", "match_pairs", "correct_order")}
    broken = [F.when((k == name) & ~holds[part], f"{part}_missing") for name, parts in SHAPES.items() for part in parts]
    broken += [F.when(~k.isin(list(SHAPES)) | k.isNull(), "unknown_kind"), F.when(k.isin(CHOICE_KINDS) & (F.col("key_basis") == "unresolved"), "key_unresolved"), F.when((k == "matching") & (F.size(paired) < F.size(a)), "pair_without_mark")]
    issues = F.array_sort(F.filter(F.array(*broken), lambda x: x.isNotNull()))
    return out.select(*rows.columns, F.expr("to_variant_object(__p)").alias("payload"), issues.alias("shape_issues"), "key_basis")
