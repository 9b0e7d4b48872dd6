"""Settings of quizzes as observed in their XML, what may be shown of them, and which of them hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import labels, text

# Settings that are never shown, elements that hold them, and the settings that quizzes and questions may have.
SENSITIVE = ["password"]
HOLDERS = ["assess_procextension", "assessfeedback"]
HIDDEN = "[redacted]"
QUIZ_DEFAULTS = {"is_active": "false", "attempts_allowed": "1", "time_limit": "0", "show_clock": "false", "enforce_time_limit": "false", "is_forward_only": "false"}
QUESTION_SETTINGS = ["randomize_answers"]


def observed(nodes: DataFrame) -> DataFrame:
    """snapshot, file, place, name, raw, kind, value, source_kind, is_sensitive: each setting of a file's first assessment in document order.

    Attributes of assessmentcontrol come by name; elements of the holders with their text, and where they have attributes
    as JSON of value and attributes, whose value is that JSON again. Sensitive values are redacted, as is what they normalize to."""
    key = ["snapshot", "file"]
    first = nodes.filter("tag = 'assessment'").groupBy(*key).agg(F.min("node_id").alias("parent_id"))
    blocks = nodes.filter(F.col("tag").isin("assessmentcontrol", *HOLDERS)).join(first, [*key, "parent_id"], "left_semi")
    control = blocks.filter("tag = 'assessmentcontrol'").select(*key, F.col("node_id").alias("block"), F.explode("attrs").alias("name", "raw"))
    control = control.select(*key, "block", F.lit(0).cast("long").alias("node"), "name", "raw", F.lit("assessmentcontrol.attribute").alias("source_kind"), F.lit(False).alias("is_nested"))
    holders = blocks.filter(F.col("tag").isin(HOLDERS)).select(*key, F.col("node_id").alias("parent_id"), F.col("tag").alias("source_kind"))
    inner = F.trim(F.coalesce("text", F.lit("")))
    nested = F.size("attrs") > 0
    raw = F.when(nested, F.to_json(F.struct(inner.alias("value"), F.col("attrs").alias("attributes")))).otherwise(inner)
    held = nodes.join(holders, [*key, "parent_id"]).select(*key, F.col("parent_id").alias("block"), F.col("node_id").alias("node"), F.col("tag").alias("name"), raw.alias("raw"), "source_kind", nested.alias("is_nested"))
    sensitive = F.lower("name").isin(SENSITIVE) & (F.col("source_kind") != "assessmentcontrol.attribute")
    found = control.unionByName(held).withColumn("is_sensitive", sensitive)
    shown = found.withColumns({
        "value": F.when(F.col("is_sensitive"), HIDDEN).when(F.col("is_nested"), F.col("raw")).otherwise(text.scalar_value(F.col("raw"))),
        "kind": F.when(F.col("is_sensitive"), "redacted").when(F.col("is_nested"), "nested").otherwise(text.scalar_kind(F.col("raw"))),
        "raw": F.when(F.col("is_sensitive"), HIDDEN).otherwise(F.col("raw")),
    })
    place = F.struct("block", "node", "name").alias("place")
    return shown.select(*key, place, "name", "raw", "kind", "value", "source_kind", "is_sensitive")


def assessment_settings(nodes: DataFrame) -> DataFrame:
    """snapshot, file and settings: a map of the plain elements of assess_procextension, of several with one name the last."""
    key = ["snapshot", "file"]
    parents = nodes.select(*key, F.col("parent_id").alias("node_id")).distinct()
    first = nodes.filter("tag = 'assessment'").groupBy(*key).agg(F.min("node_id").alias("parent_id"))
    holders = nodes.filter("tag = 'assess_procextension'").join(first, [*key, "parent_id"], "left_semi").select(*key, F.col("node_id").alias("parent_id"))
    plain = nodes.join(holders, [*key, "parent_id"], "left_semi").join(parents, [*key, "node_id"], "left_anti")
    last = plain.groupBy(*key, "tag").agg(F.max_by(F.trim(F.coalesce("text", F.lit(""))), "node_id").alias("value"))
    return last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("settings"))


def effective(resolutions: DataFrame, defaults: dict[str, str], quizzes: DataFrame, question_settings: list[str]) -> tuple[DataFrame, DataFrame]:
    """Settings that hold for each quiz and question, and what speaks against the resolutions.

    resolutions: quiz, target, setting, state, value (a text), place. Those known and at their scope overlay the defaults
    of their quiz (quizzes: quiz); of several for one setting of one target the last by place holds, and
    values are coerced to their setting's kind. Rows: quiz, target, setting, value, origin (`default` or `receipt`).
    Issues: quiz, target, setting, code: `unknown_quiz`, `quiz_scope`, `question_scope`, `value` (cannot be coerced)."""
    known = resolutions.filter("state = 'known'")
    at_quiz = F.col("target").eqNullSafe(F.col("quiz"))
    fits = F.when(at_quiz, F.col("setting").isin(list(defaults))).otherwise(F.col("setting").isin(question_settings))
    value = labels.coerced_setting(F.col("setting"), F.col("value"))
    there = quizzes.select("quiz").distinct().withColumn("is_quiz", F.lit(True))
    judged = known.join(there, "quiz", "left").withColumn("coerced", value)
    code = F.when(F.col("is_quiz").isNull(), "unknown_quiz").when(~F.coalesce(fits, F.lit(False)), F.when(at_quiz, "quiz_scope").otherwise("question_scope")).when(F.col("coerced").isNull(), "value")
    judged = judged.withColumn("code", code)
    issues = judged.filter("code IS NOT NULL").select("quiz", "target", "setting", "code").distinct()
    given = judged.filter("code IS NULL").select("quiz", "target", "setting", F.col("coerced").alias("value"), F.lit(1).alias("rank"), "place", F.lit("receipt").alias("origin"))
    safe = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(v).alias("value")) for k, v in defaults.items()])).alias("d")
    base = quizzes.select("quiz").distinct().select("quiz", F.col("quiz").alias("target"), safe).select("quiz", "target", "d.*", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("place"), F.lit("default").alias("origin"))
    both = given.unionByName(base).groupBy("quiz", "target", "setting").agg(F.max_by(F.struct("value", "origin"), F.struct("rank", "place")).alias("h"))
    return both.select("quiz", "target", "setting", "h.value", "h.origin"), issues
