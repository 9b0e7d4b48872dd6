"""Column expressions over records of reviewed questions: raw response models, aliases, feedback, references and rich text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a path that is not shown, formats of rich text, and what a flat row must not give away.
WITHHELD = "[absolute local path withheld]"
FORMATS = ["html", "xhtml", "plain_text", "mathml", "latex"]
PRIVATE = "absolute_path"
PRIVATE_KEYS = ["source_response_facts"]


def local_reference(value: Column) -> Column:
    """A reference as it may be shown: of absolute local paths and file URLs the last name alone; null and empty stay."""
    path = F.when(value.rlike("(?i)^file:"), F.regexp_replace(F.regexp_replace(value, r"(?i)^file:(//[^/?#]*)?", ""), r"[?#].*$", "")).when(value.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)"), F.replace(value, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(path.isNull(), value).when(name == "", WITHHELD).otherwise(F.concat(F.lit(WITHHELD + "/"), name))


def match_state(bound: Column, observed: Column) -> Column:
    """The recorded state of a match, else the observed one."""
    return F.coalesce(F.nullif(bound, F.lit("")), F.nullif(observed, F.lit("")), F.lit("not_recorded"))


def safe_row(row: Column) -> Column:
    """A row (a map by column) without absolute paths and source facts."""
    return F.map_filter(row, lambda k, _: ~k.contains(PRIVATE) & ~k.isin(PRIVATE_KEYS))


def canonical_payloads(models: Column, prefix: str) -> Column:
    """Payloads (maps) of the raw models, array<struct<source_kind, payload>>, that come from rows of one producer; none for null."""
    kept = F.filter(F.coalesce(models, F.slice(models, 1, 0)), lambda m: F.coalesce(m["source_kind"].startswith(prefix), F.lit(False)) & m["payload"].isNotNull())
    return F.transform(kept, lambda m: m["payload"])


def payload_digest(payload: Column) -> Column:
    """A digest of a payload's safe fields, whatever their order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(safe_row(payload))))), 256)


def fidelity(payloads: Column) -> Column:
    """struct<authored_variant_count, variant_conflict>: how many different questions the payloads describe."""
    n = F.size(F.array_distinct(F.transform(payloads, payload_digest)))
    return F.struct(n.alias("authored_variant_count"), (n > 1).alias("variant_conflict"))


def feedback_text(feedback: Column) -> Column:
    """`channel: content` of each entry, array<struct<channel, content>>, that says something, a line each."""
    said = F.filter(feedback, lambda f: F.coalesce(f["content"], F.lit("")) != "")
    return F.coalesce(F.array_join(F.transform(said, lambda f: F.concat(F.coalesce(F.nullif(f["channel"], F.lit("")), F.lit("feedback")), F.lit(": "), f["content"])), "\n"), F.lit(""))


def aliases_in(aliases: Column, namespace: str) -> Column:
    """Values of one namespace in order, array<struct<namespace, value>>; empty ones are none."""
    return F.transform(F.filter(aliases, lambda a: (a["namespace"] == namespace) & (F.coalesce(a["value"], F.lit("")) != "")), lambda a: a["value"])


def rich_text(value: Column, form: Column) -> Column:
    """struct<format, content, encoding, issue>: text in its format; LaTeX is plain text with its encoding told."""
    issue = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "text_missing").when(~F.coalesce(form.isin(FORMATS), F.lit(False)), "format_unknown")
    latex = form == "latex"
    given = issue.isNull()
    return F.struct(F.when(given, F.when(latex, "plain_text").otherwise(form)).alias("format"), F.when(given, value).alias("content"), F.when(given & latex, "latex").alias("encoding"), issue.alias("issue"))


def short_answer_agrees(values: Column, answer: Column, basis: Column, n_blanks: Column, blank_answers: Column, choices: Column) -> Column:
    """Whether a flat row says what a recognised short answer's values are: one blank, no choices, the values in order."""
    told = (answer == F.array_join(values, " || ")) & (basis == "text_entry") & (n_blanks == 1) & (blank_answers == F.concat(F.lit("Blank 1: "), F.array_join(values, " / ")))
    return F.coalesce(told & (F.coalesce(choices, F.lit("")) == "") & (F.size(values) > 0), F.lit(False))
