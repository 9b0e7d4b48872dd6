"""What reviewers read: labels, notes and states as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence levels and what they are called; statuses of matches.
LINK_LABELS = {"source_evidence": "Direct library link", "inferred_exact": "Linked by identical content", "inferred_similarity": "Possible link based on similar content", "unmatched": "No reliable library link found"}
MATCH_STATUSES = {"source_evidence": "direct", "inferred_exact": "inferred_exact", "inferred_similarity": "inferred_similarity", "unmatched": "unresolved"}
SHARED_CONTENT = "Multiple question-library items share this exact content inside one pool"
NOTES = {
    "unmatched": "No safe question-library location was found automatically.",
    "inferred_similarity": "The content matched strongly, but not by a direct library link.",
    "shared": "This question matched one question-library location, but more than one library item in that location shares the same content.",
}
ROOT_SECTION, ROOT_BANK, ROOT_LOCATION = "Quiz Root Wrapper", "Question Library Root Items", "Question Library root-level items"
FEEDBACK = ("General", "Correct", "Incorrect", "Answer-specific", "Notes")
LETTERS = "ABCDE"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def chosen(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    """What `names` calls a value."""
    out = otherwise
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def link_label(level: Column) -> Column:
    return chosen(_text(level), LINK_LABELS, _text(level))


def match_status(level: Column, status: Column) -> Column:
    """Ambiguous relations stay ambiguous whatever their evidence; unknown evidence is unknown."""
    return F.when(_text(status) == "ambiguous", "ambiguous").otherwise(chosen(_text(level), MATCH_STATUSES, F.lit("unknown")))


def section_label(title: Column) -> Column:
    """The title; a section that only wraps the whole has none."""
    return F.when(_text(title) == ROOT_SECTION, "").otherwise(_text(title))


def library_location(pool_ident: Column, bank: Column, pool: Column) -> Column:
    """Bank and pool, once where they are called the same; empty without a pool."""
    b, p = _text(bank), _text(pool)
    place = F.when((b != "") & (p != "") & (b != p), F.concat_ws(" > ", b, p)).when(b != "", b).otherwise(p)
    return F.when(_text(pool_ident) == "", "").when(place == ROOT_BANK, ROOT_LOCATION).otherwise(place)


def note(level: Column, match_note: Column, missing_images: Column) -> Column:
    """Why a match needs a look, and which images are missing."""
    said, missing = F.trim(_text(match_note)), F.trim(_text(missing_images))
    first = F.when(level == "unmatched", NOTES["unmatched"]).when(level == "inferred_similarity", NOTES["inferred_similarity"]).when(said.contains(SHARED_CONTENT), NOTES["shared"]).when(said != "", said)
    return F.concat_ws(" ", first, F.when(missing != "", F.concat(F.lit("Missing image refs: "), missing)))


def _listed(head: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n")))


def response_options(kind: Column, choices: Column, prompts: Column, options: Column) -> Column:
    """The options of a question, one a line; both sides of a matching one."""
    matching = F.concat_ws("\n\n", _listed("Prompt set:", prompts), _listed("Match options:", options))
    return F.when(kind == "Matching", matching).when(kind == "Ordering", F.coalesce(_listed("Items to order:", choices), F.lit(""))).otherwise(F.array_join(choices, "\n"))


def feedback_lines(*channels: Column) -> Column:
    """`Label: text` lines of the channels that say something, in their fixed order."""
    lines = [F.when(F.trim(_text(c)) != "", F.concat(F.lit(f"{name}: "), F.trim(_text(c)))) for name, c in zip(FEEDBACK, channels, strict=True)]
    return F.concat_ws("\n", *lines)


def location(quiz: Column, section_path: Column, number: Column) -> Column:
    """Quiz / section / item, `quiz root` where the section has no label."""
    place = section_label(section_path)
    item = F.when(_text(number) != "", F.concat(F.lit("item "), _text(number)))
    return F.concat_ws(" / ", F.nullif(_text(quiz), F.lit("")), F.when(place == "", "quiz root").otherwise(place), item)


def image_states(n_given: Column, refs: Column, resolved: Column, missing: Column, included: Column) -> list[Column]:
    """n_images, image_status (none, resolved, partially resolved, missing) and image_included (none, no, partially, yes)."""
    n = F.coalesce(n_given, F.lit(0))
    n = F.when(n == 0, F.size(refs)).otherwise(n)
    status = F.when(n == 0, "none").when((F.size(missing) > 0) & (F.size(resolved) > 0), "partially resolved").when(F.size(missing) > 0, "missing").otherwise("resolved")
    kept = F.when(n == 0, "none").when(F.size(included) == 0, "no").when(F.size(included) < n, "partially").otherwise("yes")
    return [n.cast("long").alias("n_images"), status.alias("image_status"), kept.alias("image_included")]


def section_title(title: Column, ordinal: Column) -> Column:
    """A section's number and title; a title that says nothing is left out."""
    said, n = F.trim(F.regexp_replace(_text(title), r"\s+", " ")), ordinal.cast("string")
    bare = F.lower(said).isin("", "section", "quiz section")
    return F.when(bare & n.isNull(), "Unsectioned questions").when(bare, F.concat(F.lit("Section "), n)).when(n.isNull(), said).otherwise(F.concat(F.lit("Section "), n, F.lit(" · "), said))


def preview(text: Column, most: int = 96) -> Column:
    """The text without tags on one line, shortened with an ellipsis; `Question detail` if nothing is left."""
    line = F.trim(F.regexp_replace(F.regexp_replace(_text(text), "<[^>]*>", " "), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("…"))
    return F.when(line == "", "Question detail").when(F.length(line) > most, cut).otherwise(line)


def plain_decimal(value: Column) -> Column:
    """A number without trailing zeros; other texts as they are."""
    said = F.trim(_text(value))
    shorter = F.regexp_replace(F.regexp_replace(said, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(said.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), shorter).otherwise(said)


def points(observed: Column, maximum: Column) -> Column:
    """Points as shown: all of several observed ones, else the maximum, else `not recorded`."""
    several = F.concat(F.array_join(observed, " / "), F.lit(" (varies by placement)"))
    return F.when(F.size(observed) > 1, several).when(maximum.isNotNull(), plain_decimal(maximum)).otherwise("not recorded")


def header(text: Column) -> Column:
    """A column's name: trimmed, lower case, underscores for blanks and hyphens."""
    return F.translate(F.lower(F.trim(_text(text))), " -", "__")


def safe_ident(text: Column, prefix: str = "ID") -> Column:
    """Upper-case letters and digits with single underscores, after the prefix where it would start with a digit."""
    out = F.regexp_replace(F.regexp_replace(F.upper(_text(text)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(out == "", prefix).when(out.rlike(r"^\p{N}"), F.concat(F.lit(prefix + "_"), out)).otherwise(out)


def bank_id(code: Column, entity_key: Column, draw: Column) -> Column:
    """The permanent code, or the end of the key, in safe characters; a numbered name if nothing is left."""
    given = F.when(_text(code) != "", code).otherwise(F.element_at(F.split(entity_key, ":"), -1))
    out = F.regexp_replace(F.regexp_replace(given, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(out != "", out).otherwise(F.concat(F.lit("POOL_"), draw.cast("string")))


def named_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    sha = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(sha, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.concat(F.lit("5"), F.substring(sha, 14, 3)), F.concat(variant, F.substring(sha, 18, 3)), F.substring(sha, 21, 12))


def answer_letters(kind: Column, keys: Column, expected: Column, options: Column) -> Column:
    """The letters of the right options, sorted: A or B for true or false, those that are named, or those whose text is expected."""
    named = F.array_distinct(F.filter(F.transform(F.split(F.replace(_text(keys), F.lit(","), F.lit(";")), ";"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    same = F.filter(F.transform(options, lambda o, i: F.when(F.lower(F.trim(_text(o))) == F.lower(F.trim(_text(expected))), F.substring(F.lit(LETTERS), i + 1, F.lit(1)))), lambda x: x.isNotNull())
    of_bool = F.when(F.arrays_overlap(named, F.array(*map(F.lit, ("TRUE", "T", "YES")))), F.array(F.lit("A"))).when(F.arrays_overlap(named, F.array(*map(F.lit, ("FALSE", "F", "NO")))), F.array(F.lit("B")))
    rest = F.when(F.size(named) > 0, F.array_sort(named)).when(F.trim(_text(expected)) != "", same).otherwise(F.array().cast("array<string>"))
    return F.when((kind == "TRUEFALSE") & of_bool.isNotNull(), of_bool).otherwise(rest)


def utc_timestamp(text: Column) -> Column:
    """An ISO time with a zone as UTC ending in Z; null where there is no zone or no time."""
    said = F.trim(_text(text))
    return F.when(said.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), F.date_format(F.try_to_timestamp(F.replace(said, F.lit("Z"), F.lit("+00:00"))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def strict_boolean(text: Column) -> Column:
    """TRUE or FALSE in any case; null otherwise."""
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def is_code(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))


def coerced_setting(name: Column, value: Column) -> Column:
    """A known setting's value in its kind (switches, attempts from 1, minutes from 0), as text; null where it does not fit."""
    switch = name.isin("is_active", "show_clock", "enforce_time_limit", "is_forward_only", "randomize_answers")
    whole = F.when(F.trim(value).rlike("^[0-9]{1,9}$"), F.trim(value).cast("int"))
    flag = F.when(F.lower(F.trim(value)).isin("true", "yes", "1"), "true").when(F.lower(F.trim(value)).isin("false", "no", "0"), "false")
    return F.when(switch, flag).when(name == "attempts_allowed", F.when(whole >= 1, whole.cast("string"))).when(name == "time_limit", whole.cast("string"))


def images(html: Column) -> Column:
    """Image tags of markup."""
    return F.regexp_extract_all(_text(html), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))


def images_without_alt(html: Column) -> Column:
    """The sources of images that have no text in alt, in order; a fixed phrase where the source is missing too."""
    without = F.filter(images(html), lambda x: ~x.rlike(r"(?is)\balt\s*=\s*(\"[^\"]*[^\"\s][^\"]*\"|'[^']*[^'\s][^']*')"))
    source = r"(?is)\bsrc\s*=\s*[\"']([^\"']*)[\"']"
    return F.transform(without, lambda x: F.when(F.trim(F.regexp_extract(x, source, 1)) == "", "(image src not found)").otherwise(F.trim(F.regexp_extract(x, source, 1))))


def redacted(text: Column, *patterns: str) -> Column:
    """The text, or a digest of it where a pattern says that it must not be shown."""
    shown = F.lit(False)
    for p in patterns:
        shown = shown | text.rlike(p)
    return F.when(shown, F.concat(F.lit("redacted-reference:"), F.substring(F.sha2(text, 256), 1, 16))).otherwise(text)


def replaced_uri(html: Column, original: str, replacement: str) -> tuple[Column, Column]:
    """html with attributes that name the original file naming the other one (query and fragment stay), and how many did."""
    found = r"(?i)(\b(?:src|href|data|poster|background)\s*=\s*)([\"'])\Q" + original + r"\E([?#][^\"']*)?\2"
    return F.regexp_replace(html, found, "$1$2" + replacement + "$3$2"), F.regexp_count(html, F.lit(found))
