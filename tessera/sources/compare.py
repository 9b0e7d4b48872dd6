"""Two exports against each other, and one against the rules: breaks, notes and issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import changes, rules
from tessera.operators.graph import kept

from . import packages, responses

MANIFEST, LIBRARY = "imsmanifest.xml", "questiondb.xml"


def paired(a: DataFrame, b: DataFrame, key: str, scope: list[str], identities: list[str], title: str, signature: str) -> DataFrame:
    """Rows of two sides as pairs: scope, a_key, b_key, title, state and matched_by; never a guess.

    Identities first, where a value is alone on both sides. The rest pairs by title where it is alone on both, else by title
    and signature. `missing` and `added` rows are on one side only; of an `ambiguous` class there is one row, with its least keys."""
    sides = [kept(x.select(*scope, F.col(key).alias(f"{s}_key"), F.col(title).alias("title"), F.col(signature).alias("signature"), *identities)) for s, x in (("a", a), ("b", b))]
    found = []
    if identities:
        pairs = kept(changes.pair_by(sides[0], sides[1], identities, "a_key", "b_key"))
        found.append(pairs.join(sides[0].select(*scope, "a_key", "title"), "a_key").select(*scope, "a_key", "b_key", "title", F.lit("paired").alias("state"), "matched_by"))
        sides = [x.join(pairs, f"{s}_key", "left_anti") for s, x in zip("ab", sides, strict=True)]

    def counted(x: DataFrame, side: str, by: list[str], name: str) -> DataFrame:
        return x.groupBy(*by).agg(F.count("*").alias(f"{name}_{side}"), F.min(f"{side}_key").alias(f"{name}_key_{side}"))

    def both(by: list[str], name: str) -> DataFrame:
        left, right = counted(sides[0], "a", by, name), counted(sides[1], "b", by, name)
        return left.join(right, by, "full_outer").fillna(0, [f"{name}_a", f"{name}_b"])

    titles, classes = both([*scope, "title"], "t"), both([*scope, "title", "signature"], "c")
    alone = titles.filter("t_a = 1 AND t_b = 1").select(*scope, F.col("t_key_a").alias("a_key"), F.col("t_key_b").alias("b_key"), "title", F.lit("paired").alias("state"), F.lit("title").alias("matched_by"))
    rest = kept(classes.join(titles.filter("t_a <> 1 OR t_b <> 1").select(*scope, "title"), [*scope, "title"]))
    two = (F.col("c_a") > 0) & (F.col("c_b") > 0)
    one = (F.col("c_a") == 1) & (F.col("c_b") == 1)
    met = rest.filter(two).select(*scope, F.col("c_key_a").alias("a_key"), F.col("c_key_b").alias("b_key"), "title", F.when(one, "paired").otherwise("ambiguous").alias("state"), F.when(one, "title+signature").alias("matched_by"))
    found += [alone, met]
    for s, state, none in (("a", "missing", "c_b = 0"), ("b", "added", "c_a = 0")):
        left = sides["ab".index(s)].join(rest.filter(none).select(*scope, "title", "signature"), [*scope, "title", "signature"], "left_semi")
        keys = [F.col("a_key") if s == "a" else F.lit(None).alias("a_key"), F.col("b_key") if s == "b" else F.lit(None).alias("b_key")]
        found.append(left.select(*scope, *keys, "title", F.lit(state).alias("state"), F.lit(None).cast("string").alias("matched_by")))
    return rules.union_all(found)


def _told(rows: DataFrame, kind: str, code: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("class"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _states(pairs: DataFrame, what: str) -> list[DataFrame]:
    """What is missing or ambiguous breaks; what was added is worth a note."""
    kinds = {"missing": "break", "ambiguous": "break", "added": "note"}
    return [_told(pairs.filter(F.col("state") == s), k, f"{what}_{s}", F.col("title"), F.lit("")) for s, k in kinds.items()]


def _changed(rows: DataFrame, kind: str, code: str, subject: str, name: str) -> DataFrame:
    """Rows whose a_ and b_ values of one name differ."""
    a, b = (F.col(f"{s}_{name}").cast("string") for s in "ab")
    return _told(rows.filter(~a.eqNullSafe(b)), kind, code, F.col(subject), F.concat_ws(" -> ", F.coalesce(a, F.lit("(absent)")), F.coalesce(b, F.lit("(absent)"))))


def diff(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """class (break or note), code, subject, detail: what differs between two models of `model.build`.

    Questions pair by alias, title, or title and signature; quizzes and their sections by title (a quiz that is alone on both
    sides pairs whatever its title). Breaks: whatever is missing or ambiguous, changed kinds, texts, keys, draws, points and
    members, missing assets of either side. Notes: what was added, other titles, and settings that differ."""
    out = []
    answered = [m["questions"].join(m["responses"].select("key", F.array_join("answers", "|").alias("answers")).dropDuplicates(["key"]), "key", "left") for m in (a, b)]
    pairs = kept(paired(*answered, "key", [], ["alias"], "title", "signature"))
    out += _states(pairs, "question")
    sides = [q.select(F.col("key").alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "signature", "answers")]) for s, q in zip("ab", answered, strict=True)]
    same = kept(pairs.filter("state = 'paired'").join(sides[0], "a_key").join(sides[1], "b_key"))
    out += [_changed(same, "break", f"question_{code}", "title", name) for code, name in (("kind", "kind"), ("text", "signature"), ("answers", "answers"))]
    quizzes = [m["quizzes"].withColumn("signature", F.lit("")) for m in (a, b)]
    if [q.count() for q in quizzes] == [1, 1]:
        (x, y) = (q.select(F.col("key").alias(f"{s}_key"), F.col("title").alias(f"{s}_title")) for s, q in zip("ab", quizzes, strict=True))
        alone = kept(x.join(y, x["a_title"].isNotNull() & y["b_title"].isNotNull()))  # one row each
        out.append(_changed(alone, "note", "quiz_title", "a_title", "title"))
        matched = alone.select("a_key", "b_key", F.col("a_title").alias("quiz"))
    else:
        found = kept(paired(*quizzes, "key", [], [], "title", "signature"))
        out += _states(found, "quiz")
        matched = found.filter("state = 'paired'").select("a_key", "b_key", F.col("title").alias("quiz"))
    matched = kept(matched)
    placed = []
    for s, m in zip("ab", (a, b), strict=True):
        files = m["quizzes"].select("snapshot", "file", F.col("key").alias(f"{s}_key")).join(matched, f"{s}_key")
        members = m["occurrences"].groupBy(F.col("structure").alias("key")).agg(F.count("*").alias("placed"))
        held = m["structures"].filter("kind IN ('draw', 'section')").join(members, "key", "left").join(files.select("snapshot", "file", "quiz"), ["snapshot", "file"])
        placed.append(held.select("quiz", "key", "title", F.lit("").alias("signature"), "requested", "weight", F.coalesce("placed", F.lit(0)).alias("members")))
        observed = m["settings"].join(files.select("snapshot", "file", "quiz"), ["snapshot", "file"]).groupBy("quiz", "name").agg(F.max_by("value", "place").alias(f"{s}_value"))
        placed.append(observed)
    sections = kept(paired(placed[0], placed[2], "key", ["quiz"], [], "title", "signature"))
    where = F.concat_ws(" > ", "quiz", "title").alias("title")
    out += _states(sections.select(where, "state"), "section")
    values = [x.select(F.col("key").alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in ("requested", "weight", "members")]) for s, x in (("a", placed[0]), ("b", placed[2]))]
    held = kept(sections.filter("state = 'paired'").join(values[0], "a_key").join(values[1], "b_key").withColumn("title", where))
    out += [_changed(held, "break", f"section_{code}", "title", name) for code, name in (("draw", "requested"), ("points", "weight"), ("members", "members"))]
    both = placed[1].join(placed[3], ["quiz", "name"], "full_outer").withColumn("subject", F.concat_ws(" > ", "quiz", "name"))
    out.append(_changed(both, "note", "setting", "subject", "value"))
    out += [_told(m["diagnostics"].filter("code = 'missing_asset'"), "break", f"missing_asset_{s}", F.col("entity_key"), F.col("detail")) for s, m in zip("ab", (a, b), strict=True)]
    return rules.union_all(out)


def validate(built: dict[str, DataFrame], nodes: DataFrame, files: DataFrame, library_only: bool = False) -> DataFrame:
    """severity, code, entity_key, detail: all that speaks against an export as a package: files that must be there and are not,
    broken files, listed files that are missing and files that no manifest lists, labels and native keys, and the model's diagnostics."""
    name = F.element_at(F.split("file", "/"), -1)
    of = files.groupBy("snapshot").agg(F.count_if(name == MANIFEST).alias(MANIFEST), F.count_if(name == LIBRARY).alias(LIBRARY), F.count_if(name.rlike(r"^quiz_.*\.xml$")).alias("quiz_*.xml"))
    required = [MANIFEST, LIBRARY] + ([] if library_only else ["quiz_*.xml"])
    lost = F.explode(F.filter(F.array(*[F.when(F.col(f"`{c}`") == 0, F.lit(c)) for c in required]), lambda x: x.isNotNull()))
    manifest = nodes.filter((F.element_at(F.split("file", "/"), -1) == MANIFEST) & F.col("tag").isin("resource", "file"))
    listed = manifest.select("snapshot", F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("attrs.href")).alias("file")).filter("file IS NOT NULL").distinct()
    unlisted = files.select("snapshot", "file").filter(name != MANIFEST).join(listed, ["snapshot", "file"], "left_anti")
    labels = responses.label_issues(nodes)
    return rules.union_all([
        rules.issues(of.select("snapshot", lost.alias("lost")), "error", "required_file", F.col("snapshot"), F.col("lost")),
        rules.issues(packages.missing_hrefs(nodes, files), "error", "missing_href", F.col("snapshot"), F.col("href")),
        rules.issues(unlisted, "warning", "unlisted_file", F.col("snapshot"), F.col("file")),
        rules.issues(labels, "error", "native_label", F.col("identity"), F.col("code")),
        built["diagnostics"],
    ])


def passes(issues: DataFrame) -> DataFrame:
    """One row: n_errors, n_warnings and whether the package passes, which no error lets it."""
    n = issues.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    return n.withColumn("passes", F.col("n_errors") == 0)
