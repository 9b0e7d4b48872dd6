"""The model of an export: collections of entities with lasting keys, typed edges between them, and what is not sure about them.

Collections: sources, quizzes, structures, questions, feedback, responses, settings, assets, occurrences, relationships
and diagnostics. Edges: contains, itemref, member_of, draws_from, uses_asset, same_as; an edge that evidence does not
settle keeps its status and leads nowhere. All are joins and aggregates over the node table of one export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys, text
from tessera.operators import graph, identity, link, rules
from tessera.operators.graph import kept

from . import exports, responses, settings

FILE = ["snapshot", "file"]
ALIASES = ("displayid", "globalid", "label", "ident")


def _key(kind: str, namespace: Column, alias: Column) -> Column:
    return keys.entity_key(kind, F.col("snapshot"), F.lit(""), namespace, alias)


def _in_file(*parts: str) -> Column:
    return F.concat_ws("::", "file", *[F.col(p).cast("string") for p in parts])


def _sources(nodes: DataFrame) -> DataFrame:
    """snapshot, file, role (library, quiz, broken or other) and n_nodes."""
    has = nodes.groupBy(*FILE).agg(F.bool_or(F.col("tag") == "objectbank").alias("bank"), F.bool_or(F.col("tag") == "assessment").alias("quiz"), F.max("error").alias("error"), F.count("tag").alias("n_nodes"))
    role = F.when(F.col("error").isNotNull(), "broken").when(F.col("bank"), "library").when(F.col("quiz"), "quiz").otherwise("other")
    return has.select(*FILE, role.alias("role"), "n_nodes")


def _structures(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections of quizzes and libraries: kind (draw, section; pool, bank), parent, title, ordinal, requested, weight and n_members."""
    parent = nodes.select(*FILE, F.col("node_id").alias("parent_id"), F.col("section_node").alias("above"))
    heads = nodes.filter("tag = 'section'").select(*FILE, F.col("node_id").alias("section_node"), "parent_id", F.trim(F.coalesce("attrs.title", F.lit(""))).alias("title")).join(parent, [*FILE, "parent_id"], "left")
    told = responses.sections(nodes).select(*FILE, "section_node", "draw_count", "weight", "n_items", "n_references", "state")
    out = heads.join(told, [*FILE, "section_node"]).join(sources.select(*FILE, "role"), FILE)
    kind = F.when(F.col("role") == "library", F.when(F.col("n_items") > 0, "pool").otherwise("bank")).when(F.col("draw_count").isNotNull(), "draw").otherwise("section")
    key = _key("structure", F.lit("section_locator"), _in_file("section_node"))
    return out.select(key.alias("key"), *FILE, "section_node", "above", kind.alias("kind"), "title", F.col("section_node").alias("ordinal"), F.col("draw_count").alias("requested"), "weight", (F.col("n_items") + F.col("n_references")).alias("n_members"), "state")


def _placed_items(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Items and references with the node they stand at and the nearest section."""
    number = F.row_number().over(Window.partitionBy(*FILE).orderBy("node_id"))
    numbered = nodes.filter("tag IN ('item', 'itemref')").select(*FILE, number.alias("item_number"), F.col("node_id").alias("item_node"), "section_node", F.trim(F.coalesce("attrs.title", F.lit(""))).alias("title"))
    return exports.items(nodes).join(numbered, [*FILE, "item_number"]).join(sources.select(*FILE, "role"), FILE)


def build(nodes: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The collections of one export, from its node table and its files (snapshot, file).

    Library items are questions; an item in a quiz is one where no sure evidence links it to a library question.
    A question's key comes from its first alias; several library items under one key are told of, and stay one key."""
    nodes = kept(nodes)
    sources = kept(_sources(nodes))
    structures = kept(_structures(nodes, sources))
    quizzes = nodes.filter("tag = 'assessment'").join(sources.filter("role = 'quiz'").select(*FILE), FILE, "left_semi").groupBy(*FILE).agg(F.min_by(F.struct(F.coalesce("attrs.title", F.lit("")).alias("title"), F.coalesce("attrs.ident", F.lit("")).alias("ident")), "node_id").alias("q"))
    quizzes = kept(quizzes.select(_key("quiz", F.lit("quiz_file"), F.col("file")).alias("key"), *FILE, "q.title", "q.ident"))
    items = kept(_placed_items(nodes, sources))
    alias = F.coalesce(keys.first_alias([(a, F.col(a)) for a in ALIASES]), F.struct(F.lit("item_locator").alias("namespace"), _in_file("item_node").alias("value")))
    library = items.filter("role = 'library' AND tag = 'item'").withColumn("a", alias)
    library = kept(library.withColumn("key", _key("question", F.col("a.namespace"), F.col("a.value"))).withColumn("record", F.concat_ws("#", *FILE, F.lpad("item_number", 8, "0"))))
    linked = kept(exports.link_items(library.select(*[c for c in items.columns if c != "role"]), items.filter("role = 'quiz'")))
    found = linked.join(library.select("record", F.col("key").alias("library_key")), "record", "left")
    own = _key("question", F.lit("quiz_item"), _in_file("item_node"))
    found = kept(found.withColumn("own_key", F.when(F.col("tag") == "item", own)).withColumn("question", F.coalesce("library_key", "own_key")))
    about = ["title", "kind", "prompt", "n_choices", "signature", "alias"]
    named = library.withColumn("alias", F.when(~F.col("a.namespace").isin("ident", "item_locator"), F.concat_ws(":", "a.namespace", "a.value")))
    questions = named.groupBy("key").agg(F.min(F.struct(*FILE, "item_node", *about)).alias("q"), F.count("*").alias("n_records")).select("key", "q.*", "n_records", F.lit("library").alias("origin"))
    inline = found.filter("library_key IS NULL AND own_key IS NOT NULL").withColumn("alias", F.lit(None).cast("string")).select(F.col("own_key").alias("key"), *FILE, "item_node", *about, F.lit(1).cast("long").alias("n_records"), F.lit("quiz").alias("origin"))
    questions = kept(questions.unionByName(inline))
    placed = structures.select(*FILE, "section_node", F.col("key").alias("structure"))
    occurrences = kept(found.join(placed, [*FILE, "section_node"], "left").join(quizzes.select(*FILE, F.col("key").alias("quiz")), FILE).select(
        "quiz", "structure", "item_number", "tag", "question", F.col("library_key").isNotNull().alias("is_linked"), "evidence_level", "match_basis", "own_key", "library_key", *FILE, "item_node"
    ))
    where = questions.select("key", *FILE, "item_node")
    feedback = responses.feedback(nodes).join(where, [*FILE, "item_node"]).select("key", "channel", "chosen", "content")
    answered = _answers(nodes, where)
    refs = nodes.filter("tag = 'mattext' AND item_node IS NOT NULL").select(*FILE, "item_node", F.explode(text.local_refs(F.coalesce("text", F.lit("")))).alias("ref")).withColumn("ref", text.package_path(F.col("ref"))).filter("ref <> ''").distinct()
    resolved = kept(link.resolve_refs(refs.join(where, [*FILE, "item_node"]), files.select(F.col("file").alias("path")).distinct()))
    assets = resolved.filter("resolved_path IS NOT NULL").select("snapshot", "resolved_path").distinct().select(_key("asset", F.lit("path"), F.col("resolved_path")).alias("key"), F.col("resolved_path").alias("path"))
    relationships = kept(_relationships(structures, quizzes, library, occurrences, resolved))
    conflicts = identity.collisions(library, ["key"], F.col("signature")).filter("n_variants > 1")
    diagnostics = rules.union_all([
        rules.issues(occurrences.filter("tag = 'itemref' AND question IS NULL"), "error", "unresolved_reference", _in_file("item_node"), F.col("match_basis")),
        rules.issues(occurrences.filter("evidence_level LIKE 'inferred%'"), "warning", "inferred_link", _in_file("item_node"), F.col("match_basis")),
        rules.issues(resolved.filter("status = 'missing'"), "error", "missing_asset", F.col("key"), F.col("ref")),
        rules.issues(conflicts, "error", "alias_conflict", F.col("key"), F.col("n_variants").cast("string")),
        rules.issues(structures.filter("state = 'infeasible'"), "error", "infeasible_draw", F.col("key"), F.concat_ws("/", "requested", "n_members")),
        rules.issues(relationships.filter("status <> 'resolved' AND kind = 'draws_from'"), "warning", "draw_without_one_pool", F.col("src"), F.col("status")),
        rules.issues(sources.filter("role = 'broken'"), "error", "broken_file", F.col("file"), F.lit("")),
    ])
    return {
        "sources": sources, "quizzes": quizzes, "structures": structures, "questions": questions, "feedback": feedback, "responses": answered, "settings": settings.observed(nodes), "assets": assets,
        "occurrences": occurrences, "relationships": relationships, "diagnostics": diagnostics,
    }


def _answers(nodes: DataFrame, where: DataFrame) -> DataFrame:
    """key, answers, basis of each question."""
    return responses.answer_keys(nodes).select(*FILE, "item_node", F.col("key").alias("answers"), "basis").join(where, [*FILE, "item_node"]).select("key", "answers", "basis")


def _relationships(structures: DataFrame, quizzes: DataFrame, library: DataFrame, occurrences: DataFrame, resolved: DataFrame) -> DataFrame:
    """kind, src, dst, status, basis of all edges, each once."""

    def edges(rows: DataFrame, kind: str, src: Column, dst: Column, status: Column, basis: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), status.alias("status"), basis.alias("basis"))

    sure, xml = F.lit("resolved"), F.lit("source_xml")
    above = structures.select(*FILE, F.col("section_node").alias("above"), F.col("key").alias("outer"))
    nested = structures.join(above, [*FILE, "above"], "left").join(quizzes.select(*FILE, F.col("key").alias("quiz")), FILE, "left").withColumn("outer", F.coalesce("outer", "quiz")).filter("outer IS NOT NULL")
    members = library.join(structures.select(*FILE, "section_node", F.col("key").alias("pool")), [*FILE, "section_node"]).select("key", "pool").distinct()
    status = F.when(F.col("question").isNull(), "unresolved").otherwise("resolved")
    # a draw draws from the one pool that all it refers to is in
    drawn = structures.filter("kind = 'draw'").select(F.col("key").alias("structure")).join(occurrences.filter("tag = 'itemref'"), "structure", "left").join(members.withColumnRenamed("key", "question"), "question", "left")
    pools = drawn.groupBy("structure").agg(F.countDistinct("pool").alias("n"), F.min("pool").alias("pool"), F.bool_or(F.col("question").isNull() | F.col("pool").isNull()).alias("open"))
    drawn_status = F.when((F.col("n") == 0) | F.col("open"), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return rules.union_all([
        edges(nested, "contains", F.col("outer"), F.col("key"), sure, xml),
        edges(occurrences.filter("tag = 'itemref'"), "itemref", F.coalesce("structure", "quiz"), F.col("question"), status, F.col("match_basis")),
        edges(occurrences.filter("tag = 'item' AND structure IS NOT NULL"), "contains", F.col("structure"), F.col("question"), sure, xml),
        edges(members, "member_of", F.col("key"), F.col("pool"), sure, xml),
        edges(pools, "draws_from", F.col("structure"), F.when(drawn_status == "resolved", F.col("pool")), drawn_status, F.lit("members")),
        edges(resolved, "uses_asset", F.col("key"), F.when(F.col("resolved_path").isNotNull(), _key("asset", F.lit("path"), F.col("resolved_path"))), F.col("status"), F.col("basis")),
        edges(occurrences.filter("tag = 'item' AND is_linked"), "same_as", F.col("own_key"), F.col("library_key"), sure, F.col("match_basis")),
    ]).distinct()


def authoring(model: dict[str, DataFrame], quizzes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sections, questions and issues of what quizzes (key) draw: from quiz to draws, to the one pool of each, to its members.

    Sections: quiz, draw, pool, title, requested, n_members, points. Questions: quiz, draw, pool, question. Issues: subject,
    code, n; all of them, not the first: those of typed paths, `requested_count` outside 1 to the members' number, `points`
    that are not positive, and `unresolved` edges of what is drawn. Only where there are none may a package be built."""
    s, e = model["structures"], model["relationships"]
    nodes = rules.union_all([model["quizzes"].select(F.col("key").alias("node"), F.lit("quiz").alias("kind")), s.select(F.col("key").alias("node"), "kind"), model["questions"].select(F.col("key").alias("node"), F.lit("question").alias("kind"))])
    hops = [graph.Hop("contains", ("draw",), transitive=True), graph.Hop("draws_from", ("pool", "bank"), 1, 1), graph.Hop("member_of", ("question",), against=True)]
    paths, against = graph.typed_paths(nodes, e.filter("status = 'resolved'").select("kind", "src", "dst"), quizzes.select(F.col("key").alias("node")), hops)
    paths = kept(paths.select(F.col("h0").alias("quiz"), F.col("h1").alias("draw"), F.col("h2").alias("pool"), F.col("h3").alias("question")))
    told = s.select(F.col("key").alias("draw"), "title", "requested", F.col("weight").alias("points"))
    sections = kept(paths.groupBy("quiz", "draw", "pool").agg(F.countDistinct("question").alias("n_members")).join(told, "draw").select("quiz", "draw", "pool", "title", "requested", "n_members", "points"))
    count = (F.col("requested") < 1) | (F.col("requested") > F.col("n_members"))
    drawn_twice = paths.select("quiz", "draw", "question").distinct().groupBy("quiz", "question").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = e.filter("status <> 'resolved' AND kind IN ('uses_asset', 'itemref')").join(paths.select(F.col("question").alias("src")).union(paths.select("draw")).distinct(), "src", "left_semi")
    issues = rules.union_all([
        against.select(F.col("node").alias("subject"), "code", "n"),
        sections.filter(count).select(F.col("draw").alias("subject"), F.lit("requested_count").alias("code"), F.col("requested").cast("long").alias("n")),
        sections.filter("points IS NULL OR points <= 0").select(F.col("draw").alias("subject"), F.lit("points").alias("code"), F.lit(1).cast("long").alias("n")),
        drawn_twice.select(F.col("question").alias("subject"), F.lit("drawn_twice").alias("code"), "n"),
        open_.groupBy("src").agg(F.count("*").alias("n")).select(F.col("src").alias("subject"), F.lit("unresolved").alias("code"), "n"),
    ])
    return sections, paths, issues
