"""Answer keys, feedback channels and sections, as joins and aggregates over the node table of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exports

ITEM = ["snapshot", "file", "item_node"]


def _value() -> Column:
    return F.trim(F.coalesce("text", F.lit("")))


def _marks(nodes: DataFrame) -> DataFrame:
    """Of each scoring condition: whether some variable it sets is positive by name or value, and whether all are negative."""
    sets = nodes.filter("tag = 'setvar' AND condition_node IS NOT NULL")
    name, value, score = F.coalesce(F.col("attrs.varname"), F.lit("")), _value(), F.expr("try_cast(trim(coalesce(text, '')) AS double)")
    positive = F.when(name.endswith("_Incorrect"), False).otherwise(name.endswith("_Correct") | value.endswith("_Correct") | F.coalesce(score > 0, F.lit(False)))
    negative = name.endswith("_Incorrect") | F.coalesce(score <= 0, F.lit(False))
    return sets.groupBy(*ITEM, "condition_node").agg(F.bool_or(positive).alias("positive"), F.bool_and(negative).alias("negative"))


def predicates(nodes: DataFrame) -> DataFrame:
    """The compared values of each condition, with their negation, in document order."""
    found = nodes.filter("tag = 'varequal' AND condition_node IS NOT NULL")
    return found.select(*ITEM, "condition_node", "node_id", F.col("attrs.respident").alias("respident"), _value().alias("value"), "negated")


def answer_keys(nodes: DataFrame) -> DataFrame:
    """One row for each item: the values that score, and where they come from.

    `choice` when they are option idents, `literal` when they are not, `manual` for an evaluator's key, else
    `not_found`. Values that a scoring condition negates are not part of the key."""
    scored = predicates(nodes).join(_marks(nodes).filter("positive"), [*ITEM, "condition_node"]).filter("NOT negated AND value <> ''")
    options = nodes.filter("tag = 'response_label'").select(*ITEM, F.col("attrs.ident").alias("value")).distinct().withColumn("is_option", F.lit(True))
    keys = scored.join(options, [*ITEM, "value"], "left").groupBy(*ITEM).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x.value)).alias("key"), F.bool_and(F.coalesce("is_option", F.lit(False))).alias("options_only")
    )
    manual = nodes.filter("tag = 'answer_key' AND item_node IS NOT NULL").select(*ITEM).distinct().withColumn("manual", F.lit(True))
    out = nodes.filter("tag = 'item'").select("snapshot", "file", F.col("node_id").alias("item_node"), F.col("attrs.ident").alias("ident")).join(keys, ITEM, "left").join(manual, ITEM, "left")
    basis = F.when(F.col("options_only"), "choice").when(F.col("key").isNotNull(), "literal").when(F.col("manual"), "manual").otherwise("not_found")
    return out.select(*ITEM, "ident", F.coalesce("key", F.array().cast("array<string>")).alias("key"), basis.alias("basis"))


def feedback(nodes: DataFrame) -> DataFrame:
    """Feedback texts by channel: correct, incorrect, choice (with the values chosen) or general; unlinked ones are general."""
    texts = nodes.filter("feedback IS NOT NULL AND item_node IS NOT NULL").withColumn("t", _value()).filter("t <> ''")
    blocks = texts.groupBy(*ITEM, "feedback").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda x: x.t), " ").alias("content"))
    shown = nodes.filter("tag = 'displayfeedback' AND condition_node IS NOT NULL").select(*ITEM, "condition_node", F.col("attrs.linkrefid").alias("feedback")).distinct()
    chosen = predicates(nodes).filter("value <> ''").groupBy(*ITEM, "condition_node").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("chosen"))
    linked = blocks.join(shown, [*ITEM, "feedback"], "left").join(_marks(nodes), [*ITEM, "condition_node"], "left").join(chosen, [*ITEM, "condition_node"], "left")
    channel = F.when(F.col("condition_node").isNull(), "general").when(F.col("positive"), "correct").when(F.col("negative"), "incorrect").when(F.col("chosen").isNotNull(), "choice").otherwise("general")
    return linked.select(*ITEM, "feedback", channel.alias("channel"), F.when(channel == "choice", F.col("chosen")).alias("chosen"), "content").distinct()


def sections(nodes: DataFrame) -> DataFrame:
    """One row for each section: its own metadata's draw count and weight, items and references right inside, and whether the draw can be met."""
    key = ["snapshot", "file", "section_node"]
    own = nodes.filter("item_node IS NULL AND section_node IS NOT NULL")
    label = own.filter("tag = 'fieldlabel'").select(*key, "parent_id", F.col("text").alias("label"))
    entry = own.filter("tag = 'fieldentry'").select(*key, "parent_id", _value().alias("entry"))
    meta = label.join(entry, [*key, "parent_id"]).groupBy(*key).agg(
        F.max(F.when(F.col("label") == "qmd_numberofitems", F.expr("try_cast(entry AS int)"))).alias("draw_count"), F.max(F.when(F.col("label") == "qmd_weighting", F.expr("try_cast(entry AS decimal(25,9))"))).alias("weight")
    )
    inside = nodes.filter("tag IN ('item', 'itemref') AND section_node IS NOT NULL").groupBy(*key).agg(F.count_if(F.col("tag") == "item").alias("n_items"), F.count_if(F.col("tag") == "itemref").alias("n_references"))
    heads = nodes.filter("tag = 'section'").select("snapshot", "file", F.col("node_id").alias("section_node"), "section_path", F.col("attrs.ident").alias("ident"))
    out = heads.join(meta, key, "left").join(inside, key, "left").fillna(0, ["n_items", "n_references"])
    state = F.when(F.col("draw_count").isNull(), "fixed").when(F.col("draw_count") > F.col("n_items") + F.col("n_references"), "infeasible").otherwise("draw")
    return out.withColumn("state", state)


def blanks(nodes: DataFrame) -> DataFrame:
    """One row for each response string of an item: its number, the ident of its first label, and the values that score for it."""
    strings = nodes.filter("tag = 'response_str' AND item_node IS NOT NULL").select(*ITEM, F.col("node_id").alias("string_node"))
    number = F.row_number().over(Window.partitionBy(*ITEM).orderBy("string_node"))
    labels = nodes.filter("tag = 'response_label' AND string_node IS NOT NULL").groupBy(*ITEM, "string_node").agg(F.min_by("attrs.ident", "node_id").alias("respident"))
    scored = predicates(nodes).join(_marks(nodes).filter("positive").select(*ITEM, "condition_node"), [*ITEM, "condition_node"]).filter("NOT negated AND value <> ''")
    answers = scored.groupBy(*ITEM, "respident").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x.value)).alias("answers"))
    named = strings.withColumn("blank_number", number).join(labels, [*ITEM, "string_node"], "left").join(answers, [*ITEM, "respident"], "left")
    return named.select(*ITEM, "blank_number", F.coalesce("respident", F.lit("")).alias("respident"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


def blank_answers(nodes: DataFrame) -> DataFrame:
    """snapshot, file, item_node, blank_count, blank_answers: `Blank n: a / b` of the blanks that have answers."""
    line = F.when(F.size("answers") > 0, F.struct("blank_number", F.concat(F.lit("Blank "), F.col("blank_number").cast("string"), F.lit(": "), F.array_join("answers", " / ")).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line)
    return blanks(nodes).groupBy(*ITEM).agg(F.count("*").alias("blank_count"), F.array_join(lines, " || ").alias("blank_answers"))


def matching(nodes: DataFrame) -> DataFrame:
    """The two sides of matching items: side (prompt, option), place, ident and what it says; an option ident counts once."""
    groups = nodes.filter("tag = 'response_grp' AND item_node IS NOT NULL").select(*ITEM, F.col("node_id").alias("group_node"), F.coalesce("attrs.respident", F.lit("")).alias("ident"))
    first = nodes.filter("tag = 'material' AND group_node IS NOT NULL AND parent_id = group_node").groupBy(*ITEM, "group_node").agg(F.min("node_id").alias("material"))
    inside = nodes.filter("tag = 'mattext' AND group_node IS NOT NULL AND choice_node IS NULL")
    told = exports.texts_of(inside.join(first, [*ITEM, "group_node"]).filter("node_id > material").withColumn("block", F.col("material")), "block", "said")
    sides = first.join(told, (first.item_node == told.item_node) & (first.material == told.block) & (first.file == told.file) & first.snapshot.eqNullSafe(told.snapshot)).select(first.snapshot, first.file, first.item_node, "group_node", "said")
    prompts = groups.join(sides, [*ITEM, "group_node"]).filter("said <> ''").select(*ITEM, F.lit("prompt").alias("side"), F.col("group_node").alias("place"), "ident", "said")
    options = exports.choices(nodes).filter("group_node IS NOT NULL AND coalesce(ident, '') <> ''").groupBy(*ITEM, "ident").agg(F.min(F.struct("choice_node", "choice")).alias("o"))
    return prompts.unionByName(options.select(*ITEM, F.lit("option").alias("side"), F.col("o.choice_node").alias("place"), "ident", F.col("o.choice").alias("said")))


def label_issues(nodes: DataFrame) -> DataFrame:
    """True/False items whose labels are not the bare words True and False in this order, and Multi-Select items without
    a native key: two conditions that add 1 and 0, and a grading type of 0."""
    meta = exports.fields(nodes)
    kind = F.col("fields")["qmd_questiontype"]
    heads = nodes.filter("tag = 'item'").select("snapshot", "file", F.col("node_id").alias("item_node"), F.col("attrs.label").alias("label"), F.col("attrs.ident").alias("ident")).join(meta, ITEM)
    named = heads.select(*ITEM, kind.alias("kind"), F.coalesce(F.nullif(F.col("fields")["qmd_displayid"], F.lit("")), F.nullif("label", F.lit("")), F.nullif("ident", F.lit("")), F.lit("[unidentified]")).alias("identity"))
    texts = nodes.filter("tag = 'mattext' AND choice_node IS NOT NULL").groupBy(*ITEM, "choice_node").agg(F.min_by(F.struct(_value().alias("text"), F.coalesce("attrs.texttype", F.lit("")).alias("type")), "node_id").alias("t"))
    labels = texts.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("choice_node", "t"))).alias("l"))
    told = named.filter("kind = 'True/False'").join(labels, ITEM, "left")
    words, types = F.transform(F.coalesce("l", F.array()), lambda x: x.t.text), F.transform(F.coalesce("l", F.array()), lambda x: x.t.type)
    wrong = F.when(~words.eqNullSafe(F.array(F.lit("True"), F.lit("False"))), "truefalse_labels").when(F.exists(types, lambda x: x != "text/plain"), "truefalse_texttype")
    faulty = told.select(*ITEM, "identity", wrong.alias("code")).filter("code IS NOT NULL")
    sets = nodes.filter("tag = 'setvar' AND condition_node IS NOT NULL").groupBy(*ITEM, "condition_node").agg(F.min_by(F.concat_ws(" ", "attrs.action", _value()), "node_id").alias("s"))
    keys = sets.groupBy(*ITEM).agg(F.transform(F.array_sort(F.collect_list(F.struct("condition_node", "s"))), lambda x: x.s).alias("s"))
    grading = nodes.filter("tag = 'grading_type'").groupBy(*ITEM).agg(F.collect_list(_value()).alias("g"))
    several = named.filter("kind = 'Multi-Select'").join(keys, ITEM, "left").join(grading, ITEM, "left")
    native = F.col("s").eqNullSafe(F.array(F.lit("Add 1"), F.lit("Add 0"))) & F.col("g").eqNullSafe(F.array(F.lit("0")))
    return faulty.unionByName(several.filter(~native).select(*ITEM, "identity", F.lit("multiselect_key").alias("code")))
