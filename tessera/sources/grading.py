"""Which options score, where an item's scoring has one of four closed forms; anything else is unresolved, with the reason.

The forms: one right option (0 or 100 for each), all or nothing over every option (a conjunction, with or without
a closing condition), and an order (two counters for each option).  Nothing is guessed from displayed texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .responses import ITEM

C = F.col
# Question types, what they are, and how their responses are declared.
KINDS = {"Multiple Choice": "one", "True/False": "one", "Multi-Select": "several", "Multi Select": "several", "Multiple Response": "several", "Ordering": "order"}
DECLARED = {"one": ("response_lid", "Single"), "several": ("response_lid", "Multiple"), "order": ("response_grp", "Ordered")}
SCORES = ("SCORE", "que_score")
COUNTERS = ("D2L_Correct", "D2L_Incorrect", "que_score")

_NUMBER = "decimal(38,9)"
_PARTS = ("respcondition", "conditionvar", "setvar", "displayfeedback")


def _only(attrs: Column, names: list[str]) -> Column:
    return F.size(F.array_except(F.map_keys(attrs), F.array(*[F.lit(n) for n in names]))) == 0


def conditions(nodes: DataFrame) -> DataFrame:
    """One row for each scoring condition: is_plain (one predicate, one assignment, known attributes), continues, action,
    variable, value, and inside: the tests and operators of its predicate in document order, with their depth."""
    own = nodes.filter("condition_node IS NOT NULL")
    is_top, tag = C("parent_id") == C("condition_node"), C("tag")
    attrs_hold = F.when(tag == "respcondition", _only(C("attrs"), ["title", "continue"])).when(tag == "setvar", _only(C("attrs"), ["action", "varname"])).when(tag == "conditionvar", F.size("attrs") == 0)
    setter = F.when(tag == "setvar", F.struct("node_id", F.coalesce("attrs.action", F.lit("Set")).alias("action"), F.coalesce("attrs.varname", F.lit("SCORE")).alias("variable"), F.expr(f"try_cast(trim(text) AS {_NUMBER})").alias("value")))
    test = F.when(~tag.isin(*_PARTS), F.struct("node_id", tag.alias("tag"), "depth", "parent_id", C("attrs.respident").alias("respident"), F.coalesce("text", F.lit("")).alias("value"), "negated", F.size("attrs").alias("n_attrs")))
    found = own.groupBy(*ITEM, "condition_node").agg(
        F.count_if(is_top & (tag == "conditionvar")).alias("n_predicates"), F.count_if(tag == "setvar").alias("n_setters"), F.bool_and(F.coalesce(attrs_hold, F.lit(True))).alias("attrs_hold"),
        F.count_if(is_top & ~tag.isin(*_PARTS)).alias("n_odd"), F.max(F.when(tag == "respcondition", F.lower("attrs.continue"))).alias("continues"), F.min("depth").alias("depth"),
        F.min(setter).alias("s"), F.array_sort(F.collect_list(test)).alias("inside"),
    )
    is_plain = (C("n_predicates") == 1) & (C("n_setters") == 1) & C("attrs_hold") & (C("n_odd") == 0) & C("s.value").isNotNull() & F.coalesce("continues", F.lit("no")).isin("yes", "no")
    # operators that hold nothing say nothing
    operators = F.filter("inside", lambda x: x.tag.isin("and", "or", "not"))
    full = F.size(F.array_distinct(F.transform("inside", lambda x: x.parent_id))) == F.when(F.size("inside") > 0, 1 + F.size(operators)).otherwise(0)
    inside = F.transform("inside", lambda x: F.struct(x.tag.alias("tag"), (x.depth - C("depth")).alias("depth"), F.coalesce(x.respident, F.lit("")).alias("respident"), x.value.alias("value"), x.negated.alias("negated"), x.n_attrs.alias("n_attrs")))
    return found.select(*ITEM, "condition_node", (is_plain & full).alias("is_plain"), "continues", C("s.action").alias("action"), C("s.variable").alias("variable"), C("s.value").alias("value"), inside.alias("inside"))


def _variables(nodes: DataFrame) -> DataFrame:
    """Declared outcome variables of items: name, start and limits, and whether all are of the known form and named once."""
    number = {c: F.expr(f"try_cast(attrs.{c} AS {_NUMBER})") for c in ("defaultval", "minvalue", "maxvalue")}
    told = [C(f"attrs.{c}").isNull() | v.isNotNull() for c, v in number.items()]
    holds = _only(C("attrs"), ["varname", "vartype", *number]) & F.coalesce("attrs.vartype", F.lit("Integer")).isin("Integer", "Decimal") & told[0] & told[1] & told[2] & F.coalesce(number["minvalue"] <= number["maxvalue"], F.lit(True))
    v = F.struct(F.coalesce("attrs.varname", F.lit("SCORE")).alias("variable"), F.coalesce(number["defaultval"], F.lit(0).cast(_NUMBER)).alias("start"), number["minvalue"].alias("low"), number["maxvalue"].alias("high"))
    found = nodes.filter("tag = 'decvar' AND item_node IS NOT NULL").groupBy(*ITEM).agg(F.collect_list(v).alias("variables"), F.bool_and(holds).alias("holds"))
    names = F.transform("variables", lambda x: x.variable)
    return found.select(*ITEM, "variables", (C("holds") & (F.size(F.array_distinct(names)) == F.size(names)) & ~F.array_contains(names, "")).alias("variables_hold"))


def _shape(nodes: DataFrame) -> DataFrame:
    """Options, declarations and the pieces of the scoring of each item."""
    own, tag = nodes.filter("item_node IS NOT NULL"), C("tag")
    heads = own.filter("tag IN ('resprocessing', 'outcomes', 'response_lid', 'response_grp', 'response_str')").select(*ITEM, C("node_id").alias("parent_id"), tag.alias("inside_of"))
    below = own.filter("parent_id IS NOT NULL").join(heads, [*ITEM, "parent_id"]).groupBy(*ITEM).agg(
        F.count_if(((C("inside_of") == "resprocessing") & ~tag.isin("outcomes", "respcondition")) | ((C("inside_of") == "outcomes") & (tag != "decvar"))).alias("n_odd"),
        F.count_if(C("inside_of").startswith("response_") & (tag == "render_choice")).alias("n_renderers"),
    )
    material = nodes.filter("choice_node IS NOT NULL").groupBy(*ITEM, "choice_node").agg(
        ((F.count_if(tag == "mattext") == 1) & F.bool_and(tag.isin("response_label", "flow_mat", "material", "mattext") & F.when(tag == "mattext", F.coalesce("attrs.texttype", F.lit("text/plain")).isin("text/plain", "text/html")).otherwise(True))).alias("holds")
    )
    material = material.groupBy(*ITEM).agg(F.bool_and("holds").alias("material_holds"))
    declared = F.when(C("in_presentation") & tag.isin("response_lid", "response_grp", "response_str"), F.struct("node_id", "tag", C("attrs.rcardinality").alias("cardinality"), F.when(tag == "response_grp", C("attrs.respident")).otherwise(C("attrs.ident")).alias("id")))
    label = F.when(C("in_presentation") & (tag == "response_label"), F.struct("node_id", F.coalesce("attrs.ident", F.lit("")).alias("ident")))
    alone = ((tag == "resprocessing") & (F.size("attrs") > 0)) | ((tag == "outcomes") & (F.size("attrs") > 0))
    shape = own.groupBy(*ITEM).agg(
        F.array_sort(F.collect_list(declared)).alias("declarations"), F.transform(F.array_sort(F.collect_list(label)), lambda x: x.ident).alias("options"), F.count_if(tag == "resprocessing").alias("n_programs"),
        F.count_if(tag == "outcomes").alias("n_outcomes"), F.count_if(alone).alias("n_attributed"), F.count_if((tag == "fieldlabel") & (C("text") == "qmd_questiontype")).alias("n_kinds"), F.max(F.when(tag == "item", C("attrs.ident"))).alias("ident"),
    )
    return shape.join(below, ITEM, "left").join(material, ITEM, "left").fillna(0, ["n_odd", "n_renderers"]).fillna(False, ["material_holds"])


def _first(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that does not hold; a null check does not."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for holds, name in checks])


def _allows(name: Column, *values: Column) -> Column:
    """Whether the declared limits of a variable let it take some values."""
    return F.forall("variables", lambda v: reduce(lambda a, b: a & b, [(v.variable != name) | ((F.coalesce(v.low, x) <= x) & (F.coalesce(v.high, x) >= x)) for x in values]))


def _start(name: Column) -> Column:
    """Where a variable starts; SCORE starts at 0 where nothing is declared, others are then unknown."""
    return F.coalesce(_at(F.transform(F.filter("variables", lambda v: v.variable == name), lambda v: v.start), 1), F.when((name == "SCORE") & (F.size("variables") == 0), F.lit(0).cast(_NUMBER)))


def _is_test(x: Column) -> Column:
    return (x.tag == "varequal") & (x.n_attrs == 1) & (x.respident == C("declared_id")) & F.array_contains("options", x.value)


def _at(values: Column, i: int) -> Column:
    """The i-th value from the front or the back; null where there is none."""
    return F.try_element_at(values, F.lit(i))


def _num(n) -> Column:
    return F.lit(n).cast(_NUMBER)


def _one() -> tuple[Column, Column]:
    """Reason, and whether each option is right."""
    c = C("conditions")
    names = F.array_distinct(F.transform(c, lambda x: x.variable))
    name = _at(names, 1)
    tested = F.transform(c, lambda x: F.struct(_at(x.inside, 1).value.alias("value"), x.value.alias("score")))
    ids = F.transform(tested, lambda t: t.value)
    right = F.transform(F.filter(tested, lambda t: t.score == 100), lambda t: t.value)
    start = _start(name)
    reason = _first([
        ((F.size(c) > 0) & F.forall(c, lambda x: x.is_plain & (x.action == "Set") & x.variable.isin(*SCORES) & x.value.isin(0, 100)), "no_simple_key"),
        (F.forall(c, lambda x: (F.size(x.inside) == 1) & F.exists(x.inside, _is_test)), "ambiguous_predicate"),
        (F.size(F.array_distinct(ids)) == F.size(ids), "repeated_option"),
        ((F.size(names) == 1) & F.forall("variables", lambda v: v.variable == name), "several_variables"),
        (_allows(name, _num(0), _num(100)), "limits"),
        (F.coalesce(start == 0, F.size(ids) == F.size("options")), "no_zero_start"),
        (F.size(right) == 1, "not_one_right"),
    ])
    return reason, F.transform("options", lambda o: F.array_contains(right, o))


def _several() -> tuple[Column, Column]:
    c = C("conditions")
    zero = _num(0)
    full = F.filter(c, lambda x: ((x.action == "Set") & (x.value == 100)) | ((x.action == "Add") & (x.value == 1)))
    closing = F.filter(c, lambda x: (x.action == "Set") & (x.value == zero) & (F.size(x.inside) == 0))
    complement = F.filter(c, lambda x: (x.action == "Add") & (x.value == zero))
    one, last = _at(full, 1), _at(c, -1)
    names = F.array_distinct(F.transform(c, lambda x: x.variable))
    name = _at(names, 1)
    tests = F.filter(one.inside, lambda x: x.tag == "varequal")
    ids = F.transform(tests, lambda x: x.value)
    known = F.forall(one.inside, lambda x: _is_test(x) | ((x.tag == "and") & ~x.negated & (x.n_attrs == 0)) | ((x.tag == "not") & x.negated & (x.n_attrs == 0)))

    def bare(inside: Column, up: int) -> Column:
        return F.transform(inside, lambda x: F.struct(x.tag.alias("tag"), (x.depth - up).alias("depth"), x.respident.alias("respident"), F.trim(x.value).alias("value")))

    turned = _at(complement, 1).inside
    opens = F.transform(F.slice(turned, 1, 2), lambda x: F.concat_ws(":", x.tag, x.depth.cast("string"), x.n_attrs.cast("string")))
    repeats = (F.size(turned) == F.size(one.inside) + 2) & (opens == F.array(F.lit("and:2:0"), F.lit("not:3:0"))) & (bare(F.slice(turned, 3, F.greatest(F.size(turned), F.lit(1))), 2) == bare(one.inside, 0))
    native = (F.size(closing) == 0) & (F.size(c) == 2) & (last.action == "Add") & (last.value == zero) & (one.action == "Add") & (one.continues == "yes") & (last.continues == "no") & repeats
    needs_start = (F.size(closing) == 0) | (one.action == "Add")
    reason = _first([
        (F.forall(c, lambda x: x.is_plain & x.variable.isin(*SCORES)), "no_simple_key"),
        ((F.size(full) + F.size(closing) + F.size(complement) == F.size(c)) & (F.size(closing) <= 1) & (F.size(complement) <= 1), "unknown_program"),
        (F.size(full) == 1, "not_one_full_score"),
        ((F.size(names) == 1) & F.forall("variables", lambda v: v.variable == name), "several_variables"),
        (_allows(name, zero, one.value), "limits"),
        ((F.size(closing) == 0) | ((last.action == "Set") & (last.value == zero) & (F.size(last.inside) == 0) & (F.coalesce(one.continues, F.lit("no")) == "no")), "continuation"),
        (~needs_start | F.coalesce(_start(name) == 0, F.lit(False)), "no_zero_start"),
        ((F.size(complement) == 0) | native, "complement"),
        (known, "unknown_predicate"),
        ((F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(ids) == F.size("options")) & F.exists(tests, lambda x: ~x.negated), "not_every_option"),
    ])
    return reason, F.transform("options", lambda o: F.exists(tests, lambda x: (x.value == o) & ~x.negated))


def _order() -> tuple[Column, Column]:
    """Reason, and the place of each option."""
    c, n = C("conditions"), F.size("options")

    def counts(x: Column, variable: str, opening: int) -> Column:
        test = _at(x.inside, -1)
        opens = F.lit(True) if opening == 0 else (_at(x.inside, 1).tag == "not") & (_at(x.inside, 1).n_attrs == 0)
        return (x.variable == variable) & (x.action == "Add") & (x.value == 1) & (F.size(x.inside) == opening + 1) & opens & (test.tag == "varequal") & (test.n_attrs == 1) & F.array_contains("options", test.respident) & test.value.rlike("^[1-9][0-9]{0,8}$")

    def places(variable: str, opening: int) -> Column:
        return F.array_sort(F.transform(F.filter(c, lambda x: counts(x, variable, opening)), lambda x: F.struct(_at(x.inside, -1).respident.alias("option"), _at(x.inside, -1).value.cast("int").alias("place"))))

    def ends(x: Column, tag: str, value: int) -> Column:
        test = _at(x.inside, 1)
        return (x.variable == "que_score") & (x.action == "Set") & (x.value == value) & (F.size(x.inside) == 1) & (test.tag == tag) & (test.respident == "D2L_Incorrect") & (test.n_attrs == 1) & (test.value == "0")

    right, wrong = places("D2L_Correct", 0), places("D2L_Incorrect", 1)
    listed = F.array_sort(F.transform("variables", lambda v: v.variable)) == F.array(*[F.lit(x) for x in COUNTERS])
    starts = F.forall("variables", lambda v: (v.start == 0) & (F.coalesce(v.low, _num(0)) <= 0) & (F.coalesce(v.high, n.cast(_NUMBER)) >= F.when(v.variable == "que_score", 1).otherwise(n)))
    told = F.transform(c, lambda x: x.continues)
    goes_on = F.forall(told, lambda x: x.isNull()) | (F.forall(F.slice(told, 1, F.greatest(F.size(told) - 1, F.lit(1))), lambda x: x == "yes") & _at(told, -1).isNotNull())
    all_places = F.array_sort(F.transform(right, lambda p: p.place)) == F.sequence(F.lit(1), n)
    reason = _first([
        (listed & starts, "counters"),
        (F.forall(c, lambda x: x.is_plain) & goes_on, "continuation"),
        ((F.size(c) == 2 * n + 2) & ends(_at(c, -2), "vargte", 0) & ends(_at(c, -1), "varequal", 1), "closing_scores"),
        ((F.size(right) == n) & (right == wrong) & (F.array_sort(F.transform(right, lambda p: p.option)) == F.array_sort("options")), "not_every_option"),
        (all_places, "places"),
    ])
    return reason, F.transform("options", lambda o: _at(F.transform(F.filter(right, lambda p: p.option == o), lambda p: p.place), 1))


def choice_keys(nodes: DataFrame) -> DataFrame:
    """One row for each item of a kind with options: ident, kind, options (ident, correct, place), scoring, recognized, reason.

    Options stay where the scoring is not recognized, without marks: correct and place are null then.  A textless,
    repeated or unnamed option, a second declaration, or a scoring outside the closed forms leaves the item unresolved."""
    label = nodes.filter("tag = 'fieldlabel' AND item_node IS NOT NULL AND text = 'qmd_questiontype'").select(*ITEM, "parent_id")
    entry = nodes.filter("tag = 'fieldentry' AND item_node IS NOT NULL").select(*ITEM, "parent_id", C("text").alias("entry"))
    told = label.join(entry, [*ITEM, "parent_id"]).groupBy(*ITEM).agg(F.max("entry").alias("entry"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    told = told.withColumn("kind", F.element_at(kinds, C("entry"))).filter("kind IS NOT NULL")
    programs = conditions(nodes).groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("condition_node", "is_plain", "continues", "action", "variable", "value", "inside"))).alias("conditions"))
    rows = _shape(nodes).join(told, ITEM).join(programs, ITEM, "left").join(_variables(nodes), ITEM, "left").fillna(True, ["variables_hold"])
    empty = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in rows.schema if f.name in ("conditions", "variables")}
    declaration = _at(C("declarations"), 1)
    rows = rows.withColumns(empty).withColumns({"declared_id": declaration["id"], "declared": F.concat_ws(" ", declaration["tag"], declaration["cardinality"])})
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, v in DECLARED.items() for x in (k, " ".join(v))]), C("kind"))
    common = _first([
        ((F.size("options") > 0) & ~F.array_contains("options", "") & (F.size(F.array_distinct("options")) == F.size("options")), "option_idents"),
        (C("material_holds"), "option_material"),
        (C("n_kinds") == 1, "kind"),
        (F.size("declarations") == 1, "declarations"),
        ((C("declared") == wanted) & (F.coalesce("declared_id", F.lit("")) != "") & (C("n_renderers") == 1), "declaration"),
        ((C("n_programs") == 1) & (C("n_outcomes") <= 1) & (C("n_odd") == 0) & (C("n_attributed") == 0), "program"),
        (C("variables_hold"), "variables"),
    ])
    (one, one_right), (several, several_right), (order, places) = _one(), _several(), _order()
    own = F.when(C("kind") == "one", one).when(C("kind") == "several", several).otherwise(order)
    judged = rows.withColumn("reason", F.coalesce(common, own))
    right = F.when(C("reason").isNull() & (C("kind") == "one"), one_right).when(C("reason").isNull() & (C("kind") == "several"), several_right)
    placed = F.when(C("reason").isNull() & (C("kind") == "order"), places)
    judged = judged.withColumns({"right": right, "placed": placed})
    options = F.transform("options", lambda o, i: F.struct(o.alias("ident"), F.get("right", i).alias("correct"), F.get("placed", i).alias("place")))
    scoring = F.when(C("reason").isNotNull(), "unknown").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("one", "exact", "several", "all_or_nothing", "order", "exact")]), C("kind")))
    return judged.select(*ITEM, "ident", C("entry").alias("kind"), options.alias("options"), scoring.alias("scoring"), C("reason").isNull().alias("recognized"), F.coalesce("reason", F.lit("")).alias("reason"))


# The one form of short answers that is read: tag, depth below the item's part, attributes, text.
AWARD = "100.000000000"
SHORT_HEAD = [
    "presentation 0", "flow 1", "material 2", "mattext 3 texttype=text/html", "response_extension 2", "grading_type 3 '0'", "response_str 2 rcardinality=Single", "render_fib 3", "response_label 4",
    "resprocessing 0", "outcomes 1", "decvar 2 maxvalue=100,minvalue=0,varname=Blank_1,vartype=Integer",
]
SHORT_VALUE = ["respcondition 1", "conditionvar 2", "varequal 3 case=no", f"setvar 2 action=Set '{AWARD}'"]
SHORT_TAIL = ["respcondition 1", "conditionvar 2", "other 3", "setvar 2 action=Set,varname=que_score 'D2L_Correct'"]
BOXES = ["columns=20,fibtype=String,prompt=Box,rows=0", "columns=60,fibtype=String,prompt=Box,rows=1"]
MOST_SYNONYMS = 5


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def short_answers(nodes: DataFrame) -> DataFrame:
    """Short answers of the one closed form, with one to five synonyms: ident, prompt (HTML), answers in order, weight.

    An item's presentation and scoring must be, element for element, that form; only the prompt, the answers, the
    identifiers and the size of the box are its own.  Items with feedback, with metadata that is absent, repeated
    or at odds, or with a weight that is no positive number, have no row."""
    tag, own = C("tag"), nodes.filter("item_node IS NOT NULL")
    attrs = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.struct(e.key, e.value)))

    def said(names_left_out: Column) -> Column:
        return F.array_join(F.transform(F.filter(attrs, lambda e: ~F.array_contains(names_left_out, e.key)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")

    # what is an item's own is left out of the line: identifiers, the box, the prompt and the answers
    free = F.when(tag.isin("response_str", "response_label"), _strings(["ident"])).when(tag == "varequal", _strings(["respident"])).when(tag == "render_fib", _strings(["rows", "columns", "prompt", "fibtype"])).otherwise(F.array().cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    exact = F.when(tag.isin("mattext", "varequal"), "").when(tag.isin("grading_type", "setvar"), text).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    line = F.concat_ws(" ", tag, (C("depth") - C("top")).cast("string"), F.nullif(said(free), F.lit("")), F.when(exact != "", F.concat(F.lit("'"), exact, F.lit("'"))))
    tops = own.filter("tag IN ('presentation', 'resprocessing')").select(*ITEM, "node_id", C("depth").alias("top"))
    first = tops.groupBy(*ITEM).agg(F.min("top").alias("top"), F.min("node_id").alias("first_part"))
    # metadata comes before the presentation; whatever follows it belongs to the form
    parts = own.join(first, ITEM).filter("node_id >= first_part").withColumns({"line": line, "tail_is_empty": F.trim(F.regexp_replace(F.coalesce("tail", F.lit("")), r"\s+", " ")) == ""})
    form = F.array_sort(F.collect_list(F.struct("node_id", "line", "tag", text.alias("text"), C("attrs.ident").alias("ident"), C("attrs.respident").alias("respident"), said(F.array().cast("array<string>")).alias("attributes"))))
    rows = parts.groupBy(*ITEM).agg(form.alias("form"), F.bool_and("tail_is_empty").alias("tails_are_empty"))
    labels = own.filter("tag = 'fieldlabel' AND text IN ('qmd_questiontype', 'qmd_computerscored', 'qmd_weighting')").select(*ITEM, "parent_id", C("text").alias("label"))
    entries = own.filter("tag = 'fieldentry'").select(*ITEM, "parent_id", F.coalesce("text", F.lit("")).alias("entry"))
    meta = labels.join(entries, [*ITEM, "parent_id"]).groupBy(*ITEM).agg(F.count("*").alias("n_meta"), *[F.max(F.when(C("label") == f"qmd_{n}", C("entry"))).alias(n) for n in ("questiontype", "computerscored", "weighting")])
    weight = F.expr(f"try_cast(weighting AS {_NUMBER})")
    meta = meta.filter((C("n_meta") == 3) & (C("questiontype") == "Short Answer") & (C("computerscored") == "yes") & (weight > 0) & (C("weighting") == F.trim("weighting")))
    ident = own.filter("tag = 'item'").select(*ITEM, C("attrs.ident").alias("ident"))

    def of(name: str) -> Column:
        return F.filter("form", lambda x: x.tag == name)

    lines, values = F.transform("form", lambda x: x.line), F.transform(of("varequal"), lambda x: x.text)
    label = _at(of("response_label"), 1)
    wanted = F.concat(_strings(SHORT_HEAD), F.flatten(F.array_repeat(_strings(SHORT_VALUE), F.size(values))), _strings(SHORT_TAIL))
    holds = (lines == wanted) & C("tails_are_empty") & F.size(values).between(1, MOST_SYNONYMS) & (F.size(F.array_distinct(values)) == F.size(values))
    holds &= F.forall(values, lambda v: (v != "") & (v == F.regexp_replace(v, r"^\s+|\s+$", "")) & ~v.contains(" || "))
    holds &= (F.coalesce(label.ident, F.lit("")) != "") & (F.coalesce(_at(of("response_str"), 1).ident, F.lit("")) != "") & F.forall(of("varequal"), lambda x: x.respident == label.ident) & _at(of("render_fib"), 1).attributes.isin(BOXES)
    judged = rows.join(meta, ITEM).join(ident, ITEM).filter(holds)
    return judged.select(*ITEM, "ident", _at(of("mattext"), 1).text.alias("prompt"), values.alias("answers"), weight.alias("weight"), _at(of("render_fib"), 1).attributes.alias("box"))
