"""Keys of items whose scoring has a closed form."""

from __future__ import annotations

import pytest

from tessera.sources import exports, grading


def scored(ident, kind, declared, idents, program, outcomes="", text="x"):
    labels = "".join(f'<flow_label><response_label ident="{i}"><flow_mat><material><mattext texttype="text/html">{text}</mattext></material></flow_mat></response_label></flow_label>' for i in idents)
    tag = declared.split()[0]
    return (
        f'<item ident="{ident}"><m><f><fieldlabel>qmd_questiontype</fieldlabel><fieldentry>{kind}</fieldentry></f></m><presentation><flow><{declared}><render_choice>{labels}</render_choice></{tag}></flow></presentation>'
        f"<resprocessing>{outcomes and f'<outcomes>{outcomes}</outcomes>'}{program}</resprocessing></item>"
    )


def when(test, setter, more=""):
    return f"<respcondition{more}><conditionvar>{test}</conditionvar>{setter}</respcondition>"


def equal(value, name="r"):
    return f'<varequal respident="{name}">{value}</varequal>'


def score(value, action="", name=""):
    return f"<setvar{action and f' action={chr(34)}{action}{chr(34)}'}{name and f' varname={chr(34)}{name}{chr(34)}'}>{value}</setvar>"


ONE, SEVERAL, ORDER = 'response_lid ident="r" rcardinality="Single"', 'response_lid ident="r" rcardinality="Multiple"', 'response_grp respident="r" rcardinality="Ordered"'
ALL = equal("a") + f"<not>{equal('b')}</not>" + equal("c")
NATIVE = when(ALL, score(1, "Add"), ' continue="yes"') + when(f"<and><not>{ALL}</not></and>", score(0, "Add"), ' continue="no"')
COUNTERS = "".join(f'<decvar varname="{v}" vartype="Integer" defaultval="0"/>' for v in ("D2L_Correct", "D2L_Incorrect", "que_score"))


def counted(places, wrong=None):
    rows = [when(equal(p, o), score(1, "Add", "D2L_Correct")) for o, p in places.items()]
    rows += [when(f"<not>{equal(p, o)}</not>", score(1, "Add", "D2L_Incorrect")) for o, p in (wrong or places).items()]
    return "".join(rows) + when('<vargte respident="D2L_Incorrect">0</vargte>', score(0, "Set", "que_score")) + when(equal(0, "D2L_Incorrect"), score(1, "Set", "que_score"))


CASES = {
    "one": (("Multiple Choice", ONE, "ab", when(equal("a"), score(0)) + when(equal("b"), score(100))), "b", ""),
    "one_by_start": (("True/False", ONE, "ab", when(equal("a"), score(100))), "a", ""),
    "one_unknown_start": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100, "", "que_score"))), None, "no_zero_start"),
    "one_other_start": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100)), '<decvar defaultval="5"/>'), None, "no_zero_start"),
    "one_limits": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100)), '<decvar maxvalue="50"/>'), None, "limits"),
    "one_two_right": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100)) + when(equal("b"), score(100))), None, "not_one_right"),
    "one_partial": (("Multiple Choice", ONE, "ab", when(equal("a"), score(50))), None, "no_simple_key"),
    "one_none": (("Multiple Choice", ONE, "ab", ""), None, "no_simple_key"),
    "one_negated": (("Multiple Choice", ONE, "ab", when(f"<not>{equal('a')}</not>", score(100))), None, "ambiguous_predicate"),
    "one_elsewhere": (("Multiple Choice", ONE, "ab", when(equal("z"), score(100))), None, "ambiguous_predicate"),
    "one_twice": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100)) + when(equal("a"), score(0))), None, "repeated_option"),
    "one_odd": (("Multiple Choice", ONE, "ab", when(equal("a"), score(100)) + "<respcond_extension/>"), None, "program"),
    "same_idents": (("Multiple Choice", ONE, "aa", when(equal("a"), score(100))), None, "option_idents"),
    "wrong_declared": (("Multiple Choice", SEVERAL, "ab", when(equal("a"), score(100))), None, "declaration"),
    "several": (("Multi-Select", SEVERAL, "abc", when(ALL, score(100))), "ac", ""),
    "several_closed": (("Multiple Response", SEVERAL, "abc", when(f"<and>{ALL}</and>", score(100, "", "que_score")) + when("", score(0, "", "que_score"))), "ac", ""),
    "several_native": (("Multi-Select", SEVERAL, "abc", NATIVE), "ac", ""),
    "several_other_complement": (("Multi-Select", SEVERAL, "abc", NATIVE.replace(f"<not>{ALL}</not>", f"<not>{equal('a')}</not>")), None, "complement"),
    "several_or": (("Multi-Select", SEVERAL, "abc", when(f"<or>{ALL}</or>", score(100))), None, "unknown_predicate"),
    "several_part": (("Multi-Select", SEVERAL, "abc", when(equal("a"), score(100))), None, "not_every_option"),
    "several_program": (("Multi-Select", SEVERAL, "abc", when(ALL, score(30))), None, "unknown_program"),
    "order": (("Ordering", ORDER, "abc", counted({"a": 2, "b": 1, "c": 3}), COUNTERS), "a2b1c3", ""),
    "order_no_counters": (("Ordering", ORDER, "abc", counted({"a": 2, "b": 1, "c": 3})), None, "counters"),
    "order_unlike": (("Ordering", ORDER, "abc", counted({"a": 2, "b": 1, "c": 3}, {"a": 1, "b": 2, "c": 3}), COUNTERS), None, "not_every_option"),
    "order_places": (("Ordering", ORDER, "abc", counted({"a": 2, "b": 2, "c": 3}), COUNTERS), None, "places"),
    "other_kind": (("Long Answer", ONE, "ab", ""), None, "absent"),
}


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scored")
    (folder / "q.xml").write_text("<q>" + "".join(scored(name, *given) for name, (given, _, _) in CASES.items()) + "</q>")
    (folder / "empty.xml").write_text("<q/>")
    return {r.ident: r for r in grading.choice_keys(exports.read_nodes(exports.read_files(spark, str(folder)))).collect()}


@pytest.mark.parametrize("name", CASES)
def test_choice_keys(keys, name):
    (_, _, idents, *_), marks, reason = CASES[name]
    if reason == "absent":
        assert name not in keys
        return
    found = keys[name]
    assert (found.recognized, found.reason) == (not reason, reason) and [o.ident for o in found.options] == list(idents)
    if reason:
        assert found.scoring == "unknown" and all(o.correct is None and o.place is None for o in found.options)
    elif name == "order":
        assert "".join(f"{o.ident}{o.place}" for o in found.options) == marks
    else:
        assert "".join(o.ident for o in found.options if o.correct) == marks and all(o.correct is not None for o in found.options)


def short(ident, values, weight="1.0", award=None, case="no", box='rows="0" columns="20"', more="", extra=""):
    meta = "".join(f"<f><fieldlabel>qmd_{k}</fieldlabel><fieldentry>{v}</fieldentry></f>" for k, v in (("questiontype", "Short Answer"), ("computerscored", "yes"), ("weighting", weight)))
    tests = "".join(f'<respcondition><conditionvar><varequal respident="L" case="{case}">{v}</varequal></conditionvar><setvar action="Set">{award or grading.AWARD}</setvar></respcondition>' for v in values)
    return f"""<item ident="{ident}"><itemmetadata>{meta}</itemmetadata>
  <presentation><flow><material><mattext texttype="text/html">&lt;p&gt;who?&lt;/p&gt;</mattext></material><response_extension><grading_type>0</grading_type></response_extension>
  <response_str ident="S" rcardinality="Single"><render_fib {box} prompt="Box" fibtype="String"><response_label ident="L"/></render_fib></response_str></flow></presentation>
  <resprocessing>{extra}<outcomes><decvar vartype="Integer" minvalue="0" maxvalue="100" varname="Blank_1"/></outcomes>{tests}
  <respcondition><conditionvar><other/></conditionvar><setvar varname="que_score" action="Set">D2L_Correct</setvar></respcondition></resprocessing>{more}</item>"""


def test_short_answers_of_the_closed_form_only(spark, tmp_path):
    parts = {
        "good": short("good", ["Ada", "Lovelace"]), "wide": short("wide", list("abcde"), weight="2.50", box='rows="1" columns="60"'), "many": short("many", list("abcdef")), "none": short("none", []),
        "twice": short("twice", ["a", "a"]), "cased": short("cased", ["a"], case="yes"), "award": short("award", ["a"], award="50"), "weight": short("weight", ["a"], weight="0"), "blank": short("blank", [" a"]),
        "bars": short("bars", ["a || b"]), "box": short("box", ["a"], box='rows="2" columns="20"'), "feedback": short("feedback", ["a"], more='<itemfeedback ident="F"/>'), "text": short("text", ["a"], extra="loose"), "order": short("order", ["a"], extra="<outcomes/>"),
    }
    (tmp_path / "q.xml").write_text("<q>" + "".join(parts.values()) + "</q>")
    found = {r.ident: (r.prompt, list(r.answers), float(r.weight)) for r in grading.short_answers(exports.read_nodes(exports.read_files(spark, str(tmp_path)))).collect()}
    assert found == {"good": ("<p>who?</p>", ["Ada", "Lovelace"], 1.0), "wide": ("<p>who?</p>", list("abcde"), 2.5)}
