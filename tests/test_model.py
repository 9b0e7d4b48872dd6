"""The model of a small export, and what may be built from it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import compare, exports, model


def meta(**fields):
    return "".join(f"<qti_metadatafield><fieldlabel>{k}</fieldlabel><fieldentry>{v}</fieldentry></qti_metadatafield>" for k, v in fields.items())


def item(ident, prompt, label="", **fields):
    return f'<item ident="{ident}" label="{label}"><itemmetadata>{meta(qmd_questiontype="short", **fields)}</itemmetadata><presentation><material><mattext>{prompt}</mattext></material></presentation></item>'


def draw(title, n, weight, *refs):
    return f'<section title="{title}" ident="{title}"><qtimetadata>{meta(qmd_numberofitems=n, qmd_weighting=weight)}</qtimetadata>' + "".join(f'<itemref linkrefid="{r}"/>' for r in refs) + "</section>"


LIBRARY = f"""<questestinterop><objectbank><section title="Bank" ident="b">
<section title="Pool A" ident="pa">{item("l1", "What is one", "L1")}{item("l2", "What is two &lt;img src=&quot;pics/two.png&quot;&gt;", "L2")}{item("l3", "What is three &lt;img src=&quot;gone.png&quot;&gt;", "L3")}</section>
<section title="Pool B" ident="pb">{item("l4", "What is four", "L4")}{item("x", "First of a kind", "same")}{item("y", "Second of a kind", "same")}</section></section></objectbank></questestinterop>"""
QUIZ = f"""<questestinterop><assessment title="Quiz" ident="q"><assess_procextension><time_limit>30</time_limit></assess_procextension><section title="All" ident="s">
{draw("good", 2, "5", "L1", "L2")}{draw("many", 9, "0", "L1", "L3")}{draw("mixed", 1, "1", "L1", "L4")}{draw("lost", 1, "1", "L4", "none")}
<section title="Own" ident="o">{item("i1", "What is four")}{item("i2", "Only here")}</section></section></assessment></questestinterop>"""


@pytest.fixture(scope="module")
def built(spark):
    rows = [("e", "questiondb.xml", LIBRARY.encode(), None), ("e", "quiz_1.xml", QUIZ.encode(), None), ("e", "bad.xml", b"<a><b></a>", None), ("e", "pics/two.png", b"png", None)]
    files = spark.createDataFrame(rows, exports.FILES)
    return {k: v.cache() for k, v in model.build(exports.read_nodes(files), files.select("snapshot", "file")).items()}


def test_collections(built):
    assert {r.file: r.role for r in built["sources"].collect()} == {"questiondb.xml": "library", "quiz_1.xml": "quiz", "bad.xml": "broken"}
    assert [(r.title, r.ident) for r in built["quizzes"].collect()] == [("Quiz", "q")]
    kinds = {r.title: (r.kind, r.requested, r.n_members) for r in built["structures"].collect()}
    assert kinds == {"Bank": ("bank", None, 0), "Pool A": ("pool", None, 3), "Pool B": ("pool", None, 3), "All": ("section", None, 0), "good": ("draw", 2, 2), "many": ("draw", 9, 2), "mixed": ("draw", 1, 2), "lost": ("draw", 1, 2), "Own": ("section", None, 2)}
    questions = sorted((r.origin, r.n_records) for r in built["questions"].collect())
    assert questions == [("library", 1), ("library", 1), ("library", 1), ("library", 1), ("library", 2), ("quiz", 1)]
    assert [r.path for r in built["assets"].collect()] == ["pics/two.png"]
    assert [(r["name"], r.value) for r in built["settings"].collect()] == [("time_limit", "30")]
    assert built["responses"].count() == built["questions"].count()
    assert built["occurrences"].count() == 10 and built["occurrences"].filter("quiz IS NULL").count() == 0


def test_relationships(built):
    names = {r.key: r.title for r in built["structures"].collect()} | {r.key: "quiz" for r in built["quizzes"].collect()} | {r.key: r.path for r in built["assets"].collect()}
    names |= {r.key: r.prompt[:13] for r in built["questions"].collect()}
    edges = sorted(((r.kind, names.get(r.src, "own"), names.get(r.dst), r.status) for r in built["relationships"].collect()), key=repr)
    assert [e[1:] for e in edges if e[0] == "draws_from"] == [("good", "Pool A", "resolved"), ("lost", None, "unresolved"), ("many", "Pool A", "resolved"), ("mixed", None, "ambiguous")]
    assert [e[1:3] for e in edges if e[0] == "contains"] == sorted([("All", "Own"), ("All", "good"), ("All", "lost"), ("All", "many"), ("All", "mixed"), ("Bank", "Pool A"), ("Bank", "Pool B"), ("Own", "Only here"), ("Own", "What is four"), ("quiz", "All")])
    assert [e[1:] for e in edges if e[0] == "itemref" and e[1] == "lost"] == [("lost", "What is four", "resolved"), ("lost", None, "unresolved")]
    assert [e[1:] for e in edges if e[0] == "uses_asset"] == [("What is three", None, "missing"), ("What is two", "pics/two.png", "resolved")]
    assert [e[1:] for e in edges if e[0] == "same_as"] == [("own", "What is four", "resolved")]
    assert len([e for e in edges if e[0] == "member_of"]) == 5


def test_diagnostics(built):
    codes = sorted(r.code for r in built["diagnostics"].collect())
    assert codes == ["alias_conflict", "broken_file", "draw_without_one_pool", "draw_without_one_pool", "infeasible_draw", "inferred_link", "missing_asset", "unresolved_reference"]


def test_authoring_tells_of_everything(spark, built):
    sections, questions, issues = model.authoring(built, built["quizzes"].select("key"))
    assert {r.title: (r.requested, r.n_members) for r in sections.collect()} == {"good": (2, 3), "many": (9, 3)}
    assert questions.count() == 6
    names = {r.key: r.title for r in built["structures"].collect()} | {r.key: r.prompt[:13] for r in built["questions"].collect()}
    told = sorted((names[r.subject], r.code, r.n) for r in issues.collect())
    assert told == [
        ("What is one", "drawn_twice", 2), ("What is three", "drawn_twice", 2), ("What is three", "unresolved", 1), ("What is two", "drawn_twice", 2), ("lost", "too_few", 0), ("many", "points", 1), ("many", "requested_count", 9), ("mixed", "too_few", 0),
    ]
    nobody = model.authoring(built, spark.createDataFrame([("nobody",)], "key string"))
    assert nobody[0].count() == 0 and [(r.subject, r.code) for r in nobody[2].collect()] == [("nobody", "unknown")]


def test_an_empty_export(spark):
    files = spark.createDataFrame([], exports.FILES)
    made = model.build(exports.read_nodes(files), files.select("snapshot", "file"))
    assert len(made) == 11 and all(v.count() == 0 for v in made.values())


def export(spark, library, quizzes):
    rows = [("e", "questiondb.xml", library.encode(), None)] + [("e", f"quiz_{i}.xml", q.encode(), None) for i, q in enumerate(quizzes)]
    files = spark.createDataFrame(rows, exports.FILES)
    nodes = exports.read_nodes(files).cache()
    return model.build(nodes, files.select("snapshot", "file")), nodes, files.select("snapshot", "file")


def titled(title, ident, prompt, label="", kind="short"):
    return item(ident, prompt, label).replace("<item ", f'<item title="{title}" ').replace(">short<", f">{kind}<")


def bank(*items):
    return f'<questestinterop><objectbank><section title="P" ident="p">{"".join(items)}</section></objectbank></questestinterop>'


def quiz(title, *sections, limit=30):
    return f'<questestinterop><assessment title="{title}" ident="q"><assess_procextension><time_limit>{limit}</time_limit></assess_procextension>{"".join(sections)}</assessment></questestinterop>'


def test_diff_of_two_exports(spark):
    old = bank(titled("t1", "a", "one", "L1"), titled("t2", "b", "two", "L2"), titled("t3", "c", "three"), titled("twin", "d", "x"), titled("twin", "e", "y"), titled("twin", "f", "z"), titled("twin", "g", "z"), titled("gone", "h", "h"))
    new = bank(titled("other title", "a2", "one", "L1"), titled("t2", "b", "two changed", "L2", kind="long"), titled("t3", "c9", "three"), titled("twin", "d2", "y"), titled("twin", "e2", "x"), titled("twin", "f2", "z"), titled("fresh", "n", "n"))
    a, *_ = export(spark, old, [quiz("Q", draw("D", 1, "2", "L1", "L2"), draw("E", 1, "1", "L1")), quiz("R")])
    b, *_ = export(spark, new, [quiz("Q", draw("D", 2, "2", "L1"), draw("F", 1, "1", "L1"), limit=45), quiz("S")])
    told = sorted((r["class"], r.code, r.subject, r.detail) for r in compare.diff(a, b).collect())
    assert [t[:3] for t in told] == [
        ("break", "question_ambiguous", "twin"), ("break", "question_kind", "t2"), ("break", "question_missing", "gone"), ("break", "question_text", "t2"), ("break", "quiz_missing", "R"), ("break", "section_draw", "Q > D"),
        ("break", "section_members", "Q > D"), ("break", "section_missing", "Q > E"), ("note", "question_added", "fresh"), ("note", "quiz_added", "S"), ("note", "section_added", "Q > F"), ("note", "setting", "Q > time_limit"),
    ]
    assert told[-1][3] == "30 -> 45" and told[1][3] == "short -> long"
    assert compare.diff(a, a).filter("code <> 'question_ambiguous'").count() == 0  # twins of one signature stay ambiguous
    c, *_ = export(spark, old, [quiz("Renamed")])
    d, *_ = export(spark, old, [quiz("Q")])
    assert [(r["class"], r.code, r.detail) for r in compare.diff(c, d).filter("code LIKE 'quiz%'").collect()] == [("note", "quiz_title", "Renamed -> Q")]


def test_validation_of_a_package(spark):
    manifest = b'<manifest><resources><resource href="questiondb.xml"/><resource href="gone.xml"/></resources></manifest>'
    rows = [("e", "imsmanifest.xml", manifest, None), ("e", "questiondb.xml", bank(titled("t", "a", "one", "L1", kind="True/False")).encode(), None), ("e", "loose.txt", b"x", None)]
    files = spark.createDataFrame(rows, exports.FILES)
    nodes = exports.read_nodes(files).cache()
    built = model.build(nodes, files.select("snapshot", "file"))
    issues = compare.validate(built, nodes, files)
    assert sorted((r.severity, r.code, r.detail) for r in issues.collect()) == [("error", "missing_href", "gone.xml"), ("error", "native_label", "truefalse_labels"), ("error", "required_file", "quiz_*.xml"), ("warning", "unlisted_file", "loose.txt")]
    assert compare.passes(issues).first().asDict() == {"n_errors": 3, "n_warnings": 1, "passes": False}
    assert compare.passes(issues.filter("severity = 'warning'")).first().passes
