from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import exports, sinks
from tessera.streaming import events


def item(ident, prompt, choices=(), kind="multiple", label="", **fields):
    meta = "".join(f"<qti_metadatafield><fieldlabel>{k}</fieldlabel><fieldentry>{v}</fieldentry></qti_metadatafield>" for k, v in {"qmd_questiontype": kind, **fields}.items())
    options = "".join(f'<response_label ident="c{i}"><material><mattext>{c}</mattext></material></response_label>' for i, c in enumerate(choices))
    return f'<item ident="{ident}" label="{label}"><itemmetadata>{meta}</itemmetadata><presentation><material><mattext>&lt;p&gt;{prompt}&lt;/p&gt;</mattext></material>{options}</presentation></item>'


LONG = "Which of these statements about the slow rivers of the northern plain is the most accurate one of all"
LIBRARY = f"""<questestinterop><objectbank><section title="Bank" ident="b"><section title="Pool A" ident="pa">
{item("l1", "What is two plus two", ("3", "4"), label="L1")}{item("l2", "Same text")}{item("l3", "Same text")}</section>
<section title="Pool B" ident="pb">{item("l4", "Elsewhere", qmd_displayid="D4")}{item("l5", "Twice told")}{item("l6", LONG)}</section></section>{item("l7", "Twice told")}</objectbank></questestinterop>"""
QUIZ = f"""<questestinterop><assessment title="Q" ident="q"><section title="S" ident="s">
{item("i1", "WHAT is  two plus two", ("3", "4"))}<itemref linkrefid="L1"/><itemref linkrefid="none"/>{item("i2", "Same text")}{item("i3", "Other", qmd_displayid="D4")}{item("i4", "Twice told")}{item("i5", LONG + "s")}{item("i6", "No such text at all")}</section></assessment></questestinterop>"""


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("export")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("questiondb.xml", LIBRARY)
        z.writestr("quiz_1.xml", QUIZ)
        z.writestr("broken.xml", "<a><b></a>")
        z.writestr("../evil.xml", "<a/>")
    (folder / "export.zip").write_bytes(data.getvalue())
    (folder / "bad.zip").write_bytes(b"no archive")
    return str(folder)


def test_archives_are_opened_with_guards(spark, archive):
    found = {r.file: r.error for r in exports.read_files(spark, archive).collect()}
    assert found == {"questiondb.xml": None, "quiz_1.xml": None, "broken.xml": None, "../evil.xml": "unsafe_path", "bad.zip": "bad_archive"}


def test_items_link_by_the_first_sure_evidence(spark, archive):
    nodes = exports.read_nodes(exports.read_files(spark, archive)).cache()
    assert [r.file for r in nodes.filter("error IS NOT NULL").collect()] == ["broken.xml"]
    found = exports.items(nodes).cache()
    library, quiz = found.filter("file = 'questiondb.xml'"), found.filter("file = 'quiz_1.xml'")
    paths = {r.ident: (r.section_path, r.n_choices) for r in library.collect()}
    assert paths["l1"] == ("Bank > Pool A", 2) and paths["l4"] == ("Bank > Pool B", 0) and paths["l7"][0] == ""
    linked = {r.item_number: (r.evidence_level, r.match_basis, r.record and int(r.record[-8:])) for r in exports.link_items(library, quiz).collect()}
    assert linked == {
        1: ("inferred_exact", "signature", 1),
        2: ("source_evidence", "label", 1),
        3: ("unmatched", "unmatched", None),
        4: ("inferred_exact", "signature", 2),
        5: ("source_evidence", "displayid", 4),
        6: ("unmatched", "unmatched", None),
        7: ("inferred_similarity", "similarity_key", 6),
        8: ("unmatched", "unmatched", None),
    }


def test_shards_and_their_manifest(spark, tmp_path):
    rows = spark.range(25).withColumn("g", F.when(F.col("id") < 20, "a").otherwise("b"))
    manifest = sinks.write_shards(rows, str(tmp_path / "out"), ["g"], [F.col("id")], 8).collect()
    assert {(r.g, r.shard, r.n_rows) for r in manifest} == {("a", 0, 8), ("a", 1, 8), ("a", 2, 4), ("b", 0, 5)}
    assert spark.read.text(str(tmp_path / "out")).count() == 25
    sinks.write_tables({"t": rows}, str(tmp_path / "staged"), "csv")
    sinks.commit(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    sinks.write_tables({"t": rows.limit(3)}, str(tmp_path / "staged"), "csv")
    sinks.commit(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "final/t")).count() == 3


def test_event_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 00:20:00"), (4, "a", "2024-01-01 01:20:00"), (1, "b", "2024-01-01 01:30:00"), (1, "b", "2024-01-01 01:30:00")], "n long, k string, at string").withColumn("at", F.to_timestamp("at"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))

    def ran(stream, name, mode):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    stream = events.read_events(spark, str(tmp_path / "in"), rows.schema)
    assert sorted((r.start.hour, r.k, r.n_events) for r in ran(events.windowed_counts(stream, "at", "k"), "counts", "complete")) == [(0, "a", 2), (1, "a", 1), (1, "b", 2)]
    assert len(ran(events.first_occurrences(stream, ["k", "n"], "at"), "firsts", "append")) == 4
    assert sorted((r.k, r.expected, r.found) for r in ran(events.sequence_breaks(stream, "k", "n"), "breaks", "append")) == [("a", 3, 4), ("b", 2, 1)]


SCORED = """<q><assessment title="t"><section title="S" ident="s"><qtimetadata><qti_metadatafield><fieldlabel>qmd_numberofitems</fieldlabel><fieldentry>3</fieldentry></qti_metadatafield></qtimetadata>
<item ident="a"><presentation><response_label ident="A1"/><response_label ident="A2"/></presentation><resprocessing>
<respcondition><conditionvar><varequal respident="r">A1</varequal><not><varequal respident="r">A2</varequal></not></conditionvar><setvar varname="que_score">100</setvar><displayfeedback linkrefid="F1"/></respcondition>
<respcondition><conditionvar><varequal respident="r">A2</varequal></conditionvar><setvar varname="x">0</setvar><displayfeedback linkrefid="F2"/></respcondition>
<respcondition><conditionvar><varequal respident="r">A2</varequal></conditionvar><displayfeedback linkrefid="F3"/></respcondition></resprocessing>
<itemfeedback ident="F1"><mattext>well done</mattext></itemfeedback><itemfeedback ident="F2"><mattext>no</mattext></itemfeedback><itemfeedback ident="F3"><mattext>look again</mattext></itemfeedback><itemfeedback ident="F4"><mattext>note</mattext></itemfeedback></item>
<item ident="b"><resprocessing><respcondition><conditionvar><varequal respident="r">paris</varequal></conditionvar><setvar varname="Part_Correct"/></respcondition></resprocessing></item>
<section title="Inner"><item ident="c"><answer_key><mattext>see guide</mattext></answer_key></item><itemref linkrefid="z"/></section><item ident="d"/></section></assessment></q>"""


def test_keys_feedback_and_sections(spark, tmp_path):
    from tessera.sources import responses

    (tmp_path / "quiz.xml").write_text(SCORED)
    nodes = exports.read_nodes(exports.read_files(spark, str(tmp_path))).cache()
    keys = {r.ident: (list(r.key), r.basis) for r in responses.answer_keys(nodes).collect()}
    assert keys == {"a": (["A1"], "choice"), "b": (["paris"], "literal"), "c": ([], "manual"), "d": ([], "not_found")}
    channels = {r.feedback: (r.channel, r.chosen, r.content) for r in responses.feedback(nodes).collect()}
    assert channels == {"F1": ("correct", None, "well done"), "F2": ("incorrect", None, "no"), "F3": ("choice", "A2", "look again"), "F4": ("general", None, "note")}
    found = {r.section_path: (r.draw_count, r.n_items, r.n_references, r.state) for r in responses.sections(nodes).collect()}
    assert found == {"S": (3, 3, 0, "draw"), "S > Inner": (None, 1, 1, "fixed")}


RICH = """<q><assessment><section title="S"><item ident="m"><itemmetadata><qtimetadata/></itemmetadata><presentation><flow><material><mattext>Part &lt;b&gt;one&lt;/b&gt;</mattext></material>
<flow><material><mattext>and</mattext></material><response_str ident="s1"><render_fib><response_label ident="A1"/></render_fib></response_str><material><mattext>then</mattext></material><response_str ident="s2"><response_label ident="A2"/></response_str></flow></flow>
<response_lid><render_choice><flow_label><response_label ident="c1"><material><mattext>red</mattext></material></response_label></flow_label><flow_label><response_label ident="c2"><material><mattext>blue</mattext></material></response_label></flow_label></render_choice></response_lid></presentation>
<resprocessing><respcondition><conditionvar><varequal respident="A1">x</varequal><varequal respident="A1">y</varequal></conditionvar><setvar>50</setvar></respcondition></resprocessing>
<itemfeedback ident="F"><material><mattext>well done</mattext></material></itemfeedback></item>
<item ident="g"><presentation><response_grp respident="G1"><material><mattext>capital of France</mattext></material><render_choice><response_label ident="p"><material><mattext>Paris</mattext></material></response_label><response_label ident="r"><material><mattext>Rome</mattext></material></response_label></render_choice></response_grp>
<response_grp respident="G2"><material><mattext>capital of Italy</mattext></material><render_choice><response_label ident="p"><material><mattext>Paris</mattext></material></response_label><response_label ident="r"><material><mattext>Rome</mattext></material></response_label></render_choice></response_grp></presentation></item></section></assessment></q>"""


def test_prompts_of_several_blocks_blanks_and_matching(spark, tmp_path):
    from tessera.sources import responses

    (tmp_path / "quiz.xml").write_text(RICH)
    (tmp_path / "grown.xml").write_text('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')
    nodes = exports.read_nodes(exports.read_files(spark, str(tmp_path))).cache()
    assert [r.file for r in nodes.filter("error IS NOT NULL").collect()] == ["grown.xml"]
    found = {r.ident: r for r in exports.items(nodes).collect()}
    assert (found["m"].prompt, found["m"].n_choices) == ("Part one and [Blank 1] then [Blank 2]", 2) and "well done" not in found["m"].signature
    lines = {r.item_node: (r.blank_count, r.blank_answers) for r in responses.blank_answers(nodes).collect()}
    assert list(lines.values()) == [(2, "Blank 1: x / y")]
    sides = sorted((r.side, r.place, r.ident, r.said) for r in responses.matching(nodes).collect())
    assert [(a, c, d) for a, _, c, d in sides] == [("option", "p", "Paris"), ("option", "r", "Rome"), ("prompt", "G1", "capital of France"), ("prompt", "G2", "capital of Italy")]


def test_similarity_is_sought_among_records_of_as_many_choices(spark, tmp_path):
    text = LONG + " and of its many winding tributaries"
    library = f"""<q><objectbank><section title="P" ident="p">{item("a", text, ("1", "2", "3"))}{item("b", text + "s", ("1", "2"))}{item("c", text + " x", kind="other")}</section></objectbank></q>"""
    quiz = f"""<q><assessment><section title="S">{item("i", text + "z", ("8", "9"))}{item("j", text + "z", ("6", "7", "8", "9"), kind="none such")}</section></assessment></q>"""
    (tmp_path / "questiondb.xml").write_text(library)
    (tmp_path / "quiz_1.xml").write_text(quiz)
    found = exports.items(exports.read_nodes(exports.read_files(spark, str(tmp_path)))).cache()
    linked = exports.link_items(found.filter("file = 'questiondb.xml'"), found.filter("file = 'quiz_1.xml'")).collect()
    # i: only b has two choices; j: its kind has no record, so all are sought, and of these only c, which has no choices
    assert {r.ident: (r.evidence_level, r.record and int(r.record[-8:])) for r in linked} == {"i": ("inferred_similarity", 2), "j": ("inferred_similarity", 3)}


def test_labels_of_true_false_and_keys_of_several_choices(spark, tmp_path):
    from tessera.sources import responses

    def bare(ident, words, form="text/plain", kind="True/False", more=""):
        labels = "".join(f'<response_label ident="{w}"><material><mattext texttype="{form}">{w}</mattext></material></response_label>' for w in words)
        return f'<item ident="{ident}"><itemmetadata><m><fieldlabel>qmd_questiontype</fieldlabel><fieldentry>{kind}</fieldentry></m></itemmetadata><presentation>{labels}</presentation>{more}</item>'

    key = '<resprocessing><respcondition><conditionvar><varequal>a</varequal></conditionvar><setvar action="Add">1</setvar></respcondition><respcondition><conditionvar/><setvar action="Add">0</setvar></respcondition></resprocessing><grading_type>0</grading_type>'
    parts = [bare("ok", ("True", "False")), bare("turned", ("False", "True")), bare("html", ("True", "False"), "text/html"), bare("none", ()), bare("key", "ab", kind="Multi-Select", more=key), bare("nokey", "ab", kind="Multi-Select")]
    (tmp_path / "q.xml").write_text(f"<q>{''.join(parts)}</q>")
    nodes = exports.read_nodes(exports.read_files(spark, str(tmp_path)))
    assert {(r.identity, r.code) for r in responses.label_issues(nodes).collect()} == {("turned", "truefalse_labels"), ("none", "truefalse_labels"), ("html", "truefalse_texttype"), ("nokey", "multiselect_key")}


def test_sheets_give_questions_sections_and_issues(spark, tmp_path):
    from tessera.sources import sheets

    (tmp_path / "Bank1.csv").write_text(
        "Question Code,Bank-ID,Target Question Type,Points,Option A,Option B,Correct Option Key,Correct Option Text,Scoring Policy,Question Text\n"
        '001,B1,Multiple Choice,2.50,red,blue,,BLUE,,"two\nlines, quoted"\n002,B1,True/False,,,,t,,,x\n003,B2,Multi-Select,1,a,b,"b;a",,PARTIAL,y\n\n003,B2,multi select,no,a,b,a,,,z\n'
    )
    (tmp_path / "Quiz_Structure.csv").write_text("section_order,section_title,source_bank_id,recommended_draw_count\n1,First,B1,3\n2,,B9,1\n")
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n")
    cells = sheets.read_cells(spark, str(tmp_path)).cache()
    assert [(r.sheet, r.error) for r in cells.filter("error IS NOT NULL").collect()] == [("bad", "duplicate_header")]
    assert {r.header for r in sheets.missing_headers(cells.filter("sheet = 'Bank1'"), ["Question Code", "Notes"]).collect()} == {"Notes"}
    found = sheets.rows(cells).cache()
    held = sheets.questions(found)
    got = {(r.question_code, r.kind): (r.bank_id, r.points, list(r.options), list(r.answer_keys), r.question_text) for r in held.collect()}
    assert got["001", "MULTIPLECHOICE"] == ("B1", 2.5, ["red", "blue"], ["B"], "two\nlines, quoted")
    assert got["002", "TRUEFALSE"] == ("B1", 1.0, ["True", "False"], ["A"], "x") and got["003", "MULTISELECT"][1] in (1.0, None)
    drawn = sheets.sections(found, held)
    assert {(r.section_order, r.section_title, r.bank_id, r.draws, r.available) for r in drawn.collect()} == {(1, "First", "B1", 3, 2), (2, "B9", "B9", 1, 0)}
    issues = {(r.code, r.entity_key) for r in sheets.intake_issues(held, drawn).collect()}
    assert issues == {("duplicate_code", "003"), ("scoring_policy", "003"), ("points", "003"), ("empty_bank", "B9"), ("draws_too_many", "First")}
    made = sheets.sections(found.filter("sheet = 'Bank1'"), held)
    assert {(r.section_order, r.bank_id, r.draws) for r in made.collect()} == {(1, "B1", 2), (2, "B2", 2)}


def test_packages(spark, tmp_path):
    from tessera.sources import packages

    data = io.BytesIO()
    head = '<manifest xmlns="http://www.imsglobal.org/xsd/imscp_v1p1" xmlns:ns0="urn:x" xmlns:m="http://www.imsglobal.org/xsd/imsmd_rootv1p2p1" xmlns:o="http://www.imsglobal.org/xsd/imsmd_v1p2">'
    listed = '<resource type="page" href="a%20b.html"/><resource type="page" href="gone.html"/><resource href="/d2l/x"/><resource type="link" href="https://a.org"/><resource type="page" href="../up.html"/>'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("wrapped/imsmanifest.xml", f"{head}{listed}</manifest>")
        z.writestr("wrapped/deep/imsmanifest.xml", "<manifest/>")
        z.writestr("wrapped/a b.html", "x")
        z.writestr("wrapped/grades_d2l.xml", '<grades><item identifier="g1" resource_code="r"><name> Quiz 1 </name></item><item identifier="g2"/></grades>')
    (tmp_path / "p.zip").write_bytes(data.getvalue())
    files = exports.read_files(spark, str(tmp_path)).cache()
    nodes = exports.read_nodes(files).cache()
    assert {(r.folder, r.is_first) for r in packages.manifests(files).collect()} == {("wrapped", True), ("wrapped/deep", False)}
    assert [(r.root, r.manifest) for r in packages.roots(files).collect()] == [("wrapped", "wrapped/imsmanifest.xml")]
    assert {(r.identifier, r.resource_code, r.name) for r in packages.grade_items(nodes).collect()} == {("g1", "r", "Quiz 1"), ("g2", "", "")}
    assert {(r.type, r.n_resources) for r in packages.resource_types(nodes).collect()} == {("page", 3), ("(untyped)", 1), ("link", 1)}
    assert {r.href for r in packages.missing_hrefs(nodes, files).collect()} == {"gone.html", "../up.html"}
    first = packages.namespaces(files.filter("file = 'wrapped/imsmanifest.xml'"))
    assert {(r.code, r.detail) for r in packages.namespace_issues(first).collect()} == {("invented_prefix", "ns0"), ("missing_namespace", "http://desire2learn.com/xsd/d2lcp_v2p0"), ("metadata_prefix", "m"), ("metadata_version", "http://www.imsglobal.org/xsd/imsmd_v1p2")}


def test_payloads_and_the_one_quiz(spark):
    from tessera.sources import packages

    bodies = {"a.Item.JSON": b'{"id": " p1 "}', "b.item.json": b'{"id": 7}', "c.item.json": b'{"id": ""}', "d.item.json": b"[1]", "e.item.json": b"{", "f.item.json": b"\xff", "x/g.item.json": b'{"id": {"x": 1}}', "h.txt": b"{}", "i.item.json": b'{"id": true}', "j.item.json": b"", "k.item.json": b'{"id": 7.0}'}
    files = spark.createDataFrame([("s", f, c, None) for f, c in bodies.items()], exports.FILES)
    found = {r.basename: (r.payload_id, r.state, r.error) for r in packages.payloads(files, ".item.json").collect()}
    assert found == {
        "a.Item.JSON": ("p1", "parsed", None), "b.item.json": ("7", "parsed", None), "c.item.json": (None, "invalid", "id_missing"), "d.item.json": (None, "invalid", "no_object"), "e.item.json": (None, "invalid", "not_json"),
        "f.item.json": (None, "invalid", "not_utf8"), "g.item.json": (None, "invalid", "id_missing"), "i.item.json": (None, "invalid", "id_missing"), "j.item.json": (None, "invalid", "not_json"), "k.item.json": ("7", "parsed", None),
    }
    quizzes = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    told = lambda rows, want: tuple([tuple(r) for r in x.collect()] for x in packages.one_of(rows, "key", want))
    assert told(quizzes, "b") == ([("b", 2)], []) and told(quizzes, "c") == ([], [("not_found", 0)])
    assert told(quizzes, None) == ([], [("several", 2)]) and told(quizzes.filter("n = 1"), None) == ([("a", 1)], []) and told(quizzes.limit(0), "") == ([], [("not_found", 0)])
