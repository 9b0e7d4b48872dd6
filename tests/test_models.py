"""Documents, payloads, alias classes, typed paths and nested views against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, graph, identity, payloads, project


def plain_leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in plain_leaves(v, f"{path}[{i}]")]
    return [(path, value if isinstance(value, str) else json.dumps(value))]


def any_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return [rng.randrange(-5, 5000), rng.choice(["", "é", 'a"b\\', "\n"]), rng.choice([True, False, None]), round(rng.random(), 3)][kind]
    if kind == 4:
        return [any_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdefgh") + str(i): any_json(rng, depth + 1) for i in range(rng.randrange(4))}


def test_strict_json_reads_what_json_reads():
    rng = random.Random(5)
    for _ in range(300):
        value = any_json(rng)
        for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
            assert [(p, v) for p, _, v, _ in documents.leaves(text)] == plain_leaves(value)
    assert list(documents.leaves("1.50e+3"))[0] == ("$", "number", "1.50e+3", "1.50e+3")
    deep = "[" * 100_000 + "]" * 100_000
    assert len(list(documents.leaves(deep))) == 1


FAULTS = {
    '{"a":1,"b":{"a":2,"a":3}}': ("repeated_key", 18), '{"a":1,"\\u0061":2}': ("repeated_key", 7), '[1,NaN]': ("not_finite", 3), "-Infinity": ("not_finite", 0), "[1,]": ("unexpected_character", 3),
    "{,}": ("unexpected_character", 1), '{"a" 1}': ("unexpected_character", 5), "[1 2]": ("unexpected_character", 3), "": ("unexpected_end", 0), '{"a":': ("unexpected_end", 5), "[1] x": ("unexpected_character", 4),
    "01": ("unexpected_character", 0), "[1}": ("unexpected_character", 2), '"a\nb"': ("unexpected_character", 0), "[nul]": ("unexpected_character", 1), "﻿1": ("unexpected_character", 0), "1.": ("unexpected_character", 0), '{"a":1,}': ("unexpected_character", 7),
}


@pytest.mark.parametrize("text", FAULTS)
def test_strict_json_refuses(text):
    with pytest.raises(documents.Fault) as e:
        list(documents.leaves(text))
    assert (str(e.value), e.value.at) == FAULTS[text]


def test_strict_rows(spark):
    rows = spark.createDataFrame([(1, b'{"a":[1,{}]}'), (2, b"\xff"), (3, None), (4, b"")], "id int, body binary")
    found = {r.id: (r.leaves and [tuple(x) for x in r.leaves], r.fault, r["at"]) for r in documents.strict(rows, "id", "body").collect()}
    assert found == {1: ([("$.a[0]", "number", "1", "1"), ("$.a[1]", "object", "{}", "{}")], None, None), 2: (None, "not_utf8", 0), 3: (None, None, None), 4: (None, "unexpected_end", 0)}
    assert documents.strict(rows.limit(0), "id", "body").count() == 0


def test_tree_keys(spark):
    node = {"kind": "unit", "title": "leaf"}
    for i in range(150):  # deeper than a recursion would like
        node = {"kind": "unit", "title": f"t{i}", "children": [node, "no object", {"identifier": f"id{i}"}]}
    bodies = [(1, json.dumps([node, 7, {"href": " x "}])), (2, "[]"), (3, '{"kind":"no array"}'), (4, None)]
    rows = spark.createDataFrame(bodies, "id int, body string").select("id", F.try_parse_json("body").alias("tree"))
    found = documents.tree_keys(rows, "id", "tree").collect()
    assert {r.id for r in found} == {1} and len(found) == len({r.path for r in found}) == 302
    by_path = {r.path: r for r in found}
    assert by_path["0"].parent_key is None and by_path["2"].alias == "x" and by_path["2"].basis == "href" and by_path["2"].kind == ""
    for r in found:
        above = r.path.rpartition("/")[0]
        assert r.parent_key == (by_path[above].entity_key if above else None) and r.depth == r.path.count("/")
    assert (by_path["0/2"].basis, by_path["0/2"].alias) == ("identifier", "id149") and by_path["0/0"].alias == "0/0|unit|t148"


def test_typed_payloads(spark):
    rows = [
        (1, "multiple_choice", "red || blue", "blue", None), (2, "multi_select", "a || b || a", "a", None), (3, "matching", "", "x -> 1 || y -> 2 || z", None), (4, "ordering", None, "b || a", None),
        (5, "fill_in_blanks", "", "yes", "one: yes || no: a:b || bare"), (6, "short_answer", None, None, None), (7, "odd", None, None, None), (8, None, None, None, None), (9, "multiple_choice", " || ".join(f"c{i}" for i in range(28)), "c27", None),
    ]
    frame = spark.createDataFrame(rows, "id int, kind string, c string, a string, b string")
    found = {r.id: (json.loads(r.p), r.shape_issues) for r in payloads.typed(frame, "kind", "c", "a", "b", "id").select("id", F.to_json("payload").alias("p"), "shape_issues").collect()}
    assert found[1] == ({"options": [{"option_key": "A", "content": "red", "correct": False}, {"option_key": "B", "content": "blue", "correct": True}], "accepted_responses": [], "blanks": [], "match_pairs": [], "correct_order": []}, [])
    assert [o["correct"] for o in found[2][0]["options"]] == [True, False, True]
    assert found[3][0]["match_pairs"] == [{"left_key": "x", "right_key": "1"}, {"left_key": "y", "right_key": "2"}] and found[3][1] == ["pair_without_mark"]
    assert found[4][0]["correct_order"] == [{"option_key": "b", "position": 1}, {"option_key": "a", "position": 2}]
    assert found[5][0]["blanks"] == [{"blank_key": "blank-1", "answer": "yes"}, {"blank_key": "blank-2", "answer": "a:b"}, {"blank_key": "blank-3", "answer": "bare"}]
    assert [found[i][1] for i in (6, 7, 8)] == [["accepted_responses_missing"], ["unknown_kind"], ["unknown_kind"]]
    assert [o["option_key"] for o in found[9][0]["options"]][-3:] == ["Z", "OPT_27", "OPT_28"] and found[9][1] == []
    keyed = spark.createDataFrame([(1, [0]), (2, [0, 2])], "id int, right_places array<int>")
    joined = {r.id: (json.loads(r.p), r.shape_issues) for r in payloads.typed(frame, "kind", "c", "a", "b", "id", keyed).select("id", F.to_json("payload").alias("p"), "shape_issues").collect()}
    assert [o["correct"] for o in joined[1][0]["options"]] == [True, False] and [o["correct"] for o in joined[2][0]["options"]] == [True, False, True]
    assert joined[9][1] == ["key_unresolved", "one_correct_missing"]


def plain_classes(rows):
    parent = {k: k for k, *_ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    seen = {}
    for k, *values in rows:
        for n, v in enumerate(values):
            if v:
                other = seen.setdefault((n, v), k)
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: root(k) for k in parent}


def test_alias_classes_and_conflicts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", f"a{rng.randrange(60)}"]), rng.choice([None, f"b{rng.randrange(80)}"])) for i in range(150)]
    rows += [(i, f"chain{i}", f"chain{i + 1}") for i in range(200, 230)] + [(i, "hot", None) for i in range(300, 500)] + [(500, None, None), (501, "b1", None)]
    rows += [(i, f"link{i - i % 2}", f"link{i + i % 2}") for i in range(600, 640)]  # a long way of pairs
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    aliases = {"first": F.col("a"), "second": F.col("b")}
    found = {r.id: (r.entity, r.basis) for r in identity.alias_classes(frame, "id", aliases).collect()}
    assert {k: e for k, (e, _) in found.items()} == plain_classes(rows)
    assert found[500] == (500, "own") and found[300] == (300, "first") and len(found) == len(rows)
    conflicts = {r.entity: (r.n_rows, r.n_identities, r.identities, r.namespaces) for r in identity.alias_conflicts(frame.filter("id >= 300 AND id < 500 OR id = 200"), "id", aliases, (F.col("id") % 7).cast("string")).collect()}
    assert conflicts == {300: (200, 7, "0,1,2,3,4", "first")}
    assert identity.alias_classes(frame.limit(0), "id", aliases).count() == 0


def test_components_of_awkward_graphs(spark):
    edges = [(1, 2), (2, 1), (3, 3), (4, None), (None, 5), (10, 11), (12, 11), (12, 13)] + [(i, i + 1) for i in range(20, 90)] + [(100, i) for i in range(101, 400)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert found == {1: 1, 2: 1, 3: 3} | {i: 10 for i in range(10, 14)} | {i: 20 for i in range(20, 91)} | {i: 100 for i in range(100, 400)}
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_typed_paths(spark):
    nodes = [("q1", "quiz"), ("q2", "quiz"), ("s", "section"), ("d1", "draw"), ("d2", "draw"), ("d3", "draw"), ("p1", "pool"), ("p2", "pool"), ("x", "quiz")] + [(f"i{k}", "item") for k in range(300)]
    edges = [("contains", "q1", "s"), ("contains", "s", "d1"), ("contains", "s", "d2"), ("contains", "d2", "s"), ("contains", "q1", "d3"), ("draws", "d1", "p1"), ("draws", "d2", "p1"), ("draws", "d2", "p2"), ("draws", "d3", "x"), ("draws", "d3", "gone")]
    edges += [("member", f"i{k}", "p1") for k in range(300)] + [("member", "lost", "p2"), ("member", None, "p2")]
    hops = [graph.Hop("contains", ("draw",), transitive=True), graph.Hop("draws", ("pool",), 1, 1), graph.Hop("member", ("item",), against=True, once=True)]
    starts = [("q1",), ("q2",), ("nobody",), ("q1",)]
    paths, against = graph.typed_paths(spark.createDataFrame(nodes, "node string, kind string"), spark.createDataFrame(edges, "kind string, src string, dst string"), spark.createDataFrame(starts, "node string"), hops)
    assert sorted({(r.h0, r.h1, r.h2) for r in paths.collect()}) == [("q1", "d1", "p1"), ("q1", "d2", "p1")] and paths.count() == 600
    told = sorted((r.hop, r.node, r.code, r.n) for r in against.collect())
    assert told == [
        (0, "nobody", "unknown", 1), (1, "q2", "too_few", 0), (2, "d2", "too_many", 2), (2, "d3", "dangling", 1), (2, "d3", "too_few", 0), (2, "d3", "wrong_kind", 1), (3, "p2", "dangling", 2), (3, "p2", "too_few", 0),
    ]


def test_linked_views(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "again"), (None, "null")], "id int, name string")
    placed = spark.createDataFrame([(1, i, f"o{i}") for i in range(2500)] + [(3, 1, "x"), (9, 1, "y"), (9, 2, "z"), (None, 1, "n")], "id int, n int, o string")
    view, issues = project.linked_views(entities, placed, "id", [F.col("n")], ["n", "o"])
    rows = view.collect()
    hot = sorted((r.part, [x.n for x in r.rows]) for r in rows if r.id == 1)
    assert [p for p, _ in hot] == [0, 1, 2] and [n for _, part in hot for n in part] == list(range(2500))
    assert sorted((r.name, r.part, r.n_rows) for r in rows if r.id != 1) == [("again", 0, 1), ("b", 0, 0), ("c", 0, 1), ("null", 0, 0)]
    assert sorted(((r.id, r.code, r.n) for r in issues.collect()), key=repr) == [(2, "unplaced", 1), (3, "repeated", 2), (9, "orphaned", 2)]


def test_records(spark):
    from tessera.functions import records

    C = F.col
    paths = {"file:///home/me/x.png": "[absolute local path withheld]/x.png", "/tmp/a/": "[absolute local path withheld]/a", "C:\\Users\\me\\b.doc": "[absolute local path withheld]/b.doc", "/": "[absolute local path withheld]", "pics/a.png": "pics/a.png", "http://x.org/a": "http://x.org/a", "": "", None: None, "\\\\host\\share\\c": "[absolute local path withheld]/c", "file:": "[absolute local path withheld]"}
    frame = spark.createDataFrame([(p,) for p in paths], "p string").select("p", records.local_reference(C("p")).alias("r"))
    assert {r.p: r.r for r in frame.collect()} == paths
    states = spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "a string, b string").select(records.match_state(C("a"), C("b")).alias("s"))
    assert [r.s for r in states.collect()] == ["a", "b", "not_recorded"]
    kind = "id int, models array<struct<source_kind:string,payload:map<string,string>>>"
    rows = spark.createDataFrame([(1, [("row:a", {"q": "1", "my_absolute_path": "x"}), ("row:b", {"my_absolute_path": "y", "q": "1"}), ("fact", {"q": "9"}), ("row:c", None), (None, {"q": "1"})]), (2, [("row:a", {"q": "1"}), ("row:a", {"q": "2"})]), (3, []), (4, None)], kind)
    found = rows.withColumn("p", records.canonical_payloads(C("models"), "row:")).select("id", F.size("p").alias("n"), records.fidelity(C("p")).alias("f"), F.transform("p", records.safe_row).alias("p"))
    assert {r.id: (r.n, r.f.authored_variant_count, r.f.variant_conflict) for r in found.filter("id < 4").collect()} == {1: (2, 1, False), 2: (2, 2, True), 3: (0, 0, False)}
    assert found.filter("id = 1").first().p == [{"q": "1"}, {"q": "1"}]
    told = spark.createDataFrame([([("right", "yes"), (None, "well"), ("x", "")],), ([],), (None,)], "f array<struct<channel:string,content:string>>").select(records.feedback_text(C("f")).alias("t"))
    assert [r.t for r in told.collect()] == ["right: yes\nfeedback: well", "", ""]
    named = spark.createDataFrame([([("n", "1"), ("m", "2"), ("n", ""), ("n", "3")],)], "a array<struct<namespace:string,value:string>>").select(records.aliases_in(C("a"), "n").alias("v"))
    assert named.first().v == ["1", "3"]
    rich = spark.createDataFrame([("x", "latex"), ("x", "html"), (" ", "html"), ("x", "doc"), ("x", None)], "v string, f string").select(records.rich_text(C("v"), C("f")).alias("r"))
    assert [tuple(r.r) for r in rich.collect()] == [("plain_text", "x", "latex", None), ("html", "x", None, None), (None, None, None, "text_missing"), (None, None, None, "format_unknown"), (None, None, None, "format_unknown")]
    flat = [(["a", "b"], "a || b", "text_entry", 1, "Blank 1: a / b", None), (["a"], "a", "text_entry", 2, "Blank 1: a", ""), ([], "", "text_entry", 1, "Blank 1: ", ""), (["a"], None, "text_entry", 1, "Blank 1: a", "")]
    agrees = spark.createDataFrame(flat, "v array<string>, a string, b string, n int, t string, c string").select(records.short_answer_agrees(*map(C, "vabntc")).alias("x"))
    assert [r.x for r in agrees.collect()] == [True, False, False, False]
