from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys, markup, text
from tessera.operators import changes, graph, identity, intake, link, project, rules, scan


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("  Two  “quoted”\n words – Here ", 'two "quoted" words - here'), ("", ""), (None, None)],
)
def test_exact_key(spark, given, wanted):
    assert one(spark, text.exact_key(F.col("t")), t=given) == wanted


def test_similarity_key_applies_spoken_forms_in_order(spark):
    assert one(spark, text.similarity_key(F.col("t")), t="One third PLUS x-axis squared") == "1 3 x axis 2"


def test_paths(spark):
    assert one(spark, text.package_path(F.col("t")), t="./a//b\\c.png?x=1#y") == "a/b/c.png"
    assert one(spark, text.package_path(F.col("t")), t="https://host/p/q") == "p/q"
    assert [one(spark, text.safe_member(F.col("t")), t=x) for x in ("a/b", "../a", "/a", "a/%2fb", "C:x")] == [True, False, False, False, False]


def test_local_refs(spark):
    html = '<a href="/x?q=1"></a><img src="b.png"><a href="http://z"></a><a href="/x#t"></a><a href="mailto:a@b"></a>'
    assert one(spark, text.local_refs(F.col("t")), t=html) == ["/x", "b.png"]


def test_scalars(spark):
    assert [one(spark, text.scalar_kind(F.col("t")), t=x) for x in (" YES", "+3", "2.50", "x", " ", None)] == ["boolean", "integer", "decimal", "text", "empty", "empty"]
    assert [one(spark, text.scalar_value(F.col("t")), t=x) for x in (" YES", "+3", "x ")] == ["true", "3", "x"]


def test_markup():
    assert markup.unescape_all("&amp;amp;lt;") == "<"
    assert markup.render_html("<p>a</p><p>b &amp;amp; c</p><img alt='x^2'>") == "a b & c x^2"
    assert markup.linear_math("<math><mfrac><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow><mi>b</mi></mfrac></math>") == "(a + 1)/b"
    assert markup.linear_math("<math>") == "" and markup.linear_math("<!DOCTYPE m [<!ENTITY a 'b'>]><math>&a;</math>") == ""
    said = {
        "<msqrt><mi>x</mi><mo>+</mo><mn>1</mn></msqrt>": "√(x + 1)",
        "<msup><mi>x</mi><mn>2</mn></msup>": "x²",
        "<msup><mrow><mi>a</mi><mo>*</mo><mi>b</mi></mrow><mi>k</mi></msup>": "(a × b)^k",
        "<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>": "x₁²",
        "<mroot><mi>x</mi><mn>3</mn></mroot>": "3√x",
        "<mfenced><mi>a</mi><mi>b</mi></mfenced>": "(a, b)",
        "<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable>": "[1, 2; 3]",
        "<munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover>": "∑_i^n",
        "<semantics><mi>q</mi><annotation>no</annotation></semantics>": "q",
        "<mi>a</mi><mo>−</mo><mi>b</mi>": "a - b",
    }
    for inner, wanted in said.items():
        assert markup.linear_math(f"<math>{inner}</math>") == wanted, inner
    assert markup.linear_math("«math»«mi»x«/mi»«mo»§lt;«/mo»«/math»") == "" and markup.linear_math("«math»«mi»x«/mi»«/math»") == "x"
    assert markup.render_html("<img alt='x squared plus one half'>") == "x² + 1/2"


def test_keys_last_through_refreshes(spark):
    key = keys.entity_key("q", F.col("lineage"), F.col("code"), F.lit("label"), F.col("alias"))
    coded = [one(spark, key, lineage=x, code="Q 1", alias=y) for x, y in (("a", "1"), ("b", "2"))]
    assert coded[0] == coded[1] and ":q-1:" in coded[0]
    assert one(spark, key, lineage="a", code=None, alias="1") != one(spark, key, lineage="b", code=None, alias="1")


def test_unique_gate_and_ladder(spark):
    records = spark.createDataFrame([(1, "k1", "p"), (2, "k2", "p"), (3, "k2", "p"), (4, "k3", "p"), (5, "k3", "q"), (6, None, "p"), (7, "", "p")], "rec int, key string, pool string")
    gate = link.unique_gate(records, "key", "pool", "rec")
    assert {r.key: (r.rec, r.is_shared) for r in gate.collect()} == {"k1": (1, False), "k2": (2, True)}
    items = spark.createDataFrame([(10, "k1"), (11, "k2"), (12, "k3"), (13, None)], "item int, key string")
    found = link.ladder(items, "item", [("inferred_exact", "text", gate, "key")], "rec")
    assert {r.item: (r.rec, r.evidence_level) for r in found.collect()} == {10: (1, "inferred_exact"), 11: (2, "inferred_exact"), 12: (None, "unmatched"), 13: (None, "unmatched")}


def test_reference_ladder(spark):
    files = spark.createDataFrame([("a/x.png",), ("b/y.png",), ("c/y.png",), ("t/z.png",)], "path string")
    refs = spark.createDataFrame([("a/x.png",), ("content/enforced/9/t/z.png",), ("q/x.png",), ("q/y.png",)], "ref string")
    assert {r.ref: r.basis for r in link.resolve_refs(refs, files).collect()} == {"a/x.png": "normalized_ref", "content/enforced/9/t/z.png": "content_enforced_tail", "q/x.png": "unique_basename", "q/y.png": "not_found"}


def test_similarity_candidates_lose_none(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank on a sunny day"
    words = base.split()
    texts = [" ".join(w for i, w in enumerate(words) if i % (k + 2)) for k in range(0, 30, 3)] + [base, base + " x", "other words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "item int, key string")
    found = {(r.item, r.rec): r.score for r in link.similarity_candidates(rows, rows.withColumnRenamed("item", "rec"), "item", "rec", "key").collect()}
    wanted = {(i, j): round(s, 6) for i, a in enumerate(texts) for j, b in enumerate(texts) if (s := SequenceMatcher(None, a, b).ratio()) >= 0.92}
    assert found == wanted
    best = {r.item: (r.rec, r.evidence_level) for r in link.similarity_links(rows.filter("item = 12"), rows.filter("item <> 12").withColumnRenamed("item", "rec"), "item", "rec", "key").collect()}
    assert best == {}


def test_star_edges_and_first_hit(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "id int, t string")
    assert {(r.id, r.representative, r.class_size) for r in identity.star_edges(rows, "id", F.col("t")).collect()} == {(3, 1, 3), (5, 1, 3)}


def test_three_way(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "a", "p")], "k int, x string, y string")
    current = spark.createDataFrame([(1, "a", "p"), (2, "c", "p"), (3, "a", "p")], "k int, x string, y string")
    edited = spark.createDataFrame([(1, "b", "p"), (2, "b", "z"), (4, "n", "n")], "k int, x string, y string")
    found = {(r.k, r.field): r.decision for r in changes.three_way(base, current, edited, "k", ["x", "y"], ["y"]).collect()}
    assert found == {(1, "x"): "accept", (2, "x"): "conflict", (2, "y"): "refuse", (3, "x"): "removed", (3, "y"): "removed", (4, "x"): "added", (4, "y"): "added"}


def test_pairing(spark):
    a = spark.createDataFrame([(1, "c1", "t"), (2, None, "t2"), (3, None, "t3"), (4, None, "t3")], "a int, code string, title string")
    b = spark.createDataFrame([(9, "c1", "other"), (8, None, "t2"), (7, None, "t3")], "b int, code string, title string")
    assert {(r.a, r.b, r.matched_by) for r in changes.pair_by(a, b, ["code", "title"], "a", "b").collect()} == {(1, 9, "code"), (2, 8, "title")}


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    found = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.depth for r in found.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_division(spark):
    pairs = spark.createDataFrame([(1, "g"), (2, "g"), (1, "h")], "m int, grp string")
    required = spark.createDataFrame([("o", 1), ("o", 2), ("p", 1)], "owner string, m int")
    assert {tuple(r) for r in graph.divide(pairs, "m", "grp", required, "owner").collect()} == {("o", "g"), ("p", "g"), ("p", "h")}


def test_rules(spark):
    rows = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1)], "g int, n int")
    assert [r.entity_key for r in rules.gaps(rows, ["g"], "n", "gap").collect()] == ["1"]
    found = rules.report(rules.union_all([rules.repeated(rows, ["g"], "twice"), rules.dangling(rows, "g", "n", spark.createDataFrame([(0,), (1,)], "t int"), "t", "lost", "info")]))
    assert {(r.code, r.n_issues, r["rank"], r.blocks) for r in found.collect()} == {("twice", 2, 1, True), ("lost", 1, 3, False)}


def test_intake(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "g string, n int")
    assert {r.g: r.is_permutation for r in intake.permutation(rows, "g", "n").collect()} == {"a": True, "b": False}
    assert [one(spark, intake.exact_decimal(F.col("t")), t=x) is not None for x in ("1.5", "1e3", "0.1234567891", "-2")] == [True, False, False, True]


def test_order_and_lanes(spark):
    rows = spark.createDataFrame([("g", 0, "z"), ("g", 5, "a"), ("g", None, "b")], "g string, n int, k string")
    assert [r.k for r in project.ordered(rows, "g", [F.col("n"), F.col("k")]).orderBy("running").collect()] == ["a", "b", "z"]
    assert {(r.k, r.lane) for r in project.lanes(rows, "k", {"none": F.col("n").isNull(), "big": F.col("n") > 1}).collect()} == {("b", "none"), ("a", "big")}


def test_scans(spark):
    rows = spark.createDataFrame([(1, "x\nmail a.b@c.org and d@e.io\npassword=abcdef12"), (2, None), (3, "")], "id int, t string")
    assert {(r.id, r.line_number, r.rule, r.n_found) for r in scan.scan_lines(rows, "id", "t").collect()} == {(1, 2, "email", 2), (1, 3, "secret", 1)}
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": null}'), (2, "not json"), (3, None)], "id int, j string")
    assert {tuple(r) for r in scan.json_leaves(docs, "id", "j").collect()} == {(1, "$.a[0]", "1"), (1, "$.a[1].b", "x"), (1, "$.c", "null"), (2, None, "not json")}


def test_spoken_mathematics(spark):
    from tessera.functions import mathtext

    said = {
        "fraction numerator a plus 1 over denominator b end fraction": "(a + 1)/b",
        "fraction numerator fraction numerator a over denominator b end fraction over denominator c plus 1 end fraction squared": "(a/b)/(c + 1)²",
        "fraction numerator never closed": "fraction numerator never closed",
        "f ( x ) is greater than or equal to 3 x": "f(x) is ≥ 3x",
        "sometimes open bracket - y close bracket": "sometimes [-y]",
        "2 to the power of - 3": "2⁻³",
        "fraction numerator x over denominator y end fraction": "x/y",
        "x squared plus three fourths": "x² + 3/4",
        "x to the power of 5 end exponent equals negative 2": "x⁵ =-2",
        "y to the power of k": "y^k",
        "( 3 ) , 4 = - 2": "(3), 4 =-2",
        "the (x, y)": "the (x, y)",
        "and (see: note)": "and (see: note)",
        "sin ( x + 1 ) and of ((a) b": "sin(x + 1) and of ((a) b",
        "log (": "log (",
    }
    for given, wanted in said.items():
        assert one(spark, mathtext.symbols(F.col("t")), t=given) == wanted
    assert one(spark, mathtext.raised(F.col("t")), t="-12") == "⁻¹²" and one(spark, mathtext.raised(F.col("t")), t="x") is None
    assert [one(spark, mathtext.bracketed(F.col("t")), t=x) for x in ("a b", "ab", "(a b)")] == ["(a b)", "ab", "(a b)"]
    assert one(spark, mathtext.operator(F.col("t")), t=" * ") == "×"


def test_numbers_and_unique_names(spark):
    rows = spark.createDataFrame([(1, "b", 5), (0, "a", 9), (1, "b", 3), (0, None, 1)], "kind int, name string, id int")
    assert {r.id: r.number for r in project.numbered(rows, "kind", [F.col("id")]).collect()} == {1: 1, 9: 2, 3: 3, 5: 4}
    assert {r.id: r.place for r in project.placed(rows, ["kind"], [F.desc("id")]).collect()} == {9: 1, 1: 2, 5: 1, 3: 2}
    assert {r.id: (r.identity, r.basis) for r in identity.first_unique(rows, "id", ["name"]).collect()} == {5: ("5", "id"), 3: ("3", "id"), 9: ("a", "name"), 1: ("1", "id")}
    assert project.numbered(rows.filter("false"), "kind", [F.col("id")]).count() == 0


def test_reachable_never_stops_short(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "src string, dst string")
    starts = spark.createDataFrame([("n0",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(edges, starts, most_steps=4).collect()} == {(f"n{i}", i) for i in range(5)}
    with pytest.raises(ValueError):
        graph.reachable(edges, starts, most_steps=3)


def test_numbers_and_digests_hold_no_whole_group(spark, monkeypatch):
    from tessera.functions import keys
    from tessera.operators import rollup

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, "cold").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("sha")).repartition(7)
    made = []
    monkeypatch.setattr(project, "kept", lambda df: made.append(graph.kept(df)) or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows have several ranges
    dealt = rollup.shards(rows, ["g"], [F.col("id")], 10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        wanted.setdefault(r.g, []).append(r.id)
    assert {(r.g, r.id, r.shard) for r in dealt.collect()} == {(g, i, k // 10) for g, ids in wanted.items() for k, i in enumerate(ids)}
    assert made[0].filter("g = 'hot'").select("__range").distinct().count() > 1
    args = (F.col("id").cast("string"), F.length("sha"), F.col("sha"))
    found = keys.file_set_digests(rows, "g", *args)
    assert "collect_list" not in rows.sparkSession._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    once = rows.groupBy("g").agg(F.count("*").alias("n_files"), F.sum(F.length("sha")).alias("n_bytes"), keys.file_set_digest(*args).alias("digest"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in once.collect()}


def test_similarity_finds_what_comparing_all_pairs_finds(spark):
    import random
    from difflib import SequenceMatcher

    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(20, 60))) for _ in range(12)]
    near = [b[: draw.randint(len(b) - 4, len(b))] + draw.choice(["", "x", "xy"]) for b in base for _ in range(3)]
    items = spark.createDataFrame(list(enumerate(near)), "item int, key string")
    records = spark.createDataFrame([(i, b) for i, b in enumerate(base + base[:2])], "record int, key string")
    found = {(r.item, r.record): r.score for r in link.similarity_candidates(items, records, "item", "record", "key").collect()}
    scored = {(i, k): SequenceMatcher(None, n, b).ratio() for i, n in enumerate(near) for k, b in enumerate(base + base[:2]) if b and n}
    assert found == {k: pytest.approx(v, abs=1e-6) for k, v in scored.items() if v >= link.SIMILAR - link.LEAD}
    best = {r.item: (r.record, r.match_score) for r in link.similarity_links(items, records, "item", "record", "key").collect()}
    for i in range(len(near)):
        order = sorted(((v, -k) for (j, k), v in scored.items() if j == i), reverse=True)
        if order[0][0] >= link.SIMILAR:
            sure = order[0][0] - order[1][0] >= link.LEAD
            assert best[i][0] == (-order[0][1] if sure else None)


@pytest.mark.parametrize("least", [0.92, 0.7, 0.6])
def test_similarity_misses_no_pair(spark, least):
    import random
    from difflib import SequenceMatcher

    draw = random.Random(int(least * 100))
    texts = ["", "a", "b", "aa", "ab", "abc", "abd", "ßü🙂", "ßü🙂x", "aaaaaaaaaaaa", "aaaaaaaaaaab", "a" * 300, "a" * 290 + "b" * 10, None]
    for _ in range(25):
        t = "".join(draw.choice("ab cé") for _ in range(draw.randint(3, 30)))
        texts.append(t)
        for _ in range(3):  # scattered changes, which leave the most blocks
            u = list(t)
            for _ in range(draw.randint(1, 3)):
                at = draw.randrange(len(u) + 1)
                u[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "yz"])
            texts.append("".join(u))
    frame = spark.createDataFrame(list(enumerate(texts)), "item int, key string")
    found = {(r.item, r.record): r.score for r in link.similarity_candidates(frame, frame.withColumnRenamed("item", "record"), "item", "record", "key", least).collect()}
    wanted = {(i, k): SequenceMatcher(None, x, y).ratio() for i, x in enumerate(texts) for k, y in enumerate(texts) if x and y}
    assert found == {k: pytest.approx(v, abs=1e-6) for k, v in wanted.items() if v >= least}


def test_link_similarity_query_equals_all_pairs(spark):
    import re
    from difflib import SequenceMatcher

    from tessera.plans import linking

    folder = "/root/testdata/sf0.001"
    texts = {r.item_id: r.key for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", text.similarity_key(F.col("text")).alias("key")).collect()}
    found = {r.item_id: r for r in linking.link_similarity(spark, folder).collect()}
    for i, whole in texts.items():
        words = re.split(" ", whole)
        key = " ".join(words[: max(len(words) - i % 6, 1)])
        scored = sorted(((-SequenceMatcher(None, key, t).ratio(), k) for k, t in texts.items() if t and key), key=lambda x: (round(x[0], 6), x[1]))
        scored = [(-s, k) for s, k in scored if -s >= link.SIMILAR - link.LEAD]
        if not scored:
            assert i not in found
            continue
        sure = scored[0][0] >= link.SIMILAR and (len(scored) == 1 or round(scored[0][0] - scored[1][0], 6) >= link.LEAD)
        assert (found[i].record_id, found[i].match_score) == (scored[0][1] if sure else None, pytest.approx(scored[0][0], abs=1e-6))


def test_or_join_counts_each_record_once(spark):
    left = [(i, "hot", None) for i in range(200)] + [(300, "a", "b"), (301, None, None), (302, "a", "c"), (303, "", "x"), (304, "z", None)]
    right = [(f"r{i:03}", "hot", None) for i in range(150)] + [("s1", "a", "b"), ("s2", None, "c"), ("s1", "a", "b"), ("s3", "", None)]
    found = changes.or_join(spark.createDataFrame(left, "key int, p string, q string"), spark.createDataFrame(right, "record string, p string, q string"), [("p", "p"), ("q", "q")], "key", "record")
    wanted = {}
    for k, p, q in left:
        hits = {r for r, x, y in right if (p is not None and p == x) or (q is not None and q == y)}
        wanted[k] = (len(hits), min(hits) if len(hits) == 1 else None, ["absent", "resolved", "ambiguous"][min(len(hits), 2)])
    assert {r.key: (r.n_matches, r.record, r.state) for r in found.collect()} == wanted
