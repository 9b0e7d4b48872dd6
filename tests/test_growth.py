"""Queries on tables where copies, hot keys or long texts would make the work grow faster than the input."""

from __future__ import annotations

import threading
import tracemalloc

import pyarrow as pa
import pytest

from tessera.functions import markup
from tessera.operators import changes, graph
from tessera.plans import catalogue


@pytest.fixture
def stored(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def found(spark, name, folder):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect())


def test_copies_of_a_name_are_linked_with_its_first_part_alone(spark, stored):
    names = ["red bolt", "red bolt", "Red  Bolt", "red bold", "red bold", "blue anvil"]
    parts = [(10 + i, n, "b", "t") for i, n in enumerate(names)] + [(5, "red bolt", "other", "t"), (6, "red bolt", None, "t"), (7, None, "b", "t")]
    folder = stored(part=(parts, "p_partkey long, p_name string, p_brand string, p_type string"))
    assert found(spark, "link_similarity_lev", folder) == [(10, 11, 0), (10, 12, 0), (10, 13, 1), (13, 14, 0)]


def test_single_facts_reads_all_orders(spark, stored):
    orders = [(9, 1, "O", "low"), (10, 2, "O", "low"), (11, 3, "P", "high"), (12, 3, "F", "low"), (13, 4, "F", None)]
    folder = stored(orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"))
    assert found(spark, "single_facts", folder) == [(1, 1, "low"), (2, 1, "low"), (3, 2, None), (4, 0, None)]


def test_groups_of_a_frequent_member_are_spread_over_tasks(spark):
    pairs = spark.range(1000).selectExpr("id AS grp", "explode(array('n', if(id % 2 = 0, 'r', NULL))) AS m")
    required = spark.createDataFrame([("o", "n"), ("p", "n"), ("p", "r"), ("q", None)], "owner string, m string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        parts = graph.divide(pairs, "m", "grp", required, "owner").rdd.glom().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r) for p in parts for r in p} == {("o", i) for i in range(1000)} | {("p", i) for i in range(0, 1000, 2)}
    assert max(map(len, parts)) < 1000


def test_or_join_makes_no_row_for_each_pair(spark):
    left = spark.range(20_000).selectExpr("id AS key", "'hot' AS p", "cast(id AS string) AS q")
    right = spark.range(20_000).selectExpr("id AS record", "'hot' AS p", "cast(id * 3 AS string) AS q")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # 400 million pairs take longer
    late.start()
    try:
        states = changes.or_join(left, right, [("p", "p"), ("q", "q")], "key", "record").groupBy("n_matches", "record", "state").count().collect()
    finally:
        late.cancel()
    assert [tuple(r) for r in states] == [(20_000, None, "ambiguous", 20_000)]


def test_violations_need_no_paths(spark):
    n = 40_000
    starts, mids = (spark.range(n).selectExpr(f"concat('{k}', id) AS node", f"'{k}' AS kind") for k in "sm")
    nodes = starts.union(mids).union(spark.createDataFrame([("h", "h"), ("e", "e")], "node string, kind string"))
    edges = starts.selectExpr("'a' AS kind", "node AS src", "'h' AS dst").union(mids.selectExpr("'b'", "'h'", "node")).union(mids.selectExpr("'c'", "node", "'e'"))
    hops = [graph.Hop("a", ("h",)), graph.Hop("b", ("m",)), graph.Hop("c", ("e",), 1, 1, once=True)]
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # 1.6 billion paths take longer
    late.start()
    try:
        against = graph.typed_paths(nodes, edges, starts.select("node"), hops)[1].collect()
    finally:
        late.cancel()
    assert [tuple(r) for r in against] == [(3, "e", "shared", n)]


def test_texts_of_a_batch_are_strings_a_few_at_a_time(spark):
    texts = pa.array([str(i) * 4000 for i in range(1000, 3000)] + [None, ""])
    tracemalloc.start()
    try:
        cut = markup._over_strings(lambda t: t[:4]).func(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cut.to_pylist() == [str(i) for i in range(1000, 3000)] + [None, ""]
    assert most < 8_000_000  # all texts are 32 MB
    pages = spark.createDataFrame([("<p>a</p>b",), (None,)], "t string")
    assert [r.x for r in pages.select(markup.html_text("t").alias("x")).collect()] == ["a b", None]


def test_best_overlap_makes_its_pairs_once(spark, stored):
    lines = [(20, 1), (20, 2), (20, 2), (3, 1), (3, 2), (4, 1), (4, 2), (5, 2), (40, 2), (40, None), (7, None)]
    folder = stored(lineitem=(lines, "l_orderkey long, l_partkey long"))
    assert found(spark, "best_evidence_overlap", folder) == [(20, 2, 2, 3, True), (40, 1, 4, 3, True)]
    plan = catalogue.QUERIES["best_evidence_overlap"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
