"""Change, graph, rule and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes, graph, project, rules
from tessera.sources.tables import table


def _order_versions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    base = o.filter("o_orderkey % 13 <> 0")
    current = base.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")))
    status = F.when(F.col("o_orderkey") % 12 == 0, "X").when(F.col("o_orderkey") % 4 == 0, "Y").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderkey") % 10 == 0, "URGENT").otherwise(F.col("o_orderpriority"))
    customer = F.when(F.col("o_orderkey") % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey"))
    edited = o.filter("o_orderkey % 17 <> 0").select("o_orderkey", status.alias("o_orderstatus"), priority.alias("o_orderpriority"), customer.alias("o_custkey"))
    return base, current, edited


def three_way_changes(spark, d):
    base, current, edited = _order_versions(spark, d)
    return changes.three_way(base, current, edited, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"], ["o_custkey"])


THREE_WAY = """
WITH b0 AS (SELECT * FROM orders WHERE o_orderkey%13<>0), e0 AS (SELECT * FROM orders WHERE o_orderkey%17<>0),
b AS (SELECT o_orderkey, unnest(['o_orderstatus','o_orderpriority','o_custkey']) AS field, unnest([o_orderstatus,o_orderpriority,CAST(o_custkey AS VARCHAR)]) AS v FROM b0),
c AS (SELECT o_orderkey, unnest(['o_orderstatus','o_orderpriority','o_custkey']) AS field, unnest([CASE WHEN o_orderkey%6=0 THEN 'X' ELSE o_orderstatus END,o_orderpriority,CAST(o_custkey AS VARCHAR)]) AS v FROM b0),
e AS (SELECT o_orderkey, unnest(['o_orderstatus','o_orderpriority','o_custkey']) AS field, unnest([CASE WHEN o_orderkey%12=0 THEN 'X' WHEN o_orderkey%4=0 THEN 'Y' ELSE o_orderstatus END, CASE WHEN o_orderkey%10=0 THEN 'URGENT' ELSE o_orderpriority END, CAST(CASE WHEN o_orderkey%50=0 THEN -1 ELSE o_custkey END AS VARCHAR)]) AS v FROM e0),
j AS (SELECT coalesce(b.o_orderkey,e.o_orderkey) AS o_orderkey, coalesce(b.field,e.field) AS field, b.v AS base_value, c.v AS current_value, e.v AS edited_value, b.o_orderkey IS NOT NULL AS ib, e.o_orderkey IS NOT NULL AS ie
 FROM b FULL JOIN e ON b.o_orderkey=e.o_orderkey AND b.field=e.field LEFT JOIN c ON c.o_orderkey=coalesce(b.o_orderkey,e.o_orderkey) AND c.field=coalesce(b.field,e.field))
SELECT * FROM (SELECT o_orderkey, field, base_value, current_value, edited_value, CASE WHEN NOT ib THEN 'added' WHEN NOT ie THEN 'removed' WHEN base_value IS NOT DISTINCT FROM edited_value THEN NULL WHEN field='o_custkey' THEN 'refuse'
 WHEN current_value IS NOT DISTINCT FROM base_value THEN 'accept' WHEN current_value IS NOT DISTINCT FROM edited_value THEN 'same' ELSE 'conflict' END AS decision FROM j) WHERE decision IS NOT NULL
"""


def promotion_conflicts(spark, d):
    """Events as proposed settings: one value for a user and kind is promoted, several conflict."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("v"))
    return changes.promotable(e, ["user_id", "event_type"], "v")


PROMOTION = """
SELECT user_id, event_type, count(*) AS n_changes, count(DISTINCT v) AS n_values, CASE WHEN count(DISTINCT v)=1 THEN min(v) END AS value, CASE WHEN count(DISTINCT v)>1 THEN 'conflict' ELSE 'promoted' END AS state
FROM (SELECT user_id, event_type, json_extract_string(props,'$.k') AS v FROM events) GROUP BY 1,2
"""


def settings_precedence(spark, d):
    """The event kind as the layer of a setting: the highest one wins, the latest of equals."""
    e = table(spark, d, "events").withColumn("v", F.get_json_object("props", "$.k"))
    kinds = ["view", "click", "signup", "error", "purchase"]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    return changes.precedence(e, ["user_id"], rank, F.struct("ts", "event_id"), "v")


SETTINGS = """
WITH e AS (SELECT user_id, CAST(coalesce(list_position(['view','click','signup','error','purchase'], event_type),0) AS INT) AS rank, ts, event_id, json_extract_string(props,'$.k') AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, ts DESC, event_id DESC) AS n FROM e)
SELECT user_id, max(CASE WHEN n=1 THEN rank END) AS rank, max(CASE WHEN n=1 THEN v END) AS value, count(DISTINCT rank)-1 AS n_overridden FROM r GROUP BY 1
"""


def _edges(spark, d):
    def node(kind, column):
        return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    up = n.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    down = s.select(node("n", "s_nationkey").alias("src"), node("s", "s_suppkey").alias("dst"))
    # every ninth supplier points back to a region, so the graph has cycles
    back = s.filter("s_suppkey % 9 = 0").select(node("s", "s_suppkey").alias("src"), F.concat(F.lit("r:"), (F.col("s_suppkey") % 5).cast("string")).alias("dst"))
    return up.unionByName(down).unionByName(back)


def closure_reachable(spark, d):
    starts = table(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node"))
    found = graph.reachable(_edges(spark, d), starts)
    return found.groupBy("start", "depth").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


CLOSURE = """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier UNION ALL SELECT 's:' || s_suppkey, 'r:' || (s_suppkey%5) FROM supplier WHERE s_suppkey%9=0)),
w AS (SELECT 'r:' || r_regionkey AS start, 'r:' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT start, dst, depth+1 FROM w JOIN e ON node=src WHERE depth<30),
m AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1,2)
SELECT start, CAST(depth AS INT) AS depth, count(*) AS n_nodes, min(node) AS first_node FROM m GROUP BY 1,2
"""


def relational_division(spark, d):
    """Orders that have every return flag that occurs with their priority's order of the least key."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    least = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("l_orderkey"))
    required = least.join(li, "l_orderkey").select("o_orderpriority", "l_returnflag")
    return graph.divide(li, "l_returnflag", "l_orderkey", required, "o_orderpriority")


DIVISION = """
WITH q AS (SELECT DISTINCT o_orderpriority, l_returnflag FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1) JOIN lineitem ON l_orderkey=k), n AS (SELECT o_orderpriority, count(*) AS n FROM q GROUP BY 1),
p AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem), h AS (SELECT o_orderpriority, l_orderkey, count(*) AS had FROM q JOIN p USING (l_returnflag) GROUP BY 1,2)
SELECT o_orderpriority, l_orderkey FROM h JOIN n USING (o_orderpriority) WHERE had=n
"""


def draw_feasibility(spark, d):
    """Draws of k parts from a brand's pool: whether there are enough, and whether they are worth the same."""
    pool = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n_available"), F.countDistinct("p_size").alias("n_points"))
    wanted = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_orderkey").agg(F.count("*").alias("k")).groupBy("p_brand").agg(F.max("k").alias("k"))
    state = F.when(F.coalesce("k", F.lit(0)) > F.col("n_available"), "infeasible").when(F.col("n_points") > 1, "mixed_points").otherwise("ok")
    return pool.join(wanted, "p_brand", "left").select("p_brand", "n_available", "n_points", F.coalesce("k", F.lit(0)).alias("requested"), state.alias("state"))


DRAW = """
WITH p AS (SELECT p_brand, count(*) AS n_available, count(DISTINCT p_size) AS n_points FROM part GROUP BY 1), w AS (SELECT p_brand, max(k) AS k FROM (SELECT p_brand, l_orderkey, count(*) AS k FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2) GROUP BY 1)
SELECT p_brand, n_available, n_points, coalesce(k,0) AS requested, CASE WHEN coalesce(k,0)>n_available THEN 'infeasible' WHEN n_points>1 THEN 'mixed_points' ELSE 'ok' END AS state FROM p LEFT JOIN w USING (p_brand)
"""


def _issues(spark, d):
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    kept = p.filter("p_partkey % 10 <> 0")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = li.withColumn("line_key", key)
    return rules.union_all(
        [
            rules.dangling(lines, "line_key", "l_partkey", kept, "p_partkey", "part_missing"),
            rules.dangling(lines, "line_key", "l_suppkey", table(spark, d, "supplier"), "s_suppkey", "supplier_missing"),
            rules.repeated(li, ["l_orderkey", "l_linenumber"], "line_repeated", "warning"),
            rules.repeated(p, ["p_name"], "name_repeated", "info"),
            rules.violating(o, "o_orderkey", F.col("o_totalprice") >= 1000, "price_low", F.col("o_orderstatus")),
        ]
    )


_ISSUES = """
SELECT 'error' AS severity, 'part_missing' AS code, concat_ws(':',l_orderkey,l_linenumber,l_partkey,l_suppkey) AS entity_key, CAST(l_partkey AS VARCHAR) AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey%10<>0)
UNION ALL SELECT 'error','supplier_missing',concat_ws(':',l_orderkey,l_linenumber,l_partkey,l_suppkey),CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'warning','line_repeated',l_orderkey || ':' || l_linenumber, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey,l_linenumber HAVING count(*)>1
UNION ALL SELECT 'info','name_repeated',p_name,CAST(count(*) AS VARCHAR) FROM part GROUP BY p_name HAVING count(*)>1
UNION ALL SELECT 'warning','price_low',CAST(o_orderkey AS VARCHAR),o_orderstatus FROM orders WHERE NOT o_totalprice>=1000
"""


def referential_issues(spark, d):
    return _issues(spark, d)


def issue_report(spark, d):
    return rules.report(_issues(spark, d))


ISSUE_REPORT = f"SELECT severity, code, count(*) AS n_issues, min(entity_key) AS first_key, CAST(list_position(['error','warning','info'], severity) AS INT) AS rank, severity='error' AS blocks FROM ({_ISSUES}) GROUP BY severity, code"


def review_lanes(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tests = {"unlabelled": F.col("quality").isNull(), "toxic": F.coalesce(F.col("toxic"), F.lit(0)) == 1, "poor": F.col("quality") == 0, "very_long": F.col("n_chars") > 8000, "very_short": F.col("n_chars") < 50}
    return project.lanes(docs, "doc_id", tests)


REVIEW_LANES = """
WITH d AS (SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CAST(1 AS INT) AS lane_order, 'unlabelled' AS lane FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 2, 'toxic' FROM d WHERE toxic=1 UNION ALL SELECT doc_id, 3, 'poor' FROM d WHERE quality=0
UNION ALL SELECT doc_id, 4, 'very_long' FROM d WHERE n_chars>8000 UNION ALL SELECT doc_id, 5, 'very_short' FROM d WHERE n_chars<50
"""


def manifest_verify(spark, d):
    """A recorded manifest of documents against what is there: some lines have another digest, some files are gone."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("found"))
    wanted = docs.select("doc_id", F.when(F.col("doc_id") % 40 == 0, F.reverse("found")).otherwise(F.col("found")).alias("recorded"))
    there = docs.filter("doc_id % 60 <> 1")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("recorded"), "verified").otherwise("altered")
    return wanted.join(there, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_id"))


MANIFEST = """
WITH d AS (SELECT doc_id, sha256(text) AS f FROM documents), w AS (SELECT doc_id, CASE WHEN doc_id%40=0 THEN reverse(f) ELSE f END AS r FROM d), t AS (SELECT * FROM d WHERE doc_id%60<>1)
SELECT CASE WHEN f IS NULL THEN 'missing' WHEN f=r THEN 'verified' ELSE 'altered' END AS state, count(*) AS n_files, min(doc_id) AS first_id FROM w LEFT JOIN t USING (doc_id) GROUP BY 1
"""

QUERIES = {
    "three_way_changes": three_way_changes, "promotion_conflicts": promotion_conflicts, "settings_precedence": settings_precedence, "closure_reachable": closure_reachable,
    "relational_division": relational_division, "draw_feasibility": draw_feasibility, "referential_issues": referential_issues, "issue_report_ranked": issue_report,
    "review_lanes": review_lanes, "manifest_verify": manifest_verify,
}
ORACLE_SQL = {
    "three_way_changes": THREE_WAY, "promotion_conflicts": PROMOTION, "settings_precedence": SETTINGS, "closure_reachable": CLOSURE, "relational_division": DIVISION,
    "draw_feasibility": DRAW, "referential_issues": _ISSUES, "issue_report_ranked": ISSUE_REPORT, "review_lanes": REVIEW_LANES, "manifest_verify": MANIFEST,
}
