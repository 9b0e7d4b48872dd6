"""More linkage, projection, promotion and validation queries, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import changes, identity, rules
from tessera.sources.tables import table

C = F.col


def canonical_record_choice(spark, d):
    """For each order the line that stands for it: first by number and flag, then by flag, then any; ties by part."""
    li = table(spark, d, "lineitem")
    rank = F.when((C("l_linenumber") == 1) & (C("l_returnflag") == "R"), 1).when(C("l_returnflag") == "R", 2).when(C("l_linenumber") == 1, 3).otherwise(4)
    best = li.groupBy("l_orderkey").agg(F.min(F.struct(rank.alias("rank"), "l_partkey", "l_suppkey", "l_linenumber")).alias("b"), F.count("*").alias("n_records"))
    return best.select("l_orderkey", "n_records", C("b.rank").alias("step"), C("b.l_partkey").alias("part"), C("b.l_suppkey").alias("supplier"))


CANONICAL = """
WITH r AS (SELECT *, CASE WHEN l_linenumber=1 AND l_returnflag='R' THEN 1 WHEN l_returnflag='R' THEN 2 WHEN l_linenumber=1 THEN 3 ELSE 4 END AS k FROM lineitem)
SELECT l_orderkey, count(*) AS n_records, CAST(min(k) AS INT) AS step, arg_min(l_partkey, (k,l_partkey,l_suppkey,l_linenumber)) AS part, arg_min(l_suppkey, (k,l_partkey,l_suppkey,l_linenumber)) AS supplier FROM r GROUP BY 1
"""


def pool_ladder(spark, d):
    """Customers to suppliers by balance, else nation and rank, else nation: all suppliers at the first rung that has any."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    rungs = [(1, F.round("c_acctbal").cast("string"), F.round("s_acctbal").cast("string")), (2, F.concat_ws(":", "c_nationkey", C("c_custkey") % 3), F.concat_ws(":", "s_nationkey", C("s_suppkey") % 3)), (3, C("c_nationkey").cast("string"), C("s_nationkey").cast("string"))]
    # suppliers of a key are counted before they are joined: a row for each customer and rung, never one for each pair
    pools = [(n, a, s.groupBy(b.alias("k")).agg(F.count("*").alias("n_pools"), F.min("s_suppkey").alias("first_pool"))) for n, a, b in rungs]
    found = rules.union_all([c.select("c_custkey", a.alias("k")).join(p, "k").select("c_custkey", F.lit(n).alias("rung"), "n_pools", "first_pool") for n, a, p in pools])
    best = found.groupBy("c_custkey").agg(F.min(F.struct("rung", "n_pools", "first_pool")).alias("b"))
    return best.select("c_custkey", "b.rung", "b.n_pools", "b.first_pool")


POOL_LADDER = """
WITH f AS (SELECT c_custkey, 1 AS rung, s_suppkey FROM customer JOIN supplier ON round(c_acctbal)=round(s_acctbal) UNION ALL SELECT c_custkey, 2, s_suppkey FROM customer JOIN supplier ON c_nationkey=s_nationkey AND c_custkey%3=s_suppkey%3
 UNION ALL SELECT c_custkey, 3, s_suppkey FROM customer JOIN supplier ON c_nationkey=s_nationkey), m AS (SELECT c_custkey, min(rung) AS rung FROM f GROUP BY 1)
SELECT c_custkey, CAST(rung AS INT) AS rung, count(*) AS n_pools, min(s_suppkey) AS first_pool FROM f JOIN m USING (c_custkey, rung) GROUP BY 1,2
"""


def best_overlap(spark, d):
    """A search: for each order whose key 20 divides, the orders that share most parts with it; several best are ambiguous."""
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    asking = pairs.filter("l_orderkey % 20 = 0").withColumnRenamed("l_orderkey", "asking")
    shared = asking.join(pairs, "l_partkey").filter("asking <> l_orderkey").groupBy("asking", "l_orderkey").agg(F.count("*").alias("overlap"))
    # orders of one overlap are counted, then the greatest overlap is taken: pairs are made once and joined with nothing
    alike = shared.groupBy("asking", "overlap").agg(F.count("*").alias("n_best"), F.min("l_orderkey").alias("first_best"))
    best = alike.groupBy("asking").agg(F.max(F.struct("overlap", "n_best", "first_best")).alias("b"))
    return best.select("asking", "b.overlap", "b.n_best", "b.first_best").withColumn("is_ambiguous", C("n_best") > 1)


BEST_OVERLAP = """
WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT a.l_orderkey AS asking, b.l_orderkey, count(*) AS overlap FROM p a JOIN p b USING (l_partkey) WHERE a.l_orderkey%20=0 AND a.l_orderkey<>b.l_orderkey GROUP BY 1,2),
t AS (SELECT asking, max(overlap) AS overlap FROM s GROUP BY 1) SELECT asking, overlap, count(*) AS n_best, min(l_orderkey) AS first_best, count(*)>1 AS is_ambiguous FROM s JOIN t USING (asking, overlap) GROUP BY 1,2
"""


def edge_quality(spark, d):
    """Orders as edges from a customer name to a clerk's nation: each end resolves by an alias that only one entity has."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")

    def unique(df, alias, key):
        return df.groupBy(alias.alias("alias")).agg(F.count("*").alias("n"), F.min(key).alias(key)).filter("n = 1").drop("n")

    left = unique(c, F.concat(F.lit("c"), F.floor("c_custkey") % 1200), "c_custkey").withColumnRenamed("alias", "from_alias")
    right = unique(s, F.concat(F.lit("s"), C("s_suppkey") % 70), "s_suppkey").withColumnRenamed("alias", "to_alias")
    edges = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), C("o_custkey") % 1200).alias("from_alias"), F.concat(F.lit("s"), C("o_orderkey") % 70).alias("to_alias"))
    out = edges.join(left, "from_alias", "left").join(right, "to_alias", "left")
    ends = C("c_custkey").isNotNull().cast("int") + C("s_suppkey").isNotNull().cast("int")
    return out.select("o_orderkey", "c_custkey", "s_suppkey", F.element_at(F.array(F.lit("evidence_only"), F.lit("partial"), F.lit("resolved")), ends + 1).alias("quality"))


EDGE_QUALITY = """
WITH l AS (SELECT c_custkey%1200 AS a, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*)=1), r AS (SELECT s_suppkey%70 AS a, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*)=1)
SELECT o_orderkey, c_custkey, s_suppkey, CASE WHEN c_custkey IS NULL AND s_suppkey IS NULL THEN 'evidence_only' WHEN c_custkey IS NULL OR s_suppkey IS NULL THEN 'partial' ELSE 'resolved' END AS quality
FROM orders LEFT JOIN l ON o_custkey%1200=l.a LEFT JOIN r ON o_orderkey%70=r.a
"""


def asset_bindings(spark, d):
    """Each local reference of a page must bind exactly one page; pages nothing refers to are reported too."""
    pages = table(spark, d, "pages").select("page_id", "html", text.package_path(C("url")).alias("path"))
    refs = pages.select("page_id", F.explode(text.local_refs(C("html"))).alias("ref")).select("page_id", text.package_path(C("ref")).alias("path")).distinct()
    have = pages.groupBy("path").agg(F.count("*").alias("n_assets"))
    bound = refs.join(have, "path", "left").select("page_id", "path", F.coalesce("n_assets", F.lit(0)).alias("n_assets"))
    faulty = bound.filter("n_assets <> 1").select("page_id", "path", F.when(C("n_assets") == 0, "unbound").otherwise("ambiguous").alias("issue"))
    unused = pages.join(refs.select("path").distinct(), "path", "left_anti").select("page_id", "path", F.lit("unreferenced").alias("issue"))
    return faulty.unionByName(unused)


ASSET_BINDINGS = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url),'\','/'),'^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*',''),'[#?].*$',''),'/+','/','g'),'^(\./)?/?','') AS path FROM pages),
u AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*"([^"]*)"', 1)), '[?#].*$', '') AS u FROM p),
r AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(replace(trim(u),'\','/'),'/+','/','g'),'^(\./)?/?','') AS path FROM u WHERE u<>'' AND NOT regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)')),
h AS (SELECT path, count(*) AS n FROM p GROUP BY 1)
SELECT page_id, path, CASE WHEN n IS NULL THEN 'unbound' ELSE 'ambiguous' END AS issue FROM r LEFT JOIN h USING (path) WHERE coalesce(n,0)<>1
UNION ALL SELECT page_id, path, 'unreferenced' FROM p WHERE path NOT IN (SELECT path FROM r)
"""


def placement_scoring(spark, d):
    """Points of a part over its placements: several values leave it unresolved."""
    li = table(spark, d, "lineitem")
    points = F.array_sort(F.collect_set(C("l_tax")))
    out = li.groupBy("l_partkey").agg(F.count("*").alias("n_placements"), points.alias("p"))
    return out.select("l_partkey", "n_placements", F.size("p").cast("long").alias("n_points"), F.when(F.size("p") > 1, "unresolved").otherwise("observed").alias("state"), F.when(F.size("p") == 1, F.element_at("p", 1)).alias("points"))


PLACEMENT = "SELECT l_partkey, count(*) AS n_placements, count(DISTINCT l_tax) AS n_points, CASE WHEN count(DISTINCT l_tax)>1 THEN 'unresolved' ELSE 'observed' END AS state, CASE WHEN count(DISTINCT l_tax)=1 THEN min(l_tax) END AS points FROM lineitem GROUP BY 1"


def class_injectivity(spark, d):
    """Classes of equal openings whose members carry different whole contents."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.substring("text", 1, 30), 256).alias("class"), F.sha2("text", 256).alias("digest"))
    return docs.groupBy("class").agg(F.count("*").alias("n_members"), F.countDistinct("digest").alias("n_digests"), F.min("doc_id").alias("representative")).filter("n_digests > 1")


INJECTIVITY = "SELECT sha256(substr(text,1,30)) AS class, count(*) AS n_members, count(DISTINCT sha256(text)) AS n_digests, min(doc_id) AS representative FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text))>1"


def code_coverage(spark, d):
    """Codes that are expected and missing, or there and not expected."""
    used, known = table(spark, d, "lineitem").select(C("l_partkey").alias("code")).distinct(), table(spark, d, "part").filter("p_partkey % 50 <> 3").select(C("p_partkey").alias("code"))
    return known.subtract(used).withColumn("state", F.lit("missing")).unionByName(used.subtract(known).withColumn("state", F.lit("unexpected")))


CODE_COVERAGE = "WITH k AS (SELECT p_partkey AS code FROM part WHERE p_partkey%50<>3), u AS (SELECT DISTINCT l_partkey AS code FROM lineitem) SELECT code, 'missing' AS state FROM (SELECT * FROM k EXCEPT SELECT * FROM u) UNION ALL SELECT code, 'unexpected' FROM (SELECT * FROM u EXCEPT SELECT * FROM k)"


def settings_drift(spark, d):
    """Settings of the first snapshot against the second; what only the second has is not looked at."""
    e = table(spark, d, "events").withColumn("v", F.get_json_object("props", "$.k"))
    a = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("v", "event_id").alias("a_value"))
    b = e.filter("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.max_by("v", "event_id").alias("b_value"))
    return a.join(b, ["user_id", "event_type"], "left").filter(~C("a_value").eqNullSafe(C("b_value")))


SETTINGS_DRIFT = """
WITH e AS (SELECT *, json_extract_string(props,'$.k') AS v FROM events), a AS (SELECT user_id, event_type, arg_max(v,event_id) AS a_value FROM e WHERE event_id%2=0 GROUP BY 1,2), b AS (SELECT user_id, event_type, arg_max(v,event_id) AS b_value FROM e WHERE event_id%2=1 GROUP BY 1,2)
SELECT user_id, event_type, a_value, b_value FROM a LEFT JOIN b USING (user_id, event_type) WHERE a_value IS DISTINCT FROM b_value
"""


def effective_settings(spark, d):
    """Defaults for every user and kind, overlaid by the last value observed."""
    defaults = spark.createDataFrame([(k, str(v)) for k, v in {"view": 1, "click": 2, "signup": 3, "error": 4, "purchase": 5, "refund": 6}.items()], "setting string, value string")
    e = table(spark, d, "events")
    seen = e.groupBy("user_id", C("event_type").alias("setting")).agg(F.max_by(F.get_json_object("props", "$.k"), "event_id").alias("observed"))
    users = e.select("user_id").distinct().withColumn("setting", F.explode(F.array(*[F.lit(k) for k in ("view", "click", "signup", "error", "purchase", "refund")])))
    out = users.join(F.broadcast(defaults), "setting").join(seen, ["user_id", "setting"], "left")
    return out.select("user_id", "setting", F.coalesce("observed", "value").alias("value"), F.when(C("observed").isNull(), "default").otherwise("observed").alias("origin"))


EFFECTIVE = """
WITH s AS (SELECT unnest(['view','click','signup','error','purchase','refund']) AS setting, unnest(['1','2','3','4','5','6']) AS value), u AS (SELECT DISTINCT user_id FROM events),
o AS (SELECT user_id, event_type AS setting, arg_max(json_extract_string(props,'$.k'), event_id) AS observed FROM events GROUP BY 1,2)
SELECT user_id, setting, coalesce(observed,value) AS value, CASE WHEN observed IS NULL THEN 'default' ELSE 'observed' END AS origin FROM u CROSS JOIN s LEFT JOIN o USING (user_id, setting)
"""


def apply_answer_keys(spark, d):
    """Options of an order are its line numbers; the approved key is the flags R: correct marks are set from it."""
    li = table(spark, d, "lineitem")
    options = F.array_sort(F.array_distinct(F.collect_list(C("l_linenumber"))))
    keyed = F.collect_set(F.when(C("l_returnflag") == "R", C("l_linenumber")))
    out = li.groupBy("l_orderkey").agg(options.alias("o"), keyed.alias("k"))
    marks = F.transform("o", lambda x: F.concat_ws(":", x.cast("string"), F.when(F.array_contains("k", x), "correct").otherwise("wrong")))
    return out.select("l_orderkey", F.array_join(marks, " ").alias("options"), F.size("k").cast("long").alias("n_correct"))


ANSWER_KEYS = """
WITH o AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag='R') AS c FROM lineitem GROUP BY 1,2)
SELECT l_orderkey, string_agg(l_linenumber || ':' || CASE WHEN c THEN 'correct' ELSE 'wrong' END, ' ' ORDER BY l_linenumber) AS options, count(*) FILTER (c) AS n_correct FROM o GROUP BY 1
"""


def action_queue(spark, d):
    """One queue of what needs doing from three sources, each target and reason once."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    dup = identity.star_edges(docs, "doc_id", F.sha2("text", 256)).select(C("doc_id").alias("target"), F.lit("duplicate").alias("reason"), F.lit(2).alias("priority"))
    bad = labels.filter("toxic = 1").select(C("doc_id").alias("target"), F.lit("toxic").alias("reason"), F.lit(1).alias("priority"))
    odd = docs.filter("n_chars < 40").select(C("doc_id").alias("target"), F.lit("too_short").alias("reason"), F.lit(3).alias("priority"))
    return rules.union_all([dup, bad, odd]).dropDuplicates(["target", "reason"])


ACTION_QUEUE = """
WITH g AS (SELECT sha256(text) AS k, min(doc_id) AS m FROM documents GROUP BY 1 HAVING count(*)>1)
SELECT doc_id AS target, 'duplicate' AS reason, CAST(2 AS INT) AS priority FROM documents JOIN g ON sha256(text)=k WHERE doc_id<>m UNION SELECT doc_id, 'toxic', 1 FROM labels WHERE toxic=1 UNION SELECT doc_id, 'too_short', 3 FROM documents WHERE n_chars<40
"""


def term_scan(spark, d):
    """Terms of a list, as whole words in any case, by document; where they stand is shown as a digest."""
    terms = ["loser", "license", "password", "mail7"]
    docs = table(spark, d, "documents")
    found = F.array(*[F.struct(F.lit(t).alias("term"), C("text").rlike(rf"(?i)\b{t}\b").alias("hit")) for t in terms])
    return docs.select("doc_id", F.explode(found).alias("f")).filter("f.hit").select("doc_id", "f.term", F.concat(F.lit("redacted:"), F.substring(F.sha2(C("doc_id").cast("string"), 256), 1, 16)).alias("location"))


TERM_SCAN = r"""
SELECT doc_id, term, 'redacted:' || substr(sha256(CAST(doc_id AS VARCHAR)),1,16) AS location FROM documents, (SELECT unnest(['loser','license','password','mail7']) AS term) WHERE regexp_matches(text, '(?i)\b' || term || '\b')
"""


def top_candidates(spark, d):
    """The five dearest parts of each brand, ties by key, as JSON."""
    p = table(spark, d, "part")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("rank <= 5")
    return ranked.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_partkey"))), lambda x: x.p_partkey.cast("string")), ",").alias("candidates"))


TOP_CANDIDATES = "SELECT p_brand, string_agg(p_partkey, ',' ORDER BY n) AS candidates FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n<=5 GROUP BY 1"


def channel_rows(spark, d):
    """Columns of an order as channel rows, empty ones left out."""
    o = table(spark, d, "orders").select("o_orderkey", C("o_orderpriority").alias("general"), F.when(C("o_orderstatus") == "F", C("o_orderstatus")).alias("correct"), F.when(C("o_totalprice") > 150000, F.lit("large")).alias("incorrect"))
    return o.unpivot("o_orderkey", ["general", "correct", "incorrect"], "channel", "content").filter("content IS NOT NULL")


CHANNEL_ROWS = "SELECT o_orderkey, 'general' AS channel, o_orderpriority AS content FROM orders UNION ALL SELECT o_orderkey, 'correct', o_orderstatus FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, 'incorrect', 'large' FROM orders WHERE o_totalprice>150000"


def identifier_claims(spark, d):
    """Generated identifiers that more than one source claims."""
    p = table(spark, d, "part").select(F.concat(F.lit("q-"), text.slug(C("p_name"))).alias("identifier"), "p_brand", "p_partkey")
    out = p.groupBy("identifier").agg(F.countDistinct("p_brand").alias("n_owners"), F.count("*").alias("n_claims"), F.min("p_partkey").alias("first_key"))
    return out.filter("n_owners > 1")


IDENTIFIER_CLAIMS = "SELECT 'q-' || regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS identifier, count(DISTINCT p_brand) AS n_owners, count(*) AS n_claims, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(DISTINCT p_brand)>1"


def package_equality(spark, d):
    """Two copies of a package file by file: equal, different, or on one side only."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    a = docs.filter("doc_id % 9 <> 0").withColumnRenamed("sha", "a_sha")
    b = docs.filter("doc_id % 8 <> 0").select("doc_id", F.when(C("doc_id") % 31 == 0, F.lit("x")).otherwise(C("sha")).alias("b_sha"))
    state = F.when(C("a_sha").isNull(), "only_b").when(C("b_sha").isNull(), "only_a").when(C("a_sha") == C("b_sha"), "equal").otherwise("different")
    return a.join(b, "doc_id", "full_outer").select("doc_id", state.alias("state"))


PACKAGE_EQUALITY = """
WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id%9<>0), b AS (SELECT doc_id, CASE WHEN doc_id%31=0 THEN 'x' ELSE sha256(text) END AS s FROM documents WHERE doc_id%8<>0)
SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, CASE WHEN a.s IS NULL THEN 'only_b' WHEN b.s IS NULL THEN 'only_a' WHEN a.s=b.s THEN 'equal' ELSE 'different' END AS state FROM a FULL JOIN b ON a.doc_id=b.doc_id
"""


def authorization_window(spark, d):
    """A customer's other orders against an order's window of 30 days: how many uses fall inside."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_micros(C("o_orderdate").cast("timestamp")).alias("at"))
    of_customer = Window.partitionBy("o_custkey")
    inside = of_customer.orderBy("at").rangeBetween(Window.currentRow, 30 * 86_400_000_000 - 1)
    counted = o.select("o_orderkey", (F.count("*").over(inside) - 1).alias("n_inside"), (F.count("*").over(of_customer) - 1).alias("n_uses"))
    return counted.filter("n_uses > 0")


AUTHORIZATION = """
SELECT a.o_orderkey, count(*) FILTER (b.o_orderdate>=a.o_orderdate AND b.o_orderdate<a.o_orderdate+INTERVAL 30 DAY) AS n_inside, count(*) AS n_uses FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey AND a.o_orderkey<>b.o_orderkey GROUP BY 1
"""


def reviewed_settings(spark, d):
    """Proposals for a setting of a user, promoted where they agree; the winner by layer otherwise."""
    e = table(spark, d, "events").withColumn("v", (F.get_json_object("props", "$.k").cast("long") % 2).cast("string"))
    agreed = changes.promotable(e, ["user_id"], "v").select("user_id", "n_changes", "state", C("value").alias("agreed"))
    last = changes.precedence(e, ["user_id"], F.when(C("event_type") == "purchase", 1).otherwise(0), C("event_id"), "v").select("user_id", C("value").alias("winner"), "n_overridden")
    return agreed.join(last, "user_id").select("user_id", "n_changes", "state", F.coalesce("agreed", "winner").alias("value"), "n_overridden")


REVIEWED_SETTINGS = """
WITH e AS (SELECT user_id, event_id, CAST(CAST(json_extract_string(props,'$.k') AS BIGINT)%2 AS VARCHAR) AS v, CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS r FROM events)
SELECT user_id, count(*) AS n_changes, CASE WHEN count(DISTINCT v)>1 THEN 'conflict' ELSE 'promoted' END AS state, CASE WHEN count(DISTINCT v)=1 THEN min(v) ELSE arg_max(v, (r,event_id)) END AS value, count(DISTINCT r)-1 AS n_overridden FROM e GROUP BY 1
"""

_ALL = {
    "canonical_record_choice": (canonical_record_choice, CANONICAL), "pool_ladder_all_at_first_rung": (pool_ladder, POOL_LADDER), "best_evidence_overlap": (best_overlap, BEST_OVERLAP),
    "edge_quality_by_alias": (edge_quality, EDGE_QUALITY), "asset_binding_issues": (asset_bindings, ASSET_BINDINGS), "placement_scoring": (placement_scoring, PLACEMENT),
    "class_injectivity": (class_injectivity, INJECTIVITY), "code_coverage": (code_coverage, CODE_COVERAGE), "settings_drift": (settings_drift, SETTINGS_DRIFT),
    "effective_settings": (effective_settings, EFFECTIVE), "apply_answer_keys": (apply_answer_keys, ANSWER_KEYS), "action_queue": (action_queue, ACTION_QUEUE), "term_scan": (term_scan, TERM_SCAN),
    "top5_candidates": (top_candidates, TOP_CANDIDATES), "channel_rows": (channel_rows, CHANNEL_ROWS), "identifier_claims": (identifier_claims, IDENTIFIER_CLAIMS),
    "package_equality": (package_equality, PACKAGE_EQUALITY), "authorization_window": (authorization_window, AUTHORIZATION), "reviewed_settings": (reviewed_settings, REVIEWED_SETTINGS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
