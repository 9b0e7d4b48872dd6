"""Queries over relations, facts and their evidence, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence, scan
from tessera.sources.tables import table

C = F.col


def edge_keys(spark, d):
    """The lasting keys of an order's lines as relations, and how many rows each stands for."""
    key = evidence.edge_key("holds", "line", C("l_orderkey"), C("l_partkey"), C("l_linenumber"), C("l_returnflag"))
    return table(spark, d, "lineitem").groupBy(key.alias("edge_key")).agg(F.count("*").alias("n_edges"))


EDGE_KEYS = "SELECT sha256('holds|line|' || l_orderkey || '|' || l_partkey || '|' || l_linenumber || '|' || coalesce(l_returnflag,'')) AS edge_key, count(*) AS n_edges FROM lineitem GROUP BY 1"


def pool_descriptors(spark, d):
    """What is known of the pool (supplier) of each relation: from the structure where it has the pool, else from the row."""
    members = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_members"), F.countDistinct("l_partkey").alias("n_parts"))
    known = table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(C("s_suppkey").alias("l_suppkey"), "s_name")
    label = F.coalesce("s_name", F.concat(F.lit("pool "), C("l_suppkey").cast("string")))
    return members.join(known, "l_suppkey", "left").select("l_suppkey", "n_members", "n_parts", label.alias("label"), F.when(C("s_name").isNull(), "row").otherwise("structure").alias("basis"))


POOL_DESCRIPTORS = """
WITH m AS (SELECT l_suppkey, count(*) AS n_members, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1)
SELECT l_suppkey, n_members, n_parts, coalesce(s_name, 'pool ' || l_suppkey) AS label, CASE WHEN s_name IS NULL THEN 'row' ELSE 'structure' END AS basis FROM m LEFT JOIN supplier ON s_suppkey=l_suppkey AND s_suppkey%4<>0
"""


def occurrence_diagnostics(spark, d):
    """Diagnostics of an order's suppliers, and those that concern it: about no evidence, or about a flag its lines have."""
    li = table(spark, d, "lineitem")
    flags = li.filter("l_orderkey % 11 <> 0").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    about = F.when(C("s_suppkey") % 3 == 0, F.array().cast("array<string>")).when(C("s_suppkey") % 3 == 1, F.array(F.lit("N"))).otherwise(F.array(F.lit("R"), F.lit("A")))
    diagnostics = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(C("s_suppkey").alias("l_suppkey"), about.alias("about"))
    told = li.select("l_orderkey", "l_suppkey").distinct().join(diagnostics, "l_suppkey").join(flags, "l_orderkey", "left")
    return told.groupBy("l_orderkey").agg(F.count("*").alias("n_diagnostics"), F.count_if(evidence.applies(C("flags"), C("about"))).alias("n_kept"))


OCCURRENCE_DIAGNOSTICS = """
WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem WHERE l_orderkey%11<>0 GROUP BY 1), t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey%2=0)
SELECT t.l_orderkey, count(*) AS n_diagnostics, count(*) FILTER (l_suppkey%3=0 OR flags IS NULL OR list_has_any(flags, CASE l_suppkey%3 WHEN 1 THEN ['N'] ELSE ['R','A'] END)) AS n_kept FROM t JOIN supplier ON s_suppkey=l_suppkey LEFT JOIN f ON f.l_orderkey=t.l_orderkey GROUP BY 1
"""


def status_keys(spark, d):
    """Parts with a relation of given statuses and parts that open diagnostics of given codes name."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey")
    related = li.filter("l_returnflag IN ('R', 'A') AND l_quantity >= 48").select(C("l_partkey").alias("p_partkey"))
    diagnosed = li.filter("l_linestatus = 'O' AND l_discount >= 0.09").select(F.array("l_partkey", "l_suppkey").alias("keys")).select(F.explode("keys").alias("p_partkey"))
    parts = [p.join(named, "p_partkey", "left_semi").withColumn("reason", F.lit(reason)) for reason, named in (("status", related), ("diagnostic", diagnosed))]
    return parts[0].unionByName(parts[1])


STATUS_KEYS = """
SELECT p_partkey, 'status' AS reason FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('R','A') AND l_quantity>=48)
UNION ALL SELECT p_partkey, 'diagnostic' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus='O' AND l_discount>=0.09 UNION SELECT l_suppkey FROM lineitem WHERE l_linestatus='O' AND l_discount>=0.09)
"""


def unresolved_occurrences(spark, d):
    """Orders that nothing resolves, with the first of their lines, if any."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f"))
    open_orders = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return open_orders.join(first, C("o_orderkey") == C("l_orderkey"), "left").select("o_orderkey", C("f.l_linenumber").alias("l_linenumber"), C("f.l_partkey").alias("l_partkey"), C("l_orderkey").isNotNull().alias("is_placed"))


UNRESOLVED_OCCURRENCES = """
WITH f AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey)) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey, f[1] AS l_linenumber, f[2] AS l_partkey, l_orderkey IS NOT NULL AS is_placed FROM orders LEFT JOIN f ON l_orderkey=o_orderkey WHERE o_orderstatus<>'P'
"""


def single_facts(spark, d):
    """The priority of customers with one order: a fact told twice is none."""
    return evidence.single_value(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


SINGLE_FACTS = "SELECT o_custkey, count(o_orderpriority) AS n_values, CASE WHEN count(o_orderpriority)=1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY 1"


def evidence_pairs(spark, d):
    """Even and odd orders whose set of suppliers (modulo 40) is that of one order on each side."""
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(C("l_suppkey") % 40)).cast("array<string>"), ",").alias("evidence"))
    flat, fact = held.filter("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "flat_key"), held.filter("l_orderkey % 2 = 1").withColumnRenamed("l_orderkey", "fact_key")
    return evidence.paired_once(flat, "flat_key", fact, "fact_key", "evidence")


EVIDENCE_PAIRS = """
WITH e AS (SELECT l_orderkey AS k, array_to_string(list_sort(list(DISTINCT l_suppkey%40)), ',') AS evidence FROM lineitem GROUP BY 1), o AS (SELECT k%2 AS side, evidence, min(k) AS k FROM e GROUP BY 1,2 HAVING count(*)=1)
SELECT evidence, a.k AS flat_key, b.k AS fact_key FROM o a JOIN o b USING (evidence) WHERE a.side=0 AND b.side=1
"""


def tolerant_candidates(spark, d):
    """Candidate lists as JSON: those that do not parse, and absent ones, are empty."""
    body = F.when(C("event_id") % 3 == 0, F.concat(F.lit('[{"key":"a'), C("event_id").cast("string"), F.lit('","score":0.9},{"key":"b"}]'))).when(C("event_id") % 3 == 1, "broken [")
    found = F.coalesce(F.from_json(body, "array<struct<key:string,score:double>>", {"mode": "PERMISSIVE"}), F.array().cast("array<struct<key:string,score:double>>"))
    listed = F.array_join(F.transform(found, lambda x: F.concat(x.key, F.coalesce(F.concat(F.lit(" ("), x.score.cast("string"), F.lit(")")), F.lit("")))), " | ")
    return table(spark, d, "events").select("event_id", F.size(found).alias("n_candidates"), listed.alias("listed"))


TOLERANT_CANDIDATES = """
WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[{"key":"a' || event_id || '","score":0.9},{"key":"b"}]' WHEN 1 THEN 'broken [' END AS body FROM events),
l AS (SELECT event_id, coalesce(from_json(TRY_CAST(body AS JSON), '[{"key":"VARCHAR","score":"DOUBLE"}]'), []) AS found FROM b)
SELECT event_id, len(found) AS n_candidates, array_to_string(list_transform(found, lambda x: concat(x.key, ' (' || x.score || ')')), ' | ') AS listed FROM l
"""


def variant_channels(spark, d):
    """Texts of two populations by their digest, each population in a channel of its own: where one digest stands for several rows."""
    docs = table(spark, d, "documents")
    channel = F.when(C("doc_id") % 3 == 0, "library").otherwise("inline")
    found = docs.groupBy(channel.alias("channel"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"))
    return found.withColumn("is_variant", C("n_rows") > 1)


VARIANT_CHANNELS = "SELECT CASE WHEN doc_id%3=0 THEN 'library' ELSE 'inline' END AS channel, sha256(coalesce(text,'')) AS digest, count(*) AS n_rows, min(doc_id) AS first_id, count(*)>1 AS is_variant FROM documents GROUP BY 1,2"


def asset_sources(spark, d):
    """Where each part's file is read from: its source, a copy or the package, whichever is there first inside the allowed roots."""
    p = table(spark, d, "part").select("p_partkey", F.when(C("p_partkey") % 2 == 0, F.sha2(F.concat(F.lit("src/"), C("p_partkey").cast("string")), 256)).alias("expected"))
    key = C("p_partkey").cast("string")
    tried = [F.when(C("p_partkey") % 5 > 0, F.concat(F.lit("src/"), key)), F.concat(F.lit("other/"), key), F.concat(F.lit("copy/"), (C("p_partkey") % 50).cast("string"))]
    paths = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("src/"), key).alias("path")).union(p.select(F.concat(F.lit("other/"), key))).union(p.filter("p_partkey < 25").select(F.concat(F.lit("copy/"), key)))
    return evidence.first_existing(p, "p_partkey", tried, "expected", paths.withColumn("digest", F.sha2("path", 256)), ["src", "copy"])


ASSET_SOURCES = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN sha256('src/' || p_partkey) END AS expected, [CASE WHEN p_partkey % 5 > 0 THEN 'src/' || p_partkey END, 'other/' || p_partkey, 'copy/' || (p_partkey % 50)] AS tried FROM part),
f AS (SELECT 'src/' || p_partkey AS path FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'other/' || p_partkey FROM part UNION SELECT 'copy/' || p_partkey FROM part WHERE p_partkey < 25),
t AS (SELECT p_partkey, unnest(tried) AS path, unnest(range(len(tried))) AS place FROM p),
h AS (SELECT p_partkey, min((place, path)) AS best FROM t JOIN f USING (path) WHERE split_part(path, '/', 1) IN ('src', 'copy') GROUP BY 1)
SELECT p_partkey, CAST(best[1] AS INTEGER) AS place, best[2] AS path, CASE WHEN best IS NULL THEN 'absent' WHEN sha256(best[2]) <> expected THEN 'mismatch' ELSE 'resolved' END AS state FROM p LEFT JOIN h USING (p_partkey)
"""


def required_files(spark, d):
    """What each customer's set of orders should have and has not: an order of every priority."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return evidence.missing_of(table(spark, d, "orders"), "o_custkey", "o_orderpriority", names)


REQUIRED_FILES = """
SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders))
EXCEPT SELECT o_custkey, o_orderpriority FROM orders
"""


def distinct_records(spark, d):
    """Equal records once, with the place of the first."""
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"), F.count("*").alias("n_equal")).select("l_partkey", "l_suppkey", C("f.l_orderkey").alias("l_orderkey"), C("f.l_linenumber").alias("l_linenumber"), "n_equal")


DISTINCT_RECORDS = "SELECT l_partkey, l_suppkey, min((l_orderkey,l_linenumber))[1] AS l_orderkey, min((l_orderkey,l_linenumber))[2] AS l_linenumber, count(*) AS n_equal FROM lineitem GROUP BY 1,2"


def response_views(spark, d):
    """How an answer of each kind is shown: options with marks, pairs, places, or texts."""
    kind = C("l_orderkey") % 4
    part, supplier, number = (C(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    shown = F.when(kind == 0, F.concat(F.when(C("l_returnflag") == "R", "[x] ").otherwise("[ ] "), part)).when(kind == 1, F.concat(part, F.lit(" = "), supplier)).when(kind == 2, F.concat(number, F.lit(". "), part)).otherwise(part)
    name = F.when(kind == 0, "options").when(kind == 1, "pairs").when(kind == 2, "places").otherwise("texts")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", shown.alias("shown"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey", name.alias("kind")).agg(F.array_join(F.transform(lines, lambda x: x.shown), "; ").alias("shown"))


RESPONSE_VIEWS = """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey%4 WHEN 0 THEN 'options' WHEN 1 THEN 'pairs' WHEN 2 THEN 'places' ELSE 'texts' END AS kind,
 CASE l_orderkey%4 WHEN 0 THEN CASE WHEN l_returnflag='R' THEN '[x] ' ELSE '[ ] ' END || l_partkey WHEN 1 THEN l_partkey || ' = ' || l_suppkey WHEN 2 THEN l_linenumber || '. ' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS shown FROM lineitem)
SELECT l_orderkey, kind, string_agg(shown, '; ' ORDER BY l_linenumber, shown) AS shown FROM s GROUP BY 1,2
"""


def catalog_keys(spark, d):
    """The key under which a record of each kind is listed; kinds without one are left out."""
    key = F.when(C("o_orderstatus") == "F", F.concat(F.lit("order "), C("o_orderkey").cast("string"))).when(C("o_orderstatus") == "O", F.concat(F.lit("customer "), C("o_custkey").cast("string")))
    return table(spark, d, "orders").select(C("o_orderstatus").alias("kind"), key.alias("catalog_key")).filter("catalog_key IS NOT NULL").groupBy("kind", "catalog_key").agg(F.count("*").alias("n_records"))


CATALOG_KEYS = "SELECT o_orderstatus AS kind, CASE o_orderstatus WHEN 'F' THEN 'order ' || o_orderkey ELSE 'customer ' || o_custkey END AS catalog_key, count(*) AS n_records FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1,2"

_ACTIONS = {"view": "review again", "click": "decide between revisions"}


def promotion_exclusions(spark, d):
    """What receipts leave out, why, and what comes next; entries that are no objects are passed over."""
    e = table(spark, d, "events")
    number = C("event_id").cast("string")
    body = F.concat(F.lit('{"excluded":[{"id":"'), number, F.lit('-1","reason":"'), "event_type", F.lit('"},{"id":"'), number, F.lit('-2"},'), F.when(C("event_type") == "error", "null").otherwise(F.concat(F.lit('{"id":"'), number, F.lit('-3","reason":""}'))), F.lit("]}"))
    rows = e.select(F.explode(F.from_json(body, "excluded array<struct<id:string,reason:string>>").excluded).alias("x")).filter("x.id IS NOT NULL")
    reason = F.coalesce(F.nullif("x.reason", F.lit("")), F.lit("unspecified_exclusion"))
    action = F.coalesce(*[F.when(reason == k, v) for k, v in _ACTIONS.items()], F.lit("look at the record"))
    return rows.select(C("x.id").alias("annotation"), reason.alias("reason"), action.alias("next_action"))


PROMOTION_EXCLUSIONS = """
WITH b AS (SELECT concat('{"excluded":[{"id":"', event_id, '-1","reason":"', event_type, '"},{"id":"', event_id, '-2"},', CASE WHEN event_type = 'error' THEN 'null' ELSE '{"id":"' || event_id || '-3","reason":""}' END, ']}') AS body FROM events),
x AS (SELECT unnest(from_json(json_extract(body, '$.excluded'), '[{"id":"VARCHAR","reason":"VARCHAR"}]')) AS x FROM b), r AS (SELECT x.id AS annotation, coalesce(nullif(x.reason, ''), 'unspecified_exclusion') AS reason FROM x WHERE x.id IS NOT NULL)
SELECT *, CASE reason WHEN 'view' THEN 'review again' WHEN 'click' THEN 'decide between revisions' ELSE 'look at the record' END AS next_action FROM r
"""


def fact_attributes(spark, d):
    """Orders' lines as attributes by flag and status; an order that has one of them twice has no attributes."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("", "l_returnflag", "l_linestatus").alias("name"), "l_partkey")
    entries = F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit("="), F.element_at("attributes", k).cast("string")))
    return evidence.unique_attributes(li, ["l_orderkey"], "name", "l_partkey").select("l_orderkey", F.array_join(entries, " ").alias("attributes"))


FACT_ATTRIBUTES = """
WITH a AS (SELECT l_orderkey, concat(l_returnflag, l_linestatus) AS name, l_partkey FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*)=count(DISTINCT name) THEN string_agg(name || '=' || l_partkey, ' ' ORDER BY name) END AS attributes FROM a GROUP BY 1
"""


def setting_values(spark, d):
    """Values of settings: what their JSON says, or the text where it is none."""
    body = F.when(C("event_id") % 4 == 0, C("user_id").cast("string")).when(C("event_id") % 4 == 1, F.concat(F.lit('"'), C("event_type"), F.lit('"'))).when(C("event_id") % 4 == 2, F.concat(C("event_type"), F.lit(" it"))).otherwise(C("props"))
    kind, value = evidence.json_value(C("body"))
    return table(spark, d, "events").withColumn("body", body).select("event_id", kind.alias("kind"), value.alias("value"))


SETTING_VALUES = """
SELECT event_id, CASE event_id%4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' WHEN 2 THEN 'text' ELSE 'object' END AS kind, CASE event_id%4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN event_type || ' it' ELSE replace(props,' ','') END AS value FROM events
"""


def reference_fields(spark, d):
    """All references that lines make, by kind and path: how many, and how many name nothing that is there."""
    li = table(spark, d, "lineitem").withColumn("both", F.array("l_partkey", "l_suppkey"))
    refs = evidence.references(li, "l_orderkey", {"order": "l_orderkey", "supplier": "l_suppkey", "part": "both"}).groupBy("kind", "path", "reference").agg(F.count("*").alias("n"))
    there = [table(spark, d, t).select(F.lit(k).alias("kind"), C(c).cast("string").alias("reference")) for k, t, c in (("order", "orders", "o_orderkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"))]
    known = there[0].unionByName(there[1]).unionByName(there[2]).distinct().withColumn("known", F.lit(True))
    return refs.join(known, ["kind", "reference"], "left").groupBy("kind", "path").agg(F.sum("n").alias("n_references"), F.coalesce(F.sum(F.when(C("known").isNull(), C("n"))), F.lit(0)).alias("n_dangling"))


REFERENCE_FIELDS = """
WITH r AS (SELECT 'order' AS kind, '$.l_orderkey' AS path, l_orderkey AS r FROM lineitem UNION ALL SELECT 'supplier', '$.l_suppkey', l_suppkey FROM lineitem UNION ALL SELECT 'part', '$.both[0]', l_partkey FROM lineitem UNION ALL SELECT 'part', '$.both[1]', l_suppkey FROM lineitem),
k AS (SELECT 'order' AS kind, o_orderkey AS r FROM orders UNION SELECT 'supplier', s_suppkey FROM supplier UNION SELECT 'part', p_partkey FROM part)
SELECT r.kind, path, count(*) AS n_references, count(*) FILTER (k.r IS NULL) AS n_dangling FROM r LEFT JOIN k ON k.kind=r.kind AND k.r=r.r GROUP BY 1,2
"""


def byte_scan(spark, d):
    """Rules over files of bytes, every other one in UTF-16."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return scan.scan_bytes(docs.withColumn("content", F.when(C("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))), "doc_id", "content")


BYTE_SCAN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, len(regexp_extract_all(text, '{p}')) AS n_found FROM documents WHERE regexp_matches(text, '{p}')" for k, p in scan.RULES.items())

_ALL = {
    "edge_keys": (edge_keys, EDGE_KEYS), "pool_descriptors": (pool_descriptors, POOL_DESCRIPTORS), "occurrence_diagnostics": (occurrence_diagnostics, OCCURRENCE_DIAGNOSTICS), "status_keys": (status_keys, STATUS_KEYS),
    "unresolved_occurrences": (unresolved_occurrences, UNRESOLVED_OCCURRENCES), "single_facts": (single_facts, SINGLE_FACTS), "evidence_pairs": (evidence_pairs, EVIDENCE_PAIRS), "tolerant_candidates": (tolerant_candidates, TOLERANT_CANDIDATES),
    "variant_channels": (variant_channels, VARIANT_CHANNELS), "asset_sources": (asset_sources, ASSET_SOURCES), "required_files": (required_files, REQUIRED_FILES), "distinct_records": (distinct_records, DISTINCT_RECORDS),
    "response_views": (response_views, RESPONSE_VIEWS), "catalog_keys": (catalog_keys, CATALOG_KEYS), "promotion_exclusions": (promotion_exclusions, PROMOTION_EXCLUSIONS), "fact_attributes": (fact_attributes, FACT_ATTRIBUTES),
    "setting_values": (setting_values, SETTING_VALUES), "reference_fields": (reference_fields, REFERENCE_FIELDS), "byte_scan": (byte_scan, BYTE_SCAN),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
