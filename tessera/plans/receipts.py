"""Queries over receipts, packets, replacements and projections, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import labels, text
from tessera.operators import identity, rules
from tessera.sources.tables import table

C = F.col


def receipt_check(spark, d):
    """A receipt's sizes and digests against the files there are: equal, changed, missing or not declared."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("f"), C("doc_id").cast("string")).alias("path"), "doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha"))
    declared = docs.filter("doc_id % 13 <> 0").select("path", (C("size") + F.when(C("doc_id") % 17 == 0, 1).otherwise(0)).alias("declared_size"), F.when(C("doc_id") % 19 == 0, F.sha2("path", 256)).otherwise(C("sha")).alias("declared_sha"))
    there = docs.filter("doc_id % 11 <> 0").select("path", "size", "sha")
    state = F.when(C("sha").isNull(), "missing").when(C("declared_sha").isNull(), "undeclared").when((C("size") != C("declared_size")) | (C("sha") != C("declared_sha")), "changed").otherwise("equal")
    return declared.join(there, "path", "full_outer").select("path", state.alias("state"))


RECEIPT_CHECK = """
WITH f AS (SELECT 'f' || doc_id AS path, doc_id, strlen(text) AS size, sha256(text) AS sha FROM documents),
a AS (SELECT path, size + CASE WHEN doc_id%17=0 THEN 1 ELSE 0 END AS ds, CASE WHEN doc_id%19=0 THEN sha256(path) ELSE sha END AS dh FROM f WHERE doc_id%13<>0), b AS (SELECT path, size, sha FROM f WHERE doc_id%11<>0)
SELECT coalesce(a.path,b.path) AS path, CASE WHEN b.sha IS NULL THEN 'missing' WHEN dh IS NULL THEN 'undeclared' WHEN size<>ds OR sha<>dh THEN 'changed' ELSE 'equal' END AS state FROM a FULL JOIN b ON a.path=b.path
"""


def promotion_chain(spark, d):
    """Orders of a customer as steps of a chain: each must begin with what the one before it ended with."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sha2(F.concat_ws(":", "o_custkey", F.when(C("o_orderkey") % 7 == 0, -1).otherwise(C("o_orderkey"))), 256).alias("result"), F.sha2(F.concat_ws(":", "o_custkey", "o_orderkey"), 256).alias("claimed"))
    step = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    linked = o.withColumns({"step": F.row_number().over(step), "before": F.lag("result").over(step), "expected": F.lag("claimed").over(step)})
    state = F.when(C("step") == 1, "start").when(C("before") == C("expected"), "linked").otherwise("broken")
    return linked.groupBy("o_custkey").agg(F.count("*").alias("n_steps"), F.count_if(state == "broken").alias("n_broken"), F.min(F.when(state == "broken", C("step"))).cast("long").alias("first_broken"))


PROMOTION_CHAIN = """
WITH s AS (SELECT o_custkey, row_number() OVER w AS n, lag(o_orderkey) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, count(*) AS n_steps, count(*) FILTER (p%7=0) AS n_broken, min(n) FILTER (p%7=0) AS first_broken FROM s GROUP BY 1
"""


def _packet(spark, d):
    """Lines as decisions over parts: one wanted for each part of a packet (an order)."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.when(C("l_returnflag") == "R", "accept").when(C("l_returnflag") == "A", "revise").when(C("l_linenumber") % 3 > 0, "keep").otherwise("?").alias("decision"), F.when(C("l_suppkey") % 5 > 0, C("l_suppkey").cast("string")).alias("revised"))


def packet_issues(spark, d):
    """Decisions that do not hold: unknown ones, revisions without a text, texts without a revision, parts decided twice."""
    p = _packet(spark, d).withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    known = C("decision").isin("accept", "revise", "keep")
    twice = rules.repeated(p, ["l_orderkey", "l_partkey"], "decided_twice")
    return rules.union_all([
        rules.violating(p, "key", known, "unknown_decision", C("decision"), "error"),
        rules.violating(p, "key", (C("decision") != "revise") | C("revised").isNotNull(), "revision_missing", C("decision"), "error"),
        rules.violating(p, "key", (C("decision") != "keep") | C("revised").isNull(), "revision_unused", C("revised")),
        twice,
    ])


_PACKET_SQL = "p AS (SELECT *, l_orderkey || ':' || l_linenumber AS key, CASE WHEN l_returnflag='R' THEN 'accept' WHEN l_returnflag='A' THEN 'revise' WHEN l_linenumber%3>0 THEN 'keep' ELSE '?' END AS decision, CASE WHEN l_suppkey%5>0 THEN CAST(l_suppkey AS VARCHAR) END AS revised FROM lineitem)"
PACKET_ISSUES = f"""
WITH {_PACKET_SQL}
SELECT 'error' AS severity, 'unknown_decision' AS code, key AS entity_key, decision AS detail FROM p WHERE decision='?' UNION ALL SELECT 'error', 'revision_missing', key, decision FROM p WHERE decision='revise' AND revised IS NULL
UNION ALL SELECT 'warning', 'revision_unused', key, revised FROM p WHERE decision='keep' AND revised IS NOT NULL UNION ALL SELECT 'error', 'decided_twice', l_orderkey || ':' || l_partkey, CAST(count(*) AS VARCHAR) FROM p GROUP BY l_orderkey, l_partkey HAVING count(*)>1
"""


def materialized_decisions(spark, d):
    """What parts become after all decisions: the one revision, the given name, or nothing where revisions disagree."""
    decided = _packet(spark, d).filter("decision = 'revise' AND revised IS NOT NULL").groupBy("l_partkey").agg(F.countDistinct("revised").alias("n_revisions"), F.min("revised").alias("revised"))
    p = table(spark, d, "part").join(decided, C("p_partkey") == C("l_partkey"), "left")
    state = F.when(C("n_revisions").isNull(), "kept").when(C("n_revisions") == 1, "revised").otherwise("conflict")
    return p.select("p_partkey", state.alias("state"), F.when(state == "kept", C("p_name")).when(state == "revised", C("revised")).alias("value"))


MATERIALIZED = f"""
WITH {_PACKET_SQL}, r AS (SELECT l_partkey, count(DISTINCT revised) AS n, min(revised) AS v FROM p WHERE decision='revise' AND revised IS NOT NULL GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'kept' WHEN n=1 THEN 'revised' ELSE 'conflict' END AS state, CASE WHEN n IS NULL THEN p_name WHEN n=1 THEN v END AS value FROM part LEFT JOIN r ON p_partkey=l_partkey
"""


def asset_replacements(spark, d):
    """Replacements of pages' files: the original must be in use and the new file there, and each original is replaced once."""
    p = table(spark, d, "pages").select("page_id", "html", text.package_path(C("url")).alias("path"))
    refs = p.select(F.explode(text.local_refs(C("html"))).alias("ref")).select(text.package_path(C("ref")).alias("path")).groupBy("path").agg(F.count("*").alias("n_uses"))
    wanted = p.select("page_id", "path", F.concat(F.lit("new/"), (C("page_id") % 40).cast("string")).alias("replacement"))
    files = p.select(F.concat(F.lit("new/"), (C("page_id") % 30).cast("string")).alias("replacement")).distinct().withColumn("there", F.lit(True))
    times = wanted.groupBy("path").agg(F.count("*").alias("n_wanted"))
    out = wanted.join(refs, "path", "left").join(files, "replacement", "left").join(times, "path")
    return out.select("page_id", F.when(C("n_wanted") > 1, "repeated").when(C("n_uses").isNull(), "unused").when(C("there").isNull(), "absent").otherwise("bound").alias("state"))


ASSET_REPLACEMENTS = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url),'\','/'),'^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*',''),'[#?].*$',''),'/+','/','g'),'^(\./)?/?','') AS path FROM pages),
u AS (SELECT regexp_replace(unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*"([^"]*)"', 1)), '[?#].*$', '') AS u FROM p),
r AS (SELECT DISTINCT regexp_replace(regexp_replace(replace(trim(u),'\','/'),'/+','/','g'),'^(\./)?/?','') AS path FROM u WHERE u<>'' AND NOT regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)')),
f AS (SELECT DISTINCT page_id%30 AS k FROM p)
SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY p.path)>1 THEN 'repeated' WHEN r.path IS NULL THEN 'unused' WHEN f.k IS NULL THEN 'absent' ELSE 'bound' END AS state FROM p LEFT JOIN r ON p.path=r.path LEFT JOIN f ON page_id%40=f.k
"""


def filter_options(spark, d):
    """Values by which documents and orders can be narrowed down, with how many rows each has."""
    o, docs = table(spark, d, "orders"), table(spark, d, "documents")
    parts = [df.groupBy(F.lit(c).alias("filter"), C(c).cast("string").alias("value")).agg(F.count("*").alias("n_rows")) for df, c in ((o, "o_orderstatus"), (o, "o_orderpriority"), (docs, "lang"), (docs, "source"))]
    return rules.union_all(parts).filter("value <> ''")


FILTER_OPTIONS = " UNION ALL ".join(f"SELECT '{c}' AS filter, {c} AS value, count(*) AS n_rows FROM {t} WHERE {c}<>'' GROUP BY 2" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("documents", "lang"), ("documents", "source")))


def parent_paths(spark, d):
    """The nearest path above each page's that another page has."""
    p = table(spark, d, "pages").select("page_id", text.package_path(C("url")).alias("path"))
    parts = F.split("path", "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda x: (x != C("path")) & (x != ""))
    known = p.filter("path <> ''").groupBy("path").agg(F.min("page_id").alias("parent_id")).withColumnRenamed("path", "above")
    found = p.select("page_id", F.explode(above).alias("above")).join(known, "above").groupBy("page_id").agg(F.max(F.struct(F.length("above").alias("n"), "above", "parent_id")).alias("b"))
    return p.join(found, "page_id", "left").select("page_id", C("b.parent_id").alias("parent_id"), F.coalesce("b.above", F.lit("")).alias("parent_path"))


PARENT_PATHS = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url),'\','/'),'^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*',''),'[#?].*$',''),'/+','/','g'),'^(\./)?/?','') AS path FROM pages),
k AS (SELECT path, min(page_id) AS id FROM p WHERE path<>'' GROUP BY 1), s AS (SELECT page_id, path, string_split(path,'/') AS w FROM p),
a AS (SELECT page_id, array_to_string(w[1:n],'/') AS above FROM (SELECT page_id, path, w, unnest(range(1,len(w)+1)) AS n FROM s) WHERE array_to_string(w[1:n],'/') NOT IN (path, '')),
f AS (SELECT page_id, arg_max(above, length(above)) AS above FROM a JOIN k ON above=path GROUP BY 1)
SELECT p.page_id, k.id AS parent_id, coalesce(above,'') AS parent_path FROM p LEFT JOIN f USING (page_id) LEFT JOIN k ON k.path=above
"""


def identity_fields(spark, d):
    """Identifiers of parts from the strongest to the weakest, empty ones left out, and the first of them."""
    p = table(spark, d, "part")
    pairs = [("globalid", F.when(C("p_partkey") % 4 == 0, F.concat(F.lit("g"), C("p_partkey").cast("string")))), ("displayid", F.when(C("p_partkey") % 3 == 0, C("p_brand"))), ("ident", F.when(C("p_partkey") % 2 == 0, F.lit("  "))), ("label", F.when(C("p_partkey") % 5 > 0, C("p_name")))]
    told = F.concat_ws(" || ", *[F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{n}="), F.trim(v))) for n, v in pairs])
    return p.select("p_partkey", told.alias("identifiers"), F.coalesce(F.regexp_extract(told, "^([a-z]+)=", 1), F.lit("")).alias("strongest"))


IDENTITY_FIELDS = """
WITH p AS (SELECT p_partkey, concat_ws(' || ', CASE WHEN p_partkey%4=0 THEN 'globalid=g' || p_partkey END, CASE WHEN p_partkey%3=0 THEN 'displayid=' || trim(p_brand) END, CASE WHEN p_partkey%5>0 THEN 'label=' || trim(p_name) END) AS t FROM part)
SELECT p_partkey, t AS identifiers, CASE WHEN t='' THEN '' ELSE split_part(t,'=',1) END AS strongest FROM p
"""


def occurrence_pools(spark, d):
    """The pools of each part's placements: path, title or key, whichever comes first; distinct ones in order, and the last entry of each."""
    li = table(spark, d, "lineitem")
    pool = F.coalesce(F.when(C("l_suppkey") % 3 == 0, F.concat(F.lit("path "), C("l_suppkey").cast("string"))), F.when(C("l_suppkey") % 3 == 1, C("l_returnflag")), C("l_suppkey").cast("string"))
    by_pool = li.select("l_partkey", pool.alias("pool"), F.struct("l_orderkey", "l_linenumber").alias("at")).groupBy("l_partkey", "pool").agg(F.max("at").alias("at"))
    return by_pool.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("pool")), " | ").alias("pools"), F.max_by("pool", F.struct("at", "pool")).alias("last_pool"))


OCCURRENCE_POOLS = """
WITH p AS (SELECT l_partkey, CASE l_suppkey%3 WHEN 0 THEN 'path ' || l_suppkey WHEN 1 THEN l_returnflag ELSE CAST(l_suppkey AS VARCHAR) END AS pool, max((l_orderkey,l_linenumber)) AS a FROM lineitem GROUP BY 1,2)
SELECT l_partkey, string_agg(pool, ' | ' ORDER BY pool) AS pools, arg_max(pool, (a,pool)) AS last_pool FROM p GROUP BY 1
"""


def contract_issues(spark, d):
    """Events whose properties break a contract: no object, a required field absent, or of another kind."""
    e = table(spark, d, "events").withColumn("body", F.when(C("event_id") % 9 == 0, "not json").when(C("event_id") % 9 == 1, '{"k": "text"}').when(C("event_id") % 9 == 2, "{}").otherwise(C("props")))
    parsed = F.try_parse_json("body")
    value = F.try_variant_get(parsed, "$.k", "string")
    code = F.when(parsed.isNull(), "not_json").when(value.isNull(), "missing_field").when(~F.schema_of_variant(parsed).rlike("k: BIGINT"), "wrong_kind")
    return e.select("event_id", code.alias("code")).filter("code IS NOT NULL")


CONTRACT_ISSUES = """
SELECT event_id, CASE event_id%9 WHEN 0 THEN 'not_json' WHEN 1 THEN 'wrong_kind' WHEN 2 THEN 'missing_field' END AS code FROM events WHERE event_id%9<3
UNION ALL SELECT event_id, CASE WHEN json_extract(props,'$.k') IS NULL THEN 'missing_field' ELSE 'wrong_kind' END FROM events WHERE event_id%9>=3 AND (json_extract(props,'$.k') IS NULL OR json_type(props,'$.k') NOT IN ('BIGINT','UBIGINT'))
"""


def payload_references(spark, d):
    """Pages as payloads: where they lie, whether a link leads to them, and how severe it is if none does."""
    p = table(spark, d, "pages").select("page_id", "html", text.package_path(C("url")).alias("path"))
    refs = p.select(F.explode(text.local_refs(C("html"))).alias("ref")).select(text.package_path(C("ref")).alias("path")).groupBy("path").agg(F.count("*").alias("n_links"))
    at_root = F.size(F.split("path", "/")) == 2
    code = F.when(C("n_links").isNull(), "unreferenced").when(~at_root, "nested")
    severity = F.when(code == "unreferenced", F.when(C("page_id") % 2 == 0, "error").otherwise("warning")).when(code == "nested", "warning")
    return p.join(refs, "path", "left").select("page_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), at_root.alias("at_root"), code.alias("code"), severity.alias("severity"))


PAYLOAD_REFERENCES = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url),'\','/'),'^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*',''),'[#?].*$',''),'/+','/','g'),'^(\./)?/?','') AS path FROM pages),
x AS (SELECT page_id, unnest(list_distinct([regexp_replace(u, '[?#].*$', '') FOR u IN regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*"([^"]*)"', 1)])) AS u FROM p),
r AS (SELECT regexp_replace(regexp_replace(replace(trim(u),'\','/'),'/+','/','g'),'^(\./)?/?','') AS path, count(*) AS n FROM x WHERE u<>'' AND NOT regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)') GROUP BY 1)
SELECT page_id, coalesce(n,0) AS n_links, len(string_split(p.path,'/'))=2 AS at_root, CASE WHEN n IS NULL THEN 'unreferenced' WHEN len(string_split(p.path,'/'))<>2 THEN 'nested' END AS code,
 CASE WHEN n IS NULL THEN CASE WHEN page_id%2=0 THEN 'error' ELSE 'warning' END WHEN len(string_split(p.path,'/'))<>2 THEN 'warning' END AS severity FROM p LEFT JOIN r ON p.path=r.path
"""


def option_lines(spark, d):
    """Options of orders as lines with their marks, and the key that follows from them."""
    li = table(spark, d, "lineitem")
    marked = identity.first_per(li, ["l_orderkey", "l_linenumber"], [C("l_partkey"), C("l_suppkey"), C("l_returnflag")])
    line = F.format_string("%s [%s]: %s", C("l_linenumber"), F.when(C("l_returnflag") == "R", "correct").otherwise("option"), C("l_partkey"))
    rows = marked.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line"), (C("l_returnflag") == "R").alias("right")))).alias("l"))
    return rows.select("l_orderkey", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("options"), F.array_join(F.transform(F.filter("l", lambda x: x.right), lambda x: x.l_linenumber.cast("string")), " || ").alias("answer_key"), labels.preview(F.array_join(F.transform("l", lambda x: x.line), " ")).alias("preview"))


OPTION_LINES = """
WITH m AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag)=1), t AS (SELECT *, l_linenumber || ' [' || CASE WHEN l_returnflag='R' THEN 'correct' ELSE 'option' END || ']: ' || l_partkey AS line FROM m),
g AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber) AS options, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ' || ' ORDER BY l_linenumber) FILTER (l_returnflag='R'), '') AS answer_key FROM t GROUP BY 1)
SELECT *, CASE WHEN length(options)>96 THEN rtrim(substr(replace(options, chr(10), ' '),1,93)) || '…' ELSE replace(options, chr(10), ' ') END AS preview FROM g
"""

_ALL = {
    "receipt_check": (receipt_check, RECEIPT_CHECK), "promotion_chain": (promotion_chain, PROMOTION_CHAIN), "packet_issues": (packet_issues, PACKET_ISSUES), "materialized_decisions": (materialized_decisions, MATERIALIZED),
    "asset_replacements": (asset_replacements, ASSET_REPLACEMENTS), "filter_options": (filter_options, FILTER_OPTIONS), "parent_paths": (parent_paths, PARENT_PATHS), "identity_fields": (identity_fields, IDENTITY_FIELDS),
    "occurrence_pools": (occurrence_pools, OCCURRENCE_POOLS), "contract_issues": (contract_issues, CONTRACT_ISSUES), "payload_references": (payload_references, PAYLOAD_REFERENCES), "option_lines": (option_lines, OPTION_LINES),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
