"""Text, markup, key and scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys, markup, text
from tessera.operators import scan
from tessera.sources.tables import table


def text_exact_keys(spark, d):
    docs = table(spark, d, "documents")
    key = text.exact_key(F.col("text"))
    return docs.select("doc_id", F.sha2(key, 256).alias("exact_sha"), keys.digest(F.col("lang"), key, length=16).alias("signature"))


_EXACT = "trim(regexp_replace(translate(lower(text), '‘’“”–—' || chr(160), '''''\"\"-- '), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))"
TEXT_EXACT_KEYS = f"SELECT doc_id, sha256(k) AS exact_sha, substr(sha256(CAST(to_json([coalesce(lang,''), k]) AS VARCHAR)),1,16) AS signature FROM (SELECT doc_id, lang, {_EXACT} AS k FROM documents)"


def text_similarity_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.similarity_key(F.col("text")), 256).alias("similarity_sha"))


def _similarity_sql() -> str:
    key = _EXACT
    for spoken, symbol in text.SPOKEN_FORMS:
        key = f"replace({key}, '{spoken}', '{symbol}')"
    return f"SELECT doc_id, sha256(trim(regexp_replace({key}, '[^a-z0-9]+', ' ', 'g'))) AS similarity_sha FROM documents"


def html_flatten(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.without_tags(F.col("html")), 256).alias("flat_sha"), F.length(text.without_tags(F.col("html"), scripts=False)).alias("n_readable"))


_FLAT = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"
_NO_SCRIPT = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"
HTML_FLATTEN = f"SELECT page_id, sha256({_FLAT.format('html')}) AS flat_sha, CAST(length({_FLAT.format(_NO_SCRIPT)}) AS INT) AS n_readable FROM pages"


def html_render(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_text(F.col("html")).alias("rendered"), text.package_path(F.col("url")).alias("path"))


def asset_refs(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.local_refs(F.col("html")), "|").alias("refs"), F.size(text.local_refs(F.col("html"))).alias("n_refs"))


ASSET_REFS = r"""
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*"([^"]*)"', 1)) AS u FROM pages),
c AS (SELECT DISTINCT page_id, regexp_replace(u, '[?#].*$', '') AS u FROM r), k AS (SELECT * FROM c WHERE u<>'' AND NOT regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)'))
SELECT p.page_id, coalesce(string_agg(u, '|' ORDER BY u), '') AS refs, CAST(count(u) AS INT) AS n_refs FROM pages p LEFT JOIN k USING (page_id) GROUP BY p.page_id
"""


def line_scan(spark, d):
    return scan.scan_lines(table(spark, d, "documents"), "doc_id", "text")


def _scan_sql() -> str:
    parts = [f"SELECT doc_id, CAST(i AS INT) AS line_number, '{k}' AS rule, CAST(len(regexp_extract_all(line, '{p}')) AS INT) AS n_found FROM l" for k, p in scan.RULES.items()]
    return "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls)+1)) AS i FROM s) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_found > 0"


def json_leaf_walk(spark, d):
    return scan.json_leaves(table(spark, d, "events"), "event_id", "props")


JSON_LEAF_WALK = "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"


def scalar_normalize(spark, d):
    value = F.get_json_object("props", "$.k")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(" Yes ")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("+"), value)).when(F.col("event_id") % 4 == 2, F.concat(value, F.lit(".50"))).otherwise(F.col("event_type")).alias("raw"))
    return e.select("event_id", text.scalar_kind(F.col("raw")).alias("kind"), text.scalar_value(F.col("raw")).alias("value"), text.truthy(F.col("raw")).alias("is_true"))


SCALAR_NORMALIZE = """
WITH e AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN ' Yes ' WHEN 1 THEN '+' || json_extract_string(props,'$.k') WHEN 2 THEN json_extract_string(props,'$.k') || '.50' ELSE event_type END AS raw FROM events),
k AS (SELECT *, lower(trim(raw)) AS v FROM e)
SELECT event_id, CASE WHEN v IS NULL OR v='' THEN 'empty' WHEN v IN ('yes','true','no','false') THEN 'boolean' WHEN regexp_matches(v,'^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v,'^[+-]?[0-9]*\\.[0-9]+$') THEN 'decimal' ELSE 'text' END AS kind,
 CASE WHEN v IN ('yes','true') THEN 'true' WHEN v IN ('no','false') THEN 'false' WHEN regexp_matches(v,'^[+-]?[0-9]*\\.?[0-9]+$') THEN regexp_replace(trim(raw),'^\\+','') ELSE trim(raw) END AS value,
 coalesce(upper(trim(raw)) IN ('TRUE','YES','Y','1'), false) AS is_true FROM k
""".replace("\\\\", "\\")


def entity_keys(spark, d):
    """Permanent codes for every third supplier, aliases for the others."""
    s = table(spark, d, "supplier")
    code = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))
    return s.select("s_suppkey", keys.entity_key("record", F.lit("course-1"), code, F.lit("name"), F.col("s_name")).alias("entity_key"))


ENTITY_KEYS = """
SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN 'key:record:' || regexp_replace(regexp_replace(lower(s_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') || ':' || substr(sha256(CAST(to_json(['record', s_name]) AS VARCHAR)),1,8)
 ELSE 'key:record:course-1:source-' || substr(sha256(CAST(to_json(['course-1','record','name',s_name]) AS VARCHAR)),1,24) END AS entity_key FROM supplier
"""

QUERIES = {
    "text_exact_keys": text_exact_keys, "text_similarity_keys": text_similarity_keys, "html_flatten": html_flatten, "html_render": html_render, "asset_refs": asset_refs,
    "line_scan": line_scan, "json_leaf_walk": json_leaf_walk, "scalar_normalize": scalar_normalize, "entity_keys": entity_keys,
}
ORACLE_SQL = {
    "text_exact_keys": TEXT_EXACT_KEYS, "text_similarity_keys": _similarity_sql(), "html_flatten": HTML_FLATTEN, "asset_refs": ASSET_REFS,
    "line_scan": _scan_sql(), "json_leaf_walk": JSON_LEAF_WALK, "scalar_normalize": SCALAR_NORMALIZE, "entity_keys": ENTITY_KEYS,
}
