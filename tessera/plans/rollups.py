"""Rollup, window and shard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import intake, project, rollup
from tessera.sources.tables import table


def bank_rollup(spark, d):
    """Region > nation > supplier as bank > pool > record, with counts of line items by evidence."""
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("z"))
    joined = suppliers.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return joined.groupBy(F.col("r_name").alias("bank")).agg(
        F.countDistinct("n_nationkey").alias("n_pools"),
        F.countDistinct("s_suppkey").alias("n_records"),
        rollup.labels(F.col("n_name")).alias("pools"),
        total("n").alias("n_uses"),
        total("r").alias("n_source_evidence"),
        total("a").alias("n_inferred"),
        total("z").alias("n_unmatched"),
    )


BANK_ROLLUP = """
WITH l AS (SELECT l_suppkey, count(*) n, count(*) FILTER (l_returnflag='R') r, count(*) FILTER (l_returnflag='A') a, count(*) FILTER (l_returnflag='N') z FROM lineitem GROUP BY 1)
SELECT r_name AS bank, count(DISTINCT n_nationkey) AS n_pools, count(DISTINCT s_suppkey) AS n_records, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS pools,
  CAST(coalesce(sum(n),0) AS BIGINT) AS n_uses, CAST(coalesce(sum(r),0) AS BIGINT) AS n_source_evidence, CAST(coalesce(sum(a),0) AS BIGINT) AS n_inferred, CAST(coalesce(sum(z),0) AS BIGINT) AS n_unmatched
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey LEFT JOIN l ON s_suppkey=l_suppkey GROUP BY r_name
"""


def global_summary(spark, d):
    """Counters of both tables, one row each."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.agg(F.count("*").alias("n_occurrences"), F.countDistinct("l_orderkey").alias("n_quizzes"), F.countDistinct("l_partkey").alias("n_records"), F.count_if(F.col("l_returnflag") == "R").alias("n_source_evidence"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))
    b = o.agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))
    return a.unpivot([], a.columns, "metric", "n").unionByName(b.unpivot([], b.columns, "metric", "n"))


GLOBAL_SUMMARY = """
UNPIVOT (SELECT count(*) AS n_occurrences, count(DISTINCT l_orderkey) AS n_quizzes, count(DISTINCT l_partkey) AS n_records, count(*) FILTER (l_returnflag='R') AS n_source_evidence, count(*) FILTER (l_linestatus='O') AS n_open,
 (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FILTER (o_orderstatus='F') FROM orders) AS n_final, (SELECT count(*) FILTER (o_totalprice>200000) FROM orders) AS n_large FROM lineitem)
ON COLUMNS(*) INTO NAME metric VALUE n
"""


def section_summary(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rollup.level_counts(rows.withColumn("section", F.col("o_orderpriority")), ["section"], "l_returnflag")


SECTION_SUMMARY = """
SELECT section, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(l_returnflag || ':' || n, ', ' ORDER BY l_returnflag || ':' || n) AS levels
FROM (SELECT o_orderpriority AS section, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2) GROUP BY section
"""


def quiz_summary_pivot(spark, d):
    e = table(spark, d, "events")
    kinds = ["click", "view", "purchase", "signup", "error"]
    return rollup.conditional_counts(e, ["user_id"], {f"n_{k}": F.col("event_type") == k for k in kinds}, F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_kinds"))


QUIZ_SUMMARY_PIVOT = """
SELECT user_id, count(*) FILTER (event_type='click') AS n_click, count(*) FILTER (event_type='view') AS n_view, count(*) FILTER (event_type='purchase') AS n_purchase,
 count(*) FILTER (event_type='signup') AS n_signup, count(*) FILTER (event_type='error') AS n_error, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id
"""


def occurrence_order(spark, d):
    rows = project.ordered(table(spark, d, "conversations"), "conv_id", [F.col("turn"), F.col("role")])
    return rows.select("conv_id", "turn", "role", "running")


OCCURRENCE_ORDER = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN coalesce(turn,0)=0 THEN 1000000000 ELSE turn END, role NULLS LAST) AS running FROM conversations
"""


def duplicate_order(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_claims")).filter("n_claims > 1")


DUPLICATE_ORDER = "SELECT l_orderkey, l_linenumber, count(*) AS n_claims FROM lineitem GROUP BY 1,2 HAVING count(*)>1"


def shard_manifest(spark, d):
    """Shards of 50 documents of a source, and a digest of each."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    rows = rollup.shards(docs, ["source"], [F.col("doc_id")], 50)
    return rows.groupBy("source", "shard").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), keys.file_set_digest(F.col("doc_id").cast("string"), F.col("size"), F.col("sha")).alias("digest"))


SHARD_MANIFEST = """
WITH s AS (SELECT *, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id)-1)//50 AS BIGINT) AS shard FROM documents)
SELECT source, shard, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id,
 sha256(string_agg(doc_id || chr(9) || length(text) || chr(9) || sha256(text), chr(10) ORDER BY doc_id || chr(9) || length(text) || chr(9) || sha256(text))) AS digest FROM s GROUP BY 1,2
"""


def fileset_digest(spark, d):
    docs = table(spark, d, "documents")
    return keys.file_set_digests(docs, "source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.octet_length("text"), F.sha2("text", 256))


FILESET_DIGEST = """
SELECT source, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
 sha256(string_agg('doc/' || doc_id || chr(9) || strlen(text) || chr(9) || sha256(text), chr(10) ORDER BY 'doc/' || doc_id || chr(9) || strlen(text) || chr(9) || sha256(text))) AS digest FROM documents GROUP BY source
"""


def sequence_gaps(spark, d):
    """Conversations whose user turns alone are not numbered 0, 1, 2, ..."""
    from tessera.operators import rules

    users = table(spark, d, "conversations").filter("role = 'user'")
    return rules.gaps(users, ["conv_id"], "turn", "turn_gap")


SEQUENCE_GAPS = """
SELECT 'error' AS severity, 'turn_gap' AS code, CAST(conv_id AS VARCHAR) AS entity_key, count(*) || '/' || min(turn) || '/' || max(turn) AS detail
FROM conversations WHERE role='user' GROUP BY conv_id HAVING count(*)<>count(DISTINCT turn) OR min(turn)<>0 OR max(turn)<>count(*)-1
"""


def intake_rules(spark, d):
    li = table(spark, d, "lineitem")
    slots = intake.permutation(li, "l_orderkey", "l_linenumber")
    one = intake.exactly(li, "l_orderkey", F.col("l_returnflag") == "R")
    return slots.join(one, "l_orderkey")


INTAKE_RULES = """
SELECT l_orderkey, count(*) AS n_slots, count(DISTINCT l_linenumber)=count(*) AND min(l_linenumber)=1 AND max(l_linenumber)=count(*) AS is_permutation,
 count(*) FILTER (l_returnflag='R') AS n_met, count(*) FILTER (l_returnflag='R')=1 AS holds FROM lineitem GROUP BY 1
"""

QUERIES = {
    "bank_rollup": bank_rollup, "global_summary": global_summary, "section_summary": section_summary, "quiz_summary_pivot": quiz_summary_pivot,
    "occurrence_order": occurrence_order, "duplicate_order": duplicate_order, "shard_manifest": shard_manifest, "fileset_digest": fileset_digest,
    "sequence_gaps": sequence_gaps, "intake_rules": intake_rules,
}
ORACLE_SQL = {
    "bank_rollup": BANK_ROLLUP, "global_summary": GLOBAL_SUMMARY, "section_summary": SECTION_SUMMARY, "quiz_summary_pivot": QUIZ_SUMMARY_PIVOT,
    "occurrence_order": OCCURRENCE_ORDER, "duplicate_order": DUPLICATE_ORDER, "shard_manifest": SHARD_MANIFEST, "fileset_digest": FILESET_DIGEST,
    "sequence_gaps": SEQUENCE_GAPS, "intake_rules": INTAKE_RULES,
}
