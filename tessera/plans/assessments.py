"""Codes, content digests, variants, contexts, packets, counters and queues, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, identity, project, rules
from tessera.sources.tables import table

C = F.col


def assign_codes(spark, d):
    """Sequential codes of regions, nations and suppliers, kind after kind; each kind's numbers start where the last one's end."""
    kinds = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")]
    rows = rules.union_all([table(spark, d, t).select(F.lit(i).alias("kind_order"), F.lit(t).alias("kind"), C(k).alias("entity")) for i, (t, k, _) in enumerate(kinds)])
    return project.numbered(rows, "kind_order", [C("entity")]).select("kind", "entity", F.concat(F.lit("C-"), F.lpad(C("number").cast("string"), 6, "0")).alias("code"))


ASSIGN_CODES = """
SELECT kind, entity, 'C-' || lpad(CAST(row_number() OVER (ORDER BY k, entity) AS VARCHAR), 6, '0') AS code
FROM (SELECT 0 AS k, 'region' AS kind, r_regionkey AS entity FROM region UNION ALL SELECT 1, 'nation', n_nationkey FROM nation UNION ALL SELECT 2, 'supplier', s_suppkey FROM supplier)
"""


def content_digest(spark, d):
    """The content of an order as one digest: its lines in order, without what says where they are placed."""
    line = F.concat_ws("|", "l_partkey", "l_returnflag", "l_linestatus")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line"))))
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    return out.select("l_orderkey", F.size("lines").cast("long").alias("n_parts"), F.sha2(F.array_join(F.transform("lines", lambda x: x.line), "\n"), 256).alias("content_digest"))


CONTENT_DIGEST = """
SELECT l_orderkey, count(*) AS n_parts, sha256(string_agg(l_partkey || '|' || l_returnflag || '|' || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey || '|' || l_returnflag || '|' || l_linestatus)) AS content_digest
FROM lineitem GROUP BY 1
"""


def variant_gate(spark, d):
    """Parts with their uses: a key is shown only where all uses agree."""
    out = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n_occurrences"), F.countDistinct("l_orderkey").alias("n_quizzes"), F.countDistinct("l_returnflag", "l_linestatus").alias("n_variants"), F.min("l_returnflag").alias("key")
    )
    return out.withColumn("key", F.when(C("n_variants") == 1, C("key")))


VARIANT_GATE = """
SELECT l_partkey, count(*) AS n_occurrences, count(DISTINCT l_orderkey) AS n_quizzes, count(DISTINCT l_returnflag || '|' || l_linestatus) AS n_variants,
 CASE WHEN count(DISTINCT l_returnflag || '|' || l_linestatus)=1 THEN min(l_returnflag) END AS key FROM lineitem GROUP BY 1
"""


def observation_digests(spark, d):
    """Observed settings by digest: how often, first and last, and how many repeat an earlier one."""
    e = table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "user_id", "event_type", F.get_json_object("props", "$.k")), 256).alias("digest"))
    return e.groupBy("digest").agg(F.count("*").alias("n_observed"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), (F.count("*") - 1).alias("n_repeats"))


OBSERVATION_DIGESTS = """
SELECT sha256(concat_ws('|', user_id, event_type, json_extract_string(props,'$.k'))) AS digest, count(*) AS n_observed, min(event_id) AS first_event, max(event_id) AS last_event, count(*)-1 AS n_repeats FROM events GROUP BY 1
"""


def unique_identities(spark, d):
    """A part's identity: its name where no other part has it, else brand and type, else its own number."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" > ", "p_brand", "p_type").alias("path"))
    return identity.first_unique(p, "p_partkey", ["p_name", "path"])


UNIQUE_IDENTITIES = """
WITH p AS (SELECT p_partkey, p_name, p_brand || ' > ' || p_type AS path FROM part), n AS (SELECT p_name FROM part GROUP BY 1 HAVING count(*)=1), t AS (SELECT path FROM p GROUP BY 1 HAVING count(*)=1)
SELECT p_partkey, CASE WHEN n.p_name IS NOT NULL THEN n.p_name WHEN t.path IS NOT NULL THEN t.path ELSE CAST(p_partkey AS VARCHAR) END AS identity, CASE WHEN n.p_name IS NOT NULL THEN 'p_name' WHEN t.path IS NOT NULL THEN 'path' ELSE 'p_partkey' END AS basis
FROM p LEFT JOIN n ON p.p_name=n.p_name LEFT JOIN t ON p.path=t.path
"""


def alias_conflicts(spark, d):
    """Groups of documents of equal content; an alias that more than one group claims is a conflict."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", C("doc_id") % 97).alias("alias"), F.sha2("text", 256).alias("group"))
    return docs.groupBy("alias").agg(F.count("*").alias("n_claims"), F.countDistinct("group").alias("n_groups"), F.min("doc_id").alias("first_id")).filter("n_groups > 1")


ALIAS_CONFLICTS = "SELECT concat_ws(':', source, doc_id%97) AS alias, count(*) AS n_claims, count(DISTINCT sha256(text)) AS n_groups, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text))>1"


def selection_context(spark, d):
    """The one region above a supplier; none where several are (every ninth supplier has a second parent)."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")

    def node(kind, column):
        return F.concat(F.lit(f"{kind}:"), column.cast("string"))

    up = s.select(node("s", C("s_suppkey")).alias("src"), node("n", C("s_nationkey")).alias("dst")).unionByName(n.select(node("n", C("n_nationkey")).alias("src"), node("r", C("n_regionkey")).alias("dst")))
    second = s.filter("s_suppkey % 9 = 0").select(node("s", C("s_suppkey")).alias("src"), node("r", C("s_suppkey") % 5).alias("dst"))
    above = graph.reachable(up.unionByName(second), s.select(node("s", C("s_suppkey")).alias("node"))).filter("node LIKE 'r:%'")
    found = above.groupBy("start").agg(F.countDistinct("node").alias("n_draws"), F.min("node").alias("draw"))
    return found.select("start", "n_draws", F.when(C("n_draws") == 1, C("draw")).alias("draw"), F.when(C("n_draws") == 1, "draw").otherwise("ambiguous").alias("context"))


SELECTION_CONTEXT = """
WITH a AS (SELECT s_suppkey, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey=n_nationkey UNION SELECT s_suppkey, s_suppkey%5 FROM supplier WHERE s_suppkey%9=0)
SELECT 's:' || s_suppkey AS start, count(*) AS n_draws, CASE WHEN count(*)=1 THEN 'r:' || min(r) END AS draw, CASE WHEN count(*)=1 THEN 'draw' ELSE 'ambiguous' END AS context FROM a GROUP BY s_suppkey
"""


def packet_order(spark, d):
    """A customer's orders as a review packet: the largest first, each with the set of pools it draws from."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("pools"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sized = o.join(lines, C("o_orderkey") == C("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("pools", F.lit("")).alias("pools"))
    return project.placed(sized, ["o_custkey"], [F.desc("n_items"), C("o_orderkey")])


PACKET_ORDER = """
WITH l AS (SELECT l_orderkey, count(*) AS n, (SELECT string_agg(x, ',' ) FROM (SELECT unnest(list_sort(list_distinct(list(l_suppkey)))) AS x)) AS pools FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, coalesce(n,0) AS n_items, coalesce(pools,'') AS pools, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(n,0) DESC, o_orderkey) AS INT) AS place FROM orders LEFT JOIN l ON o_orderkey=l_orderkey
"""


def annotation_issues(spark, d):
    """Orders as proposed records: their customer must be there, none may use a key that is taken, and each key comes once."""
    o = table(spark, d, "orders")
    known = table(spark, d, "customer").filter("c_custkey % 11 <> 0")
    taken = o.filter("o_orderkey % 101 = 0").join(table(spark, d, "part").select(C("p_partkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return rules.union_all([rules.dangling(o, "o_orderkey", "o_custkey", known, "c_custkey", "customer_missing"), rules.issues(taken, "error", "code_taken", C("o_orderkey"), C("o_custkey")), rules.repeated(o, ["o_orderkey"], "key_repeated")])


ANNOTATION_ISSUES = """
SELECT 'error' AS severity, 'customer_missing' AS code, CAST(o_orderkey AS VARCHAR) AS entity_key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%11<>0)
UNION ALL SELECT 'error', 'code_taken', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey%101=0 AND o_orderkey IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'error', 'key_repeated', CAST(o_orderkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderkey HAVING count(*)>1
"""


def fidelity_counters(spark, d):
    """Counters of each source of documents, and which gates they fail."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = docs.groupBy("source").agg(F.count("*").alias("n_items"), F.countDistinct(F.sha2("text", 256)).alias("n_contents"), F.count_if(C("quality").isNull()).alias("n_unlabelled"), F.count_if(C("toxic") == 1).alias("n_toxic"))
    failed = F.filter(F.array(F.when(C("n_contents") < C("n_items"), "repeated"), F.when(C("n_unlabelled") > 0, "unlabelled"), F.when(C("n_toxic") > 0, "toxic")), lambda x: x.isNotNull())
    return out.withColumn("failed", F.array_join(failed, ","))


FIDELITY = """
WITH c AS (SELECT source, count(*) AS n_items, count(DISTINCT sha256(text)) AS n_contents, count(*) FILTER (quality IS NULL) AS n_unlabelled, count(*) FILTER (toxic=1) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN n_contents<n_items THEN 'repeated' END, CASE WHEN n_unlabelled>0 THEN 'unlabelled' END, CASE WHEN n_toxic>0 THEN 'toxic' END) AS failed FROM c
"""


def kind_aliases(spark, d):
    """Kinds by any of their names; names that none has are reported as unknown."""
    known = spark.createDataFrame([("view", "SEEN"), ("click", "ACT"), ("purchase", "ACT"), ("signup", "JOIN")], "alias string, kind string")
    e = table(spark, d, "events").groupBy(F.lower(F.trim("event_type")).alias("alias")).agg(F.count("*").alias("n"))
    named = e.join(known, "alias", "left")
    kind = F.coalesce("kind", F.concat(F.lit("unknown:"), C("alias")))
    return named.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_aliases"))


KIND_ALIASES = """
SELECT CASE trim(lower(event_type)) WHEN 'view' THEN 'SEEN' WHEN 'click' THEN 'ACT' WHEN 'purchase' THEN 'ACT' WHEN 'signup' THEN 'JOIN' ELSE 'unknown:' || trim(lower(event_type)) END AS kind, count(*) AS n_rows, count(DISTINCT event_type) AS n_aliases FROM events GROUP BY 1
"""


def allow_list(spark, d):
    """Values outside an allow-list, with how often they are used."""
    allowed = spark.createDataFrame([(x,) for x in ("web", "news", "wiki", "code")], "source string")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_uses"), F.min("doc_id").alias("first_id")).join(allowed, "source", "left_anti")


ALLOW_LIST = "SELECT source, count(*) AS n_uses, min(doc_id) AS first_id FROM documents WHERE source IS NULL OR source NOT IN ('web','news','wiki','code') GROUP BY 1"


def numbered_turns(spark, d):
    """The turns of a conversation as one numbered text, by role and length."""
    turn = F.struct("turn", "role", F.length("text").alias("n"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x.role, F.lit("?")), F.lit(" "), F.coalesce(x.n, F.lit(0)).cast("string"))), " | ").alias("numbered"))


NUMBERED_TURNS = """
WITH c AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, length(text) NULLS FIRST) AS i FROM conversations)
SELECT conv_id, string_agg(i || '. ' || coalesce(role,'?') || ' ' || coalesce(n,0), ' | ' ORDER BY i) AS numbered FROM c GROUP BY 1
"""


def queue_summary(spark, d):
    """How many documents are in each queue, in one, and in several."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    lanes = project.lanes(docs, "doc_id", {"unlabelled": C("quality").isNull(), "toxic": C("toxic") == 1, "poor": C("quality") == 0, "long": C("n_chars") > 5000})
    many = lanes.groupBy("doc_id").agg(F.count("*").alias("n"))
    return lanes.join(many, "doc_id").groupBy("lane").agg(F.count("*").alias("n_items"), F.count_if(C("n") > 1).alias("n_shared"), F.min("doc_id").alias("first_id"))


QUEUE_SUMMARY = """
WITH d AS (SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT doc_id, 'unlabelled' AS lane FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic=1 UNION ALL SELECT doc_id, 'poor' FROM d WHERE quality=0 UNION ALL SELECT doc_id, 'long' FROM d WHERE n_chars>5000)
SELECT lane, count(*) AS n_items, count(*) FILTER (n>1) AS n_shared, min(doc_id) AS first_id FROM l JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) USING (doc_id) GROUP BY 1
"""


_ALL = {
    "assign_codes": (assign_codes, ASSIGN_CODES), "content_digest": (content_digest, CONTENT_DIGEST), "variant_gate": (variant_gate, VARIANT_GATE), "observation_digests": (observation_digests, OBSERVATION_DIGESTS),
    "unique_identities": (unique_identities, UNIQUE_IDENTITIES), "alias_conflicts": (alias_conflicts, ALIAS_CONFLICTS), "selection_context": (selection_context, SELECTION_CONTEXT), "packet_order": (packet_order, PACKET_ORDER),
    "annotation_issues": (annotation_issues, ANNOTATION_ISSUES), "fidelity_counters": (fidelity_counters, FIDELITY), "kind_aliases": (kind_aliases, KIND_ALIASES), "allow_list_violations": (allow_list, ALLOW_LIST),
    "numbered_turns": (numbered_turns, NUMBERED_TURNS), "queue_summary": (queue_summary, QUEUE_SUMMARY),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
