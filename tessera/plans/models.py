"""Alias classes, typed paths, nested views, tree keys, strict JSON and typed payloads, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import records
from tessera.operators import documents, graph, identity, payloads, project
from tessera.sources import settings
from tessera.sources.tables import table

C = F.col


def _aliased(spark, d):
    docs = table(spark, d, "documents")
    shape = F.concat_ws("/", "source", "lang", C("n_chars").cast("string"))
    return docs, {"text": F.when(C("text") != "", F.sha2("text", 256)), "shape": shape}


def alias_classes(spark, d):
    """Documents that share a text, or source, language and length, are one entity, whichever way round."""
    docs, aliases = _aliased(spark, d)
    return identity.alias_classes(docs, "doc_id", aliases)


_ALIASES = """
WITH RECURSIVE a AS (
  SELECT doc_id AS k, 0 AS rank, 'text' AS ns, sha256(text) AS value FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, 1, 'shape', concat_ws('/', source, lang, CAST(n_chars AS VARCHAR)) FROM documents
), e AS (SELECT DISTINCT a.k, b.k AS o FROM a JOIN a b USING (ns, value)), r AS (SELECT k, o FROM e UNION SELECT r.k, e.o FROM r JOIN e ON r.o = e.k),
c AS (SELECT doc_id AS k, coalesce(min(o), doc_id) AS entity FROM documents LEFT JOIN r ON k = doc_id GROUP BY doc_id)
"""
ALIAS_CLASSES = (
    _ALIASES
    + """, n AS (SELECT entity, count(DISTINCT ns || '/' || value) AS n FROM a JOIN c USING (k) GROUP BY 1),
b AS (SELECT k, arg_min(ns, rank) AS ns FROM a JOIN (SELECT ns, value FROM a GROUP BY 1, 2 HAVING count(DISTINCT k) > 1) USING (ns, value) GROUP BY 1)
SELECT c.k AS doc_id, entity, coalesce(n, 0) AS n_aliases, coalesce(ns, 'own') AS basis FROM c LEFT JOIN n USING (entity) LEFT JOIN b USING (k)
"""
)


def alias_class_conflicts(spark, d):
    """Entities of documents that several sources claim."""
    docs, aliases = _aliased(spark, d)
    return identity.alias_conflicts(docs, "doc_id", aliases, C("source"))


ALIAS_CLASS_CONFLICTS = (
    _ALIASES
    + """, i AS (SELECT doc_id AS k, source FROM documents WHERE source IS NOT NULL),
s AS (SELECT DISTINCT entity, ns FROM (SELECT ns, value, min(k) AS k FROM a JOIN i USING (k) GROUP BY 1, 2 HAVING count(DISTINCT source) > 1) JOIN c USING (k))
SELECT entity, count(*) AS n_rows, count(DISTINCT source) AS n_identities, array_to_string(list_sort(list(DISTINCT source))[1:5], ',') AS identities,
       coalesce((SELECT string_agg(ns, ',' ORDER BY ns) FROM s WHERE s.entity = c.entity), '') AS namespaces
FROM c LEFT JOIN i USING (k) GROUP BY entity HAVING count(DISTINCT source) > 1
"""
)


def _network(spark, d):
    def named(t, key, letter, kind):
        return table(spark, d, t).select(F.concat(F.lit(letter), C(key).cast("string")).alias("node"), F.lit(kind).alias("kind"))

    c, o, s, n = (F.concat(F.lit(x), C(k).cast("string")) for x, k in (("c", "o_custkey"), ("o", "o_orderkey"), ("s", "s_suppkey"), ("n", "s_nationkey")))
    shipped = table(spark, d, "lineitem").select(F.lit("shipped"), F.concat(F.lit("o"), C("l_orderkey").cast("string")), F.concat(F.lit("s"), C("l_suppkey").cast("string")))
    edges = table(spark, d, "orders").select(F.lit("placed").alias("kind"), o.alias("src"), c.alias("dst")).union(shipped).union(table(spark, d, "supplier").select(F.lit("based"), s, n))
    customers = named("customer", "c_custkey", "c", "customer")
    nodes = customers.union(named("orders", "o_orderkey", "o", "order")).union(named("supplier", "s_suppkey", "s", "supplier")).union(named("nation", "n_nationkey", "n", "nation"))
    hops = [graph.Hop("placed", ("order",), against=True), graph.Hop("shipped", ("supplier",), 1, 4), graph.Hop("based", ("nation",), 1, 1, once=True)]
    return graph.typed_paths(nodes, edges, customers.select("node"), hops)


def typed_paths(spark, d):
    """From customers by their orders and the suppliers of these to nations: how many ways lead from each customer to each nation."""
    return _network(spark, d)[0].groupBy(C("h0").alias("customer"), C("h3").alias("nation")).agg(F.count("*").alias("n_paths"))


TYPED_PATHS = """
SELECT 'c' || o_custkey AS customer, 'n' || s_nationkey AS nation, count(*) AS n_paths FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
"""


def path_violations(spark, d):
    """What speaks against these ways: customers without orders, orders of no or of more than four suppliers, nations of several suppliers."""
    return _network(spark, d)[1]


PATH_VIOLATIONS = """
WITH o AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey), l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN o ON l_orderkey = o_orderkey),
n AS (SELECT o_orderkey, count(s_suppkey) AS n, count(l_suppkey) - count(s_suppkey) AS gone FROM o LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
s AS (SELECT DISTINCT s_suppkey, s_nationkey FROM l JOIN supplier ON s_suppkey = l_suppkey)
SELECT 1 AS hop, 'c' || c_custkey AS node, 'too_few' AS code, 0 AS n FROM customer ANTI JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 2, 'o' || o_orderkey, 'too_few', 0 FROM n WHERE n = 0 UNION ALL SELECT 2, 'o' || o_orderkey, 'too_many', n FROM n WHERE n > 4 UNION ALL SELECT 2, 'o' || o_orderkey, 'dangling', gone FROM n WHERE gone > 0
UNION ALL SELECT 3, 's' || s_suppkey, code, n FROM s LEFT JOIN nation ON n_nationkey = s_nationkey, (SELECT unnest(['too_few', 'dangling']) AS code, unnest([0, 1]) AS n) WHERE n_nationkey IS NULL
UNION ALL SELECT 3, 'n' || s_nationkey, 'shared', count(*) FROM s JOIN nation ON n_nationkey = s_nationkey GROUP BY 2 HAVING count(*) > 1
"""


def linked_views(spark, d):
    """Customers with their orders inside, ten orders a part, in order of date."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    view, _ = project.linked_views(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", [C("o_orderdate"), C("o_orderkey")], ["o_orderkey", "o_orderstatus"], 10)
    listed = F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " ")
    return view.select("c_custkey", "c_name", "part", "n_rows", F.coalesce(listed, F.lit("")).alias("orders"))


LINKED_VIEWS = """
WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 10 AS part FROM orders)
SELECT c_custkey, c_name, coalesce(part, 0) AS part, count(o_orderkey) AS n_rows, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderdate, o_orderkey), '') AS orders
FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL
"""


def view_issues(spark, d):
    """Documents against their labels: labels of no document, documents without one."""
    return project.linked_views(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", [C("quality")], ["toxic"])[1]


VIEW_ISSUES = """
WITH d AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, 'orphaned' AS code, n FROM l ANTI JOIN d USING (doc_id) UNION ALL SELECT doc_id, 'unplaced', n FROM d ANTI JOIN l USING (doc_id) UNION ALL SELECT doc_id, 'repeated', n FROM d WHERE n > 1
"""


def tree_keys(spark, d):
    """Regions, nations and suppliers as trees: every node's key, from its identifier or from its place, kind and title."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.lit("supplier").alias("kind"), C("s_name").alias("title"), F.concat(F.lit("S"), C("s_suppkey").cast("string")).alias("identifier")))).alias("children"))
    n = table(spark, d, "nation").join(s, C("n_nationkey") == C("s_nationkey"), "left")
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lit("nation").alias("kind"), C("n_name").alias("title"), "children"))).alias("children"))
    r = table(spark, d, "region").join(n, C("r_regionkey") == C("n_regionkey"), "left")
    tree = F.array(F.struct(F.lit("region").alias("kind"), C("r_name").alias("href"), "children"), F.lit(None))
    return documents.tree_keys(r.select("r_regionkey", F.parse_json(F.to_json(tree)).alias("tree")), "r_regionkey", "tree")


TREE_KEYS = """
WITH s AS (SELECT n_regionkey AS r, n_nationkey AS n, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT n_regionkey AS r, n_nationkey AS n, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM nation),
t AS (
  SELECT r_regionkey, '0' AS path, 0 AS depth, 'region' AS kind, '' AS title, 'href' AS basis, r_name AS alias, CAST(NULL AS VARCHAR) AS above FROM region
  UNION ALL SELECT r, '0/' || place, 1, 'nation', n_name, 'path', '0/' || place || '|nation|' || n_name, '0' FROM m
  UNION ALL SELECT s.r, '0/' || m.place || '/' || s.place, 2, 'supplier', s_name, 'identifier', 'S' || s_suppkey, '0/' || m.place FROM s JOIN m USING (n)
), k AS (SELECT *, substr(sha256(to_json([CAST(r_regionkey AS VARCHAR), 'structure:' || kind, basis, alias])), 1, 24) AS entity_key FROM t)
SELECT k.r_regionkey, k.path, k.depth, k.kind, k.title, k.basis, k.alias, k.entity_key, p.entity_key AS parent_key FROM k LEFT JOIN k AS p ON p.r_regionkey = k.r_regionkey AND p.path = k.above
"""


def strict_json(spark, d):
    """Events as JSON documents, read strictly: leaves as written, or where a key stands for the second time."""
    body = F.concat(F.lit('{"click": '), "props", F.lit(', "'), "event_type", F.lit('": ['), C("value").cast("decimal(18,2)").cast("string"), F.lit(", "), C("user_id").cast("string"), F.lit("]}"))
    read = documents.strict(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body")
    return read.select("event_id", "fault", "at", F.explode_outer("leaves").alias("l")).select("event_id", "fault", "at", "l.path", "l.kind", "l.lexeme")


STRICT_JSON = r"""
WITH b AS (SELECT event_id, event_type AS t, '{"click": ' || props || ', "' || event_type || '": [' || CAST(value AS DECIMAL(18,2)) || ', ' || user_id || ']}' AS body FROM events),
f AS (SELECT *, regexp_extract_all(body, '"([a-z]+)": ', 1) AS keys FROM b), g AS (SELECT *, len(list_distinct(keys)) < len(keys) AS twice FROM f)
SELECT event_id, 'repeated_key' AS fault, length(body) - strpos(reverse(body), reverse('"' || t || '": ')) - length('"' || t || '": ') + 1 AS "at", NULL AS path, NULL AS kind, NULL AS lexeme FROM g WHERE twice
UNION ALL SELECT event_id, NULL, NULL, p[1], 'number', regexp_extract(body, p[2], 1)
FROM (SELECT *, unnest([['$.click.k', '"k": ([0-9]+)}'], ['$.' || t || '[0]', '\[([^,]+),'], ['$.' || t || '[1]', ', ([0-9]+)\]']]) AS p FROM g WHERE NOT twice)
"""


def typed_payloads(spark, d):
    """Parts as questions of six kinds: their typed payload, and what their kind misses."""
    p = table(spark, d, "part")
    kind = F.coalesce(*[F.when(C("p_type") == t, k) for t, k in _KINDS.items()], F.lower("p_type"))
    answers = F.when(kind == "matching", F.replace("p_name", F.lit(" "), F.lit(" -> "))).when(kind == "ordering", F.replace("p_name", F.lit(" "), F.lit(" || "))).otherwise(F.when(C("p_size") > 10, F.split_part("p_name", F.lit(" "), F.lit(1))))
    rows = p.select("p_partkey", kind.alias("kind"), F.replace("p_name", F.lit(" "), F.lit(" || ")).alias("choices"), answers.alias("answers"), F.when(C("p_size") > 25, F.concat("p_brand", F.lit(": "), "p_name")).alias("blanks"))
    out = payloads.typed(rows, "kind", "choices", "answers", "blanks", "p_partkey")
    return out.select("p_partkey", "kind", F.to_json("payload").alias("payload"), F.array_join("shape_issues", ",").alias("shape_issues"))


_KINDS = {"ECONOMY": "multiple_choice", "STANDARD": "multi_select", "PROMO": "matching", "SMALL": "ordering", "MEDIUM": "short_answer", "LARGE": "fill_in_blanks"}
TYPED_PAYLOADS = """
WITH q AS (
  SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'multiple_choice' WHEN 'STANDARD' THEN 'multi_select' WHEN 'PROMO' THEN 'matching' WHEN 'SMALL' THEN 'ordering' WHEN 'MEDIUM' THEN 'short_answer' WHEN 'LARGE' THEN 'fill_in_blanks' ELSE lower(p_type) END AS kind,
         string_split(p_name, ' ') AS w, p_name, p_size, p_brand FROM part
), a AS (SELECT *, CASE WHEN kind = 'matching' THEN [replace(p_name, ' ', ' -> ')] WHEN kind = 'ordering' THEN w WHEN p_size > 10 THEN [w[1]] ELSE [] END AS answers FROM q),
b AS (
  SELECT *, list_transform(w, lambda x, i: {'content': x, 'correct': list_contains(answers, x), 'option_key': chr(CAST(64 + i AS INTEGER))}) AS options,
         CASE WHEN kind IN ('short_answer', 'fill_in_blanks') THEN list_transform(answers, lambda x: {'value': x}) ELSE [] END AS accepted,
         CASE WHEN p_size > 25 THEN [{'answer': p_name, 'blank_key': 'blank-1'}] ELSE [] END AS blanks,
         CASE WHEN kind = 'matching' AND len(w) > 1 THEN [{'left_key': w[1], 'right_key': array_to_string(w[2:], ' -> ')}] ELSE [] END AS pairs,
         CASE WHEN kind = 'ordering' THEN list_transform(w, lambda x, i: {'option_key': x, 'position': i}) ELSE [] END AS placed FROM a
), c AS (SELECT *, len(list_filter(options, lambda x: x.correct)) AS n FROM b)
SELECT p_partkey, kind, CAST(to_json({'accepted_responses': accepted, 'blanks': blanks, 'correct_order': placed, 'match_pairs': pairs, 'options': options}) AS VARCHAR) AS payload,
  array_to_string(list_sort(list_filter([
    CASE WHEN kind IN ('multiple_choice') AND n <> 1 THEN 'one_correct_missing' END, CASE WHEN kind = 'multi_select' AND n = 0 THEN 'some_correct_missing' END, CASE WHEN kind = 'short_answer' AND len(accepted) = 0 THEN 'accepted_responses_missing' END,
    CASE WHEN kind = 'fill_in_blanks' AND len(blanks) = 0 THEN 'blanks_missing' END, CASE WHEN kind = 'matching' AND len(pairs) = 0 THEN 'match_pairs_missing' END, CASE WHEN kind = 'matching' AND len(pairs) < len(answers) THEN 'pair_without_mark' END,
    CASE WHEN kind NOT IN ('multiple_choice', 'multi_select', 'matching', 'ordering', 'short_answer', 'fill_in_blanks') THEN 'unknown_kind' END], lambda x: x IS NOT NULL)), ',') AS shape_issues
FROM c
"""

def _settings(spark, d):
    names = F.create_map(*[F.lit(x) for pair in {"click": "attempts_allowed", "view": "time_limit", "error": "show_clock", "signup": "randomize_answers"}.items() for x in pair])
    setting = F.coalesce(F.element_at(names, C("event_type")), C("event_type"))
    target = F.when(C("value") > 20, F.concat(F.lit("question-"), (C("event_id") % 50).cast("string"))).otherwise(C("user_id").cast("string"))
    value = F.when(setting.isin("show_clock", "randomize_answers"), F.when(C("value") > 15, "Yes").otherwise(C("props"))).otherwise(F.get_json_object("props", "$.k"))
    state = F.when(C("value") > 1, "known").otherwise("unresolved")
    rows = table(spark, d, "events").select(C("user_id").cast("string").alias("quiz"), target.alias("target"), setting.alias("setting"), state.alias("state"), value.alias("value"), C("event_id").alias("place"))
    quizzes = table(spark, d, "customer").filter(C("c_mktsegment") != "MACHINERY").select(C("c_custkey").cast("string").alias("quiz"))
    return settings.effective(rows, settings.QUIZ_DEFAULTS, quizzes, settings.QUESTION_SETTINGS)


def settings_in_force(spark, d):
    """Settings of customers as quizzes: defaults, and over them the last that users' events set at their scope."""
    return _settings(spark, d)[0]


_RESOLUTIONS = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS quiz, CASE WHEN value > 20 THEN 'question-' || (event_id % 50) ELSE CAST(user_id AS VARCHAR) END AS target, event_id AS place, props, value AS v,
         CASE event_type WHEN 'click' THEN 'attempts_allowed' WHEN 'view' THEN 'time_limit' WHEN 'error' THEN 'show_clock' WHEN 'signup' THEN 'randomize_answers' ELSE event_type END AS setting FROM events WHERE value > 1
), r AS (SELECT *, CASE WHEN setting IN ('show_clock', 'randomize_answers') THEN CASE WHEN v > 15 THEN 'Yes' ELSE props END ELSE json_extract_string(props, '$.k') END AS value FROM e),
q AS (SELECT CAST(c_custkey AS VARCHAR) AS quiz FROM customer WHERE c_mktsegment <> 'MACHINERY'),
d AS (SELECT unnest(['is_active', 'attempts_allowed', 'time_limit', 'show_clock', 'enforce_time_limit', 'is_forward_only']) AS setting, unnest(['false', '1', '0', 'false', 'false', 'false']) AS value),
c AS (
  SELECT r.*, q.quiz IS NULL AS lost, CASE WHEN target = r.quiz THEN setting IN (SELECT setting FROM d) ELSE setting = 'randomize_answers' END AS fits,
    CASE WHEN setting IN ('show_clock', 'randomize_answers') THEN CASE WHEN lower(trim(value)) IN ('true', 'yes', '1') THEN 'true' WHEN lower(trim(value)) IN ('false', 'no', '0') THEN 'false' END
         WHEN setting = 'attempts_allowed' THEN CASE WHEN TRY_CAST(value AS INTEGER) >= 1 THEN CAST(TRY_CAST(value AS INTEGER) AS VARCHAR) END WHEN setting = 'time_limit' THEN CAST(TRY_CAST(value AS INTEGER) AS VARCHAR) END AS coerced
  FROM r LEFT JOIN q USING (quiz)
)
"""
SETTINGS_IN_FORCE = (
    _RESOLUTIONS
    + """, a AS (SELECT quiz, target, setting, arg_max(coerced, place) AS value FROM c WHERE NOT lost AND fits AND coerced IS NOT NULL GROUP BY ALL)
SELECT quiz, target, setting, value, 'receipt' AS origin FROM a
UNION ALL SELECT q.quiz, q.quiz, d.setting, d.value, 'default' FROM q, d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.quiz = q.quiz AND a.target = q.quiz AND a.setting = d.setting)
"""
)


def settings_issues(spark, d):
    """Why users' settings do not hold: no such quiz, the wrong scope, or a value that is none of their kind."""
    return _settings(spark, d)[1]


SETTINGS_ISSUES = (
    _RESOLUTIONS
    + """SELECT DISTINCT quiz, target, setting, CASE WHEN lost THEN 'unknown_quiz' WHEN NOT fits THEN CASE WHEN target = quiz THEN 'quiz_scope' ELSE 'question_scope' END ELSE 'value' END AS code
FROM c WHERE lost OR NOT fits OR coerced IS NULL
"""
)

def withheld_references(spark, d):
    """Addresses of pages, and the same paths as local files would have them, as they may be shown."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    refs = F.array(C("url"), path, F.concat(F.lit("file:///srv/"), path), F.concat(F.lit("/srv/"), path, F.lit("/")), F.concat(F.lit("C:\\srv\\"), F.replace(path, F.lit("/"), F.lit("\\"))))
    return table(spark, d, "pages").select("page_id", F.posexplode(refs).alias("place", "ref")).select("page_id", "place", records.local_reference(C("ref")).alias("shown"))


WITHHELD_REFERENCES = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
r AS (SELECT page_id, unnest([url, path, 'file:///srv/' || path, '/srv/' || path || '/', 'C:\srv\' || replace(path, '/', '\')]) AS ref, unnest([0, 1, 2, 3, 4]) AS place FROM p)
SELECT page_id, place, CASE WHEN place < 2 THEN ref ELSE '[absolute local path withheld]/' || list_last(string_split(rtrim(regexp_replace(CASE place WHEN 2 THEN regexp_replace(ref, '[?#].*$', '') ELSE replace(ref, '\', '/') END, '/+$', ''), ''), '/')) END AS shown FROM r
"""


def variant_fidelity(spark, d):
    """Orders as questions, their lines as raw rows: how many different payloads the rows of one producer have."""
    payload = F.create_map(F.lit("part"), (C("l_partkey") % 3).cast("string"), F.lit("flag"), C("l_returnflag"), F.lit("absolute_path"), C("l_linenumber").cast("string"))
    model = F.struct(F.concat_ws(":", "l_linestatus", "l_returnflag").alias("source_kind"), payload.alias("payload"))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(model).alias("models")).withColumn("p", records.canonical_payloads(C("models"), "F:"))
    return orders.select("l_orderkey", F.size("p").alias("n_payloads"), records.fidelity(C("p")).alias("f")).select("l_orderkey", "n_payloads", "f.*")


VARIANT_FIDELITY = """
SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS n_payloads, count(DISTINCT (l_partkey % 3) || l_returnflag) FILTER (l_linestatus = 'F') AS authored_variant_count,
       count(DISTINCT (l_partkey % 3) || l_returnflag) FILTER (l_linestatus = 'F') > 1 AS variant_conflict FROM lineitem GROUP BY 1
"""


def feedback_texts(spark, d):
    """Orders' lines as feedback by their flag; lines of one flag have no channel, some say nothing."""
    entry = F.struct("l_linenumber", F.nullif(C("l_returnflag"), F.lit("R")).alias("channel"), F.when(C("l_quantity") > 10, F.concat_ws("-", C("l_partkey").cast("string"), "l_linestatus")).alias("content"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("f")).select("l_orderkey", records.feedback_text(C("f")).alias("feedback"))


FEEDBACK_TEXTS = """
SELECT l_orderkey, coalesce(string_agg(CASE l_returnflag WHEN 'R' THEN 'feedback' ELSE l_returnflag END || ': ' || l_partkey || '-' || l_linestatus, chr(10) ORDER BY l_linenumber, nullif(l_returnflag, 'R') NULLS FIRST, l_partkey || '-' || l_linestatus) FILTER (l_quantity > 10), '') AS feedback
FROM lineitem GROUP BY 1
"""

_ALL = {
    "alias_classes": (alias_classes, ALIAS_CLASSES), "alias_class_conflicts": (alias_class_conflicts, ALIAS_CLASS_CONFLICTS), "typed_paths": (typed_paths, TYPED_PATHS), "path_violations": (path_violations, PATH_VIOLATIONS),
    "linked_views": (linked_views, LINKED_VIEWS), "view_issues": (view_issues, VIEW_ISSUES), "tree_keys": (tree_keys, TREE_KEYS), "strict_json": (strict_json, STRICT_JSON), "typed_payloads": (typed_payloads, TYPED_PAYLOADS),
    "settings_in_force": (settings_in_force, SETTINGS_IN_FORCE), "settings_issues": (settings_issues, SETTINGS_ISSUES),
    "withheld_references": (withheld_references, WITHHELD_REFERENCES), "variant_fidelity": (variant_fidelity, VARIANT_FIDELITY), "feedback_texts": (feedback_texts, FEEDBACK_TEXTS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
