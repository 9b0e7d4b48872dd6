"""Queries over reviewers' labels, states and intake values, each on the table with the shape of its role."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels, text
from tessera.operators import rollup, rules
from tessera.sources.tables import table

C = F.col
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_LEVELS = ("source_evidence", "inferred_exact", "inferred_similarity", "unmatched", "other")


def _level(key):
    return F.element_at(F.array(*map(F.lit, _LEVELS)), (key % 5 + 1).cast("int"))


_LEVEL_SQL = "(['source_evidence','inferred_exact','inferred_similarity','unmatched','other'])[{k}%5+1]"


def reviewer_labels(spark, d):
    """Orders as questions: link label, match status, section label and note."""
    o = table(spark, d, "orders").withColumn("level", _level(C("o_orderkey")))
    status = F.when(C("o_orderstatus") == "P", "ambiguous").otherwise("resolved")
    title = F.when(C("o_orderkey") % 7 == 0, labels.ROOT_SECTION).otherwise(C("o_orderpriority"))
    match_note = F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit(labels.SHARED_CONTENT), F.lit("."))).when(C("o_orderkey") % 3 == 1, C("o_orderpriority"))
    missing = F.when(C("o_orderkey") % 11 == 0, F.concat(F.lit("img"), C("o_custkey").cast("string")))
    return o.select("o_orderkey", labels.link_label(C("level")).alias("link_label"), labels.match_status(C("level"), status).alias("match_status"), labels.section_label(title).alias("section"), labels.note(C("level"), match_note, missing).alias("note"))


REVIEWER_LABELS = f"""
WITH o AS (SELECT *, {_LEVEL_SQL.format(k="o_orderkey")} AS level, CASE WHEN o_orderkey%3=0 THEN 'shared' WHEN o_orderkey%3=1 THEN o_orderpriority ELSE '' END AS m FROM orders)
SELECT o_orderkey, CASE level WHEN 'source_evidence' THEN 'Direct library link' WHEN 'inferred_exact' THEN 'Linked by identical content' WHEN 'inferred_similarity' THEN 'Possible link based on similar content' WHEN 'unmatched' THEN 'No reliable library link found' ELSE level END AS link_label,
 CASE WHEN o_orderstatus='P' THEN 'ambiguous' WHEN level='source_evidence' THEN 'direct' WHEN level='unmatched' THEN 'unresolved' WHEN level='other' THEN 'unknown' ELSE level END AS match_status,
 CASE WHEN o_orderkey%7=0 THEN '' ELSE o_orderpriority END AS section,
 concat_ws(' ', CASE WHEN level='unmatched' THEN 'No safe question-library location was found automatically.' WHEN level='inferred_similarity' THEN 'The content matched strongly, but not by a direct library link.'
  WHEN m='shared' THEN 'This question matched one question-library location, but more than one library item in that location shares the same content.' WHEN m<>'' THEN m END, CASE WHEN o_orderkey%11=0 THEN 'Missing image refs: img' || o_custkey END) AS note FROM o
"""


def library_locations(spark, d):
    """Suppliers as pools in nations as banks."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), C("s_nationkey") == C("n_nationkey"))
    ident = F.when(C("s_suppkey") % 5 > 0, C("s_suppkey"))
    bank = F.when(C("s_suppkey") % 4 == 0, labels.ROOT_BANK).when(C("s_suppkey") % 4 < 3, C("n_name"))
    pool = F.when(C("s_suppkey") % 4 == 1, C("n_name")).when(C("s_suppkey") % 4 > 1, C("s_name"))
    return s.select("s_suppkey", labels.library_location(ident, bank, pool).alias("location"))


LIBRARY_LOCATIONS = """
SELECT s_suppkey, CASE WHEN s_suppkey%5=0 THEN '' ELSE CASE s_suppkey%4 WHEN 0 THEN 'Question Library root-level items' WHEN 1 THEN n_name WHEN 2 THEN n_name || ' > ' || s_name ELSE s_name END END AS location FROM supplier JOIN nation ON s_nationkey=n_nationkey
"""


def response_blocks(spark, d):
    """Orders as questions whose lines are options: the block of text that shows them."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x).alias("l"))
    kind = F.element_at(F.array(*map(F.lit, ("Matching", "Ordering", "Multiple Choice"))), (C("l_orderkey") % 3 + 1).cast("int"))
    said = F.transform("l", lambda x: F.concat(F.lit("part "), x.l_partkey.cast("string")))
    prompts, options = F.filter(said, lambda x, i: i % 2 == 0), F.filter(said, lambda x, i: i % 2 == 1)
    return lines.select("l_orderkey", labels.response_options(kind, said, prompts, options).alias("shown"))


RESPONSE_BLOCKS = r"""
WITH l AS (SELECT l_orderkey, list('part ' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS s FROM lineitem GROUP BY 1),
p AS (SELECT *, [s[i] FOR i IN range(1, len(s)+1) IF i%2=1] AS a, [s[i] FOR i IN range(1, len(s)+1) IF i%2=0] AS b FROM l)
SELECT l_orderkey, CASE l_orderkey%3 WHEN 0 THEN concat_ws(chr(10) || chr(10), CASE WHEN len(a)>0 THEN 'Prompt set:' || chr(10) || array_to_string(['- ' || x FOR x IN a], chr(10)) END, CASE WHEN len(b)>0 THEN 'Match options:' || chr(10) || array_to_string(['- ' || x FOR x IN b], chr(10)) END)
 WHEN 1 THEN 'Items to order:' || chr(10) || array_to_string(['- ' || x FOR x IN s], chr(10)) ELSE array_to_string(s, chr(10)) END AS shown FROM p
"""


def feedback_lines(spark, d):
    """Order columns as feedback channels on lines."""
    o = table(spark, d, "orders")
    shown = labels.feedback_lines(C("o_orderpriority"), F.when(C("o_orderstatus") == "F", C("o_orderstatus")), F.lit("  "), F.when(C("o_orderkey") % 2 == 0, C("o_custkey").cast("string")), F.lit(None).cast("string"))
    return o.select("o_orderkey", shown.alias("feedback"))


FEEDBACK_LINES = "SELECT o_orderkey, concat_ws(chr(10), 'General: ' || trim(o_orderpriority), CASE WHEN o_orderstatus='F' THEN 'Correct: F' END, CASE WHEN o_orderkey%2=0 THEN 'Answer-specific: ' || o_custkey END) AS feedback FROM orders"


def quiz_locations(spark, d):
    """Where each part is used: distinct quiz / section / item places, in order, and how many."""
    li = table(spark, d, "lineitem")
    path = F.when(C("l_orderkey") % 9 == 0, labels.ROOT_SECTION).otherwise(C("l_returnflag"))
    place = labels.location(F.concat(F.lit("quiz "), (C("l_orderkey") % 50).cast("string")), path, F.when(C("l_orderkey") % 4 > 0, C("l_linenumber")))
    found = li.select("l_partkey", place.alias("place")).distinct()
    return found.groupBy("l_partkey").agg(F.count("*").alias("n_places"), F.min("place").alias("first_place"), F.sha2(F.array_join(F.array_sort(F.collect_list("place")), "\n"), 256).alias("places"))


QUIZ_LOCATIONS = """
WITH p AS (SELECT DISTINCT l_partkey, concat_ws(' / ', 'quiz ' || (l_orderkey%50), CASE WHEN l_orderkey%9=0 THEN 'quiz root' ELSE l_returnflag END, CASE WHEN l_orderkey%4>0 THEN 'item ' || l_linenumber END) AS place FROM lineitem)
SELECT l_partkey, count(*) AS n_places, min(place) AS first_place, sha256(string_agg(place, chr(10) ORDER BY place)) AS places FROM p GROUP BY 1
"""


def image_states(spark, d):
    """Orders with their lines as image references: resolved where returned, included where not open."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[F.collect_list(F.when(t, C("l_partkey").cast("string"))).alias(n) for n, t in (("refs", C("l_linenumber") > 1), ("resolved", (C("l_linenumber") > 1) & (C("l_returnflag") == "R")), ("missing", (C("l_linenumber") > 1) & (C("l_returnflag") == "A")), ("included", (C("l_linenumber") > 1) & (C("l_suppkey") % 2 == 0)))]
    )
    given = F.when(C("l_orderkey") % 6 == 0, F.size("refs") + 1)
    return lines.select("l_orderkey", *labels.image_states(given, C("refs"), C("resolved"), C("missing"), C("included")))


IMAGE_STATES = """
WITH g AS (SELECT l_orderkey, count(*) FILTER (l_linenumber>1) AS n, count(*) FILTER (l_linenumber>1 AND l_returnflag='R') AS r, count(*) FILTER (l_linenumber>1 AND l_returnflag='A') AS m, count(*) FILTER (l_linenumber>1 AND l_suppkey%2=0) AS i FROM lineitem GROUP BY 1),
k AS (SELECT *, CASE WHEN l_orderkey%6=0 THEN n+1 ELSE n END AS x FROM g)
SELECT l_orderkey, CAST(x AS BIGINT) AS n_images, CASE WHEN x=0 THEN 'none' WHEN m>0 AND r>0 THEN 'partially resolved' WHEN m>0 THEN 'missing' ELSE 'resolved' END AS image_status, CASE WHEN x=0 THEN 'none' WHEN i=0 THEN 'no' WHEN i<x THEN 'partially' ELSE 'yes' END AS image_included FROM k
"""


def display_titles(spark, d):
    """Section titles from parts, and previews of whole documents' texts."""
    p = table(spark, d, "part").withColumn("t", F.when(C("p_partkey") % 5 == 0, " Section ").when(C("p_partkey") % 5 < 4, C("p_name")))
    titles = p.select(F.concat(F.lit("p"), C("p_partkey").cast("string")).alias("key"), labels.section_title(C("t"), F.when(C("p_partkey") % 3 > 0, C("p_partkey") % 3)).alias("title"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("key"), labels.preview(F.regexp_replace("text", r"[^\x20-\x7e]", " ")).alias("title"))
    return titles.unionByName(docs)


DISPLAY_TITLES = r"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey%5 IN (0,4) THEN '' ELSE trim(regexp_replace(p_name,'\s+',' ','g')) END AS t, CASE WHEN p_partkey%3>0 THEN p_partkey%3 END AS n FROM part),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text,'[^\x20-\x7e]',' ','g'),'<[^>]*>',' ','g'),'\s+',' ','g')) AS l FROM documents)
SELECT 'p' || p_partkey AS key, CASE WHEN t='' AND n IS NULL THEN 'Unsectioned questions' WHEN t='' THEN 'Section ' || n WHEN n IS NULL THEN t ELSE 'Section ' || n || ' · ' || t END AS title FROM p
UNION ALL SELECT 'd' || doc_id, CASE WHEN l='' THEN 'Question detail' WHEN length(l)>96 THEN rtrim(substr(l,1,93)) || '…' ELSE l END FROM d
"""


def points_shown(spark, d):
    """Points of a part as shown: what its placements say, else the price."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_partkey").agg(F.array_sort(F.collect_set(labels.plain_decimal(F.round(C("l_tax") * 100, 0).cast("decimal(10,2)")))).alias("o"))
    p = table(spark, d, "part").join(li, C("p_partkey") == C("l_partkey"), "left")
    most = F.when(C("p_partkey") % 4 > 0, F.round(C("p_retailprice"), 1).cast("decimal(12,2)"))
    return p.select("p_partkey", labels.points(F.coalesce("o", F.array().cast("array<string>")), most).alias("points"))


POINTS_SHOWN = r"""
WITH o AS (SELECT l_partkey, list(DISTINCT CAST(CAST(round(l_tax*100) AS INT) AS VARCHAR) ORDER BY CAST(CAST(round(l_tax*100) AS INT) AS VARCHAR)) AS o FROM lineitem WHERE l_linenumber<=2 GROUP BY 1)
SELECT p_partkey, CASE WHEN len(o)>1 THEN array_to_string(o,' / ') || ' (varies by placement)' WHEN p_partkey%4>0 THEN regexp_replace(regexp_replace(CAST(CAST(round(p_retailprice,1) AS DECIMAL(12,2)) AS VARCHAR),'(\.[0-9]*?)0+$','\1'),'\.$','') ELSE 'not recorded' END AS points FROM part LEFT JOIN o ON p_partkey=l_partkey
"""


def safe_names(spark, d):
    """Headers, identifiers, bank ids and lasting UUIDs of parts."""
    p = table(spark, d, "part")
    code = F.when(C("p_partkey") % 2 == 0, C("p_type"))
    return p.select("p_partkey", labels.header(C("p_type")).alias("header"), labels.safe_ident(F.concat(F.when(C("p_partkey") % 3 == 0, F.lit("7 ")).otherwise(F.lit(" ")), C("p_name")), "Q").alias("ident"), labels.bank_id(code, F.concat(F.lit("key:pool:"), C("p_name")), C("p_partkey")).alias("bank"), labels.named_uuid(NAMESPACE, C("p_name")).alias("uuid"))


SAFE_NAMES = r"""
WITH p AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name)) AS h FROM part)
SELECT p_partkey, translate(lower(trim(p_type)),' -','__') AS header,
 CASE WHEN p_partkey%3=0 THEN 'Q_7_' ELSE '' END || regexp_replace(regexp_replace(upper(p_name),'[^A-Z0-9]+','_','g'),'^_+|_+$','','g') AS ident,
 regexp_replace(regexp_replace(CASE WHEN p_partkey%2=0 THEN p_type ELSE p_name END,'[^A-Za-z0-9._-]+','_','g'),'^_+|_+$','','g') AS bank,
 concat_ws('-', substr(h,1,8), substr(h,9,4), '5' || substr(h,14,3), substr('89ab', CAST('0x' || substr(h,17,1) AS INT)%4+1, 1) || substr(h,18,3), substr(h,21,12)) AS uuid FROM p
"""


def answer_letters(spark, d):
    """Orders as questions whose lines are options: letters of the right ones, by name or by text."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 5").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey.cast("string")).alias("o"))
    kind = F.when(C("l_orderkey") % 4 == 0, "TRUEFALSE").otherwise("MULTICHOICE")
    keys = F.when(C("l_orderkey") % 8 == 0, "yes").when(C("l_orderkey") % 8 == 4, " f ").when(C("l_orderkey") % 4 == 1, "c, a; ;A")
    return li.select("l_orderkey", F.array_join(labels.answer_letters(kind, keys, F.when(C("l_orderkey") % 4 == 2, F.element_at("o", -1)), C("o")), ",").alias("letters"))


ANSWER_LETTERS = """
WITH o AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS o FROM lineitem WHERE l_linenumber<=5 GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey%8=0 THEN 'A' WHEN l_orderkey%8=4 THEN 'B' WHEN l_orderkey%4=1 THEN 'A,C' WHEN l_orderkey%4=2 THEN array_to_string([substr('ABCDE',i,1) FOR i IN range(1,len(o)+1) IF o[i]=o[len(o)]], ',') ELSE '' END AS letters FROM o
"""


def typed_cells(spark, d):
    """Cells of an intake: times in UTC, booleans, codes and settings; what does not fit is null."""
    e = table(spark, d, "events").withColumn("n", F.get_json_object("props", "$.k"))
    stamp = F.concat(F.lit("2024-03-"), F.lpad((C("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T1"), (C("event_id") % 10).cast("string"), F.lit(":30:00"), F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (C("event_id") % 3 + 1).cast("int")))
    name = F.element_at(F.array(*map(F.lit, ("is_active", "attempts_allowed", "time_limit", "unknown"))), (C("event_id") % 4 + 1).cast("int"))
    value = F.when(C("event_id") % 5 == 0, "TRUE").when(C("event_id") % 5 == 1, "no").otherwise((C("event_id") % 5 - 2).cast("string"))
    return e.select("event_id", labels.utc_timestamp(stamp).alias("at"), labels.strict_boolean(value).alias("flag"), labels.is_code(F.when(C("event_id") % 2 == 0, F.concat_ws(" ", "event_type", "n")).otherwise(F.concat_ws("_", "event_type", "n"))).alias("is_code"), labels.coerced_setting(name, value).alias("setting"))


TYPED_CELLS = """
WITH e AS (SELECT event_id, CAST(event_id%5 AS INT) AS m, event_id%4 AS q, CASE WHEN event_id%5=0 THEN 'TRUE' WHEN event_id%5=1 THEN 'no' ELSE CAST(event_id%5-2 AS VARCHAR) END AS v, json_extract_string(props,'$.k') AS n,
 make_timestamp(2024,3,event_id%28+1,10+event_id%10,30,0) - CASE WHEN event_id%3=1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS t FROM events)
SELECT event_id, CASE WHEN event_id%3<2 THEN strftime(t,'%Y-%m-%dT%H:%M:%SZ') END AS at, CASE WHEN m=0 THEN true END AS flag, event_id%2=1 OR n IS NULL AS is_code,
 CASE WHEN q=0 THEN CASE m WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'false' WHEN 3 THEN 'true' END WHEN q=1 THEN CASE WHEN m>=3 THEN v END WHEN q=2 THEN CASE WHEN m>=2 THEN v END END AS setting FROM e
"""


def missing_alt(spark, d):
    """Images of pages, and those without an alternative text."""
    p = table(spark, d, "pages")
    shown = F.concat("html", F.concat(F.lit("<img src='i"), C("page_id").cast("string"), F.lit("' alt='"), F.when(C("page_id") % 2 == 0, "text").otherwise(" "), F.lit("'>")), F.when(C("page_id") % 3 == 0, "<IMG class=x>").otherwise(""))
    refs = labels.images_without_alt(shown)
    return p.select("page_id", F.size(labels.images(shown)).cast("long").alias("n_images"), F.size(refs).cast("long").alias("n_without"), F.array_join(refs, " || ").alias("refs"))


MISSING_ALT = r"""
WITH p AS (SELECT page_id, regexp_extract_all(html || '<img src=''i' || page_id || ''' alt=''' || CASE WHEN page_id%2=0 THEN 'text' ELSE ' ' END || '''>' || CASE WHEN page_id%3=0 THEN '<IMG class=x>' ELSE '' END, '(?is)<img\b[^>]*>') AS i FROM pages),
w AS (SELECT page_id, len(i) AS n, [x FOR x IN i IF NOT regexp_matches(x, '(?is)\balt\s*=\s*("[^"]*[^"\s][^"]*"|''[^'']*[^''\s][^'']*'')')] AS w FROM p)
SELECT page_id, n AS n_images, len(w) AS n_without, array_to_string([CASE WHEN trim(regexp_extract(x,'(?is)\bsrc\s*=\s*["'']([^"'']*)["'']',1))='' THEN '(image src not found)' ELSE trim(regexp_extract(x,'(?is)\bsrc\s*=\s*["'']([^"'']*)["'']',1)) END FOR x IN w], ' || ') AS refs FROM w
"""


def safe_references(spark, d):
    """References as they may be shown: paths of a machine and addresses only as digests."""
    e = table(spark, d, "events")
    ref = F.when(C("event_id") % 3 == 0, F.concat(F.lit("/home/u"), C("user_id").cast("string"), F.lit("/a.txt"))).when(C("event_id") % 3 == 1, F.concat(F.lit("C:\\x\\"), C("user_id").cast("string"))).otherwise(F.concat(F.lit("media/"), C("event_type")))
    shown = labels.redacted(ref, r"(^|\s)/(home|Users|root|tmp)/", r"[A-Za-z]:\\")
    return e.groupBy(shown.alias("shown")).agg(F.count("*").alias("n_rows"))


SAFE_REFERENCES = r"""
WITH r AS (SELECT CASE WHEN event_id%3=0 THEN '/home/u' || user_id || '/a.txt' WHEN event_id%3=1 THEN 'C:\x\' || user_id END AS s, 'media/' || event_type AS o, event_id FROM events)
SELECT CASE WHEN s IS NULL THEN o ELSE 'redacted-reference:' || substr(sha256(s),1,16) END AS shown, count(*) AS n_rows FROM r GROUP BY 1
"""


def path_guard(spark, d):
    """Paths of pages: those that may be read inside a folder, and those declared more than once."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.when(C("page_id") % 10 == 0, "../").when(C("page_id") % 10 == 1, "/").otherwise(""), text.package_path(C("url"))).alias("path"))
    unsafe = rules.violating(p, "page_id", text.safe_member(C("path")), "unsafe_path", C("path"), "error")
    return unsafe.unionByName(rules.repeated(p, ["path"], "duplicate_path"))


PATH_GUARD = r"""
WITH p AS (SELECT page_id, CASE WHEN page_id%10=0 THEN '../' WHEN page_id%10=1 THEN '/' ELSE '' END || regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url),'\','/'),'^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*',''),'[#?].*$',''),'/+','/','g'),'^(\./)?/?','') AS path FROM pages)
SELECT 'error' AS severity, 'unsafe_path' AS code, CAST(page_id AS VARCHAR) AS entity_key, path AS detail FROM p WHERE path='' OR regexp_matches(path,'^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|%2[fF]|%5[cC]|%00')
UNION ALL SELECT 'error', 'duplicate_path', path, CAST(count(*) AS VARCHAR) FROM p GROUP BY path HAVING count(*)>1
"""


def replaced_uris(spark, d):
    """Pages whose links to one file are turned to another, with how many were."""
    p = table(spark, d, "pages").withColumn("html", F.concat("html", F.lit('<a HREF = "old/a.png?x=1#f">'), F.when(C("page_id") % 2 == 0, "<img src='old/a.png'>").otherwise("<img src='old/a.pngs'>")))
    html, n = labels.replaced_uri(C("html"), "old/a.png", "new/b.png")
    return p.select("page_id", F.sha2(html, 256).alias("digest"), n.cast("long").alias("n_replaced"))


REPLACED_URIS = r"""
WITH p AS (SELECT page_id, html || '<a HREF = "new/b.png?x=1#f">' || CASE WHEN page_id%2=0 THEN '<img src=''new/b.png''>' ELSE '<img src=''old/a.pngs''>' END AS h FROM pages)
SELECT page_id, sha256(h) AS digest, CAST(CASE WHEN page_id%2=0 THEN 2 ELSE 1 END AS BIGINT) AS n_replaced FROM p
"""


def quiz_groups(spark, d):
    """Orders as placements by customer: distinct questions, sections and pools, and how many need a look."""
    o = table(spark, d, "orders")
    key = F.when(C("o_custkey") % 6 > 0, C("o_custkey").cast("string")).otherwise(F.concat_ws(":", F.lit("unresolved"), (C("o_custkey") % 4).cast("string"), C("o_orderpriority")))
    counts = rollup.conditional_counts(o.withColumn("quiz", key), ["quiz"], {"n_review": C("o_orderstatus") == "P"}, F.count("*").alias("n_occurrences"), F.countDistinct("o_totalprice").alias("n_questions"), F.countDistinct("o_orderpriority").alias("n_sections"), F.countDistinct("o_orderstatus").alias("n_pools"))
    return counts


QUIZ_GROUPS = """
SELECT CASE WHEN o_custkey%6>0 THEN CAST(o_custkey AS VARCHAR) ELSE 'unresolved:' || (o_custkey%4) || ':' || o_orderpriority END AS quiz, count(*) FILTER (o_orderstatus='P') AS n_review, count(*) AS n_occurrences,
 count(DISTINCT o_totalprice) AS n_questions, count(DISTINCT o_orderpriority) AS n_sections, count(DISTINCT o_orderstatus) AS n_pools FROM orders GROUP BY 1
"""


def question_keys_by_state(spark, d):
    """Parts that a relation of some status, or an open finding of some code, is about."""
    parts = table(spark, d, "part").select(C("p_partkey").alias("question"))
    li = table(spark, d, "lineitem")
    related = li.filter(C("l_returnflag").isin("A", "R") & (C("l_linenumber") <= 2)).select(C("l_partkey").alias("question"), F.lit("relation").alias("basis"))
    found = li.filter((C("l_returnflag") == "N") & (C("l_linenumber") == 3)).select(F.explode(F.array("l_partkey", "l_suppkey")).alias("question"), F.lit("finding").alias("basis"))
    return related.unionByName(found).distinct().join(parts, "question", "left_semi")


QUESTION_KEYS = """
SELECT DISTINCT question, basis FROM (SELECT l_partkey AS question, 'relation' AS basis FROM lineitem WHERE l_returnflag IN ('A','R') AND l_linenumber<=2 UNION ALL SELECT unnest([l_partkey, l_suppkey]), 'finding' FROM lineitem WHERE l_returnflag='N' AND l_linenumber=3) WHERE question IN (SELECT p_partkey FROM part)
"""


def library_rows(spark, d):
    """Banks as reviewers see them: sections, questions, uses and links by evidence."""
    li = table(spark, d, "lineitem").withColumn("level", _level(C("l_orderkey")))
    used = rollup.conditional_counts(li, ["l_suppkey"], {name: C("level") == level for name, level in (("direct", "source_evidence"), ("exact", "inferred_exact"), ("probable", "inferred_similarity"), ("none", "unmatched"))}, F.count("*").alias("n_mapped"), F.countDistinct("l_partkey").alias("n_questions"))
    s = table(spark, d, "supplier").join(used, C("s_suppkey") == C("l_suppkey"), "left")
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_questions", "n_mapped", "direct", "exact", "probable", "none")]
    return s.groupBy("s_nationkey").agg(F.count("*").alias("n_sections"), *counts)


LIBRARY_ROWS = f"""
WITH u AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS q, count(*) AS m, count(*) FILTER (v='source_evidence') AS a, count(*) FILTER (v='inferred_exact') AS b, count(*) FILTER (v='inferred_similarity') AS c, count(*) FILTER (v='unmatched') AS e FROM (SELECT *, {_LEVEL_SQL.format(k="l_orderkey")} AS v FROM lineitem) GROUP BY 1)
SELECT s_nationkey, count(*) AS n_sections, CAST(coalesce(sum(q),0) AS BIGINT) AS n_questions, CAST(coalesce(sum(m),0) AS BIGINT) AS n_mapped, CAST(coalesce(sum(a),0) AS BIGINT) AS direct, CAST(coalesce(sum(b),0) AS BIGINT) AS exact, CAST(coalesce(sum(c),0) AS BIGINT) AS probable, CAST(coalesce(sum(e),0) AS BIGINT) AS none FROM supplier LEFT JOIN u ON s_suppkey=l_suppkey GROUP BY 1
"""

_ALL = {
    "reviewer_labels": (reviewer_labels, REVIEWER_LABELS), "library_locations": (library_locations, LIBRARY_LOCATIONS), "response_blocks": (response_blocks, RESPONSE_BLOCKS), "feedback_lines": (feedback_lines, FEEDBACK_LINES),
    "quiz_locations": (quiz_locations, QUIZ_LOCATIONS), "image_states": (image_states, IMAGE_STATES), "display_titles": (display_titles, DISPLAY_TITLES), "points_shown": (points_shown, POINTS_SHOWN), "safe_names": (safe_names, SAFE_NAMES),
    "answer_letters": (answer_letters, ANSWER_LETTERS), "typed_cells": (typed_cells, TYPED_CELLS), "missing_alt": (missing_alt, MISSING_ALT), "safe_references": (safe_references, SAFE_REFERENCES), "path_guard": (path_guard, PATH_GUARD),
    "replaced_uris": (replaced_uris, REPLACED_URIS), "quiz_groups": (quiz_groups, QUIZ_GROUPS), "question_keys_by_state": (question_keys_by_state, QUESTION_KEYS), "library_rows": (library_rows, LIBRARY_ROWS),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
