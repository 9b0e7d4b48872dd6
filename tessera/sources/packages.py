"""Packages as tables: where their manifests lie, what they list, their grade items and their namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import identity

# Names of files in a package, its namespaces and the prefixes they must have.
MANIFEST, GRADES = "imsmanifest.xml", "grades_d2l.xml"
DEFAULT_NAMESPACE = "http://www.imsglobal.org/xsd/imscp_v1p1"
PREFIXES = {"http://desire2learn.com/xsd/d2lcp_v2p0": "d2l_2p0"}
METADATA, METADATA_PREFIX, NO_METADATA = "http://www.imsglobal.org/xsd/imsmd_rootv1p2p1", "imsmd", "http://www.imsglobal.org/xsd/imsmd_v1p2"


def manifests(files: DataFrame) -> DataFrame:
    """snapshot, file, folder of every manifest, with its rank from the shallowest one (1: the root's, or the most plausible)."""
    name = F.element_at(F.split("file", "/"), -1)
    found = files.filter(name == MANIFEST).select("snapshot", "file", F.regexp_replace("file", r"/?[^/]*$", "").alias("folder"), F.size(F.split("file", "/")).alias("depth"))
    best = found.groupBy("snapshot").agg(F.min(F.struct("depth", "file")).alias("b"))
    return found.join(best, "snapshot").select("snapshot", "file", "folder", "depth", (F.col("file") == F.col("b.file")).alias("is_first"))


def roots(files: DataFrame) -> DataFrame:
    """snapshot, root (the folder of the first manifest; the whole where there is none), manifest."""
    first = manifests(files).filter("is_first").select("snapshot", F.col("folder").alias("root"), F.col("file").alias("manifest"))
    return files.select("snapshot").distinct().join(first, "snapshot", "left").select("snapshot", F.coalesce("root", F.lit("")).alias("root"), "manifest")


def grade_items(nodes: DataFrame) -> DataFrame:
    """snapshot, identifier, resource_code, name of the grade items."""
    key = ["snapshot", "file"]
    own = nodes.filter(F.element_at(F.split("file", "/"), -1) == GRADES)
    names = own.filter("tag = 'name'").groupBy(*key, "parent_id").agg(F.min_by(F.trim(F.coalesce("text", F.lit(""))), "node_id").alias("name")).withColumnRenamed("parent_id", "node_id")
    heads = own.filter("tag = 'item'").select(*key, "node_id", F.coalesce("attrs.identifier", F.lit("")).alias("identifier"), F.coalesce("attrs.resource_code", F.lit("")).alias("resource_code"))
    return heads.join(names, [*key, "node_id"], "left").select("snapshot", "identifier", "resource_code", F.coalesce("name", F.lit("")).alias("name"))


def resource_types(nodes: DataFrame) -> DataFrame:
    """snapshot, type, n_resources of the manifests."""
    listed = nodes.filter((F.element_at(F.split("file", "/"), -1) == MANIFEST) & (F.col("tag") == "resource"))
    return listed.groupBy("snapshot", F.coalesce(F.nullif(F.col("attrs.type"), F.lit("")), F.lit("(untyped)")).alias("type")).agg(F.count("*").alias("n_resources"))


def missing_hrefs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """snapshot, href of listed files that the package lacks. Addresses that the host resolves are not files; unsafe paths are missing."""
    listed = nodes.filter((F.element_at(F.split("file", "/"), -1) == MANIFEST) & (F.col("tag") == "resource")).select("snapshot", F.regexp_replace("file", "[^/]*$", "").alias("folder"), F.col("attrs.href").alias("href"))
    own = listed.filter((F.coalesce("href", F.lit("")) != "") & ~F.col("href").rlike(r"^(/|[A-Za-z][A-Za-z0-9+.\-]*:)"))
    named = own.withColumn("path", F.concat("folder", F.url_decode(text.package_path(F.replace("href", F.lit("+"), F.lit("%2B"))))))
    there = files.select("snapshot", F.col("file").alias("path")).distinct()
    return named.join(there.filter(text.safe_member(F.col("path"))), ["snapshot", "path"], "left_anti").select("snapshot", "href").distinct()


def namespaces(files: DataFrame) -> DataFrame:
    """snapshot, prefix (empty: the default one), uri of each manifest's root, read from its text: prefixes matter here."""
    own = files.filter(F.element_at(F.split("file", "/"), -1) == MANIFEST).select("snapshot", F.regexp_extract(F.decode("content", "UTF-8"), r"(?s)<manifest\b[^>]*>", 0).alias("head"))
    found = F.regexp_extract_all("head", F.lit(r"xmlns(?::[A-Za-z0-9_.\-]+)?\s*=\s*[\"'][^\"']*[\"']"), F.lit(0))
    one = own.select("snapshot", F.explode(found).alias("x"))
    return one.select("snapshot", F.regexp_extract("x", r"^xmlns:?([^\s=]*)", 1).alias("prefix"), F.regexp_extract("x", r"[\"']([^\"']*)[\"']", 1).alias("uri"))


def namespace_issues(spaces: DataFrame, default: str = DEFAULT_NAMESPACE, prefixes: dict[str, str] | None = None) -> DataFrame:
    """snapshot, code, detail: invented prefixes (ns0, ns1 ...), another default, namespaces that are absent or otherwise bound,
    the metadata namespace in another version, and, as `metadata_prefix`, a warning where it has another prefix."""
    prefixes = prefixes or PREFIXES
    invented = spaces.filter(F.col("prefix").rlike(r"^ns\d+$")).select("snapshot", F.lit("invented_prefix").alias("code"), F.col("prefix").alias("detail"))
    wanted = spaces.select("snapshot").distinct().withColumn("w", F.explode(F.array(*[F.struct(F.lit(u).alias("uri"), F.lit(p).alias("wanted")) for u, p in prefixes.items()]))).select("snapshot", "w.uri", "w.wanted")
    bound = wanted.join(identity.first_per(spaces.filter("prefix <> ''"), ["snapshot", "uri"], [F.col("prefix")]), ["snapshot", "uri"], "left")
    wrong = bound.filter("prefix IS NULL OR prefix <> wanted").select("snapshot", F.when(F.col("prefix").isNull(), "missing_namespace").otherwise("other_prefix").alias("code"), F.coalesce("prefix", "uri").alias("detail"))
    first = spaces.select("snapshot").distinct().join(spaces.filter("prefix = ''").groupBy("snapshot").agg(F.min("uri").alias("uri")), "snapshot", "left")
    other = first.filter(~F.col("uri").eqNullSafe(F.lit(default))).select("snapshot", F.lit("default_namespace").alias("code"), F.coalesce("uri", F.lit("")).alias("detail"))
    version = spaces.filter(F.col("uri") == NO_METADATA).select("snapshot", F.lit("metadata_version").alias("code"), F.col("uri").alias("detail")).distinct()
    prefix = spaces.filter((F.col("uri") == METADATA) & (F.col("prefix") != METADATA_PREFIX)).select("snapshot", F.lit("metadata_prefix").alias("code"), F.col("prefix").alias("detail"))
    return invented.unionByName(wrong).unionByName(other).unionByName(version).unionByName(prefix)


def payloads(files: DataFrame, suffix: str) -> DataFrame:
    """snapshot, file, basename, sha256, payload_id, state and error of the files with a suffix (in any case), which hold JSON objects with an id.

    The id is a text that is not blank, or a number; a whole one is written without a fraction. `parsed` where there is one; `invalid` otherwise, with not_utf8, not_json,
    no_object or id_missing."""
    own = files.filter(F.lower("file").endswith(suffix.lower()) & F.col("content").isNotNull())
    said = F.expr("try_validate_utf8(cast(content AS string))")
    read = own.withColumn("__t", said).withColumn("__v", F.try_parse_json("__t"))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.id", "variant")), F.lit("VOID"))
    said = F.trim(F.try_variant_get("__v", "$.id", "string"))
    named = F.when(kind == "STRING", F.nullif(said, F.lit(""))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.regexp_replace(said, r"\.0+$", ""))
    is_object = F.schema_of_variant("__v").startswith("OBJECT<")
    error = F.when(F.col("__t").isNull(), "not_utf8").when(F.col("__v").isNull(), "not_json").when(~is_object, "no_object").when(named.isNull(), "id_missing")
    found = read.withColumns({"payload_id": F.when(is_object, named), "error": error})
    return found.select("snapshot", "file", F.element_at(F.split("file", "/"), -1).alias("basename"), F.sha2("content", 256).alias("sha256"), "payload_id", F.when(F.col("error").isNull(), "parsed").otherwise("invalid").alias("state"), "error")


def one_of(rows: DataFrame, key: str, requested: str | None) -> tuple[DataFrame, DataFrame]:
    """The requested row, or the only one where none is requested; and why there is none: `not_found`, or `several` with how many there are."""
    if requested:
        chosen = rows.filter(F.col(key) == requested)
        return chosen, chosen.agg(F.count("*").alias("n")).filter("n <> 1").select(F.when(F.col("n") == 0, "not_found").otherwise("several").alias("code"), "n")
    n = rows.agg(F.count("*").alias("n"))
    counted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    alone = counted.agg(F.count("*").alias("keys"), F.sum("__n").alias("n"), F.min(key).alias(key)).filter("keys = 1 AND n = 1").select(key)
    return rows.join(alone, key, "left_semi"), n.filter("n <> 1").select(F.when(F.col("n") == 0, "not_found").otherwise("several").alias("code"), "n")
