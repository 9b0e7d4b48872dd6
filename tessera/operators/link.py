"""Record linkage: cascaded evidence, unique gates, reference resolution and bounded similarity. Never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markup

from .graph import kept

SIMILAR, LEAD = 0.95, 0.03


def unique_gate(catalogue: DataFrame, key: str, container: str, record: str) -> DataFrame:
    """key -> the record it identifies: its only one, or the first of several in one container.

    Columns: key, record, n_candidates, n_containers, is_shared. Keys that name several containers' records are left out."""
    gate = catalogue.filter((F.col(key).isNotNull()) & (F.col(key).cast("string") != "")).groupBy(key)
    found = gate.agg(F.min(record).alias(record), F.count("*").alias("n_candidates"), F.countDistinct(container).alias("n_containers"))
    return found.filter("n_candidates = 1 OR n_containers = 1").withColumn("is_shared", F.col("n_candidates") > 1)


def ladder(items: DataFrame, item: str, rungs: list[tuple[str, str, DataFrame, str]], record: str) -> DataFrame:
    """Joins items to each rung in turn and keeps the first that holds.

    rungs: (evidence level, basis, gate, key): a gate from unique_gate, and the key both sides have.
    Adds record, evidence_level and match_basis; unmatched items keep null and `unmatched`."""
    out, picks = items, []
    for i, (level, basis, gate, key) in enumerate(rungs):
        side = gate.select(F.col(key), F.col(record).alias(f"__r{i}"))
        out = out.join(side, key, "left")
        picks.append((F.col(f"__r{i}").isNotNull(), F.col(f"__r{i}"), level, basis))
    chosen, evidence, reason = F.lit(None), F.lit("unmatched"), F.lit("unmatched")
    for holds, value, level, basis in reversed(picks):
        chosen, evidence, reason = F.when(holds, value).otherwise(chosen), F.when(holds, F.lit(level)).otherwise(evidence), F.when(holds, F.lit(basis)).otherwise(reason)
    return out.select(*items.columns, chosen.alias(record), evidence.alias("evidence_level"), reason.alias("match_basis"))


def resolve_refs(refs: DataFrame, files: DataFrame, ref: str = "ref", path: str = "path") -> DataFrame:
    """Each reference by full path, else by its tail after three folders of content/enforced, else by a unique base name.

    Adds status, basis and path (null where missing)."""
    base = F.element_at(F.split(F.col("__c"), "/"), -1)
    paths = files.select(F.col(path)).distinct()
    names = paths.withColumn("__c", F.col(path)).select(base.alias("__name"), path).groupBy("__name").agg(F.min(path).alias("__p2"), F.count("*").alias("n")).filter("n = 1").drop("n")
    tail = F.when(F.col(ref).startswith("content/enforced/") & (F.size(F.split(ref, "/", 4)) == 4), F.element_at(F.split(ref, "/", 4), -1))
    keyed = refs.withColumn("__tail", tail).withColumn("__c", F.col(ref)).withColumn("__name", base).drop("__c")
    joined = (
        keyed.join(paths.select(F.col(path).alias("__p0"), F.col(path).alias(ref)), ref, "left")
        .join(paths.select(F.col(path).alias("__p1"), F.col(path).alias("__tail")), "__tail", "left")
        .join(names, "__name", "left")
    )
    basis = F.when(F.col("__p0").isNotNull(), "normalized_ref").when(F.col("__p1").isNotNull(), "content_enforced_tail").when(F.col("__p2").isNotNull(), "unique_basename").otherwise("not_found")
    found = F.coalesce("__p0", "__p1", "__p2")
    return joined.select(*refs.columns, F.when(found.isNull(), "missing").otherwise("resolved").alias("status"), basis.alias("basis"), found.alias("resolved_path"))


def grams_needed(n: Column, least: float, size: int) -> Column:
    """How many grams two texts of n characters together share at least, if their ratio is `least` or more.

    Of n characters at most (1 - least) n are not in matching blocks, and between two blocks is one at least. m matching
    characters in b blocks share m - b (size - 1) grams."""
    return F.ceil(n * (least / 2 - (1 - least) * (size - 1)) - (size - 1) - 1e-9)


def _prefixes(texts: DataFrame, least: float, size: int) -> DataFrame:
    """side, id, length, token: of each text the rarest grams, as many as any text of a fitting length must share one of.

    A gram that occurs k times in a text is k tokens, so that what two texts share counts as often as it occurs in both."""
    n = F.length("text")
    grams = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col("text"), i, size))
    each = texts.filter(n >= size).select("side", F.xxhash64("text").alias("id"), n.alias("length"), F.explode(grams).alias("gram")).groupBy("side", "id", "length", "gram").agg(F.count("*").alias("n"))
    tokens = kept(each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("side", "id", "length", F.xxhash64("gram", "k").alias("token")))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    shortest = F.ceil(F.col("length") * (least / (2 - least)) - 1e-9)
    most = F.col("length") - size + 1 - F.greatest(grams_needed(F.col("length") + shortest, least, size), F.lit(1)) + 1
    rank = F.row_number().over(Window.partitionBy("side", "id", "length").orderBy("df", "token"))
    return tokens.join(counts, "token").withColumn("rank", rank).filter(F.col("rank") <= most).select("side", "id", "length", "token")


def similarity_candidates(items: DataFrame, records: DataFrame, item: str, record: str, key: str, least: float = SIMILAR - LEAD) -> DataFrame:
    """Pairs that reach `least`, scored; `least` is below the threshold by the lead, so that no runner-up hides.

    Texts that could reach it share one of their rarest grams (prefixes, by how many grams they must share), so only
    texts that do, and whose lengths fit, are compared; none is missed. Equal texts need no gram. A text that many
    items or records have is compared once. Hashes of texts only propose pairs: what is compared are the texts."""
    size = 2 if 1.5 * least - 1 >= 0.2 else 1
    a = items.filter(F.col(key) != "").groupBy(F.col(key).alias("__a")).agg(F.count("*").alias("__n"))
    b = records.filter(F.col(key) != "").groupBy(F.col(key).alias("__b")).agg(F.count("*").alias("__m"))
    both = a.select(F.lit("a").alias("side"), F.col("__a").alias("text")).union(b.select(F.lit("b").alias("side"), F.col("__b").alias("text")))
    prefixes = kept(_prefixes(both, least, size))
    left, right = (prefixes.filter(F.col("side") == s).select(F.col("id").alias(f"__id_{s}"), F.col("length").alias(f"__l_{s}"), "token") for s in "ab")
    shorter, longer = F.least("__l_a", "__l_b"), F.greatest("__l_a", "__l_b")
    ids = left.join(right, "token").filter(shorter >= longer * (least / (2 - least)) - 1e-9).select("__id_a", "__id_b").distinct()
    near = ids.join(a.select("__a", F.xxhash64("__a").alias("__id_a")), "__id_a").join(b.select("__b", F.xxhash64("__b").alias("__id_b")), "__id_b").select("__a", "__b").filter("__a <> __b")
    equal = a.join(b, F.col("__a") == F.col("__b")).select("__a", "__b", F.lit(1.0).alias("score"))
    scored = near.withColumn("score", markup.ratio(F.col("__a"), F.col("__b"), least)).filter(F.col("score") >= least).union(equal)
    return scored.join(items.select(item, F.col(key).alias("__a")), "__a").join(records.select(record, F.col(key).alias("__b")), "__b").select(item, record, F.round("score", 6).alias("score"))


def similarity_links(items: DataFrame, records: DataFrame, item: str, record: str, key: str, threshold: float = SIMILAR, lead: float = LEAD, most: int = 5) -> DataFrame:
    """One row for each item with a candidate: its best record if it reaches the threshold and leads, its score, and up to five candidates."""
    scored = similarity_candidates(items, records, item, record, key, least=threshold - lead)
    order = Window.partitionBy(item).orderBy(F.desc("score"), record)
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(2, most))
    shown = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", record, "score"))))
    best = ranked.groupBy(item).agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("match_score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col(record))).alias("best"),
        F.to_json(shown).alias("candidates"),
    )
    holds = (F.col("match_score") >= threshold) & (F.round(F.col("match_score") - F.col("second_score"), 6) >= lead)
    return best.select(item, F.when(holds, F.col("best")).alias(record), "match_score", "second_score", F.when(holds, "inferred_similarity").otherwise("unmatched").alias("evidence_level"), "candidates")
