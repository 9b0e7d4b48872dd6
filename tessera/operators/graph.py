"""Property-graph operators: reachability over possibly cyclic edges, components, typed paths, and relational division."""

from __future__ import annotations

import itertools
import tempfile
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, starts: DataFrame, source: str = "src", target: str = "dst", node: str = "node", most_steps: int | None = None) -> DataFrame:
    """start, node, depth of everything the starts reach, themselves at depth 0; each node once, by its shortest way.

    Rounds join the frontier alone; what was seen is taken out, so cycles end. An error if most_steps do not reach all."""
    step = kept(edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).distinct())  # once, not in each round
    frontier = starts.select(F.col(node).alias("start"), F.col(node)).distinct().withColumn("depth", F.lit(0))
    seen = kept(frontier)
    frontier = seen
    for depth in itertools.count(1):
        found = frontier.join(step, F.col(node) == F.col("__from")).select("start", F.col("__to").alias(node)).distinct()
        # frontiers are kept on their own and read together: what was seen is not written again
        frontier = kept(found.join(seen, ["start", node], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        if most_steps is not None and depth > most_steps:
            raise ValueError(f"more than {most_steps} steps from the starts")
        seen = seen.unionByName(frontier)


#: Rows of a few numbers and keys, some MB, that may be sent to all tasks.
FEW = 100_000


def _if_few(rows: DataFrame) -> DataFrame:
    """Kept rows, marked for a broadcast join where they are few, so that hot keys of the other side stay where they are."""
    rows = kept(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def divide(pairs: DataFrame, member: str, group: str, required: DataFrame, of: str) -> DataFrame:
    """Groups of `pairs` that have every member which `required` names for some owner `of`: of, group.

    Groups of equal members are judged once, by the least of them: joins by member see distinct sets, so a member that most
    groups have is not a task of its own. A set is known by its size and 128 bits of hashes, whatever its size."""
    needs = _if_few(required.select(of, member).distinct())
    sizes = needs.groupBy(of).agg(F.count("*").alias("__needed"))
    known = ["__n", "__x", "__y"]
    held = pairs.filter(F.col(member).isNotNull()).select(member, group).distinct()
    marks = [F.count("*").alias("__n"), F.bit_xor(F.xxhash64(member)).alias("__x"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("__y")]
    sets = kept(held.groupBy(group).agg(*marks))
    firsts = _if_few(sets.groupBy(*known).agg(F.min(group).alias("__first")))
    members = pairs.join(firsts, F.col(group).eqNullSafe(F.col("__first"))).filter(F.col(member).isNotNull()).select(*known, member).distinct()
    had = members.join(needs, member).groupBy(of, *known).agg(F.count("*").alias("__had"))
    fitting = _if_few(had.join(sizes, of).filter("__had = __needed").select(of, *known))
    return sets.join(fitting, known).select(of, group)


def components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """node, component: the least node that each node of an edge reaches, whatever the direction. Edges of null go nowhere.

    Large-star and small-star steps: every round needs the least neighbour of a node alone, an aggregate that tasks
    begin, and joins that Spark splits where a node is hot. Rounds grow with the logarithm of the longest way."""
    given = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = given.select("u").union(given.select("v")).distinct()
    links = kept(given.filter("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = kept(small.union(below).distinct())
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return nodes.join(links, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


class Hop(NamedTuple):
    """A step along edges of one kind, or against them, to nodes of some kinds; how many a node must and may have.

    transitive: any number of steps, through nodes of any kind. once: no node may be reached from two."""

    edge: str
    to: tuple[str, ...]
    at_least: int = 1
    at_most: int | None = None
    against: bool = False
    transitive: bool = False
    once: bool = False


def typed_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: list[Hop]) -> tuple[DataFrame, DataFrame]:
    """Paths of typed hops, and all that speaks against them.

    nodes: node, kind. edges: kind, src, dst. starts: node. Paths: h0 to hn, of nodes that have the kinds asked for.
    Violations: hop (from 1), node, code, n. `dangling` and `wrong_kind` count edges of a node, `too_few` and
    `too_many` the right nodes it leads to, `shared` the nodes that lead to it where each may be reached once; a
    start that is no node is `unknown` at hop 0. A node is reported once, however many paths come by."""
    kinds = nodes.select("node", F.col("kind").alias("__kind")).dropDuplicates(["node"])
    paths = starts.select(F.col("node").alias("h0")).distinct()
    given = kept(paths.join(kinds, paths["h0"] == kinds["node"], "left").select("h0", F.col("node").isNotNull().alias("__known")))
    found = [given.filter("NOT __known").select(F.lit(0).alias("hop"), F.col("h0").alias("node"), F.lit("unknown").alias("code"), F.lit(1).cast("long").alias("n"))]
    paths = given.filter("__known").select("h0")
    ends = paths
    for i, hop in enumerate(hops, 1):
        here = f"h{i - 1}"
        step = edges.filter(F.col("kind") == hop.edge).select(F.col("dst" if hop.against else "src").alias("__a"), F.col("src" if hop.against else "dst").alias("__b")).filter("__a IS NOT NULL").distinct()
        at = kept(ends)
        if hop.transitive:
            reached = reachable(step, at.select(F.col(here).alias("node")), "__a", "__b").filter("depth > 0 AND node IS NOT NULL")
            step = reached.select(F.col("start").alias("__a"), F.col("node").alias("__b"))
        led = kept(at.join(step, at[here] == step["__a"], "left").join(kinds, F.col("__b") == kinds["node"], "left").select(here, "__a", "__b", "__kind"))
        right = F.coalesce(F.col("__kind").isin(*hop.to), F.lit(False))
        wrong = F.col("__a").isNotNull() & F.col("__kind").isNotNull() & ~right & ~F.lit(hop.transitive)
        counted = led.groupBy(here).agg(F.count_if(right).alias("n"), F.count_if(F.col("__a").isNotNull() & F.col("__kind").isNull()).alias("dangling"), F.count_if(wrong).alias("wrong"))
        told = {"dangling": F.col("dangling") > 0, "wrong_kind": F.col("wrong") > 0, "too_few": F.col("n") < hop.at_least, "too_many": F.lit(False) if hop.at_most is None else F.col("n") > hop.at_most}
        numbers = {"dangling": "dangling", "wrong_kind": "wrong"}
        each = F.explode(F.filter(F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), F.col(numbers.get(code, "n")).alias("n"))) for code, holds in told.items()]), lambda x: x.isNotNull()))
        found.append(counted.select(F.lit(i).alias("hop"), F.col(here).alias("node"), each.alias("v")).select("hop", "node", "v.code", "v.n"))
        steps = led.filter(right).select(here, F.col("__b").alias(f"h{i}"))
        ends = steps.select(f"h{i}").distinct()  # where paths end: every node a step starts from is on one, so no path is needed
        if hop.once:
            shared = steps.groupBy(f"h{i}").agg(F.count("*").alias("n")).filter("n > 1")
            found.append(shared.select(F.lit(i).alias("hop"), F.col(f"h{i}").alias("node"), F.lit("shared").alias("code"), "n"))
        paths = paths.join(steps, here).select(*[f"h{k}" for k in range(i + 1)])
    return paths, reduce(DataFrame.union, found)
