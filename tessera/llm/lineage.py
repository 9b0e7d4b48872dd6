"""Checkpoints in the folder that the cluster names, and connected components on top of them."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES_A_PARTITION = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the one that spark.checkpoint.dir names. Only a local session may do without; it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system that is read no more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def contracted(batches, most: int = 1 << 20):
    """The same components in fewer edges: of so many edges at a time each node to the least one it reaches."""

    def forest(held: list) -> pa.RecordBatch:
        edges = np.concatenate([np.stack([x.column(k).to_numpy() for k in ("u", "v")]) for x in held], axis=1)
        nodes, at = np.unique(edges, return_inverse=True)
        (a, b), label = at.reshape(2, -1), np.arange(len(nodes))
        while True:
            least, before = np.minimum(label[a], label[b]), label.copy()
            for x in (a, b, before[a], before[b]):
                np.minimum.at(label, x, least)
            label = label[label]
            if (label == before).all():
                break
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield forest(held)
            held, n = [], 0
    if n:
        yield forest(held)


def components(edges: DataFrame) -> DataFrame:
    """u, v (long) -> id, label: the smallest id each node reaches. Nodes without an edge to another have no row.

    Alternates large-star and small-star steps, which only need the least neighbour of a node:
    an aggregate with map-side combining and a join that Spark splits where a node is hot.
    Tasks contract the edges of each round before they send them. Few edges are kept in few partitions.
    """
    edges = checkpoint(edges.filter("u <> v").select("u", "v").distinct())
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = small.unionByName(below.select("u", F.col("m").alias("v"))).mapInArrow(contracted, "u long, v long").distinct()
        edges = checkpoint(found.coalesce(1 + before[0] // EDGES_A_PARTITION))
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
