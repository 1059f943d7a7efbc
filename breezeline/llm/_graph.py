"""Landed intermediate tables and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

ONE_TASK = 2_000_000  # links (32 MB) that one task joins up; more go through rounds of shuffles


def landed(df: DataFrame) -> DataFrame:
    """The rows, written once below the shared folder and read back."""
    path = work_dir(df.sparkSession) + "/landed"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined_up(batches):
    batches = list(batches)
    if not batches:
        return
    ends = np.concatenate([b.column(i).to_numpy() for i in (0, 1) for b in batches])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        left, right = root[a], root[b]
        apart = left != right
        if not apart.any():
            break
        # of two roots the larger hangs below the smaller, then all hang from roots again
        np.minimum.at(root, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reached.

    Few links are joined up in one task. Of more, every round hangs each node's larger neighbours, then its smaller ones,
    below its smallest neighbour, until each node hangs from its component's
    smallest node. Minima are combined map side, so a node of any degree is
    cheap; rounds grow with the logarithm of a component's size.
    """
    edges = links.where("a <> b").select("a", "b")
    if edges.count() <= ONE_TASK:
        return landed(edges.coalesce(1).mapInArrow(_joined_up, "node long, component long"))
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hung = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = hung.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        edges = landed(
            small.select("a", F.col("m").alias("b"))
            .unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionAll(roots)
