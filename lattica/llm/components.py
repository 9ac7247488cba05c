"""Connected components of a graph of bigint nodes by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, lean, materialise

#: The most hubs that are broadcast (16 bytes each), and the least edges of a hub.
HUBS, HUB_EDGES = 100_000, 1_000
#: Up to so many edges one task solves at once (16 bytes each, some ten times that at work); more are solved in rounds of shuffles.
TASK_EDGES = 1_000_000


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("s")).collect()[0]
    return row.n, row.s or 0


def _with_least(edges: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """Edges u, v with m of low (u, m, n: its edges); hub is None where no node has that many edges.

    The edges of a hub aren't dealt by u, or all of them would meet in one task: what is known of hubs
    is broadcast. Of E edges there are at most E / hub hubs, which ``components`` bounds by 2 * HUBS.
    """
    if hub is None:
        return edges.join(low.select("u", "m"), "u")
    marked = edges.join(F.broadcast(low.where(F.col("n") >= hub).select("u", F.col("m").alias("hm"))), "u", "left")
    rest = marked.where("hm IS NULL").drop("hm").join(low.where(F.col("n") < hub).select("u", "m"), "u")
    return marked.where("hm IS NOT NULL").select("u", "v", F.col("hm").alias("m")).unionByName(rest)


def _solved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component: roots go below the smallest root beside them until none is left to go."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [(pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)) for pdf in batches]
    if held:
        node, root = _solved(*(np.concatenate(x) for x in zip(*held)))
        yield pd.DataFrame({"node": node, "root": root})


def components(edges: DataFrame) -> DataFrame:
    """Edges u, v to rows node, root: the smallest node of each node's component.

    Up to TASK_EDGES edges are solved by one task: rounds of many small shuffles cost the driver their plans, generated
    code and tasks' statuses. With more, each round joins a node's edges with its smallest neighbour (added up before the shuffle), first
    over larger neighbours, then over smaller ones, until the edges are stars. The number of rounds
    grows with the logarithm of the longest path. Nothing is gathered but the edges' count and sum.
    Loops and repeated edges count once; no edges give no rows. The table of a round is deleted as soon as the next is written.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    if mark[0] <= TASK_EDGES:
        found = materialise(edges.coalesce(1).mapInPandas(lean(_in_one_task), "node bigint, root bigint"), "components")
        discard(edges)
        return found
    while mark[0]:
        hub = max(HUB_EDGES, mark[0] // HUBS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the edges of a node do not get more within a round: one look at them does for both stars
        if mark[0] < hub or not both.groupBy("u").count().where(F.col("count") >= hub).limit(1).count():
            hub = None
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, low, hub)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        found = materialise(small, "edges")
        discard(edges)
        edges = found
        mark, before = _mark(edges), mark
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
