"""Connected components of a graph given as edges, by contraction to stars; every round is written to the shared store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ONE_TASK, stored


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that edges a-b lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (further := new[new]) is not None and not np.array_equal(further, new):
            new = further
        if np.array_equal(new, label):
            break
        label = new
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around its components' smallest nodes; of edges from nodes to themselves those of smallest nodes."""
    for b in batches:
        ends = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        place = place.reshape(2, -1)
        label = smallest(place[0], place[1], len(nodes))
        loop = np.zeros(len(nodes), bool)
        loop[place[0][place[0] == place[1]]] = True
        out = np.flatnonzero((label != np.arange(len(nodes))) | loop)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], names=["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task as stars around their components' smallest nodes."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        yield from _forest(iter(pa.Table.from_batches(rows).combine_chunks().to_batches()))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a task's edges with their component."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        nodes, place = np.unique(np.stack([table.column(0).to_numpy(), table.column(1).to_numpy()]), return_inverse=True)
        place = place.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[smallest(place[0], place[1], len(nodes))])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of edges, whose two first columns are nodes (long, not null).

    An edge from a node to itself gives that node a component. Rounds alternate: every node hangs its larger neighbours, then its smaller
    ones and itself, below the smallest; the number of rounds grows with the logarithm of the longest path. Edges that are ONE_TASK at
    most (16 bytes each), at first or after some rounds, are one task's work. No edges, no rows.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    # edges are made once, those from nodes to themselves with the others
    first = stored(edges.mapInArrow(_forest, "u long, v long"), "edges")
    e, alone, before = first.where("u <> v"), first.where("u = v").select("u"), None
    loops = alone.count()
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] + loops <= ONE_TASK:
            whole = e.unionByName(alone.select("u", F.col("u").alias("v"))).coalesce(1)
            return stored(whole.mapInArrow(_labelled, "node long, component long"), "components")
        if state == before or not state[0]:
            break
        if state[0] <= ONE_TASK:
            e = stored(e.coalesce(1).mapInArrow(_contracted, "u long, v long"), "edges")
            break
        before, n = state, 2 * state[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest neighbours are written first, so that the join meets two plain shuffles and splits a hot node's edges
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star", rows=n)
        large = stored(both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges", rows=n)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "star", rows=n)
        small = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges", rows=n)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = nodes.select("component").distinct().select(F.col("component").alias("node"), "component")
    lone = alone.distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))
