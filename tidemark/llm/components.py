"""Connected components of an edge table: each part of it by itself, then all by alternating large-star and small-star steps.

A round of stars is about ten exchanges, and every exchange is planned, timed and kept by the driver. So tasks first
contract the edges that they hold, without an exchange; a table of one part needs no round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import Scratch, ship

#: Edges that one task contracts, about: two longs each, and as many again for its nodes.
PART_EDGES = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node that each can reach."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        # Of each two roots that an edge ties, the larger one goes below the least that it meets.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _contract(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, component) of each `part` edges (u, v) in turn; a node may come again with the next ones."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, least = least_reachable(*(np.concatenate([np.asarray(b[c], dtype=np.int64) for b in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > part:
                yield contracted(held)
                held = []
            held.append(batch)
        if held:
            yield contracted(held)

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (larger ones, or smaller ones with itself) are tied to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, part: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges (u, v), longs; component is the least node reachable.

    Tasks contract `part` edges each, so at most that many give the result at once. Else each round writes its
    edges to the shared folder, so lineage stays short and a lost executor costs one round at most. Rounds grow
    with the logarithm of the diameter; it ends when the edges are stars that no step changes. No edges give no
    rows; loops and repeated edges change nothing.
    """
    ship(edges.sparkSession)
    given = scratch.save(edges.where("u <> v").select("u", "v"), f"{name}-given")
    part = part or PART_EDGES
    parts = -(-given.count() // part)
    contracted = given.coalesce(max(1, parts)).mapInArrow(_contract(part), "node long, component long")
    if parts <= 1:
        return contracted
    now = contracted.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).distinct()
    now, last, k = scratch.save(now, f"{name}-0"), None, 0
    while True:
        k += 1
        step = scratch.save(_star(_star(now, True), False), f"{name}-{k}")
        sums = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == last:
            break
        last = (sums["n"], sums["h"])
        scratch.drop(f"{name}-{k - 1}")
        now = step
    nodes = step.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
