"""Connected components of a distributed edge table, by contraction.

Each round every root takes its smallest smaller neighbour as parent (a map-side combined minimum, so hubs cost
nothing), the parent chains are shortened by pointer jumping until they are flat, and the edges are rewritten between
roots. Every root that has a smaller neighbour vanishes, so the roots at least halve each round. All tables are
checkpointed between steps, which also leaves both sides of each lookup as plain exchanges that AQE may split when one
root is the parent of very many nodes. The tables shrink from round to round, and so do their numbers of tasks and files.
Edges that are no more than one task's rows, from the start or after some rounds, are contracted in that task at once: a
round of many small jobs costs the driver more than the work does. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bound_batches, materialize, sized


def _flatten(parents: DataFrame, rows: int) -> DataFrame:
    """(node, root) from at most ``rows`` rows (node, parent) whose parents are strictly smaller."""
    flat = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = flat.select(F.col("node").alias("root"), F.col("root").alias("above"))
        joined = flat.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        joined = materialize(sized(joined, rows))
        flat = joined.select("node", "root")
        if joined.filter("moved").isEmpty():
            return flat


def _smallest(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    a, b, up = at[: len(lo)], at[len(lo) :], np.arange(len(nodes))
    while ((x := up[a]) != (y := up[b])).any():
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (above := up[up])).any():
            up = above
    return nodes, nodes[up]


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (lo, hi; no more rows than one task takes) that are not the smallest of their component."""
    bound_batches(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if held:
            nodes, roots = _smallest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            moved = nodes != roots
            yield pa.record_batch([pa.array(nodes[moved]), pa.array(roots[moved])], names=["node", "root"])

    return edges.select("lo", "hi").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b; long): component is the smallest reachable node.

    Self-links are ignored; nodes without another neighbour have no row. Nulls are ignored."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rest = materialize(edges.filter("a <> b").select(low.alias("lo"), high.alias("hi")).distinct())
    total, nodes = None, 0
    while rows := rest.count():
        nodes = nodes or 2 * rows
        if last := rows <= common.TASK_ROWS:
            flat = materialize(_at_once(rest))
        else:
            parents = materialize(sized(rest.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), rows))
            flat = _flatten(parents, rows)
        if total is None:
            total = flat
        else:
            up = flat.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = total.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            total = materialize(sized(moved.unionByName(flat.join(total.select("node"), "node", "left_anti")), nodes))
        if last:
            break
        up_hi = flat.select(F.col("node").alias("hi"), F.col("root").alias("r_hi"))
        up_lo = flat.select(F.col("node").alias("lo"), F.col("root").alias("r_lo"))
        ends = rest.join(up_hi, "hi", "left").join(up_lo, "lo", "left").select(F.coalesce("r_lo", "lo").alias("a"), F.coalesce("r_hi", "hi").alias("b"))
        rest = materialize(sized(ends.filter("a <> b").select(low.alias("lo"), high.alias("hi")).distinct(), rows))
    if total is None:
        return edges.filter("false").select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = total.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return total.unionByName(roots).select("node", F.col("root").alias("component"))
