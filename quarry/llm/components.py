"""Connected components by repeated contraction, with joins only.

In each round every node is merged into its best neighbour (highest degree, ties by
a hash that changes per round), edges are rewritten to the merged nodes and loops
dropped.  Stars vanish in one round, other graphs shrink by a constant factor, so
rounds grow with the logarithm of the longest chain.  What is left of up to ``LAST_EDGES``
edges is finished in one task.  All tables are written to the shared folder after each
round; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task takes.
LAST_EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        top = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], top)
        np.minimum.at(label, label[y], top)
        while (label[label] != label).any():
            label = label[label]
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    return nodes, nodes[label]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, root)."""
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(a, b)], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b); comp is the smallest node reachable.

    Loops and edges with a null end are ignored; repeated edges change nothing.
    """
    now = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    labels, k = None, 0
    while now.count() > last_edges:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if labels is None:
            labels = scratch.table(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), f"{name}-labels-0")
        k += 1
        rank = lambda v, d, k=k: F.struct((-F.col(d)).alias("d"), F.xxhash64(F.col(v), F.lit(k)).alias("h"), F.col(v).alias("v"))
        degrees = both.groupBy("a").agg(F.count("*").alias("deg"))
        best = (
            both.join(degrees.select(F.col("a").alias("b"), F.col("deg").alias("deg_b")), "b")
            .groupBy("a")
            .agg(F.min(rank("b", "deg_b")).alias("best"), F.count("*").alias("deg"))
        )
        parents = scratch.table(best.select("a", F.least(F.col("best"), rank("a", "deg"))["v"].alias("p")), f"{name}-parents-{k}")
        moved = (
            now.join(parents.select("a", F.col("p").alias("pa")), "a")
            .join(parents.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        later = scratch.table(moved, f"{name}-edges-{k}")
        relabelled = labels.join(parents.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        new_labels = scratch.table(relabelled, f"{name}-labels-{k}")
        scratch.drop(f"{name}-edges-{k - 1}", f"{name}-labels-{k - 1}", f"{name}-parents-{k}")
        now, labels = later, new_labels
    roots = scratch.table(now.repartition(1).mapInArrow(_finished, "node long, root long"), f"{name}-roots")
    if labels is None:
        return roots.withColumnRenamed("root", "comp")
    labels = labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("comp"))
    return labels.join(least, "label").select("node", "comp")
