"""Connected components by star contraction; a task never unites more than a bounded number of links.

What a task reads or is dealt is united first, a bounded number of links at a time: a group of links becomes a star around
its smallest node. That leaves few links, which go to as many tasks as their number needs, not to as many as a shuffle
has: links strewn over more tasks unite less in each and take more rounds, and a round costs dozens of small stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored

ROUNDS = 64
#: Links that are united at once, and that a task is dealt.
UNITED = 1 << 18


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest rows reached, after links between rows ``i`` and ``j``."""
    label = label.copy()
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new
    return label


def _stars(links: DataFrame, named: bool = False) -> DataFrame:
    """Links (a, b), ``a`` above ``b``, that unite in each task what its ``links`` unite; if ``named``, with (b, b) of each root."""

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= UNITED:
                yield _star_rows(held, named)
                held = []
        if held:
            yield _star_rows(held, named)

    return links.mapInArrow(contracted, "a long, b long")


def _star_rows(parts: list[pa.RecordBatch], named: bool) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(c).to_numpy() for x in parts]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = united(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    kept = np.flatnonzero((label != np.arange(len(nodes))) | named)
    return pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[label[kept]])], ["a", "b"])


def _trees(links: DataFrame) -> tuple[DataFrame, int]:
    """``links`` united where they lie, and the number of tasks that they need; stored."""
    trees = stored(_stars(links.where("a <> b").select("a", "b")), "graph-trees")
    return trees, -(-trees.count() // UNITED)


def _contracted(trees: DataFrame, tasks: int) -> DataFrame:
    """United with those of the same upper end, which each task that made ``trees`` gives once for each ``UNITED`` links; stored."""
    return stored(_stars(trees.repartition("a").coalesce(tasks)), "graph-links")


def _nodes(edges: DataFrame) -> DataFrame:
    """(node, component, open): the smallest neighbour or the node itself, and whether the node is more than a leaf or a root; stored."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(
        F.min("b").alias("low"), F.max("b").alias("top"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("high")
    )
    star = (F.col("low") > F.col("node")) | ((F.col("low") == F.col("high")) & (F.col("top") < F.col("node")))
    return stored(near.select("node", F.least("low", "node").alias("component"), (~star).alias("open")), "graph-nodes")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``links`` (a, b), 64-bit numbers: the smallest node that links reach.

    Links that one task may be dealt are united there. More take large-star and small-star steps in turn until all is
    stars or few links are left. The smallest neighbour of a node is a combined minimum; joins are by node, where adaptive
    execution splits a hot one.
    """
    for _ in range(ROUNDS):
        trees, tasks = _trees(links)
        if tasks <= 1:
            return stored(_stars(trees.coalesce(1), named=True), "graph-nodes").toDF("node", "component")
        edges = _contracted(trees, tasks)
        nodes = _nodes(edges)
        if nodes.where("open").isEmpty():
            break
        links = _stepped(edges, nodes)
    return nodes.select("node", "component")


def _stepped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) after a large-star and a small-star step."""
    least = nodes.select(F.col("node").alias("a"), F.col("component").alias("m"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = (
        both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).union(least.where("m < a").select("a", F.col("m").alias("b")))
    large = large.distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return (
        large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).union(least.select("a", F.col("m").alias("b")))
