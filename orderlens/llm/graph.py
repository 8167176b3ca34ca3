"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stored

#: Links that a task contracts at once.
CHUNK = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links; root is one node of its component.

    Each round gives the nodes random priorities. Every task first contracts the links it happens
    to read to stars; then each node moves to its linked node of least priority, over all
    tasks, and the links between different places are kept. A round removes a constant
    share of the nodes, whatever the shape, so chains and stars take a logarithmic number
    of rounds, and what few tasks hold takes few. All tables stay distributed and are
    written each round.
    """
    left = stored(contracted(links, 0), "links")
    labels = None
    number = 0
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("to")))))
        least = F.min(F.struct(priority("to", number).alias("p"), F.col("to").alias("node"))).alias("best")
        moves = stored(ends.groupBy("node").agg(least).select("node", F.when(
            F.col("best.p") < priority("node", number), F.col("best.node"))
            .otherwise(F.col("node")).alias("to")), "moves")
        from_a = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        from_b = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        number += 1
        left = stored(contracted(left.join(from_a, "a").join(from_b, "b").select(
            F.col("to_a").alias("a"), F.col("to_b").alias("b")), number), "links")
        if labels is None:
            labels = moves.withColumnRenamed("to", "root")
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            labels = stored(labels.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")), "labels")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def priority(node: str, number: int) -> Column:
    """Of a node in the round of this number."""
    return F.xxhash64(F.col(node), F.lit(number))


def contracted(links: DataFrame, number: int) -> DataFrame:
    """Links (a, b) that join the same nodes: of every CHUNK links that a task reads, those of each
    node to the one of least priority it is joined with.
    """
    def work(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield stars(held)
                held, rows = [], 0
        if held:
            yield stars(held)

    return (links.where("a <> b").select("a", "b", priority("a", number).alias("p"), priority("b", number).alias("q"))
            .mapInArrow(work, "a long, b long"))


def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b, p, q = (np.concatenate([batch.column(k).to_numpy() for batch in batches]) for k in range(4))
    nodes, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    order = np.lexsort((nodes, np.concatenate([p, q])[first]))
    nodes, place = nodes[order], np.argsort(order)
    x, y = place[at].reshape(2, -1)
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (further := root[root])).any():
            root = further
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"a": nodes[root[moved]], "b": nodes[moved]})
