"""Connected components of a graph of links, by contraction in the tasks and one shuffle of labels a round."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_written, tasks_for, written

#: Parts into which the neighbours of a node are dealt where they learn its label, lest a large star is one task.
SALTS = 4
#: Links that a task holds before it contracts them; beyond, it holds a label for each of its nodes.
LINKS = 1 << 18
#: Labels for which a round has a task, beyond two for every core: few of them aren't worth a task for each shuffle partition.
ROWS = 100_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, each with the least node that these links reach from it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return nodes, nodes[label]
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])  # a root is hung on the least of those that it meets
        while (further := label[label] != label).any():
            label[further] = label[label[further]]


def _contracted(links: DataFrame) -> DataFrame:
    """(node, component): each task's links (u, v) as labels within the task, a row for each of its nodes."""

    def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, LINKS
        for b in batches:
            held.append((b["u"].to_numpy(), b["v"].to_numpy()))
            n += b.num_rows
            if n > most:
                held = [least_labels(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                most = max(LINKS, 2 * n)
        if n:
            nodes, labels = least_labels(*map(np.concatenate, zip(*held, strict=True)))
            for at in range(0, len(nodes), LINKS):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + LINKS]), pa.array(labels[at : at + LINKS])], ["node", "component"])

    return links.select("u", "v").mapInArrow(contract, "node long, component long")


def _fingerprint(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links`` that has a link; a component is its least node.

    In each round a label goes to the node that it names, and a node's own labels to all parts of those that it names:
    what meets in a task is contracted there. A node has one label a task at most, and of those that name a node
    a SALTS-th meets in one task. The rounds grow with the logarithm of the longest chain. Nothing but two numbers of each
    round comes to the driver.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    spark, n = links.sparkSession, links.count()
    labels = written(_contracted(edges).distinct().coalesce(tasks_for(spark, n, ROWS)), "labels")
    before = _fingerprint(labels)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    while before[0]:
        pairs = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        own = F.transform(every, lambda s: F.struct(F.col("u").alias("to"), s.cast("long").alias("salt")))
        named = F.array(F.struct(F.col("v").alias("to"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).alias("salt")))
        sent = pairs.select("u", "v", F.explode(F.concat(own, named)).alias("x")).select("u", "v", "x.to", "x.salt")
        n = tasks_for(spark, before[0], ROWS)
        previous, labels = labels, written(_contracted(sent.repartition("to", "salt").coalesce(n)).distinct().coalesce(n), "labels")
        drop_written(previous)
        after = _fingerprint(labels)
        if after == before:
            break
        before = after
    return labels
