"""Hard negatives by Kronecker-packed products.

The candidates of a block are packed component by component: one wide integer holds, for every
candidate, its component plus a bias, each in a field of its own. An anchor multiplies each of
those integers once by its own (biased) component; the fields of the sum hold all candidates' inner
products at once, from which the biases are subtracted. Fields are as wide as the largest
possible sum, so nothing carries over and the scores are exact for components of any size.

Anchors are a stated query set, held against all rows in blocks: rows are dealt by hash to blocks
of about BLOCK, anchors to groups of about ANCHORS, and each (block, group) is one small cogroup.
A block passes on only each anchor's first rows, whose ranks then are settled in Spark.

1. Positives: an anchor meets the blocks of its own label and keeps its first ``positives`` rows.
2. Negatives: anchors, now with the scores of their positives, meet the blocks of all rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part; of several rows with one id the one with the least (label, vector) does; vectors of different
lengths are compared as if the shorter ended in zeros; ties go to the smaller id; a score beyond 64
bits is ranked exactly and reported as null; without rows or anchors the result is empty; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_written, written

#: Rows of a block and anchors of a group, about.
BLOCK, ANCHORS = 4096, 2048
MET = "anchor_id long, positive_id long, positive_score long, other_id long, order binary, score long"
LONG = 1 << 63


def scaled(x: float) -> int:
    """floor(256 * x) as an exact integer of any size."""
    return int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256 * x)


class Packing:
    """How vectors of up to ``size`` components, none beyond ``most`` in absolute value, are packed."""

    def __init__(self, size: int, most: int):
        self.size, self.bias = size, most
        self.width = max(1, ((size * (2 * most) ** 2).bit_length() + 7) // 8)
        #: Whether scores, also a hundredfold, fit numpy's integers.
        self.small = self.width <= 7

    def components(self, vectors: list[list[float]]) -> np.ndarray:
        """A row of biased components for each vector."""
        if self.small:
            out = np.zeros((len(vectors), self.size), np.int64)
            for row, v in zip(out, vectors, strict=True):
                row[: len(v)] = np.floor(256 * np.asarray(v, np.float64))
        else:
            out = np.array([[scaled(x) for x in v] + [0] * (self.size - len(v)) for v in vectors], object).reshape(len(vectors), self.size)
        return out + self.bias

    def packed(self, components: np.ndarray) -> list[int]:
        """For each place one integer with a field for each vector."""
        if self.small:
            fields = np.ascontiguousarray(components.T).astype("<u8").view(np.uint8).reshape(self.size, -1, 8)[:, :, : self.width]
            return [int.from_bytes(f.tobytes(), "little") for f in fields]
        return [int.from_bytes(b"".join(int(x).to_bytes(self.width, "little") for x in column), "little") for column in components.T]

    def unpacked(self, fields: int, n: int) -> np.ndarray:
        data = fields.to_bytes(n * self.width, "little")
        if self.small:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, : self.width] = np.frombuffer(data, np.uint8).reshape(n, self.width)
            return wide.view("<i8").reshape(n)
        return np.array([int.from_bytes(data[k : k + self.width], "little") for k in range(0, len(data), self.width)], object)

    def order(self, score: int) -> bytes:
        """Bytes that sort as the scores do."""
        return (score + (1 << (8 * self.width + 1))).to_bytes(self.width + 1, "big")

    def score(self, order: bytes) -> int:
        return int.from_bytes(order, "big") - (1 << (8 * self.width + 1))


class Block:
    """Candidates in the order of their ids, packed."""

    def __init__(self, packing: Packing, ids: np.ndarray, vectors: list[list[float]]):
        by = np.argsort(ids, kind="stable")
        components = packing.components([vectors[k] for k in by])
        self.packing, self.at, self.ids = packing, by, ids[by]
        self.fields, self.sums = packing.packed(components), components.sum(axis=1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of all candidates with one anchor, of biased components."""
        total = 0
        for field, x in zip(self.fields, anchor.tolist(), strict=True):
            total += field * x
        p = self.packing
        # (c + bias) * (a + bias), summed, less what the biases add
        return p.unpacked(total, len(self.ids)) - p.bias * (self.sums + int(sum(anchor.tolist()))) + p.size * p.bias * p.bias


def first(scores: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest wanted scores, ties to the earlier place."""
    at = np.flatnonzero(wanted)
    if len(at) > n:
        found = scores[at]
        least = np.partition(found, len(found) - n)[len(found) - n]
        above = at[found > least]
        at = np.concatenate([above, at[found == least][: n - len(above)]])
    return np.array(sorted(at.tolist(), key=lambda k: (-scores[k], k)), np.int64)


def _meet(packing: Packing, n: int, percent: int | None):
    """For a block and a group of anchors: each anchor's first rows of its label, or, with ``percent``, the negatives of its positives."""

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            block = Block(packing, rows["id"].to_numpy(), rows["vector"].to_pylist())
            labels = rows["label"].to_numpy()[block.at]
            against = packing.components(anchors["vector"].to_pylist())
            for k, (i, label) in enumerate(zip(anchors["id"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
                scores = block.scores(against[k])
                if percent is None:
                    wanted = [(None, None, (block.ids != i) & (labels == label))]
                else:
                    other = labels != label
                    wanted = []
                    for p in anchors["positives"][k].as_py():
                        exact = packing.score(p["order"])
                        near = other & (100 * scores >= percent * exact) & (scores <= exact)
                        wanted.append((p["id"], p["score"], near.astype(bool)))
                for positive, its, mask in wanted:
                    for at in first(scores, mask, n).tolist():
                        s = int(scores[at])
                        out.append((i, positive, its, int(block.ids[at]), packing.order(s), s if -LONG <= s < LONG else None))
        names = [c.split()[0] for c in MET.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return meet


def eligible(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: bool) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~odd)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def dealt(rows: DataFrame, anchors: DataFrame, by_label: bool) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to blocks and anchors to groups, of their label or of all: every row of a key meets every anchor of it once.

    Rows are repeated for each group of anchors, anchors for each block; a key with many rows has many blocks.
    """
    key = F.col("label") if by_label else F.lit(0).cast("long")
    rows, anchors = rows.withColumn("key", key), anchors.withColumn("key", key)
    blocks, groups = F.ceil(F.sum("rows") / BLOCK).alias("blocks"), F.ceil(F.sum("anchors") / ANCHORS).alias("groups")
    sizes = rows.select("key", F.lit(1).alias("rows"), F.lit(0).alias("anchors")).union(anchors.select("key", F.lit(0), F.lit(1)))
    if by_label:
        sizes = sizes.groupBy("key").agg(blocks, groups).where("blocks > 0 and groups > 0")
        rows, anchors = rows.join(sizes, "key"), anchors.join(sizes, "key")
    else:
        of_all = sizes.agg(blocks, groups).first()
        counts = {name: F.lit(of_all[name] or 0) for name in ("blocks", "groups")}
        rows, anchors = (df.withColumns(counts).where("blocks > 0 and groups > 0") for df in (rows, anchors))

    def part(among: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(among))

    def each(among: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(among) - 1))

    rows = rows.withColumn("block", part("blocks")).withColumn("group", each("groups"))
    anchors = anchors.withColumn("group", part("groups")).withColumn("block", each("blocks"))
    return rows.drop("blocks", "groups"), anchors.drop("blocks", "groups")


def ranked(met: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` rows of each ``by``, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("order"), "other_id"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def hard_negatives(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    relabel: bool = False,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every ``every``-th id.

    For each of an anchor's ``positives`` first rows of its own label, the ``negatives`` first rows of other
    labels that score from ``percent`` % of the positive's score up to that score. ``relabel`` moves the label of
    every seventh id on by one, modulo ten.
    """
    rows = written(eligible(embeddings, id_col, vector_col, label_col, relabel), "vectors")
    largest = F.max(F.aggregate("vector", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x))))
    bound = rows.agg(F.max(F.size("vector")).alias("size"), largest.alias("most")).first()
    packing = Packing(max(1, bound["size"] or 0), scaled(bound["most"] or 0.0) + 1)
    anchors = rows.where(F.col("id") % every == 0).toDF("id", "label", "vector")

    def met(anchors: DataFrame, by_label: bool, n: int, percent: int | None) -> DataFrame:
        left, right = dealt(rows, anchors, by_label)
        by = ["key", "block", "group"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_meet(packing, n, percent), MET)

    own = ranked(met(anchors, True, positives, None), positives, "anchor_id")
    held = own.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "order", "score")).alias("positives"))
    with_positives = written(anchors.join(held, "id"), "anchors")
    found = ranked(met(with_positives, False, negatives, percent), negatives, "anchor_id", "positive_id")
    out = written(found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop_written(rows, with_positives)
    return out
