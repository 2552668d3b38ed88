"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What holds while a table is written: its shuffle files go when it ends, and batches for Python hold 8 MB at most.
WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_own_shared: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a new temporary folder stands in for it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_shared:
        _own_shared[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_shared[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new place in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the table. The write's
    shuffle files go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in WHILE_WRITTEN}
    for name, value in WHILE_WRITTEN.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete what ``written`` has left of these tables. Whatever is made of them must itself be written by now."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many small rows: one for ``each`` of them, but at least two for every core, whatever the number of shuffle partitions."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def held_out(id_col: str, folds: int, remainder: int) -> Column:
    """Whether a row is kept from training; a row with a null id always is."""
    return F.coalesce(fold_of(id_col, folds) == F.lit(remainder), F.lit(True))


def id_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that others can't clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def sliced(batches: Iterable[pa.RecordBatch], rows: int, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches to at most ``rows`` rows and about ``chars`` bytes, to bound what a task holds."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, chars // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``fn`` gets a batch and returns one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def one_label(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label. Repeated rows of a document count once; where they differ the largest counts."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, keep: Column, id_col: str = "doc_id") -> list[tuple[str, int]]:
    """Texts and labels of at most ``per_label`` labelled documents of label 0 and of 1.

    ``docs`` has doc_id and text; ``keep`` says on doc_id which rows may be learned from. The ids
    are taken in the order of a hash, so the sample doesn't depend on partitions, and only the
    ids of the sample are broadcast, never the labels.
    """
    one = one_label(labels, label_col, id_col).where(keep)
    parts = [one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    ids = {r["doc_id"]: r["label"] for p in parts for r in p.collect()}
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": sorted(ids)}))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").collect()
    by_id: dict[int, str] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        by_id.setdefault(r["doc_id"], r["text"])
    return [(by_id[i], ids[i]) for i in sorted(by_id)]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit, by pooling adjacent violators."""
    weight = np.ones(len(x)) if weight is None else weight
    knots, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    mean = np.bincount(at, weight * y) / w
    blocks: list[list[float]] = []
    for m, v in zip(mean, w, strict=True):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, v2, n2 = blocks.pop()
            m1, v1, n1 = blocks.pop()
            blocks.append([(m1 * v1 + m2 * v2) / (v1 + v2), v1 + v2, n1 + n2])
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def hash_sample(rows: DataFrame, n: int) -> list[str]:
    """The texts of ``n`` documents of ``rows`` (doc_id, text), the first in the order of a hash of the id.

    Only ids are ranked; the texts of the chosen ones follow by a join with those few ids.
    """
    ids = rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    if not ids:
        return []
    chosen = rows.sparkSession.createDataFrame(pd.DataFrame({"doc_id": [r["doc_id"] for r in ids]}))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])]
