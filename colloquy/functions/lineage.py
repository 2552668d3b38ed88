"""Cutting a plan where a result is used several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Shuffle files go when the write that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the checkpoint folder from here on, also after the loss of an executor.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine, as in tests, a
    temporary folder stands in for it.
    """
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, for rows by the million: kept as compressed columns, and without the shuffle files that it took to make them."""
    spark, path = df.sparkSession, f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()
