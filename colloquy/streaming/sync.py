"""Calendar sources kept in step with a stream of sync results, a window of time at a time.

A sync replaces what a source holds in the window it covers. ``sync_stream`` writes each micro-batch's result as a version of its
own, named by the batch's id, so that running a batch again writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENT = ["source_id", "event_id", "starts_ms", "ends_ms"]
SYNCS = "sync_id long, source_id long, low_ms long, high_ms long, event_id string, starts_ms long, ends_ms long"


def last_windows(syncs: DataFrame) -> DataFrame:
    return syncs.select("sync_id", "source_id", "low_ms", "high_ms").distinct()


def replaced(base: DataFrame, syncs: DataFrame) -> DataFrame:
    """Calendar events after syncs (``SYNCS``): a row for each event found, or one without event_id for a window found empty.

    An event goes if a later sync of its source covers part of it, and comes with the last sync that has it. Events of ``base`` are
    older than every sync. Of rows with one (source, event, start) the latest counts.
    """
    found = syncs.where("event_id IS NOT NULL").select("sync_id", *EVENT)
    rows = base.select(F.lit(-1).cast("long").alias("sync_id"), *EVENT).unionByName(found)
    key = Window.partitionBy("source_id", "event_id", "starts_ms").orderBy(F.desc("sync_id"), F.desc("ends_ms"))
    rows = rows.withColumn("_nth", F.row_number().over(key)).where("_nth = 1").drop("_nth").alias("e")
    windows = last_windows(syncs).alias("w")
    covered = (F.col("e.source_id") == F.col("w.source_id")) & (F.col("w.sync_id") > F.col("e.sync_id"))
    covered = covered & (F.col("e.starts_ms") < F.col("w.high_ms")) & (F.col("e.ends_ms") > F.col("w.low_ms"))
    return rows.join(windows, covered, "left_anti").select(*EVENT)


def version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The calendar as it was after a batch; before the first one it is empty."""
    if batch < 0:
        return spark.createDataFrame([], "source_id long, event_id string, starts_ms long, ends_ms long")
    return spark.read.parquet(f"{path}/batch={batch}")


def sync_stream(syncs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps ``path``/batch=N: the calendar after each micro-batch N of ``syncs``.

    Batch N reads version N-1 and overwrites version N, so a batch that is run again after a failure changes nothing.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        replaced(version(rows.sparkSession, path, batch - 1), rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return syncs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
