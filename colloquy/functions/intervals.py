"""Interval arithmetic, islands, and interval joins. Times are integer milliseconds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def distance(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Gap between two intervals, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), start_b - end_a, start_a - end_b)


def duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start)


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """Rounded ratio, 0 where the whole isn't positive."""
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(F.lit(0.0))


def half_up(numerator: Column, denominator: Column) -> Column:
    """The quotient of whole numbers, rounded half up in whole numbers."""
    return F.call_function("div", numerator * 2 + denominator, denominator * 2)


def islands(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    start: str = "start_ms",
    end: str = "end_ms",
    gap: int = 0,
    same: Sequence[str] = (),
    bucket: int = 3_600_000,
    cell: str | None = None,
) -> DataFrame:
    """Add ``island`` and ``prev_end``: rows of a group in order, cut where a gap or a change is.

    A row starts a new island if it differs from the row before in any column of ``same``, or
    if it starts more than ``gap`` after every earlier end of its run of equal ``same``.
    ``order`` must begin with ``start`` and be unique within a group. ``prev_end`` is the largest
    earlier end of the run, null for its first row.

    A group may hold any share of the rows: they are windowed in ``bucket``s of time, and only
    one summary row of each bucket meets those of the whole group. ``cell`` names a column for the group's columns and the number
    of the bucket; rows come back dealt by it.
    """
    if order[0] != start:
        raise ValueError("order must begin with start")
    rows = df.withColumn("_bucket", F.floor(F.col(start) / bucket)).withColumn("_same", F.struct(*same) if same else F.lit(True))
    rows = rows.withColumn("_cell", F.struct(*by, "_bucket"))  # one key, never null: rows stay where they are for windows and joins
    group = [F.col("_cell").getField(c) for c in by]
    w = Window.partitionBy("_cell").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.coalesce(~F.lag("_same").over(w).eqNullSafe(F.col("_same")) & (F.row_number().over(w) > 1), F.lit(False))
    rows = rows.withColumn("_changed", changed).withColumn("_run", F.sum(F.col("_changed").cast("long")).over(upto))
    in_run = Window.partitionBy("_cell", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max(end).over(in_run))

    runs = rows.groupBy("_cell", "_run").agg(F.max(end).alias("_top"), F.first("_same").alias("_same"))
    cells = runs.groupBy("_cell").agg(F.max("_run").alias("_changes"), F.max_by("_top", "_run").alias("_tail"), F.min_by("_same", "_run").alias("_first"), F.max_by("_same", "_run").alias("_last"))
    v = Window.partitionBy(*group).orderBy("_cell._bucket")
    all_before = v.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.row_number().over(v) == 1, 0).otherwise((~F.lag("_last").over(v).eqNullSafe(F.col("_first"))).cast("long"))
    cells = cells.withColumn("_edge", edge)
    cells = cells.withColumn("_head_run", F.sum(F.col("_edge") + F.col("_changes")).over(all_before) - F.col("_changes"))
    cells = cells.withColumn("_tail_run", F.col("_head_run") + F.col("_changes"))
    in_tail = Window.partitionBy(*group, "_tail_run").orderBy("_cell._bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_tail", F.max("_tail").over(in_tail))
    carried = F.when(F.lag("_tail_run").over(v) == F.col("_head_run"), F.lag("_tail").over(v))
    cells = cells.select("_cell", carried.alias("_carried"))

    rows = rows.join(cells, "_cell", "left")
    prev_end = F.when(F.col("_run") == 0, F.greatest("_before", "_carried")).otherwise(F.col("_before"))
    rows = rows.withColumn("prev_end", prev_end)
    rows = rows.withColumn("_new", (F.col("prev_end").isNull() | (F.col(start) > F.col("prev_end") + gap)).cast("long"))
    rows = rows.withColumn("_nth", F.sum("_new").over(upto))
    news = rows.groupBy("_cell").agg(F.sum("_new").alias("_news"))
    earlier = F.coalesce(F.sum("_news").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(news.select("_cell", earlier.alias("_earlier")), "_cell", "left")
    return rows.select(*df.columns, "prev_end", (F.col("_nth") + F.col("_earlier")).alias("island"), *([F.col("_cell").alias(cell)] if cell else []))


def coalesced(df: DataFrame, by: Sequence[str], *, start: str = "start_ms", end: str = "end_ms", drop_empty: bool = True) -> DataFrame:
    """Union of each group's intervals: overlapping and touching ones become one."""
    rows = df.select(*by, start, end).where(F.col(end) > F.col(start) if drop_empty else F.col(end) >= F.col(start)).distinct()
    return islands(rows, by, [start, end], start=start, end=end).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def in_buckets(df: DataFrame, start: str, end: str, bucket: int, name: str = "bucket") -> DataFrame:
    """One row for each bucket of time that an interval touches."""
    first, last = F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(a: DataFrame, b: DataFrame, by: Sequence[str], *, bucket: int = 600_000, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs of rows whose intervals share more than a point, by equal keys and buckets of time.

    Each pair is found once, in the bucket where the later of the two starts. Both sides have
    start_ms and end_ms; their columns come back with prefixes.
    """
    x, y = (df.select([F.col(c).alias(p + c) for c in df.columns]) for df, p in zip((a, b), prefix, strict=True))
    p, q = prefix
    x, y = in_buckets(x, f"{p}start_ms", f"{p}end_ms", bucket, "_x"), in_buckets(y, f"{q}start_ms", f"{q}end_ms", bucket, "_y")
    later = F.greatest(f"{p}start_ms", f"{q}start_ms")
    met = [F.col(p + c) == F.col(q + c) for c in by] + [F.col("_x") == F.col("_y")]
    near = (later < F.least(f"{p}end_ms", f"{q}end_ms")) & (F.floor(later / bucket) == F.col("_x"))
    return x.join(y, [*met, near]).drop("_x", "_y")


def holders(points: DataFrame, spans: DataFrame, by: Sequence[str], who: str, *, at: str, start: str = "start_ms", end: str = "end_ms", bucket: int = 60_000) -> DataFrame:
    """``points``, each once for every ``who`` of its group one of whose closed spans holds ``at``; the name comes back as ``holder``.

    Spans are united for each ``who`` first, so that a point meets few of them however many there are.
    """
    united = coalesced(spans, [*by, who], start=start, end=end, drop_empty=False)
    held = in_buckets(united.select(*by, F.col(who).alias("holder"), F.col(start).alias("_low"), F.col(end).alias("_high")), "_low", "_high", bucket, "_cell")
    met = points.withColumn("_cell", F.floor(F.col(at) / bucket)).join(held, [*by, "_cell"])
    return met.where(F.col(at).between(F.col("_low"), F.col("_high"))).select(*points.columns, "holder")
