"""Nearest marks in time, and running totals, for groups of any size.

A group may hold any share of the rows: rows are windowed in buckets of time, and only one summary
row of each bucket is carried along the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.lineage import cut

BUCKET = 600_000


def as_of(points: DataFrame, marks: DataFrame, by: Sequence[str], *, at: str, value: str, out: str, after: bool = False, least: bool = False, bucket: int = BUCKET) -> DataFrame:
    """``points`` with the value of their group's last mark at or before ``at``, or of the first one at or after it.

    With ``least`` it is the least value of all marks on that side.

    Of marks at one time the least value counts. A point without such a mark, or with a null time, gets null. Columns in ``by``
    aren't null.
    """
    sign = -1 if after else 1
    cell = [*by, "_cell"]
    kind = marks.schema[value].dataType
    one = marks.where(F.col(at).isNotNull()).groupBy(*by, F.col(at).alias("_mark")).agg(F.min(value).alias("_value"))
    one = one.select(*by, (F.col("_mark") * sign).alias("_at"), F.lit(False).alias("_asks"), "_value")
    asked = points.select("*", (F.col(at) * sign).alias("_at"), F.lit(True).alias("_asks"), F.lit(None).cast(kind).alias("_value"))
    rows = asked.unionByName(one, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_at") / bucket))
    order = Window.partitionBy(*cell).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("_here", (F.min("_value") if least else F.last("_value", True)).over(order))
    one = one.withColumn("_cell", F.floor(F.col("_at") / bucket))
    tails = one.groupBy(*cell).agg((F.min("_value") if least else F.max_by("_value", "_at")).alias("_tail"))
    cells = asked.select(*by, F.floor(F.col("_at") / bucket).alias("_cell")).distinct().withColumn("_tail", F.lit(None).cast(kind)).unionByName(tails)
    cells = cells.groupBy(*cell).agg(F.first("_tail", True).alias("_tail"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, (F.min("_tail") if least else F.last("_tail", True)).over(before).alias("_carried"))
    met = here.where("_asks").join(cells, cell, "left")
    return met.select(*points.columns, (F.least("_here", "_carried") if least else F.coalesce("_here", "_carried")).alias(out))


def running_total(df: DataFrame, by: Sequence[str], *, at: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows before it in the order of ``at``, which is unique in a group."""
    cell = [*by, "_cell"]
    rows = df.withColumn("_cell", F.floor(F.col(at) / bucket))
    before = Window.partitionBy(*cell).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    rows = rows.withColumn("_here", F.coalesce(F.sum(value).over(before), F.lit(0))).join(cells, cell)
    return rows.select(*df.columns, (F.col("_here") + F.col("_carried")).alias(out))


def holding(points: DataFrame, spans: DataFrame, by: Sequence[str], *, at: str, out: str) -> DataFrame:
    """``points`` with the sum of ``n`` over their group's spans (low, high, n) that hold ``at``, ends included; 0 without any."""
    edges = F.array(F.struct(F.col("low").alias("_edge"), F.col("n").alias("_n")), F.struct((F.col("high") + 1).alias("_edge"), (-F.col("n")).alias("_n")))
    edges = spans.select(*by, F.explode(edges).alias("_e")).groupBy(*by, F.col("_e._edge").alias("_edge")).agg(F.sum("_e._n").alias("_n"))
    marks = running_total(edges, by, at="_edge", value="_n", out="_upto").select(*by, F.col("_edge").alias(at), (F.col("_upto") + F.col("_n")).alias("_upto"))
    return as_of(points, cut(marks), by, at=at, value="_upto", out=out).fillna(0, [out])
