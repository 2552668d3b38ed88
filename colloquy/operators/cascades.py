"""Deletes and merges that follow a declared graph of foreign keys through several tables.

Tables come and go as a dictionary of names. Nothing is changed in place; a table that no rule reaches comes back as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.changes import merge_entities


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``to.key``; a delete there takes these rows along (``cascade``) or empties the column (``set null``)."""

    table: str
    column: str
    to: str
    key: str = "id"
    on_delete: str = "cascade"


#: What refers to recordings, profiles and projects, and what a delete does to it.
GRAPH = (
    ForeignKey("jobs", "recording_id", "recordings"),
    ForeignKey("stages", "recording_id", "recordings"),
    ForeignKey("chunks", "recording_id", "recordings"),
    ForeignKey("assignments", "recording_id", "recordings"),
    ForeignKey("samples", "recording_id", "recordings", on_delete="set null"),
    ForeignKey("samples", "voice_profile_id", "profiles"),
    ForeignKey("assignments", "voice_profile_id", "profiles", on_delete="set null"),
    ForeignKey("recordings", "project_id", "projects", on_delete="set null"),
    ForeignKey("recordings", "suggested_project_id", "projects", on_delete="set null"),
    ForeignKey("weights", "project_id", "projects"),
)


def deleted(tables: dict[str, DataFrame], name: str, gone: DataFrame, *, key: str = "id", graph: tuple[ForeignKey, ...] = GRAPH) -> dict[str, DataFrame]:
    """All tables after the rows of ``name`` with a key in ``gone`` are deleted, and whatever the graph says follows.

    The graph is walked from the deleted table on; it must not lead back to a table that it came through. A null reference
    refers to nothing.
    """
    return _deleted(tables, name, gone.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct(), key, graph, (name,))


def _deleted(tables: dict[str, DataFrame], name: str, gone: DataFrame, key: str, graph: tuple[ForeignKey, ...], through: tuple[str, ...]) -> dict[str, DataFrame]:
    out = dict(tables)
    for fk in graph:
        if fk.to != name or fk.key != key or fk.table not in out:
            continue
        if fk.table in through:
            raise ValueError(f"the graph leads back to {fk.table}")
        child = out[fk.table]
        if fk.column not in child.columns:
            continue
        hit = F.col(fk.column) == F.col("_gone")
        if fk.on_delete == "set null":
            rows = child.join(gone, hit, "left")
            out[fk.table] = rows.withColumn(fk.column, F.when(F.col("_gone").isNull(), F.col(fk.column))).drop("_gone")
            continue
        keys = {f.key for f in graph if f.to == fk.table}
        lost = child.join(gone, hit, "left_semi")
        for k in keys & set(child.columns):
            out = _deleted(out, fk.table, lost.select(F.col(k).alias("_gone")).where("_gone IS NOT NULL").distinct(), k, graph, (*through, fk.table))
        out[fk.table] = out[fk.table].join(gone, hit, "left_anti")
    out[name] = out[name].join(gone, F.col(key) == F.col("_gone"), "left_anti")
    return out


def merged_profiles(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """All tables after profiles are merged, ``pairs`` being (source, target), no target being a source.

    Samples and assignments follow; the id lists of participants are re-pointed, each id once and in order; a project's weight of
    ``voice:source`` is added to ``voice:target``'s; a source profile stays, marked with its target.
    """
    out = dict(tables)
    for name in ("samples", "assignments"):
        if name in out:
            out[name] = merge_entities(out[name], pairs, "voice_profile_id")
    if "participants" in out:
        rows = out["participants"]
        keys = [c for c in rows.columns if c != "voice_profile_ids"]
        each = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode_outer("voice_profile_ids").alias("_id"))
        each = each.join(pairs.select(F.col("source").alias("_id"), "target"), "_id", "left").withColumn("_id", F.coalesce("target", "_id"))
        lists = F.array_sort(F.collect_set("_id")).alias("voice_profile_ids")
        out["participants"] = each.groupBy("_row", *keys).agg(lists).select(rows.columns)
    if "weights" in out:
        rows = out["weights"]
        words = pairs.select(F.concat(F.lit("voice:"), "source").alias("keyword"), F.concat(F.lit("voice:"), "target").alias("_target"))
        moved = rows.join(words, "keyword", "left").withColumn("keyword", F.coalesce("_target", "keyword"))
        out["weights"] = moved.groupBy("project_id", "keyword").agg(F.sum("weight").alias("weight")).select(rows.columns)
    if "profiles" in out:
        rows = out["profiles"]
        marked = rows.join(pairs.select(F.col("source").alias("id"), F.col("target").alias("_target")), "id", "left")
        before = F.col("merged_into") if "merged_into" in rows.columns else F.lit(None).cast("long")
        out["profiles"] = marked.withColumn("merged_into", F.coalesce("_target", before)).drop("_target")
    return out
