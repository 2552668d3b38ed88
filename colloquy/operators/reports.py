"""Diagnostics of recordings, merged extracts, compact transcripts, and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import clean, clock
from colloquy.operators.turns import merge_turns

#: How many items of each kind a merged extract keeps.
LIMITS = {"topic": 12, "bullet": 40, "decision": 40, "cue": 12, "question": 30, "action": 30}
#: Which state of a chunk is looked at first, and which source of a cause.
CHUNK_PRIORITY = {"running": 5, "cancelled": 4, "failed": 3, "split": 2, "completed": 1}
SOURCE_PRIORITY = {"recording": 3, "stage": 2, "chunk": 1}
#: How much a cause's code says; others say 2.
VAGUE_CODES = {"job_retry_limit_reached": 0, "processing_runtime_error": 1}


def ranked(value: Column, ranks: dict[str, int], other: int = 0) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in ranks.items()], F.lit(other))


def _latest(states: DataFrame) -> list[Column]:
    """What orders rows in time: when they were updated, finished and started, of those times that there are."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("updated_at", "finished_at", "started_at") if c in states.columns]


def current_rows(states: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The stage row that tells most about a recording: the one it says it is in, else the latest; ties go to the greatest name."""
    match = F.coalesce(F.col("stage_name") == wanted, F.lit(False)) if wanted is not None else F.lit(False)
    key = F.struct(match.cast("int").alias("match"), *[c.alias(f"at{k}") for k, c in enumerate(_latest(states))], "stage_name")
    return states.groupBy("recording_id").agg(F.max_by(F.struct("stage_name", "status", "updated_at"), key).alias("s")).select("recording_id", "s.*")


def current_chunks(states: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The chunk row of each recording: the one it says it is in, else by state, then the latest; ties go to the greatest index."""
    match = F.coalesce(F.col("chunk_index") == wanted, F.lit(False)) if wanted is not None else F.lit(False)
    times = [c.alias(f"at{k}") for k, c in enumerate(_latest(states))]
    key = F.struct(match.cast("int").alias("match"), ranked(F.col("status"), CHUNK_PRIORITY).alias("state"), *times, "chunk_index")
    return states.groupBy("recording_id").agg(F.max_by(F.struct("chunk_index", "status", "updated_at"), key).alias("s")).select("recording_id", "s.*")


def root_causes(causes: DataFrame) -> DataFrame:
    """The cause of each recording: a stop first, then the more specific code, then the source; ties go to the greatest code and source."""
    source, code = F.col("source"), F.col("code")
    key = F.struct((source == "stop").cast("int").alias("stop"), ranked(code, VAGUE_CODES, 2).alias("says"), ranked(source, SOURCE_PRIORITY).alias("from"), "code", "source")
    return causes.where("code IS NOT NULL").groupBy("recording_id").agg(F.max_by(F.struct("source", "code"), key).alias("c")).select("recording_id", "c.*")


def merge_extracts(items: DataFrame) -> DataFrame:
    """Items (recording_id, kind, chunk, place, text) of chunks as one: the first of equal texts, up to each kind's limit."""
    rows = items.withColumn("text", clean(F.col("text"))).where("text IS NOT NULL")
    first = rows.groupBy("recording_id", "kind", F.lower("text").alias("key")).agg(F.min(F.struct("chunk", "place", "text")).alias("x"))
    w = Window.partitionBy("recording_id", "kind").orderBy("x")
    limit = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in LIMITS.items()], F.lit(30))
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).select("recording_id", "kind", "position", "x.text")


#: Names that say nothing, and how long a label may be.
GENERIC, MOST_CHARS, MOST_WORDS = r"(?i)^(speaker|spk|s)[\s_-]*\d+$", 10, 2


def concise(name: Column) -> Column:
    """Whether a name can stand as a label: short, of letters, digits and ``-_'``, and not a mere number of a speaker."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    short = (F.length(plain) <= MOST_CHARS) & (F.size(F.split(plain, " ")) <= MOST_WORDS)
    return F.coalesce((plain != "") & short & ~plain.rlike(GENERIC) & plain.rlike(r"^[\p{L}\p{N} _'-]+$"), F.lit(False))


def compact_transcript(turns: DataFrame, *, aliases: DataFrame | None = None, gap_ms: int = 1000) -> DataFrame:
    """Turns with something said, merged by speaker, with short labels by order of appearance.

    A speaker is called by the name that ``aliases`` (recording_id, speaker, name) have, else by its own, if that is concise and no speaker
    before has it in the recording; else S and its place.
    """
    merged = merge_turns(turns.where(F.col("text").rlike(r"[\p{L}\p{N}]")), gap_ms=gap_ms)
    firsts = merged.groupBy("recording_id", "speaker").agg(F.min(F.struct("start_ms", "end_ms", "speaker", "seq")).alias("at"))
    if aliases is not None:
        firsts = firsts.join(aliases.select("recording_id", "speaker", "name"), ["recording_id", "speaker"], "left")
    name = F.coalesce("name", "speaker") if aliases is not None else F.col("speaker")
    order = F.row_number().over(Window.partitionBy("recording_id").orderBy("at"))
    taken = F.row_number().over(Window.partitionBy("recording_id", name).orderBy("at"))
    label = F.when(concise(name) & (taken == 1), name).otherwise(F.concat(F.lit("S"), order.cast("string")))
    rows = merged.join(firsts.select("recording_id", "speaker", label.alias("label")), ["recording_id", "speaker"])
    return rows.select("recording_id", "label", "start_ms", "end_ms", F.concat(F.col("label"), F.lit(": "), F.col("text")).alias("line"))


def transcript_lines(turns: DataFrame) -> DataFrame:
    return turns.select("recording_id", "start_ms", "seq", F.concat(F.lit("- ["), clock(F.col("start_ms") / 1000), F.lit("] **"), F.col("speaker"), F.lit("**: "), F.col("text")).alias("line"))


def markdown(recordings: DataFrame, turns: DataFrame) -> DataFrame:
    """One text per recording: title, state, and its transcript in order. A recording's turns must fit a row."""
    lines = transcript_lines(turns).groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start_ms", "seq", "line")))["line"], "\n").alias("transcript"))
    rows = recordings.select(F.col("id").cast("string").alias("recording_id"), "source_filename", "status").join(lines, "recording_id", "left")
    body = F.concat(F.lit("# "), "source_filename", F.lit("\n\n- Status: "), "status", F.lit("\n\n## Transcript\n\n"), F.coalesce("transcript", F.lit("(none)")), F.lit("\n"))
    return rows.select("recording_id", body.alias("markdown"))


def missing_artifacts(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required (recording_id, stage_name, artifact) that aren't there."""
    return required.join(present, ["recording_id", "stage_name", "artifact"], "left_anti")


def before_after(db_rows: DataFrame, artifact_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' rows by key; where both have a value, the first side's counts."""
    a, b = db_rows.alias("a"), artifact_rows.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in db_rows.columns])
