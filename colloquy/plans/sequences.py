"""Queries over turn folding, reports, scalar functions, and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import scalars
from colloquy.operators import folding, reports
from colloquy.sources.tables import SEGMENT_STATUS, conversation_turns, jobs, recordings, segments, table
from colloquy.streaming import reaper, windows


def turns_short_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folding.merge_short_turns(conversation_turns(spark, sf_dir).na.fill("", ["text"]))


def turns_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folding.smooth_turns(segments(spark, sf_dir), gap_ms=60_000, least_ms=30_000)


def compact_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compact_transcript(conversation_turns(spark, sf_dir))


def recording_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    return reports.markdown(recordings(spark, sf_dir), turns)


def current_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs' priorities as stages and their states."""
    status = F.when(F.col("status") == "started", "running").when(F.col("status") == "queued", "planned").otherwise("completed")
    rows = jobs(spark, sf_dir).select("recording_id", F.concat_ws("-", "type", "id").alias("stage_name"), status.alias("status"), F.col("created_at").alias("updated_at"))
    return reports.current_rows(rows).select("recording_id", "stage_name", "status")


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of their orders."""
    status = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_linenumber") % 3 == 0, "split").when(F.col("l_linestatus") == "O", "running").otherwise("completed")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), status.alias("status"), F.col("l_shipdate").alias("updated_at"))
    return reports.current_chunks(rows).select("recording_id", "chunk_index", "status")


def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as causes of their orders' failures; parts as their sources."""
    source = F.coalesce(*[F.when(F.col("l_partkey") % 9 == k, v) for k, v in enumerate(("recording", "stage", "chunk", "stop"))], F.lit("job"))
    kind = F.col("l_linenumber") % 4
    code = F.when(kind == 0, "job_retry_limit_reached").when(kind == 1, "processing_runtime_error").otherwise(F.concat(F.lit("code_"), "l_returnflag"))
    return reports.root_causes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recording_id"), source.alias("source"), code.alias("code")))


def merged_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as bullets of their brands."""
    rows = table(spark, sf_dir, "part")
    items = rows.select(F.col("p_brand").alias("recording_id"), F.lit("bullet").alias("kind"), (F.col("p_partkey") % 5).alias("chunk"), F.col("p_partkey").alias("place"), F.col("p_type").alias("text"))
    return reports.merge_extracts(items).select("recording_id", F.col("position").cast("long").alias("position"), "text")


def scalar_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.language_code(F.concat("lang", F.lit("-XX"))).alias("code"), scalars.word_count(F.col("text")).cast("long").alias("words"), scalars.clock(F.col("n_chars")).alias("clock"), F.size(scalars.routing_tokens(F.col("source"))).cast("long").alias("tokens"), scalars.precheck(F.col("n_chars").cast("double"), F.lit(0.5), least_sec=1000.0).alias("quarantine"))


def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.activity_sessions(windows.event_batch(spark, sf_dir))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("events") == 1).alias("stale"), F.max("events").alias("longest"))


def tumbling_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.tumbling_ratio(windows.event_batch(spark, sf_dir))
    return rows.groupBy(F.date_format("start_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("windows"), F.sum("frames").alias("frames"), F.sum("loud").alias("loud"), F.max("frames").alias("most"))


def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' purchases as starts of jobs, their sign-ups and errors as ends: starts without either within twelve hours."""
    rows = windows.event_batch(spark, sf_dir).where("event_type IN ('purchase', 'signup', 'error')")
    command = F.when(F.col("event_type") == "purchase", "start").otherwise("end")
    until = rows.agg(F.max("ts")).first()[0]
    found = reaper.recovered(rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", command.alias("command")), "12 HOUR", until=F.lit(until))
    ntz = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(c)
    return found.select("job_id", ntz("started_at"), ntz("recovered_at"))


_STATUS = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_STATUS.items()) + " ELSE 'Failed' END"

QUERIES = {
    "stuck_jobs": (
        stuck_jobs,
        """WITH c AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'error'))
SELECT user_id AS job_id, ts AS started_at, ts + INTERVAL 12 HOUR AS recovered_at FROM c
WHERE event_type = 'purchase' AND (n > ts + INTERVAL 12 HOUR OR n IS NULL AND ts + INTERVAL 12 HOUR < (SELECT max(ts) FROM c))""",
    ),
    "turns_short_merge": (turns_short_merge, None),
    "turns_smooth": (turns_smooth, None),
    "compact_transcript": (
        compact_transcript,
        r"""WITH t AS (
  SELECT conv_id::VARCHAR AS recording_id, turn AS seq, role AS speaker, text, (sum(length(coalesce(text, '')) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS end_ms, length(coalesce(text, '')) * 60 AS n FROM conversations
), s AS (
  SELECT *, end_ms - n AS start_ms FROM t WHERE regexp_matches(text, '[\p{L}\p{N}]')
), c AS (
  SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER w)::INT AS changed, max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq)
), i AS (
  SELECT *, sum((changed = 1 OR start_ms > top + 1000)::INT) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS UNBOUNDED PRECEDING) AS island FROM c
), m AS (
  SELECT recording_id, island, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(seq) AS seq, string_agg(text, ' ' ORDER BY start_ms, end_ms, seq, text) AS text FROM i GROUP BY 1, 2
), f AS (
  SELECT recording_id, speaker, CASE WHEN length(speaker) <= 10 AND NOT regexp_matches(speaker, '(?i)^(speaker|spk|s)[\s_-]*[0-9]+$') AND regexp_matches(speaker, '^[\p{L}\p{N} _''-]+$') THEN speaker
    ELSE 'S' || row_number() OVER (PARTITION BY recording_id ORDER BY min(start_ms), speaker) END AS label FROM m GROUP BY recording_id, speaker
)
SELECT m.recording_id, label, start_ms, end_ms, label || ': ' || text AS line FROM m JOIN f ON f.recording_id = m.recording_id AND f.speaker = m.speaker""",
    ),
    "recording_reports": (
        recording_reports,
        f"""WITH rec AS (SELECT c_custkey::VARCHAR AS recording_id, c_name, {_STATUS} AS status FROM customer
), t AS (
  SELECT conv_id::VARCHAR AS recording_id, turn, role, text, (sum(length(coalesce(text, '')) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(coalesce(text, '')) * 60)::BIGINT AS ms FROM conversations
), l AS (
  SELECT *, ms // 1000 AS n FROM t
), g AS (
  SELECT recording_id, string_agg('- [' || CASE WHEN n >= 3600 THEN printf('%02d:', n // 3600) ELSE '' END || printf('%02d:%02d', n // 60 % 60, n % 60) || '] **' || role || '**: ' || text, chr(10) ORDER BY ms, turn) AS lines FROM l GROUP BY 1
)
SELECT rec.recording_id, '# ' || c_name || chr(10) || chr(10) || '- Status: ' || status || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || coalesce(lines, '(none)') || chr(10) AS markdown
FROM rec LEFT JOIN g ON g.recording_id = rec.recording_id""",
    ),
    "current_stages": (
        current_stages,
        """WITH s AS (SELECT o_custkey AS recording_id, o_orderpriority || '-' || o_orderkey AS stage_name, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'planned' ELSE 'completed' END AS status, o_orderdate AS u FROM orders)
SELECT recording_id, stage_name, status FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY u DESC, stage_name DESC) AS r FROM s) WHERE r = 1""",
    ),
    "current_chunks": (
        current_chunks,
        """WITH c AS (SELECT l_orderkey AS recording_id, l_linenumber AS chunk_index, CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'R' THEN 'cancelled' WHEN l_linenumber % 3 = 0 THEN 'split' WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END AS status, l_shipdate AS u FROM lineitem)
SELECT recording_id, chunk_index::BIGINT AS chunk_index, status FROM c
QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY CASE status WHEN 'running' THEN 5 WHEN 'cancelled' THEN 4 WHEN 'failed' THEN 3 WHEN 'split' THEN 2 ELSE 1 END DESC, u DESC, chunk_index DESC) = 1""",
    ),
    "root_causes": (
        root_causes,
        """WITH c AS (SELECT l_orderkey AS recording_id, CASE l_partkey % 9 WHEN 0 THEN 'recording' WHEN 1 THEN 'stage' WHEN 2 THEN 'chunk' WHEN 3 THEN 'stop' ELSE 'job' END AS source,
  CASE l_linenumber % 4 WHEN 0 THEN 'job_retry_limit_reached' WHEN 1 THEN 'processing_runtime_error' ELSE 'code_' || l_returnflag END AS code FROM lineitem)
SELECT recording_id, source, code FROM c QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY (source = 'stop') DESC,
  CASE code WHEN 'job_retry_limit_reached' THEN 0 WHEN 'processing_runtime_error' THEN 1 ELSE 2 END DESC,
  CASE source WHEN 'recording' THEN 3 WHEN 'stage' THEN 2 WHEN 'chunk' THEN 1 ELSE 0 END DESC, code DESC, source DESC) = 1""",
    ),
    "merged_extracts": (
        merged_extracts,
        """WITH f AS (SELECT p_brand AS recording_id, p_type AS text, p_partkey % 5 AS chunk, p_partkey AS place FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey % 5, p_partkey) = 1)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY chunk, place) AS position, text FROM f QUALIFY position <= 40""",
    ),
    "scalar_cleaners": (
        scalar_cleaners,
        """SELECT doc_id, lang AS code, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS words,
  CASE WHEN n_chars >= 3600 THEN printf('%02d:', n_chars // 3600) ELSE '' END || printf('%02d:%02d', n_chars // 60 % 60, n_chars % 60) AS clock, 1::BIGINT AS tokens, CASE WHEN n_chars < 1000 THEN 'duration_lt_1000s' END AS quarantine FROM documents""",
    ),
    "stale_jobs_sessions": (
        stale_sessions,
        """WITH g AS (SELECT user_id, ts, sum((p IS NULL OR ts >= p + INTERVAL 2 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
n AS (SELECT user_id, s, count(*) AS e FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, count(*) FILTER (e = 1) AS stale, max(e) AS longest FROM n GROUP BY 1""",
    ),
    "tumbling_speech_ratio": (
        tumbling_ratio,
        """WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS f, count(*) FILTER (value >= 30) AS l FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d') AS day, count(*) AS windows, sum(f)::BIGINT AS frames, sum(l)::BIGINT AS loud, max(f) AS most FROM w GROUP BY 1""",
    ),
}
