"""Queries over chunk states, claimed segments, and deletes and merges through several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import backfills, cascades, chunks, claims, voices
from colloquy.plans.sql import SEGMENTS
from colloquy.sources.tables import jobs, projects, recordings, segments, table, voice_samples


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, those of one order and number as one."""
    least = [F.min(c).alias(c) for c in ("l_shipdate", "l_suppkey", "l_returnflag", "l_linestatus")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least, F.sum("l_quantity").cast("long").alias("l_quantity"))


def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of their orders: shipping starts them, days later they end, some are started again; every third one was planned before."""
    days = lambda n: F.col("l_shipdate") + F.make_dt_interval(n.cast("int"))
    rows = _lines(spark, sf_dir).withColumns({"l_receiptdate": days(F.col("l_linenumber") + 1), "l_commitdate": days(F.col("l_suppkey") % 9)})
    key = [F.col("l_orderkey").alias("recording_id"), F.lit(" Extract").alias("chunk_group"), F.col("l_linenumber").cast("string").alias("chunk_index")]
    ended = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "cancelled").otherwise("Completed")
    late = F.when(F.col("l_receiptdate") > F.col("l_commitdate"), "late")
    nothing = F.lit(None).cast("string")

    def mark(seq: int, at: str, status: object, error: object, parent: object, kept: str) -> DataFrame:
        return rows.where(kept).select(*key, F.lit(seq).alias("seq"), F.col(at).alias("at"), F.lit(status).alias("status"), error.alias("error"), parent.alias("parent"), F.col("l_linestatus").alias("transcript_hash"))

    marks = mark(1, "l_shipdate", "running", nothing, nothing, "l_linenumber % 4 > 0")
    marks = marks.unionByName(mark(2, "l_receiptdate", ended, late, F.when(F.col("l_linenumber") > 1, "1"), "l_linenumber < 7")).unionByName(mark(3, "l_commitdate", "running", nothing, nothing, "l_linenumber % 5 = 0"))
    none = {c: F.lit(None).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")}
    states = rows.where("l_linenumber % 3 = 0").select(*key, F.lit("planned").alias("status"), (F.col("l_linenumber") % 2).cast("long").alias("attempt"), *none.values(), nothing.alias("error"), F.lit("root").alias("parent"), F.lit("old").alias("transcript_hash"))
    return chunks.after_marks(states, marks).drop("chunk_group")


def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line item of 45 pieces or more can go on with those that weren't split."""
    rows = _lines(spark, sf_dir)
    path = F.array((F.col("l_linenumber") % 3 + 1).cast("long"), F.col("l_linenumber").cast("long"))
    status = F.when(F.col("l_linenumber") % 4 == 0, "split").otherwise("completed")
    held = F.when(F.col("l_quantity") < 45, "h").otherwise("other")
    rows = rows.select(F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").cast("string").alias("chunk_index"), status.alias("status"), path.alias("order_path"), held.alias("transcript_hash"), F.lit("h").alias("current_hash"), F.col("l_linestatus").alias("text"), F.col("l_linestatus").alias("base_text"))
    return chunks.resumable(rows).select("recording_id", "chunk_index", "position")


def best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the line items of each order part into two sides of about equal quantity."""
    return chunks.best_split(_lines(spark, sf_dir), ["l_orderkey"], order="l_linenumber", size="l_quantity")


def claimed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that lie within ten minutes of a sign-up go to the first such sign-up."""
    rows = segments(spark, sf_dir)
    ranges = rows.where("text = 'signup'").select("recording_id", F.col("seq").alias("place"), (F.col("start_ms") - 600_000).alias("start_ms"), (F.col("end_ms") + 600_000).alias("end_ms"))
    return claims.claimed(rows, ranges).select("recording_id", "seq", "place")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of five tables after a region's projects and every tenth recording are deleted."""
    samples = voice_samples(spark, sf_dir).select("sample_id", (F.col("sample_id") % 1000).alias("recording_id"), "voice_profile_id")
    weights = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("project_id"), F.col("s_suppkey").alias("keyword"))
    tables = {"projects": projects(spark, sf_dir), "recordings": recordings(spark, sf_dir), "jobs": jobs(spark, sf_dir), "samples": samples, "weights": weights}
    region = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id"))
    tables = cascades.deleted(tables, "projects", region)
    tables = cascades.deleted(tables, "recordings", tables["recordings"].where("id % 10 = 0"))
    out = None
    for name, empty in (("projects", None), ("recordings", "project_id"), ("jobs", None), ("samples", "recording_id"), ("weights", None)):
        counted = tables[name].agg(F.count("*").alias("n"), (F.count_if(F.col(empty).isNull()) if empty else F.lit(0)).cast("long").alias("emptied")).withColumn("table_name", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd profiles merge into the even ones before them: participants' lists and projects' weights follow."""
    samples = voice_samples(spark, sf_dir).select("sample_id", "voice_profile_id")
    participants = samples.groupBy(F.floor(F.col("sample_id") / 3).alias("id")).agg(F.array_sort(F.collect_set("voice_profile_id")).alias("voice_profile_ids"))
    weights = samples.groupBy((F.col("sample_id") % 5).alias("project_id"), F.concat(F.lit("voice:"), "voice_profile_id").alias("keyword")).agg(F.count("*").alias("weight"))
    pairs = samples.select(F.col("voice_profile_id").alias("source")).distinct().where("source % 2 = 1").withColumn("target", F.col("source") - 1)
    out = cascades.merged_profiles({"participants": participants, "weights": weights}, pairs)
    lists = out["participants"].select(F.lit("participant").alias("kind"), F.col("id"), F.array_join(F.col("voice_profile_ids").cast("array<string>"), ",").alias("value"))
    return lists.unionByName(out["weights"].select(F.lit("weight").alias("kind"), F.col("project_id").alias("id"), F.concat_ws("=", "keyword", F.col("weight").cast("string")).alias("value")))


def _numbers() -> voices.Model:
    """Stands in for a model: numbers that follow from the times, two places for every seventh start."""
    return lambda _, start, end: [[float(start % 97), float(end % 89), float(k)][: 2 if start % 7 == 0 else 3] for k in (1, 3)]


def speaker_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = voices.longest_crops(segments(spark, sf_dir))
    found = voices.speaker_vectors(voices.embedded(crops, _numbers))
    rounded = F.transform("vector", lambda x: F.round(x, 6))
    return found.select("recording_id", "speaker", "crops", F.array_join(rounded.cast("array<string>"), " ").alias("vector"))


def backfilled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles, every second one without times; their orders as samples."""
    rows = table(spark, sf_dir, "customer")
    known = F.when(F.col("c_custkey") % 2 == 0, F.to_timestamp_ntz(F.lit("1995-05-05")))
    profiles = rows.select(F.col("c_custkey").alias("id"), known.alias("created_at"), F.when(F.col("c_custkey") % 3 == 0, F.to_timestamp_ntz(F.lit("2001-01-01"))).alias("updated_at"))
    samples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("voice_profile_id"), F.col("o_orderdate").alias("created_at"))
    return backfills.dated_profiles(profiles, samples)


def placeholder_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of which urgent ones go that were queued within a year of their recording's first job."""
    rows = jobs(spark, sf_dir).withColumns({"started_at": F.when(F.col("id") % 5 == 0, F.col("created_at")), "finished_at": F.lit(None).cast("timestamp_ntz")})
    made = rows.groupBy(F.col("recording_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return backfills.without_placeholders(rows, made, seconds=365 * 86400.0, types=("1-URGENT", "2-HIGH")).select("id", "type", "status")


_LINES = "line AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, sum(l_quantity)::BIGINT AS l_quantity FROM lineitem GROUP BY 1, 2)"

QUERIES = {
    "speaker_vectors": (
        speaker_vectors,
        f"""WITH {SEGMENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY end_ms - start_ms DESC, start_ms, seq) AS place FROM seg WHERE end_ms > start_ms
), c AS (SELECT recording_id, speaker, place, CASE WHEN end_ms - start_ms > 3000 THEN (start_ms + end_ms - 3000) // 2 ELSE start_ms END AS s, CASE WHEN end_ms - start_ms > 3000 THEN (start_ms + end_ms - 3000) // 2 + 3000 ELSE end_ms END AS e FROM t WHERE place <= 5
), v AS (SELECT recording_id, speaker, place, CASE WHEN s % 7 = 0 THEN [s % 97, e % 89] ELSE [s % 97, e % 89, 2] END AS v FROM c
), z AS (SELECT recording_id, speaker, arg_min(len(v), place) AS size FROM v GROUP BY 1, 2
), a AS (SELECT recording_id, speaker, i, round(avg(v[i]), 6) AS x, count(*) AS n FROM (SELECT v.*, unnest(range(1, len(v) + 1)) AS i FROM v JOIN z USING (recording_id, speaker) WHERE len(v) = size) GROUP BY 1, 2, 3)
SELECT recording_id, speaker, max(n) AS crops, string_agg(x::VARCHAR, ' ' ORDER BY i) AS vector FROM a GROUP BY 1, 2""",
    ),
    "backfilled_profiles": (
        backfilled_profiles,
        """WITH f AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1), p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1995-05-05' ELSE coalesce(d, TIMESTAMP '1970-01-01') END AS created_at FROM customer LEFT JOIN f ON o_custkey = c_custkey)
SELECT *, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2001-01-01' ELSE created_at END AS updated_at FROM p""",
    ),
    "placeholder_jobs": (
        placeholder_jobs,
        """WITH j AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS made FROM orders)
SELECT o_orderkey AS id, o_orderpriority AS type, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'started' WHEN 'F' THEN 'finished' END AS status FROM j
WHERE NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_orderkey % 5 > 0 AND o_orderdate <= made + INTERVAL 365 DAY)""",
    ),
    "chunk_states": (
        chunk_states,
        f"""WITH {_LINES}, l AS (SELECT l_orderkey AS recording_id, l_linenumber AS k, l_shipdate AS s, l_shipdate + to_days((l_linenumber + 1)::INT) AS r, l_shipdate + to_days((l_suppkey % 9)::INT) AS c, l_linestatus AS h, l_linenumber % 4 > 0 AS a, l_linenumber < 7 AS e, l_linenumber % 5 = 0 AS g, l_linenumber % 3 = 0 AS p,
  CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'cancelled' ELSE 'completed' END AS fin, CASE WHEN l_linenumber + 1 > l_suppkey % 9 THEN 'late' END AS late FROM line)
SELECT recording_id, k::VARCHAR AS chunk_index, CASE WHEN g THEN 'running' WHEN e THEN fin WHEN a THEN 'running' ELSE 'planned' END AS status,
  (CASE WHEN p THEN k % 2 ELSE 0 END + a::INT + g::INT + (NOT a AND e AND (NOT p OR k % 2 = 0))::INT)::BIGINT AS attempt,
  CASE WHEN g THEN c WHEN a THEN s WHEN e THEN r END AS started_at, CASE WHEN NOT g AND e THEN r END AS finished_at, CASE WHEN NOT g AND e THEN late END AS error,
  CASE WHEN e AND k > 1 THEN '1' WHEN p THEN 'root' END AS parent, CASE WHEN a OR e OR g THEN h WHEN p THEN 'old' END AS transcript_hash
FROM l WHERE a OR e OR g OR p""",
    ),
    "chunk_resume": (
        chunk_resume,
        f"""WITH {_LINES} SELECT l_orderkey AS recording_id, l_linenumber::VARCHAR AS chunk_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber) AS position FROM line
WHERE l_linenumber % 4 > 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM line WHERE l_quantity >= 45)""",
    ),
    "best_splits": (
        best_splits,
        f"""WITH {_LINES}, c AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, abs(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey) - 2 * sum(l_quantity::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)) AS d FROM line WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
b AS (SELECT l_orderkey, k FROM c WHERE k < n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY d, k) = 1)
SELECT o.l_orderkey, coalesce(k, 0)::BIGINT AS split FROM (SELECT DISTINCT l_orderkey FROM line) o LEFT JOIN b ON b.l_orderkey = o.l_orderkey""",
    ),
    "claimed_segments": (
        claimed_segments,
        f"""WITH {SEGMENTS}, r AS (SELECT recording_id, seq AS place, start_ms - 600000 AS low, end_ms + 600000 AS high FROM seg WHERE text = 'signup')
SELECT seg.recording_id, seq, min(place) AS place FROM seg JOIN r ON r.recording_id = seg.recording_id AND greatest(start_ms, end_ms) > low AND start_ms < high GROUP BY 1, 2""",
    ),
    "cascade_delete": (
        cascade_delete,
        """WITH g AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT 'projects' AS table_name, count(*) AS n, 0::BIGINT AS emptied FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT 'recordings', count(*), count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM g)) FROM customer WHERE c_custkey % 10 > 0
UNION ALL SELECT 'jobs', count(*), 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 = 0)
UNION ALL SELECT 'samples', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM customer WHERE c_custkey = vec_id % 1000 AND c_custkey % 10 = 0)) FROM embeddings
UNION ALL SELECT 'weights', count(*), 0 FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM g)""",
    ),
    "profile_merge": (
        profile_merge,
        """SELECT 'participant' AS kind, vec_id // 3 AS id, string_agg(DISTINCT (label - label % 2)::VARCHAR, ',' ORDER BY (label - label % 2)::VARCHAR) AS value FROM embeddings GROUP BY vec_id // 3
UNION ALL SELECT 'weight', vec_id % 5, 'voice:' || (label - label % 2) || '=' || count(*) FROM embeddings GROUP BY vec_id % 5, label - label % 2""",
    ),
}
