"""Queries over texts, metrics, projects and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import metrics, people, text
from colloquy.plans.sql import BLOCKS, SEGMENTS
from colloquy.sources.tables import conversation_turns, keyword_weights, projects, segments, table, voice_samples


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dedup_sentences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_plan(table(spark, sf_dir, "documents"), "doc_id")


def first_wins_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal whole texts in a source, the one with the least id."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return text.first_wins(docs, ["source"], "text", ["doc_id"])


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.json_object(F.concat(F.lit("answer: "), "props", F.lit(" end")))
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object(found, "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.countDistinct("k").alias("kinds"))


def turn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term density of every speaker role, the benchmark's words being the domain."""
    domain = table(spark, sf_dir, "benchmark").select(F.explode(metrics.terms(F.col("text"))).alias("term"))
    return metrics.term_density(conversation_turns(spark, sf_dir), domain, ["recording_id", "speaker"])


def cue_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues and question marks of each language's documents."""
    docs = table(spark, sf_dir, "documents").groupBy("lang")
    return docs.agg(F.sum(metrics.signals(F.col("text"))).alias("signals"), F.sum(metrics.question_marks(F.col("text"))).alias("questions"), F.count("*").alias("docs"))


def apportion_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 questions of each recording dealt to its speakers by their number of segments."""
    counts = segments(spark, sf_dir).groupBy("recording_id", "speaker").agg(F.count("*").alias("n")).withColumn("total", F.lit(100).cast("long"))
    return metrics.apportion(counts, ["recording_id"], "total", "n", "speaker").select("recording_id", "speaker", "n", "share")


def participant_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by airtime and turns; sign-ups stand for questions and purchases for cues."""
    from colloquy.operators.turns import airtime, merged_blocks

    rows = segments(spark, sf_dir)
    spoken = airtime(merged_blocks(rows, gap_ms=60_000))
    marks = rows.groupBy("recording_id", "speaker").agg(F.count_if(F.col("text") == "signup").alias("questions"), F.count_if(F.col("text") == "purchase").alias("cues"))
    w = Window.partitionBy("recording_id")
    mean = F.round(F.col("airtime_ms") / 1000 / F.col("turns"), 3)
    both = spoken.join(marks, ["recording_id", "speaker"]).withColumn("mean_sec", mean)
    both = both.withColumns({"share": F.round(F.col("airtime_ms") / F.sum("airtime_ms").over(w), 4), "avg_turns": F.sum("turns").over(w) / F.count("*").over(w), "avg_sec": F.avg("mean_sec").over(w), "all_q": F.sum("questions").over(w)})
    role = metrics.role_hint(F.col("share"), F.col("turns"), F.col("questions"), F.col("cues"), F.col("mean_sec"), F.lit(0.0), F.col("avg_turns"), F.col("avg_sec"), F.col("all_q"))
    return both.select("recording_id", "speaker", "turns", "questions", "cues", role.alias("role_hint"))


def speaker_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people.centroids(voice_samples(spark, sf_dir))
    return rows.select("voice_profile_id", F.posexplode("centroid").alias("place", "x")).select("voice_profile_id", "place", F.round("x", 6).alias("x"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people.cosine_pairs(people.centroids(voice_samples(spark, sf_dir)))
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = voice_samples(spark, sf_dir)
    return people.best_candidates(samples, people.centroids(samples))


def _eligible(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    samples = voice_samples(spark, sf_dir)
    return people.all_candidates(samples, people.centroids(samples), least=least)


def candidate_best_per_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("sample_id", "position", "candidate", "score")


def duplicate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate that a sample resembles at all counts."""
    return people.duplicate_profiles(_eligible(spark, sf_dir, 0.0))


def samples_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.attach(_nearest(spark, sf_dir), threshold=0.5)


def assign_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten samples are a recording, each a speaker."""
    # a score below ``least`` is needed only as the best of a speaker without any profile
    near = _nearest(spark, sf_dir).where("position = 1").select("sample_id", "voice_profile_id", "candidate", "score")
    rows = _eligible(spark, sf_dir, 0.2).unionByName(near)
    recording = F.floor(F.col("sample_id") / 10).cast("string").alias("recording_id")
    speaker = F.concat(F.lit("S"), (F.col("sample_id") % 10).cast("string")).alias("speaker")
    return people.assign_one_to_one(rows.select(recording, speaker, F.col("candidate").alias("voice_profile_id"), "score"), least=0.2)


def routing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as recordings, their event types and numbers as tags; project weights from all events."""
    rows = keyword_weights(spark, sf_dir)
    weights = rows.groupBy("project_id", "keyword").agg(F.sum("cents").alias("cents")).select("project_id", F.concat(F.lit("tag:"), "keyword").alias("keyword"), (F.col("cents") / 50_000.0).alias("weight"))
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.concat_ws(":", "event_type", (F.get_json_object("props", "$.k").cast("long") % 20).cast("string")).alias("token"))
    named = projects(spark, sf_dir).withColumn("name_tokens", F.array(F.lower("name")))
    scores = people.routing_scores(users.withColumn("part", F.lit("tag")), weights, named)
    return people.routing_choice(scores, named)


def training_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.lit("tag").alias("part"), F.col("event_type").alias("token"))
    chosen = users.select("recording_id", (F.col("recording_id") % 10).alias("project_id")).distinct()
    rows = people.training_deltas(users, chosen)
    return rows.select("project_id", "keyword", F.round("weight", 4).alias("weight"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glossary terms of their brands; a part's type words are its aliases."""
    rows = table(spark, sf_dir, "part")
    names = ("system", "speaker_bank", "manual", "project", "correction", "calendar")
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6).cast("int") + 1)
    return rows.select(F.col("p_brand").alias("group"), F.col("p_type").alias("canonical_text"), F.array("p_name").alias("aliases"), F.lit("product").alias("kind"), source.alias("source"))


def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.glossary_merge(_entries(spark, sf_dir))
    return rows.select("group", "key", "canonical_text", F.col("rank").cast("long").alias("rank"), F.array_join("sources", ",").alias("sources"), F.size("aliases").cast("long").alias("aliases"))


def glossary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.glossary_merge(_entries(spark, sf_dir)).select("group", "key", F.col("canonical_text").alias("term"), "rank")
    return text.glossary_prefix(rows, ["rank", "key"], budget=200).select("group", "term", F.col("used_chars").cast("long").alias("used_chars"))


def glossary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.glossary_fit(text.glossary_merge(_entries(spark, sf_dir)))
    return rows.select("group", "position", "canonical_text", F.array_join("aliases", "|").alias("aliases"), "truncated")


_W = "SELECT label::BIGINT AS voice_profile_id, i - 1 AS place, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2"
_CENT = f"w AS ({_W}), cen AS (SELECT voice_profile_id, list(x ORDER BY place) AS c FROM w GROUP BY 1)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_NEAR = f"""{_CENT}, sc AS (SELECT vec_id AS sample_id, label::BIGINT AS voice_profile_id, cen.voice_profile_id AS candidate, round({_COS.format('embedding::DOUBLE[]', 'c')}, 4) AS score FROM embeddings, cen), nr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, candidate) AS position FROM sc) WHERE position <= 3)"""
_GLOSS = """en AS (SELECT p_brand AS "group", p_type AS t, p_name AS al, (['system', 'speaker_bank', 'manual', 'project', 'correction', 'calendar'])[(p_partkey % 6)::INT + 1] AS source,
  CASE source WHEN 'manual' THEN 1 WHEN 'correction' THEN 2 WHEN 'project' THEN 3 WHEN 'calendar' THEN 4 WHEN 'speaker_bank' THEN 5 WHEN 'system' THEN 6 END AS rank FROM part), cl AS (
  SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS tx FROM en), mg AS (
  SELECT "group", lower(tx) AS key, first(tx ORDER BY rank, tx) AS canonical_text, min(rank)::BIGINT AS rank, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT al) AS aliases FROM cl WHERE tx <> '' GROUP BY 1, 2)"""
_TERMS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_-]{5,}'))"
_ROLES = f"""WITH {SEGMENTS}, {BLOCKS}, air AS (SELECT recording_id, speaker, sum(end_ms - start_ms)::BIGINT AS a, count(*) AS turns FROM blocks GROUP BY 1, 2),
mk AS (SELECT recording_id, speaker, count(*) FILTER (text = 'signup') AS q, count(*) FILTER (text = 'purchase') AS c FROM seg GROUP BY 1, 2), b AS (
  SELECT air.*, q, c, round(a / 1000::DOUBLE / turns, 3) AS m FROM air JOIN mk USING (recording_id, speaker)), d AS (
  SELECT *, round(a / (sum(a) OVER w)::DOUBLE, 4) AS sh, (sum(turns) OVER w) / (count(*) OVER w)::DOUBLE AS tpp, avg(m) OVER w AS am, sum(q) OVER w AS aq FROM b WINDOW w AS (PARTITION BY recording_id)), e AS (
  SELECT *, sh * 1.8::DOUBLE + least(c, 4) * 0.6::DOUBLE AS l, turns / greatest(tpp, 1.0) * 0.9::DOUBLE + q * 0.45::DOUBLE AS f, m / greatest(am, 1.0) * 0.8::DOUBLE AS x, (1.0 - sh) + greatest(0.0, 1.0 - turns / greatest(tpp, 1.0)) AS p FROM d)
SELECT recording_id, speaker, turns, q AS questions, c AS cues, CASE WHEN sh <= 0.15 AND turns <= greatest(1, round_even(tpp * 0.6::DOUBLE, 0)) THEN 'Passive' WHEN sh >= 0.35 AND c >= 1 THEN 'Leader'
  WHEN turns >= greatest(3, round_even(tpp * 1.15::DOUBLE, 0)) AND q >= greatest(1, round_even(aq * 0.3::DOUBLE, 0)) THEN 'Facilitator' WHEN FALSE THEN 'Expert' WHEN l = greatest(l, f, x, p) THEN 'Leader' WHEN f = greatest(l, f, x, p) THEN 'Facilitator'
  WHEN x = greatest(l, f, x, p) THEN 'Expert' ELSE 'Passive' END AS role_hint FROM e"""

QUERIES = {
    "sentence_dedup": (sentence_dedup, None),
    "chunk_plan": (chunk_plan, None),
    "first_wins_texts": (
        first_wins_texts,
        "SELECT source, doc_id, text FROM (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM documents) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1",
    ),
    "json_props_extract": (json_props, "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, count(DISTINCT k) AS kinds FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY 1"),
    "terminology_density": (
        turn_terms,
        f"""WITH dom AS (SELECT DISTINCT unnest({_TERMS}) AS term FROM benchmark), t AS (SELECT conv_id::VARCHAR AS recording_id, role AS speaker, unnest({_TERMS}) AS term FROM conversations)
SELECT recording_id, speaker, count(*) AS terms, count(dom.term) AS domain_terms, round(count(dom.term) / count(*)::DOUBLE, 4) AS density FROM t LEFT JOIN dom USING (term) GROUP BY 1, 2""",
    ),
    "cue_signals": (
        cue_signals,
        f"SELECT lang, sum(regexp_matches(lower(text), '{'|'.join(metrics.DECISION_CUES)}')::INT + regexp_matches(lower(text), '{'|'.join(metrics.TASK_CUES)}')::INT)::BIGINT AS signals, sum(length(text) - length(regexp_replace(text, '[?？]', '', 'g')))::BIGINT AS questions, count(*) AS docs FROM documents GROUP BY 1",
    ),
    "apportion_remainder": (
        apportion_remainder,
        f"""WITH {SEGMENTS}, c AS (SELECT recording_id, speaker, count(*) AS n FROM seg GROUP BY 1, 2), f AS (SELECT *, sum(n) OVER (PARTITION BY recording_id) AS w FROM c), g AS (SELECT *, (100 * n // w)::BIGINT AS fl, (100 * n) % w AS rest FROM f), h AS (
  SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY rest DESC, n DESC, speaker DESC) AS r, 100 - sum(fl) OVER (PARTITION BY recording_id) AS l FROM g) SELECT recording_id, speaker, n, (fl + (r <= l)::INT)::BIGINT AS share FROM h""",
    ),
    "participant_roles": (participant_roles, _ROLES),
    "speaker_centroids": (speaker_centroids, f"SELECT voice_profile_id, place::INT AS place, round(x, 6) AS x FROM ({_W})"),
    "cosine_pairs": (cosine_pairs, f"WITH {_CENT} SELECT a.voice_profile_id AS a, b.voice_profile_id AS b, round({_COS.format('a.c', 'b.c')}, 6) AS similarity FROM cen a JOIN cen b ON a.voice_profile_id < b.voice_profile_id"),
    "candidate_best_per_profile": (candidate_best_per_profile, f"WITH {_NEAR} SELECT sample_id, position, candidate, score FROM nr"),
    "duplicate_profiles": (duplicate_profiles, f"WITH {_NEAR} SELECT voice_profile_id AS source, candidate AS target, count(*) AS match_count, max(score) AS best_score FROM sc WHERE voice_profile_id <> candidate AND score >= 0 GROUP BY 1, 2"),
    "samples_attached": (samples_attached, f"WITH {_NEAR} SELECT sample_id, CASE WHEN score >= 0.5 THEN candidate END AS voice_profile_id, score, score < 0.5 AS needs_review FROM nr WHERE position = 1"),
    "assign_one_to_one": (assign_one_to_one, None),
    "routing_scores": (
        routing_scores,
        """WITH kw AS (SELECT user_id % 10 AS project_id, event_type || ':' || ((props->>'$.k')::BIGINT % 20) AS token, sum(round(value * 100)::BIGINT)::BIGINT / 50000::DOUBLE AS weight FROM events GROUP BY 1, 2), u AS (
  SELECT DISTINCT user_id AS recording_id, event_type || ':' || ((props->>'$.k')::BIGINT % 20) AS token FROM events), z AS (SELECT recording_id, count(*) AS n FROM u GROUP BY 1), s AS (
  SELECT u.recording_id, project_id, round(sum(least(weight / 3.0::DOUBLE, 1.0)) / any_value(n), 4) AS m FROM u JOIN kw USING (token) JOIN z ON z.recording_id = u.recording_id WHERE weight > 0 GROUP BY 1, 2), p AS (
  SELECT recording_id, project_id, round(m * 0.30::DOUBLE / 0.30::DOUBLE, 4) AS score, row_number() OVER (PARTITION BY recording_id ORDER BY round(m * 0.30::DOUBLE / 0.30::DOUBLE, 4) DESC, n_name, project_id) AS r FROM s JOIN nation ON n_nationkey = project_id), q AS (
  SELECT recording_id, max(project_id) FILTER (r = 1) AS project_id, max(score) AS score, coalesce(max(score) FILTER (r = 2), 0.0) AS nx FROM p WHERE r <= 2 GROUP BY 1), c AS (
  SELECT *, CASE WHEN score > 0 THEN ((greatest(0, least(40000, 4 * round(score * 10000)::BIGINT - round(nx * 10000)::BIGINT)) * 2 + 4) // 8) / 10000::DOUBLE END AS confidence FROM q) SELECT recording_id, project_id, score, confidence, coalesce(confidence, 0.0) >= 0.65 AS selected FROM c""",
    ),
    "routing_training": (training_deltas, "WITH t AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id % 10 AS project_id, 'tag:' || event_type AS keyword, round(sum(0.8::DOUBLE), 4) AS weight FROM t GROUP BY 1, 2"),
    "glossary_merge": (glossary_merge, f"WITH {_GLOSS} SELECT * FROM mg"),
    "glossary_budget_join": (
        glossary_budget,
        f'WITH {_GLOSS}, u AS (SELECT "group", canonical_text AS term, (sum(length(canonical_text) + 2) OVER (PARTITION BY "group" ORDER BY rank, key ROWS UNBOUNDED PRECEDING) - 2)::BIGINT AS used_chars FROM mg) SELECT * FROM u WHERE used_chars <= 200',
    ),
    "glossary_fit": (glossary_fit, None),
}
