"""Routing to projects, speaker identities, and the one-to-one assignment of voices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import half_up

#: Weights of a project score's parts, what a name match counts, and what training adds.
PARTS = {"cal": 0.40, "party": 0.15, "tag": 0.30, "voice": 0.15}
NAME_SCORES = {"cal": 0.4, "party": 0.0, "tag": 0.35, "voice": 0.0}
TRAINING = {"cal": 1.0, "party": 0.6, "tag": 0.8, "voice": 1.2}
AUTO_SELECT = 0.65


def routing_scores(signals: DataFrame, weights: DataFrame, projects: DataFrame, *, full: float = 3.0) -> DataFrame:
    """(recording_id, project_id, score) for every project that knows a token of a recording.

    ``signals`` has recording_id, part and token; ``weights`` project_id, keyword (``part:token``)
    and weight; ``projects`` id and name_tokens. A token counts min(weight / full, 1), or what its
    part gives for one in the project's name; a part's score is the mean over its tokens, and a
    project's the weighted mean over the parts that the recording has. Projects that know no
    token score 0 and have no row.
    """
    tokens = signals.select("recording_id", "part", "token").distinct()
    sizes = tokens.groupBy("recording_id", "part").agg(F.count("*").alias("tokens"))
    share = F.coalesce(*[F.when(F.col("part") == k, v) for k, v in PARTS.items()])
    whole = sizes.groupBy("recording_id").agg(F.sum(share).alias("whole"))
    learned = weights.where("weight > 0").select("project_id", F.split_part("keyword", F.lit(":"), F.lit(1)).alias("part"), F.expr("substring(keyword, instr(keyword, ':') + 1)").alias("token"), F.least(F.col("weight") / full, F.lit(1.0)).alias("points"))
    named = projects.select(F.col("id").alias("project_id"), F.explode("name_tokens").alias("token")).crossJoin(F.broadcast(projects.sparkSession.createDataFrame([(k, v) for k, v in NAME_SCORES.items() if v], "part string, points double")))
    known = learned.unionByName(named.select("project_id", "part", "token", "points").join(learned.select("project_id", "part", "token"), ["project_id", "part", "token"], "left_anti"))
    hits = tokens.join(known, ["part", "token"]).groupBy("recording_id", "project_id", "part").agg(F.sum("points").alias("points"))
    means = hits.join(sizes, ["recording_id", "part"]).withColumn("mean", F.round(F.col("points") / F.col("tokens"), 4))
    sums = means.groupBy("recording_id", "project_id").agg(F.sum(F.col("mean") * share).alias("sum"))
    return sums.join(whole, "recording_id").select("recording_id", "project_id", F.round(F.col("sum") / F.col("whole"), 4).alias("score"))


def routing_choice(scores: DataFrame, projects: DataFrame) -> DataFrame:
    """The best project of each recording, its lead, and whether it is sure enough to be chosen."""
    w = Window.partitionBy("recording_id").orderBy(F.desc("score"), "name", "project_id")
    ranked = scores.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id").withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = ranked.groupBy("recording_id").agg(F.max(F.when(F.col("r") == 1, F.col("project_id"))).alias("project_id"), F.max("score").alias("score"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("next_score"))
    # 0.75 of the score and 0.25 of the lead, in whole ten-thousandths
    top, second = (F.round(F.col(c) * 10_000).cast("long") for c in ("score", "next_score"))
    sure = half_up(F.greatest(F.lit(0), F.least(F.lit(40_000), top * 4 - second)), F.lit(4)) / 10_000
    rows = best.withColumn("confidence", F.when(F.col("score") > 0, sure))
    return rows.select("recording_id", "project_id", "score", "confidence", (F.coalesce("confidence", F.lit(0.0)) >= AUTO_SELECT).alias("selected"))


def training_deltas(signals: DataFrame, chosen: DataFrame) -> DataFrame:
    """What choosing projects by hand (recording_id, project_id) adds to their keywords."""
    tokens = signals.select("recording_id", "part", "token").distinct().join(chosen, "recording_id")
    gain = F.coalesce(*[F.when(F.col("part") == k, v) for k, v in TRAINING.items()])
    return tokens.groupBy("project_id", F.concat_ws(":", "part", "token").alias("keyword")).agg(F.sum(gain).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where a length differs or a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def centroids(samples: DataFrame, *, by: str = "voice_profile_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of each profile: place by place, so that no profile's vectors are gathered."""
    places = samples.where(F.col(by).isNotNull()).select(by, F.posexplode(vector).alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("x"))
    return places.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).select(by, F.col("v.x").alias("centroid"))


def cosine_pairs(vectors: DataFrame, *, by: str = "voice_profile_id", vector: str = "centroid") -> DataFrame:
    """Cosine of every two profiles. The result is every pair, so this is for profiles, not for samples."""
    a = vectors.select(F.col(by).alias("a"), F.col(vector).alias("va"))
    b = vectors.select(F.col(by).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).where("similarity IS NOT NULL")


def best_candidates(samples: DataFrame, vectors: DataFrame, *, keep: int = 3, vector: str = "embedding") -> DataFrame:
    """The ``keep`` profiles nearest to each sample: a stated, bounded set of profiles against all samples."""
    known = vectors.select(F.col("voice_profile_id").alias("candidate"), "centroid")
    scored = samples.select("sample_id", "voice_profile_id", vector).crossJoin(known)
    key = F.struct((-F.round(cosine(F.col(vector), F.col("centroid")), 4)).alias("rank"), "candidate")
    scored = scored.select("sample_id", "voice_profile_id", key.alias("k"))
    w = Window.partitionBy("sample_id").orderBy("k")
    return scored.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= keep).select("sample_id", "voice_profile_id", "position", F.col("k.candidate").alias("candidate"), (-F.col("k.rank")).alias("score"))


def all_candidates(samples: DataFrame, vectors: DataFrame, *, least: float, vector: str = "embedding", block: int = 256) -> DataFrame:
    """Every profile whose rounded score with a sample is ``least`` or more, however many there are.

    Profiles are gathered in blocks by a hash of about ``block`` of them, so that what the join deals
    out for each sample is a row a block and only pairs that reach ``least`` are made.
    """
    blocks = max(1, -(-vectors.count() // block))
    known = vectors.groupBy(F.pmod(F.xxhash64("voice_profile_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct(F.col("voice_profile_id").alias("candidate"), "centroid")).alias("known"))
    rows = samples.select("sample_id", "voice_profile_id", F.col(vector).alias("v")).crossJoin(known)
    scored = F.transform("known", lambda k: F.struct(k["candidate"].alias("candidate"), F.round(cosine(F.col("v"), k["centroid"]), 4).alias("score")))
    near = F.filter(scored, lambda x: x["score"] >= least)
    return rows.select("sample_id", "voice_profile_id", F.explode(near).alias("x")).select("sample_id", "voice_profile_id", "x.candidate", "x.score")


def duplicate_profiles(candidates: DataFrame, *, least: float = 0.0) -> DataFrame:
    """Pairs (source, target): samples of one profile that resemble another, each sample once."""
    rows = candidates.where((F.col("voice_profile_id") != F.col("candidate")) & (F.col("score") >= least))
    once = rows.groupBy("sample_id", F.col("voice_profile_id").alias("source"), F.col("candidate").alias("target")).agg(F.max("score").alias("score"))
    return once.groupBy("source", "target").agg(F.count("*").alias("match_count"), F.max("score").alias("best_score"))


def attach(candidates: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """Samples go to their best candidate if it is near enough, else they need review."""
    best = candidates.where("position = 1")
    near = F.col("score") >= threshold
    return best.select("sample_id", F.when(near, F.col("candidate")).alias("voice_profile_id"), "score", (~near).alias("needs_review"))


def assign_one_to_one(candidates: DataFrame, *, least: float = 0.75) -> DataFrame:
    """Each recording's speakers to different profiles with the greatest total score.

    Of equal totals the one with more assignments wins, then the one with smaller profiles from the
    first speaker on. ``candidates`` has recording_id, speaker, voice_profile_id and score; one
    recording's candidates are solved in one grouped call, speaker by speaker over sets of
    profiles taken, so a recording is to have some tens of candidates at most.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        speakers = sorted(rows["speaker"].unique())
        options = {s: [] for s in speakers}
        best_any = rows.groupby("speaker")["score"].max()
        for s, p, v in zip(rows["speaker"], rows["voice_profile_id"], rows["score"], strict=True):
            if v >= least:
                options[s].append((int(p), float(v)))
        # states: profiles taken -> (total, count, choices); none sorts after every profile
        states = {frozenset(): (0.0, 0, ())}
        for s in speakers:
            new: dict = {}
            for taken, (total, n, picks) in states.items():
                for p, v in [(None, 0.0), *options[s]]:
                    if p in taken:
                        continue
                    key = taken if p is None else taken | {p}
                    state = (total + v, n + (p is not None), (*picks, p))
                    if key not in new or better(state, new[key]):
                        new[key] = state
            states = new
        final = None
        for state in states.values():
            if final is None or better(state, final):
                final = state
        score = {(s, p): v for s in speakers for p, v in options[s]}
        rid = rows["recording_id"].iloc[0]
        out = [(rid, s, p, score[s, p] if p is not None else float(best_any[s]), p is None) for s, p in zip(speakers, final[2], strict=True)]
        frame = pd.DataFrame(out, columns=["recording_id", "speaker", "voice_profile_id", "confidence", "low_confidence"])
        return frame.astype({"voice_profile_id": "Int64"})

    def better(a: tuple, b: tuple) -> bool:
        order = lambda x: (round(x[0], 6), x[1], tuple(-(10**9 if p is None else p) for p in x[2]))
        return order(a) > order(b)

    once = candidates.groupBy("recording_id", "speaker", "voice_profile_id").agg(F.max("score").alias("score"))
    return once.groupBy("recording_id").applyInPandas(solve, "recording_id string, speaker string, voice_profile_id long, confidence double, low_confidence boolean")
