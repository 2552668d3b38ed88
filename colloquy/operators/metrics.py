"""Conversation metrics: questions, cues, terms, roles, and the rows that make up a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What hints at a decision, and at a task.
DECISION_CUES = ("decide", "decision", "agree", "approved", "approve", "commit", "resolved", "finalize")
TASK_CUES = ("action item", "follow up", "todo", "to-do", "next step", "owner", "deadline", "i will", "we will", "we need")


def has_cue(text: Column, cues: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(cues)), F.lit(False))


def signals(text: Column) -> Column:
    """One for a decision cue and one for a task cue."""
    return has_cue(text, DECISION_CUES).cast("long") + has_cue(text, TASK_CUES).cast("long")


def question_marks(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[?？]")), F.lit(0)).cast("long")


def terms(text: Column, least: int = 5) -> Column:
    """Distinct lower-case terms of at least so many letters, digits, hyphens and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_-]{{{least},}}"), F.lit(0)))


def term_density(turns: DataFrame, domain: DataFrame, by: list[str]) -> DataFrame:
    """Share of each group's turn terms that are domain terms (column term). Turns' terms are rows, so the domain may be any size."""
    rows = turns.select(*by, F.explode(terms(F.col("text"))).alias("term"))
    marked = rows.join(domain.select("term").distinct().withColumn("_in", F.lit(1)), "term", "left")
    return marked.groupBy(*by).agg(F.count("*").alias("terms"), F.count("_in").alias("domain_terms")).withColumn("density", F.round(F.col("domain_terms") / F.col("terms"), 4))


def actionability(items: Column) -> Column:
    """Share of action items with an owner and a deadline."""
    ready = F.filter(items, lambda x: (F.coalesce(F.trim(x["owner"]), F.lit("")) != "") & (F.coalesce(F.trim(x["deadline"]), F.lit("")) != ""))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, 0.0).otherwise(F.round(F.size(ready) / F.size(items), 4))


def apportion(df: DataFrame, by: list[str], total: str, weight: str, key: str) -> DataFrame:
    """Whole shares of a group's total by weight: largest remainders first, then larger weights, then later keys.

    Where all weights are zero, every key counts alike and earlier keys come first.
    """
    whole = F.sum(weight).over(Window.partitionBy(*by))
    n = F.count("*").over(Window.partitionBy(*by))
    even = whole <= 0
    rows = df.withColumns({"_even": even, "_w": F.when(even, 1).otherwise(F.col(weight)), "_all": F.when(even, n).otherwise(whole)})
    rows = rows.withColumns({"_floor": F.expr(f"{total} * _w div _all"), "_rest": F.expr(f"({total} * _w) % _all")})
    left = F.col(total) - F.sum("_floor").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), F.desc(weight), F.when(F.col("_even"), F.col(key)).asc_nulls_last(), F.desc(key)))
    rows = rows.withColumns({"_left": left, "_rank": rank})
    return rows.withColumn("share", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_even", "_w", "_all", "_floor", "_rest", "_left", "_rank")


def role_hint(share: Column, turns: Column, questions: Column, cues: Column, mean_turn_sec: Column, density: Column, avg_turns: Column, avg_turn_sec: Column, meeting_questions: Column) -> Column:
    """Passive, Leader, Facilitator or Expert: the first rule that holds, else the highest score."""
    few = F.greatest(F.lit(1), F.bround(avg_turns * 0.6, 0))
    many = F.greatest(F.lit(3), F.bround(avg_turns * 1.15, 0))
    asking = F.greatest(F.lit(1), F.bround(meeting_questions * 0.3, 0))
    leader = share * 1.8 + F.least(cues, F.lit(4)) * 0.6
    helper = turns / F.greatest(avg_turns, F.lit(1.0)) * 0.9 + questions * 0.45
    expert = mean_turn_sec / F.greatest(avg_turn_sec, F.lit(1.0)) * 0.8 + density * 4.0
    quiet = (1.0 - share) + F.greatest(F.lit(0.0), 1.0 - turns / F.greatest(avg_turns, F.lit(1.0)))
    top = F.greatest(leader, helper, expert, quiet)
    return (
        F.when((share <= 0.15) & (turns <= few), "Passive")
        .when((share >= 0.35) & (cues >= 1), "Leader")
        .when((turns >= many) & (questions >= asking), "Facilitator")
        .when((mean_turn_sec >= F.greatest(F.lit(4.0), avg_turn_sec * 1.2)) & (density >= 0.08), "Expert")
        .when(leader == top, "Leader")
        .when(helper == top, "Facilitator")
        .when(expert == top, "Expert")
        .otherwise("Passive")
    )


def question_owners(questions: DataFrame, turns: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(recording_id, question, speaker): whose turn holds a question's text, or most of its words; ties go to the first turn."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_-]{2,}"), F.lit(0)))
    pairs = questions.select("recording_id", "question").join(turns.select("recording_id", "seq", "speaker", "text"), "recording_id")
    asked = words(F.col("question"))
    bare = F.lower(F.regexp_replace("question", r"^[?？\s]+|[?？\s]+$", ""))
    share = F.size(F.array_intersect(asked, words(F.col("text")))) / F.greatest(F.size(asked), F.lit(1))
    score = F.when(F.contains(F.lower("text"), bare), 2.0).otherwise(share)
    best = pairs.withColumn("score", score).groupBy("recording_id", "question").agg(F.max_by(F.struct("speaker", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("recording_id", "question", "b.speaker")
