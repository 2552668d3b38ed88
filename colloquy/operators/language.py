"""Language of transcripts by function words: guesses, distributions, spans, and multilingual plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import islands

#: Function words of either language.
ENGLISH = ("the", "and", "to", "of", "in", "for", "with", "on", "is", "are", "we", "you", "hello", "thanks", "meeting", "team", "today")
SPANISH = ("el", "la", "los", "las", "de", "que", "y", "en", "para", "con", "es", "somos", "hola", "gracias", "reunion", "equipo", "hoy")
LETTERS = r"[a-zA-ZÀ-ſ]+"
SURE = 0.75


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many tokens are among the words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    return F.size(F.filter(tokens, lambda t: t.isin(*words))).cast("long")


def guess(text: Column) -> dict[str, Column]:
    """``en`` and ``es`` scores, the language that leads (null on a tie or without hits), and its share."""
    text = F.coalesce(text, F.lit(""))
    en = hits(text, ENGLISH)
    some = F.size(F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))) > 0
    es = hits(text, SPANISH) + F.when(some & F.lower(text).rlike("[áéíóúñ¿¡]"), 2).otherwise(0)
    total = en + es
    lead = F.when(en > es, "en").when(es > en, "es")
    share = F.when(total == 0, F.lit(None).cast("double")).otherwise(F.round(F.greatest(en, es) / total, 4))
    return {"en_score": en, "es_score": es, "language": lead, "confidence": share}


def segment_language(override: Column, given: Column, given_confidence: Column, detected: Column, text: Column, *, prefer_detected: bool = True) -> dict[str, Column]:
    """A segment's language: an override, its own, the detected one if preferred, a guess, the detected one, else unknown.

    A sure guess conflicts with a segment's own language, or with the detected one that it is taken before. The detected one
    is certain only where it is preferred and no guess differs.
    """
    g = guess(text)
    source = (
        F.when(override.isNotNull(), "override")
        .when(given.isNotNull(), "segment")
        .when(F.lit(prefer_detected) & detected.isNotNull(), "detected")
        .when(g["language"].isNotNull(), "guess")
        .when(detected.isNotNull(), "detected")
        .otherwise("unknown")
    )
    language = F.coalesce(override, given, F.when(F.lit(prefer_detected), detected), g["language"], detected, F.lit("unknown"))
    confidence = F.when(source == "override", 1.0).when(source == "segment", F.coalesce(given_confidence, F.lit(0.95))).when(source == "guess", g["confidence"])
    sure = g["language"].isNotNull() & (g["confidence"] >= SURE)
    own = (source == "segment") & sure & (g["language"] != given)
    against = (source == "guess") & sure & F.coalesce(g["language"] != detected, F.lit(False))
    conflict = F.coalesce(own | against, F.lit(False))
    differs = F.coalesce(g["language"] != detected, F.lit(False))
    unsure = F.coalesce(confidence < SURE, F.lit(True))
    preferred = F.lit(prefer_detected) & (source == "detected")
    uncertain = F.when(source == "override", False).when(source == "segment", unsure | own).when(preferred, differs).when(source == "guess", unsure).otherwise(True)
    return {"language": language, "language_source": source, "language_confidence": confidence, "uncertain": uncertain, "conflict": conflict}


def weight_ms(start: Column, end: Column, text: Column) -> Column:
    """Duration, or ten milliseconds a word where there is none."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.when(end > start, end - start).otherwise(10 * F.greatest(words, F.lit(1)))


def distribution(segments: DataFrame, by: str = "recording_id") -> DataFrame:
    """Each language's weight and share of a recording in per cent; unknown counts too."""
    sums = segments.groupBy(by, "language").agg(F.sum(weight_ms(F.col("start_ms"), F.col("end_ms"), F.col("text"))).alias("weight"))
    return sums.withColumn("percent", F.round(F.col("weight") * 100 / F.sum("weight").over(Window.partitionBy(by)), 2))


def dominant(shares: DataFrame, by: str = "recording_id") -> DataFrame:
    """The language with most weight, any known one before unknown; ties by code."""
    key = F.struct((F.col("language") == "unknown").alias("u"), (-F.col("weight")).alias("w"), "language")
    return shares.groupBy(by).agg(F.min(key)["language"].alias("dominant_language"), F.count_if(F.col("language") != "unknown").alias("languages"))


def spans(segments: DataFrame, *, gap_ms: int = 500) -> DataFrame:
    """Stretches of one language: segments in order, cut at a change or a longer gap."""
    rows = islands(segments, ["recording_id"], ["start_ms", "end_ms", "seq"], gap=gap_ms, same=["language"])
    return rows.groupBy("recording_id", "island").agg(F.first("language").alias("language"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("segments")).drop("island")


def needs_review(segments: DataFrame, by: str = "recording_id") -> DataFrame:
    """A recording needs review with any conflict, or with two languages and two uncertain segments."""
    sums = segments.groupBy(by).agg(F.count_if("uncertain").alias("uncertain"), F.count_if("conflict").alias("conflicts"), F.countDistinct(F.when(F.col("language") != "unknown", F.col("language"))).alias("languages"))
    return sums.withColumn("review", (F.col("conflicts") > 0) | ((F.col("languages") >= 2) & (F.col("uncertain") >= 2)))


def multilingual(shares: DataFrame, stretches: DataFrame, *, least_percent: float = 15.0, least_ms: int = 3000) -> DataFrame:
    """Whether a recording has two languages of some share, and two with a stretch of some length."""
    a = shares.where("language <> 'unknown'").groupBy("recording_id").agg(F.count_if(F.col("percent") >= least_percent).alias("common"))
    b = stretches.where((F.col("language") != "unknown") & (F.col("end_ms") - F.col("start_ms") >= least_ms)).groupBy("recording_id").agg(F.countDistinct("language").alias("lasting"))
    rows = a.join(b, "recording_id", "left")
    return rows.select("recording_id", ((F.col("common") >= 2) & (F.coalesce("lasting", F.lit(0)) >= 2)).alias("multilingual"))


def chunk_plan(segments: DataFrame, *, gap_ms: int = 750) -> DataFrame:
    """Chunks to transcribe apart: stretches of equal language and certainty with short gaps."""
    rows = islands(segments, ["recording_id"], ["start_ms", "end_ms", "seq"], gap=gap_ms, same=["language", "uncertain"])
    return rows.groupBy("recording_id", "island").agg(
        F.first("language").alias("language"), F.bool_or("uncertain").alias("uncertain"), F.bool_or("conflict").alias("conflict"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("segments")
    ).drop("island")


def summary_language(requested: Column, main: Column, detected: Column) -> Column:
    return F.coalesce(requested, F.when(main != "unknown", main), detected, F.lit("en"))
