"""Scalar cleaners, parsers and formatters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter language codes and their two-letter ones.
LANGUAGE_CODES = {
    "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ita": "it",
    "por": "pt", "rus": "ru", "ukr": "uk", "jpn": "ja", "kor": "ko", "zho": "zh", "chi": "zh",
}
#: Words that say nothing about a project.
ROUTING_STOP_WORDS = ("a", "an", "and", "at", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
#: Seconds before each further attempt of a job, by its type.
RETRY_DELAYS = {"precheck": (1, 2), "publish": (3,), "cleanup": (5,)}
DEFAULT_RETRY_DELAYS = (2,)


def safe_number(value: Column, default: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """A number, or the default for text, NaN, infinities, and values out of bounds (which aren't clamped)."""
    x = value.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x).otherwise(F.lit(default))


def clamp(value: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def folded(text: Column) -> Column:
    """Lower case for comparisons; a null is blank. Sharp s counts as ss."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def language_code(value: Column) -> Column:
    """EN-us, eng and en_GB as en; null for what isn't a known code."""
    token = F.substring_index(F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-")), "-", 1)
    three = F.coalesce(*[F.when(token == k, v) for k, v in LANGUAGE_CODES.items()])
    return F.when(token.rlike(r"^\p{L}{2}$"), token).when(token.rlike(r"^\p{L}{3}$"), three)


def text_items(text: Column, limit: int = 30) -> Column:
    """Lines without bullets and blanks, at most ``limit``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]+\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, limit)


def routing_tokens(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*ROUTING_STOP_WORDS)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def duration_ms(started: Column, finished: Column) -> Column:
    """Milliseconds between two times, never negative; null if one is missing."""
    return F.greatest(F.lit(0), F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp")))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0))))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def tone_score(value: Column, default: int = 50) -> Column:
    """0 to 100, rounded; the default for what isn't a number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(safe_number(value, float(default)), 0))).cast("int")


def captured_local(filename: Column) -> Column:
    """The local time in a file name like 2024-01-31 10_20_30 or 2024-01-31 10-20-30."""
    found = F.regexp_extract(filename, r"(\d{4}-\d{2}-\d{2})[ _T](\d{2})[-_:](\d{2})[-_:](\d{2})", 0)
    return F.try_to_timestamp(F.nullif(F.regexp_replace(found, r"^(.{10}).(..).(..).(..)$", "$1 $2:$3:$4"), F.lit("")))


def to_utc(local: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(local, zone)


def slug(text: Column) -> Column:
    """Letters, digits, dots, hyphens and underscores; anything else becomes one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("unknown"))


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[A-Za-z0-9]+)$", 1))


def participant(text: Column) -> Column:
    """(name, email) of an attendee like ``MAILTO:ann@x.org``, ``Ann <ann@x.org>`` or ``Ann``."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^mailto:", "")
    email = F.nullif(F.lower(F.regexp_extract(bare, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1)), F.lit(""))
    name = clean(F.regexp_replace(F.regexp_replace(bare, r"<?[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+>?", ""), r'^"|"$', ""))
    return F.struct(name.alias("name"), email.alias("email"))


def without_password(url: Column) -> Column:
    """Scheme and host of a URL; what may hold secrets is left out."""
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")), F.lit("/…"))


def chunk_position(code: Column) -> Column:
    """(chunk, total) of a progress code like llm_chunk_2_of_5; nulls for others."""
    part = lambda k: F.regexp_extract(code, r"^llm_chunk_(\d+)_of_(\d+)$", k).try_cast("int")
    return F.struct(part(1).alias("chunk"), part(2).alias("total"))


def precheck(duration_sec: Column, speech_ratio: Column, *, least_sec: float = 20.0, least_ratio: float = 0.1) -> Column:
    """Why a recording goes to quarantine; null if it doesn't."""
    return (
        F.when(duration_sec.isNull() | speech_ratio.isNull(), "precheck_metrics_unavailable")
        .when(duration_sec < least_sec, f"duration_lt_{least_sec:.0f}s")
        .when(speech_ratio < least_ratio, f"speech_ratio_lt_{least_ratio:.2f}")
    )


def retry_delay(job_type: Column, attempt: Column) -> Column:
    """Seconds before the next try after an attempt (from 1); 0 before the first and beyond what the type's policy lists."""
    delays = F.coalesce(*[F.when(job_type == k, F.array(*map(F.lit, v))) for k, v in RETRY_DELAYS.items()], F.array(*map(F.lit, DEFAULT_RETRY_DELAYS)))
    listed = attempt.between(1, F.size(delays))
    return F.when(listed, F.try_element_at(delays, attempt.cast("int"))).otherwise(F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def joined_piece(before: Column, after: Column) -> Column:
    """``after`` as it follows ``before`` in speech: in lower case, unless a sentence ended, or it begins with I or an acronym.

    An acronym is a first word whose letters up to the first other character are two or more, all upper.
    """
    first = F.regexp_extract(after, r"^\s*(\S+)", 1)
    keep = before.rlike(r"[.!?]\s*$") | ~first.rlike(r"^\p{Lu}") | (first == "I") | first.rlike(r"^\p{Lu}{2,}(\P{L}|$)")
    lowered = F.concat(F.lower(F.substring(after, 1, 1)), F.substr(after, F.lit(2)))
    return F.when(keep, after).otherwise(lowered)


def joined_text(before: Column, after: Column) -> Column:
    """Two pieces of speech as one, joined as ``joined_piece`` says. A blank or null piece leaves the other alone."""
    before, after = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    blank = (F.trim(before) == "") | (F.trim(after) == "")
    return F.when(blank, F.trim(F.concat_ws(" ", before, after))).otherwise(F.concat_ws(" ", before, joined_piece(before, after)))
