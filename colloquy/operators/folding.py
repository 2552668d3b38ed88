"""Turn operators that depend on their own earlier steps: one recording is one unit of work, but for ``smooth_turns``.

A null text counts as a blank one, which has no words and adds nothing to what it is joined with.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import islands

TURN = "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string"
NAMES = [f.split()[0] for f in TURN.split(", ")]


def joined(before: str, after: str) -> str:
    """Speech joined in one sentence, unless the first piece ended one or the second begins with I or an acronym.

    The same rule as ``scalars.joined_text``; a blank piece leaves the other alone.
    """
    if not before.strip() or not after.strip():
        return f"{before} {after}".strip()
    word = after.split()[0]
    letters = "".join(itertools.takewhile(str.isalpha, word))
    acronym = len(letters) > 1 and letters.isupper()
    keep = before.rstrip()[-1] in ".!?" or word == "I" or acronym or not word[0].isupper()
    return f"{before} {after if keep else after[0].lower() + after[1:]}"


def fold_short(rows: list[dict], least_words: int, gap_ms: int) -> list[dict]:
    """Short turns go into the speaker's turn before, else into the one after, if the gap is short enough."""
    out: list[dict] = []
    waiting = [dict(r) for r in rows]
    for k, turn in enumerate(waiting):
        after = waiting[k + 1] if k + 1 < len(waiting) else None
        before = out[-1] if out else None
        if len(turn["text"].split()) >= least_words:
            out.append(turn)
        elif before and before["speaker"] == turn["speaker"] and turn["start_ms"] - before["end_ms"] < gap_ms:
            before["text"], before["end_ms"] = joined(before["text"], turn["text"]), max(before["end_ms"], turn["end_ms"])
        elif after and after["speaker"] == turn["speaker"] and after["start_ms"] - turn["end_ms"] < gap_ms:
            after["text"], after["start_ms"] = joined(turn["text"], after["text"]), min(after["start_ms"], turn["start_ms"])
        else:
            out.append(turn)
    return out


def pulled(left: dict, right: dict) -> dict:
    return left | {"end_ms": max(left["end_ms"], right["end_ms"]), "text": f"{left['text']} {right['text']}".strip()}


def merge_near(rows: list[dict], gap_ms: int) -> list[dict]:
    out: list[dict] = []
    for turn in rows:
        if out and out[-1]["speaker"] == turn["speaker"] and turn["start_ms"] - out[-1]["end_ms"] <= gap_ms:
            out[-1] = pulled(out[-1], turn)
        else:
            out.append(dict(turn))
    return out


def absorb_micro(rows: list[dict], least_ms: int, gap_ms: int) -> list[dict]:
    """A very short turn between two longer ones of one other speaker is theirs; what that makes is looked at again."""
    out: list[dict] = []
    ahead = [dict(r) for r in reversed(rows)]
    length = lambda t: t["end_ms"] - t["start_ms"]
    while ahead:
        out.append(ahead.pop())
        while len(out) > 1 and ahead:
            left, micro, right = out[-2], out[-1], ahead[-1]
            near = micro["start_ms"] - left["end_ms"] <= gap_ms and right["start_ms"] - micro["end_ms"] <= gap_ms
            if not (left["speaker"] == right["speaker"] != micro["speaker"] and length(micro) < least_ms <= min(length(left), length(right)) and near):
                break
            out[-2:] = [pulled(pulled(left, micro), right)]
            ahead.pop()
    return out


def smooth(rows: list[dict], gap_ms: int, least_ms: int) -> list[dict]:
    return merge_near(absorb_micro(merge_near(rows, gap_ms), least_ms, gap_ms), gap_ms)


def by_recording(turns: DataFrame, fold: Callable[[list[dict]], list[dict]]) -> DataFrame:
    names = NAMES

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(text=frame["text"].fillna("")).sort_values(["start_ms", "end_ms", "speaker", "seq"])
        return pd.DataFrame(fold(frame[names].to_dict("records")), columns=names)

    return turns.select(*names).groupBy("recording_id").applyInPandas(run, TURN)


def merge_short_turns(turns: DataFrame, *, least_words: int = 6, gap_ms: int = 8000) -> DataFrame:
    return by_recording(turns, lambda rows: fold_short(rows, least_words, gap_ms))


def spoken(texts: Column) -> Column:
    """Texts joined one after the other as ``pulled`` joins them; a single one stays as it is."""
    blank = r"(?U)[\s\x1c-\x1f]+"
    bare = lambda t: F.regexp_replace(t, f"{blank}$", "")
    rest = F.filter(F.transform(F.slice(texts, 2, F.size(texts)), bare), lambda t: t != "")
    first = F.when(bare(texts[1]) == "", bare(texts[0])).otherwise(texts[0])
    whole = F.array_join(F.concat(F.array(first), rest), " ")
    return F.when(F.size(texts) > 1, F.regexp_replace(bare(whole), f"^{blank}", "")).otherwise(texts[0])


def _pulled_rows(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row for the rows of a recording with the same ``by``: the first in order, with all texts and the last end."""
    parts = F.array_sort(F.collect_list(F.struct(*order, *[c for c in ("speaker", "seq", "end_ms", "text") if c not in order]))).alias("parts")
    held = rows.groupBy("recording_id", by).agg(parts, F.max("end_ms").alias("end_ms"))
    first = [F.col("parts")[0][c].alias(c) for c in ("seq", "speaker", "start_ms")]
    return held.select("recording_id", by, *first, "end_ms", spoken(F.col("parts.text")).alias("text"))


def smooth_turns(turns: DataFrame, *, gap_ms: int = 500, least_ms: int = 500) -> DataFrame:
    """As ``smooth``, on rows: no recording is gathered, only the texts of what becomes one turn.

    A micro turn can only go to its neighbours if both are long and of one other speaker, and the right one is near. Such micro turns
    and their neighbours form runs; in a run, the left side reaches as far as the latest end before the micro turn. What lies before a gap
    ends too early to count, and a micro turn that stays ends before its right neighbour, so that maximum is exact.
    """
    order = ["start_ms", "end_ms", "speaker", "seq"]
    rows = turns.select(*NAMES).withColumn("text", F.coalesce("text", F.lit("")))
    blocks = _pulled_rows(islands(rows, ["recording_id"], order, gap=gap_ms, same=["speaker"]), "island", order)
    w = Window.partitionBy("recording_id").orderBy("island")
    long = F.col("end_ms") - F.col("start_ms") >= least_ms
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    sides = before(long) & after(long) & before(F.col("speaker")).eqNullSafe(after(F.col("speaker"))) & ~before(F.col("speaker")).eqNullSafe(F.col("speaker"))
    micro = F.coalesce(~long & sides & (after(F.col("start_ms")) - F.col("end_ms") <= gap_ms), F.lit(False))
    apart = lambda c: (~(F.col(c) | F.coalesce(F.lag(c).over(w), F.lit(False)))).cast("long")
    marked = blocks.withColumn("micro", micro).withColumn("cut", apart("micro")).withColumn("run", F.sum("cut").over(w))
    reach = F.max("end_ms").over(Window.partitionBy("recording_id", "run").orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("absorbed", F.coalesce(F.col("micro") & (F.col("start_ms") - reach <= gap_ms), F.lit(False)))
    marked = marked.withColumn("cut", apart("absorbed")).withColumn("kept", F.sum("cut").over(w))
    whole = _pulled_rows(marked, "kept", ["island", "start_ms"])
    return _pulled_rows(islands(whole, ["recording_id"], ["start_ms", "kept"], gap=gap_ms, same=["speaker"]), "island", ["kept", "start_ms"]).select(*NAMES)
