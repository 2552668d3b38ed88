"""Calendar files: events in a window, with recurrences, exceptions and moved instances expanded.

A rule gives days, and each day the event's own time of day in its own zone, so that a meeting at ten stays at ten when clocks change.
A block that can't be read is a row of ``problems`` and stops nothing else.
"""

from __future__ import annotations

import calendar
import itertools
import re
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "source_id long, uid string, starts_ms long, ends_ms long, all_day boolean, summary string, location string, organizer string, attendees array<string>"
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LENGTH = re.compile(r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")


def fields(block: str) -> dict[str, list[tuple[str, str]]]:
    """Property name to its (parameters, value) pairs; folded lines are joined before."""
    out: dict[str, list[tuple[str, str]]] = {}
    for line in block.split("\n"):
        name, _, value = line.partition(":")
        key, _, params = name.partition(";")
        out.setdefault(key.strip().upper(), []).append((params, value.strip()))
    return out


def moment(params: str, value: str, default: tzinfo = timezone.utc) -> tuple[datetime, bool]:
    """A time with its zone (``default`` where none is named), and whether it is a whole day."""
    if len(value) == 8:
        return datetime.combine(date(int(value[:4]), int(value[4:6]), int(value[6:])), datetime.min.time(), default), True
    at = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S")
    zone = re.search(r"TZID=([^;:]+)", params)
    named = timezone.utc if value.endswith("Z") else ZoneInfo(zone[1].strip('"')) if zone else default
    return at.replace(tzinfo=named), False


def moments(found: list[tuple[str, str]], default: tzinfo) -> list[datetime]:
    """The times of properties that list several."""
    return [moment(params, v.strip().partition("/")[0], default)[0] for params, value in found for v in value.split(",") if v.strip()]


def span(f: dict, start: datetime, all_day: bool, default: tzinfo) -> timedelta:
    if "DTEND" in f:
        end = moment(*f["DTEND"][0], default)[0]
        length = end.replace(tzinfo=None) - start.replace(tzinfo=None) if end.tzinfo == start.tzinfo else end - start
    elif "DURATION" in f and (m := LENGTH.match(f["DURATION"][0][1])):
        w, d, h, mi, s = (int(x or 0) for x in m.groups())
        length = timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s)
    else:
        length = timedelta(days=1) if all_day else timedelta(hours=1)
    return length if length > timedelta(0) else timedelta(minutes=1)


def month_days(year: int, month: int, weekdays: list[tuple[int, int]], monthdays: list[int], day: int) -> list[date]:
    """The days of a month that a rule names: by weekday (0 for every one, else the n-th), by number, or the event's own."""
    size = calendar.monthrange(year, month)[1]
    every = [date(year, month, k) for k in range(1, size + 1)]
    by_number = {n if n > 0 else size + 1 + n for n in monthdays}
    if not weekdays:
        return [d for d in every if d.day in (by_number or {day})]
    out = set()
    for nth, weekday in weekdays:
        same = [d for d in every if d.weekday() == weekday]
        out |= set(same if not nth else same[nth - 1 : nth] if nth > 0 else same[nth : nth + 1 or None])
    return sorted(d for d in out if not by_number or d.day in by_number)


def periods(parts: dict[str, str], start: date) -> Iterator[list[date]]:
    """The days of a rule, a day, week, month or year at a time, without end."""
    step = max(1, int(parts.get("INTERVAL", 1)))
    weekdays = [(int(n or 0), DAYS.index(d)) for n, d in re.findall(r"([+-]?\d*)([A-Z]{2})", parts.get("BYDAY", ""))]
    numbers = lambda name: [int(n) for n in parts[name].split(",")] if name in parts else []
    monthdays, months = numbers("BYMONTHDAY"), numbers("BYMONTH")
    allowed = {d for _, d in weekdays}
    for k in itertools.count():
        if parts["FREQ"] == "DAILY":
            day = start + timedelta(days=k * step)
            fits = (not allowed or day.weekday() in allowed) and (not monthdays or day in month_days(day.year, day.month, [], monthdays, 0))
            days = [day] if fits else []
        elif parts["FREQ"] == "WEEKLY":
            monday = start - timedelta(days=start.weekday()) + timedelta(weeks=k * step)
            days = [monday + timedelta(days=d) for d in sorted(allowed or {start.weekday()})]
        elif parts["FREQ"] == "MONTHLY":
            year, month = divmod(start.year * 12 + start.month - 1 + k * step, 12)
            days = month_days(year, month + 1, weekdays, monthdays, start.day)
        elif parts["FREQ"] == "YEARLY":
            year = start.year + k * step
            days = [d for m in months or [start.month] for d in month_days(year, m, weekdays, monthdays, start.day)]
        else:
            raise ValueError(f"unknown frequency {parts['FREQ']}")
        days = [d for d in days if not months or d.month in months]
        chosen = numbers("BYSETPOS")
        yield sorted({days[p - 1 if p > 0 else p] for p in chosen if 0 < abs(p) <= len(days)}) if chosen else days


def occurrences(rule: str | None, start: datetime, until: datetime) -> Iterator[datetime]:
    """Starts of a rule before ``until``; without a rule, the start alone."""
    parts = dict(p.split("=", 1) for p in (rule or "").upper().split(";") if "=" in p)
    if "FREQ" not in parts:
        yield start
        return
    last = moment("", parts["UNTIL"], start.tzinfo)[0] if "UNTIL" in parts else until
    if len(parts.get("UNTIL", "")) == 8:
        last += timedelta(days=1) - timedelta(microseconds=1)
    left = int(parts.get("COUNT", 2**62))
    for k, days in enumerate(periods(parts, start.date())):
        for day in days:
            at = datetime.combine(day, start.timetz())
            if at < start:
                continue
            if at > last or at >= until or left < 1:
                return
            left -= 1
            yield at
        # a rule may name days that never come
        if not days and (datetime.combine(start.date(), datetime.min.time(), start.tzinfo) + timedelta(days=k) > until or k > 5000):
            return


def instances(f: dict, start: datetime, until: datetime, default: tzinfo, moved: set[datetime]) -> list[datetime]:
    """An event's starts: those of its rules and dates, without exceptions and the instances that blocks of their own have moved."""
    found = {at for _, rule in f.get("RRULE", [("", "")]) for at in occurrences(rule, start, until)} | set(moments(f.get("RDATE", []), default))
    gone = set(moments(f.get("EXDATE", []), default))
    whole = {at.date() for (params, value), at in zip(f.get("EXDATE", []), moments(f.get("EXDATE", []), default), strict=False) if "VALUE=DATE" in params and "DATE-TIME" not in params}
    return sorted(at for at in found if at not in gone and at not in moved and at.date() not in whole)


def parse(source_id: int, payload: str, low: datetime, high: datetime) -> list[tuple]:
    """Rows of EVENTS and an error, which is null where the block could be read."""
    text = re.sub(r"\r?\n[ \t]", "", payload or "").replace("\r\n", "\n")
    named = re.search(r"^X-WR-TIMEZONE:(.+)$", text, re.M)
    try:
        default: tzinfo = ZoneInfo(named[1].strip()) if named else timezone.utc
    except (ZoneInfoNotFoundError, ValueError):
        default = timezone.utc
    blocks = [fields(b) for b in re.findall(r"BEGIN:VEVENT\n(.*?)\nEND:VEVENT", text, re.S)]
    out, moved = [], {}
    for f in blocks:
        try:
            if "RECURRENCE-ID" in f and "UID" in f:
                moved.setdefault(f["UID"][0][1], set()).update(moments(f["RECURRENCE-ID"], default))
        except (ValueError, KeyError, ZoneInfoNotFoundError):
            continue  # the block itself is reported below
    for f in blocks:
        uid = f.get("UID", [("", "")])[0][1]
        one = lambda k, f=f: f[k][0][1].replace("\\,", ",") if k in f else None
        try:
            if not uid or "DTSTART" not in f or f.get("STATUS", [("", "")])[0][1].upper() == "CANCELLED":
                continue
            moments(f.get("RECURRENCE-ID", []), default)
            start, all_day = moment(*f["DTSTART"][0], default)
            length = span(f, start, all_day, default)
            starts = [start] if "RECURRENCE-ID" in f else instances(f, start, high, default, moved.get(uid, set()))
            for at in starts:
                end = at + length if all_day else (at.astimezone(timezone.utc) + length)
                if at < high and end > low:
                    ms = lambda t: round((t - EPOCH).total_seconds() * 1000)
                    out.append((source_id, uid, ms(at), ms(end), all_day, one("SUMMARY"), one("LOCATION"), one("ORGANIZER"), [v for _, v in f.get("ATTENDEE", [])], None))
        except (ValueError, KeyError, IndexError, OverflowError, ZoneInfoNotFoundError) as e:
            out.append((source_id, uid or None, None, None, None, one("SUMMARY"), None, None, None, f"{type(e).__name__}: {e}"[:200]))
    return out


def read(calendars: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """Events of calendars (source_id, payload) that touch [low, high), and an ``error`` for each block that can't be read."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in EVENTS.split(", ")] + ["error", "place"]
        for frame in frames:
            for sid, payload in zip(frame["source_id"], frame["payload"], strict=True):
                rows = [(*r, k) for k, r in enumerate(parse(int(sid), payload, low, high))]
                yield pd.DataFrame(rows, columns=names).astype({"starts_ms": "Int64", "ends_ms": "Int64", "all_day": "boolean"})

    return calendars.select("source_id", "payload").mapInPandas(run, EVENTS + ", error string, place long")


def problems(calendars: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """(source_id, uid, summary, error) of the blocks that can't be read."""
    return read(calendars, low, high).where("error IS NOT NULL").select("source_id", "uid", "summary", "error")


def expand(calendars: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """Events of calendars (source_id, payload) that touch [low, high); of equal (uid, start) the last stays."""
    rows = read(calendars, low, high).where("error IS NULL").drop("error")
    last = Window.partitionBy("source_id", "uid", "starts_ms").orderBy(F.desc("place"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "place")
