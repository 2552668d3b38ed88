"""Recurrence rules, exceptions, moved instances, clock changes and unreadable blocks of calendar files."""

from datetime import datetime, timedelta, timezone

import pytest

from colloquy.sources import ics

LOW, HIGH = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 12, 31, tzinfo=timezone.utc)


def block(start, *lines, uid="u"):
    return "\r\n".join(["BEGIN:VEVENT", f"UID:{uid}", f"DTSTART{start}", "DURATION:PT30M", *lines, "END:VEVENT"])


def starts(*blocks, low=LOW, high=HIGH, head=""):
    rows = ics.parse(1, "\r\n".join(["BEGIN:VCALENDAR", head, *blocks, "END:VCALENDAR"]), low, high)
    assert not [r for r in rows if r[-1]]
    return sorted((ics.EPOCH + timedelta(milliseconds=r[2])).strftime("%m-%d %H:%M") for r in rows)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4", ["01-03", "01-08", "01-10", "01-15"]),
        ("FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,FR;UNTIL=20240126T235959Z", ["01-05", "01-16", "01-19"]),
        ("FREQ=MONTHLY;COUNT=3", ["01-03", "02-03", "03-03"]),
        ("FREQ=MONTHLY;BYDAY=2TU;COUNT=3", ["01-09", "02-13", "03-12"]),
        ("FREQ=MONTHLY;BYDAY=-1FR;COUNT=2", ["01-26", "02-23"]),
        ("FREQ=MONTHLY;BYMONTHDAY=-1,31;COUNT=3", ["01-31", "02-29", "03-31"]),
        ("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=2", ["01-31", "02-29"]),
        ("FREQ=YEARLY;BYMONTH=3,11;BYMONTHDAY=1", ["03-01", "11-01"]),
        ("FREQ=DAILY;INTERVAL=3;COUNT=3", ["01-03", "01-06", "01-09"]),
        ("FREQ=DAILY;BYDAY=SA;COUNT=2", ["01-06", "01-13"]),
        ("FREQ=DAILY;UNTIL=20240105", ["01-03", "01-04", "01-05"]),
        ("FREQ=MONTHLY;BYMONTHDAY=31;UNTIL=20240601", ["01-31", "03-31", "05-31"]),
    ],
)
def test_rules(rule, want):
    assert [s[:5] for s in starts(block(":20240103T100000Z", f"RRULE:{rule}"))] == want


def test_a_rule_that_never_comes_ends():
    assert starts(block(":20240103T100000Z", "RRULE:FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=30")) == []


def test_exceptions_dates_and_moved_instances():
    master = block(":20240103T100000Z", "RRULE:FREQ=DAILY;COUNT=6", "EXDATE:20240104T100000Z,20240105T100000Z", "RDATE:20240201T080000Z")
    moved = block(":20240107T150000Z", "RECURRENCE-ID:20240106T100000Z")
    cancelled = block(":20240107T100000Z", "RECURRENCE-ID:20240107T100000Z", "STATUS:CANCELLED")
    assert starts(master, moved, cancelled) == ["01-03 10:00", "01-07 15:00", "01-08 10:00", "02-01 08:00"]
    assert starts(block(";VALUE=DATE:20240103", "RRULE:FREQ=DAILY;COUNT=3", "EXDATE;VALUE=DATE:20240104")) == ["01-03 00:00", "01-05 00:00"]


def test_ten_stays_ten_when_clocks_change():
    got = starts(block(";TZID=Europe/Berlin:20240324T100000", "RRULE:FREQ=WEEKLY;COUNT=3"))
    assert got == ["03-24 09:00", "03-31 08:00", "04-07 08:00"]
    assert starts(block(":20240701T100000"), head="X-WR-TIMEZONE:Europe/Berlin") == ["07-01 08:00"]
    assert starts(block(":20240701T100000"), head="X-WR-TIMEZONE:No/Where") == ["07-01 10:00"]


def test_one_bad_block_stops_nothing(spark):
    payload = "\n".join(["BEGIN:VCALENDAR", block(":20240103T100000Z"), block(":2024-13-99", uid="bad"), block(":20240103T100000Z", "RRULE:FREQ=SOMETIMES", uid="odd"), "END:VCALENDAR"])
    df = spark.createDataFrame([(1, payload), (2, None), (3, "garbage")], "source_id long, payload string")
    assert [(r["uid"], r["all_day"]) for r in ics.expand(df, LOW, HIGH).collect()] == [("u", False)]
    found = {r["uid"]: r["error"] for r in ics.problems(df, LOW, HIGH).collect()}
    assert set(found) == {"bad", "odd"} and all(found.values())
