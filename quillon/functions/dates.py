"""Dates, times of day, date ranges and expiry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import _c, compact_space, split_values

#: Accepted date spellings in the order they are tried (day before month).
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date_text(x) -> Column:
    """ISO date text of any accepted spelling; the trimmed text itself if none fits."""
    v = F.trim(F.coalesce(_c(x), F.lit("")))
    tries = [F.date_format(F.try_to_date(v, f), "yyyy-MM-dd") for f in DATE_FORMATS]
    return F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v).otherwise(F.coalesce(*tries, v))


def parse_date_list(x) -> Column:
    """Sorted distinct dates of a list text."""
    return F.array_sort(F.array_distinct(F.transform(split_values(x), parse_date_text)))


def parse_exclusion(x, default_year: int = 2026, roll_over: bool = False) -> Column:
    """struct(start, end, label, tentative, note) of "3 - 5 May 2026", "3 May - 5 June [2026]" or "3 May 2026".

    Anything else is a note. Without a year the default is taken. A range over New Year gets one year for both
    ends, as listed; roll_over=True moves its end to the next year.
    """
    raw = F.translate(F.coalesce(_c(x), F.lit("")), "–—−•", "---")
    tentative = F.lower(raw).contains("(tentative)")
    label = compact_space(F.regexp_replace(raw, r"(?i)\s*\(tentative\)\s*", ""))
    names = "|".join(MONTHS)
    same, across, single = rf"(?i)^([0-9]{{1,2}})\s*-\s*([0-9]{{1,2}})\s+({names})\s+([0-9]{{4}})$", rf"(?i)^([0-9]{{1,2}})\s+({names})\s*-\s*([0-9]{{1,2}})\s+({names})(?:\s+([0-9]{{4}}))?$", rf"(?i)^([0-9]{{1,2}})\s+({names})\s+([0-9]{{4}})$"

    def group(pattern, i):
        return F.regexp_extract(label, pattern, i)

    def cast(c):
        return F.nullif(c, F.lit("")).try_cast("int")

    def make(year, month, d):
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month)).cast("string")
        return F.try_to_date(F.concat_ws("-", year.cast("string"), number, d), "y-M-d")

    year2 = F.coalesce(cast(group(across, 5)), F.lit(default_year))
    start2, end2 = make(year2, group(across, 2), group(across, 1)), make(year2, group(across, 4), group(across, 3))
    if roll_over:
        end2 = F.when(end2 < start2, F.add_months(end2, 12)).otherwise(end2)
    start = F.when(label.rlike(same), make(group(same, 4), group(same, 3), group(same, 1))).when(label.rlike(across), start2).when(label.rlike(single), make(group(single, 3), group(single, 2), group(single, 1)))
    end = F.when(label.rlike(same), make(group(same, 4), group(same, 3), group(same, 2))).when(label.rlike(across), end2).when(label.rlike(single), make(group(single, 3), group(single, 2), group(single, 1)))
    return F.struct(start.alias("start"), end.alias("end"), label.alias("label"), tentative.alias("tentative"), F.when(start.isNull() & (label != ""), label).alias("note"))


def is_weekend(d) -> Column:
    return F.weekday(_c(d)) >= 5


def minutes_of(x) -> Column:
    """Minutes of an HH:MM text; null if it is none."""
    v = F.trim(F.coalesce(_c(x), F.lit("")))
    h, m = F.regexp_extract(v, r"^([0-9]{1,2}):([0-9]{2})$", 1).try_cast("int"), F.regexp_extract(v, r"^([0-9]{1,2}):([0-9]{2})$", 2).try_cast("int")
    return F.when((h < 24) & (m < 60), h * 60 + m)


def clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def half_hour(x) -> Column:
    """HH:MM rounded to the nearest half hour, 23:30 at most; "" if it is no time."""
    m = minutes_of(x)
    return F.when(m.isNull(), F.lit("")).otherwise(clock(F.least(F.lit(1410), F.greatest(F.lit(0), (F.floor(m / 30 + 0.5) * 30).cast("int")))))


def time_distance(x, preferred) -> Column:
    """Signed minutes between a time and the preferred one."""
    return minutes_of(x) - minutes_of(preferred)


def distance_label(d: Column) -> Column:
    return F.when(d.isNull(), F.lit("")).when(d == 0, F.lit("exact")).when(d > 0, F.concat(F.lit("+"), d.cast("string"), F.lit(" min"))).otherwise(F.concat(d.cast("string"), F.lit(" min")))


def is_stale(at, now: Column, minutes: int = 30) -> Column:
    return F.coalesce(_c(at) < now - F.expr(f"interval {int(minutes)} minutes"), F.lit(True))


def zoned_text(at, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(_c(at), zone), pattern)


def expiry_date(dates, start, end) -> Column:
    """Latest listed date within [start, end], else the end, else the latest listed date."""
    d = F.filter(_c(dates), lambda x: (_c(start).isNull() | (x >= _c(start))) & (_c(end).isNull() | (x <= _c(end))))
    return F.coalesce(F.array_max(d), _c(end), F.array_max(_c(dates)))


def is_expired(dates, start, end, today: Column) -> Column:
    return F.coalesce(expiry_date(dates, start, end) < today, F.lit(False))


def month_days(month: Column) -> Column:
    """All days of a yyyy-MM month, after as many nulls as weekdays before the first (weeks start on Sunday)."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    blanks = F.array_repeat(F.lit(None).cast("date"), F.dayofweek(first) - 1)
    return F.concat(blanks, F.sequence(first, F.last_day(first)))


def past_end_of_day(until, now: Column, zone: str) -> Column:
    """Whether `now` (UTC) is past the end of a date in a time zone."""
    return F.coalesce(now > F.to_utc_timestamp(F.date_add(_c(until), 1).cast("timestamp"), zone), F.lit(False))
