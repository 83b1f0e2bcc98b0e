"""Nested slot inventories: normalise, flatten, filter, group, pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.dates import is_weekend, minutes_of
from quillon.functions.numbers import seats_shown
from quillon.functions.text import _c, first_truthy

AVAILABLE = ("live_available", "captured_available", "available")
#: Meals in the order they are shown; others follow.
MEAL_ORDER = ("lunch", "dinner")


def meal_slots(meal: str, keep_undated: bool = False, default_seats: int = 2) -> Column:
    """array<struct(date, time, meal, seats)> of a meal struct (status, meal, date, dates, times, seats, max_seats,
    slots: array<struct(date, time, meal, available_seats, max_seats, total_available_seats)>).

    Nested slots if there are any, else every date with every time, else times alone; nothing unless the status is
    "available". Dates are distinct and sorted and slots with neither date nor time dropped, unless keep_undated.
    """
    m = lambda f: F.col(f"{meal}.{f}")
    some = lambda c: F.when(c != 0, c)
    spare = F.coalesce(some(m("max_seats")), some(m("seats")), F.lit(0))
    nested = F.transform(m("slots"), lambda s: F.struct(F.coalesce(s["date"], m("date")).alias("date"), F.coalesce(s["time"], F.lit("")).alias("time"), F.coalesce(F.nullif(s["meal"], F.lit("")), m("meal")).alias("meal"), seats_shown(s["available_seats"], s["max_seats"], s["total_available_seats"], spare).cast("int").alias("seats")))
    if not keep_undated:
        nested = F.filter(nested, lambda s: s["date"].isNotNull() | (s["time"] != ""))
    listed = F.filter(F.concat(F.array(m("date")), F.coalesce(m("dates"), F.array().cast("array<date>"))), lambda d: d.isNotNull())
    dates = listed if keep_undated else F.array_sort(F.array_distinct(listed))
    dates = F.when(F.size(dates) > 0, dates).otherwise(F.array(F.lit(None).cast("date")))
    seats = F.coalesce(some(m("max_seats")), some(m("seats")), F.lit(default_seats)).cast("int")
    crossed = F.flatten(F.transform(dates, lambda d: F.transform(F.coalesce(m("times"), F.array().cast("array<string>")), lambda t: F.struct(d.alias("date"), t.alias("time"), m("meal").alias("meal"), seats.alias("seats")))))
    return F.when(m("status") != "available", F.slice(crossed, 1, 0)).when(F.size(F.coalesce(m("slots"), F.array())) > 0, nested).otherwise(crossed)


def slot_predicate(party: int | None = None, session: str | None = None, date=None, time: str | None = None, day: str | None = None, within: int = 60) -> Column:
    """Conjunction over the flat slot columns (seats, meal, date, time); a day type rejects slots without a date."""
    out = F.lit(True)
    if party:
        out = out & (F.col("seats") >= party)
    if session:
        out = out & (F.lower("meal") == session.lower())
    if date is not None:
        out = out & F.coalesce(F.col("date") == F.lit(date).cast("date"), F.lit(False))
    if time:
        out = out & F.coalesce(F.abs(minutes_of("time") - minutes_of(F.lit(time))) <= within, F.lit(False))
    if day in ("weekday", "weekend"):
        out = out & F.coalesce(is_weekend("date") == (day == "weekend"), F.lit(False))
    return out


def availability_key(status, matching: Column, is_stale: Column) -> Column:
    """available / no_seats / stale / unknown of a venue: available needs an available status and a matching slot."""
    open_ = _c(status).isin(list(AVAILABLE))
    return F.when(open_ & is_stale, "stale").when(open_ & (matching > 0), "available").when(open_ | (_c(status) == "no_seats"), "no_seats").otherwise("unknown")


def meal_rank(meal) -> Column:
    out = None
    for i, m in enumerate(MEAL_ORDER):
        test = F.lower(_c(meal)).contains(m)
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(len(MEAL_ORDER))


def group_meals(slots: DataFrame, *by: str, times_shown: int = 12) -> DataFrame:
    """Slots (date, time, seats, ...) grouped: distinct sorted dates, first sorted times, count, most seats, span."""
    return slots.groupBy(*by).agg(
        F.array_sort(F.collect_set("date")).alias("dates"),
        F.slice(F.array_sort(F.collect_set("time")), 1, times_shown).alias("times"),
        F.count("*").alias("slot_count"),
        F.max("seats").alias("max_seats"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def span_text(n: Column, first: Column, last: Column, none: str = "") -> Column:
    """"date", "n dates, first to last", or the fallback."""
    return F.when(n == 0, none).when(n == 1, first.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(" dates, "), first.cast("string"), F.lit(" to "), last.cast("string")))


def closest(preferred: str, keep: tuple[str, ...] = ("date", "time", "seats")) -> tuple[Column, Column]:
    """Aggregates over slots: minutes of the nearest to a time of day, and its struct of `keep`; ties by date, then time."""
    away = F.abs(minutes_of("time") - minutes_of(F.lit(preferred)))
    far = F.coalesce(away, F.lit(1 << 30))
    return F.min(away), F.min_by(F.struct(*keep), F.struct(far, F.col("date"), F.col("time")))


def closest_slot(slots: DataFrame, preferred: str, *by: str, keep: tuple[str, ...] = ("date", "time", "seats")) -> DataFrame:
    """The slot nearest to a time of day in each group; ties by date, then time."""
    away, nearest = closest(preferred, keep)
    return slots.groupBy(*by).agg(nearest.alias("s"), away.alias("minutes_away")).select(*by, "s.*", "minutes_away")


def month_calendar(slots: DataFrame, month: str, date: str = "date") -> DataFrame:
    """One row per day of a yyyy-MM month: day, column 0-6 (Sunday first) and slot count."""
    days = slots.sparkSession.range(1).select(F.explode(F.expr(f"sequence(to_date('{month}-01'), last_day(to_date('{month}-01')))")).alias("day"))
    counts = slots.filter(F.date_format(date, "yyyy-MM") == month).groupBy(F.col(date).cast("date").alias("d_")).agg(F.count("*").alias("n_slots"))
    return days.join(counts, F.col("day") == F.col("d_"), "left").select("day", (F.dayofweek("day") - 1).alias("column"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))


def latest_checked(df: DataFrame, column: str) -> DataFrame:
    """One row: the latest parsable timestamp text."""
    return df.agg(F.max_by(column, F.try_to_timestamp(F.col(column))).alias("latest"))


def intent(query: str) -> tuple[dict, str]:
    """Filters named in free text, and the rest of the text: plan-time."""
    import re

    text, found = f" {query.lower()} ", {}
    for word, key, value in (("lunch", "session", "lunch"), ("dinner", "session", "dinner"), ("weekends?", "day", "weekend"), ("weekdays?", "day", "weekday"), ("available", "availability", "available")):
        if re.search(rf"\b{word}\b", text):
            found[key] = value
            text = re.sub(rf"\b{word}\b", " ", text)
    if m := re.search(r"\b(\d{1,2})\s*(?:pax|people|guests|persons)\b", text):
        found["party"], text = int(m[1]), text.replace(m[0], " ")
    if m := re.search(r"\b(\d{1,2}:\d{2})\b", text):
        found["time"], text = m[1], text.replace(m[0], " ")
    return found, " ".join(text.split())


def summary(record, *fallbacks: str) -> Column:
    return first_truthy(record, *fallbacks)
