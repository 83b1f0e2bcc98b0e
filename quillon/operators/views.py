"""Whole views of the explorer: stays, discount outlets and slot venues, with the projections that they show."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import _c, compact_space, count_of, first_truthy, fuzzy_match, match_text
from quillon.operators import rules
from quillon.operators.facets import at_least, equals, facet_filter, ranked
from quillon.operators.lookup import with_rating
from quillon.operators.ranges import stay_status
from quillon.operators.slots import availability_key, closest, slot_predicate, span_text


@dataclass(frozen=True)
class StayQuery:
    """Stay properties by country, city, search and rating, for a stay [start, end) if there is one."""

    country: str = ""
    city: str = ""
    search: str = ""
    start: str | None = None
    end: str | None = None
    hide_blocked: bool = True
    min_rating: float | None = None

    def build(self, stays: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
        """Rows with status (struct key, blocked, detail); blocked ones are left out if asked for. Needs id, name,
        country, city, search_text, blackout_exact_ranges, blackout_notes, blackout_raw."""
        day = lambda d: F.lit(d).cast("date") if d else None
        rows = facet_filter(stays, equals("country", self.country), equals("city", self.city))
        rows = rows.withColumn("status", stay_status("blackout_exact_ranges", "blackout_notes", "blackout_raw", day(self.start), day(self.end)))
        if ratings is not None and self.min_rating is not None:
            rows = facet_filter(with_rating(rows, ratings, "id"), at_least(self.min_rating, "rating"))
        if self.search:
            rows = rows.filter(fuzzy_match("search_text", self.search))
        return rows.filter(~F.col("status.blocked")) if self.hide_blocked and self.start else rows

    @staticmethod
    def counts(rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n_rows"), F.count_if("status.blocked").alias("n_blocked"), F.countDistinct("city").alias("n_cities"), F.countDistinct("country").alias("n_countries"))


def discount_profile(df: DataFrame, fixed_ids: Sequence[str] = ()) -> DataFrame:
    """df with benefit, booking keys, location key and unavailable, from id, name, type, cuisine, notes, opening_hours,
    closing_note, address, phone, lat and lng."""
    hotel, text = F.coalesce(F.col("type") == "hotel", F.lit(False)), F.concat_ws(" ", "name", "cuisine", "notes")
    n_addresses = F.greatest(count_of("notes", "Address:"), F.size(F.filter(F.split(F.coalesce("address", F.lit("")), r"\s*;\s*"), lambda a: a != "")))
    n_phones = F.regexp_count(F.coalesce("phone", F.lit("")), F.lit(r"\+?[0-9][0-9 ]{7,}"))
    repeats = (match_text("name") != "") & (count_of(match_text("notes"), "outlet") > 1)
    return df.withColumns({
        "benefit": rules.benefit(text, hotel, F.col("id").isin(list(fixed_ids)) if fixed_ids else F.lit(False)),
        "booking": rules.all_rules(F.concat_ws(" ", "notes", "opening_hours"), rules.BOOKING_RULES, "not_stated"),
        "unavailable": F.lower(compact_space(F.concat_ws(" ", "closing_note", "notes"))).rlike(rules.UNAVAILABLE),
        "location": F.when(repeats, "bundled").otherwise(rules.location_key(n_addresses, n_phones, F.col("lat").isNotNull() & F.col("lng").isNotNull())),
    })


def filter_discounts(df: DataFrame, kind: str = "", cuisine: str = "", savings: str = "", order_rule: str = "", applies_to: str = "", booking: str = "", location: str = "", search: str = "") -> DataFrame:
    """Profiled discount outlets by their derived facets."""
    rows = facet_filter(df, equals("type", kind), equals("cuisine", cuisine), equals("benefit.savings", savings), equals("benefit.order_rule", order_rule), equals("benefit.applies_to", applies_to), F.array_contains("booking", booking) if booking else None, equals("location", location))
    return rows.filter(fuzzy_match(F.concat_ws(" ", "name", "cuisine", "address", "notes"), search)) if search else rows


def slot_venues(venues: DataFrame, slots: DataFrame, key: str, status: str, stale: Column, availability: str = "", preferred: str | None = None, order: str = "name", **slot_filters) -> DataFrame:
    """Venues with availability, n_slots, span and the slot nearest to a preferred time, ranked: available first,
    then by distance in time, then by name. Slot filters without an availability facet show available venues only."""
    fits = slots.filter(slot_predicate(**slot_filters))
    away, nearest = closest(preferred or "19:00", ("date", "time"))
    n = fits.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_"), F.countDistinct("date").alias("d_"), F.min("date").alias("a_"), F.max("date").alias("z_"), nearest.alias("s_"), away.alias("minutes_away"))
    rows = venues.join(n, F.col(key) == F.col("k_"), "left").withColumns({"next_date": F.col("s_.date"), "next_time": F.col("s_.time")})
    rows = rows.withColumns({"n_slots": F.coalesce("n_", F.lit(0)), "availability": availability_key(status, F.coalesce("n_", F.lit(0)), stale), "span": span_text(F.coalesce("d_", F.lit(0)), F.col("a_"), F.col("z_"))})
    wanted = availability or ("available" if any(v for v in slot_filters.values()) else "")
    rows = facet_filter(rows, equals("availability", wanted)).drop("k_", "n_", "d_", "a_", "z_", "s_")
    rank = F.when(F.col("availability") == "available", 0).when(F.col("availability") == "stale", 1).when(F.col("availability") == "no_seats", 2).otherwise(3)
    # stored by a shuffle: the sort samples its input first, which would count all slots a second time
    return rows.repartition(key, order).orderBy(rank, F.coalesce("minutes_away", F.lit(1 << 30)), order, key)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("availability").agg(F.count("*").alias("n"))


#: Confidence labels that count as verified.
VERIFIED = ("google_place_verified", "source_map_verified", "place_verified", "link_verified", "address_validated")


def has_point(lat="lat", lng="lng") -> Column:
    return _c(lat).isNotNull() & _c(lng).isNotNull()


def is_verified(confidence="coordinate_confidence", lat="lat", lng="lng") -> Column:
    return has_point(lat, lng) & F.coalesce(_c(confidence).isin(list(VERIFIED)), F.lit(False))


def region(*levels) -> Column:
    """First non-empty of district, region, area and the like."""
    return first_truthy(*levels)


def kicker(*parts) -> Column:
    """Non-empty parts without repeats, between middle dots."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[compact_space(p) for p in parts]), lambda p: p != "")), " · ")


def source_kind(source, rules_: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    return rules.first_rule(source, rules_, otherwise)


def location_note(confidence, note) -> Column:
    """The record's own note, else one that follows from the confidence."""
    own = F.nullif(compact_space(note), F.lit(""))
    c = F.coalesce(_c(confidence), F.lit("none"))
    return F.coalesce(own, F.when(c.isin(list(VERIFIED)), "Location verified.").when(c == "source", "Location from the listing, not verified.").when(c == "location_conflict", "Sources disagree on the location; the pin is hidden.").otherwise("Location not known."))


def summary(*sources: tuple[str, object]) -> Column:
    """struct(origin, text) of the first non-empty text."""
    return F.coalesce(*[F.when(compact_space(c) != "", F.struct(F.lit(name).alias("origin"), compact_space(c).alias("text"))) for name, c in sources])


def without_empty(*fields: str) -> Column:
    """Map of the non-empty fields among text columns."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])), lambda k, v: v.isNotNull() & (v != ""))


def dotted(df: DataFrame, path: str) -> Column:
    """Column of a dotted path, null where the schema lacks it."""
    from pyspark.sql import types as T

    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[part].dataType
    return F.col(path)


#: Where a site's own description may come from to count as evidence.
EVIDENCE_SOURCES = ("meta", "og:description", "twitter:description", "jsonld")


def has_evidence(official, tags: Column, press, site, site_source) -> Column:
    """Whether a record says enough for a description: an official summary, tags, or eight words by the press or by the
    site's own description from a trusted place."""
    words = lambda c: F.size(F.filter(F.split(compact_space(c), " "), lambda w: w != ""))
    own = (words(site) >= 8) & F.coalesce(compact_space(site_source).isin(list(EVIDENCE_SOURCES)), F.lit(False))
    return (F.coalesce(_c(official), F.lit("")) != "") | (F.size(F.coalesce(tags, F.array())) > 0) | (words(press) >= 8) | own


def accept_summary(text, name, cuisines, known_for: Column | None = None) -> Column:
    """Whether a site's text may stand as a summary: English, no junk, 60 to 600 characters, and it names the record,
    a cuisine of it or a tag."""
    t = compact_space(text)
    named = (match_text(name) != "") & match_text(t).contains(match_text(name))
    food = F.exists(F.coalesce(_c(cuisines), F.array().cast("array<string>")), lambda c: (match_text(c) != "") & match_text(t).contains(match_text(c)))
    tags = F.size(known_for) > 0 if known_for is not None else F.lit(False)
    return rules.is_english(t) & ~rules.is_junk(t) & F.length(t).between(60, 600) & (named | food | tags)


def ranked_stays(df: DataFrame) -> DataFrame:
    """By rating, then review count, descending, missing ones last; then by name and id."""
    return ranked(df, ("rating", -1.0), ("review_count", 0), ties=["name", "id"])
