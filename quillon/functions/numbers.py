"""Bands, seats, money text, geography and hashes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import _c

#: Fixed values: (key, label, tier, lower, upper) of price bands; lower <= value < upper.
LUNCH_BANDS = (("under-5k", "Under JPY 5k", "$", 0, 5000), ("5k-10k", "JPY 5k-10k", "$$", 5000, 10000), ("10k-20k", "JPY 10k-20k", "$$$", 10000, 20000), ("20k-plus", "JPY 20k+", "$$$$", 20000, None))
DINNER_BANDS = (("under-10k", "Under JPY 10k", "$$", 0, 10000), ("10k-20k", "JPY 10k-20k", "$$$", 10000, 20000), ("20k-30k", "JPY 20k-30k", "$$$$", 20000, 30000), ("30k-plus", "JPY 30k+", "$$$$$", 30000, None))
#: Fixed values: (from this score on, stars), best first; below them all one star.
STAR_STEPS = ((4.0, 5.0), (3.5, 4.5), (3.4, 4.0), (3.3, 3.5), (3.1, 3.0), (3.0, 2.0))
EARTH_KM = 6371.0


def band(x, bands: Sequence[tuple] = LUNCH_BANDS) -> Column:
    """struct(key, label, tier) of the first band that holds the value; null fields if none does."""
    v, out = _c(x), None
    for key, label, tier, lower, upper in bands:
        test = (v >= lower) if upper is None else (v >= lower) & (v < upper)
        value = F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(tier).alias("tier"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def stars(x, steps: Sequence[tuple[float, float]] = STAR_STEPS) -> Column:
    v, out = _c(x), F.when(_c(x).isNull(), F.lit(None).cast("double"))
    for least, value in steps:
        out = out.when(v >= least, F.lit(float(value)))
    return out.otherwise(F.lit(1.0))


def price_bounds(x) -> Column:
    """struct(low, high) of the numbers in a price text (thousands separators allowed)."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"([0-9][0-9,]*)"), 1), lambda t: F.replace(t, F.lit(","), F.lit("")).cast("long"))
    return F.struct(F.array_min(found).alias("low"), F.when(F.size(found) > 1, F.array_max(found)).alias("high"))


def bounds_overlap(low1, high1, low2, high2) -> Column:
    return (_c(low1) <= F.coalesce(_c(high2), _c(low2))) & (_c(low2) <= F.coalesce(_c(high1), _c(low1)))


def numbers_in(xs) -> Column:
    """Elements of an array that are whole numbers, as such."""
    return F.filter(F.transform(_c(xs), lambda v: v.cast("string").try_cast("int")), lambda v: v.isNotNull())


def seats_shown(listed, most, total, fallback) -> Column:
    """Largest listed seat count, else the maximum, else the total, else the fallback (zero counts as missing)."""
    some = lambda c: F.when(_c(c) != 0, _c(c))
    return F.coalesce(F.array_max(numbers_in(listed)), some(most), some(total), _c(fallback))


def seats_alerted(listed, most) -> Column:
    """The larger of the largest listed seat count and the maximum."""
    return F.coalesce(F.greatest(F.array_max(numbers_in(listed)), _c(most)), F.lit(0))


def seats_stored(listed, total) -> Column:
    return F.coalesce(F.array_max(numbers_in(listed)), _c(total).try_cast("int"), F.lit(0))


def party_size(x, default: int = 2) -> Column:
    """First number of a text, 1 at least; the default if there is none."""
    n = F.nullif(F.regexp_extract(F.coalesce(_c(x).cast("string"), F.lit("")), "([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(1), n))


def money_range(low, high, sign: str = "¥") -> Column:
    one = lambda c: F.concat(F.lit(sign), F.format_number(_c(c), 0))
    return F.when(_c(low).isNull() & _c(high).isNull(), F.lit("")).when(_c(high).isNull(), F.concat(one(low), F.lit("+"))).when(_c(low).isNull(), F.concat(F.lit("up to "), one(high))).when(_c(low) == _c(high), one(low)).otherwise(F.concat(one(low), F.lit(" - "), one(high)))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(_c(lng2)) - F.radians(_c(lng1))) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_boxes(df: DataFrame, boxes: DataFrame, key: str, lat: str, lng: str, name: str = "in_box") -> DataFrame:
    """df with a flag: the point lies in its key's box (key, min_lat, max_lat, min_lng, max_lng).

    A key without a box passes; a point without coordinates doesn't. Several boxes of a key: any will do.
    Spark broadcasts the boxes if they are small enough by its own statistics.
    """
    b = boxes.groupBy(F.col(key).alias("k_")).agg(F.collect_list(F.struct("min_lat", "max_lat", "min_lng", "max_lng")).alias("b_"))
    inside = F.exists("b_", lambda x: F.col(lat).between(x["min_lat"], x["max_lat"]) & F.col(lng).between(x["min_lng"], x["max_lng"]))
    flag = F.when(F.col(lat).isNull() | F.col(lng).isNull(), False).when(F.col("b_").isNull(), True).otherwise(inside)
    return df.join(b, F.col(key).eqNullSafe(F.col("k_")), "left").withColumn(name, flag).drop("k_", "b_")


def bounding_box(df: DataFrame, lat: str, lng: str, by: Sequence[str] = ()) -> DataFrame:
    ok = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return ok.groupBy(*by).agg(F.count("*").alias("n_points"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lng).alias("min_lng"), F.max(lng).alias("max_lng"))


def grid_clusters(df: DataFrame, lat: str, lng: str, zoom: int, steps: Sequence[int] = (10, 100)) -> DataFrame:
    """Points by grid cell of a zoom level with count, centre and size class: an approximation of map clustering."""
    cell = 360.0 / 2 ** (zoom + 1)
    n = F.count("*")
    size = F.when(n < steps[0], "small").when(n < steps[1], "medium").otherwise("large")
    ok = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return ok.groupBy(F.floor(F.col(lat) / cell).alias("cell_y"), F.floor(F.col(lng) / cell).alias("cell_x")).agg(n.alias("n_points"), F.avg(lat).alias("lat"), F.avg(lng).alias("lng"), size.alias("size_class"))


def adjudicate(source, link, place, same_place: Column, place_ok: Column, fallback, source_in: Column, link_in: Column, near_place: float = 0.35, near_source: float = 0.35) -> Column:
    """struct(lat, lng, origin, confidence, note) from up to four points; points are struct(lat, lng) columns, nullable.

    link: from the record's map link; place: the matched place, same_place: by id, place_ok: its name or address
    agrees. In order: the matched place if ids agree and the link has no usable point; the link if the place is
    the same or near; hidden if link and agreeing place are apart; the link alone; the source near an agreeing
    place; the source; an agreeing place; the fallback; hidden. Distances are kilometres (fixed values); the note is a
    key that tells what was done: a source further than near_source from the link that replaced it has drifted.
    """
    s, l, p, f = (_c(x) for x in (source, link, place, fallback))
    none = F.lit(None).cast("double")

    def out(point, origin, confidence, note):
        return F.struct((point["lat"] if point is not None else none).alias("lat"), (point["lng"] if point is not None else none).alias("lng"), F.lit(origin).cast("string").alias("origin"), F.lit(confidence).alias("confidence"), (note if isinstance(note, Column) else F.lit(note).cast("string")).alias("note"))

    has = p.isNotNull()
    linked, sourced, same, ok = (F.coalesce(c, F.lit(False)) for c in (link_in, source_in, same_place, place_ok))
    gap = haversine_km(l["lat"], l["lng"], p["lat"], p["lng"]) <= near_place
    near = haversine_km(s["lat"], s["lng"], p["lat"], p["lng"]) <= near_place
    apart = haversine_km(s["lat"], s["lng"], l["lat"], l["lng"]) > near_source
    moved = lambda drifted, agrees, alone: F.when(sourced & apart, drifted).when(sourced, agrees).otherwise(alone)
    return (
        F.when(has & same & ~linked, out(p, "place", "place_verified", "link_names_the_place"))
        .when(linked & has & (same | gap), out(l, "link", "place_verified", moved("source_drifted_from_verified_link", "link_and_place_agree", "link_and_place_agree_without_source")))
        .when(linked & has & ok, out(None, None, "location_conflict", "link_and_place_disagree"))
        .when(linked, out(l, "link", "link_verified", moved("source_drifted_from_link", "source_matches_link", "link_without_source")))
        .when(sourced & has & ok & near, out(s, "place", "place_verified", "source_matches_place"))
        .when(sourced, out(s, "source", "source", None))
        .when(has & ok, out(p, "place", "place_verified", "source_unusable_place_used"))
        .when(f.isNotNull(), out(f, "fallback", "address_validated", "source_invalid_fallback_used"))
        .otherwise(out(None, None, "none", "nothing_validated"))
    )


def row_hash(*columns: str, bits: int = 256) -> Column:
    """SHA-2 of the columns in name order, nulls kept: equal rows hash equal."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), bits)


def salted_hash(salt: str, *parts) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), F.to_json(F.array(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]))), 256)


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: n_rows and a digest of all rows that doesn't depend on their order.

    The rows' hashes are added up in four lanes, so no task holds them all (a sorted list of hashes would).
    """
    h = row_hash(*columns)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("-", *[F.coalesce(x, F.lit(0)).cast("decimal(38,0)").cast("string") for x in lanes]), 256).alias("digest"))
