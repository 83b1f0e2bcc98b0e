"""Rule-based text classification: ordered rules, tag dictionaries, sentence filters, language and policy tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import _c, compact_space, title_words

#: English function words.
ENGLISH = ("a", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "has", "have", "in", "is", "it", "its", "not", "of", "on", "or", "our", "that", "the", "their", "this", "to", "was", "we", "were", "when", "where", "which", "who", "with", "you")
#: Fixed values: (key, pattern) of closures, order rules and booking notes.
UNAVAILABLE = r"not eligible|permanently closed|temporarily closed|closed for renovation"
ORDER_RULES = (("special", UNAVAILABLE), ("three_items", r"minimum order of three|three\s*\(3\)"), ("buffet", r"buffet|hotpot"))
BOOKING_RULES = (("48h", r"48\s*hours?|48h"), ("24h", r"24\s*hours?|24h"), ("phone", r"via phone|by phone|call|contact\s*\+?65|quote"), ("walk_in", r"walk-?ins?"), ("reservation_required", r"reservation"))
#: Venue status by its notes, the first that holds.
STATUS_RULES = (("closed", "permanently closed"), ("closing_soon", "effective from|not be eligible"), ("temporarily_closed", "temporarily closed"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row: branches of a condition don't share their inputs otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_rule(text, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Key of the first rule whose pattern occurs in the lower-cased text."""
    def pick(t):
        out = None
        for key, pattern in rules:
            out = F.when(t.rlike(pattern), key) if out is None else out.when(t.rlike(pattern), key)
        return out.otherwise(F.lit(otherwise).cast("string"))

    return once(F.lower(compact_space(text)), pick)


def all_rules(text, rules: Sequence[tuple[str, str]], none: str | None = None, limit: int | None = None) -> Column:
    """Distinct keys of all rules that hold, in rule order; [none] if there is none."""
    def pick(t):
        return F.array_distinct(F.filter(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in rules]), lambda x: x.isNotNull()))

    found = once(F.lower(compact_space(text)), pick)
    if limit:
        found = F.slice(found, 1, limit)
    return F.when(F.size(found) == 0, F.array(F.lit(none))).otherwise(found) if none else found


def order_rule(text, is_hotel: Column) -> Column:
    return F.coalesce(first_rule(text, ORDER_RULES), F.when(is_hotel, "one_per_diner").otherwise("two_mains"))


def benefit(text, is_hotel: Column, is_fixed: Column) -> Column:
    """struct(max_percent, savings, applies_to, order_rule)."""
    closed, order = F.lower(compact_space(text)).rlike(UNAVAILABLE), order_rule(text, is_hotel)
    return F.struct(
        F.when(is_fixed, 20).otherwise(50).alias("max_percent"),
        F.when(closed, "unavailable").when(is_fixed, "twenty").otherwise("fifty").alias("savings"),
        F.when(closed | is_fixed, "special").when(order == "buffet", "buffet").when(is_hotel, "hotel_food").otherwise("ala_carte").alias("applies_to"),
        order.alias("order_rule"),
    )


def location_key(n_addresses: Column, n_phones: Column, has_pin: Column) -> Column:
    """bundled: several addresses or phones in one record; else mapped or unmapped."""
    return F.when((n_addresses > 1) | (n_phones > 1), "bundled").when(has_pin, "mapped").otherwise("unmapped")


def is_english(text, stop: Sequence[str] = ENGLISH) -> Column:
    """Under 20 % non-ASCII characters and, from eight words on, a function word per eight at least."""
    t = F.coalesce(_c(text), F.lit(""))
    foreign = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"\b([a-z]+)\b"), 1)
    dense = once(words, lambda ws: (F.size(ws) < 8) | (F.size(F.filter(ws, lambda w: w.isin(list(stop)))) >= F.size(ws) / 8))
    return (t != "") & (foreign < 0.2 * F.length(t)) & dense


def sentences(text) -> Column:
    return F.filter(F.split(compact_space(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_filter(text, drop: str) -> Column:
    """Text without the sentences in which a pattern occurs."""
    return F.array_join(F.filter(sentences(text), lambda s: ~F.lower(s).rlike(drop)), " ")


def drop_navigation(text) -> Column:
    """Text after leading menu entries between bars: from the first part of over six words, or of over twice the words
    of the part before it; texts with fewer than three bars stay."""
    out = compact_space(text)
    for mark, pattern in (("｜", "｜"), (" | ", r" \| ")):
        raw = F.coalesce(_c(text), F.lit(""))
        parts = F.transform(F.split(raw, pattern), lambda p: F.trim(p))
        n = F.transform(parts, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")))
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (F.element_at(n, i) > 6) | ((i > 1) & (F.element_at(n, i) > 2 * F.element_at(n, F.greatest(i - 1, F.lit(1))))))
        first = F.coalesce(F.array_min(starts), F.lit(1))
        long = F.size(parts) > 3
        out = F.when(long & (first > 1), compact_space(F.array_join(F.slice(parts, first, F.size(parts)), " "))).otherwise(out)
    return out


def policy_excerpt(text, words: Sequence[str] = ("children", "child")) -> Column:
    """From the first of the words that occurs up to the next full stop; null if none does."""
    t = compact_space(text)
    found = [F.nullif(compact_space(F.regexp_extract(t, rf"(?i)({w}[^.]*\.)", 1)), F.lit("")) for w in words]
    return F.coalesce(*found)


def child_policy(note, services) -> Column:
    """kid_friendly / older_children_only / teens_only / policy_available / unknown from services and a note's age."""
    tags, t = F.lower(F.array_join(F.coalesce(_c(services), F.array().cast("array<string>")), " ")), F.lower(compact_space(note))
    age = F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).try_cast("int")
    return (
        F.when(tags.contains("child-friendly"), "kid_friendly")
        .when(tags.contains("children-over12-accepted"), "older_children_only")
        .when(t == "", "unknown")
        .when(age <= 6, "kid_friendly")
        .when(age <= 12, "older_children_only")
        .when(age > 12, "teens_only")
        .when(t.contains("elementary school"), "older_children_only")
        .when(t.contains("junior high") | t.contains("middle school"), "teens_only")
        .when(t.contains("welcome"), "kid_friendly")
        .otherwise("policy_available")
    )


def is_junk(text, least: int = 40) -> Column:
    """Too short, or a cookie, script or error notice."""
    t = F.lower(compact_space(text))
    return (F.length(t) < least) | t.rlike(r"enable javascript|cookies? (?:policy|consent)|page not found|access denied|403 forbidden|domain (?:is )?for sale")


def keyword_list(text, limit: int = 8) -> Column:
    """Distinct trimmed keywords between commas, semicolons or bars, at most `limit`."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"[,;|]"), lambda p: compact_space(p)), lambda p: p != "")), 1, limit)


def longest_alias(text, aliases: Sequence[tuple[str, str]]) -> Column:
    """Value of the longest alias that occurs as a word in the text (country and city inference)."""
    t, out = F.lower(F.coalesce(_c(text), F.lit(""))), None
    for alias, value in sorted(aliases, key=lambda a: (-len(a[0]), a[0])):
        test = t.rlike(rf"(^|[^a-z]){alias.lower()}([^a-z]|$)")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def geo_title(x) -> Column:
    """Hyphens become blanks and every word starts in upper case; null if nothing is left."""
    return F.nullif(title_words(F.regexp_replace(compact_space(x), "-", " ")), F.lit(""))


#: Areas that are no districts.
AREAS = ("Tokyo", "Yokohama/Kawasaki", "Kamakura/Hayama/Shonan", "Greater Tokyo Area", "Kyoto/Osaka/Nara", "Chubu/Tokai/Karuizawa", "Kanazawa/Toyama/Hokuriku", "Hokkaido", "Tohoku", "Chugoku/Shikoku", "Kyushu/Okinawa")


def infer_city(address, prefecture, area, town) -> Column:
    """City of a Japanese address: Tokyo by prefecture or address part; the first part that ends in -shi; the first in
    -machi, -cho, -son or -mura; Kyoto, Osaka or Nara named anywhere; Tokyo by area; else prefecture, town, area, "Japan"."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(address), F.lit("")), ","), compact_space), lambda p: p != "")

    def ending(pattern):
        found = F.transform(F.filter(parts, lambda p: F.lower(p).rlike(rf"-({pattern})$")), lambda p: geo_title(F.regexp_replace(p, "-[^-]*$", "")))
        return F.get(F.array_compact(found), F.lit(0))

    named = F.lower(F.array_join(parts, " "))
    pre = F.nullif(_c(prefecture), F.lit(""))
    out = F.when(F.coalesce(pre == "Tokyo", F.lit(False)) | F.array_contains(parts, "Tokyo"), F.lit("Tokyo"))
    out = out.when(ending("shi").isNotNull(), ending("shi")).when(ending("machi|cho|son|mura").isNotNull(), ending("machi|cho|son|mura"))
    for city in ("Kyoto", "Osaka", "Nara"):
        out = out.when(named.contains(city.lower()), city)
    out = out.when(pre.isNull() & _c(area).isin("Tokyo", "Greater Tokyo Area"), "Tokyo").when(pre.isNotNull(), F.coalesce(geo_title(pre), F.lit("Japan")))
    return out.otherwise(F.coalesce(geo_title(town), geo_title(area), F.lit("Japan")))


def infer_district(town, area, city, areas: Sequence[str] = AREAS) -> Column:
    """The town, else the area if it is none of the large ones, unless it is the city itself; null if neither."""
    t, a, c = compact_space(town), F.nullif(_c(area), F.lit("")), F.lower(_c(city))
    return F.when((t != "") & ~F.lower(t).eqNullSafe(c), t).when(a.isNotNull() & ~a.isin(*areas) & ~F.lower(a).eqNullSafe(c), a)


def service_price(ranges, service: str) -> Column:
    """struct(min, max) of the first price range of a service type in array<struct(serviceType, min, max)>; null if none."""
    first = F.get(F.filter(_c(ranges), lambda r: r["serviceType"] == service), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["min"].alias("min"), first["max"].alias("max")))


def contacts(lines) -> Column:
    """struct(email, phone, url, mode) of contact lines."""
    text = F.array_join(_c(lines), " ")
    email = F.nullif(F.regexp_extract(text, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), F.lit(""))
    url = F.nullif(F.regexp_extract(text, r"(https?://[^\s]+)", 1), F.lit(""))
    phone = F.nullif(F.trim(F.regexp_extract(F.regexp_replace(text, r"https?://[^\s]+", ""), r"(\+?[0-9][0-9 ()-]{6,}[0-9])", 1)), F.lit(""))
    mode = F.when(email.isNotNull() & phone.isNotNull(), "email_or_phone").when(email.isNotNull(), "email").when(phone.isNotNull(), "phone").when(url.isNotNull(), "online").otherwise("none")
    return F.struct(email.alias("email"), phone.alias("phone"), url.alias("url"), mode.alias("mode"))
