"""Text normalisers, tokens, fuzzy search, URL helpers. All are Column expressions unless they say UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.batch import batch_udf


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_truthy(*columns) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in columns])


def compact_space(x) -> Column:
    """White space runs (no-break spaces included) become one blank; null becomes empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), " ", " "), r"\s+", " "))


def match_text(x, filler: str = " ") -> Column:
    """Lower case, everything but a-z and 0-9 becomes the filler."""
    kept = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", filler)
    return F.trim(kept)


def strip_punctuation(x) -> Column:
    """Lower case without punctuation; letters and digits of any script stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}_\s]", ""))


def slug(x) -> Column:
    return F.regexp_replace(match_text(x, "-"), "^-+|-+$", "")


def title_words(x) -> Column:
    """First letter of every word in upper case, the rest as it is."""
    words = F.split(compact_space(x), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


#: Address words and their short forms.
ADDRESS_WORDS = {"section": "sec", "road": "rd", "street": "st", "avenue": "ave", "west": "w", "east": "e", "north": "n", "south": "s"}


def shorten_address(x) -> Column:
    """Address text for comparison: &, no., street words, compass words and ordinals in one short form; ASCII only."""
    out = F.lower(F.coalesce(_c(x), F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, "&", " and "), r"/|\bno\b\.?", " ")
    for word, short in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"([0-9]+)(?:st|nd|rd|th)\b", "$1"), "[^a-z0-9]+", " "))


@batch_udf("string")
def ascii_fold(s: pd.Series) -> pd.Series:
    """UDF: compatibility decomposition, non-ASCII dropped. Spark has no built-in for it."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


@batch_udf("string")
def unicode_key(s: pd.Series) -> pd.Series:
    """UDF: NFKC, lower case, parenthesised readings and everything but letters and digits (any script) dropped."""
    import re

    def one(v):
        if v is None:
            return ""
        folded = unicodedata.normalize("NFKC", v).lower()
        return "".join(ch for ch in re.sub(r"\([^)]*\)", "", folded) if ch.isalnum())

    return s.map(one)


@batch_udf("string")
def plain_text(s: pd.Series) -> pd.Series:
    """UDF: tags become blanks, character references are decoded, white space is compacted."""
    import html
    import re

    return s.map(lambda v: "" if v is None else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", v)).split()))


def html_escape(x) -> Column:
    out = F.coalesce(_c(x), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def tokens(x) -> Column:
    return F.filter(F.split(match_text(x), " "), lambda t: t != "")


def important_tokens(x, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens longer than one character that are no stop words."""
    kept = F.filter(F.array_distinct(tokens(x)), lambda t: F.length(t) > 1)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop]).cast("array<string>")) if stop else kept


def token_overlap(a, b) -> Column:
    return F.size(F.array_intersect(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))))


def overlap_score(a, b) -> Column:
    """Common tokens over those of the side that has more; 0 if a side has none."""
    most = F.greatest(F.size(F.array_distinct(tokens(a))), F.size(F.array_distinct(tokens(b))))
    least = F.least(F.size(F.array_distinct(tokens(a))), F.size(F.array_distinct(tokens(b))))
    return F.when(least == 0, F.lit(0.0)).otherwise(token_overlap(a, b) / most)


#: What a branch suffix looks like at the end of a name.
BRANCH_SUFFIXES = (r"[\s　]*[（(].*?[)）]$", r"[\s　]+(?:本店|支店|新店|別邸|別館|離れ)$", r"[\s　]+\S{1,10}[店舗館]$")


def strip_suffix(x, patterns: Sequence[str] = BRANCH_SUFFIXES, passes: int = 3) -> Column:
    """Drop what matches a pattern at the end, at most `passes` times."""
    out = F.trim(F.coalesce(_c(x), F.lit("")))
    for _ in range(passes):
        out = F.trim(F.regexp_replace(out, "|".join(patterns), ""))
    return out


def tidy_address(x, country=None) -> Column:
    """Parts between commas or " / ", trimmed, no empty ones, no repeats in a row (case aside), without a trailing
    country."""
    text = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s*/\s*", ", ")
    if country is not None:
        tail = F.concat(F.lit(r"(?i),?\s*\Q"), _c(country), F.lit(r"\E\s*$"))
        text = F.when(F.coalesce(_c(country), F.lit("")) != "", F.regexp_replace(text, tail, F.lit(""))).otherwise(text)
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter(parts, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.get(parts, i - 1))))
    return F.array_join(kept, ", ")


#: Tokens that are postcodes.
POSTCODE = r"[0-9]{4,6}|[a-z][0-9][a-z][0-9][a-z][0-9]|[a-z]{1,2}[0-9][a-z0-9]?[0-9][a-z]{2}"


def canonical_address(x, country, postcode: str = POSTCODE) -> Column:
    """Shortened address without the country's tokens and without postcodes."""
    words = F.split(shorten_address(x), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(F.split(shorten_address(country), " "), w) & ~w.rlike(f"^(?:{postcode})$")), " ")


def digits(x) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^0-9]", "")


#: Digits in the first two of three groups of a phone number, by its length.
PHONE_GROUPS = {10: ((2, 4), (3, 3), (4, 2)), 11: ((3, 4), (4, 3), (5, 2))}


def phone_variants(x, country_code: str = "81", trunk: str = "0") -> Column:
    """Distinct spellings of a phone number in order: local digits (for an international one of 11 digits or more), in
    groups with hyphens and blanks, then the digits as they are and in groups."""
    d = digits(x)
    local = F.when(d.startswith(country_code) & (F.length(d) >= 11), F.concat(F.lit(trunk), F.substring(d, len(country_code) + 1, 30)))

    def grouped(v):
        out = []
        for n, cuts in PHONE_GROUPS.items():
            for a, b in cuts:
                parts = [F.substring(v, 1, a), F.substring(v, a + 1, b), F.substring(v, a + b + 1, 30)]
                out += [F.when(F.length(v) == n, F.concat_ws(sep, *parts)) for sep in ("-", " ")]
        return out

    return F.array_distinct(F.filter(F.array(local, *grouped(local), d, *grouped(d)), lambda v: v.isNotNull() & (v != "")))


def address_blocks(x) -> Column:
    """Number groups such as 3-14-5, in order."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"([0-9]+(?:-[0-9]+)*)"), 1)


def primary_block(x) -> Column:
    """The first hyphenated number group, else the first; "" if there is none."""
    b = address_blocks(x)
    return F.coalesce(F.get(F.filter(b, lambda t: t.contains("-")), F.lit(0)), F.get(b, F.lit(0)), F.lit(""))


def blocks_match(a, b) -> Column:
    """Whether both sides share a hyphenated number group, or one side's groups, joined, contain the other's."""
    x, y = address_blocks(a), address_blocks(b)
    long = lambda t: F.filter(t, lambda v: v.contains("-"))
    j, k = F.array_join(x, " "), F.array_join(y, " ")
    return (j != "") & (k != "") & (F.arrays_overlap(long(x), long(y)) | j.contains(k) | k.contains(j))


def natural_list(xs, word: str = "and") -> Column:
    """a / a and b / a, b, and c."""
    x, n = _c(xs), F.size(_c(xs))
    many = F.concat(F.array_join(F.slice(x, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(f", {word} "), F.element_at(x, -1))
    return F.when(n <= 0, F.lit("")).when(n == 1, F.element_at(x, 1)).when(n == 2, F.concat(F.element_at(x, 1), F.lit(f" {word} "), F.element_at(x, 2))).otherwise(many)


def search_text(*columns) -> Column:
    """Lower-cased text of all columns; arrays are joined."""
    return F.lower(F.concat_ws(" ", *[_c(c) for c in columns]))


def fuzzy_match(text, query: str) -> Column:
    """Substring, or every query word is in a text word or within floor(0.3 * length) edits of one.

    The query is known when the plan is made; words under three characters have to be contained.
    """
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    words = F.split(t, r"\s+")
    found = F.lit(True)

    def near(w: str):
        return lambda x: x.contains(w) | (F.levenshtein(x, F.lit(w), int(0.3 * len(w))) >= 0) if len(w) >= 3 else x.contains(w)

    for w in q.split():
        found = found & F.exists(words, near(w))
    return t.contains(q) | found


def split_values(x) -> Column:
    """Parts between newlines, commas, semicolons or bars, trimmed, no empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[\n,;|]+"), lambda p: F.trim(p)), lambda p: p != "")


def sessions(x, kinds: Mapping[str, Sequence[str]]) -> Column:
    """Sorted distinct kinds whose words all occur in a part of x; parts for any session give none."""
    parts = F.transform(split_values(x), lambda p: F.lower(compact_space(p)))
    hit = lambda p: F.coalesce(*[F.when(_all(p, words), F.lit(k)) for k, words in kinds.items()])
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, hit), lambda v: v.isNotNull())))


def _all(p: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & p.contains(w)
    return out


def collapse_runs(xs) -> Column:
    """Array without elements equal to the one before."""
    x = _c(xs)
    return F.filter(x, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(x, i - 1)))


def distinct_ignoring_case(xs, limit: int | None = None) -> Column:
    """First spelling of each value, in order."""
    x = _c(xs)
    low = F.transform(x, lambda v: F.lower(v))
    kept = F.filter(x, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
    return F.slice(kept, 1, limit) if limit else kept


def count_of(x, part: str) -> Column:
    """How often the text `part` occurs."""
    v = F.coalesce(_c(x), F.lit(""))
    return ((F.length(v) - F.length(F.replace(v, F.lit(part), F.lit("")))) / len(part)).cast("long")


def url_host(x) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(_c(x), F.lit("HOST")), F.lit("")), r"^www\.", ""))


def canonical_url(x) -> Column:
    """https, lower-case host without www, no query, fragment or trailing slash; null if there is no host."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(_c(x), F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(url_host(x) != "", F.concat(F.lit("https://"), url_host(x), path))


def url_depth(x) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.try_parse_url(_c(x), F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""))


def query_value(x, key: str) -> Column:
    return F.try_parse_url(_c(x), F.lit("QUERY"), F.lit(key))


def add_query(x, params: Mapping[str, Column | str]) -> Column:
    """URL with more query parameters, escaped."""
    pairs = F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(_c(v) if not isinstance(v, str) else F.lit(v))) for k, v in params.items()])
    return F.concat(_c(x), F.when(_c(x).contains("?"), F.lit("&")).otherwise(F.lit("?")), pairs)


def map_coordinates(x) -> Column:
    """struct(lat, lng) of a map link: @lat,lng, !3dlat!4dlng, or a query of the form lat,lng; else null."""
    number = r"(-?[0-9]{1,3}(?:\.[0-9]+)?)"
    patterns = (rf"!3d{number}!4d{number}", rf"@{number},{number}", rf"[?&](?:q|query|ll|center|destination)=(?:loc:)?{number}(?:,|%2C){number}")
    v = F.coalesce(_c(x), F.lit(""))
    return F.coalesce(*[F.when(v.rlike(p), F.struct(F.regexp_extract(v, p, 1).cast("double").alias("lat"), F.regexp_extract(v, p, 2).cast("double").alias("lng"))) for p in patterns])


#: Path parts of booking pages.
BOOKING_PATHS = ("reserv", "book", "booking", "contact", "module", "gift", "find-a-table", "new-events")


def is_booking_url(x) -> Column:
    return F.lower(F.coalesce(_c(x), F.lit(""))).rlike("|".join(BOOKING_PATHS))


def url_ladder(x, limit: int = 8) -> Column:
    """Addresses to try for a URL: itself without fragment, its https form, the roots if it is a booking page, its
    parent folders from the nearest on and the roots, https before http; distinct, at most `limit`."""
    url = F.regexp_replace(compact_space(x), "#.*$", "")
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    own = F.when(path == "", F.regexp_replace(url, r"^([a-zA-Z]+://[^/?]*)", "$1/")).otherwise(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    folder = lambda i: F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    at = lambda scheme, tail: F.concat(F.lit(scheme + "://"), host, tail)
    parents = F.when(n > 0, F.flatten(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.array(at("https", folder(i)), at("http", folder(i)))))).otherwise(F.array().cast("array<string>"))
    roots = F.array(at("https", F.lit("/")), at("http", F.lit("/")))
    first = F.array(own, F.when(own.startswith("http://"), F.concat(F.lit("https://"), F.substring(own, 8, 10_000))))
    steps = F.concat(first, F.when(is_booking_url(own), roots).otherwise(F.array().cast("array<string>")), parents, roots)
    return F.when(host.isNull(), F.filter(F.array(own), lambda v: v != "")).otherwise(F.slice(F.array_distinct(F.array_compact(steps)), 1, limit))


@batch_udf("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """UDF: 1 if one side contains the other, else the matching-blocks ratio; 0 if a side is empty."""
    import difflib

    def one(x, y):
        if not x or not y:
            return 0.0
        return 1.0 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
