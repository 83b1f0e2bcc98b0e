"""Parsers of landed documents: HTML signals, JSON-LD, fixed-width blocks, section lists and numbered clauses.

Where a parser has no built-in it is an Arrow-batched UDF or UDTF over one document; everything after it is columns.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batch import batch_udf
from quillon.functions.text import _c, compact_space, is_booking_url, match_text
from quillon.sources.shared import discard, materialize

SIGNALS = "title string, description string, keywords string, headings array<string>, paragraphs array<string>, jsonld array<string>"


class _Signals(HTMLParser):
    def __init__(self, headings: int, paragraphs: int):
        super().__init__(convert_charrefs=True)
        self.limit = {"h": headings, "p": paragraphs}
        self.title, self.meta, self.found, self.jsonld, self.open, self.text = None, {}, {"h": [], "p": []}, [], None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            self.meta.setdefault(name, a.get("content", ""))
        kind = "title" if tag == "title" else "h" if tag in ("h1", "h2", "h3") else "p" if tag == "p" else "ld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else None
        if kind:
            self._close()
            self.open = kind
        elif tag == "br" and self.open:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("title", "h1", "h2", "h3", "p", "script"):
            self._close()

    def handle_data(self, data):
        if self.open:
            self.text.append(data)

    def _close(self):
        text = " ".join("".join(self.text).split())
        if self.open == "title" and self.title is None:
            self.title = text
        elif self.open == "ld" and text:
            self.jsonld.append("".join(self.text))
        elif self.open in self.found and text and len(self.found[self.open]) < self.limit[self.open]:
            self.found[self.open].append(text)
        self.open, self.text = None, []


@batch_udf(SIGNALS)
def html_signals(pages: pd.Series) -> pd.DataFrame:
    """Title, meta description, keywords, up to 12 headings, up to 40 paragraphs and JSON-LD blocks of a page."""
    rows = []
    for page in pages:
        p = _Signals(12, 40)
        p.feed(page or "")
        p.close()
        p._close()
        rows.append((p.title, p.meta.get("description") or p.meta.get("og:description"), p.meta.get("keywords"), p.found["h"], p.found["p"], p.jsonld))
    return pd.DataFrame(rows, columns=["title", "description", "keywords", "headings", "paragraphs", "jsonld"])


def raw_title(page) -> Column:
    """What stands between a page's first <title> and the </title> after it, undecoded; "" if there is none, null for null."""
    start, end = "<title>", "</title>"
    rest = F.substr(_c(page), F.locate(start, _c(page)) + len(start))
    found = F.contains(_c(page), F.lit(start)) & F.contains(rest, F.lit(end))
    return F.when(_c(page).isNotNull(), F.when(found, F.substring_index(rest, end, 1)).otherwise(""))


def _walk(node, out):
    if isinstance(node, dict):
        out.append(node)
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            _walk(x, out)


@batch_udf("array<struct<type: array<string>, name: string, json: string>>")
def jsonld_objects(blocks: pd.Series) -> pd.Series:
    """All objects at any depth of JSON-LD blocks; blocks that don't parse give none."""
    def one(texts):
        found = []
        for t in texts if texts is not None else ():
            try:
                _walk(json.loads(t), found)
            except ValueError:
                continue
        out = []
        for o in found:
            kind = o.get("@type", [])
            out.append({"type": [str(k) for k in (kind if isinstance(kind, list) else [kind])], "name": o["name"] if isinstance(o.get("name"), str) else None, "json": json.dumps(o, ensure_ascii=False, sort_keys=True)})
        return out

    return blocks.map(one)


#: JSON-LD types of venues.
VENUE_TYPES = ("restaurant", "foodestablishment", "localbusiness", "barorpub", "cafeorcoffeeshop", "bakery", "hotel")


def venue_signals(pages: DataFrame, key: str, objects: str) -> DataFrame:
    """(key, name, description, cuisines) of the first venue-like JSON-LD object of each page."""
    rows = pages.select(key, F.posexplode(objects).alias("i", "o")).filter(F.exists("o.type", lambda t: F.regexp_replace(F.lower(F.trim(t)), "^#+", "").isin(list(VENUE_TYPES))))
    first = rows.groupBy(key).agg(F.min_by("o", "i").alias("o"))
    cuisine = F.get_json_object("o.json", "$.servesCuisine")
    return first.select(key, "o.name", F.get_json_object("o.json", "$.description").alias("description"), F.coalesce(F.from_json(cuisine, "array<string>"), F.array_compact(F.array(cuisine))).alias("cuisines"))


#: What notices, opening hours and addresses say, and what descriptions say.
NOTICE_WORDS = ("embeddable widget", "book online", "book your table", "book a table", "book now", "make a booking", "reserve a table", "reserve now", "find a table", "cookie", "privacy policy", "javascript", "sign in", "coming soon", "skip to content", "accept all", "sign up with your email address", "receive news and updates", "subscribe")
HOURS_WORDS = (" monday ", " tuesday ", " wednesday ", " thursday ", " friday ", " saturday ", " sunday ", " hours ", " until late", "open daily", "info@", "@")
ADDRESS_WORDS = (" avenue", " ave", " street", " st ", " road", " rd ", " boulevard", " blvd", " floor", " level", " lane")
CONTENT_WORDS = ("menu", "tasting", "seasonal", "seafood", "wine", "cocktail", "sake", "bar", "grill", "charcoal", "rooftop", "harbour", "beach", "ocean", "degustation", "omakase", "steak", "restaurant", "brasserie", "izakaya", "produce", "ingredient", "chef", "dining")
#: Points of a text by where it was found.
SOURCE_POINTS = {"meta": 18, "og:description": 16, "twitter:description": 14, "jsonld": 16, "visible_text": 12}


def _any(text: Column, words) -> Column:
    """Whether any of the words occurs: searched one by one, as a pattern of them all tries each at every letter."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _folded(x) -> Column:
    return F.lower(compact_space(x))


def _says(t: Column, low: Column, content: Column, title: Column, name: Column) -> Column:
    """meaningful_text of a compact text t, its lower case, whether it has a content word, and folded title and name."""
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    n_digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    days = F.regexp_count(low, F.lit(r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"))
    clocks = F.regexp_count(low, F.lit(r"\b[0-9]{1,2}(?::[0-9]{2})?\s*(?:am|pm)\b"))
    bad = _any(low, NOTICE_WORDS) | (_any(padded, HOURS_WORDS) & ~content) | (days >= 2) | (clocks >= 2) | (_any(padded, ADDRESS_WORDS) & (n_digits >= 3)) | ((n_digits >= 8) & ~content)
    return (F.size(F.split(t, " ")) >= 8) & ~bad & (low != title) & (low != name)


def meaningful_text(text, title, name) -> Column:
    """At least eight words; no notice, no opening hours or digits without a content word, no address, no two weekdays
    or clock times, and neither the title nor the name itself."""
    return _says(compact_space(text), _folded(text), _any(_folded(text), CONTENT_WORDS), _folded(title), _folded(name))


def _points(t: Column, low: Column, content: Column, title: Column, name: Column, bonus: float | Column) -> Column:
    """text_score of what _says takes."""
    words = F.size(F.split(t, " "))
    score = F.lit(20) + bonus + F.when(content, 10).otherwise(0) + F.when((name != "") & low.contains(name), 3).otherwise(0)
    score = score + F.when(words.between(10, 45), 8).when(words > 80, -6).otherwise(0)
    return F.when(_says(t, low, content, title, name), score).otherwise(-100).cast("double")


def text_score(text, title, name, bonus: float | Column = 0.0) -> Column:
    """Score of a text candidate, -100 if it says nothing: 20, the source's points, 10 for a content word, 3 for the
    record's name, 8 for 10 to 45 words, -6 beyond 80."""
    return _points(compact_space(text), _folded(text), _any(_folded(text), CONTENT_WORDS), _folded(title), _folded(name), bonus)


def page_score(title, description, cuisines, keywords, headings, score, url) -> Column:
    """Score of a page among a record's candidate pages."""
    there = lambda c, n: F.when(c, n).otherwise(0)
    some = lambda c: F.size(F.coalesce(_c(c), F.array())) > 0
    text = lambda c: F.coalesce(_c(c), F.lit("")) != ""
    return there(text(title), 4) + there(text(description), 25) + there(some(cuisines), 6) + there(some(keywords), 5) + there(some(headings), 3) + F.coalesce(_c(score), F.lit(0)).cast("int") + F.when(~text(url), 0).when(is_booking_url(url), -3).otherwise(4)


def best_text(pages: DataFrame, key: str, title: str, name: Column, candidates: dict[str, tuple[Column, float]]) -> DataFrame:
    """(key, source, text, score): best candidate of each page; candidates {source: (array of texts, bonus)}, ties keep
    the first. One row per page, so a page's candidates never leave its task."""
    def tagged(source: str, texts: Column, bonus: float) -> Column:
        return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(F.lit(source).alias("source"), t.alias("text"), F.lit(bonus).alias("bonus")))

    items = F.concat(*[tagged(s, c, b) for s, (c, b) in candidates.items()])
    rows = pages.withColumns({"title_": _folded(title), "name_": _folded(name)}).select(key, "title_", "name_", F.posexplode(items).alias("i", "c"))
    # step by step, and with no filter on the score below the aggregate: what Spark pushes down it computes once a use
    steps = rows.withColumn("t_", compact_space("c.text")).withColumn("low_", F.lower("t_")).withColumn("content_", _any(F.col("low_"), CONTENT_WORDS))
    scored = steps.withColumn("score", _points(*[F.col(c) for c in ("t_", "low_", "content_", "title_", "name_")], F.col("c.bonus")))
    best = scored.groupBy(key).agg(F.max_by(F.struct("c.source", "c.text", "score"), F.struct("score", -F.col("i"))).alias("b"))
    return best.filter("b.score > -100").select(key, "b.*")


#: First character of each column in the fixed-width listing.
COLUMN_STARTS = (("name", 0), ("address", 16), ("room", 40), ("exclusions", 64), ("contact", 88))


#: What makes a segment a contact or an exclusion wherever it starts.
CONTACT_STARTS = ("+", "reservations-", "reservations.", "wreservations.", "tlc.sinlb.")
EXCLUSION_STARTS = ("subject to availability", "opening q2", "\u2022")


def segment_field(start: int, text: str) -> str:
    """Column of a segment of the fixed-width listing: told by its content, else by where it starts."""
    t, by_place = text.strip().lower(), [n for n, first in COLUMN_STARTS if start >= first][-1]
    if by_place == "contact" or "@" in t or t.endswith(".com") or t.startswith(CONTACT_STARTS):
        return "contact"
    return "exclusions" if t.startswith(EXCLUSION_STARTS) else by_place


@F.udtf(returnType="line_no int, field string, text string")
class FixedWidth:
    """Segments of a fixed-width text: runs between three or more blanks, put into a column by segment_field."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            for m in re.finditer(r"\S(?:.*?\S)??(?=\s{3,}|\s*$)", line):
                yield i, segment_field(m.start(), m[0]), " ".join(m[0].split())


@F.udtf(returnType="block_no int, first_line int, text string")
class Blocks:
    """Blocks of lines between blank lines."""

    def eval(self, text: str):
        held, first, n = [], 0, 0
        for i, line in enumerate([*(text or "").split("\n"), ""]):
            if line.strip():
                first = i if not held else first
                held.append(line.rstrip())
            elif held:
                yield n, first, "\n".join(held)
                held, n = [], n + 1


def starts_entry(line: str) -> bool:
    """Whether a line has a name and, in the address column, a house number of up to four digits before a word."""
    found = [(m.start(), m[0]) for m in re.finditer(r"\S(?:.*?\S)??(?=\s{3,}|\s*$)", line)]
    _, address, room = (first for _, first in COLUMN_STARTS[:3])
    return any(at < address for at, _ in found) and any(address <= at < room and re.match(r"\d{1,4}\s+[A-Za-z]", t) for at, t in found)


@F.udtf(returnType="block_no int, first_line int, text string")
class Listing:
    """Entries of the listing's table: from two lines below its heads to its terms; blank lines and lines that start an
    entry part them, page numbers go. A text without heads (or the anchor) and terms after them has none."""

    #: Words of the heads, what stands in the first line if there are none, and the line after the table.
    HEADS, ANCHOR, TERMS = ("Participating", "Eligible Room Type"), "The Fullerton", "Terms and Conditions"

    def eval(self, text: str):
        lines = (text or "").split("\n")
        where = lambda test: next((i for i, line in enumerate(lines) if test(line)), None)
        head = where(lambda line: all(w in line for w in self.HEADS))
        head = where(lambda line: self.ANCHOR in line) if head is None else head
        end = where(lambda line: line.startswith(self.TERMS))
        if head is None or end is None or end <= head:
            return
        held, first, n = [], 0, 0
        for i in range(head + 2, end + 1):
            line = lines[i] if i < end else ""
            if line.strip().isdecimal():
                continue
            if held and (not line.strip() or starts_entry(line)):
                yield n, first, "\n".join(held)
                held, n = [], n + 1
            if line.strip():
                first = i if not held else first
                held.append(line.rstrip())


@F.udtf(returnType="number int, text string")
class Clauses:
    """Numbered clauses ("1. text") with their continuation lines; numbers have to follow one another from 1."""

    def eval(self, text: str):
        number, held = 0, []
        for line in (text or "").split("\n"):
            m = re.match(r"\s*(\d{1,3})[.)]\s+(.*)", line)
            if m and int(m[1]) == number + 1:
                if number:
                    yield number, " ".join(" ".join(held).split())
                number, held = number + 1, [m[2]]
            elif number and line.strip():
                held.append(line)
        if number:
            yield number, " ".join(" ".join(held).split())


def section_lines(docs: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """(key, line_no, section, line): non-empty lines below the last line that matches the header pattern."""
    from quillon.operators.dedupe import carry_forward

    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    is_header = F.col("line").rlike(header)
    out = carry_forward(lines, [key], "line_no", F.when(is_header, F.col("line")), "section")
    return out.filter(~is_header & (F.col("line") != "")).select(key, "line_no", "section", "line")


@batch_udf("array<struct<url: string, name: string, area: string, score: double, reviews: long>>")
def result_blocks(pages: pd.Series) -> pd.Series:
    """Search results of a listing page: anchors with data-rst or result classes, score and review count near them."""
    block = re.compile(r"<a[^>]+class=\"[^\"]*rst-name[^\"]*\"[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>(.*?)(?=<a[^>]+class=\"[^\"]*rst-name|\Z)", re.S)

    def one(page):
        out = []
        for url, name, rest in block.findall(page or ""):
            area = re.search(r"class=\"[^\"]*area-genre[^\"]*\"[^>]*>(.*?)<", rest, re.S)
            score = re.search(r"class=\"[^\"]*rating-val[^\"]*\"[^>]*>\s*([0-9.]+)", rest)
            reviews = re.search(r"class=\"[^\"]*review-count[^\"]*\"[^>]*>\s*([0-9,]+)", rest)
            out.append({"url": url, "name": " ".join(re.sub(r"<[^>]+>", " ", name).split()), "area": area and " ".join(area[1].split()), "score": float(score[1]) if score else None, "reviews": int(reviews[1].replace(",", "")) if reviews else None})
        return out

    return pages.map(one)


def follow_moves(moves: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, cyclic): where each moved link ends, however many moves away that is.

    Pointers are doubled, and the smallest link on the way is kept, in rounds written to the shared folder; a chain of n
    moves takes about log2(n). Links that lead into a cycle end at its smallest link, and cyclic is true. Of several
    targets of a source the smallest counts; null sources and targets are no moves.
    """
    moved = moves.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s is not null and t is not null").groupBy("s").agg(F.min("t").alias("t"))
    sources = moved.select(F.col("s").alias("k"))
    now = materialize(moved.join(sources, F.col("t") == F.col("k"), "left").select("s", "t", F.col("s").alias("low"), F.col("k").isNotNull().alias("open")), "moves")
    steps, bound = 1, None
    while True:
        left = now.filter("open").count()
        # a chain that isn't at its end has at most `left` links with the end more than `steps` away
        bound = steps + left if bound is None else min(bound, steps + left)
        if not left or steps >= bound:
            break
        ahead = now.select(F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        further = now.filter("open").join(ahead, F.col("t") == F.col("s2")).select("s", F.col("t2").alias("t"), F.least("low", "low2").alias("low"), F.col("open2").alias("open"))
        last, now = now, materialize(now.filter("not open").unionAll(further), "moves")
        discard(last)
        steps *= 2
    lows = now.filter("open").select(F.col("s").alias("s2"), F.col("low").alias("low2"))
    out = now.join(lows, F.col("open") & (F.col("t") == F.col("s2")), "left")
    return out.select(F.col("s").alias(source), F.when(F.col("open"), F.col("low2")).otherwise(F.col("t")).alias(target), F.col("open").alias("cyclic"))


def localized(json_column, field: str, locale: str = "en") -> Column:
    """translations.<locale>.field, else field, else title."""
    j = lambda p: F.nullif(F.get_json_object(_c(json_column), p), F.lit(""))
    return F.coalesce(j(f"$.translations.{locale}.{field}"), j(f"$.{field}"), j("$.title"))


def station_hints(text) -> Column:
    """Names before "station" or "sta.", one of each that differ in more than case and punctuation; the last one
    comes first where the text speaks of the nearest station."""
    t = F.coalesce(_c(text), F.lit(""))
    names = F.regexp_extract_all(t, F.lit(r"(?i:nearest station(?: is|:)? ?)?([A-Z][A-Za-z'-]*(?: [A-Z][A-Za-z'-]*){0,2}) (?:Station|Sta\.)"), 1)
    n = F.size(names)
    names = F.when(F.lower(t).contains("nearest station") & (n > 1), F.concat(F.slice(names, -1, 1), F.slice(names, 1, n - 1))).otherwise(names)
    keys = F.transform(names, lambda x: match_text(x))
    return F.filter(names, lambda x, i: F.array_position(keys, match_text(x)) == i + 1)


def search_variants(names, city, prefecture, prefix, locations, digits, block, phones) -> Column:
    """Distinct array<struct(label, text)> of a venue's search queries, by name and then by phone alone.

    names (of which the first four without Japanese signs count), locations (four) and phones are arrays; prefix is
    the place's part of the search URL. For each name: alone, with the city, with city and prefecture; with each
    location and the address's digits, within the prefecture and overall; with the address block and two phones; at
    last three phones. Queries by prefecture need the prefix; those overall need city and prefecture.
    """
    none = F.array().cast("array<string>")
    texts = lambda a, n: F.filter(F.slice(F.coalesce(_c(a), none), 1, n), lambda x: F.coalesce(x, F.lit("")) != "")
    one = lambda x: F.filter(F.array(_c(x).cast("string")), lambda y: F.coalesce(y, F.lit("")) != "")
    city, prefecture = F.trim(F.coalesce(_c(city), F.lit(""))), F.trim(F.coalesce(_c(prefecture), F.lit("")))
    here, overall = F.coalesce(_c(prefix), F.lit("")) != "", (city != "") & (prefecture != "")
    japanese = r"[\u3040-\u30ff\u3400-\u9fff]"

    def query(when, kind, shown, text):
        return F.when(when, F.struct(F.concat(F.lit(kind + ":"), shown).alias("label"), text.alias("text")))

    def of(name):
        words = lambda *w: F.concat_ws(" ", name, *w)
        places = F.concat(texts(locations, 4), one(digits))
        first = F.array(query(here, "prefecture_name", name, name), query(here & (city != ""), "prefecture_name_city", words(city), words(city)), query(overall, "global_name_city_prefecture", words(city, prefecture), words(city, prefecture)))
        by_place = F.flatten(F.transform(places, lambda p: F.array(query(here, "prefecture_name_location", words(p), words(p)), query(overall, "global_name_location", words(p), words(p, prefecture)))))
        extra = F.transform(F.concat(one(block), texts(phones, 2)), lambda p: query(here, "prefecture_name_extra", words(p), words(p)))
        return F.concat(first, by_place, extra)

    usable = F.slice(F.filter(F.coalesce(_c(names), none), lambda x: (F.coalesce(x, F.lit("")) != "") & ~x.rlike(japanese)), 1, 4)
    found = F.concat(F.flatten(F.transform(usable, of)), F.transform(texts(phones, 3), lambda p: query(here, "prefecture_phone_only", p, p)))
    return F.array_distinct(F.filter(found, lambda q: q.isNotNull() & ((match_text(q["text"]) != "") | q["text"].rlike(japanese))))


def query_variants(name: Column, city: Column, district: Column, phone: Column, limit: int = 28) -> Column:
    """Distinct array<struct(label, text)> of search queries, most specific first."""
    q = lambda label, *parts: F.struct(F.lit(label).alias("label"), compact_space(F.concat_ws(" ", *parts)).alias("text"))
    items = F.array(q("name_district_city", name, district, city), q("name_city", name, city), q("name_district", name, district), q("name", name), q("phone", phone))
    items = F.filter(items, lambda s: s["text"] != "")
    texts = F.transform(items, lambda s: s["text"])
    return F.slice(F.filter(items, lambda s, i: F.array_position(texts, s["text"]) == i + 1), 1, limit)
