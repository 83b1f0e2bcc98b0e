"""Literal rows for the column functions; expected values follow from the behaviour that is to be matched."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, numbers, text
from quillon.operators import match, ranges, rules, slots


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


L = F.lit
D = lambda s: F.lit(s).cast("date")


@pytest.mark.parametrize("value,query,want", [("Small Widget", "smal wiget", True), ("sushi bar", "bra", False), ("sushi bar", "bar", True), ("", "x", False), (None, "x", False), ("anything", "", True), ("Kyoto Ramen", "kyoti", True), ("Kyoto Ramen", "kiati", False)])
def test_fuzzy_match(one, value, query, want):
    assert one(text.fuzzy_match(L(value).cast("string"), query)) is want


@pytest.mark.parametrize("value,key", [(4999, "under-5k"), (5000, "5k-10k"), (20000, "20k-plus"), (None, None), (-1, None)])
def test_bands(one, value, key):
    found = one(numbers.band(L(value).cast("int")))
    assert (found and found.key) == key


@pytest.mark.parametrize("score,want", [(3.99, 4.5), (3.5, 4.5), (3.05, 2.0), (2.9, 1.0), (4.0, 5.0), (None, None)])
def test_stars(one, score, want):
    assert one(numbers.stars(L(score).cast("double"))) == want


def test_seats_differ_by_consumer(one):
    listed = F.array(L("2"), L("4"), L("x"))
    assert one(numbers.seats_shown(listed, L(6), L(0), L(2))) == 4
    assert one(numbers.seats_alerted(listed, L(6))) == 6
    none = F.array().cast("array<string>")
    assert one(numbers.seats_shown(none, L(0), L(5), L(2))) == 5 and one(numbers.seats_shown(none, L(0), L(0), L(2))) == 2
    assert one(numbers.seats_stored(none, L("7"))) == 7


@pytest.mark.parametrize("value,want", [("12:14", "12:00"), ("12:15", "12:30"), ("23:59", "23:30"), ("24:00", ""), ("", ""), (None, ""), ("9:50", "10:00")])
def test_half_hour(one, value, want):
    assert one(dates.half_hour(L(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("03/04/2026", "2026-04-03"), ("13/31/2026", "13/31/2026"), ("12/31/2026", "2026-12-31"), ("3 May 2026", "2026-05-03"), ("2026-05-03", "2026-05-03"), ("", ""), (None, ""), ("soon", "soon")])
def test_dates(one, value, want):
    assert one(dates.parse_date_text(L(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("4 pax", 4), ("", 2), ("0", 1), (None, 2)])
def test_party_size(one, value, want):
    assert one(numbers.party_size(L(value).cast("string"))) == want


@pytest.mark.parametrize(
    "value,start,end,label,tentative,note",
    [
        ("• 20 – 31 December 2026", "2026-12-20", "2026-12-31", "20 - 31 December 2026", False, None),
        ("20 December - 5 January 2027", "2027-12-20", "2027-01-05", "20 December - 5 January 2027", False, None),
        ("3 May - 4 June (Tentative)", "2026-05-03", "2026-06-04", "3 May - 4 June", True, None),
        ("14 February 2026", "2026-02-14", "2026-02-14", "14 February 2026", False, None),
        ("Eve of public holidays", None, None, "Eve of public holidays", False, "Eve of public holidays"),
        ("", None, None, "", False, None),
    ],
)
def test_exclusions(one, value, start, end, label, tentative, note):
    x = one(dates.parse_exclusion(L(value)))
    day = lambda s: s and dt.date.fromisoformat(s)
    assert tuple(x) == (day(start), day(end), label, tentative, note)


def test_exclusion_roll_over(one):
    x = one(dates.parse_exclusion(L("20 December - 5 January 2027"), roll_over=True))
    assert (x.start, x.end) == (dt.date(2027, 12, 20), dt.date(2028, 1, 5))


def test_expiry(one):
    listed = F.array(D("2026-05-01"), D("2026-05-10"))
    assert one(dates.expiry_date(listed, L(None).cast("date"), D("2026-05-05"))) == dt.date(2026, 5, 1)
    assert one(dates.expiry_date(F.array().cast("array<date>"), L(None).cast("date"), D("2026-05-05"))) == dt.date(2026, 5, 5)
    assert one(dates.is_expired(listed, L(None).cast("date"), D("2026-05-05"), D("2026-05-02"))) is True


@pytest.mark.parametrize("start,end,blocked", [("2026-12-31", "2027-01-02", True), ("2027-01-01", "2027-01-02", False), ("2026-12-18", "2026-12-20", False), ("2026-12-18", "2026-12-21", True)])
def test_stay_overlap(one, start, end, blocked):
    r = F.array(F.struct(D("2026-12-20").alias("start"), D("2026-12-31").alias("end"), L("xmas").alias("label"), L(False).alias("tentative")))
    s = one(ranges.stay_status(r, F.array().cast("array<string>"), L(""), D(start), D(end)))
    assert s.blocked is blocked and s.key == ("blocked" if blocked else "not_blocked")


def test_stay_status_without_dates(one):
    none = F.array().cast("array<struct<start:date,end:date,label:string,tentative:boolean>>")
    notes = F.array().cast("array<string>")
    assert one(ranges.stay_status(none, notes, L("Subject to availability"))).key == "subject_to_availability"
    assert one(ranges.stay_status(none, notes, L("Not in May"))).key == "notes_only"


def test_margin_numbers(one):
    assert round(one(match.preference(L(70), L(50))), 3) == 0.924 and round(one(match.log_gap(L(70), L(50))), 3) == 0.331
    assert round(one(match.log_gap(L(86), L(0))), 3) == 4.466
    assert one(match.clear_win(L(70), L(50))) is False and one(match.clear_win(L(86), L(0))) is True


def test_assessment(one):
    yes = dict.fromkeys(["has_prefecture", "prefecture", "has_city", "city", "has_district", "district", "digits_both", "digits_exact", "phone_exact", "english"], L(True))
    no = dict.fromkeys(["locality_missing", "digits_partial", "block", "phone_conflict", "native", "station", "cuisine"], L(False))
    x = one(match.assess(yes | no))
    assert (x.status, x.confidence, x.conflicts) == ("verified", 86, []) and "phone_exact" in x.reasons
    x = one(match.assess(yes | no | {"city": L(False), "phone_exact": L(False), "phone_conflict": L(True)}))
    assert x.conflicts == ["city_mismatch"] and "phone_changed_likely" in x.reasons
    x = one(match.assess(dict.fromkeys(yes | no, L(False))))
    assert (x.status, x.confidence) == ("reject", 0)


@pytest.mark.parametrize("value,want", [("  A   b\n c ", "A b c"), (None, "")])
def test_compact_space(one, value, want):
    assert one(text.compact_space(L(value).cast("string"))) == want


def test_text_helpers(one):
    assert one(text.shorten_address(L("12th West Road & Co., No. 5 / Section 3"))) == "12 w rd and co 5 sec 3"
    assert one(text.ascii_fold(L("Café Ünï"))) == "Cafe Uni"
    assert one(text.unicode_key(L("Ｓｕｓｈｉ 鮨 (すし)"))) == "sushi鮨"
    assert one(text.plain_text(L("<p>a &amp; b</p><b>c</b>"))) == "a & b c"
    assert one(text.html_escape(L("<a href=\"x\">'&'"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"
    assert one(text.natural_list(F.array(L("a"), L("b"), L("c")))) == "a, b, and c" and one(text.natural_list(F.array().cast("array<string>"))) == ""
    assert one(text.tidy_address(L("1 Main St,, 1 main st / Tokyo, Japan"), L("japan"))) == "1 Main St, Tokyo"
    assert one(text.canonical_address(L("5 High Road 10115 Berlin Germany"), L("Germany"))) == "5 high rd berlin"
    assert one(text.slug(L(" Le Café! No.1 "))) == "le-caf-no-1"
    assert one(text.strip_suffix(L("鮨幸 銀座店 (新館)"))) == "鮨幸" and one(text.strip_suffix(L("鮨幸 本店"))) == "鮨幸"
    assert one(text.primary_block(L("5 Ginza 3-14-5"))) == "3-14-5" and one(text.primary_block(L("none"))) == ""
    assert one(text.split_values(L("a, b\nc;|d"))) == ["a", "b", "c", "d"]
    assert one(text.sessions(L("Lunch | any, afternoon tea, DINNER"), {"lunch": ["lunch"], "afternoon tea": ["afternoon", "tea"], "dinner": ["dinner"]})) == ["afternoon tea", "dinner", "lunch"]
    assert one(text.first_truthy(L(""), L(None), L("x"))) == "x"
    assert one(text.collapse_runs(F.array(L("a"), L("a"), L("b"), L("a")))) == ["a", "b", "a"]
    assert one(text.distinct_ignoring_case(F.array(L("A"), L("a"), L("b")), 5)) == ["A", "b"]
    assert one(text.similarity(L("abcd"), L("abed"))) == 0.75 and one(text.similarity(L("abc"), L("b"))) == 1.0 and one(text.similarity(L(""), L("b"))) == 0.0
    assert one(text.blocks_match(L("Ginza 3-14-5"), L("3-14-5 Ginza"))) is True and one(text.blocks_match(L("1-2"), L("3-4"))) is False


def test_urls(one):
    assert one(text.canonical_url(L("http://www.X.example/a/b/?q=1#z"))) == "https://x.example/a/b" and one(text.canonical_url(L("nothing"))) is None
    assert one(text.url_ladder(L("http://x.example/a/b#c"))) == ["http://x.example/a/b", "https://x.example/a/b", "https://x.example/a/", "http://x.example/a/", "https://x.example/", "http://x.example/"]
    assert one(text.url_ladder(L("https://x.example/book/t")))[:3] == ["https://x.example/book/t", "https://x.example/", "http://x.example/"] and one(text.url_ladder(L("")))== []
    for link in ("https://m.example/@35.5,139.25,17z", "https://m.example/?q=35.5,139.25", "https://m.example/data=!3d35.5!4d139.25"):
        assert tuple(one(text.map_coordinates(L(link)))) == (35.5, 139.25)
    assert one(text.map_coordinates(L("https://m.example/place"))) is None
    assert one(text.phone_variants(L("+81 3 1234 5678")))[:3] == ["0312345678", "03-1234-5678", "03 1234 5678"]


def test_rules(one):
    assert one(rules.first_rule(L("This will not be eligible; temporarily closed"), rules.STATUS_RULES)) == "closing_soon"
    assert one(rules.order_rule(L("Hotpot"), L(True))) == "buffet" and one(rules.order_rule(L("x"), L(True))) == "one_per_diner" and one(rules.order_rule(L("x"), L(False))) == "two_mains"
    b = one(rules.benefit(L("Permanently closed"), L(False), L(True)))
    assert (b.savings, b.applies_to, b.max_percent) == ("unavailable", "special", 20)
    assert one(rules.all_rules(L("Call 24h ahead"), rules.BOOKING_RULES, "not_stated")) == ["24h", "phone"] and one(rules.all_rules(L("x"), rules.BOOKING_RULES, "not_stated")) == ["not_stated"]
    assert one(rules.is_english(L("This is a place that we like and it has the best of all dishes"))) is True
    assert one(rules.is_english(L("Questo locale offre piatti tipici della cucina romana tradizionale sempre"))) is False and one(rules.is_english(L("東京の店"))) is False
    assert one(rules.drop_navigation(L("Home | Menu | Book | A quiet room with a view over the old harbour."))) == "A quiet room with a view over the old harbour."
    assert one(rules.drop_navigation(L("a | b"))) == "a | b"
    assert one(rules.policy_excerpt(L("Nice place. Only children over 6. Bye."))) == "children over 6." and one(rules.policy_excerpt(L("x"))) is None
    none = F.array().cast("array<string>")
    for note, want in (("over 6", "kid_friendly"), ("12+", "older_children_only"), ("13", "teens_only"), ("All welcome", "kid_friendly"), ("ask us", "policy_available"), (None, "unknown")):
        assert one(rules.child_policy(L(note).cast("string"), none)) == want
    assert one(rules.child_policy(L("13"), F.array(L("child-friendly")))) == "kid_friendly"
    c = one(rules.contacts(F.array(L("Call +65 6123 4567"), L("a@b.example"))))
    assert (c.email, c.phone, c.mode) == ("a@b.example", "+65 6123 4567", "email_or_phone")
    assert one(rules.longest_alias(L("Hotel in Hong Kong, China"), [("china", "CN"), ("hong kong", "HK")])) == "HK"
    assert one(rules.location_key(L(2), L(1), L(True))) == "bundled"


def test_adjudication(one):
    point = lambda a, b: F.struct(L(float(a)).alias("lat"), L(float(b)).alias("lng"))
    none = L(None).cast("struct<lat:double,lng:double>")
    t, f = L(True), L(False)
    a, near, far = point(35, 139), point(35.001, 139), point(36, 139)
    x = lambda *p: one(numbers.adjudicate(*p))
    assert x(a, none, near, t, f, none, t, f).confidence == "place_verified"
    assert x(a, a, near, f, f, none, t, t).origin == "link"
    assert x(a, a, far, f, t, none, t, t).confidence == "location_conflict"
    assert x(a, a, far, f, f, none, t, t).confidence == "link_verified"
    assert x(a, none, near, f, t, none, t, f).origin == "place"
    assert x(a, none, far, f, t, none, t, f).origin == "source"
    assert x(a, none, far, f, t, none, f, f).origin == "place"
    assert x(a, none, none, f, f, near, f, f).origin == "fallback"
    assert x(none, none, none, f, f, none, f, f).lat is None


def test_haversine(one):
    assert abs(one(numbers.haversine_km(L(35.6812), L(139.7671), L(34.7025), L(135.4959))) - 403.5) < 1.5
    assert one(numbers.haversine_km(L(1.0), L(2.0), L(1.0), L(2.0))) == 0


def test_intent():
    assert slots.intent("sushi dinner for 4 pax weekend 19:30 ginza") == ({"session": "dinner", "day": "weekend", "party": 4, "time": "19:30"}, "sushi for ginza")
