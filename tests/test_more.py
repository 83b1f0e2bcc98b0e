"""Literal rows for operators that no carrier covers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, numbers, text
from quillon.operators import lookup, match, parse, rules, views
from quillon.sources import readers, sinks

L = F.lit


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


GOOD = "A seasonal tasting menu with seafood from the harbour served daily at the counter."


@pytest.mark.parametrize(
    "value,ok",
    [
        (GOOD, True),
        ("Too short to say anything", False),
        ("Please accept our cookie policy before you go on to the rest of this site", False),
        ("We are open on Monday and on Tuesday and serve a seasonal menu all day", False),
        ("Find us at 123 High Street in the middle of the old town today", False),
        ("Call 12345678 or write to us any time you want to know more", False),
        ("", False),
        (None, False),
    ],
)
def test_meaningful_text(one, value, ok):
    assert one(parse.meaningful_text(L(value).cast("string"), L("t"), L("n"))) is ok


def test_text_and_page_scores(one):
    assert one(parse.text_score(L(GOOD), L("t"), L("Counter"), 18.0)) == 20 + 18 + 10 + 3 + 8
    assert one(parse.text_score(L(GOOD), L(GOOD), L("x"))) == -100
    none = F.array().cast("array<string>")
    assert one(parse.page_score(L("t"), L("d"), none, F.array(L("k")), none, L(39.0), L("https://x.example/about"))) == 4 + 25 + 5 + 39 + 4
    assert one(parse.page_score(L(""), L(None).cast("string"), none, none, none, L(None).cast("double"), L("https://x.example/booking"))) == -3


def test_detail_score(one):
    s = match.detail_score(
        [(L("tokyo"), L("tokyo 1 2"), 2.0, -3.0), (L("ginza"), L("shibuya"), 2.5, -2.0), (L(""), L("x"), 2.5, -3.0)],
        L(0.7),
        (L("0312345678"), L("0312345678")),
        (L("123"), L("91234")),
        (L("Ginza"), L("Ginza")),
        (L(1000), L(2000), L(1500), L(3000)),
        (L("sushi"), L("ramen")),
        (L("Blue Door"), L("Blue Gate")),
    )
    assert one(s) == 2.0 - 2.0 + 3.0 + 4.0 + 3.0 + 3.0 + 1.5 + 0 + 2.0


def test_candidate_score(one):
    s = match.candidate_score(L("Blue Door"), L("blue door annex"), {"city": (L("Tokyo"), 1.5)}, L("Tokyo / sushi"), L("sushi"), L(120), L(0.7), L(1.0))
    assert one(s) == round(10 + 0.7 * 12 + 1.5 + 0.5 * 3 + 1.0 + 0.5, 4)
    assert one(match.candidate_score(L("a b"), L("c d"), {}, L(""), L(""), L(None).cast("int"))) == -2
    assert one(match.native_strength(L("鮨"), F.array(L("鮨"), L("x")))) == 1.0 and one(match.native_strength(L("鮨本"), F.array(L("鮨")))) == 0.7 and one(match.native_strength(L(""), F.array(L("x")))) == 0


def test_staged_match(spark):
    rows = [(1, i, "blue door" if i == 3 else f"blue x{i}", 90 if i == 3 else 40) for i in range(1, 8)]
    pairs = spark.createDataFrame(rows, "id int, other int, name string, conf int")
    seen = []

    def detail(df):
        seen.append(df.count())
        return df.withColumns({"status": F.when(F.col("conf") >= 70, "verified").otherwise("reject"), "confidence": F.col("conf"), "reasons": F.array(L("r")), "conflicts": F.array().cast("array<string>")})

    out = match.staged_match(pairs, "id", text.overlap_score("name", L("blue door")), 4, detail, 2, "other").orderBy("rank").collect()
    assert seen == [4] and [(r.other, r.rank) for r in out][0] == (3, 1) and len(out) == 2
    assert out[0].status == "review" and out[0].reasons[-1] == "close_runner_up"


def test_first_match(spark):
    left = spark.createDataFrame([(1, "a b c", "jp"), (2, "x", "jp")], "k int, name string, country string")
    right = spark.createDataFrame([(0, "c b a z", "jp", "u0"), (1, "a b c", "jp", "u1"), (2, "a b c", "us", "u2")], "o int, hit string, c2 string, url string")
    out = lookup.first_match(left, right, F.col("country") == F.col("c2"), text.overlap_score("name", "hit") >= 0.6, "k", "o", "url")
    assert {r.k: r.url for r in out.collect()} == {1: "u0", 2: None}


def test_dates_and_numbers(one):
    days = one(dates.month_days(L("2026-05")))
    assert days[:6] == [None] * 5 + [dt.date(2026, 5, 1)] and len(days) == 36
    now = L("2026-05-31 15:59:00").cast("timestamp")
    assert one(dates.past_end_of_day(L("2026-05-31").cast("date"), now, "Asia/Singapore")) is False
    assert one(dates.past_end_of_day(L("2026-05-31").cast("date"), L("2026-05-31 16:01:00").cast("timestamp"), "Asia/Singapore")) is True
    assert one(dates.distance_label(dates.time_distance(L("19:30"), L("19:00")))) == "+30 min" and one(dates.distance_label(dates.time_distance(L("x"), L("19:00")))) == ""
    assert one(numbers.money_range(L(1000), L(2000))) == "¥1,000 - ¥2,000" and one(numbers.money_range(L(1000), L(None).cast("int"))) == "¥1,000+"
    assert tuple(one(numbers.price_bounds(L("JPY 8,000 - 9,999")))) == (8000, 9999) and one(numbers.price_bounds(L("?"))).low is None


def test_pages_of_results(spark):
    page = '<a class="list-rst__rst-name" href="https://x.example/1">Blue <b>Door</b></a><div class="area-genre"> Ginza / Sushi </div><span class="rating-val">3.58</span><em class="review-count">1,204</em><a class="list-rst__rst-name" href="https://x.example/2">Red</a>'
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(parse.result_blocks("html").alias("r")).collect()
    assert [(x.url, x.name, x.area, x.score, x.reviews) for x in rows[0].r] == [("https://x.example/1", "Blue Door", "Ginza / Sushi", 3.58, 1204), ("https://x.example/2", "Red", None, None, None)] and rows[1].r == []


def test_hints_and_lists(one):
    assert one(parse.station_hints(L("5 min from Ginza Station and Higashi Ginza Sta."))) == ["Ginza", "Higashi Ginza"]
    assert one(sinks.head_and_more(F.array(L("a"), L("b"), L("c")), 2)) == "a, b … and 1 more" and one(sinks.head_and_more(F.array(L("a")), 2)) == "a"
    assert one(rules.keyword_list(L("a, b;a| c "), 2)) == ["a", "b"]
    assert one(rules.sentence_filter(L("Book now! Good food. Nice."), "book now")) == "Good food. Nice."


def test_summaries(one):
    good = "The Blue Door is a small place in the old town and it serves the best of French food."
    assert one(views.accept_summary(L(good), L("Blue Door"), F.array(L("Thai")))) is True
    assert one(views.accept_summary(L(good), L("Red Gate"), F.array(L("French")))) is True
    assert one(views.accept_summary(L(good), L("Red Gate"), F.array(L("Thai")))) is False
    assert one(views.accept_summary(L("short"), L("short"), F.array(L("Thai")))) is False
    none = F.array().cast("array<string>")
    assert one(views.has_evidence(L(""), none, L(None).cast("string"), L(good), L("meta"))) is True and one(views.has_evidence(L(""), none, L(""), L(good), L("visible_text"))) is False
    assert one(views.has_evidence(L(""), F.array(L("t")), L(""), L(""), L(""))) is True and one(views.has_evidence(L(""), none, L(good), L(""), L(""))) is True
    assert one(views.is_verified(L("place_verified"), L(1.0), L(2.0))) is True and one(views.is_verified(L("source"), L(1.0), L(2.0))) is False and one(views.is_verified(L("place_verified"), L(None), L(2.0))) is False
    assert one(views.source_kind(L("Official API"), (("api", "api"), ("map", "sitemap")))) == "api"


def test_discount_filter(spark):
    ddl = "id string, name string, type string, cuisine string, notes string, opening_hours string, closing_note string, address string, phone string, lat double, lng double"
    rows = [("1", "Grill House", "restaurant", "Steak", "Minimum order of three dishes. Call 24 hours ahead.", "", "", "1 St", "+65 6123 4567", 1.0, 1.0), ("2", "Lobby", "hotel", "Cafe", "", "", "", "1 St; 2 St", "", None, None)]
    out = views.discount_profile(spark.createDataFrame(rows, ddl), ["2"])
    assert {(r.id, r.benefit.order_rule, r.benefit.savings, r.location) for r in out.collect()} == {("1", "three_items", "fifty", "mapped"), ("2", "one_per_diner", "twenty", "bundled")}
    assert [r.id for r in views.filter_discounts(out, booking="24h", search="gril").collect()] == ["1"] and views.filter_discounts(out, kind="hotel", savings="fifty").count() == 0


def test_catalog_and_assets(spark, tmp_path):
    made = []
    c = readers.Catalog(spark, {"a": lambda s: made.append("a") or s.range(3).toDF("x"), "b": lambda s: made.append("b") or s.range(1)}, {"home": ["a"]})
    c.route("home"), c.route("home")
    assert made == ["a"] and spark.table("a").count() == 3
    (tmp_path / "l.json").write_text('{"Menu A.pdf": {"created": "1", "url": "u"}, "logo.png": {"created": "2", "url": "v"}}')
    assert [r.asset for r in readers.read_assets(spark, str(tmp_path / "l.json"), r"(?i)menu.*\.pdf$").collect()] == ["Menu A.pdf"]
    for i in (1, 2):
        (tmp_path / f"page{i}.json").write_text(f'{{"page": {i}, "items": [{{"id": {i}}}]}}')
    assert sorted(r.id for r in readers.read_pages(spark, f"{tmp_path}/page*.json", "page int, items array<struct<id:int>>", "items").collect()) == [1, 2]
    assert lookup.selection(spark.range(9), "id", ids=spark.createDataFrame([(3,), (5,)], "id long")).count() == 2


def test_explorer_query(spark):
    from quillon.operators import facets

    rows = spark.createDataFrame([(1, "a", "Blue Door"), (2, "b", "Red Gate"), (3, "x", "Blue Gate"), (4, "c", "Blue Bar")], "id int, r string, name string")
    ratings = spark.createDataFrame([("a", 4.0, 10), ("b", 4.5, None), ("c", None, 5)], "id string, rating double, review_count int")
    ids = lambda q: [r.id for r in q.build(rows, ratings).collect()]
    q = facets.ExplorerQuery
    assert ids(q("id", "r", sort=[("rating", -1.0), ("review_count", 0)])) == [2, 1, 4, 3]
    assert ids(q("id", "r", min_rating=4.2)) == [2] and ids(q("id", "r", has_rating=True)) == [1, 2, 4]
    assert ids(q("id", "r", search="blu gate", search_col="name")) == [3] and ids(q("id", "r", pages=1, size=2)) == [1, 2]
    assert not q("id", "r").needs_ratings() and "rating" not in q("id", "r").build(rows, ratings).columns
    assert ids(q("id", "r", alias_col=F.lit("b"), sort=[("rating", -1.0)])) == [2, 3, 1, 4] and facets.active_count("", None, "x", []) == 1


def test_whole_table_ranges_against_brute_force(spark, tmp_path):
    import datetime as dt
    import random

    from quillon.plans import carriers

    rng = random.Random(4)
    at = lambda n: dt.datetime(1997, 1, 1) + dt.timedelta(days=n)
    orders = [(i, at(rng.randint(0, 80))) for i in range(60)]
    lines = [(o, n, rng.randint(1, 5), rng.randint(1, 50), at(rng.randint(0, 80))) for o, _ in orders for n in range(1, rng.randint(2, 5))]
    subs = [(i, i % 3) for i in range(1, 60)]
    suppliers = [(i, i % 3) for i in range(1, 7)]
    for name, rows, ddl in (("orders", orders, "o_orderkey long, o_orderdate timestamp"), ("lineitem", [(*x, "A") for x in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity int, l_shipdate timestamp, l_returnflag string"), ("customer", subs, "c_custkey long, c_nationkey int"), ("supplier", suppliers, "s_suppkey long, s_nationkey int")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: sorted(map(tuple, carriers.queries()[name](spark, str(tmp_path)).collect()))
    day = dt.timedelta(days=1)
    windows = {(o, d, x[2]) for o, d in orders for x in lines if x[0] == o}
    pairs = sorted((o, s, x[0], x[1]) for o, d, s in windows for x in lines if x[2] == s and d < x[4] + 4 * day and x[4] < d + 2 * day)
    assert pairs and run("range_join_pairs") == pairs
    assert run("range_join_semi") == sorted({(p[0],) for p in pairs})
    nation = dict(suppliers)
    want = sorted((c, x[2], x[0], x[1]) for c, k in subs for x in lines if nation[x[2]] == k and x[3] >= c % 40 + 10 and at(c % 30) <= x[4] <= dt.datetime(1997, 2, 1))
    assert want and run("subscription_slots") == want
    stays = {s: [x for x in lines if x[2] == s] for s in nation}
    hit = lambda x: x[4] < dt.datetime(1997, 3, 10) and dt.datetime(1997, 3, 1) < x[4] + 4 * day
    assert run("stay_window") == sorted((s, "blocked" if any(map(hit, v)) else "not_blocked" if v else "subject_to_availability") for s, v in stays.items())
