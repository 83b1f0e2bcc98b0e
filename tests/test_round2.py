"""Lost rows, caps, content overrides and inferred places: literal cases and brute-force comparisons."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers, text
from quillon.operators import dedupe, lookup, parse, ranges, rules
from quillon.streaming import alerts

L = F.lit


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


def test_unique_ids_keeps_null_and_repeated_rows(spark):
    rows = [(None, None, 1), ("a", None, 2), ("a", None, 3), ("b", "b-x", 4), (None, "b", 5), (None, "c", 6), (None, "c", 6), ("d", "d", None)]
    df = spark.createDataFrame(rows, "base string, ext string, k int")
    out = [(r.k, r.record_id) for r in dedupe.unique_ids(df, F.col("base"), F.col("ext"), F.col("k")).collect()]
    assert len(out) == 8 and all(i for _, i in out)
    ids = dict(out)
    assert ids[4] == "b" and ids[5].startswith("b-") and ids[6].startswith("c-") and ids[None] == "d"
    assert len(set(ids.values())) == len(ids)


def test_an_id_with_suffix_gives_way_to_one_that_has_it_already(spark):
    import hashlib

    taken = "a-x-" + hashlib.sha1(b"1").hexdigest()[:8]
    df = spark.createDataFrame([("a", "a-x", 1), ("a", "a-x", 2), (taken, "q", 3)], "base string, ext string, k int")
    ids = {r.k: r.record_id for r in dedupe.unique_ids(df, F.col("base"), F.col("ext"), F.col("k")).collect()}
    assert ids[3] == taken and len(set(ids.values())) == 3 and ids[1] == "a-x-" + hashlib.sha1(b"1").hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_semi_range_join_keeps_repeated_rows(spark, seed):
    r = random.Random(seed)
    span = lambda k: [(r.choice("ab"), lo := r.randrange(60), lo + r.randrange(0, 25)) for _ in range(k)]
    left, right = span(30) * 2 + span(10) + [("a", None, 3), (None, 1, 9)], span(6)
    a, b = spark.createDataFrame(left, "g string, lo int, hi int"), spark.createDataFrame(right, "g2 string, lo2 int, hi2 int")
    want = sorted(x for x in left if None not in x and x[1] < x[2] and any(x[0] == y[0] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2] for y in right))
    for width in (1, 7, 100):
        assert sorted(map(tuple, ranges.range_join(a, b, ("lo", "hi"), ("lo2", "hi2"), width, ("g", "g2"), how="left_semi").collect())) == want


def test_zip_without_groups(spark):
    a = spark.createDataFrame([(i, i * 3) for i in range(50)], "i int, o int").repartition(4)
    b = spark.createDataFrame([(100 - i, f"n{i}") for i in range(40)], "p int, name string").repartition(3)
    got = {r.i: r.name for r in lookup.zip_by_position(a, b, "o", "p", "name").collect()}
    assert got == {i: f"n{39 - i}" if i < 40 else None for i in range(50)}


def test_long_texts_are_whole(one):
    assert one(text.title_words(L("x" * 30_000 + " yz"))) == "X" + "x" * 29_999 + " Yz"
    assert one(rules.drop_navigation(L(" | ".join(["a", "b", "one two three four five six seven", *["z"] * 3000])))).count("z") == 3000


def test_alert_rows_in_several_frames():
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    r = random.Random(5)
    for _ in range(200):
        rows = [(i, r.random() < 0.1, r.random() < 0.3) for i in range(r.randrange(1, 12))]
        state, want = frozenset(), []
        for seq, match, expired in rows:
            state, event = alerts.step(state, match, expired)
            want += [("s", event, seq)] if event else []
        r.shuffle(rows)
        cut = r.randrange(len(rows) + 1)
        frames = [pd.DataFrame(x, columns=["seq", "has_match", "expired"]) for x in (rows[:cut], rows[cut:])]
        p = alerts.alert_processor()
        p.sent = Held()
        assert [tuple(x) for f in p.handleInputRows(("s",), iter(frames), None) for x in f.itertuples(index=False)] == want
        assert set(p.sent.value[0].split(",")) - {""} == state


def test_segments_are_told_by_content():
    assert [parse.segment_field(s, t) for s, t in ((0, "Grand Hotel"), (20, "1 Main Rd"), (41, "Deluxe"), (70, "24 May"), (90, "x"))] == ["name", "address", "room", "exclusions", "contact"]
    assert {parse.segment_field(20, t) for t in ("a@b.example", "hotel.com", "+65 1234", "Reservations-Asia", "WRESERVATIONS.x")} == {"contact"}
    assert {parse.segment_field(3, t) for t in ("Subject to availability", "• 24 May", "Opening Q2 2026")} == {"exclusions"}


def test_listing_entries(spark):
    spark.udtf.register("listing", parse.Listing)
    pad = lambda *c: "".join(x.ljust(w) for x, w in zip(c, (16, 24, 24, 24, 1))).rstrip()
    table = [pad("One Hotel", "30 Beach Road", "Deluxe"), pad("", "Singapore 189763"), pad("Two Hotel", "8 Hill St", "Suite"), "12", "", "", pad("Three", "11100 Teluk", "Twin")]
    doc = "\n".join(["intro", "Participating Hotels     Eligible Room Type", "Property", "", *table, "Terms and Conditions", "1. x"])
    rows = spark.sql("select * from listing(:t)", args={"t": doc}).collect()
    assert [(r.block_no, r.first_line) for r in rows] == [(0, 4), (1, 6), (2, 10)]
    assert [r.text for r in rows] == ["\n".join(table[:2]), table[2], table[6]]
    assert spark.sql("select * from listing(:t)", args={"t": "no table"}).count() == 0
    assert spark.sql("select * from listing(cast(null as string))").count() == 0


@pytest.mark.parametrize("address,prefecture,area,town,want", [
    ("Nakajima-cho, Nakagyo-ku, Kyoto-shi", "Kyoto", None, None, "Kyoto"),
    ("1-1, Chiyoda-ku, Tokyo", None, None, None, "Tokyo"),
    ("x, Karuizawa-machi, Nagano", "Nagano", None, None, "Karuizawa"),
    ("x, minami-uonuma-shi", "Niigata", None, None, "Minami Uonuma"),
    ("Gion, KYOTO city", "Shiga", None, None, "Kyoto"),
    ("-shi, Hakuba-mura", None, None, None, "Hakuba"),
    (None, "", "Greater Tokyo Area", "Meguro", "Tokyo"),
    (None, "okinawa", None, None, "Okinawa"),
    (None, None, "Hokkaido", "niseko", "Niseko"),
    (None, None, None, None, "Japan"),
])
def test_city(one, address, prefecture, area, town, want):
    assert one(rules.infer_city(*[L(x).cast("string") for x in (address, prefecture, area, town)])) == want


@pytest.mark.parametrize("town,area,city,want", [("Gion", "Kyoto/Osaka/Nara", "Kyoto", "Gion"), ("kyoto", "Arashiyama", "Kyoto", "Arashiyama"), (" ", "Tokyo", "Kyoto", None), (None, None, "Kyoto", None), ("Ginza", None, None, "Ginza")])
def test_district(one, town, area, city, want):
    assert one(rules.infer_district(*[L(x).cast("string") for x in (town, area, city)])) == want


def test_service_price(one):
    prices = F.from_json(L('[{"serviceType":"dinner","min":5,"max":9},{"serviceType":"lunch","min":1},{"serviceType":"lunch","min":3,"max":4}]'), "array<struct<serviceType:string,min:int,max:int>>")
    assert tuple(one(rules.service_price(prices, "lunch"))) == (1, None) and one(rules.service_price(prices, "bar")) is None
    assert one(rules.service_price(L(None).cast("array<struct<serviceType:string,min:int,max:int>>"), "lunch")) is None


def test_nearest_station_first(one):
    assert one(parse.station_hints(L("Ginza Station, Shimbashi Station. The nearest station: Higashi Ginza Station"))) == ["Higashi Ginza", "Ginza", "Shimbashi"]
    assert one(parse.station_hints(L("Ginza Station or GINZA Station"))) == ["Ginza"] and one(parse.station_hints(L(None).cast("string"))) == []


def test_search_variants(one):
    arr = lambda *x: F.array(*map(L, x)).cast("array<string>")
    q = lambda *a: [(r.label, r.text) for r in one(parse.search_variants(*a))]
    got = q(arr("Sushi A", "鮨", None, "B"), L("Kyoto"), L("Kyoto"), L("kyoto"), arr("Gion"), L("12"), L("1-2"), arr("075", "0-75", "75", "x"))
    assert [t for label, t in got if label.endswith("Sushi A") or "Sushi A " in label] == ["Sushi A", "Sushi A Kyoto", "Sushi A Kyoto Kyoto", "Sushi A Gion", "Sushi A Gion Kyoto", "Sushi A 12", "Sushi A 12 Kyoto", "Sushi A 1-2", "Sushi A 075", "Sushi A 0-75"]
    assert len(got) == 2 * 10 + 3 and got[-1] == ("prefecture_phone_only:75", "75") and not any("鮨" in t for _, t in got)
    none = L(None).cast("string")
    assert q(arr("A"), none, none, none, arr(), none, none, arr("1")) == []
    assert [label.split(":")[0] for label, _ in q(arr("A"), L("C"), L("P"), none, arr("D"), none, none, arr("1"))] == ["global_name_city_prefecture", "global_name_location"]


def test_pin_notes(one):
    point = lambda a, b: F.struct(L(float(a)).alias("lat"), L(float(b)).alias("lng"))
    none, t, f = L(None).cast("struct<lat:double,lng:double>"), L(True), L(False)
    near, far = point(35.001, 139), point(35.01, 139)
    note = lambda *p: one(numbers.adjudicate(*p)).note
    assert note(point(35, 139), near, none, f, f, none, t, t) == "source_matches_link"
    assert note(far, near, none, f, f, none, t, t) == "source_drifted_from_link"
    assert note(far, near, near, t, t, none, t, t) == "source_drifted_from_verified_link"
    assert note(far, near, none, f, f, none, f, t) == "link_without_source"
    assert note(far, none, none, f, f, none, t, f) is None
