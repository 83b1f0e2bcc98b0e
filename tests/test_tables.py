"""Operators on tables: properties, sources and sinks, parsers, streams."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import dedupe, diff, lookup, match, parse, ranges, slots
from quillon.sources import readers, sinks
from quillon.streaming import alerts, latest
from tests.conftest import SF


def test_diff_of_a_table_with_itself_is_empty(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    assert diff.snapshot_diff(df, df, ["o_orderkey"]).filter("change_type <> 'same'").count() == 0


def test_diff_last_of_repeated_keys_wins(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, o int")
    new = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "x", 2)], "id int, v string, o int")
    assert {(r.id, r.change_type) for r in diff.snapshot_diff(old, new, ["id"], "o").collect()} == {(1, "same"), (2, "added")}


def test_without_fields(spark):
    df = spark.createDataFrame([(1, "t", (2, "t"), [(3, "t")])], "a int, at string, s struct<b:int,at:string>, x array<struct<c:int,at:string>>")
    assert diff.without_fields(df, "at").schema.simpleString() == "struct<a:int,s:struct<b:int>,x:array<struct<c:int>>>"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), max_size=15), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), max_size=15), st.integers(1, 30))
def test_bucketed_join_is_the_theta_join(spark, a, b, width):
    left = spark.createDataFrame([(i, x, x + n) for i, (x, n) in enumerate(a)], "i int, lo long, hi long")
    right = spark.createDataFrame([(j, x, x + n) for j, (x, n) in enumerate(b)], "j int, lo2 long, hi2 long")
    got = sorted((r.i, r.j) for r in ranges.range_join(left, right, ("lo", "hi"), ("lo2", "hi2"), width).collect())
    want = sorted((i, j) for i, (x, n) in enumerate(a) for j, (y, m) in enumerate(b) if n and m and x < y + m and y < x + n)
    assert got == want


def test_subscriptions_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    day = lambda: dt.date(2026, 5, rng.randint(1, 9))
    subs = [(i, rng.randint(1, 4), rng.sample([1, 2, 3], rng.randint(0, 2)), rng.sample(["lunch", "dinner"], rng.randint(0, 1)), [day() for _ in range(rng.randint(0, 2))], rng.choice([None, day()]), rng.choice([None, day()])) for i in range(40)]
    offer = [(rng.randint(1, 3), rng.choice([None, day(), day()]), rng.choice(["lunch", "dinner"]), rng.randint(1, 5), k) for k in range(60)]
    s = spark.createDataFrame(subs, "sub_id int, party_size int, venues array<int>, sessions array<string>, dates array<date>, date_start date, date_end date")
    o = spark.createDataFrame(offer, "venue_id int, date date, meal string, seats int, k int")
    got = sorted((r.sub_id, r.k) for r in ranges.subscription_matches(s, o).collect())
    fits = lambda a, b: b[3] >= a[1] and (not a[2] or b[0] in a[2]) and (not a[3] or b[2] in a[3]) and (not a[4] or b[1] in a[4]) and (a[5] is None or b[1] is not None and b[1] >= a[5]) and (a[6] is None or b[1] is not None and b[1] <= a[6])
    assert got == sorted((a[0], b[4]) for a in subs for b in offer if fits(a, b))


def test_dedupe_is_idempotent(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    once = dedupe.first_wins(df, ["user_id", "event_type"], "event_id")
    assert sorted(map(tuple, dedupe.first_wins(once, ["user_id", "event_type"], "event_id").collect())) == sorted(map(tuple, once.collect()))


def test_unique_ids(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "x", 4), ("a-x", "q", 5)]
    df = spark.createDataFrame(rows, "base string, ext string, k int")
    out = dedupe.unique_ids(df, F.col("base"), F.concat_ws("-", "base", "ext"), F.col("k")).collect()
    ids = {r.k: r.record_id for r in out}
    assert len(set(ids.values())) == 5 and ids[4] == "b" and ids[5] == "a-x" and ids[1].startswith("a-x-") and ids[2].startswith("a-y-")


def test_slots(spark):
    ddl = "id int, meal struct<status:string,meal:string,date:date,dates:array<date>,times:array<string>,seats:int,max_seats:int,slots:array<struct<date:date,time:string,meal:string,available_seats:array<string>,max_seats:int,total_available_seats:int>>>"
    d = dt.date(2026, 5, 1)
    rows = [
        (1, ("available", "lunch", None, None, None, 0, 0, [(d, "12:00", "", ["2", "4"], 6, 0), (None, "", "tea", [], 0, 0)])),
        (2, ("available", "dinner", d, [d, dt.date(2026, 5, 3)], ["19:00", "20:00"], 3, 0, [])),
        (3, ("available", "dinner", None, [], ["19:00"], 0, 0, None)),
        (4, ("closed", "dinner", d, [], ["19:00"], 0, 0, None)),
    ]
    out = spark.createDataFrame(rows, ddl).select("id", F.inline(slots.meal_slots("meal"))).collect()
    assert sorted((r.id, str(r.date), r.time, r.meal, r.seats) for r in out) == [(1, "2026-05-01", "12:00", "lunch", 4), (2, "2026-05-01", "19:00", "dinner", 3), (2, "2026-05-01", "20:00", "dinner", 3), (2, "2026-05-03", "19:00", "dinner", 3), (2, "2026-05-03", "20:00", "dinner", 3), (3, "None", "19:00", "dinner", 2)]


def test_rating_alias_patches_review_count(spark):
    ratings = spark.createDataFrame([("a", 4.0, None), ("b", 3.0, 320)], "id string, rating double, review_count long")
    rows = spark.createDataFrame([("a", "b"), ("x", "b"), ("y", "z")], "id0 string, alias string")
    out = {r.id0: (r.rating, r.review_count, r.has_rating) for r in lookup.with_rating(rows, ratings, "id0", F.col("alias")).collect()}
    assert out == {"a": (4.0, 320, True), "x": (3.0, 320, True), "y": (None, None, False)}


def test_cascade(spark):
    names = spark.createDataFrame([(1, "The Blue Door"), (2, "Blue Door Kitchen"), (3, "Red"), (4, "Nothing Here")], "k int, n string")
    files = spark.createDataFrame([("bluedoor",), ("red lantern house",), ("blue door",)], "f string")
    out = {r.k: (r.candidate, r.tier) for r in lookup.cascade_match(names, "n", files, "f", "k").collect()}
    assert out == {1: ("blue door", 1), 2: ("blue door", 2), 3: ("red lantern house", 4)}


def test_margin_policy_and_trace(spark):
    rows = [(1, 1, "verified", 70, ["a"], []), (1, 2, "review", 50, [], []), (2, 1, "verified", 86, ["a"], []), (3, 1, "review", 66, list("abcde"), []), (3, 2, "reject", 10, [], [])]
    df = spark.createDataFrame(rows, "id int, rank int, status string, confidence int, reasons array<string>, conflicts array<string>")
    top = {r.id: r for r in match.margin_policy(df, "id").filter("rank = 1").collect()}
    assert {i: r.status for i, r in top.items()} == {1: "review", 2: "verified", 3: "verified"} and top[1].reasons == ["a", "close_runner_up"] and "margin_promoted" in top[3].reasons
    trace = {r.id: r for r in match.decision_trace(df, "id").collect()}
    assert trace[1].gap_12 == 20 and not trace[1].accept and trace[2].accept


def test_stratified_sample_takes_its_rows_whatever_the_keys(spark):
    rows = [("nulls", None)] * 3000 + [("ok", i) for i in range(3000)]
    import hashlib

    late = max(range(500), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    rows += [("one", late)] * 3000
    got = dedupe.stratified_sample(spark.createDataFrame(rows, "s string, k long"), "s", "k", 30).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"nulls": 10, "ok": 10, "one": 10}
    few = spark.createDataFrame([("a", None)] * 5 + [("a", 7)], "s string, k long")
    assert [r.k for r in dedupe.stratified_sample(few, "s", "k", 1, least=1).collect()] == [7]


def test_follow_moves(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "s string, t string")
    out = {r.s: r.t for r in parse.follow_moves(df, "s", "t").collect()}
    assert out["a"] == out["b"] == out["c"] == "d" and out["x"] in ("x", "y")


PAGE = """<html><head><title>The  Blue
Door</title><meta name="description" content="A quiet room."><script type="application/ld+json">{"@graph":[{"@type":["Restaurant"],"name":"Blue Door","servesCuisine":["French","Wine"],"geo":{"@type":"GeoCoordinates"}}]}</script><script type="application/ld+json">broken</script></head>
<body><h1>Welcome</h1><p>Blue Door serves seasonal plates in a small room. Come and see us by the river.<p>cookie policy and privacy policy of this site are here for you</p></body></html>"""


def test_page_signals(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    s = df.select("id", parse.html_signals("html").alias("s")).select("id", "s.*")
    r = s.filter("id = 1").first()
    assert (r.title, r.description, list(r.headings)) == ("The Blue Door", "A quiet room.", ["Welcome"]) and len(r.paragraphs) == 2 and len(r.jsonld) == 2
    objects = s.select("id", parse.jsonld_objects("jsonld").alias("o"))
    v = parse.venue_signals(objects, "id", "o").collect()
    assert [(x.id, x.name, list(x.cuisines)) for x in v] == [(1, "Blue Door", ["French", "Wine"])]
    best = parse.best_text(s, "id", "title", F.lit("Blue Door"), {"meta": (F.array_compact(F.array("description")), 4.0), "p": (F.col("paragraphs"), 0.0)}).collect()
    assert [(b.id, b.source) for b in best] == [(1, "p")] and best[0].text.startswith("Blue Door serves")


def test_table_functions(spark):
    text = "Grand Hotel     1 Main Rd               Deluxe                  24 May 2026             +65 1\n\nnext block\nline"
    spark.udtf.register("fixed_width", parse.FixedWidth)
    spark.udtf.register("blocks", parse.Blocks)
    spark.udtf.register("clauses", parse.Clauses)
    rows = spark.sql("select * from fixed_width(:t)", args={"t": text}).collect()
    assert [(r.field, r.text) for r in rows][:5] == [("name", "Grand Hotel"), ("address", "1 Main Rd"), ("room", "Deluxe"), ("exclusions", "24 May 2026"), ("contact", "+65 1")]
    assert [r.text for r in spark.sql("select * from blocks(:t)", args={"t": text}).collect()][1] == "next block\nline"
    assert [tuple(r) for r in spark.sql("select * from clauses(:t)", args={"t": "Terms\n1. First\n   goes on\n2. Second\n7. no\n"}).collect()] == [(1, "First goes on"), (2, "Second 7. no")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": 1, "records": [{"id": "1", "v": 2}, null]}')
    env = readers.read_json(spark, str(tmp_path / "a.json"), "meta int, venues array<struct<id:string,v:int>>, records array<struct<id:string,v:int>>")
    assert [tuple(r) for r in readers.unwrap(readers.good_records(env), "venues", "records").collect()] == [("1", 2)]
    assert readers.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "b.ndjson").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert sorted(r.id for r in readers.read_ndjson(spark, str(tmp_path / "b.ndjson"), "id int").collect()) == [1, 2]
    (tmp_path / "c.ndjson").write_text('[{"id": 1}, {"id": 3}]')
    assert sorted(r.id for r in readers.read_ndjson(spark, str(tmp_path / "c.ndjson"), "id int").collect()) == [1, 3]
    (tmp_path / "d.json").write_text('{"x": {"lat": 1.5}, "y": null}')
    assert {(r.id, r.entry and r.entry.lat) for r in readers.read_keyed(spark, str(tmp_path / "d.json"), "struct<lat:double>").collect()} == {("x", 1.5), ("y", None)}


def test_csv_and_other_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿E-mail Address,Party Size,Active\nA@x.example,4 pax,yes\n"b@x.example","2\n",paused\n,3,yes\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "s.csv"), {"email": ["email address", "mail"], "party_size": ["pax"], "enabled": ["active"], "name": []})
    assert [(r.email, r.party_size, r.name) for r in readers.active_subscriptions(rows).collect()] == [("A@x.example", "4 pax", None)]
    (tmp_path / "m.xml").write_text("<urlset><url><loc>https://x.example/a/b/c</loc></url><url><loc>https://x.example/a</loc></url></urlset>")
    m = readers.read_sitemap(spark, str(tmp_path / "m.xml"))
    assert [r.loc for r in m.filter(readers.is_detail_url(F.col("loc"))).collect()] == ["https://x.example/a/b/c"]
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-" + bytes(2000))
    (tmp_path / "bad.pdf").write_bytes(b"<html>" + bytes(2000))
    assert sorted(r.is_valid for r in readers.valid_pdfs(spark, f"{tmp_path}/*.pdf").collect()) == [False, True]
    for v in ("2026-01-01", "2026-02-01"):
        spark.createDataFrame([(v,)], "v string").write.parquet(f"{tmp_path}/snap/snapshot={v}")
    assert readers.read_snapshot(spark, f"{tmp_path}/snap").first().v == "2026-02-01"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A & B", 1.5, 2.5, "x"), (2, "C", None, 2.0, "x")], "id int, name string, lat double, lng double, city string")
    import json

    got = json.loads(sinks.geo_collection(sinks.geo_features(df, "lat", "lng", "id"), "id").first().json)
    assert got["features"][0]["geometry"]["coordinates"] == [2.5, 1.5] and len(got["features"]) == 1
    kml = sinks.kml_documents(df.filter("lat is not null"), "city", "id", sinks.kml_placemark("name", "lat", "lng", F.lit("note"), F.lit("")))
    assert "<name>A &amp; B</name><description>note</description>" in kml.first().kml and "2.5,1.5,0" in kml.first().kml
    sinks.write_texts(kml, "kml", f"{tmp_path}/kml", "group")
    assert spark.read.text(f"{tmp_path}/kml").count() >= 1
    sinks.write_json(df, f"{tmp_path}/out", True)
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    d = spark.createDataFrame([("added", f"n{i:02}") for i in range(60)] + [("changed", "z")], "change_type string, label string")
    for _ in range(2):
        sinks.append_changelog(d, f"{tmp_path}/log", "p", "2026-05-01")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 100
    assert "… and 40 more" in sinks.change_report(d).filter("change_type = 'added'").first().line


def test_alert_machine_sends_each_event_once():
    import itertools

    for steps in itertools.product([(m, e) for m in (False, True) for e in (False, True)], repeat=4):
        state, sent = frozenset(), []
        for has_match, expired in steps:
            before = state
            state, event = alerts.step(state, has_match, expired)
            if event:
                sent.append(event)
            assert alerts.MATCHED not in before or event is None
        assert len(sent) == len(set(sent))
    assert alerts.step(frozenset(), True, True)[1] == alerts.MATCHED
    assert alerts.step(frozenset(), False, True)[1] == alerts.EXPIRED
    assert alerts.step(frozenset({"expired"}), False, True)[1] == alerts.CONFIRMED


def test_streamed_alerts_survive_restarts(spark, tmp_path):
    schema = "scope string, seq long, has_match boolean, expired boolean"
    parts = [[("a", 0, False, False), ("b", 0, False, True)], [("a", 1, False, False), ("b", 1, True, False)], [("a", 2, True, False), ("a", 3, False, True), ("b", 2, True, True)]]
    seen = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = alerts.stream_alerts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        sink = alerts.idempotent_sink(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}"))
        out.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.scope, r.event) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "confirmed"), ("a", "matched"), ("b", "expired"), ("b", "matched")]


def test_batch_alerts_agree_with_the_machine(spark, tmp_path):
    subs = spark.createDataFrame([(i, i, f"u{i}@x", 2, [], None, dt.date(2026, 5, 1 + i), [], []) for i in range(4)] + [(9, 9, "U0@X", 2, [], None, dt.date(2026, 5, 1), [], [])], "sub_id int, ordinal int, email string, party_size int, dates array<date>, date_start date, date_end date, sessions array<string>, venues array<string>")
    hits = spark.createDataFrame([(1,)], "sub_id int")
    log = spark.createDataFrame([], "sent_key string, event string")
    today = F.lit("2026-05-03").cast("date")
    first = alerts.due_events(subs, hits, log, today, "s")
    assert {r.sub_id: r.event for r in first.collect()} == {0: "expired", 1: "matched", 2: "confirmed", 3: "confirmed"}
    alerts.append_log(first, f"{tmp_path}/log", F.lit("2026-05-03"))
    again = alerts.due_events(subs, hits, spark.read.parquet(f"{tmp_path}/log"), today, "s")
    assert {r.sub_id: r.event for r in again.collect()} == {0: "confirmed"}
    assert alerts.due_events(subs, hits, log, today, "s", limit=0).count() == 1


def test_streamed_latest_state(spark, tmp_path):
    schema = "k string, at timestamp, o long, v int"
    at = lambda m: dt.datetime(2026, 5, 1, 12, m)
    for rows in ([("a", at(1), 1, 1), ("b", at(5), 2, 2)], [("a", at(3), 3, 3), ("b", at(4), 4, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        latest.stream_latest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"], "at", "o", f"{tmp_path}/state", f"{tmp_path}/cp")
    assert sorted((r.k, r.v) for r in latest.read_latest(spark, f"{tmp_path}/state", schema).collect()) == [("a", 3), ("b", 2)]


def test_latest_keeps_the_state_on_failure(spark):
    rows = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 2, False), ("b", 1, 3, False)], "k string, at int, o int, ok boolean")
    assert sorted((r.k, r.at) for r in latest.latest_per_key(rows, ["k"], "at", "o", F.col("ok")).collect()) == [("a", 1), ("b", 1)]


def test_unsubscribe(spark):
    from quillon.functions.numbers import salted_hash

    subs = spark.createDataFrame([("A@x", True), ("a@x", True), ("b@x", True)], "email string, enabled boolean")
    token = subs.filter("email = 'a@x'").select(salted_hash("s", F.lower("email")).alias("token"))
    assert sorted((r.email, r.enabled) for r in alerts.unsubscribe(subs, token, "s").collect()) == [("A@x", False), ("a@x", False), ("b@x", True)]
