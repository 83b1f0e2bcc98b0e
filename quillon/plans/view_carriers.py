"""Carriers: whole views, streams and the rest of the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import diff, rules, views
from quillon.plans.registry import carrier
from quillon.plans.table_carriers import _FLAT, _flat
from quillon.sources.shared import shared_dir
from quillon.streaming import alerts, latest


def _stays(t):
    r = t.lineitem.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.to_date("l_shipdate").alias("start"), F.date_add(F.to_date("l_shipdate"), 3).alias("end"), F.col("l_orderkey").cast("string").alias("label"), F.lit(False).alias("tentative"))).alias("blackout_exact_ranges"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_regionkey").cast("string").alias("country"), F.col("n_name").alias("city"), F.lower("s_name").alias("search_text"), "blackout_exact_ranges", F.array().cast("array<string>").alias("blackout_notes"), F.lit("").alias("blackout_raw"))


_BLOCKED = "b AS (SELECT s_suppkey AS id, s_name AS name, n_name AS city, n_regionkey, s_acctbal, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate::DATE < DATE '1997-03-02' AND DATE '1997-03-01' < l_shipdate::DATE + 4) AS blocked FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@carrier(f"WITH {_BLOCKED} SELECT id, city FROM b WHERE n_regionkey = 1 AND NOT blocked AND s_acctbal >= 500")
def stay_view(t):
    ratings = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rating"), F.lit(1).alias("review_count"))
    q = views.StayQuery(country="1", start="1997-03-01", end="1997-03-02", min_rating=500.0)
    return q.build(_stays(t), ratings).select("id", "city")


@carrier(f"WITH {_BLOCKED} SELECT count(*) AS n_rows, count(*) FILTER (blocked) AS n_blocked, count(DISTINCT city) AS n_cities, count(DISTINCT n_regionkey) AS n_countries FROM b")
def stay_counts(t):
    return views.StayQuery.counts(views.StayQuery(start="1997-03-01", end="1997-03-02", hide_blocked=False).build(_stays(t)))


@carrier("SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN 'unavailable' WHEN p_size < 5 THEN 'twenty' ELSE 'fifty' END AS savings, CASE WHEN p_size > 45 THEN 'special' WHEN contains(p_name, 'ring') THEN 'buffet' WHEN p_type = 'PROMO' THEN 'one_per_diner' ELSE 'two_mains' END AS order_rule, CASE WHEN p_size > 45 OR p_size < 5 THEN 'special' WHEN contains(p_name, 'ring') THEN 'buffet' WHEN p_type = 'PROMO' THEN 'hotel_food' ELSE 'ala_carte' END AS applies_to, CASE WHEN p_brand = 'Brand#1' THEN 'bundled' WHEN p_retailprice > 905 THEN 'mapped' ELSE 'unmapped' END AS location FROM part")
def discount_profiles(t):
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.regexp_replace("p_name", "ring", "ring Buffet").alias("name"), F.when(F.col("p_type") == "PROMO", "hotel").otherwise("restaurant").alias("type"), F.lit("").alias("cuisine"), F.when(F.col("p_size") > 45, "Temporarily closed").otherwise("").alias("notes"), F.lit("").alias("opening_hours"), F.lit("").alias("closing_note"), F.when(F.col("p_brand") == "Brand#1", "1 First St; 2 Second St").otherwise("1 First St").alias("address"), F.lit("").alias("phone"), F.when(F.col("p_retailprice") > 905, 1.0).alias("lat"), F.lit(1.0).alias("lng"), "p_size")
    out = views.discount_profile(rows)
    fixed = rules.benefit(F.concat_ws(" ", "name", "cuisine", "notes"), F.col("type") == "hotel", F.col("p_size") < 5)
    return out.withColumn("benefit", fixed).select(F.col("id").cast("long").alias("id"), "benefit.savings", "benefit.order_rule", "benefit.applies_to", "location")


@carrier(f"WITH {_FLAT}, g AS (SELECT l_orderkey, count(*) AS n_slots, min(abs(left(time, 2)::INT * 60 + right(time, 2)::INT - 1140)) AS minutes_away FROM f WHERE open AND seats >= 30 AND meal = 'dinner' GROUP BY 1) SELECT o_orderkey, n_slots, minutes_away FROM orders JOIN g ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def slot_venue_view(t):
    venues = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "live_available").otherwise("closed").alias("status"), F.col("o_orderpriority").alias("name"))
    out = views.slot_venues(venues, _flat(t), "l_orderkey", "status", F.lit(False), preferred="19:00", party=30, session="dinner")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), "n_slots", "minutes_away")


@carrier("SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), n_name) AS region, CASE WHEN c_acctbal < 0 THEN n_name ELSE c_mktsegment || ' · ' || n_name END AS kicker, CASE WHEN c_acctbal > 9000 THEN 'note' WHEN c_acctbal > 5000 THEN 'Location verified.' ELSE 'Location not known.' END AS location_note, CASE WHEN c_acctbal < 0 THEN 'name' ELSE 'segment' END AS origin, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS n_fields FROM customer JOIN nation ON n_nationkey = c_nationkey")
def display_projections(t):
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("segment", segment)
    confidence = F.when(F.col("c_acctbal") > 5000, "place_verified")
    return rows.select("c_custkey", views.region("segment", "n_name").alias("region"), views.kicker("segment", "n_name", "n_name").alias("kicker"), views.location_note(confidence, F.when(F.col("c_acctbal") > 9000, " note ")).alias("location_note"), views.summary(("segment", "segment"), ("name", "c_name"))["origin"].alias("origin"), F.size(views.without_empty("segment", "c_name")).alias("n_fields"))


@carrier("SELECT o_orderkey, o_orderstatus AS status, NULL::VARCHAR AS missing FROM orders")
def dotted_paths(t):
    rows = t.orders.select("o_orderkey", F.struct(F.struct("o_orderstatus").alias("b")).alias("a"))
    return rows.select("o_orderkey", views.dotted(rows, "a.b.o_orderstatus").alias("status"), views.dotted(rows, "a.c.x").alias("missing"))


@carrier("SELECT o_orderkey, '{\"v\":{\"p\":\"' || o_orderpriority || '\"}}' AS json FROM orders")
def volatile_fields_dropped(t):
    rows = t.orders.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("checked_at")).alias("v"), F.col("o_totalprice").alias("checked_at"))
    return diff.without_fields(rows, "checked_at").select("o_orderkey", F.to_json(F.struct("v")).alias("json"))


@carrier("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_state_streamed(t):
    """The same result as the batch operator, by a stream that runs until its input is read."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    import uuid

    root = f"{shared_dir(t.spark)}/latest-{uuid.uuid4().hex}"
    latest.stream_latest(source, ["user_id", "event_type"], "ts", "event_id", f"{root}/state", f"{root}/checkpoint")
    return latest.read_latest(t.spark, f"{root}/state", t.events.schema).select("user_id", "event_type", "event_id")


@carrier("WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id::VARCHAR AS scope, 'confirmed' AS event, event_id AS seq FROM e WHERE r = 1 AND NOT p UNION ALL SELECT user_id::VARCHAR, 'matched', min(event_id) FROM e WHERE p GROUP BY 1")
def alerts_streamed(t):
    """First event of a user confirms, the first purchase matches and ends it."""
    import uuid

    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    rows = source.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("has_match"), F.lit(False).alias("expired"))
    root = f"{shared_dir(t.spark)}/alerts-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = alerts.idempotent_sink(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/b={n}"))
        alerts.stream_alerts(rows).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.parquet(f"{root}/out").select("scope", "event", "seq")
