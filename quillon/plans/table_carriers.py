"""Carriers: slots, ranges, deduplication, diffs, joins of lookups and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers
from quillon.functions.dates import minutes_of
from quillon.operators import audit, dedupe, diff, lookup, ranges, slots
from quillon.plans.registry import Tables, carrier
from quillon.sources import sinks
from quillon.sources.readers import union_sources, unwrap
from quillon.streaming import alerts, latest

#: Status of an order as meal, quantities as seats.
_MEAL = "CASE l_returnflag WHEN 'A' THEN 'lunch' WHEN 'N' THEN 'dinner' ELSE 'tea' END"


def _inventory(t: Tables):
    """One availability struct per order and return flag, with nested slots: what an inventory file holds."""
    meal = F.when(F.col("l_returnflag") == "A", "lunch").when(F.col("l_returnflag") == "N", "dinner").otherwise("tea")
    slot = F.struct(F.to_date("l_shipdate").alias("date"), F.format_string("%02d:%02d", (F.col("l_suppkey") % 24).cast("int"), (F.col("l_partkey") % 60).cast("int")).alias("time"), F.lit("").alias("meal"), F.array(F.col("l_quantity").cast("int").cast("string"), F.lit("x")).alias("available_seats"), F.lit(0).alias("max_seats"), F.lit(0).alias("total_available_seats"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    # dealt by order while rows are short: all that follows by order, or order and meal, needs no other shuffle
    return lines.repartition("l_orderkey").groupBy("l_orderkey", meal.alias("m")).agg(F.collect_list(slot).alias("s"), F.max("l_linestatus").alias("state")).select("l_orderkey", F.struct(F.when(F.col("state") == "O", "available").otherwise("no_seats").alias("status"), F.col("m").alias("meal"), F.lit(None).cast("date").alias("date"), F.array().cast("array<date>").alias("dates"), F.array().cast("array<string>").alias("times"), F.lit(0).alias("seats"), F.lit(0).alias("max_seats"), F.col("s").alias("slots")).alias("meal"))


def _flat(t: Tables):
    return _inventory(t).select("l_orderkey", F.inline(slots.meal_slots("meal")))


_FLAT = f"f AS (SELECT l_orderkey, l_shipdate::DATE AS date, lpad((l_suppkey % 24)::VARCHAR, 2, '0') || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0') AS time, {_MEAL} AS meal, l_quantity::INT AS seats, max(l_linestatus) OVER (PARTITION BY l_orderkey, {_MEAL}) = 'O' AS open FROM lineitem)"


@carrier(f"WITH {_FLAT} SELECT l_orderkey, date, time, meal, seats FROM f WHERE open")
def slots_normalised(t):
    return _flat(t)


@carrier(f"WITH {_FLAT} SELECT l_orderkey, meal, list_sort(list_distinct(list(time)))[1:12] AS times, count(*) AS slot_count, max(seats) AS max_seats, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates, CASE meal WHEN 'lunch' THEN 0 WHEN 'dinner' THEN 1 ELSE 2 END AS meal_rank, CASE WHEN count(DISTINCT date) = 1 THEN min(date)::VARCHAR ELSE count(DISTINCT date) || ' dates, ' || min(date) || ' to ' || max(date) END AS span FROM f WHERE open GROUP BY ALL", longs=("n_dates",))
def slots_by_meal(t):
    g = slots.group_meals(_flat(t), "l_orderkey", "meal")
    n = F.size("dates")
    return g.withColumns({"n_dates": n, "meal_rank": slots.meal_rank("meal"), "span": slots.span_text(n, F.col("first_date"), F.col("last_date"))}).drop("dates")


@carrier(f"WITH {_FLAT} SELECT l_orderkey, date, time, seats FROM f WHERE open AND seats >= 10 AND meal = 'dinner' AND isodow(date) >= 6 AND abs(left(time, 2)::INT * 60 + right(time, 2)::INT - 720) <= 60")
def slots_filtered(t):
    return _flat(t).filter(slots.slot_predicate(10, "Dinner", None, "12:00", "weekend")).select("l_orderkey", "date", "time", "seats")


@carrier("SELECT event_id FROM events WHERE isodow(ts) >= 6 AND abs(hour(ts) * 60 + minute(ts) - 720) <= 60")
def events_near_noon(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("time"), F.lit(2).alias("seats"), F.col("event_type").alias("meal"))
    return rows.filter(slots.slot_predicate(2, None, None, "12:00", "weekend")).select("event_id")


@carrier("SELECT user_id, s.date AS date, s.time AS time, s.event_id AS event_id, d AS minutes_away FROM (SELECT user_id, arg_min({date: ts::DATE, time: strftime(ts, '%H:%M'), event_id: event_id}, {d: abs(hour(ts) * 60 + minute(ts) - 720), t: strftime(ts, '%Y-%m-%d %H:%M'), e: event_id}) AS s, min(abs(hour(ts) * 60 + minute(ts) - 720)) AS d FROM events GROUP BY 1)", longs=("minutes_away",))
def closest_event(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("date"), F.concat(F.date_format("ts", "HH:mm")).alias("time"), "event_id")
    unique = dedupe.first_wins(rows, ["user_id", "date", "time"], "event_id")
    return slots.closest_slot(unique, "12:00", "user_id", keep=("date", "time", "event_id"))


@carrier("SELECT d::DATE AS day, dayofweek(d) AS \"column\", coalesce(n, 0) AS n_slots FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) s(d) LEFT JOIN (SELECT ts::DATE AS k, count(*) AS n FROM events GROUP BY 1) ON k = d", longs=("column",))
def month_calendar(t):
    return slots.month_calendar(t.events, "2024-01", "ts")


@carrier(f"WITH {_FLAT} SELECT l_orderkey, CASE WHEN bool_or(open) AND bool_or(open AND seats >= 30) THEN 'available' ELSE 'no_seats' END AS availability FROM f GROUP BY 1")
def availability_status(t):
    fitting = F.size(F.filter(slots.meal_slots("meal"), lambda s: s["seats"] >= 30))
    meals = _inventory(t).select("l_orderkey", F.col("meal.status").alias("status"), fitting.alias("n"))
    status = F.when(F.bool_or(F.col("status") == "available"), "live_available").otherwise("no_seats")
    return meals.groupBy("l_orderkey").agg(slots.availability_key(status, F.sum("n"), F.lit(False)).alias("availability"))


@carrier("SELECT s_suppkey, CASE WHEN bool_or(l_shipdate::DATE < DATE '1997-03-10' AND DATE '1997-03-01' < l_shipdate::DATE + 4) THEN 'blocked' WHEN count(l_shipdate) = 0 THEN 'subject_to_availability' ELSE 'not_blocked' END AS status FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def stay_window(t):
    r = t.lineitem.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.to_date("l_shipdate").alias("start"), F.date_add(F.to_date("l_shipdate"), 3).alias("end"), F.col("l_orderkey").cast("string").alias("label"), F.lit(False).alias("tentative"))).alias("ranges"))
    day = lambda d: F.lit(d).cast("date")
    rows = t.supplier.join(r, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("s_suppkey", ranges.stay_status("ranges", F.array().cast("array<string>"), F.lit(""), day("1997-03-01"), day("1997-03-10"))["key"].alias("status"))


def _windows(t: Tables):
    """Windows of all orders at each of their suppliers, and ranges of all lines: the supplier bounds the pairs."""
    sold = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("w_supp")).distinct()
    w = t.orders.join(sold, F.col("o_orderkey") == F.col("k")).select("o_orderkey", "w_supp", F.to_date("o_orderdate").alias("w_start"), F.date_add("o_orderdate", 2).alias("w_end"))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("r_start"), F.date_add("l_shipdate", 4).alias("r_end"))
    return w, x


_WINDOWS = "FROM (SELECT DISTINCT o_orderkey, o_orderdate::DATE AS a, l_suppkey AS w_supp FROM orders JOIN lineitem ON l_orderkey = o_orderkey) w JOIN lineitem x ON x.l_suppkey = w_supp AND a < x.l_shipdate::DATE + 4 AND x.l_shipdate::DATE < a + 2"


@carrier(f"SELECT o_orderkey, w_supp, x.l_orderkey, x.l_linenumber {_WINDOWS}")
def range_join_pairs(t):
    w, x = _windows(t)
    return ranges.range_join(w, x, ("w_start", "w_end"), ("r_start", "r_end"), 16, ("w_supp", "l_suppkey")).select("o_orderkey", "w_supp", "l_orderkey", "l_linenumber")


@carrier(f"SELECT DISTINCT o_orderkey {_WINDOWS}")
def range_join_semi(t):
    w, x = _windows(t)
    return ranges.range_join(w, x, ("w_start", "w_end"), ("r_start", "r_end"), 16, ("w_supp", "l_suppkey"), how="left_semi").select("o_orderkey").distinct()


@carrier("SELECT c_custkey AS sub_id, s_suppkey, l_orderkey, l_linenumber FROM customer JOIN (supplier JOIN lineitem ON l_suppkey = s_suppkey) ON s_nationkey = c_nationkey WHERE l_quantity >= c_custkey % 40 + 10 AND l_shipdate::DATE BETWEEN DATE '1997-01-01' + (c_custkey % 30)::INT AND DATE '1997-02-01'")
def subscription_slots(t):
    start = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int"))
    subs = t.customer.select(F.col("c_custkey").alias("sub_id"), (F.col("c_custkey") % 40 + 10).alias("party_size"), F.array(F.col("c_nationkey")).alias("venues"), F.array().cast("array<string>").alias("sessions"), F.array().cast("array<date>").alias("dates"), start.alias("date_start"), F.lit("1997-02-01").cast("date").alias("date_end"))
    offered = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_nationkey").alias("venue_id"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("meal"), F.col("l_quantity").alias("seats"), "l_orderkey", "l_linenumber")
    return ranges.subscription_matches(subs, offered).select("sub_id", "s_suppkey", "l_orderkey", "l_linenumber")


def _points(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", (F.col("c_custkey") * 37 % 181 - 90).cast("double").alias("lat"), F.when(F.col("c_acctbal") > -500, (F.col("c_custkey") * 97 % 361 - 180).cast("double")).alias("lng"))


_POINTS = "p AS (SELECT c_custkey, n_regionkey, (c_custkey * 37 % 181 - 90)::DOUBLE AS lat, CASE WHEN c_acctbal > -500 THEN (c_custkey * 97 % 361 - 180)::DOUBLE END AS lng FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@carrier(f"WITH {_POINTS} SELECT n_regionkey, count(*) AS n_rows, count(lng) AS n_mapped, count(*) - count(lng) AS n_missing, count(*) FILTER (lng IS NOT NULL AND n_regionkey <> 4 AND NOT (lat BETWEEN n_regionkey * 10 - 60 AND n_regionkey * 10 + 20 AND lng BETWEEN -100 AND 100)) AS n_outside FROM p GROUP BY 1")
def coordinate_audit(t):
    boxes = t.region.filter("r_regionkey <> 4").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") * 10 - 60).alias("min_lat"), (F.col("r_regionkey") * 10 + 20).alias("max_lat"), F.lit(-100).alias("min_lng"), F.lit(100).alias("max_lng"))
    return audit.coordinate_audit(_points(t), boxes, "n_regionkey", "lat", "lng")


@carrier(f"WITH {_POINTS} SELECT c_custkey, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(35.68 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.68)) * pow(sin(radians(139.76 - lng) / 2), 2)))), 6) AS km FROM p")
def haversine(t):
    return _points(t).select("c_custkey", F.round(numbers.haversine_km("lat", "lng", F.lit(35.68), F.lit(139.76)), 6).alias("km"))


@carrier(f"WITH {_POINTS} SELECT n_regionkey, count(*) AS n_points, min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng FROM p WHERE lng IS NOT NULL GROUP BY 1")
def bounding_boxes(t):
    return numbers.bounding_box(_points(t), "lat", "lng", ["n_regionkey"])


@carrier(f"WITH {_POINTS} SELECT floor(lat / 11.25)::BIGINT AS cell_y, floor(lng / 11.25)::BIGINT AS cell_x, count(*) AS n_points, CASE WHEN count(*) < 10 THEN 'small' WHEN count(*) < 100 THEN 'medium' ELSE 'large' END AS size_class FROM p WHERE lng IS NOT NULL GROUP BY ALL")
def grid_clusters(t):
    return numbers.grid_clusters(_points(t), "lat", "lng", 4).drop("lat", "lng")


@carrier(f"WITH {_POINTS} SELECT c_custkey, CASE WHEN lng IS NULL THEN 'none' WHEN abs(lat) > 80 THEN 'none' ELSE 'source' END AS confidence FROM p")
def coordinate_decisions(t):
    point = F.when(F.col("lng").isNotNull(), F.struct("lat", "lng"))
    none = F.lit(None).cast("struct<lat:double,lng:double>")
    x = numbers.adjudicate(point, none, none, F.lit(False), F.lit(False), none, F.col("lng").isNotNull() & (F.abs("lat") <= 80), F.lit(False))
    return _points(t).select("c_custkey", x["confidence"].alias("confidence"))


_KEY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@carrier(f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY {_KEY}")
def first_wins(t):
    rows = t.documents.withColumn("k", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    kept = dedupe.first_wins(rows, ["k"], "doc_id")
    n = rows.groupBy("k").count()
    return kept.join(n, "k").select("doc_id", F.col("count").alias("n"))


@carrier(f"SELECT arg_max(doc_id, {{a: labelled, b: n_chars, c: -doc_id}}) AS doc_id, min(doc_id) AS position, count(*) AS n_merged FROM (SELECT d.*, ({_KEY}) AS k, (l.doc_id IS NOT NULL)::INT AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id) GROUP BY k")
def best_wins(t):
    lab = t.labels.select(F.col("doc_id").alias("l")).distinct()
    rows = t.documents.join(lab, F.col("doc_id") == F.col("l"), "left")
    return dedupe.best_wins(rows, [F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))], [F.col("l").isNotNull().cast("int"), F.col("n_chars")], "doc_id").select("doc_id", "position", "n_merged")


@carrier("SELECT lang, list_distinct(list(source)) IS NOT NULL AS merged, count(DISTINCT source) AS n_sources, min(doc_id) AS doc_id FROM documents GROUP BY lang", longs=("n_sources",))
def merged_arrays(t):
    rows = t.documents.select("lang", "doc_id", F.array("source").alias("sources"))
    return dedupe.merge_arrays(rows, "lang", "doc_id", ["sources"]).select("lang", F.col("sources").isNotNull().alias("merged"), F.size("sources").alias("n_sources"), "doc_id")


@carrier("WITH a AS (SELECT p_partkey, replace(p_name, ' ', '-') AS b, replace(p_name, ' ', '-') || '-' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS e FROM part), b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY b) = 1 THEN b ELSE e END AS w, count(*) OVER (PARTITION BY b) AS n FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY w) AS m FROM b) SELECT p_partkey, CASE WHEN n = 1 OR m = 1 THEN w ELSE w || '-' || left(sha1(p_partkey::VARCHAR), 8) END AS record_id FROM c")
def unique_ids(t):
    from quillon.functions.text import slug

    return dedupe.unique_ids(t.part, slug("p_name"), F.concat_ws("-", slug("p_name"), slug("p_brand")), F.col("p_partkey")).select("p_partkey", "record_id")


@carrier("WITH c AS (SELECT lang, count(*) AS c, greatest(2, floor(60 * count(*) / (SELECT count(*) FROM documents))) AS k FROM documents GROUP BY 1), r AS (SELECT doc_id, lang, k, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents JOIN c USING (lang)) SELECT doc_id, lang FROM r WHERE r <= k ORDER BY lang, r LIMIT 60")
def stratified_sample(t):
    return dedupe.stratified_sample(t.documents, "lang", "doc_id", 60).select("doc_id", "lang")


@carrier("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations")
def carried_question(t):
    return dedupe.carry_forward(t.conversations, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "question").select("conv_id", "turn", "question")


@carrier("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def without_runs(t):
    return dedupe.without_runs(t.events, ["user_id"], "event_id", "event_type").select("event_id")


def _versions(t: Tables):
    """Two versions of orders: the old lacks the low priority, the new the urgent one and has raised prices."""
    old = t.orders.filter("o_orderpriority <> '5-LOW'")
    new = t.orders.filter("o_orderpriority <> '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0))
    return old, new


@carrier("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'added' WHEN '1-URGENT' THEN 'removed' WHEN '2-HIGH' THEN 'changed' ELSE 'same' END AS change_type FROM orders")
def snapshot_diff(t):
    return diff.snapshot_diff(*_versions(t), ["o_orderkey"])


@carrier("SELECT change_type, count(*) AS n, '- ' || change_type || ' (' || count(*) || '): ' || array_to_string((list(o_orderkey::VARCHAR ORDER BY o_orderkey::VARCHAR))[1:20], ', ') || ' … and ' || (count(*) - 20) || ' more' AS line FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'added' WHEN '1-URGENT' THEN 'removed' WHEN '2-HIGH' THEN 'changed' END AS change_type FROM orders) WHERE change_type IS NOT NULL GROUP BY 1")
def change_report(t):
    return sinks.change_report(diff.snapshot_diff(*_versions(t), ["o_orderkey"], label="o_orderkey"))


@carrier("SELECT 'c' || o_custkey AS who, CASE WHEN max((o_orderpriority <> '5-LOW')::INT) = 1 THEN 'missing' ELSE 'extra' END AS side FROM orders GROUP BY o_custkey HAVING max((o_orderpriority <> '5-LOW')::INT) <> max((o_orderpriority <> '1-URGENT')::INT)")
def roster_gaps(t):
    old, new = _versions(t)
    return diff.reconcile(old, new, {"who": F.concat(F.lit("c"), F.col("o_custkey"))})


@carrier("SELECT o_orderkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT') AS is_active FROM orders WHERE o_orderpriority <> '5-LOW'")
def membership(t):
    old, new = _versions(t)
    return diff.membership(old, new, {"k": F.col("o_custkey")}).select("o_orderkey", "is_active")


@carrier("SELECT o_orderpriority, count(*) FILTER (o_orderpriority <> '5-LOW') AS n_a, count(*) FILTER (o_orderpriority <> '1-URGENT') AS n_b, count(*) FILTER (o_orderpriority <> '5-LOW') - count(*) FILTER (o_orderpriority <> '1-URGENT') AS gap FROM orders GROUP BY 1")
def compared_counts(t):
    return diff.compare_counts(*_versions(t), "o_orderpriority")


@carrier(f"WITH {_POINTS} SELECT count(*) FILTER (lng IS NOT NULL AND n_regionkey = 1) AS n_hidden, count(*) FILTER (lng IS NOT NULL AND n_regionkey = 2) AS n_moved FROM p")
def corrected_points(t):
    p = _points(t)
    new = p.withColumns({"lat": F.col("lat") + F.when(F.col("n_regionkey") == 2, 1).otherwise(0), "lng": F.when(F.col("n_regionkey") != 1, F.col("lng"))})
    return diff.corrected(p, new, "c_custkey")


@carrier("SELECT 'n' AS path, (SELECT count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'F') AS old_value, (SELECT count(*)::VARCHAR FROM orders) AS new_value")
def watched_metadata(t):
    one = lambda d: d.agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("least"))
    return diff.watched_changes(one(t.orders.filter("o_orderstatus = 'F'")), one(t.orders), ["n", "least", "gone.field"])


@carrier("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'never_reviewed' WHEN p_size > 20 THEN 'changed_since_review' END AS reason, p_size > 20 AS needs_review FROM part")
def review_gate(t):
    now = t.part.select("p_partkey", F.md5("p_name").alias("hash"), "p_size")
    seen = now.filter("p_size <= 40").select("p_partkey", F.when(F.col("p_size") > 20, "old").otherwise(F.col("hash")).alias("hash"))
    return diff.review_gate(now, seen, "p_partkey", "hash").select("p_partkey", "reason", "needs_review")


@carrier("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'missing' WHEN p_type = 'LARGE' THEN 'new' WHEN p_type = 'MEDIUM' THEN 'changed' ELSE 'same' END AS status, CASE WHEN p_type = 'MEDIUM' THEN 2 ELSE 1 END AS changed FROM part WHERE p_type <> 'LARGE' UNION ALL SELECT p_partkey, 'new', NULL FROM part WHERE p_type = 'LARGE'")
def tracked_files(t):
    d = lambda n: F.lit(f"2026-01-0{n}").cast("timestamp")
    state = t.part.filter("p_type <> 'LARGE'").select("p_partkey", F.col("p_name").alias("url"), F.md5("p_name").alias("sha256"), d(1).alias("first_seen_at"), d(1).alias("last_seen_at"), d(1).alias("changed_at"))
    listing = t.part.filter("p_type <> 'PROMO'").select("p_partkey", F.col("p_name").alias("url"), F.when(F.col("p_type") == "MEDIUM", "x").otherwise(F.md5("p_name")).alias("sha256"))
    return diff.track_files(state, listing, "p_partkey", d(2)).select("p_partkey", "status", F.dayofmonth("changed_at").alias("changed"))


@carrier("SELECT c_custkey, CASE WHEN n_name IS NOT NULL AND c_acctbal > 0 THEN 'set' ELSE c_mktsegment END AS c_mktsegment, n_name IS NOT NULL AND c_acctbal > 0 AS overridden FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) ON n_nationkey = c_nationkey")
def guarded_overrides(t):
    rows = t.customer.withColumn("note", F.when(F.col("c_acctbal") > 0, "In Credit").otherwise("debt"))
    o = t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.lit("set").alias("c_mktsegment"), F.lit("CREDIT").alias("expected"))
    return lookup.override(rows, o, "c_nationkey", ["c_mktsegment"], guards={"note": "expected"}).select("c_custkey", "c_mktsegment", "overridden")


@carrier("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'new' END AS o_orderpriority FROM orders")
def preserved_fields(t):
    new = t.orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "").otherwise("new"))
    return lookup.fill_from(new, t.orders, "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@carrier("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END AS n_signals FROM customer")
def provider_signals(t):
    s = t.nation.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit(""), F.lit("c"), F.col("n_name")).alias("signals"))
    return lookup.with_signals(t.customer, s, "c_nationkey", allow=["a", "b"]).select("c_custkey", F.size("signals").alias("n_signals"))


@carrier("SELECT p_partkey, n AS n_sharing FROM part JOIN (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL) USING (p_name, p_brand)")
def fanned_out(t):
    work = lookup.once_per_key(t.part, F.concat_ws("|", "p_name", "p_brand"), "p_partkey").select(F.col("p_name").alias("n_"), F.col("p_brand").alias("b_"), "n_sharing")
    return lookup.fan_out(t.part, work, {"p_name": "n_", "p_brand": "b_"}).select("p_partkey", "n_sharing")


@carrier("SELECT o_orderkey, o_custkey AS echoed FROM orders")
def echoed_ids(t):
    return t.orders.select("o_orderkey", lookup.echo_id(F.concat(F.lit("name, city #!#"), F.col("o_custkey").cast("string"))).cast("long").alias("echoed"))


@carrier("SELECT n_regionkey, list_sort(list_distinct(list(n_nationkey::VARCHAR))) AS resolved FROM nation GROUP BY 1")
def resolved_aliases(t):
    table = lookup.alias_table(t.nation, "n_nationkey", "n_nationkey", "n_name")
    rows = t.nation.groupBy("n_regionkey").agg(F.flatten(F.collect_list(F.array(F.upper("n_name"), F.col("n_nationkey").cast("string")))).alias("names"))
    return lookup.resolve_aliases(rows, "names", table, "n_regionkey").select("n_regionkey", "resolved")


@carrier("SELECT n_nationkey, lower(n_name) || '-menu' AS candidate, 3 AS tier FROM nation WHERE false UNION ALL SELECT n_nationkey, n_name, 0 FROM nation")
def cascade_names(t):
    return lookup.cascade_match(t.nation, "n_name", t.nation.select(F.col("n_name").alias("cand0")), "cand0", "n_nationkey")


@carrier("SELECT a.n_nationkey, b.n_name AS partner FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) b USING (n_regionkey, i)")
def zipped_rows(t):
    right = t.nation.select("n_regionkey", "n_name", F.col("n_name").alias("partner"))
    left = t.nation.select("n_nationkey", F.col("n_regionkey").alias("region"))
    return lookup.zip_by_position(left, right.withColumnRenamed("n_regionkey", "region"), "n_nationkey", "n_name", "partner", group="region").select("n_nationkey", "partner")


@carrier("SELECT o_orderkey, c.c_acctbal IS NOT NULL AS found, c.c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey > 4) c ON c_custkey = o_custkey")
def cached_lookups(t):
    cache = t.customer.filter("c_nationkey > 4").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return lookup.read_through(t.orders, cache, "o_custkey", "v").select("o_orderkey", F.col("v").isNotNull().alias("found"), "hit")


@carrier("SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'error' THEN false ELSE date_diff('day', ts::DATE, DATE '2024-04-10') < 90 END AS fresh FROM events")
def cache_freshness(t):
    status = F.when(F.col("event_type") == "view", "found").when(F.col("event_type") == "error", "error").otherwise("no_result")
    return t.events.select("event_id", lookup.is_fresh(status, F.to_date("ts"), F.lit("2024-04-10").cast("date")).alias("fresh"))


@carrier("SELECT o_orderkey, o_orderpriority <> '1-URGENT' AS is_new FROM orders")
def merged_store(t):
    old, new = _versions(t)
    return lookup.merge_write(old.withColumn("is_new", F.lit(False)), new.withColumn("is_new", F.lit(True)), "o_orderkey").select("o_orderkey", "is_new")


@carrier("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def work_list(t):
    return lookup.not_known(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@carrier("SELECT o_orderkey, l_linenumber, CASE WHEN l_linenumber IS NULL THEN 'fallback' ELSE 'bulk' END AS origin FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def bulk_then_fallback(t):
    bulk = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.lit("bulk").alias("origin"))
    return lookup.with_fallback(bulk, t.orders.select("o_orderkey", F.lit("fallback").alias("origin")), "o_orderkey").select("o_orderkey", "l_linenumber", "origin")


@carrier("SELECT n_nationkey AS id, n_name AS name FROM nation")
def envelope_records(t):
    env = t.nation.groupBy().agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("records")).withColumn("venues", F.lit(None).cast("array<struct<id:int,name:string>>"))
    return unwrap(env, "venues", "records", "data")


@carrier("SELECT c_custkey AS id, c_name AS name, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def united_sources(t):
    return union_sources(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))


@carrier("SELECT n_regionkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE 'region ' || n_regionkey END AS shown FROM nation WHERE n_regionkey = 0 UNION ALL SELECT r_regionkey, 'region ' || r_regionkey FROM region WHERE r_regionkey <> 0")
def expanded_groups(t):
    g = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name")).alias("children")).withColumn("own", F.struct(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("n_name")))
    return lookup.expand_groups(g, F.col("n_regionkey") == 0, "children", "own").select("n_regionkey", F.col("member.n_name").alias("shown"))


@carrier("SELECT c_custkey, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || lng || ',' || lat || ']},\"properties\":{\"c_custkey\":' || c_custkey || '}}' AS feature FROM (SELECT c_custkey, (c_custkey * 37 % 181 - 90)::DOUBLE AS lat, CASE WHEN c_acctbal > -500 THEN (c_custkey * 97 % 361 - 180)::DOUBLE END AS lng FROM customer) WHERE lng IS NOT NULL")
def geo_features(t):
    return sinks.geo_features(_points(t), "lat", "lng", "c_custkey")


@carrier("SELECT n_regionkey, count(*) AS n_placemarks FROM (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > -500) GROUP BY 1")
def kml_documents(t):
    mapped = _points(t).filter("lng is not null").withColumn("g", F.col("n_regionkey").cast("string"))
    docs = sinks.kml_documents(mapped, "g", "c_custkey", sinks.kml_placemark(F.col("c_custkey").cast("string"), "lat", "lng", F.col("g")))
    return docs.select(F.col("group").cast("int").alias("n_regionkey"), F.regexp_count("kml", F.lit("<Placemark>")).cast("long").alias("n_placemarks"))


@carrier("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t):
    return latest.latest_per_key(t.events, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@carrier("SELECT c_custkey AS sub_id, CASE WHEN c_acctbal > 5000 THEN 'matched' WHEN c_nationkey < 10 THEN 'expired' ELSE 'confirmed' END AS event FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'matched' ELSE 'expired' END FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR c_nationkey < 10)")
def alert_events(t):
    end = F.when(F.col("c_nationkey") < 10, "2026-01-01").otherwise("2026-12-31").cast("date")
    subs = t.customer.select(F.col("c_custkey").alias("sub_id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("email"), F.lit(2).alias("party_size"), F.array().cast("array<date>").alias("dates"), F.lit(None).cast("date").alias("date_start"), end.alias("date_end"), F.array().cast("array<string>").alias("sessions"), F.array().cast("array<string>").alias("venues"), "c_mktsegment")
    hits = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("sub_id"))
    log = subs.filter("c_mktsegment = 'BUILDING'").select(alerts.scope_key("s").alias("sent_key"), F.lit(alerts.CONFIRMED).alias("event"))
    return alerts.due_events(subs, hits, log, F.lit("2026-06-01").cast("date"), "s").select("sub_id", "event")
