"""Carriers: similarity joins, keyed streams with timers, range and dominance joins, fuzzy search by many queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.text import html_escape
from quillon.operators import clusters, dictionary, dyadic, fuzzy, hashtree, parse, ranges, similar
from quillon.plans.registry import carrier
from quillon.plans.table_carriers import _POINTS, _points, _versions
from quillon.sources import framed, landed, sinks
from quillon.sources.shared import shared_dir
from quillon.streaming import outbox, polls


def _named_parts(t):
    left = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return left, left.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("brand").alias("other_brand"))


def _similar_parts(t, ratio):
    return similar.similar_pairs(*_named_parts(t), [("brand", "other_brand")], ("name", "other_name"), ratio=ratio)


@carrier()
def similar_parts(t):
    """Parts of a brand with two common words, one name in the other, or a ratio of 0.72: a row `pair` for two names,
    each by its least part (a name goes with itself, too), and a row `copy` for every part that has a name, whose
    `other` is the least part of its brand and name. Two parts are similar if their least parts are a pair."""
    s = _similar_parts(t, 0.72)
    least = lambda df, c, name: df.groupBy(F.col("class_").alias(f"{name}_class")).agg(F.min(c).alias(name))
    one, two = least(s.left, "id", "first"), least(s.right, "other", "second")
    links = s.links.join(one, F.col("left_class") == F.col("first_class")).join(two, F.col("right_class") == F.col("second_class"))
    pairs = links.select(F.lit("pair").alias("row"), F.col("first").alias("id"), F.col("second").alias("other"), "common", F.round("ratio", 6).alias("ratio"))
    copies = s.left.join(one, F.col("class_") == F.col("first_class"))
    return pairs.unionAll(copies.select(F.lit("copy").alias("row"), "id", F.col("first").alias("other"), F.lit(None).cast("int").alias("common"), F.lit(None).cast("double").alias("ratio")))


@carrier()
def similar_parts_report(t):
    return _similar_parts(t, 0.72).report()


@carrier("SELECT a.p_partkey AS id, b.p_partkey AS other, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS common FROM part a JOIN part b ON a.p_brand = b.p_brand AND len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) >= 2", longs=("common",))
def two_word_parts(t):
    return _similar_parts(t, None).pairs.select("id", "other", "common")


_POLLS = """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS w, event_id AS seq, event_type <> 'error' AS ok, event_id % 7 = 0 AS force, event_id % 5 * 30000000 AS busy, event_type AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, max(epoch_ms(ts) * 1000) OVER () AS over FROM events),
s AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS last, 0::BIGINT AS until, NULL::BIGINT AS checked, NULL::BIGINT AS known, NULL::VARCHAR AS said, FALSE AS open,
    NULL::VARCHAR AS event, NULL::BIGINT AS w, NULL::BIGINT AS seq, NULL::VARCHAR AS value, NULL::BIGINT AS stale_at, NULL::BIGINT AS stale_seq, NULL::VARCHAR AS stale_value FROM e
  UNION ALL SELECT key, rn, CASE WHEN ran THEN w ELSE last END, CASE WHEN ran THEN w + busy ELSE until END, CASE WHEN ran AND ok THEN w ELSE checked END,
    CASE WHEN ran AND ok THEN seq ELSE known END, CASE WHEN ran AND ok THEN value ELSE said END, CASE WHEN ran AND ok THEN TRUE ELSE open AND NOT late END,
    CASE WHEN ran AND ok THEN 'fresh' WHEN ran THEN 'kept' WHEN w < until THEN 'in_flight' ELSE 'soon' END, w, seq, CASE WHEN ran AND NOT ok THEN said ELSE value END,
    CASE WHEN late THEN checked + 1800000000 END, known, said
  FROM (SELECT e.*, s.last, s.until, s.checked, s.known, s.said, s.open, coalesce(s.open AND e.w - s.checked > 1800000000, FALSE) AS late,
    e.w >= s.until AND (s.last IS NULL OR e.force OR e.w - s.last >= 60000000) AS ran FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1)),
n AS (SELECT key, max(rn) AS rn, any_value(over) AS over FROM e GROUP BY key),
out AS (SELECT key, event, w, seq, value FROM s WHERE rn > 0 UNION ALL SELECT key, 'stale', stale_at, stale_seq, stale_value FROM s WHERE stale_at IS NOT NULL
  UNION ALL SELECT s.key, 'stale', s.checked + 1800000000, s.known, s.said FROM s JOIN n ON n.key = s.key AND n.rn = s.rn WHERE s.open AND n.over - s.checked > 1800000000)
SELECT key, event, strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S.%f') AS "at", seq, value FROM out
"""


@carrier(_POLLS)
def polls_streamed(t):
    """Events as polls of their users, replayed by event time: guards, kept rows and staleness timers."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    rows = source.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 7 == 0).alias("force"), (F.col("event_id") % 5 * 30_000).cast("long").alias("busy_ms"), F.col("event_type").alias("value"))
    root = f"{shared_dir(t.spark)}/polls-{uuid.uuid4().hex}"
    polls.run_polls(rows, f"{root}/out", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/out").select("key", "event", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "seq", "value")


_SPANS = """o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + (1 << (o_orderkey % 14))::INT AS b FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::DATE AS c, l_shipdate::DATE + l_linenumber AS d FROM lineitem)"""


def _spans(t):
    """Ranges of 1 to 8,192 days from the orders, of 1 to 7 from the lines."""
    o = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add("o_orderdate", F.call_function("shiftleft", F.lit(1), (F.col("o_orderkey") % 14).cast("int"))).alias("b"))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("c"), F.date_add("l_shipdate", F.col("l_linenumber")).alias("d"))
    return o, x, ("a", "b"), ("c", "d"), ("o_custkey", "l_suppkey")


@carrier(f"WITH {_SPANS} SELECT o_orderkey, l_orderkey, l_linenumber FROM o JOIN l ON o_custkey = l_suppkey AND a < d AND c < b")
def overlaps_of_all_lengths(t):
    return dyadic.overlap_join(*_spans(t)).select("o_orderkey", "l_orderkey", "l_linenumber")


@carrier(f"WITH {_SPANS} SELECT o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM l WHERE o_custkey = l_suppkey AND a < d AND c < b)")
def overlaps_of_all_lengths_semi(t):
    return dyadic.overlap_join(*_spans(t), how="left_semi").select("o_orderkey")


@carrier("""WITH s AS (SELECT c_custkey AS sub_id, c_custkey % 4 AS kind, CASE WHEN c_custkey % 1000 = 7 THEN 1000000 ELSE 45 + c_custkey % 6 END AS party, DATE '1995-01-01' + (c_custkey * 13 % 1000)::INT AS day FROM customer)
SELECT sub_id, l_orderkey, l_linenumber FROM s JOIN lineitem ON l_quantity >= party AND CASE kind
  WHEN 0 THEN l_suppkey IN (sub_id, sub_id * 7 % 100 + 1) WHEN 1 THEN l_shipdate::DATE IN (day, day + 40)
  WHEN 2 THEN l_returnflag = 'R' AND l_shipdate::DATE BETWEEN day AND day + 9 ELSE l_shipdate::DATE BETWEEN day AND day + 2 END""")
def subscriptions_of_all_kinds(t):
    """All customers as subscriptions to venues, dates, meals or anything; a few ask for a party of a million."""
    kind, day = F.col("c_custkey") % 4, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 13 % 1000).cast("int"))
    listed = lambda n, *values: F.when(kind == n, F.array(*values)).otherwise(F.array())
    subs = t.customer.select(F.col("c_custkey").alias("sub_id"), F.when(F.col("c_custkey") % 1000 == 7, 1_000_000).otherwise(45 + F.col("c_custkey") % 6).alias("party_size"), listed(0, F.col("c_custkey"), F.col("c_custkey") * 7 % 100 + 1).alias("venues"), listed(2, F.lit("R")).alias("sessions"), listed(1, day, F.date_add(day, 40)).alias("dates"), F.when(kind >= 2, day).alias("date_start"), F.when(kind >= 2, F.date_add(day, F.when(kind == 2, 9).otherwise(2))).alias("date_end"))
    slots = t.lineitem.select(F.col("l_suppkey").alias("venue_id"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("meal"), F.col("l_quantity").alias("seats"), "l_orderkey", "l_linenumber")
    return ranges.subscription_matches(subs, slots).select("sub_id", "l_orderkey", "l_linenumber")


_FUZZY = """WITH q AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark)),
v AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part)),
m AS (SELECT word, w FROM q JOIN v ON contains(w, word) OR (length(word) >= 3 AND abs(length(w) - length(word)) <= floor(length(word) * 0.3) AND levenshtein(w, word) <= floor(length(word) * 0.3)))
SELECT DISTINCT word, p_partkey FROM m JOIN (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part) USING (w)"""


@carrier(_FUZZY)
def fuzzy_words(t):
    """Every word of the benchmark as a search over the names of all parts."""
    asked = t.benchmark.select(F.explode(fuzzy.search_words("text")).alias("word")).distinct()
    return fuzzy.fuzzy_search(t.part.select("p_partkey", "p_name"), "p_name", asked, "word").select("word", "p_partkey")


@carrier()
def radius_clusters(t):
    """Customers' places on the map at four zooms."""
    return clusters.radius_clusters(_points(t), "c_custkey", "lat", "lng", (9, 6, 4, 2)).levels.select("zoom", "id", "n_points", "size_class")


@carrier(f"WITH {_POINTS} SELECT n_regionkey::VARCHAR AS region, c_custkey, lng, lat FROM p WHERE lng IS NOT NULL")
def geojson_files(t):
    """Points of all customers, written as GeoJSON files by region and read back."""
    where = f"{shared_dir(t.spark)}/geojson-{uuid.uuid4().hex}"
    framed.write_framed(sinks.geo_features(_points(t), "lat", "lng", "c_custkey", "n_regionkey"), "n_regionkey", "c_custkey", "feature", where, "geojson", 5000)
    features = F.from_json("text", "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<c_custkey: long>>>")["features"]
    at = F.col("x.geometry.coordinates")
    return framed.read_framed(t.spark, where).select(F.col("group").alias("region"), F.explode(features).alias("x")).select("region", "x.properties.c_custkey", at[0].alias("lng"), at[1].alias("lat"))


@carrier(f"WITH {_POINTS} SELECT n_regionkey::VARCHAR AS region, count(*) AS n_placemarks FROM p WHERE lng IS NOT NULL GROUP BY 1")
def kml_files(t):
    where = f"{shared_dir(t.spark)}/kml-{uuid.uuid4().hex}"
    marks = _points(t).filter("lng is not null").withColumn("p", sinks.kml_placemark(F.col("c_custkey").cast("string"), "lat", "lng"))
    framed.write_framed(marks, "n_regionkey", "c_custkey", "p", where, "kml", 5000)
    return framed.read_framed(t.spark, where).groupBy(F.col("group").alias("region")).agg(F.sum(F.regexp_count("text", F.lit("<Placemark>"))).cast("long").alias("n_placemarks"))


@carrier("SELECT page_id % 3 AS part, url AS loc FROM pages", longs=("part",))
def sitemap_index(t):
    """Addresses of all pages, landed as sitemaps with an index and read back through it, a partition a sitemap."""
    where = f"{shared_dir(t.spark)}/sitemaps-{uuid.uuid4().hex}"
    entry = lambda tag, loc: F.concat(F.lit(f"<{tag}><loc>"), loc, F.lit(f"</loc></{tag}>"))
    framed.write_framed(t.pages.select((F.col("page_id") % 3).alias("part"), "page_id", entry("url", html_escape("url")).alias("body")), "part", "page_id", "body", f"{where}/maps", "sitemap", 50_000)
    index = framed.read_index(f"{where}/maps")
    files = t.spark.createDataFrame([(g, p["file"]) for g, parts in index.items() for p in parts], "part string, file string")
    framed.write_framed(files.select(F.lit("all").alias("g"), "file", entry("sitemap", F.concat(F.lit("https://example.org/maps/"), "file")).alias("body")), "g", "file", "body", f"{where}/index", "sitemapindex")
    (start,) = framed.read_index(f"{where}/index")["all"]
    read = landed.read_sitemaps(t.spark, f"{where}/index/{start['file']}", where)
    return read.withColumn("file", F.element_at(F.split("sitemap", "/"), -1)).join(files, "file").select(F.col("part").cast("long").alias("part"), "loc")


@carrier("SELECT c_nationkey::VARCHAR AS area, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 + 1 AS page, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 50 AS position, c_custkey FROM customer", longs=("page", "position"))
def paged_listing(t):
    """Customers as landed pages of 50 by nation, read back by the pages that each first page promises."""
    where = f"{shared_dir(t.spark)}/listing-{uuid.uuid4().hex}"
    rows = t.customer.select(F.col("c_nationkey").alias("area"), "c_custkey", F.expr("row_number() over (partition by c_nationkey order by c_custkey) - 1").alias("n"), F.expr("count(*) over (partition by c_nationkey)").alias("of"))
    page = F.struct(F.struct(F.ceil(F.col("of") / 50).cast("int").alias("totalPages")).alias("metadata"), "collection")
    pages = rows.groupBy("area", (F.floor(F.col("n") / 50) + 1).alias("page"), "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c_custkey"))), lambda x: F.struct(x["c_custkey"].alias("id"))).alias("collection"))
    pages.select("area", "page", F.to_json(page).alias("value")).repartition("area", "page").write.partitionBy("area", "page").text(where)
    return landed.read_listing(t.spark, where).select("area", "page", "position", F.get_json_object("record", "$.id").cast("long").alias("c_custkey"))


@carrier("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'added' WHEN '1-URGENT' THEN 'removed' ELSE 'changed' END AS change_type FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '2-HIGH')")
def tree_diff(t):
    """The two versions of the orders as written snapshots, compared by their trees."""
    where = f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}"
    for name, df in zip(("old", "new"), _versions(t)):
        hashtree.write_snapshot(df, ["o_orderkey"], f"{where}/{name}", depth=6)
    return hashtree.tree_diff(t.spark, f"{where}/old", f"{where}/new", ["o_orderkey"])


@carrier("SELECT 'c' || c_custkey AS message_id, CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS batch FROM customer WHERE c_acctbal > 0", longs=("batch",))
def outbox_deliveries(t):
    """Messages to customers in two batches with rows in common; the first is sent and not confirmed when it stops."""
    where = f"{shared_dir(t.spark)}/outbox-{uuid.uuid4().hex}"
    messages = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("message_id"), "c_acctbal")

    def send(df, n):
        df.write.mode("overwrite").parquet(f"{where}/sent/batch={n}")

    def stop(name):
        if name == "after send":
            raise InterruptedError(name)

    try:
        outbox.Outbox(t.spark, f"{where}/box", stop).deliver(messages.filter("c_acctbal > 5000"), 0, send)
    except InterruptedError:
        pass
    box = outbox.Outbox(t.spark, f"{where}/box")
    box.deliver(messages.filter("c_acctbal > 0"), 1, send)
    box.compact()
    return t.spark.read.parquet(f"{where}/sent").select("message_id", F.col("batch").cast("int").alias("batch"))


@carrier("""WITH a AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE w <> '')
SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) JOIN a USING (w) GROUP BY doc_id""")
def dictionary_documents(t):
    """Aliases (all words of the benchmark) found in all documents, by one automaton."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("alias")).distinct()
    found = dictionary.dictionary_matches(t.documents.select("doc_id", "text"), "text", words.withColumn("value", F.col("alias")))
    return found.select("doc_id", F.size(dictionary.values_of("matches")).cast("long").alias("n")).filter("n > 0")


@carrier("WITH b AS (SELECT p_partkey AS p, (p_partkey - 1) // 50 AS block, max(p_partkey) OVER () AS last FROM part) SELECT p, CASE WHEN block % 2 = 1 AND block * 50 + 50 <= last THEN block * 50 + 1 ELSE least(block * 50 + 50, last) END AS t, block % 2 = 1 AND block * 50 + 50 <= last AS cyclic FROM b WHERE p < last AND p % 50 <> 0 OR p % 50 = 0 AND block % 2 = 1")
def moved_links(t):
    """Parts as links to the next one, in chains of 50 and cycles of 50."""
    p = F.col("p_partkey")
    to = F.when(p % 50 != 0, p + 1).when(F.floor((p - 1) / 50) % 2 == 1, p - 49)
    there = t.part.select(p.alias("k"))
    moves = t.part.select(p.alias("p"), to.alias("t")).filter("t is not null").join(there, F.col("t") == F.col("k"), "left_semi")
    return parse.follow_moves(moves, "p", "t")
