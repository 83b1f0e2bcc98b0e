"""Carriers: facets, lookups, ranking, aggregates, bands, text and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import dates, numbers, text
from quillon.operators import facets, lookup, rules
from quillon.plans.registry import Tables, carrier


def _ratings(t: Tables) -> DataFrame:
    """Rating side table: customers with a balance that isn't negative, so that lookups really miss."""
    return t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rating"), F.when(F.col("c_mktsegment") != "BUILDING", F.length("c_name") + F.col("c_nationkey")).alias("review_count"))


_RATINGS = "r AS (SELECT c_custkey AS id, c_acctbal AS rating, CASE WHEN c_mktsegment <> 'BUILDING' THEN length(c_name) + c_nationkey END AS review_count FROM customer WHERE c_acctbal >= 0)"


@carrier("SELECT o_orderkey, o_custkey, o_totalprice, c_acctbal AS rating FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY coalesce(c_acctbal, -1) DESC, o_orderkey LIMIT 50")
def explorer_page(t):
    return facets.ExplorerQuery("o_orderkey", "o_custkey", facets.equals("o_orderstatus", "F"), sort=[("rating", -1.0)], columns=["o_orderkey", "o_custkey", "o_totalprice", "rating"]).build(t.orders, _ratings(t))


@carrier(f"WITH {_RATINGS} SELECT o_orderkey, coalesce(a.rating, CASE WHEN a.id IS NULL THEN b.rating END) AS rating, coalesce(CASE WHEN a.id IS NULL THEN b.review_count ELSE a.review_count END, b.review_count) AS review_count, a.id IS NOT NULL OR b.id IS NOT NULL AS has_rating FROM orders LEFT JOIN r a ON a.id = o_custkey LEFT JOIN r b ON b.id = o_custkey % 100", longs=("review_count",))
def rating_alias_lookup(t):
    return lookup.with_rating(t.orders, _ratings(t), "o_custkey", F.col("o_custkey") % 100).select("o_orderkey", "rating", "review_count", "has_rating")


@carrier(f"WITH {_RATINGS} SELECT o_orderkey, rating FROM orders JOIN r ON id = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND rating >= 4000")
def facet_conjunction(t):
    urgent = facets.one_of("o_orderpriority", "soon", {"soon": ["1-URGENT", "2-HIGH"]})
    q = facets.ExplorerQuery("o_orderkey", "o_custkey", facets=[urgent, facets.equals("o_orderstatus", "O"), facets.equals("o_orderkey", None)], min_rating=4000.0)
    rows = lookup.with_rating(facets.facet_filter(t.orders, q.scope, *q.facets), _ratings(t), q.lookup_col)
    return facets.facet_filter(rows, facets.at_least(q.min_rating, "rating")).select("o_orderkey", "rating")


@carrier("SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer WHERE c_mktsegment <> 'MACHINERY') ON c_custkey = o_custkey WHERE NOT coalesce(rich, false)")
def flag_no_keeps_null(t):
    c = t.customer.filter("c_mktsegment <> 'MACHINERY'").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich"))
    return facets.facet_filter(t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left"), facets.yes_no("rich", "no")).select("o_orderkey")


@carrier("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_nationkey = 3")
def facet_options(t):
    return facets.options(t.customer, "c_mktsegment", facets.equals("c_nationkey", 3))


@carrier("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'small') AS has_small FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')")
def array_facet(t):
    rows = t.part.withColumn("words", text.tokens("p_name"))
    return facets.facet_filter(rows, facets.contains("words", "widget")).select("p_partkey", F.array_contains("words", "small").alias("has_small"))


@carrier("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def quick_search(t):
    return facets.facet_filter(t.part, facets.quick_search("RING", "p_name", "p_brand", "p_type")).select("p_partkey")


@carrier("SELECT count(*) AS n_rows, count(*) FILTER (c_acctbal < 0) AS n_negative, count(DISTINCT c_nationkey) AS n_nations, count(DISTINCT c_mktsegment) AS n_segments FROM customer")
def stats_overview(t):
    return facets.overview(t.customer, {"n_negative": F.col("c_acctbal") < 0}, {"n_nations": "c_nationkey", "n_segments": "c_mktsegment"})


@carrier("SELECT c_mktsegment, c_nationkey, count(*) AS n_rows, count(*) FILTER (c_acctbal < 0) AS n_negative FROM customer GROUP BY ALL")
def conditional_counts(t):
    return facets.counts_by(t.customer, "c_mktsegment", "c_nationkey", n_negative=F.col("c_acctbal") < 0)


@carrier("SELECT count(*) AS n_repeated FROM (SELECT text FROM documents WHERE text <> '' GROUP BY text HAVING count(*) >= 2)")
def repeated_values(t):
    return facets.repeated_values(t.documents, "text")


@carrier("SELECT c_nationkey, bool_and(c_acctbal > -900) AS every_ok, bool_or(c_acctbal < 0) AS some_negative FROM customer GROUP BY 1")
def every_and_some(t):
    return t.customer.groupBy("c_nationkey").agg(F.bool_and(F.col("c_acctbal") > -900).alias("every_ok"), F.bool_or(F.col("c_acctbal") < 0).alias("some_negative"))


@carrier("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS batch_no FROM orders")
def batch_numbers(t):
    return facets.batches(t.orders, 500, "o_orderkey").select("o_orderkey", "batch_no")


@carrier("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 100")
def selection_stretch(t):
    return lookup.selection(t.orders, "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@carrier("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'top' END AS band_key, CASE WHEN o_totalprice < 100000 THEN 'Low' WHEN o_totalprice < 200000 THEN 'Middle' ELSE 'Top' END AS band_label FROM orders")
def price_bands(t):
    b = numbers.band("o_totalprice", (("low", "Low", "$", 0, 100000), ("mid", "Middle", "$$", 100000, 200000), ("top", "Top", "$$$", 200000, None)))
    return t.orders.select("o_orderkey", b["key"].alias("band_key"), b["label"].alias("band_label"))


@carrier("SELECT c_custkey, CASE WHEN s >= 4 THEN 5 WHEN s >= 3.5 THEN 4.5 WHEN s >= 3.4 THEN 4 WHEN s >= 3.3 THEN 3.5 WHEN s >= 3.1 THEN 3 WHEN s >= 3 THEN 2 ELSE 1 END::DOUBLE AS stars FROM (SELECT c_custkey, c_acctbal / 2000 AS s FROM customer)")
def star_steps(t):
    return t.customer.select("c_custkey", numbers.stars(F.col("c_acctbal") / 2000).alias("stars"))


@carrier("SELECT p_partkey, coalesce(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '')::INT, 2) AS party, p_size <= 20 AND 10 <= p_size + 5 AS fits FROM part")
def number_texts(t):
    return t.part.select("p_partkey", numbers.party_size("p_brand").alias("party"), numbers.bounds_overlap("p_size", F.col("p_size") + 5, F.lit(10), F.lit(20)).alias("fits"))


@carrier("SELECT p_partkey, lower(p_name) AS compact, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(p_name[1]) || p_name[2:string_length_first] || ' ' || upper(second[1]) || second[2:] AS titled FROM (SELECT *, strpos(p_name, ' ') - 1 AS string_length_first, substr(p_name, strpos(p_name, ' ') + 1) AS second FROM part)")
def normalised_names(t):
    return t.part.select("p_partkey", F.lower(text.compact_space(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " \t"), F.lit(" ")))).alias("compact"), text.match_text(F.concat_ws("-", "p_name", "p_brand"), "").alias("key"), text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.title_words("p_name").alias("titled"))


@carrier("SELECT p_partkey, p_name || ' st ' || p_size || ' n rd and co' AS short FROM part")
def address_short_forms(t):
    return t.part.select("p_partkey", text.shorten_address(F.concat("p_name", F.lit(" Street, No. "), F.col("p_size").cast("string"), F.lit("th / North Road & Co."))).alias("short"))


@carrier("SELECT p_partkey FROM part WHERE list_bool_and([list_bool_or([contains(w, q) OR levenshtein(w, q) <= 1 FOR w IN string_split(p_name, ' ')]) FOR q IN ['smal', 'wiget']])")
def fuzzy_search(t):
    return t.part.filter(text.fuzzy_match("p_name", "smal wiget")).select("p_partkey")


@carrier("SELECT p_partkey, p_name || ' ' || lower(p_brand) || ' ' || lower(p_type) AS search_text, len(list_distinct(string_split(p_name || ' ' || p_name, ' '))) AS n_tokens FROM part", longs=("n_tokens",))
def search_texts(t):
    return t.part.select("p_partkey", text.search_text("p_name", "p_brand", "p_type").alias("search_text"), F.size(text.important_tokens(F.concat_ws(" ", "p_name", "p_name"))).alias("n_tokens"))


@carrier(r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS host, len(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source, 'https://' || regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical FROM pages", longs=("depth",))
def url_parts(t):
    return t.pages.select("page_id", text.url_host("url").alias("host"), text.url_depth("url").alias("depth"), text.query_value("url", "utm_source").alias("utm_source"), text.canonical_url("url").alias("canonical"))


@carrier(r"WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages), l AS (SELECT page_id, list_concat([u], CASE WHEN u LIKE 'http://%' THEN ['https://' || u[8:]] ELSE [] END, flatten([[s || h || '/' || CASE WHEN i = 0 THEN '' ELSE array_to_string(p[1:i], '/') || '/' END FOR s IN ['https://', 'http://']] FOR i IN range(len(p) - 1, -1, -1)])) AS l FROM u) SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] AS ladder FROM l")
def url_ladders(t):
    return t.pages.select("page_id", text.url_ladder("url").alias("ladder"))


@carrier("SELECT event_id, 'https://x.example/a?k=' || regexp_extract(props, '([0-9]+)', 1) || '&t=' || event_type AS link FROM events")
def url_building(t):
    return t.events.select("event_id", text.add_query(F.lit("https://x.example/a"), {"k": F.get_json_object("props", "$.k"), "t": F.col("event_type")}).alias("link"))


@carrier("SELECT c_custkey, n_name || CASE WHEN c_acctbal < 0 THEN '' ELSE ', ' || c_mktsegment END || ', ' || c_name AS address FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tidy_addresses(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat_ws(" , ", "n_name", "n_name", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit(" "), "c_name", F.lit("Norway"))
    return rows.select("c_custkey", text.tidy_address(raw, F.lit("norway")).alias("address"))


@carrier("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, list_distinct([regexp_replace(c_name, '[^0-9]', '', 'g')]) AS blocks FROM customer")
def digit_groups(t):
    return t.customer.select("c_custkey", text.digits("c_name").alias("digits"), F.array_distinct(text.address_blocks("c_name")).alias("blocks"))


@carrier("SELECT n_regionkey, CASE len(x) WHEN 1 THEN x[1] WHEN 2 THEN x[1] || ' and ' || x[2] ELSE array_to_string(x[1:len(x) - 1], ', ') || ', and ' || x[len(x)] END AS listed FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS x FROM nation GROUP BY 1)")
def natural_lists(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("x")).select("n_regionkey", text.natural_list("x").alias("listed"))


@carrier(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: true)) AS n_lines, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the, len(list_filter([trim(p) FOR p IN regexp_split_to_array(text, '[\n,;|]+')], lambda p: p <> '')) AS n_parts FROM documents", longs=("n_lines", "n_parts"))
def split_and_count(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), text.count_of("text", "the").alias("n_the"), F.size(text.split_values("text")).alias("n_parts"))


_LINES = "SELECT doc_id, string_split(text, chr(10)) AS x FROM documents"


@carrier(f"SELECT doc_id, len([i FOR i IN range(1, len(x) + 1) IF i = 1 OR x[i] <> x[i - 1]]) AS n_runs, len(list_distinct([lower(v) FOR v IN x])) AS n_distinct FROM ({_LINES})", longs=("n_runs", "n_distinct"))
def runs_in_arrays(t):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(text.collapse_runs(lines)).alias("n_runs"), F.size(text.distinct_ignoring_case(lines)).alias("n_distinct"))


_TAGS = (("license", r"\blicen[cs]e"), ("email", r"[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]{2,}"), ("phone", r"\+?[0-9][0-9 ()-]{7,}[0-9]"), ("table", r" \| "), ("shout", r"!!"))


@carrier("SELECT doc_id, (list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in _TAGS) + r"], lambda x: x IS NOT NULL))[1:4] AS tags FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)")
def tag_dictionary(t):
    return t.documents.select("doc_id", rules.all_rules("text", _TAGS, limit=4).alias("tags"))


@carrier(r"SELECT doc_id, length(text) > 0 AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) < 0.2 * length(text) AND (n < 8 OR h >= n / 8) AS english FROM (SELECT doc_id, text, len(w) AS n, len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in rules.ENGLISH) + r"))) AS h FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS w FROM documents))")
def english_detector(t):
    return t.documents.select("doc_id", rules.is_english("text").alias("english"))


@carrier(r"SELECT doc_id, coalesce(array_to_string(list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '' AND NOT contains(lower(s), 'license')), ' '), '') AS kept FROM documents")
def sentence_filter(t):
    return t.documents.select("doc_id", rules.sentence_filter("text", "license").alias("kept"))


@carrier("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'special' WHEN contains(p_name, 'widget') THEN 'three' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'plain' END AS rule, list_filter([CASE WHEN contains(p_name, 'small') THEN 'size' END, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' END], lambda x: x IS NOT NULL) AS keys FROM part")
def ordered_rules(t):
    rule = F.coalesce(rules.first_rule("p_name", (("special", "ring"), ("three", "widget"))), F.when(F.col("p_type") == "PROMO", "promo").otherwise("plain"))
    return t.part.select("p_partkey", rule.alias("rule"), rules.all_rules("p_name", (("size", "small"), ("colour", "red|blue"))).alias("keys"))


@carrier("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%d/%m/%Y') AS raw, isodow(ts) >= 6 AS weekend, hour(ts) * 60 + minute(ts) AS minutes, CASE WHEN m > 1410 THEN '23:30' ELSE lpad((m // 60)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') END AS rounded FROM (SELECT *, (floor((hour(ts) * 60 + minute(ts)) / 30 + 0.5) * 30)::BIGINT AS m FROM events)", longs=("minutes",))
def date_and_time_texts(t):
    raw, clock = F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm")
    return t.events.select("event_id", dates.parse_date_text(raw).alias("day"), raw.alias("raw"), dates.is_weekend("ts").alias("weekend"), dates.minutes_of(clock).alias("minutes"), dates.half_hour(clock).alias("rounded"))


@carrier("SELECT o_orderkey, o_orderdate::DATE AS start_date, (o_orderdate + INTERVAL 1 DAY)::DATE AS end_date, o_orderstatus = 'P' AS tentative FROM orders WHERE month(o_orderdate) = month(o_orderdate + INTERVAL 1 DAY) ORDER BY 1")
def exclusion_items(t):
    last = F.date_add("o_orderdate", 1)
    raw = F.concat(F.lit("• "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" – "), F.dayofmonth(last).cast("string"), F.date_format("o_orderdate", " MMMM yyyy"), F.when(F.col("o_orderstatus") == "P", " (Tentative)").otherwise(""))
    x = t.orders.filter(F.month("o_orderdate") == F.month(last)).select("o_orderkey", dates.parse_exclusion(raw).alias("x"))
    return x.select("o_orderkey", F.col("x.start").alias("start_date"), F.col("x.end").alias("end_date"), "x.tentative")


@carrier("SELECT c_custkey, coalesce(max(CASE WHEN o_orderdate::DATE <= DATE '1997-06-01' THEN o_orderdate::DATE END), DATE '1997-06-01') AS expiry, coalesce(max(CASE WHEN o_orderdate::DATE <= DATE '1997-06-01' THEN o_orderdate::DATE END), DATE '1997-06-01') < DATE '1997-01-01' AS expired FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def expiry_dates(t):
    d = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.collect_set(F.to_date("o_orderdate")).alias("dates"))
    end, none = F.lit("1997-06-01").cast("date"), F.lit(None).cast("date")
    return d.select("c_custkey", dates.expiry_date("dates", none, end).alias("expiry"), dates.is_expired("dates", none, end, F.lit("1997-01-01").cast("date")).alias("expired"))


@carrier("SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE AS stale, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events")
def staleness(t):
    return t.events.select("event_id", dates.is_stale(F.col("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"), dates.zoned_text(F.col("ts").cast("timestamp"), "Asia/Singapore").alias("shown"))


@carrier("SELECT max(s) AS latest FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events)")
def latest_checked(t):
    from quillon.operators.slots import latest_checked as latest

    rows = t.events.select(F.explode(F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("not yet"))).alias("checked"))
    return latest(rows, "checked")


@carrier("SELECT count(*) AS n_rows, sha256(concat_ws('-', " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT::VARCHAR" for i in range(4)) + ")) AS digest FROM (SELECT sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation)")
def table_digest(t):
    return numbers.table_digest(t.nation, *t.nation.columns)


@carrier("SELECT event_id, sha256('pepper:[\"' || user_id || '\",\"' || event_type || '\"]') AS key FROM events")
def salted_keys(t):
    return t.events.select("event_id", numbers.salted_hash("pepper", "user_id", "event_type").alias("key"))
