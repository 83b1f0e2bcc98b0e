"""Carriers: rules, first matches, contacts and unsubscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.numbers import salted_hash
from quillon.operators import lookup, match, rules
from quillon.plans.registry import carrier
from quillon.streaming import alerts


@carrier("SELECT o_orderkey, min(l_partkey) FILTER (l_quantity > 30) AS l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def first_matches(t):
    """Of each order the first part of which it has over 30 pieces."""
    return lookup.first_match(t.orders.select("o_orderkey"), t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), F.col("l_quantity") > 30, "o_orderkey", "l_partkey", "l_partkey")


@carrier("WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Shared' || c_nationkey ELSE 'own' || c_custkey END || '@example.org' AS email, c_acctbal < 0 AS out FROM customer) SELECT c_custkey, NOT bool_or(out) OVER (PARTITION BY lower(email)) AS enabled FROM s")
def unsubscribed(t):
    """An address that one customer with a negative balance unsubscribed is off for all who share it."""
    email = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Shared"), "c_nationkey")).otherwise(F.concat(F.lit("own"), "c_custkey")), F.lit("@example.org"))
    subs = t.customer.select("c_custkey", email.alias("email"), (F.col("c_acctbal") < 0).alias("out"), F.lit(True).alias("enabled"))
    tokens = subs.filter("out").select(salted_hash("s", F.lower("email")).alias("token"))
    return alerts.unsubscribe(subs, tokens, "s").select("c_custkey", "enabled")


@carrier("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment || '@x.example' END AS email, CASE WHEN c_custkey % 2 = 0 THEN '+65 6' || lpad(c_custkey::VARCHAR, 7, '0') END AS phone, CASE WHEN c_custkey % 3 = 0 THEN 'https://x.example/' || c_custkey END AS url FROM customer)
SELECT *, CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 'email_or_phone' WHEN email IS NOT NULL THEN 'email' WHEN phone IS NOT NULL THEN 'phone' WHEN url IS NOT NULL THEN 'online' ELSE 'none' END AS mode FROM c""")
def contact_parts(t):
    k = F.col("c_custkey")
    lines = F.array_compact(F.array(F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Mail: "), "c_mktsegment", F.lit("@x.example"))), F.when(k % 3 == 0, F.concat(F.lit("see https://x.example/"), k)), F.when(k % 2 == 0, F.concat(F.lit("Tel. +65 6"), F.lpad(k.cast("string"), 7, "0")))))
    return t.customer.select(k, rules.contacts(lines).alias("c")).select("c_custkey", "c.email", "c.phone", "c.url", "c.mode")


@carrier("SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'kid_friendly' WHEN c_nationkey = 2 THEN 'older_children_only' WHEN c_nationkey = 3 THEN 'unknown' WHEN c_nationkey = 4 THEN 'teens_only' WHEN c_nationkey = 5 THEN 'policy_available' WHEN c_custkey % 20 <= 6 THEN 'kid_friendly' WHEN c_custkey % 20 <= 12 THEN 'older_children_only' ELSE 'teens_only' END AS policy FROM customer")
def child_policies(t):
    n = F.col("c_nationkey")
    note = F.when(n == 3, "  ").when(n == 4, "From junior high school").when(n == 5, "Please ask").otherwise(F.concat(F.lit("Children from "), (F.col("c_custkey") % 20).cast("string"), F.lit(" years")))
    services = F.when(n == 1, F.array(F.lit("Child-Friendly"))).when(n == 2, F.array(F.lit("parking"), F.lit("children-over12-accepted")))
    return t.customer.select("c_custkey", rules.child_policy(note, services).alias("policy"))


_ALIASES = (("ring", "round"), ("spring", "season"), ("red", "colour"), ("dark red", "deep colour"), ("green", "colour"), ("linen", "cloth"))


@carrier("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '(^|[^a-z]){a}([^a-z]|$)') THEN '{v}'" for a, v in sorted(_ALIASES, key=lambda x: (-len(x[0]), x[0]))) + " END AS value FROM part")
def longest_aliases(t):
    return t.part.select("p_partkey", rules.longest_alias("p_name", _ALIASES).alias("value"))


@carrier("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_custkey % 50 + 10 END AS low, CASE WHEN c_acctbal > 0 THEN c_custkey % 50 + 40 END AS high FROM customer")
def service_prices(t):
    k = F.col("c_custkey")
    price = lambda name, low: F.struct(F.lit(name).alias("serviceType"), (k % 50 + low).alias("min"), (k % 50 + low + 30).alias("max"))
    ranges = F.when(F.col("c_acctbal") > 0, F.array(price("lunch", 0), price("dinner", 10), price("dinner", 99))).otherwise(F.array(price("lunch", 5)))
    return t.customer.select("c_custkey", rules.service_price(ranges, "dinner").alias("p")).select("c_custkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"))


@carrier("SELECT doc_id, length(t) < 40 OR regexp_matches(t, 'enable javascript|cookies? (?:policy|consent)|page not found|access denied|403 forbidden|domain (?:is )?for sale') AS junk FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t FROM documents)")
def junk_documents(t):
    return t.documents.select("doc_id", rules.is_junk("text").alias("junk"))


@carrier("WITH a AS (SELECT p_brand, list(DISTINCT p_name) AS names FROM part WHERE p_size <= 3 GROUP BY 1) SELECT p_partkey, CASE WHEN p_name = '' THEN 0 WHEN list_contains(coalesce(names, []), p_name) THEN 1 WHEN len(list_filter(coalesce(names, []), lambda x: contains(x, p_name) OR contains(p_name, x))) > 0 THEN 0.7 ELSE 0 END::DOUBLE AS strength FROM part LEFT JOIN a USING (p_brand)")
def native_strengths(t):
    """Names against those of the brand's small parts as aliases."""
    names = t.part.filter("p_size <= 3").groupBy(F.col("p_brand").alias("b")).agg(F.collect_set("p_name").alias("names"))
    rows = t.part.join(names, F.col("p_brand") == F.col("b"), "left")
    return rows.select("p_partkey", match.native_strength("p_name", F.coalesce("names", F.array().cast("array<string>"))).alias("strength"))
