"""Pairs of copies: decided once a text, expanded only where they are the result."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import token_overlap
from quillon.operators import match
from quillon.plans import carriers

BLOCK, NAMES, IDS = [("b", "b2")], ("name", "other_name"), ("id", "other")


@pytest.fixture(scope="module")
def sides(spark):
    names = ["red bolt", "red bolt", "red nut", "blue nut", "bolt red", "", None, "lone", "blue red"]
    rows = [(i, names[i * i % 9], None if i % 23 == 5 else i % 2, i * 37 % 11) for i in range(120)]
    left = spark.createDataFrame(rows, "id long, name string, b int, size int").cache()
    return left.drop("size"), left.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("b").alias("b2"), "size")


def test_expanded_classes_are_all_pairs(sides):
    left, right = sides
    want = match.blocked_pairs(left, right, BLOCK, NAMES).select("id", "other", token_overlap("name", "other_name").alias("c"))
    classes = match.class_pairs(left, right, BLOCK, NAMES, IDS).withColumn("c", token_overlap("name", "other_name"))
    for most in (1000, 3):  # in one slice and in many
        got = match.expand_pairs(left.join(classes, ["b", "name"]), right.drop("size"), ["b2", "other_name"], "other", most).select("id", "other", "c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert classes.count() * 10 < want.count()


def test_best_blocked_is_the_top_of_all_pairs(sides):
    left, right = sides
    score = lambda df: df.withColumn("s", token_overlap("name", "other_name") * 5 + F.col("size"))
    order = [F.col("s"), -F.col("other")]
    want = match.top_candidates(score(match.blocked_pairs(left, right, BLOCK, NAMES).filter("id <> other")), "id", 3, *order)
    got = match.best_blocked(left, right, BLOCK, NAMES, IDS, 3, [F.col("size"), -F.col("other")], score, order)
    rows = lambda df: sorted(map(tuple, df.select("id", "other", "s", "rank").collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 100


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """1,000 parts of a block: 500 of one name, 499 of another that has one word in common, and one that stands alone."""
    where = str(tmp_path_factory.mktemp("parts"))
    name = F.when(F.col("id") == 999, "odd thing").when(F.col("id") % 2 == 0, "red bolt").otherwise("red nut")
    spark.range(1000).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{where}/part.parquet")
    return where


def test_best_tier_of_copies(spark, copies):
    rows = carriers.queries()["best_strength_tier"](spark, copies)
    assert rows.count() == 500 * 499 + 499 * 498 and rows.filter("common <> 2 or id = other").count() == 0


def test_similar_names_are_linear(spark, copies):
    rows = carriers.queries()["similar_names"](spark, copies)
    pairs = sorted((r.id, r.other, r.same, r.ratio) for r in rows.filter("row = 'pair'").collect())
    assert [p[:3] for p in pairs] == [(0, 0, True), (0, 1, False), (1, 0, False), (1, 1, True)]
    assert {(r.id, r.other) for r in rows.filter("row = 'copy'").collect()} == {(i, 999 if i == 999 else i % 2) for i in range(1000)}


def test_best_blocked_ranks_classes_only(sides):
    left, right = sides
    score = lambda df: df.withColumn("s", F.col("size"))
    got = match.best_blocked(left, right, BLOCK, NAMES, IDS, 3, [F.col("size"), -F.col("other")], score, [F.col("s"), -F.col("other")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Window [row_number() windowspecdefinition(id#") == 0


def test_class_members_hold_every_key_once(sides):
    left, _ = sides
    got = match.class_members(left, ["b", "name"], "id", "ids", 4).collect()
    want = {r.id: (r.b, r.name) for r in left.filter("b is not null and name is not null").collect()}
    assert sorted(i for r in got for i in r.ids) == sorted(want)
    assert all(want[i] == (r.b, r.name) for r in got for i in r.ids) and max(len(r.ids) for r in got) < 12


def test_all_pairs_of_copies_are_not_joined_one_by_one(spark, copies):
    rows = carriers.queries()["blocked_token_overlap"](spark, copies)
    assert rows.count() == 999 * 998 and rows.distinct().count() == 999 * 998 and rows.filter("id = other").count() == 0
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert plan.toString().splitlines()[0].startswith("Project") and plan.toString().index("Generate") < plan.toString().index("Join")
