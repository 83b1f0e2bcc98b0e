"""Best candidates: rows dealt by id meet the lists of their classes; classes beyond what a task may hold, too."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import token_overlap
from quillon.operators import match
from quillon.plans import carriers

BLOCK, NAMES, IDS = [("b", "b2")], ("name", "other_name"), ("id", "other")


@pytest.fixture(scope="module")
def sides(spark):
    names = ["red bolt", "red bolt", "red nut", "blue nut", "bolt red", "", None, "lone", "blue red", "a"]
    rows = [(None if i % 31 == 7 else i, names[i * i % 10], None if i % 23 == 5 else i % 2, i * 37 % 11) for i in range(150)]
    left = spark.createDataFrame(rows, "id long, name string, b int, size int").cache()
    return left.drop("size"), left.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("b").alias("b2"), "size")


@pytest.mark.parametrize("bounds", [{}, {"held": 0}, {"held": 0, "heavy": 10}, {"held": 0, "heavy": 0}])
def test_all_ways_give_the_top_of_all_pairs(spark, sides, bounds):
    left, right = sides
    score = lambda df: df.withColumn("s", token_overlap("name", "other_name") * 5 + F.col("size"))
    order = [F.col("s"), -F.col("other")]
    want = match.top_candidates(score(match.blocked_pairs(left, right, BLOCK, NAMES).filter("id <> other")), "id", 3, *order)
    got = match.best_blocked(left, right, BLOCK, NAMES, IDS, 3, [F.col("size"), -F.col("other")], score, order, **bounds)
    rows = lambda df: sorted(map(tuple, df.select("id", "name", "b", "other", "other_name", "s", "rank").collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 100


def test_margin_policy_deals_rows_by_id(spark, tmp_path):
    name = F.when(F.col("id") % 2 == 0, "red bolt").otherwise("red nut")
    spark.range(1000).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    rows = carriers.queries()["margin_policy"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # one shuffle of rows by id, before they become three; no row is sent to all tasks, and its list needs no interpreted lambda
    assert plan.count("hashpartitioning(id#") == 1 and "REPARTITION_BY_COL" in plan and "filter(best_" not in plan
    assert rows.count() == 3000 and rows.filter("id = other").count() == 0
    assert {tuple(r) for r in rows.filter("id in (48, 49, 50)").select("id", "other", "rank").collect()} == {(48, 98, 1), (48, 148, 2), (48, 198, 3), (49, 99, 1), (49, 149, 2), (49, 199, 3), (50, 48, 1), (50, 98, 2), (50, 148, 3)}
