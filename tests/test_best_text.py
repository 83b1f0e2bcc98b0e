"""Best texts of pages: a candidate's score is worked out once, and is text_score."""

from pyspark.sql import functions as F

from quillon.operators import parse

LONG = "a small house near the harbour with seasonal plates and wine all day"
TEXTS = [
    LONG,
    "too short",
    "Book a table for dinner with us at the house by the bay",
    "we open on Monday and on Tuesday for lunch and dinner in the house by the bay",
    "a house with a chef and wine from 5 pm to 11 pm every day of the whole year",
    "write to info@house for news of the house by the bay and more of it",
    "write to info@house for the menu of the house by the bay and more of it",
    "the house at 120 long road by the bay is the one that we all like best",
    "call 0123 45678 to hear more of the house by the bay that we like best",
    "Ｗine   and\n\tmore of it été in the house by the bay every single day",
    " ".join(["plain"] * 90),
    "The Bay House is the one that we all like best",
    "",
    None,
]


def test_best_text_is_the_best_of_text_score(spark):
    rows = [(i, t, [TEXTS[j % len(TEXTS)] for j in range(i, i + i % 5)] or None) for i, t in enumerate(["The Bay House", None, LONG, ""] * 12)]
    pages = spark.createDataFrame(rows, "id long, title string, texts array<string>")
    cands = pages.select("id", "title", F.posexplode("texts").alias("i", "text")).withColumn("score", parse.text_score("text", "title", F.col("title"), 12.0)).collect()
    want = {}
    for r in sorted(cands, key=lambda r: (-r.score, r.i)):
        if r.score > -100:
            want.setdefault(r.id, ("visible_text", r.text, r.score))
    got = parse.best_text(pages, "id", "title", F.col("title"), {"visible_text": (F.col("texts"), 12.0)}).collect()
    assert {r.id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    # pages of no text, no candidate or only bad ones have no row
    assert 10 < len(want) < len({r.id for r in cands}) < len(rows)


def test_scores_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    score = {r.i: r.s for r in df.select("i", parse.text_score("text", F.lit("The Bay House"), F.lit("The Bay House"), 12.0).alias("s")).collect()}
    assert score == {0: 50.0, 1: -100.0, 2: -100.0, 3: -100.0, 4: -100.0, 5: -100.0, 6: 50.0, 7: -100.0, 8: -100.0, 9: 40.0, 10: 26.0, 11: 43.0, 12: -100.0, 13: -100.0}


def test_a_candidate_is_normalised_once(spark):
    pages = spark.createDataFrame([(1, "t", ["x"])], "id long, title string, texts array<string>")
    plan = parse.best_text(pages, "id", "title", F.col("title"), {"visible_text": (F.col("texts"), 12.0)})._jdf.queryExecution().optimizedPlan().toString()
    # once for the text, the title and the name
    assert plan.count("translate(") == 3 and "RLIKE" not in plan
