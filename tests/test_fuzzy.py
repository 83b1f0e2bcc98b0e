"""Fuzzy search by many queries against all pairs."""

import math
import random
import re

from pyspark.sql import functions as F

from quillon.operators import fuzzy
from tests.conftest import SF

WORD = re.compile(r"[^\W_]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_fits(q, w):
    return q in w or len(q) >= 3 and edits(q, w) <= math.floor(len(q) * 0.3)


def fits(text, query):
    q, t = WORD.findall((query or "").lower()), WORD.findall((text or "").lower())
    return all(any(word_fits(a, b) for b in t) for a in q)


def test_pairs_of_words(spark):
    """Words of all lengths, changed in as many places as are allowed and one more."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 16))) for _ in range(120)]

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            kind, at = rng.randrange(3), rng.randrange(len(w) + 1)
            if kind == 0:
                w.insert(at, rng.choice("abcé"))
            elif w and kind == 1:
                w.pop(at % len(w))
            elif w:
                w[at % len(w)] = rng.choice("abcé")
        return "".join(w)

    asked = sorted({x for w in words for n in (0, 1, math.floor(len(w) * 0.3), math.floor(len(w) * 0.3) + 1) for x in [changed(w, n)] if x} | {"a", "ab", "abc"})
    got = fuzzy.matching_words(spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in sorted(set(words))], "w string"))
    want = sorted((q, w) for q in asked for w in set(words) if word_fits(q, w))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_queries_of_several_words(spark):
    texts = [(1, "Grand Hotel Paris-Nord"), (2, "grand café"), (3, None), (4, ""), (5, "hotels of the north"), (5, "hotels of the north"), (6, "東京 大阪 42nd street"), (7, "x" * 3000 + " hotel")]
    asked = [(1, "hotel"), (2, "grnd hotl"), (3, "grand"), (4, " !! "), (5, None), (6, "no rth"), (7, "42"), (8, "京"), (9, "nothing like this"), (10, "GRAND grand"), (11, "hotel zzz"), (12, "el-par")]
    t, q = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked, "qid int, query string")
    got = sorted((r.qid, r.id) for r in fuzzy.fuzzy_search(t, "text", q, "query").collect())
    assert got == sorted((i, j) for i, a in asked if WORD.findall(a or "") for j, b in texts if fits(b, a))
    assert sorted(r.qid for r in fuzzy.words_of_none(q, "query").collect()) == [4, 5]
    assert fuzzy.fuzzy_search(t.limit(0), "text", q, "query").count() == fuzzy.fuzzy_search(t, "text", q.limit(0), "query").count() == 0


def test_benchmark_words_against_parts(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.explode(fuzzy.search_words("text")).alias("word")).distinct()
    names = [tuple(r) for r in part.collect()]
    want = sorted((a, k) for a in (r.word for r in asked.collect()) for k, n in names if fits(n, a))
    assert sorted((r.word, r.p_partkey) for r in fuzzy.fuzzy_search(part, "p_name", asked, "word").collect()) == want and want


def test_texts_of_equal_words_are_searched_once(spark, monkeypatch):
    """Repeated texts come out once each, and no set of (query, text) pairs is aggregated to make them distinct."""
    texts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "Red bolts, bolt").when(F.col("id") % 3 == 1, "bolt red BOLTS").otherwise("").alias("text"))
    asked = spark.createDataFrame([(1, "bolt"), (2, "red bolts"), (3, "bolt"), (4, "gasket")], "no int, query string")
    for most in (50_000, 0):  # broadcast and shuffled
        monkeypatch.setattr(fuzzy, "COUNTED", most)
        got = fuzzy.fuzzy_search(texts, "text", asked, "query")
        assert sorted((r.no, r.id) for r in got.collect()) == [(n, i) for n in (1, 2, 3) for i in range(300) if i % 3 < 2]
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
