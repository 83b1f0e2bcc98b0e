"""Similarity join against all pairs of a block."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import shorten_address
from quillon.operators import similar
from tests.conftest import SF


def ratio_of(a, b):
    return 1.0 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def brute(left, right, tokens, ratio):
    """(left id, right id, common, ratio) over all pairs of a block; rows are (id, block, normalised text)."""
    out = []
    for i, k, a in left:
        for j, m, b in right:
            if k == m and k is not None and a and b:
                common = len(set(a.split()) & set(b.split()))
                r = ratio_of(a, b)
                if common >= tokens or (ratio is not None and r >= ratio):
                    out.append((i, j, common, None if ratio is None else round(r, 9)))
    return sorted(out)


def found(s):
    return sorted((r.id, r.other, r.common, None if r.ratio is None else round(r.ratio, 9)) for r in s.pairs.collect())


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("tokens,ratio", [(2, 0.72), (3, 0.65), (1, 0.9), (2, None)])
def test_names_of_every_kind(spark, tokens, ratio):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdo") for _ in range(rng.randrange(1, 6)))
    names = [" ".join(["the", *(word() for _ in range(rng.randrange(0, 4)))]) for _ in range(90)]
    names += ["", None, "!!", "a", "b", "ab", "aa", "aaa", "a a", "aaaa aaaa", "the", "the the", "Cafe  Paris", "cafe, paris", "cafe paris on the hill of the long road to the sea " * 3, "12 North Street", "12 n st", "x" * 230, "x" * 229 + "y"]
    names += [n[:i] + rng.choice("abo") + n[i + 1 :] for n in names[:40] for i in [rng.randrange(len(n))]]
    rows = [(i, n, None if i % 31 == 0 else i % 2) for i, n in enumerate(names)]
    left = spark.createDataFrame(rows, "id long, name string, block long")
    right = left.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("block").alias("other_block")).filter("other % 3 > 0")
    s = similar.similar_pairs(left, right, [("block", "other_block")], ("name", "other_name"), tokens, ratio)
    want = brute(plain(left, "id", "block", shorten_address("name")), plain(right, "other", "other_block", shorten_address("other_name")), tokens, ratio)
    assert found(s) == want and want
    (r,) = s.report().collect()
    assert r.matched == len(want) <= r.candidates < r.possible and r.verified <= r.candidates


def test_without_blocks_and_with_repeated_rows(spark):
    left = spark.createDataFrame([(1, "grand hotel"), (1, "grand hotel"), (2, "hotel"), (3, "grnad hotel")], "id long, name string")
    right = left.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    s = similar.similar_pairs(left, right, [], ("name", "other_name"))
    rows = [(i, 0, n) for i, n in plain(left, "id", "name")]
    assert found(s) == brute(rows, rows, 2, 0.72)
    assert similar.similar_pairs(left.limit(0), right, [], ("name", "other_name")).pairs.count() == 0


def test_hot_words_are_no_postings(spark):
    """All 400 names have the same two words; only those with a third in common or a like text meet."""
    left = spark.createDataFrame([(i, f"the restaurant {chr(97 + i % 26) * 9}{chr(97 + i // 26) * 9}") for i in range(400)], "id long, name string")
    right = left.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    s = similar.similar_pairs(left, right, [], ("name", "other_name"), 3, None)
    assert s.pairs.count() == 400 and s.candidates.count() == 400


def test_parts_of_a_block(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    left = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    right = left.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("brand").alias("other_brand"))
    s = similar.similar_pairs(left, right, [("brand", "other_brand")], ("name", "other_name"))
    assert found(s) == brute(plain(left, "id", "brand", shorten_address("name")), plain(right, "other", "other_brand", shorten_address("other_name")), 2, 0.72)


def test_bounds_hold_for_random_texts():
    """Pairs at the ratio have the common letter pairs that the join asks for."""
    rng = random.Random(1)
    for _ in range(20_000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14)))
        size = len(a) + len(b)
        m = sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        pairs = [[t[i : i + 2] for i in range(len(t) - 1)] for t in (f"\2{a}\3", f"\2{b}\3")]
        common = sum(min(pairs[0].count(g), pairs[1].count(g)) for g in set(pairs[0]))
        assert common >= 3 * m - size + 1


def test_copies_are_compared_once(spark):
    """300 copies of each of two names: four pairs of classes, and all pairs of rows from them."""
    left = spark.range(601).select(F.col("id"), F.when(F.col("id") == 600, "odd").when(F.col("id") % 2 == 0, "red bolt").otherwise("red bold").alias("name"))
    right = left.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    s = similar.similar_pairs(left, right, [], ("name", "other_name"))
    assert s.candidates.count() == s.links.count() == 5 and s.pairs.distinct().count() == 4 * 300 * 300 + 1
    (r,) = s.report().collect()
    assert tuple(r) == (601 * 601, 360_001, 180_000, 360_001)
    assert s.left.count() == 601 and s.left.select("class_").distinct().count() == 3


def test_similar_parts_by_their_least_parts(spark):
    from quillon.plans import carriers

    rows = carriers.queries()["similar_parts"](spark, SF).collect()
    least = {r.id: r.other for r in rows if r.row == "copy"}
    links = {(r.id, r.other) for r in rows if r.row == "pair"}
    part = spark.read.parquet(f"{SF}/part.parquet")
    parts = plain(part, "p_partkey", "p_brand", shorten_address("p_name"))
    assert {(i, j) for i in least for j in least if (least[i], least[j]) in links} == {x[:2] for x in brute(parts, parts, 2, 0.72)}
