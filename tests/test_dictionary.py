"""Dictionaries of many aliases against brute force, and moved links to the end."""

import random
import string

from pyspark.sql import functions as F

from quillon.operators import dictionary, parse, rules
from tests.conftest import SF


def brute(text, aliases):
    """(start, alias, value) of all places, by hand."""
    if text is None:
        return []
    text, out = text.lower(), []
    for alias, value in aliases:
        alias = (alias or "").lower()
        at = text.find(alias) if alias else -1
        while at >= 0:
            end = at + len(alias)
            if (at == 0 or text[at - 1] not in string.ascii_lowercase) and (end == len(text) or text[end] not in string.ascii_lowercase):
                out.append((at, alias, value))
            at = text.find(alias, at + 1)
    return sorted(set(out), key=lambda m: (m[0], -len(m[1]), m[2]))


def test_all_places_in_one_pass_or_several(spark):
    aliases = [("New York", "NY"), ("york", "UK"), ("York", "PA"), ("new", "x"), ("", "no"), (None, "no"), ("東京", "Tokyo"), ("a.b", "dot"), ("new york city", "NYC")]
    texts = [(1, "New York City, york; newyork"), (2, None), (3, ""), (4, "東京a.b a.b"), (5, "yorks york"), (5, "yorks york")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    table = spark.createDataFrame(aliases, "alias string, value string")
    for how in ({}, {"automaton_bytes": 30}):
        out = dictionary.dictionary_matches(df, "text", table, **how)
        assert out.columns == [*df.columns, "matches"]
        got = sorted((r.id, [tuple(m) for m in r.matches]) for r in out.collect())
        assert got == sorted((i, brute(t, aliases)) for i, t in texts)
        first = {r.id: (r.v, r.l, [m.alias for m in r.w]) for r in out.select("id", dictionary.values_of("matches").alias("v"), dictionary.longest_value("matches").alias("l"), dictionary.without_overlaps("matches").alias("w")).collect()}
        assert first[1] == (["NYC", "NY", "x", "PA", "UK"], "NYC", ["new york city", "york"]) and first[2] == ([], None, [])
    assert dictionary.dictionary_matches(df, "text", table.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_a_hundred_thousand_aliases(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9)))
    aliases = sorted({(" ".join(word() for _ in range(rng.randrange(1, 3))), f"t{i % 50}") for i in range(100_000)})
    texts = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    df, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(aliases, "alias string, value string")
    got = {r.id: [tuple(m) for m in r.matches] for r in dictionary.dictionary_matches(df, "text", table).collect()}
    assert got == {i: brute(t, aliases) for i, t in texts} and sum(map(len, got.values())) > 100


def test_longest_value_is_longest_alias(spark):
    aliases = [("paris", "FR"), ("south", "S"), ("south paris", "US"), ("rome", "IT")]
    df = spark.read.parquet(f"{SF}/part.parquet").select(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Paris,").otherwise("South Paris Rome")).alias("text"))
    out = dictionary.dictionary_matches(df, "text", spark.createDataFrame(aliases, "alias string, value string"))
    assert out.filter(~dictionary.longest_value("matches").eqNullSafe(rules.longest_alias("text", aliases))).count() == 0


def test_moves_to_the_end(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(1000)]
    loop = [("x3", "x1"), ("x1", "x2"), ("x2", "x3"), ("tail2", "tail1"), ("tail1", "x2"), ("me", "me")]
    other = [("two", "b"), ("two", "a"), (None, "z"), ("lost", None), ("a", "end")]
    df = spark.createDataFrame(chain + loop + other, "s string, t string")
    out = {r.s: (r.t, r.cyclic) for r in parse.follow_moves(df, "s", "t").collect()}
    want = {s: ("c1000", False) for s, _ in chain} | {s: ("x1", True) for s in ("x1", "x2", "x3", "tail1", "tail2")} | {"me": ("me", True), "two": ("end", False), "a": ("end", False)}
    assert out == want
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "s int, t int")
    assert {(r.t, r.cyclic) for r in parse.follow_moves(ring, "s", "t").collect()} == {(0, True)}
    assert parse.follow_moves(df.limit(0), "s", "t").count() == 0


def test_a_worker_holds_few_texts_at_once(monkeypatch):
    """Matches of a whole batch used to be Python objects at the same time."""
    import pyarrow as pa

    monkeypatch.setattr(dictionary, "PIECE", 10)
    texts = ["a" * 4, None, "b" * 4, "", "c" * 30, "d", "e" * 9, "f"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["row", "t"])
    got = [(p.column(0).to_pylist(), held) for p, held in dictionary._pieces([b, b.slice(0, 0)])]
    assert [i for rows, _ in got for i in rows] == list(range(8)) and [t for _, held in got for t in held] == texts
    assert [rows for rows, _ in got] == [[0, 1, 2, 3], [4], [5, 6], [7]]
