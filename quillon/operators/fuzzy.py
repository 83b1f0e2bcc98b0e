"""Fuzzy search by a table of queries: query words meet the vocabulary by signatures, candidates by the rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import _c
from quillon.sources.shared import materialize

#: A word of a query may be off by this share of its length; shorter words have to be contained.
SHARE, SHORTEST = 0.3, 3
#: Pairs of a query and a set of words, counted first, that are broadcast to the texts; more are shuffled.
COUNTED = 50_000


def search_words(x) -> Column:
    """Distinct lower-cased runs of letters and digits; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def edits_allowed(length) -> Column:
    """Edits that a query word of this length may need."""
    return F.when(length < SHORTEST, 0).otherwise(F.floor(length * F.lit(SHARE))).cast("int")


def word_fits(query: Column, word: Column) -> Column:
    """The word contains the query word or is within its edits."""
    k = edits_allowed(F.length(query))
    return word.contains(query) | ((k > 0) & (F.abs(F.length(word) - F.length(query)) <= k) & (F.levenshtein(word, query) <= k))


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """(first letter from 1, size) of segment i of k + 1 of a word; the last ones are longer by one where need be."""
    base, more = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    plain = k + 1 - more
    return F.lit(1) + (i - 1) * base + F.greatest(i - 1 - plain, F.lit(0)), base + (i > plain).cast("int")


def _near_candidates(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(q, w) with a segment of q in w at a place that k edits allow; a superset of the pairs within k edits.

    Of k + 1 segments k edits leave one as it is. Segment i is sought where at most i - 1 edits lie before it and k + 1
    - i behind it, seen from the start and from the end, so few substrings of a word are looked up.
    """
    q = asked.withColumn("n", F.length("q")).withColumn("k", edits_allowed(F.col("n"))).filter("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1)))
    start, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    left = q.select("q", "n", "i", F.col("q").substr(start, size).alias("part"))
    lengths = sorted(r.n for r in q.select("n").distinct().collect())  # one number a length of word
    some = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    w = words.withColumn("m", F.length("w")).withColumn("n", F.explode(F.filter(some, lambda n: F.abs(n - F.col("m")) <= edits_allowed(n)))).withColumn("k", edits_allowed(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1)))
    start, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    off = F.col("m") - F.col("n")
    first = F.greatest(F.lit(1), start - F.col("i") + 1, start + off - (F.col("k") + 1 - F.col("i")))
    last = F.least(F.col("m") - size + 1, start + F.col("i") - 1, start + off + (F.col("k") + 1 - F.col("i")))
    w = w.withColumns({"size": size, "first": first, "last": last}).filter("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    right = w.select("w", "n", "i", F.col("w").substr(F.col("at"), F.col("size")).alias("part"))
    return left.join(right, ["n", "i", "part"]).select("q", "w").distinct()


def _containing(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(q, w) with q in w: the triple of letters of q (all of q, if shorter) that the fewest words have leads to them."""
    grams = lambda c, size: F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    short = sorted(r[0] for r in asked.select(F.least(F.length("q"), F.lit(3))).distinct().collect())
    index = words.select("w", F.explode(F.array_distinct(F.flatten(F.array(*[grams("w", s) for s in short]))) if short else F.array().cast("array<string>")).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("df"))
    own = asked.select("q", F.explode(F.array_distinct(F.coalesce(*[F.when(F.least(F.length("q"), F.lit(3)) == s, grams("q", s)) for s in short]) if short else F.array().cast("array<string>"))).alias("gram"))
    # a gram that no word has makes the query word hopeless: it counts as the rarest
    rarest = own.join(often, "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").filter(F.col("w").contains(F.col("q"))).select("q", "w")


def matching_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(q, w) of all query words (column q) and words (column w) that fit, each pair once; see word_fits."""
    near = _near_candidates(asked, words).filter(F.levenshtein("w", "q") <= edits_allowed(F.length("q")))
    return near.unionAll(_containing(asked, words)).distinct()


def fuzzy_search(texts: DataFrame, text: str, queries: DataFrame, query: str) -> DataFrame:
    """Pairs of queries and texts (columns of both, whose names differ) in which every word of the query is in, or
    within floor(0.3 * its length) edits of, a word of the text; words of under three letters have to be contained.

    The distinct words of the queries meet those of the texts by signatures, so no pair of query and text is looked at
    that has no word in common so, and texts of equal words are looked at once. Of a query's words, the one that the fewest texts fit proposes texts; the others
    are tested on these. A query without words fits any text and isn't paired (words_of_none); null and empty texts
    fit none; repeated rows are rows of their own.
    """
    row = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    t = materialize(texts.select(F.monotonically_increasing_id().alias("t_id"), search_words(text).alias("t_words"), row(texts).alias("t_row")), "fuzzy-texts")
    q = materialize(queries.select(F.monotonically_increasing_id().alias("q_id"), search_words(query).alias("q_words"), row(queries).alias("q_row")).filter(F.size("q_words") > 0), "fuzzy-queries")
    kinds = materialize(t.groupBy(F.array_sort("t_words").alias("words")).agg(F.count("*").alias("n")), "fuzzy-kinds")
    posted = kinds.select("words", "n", F.explode("words").alias("w"))
    vocabulary = materialize(posted.groupBy("w").agg(F.sum("n").alias("df")), "fuzzy-words")
    asked = q.select("q_id", F.explode("q_words").alias("q"))
    pairs = materialize(matching_words(asked.select("q").distinct(), vocabulary.select("w")), "fuzzy-pairs")
    cost = pairs.join(vocabulary, "w").groupBy("q").agg(F.sum("df").alias("cost"))
    # words that fit nothing make their query fit nothing: it has no driver then
    driver = asked.join(cost, "q", "left").groupBy("q_id").agg(F.min_by("q", F.struct("cost", "q")).alias("q"), F.min(F.col("cost").isNotNull()).alias("all")).filter("all").select("q_id", "q")
    # a query meets words at the first that its driver fits, so no set of pairs is held to make them distinct
    met = driver.join(pairs, "q").join(posted, "w").filter(F.col("w") == F.element_at(F.filter("words", lambda b: word_fits(F.col("q"), b)), 1))
    fits = F.forall("q_words", lambda a: F.exists("words", lambda b: word_fits(a, b)))
    met = materialize(met.join(q, "q_id").filter(fits).select("q_id", "words"), "fuzzy-met")
    few = met.count() <= COUNTED
    return t.join(F.broadcast(met) if few else met, F.array_sort("t_words") == F.col("words")).join(q, "q_id").select("q_row.*", "t_row.*")


def words_of_none(queries: DataFrame, query: str) -> DataFrame:
    """Queries without a word: they fit every text."""
    return queries.filter(F.size(search_words(query)) == 0)
