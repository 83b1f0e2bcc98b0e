"""Similarity join of names or addresses: rare-first postings, length, position and count bounds, one verification a pair.

Two texts are similar if they have enough words in common, if one contains the other, or if their matching blocks make
up enough of both (the ratio of difflib). Each of the three ways has postings of its own that lose no such pair:

* words: of two texts with k common words, the words of either without its k - 1 most frequent ones have one in common;
* ratio: with L letters in both and 2 M of them in matching blocks, at most L - 2 M letters part the blocks, so of the
  letter pairs of both texts (with marks at the ends, repeats told apart) at least 3 M - L + 1 are common. For ratios
  under 2 / 3 that bound is void, and the letters themselves are counted: M are common;
* containment: the rarest letter triple of the contained text is one of the other's triples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import shorten_address, similarity
from quillon.operators.match import expand_pairs
from quillon.sources.shared import discard, materialize

_START, _END = "\u0002", "\u0003"


@dataclass(frozen=True)
class Similar:
    """Rows of one side with equal block and text are a class; ways, words and ratios are found once for two classes.

    pairs: columns of both sides, common (words) and ratio, of all rows; links: (left_class, right_class, n, common,
    ratio), the same pairs as pairs of classes, n of rows each; left, right: the rows with their class_; candidates:
    (left_row, right_row: classes, n, words, part, near), the ways in which a pair was proposed; blocks: rows of both
    sides by block."""

    pairs: DataFrame
    links: DataFrame
    left: DataFrame
    right: DataFrame
    candidates: DataFrame
    blocks: DataFrame

    def report(self) -> DataFrame:
        """One row: possible (pairs of rows that agree on the block), candidates, verified (those that only their ratio
        could decide) and matched, all in pairs of rows."""
        one = lambda df, name, c: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias(name))
        possible = one(self.blocks, "possible", F.sum(F.col("l").cast("decimal(38,0)") * F.col("r")))
        undecided = F.when(~F.col("words") & ~F.col("part"), F.col("n")).otherwise(0)
        decided = self.candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(undecided), F.lit(0)).alias("verified"))
        out = possible.withColumn("one_", F.lit(1))
        for x in (decided, one(self.links, "matched", F.sum("n"))):
            out = out.join(x.withColumn("one_", F.lit(1)), "one_")
        return out.drop("one_")


def common_needed(letters, ratio: float) -> Column:
    """Common letter pairs (or letters, see the module) that texts of so many letters together have at that ratio."""
    m = F.ceil(F.lit(ratio / 2) * letters - F.lit(1e-9))
    return 3 * m - letters + 1 if ratio >= 2 / 3 else m


def _least_needed(n: Column, ratio: float) -> Column:
    """Lower bound of common_needed over all partners of a text of n letters: none has under n * ratio / (2 - ratio)."""
    share = 2 / (2 - ratio) * ((1.5 * ratio - 1) if ratio >= 2 / 3 else ratio / 2)
    return F.greatest(F.ceil(F.lit(share) * n + F.lit((1 if ratio >= 2 / 3 else 0) - 1e-9)), F.lit(1)).cast("int")


def _grams(t: Column, n: Column, q: int) -> Column:
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: t.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _counted(values: Column) -> Column:
    """Values with their occurrence number, so that a set of them counts as the values do with repeats."""
    s = F.array_sort(values)
    return F.transform(s, lambda x, i: F.concat(x, F.lit("#"), (i + 2 - F.array_position(s, x)).cast("string")))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(tag), x))


def _side(df: DataFrame, side: int, keys: Sequence[str], text: str, normal: Callable) -> DataFrame:
    t = normal(F.col(f"`{text}`"))
    return df.select(F.lit(side).alias("side"), F.monotonically_increasing_id().alias("id"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], t.alias("t"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _ranked(rows: DataFrame, keys: list[str], ratio: float | None, short: bool) -> DataFrame:
    """rows (side, id, keys, t) with n and, rarest in the block first, words, grams (for the ratio) and parts (for
    containment). Frequencies are counted over both sides of a block."""
    t, n = F.col("t"), F.length("t")
    kinds = [_tagged("w", F.filter(F.array_distinct(F.split(t, " ")), lambda x: x != ""))]
    if ratio is not None:
        marked = F.concat(F.lit(_START), t, F.lit(_END))
        kinds += [_tagged("g", _counted(_grams(marked, n + 2, 2) if ratio >= 2 / 3 else _grams(t, n, 1)))]
        kinds += [_tagged("p", F.array_distinct(_grams(t, n, q))) for q in ((1, 2, 3) if short else (3,))]
    seen = rows.select("side", "id", *keys, F.explode(F.concat(*kinds)).alias("f"))
    often = seen.groupBy(*keys, "f").agg(F.count("*").alias("df"))
    met = seen.join(often, [*keys, "f"]).groupBy(F.col("side").alias("s_"), F.col("id").alias("i_")).agg(F.array_sort(F.collect_list(F.struct("df", "f"))).alias("all"))
    own = lambda tag: F.transform(F.filter("all", lambda x: x["f"].startswith(tag)), lambda x: x["f"])
    return rows.join(met, (F.col("side") == F.col("s_")) & (F.col("id") == F.col("i_"))).select("side", "id", *keys, "t", n.alias("n"), own("w").alias("words"), own("g").alias("grams"), own("p").alias("parts"))


def _meet(table: DataFrame, keys: list[str], posted: Column, *carry: str) -> DataFrame:
    """Pairs (l_*, r_*) of the two sides at the first of their common postings."""
    sides = []
    for side, tag in ((0, "l_"), (1, "r_")):
        own = table.filter(F.col("side") == side).withColumn("posted", posted)
        sides.append(own.select(*[F.col(k).alias(tag + k) for k in keys], F.col("id").alias(tag + "id"), F.col("posted").alias(tag + "posted"), *[F.col(c).alias(tag + c) for c in carry], F.posexplode("posted").alias(tag + "at", tag + "f")))
    on = F.col("l_f") == F.col("r_f")
    for k in keys:
        on = on & (F.col("l_" + k) == F.col("r_" + k))
    return sides[0].join(sides[1], on).filter(F.col("l_f") == F.element_at(F.array_intersect("l_posted", "r_posted"), 1))


def similar_pairs(left: DataFrame, right: DataFrame, block: Sequence[tuple[str, str]], text: tuple[str, str], tokens: int = 2, ratio: float | None = 0.72, normal: Callable = shorten_address) -> Similar:
    """All pairs that agree on the block columns and have `tokens` common words, or one text in the other, or a ratio
    of at least `ratio` (None: words only), as names_match and addresses_match decide pair by pair.

    Texts are compared after `normal`; empty ones match nothing, and a null in a block column neither. Repeated rows
    are rows of their own; columns of the two sides keep their names, which have to differ. A word, pair or triple of
    letters that most texts have is among the postings of no text that has rarer ones enough.
    """
    keys = [f"k{i}" for i in range(len(block))]
    sides = [_side(df, i, [b[i] for b in block], text[i], normal) for i, df in enumerate((left, right))]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    stored = [materialize(s.filter((F.col("t") != "") & known), "similar-rows") for s in sides]
    classes = [materialize(s.groupBy("side", *keys, "t").agg(F.count("*").alias("rows_")).withColumn("id", F.monotonically_increasing_id()), "similar-classes") for s in stored]
    columns = ["side", "id", *keys, "t"]
    rows = classes[0].select(*columns).unionAll(classes[1].select(*columns))
    short = ratio is not None and rows.filter(F.length("t") < 3).limit(1).count() > 0
    table = materialize(_ranked(rows, keys, ratio, short), "similar-ranked")

    prefix = F.when(F.size("words") >= tokens, F.slice("words", F.lit(1), F.size("words") - F.lit(tokens - 1))).otherwise(F.array().cast("array<string>"))
    shared = F.size(F.array_intersect("l_words", "r_words"))
    ways = [_meet(table, keys, prefix, "words").filter(shared >= tokens).select("l_id", "r_id", F.lit("words").alias("way"))]
    if ratio is not None:
        letters = F.col("l_n") + F.col("r_n")
        needed = common_needed(letters, ratio)
        size = F.size("grams")
        prefix = F.slice("grams", F.lit(1), F.greatest(size - _least_needed(F.col("n"), ratio) + 1, F.lit(0)))
        met = _meet(table, keys, prefix, "grams", "n").filter(2 * F.least("l_n", "r_n") >= F.lit(ratio) * letters - F.lit(1e-9))
        left_over = F.least(F.size("l_grams") - F.col("l_at"), F.size("r_grams") - F.col("r_at"))
        near = met.filter(left_over >= needed).filter(F.size(F.array_intersect("l_grams", "r_grams")) >= needed)
        ways.append(near.select("l_id", "r_id", F.lit("near").alias("way")))
        ways += [_contained(table, keys, side) for side in (0, 1)]
    proposed = ways[0]
    for w in ways[1:]:
        proposed = proposed.unionAll(w)
    flag = lambda w: F.max(F.col("way") == w)
    met = proposed.groupBy(F.col("l_id").alias("left_row"), F.col("r_id").alias("right_row")).agg(flag("words").alias("words"), flag("part").alias("part"), flag("near").alias("near"))
    a, b = (c.select(*[F.col(x).alias(tag + x) for x in ("id", *keys, "t", "rows_")]) for c, tag in zip(classes, ("l_", "r_")))
    of = lambda df: df.join(a, F.col("left_row") == F.col("l_id")).join(b, F.col("right_row") == F.col("r_id"))
    candidates = materialize(of(met).select("left_row", "right_row", (F.col("l_rows_") * F.col("r_rows_")).alias("n"), "words", "part", "near"), "similar-candidates")

    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda x: x != "")
    both = of(candidates).withColumn("common", F.size(F.array_intersect(words("l_t"), words("r_t")))).withColumn("ratio", similarity("l_t", "r_t") if ratio is not None else F.lit(None).cast("double"))
    kept = both.filter(F.col("words") | F.col("part") | (F.col("ratio") >= (2.0 if ratio is None else ratio)))
    near, far = [[tag + x for x in (*keys, "t")] for tag in ("l_", "r_")]
    own, others = (s.select(*[F.col(x).alias(tag + x) for x in (*keys, "t")], F.col("id").alias(tag + "row_id"), F.col("row").alias(tag + "row")) for s, tag in zip(stored, ("l_", "r_")))
    pairs = expand_pairs(own.select(*near, "l_row").join(kept, near).select("l_row", *far, F.col("r_rows_").alias("n_"), "common", "ratio"), others, far, "r_row_id")
    members = [o.join(c, on).select(F.col(tag + "id").alias("class_"), F.col(tag + "row.*")) for o, c, on, tag in ((own, a, near, "l_"), (others, b, far, "r_"))]
    blocks = stored[0].select("side", *keys).unionAll(stored[1].select("side", *keys)).groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    discard(table)
    links = kept.select(F.col("left_row").alias("left_class"), F.col("right_row").alias("right_class"), "n", "common", "ratio")
    return Similar(pairs.select("l_row.*", "r_row.*", "common", "ratio"), links, *members, candidates, blocks)


def _contained(table: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Pairs in which the text of `side` is part of the other: its rarest triple of letters (all of it, if shorter)
    meets all triples of the others, and the texts decide."""
    own = table.filter(F.col("side") == side)
    size = F.least(F.col("n"), F.lit(3)) + 1  # with its tag
    probe = own.select(*[F.col(k).alias("p_" + k) for k in keys], F.col("id").alias("p_id"), F.col("t").alias("p_t"), F.element_at(F.filter("parts", lambda x: F.length(x) == size), 1).alias("f"))
    index = table.filter(F.col("side") != side).select(*keys, "id", "t", F.explode("parts").alias("f_"))
    on = (F.col("f") == F.col("f_")) & F.col("t").contains(F.col("p_t"))
    for k in keys:
        on = on & (F.col(k) == F.col("p_" + k))
    ids = ("p_id", "id") if side == 0 else ("id", "p_id")
    return probe.join(index, on).select(F.col(ids[0]).alias("l_id"), F.col(ids[1]).alias("r_id"), F.lit("part").alias("way"))
