"""Lookup joins: side tables with fallback keys, overrides, fills, fan-outs, aliases, cascades and caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import _c, match_text


def with_rating(records: DataFrame, ratings: DataFrame, id_col: str, alias: Column | None = None, key: str = "id", rating: str = "rating", reviews: str = "review_count") -> DataFrame:
    """records with rating, review_count and has_rating of their id; a missing entry is looked up by the alias id,
    and a null review count is patched from the alias entry. ratings has one row per key. Spark broadcasts it if its
    size allows."""
    r = ratings.select(F.col(key).alias("k1_"), F.struct(rating, reviews).alias("r1_"))
    out = records.join(r, F.col(id_col) == F.col("k1_"), "left")
    first, second = F.col("r1_"), F.lit(None)
    if alias is not None:
        b = ratings.select(F.col(key).alias("k2_"), F.struct(rating, reviews).alias("r2_"))
        out = out.join(b, alias == F.col("k2_"), "left")
        second = F.col("r2_")
    found = F.coalesce(first, second) if alias is not None else first
    patched = F.coalesce(found[reviews], second[reviews]) if alias is not None else found[reviews]
    return out.withColumns({"rating": found[rating], "review_count": patched, "has_rating": found.isNotNull()}).drop("k1_", "k2_", "r1_", "r2_")


def with_signals(records: DataFrame, signals: DataFrame, id_col: str, key: str = "id", column: str = "signals", allow: Sequence[str] | None = None) -> DataFrame:
    """records with a map column of their signals (empty if none), entries limited to allowed names, null and ""
    dropped."""
    s = signals.select(F.col(key).alias("k_"), F.col(column).alias("s_"))
    out = records.join(s, F.col(id_col) == F.col("k_"), "left")
    kept = F.map_filter(F.coalesce(F.col("s_"), F.map_from_arrays(F.array(), F.array()).cast(signals.schema[column].dataType)), lambda k, v: v.isNotNull() & (v.cast("string") != "") & (k.isin(list(allow)) if allow else F.lit(True)))
    return out.withColumn(column, kept).drop("k_", "s_")


def override(records: DataFrame, overrides: DataFrame, id_col: str, columns: Sequence[str], key: str = "id", guards: Mapping[str, str] | None = None) -> DataFrame:
    """records with the overrides' non-null values of `columns`; guards {record column: override column}: the
    normalised record text has to contain the normalised expected text where that isn't null."""
    o = overrides.select(F.col(key).alias("k_"), *[F.col(c).alias(f"{c}__o") for c in columns], *[F.col(g).alias(f"{g}__g") for g in (guards or {}).values()])
    on = F.col(id_col) == F.col("k_")
    for mine, theirs in (guards or {}).items():
        on = on & (F.col(f"{theirs}__g").isNull() | match_text(mine).contains(match_text(f"{theirs}__g")))
    out = records.join(o, on, "left")
    return out.withColumns({c: F.coalesce(F.col(f"{c}__o"), F.col(c)) for c in columns} | {"overridden": F.col("k_").isNotNull()}).select(*records.columns, "overridden")


def fill_from(new: DataFrame, old: DataFrame, key: str, columns: Sequence[str], guard: Column | None = None) -> DataFrame:
    """new with missing (null or "") values of `columns` taken from old, where the guard on old's row holds."""
    o = old.select(F.col(key).alias("k_"), *[F.col(c).alias(f"{c}__o") for c in columns], (guard if guard is not None else F.lit(True)).alias("g_"))
    out = new.join(o, F.col(key) == F.col("k_"), "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return out.withColumns({c: F.when(empty(c) & F.col("g_"), F.col(f"{c}__o")).otherwise(F.col(c)) for c in columns}).select(*new.columns)


def fan_out(rows: DataFrame, results: DataFrame, on: Mapping[str, str], how: str = "inner") -> DataFrame:
    """rows with the result of their normalised key; many rows may share one. on: {row column: result column}."""
    r = results.withColumns({f"f{i}_": match_text(c) for i, c in enumerate(on.values())}).drop(*on.values())
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & (match_text(c) == F.col(f"f{i}_"))
    return rows.join(r, cond, how).drop(*[f"f{i}_" for i in range(len(on))])


def once_per_key(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """Work list: the first row of each non-empty key, with how many rows share it."""
    return rows.withColumn("work_key", key).filter(F.col("work_key").isNotNull() & (F.col("work_key") != "")).groupBy("work_key").agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), ordinal).alias("x"), F.count("*").alias("n_sharing")).select("work_key", "n_sharing", "x.*")


def not_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def echo_id(text, mark: str = "#!#") -> Column:
    """Id that was put behind a mark in a query text and came back with the result; null if there is none."""
    return F.nullif(F.trim(F.get(F.split(_c(text), mark, 2), F.lit(1))), F.lit(""))


def alias_table(dimension: DataFrame, id_col: str, *names: str, ordinal: str | None = None) -> DataFrame:
    """(alias, id): every normalised name of every member; of equal aliases the last member's wins."""
    order = F.col(ordinal) if ordinal else F.col(id_col)
    rows = dimension.select(F.col(id_col).alias("id"), order.alias("o"), F.posexplode(F.array(*[match_text(F.col(n).cast("string"), "") for n in names])).alias("p", "alias")).filter("alias <> ''")
    return rows.groupBy("alias").agg(F.max_by("id", F.struct("o", "p")).alias("id"))


def resolve_aliases(rows: DataFrame, names: str, aliases: DataFrame, key: str, out: str = "resolved") -> DataFrame:
    """rows with the sorted distinct ids of an array of names; unknown names stay as written."""
    parts = rows.select(F.col(key).alias("k_"), F.explode(names).alias("raw")).withColumn("alias", match_text("raw", ""))
    found = parts.join(aliases, "alias", "left").groupBy("k_").agg(F.array_sort(F.collect_set(F.coalesce(F.col("id").cast("string"), F.col("raw")))).alias(out))
    return rows.join(found, F.col(key) == F.col("k_"), "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("k_")


def _name_keys(name: Column) -> Column:
    """struct(key, tier) of a name, best tier first: whole, without a leading "the", first two words, first word."""
    words = F.filter(F.split(match_text(name), " "), lambda w: w != "")
    bare = F.when((F.size(words) > 1) & (F.element_at(words, 1) == "the"), F.slice(words, 2, F.size(words))).otherwise(words)
    join = lambda a: F.array_join(a, "")
    tiers = [join(words), join(bare), F.when(F.size(bare) >= 2, join(F.slice(bare, 1, 2))), join(F.slice(bare, 1, 1))]
    return F.filter(F.array(*[F.struct(t.alias("key"), F.lit(i).alias("tier")) for i, t in enumerate(tiers)]), lambda s: s["key"].isNotNull() & (s["key"] != ""))


def cascade_match(names: DataFrame, name: str, candidates: DataFrame, candidate: str, key: str) -> DataFrame:
    """(key, candidate, tier): the best candidate whose normalised name equals one of the name's keys (tiers 0-3), or
    that contains or is contained in the name where they share a token (tier 4); ties: the smallest candidate.

    Equal keys and tokens are equi-joins; names are never paired with all candidates.
    """
    c = candidates.select(F.col(candidate).alias("cand")).distinct().withColumn("ckey", match_text("cand", ""))
    n = names.select(F.col(key).alias("k"), F.col(name).alias("nm"))
    exact = n.select("k", F.inline(_name_keys(F.col("nm")))).join(c, F.col("key") == F.col("ckey")).select("k", "cand", "tier")
    tok = lambda x: F.explode(F.array_distinct(F.filter(F.split(match_text(x), " "), lambda w: w != "")))
    shared = n.withColumn("w", tok("nm")).join(c.withColumn("w", tok("cand")), "w").withColumn("nkey", match_text("nm", ""))
    inside = shared.filter((F.col("nkey") != "") & (F.col("ckey") != "") & (F.col("nkey").contains(F.col("ckey")) | F.col("ckey").contains(F.col("nkey")))).select("k", "cand", F.lit(4).alias("tier"))
    best = exact.unionByName(inside).groupBy("k").agg(F.min(F.struct("tier", "cand")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.cand").alias("candidate"), F.col("b.tier").alias("tier"))


def first_match(left: DataFrame, right: DataFrame, on: Column, accept: Column, key: str, ordinal: str, *columns: str) -> DataFrame:
    """left with the columns of the first right row (by ordinal) that joins and is accepted; null if none."""
    pairs = left.join(right, on).filter(accept).groupBy(key).agg(F.min_by(F.struct(*columns), ordinal).alias("m_")).select(F.col(key).alias("k_"), "m_.*")
    return left.join(pairs, F.col(key) == F.col("k_"), "left").drop("k_")


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, *columns: str, group: str | None = None) -> DataFrame:
    """i-th right row to the i-th left row, within groups; rows without a partner get nulls. Without a group,
    positions come from counts of value ranges, not from one task."""
    if group is None:
        from quillon.operators.facets import positions

        a = positions(left, left_order, "i_")
        b = positions(right, right_order, "j_").select("j_", *columns)
        return a.join(b, F.col("i_") == F.col("j_"), "left").drop("i_", "j_")
    a = left.withColumn("i_", F.row_number().over(W.partitionBy(group).orderBy(left_order)))
    b = right.select(F.col(group).alias("g_"), F.row_number().over(W.partitionBy(group).orderBy(right_order)).alias("j_"), *columns)
    return a.join(b, (F.col("i_") == F.col("j_")) & F.col(group).eqNullSafe(F.col("g_")), "left").drop("i_", "j_", "g_")


def read_through(keys: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """keys with the cached value and hit: a cached null is a hit, a missing key is none."""
    c = cache.select(F.col(key).alias("k_"), F.col(value), F.lit(True).alias("hit"))
    return keys.join(c, F.col(key) == F.col("k_"), "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("k_")


def is_fresh(status, searched_on, today: Column, days: int = 90) -> Column:
    """Found entries stay fresh, errors never are, entries without a result for `days` days."""
    return F.when(_c(status) == "found", True).when(_c(status) == "error", False).otherwise(F.coalesce(F.date_diff(today, _c(searched_on)) < days, F.lit(False)))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All primary rows, and the fallback's for keys that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def selection(df: DataFrame, order: str, offset: int = 0, limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows of an id list, or a stretch in the order of a unique column."""
    rows = df.join(ids.select(order), order, "left_semi") if ids is not None else df
    rows = rows.orderBy(order).offset(offset)
    return rows.limit(limit) if limit is not None else rows


def merge_write(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones: what a store holds after the merge."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def expand_groups(df: DataFrame, is_group: Column, children: str, parent: str) -> DataFrame:
    """A group's visible children instead of the group itself; children is an array of the row's struct type."""
    return df.withColumn("member", F.explode(F.when(is_group, F.col(children)).otherwise(F.array(F.col(parent)))))
