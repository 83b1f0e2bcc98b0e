"""Deduplication, ids without collisions, carried headers and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row of the smallest ordinal of every key. Partial aggregation: a hot key is reduced before the shuffle."""
    return df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(ordinal)).alias("x")).select("x.*")


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(ordinal)).alias("x")).select("x.*")


def best_wins(df: DataFrame, fingerprint: Sequence[Column], quality: Sequence[Column], ordinal: str) -> DataFrame:
    """The best row of every fingerprint (quality tuple, ties keep the first) with `position` = smallest ordinal of the
    group and n_merged."""
    keys = [c.alias(f"k{i}_") for i, c in enumerate(fingerprint)]
    order = F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)], (-F.col(ordinal)).alias("o"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("x"), F.min(ordinal).alias("position"), F.count("*").alias("n_merged")).select("x.*", "position", "n_merged")


def merge_arrays(df: DataFrame, key: str, ordinal: str, arrays: Sequence[str]) -> DataFrame:
    """One row per key: the first row's columns, its array columns joined with those of the key's other rows in order,
    without repeats."""
    rest = [c for c in df.columns if c not in arrays and c != key]
    merged = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(a).alias("a")))), lambda s: s["a"]))).alias(a) for a in arrays]
    return df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordinal).alias("x"), *merged).select(key, "x.*", *arrays)


def unique_ids(df: DataFrame, base: Column, extended: Column, stable_key: Column, name: str = "record_id") -> DataFrame:
    """df with an id: the base where it is unique; else the extended form; else that and eight hex digits of SHA-1.

    Passes over groups instead of one loop over rows, so the result doesn't depend on the order: an extended id counts
    as taken if another row has it as base or extended id. An id with a suffix that rows of another key have as well
    gets all 40 digits. Null bases and extended ids name nothing and never count as unique: such a row ends with its
    suffix alone. Every row stays; rows of one stable key (repeated rows) may share an id.
    """
    step = df.withColumn("b_", base).withColumn("e_", extended).withColumn("h_", F.sha1(F.coalesce(stable_key.cast("string"), F.lit(""))))
    n_base = step.groupBy(F.col("b_").alias("b2_")).agg(F.count("*").alias("n_"))
    step = step.join(n_base, F.col("b_").eqNullSafe(F.col("b2_"))).drop("b2_")
    own = (F.col("n_") == 1) & F.col("b_").isNotNull()
    step = step.withColumn("w_", F.when(own, F.col("b_")).otherwise(F.col("e_")))
    n_wanted = step.groupBy(F.col("w_").alias("w2_")).agg(F.count("*").alias("m_"))
    step = step.join(n_wanted, F.col("w_").eqNullSafe(F.col("w2_"))).drop("w2_")
    plain = own | ((F.col("m_") == 1) & F.col("w_").isNotNull())
    step = step.withColumn("p_", plain).withColumn("f_", F.when(plain, F.col("w_")).otherwise(F.concat_ws("-", "w_", F.substring("h_", 1, 8))))
    clash = step.groupBy(F.col("f_").alias("f2_")).agg((F.min("h_") != F.max("h_")).alias("c_"))
    step = step.join(clash, F.col("f_") == F.col("f2_"))
    return step.withColumn(name, F.when(F.col("c_") & ~F.col("p_"), F.concat_ws("-", "w_", "h_")).otherwise(F.col("f_"))).drop("b_", "e_", "h_", "n_", "m_", "w_", "p_", "f_", "f2_", "c_")


def carry_forward(df: DataFrame, partition: Sequence[str], ordinal: str, value: Column, name: str) -> DataFrame:
    """The last non-null value so far, in ordinal order: section headers for the lines below them."""
    w = W.partitionBy(*partition).orderBy(ordinal).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def without_runs(df: DataFrame, partition: Sequence[str], ordinal: str, column: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = W.partitionBy(*partition).orderBy(ordinal)
    return df.withColumn("p_", F.lag(column).over(w)).withColumn("n_", F.row_number().over(w)).filter((F.col("n_") == 1) | ~F.col(column).eqNullSafe(F.col("p_"))).drop("p_", "n_")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, least: int = 2) -> DataFrame:
    """max(least, int(n * share)) rows of every stratum in the order of md5(seed:key), then the first n overall.

    Per-stratum counts come from an aggregate; the rank window runs over the rows below a hash threshold that is
    generous for the wanted number, so a large stratum isn't sorted whole. What passes is counted: a stratum of which
    too few pass (one key on most rows, null keys, which come last) is ranked whole.
    """
    total = df.groupBy(stratum).agg(F.count("*").alias("c_"))
    share = total.crossJoin(F.broadcast(total.agg(F.sum("c_").alias("t_")))).withColumn("take_", F.greatest(F.lit(least), F.floor(F.lit(n) * F.col("c_") / F.col("t_")))).select(F.col(stratum).alias("s_"), "take_", "c_")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    cut = F.least(F.lit(1.0), (F.col("take_") * 4 + 64) / F.col("c_"))
    rows = df.withColumn("h_", h).join(share, F.col(stratum).eqNullSafe(F.col("s_")))
    rows = rows.withColumn("in_", F.coalesce(F.conv(F.substring("h_", 1, 8), 16, 10).cast("double") / 4294967296.0 <= cut, F.lit(False)))
    short = rows.groupBy(stratum).agg((F.count_if("in_") < F.max("take_")).alias("all_")).select(F.col(stratum).alias("z_"), "all_")
    rows = rows.join(short, F.col(stratum).eqNullSafe(F.col("z_"))).filter(F.col("in_") | F.col("all_"))
    w = W.partitionBy(stratum).orderBy(F.col("h_").asc_nulls_last(), key)
    picked = rows.withColumn("r_", F.row_number().over(w)).filter("r_ <= take_")
    return picked.orderBy(F.col(stratum).asc_nulls_first(), "r_").limit(n).drop("s_", "take_", "c_", "h_", "in_", "z_", "all_", "r_")
