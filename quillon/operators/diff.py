"""Snapshot diffs, reconciliation, watched metadata, file change tracking and review gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import row_hash
from quillon.operators.dedupe import last_wins


def without_fields(df: DataFrame, *volatile: str) -> DataFrame:
    """df without volatile columns at the top level and inside structs and arrays of structs."""
    from pyspark.sql import types as T

    def strip(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            keep = [f for f in kind.fields if f.name not in volatile]
            return F.when(c.isNotNull(), F.struct(*[strip(c[f.name], f.dataType).alias(f.name) for f in keep])) if keep else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: strip(x, kind.elementType))
        return c

    return df.select(*[strip(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in volatile])


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], ordinal: str | None = None, volatile: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """key columns, change_type (added / removed / changed / same) and label; the last of repeated keys counts.

    Rows shrink to key, label and a hash before the join, so payload columns aren't shuffled.
    """
    def slim(df, tag):
        if ordinal:
            df = last_wins(df, key, ordinal)
        columns = [c for c in df.columns if c not in (*volatile, ordinal)]
        named = F.col(label).cast("string") if label else F.lit(None).cast("string")
        return df.select(*[F.col(k).alias(f"{k}{tag}") for k in key], row_hash(*columns).alias(f"h{tag}"), named.alias(f"l{tag}"))

    a, b = slim(old, "_o"), slim(new, "_n")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"{k}_o") == F.col(f"{k}_n"))
    kind = F.when(F.col("h_o").isNull(), "added").when(F.col("h_n").isNull(), "removed").when(F.col("h_o") != F.col("h_n"), "changed").otherwise("same")
    out = a.join(b, on, "full_outer").select(*[F.coalesce(f"{k}_n", f"{k}_o").alias(k) for k in key], kind.alias("change_type"), F.coalesce("l_n", "l_o").alias("label"))
    return out if label else out.drop("label")


def reconcile(official: DataFrame, local: DataFrame, on: Mapping[str, Column]) -> DataFrame:
    """Keys that only one side has, with side = missing (official only) or extra (local only)."""
    a = official.select(*[c.alias(k) for k, c in on.items()]).distinct()
    b = local.select(*[c.alias(k) for k, c in on.items()]).distinct()
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("extra")))


def membership(local: DataFrame, active: DataFrame, on: Mapping[str, Column], name: str = "is_active") -> DataFrame:
    """local with a flag: its normalised key occurs in active."""
    b = active.select(*[c.alias(f"{k}__a") for k, c in on.items()]).distinct()
    cond = F.lit(True)
    for k, c in on.items():
        cond = cond & (c == F.col(f"{k}__a"))
    first = f"{next(iter(on))}__a"
    return local.join(b, cond, "left").withColumn(name, F.col(first).isNotNull()).select(*local.columns, name)


def compare_counts(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Counts by a column on both sides, 0 where a side has none, and the difference."""
    x, y = (d.groupBy(F.col(by).alias(f"k{t}")).agg(F.count("*").alias(f"n{t}")) for d, t in ((a, "a"), (b, "b")))
    return x.join(y, F.col("ka").eqNullSafe(F.col("kb")), "full_outer").select(F.coalesce("ka", "kb").alias(by), F.coalesce("na", F.lit(0)).alias("n_a"), F.coalesce("nb", F.lit(0)).alias("n_b"), (F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("gap"))


def corrected(old: DataFrame, new: DataFrame, key: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """One row: how many points were hidden and how many moved between two versions."""
    b = new.select(F.col(key).alias("k_"), F.col(lat).alias("a_"), F.col(lng).alias("o_"))
    both = old.join(b, F.col(key) == F.col("k_"))
    had, has = F.col(lat).isNotNull() & F.col(lng).isNotNull(), F.col("a_").isNotNull() & F.col("o_").isNotNull()
    return both.agg(F.count_if(had & ~has).alias("n_hidden"), F.count_if(had & has & ((F.col(lat) != F.col("a_")) | (F.col(lng) != F.col("o_")))).alias("n_moved"))


def watched_changes(old: DataFrame, new: DataFrame, paths: Sequence[str]) -> DataFrame:
    """(path, old_value, new_value) of watched dotted paths that differ between two one-row metadata tables."""
    def long(df, name):
        names = {f.name for f in df.schema.fields}
        value = lambda p: F.col(p).cast("string") if p.split(".")[0] in names else F.lit(None).cast("string")
        return df.select(F.inline(F.array(*[F.struct(F.lit(p).alias("path"), value(p).alias(name)) for p in paths])))

    return long(old, "old_value").join(long(new, "new_value"), "path").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def review_gate(current: DataFrame, reviewed: DataFrame, key: str, value: str) -> DataFrame:
    """current with needs_review and reason: its hash isn't the one that was reviewed last."""
    r = reviewed.select(F.col(key).alias("k_"), F.col(value).alias("v_"))
    out = current.join(r, F.col(key) == F.col("k_"), "left")
    reason = F.when(F.col("v_").isNull(), "never_reviewed").when(F.col(value) != F.col("v_"), "changed_since_review")
    return out.withColumn("reason", reason).withColumn("needs_review", reason.isNotNull()).drop("k_", "v_")


def track_files(state: DataFrame, listing: DataFrame, key: str, checked_at: Column) -> DataFrame:
    """New state (key, url, sha256, first_seen_at, last_seen_at, changed_at, status) from the old state and a listing
    (key, url, sha256): unseen files keep their state as "missing", a new hash moves changed_at."""
    o = state.select(F.col(key).alias("k_"), F.col("url").alias("u_"), F.col("sha256").alias("h_"), F.col("first_seen_at").alias("f_"), F.col("last_seen_at").alias("s_"), F.col("changed_at").alias("c_"))
    both = listing.join(o, F.col(key) == F.col("k_"), "full_outer")
    seen, known = F.col(key).isNotNull(), F.col("k_").isNotNull()
    moved = seen & known & ~F.col("sha256").eqNullSafe(F.col("h_"))
    return both.select(
        F.coalesce(key, "k_").alias(key),
        F.coalesce("url", "u_").alias("url"),
        F.coalesce("sha256", "h_").alias("sha256"),
        F.coalesce("f_", checked_at).alias("first_seen_at"),
        F.when(seen, checked_at).otherwise(F.col("s_")).alias("last_seen_at"),
        F.when(moved, checked_at).otherwise(F.col("c_")).alias("changed_at"),
        F.when(~seen, "missing").when(~known, "new").when(moved, "changed").otherwise("same").alias("status"),
    )


def source_metadata(df: DataFrame, *columns: str, mapped: Column, by: str) -> DataFrame:
    """One row: record and mapped counts, counts by a column as a map, and the digest of all rows."""
    from quillon.functions.numbers import table_digest

    counts = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias("by_" + by))
    return df.agg(F.count("*").alias("records"), F.count_if(mapped).alias("mapped")).crossJoin(counts).crossJoin(table_digest(df, *columns).select("digest"))
