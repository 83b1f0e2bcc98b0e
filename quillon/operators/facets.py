"""Faceted filters, distinct options, rankings and pages: the explorer's query as one declarative plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import _c, fuzzy_match
from quillon.operators.lookup import with_rating
from quillon.sources.shared import materialize


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def equals(column, value) -> Column | None:
    """Facet by equality; an empty value is no filter."""
    return None if value in (None, "") else _c(column) == F.lit(value)


def contains(column, value) -> Column | None:
    """Facet on an array column."""
    return None if value in (None, "") else F.array_contains(_c(column), value)


def at_least(value: float | None, *columns) -> Column | None:
    """Facet by a threshold on the first non-null column; null never passes."""
    return None if value is None else F.coalesce(F.coalesce(*[_c(c) for c in columns]) >= value, F.lit(False))


def one_of(column, value, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column | None:
    """Facet by an enum value that may stand for several."""
    return None if value in (None, "") else _c(column).isin(list((synonyms or {}).get(value, [value])))


def yes_no(column, value: str | None) -> Column | None:
    """Three-valued flag: "yes" keeps true, "no" keeps false and null."""
    flag = F.coalesce(_c(column), F.lit(False))
    return None if value in (None, "") else flag if value == "yes" else ~flag


def quick_search(query: str, *columns) -> Column | None:
    """Substring of any column (arrays joined), ignoring case."""
    q = (query or "").strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.concat_ws(" ", _c(c))).contains(q), F.lit(False)) for c in columns]) if q else None


def facet_filter(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows that pass every facet in use. Cheap facets first: Spark keeps this order within one filter."""
    return df.filter(all_of([p for p in predicates if p is not None]))


def active_count(*values) -> int:
    """How many facet values are in use."""
    return sum(v not in (None, "", [], False) for v in values)


def options(df: DataFrame, column: str, *predicates: Column | None, collate: str | None = None) -> DataFrame:
    """Distinct non-empty values of a facet (arrays exploded) under the other facets, sorted."""
    rows = facet_filter(df, *predicates)
    value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    found = rows.select(value.alias("value")).filter("value is not null and cast(value as string) <> ''").distinct()
    return found.orderBy(F.collate("value", collate) if collate else F.col("value"))


def ranked(df: DataFrame, *keys: tuple[str, object], ties: Sequence[str] = ()) -> DataFrame:
    """Descending by (column, value for null) keys, then by the tie columns: a total order where they are unique."""
    return df.orderBy(*[F.coalesce(_c(c), F.lit(missing)).desc() for c, missing in keys], *[F.col(t).asc_nulls_first() for t in ties])


def page(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """The first number * size rows of an ordered table (a top-k plan, no full sort)."""
    return df.limit(number * size)


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with every row's position from 0 in the order of a unique column.

    Positions come from counts of value ranges, so there is no window over the whole table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, order).withColumn("p_", F.spark_partition_id()), "batches")  # ranges differ from run to run
    counts = sorted((r.p_, r.n) for r in ranged.groupBy("p_").agg(F.count("*").alias("n")).collect())  # a row a range
    starts, before = [], 0
    for p, k in counts:
        starts.append((p, before))
        before += k
    small = spark.createDataFrame(starts, "q_ int, s_ long")
    local = ranged.withColumn("r_", F.expr(f"row_number() over (partition by p_ order by `{order}`)"))
    return local.join(F.broadcast(small), F.col("p_") == F.col("q_")).withColumn(name, F.col("s_") + F.col("r_") - 1).drop("p_", "q_", "s_", "r_")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with batch_no = position div size in the order of a unique column."""
    return positions(df, order, "i_").withColumn("batch_no", F.floor(F.col("i_") / size)).drop("i_")


def overview(df: DataFrame, counts: Mapping[str, Column], distinct: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """One row: n_rows, conditional counts and exact distinct counts."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in counts.items()], *[F.countDistinct(c).alias(k) for k, c in distinct.items()])


def counts_by(df: DataFrame, *by: str, **conditions: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """One row: how many non-empty values occur twice or more."""
    return df.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(column).count().filter("count >= 2").agg(F.count("*").alias("n_repeated"))


@dataclass(frozen=True)
class ExplorerQuery:
    """A page of records: scope and facets, lookup of ratings only when a facet or the order needs them, ranking.

    id_col is unique and breaks ties; lookup_col (else id_col) is the key of the ratings.
    """

    id_col: str
    lookup_col: str = ""
    scope: Column | None = None
    facets: Sequence[Column | None] = ()
    search: str = ""
    search_col: str | None = None
    alias_col: Column | None = None
    min_rating: float | None = None
    has_rating: bool = False
    sort: Sequence[tuple[str, object]] = ()
    pages: int = 1
    size: int = 50
    columns: Sequence[str] = field(default_factory=list)

    def needs_ratings(self) -> bool:
        return self.min_rating is not None or self.has_rating or any(c in ("rating", "review_count") for c, _ in self.sort)

    def build(self, records: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
        rows = facet_filter(records, self.scope, *self.facets)
        if ratings is not None and self.needs_ratings():
            rows = with_rating(rows, ratings, self.lookup_col or self.id_col, self.alias_col)
            rows = facet_filter(rows, at_least(self.min_rating, "rating"), F.col("has_rating") if self.has_rating else None)
        if self.search and self.search_col:
            rows = rows.filter(fuzzy_match(self.search_col, self.search))
        rows = page(ranked(rows, *self.sort, ties=[self.id_col]), self.pages, self.size)
        return rows.select(*self.columns) if self.columns else rows
