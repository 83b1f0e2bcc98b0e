"""Readers of landed files: schema-first, tolerant of missing files and bad lines. Fetching is not a task's work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import match_text


def _schema(spark: SparkSession, schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path, in whatever store Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema, lines: bool = False) -> DataFrame:
    """JSON arrays or objects (or one object a line); an empty table if nothing is there; bad records in _corrupt."""
    kind = _schema(spark, schema)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    full = T.StructType(kind.fields + [T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def good_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt") if "_corrupt" in df.columns else df


def read_ndjson(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object a line, malformed lines dropped; a file that is one JSON array gives its elements."""
    kind = _schema(spark, schema)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if head is not None and head.c == "[":
        return good_records(read_json(spark, path, kind))
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def unwrap(df: DataFrame, *candidates: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records of an envelope: the elements of the first candidate array that isn't null, nulls dropped."""
    there = [c for c in candidates if c in df.columns]
    return df.select(*keep, F.explode(F.coalesce(*[F.col(c) for c in there])).alias("record")).filter(F.col("record").isNotNull()).select(*keep, "record.*")


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """A JSON object {key: value} as rows; value is a DDL type; a null value stays a row."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string, {value}>")
    return text.select(F.explode_outer(entries).alias(key, "entry")).filter(F.col(key).isNotNull())


def read_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """CSV with a header: columns by normalised header names (a byte-order mark is ignored), the first alias with a
    non-empty value wins; missing columns are null. Quoted fields may hold line breaks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    by = {plain(c): c for c in raw.columns}

    def value(names):
        there = [F.nullif(F.trim(F.col(f"`{by[plain(n)]}`")), F.lit("")) for n in names if plain(n) in by]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    return raw.select(*[value([out, *names]).alias(out) for out, names in aliases.items()])


#: Texts that switch a subscription off.
OFF = ("false", "no", "n", "0", "off", "disabled", "paused")


def enabled(column: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(column.cast("string"), F.lit("")))).isin(list(OFF))


def active_subscriptions(rows: DataFrame, email: str = "email", flag: str = "enabled") -> DataFrame:
    """Rows that are enabled and have an e-mail address."""
    return rows.filter(enabled(F.col(flag)) & F.coalesce(F.col(email), F.lit("")).contains("@"))


def read_pages(spark: SparkSession, pattern: str, schema, records: str) -> DataFrame:
    """Landed pages of a paged listing, read in one go: the records of all pages."""
    return unwrap(good_records(read_json(spark, pattern, schema)), records)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of a sitemap's urls."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).filter(F.col("loc").isNotNull())


def is_detail_url(url: Column, depth: int = 3, excluded: Sequence[str] = ()) -> Column:
    """URL path of exactly `depth` parts, none of them excluded."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    return (F.size(parts) == depth) & ~F.exists(parts, lambda p: p.isin(list(excluded)) if excluded else F.lit(False))


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of whole text files, e.g. text extracted from PDFs or rendered pages."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def valid_pdfs(spark: SparkSession, pattern: str, least: int = 1024) -> DataFrame:
    """(path, bytes, is_valid): files with the PDF mark and a least size; contents aren't kept."""
    df = spark.read.format("binaryFile").load(pattern)
    return df.select("path", F.col("length").alias("bytes"), ((F.col("length") >= least) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))).alias("is_valid"))


def read_assets(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(asset, created) entries of a listing object whose names match a pattern."""
    return read_keyed(spark, path, "struct<created: string, url: string>", "asset").filter(F.col("asset").rlike(name)).select("asset", "entry.*")


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A snapshot=... partition of a versioned table: the named one or the latest."""
    df = spark.read.parquet(root)
    if version is None:
        version = df.agg(F.max(F.col("snapshot").cast("string"))).first()[0]
    return df.filter(F.col("snapshot").cast("string") == version).drop("snapshot")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of tables with different columns; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


class Catalog:
    """Tables registered on first use: route -> the tables it needs."""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, object], routes: Mapping[str, Sequence[str]]):
        self.spark, self.loaders, self.routes, self.loaded = spark, loaders, routes, {}

    def table(self, name: str) -> DataFrame:
        if name not in self.loaded:
            self.loaded[name] = self.loaders[name](self.spark)
            self.loaded[name].createOrReplaceTempView(name)
        return self.loaded[name]

    def route(self, name: str) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in self.routes[name]}


def normalised_key(column) -> Column:
    return match_text(column, "")
