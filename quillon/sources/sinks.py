"""Writers: JSON, GeoJSON, KML, Markdown reports, append-only change logs and message rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import html_escape
from quillon.operators.lookup import merge_write


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """Overwrite through Spark's commit protocol; single=True for outputs known to be tiny."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merge_parquet(new: DataFrame, key: str, old_path: str, out_path: str) -> None:
    """Write the old table overlaid with new rows to another folder."""
    merge_write(new.sparkSession.read.parquet(old_path), new, key).write.mode("overwrite").parquet(out_path)


def geo_features(df: DataFrame, lat: str, lng: str, *properties: str) -> DataFrame:
    """One GeoJSON feature a mapped row: longitude before latitude; rows without a point are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lng).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(*properties, F.to_json(feature).alias("feature"))


def geo_collection(features: DataFrame, order: str) -> DataFrame:
    """One row: a FeatureCollection, for sets of features known to fit in a row (a map layer)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda s: s["feature"]), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("json"))


def kml_placemark(name, lat, lng, *lines) -> Column:
    """KML placemark text; description lines that are null or empty are left out."""
    text = F.concat_ws("&lt;br/&gt;", *[F.nullif(html_escape(x), F.lit("")) for x in lines])
    return F.concat(F.lit("<Placemark><name>"), html_escape(name), F.lit("</name><description>"), text, F.lit("</description><Point><coordinates>"), F.col(lng).cast("double").cast("string"), F.lit(","), F.col(lat).cast("double").cast("string"), F.lit(",0</coordinates></Point></Placemark>"))


KML_HEAD, KML_TAIL = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>', "</Document></kml>"


def kml_documents(df: DataFrame, group: str, order: str, placemark: Column) -> DataFrame:
    """(group, kml): a document per group."""
    rows = df.select(F.col(group).alias("group"), F.col(order).alias("o"), placemark.alias("p"))
    return rows.groupBy("group").agg(F.concat(F.lit(KML_HEAD), html_escape(F.first("group")), F.lit("</name>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]), ""), F.lit(KML_TAIL)).alias("kml"))


def write_texts(df: DataFrame, text: str, path: str, by: str | None = None) -> None:
    out = df.select(*([by] if by else []), F.col(text).cast("string").alias("value"))
    (out.write.mode("overwrite").partitionBy(by) if by else out.write.mode("overwrite")).text(path)


def head_and_more(items: Column, limit: int) -> Column:
    """First items, and how many more there are."""
    more = F.size(items) - limit
    return F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" … and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def change_report(diff: DataFrame, label: str = "label", limit: int = 20) -> DataFrame:
    """(change_type, n, line) per kind of change: the first labels in order and how many more.

    Labels are cut to the shown ones before they are gathered.
    """
    from pyspark.sql import Window as W

    counts = diff.filter("change_type <> 'same'").groupBy("change_type").agg(F.count("*").alias("n"))
    first = diff.filter("change_type <> 'same'").withColumn("r_", F.row_number().over(W.partitionBy("change_type").orderBy(label))).filter(F.col("r_") <= limit)
    shown = first.groupBy("change_type").agg(F.array_sort(F.collect_list(label)).alias("x"))
    more = F.when(F.col("n") > limit, F.concat(F.lit(" … and "), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return counts.join(shown, "change_type").select("change_type", "n", F.concat(F.lit("- "), F.col("change_type"), F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("x", ", "), more).alias("line"))


def has_changes(report: DataFrame) -> bool:
    """Flag for a scheduler."""
    return not report.isEmpty()


def append_changelog(diff: DataFrame, path: str, program: str, day: str, kinds: Sequence[str] = ("added", "removed"), limit: int = 50) -> None:
    """Append added and removed labels, at most `limit` of each kind, to a Parquet log partitioned by program."""
    from pyspark.sql import Window as W

    w = W.partitionBy("change_type").orderBy("label")
    rows = diff.filter(F.col("change_type").isin(list(kinds))).withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= limit).drop("r_")
    rows.select(F.lit(program).alias("program"), F.lit(day).cast("date").alias("day"), "change_type", "label").write.mode("append").partitionBy("program").parquet(path)


def messages(events: DataFrame, subject: Column, body: Column, to: str = "email") -> DataFrame:
    """Message rows for a mail gateway: to, subject, body and a stable id; sending is the gateway's work."""
    return events.select(F.sha2(F.concat_ws("|", to, subject, body), 256).alias("message_id"), F.col(to).alias("recipient"), subject.alias("subject"), body.alias("body"))
