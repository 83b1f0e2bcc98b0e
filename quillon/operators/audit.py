"""Data-quality audits: coordinates, provenance, official rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import in_boxes


def coordinate_audit(df: DataFrame, boxes: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """One row per key value: rows, mapped, missing, outside the key's box."""
    flagged = in_boxes(df, boxes, key, lat, lng)
    has = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    return flagged.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(has).alias("n_mapped"), F.count_if(~has).alias("n_missing"), F.count_if(has & ~F.col("in_box")).alias("n_outside"))


def provenance_audit(df: DataFrame, column: str, forbidden: str, by: str) -> DataFrame:
    """Rows per group whose text carries a forbidden provenance mark."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col(column).rlike(forbidden), F.lit(False))).alias("n_marked"))
