"""Arrow helpers and column checks used by several operators; tables in the shared folder."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.batch import BATCH_BYTES, bounded_batches  # noqa: F401
from quillon.sources.shared import discard, materialize, shared_dir  # noqa: F401


def stable_splits(spark: SparkSession) -> None:
    """Fix the least number of a scan's splits, which otherwise follows the number of executors alive: rows that are
    told apart by their place in the scan keep it when an executor is lost. A session setting that changes no results."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def release() -> None:
    """Give memory that a finished task no longer uses back to the system: workers serve many tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, keeps_words: bool = False):
    """Batch function that releases its memory when its task ends. Workers serve tasks of several operators: those that
    don't tokenize drop the ids of words that earlier tasks have left (keeps_words: those that do, keep them)."""
    def call(batches):
        try:
            tokens = sys.modules.get("quillon.llm.tokens")
            if tokens and not keeps_words:
                tokens.forget()
            yield from run(batches)
        finally:
            release()

    return call


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so other columns (of any name) cannot clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pieces(batches, rows: int = 500):
    """Arrow batches in slices of few rows, so that long texts don't become Python objects all at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
