"""Arrow batches of bounded size; batched UDFs whose type is a DDL text: built when first used, as parsing it needs a
session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let long texts make smaller Arrow batches: a session setting that changes no results. A smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    size = -1 if now.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def batch_udf(ddl: str):
    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, ddl)(*columns)

        return call

    return wrap
