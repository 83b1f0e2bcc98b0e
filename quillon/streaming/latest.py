"""Latest state per key from polls, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import discard, materialize


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, ordinal: str, ok: Column | None = None) -> DataFrame:
    """The latest successful row of every key (ties: the larger ordinal); keys that only failed keep their latest row."""
    good = F.coalesce(ok, F.lit(False)).cast("int") if ok is not None else F.lit(1)
    order = F.struct(good.alias("g"), F.col(at).alias("t"), F.col(ordinal).alias("o"))
    return df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("x")).select("x.*")


def upsert(state: DataFrame, update: DataFrame, keys: Sequence[str], at: str, ordinal: str) -> DataFrame:
    """State after an update: the later row of every key."""
    return latest_per_key(state.unionByName(update, allowMissingColumns=True), keys, at, ordinal)


def too_soon(last: Column, now: Column, seconds: int = 60) -> Column:
    """A poll within so many seconds of the last refresh is skipped."""
    return F.coalesce(now.cast("double") - last.cast("double") < seconds, F.lit(False))


#: Buckets of a kept state: a micro-batch rewrites those that hold one of its keys.
BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def current_versions(spark, path: str) -> dict[int, int]:
    """Bucket -> version (the micro-batch that wrote it) of the last complete state below path; {} if there is none."""
    last = _committed(spark, path)
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/state={last[-1]}").collect()} if last else {}


def _committed(spark, path: str) -> list[int]:
    """Numbers of the micro-batches whose list of versions is complete, ascending."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/state=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)


def read_latest(spark, path: str, schema, only: Sequence[int] | None = None, versions: dict[int, int] | None = None) -> DataFrame:
    """The state that stream_latest keeps below path, or some buckets of it, as of the last complete micro-batch."""
    versions = current_versions(spark, path) if versions is None else versions
    files = [f"{path}/rows/v={v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def stream_latest(source: DataFrame, keys: Sequence[str], at: str, ordinal: str, path: str, checkpoint: str, ok: str | None = None, buckets: int = BUCKETS, keep: int = 2):
    """Run all available input through a stream that keeps the latest row per key (with ok: the latest for which that
    column is true, as latest_per_key) in files by key bucket below path; see read_latest. Returns the finished query.

    A micro-batch reads and rewrites only the buckets of its own keys, beside the old ones, and then writes the list of
    versions that make up the state. A micro-batch that runs again starts from the list before it and writes the same,
    so a reader sees each batch whole or not at all. Rows that none of the last `keep` lists names are deleted.
    """
    spark, schema = source.sparkSession, source.schema
    good = F.col(ok) if ok else None

    def merge(df: DataFrame, batch_id: int) -> None:
        new = materialize(latest_per_key(df, keys, at, ordinal, good).withColumn("bucket", _bucket(keys, buckets)), "latest-new")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most `buckets` numbers
        done = [n for n in _committed(spark, path) if n < batch_id]
        before = {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/state={done[-1]}").collect()} if done else {}
        if touched:
            old = read_latest(spark, path, schema, touched, before)
            both = latest_per_key(old.unionByName(new.drop("bucket")), keys, at, ordinal, good).withColumn("bucket", _bucket(keys, buckets))
            both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={batch_id}")
        now = before | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state={batch_id}")
        discard(new)
        _clear(spark, path, [*done, batch_id], keep)

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _clear(spark, path: str, done: list[int], keep: int) -> None:
    """Delete lists of versions before the last `keep`, and buckets that none of those kept names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = spark.read.schema("bucket int, version long").parquet(*[f"{path}/state={n}" for n in done[-keep:]])
    named = {(r.version, r.bucket) for r in kept.distinct().collect()}
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/v=*/bucket=*")
    store = p.getFileSystem(conf)
    for x in store.globStatus(p) or []:
        of = tuple(int(n.partition("=")[2]) for n in (x.getPath().getParent().getName(), x.getPath().getName()))
        if of not in named and of[0] <= done[-1]:
            store.delete(x.getPath(), True)
    for n in done[:-keep]:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/state={n}"), True)


def dedupe_stream(source: DataFrame, keys: Sequence[str], at: str, delay: str = "10 minutes") -> DataFrame:
    """Repeated keys within a watermark are dropped; the time column may have no zone."""
    return source.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
