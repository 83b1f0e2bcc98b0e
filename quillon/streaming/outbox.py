"""Outbox: what is to be sent is written first, sent with stable ids, then confirmed, so that a crash at any step neither
loses nor repeats an event; and batch work that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import discard, materialize


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the folders <path>/b=n that were written whole, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/b=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Outbox:
    """Events with a message_id, by batch: intents/b=n (what batch n sends), sent/b=n (confirmed), packed/b=n (ids of all
    confirmed batches up to n, in their place).

    send(df, batch_id) may be called again for a batch that was being sent when the process died, with the same rows and
    number; it has to be idempotent by either, as a gateway that knows message ids or a folder named after the batch is.
    `step` is called between the steps with their names, for tests that stop there.
    """

    def __init__(self, spark: SparkSession, path: str, step: Callable[[str], None] = lambda name: None):
        self.spark, self.path, self.step = spark, path.rstrip("/"), step

    def batches(self, kind: str) -> list[int]:
        return _complete(self.spark, f"{self.path}/{kind}")

    def packed(self) -> int:
        """The last batch whose ids are packed; -1 if there is none."""
        return max(self.batches("packed"), default=-1)

    def known(self) -> DataFrame:
        """message_id of all events that were sent or are about to be."""
        last = self.packed()
        paths = [f"{self.path}/intents/b={n}" for n in self.batches("intents") if n > last] + ([f"{self.path}/packed/b={last}"] if last >= 0 else [])
        return self.spark.read.schema("message_id string").parquet(*paths) if paths else self.spark.createDataFrame([], "message_id string")

    def deliver(self, events: DataFrame, batch_id: int, send: Callable[[DataFrame, int], None]) -> bool:
        """Send those events that no batch has yet; False if the batch was confirmed before. Unconfirmed batches before
        it are finished first. The events of a batch are those of its first call, so a later call can't change them."""
        self.recover(send, before=batch_id)
        if batch_id <= self.packed() or batch_id in self.batches("sent"):
            return False
        if batch_id not in self.batches("intents"):
            self.step("before intent")
            fresh = events.dropDuplicates(["message_id"]).join(self.known(), "message_id", "left_anti")
            fresh.write.mode("overwrite").parquet(f"{self.path}/intents/b={batch_id}")
            self.step("after intent")
        self._finish(batch_id, send)
        return True

    def recover(self, send: Callable[[DataFrame, int], None], before: int | None = None) -> list[int]:
        """Finish batches that have intents and no confirmation; their numbers."""
        done, last = set(self.batches("sent")), self.packed()
        open_ = [n for n in self.batches("intents") if n > last and n not in done and (before is None or n < before)]
        for n in open_:
            self._finish(n, send)
        return open_

    def _finish(self, n: int, send: Callable[[DataFrame, int], None]) -> None:
        intents = self.spark.read.parquet(f"{self.path}/intents/b={n}")
        send(intents, n)
        self.step("after send")
        intents.select("message_id", F.current_timestamp().alias("sent_at")).write.mode("overwrite").parquet(f"{self.path}/sent/b={n}")
        self.step("after confirmation")

    def compact(self) -> int:
        """Pack the ids of all batches up to the first unconfirmed one into one table and delete their folders; the last
        batch packed. The table counts once it is whole, and folders that a crash leaves are deleted by the next call."""
        last, sent = self.packed(), set(self.batches("sent"))
        intents = [n for n in self.batches("intents") if n > last]
        upto = next((n for n in intents if n not in sent), (max(intents, default=last)) + 1) - 1
        ready = [n for n in intents if n <= upto]
        if ready:
            ids = self.spark.read.schema("message_id string").parquet(*[f"{self.path}/intents/b={n}" for n in ready], *([f"{self.path}/packed/b={last}"] if last >= 0 else []))
            ids.write.mode("overwrite").parquet(f"{self.path}/packed/b={ready[-1]}")
            self.step("after packing")
        last = self.packed()
        for kind in ("intents", "sent", "packed"):
            for n in self.batches(kind):
                if n < last or n == last and kind != "packed":
                    _delete(self.spark, f"{self.path}/{kind}/b={n}")
                    self.step("after deletion")
        return last


def stream_to_outbox(events: DataFrame, outbox: Outbox, send: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run all available streamed events (message_id, ...) through the outbox; a micro-batch that runs again after a crash
    is the batch of the same number."""
    query = events.writeStream.foreachBatch(lambda df, n: outbox.deliver(df, n, send)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def resumable(work: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], path: str, parts: int = 50) -> DataFrame:
    """process(work), done part by part (of the key's hash), each written to <path>/done/b=n; parts that were written whole
    are not done again, so a run that was stopped goes on where it was, as long as path and parts stay.

    The work list is written once, by part, and belongs to the run until it is done: rows added meanwhile wait for the
    next path. An empty part costs nothing; a null key is a key.
    """
    spark = work.sparkSession
    listed = f"{path}/work"
    if not _complete(spark, f"{path}/listed"):
        rows = materialize(work.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "resumable")
        rows.write.mode("overwrite").partitionBy("part_").parquet(listed)
        rows.groupBy("part_").count().coalesce(1).write.mode("overwrite").parquet(f"{path}/listed/b=0")
        discard(rows)
    done = set(_complete(spark, f"{path}/done"))
    numbers = sorted(r.part_ for r in spark.read.parquet(f"{path}/listed/b=0").select("part_").collect())  # at most `parts`
    for n in numbers:
        if n not in done:
            process(spark.read.schema(work.schema).parquet(f"{listed}/part_={n}")).write.mode("overwrite").parquet(f"{path}/done/b={n}")
    if not numbers:
        return process(work.limit(0))
    return spark.read.parquet(*[f"{path}/done/b={n}" for n in numbers])
