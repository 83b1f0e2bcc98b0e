"""Outbox with a crash after every step, resumable work, and hash trees of snapshots."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import diff, hashtree
from quillon.streaming import outbox
from tests.conftest import SF


class Crash(Exception):
    pass


def events(spark, ids):
    return spark.createDataFrame([(f"m{i}", i) for i in ids], "message_id string, n int")


@pytest.mark.parametrize("at", range(12))
def test_a_crash_after_any_step_sends_each_event_once(spark, tmp_path, at):
    """Two batches with common events and a compaction, stopped at the at-th step and started again."""
    calls = []

    def step(name):
        calls.append(name)
        if len(calls) == at + 1:
            raise Crash(name)

    def send(df, n):
        df.write.mode("overwrite").parquet(f"{tmp_path}/gateway/b={n}")

    def run(box):
        box.deliver(events(spark, [1, 2, 2, 3]), 0, send)
        box.deliver(events(spark, [3, 4]), 1, send)
        box.compact()
        box.deliver(events(spark, [1, 4, 5]), 2, send)

    try:
        run(outbox.Outbox(spark, f"{tmp_path}/box", step))
    except Crash:
        pass
    box = outbox.Outbox(spark, f"{tmp_path}/box")
    run(box)
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/gateway").collect()) == [1, 2, 3, 4, 5]
    assert box.packed() == 1 and box.batches("sent") == [2] and box.recover(send) == []
    assert sorted(r.message_id for r in box.known().collect()) == ["m1", "m2", "m3", "m4", "m5"]
    assert not box.deliver(events(spark, [9]), 1, send)  # confirmed long ago


def test_a_repeated_batch_sends_what_it_was_going_to(spark, tmp_path):
    sent = []
    box = outbox.Outbox(spark, f"{tmp_path}/box", lambda name: (_ for _ in ()).throw(Crash()) if name == "after intent" else None)
    with pytest.raises(Crash):
        box.deliver(events(spark, [1]), 0, lambda df, n: None)
    outbox.Outbox(spark, f"{tmp_path}/box").deliver(events(spark, [1, 2]), 0, lambda df, n: sent.append(sorted(r.n for r in df.collect())))
    assert sent == [[1]]


def test_streamed_events_reach_the_outbox(spark, tmp_path):
    seen = []
    for ids in ([1, 2], [2, 3]):
        events(spark, ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("message_id string, n int").parquet(f"{tmp_path}/in")
        outbox.stream_to_outbox(source, outbox.Outbox(spark, f"{tmp_path}/box"), lambda df, n: seen.append((n, sorted(r.n for r in df.collect()))), f"{tmp_path}/cp")
    assert seen == [(0, [1, 2]), (1, [3])]


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    done = []

    def process(stop):
        def f(df):
            if len(done) == stop:
                raise Crash
            done.append(df.count())
            return df.withColumn("twice", F.col("n") * 2)

        return f

    work = events(spark, range(100))
    with pytest.raises(Crash):
        outbox.resumable(work, "message_id", process(3), f"{tmp_path}/run", 8)
    before = list(done)
    out = outbox.resumable(work, "message_id", process(99), f"{tmp_path}/run", 8)
    assert sorted((r.n, r.twice) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
    assert len(done) == 8 and done[:3] == before and sum(done) == 100
    assert outbox.resumable(work.limit(0), "message_id", process(99), f"{tmp_path}/none", 8).count() == 0


def test_one_changed_row_reads_one_leaf(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    hashtree.write_snapshot(orders, ["o_orderkey"], old, depth=6)
    some = orders.first().o_orderkey
    hashtree.write_snapshot(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == some, 0.0).otherwise(F.col("o_totalprice"))).repartition(7), ["o_orderkey"], new, depth=6)
    leaves = hashtree.differing_leaves(spark, old, new)
    assert len(leaves) == 1
    files = hashtree.read_leaves(spark, new, leaves).inputFiles()
    assert files and all(f"leaf_={leaves[0]}/" in f for f in files)
    assert [tuple(r) for r in hashtree.tree_diff(spark, old, new, ["o_orderkey"]).collect()] == [(some, "changed")]
    assert hashtree.differing_leaves(spark, old, old) == [] and hashtree.tree_diff(spark, old, old, ["o_orderkey"]).count() == 0


def test_tree_diff_is_snapshot_diff(spark, tmp_path):
    a = spark.createDataFrame([(i, f"v{i}", i, 1) for i in range(300)] + [(None, "null", 0, 1), (5, "later", 5, 2)], "k int, v string, seen int, o int")
    b = spark.createDataFrame([(i, f"v{i if i % 40 else -i}", -i, 1) for i in range(20, 320)], "k int, v string, seen int, o int")
    for i, df in enumerate((a, b, a.limit(0))):
        hashtree.write_snapshot(df, ["k"], f"{tmp_path}/{i}", "o", ["seen"], depth=5)
    for x, y, p, q in ((a, b, 0, 1), (b, a, 1, 0), (a.limit(0), b, 2, 1), (a.limit(0), a.limit(0), 2, 2)):
        want = diff.snapshot_diff(x, y, ["k"], "o", ["seen"]).filter("change_type <> 'same'")
        got = hashtree.tree_diff(spark, f"{tmp_path}/{p}", f"{tmp_path}/{q}", ["k"], ["seen", "o"])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    hashtree.write_snapshot(b, ["k"], f"{tmp_path}/deep", depth=6)
    with pytest.raises(ValueError):
        hashtree.differing_leaves(spark, f"{tmp_path}/0", f"{tmp_path}/deep")
