from quillon.llm import shared
from quillon.llm.quality import judge_quality
from tests.llm.cases import DDL


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        shared.bounded_batches(spark)
        assert spark.conf.get(name).startswith("4096")  # a smaller setting stays
        spark.conf.set(name, "1g")
        shared.bounded_batches(spark)
        assert spark.conf.get(name).startswith(str(shared.BATCH_BYTES))
        spark.conf.set(name, "65536")
        docs = spark.createDataFrame([(i, "word " * 2000, "", "", 0) for i in range(300)], DDL).coalesce(1)
        rows = []

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        rows = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(rows) == 300 and max(rows) < 30
        assert judge_quality(docs).count() == 300
    finally:
        spark.conf.set(name, before)


def test_shared_folder(spark, tmp_path):
    from quillon.sources.shared import qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    made = shared.materialize(spark.range(5), "five")
    assert made.materialized_at.startswith(shared.shared_dir(spark)) and made.count() == 5
    shared.discard(made, spark.range(1))
    assert not __import__("os").path.exists(made.materialized_at.removeprefix("file://"))


def test_tidy_passes_batches_and_releases():
    seen = []
    run = shared.tidy(lambda batches: (b * 2 for b in batches))
    seen = list(run([1, 2]))
    assert seen == [2, 4]


def test_tasks_that_do_not_tokenize_drop_remembered_words():
    from quillon.llm import shared, tokens
    from quillon.llm.queries import vocabulary

    kept = tokens.chunk_ids(vocabulary())
    list(shared.tidy(lambda batches: batches, keeps_words=True)([]))
    assert tokens.chunk_ids(vocabulary()) is kept
    list(shared.tidy(lambda batches: batches)([]))
    assert tokens.chunk_ids(vocabulary()) is not kept
