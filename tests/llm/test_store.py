"""Scratch tables, batch sizes and the tables that workers keep."""

from cuelight.llm import store


def test_scratch(spark):
    s = store.Scratch(spark, "t")
    t = s.table(spark.range(5), "x")
    assert t.count() == 5 and t.scratch_path.startswith(store.shared_root(spark))
    s.drop(t)


def test_small_batches_are_undone(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with store.small_batches(spark, "1m"):
        assert spark.conf.get(name) == "1m"
    assert spark.conf.get(name) == before


def test_worker_tables_of_others_go():
    mine, other = {1: 1}, {2: 2}
    store.in_worker("a", mine.clear)
    store.in_worker("a", mine.clear)
    assert mine
    store.in_worker("b", other.clear)
    assert not mine and other
    store.in_worker("c")
    assert not other


def test_shuffle_files_go_with_the_job(spark):
    import glob
    import os

    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    size = lambda: sum(os.path.getsize(f) for d in root for f in glob.glob(f"{d}/**/*.data", recursive=True))
    before = size()
    stored = store.Scratch(spark, "t").table(spark.range(300_000).repartition(3, "id"))
    assert stored.count() == 300_000 and size() <= before
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"
