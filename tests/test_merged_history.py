"""Merged runs: the same history before and after, faults in between, repeats, and joins that leave the keys where they are."""

import re

import pytest
from pyspark.sql import functions as F

from postsieve.operators import report
from postsieve.plans.run import new_to_history
from postsieve.sources import schemas, snapshots


def add(spark, root, run, rows, first=0):
    made = [(c, t, "u", "i", "d", None, first + i, False) for i, (c, t) in enumerate(rows)]
    snapshots.append_run(spark.createDataFrame(made, schemas.HISTORY), root, run)


def content(spark, root, **kwargs):
    return sorted(((r.run, r.seq, r.company, r.title) for r in snapshots.read_history(spark, root, **kwargs).collect()), key=str)


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path)
    add(spark, path, "a", [("A", "x"), ("A", None), (None, "z")])
    add(spark, path, "b", [("B", "x"), ("B", "y")], first=10)
    add(spark, path, "empty", [])
    snapshots.remove_rows(snapshots.read_history(spark, path).where("run = 'b' AND seq = 11"), path)
    return path


def test_history_is_the_same_before_and_after(spark, root):
    before = content(spark, root)
    assert snapshots.merge_runs(spark, root, buckets=3) == 1
    assert content(spark, root) == before and len(before) == 4
    assert content(spark, root, without_run="a") == [r for r in before if r[0] != "a"]
    assert snapshots.last_seq(spark, root) == 11, "the number of a removed row is not given again"
    assert snapshots.last_seq(spark, root, without_run="b") == 2
    assert snapshots.merge_runs(spark, root) == 1, "nothing to merge"
    plan = snapshots.read_history(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*NOT run#\d+ IN \(a,b,empty\)", plan), "folders of merged runs are passed over"


def test_later_runs_removals_and_clearing(spark, root):
    snapshots.merge_runs(spark, root)
    add(spark, root, "c", [("C", "x")], first=20)
    snapshots.remove_rows(snapshots.read_history(spark, root).where("run = 'a' AND seq = 0"), root)
    want = content(spark, root)
    assert [r[0] for r in want] == ["a", "a", "b", "c"]
    assert snapshots.merge_runs(spark, root, buckets=2) == 2 and content(spark, root) == want
    snapshots.clear_history(spark, root)
    add(spark, root, "d", [("A", "x")], first=30)
    assert content(spark, root) == [("d", 30, "A", "x")]
    assert snapshots.merge_runs(spark, root) == 3 and content(spark, root) == [("d", 30, "A", "x")]


def test_a_repeat_of_a_merged_run_replaces_its_rows(spark, root):
    snapshots.merge_runs(spark, root)
    for _ in range(2):
        add(spark, root, "b", [("B", "new")], first=12)
        assert [r for r in content(spark, root) if r[0] == "b"] == [("b", 12, "B", "new")]
    assert snapshots.merge_runs(spark, root) == 2
    assert [r for r in content(spark, root) if r[0] == "b"] == [("b", 12, "B", "new")] and len(content(spark, root)) == 4


def test_a_fault_between_the_steps_is_not_seen(spark, root, monkeypatch):
    before = content(spark, root)
    for step in ("_write_keys", "_finish"):
        with monkeypatch.context() as patch:
            patch.setattr(snapshots, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                snapshots.merge_runs(spark, root)
        assert content(spark, root) == before
    assert snapshots.merge_runs(spark, root) == 1 and content(spark, root) == before


def test_a_run_that_is_not_whole_keeps_its_folder(spark, root):
    torn = spark.createDataFrame([("T", "x", "u", "i", "d", None, 40, False)], schemas.HISTORY)
    torn.write.parquet(f"{root}/rows/run=torn")  # its writer was lost before it wrote that the run is finished
    add(spark, root, "short", [("S", "x"), ("S", "y")], first=50)
    torn.write.mode("overwrite").parquet(f"{root}/rows/run=short")
    snapshots.merge_runs(spark, root)
    assert not {"torn", "short"} & snapshots._merged(spark, root).runs
    assert {("torn", 40, "T", "x"), ("short", 40, "T", "x")} <= set(content(spark, root))
    add(spark, root, "torn", [("T", "x")], first=40)
    assert snapshots.merge_runs(spark, root) == 2 and "torn" in snapshots._merged(spark, root).runs


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_new_postings_by_buckets(spark, root, limit):
    snapshots.merge_runs(spark, root, buckets=3)
    add(spark, root, "c", [("C", "x")], first=20)
    snapshots.remove_rows(snapshots.read_history(spark, root).where("run = 'a' AND seq = 0"), root)
    keys = [("A", "x"), ("A", ""), ("", "z"), ("B", "x"), ("B", "y"), ("C", "x"), ("D", "x")]
    firsts = spark.createDataFrame([(c, t, "u", i) for i, (c, t) in enumerate(keys)], schemas.POSTINGS)
    fresh = new_to_history(firsts, root, "now", limit)
    assert sorted((r.company, r.title) for r in fresh.collect()) == [("A", "x"), ("B", "y"), ("D", "x")]
    assert ("C", "x") in {(r.company, r.title) for r in new_to_history(firsts, root, "c", limit).collect()}


def test_keys_are_joined_where_they_lie(spark, root):
    snapshots.merge_runs(spark, root, buckets=3)
    firsts = spark.createDataFrame([("A", "x", "u", 0)], schemas.POSTINGS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, keys = snapshots.history_keys(spark, root)
        met = keys.join(firsts.select(snapshots.key_number().alias("key")), "key", "left_semi")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "SelectedBucketsCount: 3 out of 3" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, "only the batch moves"
    keyed_side = plan[plan.index("SortMergeJoin"):plan.index("FileScan parquet")]
    assert "Exchange" not in keyed_side


def test_pages_of_merged_runs_open_few_files(spark, tmp_path):
    root = str(tmp_path)
    for run in range(4):  # runs whose numbers interleave, so that every folder holds a part of each page
        made = spark.range(1000).select(
            F.lit("A").alias("company"), F.col("id").cast("string").alias("title"), *[F.lit("").alias(c) for c in ("url", "i", "date")],
            F.lit(None).cast("timestamp").alias("found_at"), (F.col("id") * 4 + run).alias("seq"), F.lit(False).alias("notified"),
        ).withColumnRenamed("i", "id")
        snapshots.append_run(made, root, f"r{run}")
    page = lambda: [r.seq for r in report.history_page(snapshots.read_history(spark, root), 3, 50, width=64).collect()]
    want = page()
    assert snapshots.merge_runs(spark, root, rows_per_file=500) == 1
    assert page() == want == list(range(3849, 3799, -1))
    files = snapshots.read_history(spark, root).where(F.col("seq").between(3800, 3849)).select(F.input_file_name()).distinct().count()
    assert files <= 2
