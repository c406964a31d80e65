"""State of the sources kept by a stream of attempts."""

from datetime import datetime, timezone

import pytest

from postsieve.operators.state import latest_attempts, merge_latest, merge_source_state
from postsieve.sources import schemas, snapshots
from postsieve.streaming.attempts import start_source_state, state_writer

FORM = "company string, checked_at timestamp, ok boolean, title string"


def at(hour):
    return datetime(2024, 3, 1, hour, tzinfo=timezone.utc)


def seed(spark, root, *names, checked=None):
    rows = [(i, n, n, "", True, "unknown", "old", checked) for i, n in enumerate(names)]
    snapshots.write_snapshot(spark.createDataFrame(rows, schemas.SOURCES), f"{root}/sources")


def state_of(spark, root):
    df = snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES).selectExpr("name", "status", "last_job", "unix_seconds(last_checked) AS s")
    return sorted((r.name, r.status, r.last_job, r.s and (r.s - int(at(0).timestamp())) // 3600) for r in df.collect())


@pytest.fixture
def land(spark, tmp_path):
    root = str(tmp_path)

    def run(*rows):
        spark.createDataFrame(rows, FORM).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(FORM).parquet(f"{root}/landed")
        start_source_state(stream, root, f"{root}/checkpoint").awaitTermination()

    run.root = root
    return run


def test_late_and_repeated_attempts_change_nothing(spark, land):
    seed(spark, land.root, "a", "b", "c")
    land(("a", at(2), True, "two"), ("b", at(3), False, None), ("untracked", at(3), True, "x"))
    first = [("a", "active", "two", 2), ("b", "broken", "", 3), ("c", "unknown", "old", None)]
    assert state_of(spark, land.root) == first
    land(("a", at(1), False, None), ("a", at(2), True, "two"), ("b", at(1), True, "one"), (None, at(9), True, "x"), ("c", None, True, "x"))
    assert state_of(spark, land.root) == first
    land(("b", at(4), True, None), ("c", at(4), None, "four"), ("a", at(2), False, "ignored"))
    assert state_of(spark, land.root) == [("a", "broken", "", 2), ("b", "active", "", 4), ("c", "active", "four", 4)]


def test_a_later_run_is_not_undone(spark, land):
    seed(spark, land.root, "a", checked=at(5))
    land(("a", at(4), False, None))
    assert state_of(spark, land.root) == [("a", "unknown", "old", 5)]
    land(("a", at(5), False, None))
    assert state_of(spark, land.root) == [("a", "broken", "", 5)]


def test_equal_to_the_merge_of_a_run(spark):
    """Attempts at one instant are a run: the same state as ``merge_source_state``."""
    sources = spark.createDataFrame([(n, "unknown", "old", None) for n in "abcd"], "name string, status string, last_job string, last_checked timestamp")
    attempts = spark.createDataFrame([("a", at(1), True, "x"), ("b", at(1), False, None), ("c", at(1), True, None)], FORM)
    statuses = spark.createDataFrame([("a", "active"), ("b", "broken"), ("c", "active")], "name string, status string")
    firsts = spark.createDataFrame([("a", "x")], "name string, last_job string")
    mine = merge_latest(sources, latest_attempts(attempts))
    assert sorted(mine.collect()) == sorted(merge_source_state(sources, statuses, firsts, at(1)).collect())


def test_replay_and_a_conflicting_edit(spark, tmp_path, monkeypatch):
    """A batch that is repeated gives the same state, and one that meets another writer merges into what that one wrote."""
    root = str(tmp_path)
    seed(spark, root, "a", "b")
    batch = latest_attempts(spark.createDataFrame([("a", at(2), True, "two")], FORM))
    write, real, raced = state_writer(root, "s"), snapshots.write_snapshot, []

    def racing(df, path, expected=None):
        if not raced:
            raced.append(snapshots.read_snapshot(spark, path, schemas.SOURCES).where("name = 'a'"))
            real(raced[0], path)
        return real(df, path, expected)

    monkeypatch.setattr(snapshots, "write_snapshot", racing)
    write(batch, 0)
    assert state_of(spark, root) == [("a", "active", "two", 2)]
    write(batch, 0)
    assert state_of(spark, root) == [("a", "active", "two", 2)]
    write(batch.limit(0), 1)
    assert snapshots.current_version(spark, f"{root}/sources") == 4
