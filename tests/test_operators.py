import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postsieve.operators import dedup, edits, positions, report, stamp, state
from postsieve.operators.screens import screen_endpoint_rows, screen_page_rows
from postsieve.sources import schemas

NOW = datetime(2026, 8, 22, 15, 0, 0, tzinfo=timezone.utc)
POST = "company string, title string, ord bigint"


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())


def hot_batch(n=3000):
    """A third of the rows share one key, a third one company."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(("hot", "same", i))
        elif i % 3 == 1:
            out.append(("hot", f"t{rng.randint(0, 400)}", i))
        else:
            out.append((f"c{rng.randint(0, 50)}", f"t{rng.randint(0, 20)}", i))
    rng.shuffle(out)
    return out


def first_of(batch, seen=()):
    best = {}
    for company, title, order in batch:
        key = (company, title)
        if key not in seen and order < best.get(key, order + 1):
            best[key] = order
    return sorted((*k, v) for k, v in best.items())


def test_endpoint_screen(spark):
    data = [
        (1, "Associate Analyst", "Pune", "/job/1"), (2, "Associate Analyst", "Berlin", "/job/2"),
        (3, "Associate Analyst, Pune", "", "/job/3"), (4, "Analyst", "Pune Graduate", "/job/4"),
        (5, "Associate Director", "Pune", "/job/5"), (6, "Meet Ann, Associate", "Pune", "/job/6"),
        (7, "Associate Analyst", "Pune", "/blog/7"), (8, None, "Junior Pune", None),
    ]
    df = spark.createDataFrame(data, "id int, title string, location string, href string")
    assert rows(screen_endpoint_rows(df), "id") == [(1,), (3,), (4,), (8,)]


def test_page_screen_needs_a_title_and_reads_the_whole_card(spark):
    data = [
        (1, "Analyst", "Analyst\nJunior role in Pune", "/j"), (2, "", "Junior Pune", "/j"),
        (3, "Junior", "Junior\nPune\nSenior team", "/j"), (4, "Junior", "Junior\nParis", "/j"), (5, "Junior", "Junior\nPune", ""),
    ]
    df = spark.createDataFrame(data, "id int, title string, card string, href string")
    assert rows(screen_page_rows(df), "id") == [(1,), (5,)]


def test_keep_first_and_new_postings_golden(spark):
    batch = spark.createDataFrame([("A", "t", 0), ("A", "t", 1), ("B", "u", 2)], POST)
    history = spark.createDataFrame([("B", "u", 9)], POST)
    assert rows(dedup.new_postings(batch, history)) == [("A", "t", 0)]


def test_null_keys_are_one_key(spark):
    batch = spark.createDataFrame([("A", None, 0), ("A", "", 1), (None, "t", 2)], POST)
    assert rows(dedup.new_postings(batch, batch.limit(0))) == [("", "t", 2), ("A", "", 0)]
    assert rows(dedup.new_postings(batch, batch)) == []


@pytest.mark.parametrize("limit", [0, dedup.PROBE_LIMIT])
def test_new_postings_with_a_hot_key(spark, limit):
    batch = hot_batch()
    past = [(c, t, 0) for c, t, _ in batch if t.endswith("7")] * 2 + [("hot", "same", 0)] * 500
    expected = first_of(batch, {(c, t) for c, t, _ in past})
    df = spark.createDataFrame(batch, POST).repartition(5)
    history = spark.createDataFrame(past, POST)
    assert rows(dedup.new_postings(df, history)) == expected
    firsts = dedup.keep_first(df)
    assert rows(dedup.probe_new_postings(firsts, history, limit=limit), *df.columns) == expected


def test_dedup_ignores_input_order_and_repeats(spark):
    batch = hot_batch(600)
    df = spark.createDataFrame(batch, POST)
    other = spark.createDataFrame(sorted(batch, key=lambda r: (r[1], -r[2])), POST).repartition(7)
    empty = df.limit(0)
    new = dedup.new_postings(df, empty)
    assert rows(new) == rows(dedup.new_postings(other, empty)) == first_of(batch)
    history = dedup.append_rows(empty.withColumn("notified", F.lit(True)), new)
    assert dedup.new_postings(df, history, history_unique=True).count() == 0
    assert {r.notified for r in history.collect()} == {None}


def test_probe_plan_sends_the_batch_to_the_history(spark, tmp_path):
    spark.createDataFrame(hot_batch(), POST).write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    firsts = dedup.keep_first(history.where("ord < 50"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.probe_new_postings(firsts, history)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [company" in plan and "LeftSemi, BuildRight" in plan
        shuffled = dedup.probe_new_postings(firsts, history, limit=0)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_fallback_rows(spark):
    api = spark.createDataFrame([("a", "x", 0)], POST)
    page = spark.createDataFrame([("a", "y", 0), ("b", "y", 0), ("c", "y", 0)], POST)
    failed = spark.createDataFrame([("c",)], "company string")
    assert rows(dedup.fallback_rows(api, page, failed=failed)) == [("a", "x", 0), ("b", "y", 0)]


def test_positions_match_a_plain_count(spark):
    rng = random.Random(9)
    seqs = rng.sample(range(-5000, 50_000), 4000)
    data = [(None if i % 10 == 0 else "hot" if i % 3 == 0 else f"g{i % 40}", s) for i, s in enumerate(seqs)]
    out = positions.with_positions(spark.createDataFrame(data, "g string, seq bigint"), ["g"], "seq", width=256)
    groups = {}
    for g, s in data:
        groups.setdefault(g, []).append(s)
    expected = {(g, s): (n, len(v)) for g, v in groups.items() for n, s in enumerate(sorted(v))}
    assert {(r.g, r.seq): (r.position, r.total) for r in out.collect()} == expected


def test_delete_and_select(spark):
    table = spark.createDataFrame([("A", "t", 0), ("A", "u", 1), ("B", "t", 2)], POST)
    ids = spark.createDataFrame([("A", "t"), ("A", "t")], "company string, title string")
    assert rows(edits.delete_by_key(table, ids, ["company", "title"]), "ord") == [(1,), (2,)]
    assert rows(edits.select_by_key(table, ids, ["company", "title"]), "ord") == [(0,)]


def test_new_sources(spark):
    data = [
        (0, " Acme ", "https://a"), (1, "", "x"), (2, "Bell", "ftp://b"), (3, "ACME", "http://a2"),
        (4, "Known", "httpx"), (5, "bell", "http"), (6, None, None), (7, "　", "https://z"),
    ]
    df = spark.createDataFrame(data, "ord bigint, name string, url string")
    tracked = spark.createDataFrame([("kNOWN",), ("kNOWN",)], "name string")
    checked = edits.validate_sources(df, tracked)
    assert rows(checked, "ord", "reason") == sorted([
        (0, None), (1, edits.NAME_REQUIRED), (2, edits.URL_SCHEME), (3, edits.ALREADY_TRACKED),
        (4, edits.ALREADY_TRACKED), (5, None), (6, edits.NAME_REQUIRED), (7, edits.NAME_REQUIRED),
    ])
    added = edits.accepted_sources(checked, after=9)
    assert added.schema.fieldNames() == schemas.SOURCES.fieldNames()
    assert rows(added, "position", "name", "status", "locked") == [(10, "Acme", "unknown", False), (15, "bell", "unknown", False)]
    assert added.select("id").distinct().count() == 2


def test_first_title_needs_no_unique_order(spark):
    rows_ = spark.createDataFrame([("a", "z", "u2", 0), ("a", "y", "u1", 0), ("a", "x", "u0", 1)], schemas.POSTINGS)
    firsts = state.first_title(rows_, order=["ord", "url"])
    assert rows(firsts) == [("a", "y")]
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_status_and_merge(spark):
    attempts = spark.createDataFrame(
        [("a", NOW, True), ("a", datetime(2026, 8, 22, 18, tzinfo=timezone.utc), False), ("b", NOW, True), ("c", NOW, True), ("c", NOW, False)],
        schemas.ATTEMPTS,
    )
    statuses = state.source_status(attempts).withColumnRenamed("company", "name")
    assert rows(statuses, "name", "status") == [("a", "broken"), ("b", "active"), ("c", "broken")]
    sources = spark.createDataFrame(
        [(0, "1", "a", "u", True, "active", "old", None), (1, "2", "b", "u", True, "broken", None, None), (2, "3", "z", "u", None, "unknown", "kept", None)],
        schemas.SOURCES,
    )
    firsts = state.first_title(spark.createDataFrame([("b", "second", 4), ("b", "first", 3)], POST)).withColumnRenamed("company", "name")
    merged = state.merge_source_state(sources, statuses.select("name", "status"), firsts, NOW)
    assert rows(merged, "name", "status", "last_job") == [("a", "broken", ""), ("b", "active", "first"), ("z", "unknown", "kept")]
    assert {r.name: r.last_checked is None for r in merged.collect()} == {"a": False, "b": False, "z": True}
    assert rows(report.responding_count(merged)) == [(2, 3)]
    assert rows(report.responding_count(sources.withColumn("status", F.lit(None).cast("string")))) == [(3, 3)]


def test_latest_check_never(spark):
    assert report.latest_check(spark.createDataFrame([], schemas.SOURCES), NOW).first().age == "never"


def test_board(spark):
    sources = spark.createDataFrame([(0, "1", "acme", "https://www.acme.com/jobs", True, "active", "", NOW)], schemas.SOURCES)
    board = report.source_board(sources, datetime(2026, 8, 22, 16, 30, tzinfo=timezone.utc))
    assert tuple(board.first()) == ("acme", "A", "acme.com", "Active", "—", "1h ago", "CORE")


def test_digest_of_one_document(spark):
    data = [
        ("user@example.com", 2, "B <x>", "Co & co", 'https://h/?a=1&b="2"', "Jul 5, 03:04"),
        ("user@example.com", 1, "A", "Co", None, None), ("", 3, "C", "Co", "u", "d"), (None, 4, "D", "Co", "u", "d"),
    ]
    df = spark.createDataFrame(data, "recipient string, seq bigint, title string, company string, url string, date string")
    out = report.alert_digest(df).collect()
    assert len(out) == 1
    assert out[0].subject == "[Job Alert] 2 new fresher postings" and (out[0].part, out[0].parts, out[0].total) == (1, 1, 2)
    assert out[0].body == 'A @ Co — \nB <x> @ Co & co — https://h/?a=1&b="2"'
    first, second = out[0].html_rows.split("\n")
    assert 'href="#"' in first and "B &lt;x&gt;" in second and 'b=&quot;2&quot;"' in second
    one = report.alert_digest(df.where("seq = 1")).first()
    assert one.subject == "[Job Alert] 1 new fresher posting"
    assert report.alert_digest(df.where("seq > 2")).count() == 0


def test_digest_of_one_hot_recipient_is_split_and_whole(spark):
    df = spark.range(5000).select(
        F.lit("user@example.com").alias("recipient"), (F.col("id") * 7).alias("seq"), F.concat(F.lit("t"), "id").alias("title"),
        F.lit("c").alias("company"), F.lit("u").alias("url"), F.lit("d").alias("date"),
    )
    out = report.alert_digest(df, lines_per_document=300).orderBy("part").collect()
    assert [r.part for r in out] == list(range(1, 18)) and {(r.parts, r.total) for r in out} == {(17, 5000)}
    lines = "\n".join(r.body for r in out).split("\n")
    assert lines == [f"t{i} @ c — u" for i in range(5000)]
    assert max(r.body.count("\n") + 1 for r in out) == 300


def test_pending_and_marking(spark):
    df = spark.createDataFrame([(1, None), (2, False), (3, True), (4, None)], "seq bigint, notified boolean")
    sent = spark.createDataFrame([(4,), (4,)], "seq bigint")
    assert rows(report.pending_alerts(df, sent), "seq") == [(1,), (2,)]
    marked = {r.seq: r.notified for r in report.mark_notified(df, sent).collect()}
    assert marked == {1: None, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("width", [4, 64, 65_536])
@pytest.mark.parametrize("total", [0, 1, 10, 11, 237])
def test_pages_match_a_slice(spark, total, width):
    seqs = [i * 3 + (i % 2) for i in range(total)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
    newest = list(reversed(seqs))
    last = max(0, (total - 1) // 10) if total else 0
    for page in {0, 1, last, last + 5}:
        at = min(page, last)
        found = [r.seq for r in report.history_page(df, page, width=width).collect()]
        assert found == newest[at * 10 : at * 10 + 10]
        place = report.locate_page(df, page, width=width)
        assert (place.number, place.total) == (at, total)


def test_page_bounds_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("seq"), F.lit("x").alias("title")).write.parquet(str(tmp_path / "h"))
    page = report.history_page(spark.read.parquet(str(tmp_path / "h")), 3, width=50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq" in plan and "TakeOrderedAndProject" in plan


def test_summary(spark):
    firsts = spark.createDataFrame([("A", "t", 0), ("B", "t", 1)], POST)
    history = spark.createDataFrame([("A", "t", 0), ("A", "t", 5)], POST)
    assert rows(report.run_summary(firsts, history, dedup.KEY)) == [(2, 1, 1)]
    untitled = spark.createDataFrame([("A", None, 0), ("A", "", 1)], POST)
    assert rows(report.run_summary(untitled, history, dedup.KEY)) == [(1, 0, 1)]


def test_stamp(spark):
    new = spark.createDataFrame([("B b", "t", "u", 1), ("A", "t", "u", 0)], schemas.POSTINGS)
    out = stamp.stamp_new(new, 41, NOW, ["company", "ord"]).orderBy("seq").collect()
    assert [r.id for r in out] == ["A_t", "B_b_t"] and out[0].seq >= 42 and out[0].seq < out[1].seq
    assert {(r.date, r.notified) for r in out} == {("Aug 22, 15:00", False)}
    assert stamp.stamp_new(new, 41, NOW, ["ord"]).where(F.col("found_at") == F.lit(NOW)).count() == 2


def test_stamp_numbers_ties_alike(spark):
    rows = [(c, t, "u", 0) for c in ("c2", "c1", "c3") for t in ("b", "a")]
    found = []
    for given in (rows, rows[::-1]):
        new = spark.createDataFrame(given, "company string, title string, url string, ord long")
        found.append([(r.company, r.title) for r in stamp.stamp_new(new, 0, NOW, ["ord", "url"]).orderBy("seq").collect()])
    assert found[0] == found[1] == sorted((c, t) for c, t, _, _ in rows)
