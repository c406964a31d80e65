import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postsieve.operators.dedup import new_postings
from postsieve.plans.run import apply_run, scheduled_run, send_pending
from postsieve.sources import outbox, schemas, snapshots
from postsieve.streaming import incremental

FIRST = datetime(2026, 8, 22, 15, 0, tzinfo=timezone.utc)
SECOND = datetime(2026, 8, 22, 18, 0, tzinfo=timezone.utc)
ENDPOINT = "https://t.example.com/wday/cxs/t/Careers/jobs"


def payload(*titles):
    return json.dumps({"jobPostings": [{"title": t, "locationsText": "Pune", "externalPath": f"/job/{i}"} for i, t in enumerate(titles)]})


def link(title, href):
    return f"<a href='{href}'><h3>{title}</h3><p>Pune, India</p></a>"


@pytest.fixture
def root(spark, tmp_path):
    names = ["Api", "Empty", "Broken", "Page", "Quiet"]
    sources = [(i, n.lower(), n, f"https://{n.lower()}.example.com/jobs/", True, "unknown", None, None) for i, n in enumerate(names)]
    snapshots.write_snapshot(spark.createDataFrame(sources, schemas.SOURCES), f"{tmp_path}/sources")
    return str(tmp_path)


def run(spark, root, at, api_titles, page_titles):
    payloads = spark.createDataFrame(
        [("Api", ENDPOINT, payload(*api_titles)), ("Empty", ENDPOINT, payload("Director")), ("Broken", ENDPOINT, "<html>")],
        schemas.PAYLOADS,
    )
    html = "".join(link(t, f"view/{i}") for i, t in enumerate(page_titles)) + "<a href='/blog/x'>Junior in Pune</a>"
    pages = spark.createDataFrame([(n, f"https://{n.lower()}.example.com/jobs/", html) for n in ("Api", "Empty", "Broken", "Page")], schemas.PAGES)
    return scheduled_run(spark, root, payloads, pages, at, "user@example.com")


def test_two_scheduled_runs(spark, root):
    name = run(spark, root, FIRST, ["Junior A", "Associate B", "Junior A"], ["Trainee C"])
    history = snapshots.read_history(spark, f"{root}/history")
    assert [(r.company, r.title, r.url) for r in history.orderBy("seq").collect()] == [
        ("Api", "Junior A", "https://t.example.com/Careers/job/0"), ("Api", "Associate B", "https://t.example.com/Careers/job/1"),
        ("Empty", "Trainee C", "https://empty.example.com/jobs/view/0"), ("Page", "Trainee C", "https://page.example.com/jobs/view/0"),
    ]
    sources = snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES).orderBy("position").collect()
    assert [(s.name, s.status, s.last_job) for s in sources] == [
        ("Api", "active", "Junior A"), ("Empty", "active", "Trainee C"), ("Broken", "broken", ""), ("Page", "active", "Trainee C"), ("Quiet", "active", ""),
    ]
    digest = spark.read.parquet(f"{root}/digests/run={name}").first()
    assert digest.subject == "[Job Alert] 4 new fresher postings"
    assert digest.body.split("\n")[0] == "Junior A @ Api — https://t.example.com/Careers/job/0"

    again = run(spark, root, FIRST, ["Junior A", "Associate B", "Junior A"], ["Trainee C"])
    assert again == name and snapshots.read_history(spark, f"{root}/history").count() == 4, "a repeated run replaces itself"

    later = run(spark, root, SECOND, ["Associate B", "Graduate D"], [])
    new = snapshots.read_history(spark, f"{root}/history").where(F.col("run") == later)
    assert [(r.company, r.title, r.date) for r in new.collect()] == [("Api", "Graduate D", "Aug 22, 18:00")]
    assert new.agg(F.min("seq")).first()[0] > max(
        r.seq for r in snapshots.read_history(spark, f"{root}/history", without_run=later).collect()
    )
    after = {s.name: (s.status, s.last_job) for s in snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES).collect()}
    assert after["Api"] == ("active", "Associate B") and after["Page"] == ("active", "") and after["Broken"] == ("broken", "")


FILES = [
    [("A", "t", "u0", 0), ("A", "t", "u1", 1), ("B", "v", "u2", 2)],
    [("A", "t", "u3", 3), ("C", None, "u4", 4)],
    [("C", "", "u5", 5), ("D", "w", "u6", 6), ("old", "old", "u7", 7)],
]


def land(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame(batch, schemas.POSTINGS).coalesce(1).write.mode("append").parquet(folder)


def start(spark, tmp_path, **kwargs):
    stream = spark.readStream.schema(schemas.POSTINGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.start_new_postings(stream, str(tmp_path), f"{tmp_path}/checkpoint", **kwargs).awaitTermination()
    return snapshots.read_history(spark, f"{tmp_path}/history")


def test_stream_equals_batch_and_adds_only_unseen(spark, tmp_path):
    seed = spark.createDataFrame([("old", "old", "u", "i", "d", None, 7, True)], schemas.HISTORY)
    snapshots.append_run(seed, f"{tmp_path}/history", "seed")
    land(spark, f"{tmp_path}/in", FILES[:2])
    keys = {(r.company, r.title) for r in start(spark, tmp_path, recipient="user@example.com").collect()}
    assert keys == {("old", "old"), ("A", "t"), ("B", "v"), ("C", "")}
    land(spark, f"{tmp_path}/in", FILES[2:])
    history = start(spark, tmp_path, recipient="user@example.com").where("run <> 'seed'")
    everything = spark.createDataFrame([r for f in FILES for r in f], schemas.POSTINGS)
    batch = new_postings(everything, seed, order=["ord", "url"])
    assert sorted((r.company, r.title) for r in history.collect()) == sorted((r.company, r.title) for r in batch.collect())
    assert history.select("seq").distinct().count() == history.count()
    digests = spark.read.parquet(f"{tmp_path}/digests")
    assert digests.agg(F.sum("total")).first()[0] == history.count()


def test_streams_of_landed_pages_and_answers(spark, tmp_path):
    base = "https://page.example.com/jobs/"
    pages = [("Page", base, link("Junior A", "view/1") + link("Director", "view/2")), ("Page", base, link("Junior A", "view/3"))]
    answers = [("Api", ENDPOINT, payload("Trainee B", "Chief")), ("Api", ENDPOINT, "<html>")]
    for name, schema, rows in (("pages", schemas.PAGES, pages), ("answers", schemas.PAYLOADS, answers)):
        for row in rows:
            spark.createDataFrame([row], schema).write.mode("append").parquet(f"{tmp_path}/{name}")
    one = {"maxFilesPerTrigger": "1"}
    for name, read in (("pages", incremental.landed_pages), ("answers", incremental.landed_payloads)):
        stream = read(spark, f"{tmp_path}/{name}", **one)
        incremental.start_new_postings(stream, str(tmp_path), f"{tmp_path}/checkpoint-{name}").awaitTermination()
    found = {(r.company, r.title): r.url for r in snapshots.read_history(spark, f"{tmp_path}/history").collect()}
    assert found[("Api", "Trainee B")] == "https://t.example.com/Careers/job/0"
    assert found.pop(("Page", "Junior A")) in (f"{base}view/1", f"{base}view/3") and len(found) == 1


def test_repeated_batch_changes_nothing(spark, tmp_path):
    write = incremental.new_postings_writer(str(tmp_path), "s", "user@example.com", clock=lambda: FIRST)
    for number, batch in enumerate(FILES[:2]):
        write(spark.createDataFrame(batch, schemas.POSTINGS), number)
    before = sorted(map(tuple, snapshots.read_history(spark, f"{tmp_path}/history").collect()))
    write(spark.createDataFrame(FILES[1], schemas.POSTINGS), 1)
    assert sorted(map(tuple, snapshots.read_history(spark, f"{tmp_path}/history").collect())) == before
    assert spark.read.parquet(f"{tmp_path}/digests").agg(F.sum("total")).first()[0] == len(before)


def test_replay_under_a_moving_clock_is_the_same(spark, tmp_path):
    times = iter([FIRST, SECOND])
    write = incremental.new_postings_writer(str(tmp_path), "s", clock=lambda: next(times))
    write(spark.createDataFrame(FILES[0], schemas.POSTINGS), 0)
    before = sorted(map(tuple, snapshots.read_history(spark, f"{tmp_path}/history").collect()))
    write(spark.createDataFrame(FILES[0], schemas.POSTINGS), 0)
    assert sorted(map(tuple, snapshots.read_history(spark, f"{tmp_path}/history").collect())) == before
    assert {r[5].replace(tzinfo=None) for r in before} == {before[0][5].replace(tzinfo=None)}


def test_writers_that_begin_together_keep_their_rows_apart(spark, tmp_path):
    past = f"{tmp_path}/history"
    for run_name, company in (("one", "A"), ("two", "B")):
        rows = spark.createDataFrame([(company, t, "u", "i", "d", None, i, False) for i, t in enumerate("xy")], schemas.HISTORY)
        snapshots.append_run(rows, past, run_name)
    history = snapshots.read_history(spark, past)
    snapshots.remove_rows(history.where("company = 'A' AND seq = 0"), past)
    left = {(r.company, r.title) for r in snapshots.read_history(spark, past).collect()}
    assert left == {("A", "y"), ("B", "x"), ("B", "y")}
    write = incremental.new_postings_writer(str(tmp_path), "s", clock=lambda: FIRST)
    write(spark.createDataFrame([("A", "x", "u", 0), ("A", "y", "u", 1)], schemas.POSTINGS), 0)
    assert {r.title for r in snapshots.read_history(spark, past).where("run = 's-0'").collect()} == {"x"}, "removed: new again"


def land_inputs(spark, root, api_titles, page_titles):
    payloads = [("Api", ENDPOINT, payload(*api_titles)), ("Empty", ENDPOINT, payload("Director")), ("Broken", ENDPOINT, "<html>"), ("Stranger", ENDPOINT, payload("Junior S"))]
    html = "".join(link(t, f"view/{i}") for i, t in enumerate(page_titles)) + "<a href='/blog/x'>Junior in Pune</a>"
    pages = [(n, f"https://{n.lower()}.example.com/jobs/", html) for n in ("Api", "Empty", "Broken", "Page", "Unknown")]
    payloads, pages = spark.createDataFrame(payloads, schemas.PAYLOADS), spark.createDataFrame(pages, schemas.PAGES)
    payloads.write.mode("append").parquet(f"{root}/in/payloads")
    pages.write.mode("append").parquet(f"{root}/in/pages")
    return payloads, pages


def results(spark, root):
    history = snapshots.read_history(spark, f"{root}/history").drop("run", "seq").collect()
    sources = snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES).collect()
    digests = spark.read.parquet(f"{root}/digests").drop("run").collect()
    return [sorted(map(tuple, x), key=str) for x in (history, sources, digests)]


def test_stream_of_both_inputs_equals_the_scheduled_runs(spark, root, tmp_path_factory):
    other = str(tmp_path_factory.mktemp("stream"))
    snapshots.write_snapshot(snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES), f"{other}/sources")
    times = iter([FIRST, SECOND])
    for at, api, page in ((FIRST, ["Junior A", "Associate B"], ["Trainee C"]), (SECOND, ["Associate B", "Graduate D"], [])):
        payloads, pages = land_inputs(spark, other, api, page)
        scheduled_run(spark, root, payloads, pages, at, "user@example.com")
        stream = incremental.landed(spark, f"{other}/in/payloads", f"{other}/in/pages")
        incremental.start_runs(stream, other, f"{other}/checkpoint", "user@example.com", clock=lambda: next(times)).awaitTermination()
        assert results(spark, other) == results(spark, root)
        assert outbox.pending(spark, other).count() == 0
    assert not {"Stranger", "Unknown", "Broken"} & {r.company for r in snapshots.read_history(spark, f"{other}/history").collect()}


def test_repeated_batch_of_both_inputs_changes_nothing(spark, root):
    payloads, pages = land_inputs(spark, root, ["Junior A"], ["Trainee C"])
    null = lambda schema: F.lit(None).cast(schema)
    forms = incremental.landed(spark, f"{root}/in/payloads", f"{root}/in/pages").schema
    batch = payloads.select("company", F.struct("endpoint_url", "payload").alias("answer"), null(forms["page"].dataType).alias("page")).unionByName(
        pages.select("company", null(forms["answer"].dataType).alias("answer"), F.struct("url", "html").alias("page")))
    times = iter([FIRST, SECOND])
    write = incremental.run_writer(root, "s", "user@example.com", clock=lambda: next(times))
    write(batch, 0)
    before = results(spark, root)
    write(batch, 0)
    assert results(spark, root) == before and outbox.sent_rows(spark, root).count() == len(before[0])


def test_only_landed_sources_are_tried(spark, root):
    payloads, pages = land_inputs(spark, root, ["Junior A"], [])
    apply_run(spark, root, "r", payloads.where("company = 'Api'"), pages.where("company = 'Page'"), FIRST, -1, only_landed=True)
    after = {s.name: s.status for s in snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES).collect()}
    assert after == {"Api": "active", "Page": "active", "Empty": "unknown", "Broken": "unknown", "Quiet": "unknown"}


def test_outbox_sends_what_no_run_sent_and_only_once(spark, root):
    land = lambda at, api, to: scheduled_run(spark, root, *land_inputs(spark, root, api, []), at, to)
    land(FIRST, ["Junior A", "Associate B"], "")
    seed = spark.createDataFrame([("Old", t, "u", "i", "d", None, n, f) for n, (t, f) in enumerate([("x", True), ("y", None), ("z", False)])], schemas.HISTORY)
    snapshots.append_run(seed, f"{root}/history", "imported")
    land(SECOND, ["Graduate D"], "user@example.com")
    assert sorted(r.title for r in outbox.pending(spark, root).collect()) == ["Associate B", "Junior A", "y", "z"]
    for _ in range(2):  # a repeat sends the same documents
        send_pending(spark, root, "catch-up", "user@example.com", lines_per_document=3)
        parts = spark.read.parquet(f"{root}/digests/run=catch-up").orderBy("part").collect()
        assert [p.total for p in parts] == [4, 4] and "\n".join(p.body for p in parts).count(" @ ") == 4
        assert outbox.pending(spark, root).count() == 0 and outbox.sent_rows(spark, root).count() == 5
    send_pending(spark, root, "nothing", "user@example.com")
    assert spark.read.schema(spark.read.parquet(f"{root}/digests/run=catch-up").schema).parquet(f"{root}/digests/run=nothing").count() == 0


def test_snapshot_writers_do_not_lose_each_other(spark, root):
    path = f"{root}/sources"
    read, version = snapshots.read_version(spark, path, schemas.SOURCES)
    snapshots.write_snapshot(read.where("name <> 'Quiet'"), path, version)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(read, path, version)
    assert snapshots.read_snapshot(spark, path, schemas.SOURCES).count() == 4
    snapshots.write_snapshot(read, path)
    assert snapshots.current_version(spark, path) == version + 2


def test_stream_keys(spark, tmp_path):
    land(spark, f"{tmp_path}/in", FILES)
    stream = spark.readStream.schema(schemas.POSTINGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keys = incremental.stream_keys(stream)
    (keys.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [("A", "t"), ("B", "v"), ("C", ""), ("D", "w"), ("old", "old")]


def test_stream_keys_with_a_watermark_plan(spark, tmp_path):
    schema = "company string, title string, at timestamp"
    (tmp_path / "w").mkdir()
    keys = incremental.stream_keys(spark.readStream.schema(schema).parquet(str(tmp_path / "w")), event_time="at", forget_after="7 days")
    assert keys.isStreaming and "DeduplicateWithinWatermark" in keys._jdf.queryExecution().analyzed().toString()
