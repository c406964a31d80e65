import json

import pytest
from pyspark.sql import functions as F

from postsieve.plans.catalogue import QUERIES
from postsieve.sources import payloads, schemas, snapshots
from postsieve.sources.pages import extract_links, page_postings


def test_json_snapshots(spark, tmp_path):
    sources = [
        {"id": "a", "name": "Acme", "url": "https://a", "locked": True, "status": "active", "last_job": "", "last_checked": "2026-08-22T15:22:19.905809+00:00"},
        {"id": "b", "name": "Bell", "url": "https://b", "status": "unknown", "last_job": "X", "last_checked": ""},
        {"id": "c", "name": "Cole", "url": "https://c", "last_checked": "yesterday"},
    ]
    (tmp_path / "sources.json").write_text(json.dumps(sources, indent=2))
    rows = snapshots.scan_sources_json(spark, str(tmp_path / "sources.json")).orderBy("position").collect()
    assert [(r.name, r.locked, r.last_job, r.last_checked is None) for r in rows] == [
        ("Acme", True, None, False), ("Bell", None, "X", True), ("Cole", None, None, True),
    ]
    (tmp_path / "history.json").write_text(json.dumps([{"title": "t", "url": "u", "company": "c", "date": "Jul 15, 13:45", "id": "c_t", "notified": True}] * 2))
    history = snapshots.scan_history_json(spark, str(tmp_path / "history.json"))
    assert history.schema.fieldNames() == schemas.HISTORY.fieldNames()
    assert [(r.title, r.seq, r.date) for r in history.orderBy("seq").collect()] == [("t", 0, "Jul 15, 13:45"), ("t", 1, "Jul 15, 13:45")]
    (tmp_path / "settings.json").write_text('{\n "recipient_email": "user@example.com"\n}')
    assert snapshots.scan_settings_json(spark, str(tmp_path / "settings.json")).first()[0] == "user@example.com"


def test_missing_is_empty_but_damaged_fails(spark, tmp_path):
    missing = snapshots.scan_history_json(spark, str(tmp_path / "none.json"))
    assert missing.count() == 0 and missing.schema == schemas.HISTORY
    assert snapshots.read_history(spark, str(tmp_path / "none")).count() == 0
    assert snapshots.scan_sources_json(spark, str(tmp_path / "none.json")).count() == 0
    assert snapshots.scan_settings_json(spark, str(tmp_path / "none.json")).collect() == [("",)]
    (tmp_path / "bad.json").write_text('[{"title": "t", ')
    with pytest.raises(Exception):
        snapshots.scan_history_json(spark, str(tmp_path / "bad.json")).collect()


def test_snapshot_overwrites_what_it_reads(spark, tmp_path):
    root, schema = str(tmp_path / "s"), schemas.SETTINGS
    assert snapshots.read_snapshot(spark, root, schema).count() == 0
    snapshots.write_snapshot(spark.createDataFrame([("a",)], schema), root)
    read = snapshots.read_snapshot(spark, root, schema)
    snapshots.write_snapshot(read.select(F.concat("recipient_email", F.lit("b")).alias("recipient_email")), root)
    assert snapshots.read_snapshot(spark, root, schema).first()[0] == "ab"
    spark.createDataFrame([("half",)], schema).write.parquet(f"{root}/data/version=3")
    assert snapshots.read_snapshot(spark, root, schema).first()[0] == "ab", "an unfinished version is not read"
    snapshots.clear_snapshot(spark, root, schema)
    cleared = snapshots.read_snapshot(spark, root, schema)
    assert cleared.count() == 0 and cleared.schema == schema


def test_history_runs_replace_themselves(spark, tmp_path):
    root = str(tmp_path / "h")

    def rows(*titles):
        return spark.createDataFrame([("c", t, "u", "i", "d", None, n, False) for n, t in enumerate(titles)], schemas.HISTORY)

    snapshots.append_run(rows("a", "b"), root, "1")
    snapshots.append_run(rows("c"), root, "2")
    snapshots.append_run(rows("c"), root, "2")
    snapshots.append_run(rows(), root, "3")
    assert sorted(r.title for r in snapshots.read_history(spark, root).collect()) == ["a", "b", "c"]
    assert sorted(r.title for r in snapshots.read_history(spark, root, without_run="2").collect()) == ["a", "b"]


def test_removed_rows_leave_the_history(spark, tmp_path):
    root = str(tmp_path / "h")

    def rows(first, *titles):
        return spark.createDataFrame([("c", t, "u", "i", "d", None, first + n, False) for n, t in enumerate(titles)], schemas.HISTORY)

    def titles():
        return sorted(r.title for r in snapshots.read_history(spark, root).collect())

    snapshots.append_run(rows(0, "a", "b", "c"), root, "1")
    history = snapshots.read_history(spark, root)
    assert "Join" not in history._jdf.queryExecution().optimizedPlan().toString()
    snapshots.remove_rows(history.where("title = 'b'"), root)
    assert titles() == ["a", "c"]
    snapshots.append_run(rows(snapshots.last_seq(spark, root) + 1, "b"), root, "2")
    assert titles() == ["a", "b", "c"], "a removed posting may come again"
    snapshots.clear_history(spark, root)
    assert titles() == [] and snapshots.last_seq(spark, root) == 3
    snapshots.append_run(rows(snapshots.last_seq(spark, root) + 1, "a"), root, "3")
    assert titles() == ["a"]


def test_payloads(spark):
    endpoint = "https://t.example.com/wday/cxs/t/Careers/jobs"
    good = {"jobPostings": [{"title": "A", "locationsText": "Pune", "externalPath": "/job/1"}, {"title": None}, {}]}
    rows = [
        ("good", endpoint, json.dumps(good)), ("none", endpoint, "{}"), ("null", endpoint, None),
        ("bad", endpoint, "<html>"), ("short", "https://t.example.com", json.dumps(good)),
    ]
    df = spark.createDataFrame(rows, schemas.PAYLOADS)
    out = payloads.endpoint_postings(df).orderBy("company", "ord").collect()
    assert [tuple(r) for r in out] == [
        ("good", "A", "Pune", "/job/1", "https://t.example.com/Careers/job/1", 0),
        ("good", "", "", "", "https://t.example.com/Careers", 1),
        ("good", "", "", "", "https://t.example.com/Careers", 2),
    ]
    marked = [(r.company, r.ok, r.ord) for r in payloads.endpoint_rows(df).orderBy("company", "ord").collect()]
    assert marked == [
        ("bad", False, None), ("good", True, 0), ("good", True, 1), ("good", True, 2), ("none", True, None),
        ("null", False, None), ("short", False, None),
    ]
    assert payloads.cap_per_source(payloads.endpoint_postings(df), 1).count() == 1


HTML = """<body><A class="x" HREF='a&amp;b' title="a > b"><h3> Junior
 Analyst</h3><div>Pune <b>x</b>  <i> y</i>&#8211;&nbsp;z&#x41;</div></A>
<!-- <a href="no">n</a> --><a>bare</a><a href=un>one<a href="two">two</a><abbr href="q">x</abbr>
<script>"<a href=q>q</a>"</script><a data-href="d" href = "e"></a><a href="""


def test_links(spark):
    out = extract_links(spark.createDataFrame([(1, HTML)], "id int, html string")).orderBy("ord").collect()
    assert [(r.ord, r.href, r.text) for r in out] == [
        (0, "a&b", "Junior Analyst\nPune x y–\xa0zA"), (1, "", "bare"), (2, "un", "one"), (3, "two", "two"), (4, "e", ""),
    ]
    card = page_postings(spark.createDataFrame([("c", "u", HTML)], schemas.PAGES)).where("ord = 0").first()
    assert (card.title, card.card.count("\n")) == ("Junior Analyst", 1)


@pytest.mark.parametrize("html", ["<a " * 100_000, "<a>" + "<b " * 100_000, "<!--" * 100_000, "<a href='" + "q=\"' " * 100_000 + ">x</a>", "<a>" + "x <b> " * 100_000 + "</a>"])
def test_hostile_pages_end(spark, html):
    assert extract_links(spark.createDataFrame([(1, html)], "id int, html string")).count() <= 1


@pytest.mark.parametrize("code", range(1, 128))
def test_numbered_references_are_literal(spark, code):
    forms = [f"&#{code};", f"&#x{code:x};", f"&#X{code:X};", f"&#{code:010d};", f"&#x{code:08x};"]
    html = "<a href='/x'>" + "".join(f"({f})" for f in forms) + "</a>"
    text = extract_links(spark.createDataFrame([(1, html)], "id int, html string")).first()["text"]
    assert text == f"({chr(code)})" * len(forms)


def test_references_of_all_kinds(spark):
    html = "<a href='/x?a=1&amp;b=&#36;1'>f&uuml;r M&eacute;tro &#1114111;&#0;&#xD800;&#99999999999; &amp;lt; &nosuch; <svg><title>icon</title></svg><table><tr><td>Junior</td><td>Pune</td></tr></table></a>"
    row = extract_links(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert row["href"] == "/x?a=1&b=$1"
    assert row["text"] == "f\u00fcr M\u00e9tro \U0010ffff\ufffd\ufffd\ufffd &lt; &nosuch;\nJunior\tPune"


def test_fields_of_a_link_are_cut_out_once(spark):
    pages = spark.createDataFrame([(1, '<a href="/x?a=1&amp;b=2">&eacute;&#36;&Tab;&nosuch;&#x24;</a>')], "id int, html string")
    links = extract_links(pages)
    assert [(r.href, r.text) for r in links.collect()] == [("/x?a=1&b=2", "é$\t&nosuch;$")]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\shref\s*=") == 3, "one for each kind of quotes"


def test_links_of_a_small_file_are_made_in_several_tasks(spark):
    plan = QUERIES["link_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(p_partkey")
