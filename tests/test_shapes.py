"""Endpoint answers of several shapes."""

import json

import pytest

from postsieve.plans.run import Vocabulary, screened_endpoint_rows
from postsieve.sources.payloads import endpoint_rows
from postsieve.sources.shapes import LISTED, Shape, shaped_rows, unread_fields

NESTED = Shape("nested", "$.jobs", "$.title", "$.place.name", "$.link")
BARE = Shape("bare", "$", "$.text", "$.where", "$.href")
SHAPES = (LISTED, NESTED, BARE)
ENDPOINT = "https://x.example.com/api/x/Careers/jobs"


def answers(spark, *payloads, endpoint=ENDPOINT):
    rows = [(f"c{i}", endpoint, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "company string, endpoint_url string, payload string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_three_shapes_in_one_pass(spark):
    found = shaped_rows(answers(
        spark,
        {"jobPostings": [{"title": "A", "locationsText": "Here", "externalPath": "/job/1"}, {"title": "B"}]},
        {"total": 1, "jobs": [{"title": "C", "place": {"name": "There"}, "link": "https://y.example.org/p?q=1"}]},
        [{"text": "D", "where": None, "href": "/b/2"}],
    ), SHAPES)
    assert rows_of(found, "company", "ok", "shape", "ord", "title", "location", "url") == [
        ("c0", True, "listed", 0, "A", "Here", "https://x.example.com/Careers/job/1"),
        ("c0", True, "listed", 1, "B", "", "https://x.example.com/Careers"),
        ("c1", True, "nested", 0, "C", "There", "https://y.example.org/p?q=1"),
        ("c2", True, "bare", 0, "D", "", "https://x.example.com/b/2"),
    ]


@pytest.mark.parametrize("payload", [
    None, "", "<html>", "{", {}, [], 5, {"jobPostings": None}, {"jobPostings": 7}, {"jobPostings": []}, {"jobPostings": {"a": 1}},
    {"jobPostings": [None, {}, {"title": 12, "locationsText": True}, {"title": None}]},
    {"jobPostings": [{"title": "é & <b>", "externalPath": "", "more": {"deep": [1, {"a": None}]}}]},
])
def test_listed_shape_equals_the_plain_reader(spark, payload):
    if payload in ([], 5) or payload == {"jobPostings": {"a": 1}} or payload == {"jobPostings": 7}:
        # The plain reader takes a wrong type as unreadable; here the answer is read and has no shape.
        found = shaped_rows(answers(spark, payload), (LISTED,))
        assert rows_of(found, "ok", "ord", "shape") == [(True, None, None)]
        return
    columns = ("company", "ok", "title", "location", "href", "url", "ord")
    given = answers(spark, payload)
    mine, plain = rows_of(shaped_rows(given), *columns), rows_of(endpoint_rows(given), *columns)
    assert [(r[0], r[1], *r[2:5], r[6]) for r in mine] == [(r[0], r[1], *r[2:5], r[6]) for r in plain]
    assert [r[5] for r in mine if r[6] is not None] == [r[5] for r in plain if r[6] is not None]


def test_an_endpoint_without_a_site_fails_only_where_the_shape_needs_one(spark):
    given = answers(spark, {"jobPostings": [{"title": "A"}]}, {"jobs": [{"title": "B", "link": "/z"}]}, endpoint="https://x.example.com")
    found = shaped_rows(given, SHAPES)
    assert rows_of(found, "company", "ok", "title", "url") == [
        ("c0", False, "", None), ("c1", True, "B", "https://x.example.com/z"),
    ]


def test_records_stay_whole_and_unread_fields_are_counted(spark):
    found = shaped_rows(answers(
        spark, {"jobs": [{"title": "A", "pay": {"low": 3}}, {"title": "B", "pay": None, "team": "x"}, "text", None]}, [{"text": "C", "id": 9}],
    ), SHAPES)
    low = found.selectExpr("try_variant_get(record, '$.pay.low', 'int') AS low", "title")
    assert rows_of(low, "title", "low") == [("", None), ("", None), ("A", 3), ("B", None), ("C", None)]
    assert rows_of(unread_fields(found, SHAPES), "shape", "field", "n") == [("bare", "id", 1), ("nested", "pay", 2), ("nested", "team", 1)]


def test_a_key_twice_keeps_the_last(spark):
    found = shaped_rows(answers(spark, '{"jobPostings":[{"title":"A","title":"B"}]}'))
    assert rows_of(found, "ok", "title") == [(True, "B")]


def test_shapes_go_through_the_screens_of_a_run(spark):
    given = answers(spark, {"jobs": [{"title": "data job", "place": {"name": "Here"}, "link": "/1"}, {"title": "other", "link": "/2"}]}, "<html>")
    words = Vocabulary(include=["data"], veto=[], places=["here"])
    kept = screened_endpoint_rows(given, words, SHAPES)
    assert rows_of(kept, "company", "ok", "title", "url") == [("c0", True, "data job", "https://x.example.com/1"), ("c1", False, "", None)]
    assert kept.columns == endpoint_rows(given).columns


def test_names_of_shapes_are_unique(spark):
    with pytest.raises(ValueError):
        shaped_rows(answers(spark, {}), (LISTED, LISTED))
