import random
from datetime import datetime, timedelta, timezone
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from postsieve.functions import labels, text, urls

BLANKS = [" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "　", "​"]


def test_strip_and_first_line_agree_with_python(values):
    rng = random.Random(3)
    texts = ["", " ", "a"] + ["".join(rng.choice([*BLANKS, "a", "b é", "日"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert values(text.strip, texts) == [t.strip() for t in texts]
    expected = [t.strip().splitlines()[0].strip() if t.strip() else "" for t in texts]
    assert values(text.first_line, texts) == expected


def test_small_text_helpers(values):
    assert values(text.shorten, ["x" * 50, "x" * 51, "é" * 60, None]) == ["x" * 50, "x" * 50 + "…", "é" * 50 + "…", ""]
    assert values(text.placeholder, ["", None, "a"]) == ["—", "—", "a"]
    assert values(text.initial, ["acme", "élan", ""]) == ["A", "É", ""]
    assert values(text.match_text, ["t", None], ["l", "l"]) == ["t l", " l"]
    assert values(text.place_text, ["", None, "Pune"], ["t", "t", "t"]) == ["t", "t", "Pune"]


def _resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    rows = urls.resolve_links(df, "b", "h").collect()
    return [r.url for r in sorted(rows, key=lambda r: r.i)]


def test_links_golden(spark):
    base = "https://h.com/a/b"
    golden = {
        "c": "https://h.com/a/c", "/c": "https://h.com/c", "//o.com/x": "https://o.com/x",
        "?q=1": "https://h.com/a/b?q=1", "#f": "https://h.com/a/b#f", "": base,
        "mailto:x@y": "mailto:x@y", "job/123": "https://h.com/a/job/123",
    }
    assert _resolved(spark, [(base, h) for h in golden]) == list(golden.values())
    assert _resolved(spark, [("https://h.com/a/b/c", "../../../../x")]) == ["https://h.com/x"]


def _url_vectors(n):
    rng = random.Random(11)
    tokens = ["a", "b", "..", ".", "/", "/", "//", "?q=1", "#f", "http:", "https:", "h.com", "x y", "mailto:", "www.", ":", "?", "#", "é", " ", "@", ":80"]
    bases = ["https://h.com/a/b", "https://h.com", "http://h.com/a/b/c/?x=1#z", "https://H.com/a//b/../c", "HTTPS://u@h.com:8/a/"]
    return [(rng.choice(bases), "".join(rng.choice(tokens) for _ in range(rng.randint(0, 6)))) for _ in range(n)]


def test_links_agree_with_the_standard_library(spark):
    pairs = []
    for b, h in _url_vectors(4000):
        try:
            pairs.append((b, h, urljoin(b, h) if h else b))
        except ValueError:
            continue
    assert _resolved(spark, [p[:2] for p in pairs]) == [p[2] for p in pairs]


def test_host_agrees_with_the_standard_library(values):
    texts = [b + h for b, h in _url_vectors(2000)] + ["https://a.www.b.com/", "http://user@www.h.com:80/", "h.com/x", "", "http://[x/"]

    def expected(u):
        try:
            return urlparse(u).netloc.replace("www.", "")
        except ValueError:
            return u

    assert values(urls.host_of, texts) == [expected(u) for u in texts]


def test_site_base(values):
    texts = [
        "https://t.example.com/wday/cxs/t/Careers/jobs", "https://t.example.com/wday/Careers/jobs//",
        "https://t.example.com/jobs", "https://t.example.com",
    ]
    assert values(urls.site_base, texts) == [
        "https://t.example.com/Careers", "https://t.example.com/Careers", "https://t.example.com/", None,
    ]
    assert values(urls.posting_url, ["https://x/S", "https://x/S"], ["/job/1", None]) == ["https://x/S/job/1", "https://x/S"]


def test_ids_and_keys(values):
    title = "Junior Associate - Evidence Synthesis, Clinical Outcome assessments (COA)"
    assert values(labels.posting_id, ["A co", "B"], [title, "–" * 50]) == [
        "A_co_Junior_Associate_-_Evidence_Synthesis,_C", "B_" + "–" * 40,
    ]
    assert values(labels.row_key, ["", None, "k"], ["c", None, "c"], ["t", "t", "t"]) == ["c_t", "_t", "k"]
    assert values(labels.status_label, ["broken", "active", "unknown", None]) == ["Broken", "Active", "Pending", "Pending"]


def test_display_date_and_age(spark):
    now = datetime(2026, 7, 5, 12, 0, 0, tzinfo=timezone.utc)
    cases = {
        timedelta(hours=8, minutes=56): "8h ago", timedelta(seconds=59, microseconds=999_999): "just now",
        timedelta(seconds=60): "1 min ago", timedelta(seconds=3599): "59 min ago", timedelta(hours=1): "1h ago",
        timedelta(hours=24): "1d ago", timedelta(days=12, hours=23): "12d ago", -timedelta(days=2): "just now",
    }
    df = spark.createDataFrame([(i, now - d) for i, d in enumerate(cases)], "i int, ts timestamp")
    out = df.select("i", labels.relative_age("ts", now).alias("age"), labels.display_date("ts").alias("day")).collect()
    out.sort(key=lambda r: r.i)
    assert [r.age for r in out] == list(cases.values())
    assert out[0].day == "Jul 5, 03:04"


def test_age_of_stored_text(values):
    now = datetime(2026, 8, 22, 16, 22, 20, tzinfo=timezone.utc)
    texts = ["2026-08-22T15:22:19.905809+00:00", "2026-08-22T15:22:19Z", "2026-08-22T20:52:19+05:30", "", None, "soon", "2026-08-22T15:22:19"]
    expected = ["1h ago", "1h ago", "1h ago", "—", "—", "soon", "2026-08-22T15:22:19"]
    assert values(lambda c: labels.relative_age_of_text(c, now), texts) == expected


def test_page_label(spark):
    row = spark.range(1).select(labels.page_label(F.lit(20), 10, F.lit(23)).alias("v")).first()
    assert row.v == "21–23 of 23"
