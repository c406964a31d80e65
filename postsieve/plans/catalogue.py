"""Every operator as a query over the given tables.

The tables play these roles: ``documents`` are posting cards (language = source, first line =
title), the ``labels`` rows among them are the history; ``pages`` are captured pages; ``part`` holds
short titles; ``supplier``, ``customer`` and ``nation`` are sources; ``events`` are attempts to reach
them; ``orders`` are history rows with a sequence number. Word lists fit the words of the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions import labels, matching, text, urls
from postsieve.operators import dedup, edits, report, screens, state, terms
from postsieve.plans.run import Vocabulary, new_to_history
from postsieve.plans.run import scheduled_run as scheduled_run_once
from postsieve.plans.run import send_pending
from postsieve.session import fresh_dir, use_utc
from postsieve.sources import pages as page_source
from postsieve.sources import payloads as payload_source
from postsieve.sources import outbox, schemas, shapes, snapshots
from postsieve.streaming import attempts as attempt_stream
from postsieve.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime(2024, 1, 15, 12, 0, 0, tzinfo=timezone.utc)

CARD_INCLUDE, CARD_VETO = ["the", "que", "der"], ["license", "copyright"]
PART_INCLUDE, PART_VETO, PART_PLACES = ["widget", "ring", "promo"], ["old"], ["economy", "promo", "small"]
LINK_INCLUDE, LINK_VETO = ["the", "que", "der", "la", "of"], ["license"]
LINK_PATH_WORDS = ["fr", "de"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_cards(docs: DataFrame) -> DataFrame:
    """Documents as posting cards."""
    return docs.select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("company"),
        text.first_line("text").alias("title"), F.col("text").alias("card"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_cards(table(spark, sf_dir, "documents"))


def screened_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screens.screen_page_rows(
        cards(spark, sf_dir), href=None, include=CARD_INCLUDE, veto=CARD_VETO, places=None
    )
    return rows.select("company", "title", "ord")


def card_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the labelled documents: what earlier runs reported."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    return cards(spark, sf_dir).join(labelled, "ord").select(
        "company", "title", "ord", (F.col("quality") == 1).alias("notified")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("checked_at"),
        (F.col("event_type") != "error").alias("ok"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.extract_links(
        table(spark, sf_dir, "pages").select("page_id", "url", "html")
    )


# Scans and sources


@query
def scan_sources(spark, sf_dir):
    schema = T.StructType([
        T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
        T.StructField("s_nationkey", T.IntegerType()),
    ])
    return spark.read.schema(schema).parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )


@query
def flatten_payload(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"jobPostings":['), "props", F.lit(",{}]}")).alias("payload")
    )
    return payload_source.flatten_records(events, "payload", payload_source.LIST_FIELD, {"k": "int"}, {"k": -1})


@query
def endpoint_postings(spark, sf_dir):
    """Endpoint answers from end to end: parse, flatten, build the address, screen."""
    answers = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("company"),
        F.concat(
            F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
            F.lit(".example.com/api/v1/"), F.lower("p_type"), F.lit("/jobs/"),
        ).alias("endpoint_url"),
        F.to_json(F.struct(F.array(F.struct(
            F.col("p_name").alias("title"),
            F.when(F.col("p_size") >= 10, F.col("p_type")).alias("locationsText"),
            F.concat(F.lit("/job/"), "p_partkey").alias("externalPath"),
        )).alias("jobPostings"))).alias("payload"),
    )
    rows = payload_source.endpoint_postings(answers)
    kept = screens.screen_endpoint_rows(rows, include=PART_INCLUDE, veto=PART_VETO, places=PART_PLACES)
    return kept.select("company", "title", "url", "ord")


#: Three kinds of endpoints: the listed one, one with nested places and absolute addresses, one that is a bare list.
SHAPES = (
    shapes.LISTED,
    shapes.Shape("nested", "$.jobs", "$.title", "$.location.name", "$.absolute_url"),
    shapes.Shape("bare", "$", "$.text", "$.categories.location", "$.hostedUrl"),
)


def _shaped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as endpoint answers of the three shapes by their size, with fields no shape reads; those of Brand#20 cannot be read."""
    title, place, number = F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string")
    listed = F.to_json(F.struct(F.array(F.struct(
        title.alias("title"), place.alias("locationsText"), F.concat(F.lit("/job/"), number).alias("externalPath"), F.col("p_size").alias("size"),
    )).alias("jobPostings")))
    nested = F.to_json(F.struct(F.array(F.struct(
        title.alias("title"), F.struct(place.alias("name")).alias("location"),
        F.concat(F.lit("https://other.example.com/n/"), number).alias("absolute_url"), F.struct(F.col("p_brand").alias("brand")).alias("team"),
    )).alias("jobs")))
    bare = F.to_json(F.array(F.struct(
        F.col("p_partkey").alias("text"), F.struct(place.alias("location")).alias("categories"), F.concat(F.lit("/b/"), number).alias("hostedUrl"),
        F.lit("full").alias("commitment"), F.col("p_size").alias("size"),
    )))
    payload = F.when(F.col("p_brand") == "Brand#20", F.lit("<html>")).when(F.col("p_size") % 3 == 0, listed).when(F.col("p_size") % 3 == 1, nested).otherwise(bare)
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("company"), F.lit("https://t.example.com/api/t/Careers/jobs").alias("endpoint_url"), payload.alias("payload"),
    )


@query
def shaped_postings(spark, sf_dir):
    """Answers of three shapes in one pass, failed ones marked, with a field that no shape reads."""
    rows = shapes.shaped_rows(_shaped_answers(spark, sf_dir), SHAPES)
    return rows.select(
        "company", "ok", "title", "location", "url", "ord", "shape", F.try_variant_get("record", "$.size", "bigint").alias("size"),
        F.try_variant_get("record", "$.team.brand", "string").alias("brand"),
    )


@query
def unread_fields(spark, sf_dir):
    """How many records hold fields that their shape does not read."""
    return shapes.unread_fields(shapes.shaped_rows(_shaped_answers(spark, sf_dir), SHAPES), SHAPES)


@query
def extract_links(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "ord", "href", "text")


@query
def page_postings(spark, sf_dir):
    """Captured pages from end to end: links, titles, screens, addresses."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    captured = pages.select(urls.host_of("url").alias("company"), "url", "html")
    kept = screens.screen_page_rows(
        page_source.page_postings(captured), include=LINK_INCLUDE, veto=LINK_VETO, places=None,
    )
    return urls.resolve_links(kept, "page_url", "href").select("company", "title", "url", "ord")


@query
def link_text(spark, sf_dir):
    """Links made from parts, with references in every spelling and texts in table cells."""
    spellings = ["&#x24;", "&#36;", "&#X5c;", "&#0000092;", "&eacute;", "&#00000233;", "&uuml;", "&#xD800;"]
    spelling = F.element_at(F.array(*[F.lit(s) for s in spellings]), F.col("p_size") % 8 + 1)
    html = F.concat(
        F.lit('<a href="/p/'), "p_partkey", F.lit('?a=1&amp;b=2"><table><tr><td>'), spelling, F.lit(" "), "p_name",
        F.lit("</td><td>"), "p_type", F.lit("</td></tr></table><svg><title>icon</title></svg></a>"),
    )
    # A small file of short rows would be one task, and the links cost much more than reading it.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type").repartition("p_partkey")
    made = parts.select("p_partkey", html.alias("html"))
    return page_source.extract_links(made).select("p_partkey", "href", "text")


@query
def cap_per_source(spark, sf_dir):
    capped = payload_source.cap_per_source(page_links(spark, sf_dir), 3)
    return capped.groupBy("page_id").agg(F.count("*").alias("n_links"))


# Projections


@query
def first_line_title(spark, sf_dir):
    return cards(spark, sf_dir).select("ord", "title")


@query
def site_base(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.site_base("url").alias("base"))


@query
def resolve_links(spark, sf_dir):
    """Links rewritten, by their place in the page, to root-relative, page-relative, dotted, query-only,
    scheme-relative and absolute form."""
    bare = F.substr("href", F.lit(2))
    form = (
        F.when(F.col("ord") == 1, bare)
        .when(F.col("ord") == 2, F.concat(F.lit("../"), bare))
        .when(F.col("ord") == 3, F.concat(F.lit("?q="), bare))
        .when(F.col("ord") == 4, F.concat(F.lit("//other.example.org/"), bare))
        .when(F.col("ord") == 5, F.concat(F.lit("mailto:"), bare))
        .otherwise(F.col("href"))
    )
    links = page_links(spark, sf_dir).select("page_id", "url", "ord", form.alias("href"))
    return urls.resolve_links(links, "url", "href", "target").select("page_id", "ord", "target")


@query
def posting_id(spark, sf_dir):
    return cards(spark, sf_dir).select("ord", labels.posting_id("company", "title").alias("id"))


@query
def display_date(spark, sf_dir):
    found = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.display_date(found).alias("shown"))


@query
def host_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host_of("url").alias("host"))


@query
def relative_age(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", labels.relative_age("checked_at", NOW).alias("age"))


@query
def status_label(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "broken").when(kind.isin("view", "click"), "active").otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", labels.status_label(status).alias("label"))


@query
def shorten_text(spark, sf_dir):
    return cards(spark, sf_dir).select("ord", text.shorten("title").alias("short"))


@query
def row_key(spark, sf_dir):
    stored = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", labels.row_key(stored, "p_type", "p_name").alias("key"))


# Screens


@query
def term_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(matching.has_term("p_name", PART_INCLUDE)).select("p_partkey", "p_name")


def _benchmark_terms(spark, sf_dir):
    """The first two words of every benchmark text, where a blank parts them, as a term table."""
    first_two = F.regexp_extract("text", r"^(\p{L}+ \p{L}+)", 1)
    return terms.term_table(table(spark, sf_dir, "benchmark").select(first_two.alias("term")))


@query
def term_table_match(spark, sf_dir):
    """Documents with one of many terms, which are a table themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return terms.with_terms(docs, _benchmark_terms(spark, sf_dir), "doc_id").select("doc_id")


@query
def term_table_veto(spark, sf_dir):
    """Documents with none of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return terms.without_terms(docs, _benchmark_terms(spark, sf_dir), "doc_id").select("doc_id")


@query
def term_veto(spark, sf_dir):
    return table(spark, sf_dir, "part").where(matching.lacks_term("p_name", ["old", "cold"])).select("p_partkey", "p_name")


@query
def level_screen(spark, sf_dir):
    keep = matching.level_ok("p_name", PART_INCLUDE, ["old", "cold"])
    return table(spark, sf_dir, "part").where(keep).select("p_partkey", "p_name")


@query
def place_screen(spark, sf_dir):
    return table(spark, sf_dir, "part").where(matching.place_ok("p_name", ["red", "blue"])).select("p_partkey", "p_name")


@query
def headline_screen(spark, sf_dir):
    title = (
        F.when(F.col("p_size") > 35, F.concat("p_name", F.lit(": x")))
        .when(F.col("p_size") > 30, F.concat(F.lit("Meet "), "p_name"))
        .when(F.col("p_size") > 25, F.concat("p_name", F.lit(":x")))
        .otherwise(F.concat(F.lit("Meeting "), "p_name"))
    )
    titles = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return titles.where(matching.not_headline("title"))


@query
def url_path_screen(spark, sf_dir):
    keep = matching.not_article_path("url", LINK_PATH_WORDS)
    return table(spark, sf_dir, "pages").where(keep).select("page_id", "url")


@query
def screen_api_rows(spark, sf_dir):
    location = F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), location.alias("location"), F.lit("").alias("href")
    )
    kept = screens.screen_endpoint_rows(rows, include=PART_INCLUDE, veto=PART_VETO, places=PART_PLACES)
    return kept.select("p_partkey", "title", "location")


@query
def screen_page_rows(spark, sf_dir):
    return screened_cards(spark, sf_dir)


@query
def default_screens(spark, sf_dir):
    """The default word lists over titles built from part sizes and names, places from part types."""
    size = F.col("p_size")
    title = F.concat(
        F.when(size < 5, "Associate ").when(size < 10, "Associate Director, ").when(size < 14, "Sr Associate ")
        .when(size < 18, "Sr. Associate ").when(size < 22, "Campus hire 0-1 year ").when(size < 26, "Internal ")
        .when(size < 30, "New Grad 3+ year ").when(size < 34, "VP, Graduate ").when(size < 38, "Internships ")
        .when(size < 42, "Meet the trainee ").when(size < 46, "Recent Graduate: ").otherwise("junior_"),
        F.col("p_name"),
    )
    place = (
        F.when(F.col("p_type") == "PROMO", "Navi Mumbai").when(F.col("p_type") == "SMALL", "PUNE, IN")
        .when(F.col("p_type") == "LARGE", "Indiana").when(F.col("p_type") == "ECONOMY", "")
        .otherwise("Delhi/Noida")
    )
    href = F.when(F.col("p_brand") == "Brand#7", "/blogs/x").otherwise(F.concat(F.lit("/job/"), "p_partkey"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", title.alias("title"), place.alias("location"), href.alias("href")
    )
    return screens.screen_endpoint_rows(rows).select("p_partkey", "title", "location")


@query
def email_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", matching.count_emails("text").alias("n_emails"))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.when(F.col("s_acctbal") < 0, F.lit(" \t")).otherwise(
            F.concat(F.lit(" Source "), F.col("s_nationkey"))
        ).alias("name"),
        F.when(F.col("s_acctbal") > 9000, F.lit("ftp://x")).otherwise(
            F.concat(F.lit("https://example.com/"), F.col("s_suppkey"))
        ).alias("url"),
    )


def _tracked(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 0).select(
        F.concat(F.lit("SOURCE "), F.col("n_nationkey")).alias("name")
    )


@query
def validate_sources(spark, sf_dir):
    return edits.validate_sources(_candidates(spark, sf_dir), _tracked(spark, sf_dir))


@query
def add_sources(spark, sf_dir):
    """The sources table rows of the accepted candidates."""
    checked = edits.validate_sources(_candidates(spark, sf_dir), _tracked(spark, sf_dir))
    return edits.accepted_sources(checked).select("position", "id", "name", "url", "locked", "status")


# Joins


@query
def new_postings(spark, sf_dir):
    """Flagship: screened cards, the first of each (source, title), without those in the history."""
    return dedup.new_postings(screened_cards(spark, sf_dir), card_history(spark, sf_dir))


@query
def probe_new_postings(spark, sf_dir):
    """The same for a stored batch and a large history: the checked batch keys go to the history."""
    staged = fresh_dir(spark, "firsts")
    firsts = dedup.keep_first(dedup.normal_keys(screened_cards(spark, sf_dir)))
    firsts.write.parquet(staged)
    stored = spark.read.schema(firsts.schema).parquet(staged)
    return dedup.probe_new_postings(stored, card_history(spark, sf_dir))


@query
def endpoint_lookup(spark, sf_dir):
    endpoints = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 0).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("endpoint")
    )
    sources = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return state.endpoint_lookup(sources, endpoints, "s_nationkey").select("s_suppkey", "endpoint")


@query
def fallback_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    low = orders.where(F.col("o_orderpriority") == "5-LOW")
    return dedup.fallback_rows(urgent, low, "o_custkey")


def _in_debt(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))


@query
def delete_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return edits.delete_by_key(orders, _in_debt(spark, sf_dir), "o_custkey").select("o_orderkey", "o_custkey")


@query
def select_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return edits.select_by_key(orders, _in_debt(spark, sf_dir), "o_custkey").select("o_orderkey", "o_custkey")


@query
def merge_source_state(spark, sf_dir):
    """Customers as sources, their orders as attempts (urgent = failed) and, when final, as postings."""
    sources = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("name"), F.lit("unknown").alias("status"),
        F.col("c_mktsegment").alias("last_job"), F.lit(None).cast("timestamp").alias("last_checked"),
    )
    orders = table(spark, sf_dir, "orders")
    tried = orders.select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("at"),
        (F.col("o_orderpriority") != "1-URGENT").alias("ok"),
    )
    found = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("ord")
    )
    statuses = state.source_status(tried, "name", "at").select("name", "status")
    merged = state.merge_source_state(sources, statuses, state.first_title(found, "name"), NOW)
    return merged.select(
        F.col("name").alias("c_custkey"), "status", "last_job", F.unix_micros("last_checked").alias("last_checked_us")
    )


def _tried_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as sources, every fifth one checked at the start of 1998; their orders as attempts, urgent ones failed, final ones with a title."""
    key = F.col("c_custkey")
    seen = F.when(key % 5 == 0, F.lit("1998-01-01").cast("timestamp"))
    sources = table(spark, sf_dir, "customer").select(
        key.alias("position"), key.cast("string").alias("id"), key.cast("string").alias("name"), F.lit("").alias("url"), F.lit(True).alias("locked"),
        F.lit("unknown").alias("status"), F.col("c_mktsegment").alias("last_job"), seen.alias("last_checked"),
    )
    tried = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company"), F.col("o_orderdate").cast("timestamp").alias("checked_at"),
        (F.col("o_orderpriority") != "1-URGENT").alias("ok"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("title"),
        F.col("o_orderkey").alias("number"),
    )
    return sources, tried


def _checked_customers(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("position").alias("c_custkey"), "status", "last_job", F.unix_micros("last_checked").alias("last_checked_us"))


@query
def merge_latest(spark, sf_dir):
    """Each attempt has an instant of its own, and a source keeps a state that is newer than all of its attempts."""
    sources, tried = _tried_customers(spark, sf_dir)
    return _checked_customers(state.merge_latest(sources, state.latest_attempts(tried)))


# Aggregations and windows


@query
def count_per_source(spark, sf_dir):
    return state.count_per_source(screened_cards(spark, sf_dir))


@query
def first_title(spark, sf_dir):
    return state.first_title(screened_cards(spark, sf_dir))


@query
def source_status(spark, sf_dir):
    found = state.source_status(attempts(spark, sf_dir), "user_id")
    return found.select("user_id", "status", F.unix_micros("last_checked").alias("last_checked_us"))


@query
def latest_check(spark, sf_dir):
    top = report.latest_check(attempts(spark, sf_dir), datetime(2024, 2, 15, tzinfo=timezone.utc), "checked_at")
    return top.select(F.unix_micros("latest_check").alias("latest_us"), "age")


@query
def responding_count(spark, sf_dir):
    return report.responding_count(state.source_status(attempts(spark, sf_dir), "user_id"))


@query
def source_board(spark, sf_dir):
    """Suppliers as sources; status and last check from the attempts, last title from the parts."""
    checked = state.source_status(attempts(spark, sf_dir), "user_id")
    titles = table(spark, sf_dir, "part").where(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("last_job")
    )
    slug = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    sources = (
        table(spark, sf_dir, "supplier")
        .join(checked.withColumnRenamed("user_id", "s_suppkey"), "s_suppkey", "left")
        .join(titles, "s_suppkey", "left")
        .select(
            F.col("s_name").alias("name"),
            F.concat(F.lit("https://www."), slug, F.lit(".example.com/careers")).alias("url"),
            "status", "last_job", "last_checked", (F.col("s_acctbal") > 5000).alias("locked"),
        )
    )
    return report.source_board(sources, NOW)


def _alert_rows(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("user"), "o_custkey", F.lit("@example.com")).alias("recipient"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("company"),
        F.concat(F.lit("https://example.com/?a=1&b="), "o_orderkey").alias("url"),
        labels.display_date(F.col("o_orderdate").cast("timestamp")).alias("date"),
    )


@query
def alert_digest(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return report.alert_digest(_alert_rows(urgent), lines_per_document=4)


@query
def pending_alerts(spark, sf_dir):
    """Open orders are the rows not notified yet, and customers in debt were told before."""
    history = table(spark, sf_dir, "orders").withColumn(
        "notified", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    )
    told = edits.select_by_key(history, _in_debt(spark, sf_dir), "o_custkey").select("o_orderkey")
    waiting = report.pending_alerts(history, told, "o_orderkey")
    return report.alert_digest(_alert_rows(waiting)).select("recipient", "part", "total", "subject", "body")


@query
def mark_notified(spark, sf_dir):
    history = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("notified")
    )
    told = edits.select_by_key(history, _in_debt(spark, sf_dir), "o_custkey")
    return report.mark_notified(history, told, "o_orderkey")


@query
def joined_names(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    return report.joined_names(suppliers, ["s_nationkey"], "s_name", "s_suppkey", per_part=3)


@query
def run_summary(spark, sf_dir):
    return report.run_summary(screened_cards(spark, sf_dir), card_history(spark, sf_dir), dedup.KEY)


@query
def keep_first(spark, sf_dir):
    return dedup.keep_first(cards(spark, sf_dir).select("company", "title", "ord"))


# Paging


@query
def history_page(spark, sf_dir):
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderpriority")
    return report.history_page(history, 2)


@query
def page_label(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    return report.page_labels(counts, "total", page=1)


# Set operations


@query
def append_history(spark, sf_dir):
    history = card_history(spark, sf_dir)
    new = dedup.new_postings(screened_cards(spark, sf_dir), history)
    return dedup.append_rows(history, new).select("company", "title", "ord", "notified")


def _as_history(rows: DataFrame) -> DataFrame:
    """Cards (company, title, ord, notified) as history rows numbered by ``ord``."""
    return rows.select(
        "company", "title", F.lit("").alias("url"), F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("date"), F.lit(None).cast("timestamp").alias("found_at"),
        F.col("ord").alias("seq"), "notified",
    )


def _history_of(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.read_history(spark, root).select("company", "title", "seq", "run")


@query
def remove_history(spark, sf_dir):
    """Two runs that gave the same numbers; the notified rows of the first are removed."""
    root = fresh_dir(spark, "removals")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), root, "first")
    everything = cards(spark, sf_dir).withColumn("notified", F.lit(False))
    snapshots.append_run(_as_history(everything), root, "second")
    snapshots.remove_rows(snapshots.read_history(spark, root).where("run = 'first' AND notified"), root)
    return _history_of(spark, root)


@query
def clear_history(spark, sf_dir):
    """A history that is cleared and then gets a run with numbers used before."""
    root = fresh_dir(spark, "cleared")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), root, "first")
    snapshots.clear_history(spark, root)
    snapshots.append_run(_as_history(screened_cards(spark, sf_dir).withColumn("notified", F.lit(False))), root, "second")
    return _history_of(spark, root)


def _merged_history(spark: SparkSession, sf_dir: str) -> str:
    """Two runs merged, less the notified rows of the first; then a third run and, of the second run, the rows with a number divisible by 3 removed."""
    root = fresh_dir(spark, "merged")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), root, "first")
    snapshots.append_run(_as_history(cards(spark, sf_dir).withColumn("notified", F.lit(False))), root, "second")
    snapshots.remove_rows(snapshots.read_history(spark, root).where("run = 'first' AND notified"), root)
    snapshots.merge_runs(spark, root, buckets=8)
    snapshots.append_run(_as_history(screened_cards(spark, sf_dir).withColumn("notified", F.lit(False))), root, "third")
    snapshots.remove_rows(snapshots.read_history(spark, root).where("run = 'second' AND seq % 3 = 0"), root)
    return root


@query
def merge_runs(spark, sf_dir):
    """The history after a merge, a later run, later removals and a second merge."""
    root = _merged_history(spark, sf_dir)
    snapshots.merge_runs(spark, root)
    return _history_of(spark, root)


@query
def merged_page(spark, sf_dir):
    """A page of the history while one run lies beside the merged ones; numbers of the runs meet, so the page is of one run."""
    history = snapshots.read_history(spark, _merged_history(spark, sf_dir)).where("run = 'second'")
    return report.history_page(history.select("seq", "company", "title"), 2)


@query
def new_to_merged(spark, sf_dir):
    """Every card as a batch against a merged history of the labelled cards, by its buckets, and an unmerged run of half of the screened ones."""
    root = fresh_dir(spark, "new-to-merged")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), f"{root}/history", "first")
    snapshots.merge_runs(spark, f"{root}/history", buckets=8)
    half = screened_cards(spark, sf_dir).where("ord % 2 = 0").withColumn("notified", F.lit(False))
    snapshots.append_run(_as_history(half), f"{root}/history", "second")
    firsts = dedup.keep_first(dedup.normal_keys(cards(spark, sf_dir).select("company", "title", "ord")))
    firsts.write.parquet(f"{root}/firsts")
    stored = spark.read.schema(firsts.schema).parquet(f"{root}/firsts")
    return new_to_history(stored, f"{root}/history", "third", limit=0)


# The whole run


RUN_WORDS = Vocabulary(include=[*PART_INCLUDE, *LINK_INCLUDE], veto=PART_VETO, places=[*PART_PLACES, *LINK_INCLUDE])


def _run_inputs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """Parts as endpoint answers, captured pages, and a new folder with the sources of both.

    Brands are the sources. A page belongs to the brand numbered by the length of its address, so
    some pages belong to brands with endpoint rows, one to a brand whose answers are unreadable, and
    some to sources without an endpoint.
    """
    payloads = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("company"),
        F.lit("https://t.example.com/api/t/Careers/jobs").alias("endpoint_url"),
        F.when(F.col("p_brand") == "Brand#20", F.lit("<html>")).otherwise(
            F.to_json(F.struct(F.array(F.struct(
                F.col("p_name").alias("title"), F.col("p_type").alias("locationsText"),
                F.concat(F.lit("/job/"), "p_partkey").alias("externalPath"),
            )).alias("jobPostings")))
        ).alias("payload"),
    )
    pages = table(spark, sf_dir, "pages").select("url", "html").select(
        F.concat(F.lit("Brand#"), F.length("url") - 15).alias("company"), "url", "html"
    )
    names = payloads.select("company").union(pages.select("company")).distinct()
    sources = names.select(
        F.length("company").cast("bigint").alias("position"), labels.source_id("company").alias("id"),
        F.col("company").alias("name"), F.lit("https://t.example.com").alias("url"), F.lit(True).alias("locked"),
        F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("last_job"),
        F.lit(None).cast("timestamp").alias("last_checked"),
    )
    root = fresh_dir(spark, "run")
    snapshots.write_snapshot(sources, f"{root}/sources")
    return root, payloads, pages


def _seed(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Earlier rows: half the parts and pages as they were reported, and the cards of the labelled documents."""
    reported = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(
        F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"), F.lit(True).alias("notified"))
    snapshots.append_run(_as_history(reported), f"{root}/history", "reported")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), f"{root}/history", "cards")


def _run_once(spark: SparkSession, sf_dir: str, seeded: bool = False) -> str:
    """A scheduled run; returns its folder."""
    root, payloads, pages = _run_inputs(spark, sf_dir)
    if seeded:
        _seed(spark, sf_dir, root)
    scheduled_run_once(spark, root, payloads, pages, NOW, "user@example.com", RUN_WORDS)
    return root


def _run_stream(spark: SparkSession, sf_dir: str) -> str:
    """The same run as a stream over the landed inputs; returns its folder."""
    root, payloads, pages = _run_inputs(spark, sf_dir)
    payloads.write.parquet(f"{root}/landed/payloads")
    pages.write.parquet(f"{root}/landed/pages")
    stream = incremental.landed(spark, f"{root}/landed/payloads", f"{root}/landed/pages")
    incremental.start_runs(stream, root, f"{root}/checkpoint", "user@example.com", RUN_WORDS, clock=lambda: NOW).awaitTermination()
    return root


@query
def scheduled_run(spark, sf_dir):
    """The history after a whole run."""
    history = snapshots.read_history(spark, f"{_run_once(spark, sf_dir)}/history")
    return history.select("company", "title", "url", "id", "date", "notified")


@query
def scheduled_run_state(spark, sf_dir):
    """The sources after a whole run."""
    sources = snapshots.read_snapshot(spark, f"{_run_once(spark, sf_dir)}/sources", schemas.SOURCES)
    return sources.select("name", "status", "last_job", F.unix_micros("last_checked").alias("last_checked_us"))


@query
def scheduled_run_digest(spark, sf_dir):
    """The digest documents that a whole run stored."""
    digests = spark.read.parquet(f"{_run_once(spark, sf_dir)}/digests")
    return digests.select("recipient", "part", "parts", "total", "subject", "body")


@query
def run_on_history(spark, sf_dir):
    """What a whole run adds to a history that holds half of the parts already."""
    history = snapshots.read_history(spark, f"{_run_once(spark, sf_dir, seeded=True)}/history")
    return history.where(~F.col("run").isin("reported", "cards")).select("company", "title", "url", "id", "date", "notified")


@query
def pending_after_run(spark, sf_dir):
    """The run marked its rows as sent, so what is pending is the earlier rows that no one was told about."""
    return outbox.pending(spark, _run_once(spark, sf_dir, seeded=True)).select("run", "seq", "company", "title")


@query
def pending_digest(spark, sf_dir):
    """Those rows are sent: the documents, and how many rows are pending afterwards."""
    root = _run_once(spark, sf_dir, seeded=True)
    send_pending(spark, root, "catch-up", "user@example.com")
    sent = spark.read.parquet(f"{root}/digests").where("run = 'catch-up'").select("recipient", "part", "parts", "total", "subject", "body")
    return sent.withColumn("pending_after", F.lit(outbox.pending(spark, root).count()).cast("long"))


# Streams


@query
def stream_run(spark, sf_dir):
    """The history after the whole run as a stream."""
    history = snapshots.read_history(spark, f"{_run_stream(spark, sf_dir)}/history")
    return history.select("company", "title", "url", "id", "date", "notified")


@query
def stream_run_state(spark, sf_dir):
    """The sources after the whole run as a stream."""
    sources = snapshots.read_snapshot(spark, f"{_run_stream(spark, sf_dir)}/sources", schemas.SOURCES)
    return sources.select("name", "status", "last_job", F.unix_micros("last_checked").alias("last_checked_us"))


@query
def stream_run_digest(spark, sf_dir):
    """The digest documents of the whole run as a stream, and how many of its rows are still pending."""
    root = _run_stream(spark, sf_dir)
    digests = spark.read.parquet(f"{root}/digests").select("recipient", "part", "parts", "total", "subject", "body")
    return digests.withColumn("pending_after", F.lit(outbox.pending(spark, root).count()).cast("long"))


def _card_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as a file stream of cards. The path is a pattern because a stream takes a plain one for a folder, and the table
    may be a single file or a folder of files."""
    schema = table(spark, sf_dir, "documents").schema
    return as_cards(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]"))


@query
def stream_new_postings(spark, sf_dir):
    """Flagship as a stream: the history is stored first, the stream appends what it lacks."""
    root = fresh_dir(spark, "stream-new")
    snapshots.append_run(_as_history(card_history(spark, sf_dir)), f"{root}/history", "seed")
    stream = screens.screen_page_rows(
        _card_stream(spark, sf_dir), href=None, include=CARD_INCLUDE, veto=CARD_VETO, places=None
    ).select("company", "title", F.concat(F.lit("/doc/"), "ord").alias("url"), "ord")
    incremental.start_new_postings(stream, root, f"{root}/checkpoint").awaitTermination()
    added = snapshots.read_history(spark, f"{root}/history", without_run="seed")
    return added.select("company", "title", "url", "id")


@query
def stream_dedup(spark, sf_dir):
    root = fresh_dir(spark, "stream-keys")
    keys = incremental.stream_keys(_card_stream(spark, sf_dir))
    (
        keys.writeStream.format("parquet").option("path", f"{root}/keys")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(keys.schema).parquet(f"{root}/keys")


def _order_keys(spark: SparkSession, sf_dir: str, pick) -> DataFrame:
    """One posting a customer: its first or its last order."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(pick("o_orderdate").cast("timestamp").alias("at"))
    return orders.select(F.col("o_custkey").cast("string").alias("company"), F.lit("order").alias("title"), "at")


@query
def stream_dedup_forgetting(spark, sf_dir):
    """Keys with a watermark over two runs of a stream: a customer's last order comes out again where the first one is forgotten,
    and not where it came too late."""
    root = fresh_dir(spark, "stream-forget")
    schema = "company string, title string, at timestamp"
    for pick in (F.min, F.max):
        _order_keys(spark, sf_dir, pick).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        keys = incremental.stream_keys(stream, event_time="at", forget_after="800 days")
        (
            keys.writeStream.format("parquet").option("path", f"{root}/keys")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(keys.schema).parquet(f"{root}/keys").select("company", "title", F.unix_micros("at").alias("at_us"))


@query
def stream_source_state(spark, sf_dir):
    """The same kept by a stream over two landings, the second with late attempts and with a third of the first ones again."""
    root = fresh_dir(spark, "source-state")
    sources, tried = _tried_customers(spark, sf_dir)
    snapshots.write_snapshot(sources, f"{root}/sources")
    for landing in ("number % 2 = 0", "number % 2 = 1 OR number % 3 = 0"):
        tried.where(landing).drop("number").write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(tried.drop("number").schema).parquet(f"{root}/landed")
        attempt_stream.start_source_state(stream, root, f"{root}/checkpoint").awaitTermination()
    return _checked_customers(snapshots.read_snapshot(spark, f"{root}/sources", schemas.SOURCES))
