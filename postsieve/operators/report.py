"""Digests, paged views, the source board and summary figures."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.labels import (
    alert_subject, core_flag, page_label, relative_age, status_label,
)
from postsieve.functions.text import filled_or, initial, placeholder, text_or
from postsieve.functions.urls import host_of
from postsieve.operators.dedup import normal_keys
from postsieve.operators.positions import SLICE_WIDTH, slice_offsets, with_positions

# Lines of one digest document, names of one joined list. Longer ones continue in further parts.
DIGEST_LINES = 1_000


def joined_parts(
    rows: DataFrame, group: list[str], seq: str, columns: dict[str, tuple[Column, str]],
    per_part: int, width: int = SLICE_WIDTH,
) -> DataFrame:
    """Texts of a group joined in ``seq`` order: (group, part, parts, total, n, columns).

    ``columns`` maps a result name to (text, separator). A group longer than ``per_part`` rows
    goes on in further parts, so no task ever gathers more than ``per_part`` rows; nothing is
    left out. A group that fits is one part.
    """
    texts = rows.select(*group, F.col(seq).alias("_seq"), *[c.alias(name) for name, (c, _) in columns.items()])
    placed = with_positions(texts, group, "_seq", "_position", "total", width)
    part = F.call_function("div", F.col("_position"), F.lit(per_part)).alias("part")
    gathered = placed.groupBy(*group, part).agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("_position", *columns))).alias("_rows"),
    )
    parts = F.call_function("div", F.col("total") + F.lit(per_part - 1), F.lit(per_part))
    return gathered.select(
        *group, (F.col("part") + 1).alias("part"), parts.alias("parts"), "total",
        F.size("_rows").cast("bigint").alias("n"),
        *[F.array_join(F.col(f"_rows.{name}"), sep).alias(name) for name, (_, sep) in columns.items()],
    )


def joined_names(
    rows: DataFrame, group: list[str], name: str, seq: str, per_part: int = DIGEST_LINES
) -> DataFrame:
    """Names of a set of rows, separated by ", "."""
    return joined_parts(rows, group, seq, {"names": (text_or(name), ", ")}, per_part)


def text_line(title: Column | str, company: Column | str, url: Column | str) -> Column:
    # Fixed value: the format of a digest line.
    return F.concat(text_or(title), F.lit(" @ "), text_or(company), F.lit(" — "), text_or(url))


def escape_html(c: Column) -> Column:
    for char, reference in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        c = F.replace(c, F.lit(char), F.lit(reference))
    return c


def html_row(title: Column | str, company: Column | str, date: Column | str, url: Column | str) -> Column:
    """A table row: title, company and date, a link. Values are escaped; no address links to "#"."""
    return F.concat(
        F.lit("<tr><td><b>"), escape_html(text_or(title)), F.lit("</b><br>"), escape_html(text_or(company)),
        F.lit(" &middot; "), escape_html(text_or(date)), F.lit('</td><td><a href="'),
        escape_html(text_or(url, "#")), F.lit('">Apply</a></td></tr>'),
    )


def alert_digest(
    rows: DataFrame, recipient: str = "recipient", seq: str = "seq",
    title: str = "title", company: str = "company", url: str = "url", date: str | None = "date",
    lines_per_document: int = DIGEST_LINES,
) -> DataFrame:
    """Documents to send: (recipient, part, parts, total, subject, body, html_rows).

    The subject counts all rows of the recipient; rows without a recipient give none. A
    recipient with more rows than fit in one document gets numbered further ones.
    """
    addressed = rows.where(text_or(rows[recipient].cast("string")) != "")
    day = F.lit("") if date is None else F.col(date)
    parts = joined_parts(
        addressed, [recipient], seq,
        {"body": (text_line(title, company, url), "\n"), "html_rows": (html_row(title, company, day, url), "\n")},
        lines_per_document,
    )
    return parts.select(
        recipient, "part", "parts", "total", alert_subject(F.col("total")).alias("subject"), "body", "html_rows"
    )


def pending_alerts(history: DataFrame, sent: DataFrame | None = None, key: str = "seq") -> DataFrame:
    """Rows not yet notified: neither flagged in the history nor listed in ``sent``."""
    open_rows = history.where(~F.coalesce(F.col("notified"), F.lit(False)))
    return open_rows if sent is None else open_rows.join(sent.select(key), key, "left_anti")


def mark_notified(history: DataFrame, sent: DataFrame, key: str = "seq") -> DataFrame:
    """History with the flag set on the listed rows."""
    hits = sent.select(key).distinct().withColumn("_sent", F.lit(True))
    return history.join(hits, key, "left").withColumn(
        "notified", F.coalesce(F.col("_sent"), F.col("notified"))
    ).select(history.columns)


@dataclass(frozen=True)
class Page:
    """Where a page of the newest-first view lies."""

    number: int
    total: int
    start: int
    low: int | None
    high: int | None
    skip: int


def locate_page(
    history: DataFrame, page: int, size: int = V.PAGE_SIZE, seq: str = "seq", width: int = SLICE_WIDTH
) -> Page:
    """Find the slices of ``seq`` the page lies in, after clamping the page number.

    Reads one column; what reaches the driver is one row.
    """
    total, n, before = F.col("_total"), F.col("_n"), F.col("_before")
    last_page = F.greatest(F.call_function("div", total - 1, F.lit(size)), F.lit(0))
    number = F.greatest(F.least(F.lit(page), last_page), F.lit(0))
    spans = slice_offsets(history.select(seq), [], seq, width).select(
        "_slot._slice", "_total", number.alias("_number"), (number * size).alias("_start"),
        (total - before - n).alias("_from"), (total - before).alias("_to"),
    ).where((F.col("_from") < F.col("_start") + size) & (F.col("_to") > F.col("_start")))
    found = spans.agg(
        F.max("_number"), F.max("_total"), F.max("_start"),
        F.min("_slice"), F.max("_slice"), F.min("_from"),
    ).first()
    if found[1] is None:
        return Page(0, 0, 0, None, None, 0)
    return Page(
        number=found[0], total=found[1], start=found[2],
        low=found[3] * width, high=(found[4] + 1) * width - 1, skip=found[2] - found[5],
    )


def history_page(
    history: DataFrame, page: int, size: int = V.PAGE_SIZE, seq: str = "seq", width: int = SLICE_WIDTH
) -> DataFrame:
    """Page ``page`` (from 0) of the history, newest first; numbers past the end give the last page.

    The bounds found first are pushed to the scan, so a history written in ``seq`` order is read
    only where the page lies, and a late page costs no more than the first.
    """
    at = locate_page(history, page, size, seq, width)
    if at.low is None:
        return history.limit(0)
    return (
        history.where(F.col(seq).between(at.low, at.high))
        .orderBy(F.desc(seq)).offset(at.skip).limit(size)
    )


def page_labels(counts: DataFrame, total: str, page: int = 0, size: int = V.PAGE_SIZE) -> DataFrame:
    """Add the label of the (clamped) page to rows that carry a row count."""
    n = F.col(total)
    last_page = F.greatest(F.call_function("div", n - 1, F.lit(size)), F.lit(0))
    start = F.least(F.lit(page), last_page) * size
    return counts.withColumn("label", page_label(start, size, n))


def source_board(sources: DataFrame, now: datetime) -> DataFrame:
    """One display row per source."""
    return sources.select(
        "name", initial("name").alias("initial"), host_of("url").alias("host"),
        status_label("status").alias("status"), placeholder("last_job").alias("last_job"),
        relative_age("last_checked", now).alias("last_checked"), core_flag("locked").alias("core"),
    )


def latest_check(sources: DataFrame, now: datetime, at: str = "last_checked") -> DataFrame:
    """One row: the latest check over all sources and its age, "never" when there was none."""
    top = sources.agg(F.max(at).alias("latest_check"))
    age = F.when(F.col("latest_check").isNull(), F.lit(V.NEVER)).otherwise(relative_age("latest_check", now))
    return top.withColumn("age", age)


def responding_count(sources: DataFrame, status: str = "status") -> DataFrame:
    """One row: sources that respond (any status but broken) and all sources."""
    return sources.agg(
        F.count_if(filled_or(status, "unknown") != "broken").alias("responding"), F.count("*").alias("total")
    )


def run_summary(firsts: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct postings of a run, how many the history had, how many are new. A NULL key counts as ""."""
    past = normal_keys(history.select(*keys), keys).distinct().withColumn("_seen", F.lit(1))
    return normal_keys(firsts.select(*keys), keys).distinct().join(past, keys, "left").agg(
        F.count("*").alias("in_batch"), F.count("_seen").alias("already_seen"),
        (F.count("*") - F.count("_seen")).alias("new"),
    )
