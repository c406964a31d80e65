"""Ids, dates and labels shown to people."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.text import as_column, filled_or, text_or


def posting_id(company: Column | str, title: Column | str) -> Column:
    """Readable id of a posting. Long titles can share one: a display key, not an identity."""
    head = F.substring(text_or(title), 1, V.ID_TITLE_CHARS)
    return F.replace(F.concat(text_or(company), F.lit("_"), head), F.lit(" "), F.lit("_"))


def row_key(id_: Column | str, company: Column | str, title: Column | str) -> Column:
    """The stored id, or company and title where there is none."""
    return filled_or(id_, F.concat(text_or(company), F.lit("_"), text_or(title)))


def source_id(name: Column | str) -> Column:
    """Id of a newly tracked source, a function of its name so that a repeated job gives the same one."""
    return F.concat(F.lit("c"), F.substring(F.sha2(F.lower(as_column(name)), 256), 1, 16))


def display_date(ts: Column | str) -> Column:
    return F.date_format(as_column(ts), V.DISPLAY_DATE_FORMAT)


def instant(moment: datetime | Column) -> Column:
    """A run's reference instant: one literal per run, so a repeated run gives the same rows."""
    return F.lit(moment) if isinstance(moment, datetime) else moment


def relative_age(ts: Column | str, now: datetime | Column) -> Column:
    """Age in whole seconds put into words; NULL gives the placeholder."""
    micros = F.unix_micros(instant(now)) - F.unix_micros(as_column(ts))
    diff = F.call_function("div", micros, F.lit(1_000_000))

    def whole(per: int) -> Column:
        return F.call_function("div", diff, F.lit(per)).cast("string")

    return (
        F.when(diff.isNull(), F.lit(V.PLACEHOLDER))
        .when(diff < 60, F.lit("just now"))
        .when(diff < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(diff < 86400, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )


def relative_age_of_text(iso: Column | str, now: datetime | Column) -> Column:
    """As ``relative_age`` for stored ISO text: empty gives the placeholder, text that is no
    instant with an offset comes back unchanged."""
    iso = as_column(iso)
    has_offset = iso.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}(?::?\d{2}){0,2})$")
    ts = F.when(has_offset, F.try_to_timestamp(iso))
    return (
        F.when(iso.isNull() | (iso == ""), F.lit(V.PLACEHOLDER))
        .when(ts.isNull(), iso)
        .otherwise(relative_age(ts, now))
    )


def status_label(status: Column | str) -> Column:
    status = as_column(status)
    return (
        F.when(status == "broken", F.lit("Broken"))
        .when(status == "active", F.lit("Active"))
        .otherwise(F.lit("Pending"))
    )


def core_flag(locked: Column | str) -> Column:
    return F.when(F.coalesce(as_column(locked), F.lit(False)), F.lit("CORE")).otherwise(F.lit(""))


def plural_s(n: Column) -> Column:
    return F.when(n > 1, F.lit("s")).otherwise(F.lit(""))


def alert_subject(n: Column) -> Column:
    return F.concat(F.lit("[Job Alert] "), n.cast("string"), F.lit(" new fresher posting"), plural_s(n))


def page_label(start: Column, size: int | Column, total: Column) -> Column:
    """ "a–b of total" for the page that begins after ``start`` rows."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(
        (start + 1).cast("string"), F.lit("–"), F.least(start + size, total).cast("string"),
        F.lit(" of "), total.cast("string"),
    )
