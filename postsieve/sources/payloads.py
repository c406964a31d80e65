"""Endpoint answers (nested JSON) to posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.text import text_or
from postsieve.functions.urls import posting_url, site_base

_BAD = "_unreadable"

# The fields of an endpoint answer.
LIST_FIELD = "jobPostings"
TITLE_FIELD, LOCATION_FIELD, PATH_FIELD = "title", "locationsText", "externalPath"


def parse_payload(payload: Column | str, list_field: str, fields: dict[str, str]) -> Column:
    """Struct with the list of records; unreadable text is kept in an extra field, because a
    tolerant parse turns it into a non-NULL struct of NULLs."""
    record = T.StructType([T.StructField(f, T._parse_datatype_string(kind)) for f, kind in fields.items()])
    schema = T.StructType([
        T.StructField(list_field, T.ArrayType(record)),
        T.StructField(_BAD, T.StringType()),
    ])
    return F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def is_unreadable(parsed: Column) -> Column:
    return parsed.isNull() | parsed[_BAD].isNotNull()


def flatten_records(
    df: DataFrame, payload: str, list_field: str, fields: dict[str, str], defaults: dict[str, object]
) -> DataFrame:
    """One row per record of the payload's list: the other columns, ``ord``, the fields with
    ``defaults`` where they are missing or null. Unreadable payloads give no row."""
    kept = [c for c in df.columns if c != payload]
    records = parse_payload(payload, list_field, fields)[list_field]
    flat = df.select(*kept, F.posexplode(records).alias("ord", "_record"))
    return flat.select(
        *kept, F.col("ord").cast("bigint").alias("ord"),
        *[F.coalesce(F.col(f"_record.{f}"), F.lit(defaults[f])).alias(f) for f in fields],
    )


def endpoint_rows(payloads: DataFrame) -> DataFrame:
    """(company, ok, title, location, href, url, ord) of landed answers (``schemas.PAYLOADS``).

    One row per posting, and one without ``ord`` for an answer that has none. ``ok`` is false, on one
    such row, where the attempt failed: the answer cannot be read, or its endpoint has no site. So
    one pass over the answers gives both the postings and the state of the sources.
    """
    fields = {TITLE_FIELD: "string", LOCATION_FIELD: "string", PATH_FIELD: "string"}
    parsed = payloads.select(
        "company", site_base("endpoint_url").alias("_base"),
        parse_payload(F.col("payload"), LIST_FIELD, fields).alias("_parsed"),
    )
    ok = ~is_unreadable(F.col("_parsed")) & F.col("_base").isNotNull()
    records = F.when(F.col("_ok"), F.col(f"_parsed.{LIST_FIELD}"))
    rows = parsed.withColumn("_ok", ok).select("company", "_ok", "_base", F.posexplode_outer(records).alias("ord", "_record"))
    title, location, path = (text_or(f"_record.{f}") for f in fields)
    return rows.select(
        "company", F.col("_ok").alias("ok"), title.alias("title"), location.alias("location"), path.alias("href"),
        posting_url("_base", path).alias("url"), F.col("ord").cast("bigint").alias("ord"),
    )


def endpoint_postings(payloads: DataFrame) -> DataFrame:
    """The postings among ``endpoint_rows``."""
    return endpoint_rows(payloads).where(F.col("ord").isNotNull()).drop("ok")


def cap_per_source(rows: DataFrame, limit: int, ord_col: str = "ord") -> DataFrame:
    """Only the first ``limit`` records of each source, as an endpoint that answers one page gives.
    Not part of any run unless asked for: landed answers are processed whole."""
    return rows.where(F.col(ord_col) < limit)
