"""Declared schemas of every stored and landed table. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _B, _TS, _L = T.StringType(), T.BooleanType(), T.TimestampType(), T.LongType()

# Tracked sources and their state; ``position`` is their order.
SOURCES = _struct(position=_L, id=_S, name=_S, url=_S, locked=_B, status=_S, last_job=_S, last_checked=_TS)

# Postings already reported. ``seq`` orders the table; ``date`` is the display form of ``found_at``.
HISTORY = _struct(company=_S, title=_S, url=_S, id=_S, date=_S, found_at=_TS, seq=_L, notified=_B)

SETTINGS = _struct(recipient_email=_S)

# Source id -> endpoint.
ENDPOINTS = _struct(id=_S, type=_S, url=_S)

# One fetched endpoint answer, one captured page, one attempt to reach a source.
PAYLOADS = _struct(company=_S, endpoint_url=_S, payload=_S)
PAGES = _struct(company=_S, url=_S, html=_S)
ATTEMPTS = _struct(company=_S, checked_at=_TS, ok=_B)

# A posting between extraction and history.
POSTINGS = _struct(company=_S, title=_S, url=_S, ord=_L)

# The stored JSON forms, before empty texts become NULL.
SOURCES_JSON = _struct(id=_S, name=_S, url=_S, locked=_B, status=_S, last_job=_S, last_checked=_S)
HISTORY_JSON = _struct(title=_S, url=_S, company=_S, date=_S, id=_S, notified=_B)
