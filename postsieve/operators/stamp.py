"""New postings to history rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.labels import display_date, posting_id
from postsieve.operators.dedup import KEY
from postsieve.sources import schemas


def stamp_new(new: DataFrame, after: int, found_at: datetime, order: list[str]) -> DataFrame:
    """Add id, dates, the unset flag, and ``seq``: unique, above ``after``, and rising in ``order``, then by company and
    title, so that a repeat numbers the rows alike. It leaves gaps: partitions are numbered apart from each other."""
    return new.orderBy(*order, *[k for k in KEY if k not in order]).withColumns({
        "seq": F.monotonically_increasing_id() + F.lit(after + 1),
        "id": posting_id("company", "title"),
        "found_at": F.lit(found_at),
        "date": display_date(F.lit(found_at)),
        "notified": F.lit(False),
    }).select(schemas.HISTORY.fieldNames())


def renumbered(rows: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """``rows`` with a new number that rises in ``order``, unique, with gaps. Store the result before it is read twice."""
    return rows.orderBy(*order).withColumn(seq, F.monotonically_increasing_id())
