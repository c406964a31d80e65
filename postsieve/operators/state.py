"""Per-source figures of a run, and the merge into the sources table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.labels import instant


def count_per_source(rows: DataFrame, source: str = "company") -> DataFrame:
    return rows.groupBy(source).agg(F.count("*").alias("n_postings"))


def first_title(
    rows: DataFrame, source: str = "company", title: str = "title", order: str | list[str] = "ord"
) -> DataFrame:
    """Title of each source's first row in extraction order.

    The group limit of a row number runs before the shuffle too; ``min_by`` over text would sort all rows of a task.
    """
    order = [order] if isinstance(order, str) else order
    in_source = Window.partitionBy(source).orderBy(*[F.asc_nulls_last(c) for c in order])
    first = rows.select(source, title, *order).withColumn("_nth", F.row_number().over(in_source)).where(F.col("_nth") == 1)
    return first.select(source, F.col(title).alias("last_job"))


def source_status(
    attempts: DataFrame, source: str = "company", at: str = "checked_at", ok: str = "ok"
) -> DataFrame:
    """Status by the latest attempt: broken when it failed, else active; of attempts at one instant
    a failed one counts.

    Written with plain maxima, which aggregate by hash; picking a row by a pair would sort.
    """
    latest = attempts.groupBy(source).agg(
        F.max(at).alias("last_checked"), F.max(F.when(~F.col(ok), F.col(at))).alias("_failed")
    )
    broken = F.coalesce(F.col("_failed") == F.col("last_checked"), F.lit(False))
    return latest.select(
        source, F.when(broken, F.lit("broken")).otherwise(F.lit("active")).alias("status"), "last_checked"
    )


def endpoint_lookup(sources: DataFrame, endpoints: DataFrame, on: str = "id") -> DataFrame:
    """Sources with their endpoint, NULL where they have none."""
    return sources.join(endpoints, on, "left")


def merge_source_state(
    sources: DataFrame, statuses: DataFrame, firsts: DataFrame, checked_at: datetime | Column,
    name: str = "name",
) -> DataFrame:
    """Sources after a run. ``statuses`` (name, status) names the sources that were tried: they get
    the status, the run's instant, and the first title of this run or "" when it found none.
    Sources that were not tried keep their state."""
    tried = statuses.select(F.col(name), F.col("status").alias("_status"))
    seen = firsts.select(F.col(name), F.col("last_job").alias("_last_job"))
    was_tried = F.col("_status").isNotNull()
    return (
        sources.join(tried, name, "left").join(seen, name, "left")
        .withColumns({
            "status": F.coalesce("_status", "status"),
            "last_checked": F.when(was_tried, instant(checked_at)).otherwise(F.col("last_checked")),
            "last_job": F.when(was_tried, F.coalesce("_last_job", F.lit(""))).otherwise(F.col("last_job")),
        })
        .select(sources.columns)
    )


def latest_attempts(
    attempts: DataFrame, source: str = "company", at: str = "checked_at", ok: str = "ok", title: str = "title"
) -> DataFrame:
    """(name, status, last_checked, last_job) by the latest attempt of each source, on a table or, in update mode, on a stream.

    Of attempts at one instant a failed one counts, then the greatest title. An attempt without a title found nothing:
    the last title is "". Attempts without a source or an instant are left out; ``ok`` NULL counts as reached.
    """
    known = attempts.where(F.col(source).isNotNull() & F.col(at).isNotNull())
    failed = F.coalesce(~F.col(ok), F.lit(False))
    latest = known.groupBy(F.col(source).alias("name")).agg(
        F.max(F.struct(F.col(at).alias("at"), failed.alias("failed"), F.col(title).alias("title"))).alias("_last")
    )
    return latest.select(
        "name", F.when(F.col("_last.failed"), F.lit("broken")).otherwise(F.lit("active")).alias("status"),
        F.col("_last.at").alias("last_checked"),
        F.when(F.col("_last.failed"), F.lit("")).otherwise(F.coalesce("_last.title", F.lit(""))).alias("last_job"),
    )


def merge_latest(sources: DataFrame, latest: DataFrame, name: str = "name") -> DataFrame:
    """Sources with the state of ``latest_attempts``. One that was checked later than its attempt keeps its state, and so
    does one without an attempt; attempts of sources that are not tracked are left out."""
    found = latest.select(
        F.col(name), F.col("status").alias("_status"), F.col("last_checked").alias("_at"), F.col("last_job").alias("_job")
    )
    newer = F.col("_at").isNotNull() & (F.col("last_checked").isNull() | (F.col("_at") >= F.col("last_checked")))
    return (
        sources.join(found, name, "left").withColumn("_newer", newer)
        .withColumns({
            "status": F.when(F.col("_newer"), F.col("_status")).otherwise(F.col("status")),
            "last_checked": F.when(F.col("_newer"), F.col("_at")).otherwise(F.col("last_checked")),
            "last_job": F.when(F.col("_newer"), F.col("_job")).otherwise(F.col("last_job")),
        })
        .select(sources.columns)
    )
