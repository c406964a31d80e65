"""Edits of stored tables: removal and selection by key, and adding sources in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.labels import source_id
from postsieve.functions.text import strip, text_or
from postsieve.sources import schemas

# Reasons a new source is refused, in the order the rules are tried.
NAME_REQUIRED = "name required"
URL_SCHEME = "url must start with http"
ALREADY_TRACKED = "already tracked"


def delete_by_key(table: DataFrame, ids: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows whose key is not listed. Postings are removed by company and title: the display id
    is shared by long titles."""
    keys = [keys] if isinstance(keys, str) else keys
    return table.join(ids.select(*keys), keys, "left_anti")


def select_by_key(table: DataFrame, ids: DataFrame, keys: list[str] | str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return table.join(ids.select(*keys), keys, "left_semi")


def validate_sources(candidates: DataFrame, tracked: DataFrame, order: str = "ord") -> DataFrame:
    """Candidates with stripped ``name`` and ``url`` and the first failing ``reason`` (NULL = accepted).

    A name is taken, whatever its case, when it is tracked or an earlier candidate of the same
    batch was accepted under it. Both come from one grouped lookup with one row per name.
    """
    tidy = candidates.withColumns({"name": strip(text_or("name")), "url": strip(text_or("url"))})
    ruled = tidy.withColumn(
        "_refused",
        F.when(F.col("name") == "", F.lit(NAME_REQUIRED))
        .when(~F.startswith("url", F.lit("http")), F.lit(URL_SCHEME)),
    ).withColumn("_key", F.lower("name"))
    offered = ruled.where(F.col("_refused").isNull()).select("_key", F.col(order).cast("bigint").alias("_owner"))
    known = tracked.select(F.lower("name").alias("_key"), F.lit(None).cast("bigint").alias("_owner"))
    owners = offered.unionByName(known).groupBy("_key").agg(
        F.count_if(F.col("_owner").isNull()).alias("_tracked"), F.min("_owner").alias("_owner")
    )
    taken = (F.col("_tracked") > 0) | (F.col(order) > F.col("_owner"))
    return (
        ruled.join(owners, "_key", "left")
        .withColumn("reason", F.coalesce("_refused", F.when(taken, F.lit(ALREADY_TRACKED))))
        .select(*candidates.columns, "reason")
    )


def accepted_sources(validated: DataFrame, after: int = -1, order: str = "ord") -> DataFrame:
    """Rows to add to the sources table (``schemas.SOURCES``) for the accepted candidates, placed
    behind position ``after``."""
    return validated.where(F.col("reason").isNull()).select(
        (F.col(order) + F.lit(after) + 1).cast("bigint").alias("position"),
        source_id("name").alias("id"), "name", "url",
        F.lit(False).alias("locked"), F.lit("unknown").alias("status"),
        F.lit(None).cast("string").alias("last_job"), F.lit(None).cast("timestamp").alias("last_checked"),
    ).select(schemas.SOURCES.fieldNames())
