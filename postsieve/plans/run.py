"""One scheduled run over landed endpoint answers and captured pages.

Landed tables in, stored tables out: the sources with their new state, the history with
the new postings, the digest documents, and the rows marked as sent. What several steps read is written once to the
run's own folder; a lost executor re-reads it, and a repeated run replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.urls import resolve_links
from postsieve.operators import stamp
from postsieve.operators.dedup import KEY, PROBE_LIMIT, fallback_rows, keep_first, normal_keys, probe_new_postings
from postsieve.operators.report import DIGEST_LINES, alert_digest
from postsieve.operators.screens import endpoint_row_ok, screen_page_rows
from postsieve.operators.state import first_title, merge_source_state
from postsieve.sources import outbox, schemas, snapshots
from postsieve.sources.pages import page_postings
from postsieve.sources.payloads import endpoint_rows
from postsieve.sources.shapes import Shape, shaped_rows

ORDER = ["ord", "url"]


@dataclass(frozen=True)
class Vocabulary:
    include: list[str] = tuple(V.INCLUDE_TERMS)
    veto: list[str] = tuple(V.VETO_TERMS)
    places: list[str] = tuple(V.PLACE_TERMS)
    path_words: list[str] = tuple(V.ARTICLE_PATH_WORDS)

    def as_kwargs(self) -> dict[str, list[str]]:
        return {name: list(getattr(self, name)) for name in ("include", "veto", "places", "path_words")}


def screened_endpoint_rows(payloads: DataFrame, words: Vocabulary = Vocabulary(), shapes: Sequence[Shape] = ()) -> DataFrame:
    """Endpoint rows that pass the screens, and the marker rows of failed attempts. With ``shapes`` answers may have any of them."""
    passes = F.col("ord").isNotNull() & endpoint_row_ok(**words.as_kwargs())
    rows = shaped_rows(payloads, shapes).drop("shape", "record") if shapes else endpoint_rows(payloads)
    return rows.where(~F.col("ok") | passes)


def failed_sources(endpoint: DataFrame) -> DataFrame:
    """Sources whose endpoint answer could not be used: broken, and without page fallback."""
    return endpoint.where(~F.col("ok")).select("company").distinct()


def screened_page_rows(pages: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Postings (``schemas.POSTINGS``) of captured pages that pass the screens, addresses resolved."""
    kept = screen_page_rows(page_postings(pages), **words.as_kwargs())
    return resolve_links(kept, "page_url", "href").select(schemas.POSTINGS.fieldNames())


def screened_postings(endpoint: DataFrame, pages: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Postings (``schemas.POSTINGS``) that pass the screens: ``screened_endpoint_rows``, and page rows
    of the sources without any."""
    columns = schemas.POSTINGS.fieldNames()
    failed = failed_sources(endpoint)
    usable = endpoint.where(F.col("ok")).join(failed, "company", "left_anti").select(columns)
    return fallback_rows(usable, screened_page_rows(pages, words), "company", failed)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table several steps read, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send(rows: DataFrame, root: str, sender: str, recipient: str, lines_per_document: int = DIGEST_LINES) -> None:
    """Store the digest documents of history rows, then mark the rows as sent. Both go under the name of the
    sender, so that a repeat after a fault in between replaces them."""
    digest = alert_digest(rows.withColumn("recipient", F.lit(recipient)), lines_per_document=lines_per_document)
    digest.write.mode("overwrite").parquet(f"{root}/digests/run={sender}")
    outbox.record_sent(rows, root, sender)


def send_pending(spark: SparkSession, root: str, sender: str, recipient: str, lines_per_document: int = DIGEST_LINES) -> None:
    """Send what no run has sent yet: rows of runs without a recipient, of imported histories, of runs that stopped early.

    What is pending is written down first and only once for a sender, so a repeat sends the same rows. Numbers of runs that began together
    may meet, so documents follow a numbering of their own: by instant, run and number.
    """
    path = f"{root}/stage/run={sender}/pending"
    open_rows = outbox.pending(spark, root, without=sender)
    if snapshots.current_version(spark, path) is None:
        numbered = stamp.renumbered(open_rows.withColumnRenamed("seq", "_seq"), ["found_at", "run", "_seq"])
        snapshots.write_snapshot(numbered, path)
    kept = snapshots.read_snapshot(spark, path, open_rows.withColumnRenamed("seq", "_seq").withColumn("seq", F.lit(0).cast("long")).schema)
    digest = alert_digest(kept.withColumn("recipient", F.lit(recipient)), lines_per_document=lines_per_document)
    digest.write.mode("overwrite").parquet(f"{root}/digests/run={sender}")
    outbox.record_sent(kept.select("run", F.col("_seq").alias("seq")), root, sender)


def new_to_history(firsts: DataFrame, root: str, run: str, limit: int = PROBE_LIMIT) -> DataFrame:
    """Rows of a stored, folded batch that the history lacks, the rows of ``run`` left out: runs that are not merged by
    ``probe_new_postings``, merged ones by their buckets."""
    loose, index = snapshots.history_keys(firsts.sparkSession, root, without_run=run)
    return probe_new_postings(firsts, loose, limit=limit, live=lambda rows: snapshots.live_rows(rows, root), index=index, number=snapshots.key_number)


def apply_run(
    spark: SparkSession, root: str, run: str, payloads: DataFrame, pages: DataFrame, checked_at: datetime, after: int,
    recipient: str = "", words: Vocabulary = Vocabulary(), lines_per_document: int = DIGEST_LINES, only_landed: bool = False,
    shapes: Sequence[Shape] = (),
) -> None:
    """The steps of a run under the name ``run``: what its rows are numbered after, and its instant, are given, so that
    a repeat gives the same results.

    Every tracked source counts as tried; with ``only_landed`` only those with an answer or a page among the inputs.
    """
    stage = f"{root}/stage/run={run}"
    sources, version = snapshots.read_version(spark, f"{root}/sources", schemas.SOURCES)

    tracked = sources.groupBy(F.col("name").alias("company")).agg(F.min("position").alias("position"))
    tracked = _stored(tracked, f"{stage}/tracked")  # Joined as a table, so that a hot source can be split.
    endpoint = _stored(screened_endpoint_rows(payloads, words, shapes), f"{stage}/endpoint")
    screened = screened_postings(endpoint, pages, words)
    postings = _stored(screened.join(tracked, "company"), f"{stage}/postings")
    firsts = _stored(keep_first(normal_keys(postings), KEY, ORDER), f"{stage}/firsts")

    new = new_to_history(firsts, f"{root}/history", run)
    stamped = stamp.stamp_new(new, after, checked_at, ["position", *ORDER])
    snapshots.append_run(stamped, f"{root}/history", run)

    if recipient:
        added = snapshots.read_history(spark, f"{root}/history").where(F.col("run") == run)
        send(added, root, run, recipient, lines_per_document)

    tried = tracked.select(F.col("company").alias("name"))
    if only_landed:
        tried = tried.join(payloads.select("company").union(pages.select("company")), tried["name"] == F.col("company"), "left_semi")
    broken = failed_sources(endpoint).select(F.col("company").alias("name"), F.lit("broken").alias("status"))
    statuses = tried.join(broken, "name", "left").select("name", F.coalesce("status", F.lit("active")).alias("status"))
    firsts_of_run = first_title(postings, order=ORDER).withColumnRenamed("company", "name")
    while True:
        merged = merge_source_state(sources, statuses, firsts_of_run, checked_at)
        try:
            snapshots.write_snapshot(merged, f"{root}/sources", version)
            return
        except snapshots.SnapshotConflict:  # an edit of the sources came in between: merge into that
            sources, version = snapshots.read_version(spark, f"{root}/sources", schemas.SOURCES)


def scheduled_run(
    spark: SparkSession, root: str, payloads: DataFrame, pages: DataFrame,
    checked_at: datetime, recipient: str = "", words: Vocabulary = Vocabulary(),
    lines_per_document: int = DIGEST_LINES, shapes: Sequence[Shape] = (),
) -> str:
    """Run once and store the results below ``root``; returns the name of the run.

    Tables: ``sources`` (snapshot), ``history`` (runs), ``digests`` (runs), ``sent`` (senders), ``stage`` (runs). A digest of
    more than ``lines_per_document`` lines goes on in further documents.
    """
    run = f"{checked_at:%Y%m%dT%H%M%S%f}"
    after = snapshots.last_seq(spark, f"{root}/history", without_run=run)
    apply_run(spark, root, run, payloads, pages, checked_at, after, recipient, words, lines_per_document, shapes=shapes)
    return run
