"""The run as a stream: newly landed postings against a growing history.

``foreachBatch`` delivers a batch at least once. Each batch owns one folder of every table it
writes and leaves that folder out when it reads the history, so a repeated batch replaces
its own rows with the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.dedup import KEY, keep_first, normal_keys
from postsieve.operators.report import DIGEST_LINES
from postsieve.operators.stamp import stamp_new
from postsieve.plans.run import Vocabulary, apply_run, new_to_history, screened_endpoint_rows, screened_page_rows, send
from postsieve.sources import schemas, snapshots
from postsieve.sources.shapes import Shape


def landed_pages(spark: SparkSession, folder: str, words: Vocabulary = Vocabulary(), **options: str) -> DataFrame:
    """Stream of the postings in captured pages as they land in a folder. ``options`` go to the file
    source, such as ``maxFilesPerTrigger``."""
    stream = spark.readStream.schema(schemas.PAGES).options(**options).parquet(folder)
    return screened_page_rows(stream, words)


def landed_payloads(spark: SparkSession, folder: str, words: Vocabulary = Vocabulary(), **options: str) -> DataFrame:
    """Stream of the postings in endpoint answers as they land in a folder."""
    stream = spark.readStream.schema(schemas.PAYLOADS).options(**options).parquet(folder)
    return screened_endpoint_rows(stream, words).where(F.col("ok")).select(schemas.POSTINGS.fieldNames())


def landed(spark: SparkSession, payloads: str, pages: str, **options: str) -> DataFrame:
    """One stream of endpoint answers and captured pages as they land in two folders: (company, answer, page), one of the
    two set. ``options`` go to both file sources."""

    def read(folder: str, schema: T.StructType) -> DataFrame:
        return spark.readStream.schema(schema).options(**options).parquet(folder)

    def form(schema: T.StructType) -> T.StructType:
        return T.StructType([f for f in schema.fields if f.name != "company"])

    answer, page = (F.struct(*form(x).fieldNames()) for x in (schemas.PAYLOADS, schemas.PAGES))
    answers = read(payloads, schemas.PAYLOADS).select("company", answer.alias("answer"), F.lit(None).cast(form(schemas.PAGES)).alias("page"))
    captured = read(pages, schemas.PAGES).select("company", F.lit(None).cast(form(schemas.PAYLOADS)).alias("answer"), page.alias("page"))
    return answers.unionByName(captured)


_STARTED = T.StructType([T.StructField("at_us", T.LongType()), T.StructField("after", T.LongType())])
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _started(spark: SparkSession, root: str, run: str, clock: Callable[[], datetime]) -> tuple[datetime, int]:
    """Instant of a batch and the number its rows come after, written at its first attempt and read by later ones."""
    path = f"{root}/started/run={run}"
    kept = snapshots.scan_or_empty(spark, path, _STARTED).first()
    if kept is None:
        after = snapshots.last_seq(spark, f"{root}/history", without_run=run)
        start = spark.createDataFrame([((clock() - _EPOCH) // timedelta(microseconds=1), after)], _STARTED)
        start.coalesce(1).write.mode("overwrite").parquet(path)
        kept = spark.read.schema(_STARTED).parquet(path).first()
    return _EPOCH + timedelta(microseconds=kept["at_us"]), kept["after"]


def new_postings_writer(
    root: str, name: str, recipient: str = "", order: list[str] | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), lines_per_document: int = DIGEST_LINES,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: store the new postings of a batch, and its digest when there
    is a recipient, ``lines_per_document`` lines to a document. ``name`` tells the streams that write to one history apart."""
    order = order or ["ord", "url"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"{name}-{batch_id}"
        staged = f"{root}/stage/run={run}"
        keep_first(normal_keys(batch), KEY, order).write.mode("overwrite").parquet(staged)
        firsts = spark.read.schema(batch.schema).parquet(staged)
        past = f"{root}/history"
        at, after = _started(spark, root, run, clock)
        new = stamp_new(new_to_history(firsts, past, run), after, at, ["company", *order])
        snapshots.append_run(new, past, run)
        if recipient:
            added = snapshots.read_history(spark, f"{root}/history").where(F.col("run") == run)
            send(added, root, run, recipient, lines_per_document)

    return write


def start_new_postings(
    stream: DataFrame, root: str, checkpoint: str, recipient: str = "",
    order: list[str] | None = None, every: str | None = None, lines_per_document: int = DIGEST_LINES,
) -> StreamingQuery:
    """Start the stream of postings (company, title, url, ord). Without ``every`` it processes what
    has landed and stops; ``every="3 hours"`` keeps it running at that pace.

    The name in the history comes from the checkpoint: use a new path for a new checkpoint.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(new_postings_writer(root, name, recipient, order, lines_per_document=lines_per_document))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def run_writer(
    root: str, name: str, recipient: str = "", words: Vocabulary = Vocabulary(),
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), lines_per_document: int = DIGEST_LINES, only_landed: bool = False,
    shapes: Sequence[Shape] = (),
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` over ``landed``: a whole run for each batch. Answers come before pages, failed answers mark
    their source and keep it from fallback, untracked sources are left out, and history, digest, sent rows and state are stored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"{name}-{batch_id}"
        payloads = batch.where(F.col("answer").isNotNull()).select("company", "answer.*")
        pages = batch.where(F.col("page").isNotNull()).select("company", "page.*")
        at, after = _started(spark, root, run, clock)
        apply_run(spark, root, run, payloads, pages, at, after, recipient, words, lines_per_document, only_landed, shapes)

    return write


def start_runs(
    stream: DataFrame, root: str, checkpoint: str, recipient: str = "", words: Vocabulary = Vocabulary(), every: str | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), lines_per_document: int = DIGEST_LINES, only_landed: bool = False,
    shapes: Sequence[Shape] = (),
) -> StreamingQuery:
    """Start the whole run as a stream over ``landed``, once over what has landed or, with ``every``, at that pace.

    A batch is a run: answers decide about the pages that come in the same batch, so land both inputs of a source together, and let
    a batch take all there is (no ``maxFilesPerTrigger``) where that matters. Every tracked source counts as tried in each batch, as in
    a scheduled run; ``only_landed`` is for inputs that land source by source.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = run_writer(root, name, recipient, words, clock, lines_per_document, only_landed, shapes)
    return stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_keys(
    stream: DataFrame, keys: list[str] = KEY, event_time: str | None = None, forget_after: str | None = None
) -> DataFrame:
    """Each key of a stream once, without a history table.

    The state keeps every key for good, as the history does; on a cluster keep it in the RocksDB
    state store. With ``event_time`` and ``forget_after`` keys older than that are dropped from the
    state and come out again when they return.
    """
    known = normal_keys(stream, keys)
    if event_time and forget_after:
        return known.withWatermark(event_time, forget_after).dropDuplicatesWithinWatermark(keys)
    return known.select(*keys).dropDuplicates(keys)
