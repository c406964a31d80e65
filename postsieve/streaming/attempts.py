"""State of the sources kept by a stream of attempts to reach them.

The stream holds the latest attempt of each source as its state, one row a source, so an attempt that lands late or twice
changes nothing. Each batch merges the sources it touched into a new version of the sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.state import latest_attempts, merge_latest
from postsieve.sources import schemas, snapshots


def state_writer(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` over ``latest_attempts``: merge a batch into the stored sources below ``root``.

    A repeated batch merges the same attempts, which are no newer than what is there. A version that another writer
    finished in between is read and merged into.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{root}/stage/run={name}-{batch_id}/latest"
        batch.write.mode("overwrite").parquet(staged)  # The state of the stream is computed once, whatever is read below.
        latest = spark.read.schema(batch.schema).parquet(staged)
        if latest.isEmpty():
            return
        while True:
            sources, version = snapshots.read_version(spark, f"{root}/sources", schemas.SOURCES)
            try:
                snapshots.write_snapshot(merge_latest(sources, latest), f"{root}/sources", version)
                return
            except snapshots.SnapshotConflict:
                continue

    return write


def start_source_state(attempts: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start the stream of attempts (company, checked_at, ok, title), once over what has landed or, with ``every``, at that pace.

    ``title`` is the first one that the attempt found, NULL where it found none.
    """
    name = "state-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    trigger = {"processingTime": every} if every else {"availableNow": True}
    latest = latest_attempts(attempts)
    return (
        latest.writeStream.outputMode("update").foreachBatch(state_writer(root, name))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
