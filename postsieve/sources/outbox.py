"""Which history rows were sent: a table beside the history, one folder for each sender.

A row is known by its run and number. A sender writes only the folder of its own name, so one that is
repeated replaces what it had marked, and it does not count its own marks when it looks for what is pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.sources import snapshots

_SENT = T.StructType([T.StructField("run", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("sender", T.StringType())])
KEY = ["run", "seq"]


def sent_rows(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """(run, seq) of the rows sent so far, those of the sender ``without`` left out."""
    sent = snapshots.scan_or_empty(spark, f"{root}/sent", _SENT)
    return (sent if without is None else sent.where(F.col("sender") != without)).select(*KEY)


def record_sent(rows: DataFrame, root: str, sender: str) -> None:
    """Mark history rows (run, seq) as sent by ``sender``; its earlier marks are replaced."""
    rows.select(*KEY).write.mode("overwrite").parquet(f"{root}/sent/sender={sender}")


def pending(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """Rows of the stored history that are neither flagged as notified nor marked as sent.

    The flag is pushed to the scan. Marks are joined by run and number, which spread evenly however long a run is.
    """
    history = snapshots.read_history(spark, f"{root}/history").where(~F.coalesce("notified", F.lit(False)))
    return history.join(sent_rows(spark, root, without), KEY, "left_anti").select(history.columns)
