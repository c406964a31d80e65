"""Session settings and the shared folder jobs keep intermediate tables in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "postsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on. ``master`` is for local use only."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Keys of a stream's state live on disk, not on the executors' heap.
        .config("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        # An endpoint answer with a key twice keeps the last one, as JSON readers do.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    use_utc(spark)
    return spark


def use_utc(spark: SparkSession) -> None:
    """Stored instants are UTC; display dates and casts follow the session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; a cluster without it is refused,
    because a folder of one machine would be lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="postsieve-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_dir(spark: SparkSession, label: str) -> str:
    """An unused sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
