"""Stored tables: JSON snapshots, versioned Parquet snapshots, the appended history."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.text import text_or
from postsieve.sources import schemas


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form the optimizer knows to be empty, so that joins with it vanish from the plan."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*nothing).where(F.lit(False))


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of one JSON array, with ``seq``, their place in it.

    Meant for the small stored tables: a JSON array cannot be split among tasks. FAILFAST, so
    that a damaged table stops the job instead of reading as empty.
    """
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("seq", F.monotonically_increasing_id())


def _unless_missing(read: Callable[[], DataFrame], otherwise: Callable[[], DataFrame]) -> DataFrame:
    """``read()``, or ``otherwise()`` where the path does not exist; any other fault is raised."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return otherwise()


def scan_sources_json(spark: SparkSession, path: str) -> DataFrame:
    """The tracked sources; "" in the two optional fields, and an instant that is none, become NULL.
    Missing file: no rows."""

    def read() -> DataFrame:
        return scan_json_array(spark, path, schemas.SOURCES_JSON).withColumns({
            "position": F.col("seq"),
            "last_job": F.nullif("last_job", F.lit("")),
            "last_checked": F.try_to_timestamp(F.nullif("last_checked", F.lit(""))),
        }).select(schemas.SOURCES.fieldNames())

    return _unless_missing(read, lambda: empty_table(spark, schemas.SOURCES))


def scan_history_json(spark: SparkSession, path: str) -> DataFrame:
    """The stored history; its dates carry no year, so ``found_at`` stays NULL. Missing file: no rows."""

    def read() -> DataFrame:
        df = scan_json_array(spark, path, schemas.HISTORY_JSON)
        return df.withColumn("found_at", F.lit(None).cast("timestamp")).select(schemas.HISTORY.fieldNames())

    return _unless_missing(read, lambda: empty_table(spark, schemas.HISTORY))


def scan_settings_json(spark: SparkSession, path: str) -> DataFrame:
    """The settings, one row. Missing file: no recipient."""

    def read() -> DataFrame:
        return spark.read.schema(schemas.SETTINGS).option("multiLine", True).option("mode", "FAILFAST").json(path)

    return _unless_missing(read, lambda: spark.range(1).select(F.lit("").alias("recipient_email")))


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, empty when it was never written. A damaged history read as empty would
    report every posting again, so any other fault is raised."""
    return _unless_missing(lambda: spark.read.schema(schema).parquet(path), lambda: empty_table(spark, schema))


# A snapshot table is a folder of complete versions plus a log naming the finished ones.
# A version counts only once its log entry is there, so readers never see half a write and
# a job may overwrite the table it reads. Each write has a folder of its own, so two writers never mix their
# files, and a version has one entry: who comes second with the same number is refused.
_LOG_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.LongType())])


class SnapshotConflict(Exception):
    """Another writer finished the version first: read it and try again."""


def _current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    log = scan_or_empty(spark, f"{root}/log", _LOG_SCHEMA)
    last = log.agg(F.max(F.struct("version", "name")).alias("last")).first()["last"]
    return last and (last["version"], last["name"])


def current_version(spark: SparkSession, root: str) -> int | None:
    current = _current(spark, root)
    return current and current[0]


def read_version(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """The table and the number of the version read, 0 before the first."""
    current = _current(spark, root)
    if current is None:
        return empty_table(spark, schema), 0
    return spark.read.schema(schema).parquet(f"{root}/data/version={current[1]}"), current[0]


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return read_version(spark, root, schema)[0]


def write_snapshot(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Replace the table by ``df``; returns the new version.

    With ``expected``, the version that ``df`` was made from, a version that came in between raises
    ``SnapshotConflict`` instead of being lost. The entry is made where none is; on storage without an atomic way to do that, two writers within the same
    moment may both pass, and readers then agree on one of them.
    """
    spark = df.sparkSession
    version = (current_version(spark, root) or 0 if expected is None else expected) + 1
    name = f"{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/version={name}")
    _finish(spark, root, version, name)
    return version


def _finish(spark: SparkSession, root: str, version: int, name: str) -> None:
    """Name the folder of a version in the log: from here on readers see it."""
    done = spark.createDataFrame([(name,)], "name string")
    try:
        done.coalesce(1).write.mode("error").parquet(f"{root}/log/version={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise SnapshotConflict(f"version {version} of {root} is there already") from error


def clear_snapshot(spark: SparkSession, root: str, schema: T.StructType) -> int:
    """Replace the table by no rows, keeping its columns."""
    return write_snapshot(empty_table(spark, schema), root)


# The history is a folder of runs. A run writes only its own folder, so old rows are never
# rewritten, and a repeated run replaces its own rows instead of adding them twice. Removals are
# kept beside the rows and taken off when the history is read. A row is known by its run and its
# sequence number: writers that begin together may give the same numbers, but no two write one run.
_STORED_HISTORY = T.StructType([*schemas.HISTORY.fields, T.StructField("run", T.StringType())])
_REMOVED = T.StructType([T.StructField("run", T.StringType()), T.StructField("seq", T.LongType())])
_CLEARED = T.StructType([T.StructField("run", T.StringType())])


# Runs that are finished can be merged: a version below ``merged`` holds their rows, in few files by number, and
# their keys, in buckets. The version names its runs, and readers pass over the folders of those. What belongs to a run stays known by its
# name: a run that is repeated after it was merged is taken from its own folder again.
_FINISHED = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
])
_MERGED = T.StructType([T.StructField("run", T.StringType()), T.StructField("high", T.LongType())])
_REOPENED = T.StructType([T.StructField("run", T.StringType()), T.StructField("version", T.LongType())])
_FACTS = T.StructType([T.StructField("rows", T.LongType()), T.StructField("buckets", T.IntegerType())])
_KEYS = T.StructType([T.StructField("key", T.LongType()), *[f for f in _STORED_HISTORY.fields if f.name in ("company", "title", "run", "seq")]])


@dataclass(frozen=True)
class Merged:
    """A version of the merged runs. ``runs`` are read from it; ``again`` were repeated since and are not. Both
    are names of folders, of which Spark lists every one on the driver whenever the history is read."""

    version: int
    folder: str
    runs: frozenset[str]
    again: frozenset[str]


def _merged(spark: SparkSession, root: str) -> Merged | None:
    current = _current(spark, f"{root}/merged")
    if current is None:
        return None
    folder = f"{root}/merged/data/version={current[1]}"
    runs = {r["run"] for r in spark.read.schema(_MERGED).parquet(f"{folder}/runs").select("run").collect()}
    again = scan_or_empty(spark, f"{root}/reopened", _REOPENED).where(F.col("version") == current[0]).select("run").distinct()
    repeated = {r["run"] for r in again.collect()}
    return Merged(current[0], folder, frozenset(runs - repeated), frozenset(repeated))


def _without_runs(rows: DataFrame, runs: set[str] | frozenset[str]) -> DataFrame:
    return rows.where(~F.col("run").isin(sorted(runs))) if runs else rows


def _parts(spark: SparkSession, root: str, merged: Merged | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the runs in folders of their own (a partition filter passes over the others), and merged rows."""
    loose = scan_or_empty(spark, f"{root}/rows", _STORED_HISTORY)
    if merged is None:
        return loose, None
    rows = spark.read.schema(_STORED_HISTORY).parquet(f"{merged.folder}/rows")
    return _without_runs(loose, merged.runs), _without_runs(rows, merged.again)


def _all_rows(spark: SparkSession, root: str, without_run: str | None, merged: Merged | None = None) -> DataFrame:
    loose, together = _parts(spark, root, merged or _merged(spark, root))
    df = loose if together is None else loose.unionByName(together)
    return df if without_run is None else df.where(F.col("run") != without_run)


def without_cleared(rows: DataFrame, root: str) -> DataFrame:
    cleared = scan_or_empty(rows.sparkSession, f"{root}/cleared", _CLEARED)
    return rows.join(cleared, "run", "left_anti").select(rows.columns)


def history_rows(spark: SparkSession, root: str, without_run: str | None = None) -> DataFrame:
    """All rows of the runs that were not cleared, removed ones among them; ``without_run`` leaves one run
    out (a partition filter), as a repeated run must not meet its own earlier rows."""
    return without_cleared(_all_rows(spark, root, without_run), root).select(_STORED_HISTORY.fieldNames())


def without_removed(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` (with run and seq) less the removed ones. Take them off a selection where there is one: then the
    selection is joined with the removals, and not the whole history."""
    spark = rows.sparkSession
    cleared = scan_or_empty(spark, f"{root}/cleared", _CLEARED)
    removed = scan_or_empty(spark, f"{root}/removed", _REMOVED).join(cleared, "run", "left_anti")
    return rows.join(removed, ["run", "seq"], "left_anti").select(rows.columns)


def read_history(spark: SparkSession, root: str, without_run: str | None = None) -> DataFrame:
    """The history rows there are now, without cleared and removed ones."""
    return without_removed(history_rows(spark, root, without_run), root)


def last_seq(spark: SparkSession, root: str, without_run: str | None = None) -> int:
    """Highest sequence number ever given, to removed rows too; -1 before the first."""
    merged = _merged(spark, root)
    numbers = _all_rows(spark, root, without_run, merged).select("seq")
    if merged:
        highest = _without_runs(spark.read.schema(_MERGED).parquet(f"{merged.folder}/runs"), merged.again)
        numbers = numbers.union((highest if without_run is None else highest.where(F.col("run") != without_run)).select("high"))
    return numbers.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]


def append_run(new: DataFrame, root: str, run: str) -> None:
    """Add the rows of one run. No rows leaves a folder that reads as no rows. That the run is finished is written down
    afterwards with its rows and numbers: only finished runs are merged."""
    spark = new.sparkSession
    new.select(schemas.HISTORY.fieldNames()).write.mode("overwrite").parquet(f"{root}/rows/run={run}")
    written = spark.read.schema(schemas.HISTORY).parquet(f"{root}/rows/run={run}")
    facts = written.agg(F.count("*").alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{root}/finished/run={run}")
    merged = _merged(spark, root)
    if merged and run in merged.runs:
        again = spark.createDataFrame([(run, merged.version)], _REOPENED)
        again.coalesce(1).write.mode("append").parquet(f"{root}/reopened")


def remove_rows(rows: DataFrame, root: str) -> None:
    """Remove the given history rows (with run and seq). They leave the dedup memory as well: a removed posting that
    turns up again is new again."""
    rows.select(_REMOVED.fieldNames()).write.mode("append").parquet(f"{root}/removed")


def clear_history(spark: SparkSession, root: str) -> None:
    """Remove all rows there are now, by the names of their runs; a repeat of such a run stays removed."""
    runs = history_rows(spark, root).select("run").distinct()
    runs.coalesce(1).write.mode("append").parquet(f"{root}/cleared")


def key_number(company: Column | str = "company", title: Column | str = "title") -> Column:
    """64-bit hash of a posting's key: what the keys of merged runs are put in buckets by."""
    return F.xxhash64(text_or(company), text_or(title))


def merge_runs(spark: SparkSession, root: str, buckets: int | None = None, rows_per_file: int = 2_000_000) -> int:
    """Merge the finished runs into one new version, without removed and cleared rows; returns the version, the old one if no run is new.

    The rows lie in files by number, about ``rows_per_file`` in each, so that a page opens few of them; (key, company, title, run, seq)
    lie in ``buckets`` by ``key_number`` (by default as many as there are files). Readers see the old version until the log
    names the new one, and all rows in both. A run is merged if its rows are those written down when it finished; others keep their folders. After a
    fault half a version is left that no reader sees. Two merges at once: the second raises ``SnapshotConflict``. Do not merge while a
    run that is finished already is being repeated. Folders of merged runs are not deleted, as older readers may be at them.
    """
    merged = _merged(spark, root)
    version = merged.version if merged else 0
    loose, together = _parts(spark, root, merged)
    done = _without_runs(scan_or_empty(spark, f"{root}/finished", _FINISHED), merged.runs if merged else set())
    found = loose.groupBy("run").agg(F.count("*").alias("n"), F.min("seq").alias("from"), F.max("seq").alias("to"))
    whole = F.coalesce("n", F.lit(0)).eqNullSafe(F.col("rows")) & F.col("from").eqNullSafe(F.col("low")) & F.col("to").eqNullSafe(F.col("high"))
    ready = done.join(found, "run", "left").where(whole).select("run", "high").collect()  # one row a folder
    if not ready:
        return version
    rows = loose.where(F.col("run").isin([r["run"] for r in ready]))
    rows = without_removed(without_cleared(rows if together is None else rows.unionByName(together), root), root)

    name = f"{version + 1}-{uuid.uuid4().hex}"
    folder = f"{root}/merged/data/version={name}"
    total = rows.count()
    files = max(1, -(-total // rows_per_file))
    rows.select(_STORED_HISTORY.fieldNames()).repartitionByRange(files, "seq", "run").sortWithinPartitions("seq", "run").write.parquet(f"{folder}/rows")
    runs = spark.createDataFrame([(r["run"], r["high"]) for r in ready], _MERGED)
    if merged:
        runs = runs.unionByName(_without_runs(spark.read.schema(_MERGED).parquet(f"{merged.folder}/runs"), {r["run"] for r in ready} | merged.again))
    runs.coalesce(1).write.parquet(f"{folder}/runs")
    _write_keys(spark.read.schema(_STORED_HISTORY).parquet(f"{folder}/rows"), f"{folder}/keys", buckets or files)
    spark.createDataFrame([(total, buckets or files)], _FACTS).coalesce(1).write.parquet(f"{folder}/facts")
    _finish(spark, f"{root}/merged", version + 1, name)
    return version + 1


def _write_keys(rows: DataFrame, path: str, buckets: int) -> None:
    """One sorted file for each bucket. Spark writes buckets only as a table; its entry in the catalog is dropped, its files stay."""
    spark = rows.sparkSession
    keyed = rows.withColumn("key", key_number()).select(_KEYS.fieldNames())
    name = f"history_keys_{uuid.uuid4().hex}"
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def history_keys(spark: SparkSession, root: str, without_run: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The history in two parts for a search by key: rows of runs that are not merged, and the bucketed keys (``_KEYS``) of those that are,
    None before the first merge. Cleared and removed rows are among them: see ``live_rows``.

    The buckets are declared as a table in the session's catalog, under a name made from their path.
    """
    merged = _merged(spark, root)
    loose, _ = _parts(spark, root, merged)
    keys = None
    if merged:
        path = f"{merged.folder}/keys"
        facts = spark.read.schema(_FACTS).parquet(f"{merged.folder}/facts").first()
        name = f"history_keys_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _KEYS.fields)
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                  f"INTO {facts['buckets']} BUCKETS LOCATION '{quoted}'")
        keys = _without_runs(spark.table(name), merged.again)
    if without_run is not None:
        loose = loose.where(F.col("run") != without_run)
        keys = None if keys is None else keys.where(F.col("run") != without_run)
    return loose, keys


def live_rows(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` (with run and seq) less those of cleared runs and the removed ones."""
    return without_removed(without_cleared(rows, root), root)
