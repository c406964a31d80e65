"""Pieces that several operators share."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.session import fresh_dir

#: The white space that separates words, and the letters that are lower-cased.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WHITE_RUN = "[ \\t-\\r]+"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it was."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of other characters than white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), lambda w: w != "")


def whole_row(df: DataFrame) -> Column:
    """Every column of a row in one struct, so that added columns cannot clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def id_remainder(id_column: Column, modulus: int = 5) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus``. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps survive lost executors and do not repeat it.

    Nothing reads the shuffle files of the write once it has ended, so executors drop them then.
    """
    path = fresh_dir(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def row_places(df: DataFrame) -> list[Column]:
    """Where each row stands in a table read from files: ``_file`` and ``_index`` in it. Of other tables, the partition and the place in that."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return [F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_index")]
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")]


def in_file_order(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``_file`` and ``_index`` made one number ``_position`` over all files by name, and how many numbers there are.

    The driver holds one count for each file.
    """
    sizes = sorted((r["_file"], r["n"]) for r in df.groupBy("_file").agg((F.max("_index") + 1).alias("n")).collect())
    firsts, total = [], 0
    for name, n in sizes:
        firsts.append((name, total))
        total += n
    first = df.sparkSession.createDataFrame(firsts, "_file string, _before long")
    return df.join(F.broadcast(first), "_file").withColumn("_position", F.col("_before") + F.col("_index")).drop("_file", "_index", "_before"), total


def ranked(df: DataFrame, key: str, order: list[str], buckets: int, rank: str = "rank", positions: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its ``key``.

    The order inside a key is by a hash of the ``order`` columns, then by those columns: a fixed shuffle. A key is
    dealt over ``buckets`` hash buckets that are numbered apart; per-bucket counts, added up over at most ``buckets``
    rows a key, give each bucket's first number. So no task holds a key's rows, however many there are.
    With ``positions`` the order is that of ``_position``, a number below it, and buckets are stretches of it.
    """
    if positions is None:
        mixed = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    else:
        mixed = df.withColumn("_h", F.col("_position")).withColumn("_b", F.floor(F.col("_h") / F.lit(max(positions, 1)) * buckets))
    counts = mixed.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(key, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(key, "_b").orderBy("_h", *order)
    return (
        mixed.withColumn("_r", F.row_number().over(inside))
        .join(first, [key, "_b"])
        .withColumn(rank, F.col("_first") + F.col("_r") - 1)
        .drop("_h", "_b", "_n", "_r", "_first")
    )


def reach_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it. On a cluster, ship it with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
