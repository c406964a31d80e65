"""Line dedup: a line that several documents hold stays only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import WHITE, lower_ascii, stored, whole_row


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(WHITE)))


def _exploded(marked: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line that is long enough: document, row, position, 128-bit hash of the key."""
    return (
        marked.filter(F.col("id").isNotNull())
        .select("id", "mark", F.posexplode("lines").alias("at", "line"))
        .select("id", "mark", "at", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "mark", "at", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"))
    )


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct), with its ``lines`` and ``kept`` ones (both arrays of text).

    Lines are what stands between ``\\n``; null or empty text is one empty line. A key (see ``line_key``) of at least
    ``min_chars`` code points that two or more ids hold loses all its lines except those of the smallest id. Rows with
    one id are one document and keep their own repeats; rows with a null id are left whole and make no other lose a
    line. Repeated rows each come out. An empty table gives an empty table.

    Only (id, hash) pairs go through the two shuffles by hash; whole texts move once, to meet their dropped positions.
    The repeated keys are stored before the join, so that a key held by very many documents can be split over tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines"),
        whole_row(docs).alias("row"),
    )
    thin = marked.select("id", "mark", "lines")
    held = _exploded(thin, min_chars).groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    repeated = stored(spark, held.filter(F.col("first") < F.col("last")).select("hash", "first"), "lines-repeated")
    losing = (
        _exploded(thin, min_chars).join(repeated, "hash").filter(F.col("id") > F.col("first"))
        .groupBy("id", "mark").agg(F.collect_set("at").alias("gone"))
    )
    losing = stored(spark, losing, "lines-dropped")
    staying = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return marked.join(losing, ["id", "mark"], "left").select(
        "row", "lines",
        F.when(F.col("gone").isNull(), F.col("lines"))
        .otherwise(F.transform(staying, lambda i: F.get(F.col("lines"), i))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated lines taken out of its text, same columns; a null text stays null.

    ``chars_col``, where ``docs`` has it, becomes the new length of a text that lost lines.
    """
    lost = F.size("kept") < F.size("lines")
    text = F.when(lost, F.array_join("kept", "\n")).otherwise(F.col(f"row.`{text_col}`"))
    out = mark_lines(docs, id_col, text_col, min_chars).withColumn("text_now", text)

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == text_col:
            return F.col("text_now").alias(name)
        if name == chars_col:
            return F.when(lost, F.length("text_now")).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old.alias(name)

    return out.select(*[column(name) for name in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Per row of ``docs``: id, lines before, lines dropped, SHA-256 of the text that is left."""
    return mark_lines(docs, id_col, text_col, min_chars).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
