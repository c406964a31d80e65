"""Place of each row in its group without bringing a whole group to one task.

A window over the group would sort a group that holds a third of all rows in one task.
Here rows are first numbered inside slices of the order column (``seq`` div ``width``). As
``seq`` is a unique whole number, a slice of a group never holds more than ``width`` rows.
The slices of a group are then added up: that second window sees one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_WIDTH = 65_536


def slice_of(seq: Column | str, width: int) -> Column:
    """Whole-number slice, rounded down below zero too."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.call_function("div", seq - F.pmod(seq, F.lit(width)), F.lit(width))


def _slot(group: list[str], seq: str, width: int) -> Column:
    """(group, slice) as one struct: inside a struct NULL group values equal each other, so a
    join on it keeps them."""
    return F.struct(*group, slice_of(seq, width).alias("_slice"))


def slice_offsets(df: DataFrame, group: list[str], seq: str, width: int = SLICE_WIDTH) -> DataFrame:
    """(slot, rows in the slice, rows before it, rows of the group), from a count that folds map-side."""
    counts = df.groupBy(_slot(group, seq, width).alias("_slot")).agg(F.count("*").alias("_n"))
    of_group = Window.partitionBy(*[F.col("_slot")[g] for g in group])
    running = of_group.orderBy("_slot._slice").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "_slot", "_n",
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(of_group).alias("_total"),
    )


def with_positions(
    df: DataFrame, group: list[str], seq: str,
    position: str = "position", total: str = "total", width: int = SLICE_WIDTH,
) -> DataFrame:
    """Add ``position`` (0 for the smallest ``seq`` of the group) and ``total`` (rows of the group).

    The rows move once, by (group, slice); numbering and the join with the slice offsets share
    that. ``df`` is read twice, the first time only for group and ``seq``: pass a stored table.
    """
    in_slice = Window.partitionBy("_slot").orderBy(seq)
    numbered = (
        df.withColumn("_slot", _slot(group, seq, width))
        .withColumn("_in_slice", F.row_number().over(in_slice) - 1)
    )
    joined = numbered.join(slice_offsets(df, group, seq, width), "_slot")
    return joined.select(
        *df.columns,
        (F.col("_before") + F.col("_in_slice")).cast("bigint").alias(position),
        F.col("_total").alias(total),
    )
