"""First occurrences, new postings, fallback rows, unions.

Rows are reduced to one per key before they are joined, so a key that holds a large part
of all rows is folded inside the map tasks and reaches the shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import text_or

KEY = ["company", "title"]

# Largest key set sent to every executor by ``new_postings``, in bytes of key text.
PROBE_LIMIT = 64 * 1024 * 1024


def normal_keys(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """NULL keys become "": two rows without a title are the same posting, and a plain equality
    join (which shares its shuffle with the grouping) never matches NULLs."""
    return df.withColumns({k: text_or(k) for k in keys})


def keep_first(df: DataFrame, keys: list[str] = KEY, order: list[str] | str = "ord") -> DataFrame:
    """The first row of each key in ``order``, which must tell the rows of a key apart.

    Spark turns "row number one" into a group limit that runs before the shuffle as well, so
    one row per key and task is moved, and the result arrives sorted for a join on the keys.
    ``dropDuplicates`` would keep any row; ``min_by`` over whole rows measured slower.
    """
    order = [order] if isinstance(order, str) else order
    in_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(in_key)).where(F.col("_nth") == 1).drop("_nth")


def _key_set(df: DataFrame, keys: list[str], unique: bool) -> DataFrame:
    found = normal_keys(df.select(*keys), keys)
    return found if unique else found.distinct()


def new_postings(
    batch: DataFrame, history: DataFrame, keys: list[str] = KEY, order: list[str] | str = "ord",
    history_unique: bool = False,
) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``history``, the first of each key.

    One shuffle of the folded batch serves both the grouping and the anti-join. Pass
    ``history_unique`` for a table this package wrote: its keys need no folding.
    """
    firsts = keep_first(normal_keys(batch, keys), keys, order)
    return firsts.join(_key_set(history, keys, history_unique), keys, "left_anti")


def key_bytes(firsts: DataFrame, keys: list[str] = KEY) -> int:
    """Bytes of key text in a stored batch: the size check in front of ``probe_new_postings``."""
    size = sum((F.octet_length(k) for k in keys[1:]), F.octet_length(keys[0]))
    return firsts.agg(F.coalesce(F.sum(size.cast("bigint") + 32), F.lit(0))).first()[0]


def probe_new_postings(
    firsts: DataFrame, history: DataFrame, keys: list[str] = KEY, limit: int = PROBE_LIMIT,
    live: Callable[[DataFrame], DataFrame] | None = None,
    index: DataFrame | None = None, number: Callable[..., Column] | None = None,
) -> DataFrame:
    """As ``new_postings`` for a large history and a stored, already folded batch.

    An anti-join can only broadcast its right side, here the history, so it shuffles the
    whole history. While the batch keys measure no more than ``limit`` they are sent to the
    history instead, and only the history keys that match travel. A larger batch takes the
    shuffled anti-join. ``live`` takes rows off that are in ``history`` but do not count, such as removed ones; it
    sees only rows with a key of the batch.

    ``index`` holds the rest of the history, with ``key`` = ``number(*keys)`` and in buckets by it (``snapshots.history_keys``): whatever the
    size of the batch, the batch goes to the buckets, and the rows whose number the batch has are then compared by their keys.
    """
    past = normal_keys(history, keys)
    small = key_bytes(firsts, keys) <= limit
    if small:
        past = past.join(F.broadcast(firsts.select(*keys)), keys, "left_semi")
    if index is not None:
        numbers = firsts.select(number(*keys).alias("key"))
        met = normal_keys(index.join(F.broadcast(numbers) if small else numbers, "key", "left_semi"), keys)
        past = past.select(*keys, "run", "seq").unionByName(met.select(*keys, "run", "seq"))
    past = live(past) if live else past
    return firsts.join(past.select(*keys).distinct(), keys, "left_anti")


def fallback_rows(
    preferred: DataFrame, other: DataFrame, source: str = "company", failed: DataFrame | None = None
) -> DataFrame:
    """All ``preferred`` rows, and ``other`` rows of the sources that have none and did not fail.

    The right side is not made distinct: an anti-join needs no unique keys, and without an aggregate before it a hot source can be split.
    """
    covered = preferred.select(source)
    if failed is not None:
        covered = covered.unionByName(failed.select(source))
    return preferred.unionByName(other.join(covered, source, "left_anti"))


def append_rows(history: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union; columns one side lacks are NULL."""
    return history.unionByName(new, allowMissingColumns=True)
