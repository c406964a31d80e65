"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.llm.common import ranked, whole_row


def integer_weights(weights: Mapping[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole numbers.

    Weights with a small common denominator, such as those written with a few decimals, stay exact: the numbers are their ratios.
    Others are rounded, by largest remainders, to shares of ``resolution``, each at least 1.
    """
    names = sorted(weights)
    exact = [Fraction(str(weights[s])) for s in names]
    common = lcm(*(x.denominator for x in exact)) if max(x.denominator for x in exact) <= resolution else 0
    whole = [int(x * common) for x in exact]
    if common and sum(whole) // (divisor := gcd(*whole)) <= resolution:
        return {s: n // divisor for s, n in zip(names, whole)}
    resolution = max(resolution, 2 * len(names))
    free, total = resolution - len(names), sum(exact)
    shares = [x / total * free for x in exact]
    units = [1 + int(x) for x in shares]
    for i in sorted(range(len(names)), key=lambda i: (int(shares[i]) - shares[i], i))[: resolution - sum(units)]:
        units[i] += 1
    return dict(zip(names, units))


def pfair_slots(units: Mapping[str, int], blocks: Mapping[str, int]) -> tuple[list[str], bool]:
    """Earliest deadline first over blocks with Pfair windows, until a source has no block left or, if that is earlier, for one period; and whether
    it is a whole period, which repeats.

    Block k of a source with weight w = units / period is released at floor(k / w) and due at ceil((k + 1) / w). At
    each slot the released block with the earliest deadline runs, so every source's count stays
    within one block of w times the slots gone by.
    """
    period = sum(units.values())
    waiting = [(0, s, 0) for s in sorted(units)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slots = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // units[s]), -units[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        slots.append(s)
        if k + 1 == blocks[s] < units[s]:
            return slots, len(slots) == period
        if k + 1 < units[s]:
            heapq.heappush(waiting, ((k + 1) * period // units[s], s, k + 1))
    return slots, True


@dataclass
class SourceSlots:
    """Slots of a source's blocks: one entry for each stretch of the schedule with the same sources in it."""

    first_block: list[int] = field(default_factory=list)
    first_slot: list[int] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    period: list[int] = field(default_factory=list)

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), dtype=np.int64)
        stretch = np.searchsorted(self.first_block, blocks, side="right") - 1
        for i in np.unique(stretch):
            at = stretch == i
            turn, place = np.divmod(blocks[at] - self.first_block[i], len(self.places[i]))
            out[at] = self.first_slot[i] + turn * self.period[i] + self.places[i][place]
        return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], resolution: int) -> dict[str, SourceSlots]:
    """Where every block of every source goes, for sources with so many ``blocks``.

    Weighted sources run first, by their weights. When one has no block left, the others go on with the same whole
    weights, which are then larger shares. Sources without a positive weight follow, all alike, so that no row is lost. The schedule is worked out for
    one period at most between two sources' ends, and never for more slots than there are.
    """
    out = {s: SourceSlots() for s, n in blocks.items() if n > 0}
    weighted = {s: weights[s] for s in out if weights.get(s, 0) > 0}
    slot = 0
    for group in (weighted, {s: 1.0 for s in out if s not in weighted}):
        left = {s: blocks[s] for s in group}
        units = integer_weights(group, resolution) if group else {}
        while left:
            divisor = gcd(*(units[s] for s in left))
            now = {s: units[s] // divisor for s in left}
            order, whole = pfair_slots(now, left)
            size = len(order)
            turns = min(left[s] // now[s] for s in left) if whole else 0
            names = sorted(left)
            number = {s: i for i, s in enumerate(names)}
            coded = np.fromiter(map(number.__getitem__, order), dtype=np.int32, count=size)
            by_source = np.argsort(coded, kind="stable").astype(np.int32)
            bounds = np.searchsorted(coded[by_source], np.arange(len(names) + 1))
            places = {s: by_source[bounds[i] : bounds[i + 1]] for s, i in number.items()}
            over = {s: left[s] - turns * now[s] for s in left}
            # The part of a period until the first source has no block left.
            rest = min((int(places[s][n - 1]) + 1 for s, n in over.items() if 0 < n <= len(places[s])), default=0) if all(over.values()) else 0
            for s in names:
                out[s].first_block.append(blocks[s] - left[s])
                out[s].first_slot.append(slot)
                out[s].places.append(places[s])
                out[s].period.append(size)
                left[s] = over[s] - int(np.searchsorted(places[s], rest))
            slot += turns * size + rest
            left = {s: n for s, n in left.items() if n}
    return out


def sqrt_weights(rows: Mapping[str, int]) -> dict[str, float]:
    """Target weights in proportion to the square root of a source's rows, as whole numbers of a thousand for the largest, so that they are kept exactly."""
    top = max(rows.values(), default=1)
    return {s: max(1, round(1000 * (n / top) ** 0.5)) for s, n in rows.items()}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = 16, resolution: int | None = None, buckets: int = 1024) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct) with ``source_rank``, ``block``, ``slot`` and ``position`` in the mix.

    A source's rows, in a fixed shuffled order, are cut into blocks of ``block_rows``; blocks take the slots of
    ``schedule``. As long as no weighted source has run out, each one's share of any number of first blocks is
    within one block of its target. Weights with a small common denominator are kept exactly; others are shares of ``resolution``, 2**20 for up to eight sources and
    2**23 divided by their number for more, so that a schedule of a million blocks stays within one block of those as well (beyond, the rounding adds up). ``weights`` None means ``sqrt_weights``
    of the table, which are whole numbers. ``position`` numbers all rows from 0 without gaps.

    Null is a source like any other, and weighted by the key None. Rows with equal ids, null ids and repeated rows each get
    a place of their own. An empty table gives an empty table. The driver holds one count for each source and the
    schedule; rows are ranked in ``buckets`` hash buckets a source, so a hot source is spread.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    keyed = docs.select(
        key.alias("key"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tie"),
        whole_row(docs).alias("row"),
    )
    rows = {r["key"]: r["n"] for r in docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).collect()}
    named = sqrt_weights(rows) if weights is None else {"" if s is None else f"={s}": w for s, w in weights.items()}
    resolution = resolution or min(1 << 20, (1 << 23) // max(len(rows), 1))
    table = schedule({s: -(-n // block_rows) for s, n in rows.items()}, named, resolution)
    # A source's last block may be short: what later slots must move up by.
    last = sorted((int(table[s].slots(np.array([-(-n // block_rows) - 1]))[0]), -n % block_rows) for s, n in rows.items())
    ends, short = np.array([x for x, _ in last], dtype=np.int64), np.cumsum([0, *(y for _, y in last)])

    @F.pandas_udf(T.StructType([T.StructField("slot", T.LongType()), T.StructField("position", T.LongType())]))
    def place(source: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ranks = rank.to_numpy()
        blocks, slots = ranks // block_rows, np.zeros(len(ranks), dtype=np.int64)
        for s, at in source.groupby(source).indices.items():
            slots[at] = table[s].slots(blocks[at])
        positions = slots * block_rows + ranks % block_rows - short[np.searchsorted(ends, slots, side="left")]
        return pd.DataFrame({"slot": slots, "position": positions})

    placed = ranked(keyed, "key", ["id", "tie"], buckets, "source_rank").withColumn("at", place("key", "source_rank"))
    return placed.select(
        "row", F.col("source_rank").cast("long").alias("source_rank"),
        F.floor(F.col("source_rank") / block_rows).alias("block"), "at.slot", "at.position",
    )


def in_mixed_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """``docs`` in the order of the mix: range-partitioned and sorted by position, so its files follow it. Same columns."""
    placed = mix(docs, **options)
    spread = placed.repartitionByRange(partitions, "position") if partitions else placed.repartitionByRange("position")
    return spread.sortWithinPartitions("position").select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, source, place in its source, block, slot and position."""
    thin = docs.select(options.get("id_col", "doc_id"), options.get("source_col", "source"))
    return mix(thin, **options).select("row.*", "source_rank", "block", "slot", "position")
