"""Packing documents into sequences of a fixed length: a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.llm.common import in_file_order, ranked, row_places, stored
from postsieve.llm.tokens import encoder, slices


def best_config(sizes: np.ndarray, values: np.ndarray, capacity: int) -> Counter:
    """Pricing: the most valuable multiset of ``sizes`` within ``capacity``, by the knapsack recurrence over capacities."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes, values = sizes[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], taken[room] = best[room - 1], -1
        if fits[room]:
            gain = best[room - sizes[: fits[room]]] + values[: fits[room]]
            top = int(gain.argmax())
            if gain[top] > best[room]:
                best[room], taken[room] = gain[top], top
    found: Counter = Counter()
    room = capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            found[int(order[taken[room]])] += 1
            room -= int(sizes[taken[room]])
    return found


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200, rate: float = 3.0,
          covered: float = 0.985) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often to use each, by multiplicative weights on the covering constraints.

    A size's price starts at its share of the capacity and shrinks by exp(-``rate``) as its demand gets covered. Each
    round adds the configuration of most worth, by at most 1 / ``rounds`` of the volume bound and by no more than the
    demand that its sizes have left. It ends when ``covered`` of the volume is.
    """
    volume = float(sizes @ demand)
    step = max(1.0, volume / capacity / rounds)
    done = np.zeros(len(sizes))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    while float(sizes @ done) < covered * volume:
        left = demand - done
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        price = sizes[open_] / capacity * np.exp(-rate * done[open_] / demand[open_])
        config: dict[int, int] = {}
        room = capacity
        while room > 0 and len(open_):
            for i, n in best_config(sizes[open_], price, room).items():
                size = int(open_[i])
                config[size] = config.get(size, 0) + int(min(n, left[size] - config.get(size, 0)))
            taken = capacity - sum(int(sizes[i]) * n for i, n in config.items())
            spare = [j for j, i in enumerate(open_) if left[i] - config.get(int(i), 0) >= 1 and sizes[i] <= taken]
            if taken == room or not spare:
                break
            open_, price, room = open_[spare], price[spare], taken
        amount = min([step, *(left[i] / n for i, n in config.items())])
        for i, n in config.items():
            done[i] += amount * n
        name = tuple(sorted(config.items()))
        used[name] = used.get(name, 0.0) + amount
    return [(dict(c), x) for c, x in used.items()]


def _best_fit(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for the few items left: longest first, each into the fullest sequence that has room. Sequences with one content are kept as
    a count, and copies of a size are dealt to all of them at once."""
    rooms: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(capacity + 1)]
    for size, n in sorted(sizes, reverse=True):
        while n:
            room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
            if room is None:
                copies = min(n, capacity // size)
                same = n // copies
                name, room = ((size, copies),), capacity - size * copies
                n -= same * copies
            else:
                name, count = rooms[room].popitem()
                copies = min(room // size, n)
                same = min(count, n // copies)
                if count > same:
                    rooms[room][name] = count - same
                name, room = (*name, (size, copies)), room - size * copies
                n -= same * copies
            rooms[room][name] = rooms[room].get(name, 0) + same
    return [(dict(c), n) for r in rooms for c, n in r.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences for all items: configurations (size -> copies) and how many sequences each makes.

    The program's amounts are rounded down; what is left, the uncovered share and less than one sequence a configuration, is the histogram
    of the next program, until one no longer halves what is left. What remains then is bounded by the configurations, at most ``capacity`` items
    for each, and fills further sequences by best fit, longest first. So work and result depend on
    ``capacity`` and, by the number of programs, on the logarithm of the number of items.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0 and s < capacity), dtype=np.int64)
    used: Counter = Counter()
    if histogram.get(capacity):
        used[((capacity, 1),)] = histogram[capacity]
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    while left.sum():
        before, open_ = int(sizes @ left), np.flatnonzero(left)
        for config, amount in solve(sizes[open_], left[open_].astype(float), capacity):
            if whole := int(amount + 1e-9):
                used[tuple(sorted((int(sizes[open_[i]]), n) for i, n in config.items()))] += whole
                for i, n in config.items():
                    left[open_[i]] -= n * whole
        if int(sizes @ left) * 2 > before:
            break
    for config, n in _best_fit([(int(s), int(n)) for s, n in zip(sizes, left) if n], capacity):
        used[tuple(sorted(config.items()))] += n
    return [(dict(c), n) for c, n in used.items()]


def spread(configs: list[tuple[dict[int, int], int]], stretches: int = 64) -> list[tuple[dict[int, int], int]]:
    """The same sequences in ``stretches`` rounds, each with its part of every configuration, so that items of all lengths are used up evenly."""
    out = []
    for k in range(stretches):
        for i, (config, times) in enumerate(configs):
            shift = int(i * 0.6180339887 % 1 * stretches)
            if n := (times * (k + 1) + shift) // stretches - (times * k + shift) // stretches:
                out.append((config, n))
    return out


class Places:
    """Sequence and offset of the n-th item of each size, from a plan."""

    def __init__(self, configs: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter = Counter()
        base = 0
        for config, times in configs:
            offset = 0
            for size, copies in sorted(config.items(), reverse=True):
                rows.setdefault(size, []).append((taken[size], base, copies, offset))
                taken[size] += copies * times
                offset += size * copies
            base += times
        self.sequences = base
        self.rows = {s: np.array(x, dtype=np.int64).T for s, x in rows.items()}

    def of(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, copies, offset = self.rows[size]
        at = np.searchsorted(first, ranks, side="right") - 1
        turn, copy = np.divmod(ranks - first[at], copies[at])
        return base[at] + turn, offset[at] + copy * size


def pack(items: DataFrame, order: list[str], capacity: int = 2048, length_col: str = "length", buckets: int = 64, positions: int | None = None) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: no sequence is longer than ``capacity``, and none has a gap.

    ``order`` names columns that tell items apart. Lengths must be from 1 to ``capacity``; an item with any other or a null
    length gets nulls. Equal items each get their own place. ``items`` is read twice, so pass a stored table. The driver sees the histogram
    (at most ``capacity`` counts) and holds the plan (``plan``), which does not grow with the items but for a logarithm; items of one length are numbered
    in hash buckets, so a length that most items have is spread over tasks.

    With ``positions``, items have a ``_position`` below it, which is left out of the result: items of each length are taken in that order and sequences are
    numbered along it (``spread``), so a run of sequences holds about what a run of positions does.
    """
    fits = F.col(length_col).between(1, capacity)
    counted = items.filter(fits).groupBy(F.col(length_col).alias("l")).agg(F.count("*").alias("n")).collect()
    planned = plan({int(r["l"]): int(r["n"]) for r in counted}, capacity)
    places = Places(planned if positions is None else spread(planned))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        ranks = rank.to_numpy()
        for size, at in length.groupby(length).indices.items():
            sequence[at], offset[at] = places.of(int(size), ranks[at])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    names = [f"`{c}`" for c in items.columns if c not in ("sequence_id", "offset", "_position")]
    placed = ranked(items.filter(fits), length_col, order, buckets, "_rank", positions).withColumn("_at", place(F.col(length_col), F.col("_rank")))
    null = F.lit(None).cast("long")
    other = items.filter(F.coalesce(~fits, F.lit(True))).select(*names, null.alias("sequence_id"), null.alias("offset"))
    return placed.select(*names, F.col("_at.sequence_id"), F.col("_at.offset")).unionByName(other)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, spaces_dropped: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, ranks: tuple[str, str] | None = None, keep_places: bool = False) -> DataFrame:
    """Each document's token ids, the end id last, in pieces of at most ``capacity``: the first piece takes what is left over.

    Columns: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids`` (little-endian
    unsigned 32-bit integers), with ``keep_places`` also ``_file`` and ``_index`` (``row_places``). Null text is empty, so a document has one piece at least. Rows with equal ids are separate.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * keep_ids
    fields += [("_file", pa.string()), ("_index", pa.int64())] * keep_places
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary, spaces_dropped, ranks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = list(zip(*(c.to_pylist() for c in batch.columns[2:]))) or [()] * len(ids)
            for i, j in slices(texts):
                out: list[tuple] = []
                for doc, place, coded in zip(ids[i:j], at[i:j], known.encode([x or "" for x in texts[i:j]])):
                    coded += end
                    size = len(coded) // 4
                    head = size % capacity or capacity
                    bounds = [0, *range(head, size + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                        part = coded[4 * a : 4 * b]
                        out.append((doc, k, a, b - a, zlib.crc32(part), *[part] * keep_ids, *place))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", _file string, _index long" * keep_places
    more = row_places(docs) if keep_places else []
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), *more).mapInArrow(cut, ddl)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, in_order: bool = False, **options) -> DataFrame:
    """The pieces of ``token_pieces`` with their places from ``pack``. Pieces are stored, so texts are encoded once.

    With ``in_order`` sequences follow the order of ``docs`` in their files; without, a fixed shuffle.
    """
    pieces, positions = stored(docs.sparkSession, token_pieces(docs, vocabulary, end_id, capacity, keep_places=in_order, **options), "pieces"), None
    if in_order:
        pieces, positions = in_file_order(pieces)
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity, positions=positions)
