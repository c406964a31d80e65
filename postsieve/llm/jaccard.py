"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, by DivideSkip.

Two documents link when the Jaccard similarity of their shingle sets reaches num / den. Three steps find the groups exactly:

1. *Meeting keys.* Sets that link differ in at most H shingles, H known from their sizes. Each set is dealt by hash into more than H parts, so
   linked sets have equal parts; a part's hash is a key. How many keys sets that link have in common at least follows from their sizes and empty parts.
2. *Groups.* Common keys of two ids are counted. Ids with enough of them, directly or over others, form a group; no link leaves it.
3. *Search.* Within blocks of a group, an inverted index of shingles is asked for the sets that occur in T lists.

A group of many sets is first grouped anew by its rare shingles, as a phrase that many texts have makes sets meet that do not link. A set that links has few
shingles that no other set has; one with more of them is left out. Of the others, the first shingles in one order for all sets, rare ones first, are the keys (prefix filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.llm.common import LOWER, UPPER, ranked, stored
from postsieve.llm.graph import Forest, components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_U = np.uint64


class _WordHashes(dict):
    """64-bit hashes of words, kept between documents."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole UTF-8 text.

    Words are what white space separates, A-Z lower-cased. Fewer words than ``width`` make one shingle, none an empty set.
    """
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(_HASHES.__getitem__, found)), dtype=np.int64).view(np.uint64)
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, _U(span))
    for k in range(span):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


class Parts:
    """Keys of a set such that any two sets with similarity ``num / den`` or more have one in common.

    Sizes fall into bands, each 1.5 times as wide as the one before. Sets of band k, and those of the band below that are large enough to link
    upwards, use the same number of parts there. A part that is empty gives no key; a set with more empty parts than there
    are spare ones is dealt again with the next seed as well, and after the last seed gives keys for empty parts too. So of two sets that link, either
    one has too few empty parts for all equal parts to be empty, or both try the next seed.
    """

    SEEDS = 4

    def __init__(self, num: int, den: int):
        if num * 3 < den * 2:
            raise ValueError("sets of a similarity below 2/3 may be more than one band apart")
        self.num, self.den = num, den
        self.limits = [1]
        while self.limits[-1] < 1 << 40:
            self.limits.append(max(self.limits[-1] + 1, self.limits[-1] * 3 // 2))

    def keys(self, found: np.ndarray) -> np.ndarray:
        return self.keys_and_marks(found)[0]

    def keys_and_marks(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and for each its mark: 65,536 times its deal (band and seed), plus the number of keys of that deal that a set which links has too, 65,535 at most.

        Two sets that link have a deal in which they have one common key at least, and as many as either number says: of 1 + spare equal parts or more, only those
        give no key that are empty in both.
        """
        n = len(found)
        band = int(np.searchsorted(self.limits, n, side="right")) - 1
        out = self._band_keys(found, band)
        if n * self.den >= self.limits[band + 1] * self.num:
            out += self._band_keys(found, band + 1)
        return np.concatenate([k for k, _ in out]), np.concatenate([np.full(len(k), mark) for k, mark in out])

    def _band_keys(self, found: np.ndarray, band: int) -> list[tuple[np.ndarray, int]]:
        largest = self.limits[band + 1] - 1
        differ = 2 * largest * (self.den - self.num) // (self.den + self.num)
        spare = 0 if not differ else 1 + differ // (5 if self.num * 10 < self.den * 9 else 40)
        parts = differ + 1 + spare
        out = []
        for seed in range(self.SEEDS):
            dealt = (_mixed(found + _U(seed + 1)) >> _U(11)) % _U(parts)
            order = np.argsort(dealt, kind="stable")
            place = dealt[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            sums = np.add.reduceat(_mixed(found ^ _U(0xA0761D6478BD642F))[order], first)
            full = place[first]
            mark = (band * self.SEEDS + seed) << 16 | min(max(1 + spare - (parts - len(full)), 0), 65_535)
            out.append((_mixed(sums + _mixed(full + _U(band << 48) + _U(seed << 44))), mark))
            if parts - len(full) <= spare:
                break
            if seed == self.SEEDS - 1:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), full)
                out.append((_mixed(_mixed(empty + _U(band << 48) + _U(seed << 44))), mark))
        return out


def divide_skip(sets: list[np.ndarray], same: list[int], num: int, den: int, mu: float = 0.5) -> list[int]:
    """Trees of the sets that links join: for each set the lowest number in its tree.

    ``same`` gives trees known before; links inside a tree are not looked for. Sets ask in order of size. A set x needs T = num / den of
    |x| shingles in common with a smaller one. Its L longest lists are put aside; the short ones are merged, which leaves
    the sets that stand in T - L of them, and only those are looked up in the long lists by binary search. Among candidates of
    one tree the best goes first, and a hit ends the search in that tree. ``mu`` weighs a look-up against a merged posting: the larger it is,
    the fewer lists are put aside. Merging runs over arrays and a look-up is a call, so it is larger than for lists in memory pages.
    """
    forest = Forest(len(sets))
    for i, j in enumerate(same):
        forest.union(i, j)
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return forest.roots().tolist()
    sizes = np.array([len(sets[i]) for i in order])
    elements, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(order)), sizes)
    postings_at = np.argsort(codes, kind="stable")
    postings = owner[postings_at]
    lookup = codes[postings_at] * len(order) + postings
    counts = np.bincount(codes, minlength=len(elements))
    start = np.concatenate(([0], np.cumsum(counts)))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    longest = np.log2(max(2, counts.max()))
    for x in range(1, len(order)):
        mine = codes[begin[x] : begin[x + 1]]
        n = len(mine)
        least = -(-num * n // den)
        aside = min(int(least / (mu * longest + 1)), least - 1)
        by_length = mine[np.argsort(counts[mine], kind="stable")]
        short, long_ = by_length[: n - aside], by_length[n - aside :]
        short = short[counts[short] > 1]
        if not len(short):
            continue
        lens = counts[short]
        at = np.repeat(start[short] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        merged = np.bincount(postings[at], minlength=len(order))[:x]
        able = np.flatnonzero((merged >= least - aside) & (sizes[:x] * den >= num * n))
        able = able[np.argsort(-merged[able], kind="stable")]
        while len(able):
            own = forest.find(order[x])
            roots = np.array([forest.find(order[j]) for j in able])
            able, roots = able[roots != own], roots[roots != own]
            if not len(able):
                break
            turn = np.unique(roots, return_index=True)[1]
            for j in able[turn]:
                want = long_ * len(order) + j
                place = np.searchsorted(lookup, want)
                both = int(merged[j] + np.count_nonzero(lookup[np.minimum(place, len(lookup) - 1)] == want))
                if den * both >= num * (n + sizes[j] - both):
                    forest.union(order[x], order[j])
            able = np.delete(able, turn)
    return forest.roots().tolist()


ROWS = "kind int, key long, id long, n long, print long, other long"
_SCHEMA = pa.schema([("kind", pa.int32()), *((name, pa.int64()) for name in ("key", "id", "n", "print", "other"))])
_MANY = 2_000_000


def _batch(kind: int, key, ids, n, print_, other) -> pa.RecordBatch:
    key = np.ascontiguousarray(key).view(np.int64)
    column = lambda x: pa.array(x.view(np.int64) if isinstance(x, np.ndarray) else np.full(len(key), x), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key), *map(column, (ids, n, print_, other))], schema=_SCHEMA)


def _by_key(keys: list[np.ndarray], ids: list[int], *more: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Ids, and for every key in order: the place of its set's id, the key, whether it is the first one of its kind, and ``more``."""
    names, at = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
    owner, every = np.repeat(at, [len(k) for k in keys]), np.concatenate(keys)
    order = np.lexsort((owner, every))
    owner, every = owner[order], every[order]
    return names, owner, every, np.concatenate(([True], every[1:] != every[:-1])), *(np.concatenate(x)[order] for x in more)


def _grouped(keys: list[np.ndarray], ids: list[int], marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The documents that meet, grouped, each with the smallest id of its group (2); and one row with a group's smallest id for each key (1).

    A group that many documents are in so sends the same few pairs of ids for all its keys.
    """
    names, owner, every, first = _by_key(keys, ids)
    lowest = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    forest = Forest(len(names))
    for i, j in np.unique(np.stack([owner, lowest])[:, owner != lowest], axis=1).T.tolist():
        forest.union(i, j)
    root = names[forest.roots()]
    yield _batch(1, every[first], root[owner[first]], 0, 0, 0)
    own = np.flatnonzero(root != names)
    if len(own):
        yield _batch(2, _mixed(names[own].view(np.uint64)), names[own], 0, 0, root[own])


def _listed(keys: list[np.ndarray], ids: list[int], marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each key the smallest id that has it, with the key's mark and whether others here have it (1); those others, by a hash of their own, with mark and key (2)."""
    names, owner, every, first, mark = _by_key(keys, ids, marks)
    several = np.concatenate((~first[1:], [False]))
    yield _batch(1, every[first], names[owner[first]], mark[first], several[first].astype(np.int64), 0)
    own, more = names[owner[~first]], every[~first]
    if len(own):
        yield _batch(2, _mixed(more ^ _mixed(own.view(np.uint64))), own, mark[~first], 0, more)


def _keys_of(keys_for, width: int, told):
    """Per task, with the keys that ``keys_for`` gives for a set (and their marks) and what the row's further columns hold: a row for each document (kind 0); and what ``told`` makes of the keys.

    That is at most one row a key of kind 1. Rows of kinds 0 and 2 only pass by the search for
    common keys: their key is a hash of their own, so copies and equal ids do not meet in one task. Without further columns equal sets have equal keys, and of
    those held together the smallest id gives them for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        ids: list[int] = []
        place: dict[tuple, int] = {}
        held = 0
        for rows in batches:
            docs, texts = rows.column(0).to_pylist(), rows.column(1).cast(pa.binary())
            more = [c.to_pylist() for c in rows.columns[2:]]
            about = np.zeros((4, len(docs)), dtype=np.int64)
            alone = _mixed(np.array(docs, dtype=np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15) + np.arange(len(docs), dtype=np.uint64))
            for i, doc in enumerate(docs):
                found = shingles(texts[i].as_py(), width)
                prints = [int(_mixed(found + _U(s)).sum(dtype=np.uint64).view(np.int64)) for s in (17, 71)]
                about[:, i] = (doc, len(found), *prints)
                same = (len(found), *prints)
                if same in place:
                    ids[place[same]] = min(ids[place[same]], doc)
                    continue
                own, mark = keys_for(found, *(c[i] for c in more)) if len(found) else (found, found)
                if len(own):
                    if not more:
                        place[same] = len(ids)
                    keys.append(own)
                    marks.append(mark)
                    ids.append(doc)
                    held += len(own)
                if held > _MANY:
                    yield from told(keys, ids, marks)
                    keys, marks, ids, place, held = [], [], [], {}, 0
            yield _batch(0, alone, *about)
        if keys:
            yield from told(keys, ids, marks)

    return run


def _met(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Rows of ``_keys_of`` and ``_grouped``, stored, with ``low``, the smallest id that has a key; of the keys, only those that give a link."""
    lowest = F.expr("CASE WHEN kind = 1 THEN min(id) OVER (PARTITION BY kind, key) END")
    return stored(spark, rows.withColumn("low", lowest).filter("kind <> 1 OR id > low"), label)


def _may_link(met: DataFrame) -> DataFrame:
    """Pairs of ids that have a key in common, enough of them to reach all."""
    return met.filter("kind = 1").select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(
        met.filter("kind = 2").select(F.col("id").alias("a"), F.col("other").alias("b")))


def _enough_keys(held: DataFrame, few: int) -> DataFrame:
    """Pairs of ids of ``held`` (key, id, mark) with as many common keys of a deal as sets that link have, or more; enough pairs to reach all such ids.

    A key of at most ``few`` ids gives all their pairs, so there are at most few / 2 pairs for each row, and they are counted. A key that more ids have is a frequent one and
    gives no pairs, so a set asks for fewer of the others: for the number in its mark less its own frequent keys of the deal. Where nothing is left to ask for, its
    frequent keys link it with the smallest id of which the same holds. Of two sets that link, either both are of that kind and a frequent key links them, or they
    have one other key in common at least, and as many as either asks for.
    """
    spark = held.sparkSession
    held = held.withColumn("deal", F.shiftright("mark", 16))
    frequent = held.groupBy("key").agg(F.count("*").alias("ids")).filter(F.col("ids") > few).select("key", F.lit(1).alias("frequent"))
    marked = held.join(stored(spark, frequent, "frequent-keys"), "key", "left").withColumn("frequent", F.coalesce("frequent", F.lit(0)))
    asks = F.col("mark") - F.shiftleft("deal", 16) - F.sum("frequent").over(Window.partitionBy("id", "deal"))
    marked = stored(spark, marked.select("key", "id", "deal", "frequent", asks.alias("asks")), "keys-marked")
    one = marked.filter("frequent = 0").select("key", "deal", F.col("id").alias("a"), F.col("asks").alias("x"))
    other = marked.filter("frequent = 0").select("key", F.col("id").alias("b"), F.col("asks").alias("y"))
    pairs = one.join(other.hint("merge"), "key").filter("a > b").groupBy("a", "b", "deal").agg(F.count("*").alias("both"), F.min(F.greatest("x", "y")).alias("asks"))
    over = stored(spark, marked.filter("frequent = 1 AND asks <= 0").select("key", "id"), "keys-over")
    low = stored(spark, over.groupBy("key").agg(F.min("id").alias("low")), "keys-low")
    stars = over.join(low, "key").filter("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return pairs.filter("both >= asks").select("a", "b").unionByName(stars.distinct())


def _looked_at(num: int, den: int) -> int:
    """One shingle in so many, by hash, is looked up in all sets: more than a set that links may have for itself."""
    return 4 if num * 10 >= den * 9 else 2


def _common(width: int, every: int):
    """Per task, of the shingles looked at: a row for each one that one of its sets has (kind 0); for each set with one that others of the task have too (1); per set its size and how many are looked at (2).

    Rows of kinds 1 and 2 only pass by: their key is a hash of their own, so a shingle that very many sets have meets in one task no more often than there are tasks.
    """

    def batch(kind: int, key, ids, shingle, n) -> pa.RecordBatch:
        whole = [np.ascontiguousarray(x).view(np.int64) for x in (key, ids, shingle, n)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), *map(pa.array, whole)], names=["kind", "key", "id", "shingle", "n"])

    def told(sets: list[np.ndarray], sizes: list[int], ids: list[int]) -> Iterator[pa.RecordBatch]:
        looked = np.array([len(x) for x in sets], dtype=np.int64)
        names = np.array(ids, dtype=np.int64)
        yield batch(2, _mixed(names.view(np.uint64)), names, looked, np.array(sizes, dtype=np.int64))
        owner, found = np.repeat(names, looked), np.concatenate(sets)
        order = np.argsort(found, kind="stable")
        owner, found = owner[order], found[order]
        first = np.concatenate((np.ones(min(len(found), 1), dtype=bool), found[1:] != found[:-1]))
        yield batch(0, found[first], owner[first], *np.zeros((2, first.sum()), dtype=np.int64))
        several = np.concatenate((~first[1:], np.zeros(min(len(found), 1), dtype=bool))) | ~first
        owner, found = owner[several], found[several]
        yield batch(1, _mixed(found ^ _mixed(owner.view(np.uint64))), owner, found, np.zeros(len(found), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sizes, ids, held = [], [], [], 0
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary())):
                found = shingles(text.as_py(), width)
                ids.append(doc)
                sizes.append(len(found))
                sets.append(found[found % _U(every) == 0])
                held += len(sets[-1])
                if held > _MANY:
                    yield from told(sets, sizes, ids)
                    sets, sizes, ids, held = [], [], [], 0
        if ids:
            yield from told(sets, sizes, ids)

    return run


def _rare_first(num: int, den: int, every: int):
    """Keys of a set and of its shingles that other sets have: of its first shingles in the order, those that others may have.

    The order: shingles looked at that no other set has, those not looked at, those that others have; by hash inside. It is one for all sets, so that two sets
    of similarity ``num / den`` have one of their first n - T + 1 in common, where T = num / den of n.
    """

    def keys(found: np.ndarray, common: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        shared = np.isin(found, np.array(common or [], dtype=np.int64).view(np.uint64))
        kind = np.where(found % _U(every) != 0, 1, np.where(shared, 2, 0))
        first = np.argsort(kind, kind="stable")[: len(found) + (-num * len(found) // den) + 1]
        own = found[first][kind[first] > 0]
        return own, np.zeros(len(own), dtype=np.int64)

    return keys


def _regrouped(texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """``id`` and ``grp`` of those sets of ``texts`` (id, text) that may link, by their rare shingles.

    Of two that link each has at least T of its n shingles in the other, so at most n - T that no other set has.
    """
    spark, every = texts.sparkSession, _looked_at(num, den)
    rows = texts.select("id", "text").mapInArrow(_common(width, every), "kind int, key long, id long, shingle long, n long")
    rows = rows.withColumn("sets", F.expr("CASE WHEN kind = 0 THEN count(*) OVER (PARTITION BY kind, key) END"))
    rows = rows.filter("kind > 0 OR sets > 1").select("kind", "id", F.when(F.col("kind") == 0, F.col("key")).otherwise(F.col("shingle")).alias("shingle"), "n")
    rows = stored(spark, rows, "common")
    # A task's shingle of several sets stands for one of them too.
    common = rows.filter("kind < 2").select("id", "shingle").distinct().groupBy("id").agg(F.collect_list("shingle").alias("common"), F.count("*").alias("shared"))
    sizes = rows.filter("kind = 2").groupBy("id").agg(F.sum("n").alias("n"), F.sum("shingle").alias("looked"), F.count("*").alias("texts"))
    own = F.col("looked") - F.coalesce("shared", F.lit(0))
    left = sizes.join(common, "id", "left").filter((F.col("texts") > 1) | (own * den <= F.col("n") * (den - num)))
    left = stored(spark, left.select("id", "common"), "left")
    keyed = texts.select("id", "text").join(left, "id").select("id", "text", "common")
    met = _met(spark, keyed.mapInArrow(_keys_of(_rare_first(num, den, every), width, _grouped), ROWS), "rare-met")
    return components(spark, _may_link(met)).select("id", F.col("component").alias("grp"))


def _search(num: int, den: int, width: int):
    """Rows (block, id, label, text), sorted by block: (a, b) for each id whose tree the search in its block joins to another."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def joined(ids: list[int], labels: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        first: dict[int, int] = {}
        same = [first.setdefault(label, i) for i, label in enumerate(labels)]
        roots = divide_skip(sets, same, num, den)
        pairs = [(labels[i], labels[r]) for i, r in enumerate(roots) if labels[i] != labels[r]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, labels, sets = None, [], [], []
        for rows in batches:
            texts = rows.column(3).cast(pa.binary())
            for i, (at, doc, label) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(3)))):
                if at != block:
                    if len(ids) > 1:
                        yield joined(ids, labels, sets)
                    block, ids, labels, sets = at, [], [], []
                ids.append(doc)
                labels.append(label)
                sets.append(shingles(texts[i].as_py(), width))
        if len(ids) > 1:
            yield joined(ids, labels, sets)

    return run


def _searched(rows: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Links that the search finds in each ``block`` of ``rows`` (block, id, label, text)."""
    # The number is given, since blocks of few bytes may still take long: they are not to be put together by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("block", "id", "label", "text").repartition(tasks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_search(num, den, width), "a long, b long")


def linked_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, block_rows: int = 256, pair_rows: int = 2048,
                  id_col: str = "doc_id", text_col: str = "text", few: int = 8) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_shingles`` (size of its set) and ``component_id`` (smallest id that its links reach).

    Whole texts are used. A null or empty text, or one without words, has an empty set and links with nothing; so does a row with a
    null id, whose component is null. Rows with one id count as one document and each come out; equal texts link.
    An empty table gives an empty table; other columns are not read. Equal sets are told by 128 bits of sums of their shingles' hashes.

    What grows: keys, about a sixth of the words, go through one shuffle, at most one row for each key and task, so a key that very many documents have is no
    hot group. Those of several sets, with their ids, are stored and counted by pairs: a key of more than ``few`` sets gives no pairs, so the pairs grow with the keys and not with the square of a
    group. Only documents that have enough keys in common with another move their text. Groups of more than ``block_rows`` sets are grouped anew by rare shingles (half of the shingles, or a
    quarter, go through one shuffle for that); one that still has more is
    searched in blocks: first each block, then the trees' first members against each other as long as that more than halves them, last all pairs of blocks, now of ``pair_rows`` sets, that still
    hold different trees: a text moves once for each such block of its group. That is every pair which may link; copies and sets of one tree are never compared again.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = named.filter("id is not null").mapInArrow(_keys_of(Parts(num, den).keys_and_marks, width, _listed), ROWS)
    rows = rows.withColumn("tasks", F.expr("CASE WHEN kind = 1 THEN count(*) OVER (PARTITION BY kind, key) END"))
    met = stored(spark, rows.filter("kind <> 1 OR print = 1 OR tasks > 1").drop("tasks"), "keys-met")
    about = met.filter("kind = 0").select("id", "n", "print", "other")
    first = stored(spark, about.filter("n > 0").groupBy("n", "print", "other").agg(F.min("id").alias("rep")), "sets")
    members = stored(spark, about.join(first, ["n", "print", "other"], "left").select("id", "n", "rep"), "members")

    held = met.filter("kind > 0").select(F.when(F.col("kind") == 1, F.col("key")).otherwise(F.col("other")).alias("key"), "id", F.col("n").alias("mark"))
    held = stored(spark, held.join(first.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "keys-held")
    may = _enough_keys(held, few).unionByName(members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    groups = components(spark, may)
    reps = first.select(F.col("rep").alias("id")).distinct().join(groups, "id").select("id", F.col("component").alias("grp"))
    sized = stored(spark, ranked(reps, "grp", ["id"], 64, "rank"), "groups")
    several = sized.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1")
    chosen = stored(spark, sized.join(stored(spark, several, "group-sizes"), "grp"), "chosen")
    # Merged at every size: the plan does not change where the chosen ids outgrow a broadcast.
    texts = chosen.join(named.hint("merge"), "id").select("id", "grp", "size", "text", F.xxhash64("grp", F.floor(F.col("rank") / block_rows)).alias("block"))
    texts = stored(spark, texts, "texts")
    large = F.col("size") > block_rows
    links = stored(spark, _searched(texts.filter(~large).withColumn("label", F.col("id")), num, den, width), "links")
    if not chosen.filter(large).isEmpty():
        texts = texts.filter(large).select("id", "text")
        sized = stored(spark, ranked(_regrouped(texts, num, den, width), "grp", ["id"], 64, "rank"), "groups")
        several = stored(spark, sized.groupBy("grp").agg(F.count("*").alias("size")), "group-sizes")
        texts = texts.join(sized.join(several, "grp"), "id")
        texts = stored(spark, texts.select("id", "grp", "size", "text", F.xxhash64("grp", F.floor(F.col("rank") / block_rows)).alias("block")), "texts")
        links = stored(spark, links.unionByName(_searched(texts.withColumn("label", F.col("id")), num, den, width)), "links")
        if not several.filter(large).isEmpty():
            links = _across_blocks(texts.filter(large).select("id", "grp", "text"), links, num, den, width, block_rows, pair_rows)

    found = components(spark, links)
    return members.join(found, members["rep"] == found["id"], "left").select(
        members["id"], F.col("n").alias("n_shingles"), F.coalesce("component", "rep", members["id"]).alias("component_id")
    ).unionByName(
        named.filter("id is null").select("id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    )


def _across_blocks(texts: DataFrame, links: DataFrame, num: int, den: int, width: int, block_rows: int, pair_rows: int) -> DataFrame:
    """``links`` and those between blocks of the large groups in ``texts`` (id, grp, text)."""
    spark = texts.sparkSession

    def labelled(known: DataFrame) -> DataFrame:
        trees = components(spark, known)
        thin = texts.select("id", "grp").distinct()
        return stored(spark, thin.join(trees, "id", "left").select("id", "grp", F.coalesce("component", "id").alias("label")), "trees")

    while True:  # Each round has less than half the heads of the one before; what it leaves open, the pairs of blocks decide.
        now = labelled(links)
        heads = ranked(now.filter("id = label"), "grp", ["id"], 64, "rank")
        heads = stored(spark, heads.withColumn("block", F.xxhash64("grp", F.floor(F.col("rank") / block_rows))).select("id", "label", "block"), "heads")
        more = stored(spark, _searched(heads.join(texts.select("id", "text"), "id"), num, den, width), "links")
        links = links.unionByName(more)
        if more.count() * 2 <= heads.count():
            break

    # Blocks of one large tree, or of many small trees; then every pair of blocks of a group that can hold two trees.
    trees = now.groupBy("grp", "label").agg(F.count("*").alias("rows"))
    large = F.col("rows") * 2 >= pair_rows
    small = trees.filter(~large).groupBy("grp").agg(F.ceil(F.sum("rows") / pair_rows).alias("heaps"))
    placed = stored(spark, trees.join(small, "grp", "left").select(
        "grp", "label", large.alias("pure"),
        F.when(large, F.xxhash64("grp", "label")).otherwise(F.xxhash64("grp", F.lit("small"), F.pmod(F.xxhash64("label"), F.col("heaps")))).alias("heap"),
    ), "heaps")
    dealt = ranked(now.join(placed, ["grp", "label"]), "heap", ["id"], 64, "rank")
    dealt = stored(spark, dealt.withColumn("part", F.xxhash64("heap", F.floor(F.col("rank") / pair_rows))), "parts")
    blocks = stored(spark, dealt.select("grp", "part", "heap", "pure").distinct(), "blocks")
    left = blocks.select("grp", F.col("part").alias("p"), F.col("heap").alias("hp"), "pure")
    right = blocks.select("grp", F.col("part").alias("q"), F.col("heap").alias("hq"))
    pairs = left.join(right, "grp").filter("p < q AND NOT (pure AND hp = hq) OR p = q AND NOT pure")
    pairs = pairs.select(F.xxhash64("p", "q").alias("block"), F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    pairs = stored(spark, pairs, "pairs")
    rows = dealt.join(pairs, "part").select("block", "id", "label").join(texts.select("id", "text"), "id")
    return stored(spark, links.unionByName(_searched(rows, num, den, width)), "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of ``docs`` that are the first of their group. Rows with a null id stay."""
    groups = linked_groups(docs, id_col=id_col, **options)
    gone = stored(docs.sparkSession, groups.filter("id > component_id").select("id").distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")


def link_report(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, **options) -> DataFrame:
    """Per document: doc_id, size of its set, smallest doc_id that its links reach."""
    return linked_groups(docs, width, num, den, **options).withColumnRenamed("id", "doc_id")
