"""Which tokens of two vocabularies cover the same bytes, over whole texts and a whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import stored
from postsieve.llm.tokens import stretches

#: A blank between two characters that no tokenizer here counts as white space: both vocabularies end a token before it.
_INNER_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
_SPACE_RUN = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]")

Tokens = list[tuple[int, int]]  # ids and sizes in bytes
Group = tuple[Tokens, Tokens]


def words(text: str) -> list[str]:
    """``text`` cut before each blank that stands alone between two words."""
    if "\0" in text or text.endswith(" ") or _SPACE_RUN.search(text):
        return _INNER_SPACE.split(text)
    return (text[:1] + text[1:].replace(" ", "\0 ")).split("\0")


def _join(x: Group, y: Group) -> Group:
    return [*x[0], *y[0]], [*x[1], *y[1]]


@dataclass
class Fragment:
    """What a stretch of a text's bytes tells about its groups: the tokens that end in it.

    A place is common if tokens of both vocabularies end there. ``closed``: whether the stretch, its two edges included, has such a place.
    ``head``: the tokens up to the first one, an open prefix; ``at``: the number of the stretch it lies in; ``groups``: those between the common places, each with
    the number of the stretch that closes it; ``tail``: the tokens after the last one, an open suffix. Without a common place all tokens are
    ``head``. Joining neighbours with ``+`` is associative, and ``Fragment()`` changes nothing, so pieces may be joined in any tree.
    """

    closed: bool = False
    at: int = 0
    head: Group = ((), ())
    tail: Group = ((), ())
    groups: list[tuple[int, Group]] = field(default_factory=list)

    def __add__(self, other: Fragment) -> Fragment:
        if not self.closed:
            return Fragment(other.closed, other.at if other.closed else self.at, _join(self.head, other.head), other.tail, other.groups)
        between = _join(self.tail, other.head)
        if not other.closed:
            return Fragment(True, self.at, self.head, between, self.groups)
        return Fragment(True, self.at, self.head, other.tail, [*self.groups, *[(other.at, between)] * bool(between[0]), *other.groups])

    def edges(self) -> str:
        return json.dumps([self.closed, self.at, self.head, self.tail])

    @classmethod
    def from_edges(cls, text: str) -> Fragment:
        return cls(*json.loads(text))


def fragment(a: Tokens, b: Tokens, first: int, last: int, at: int = 0) -> Fragment:
    """The fragment of bytes ``first`` to ``last`` of a stretch of text with tokens ``a`` and ``b``, counted from where both begin."""
    ends = [list(accumulate((size for _, size in x), initial=0)) for x in (a, b)]
    common = [x for x in sorted(set(ends[0]) & set(ends[1])) if first <= x <= last]

    def between(low: int, high: int) -> Group:
        return tuple(x[max(bisect_right(e, low) - 1, 0) : bisect_right(e, high) - 1] for x, e in zip((a, b), ends))

    if not common:
        return Fragment(False, at, between(first, last))
    groups = [(at, between(x, y)) for x, y in zip(common, common[1:])]
    return Fragment(True, at, between(first, common[0]), between(common[-1], last), groups)


def links_of(group: Group) -> list[tuple[int, int]]:
    """Pairs of ids of a group's tokens whose bytes overlap."""
    a, b = group
    out, i, j, end_a, end_b = [], 0, 0, a[0][1], b[0][1]
    while True:
        out.append((a[i][0], b[j][0]))
        if end_a == end_b and i + 1 == len(a):
            return out
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
            end_a += a[i][1]
        if step_b:
            j += 1
            end_b += b[j][1]


@dataclass(slots=True)
class Aligned:
    """Groups of a piece of text: token counts, links as ``a << 32 | b``, and the groups written out."""

    n_a: int
    n_b: int
    n_groups: int
    links: list[int]
    text: str
    fits: bool = True


def aligned(groups: list[Group], n_a: int | None = None, n_b: int | None = None) -> Aligned:
    text = ";".join(",".join(str(i) for i, _ in a) + "|" + ",".join(str(i) for i, _ in b) for a, b in groups)
    links = [x << 32 | y for g in groups for x, y in links_of(g)]
    return Aligned(sum(len(g[0]) for g in groups) if n_a is None else n_a, sum(len(g[1]) for g in groups) if n_b is None else n_b, len(groups), links, text)


class Columns:
    """Alignments of many pieces, column by column: some numbers each, all their links one after another, and their groups written out, each with ``;`` behind it."""

    _FIELDS = ("n_a", "n_b", "n_groups", "n_links", "links", "texts", "fits")

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, links: np.ndarray, texts: list[bytes], fits: np.ndarray):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.links, self.texts, self.fits = n_a, n_b, n_groups, n_links, links, texts, fits
        self.starts: np.ndarray | None = None

    @classmethod
    def of(cls, found: Sequence[Aligned]) -> Columns:
        n_a, n_b, n_groups, n_links = np.array([(x.n_a, x.n_b, x.n_groups, len(x.links)) for x in found], dtype=np.int64).reshape(-1, 4).T
        links = np.fromiter(chain.from_iterable(x.links for x in found), dtype=np.int64)
        return cls(n_a, n_b, n_groups, n_links, links, [x.text.encode() + b";" if x.text else b"" for x in found], np.array([x.fits for x in found], dtype=bool))

    @classmethod
    def joined(cls, parts: Sequence[Columns]) -> Columns:
        return cls(*([*chain.from_iterable(x)] if isinstance(x[0], list) else np.concatenate(x) for x in zip(*([getattr(p, f) for f in cls._FIELDS] for p in parts))))

    def link_places(self, at: np.ndarray) -> np.ndarray:
        """Where the links of the pieces ``at`` stand, piece by piece."""
        if self.starts is None:
            self.starts = np.cumsum(self.n_links) - self.n_links
        sizes, starts = self.n_links[at], self.starts[at]
        return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def take(self, at: np.ndarray) -> Columns:
        texts = [*map(self.texts.__getitem__, at.tolist())]
        return Columns(self.n_a[at], self.n_b[at], self.n_groups[at], self.n_links[at], self.links[self.link_places(at)], texts, self.fits[at])

    def rows(self) -> list[Aligned]:
        ends = np.cumsum(self.n_links).tolist()
        return [Aligned(a, b, g, self.links[e - n : e].tolist(), t[:-1].decode(), f) for a, b, g, n, e, t, f in zip(
            *(x.tolist() for x in (self.n_a, self.n_b, self.n_groups, self.n_links)), ends, self.texts, self.fits.tolist())]


class _Kept:
    """Pieces of text and their alignments."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.found = Columns.of([])

    def places(self, pieces: Sequence[str]) -> np.ndarray:
        """Where pieces are held, -1 for others."""
        get = self.place.get
        return np.fromiter((get(x, -1) for x in pieces), dtype=np.int64, count=len(pieces))

    def add(self, pieces: list[str], found: Columns) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
        self.found = Columns.joined([self.found, found])


class Aligner:
    """Both vocabularies, and the words aligned lately (at most twice ``keep``, none over 200 characters; of blocks of texts, those that stand in one more than once).

    Texts are cut where both vocabularies end a token, before a blank between two words, and a word is aligned alike wherever it stands. Where the second
    vocabulary has a token with a blank behind another character, nothing is cut.
    """

    def __init__(self, bytes_path: str, pieces_path: str, keep: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        hidden = [x for x in range(256) if x <= 32 or 127 <= x <= 160 or x == 173]
        byte_of = {chr(x): x for x in range(256) if x not in hidden} | {chr(256 + n): x for n, x in enumerate(hidden)}
        self.a_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.a.get_vocab().items() if all(c in byte_of for c in t)}
        self.b = SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_size, self.b_size = [*map(len, self.a_bytes)], [*map(len, self.b_bytes)]
        self.a_sizes, self.b_sizes = np.array(self.a_size), np.array(self.b_size)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.signed = [f"{x}{sign}".encode() for sign in ",|;" for x in self.names]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.keep = keep
        self.known, self.older = _Kept(), _Kept()

    def words(self, text: str) -> list[str]:
        return words(text) if self.cuts else [text]

    def tokens(self, texts: list[str]) -> Iterator[tuple[Tokens, Tokens, bool]]:
        """Tokens of both vocabularies for pieces that begin with a blank, and whether both spell the piece's bytes."""
        coded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        pieces = self.b.encode([x[1:] for x in texts], num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for text, x, y in zip(texts, coded, pieces):
            data = text.encode()
            a, b = [a_bytes[i] for i in x.ids], [b_bytes[i] for i in y]
            fits = b"".join(a) == data and b"".join(b) == data
            yield list(zip(x.ids, map(len, a))), list(zip(y, map(len, b))), fits

    def _align(self, texts: list[str]) -> Iterator[Aligned]:
        """Groups of whole pieces, which both vocabularies begin and end at common places, in one pass over the two lists."""
        coded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        pieces = self.b.encode([x[1:] for x in texts], num_threads=1)
        a_bytes, b_bytes, a_size, b_size, names = self.a_bytes, self.b_bytes, self.a_size, self.b_size, self.names
        for text, x, ys in zip(texts, coded, pieces):
            data, xs = text.encode(), x.ids
            if b"".join(map(b_bytes.__getitem__, ys)) != data or b"".join(map(a_bytes.__getitem__, xs)) != data:
                yield Aligned(0, 0, 0, [], "", False)
                continue
            n_a, n_b, i, j = len(xs), len(ys), 0, 0
            a, b = xs[0], ys[0]
            end_a, end_b, left, right = a_size[a], b_size[b], names[a], names[b]
            links, written = [a << 32 | b], []
            while True:
                if end_a < end_b:
                    i += 1
                    a = xs[i]
                    end_a += a_size[a]
                    left += "," + names[a]
                elif end_b < end_a:
                    j += 1
                    b = ys[j]
                    end_b += b_size[b]
                    right += "," + names[b]
                else:
                    written.append(left + "|" + right)
                    i += 1
                    j += 1
                    if i == n_a:
                        break
                    a, b = xs[i], ys[j]
                    end_a += a_size[a]
                    end_b += b_size[b]
                    left, right = names[a], names[b]
                links.append(a << 32 | b)
            yield Aligned(n_a, n_b, len(written), links, ";".join(written))

    def _align_joined(self, texts: list[str], most: int = 64) -> tuple[list[int], Columns]:
        """The same, with up to ``most`` pieces encoded as one text, as both vocabularies end a token before a blank between two words. Also each row's place in ``texts``.

        Pieces that begin or end otherwise, and those of a joined text that is not spelled byte by byte with tokens ending after each piece, are aligned one by one.
        """
        able = [i for i, x in enumerate(texts) if len(x) > 1 and x[0] == " " and not x[1].isspace() and not x[-1].isspace()] if self.cuts else []
        runs = [able[k : k + most] for k in range(0, len(able), most)]
        joined = ["".join([texts[i] for i in run]) for run in runs]
        coded = self.a.encode_batch_fast(joined, add_special_tokens=False)
        pieces = self.b.encode([x[1:] for x in joined], num_threads=1)
        a_bytes, b_bytes, a_size, b_size = self.a_bytes, self.b_bytes, self.a_size, self.b_size
        order, all_a, all_b, all_sizes = [], [], [], []
        for run, text, x, ys in zip(runs, joined, coded, pieces):
            data, xs = text.encode(), x.ids
            if b"".join(map(b_bytes.__getitem__, ys)) != data or b"".join(map(a_bytes.__getitem__, xs)) != data:
                continue
            sizes = [len(texts[i].encode()) for i in run]
            ends_a, ends_b = set(accumulate(map(a_size.__getitem__, xs))), set(accumulate(map(b_size.__getitem__, ys)))
            if len(ends_a) == len(xs) and len(ends_b) == len(ys) and ends_a.issuperset(stops := list(accumulate(sizes))) and ends_b.issuperset(stops):
                order += run
                all_a += xs
                all_b += ys
                all_sizes += sizes
        whole = self._grouped(all_a, all_b, all_sizes)
        if len(order) == len(texts):
            return order, whole
        done = set(order)
        alone = [i for i in range(len(texts)) if i not in done]
        return order + alone, Columns.joined([whole, Columns.of([*self._align([texts[i] for i in alone])])])

    def _grouped(self, a: list[int], b: list[int], sizes: list[int]) -> Columns:
        """Groups of pieces of ``sizes`` bytes, one after another, from their ids: by where tokens end, without a step for each token."""
        a, b, stops = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.cumsum(np.array(sizes, dtype=np.int64))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = ends[1:] == ends[:-1]
        common, ends = ends[1:][twice], ends[np.concatenate([~twice, np.ones(min(len(ends), 1), bool)])]
        links = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        # Each group's tokens of the first vocabulary, then those of the second, with the sign that follows each.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        until_a, until_b = np.searchsorted(ends_a, common, "right"), np.concatenate([[0], np.searchsorted(ends_b, common, "right")])
        codes, n = np.empty(len(a) + len(b), dtype=np.int64), len(self.names)
        codes[np.arange(len(a)) + until_b[group_a]] = a + n * (common[group_a] == ends_a)
        codes[np.arange(len(b)) + until_a[group_b]] = b + 2 * n * (common[group_b] == ends_b)
        signed = [*map(self.signed.__getitem__, codes.tolist())]
        counts = [np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (ends_a, ends_b, common, ends)]
        bounds = np.cumsum(counts[0] + counts[1]).tolist()
        return Columns(*counts, links, [b"".join(signed[x:y]) for x, y in zip([0, *bounds], bounds)], np.ones(len(stops), dtype=bool))

    def columns(self, texts: list[str], lasting: np.ndarray | None = None) -> Columns:
        """The alignment of distinct pieces of text. Those marked as ``lasting`` (all of them without marks) are kept for later calls."""
        at = self.known.places(texts)
        new = np.flatnonzero(at < 0)
        orders, parts = [np.flatnonzero(at >= 0)], [self.known.found.take(at[at >= 0])]
        if len(self.older.place):
            some = [texts[i] for i in new.tolist()]
            at = self.older.places(some)
            orders.append(new[at >= 0])
            parts.append(self.older.found.take(at[at >= 0]))
            new = new[at < 0]
        for k in range(0, len(new), 5000):
            some = new[k : k + 5000]
            order, found = self._align_joined([texts[i] for i in some.tolist()])
            orders.append(some[order])
            parts.append(found)
        out = Columns.joined(parts).take(np.argsort(np.concatenate(orders)))
        keep = np.concatenate(orders[1:]) if len(orders) > 1 else new
        if lasting is not None:
            keep = keep[lasting[keep]]
        keep = np.array([i for i in keep.tolist() if len(texts[i]) <= 200][: self.keep], dtype=np.int64)
        if len(self.known.place) + len(keep) > self.keep:
            self.known, self.older = _Kept(), self.known
        self.known.add([texts[i] for i in keep.tolist()], out.take(keep))
        return out

    def align(self, texts: list[str]) -> list[Aligned]:
        """The same, an object for each piece."""
        return self.columns(texts).rows()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The worker's aligner of two vocabularies; it lives as long as the worker."""
    if (bytes_path, pieces_path) not in _ALIGNERS:
        _ALIGNERS[bytes_path, pieces_path] = Aligner(bytes_path, pieces_path)
    return _ALIGNERS[bytes_path, pieces_path]


@dataclass
class Unit:
    """A text or a stretch of one inside a block: its pieces by their places among the block's, and what stays of it."""

    uid: int | None
    doc_id: int | None
    chunk: int
    part: int
    pieces: np.ndarray
    n_a: int = 0
    n_b: int = 0
    fits: bool = True
    edges: str = ""


_BLOCK = pa.schema([
    ("block", pa.int64()), ("uid", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("chunk", pa.list_(pa.int32())), ("part", pa.list_(pa.int32())),
    ("fits", pa.list_(pa.bool_())), ("edges", pa.list_(pa.string())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("written", pa.list_(pa.string())),
    ("offsets", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
])
_BLOCK_DDL = ("block long, uid array<long>, doc_id array<long>, chunk array<int>, part array<int>, fits array<boolean>, edges array<string>, n_a array<long>, n_b array<long>, "
              "n_groups array<long>, n_links array<long>, written array<string>, offsets binary, places binary, times binary, pairs array<long>, totals array<long>")


def _block(number: int, units: list[Unit], pieces: Columns, digest: bool) -> pa.RecordBatch:
    """One row for some units: their figures, which id pairs are linked in the block how often, and in which unit."""
    for u in units:
        u.fits = u.fits and bool(pieces.fits[u.pieces].all())
        if not u.fits:
            u.pieces, u.n_a, u.n_b = u.pieces[:0], 0, 0
    used = np.concatenate([u.pieces for u in units])
    sizes = np.array([len(u.pieces) for u in units])
    bounds = np.concatenate(([0], np.cumsum(sizes)))

    def summed(of_piece: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(of_piece[used])))
        return running[bounds[1:]] - running[bounds[:-1]]

    distinct, where = np.unique(pieces.links, return_inverse=True)
    n_links, per_unit, totals = summed(pieces.n_links), max(len(distinct), 1), np.zeros(len(distinct), dtype=np.int64)
    offsets, places, times = np.zeros(len(units) + 1, dtype=np.int64), [], []
    for i, j in stretches(sizes, 50_000):  # links of some units at a time: a piece has several wherever it stands
        at = where[pieces.link_places(used[bounds[i] : bounds[j]])]
        keys, n = np.unique(np.repeat(np.arange(j - i), n_links[i:j]) * per_unit + at, return_counts=True)
        offsets[i + 1 : j + 1] = offsets[i] + np.searchsorted(keys, np.arange(1, j - i + 1) * per_unit)
        places.append((keys % per_unit).astype("<i4"))
        times.append(n.astype("<i4"))
        totals += np.bincount(at, minlength=len(distinct))
    written = []
    for u in units:
        text = b"".join(map(pieces.texts.__getitem__, u.pieces.tolist()))[:-1]
        written.append(text.decode() if not digest else hashlib.sha256(text).hexdigest() if len(u.pieces) else "")
    row = [
        number, [u.uid for u in units], [u.doc_id for u in units], [u.chunk for u in units], [u.part for u in units], [u.fits for u in units], [u.edges for u in units],
        summed(pieces.n_a) + np.array([u.n_a for u in units]), summed(pieces.n_b) + np.array([u.n_b for u in units]), summed(pieces.n_groups), n_links, written,
        offsets.astype("<i8").tobytes(), b"".join(places), b"".join(times), distinct, totals,
    ]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


def _whole_texts(bytes_path: str, pieces_path: str, block_chars: int):
    """Blocks of whole texts, which begin and end with a common place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_, number = aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in stretches(pc.utf8_length(batch.column(1)).fill_null(0).to_pylist(), block_chars):
                ids, texts = (x[i:j].to_pylist() for x in batch.columns)
                place: defaultdict[str, int] = defaultdict()
                place.default_factory = place.__len__
                units = [Unit(None, d, 0, 0, np.array([*map(place.__getitem__, with_.words(" " + x))] if x else [], dtype=np.int32)) for d, x in zip(ids, texts)]
                times = np.bincount(np.concatenate([u.pieces for u in units]), minlength=len(place))
                yield _block(number, units, with_.columns([*place], times > 1), True)
                number += 1

    return run


def _stretches(bytes_path: str, pieces_path: str, chunk_chars: int):
    """Long texts in stretches of about ``chunk_chars``, cut anywhere, each with the rest of the words its edges cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, reach = aligner(bytes_path, pieces_path).cuts, max(min(4096, chunk_chars // 2), 1)
        for batch in batches:
            for uid, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = " " + text
                bounds = [(0, 0, 0)]  # where a stretch begins, the last cut before that, the first cut from there on
                for at in range(chunk_chars, len(text), chunk_chars) if cuts else ():
                    low = next((p for p in range(at, max(at - reach, bounds[-1][0]), -1) if text[p] == " " and _INNER_SPACE.match(text, p)), None)
                    high = next((p for p in range(at, min(at + reach, len(text))) if text[p] == " " and _INNER_SPACE.match(text, p)), None)
                    if low is not None and high is not None and low >= bounds[-1][2]:
                        bounds.append((at, low, high))
                bounds.append((len(text), len(text), len(text)))
                for k, ((first, low, _), (last, _, high)) in enumerate(zip(bounds, bounds[1:])):
                    lead, size = len(text[low:first].encode()), len(text[first:last].encode())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip((uid, doc, k, lead, size, text[low:high]), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                        names=["uid", "doc_id", "chunk", "lead", "size", "text"])

    return run


def _fragments(bytes_path: str, pieces_path: str):
    """A block for each stretch: whole words as they are, the words at its edges as fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_, number = aligner(bytes_path, pieces_path), (1 << 61) + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            for uid, doc, k, lead, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = with_.words(text)
                ends = list(accumulate(len(x.encode()) for x in parts))
                inner = [x for x, e, b in zip(parts, ends, [0, *ends]) if b >= lead and e <= lead + size]
                place = {x: i for i, x in enumerate(dict.fromkeys(inner))}
                found, used = with_.align(list(place)), []
                unit = Unit(uid, doc, k, 1, np.zeros(0, dtype=np.int32))
                whole, inside = Fragment(), False
                for x, e, b in zip(parts, ends, [0, *ends]):
                    if b >= lead and e <= lead + size:
                        used.append(place[x])
                        if not inside:  # a run of whole words is closed at both ends; its groups are those of the words
                            whole, inside = whole + Fragment(True, k), True
                        continue
                    inside = False
                    a, b_, fits = next(with_.tokens([x]))
                    unit.fits = unit.fits and fits
                    edge = fragment(a, b_, max(lead - b, 0), min(lead + size - b, e - b), k) if fits else Fragment()
                    used.append(len(found))
                    found.append(aligned([g for _, g in edge.groups], 0, 0))
                    unit.n_a += sum(max(lead - b, 0) < t <= lead + size - b for t in accumulate(n for _, n in a))
                    unit.n_b += sum(max(lead - b, 0) < t <= lead + size - b for t in accumulate(n for _, n in b_))
                    whole = whole + Fragment(edge.closed, edge.at, edge.head, edge.tail)
                unit.edges = whole.edges()
                unit.pieces = np.array(used, dtype=np.int32)
                yield _block(number, [unit], Columns.of(found), False)
                number += 1

    return run


def _joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring fragments of one text made one, and the groups that closes."""
    whole = Fragment()
    for edges in rows.sort_values("k")["edges"]:
        whole = whole + Fragment.from_edges(edges)
    glue = [json.dumps([at, group]) for at, group in whole.groups]
    return pd.DataFrame({"uid": [key[0]], "k": [key[1]], "edges": [whole.edges()], "glue": [glue]})


def _glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the groups that closed when fragments were joined."""
    number = (1 << 62) + (TaskContext.get().partitionId() << 32)
    for batch in batches:
        units, found = [], []
        for n, (uid, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            at, group = json.loads(text)
            found.append(aligned([group], 0, 0))
            units.append(Unit(uid, None, at, 0, np.array([n], dtype=np.int32)))
        if units:
            yield _block(number, units, Columns.of(found), False)
            number += 1


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of units from blocks with the corpus-wide counts of their pairs."""
    names = ["uid", "doc_id", "chunk", "part", "fits", "n_a", "n_b", "n_groups", "n_links", "written"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {x: batch.column(batch.schema.get_field_index(x))[i] for x in [*names, "offsets", "places", "times", "found"]}
            offsets, places, times = (np.frombuffer(row[x].as_py(), t) for x, t in (("offsets", "<i8"), ("places", "<i4"), ("times", "<i4")))
            found = row["found"].values
            at = found.field("i").to_numpy()
            total, best = np.zeros(at.max(initial=-1) + 1, dtype=np.int64), np.zeros(at.max(initial=-1) + 1, dtype=np.int64)
            total[at], best[at] = found.field("total").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)

            def summed(of_pair: np.ndarray) -> pa.Array:
                running = np.concatenate(([0], np.cumsum(of_pair[places] * times.astype(np.int64))))
                return pa.array(running[offsets[1:]] - running[offsets[:-1]], pa.int64())

            yield pa.RecordBatch.from_arrays([*[row[x].values for x in names], summed(best), summed(total)], names=[*names, "n_best", "count_sum"])


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each long text from its stretches in order."""
    one = None

    def out(x: dict) -> pa.RecordBatch:
        digest = x["sha"].hexdigest() if x["n_a"] else ""
        return pa.RecordBatch.from_arrays(
            [pa.array([x["doc_id"]], pa.int64()), *[pa.array([x[f]], pa.int64()) for f in _FIGURES], pa.array([digest])], names=["doc_id", *_FIGURES, "groups_sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            if one is None or one["uid"] != row["uid"]:
                if one:
                    yield out(one)
                one = {"uid": row["uid"], "doc_id": None, "sha": hashlib.sha256(), "any": False, **dict.fromkeys(_FIGURES, 0)}
            for f in _FIGURES:
                one[f] += row[f]
            if row["part"]:
                one["doc_id"] = row["doc_id"]
            if row["written"]:
                one["sha"].update((";" * one["any"] + row["written"]).encode())
                one["any"] = True
    if one:
        yield out(one)


def align(docs: DataFrame, bytes_path: str, pieces_path: str, block_chars: int = 4_000_000, chunk_chars: int = 65_536, fan: int = 32,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """How two vocabularies' tokens cover each text, and the corpus-wide counts of linked ids.

    ``bytes_path`` is a byte-level vocabulary (A), which encodes a blank and the text; ``pieces_path`` one of pieces (B), which adds that blank itself. Places where
    tokens of both end cut them into groups; tokens whose bytes overlap are linked. Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links
    whose ids' count is the highest of their B id), ``count_sum`` (of the counts over links) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).
    Null and empty texts, and those whose bytes A or B does not spell (B knows no U+2581), have no tokens: zeros and an empty digest. Special tokens' strings are
    plain text. Rows with equal ids stay apart; an empty table gives an empty one. The second table: ``a_id``, ``b_id``, ``total``, ``best``.

    Texts of more than ``chunk_chars`` are cut into stretches, which tasks turn into fragments (``Fragment``); ``fan`` neighbours at a time are then joined in a tree. A text
    without a blank between words for 4,096 characters around a cut is not cut there, since its tokens cannot be told from a part of it.
    Links are counted in blocks of texts before they are counted over the corpus, and the counts go back to blocks, not to texts: the shuffles
    hold a row for each block and id pair.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = stored(spark, rows.filter(~is_long).mapInArrow(_whole_texts(bytes_path, pieces_path, block_chars), _BLOCK_DDL), "aligned")
    cut = rows.filter(is_long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(
        _stretches(bytes_path, pieces_path, chunk_chars), "uid long, doc_id long, chunk int, lead long, size long, text string")
    long = stored(spark, cut.repartition("uid", "chunk").mapInArrow(_fragments(bytes_path, pieces_path), _BLOCK_DDL), "stretches")

    # A long text that does not fit anywhere has no tokens at all.
    marked = long.withColumn("_uid", F.col("uid")[0])
    unfit = marked.filter(~F.col("fits")[0]).select("_uid").distinct()
    good = marked.join(unfit, "_uid", "left_anti")
    fragments = good.select(F.col("_uid").alias("uid"), F.col("chunk")[0].cast("long").alias("k"), F.col("edges")[0].alias("edges"))
    most = fragments.agg(F.max("k")).first()[0] or 0
    glues = []
    while most > 0:
        fragments = stored(spark, fragments.groupBy("uid", F.floor(F.col("k") / fan).alias("k")).applyInPandas(_joined, "uid long, k long, edges string, glue array<string>"), "joined")
        glues.append(fragments.select("uid", F.explode("glue").alias("glue")))
        fragments, most = fragments.select("uid", "k", "edges"), most // fan
    blocks = [short, good.drop("_uid")]
    if glues:
        glue = glues[0]
        for x in glues[1:]:
            glue = glue.unionByName(x)
        blocks.append(stored(spark, glue.mapInArrow(_glue, _BLOCK_DDL), "glue"))
    every = blocks[0]
    for x in blocks[1:]:
        every = every.unionByName(x)

    def held(some: DataFrame) -> DataFrame:
        zipped = some.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("i", "x"))
        return zipped.select("block", "i", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n")).filter("n > 0")

    totals = stored(spark, held(every).groupBy("pair").agg(F.sum("n").alias("total")), "totals").withColumn("b_id", F.col("pair").bitwiseAND((1 << 32) - 1))
    tops = totals.groupBy("b_id").agg(F.max("total").alias("top"))
    counts = stored(spark, totals.join(tops, "b_id").select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "total", (F.col("total") == F.col("top")).alias("best")), "counts")
    schema = ("uid long, doc_id long, chunk int, part int, fits boolean, n_a long, n_b long, n_groups long, n_links long, written string, n_best long, count_sum long")

    def with_counts(some: DataFrame) -> DataFrame:
        """Units of blocks; a block without links has no counts to wait for."""
        empty = F.array().cast("array<struct<i:int,total:bigint,best:boolean>>")
        back = held(some).join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("i", "total", "best")).alias("found"))
        sized = some.join(back, "block", "left").withColumn("found", F.coalesce("found", empty))
        return sized.mapInArrow(_looked_up, schema)

    columns = ["doc_id", *_FIGURES, "groups_sha256"]
    out = with_counts(short).withColumnRenamed("written", "groups_sha256").select(columns)
    pieces = with_counts(every.filter(F.col("uid")[0].isNotNull()))
    whole = pieces.repartition("uid").sortWithinPartitions("uid", "chunk", "part").mapInArrow(
        _summed_up, "doc_id long, " + ", ".join(f"{x} long" for x in _FIGURES) + ", groups_sha256 string")
    zeros = marked.join(unfit, "_uid", "left_semi").filter(F.col("chunk")[0] == 0).select(
        F.col("doc_id")[0].alias("doc_id"), *[F.lit(0).cast("long").alias(x) for x in _FIGURES], F.lit("").alias("groups_sha256"))
    return out.unionByName(whole.select(columns)).unionByName(zeros), counts.select("a_id", "b_id", "total", "best")


def alignment_report(docs: DataFrame, bytes_path: str, pieces_path: str, **options) -> DataFrame:
    """The first table of ``align``."""
    return align(docs, bytes_path, pieces_path, **options)[0]
