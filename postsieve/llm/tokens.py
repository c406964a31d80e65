"""Token ids of documents in Parquet files for selective reads."""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.session import fresh_dir

#: A space between two characters that no tokenizer here counts as white space: a safe place to cut.
_INNER_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
#: Letters that no normal form changes, with marks behind them; every byte-level tokenizer splits the two.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_SPACE_RUN = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]")


class ChunkEncoder:
    """Encodes texts by pieces that are encoded alike wherever they stand, and keeps the ids of pieces met before.

    ``spaces_dropped`` is for a tokenizer that drops white space and case: text is cut at blanks and line feeds. Otherwise it is cut
    before a single blank between two words; tokens of a byte-level vocabulary never span that place.
    A new piece that is only Latin words with line feeds between and marks behind them is split into those, for
    which the library's model is asked directly; its full pipeline takes every other piece. Pieces not met again for a while are
    forgotten: at most twice ``keep`` are held.
    """

    def __init__(self, path: str, spaces_dropped: bool, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level vocabularies write printable bytes as themselves, the n-th other byte as character 256 + n.
        hidden = [x for x in range(256) if x <= 32 or 127 <= x <= 160 or x == 173]
        self.signs = {x: chr(256 + n) for n, x in enumerate(hidden)}
        self.spaces_dropped = spaces_dropped
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.spaces_dropped:
            return text.replace("\n", " ").split(" ")
        if _SPACE_RUN.search(text):
            return _INNER_SPACE.split(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _INNER_SPACE.split(text)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        elif word[0] in " \n":
            word = self.signs[ord(word[0])] + word[1:]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > self.keep:
                self.parts = {}
            ids = self.parts[part] = self._word(part)
        return ids

    def _plain(self, piece: str) -> bytes | None:
        """Ids of a piece of plain words, None for any other."""
        if self.spaces_dropped:
            piece = piece.lower()
            core = piece.rstrip(".,!?;:")
            if core.isalpha() and (core.isascii() or _LATIN(core)):
                return self._part(core) if len(core) == len(piece) else self._part(core) + self._part(piece[len(core) :])
            return None
        if piece.isascii() and piece[1 if piece[:1] == " " else 0 :].isalpha():
            return self._word(piece)
        out = []
        for i, line in enumerate(piece.split("\n")):
            found = _PLAIN.fullmatch(line)
            if not found or i and line[0] == " ":
                return None
            if i:
                out.append(self._part("\n"))
            out.extend(self._part(x) for x in found.groups() if x)
        return b"".join(out)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(x) for x in texts]
        known = self._learn(set().union(*cut))
        for x in cut:
            yield b"".join(map(known.__getitem__, x))

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end_id`` behind it, and where each text's ids begin and end.

        For a tokenizer that drops white space: Arrow cuts the texts and numbers the distinct words, Python sees only those.
        """
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._learn(words)
        ids = [*map(known.__getitem__, words), np.array([end_id], dtype="<u4").tobytes()]
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        lists = pa.ListArray.from_arrays(
            np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")),
        )
        order = np.insert(np.asarray(coded.indices), bounds[1:], len(words))
        placed = lists.take(pa.array(order))  # One copy a word.
        ends = np.asarray(placed.offsets).astype(np.int64)
        return np.asarray(placed.values).view("<u4"), ends[bounds + np.arange(len(bounds))]

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids known, those of ``pieces`` among them."""
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        known, older, full = self.known, self.older, []
        for piece in pieces:
            if piece in known:
                continue
            ids = older.get(piece)
            if ids is None:
                ids = self._plain(piece)
            if ids is None:
                full.append(piece)
            else:
                known[piece] = ids
        for piece, ids in zip(full, self.tokenizer.encode_batch_fast(full, add_special_tokens=False)):
            known[piece] = array("I", ids.ids).tobytes()
        return known


class RankEncoder:
    """Ids of a byte-level vocabulary through its rank table, for texts on which both libraries split words alike.

    Those are texts of characters below U+0250 other than rare control characters, without anything like a special token and without very
    long words. Every other text goes through the tokenizers library itself.
    """

    _COMMON = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f]*")
    _ODD = re.compile(r"<\||[^ \n]{2000}")

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            if self._COMMON.fullmatch(text) and not self._ODD.search(text):
                yield self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[tuple, ChunkEncoder | RankEncoder] = {}


def encoder(path: str, spaces_dropped: bool, ranks: tuple[str, str] | None = None) -> ChunkEncoder | RankEncoder:
    """The worker's encoder for a vocabulary; it lives as long as the worker. ``ranks``: path of the same vocabulary's ranks, and word pattern."""
    key = (path, spaces_dropped, ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(path, *ranks) if ranks else ChunkEncoder(path, spaces_dropped)
    return _ENCODERS[key]


def stretches(sizes: Iterable[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to at most about ``most``, or single ones."""
    begin = end = total = 0
    for end, size in enumerate(sizes, 1):
        total += int(size)
        if total > most and end - 1 > begin:
            yield begin, end - 1
            begin, total = end - 1, int(size)
    if begin < end:
        yield begin, end


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most about ``most`` characters (one text at least), so that long texts don't pile up in memory."""
    return stretches((len(x or "") for x in texts), most)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, spaces_dropped: bool = True, id_col: str = "doc_id",
                 text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, codec: str = "zstd") -> None:
    """Writes one row for each row of ``docs``, in ascending id order over the files.

    Columns: ``part`` (number of the file in the order), ``doc_id``, ``part_start`` (ids before it in its file),
    ``n_tokens`` and ``ids`` (list of int, the end id included). The ids are dictionary coded (two bytes each below 65,536
    distinct ones), the ascending numbers delta coded; row groups and pages are of the given sizes, and column and offset
    indexes let a reader skip pages. Null text is empty; a null id comes first; rows with equal ids are ordered by
    their text's hash. An empty table writes no rows.

    Texts move once, in a range exchange; encoding follows it, so the sampling of ranges costs no encoding.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ordered = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = encoder(vocabulary, spaces_dropped), 0
        for batch in batches:
            texts = batch.column(2)
            for i, j in stretches(np.asarray(pc.utf8_length(texts)), 8_000_000):
                if spaces_dropped:
                    values, before = known.encode_column(texts[i:j], end_id)
                else:
                    coded = [x + end for x in known.encode(texts[i:j].to_pylist())]
                    values, before = np.frombuffer(b"".join(coded), dtype="<u4"), np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded])))
                ids = pa.array(values.view("<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(start + before[:-1]), pa.array(np.diff(before)),
                     pa.ListArray.from_arrays(pa.array(before, pa.int32()), ids)],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(before[-1])

    (
        ordered.mapInArrow(encode, "part int, doc_id long, part_start long, n_tokens long, ids array<int>")
        .write.option("compression", codec)
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.column.index.truncate.length", 64)
        .parquet(path)
    )


SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_tokens``. Choose columns and filter by ``doc_id`` to read only their pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``part``; reads no ids.

    Only one total for each file is summed in order.
    """
    rows = read_tokens(spark, path).select("part", "doc_id", "part_start", "n_tokens")
    return _with_start(rows, rows).select("doc_id", "start", "n_tokens", "part")


def _with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("part_start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids_crc32``, the CRC-32 of its ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids") + ", ids_crc32 long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != "ids"]
            lists = batch.column(batch.schema.get_field_index("ids"))
            values = np.asarray(lists.values).astype("<u4", copy=False)
            offsets = np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(crc, pa.int64())], names=[*names, "ids_crc32"]
            )

    return tokens.mapInArrow(add, schema)


def token_report(docs: DataFrame, vocabulary: str, end_id: int = 1, **options) -> DataFrame:
    """Writes ``docs`` to the shared folder as token files and reads them back: id, start, size and checksum of each document."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id, **options)
    sums = checksums(read_tokens(spark, path))
    return _with_start(sums, read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
