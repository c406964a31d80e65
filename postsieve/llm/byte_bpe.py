"""Byte-level byte-pair encoding as a transducer over bytes, and decoding as a state machine over tokens."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.alignment import words as before_blanks
from postsieve.llm.tokens import slices

#: A pattern none of whose matches goes on over a blank between two other characters than white space.
BLANKS_LEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges as they are defined: the neighbours whose union has the lowest rank are joined, the leftmost first, until none has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    none = float("inf")
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs and (least := min(costs)) is not none:
        at = costs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at < len(costs):
            costs[at] = ranks.get(parts[at] + parts[at + 1], none)
        if at:
            costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
    return parts


class State(dict):
    """A state of the transducer: byte -> (next state, ids emitted). ``items`` are the guesses it stands for, ``final`` what the end emits."""

    __slots__ = ("items_", "final")


class Transducer:
    """Merges compiled into a transducer from bytes to ids, made deterministic as it is used.

    A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs. So a
    machine that guesses tokens one by one needs to know only its last token and how far it is in the next one (a
    node of the trie of tokens), and a guess dies when its token does not get on with the last one. A deterministic state
    is the set of guesses alive, each with the ids it still owes; ids that all of them owe are emitted at once, so the output lags
    by no more than the longest token and the few tokens that a later byte can still change. One guess at most stands at a token's end; it is the answer if the text ends there.
    States and pairs of neighbours are worked out when first met. Beyond ``keep`` states they are forgotten and worked out anew.
    """

    def __init__(self, ranks: dict[bytes, int], keep: int = 600_000):
        self.ranks, self.keep = ranks, keep
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                child = self.trie[node].get(b)
                if child is None:
                    child = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(((-1, 0, ()),))

    def _state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            if len(self.states) > self.keep:
                self._forget()
            found = self.states[items] = State()
            found.items_ = items
            found.final = next((owed for _, node, owed in items if node == 0), None)
        return found

    def _get_on(self, last: int, token: int) -> bool:
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > 2 * self.keep:
                self.pairs = {}
            own = self.tokens[token]
            if last < 0:
                known = merged(own, self.ranks) == [own]
            else:
                known = merged(self.tokens[last] + own, self.ranks) == [self.tokens[last], own]
            self.pairs[last, token] = known
        return known

    def _arc(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Follows every guess over ``byte``, and remembers where that leads."""
        items = []
        for last, node, owed in state.items_:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and self._get_on(last, token):
                items.append((token, 0, (*owed, token)))
            if self.trie[node]:
                items.append((last, node, owed))
        if not items:
            raise ValueError(f"no token for byte {byte}")
        common = 0
        shortest = min(len(owed) for _, _, owed in items)
        while common < shortest and all(owed[common] == items[0][2][common] for _, _, owed in items):
            common += 1
        emitted = items[0][2][:common]
        arc = state[byte] = self._state(tuple((last, node, owed[common:]) for last, node, owed in items)), emitted
        return arc

    def stream(self, chunks: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of one word given in pieces, as soon as they are sure."""
        state = self.start
        for chunk in chunks:
            for byte in chunk:
                state, emitted = state.get(byte) or self._arc(state, byte)
                if emitted:
                    yield emitted
        if state.final:
            yield state.final

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        state, out = self.start, []
        for byte in word:
            arc = state.get(byte)
            if arc is None:
                arc = self._arc(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        if state.final:
            out += state.final
        return tuple(out)


class Decoder:
    """Ids to text piece by piece: the state is the bytes of a character not yet whole, three at most.

    Where a byte cannot go on, U+FFFD stands for the part that was there, as in Python's ``replace``. Steps are worked out when first met: (state, id) -> text, next state.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.states: dict[bytes, dict[int, tuple[str, dict]]] = {}
        self.pending: dict[int, bytes] = {}
        self.start = self._state(b"")

    def _state(self, pending: bytes) -> dict:
        if pending not in self.states:
            state = self.states[pending] = {}
            self.pending[id(state)] = pending
        return self.states[pending]

    @staticmethod
    def _whole(data: bytes) -> tuple[str, bytes]:
        """The text of ``data`` without its last character, if that needs more bytes; and that character's bytes."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                rest = data[-back:]
                # Still open only if some further bytes make a character of it.
                if lead < 0xF5 and lead > 0xC1 and back < need and "�" not in _completed(rest, need):
                    return data[:-back].decode("utf-8", "replace"), rest
                break
        return data.decode("utf-8", "replace"), b""

    def _step(self, state: dict, token: int) -> tuple[str, dict]:
        text, pending = self._whole(self.pending[id(state)] + self.tokens[token])
        step = state[token] = text, self._state(pending)
        return step

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of each id, as far as its characters are whole."""
        state = self.start
        for i in ids:
            text, state = state.get(i) or self._step(state, i)
            yield text
        if state is not self.start:
            yield self.pending[id(state)].decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


def _completed(rest: bytes, need: int) -> str:
    second = {0xE0: 0xA0, 0xF0: 0x90}.get(rest[0], 0x80) if len(rest) == 1 else 0x80
    more = need - len(rest)
    return (rest + bytes([second]) * min(more, 1) + b"\x80" * (more - 1)).decode("utf-8", "replace")


class Coder:
    """Encoder and decoder of one vocabulary, with the words met lately: at most twice ``keep`` of them, none over 64 characters."""

    def __init__(self, path: str, pattern: str, keep: int = 200_000):
        ranks = read_ranks(path)
        self.words = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.decoder = Decoder(self.transducer.tokens)
        self.keep = keep
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple:
        """What is kept for a word: its ids."""
        return self.transducer.encode(word.encode())

    def encode(self, text: str) -> list[tuple]:
        """Ids of each word of ``text``."""
        return self._looked_up(self.words(text))

    def _looked_up(self, out: list[str]) -> list[tuple]:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        known = self.known
        try:
            return [known[w] for w in out]
        except KeyError:
            pass
        for w in set(out):
            if w not in known and len(w) <= 64:
                found = self.older.get(w)
                known[w] = self.of_word(w) if found is None else found
        return [known[w] if w in known else self.of_word(w) for w in out]


class RoundTrip(Coder):
    """Keeps for each stretch of text up to a blank the number of its ids, the ids in decimal, and the text they decode to.

    A stretch is whole words and whole characters, so that the decoder is at its start after it, and what it gives is the same wherever the stretch stands.
    Patterns other than ``BLANKS_LEAD`` have words for stretches.
    """

    def __init__(self, path: str, pattern: str, keep: int = 200_000):
        super().__init__(path, pattern, keep)
        self.decimal = {i: str(i) for i in self.transducer.tokens}.__getitem__
        self.cut = pattern == BLANKS_LEAD

    def of_word(self, word: str) -> tuple[int, str, str]:
        encode = self.transducer.encode
        ids = [i for w in (self.words(word) if self.cut else [word]) for i in encode(w.encode())]
        return len(ids), " ".join(map(self.decimal, ids)), self.decoder.decode(ids)

    def trip(self, text: str) -> tuple[int, str, str]:
        """The number of ids of a text, the ids in decimal with blanks between, and the text they decode to."""
        found = self._looked_up(before_blanks(text) if self.cut else self.words(text))
        n, ids, decoded = zip(*found) if found else ((), (), ())
        return sum(n), " ".join(ids), "".join(decoded)


_CODERS: dict[tuple[type, str, str], Coder] = {}


def coder(path: str, pattern: str, kind: type[Coder] = Coder) -> Coder:
    """The worker's coder of a vocabulary; it lives as long as the worker."""
    if (kind, path, pattern) not in _CODERS:
        _CODERS[kind, path, pattern] = kind(path, pattern)
    return _CODERS[kind, path, pattern]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``ids`` (array of int) of the whole text; null text is empty and has no ids.

    ``ranks`` is a file of tokens and ranks, ``pattern`` cuts words, which are encoded apart. One narrow pass; a word of any length costs its
    length. Special tokens' strings are plain text. Equal and null ids stay rows of their own; an empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = coder(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                ids = [list(chain.from_iterable(with_.encode(x or ""))) for x in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``tokens``: ``doc_id`` and the ``text`` of its ids; null ids give null. Bytes that are no character become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = coder(ranks, pattern).decoder
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [None if x is None else with_.decode(x) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{ids_col}`").cast("array<int>")).mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, SHA-256 of its ids in decimal with blanks between, and of the UTF-8 bytes that the ids decode to.

    The steps of ``encode_texts`` and ``decode_ids`` one after the other in the same task, each worked out once for a stretch of text (``RoundTrip``); rows as there.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, sha = coder(ranks, pattern, RoundTrip).trip, hashlib.sha256
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                out = []
                for x in texts[i:j]:
                    n, ids, decoded = trip(x or "")
                    out.append((n, sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest()))
                n, coded, decoded = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
