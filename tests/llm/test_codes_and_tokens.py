"""Vector codes, byte-level encoding and token alignment against brute force, the libraries, SQL and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from postsieve.llm import alignment, byte_bpe, gnat
from postsieve.llm import queries as llm
from postsieve.llm.oracles import vector_codes

SMALL = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  two  blanks ", "line\nline\r\n\tx \n y", "Grüße, 東京! 𝔘𝔫𝔦 🙂🙂", "<|endoftext|> and </s> <s> <unk> <0x41>", "under▁bar word",
    "it's we'll 'Twas 1234567 $%&&& ...", "x" * 5000, "ab" * 3000 + " " + "tail", "\0 nul \0", "a b　c d", "näive é", "the same text", "the same text",
]


# Vector codes

@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(-12, 12), st.integers(-12, 12)), min_size=1, max_size=30), st.integers(2, 6))
@settings(max_examples=150, deadline=None)
def test_tree_finds_the_lowest_nearest_entry(entries, points, degree):
    entries, points = np.array(entries), np.array(points)
    near, gap = gnat.Gnat(entries, degree).nearest(points)
    all_ = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    assert near.tolist() == all_.argmin(1).tolist() and gap.tolist() == all_.min(1).tolist()


def test_tree_rules_subtrees_out_and_takes_large_numbers():
    r = np.random.default_rng(1)
    entries = r.integers(-4000, 4000, (64, 8))
    points = entries[r.integers(0, 64, 500)] + r.integers(-40, 40, (500, 8))
    tree = gnat.Gnat(entries)
    near, _ = tree.nearest(points)
    assert near.tolist() == ((points[:, None, :] - entries[None]) ** 2).sum(2).argmin(1).tolist()
    assert tree.compared < 500 * 64 / 2
    big = [[(1 << 61) + k, -(1 << 61)] for k in (0, 3, 1)]
    near, gap = gnat.Gnat(np.array(big, dtype=object)).nearest(np.array([[(1 << 61) + 2, -(1 << 61)]], dtype=object))
    assert (near.tolist(), gap.tolist()) == ([1], [1])


def test_codes_equal_their_sql(spark):
    df = llm.QUERIES["op11_vector_codes"](spark, SMALL)
    assert difference(df, connect(SMALL), vector_codes()) is None


def _codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, _, v in kept]
    books = [[cut[k][p] for k in sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][2]))[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(xs) // len(own[e]) for xs in zip(*own[e])) if e in own else y for e, y in enumerate(books[p])]
    out = [(i, label, "".join(f"{nearest(p, c[p])[1]:02x}" for p in range(parts)), sum(nearest(p, c[p])[0] for p in range(parts))) for (i, label, _), c in zip(kept, cut)]
    by = Counter()
    for _, label, _, error in out:
        by[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted((i, code, error, by[label], digest) for i, label, code, error in out)


def test_codes_by_brute_force_with_odd_rows(spark):
    r = random.Random(3)
    rows = [(k * 3 % 50, r.choice([None, 1, 2]), [r.choice([-1.5, 0.25, r.gauss(0, 1), 0.0]) for _ in range(16)]) for k in range(60)]
    rows += [(900, 1, None), (901, 1, [None] * 16), (902, 1, [float("nan")] * 16), (903, 2, [float("inf")] * 16), (5, 1, rows[0][2]), (5, 1, rows[0][2])]
    df = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, label int, embedding array<float>, code string")
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = sorted(tuple(x) for x in gnat.code_report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == _codes(rows)


def test_codes_of_few_other_and_no_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert gnat.code_report(spark.createDataFrame([], schema)).count() == 0
    assert gnat.code_report(spark.createDataFrame([(1, 1, None)], schema)).count() == 0
    rows = [(1, None, [1.0] * 8), (2, None, [2.0] * 8), (3, 1, [1.0] * 7), (None, 1, [1e200] * 8), (4, 1, [1e12] * 8)]
    got = {x["vec_id"]: (x["code"], x["error"], x["label_error"]) for x in gnat.code_report(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: ("01" * 8, 0, 0), 3: (None, None, 0), 4: ("02" * 8, 0, 0)}
    odd = gnat.code_report(spark.createDataFrame([(1, 1, [1.0] * 7)], schema)).collect()
    assert [(x["code"], x["error"]) for x in odd] == [(None, None)]


# Byte-level encoding

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return byte_bpe.Transducer(byte_bpe.read_ranks(RANKS), keep=2000)


@given(st.one_of(st.binary(max_size=40), st.lists(st.sampled_from([b"a", b"b", b" t", b"he", b"in", b"ing", b" the", b"\xc3", b"\xa9"]), max_size=30).map(b"".join)))
@settings(max_examples=400, deadline=None)
def test_transducer_equals_merging(machine, word):
    expected = [machine.ranks[x] for x in byte_bpe.merged(word, machine.ranks)]
    assert list(machine.encode(word)) == expected
    pieces = [word[i : i + 3] for i in range(0, len(word), 3)]
    assert [i for x in machine.stream(pieces) for i in x] == expected


def test_transducer_of_an_ambiguous_small_vocabulary():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"ca": 5, b"abc": 6, b"cab": 7, b"aa": 8, b"aaa": 9}
    machine, r = byte_bpe.Transducer(ranks, keep=20), random.Random(2)
    for _ in range(2000):
        word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 25)))
        assert [machine.tokens[i] for i in machine.encode(word)] == byte_bpe.merged(word, ranks)
    with pytest.raises(ValueError):
        machine.encode(b"x")


def test_tokens_come_before_the_end(machine):
    seen = []

    def fed():
        for k in range(200):
            yield b"hello world "
            seen.append(k)

    first = next(machine.stream(fed()))
    assert first and len(seen) < 3


@given(st.binary(max_size=12), st.data())
@settings(max_examples=400, deadline=None)
def test_decoder_equals_python_however_bytes_are_cut(data, draw):
    cuts = sorted(draw.draw(st.sets(st.integers(0, len(data)), max_size=6)))
    pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    decoder = byte_bpe.Decoder(dict(enumerate(pieces)))
    assert decoder.decode(range(len(pieces))) == data.decode("utf-8", "replace")


def test_round_trip_equals_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "a", "x")], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(x) for x in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)

    def row(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()

    assert got == sorted((row(i, t) for i, t in [*enumerate(TEXTS), (None, "null id"), (3, "a")]), key=str)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter(tuple(x) for x in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(x) for x in byte_bpe.decode_ids(none, RANKS, public_tokenizers.PATTERN).collect()} == {(1, None), (2, "")}


def test_round_trip_works_a_stretch_out_once(monkeypatch):
    calls = []
    monkeypatch.setattr(byte_bpe.Decoder, "decode", lambda self, ids, was=byte_bpe.Decoder.decode: calls.append(1) or was(self, ids))
    own, text = byte_bpe.RoundTrip(RANKS, public_tokenizers.PATTERN), "It's 12 words,  and\n more \u00a0 \u65e5\u672c  words, I'll\tsay. "
    assert own.cut
    ids = [i for w in byte_bpe.Coder(RANKS, public_tokenizers.PATTERN).encode(text) for i in w]
    expected = len(ids), " ".join(map(str, ids)), text
    assert own.trip(text) == expected and calls
    before = len(calls)
    assert own.trip(text) == expected and len(calls) == before
    assert own.trip("") == (0, "", "")


def test_whole_documents_equal_the_library(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in llm.QUERIES["op12_byte_bpe"](spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert got == {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}


# Alignment

def _byte_of():
    hidden = [x for x in range(256) if x <= 32 or 127 <= x <= 160 or x == 173]
    return {chr(x): x for x in range(256) if x not in hidden} | {chr(256 + n): x for n, x in enumerate(hidden)}


def _by_hand(texts):
    a, b, byte_of = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES), _byte_of()
    a.encode_special_tokens = True
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        data = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            docs.append(None)
            continue
        spans = [[(e - len(x), e, i) for e, x, i in zip(accumulate(map(len, xs)), xs, ids)] for xs, ids in ((bytes_a, ids_a), (bytes_b, ids_b))]
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for _, e, i in side if x < e <= y] for side in spans] for x, y in zip([0, *common], common)]
        links, j = [], 0
        for x, y, i in spans[0]:
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                links.append((i, spans[1][k][2]))
                k += 1
        docs.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for d in docs if d for x in d[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0,) * 6 + ("",))
        else:
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(written.encode()).hexdigest()))
    return out, count


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk,block,fan", [(65_536, 4_000_000, 32), (40, 300, 12)])
def test_alignment_by_hand(spark, chunk, block, fan):
    r = random.Random(4)
    pool = ["Grüße", "tokenizer", "it's", "1234", "naïve", "東京都", "...", "unbelievable", "a", "\n", "x-y", "🙂"]
    texts = TEXTS + [" ".join(r.choice(pool) for _ in range(r.randint(1, 120))) for _ in range(30)] + [" ".join(pool * 5) + " ▁ " + " ".join(pool * 5)]
    docs = spark.createDataFrame([(i % 40, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    rows, counts = alignment.align(docs, BYTES, PIECES, block_chars=block, chunk_chars=chunk, fan=fan)
    expected, count = _by_hand(texts)
    assert Counter(tuple(x) for x in rows.select("doc_id", *_COLUMNS).collect()) == Counter((i % 40, *e) for i, e in enumerate(expected))
    assert {(x["a_id"], x["b_id"]): x["total"] for x in counts.collect()} == dict(count)


def test_pieces_are_encoded_together():
    own, calls = alignment.Aligner(BYTES, PIECES), []
    texts = ["some words, more\nwords and 12 of x1y2z3", "  a  b \tc d ", " ", "\ufb01x \u00bd n", "\u65e5\u672c \u8a9e \u00e9t\u00e9", "<s> </s> a", "\u2581 a\u2581b", "a\0b c\x1c d e"]
    pieces = list(dict.fromkeys(p for x in texts for p in own.words(" " + x)))
    expected = list(own._align(pieces))
    one = own._align
    own._align = lambda some: calls.extend(some) or one(some)
    assert own.align(pieces) == expected
    calls.clear()
    own.align([f" w{i}q" for i in range(200)])
    assert not calls


def test_aligned_pieces_are_held_up_to_a_bound():
    own = alignment.Aligner(BYTES, PIECES, keep=100)
    for k in range(4):
        some = [f" w{k}q{i}" for i in range(500)]
        assert own.align(some) == list(own._align(some))
        assert len(own.known.place) <= 100 and len(own.older.place) <= 100
    once = [f" once{i}" for i in range(50)]
    own.columns([*once, " twice"], np.array([False] * 50 + [True]))
    assert " twice" in own.known.place and not set(once) & set(own.known.place)
    assert own.align([" twice", once[3], "x" * 300, *some[400:]]) == list(own._align([" twice", once[3], "x" * 300, *some[400:]]))


def test_alignment_of_whole_documents(spark):
    got = {r["doc_id"]: tuple(r[c] for c in _COLUMNS) for r in llm.QUERIES["op13_token_alignment"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = _by_hand([d["text"] for d in docs])
    assert got == {d["doc_id"]: e for d, e in zip(docs, expected)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_report(empty, BYTES, PIECES).count() == 0


_sizes = st.lists(st.integers(1, 4), min_size=1, max_size=14)


@given(_sizes, _sizes, st.data())
@settings(max_examples=300, deadline=None)
def test_fragments_join_in_any_tree(a, b, draw):
    gap = sum(a) - sum(b)
    a, b = a + [-gap] * (gap < 0), b + [gap] * (gap > 0)
    total = sum(a)
    tokens = [[(i, n) for i, n in enumerate(x)] for x in (a, b)]
    whole = alignment.fragment(*tokens, 0, total)
    cuts = sorted(draw.draw(st.sets(st.integers(1, max(total - 1, 1)), max_size=6)) | {0, total})
    parts = [alignment.fragment(*tokens, x, y, k) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]

    def tree(some):
        if len(some) == 1:
            return some[0]
        at = draw.draw(st.integers(1, len(some) - 1))
        return tree(some[:at]) + alignment.Fragment() + tree(some[at:])

    joined = tree(parts)

    def plain(g):
        return [list(x) for x in g]

    assert [plain(g) for _, g in joined.groups] == [plain(g) for _, g in whole.groups]
    assert joined.closed and not any(map(len, joined.head)) and not any(map(len, joined.tail))
    # Each joined group is numbered by the stretch that closes it.
    ends = set(accumulate(a)) & set(accumulate(b))
    assert [k for k, _ in joined.groups] == [next(i for i, y in enumerate(cuts[1:]) if e <= y) for e in sorted(ends)]
