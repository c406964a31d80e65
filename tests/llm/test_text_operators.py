"""Line dedup, quality rules, token files, mixing, packing and the pipeline against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import gcd

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from postsieve.llm import lines, mixing, packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} of the text," for i in range(20_000))
ODD = [
    (1, "A shared line of text\nonly here, in one", "en", "a", 39),
    (2, "  a SHARED line of text \nsomething else stands", "en", "a", 45),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, LONG, "de", "b", len(LONG)),
    (5, LONG, "de", "b", len(LONG)),
    (None, "A shared line of text", "en", "a", 21),
    (7, "short\nshort\n\n", "en", "c", 13),
    (8, "tab\tand\x0bother  white\r\n\x1c odd \x85 　 signs É́ <|endoftext|> don't", "xx", "c", 60),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def test_line_dedup_by_brute_force(odd):
    holders: dict[str, set] = {}
    for doc, text, *_ in ODD:
        for line in (text or "").split("\n"):
            if doc is not None and len(_key(line)) >= 10:
                holders.setdefault(_key(line), set()).add(doc)
    want = []
    for doc, text, *_ in ODD:
        all_lines = (text or "").split("\n")
        left = [x for x in all_lines if doc is None or len(holders.get(_key(x), ())) < 2 or min(holders[_key(x)]) == doc]
        want.append((doc, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    got = [tuple(r) for r in lines.line_report(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_keeps_columns_and_clashing_names(odd, empty):
    more = odd.selectExpr("*", "1 AS id", "2 AS mark", "3 AS gone", "4 AS `lines`")
    out = lines.dedup_lines(more)
    assert out.columns == more.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] == "something else stands" and rows[2]["n_chars"] == 21 and rows[3]["text"] is None
    assert lines.dedup_lines(empty).count() == 0 and lines.line_report(empty).count() == 0


def test_quality_counts_by_brute_force(odd, spark):
    extra = [(20 + i, t, "en", "a", 1) for i, t in enumerate(["a b c a b c a b", "x y z", "x x x x", "# $ a|b <c>\na\na\n \n ", "fine words end here. " * 30])]
    frame = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality_report(frame).collect()}
    for doc, text, *_ in [*ODD, *extra]:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        with_word = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[doc, len(words)]
        assert r["word_chars"] == sum(map(len, words)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(with_word) - len(set(with_word)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_lines_go_first_then_documents(spark, empty):
    body = "\n".join(f"Line{i} holds word{i} and thing{i} with note{i}." for i in range(12))
    menu = "Home | News | Sport | About us | Contact"
    loud = "\n".join("BUY!! NOW!! " * 6 + str(i) for i in range(20))
    frame = spark.createDataFrame([(1, body), (2, f"{menu}\n{body}\nAll rights reserved"), (3, f"{loud}\n{body[:200]}")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in quality.clean(frame).collect()}
    assert out == {1: body, 2: body}
    assert quality.clean(empty).count() == 0


def _expected_ids(name: str, end: int) -> dict[int, list]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for i, t in enumerate(x[1] for x in ODD)}


def test_token_files_by_exact_ids(odd, empty, spark):
    ids = _expected_ids("word_bpe_49k.json", 1)
    got = tokens.token_report(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(x.tobytes()) for x in ids.values())
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((x[0] for x in ODD), key=lambda x: (x is not None, x))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert tokens.token_report(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_encoders_equal_the_library():
    texts = ["", " ", "a  b", " a", "a ", "a\n b", "a\n\nb", "don't you'LL", "ǅ İstanbul ΑΣ Σ", "a\0b c", "é x", "日本 語",
             "1234 5x .. ...a,b", "a\x1c b \x85 c", "ß ÿ × Ø.", "A.\nB c.\n D", "<|endoftext|> a<|endoftext|>b", "y" * 5000, "a　 b", "½ ² ª"]
    for name, dropped, ranks in (
        ("word_bpe_49k.json", True, None), ("byte_bpe_50k.json", False, None),
        ("byte_bpe_50k.json", False, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)),
    ):
        own = tokens.encoder(public_tokenizers.path(name), dropped, ranks)
        library = Tokenizer.from_file(public_tokenizers.path(name))
        for text in texts:
            assert next(iter(own.encode([text]))) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), (name, text)


def _far_off(weights, total, resolution=1 << 20):
    """Blocks that a source is off its true weight, at most, over ``total`` slots in which no source runs out."""
    table = mixing.schedule(dict.fromkeys(weights, total), weights, resolution)
    whole, worst = sum(Fraction(str(w)) for w in weights.values()), 0
    for s, w in weights.items():
        slots = table[s].slots(np.arange(int(total * w / float(whole)) - 2))
        k, share = np.arange(len(slots)), float(Fraction(str(w)) / whole)
        worst = max(worst, np.abs(k - slots * share).max(), np.abs(k + 1 - (slots + 1) * share).max())
    return worst


def test_pfair_stays_within_one_block_of_the_true_weights():
    assert _far_off({"a": 0.3333, "b": 0.2005, "c": 0.31, "d": 0.1562}, 1_000_000) < 1
    assert _far_off({"a": 2**0.5, "b": 1.0, "c": 3.0**0.5}, 300_000) < 1
    assert _far_off(mixing.sqrt_weights({"a": 9_000_001, "b": 70_000, "c": 12}), 300_000) < 1


def _one_by_one(blocks, weights, resolution):
    """The schedule without periods: every slot is given by comparing all sources."""
    out, slot = {s: [] for s in blocks}, 0
    blocks = {s: n for s, n in blocks.items() if n}
    for group in ({s for s in blocks if weights.get(s, 0) > 0}, {s for s in blocks if not weights.get(s, 0) > 0}):
        units = mixing.integer_weights({s: weights.get(s, 0) or 1.0 for s in group}, resolution) if group else {}
        left = {s: blocks[s] for s in group}
        while left:
            total, start, took = sum(units[s] for s in left), slot, dict.fromkeys(left, 0)
            shared = gcd(*(units[s] for s in left))
            # A source that ends with its part of a period ends the stretch with the period, any other at once.
            while all(left.values()) or (slot - start) % (total // shared) and all(n or took[s] % (units[s] // shared) == 0 for s, n in left.items()):
                now = slot - start
                able = [s for s in left if left[s] and took[s] * total // units[s] <= now]
                s = min(able, key=lambda s: (-(-(took[s] + 1) * total // units[s]), -units[s], s))
                out[s].append(slot)
                took[s] += 1
                left[s] -= 1
                slot += 1
            left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_by_brute_force(seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(r.choice([1, 3, 6, 40]))]
    blocks = {s: r.choice([0, 1, 7, 60, 300]) for s in names}
    weights = {s: r.choice([0, 1, 0.25, 0.3, r.random()]) for s in names if r.random() < 0.9}
    table = mixing.schedule(blocks, weights, 200)
    assert {s: table[s].slots(np.arange(n)).tolist() for s, n in blocks.items() if n} == {s: x for s, x in _one_by_one(blocks, weights, 200).items() if x}


def test_mix_report_by_brute_force(spark):
    rows = {s: n for s, n in zip("abcd", (900, 333, 50, 1))}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in rows.items() for _ in range(n))], "doc_id long, source string")
    out = mixing.mix_report(docs).collect()
    expected = _one_by_one({s: -(-n // 16) for s, n in rows.items()}, mixing.sqrt_weights(rows), 1 << 20)
    assert all(r["slot"] == expected[r["source"]][r["block"]] and r["block"] == r["source_rank"] // 16 for r in out)
    order = sorted(out, key=lambda r: (r["slot"], r["source_rank"]))
    assert [r["position"] for r in order] == list(range(sum(rows.values())))
    assert {s: sorted(r["source_rank"] for r in out if r["source"] == s) for s in rows} == {s: list(range(n)) for s, n in rows.items()}


def test_schedule_of_many_sources():
    blocks = {f"s{i}": 3 + i % 5 for i in range(2000)}
    table = mixing.schedule(blocks, {s: 1 + n**0.5 for s, n in blocks.items()}, 1 << 12)
    slots = np.concatenate([table[s].slots(np.arange(n)) for s, n in blocks.items()])
    assert sorted(slots.tolist()) == list(range(sum(blocks.values())))


def test_what_programs_leave_does_not_grow(monkeypatch):
    r = np.random.default_rng(1)
    sizes, counts = np.unique(np.minimum(r.lognormal(5.5, 1.1, 60_000).astype(int) + 1, 300), return_counts=True)
    handed = []
    whole = packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda items, capacity: handed.append(sum(n for _, n in items)) or whole(items, capacity))
    for times in (1, 10, 50):
        histogram = {int(s): int(n) * times for s, n in zip(sizes, counts)}
        plan = packing.plan(histogram, 300)
        packed = Counter()
        for config, n in plan:
            assert sum(s * k for s, k in config.items()) <= 300
            for s, k in config.items():
                packed[s] += k * n
        assert packed == histogram
        assert sum(n for _, n in plan) <= 1.02 * sum(s * n for s, n in histogram.items()) / 300 + 1
    assert max(handed) <= 3 * min(handed) + 300, handed


def test_mix_places_every_row_once(odd, empty):
    out = mixing.mix(odd, {"a": 2.0, "b": 1.0, None: 1.0}, block_rows=2).collect()
    assert sorted(r["position"] for r in out) == list(range(len(ODD)))
    assert [r["row"]["source"] for r in sorted(out, key=lambda r: r["position"])][-2:] == ["c", "c"]
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, mixing.in_mixed_order(odd).collect())) == sorted(map(str, odd.collect()))


def test_pieces_and_packing(odd, empty):
    ids = _expected_ids("byte_bpe_50k.json", 0)
    rows = packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    by_doc = {ODD[i][0]: x for i, x in ids.items()}
    for r in rows:
        part = by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and (r["length"] == 2048 or r["piece"] == 0)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_near_the_volume_bound(seed):
    random = np.random.default_rng(seed)
    sizes = np.clip(random.lognormal(5.5, 1.0, 20_000).astype(int) + 1, 1, 2048)
    values, counts = np.unique(sizes, return_counts=True)
    plan = packing.plan(dict(zip(values.tolist(), counts.tolist())), 2048)
    packed: dict[int, int] = {}
    for config, times in plan:
        assert sum(s * n for s, n in config.items()) <= 2048
        for s, n in config.items():
            packed[s] = packed.get(s, 0) + n * times
    assert packed == dict(zip(values.tolist(), counts.tolist()))
    assert sum(t for _, t in plan) <= -(-sizes.sum() // 2048) * 1.01 + 1


def test_pack_takes_odd_lengths(spark):
    frame = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 3000), (5, 5), (5, 5)], "doc_id long, length long")
    out = packing.pack(frame, ["doc_id"]).collect()
    assert len(out) == 6 and sum(r["sequence_id"] is None for r in out) == 3


def test_pipeline_stages_keep_what_they_should(odd, empty, spark):
    body = "\n".join(f"Line{i} holds word{i} and thing{i} with note{i}." for i in range(12))
    other = "\n".join(f"Row{i} has term{i} but item{i} nor sign{i}." for i in range(12))
    frame = spark.createDataFrame([(1, body, "en", "a", 1), (2, other, "en", "b", 1), (3, "too short", "en", "b", 1), (4, body + " Yes.", "en", "a", 1)], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert sorted(r["doc_id"] for r in stages["ngram_jaccard_join"](spark, kept, "").collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in stages["source_mix"](spark, kept, "").collect()) == [1, 2, 4]
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "")
            assert out.columns == frame.columns or name == "best_fit_pack"
            out.count()


def test_pipeline_sequences_follow_the_weights(spark, tmp_path, monkeypatch):
    rows = [(i, f"{i:04d} " + "the river and " * (40, 90, 150, 210)[i // 2 % 4], "en", "ab"[i % 2], 0) for i in range(800)]
    source = {x[0]: x[3] for x in rows}
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    shares, seen = [], []
    for weights in ({"=a": 4.0, "=b": 1.0}, {"=a": 1.0, "=b": 4.0}):
        monkeypatch.setattr(mixing, "sqrt_weights", lambda rows: weights)
        out = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
        last = max(x[-2] for x in out)
        early = [source[x[0]] for x in out if x[-2] <= last // 3]
        shares.append(early.count("a") / len(early))
        seen.append(sorted(out))
        ends = {}
        for x in sorted(out, key=lambda x: x[-2:]):
            assert x[-1] == ends.get(x[-2], 0)
            ends[x[-2]] = x[-1] + x[3]
        assert max(ends.values()) <= 2048 and sorted(ends) == list(range(last + 1))
    assert [x[:5] for x in seen[0]] == [x[:5] for x in seen[1]] and seen[0] != seen[1]
    assert shares[0] > 0.7 and shares[1] < 0.3


def test_spread_keeps_the_plan():
    configs = [({5: 2}, 1000), ({7: 1}, 1), ({3: 1, 4: 2}, 70), ({9: 1}, 3)]
    rounds = packing.spread(configs)
    for config, times in configs:
        assert sum(n for c, n in rounds if c == config) == times
    assert max(n for c, n in rounds if c == {5: 2}) <= 16
