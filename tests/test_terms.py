"""Terms as a table against the pattern of the same terms."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from postsieve.functions import matching as M
from postsieve.functions import vocabulary as V
from postsieve.operators import terms as T
from postsieve.streaming import incremental

GLUE = [" ", "", "-", ".", ",", "é", "_", "1", "²", "①", "́", "‍", "\n", "s", " ", "ſ", "K", "ß", "ẞ", "日", "İ", "ı", "Σ", "ς", "µ", "😀"]


def table(spark, words):
    return T.term_table(spark.createDataFrame([(w,) for w in words], "term string"))


def both(spark, words, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = [w for w in words if w]
    want = {r.id for r in df.where(M.has_term("text", known)).collect()}
    assert {r.id for r in T.with_terms(df, table(spark, words), "id").collect()} == want
    assert {r.id for r in T.without_terms(df, table(spark, words), "id").collect()} == set(range(len(texts))) - want
    return want


@pytest.mark.parametrize("words", [
    V.INCLUDE_TERMS, V.VETO_TERMS, V.PLACE_TERMS,
    ["für", "éa", "c++", "_x", ".net", "σας", "µm", "straße", "ılk", "a b", "😀x", ". .", "", None],
])
def test_equal_to_the_pattern(spark, words):
    rng = random.Random(7)
    texts = [None, "", " "]
    for _ in range(1500):
        word = rng.choice([w for w in words if w])
        word = rng.choice([word, word.upper(), word.title(), word.replace("s", "ſ"), word[:-1], word + word])
        texts.append("".join(rng.choice(GLUE) for _ in range(2)) + word + "".join(rng.choice(GLUE) for _ in range(2)))
    assert 100 < len(both(spark, words, texts)) < 1400


def test_ten_thousand_terms(spark):
    rng = random.Random(3)
    syllables = ["ba", "ko", "ri", "tu", "ne", "so", "li", "mé", "da", "fu"]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    words = {f"{word(4)} {word(2)}" for _ in range(5000)} | {word(5) for _ in range(4800)} | {f"{word(4)}++" for _ in range(200)}
    texts = [" ".join(rng.choice([word(4), word(2), word(5), "c++x", word(2).upper()]) for _ in range(12)) for _ in range(800)]
    assert 0 < len(both(spark, sorted(words), texts)) < 800


def test_lower_case_is_enough_outside_the_span_of_the_twins():
    inside = re.compile(T._SPAN)
    assert all(inside.match(c) for c in T._FROM)
    others = (chr(code) for code in range(sys.maxunicode + 1) if not inside.match(chr(code)))
    assert not [c for c in others if set(c.lower()) & set(T._FROM)]


def test_runs_stay_with_the_texts_and_shuffled_terms_find_the_same(spark):
    df = spark.createDataFrame([(1, "One two-three"), (2, "two three"), (3, "C++ x"), (4, None), (5, "a two"), (6, "😀 one two")], "id int, text string")
    known = table(spark, ["one two", "two-", "c++", "x", " two", "a"])
    sent, shuffled = T.ids_with_terms(df, known, "id"), T.ids_with_terms(df, known, "id", limit=0)
    assert {r.id for r in sent.collect()} == {r.id for r in shuffled.collect()} == {r.id for r in df.where(
        M.has_term("text", ["one two", "two-", "c++", "x", " two", "a"])).collect()}
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(gram" not in plan.split("BroadcastExchange")[0]
    assert "lambdafunction" not in plan, "runs are cut out by patterns, not by functions over arrays of tokens"


def test_no_terms_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    nothing = table(spark, ["", None])
    assert T.with_terms(df, nothing, "id").count() == 0 and T.without_terms(df, nothing, "id").count() == 1
    assert T.with_terms(df.where("false"), table(spark, ["a"]), "id").count() == 0


def test_state_of_a_forgetting_stream_is_bounded(spark, tmp_path):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    batches = [[("A", 1), ("B", 9), ("C", 12)], [("A", 8), ("B", 10), ("D", 2)], [("A", 30), ("E", 11)]]
    found, kept = [], []
    for batch in batches:
        rows = spark.createDataFrame([(c, "t", day(n)) for c, n in batch], "company string, title string, at string")
        rows.withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("company string, title string, at timestamp").parquet(f"{tmp_path}/in")
        keys = incremental.stream_keys(stream, event_time="at", forget_after="5 days")
        query = (keys.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        found.append(sorted((r.company, r.at.day) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert found[0] == [("A", 1), ("B", 9), ("C", 12)]
    assert found[1] == sorted([*found[0], ("A", 8)]), "A is forgotten and comes out again, D is late"
    assert found[2] == sorted([*found[1], ("E", 11)]), "A of day 8 was still known when day 30 came"
    assert kept == [2, 3, 0], "forgotten keys leave the state"
