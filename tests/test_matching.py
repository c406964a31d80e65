import random
import re

import pytest

from postsieve.functions import matching as M
from postsieve.functions import vocabulary as V

INCLUDE_NO = ["Intern", "internal", "Internships", "0-1 years", "junior_", "Associateé", "international"]
INCLUDE_YES = ["campus-wide", "0-1 year", "new grad", "trainee‍", "freshe" + "ŕ", "ENTRY-LEVEL", "(Junior)"]
VETO_YES = [
    "Sr Associate", "Sr.Associate", "VP Graduate", "VP,Graduate", "Associate 3+ year",
    "Associate 3+ years of experience", "Associate Director",
]
VETO_NO = ["Sr. Associate", "VP, Graduate", "Associate 3+ years", "Team Leader"]


def test_include_terms(values):
    assert values(lambda c: M.has_term(c, V.INCLUDE_TERMS), INCLUDE_NO) == [False] * len(INCLUDE_NO)
    assert values(lambda c: M.has_term(c, V.INCLUDE_TERMS), INCLUDE_YES) == [True] * len(INCLUDE_YES)


def test_veto_terms(values):
    assert values(lambda c: M.has_term(c, V.VETO_TERMS), VETO_YES) == [True] * len(VETO_YES)
    assert values(lambda c: M.has_term(c, V.VETO_TERMS), VETO_NO) == [False] * len(VETO_NO)


def test_level_needs_a_term_and_no_veto(values):
    texts = ["Associate Analyst", "Associate Director", "Analyst", "Junior Associate - Evidence Synthesis"]
    assert values(M.level_ok, texts) == [True, False, False, True]


def test_empty_lists(values):
    with pytest.raises(ValueError):
        M.term_pattern([])
    assert values(lambda c: M.level_ok(c, ["a"], []), ["a", "b"]) == [True, False]


def _python_terms(terms):
    return re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)


@pytest.mark.parametrize("terms", [V.INCLUDE_TERMS, V.VETO_TERMS, V.PLACE_TERMS, ["für", "éa", "c++", "_x", ".net"]])
def test_terms_agree_with_word_boundary_search(values, terms):
    rng = random.Random(7)
    glue = [" ", "", "-", ".", ",", "é", "_", "1", "²", "①", "́", "‍", "\n", "s", " ", "ſ", "K", "ß", "日"]
    texts = []
    for _ in range(4000):
        word = rng.choice(terms)
        word = rng.choice([word, word.upper(), word.title(), word.replace("s", "ſ"), word[:-1], word + word])
        texts.append("".join(rng.choice(glue) for _ in range(2)) + word + "".join(rng.choice(glue) for _ in range(2)))
    pattern = _python_terms(terms)
    assert values(lambda c: M.has_term(c, terms), texts) == [bool(pattern.search(t)) for t in texts]


def test_case_twins_are_complete(spark):
    chars = [(chr(c),) for c in range(0x80, 0xFFFF) if not 0xD800 <= c <= 0xDFFF]
    found = spark.createDataFrame(chars, "c string").where("c rlike '(?iu)^[a-z]$'").collect()
    assert {r.c for r in found} == set("".join(M._CASE_TWINS.values()))


def test_headlines(values):
    rejected = ["Meet Nils", "Jane Doe: hi", "Software Engineer: Graduate", " Meet X", "meet", " \x1cJane O'Doe : x"]
    kept = ["Meeting host", "A B C: x", "Jane Doe:hi", "x\nMeet Y", "", "Jane: x", "Meeté"]
    assert values(M.not_headline, rejected) == [False] * len(rejected)
    assert values(M.not_headline, kept) == [True] * len(kept)


def test_article_paths(values):
    assert values(M.not_article_path, ["/blogs/x", "/Blog/x", "/stories/", "a/news/b"]) == [False] * 4
    assert values(M.not_article_path, ["/article", "/job/news", "/newsroom/x", ""]) == [True] * 4


def test_posting_needs_both(values):
    assert values(M.is_posting, ["Analyst", "Analyst", "Meet A", None], ["/job/1", "/blog/1", "", None]) == [
        True, False, False, True,
    ]


def test_email_shape(values):
    assert values(M.email_shaped, ["a@b.c", "a@b.c junk", "a@b.c@d", "é@b.ü"]) == [True] * 4
    assert values(M.email_shaped, ["a@b", "a@@b.c", "x y@b.c", "@b.c", "a b"]) == [False] * 5
