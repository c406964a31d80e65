"""Predicates over text: whole-word term lists, headlines, paths, e-mail shapes.

A term list becomes one alternation literal, so Spark compiles it once per task and a
screen is a single ``rlike`` inside the scan stage. The word boundary is spelled out with
the Unicode letter and number classes: Java's own word boundary disagrees on accents and joiners.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.text import as_column, text_or

_WORD = f"[{V.WORD_CLASS}]"
_BLANK = f"[{V.BLANK_CLASS}]"


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def _literal(term: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", term).replace("\\_", "_")


# Letters outside ASCII that equal an ASCII one when case is ignored.
_CASE_TWINS = {"i": "ıİ", "k": "\u212a", "s": "ſ"}


def _starts(terms: list[str]) -> str:
    """Lookahead for the first characters of ``terms``: turns most positions away before the
    alternation is tried. Left out where a term begins outside ASCII."""
    heads = {t[0].lower() for t in terms}
    if not all(h.isascii() and (h.isalnum() or h == "_") for h in heads):
        return ""
    chars = "".join(sorted("".join({h, h.upper()}) + _CASE_TWINS.get(h, "") for h in heads))
    return f"(?=[{chars}])"


def term_pattern(terms: list[str]) -> str:
    """Java pattern matching any of ``terms`` between word boundaries, ignoring case.

    A boundary lies where a word character meets a non-word character. Next to a letter
    that asks for a non-word neighbour; next to punctuation or a blank ("sr.", "vp ") it asks
    for a word character, so "Sr.Analyst" matches "sr." and "Sr. Analyst" does not.
    """
    terms = [t for t in terms if t]
    if not terms:
        raise ValueError("at least one non-empty term is needed")
    branches = []
    for first_is_word in (True, False):
        for last_is_word in (True, False):
            group = [t for t in terms if _is_word(t[0]) == first_is_word and _is_word(t[-1]) == last_is_word]
            if group:
                before = f"(?<!{_WORD})" if first_is_word else f"(?<={_WORD})"
                after = f"(?!{_WORD})" if last_is_word else f"(?={_WORD})"
                branches.append(f"{before}{_starts(group)}(?iu:{'|'.join(_literal(t) for t in group)}){after}")
    return "|".join(branches)


def has_term(c: Column | str, terms: list[str]) -> Column:
    return as_column(c).rlike(term_pattern(terms))


def lacks_term(c: Column | str, terms: list[str]) -> Column:
    return ~has_term(c, terms)


def level_ok(c: Column | str, include: list[str] = V.INCLUDE_TERMS, veto: list[str] = V.VETO_TERMS) -> Column:
    """Carries a wanted term and no vetoing one. An empty veto list vetoes nothing."""
    wanted = has_term(c, include)
    return wanted & lacks_term(c, veto) if veto else wanted


def place_ok(c: Column | str, places: list[str] = V.PLACE_TERMS) -> Column:
    return has_term(c, places)


# A headline is the word "meet" first, or two words, a colon and a blank.
HEADLINE_PATTERN = (
    f"(?iu)^{_BLANK}*meet(?!{_WORD})"
    f"|^{_BLANK}*[{V.WORD_CLASS}'’.-]+{_BLANK}+[{V.WORD_CLASS}'’.-]+{_BLANK}*:{_BLANK}"
)


def not_headline(title: Column | str) -> Column:
    return ~as_column(title).rlike(HEADLINE_PATTERN)


def path_pattern(words: list[str]) -> str:
    return f"(?i)/(?:{'|'.join(_literal(w) for w in words)})s?/"


def not_article_path(href: Column | str, words: list[str] = V.ARTICLE_PATH_WORDS) -> Column:
    """Looks at the address as written in the page, before it is resolved."""
    return ~as_column(href).rlike(path_pattern(words))


def is_posting(title: Column | str, href: Column | str, path_words: list[str] = V.ARTICLE_PATH_WORDS) -> Column:
    """Neither a headline nor an article link; an empty address passes."""
    href = text_or(href)
    return not_headline(text_or(title)) & ((href == "") | not_article_path(href, path_words))


# Fixed value: shape of an address; only the beginning of the text has to fit.
EMAIL_PATTERN = f"^[^@{V.BLANK_CLASS}]+@[^@{V.BLANK_CLASS}]+\\.[^@{V.BLANK_CLASS}]+"


def email_shaped(c: Column | str) -> Column:
    c = as_column(c)
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL_PATTERN)


def count_emails(text: Column | str) -> Column:
    """How many blank-separated words of a text have the shape. Texts without "@" are not searched, and of the others only the
    words with one are cut out."""
    text = as_column(text)
    words = F.regexp_extract_all(text, F.lit(f"[^@{V.BLANK_CLASS}]*+@[^{V.BLANK_CLASS}]*+"), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), F.size(F.filter(words, email_shaped)).cast("bigint")).when(text.isNotNull(), F.lit(0).cast("bigint"))
