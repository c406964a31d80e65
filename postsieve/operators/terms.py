"""Word screens with lists of any size: terms as a table, looked up by the words and marks of each text.

``functions.matching`` makes one pattern of a list, which is right for dozens of terms; thousands would be tried one after another
at every word. A term between word boundaries is a run of whole tokens (a word, or one character that belongs to none), so a
text has a term exactly if one of its token runs equals it. A run is cut out by one pattern for each form of term, and goes through a
plain join with the terms, which are sent to the texts up to a measured size and shuffled beyond.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.text import as_column, text_or
from postsieve.operators.dedup import PROBE_LIMIT

TOKEN = f"(?s)[{V.WORD_CLASS}]++|."


def _twins() -> tuple[str, str]:
    """Characters that equal another one when case is ignored, but not by their lower case alone."""
    single = lambda changed, c: changed if len(changed) == 1 else c
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha() or c.upper() != c:
            upper = single(c.upper(), c)
            folded = single(upper.lower(), upper)
            folded = "i" if c in "İı" else folded
            if folded != c.lower():
                pairs.append((c, folded))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _twins()
_SPAN = "[{}{}-{}]".format("".join(c for c in _FROM if c < "Ā"), min(c for c in _FROM if c >= "Ā"), max(_FROM))


def folded(c: Column | str) -> Column:
    """The text without case, character by character, as patterns that ignore case compare it. Where no character is in the
    span of the twins, lower case is all there is to do, and that is told at a fraction of the cost of replacing."""
    given = text_or(c)
    replaced = F.translate(F.lower(F.translate(given, _FROM, _TO)), _FROM, _TO)
    return F.when(given.rlike(_SPAN), replaced).otherwise(F.lower(given))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def term_table(terms: DataFrame, term: str = "term") -> DataFrame:
    """(gram, n): the terms without case, each once, and their numbers of tokens. NULL and empty terms are left out."""
    known = terms.select(folded(term).alias("gram")).where("gram <> ''").distinct()
    return known.select("gram", F.size(tokens("gram")).alias("n"))


def _run_pattern(n: int, first: bool, last: bool) -> str:
    """Group 1 is the run of ``n`` tokens that begins at a token and lies between word boundaries; ``first`` and ``last`` tell whether
    these tokens are words. Only the first token is consumed, so runs may overlap."""
    word, other = f"[{V.WORD_CLASS}]", f"[^{V.WORD_CLASS}]"
    begin = f"(?<!{word})" if first else f"(?<={word})"
    head = f"{word}++" if first else other
    end = f"(?<={word})" if last else f"(?<!{word})(?={word})"
    return f"(?s){begin}(?=({head}(?:{word}++|{other}){{{n - 1}}}+){end}){head}"


def runs(t: Column | str, forms: list[tuple[int, bool, bool]]) -> Column:
    """Of a text without case, the distinct runs of tokens that lie between word boundaries: at each end, one of the two
    neighbours is a word and the other is not. ``forms`` are the wanted numbers of tokens, and whether the first and the last is a word."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(as_column(t), F.lit(_run_pattern(*form)), F.lit(1)) for form in forms]))


def ids_with_terms(rows: DataFrame, terms: DataFrame, row_id: str, text: str = "text", limit: int = PROBE_LIMIT) -> DataFrame:
    """The ids of the rows whose text has one of ``terms`` (a ``term_table``), each once. A NULL text has none.

    Equal to ``matching.has_term`` for the same terms. Only the forms of terms (their lengths, and whether they begin and end with a word)
    come to the driver. Terms that measure no more than ``limit`` bytes are sent to the rows, whose runs then stay where they are.
    """
    is_word = lambda place: F.col("gram").rlike(place)
    forms = terms.groupBy("n", is_word(f"^[{V.WORD_CLASS}]").alias("first"), is_word(rf"[{V.WORD_CLASS}]\z").alias("last")).agg(
        F.sum(F.octet_length("gram").cast("bigint") + 32).alias("bytes")).orderBy("n", "first", "last").collect()
    if not forms:
        return rows.select(row_id).where(F.lit(False))
    found = runs("_folded", [(r["n"], r["first"], r["last"]) for r in forms])
    grams = rows.select(row_id, folded(text).alias("_folded")).select(row_id, F.explode(found).alias("gram"))
    known = terms.select("gram")
    known = F.broadcast(known) if sum(r["bytes"] for r in forms) <= limit else known
    return grams.join(known, "gram", "left_semi").select(row_id).distinct()


def with_terms(rows: DataFrame, terms: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """``rows`` whose text has one of the terms. ``row_id`` tells the rows apart and is not NULL."""
    return rows.join(ids_with_terms(rows, terms, row_id, text), row_id, "left_semi").select(rows.columns)


def without_terms(rows: DataFrame, terms: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """``rows`` whose text has none of the terms: a veto list of any size."""
    return rows.join(ids_with_terms(rows, terms, row_id, text), row_id, "left_anti").select(rows.columns)
