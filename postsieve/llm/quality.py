"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import WHITE, words, whole_row

#: The symbols of the base rule.
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, as one pattern over lower-cased lines.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|(uses?|accept) cookies"
    "|enable javascript|lorem ipsum|click here|read more|sign up for|subscribe to our|skip to (main )?content"
    "|share (this )?on (facebook|twitter)|powered by "
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules, and how much text a document may lose."""

    symbols_per_word: float = 0.2
    shouted_share: float = 0.3
    repeated_share: float = 0.5
    repeated_from: int = 8
    menu_marks: int = 2
    boilerplate_words: int = 30
    lost_share: float = 0.5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def bad_line(line: Column, rules: LineRules) -> Column:
    """Whether a line fails one of the rules. A line without a word fails none.

    punctuation: symbols at more than ``symbols_per_word`` a word, or more than ``shouted_share`` of the words ending in ``!!``;
    navigation: ``menu_marks`` or more free-standing separators (``|``, ``>``, a raised dot or angle quote) in a line without a full stop;
    boilerplate: a phrase of page furniture in a line of at most ``boilerplate_words`` words; or, from ``repeated_from`` words on,
    more than ``repeated_share`` of the words are repeats within the line.
    """
    spaced = F.filter(F.split(line, "[ \\t-\\r]+"), lambda w: w != "")

    def judge(w: Column) -> Column:
        n = F.size(w)
        symbols = F.length(line) - F.length(_without(line, SYMBOLS))
        shouted = F.regexp_count(line, F.lit("!!(?=[ \\t-\\r]|$)"))
        menu = F.regexp_count(line, F.lit("(?<=[ \\t])[|>\u00bb\u203a\u00b7](?=[ \\t])"))
        return (
            (symbols > n * F.lit(rules.symbols_per_word))
            | (shouted > n * F.lit(rules.shouted_share))
            | ((menu >= rules.menu_marks) & ~line.rlike("[.!?][ \\t-\\r]*$"))
            | ((n <= rules.boilerplate_words) & F.lower(line).rlike(BOILERPLATE))
            | ((n >= rules.repeated_from) & (n - F.size(F.array_distinct(w)) > n * F.lit(rules.repeated_share)))
        )

    return F.get(F.transform(F.array(spaced), lambda w: (F.size(w) > 0) & judge(w)), F.lit(0))


def repeat_words(tokens: Column) -> Column:
    """How many words stand in a 3-word window that the text holds twice or more, the first one included.

    Windows are compared by their 64-bit hashes. Only a text with a repeated window sorts them: equal windows
    are then neighbours, and the positions of both cover three words each.
    """

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

        def covered(h: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
                twice = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
                return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, of_sorted))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes, covered))

    return _let(tokens, count)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judged(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct), with the base counts, the verdict and the lines that stay.

    Null and empty texts have no words and fail the base rule. Rows are judged one by one, so repeated rows, ties and
    other columns change nothing, and nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    has_word = lambda x: _without(x, WHITE) != ""
    base = docs.select(whole_row(docs).alias("row"), text.alias("text"), words(text).alias("w"), F.split(text, "\n", -1).alias("lines"))
    base = base.select(
        "row", "lines", "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _let(F.filter("lines", has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda x: ~bad_line(x, rules)).alias("staying"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.length(_without(F.array_join("staying", ""), WHITE))
    return base.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("word_chars") - left <= F.col("word_chars") * F.lit(rules.lost_share))
    )


def clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), chars_col: str | None = "n_chars") -> DataFrame:
    """The rows that are kept, with their failing lines taken out; same columns, ``chars_col`` brought up to date."""
    out = judged(docs, text_col, rules).filter("kept")
    cut = F.size("staying") < F.size("lines")
    text = F.when(cut, F.array_join("staying", "\n")).otherwise(F.col("text"))

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == text_col:
            return text.alias(name)
        if name == chars_col:
            return F.when(cut, F.length(F.array_join("staying", "\n"))).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old.alias(name)

    return out.select(*[column(name) for name in docs.columns])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Per row: id, the base counts, whether the base rule fails, and whether the document stays."""
    return judged(docs, text_col, rules).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )
