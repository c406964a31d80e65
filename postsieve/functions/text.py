"""Text columns: blanks, first lines, short titles, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or(c: Column | str, default: str = "") -> Column:
    """The value, or ``default`` where it is NULL."""
    return F.coalesce(as_column(c), F.lit(default))


def filled_or(c: Column | str, default: str | Column) -> Column:
    """The value, or ``default`` where it is NULL or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(as_column(c), F.lit("")), default)


def strip(c: Column | str) -> Column:
    """Remove every kind of blank from both ends (``trim`` alone only knows U+0020)."""
    return F.btrim(as_column(c), F.lit(V.BLANK_CHARS))


def first_line(c: Column | str) -> Column:
    """First line of the stripped text, stripped.

    The text is cut at its first line feed before the pattern for the other line ends runs, so
    the pattern sees one line and not a whole document; the result is the same.
    """
    left = F.ltrim(as_column(c), F.lit(V.BLANK_CHARS))
    line = F.substring_index(left, "\n", 1)
    return strip(F.regexp_extract(line, f"^[^{V.LINE_END_CLASS}]*", 0))


def match_text(*parts: Column | str) -> Column:
    """Text the word screens look at: the parts joined by one blank, NULL counting as empty."""
    return F.concat_ws(" ", *[text_or(p) for p in parts])


def place_text(location: Column | str, title: Column | str) -> Column:
    """The location, or the title where there is no location."""
    return filled_or(location, text_or(title))


def shorten(c: Column | str, limit: int = V.SHORT_TITLE_CHARS) -> Column:
    """Cut to ``limit`` characters and mark the cut; shorter texts stay as they are."""
    c = text_or(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def placeholder(c: Column | str) -> Column:
    return filled_or(c, V.PLACEHOLDER)


def initial(c: Column | str) -> Column:
    return F.upper(F.substring(as_column(c), 1, 1))
