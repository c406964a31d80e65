"""Row screens. Each is one ``where`` right behind the extraction, cheap predicates first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.matching import is_posting, level_ok, place_ok
from postsieve.functions.text import as_column, match_text, place_text, text_or


def endpoint_row_ok(
    title: str = "title", location: str = "location", href: str = "href",
    include: list[str] = V.INCLUDE_TERMS, veto: list[str] = V.VETO_TERMS,
    places: list[str] = V.PLACE_TERMS, path_words: list[str] = V.ARTICLE_PATH_WORDS,
) -> Column:
    """Endpoint rows: level on title and location, place on the location or else the title."""
    return (
        is_posting(title, href, path_words)
        & level_ok(match_text(title, location), include, veto)
        & place_ok(place_text(location, title), places)
    )


def screen_endpoint_rows(rows: DataFrame, **screen: str | list[str]) -> DataFrame:
    """Rows that pass ``endpoint_row_ok``, which names the arguments."""
    return rows.where(endpoint_row_ok(**screen))


def screen_page_rows(
    rows: DataFrame,
    title: str = "title", card: str = "card", href: str | None = "href",
    include: list[str] = V.INCLUDE_TERMS, veto: list[str] = V.VETO_TERMS,
    places: list[str] | None = V.PLACE_TERMS, path_words: list[str] = V.ARTICLE_PATH_WORDS,
) -> DataFrame:
    """Page rows: a title is needed; level and place look at the whole card.

    ``places=None`` leaves the place screen out, ``href=None`` says that the rows carry no link.
    """
    keep = text_or(title) != ""
    keep &= is_posting(title, as_column(href) if href else F.lit(""), path_words)
    keep &= level_ok(text_or(card), include, veto)
    if places is not None:
        keep &= place_ok(text_or(card), places)
    return rows.where(keep)
