"""Captured pages (HTML text) to link rows.

Links are cut out with regular expressions on the JVM; nothing is parsed in Python. The
loops in the patterns are possessive or bounded by the next tag, so they neither recurse nor
go over a hostile page again and again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions import vocabulary as V
from postsieve.functions.text import as_column, first_line, strip

# Parts of a page that hold no visible links, to the end of the page where they are not closed.
# Every pattern over a whole page begins with a plain "<", which turns most positions away.
_HIDDEN = (
    r"<(?:!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
    r"|(?i:(script|style|template|svg))\b(?:[^<]++|<(?!/(?i:\1)\s*>))*+(?:</(?i:\1)\s*>|\z))"
)

# The rest of a start tag; ">" inside a quoted attribute value does not end it.
_ATTRIBUTES = r"""(?:\s(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)?"""

# A link runs to its end tag, or to the next link where the end tag is missing. A start tag the
# page breaks off in is matched too, so that no later search repeats the way to the end of the
# page; it is dropped afterwards.
_LINK = rf"<[aA]{_ATTRIBUTES}(?:>(?:[^<]++|<(?!/?[aA][\s>]))*+|\z)"
_START_TAG = rf"(?i)^<a{_ATTRIBUTES}>"
_HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_BLOCK_TAG = rf"(?i)</?(?:{'|'.join(V.BLOCK_ELEMENTS)})(?:[\s/][^<>]*)?>"
_CELL_END = r"(?i)</t[dh]\s*>"
_ANY_TAG = r"</?[A-Za-z][^<>]*>"


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once: in functions over arrays Spark computes an expression again at each place it is used."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _char_of(digits: Column, base: int) -> Column:
    """Character of a reference's digits, however many; U+FFFD for zero, surrogates and what is out of range."""

    def number(short: Column) -> Column:
        return F.when((short != "") & (F.length(short) <= 7), F.conv(short, base, 10).cast("bigint"))

    def char(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    return _bound(_bound(F.regexp_replace(digits, "^0+", ""), number), char)


def decode_references(c: Column) -> Column:
    """Decode named and numbered character references, each only where there are any.

    Every replacement is literal: a decoded "$" or backslash stands for itself.
    """
    return _bound(c, _decoded)


def _decoded(c: Column) -> Column:
    ampersand = F.lit("&")
    names = F.array_remove(F.array_distinct(F.regexp_extract_all(c, F.lit(r"&([A-Za-z][A-Za-z0-9]{1,31});"), F.lit(1))), "amp")
    # A map is searched from its start, so the names are parted by their first two letters.
    known = F.from_json(F.lit(V.HTML_REFERENCES_JSON), "map<string,map<string,string>>")

    def named(name: Column) -> Column:
        char = F.try_element_at(F.try_element_at(known, F.substring(name, 1, 2)), name)
        return F.coalesce(char, F.concat(ampersand, name, F.lit(";")))

    def all_of(text: Column, found: Column, before: list[str], char: Callable[[Column], Column]) -> Column:
        def one(done: Column, key: Column) -> Column:
            def replaced(by: Column) -> Column:
                out = done
                for start in before:
                    out = F.replace(out, F.concat(F.lit(start), key, F.lit(";")), by)
                return out

            return _bound(char(key), replaced)

        return F.aggregate(found, text, one)

    decoded = all_of(c, names, ["&"], named)
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#([0-9]+);"), F.lit(1)))
    hex_codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#[xX]([0-9A-Fa-f]+);"), F.lit(1)))
    decimal = all_of(decoded, codes, ["&#"], lambda n: _char_of(n, 10))
    both = all_of(decimal, hex_codes, ["&#x", "&#X"], lambda n: _char_of(n, 16))
    last = F.replace(F.replace(both, F.lit("&amp;"), ampersand), F.lit("&AMP;"), ampersand)
    return F.when(F.contains(c, ampersand), last).otherwise(c)


def visible_text(html: Column) -> Column:
    """Text of an HTML fragment as a reader sees it: source line breaks are blanks, block
    elements are line breaks, table cells end with a tab, other tags vanish, references are decoded."""
    flat = F.regexp_replace(html, r"[\t\n\f\r ]+", " ")
    lined = F.regexp_replace(F.regexp_replace(flat, _CELL_END, "\t"), _BLOCK_TAG, "\n")
    bare = F.regexp_replace(F.regexp_replace(lined, _ANY_TAG, ""), " {2,}", " ")
    tidy = F.regexp_replace(bare, r"[ \t]*+\n[ \t\n]*", "\n")
    return strip(decode_references(tidy))


def _link_fields(a: Column) -> Column:
    """(start tag, href, text) of one cut-out link."""

    def fields(start: Column) -> Column:
        href = F.concat(*[F.regexp_extract(start, _HREF, i) for i in (1, 2, 3)])
        return F.struct(
            start.alias("start"), decode_references(href).alias("href"),
            visible_text(F.regexp_replace(a, _START_TAG, "")).alias("text"),
        )

    return _bound(F.regexp_extract(a, _START_TAG, 0), fields)


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link: the other columns, ``ord``, ``href`` as written, visible ``text``.

    Projected right behind the scan, so the HTML itself never enters a shuffle. The fields are
    made before the list is exploded: a later filter then reads finished columns, while on
    projected ones Spark would repeat the whole text clean-up for every predicate.
    """
    kept = [c for c in pages.columns if c != html]
    shown = F.regexp_replace(as_column(html), _HIDDEN, "")
    links = F.transform(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(0)), _link_fields)
    rows = pages.select(*kept, F.posexplode(links).alias("ord", "_link")).where(F.col("_link.start") != "")
    return rows.select(
        *kept, F.col("ord").cast("bigint").alias("ord"),
        F.col("_link.href").alias("href"), F.col("_link.text").alias("text"),
    )


def page_postings(pages: DataFrame) -> DataFrame:
    """(company, page_url, title, card, href, ord) of captured pages (``schemas.PAGES``). The first
    line of a link is its title, the whole text is its card."""
    links = extract_links(pages)
    return links.select(
        "company", F.col("url").alias("page_url"), first_line("text").alias("title"),
        F.col("text").alias("card"), "href", "ord",
    )
