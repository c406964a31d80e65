"""Addresses: parts, host for display, site base, relative links.

All columns are built-in expressions. Parts follow RFC 3986 appendix B, with the scheme
restricted to the characters a scheme may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import as_column, text_or

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"
_PARTS = f"^(?:({_SCHEME}):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#([\\s\\S]*))?$"
_SCHEME_PART, _HOST_PART, _PATH_PART, _QUERY_PART, _FRAGMENT_PART = range(1, 6)

# Blanks and control characters browsers drop from the left end, and from anywhere.
_LEADING = "".join(chr(c) for c in range(0x21))


def clean(url: Column | str) -> Column:
    """Drop leading blanks and controls, and tabs and line breaks wherever they are."""
    return F.ltrim(F.translate(as_column(url), "\t\r\n", ""), F.lit(_LEADING))


def _part(url: Column, which: int) -> Column:
    part = F.regexp_extract(url, _PARTS, which)
    return F.lower(part) if which == _SCHEME_PART else part


def host_of(url: Column | str) -> Column:
    """Authority with every "www." removed; user and port stay, no authority gives ""."""
    raw = text_or(url)
    host = F.replace(_part(clean(raw), _HOST_PART), F.lit("www."), F.lit(""))
    unbalanced = F.contains(raw, F.lit("[")) != F.contains(raw, F.lit("]"))
    return F.when(unbalanced, raw).otherwise(host)


def site_base(endpoint: Column | str) -> Column:
    """scheme://authority/next-to-last path segment; NULL where the path has fewer than two."""
    url = clean(endpoint)
    segments = F.split(F.rtrim(_part(url, _PATH_PART), F.lit("/")), "/")
    site = F.try_element_at(segments, F.lit(-2))
    return F.concat(_part(url, _SCHEME_PART), F.lit("://"), _part(url, _HOST_PART), F.lit("/"), site)


def posting_url(base: Column | str, path: Column | str) -> Column:
    return F.concat(as_column(base), text_or(path))


def _tail(query: Column, fragment: Column) -> Column:
    return F.concat(
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _split_parts(url: Column) -> Column:
    """[scheme, authority, path, query, fragment] from one run of the pattern."""
    mark = "\u0001"
    marked = F.regexp_replace(F.translate(clean(url), mark, ""), _PARTS, mark.join(f"${i}" for i in range(1, 6)))
    return F.split(marked, mark)


def _fold_dots(segments: Column) -> Column:
    """Apply "." and ".." to a list of path segments."""
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.array_append(done, s)),
    )


def _fold_path(path: Column) -> Column:
    """Fold "." and ".." of a path; a path that ends in one of them ends in a slash."""
    closed = F.regexp_replace(path, "(^|/)(\\.\\.?)$", "$1$2/")
    folded = F.array_join(_fold_dots(F.split(closed, "/")), "/")
    return F.when(F.startswith(folded, F.lit("/")), folded).otherwise(F.concat(F.lit("/"), folded))


def resolve_links(df: DataFrame, base: str, href: str, out: str = "url") -> DataFrame:
    """Add ``out``: the absolute address of ``href`` found in the page ``base``; an empty link is the
    page itself.

    A link with the scheme of the page but no authority counts as relative, and an address
    that is already absolute keeps its path as written. Parts are taken once per row and kept
    in columns; the list functions run only for paths with something to fold.
    """
    b, h = F.col("_base_parts"), F.col("_href_parts")
    b_scheme, b_host, b_path, b_query = F.lower(b[0]), b[1], b[2], b[3]
    h_scheme, h_host, h_path, h_query, h_fragment = F.lower(h[0]), h[1], h[2], h[3], h[4]

    rooted = F.startswith(h_path, F.lit("/"))
    folder = F.regexp_replace(b_path, "[^/]*$", "")
    in_folder = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h_path), "/{2,}", "/")
    path = F.col("_path")
    slashed = F.when((h_path == "") | rooted, h_path).otherwise(F.concat(F.lit("/"), h_path))
    origin = F.concat(b_scheme, F.lit("://"), b_host)
    own_query = F.when(h_query != "", h_query).otherwise(b_query)
    link, page = text_or(href), text_or(base)
    url = (
        F.when(link == "", page)
        .when(page == "", link)
        .when((h_scheme != "") & (h_scheme != b_scheme), link)
        .when(h_host != "", F.concat(b_scheme, F.lit("://"), h_host, slashed, _tail(h_query, h_fragment)))
        .when(h_path == "", F.concat(origin, b_path, _tail(own_query, h_fragment)))
        .when(path.rlike("(?:^|/)\\.\\.?(?:/|$)"), F.concat(origin, _fold_path(path), _tail(h_query, h_fragment)))
        .otherwise(F.concat(origin, path, _tail(h_query, h_fragment)))
    )
    return (
        df.withColumns({"_base_parts": _split_parts(page), "_href_parts": _split_parts(link)})
        .withColumn("_path", F.when(rooted, h_path).otherwise(in_folder))
        .withColumn(out, url)
        .drop("_base_parts", "_href_parts", "_path")
    )
