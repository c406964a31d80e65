"""Endpoint answers of several shapes in one pass: parsed once to VARIANT, read by paths.

An answer takes the first shape whose list it holds, so one stage serves endpoints of any kind, and each record is
kept whole beside its fields: what no shape names can be read later without fetching again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import text_or
from postsieve.functions.urls import posting_url, resolve_links, site_base
from postsieve.sources import payloads as P


@dataclass(frozen=True)
class Shape:
    """Paths of the list of records in an answer, and of the fields in a record: ``$.jobs``, ``$.place.name``, ``$`` for the whole.

    ``below_site``: the address is the site of the endpoint followed by the path of the record. Otherwise it is a link
    as one found on the endpoint's page.
    """

    name: str
    records: str
    title: str
    location: str
    href: str
    below_site: bool = False

    def fields(self) -> set[str]:
        """Names of the fields of a record that the shape reads."""
        return {path.removeprefix("$").lstrip(".").split(".")[0] for path in (self.title, self.location, self.href)}


#: The shape that ``payloads.endpoint_rows`` reads.
LISTED = Shape("listed", f"$.{P.LIST_FIELD}", f"$.{P.TITLE_FIELD}", f"$.{P.LOCATION_FIELD}", f"$.{P.PATH_FIELD}", below_site=True)


def _by_shape(shapes: Sequence[Shape], value: Callable[[Shape], Column]) -> Column:
    """A value that depends on the shape a row has; NULL where it has none."""
    chosen = F.lit(None)
    for shape in reversed(shapes):
        chosen = F.when(F.col("shape") == shape.name, value(shape)).otherwise(chosen)
    return chosen


def shaped_rows(payloads: DataFrame, shapes: Sequence[Shape] = (LISTED,)) -> DataFrame:
    """(company, ok, title, location, href, url, ord, shape, record) of landed answers (``schemas.PAYLOADS``).

    Rows are those of ``payloads.endpoint_rows``: one a record, one without ``ord`` for an answer without records, and for a failed
    attempt one with ``ok`` false: text that is no JSON, or an endpoint without a site where the shape needs one. An answer that is read
    but has none of the shapes is no failure: it has no ``shape`` and no records. Missing fields are empty, numbers are their digits, lists and objects their JSON.

    ``record`` is the whole record as VARIANT. An object with a key twice makes its answer a failed one, unless
    ``spark.sql.variant.allowDuplicateKeys`` is set, as ``build_session`` does; then the last one counts.
    """
    if len({s.name for s in shapes}) < len(shapes):
        raise ValueError("two shapes have one name")
    read = payloads.select("company", "endpoint_url", F.try_parse_json("payload").alias("_answer"))

    def found(shape: Shape) -> Column:
        return F.try_variant_get("_answer", shape.records, "array<variant>")

    named = read.withColumn("shape", F.coalesce(*[F.when(found(s).isNotNull(), F.lit(s.name)) for s in shapes]))
    lists = named.select(
        "company", "endpoint_url", "shape", F.col("_answer").isNotNull().alias("_read"), site_base("endpoint_url").alias("_site"),
        _by_shape(shapes, found).alias("_records"),
    )
    sited = F.coalesce(_by_shape(shapes, lambda s: F.lit(s.below_site)), F.lit(LISTED in shapes and len(shapes) == 1))
    checked = lists.withColumn("ok", F.col("_read") & (~sited | F.col("_site").isNotNull()))
    rows = checked.select(
        "company", "endpoint_url", "shape", "ok", "_site",
        F.posexplode_outer(F.when(F.col("ok"), F.col("_records"))).alias("ord", "record"),
    )

    def field(path: Callable[[Shape], str]) -> Column:
        return text_or(_by_shape(shapes, lambda s: F.try_variant_get("record", path(s), "string")))

    rows = rows.withColumns({
        "title": field(lambda s: s.title), "location": field(lambda s: s.location), "href": field(lambda s: s.href),
        "ord": F.col("ord").cast("bigint"),
    })
    if not all(s.below_site for s in shapes):
        rows = resolve_links(rows, "endpoint_url", "href", "_link")
    else:
        rows = rows.withColumn("_link", F.col("href"))
    below = _by_shape(shapes, lambda s: F.lit(s.below_site))
    url = F.when(below, posting_url("_site", "href")).when(~below, F.col("_link"))
    return rows.select("company", "ok", "title", "location", "href", url.alias("url"), "ord", "shape", "record")


def unread_fields(rows: DataFrame, shapes: Sequence[Shape] = (LISTED,)) -> DataFrame:
    """(shape, field, n) of ``shaped_rows``: how many records hold a field that their shape does not read. A change of an
    endpoint shows here before its rows are missed. Names are counted; their values stay in ``record``."""
    names = F.map_keys(F.try_variant_get("record", "$", "map<string, variant>"))
    read = _by_shape(shapes, lambda s: F.array(*[F.lit(f) for f in sorted(s.fields())]))
    others = rows.select("shape", F.explode(F.array_except(names, read)).alias("field"))
    return others.groupBy("shape", "field").agg(F.count("*").alias("n"))
