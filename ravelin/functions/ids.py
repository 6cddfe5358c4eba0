"""Deterministic identifiers: name-based UUIDs, digests, document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the UUID namespace of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_SHAPE = r"^[a-z0-9-]+--[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace; null of null."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.lit(1) + (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4), F.lit(1))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), F.concat_ws("-", *parts))


def indicator_id(pattern: Column, *known: Column) -> tuple[Column, Column]:
    """The first well-formed known id, else one made from the pattern; and which of the two it is."""
    given = F.coalesce(*[F.when(k.rlike(_SHAPE), k) for k in known], F.lit(None).cast("string"))
    return F.coalesce(given, F.concat(F.lit("indicator--"), uuid5(pattern))), F.when(given.isNull(), "derived").otherwise("platform")


def report_id(landing: Column) -> Column:
    return F.concat(F.lit("report--"), uuid5(landing))


def pattern_key(pattern: Column) -> Column:
    """The key under which a pattern counts as seen."""
    return F.sha2(pattern.cast("binary"), 256)


def document_key(landing: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("\n", landing, url).cast("binary"), 256)


def generic_document_key(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("generic\n"), name).cast("binary"), 256)
