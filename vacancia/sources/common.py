"""What the mappers of landed payloads share.

A payload frame has ``seq`` (ingest order), ``company_slug`` and ``payload``. A mapper gives
one row per posting: ``seq`` and the 25 fields. Positions within a payload are part of the new
``seq``, so that feeds can be put in order after mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, slug_to_name
from ..schema import posting_columns

#: postings per payload that a row number has room for
ITEMS_PER_PAYLOAD = 1 << 24
#: rows per feed that a row number has room for, see ``union_feeds``
ROWS_PER_FEED = 1 << 58

DISCOVERY = "ats_discovery"


def explode_items(raw: DataFrame, items: Column) -> DataFrame:
    """One row per item of a payload, with the item as ``item``."""
    return raw.select("*", F.posexplode(items).alias("_pos", "item")).withColumn(
        "seq",
        _within("seq", ROWS_PER_FEED // ITEMS_PER_PAYLOAD) * ITEMS_PER_PAYLOAD + _within("_pos", ITEMS_PER_PAYLOAD),
    )


def _within(name: str, room: int) -> Column:
    """A number that has a room of its own; beyond it rows would share their numbers, so the run stops."""
    number = F.col(name)
    says = F.concat(F.lit(f"{name} must be from 0 to {room - 1}, number the payloads anew (global_index): "), number.cast("string"))
    return F.when(number.isNull() | number.between(0, room - 1), number).otherwise(F.raise_error(says))


def to_postings(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.select("seq", *posting_columns(values))


def platform_values(platform: str) -> dict[str, Column]:
    return {
        "source": F.lit(DISCOVERY),
        "ats_platform": F.lit(platform),
        "company": slug_to_name(F.col("company_slug")),
    }


def iso_day(*candidates: Column) -> Column:
    """First ten characters of the first filled time stamp."""
    return F.left(F.coalesce(*[blank_to_null(c) for c in candidates]), F.lit(10))


def name_or_text(v: Column) -> Column:
    """A variant that is either text or an object with a name."""
    is_text = F.schema_of_variant(v) == "STRING"
    return F.when(is_text, F.try_variant_get(v, "$", "string")).otherwise(
        F.try_variant_get(v, "$.name", "string")
    )


def join_filled(parts: list[Column], separator: str) -> Column:
    """Parts that have text, joined; null if none has."""
    filled = F.filter(F.array(*parts), lambda p: F.length(p) > 0)
    return F.when(F.size(filled) > 0, F.array_join(filled, separator))


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """All feeds in one frame; ``seq`` orders them feed by feed as given.

    A number outside its feed's room stops the run, since rows of two feeds would share it.
    """
    if len(feeds) > (1 << 63) // ROWS_PER_FEED:
        raise ValueError(f"{len(feeds)} feeds, but row numbers have room for {(1 << 63) // ROWS_PER_FEED}")
    placed = [
        df.withColumn("seq", F.lit(place).cast("bigint") * ROWS_PER_FEED + _within("seq", ROWS_PER_FEED))
        for place, df in enumerate(feeds)
    ]
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
