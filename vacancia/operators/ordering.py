"""Sorts, limits that are features, and row numbers over everything.

Every order ends in ``seq``, so that results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import blank_to_null
from ..session import TableSpool


def date_key() -> Column:
    """Sort key of the date; missing dates sort before any date."""
    return F.coalesce(blank_to_null(F.col("date_posted")), F.lit("0000-00-00"))


def newest_first(df: DataFrame) -> DataFrame:
    """By date, newest first, undated last; earlier rows first within a date."""
    return df.orderBy(date_key().desc(), F.col("seq").asc())


def best_score_first(df: DataFrame) -> DataFrame:
    """By score, a missing score counting as zero."""
    return df.orderBy(F.coalesce(F.col("ai_score"), F.lit(0)).desc(), F.col("seq").asc())


def best_score_first_nulls_last(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("ai_score").desc_nulls_last(), F.col("seq").asc())


def with_positions(ordered: DataFrame) -> DataFrame:
    """Add ``row_index``: the 0-based position of each row of a sorted frame.

    Positions over a whole table without one task seeing the whole table: a sorted frame consists of
    ranges of the order, rows are numbered within those, and only the sizes of the ranges, one number
    per partition, are added up. The numbered rows are written once, because range bounds are
    sampled and must not be drawn twice. Nothing is sorted again: the files are the order, and
    ``row_index`` says it.
    """
    # the number is the partition in the upper bits and the position within it in the lower 33
    numbered = TableSpool(ordered.sparkSession, "index").cut(
        ordered.withColumn("_number", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("_number", 33).alias("_part")
    sizes = numbered.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_index", F.col("_offset") + F.col("_number").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_number", "_offset")
    )


def global_index(df: DataFrame, major: Column | None = None) -> DataFrame:
    """Add ``row_index``: 0-based position by ``major`` descending (if given), then ``seq``.

    Ranges are balanced whatever the values of ``major``, since ``seq`` is part of the order.
    """
    order = [F.col("seq").asc()] if major is None else [major.desc(), F.col("seq").asc()]
    return with_positions(df.orderBy(*order))


def with_batches(df: DataFrame, size: int = V.MODEL_BATCH) -> DataFrame:
    """Add ``batch_id`` and ``idx``, the position within the batch, by ``seq``."""
    return (
        global_index(df)
        .withColumn("batch_id", F.floor(F.col("row_index") / size).cast("bigint"))
        .withColumn("idx", (F.col("row_index") % size).cast("int"))
        .drop("row_index")
    )


def with_pages(df: DataFrame, size: int = V.PAGE_SIZE) -> DataFrame:
    """Add ``page``, counted from 1, in the order of the result list (newest first)."""
    return (
        with_positions(newest_first(df))
        .withColumn("page", (F.floor(F.col("row_index") / size) + 1).cast("bigint"))
        .drop("row_index")
    )


def page(df: DataFrame, number: int, size: int = V.PAGE_SIZE) -> DataFrame:
    return with_pages(df, size).filter(F.col("page") == number)


def recent_companies(registry: DataFrame, n: int = V.RECENT_COMPANIES) -> DataFrame:
    return registry.orderBy(F.col("discovered_date").desc_nulls_last(), "ats", "slug").limit(n)


def latest_applications(applications: DataFrame, n: int = V.TRACKED_SHOWN) -> DataFrame:
    return applications.orderBy(F.col("updated_at").desc(), "job_url").limit(n)


def first_per_platform(companies: DataFrame, n: int = V.COMPANIES_PER_PLATFORM) -> DataFrame:
    """At most ``n`` companies of each platform, by slug.

    Spark keeps the first ``n`` of a platform per map task already, before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("ats").orderBy("slug"))
    return companies.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def first_urls(urls: DataFrame, n: int = V.GENERIC_URLS) -> DataFrame:
    return urls.orderBy("seq").limit(n)


def first_domains(domains: DataFrame, n: int = V.CRAWL_DOMAINS) -> DataFrame:
    return domains.orderBy("domain").limit(n)


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """(key, seq of its first row): the leader of rows that share a key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("first_seq"))
