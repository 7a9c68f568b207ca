"""Counts and key figures. All are partial aggregations, so hot keys are combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.keys import url_host
from ..functions.platforms import clean_url
from ..functions.text import blank_to_null, contains_any, strip
from .filters import asked_language


def source_parts(source: Column) -> Column:
    """The single sources of a merged source such as ``a + b``."""
    return F.transform(F.split(source, r" \+ "), strip)


def _exploded_sources(df: DataFrame) -> DataFrame:
    return df.select(
        F.explode(source_parts(F.coalesce(F.col("source"), F.lit("unknown")))).alias("source")
    )


def by_source(df: DataFrame) -> DataFrame:
    return _exploded_sources(df).groupBy("source").agg(F.count("*").alias("n"))


def sources_used(df: DataFrame) -> DataFrame:
    return _exploded_sources(df).distinct().agg(F.count("*").alias("sources_used"))


def by_language(df: DataFrame) -> DataFrame:
    return df.groupBy(asked_language().alias("language")).agg(F.count("*").alias("n"))


def key_figures(df: DataFrame) -> DataFrame:
    asked = asked_language()
    return df.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(asked.isin("English", "English (German plus)")).alias("english_ok_jobs"),
        F.count_if(asked == "German").alias("german_jobs"),
    )


def listing_language_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("listing_language").agg(F.count("*").alias("n"))


def required_language_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("language_required").agg(F.count("*").alias("n"))


def chart(counts: DataFrame, label: str) -> DataFrame:
    """Counts ascending, as charts show them."""
    return counts.orderBy(F.col("n").asc(), F.col(label).asc())


def tracker_stats(applications: DataFrame) -> DataFrame:
    """Applications per status, with the total as a row of its own."""
    return (
        applications.rollup("status")
        .agg(F.count("*").alias("n"), F.grouping("status").alias("_all"))
        .select(F.when(F.col("_all") == 1, "total").otherwise(F.col("status")).alias("status"), "n")
    )


def registry_by_platform(registry: DataFrame) -> DataFrame:
    return (
        registry.groupBy(F.coalesce(F.col("ats"), F.lit("unknown")).alias("ats"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("ats").asc())
    )


def url_classes(classified: DataFrame) -> DataFrame:
    return classified.groupBy("platform").agg(F.count("*").alias("n"))


def feed_yield(df: DataFrame, feed: str = "source", company: str = "company") -> DataFrame:
    """Rows and companies with rows per feed; companies are counted after one distinct pass."""
    per_company = df.groupBy(feed, company).agg(F.count("*").alias("_n"))
    return per_company.groupBy(feed).agg(
        F.sum("_n").alias("n_rows"), F.count(company).alias("n_companies")
    )


def filter_effect(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows before, kept and removed per filter, in one pass over the data."""
    before, counts = F.lit(True), [F.count("*").alias("_c0")]
    for i, (_, condition) in enumerate(stages, 1):
        before = before & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(before).alias(f"_c{i}"))
    totals = df.agg(*counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("stage"),
                F.col(f"_c{i - 1}").alias("before"),
                F.col(f"_c{i}").alias("kept"),
                (F.col(f"_c{i - 1}") - F.col(f"_c{i}")).alias("removed"),
            )
            for i, (name, _) in enumerate(stages, 1)
        ]
    )
    return totals.select(F.inline(rows))


def merged_sources(df: DataFrame, group: str) -> DataFrame:
    """Sorted union of the sources of each group, joined again."""
    parts = df.filter(F.length("source") > 0).select(
        group, F.explode(source_parts(F.col("source"))).alias("part")
    )
    return (
        parts.distinct()
        .groupBy(group)
        .agg(F.array_join(F.array_sort(F.collect_list("part")), V.SOURCE_SEPARATOR).alias("source"))
    )


def distinct_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Distinct cleaned URLs with the position at which each was first seen."""
    cleaned = df.select(clean_url(F.col(url)).alias("url"), "seq").filter(F.length("url") > 0)
    return cleaned.groupBy("url").agg(F.min("seq").alias("first_seq"))


def distinct_domains(df: DataFrame) -> DataFrame:
    """Company hosts of postings, known job boards left out."""
    hosts = df.select(F.explode(F.array("company_url", "job_url")).alias("url")).select(
        url_host(F.col("url")).alias("domain")
    )
    return hosts.filter(
        F.col("domain").isNotNull() & ~contains_any(F.col("domain"), V.KNOWN_BOARD_DOMAINS)
    ).distinct()


def monthly_usage(queries: DataFrame, when: str = "ts", count: str | None = None) -> DataFrame:
    """Queries used per month and what the monthly quota leaves."""
    used = F.sum(count) if count else F.count("*")
    return (
        queries.groupBy(F.date_format(when, "yyyy-MM").alias("month"))
        .agg(used.cast("bigint").alias("used"))
        .withColumn("remaining", F.greatest(F.lit(V.MONTHLY_QUERY_QUOTA) - F.col("used"), F.lit(0)))
    )


def pending_ai_language(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(blank_to_null(F.col("ai_detected_language")).isNull()).alias("pending"))
