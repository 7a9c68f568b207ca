"""Relations behind reports and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.normalise import score_band
from ..schema import POSTING_FIELDS
from .ordering import best_score_first_nulls_last, newest_first


def summary_table(df: DataFrame) -> DataFrame:
    return newest_first(df).select(*V.SUMMARY_COLUMNS)


def full_table(df: DataFrame) -> DataFrame:
    return newest_first(df).select(*[c for c in df.columns if c != "seq"])


def score_table(df: DataFrame) -> DataFrame:
    """By score, best first, unscored rows last."""
    return best_score_first_nulls_last(df).select(*V.SCORE_COLUMNS)


def primary_source(source: Column) -> Column:
    """First source of a merged one, lower-cased."""
    return F.lower(F.trim(F.get(F.split(F.coalesce(source, F.lit("")), r" \+ "), F.lit(0))))


def shown_url(url: Column) -> Column:
    """Link text of a URL: long ones are cut."""
    long = F.startswith(url, F.lit("http")) & (F.length(url) > 60)
    return F.when(long, F.concat(F.substring(url, 1, 57), F.lit("..."))).otherwise(url)


def report_attributes(df: DataFrame) -> DataFrame:
    """What the formatting of a report is derived from."""
    return df.select(
        "seq",
        primary_source(F.col("source")).alias("primary_source"),
        shown_url(F.col("job_url")).alias("url_text"),
        score_band(F.col("ai_score")).alias("score_band"),
    )


def display_table(df: DataFrame, scored: bool) -> DataFrame:
    """Result list on screen: title replaced by the link, score in front once scored."""
    columns = (["ai_score"] if scored else []) + V.DISPLAY_COLUMNS
    linked = df.withColumn("title", F.coalesce(F.col("job_url"), F.col("title")))
    return newest_first(linked).select(*columns)


def top_matches(df: DataFrame) -> DataFrame:
    names = {
        "Score": "ai_score", "Title": "title", "Company": "company", "Location": "location",
        "Written In": "listing_language", "Requires": "language_required",
        "AI Language": "ai_detected_language", "Reasoning": "ai_reasoning",
    }
    return df.select(*[F.col(column).alias(label) for label, column in names.items()])


def export_columns(df: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """The posting fields in order, with those of ``extras`` that are there."""
    return newest_first(df).select(*POSTING_FIELDS, *[c for c in extras if c in df.columns])
