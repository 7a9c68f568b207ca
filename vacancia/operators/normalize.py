"""From loosely typed rows to clean postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import normalise as N
from ..functions.text import (
    collapse_spaces,
    is_blank,
    strip,
    title_case,
    title_case_if_lower,
)
from ..schema import POSTING_FIELDS, REQUIRED_FIELDS, conform_schema


def _has_required() -> Column:
    ok = F.lit(True)
    for name in REQUIRED_FIELDS:
        ok = ok & ~is_blank(F.col(name).cast("string"))
    return ok


def require_fields(df: DataFrame) -> DataFrame:
    """Rows with a title and a URL."""
    return df.filter(_has_required())


def rejected_rows(df: DataFrame) -> DataFrame:
    """What ``require_fields`` drops."""
    return df.filter(~_has_required())


def coerce_types(df: DataFrame) -> DataFrame:
    """Give every posting field its type; a value that cannot be converted becomes null.

    Text is read as a boolean the way SQL reads it, so "false" is false.
    """
    have = dict(df.dtypes)
    changed = {}
    for name, kind in POSTING_FIELDS.items():
        if name not in have or have[name] == kind.simpleString():
            continue
        column = F.col(name)
        if isinstance(kind, T.IntegerType):
            column = column.try_cast("double")
        changed[name] = column.try_cast(kind)
    return df.withColumns(changed) if changed else df


def normalize(df: DataFrame) -> DataFrame:
    """The whole-row normalisation, as one projection.

    Every step is total, so no row can fail and none needs a fallback.
    """
    title = collapse_spaces(F.col("title"))
    location = collapse_spaces(F.col("location"))
    clean = {
        "source": F.lower(strip(F.col("source"))),
        "ats_platform": F.lower(strip(F.col("ats_platform"))),
        "title": title,
        "company": collapse_spaces(F.col("company")),
        "location": title_case_if_lower(location),
        "country": title_case(strip(F.col("country"))),
        "date_posted": N.parse_date(F.col("date_posted")),
        "job_type": N.job_type(F.col("job_type")),
        "experience_level": F.coalesce(
            F.when(F.length("experience_level") > 0, F.col("experience_level")),
            N.experience_level(title, F.col("description")),
        ),
        "salary_currency": F.upper(strip(F.col("salary_currency"))),
        "salary_interval": F.lower(strip(F.col("salary_interval"))),
        "job_url": strip(F.col("job_url")),
        "company_url": strip(F.col("company_url")),
    }
    return df.withColumns(clean)


def normalize_postings(df: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Conform, require, coerce and normalise."""
    return normalize(coerce_types(require_fields(conform_schema(df, keep))))


def relabel_source(df: DataFrame, label: str) -> DataFrame:
    """Mark rows as found by discovery or by the crawler."""
    return df.withColumn("source", F.lit(label))


def relabel_workday(df: DataFrame, default_company: Column) -> DataFrame:
    """Discovery rows of Workday sites; the site's name stands in for a missing company."""
    company = F.when(F.length("company") > 0, F.col("company")).otherwise(default_company)
    return df.withColumns(
        {"source": F.lit("ats_discovery"), "ats_platform": F.lit("workday"), "company": company}
    )
