"""Row filters. The ``*_condition`` functions give the bare predicate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.keys import url_host
from ..functions.language import UNKNOWN
from ..functions.platforms import is_job_url
from ..functions.salary import salary_missing
from ..functions.text import blank_to_null, contains_any, let, lowered, strip


def date_condition(hours_old: int | None, as_of: dt.datetime) -> Column:
    """No date, or not older than the look-back; without a look-back under a year, anything.

    Dates are compared as text, so text that is no date stays whenever it sorts later.
    """
    if not hours_old or hours_old >= V.HOURS_IN_YEAR:
        return F.lit(True)
    cutoff = (as_of - dt.timedelta(hours=hours_old)).strftime("%Y-%m-%d")
    # one reference to the column: a filter over a computed date repeats the computation
    return F.coalesce(F.nullif(F.col("date_posted"), F.lit("")), F.lit(cutoff)) >= cutoff


def by_date(df: DataFrame, hours_old: int | None, as_of: dt.datetime) -> DataFrame:
    return df.filter(date_condition(hours_old, as_of))


def asked_language() -> Column:
    return F.coalesce(blank_to_null(F.col("language_required")), F.col("language"), F.lit(UNKNOWN))


def required_language_condition(wanted: str | None) -> Column:
    """The required language suits the wanted one; "All" or none asks for nothing."""
    if not wanted or wanted == "All":
        return F.lit(True)
    asked, plus = asked_language(), "English (German plus)"
    if wanted == "English":
        short = F.length(strip(F.coalesce(F.col("description"), F.lit("")))) < 50
        return asked.isin("English", plus) | ((asked == UNKNOWN) & short)
    if wanted == plus:
        return asked == plus
    if wanted == "German":
        return asked.isin("German", plus)
    return asked.isin(wanted, UNKNOWN)


def by_required_language(df: DataFrame, wanted: str | None) -> DataFrame:
    return df.filter(required_language_condition(wanted))


def by_listing_language(df: DataFrame, wanted: str | None) -> DataFrame:
    """Rows written in the wanted language or in an unknown one."""
    if not wanted or wanted == "All":
        return df
    return df.filter(F.col("listing_language").isin(wanted, UNKNOWN))


def remote_condition() -> Column:
    """Flagged as remote, or called so in location or title."""
    return (
        F.coalesce(F.col("is_remote"), F.lit(False))
        | contains_any(lowered(F.col("location")), V.REMOTE_LOCATION_WORDS)
        | F.contains(lowered(F.col("title")), F.lit("remote"))
    )


def blocked_remote_condition() -> Column:
    """The location restricts the posting to an excluded country."""
    return contains_any(lowered(F.col("location")), V.BLOCKED_REMOTE)


def remote_jobs(df: DataFrame) -> DataFrame:
    return df.filter(remote_condition())


def blocked_remote(df: DataFrame) -> DataFrame:
    return df.filter(blocked_remote_condition())


def location_scope_condition(scope: list[str] | None) -> Column:
    """The posting is within the search scope; no scope admits all.

    Remote postings stay unless restricted to an excluded country. Others stay without a real
    location, with a scope place (or a city of a scope country) in it, in Germany whatever
    the scope, in India if that is in scope, and anywhere once the scope has several places.
    """
    if not scope:
        return F.lit(True)
    places = [place.lower() for place in scope]
    for country, cities in V.CITIES_OF_SCOPE.items():
        if country in places:
            places = places + cities
    location = lowered(F.col("location"))
    verdict = (
        F.when(remote_condition(), ~blocked_remote_condition())
        .when(F.length(strip(location)) < 2, True)
        .when(contains_any(location, places), True)
        .when(contains_any(location, V.GERMANY_MARKERS), True)
    )
    if "india" in places:
        verdict = verdict.when(contains_any(location, V.INDIA_MARKERS), True)
    return verdict.otherwise(len(scope) > 1)


def by_location_scope(df: DataFrame, scope: list[str] | None) -> DataFrame:
    return df.filter(location_scope_condition(scope))


def by_location_text(df: DataFrame, location: str | None) -> DataFrame:
    """The location contains the text."""
    if not location:
        return df
    return df.filter(F.contains(lowered(F.col("location")), F.lit(location.lower())))


def by_location_or_remote(df: DataFrame, places: list[str]) -> DataFrame:
    """The location contains a place or the word "remote"."""
    if not places:
        return df
    return df.filter(contains_any(lowered(F.col("location")), [p.lower() for p in places] + ["remote"]))


def by_location_places(df: DataFrame, places: list[str]) -> DataFrame:
    """The location contains a place; remote postings are no exception."""
    if not places:
        return df
    return df.filter(contains_any(lowered(F.col("location")), [p.lower().strip() for p in places]))


def by_location_or_worldwide(df: DataFrame, places: list[str]) -> DataFrame:
    """The location contains a place or the word "worldwide"."""
    if not places:
        return df
    return by_location_places(df, places + ["worldwide"])


def valid_job_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """URLs of postings, without social media, aggregators and the like."""
    return df.filter(is_job_url(F.col(url)))


def released_within(df: DataFrame, released: str, as_of: dt.datetime, days: int = V.MAX_RELEASE_AGE_DAYS) -> DataFrame:
    """Rows released in the last days; a release time that cannot be read is no reason to drop.

    An offset in the text is dropped, not applied: wall-clock times are compared.
    """
    wall_clock = F.regexp_replace(F.col(released), r"(Z|[+-]\d{2}:?\d{2})$", "")
    when = wall_clock.try_cast("timestamp_ntz")
    cutoff = F.lit((as_of - dt.timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return df.filter(F.coalesce(when >= cutoff, F.lit(True)))


def needs_salary_estimate(df: DataFrame) -> DataFrame:
    return df.filter(salary_missing(F.col("salary_min"), F.col("salary_max")))


def needs_ai_language(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.length("ai_detected_language"), F.lit(0)) == 0)


def career_signal_count(html: Column) -> Column:
    """How many of the phrases of careers pages a page has."""
    def count(text: Column) -> Column:
        return sum((F.contains(text, F.lit(signal)).cast("int") for signal in V.CAREER_SIGNALS), F.lit(0))

    return let(F.lower(html), count)


def career_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Pages with at least two phrases of a careers page."""
    return df.filter(career_signal_count(F.col(html)) >= V.MIN_CAREER_SIGNALS)


def crawlable_hosts(df: DataFrame, url: str) -> DataFrame:
    """Rows with the host of an http URL that is not a known job board, as ``domain``."""
    return df.withColumn("domain", url_host(F.col(url))).filter(
        F.col("domain").isNotNull() & ~contains_any(F.col("domain"), V.KNOWN_BOARD_DOMAINS)
    )


def tracker_with_status(df: DataFrame, status: str | None) -> DataFrame:
    """Applications of one status; no status or an unknown one means all."""
    return df.filter(F.col("status") == status) if status in V.TRACKER_STATUSES else df


def optional_job_type(df: DataFrame, job_type: str | None) -> DataFrame:
    """The type argument of a board search; "any" is none."""
    return df if not job_type or job_type.lower() == "any" else df.filter(F.col("job_type") == job_type.lower())
