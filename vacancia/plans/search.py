"""The whole search, from mapped feeds to the sorted result."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import language as L
from ..operators import filters as FL
from ..operators.normalize import normalize_postings, relabel_source
from ..operators.ordering import newest_first
from ..operators.companies import learn_companies
from ..operators.resolve import resolve, resolve_new
from ..operators.search import all_words
from ..schema import conform_schema
from ..session import TableSpool
from ..sources.common import ROWS_PER_FEED, union_feeds


@dataclass(frozen=True)
class SearchOptions:
    """Parameters of a run. ``as_of`` stands for the time of the search."""

    as_of: dt.datetime
    hours_old: int | None = None
    language: str | None = None
    listing_language: str | None = None
    locations: list[str] = field(default_factory=list)
    fuzzy: bool = True


def detect_languages(df: DataFrame) -> DataFrame:
    """Fill the written and the required language; ``language`` repeats the latter.

    The written language feeds the rules for the required one, so it is a projection of its
    own and computed once.
    """
    written = df.withColumn("listing_language", L.listing_language(F.col("description")))
    return written.withColumn(
        "language_required",
        L.language_required(F.col("description"), F.col("title"), F.col("listing_language")),
    ).withColumn("language", F.col("language_required"))


def classify_postings(feeds: DataFrame, options: SearchOptions) -> DataFrame:
    """Normalised postings within the look-back and the places, with their languages.

    The filters that need no language come first, the languages cost most.
    """
    recent = FL.by_date(normalize_postings(feeds), options.hours_old, options.as_of)
    return detect_languages(FL.by_location_scope(recent, options.locations))


def select_postings(classified: DataFrame, options: SearchOptions) -> DataFrame:
    """Classified postings that suit the languages of the search.

    Languages are filtered before duplicates are merged, since merging first would give other
    results.
    """
    df = FL.by_required_language(classified, options.language)
    return FL.by_listing_language(df, options.listing_language)


def resolved_search(feeds: DataFrame, options: SearchOptions) -> DataFrame:
    """One row per distinct posting that suits the search.

    The classified postings are written to a table once. Filters on the languages would
    otherwise be pushed below their detection and repeat it; over the table they are pushed
    into the scan instead.
    """
    classified = TableSpool(feeds.sparkSession, "search").cut(classify_postings(feeds, options), "classified")
    return resolve(select_postings(classified, options), options.fuzzy, stored=True)


def search(feeds: DataFrame, options: SearchOptions) -> DataFrame:
    """One row per distinct posting, newest first."""
    return newest_first(resolved_search(feeds, options))


def matching_crawled(crawled: DataFrame, terms: list[str], places: list[str]) -> DataFrame:
    """Crawled postings that match the search, marked as such."""
    return relabel_source(FL.by_location_or_remote(all_words(crawled, terms), places), "career_crawler")


def add_crawled(merged: DataFrame, crawled: DataFrame, after: int, fuzzy: bool = True) -> DataFrame:
    """Merged postings with crawled ones merged in; see ``resolve_new``.

    ``after`` is a row number that no merged posting exceeds; crawled ones come behind it.
    """
    behind = conform_schema(crawled).withColumn("seq", F.col("seq") + F.lit(after).cast("bigint") + 1)
    return resolve_new(conform_schema(merged), behind, fuzzy)


@dataclass(frozen=True)
class SearchResult:
    """Postings, newest first, and the companies that the registry lacked."""

    postings: DataFrame
    companies: DataFrame


def run_search(
    feeds: list[DataFrame],
    crawled: DataFrame,
    registry: DataFrame,
    options: SearchOptions,
    terms: list[str],
    places: list[str],
) -> SearchResult:
    """A whole run: feeds united, classified, filtered and resolved; crawled postings that match added
    to what was found, and companies learnt from the postings of the result.

    What the feeds gave is written once: crawled postings are searched in it, and companies learnt.
    """
    spool = TableSpool(crawled.sparkSession, "run")
    found = spool.cut(resolved_search(union_feeds(feeds), options), "found")
    last = len(feeds) * ROWS_PER_FEED - 1
    postings = spool.cut(add_crawled(found, matching_crawled(crawled, terms, places), last, options.fuzzy), "postings")
    return SearchResult(newest_first(postings), learn_companies(postings, registry, options.as_of.strftime("%Y-%m-%d")))
