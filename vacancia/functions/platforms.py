"""Hiring platforms and companies out of URLs and pages."""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import (
    UNICODE,
    blank_to_null,
    contains_any,
    let,
    long_contains_any,
    lowered,
    slug_to_name,
    strip,
    title_case,
)


def _first_match(c: Column, rules: Iterable[tuple[str, str]], fold_case: bool = False) -> tuple[Column, Column]:
    """(name, captured group) of the first pattern that is found; both null without any."""
    flags = "(?iuU)" if fold_case else UNICODE
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    slug = name
    for platform, pattern in rules:
        found = c.rlike(flags + pattern)
        captures = re.compile(pattern).groups > 0
        name = name.when(found, F.lit(platform))
        slug = slug.when(found, F.regexp_extract(c, flags + pattern, 1) if captures else F.lit(None).cast("string"))
    return name, slug


def registry_platform(url: Column) -> tuple[Column, Column]:
    """(platform, company slug) of a posting URL on a platform with company boards."""
    return _first_match(url, V.REGISTRY_URL_PATTERNS.items())


def router_platform(url: Column) -> tuple[Column, Column]:
    """(platform, slug) that decides how a discovered URL is fetched; "generic" if none."""
    name, slug = _first_match(url, V.ROUTER_URL_PATTERNS.items())
    return F.coalesce(name, F.lit("generic")), slug


def page_platform(text: Column) -> tuple[Column, Column]:
    """(platform, slug) named anywhere in a URL or page, in any case.

    The whole text is searched. Pages that name no platform domain, the bulk of them, are
    recognised by plain substring search.
    """
    named = long_contains_any(lowered(text), V.CRAWLER_LITERALS)
    name, slug = _first_match(text, V.CRAWLER_PATTERNS, fold_case=True)
    return F.when(named, name), F.when(named, slug)


def workday_parts(url: Column) -> Column:
    """Struct(company, number, board, external_path) of a Workday URL, else null.

    A leading locale such as ``en-US`` is not the board; everything from ``/job/`` on is the
    external path.
    """
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^https?://([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    host_shape = UNICODE + r"^([\w-]+)\.wd(\d+)\.myworkdayjobs\.com"
    segments = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    board = F.when(first.rlike(r"^[a-z]{2}(-[A-Z]{2})?$") & second.isNotNull(), second).otherwise(first)
    parts = F.struct(
        F.regexp_extract(host, host_shape, 1).alias("company"),
        F.regexp_extract(host, host_shape, 2).alias("number"),
        board.alias("board"),
        blank_to_null(F.regexp_extract(path, r"(/job/.+)$", 1)).alias("external_path"),
    )
    return F.when(host.rlike(host_shape) & first.isNotNull(), parts)


def _segments(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    return F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)


def spaced_title(slug: Column) -> Column:
    return title_case(F.regexp_replace(slug, r"[-_]", " "))


def company_from_host(url: Column) -> Column:
    """First label of the host without ``www.``, as a name."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#:]*)", 1))
    return spaced_title(F.element_at(F.split(F.replace(host, F.lit("www."), F.lit("")), r"\."), 1))


def generic_title_from_url(url: Column) -> Column:
    """Last path segment that is longer than three characters and not a number, as a title."""
    usable = F.filter(_segments(url), lambda s: (F.length(s) > 3) & ~s.rlike(r"^[0-9]+$"))
    return spaced_title(F.try_element_at(usable, F.lit(-1)))


def workday_title_from_url(url: Column) -> Column:
    """Last path segment that is neither ``job``, a locale nor a number, as a title."""
    usable = F.filter(
        _segments(url), lambda s: ~s.isin("job", "en-US", "de-DE") & ~s.rlike(r"^[0-9]+$")
    )
    return spaced_title(F.try_element_at(usable, F.lit(-1)))


def workday_company_from_host(url: Column) -> Column:
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^https?://([^/?#:]*)", 1))
    return slug_to_name(blank_to_null(F.regexp_extract(host, UNICODE + r"^([\w-]+)\.wd\d+", 1)))


def personio_company_from_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))
    return slug_to_name(blank_to_null(F.regexp_extract(host, UNICODE + r"^([\w-]+)\.jobs\.personio\.de", 1)))


def is_job_url(url: Column) -> Column:
    """The URL names no excluded site and looks like a posting."""
    return let(
        lowered(url),
        lambda text: ~contains_any(text, V.BLOCKED_URL_PARTS) & contains_any(text, V.JOB_URL_PARTS),
    )


def clean_url(url: Column) -> Column:
    """Trimmed and without trailing slashes."""
    return F.regexp_replace(strip(url), r"/+$", "")
