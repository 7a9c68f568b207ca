"""Keys by which postings are recognised as the same, and how complete a posting is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import UNICODE, collapse_spaces, let, strip


def _normalize_stripped_url(url: Column) -> Column:
    shape = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"
    path = F.regexp_replace(F.regexp_extract(url, shape, 3), r";[^/]*$", "")
    hierarchical = F.concat(
        F.lower(F.regexp_extract(url, shape, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(url, shape, 2)),
        F.regexp_replace(path, r"/+$", ""),
    )
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), r"/+$", "")
    return (
        F.when(~F.startswith(url, F.lit("http")), F.lower(url))
        .when(url.rlike(r"^[^:/?#]+://"), hierarchical)
        .otherwise(bare)
    )


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no parameters, query or fragment.

    The path keeps its case. What does not start with "http" is only lower-cased.
    """
    return let(strip(F.coalesce(c, F.lit(""))), _normalize_stripped_url)


def url_host(c: Column) -> Column:
    """Lower-case host of an http(s) URL without a leading ``www.``, else null."""
    host = F.lower(F.regexp_extract(c, r"^https?://([^/?#]*)", 1))
    return F.when(F.length(host) > 0, F.regexp_replace(host, r"^www\.", ""))


def normalize_title(c: Column) -> Column:
    """Lower case, gender markers out, abbreviations spelled out, single spaces.

    Markers take the white space around them along, as the key has always been built.
    """
    title = F.lower(strip(F.coalesce(c, F.lit(""))))
    # a marker at the end may only show once the others are gone
    anywhere = [m for m in V.TITLE_MARKERS if not m.endswith("$")]
    at_end = [m for m in V.TITLE_MARKERS if m.endswith("$")]
    for markers in (anywhere, at_end):
        title = F.regexp_replace(title, UNICODE + "|".join(markers), "")
    return collapse_spaces(let(title, _spell_out))


def _spell_out(title: Column) -> Column:
    """Replace abbreviations one after the other; most titles have none and skip that."""
    spelled = title
    for short, full in V.TITLE_SPELLINGS.items():
        spelled = F.regexp_replace(spelled, UNICODE + short, full)
    return F.when(title.rlike(UNICODE + "|".join(V.TITLE_SPELLINGS)), spelled).otherwise(title)


def normalize_company(c: Column) -> Column:
    """Lower case without one trailing legal form.

    The legal form need not be a word of its own: "chase" loses its "se", as the key has
    always been built.
    """
    company = F.lower(strip(F.coalesce(c, F.lit(""))))
    return collapse_spaces(F.regexp_replace(company, UNICODE + V.LEGAL_SUFFIX, ""))


def title_company_key(normal_title: Column, normal_company: Column) -> Column:
    """Both normalised parts joined, null unless both have text."""
    return F.when(
        (F.length(normal_title) > 0) & (F.length(normal_company) > 0),
        F.concat(normal_title, F.lit(V.KEY_SEPARATOR), normal_company),
    )


def is_ats(source: Column, ats_platform: Column) -> Column:
    """The posting comes from a hiring platform and not from a board."""
    return F.coalesce(source.isin(V.ATS_SOURCES), F.lit(False)) | (
        F.coalesce(F.length(ats_platform), F.lit(0)) > 0
    )


# What a filled field adds to completeness.
TEXT_WEIGHTS = {
    "title": 2, "company": 2, "location": 1, "description": 3, "date_posted": 1,
    "job_type": 1, "country": 1, "company_url": 1,
}
VALUE_WEIGHTS = {"salary_min": 2, "is_remote": 1}
LONG_DESCRIPTION = [(500, 2), (2000, 2)]  # longer than -> adds


def completeness() -> Column:
    """How much a posting tells, 0 to 19, over the posting columns."""
    score = F.lit(0)
    for name, weight in TEXT_WEIGHTS.items():
        score = score + F.when(F.length(F.col(name)) > 0, weight).otherwise(0)
    for name, weight in VALUE_WEIGHTS.items():
        score = score + F.when(F.col(name).isNotNull(), weight).otherwise(0)
    for bound, weight in LONG_DESCRIPTION:
        score = score + F.when(F.length(F.col("description")) > bound, weight).otherwise(0)
    return score.cast("int")
