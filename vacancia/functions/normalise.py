"""Dates, contract types and seniority."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import UNICODE, blank_to_null, let, lowered, strip

EPOCH_DAY = "1970-01-01"


def epoch_seconds_to_day(seconds: Column) -> Column:
    """ISO day of an epoch in seconds, in UTC whatever the session says."""
    days = F.floor(seconds / 86400).cast("int")
    return F.date_format(F.date_add(F.lit(EPOCH_DAY).cast("date"), days), "yyyy-MM-dd")


def _parse_stripped(text: Column) -> Column:
    parsed = F.when(F.lit(False), F.lit(None).cast("date"))
    for shape, formats in V.DATE_SHAPES.items():
        parsed = parsed.when(text.rlike(shape), F.coalesce(*[F.try_to_date(text, f) for f in formats]))
    written = F.when(text.rlike(r"^\d{4}") & (F.length(text) >= 10), F.left(text, F.lit(10))).otherwise(text)
    return (
        F.when(F.length(text) == 0, F.lit(None))
        .when(text.rlike(r"^[0-9]{10,}$"), epoch_seconds_to_day(F.left(text, F.lit(10)).try_cast("bigint")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)))
        .otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), written))
    )


def parse_date(c: Column) -> Column:
    """ISO day of a date in any of the accepted notations; other text passes unchanged.

    Day-first notation is tried before month-first. Digits of an epoch are read as seconds,
    only the first ten count.
    """
    return let(strip(c), _parse_stripped)


def _type_of_lowered(text: Column) -> Column:
    out = F.when(text.isin(V.JOB_TYPES), text)
    for written, canonical in V.JOB_TYPE_SYNONYMS.items():
        out = out.when(text == written, F.lit(canonical))
    for written, canonical in V.JOB_TYPE_SYNONYMS.items():
        out = out.when(F.contains(text, F.lit(written)), F.lit(canonical))
    return out.otherwise(text)


def job_type(c: Column) -> Column:
    """Canonical contract type: exact name, synonym, contained synonym, else as written."""
    return let(F.lower(strip(c)), _type_of_lowered)


def job_type_by_words(c: Column, rules: list[tuple[str, str]], keep_unknown: bool = False) -> Column:
    """First rule whose word is part of the lower-cased text.

    Feeds differ in the order of their rules and in whether unknown text is kept.
    """
    text = F.lower(c)
    out = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(None).cast("string"))
    for word, canonical in rules:
        out = out.when(F.contains(text, F.lit(word)), F.lit(canonical))
    return out.otherwise(strip(text)) if keep_unknown else out


# Rules of the feed with free-text types.
LOOSE_TYPES = [
    ("full", "fulltime"), ("part", "parttime"), ("contract", "contract"),
    ("freelance", "contract"), ("intern", "internship"),
]


def job_type_loose(c: Column) -> Column:
    return job_type_by_words(c, LOOSE_TYPES, keep_unknown=True)


def remote_from_text(location: Column, title: Column) -> Column:
    """True if location or title says "remote", else unknown."""
    said = F.contains(lowered(location), F.lit("remote")) | F.contains(lowered(title), F.lit("remote"))
    return F.when(said, F.lit(True))


def _level_of_title(lower_title: Column) -> Column:
    level = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in V.TITLE_LEVELS.items():
        level = level.when(lower_title.rlike(UNICODE + pattern), F.lit(name))
    return level


def _level_of_years(digits: Column) -> Column:
    years = digits.try_cast("double")
    level = F.when(F.coalesce(F.length(digits), F.lit(0)) == 0, F.lit(None).cast("string"))
    for bound, name in V.YEARS_LEVELS:
        level = level.when(years <= bound, F.lit(name))
    return level.otherwise(F.lit("lead"))


def experience_level(title: Column, description: Column, window: int | None = None) -> Column:
    """Seniority from the title, else from the first years of experience that the text asks for.

    ``window`` leaves only so many leading characters of the text to count.
    """
    text = F.coalesce(description, F.lit(""))
    text = F.lower(text if window is None else F.substring(text, 1, window))
    digits = F.regexp_extract(text, UNICODE + V.YEARS_OF_EXPERIENCE, 1)
    return F.coalesce(let(lowered(title), _level_of_title), let(digits, _level_of_years))


def score_band(score: Column) -> Column:
    value = F.coalesce(score, F.lit(0))
    band = F.when(F.lit(False), F.lit(""))
    for bound, name in V.SCORE_BANDS:
        band = band.when(value >= bound, F.lit(name))
    return band.otherwise(F.lit("low"))


def feed_category(term: Column) -> Column:
    """Category of a search term: that of the first key word it contains."""
    text = F.lower(strip(term))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, category in V.FEED_CATEGORIES.items():
        out = out.when(F.contains(text, F.lit(word)), F.lit(category))
    return out


def output_language(language_required: Column, language: Column) -> Column:
    """Language to write an application in."""
    text = F.lower(F.coalesce(blank_to_null(language_required), blank_to_null(language), F.lit("")))
    return (
        F.when(F.contains(text, F.lit("german")), "German")
        .when(F.contains(text, F.lit("french")), "French")
        .when(F.contains(text, F.lit("dutch")), "Dutch")
        .when(F.contains(text, F.lit("spanish")), "Spanish")
        .otherwise("English")
    )
