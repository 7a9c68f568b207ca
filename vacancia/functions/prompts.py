"""Text blocks that describe postings to a model.

A block holds the whole description unless the caller says how many characters a model may be shown.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .salary import format_salary
from .text import blank_to_null

# What stands between the blocks of a batch.
BATCH_JOINERS = {"score": "\n---\n", "skills": "\n", "language": "\n", "salary": "\n"}


def _or(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def _none(c: Column) -> Column:
    """Missing values as the scoring prompt has always shown them."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _description(chars: int | None) -> Column:
    text = F.coalesce(F.col("description"), F.lit(""))
    return text if chars is None else F.substring(text, 1, chars)


def score_block(index: Column, chars: int | None = None) -> Column:
    remote = F.when(F.col("is_remote"), "True").when(~F.col("is_remote"), "False").otherwise("None")
    asks = F.coalesce(blank_to_null(F.col("language_required")), F.col("language"))
    return F.concat(
        F.lit("[JOB "), index.cast("string"), F.lit("]\nTitle: "), _none(F.col("title")),
        F.lit("\nCompany: "), _none(F.col("company")),
        F.lit("\nLocation: "), _none(F.col("location")),
        F.lit("\nType: "), _none(F.col("job_type")),
        F.lit("\nRemote: "), remote,
        F.lit("\nListing written in: "), _none(F.col("listing_language")),
        F.lit("\nLanguage required: "), _none(asks),
        F.lit("\nExperience: "), _none(F.col("experience_level")),
        F.lit("\nSalary: "),
        format_salary(F.col("salary_min"), F.col("salary_max"), F.coalesce(F.col("salary_currency"), F.lit("None"))),
        F.lit("\nDescription:\n"), _description(chars), F.lit("\n"),
    )


def skills_block(index: Column, chars: int | None = None) -> Column:
    """Numbered within the batch, as the answers are."""
    return F.concat(
        F.lit("--- JOB "), index.cast("string"), F.lit(" ---\nTitle: "), _or(F.col("title"), "Untitled"),
        F.lit("\nDescription:\n"), _description(chars), F.lit("\n"),
    )


def salary_block(index: Column, chars: int | None = None) -> Column:
    return F.concat(
        F.lit("--- JOB "), index.cast("string"), F.lit(" ---\nTitle: "), _or(F.col("title"), "Untitled"),
        F.lit("\nCompany: "), _or(F.col("company"), "Unknown"),
        F.lit("\nLocation: "), _or(F.col("location"), "Unknown"),
        F.lit(", "), F.coalesce(F.col("country"), F.lit("")),
        F.lit("\nDescription:\n"), _description(chars), F.lit("\n"),
    )


def language_block(index: Column, chars: int | None = None) -> Column:
    return F.concat(
        F.lit("--- JOB "), index.cast("string"), F.lit(" ---\nTitle: "), _or(F.col("title"), "Untitled"),
        F.lit("\nCompany: "), _or(F.col("company"), "Unknown"),
        F.lit("\nLocation: "), _or(F.col("location"), "Unknown"),
        F.lit("\nDescription:\n"), _description(chars), F.lit("\n"),
    )


BLOCKS = {"score": score_block, "skills": skills_block, "salary": salary_block, "language": language_block}


def profile_prompt(
    profile: str, index: Column, profile_chars: int | None = None, chars: int | None = None
) -> Column:
    """Candidate profile, a parameter of the run, in front of the block of each posting."""
    return F.concat(
        F.lit("CANDIDATE PROFILE:\n" + profile[:profile_chars] + "\n\nJOB LISTING:\n"), score_block(index, chars)
    )
