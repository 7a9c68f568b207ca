"""Search-term filters. Terms are parameters of a run, so they become literals of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any, let, long_contains_any, lowered
from .filters import by_location_text


def _all_words(c: Column, words: list[str]) -> Column:
    hit = F.lit(True)
    for word in words:
        hit = hit & F.contains(c, F.lit(word))
    return hit


def any_word(df: DataFrame, term: str | None) -> DataFrame:
    """Some word of the term is part of title or description."""
    if not term:
        return df
    words = term.lower().split()
    return df.filter(
        contains_any(lowered(F.col("title")), words) | long_contains_any(lowered(F.col("description")), words)
    )


def all_words(df: DataFrame, terms: list[str] | None) -> DataFrame:
    """All words of some term are in the title, or all are in the description."""
    if not terms:
        return df
    each = [term.lower().split() for term in terms]

    def some_term(text: Column) -> Column:
        hit = F.lit(False)
        for words in each:
            hit = hit | _all_words(text, words)
        return hit

    return df.filter(let(lowered(F.col("title")), some_term) | let(lowered(F.col("description")), some_term))


def tagged(df: DataFrame, terms: list[str] | None, extra: Column) -> DataFrame:
    """The phrase or all its words are in the title, or all words in title, text and extra.

    ``extra`` is the tags or the category of the feed. Words may be spread over the parts.
    """
    wanted = [t.lower().strip() for t in terms or [] if t.strip()]
    if not wanted:
        return df
    title = lowered(F.col("title"))
    blank = F.lit("")
    blob = F.lower(
        F.concat_ws(" ", F.coalesce(F.col("title"), blank), F.coalesce(F.col("description"), blank), F.coalesce(extra, blank))
    )

    def in_title(text: Column) -> Column:
        hit = F.lit(False)
        for term in wanted:
            hit = hit | F.contains(text, F.lit(term)) | _all_words(text, term.split())
        return hit

    def in_all(text: Column) -> Column:
        hit = F.lit(False)
        for term in wanted:
            hit = hit | _all_words(text, term.split())
        return hit

    return df.filter(let(title, in_title) | let(blob, in_all))


def blob_any_word(df: DataFrame, term: str | None) -> DataFrame:
    """Some word of the term is part of title and description taken together."""
    words = (term or "").lower().split()
    if not words:
        return df
    blank = F.lit("")
    blob = F.lower(F.concat_ws(" ", F.coalesce(F.col("title"), blank), F.coalesce(F.col("description"), blank)))
    return df.filter(long_contains_any(blob, words))


def filter_jobs(
    df: DataFrame,
    term: str | None = None,
    terms: list[str] | None = None,
    location: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Strict or loose term match, then location."""
    matched = all_words(df, terms) if strict and terms else any_word(df, term)
    return by_location_text(matched, location)
