"""The language a posting is written in and the language it asks for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import UNICODE_LINES, collapse_spaces, let, lowered

UNKNOWN = "unknown"


def _alternation(patterns: list[str]) -> str:
    return UNICODE_LINES + "|".join(f"(?:{p})" for p in patterns)


def matches_any(text: Column, patterns: list[str], literals: list[str] | None = None) -> Column:
    """Some pattern is found in the text.

    The patterns form one alternation. With ``literals``, of which every pattern holds one,
    each literal has the alternation of its patterns, and a text without the literal is not
    searched for them.
    """
    if not literals:
        return text.rlike(_alternation(patterns))
    groups: dict[str, list[str]] = {literal: [] for literal in literals}
    for pattern in patterns:
        groups[next(literal for literal in literals if literal in pattern)].append(pattern)
    hit = F.lit(False)
    for literal, group in groups.items():
        if group:
            hit = hit | (F.contains(text, F.lit(literal)) & text.rlike(_alternation(group)))
    return hit


def _by_function_words(clean: Column) -> Column:
    tables = {code: sorted(set(listed.split())) for code, listed in V.STOP_WORDS.items()}
    known = sorted({word for table in tables.values() for word in table})

    def winner(hits: Column) -> Column:
        def count(table: list[str]) -> Column:
            return F.size(F.filter(hits, lambda t: t.isin(table)))

        return F.array_max(
            F.array(
                *[
                    F.struct(count(table).alias("n"), F.lit(-place).alias("place"), F.lit(V.LANGUAGE_NAMES[code]).alias("name"))
                    for place, (code, table) in enumerate(tables.items())
                ]
            )
        )

    tokens = F.split(F.lower(clean), r"[^\p{L}]+")
    hits = F.filter(tokens, lambda t: t.isin(known))
    return let(let(hits, winner), lambda best: F.when(best["n"] > 0, best["name"]).otherwise(UNKNOWN))


def _short(text: Column) -> Column:
    """Less than MIN_LANGUAGE_TEXT characters with white space collapsed; mostly the start of the text tells."""
    length = lambda c: F.length(collapse_spaces(c))
    enough = length(F.left(text, F.lit(8 * V.MIN_LANGUAGE_TEXT))) >= V.MIN_LANGUAGE_TEXT
    return F.when(enough, F.lit(False)).otherwise(length(text) < V.MIN_LANGUAGE_TEXT)


def _by_script_or_words(clean: Column) -> Column:
    any_script = "".join(pattern.strip("[]") for _, pattern in V.SCRIPT_LANGUAGES)
    script = F.when(F.lit(False), F.lit(""))
    for code, pattern in V.SCRIPT_LANGUAGES:
        script = script.when(clean.rlike(pattern), F.lit(V.LANGUAGE_NAMES[code]))
    return (
        F.when(_short(clean), F.lit(UNKNOWN))
        .when(clean.rlike(f"[{any_script}]"), script)
        .otherwise(_by_function_words(clean))
    )


def listing_language(text: Column) -> Column:
    """Language of the running text by its function words, or by its script.

    The language with the most of its function words wins, ties go to the first in the
    table. Text under 30 characters or without any such word is "unknown".
    """
    plain = F.coalesce(text, F.lit(""))
    untagged = F.when(F.contains(plain, F.lit("<")), F.regexp_replace(plain, r"<[^>]+>", " ")).otherwise(plain)
    return let(untagged, _by_script_or_words)


def language_from_title(title: Column) -> Column:
    return F.when(matches_any(lowered(title), V.GERMAN_TITLE), "German").otherwise(UNKNOWN)


def _required_by_rules(text: Column, title: Column, text_language: Column) -> Column:
    """The rules, over text and title in lower case."""
    def says(rule: str, patterns: list[str]) -> Column:
        return matches_any(text, patterns, V.RULE_LITERALS[rule])

    title_rule = F.when(matches_any(title, V.GERMAN_TITLE), "German").otherwise(UNKNOWN)
    plus = F.lit("English (German plus)")
    german = F.struct(
        says("german_optional", V.GERMAN_OPTIONAL).alias("optional"),
        (~says("no_german", V.NO_GERMAN_NEEDED) & says("german_required", V.GERMAN_REQUIRED)).alias("required"),
        says("english_working", V.ENGLISH_WORKING).alias("english_working"),
    )
    english_text = (
        F.when(matches_any(title, V.GERMAN_REQUIRED, V.RULE_LITERALS["german_required"]), "German")
        .when(matches_any(title, V.GERMAN_TITLE), plus)
        .otherwise("English")
    )
    by_text = let(
        german,
        lambda g: F.when(g["english_working"] & ~g["required"], "English")
        .when(g["required"] & ~g["optional"], "German")
        .when(g["required"] | g["optional"], plus),
    )
    by_other_language = (
        F.when(says("french_required", V.FRENCH_REQUIRED), "French")
        .when(says("dutch_required", V.DUTCH_REQUIRED), "Dutch")
        .when(says("hindi_required", V.HINDI_REQUIRED), "Hindi")
        .when(says("english_required", V.ENGLISH_REQUIRED), "English")
        .when(text_language == "English", english_text)
        .when(text_language.isin("French", "Spanish", "Dutch", "Hindi"), text_language)
        .otherwise(title_rule)
    )
    working = says("english_working", V.ENGLISH_WORKING)
    return (
        F.when(F.length(text) == 0, title_rule)
        .when(text_language == "German", F.when(working, plus).otherwise("German"))
        .otherwise(F.coalesce(by_text, by_other_language))
    )


def language_required(description: Column, title: Column, text_language: Column) -> Column:
    """Language the posting asks for; the first rule that applies decides.

    ``text_language`` is what ``listing_language`` says of the description; give it as a
    stored column so that it is not worked out twice.
    """
    return let(
        F.struct(lowered(description).alias("text"), lowered(title).alias("title")),
        lambda p: _required_by_rules(p["text"], p["title"], text_language),
    )
