"""Whitespace, case, markup and containment helpers."""

from __future__ import annotations

import re
from html.entities import html5, name2codepoint
from typing import Callable, Iterable

from pyspark.sql import Column, functions as F

# Java's classes are ASCII unless told otherwise; postings are not.
UNICODE = "(?U)"
# Unicode classes, and only \n ends a line for the dot.
UNICODE_LINES = "(?Ud)"
#: What ``\\s`` stands for with UNICODE.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it.

    Shared subexpressions under a CASE are not shared by Spark; a lambda variable is.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def lowered(c: Column) -> Column:
    """Lower case, with missing text as the empty string."""
    return F.lower(F.coalesce(c, F.lit("")))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    # single spaces, which nearly all are, stay as they are
    return F.trim(F.regexp_replace(c, UNICODE + r"\s{2,}|[^\S ]", " "))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def title_case_if_lower(c: Column) -> Column:
    """Title-case text without any capital; keep the rest, so that "USA" survives."""
    return F.when(c == F.lower(c), title_case(c)).otherwise(c)


def words(c: Column) -> Column:
    """White-space separated words; blank text has none."""
    return F.filter(F.split(c, UNICODE + r"\s+"), lambda w: F.length(w) > 0)


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, literals: Iterable[str]) -> Column:
    """Some literal is a substring of a short text: one search for all of them."""
    literals = list(literals)
    return c.rlike("|".join(re.escape(v) for v in literals)) if literals else F.lit(False)


def long_contains_any(c: Column, literals: Iterable[str]) -> Column:
    """Some literal is a substring of a long text: plain searches beat a pattern there."""
    def search(text: Column) -> Column:
        hit = F.lit(False)
        for literal in literals:
            hit = hit | F.contains(text, F.lit(literal))
        return hit

    return let(c, search)


def slug_to_name(slug: Column) -> Column:
    """``acme-labs`` -> ``Acme Labs``."""
    return title_case(F.regexp_replace(slug, "-", " "))


def _code_point(number: Column) -> Column:
    """The character of a code point given as a bigint."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _valid_code_point(number: Column) -> Column:
    return number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)


def _windows_characters() -> dict[int, str]:
    """What numbers 128 to 159 stand for in practice: the bytes of the Windows code page."""
    return {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _text_map(entries: dict[str, str]) -> Column:
    """A constant map of text, in a few nodes of the plan however many entries it has."""
    gap = "\u0001"
    return F.map_from_arrays(F.split(F.lit(gap.join(entries)), gap), F.split(F.lit(gap.join(entries.values())), gap))


def _decode_all(c: Column) -> Column:
    named = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
    del named["amp"]
    table = _text_map(named)
    # names that browsers know without a semicolon as well
    open_names = sorted((n for n in html5 if not n.endswith(";") and n.lower() != "amp"), key=len, reverse=True)
    open_table = _text_map({name: html5[name] for name in open_names})
    windows = _text_map({str(n): ch for n, ch in _windows_characters().items()})

    def decode_named(text: Column, name: Column) -> Column:
        entity = F.concat(F.lit("&"), name, F.lit(";"))
        return F.replace(text, entity, F.coalesce(F.try_element_at(table, name), entity))

    def decode_open(text: Column, name: Column) -> Column:
        return F.replace(text, F.concat(F.lit("&"), name), F.try_element_at(open_table, name))

    def decode_number(text: Column, token: Column) -> Column:
        is_hex = F.lower(F.left(token, F.lit(1))) == "x"
        number = F.when(is_hex, F.conv(F.substring(token, 2, 6), 16, 10)).otherwise(token).try_cast("bigint")
        usable = _valid_code_point(number) & (number != 38)
        rest = F.when(is_hex, "(?:;|(?![0-9a-fA-F;]))").otherwise("(?:;|(?![0-9;]))")
        special = F.when(number.isin(36, 92), "\\").otherwise("")
        character = F.coalesce(F.try_element_at(windows, number.cast("string")), _code_point(number))
        return F.when(
            usable, F.regexp_replace(text, F.concat(F.lit("&#"), token, rest), F.concat(special, character))
        ).otherwise(text)

    def found(text: Column, pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    step = F.aggregate(found(c, r"&([A-Za-z][A-Za-z0-9]*);"), c, decode_named)
    step = let(step, lambda t: F.aggregate(found(t, f"&({'|'.join(open_names)})"), t, decode_open))
    numbers = found(c, r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})")
    step = let(step, lambda t: F.when(F.contains(c, F.lit("&#")), F.aggregate(numbers, t, decode_number)).otherwise(t))
    return F.regexp_replace(step, r"&(?:amp;?|AMP;?|#38;?|#[xX]26;?)", "&")


def unescape_entities(c: Column) -> Column:
    """Decode named (HTML 4 and ``&apos;``) and numeric entities, each only once.

    Text without an ampersand, the usual case, is passed on untouched. Ampersands come last,
    so that what they produce is not decoded again.
    """
    return let(c, lambda t: F.when(F.contains(t, F.lit("&")), _decode_all(t)).otherwise(t))


def strip_html(c: Column) -> Column:
    """Plain text of an HTML fragment; breaks, paragraphs and list items keep their lines."""
    text = F.regexp_replace(c, r"<br\s*/?>|<p>|</p>", "\n")
    text = F.replace(text, F.lit("<li>"), F.lit("\n• "))
    text = F.regexp_replace(text, r"<[^>]+>", "")
    fewer = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(unescape_entities(text), fewer))


def strip_html_if_markup(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), strip_html(c)).otherwise(c)
