"""Pieces of HTML by pattern: attributes, elements and their text.

Pages are searched as text. An element ends at the closing tag that balances its opening tag, so
elements of the same name may lie within it; where tags do not balance it ends at the first one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..functions.text import blank_to_null, let, strip, unescape_entities

HIDDEN = r"(?i)<!--[\s\S]*?-->|<(script|style|noscript)\b[\s\S]*?</\1\s*>"
CHROME = r"(?i)<!--[\s\S]*?-->|<(nav|header|footer|script|style|noscript)\b[\s\S]*?</\1\s*>"


def _gated(html: Column, literal: str, value: Column) -> Column:
    """Search only pages that contain the literal at all. Values of attributes are matched in
    the case they are written in."""
    return F.when(F.contains(html, F.lit(literal)), value)


def text_of(fragment: Column, separator: str = "") -> Column:
    """Texts between tags, trimmed, without the empty ones, joined."""
    pieces = F.split(F.regexp_replace(fragment, HIDDEN, ""), r"<[^>]*>")
    texts = F.transform(pieces, lambda p: strip(unescape_entities(p)))
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 0), separator)


def _after(page: Column, opening: Column) -> Column:
    """What follows the first place of an opening tag; null if the tag is empty."""
    return let(
        opening, lambda o: F.when(F.length(o) > 0, F.substring(page, F.instr(page, o) + F.length(o), F.length(page)))
    )


def _up_to_close(rest: Column, tag: Column) -> Column:
    """What precedes the closing tag of an element whose opening tag was just left; null if none closes.

    The text is cut at the closing tags of that name. The element ends with the first piece up to
    which as many elements of the name were opened as closed.
    """
    opening = F.concat(F.lit("(?i)<"), tag, F.lit(r"(?=[\s/>])"))

    def step(state: Column, piece: Column) -> Column:
        still = state["open"] + F.regexp_count(piece, opening)
        goes_on = F.struct((still - 1).alias("open"), (state["n"] + 1).alias("n"))
        return F.when(state["open"] < 0, state).otherwise(goes_on)

    def balanced(pieces: Column) -> Column:
        # the last piece has no closing tag behind it
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"))
        ended = F.aggregate(closed, start, step, lambda s: F.when(s["open"] < 0, s["n"]).otherwise(1))
        # the function of this name in Python takes constants only
        whole = F.call_function("array_join", F.slice(closed, F.lit(1), ended), F.concat(F.lit("</"), tag, F.lit(">")))
        return F.when(F.size(pieces) > 1, whole)

    return let(F.split(rest, F.concat(F.lit("(?i)</"), tag, F.lit(r"\s*>"))), balanced)


def element(html: Column, tag: str, may_stay_open: bool = False) -> Column:
    """Inside of the first element with this tag, null if there is none.

    An element that is never closed counts only if it may stay open, and then goes on to the
    end, as the body of a page that was cut off.
    """
    def inside(rest: Column) -> Column:
        found = _up_to_close(rest, F.lit(tag))
        return F.coalesce(found, rest) if may_stay_open else found

    return let(html, lambda page: let(_after(page, F.regexp_extract(page, rf"(?i)<{tag}\b[^>]*>", 0)), inside))


def _has_class(name: str) -> str:
    """The class must be one of the space-separated names."""
    return rf"""(?i:class)\s*=\s*["'](?:[^"']*\s)?{re.escape(name)}(?:\s[^"']*)?["']"""


def _has_value(attribute: str, name: str) -> str:
    return rf"""(?i:{attribute})\s*=\s*["']{re.escape(name)}["']"""


def _condition(selector: str) -> tuple[str, str]:
    """(literal that must occur, attribute pattern) of .class, #id or [itemprop='...']."""
    if selector.startswith("."):
        return selector[1:], _has_class(selector[1:])
    if selector.startswith("#"):
        return selector[1:], _has_value("id", selector[1:])
    name = selector.split("'")[1]
    return name, _has_value("itemprop", name)


def _is_tag(selector: str) -> bool:
    return selector.isalnum()


def _opening(html: Column, tags: Column, selector: str) -> Column:
    """First of the opening tags of a page that a selector names."""
    if _is_tag(selector):
        literal, pattern = None, rf"(?i)<{selector}\b[^>]*>"
    else:
        literal, condition = _condition(selector)
        pattern = rf"<[a-zA-Z][^>]*\s{condition}[^>]*>"
    named = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, pattern, 0)), lambda t: F.length(t) > 0)
    first = F.get(named, F.lit(0))
    return first if literal is None else _gated(html, literal, first)


def elements(html: Column, selectors: list[str]) -> Column:
    """(tag, inside) of the first element for each simple selector (tag, .class, #id or [itemprop])
    that has one, in the order of the selectors; inside is null where the element is never closed.

    A page is scanned for opening tags once, and all selectors are answered from those.
    """
    def inside(opening: Column) -> Column:
        return _up_to_close(_after(html, opening), F.regexp_extract(opening, r"^<([a-zA-Z0-9]+)", 1))

    def of_tags(tags: Column) -> Column:
        openings = F.filter(F.array(*[_opening(html, tags, s) for s in selectors]), lambda o: o.isNotNull())
        return F.transform(openings, lambda o: F.struct(o.alias("tag"), inside(o).alias("inside")))

    # no tag reaches beyond its first '>', so whatever a selector finds lies within one of these
    return let(F.regexp_extract_all(html, F.lit(r"<[a-zA-Z][^>]*>"), F.lit(0)), of_tags)


def insides(html: Column, selectors: list[str]) -> Column:
    """Insides of the first closed element for each selector that has one."""
    return F.filter(F.transform(elements(html, selectors), lambda e: e["inside"]), lambda c: c.isNotNull())


def first_inside(html: Column, selectors: list[str]) -> Column:
    """Inside of the first selector's element that is there and closed."""
    return F.get(insides(html, selectors), F.lit(0))


def attribute(tag: Column, *names: str) -> Column:
    """Value of the first of these attributes that an opening tag fills."""
    raw = [blank_to_null(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)) for name in names]
    return unescape_entities(F.coalesce(*raw))


def meta_properties(html: Column, names: list[str]) -> Column:
    """Contents of ``<meta property=...>`` by these names, whichever attribute comes first, as an array."""
    tags = [
        _gated(html, name, F.regexp_extract(html, rf"""(?i)<meta\b[^>]*property\s*=\s*["']{re.escape(name)}["'][^>]*>""", 0))
        for name in names
    ]
    return F.transform(F.array(*tags), lambda tag: strip(attribute(tag, "content")))
