"""Boolean trigram queries of regular expressions.

A query is None (nothing is known, every text must be scanned) or a set of conjunctions, each a set
of trigrams in lower case: a text that matches holds all trigrams of at least one conjunction.
"""

from __future__ import annotations

import re
from itertools import product

Query = frozenset[frozenset[str]] | None

#: Strings a run of a pattern may stand for before it counts as unknown, and conjunctions of a query.
MOST_STRINGS = 64
_parse, _names = re._parser.parse, re._constants


def _strings(op, arg) -> set[str] | None:
    """All strings a part of a pattern may match, in lower case, if they are few."""
    if op is _names.LITERAL:
        return {chr(arg).lower()}
    if op is _names.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is _names.LITERAL:
                found.add(chr(value).lower())
            elif kind is _names.RANGE and value[1] - value[0] < 4:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found
    if op is _names.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is _names.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is _names.MAX_REPEAT and arg[1] <= 2:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        part = _strings(op, arg)
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _least(conjunctions) -> Query:
    """Without conjunctions that hold another one."""
    all_of = set(conjunctions)
    return frozenset(a for a in all_of if not any(b < a for b in all_of))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return _least(x | y for x in a for y in b)


def _of_strings(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return None
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _inner(op, arg) -> Query:
    """What a part needs that stands for too many strings."""
    if op is _names.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _names.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else _least(x for part in parts for x in part)
    if op is _names.MAX_REPEAT and arg[0] > 0:
        return _sequence(arg[2])
    return None


def _sequence(items) -> Query:
    query, run = None, {""}
    for op, arg in [*items, (None, None)]:
        part = None if op is None else _strings(op, arg)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query = _both(query, _of_strings(run))
        run = part if part is not None else {""}
        if part is None and op is not None:
            query = _both(query, _inner(op, arg))
    return query


def trigram_query(pattern: str) -> Query:
    return _sequence(list(_parse(pattern)))
