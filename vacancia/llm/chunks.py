"""Cutting a text where no token can cross, so that each distinct chunk is encoded once."""

from __future__ import annotations

import re

#: A space that starts no word: the text goes on with white space or ends.
_LOOSE = re.compile(r" (?=\s|\Z)")


def spaced_chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the space they begin with.

    A byte-level tokenizer never joins a single space that a word follows with what stands before
    it, so a text may be cut there. Spaces inside or at the end of white space stay in their chunk.
    """
    if not _LOOSE.search(text):
        first, *rest = text.split(" ")
        return first, rest
    first, *parts = text.split(" ")
    rest: list[str] = []
    for part in parts:
        if part and not part[0].isspace():
            rest.append(part)
        elif rest:
            rest[-1] += " " + part
        else:
            first += " " + part
    return first, rest


class Cache(dict):
    """At most ``room`` results of ``make``, by chunk; starts anew when it is full."""

    def __init__(self, make, room: int = 400_000):
        super().__init__()
        self._make, self._room = make, room

    def __missing__(self, chunk):
        if len(self) >= self._room:
            self.clear()
        found = self[chunk] = self._make(chunk)
        return found
