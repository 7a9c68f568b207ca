"""Insert/delete similarity of short strings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import let, words

#: Letters of the one string that a number holds; the sum of two such numbers still is a signed 64-bit one.
WORD = 62
_FULL = (1 << WORD) - 1


def _letters(c: Column) -> Column:
    return F.split(c, "")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _places(letters: Column) -> Column:
    """For each letter the places where it stands, as bits of one number for every WORD letters."""
    parts = F.sequence(F.lit(0), F.floor((F.size(letters) - 1) / WORD).cast("int"))

    def bits(letter: Column, part: Column) -> Column:
        some = F.slice(letters, part * WORD + 1, F.lit(WORD))
        marked = F.transform(some, lambda x, i: F.when(x == letter, _bit(i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(marked, F.lit(0).cast("long"), lambda total, x: total + x)

    entries = F.transform(F.array_distinct(letters), lambda x: F.struct(x.alias("key"), F.transform(parts, lambda part: bits(x, part)).alias("value")))
    return F.map_from_entries(entries)


def _after(rows: Column, hits: Column) -> Column:
    """One letter further: a set bit of ``rows`` is a place not yet matched; sums carry from part to part."""

    def part(state: Column, both: Column) -> Column:
        held, hit = both["rows"], both["hits"].bitwiseAND(both["rows"])
        total = held + hit + state["carry"]
        now = total.bitwiseAND(F.lit(_FULL)).bitwiseOR(held - hit)
        return F.struct(F.shiftright(total, WORD).alias("carry"), F.concat(state["done"], F.array(now)).alias("done"))

    both = F.zip_with(rows, hits, lambda x, y: F.struct(x.alias("rows"), F.coalesce(y, F.lit(0).cast("long")).alias("hits")))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("done"))
    return F.aggregate(both, start, part, lambda state: state["done"])


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts; bits of a number are places in ``a``."""

    def folded(places: Column) -> Column:
        """All letters of ``b`` at one number for ``a``."""

        def step(rows: Column, letter: Column) -> Column:
            hit = rows.bitwiseAND(F.coalesce(F.get(F.element_at(places, letter), F.lit(0)), F.lit(0).cast("long")))
            return (rows + hit).bitwiseOR(rows - hit).bitwiseAND(F.lit(_FULL))

        return WORD - F.bit_count(F.aggregate(_letters(b), F.lit(_FULL), step))

    def folded_parts(places: Column) -> Column:
        """The same with several numbers for ``a``."""
        count = F.floor((F.length(a) - 1) / WORD).cast("int") + 1
        none = F.array().cast("array<bigint>")
        rows = F.aggregate(
            _letters(b),
            F.array_repeat(F.lit(_FULL), count),
            lambda rows, letter: _after(rows, F.coalesce(F.element_at(places, letter), none)),
        )
        return F.aggregate(rows, F.lit(0), lambda total, x: total + WORD - F.bit_count(x))

    measured = let(
        _places(_letters(a)), lambda places: F.when(F.length(a) <= WORD, folded(places)).otherwise(folded_parts(places))
    )
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, F.length(a)).otherwise(measured)


def indel_distance(a: Column, b: Column) -> Column:
    """Number of insertions and deletions that turn ``a`` into ``b``; a missing text is an empty one."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.length(a) + F.length(b) - 2 * common_length(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Per cent of both lengths that an insert/delete script leaves alone; 100 if both empty."""
    total = F.length(F.coalesce(a, F.lit(""))) + F.length(F.coalesce(b, F.lit("")))
    return F.when(total == 0, F.lit(100.0)).otherwise((F.lit(1.0) - indel_distance(a, b) / total) * 100)


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Similarity that does not mind the order of words."""
    return similarity(sort_tokens(a), sort_tokens(b))


def signature(c: Column) -> list[Column]:
    """Two numbers that tell which letters a text has, and how often.

    Each letter, numbered among its like, sets one bit. An insertion or deletion changes one letter's
    number and so at most one bit.
    """
    letters = F.array_sort(F.filter(_letters(c), lambda x: F.length(x) > 0))
    numbered = F.transform(letters, lambda x, i: F.xxhash64(x, i - F.array_position(letters, x).cast("int")))

    def bits(hashes: Column, half: int) -> Column:
        own = F.filter(hashes, lambda h: F.pmod(F.shiftright(h, 8), F.lit(2)) == half)
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, h: total.bitwiseOR(_bit(F.pmod(h, F.lit(64)).cast("int"))))

    both = let(numbered, lambda hashes: F.array(bits(hashes, 0), bits(hashes, 1)))
    return [both[0], both[1]]


def allowed_distance(a: Column, b: Column, per_cent: int) -> Column:
    """``100 * (1 - d / (la + lb)) >= p`` is ``100 * d <= (100 - p) * (la + lb)``; the largest such d, of lengths."""
    return F.floor((a + b) * (100 - per_cent) / 100).cast("int")


def may_be_similar(a: list[Column], b: list[Column], sizes: tuple[Column, Column], per_cent: int) -> Column:
    """A test of lengths and signatures that every similar pair passes; a few instructions, no text is read."""
    allowed = allowed_distance(*sizes, per_cent)
    differing = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])
    return (F.abs(sizes[0] - sizes[1]) <= allowed) & (differing <= allowed)


def similar(a: Column, b: Column, per_cent: int) -> Column:
    """Both texts are similar. Plain edit distance never exceeds the insert/delete distance and is tried first."""
    allowed = allowed_distance(F.length(a), F.length(b), per_cent)
    return (a == b) | ((F.levenshtein(a, b) <= allowed) & (indel_distance(a, b) <= allowed))
