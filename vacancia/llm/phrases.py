"""Collocations from a weighted de Bruijn graph of each language.

Texts are cut into pieces and words. Nodes of the graph are sequences of one word less than the longest
phrase; an edge joins two nodes that overlap, is a longest gram, and weighs as often as it occurs. Only
edges are counted from text. The count of a node is what flows out of it plus the pieces that end in
it; nodes are the edges of the next shorter graph, and so the counts of all shorter phrases follow, down
to single words.

A node all of whose flow goes on along one edge, or comes in along one, lies on a unary path: it never
occurs without that edge, and is merged into it. What is left are phrases that stand on their own. They
are scored by their weakest cut.

A phrase that counts has no rare pair of words in it. So pieces are cut further where a pair is rare,
which changes no count that is asked for and leaves a fifth of the words or less. Pairs are counted
by their hashes; the frequent ones are sent as a bit map of bounded size, which may let rare pairs
through and drops none. All counts that are returned come from whole words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vacancia.session import TableSpool

from .words import _mixed

#: Words of the longest phrases, the least count of a phrase, and rows returned for each language.
LONGEST = 5
LEAST = 100
TOP = 2000
#: Bits of the map of frequent words and pairs: so many for each of them, within these powers of two.
BITS_EACH = 64
SMALLEST_MAP, LARGEST_MAP = 20, 28
#: Hashes that a task holds before it counts them, and parts in which a language's first rows are chosen.
HELD_HASHES = 4_000_000
SALTS = 32

_BUCKET = 32768  # bits that Spark keeps in one bit map

_LETTERS = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_class() -> np.ndarray:
    """Bytes by what they do: 0 belongs to a word, 1 parts words, 2 parts pieces."""
    kind = np.zeros(256, np.int8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return kind


_KIND = _word_class()


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, hashes, joined) of the words of lower-case UTF-8; joined says whether a word and
    the next are of one piece."""
    found = np.frombuffer(data, np.uint8)
    kind = _KIND[found]
    inside = np.zeros(len(found) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return starts, stops, np.zeros(0, np.uint64), np.zeros(0, bool)
    # a sum over the bytes of a word, each mixed with its place
    first = np.zeros(len(found), np.int64)
    first[starts] = 1
    place = np.arange(len(found)) - starts[np.cumsum(first) - 1]
    hashes = np.add.reduceat(_mixed(_LETTERS[found] + place.astype(np.uint64) * _BASE) * (kind == 0), starts)
    hashes = _mixed(hashes + (stops - starts).astype(np.uint64))
    breaks = np.r_[0, np.cumsum(kind == 2)]
    joined = breaks[starts[1:]] == breaks[stops[:-1]]
    return starts, stops, hashes, np.r_[joined, False]


def _pairs(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each word and the next in a language; of no use where they aren't joined."""
    return _mixed(hashes * _BASE + np.roll(hashes, -1) + np.uint64(salt))


def _alone(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each word in a language."""
    return _mixed(hashes ^ np.uint64(salt))


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """Language, a number for it and the lower-case text of each row; the number need not be its own."""
    langs = batch.column(0).to_pylist()
    salt = {lang: int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") for lang in set(langs)}
    for lang, text in zip(langs, batch.column(1).to_pylist()):
        yield lang, salt[lang], text.encode().lower()


def _hash_counts(rows: DataFrame) -> DataFrame:
    """(hash, lang, n): how often words and pairs of neighbours occur, by their hashes, without a language;
    and the number of words of each language, without a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, words = [], 0, Counter()

        def counted() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            columns = [pa.array(hashes.view(np.int64)), pa.nulls(len(hashes), pa.string()), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["hash", "lang", "n"])

        for batch in batches:
            for lang, salt, data in _languages(batch):
                starts, _, hashes, joined = _words(data)
                words[lang] += len(starts)
                held += [_pairs(hashes, salt)[joined], _alone(hashes, salt)]
                size += 2 * len(starts)
                if size >= HELD_HASHES:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
        columns = [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "lang", "n"])

    return rows.mapInArrow(count, "hash long, lang string, n long")


def _map_of(frequent: DataFrame, count: int) -> np.ndarray:
    """The bit map of frequent words and pairs, put together in the cluster; its size is bounded."""
    power = min(LARGEST_MAP, max(SMALLEST_MAP, (BITS_EACH * max(1, count)).bit_length()))
    slot = F.pmod(F.col("hash"), F.lit(1 << power))
    placed = frequent.select(F.floor(slot / _BUCKET).cast("int").alias("bucket"), (slot % _BUCKET).alias("bit"))
    whole = np.zeros((1 << power) // 8, np.uint8)
    for bucket, bits in placed.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)")).collect():
        whole[bucket * _BUCKET // 8 : (bucket + 1) * _BUCKET // 8] = np.frombuffer(bits, np.uint8)
    return whole


def _edges(rows: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """(lang, size, gram, n): longest grams, and shorter ones at the end of a run; words joined by spaces."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        last = np.uint64(len(marks) * 8 - 1)

        def marked(hashes: np.ndarray) -> np.ndarray:
            slot = hashes & last
            byte = marks[(slot >> np.uint64(3)).astype(np.int64)]
            return byte >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1

        for batch in batches:
            found: dict[tuple[str, int], Counter] = defaultdict(Counter)
            for lang, salt, data in _languages(batch):
                starts, stops, hashes, joined = _words(data)
                if not len(starts):
                    continue
                joined &= marked(_pairs(hashes, salt))
                before = np.r_[False, joined[:-1]]
                # rare words in no run have counts nobody asks for
                single = ~joined & ~before & marked(_alone(hashes, salt))
                found[lang, 1].update([data[a:b] for a, b in zip(starts[single].tolist(), stops[single].tolist())])
                for at, stop in zip(np.flatnonzero(joined & ~before).tolist(), (np.flatnonzero(before & ~joined) + 1).tolist()):
                    run = [data[a:b] for a, b in zip(starts[at:stop].tolist(), stops[at:stop].tolist())]
                    found[lang, longest].update([b" ".join(run[i : i + longest]) for i in range(len(run) - longest + 1)])
                    for size in range(1, min(longest, len(run) + 1)):
                        found[lang, size][b" ".join(run[-size:])] += 1
            for (lang, size), grams in found.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array([size] * len(grams), pa.int32()),
                        pa.array(list(grams), pa.binary()).cast(pa.string()),
                        pa.array(list(grams.values()), pa.int64()),
                    ],
                    ["lang", "size", "gram", "n"],
                )

    return rows.mapInArrow(build, "lang string, size int, gram string, n long")


def phrase_graph(grams: DataFrame, longest: int, spool: TableSpool) -> DataFrame:
    """(lang, size, gram, f, merged) of all phrases, from longest grams and piece ends.

    ``f`` is the count, ``merged`` whether one edge into or out of the phrase takes all of it. Of each order
    one shuffle: flow and largest edges of a node are added up together, in each task first.
    """
    level = grams.where(F.col("size") == longest).groupBy("lang", "gram").agg(F.sum("n").alias("f"))
    levels = [spool.cut(level.withColumn("merged", F.lit(False)), f"order-{longest}")]
    zero = F.lit(0).cast("long")
    for size in range(longest - 1, 0, -1):
        edges = levels[-1]
        gram = "gram"
        out = edges.select("lang", F.substring_index(gram, " ", size).alias("gram"), F.col("f").alias("flow"), F.col("f").alias("edge"))
        into = edges.select("lang", F.substring_index(gram, " ", -size).alias("gram"), zero.alias("flow"), F.col("f").alias("edge"))
        ends = grams.where(F.col("size") == size).select("lang", "gram", F.col("n").alias("flow"), zero.alias("edge"))
        nodes = out.unionByName(into).unionByName(ends).groupBy("lang", "gram").agg(
            F.sum("flow").alias("f"), F.max("edge").alias("largest")
        )
        levels.append(spool.cut(nodes.select("lang", "gram", "f", (F.col("largest") >= F.col("f")).alias("merged")), f"order-{size}"))
    whole = [level.withColumn("size", F.lit(longest - i)) for i, level in enumerate(levels)]
    graph = whole[0]
    for level in whole[1:]:
        graph = graph.unionByName(level)
    return graph


def _scored(graph: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases that stand on their own, by their weakest cut."""
    often = graph.where(F.col("f") >= least)
    words = F.split("gram", " ")
    joined = lambda start, size: F.array_join(F.slice(F.col("words"), start, size), " ")
    phrases = often.where((F.col("size") > 1) & ~F.col("merged"))
    cuts = phrases.select(
        "lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), words.alias("words"), "size",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
        joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    known = often.select("lang", "gram", "f")
    cuts = cuts.join(known.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    A-Z in lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. ``a`` counts the
    phrase, at least ``least`` times, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the
    language. Phrases that occur in a longer one only are left out. Ties go by count, then by the phrase's
    bytes. A null language is ``und``; null, empty and wordless texts add nothing; repeated rows count each;
    an empty table gives no rows. Ids and other columns play no part.
    """
    spool = TableSpool(docs.sparkSession, "phrases")
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counted = _hash_counts(rows).groupBy("hash", "lang").agg(F.sum("n").alias("n"))
    # what is not frequent is not stored
    kept = spool.cut(counted.where(F.col("hash").isNull() | (F.col("n") >= least)), "frequent")
    frequent = kept.where(F.col("hash").isNotNull()).select("hash")
    totals = kept.where(F.col("hash").isNull()).select("lang", "n")
    bits = _map_of(frequent, frequent.count())
    grams = _edges(rows, bits, longest).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    graph = phrase_graph(spool.cut(grams, "grams"), longest, spool)
    scored = spool.cut(_scored(graph, totals, least), "scored")
    return best_of_each(scored, top)


def best_of_each(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; parts of a language choose theirs first, so none is sorted whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = salted.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
