"""Repeated passages through a sparse suffix array.

Of each text's suffixes only those stay that start at a minimiser: the word whose next few words have
the smallest hash among neighbouring ones, so equal passages keep suffixes at equal places. The
suffixes of all texts are sorted by a hash of their first words, then by one of their surroundings,
over ranges of the whole cluster; neighbours that agree in both are compared word by word to the left
and right as far as they agree. Matches of enough words are passages.

Neighbours that begin alike in different surroundings may share a passage or not, and the suffix that
does share it may stand further on. For the keys of such neighbours the passages around each minimiser
are listed by exact hashes, one of each kind of surroundings, and sorted in the same way. A hot
passage is spread over ranges like any other: a suffix meets its neighbour only, never its group.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from vacancia.session import TableSpool

from .common import id_and_text
from .marks import marks_of, slot_of
from .words import _mixed, _ranges, sequence_hashes, word_hashes

#: Words of a passage; of the sequence whose hash elects minimisers; sequences they are elected from.
PASSAGE = 50
GRAM = 8
WINDOW = 16
#: Bytes of texts whose words are hashed together; a longer text is hashed alone.
TOGETHER = 1 << 19

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _elected(words: np.ndarray, passage: int, gram: int, window: int) -> np.ndarray:
    """For each place where a passage may start, the rightmost smallest hash of the window from there."""
    least = _mixed(sequence_hashes(words, gram))
    at, size = np.arange(len(least)), 1
    while size < window:
        # the smaller of two windows side by side, or overlapping in the last step
        step = min(size, window - size)
        right = least[step:] <= least[:-step]
        least, at = np.minimum(least[:-step], least[step:]), np.where(right, at[step:], at[:-step])
        size += step
    return at[: len(words) - passage + 1]


def _suffixes(words: np.ndarray, owner: np.ndarray, passage: int, gram: int, window: int):
    """(place, key, follow, low, high) of the minimisers of texts, whose words stand in a row.

    Passages that start at low..high elect the minimiser; ``follow`` hashes all their words and where
    the minimiser lies in them, so suffixes with equal key and follow share all these passages.
    """
    starts = np.flatnonzero(owner[: len(words) - passage + 1] == owner[passage - 1 :])
    elected = _elected(words, passage, gram, window)[starts]
    first = np.flatnonzero(np.r_[True, elected[1:] != elected[:-1]][: len(starts)])
    low, high = starts[first], starts[np.r_[first[1:], len(starts)][: len(first)] - 1]
    place = elected[first]
    key = _ranges(words, place, place + passage - window + 1, 1)
    inside = (place - low) * window + high - low
    follow = _mixed(_ranges(words, low, high + passage, 1) + inside.astype(np.uint64))
    return place, key.astype(np.int64), follow.astype(np.int64), low, high


def _words_in_groups(batch: pa.RecordBatch, passage: int) -> Iterator[tuple]:
    """(rows, words, owner, first) for texts (row, text) of ``TOGETHER`` bytes at a time, or a longer one:
    all words in a row, the text of each, and where each text's words begin."""
    rows, texts, size = [], [], 0
    for row, text in [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), (None, "")]:
        data = text.encode()
        if texts and (row is None or size + len(data) > TOGETHER):
            words, starts, _ = word_hashes(b" ".join(texts))
            begins = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
            if len(words) >= passage:
                owner = np.searchsorted(begins, starts, "right") - 1
                yield np.array(rows, np.int64), words, owner, np.searchsorted(starts, begins)
            rows, texts, size = [], [], 0
        rows.append(row)
        texts.append(data)
        size += len(data)


def sparse_suffixes(rows: DataFrame, passage: int, gram: int, window: int) -> DataFrame:
    """(key, follow, row, place): the suffixes that start at minimisers, by hashes of their words.

    The minimiser of a passage lies within ``window`` words of its start, so suffixes that agree in
    passage - window + 1 words, the key, show every passage. Shorter ends of texts have no such
    suffix. ``follow`` tells the surroundings of suffixes of one key apart.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for held, words, owner, begins in _words_in_groups(batch, passage):
                place, key, follow, _, _ = _suffixes(words, owner, passage, gram, window)
                parts.append((key, follow, held[owner[place]], place - begins[owner[place]]))
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "follow", "row", "place"])

    return rows.select("row", "text").mapInArrow(build, "key long, follow long, row long, place long")


def _open_passages(rows: DataFrame, marks: np.ndarray, passage: int, gram: int, window: int) -> DataFrame:
    """(key, follow, row, place): the passages around minimisers of marked keys, by their exact hash.

    Of suffixes with equal surroundings one stands for all: they share all these passages and are
    neighbours already. ``follow`` is 0 for all, so every passage meets its neighbour.
    """
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            parts = []
            for held, words, owner, begins in _words_in_groups(batch, passage):
                _, key, follow, low, high = _suffixes(words, owner, passage, gram, window)
                chosen = np.flatnonzero(marked[slot_of(key, len(marked))])
                many = high[chosen] - low[chosen] + 1
                first = np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(low[chosen], many) + np.arange(many.sum()) - first
                exact = _ranges(words, start, start + passage, 1).astype(np.int64)
                text = owner[start]
                parts.append((exact, np.repeat(follow[chosen], many), held[text], start - begins[text]))
            if parts:
                frame = pd.DataFrame(dict(zip(("key", "around", "row", "place"), map(np.concatenate, zip(*parts)))))
                frame = frame.drop_duplicates(["key", "around"])
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    listed = rows.select("row", "text").mapInArrow(build, "key long, around long, row long, place long")
    one = listed.groupBy("key", "around").agg(F.min("row").alias("row"), F.min_by("place", "row").alias("place"))
    return one.select("key", F.lit(0).cast("long").alias("follow"), "row", "place")


def _neighbours(suffixes: DataFrame, spool: TableSpool) -> tuple[DataFrame, DataFrame]:
    """(row, place, other, there): each suffix with a neighbour of equal key and follow, and (key): the
    keys under which follows differ. Two suffixes that are alone under their key are paired at once."""
    order = ["key", "follow", "row", "place"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = "key long, follow long, row long, place long, other long, there long, kind int"
    pair, torn, edge = 0, 1, 2

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        key, follow, row, place = (frame[c].to_numpy() for c in order)
        alike = np.r_[False, key[1:] == key[:-1], False]  # with the one before
        equal = alike.copy()
        equal[1:-1] &= follow[1:] == follow[:-1]
        later = np.flatnonzero(equal[:-1])
        first = np.flatnonzero(equal[1:] & ~equal[:-1])
        differ = np.flatnonzero(alike[:-1] & ~equal[:-1])
        # of a group whose ends lie in this frame, that holds these two and no other
        inner = differ[(differ > 1) & (differ < len(key) - 1)]
        two = inner[~alike[inner - 1] & ~alike[inner + 1]]
        rest = np.unique(key[np.setdiff1d(differ, two)])
        at, other = np.r_[later, first, two, two - 1], np.r_[later - 1, first + 1, two - 1, two]
        pairs = {"key": 0, "follow": 0, "row": row[at], "place": place[at], "other": row[other], "there": place[other], "kind": pair}
        open_keys = {"key": rest, "follow": 0, "row": 0, "place": 0, "other": 0, "there": 0, "kind": torn}
        return pd.concat([pd.DataFrame(pairs), pd.DataFrame(open_keys)])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, None
        for frame in frames:
            if not len(frame):
                continue
            if first is None:
                first = frame[:1]
            # the last row of a batch is the first of the next, so that no neighbours are torn apart
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = frame[-1:]
            yield within(frame)
        if held is not None:
            for end in (first, held):
                yield end.assign(other=0, there=0, kind=edge)[[*order, "other", "there", "kind"]]

    found = spool.cut(ordered.mapInPandas(compare, shape), "neighbours")
    # two rows of each range: where a group goes on in the next range
    by_key = Window.partitionBy("key").orderBy("follow", "row", "place")
    edges = found.where(F.col("kind") == edge).select(*order).distinct()
    at = F.struct("row", "place")
    edges = edges.withColumn("near", F.array(F.lag(at).over(by_key), F.lead(at).over(by_key)))
    edges = edges.select("key", "row", "place", F.explode("near").alias("near")).where("near IS NOT NULL")
    pairs = found.where(F.col("kind") == pair).select("row", "place", "other", "there")
    pairs = pairs.unionByName(
        edges.select("row", "place", F.col("near.row").alias("other"), F.col("near.place").alias("there"))
    )
    return pairs, found.where(F.col("kind") == torn).select("key").unionByName(edges.select("key"))


def _packed(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, doc_id, packed): compressed texts of the rows asked for and maybe a few more."""
    marks = marks_of(asked)
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, packer = np.unpackbits(sent.value).astype(bool), zstandard.ZstdCompressor(3)
        for batch in batches:
            batch = batch.filter(pa.array(marked[slot_of(batch.column(0).to_numpy(), len(marked))]))
            packed = [packer.compress(text.encode()) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["row", "doc_id", "packed"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(pack, f"row long, doc_id {kind}, packed binary")


def _extended(text: bytes, other: bytes, same: bool, seeds, passage: int) -> list[tuple[int, int, int]]:
    """(start, stop, there) of the longest matches through the seeds (place, there), in words."""
    a = word_hashes(text)[0]
    b = a if same else word_hashes(other)[0]
    found = []
    shifts: dict[int, list[int]] = {}
    for seed in seeds:
        shifts.setdefault(seed["there"] - seed["place"], []).append(seed["place"])
    for shift, places in sorted(shifts.items()):
        low, high = max(0, -shift), min(len(a), len(b) - shift)
        agree = np.zeros(high - low + 2, bool)
        agree[1:-1] = a[low:high] == b[low + shift : high + shift]
        edges = np.flatnonzero(agree[1:] != agree[:-1]) + low
        starts, stops = edges[::2], edges[1::2]
        for i in np.unique(np.searchsorted(starts, places, "right") - 1):
            if i >= 0 and stops[i] - starts[i] >= passage:
                found.append((int(starts[i]), int(stops[i]), int(starts[i]) + shift))
    return found


def repeated_passages(
    docs: DataFrame,
    passage: int = PASSAGE,
    gram: int = GRAM,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per passage of ``passage`` words or more that a row of a stored table shares with another
    row or place: doc_id, start, stop (code points), n_words, first_word, other_doc_id, other_word.

    Words are runs without white space and are compared as they are. Every repeated passage of
    ``passage`` words lies in such a row for each text and place that holds it, the first copy too;
    passages may overlap. ``passage`` must be at least gram + window - 1. Null, empty and short texts
    have none; repeated rows are each other's copies; null ids are reported like others. Bit maps of a
    fixed size say which keys and rows are asked for; beyond what they tell apart more is read, with
    equal results.
    """
    spool = TableSpool(docs.sparkSession, "passages")
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    near, open_keys = _neighbours(spool.cut(sparse_suffixes(rows, passage, gram, window), "suffixes"), spool)
    marks = marks_of(open_keys)
    if marks.any():
        listed = spool.cut(_open_passages(rows, marks, passage, gram, window), "open")
        near = near.unionByName(_neighbours(listed, spool)[0])
    # of many seeds in a row on one diagonal all belong to one match; a text has few per word
    seeds = spool.cut(near.groupBy("row", "other").agg(F.collect_set(F.struct("place", "there")).alias("seeds")), "seeds")
    texts = _packed(rows, seeds.select(F.explode(F.array("row", "other")).alias("row")))
    mine = texts.join(seeds, "row")
    theirs = texts.select(F.col("row").alias("other"), F.col("doc_id").alias("other_doc_id"), F.col("packed").alias("other_packed"))
    both = mine.join(theirs, "other").select(
        "doc_id", "packed", "other_doc_id", "other_packed", (F.col("row") == F.col("other")).alias("same"), "seeds"
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at, spans = [], []
            columns = [batch.column(name) for name in ("packed", "other_packed", "same", "seeds")]
            for i, (mine, theirs, same, seeds) in enumerate(zip(*columns)):
                text = unpack(mine.as_py())
                found = _extended(text, unpack(theirs.as_py()), same.as_py(), seeds.as_py(), passage)
                if found:
                    words = [m.span() for m in _WORDS.finditer(text.decode())]
                    for start, stop, there in found:
                        at.append(i)
                        spans.append((words[start][0], words[stop - 1][1], stop - start, start, there))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("other_doc_id").take(take)]
                + [pa.array([s[i] for s in spans], pa.int64()) for i in range(5)],
                ["doc_id", "other_doc_id", "start", "stop", "n_words", "first_word", "other_word"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, other_doc_id {kind}, start long, stop long, n_words long, first_word long, other_word long"
    return both.mapInArrow(extend, shape)
