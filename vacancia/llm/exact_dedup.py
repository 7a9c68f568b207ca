"""Exact duplicates through a cuckoo-filter index of live digests.

Texts are equal when they are identical after every run of white space became one space; the
SHA-256 of that text is its digest. Digests are dealt over shards by their own bits. A shard keeps
a cuckoo filter of short fingerprints in front of buckets that hold whole digests: a miss in the
filter proves a digest new, a hit is verified against the bucket's content. Deleted digests leave
the filter as they leave the bucket; when a fingerprint finds no place the filter is built anew,
twice as large, from the digests the buckets store.

Copies are folded twice: each task folds the rows it has read, so a text that a third of all rows
share reaches its shard once per task; then the shards fold what the tasks found.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vacancia.session import TableSpool

from .common import SPACE, id_and_text

#: Digests a shard is meant to hold.
SHARD_DIGESTS = 50_000


class CuckooIndex:
    """Live digests with a value each; ``fold`` joins the value of a digest that is there already."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, fold, room: int = 1024):
        self._fold = fold
        self._content: dict[int, dict[bytes, tuple]] = {}
        self.resizes = 0
        self._allot(room)

    def _allot(self, room: int) -> None:
        self._buckets = 1 << max(2, (room // self.SLOTS - 1).bit_length())
        self._table = [[] for _ in range(self._buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") | 1 << 16
        one = int.from_bytes(digest[2:10], "big") % self._buckets
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 % self._buckets)

    def _mark(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for place in (one, two):
            if len(self._table[place]) < self.SLOTS:
                self._table[place].append(mark)
                return True
        place = one
        for turn in range(self.KICKS):
            row = self._table[place]
            mark, row[turn % self.SLOTS] = row[turn % self.SLOTS], mark
            place = self._other(place, mark)
            if len(self._table[place]) < self.SLOTS:
                self._table[place].append(mark)
                return True
        return False

    def _resize(self) -> None:
        self.resizes += 1
        stored = [digest for bucket in self._content.values() for digest in bucket]
        room = 2 * self._buckets * self.SLOTS
        while True:
            self._allot(room)
            if all(self._mark(digest) for digest in stored):
                return
            room *= 2

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says; False is certain."""
        mark, one, two = self._places(digest)
        return mark in self._table[one] or mark in self._table[two]

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "big")

    def get(self, digest: bytes):
        if not self.maybe(digest):
            return None
        return self._content.get(self._bucket(digest), {}).get(digest)

    def insert(self, digest: bytes, value: tuple) -> None:
        known = self.get(digest)
        if known is not None:
            self._content[self._bucket(digest)][digest] = self._fold(known, value)
            return
        self._content.setdefault(self._bucket(digest), {})[digest] = value
        if not self._mark(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False if it wasn't there."""
        if self.get(digest) is None:
            return False
        bucket = self._content[self._bucket(digest)]
        del bucket[digest]
        if not bucket:
            del self._content[self._bucket(digest)]
        mark, one, two = self._places(digest)
        self._table[one if mark in self._table[one] else two].remove(mark)
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self._content.values():
            yield from bucket.items()

    def __len__(self) -> int:
        return sum(map(len, self._content.values()))


def _first_and_total(a: tuple, b: tuple) -> tuple:
    return (min(a[0], b[0]), a[1] + b[1])


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each digest a task has live rows of, with the first of them by (null, id, row).

    A row with ``rows`` 0 is what is left of a deleted document: it holds no copy of its digest, and
    a digest that only such rows hold leaves the index.
    """
    index = CuckooIndex(_first_and_total)
    for frame in frames:
        for digest, absent, doc, row, rows in zip(frame.digest, frame.absent, frame.doc, frame.row, frame.rows):
            index.insert(digest, ((absent, doc, row), rows))
    for digest in [digest for digest, (_, rows) in index.items() if not rows]:
        index.delete(digest)
    found = [(digest, *first, rows) for digest, (first, rows) in index.items()]
    yield pd.DataFrame(found, columns=["digest", "absent", "doc", "row", "rows"])


def _fold(rows: DataFrame) -> DataFrame:
    return rows.mapInPandas(_folded, "digest binary, absent boolean, doc long, row long, rows long")


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each run of white space as one space."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", F.unhex(F.sha2(F.regexp_replace("text", SPACE, " "), 256)).alias("digest"))


def _owners(rows: DataFrame, shard_digests: int) -> DataFrame:
    """(digest, doc, row, rows): the first row of each digest and the number of its rows.

    The number of shards follows the number of rows; a shard's rows are one partition's.
    """
    shards = max(1, -(-rows.count() // shard_digests))
    keyed = _fold(rows).repartition(shards, "digest")
    return _fold(keyed)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = SHARD_DIGESTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; a null id comes after all others, and among
    rows that repeat an id exactly one stays. A null text counts as empty, and empty texts are
    equal to each other. An empty table gives no rows.
    """
    spool = TableSpool(docs.sparkSession, "exact-dedup")
    digests = text_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    digests = spool.cut(digests, "digests")
    rows = digests.select(
        "digest",
        F.col("doc_id").isNull().alias("absent"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        "row",
        F.lit(1).cast("long").alias("rows"),
    )
    owners = spool.cut(_owners(rows, shard_digests), "owners")
    owners = owners.select(
        "digest", F.when(~F.col("absent"), F.col("doc")).alias("keep_id"), F.col("row").alias("keep_row"), "rows"
    )
    return digests.join(owners, "digest").select(
        "doc_id",
        "keep_id",
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def apply_changes(changes: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """The live groups after a log of changes (seq long, deleted boolean, doc_id long, text string).

    The last change of a document and text counts. Digests of documents that were deleted go out of
    the index; equal texts that are still live keep theirs. Returns text_sha256, keep_id, group_size.
    Rows with a null seq come first; null deleted means not deleted.
    """
    spool = TableSpool(changes.sparkSession, "exact-changes")
    digest = text_digests(changes.withColumn("_doc", F.struct("seq", "deleted", "doc_id")), "_doc", "text")
    seq, gone = F.coalesce("doc_id.seq", F.lit(-(2**63))), F.coalesce("doc_id.deleted", F.lit(False))
    state = digest.groupBy("digest", F.col("doc_id.doc_id").alias("doc_id")).agg(
        F.max(F.struct(seq.alias("seq"), gone.alias("gone"))).alias("last")
    )
    dead, last = F.col("last.gone"), F.lit(2**63 - 1)
    rows = state.select(
        "digest",
        (dead | F.col("doc_id").isNull()).alias("absent"),
        F.when(dead, last).otherwise(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("doc"),
        F.lit(0).cast("long").alias("row"),
        F.when(dead, 0).otherwise(1).cast("long").alias("rows"),
    )
    live = _owners(spool.cut(rows, "state"), shard_digests)
    return live.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(~F.col("absent"), F.col("doc")).alias("keep_id"),
        F.col("rows").alias("group_size"),
    )
