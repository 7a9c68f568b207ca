"""Jaccard similarity join of word shingles as a metric-space join.

1 - Jaccard is a metric, so distances to a pivot bound distances between documents. Two sets as
similar as asked for share one of their first shingles in any common order (rare shingles first);
every shingle that several sets share at the front elects one of them as its pivot, and the sets that
a pivot was elected for are its region: all links lie inside a region. Every member's distance to
its pivot is measured. Members within the threshold are linked through the pivot. What remains are
members beyond it and, by the triangle inequality, the boundary: members nearer to the pivot by no
more than the threshold than the nearest of those. They are joined anew: exactly, in one task, if
they are few. In a larger region those outside its largest component become pivots of it, some first
and in each further round several times as many, and meet it block by block; then what is left of the
region is joined in the same way, until no region holds two components that may still link.

Distances are measured in two steps: how often hashes of a set fall into each of a number of classes bounds
its intersection with any other from above, and only pairs that may link by that are measured exactly. The
number of classes follows the size of the set: in too few, all large sets of about one size look alike.

Regions of hot shingles do not arise, since order goes by how frequent a shingle is in all documents,
as a sketch of fixed size tells. Most shingles are in one document only; they are left out of the sketch
(see ``_frequencies``), or in a large table they alone would fill it and all shingles look alike.
Documents with equal sets are one member.
"""

from __future__ import annotations

from itertools import count
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacancia.session import TableSpool

from .common import components, id_and_text, may_match, small_batches
from .words import shingles

#: Counters of the frequency sketch, and the slices in which it is added up.
COUNTERS = 1 << 19
SLICES = 16
#: Shingles that are counted together for the sketch.
BLOCK = 1 << 21
#: Bits of the least and of the largest number of classes in the sketch that bounds intersections.
CLASS_BITS = 6, 14
#: Bits of the filter of rows whose sets are asked for.
FILTER_BITS = 1 << 23
#: Counters of sketches that are compared with one at a time.
GRID = 1 << 22
#: Members of a region, or of a block of a larger one, that one task compares with one another.
LOCAL = 256
#: Members of small regions that are handed to Python together; most regions hold two or three.
TOGETHER = 4096
#: In each round so many times more members of a large region ask than in the one before.
MORE = 4


def _summed(parts: DataFrame, join, kind, size: int) -> np.ndarray:
    """One array of a fixed size from slices of it (slice, part), put together with ``join``."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["part"].iloc[0], kind)
        for part in frame["part"].iloc[1:]:
            total = join(total, np.frombuffer(part, kind))
        return pd.DataFrame({"slice": frame["slice"][:1], "part": [total.tobytes()]})

    whole = np.zeros((SLICES, size // SLICES), kind)
    for row in parts.groupBy("slice").applyInPandas(add, "slice int, part binary").collect():
        whole[row["slice"]] = np.frombuffer(row["part"], kind)
    return whole.reshape(-1)


def _sliced(whole: np.ndarray) -> pa.RecordBatch:
    parts = [part.tobytes() for part in whole.reshape(SLICES, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])


def _frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle in each counter; the array has one size whatever the input.

    All texts are read and shingles counted block by block, and what only one set of a block holds is
    not added. A frequent shingle is in most blocks several times and loses little, while rare ones, which are nearly
    all and more with every document, stay out of the counters. The counts only say in which order shingles
    are taken, and any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        block, room = [], 0

        def add() -> None:
            held, times = np.unique(np.concatenate(block), return_counts=True)
            often = times > 1
            np.add.at(counts, (held[often] % np.uint64(COUNTERS)).astype(np.int64), times[often].astype(np.uint32))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                block.append(shingles(text, size))
                room += len(block[-1])
                if room >= BLOCK:
                    add()
                    block, room = [], 0
        if block:
            add()
        yield _sliced(counts)

    counted = rows.select("text").mapInArrow(count, "slice int, part binary")
    return _summed(counted, np.add, np.uint32, COUNTERS)


def _sketch(held: np.ndarray) -> bytes:
    """How many hashes of a set start with each number of some bits: four to a class at most, while the bits last.

    The first byte is the width of a counter, so that small sets take little room and none overflows.
    """
    bits = min(max((len(held) - 1).bit_length() - 2, CLASS_BITS[0]), CLASS_BITS[1])
    counts = np.bincount((held >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.dtype(np.uint8 if counts.max() < 256 else np.uint32)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _counts(sketch) -> np.ndarray:
    return np.frombuffer(sketch, f"u{memoryview(sketch)[0]}", offset=1)


def _folded(counts: np.ndarray, classes: int) -> np.ndarray:
    """Counters of a sketch in so many classes, as many as it has or fewer."""
    return counts.reshape(classes, -1).sum(1, dtype=np.uint32)


def _sets(rows: DataFrame, frequency, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n, one, two, front, sketch): each set's size, digest, first shingles and classes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.log2(frequency.value.astype(np.float64) + 1).astype(np.int64)
        for batch in batches:
            sizes, ones, twos, fronts, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                held = shingles(text, size)
                n = len(held)
                # two sets of which the smaller has n, and as similar as asked for, share n * percent / 100
                first = n - -(-n * percent // 100) + 1 if n else 0
                order = np.lexsort((held, rank[(held % np.uint64(COUNTERS)).astype(np.int64)]))
                sizes.append(n)
                ones.append(int(held.sum(dtype=np.uint64).astype(np.int64)))
                twos.append(int(np.bitwise_xor.reduce(held * held * np.uint64(0x9E3779B97F4A7C15) + held).astype(np.int64)) if n else 0)
                fronts.append(held[order[:first]].astype(np.int64))
                sketches.append(_sketch(held))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64())]
                + [pa.array(twos, pa.int64()), pa.array(fronts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "row", "n", "one", "two", "front", "sketch"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row", "text").mapInArrow(
        build, f"doc_id {kind}, row long, n long, one long, two long, front array<long>, sketch binary"
    )


def _held(rows: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(row, held): whole sets, as packed sorted hashes, of the rows asked for and maybe a few more.

    Texts are not shuffled: a bit map of a fixed size says which rows may be asked for.
    """
    slot = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    per_slice = FILTER_BITS // SLICES
    slots = asked.select(F.floor(slot / per_slice).cast("int").alias("slice"), (slot % per_slice).alias("bit")).distinct()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            marks[batch.column(0).to_numpy().astype(np.int64) * per_slice + batch.column(1).to_numpy()] = True
        if marks.any():
            yield _sliced(np.packbits(marks))

    bits = _summed(slots.mapInArrow(mark, "slice int, part binary"), np.bitwise_or, np.uint8, FILTER_BITS // 8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(marks[batch.column(2).to_numpy()]))
            held = [shingles(text, size).tobytes() for text in found.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array(held, pa.binary())], ["row", "held"])

    return rows.select("row", "text", slot.alias("slot")).mapInArrow(build, "row long, held binary")


def _shared(a, b) -> tuple[int, int]:
    """Sizes of intersection and union of two sets of sorted hashes, given packed."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n, len(a) + len(b) - n


def _at_most_shared(a, b) -> tuple[int, int]:
    """The same from two sketches: at most the one, at least the other."""
    a, b = _counts(a), _counts(b)
    classes = min(len(a), len(b))
    a, b = _folded(a, classes), _folded(b, classes)
    n = int(np.minimum(a, b).sum())
    return n, int(a.sum()) + int(b.sum()) - n


def _may_link(frame: pd.DataFrame, percent: int, sides: np.ndarray | None = None) -> pd.DataFrame:
    """(region, x, pivot) of members in different components, and on different sides, that may link by their sketches."""
    return _pairs(_linkable(frame["x"].to_numpy(), frame["label"].to_numpy(), frame["sketch"].to_numpy(), percent, sides))


def _pairs(found: np.ndarray) -> pd.DataFrame:
    found = np.sort(found, 1)
    return pd.DataFrame({"region": 0, "x": found[:, 0], "pivot": found[:, 1]})


def _linkable(rows: np.ndarray, labels: np.ndarray, sketches: np.ndarray, percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Pairs of a region's members for ``_may_link``; each two meet once, in the fewer classes of both."""
    found = [np.zeros((0, 2), np.int64)]
    counts = [_counts(s) for s in sketches]
    sizes = np.array([c.sum(dtype=np.int64) for c in counts])
    classes = np.array([len(c) for c in counts])
    for k in np.unique(classes):
        finer = np.flatnonzero(classes >= k)
        step = max(1, GRID // k)
        for block in (finer[i : i + step] for i in range(0, len(finer), step)):
            grid = np.array([_folded(counts[i], k) for i in block])
            for i in np.flatnonzero(classes == k):
                # of two with as many classes the first asks
                met = ((classes[block] > k) | (block > i)) & (labels[block] != labels[i])
                if sides is not None:
                    met &= sides[block] != sides[i]
                # what is too large or too small for the threshold needs no look at its classes
                low, high = np.minimum(sizes[block], sizes[i]), np.maximum(sizes[block], sizes[i])
                met = np.flatnonzero(met & (100 * low >= percent * high))
                both = np.minimum(counts[i], grid[met]).sum(1, dtype=np.int64)
                at = block[met]
                at = at[100 * both >= percent * (sizes[i] + sizes[at] - both)]
                found.append(np.stack([np.full(len(at), rows[i]), rows[at]], 1))
    return np.concatenate(found)


def _measured(pairs: DataFrame, held: DataFrame, sizes) -> DataFrame:
    """(region, x, pivot, both, either): sizes of intersection and union of members and pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sizes(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(3)] + [pa.array([f[i] for f in found], pa.int64()) for i in range(2)],
                ["region", "x", "pivot", "both", "either"],
            )

    found = pairs.select("region", "x", "pivot").join(held.toDF("x", "hx"), "x")
    found = found.join(held.toDF("pivot", "hp"), "pivot")
    shape = "region long, x long, pivot long, both long, either long"
    return found.select("region", "x", "pivot", "hx", "hp").mapInArrow(measure, shape)


class _Distances:
    """Distances of pairs of rows: exact where they may link, else a lower bound above the threshold."""

    def __init__(self, rows: DataFrame, sketches: DataFrame, size: int, percent: int, spool: TableSpool):
        self._rows, self._sketches, self._size, self._spool = rows, sketches, size, spool
        self._near = f"100 * both >= {percent} * either"

    def of(self, pairs: DataFrame) -> DataFrame:
        """(region, x, pivot, d, linked) for (region, x, pivot)."""
        bounds = self._spool.cut(_measured(pairs, self._sketches, _at_most_shared), "bounds")
        near = F.expr(self._near)
        far = bounds.where(~near).select("region", "x", "pivot", self._distance(), F.lit(False).alias("linked"))
        return self.exactly(bounds.where(near)).unionByName(far)

    def exactly(self, pairs: DataFrame) -> DataFrame:
        """The same for pairs of a stored table that may link by their sketches; whole sets move for them only."""
        asked = pairs.select(F.col("x").alias("row")).unionByName(pairs.select(F.col("pivot").alias("row")))
        held = self._spool.cut(_held(self._rows, asked, self._size), "held")
        exact = self._spool.cut(_measured(pairs, held, _shared), "exact")
        return exact.select("region", "x", "pivot", self._distance(), F.expr(self._near).alias("linked"))

    @staticmethod
    def _distance() -> Column:
        return (1 - F.col("both") / F.col("either")).alias("d")


def _meet(percent: int):
    """Pairs of small regions' members that are in different components and may link by their sketches."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("region")
        regions = frame["region"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1]]))
        rows, labels, sketches = frame["x"].to_numpy(), frame["label"].to_numpy(), frame["sketch"].to_numpy()
        found = [_linkable(rows[a:b], labels[a:b], sketches[a:b], percent) for a, b in zip(starts, [*starts[1:], len(frame)])]
        return _pairs(np.concatenate(found))

    return meet


class _Components:
    """Components of all links so far, written down; new links go on from them."""

    def __init__(self, spool: TableSpool):
        self._spool, self.reached = spool, None

    def add(self, links: DataFrame) -> None:
        """``links`` (a, b) of a stored table."""
        if self.reached is not None:
            if links.isEmpty():
                return
            links = links.unionByName(self.reached.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.reached = self._spool.cut(components(links, self._spool), "reached")


def _labelled(members: DataFrame, reached: DataFrame, spool: TableSpool) -> DataFrame:
    """Members of regions in which several components are left, with their component as label."""
    labels = F.coalesce("component", "x").alias("label")
    marked = members.join(reached.withColumnRenamed("node", "x"), "x", "left")
    marked = marked.select("region", "x", "d", labels)
    mixed = marked.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    mixed = mixed.where("low <> high").select("region", "members")
    return spool.cut(marked.join(mixed, "region"), "members")


def _meet_asked(percent: int):
    """Pairs of an asking member and a member of its block that are in different components and may link."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return _may_link(frame, percent, frame["asks"].to_numpy())

    return meet


def _asking(members: DataFrame, most: int, salt: int, spool: TableSpool) -> DataFrame:
    """(region, x, label, members, asking): members outside the largest component of their region, about ``most``
    at a time, as a hash deals them out, and how many are meant to ask.

    Those of the largest component need not ask: whoever may join it asks them.
    """
    sizes = members.groupBy("region", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("region").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    main = main.select("region", F.col("main.label").alias("main"), (F.col("all") - F.col("main.n")).alias("others"))
    turns = F.ceil(F.col("others") / most)
    others = members.join(main, "region").where("label <> main")
    asking = others.where(F.pmod(F.xxhash64("x", F.lit(salt)), turns) == 0)
    asked = F.ceil(F.col("others") / turns).alias("asking")
    return spool.cut(asking.select("region", "x", "label", "members", asked), "asking")


def _asked_blocks(members: DataFrame, asking: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(region, x, pivot) of asking members and others of their region; a task holds a block of both."""
    blocks, groups = (F.ceil(F.col(c) / LOCAL).cast("int") for c in ("members", "asking"))
    own = lambda count: F.pmod(F.xxhash64("x"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    asked = members.join(asking.select("region", "asking").distinct(), "region")
    asked = asked.withColumn("group", every(groups))
    asked = asked.select("region", own(blocks).alias("block"), "group", "x", "label", F.lit(False).alias("asks"))
    asks = asking.withColumn("block", every(blocks))
    asks = asks.select("region", "block", own(groups).alias("group"), "x", "label", F.lit(True).alias("asks"))
    both = asked.unionByName(asks).join(sketches.withColumnRenamed("row", "x"), "x")
    return both.groupBy("region", "block", "group").applyInPandas(_meet_asked(percent), "region long, x long, pivot long")


def shingle_components(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of a stored table: doc_id, n_shingles, component_id.

    Sets are the distinct shingles of ``size`` words (all words where there are fewer), A-Z in lower
    case. Two documents link when 100 * intersection >= percent * union; component_id is the smallest
    id that links reach. A text without words (or null) links with nothing and keeps its own id. Null
    ids take part and get the smallest id of their component, null if it has none; repeated rows are
    in one component. An empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    placed = shingle_groups(docs, size, percent, id_col, text_col)
    smallest = placed.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("smallest"))
    return placed.join(smallest, "group", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def shingle_groups(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of a stored table: doc_id, row, n_shingles, group.

    ``row`` is the number that ``row_number`` gives the row, and ``group`` names its component (see
    ``shingle_components``); it is null for a text without words.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, size, percent, id_col, text_col)


def row_number() -> Column:
    """A number for each row of a stored table, the same whenever the table is read."""
    return F.monotonically_increasing_id()


def _groups(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """All steps are written before the result is read, which needs no Python."""
    spark = docs.sparkSession
    spool = TableSpool(spark, "shingle-join")
    rows = id_and_text(docs, id_col, text_col).withColumn("row", row_number())
    frequency = spark.sparkContext.broadcast(_frequencies(rows, size))
    sets = spool.cut(_sets(rows, frequency, size, percent), "sets")
    digest = ["n", "one", "two"]
    classes = sets.where("n > 0").groupBy(*digest).agg(F.min("row").alias("rep"), F.count("*").alias("members"))
    classes = spool.cut(classes, "classes")
    # of equal sets one member goes on, the first row; only fronts that may be of others are shuffled to drop them
    copies = sets.join(classes.where("members > 1").drop("members"), digest).where("row <> rep").select("row")
    copies = spool.cut(copies, "copies")
    fronts = may_match(sets.where("n > 0").select("row", "front"), copies, "row")
    firsts = fronts.where("may").join(copies, "row", "left_anti")
    fronts = fronts.where("NOT may").select("row", "front").unionByName(firsts.select("row", "front"))
    tokens = fronts.select(F.col("row").alias("x"), F.explode("front").alias("token"))
    elected = tokens.groupBy("token").agg(F.min("x").alias("pivot"), F.count("*").alias("members"))
    elected = elected.where("members > 1").select("token", "pivot")
    pairs = spool.cut(tokens.join(elected, "token").where("x <> pivot").select("x", "pivot").distinct(), "pairs")
    sketches = sets.select("row", "sketch")
    distances = _Distances(rows, sketches, size, percent, spool)
    linked = F.col("linked")
    ends = (F.col("x").alias("a"), F.col("pivot").alias("b"))

    measured = distances.of(pairs.withColumn("region", F.col("pivot")))
    joined = _Components(spool)
    joined.add(spool.cut(measured.where(linked).select(*ends), "links"))
    reach = 1 - percent / 100 + 1e-9
    beyond = measured.where(~linked).groupBy("region").agg(F.min("d").alias("nearest"))
    members = measured.join(beyond, "region").where(~linked | (F.col("d") >= F.col("nearest") - reach))
    members = _labelled(members.select("region", "x", "d"), joined.reached, spool)
    for turn in count():
        few, many = members.where(F.col("members") <= LOCAL), members.where(F.col("members") > LOCAL)
        more = not many.isEmpty()
        local = few.select("region", "x", "label").join(sketches.withColumnRenamed("row", "x"), "x")
        local = local.withColumn("deal", F.pmod(F.xxhash64("region"), F.lit(few.count() // TOGETHER + 1)))
        met = local.groupBy("deal").applyInPandas(_meet(percent), "region long, x long, pivot long").distinct()
        if more:
            asking = _asking(many, LOCAL * MORE**turn, turn, spool)
            met = met.unionByName(_asked_blocks(many, asking, sketches, percent)).distinct()
        found = distances.exactly(spool.cut(met, "met")).where(linked).select(*ends)
        joined.add(spool.cut(found, "links"))
        if not more:
            break
        left = many.join(asking.select("region", "x"), ["region", "x"], "left_anti")
        members = _labelled(left.select("region", "x", "d"), joined.reached, spool)
        if members.isEmpty():
            break

    reached = joined.reached
    grouped = classes.drop("members").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select(*digest, F.coalesce("component", "rep").alias("group"))
    placed = spool.cut(sets.select("doc_id", "row", *digest).join(grouped, digest, "left"), "placed")
    return placed.select("doc_id", "row", F.col("n").alias("n_shingles"), "group")
