"""Document fingerprints of spot signatures.

A spot is an occurrence of a common word (an anchor); its signature is the anchor with the chain of
content words that follow, anchors in between left out. A text's fingerprint is the set of its
signatures. Sets are compared by Jaccard similarity; pairs of sets whose lengths alone rule out the
similarity asked for are never compared, since sets are partitioned by length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacancia.functions.text import let
from vacancia.session import TableSpool

from .common import id_and_text

#: Anchors, common words of four languages.
ANCHORS = """
    the of and to in a is that it was for on are as with be at by this have from or an not but
    der die das und ist von zu den mit ein eine im auf für nicht des dem sich auch es
    le la les de et un une est en que qui dans pour pas au sur il par du ce
    el los las y una por con para no se lo del su al como más
""".split()
#: Content words to a chain, and how many words after the anchor they are looked for in.
CHAIN = 2
REACH = 8
SIMILARITY = 0.8


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct 31-bit hashes of a text's spot signatures.

    A text without a whole spot takes every word as an anchor, one too short for that is a signature
    as a whole; a text without any word is one signature of itself, an empty one has none.
    """

    def hashed(*words: Column) -> Column:
        return F.xxhash64(*words).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def spots(words: Column) -> Column:
        def spot(word: Column, i: Column) -> Column:
            near = F.filter(F.slice(words, i + 2, F.lit(reach)), lambda w: ~w.isin(anchors))
            return F.when(
                word.isin(anchors),
                let(near, lambda n: F.when(F.size(n) >= chain, hashed(word, F.array_join(F.slice(n, 1, chain), " ")))),
            )

        return F.array_compact(F.transform(words, spot))

    def plain(words: Column) -> Column:
        every = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - chain, F.lit(0))),
            lambda w, i: hashed(F.array_join(F.slice(words, i + 1, F.lit(chain + 1)), " ")),
        )
        return F.when(F.size(words) > chain, every).otherwise(F.array(hashed(F.array_join(words, " "))))

    def of_words(words: Column) -> Column:
        found = let(spots(words), lambda s: F.when(F.size(s) > 0, s).when(F.size(words) > 0, plain(words)))
        alone = F.when(F.length(text) > 0, F.array(hashed(text))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.array_distinct(F.coalesce(found, alone)))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, of_words)


def fingerprint(found: Column) -> Column:
    """A set of signatures as one string."""
    return F.array_join(found, " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 1 for two empty ones; 0 where lengths rule out ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0)).otherwise(exact)


def similar_pairs(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs of different fingerprints whose likeness is ``least`` or more.

    ``pairs`` has (a, b, likeness) of classes, ``members`` (doc_id, class) of every row; equal
    fingerprints are one class, named by a hash of the set. Sets are partitioned by length so that
    similar ones lie in the same or in neighbouring partitions; there they meet if they share one of
    their first signatures, rare ones before common ones, as any two sets that similar must.
    """
    spool = TableSpool(docs.sparkSession, "spots")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", signatures(F.col("text")).alias("held"))
    rows = spool.cut(rows.withColumn("class", F.xxhash64("held")), "rows")
    # empty sets are alike only among themselves, and those are one class
    classes = rows.where(F.size("held") > 0).dropDuplicates(["class"]).select("class", "held")
    each = classes.select("class", F.size("held").alias("n"), F.explode("held").alias("spot"))
    counts = each.groupBy("spot").agg(F.count("*").alias("held_by")).where("held_by > 1")
    order = F.array_sort(F.collect_list(F.struct("held_by", "spot")))
    # a spot that no other class has can't meet anything; it still takes a place in front
    known = each.join(counts, "spot").groupBy("class", "n").agg(order.alias("spots"))
    first = F.col("n") - F.ceil(least * F.col("n")) + 1 - (F.col("n") - F.size("spots"))
    ring = F.floor(F.log("n") / -math.log(least))
    keyed = known.where(first > 0).select(
        "class", "n", ring.alias("ring"), F.explode(F.slice("spots", F.lit(1), first.cast("int"))).alias("s")
    )
    keyed = keyed.select("class", "n", "ring", F.col("s.spot").alias("spot"))
    left = keyed.select(F.col("class").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
    right = keyed.select(F.col("class").alias("b"), F.col("n").alias("nb"), "spot", "ring")
    met = left.join(right, ["spot", "ring"]).where((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = met.where(F.col("na") >= least * F.col("nb")).select("a", "b").distinct()
    sets = classes.select(F.col("class"), "held")
    pairs = (
        met.join(sets.withColumnsRenamed({"class": "a", "held": "ha"}), "a")
        .join(sets.withColumnsRenamed({"class": "b", "held": "hb"}), "b")
        .select("a", "b", likeness(F.col("ha"), F.col("hb"), least).alias("likeness"))
        .where(F.col("likeness") >= least)
    )
    return pairs, rows.select("doc_id", "class")


def _successors(rows: DataFrame, spool: TableSpool) -> DataFrame:
    """(row, next_row, n) by ascending id, null ids first; the last is followed by the first.

    Ids are dealt over ranges; the last row of a range is followed by the first of the next range
    that has any, of which there is one row for each partition.
    """
    ids = rows.select("doc_id", "row", F.length("text").alias("n"))
    ranged = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").withColumn("part", F.spark_partition_id())
    ranged = spool.cut(ranged, "ranged")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "row")).getField("row").alias("first"))
    onward = Window.orderBy("part")
    after = firsts.select(
        "part",
        F.coalesce(
            F.lead("first").over(onward),
            F.first("first").over(onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    held = ranged.withColumn("inside", F.lead("row").over(inside)).join(after, "part")
    return spool.cut(held.select("row", F.coalesce("inside", "after").alias("next_row"), "n"), "successors")


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a stored table: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, next_doc_id, length_class.

    The edited text has the last half of a text replaced by as much of the next document's start, by
    ascending id (null ids first, repeated ids in the table's order); after the last comes the first.
    A null text counts as empty; an empty table gives no rows.
    """
    spool = TableSpool(docs.sparkSession, "fingerprints")
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    order = _successors(rows, spool)
    asked = order.select(F.col("next_row").alias("row"), F.col("row").alias("for_row"), F.floor(F.col("n") / 2).alias("half"))
    # what a document gives to the one before it: its start and its signatures
    given = rows.join(asked, "row")  # reads the same columns as below, so both use one shuffle of the texts
    given = given.select(
        F.col("for_row").alias("row"),
        F.col("doc_id").alias("next_doc_id"),
        F.col("half").cast("int").alias("half"),
        F.substring("text", F.lit(1), F.col("half").cast("int")).alias("start"),
        signatures(F.col("text")).alias("next_held"),
    )
    texts = rows.join(given, "row").select(
        "doc_id",
        "next_doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "next_held",
        "text",
        F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("half")), "start").alias("edited"),
    )
    sets = texts.select(
        "doc_id",
        "n_chars",
        "next_doc_id",
        "next_held",
        F.sha2("edited", 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("held"),
        signatures(F.col("edited")).alias("edited_held"),
    )
    held, edited = F.col("held"), F.col("edited_held")
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(held).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        likeness(held, edited).alias("near_edited"),
        likeness(held, F.col("next_held")).alias("near_next"),
        "next_doc_id",
        F.floor(F.log(F.greatest(F.size(held), F.lit(1))) / -math.log(SIMILARITY)).alias("length_class"),
    )
