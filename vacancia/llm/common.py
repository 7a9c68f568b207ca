"""What the operators share: inputs, per-process caches, whole components."""

from __future__ import annotations

import gc
import sys
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacancia.session import TableSpool

#: White space as the word rules of the operators see it.
SPACE = r"[\x20\x09-\x0D]+"

#: Bits of the map that says which rows a join may match.
MATCH_BITS = 1 << 23


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; any other path can be given to an operator instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as doc_id and text; a missing text is an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def may_match(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with a flag ``may``: false only where no row of ``keys`` has the row's key, or it is null.

    Rows with wide columns need not be shuffled to a join that they can't match. The map of the keys'
    hashes has a fixed size whatever their number is; where it is full, all rows may match.
    """
    if rows.schema[key].dataType != keys.schema[key].dataType:  # equal keys of two types may hash differently
        return rows.withColumn("may", F.col(key).isNotNull())
    slot = F.pmod(F.xxhash64(key), F.lit(MATCH_BITS)) + 1
    maps = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("bucket"), "left")
    return joined.select(*rows.columns, (F.col(key).isNotNull() & F.coalesce(bit, F.lit(False))).alias("may"))


def per_process(key, make, large: bool = False):
    """``make()``, once for each Python process: tables and caches that outlive a task.

    ``large`` caches hold no cycles, so the collector's full passes over them are put off.
    """
    if large:
        gc.set_threshold(200_000, 50, 1000)
    held = sys.__dict__.setdefault("_vacancia_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Python workers get at most so many rows at a time, for operators whose rows carry whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, spool: TableSpool) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the edges (a, b).

    Alternates two star steps until no edge changes: each node links its larger neighbours to its
    smallest neighbour, then its smaller neighbours likewise. Every step is one shuffle of the
    edges; a node's neighbours are never gathered, only their minimum is, map-side first, and hot
    nodes meet it by a join whose larger side adaptive execution can split.
    """
    edges = spool.cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = spool.cut(large.where("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = spool.cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return top.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
