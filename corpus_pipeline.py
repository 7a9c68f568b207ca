"""Training text from raw documents: toxic ones out, repeated lines and near copies out, secrets
masked, the rest packed into sequences."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vacancia.functions.text import let  # noqa: E402
from vacancia.llm.common import documents, may_match  # noqa: E402
from vacancia.llm.line_dedup import dedup_lines  # noqa: E402
from vacancia.llm.packing import pack  # noqa: E402
from vacancia.llm.secret_scan import scan_secrets  # noqa: E402
from vacancia.llm.shingle_join import row_number, shingle_groups  # noqa: E402
from vacancia.llm.toxicity import learn, score_toxicity  # noqa: E402
from vacancia.session import TableSpool  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"
#: Near copies share at least so many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labelled ones of its input."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document that loses all its lines goes."""
    done = dedup_lines(docs, keep=("text", "lang", "source", "n_chars"))
    untouched = F.col("n_deleted") == 0
    kept = done.where(untouched | (F.col("n_deleted") < F.col("n_lines")))
    text = F.when(untouched, F.col("text")).otherwise(F.col("kept_text"))
    count = F.when(untouched, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", count.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, null ids last, and the first row of it.

    Rows are told apart by their number, since ids may repeat or be null. Texts without words all stay.
    Only texts that may be among the dropped ones are shuffled.
    """
    groups = shingle_groups(docs, NEAR_WORDS, NEAR_PERCENT).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = groups.groupBy("group").agg(F.min(place).getField("row").alias("first"), F.count("*").alias("members"))
    dropped = groups.join(first.where("members > 1"), "group").where("row <> first").select("row")
    dropped = TableSpool(spark, "near-copies").cut(dropped, "dropped")
    numbered = may_match(docs.withColumn("row", row_number()), dropped, "row")
    left = numbered.where("may").join(dropped, "row", "left_anti")
    return numbered.where("NOT may").select(*COLUMNS).unionByName(left.select(*COLUMNS))


def _masked(text: Column, found: Column) -> Column:
    """A text with each found span as MASK; spans that overlap are masked together."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        piece = F.concat(
            state["out"],
            F.substring(text, (state["at"] + 1).cast("int"), F.greatest(start - state["at"], F.lit(0)).cast("int")),
            F.when(span["start"] >= state["at"], F.lit(MASK)).otherwise(""),
        )
        return F.struct(F.greatest(span["stop"], state["at"]).alias("at"), piece.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return let(F.aggregate(found, begin, step), rest)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in their texts."""
    found = scan_secrets(docs, keep=("text", "lang", "source", "n_chars"))
    some = F.size("found") > 0
    masked = found.withColumn("masked", F.when(some, _masked(F.col("text"), F.col("found"))))
    return masked.select(
        "doc_id",
        F.when(some, F.col("masked")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(some, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again by the next."""
    spool = TableSpool(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spool.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
