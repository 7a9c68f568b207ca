"""Model answers back onto postings.

The engine writes prompt batches to a table, an external system answers them into another,
and these operators join the answers. Batches hold at most a few rows, so all work within a
batch is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import prompts as P, responses as R
from ..functions.text import blank_to_null
from .filters import needs_ai_language, needs_salary_estimate
from .ordering import best_score_first, with_batches


def prompt_batches(postings: DataFrame, kind: str, size: int = V.MODEL_BATCH) -> DataFrame:
    """(batch_id, jobs_block): the postings of a batch as one text, in order."""
    if kind == "salary":
        postings = needs_salary_estimate(postings)
    elif kind == "language":
        postings = needs_ai_language(postings)
    batched = with_batches(postings, size)
    blocks = batched.select("batch_id", "idx", P.BLOCKS[kind](F.col("idx")).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "block")))
    return blocks.groupBy("batch_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["block"]), P.BATCH_JOINERS[kind]).alias("jobs_block")
    )


def answers_by_index(responses: DataFrame, value: Column, size: int = V.MODEL_BATCH) -> DataFrame:
    """(batch_id, idx, value) of answers that name their posting by its index in the batch.

    ``value`` is built over a variant column ``answer``. An index outside the batch is
    dropped, of a repeated one the last answer counts, an answer that is a lone object
    belongs to the first posting.
    """
    parsed = responses.select("batch_id", R.unfenced_json(F.col("response")).alias("_parsed"))
    each = parsed.select("batch_id", R.is_object(F.col("_parsed")).alias("_lone"), F.posexplode(R.items(F.col("_parsed"))).alias("_pos", "answer"))
    named = F.coalesce(R.field(F.col("answer"), "job_index", "int"), F.lit(-1))
    typed = each.select(
        "batch_id", "_pos", F.when(F.col("_lone"), F.lit(0)).otherwise(named).alias("idx"), value.alias("value")
    ).filter(F.col("idx").between(0, size - 1))
    return typed.groupBy("batch_id", "idx").agg(F.max_by("value", "_pos").alias("value"))


def join_answers(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with their answer as ``value``, null where none came."""
    return batched.join(answers, ["batch_id", "idx"], "left")


def apply_skills(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``skills``; postings without an answer have none."""
    value = F.struct(R.skills(F.col("answer")).alias("skills"))
    joined = join_answers(batched, answers_by_index(responses, value))
    return joined.withColumn(
        "skills", F.coalesce(F.col("value.skills"), F.array().cast("array<string>"))
    ).drop("value")


def _with_answers(postings: DataFrame, asked: DataFrame, responses: DataFrame, value: Column) -> DataFrame:
    """All postings, with the answer to those that were asked about as ``value``.

    ``asked`` has (seq, batch_id, idx) of the postings that went into batches.
    """
    given = asked.select("seq", "batch_id", "idx").join(answers_by_index(responses, value), ["batch_id", "idx"])
    return postings.join(given.select("seq", "value"), "seq", "left")


def apply_salary_estimates(postings: DataFrame, asked: DataFrame, responses: DataFrame) -> DataFrame:
    """All postings with the estimated salary bounds and currency.

    A posting without an estimate keeps the one it had, null if it had none.
    """
    joined = _with_answers(postings, asked, responses, R.salary_estimate(F.col("answer")))

    def estimated(name: str) -> Column:
        before = f"salary_estimated_{name}"
        value = F.when(F.col("value").isNotNull(), F.col(f"value.{name}"))
        return value.otherwise(F.col(before)) if before in postings.columns else value

    return joined.withColumns({f"salary_estimated_{name}": estimated(name) for name in ("min", "max", "currency")}).drop("value")


def backfill_ai_language(postings: DataFrame, asked: DataFrame, responses: DataFrame) -> DataFrame:
    """All postings, with the model's answer stored and languages filled with it where they are unknown."""
    joined = _with_answers(postings, asked, responses, R.language_answer(F.col("answer")))
    said_required, said_listing = F.col("value.language_required"), F.col("value.listing_language")

    def unknown(c: str) -> Column:
        return F.coalesce(blank_to_null(F.col(c)), F.lit("unknown")) == "unknown"

    def known(c: Column) -> Column:
        return F.coalesce((F.length(c) > 0) & (c != "unknown"), F.lit(False))

    fill_required = known(said_required) & unknown("language_required")
    return joined.withColumns(
        {
            "ai_detected_language": F.when(
                F.col("value").isNotNull(),
                F.coalesce(blank_to_null(said_required), blank_to_null(said_listing), F.lit("")),
            ).otherwise(F.col("ai_detected_language")),
            "listing_language": F.when(known(said_listing) & unknown("listing_language"), said_listing).otherwise(
                F.col("listing_language")
            ),
            "language_required": F.when(fill_required, said_required).otherwise(F.col("language_required")),
            "language": F.when(fill_required, said_required).otherwise(F.col("language")),
        }
    ).drop("value")


# Reasons given in place of an answer.
NO_RESPONSE = "Model returned no usable response"
NOT_PARSED = "Failed to parse AI response"
MISSING = "Missing from batch response"


def scores_by_position(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``ai_score``, ``ai_reasoning``, ``ai_pros`` and ``ai_cons`` from the answer in the
    same place of the batch. A batch with fewer answers than rows scores the others 0.
    """
    parsed = responses.select(
        "batch_id",
        (F.coalesce(F.length("response"), F.lit(0)) > 0).alias("_came"),
        R.extract_json(F.col("response")).alias("_parsed"),
    )
    state = parsed.select(
        "batch_id",
        F.when(~F.col("_came"), NO_RESPONSE).when(R.items(F.col("_parsed")).isNull(), NOT_PARSED).alias("_failure"),
        F.lit(True).alias("_asked"),
    )
    none = F.array().cast("array<string>")
    answers = parsed.select("batch_id", F.posexplode(R.items(F.col("_parsed"))).alias("idx", "answer")).select(
        "batch_id",
        "idx",
        F.coalesce(R.score_value(F.col("answer")), F.lit(1)).alias("_score"),
        R.reasoning_text(F.col("answer")).alias("_reasoning"),
        F.coalesce(R.field(F.col("answer"), "pros", "array<string>"), none).alias("_pros"),
        F.coalesce(R.field(F.col("answer"), "cons", "array<string>"), none).alias("_cons"),
    )
    joined = batched.join(state, "batch_id", "left").join(answers, ["batch_id", "idx"], "left")
    reason = F.coalesce(
        F.col("_reasoning"), F.col("_failure"), F.when(F.col("_asked"), MISSING).otherwise(NO_RESPONSE)
    )
    return joined.withColumns(
        {
            "ai_score": F.coalesce(F.col("_score"), F.lit(0)).cast("int"),
            "ai_reasoning": reason,
            "ai_pros": F.coalesce(F.col("_pros"), none),
            "ai_cons": F.coalesce(F.col("_cons"), none),
        }
    ).drop("_score", "_reasoning", "_pros", "_cons", "_failure", "_asked")


def apply_scores(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """Scored postings, best first."""
    return best_score_first(scores_by_position(batched, responses))
