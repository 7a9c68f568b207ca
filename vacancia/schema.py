"""The 25-field posting row, its types and the frames built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_S, _D, _B, _I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()

# Field order and types of a posting.
POSTING_FIELDS: dict[str, T.DataType] = {
    "source": _S,
    "ats_platform": _S,
    "title": _S,
    "company": _S,
    "location": _S,
    "country": _S,
    "date_posted": _S,
    "job_type": _S,
    "experience_level": _S,
    "is_remote": _B,
    "salary_min": _D,
    "salary_max": _D,
    "salary_currency": _S,
    "salary_interval": _S,
    "job_url": _S,
    "company_url": _S,
    "description": _S,
    "listing_language": _S,
    "language_required": _S,
    "ai_detected_language": _S,
    "language": _S,
    "ai_score": _I,
    "ai_reasoning": _S,
    "ai_cover_letter": _S,
    "ai_resume_bullets": _S,
}

REQUIRED_FIELDS = ("title", "job_url")

# Columns that enrichment adds beside the fixed schema.
ENRICHMENT_FIELDS: dict[str, T.DataType] = {
    "skills": T.ArrayType(_S),
    "salary_estimated_min": _D,
    "salary_estimated_max": _D,
    "salary_estimated_currency": _S,
}

POSTING_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(name, kind) for name, kind in POSTING_FIELDS.items()]
)


def empty_postings(spark: SparkSession) -> DataFrame:
    """A posting frame without rows, for runs whose feeds gave nothing."""
    return spark.createDataFrame([], POSTING_SCHEMA)


def posting_columns(values: dict[str, Column]) -> list[Column]:
    """All 25 posting columns in order; fields that a feed lacks become typed nulls."""
    unknown = set(values) - set(POSTING_FIELDS)
    if unknown:
        raise ValueError(f"not posting fields: {sorted(unknown)}")
    return [
        (values[name] if name in values else F.lit(None)).cast(kind).alias(name)
        for name, kind in POSTING_FIELDS.items()
    ]


def conform_schema(df: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Add missing posting fields as null, drop the rest, fix the order.

    Types stay as they come; see ``operators.normalize.coerce_types`` for those.
    """
    present = set(df.columns)
    kept = [F.col(c) for c in keep if c in present]
    fields = [
        F.col(name) if name in present else F.lit(None).cast(kind).alias(name)
        for name, kind in POSTING_FIELDS.items()
    ]
    return df.select(*kept, *fields)
