"""Model responses: lenient JSON and the fields of each kind of answer.

A response is text. What can be read of it becomes typed columns; what cannot becomes null,
never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import blank_to_null, strip


def extract_json(text: Column) -> Column:
    """The JSON object or array of a response as a variant, null if there is none.

    A fenced block wins over the text around it; else everything between the outermost
    brackets counts. Wrapped into an array before parsing, since the parser overlooks what
    follows a complete value.
    """
    trimmed = strip(text)
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    body = F.when(trimmed.rlike(fence), strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    span = blank_to_null(F.regexp_extract(body, r"[\[{][\s\S]*[\]}]", 0))
    wrapped = F.try_parse_json(F.concat(F.lit("["), span, F.lit("]")))
    return F.try_variant_get(wrapped, "$[0]", "variant")


def unfenced_json(text: Column) -> Column:
    """A response that must be JSON, but for a fence around it; null otherwise."""
    trimmed = strip(text)
    inner = F.regexp_replace(trimmed, r"^```[^\n]*\n?", "")
    # up to the last closing fence, or all of it if none follows
    inner = F.when(F.contains(inner, F.lit("```")), F.regexp_extract(inner, r"^([\s\S]*)```", 1)).otherwise(inner)
    body = F.when(F.startswith(trimmed, F.lit("```")), inner).otherwise(trimmed)
    wrapped = F.try_parse_json(F.concat(F.lit("["), blank_to_null(strip(body)), F.lit("]")))
    return F.try_variant_get(wrapped, "$[0]", "variant")


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def items(v: Column) -> Column:
    """The elements of an array answer; an object answer is one element."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(is_array(v), many).when(is_object(v), F.array(v))


def score_value(answer: Column) -> Column:
    """Score of one answer, kept within 1 and 100."""
    raw = F.floor(field(answer, "score", "double")).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(100), raw))


def reasoning_text(answer: Column) -> Column:
    """Reasoning followed by lines of pros and cons, where there are any."""
    out = F.coalesce(field(answer, "reasoning"), F.lit(""))
    for name, label in (("pros", "Pros"), ("cons", "Cons")):
        listed = F.coalesce(field(answer, name, "array<string>"), F.array().cast("array<string>"))
        out = F.concat(
            out,
            F.when(F.size(listed) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(listed, "; "))).otherwise(""),
        )
    return out


def skills(answer: Column, limit: int | None = None) -> Column:
    """Trimmed skills of one answer without empty entries; only the first ``limit`` if one is given."""
    listed = F.filter(field(answer, "skills", "array<string>"), lambda s: F.length(s) > 0)
    trimmed = F.transform(listed, strip)
    return trimmed if limit is None else F.slice(trimmed, 1, limit)


def salary_estimate(answer: Column) -> Column:
    """Struct(min, max, currency) of one answer; null if it gives neither bound.

    A bound of zero is no bound, but still an answer.
    """
    low, high = field(answer, "min", "double"), field(answer, "max", "double")
    return F.when(
        low.isNotNull() | high.isNotNull(),
        F.struct(
            F.when(low != 0, low).alias("min"),
            F.when(high != 0, high).alias("max"),
            F.coalesce(field(answer, "currency"), F.lit("USD")).alias("currency"),
        ),
    )


def language_answer(answer: Column) -> Column:
    """Struct(listing_language, language_required, confidence), with the usual defaults."""
    return F.struct(
        F.coalesce(field(answer, "listing_language"), F.lit("unknown")).alias("listing_language"),
        F.coalesce(field(answer, "language_required"), F.lit("unknown")).alias("language_required"),
        F.coalesce(
            field(answer, "confidence"), F.when(is_object(answer), "medium").otherwise("low")
        ).alias("confidence"),
    )
