"""Tabular board rows, search queries and board choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..functions.text import first_filled, string_array, strip
from .common import to_postings


def map_board_rows(rows: DataFrame) -> DataFrame:
    """Rows of a board table: NaN is missing, the first filled link is the URL, rows without
    a link are dropped."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def get(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        c = F.col(name)
        return F.when(~F.isnan(c), c) if isinstance(kinds[name], (T.DoubleType, T.FloatType)) else c

    def number(name: str) -> Column:
        value = get(name).try_cast("double")
        return F.when(~F.isnan(value), value)

    posted = get("date_posted")
    if isinstance(kinds.get("date_posted"), (T.TimestampType, T.TimestampNTZType, T.DateType)):
        posted = F.date_format(posted, "yyyy-MM-dd")
    url = strip(first_filled(get("job_url"), get("job_url_direct"), get("link")))
    return to_postings(
        rows.withColumn("_url", url).filter(F.length("_url") > 0),
        {
            "source": F.lower(strip(F.coalesce(get("site"), F.lit("unknown")))),
            "title": get("title"),
            "company": get("company"),
            "location": get("location"),
            "country": get("country"),
            "date_posted": F.left(posted.cast("string"), F.lit(10)),
            "job_type": F.lower(strip(get("job_type"))),
            "is_remote": get("is_remote").try_cast("boolean"),
            "salary_min": number("min_amount"),
            "salary_max": number("max_amount"),
            "salary_currency": first_filled(get("currency").cast("string")),
            "salary_interval": first_filled(get("interval").cast("string")),
            "job_url": F.col("_url"),
            "company_url": get("company_url"),
            "description": get("description"),
        },
    )


def _fill(template: Column, keyword: Column, location: Column, placeholder: str) -> Column:
    return F.replace(F.replace(template, F.lit(placeholder), keyword), F.lit("{location}"), location)


def expand_queries(terms: DataFrame, location: str, language: str | None = None) -> DataFrame:
    """(term, query): every template filled with every term.

    The templates are a short fixed list, so they are exploded from a literal and nothing is
    joined.
    """
    templates = V.QUERY_TEMPLATES + V.LANGUAGE_QUERY_TEMPLATES.get(language or "", [])
    filled = terms.select("term", F.explode(string_array(templates)).alias("template"))
    return filled.select(
        "term", _fill(F.col("template"), F.col("term"), F.lit(location), "{keyword}").alias("query")
    )


def expand_or_queries(locations: DataFrame, terms: list[str]) -> DataFrame:
    """(location, query): one query per template and location, with all terms of the run."""
    either = " OR ".join(f'"{term}"' for term in terms)
    filled = locations.select("location", F.explode(string_array(V.OR_QUERY_TEMPLATES)).alias("template"))
    return filled.select(
        "location", _fill(F.col("template"), F.lit(either), F.col("location"), "{roles_or}").alias("query")
    )


def boards_for_country(country: Column) -> Column:
    """Boards to ask for a country: its own choice or the first three."""
    out = F.when(F.lit(False), string_array([]))
    for name, boards in V.COUNTRY_BOARDS.items():
        out = out.when(country == name, string_array(boards))
    return out.otherwise(string_array(V.DEFAULT_BOARDS))
