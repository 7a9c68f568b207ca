"""Writing results. Files are written by all tasks; their order is the order of rows.

An export is checked: while rows are written, their number and a digest of each column are counted
along; then the files are read back and must give the same. Only after that a manifest is written
beside them, so a folder with a manifest holds a whole export.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .operators.companies import new_companies
from .operators.reports import export_columns, full_table, score_table, summary_table
from .schema import ENRICHMENT_FIELDS

#: Folder of the manifest within an export; readers of the export pass over it, as over all hidden ones.
MANIFEST = "_manifest"
MANIFEST_SHAPE = "kind string, name string, n_rows long, n_filled long, digest string"


class ExportError(RuntimeError):
    """What was read back is not what was written."""


def _tallies(df: DataFrame, blank_is_null: bool) -> list[Column]:
    """Rows, filled values and digest of each column, in any order of rows.

    A digest is a sum of hashes of values, so values may trade places between rows of a column but
    not between columns. ``blank_is_null`` takes empty text for missing, for formats that can't tell.
    """
    tallies = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        value = F.col(f"`{field.name}`")
        if blank_is_null and isinstance(field.dataType, T.StringType):
            value = F.when(value != "", value)
        number = F.when(value.isNotNull(), F.xxhash64(F.lit(field.name), value)).cast("decimal(38,0)")
        tallies += [F.count(value).alias(f"filled_{i}"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias(f"digest_{i}")]
    return tallies


def _export(df: DataFrame, path: str, write: Callable, read: Callable, blank_is_null: bool = False) -> DataFrame:
    """Write, read back, compare, and write and return the manifest.

    A manifest has rows (kind, name, n_rows, n_filled, digest): one of kind file for each data file
    with its number of rows, one of kind column for each column.
    """
    spark = df.sparkSession
    written = Observation()
    write(df.observe(written, *_tallies(df, blank_is_null)))
    back = read(spark.read.schema(df.schema))
    said, found = written.get, back.agg(*_tallies(back, blank_is_null)).first().asDict()
    wrong = [name for i, name in enumerate(df.columns) if any(said[f"{k}_{i}"] != found[f"{k}_{i}"] for k in ("filled", "digest"))]
    if said["rows"] != found["rows"] or wrong:
        raise ExportError(f"{path}: {said['rows']} rows written, {found['rows']} read back; columns that differ: {wrong}")
    columns = [("column", name, found["rows"], found[f"filled_{i}"], found[f"digest_{i}"]) for i, name in enumerate(df.columns)]
    files = back.select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count("*").alias("n_rows"))
    none = F.lit(None)
    files = files.select(F.lit("file").alias("kind"), "name", "n_rows", none.cast("long").alias("n_filled"), none.cast("string").alias("digest"))
    spark.createDataFrame(columns, MANIFEST_SHAPE).unionByName(files).coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the export at ``path``; an export that was not finished has none."""
    return spark.read.schema(MANIFEST_SHAPE).json(f"{path}/{MANIFEST}")


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """The 25 fields, newest first, every value quoted, with header; null becomes empty. Gives the manifest."""
    return _export(
        export_columns(df),
        path,
        lambda out: out.write.mode("overwrite").csv(
            path, header=True, quoteAll=True, escape='"', nullValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        ),
        lambda reader: read_csv(reader, path),
        blank_is_null=True,
    )


def read_csv(reader, path: str) -> DataFrame:
    """What ``write_csv`` wrote, by a reader with its schema; empty text reads as missing."""
    return reader.csv(path, header=True, escape='"', multiLine=True, nullValue="")


def write_json(df: DataFrame, path: str) -> DataFrame:
    """The 25 fields and what enrichment added, newest first; nulls are written out. Gives the manifest."""
    return _export(
        export_columns(df, tuple(ENRICHMENT_FIELDS)),
        path,
        lambda out: out.write.mode("overwrite").option("ignoreNullFields", "false").json(path),
        lambda reader: reader.json(path),
    )


def write_report(df: DataFrame, path: str) -> dict[str, DataFrame]:
    """The three report tables as parquet below ``path``, and the manifest of each."""
    tables = (("summary", summary_table), ("full", full_table), ("scores", score_table))

    def written(table: DataFrame, place: str) -> DataFrame:
        return _export(
            table, place, lambda out: out.write.mode("overwrite").parquet(place), lambda reader: reader.parquet(place)
        )

    return {name: written(table(df), f"{path}/{name}") for name, table in tables}


def append_new_companies(found: DataFrame, registry: DataFrame, path: str) -> None:
    """Add companies to the registry table at ``path`` that it lacks.

    Known companies are left as they are, so appending is enough.
    """
    new_companies(found, registry).write.mode("append").parquet(path)


def registry_rows(df: DataFrame) -> DataFrame:
    """The columns of the registry table, in order."""
    columns = ["ats", "slug", "company_name", "discovered_from", "discovered_date", "url"]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
