"""Exports are read back as they were written, or say so."""

import os

import pytest
from pyspark.sql import functions as F

from vacancia import sinks
from vacancia.schema import POSTING_FIELDS, POSTING_SCHEMA, conform_schema, empty_postings

ODD = ["plain", " spaces around ", 'quo"ted, "twice""', "two\nlines\r\nand three", "back\\slash\\", "\\", "", None, "ümlaut 中 😀", '"', ",", "\t"]


@pytest.fixture
def postings(spark):
    rows = [(i, t, f"https://x/{i}", 0.1 * i if i % 2 else None, i if i % 3 else None, i % 2 == 0) for i, t in enumerate(ODD * 20)]
    df = spark.createDataFrame(rows, "seq long, description string, job_url string, salary_min double, ai_score int, is_remote boolean")
    return conform_schema(df.repartition(4))


def test_csv(spark, postings, tmp_path):
    path = str(tmp_path / "csv")
    manifest = {(r.kind, r.name): r for r in sinks.write_csv(postings, path).collect()}
    assert {n for k, n in manifest if k == "column"} == set(POSTING_FIELDS)
    files = {f for f in os.listdir(path) if f.startswith("part-")}
    assert {n for k, n in manifest if k == "file"} <= files
    assert sum(r.n_rows for (k, _), r in manifest.items() if k == "file") == len(ODD) * 20
    assert manifest["column", "description"].n_filled == (len(ODD) - 2) * 20
    schema = POSTING_SCHEMA.fields[1:]
    back = sinks.read_csv(spark.read.schema(type(POSTING_SCHEMA)(schema)), path)
    got = {r.job_url: (r.description, r.salary_min, r.ai_score, r.is_remote) for r in back.collect()}
    assert got == {r.job_url: (r.description or None, r.salary_min, r.ai_score, r.is_remote) for r in postings.collect()}


def test_json_and_report(spark, postings, tmp_path):
    manifest = sinks.write_json(postings.withColumn("skills", F.array("description")), str(tmp_path / "json"))
    assert manifest.where("kind = 'column'").count() == len(POSTING_FIELDS) + 1
    both = [
        {r.name: r.digest for r in sinks.write_json(df, str(tmp_path / name)).where("kind = 'column'").collect()}
        for name, df in (("one", postings), ("two", postings.repartition(7, "seq")))
    ]
    assert both[0] == both[1]
    found = sinks.write_report(postings, str(tmp_path / "report"))
    assert {n: m.where("kind = 'file'").agg(F.sum("n_rows")).first()[0] for n, m in found.items()} == dict.fromkeys(("summary", "full", "scores"), len(ODD) * 20)


def test_empty_export(spark, tmp_path):
    for df in (empty_postings(spark), empty_postings(spark).repartition(3)):
        rows = sinks.write_csv(df, str(tmp_path / "none")).collect()
        assert {(r.kind, r.n_rows, r.n_filled, r.digest) for r in rows} == {("column", 0, 0, "0")}


def test_what_is_lost_or_moved_is_noticed(spark, postings, tmp_path):
    def export(change):
        path = str(tmp_path / str(len(os.listdir(tmp_path))))
        df = postings.select("seq", "description", "job_url")
        sinks._export(df, path, lambda out: out.write.json(path), lambda reader: change(reader.json(path)))
        return path

    assert os.path.isdir(export(lambda back: back) + "/" + sinks.MANIFEST)
    lost = lambda back: back.where("seq <> 5")
    moved = lambda back: back.withColumns({"description": F.col("job_url"), "job_url": F.col("description")})
    other = lambda back: back.withColumn("job_url", F.regexp_replace("job_url", "7$", "8"))
    for change in (lost, moved, other):
        with pytest.raises(sinks.ExportError):
            export(change)
    assert sum(os.path.isdir(f"{tmp_path}/{d}/{sinks.MANIFEST}") for d in os.listdir(tmp_path)) == 1
