"""Similarity expressions against a plain table of longest common subsequences."""

import random

from pyspark.sql import functions as F

from resolution_rule import longest_shared
from vacancia.functions import similarity as S


def strings():
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdé \U0001f600x") for _ in range(n))
    sizes = [0, 1, 5, 30, 61, 62, 63, 70, 124, 125, 190]
    rows = [(text(rnd.choice(sizes)), text(rnd.choice(sizes))) for _ in range(150)]
    return rows + [(a, a[: len(a) // 2] + "q" + a[len(a) // 2 :]) for a, _ in rows[:40]] + [("a" * 200, "a" * 150), ("abc", "abc")]


def test_common_length_and_what_comes_before_it(spark):
    rows = strings()
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    may = S.may_be_similar(S.signature(a), S.signature(b), (F.length(a), F.length(b)), 85)
    found = df.select("a", "b", S.common_length(a, b).alias("n"), may.alias("may"), S.similar(a, b, 85).alias("similar"), S.similarity(a, b).alias("ratio")).collect()
    for r in found:
        n = longest_shared(r["a"], r["b"])
        total = len(r["a"]) + len(r["b"])
        assert r["n"] == n
        assert r["similar"] == (200 * n >= 85 * total)
        assert r["may"] or not r["similar"]
        assert abs(r["ratio"] - (200 * n / total if total else 100)) < 1e-9


def test_missing_texts_are_empty(spark):
    df = spark.createDataFrame([(None, None), (None, "ab"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"))).collect()] == [100.0, 0.0, 100.0]
