"""The numbered operators as queries over their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignments
from .common import documents
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .packing import pack
from .phrases import collocations
from .pieces import piece_digests
from .quality import score_quality
from .secret_scan import secret_digests
from .shingle_join import shingle_components
from .spot_signatures import fingerprints_with_neighbours
from .suffix_dedup import repeated_passages
from .token_counts import token_counts
from .toxicity import learn, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))


@query("op2_piece_coding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(documents(spark, folder))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, n) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, n) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


def _secret_sql() -> str:
    """The spans of each kind from the lengths of matches and of what lies between them."""
    words = "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )
    assign = f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    rules = (("assign", assign, 2, 6), ("access", "(AKIA[A-Z0-9]+)", 0, 20), ("hex", "([0-9a-f]+)", 0, 24))
    spans = [
        f"""SELECT n, {rank} AS rank, '{kind}' AS kind,
          unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
            'size': length(m[i]), 'value': length(v[i])}}), recursive := true)
        FROM (SELECT n, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
                     string_split_regex(text, '{pattern}') AS g FROM d)"""
        for rank, (kind, pattern, group, _) in enumerate(rules)
    ]
    least = " OR ".join(f"rank = {rank} AND value >= {rule[3]}" for rank, rule in enumerate(rules))
    counts = ", ".join(f"count(rank) FILTER (rank = {rank}) AS n_{rule[0]}" for rank, rule in enumerate(rules))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
s AS ({" UNION ALL ".join(spans)}),
k AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s WHERE {least}),
j AS (SELECT d.doc_id, d.n, {counts}, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
      FROM d LEFT JOIN k USING (n) GROUP BY d.doc_id, d.n)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM j
"""


@query("op3_secret_scans", _secret_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(documents(spark, folder))


@query("op8_spot_signatures")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints_with_neighbours(documents(spark, folder))


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(documents(spark, folder))


@query("op9_shingle_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(documents(spark, folder))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(documents(spark, folder))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_toxicity(docs, learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))


@query("op11_quality")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


PHRASE_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, ws[i:i + k - 1] AS words, count(*) AS f FROM o GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT s.lang, s.words FROM (
    SELECT lang, words[i:i + j - 1] AS words, f FROM (
      SELECT lang, words, f, j, unnest(range(1, k - j + 2)) AS i
      FROM c, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)) AS s
  JOIN c ON c.lang = s.lang AND c.words = s.words AND 100 * s.f >= 100 * c.f
), cut AS (
  SELECT c.lang, c.words, c.f AS a, l.f AS l, r.f AS r, t.n, x.i AS i,
         (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM c ANTI JOIN inside USING (lang, words)
  JOIN (SELECT unnest(range(1, 5)) AS i) AS x ON x.i < c.k
  JOIN f AS l ON l.lang = c.lang AND l.words = c.words[1:x.i]
  JOIN f AS r ON r.lang = c.lang AND r.words = c.words[x.i + 1:]
  JOIN t ON t.lang = c.lang
), weakest AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000
"""


@query("op12_collocations", PHRASE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignments(documents(spark, folder))
