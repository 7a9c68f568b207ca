"""Duplicates: keys, leaders and merged rows, and whole runs.

The SQL states the rule row by row: a recursive query walks through the rows in order, holding the
leaders found so far, and merging goes by windows over each group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia import fixed_values as V
from vacancia.functions import keys as K
from vacancia.operators import resolve as RS
from vacancia.operators.normalize import normalize_postings
from vacancia.plans.search import SearchOptions, add_crawled, matching_crawled, run_search
from vacancia.schema import POSTING_FIELDS
from vacancia.session import TableSpool

from .base import AS_OF, ORACLES, TERMS, jobs, on_jobs, query, s_any, s_norm_company, s_norm_title, s_norm_url, s_strip, sql_text
from .classify import ATS_SQL, LISTING_SQL, NORMAL_JOBS, SCORE_SQL, required_sql, s_indel
from .companies import DAY, REGISTRY_CTE, _SEEN, registry
from .feeds import src_board_rows, src_lever
from .filters import ALL_SQL, LOC, WANTED, scope_sql
from .summaries import KEYS_SQL

PLACES = ["berlin", "hamburg"]


def _pairs(key: str) -> str:
    return on_jobs(
        f"SELECT seq, first_seq FROM (SELECT seq, min(seq) OVER (PARTITION BY {key}) AS first_seq FROM keyed WHERE {key} IS NOT NULL) WHERE first_seq < seq",
        KEYS_SQL,
    )


@query("join_url_dup", _pairs("norm_url"))
def join_url_dup(spark, sf):
    return RS.first_row_per_key(RS.with_keys(jobs(spark, sf)), "norm_url")


@query("join_title_company_dup", _pairs("dup_key"))
def join_title_company_dup(spark, sf):
    return RS.first_row_per_key(RS.with_keys(jobs(spark, sf)), "dup_key")


# --- SQL of leaders and of merging ----------------------------------------------------------------


def leaders_sql(p: str, rows: str, fuzzy: bool = True, urls: bool = True, stored: str | None = None) -> str:
    """Common table expressions that end in ``{p}_led`` (seq, leader); rows of ``stored`` all lead."""
    url = f"nullif({s_norm_url('job_url')}, '')" if urls else "NULL::VARCHAR"
    keys = lambda source, known: (
        f"SELECT seq, {known} AS known, {url} AS u, nullif({s_norm_title('title')}, '') AS t, nullif({s_norm_company('company')}, '') AS c FROM {source}"
    )
    every = keys(rows, "FALSE") + (f" UNION ALL {keys(stored, 'TRUE')}" if stored else "")
    far = lambda a, b, per_cent: f"100 * {s_indel(a, b)} <= {100 - per_cent} * (length({a}) + length({b}))"
    near = lambda a, b, per_cent: f"100 * levenshtein({a}, {b}) <= {100 - per_cent} * (length({a}) + length({b}))"
    alike = lambda column, per_cent: (
        f"SELECT x, y FROM (SELECT a.{column} AS x, b.{column} AS y FROM (SELECT DISTINCT {column} FROM {p}_k WHERE k IS NOT NULL) a "
        f"JOIN (SELECT DISTINCT {column} FROM {p}_k WHERE k IS NOT NULL) b ON {near(f'a.{column}', f'b.{column}', per_cent)}) WHERE x = y OR {far('x', 'y', per_cent)}"
    )
    similar = f""" UNION ALL SELECT b.seq, a.seq, 2 FROM {p}_k a JOIN {p}_cc cc ON cc.x = a.c JOIN {p}_k b ON b.c = cc.y
      JOIN {p}_tt tt ON tt.x = a.st AND tt.y = b.st WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.seq < b.seq AND NOT b.known"""
    tables = f"""{p}_cc AS MATERIALIZED ({alike('c', V.COMPANY_SIMILARITY)}),
    {p}_tt AS MATERIALIZED ({alike('st', V.TITLE_SIMILARITY)}),""" if fuzzy else ""
    return f"""{p}_k AS MATERIALIZED (SELECT *, t || '|||' || c AS k, array_to_string(list_sort(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')), ' ') AS st FROM ({every})),
    {tables}
    {p}_pairs AS MATERIALIZED (
      SELECT b.seq AS b, a.seq AS a, 0 AS kind FROM {p}_k a JOIN {p}_k b ON a.u = b.u AND a.seq < b.seq AND NOT b.known
      UNION ALL SELECT b.seq, a.seq, 1 FROM {p}_k a JOIN {p}_k b ON a.k = b.k AND a.seq < b.seq AND NOT b.known
      {similar if fuzzy else ''}),
    {p}_rows AS MATERIALIZED (
      SELECT seq, row_number() OVER (ORDER BY seq) AS i, earlier FROM {p}_k LEFT JOIN (
        SELECT b, list(a ORDER BY kind, a) AS earlier FROM (SELECT b, a, min(kind) AS kind FROM {p}_pairs GROUP BY b, a) GROUP BY b) ON b = seq
      WHERE NOT known),
    {p}_walk AS (
      SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS leader, coalesce((SELECT list(seq) FROM {p}_k WHERE known), []::BIGINT[]) AS heads
      UNION ALL
      SELECT i, seq, coalesce(led, seq), CASE WHEN led IS NULL THEN list_append(heads, seq) ELSE heads END FROM (
        SELECT r.i, r.seq, w.heads, list_filter(r.earlier, lambda x: list_contains(w.heads, x))[1] AS led
        FROM {p}_walk w JOIN {p}_rows r ON r.i = w.i + 1)),
    {p}_led AS MATERIALIZED (SELECT seq, leader FROM {p}_walk WHERE i > 0 {f'UNION ALL SELECT seq, seq FROM {stored}' if stored else ''})"""


def merge_sql(p: str, rows: str) -> str:
    """Common table expressions that end in ``{p}_merged``, from ``rows`` and ``{p}_led``."""
    texts = [c for c, kind in POSTING_FIELDS.items() if kind.simpleString() == "string"]
    fields = list(POSTING_FIELDS)
    blank = ", ".join(f"nullif({c}, '') AS {c}" if c in texts else c for c in fields)
    has = lambda c: f"coalesce(bool_or({c} IS NOT NULL) OVER w, FALSE)"
    so_far = " + ".join(
        [f"CASE WHEN {has(c)} THEN {n} ELSE 0 END" for c, n in {**K.TEXT_WEIGHTS, **K.VALUE_WEIGHTS}.items()]
        + [f"CASE WHEN coalesce(max(length(description)) OVER w, 0) > {bound} THEN {n} ELSE 0 END" for bound, n in K.LONG_DESCRIPTION]
    )
    boards = ", ".join(map(sql_text, V.ATS_SOURCES))
    parts = f"list_transform(string_split(source, {sql_text(V.SOURCE_SEPARATOR)}), lambda x: {s_strip('x')})"
    given = {c: f"arg_min({c}, place) FILTER ({c} IS NOT NULL)" for c in fields}
    given["description"] = "first(description ORDER BY length(description) DESC, place) FILTER (description IS NOT NULL)"
    given["source"] = f"array_to_string(list_sort(list_distinct(flatten(list({parts}) FILTER (source IS NOT NULL)))), {sql_text(V.SOURCE_SEPARATOR)})"
    return f"""{p}_m AS MATERIALIZED (SELECT r.*, l.leader, count(*) OVER (PARTITION BY l.leader) AS n_merged FROM {rows} r JOIN {p}_led l USING (seq)),
    {p}_g AS (SELECT seq, leader, {blank} FROM {p}_m WHERE n_merged > 1),
    {p}_w AS (SELECT *, {ATS_SQL} AS ats, {SCORE_SQL} AS score,
      {has('ats_platform')} OR coalesce(min(source) OVER w = max(source) OVER w AND min(source) OVER w IN ({boards}), FALSE) AS ats_before,
      {so_far} AS before FROM {p}_g WINDOW w AS (PARTITION BY leader ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {p}_p AS (SELECT *, CASE WHEN seq = leader THEN 0 WHEN ats AND NOT ats_before OR ats = ats_before AND score > before THEN -seq - 1 ELSE seq + 1 END AS place FROM {p}_w),
    {p}_merged AS MATERIALIZED (
      SELECT seq, {', '.join(fields)}, n_merged FROM {p}_m WHERE n_merged = 1
      UNION ALL SELECT leader, {', '.join(f'{e} AS {c}' for c, e in given.items())}, count(*) FROM {p}_p GROUP BY leader)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _resolved(fuzzy: bool) -> str:
    more = f"{NORMAL_JOBS}, {leaders_sql('r', 'clean', fuzzy)}, {merge_sql('r', 'clean')}"
    return recursive(on_jobs("SELECT * FROM r_merged", more))


@query(
    "join_fuzzy_dup",
    recursive(on_jobs(
        "SELECT seq, k AS dup_key, leader FROM f_led JOIN f_k USING (seq) WHERE seq <> leader",
        f"named AS (SELECT * FROM jobs WHERE {s_norm_title('title')} <> '' AND {s_norm_company('company')} <> ''), {leaders_sql('f', 'named', urls=False)}",
    )),
)
def join_fuzzy_dup(spark, sf):
    return RS.similar_keys(jobs(spark, sf))


@query("resolve_exact", _resolved(False))
def resolve_exact(spark, sf):
    return RS.resolve_exact(normalize_postings(jobs(spark, sf)))


@query("resolve_duplicates", _resolved(True))
def resolve_duplicates(spark, sf):
    return RS.resolve(normalize_postings(jobs(spark, sf)))


_BY_URL = f"u_led AS MATERIALIZED (SELECT seq, CASE WHEN u IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY u) END AS leader FROM (SELECT seq, nullif({s_norm_url('job_url')}, '') AS u FROM clean))"


@query("agg_dedup_merge", on_jobs("SELECT * FROM u_merged", f"{NORMAL_JOBS}, {_BY_URL}, {merge_sql('u', 'clean')}"))
def agg_dedup_merge(spark, sf):
    """Rows of a URL merged into one, whatever else they share."""
    df = normalize_postings(jobs(spark, sf))
    keyed = RS.with_keys(df).select("seq", "norm_url")
    firsts = keyed.filter("norm_url IS NOT NULL").groupBy("norm_url").agg(F.min("seq").alias("leader"))
    leaders = keyed.join(firsts, "norm_url", "left").select("seq", F.coalesce("leader", "seq").alias("leader"))
    return RS.merge_groups(df, leaders, TableSpool(spark, "merge"))


# --- whole runs -----------------------------------------------------------------------------------


def _crawl_sql(p: str, found: str, posted: str, after: int) -> str:
    """Crawled rows of ``posted`` that match, merged into ``found``; ends in ``{p}_merged``."""
    fields = ", ".join(POSTING_FIELDS)
    return f"""{p}_new AS MATERIALIZED (SELECT seq + {after + 1} AS seq, {fields} FROM (SELECT * REPLACE ('career_crawler' AS source) FROM ({posted}) WHERE {ALL_SQL} AND {s_any(LOC, [*PLACES, 'remote'])})),
    {p}_all AS MATERIALIZED (SELECT seq, {fields} FROM {found} UNION ALL SELECT * FROM {p}_new),
    {leaders_sql(p, f'{p}_new', stored=found)}, {merge_sql(p, f'{p}_all')}"""


@query(
    "set_union_crawl",
    recursive(on_jobs(
        "SELECT * FROM c_merged",
        f"{NORMAL_JOBS}, {leaders_sql('r', 'clean', False)}, {merge_sql('r', 'clean')}, {_crawl_sql('c', 'r_merged', 'SELECT * FROM jobs', 1 << 40)}",
    )),
)
def set_union_crawl(spark, sf):
    spool = TableSpool(spark, "crawl")
    merged = spool.cut(RS.resolve_exact(normalize_postings(jobs(spark, sf))), "merged")
    return add_crawled(merged, matching_crawled(jobs(spark, sf), TERMS, PLACES), after=1 << 40)


OPTIONS = SearchOptions(as_of=AS_OF, hours_old=24 * 150, language="English", locations=["Germany", "India"])
_FEEDS = ["src_board_rows", "src_lever"]


def _run_sql(select: str, more: str = "") -> str:
    """A run over two feeds and crawled postings, up to ``c_merged``."""
    asked = required_sql("description", "title", "listing_language")
    united = " UNION ALL BY NAME ".join(f"SELECT * REPLACE (seq + {i << 58} AS seq) FROM feed{i}" for i in range(len(_FEEDS)))
    return f"""WITH RECURSIVE {', '.join(f'feed{i} AS ({ORACLES[name]})' for i, name in enumerate(_FEEDS))},
    jobs AS ({united}), {NORMAL_JOBS},
    dated AS MATERIALIZED (SELECT * REPLACE ({LISTING_SQL} AS listing_language) FROM clean WHERE coalesce(date_posted, '') = '' OR date_posted >= '2024-02-02'),
    asked AS MATERIALIZED (SELECT * REPLACE ({asked} AS language_required, {asked} AS language) FROM dated),
    picked AS MATERIALIZED (SELECT * FROM asked WHERE ({WANTED['English']}) AND {scope_sql(['Germany', 'India'])}),
    {leaders_sql('r', 'picked')}, {merge_sql('r', 'picked')},
    {_crawl_sql('c', 'r_merged', on_jobs('SELECT * FROM jobs'), (len(_FEEDS) << 58) - 1)}{more} {select}"""


def _run(spark, sf):
    feeds = [src_board_rows(spark, sf), src_lever(spark, sf)]
    return run_search(feeds, jobs(spark, sf), registry(spark, sf), OPTIONS, TERMS, PLACES)


@query("pipeline_search", _run_sql("SELECT * FROM c_merged"))
def pipeline_search(spark, sf):
    """Two feeds and crawled postings: classified, filtered, resolved and merged."""
    return _run(spark, sf).postings


_LEARNT = _SEEN.replace("FROM jobs", "FROM c_merged")
_KNOWN = f"registry AS ({on_jobs('SELECT * FROM registry', REGISTRY_CTE)})"


@query(
    "pipeline_companies",
    _run_sql(
        f"SELECT f.*, '{DAY}' AS discovered_date FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.ats = f.ats AND r.slug = f.slug)",
        f", {_LEARNT}, {_KNOWN}",
    ),
)
def pipeline_companies(spark, sf):
    """The companies that a run learns from its postings."""
    return _run(spark, sf).companies
