"""Counts, sorts, limits, sets and reports over derived postings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacancia import fixed_values as V
from vacancia.functions import keys as K
from vacancia.operators import filters as FL, ordering as OR, reports as RE, summaries as SU
from vacancia.operators.normalize import normalize_postings
from vacancia.operators.resolve import with_keys
from vacancia.plans.search import detect_languages
from vacancia.schema import POSTING_FIELDS, POSTING_SCHEMA, empty_postings
from vacancia.session import TableSpool
from vacancia.sources.common import union_feeds

from .base import AS_OF, jobs, on_jobs, query, s_any, s_host, s_norm_company, s_norm_title, s_norm_url, s_strip, table
from .classify import ATS_SQL, BAND_SQL, LISTING_SQL, NORMAL_JOBS, ROUTE_SQL, SCORE_SQL, required_sql
from .filters import ASKED_SQL, scope_sql

EXPORT_SCHEMA = StructType(POSTING_SCHEMA.fields[1:])

# --- counts ---------------------------------------------------------------------------------------------

_SOURCES = "parts AS (SELECT trim(unnest(string_split(coalesce(source, 'unknown'), ' + '))) AS source FROM jobs)"


@query("agg_by_source", on_jobs("SELECT source, count(*) AS n FROM parts GROUP BY source", _SOURCES))
def agg_by_source(spark, sf):
    return SU.by_source(jobs(spark, sf))


@query("agg_sources_used", on_jobs("SELECT count(DISTINCT source) AS sources_used FROM parts", _SOURCES))
def agg_sources_used(spark, sf):
    return SU.sources_used(jobs(spark, sf))


_BY_LANGUAGE = f"SELECT {ASKED_SQL} AS language, count(*) AS n FROM jobs GROUP BY 1"


@query("agg_by_language", on_jobs(_BY_LANGUAGE))
def agg_by_language(spark, sf):
    return SU.by_language(jobs(spark, sf))


@query(
    "agg_kpis",
    on_jobs(
        f"""SELECT count(*) AS total_jobs, count(*) FILTER ({ASKED_SQL} IN ('English', 'English (German plus)')) AS english_ok_jobs,
        count(*) FILTER ({ASKED_SQL} = 'German') AS german_jobs FROM jobs"""
    ),
)
def agg_kpis(spark, sf):
    return SU.key_figures(jobs(spark, sf))


@query("agg_listing_language_stats", on_jobs(f"SELECT {LISTING_SQL} AS listing_language, count(*) AS n FROM jobs GROUP BY 1"))
def agg_listing_language_stats(spark, sf):
    return SU.listing_language_stats(detect_languages(jobs(spark, sf)))


@query(
    "agg_required_language_stats",
    on_jobs(
        f"SELECT {required_sql('description', 'title', 'listed')} AS language_required, count(*) AS n FROM (SELECT description, title, {LISTING_SQL} AS listed FROM jobs) GROUP BY 1"
    ),
)
def agg_required_language_stats(spark, sf):
    return SU.required_language_stats(detect_languages(jobs(spark, sf)))


@query("agg_url_class_summary", on_jobs(f"SELECT {ROUTE_SQL[0]} AS platform, count(*) AS n FROM jobs GROUP BY 1"))
def agg_url_class_summary(spark, sf):
    from vacancia.operators.companies import classify_urls

    return SU.url_classes(classify_urls(jobs(spark, sf).select("seq", F.col("job_url").alias("url"))))


@query("agg_source_yield", on_jobs("SELECT source, count(*) AS n_rows, count(DISTINCT company) AS n_companies FROM jobs GROUP BY source"))
def agg_source_yield(spark, sf):
    return SU.feed_yield(jobs(spark, sf))


_STAGES = [
    ("date", "coalesce(date_posted, '') = '' OR date_posted >= '2024-06-01'"),
    ("language", f"{ASKED_SQL} IN ('German', 'English (German plus)')"),
    ("location", scope_sql(["Germany"])),
]


def _effect_sql() -> str:
    before, parts = "TRUE", []
    for step, (name, condition) in enumerate(_STAGES, 1):
        now = f"{before} AND ({condition})"
        parts.append(
            f"SELECT {step} AS step, '{name}' AS stage, count(*) FILTER ({before}) AS before, count(*) FILTER ({now}) AS kept, "
            f"count(*) FILTER ({before}) - count(*) FILTER ({now}) AS removed FROM clean"
        )
        before = now
    return " UNION ALL ".join(parts)


@query("agg_filter_effect", on_jobs(_effect_sql(), NORMAL_JOBS))
def agg_filter_effect(spark, sf):
    return SU.filter_effect(
        normalize_postings(jobs(spark, sf)),
        [
            ("date", FL.date_condition(720, AS_OF)),
            ("language", FL.required_language_condition("German")),
            ("location", FL.location_scope_condition(["Germany"])),
        ],
    )


_UNITED = """parts AS (SELECT DISTINCT company, trim(unnest(string_split(source, ' + '))) AS part FROM jobs WHERE source <> '' AND company <> '')"""


@query("agg_sources_set", on_jobs("SELECT company, string_agg(part, ' + ' ORDER BY part) AS source FROM parts GROUP BY company", _UNITED))
def agg_sources_set(spark, sf):
    return SU.merged_sources(jobs(spark, sf).filter("company <> ''"), "company")


_CLEAN_URL = f"regexp_replace({s_strip('job_url')}, '/+$', '')"


@query("agg_distinct_urls", on_jobs(f"SELECT {_CLEAN_URL} AS url, min(seq) AS first_seq FROM jobs WHERE {_CLEAN_URL} <> '' GROUP BY 1"))
def agg_distinct_urls(spark, sf):
    return SU.distinct_urls(jobs(spark, sf), "job_url")


DOMAINS_SQL = f"""domains AS (SELECT DISTINCT domain FROM (SELECT {s_host('company_url')} AS domain FROM jobs UNION ALL SELECT {s_host('job_url')} FROM jobs)
  WHERE domain IS NOT NULL AND NOT {s_any('domain', V.KNOWN_BOARD_DOMAINS)})"""


@query("agg_distinct_domains", on_jobs("SELECT domain FROM domains", DOMAINS_SQL))
def agg_distinct_domains(spark, sf):
    return SU.distinct_domains(jobs(spark, sf))


@query("agg_pending_ai_language", on_jobs("SELECT count(*) FILTER (coalesce(ai_detected_language, '') = '') AS pending FROM jobs"))
def agg_pending_ai_language(spark, sf):
    return SU.pending_ai_language(jobs(spark, sf))


# --- windows ------------------------------------------------------------------------------------------------


@query("win_first_seen", on_jobs(f"SELECT norm_url, min(seq) AS first_seq FROM (SELECT seq, nullif({s_norm_url('job_url')}, '') AS norm_url FROM jobs) WHERE norm_url IS NOT NULL GROUP BY 1"))
def win_first_seen(spark, sf):
    return OR.first_seen(with_keys(jobs(spark, sf)), "norm_url")


@query(
    "win_best_version",
    on_jobs(
        f"""SELECT norm_url, seq AS best_seq FROM (SELECT norm_url, seq, row_number() OVER (PARTITION BY norm_url ORDER BY ats DESC, score DESC, seq) AS rn
        FROM (SELECT seq, nullif({s_norm_url('job_url')}, '') AS norm_url, {ATS_SQL} AS ats, {SCORE_SQL} AS score FROM jobs) WHERE norm_url IS NOT NULL) WHERE rn = 1"""
    ),
)
def win_best_version(spark, sf):
    # best of each group as a partial aggregate: no group is sorted
    rank = F.struct((~K.is_ats(F.col("source"), F.col("ats_platform"))).alias("board"), (-K.completeness()).alias("score"), "seq")
    df = with_keys(jobs(spark, sf)).filter("norm_url IS NOT NULL").select("norm_url", rank.alias("rank"))
    return df.groupBy("norm_url").agg(F.min("rank").alias("rank")).select("norm_url", F.col("rank.seq").alias("best_seq"))


_DATE_KEY = "coalesce(nullif(date_posted, ''), '0000-00-00')"


@query("win_page", on_jobs(f"SELECT seq, (row_number() OVER (ORDER BY {_DATE_KEY} DESC, seq) - 1) // 25 + 1 AS page FROM clean", NORMAL_JOBS))
def win_page(spark, sf):
    return OR.with_pages(normalize_postings(jobs(spark, sf)).select("seq", "date_posted")).select("seq", "page")


# --- sorts and limits: the position shows the order -------------------------------------------------------------


@query("srt_date_desc", on_jobs(f"SELECT seq, date_posted, row_number() OVER (ORDER BY {_DATE_KEY} DESC, seq) - 1 AS row_index FROM clean", NORMAL_JOBS))
def srt_date_desc(spark, sf):
    df = normalize_postings(jobs(spark, sf)).select("seq", "date_posted")
    return OR.with_positions(OR.newest_first(df)).select("seq", "date_posted", "row_index")


@query("srt_score_desc", on_jobs("SELECT seq, ai_score, row_number() OVER (ORDER BY coalesce(ai_score, 0) DESC, seq) - 1 AS row_index FROM jobs"))
def srt_score_desc(spark, sf):
    df = jobs(spark, sf).select("seq", "ai_score")
    return OR.with_positions(OR.best_score_first(df)).select("seq", "ai_score", "row_index")


@query("srt_chart_asc", on_jobs(f"SELECT 'source' AS chart, source AS label, n FROM (SELECT source, count(*) AS n FROM parts GROUP BY source) UNION ALL SELECT 'language', language, n FROM ({_BY_LANGUAGE})", _SOURCES))
def srt_chart_asc(spark, sf):
    df = jobs(spark, sf)
    by_source = SU.chart(SU.by_source(df), "source").select(F.lit("source").alias("chart"), F.col("source").alias("label"), "n")
    return by_source.unionAll(SU.chart(SU.by_language(df), "language").select(F.lit("language"), "language", "n"))


@query("lim_generic_urls", on_jobs(f"SELECT seq, job_url AS url FROM jobs WHERE {ROUTE_SQL[0]} = 'generic' ORDER BY seq LIMIT 20"))
def lim_generic_urls(spark, sf):
    from vacancia.operators.companies import classify_urls

    urls = classify_urls(jobs(spark, sf).select("seq", F.col("job_url").alias("url")))
    return OR.first_urls(urls.filter("platform = 'generic'")).select("seq", "url")


@query("lim_crawl_domains", on_jobs("SELECT domain FROM domains ORDER BY domain LIMIT 30", DOMAINS_SQL))
def lim_crawl_domains(spark, sf):
    return OR.first_domains(SU.distinct_domains(jobs(spark, sf)))


# --- sets --------------------------------------------------------------------------------------------------------


@query(
    "set_union_feeds",
    """SELECT doc_id AS seq, 'a' || doc_id AS title, CAST(NULL AS DOUBLE) AS salary_min FROM documents
    UNION ALL SELECT 288230376151711744 + o_orderkey, 'b' || o_orderkey, o_totalprice FROM orders
    UNION ALL SELECT 576460752303423488 + page_id, 'a' || page_id, NULL FROM pages""",
)
def set_union_feeds(spark, sf):
    titled = lambda df, key, letter: df.select(F.col(key).alias("seq"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("title"))
    orders = table(spark, sf, "orders")
    return union_feeds(
        [
            titled(table(spark, sf, "documents"), "doc_id", "a"),
            orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_totalprice").alias("salary_min")),
            titled(table(spark, sf, "pages"), "page_id", "a"),
        ]
    )


# --- reports --------------------------------------------------------------------------------------------------------


SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def _sheet_sql(name: str, columns) -> str:
    return f"SELECT '{name}' AS sheet, " + ", ".join(
        f"{c if c in columns else 'NULL::' + SQL_TYPES[kind.simpleString()]} AS {c}" for c, kind in POSTING_FIELDS.items()
    ) + " FROM jobs"


@query(
    "sink_report_tables",
    on_jobs(
        " UNION ALL ".join(
            _sheet_sql(name, columns)
            for name, columns in (("summary", V.SUMMARY_COLUMNS), ("full", POSTING_FIELDS), ("scores", V.SCORE_COLUMNS))
        )
    ),
)
def sink_report_tables(spark, sf):
    from vacancia.sinks import write_report

    df = jobs(spark, sf)
    folder = _export_folder(spark)
    write_report(df, folder)
    sheets = []
    for name in ("summary", "full", "scores"):
        sheet = spark.read.parquet(f"{folder}/{name}")
        columns = [(F.col(c) if c in sheet.columns else F.lit(None).cast(kind)).alias(c) for c, kind in POSTING_FIELDS.items()]
        sheets.append(sheet.select(F.lit(name).alias("sheet"), *columns))
    return sheets[0].unionAll(sheets[1]).unionAll(sheets[2])


@query(
    "sink_report_attrs",
    on_jobs(
        f"""SELECT seq, lower(trim(string_split(coalesce(source, ''), ' + ')[1])) AS primary_source,
        CASE WHEN starts_with(job_url, 'http') AND length(job_url) > 60 THEN left(job_url, 57) || '...' ELSE job_url END AS url_text,
        {BAND_SQL} AS score_band FROM jobs"""
    ),
)
def sink_report_attrs(spark, sf):
    return RE.report_attributes(jobs(spark, sf))


@query("sink_empty_result", "SELECT count(*) AS n_rows, 26 AS n_columns FROM documents WHERE doc_id < 0")
def sink_empty_result(spark, sf):
    # a search that keeps nothing still has all its columns
    none = normalize_postings(jobs(spark, sf)).filter(F.col("seq") < 0)
    both = empty_postings(spark).unionByName(none)
    return both.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(both.columns)))


def _export_folder(spark) -> str:
    return TableSpool(spark, "export").path("files")


# text that is empty cannot be told from missing text in a CSV file; the check reads both as missing
_CSV_ROWS = ", ".join(f"nullif({c}, '') AS {c}" if kind.simpleString() == "string" else c for c, kind in POSTING_FIELDS.items())


@query("sink_csv", on_jobs(f"SELECT {_CSV_ROWS} FROM clean", NORMAL_JOBS))
def sink_csv(spark, sf):
    from vacancia.sinks import read_csv, write_csv

    path = _export_folder(spark)
    write_csv(normalize_postings(jobs(spark, sf)), path)
    return read_csv(spark.read.schema(EXPORT_SCHEMA), path)


@query("sink_json", on_jobs(f"SELECT {', '.join(POSTING_FIELDS)} FROM clean", NORMAL_JOBS))
def sink_json(spark, sf):
    from vacancia.sinks import write_json

    path = _export_folder(spark)
    write_json(normalize_postings(jobs(spark, sf)), path)
    return spark.read.schema(EXPORT_SCHEMA).json(path)


@query(
    "sink_manifest",
    on_jobs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, count(*) AS n_rows, count({c}) AS n_filled, (SELECT count(*) FROM clean) AS n_in_files FROM clean"
            for c in POSTING_FIELDS
        ),
        NORMAL_JOBS,
    ),
)
def sink_manifest(spark, sf):
    """Columns of a JSON export as its manifest has them, with the rows its files have in all."""
    from vacancia.sinks import write_json

    manifest = write_json(normalize_postings(jobs(spark, sf)), _export_folder(spark))
    files = manifest.where("kind = 'file'").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_in_files"))
    return manifest.where("kind = 'column'").select("name", "n_rows", "n_filled", files.scalar().alias("n_in_files"))


KEYS_SQL = f"""keyed AS (SELECT seq, norm_url, t || '|||' || c AS dup_key FROM (SELECT seq, nullif({s_norm_url('job_url')}, '') AS norm_url,
  nullif({s_norm_title('title')}, '') AS t, nullif({s_norm_company('company')}, '') AS c FROM jobs))"""
