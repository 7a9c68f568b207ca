"""Registry, routing and careers pages over derived postings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia import fixed_values as V
from vacancia.functions.platforms import router_platform
from vacancia.functions.text import slug_to_name
from vacancia.operators import companies as CO, ordering as OR, summaries as SU
from vacancia.sinks import append_new_companies, registry_rows
from vacancia.sources.boards import boards_for_country, expand_or_queries, expand_queries

from .base import TERMS, jobs, on_jobs, query, s_any, s_title_case, sql_text, table
from .classify import REGISTRY_SQL, ROUTE_SQL, wide_sql
from .filters import JOB_URL_SQL, career_sql

DAY = "2024-07-01"


def urls(spark, sf):
    return jobs(spark, sf).select("seq", F.col("job_url").alias("url"))


def registry(spark, sf):
    """Companies known before the run: those of suppliers and of every third document."""
    docs = jobs(spark, sf).select("seq", "job_url")
    platform, slug = router_platform(F.col("job_url"))
    known = (
        docs.select("seq", platform.alias("ats"), slug.alias("slug"))
        .filter((F.col("seq") % 3 == 0) & F.col("slug").isNotNull())
        .groupBy("ats", "slug")
        .agg(F.min("seq").alias("seq"))
    )
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("seq") % 90).cast("int")), "yyyy-MM-dd")
    learnt = known.select("ats", "slug", slug_to_name(F.col("slug")).alias("company_name"), F.lit("serpapi").alias("discovered_from"),
                          day.alias("discovered_date"), F.lit(None).cast("string").alias("url"))
    site = F.concat(F.lit("site"), F.col("s_suppkey").cast("string"))
    sites = table(spark, sf, "supplier").select(
        F.lit("workday").alias("ats"), site.alias("slug"), F.col("s_name").alias("company_name"), F.lit("list").alias("discovered_from"),
        F.lit("2023-12-01").alias("discovered_date"),
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("https://"), site, F.lit(".wd1.myworkdayjobs.com/Careers"))).alias("url"),
    )
    return learnt.unionByName(sites)


_KNOWN_ATS, _KNOWN_SLUG = ROUTE_SQL
REGISTRY_CTE = f"""registry AS (SELECT ats, slug, {s_title_case("replace(slug, '-', ' ')")} AS company_name, 'serpapi' AS discovered_from,
    strftime(DATE '2024-01-01' + CAST(seq % 90 AS INTEGER), '%Y-%m-%d') AS discovered_date, NULL::VARCHAR AS url
  FROM (SELECT {_KNOWN_ATS} AS ats, {_KNOWN_SLUG} AS slug, min(seq) AS seq FROM jobs WHERE seq % 3 = 0 GROUP BY 1, 2) WHERE slug IS NOT NULL
  UNION ALL SELECT 'workday', 'site' || s_suppkey, s_name, 'list', '2023-12-01',
    CASE WHEN s_suppkey % 4 <> 0 THEN 'https://site' || s_suppkey || '.wd1.myworkdayjobs.com/Careers' END FROM supplier)"""

_ATS, _SLUG = REGISTRY_SQL
_SEEN = f"""seen AS (SELECT seq, 0 AS pos, job_url, company, source FROM jobs UNION ALL SELECT seq, 1, company_url, company, source FROM jobs),
 found AS (SELECT *, {_ATS} AS ats, {_SLUG} AS slug FROM seen),
 firsts AS (SELECT ats, slug, company AS company_name, coalesce(source, 'unknown') AS discovered_from, CASE WHEN ats = 'workday' THEN job_url END AS url
   FROM (SELECT *, row_number() OVER (PARTITION BY ats, slug ORDER BY seq, pos) AS rn FROM found WHERE ats IS NOT NULL) WHERE rn = 1)"""


@query("learn_companies", on_jobs(f"SELECT f.*, '{DAY}' AS discovered_date FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.ats = f.ats AND r.slug = f.slug)", f"{_SEEN}, {REGISTRY_CTE}"))
def learn_companies(spark, sf):
    return CO.learn_companies(jobs(spark, sf), registry(spark, sf), DAY)


_IN_URLS = f"in_urls AS (SELECT DISTINCT {_ATS} AS ats, {_SLUG} AS slug FROM jobs WHERE {JOB_URL_SQL})"


@query("join_registry_new", on_jobs("SELECT ats, slug FROM in_urls u WHERE ats IS NOT NULL AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.ats = u.ats AND r.slug = u.slug)", f"{_IN_URLS}, {REGISTRY_CTE}"))
def join_registry_new(spark, sf):
    return CO.new_companies(CO.companies_in_urls(urls(spark, sf), DAY), registry(spark, sf)).select("ats", "slug")


@query("set_registry_delta", on_jobs(f"SELECT ats, slug, {s_title_case('replace(slug, chr(45), chr(32))')} AS company_name, 'serpapi' AS discovered_from, url FROM (SELECT ats, slug, CASE WHEN ats = 'workday' THEN arg_min(job_url, seq) END AS url FROM (SELECT seq, job_url, {_ATS} AS ats, {_SLUG} AS slug FROM jobs WHERE {JOB_URL_SQL}) WHERE ats IS NOT NULL GROUP BY 1, 2) u WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.ats = u.ats AND r.slug = u.slug)", REGISTRY_CTE))
def set_registry_delta(spark, sf):
    found = CO.companies_in_urls(urls(spark, sf), DAY)
    return CO.new_companies(found, registry(spark, sf)).select("ats", "slug", "company_name", "discovered_from", "url")


def curated(spark, sf):
    return table(spark, sf, "customer").select(
        F.element_at(F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("ashby")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("ats"),
        F.concat(F.lit("customer-"), (F.col("c_custkey") % 900).cast("string")).alias("slug"),
    )


CURATED_SQL = "curated AS (SELECT (['greenhouse', 'lever', 'ashby'])[1 + c_custkey % 3] AS ats, 'customer-' || (c_custkey % 900) AS slug FROM customer)"


@query("join_registry_slugs", on_jobs("SELECT ats, slug FROM curated UNION SELECT ats, slug FROM registry", f"{REGISTRY_CTE}, {CURATED_SQL}"))
def join_registry_slugs(spark, sf):
    return CO.slugs_to_query(curated(spark, sf), registry(spark, sf))


@query("set_distinct_slugs", on_jobs("SELECT ats, slug FROM curated UNION SELECT ats, slug FROM in_urls WHERE ats IS NOT NULL", f"{_IN_URLS}, {CURATED_SQL}"))
def set_distinct_slugs(spark, sf):
    return CO.slugs_to_query(curated(spark, sf), CO.companies_in_urls(urls(spark, sf), DAY))


# Companies that customers stand for; some have the names of suppliers, whose sites were learnt.
_CURATED_SITES = "SELECT DISTINCT 'Supplier#' || lpad(CAST(c_custkey * 3 % 2000 AS VARCHAR), 9, '0') AS company_name, 'https://curated.wd5.myworkdayjobs.com/' || (c_custkey * 3 % 2000) AS url FROM customer"


@query("join_workday_override", f"SELECT coalesce(c.company_name, r.company_name) AS company_name, coalesce(r.url, c.url) AS url FROM ({_CURATED_SITES}) c FULL JOIN (SELECT s_name AS company_name, 'https://site' || s_suppkey || '.wd1.myworkdayjobs.com/Careers' AS url FROM supplier WHERE s_suppkey % 4 <> 0) r ON r.company_name = c.company_name")
def join_workday_override(spark, sf):
    key = (F.col("c_custkey") * 3 % 2000).cast("string")
    sites = table(spark, sf, "customer").select(
        F.concat(F.lit("Supplier#"), F.lpad(key, 9, "0")).alias("company_name"), F.concat(F.lit("https://curated.wd5.myworkdayjobs.com/"), key).alias("url")
    )
    return CO.workday_sites(sites.distinct(), registry(spark, sf))


@query("join_ats_classify", on_jobs(f"SELECT seq, job_url AS url, {ROUTE_SQL[0]} AS platform, {ROUTE_SQL[1]} AS slug FROM jobs"))
def join_ats_classify(spark, sf):
    return CO.classify_urls(urls(spark, sf))


@query("agg_distinct_companies", on_jobs("SELECT platform, slug, min(seq) AS first_seq FROM (SELECT seq, " + f"{ROUTE_SQL[0]} AS platform, {ROUTE_SQL[1]} AS slug FROM jobs) WHERE slug IS NOT NULL GROUP BY 1, 2"))
def agg_distinct_companies(spark, sf):
    return CO.companies_to_fetch(CO.classify_urls(urls(spark, sf)))


_ROUTED = f"routed AS (SELECT seq, job_url AS url, {ROUTE_SQL[0]} AS platform, {ROUTE_SQL[1]} AS slug FROM jobs WHERE {JOB_URL_SQL})"


@query(
    "route_urls",
    on_jobs(
        """SELECT platform, slug AS target, min(seq) AS first_seq FROM routed WHERE slug IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT platform, url, min(seq) FROM routed WHERE slug IS NULL AND platform <> 'generic' GROUP BY 1, 2
        UNION ALL (SELECT platform, url, seq FROM routed WHERE platform = 'generic')""",
        _ROUTED,
    ),
)
def route_urls(spark, sf):
    return CO.route_urls(urls(spark, sf))


@query("agg_registry_by_ats", on_jobs("SELECT ats, count(*) AS n FROM registry GROUP BY ats", REGISTRY_CTE))
def agg_registry_by_ats(spark, sf):
    return SU.registry_by_platform(registry(spark, sf))


@query("topk_recent_companies", on_jobs("SELECT ats, slug, discovered_date FROM registry ORDER BY discovered_date DESC, ats, slug LIMIT 10", REGISTRY_CTE))
def topk_recent_companies(spark, sf):
    return OR.recent_companies(registry(spark, sf)).select("ats", "slug", "discovered_date")


@query("lim_per_platform", on_jobs("SELECT ats, slug FROM (SELECT ats, slug, row_number() OVER (PARTITION BY ats ORDER BY slug) AS rn FROM (SELECT ats, slug FROM registry UNION SELECT ats, slug FROM curated)) WHERE rn <= 200", f"{REGISTRY_CTE}, {CURATED_SQL}"))
def lim_per_platform(spark, sf):
    return OR.first_per_platform(CO.slugs_to_query(curated(spark, sf), registry(spark, sf)))


@query("sink_registry", on_jobs("SELECT ats, slug FROM registry UNION SELECT ats, slug FROM in_urls WHERE ats IS NOT NULL", f"{REGISTRY_CTE}, {_IN_URLS}"))
def sink_registry(spark, sf):
    from vacancia.session import TableSpool

    path = TableSpool(spark, "registry").path("companies")
    registry_rows(registry(spark, sf)).write.parquet(path)
    known = spark.read.parquet(path)
    append_new_companies(registry_rows(CO.companies_in_urls(urls(spark, sf), DAY)), known, path)
    return spark.read.parquet(path).select("ats", "slug")


# --- landed contents of company sites ---------------------------------------------------------------------


def sitemaps(spark, sf):
    """A sitemap per posting: its URLs, one per line or all in one line."""
    body = F.concat(
        F.lit("<urlset>\n<url><loc>https://a.example.com/about</loc></url>\n<url><loc>"), F.col("job_url"), F.lit("</loc></url>\n"),
        F.lit("<loc>"), F.coalesce("company_url", F.lit("")), F.lit("</loc>\n<loc>https://a.example.com/Join-Us</loc>\n</urlset>"),
    )
    one_line = F.replace(body, F.lit("\n"), F.lit(""))
    return jobs(spark, sf).select("seq", F.when(F.col("seq") % 2 == 0, body).otherwise(one_line).alias("sitemap"))


def _career(x: str) -> str:
    return s_any(f"lower({x})", V.CAREER_URL_WORDS)


@query("src_sitemap_career", on_jobs(f"SELECT seq, CASE WHEN {_career('job_url')} THEN job_url WHEN {_career("coalesce(company_url, '')")} THEN company_url ELSE 'https://a.example.com/Join-Us' END AS url FROM jobs"))
def src_sitemap_career(spark, sf):
    return sitemaps(spark, sf).select("seq", CO.sitemap_career_url(F.col("sitemap")).alias("url"))


@query(
    "src_robots_sitemaps",
    on_jobs(
        """SELECT seq, CASE seq % 3 WHEN 0 THEN 'https://a.example.com/sitemap.xml' WHEN 1 THEN 'https://a.example.com/one.xml https://a.example.com/sitemap.xml'
        ELSE 'https://b.example.com/x?y=1:2 https://a.example.com/sitemap.xml' END AS sitemaps FROM jobs"""
    ),
)
def src_robots_sitemaps(spark, sf):
    lines = (
        F.when(F.col("seq") % 3 == 0, "User-agent: *\r\nSITEMAP: https://a.example.com/sitemap.xml\nDisallow: /")
        .when(F.col("seq") % 3 == 1, "  Sitemap:https://a.example.com/one.xml  ")
        .otherwise("# Sitemap: no\nsitemap: https://b.example.com/x?y=1:2")
    )
    found = CO.robots_sitemaps(lines, F.lit("https://a.example.com"))
    return jobs(spark, sf).select("seq", F.array_join(found, " ").alias("sitemaps"))


_PAGE_DOMAIN = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_PROBE_HTML = "html || CASE page_id % 4 WHEN 0 THEN ' see boards.greenhouse.io/acme' WHEN 1 THEN ' Apply now. Open roles' ELSE '' END"
_PROBE_URL = "CASE WHEN page_id % 7 = 0 THEN 'https://jobs.lever.co/p' || page_id ELSE url END"
_U, _H, _S = wide_sql("probe_url"), wide_sql("probe_html"), wide_sql("site_url")


@query(
    "discover_careers",
    f"""WITH probes AS (SELECT {_PAGE_DOMAIN} AS domain, page_id AS ordinal, {_PROBE_URL} AS probe_url, {_PROBE_HTML} AS probe_html FROM pages),
    sites AS (SELECT {_PAGE_DOMAIN} AS domain, page_id % 4 AS ordinal, CASE WHEN page_id % 5 = 0 THEN 'https://jobs.ashbyhq.com/c' || page_id WHEN page_id % 11 = 0 THEN url || '/jobs' END AS site_url, page_id FROM pages),
    candidates AS (SELECT domain, 0 AS step, page_id AS ordinal, site_url AS career_url, {_S[0]} AS ats, {_S[1]} AS slug FROM sites WHERE site_url IS NOT NULL
      UNION ALL SELECT domain, 1, ordinal, probe_url, coalesce({_U[0]}, {_H[0]}), CASE WHEN {_U[0]} IS NOT NULL THEN {_U[1]} ELSE {_H[1]} END
      FROM probes WHERE coalesce({_U[0]}, {_H[0]}) IS NOT NULL OR {career_sql('probe_html')})
    SELECT domain, career_url, ats, slug FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step, CASE WHEN step = 0 THEN ordinal % 4 ELSE ordinal END, career_url) AS rn FROM candidates) WHERE rn = 1""",
)
def discover_careers(spark, sf):
    pages = table(spark, sf, "pages").withColumn("domain", F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    i = F.col("page_id")
    tail = F.when(i % 4 == 0, " see boards.greenhouse.io/acme").when(i % 4 == 1, " Apply now. Open roles").otherwise("")
    probes = pages.select(
        "domain", i.alias("ordinal"),
        F.when(i % 7 == 0, F.concat(F.lit("https://jobs.lever.co/p"), i.cast("string"))).otherwise(F.col("url")).alias("url"),
        F.concat("html", tail).alias("html"),
    )
    site = F.when(i % 5 == 0, F.concat(F.lit("https://jobs.ashbyhq.com/c"), i.cast("string"))).when(i % 11 == 0, F.concat("url", F.lit("/jobs")))
    firsts = pages.select("domain", (i % 4).alias("ordinal"), site.alias("url"))
    return CO.discover_careers(firsts, probes)


@query(
    "src_company_list",
    """SELECT ats, slug FROM (SELECT 'greenhouse' AS ats, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN 'slug-' || c_custkey
      WHEN 3 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN lower(c_mktsegment) ELSE 'x' END AS slug FROM customer
      UNION ALL SELECT 'greenhouse', 'Plain' || c_custkey FROM customer) WHERE length(slug) >= 2""",
)
def src_company_list(spark, sf):
    i = F.col("c_custkey")
    entry = (
        F.when(i % 6 == 0, F.to_json(F.array("c_name")))
        .when(i % 6 == 1, F.to_json(F.array(F.struct(F.col("c_name").alias("slug")))))
        .when(i % 6 == 2, F.to_json(F.array(F.struct(F.lit("").alias("slug"), F.concat(F.lit(" Slug-"), i.cast("string")).alias("company_slug")))))
        .when(i % 6 == 3, F.to_json(F.array(F.struct(i.alias("id"), F.lit("n").alias("name")))))
        .when(i % 6 == 4, F.to_json(F.array(F.struct(F.col("c_mktsegment").alias("name")))))
        .otherwise(F.lit('["x", 5, null]'))
    )
    both = F.concat(F.rtrim(entry, F.lit("]")), F.lit(', "Plain'), i.cast("string"), F.lit('"]'))
    lists = table(spark, sf, "customer").select(F.lit("greenhouse").alias("ats"), both.alias("payload"))
    return CO.parse_company_list(lists)


# --- queries and boards ---------------------------------------------------------------------------------------


@query(
    "src_query_expansion",
    "SELECT term, replace(replace(template, '{keyword}', term), '{location}', 'Germany') AS query FROM (SELECT DISTINCT p_name AS term FROM part), "
    f"(SELECT unnest([{', '.join(sql_text(t) for t in V.QUERY_TEMPLATES + V.LANGUAGE_QUERY_TEMPLATES['English'])}]) AS template)",
)
def src_query_expansion(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    return expand_queries(terms, "Germany", "English")


_EITHER = " OR ".join(f'"{t}"' for t in TERMS)


@query(
    "src_query_expansion_or",
    f"SELECT location, replace(replace(template, '{{roles_or}}', '{_EITHER}'), '{{location}}', location) AS query FROM (SELECT DISTINCT c_name AS location FROM customer), "
    f"(SELECT unnest([{', '.join(sql_text(t) for t in V.OR_QUERY_TEMPLATES)}]) AS template)",
)
def src_query_expansion_or(spark, sf):
    return expand_or_queries(table(spark, sf, "customer").select(F.col("c_name").alias("location")).distinct(), TERMS)


_COUNTRY = "(['India', 'UAE', 'Germany', 'Oman'])[1 + c_nationkey % 4]"


@query(
    "src_sites_for_country",
    f"SELECT c_custkey, CASE {_COUNTRY} WHEN 'India' THEN 'indeed,linkedin,naukri' WHEN 'Germany' THEN 'indeed,linkedin,google' ELSE 'indeed,linkedin,bayt' END AS boards FROM customer",
)
def src_sites_for_country(spark, sf):
    country = F.element_at(F.array(*[F.lit(c) for c in ("India", "UAE", "Germany", "Oman")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(boards_for_country(country), ",").alias("boards"))


