"""Filters and search predicates over derived postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia import fixed_values as V
from vacancia.operators import filters as FL, search as SE, tracker as TR
from vacancia.operators.normalize import require_fields

from .base import AS_OF, TERMS, jobs, on_jobs, query, s_any, s_host, s_low, s_strip, sql_text, table
from .classify import NORMAL_JOBS, REQUIRED_SQL
from .enrichment import events, TRACKER_SQL

SEQ = "SELECT seq FROM jobs WHERE "


def on(condition: str) -> str:
    return on_jobs(SEQ + condition)


def seqs(df):
    return df.select("seq")


@query("flt_required", on(REQUIRED_SQL))
def flt_required(spark, sf):
    return seqs(require_fields(jobs(spark, sf)))


@query(
    "flt_date",
    on_jobs(
        """SELECT 168 AS hours, seq FROM clean WHERE coalesce(date_posted, '') = '' OR date_posted >= '2024-06-24'
        UNION ALL SELECT 720, seq FROM clean WHERE coalesce(date_posted, '') = '' OR date_posted >= '2024-06-01'
        UNION ALL SELECT 8760, seq FROM clean""",
        NORMAL_JOBS,
    ),
)
def flt_date(spark, sf):
    from vacancia.operators.normalize import normalize_postings

    df = normalize_postings(jobs(spark, sf)).select("seq", "date_posted")
    parts = [FL.by_date(df, hours, AS_OF).select(F.lit(hours).alias("hours"), "seq") for hours in (168, 720, 8760)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


ASKED_SQL = "coalesce(nullif(language_required, ''), language, 'unknown')"
WANTED = {
    "English": f"{ASKED_SQL} IN ('English', 'English (German plus)') OR ({ASKED_SQL} = 'unknown' AND length({s_strip("coalesce(description, '')")}) < 50)",
    "English (German plus)": f"{ASKED_SQL} = 'English (German plus)'",
    "German": f"{ASKED_SQL} IN ('German', 'English (German plus)')",
    "French": f"{ASKED_SQL} IN ('French', 'unknown')",
    "All": "TRUE",
}


@query("flt_language_required", on_jobs(" UNION ALL ".join(f"SELECT '{w}' AS wanted, seq FROM jobs WHERE {c}" for w, c in WANTED.items())))
def flt_language_required(spark, sf):
    # one pass: which choices admit a posting
    choices = [F.when(FL.required_language_condition(w), F.lit(w)) for w in WANTED]
    admitted = F.filter(F.array(*choices), lambda w: w.isNotNull())
    return jobs(spark, sf).select(F.explode(admitted).alias("wanted"), "seq")


@query("flt_listing_language", on("listing_language IN ('French', 'unknown')"))
def flt_listing_language(spark, sf):
    return seqs(FL.by_listing_language(jobs(spark, sf), "French"))


LOC = s_low("location")
REMOTE_SQL = f"(coalesce(is_remote, FALSE) OR {s_any(LOC, V.REMOTE_LOCATION_WORDS)} OR contains({s_low('title')}, 'remote'))"
BLOCKED_SQL = s_any(LOC, V.BLOCKED_REMOTE)


def scope_sql(scope: list[str]) -> str:
    places = [p.lower() for p in scope]
    for country, cities in V.CITIES_OF_SCOPE.items():
        if country in places:
            places = places + cities
    india = f"WHEN {s_any(LOC, V.INDIA_MARKERS)} THEN TRUE" if "india" in places else ""
    return (
        f"CASE WHEN {REMOTE_SQL} THEN NOT {BLOCKED_SQL} WHEN length({s_strip(LOC)}) < 2 THEN TRUE "
        f"WHEN {s_any(LOC, places)} THEN TRUE WHEN {s_any(LOC, V.GERMANY_MARKERS)} THEN TRUE {india} ELSE {len(scope) > 1} END"
    )


SCOPES = {"Germany": ["Germany"], "India": ["India"], "Paris": ["Paris"], "several": ["France", "UK"], "none": []}


@query(
    "flt_location_scope",
    on_jobs(" UNION ALL ".join(f"SELECT '{n}' AS scope, seq FROM jobs WHERE {scope_sql(s) if s else 'TRUE'}" for n, s in SCOPES.items())),
)
def flt_location_scope(spark, sf):
    choices = [F.when(FL.location_scope_condition(s), F.lit(n)) for n, s in SCOPES.items()]
    admitted = F.filter(F.array(*choices), lambda n: n.isNotNull())
    return jobs(spark, sf).select(F.explode(admitted).alias("scope"), "seq")


@query("flt_remote_job", on(REMOTE_SQL))
def flt_remote_job(spark, sf):
    return seqs(FL.remote_jobs(jobs(spark, sf)))


@query("flt_blocked_remote", on(BLOCKED_SQL))
def flt_blocked_remote(spark, sf):
    return seqs(FL.blocked_remote(jobs(spark, sf)))


TITLE, TEXT = s_low("title"), s_low("description")


def every(x: str, term: str) -> str:
    return "(" + " AND ".join(f"contains({x}, {sql_text(w)})" for w in term.lower().split()) + ")"


ANY_SQL = f"({s_any(TITLE, ['scrum', 'developer'])} OR {s_any(TEXT, ['scrum', 'developer'])})"
ALL_SQL = "(" + " OR ".join(f"{every(TITLE, t)} OR {every(TEXT, t)}" for t in TERMS) + ")"


@query("flt_search_any_word", on(ANY_SQL))
def flt_search_any_word(spark, sf):
    return seqs(SE.any_word(jobs(spark, sf), "Scrum Developer"))


@query("flt_search_all_words", on(ALL_SQL))
def flt_search_all_words(spark, sf):
    return seqs(SE.all_words(jobs(spark, sf), TERMS))


_TAGGED = ["owner team", "qa", "office it"]
_BLOB = "lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(location, ''))"


@query(
    "flt_search_tagged",
    on(" OR ".join(f"contains({TITLE}, {sql_text(t)}) OR {every(TITLE, t)} OR {every(_BLOB, t)}" for t in _TAGGED)),
)
def flt_search_tagged(spark, sf):
    return seqs(SE.tagged(jobs(spark, sf), _TAGGED, F.col("location")))


@query("flt_search_blob_any", on(s_any("lower(coalesce(title, '') || ' ' || coalesce(description, ''))", ["agile", "vp"])))
def flt_search_blob_any(spark, sf):
    return seqs(SE.blob_any_word(jobs(spark, sf), "Agile VP"))


@query("flt_location_substring", on(f"contains({LOC}, 'germany')"))
def flt_location_substring(spark, sf):
    return seqs(FL.by_location_text(jobs(spark, sf), "Germany"))


@query("flt_location_or_remote", on(s_any(LOC, ["berlin", "paris", "remote"])))
def flt_location_or_remote(spark, sf):
    return seqs(FL.by_location_or_remote(jobs(spark, sf), ["Berlin", "Paris"]))


@query("flt_location_tokens_only", on(s_any(LOC, ["berlin", "paris"])))
def flt_location_tokens_only(spark, sf):
    return seqs(FL.by_location_places(jobs(spark, sf), ["Berlin", "Paris "]))


@query("flt_location_or_worldwide", on(s_any(LOC, ["berlin", "worldwide"])))
def flt_location_or_worldwide(spark, sf):
    return seqs(FL.by_location_or_worldwide(jobs(spark, sf), ["Berlin"]))


@query("flt_jobs_combined", on_jobs(f"SELECT 'strict' AS mode, seq FROM jobs WHERE {ALL_SQL} AND contains({LOC}, 'remote') UNION ALL SELECT 'loose', seq FROM jobs WHERE {ANY_SQL}"))
def flt_jobs_combined(spark, sf):
    df = jobs(spark, sf)
    strict = SE.filter_jobs(df, terms=TERMS, location="Remote", strict=True).select(F.lit("strict").alias("mode"), "seq")
    return strict.unionAll(SE.filter_jobs(df, term="Scrum Developer").select(F.lit("loose"), "seq"))


JOB_URL_SQL = f"NOT {s_any('lower(job_url)', V.BLOCKED_URL_PARTS)} AND {s_any('lower(job_url)', V.JOB_URL_PARTS)}"


@query("flt_valid_job_url", on(JOB_URL_SQL))
def flt_valid_job_url(spark, sf):
    return seqs(FL.valid_job_urls(jobs(spark, sf), "job_url"))


@query(
    "flt_max_age_90d",
    """SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'soon' END AS released, o_orderdate FROM orders)
    WHERE released = 'soon' OR o_orderdate >= TIMESTAMP '1998-04-02 00:00:00'""",
)
def flt_max_age_90d(spark, sf):
    import datetime as dt

    day, i = F.col("o_orderdate"), F.col("o_orderkey") % 4
    stamp = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")
    released = F.when(i == 0, F.concat(stamp, F.lit("Z"))).when(i == 1, F.date_format(day, "yyyy-MM-dd")).when(
        i == 2, F.concat(stamp, F.lit("+02:00"))
    ).otherwise("soon")
    df = table(spark, sf, "orders").withColumn("released", released)
    return FL.released_within(df, "released", dt.datetime(1998, 7, 1)).select("o_orderkey")


NEEDS_SALARY_SQL = "coalesce(salary_min, 0) = 0 AND coalesce(salary_max, 0) = 0"


@query("flt_needs_salary_estimate", on(NEEDS_SALARY_SQL))
def flt_needs_salary_estimate(spark, sf):
    return seqs(FL.needs_salary_estimate(jobs(spark, sf)))


@query("flt_needs_ai_language", on("coalesce(ai_detected_language, '') = ''"))
def flt_needs_ai_language(spark, sf):
    return seqs(FL.needs_ai_language(jobs(spark, sf)))


def career_sql(x: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {sql_text(s)}) AS INTEGER)" for s in V.CAREER_SIGNALS) + ") >= 2"


@query("flt_career_page", on_jobs(f"SELECT page_id FROM pages JOIN jobs ON seq = page_id WHERE {career_sql("(html || coalesce(description, ' '))")}"))
def flt_career_page(spark, sf):
    text = jobs(spark, sf).select(F.col("seq").alias("page_id"), "description")
    pages = table(spark, sf, "pages").join(text, "page_id")
    html = F.concat(F.col("html"), F.coalesce(F.col("description"), F.lit(" ")))
    return FL.career_pages(pages.withColumn("html", html)).select("page_id")


HOST_SQL = s_host("job_url")


@query("flt_crawl_domain", on_jobs(f"SELECT seq, domain FROM (SELECT seq, {HOST_SQL} AS domain FROM jobs) WHERE domain IS NOT NULL AND NOT {s_any('domain', V.KNOWN_BOARD_DOMAINS)}"))
def flt_crawl_domain(spark, sf):
    return FL.crawlable_hosts(jobs(spark, sf), "job_url").select("seq", "domain")


@query("flt_tracker_status", TRACKER_SQL + " SELECT 'applied' AS wanted, job_url FROM applications WHERE status = 'applied' UNION ALL SELECT 'bad', job_url FROM applications")
def flt_tracker_status(spark, sf):
    applications = TR.fold(events(spark, sf))
    wanted = FL.tracker_with_status(applications, "applied").select(F.lit("applied").alias("wanted"), "job_url")
    return wanted.unionAll(FL.tracker_with_status(applications, "no such status").select(F.lit("bad"), "job_url"))
