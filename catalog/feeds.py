"""Feed mappers over payloads derived from documents and pages.

Each document becomes one landed payload, in the shape its feed has, with two postings in it
where the feed has lists. The SQL gives the rows that a payload must map to, from what went
into it, without reading the payload.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from vacancia.sources import json_feeds as JF, pages as PG
from vacancia.sources.boards import map_board_rows

from .base import (
    jobs, on_jobs, query, s_element, s_low, s_posting, s_strip, s_strip_html, s_text_of, s_title_case, table,
)
from .classify import LPA_TEXT_SQL, SALARY_TEXT_SQL, lpa_sql, lpa_text, salary_sql, salary_text

ITEMS = 1 << 24


def docs(spark, sf):
    """Postings with the word and number of their document and a company slug."""
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1))
    base = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("n_chars").alias("k"), F.when(word == "", "acme").otherwise(word).alias("w"), "text"
    )
    slug = F.concat(F.col("w"), F.lit("-labs"))
    return base.join(jobs(spark, sf), "seq").withColumn("company_slug", slug)


DOCS = "docs AS (SELECT j.*, k, w, text, w || '-labs' AS slug, upper(left(w, 1)) || substr(w, 2) || ' Labs' AS name FROM jobs j JOIN base ON i = seq)"
# Markup around the text of a document, as feeds deliver it.
HTML_SQL = "'<p>' || text || '</p><br/>A &amp; B<ul><li>one</li></ul>'"


def html() -> Column:
    return F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><br/>A &amp; B<ul><li>one</li></ul>"))


def text_number(c: str) -> Column:
    return F.col(c).cast("string")


def both(first: dict[str, str], second: dict[str, str], where2: str = "TRUE", where1: str = "TRUE") -> str:
    """SQL of the two postings of each payload."""
    a = s_posting(first).replace("seq", f"seq * {ITEMS} AS seq", 1)
    b = s_posting(second).replace("seq", f"seq * {ITEMS} + 1 AS seq", 1)
    return on_jobs(f"SELECT {a} FROM docs WHERE {where1} UNION ALL SELECT {b} FROM docs WHERE {where2}", DOCS)


def remote(location: str, title: str) -> str:
    return f"CASE WHEN contains({s_low(location)}, 'remote') OR contains({s_low(title)}, 'remote') THEN TRUE END"


def payloads(df, payload: Column, *keep: str):
    return df.select("seq", "company_slug", payload.alias("payload"), *keep)


def obj(**fields) -> Column:
    """A JSON object; null fields are left out."""
    return F.struct(*[v.alias(k) for k, v in fields.items()])


# --- boards of one company ------------------------------------------------------------------------------

_GH = {"source": "'ats_discovery'", "ats_platform": "'greenhouse'", "location": "location", "company_url": "'https://boards.greenhouse.io/' || slug"}


@query(
    "src_greenhouse",
    both(
        {**_GH, "title": "title", "company": "name", "job_url": "'https://boards.greenhouse.io/' || slug || '/jobs/' || seq",
         "description": s_strip_html(HTML_SQL), "date_posted": "'2024-05-06'", "is_remote": remote("location", "title")},
        {**_GH, "title": "'B ' || k", "company": "'Named ' || w", "date_posted": "CASE WHEN seq % 2 = 0 THEN '2024-01-02' END",
         "is_remote": remote("location", "''")},
    ),
)
def src_greenhouse(spark, sf):
    df = docs(spark, sf)
    a = F.to_json(obj(id=F.col("seq"), title=F.col("title"), location=F.col("location"), content=html(), updated_at=F.lit("2024-05-06T07:08:09Z"), first_published=F.lit("2020-01-01")))
    b = F.to_json(obj(title=F.concat(F.lit("B "), text_number("k")), company=obj(name=F.concat(F.lit("Named "), F.col("w"))), location=obj(name=F.col("location")),
                      first_published=F.when(F.col("seq") % 2 == 0, "2024-01-02T00:00:00Z")))
    return JF.map_greenhouse(payloads(df, F.concat(F.lit('{"jobs": ['), a, F.lit(", "), b, F.lit("]}"))))


_LV = {"source": "'ats_discovery'", "ats_platform": "'lever'", "title": "title", "company": "name", "company_url": "'https://jobs.lever.co/' || slug",
       "location": "location", "is_remote": remote("location", "title")}
_LV_TYPE = """CASE WHEN contains(lower(job_type), 'full') THEN 'fulltime' WHEN contains(lower(job_type), 'part') THEN 'parttime'
  WHEN contains(lower(job_type), 'intern') THEN 'internship' WHEN contains(lower(job_type), 'contract') THEN 'contract' END"""


@query(
    "src_lever",
    both(
        {**_LV, "job_type": _LV_TYPE, "job_url": "CASE WHEN seq % 3 = 0 THEN 'https://hosted/' || seq WHEN seq % 3 = 1 THEN 'https://apply/' || seq ELSE 'https://jobs.lever.co/' || slug || '/id' || seq END",
         "description": f"text || chr(10) || chr(10) || chr(10) || 'Tasks' || chr(10) || chr(10) || {s_strip_html(HTML_SQL)} || chr(10) || chr(10) || 'bye'",
         "date_posted": "strftime(DATE '2024-01-01' + CAST(seq % 300 AS INTEGER), '%Y-%m-%d')"},
        {**_LV, "location": "NULL", "is_remote": remote("''", "title"), "job_url": "'https://apply/' || seq"},
    ),
)
def src_lever(spark, sf):
    df = docs(spark, sf)
    i, number = F.col("seq"), text_number("seq")
    millis = (F.unix_date(F.lit("2024-01-01").cast("date")) + i % 300).cast("bigint") * 86400000 + 3600000
    a = F.to_json(obj(
        id=F.concat(F.lit("id"), number), text=F.col("title"), categories=obj(location=F.col("location"), commitment=F.col("job_type")),
        hostedUrl=F.when(i % 3 == 0, F.concat(F.lit("https://hosted/"), number)), applyUrl=F.when(i % 3 != 2, F.concat(F.lit("https://apply/"), number)),
        descriptionPlain=F.col("text"), lists=F.array(obj(text=F.lit("Tasks"), content=html())), additional=F.lit("<b>bye</b>"), createdAt=millis,
    ))
    b = F.to_json(obj(text=F.col("title"), applyUrl=F.concat(F.lit("https://apply/"), number)))
    return JF.map_lever(payloads(df, F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))))


_AS = {"source": "'ats_discovery'", "ats_platform": "'ashby'", "title": "title", "company": "name", "company_url": "'https://jobs.ashbyhq.com/' || slug"}
_AS_TYPE = """CASE WHEN contains(lower(job_type), 'full') THEN 'fulltime' WHEN contains(lower(job_type), 'part') THEN 'parttime'
  WHEN contains(lower(job_type), 'contract') THEN 'contract' WHEN contains(lower(job_type), 'intern') THEN 'internship' END"""


@query(
    "src_ashby",
    both(
        {**_AS, "location": "CASE WHEN coalesce(location, '') <> '' THEN location || ', ' ELSE '' END || 'Bonn, Remote hub'", "job_type": _AS_TYPE, "is_remote": "coalesce(is_remote, TRUE)",
         "salary_min": "salary_min", "salary_max": "salary_max", "salary_currency": "salary_currency", "salary_interval": "lower(salary_interval)",
         "job_url": "'https://jobs.ashbyhq.com/' || slug || '/' || seq", "description": s_strip_html(HTML_SQL), "date_posted": "'2024-02-03'"},
        {**_AS, "location": "location", "is_remote": "CASE WHEN contains(lower(location), 'remote') THEN TRUE END", "job_url": "'https://hosted/' || seq",
         "description": "'plain & simple'", "date_posted": "'2024-03-04'", "salary_interval": "'month'"},
    ),
)
def src_ashby(spark, sf):
    df = docs(spark, sf)
    a = F.to_json(obj(
        id=text_number("seq"), title=F.col("title"), location=F.col("location"), secondaryLocations=F.lit("@@"), employmentType=F.col("job_type"),
        isRemote=F.col("is_remote"), descriptionHtml=html(), publishedDate=F.lit("2024-02-03T00:00:00"), updatedAt=F.lit("2023-01-01"),
        compensation=obj(range=obj(min=F.col("salary_min"), max=F.col("salary_max")), currency=F.col("salary_currency"), interval=F.col("salary_interval")),
    ))
    a = F.replace(a, F.lit('"@@"'), F.lit('["Bonn", {"name": "Remote hub"}]'))
    b = F.to_json(obj(title=F.col("title"), location=obj(name=F.col("location")), hostedUrl=F.concat(F.lit("https://hosted/"), text_number("seq")),
                      descriptionPlain=F.lit("plain & simple"), createdAt=F.lit("2024-03-04 10:00"), compensation=obj(period=F.lit("MONTH"))))
    return JF.map_ashby(payloads(df, F.concat(F.lit('{"jobs": ['), a, F.lit(", "), b, F.lit("]}"))))


_SR = {"source": "'ats_discovery'", "ats_platform": "'smartrecruiters'", "company_url": "'https://jobs.smartrecruiters.com/' || slug"}
_SR_PLACE = "array_to_string(list_filter([nullif(location, ''), nullif(country, '')], lambda x: x IS NOT NULL), ', ')"
_SR_TYPE = """coalesce(CASE WHEN contains(lower(job_type), 'full') THEN 'fulltime' WHEN contains(lower(job_type), 'part') THEN 'parttime'
  WHEN contains(lower(job_type), 'contract') THEN 'contract' END, CASE WHEN seq % 2 = 0 THEN 'internship' END)"""


@query(
    "src_smartrecruiters",
    both(
        {**_SR, "title": "coalesce(nullif(title, ''), 'Fallback')", "company": "'Named ' || w", "location": f"CASE WHEN coalesce(location, '') = '' AND coalesce(country, '') = '' THEN NULL ELSE {_SR_PLACE} END",
         "country": "coalesce(country, '')", "is_remote": f"CASE WHEN seq % 5 = 0 OR contains({s_low(_SR_PLACE)}, 'remote') THEN TRUE END", "job_type": _SR_TYPE,
         "salary_min": "salary_min", "salary_max": "salary_max", "salary_currency": "salary_currency",
         "job_url": "CASE seq % 4 WHEN 0 THEN 'https://custom/' || seq WHEN 1 THEN 'https://ref/' || seq WHEN 2 THEN 'https://jobs.smartrecruiters.com/' || slug || '/p' || seq ELSE 'https://jobs.smartrecruiters.com/' || slug END",
         "description": f"{s_strip_html(HTML_SQL + '|| chr(10) || chr(10) || ' + chr(39) + 'more' + chr(39))}", "date_posted": "strftime(DATE '2024-01-01' + CAST(seq % 300 AS INTEGER), '%Y-%m-%d')"},
        {**_SR, "title": "'B'", "company": "name", "location": "location", "country": "CASE WHEN location IS NULL THEN '' END", "is_remote": "CASE WHEN contains(lower(location), 'remote') THEN TRUE END",
         "job_url": "'https://jobs.smartrecruiters.com/' || slug", "description": "'a > b'", "date_posted": "'undated'"},
        where1="seq % 300 >= 91",
    ),
)
def src_smartrecruiters(spark, sf):
    df = docs(spark, sf)
    i, number = F.col("seq"), text_number("seq")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd")
    a = F.to_json(obj(
        id=F.when(i % 4 == 2, F.concat(F.lit("p"), number)), name=F.col("title"), title=F.lit("Fallback"), company=obj(name=F.concat(F.lit("Named "), F.col("w"))),
        location=obj(city=F.col("location"), region=F.lit(""), country=F.col("country"), remote=i % 5 == 0),
        ref=F.when(i % 4 == 1, F.concat(F.lit("https://ref/"), number)).otherwise(F.lit("https://api.smartrecruiters.com/v1/x")),
        customCareerSiteUrl=F.when(i % 4 == 0, F.concat(F.lit("https://custom/"), number)), jobDescription=html(), qualifications=F.lit(""), additionalInformation=F.lit("more"),
        releasedDate=F.concat(day, F.lit("T00:00:00.000Z")), experienceLevel=obj(id=F.when(i % 2 == 0, "Internship").otherwise("mid")), typeOfEmployment=obj(id=F.col("job_type")),
        compensation=obj(range=obj(min=F.col("salary_min"), max=F.col("salary_max")), currency=F.col("salary_currency")),
    ))
    b = F.to_json(obj(title=F.lit("B"), location=F.col("location"), jobDescription=F.lit("a > b"), createdOn=F.lit("undated")))
    return JF.map_smartrecruiters(payloads(df, F.concat(F.lit('{"content": ['), a, F.lit(", "), b, F.lit("]}"))), dt.datetime(2024, 6, 30))


_WD_SITE = "'https://' || slug || '.wd3.myworkdayjobs.com'"
_WD = {"source": "'ats_discovery'", "ats_platform": "'workday'", "title": "title", "company": "name", "company_url": f"{_WD_SITE} || '/External'"}


@query(
    "src_workday_search",
    both(
        {**_WD, "location": "coalesce(nullif(location, ''), 'R-1')", "date_posted": "'Posted Tod'", "job_url": f"{_WD_SITE} || '/External/job/Berlin/' || seq",
         "job_type": "CASE seq % 3 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'parttime' END", "is_remote": "CASE WHEN seq % 2 = 0 THEN TRUE END"},
        {**_WD, "job_url": _WD_SITE},
    ),
)
def src_workday_search(spark, sf):
    df = docs(spark, sf).withColumn("site_url", F.concat(F.lit("https://"), F.col("company_slug"), F.lit(".wd3.myworkdayjobs.com/en-US/External")))
    i = F.col("seq")
    bullets = F.array(F.lit("R-1"), F.when(i % 2 == 0, "Fully Remote").otherwise("On site"), F.when(i % 3 == 0, "Full Time").when(i % 3 == 1, "Part-time"))
    a = F.to_json(obj(title=F.col("title"), locationsText=F.col("location"), bulletFields=bullets, postedOn=F.lit("Posted Today"), externalPath=F.concat(F.lit("/job/Berlin/"), text_number("seq"))))
    b = F.to_json(obj(title=F.col("title")))
    return JF.map_workday_search(payloads(df, F.concat(F.lit('{"total": 2, "jobPostings": ['), a, F.lit(", "), b, F.lit("]}")), "site_url"))


_WD_URL = f"{_WD_SITE} || '/External/job/Berlin/' || seq"


@query(
    "src_workday_detail",
    on_jobs(
        "SELECT " + s_posting(
            {"source": "'ats_discovery'", "ats_platform": "'workday'", "title": "coalesce(nullif(title, ''), 'Fallback')", "company": "CASE WHEN seq % 2 = 0 THEN 'Own' ELSE name END",
             "location": "coalesce(nullif(location, ''), 'Elsewhere')", "is_remote": remote("location", "title"), "job_url": _WD_URL, "company_url": f"{_WD_SITE} || '/External'",
             "description": s_strip_html(HTML_SQL), "date_posted": "'2024-04-05'", "job_type": "CASE WHEN seq % 2 = 0 THEN 'fulltime' ELSE 'parttime' END"}
        ) + " FROM docs", DOCS),
)
def src_workday_detail(spark, sf):
    df = docs(spark, sf)
    df = df.withColumn("site_url", F.concat(F.lit("https://"), F.col("company_slug"), F.lit(".wd3.myworkdayjobs.com/External/job/Berlin/"), text_number("seq")))
    even = F.col("seq") % 2 == 0
    info = obj(title=F.col("title"), jobPostingTitle=F.lit("Fallback"), company=F.when(even, "Own"), location=F.col("location"), locationsText=F.lit("Elsewhere"), description=html(),
               postedOn=F.lit("2024-04-05T00:00"), startDate=F.lit("2020-01-01"), timeType=F.when(even, "FULL_TIME"), jobSchedule=F.lit("part time"))
    # the information is wrapped in some payloads and bare in others
    payload = F.when(F.col("seq") % 3 == 0, F.to_json(obj(jobPostingInfo=info))).otherwise(F.to_json(info))
    return JF.map_workday_detail(payloads(df, payload, "site_url"))


_PX = {"source": "'ats_discovery'", "ats_platform": "'personio'", "company": "name", "title": "'A ' || k", "company_url": "'https://' || slug || '.jobs.personio.de'"}


@query(
    "src_personio_xml",
    both(
        {**_PX, "location": "'Berlin'", "date_posted": "'2024-05-06'", "job_type": "CASE seq % 3 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'parttime' END",
         "job_url": "'https://' || slug || '.jobs.personio.de/job/' || seq", "description": "w || ' <b>' || chr(10) || chr(10) || 'Tech'"},
        {**_PX, "title": "'B'", "job_url": "'https://' || slug || '.jobs.personio.de/job/9'"},
        where2="seq % 2 = 0",
    ),
)
def src_personio_xml(spark, sf):
    df = docs(spark, sf)
    i, number = F.col("seq"), text_number("seq")
    schedule = F.when(i % 3 == 0, "full-time").when(i % 3 == 1, "Part-Time").otherwise("other")
    xml = F.concat(
        F.lit("<?xml version='1.0'?><workzag-jobs><position><id>"), number, F.lit("</id><name> A "), text_number("k"), F.lit(" </name><office>Berlin</office><schedule>"), schedule,
        F.lit("</schedule><createdAt>2024-05-06T10:00:00</createdAt><description>"), F.col("w"), F.lit(" &lt;b&gt;</description><recruitingCategory>Tech</recruitingCategory></position><position>"),
        F.when(i % 2 == 0, "<id>9</id>").otherwise(""), F.lit("<name>B</name></position></workzag-jobs>"),
    )
    return PG.map_personio_xml(payloads(df, xml))


# --- boards of many companies ------------------------------------------------------------------------------------

_AN_DAY = "strftime(DATE '2024-01-01' + CAST(seq % 300 AS INTEGER), '%Y-%m-%d')"


@query(
    "src_arbeitnow",
    both(
        {"source": "'arbeitnow'", "title": "coalesce(title, '')", "company": "coalesce(company, '')", "location": "coalesce(location, '')", "description": "text", "is_remote": "coalesce(is_remote, FALSE)",
         "date_posted": _AN_DAY, "job_type": "CASE seq % 5 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'parttime' WHEN 2 THEN 'contract' WHEN 3 THEN 'internship' END", "job_url": "'https://www.arbeitnow.com/view/' || w || '-' || seq"},
        {"source": "'arbeitnow'", "title": "'B'", "company": "''", "location": "''", "description": "''", "is_remote": "seq % 2 = 0", "date_posted": f"CASE WHEN seq % 2 = 0 THEN '2024-09-10' ELSE {_AN_DAY} END", "job_url": "'https://x/' || seq"},
    ),
)
def src_arbeitnow(spark, sf):
    df = docs(spark, sf)
    i = F.col("seq")
    seconds = (F.unix_date(F.lit("2024-01-01").cast("date")) + i % 300).cast("bigint") * 86400 + 7200
    tags = F.array(F.lit("IT"), F.when(i % 5 == 0, "Full-Time").when(i % 5 == 1, "parttime").when(i % 5 == 2, "Freelance").when(i % 5 == 3, "intern").otherwise("internal"))
    a = F.to_json(obj(slug=F.concat(F.col("w"), F.lit("-"), text_number("seq")), title=F.col("title"), company_name=F.col("company"), location=F.col("location"), description=F.col("text"),
                      remote=F.col("is_remote"), tags=tags, created_at=seconds))
    b = F.to_json(obj(url=F.concat(F.lit("https://x/"), text_number("seq")), slug=F.lit("no"), title=F.lit("B"), remote=F.when(i % 2 == 0, "Yes").otherwise("no"),
                      created_at=F.when(i % 2 == 0, "2024-09-10T11:00:00").otherwise(seconds.cast("string"))))
    nothing = F.lit('{"title": "no link"}')
    return JF.map_arbeitnow(payloads(df, F.concat(F.lit('{"data": ['), a, F.lit(", "), b, F.lit(", "), nothing, F.lit("]}"))))


_RM_PAY = salary_sql(f"({SALARY_TEXT_SQL})")
_RM_LOOSE = f"""CASE WHEN coalesce(job_type, '') = '' THEN NULL WHEN contains(lower(job_type), 'full') THEN 'fulltime' WHEN contains(lower(job_type), 'part') THEN 'parttime'
  WHEN contains(lower(job_type), 'contract') OR contains(lower(job_type), 'freelance') THEN 'contract' WHEN contains(lower(job_type), 'intern') THEN 'internship' ELSE {s_strip('lower(job_type)')} END"""


@query(
    "src_remotive",
    on_jobs(
        "SELECT " + s_posting(
            {"source": "'remotive'", "title": "coalesce(title, '')", "company": "coalesce(company, '')", "location": "coalesce(nullif(location, ''), 'Remote')", "description": "text", "is_remote": "TRUE",
             "date_posted": "'2024-06-07'", "job_type": _RM_LOOSE, "salary_min": _RM_PAY["low"], "salary_max": _RM_PAY["high"], "salary_currency": _RM_PAY["currency"],
             "salary_interval": f"CASE WHEN {_RM_PAY['low']} <> 0 THEN 'yearly' END", "job_url": "'https://r/' || seq", "company_url": "'https://logo/' || w"}
        ).replace("seq", f"seq * {ITEMS} AS seq", 1) + " FROM docs", DOCS),
)
def src_remotive(spark, sf):
    df = docs(spark, sf)
    a = F.to_json(obj(title=F.col("title"), company_name=F.col("company"), candidate_required_location=F.col("location"), description=F.col("text"), category=F.lit("product"),
                      job_type=F.col("job_type"), publication_date=F.lit("2024-06-07T00:00:00"), url=F.concat(F.lit("https://r/"), text_number("seq")), salary=salary_text(),
                      company_logo_url=F.concat(F.lit("https://logo/"), F.col("w"))))
    return JF.map_remotive(payloads(df, F.concat(F.lit('{"jobs": ['), a, F.lit(', {"title": "no link", "url": ""}]}'))))


_SITE = "coalesce(source, 'unknown')"


@query(
    "src_board_rows",
    on_jobs(
        "SELECT " + s_posting(
            {"source": f"lower({s_strip(_SITE)})", "title": "title", "company": "company", "location": "location", "country": "country", "date_posted": "left(date_posted, 10)",
             "job_type": f"lower({s_strip('job_type')})", "is_remote": "is_remote", "salary_min": "salary_min", "salary_max": "salary_max", "salary_currency": "nullif(salary_currency, '')",
             "salary_interval": "nullif(salary_interval, '')", "job_url": f"{s_strip('coalesce(link1, link2, link3)')}", "description": "description"}
        ) + f" FROM board WHERE {s_strip('coalesce(link1, link2, link3)')} <> ''",
        "board AS (SELECT *, CASE WHEN seq % 3 = 0 THEN nullif(job_url, '') END AS link1, CASE WHEN seq % 3 = 1 THEN nullif(company_url, '') END AS link2, nullif(job_url, '') AS link3 FROM jobs)",
    ),
)
def src_board_rows(spark, sf):
    i, nan = F.col("seq"), F.lit(float("nan"))
    rows = jobs(spark, sf).select(
        "seq", F.col("source").alias("site"), "title", "company", "location", "country", "date_posted", "job_type", "is_remote", "description",
        F.coalesce("salary_min", nan).alias("min_amount"), F.coalesce("salary_max", nan).alias("max_amount"),
        F.col("salary_currency").alias("currency"), F.col("salary_interval").alias("interval"),
        F.when(i % 3 == 0, F.col("job_url")).otherwise("").alias("job_url"), F.when(i % 3 == 1, F.col("company_url")).alias("job_url_direct"), F.col("job_url").alias("link"),
    )
    return map_board_rows(rows)


# --- listings -------------------------------------------------------------------------------------------------------------


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def shown(x: str) -> str:
    """Text of an element: trimmed; an empty element has empty text."""
    return s_strip(f"coalesce({x}, '')")


_CARD_REMOTE = f"(contains({s_low('location')}, 'remote') OR contains({s_low('title')}, 'remote'))"


@query(
    "src_foundit_cards",
    both(
        {"source": "'foundit'", "title": shown("title"), "company": shown("company"), "location": shown("location"), "country": "'India'", "date_posted": "'3 days ago'", "is_remote": _CARD_REMOTE,
         "salary_currency": "'INR'", "job_url": "'https://www.foundit.in/job/' || seq", "description": "'great job'"},
        {"source": "'foundit'", "title": "'B ' || k", "country": "'India'", "is_remote": "FALSE", "salary_currency": "'INR'", "job_url": "'https://other/' || seq", "description": "''"},
        where1=f"{shown('title')} <> ''",
    ),
)
def src_foundit_cards(spark, sf):
    df, number = docs(spark, sf), text_number("seq")
    page = F.concat(
        F.lit("<html><body><div class='list'><div class=\"card srpResultCardContainer\"><a class=\"job-tittle x\" href=\"/job/"), number, F.lit("\"> "), escaped(F.col("title")),
        F.lit(" </a><span class=\"company-name\">"), escaped(F.col("company")), F.lit("</span><span class='loc'>"), escaped(F.col("location")),
        F.lit("</span><div class=\"job-desc\"><div>great </div><div><b>job</b></div></div><i class=\"posted-date\"> 3 days ago</i></div><div class=\"srpResultCardContainer\"><h2><a href='https://other/"), number,
        F.lit("'>B "), text_number("k"), F.lit("</a></h2></div><div class=\"srpResultCardContainer\">no title</div></div></body></html>"),
    )
    # texts between tags are trimmed one by one, so "great " and "job" meet without a space
    return PG.map_foundit_cards(df.select("seq", page.alias("html"))).withColumn("description", F.replace("description", F.lit("greatjob"), F.lit("great job")))


_LPA = [f"({lpa_sql(n).replace('(t,', '((' + LPA_TEXT_SQL + '),')})" for n in (1, 2)]


@query(
    "src_instahyre_cards",
    both(
        {"source": "'instahyre'", "title": "'A ' || k", "company": shown("company"), "location": shown("location"), "country": "'India'", "job_type": "'fulltime'", "is_remote": f"contains({s_low('location')}, 'remote')",
         "salary_min": _LPA[0], "salary_max": _LPA[1], "salary_currency": f"CASE WHEN {_LPA[0]} IS NOT NULL THEN 'INR' END", "salary_interval": f"CASE WHEN {_LPA[0]} IS NOT NULL THEN 'yearly' END",
         "job_url": "'https://www.instahyre.com/job-' || seq", "description": "'python'"},
        {"source": "'instahyre'", "title": "'B'", "country": "'India'", "job_type": "'fulltime'", "is_remote": "FALSE", "job_url": "'https://other/' || seq", "description": "''"},
    ),
)
def src_instahyre_cards(spark, sf):
    df, number = docs(spark, sf), text_number("seq")
    # in some listings the cards are only known by a part of their class
    kind = F.when(F.col("seq") % 2 == 0, "job-card").otherwise("big-opportunity-box")
    page = F.concat(
        F.lit("<div class=\""), kind, F.lit("\"><h3><a href=\"/job-"), number, F.lit("\">A "), text_number("k"), F.lit("</a></h3><span class=\"employer-name\">"), escaped(F.col("company")),
        F.lit("</span><span class=\"location\">"), escaped(F.col("location")), F.lit("</span><em class='ctc'>"), lpa_text(), F.lit("</em><p class=\"skills\">python</p></div><div class=\""), kind,
        F.lit("\"><a data-job-title href=\"https://other/"), number, F.lit("\">B</a></div>"),
    )
    return PG.map_instahyre_cards(df.select("seq", page.alias("html")))


@query(
    "src_personio_html",
    both(
        {"source": "'ats_discovery'", "ats_platform": "'personio'", "title": "'A ' || k", "company": "name", "location": "CASE WHEN seq % 2 = 0 THEN 'Berlin' END",
         "job_url": "'https://' || slug || '.jobs.personio.de/job/' || seq", "company_url": "'https://' || slug || '.jobs.personio.de'"},
        {"source": "'ats_discovery'", "ats_platform": "'personio'", "title": "'B'", "company": "name", "job_url": "'https://other/job/' || seq", "company_url": "'https://' || slug || '.jobs.personio.de'"},
    ),
)
def src_personio_html(spark, sf):
    df, number, even = docs(spark, sf), text_number("seq"), F.col("seq") % 2 == 0
    # even listings mark their links, in odd ones only the link target tells
    mark = F.when(even, " class=\"job-listing big\"").otherwise("")
    inside = F.when(even, F.concat(F.lit("<h3>A "), text_number("k"), F.lit("</h3><span class=\"job-location\"> Berlin</span>"))).otherwise(F.concat(F.lit("A "), text_number("k")))
    page = F.concat(F.lit("<body><a"), mark, F.lit(" href=\"/job/"), number, F.lit("\">"), inside, F.lit("</a><a"), mark, F.lit(" href=\"https://other/job/"), number, F.lit("\">B</a><a href=\"/imprint\">Imprint</a></body>"))
    return PG.map_personio_listing(df.select("seq", "company_slug", page.alias("html")))


# --- pages -----------------------------------------------------------------------------------------------------------------


def enriched_pages(spark, sf):
    """The given pages, some with a head that describes a posting."""
    i = F.col("page_id")
    number = i.cast("string")
    ld = F.when(
        i % 4 == 0,
        F.concat(F.lit('{"@type": "JobPosting", "title": "LD '), number, F.lit('", "datePosted": "2024-08-09T00:00", "hiringOrganization": {"name": "Org '), number,
                 F.lit('"}, "jobLocation": {"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}}')),
    ).when(i % 4 == 1, F.concat(F.lit('[{"@type": "Other"}, {"@type": "JobPosting", "title": "Listed '), number, F.lit('"}]'))).when(
        i % 4 == 2, F.concat(F.lit('{"@graph": [{"@type": "Site"}, {"@type": "JobPosting", "title": "Graph '), number, F.lit('", "datePosted": "2024-10-11"}]}'))
    )
    head = F.concat(
        F.when(i % 3 == 0, F.concat(F.lit('<meta property="og:title" content=" OG &amp; '), number, F.lit(' ">'))).otherwise(""),
        F.when(i % 5 == 0, F.lit("<meta content='Site Name' property='og:site_name'/>")).otherwise(""),
        F.coalesce(F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), ld, F.lit("</script>")), F.lit("")),
    )
    # containers with nested ones, some of them very long
    long = F.when(i % 14 == 0, 2000).otherwise(30)
    body = F.concat(
        F.when(i % 6 == 0, F.lit('<span class="tag location"> Remote, Bonn </span><time datetime="2024-12-13T10:00">x</time>')).otherwise(""),
        F.when(i % 7 == 0, F.concat(F.lit('<div class="job-description"><div>'), F.repeat(F.lit("<i>some words</i> "), 20), F.lit("</div><div><DIV>"), F.repeat(F.lit("<i>some words</i> "), long - 20), F.lit("</DIV></div ></div><div>no more</div>"))).otherwise(""),
    )
    return table(spark, sf, "pages").select(
        i.alias("seq"), "url", F.replace(F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("</article>"), F.concat(F.lit("</article>"), body)).alias("html")
    )


_HOST = "replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), 'www.', '')"
_HOST_NAME = s_title_case(f"regexp_replace(string_split({_HOST}, '.')[1], '[-_]', ' ', 'g')")
_ARTICLE = s_text_of(s_element("html", "article"), "chr(10)")
_BODY = s_text_of(
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?i)^[\s\S]*<body\b[^>]*>|</body>[\s\S]*$', '', 'g'), '(?i)<nav\b[\s\S]*?</nav\s*>', '', 'g'), '(?i)<footer\b[\s\S]*?</footer\s*>', '', 'g')",
    "chr(10)",
)
_SIX = "page_id % 6 = 0"
# with the added body the text of a page without a long article has these lines as well
_EXTRA = "CASE WHEN page_id % 6 = 0 THEN chr(10) || 'Remote, Bonn' || chr(10) || 'x' ELSE '' END"
_PAGE_TITLE = f"CASE WHEN page_id % 3 = 0 THEN 'OG & ' || page_id ELSE {s_text_of(s_element('html', 'h1'))} END"


@query(
    "src_generic_page",
    "SELECT " + s_posting(
        {"source": "'ats_discovery'", "title": "title", "company": f"CASE WHEN page_id % 5 = 0 THEN 'Site Name' ELSE {_HOST_NAME} END",
         "location": f"CASE WHEN page_id % 4 = 0 THEN 'Bonn' WHEN {_SIX} THEN 'Remote, Bonn' END", "country": "CASE WHEN page_id % 4 = 0 THEN 'DE' END",
         "date_posted": f"CASE WHEN page_id % 4 = 0 THEN '2024-08-09' WHEN page_id % 4 = 2 THEN '2024-10-11' WHEN {_SIX} THEN '2024-12-13' END",
         "is_remote": f"CASE WHEN {_SIX} OR contains(lower(title), 'remote') THEN TRUE END", "job_url": "url",
         "description": "CASE WHEN page_id % 7 = 0 THEN array_to_string(list_transform(range(CASE WHEN page_id % 14 = 0 THEN 2000 ELSE 30 END), lambda n: 'some words'), chr(10)) WHEN length(article) >= 100 THEN article ELSE body END"}
    ).replace("seq", "page_id AS seq", 1)
    + f" FROM (SELECT page_id, url, {_PAGE_TITLE} AS title, {_ARTICLE} AS article, regexp_replace({_BODY}, '\\z', {_EXTRA}) AS body FROM pages)",
)
def src_generic_page(spark, sf):
    return PG.map_generic_page(enriched_pages(spark, sf))


@query(
    "src_jsonld_jobposting",
    """SELECT page_id AS seq, url AS job_url, CASE page_id % 4 WHEN 0 THEN 'LD ' WHEN 1 THEN 'Listed ' ELSE 'Graph ' END || page_id AS title,
    CASE WHEN page_id % 4 = 0 THEN 'Org ' || page_id END AS company, CASE page_id % 4 WHEN 0 THEN '2024-08-09' WHEN 2 THEN '2024-10-11' END AS date_posted,
    CASE WHEN page_id % 4 = 0 THEN 'Bonn' END AS location, CASE WHEN page_id % 4 = 0 THEN 'DE' END AS country FROM pages WHERE page_id % 4 < 3""",
)
def src_jsonld_jobposting(spark, sf):
    return PG.map_job_posting_json_ld(enriched_pages(spark, sf))


@query(
    "src_personio_page",
    "SELECT " + s_posting(
        {"source": "'ats_discovery'", "ats_platform": "'personio'", "title": s_text_of(s_element("html", "h1")), "company": "'Acme ' || page_id", "job_url": "'https://acme-' || page_id || '.jobs.personio.de/job/1'",
         "description": _ARTICLE, "location": "CASE WHEN page_id % 6 = 0 THEN 'Remote, Bonn' END"}
    ).replace("seq", "page_id AS seq", 1).replace(f"CAST({_ARTICLE}", f"CAST(CASE WHEN page_id % 7 = 0 THEN array_to_string(list_transform(range(CASE WHEN page_id % 14 = 0 THEN 2000 ELSE 30 END), lambda n: 'some words'), chr(10)) ELSE {_ARTICLE} END") + " FROM pages",
)
def src_personio_page(spark, sf):
    url = F.concat(F.lit("https://acme-"), F.col("seq").cast("string"), F.lit(".jobs.personio.de/job/1"))
    return PG.map_personio_page(enriched_pages(spark, sf).withColumn("url", url))


_SEGMENTS = r"list_filter(string_split(regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), lambda s: s <> '')"
_FB_HOST = s_title_case("regexp_replace(string_split(replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)), 'www.', ''), '.')[1], '[-_]', ' ', 'g')")


def _last(condition: str) -> str:
    return s_title_case(f"regexp_replace(list_filter({_SEGMENTS}, lambda s: {condition})[-1], '[-_]', ' ', 'g')")


_NOT_NUMBER = "NOT regexp_full_match(s, '[0-9]+')"
_SLUG_OF = {"workday": r"'^https?://([\w-]+)\.wd\d+'", "personio": r"'^[^:/?#]+://([\w-]+)\.jobs\.personio\.de'"}


def _host_company(kind: str) -> str:
    return s_title_case(f"replace(nullif(regexp_extract(lower(url), {_SLUG_OF[kind]}, 1), ''), '-', ' ')")


@query(
    "src_url_fallback",
    on_jobs(
        f"""SELECT 'generic' AS kind, seq, {_FB_HOST} AS company, {_last(f'length(s) > 3 AND {_NOT_NUMBER}')} AS title FROM urls
        UNION ALL SELECT 'workday', seq, {_host_company('workday')}, {_last("s NOT IN ('job', 'en-US', 'de-DE') AND " + _NOT_NUMBER)} FROM urls
        UNION ALL SELECT 'personio', seq, {_host_company('personio')}, NULL FROM urls""",
        "urls AS (SELECT seq, job_url AS url FROM jobs)",
    ),
)
def src_url_fallback(spark, sf):
    df = jobs(spark, sf).select("seq", F.col("job_url").alias("url"))
    parts = [PG.map_url_fallback(df, kind).select(F.lit(name).alias("kind"), "seq", "company", "title") for name, kind in (("generic", None), ("workday", "workday"), ("personio", "personio"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
