"""The registry of queries and the posting rows they run on.

The given tables hold no postings, so postings are derived from ``documents``: text, length
and number of a document decide the fields of one posting. The derivation is written twice,
once for Spark and once in SQL; every document gives a posting.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacancia.session import spread_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2024, 7, 1)
TERMS = ["Product Owner", "Scrum Master"]


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    # only texts and pages cost more to work on than to read
    return spread_scan(scan) if name in ("documents", "pages") else scan


# --- derived postings ---------------------------------------------------------------------------

TITLES = [
    "Sr. Product Owner (m/w/d)", "Senior Product Owner", "  Product   Owner ", "Jr Developer",
    "Head of Operations", "VP Product", "Werkstudent IT", "Scrum Master (all genders)",
    "Business Analyst - m/w/d", "QA Eng.", "Director of Engineering", "Staff SWE",
    "Remote Data Engineer", "Teamleiter Vertrieb", "Graduate IT", "Principal Consultant", "CTO",
    "Senior Product Owner, Digital Products", "PM", "", None, "Sales Manager, German speaker",
    "Scrum Master", "Product Owner Senior", "Software Developer",
]
TITLE_TAILS = ["", "", "", " (m/f/d)"]
LEGAL_FORMS = [" GmbH", " Inc.", "", " AG", " Ltd", " Labs"]
LOCATIONS = [
    "berlin, germany", "Munich", "Remote", "Remote - USA", "Remote - EU", "Bangalore, IN", "London, UK",
    "", None, "X", "Wilmington, Delaware", "New York, NY", "  hamburg   germany", "Home Office", "Paris, France",
    "mumbai india", "toronto, canada only", "Work from anywhere", "stuttgart-mitte", "remote, worldwide",
]
COUNTRIES = ["germany", " INDIA ", "united kingdom", None, "", "USA", "south-korea"]
JOB_TYPES = [
    "Full-time", "full time", "fulltime", "Part-Time", "Freelance", "Intern", "Working Student",
    "Permanent position", "apprenticeship", None, "", "Temp", " Contractor ",
]
CURRENCIES = ["eur", "USD ", None, "inr"]
INTERVALS = ["Yearly", " monthly", None]
SOURCES = [
    "indeed", "LinkedIn ", "greenhouse", "arbeitnow", "remotive", "ats_discovery", "lever + indeed", None,
    "google_dork", "naukri",
]
PLATFORMS = [None, None, "greenhouse", None, "Lever", None, None]
ASKED = ["English", "German", "English (German plus)", "French", "unknown", None, ""]
AI_LANGUAGES = [None, "", "German", "English"]
PHRASES = [
    "", "No German required. Working language is English.", "Fluent German is required for this position.",
    "English is the working language. German is a plus.", "Deutschkenntnisse sind erforderlich.",
    "Deutschkenntnisse erforderlich.", "We need someone with fluent French. French is required.",
    "Requirements: German C1 level, experience in agile methodologies.",
    "English required. Deutschkenntnisse von Vorteil.",
    "Requires 5+ years of experience in open positions. Apply now.",
    "Dutch is mandatory. 12 years of experience.", "Hindi required, fluent in Hindi.",
    "English communication skills and 2 years experience",
    "Product owner and scrum master wanted, join our team.",
]
URL_SHAPES = [
    "https://boards.greenhouse.io/{w}/jobs/{k}", "https://Boards.Greenhouse.io/{w}/jobs/{k}",
    "https://jobs.lever.co/{w}/{k}", "https://{w}.jobs.personio.de/job/{k}", "https://jobs.ashbyhq.com/{w}/{k}",
    "https://jobs.smartrecruiters.com/{w}/{k}",
    "https://{w}.wd3.myworkdayjobs.com/en-US/Careers/job/Berlin/Product-Owner_{k}",
    "https://www.{w}.example.com/careers/senior-{w}/{k}", "https://careers-{w}.icims.com/jobs/{k}",
    "https://{w}.taleo.net/careersection/{k}", "https://www.linkedin.com/feed/{k}", "ftp://Files.{w}.example.com/{k}",
    "  ", "https://{w}.breezy.hr/p/{k}-{w}",
]
URL_TAILS = ["", "", "?ref=google#apply", "/", "#top", ";v=1"]
COMPANY_URLS = ["https://boards.greenhouse.io/{w}", None, "https://www.{w}.com/about", "", "https://{w}.recruitee.com", "https://jobs.lever.co/{w}"]
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: list, index: str) -> str:
    return f"(CAST([{', '.join(sql_text(v) for v in values)}] AS VARCHAR[]))[1 + {index}]"


def _url(shapes: list, index: Column) -> Column:
    return F.replace(F.replace(pick(shapes, index), F.lit("{w}"), F.col("w")), F.lit("{k}"), F.col("k").cast("string"))


def _sql_url(shapes: list, index: str) -> str:
    return f"replace(replace({sql_pick(shapes, index)}, '{{w}}', w), '{{k}}', CAST(k AS VARCHAR))"


DATE_STYLES = 14


def _dates() -> Column:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("i") * 7 % 400).cast("int"))
    style, out = F.col("i") % DATE_STYLES, None
    iso = F.date_format(day, "yyyy-MM-dd")
    notations = [
        iso, F.concat(iso, F.lit("T10:30:00")), F.concat(iso, F.lit(" 08:15:00")), F.date_format(day, "dd/MM/yyyy"),
        F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "MMMM dd, yyyy"), F.date_format(day, "MMM dd, yyyy"),
        F.date_format(day, "dd MMMM yyyy"), F.date_format(day, "dd MMM yyyy"),
        ((F.unix_date(day).cast("bigint")) * 86400 + 3600).cast("string"), F.lit("yesterday"), F.lit(None).cast("string"),
        F.lit(""), F.date_format(day, "MM/dd/yyyy"),
    ]
    for number, notation in enumerate(notations):
        out = F.when(style == number, notation) if out is None else out.when(style == number, notation)
    return out


_SQL_DAY = "(DATE '2024-01-01' + CAST(i * 7 % 400 AS INTEGER))"
_SQL_DATES = "CASE i % 14 " + " ".join(
    f"WHEN {n} THEN {e}"
    for n, e in enumerate(
        [
            f"strftime({_SQL_DAY}, '%Y-%m-%d')", f"strftime({_SQL_DAY}, '%Y-%m-%d') || 'T10:30:00'",
            f"strftime({_SQL_DAY}, '%Y-%m-%d') || ' 08:15:00'", f"strftime({_SQL_DAY}, '%d/%m/%Y')",
            f"strftime({_SQL_DAY}, '%d.%m.%Y')", f"strftime({_SQL_DAY}, '%B %d, %Y')", f"strftime({_SQL_DAY}, '%b %d, %Y')",
            f"strftime({_SQL_DAY}, '%d %B %Y')", f"strftime({_SQL_DAY}, '%d %b %Y')",
            f"CAST(date_diff('day', DATE '1970-01-01', {_SQL_DAY}) * 86400 + 3600 AS VARCHAR)", "'yesterday'", "NULL",
            "''", f"strftime({_SQL_DAY}, '%m/%d/%Y')",
        ]
    )
) + " END"


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One raw posting per document."""
    i, k, w = F.col("i"), F.col("k"), F.col("w")
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1))
    base = table(spark, folder, "documents").select(
        F.col("doc_id").alias("i"),
        F.col("n_chars").alias("k"),
        F.when(word == "", "acme").otherwise(word).alias("w"),
        "text",
        "lang",
    )
    phrase = pick(PHRASES, i % len(PHRASES))
    return base.select(
        i.alias("seq"),
        pick(SOURCES, (i + k) % len(SOURCES)).alias("source"),
        pick(PLATFORMS, i % len(PLATFORMS)).alias("ats_platform"),
        F.concat(pick(TITLES, k % len(TITLES)), pick(TITLE_TAILS, i % 4)).alias("title"),
        F.when(i % 29 == 0, None).when(i % 31 == 0, "").otherwise(F.concat(F.initcap(w), pick(LEGAL_FORMS, i % 6))).alias("company"),
        pick(LOCATIONS, (i * 3 + k) % len(LOCATIONS)).alias("location"),
        pick(COUNTRIES, (i + k) % len(COUNTRIES)).alias("country"),
        _dates().alias("date_posted"),
        pick(JOB_TYPES, k % len(JOB_TYPES)).alias("job_type"),
        F.when(i % 23 == 0, "mid").alias("experience_level"),
        F.when(i % 5 == 0, True).when(i % 5 == 1, False).alias("is_remote"),
        F.when(i % 4 == 1, 0.0).when(i % 4 > 1, (40000 + k % 500 * 100).cast("double")).alias("salary_min"),
        F.when(i % 3 == 1, (60000 + k % 700 * 100).cast("double")).alias("salary_max"),
        pick(CURRENCIES, i % 4).alias("salary_currency"),
        pick(INTERVALS, i % 3).alias("salary_interval"),
        F.concat(_url(URL_SHAPES, k % len(URL_SHAPES)), pick(URL_TAILS, i % 6)).alias("job_url"),
        _url(COMPANY_URLS, i % 6).alias("company_url"),
        F.when(i % 37 == 0, None).when(i % 41 == 0, "").when(i % 2 == 0, F.concat(phrase, F.lit(" "), F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(" "), phrase)).alias("description"),
        F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "French")
        .otherwise("unknown").alias("listing_language"),
        pick(ASKED, i % 7).alias("language_required"),
        pick(AI_LANGUAGES, i % 4).alias("ai_detected_language"),
        pick(ASKED, (i + 3) % 5).alias("language"),
        F.when(i % 3 != 0, (k % 101).cast("int")).alias("ai_score"),
        F.when(i % 3 != 0, F.concat(F.lit("reason "), k.cast("string"))).alias("ai_reasoning"),
        F.lit(None).cast("string").alias("ai_cover_letter"),
        F.lit(None).cast("string").alias("ai_resume_bullets"),
    )


JOBS = f"""WITH base AS (
  SELECT doc_id AS i, n_chars AS k,
         CASE WHEN regexp_extract(text, '([A-Za-z]{{4,}})', 1) = '' THEN 'acme'
              ELSE lower(regexp_extract(text, '([A-Za-z]{{4,}})', 1)) END AS w, text, lang
  FROM documents), jobs AS (
  SELECT i AS seq,
    {sql_pick(SOURCES, f'(i + k) % {len(SOURCES)}')} AS source,
    {sql_pick(PLATFORMS, f'i % {len(PLATFORMS)}')} AS ats_platform,
    {sql_pick(TITLES, f'k % {len(TITLES)}')} || {sql_pick(TITLE_TAILS, 'i % 4')} AS title,
    CASE WHEN i % 29 = 0 THEN NULL WHEN i % 31 = 0 THEN ''
         ELSE upper(left(w, 1)) || substr(w, 2) || {sql_pick(LEGAL_FORMS, 'i % 6')} END AS company,
    {sql_pick(LOCATIONS, f'(i * 3 + k) % {len(LOCATIONS)}')} AS location,
    {sql_pick(COUNTRIES, f'(i + k) % {len(COUNTRIES)}')} AS country,
    {_SQL_DATES} AS date_posted,
    {sql_pick(JOB_TYPES, f'k % {len(JOB_TYPES)}')} AS job_type,
    CASE WHEN i % 23 = 0 THEN 'mid' END AS experience_level,
    CASE i % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_remote,
    CASE WHEN i % 4 = 1 THEN 0.0::DOUBLE WHEN i % 4 > 1 THEN (40000 + k % 500 * 100)::DOUBLE END AS salary_min,
    CASE WHEN i % 3 = 1 THEN (60000 + k % 700 * 100)::DOUBLE END AS salary_max,
    {sql_pick(CURRENCIES, 'i % 4')} AS salary_currency,
    {sql_pick(INTERVALS, 'i % 3')} AS salary_interval,
    {_sql_url(URL_SHAPES, f'k % {len(URL_SHAPES)}')} || {sql_pick(URL_TAILS, 'i % 6')} AS job_url,
    {_sql_url(COMPANY_URLS, 'i % 6')} AS company_url,
    CASE WHEN i % 37 = 0 THEN NULL WHEN i % 41 = 0 THEN ''
         WHEN i % 2 = 0 THEN {sql_pick(PHRASES, f'i % {len(PHRASES)}')} || ' ' || text
         ELSE text || ' ' || {sql_pick(PHRASES, f'i % {len(PHRASES)}')} END AS description,
    CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'unknown' END AS listing_language,
    {sql_pick(ASKED, 'i % 7')} AS language_required,
    {sql_pick(AI_LANGUAGES, 'i % 4')} AS ai_detected_language,
    {sql_pick(ASKED, '(i + 3) % 5')} AS language,
    CASE WHEN i % 3 <> 0 THEN CAST(k % 101 AS INTEGER) END AS ai_score,
    CASE WHEN i % 3 <> 0 THEN 'reason ' || k END AS ai_reasoning,
    NULL::VARCHAR AS ai_cover_letter, NULL::VARCHAR AS ai_resume_bullets
  FROM base)"""


def on_jobs(select: str, more: str = "") -> str:
    """SQL over the derived postings; ``more`` adds common table expressions."""
    return f"{JOBS}{',' + more if more else ''} {select}"


# --- SQL counterparts -------------------------------------------------------------------------------


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def s_title_case(x: str) -> str:
    return (
        rf"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)'), "
        "lambda t: upper(t[1]) || lower(t[2:])), '') END"
    )


def s_blank(x: str) -> str:
    return f"(coalesce({s_strip(x)}, '') = '')"


def s_low(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def s_any(x: str, literals: list[str]) -> str:
    """Some literal is a substring."""
    return "(" + " OR ".join(f"contains({x}, {sql_text(v)})" for v in literals) + ")"


def s_regex(x: str, patterns: list[str]) -> str:
    both = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({x}, {sql_text(both)})"


def s_norm_url(x: str) -> str:
    u = s_strip(f"coalesce({x}, '')")
    shape = "^([^:/?#]+)://([^/?#]*)([^?#]*)"
    path = f"regexp_replace(regexp_replace(regexp_extract({u}, '{shape}', 3), ';[^/]*$', ''), '/+$', '')"
    return (
        f"CASE WHEN NOT starts_with({u}, 'http') THEN lower({u}) "
        f"ELSE lower(regexp_extract({u}, '{shape}', 1)) || '://' || lower(regexp_extract({u}, '{shape}', 2)) || {path} END"
    )


def s_norm_title(x: str) -> str:
    from vacancia import fixed_values as V

    out = f"lower({s_strip(f'coalesce({x}, chr(32))')})"
    for marker in V.TITLE_MARKERS:
        out = f"regexp_replace({out}, {sql_text(marker)}, '', 'g')"
    for short, full in V.TITLE_SPELLINGS.items():
        # no lookahead here: what follows is put back
        ahead = r"(?=\s|$)"
        pattern, back = (short.replace(ahead, r"(\s|$)"), r"\1") if ahead in short else (short, "")
        out = f"regexp_replace({out}, {sql_text(pattern)}, '{full}{back}', 'g')"
    return s_collapse(out)


def s_norm_company(x: str) -> str:
    from vacancia import fixed_values as V

    inner = s_strip(f"coalesce({x}, '')")
    return s_collapse(f"regexp_replace(lower({inner}), {sql_text(V.LEGAL_SUFFIX)}, '')")


def s_date(x: str) -> str:
    t = s_strip(x)
    formats = ["%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
    parsed = "coalesce(" + ", ".join(f"try_strptime({t}, '{f}')" for f in formats) + ")"
    return (
        f"CASE WHEN coalesce({t}, '') = '' THEN NULL "
        f"WHEN regexp_full_match({t}, '[0-9]{{10,}}') THEN strftime(DATE '1970-01-01' + CAST(CAST(left({t}, 10) AS BIGINT) // 86400 AS INTEGER), '%Y-%m-%d') "
        rf"WHEN regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN left({t}, 10) "
        # years have four digits, which the parser does not ask for
        f"WHEN regexp_matches({t}, '[0-9]{{4}}$') AND {parsed} IS NOT NULL THEN strftime({parsed}, '%Y-%m-%d') "
        rf"WHEN length({t}) >= 10 AND regexp_matches({t}, '^\d{{4}}') THEN left({t}, 10) ELSE {t} END"
    )


def s_job_type(x: str) -> str:
    from vacancia import fixed_values as V

    t = f"lower({s_strip(x)})"
    arms = [f"WHEN {t} IN ({', '.join(map(sql_text, V.JOB_TYPES))}) THEN {t}"]
    arms += [f"WHEN {t} = {sql_text(a)} THEN {sql_text(b)}" for a, b in V.JOB_TYPE_SYNONYMS.items()]
    arms += [f"WHEN contains({t}, {sql_text(a)}) THEN {sql_text(b)}" for a, b in V.JOB_TYPE_SYNONYMS.items()]
    return f"CASE {' '.join(arms)} ELSE {t} END"


def s_level(title: str, description: str) -> str:
    from vacancia import fixed_values as V

    arms = [f"WHEN regexp_matches({s_low(title)}, {sql_text(p)}) THEN {sql_text(n)}" for n, p in V.TITLE_LEVELS.items()]
    years = f"nullif(regexp_extract(lower(coalesce({description}, '')), {sql_text(V.YEARS_OF_EXPERIENCE)}, 1), '')"
    arms.append(f"WHEN {years} IS NULL THEN NULL")
    arms += [f"WHEN CAST({years} AS DOUBLE) <= {b} THEN '{n}'" for b, n in V.YEARS_LEVELS]
    return f"CASE {' '.join(arms)} ELSE 'lead' END"


def s_host(x: str) -> str:
    h = f"lower(regexp_extract({x}, '^https?://([^/?#]*)', 1))"
    return rf"CASE WHEN {h} <> '' THEN regexp_replace({h}, '^www\.', '') END"


def s_first_match(x: str, rules) -> tuple[str, str]:
    import re

    names, slugs = [], []
    for name, pattern in rules:
        names.append(f"WHEN regexp_matches({x}, {sql_text(pattern)}) THEN '{name}'")
        captured = f"regexp_extract({x}, {sql_text(pattern)}, 1)" if re.compile(pattern).groups else "NULL"
        slugs.append(f"WHEN regexp_matches({x}, {sql_text(pattern)}) THEN {captured}")
    return f"CASE {' '.join(names)} END", f"CASE {' '.join(slugs)} END"


def s_unescape(x: str) -> str:
    """The entities that occur in the given pages and in derived payloads."""
    for name, value in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("eacute", "é"), ("#8364", "€"), ("copy", "©"), ("middot", "·")]:
        x = f"replace({x}, '&{name};', '{value}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def s_strip_html(x: str) -> str:
    t = rf"regexp_replace({x}, '<br\s*/?>|<p>|</p>', chr(10), 'g')"
    t = f"replace({t}, '<li>', chr(10) || '• ')"
    t = s_unescape(f"regexp_replace({t}, '<[^>]+>', '', 'g')")
    return s_strip(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def s_text_of(x: str, separator: str = "''") -> str:
    pieces = rf"regexp_split_to_array(regexp_replace({x}, '(?i)<!--[\s\S]*?-->|<script\b[\s\S]*?</script\s*>|<style\b[\s\S]*?</style\s*>|<noscript\b[\s\S]*?</noscript\s*>', '', 'g'), '<[^>]*>')"
    texts = f"list_transform({pieces}, lambda t: {s_strip(s_unescape('t'))})"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(array_to_string(list_filter({texts}, lambda t: t <> ''), {separator}), '') END"


def s_element(x: str, tag: str) -> str:
    pattern = rf"(?i)<{tag}\b[^>]*>([\s\S]*?)</{tag}\s*>"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', 1) END"


POSTING_TYPES = {"is_remote": "BOOLEAN", "salary_min": "DOUBLE", "salary_max": "DOUBLE", "ai_score": "INTEGER"}


def s_posting(values: dict[str, str]) -> str:
    """Select list of ``seq`` and the 25 fields; missing ones are typed nulls."""
    from vacancia.schema import POSTING_FIELDS

    columns = ["seq"]
    for name in POSTING_FIELDS:
        columns.append(f"CAST({values.get(name, 'NULL')} AS {POSTING_TYPES.get(name, 'VARCHAR')}) AS {name}")
    return ", ".join(columns)
