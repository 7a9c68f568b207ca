"""Column functions and row normalisation over derived postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia import fixed_values as V
from vacancia.functions import keys as K, language as L, normalise as N, platforms as PF
from vacancia.functions import salary as S, similarity as SIM, text as T
from vacancia.operators import normalize as NO, reports
from vacancia.operators.resolve import with_keys
from vacancia.schema import POSTING_FIELDS, conform_schema
from vacancia.operators.ordering import with_batches
from vacancia.functions.prompts import BLOCKS, profile_prompt

from .base import (
    JOBS, POSTING_TYPES, jobs, on_jobs, query, s_blank, s_collapse, s_date, s_first_match, s_job_type,
    s_level, s_low, s_norm_company, s_norm_title, s_norm_url, s_regex, s_strip, s_strip_html, s_title_case, sql_text, table,
)

# --- text ------------------------------------------------------------------------------------------


@query("fn_collapse_ws", on_jobs(f"SELECT seq, {s_collapse('title')} AS title, {s_collapse('location')} AS location FROM jobs"))
def fn_collapse_ws(spark, sf):
    return jobs(spark, sf).select("seq", T.collapse_spaces(F.col("title")).alias("title"), T.collapse_spaces(F.col("location")).alias("location"))


_LOC = s_collapse("location")


@query(
    "fn_smart_title_case",
    on_jobs(
        f"SELECT seq, CASE WHEN {_LOC} = lower({_LOC}) THEN {s_title_case(_LOC)} ELSE {_LOC} END AS location, "
        f"{s_title_case(s_strip('country'))} AS country FROM jobs"
    ),
)
def fn_smart_title_case(spark, sf):
    return jobs(spark, sf).select(
        "seq",
        T.title_case_if_lower(T.collapse_spaces(F.col("location"))).alias("location"),
        T.title_case(T.strip(F.col("country"))).alias("country"),
    )


@query("fn_parse_date", on_jobs(f"SELECT seq, {s_date('date_posted')} AS day FROM jobs"))
def fn_parse_date(spark, sf):
    return jobs(spark, sf).select("seq", N.parse_date(F.col("date_posted")).alias("day"))


@query("fn_job_type", on_jobs(f"SELECT seq, {s_job_type('job_type')} AS job_type FROM jobs"))
def fn_job_type(spark, sf):
    return jobs(spark, sf).select("seq", N.job_type(F.col("job_type")).alias("job_type"))


@query(
    "fn_job_type_loose",
    on_jobs(
        f"""SELECT seq, CASE WHEN coalesce(job_type, '') = '' THEN NULL WHEN contains(lower(job_type), 'full') THEN 'fulltime'
        WHEN contains(lower(job_type), 'part') THEN 'parttime'
        WHEN contains(lower(job_type), 'contract') OR contains(lower(job_type), 'freelance') THEN 'contract'
        WHEN contains(lower(job_type), 'intern') THEN 'internship' ELSE {s_strip('lower(job_type)')} END AS job_type FROM jobs"""
    ),
)
def fn_job_type_loose(spark, sf):
    return jobs(spark, sf).select("seq", N.job_type_loose(F.col("job_type")).alias("job_type"))


@query(
    "fn_remote_from_text",
    on_jobs("SELECT seq, CASE WHEN lower(coalesce(location, '') || chr(10) || coalesce(title, '')) LIKE '%remote%' THEN TRUE END AS is_remote FROM jobs"),
)
def fn_remote_from_text(spark, sf):
    return jobs(spark, sf).select("seq", N.remote_from_text(F.col("location"), F.col("title")).alias("is_remote"))


@query("fn_experience_level", on_jobs(f"SELECT seq, {s_level('title', 'description')} AS level FROM jobs"))
def fn_experience_level(spark, sf):
    return jobs(spark, sf).select("seq", N.experience_level(F.col("title"), F.col("description")).alias("level"))


# --- keys --------------------------------------------------------------------------------------------


@query("fn_normalize_url", f"SELECT 'page' AS kind, page_id AS id, {s_norm_url('url')} AS url FROM pages UNION ALL " + f"SELECT * FROM ({on_jobs('SELECT ' + chr(39) + 'job' + chr(39) + ' AS kind, seq AS id, ' + s_norm_url('job_url') + ' AS url FROM jobs')})")
def fn_normalize_url(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), K.normalize_url(F.col("url")).alias("url"))
    posted = jobs(spark, sf).select(F.lit("job").alias("kind"), F.col("seq").alias("id"), K.normalize_url(F.col("job_url")).alias("url"))
    return pages.unionByName(posted)


@query("fn_normalize_title", on_jobs(f"SELECT seq, {s_norm_title('title')} AS title FROM jobs"))
def fn_normalize_title(spark, sf):
    return jobs(spark, sf).select("seq", K.normalize_title(F.col("title")).alias("title"))


@query("fn_normalize_company", on_jobs(f"SELECT seq, {s_norm_company('company')} AS company FROM jobs"))
def fn_normalize_company(spark, sf):
    return jobs(spark, sf).select("seq", K.normalize_company(F.col("company")).alias("company"))


@query(
    "fn_title_company_key",
    on_jobs(
        "SELECT seq, CASE WHEN t <> '' AND c <> '' THEN t || '|||' || c END AS dup_key FROM "
        f"(SELECT seq, {s_norm_title('title')} AS t, {s_norm_company('company')} AS c FROM jobs)"
    ),
)
def fn_title_company_key(spark, sf):
    return with_keys(jobs(spark, sf)).select("seq", "dup_key")


SCORE_SQL = """(CASE WHEN coalesce(title, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(company, '') <> '' THEN 2 ELSE 0 END
  + CASE WHEN coalesce(location, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 3 ELSE 0 END
  + CASE WHEN length(description) > 500 THEN 2 ELSE 0 END + CASE WHEN length(description) > 2000 THEN 2 ELSE 0 END
  + CASE WHEN coalesce(date_posted, '') <> '' THEN 1 ELSE 0 END + CASE WHEN salary_min IS NOT NULL THEN 2 ELSE 0 END
  + CASE WHEN coalesce(job_type, '') <> '' THEN 1 ELSE 0 END + CASE WHEN is_remote IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN coalesce(country, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(company_url, '') <> '' THEN 1 ELSE 0 END)"""


@query("fn_completeness", on_jobs(f"SELECT seq, CAST({SCORE_SQL} AS INTEGER) AS score FROM jobs"))
def fn_completeness(spark, sf):
    return jobs(spark, sf).select("seq", K.completeness().alias("score"))


ATS_SQL = f"(coalesce(source IN ({', '.join(map(sql_text, V.ATS_SOURCES))}), FALSE) OR coalesce(ats_platform, '') <> '')"


@query("fn_is_ats", on_jobs(f"SELECT seq, {ATS_SQL} AS is_ats FROM jobs"))
def fn_is_ats(spark, sf):
    return jobs(spark, sf).select("seq", K.is_ats(F.col("source"), F.col("ats_platform")).alias("is_ats"))


def s_indel(a: str, b: str) -> str:
    """Insertions and deletions from ``a`` to ``b``, of at most 120 letters: a bit for each place of ``a`` not yet
    matched, folded over the places of each letter of ``b``."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    places = f"list_transform(range(1, length({a}) + 1), lambda j: CASE WHEN ({a})[j] = ch THEN 1::HUGEINT << (j - 1)::INTEGER ELSE 0::HUGEINT END)"
    hits = f"list_transform(string_split({b}, ''), lambda ch: list_sum({places})::HUGEINT)"
    rows = f"list_reduce(list_prepend({full}, {hits}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN length({a}) + length({b}) ELSE length({b}) - length({a}) + 2 * bit_count({rows}) END)"


def ratio_sql(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return f"round(CASE WHEN {total} = 0 THEN 100.0::DOUBLE ELSE (1.0::DOUBLE - {s_indel(a, b)} / {total}) * 100 END, 6)"


_NAMES_SQL = f"""names AS (SELECT seq, coalesce({s_norm_title('title')}, '') AS t, coalesce({s_norm_company('company')}, '') AS c, coalesce(lower(title), '') AS h FROM jobs)"""


def _sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), ' ')"


@query("fn_ratio", on_jobs(f"SELECT seq, {ratio_sql('t', 'c')} AS ratio FROM names", _NAMES_SQL))
def fn_ratio(spark, sf):
    keyed = with_keys(jobs(spark, sf))
    return keyed.select("seq", F.round(SIM.similarity(F.col("norm_title"), F.col("norm_company")), 6).alias("ratio"))


@query(
    "fn_token_sort_ratio",
    on_jobs(
        f"SELECT seq, {ratio_sql('t', 'h')} AS ratio FROM (SELECT seq, {_sorted_sql('t')} AS t, {_sorted_sql('h')} AS h FROM names)",
        _NAMES_SQL,
    ),
)
def fn_token_sort_ratio(spark, sf):
    keyed = with_keys(jobs(spark, sf))
    return keyed.select("seq", F.round(SIM.token_sort_similarity(F.col("norm_title"), F.lower("title")), 6).alias("ratio"))


# --- languages ---------------------------------------------------------------------------------------------


def _listing_sql(x: str) -> str:
    clean = s_collapse(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")
    tokens = rf"regexp_split_to_array(lower({clean}), '[^\p{{L}}]+')"
    counts = []
    for place, (code, words) in enumerate(V.STOP_WORDS.items()):
        listed = ", ".join(sql_text(w) for w in sorted(set(words.split())))
        counts.append(
            f"{{'n': len(list_filter({tokens}, lambda t: t IN ({listed}))), 'p': {-place}, 'name': '{V.LANGUAGE_NAMES[code]}'}}"
        )
    best = f"list_max([{', '.join(counts)}])"
    return f"CASE WHEN length({clean}) < 30 THEN 'unknown' WHEN {best}.n > 0 THEN {best}.name ELSE 'unknown' END"


LISTING_SQL = _listing_sql("description")


@query("fn_listing_language", on_jobs(f"SELECT seq, {LISTING_SQL} AS language FROM jobs"))
def fn_listing_language(spark, sf):
    return jobs(spark, sf).select("seq", L.listing_language(F.col("description")).alias("language"))


def required_sql(description: str, title: str, text_language: str) -> str:
    t, h = s_low(description), s_low(title)
    required = f"(NOT {s_regex(t, V.NO_GERMAN_NEEDED)} AND {s_regex(t, V.GERMAN_REQUIRED)})"
    optional, working = s_regex(t, V.GERMAN_OPTIONAL), s_regex(t, V.ENGLISH_WORKING)
    by_title = f"CASE WHEN {s_regex(h, V.GERMAN_TITLE)} THEN 'German' ELSE 'unknown' END"
    return f"""CASE WHEN {t} = '' THEN {by_title}
      WHEN {text_language} = 'German' THEN CASE WHEN {working} THEN 'English (German plus)' ELSE 'German' END
      WHEN {working} AND NOT {required} THEN 'English'
      WHEN {required} AND NOT {optional} THEN 'German'
      WHEN {required} OR {optional} THEN 'English (German plus)'
      WHEN {s_regex(t, V.FRENCH_REQUIRED)} THEN 'French' WHEN {s_regex(t, V.DUTCH_REQUIRED)} THEN 'Dutch'
      WHEN {s_regex(t, V.HINDI_REQUIRED)} THEN 'Hindi' WHEN {s_regex(t, V.ENGLISH_REQUIRED)} THEN 'English'
      WHEN {text_language} = 'English' THEN CASE WHEN {s_regex(h, V.GERMAN_REQUIRED)} THEN 'German'
        WHEN {s_regex(h, V.GERMAN_TITLE)} THEN 'English (German plus)' ELSE 'English' END
      WHEN {text_language} IN ('French', 'Spanish', 'Dutch', 'Hindi') THEN {text_language}
      ELSE {by_title} END"""


@query("fn_language_required", on_jobs(f"SELECT seq, {required_sql('description', 'title', 'listing_language')} AS language FROM jobs"))
def fn_language_required(spark, sf):
    # the written language is given here, so that the rules alone are checked
    asked = L.language_required(F.col("description"), F.col("title"), F.col("listing_language"))
    return jobs(spark, sf).select("seq", asked.alias("language"))


@query("fn_language_from_title", on_jobs(f"SELECT seq, CASE WHEN {s_regex(s_low('title'), V.GERMAN_TITLE)} THEN 'German' ELSE 'unknown' END AS language FROM jobs"))
def fn_language_from_title(spark, sf):
    return jobs(spark, sf).select("seq", L.language_from_title(F.col("title")).alias("language"))


# --- markup, salaries -----------------------------------------------------------------------------------------


@query("fn_strip_html", f"SELECT page_id, {s_strip_html('html')} AS text FROM pages")
def fn_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


# Salary texts are spelled from the amounts of a posting, in the notations that feeds use.
SALARY_STYLES = 7


def salary_text():
    low, high, style = F.col("salary_min").cast("bigint"), F.col("salary_max").cast("bigint"), F.col("seq") % SALARY_STYLES
    a, b = low.cast("string"), high.cast("string")
    k = (low / 1000).cast("bigint").cast("string")
    return (
        F.when(style == 0, F.concat(F.lit("$"), F.format_number(low, 0), F.lit(" - $"), F.format_number(high, 0)))
        .when(style == 1, F.concat(F.lit("€"), k, F.lit("k-"), (high / 1000).cast("bigint").cast("string"), F.lit("k")))
        .when(style == 2, F.concat(F.lit("£"), a))
        .when(style == 3, F.concat(k, F.lit("K")))
        .when(style == 4, F.lit("negotiable"))
        .when(style == 5, F.lit(""))
        .otherwise(F.concat(a, F.lit(".50 to "), b))
    )


_LOW, _HIGH = "CAST(salary_min AS BIGINT)", "CAST(salary_max AS BIGINT)"
SALARY_TEXT_SQL = f"""CASE seq % 7 WHEN 0 THEN '$' || format('{{:,}}', {_LOW}) || ' - $' || format('{{:,}}', {_HIGH})
  WHEN 1 THEN '€' || ({_LOW} // 1000) || 'k-' || ({_HIGH} // 1000) || 'k' WHEN 2 THEN '£' || {_LOW}
  WHEN 3 THEN ({_LOW} // 1000) || 'K' WHEN 4 THEN 'negotiable' WHEN 5 THEN '' ELSE {_LOW} || '.50 to ' || {_HIGH} END"""


def salary_sql(x: str) -> dict[str, str]:
    numbers = rf"regexp_extract_all(replace({x}, ',', ''), '\d+\.?\d*')"

    def scaled(n: str) -> str:
        return f"CASE WHEN contains(lower({x}), 'k') AND {n} < 1000 THEN {n} * 1000 ELSE {n} END"

    first, second = f"TRY_CAST({numbers}[1] AS DOUBLE)", f"TRY_CAST(coalesce({numbers}[2], {numbers}[1]) AS DOUBLE)"
    return {
        "low": scaled(first),
        "high": scaled(second),
        "currency": f"CASE WHEN {numbers}[1] IS NULL THEN NULL WHEN contains({x}, '$') THEN 'USD' WHEN contains({x}, '€') THEN 'EUR' WHEN contains({x}, '£') THEN 'GBP' END",
    }


_PAY = salary_sql("t")


@query(
    "fn_salary_text",
    on_jobs(f"SELECT seq, {_PAY['low']} AS low, {_PAY['high']} AS high, {_PAY['currency']} AS currency FROM (SELECT seq, {SALARY_TEXT_SQL} AS t FROM jobs)"),
)
def fn_salary_text(spark, sf):
    pay = S.parse_salary(salary_text())
    return jobs(spark, sf).select("seq", pay["min"].alias("low"), pay["max"].alias("high"), pay["currency"].alias("currency"))


def lpa_text():
    a, b, style = (F.col("seq") % 40 + 3).cast("string"), (F.col("seq") % 40 + 9).cast("string"), F.col("seq") % 6
    return (
        F.when(style == 0, F.concat(a, F.lit("-"), b, F.lit(" LPA")))
        .when(style == 1, F.concat(a, F.lit("L - "), b, F.lit("L")))
        .when(style == 2, F.concat(a, F.lit(".5 Cr")))
        .when(style == 3, F.concat(a, F.lit(" lakh")))
        .when(style == 4, F.lit(""))
        .otherwise(F.concat(a, F.lit("0000 per annum total")))
    )


LPA_TEXT_SQL = """CASE seq % 6 WHEN 0 THEN (seq % 40 + 3) || '-' || (seq % 40 + 9) || ' LPA'
  WHEN 1 THEN (seq % 40 + 3) || 'L - ' || (seq % 40 + 9) || 'L' WHEN 2 THEN (seq % 40 + 3) || '.5 Cr'
  WHEN 3 THEN (seq % 40 + 3) || ' lakh' WHEN 4 THEN '' ELSE (seq % 40 + 3) || '0000 per annum total' END"""
# the unit of each notation is known from how the text was spelled
_LPA_UNIT = "CASE WHEN seq % 6 IN (0, 1, 3) THEN 1e5 WHEN seq % 6 = 2 THEN 1e7 ELSE 1 END"
_LPA_NUMBERS = r"regexp_extract_all(t, '\d+(?:\.\d+)?')"


def lpa_sql(place: int) -> str:
    return f"TRY_CAST({_LPA_NUMBERS}[{place}] AS DOUBLE) * CAST({_LPA_UNIT} AS DOUBLE)"


@query("fn_salary_lpa", on_jobs(f"SELECT seq, {lpa_sql(1)} AS low, {lpa_sql(2)} AS high FROM (SELECT seq, {LPA_TEXT_SQL} AS t FROM jobs)"))
def fn_salary_lpa(spark, sf):
    pay = S.parse_salary_lpa(lpa_text())
    return jobs(spark, sf).select("seq", pay["min"].alias("low"), pay["max"].alias("high"))


FORMAT_SALARY_SQL = """CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0
  THEN {c} || ' ' || format('{{:,}}', CAST(salary_min AS BIGINT)) || ' - ' || format('{{:,}}', CAST(salary_max AS BIGINT))
  WHEN coalesce(salary_min, 0) <> 0 THEN {c} || ' ' || format('{{:,}}', CAST(salary_min AS BIGINT)) || '+'
  ELSE 'Not specified' END"""


@query("fn_format_salary", on_jobs(f"SELECT seq, {FORMAT_SALARY_SQL.format(c='coalesce(salary_currency, chr(45))')} AS salary FROM jobs").replace("chr(45)", "''"))
def fn_format_salary(spark, sf):
    return jobs(spark, sf).select("seq", S.format_salary(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("salary"))


# --- platforms -----------------------------------------------------------------------------------------------------

_REG = s_first_match("job_url", V.REGISTRY_URL_PATTERNS.items())
_ROUTE = s_first_match("job_url", V.ROUTER_URL_PATTERNS.items())
ROUTE_SQL = (f"coalesce({_ROUTE[0]}, 'generic')", _ROUTE[1])
REGISTRY_SQL = _REG


@query("fn_ats_from_url", on_jobs(f"SELECT seq, {_REG[0]} AS ats, {_REG[1]} AS slug FROM jobs"))
def fn_ats_from_url(spark, sf):
    ats, slug = PF.registry_platform(F.col("job_url"))
    return jobs(spark, sf).select("seq", ats.alias("ats"), slug.alias("slug"))


@query("fn_ats_classify", on_jobs(f"SELECT seq, {ROUTE_SQL[0]} AS platform, {ROUTE_SQL[1]} AS slug FROM jobs"))
def fn_ats_classify(spark, sf):
    platform, slug = PF.router_platform(F.col("job_url"))
    return jobs(spark, sf).select("seq", platform.alias("platform"), slug.alias("slug"))


def wide_sql(x: str) -> tuple[str, str]:
    return s_first_match(x, [(n, "(?i)" + p) for n, p in V.CRAWLER_PATTERNS])


# Pages with a link to a careers board, as company sites have them.
_WIDE_HTML = "replace(html, '</body>', '<a href=\"' || job_url || '\">' || chr(10) || '</a></body>')"
_WIDE = wide_sql("h")


@query(
    "fn_ats_detect_wide",
    f"{JOBS} SELECT page_id, {_WIDE[0]} AS ats, {_WIDE[1]} AS slug FROM (SELECT page_id, {_WIDE_HTML} AS h FROM pages JOIN jobs ON seq = page_id)",
)
def fn_ats_detect_wide(spark, sf):
    linked = table(spark, sf, "pages").join(jobs(spark, sf).select(F.col("seq").alias("page_id"), "job_url"), "page_id")
    html = F.replace(F.col("html"), F.lit("</body>"), F.concat(F.lit('<a href="'), F.col("job_url"), F.lit('">\n</a></body>')))
    ats, slug = PF.page_platform(F.col("html"))
    return linked.withColumn("html", html).select("page_id", ats.alias("ats"), slug.alias("slug"))


@query(
    "fn_workday_parts",
    on_jobs(
        r"""SELECT seq, regexp_extract(job_url, '^https://([\w-]+)\.wd\d+\.myworkdayjobs\.com', 1) AS company,
        regexp_extract(job_url, '\.wd(\d+)\.', 1) AS number, 'Careers' AS board,
        nullif(regexp_replace(regexp_extract(job_url, '(/job/[^?#]+)', 1), ';[^/]*$', ''), '') AS external_path
        FROM jobs WHERE regexp_matches(job_url, '^https://[\w-]+\.wd\d+\.myworkdayjobs\.com/')"""
    ),
)
def fn_workday_parts(spark, sf):
    parts = jobs(spark, sf).select("seq", PF.workday_parts(F.col("job_url")).alias("p")).filter("p IS NOT NULL")
    return parts.select("seq", "p.*")


@query("fn_company_from_slug", on_jobs(f"SELECT seq, {s_title_case("replace(slug, '-', ' ')")} AS company FROM (SELECT seq, w || '-labs-' || (i % 7) AS slug FROM base JOIN jobs ON i = seq)"))
def fn_company_from_slug(spark, sf):
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{4,})", 1))
    slug = F.concat(F.when(word == "", "acme").otherwise(word), F.lit("-labs-"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), T.slug_to_name(slug).alias("company"))


@query(
    "fn_category_for_term",
    on_jobs(
        "SELECT seq, CASE " + " ".join(f"WHEN contains({s_low('title')}, '{w}') THEN '{c}'" for w, c in V.FEED_CATEGORIES.items()) + " END AS category FROM jobs"
    ),
)
def fn_category_for_term(spark, sf):
    return jobs(spark, sf).select("seq", N.feed_category(F.col("title")).alias("category"))


@query(
    "fn_output_language",
    on_jobs(
        """SELECT seq, CASE WHEN l LIKE '%german%' THEN 'German' WHEN l LIKE '%french%' THEN 'French' WHEN l LIKE '%dutch%' THEN 'Dutch'
        WHEN l LIKE '%spanish%' THEN 'Spanish' ELSE 'English' END AS language
        FROM (SELECT seq, lower(coalesce(nullif(language_required, ''), language, '')) AS l FROM jobs)"""
    ),
)
def fn_output_language(spark, sf):
    return jobs(spark, sf).select("seq", N.output_language(F.col("language_required"), F.col("language")).alias("language"))


BAND_SQL = "CASE WHEN coalesce(ai_score, 0) >= 70 THEN 'high' WHEN coalesce(ai_score, 0) >= 40 THEN 'medium' ELSE 'low' END"


@query("fn_score_band", on_jobs(f"SELECT seq, {BAND_SQL} AS band FROM jobs"))
def fn_score_band(spark, sf):
    return jobs(spark, sf).select("seq", N.score_band(F.col("ai_score")).alias("band"))


# --- whole rows -----------------------------------------------------------------------------------------------------------


@query(
    "prj_conform_schema",
    on_jobs(
        "SELECT seq, " + ", ".join(
            f"CAST({'title' if c == 'title' else 'job_url' if c == 'job_url' else 'salary_min' if c == 'salary_min' else 'NULL'} AS {POSTING_TYPES.get(c, 'VARCHAR')}) AS {c}"
            for c in POSTING_FIELDS
        ) + " FROM jobs"
    ),
)
def prj_conform_schema(spark, sf):
    partial = jobs(spark, sf).select("salary_min", "job_url", F.lit(1).alias("unknown_field"), "title", "seq")
    return conform_schema(partial)


def loose(spark, sf):
    """Postings with loosely typed amounts, flags and scores."""
    i = F.col("seq")
    return jobs(spark, sf).withColumns(
        {
            "salary_min": F.when(i % 5 == 0, "not-a-number").otherwise(F.col("salary_min").cast("bigint").cast("string")),
            "salary_max": F.col("salary_max").cast("bigint"),
            "is_remote": F.when(F.col("is_remote"), "1").when(~F.col("is_remote"), "false").otherwise("maybe"),
            "ai_score": F.concat(F.col("ai_score").cast("string"), F.lit(".0")),
            "country": (i % 9).cast("int"),
        }
    )


@query(
    "prj_coerce_types",
    on_jobs(
        """SELECT seq, title, CASE WHEN seq % 5 = 0 THEN NULL ELSE salary_min END AS salary_min, salary_max,
        is_remote, ai_score, CAST(seq % 9 AS VARCHAR) AS country FROM jobs"""
    ),
)
def prj_coerce_types(spark, sf):
    return NO.coerce_types(loose(spark, sf)).select("seq", "title", "salary_min", "salary_max", "is_remote", "ai_score", "country")


REQUIRED_SQL = f"NOT {s_blank('title')} AND NOT {s_blank('job_url')}"
NORMAL = {
    "source": f"lower({s_strip('source')})",
    "ats_platform": f"lower({s_strip('ats_platform')})",
    "title": s_collapse("title"),
    "company": s_collapse("company"),
    "location": f"CASE WHEN {_LOC} = lower({_LOC}) THEN {s_title_case(_LOC)} ELSE {_LOC} END",
    "country": s_title_case(s_strip("country")),
    "date_posted": s_date("date_posted"),
    "job_type": s_job_type("job_type"),
    "experience_level": f"coalesce(nullif(experience_level, ''), {s_level(s_collapse('title'), 'description')})",
    "salary_currency": f"upper({s_strip('salary_currency')})",
    "salary_interval": f"lower({s_strip('salary_interval')})",
    "job_url": s_strip("job_url"),
    "company_url": s_strip("company_url"),
}
NORMAL_JOBS = "clean AS (SELECT seq, " + ", ".join(f"{NORMAL.get(c, c)} AS {c}" for c in POSTING_FIELDS) + f" FROM jobs WHERE {REQUIRED_SQL})"


@query("prj_normalize", on_jobs("SELECT * FROM clean", NORMAL_JOBS))
def prj_normalize(spark, sf):
    return NO.normalize_postings(jobs(spark, sf))


@query("prj_row_fallback", on_jobs("SELECT seq, title, date_posted, job_type, salary_min FROM loose",
       f"loose AS (SELECT seq, {NORMAL['title']} AS title, {NORMAL['date_posted']} AS date_posted, {NORMAL['job_type']} AS job_type, "
       f"CASE WHEN seq % 5 = 0 THEN NULL ELSE salary_min END AS salary_min FROM jobs WHERE {REQUIRED_SQL})"))
def prj_row_fallback(spark, sf):
    # rows whose amounts cannot be read are kept, as all others
    return NO.normalize_postings(loose(spark, sf)).select("seq", "title", "date_posted", "job_type", "salary_min")


@query(
    "prj_source_label",
    on_jobs(
        """SELECT seq, 'discovery' AS kind, 'ats_discovery' AS source, 'workday' AS ats_platform, coalesce(nullif(company, ''), 'Site ' || (seq % 3)) AS company FROM jobs
        UNION ALL SELECT seq, 'crawl', 'career_crawler', ats_platform, company FROM jobs"""
    ),
)
def prj_source_label(spark, sf):
    df = jobs(spark, sf).select("seq", "source", "ats_platform", "company")
    site = F.concat(F.lit("Site "), (F.col("seq") % 3).cast("string"))
    return NO.relabel_workday(df.withColumn("kind", F.lit("discovery")), site).unionByName(
        NO.relabel_source(df.withColumn("kind", F.lit("crawl")), "career_crawler")
    )


@query(
    "prj_display",
    on_jobs(
        """SELECT ai_score, coalesce(job_url, title) AS title, company, location, experience_level, is_remote, listing_language,
        language_required, ai_detected_language, date_posted, job_type, source FROM jobs"""
    ),
)
def prj_display(spark, sf):
    return reports.display_table(jobs(spark, sf), scored=True)


@query(
    "prj_top_matches",
    on_jobs(
        """SELECT ai_score AS "Score", title AS "Title", company AS "Company", location AS "Location", listing_language AS "Written In",
        language_required AS "Requires", ai_detected_language AS "AI Language", ai_reasoning AS "Reasoning" FROM jobs"""
    ),
)
def prj_top_matches(spark, sf):
    return reports.top_matches(jobs(spark, sf))


# --- prompts -------------------------------------------------------------------------------------------------------------------


def _none(c: str) -> str:
    return f"coalesce({c}, 'None')"


SCORE_BLOCK_SQL = f"""'[JOB ' || idx || ']' || chr(10) || 'Title: ' || {_none('title')} || chr(10) || 'Company: ' || {_none('company')}
  || chr(10) || 'Location: ' || {_none('location')} || chr(10) || 'Type: ' || {_none('job_type')}
  || chr(10) || 'Remote: ' || CASE WHEN is_remote THEN 'True' WHEN NOT is_remote THEN 'False' ELSE 'None' END
  || chr(10) || 'Listing written in: ' || {_none('listing_language')}
  || chr(10) || 'Language required: ' || {_none("coalesce(nullif(language_required, ''), language)")}
  || chr(10) || 'Experience: ' || {_none('experience_level')}
  || chr(10) || 'Salary: ' || {FORMAT_SALARY_SQL.format(c=_none('salary_currency'))}
  || chr(10) || 'Description:' || chr(10) || coalesce(description, '') || chr(10)"""
BATCHED = "batched AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 5 AS batch_id, CAST((row_number() OVER (ORDER BY seq) - 1) % 5 AS INTEGER) AS idx FROM {src})"


def _or(c: str, default: str) -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


SKILLS_BLOCK_SQL = f"'--- JOB ' || idx || ' ---' || chr(10) || 'Title: ' || {_or('title', 'Untitled')} || chr(10) || 'Description:' || chr(10) || coalesce(description, '') || chr(10)"
SALARY_BLOCK_SQL = (
    f"'--- JOB ' || idx || ' ---' || chr(10) || 'Title: ' || {_or('title', 'Untitled')} || chr(10) || 'Company: ' || {_or('company', 'Unknown')} || chr(10) || "
    f"'Location: ' || {_or('location', 'Unknown')} || ', ' || coalesce(country, '') || chr(10) || 'Description:' || chr(10) || coalesce(description, '') || chr(10)"
)
LANGUAGE_BLOCK_SQL = (
    f"'--- JOB ' || idx || ' ---' || chr(10) || 'Title: ' || {_or('title', 'Untitled')} || chr(10) || 'Company: ' || {_or('company', 'Unknown')} || chr(10) || "
    f"'Location: ' || {_or('location', 'Unknown')} || chr(10) || 'Description:' || chr(10) || coalesce(description, '') || chr(10)"
)


@query(
    "fn_prompt_text",
    on_jobs(
        f"""SELECT seq, 'score' AS kind, {SCORE_BLOCK_SQL} AS block FROM batched UNION ALL SELECT seq, 'skills', {SKILLS_BLOCK_SQL} FROM batched
        UNION ALL SELECT seq, 'salary', {SALARY_BLOCK_SQL} FROM batched UNION ALL SELECT seq, 'language', {LANGUAGE_BLOCK_SQL} FROM batched""",
        BATCHED.format(src="jobs"),
    ),
)
def fn_prompt_text(spark, sf):
    batched = with_batches(jobs(spark, sf))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), BLOCKS[k](F.col("idx")).alias("block")) for k in ("score", "skills", "salary", "language")])
    return batched.select("seq", F.explode(kinds).alias("x")).select("seq", "x.*")


PROFILE = "Ada Example, product owner, Berlin. English and German."


@query(
    "join_profile_cross",
    on_jobs(
        f"SELECT seq, 'CANDIDATE PROFILE:' || chr(10) || '{PROFILE}' || chr(10) || chr(10) || 'JOB LISTING:' || chr(10) || {SCORE_BLOCK_SQL} AS prompt FROM batched",
        BATCHED.format(src="jobs"),
    ),
)
def join_profile_cross(spark, sf):
    # one profile per run: a literal in the plan, so nothing is joined
    return with_batches(jobs(spark, sf)).select("seq", profile_prompt(PROFILE, F.col("idx")).alias("prompt"))
