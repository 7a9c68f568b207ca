"""Mappers of JSON payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalise import epoch_seconds_to_day, job_type_by_words, job_type_loose, remote_from_text
from ..functions.platforms import workday_parts
from ..functions.salary import parse_salary
from ..functions.text import (
    blank_to_null,
    first_filled,
    lowered,
    string_array,
    strip_html,
    strip_html_if_markup,
)
from ..operators.filters import released_within
from .common import (
    explode_items,
    iso_day,
    join_filled,
    name_or_text,
    platform_values,
    to_postings,
)


def _field(name: str) -> Column:
    return F.col(f"item.{name}")


def _has(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


# --- boards of one company --------------------------------------------------------------------

GREENHOUSE = (
    "jobs array<struct<id string, title string, company struct<name string>, location variant, "
    "content string, updated_at string, first_published string>>"
)


def map_greenhouse(raw: DataFrame) -> DataFrame:
    rows = explode_items(raw, F.from_json("payload", GREENHOUSE)["jobs"])
    board = F.concat(F.lit("https://boards.greenhouse.io/"), F.col("company_slug"))
    location, title = name_or_text(_field("location")), _field("title")
    values = platform_values("greenhouse")
    return to_postings(
        rows,
        {
            **values,
            "title": title,
            "company": F.coalesce(_field("company.name"), values["company"]),
            "location": location,
            "job_url": F.when(_has(_field("id")), F.concat(board, F.lit("/jobs/"), _field("id"))),
            "description": strip_html(blank_to_null(_field("content"))),
            "date_posted": iso_day(_field("updated_at"), _field("first_published")),
            "is_remote": remote_from_text(location, title),
            "company_url": board,
        },
    )


LEVER = (
    "array<struct<id string, text string, "
    "categories struct<location string, department string, commitment string>, "
    "hostedUrl string, applyUrl string, descriptionPlain string, "
    "lists array<struct<text string, content string>>, additional string, createdAt double>>"
)
# Contract types by words, in the order of each feed.
LEVER_TYPES = [("full", "fulltime"), ("part", "parttime"), ("intern", "internship"), ("contract", "contract")]
ASHBY_TYPES = [("full", "fulltime"), ("part", "parttime"), ("contract", "contract"), ("intern", "internship")]
EMPLOYMENT_TYPES = [("full", "fulltime"), ("part", "parttime"), ("contract", "contract")]
SCHEDULE_TYPES = [("full", "fulltime"), ("part", "parttime")]


def map_lever(raw: DataFrame) -> DataFrame:
    rows = explode_items(raw, F.from_json("payload", LEVER))
    board = F.concat(F.lit("https://jobs.lever.co/"), F.col("company_slug"))
    location, title = _field("categories.location"), _field("text")

    def section(entry: Column) -> Column:
        return F.array(
            F.when(F.length(entry["text"]) > 0, F.concat(F.lit("\n"), entry["text"])),
            F.when(F.length(entry["content"]) > 0, strip_html(entry["content"])),
        )

    sections = F.flatten(F.transform(F.coalesce(_field("lists"), F.array().cast("array<struct<text:string,content:string>>")), section))
    parts = F.filter(
        F.concat(
            F.array(blank_to_null(_field("descriptionPlain"))),
            sections,
            F.array(strip_html(blank_to_null(_field("additional")))),
        ),
        lambda part: part.isNotNull(),
    )
    built = F.when(_has(_field("id")), F.concat(board, F.lit("/"), _field("id")))
    return to_postings(
        rows,
        {
            **platform_values("lever"),
            "title": title,
            "location": location,
            "job_type": job_type_by_words(_field("categories.commitment"), LEVER_TYPES),
            "job_url": F.coalesce(first_filled(_field("hostedUrl"), _field("applyUrl")), built),
            "description": F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")),
            "date_posted": F.when(_field("createdAt") != 0, epoch_seconds_to_day(_field("createdAt") / 1000)),
            "is_remote": remote_from_text(location, title),
            "company_url": board,
        },
    )


ASHBY = (
    "jobs array<struct<id string, title string, location variant, secondaryLocations array<variant>, "
    "jobUrl string, hostedUrl string, employmentType string, isRemote boolean, descriptionHtml string, "
    "description string, descriptionPlain string, publishedDate string, updatedAt string, "
    "createdAt string, compensation struct<range struct<min double, max double>, currency string, "
    "interval string, period string>>>"
)


def map_ashby(raw: DataFrame) -> DataFrame:
    rows = explode_items(raw, F.from_json("payload", ASHBY)["jobs"])
    board = F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("company_slug"))
    own = name_or_text(_field("location"))
    others = F.transform(_field("secondaryLocations"), lambda v: F.coalesce(name_or_text(v), F.lit("")))
    own_list = F.filter(F.array(own), lambda x: F.length(x) > 0)
    location = F.when(F.size(others) > 0, F.array_join(F.concat(own_list, others), ", ")).otherwise(own)
    text = first_filled(_field("descriptionHtml"), _field("description"), _field("descriptionPlain"))
    built = F.when(_has(_field("id")), F.concat(board, F.lit("/"), _field("id")))
    pay = "compensation"
    return to_postings(
        rows,
        {
            **platform_values("ashby"),
            "title": _field("title"),
            "location": location,
            "job_type": job_type_by_words(_field("employmentType"), ASHBY_TYPES),
            "is_remote": F.coalesce(
                _field("isRemote"), F.when(F.contains(lowered(location), F.lit("remote")), F.lit(True))
            ),
            "salary_min": _field(f"{pay}.range.min"),
            "salary_max": _field(f"{pay}.range.max"),
            "salary_currency": _field(f"{pay}.currency"),
            "salary_interval": F.lower(first_filled(_field(f"{pay}.interval"), _field(f"{pay}.period"))),
            "job_url": F.coalesce(first_filled(_field("jobUrl"), _field("hostedUrl")), built),
            "description": strip_html_if_markup(text),
            "date_posted": iso_day(_field("publishedDate"), _field("updatedAt"), _field("createdAt")),
            "company_url": board,
        },
    )


SMARTRECRUITERS = (
    "content array<struct<id string, uuid string, name string, title string, "
    "company struct<name string>, location variant, ref string, customCareerSiteUrl string, "
    "jobDescription string, qualifications string, additionalInformation string, "
    "releasedDate string, createdOn string, experienceLevel struct<id string>, "
    "typeOfEmployment struct<id string>, "
    "compensation struct<range struct<min double, max double>, currency string>>>"
)


def map_smartrecruiters(raw: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Postings released in the 90 days before ``as_of``."""
    rows = explode_items(raw, F.from_json("payload", SMARTRECRUITERS)["content"])
    rows = rows.withColumn("_released", first_filled(_field("releasedDate"), _field("createdOn")))
    rows = released_within(rows, "_released", as_of)
    board = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("company_slug"))
    place = _field("location")
    is_text = F.coalesce(F.schema_of_variant(place) == "STRING", F.lit(False))
    city, region, country = (F.try_variant_get(place, f"$.{n}", "string") for n in ("city", "region", "country"))
    location = F.when(is_text, F.try_variant_get(place, "$", "string")).otherwise(
        join_filled([city, region, country], ", ")
    )
    flagged = F.coalesce(F.try_variant_get(place, "$.remote", "boolean"), F.lit(False))
    ref = blank_to_null(_field("ref"))
    posting_id = first_filled(_field("id"), _field("uuid"))
    text = join_filled([_field("jobDescription"), _field("qualifications"), _field("additionalInformation")], "\n\n")
    is_intern = F.contains(lowered(_field("experienceLevel.id")), F.lit("intern"))
    values = platform_values("smartrecruiters")
    return to_postings(
        rows,
        {
            **values,
            "title": first_filled(_field("name"), _field("title")),
            "company": F.coalesce(blank_to_null(_field("company.name")), values["company"]),
            "location": location,
            "country": F.when(~is_text, F.coalesce(country, F.lit(""))),
            "is_remote": F.when(flagged | F.contains(lowered(location), F.lit("remote")), F.lit(True)),
            "job_type": F.coalesce(
                job_type_by_words(_field("typeOfEmployment.id"), EMPLOYMENT_TYPES),
                F.when(is_intern, F.lit("internship")),
            ),
            "salary_min": _field("compensation.range.min"),
            "salary_max": _field("compensation.range.max"),
            "salary_currency": _field("compensation.currency"),
            "job_url": F.coalesce(
                blank_to_null(_field("customCareerSiteUrl")),
                F.when(~F.contains(ref, F.lit("api.smartrecruiters.com")), ref),
                F.concat(board, F.lit("/"), posting_id),
                board,
            ),
            "description": strip_html_if_markup(text),
            "date_posted": F.left(F.col("_released"), F.lit(10)),
            "company_url": board,
        },
    )


WORKDAY_SEARCH = (
    "jobPostings array<struct<title string, locationsText string, bulletFields array<string>, "
    "postedOn string, externalPath string>>"
)


def _workday(raw: DataFrame) -> DataFrame:
    """Payload rows with the parts of their site URL; rows of other URLs are dropped."""
    sited = raw.withColumn("_site", workday_parts(F.col("site_url"))).filter(F.col("_site").isNotNull())
    base = F.concat(
        F.lit("https://"), F.col("_site.company"), F.lit(".wd"), F.col("_site.number"), F.lit(".myworkdayjobs.com")
    )
    return sited.withColumns({"_base": base, "company_slug": F.col("_site.company")})


def map_workday_search(raw: DataFrame) -> DataFrame:
    """Search results of Workday sites; payload frames name the site as ``site_url``."""
    rows = explode_items(_workday(raw), F.from_json("payload", WORKDAY_SEARCH)["jobPostings"])
    bullets = F.transform(_field("bulletFields"), lambda b: F.lower(F.coalesce(b, F.lit(""))))

    def says(bullet: Column, *parts: str) -> Column:
        hit = F.lit(True)
        for part in parts:
            hit = hit & F.contains(bullet, F.lit(part))
        return hit

    types = F.filter(
        F.transform(
            bullets,
            lambda b: F.when(says(b, "full", "time"), "fulltime").when(says(b, "part", "time"), "parttime"),
        ),
        lambda t: t.isNotNull(),
    )
    board = F.concat(F.col("_base"), F.lit("/"), F.col("_site.board"))
    path = blank_to_null(_field("externalPath"))
    return to_postings(
        rows,
        {
            **platform_values("workday"),
            "title": _field("title"),
            "location": F.coalesce(blank_to_null(_field("locationsText")), F.get(_field("bulletFields"), F.lit(0))),
            "date_posted": iso_day(_field("postedOn")),
            "job_type": F.try_element_at(types, F.lit(-1)),
            "is_remote": F.when(F.exists(bullets, lambda b: says(b, "remote")), F.lit(True)),
            "job_url": F.coalesce(F.concat(board, path), F.col("_base")),
            "company_url": board,
        },
    )


_WORKDAY_INFO = (
    "title string, jobPostingTitle string, company string, location string, locationsText string, "
    "jobDescription string, description string, postedDate string, postedOn string, "
    "startDate string, timeType string, jobSchedule string"
)


def map_workday_detail(raw: DataFrame) -> DataFrame:
    """Details of single Workday postings; ``site_url`` is the URL of the posting."""
    wrapped = F.from_json("payload", f"jobPostingInfo struct<{_WORKDAY_INFO}>")["jobPostingInfo"]
    rows = _workday(raw).withColumn("item", F.coalesce(wrapped, F.from_json("payload", _WORKDAY_INFO)))
    title = first_filled(_field("title"), _field("jobPostingTitle"))
    location = first_filled(_field("location"), _field("locationsText"))
    text = first_filled(_field("jobDescription"), _field("description"))
    values = platform_values("workday")
    return to_postings(
        rows,
        {
            **values,
            "title": title,
            "company": F.coalesce(blank_to_null(_field("company")), values["company"]),
            "location": location,
            "job_url": F.col("site_url"),
            "description": strip_html_if_markup(text),
            "date_posted": iso_day(_field("postedDate"), _field("postedOn"), _field("startDate")),
            "is_remote": remote_from_text(location, title),
            "job_type": job_type_by_words(first_filled(_field("timeType"), _field("jobSchedule")), SCHEDULE_TYPES),
            "company_url": F.concat(F.col("_base"), F.lit("/"), F.col("_site.board")),
        },
    )


# --- aggregating boards ------------------------------------------------------------------------

ARBEITNOW = (
    "data array<struct<title string, company_name string, location string, description string, "
    "tags array<string>, remote variant, created_at string, url string, slug string>>"
)
# Tags that name a contract type, in order.
TAG_TYPES = {
    "fulltime": ["full-time", "full time", "fulltime"],
    "parttime": ["part-time", "part time", "parttime"],
    "contract": ["contract", "freelance"],
    "internship": ["internship", "intern"],
}


def _text(name: str) -> Column:
    return F.coalesce(_field(name), F.lit(""))


def job_type_from_tags(tags: Column) -> Column:
    lower_tags = F.transform(tags, F.lower)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, names in TAG_TYPES.items():
        out = out.when(F.arrays_overlap(lower_tags, string_array(names)), F.lit(kind))
    return out


def map_arbeitnow(raw: DataFrame) -> DataFrame:
    rows = explode_items(raw, F.from_json("payload", ARBEITNOW)["data"])
    created = F.trim(_field("created_at"))
    # an epoch may come as a number, even with a fraction, or as text of ten digits or more
    day = (
        F.when(created.rlike(r"^[0-9]{10,}$"), epoch_seconds_to_day(F.left(created, F.lit(10)).try_cast("bigint")))
        .when(created.rlike(r"^[0-9.eE+]+$") & created.try_cast("double").isNotNull(), epoch_seconds_to_day(created.try_cast("double")))
        .otherwise(F.left(_field("created_at"), F.lit(10)))
    )
    link = F.coalesce(blank_to_null(_field("url")), _text("slug"))
    url = F.when(F.length(link) == 0, link).when(F.startswith(link, F.lit("http")), link).otherwise(
        F.concat(F.lit("https://www.arbeitnow.com/view/"), link)
    )
    flag = F.lower(F.try_variant_get(_field("remote"), "$", "string")).isin("true", "yes", "1")
    return to_postings(
        rows.withColumn("_url", url).filter(F.length("_url") > 0),
        {
            "source": F.lit("arbeitnow"),
            "title": _text("title"),
            "company": _text("company_name"),
            "location": _text("location"),
            "date_posted": day,
            "job_type": job_type_from_tags(_field("tags")),
            "is_remote": F.coalesce(flag, F.lit(False)),
            "job_url": F.col("_url"),
            "description": _text("description"),
        },
    )


REMOTIVE = (
    "jobs array<struct<title string, company_name string, candidate_required_location string, "
    "description string, category string, job_type string, publication_date string, url string, "
    "salary string, company_logo_url string>>"
)


def map_remotive(raw: DataFrame) -> DataFrame:
    rows = explode_items(raw, F.from_json("payload", REMOTIVE)["jobs"])
    rows = rows.withColumn("_pay", parse_salary(blank_to_null(_field("salary"))))
    return to_postings(
        rows.filter(_has(_field("url"))),
        {
            "source": F.lit("remotive"),
            "title": _text("title"),
            "company": _text("company_name"),
            "location": F.coalesce(blank_to_null(_field("candidate_required_location")), F.lit("Remote")),
            "date_posted": iso_day(_field("publication_date")),
            "job_type": job_type_loose(_field("job_type")),
            "is_remote": F.lit(True),
            "salary_min": F.col("_pay.min"),
            "salary_max": F.col("_pay.max"),
            "salary_currency": F.col("_pay.currency"),
            "salary_interval": F.when(F.col("_pay.min") != 0, F.lit("yearly")),
            "job_url": _field("url"),
            "company_url": _field("company_logo_url"),
            "description": _text("description"),
        },
    )
