"""Mappers of web pages, listings and URLs. Page frames have ``seq``, ``url`` and ``html``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import platforms as PF
from ..functions.normalise import job_type_by_words, remote_from_text
from ..functions.salary import parse_salary_lpa
from ..functions.text import blank_to_null, first_filled, let, lowered, strip
from . import html as H
from .common import DISCOVERY, explode_items, join_filled, platform_values, to_postings
from .json_feeds import SCHEDULE_TYPES

# Where a page keeps what, in order of preference.
DESCRIPTION_SELECTORS = [
    ".job-description", ".job-details", ".job-content", ".position-description",
    ".careers-description", "#job-description", "#job-details", "[itemprop='description']",
    "article", ".content", "main",
]
LOCATION_SELECTORS = [".job-location", ".location", "[itemprop='jobLocation']", "[itemprop='addressLocality']"]
DATE_SELECTORS = ["[itemprop='datePosted']", ".date-posted", ".posting-date", "time"]


def _description(html: Column, chars: int | None) -> Column:
    """Text of the first container with more than 100 characters, else of the body."""
    body = H.text_of(F.regexp_replace(H.element(html, "body", may_stay_open=True), H.CHROME, ""), "\n")

    def choose(texts: Column) -> Column:
        long_enough = F.get(F.filter(texts, lambda t: F.length(t) > V.MIN_PAGE_DESCRIPTION), F.lit(0))
        last = F.try_element_at(texts, F.lit(-1))
        just_enough = F.when(F.length(last) == V.MIN_PAGE_DESCRIPTION, last)
        return F.coalesce(long_enough, just_enough, body, last)

    chosen = let(F.transform(H.insides(html, DESCRIPTION_SELECTORS), lambda c: H.text_of(c, "\n")), choose)
    return blank_to_null(chosen if chars is None else F.substring(chosen, 1, chars))


def _date(html: Column) -> Column:
    """Day of the first date element: its datetime, its content or its text."""
    def of_element(found: Column) -> Column:
        tag = found["tag"]
        written = first_filled(H.attribute(tag, "datetime", "content"), H.text_of(found["inside"]))
        return let(written, lambda t: F.when(F.length(t) >= 10, F.left(t, F.lit(10))))

    days = F.transform(H.elements(html, DATE_SELECTORS), of_element)
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def job_posting_json_ld(html: Column) -> Column:
    """First JSON-LD object of type JobPosting of a page, as a variant.

    Looked for in script order: the object itself, the elements of an array, those of a graph.
    """
    script = r"""(?i)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>([\s\S]*?)</script\s*>"""
    bodies = F.regexp_extract_all(html, F.lit(script), F.lit(1))

    def kind(v: Column) -> Column:
        return F.try_variant_get(v, "$['@type']", "string")

    def objects(body: Column) -> Column:
        parsed = F.try_parse_json(body)
        none = F.array().cast("array<variant>")
        listed = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), none)
        graph = F.coalesce(F.try_variant_get(parsed, "$['@graph']", "array<variant>"), none)
        return F.when(kind(parsed) == "JobPosting", F.array(parsed)).otherwise(F.concat(listed, graph))

    found = F.filter(F.flatten(F.transform(bodies, objects)), lambda v: kind(v) == "JobPosting")
    return F.when(F.contains(html, F.lit("ld+json")), F.get(found, F.lit(0)))


def map_job_posting_json_ld(pages: DataFrame) -> DataFrame:
    """Title, company, day and place of pages that carry a JSON-LD posting."""
    v = F.col("_ld")
    get = lambda path: F.try_variant_get(v, path, "string")
    return (
        pages.withColumn("_ld", job_posting_json_ld(F.col("html")))
        .filter(F.col("_ld").isNotNull())
        .select(
            "seq",
            F.col("url").alias("job_url"),
            get("$.title").alias("title"),
            get("$.hiringOrganization.name").alias("company"),
            F.left(get("$.datePosted"), F.lit(10)).alias("date_posted"),
            blank_to_null(get("$.jobLocation.address.addressLocality")).alias("location"),
            blank_to_null(get("$.jobLocation.address.addressCountry")).alias("country"),
        )
    )


def map_generic_page(pages: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Any page as a posting; a JSON-LD posting in it overrides day and place.

    ``description_chars`` cuts descriptions to so many characters.
    """
    html = F.col("html")
    # what is used more than once comes first, as columns of its own
    rows = pages.withColumns(
        {
            "_ld": job_posting_json_ld(html),
            "_shown": F.transform(
                F.array(H.first_inside(html, LOCATION_SELECTORS), H.first_inside(html, ["h1", "title"])),
                lambda found: H.text_of(found),
            ),
            "_og": H.meta_properties(html, ["og:title", "og:site_name"]),
            "_host": PF.company_from_host(F.col("url")),
        }
    )
    ld = lambda path: blank_to_null(F.try_variant_get(F.col("_ld"), path, "string"))
    place = F.get("_shown", F.lit(0))
    shown = F.coalesce(blank_to_null(F.get("_og", F.lit(0))), F.get("_shown", F.lit(1)))
    rows = rows.withColumns(
        {
            "_title": F.coalesce(blank_to_null(shown), ld("$.title")),
            "_company": first_filled(F.get("_og", F.lit(1)), F.col("_host"), ld("$.hiringOrganization.name")),
        }
    )
    return to_postings(
        rows,
        {
            "source": F.lit(DISCOVERY),
            "title": F.col("_title"),
            "company": F.col("_company"),
            "location": F.coalesce(ld("$.jobLocation.address.addressLocality"), place),
            "country": ld("$.jobLocation.address.addressCountry"),
            "date_posted": F.coalesce(F.left(ld("$.datePosted"), F.lit(10)), _date(html)),
            "is_remote": remote_from_text(place, F.col("_title")),
            "job_url": F.col("url"),
            "description": _description(html, description_chars),
        },
    )


def map_personio_page(pages: DataFrame) -> DataFrame:
    """A single posting page of a Personio site."""
    html = F.col("html")
    heading = H.first_inside(html, ["h1", ".position-title", "title"])
    return to_postings(
        pages,
        {
            "source": F.lit(DISCOVERY),
            "ats_platform": F.lit("personio"),
            "title": H.text_of(heading),
            "company": PF.personio_company_from_host(F.col("url")),
            "location": H.text_of(H.first_inside(html, [".job-location", ".position-location", ".location"])),
            "job_url": F.col("url"),
            "description": H.text_of(
                H.first_inside(html, [".job-description", ".position-description", ".description", "article"]), "\n"
            ),
        },
    )


def map_personio_listing(raw: DataFrame) -> DataFrame:
    """Postings of Personio listing pages; frames have ``seq``, ``company_slug`` and ``html``."""
    anchors = F.transform(
        F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*>[\s\S]*?</a\s*>"), F.lit(0)),
        lambda a: F.struct(F.regexp_extract(a, r"^<[^>]*>", 0).alias("tag"), a.alias("whole")),
    )
    marked = F.filter(
        anchors,
        lambda a: a["tag"].rlike(r"""(?i)class\s*=\s*["'](?:[^"']*\s)?job-listing(?:\s[^"']*)?["']|\sdata-position-id\b"""),
    )
    by_href = F.filter(anchors, lambda a: a["tag"].rlike(r"""(?i)href\s*=\s*["'][^"']*/job/\d+"""))
    rows = explode_items(raw, F.when(F.size(marked) > 0, marked).otherwise(by_href))
    site = F.concat(F.lit("https://"), F.col("company_slug"), F.lit(".jobs.personio.de"))
    whole = F.col("item.whole")
    href = F.coalesce(H.attribute(F.col("item.tag"), "href"), F.lit(""))
    title = H.text_of(F.coalesce(H.first_inside(whole, [".job-title", ".position-title", "h3", "h4"]), whole))
    url = F.when((F.length(href) > 0) & ~F.startswith(href, F.lit("http")), F.concat(site, F.lit("/"), F.ltrim(href, F.lit("/")))).otherwise(href)
    rows = rows.withColumns({"_title": title, "_url": url}).filter((F.length("_title") > 0) & (F.length("_url") > 0))
    return to_postings(
        rows,
        {
            **platform_values("personio"),
            "title": F.col("_title"),
            "location": H.text_of(H.first_inside(whole, [".job-location", ".position-location", ".location"])),
            "job_url": F.col("_url"),
            "company_url": site,
        },
    )


PERSONIO_XML = (
    "position array<struct<id string, name string, office string, jobDescription string, "
    "description string, recruitingCategory string, createdAt string, schedule string>>"
)


def map_personio_xml(raw: DataFrame) -> DataFrame:
    """Postings of Personio XML feeds; positions without an id have no URL and are dropped."""
    rows = explode_items(raw, F.from_xml("payload", PERSONIO_XML)["position"])
    site = F.concat(F.lit("https://"), F.col("company_slug"), F.lit(".jobs.personio.de"))
    of = lambda name: blank_to_null(strip(F.col(f"item.{name}")))
    return to_postings(
        rows.filter(of("id").isNotNull()),
        {
            **platform_values("personio"),
            "title": of("name"),
            "location": of("office"),
            "date_posted": F.left(of("createdAt"), F.lit(10)),
            "job_type": job_type_by_words(of("schedule"), SCHEDULE_TYPES),
            "job_url": F.concat(site, F.lit("/job/"), of("id")),
            "company_url": site,
            "description": join_filled([of("jobDescription"), of("description"), of("recruitingCategory")], "\n\n"),
        },
    )


def _cards(html: Column, classes: list[str], data_attribute: str, fallback: str) -> Column:
    """Pieces of a listing, each from the start of a card to the start of the next."""
    names = "|".join(classes)
    own = rf"""(?i)(?=<[a-z][^>]*(?:\sclass\s*=\s*["'](?:[^"']*\s)?(?:{names})(?:\s[^"']*)?["']|\s{data_attribute}\b))"""
    loose = rf"""(?i)(?=<div\b[^>]*\sclass\s*=\s*["'][^"']*(?:{fallback}))"""
    by_class, by_name = F.split(html, own), F.split(html, loose)
    rest = lambda pieces, pattern: F.filter(pieces, lambda p: p.rlike("^" + pattern))
    cards = rest(by_class, own.replace("(?=", "(?:", 1))
    return F.when(F.size(cards) > 0, cards).otherwise(rest(by_name, loose.replace("(?=", "(?:", 1)))


def _link(card: Column, classes: list[str], headings: list[str], marker: str) -> Column:
    """Struct(tag, whole) of the anchor that holds the title of a card."""
    inside = H.insides(card, [f".{c}" for c in classes] + headings)
    anchor = r"(?i)<a\b[^>]*>[\s\S]*?</a\s*>"
    anchors = F.filter(F.transform(inside, lambda part: F.regexp_extract(part, anchor, 0)), lambda a: F.length(a) > 0)
    marked = blank_to_null(F.regexp_extract(card, rf"(?i)<a\b[^>]*\s{marker}\b[^>]*>[\s\S]*?</a\s*>", 0))
    return F.coalesce(F.get(anchors, F.lit(0)), marked)


def _card_rows(raw: DataFrame, cards: Column, link: Column, site: str) -> DataFrame:
    rows = explode_items(raw, cards).withColumn("_link", link)
    tag = F.regexp_extract("_link", r"^<[^>]*>", 0)
    href = H.attribute(tag, "href")
    url = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(site), href))
    return rows.withColumns({"_title": blank_to_null(H.text_of(F.col("_link"))), "_url": url}).filter(
        F.col("_title").isNotNull() & F.col("_url").isNotNull()
    )


def _said_remote(location: Column, title: Column) -> Column:
    return F.contains(lowered(location), F.lit("remote")) | F.contains(lowered(title), F.lit("remote"))


def map_foundit_cards(raw: DataFrame) -> DataFrame:
    """Result cards of an Indian board; frames have ``seq`` and ``html``."""
    card = F.col("item")
    cards = _cards(F.col("html"), ["srpResultCardContainer", "card-apply-content"], "data-job-id", r"job[-_]?card|srp[-_]?result")
    link = F.coalesce(
        blank_to_null(F.regexp_extract(card, r"""(?i)<a\b[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?job-tittle(?:\s[^"']*)?["'][^>]*>[\s\S]*?</a\s*>""", 0)),
        _link(card, ["jobTitle"], ["h2"], "data-job-title"),
        _link(card, ["designation"], [], "data-job-title"),
    )
    rows = _card_rows(raw, cards, link, "https://www.foundit.in")
    location = H.text_of(H.first_inside(card, [".loc", ".location", ".job-location"]))
    return to_postings(
        rows,
        {
            "source": F.lit("foundit"),
            "title": F.col("_title"),
            "company": H.text_of(H.first_inside(card, [".company-name", ".companyName", ".comp-name"])),
            "location": location,
            "country": F.lit("India"),
            "date_posted": H.text_of(H.first_inside(card, [".posted-date", ".date", ".job-date"])),
            "is_remote": _said_remote(location, F.col("_title")),
            "salary_currency": F.lit("INR"),
            "job_url": F.col("_url"),
            "description": F.coalesce(H.text_of(H.first_inside(card, [".job-description", ".desc", ".job-desc"])), F.lit("")),
        },
    )


def map_instahyre_cards(raw: DataFrame) -> DataFrame:
    """Result cards of an Indian board with salaries in its own notation."""
    card = F.col("item")
    cards = _cards(F.col("html"), ["job-card", "opportunity-card"], "data-opportunity-id", r"job[-_]?card|opportunity")
    rows = _card_rows(raw, cards, _link(card, ["job-title", "opportunity-title"], ["h3"], "data-job-title"), "https://www.instahyre.com")
    location = H.text_of(H.first_inside(card, [".location", ".job-location", ".city"]))
    pay = parse_salary_lpa(H.text_of(H.first_inside(card, [".salary", ".compensation", ".ctc"])))
    rows = rows.withColumn("_pay", pay)
    paid = (F.coalesce(F.col("_pay.min"), F.lit(0.0)) != 0) | (F.coalesce(F.col("_pay.max"), F.lit(0.0)) != 0)
    return to_postings(
        rows,
        {
            "source": F.lit("instahyre"),
            "title": F.col("_title"),
            "company": H.text_of(H.first_inside(card, [".company-name", ".employer-name"])),
            "location": location,
            "country": F.lit("India"),
            "job_type": F.lit("fulltime"),
            "is_remote": _said_remote(location, F.col("_title")),
            "salary_min": F.col("_pay.min"),
            "salary_max": F.col("_pay.max"),
            "salary_currency": F.when(paid, F.lit("INR")),
            "salary_interval": F.when(paid, F.lit("yearly")),
            "job_url": F.col("_url"),
            "description": F.coalesce(H.text_of(H.first_inside(card, [".job-description", ".desc", ".skills"])), F.lit("")),
        },
    )


def map_url_fallback(urls: DataFrame, platform: str | None = None) -> DataFrame:
    """A minimal posting from a URL alone, for pages that could not be read."""
    url = F.col("url")
    if platform == "workday":
        company, title = PF.workday_company_from_host(url), PF.workday_title_from_url(url)
    elif platform == "personio":
        company, title = PF.personio_company_from_host(url), F.lit(None)
    else:
        company, title = PF.company_from_host(url), PF.generic_title_from_url(url)
    return to_postings(
        urls,
        {
            "source": F.lit(DISCOVERY),
            "ats_platform": F.lit(platform),
            "title": title,
            "company": company,
            "job_url": url,
        },
    )
