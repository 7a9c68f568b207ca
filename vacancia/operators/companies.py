"""The company registry, URL routing and the discovery of careers pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.platforms import page_platform, registry_platform, router_platform
from ..functions.text import blank_to_null, slug_to_name
from .filters import career_signal_count, valid_job_urls
from .ordering import first_urls

KEY = ["ats", "slug"]


def _first_per_company(found: DataFrame, order: str, *values: str) -> DataFrame:
    """The values of the first sighting of each (ats, slug); combined map-side."""
    first = F.min_by(F.struct(*values), F.col(order)).alias("_first")
    return found.groupBy(*KEY).agg(first).select(*KEY, "_first.*")


def new_companies(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Companies that the registry lacks, by platform and slug."""
    return found.join(registry.select(*KEY), KEY, "left_anti")


def companies_in_postings(postings: DataFrame) -> DataFrame:
    """Companies whose boards the URLs of postings name; the first posting names them.

    The posting's own URL is looked at before the company URL.
    """
    seen = postings.select(
        "seq", "company", "source", F.posexplode(F.array("job_url", "company_url")).alias("_pos", "seen_url")
    )
    ats, slug = registry_platform(F.col("seen_url"))
    found = seen.withColumns({"ats": ats, "slug": slug}).filter(F.col("ats").isNotNull())
    found = found.select(
        *KEY,
        F.struct("seq", "_pos").alias("_order"),
        F.col("company").alias("company_name"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("discovered_from"),
        F.when(F.col("ats") == "workday", F.col("seen_url")).alias("url"),
    )
    return _first_per_company(found, "_order", "company_name", "discovered_from", "url")


def learn_companies(postings: DataFrame, registry: DataFrame, discovered_date: str) -> DataFrame:
    """Registry rows to add after a run."""
    return new_companies(companies_in_postings(postings), registry).withColumn(
        "discovered_date", F.lit(discovered_date)
    )


def companies_in_urls(urls: DataFrame, discovered_date: str) -> DataFrame:
    """Companies that discovered URLs name. The slug serves as name."""
    ats, slug = registry_platform(F.col("url"))
    found = valid_job_urls(urls).withColumns({"ats": ats, "slug": slug}).filter(F.col("ats").isNotNull())
    found = found.withColumn("url", F.when(F.col("ats") == "workday", F.col("url")))
    return _first_per_company(found, "seq", "url").withColumns(
        {
            "company_name": slug_to_name(F.col("slug")),
            "discovered_from": F.lit("serpapi"),
            "discovered_date": F.lit(discovered_date),
        }
    )


def slugs_to_query(curated: DataFrame, registry: DataFrame) -> DataFrame:
    """Curated and learnt companies, each once."""
    return curated.select(*KEY).unionByName(registry.select(*KEY)).distinct()


def workday_sites(curated: DataFrame, registry: DataFrame) -> DataFrame:
    """(company_name, url) of Workday sites; what was learnt overrides what was curated."""
    learnt = (
        registry.filter((F.col("ats") == "workday") & (F.length("url") > 0))
        .select(F.coalesce(F.col("company_name"), F.col("slug")).alias("company_name"), "slug", F.col("url").alias("learnt"))
        .groupBy("company_name")
        .agg(F.max_by("learnt", "slug").alias("learnt"))
    )
    return curated.join(learnt, "company_name", "full_outer").select(
        "company_name", F.coalesce("learnt", "url").alias("url")
    )


def classify_urls(urls: DataFrame) -> DataFrame:
    """URLs with the platform that decides how they are fetched, and the company slug."""
    platform, slug = router_platform(F.col("url"))
    return urls.withColumns({"platform": platform, "slug": slug})


def companies_to_fetch(classified: DataFrame) -> DataFrame:
    """One target per company of the platforms with company boards, at its first URL."""
    return (
        classified.filter(F.col("slug").isNotNull())
        .groupBy("platform", "slug")
        .agg(F.min("seq").alias("first_seq"))
    )


def route_urls(urls: DataFrame, generic_limit: int | None = None) -> DataFrame:
    """Targets to fetch: companies by slug, other platform pages by URL, generic pages.

    Equal slugs on two platforms are two companies. ``generic_limit`` keeps only so many generic
    pages, the first ones.
    """
    classified = classify_urls(valid_job_urls(urls))
    by_company = companies_to_fetch(classified).withColumnRenamed("slug", "target")
    single = (
        classified.filter(F.col("slug").isNull() & (F.col("platform") != "generic"))
        .groupBy("platform", F.col("url").alias("target"))
        .agg(F.min("seq").alias("first_seq"))
    )
    generic = classified.filter(F.col("platform") == "generic")
    if generic_limit is not None:
        generic = first_urls(generic, generic_limit)
    generic = generic.select("platform", F.col("url").alias("target"), F.col("seq").alias("first_seq"))
    return by_company.unionByName(single).unionByName(generic)


def _place(step: int) -> Column:
    """Order of a candidate: kind, position, and the URL where positions are shared."""
    return F.struct(F.lit(step).alias("step"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("url").alias("url")).alias("_order")


def discover_careers(sitemaps: DataFrame, probes: DataFrame, sitemaps_per_domain: int | None = None) -> DataFrame:
    """Careers page and platform per domain out of landed sitemap and page contents.

    ``sitemaps(domain, ordinal, url)`` holds the first careers URL found in each of a domain's
    sitemaps, ``probes(domain, ordinal, url, html)`` the pages found under the usual paths,
    ordered by path. Sitemaps come first; of the pages the first that names a platform, in its
    URL or its text, or that reads like a careers page. ``sitemaps_per_domain`` leaves out the
    sitemaps beyond the first so many.
    """
    if sitemaps_per_domain is not None:
        sitemaps = sitemaps.filter(F.col("ordinal") < sitemaps_per_domain)
    site_ats, site_slug = page_platform(F.col("url"))
    from_sitemaps = sitemaps.filter(F.col("url").isNotNull()).select("domain", _place(0), F.col("url").alias("career_url"), site_ats.alias("ats"), site_slug.alias("slug"))

    url_ats, url_slug = page_platform(F.col("url"))
    html_ats, html_slug = page_platform(F.col("html"))
    looked_at = probes.select(
        "domain",
        _place(1),
        F.col("url").alias("career_url"),
        F.coalesce(url_ats, html_ats).alias("ats"),
        F.when(url_ats.isNotNull(), url_slug).otherwise(html_slug).alias("slug"),
        (career_signal_count(F.col("html")) >= V.MIN_CAREER_SIGNALS).alias("_career_like"),
    )
    from_pages = looked_at.filter(F.col("ats").isNotNull() | F.col("_career_like")).drop("_career_like")
    candidates = from_sitemaps.unionByName(from_pages)
    best = F.min_by(F.struct("career_url", "ats", "slug"), F.col("_order")).alias("_best")
    return candidates.groupBy("domain").agg(best).select("domain", "_best.*")


def sitemap_career_url(sitemap: Column) -> Column:
    """First URL of a sitemap that speaks of careers, null if none does."""
    urls = F.regexp_extract_all(sitemap, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    hit = F.filter(urls, lambda url: F.lower(url).rlike("|".join(V.CAREER_URL_WORDS)))
    return F.get(hit, F.lit(0))


def robots_sitemaps(robots: Column, base_url: Column) -> Column:
    """Sitemaps that a robots.txt names, with the default one added if it is not among them."""
    lines = F.split(F.coalesce(robots, F.lit("")), r"\r\n|\n|\r")
    named = F.filter(lines, lambda line: line.rlike(r"^\s*(?i:sitemap):"))
    urls = F.transform(named, lambda line: F.trim(F.regexp_replace(line, r"^[^:]*:", "")))
    default = F.concat(base_url, F.lit("/sitemap.xml"))
    return F.when(F.array_contains(urls, default), urls).otherwise(F.array_append(urls, default))


def parse_company_list(lists: DataFrame) -> DataFrame:
    """(ats, slug) of landed company lists: JSON arrays of strings or objects.

    Objects give their slug, company_slug, id or name, lower-cased; strings are taken as they
    are. Slugs of one character are dropped.
    """
    item = F.explode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("item")
    names = [F.try_variant_get("item", f"$.{n}", "string") for n in ("slug", "company_slug", "id", "name")]
    of_object = F.trim(F.lower(F.coalesce(*[blank_to_null(n) for n in names])))
    is_text = F.schema_of_variant("item") == "STRING"
    is_object = F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))
    slug = F.when(is_text, F.try_variant_get("item", "$", "string")).when(is_object, of_object)
    return lists.select("ats", item).select("ats", slug.alias("slug")).filter(F.length("slug") >= 2)
