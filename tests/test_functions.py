"""Column functions on the cases that define them."""

import random

import pytest
from pyspark.sql import functions as F

from vacancia.functions import keys as K, language as L, normalise as N, platforms as PF
from vacancia.functions import salary as S, similarity as SIM, text as T


def check(spark, function, cases):
    """cases: {input or tuple of inputs: expected}."""
    data = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    width = len(data[0]) - 1
    schema = "i int, " + ", ".join(f"c{k} string" for k in range(width))
    df = spark.createDataFrame(data, schema)
    got = dict(df.select("i", function(*[F.col(f"c{k}") for k in range(width)]).alias("v")).collect())
    for i, (case, expected) in enumerate(cases.items()):
        assert got[i] == expected, f"{case!r}: {got[i]!r} != {expected!r}"


def test_normalize_url(spark):
    check(spark, K.normalize_url, {
        "": "",
        None: "",
        "https://example.com/job/123?ref=google#apply": "https://example.com/job/123",
        "https://example.com/job/123/": "https://example.com/job/123",
        "https://EXAMPLE.COM/Job/123": "https://example.com/Job/123",
        "ftp://example.com/file": "ftp://example.com/file",
        "HTTPS://Example.com/A": "https://example.com/a",
        " https://example.com/a;x=1?b ": "https://example.com/a",
        "https://example.com/a/;x": "https://example.com/a",
        "https://example.com": "https://example.com",
        "httpfoo/Bar?x": "httpfoo/Bar",
    })


def test_normalize_title(spark):
    check(spark, K.normalize_title, {
        "": "",
        "Sr. Product Owner": "senior product owner",
        "Jr Developer": "junior developer",
        "Product Owner (m/w/d)": "product owner",
        "Scrum Master (all genders)": "scrum master",
        "Product   Owner   (m/w/d)": "product owner",
        "PM": "product manager",
        "PO": "product owner",
        "Owner (m/w/d) Berlin": "ownerberlin",
        "Analyst - m/w/d": "analyst",
        "Dev/Ops Eng.": "dev/operations engineer",
    })


def test_normalize_company(spark):
    check(spark, K.normalize_company, {
        "SAP GmbH": "sap", "Google Inc.": "google", "Siemens AG": "siemens", "Acme Ltd": "acme",
        "Deutsche Telekom AG": "deutsche telekom", "Chase": "cha", "": "", None: "",
        "Foo S.A.": "foo",
    })


def test_completeness(spark):
    schema = (
        "title string, company string, location string, description string, date_posted string, "
        "salary_min double, job_type string, is_remote boolean, country string, company_url string"
    )
    df = spark.createDataFrame(
        [(None,) * 10, ("t", "c", "l", "x" * 3000, "d", 0.0, "j", False, "c", "u"),
         ("", "", "", "x" * 501, "", None, "", None, "", "")], schema)
    assert [r[0] for r in df.select(K.completeness()).collect()] == [0, 19, 5]


def test_parse_date(spark):
    check(spark, N.parse_date, {
        None: None, "": None, "  ": None,
        "2024-03-15": "2024-03-15", "2024-03-15T10:30:00": "2024-03-15", "2024-03-15T10:30:00Z": "2024-03-15",
        "15/03/2024": "2024-03-15", "03/15/2024": "2024-03-15", "15.03.2024": "2024-03-15",
        "March 15, 2024": "2024-03-15", "Mar 15, 2024": "2024-03-15", "15 March 2024": "2024-03-15",
        "15 Mar 2024": "2024-03-15", "03/04/2024": "2024-04-03", "1710460800": "2024-03-15",
        "1710460800123": "2024-03-15", "yesterday": "yesterday", "2024/03/15 noon": "2024/03/15",
        "2024-3-5T1:02:03": "2024-03-05", "31/02/2024": "31/02/2024",
    })


def test_job_type(spark):
    check(spark, N.job_type, {
        None: None, "fulltime": "fulltime", "full-time": "fulltime", "Full Time": "fulltime",
        "Part-Time": "parttime", "freelance": "contract", "Intern": "internship",
        "Working Student": "internship", "apprenticeship": "apprenticeship", "": "",
        "Software": "fulltime", "Permanent position": "fulltime",
    })


def test_job_type_loose(spark):
    check(spark, N.job_type_loose, {
        None: None, "": None, "full_time": "fulltime", "Part": "parttime", "Freelance": "contract",
        "internship": "internship", " Other ": "other",
    })


def test_experience_level(spark):
    check(spark, N.experience_level, {
        ("Senior Product Owner", ""): "senior", ("Junior Developer", None): "junior",
        ("Team Lead Engineering", ""): "lead", ("Internship Product Management", ""): "intern",
        ("Werkstudent IT", ""): "intern", ("Director of Engineering", ""): "director",
        ("VP Product", ""): "vp", ("Product Owner", "Requires 5+ years of experience"): "mid",
        ("Product Owner", ""): None, ("Praktikant", ""): None, (None, "1 year experience"): "entry",
        ("x", "12 years of experience"): "lead", ("x", " " * 1990 + "12 years of experience"): "lead",
        ("x", "99999999999999999999999 years experience"): "lead",
    })


def test_language_required(spark):
    def required(description, title):
        return L.language_required(description, title, L.listing_language(description))

    check(spark, required, {
        (None, "Product Owner (m/w/d)"): "German",
        ("", "Product Owner (m/w/d)"): "German",
        ("", ""): "unknown",
        ("We are looking for a Product Owner. No German required. Working language is English.", ""): "English",
        ("We need a Product Owner. Fluent German is required for this position.", ""): "German",
        ("We are a team. English is the working language. German is a plus.", ""): "English (German plus)",
        ("Wir suchen einen erfahrenen Product Owner für unser Team. Deutschkenntnisse sind erforderlich.", ""): "German",
        ("Join our international team. The working language is English. We offer a lot.", ""): "English",
        ("We need someone with fluent French for our Paris office. French is required.", ""): "French",
        ("English is our working language. German is beneficial but not required.", ""): "English (German plus)",
        ("Requirements: German C1 level, experience in agile methodologies.", ""): "German",
        ("We are hiring a developer. English required. Deutschkenntnisse von Vorteil.", ""): "English (German plus)",
        ("We are looking for someone to join us and build things with the team.", "Entwickler (m/w/d)"): "English (German plus)",
        ("We are looking for someone to join us and build things with the team.", "Sales, German speaker"): "German",
        ("working language\nof german origin", ""): "English",
    })


def test_language_from_title(spark):
    check(spark, L.language_from_title, {
        "Product Owner (m/w/d)": "German", "Werkstudent IT": "German", "Product Manager": "unknown",
        "": "unknown", None: "unknown",
    })


def test_listing_language(spark):
    check(spark, L.listing_language, {
        None: "unknown", "": "unknown", "too short for a language": "unknown",
        "<p>We are looking for a person with the skills to lead our team in Berlin.</p>": "English",
        "Wir suchen eine Person mit den richtigen Fähigkeiten, die das Team in Berlin leitet.": "German",
        "Nous recherchons une personne pour diriger notre équipe dans les bureaux de Paris.": "French",
        "Buscamos una persona con las habilidades para dirigir el equipo en los proyectos.": "Spanish",
        "Wij zoeken een persoon met de juiste vaardigheden om ons team te leiden in het land.": "Dutch",
        "हम अपनी टीम का नेतृत्व करने के लिए एक व्यक्ति की तलाश कर रहे हैं": "Hindi",
        "0123456789 0123456789 0123456789 0123456789": "unknown",
    })


def test_title_case(spark):
    check(spark, T.title_case, {
        None: None, "": "", "berlin-mitte": "Berlin-Mitte", "o'brien": "O'Brien", "NEW york": "New York",
        "3d artist": "3D Artist", "münchen": "München",
    })


def test_strip_html(spark):
    check(spark, T.strip_html, {
        None: None,
        "<p>a</p><br/>b<li>c</li>": "a\n\nb\n• c",
        "x &amp;amp; y &lt;b&gt; &#8364; &#x20AC; &eacute;&nbsp;&quot;&apos;": "x &amp; y <b> € € é\xa0\"'",
        "&#38;lt; &#38;amp; &unknown; &#0;": "&lt; &amp; &unknown; &#0;",
        "a\n\n\n\nb": "a\n\nb",
        "R&ampD &copy2024 &#65B &#150; &#36;5 &notit; AT&T": "R&D ©2024 AB – $5 ¬it; AT&T",
    })


def test_salary(spark):
    df = spark.createDataFrame(
        [("$80,000 - $120,000",), ("€60k-80k",), ("£500",), ("45k",), ("",), ("negotiable",)], "t string")
    got = [tuple(r[0]) for r in df.select(S.parse_salary(F.col("t"))).collect()]
    assert got == [
        (80000.0, 120000.0, "USD"), (60000.0, 80000.0, "EUR"), (500.0, 500.0, "GBP"),
        (45000.0, 45000.0, None), (None, None, None), (None, None, None)]


def test_salary_lpa(spark):
    df = spark.createDataFrame(
        [("15-25 LPA",), ("10L - 20L",), ("1.2 Cr",), ("500000",), ("",), ("8 lakh",), ("300 annual total",)], "t string")
    got = [tuple(r[0]) for r in df.select(S.parse_salary_lpa(F.col("t"))).collect()]
    assert got == [
        (1500000.0, 2500000.0), (1000000.0, 2000000.0), (12000000.0, None), (500000.0, None),
        (None, None), (800000.0, None), (300.0, None)]


def test_format_salary(spark):
    df = spark.createDataFrame([(50000.0, 70000.0, "EUR"), (50000.0, None, "EUR"), (0.0, 5.0, "EUR"), (None, None, None)], "a double, b double, c string")
    got = [r[0] for r in df.select(S.format_salary(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["EUR 50,000 - 70,000", "EUR 50,000+", "Not specified", "Not specified"]


def indel_ratio(a, b):
    """Plain table version of the similarity."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = previous + 1 if x == y else max(row[j + 1], row[j])
            previous = keep
    return (1 - (len(a) + len(b) - 2 * row[-1]) / (len(a) + len(b))) * 100


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity(spark, seed):
    import random

    rnd = random.Random(seed)
    pairs = [("", ""), ("a", ""), ("abc", "abc")]
    pairs += [("".join(rnd.choices("abcé ", k=rnd.randint(0, 90))), "".join(rnd.choices("abcé ", k=rnd.randint(0, 90)))) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = dict(df.select("i", SIM.similarity(F.col("a"), F.col("b"))).collect())
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(indel_ratio(a, b))


def test_token_sort_similarity(spark):
    df = spark.createDataFrame([("product owner senior", "senior product owner"),
                                ("senior product owner", "senior product owner, digital")], "a string, b string")
    got = [r[0] for r in df.select(SIM.token_sort_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and 81 < got[1] < 82


def test_platforms(spark):
    def both(f):
        return lambda c: F.concat_ws("|", *f(c))

    check(spark, both(PF.registry_platform), {
        "https://boards.greenhouse.io/acme-labs/jobs/1": "greenhouse|acme-labs",
        "https://jobs.lever.co/acme/1": "lever|acme",
        "https://acme.jobs.personio.de/job/1": "personio|acme",
        "https://acme.wd3.myworkdayjobs.com/en-US/Careers": "workday|acme",
        "https://example.com": "", None: "",
    })
    check(spark, both(PF.router_platform), {
        "https://acme.wd3.myworkdayjobs.com/en-US/Careers": "workday",
        "https://careers-acme.icims.com/jobs/1": "icims", "https://acme.taleo.net/x": "taleo",
        "https://jobs.ashbyhq.com/acme": "ashby|acme", "https://example.com": "generic",
    })
    check(spark, both(PF.page_platform), {
        "<a href='https://BOARDS.greenhouse.io/Acme/jobs'>": "greenhouse|Acme",
        "see grnh.se/abc": "greenhouse", "https://x.breezy.hr": "breezyhr|x", "nothing": "",
    })


def test_workday_parts(spark):
    check(spark, lambda c: F.concat_ws("|", *[PF.workday_parts(c)[n] for n in ("company", "number", "board", "external_path")]), {
        "https://acme.wd3.myworkdayjobs.com/en-US/Careers/job/Berlin/PO_1": "acme|3|Careers|/job/Berlin/PO_1",
        "acme.wd5.myworkdayjobs.com/External": "acme|5|External",
        "https://acme.wd5.myworkdayjobs.com/": "", "https://example.com/x": "",
    })


def test_url_fallbacks(spark):
    check(spark, PF.generic_title_from_url, {
        "https://acme.com/jobs/product-owner_berlin/12345": "Product Owner Berlin", "https://acme.com/a": None,
        "https://acme.com": None,
    })
    check(spark, PF.company_from_host, {"https://www.acme-labs.com/x": "Acme Labs", "https://m.acme.com": "M"})
    check(spark, PF.workday_title_from_url, {"https://a.wd1.myworkdayjobs.com/en-US/C/job/Senior-PO/99": "Senior Po"})


def test_selectors_are_answered_from_one_scan_of_tags(rows):
    from vacancia.sources import html as H

    page = (
        "<main><div class='x job-content'><div>a</div>b</div><P id=\"job\">never closed"
        "<x <span data-a='1' class=\"location\">Bonn</span><i itemprop='datePosted' content='2024-05-06'></i></main>"
    )
    df = rows("html string", (page,), ("",), (None,), ("no tags < here > at all",))
    selectors = [".job-content", "#job", ".location", "[itemprop='datePosted']", ".content", "main", "article"]
    found = [r[0] for r in df.select(H.elements(F.col("html"), selectors)).collect()]
    assert [(e.tag, e.inside) for e in found[0]] == [
        ("<div class='x job-content'>", "<div>a</div>b"),
        ('<P id="job">', None),
        ("<x <span data-a='1' class=\"location\">", None),
        ("<i itemprop='datePosted' content='2024-05-06'>", ""),
        ("<main>", page[len("<main>") : -len("</main>")]),
    ]
    assert found[1] == [] and not found[2] and found[3] == []
    first = [r[0] for r in df.select(H.first_inside(F.col("html"), ["#job", ".job-content"])).collect()]
    assert first == ["<div>a</div>b", None, None, None]


def test_white_space_of_any_kind(spark):
    """Trimming and collapsing are what the patterns say, at the ends and within."""
    rnd = random.Random(8)
    some = T.WHITE_SPACE + "\u200b\u180e\x1c\ufeffab ä\U0001f600"
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 12))) for _ in range(600)] + ["", " ", "\n", "a\n", "\u3000 x \n\n"]
    c = F.col("c")
    by_pattern = [F.regexp_replace(c, T.UNICODE + r"^\s+|\s+$", ""), F.trim(F.regexp_replace(c, T.UNICODE + r"\s+", " "))]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select(T.strip(c).alias("s"), T.collapse_spaces(c).alias("k"), *[x.alias(f"p{i}") for i, x in enumerate(by_pattern)])
    assert [r for r in df.collect() if (r.s, r.k) != (r.p0, r.p1)] == []


def test_white_space_does_not_make_a_text_long(spark):
    gap = " \n" * 400
    check(spark, L.listing_language, {
        gap + "the and of the" + gap + "the" + gap: "unknown",
        gap + "the and of the and for with the and" + gap: "English",
        "the and of the and of" + gap + "the and of": "English",
        "the and of" + gap + "the<br>" + gap: "unknown",
    })
