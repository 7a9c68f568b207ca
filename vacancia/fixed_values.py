"""The lists, patterns and constants that decide results.

Everything here is data that must be exactly so for results to be right. Order matters
wherever the first match wins.
"""

# --- fixed values: job types -------------------------------------------------------
JOB_TYPES = ["fulltime", "parttime", "contract", "internship"]

JOB_TYPE_SYNONYMS = {
    "full-time": "fulltime",
    "full time": "fulltime",
    "ft": "fulltime",
    "permanent": "fulltime",
    "part-time": "parttime",
    "part time": "parttime",
    "pt": "parttime",
    "freelance": "contract",
    "contractor": "contract",
    "temporary": "contract",
    "temp": "contract",
    "intern": "internship",
    "internships": "internship",
    "working student": "internship",
    "werkstudent": "internship",
}

# --- fixed values: experience level by title, first match wins ------------------------
TITLE_LEVELS = {
    "c-level": r"\b(c-level|cto|cfo|ceo|coo|cio|cpo)\b",
    "vp": r"\b(vp|vice\s+president)\b",
    "director": r"\b(director|direktor)\b",
    "principal": r"\b(principal|distinguished|fellow)\b",
    "staff": r"\b(staff)\b",
    "lead": r"\b(lead|head\s+of|team\s+lead|leiter)\b",
    "senior": r"\b(senior|sr\.?|experienced)\b",
    "junior": r"\b(junior|jr\.?)\b",
    "entry": r"\b(entry[\s-]level|graduate|absolvent|berufseinsteiger|berufseinstieg)\b",
    "intern": r"\b(intern|internship|praktik|werkstudent|working\s+student|trainee|auszubildende)\b",
}
YEARS_OF_EXPERIENCE = r"\b(\d+)\+?\s+years?\s+(of\s+)?experience"
# upper bound of years -> level; more years than the last bound is "lead"
YEARS_LEVELS = [(1, "entry"), (3, "junior"), (6, "mid"), (10, "senior")]

# --- fixed values: dates, tried in order; the shape of a text tells which formats can fit --
DATE_SHAPES = {
    r"^\d{4}-\d{1,2}-\d{1,2}T.*Z$": ["yyyy-M-d'T'H:m:s'Z'"],
    r"^\d{4}-\d{1,2}-\d{1,2}T": ["yyyy-M-d'T'H:m:s"],
    r"^\d{4}-\d{1,2}-\d{1,2} ": ["yyyy-M-d H:m:s"],
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["d/M/yyyy", "M/d/yyyy"],
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": ["d.M.yyyy"],
    r"^[A-Za-z]+ \d{1,2}, \d{4}$": ["MMMM d, yyyy", "MMM d, yyyy"],
    r"^\d{1,2} [A-Za-z]+ \d{4}$": ["d MMMM yyyy", "d MMM yyyy"],
}
HOURS_IN_YEAR = 8760
MAX_RELEASE_AGE_DAYS = 90

# --- fixed values: title and company keys --------------------------------------------
# what is taken out of titles
TITLE_MARKERS = [
    r"\s*\(m/[wf]/[dx]\)\s*",
    r"\s*\([wf]/m/[dx]\)\s*",
    r"\s*\(m/f/[dx]\)\s*",
    r"\s*\([fm]/[fm]/[dx]\)\s*",
    r"\s*\(all\s+genders?\)\s*",
    r"\s*\(d/f/m\)\s*",
    r"\s*-\s*(m/w/d|f/m/d|w/m/d)\s*$",
]

# what is spelled out in titles, in this order
TITLE_SPELLINGS = {
    r"\bsr\.?(?=\s|$)": "senior",
    r"\bjr\.?(?=\s|$)": "junior",
    r"\bmgr\.?(?=\s|$)": "manager",
    r"\beng\.?(?=\s|$)": "engineer",
    r"\bdev\.?(?=\s|$)": "developer",
    r"\bdir\.?(?=\s|$)": "director",
    r"\bvp\b": "vice president",
    r"\bassoc\.?(?=\s|$)": "associate",
    r"\basst\.?(?=\s|$)": "assistant",
    r"\badmin\.?(?=\s|$)": "administrator",
    r"\bcoord\.?(?=\s|$)": "coordinator",
    r"\bspec\.?(?=\s|$)": "specialist",
    r"\bexec\.?(?=\s|$)": "executive",
    r"\bops\.?(?=\s|$)": "operations",
    r"\btech\.?(?=\s|$)": "technical",
    r"\bswe\b": "software engineer",
    r"\bpm\b": "product manager",
    r"\bpo\b": "product owner",
    r"\bba\b": "business analyst",
    r"\bqa\b": "quality assurance",
    r"\bux\b": "user experience",
    r"\bui\b": "user interface",
}

LEGAL_SUFFIX = (
    r"\s*(gmbh|inc\.?|ltd\.?|llc|ag|se|co\.?|corp\.?|plc|s\.?a\.?|"
    r"b\.?v\.?|n\.?v\.?|e\.?v\.?|kg|ohg|ug|sarl|srl|spa|pty)\s*\.?\s*$"
)
KEY_SEPARATOR = "|||"
SOURCE_SEPARATOR = " + "
COMPANY_SIMILARITY = 90  # per cent
TITLE_SIMILARITY = 85  # per cent

ATS_SOURCES = [
    "ats_discovery", "google_dork", "greenhouse", "lever",
    "workday", "ashby", "personio", "smartrecruiters",
]

# --- fixed values: required-language rules ---------------------------------------------
NO_GERMAN_NEEDED = [r"no\s+german\s+(required|needed|necessary|skills|language)"]

GERMAN_REQUIRED = [
    r"german\s+(is\s+)?(required|mandatory|essential|necessary|must|needed)",
    r"(fluent|native|proficient|excellent|strong|advanced)\s+(in\s+)?german",
    r"(must|need\s+to|should)\s+(speak|know|have)\s+german",
    r"german\s+(c1|c2|b2|native|fluency|fluent)",
    r"(c1|c2)\s+(level\s+)?(in\s+)?german",
    r"working\s+language.*german",
    r"german[\s-]speaking\s+(required|essential|mandatory|only)",
    r"requires?\s+german",
    r"(flie[ßs]ende?|sehr\s+gute|verhandlungssichere?)\s+deutsch",
    r"deutsch(kenntnisse)?\s+(erforderlich|vorausgesetzt|zwingend|notwendig|m[üu]ssen)",
    r"muttersprach(e|lich)\s+deutsch",
    r"deutsch\s+(c1|c2|b2|muttersprachlich)",
    r"(arbeitssprache|unternehmenssprache).*deutsch",
    r"sichere\s+deutschkenntnisse",
    r"deutsch\s+in\s+wort\s+und\s+schrift",
    r"german[\s-]speaker",
    r"native[\s-]level\s+german",
    r"business[\s-]level\s+german",
    r"professional[\s-]level\s+german",
    r"german\s+native\s+speaker",
    r"mother[\s-]tongue.*german",
    r"german.*mother[\s-]tongue",
    r"native[\s-]german",
    r"confident\s+(business\s+)?german",
    r"conversational\s+german",
    r"(good|solid|strong)\s+command\s+of\s+german",
    r"german\s+(skills?\s+)?(required|needed|essential|mandatory)",
    r"(speak|speaking)\s+german",
    r"german\s+(b1|b2|c1|c2)[\s-]level",
    r"(b1|b2|c1|c2)[\s-]level\s+(in\s+)?german",
    r"german\s+language\s+(required|needed|skills|proficiency)",
    r"deutsch\s+als\s+arbeitssprache",
    r"gute\s+deutschkenntnisse",
    r"deutschkenntnisse\s+(auf\s+)?(c1|c2|b2|muttersprachniveau)",
    r"sprache[n]?:\s*deutsch",
    r"verhandlungssicher(es?)?\s+deutsch",
    r"deutsch\s+verhandlungssicher",
    r"kommunikation(sf[äa]higkeit)?\s+in\s+deutsch",
    r"german\s+at\s+(a\s+)?(native|business|professional|fluent)\s+level",
    r"(mindestens|minimum)\s+(b2|c1|c2)\s+(in\s+)?german",
    r"(mindestens|minimum)\s+(b2|c1|c2)\s+(in\s+)?deutsch",
]

GERMAN_OPTIONAL = [
    r"german\s+(is\s+)?(a\s+)?(plus|bonus|advantage|beneficial|nice|preferred|helpful|asset|welcome|desirable)",
    r"(ideally|preferably|optionally).*german",
    r"german.*not\s+(required|mandatory|necessary|essential)",
    r"german\s+(helpful|advantageous)\s+but\s+not\s+(required|essential|mandatory)",
    r"deutsch(kenntnisse)?\s+(von\s+vorteil|w[üu]nschenswert|hilfreich|vorteilhaft|willkommen)",
    r"german\s+is\s+not\s+(required|a\s+must|necessary)",
    r"german\s+language\s+skills\s+are\s+(a\s+)?(plus|bonus|advantage)",
    r"(basic|some|elementary)\s+german",
    r"german\s+(a1|a2|b1)\b",
    r"willingness\s+to\s+learn\s+german",
    r"german\s+is\s+(nice|good)\s+to\s+have",
    r"(bonus|plus)\s*:\s*german",
    r"open\s+to\s+learning\s+german",
    r"bereitschaft\s+deutsch\s+zu\s+lernen",
]

ENGLISH_WORKING = [
    r"(working|company|team|office|corporate)\s+language.*english",
    r"english[\s-]speaking\s+(environment|team|company|office|workplace)",
    r"(all|our)\s+(communication|meetings|work).*in\s+english",
    r"english\s+(is\s+)?(the\s+)?(working|official|primary|main)\s+language",
    r"no\s+german\s+(required|needed|necessary)",
    r"international\s+(team|environment|company).*english",
    r"without\s+(any\s+)?german",
    r"englisch\s+(ist\s+)?(die\s+)?(arbeitssprache|unternehmenssprache)",
    r"(fluent|proficient|excellent)\s+english\s+(is\s+)?(required|mandatory|essential)",
    r"english\s+(c1|c2|native)\s+(required|level)",
    r"communicate\s+(effectively\s+)?in\s+english",
    r"english\s+only\s+(environment|team|workplace)",
]

ENGLISH_REQUIRED = [
    r"english\s+(is\s+)?(required|mandatory|essential|necessary|must|needed)",
    r"(fluent|native|proficient|excellent|strong)\s+(in\s+)?english",
    r"(must|need\s+to|should)\s+(speak|know|have)\s+english",
    r"english\s+(c1|c2|b2|native|fluency|fluent)",
    r"english[\s-]speaking\s+(required|essential|mandatory)",
    r"english\s+language\s+(required|needed|skills|proficiency)",
    r"(good|excellent|strong)\s+command\s+of\s+english",
    r"english\s+communication\s+skills",
]

FRENCH_REQUIRED = [
    r"french\s+(is\s+)?(required|mandatory|essential|necessary|needed)",
    r"(fluent|native|proficient|excellent)\s+(in\s+)?french",
    r"(must|need\s+to)\s+(speak|know|have)\s+french",
    r"french\s+(c1|c2|b2|native|fluent)",
    r"french[\s-]speaking\s+(required|essential|mandatory)",
    r"fran[çc]ais\s+(requis|obligatoire|indispensable|courant)",
    r"ma[îi]trise\s+du\s+fran[çc]ais",
    r"langue\s+de\s+travail.*fran[çc]ais",
]

DUTCH_REQUIRED = [
    r"dutch\s+(is\s+)?(required|mandatory|essential|necessary|needed)",
    r"(fluent|native|proficient|excellent)\s+(in\s+)?dutch",
    r"(must|need\s+to)\s+(speak|know|have)\s+dutch",
    r"dutch\s+(c1|c2|b2|native|fluent)",
    r"dutch[\s-]speaking\s+(required|essential|mandatory)",
    r"nederlands\s+(vereist|verplicht|noodzakelijk|vloeiend)",
    r"vloeiend\s+nederlands",
]

HINDI_REQUIRED = [
    r"hindi\s+(is\s+)?(required|mandatory|essential|necessary|needed)",
    r"(fluent|native|proficient)\s+(in\s+)?hindi",
    r"(must|need\s+to)\s+(speak|know|have)\s+hindi",
    r"hindi[\s-]speaking\s+(required|essential|mandatory)",
    r"hindi\s+language\s+(required|needed|skills)",
    r"(speak|speaking)\s+hindi",
    r"regional\s+language.*hindi",
]

GERMAN_TITLE = [
    r"\(m/w/d\)", r"\(w/m/d\)", r"\(m/w/x\)", r"\(w/m/x\)",
    r"\(m/f/d\)", r"\(f/m/d\)", r"\(m/f/x\)",
    r"bundesweit", r"stellenangebot", r"sachbearbeiter",
    r"fachinformatiker", r"kaufmann", r"kauffrau",
    r"werkstudent", r"praktikant", r"auszubildende",
    r"referent(in)?", r"teamleiter(in)?",
    r"german[\s-]speak", r"deutschsprachig",
    r"german[\s-]native", r"muttersprachler",
    r"german\s+required", r"deutsch\s+erforderlich",
    r"deu?tschland",
    r"projektleiter(in)?", r"produktmanager(in)?",
    r"gesch[äa]ftsf[üu]hrer(in)?", r"berater(in)?",
    r"entwickler(in)?", r"ingenieur(in)?",
    r"mitarbeiter(in)?", r"leiter(in)?",
    r"fachkraft", r"spezialist(in)?",
    r"vollzeit", r"teilzeit",
    r"festanstellung", r"befristet",
    r"standort\s*:", r"ab\s+sofort",
]

# Every pattern of a rule set contains one of these literals, so a text without any of them
# cannot match and the patterns need not be tried.
RULE_LITERALS = {
    "no_german": ["german"],
    "german_required": ["german", "deutsch"],
    "german_optional": ["german", "deutsch"],
    "english_working": ["english", "englisch", "german"],
    "english_required": ["english"],
    "french_required": ["french", "fran"],
    "dutch_required": ["dutch", "nederlands"],
    "hindi_required": ["hindi"],
}

# --- fixed values: language codes and names ----------------------------------------------
LANGUAGE_NAMES = {
    "en": "English",
    "de": "German",
    "fr": "French",
    "es": "Spanish",
    "nl": "Dutch",
    "pt": "Portuguese",
    "it": "Italian",
    "hi": "Hindi",
    "ja": "Japanese",
    "zh-cn": "Chinese",
    "ko": "Korean",
    "ar": "Arabic",
    "ru": "Russian",
    "pl": "Polish",
    "sv": "Swedish",
    "da": "Danish",
    "no": "Norwegian",
    "fi": "Finnish",
}
MIN_LANGUAGE_TEXT = 30  # shorter texts have no language

# Function words that carry the language of a Latin-script text (our own choice; the share
# of such words decides, see functions.language).
STOP_WORDS = {
    "en": "the of and to in is was for on with that by this are be at from or have an which "
          "not you we will our your as it he she they his her their has had were been",
    "de": "der die das und ist von mit für auf den dem des ein eine im zu nicht sich als auch "
          "es an werden aus er hat dass sie nach wird bei einer um am sind noch wie wir zur",
    "fr": "le la les des et est un une du que dans qui pour pas au sur avec ce il sont plus par "
          "ne se vous nous aux cette ou elle leur être votre notre",
    "es": "el la los las de y que en un una es por con para del se no al lo como más pero sus "
          "su este entre está son sobre también fue ser ha",
    "nl": "de het een en van is dat op te zijn met voor niet aan er om ook als bij door maar "
          "naar uit wordt we je ons onze heeft deze",
    "pt": "o a os as de e que em um uma é para com não do da dos das no na por mais se ao como "
          "mas foi são você nós",
    "it": "il lo la i gli le di e che un una è per con non del della dei in si da come più ma "
          "sono al nel alla anche",
    "sv": "och att det som en på är av för med den till inte om ett han men var sig från vi så "
          "kan när vara",
    "da": "og at det som en på er af for med den til ikke om et han men var sig fra vi så kan "
          "når være",
    "no": "og at det som en på er av for med den til ikke om et han men var seg fra vi så kan "
          "når være",
    "fi": "ja on ei että se hän oli joka mutta ovat kun niin myös tai sen ole kuin jos",
    "pl": "i w na z do się nie jest to że o jak za po ale od dla przez są tym",
}
# Scripts that settle the language without words, checked in order.
SCRIPT_LANGUAGES = [
    ("ja", r"[぀-ヿ]"),
    ("ko", r"[가-힯]"),
    ("zh-cn", r"[一-鿿]"),
    ("hi", r"[ऀ-ॿ]"),
    ("ar", r"[؀-ۿ]"),
    ("ru", r"[Ѐ-ӿ]"),
]

# --- fixed values: location rules ---------------------------------------------------------
GERMAN_CITIES = [
    "berlin", "munich", "münchen", "hamburg", "frankfurt",
    "cologne", "köln", "düsseldorf", "stuttgart", "dresden",
    "leipzig", "hannover", "nuremberg", "nürnberg", "dortmund",
    "essen", "bremen", "bonn", "mannheim", "karlsruhe",
    "freiburg", "heidelberg", "mainz", "wiesbaden", "potsdam",
    "rostock", "kiel", "augsburg", "aachen", "regensburg",
    "darmstadt", "wolfsburg", "ingolstadt", "ulm", "bielefeld",
]

INDIAN_CITIES = [
    "bangalore", "bengaluru", "mumbai", "hyderabad", "pune",
    "delhi", "new delhi", "ncr", "delhi ncr", "gurgaon", "gurugram",
    "noida", "greater noida", "ghaziabad", "faridabad",
    "chennai", "kolkata", "ahmedabad", "jaipur", "lucknow",
    "kochi", "cochin", "thiruvananthapuram", "trivandrum",
    "chandigarh", "indore", "bhopal", "nagpur", "coimbatore",
    "visakhapatnam", "vizag", "mysore", "mysuru", "mangalore",
    "mangaluru", "vadodara", "surat", "rajkot", "gandhinagar",
    "bhubaneswar", "patna", "ranchi", "dehradun", "shimla",
    "goa", "panaji", "pondicherry", "puducherry",
]

CITIES_OF_SCOPE = {"germany": GERMAN_CITIES, "india": INDIAN_CITIES}
GERMANY_MARKERS = [", de", "germany", "deutschland"]
INDIA_MARKERS = [", in", "india", "bharat"]
REMOTE_LOCATION_WORDS = ["remote", "home office", "wfh"]

BLOCKED_REMOTE = [
    "united states", "usa", "u.s.", "us only",
    "canada only", "australia only", "japan only",
    "china only", "korea only", "brazil only",
    "latin america", "latam only",
]

# --- fixed values: boards and query templates -----------------------------------------------
DEFAULT_BOARDS = ["indeed", "linkedin", "google"]
COUNTRY_BOARDS = {
    "India": ["indeed", "linkedin", "naukri"],
    "UAE": ["indeed", "linkedin", "bayt"],
    "Saudi Arabia": ["indeed", "linkedin", "bayt"],
    "Qatar": ["indeed", "linkedin", "bayt"],
    "Bahrain": ["indeed", "linkedin", "bayt"],
    "Kuwait": ["indeed", "linkedin", "bayt"],
    "Oman": ["indeed", "linkedin", "bayt"],
}

QUERY_TEMPLATES = [
    'site:myworkdayjobs.com "{keyword}" "{location}"',
    'site:boards.greenhouse.io "{keyword}" "{location}"',
    'site:jobs.lever.co "{keyword}" "{location}"',
    'site:jobs.ashbyhq.com "{keyword}" "{location}"',
    'site:jobs.smartrecruiters.com "{keyword}" "{location}"',
    'site:jobs.personio.de "{keyword}" "{location}"',
    'site:icims.com "{keyword}" "{location}"',
    'site:taleo.net "{keyword}" "{location}"',
    'site:recruiting.paylocity.com "{keyword}" "{location}"',
    'site:breezy.hr "{keyword}" "{location}"',
    'inurl:careers "{keyword}" "{location}" -site:linkedin.com -site:indeed.com -site:glassdoor.com',
    'inurl:/jobs/ "{keyword}" "{location}" -site:linkedin.com -site:indeed.com -site:glassdoor.com',
    'intitle:"careers" "{keyword}" "{location}" -site:linkedin.com -site:indeed.com',
    'site:myworkdayjobs.com "{keyword}" "{location}" "English"',
    'site:boards.greenhouse.io "{keyword}" "{location}" "English"',
]
LANGUAGE_QUERY_TEMPLATES = {
    "English": [
        '"{keyword}" "{location}" "no German required"',
        '"{keyword}" "{location}" "English speaking" careers',
        '"{keyword}" "{location}" "international team" inurl:jobs',
    ],
    "German": [
        '"{keyword}" "{location}" "Deutschkenntnisse" Karriere',
        '"{keyword}" "{location}" "Stellenangebot"',
    ],
}
OR_QUERY_TEMPLATES = [
    'site:myworkdayjobs.com ({roles_or}) "{location}"',
    'site:boards.greenhouse.io ({roles_or}) "{location}"',
    'site:jobs.lever.co ({roles_or}) "{location}"',
    'site:jobs.ashbyhq.com ({roles_or}) "{location}"',
    'site:jobs.personio.de ({roles_or}) "{location}"',
    'site:jobs.smartrecruiters.com ({roles_or}) "{location}"',
    'inurl:careers ({roles_or}) "{location}" -site:linkedin.com -site:indeed.com',
    '({roles_or}) "{location}" "hiring" inurl:jobs -site:linkedin.com -site:indeed.com -site:glassdoor.com',
]
MONTHLY_QUERY_QUOTA = 100

# --- fixed values: platforms by URL, first match wins -----------------------------------------
REGISTRY_URL_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/([\w-]+)",
    "lever": r"jobs\.lever\.co/([\w-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([\w-]+)",
    "smartrecruiters": r"jobs\.smartrecruiters\.com/([\w-]+)",
    "personio": r"([\w-]+)\.jobs\.personio\.de",
    "workday": r"([\w-]+)\.wd\d+\.myworkdayjobs\.com",
}
ROUTER_URL_PATTERNS = {
    "workday": r"[\w-]+\.wd\d+\.myworkdayjobs\.com",
    "greenhouse": r"boards\.greenhouse\.io/([\w-]+)",
    "lever": r"jobs\.lever\.co/([\w-]+)",
    "personio": r"([\w-]+)\.jobs\.personio\.de",
    "ashby": r"jobs\.ashbyhq\.com/([\w-]+)",
    "smartrecruiters": r"jobs\.smartrecruiters\.com/([\w-]+)",
    "icims": r"careers[\w-]*\.icims\.com",
    "taleo": r"[\w-]+\.taleo\.net",
}
CRAWLER_PATTERNS = [
    ("greenhouse", r"boards\.greenhouse\.io/([\w-]+)"),
    ("greenhouse", r"greenhouse\.io"),
    ("greenhouse", r"grnh\.se"),
    ("lever", r"jobs\.lever\.co/([\w-]+)"),
    ("lever", r"lever\.co"),
    ("ashby", r"jobs\.ashbyhq\.com/([\w-]+)"),
    ("ashby", r"ashbyhq\.com"),
    ("workday", r"[\w-]+\.wd\d+\.myworkdayjobs\.com"),
    ("workday", r"myworkdayjobs\.com"),
    ("personio", r"([\w-]+)\.jobs\.personio\.de"),
    ("personio", r"personio\.de"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([\w-]+)"),
    ("smartrecruiters", r"smartrecruiters\.com"),
    ("icims", r"careers[\w-]*\.icims\.com"),
    ("icims", r"icims\.com"),
    ("taleo", r"[\w-]+\.taleo\.net"),
    ("taleo", r"taleo\.net"),
    ("bamboohr", r"([\w-]+)\.bamboohr\.com/careers"),
    ("bamboohr", r"bamboohr\.com"),
    ("recruitee", r"([\w-]+)\.recruitee\.com"),
    ("recruitee", r"recruitee\.com"),
    ("breezyhr", r"([\w-]+)\.breezy\.hr"),
    ("breezyhr", r"breezy\.hr"),
]
# Literals of which every crawler pattern holds one; pages without any are not searched.
CRAWLER_LITERALS = [
    "greenhouse.io", "grnh.se", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "personio.de",
    "smartrecruiters.com", "icims.com", "taleo.net", "bamboohr.com", "recruitee.com", "breezy.hr",
]

# --- fixed values: URL filters -------------------------------------------------------------------
BLOCKED_URL_PARTS = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "tiktok.com",
    "youtube.com", "reddit.com", "quora.com",
    "linkedin.com/feed", "linkedin.com/posts", "linkedin.com/pulse",
    "ziprecruiter.com/Jobs/", "ziprecruiter.com/jobs/",
    "indeed.com/q-", "indeed.com/jobs?", "indeed.com/career",
    "glassdoor.com/Job-", "glassdoor.com/job-listing",
    "jobright.ai", "adzuna.com", "jooble.org", "talent.com",
    "salary.com", "payscale.com", "levels.fyi",
    "wikipedia.org", "medium.com", "substack.com",
    "github.com", "stackoverflow.com", "stackexchange.com",
    "crunchbase.com", "pitchbook.com",
    "visa.co.uk/careers.html", "visa.com/careers.html",
]
JOB_URL_PARTS = [
    "myworkdayjobs.com",
    "boards.greenhouse.io",
    "jobs.lever.co",
    "jobs.ashbyhq.com",
    "jobs.personio.de",
    "jobs.smartrecruiters.com",
    "icims.com",
    "taleo.net",
    "breezy.hr",
    "recruiting.paylocity.com",
    "/job/", "/jobs/", "/career/", "/careers/",
    "/position/", "/opening/", "/vacancy/",
    "/apply", "/posting",
    "job-board", "jobboard",
]
KNOWN_BOARD_DOMAINS = [
    "indeed.com", "linkedin.com", "glassdoor.com",
    "google.com", "ziprecruiter.com", "naukri.com",
    "foundit.in", "instahyre.com", "arbeitnow.com",
    "boards.greenhouse.io", "jobs.lever.co",
    "jobs.ashbyhq.com", "jobs.smartrecruiters.com",
]

# --- fixed values: career pages --------------------------------------------------------------------
CAREER_PATHS = [
    "/careers", "/jobs", "/careers/", "/jobs/", "/en/careers", "/en/jobs",
    "/about/careers", "/company/careers", "/work-with-us", "/join-us",
    "/open-positions", "/vacancies", "/opportunities",
]
CAREER_URL_WORDS = ["career", "jobs", "vacancies", "openings", "join", "hiring"]
CAREER_SIGNALS = [
    "open positions", "current openings", "job openings",
    "career opportunities", "join our team", "we're hiring",
    "apply now", "view all jobs", "search jobs",
    "open roles", "job listings",
]
MIN_CAREER_SIGNALS = 2

# --- fixed values: feed categories by search word, first match wins -----------------------------------
FEED_CATEGORIES = {
    "software": "software-dev",
    "engineer": "software-dev",
    "developer": "software-dev",
    "data": "data",
    "design": "design",
    "product": "product",
    "marketing": "marketing",
    "sales": "sales",
    "customer": "customer-support",
    "devops": "devops",
    "qa": "qa",
    "writing": "writing",
    "finance": "finance",
    "hr": "hr",
    "legal": "legal",
}

# --- fixed values: limits that are features ----------------------------------------------------------------
COMPANIES_PER_PLATFORM = 200
GENERIC_URLS = 20
CRAWL_DOMAINS = 30
PAGE_SIZE = 25
RECENT_COMPANIES = 10
TRACKED_SHOWN = 20
MODEL_BATCH = 5
MIN_PAGE_DESCRIPTION = 100

# --- fixed values: application tracker ------------------------------------------------------------------------
TRACKER_STATUSES = ["saved", "applied", "interviewing", "rejected", "offered", "accepted"]

# --- fixed values: scores ----------------------------------------------------------------------------------------
SCORE_BANDS = [(70, "high"), (40, "medium")]

# --- fixed values: report columns -----------------------------------------------------------------------------------
SUMMARY_COLUMNS = [
    "source", "ats_platform", "title", "company", "location", "country",
    "date_posted", "job_type", "experience_level", "is_remote", "salary_min",
    "salary_max", "salary_currency", "salary_interval", "job_url", "company_url",
    "language",
]
SCORE_COLUMNS = [
    "title", "company", "job_url", "ai_score", "ai_reasoning",
    "ai_cover_letter", "ai_resume_bullets",
]
DISPLAY_COLUMNS = [
    "title", "company", "location", "experience_level", "is_remote",
    "listing_language", "language_required", "ai_detected_language",
    "date_posted", "job_type", "source",
]
