"""Model answers and the application tracker.

Answers are derived from the postings of each batch, in the shapes models give them: plain,
fenced, with a preamble, cut short, garbage, none, and with shifted indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacancia.functions import responses as R
from vacancia.operators import enrich as EN, filters as FL, ordering as OR, summaries as SU, tracker as TR
from vacancia.operators.ordering import with_batches

from .base import jobs, on_jobs, query, table
from .classify import BATCHED, LANGUAGE_BLOCK_SQL, SALARY_BLOCK_SQL, SCORE_BLOCK_SQL, SKILLS_BLOCK_SQL

SHAPES = 7  # 0, 6 plain; 1 fenced; 2 preamble; 3 first two only; 4 garbage; 5 none


def responses(batched, item: Column):
    """(batch_id, response) from one JSON text per posting; a batch has at most five."""
    shape = F.col("batch_id") % SHAPES
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("json")))), lambda x: x["json"])
    kept = F.when(shape == 3, F.slice(items, 1, 2)).otherwise(items)
    array = F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))
    text = (
        F.when(shape == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here you go: "), array, F.lit(" Bye.")))
        .when(shape == 4, F.lit("sorry, [no"))
        .when(shape == 5, F.lit(""))
        .otherwise(array)
    )
    return batched.groupBy("batch_id").agg(text.alias("response"))


# --- scores -------------------------------------------------------------------------------------------


def score_items(batched):
    pros = F.when(F.col("seq") % 2 == 0, F.array(F.lit("fits"), F.concat(F.lit("near "), F.col("seq").cast("string")))).otherwise(F.array().cast("array<string>"))
    cons = F.when(F.col("seq") % 3 == 0, F.array(F.lit("far"))).otherwise(F.array().cast("array<string>"))
    item = F.to_json(
        F.struct(
            F.col("idx").alias("job_index"), (F.col("seq") % 130 - 10).alias("score"),
            F.concat(F.lit("because of "), F.col("seq").cast("string")).alias("reasoning"), pros.alias("pros"), cons.alias("cons"),
        )
    )
    return responses(batched, item)


_ANSWERED = "(batch_id % 7 IN (0, 1, 2, 6) OR (batch_id % 7 = 3 AND idx < 2))"
SCORED_SQL = f"""scored AS (SELECT seq, batch_id, idx,
  CASE WHEN {_ANSWERED} THEN CAST(greatest(1, least(100, seq % 130 - 10)) AS INTEGER) ELSE 0 END AS ai_score,
  CASE WHEN {_ANSWERED} THEN 'because of ' || seq || CASE WHEN seq % 2 = 0 THEN chr(10) || 'Pros: fits; near ' || seq ELSE '' END
      || CASE WHEN seq % 3 = 0 THEN chr(10) || 'Cons: far' ELSE '' END
    WHEN batch_id % 7 = 3 THEN 'Missing from batch response' WHEN batch_id % 7 = 4 THEN 'Failed to parse AI response'
    ELSE 'Model returned no usable response' END AS ai_reasoning,
  CASE WHEN {_ANSWERED} AND seq % 2 = 0 THEN 'fits; near ' || seq ELSE '' END AS pros,
  CASE WHEN {_ANSWERED} AND seq % 3 = 0 THEN 'far' ELSE '' END AS cons FROM batched)"""
_BATCHES = BATCHED.format(src="jobs")


def score_batches(spark, sf):
    # the order of batches does not hang on the scores there were before
    return with_batches(jobs(spark, sf)).select("seq", "title", "batch_id", "idx")


@query("fn_score_parse", on_jobs("SELECT batch_id, idx, ai_score AS score, ai_reasoning AS reasoning FROM scored WHERE " + _ANSWERED, _BATCHES + ", " + SCORED_SQL))
def fn_score_parse(spark, sf):
    answers = score_items(score_batches(spark, sf))
    each = answers.select("batch_id", F.posexplode(R.items(R.extract_json(F.col("response")))).alias("idx", "answer"))
    return each.select("batch_id", "idx", R.score_value(F.col("answer")).alias("score"), R.reasoning_text(F.col("answer")).alias("reasoning"))


@query("fn_json_extract_lenient", on_jobs("SELECT batch_id, CASE WHEN batch_id % 7 IN (4, 5) THEN NULL WHEN batch_id % 7 = 3 THEN least(2, count(*)) ELSE count(*) END AS n, CASE WHEN batch_id % 7 NOT IN (4, 5) THEN 'because of ' || min(seq) END AS first_reason FROM batched GROUP BY batch_id", _BATCHES))
def fn_json_extract_lenient(spark, sf):
    answers = score_items(score_batches(spark, sf)).withColumn("v", R.extract_json(F.col("response")))
    return answers.select(
        "batch_id", F.size(R.items(F.col("v"))).cast("bigint").alias("n"), F.try_variant_get("v", "$[0].reasoning", "string").alias("first_reason")
    )


@query("join_score_positional", on_jobs("SELECT seq, batch_id, idx, ai_score, ai_reasoning FROM scored", _BATCHES + ", " + SCORED_SQL))
def join_score_positional(spark, sf):
    batched = score_batches(spark, sf)
    return EN.scores_by_position(batched, score_items(batched)).select("seq", "batch_id", "idx", "ai_score", "ai_reasoning")


@query("apply_scores", on_jobs("SELECT seq, ai_score, ai_reasoning, pros, cons FROM scored", _BATCHES + ", " + SCORED_SQL))
def apply_scores(spark, sf):
    batched = score_batches(spark, sf)
    return EN.apply_scores(batched, score_items(batched)).select(
        "seq", "ai_score", "ai_reasoning", F.array_join("ai_pros", "; ").alias("pros"), F.array_join("ai_cons", "; ").alias("cons")
    )


# --- answers by index ------------------------------------------------------------------------------------
# shape 6 shifts every index by one: the first posting of a batch gets none, the last answer is dropped


def _index():
    return (F.col("idx") + F.when(F.col("batch_id") % SHAPES == 6, 1).otherwise(0)).alias("job_index")


_BY_INDEX = "(batch_id % 7 IN (0, 1) OR (batch_id % 7 = 3 AND idx < 2) OR (batch_id % 7 = 6 AND idx > 0))"
# the posting whose answer a row gets
_GIVER = "CASE WHEN batch_id % 7 = 6 THEN lag(seq) OVER (PARTITION BY batch_id ORDER BY idx) ELSE seq END"


def skill_items(batched):
    many = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda n: F.concat(F.lit(" s"), n.cast("string"), F.lit(" ")))
    few = F.array(F.concat(F.lit("skill "), F.col("seq").cast("string")), F.lit(""), F.lit(" Agile "))
    listed = F.when(F.col("seq") % 10 == 0, many).when(F.col("seq") % 10 == 1, F.array().cast("array<string>")).otherwise(few)
    return responses(batched, F.to_json(F.struct(_index(), listed.alias("skills"))))


_SKILLS_SQL = f"""SELECT seq, batch_id, idx, CASE WHEN NOT {_BY_INDEX} OR giver IS NULL OR giver % 10 = 1 THEN ''
  WHEN giver % 10 = 0 THEN {"|| ';' ||".join(f"'s{n}'" for n in range(1, 31))} ELSE 'skill ' || giver || ';Agile' END AS skills
  FROM (SELECT *, {_GIVER} AS giver FROM batched)"""


def _skills_of(v):
    return F.array_join(v, ";").alias("skills")


@query("apply_skills", on_jobs(_SKILLS_SQL.replace("seq, batch_id, idx, CASE", "seq, CASE"), _BATCHES))
def apply_skills(spark, sf):
    batched = score_batches(spark, sf)
    return EN.apply_skills(batched, skill_items(batched)).select("seq", _skills_of(F.col("skills")))


@query("join_batch_response", on_jobs(_SKILLS_SQL, _BATCHES))
def join_batch_response(spark, sf):
    batched = score_batches(spark, sf)
    answers = EN.answers_by_index(skill_items(batched), R.skills(F.col("answer")))
    return EN.join_answers(batched, answers).select("seq", "batch_id", "idx", _skills_of(F.coalesce("value", F.array().cast("array<string>"))))


@query("fn_skills_parse", on_jobs(
    f"""SELECT seq, CASE WHEN seq % 10 = 1 THEN '' WHEN seq % 10 = 0 THEN {"|| ';' ||".join(f"'s{n}'" for n in range(1, 31))} ELSE 'skill ' || seq || ';Agile' END AS skills FROM jobs"""
))
def fn_skills_parse(spark, sf):
    # one response per posting, a lone object
    alone = jobs(spark, sf).select("seq", F.col("seq").alias("batch_id"), F.lit(0).alias("idx"))
    many = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda n: F.concat(F.lit(" s"), n.cast("string"), F.lit(" ")))
    few = F.array(F.concat(F.lit("skill "), F.col("seq").cast("string")), F.lit(""), F.lit(" Agile "))
    listed = F.when(F.col("seq") % 10 == 0, many).when(F.col("seq") % 10 == 1, F.array().cast("array<string>")).otherwise(few)
    text = F.concat(F.lit("```\n"), F.to_json(F.struct(listed.alias("skills"))), F.lit("\n```"))
    return alone.select("seq", _skills_of(R.skills(R.unfenced_json(text))))


def _salary_json():
    low = F.when(F.col("seq") % 3 == 0, F.lit(None)).when(F.col("seq") % 3 == 1, 0).otherwise(30000 + F.col("seq"))
    high = F.when(F.col("seq") % 6 == 0, F.lit(None)).otherwise(50000 + F.col("seq"))
    currency = F.when(F.col("seq") % 2 == 0, "EUR")
    return low.alias("min"), high.alias("max"), currency.alias("currency")


_EST = {
    "salary_estimated_min": "CASE WHEN {g} % 3 = 2 THEN CAST(30000 + {g} AS DOUBLE) END",
    "salary_estimated_max": "CASE WHEN {g} % 6 <> 0 THEN CAST(50000 + {g} AS DOUBLE) END",
    "salary_estimated_currency": "CASE WHEN {g} % 6 <> 0 THEN CASE WHEN {g} % 2 = 0 THEN 'EUR' ELSE 'USD' END END",
}
_NEEDING = BATCHED.format(src="jobs WHERE coalesce(salary_min, 0) = 0 AND coalesce(salary_max, 0) = 0")


@query("apply_salary_estimates", on_jobs(
    "SELECT seq, " + ", ".join(f"CASE WHEN {_BY_INDEX} AND giver IS NOT NULL THEN {e.format(g='giver')} END AS {n}" for n, e in _EST.items())
    + f" FROM (SELECT *, {_GIVER} AS giver FROM batched) UNION ALL SELECT seq, NULL, NULL, NULL FROM jobs WHERE coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0", _NEEDING))
def apply_salary_estimates(spark, sf):
    postings = jobs(spark, sf)
    batched = with_batches(FL.needs_salary_estimate(postings)).select("seq", "batch_id", "idx")
    answers = responses(batched, F.to_json(F.struct(_index(), *_salary_json())))
    return EN.apply_salary_estimates(postings, batched, answers).select("seq", *_EST)


@query("fn_salary_estimate_parse", on_jobs("SELECT seq, " + ", ".join(f"{e.format(g='seq')} AS {n.removeprefix('salary_estimated_')}" for n, e in _EST.items()) + " FROM jobs"))
def fn_salary_estimate_parse(spark, sf):
    text = F.to_json(F.struct(*_salary_json()))
    return jobs(spark, sf).select("seq", R.salary_estimate(R.unfenced_json(text)).alias("e")).select("seq", "e.*")


def _language_json():
    listing = F.when(F.col("seq") % 4 != 0, F.when(F.col("seq") % 4 == 1, "unknown").otherwise("German"))
    asked = F.when(F.col("seq") % 5 != 0, F.when(F.col("seq") % 5 == 1, "").otherwise("English"))
    return listing.alias("listing_language"), asked.alias("language_required")


_SAID_LISTING = "CASE {g} % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE 'German' END"
_SAID_ASKED = "CASE {g} % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE 'English' END"


@query("fn_language_answer_parse", on_jobs(
    f"SELECT seq, {_SAID_LISTING.format(g='seq')} AS listing_language, {_SAID_ASKED.format(g='seq')} AS language_required, 'medium' AS confidence FROM jobs WHERE seq % 2 = 0 "
    "UNION ALL SELECT seq, 'unknown', 'unknown', 'low' FROM jobs WHERE seq % 2 = 1"))
def fn_language_answer_parse(spark, sf):
    # every other response cannot be parsed
    text = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(*_language_json()))).otherwise("I think it is English")
    return jobs(spark, sf).select("seq", R.language_answer(R.unfenced_json(text)).alias("a")).select("seq", "a.*")


_AI_SQL = f"""answers AS (SELECT *, {_BY_INDEX} AND giver IS NOT NULL AS has, {_SAID_LISTING.format(g='giver')} AS said_l, {_SAID_ASKED.format(g='giver')} AS said_r
  FROM (SELECT *, {_GIVER} AS giver FROM batched))"""


@query("backfill_ai_language", on_jobs(
    """SELECT seq, CASE WHEN has THEN coalesce(nullif(said_r, ''), nullif(said_l, ''), '') ELSE ai_detected_language END AS ai_detected_language,
    CASE WHEN has AND said_l <> 'unknown' AND coalesce(nullif(listing_language, ''), 'unknown') = 'unknown' THEN said_l ELSE listing_language END AS listing_language,
    CASE WHEN has AND said_r NOT IN ('', 'unknown') AND coalesce(nullif(language_required, ''), 'unknown') = 'unknown' THEN said_r ELSE language_required END AS language_required,
    CASE WHEN has AND said_r NOT IN ('', 'unknown') AND coalesce(nullif(language_required, ''), 'unknown') = 'unknown' THEN said_r ELSE language END AS language
    FROM answers UNION ALL SELECT seq, ai_detected_language, listing_language, language_required, language FROM jobs WHERE coalesce(ai_detected_language, '') <> ''""", BATCHED.format(src="jobs WHERE coalesce(ai_detected_language, '') = ''") + ", " + _AI_SQL))
def backfill_ai_language(spark, sf):
    postings = jobs(spark, sf)
    batched = with_batches(FL.needs_ai_language(postings)).select("seq", "batch_id", "idx")
    answers = responses(batched, F.to_json(F.struct(_index(), *_language_json())))
    return EN.backfill_ai_language(postings, batched, answers).select("seq", "ai_detected_language", "listing_language", "language_required", "language")


# --- batches and pages ---------------------------------------------------------------------------------------


@query("win_batch_index", on_jobs("SELECT seq, batch_id, idx FROM batched", _BATCHES))
def win_batch_index(spark, sf):
    return with_batches(jobs(spark, sf).select("seq")).select("seq", "batch_id", "idx")


_BLOCKS = {"score": (SCORE_BLOCK_SQL, "chr(10) || '---' || chr(10)"), "skills": (SKILLS_BLOCK_SQL, "chr(10)")}


@query("prompt_batches", on_jobs(
    " UNION ALL ".join(f"SELECT '{k}' AS kind, batch_id, string_agg({b}, {j} ORDER BY idx) AS jobs_block FROM batched GROUP BY batch_id" for k, (b, j) in _BLOCKS.items()), _BATCHES))
def prompt_batches(spark, sf):
    df = jobs(spark, sf)
    parts = [EN.prompt_batches(df, kind).select(F.lit(kind).alias("kind"), "batch_id", "jobs_block") for kind in _BLOCKS]
    return parts[0].unionAll(parts[1])


@query("prompt_batches_pending", on_jobs(
    f"SELECT 'salary' AS kind, batch_id, string_agg({SALARY_BLOCK_SQL}, chr(10) ORDER BY idx) AS jobs_block FROM paid GROUP BY batch_id UNION ALL "
    f"SELECT 'language', batch_id, string_agg({LANGUAGE_BLOCK_SQL}, chr(10) ORDER BY idx) FROM spoken GROUP BY batch_id",
    _NEEDING.replace("batched AS", "paid AS", 1) + ", " + BATCHED.format(src="jobs WHERE coalesce(ai_detected_language, '') = ''").replace("batched AS", "spoken AS", 1)))
def prompt_batches_pending(spark, sf):
    df = jobs(spark, sf)
    parts = [EN.prompt_batches(df, kind).select(F.lit(kind).alias("kind"), "batch_id", "jobs_block") for kind in ("salary", "language")]
    return parts[0].unionAll(parts[1])


# --- tracker ----------------------------------------------------------------------------------------------------

STATUSES = ["saved", "applied", "interviewing", "rejected", "offered", "accepted", "bogus"]


def events(spark, sf):
    """The event stream read as a log of tracker events; users stand for postings."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    kind = (
        F.when((F.col("event_type") == "error") & (i % 3 == 0), "delete")
        .when(F.col("event_type").isin("view", "error"), "save")
        .when(F.col("event_type") == "signup", "notes")
        .otherwise("status")
    )
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    number = i.cast("string")
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("user_id").cast("string")).alias("job_url"),
        kind.alias("kind"),
        F.get(statuses, (i % 7).cast("int")).alias("status"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, None).otherwise(F.concat(F.lit("note "), number)).alias("notes"),
        F.when(i % 5 == 0, F.concat(F.lit("letter "), number)).otherwise("").alias("cover_letter"),
        F.concat(F.lit("Title "), number).alias("title"),
        F.concat(F.lit("Company "), F.col("user_id").cast("string")).alias("company"),
        F.when(i % 2 == 0, "Berlin").alias("location"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
    )


EVENTS_SQL = f"""log AS (SELECT event_id AS seq, 'https://jobs.example.com/' || user_id AS job_url,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' WHEN event_type IN ('view', 'error') THEN 'save'
       WHEN event_type = 'signup' THEN 'notes' ELSE 'status' END AS kind,
  (['{"', '".join(STATUSES)}'])[1 + event_id % 7] AS status,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'note ' || event_id END AS notes,
  CASE WHEN event_id % 5 = 0 THEN 'letter ' || event_id ELSE '' END AS cover_letter,
  'Title ' || event_id AS title, 'Company ' || user_id AS company, CASE WHEN event_id % 2 = 0 THEN 'Berlin' END AS location,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events)"""
TRACKER_SQL = f"""WITH {EVENTS_SQL}, valid AS (SELECT * FROM log WHERE kind IN ('notes', 'delete') OR status <> 'bogus'),
 alive AS (SELECT v.*, max(CASE WHEN kind = 'delete' THEN seq END) OVER (PARTITION BY job_url) AS gone FROM valid v),
 begun AS (SELECT *, min(CASE WHEN kind = 'save' THEN seq END) OVER (PARTITION BY job_url) AS start FROM alive WHERE gone IS NULL OR seq > gone),
 applications AS (SELECT job_url, max(title) FILTER (seq = start) AS title, max(company) FILTER (seq = start) AS company,
   max(coalesce(location, '')) FILTER (seq = start) AS location,
   arg_max(status, seq) FILTER (kind IN ('save', 'status')) AS status, max(ts) FILTER (seq = start) AS date_saved,
   arg_min(ts, seq) FILTER (kind IN ('save', 'status') AND status = 'applied') AS date_applied,
   coalesce(arg_max(coalesce(notes, ''), seq) FILTER (kind = 'notes' OR (kind = 'save' AND notes <> '')), '') AS notes,
   coalesce(arg_max(cover_letter, seq) FILTER (kind = 'save' AND cover_letter <> ''), '') AS cover_letter,
   arg_max(ts, seq) AS updated_at FROM begun WHERE seq >= start GROUP BY job_url)"""


@query("tracker_fold", TRACKER_SQL + " SELECT * FROM applications")
def tracker_fold(spark, sf):
    return TR.fold(events(spark, sf))


@query("tracker_fold_stored", TRACKER_SQL + " SELECT * FROM applications")
def tracker_fold_stored(spark, sf):
    """The earlier half of the log folded and stored, the later events joined to that."""
    from vacancia.session import TableSpool

    log = events(spark, sf)
    half = log.agg(F.avg("seq")).scalar()
    stored = TableSpool(spark, "tracker").cut(TR.fold_state(log.where(F.col("seq") <= half)), "state")
    return TR.applications(TR.fold_state(log.where(F.col("seq") > half), stored))


@query("tracker_status_update", TRACKER_SQL + " SELECT job_url, status, date_applied, updated_at FROM applications")
def tracker_status_update(spark, sf):
    return TR.fold(events(spark, sf)).select("job_url", "status", "date_applied", "updated_at")


@query("tracker_notes_update", TRACKER_SQL + " SELECT job_url, notes, updated_at FROM applications")
def tracker_notes_update(spark, sf):
    return TR.fold(events(spark, sf)).select("job_url", "notes", "updated_at")


@query("tracker_delete", TRACKER_SQL + " SELECT job_url, title, date_saved FROM applications")
def tracker_delete(spark, sf):
    return TR.fold(events(spark, sf)).select("job_url", "title", "date_saved")


@query("tracker_validate", f"WITH {EVENTS_SQL} SELECT seq, status FROM log WHERE kind IN ('save', 'status') AND status = 'bogus'")
def tracker_validate(spark, sf):
    return TR.rejected_events(events(spark, sf)).select("seq", "status")


@query("win_latest_status", TRACKER_SQL + " SELECT job_url, status FROM applications")
def win_latest_status(spark, sf):
    return TR.fold(events(spark, sf)).select("job_url", "status")


@query("agg_tracker_stats", TRACKER_SQL + " SELECT status, count(*) AS n FROM applications GROUP BY status UNION ALL SELECT 'total', count(*) FROM applications")
def agg_tracker_stats(spark, sf):
    return SU.tracker_stats(TR.fold(events(spark, sf)))


@query("topk_tracker", TRACKER_SQL + " SELECT job_url, status, updated_at FROM applications ORDER BY updated_at DESC, job_url LIMIT 20")
def topk_tracker(spark, sf):
    return OR.latest_applications(TR.fold(events(spark, sf))).select("job_url", "status", "updated_at")


def _urls_of(spark, sf):
    """Postings whose URL is one that events track, for some."""
    url = F.concat(F.lit("https://jobs.example.com/"), (F.col("seq") % 400).cast("string"))
    return jobs(spark, sf).select("seq", url.alias("job_url"))


@query("join_tracker_status", TRACKER_SQL + " SELECT doc_id AS seq, d.job_url, status AS application_status, date_applied FROM (SELECT doc_id, 'https://jobs.example.com/' || (doc_id % 400) AS job_url FROM documents) d LEFT JOIN applications a ON a.job_url = d.job_url")
def join_tracker_status(spark, sf):
    return TR.with_application(_urls_of(spark, sf), TR.fold(events(spark, sf))).select("seq", "job_url", "application_status", "date_applied")


@query("join_bookmarks", "SELECT doc_id AS seq FROM documents WHERE 'https://jobs.example.com/' || (doc_id % 400) IN (SELECT 'https://jobs.example.com/' || user_id FROM events WHERE event_type = 'purchase')")
def join_bookmarks(spark, sf):
    marks = table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("https://jobs.example.com/"), F.col("user_id").cast("string")).alias("job_url")
    )
    return TR.bookmarked(_urls_of(spark, sf), marks).select("seq")


@query("agg_monthly_usage", "SELECT month, used, greatest(100 - used, 0) AS remaining FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY 1)")
def agg_monthly_usage(spark, sf):
    return SU.monthly_usage(table(spark, sf, "events"))


