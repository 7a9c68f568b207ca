"""Application status as a fold over a log of events.

Events ``(seq, job_url, kind, status, notes, cover_letter, title, company, location, ts)``
with kind save, status, notes or delete. The fold uses aggregations only: no event list of a
URL is ever brought together, however many events it has. Its state can be stored, and a day's
events join yesterday's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import blank_to_null
from .lookup import join_unique


def valid_events(events: DataFrame) -> DataFrame:
    """Events that may be applied: a save or status change must name one of the statuses."""
    sets_status = F.col("kind").isin("save", "status")
    ok = ~sets_status | F.coalesce(F.col("status").isin(V.TRACKER_STATUSES), F.lit(False))
    return events.filter(ok)


def rejected_events(events: DataFrame) -> DataFrame:
    return events.filter(
        F.col("kind").isin("save", "status")
        & ~F.coalesce(F.col("status").isin(V.TRACKER_STATUSES), F.lit(False))
    )


#: What an application shows; the first four come from the save that started it.
START_FIELDS = ("title", "company", "location", "date_saved")
FIELDS = (*START_FIELDS, "status", "date_applied", "notes", "cover_letter", "updated_at")


def _marks(events: DataFrame) -> DataFrame:
    """Events without their texts: what decides which event gives a field."""
    sets_status = F.col("kind").isin("save", "status")
    is_save = F.col("kind") == "save"
    return events.select(
        "job_url",
        "seq",
        is_save.alias("saves"),
        (F.col("kind") == "delete").alias("deletes"),
        sets_status.alias("sets_status"),
        (sets_status & (F.col("status") == "applied")).alias("applies"),
        ((F.col("kind") == "notes") | (is_save & (F.length("notes") > 0))).alias("sets_notes"),
        (is_save & (F.length("cover_letter") > 0)).alias("sets_letter"),
    )


def fold_state(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per URL that events name: the application as of its ``last_seq``, to be stored and gone on from.

    With ``stored``, the state of all earlier events, only the later ones are given; of those, events
    up to a URL's stored ``last_seq`` were applied already and change nothing, so a part may be given
    twice. Rows whose ``started`` is null have no application; they keep ``last_seq`` of what was
    deleted. URLs without later events stay as stored. Events without URL have no effect.

    Which event gives a field is found by aggregates over row numbers; texts move only for the events that
    give one, at most six of a URL.
    """
    events = valid_events(events).filter(F.col("job_url").isNotNull())
    marks = _marks(events)
    if stored is not None:
        known = stored.select("job_url", F.col("last_seq").alias("_after"), F.col("started").alias("_running"))
        marks = marks.join(known, "job_url", "left").filter(F.col("_after").isNull() | (F.col("seq") > F.col("_after")))
    else:
        marks = marks.withColumn("_running", F.lit(None).cast("long"))
    heads = marks.groupBy("job_url").agg(
        F.max("seq").alias("last_seq"), F.max(F.when(F.col("deletes"), F.col("seq"))).alias("deleted")
    )
    alive = marks.filter(~F.col("deletes")).join(heads.drop("last_seq"), "job_url", "left").filter(
        F.col("deleted").isNull() | (F.col("seq") > F.col("deleted"))
    )
    # an application that runs goes on unless it was deleted; others start with their first save
    begins = F.when(F.col("deleted").isNull(), F.max("_running"))
    started = alive.groupBy("job_url", "deleted").agg(
        F.coalesce(begins, F.min(F.when(F.col("saves"), F.col("seq")))).alias("started")
    )
    effective = alive.drop("deleted").join(started.drop("deleted"), "job_url").filter(
        F.col("seq") >= F.col("started")
    )
    last = lambda name: F.max(F.when(F.col(name), F.col("seq")))
    givers = effective.groupBy("job_url").agg(
        F.min("started").alias("started"),
        last("sets_status").alias("_status"),
        F.min(F.when(F.col("applies"), F.col("seq"))).alias("applied_seq"),
        last("sets_notes").alias("_notes"),
        last("sets_letter").alias("_letter"),
        F.max("seq").alias("_updated"),
    )
    by_giver = {
        "title": ("started", F.coalesce("title", F.lit(""))),
        "company": ("started", F.coalesce("company", F.lit(""))),
        "location": ("started", F.coalesce("location", F.lit(""))),
        "date_saved": ("started", F.col("ts")),
        "status": ("_status", F.col("status")),
        "date_applied": ("applied_seq", F.col("ts")),
        "notes": ("_notes", F.coalesce("notes", F.lit(""))),
        "cover_letter": ("_letter", F.col("cover_letter")),
        "updated_at": ("_updated", F.col("ts")),
    }
    numbers = ["started", "_status", "applied_seq", "_notes", "_letter", "_updated"]
    texts = events.join(givers, "job_url").filter(F.col("seq").isin(*[F.col(n) for n in numbers]))
    given = texts.groupBy("job_url", *numbers).agg(
        *[F.max(F.when(F.col("seq") == F.col(giver), value)).alias(name) for name, (giver, value) in by_giver.items()]
    )
    new = heads.join(given, "job_url", "left")
    columns = ["job_url", "last_seq", "started", "applied_seq", *FIELDS]
    if stored is None:
        return new.select(*columns)

    both = stored.alias("s").join(new.alias("n"), "job_url", "full_outer")
    # what is stored counts unless a later deletion wiped it out
    holds = F.col("s.started").isNotNull() & F.col("n.deleted").isNull()
    held = lambda name: F.when(holds, F.col(f"s.{name}"))

    def field(name: str) -> Column:
        mine, giver = F.col(f"n.{name}"), F.col(f"n.{by_giver[name][0]}")
        if name in START_FIELDS:
            return F.when(holds, F.col(f"s.{name}")).otherwise(mine)
        if name == "date_applied":
            return F.when(holds & F.col("s.applied_seq").isNotNull(), F.col(f"s.{name}")).otherwise(mine)
        return F.when(giver.isNotNull(), mine).otherwise(held(name))

    return both.select(
        "job_url",
        F.coalesce("n.last_seq", "s.last_seq").alias("last_seq"),
        F.coalesce(held("started"), F.col("n.started")).alias("started"),
        F.coalesce(held("applied_seq"), F.col("n.applied_seq")).alias("applied_seq"),
        *[field(name).alias(name) for name in FIELDS],
    )


def applications(state: DataFrame) -> DataFrame:
    """Current applications, one per URL, of a state."""
    filled = {"notes": F.coalesce("notes", F.lit("")), "cover_letter": F.coalesce("cover_letter", F.lit(""))}
    return state.filter(F.col("started").isNotNull()).select(
        "job_url", *[filled.get(name, F.col(name)).alias(name) for name in FIELDS]
    )


def fold(events: DataFrame) -> DataFrame:
    """Current applications, one per URL.

    A URL's history starts over with the first save after its last deletion; what lies before
    has no effect. Title, company and location are those of that save. Blank notes and letters
    of a save keep the old ones, a notes event replaces them by whatever it says.
    """
    return applications(fold_state(events))


def with_application(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """Postings with the status of their application, null if there is none."""
    applied = applications.select("job_url", F.col("status").alias("application_status"), "date_applied")
    return join_unique(postings, applied, "job_url")


def bookmarked(postings: DataFrame, bookmarks: DataFrame) -> DataFrame:
    return postings.join(bookmarks.select("job_url"), "job_url", "left_semi")


def save_events(postings: DataFrame, status: str = "saved") -> DataFrame:
    """Events that save postings to the tracker."""
    if status not in V.TRACKER_STATUSES:
        raise ValueError(f"not a status: {status}")
    return postings.select(
        "seq", "job_url", F.lit("save").alias("kind"), F.lit(status).alias("status"),
        F.lit("").alias("notes"), F.lit("").alias("cover_letter"),
        F.coalesce(blank_to_null(F.col("title")), F.lit("")).alias("title"),
        F.coalesce(F.col("company"), F.lit("")).alias("company"),
        F.coalesce(F.col("location"), F.lit("")).alias("location"),
    )
