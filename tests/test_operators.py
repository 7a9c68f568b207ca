"""Operators on small inputs with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacancia import fixed_values as V
from vacancia.functions import language as L, responses as R
from vacancia.operators import filters as FL, lookup, normalize as NO, ordering as OR, search as SE, summaries as SU, tracker as TR
from vacancia.schema import POSTING_FIELDS, conform_schema, empty_postings

AS_OF = dt.datetime(2024, 7, 8, 12)


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


def test_date_filter(rows):
    df = rows("seq int, date_posted string", (1, None), (2, ""), (3, "2024-07-01"), (4, "2024-06-30"), (5, "yesterday"))
    assert seqs(FL.by_date(df, 168, AS_OF)) == [1, 2, 3, 5]
    assert seqs(FL.by_date(df, 0, AS_OF)) == seqs(FL.by_date(df, 8760, AS_OF)) == [1, 2, 3, 4, 5]


def test_language_filter(rows):
    df = rows(
        "seq int, language_required string, language string, description string",
        (1, "English", None, None), (2, "English (German plus)", None, None), (3, "German", None, None),
        (4, "unknown", None, "x" * 49), (5, "unknown", None, "x" * 50), (6, None, "French", None), (7, "", None, None),
    )
    assert seqs(FL.by_required_language(df, "English")) == [1, 2, 4, 7]
    assert seqs(FL.by_required_language(df, "English (German plus)")) == [2]
    assert seqs(FL.by_required_language(df, "German")) == [2, 3]
    assert seqs(FL.by_required_language(df, "French")) == [4, 5, 6, 7]
    assert seqs(FL.by_required_language(df, "All")) == seqs(FL.by_required_language(df, None)) == list(range(1, 8))


def test_location_scope(rows):
    df = rows(
        "seq int, title string, location string, is_remote boolean",
        (1, "a", "Remote - USA", None), (2, "a", "Remote", None), (3, "a", "Remote - EU", None), (4, "a", None, None),
        (5, "a", "X", None), (6, "a", "Hamburg", False), (7, "a", "Pune", None), (8, "a", "Wilmington, Delaware", None),
        (9, "a", "Lyon", None), (10, "a", "Lyon", True), (11, "remote a", "Lyon", None), (12, "a", "us only", True), (13, "a", "Delhi, IN", None),
    )
    always = [2, 3, 4, 5, 8, 10, 11]
    assert seqs(FL.by_location_scope(df, ["Germany"])) == sorted(always + [6])
    assert seqs(FL.by_location_scope(df, ["India"])) == sorted(always + [7, 13])
    assert seqs(FL.by_location_scope(df, ["France", "Italy"])) == sorted(always + [6, 7, 9, 13])
    assert seqs(FL.by_location_scope(df, [])) == list(range(1, 14))


def test_search(rows):
    df = rows(
        "seq int, title string, description string, tags string",
        (1, "Senior Product Owner", None, ""), (2, "Product", "the owner", ""), (3, "Cook", "a product for an owner", ""),
        (4, "Cook", "nothing", "owner product"), (5, None, None, None),
    )
    assert seqs(SE.all_words(df, ["Product Owner"])) == [1, 3]
    assert seqs(SE.any_word(df, "Product Owner")) == [1, 2, 3]
    assert seqs(SE.tagged(df, [" product owner "], F.col("tags"))) == [1, 2, 3, 4]
    assert seqs(SE.all_words(df, [])) == seqs(SE.any_word(df, "")) == [1, 2, 3, 4, 5]
    assert seqs(SE.any_word(df, " ")) == []


def test_normalize(rows):
    df = rows(
        "seq int, title string, job_url string, location string, salary_min string, salary_max string, is_remote int, source string, extra string",
        (1, "  Product   Owner ", " https://x ", "berlin,  germany", "50000", "not-a-number", 1, " Indeed ", "dropped"),
        (2, "   ", "https://x", None, None, None, None, None, None),
        (3, "PO", None, None, None, None, None, None, None),
        (4, "PO", "https://y", "Berlin, USA", None, None, 0, None, None),
    )
    out = {r["seq"]: r for r in NO.normalize_postings(df).collect()}
    assert sorted(out) == [1, 4]
    assert list(NO.normalize_postings(df).columns) == ["seq", *POSTING_FIELDS]
    a = out[1]
    assert (a["title"], a["job_url"], a["location"], a["source"]) == ("Product Owner", "https://x", "Berlin, Germany", "indeed")
    assert (a["salary_min"], a["salary_max"], a["is_remote"], out[4]["is_remote"], out[4]["location"]) == (50000.0, None, True, False, "Berlin, USA")
    assert seqs(NO.rejected_rows(df)) == [2, 3]


def test_empty_input(spark):
    assert NO.normalize_postings(empty_postings(spark)).count() == 0
    assert SU.key_figures(empty_postings(spark)).first()["total_jobs"] == 0


def test_lenient_json(rows):
    df = rows(
        "i int, t string", (1, '{"a": 1}'), (2, '```json\n{"a": 1}\n```'), (3, "```\n[1]\n```"), (4, 'Here: {"a": 1}'), (5, "[1, 2]"), (6, ""),
        (7, "no json"), (8, '{"a": '), (9, '{"a": 1} trailing'), (10, '  {"a": 1}  '), (11, 'say {"a": 1} and [2'),
    )
    got = dict(df.select("i", R.extract_json(F.col("t")).cast("string")).collect())
    one = '{"a":1}'
    assert got == {1: one, 2: one, 3: "[1]", 4: one, 5: "[1,2]", 6: None, 7: None, 8: None, 9: one, 10: one, 11: one}


def test_unfenced_json(rows):
    df = rows("i int, t string", (1, '```json\n{"a": 1}\n```'), (2, '{"a": 1}'), (3, 'x {"a": 1}'), (4, None), (5, "```\n[1]"))
    got = dict(df.select("i", R.unfenced_json(F.col("t")).cast("string")).collect())
    assert got == {1: '{"a":1}', 2: '{"a":1}', 3: None, 4: None, 5: "[1]"}


def test_global_index(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") * 7 % 13).alias("m")).repartition(5)
    got = {r["seq"]: r["row_index"] for r in OR.global_index(df, major=F.col("m")).collect()}
    order = sorted(range(1000), key=lambda i: (-(i * 7 % 13), i))
    assert [got[i] for i in order] == list(range(1000))


def test_lookup_with_a_hot_key_and_missing_keys(spark):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        want = sorted((r["id"], r["k"], r["v"]) for r in left.join(right, "k", how).collect())
        got = sorted((r["id"], r["k"], r["v"]) for r in lookup.join_unique(left, right, "k", how).collect())
        assert got == want


def fold_one_by_one(events):
    table = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["kind"] in ("save", "status") and e["status"] not in V.TRACKER_STATUSES:
            continue
        url, row = e["job_url"], table.get(e["job_url"])
        if e["kind"] == "delete":
            table.pop(url, None)
        elif e["kind"] == "save" and row is None:
            table[url] = {
                "title": e["title"] or "", "company": e["company"] or "", "location": e["location"] or "", "status": e["status"], "date_saved": e["ts"],
                "date_applied": e["ts"] if e["status"] == "applied" else None, "notes": e["notes"] or "", "cover_letter": e["cover_letter"] or "", "updated_at": e["ts"],
            }
        elif row is not None:
            row["updated_at"] = e["ts"]
            if e["kind"] in ("save", "status"):
                row["status"] = e["status"]
                if e["status"] == "applied" and not row["date_applied"]:
                    row["date_applied"] = e["ts"]
            if e["kind"] == "save":
                row["notes"] = e["notes"] or row["notes"]
                row["cover_letter"] = e["cover_letter"] or row["cover_letter"]
            if e["kind"] == "notes":
                row["notes"] = e["notes"] or ""
    return table


def test_tracker_fold(spark):
    rnd = random.Random(5)
    events = [
        {
            "seq": i, "job_url": f"u{rnd.randint(1, 12)}", "kind": rnd.choice(["save", "save", "status", "notes", "delete"]),
            "status": rnd.choice(V.TRACKER_STATUSES + ["bad"]), "notes": rnd.choice([None, "", f"n{i}"]), "cover_letter": rnd.choice(["", f"l{i}"]),
            "title": f"t{i}", "company": "c", "location": None, "ts": f"2024-01-01T{i:06d}",
        }
        for i in range(400)
    ]
    schema = "seq long, job_url string, kind string, status string, notes string, cover_letter string, title string, company string, location string, ts string"
    df = spark.createDataFrame([tuple(e.values()) for e in events], schema).repartition(4)
    got = {r["job_url"]: {k: v for k, v in r.asDict().items() if k != "job_url"} for r in TR.fold(df).collect()}
    assert got == fold_one_by_one(events)
    stats = dict(SU.tracker_stats(TR.fold(df)).collect())
    assert stats["total"] == len(got) == sum(n for s, n in stats.items() if s != "total")


def test_languages_of_given_texts(spark):
    """Share of documents whose language is found; not the claim of any library's results."""
    names = F.create_map(*[F.lit(x) for code in ("en", "de", "fr", "es") for x in (code, V.LANGUAGE_NAMES[code])])
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        (L.listing_language(F.col("text")) == names[F.col("lang")]).alias("right")
    )
    assert df.agg(F.avg(F.col("right").cast("int"))).first()[0] > 0.9


def test_partitioning_does_not_matter(spark):
    from catalog.base import jobs
    from vacancia.operators.resolve import resolve_exact

    df = conform_schema(jobs(spark, "/root/testdata/sf0.001"))
    plain = lambda d: sorted(map(str, resolve_exact(d).collect()))
    assert plain(df.repartition(1)) == plain(df.repartition(7, "title"))


@pytest.mark.parametrize("master, named, ok", [("local[2]", None, True), ("yarn", "hdfs://x/y/", True), ("yarn", None, False), ("local", None, True), ("local-cluster[2,1,1024]", None, False)])
def test_working_folder(master, named, ok):
    from vacancia.session import working_folder

    class Context:
        folder = None

        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return named

    if ok:
        assert working_folder(Session()) == "hdfs://x/y" if named else working_folder(Session())
    else:
        with pytest.raises(RuntimeError):
            working_folder(Session())


def test_positions_of_a_sorted_frame_need_one_exchange(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("2024-01-0"), (F.col("id") % 7 + 1).cast("string"))).alias("date_posted"))
    ordered = OR.newest_first(df.repartition(5))
    assert ordered._jdf.queryExecution().executedPlan().toString().count("rangepartitioning") == 1
    got = sorted((r.row_index, r.seq) for r in OR.with_positions(ordered).collect())
    want = sorted(df.collect(), key=lambda r: (-int((r.date_posted or "0000-00-00").replace("-", "")), r.seq))
    assert got == list(enumerate(r.seq for r in want))
    assert OR.with_positions(OR.newest_first(df.limit(0))).count() == 0


def test_tracker_parts_give_what_the_whole_log_gives(spark):
    import random

    rng = random.Random(5)
    kinds = ["save", "status", "notes", "delete", "status"]
    texts = ["", None, "a", "b", "c"]
    log = [
        (i, rng.choice(["u", "v", "w", "x", "y", "z", None]) if i % 50 else f"only {i}", rng.choice(kinds), rng.choice([*V.TRACKER_STATUSES, "bogus", None]),
         rng.choice(texts), rng.choice(texts), f"t{i}", rng.choice(texts), rng.choice(texts), rng.choice([None, f"2024-01-01T{i:05d}"]))
        for i in range(400)
    ]
    shape = "seq long, job_url string, kind string, status string, notes string, cover_letter string, title string, company string, location string, ts string"
    frame = lambda part: spark.createDataFrame(part, shape)
    # the rule, event by event
    for cuts in ([0, 400], [0, 130, 131, 300, 400]):
        state = None
        for start, stop in zip(cuts, cuts[1:]):
            # a part that overlaps with what was applied changes nothing
            state = TR.fold_state(frame(log[max(0, start - 40) : stop]), state)
            state = spark.createDataFrame(state.collect(), state.schema)
        got = {r.job_url: r[1:] for r in TR.applications(state).collect()}
        want = {}
        for seq, url, kind, status, notes, letter, title, company, location, ts in log:
            if url is None or kind in ("save", "status") and status not in V.TRACKER_STATUSES:
                continue
            if kind == "delete":
                want.pop(url, None)
                continue
            if url not in want:
                if kind != "save":
                    continue
                want[url] = [title, company or "", location or "", ts, None, None, "", "", None, False]
            row = want[url]
            if kind in ("save", "status"):
                row[4] = status
                if status == "applied" and not row[9]:
                    row[5], row[9] = ts, True
            if kind == "notes" or kind == "save" and notes:
                row[6] = notes or ""
            if kind == "save" and letter:
                row[7] = letter
            row[8] = ts
        assert got == {url: tuple(row[:9]) for url, row in want.items()} and len(got) > 3
    assert TR.fold(frame([])).count() == 0
