"""Duplicate resolution against its rule, row by row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import resolution_rule as rule
from vacancia.operators import resolve as RS
from vacancia.session import TableSpool

SCHEMA = (
    "seq long, source string, ats_platform string, title string, company string, location string, country string, "
    "date_posted string, job_type string, experience_level string, is_remote boolean, salary_min double, salary_max double, "
    "job_url string, company_url string, description string"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["senior", "sr.", "product", "owner", "manager", "data", "engineer", "dev", "berlin", "digital", "lead"]
    names = ["acme", "acme labs", "acme lab", "northwind traders", "northwind trader", "nordwind traders", "contoso", "contosa",
             "fabrikam systems", "fabrikam system", "fabricam systems", "x", "xy"]
    rows = []
    for i in range(n):
        title = " ".join(rnd.sample(words, rnd.randint(1, 4))) + rnd.choice(["", "", " (m/w/d)", "s"])
        company = rnd.choice(names) + rnd.choice(["", " GmbH", " Inc."])
        some = lambda v: v if rnd.random() < 0.6 else None
        rows.append((
            i * 3 + 1, some(rnd.choice(["indeed", "greenhouse", "lever", "a + b", "linkedin"])), "lever" if rnd.random() < 0.1 else None,
            title, None if rnd.random() < 0.05 else company, some("Berlin"), some("Germany"), some("2024-01-01"), some("fulltime"),
            some("senior"), some(rnd.random() < 0.5), some(float(rnd.randint(0, 3))), some(1.0),
            rnd.choice(["https://x.com/%d" % rnd.randint(0, n // 2), "https://x.com/%d/?q" % rnd.randint(0, n // 2), None if rnd.random() < 0.5 else "  ",
                        "https://y.com/%d" % i]),
            some("https://c.com"), some("d" * rnd.choice([5, 400, 501, 900, 2001, 2500]) + str(rnd.randint(0, 2))),
        ))
    return rows


KEYS = ["seq", "norm_url", "norm_title", "norm_company", "dup_key"]


def led(spark, df, fuzzy):
    """(keys, leaders) by seq."""
    keyed = RS.with_keys(df).select(*KEYS)
    leaders = RS.assign_leaders(keyed, fuzzy, TableSpool(spark, "test"))
    return {r["seq"]: r.asDict() for r in keyed.collect()}, dict(leaders.collect())


@pytest.mark.parametrize("fuzzy", [False, True])
def test_leaders_and_merged_rows_follow_the_rule(spark, fuzzy):
    rows = random_rows(7, 260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "title")
    keyed, leaders = led(spark, df, fuzzy)
    assert len(leaders) == len(rows) and rule.wrong_leaders(keyed, leaders, fuzzy) == []
    groups = {}
    for row in sorted(rows):
        groups.setdefault(leaders[row[0]], []).append(dict(zip(NAMES, row)))
    assert max(map(len, groups.values())) > 2
    got = {r["seq"]: {n: r[n] for n in NAMES[1:]} for r in RS.resolve(df, fuzzy).collect()}
    assert sorted(got) == sorted(groups)
    for seq, group in groups.items():
        assert got[seq] == rule.merged(group, NAMES[1:]), seq


def test_small_fronts_take_more_rounds_to_the_same_end(spark, monkeypatch):
    monkeypatch.setattr(RS, "FIRST_FRONT", 2)
    monkeypatch.setattr(RS, "LARGEST_FRONT", 3)
    keyed, leaders = led(spark, spark.createDataFrame(random_rows(11, 200), SCHEMA), True)
    assert rule.wrong_leaders(keyed, leaders, True) == []


def test_no_chaining(spark):
    """A~B by title, B~C by URL, A and C unlike: C stays on its own."""
    rows = [(1, "Product Owner", "Acme", "https://x/1"), (2, "Product Owner", "Acme", "https://x/2"), (3, "Cook", "Diner", "https://x/2")]
    df = spark.createDataFrame(rows, "seq long, title string, company string, job_url string")
    keyed = RS.with_keys(df).select("seq", "norm_url", "norm_title", "norm_company", "dup_key")
    got = dict(RS.assign_leaders(keyed, False, TableSpool(spark, "test")).collect())
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_key_holds_most_rows(spark):
    """A third of the rows share a URL, another third a key; all merge into two rows."""
    n = 3000
    hot = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 1, "Product Owner").otherwise(F.concat(F.lit("Job "), F.col("id").cast("string"))).alias("title"),
        F.when(F.col("id") % 3 == 1, "Acme").alias("company"),
        F.when(F.col("id") % 3 == 0, "https://x/1").otherwise(F.concat(F.lit("https://y/"), F.col("id").cast("string"))).alias("job_url"),
    )
    from vacancia.schema import conform_schema

    got = RS.resolve(conform_schema(hot), fuzzy=True)
    sizes = sorted(r["n_merged"] for r in got.select("n_merged").collect())
    assert sizes == [1] * (n // 3) + [n // 3, n // 3]


def test_similar_names_share_a_token(spark):
    """Whatever two names are similar, their tokens meet."""
    rnd = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choices("abcd ", k=rnd.randint(1, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            place = rnd.randrange(len(b) + 1)
            if rnd.random() < 0.5:
                b.insert(place, rnd.choice("abcd"))
            elif b and place < len(b):
                del b[place]
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", F.arrays_overlap(RS.company_tokens(F.col("a")), RS.company_tokens(F.col("b"))).alias("meet")
    )
    similar = [r for r in df.collect() if r["b"] and rule.alike(r["a"], r["b"], 90)]
    assert len(similar) > 100 and all(r["meet"] for r in similar)


def test_empty(spark):
    from vacancia.schema import empty_postings

    assert RS.resolve(empty_postings(spark)).count() == 0


def test_many_unlike_titles_of_one_company_take_one_round(spark, monkeypatch):
    """Rounds do not grow with a company: what is unlike is settled by its pairs."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    titles = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 4))) for _ in range(900)})
    titles += [t + "x" for t in titles[:20]]
    rows = [(i, t, "Acme" if i % 9 else "Acme Labs", f"https://x.com/{i}") for i, t in enumerate(titles)]
    calls = []
    whole = RS._round
    monkeypatch.setattr(RS, "_round", lambda *a: calls.append(1) or whole(*a))
    keyed, leaders = led(spark, spark.createDataFrame(rows, "seq long, title string, company string, job_url string"), True)
    assert len(calls) <= 2
    near = [s for s in keyed if leaders[s] != s]
    assert len(near) >= 20
    assert [s for s in rnd.sample(sorted(keyed), 25) + near[:10] if rule.rightful_leader(s, keyed, {x for x, y in leaders.items() if x == y}, True) != leaders[s]] == []


@pytest.mark.parametrize("fuzzy", [False, True])
def test_new_rows_join_stored_ones_by_the_rule(spark, fuzzy):
    rows = random_rows(23, 160)
    whole = spark.createDataFrame(rows, SCHEMA)
    stored = RS.resolve(whole.where("seq < 240"), fuzzy).drop("n_merged")
    new = whole.where("seq >= 240")
    keyed = {r["seq"]: r.asDict() for r in RS.with_keys(stored.unionByName(new)).select(*KEYS).collect()}
    spool = TableSpool(spark, "test")
    parts = [RS.with_keys(df).select(*KEYS) for df in (stored, new)]
    leaders = dict(RS.assign_new(*parts, fuzzy, spool).collect())
    known = {s for s in keyed if s < 240}
    heads = known | {s for s, leader in leaders.items() if s == leader}
    assert {s for s in leaders} == {s for s in keyed if s >= 240}
    assert [s for s in leaders if leaders[s] != rule.rightful_leader(s, keyed, heads, fuzzy)] == []
    assert any(leader in known for leader in leaders.values())
    groups = {s: [] for s in heads}
    for r in sorted(stored.unionByName(new).collect()):
        groups[leaders.get(r["seq"], r["seq"])].append(r.asDict())
    got = {r["seq"]: {n: r[n] for n in NAMES[1:]} for r in RS.resolve_new(stored, new, fuzzy).collect()}
    assert sorted(got) == sorted(groups)
    for seq, group in groups.items():
        assert got[seq] == rule.merged(group, NAMES[1:]), seq


def test_nothing_new(spark):
    stored = spark.createDataFrame(random_rows(3, 30), SCHEMA)
    got = RS.resolve_new(stored, stored.where("false")).collect()
    assert sorted(r["seq"] for r in got) == sorted(r["seq"] for r in stored.collect())


def test_a_word_of_many_names_does_not_bring_them_together(spark, monkeypatch):
    """Names meet under their rarest triples; those of a word that most names have come last."""
    rnd = random.Random(12)
    names = {"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(6, 9))) + " labs" for _ in range(300)}
    names |= {name[:-1] for name in sorted(names)[:20]} | {"labs labs labs", "labs labs lab", "a", "abcdefgh", "abcdefghi"}
    cuts = {}

    def cut(spool, df, name, write=TableSpool.cut):
        cuts[name] = write(spool, df, name)
        return cuts[name]

    monkeypatch.setattr(TableSpool, "cut", cut)
    found = RS.company_circles(spark.createDataFrame([(n,) for n in names], "norm_company string"), TableSpool(spark, "test"))
    got = {(c["circle"], r["norm_company"]) for r in found.collect() for c in r["circles"]}
    assert got == {(a, b) for a in names for b in names if a == b or (a < b and rule.alike(a, b, 90))}
    assert len(got) >= len(names) + 20
    assert cuts["names"].groupBy("token").count().agg(F.max("count")).first()[0] < 60


def test_places_are_chosen_before_languages_are_detected(spark, monkeypatch):
    from vacancia.plans import search

    rows = random_rows(41, 60)
    cuts = {}

    def cut(spool, df, name, write=TableSpool.cut):
        cuts[name] = write(spool, df, name)
        return cuts[name]

    monkeypatch.setattr(TableSpool, "cut", cut)
    feeds = spark.createDataFrame(rows, SCHEMA).withColumn("location", F.when(F.col("seq") % 2 == 0, "Oslo, Norway").otherwise("Berlin")).withColumn("is_remote", F.lit(False)).withColumn("title", F.lit("Owner")).withColumn("job_url", F.concat(F.lit("https://x.com/"), F.col("seq").cast("string")))
    options = search.SearchOptions(as_of=dt.datetime(2024, 7, 1), locations=["Germany"])
    search.resolved_search(feeds, options).collect()
    assert {r["location"] for r in cuts["classified"].collect()} == {"Berlin"}
