"""Duplicate resolution: who is a duplicate of whom, and what the merged row holds.

Rule. Rows are taken in ``seq`` order. A row joins the earlier *leader* that has its URL, else
the one that has its title-and-company key, else the earliest leader with a similar key;
otherwise it becomes a leader. Only leaders are compared against, so A~B and B~C do not put A
and C together: this is the first maximal independent set in ``seq`` order, not a set of
connected components.

How it runs. Everything two duplicates can share is a *token*: the URL, the key and, for
similar keys, a *circle* of companies together with a class of title lengths. Companies are
compared first, each distinct name once: a circle is one name and the names similar to it that
come after it, so any two rows of similar companies meet in exactly one circle and class. What a
title looks like is a *signature* of its letters, two numbers; rows that meet are told apart by
lengths and signatures within the join, and only what passes is read as text.

Rows that have many duplicates go in rounds. In each round

* the first rows of each token (at most ``front`` of them, kept per map task before the
  shuffle) are compared with one another; a row that is among the first of *all* its tokens
  and has no earlier undecided duplicate there is a leader, since no other row can precede it;
* undecided rows that share a token with a new leader are compared with it, and duplicates
  leave.

A round writes pairs of a row with at most ``front`` others per token, also for a token that holds a
third of the table. Once a round decides little, few rows are alike. Then all pairs that are left are
written once, and leaders follow from the pairs alone: in each step rows without an undecided
earlier duplicate lead, and their duplicates leave. So neither rounds nor written pairs grow with the
unlike titles of a company; what does is the number of signatures compared. There is no cap on rounds,
candidates or group sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import keys as K
from ..functions.similarity import may_be_similar, signature, similar, sort_tokens
from ..functions.text import blank_to_null
from ..session import TableSpool
from .lookup import join_unique
from .summaries import source_parts

FIRST_FRONT = 256
LARGEST_FRONT = 512  # Spark keeps the first rows per map task up to 1000 of them
PART_ROWS = 2048  # rows of one token that are met at a time
#: After a round that decides less than this share of what was undecided, all pairs are written.
FEW = 0.1


def with_keys(df: DataFrame) -> DataFrame:
    """Add ``norm_url``, ``norm_title``, ``norm_company`` and ``dup_key``; blanks are null."""
    return (
        df.withColumns(
            {
                "norm_url": blank_to_null(K.normalize_url(F.col("job_url"))),
                "norm_title": blank_to_null(K.normalize_title(F.col("title"))),
                "norm_company": blank_to_null(K.normalize_company(F.col("company"))),
            }
        ).withColumn("dup_key", K.title_company_key(F.col("norm_title"), F.col("norm_company")))
    )


def first_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """(seq, first_seq) of every later row that shares a key with an earlier one.

    Each row is paired with the first holder of its key only, never with all of them.
    """
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("first_seq"))
    return (
        join_unique(df.select("seq", key), firsts, key, "inner")
        .filter(F.col("first_seq") < F.col("seq"))
        .select("seq", "first_seq")
    )


# --- tokens ---------------------------------------------------------------------------------


# Two names of at most 19 characters together are similar only if they are equal or one is the
# other with one character more; longer pairs have at least 9 characters each.
_SHORT_NAME, _LONG_NAME, _SHORTEST_UNEQUAL = 10, 9, 6


def _name_and_deletions(company: Column) -> Column:
    """The name itself, and the name without one of its characters."""
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(company)),
        lambda i: F.concat(F.left(company, i - 1), F.substring(company, i + 1, F.length(company))),
    )
    unequal = F.length(company).between(_SHORTEST_UNEQUAL, _SHORT_NAME)
    none = F.array().cast("array<string>")
    return F.concat(F.array(company), F.when(unequal, F.array_distinct(shorter)).otherwise(none))


def _triples(company: Column) -> Column:
    """Numbers for the letter triples of a name; repeated triples are told apart."""
    padded = F.concat(F.lit("\u0002"), company, F.lit("\u0003"))
    triples = F.transform(F.sequence(F.lit(1), F.length(company)), lambda i: F.substring(padded, i, F.lit(3)))
    return F.transform(
        triples,
        lambda triple, i: F.xxhash64(
            triple, F.size(F.filter(F.slice(triples, F.lit(1), i + 1), lambda other: other == triple))
        ),
    )


def _first_triples(company: Column, ordered: Column) -> Column:
    """Letter triples of which any similar name shares at least one, of all in a common order.

    A name of length l turns into a similar one of length m by x deletions and y insertions
    with ``x + y <= q (l + m)`` and ``x - y = l - m``. A deletion destroys at most three triples
    and an insertion two, so 3x + 2y are lost at most; that is largest with deletions alone and
    then is ``6 q l / (1 + q)``. If two names lack at most k of each other's triples, the k + 1
    that come first in any fixed order have one in common.
    """
    q = 100 - V.COMPANY_SIMILARITY
    keep = F.floor(F.length(company) * F.lit(6 * q) / F.lit(100 + q)).cast("int") + 1
    return F.slice(ordered, F.lit(1), keep)


def _rarest_first(names: DataFrame) -> DataFrame:
    """(norm_company, triples) of names with triples, by how many names have each.

    A word that many companies have in their names would else bring all of them together.
    """
    held = names.filter(F.length("norm_company") >= _LONG_NAME).select("norm_company", F.explode(_triples(F.col("norm_company"))).alias("triple"))
    often = held.groupBy("triple").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "triple")))
    counted = join_unique(held, often, "triple", "inner").groupBy("norm_company").agg(ordered.alias("triples"))
    return counted.withColumn("triples", F.col("triples.triple"))


def company_tokens(company: Column, triples: Column | None = None) -> Column:
    """Numbers of which two similar names share at least one, and unlike names rarely do.

    ``triples`` are those of the name in an order that all names share, by default that of a hash.
    """
    none = F.array().cast("array<bigint>")
    short = F.transform(_name_and_deletions(company), lambda text: F.xxhash64(F.lit("name"), text))
    ordered = F.array_sort(_triples(company)) if triples is None else triples
    long = F.transform(_first_triples(company, ordered), lambda triple: F.xxhash64(F.lit("triple"), triple))
    return F.concat(
        F.when(F.length(company) <= _SHORT_NAME, short).otherwise(none),
        F.when(F.length(company) >= _LONG_NAME, long).otherwise(none),
    )


# Titles that are similar differ in length by at most this ratio; a little is added for the
# rounding of logarithms.
_LENGTH_RATIO = (200 - V.TITLE_SIMILARITY) / V.TITLE_SIMILARITY + 0.001
# What a token says of a row: its company gives the circle its name, its title is in the length class, or
# the token is a URL or key.
_HOME, _OWN, _EXACT = 1, 2, 4


def _length_class(size: Column) -> Column:
    """Of two similar titles the longer is in the class of the shorter or in the next one."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(_LENGTH_RATIO))).cast("int")


def company_circles(names: DataFrame, spool: TableSpool) -> DataFrame:
    """(norm_company, circles) for distinct names; a circle is the name that it is called by and whether that
    is the company's own. A name is in the circles of the smaller names that are similar to it, and its own.

    Where ``names`` has a column ``stored``, two stored names are not compared.
    """
    if "stored" not in names.columns:
        names = names.withColumn("stored", F.lit(False))
    signed = names.withColumns({f"s{i}": x for i, x in enumerate(signature(F.col("norm_company")))})
    signed = signed.join(_rarest_first(names), "norm_company", "left")
    held = company_tokens(F.col("norm_company"), F.col("triples"))
    tokens = spool.cut(signed.withColumn("token", F.explode(held)).drop("triples"), "names")
    a, b = (tokens.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("norm_company", "s0", "s1", "stored")]) for side in "ab")
    first, second = F.col("a_norm_company"), F.col("b_norm_company")
    sides = [[F.col(f"{side}_s{i}") for i in range(2)] for side in "ab"]
    near = may_be_similar(*sides, (F.length(first), F.length(second)), V.COMPANY_SIMILARITY)
    some_new = ~(F.col("a_stored") & F.col("b_stored"))
    met = a.join(b, "token").filter((first < second) & some_new & near).select(first, second).distinct()
    alike = spool.cut(met, "near-names").filter(similar(first, second, V.COMPANY_SIMILARITY))
    guests = alike.select(second.alias("norm_company"), first.alias("circle"), F.lit(False).alias("home"))
    own = names.select("norm_company", F.col("norm_company").alias("circle"), F.lit(True).alias("home"))
    circles = own.unionByName(guests).groupBy("norm_company").agg(F.collect_list(F.struct("circle", "home")).alias("circles"))
    return spool.cut(circles, "circles")


# --- leaders --------------------------------------------------------------------------------

_SIDE = ["node", "norm_url", "dup_key", "sorted_title", "size", "s0", "s1", "kind"]


def _token_rows(nodes: DataFrame, circles: DataFrame | None) -> DataFrame:
    """One row per token of each node: token, kind, ``tokens``, their number, and what is compared.

    Rows that meet in a circle are compared if the company of one is at home there and the title of one is
    in its own length class, which holds once for each pair of similar companies and near lengths.
    """
    exact = F.filter(
        F.array(
            F.when(F.col("norm_url").isNotNull(), F.xxhash64(F.lit("url"), "norm_url")),
            F.when(F.col("dup_key").isNotNull(), F.xxhash64(F.lit("key"), "dup_key")),
        ),
        lambda t: t.isNotNull(),
    )
    held = F.transform(exact, lambda t: F.struct(t.alias("token"), F.lit(_EXACT).alias("kind")))
    none = F.lit(0).cast("long")
    if circles is None:
        rows = nodes.withColumn("sorted_title", sort_tokens(F.col("norm_title")))
        rows = rows.withColumns({"size": F.coalesce(F.length("sorted_title"), F.lit(0)), "s0": none, "s1": none, "held": held})
    else:
        # many rows have one title; its letters are looked at once
        titles = nodes.select("norm_title").distinct().withColumn("sorted_title", sort_tokens(F.col("norm_title")))
        first, second = signature(F.col("sorted_title"))
        titles = titles.withColumns({"size": F.length("sorted_title"), "s0": first, "s1": second})
        rows = nodes.join(titles, "norm_title", "left")
        rows = rows.withColumns({"size": F.coalesce("size", F.lit(0)), "s0": F.coalesce("s0", none), "s1": F.coalesce("s1", none)})
        rows = rows.join(circles, "norm_company", "left")

        def in_circle(circle: Column, step: int) -> Column:
            token = F.xxhash64(F.lit("circle"), circle["circle"], _length_class(F.col("size")) + step)
            kind = F.when(circle["home"], _HOME).otherwise(0) + (0 if step else _OWN)
            return F.struct(token.alias("token"), kind.alias("kind"))

        met = F.flatten(F.transform("circles", lambda c: F.array(in_circle(c, 0), in_circle(c, 1))))
        keyed = F.col("dup_key").isNotNull() & F.col("circles").isNotNull()
        rows = rows.withColumn("held", F.when(keyed, F.concat(held, met)).otherwise(held))
    at = rows.withColumn("tokens", F.size("held")).withColumn("at", F.explode("held"))
    return at.withColumns({"token": F.col("at.token"), "kind": F.col("at.kind")}).select("token", "tokens", *_SIDE)


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{prefix}_{c}") for c in _SIDE])


def _duplicates(pairs: DataFrame, fuzzy: bool, spool: TableSpool, *keep: str) -> DataFrame:
    """Of pairs a/b that meet under a token, those that are duplicates; ``keep`` is returned.

    Where rows meet only numbers and equality are tested. What passes is written down before texts are
    compared, so that this is no part of the join.
    """
    same = F.coalesce(F.col("a_norm_url") == F.col("b_norm_url"), F.lit(False)) | F.coalesce(
        F.col("a_dup_key") == F.col("b_dup_key"), F.lit(False)
    )
    if not fuzzy:
        return pairs.filter(same).select(*keep)
    sides = [[F.col(f"{side}_s{i}") for i in range(2)] for side in "ab"]
    may = (F.col("a_kind").bitwiseOR(F.col("b_kind")) == (_HOME | _OWN)) & may_be_similar(
        *sides, (F.col("a_size"), F.col("b_size")), V.TITLE_SIMILARITY
    )
    first, second = F.col("a_sorted_title"), F.col("b_sorted_title")
    possible = spool.cut(pairs.filter(same | may).select(*keep, first, second, same.alias("same")), "possible")
    return possible.filter(F.col("same") | similar(first, second, V.TITLE_SIMILARITY)).select(*keep)


def _meetings(few: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs by token of the a-side ``few`` and the b-side ``many``.

    Rows of ``many`` under a token that has many are dealt out to parts, each of which gets a copy of the
    few; the larger the token, the more parts.
    """
    parts = many.groupBy("token").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
    count = F.coalesce("_parts", F.lit(1))
    dealt = many.join(parts, "token", "left").withColumn("_part", F.pmod(F.xxhash64("b_node", "b_dup_key"), count).cast("int"))
    copies = few.join(parts, "token", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1)))
    return copies.drop("_parts").join(dealt.drop("_parts"), ["token", "_part"])


def _round(live: DataFrame, front: int, fuzzy: bool, spool: TableSpool) -> DataFrame:
    """Nodes that are leaders for sure, given that all their earlier duplicates are decided."""
    rank = F.row_number().over(Window.partitionBy("token").orderBy("node"))
    head = live.withColumn("_rn", rank).filter(F.col("_rn") <= front).drop("_rn")
    complete = (
        head.groupBy("node")
        .agg(F.count("*").alias("_seen"), F.max("tokens").alias("_all"))
        .filter(F.col("_seen") == F.col("_all"))
        .select("node")
    )
    if front == 1:
        return complete
    later = head.join(complete, "node", "left_semi")
    pairs = _side(head, "a").join(_side(later, "b"), "token").filter(F.col("a_node") < F.col("b_node"))
    waiting = _duplicates(pairs, fuzzy, spool, "b_node").distinct()
    return complete.join(waiting, complete["node"] == waiting["b_node"], "left_anti")


def _leaders_by_pairs(live: DataFrame, spool: TableSpool) -> DataFrame:
    """Nodes of ``live`` that lead, from all their pairs of duplicates."""
    met = _meetings(_side(live, "a"), _side(live, "b")).filter(F.col("a_node") < F.col("b_node"))
    pairs = spool.cut(_duplicates(met, True, spool, "a_node", "b_node").distinct(), "pairs")
    gone: list[DataFrame] = []
    while not pairs.isEmpty():
        leads = pairs.select("a_node").distinct().join(pairs.select(F.col("b_node").alias("a_node")), "a_node", "left_anti")
        new = spool.cut(pairs.join(leads, "a_node", "left_semi").select("b_node").distinct(), "gone")
        gone.append(new)
        left = pairs.join(new, "b_node", "left_anti").join(new.withColumnRenamed("b_node", "a_node"), "a_node", "left_anti")
        pairs = spool.cut(left.select("a_node", "b_node"), "pairs")
    nodes = live.select("node").distinct()
    if not gone:
        return nodes
    return nodes.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("b_node", "node"), "node", "left_anti")


def _nodes(keyed: DataFrame) -> DataFrame:
    """Rows that share URL and key have the same first holder and the same duplicates; the first stands for all."""
    rows = keyed.groupBy("norm_url", "dup_key", "norm_title", "norm_company").agg(F.min("seq").alias("node"))
    return rows.filter(F.col("norm_url").isNotNull() | F.col("dup_key").isNotNull())


def find_leaders(live: DataFrame, fuzzy: bool, spool: TableSpool) -> DataFrame:
    """Leaders among nodes, as token rows like ``live``. ``node`` is the leader's ``seq``."""
    found: list[DataFrame] = []
    front = FIRST_FRONT if fuzzy else 1
    left = live.count()
    while left:
        decided = _round(live, front, fuzzy, spool)
        new = spool.cut(live.join(decided, "node", "left_semi").select(*live.columns), "leaders")
        found.append(new)
        met = _meetings(_side(new, "a"), _side(live, "b")).filter(F.col("a_node") < F.col("b_node"))
        joined = _duplicates(met, fuzzy, spool, "b_node").select(F.col("b_node").alias("node"))
        gone = joined.unionByName(new.select("node")).distinct()
        live = spool.cut(live.join(gone, "node", "left_anti").select(*live.columns), "undecided")
        before, left = left, live.count()
        if fuzzy and left and before - left < FEW * before:
            leads = _leaders_by_pairs(live, spool)
            found.append(spool.cut(live.join(leads, "node", "left_semi").select(*live.columns), "leaders"))
            break
        if fuzzy:
            front = min(front * 8, LARGEST_FRONT)
    return reduce(DataFrame.unionByName, found) if found else live


def _follow(keyed: DataFrame, leader_tokens: DataFrame, circles: DataFrame | None, spool: TableSpool) -> DataFrame:
    """(seq, leader) of every row, given all leaders: by URL, else by key, else by likeness, else itself."""
    leaders = leader_tokens.select("node", "norm_url", "dup_key").distinct()
    first = lambda key, name: leaders.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("node").alias(name))
    # A leader counts for a row only if it came earlier (or is the row itself).
    earlier = lambda c: F.when(F.col(c) <= F.col("seq"), F.col(c))
    names = ["seq", "dup_key", "norm_title", "norm_company"]
    rows = join_unique(keyed.select(*names, "norm_url"), first("norm_url", "url_leader"), "norm_url")
    rows = spool.cut(rows.select(*names, F.col("norm_url").isNull().alias("no_url"), earlier("url_leader").alias("leader")), "by-url")
    rows = join_unique(rows, first("dup_key", "key_leader"), "dup_key")
    keyless = F.col("no_url") & F.col("dup_key").isNull()
    rows = rows.select(
        *names, F.when(keyless, F.col("seq")).otherwise(F.coalesce("leader", earlier("key_leader"))).alias("leader")
    )
    if circles is None:
        return rows.select("seq", "leader")
    rows = spool.cut(rows, "exact-leaders")
    searching = (
        rows.filter(F.col("leader").isNull())
        .select("dup_key", "norm_title", "norm_company")
        .distinct()
        .withColumn("norm_url", F.lit(None).cast("string"))
        .withColumn("node", F.lit(None).cast("bigint"))
    )
    met = _meetings(_side(leader_tokens, "a"), _side(_token_rows(searching, circles), "b"))
    similar_leaders = (
        _duplicates(met, True, spool, "a_node", "b_dup_key")
        .groupBy(F.col("b_dup_key").alias("dup_key"))
        .agg(F.min("a_node").alias("similar_leader"))
    )
    return join_unique(rows.select("seq", "dup_key", "leader"), similar_leaders, "dup_key").select(
        "seq", F.coalesce("leader", "similar_leader").alias("leader")
    )


def _names(keyed: DataFrame) -> DataFrame:
    return keyed.filter(F.col("dup_key").isNotNull()).select("norm_company").distinct()


def assign_leaders(keyed: DataFrame, fuzzy: bool, spool: TableSpool) -> DataFrame:
    """(seq, leader) of every row. Leaders lead themselves."""
    circles = company_circles(_names(keyed), spool) if fuzzy else None
    live = spool.cut(_token_rows(_nodes(keyed), circles), "undecided")
    return _follow(keyed, find_leaders(live, fuzzy, spool), circles, spool)


def assign_new(stored: DataFrame, keyed: DataFrame, fuzzy: bool, spool: TableSpool) -> DataFrame:
    """(seq, leader) of the rows of ``keyed`` where all ``stored`` rows, which come before, are leaders.

    Only new rows are searched: new names are compared with all names, and of the stored rows
    those are read that share a token with a new one. A new row with a stored duplicate cannot
    lead; the others find leaders among themselves.
    """
    circles = None
    if fuzzy:
        names = _names(stored).withColumn("stored", F.lit(True)).unionByName(_names(keyed).withColumn("stored", F.lit(False)))
        circles = company_circles(names.groupBy("norm_company").agg(F.min("stored").alias("stored")), spool)
    new = spool.cut(_token_rows(_nodes(keyed), circles), "new")
    known = _token_rows(_nodes(stored), circles).join(new.select("token").distinct(), "token", "left_semi")
    known = spool.cut(known.select(*new.columns), "known")
    led = _duplicates(_meetings(_side(known, "a"), _side(new, "b")), fuzzy, spool, "b_node")
    rest = new.join(led.select(F.col("b_node").alias("node")).distinct(), "node", "left_anti").select(*new.columns)
    leaders = find_leaders(spool.cut(rest, "undecided"), fuzzy, spool)
    return _follow(keyed, known.unionByName(leaders), circles, spool)


# --- merge ----------------------------------------------------------------------------------


def _traits(rows: DataFrame, plain: list[str]) -> DataFrame:
    """What the merge needs to know of each row, without its texts."""
    filled = [
        (F.col(name).isNotNull() & (F.length(F.col(name)) > 0) if name in K.TEXT_WEIGHTS else F.col(name).isNotNull()).alias(f"has_{name}")
        for name in (*K.TEXT_WEIGHTS, *K.VALUE_WEIGHTS)
    ]
    return rows.select(
        "seq", "leader",
        blank_to_null(F.col("source")).alias("source"),
        (F.length(F.coalesce(F.col("ats_platform"), F.lit(""))) > 0).alias("has_platform"),
        K.is_ats(F.col("source"), F.col("ats_platform")).alias("is_ats"),
        F.coalesce(F.length("description"), F.lit(0)).alias("text_length"),
        K.completeness().alias("score"),
        *filled,
        *[F.col(c).isNotNull().alias(f"p_{c}") for c in plain],
    )


def _first_times(traits: DataFrame) -> DataFrame:
    """Per leader, the first ``seq`` at which its group has each thing that scores."""
    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("seq")))

    times = traits.groupBy("leader").agg(
        F.count("*").alias("n_merged"),
        F.max("text_length").alias("longest"),
        first(F.col("has_platform")).alias("t_platform"),
        *[first(F.col(f"has_{name}")).alias(f"t_{name}") for name in (*K.TEXT_WEIGHTS, *K.VALUE_WEIGHTS)],
        *[first(F.col("text_length") > bound).alias(f"t_longer_{bound}") for bound, _ in K.LONG_DESCRIPTION],
    )
    # A group is of one platform by name until a second source turns up.
    per_source = traits.filter(F.col("source").isNotNull()).groupBy("leader", "source").agg(F.min("seq").alias("t"))
    rank = F.row_number().over(Window.partitionBy("leader").orderBy("t", "source"))
    first_two = per_source.withColumn("_rn", rank).filter(F.col("_rn") <= 2)
    sources = first_two.groupBy("leader").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("t"))).alias("t_source"),
        F.max(F.when(F.col("_rn") == 1, F.col("source").isin(V.ATS_SOURCES))).alias("first_is_ats"),
        F.max(F.when(F.col("_rn") == 2, F.col("t"))).alias("t_mixed"),
    )
    return times.join(sources, "leader", "left")


def _places(traits: DataFrame, times: DataFrame) -> DataFrame:
    """Rank each row within its group: values are taken from the row that comes first.

    Adding rows one after the other, a row that beats what has been merged so far goes to the
    front, any other to the back. Whether it does depends only on which things the group had
    before it, which ``_first_times`` tells, so no group is walked through.
    """
    def had(name: str) -> Column:
        return F.coalesce(F.col(name) < F.col("seq"), F.lit(False))

    so_far = F.lit(0)
    for name, weight in {**K.TEXT_WEIGHTS, **K.VALUE_WEIGHTS}.items():
        so_far = so_far + F.when(had(f"t_{name}"), weight).otherwise(0)
    for bound, weight in K.LONG_DESCRIPTION:
        so_far = so_far + F.when(had(f"t_longer_{bound}"), weight).otherwise(0)
    merged_is_ats = had("t_platform") | (
        F.coalesce(F.col("first_is_ats"), F.lit(False)) & had("t_source") & ~had("t_mixed")
    )
    wins = (F.col("is_ats") & ~merged_is_ats) | (
        (F.col("is_ats") == merged_is_ats) & (F.col("score") > so_far)
    )
    place = (
        F.when(F.col("seq") == F.col("leader"), F.lit(0))
        .when(wins, -F.col("seq") - 1)
        .otherwise(F.col("seq") + 1)
    )
    return join_unique(traits, times, "leader", "inner").select(
        "seq", "leader", "longest", "text_length", place.cast("bigint").alias("place"),
        *[c for c in traits.columns if c.startswith("p_")],
    )


def merge_groups(df: DataFrame, leaders: DataFrame, spool: TableSpool) -> DataFrame:
    """One row per leader, at the leader's place; rows without duplicates stay as they are.

    Of every field the value of the foremost row that has one; of the description the longest
    text; of the source the sorted union. Blank text of a duplicate counts as missing.

    Only positions are aggregated over whole groups. Texts move only for rows that give a
    field, at most one row per field, so no task ever holds a group.
    """
    fields = [c for c in df.columns if c != "seq"]
    plain = [c for c in fields if c not in ("description", "source")]
    sizes = leaders.groupBy("leader").agg(F.count("*").alias("n_merged")).filter("n_merged > 1")
    members = join_unique(leaders, sizes, "leader", "inner")
    single = df.join(members, "seq", "left_anti").select("seq", *fields, F.lit(1).cast("bigint").alias("n_merged"))

    texts = {name for name, kind in df.dtypes if kind == "string"}
    grouped = spool.cut(
        df.select("seq", *[blank_to_null(F.col(c)).alias(c) if c in texts else F.col(c) for c in fields])
        .join(members.select("seq", "leader"), "seq"),
        "grouped",
    )
    traits = _traits(grouped, plain)
    placed = spool.cut(_places(traits, _first_times(traits)), "places")

    def foremost(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("place")))

    givers = placed.groupBy("leader").agg(
        *[foremost(F.col(f"p_{c}")).alias(f"g_{c}") for c in plain],
        foremost((F.col("text_length") == F.col("longest")) & (F.col("longest") > 0)).alias("g_description"),
    )
    gives = F.lit(False)
    for c in [*plain, "description"]:
        gives = gives | F.coalesce(F.col(f"g_{c}") == F.col("place"), F.lit(False))
    giving = join_unique(placed.select("seq", "leader", "place"), givers, "leader", "inner").filter(gives).drop("leader")
    given = grouped.join(giving, "seq").groupBy("leader").agg(
        *[
            F.first(F.when(F.col(f"g_{c}") == F.col("place"), F.col(c)), ignorenulls=True).alias(c)
            for c in [*plain, "description"]
        ]
    )
    merged = (
        given.join(_united_sources(grouped), "leader", "left")
        .join(sizes, "leader")
        .select(F.col("leader").alias("seq"), *fields, "n_merged")
    )
    return single.unionByName(merged)


def _united_sources(grouped: DataFrame) -> DataFrame:
    parts = grouped.filter(F.length("source") > 0).select(
        "leader", F.explode(source_parts(F.col("source"))).alias("part")
    )
    return (
        parts.distinct()
        .groupBy("leader")
        .agg(F.array_join(F.array_sort(F.collect_list("part")), V.SOURCE_SEPARATOR).alias("source"))
    )


def resolve(df: DataFrame, fuzzy: bool = True, stored: bool = False) -> DataFrame:
    """Merge duplicate postings; ``n_merged`` says how many rows a row stands for.

    ``fuzzy`` also merges postings of similar companies with similar titles. The rows are read
    several times; unless they are ``stored`` already they are written to a table first.
    """
    spool = TableSpool(df.sparkSession, "resolve")
    source = df if stored else spool.cut(df, "input")
    keyed = spool.cut(
        with_keys(source).select("seq", "norm_url", "norm_title", "norm_company", "dup_key"), "keyed"
    )
    leaders = spool.cut(assign_leaders(keyed, fuzzy, spool), "assigned")
    return merge_groups(source, leaders, spool)


def resolve_new(stored: DataFrame, new: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Stored postings with new ones merged in; ``n_merged`` says how many of these rows a row stands for.

    Every row of ``stored`` must come before every row of ``new`` in ``seq``, and stays a row of its own. The
    result is that of resolving all rows together if no two stored ones are duplicates, but only stored
    rows that take a new one in are merged; the others are passed on.
    """
    spool = TableSpool(new.sparkSession, "resolve-new")
    new = spool.cut(new, "input")
    keys = ["seq", "norm_url", "norm_title", "norm_company", "dup_key"]
    keyed = spool.cut(with_keys(new).select(*keys), "keyed")
    known = spool.cut(with_keys(stored).select(*keys), "known-keys")
    leaders = spool.cut(assign_new(known, keyed, fuzzy, spool), "assigned")
    touched = leaders.select(F.col("leader").alias("seq")).distinct()
    taking = spool.cut(stored.join(touched, "seq", "left_semi").select(*stored.columns), "taking")
    itself = taking.select("seq", F.col("seq").alias("leader"))
    merged = merge_groups(taking.unionByName(new.select(*stored.columns)), leaders.unionByName(itself), spool)
    others = stored.join(touched, "seq", "left_anti").select(*stored.columns)
    return merged.unionByName(others.withColumn("n_merged", F.lit(1).cast("bigint")).select(*merged.columns))


def resolve_exact(df: DataFrame) -> DataFrame:
    """Merge postings with the same URL or the same normalised title and company."""
    return resolve(df, fuzzy=False)


def similar_keys(df: DataFrame) -> DataFrame:
    """(dup_key, similar_leader): for each distinct key the earliest leader similar to it.

    Keys that lead themselves are left out.
    """
    spool = TableSpool(df.sparkSession, "similar")
    keyed = spool.cut(
        with_keys(df).select("seq", "norm_url", "norm_title", "norm_company", "dup_key"), "keyed"
    )
    key_only = keyed.filter(F.col("dup_key").isNotNull()).withColumn("norm_url", F.lit(None).cast("string"))
    leaders = assign_leaders(key_only, True, spool)
    return (
        keyed.select("seq", "dup_key").join(leaders, "seq").filter(F.col("seq") != F.col("leader"))
    )

