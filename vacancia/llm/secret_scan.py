"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold. The
index stores postings of the trigrams the queries ask for: one row for each of them that a text has.
A query intersects postings by text, and only its candidates are verified with the expression. Rules
without mandatory trigrams are run over every text. Texts are told apart by a 64-bit hash in the
index; texts that share one can only become candidates together, so results stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vacancia.functions.text import let
from vacancia.session import TableSpool

from .common import may_match
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed. A run shorter than 24 or 20
#: can't hold a longer match, so these two lengths stand in the pattern itself.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Trigrams to one number of a mask.
MASK_BITS = 62


def asked_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    queries = (trigram_query(rule.pattern) for rule in rules)
    return sorted({t for query in queries if query for conjunction in query for t in conjunction})


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram int, key long) of the asked trigrams in (key, text)."""
    low = let(F.lower("text"), lambda t: F.array(*[F.when(t.contains(x), F.lit(i)) for i, x in enumerate(trigrams)]))
    return texts.select(F.explode(F.array_compact(low)).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(key, a flag for each rule with a query): keys whose postings satisfy the queries."""
    place = {t: i for i, t in enumerate(trigrams)}
    masks = range(-(-len(trigrams) // MASK_BITS))
    bit = F.expr(f"shiftleft(1L, cast(trigram % {MASK_BITS} AS int))")
    held = index.groupBy("key").agg(
        *[F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == m, bit).otherwise(0)).alias(f"mask{m}") for m in masks]
    )

    def satisfied(query) -> Column:
        ways = []
        for conjunction in sorted(map(sorted, query)):
            need = [sum(1 << place[t] % MASK_BITS for t in conjunction if place[t] // MASK_BITS == m) for m in masks]
            tests = [F.col(f"mask{m}").bitwiseAND(F.lit(n)) == n for m, n in zip(masks, need) if n]
            way = tests[0]
            for test in tests[1:]:
                way &= test
            ways.append(way)
        any_way = ways[0]
        for way in ways[1:]:
            any_way |= way
        return any_way

    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    flags = {f"may_{kind}": satisfied(query) for kind, query in queries.items() if query}
    some = F.lit(False)
    for flag in flags:
        some |= F.col(flag)
    return held.select("key", *[flag.alias(name) for name, flag in flags.items()]).where(some)


def _spans(rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches in ``text``, in code points.

    What lies between matches comes from splitting at them; lengths of both, summed up, are places.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<start:long,rank:int,stop:long>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        stop = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))
        keep = F.length(part["value"]) >= rule.least
        return F.struct(
            F.coalesce(stop, start).alias("at"),
            F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    return F.when(
        F.rlike(text, pattern), F.aggregate(parts, begin, step, lambda state: state["found"])
    ).otherwise(none)


def scan_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()
) -> DataFrame:
    """One row per row: the id, n_<kind> for each rule, ``found`` and the columns named in ``keep``.

    ``found`` has (start, rank, stop) of every match, by start, then by the rules' order. A null text
    counts as empty and has none; ids may be null or repeat; an empty table gives no rows.
    """
    spool = TableSpool(docs.sparkSession, "secrets")
    names = ["raw" if c == text_col else f"kept_{i}" for i, c in enumerate(keep)]  # a text is carried once
    carried = [F.col(c).alias(name) for c, name in zip(keep, names) if c != text_col]
    text = F.coalesce("raw", F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"), *carried).withColumn("key", F.xxhash64(text))
    trigrams = asked_trigrams(rules)
    if trigrams:
        index = spool.cut(trigram_index(texts.select("key", text.alias("text")), trigrams), "index")
        found = spool.cut(candidates(index, rules, trigrams), "candidates")
        # texts that are no candidates need not be shuffled
        texts = may_match(texts, found, "key")
        texts, others = [texts.where(F.col("may") == may).drop("may") for may in (True, False)]
        texts = texts.join(found, "key", "left").unionByName(others, allowMissingColumns=True)
    texts = texts.withColumn("text", text)
    spans = []
    for rank, rule in enumerate(rules):
        found = _spans(rule, rank)
        if trigram_query(rule.pattern):
            found = F.when(F.col(f"may_{rule.kind}"), found).otherwise(F.array().cast("array<struct<start:long,rank:int,stop:long>>"))
        spans.append(found.alias(f"spans_{rank}"))
    each = texts.select("doc_id", *names, "text", *spans)
    return each.select(
        F.col("doc_id").alias(id_col),
        *[F.size(f"spans_{rank}").cast("long").alias(f"n_{rule.kind}") for rank, rule in enumerate(rules)],
        F.array_sort(F.concat(*[f"spans_{rank}" for rank in range(len(rules))])).alias("found"),
        *[F.col(name).alias(c) for name, c in zip(names, keep)],
        *([F.col("text").alias("scanned_text")] if keep else []),
    )


def written_spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    write = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(found, write), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of the base rules; see scan_secrets."""
    found = scan_secrets(docs, RULES, id_col, text_col).withColumn("spans", written_spans(F.col("found")))
    counts = [f"n_{rule.kind}" for rule in RULES]
    return found.select(F.col(id_col).alias("doc_id"), *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")
