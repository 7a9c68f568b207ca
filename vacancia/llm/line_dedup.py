"""Repeated runs of lines, by prefix doubling over the suffix array of line ids.

Lines get an id by their content. The suffixes that start at each line are ranked by their first
line, then by their first 2, 4, 8, ... lines: the rank of a doubled prefix is the pair of ranks of
its halves, named after its first occurrence. Suffixes of equal rank are an interval whose longest
common prefix is at least that long; a suffix that is alone in its interval takes part no longer. So
the intervals show every run of lines that occurs twice, and where it occurs first.

A run is deleted where it occurs later. Occurrences are ordered by document id, then by line; the
first one of every line always stays. Runs of few characters are left alone.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacancia.session import TableSpool

from .common import id_and_text

#: A repeated run counts if its lines have this many characters in all.
MIN_CHARS = 10


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, line, chars, one, two): a 128-bit id for each line of each row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return each.select(
        "row",
        "doc_id",
        "line",
        F.length("content").alias("chars"),
        F.xxhash64("content").alias("one"),
        F.xxhash64(F.lit(7), "content").alias("two"),
    )


def _ranked(places: DataFrame, keys: list[str], spool: TableSpool, level: int) -> DataFrame:
    """Suffixes whose keys occur twice, with the first occurrence as their rank."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row", "line"))
    groups = places.groupBy(*keys).agg(first.alias("first"), F.count("*").alias("members")).where("members > 1")
    groups = groups.select(
        *keys, F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line")
    )
    ranked = places.join(groups, keys)
    return spool.cut(
        ranked.select("row", "doc_id", "line", "chars", "first_doc", "first_row", "first_line"), f"level-{level}"
    )


def repeated_runs(lines: DataFrame, spool: TableSpool) -> DataFrame:
    """(row, line, size, chars, first_doc, first_row, first_line): later copies of runs of 2^k lines."""
    found, level = [], 0
    ranked = _ranked(lines, ["one", "two"], spool, 0)
    while True:
        later = ranked.where("row <> first_row OR line <> first_line")
        found.append(later.withColumn("size", F.lit(1 << level)).drop("doc_id"))
        if not ranked.where("row <> first_row OR line <> first_line").limit(1).count():
            break
        half = 1 << level
        second = ranked.select(
            "row",
            (F.col("line") - half).alias("line"),
            F.col("chars").alias("more"),
            F.col("first_row").alias("second_row"),
            F.col("first_line").alias("second_line"),
        )
        doubled = ranked.join(second, ["row", "line"]).withColumn("chars", F.col("chars") + F.col("more"))
        doubled = doubled.withColumnsRenamed({"first_row": "half_row", "first_line": "half_line"}).drop("first_doc")
        level += 1
        ranked = _ranked(doubled, ["half_row", "half_line", "second_row", "second_line"], spool, level)
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    return runs


def _without(text: str, runs) -> tuple[str, int, list[str], list[str]]:
    """A text without its deleted lines, their number, themselves and the maximal runs they form."""
    lines = text.split("\n")
    source: list = [None] * len(lines)
    for run in sorted(runs or [], key=lambda r: r["size"]):
        for j in range(run["size"]):
            source[run["line"] + j] = (run["first_doc"], run["first_row"], run["first_line"] + j)
    written, start = [], None
    for i in range(len(lines) + 1):
        here = source[i] if i < len(lines) else None
        if start is not None and (here is None or here[1:] != (source[i - 1][1], source[i - 1][2] + 1)):
            written.append(f"{start}:{i - start}:{source[start][0]}:{source[start][2]}")
            start = None
        if here is not None and start is None:
            start = i
    deleted = [str(i) for i, s in enumerate(source) if s is not None]
    return "\n".join(line for line, s in zip(lines, source) if s is None), len(lines), deleted, written


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of a stored table: the id, n_lines, n_deleted, deleted, runs, kept_text and ``keep``.

    ``deleted`` lists the numbers of the deleted lines, ``runs`` the maximal runs they form as
    start:lines:id of the first occurrence:its line. A null text counts as one empty line, of which
    nothing is ever deleted; null ids come last in the order, repeated ids in the table's order. An
    empty table gives no rows. ``kept_text`` is empty where every line is a later copy.
    """
    spool = TableSpool(docs.sparkSession, "line-dedup")
    lines = spool.cut(line_ids(docs, id_col, text_col), "lines")
    runs = repeated_runs(lines, spool).where(F.col("chars") >= min_chars)
    by_row = runs.groupBy("row").agg(
        F.collect_list(F.struct("line", "size", "first_doc", "first_row", "first_line")).alias("runs")
    )
    names = ["text" if c == text_col else f"kept_{i}" for i, c in enumerate(keep)]  # a text is carried once
    carried = [F.col(c).alias(name) for c, name in zip(keep, names) if c != text_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    whole = texts.join(by_row, "row", "left").drop("row")
    fields = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("doc_id", *names))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _without(text or "", runs) for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())
            ]
            kept, counts, deleted, written = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *names)]
                + [
                    pa.array(counts, pa.int64()),
                    pa.array([len(d) for d in deleted], pa.int64()),
                    pa.array([",".join(d) for d in deleted], pa.string()),
                    pa.array([",".join(w) for w in written], pa.string()),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", *names, "n_lines", "n_deleted", "deleted", "runs", "kept_text"],
            )

    shape = f"{fields}, n_lines long, n_deleted long, deleted string, runs string, kept_text string"
    done = whole.mapInArrow(delete, shape)
    return done.select(
        F.col("doc_id").alias(id_col),
        "n_lines",
        "n_deleted",
        "deleted",
        "runs",
        "kept_text",
        *[F.col(name).alias(c) for name, c in zip(names, keep)],
    )
