"""Alignment of two tokenizers' encodings of the same texts.

Both encodings cover the same bytes, so each token ends at a byte offset. Of each encoding a dictionary
tells which token ends where; offsets that are keys of both, in order, cut the two lists of ids into
groups, the smallest stretches that both cover whole. Inside a group no two tokens end together, so
walking both sides once gives all pairs that overlap, the links.

How often a pair of ids is linked in the whole corpus says how well they belong together. Links are
written down per document as one number a pair, counted by pair, and looked up again.

Texts are cut where no token of either side can cross, and each distinct chunk of a process is encoded
and aligned once.
"""

from __future__ import annotations

import json
from array import array
from itertools import accumulate
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacancia.session import TableSpool

from .common import id_and_text, per_process, tokenizer_path
from .packing import _LONG_BLANK, PRINTED_BYTES, WORD_PATTERN, _ranks

#: Chunks kept in a process, and the length from which a chunk is not kept.
CHUNKS, LONG_CHUNK = 300_000, 100
#: Links that a task holds before it counts them; pairs that are sent whole to all tasks.
HELD_LINKS = 4_000_000
SENT_PAIRS = 4_000_000

SPACE_SIGN = "▁"


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or tokenizer_path("byte_bpe_50k.json"), second or tokenizer_path("piece_bpe_32k.model")


def _id_count(described: dict) -> int:
    return 1 + max([*described["model"]["vocab"].values(), *(x["id"] for x in described["added_tokens"])])


def _kind(first: int, second: int) -> np.dtype:
    """How a pair of ids, first * (number of second ids) + second, is packed."""
    return np.dtype("<u4" if first * second <= 1 << 32 else "<u8")


def _pair_numbers(first: str, second: str) -> tuple[int, np.dtype]:
    """(number of second ids, kind of a pair's number)."""
    import sentencepiece

    with open(first, encoding="utf-8") as file:
        ids = _id_count(json.load(file))
    size = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    return size, _kind(ids, size)


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        others = [b for b in range(256) if b not in set(PRINTED_BYTES)]
        byte = {chr(b): b for b in PRINTED_BYTES} | {chr(256 + n): b for n, b in enumerate(others)}
        self.size = _id_count(described)
        self.bytes = [b""] * self.size
        for name, i in described["model"]["vocab"].items():
            self.bytes[i] = bytes([byte[c] for c in name]) if all(c in byte for c in name) else name.encode()
        ranks = _ranks(described)
        self._path, self._library = path, None
        self._by_rank = ranks and tiktoken.Encoding("by rank", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self._by_rank and not (len(text) >= 65536 and _LONG_BLANK.search(text)):
            return self._by_rank.encode_ordinary(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and token bytes of a sentencepiece model, which puts a space in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        names = [self._model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self._model.is_byte(i) else name.replace(SPACE_SIGN, " ").encode()
            for i, name in enumerate(names)
        ]
        #: whether no piece has a space after another sign
        self.cuts_at_spaces = not any(SPACE_SIGN in name.lstrip(SPACE_SIGN) for name in names)
        self._space = self._model.piece_to_id(SPACE_SIGN)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that each have a space put in front; of nothing but that space for an empty one."""
        return [ids or [self._space] for ids in self._model.encode(texts, num_threads=1)]


def slices(first: list[int], second: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of each group of tokens of these lengths, by the ends both sides have in common."""
    ends_a = dict(zip(accumulate(first), range(1, len(first) + 1)))
    ends_b = dict(zip(accumulate(second), range(1, len(second) + 1)))
    common = [end for end in ends_a if end in ends_b]  # ends only grow
    a, b = [ends_a[end] for end in common], [ends_b[end] for end in common]
    return list(zip([0, *a], a, [0, *b], b))


def overlaps(first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """Places of tokens whose bytes overlap, for one group: one step past the token that ends first."""
    a = b = 0
    end_a, end_b = first[0], second[0]
    found = [(0, 0)]
    while end_a != end_b:
        if end_a < end_b:
            a += 1
            end_a += first[a]
        else:
            b += 1
            end_b += second[b]
        found.append((a, b))
    return found


def chunks(text: str) -> list[str]:
    """The parts of a text, cut before each space that follows another sign, without that space."""
    parts = text.split(" ")
    found, held = [], parts[0]
    for part in parts[1:]:
        if held and not held[-1].isspace():
            found.append(held)
            held = part
        else:
            held = f"{held} {part}"
    found.append(held)
    return found


class Aligner:
    """Groups and links of texts; keeps the results of short chunks."""

    def __init__(self, first: str, second: str):
        self.first, self.second = ByteLevel(first), Pieces(second)
        self.kind = _kind(self.first.size, self.second.size)
        self._code = "I" if self.kind.itemsize == 4 else "Q"
        self._shown = list(map(str, range(max(self.first.size, self.second.size))))
        self._held: dict[str, tuple | None] = {}

    def _aligned(self, chunk: str, b: list[int]) -> tuple | None:
        """(tokens, tokens, groups, links, groups written out, links packed) of one chunk."""
        whole = f" {chunk}"
        a = self.first.encode(whole)
        first, second = [self.first.bytes[i] for i in a], [self.second.bytes[i] for i in b]
        data = whole.encode()
        if b"".join(first) != data or b"".join(second) != data:
            return None
        size, shown = self.second.size, self._shown
        if first == second:  # every group has one token on each side
            n, links = len(a), [x * size + y for x, y in zip(a, b)]
            return n, n, n, n, ";".join([f"{shown[x]}|{shown[y]}" for x, y in zip(a, b)]), array(self._code, links).tobytes()
        written, links = [], []
        first, second = list(map(len, first)), list(map(len, second))
        groups = slices(first, second)
        for a0, a1, b0, b1 in groups:
            if a1 - a0 == 1:
                x = a[a0]
                if b1 - b0 == 1:
                    y = b[b0]
                    links.append(x * size + y)
                    written.append(f"{shown[x]}|{shown[y]}")
                    continue
                links += [x * size + y for y in b[b0:b1]]
                written.append(f"{shown[x]}|{','.join([shown[y] for y in b[b0:b1]])}")
            elif b1 - b0 == 1:
                y = b[b0]
                links += [x * size + y for x in a[a0:a1]]
                written.append(f"{','.join([shown[x] for x in a[a0:a1]])}|{y}")
            else:
                links += [a[a0 + i] * size + b[b0 + j] for i, j in overlaps(first[a0:a1], second[b0:b1])]
                written.append("|".join(",".join([shown[i] for i in ids]) for ids in (a[a0:a1], b[b0:b1])))
        return len(a), len(b), len(groups), len(links), ";".join(written), array(self._code, links).tobytes()

    def align(self, texts: list[str]) -> list[tuple | None]:
        """The same for whole texts; nothing for empty ones and where an encoding's bytes are not the text's."""
        cut = [(chunks(text) if self.second.cuts_at_spaces else [text]) if text else [] for text in texts]
        held = self._held
        if len(held) > CHUNKS:
            held.clear()
        new = list({chunk for parts in cut for chunk in parts if chunk not in held})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for chunk, ids in zip(part, self.second.encode(part)):
                held[chunk] = self._aligned(chunk, ids)
        found = []
        for parts in cut:
            records = [held[chunk] for chunk in parts]
            if not records or None in records:
                found.append(None)
                continue
            a, b, groups, links, written, packed = zip(*records)
            found.append((sum(a), sum(b), sum(groups), sum(links), ";".join(written), b"".join(packed)))
        for chunk in new:
            if len(chunk) >= LONG_CHUNK:
                del held[chunk]
        return found


def aligner(first: str, second: str) -> Aligner:
    return per_process(("aligner", first, second), lambda: Aligner(first, second), large=True)


def aligned_texts(
    docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) of each whole text.

    ``groups`` is written as ``a1,a2|b1;a3|b2,b3`` and ``links`` packs id pairs as numbers. Null and empty
    texts, and texts whose tokens do not give back a space and the text, have zeros and nothing.
    """
    paths = _paths(first, second)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                found = [x or (0, 0, 0, 0, "", b"") for x in made.align(part.column(1).to_pylist())]
                columns = zip(*found)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds)]], ["doc_id", *names]
                )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary")


def pair_counts(links: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n): how many links hold each pair of ids linked; counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            size += len(held[-1])
            if size >= HELD_LINKS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _with_sent_counts(stored: DataFrame, counts: DataFrame, kind: np.dtype, names: list[str]) -> DataFrame:
    """n_best and count_sum of each row, by counts that every task holds whole."""
    table = counts.toArrow()
    pairs = table["pair"].to_numpy()
    order = np.argsort(pairs)
    values = pairs[order].astype(kind), table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order]
    sent = stored.sparkSession.sparkContext.broadcast(values)
    del table, pairs, order, values

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                packed = part.column(part.num_columns - 1).to_pylist()
                # each distinct pair of some rows is looked up once
                pairs, place = np.unique(np.frombuffer(b"".join(packed), kind), return_inverse=True)
                found = np.searchsorted(known, pairs)
                ends = np.cumsum([len(x) // kind.itemsize for x in packed])
                starts = np.r_[0, ends[:-1]]
                sums = [np.r_[0, np.cumsum(x[found][place])] for x in (n, best.astype(np.int64))]
                n_of, best_of = [pa.array(x[ends] - x[starts]) for x in sums]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], best_of, n_of], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in names)
    return stored.select(*names, "links").mapInArrow(look, f"{kinds}, n_best long, count_sum long")


def _with_joined_counts(stored: DataFrame, counts: DataFrame, kind: np.dtype, names: list[str]) -> DataFrame:
    """The same by a join of each row's distinct pairs with the counts, whatever the number of pairs."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, times = np.unique(np.frombuffer(packed, kind), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), row)), pa.array(pairs.astype(np.int64)), pa.array(times)], ["row", "pair", "times"]
                )

    rows = stored.withColumn("row", F.monotonically_increasing_id())
    held = rows.where("n_links > 0").select("row", "links").mapInArrow(distinct, "row long, pair long, times long")
    sums = held.join(counts.hint("merge"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    nothing = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select(*names, nothing("n_best"), nothing("count_sum"))


def alignments(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sent_pairs: int = SENT_PAIRS,
) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is how many links of the whole table join its two ids; ``count_sum`` adds up the counts of
    a document's links, ``n_best`` is how many of them have the highest count that their second id has. Null,
    empty and unfaithfully encoded texts have zeros and no digest. Repeated rows and null ids are kept and
    count like others; an empty table gives no rows. Counts are sent to all tasks while there are at most
    ``sent_pairs`` pairs, and joined beyond that, with equal results.
    """
    spool = TableSpool(docs.sparkSession, "alignment")
    found = aligned_texts(docs, first, second, id_col, text_col)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    path = spool.path("aligned")
    written = found.select(*names[:-1], digest, "links")
    # links repeat like words do, which this codec sees
    written.write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.schema(written.schema).parquet(path)
    size, kind = _pair_numbers(*_paths(first, second))
    counts = spool.cut(pair_counts(stored, kind), "counts")
    of_second = F.col("pair") % size
    highest = counts.groupBy(of_second.alias("b")).agg(F.max("n").alias("highest"))
    counts = counts.join(highest, of_second == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    counts = spool.cut(counts, "best")
    add = _with_sent_counts if counts.count() <= sent_pairs else _with_joined_counts
    return add(stored, counts, kind, names).select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
