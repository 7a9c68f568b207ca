"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A genome says which bin each document of a shard lies in. Crossover copies a parent's well-filled
bins whole into the other parent, dissolves the bins that now hold a document twice, and best-fits
the documents this displaces, longest first. Each shard is packed by several islands that evolve on
their own for an epoch; then the elite of each island moves on to the next one. What shards leave in
poorly filled bins is packed once more, many shards' leftovers together.

Rows move as lengths only: a shard holds a bounded number of documents whatever the table's size.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left, insort
from functools import cached_property
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacancia.session import TableSpool

from .common import id_and_text, per_process, tokenizer_path

CAPACITY = 1024
END_ID = 2
SHARD_ITEMS = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 8
#: A bin filled to this share is passed on whole; others are packed again with other shards' bins.
WELL_FILLED = 0.98


#: How byte-level vocabularies cut texts, and the bytes they write as themselves.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: A run of white space too long for a pattern that looks ahead.
_LONG_BLANK = re.compile(r"\s{65536}")


def _ranks(described: dict) -> dict[bytes, int] | None:
    """The ranks of a byte-level vocabulary, or None where ids do not say which merge comes first."""
    model, cutter = described["model"], described["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not plain or cutter.get("add_prefix_space") or described["normalizer"] or any(model.get(x) for x in odd):
        return None
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in described["added_tokens"]):
        return None
    added = {x["content"] for x in described["added_tokens"]}
    vocabulary = {name: i for name, i in model["vocab"].items() if name not in added}
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    merged = [vocabulary.get(left + right, -1) for left, right in pairs]
    singles = [i for name, i in vocabulary.items() if len(name) == 1]
    if len(singles) != 256 or merged != sorted(set(merged)) or merged[0] <= max(singles) or len(merged) + 256 != len(vocabulary):
        return None
    others = [b for b in range(256) if b not in PRINTED_BYTES]
    byte = {chr(b): b for b in PRINTED_BYTES} | {chr(256 + n): b for n, b in enumerate(others)}
    return {bytes(byte[c] for c in name): i for name, i in vocabulary.items()}


class TextIds:
    """The ids the tokenizers library gives for a text, packed as 32-bit little-endian.

    Vocabularies whose ids follow the order of their merges are encoded by their ranks, which gives
    the same ids at a third of the time; all others, and texts with huge white space, by the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self._path = path
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        ranks = _ranks(described)
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self._by_rank = ranks and tiktoken.Encoding(
            "by rank", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    @cached_property
    def _tokenizer(self):
        """The library's own, read when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def __call__(self, text: str) -> bytes:
        if self._by_rank and not (len(text) >= 65536 and _LONG_BLANK.search(text)):
            return self._by_rank.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut only beyond ``capacity``.

    All pieces of a long text have ``capacity`` ids but the first, which takes the remainder.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("text ids", vocabulary), lambda: TextIds(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, min(64, batch.num_rows - at))
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder(text) + end
                    total = len(ids) // 4
                    cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(stop - start)
                        sums.append(zlib.crc32(ids[4 * start : 4 * stop]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Genomes over the lengths of one shard."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self._lengths, self._capacity = lengths, capacity
        self._random = random.Random(seed)

    def _best_fit(self, genome: np.ndarray, displaced, fills: dict[int, int]) -> np.ndarray:
        """Put each displaced item, longest first, into the fullest bin that has room for it."""
        lengths, capacity = self._lengths, self._capacity
        room = sorted((capacity - fill, b) for b, fill in fills.items() if fill < capacity)
        fresh = max(fills, default=-1) + 1
        for item in displaced:
            size = int(lengths[item])
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = capacity, fresh
                fresh += 1
            genome[item] = b
            if left > size:
                insort(room, (left - size, b))
        return genome

    def greedy(self, noise: float) -> np.ndarray:
        order = np.array(self._lengths, float)
        if noise:
            state = np.random.default_rng(self._random.randrange(2**32))
            order *= 1 + noise * state.standard_normal(len(order))
        return self._best_fit(np.zeros(len(order), np.int64), np.argsort(-order, kind="stable").tolist(), {})

    def _fills(self, genome: np.ndarray) -> np.ndarray:
        return np.bincount(genome, weights=self._lengths).astype(np.int64)

    def fitness(self, genome: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller full ones."""
        fills = self._fits(genome)
        return -len(fills), float(((fills / self._capacity) ** 2).sum())

    def _fits(self, genome: np.ndarray) -> np.ndarray:
        fills = self._fills(genome)
        return fills[fills > 0]

    def crossover(self, into: np.ndarray, other: np.ndarray) -> np.ndarray:
        fills = self._fills(other)
        full = np.flatnonzero(fills >= WELL_FILLED * self._capacity)
        if not len(full):
            full = np.flatnonzero(fills >= np.median(fills[fills > 0]))
        chosen = np.zeros(len(fills), bool)
        chosen[self._random.sample(full.tolist(), max(1, len(full) // 2))] = True
        injected = chosen[other]
        child = into.copy()
        hit = np.zeros(int(into.max()) + 1, bool)
        hit[into[injected]] = True
        displaced = hit[into] & ~injected
        child[injected] = other[injected] + into.max() + 1
        return self._refit(child, displaced)

    def mutate(self, genome: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest bins and a few others."""
        fills = self._fills(genome)
        used = np.flatnonzero(fills)
        worst = used[np.argsort(fills[used], kind="stable")[: 1 + len(used) // 50]]
        gone = np.zeros(len(fills), bool)
        gone[worst] = True
        gone[self._random.sample(used.tolist(), 1 + len(used) // 50)] = True
        return self._refit(genome.copy(), gone[genome])

    def _refit(self, genome: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        genome = np.unique(genome, return_inverse=True)[1]
        fills = np.bincount(genome[~displaced], weights=self._lengths[~displaced])
        kept = {b: int(fill) for b, fill in enumerate(fills.tolist()) if fill}
        items = np.flatnonzero(displaced)
        items = items[np.argsort(-self._lengths[items], kind="stable")]
        return np.unique(self._best_fit(genome, items.tolist(), kept), return_inverse=True)[1]

    def evolve(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        ranked = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations):
            a, b = self._random.sample(range(len(ranked)), 2)
            child = self.crossover(ranked[min(a, b)], ranked[max(a, b)])
            if self._random.random() < 0.5:
                child = self.mutate(child)
            ranked[-1] = max(ranked[-1], child, key=self.fitness)
            ranked.sort(key=self.fitness, reverse=True)
        return ranked


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard, island, lengths, genomes, migrant in zip(
                frame["shard"], frame["island"], frame["lengths"], frame["genomes"], frame["migrant"]
            ):
                packer = Packer(np.asarray(lengths, np.int64), capacity, hash((epoch, int(shard), int(island))))
                flat = np.asarray(genomes, np.int64).reshape(-1, len(lengths))
                if len(lengths) < 2:
                    evolved = [packer.greedy(0)]
                else:
                    seeds = list(flat) or [packer.greedy(0 if i == 0 and island == 0 else 0.1) for i in range(population)]
                    if migrant is not None and len(migrant):
                        seeds[-1] = np.asarray(migrant, np.int64)
                    evolved = packer.evolve(seeds, generations)
                best = packer.fitness(evolved[0])
                out.append((shard, island, lengths, np.concatenate(evolved), evolved[0], best[0], best[1]))
            yield pd.DataFrame(out, columns=["shard", "island", "lengths", "genomes", "elite", "bins", "fill"])

    return run


def evolve_shards(
    items: DataFrame, spool: TableSpool, capacity: int, islands: int, epochs: int, population: int, generations: int
) -> DataFrame:
    """(item, bin, shard, offset, filled) for items (item, length, shard), by the best island of each shard."""
    shape = "shard long, island int, lengths array<int>, genomes array<int>, elite array<int>, bins long, fill double"
    shards = items.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("held"))
    shards = spool.cut(shards, "shards")
    state = shards.select(
        "shard",
        F.explode(F.array(*map(F.lit, range(islands)))).alias("island"),
        F.col("held.length").cast("array<int>").alias("lengths"),
        F.array().cast("array<int>").alias("genomes"),
        F.lit(None).cast("array<int>").alias("migrant"),
    )
    # little data but much work: with their number given, these partitions are not merged by size
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(epochs):
        spread = state.repartition(tasks, "shard", "island")
        state = spool.cut(spread.mapInPandas(_epoch(capacity, population, generations, epoch), shape), "epoch")
        if epoch + 1 < epochs:
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
            state = state.drop("elite").join(elites, ["shard", "island"])
    rank = F.struct("bins", "fill", -F.col("island"))
    best = state.groupBy("shard").agg(F.max(F.struct(rank, "elite")).getField("elite").alias("genome"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, held, genome in zip(frame["shard"], frame["held"], frame["genome"]):
                bins = np.asarray(genome, np.int64)
                items = np.array([x["item"] for x in held], np.int64)
                lengths = np.array([x["length"] for x in held], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                fills = np.bincount(bins, weights=lengths).astype(np.int64)
                firsts = np.concatenate([[0], np.cumsum(fills)[:-1]])
                yield pd.DataFrame(
                    {
                        "item": items[order],
                        "length": lengths[order],
                        "shard": shard,
                        "bin": bins[order],
                        "offset": ends - lengths[order] - firsts[bins[order]],
                        "filled": fills[bins[order]],
                    }
                )

    return shards.join(best, "shard").mapInPandas(
        place, "item long, length long, shard long, bin long, offset long, filled long"
    )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_items: int = SHARD_ITEMS,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, filled.

    Every row of ``docs`` gives at least one piece, null and empty texts one with the end id alone.
    Repeated rows and null ids are packed like others, each row on its own. An empty table gives no
    rows. Pieces of full length are sequences by themselves; ``filled`` is the length of a sequence.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    spool = TableSpool(docs.sparkSession, "packing")
    pieces = token_pieces(docs, path, capacity, end_id, id_col, text_col)
    pieces = spool.cut(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < capacity).select("item", "length")
    shards = max(1, -(-items.count() // shard_items))
    settings = (spool, capacity, islands, epochs, population, generations)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    placed = spool.cut(evolve_shards(dealt, *settings), "placed")
    poor = F.col("filled") < WELL_FILLED * capacity
    rest = placed.where(poor).select("item", "length")
    again = max(1, -(-rest.count() // shard_items))
    # shards of the second pass are numbered on from those of the first
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(again)) + shards)
    placed = placed.where(~poor).unionByName(evolve_shards(dealt, *settings))
    return pieces.join(placed.drop("length"), "item", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        # full pieces have numbers below zero, the bins of a shard those from shard * 2^32 on
        F.coalesce(F.col("shard") * 2**32 + F.col("bin"), -1 - F.col("item")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        F.coalesce("filled", "length").alias("filled"),
    )
