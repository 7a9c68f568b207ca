"""Toxicity by nearest labelled examples.

The examples, a bounded sample of the labelled training texts, are vectors over all words that occur
in any of them. A word weighs as much as it is rare among all documents and as it tells the two labels
apart: by how far the share of label 1 among its training texts is from the general share, in log odds.
The share is drawn to the general one by a fixed number of texts, so the weight does not depend on how
large the corpus is, and no word is left out. The vectors are held in an inverted index whose postings
lie in blocks of examples; for each term and block the index knows the largest weight. A text's nearest
examples by cosine are found exactly: blocks are scored in the order of their upper bounds, and none is
left out whose bound reaches the k-th best score. The neighbours vote with weights that fall with
distance, corrected for how the sample was drawn. A logistic curve fitted to the examples' own votes
(each without itself) makes the vote a probability. The neighbours and the heaviest terms are the
evidence.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacancia.session import TableSpool

from .common import id_and_text, may_match, per_process

#: The bound of what is learnt: examples of each label (the rows with the smallest hashes).
EXAMPLES = 4000
#: So many texts of the general share of label 1 are added to those of each word.
PRIOR_TEXTS = 5.0
#: The power of the distance in log odds in a word's weight.
POWER = 2.0
NEIGHBOURS = 15
BLOCK = 512
FOLDS = 5
#: Terms that at least one of so many examples has are held as tables, the others as postings.
DENSE = 8
#: Texts that are scored together.
TOGETHER = 32

_WORD = re.compile(r"\w+")


def in_training(id_col: str) -> Column:
    """Whether labels of a row may be learnt from; the others are held out."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS != 0


class BlockMaxIndex:
    """Example vectors by term, with the largest weight of each block."""

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        sizes = [len(v) for v in vectors]
        of = np.fromiter((t for v in vectors for t in v), np.int32, sum(sizes))
        self._fill(sizes, of, np.fromiter((w for v in vectors for w in v.values()), float, len(of)), terms)

    @classmethod
    def of_rows(cls, sizes, of: np.ndarray, weights: np.ndarray, terms: int) -> "BlockMaxIndex":
        """The index of vectors given one after another: their sizes, terms and weights."""
        made = cls.__new__(cls)
        made._fill(sizes, of, weights, terms)
        return made

    def _fill(self, sizes, of: np.ndarray, weights: np.ndarray, terms: int) -> None:
        self.size, self._terms = len(sizes), terms
        order = np.argsort(of, kind="stable")
        self._ids = np.repeat(np.arange(self.size, dtype=np.int32), sizes)[order]
        self._of, self._weights = of[order].astype(np.int32), weights[order]
        self._tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _laid_out(self) -> tuple:
        """(limits, first postings, rows of the table, the table), made once in each process."""
        if self._tables is None:
            blocks = max(1, -(-self.size // BLOCK))
            limits = np.zeros((self._terms, blocks))
            np.maximum.at(limits, (self._of, self._ids // BLOCK), self._weights)
            counts = np.bincount(self._of, minlength=self._terms)
            common = np.flatnonzero(counts * DENSE >= max(self.size, 1))
            row = np.full(self._terms, -1, np.int64)
            row[common] = np.arange(len(common))
            whole = np.zeros((len(common), blocks * BLOCK))
            held = row[self._of] >= 0
            whole[row[self._of[held]], self._ids[held]] = self._weights[held]
            self._tables = (limits, np.concatenate([[0], np.cumsum(counts)]), row, whole)
        return self._tables

    def nearest(self, vector: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, example) with a cosine above zero, ties by the smaller example."""
        return self.nearest_to(np.array(list(vector), np.int64), np.array(list(vector.values()), float), k, without)

    def nearest_to(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The same for a vector given by its terms and their weights."""
        return self.nearest_to_all([(terms, weights)], k, without)[0]

    def nearest_to_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: int | list[int] = -1) -> list:
        """The same for each of some vectors; ``without`` may name an example for each.

        The common terms of all vectors meet a block in one product. The block with the highest bound of
        each vector comes first, then those whose bounds reach the k-th best cosine there.
        """
        limits, starts, row, whole = self._laid_out()
        n, each = len(vectors), np.arange(len(vectors))
        without = np.broadcast_to(without, n)
        bounds, strong = np.zeros((n, limits.shape[1])), np.zeros((n, len(whole)))
        rest, scores = np.empty((n, whole.shape[1])), np.full((n, whole.shape[1]), -1.0)
        for i, (terms, weights) in enumerate(vectors):
            bounds[i] = weights @ limits[terms]
            common = row[terms] >= 0
            strong[i, row[terms[common]]] = weights[common]
            # all postings of the other terms, one after another
            first = starts[terms[~common]]
            sizes = starts[terms[~common] + 1] - first
            at = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            rest[i] = np.bincount(self._ids[at], np.repeat(weights[~common], sizes) * self._weights[at], whole.shape[1])

        def measure(chosen: np.ndarray) -> None:
            for block in np.flatnonzero(chosen.any(0)):
                at, part = np.flatnonzero(chosen[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
                scores[at, part] = strong[at] @ whole[:, part] + rest[at, part]

        best = bounds.argmax(1)
        first = np.zeros(bounds.shape, bool)
        first[each, best] = bounds[each, best] > 0
        measure(first)
        # the one left out may be among them
        floor = np.zeros(n)
        if k < BLOCK:
            floor = np.maximum(np.partition(scores.reshape(n, -1, BLOCK)[each, best], -k - 1)[:, -k - 1], 0)
        measure(~first & (bounds > 0) & (bounds >= floor[:, None] - 1e-12))

        found = []
        for i in range(n):
            at = np.flatnonzero((scores[i] > 0) & (scores[i] >= floor[i] - 1e-9))
            if len(at) > 4 * k:  # all that can be among the k best, ties and the one left out included
                at = at[scores[i, at] >= np.partition(scores[i, at], -k - 1)[-k - 1] - 1e-9]
            # summed up anew, in an order that doesn't depend on the other vectors
            rows = np.flatnonzero(strong[i])
            cosines = (strong[i, rows, None] * whole[np.ix_(rows, at)]).sum(0) + rest[i, at]
            near = sorted((-round(s, 12), e) for s, e in zip(cosines.tolist(), at.tolist()) if e != without[i])
            found.append([(-s, e) for s, e in near[:k]])
        return found


class Words:
    """Words by number, held as one array; each process makes its dictionary of them when it needs one."""

    def __init__(self, words: pa.Array):
        self.words, self._key = words, uuid.uuid4().hex

    def __len__(self) -> int:
        return len(self.words)

    @property
    def place(self) -> dict[str, int]:
        held = per_process("toxicity words", dict)
        if self._key not in held:
            held.clear()  # those of an earlier model
            held[self._key] = {w: i for i, w in enumerate(self.words.to_pylist())}
        return held[self._key]


class ToxicityModel:
    """Terms, examples and the curve; bounded by the words of EXAMPLES whatever the corpus is."""

    def __init__(self, words: Words, weights: np.ndarray, rates: tuple[float, float]):
        self._words, self._weights = words, weights
        # training rows that an example of each label stands for
        self._rates = rates
        self._index = BlockMaxIndex([], len(words))
        self._labels = np.zeros(0, int)
        self._ids: list = []
        self._plain = 0.5
        self.curve = (0.0, 1.0)
        self._sent: Broadcast | None = None

    def __getstate__(self):
        return self.__dict__ | {"_sent": None}

    def sent(self, spark: SparkSession) -> Broadcast:
        """The model on all executors, once; the curve goes with whoever scores."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    @property
    def terms(self) -> list[str]:
        return self._words.words.to_pylist()

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms, in order, and their weights; of length one."""
        counts, place = Counter(_WORD.findall(text.lower())), self._words.place.get
        terms = np.fromiter([place(w, -1) for w in counts], np.int64, len(counts))
        often = np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms, 0, sorter=order) :]  # without words that are no terms
        terms = terms[order]
        weights = (1 + np.log(often[order])) * self._weights[terms]
        norm = math.sqrt(float(weights @ weights))
        return (terms, weights / norm) if norm else (terms[:0], weights[:0])

    def _vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, nearer ones and rarer rows counting for more."""
        votes = [(self._rates[self._labels[i]] / (1.05 - min(1.0, s)), self._labels[i]) for s, i in near]
        total = sum(w for w, _ in votes)
        share = sum(w for w, y in votes if y) / total if total else self._plain
        nearness = near[0][0] if near else 0.0
        # far neighbours say little: then the share of rows without any term counts, or the general one
        return nearness * share + (1 - nearness) * self._plain

    def hold(self, ids: list, labels: np.ndarray, sizes: np.ndarray, of: np.ndarray, often: np.ndarray) -> None:
        """Take examples in: their ids and labels, and one after another their terms and how often each is."""
        weights = (1 + np.log(often)) * self._weights[of]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        norms = np.sqrt(np.bincount(owner, weights * weights, len(sizes)))
        weights /= np.where(norms > 0, norms, 1)[owner]
        self._ids, self._labels = ids, labels
        self._index = BlockMaxIndex.of_rows(sizes, of, weights, len(self._words))
        rates, bare = self.rates_of_examples(), norms == 0
        general = float((rates * labels).sum() + 0.5) / float(rates.sum() + 1)
        self._plain = (float((rates * labels * bare).sum()) + general) / float((rates * bare).sum() + 1)

    def rates_of_examples(self) -> np.ndarray:
        return np.array(self._rates)[self._labels]

    def own_votes(self, examples: list[int], texts: list[str]) -> list[float]:
        """The votes on examples' texts, each by the others."""
        near = self._index.nearest_to_all([self.vector(text) for text in texts], NEIGHBOURS, examples)
        return [self._vote(x) for x in near]

    def score(self, text: str, curve: tuple[float, float] | None = None) -> tuple[float, str]:
        """(probability of label 1, evidence: neighbours with cosines, and the terms shared with the nearest)."""
        return self.scores([text], curve)[0]

    def scores(self, texts: list[str], curve: tuple[float, float] | None = None) -> list[tuple[float, str]]:
        """The same for each of some texts."""
        vectors = [self.vector(text) for text in texts]
        a, b = curve or self.curve
        found = []
        for (terms, weights), near in zip(vectors, self._index.nearest_to_all(vectors, NEIGHBOURS)):
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * _logit(self._vote(near))))))
            named = ",".join(f"{self._ids[i]}:{s:.3f}:{self._labels[i]}" for s, i in near[:3])
            strong = " ".join([self._words.words[int(terms[i])].as_py() for i in np.argsort(-weights, kind="stable")[:3]])
            found.append((score, f"{named};{strong}"))
        return found


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, slightly pulled to the identity."""
    a, b = 0.0, 1.0
    if not len(x) or weights.sum() <= 0:
        return a, b
    weights = weights / weights.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        slope = weights * (p - y)
        bend = weights * p * (1 - p)
        g = np.array([slope.sum() + a, (slope * x).sum() + b - 1])
        h = np.array([[bend.sum() + 1, (bend * x).sum()], [(bend * x).sum(), (bend * x * x).sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 1e-3))


def _term_counts(rows: DataFrame, sent: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each term is, and in how many toxic ones; added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.place
        every, toxic = np.zeros((2, len(place)), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = [i for i in map(place.get, set(_WORD.findall(text.lower()))) if i is not None]
                every[held] += 1
                if label:
                    toxic[held] += 1
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, every[at], toxic[at])], ["place", "texts", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(count, "place long, texts long, toxic long")
    found = counted.groupBy("place").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).toArrow()
    whole = np.zeros((2, len(sent.value)), np.int64)
    for i, name in enumerate(("texts", "toxic")):
        whole[i, found["place"].to_numpy()] = found[name].to_numpy()
    return whole[0], whole[1]


def _word_counts(examples: DataFrame) -> pa.Table:
    """(doc_id, toxic, words, counts) of stored examples, by id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(_WORD.findall(text.lower())) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array([list(c) for c in found], pa.list_(pa.string()))]
                + [pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "words", "counts"],
            )

    kind = examples.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, toxic int, words array<string>, counts array<int>"
    return examples.select("doc_id", "toxic", "text").mapInArrow(count, shape).toArrow().sort_by("doc_id")


def _own_votes(examples: DataFrame, model: ToxicityModel) -> dict:
    """The vote on each example by the others, worked out where the examples are."""
    sent, place = model.sent(examples.sparkSession), {i: n for n, i in enumerate(model._ids)}
    kind = examples.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for at in range(0, len(ids), TOGETHER):
                found += judge.own_votes([place[i] for i in ids[at : at + TOGETHER]], texts[at : at + TOGETHER])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "vote"])

    return dict(examples.select("doc_id", "text").mapInArrow(vote, f"doc_id {kind}, vote double").collect())


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    examples: int = EXAMPLES,
) -> ToxicityModel:
    """A model from the labelled rows that are not held out.

    Examples are at most ``examples`` ids of each label, and terms are all their words. What a term
    tells about the label comes from all of those rows, how rare it is from all documents. A document
    labelled twice counts as toxic if any label says so; of rows that share an id, the text with the
    smallest hash is the example; null ids and null labels are left out. Without any label scores are 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # one plan at every size: labels grow with the documents, so they are not broadcast, but texts without
    # a label need not be shuffled
    every = id_and_text(docs, id_col, text_col)
    training = may_match(every, known, "doc_id").where("may").drop("may").join(known.hint("merge"), "doc_id")
    texts, toxic = training.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not texts:
        return ToxicityModel(Words(pa.array([], pa.string())), np.zeros(0), (1.0, 1.0))

    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(examples) for y in (0, 1)]
    chosen = every.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    chosen = TableSpool(spark, "toxicity").cut(chosen, "examples")
    held = _word_counts(chosen)
    coded = pc.dictionary_encode(held["words"].combine_chunks().flatten())
    by_name = pc.sort_indices(coded.dictionary)
    words = Words(coded.dictionary.take(by_name))
    number = np.empty(len(words), np.int32)
    number[by_name.to_numpy()] = np.arange(len(words), dtype=np.int32)

    sent = spark.sparkContext.broadcast(words)
    known_texts, known_toxic = _term_counts(training, sent)
    all_texts, _ = _term_counts(every.withColumn("toxic", F.lit(0)), sent)
    rate = (toxic + 0.5) / (texts + 1)
    share = (known_toxic + PRIOR_TEXTS * rate) / (known_texts + PRIOR_TEXTS)
    tells = np.abs(np.log(share / (1 - share)) - math.log(rate / (1 - rate))) ** POWER
    rare = np.log((1 + every.count()) / (1 + all_texts)) + 1
    model = ToxicityModel(words, rare * tells, tuple(max(1.0, n / examples) for n in (texts - toxic, toxic)))
    sizes = pc.list_value_length(held["words"]).to_numpy()
    often = held["counts"].combine_chunks().flatten().to_numpy()
    model.hold(held["doc_id"].to_pylist(), held["toxic"].to_numpy(), sizes, number[coded.indices.to_numpy()], often)
    del held, coded, sizes, often
    pa.default_memory_pool().release_unused()  # the driver goes on with the model alone
    votes = _own_votes(chosen, model)
    logits = np.array([_logit(votes[i]) for i in model._ids])
    model.curve = logistic(logits, model._labels, model.rates_of_examples())
    return model


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: the id, held_out, score, predicted, evidence and the columns in ``keep``.

    A null text counts as empty and gets the score of texts without any known term. Rows that repeat
    get equal scores; a null id is not held out. An empty table gives no rows.
    """
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(name) for c, name in zip(keep, names)],
    )
    sent, curve = model.sent(docs.sparkSession), model.curve
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for at in range(0, len(texts), TOGETHER) for x in judge.scores(texts[at : at + TOGETHER], curve)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *names)]
                + [pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())],
                ["doc_id", *names, "score", "evidence"],
            )

    scored = rows.mapInArrow(score, f"{fields}, score double, evidence string")
    return scored.select(
        F.col("doc_id").alias(id_col),
        F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
        *[F.col(name).alias(c) for c, name in zip(keep, names)],
    )
