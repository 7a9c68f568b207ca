"""Quality by a regularised quadratic discriminant over document statistics.

A text is a short vector of statistics of its whole words, characters and lines: counts as logarithms,
shares as smoothed log odds, so that each is roughly normal within a label. Each label has a mean and a
covariance, the latter drawn towards the one both labels share and then towards a sphere. A text's score
comes from the difference of the two log densities, that is of Mahalanobis distances under the labels'
Cholesky factors, which are computed once. How far to draw is chosen inside the training rows, where
each fold is scored by what the others gave; the same differences give the logistic curve that makes
them probabilities.

What is learnt are sums: the training rows are never gathered, and what reaches the driver has a size
that depends on the number of statistics alone.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from itertools import product
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacancia.session import TableSpool

from .common import per_process
from .toxicity import in_training, logistic

STATISTICS = (
    "words", "word_length", "word_length_spread", "longest_word", "upper", "digits", "stops", "symbols", "blanks",
    "distinct_words", "top_word", "short_words", "marked_words", "lettered_words", "repeated_triples", "lines",
    "repeated_lines", "closed_lines", "sentence_length", "letter_entropy",
)
#: Shares of the common covariance and of the sphere that are tried.
COMMON = (0.05, 0.3, 0.7)
SPHERE = (0.01, 0.1, 0.3)
FOLDS = 4
#: Differences of log densities are counted in bins of this width up to this size.
WIDTH, FARTHEST = 0.125, 40.0
THRESHOLD = 0.3

#: Classes of characters.
_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _BLANK = range(6)
_STOPS = frozenset(".,;:!?'\"()-")
_ENDS = (".", "!", "?", ":", ";", '"')


def _class_of(letter: str) -> int:
    kind = unicodedata.category(letter)
    if letter.isspace():
        return _BLANK
    if letter in _STOPS:
        return _STOP
    if kind == "Lu" or kind == "Lt":
        return _UPPER
    if kind[0] in "LM":
        return _LOWER
    return _DIGIT if kind[0] == "N" else _SYMBOL


def _classes() -> np.ndarray:
    """The class of each character of the basic plane; others count as symbols."""
    return np.array([_class_of(chr(i)) if not 0xD800 <= i < 0xE000 else _SYMBOL for i in range(1 << 16)] + [_SYMBOL], np.int8)


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS; an empty text has them too."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = per_process("character classes", _classes)[np.minimum(codes, 1 << 16)]
    count = np.bincount(kinds, minlength=6).tolist()
    letters = count[_LOWER] + count[_UPPER]
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), float, n)
    often = Counter(words)
    triples = max(0, n - 2)
    marked = sum(m for w, m in often.items() if not w[-1].isalnum() and w[-1] not in _STOPS)
    lettered = sum(m for w, m in often.items() if any(map(str.isalpha, w)))
    lines = [line for line in text.split("\n") if line.strip()]
    ends = text.count(".") + text.count("!") + text.count("?")
    shares = np.unique(codes, return_counts=True)[1] / max(1, len(codes))
    return [
        math.log1p(n),
        math.log1p(sizes.mean()) if n else 0.0,
        math.log1p(sizes.std()) if n else 0.0,
        math.log1p(sizes.max()) if n else 0.0,
        _odds(count[_UPPER], letters),
        _odds(count[_DIGIT], len(codes)),
        _odds(count[_STOP], len(codes)),
        _odds(count[_SYMBOL], len(codes)),
        _odds(count[_BLANK], len(codes)),
        _odds(len(often), n),
        _odds(max(often.values(), default=0), n),
        _odds(int((sizes <= 3).sum()), n),
        _odds(marked, n),
        _odds(lettered, n),
        _odds(triples - len(set(zip(words, words[1:], words[2:]))), triples),
        math.log1p(len(lines)),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(sum(line.rstrip().endswith(_ENDS) for line in lines), len(lines)),
        math.log1p(n / (ends + 1)),
        float(-(shares * np.log(shares)).sum()),
    ]


class Discriminant:
    """Two normal densities; the inverses of their Cholesky factors are kept."""

    def __init__(self, moments: np.ndarray, common: float, sphere: float):
        """``moments`` holds for each label the number of rows, the sums and the sums of products."""
        p = len(STATISTICS)
        n = moments[:, 0]
        means = moments[:, 1 : p + 1] / n[:, None]
        spread = moments[:, p + 1 :].reshape(2, p, p) - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = spread.sum(0) / n.sum()
        scale = 1 / np.sqrt(np.diag(pooled) + 1e-6)
        self._scale, self._means = scale, means * scale
        grid = scale[:, None] * scale[None, :]
        self._factors, self._logs = [], []
        for y in (0, 1):
            own = ((1 - common) * spread[y] / n[y] + common * pooled) * grid
            own = (1 - sphere) * own + sphere * (np.trace(own) / p + 1e-3) * np.eye(p)
            factor = np.linalg.cholesky(own)
            self._factors.append(np.linalg.inv(factor))
            self._logs.append(2 * np.log(np.diag(factor)).sum())
        self._prior = math.log(n[1] / n[0])

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for rows of statistics."""
        rows = rows * self._scale
        far = [((rows - self._means[y]) @ self._factors[y].T) ** 2 for y in (0, 1)]
        return self._prior + 0.5 * (far[0].sum(1) + self._logs[0] - far[1].sum(1) - self._logs[1])


class QualityModel:
    """A discriminant with its curve, or one constant where there are not both labels to learn from."""

    def __init__(self, plain: float, discriminant: Discriminant | None = None, curve: tuple[float, float] = (0.0, 1.0)):
        self.plain, self.discriminant, self.curve = plain, discriminant, curve

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.discriminant is None:
            return np.full(len(rows), self.plain)
        a, b = self.curve
        bounded = np.clip(self.discriminant.differences(rows), -FARTHEST, FARTHEST)
        return np.round(1 / (1 + np.exp(-np.clip(a + b * bounded, -30, 30))), 9)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stats, kept_0, ...): the statistics of each whole text; null counts as empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(text) for text in batch.column(1).to_pylist()]
            stats = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), stats, *batch.columns[2:]], ["doc_id", "stats", *batch.schema.names[2:]]
            )

    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(name) for c, name in zip(keep, names)],
    )
    others = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(build, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>{others}")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _moments(training: DataFrame) -> np.ndarray:
    """Sums over the training rows by fold and label, added up in each task before they move."""
    size = 1 + len(STATISTICS) + len(STATISTICS) ** 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, size))
        for batch in batches:
            rows = _matrix(batch.column(0))
            group = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy()
            for g in np.unique(group):
                own = rows[group == g]
                total[g // 2, g % 2] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "part"])

    added = training.select("stats", "fold", "label").mapInArrow(add, "place long, part double")
    moments = np.zeros(FOLDS * 2 * size)
    for place, whole in added.groupBy("place").agg(F.sum("part")).collect():
        moments[place] = whole
    return moments.reshape(FOLDS, 2, size)


def _counted(training: DataFrame, models: list[list[Discriminant]]) -> np.ndarray:
    """Training rows by setting, bin of the difference and label; each row is scored by its fold's model."""
    bins = int(2 * FARTHEST / WIDTH) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), bins, 2), np.int64)
        for batch in batches:
            rows, fold, label = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold):
                own = fold == f
                for s, by_fold in enumerate(models):
                    far = np.clip(by_fold[f].differences(rows[own]), -FARTHEST, FARTHEST)
                    np.add.at(total[s], (np.rint((far + FARTHEST) / WIDTH).astype(int), label[own]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "part"])

    counted = training.select("stats", "fold", "label").mapInArrow(count, "place long, part long")
    whole = np.zeros(len(models) * bins * 2, np.int64)
    for place, n in counted.groupBy("place").agg(F.sum("part")).collect():
        whole[place] = n
    return whole.reshape(len(models), bins, 2)


def _fitted(counts: np.ndarray) -> tuple[float, tuple[float, float]]:
    """(mean log loss, curve) of one setting's counts by bin and label."""
    centres = np.arange(len(counts)) * WIDTH - FARTHEST
    x, y, weights = np.repeat(centres, 2), np.tile([0, 1], len(counts)), counts.ravel().astype(float)
    a, b = logistic(x, y, weights)
    logits = np.clip(a + b * x, -30, 30)
    return float((weights * np.logaddexp(0, np.where(y == 1, -logits, logits))).sum() / weights.sum()), (a, b)


def learn_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """A model from all labelled rows of a stored table of statistics that are not held out.

    A document labelled twice is of label 1 only if all its labels say so; null ids and null labels are
    left out. Without rows of both labels every score is the share of label 1, 0.5 without any.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & in_training("doc_id"))
    known = known.groupBy("doc_id").agg((F.min("label") > 0).cast("int").alias("label"))
    # folds follow the text's statistics, so that equal texts are in one
    fold = F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")
    training = stats.select("doc_id", "stats").join(known.hint("merge"), "doc_id").select("stats", fold, "label")
    training = TableSpool(stats.sparkSession, "quality").cut(training, "training")
    moments = _moments(training)
    whole = moments.sum(0)
    rows = whole[:, 0]
    plain = float((rows[1] + 0.5) / (rows.sum() + 1))
    if rows.min() < 1:
        return QualityModel(plain)
    settings = list(product(COMMON, SPHERE))
    others = [whole - moments[f] for f in range(FOLDS)]
    # a fold that holds all rows of a label is scored by the model of all rows
    others = [part if part[:, 0].min() >= 1 else whole for part in others]
    counts = _counted(training, [[Discriminant(part, *s) for part in others] for s in settings])
    fitted = [_fitted(c) for c in counts]
    best = min(range(len(settings)), key=lambda i: fitted[i][0])
    return QualityModel(plain, Discriminant(whole, *settings[best]), fitted[best][1])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: the id, held_out, score, predicted and the columns in ``keep``.

    Learns from the labelled rows of ``docs`` that are not held out. A null text counts as empty and is
    scored by the statistics of an empty one. Equal texts get equal scores; a null id is not held out. An
    empty table gives no rows. Other columns of ``docs`` play no part, whatever their names are.
    """
    kinds = {c: docs.schema[c].dataType for c in keep}
    stats = TableSpool(docs.sparkSession, "quality").cut(document_statistics(docs, id_col, text_col, keep), "statistics")
    model = learn_quality(stats, labels, id_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [f"kept_{i}" for i in range(len(keep))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(sent.value.score(_matrix(batch.column(1))), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), found, *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]]
            )

    fields = "".join(f", {name} {kind.simpleString()}" for name, kind in zip(others, kinds.values()))
    scored = stats.mapInArrow(score, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double{fields}")
    return scored.select(
        F.col("doc_id").alias(id_col),
        F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *[F.col(name).alias(c) for c, name in zip(keep, others)],
    )
