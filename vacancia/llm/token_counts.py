"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The encoding of a prefix is the encoding of a shorter prefix plus one last token: the only token
that ends there and is compatible with the last token of the shorter prefix. Two tokens are
compatible when merging their joined bytes anew gives the same two tokens. So one pass over a word
stores the exact count at each of its prefixes, and counts of a whole text are sums over its chunks.
Truncation and budgets are answered from the stored counts; nothing is encoded again.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Cache, spaced_chunks
from .common import id_and_text, per_process, tokenizer_path

#: How a byte-level BPE of this family cuts a text into words, and its special string.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """The letters that vocabulary files write bytes with: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _letters(text: str) -> str:
    """The bytes of a text, as one letter each."""
    return text if text.isascii() else text.encode().decode("latin-1")


class PrefixCounter:
    """Counts at prefixes for one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        import json

        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_of = _byte_of_letter()
        plain = lambda token: "".join([chr(bytes_of[c]) for c in token])
        self._special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._cut = regex.compile("|".join(map(regex.escape, self._special))) if self._special else None
        self._words = regex.compile(WORDS)
        named = {t["content"] for t in spec["added_tokens"]}
        self._automaton = ahocorasick.Automaton()
        for token in spec["model"]["vocab"]:
            if token not in named:
                self._automaton.add_word(plain(token), len(token))
        self._automaton.make_automaton()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self._rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        self._fits: dict[tuple[str, str], bool] = {}
        self._word = Cache(self._word_counts, 200_000)
        self._after_space = Cache(lambda part: self.chunk(" " + part))

    def _merge(self, text: str) -> list[str]:
        rank, never = self._rank.get, float("inf")
        parts = list(text)
        ranks = [rank((a, b), never) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    a, b = parts[j : j + 2]
                    ranks[j] = rank((a, b), never)
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _word_counts(self, word: str) -> list[int]:
        """The count at each byte of a word (one letter for each byte), from 0 on."""
        fits = self._fits
        last, counts, done = [""] * (len(word) + 1), [0] * (len(word) + 1), -1
        for end, length in self._automaton.iter(word):
            if end != done:
                start = end + 1 - length
                token = word[start : end + 1]
                known = fits.get((last[start], token))
                if known or known is None and self._compatible(last[start], token):
                    done = end
                    last[end + 1] = token
                    counts[end + 1] = counts[start] + 1
        return counts

    def _plain_counts(self, text: str) -> list[int]:
        """The count at each code point of a text without special strings."""
        counts = [0]
        before, spaces = 0, 0
        for word in self._words.findall(text):
            at_byte = self._word[_letters(word)]
            if word.isascii():
                inside = at_byte[1:]
            else:
                inside, at = [], 0
                for letter in word:
                    at += len(letter.encode())
                    inside.append(at_byte[at])
            if spaces and word[0].isspace():
                # a prefix that ends in here has one run of white space where the whole text has two
                blanks = len(word) - len(word.lstrip())
                run = text[len(counts) - 1 - spaces : len(counts) - 1]
                inside = [
                    self._word[_letters(run + word[: i + 1])][-1] - self._word[_letters(run)][-1] if i < blanks else n
                    for i, n in enumerate(inside)
                ]
            counts += [before + n for n in inside]
            before += at_byte[-1]
            spaces = len(word) if word.isspace() else 0
        return counts

    def prefix_counts(self, text: str) -> list[int]:
        """The count at each code point, from 0 on, of a whole text; a special string counts as one
        token where it ends, and as plain text before."""
        if not self._cut or not self._cut.search(text):
            return self._plain_counts(text)
        counts, at = [0], 0
        for found in self._cut.finditer(text):
            base, start = counts[-1], found.start()
            counts += [base + n for n in self._plain_counts(text[at:start])[1:]]
            whole = counts[-1] + 1
            counts += [base + n for n in self._plain_counts(text[at : found.end() - 1])[start - at + 1 :]]
            counts.append(whole)
            at = found.end()
        return counts + [counts[-1] + n for n in self._plain_counts(text[at:])[1:]]

    def chunk(self, text: str) -> bytes | tuple[int, ...]:
        """The counts at the prefixes of a chunk, without the one of the empty prefix, packed."""
        if text.isascii() and text[1:].isalpha() and text[0] == " ":
            counts = self._word_counts(text)[1:]
        else:
            counts = self.prefix_counts(text)[1:]
        return bytes(counts) if not counts or max(counts) < 256 else tuple(counts)

    def count_and_cut(self, text: str, limit: int) -> tuple[int, int]:
        """The count of a text, and the code points of a prefix within ``limit``: all chunks before
        the one whose end passes the limit, and the longest prefix of that one that still fits."""
        if not text:
            return 0, 0
        first, rest = spaced_chunks(text)
        found = self._after_space
        chunks = [self.chunk(first) or b"\0", *[found[part] for part in rest]]
        ends = list(accumulate([counts[-1] for counts in chunks]))
        at = bisect_right(ends, limit)
        if at == len(chunks):
            return ends[-1], len(text)
        before = ends[at - 1] if at else 0
        inside = max((i + 1 for i, n in enumerate(chunks[at]) if before + n <= limit), default=0)
        # the empty first chunk of a text that begins with a space stands for no code point
        return ends[-1], sum(map(len, chunks[:at])) - (not first and at > 0) + inside


def counter(path: str) -> PrefixCounter:
    return per_process(("prefix counter", path), lambda: PrefixCounter(path), large=True)


def token_counts(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the length in code points of a prefix within ``limit`` tokens (see count_and_cut). A null
    text counts as empty, with no bytes and no tokens; ids are carried as they are, null or repeated.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [counts.count_and_cut(text, limit) for text in texts]
            tokens = pa.array([n for n, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    tokens,
                    pa.array([n > limit for n, _ in found], pa.bool_()),
                    pa.array([at for _, at in found], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, counts): the count at each code point of each text, from the empty prefix on."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = pa.array([counts.prefix_counts(text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), found], ["doc_id", "counts"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, counts array<int>")
