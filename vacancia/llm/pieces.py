"""Encoding and decoding with a SentencePiece model of merge type.

The valid encoding of a text is the one sequence of pieces in which every two neighbours are
compatible: merging their joined text anew gives the same two pieces. It is found from left to
right. An Aho-Corasick automaton lists all pieces of a chunk in one pass; at each position the
longest comes first, and where it isn't compatible with the piece before it, the next shorter one.
If none fits, the position is marked as failed in a bitfield and the piece before it is given up.

Texts are cut where no piece of the vocabulary can cross, so each distinct chunk is encoded once.
"""

from __future__ import annotations

import codecs
import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Cache
from .common import id_and_text, per_process, tokenizer_path

#: The sign that stands for a space in pieces, and how byte pieces are written.
SPACE_SIGN = "▁"
BYTE_PIECE = "<0x{:02X}>"


class PieceCoder:
    """Encodes and decodes for one model; the library only reads the model's vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        # a byte that belongs to no character is a sign of its own
        codecs.register_error("vacancia-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self._names = [model.id_to_piece(i) for i in range(size)]
        self._bytes = {i: int(self._names[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        silent = {i for i in range(size) if model.is_control(i)}
        self._silent = silent
        self._unknown = model.unk_id()
        self._special = silent | self._bytes.keys() | {self._unknown}
        plain = [i for i in range(size) if i not in self._bytes and i not in silent and i != self._unknown]
        self._id = {self._names[i]: i for i in plain if not model.is_unused(i)}
        self._rank = {name: -model.get_score(i) for name, i in self._id.items()}
        self._byte_id = {b: i for i, b in self._bytes.items()}
        self._joined = {name[i : i + 2] for name in self._id for i in range(len(name) - 1)}
        self._automaton = ahocorasick.Automaton()
        for name in self._id:
            if len(name) > 1:
                self._automaton.add_word(name, len(name))
        self._automaton.make_automaton()
        self._fits: dict[tuple[str, str], bool] = {}
        self._part = Cache(self._encode_part, 200_000)
        self.words = Cache(self._word)

    def _merge(self, text: str) -> list[str]:
        rank, never = self._rank.get, float("inf")
        parts = list(text)
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
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
                    ranks[j] = rank(a + b, never)
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        known = self._fits[left, right] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _encode_part(self, text: str) -> tuple[int, ...]:
        """The ids of a chunk, by longest matches and backtracking."""
        size = len(text)
        choices = [[1] for _ in text]
        for end, length in self._automaton.iter(text):
            choices[end - length + 1].append(length)
        fits, failed = self._fits, 0
        taken: list[tuple[int, int, str]] = []  # position, choice, piece
        at, choice, before = 0, len(choices[0]) - 1, ""
        while at < size:
            while choice >= 0:
                end = at + choices[at][choice]
                if not failed >> end & 1:
                    piece = text[at:end]
                    known = fits.get((before, piece))
                    if known or known is None and self._compatible(before, piece):
                        break
                choice -= 1
            if choice < 0:
                failed |= 1 << at
                at, choice, _ = taken.pop()
                before = taken[-1][2] if taken else ""
                choice -= 1
                continue
            taken.append((at, choice, piece))
            at, before = end, piece
            if at < size:
                choice = len(choices[at]) - 1
        ids = [self._id.get(piece) for _, _, piece in taken]
        if None not in ids:
            return tuple(ids)
        ids = []
        for _, _, piece in taken:
            known = self._id.get(piece)
            if known is not None:
                ids.append(known)
            elif self._byte_id:
                ids += [self._byte_id[b] for b in piece.encode()]
            elif not ids or ids[-1] != self._unknown:
                ids.append(self._unknown)
        return tuple(ids)

    def _word_ids(self, word: str) -> list[int]:
        """The ids of a chunk that is cut further where no piece has its two letters side by side."""
        joined, part = self._joined, self._part
        if word[1:].isalpha():
            return list(self._encode_part(word))
        ids: list[int] = []
        start = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                ids += part[word[start:i]]
                start = i
        ids += part[word[start:]]
        return ids

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self._word_ids(SPACE_SIGN + word)
        return len(ids), ",".join(map(str, ids)), self._joined_text(ids)

    @staticmethod
    def _spaced(text: str) -> list[str]:
        """The chunks of a text that begin with a space, without it; more spaces stay in the chunk."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        words, run = [], ""
        for part in parts[:-1]:
            if part:
                words.append(run + part)
                run = ""
            else:
                run += SPACE_SIGN
        words.append(run + parts[-1])
        return words

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by commas, decoded text)."""
        if not text:
            return 0, "", ""
        found = [self.words[word] for word in self._spaced(text.replace(SPACE_SIGN, " "))]
        counts, ids, texts = zip(*found)
        return sum(counts), ",".join(ids), "".join(texts)[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.digest(text)[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def _joined_text(self, ids) -> str:
        if not self._special.intersection(ids):
            return "".join([self._names[i] for i in ids]).replace(SPACE_SIGN, " ")
        out, held = [], bytearray()
        for i in ids:
            byte = self._bytes.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "vacancia-each-byte"))
                held = bytearray()
            if i not in self._silent:
                out.append(" ⁇ " if i == self._unknown else self._names[i])
        if held:
            out.append(held.decode("utf-8", "vacancia-each-byte"))
        return "".join(out).replace(SPACE_SIGN, " ")

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        first = next((i for i in ids if i not in self._silent), self._unknown)
        return self._joined_text(ids)[first not in self._special and self._names[first].startswith(SPACE_SIGN) :]


def coder(path: str) -> PieceCoder:
    return per_process(("piece coder", path), lambda: PieceCoder(path), large=True)


def encode_pieces(
    docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without begin or end; null counts as empty (no ids)."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = pa.array([encoder.encode(text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), ids], ["doc_id", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(path)
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def piece_digests(
    docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each whole text and decodes its ids in one pass. A null text counts as empty: no ids,
    and the digests of empty strings. Ids are carried as they are, null or repeated.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                n, written, decoded = encoder.digest(text)
                counts.append(n)
                ids.append(sha(written))
                texts.append(sha(decoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
