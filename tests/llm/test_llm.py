"""The operators against brute force and libraries, on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacancia.llm import shingle_join, toxicity
from vacancia.llm.common import may_match, tokenizer_path
from vacancia.llm.exact_dedup import CuckooIndex, apply_changes, exact_dedup
from vacancia.llm.line_dedup import dedup_lines
from vacancia.llm.packing import Packer, TextIds, pack
from vacancia.llm.pieces import PieceCoder, decode_pieces, encode_pieces, piece_digests
from vacancia.llm.secret_scan import secret_digests
from vacancia.llm.shingle_join import shingle_components
from vacancia.llm.spot_signatures import fingerprints_with_neighbours, similar_pairs
from vacancia.llm.suffix_dedup import repeated_passages
from vacancia.llm.token_counts import PrefixCounter, token_counts
from vacancia.llm.toxicity import BlockMaxIndex, learn, score_toxicity
from vacancia.llm.trigrams import trigram_query
from vacancia.session import TableSpool

SCHEMA = "doc_id long, text string, row long, key string, n int"
RNG = random.Random(5)


def word():
    return "".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7)))


PASSAGE = " ".join(word() for _ in range(70))
BASE = [word() for _ in range(150)]


def near(changes):
    words = BASE[:]
    for _ in range(changes):
        words[RNG.randrange(150)] = word()
    return " ".join(words)


TEXTS = (
    [None, "", " ", "\n\n", "one", "two words", "the of and", "日本語 текст　ü \U0001f600 x", "!!! ???", "a  b\n\n c  "]
    + [near(RNG.randint(0, 8)) for _ in range(25)]
    + [f"{word()} {PASSAGE}\n{word()} tail number {i}" for i in range(6)]
    + ["\n".join(["a common line of text", word(), "another common line", word()]) for _ in range(5)]
    + ["x\ny\nz\nsome longer block", "q\nx\ny\nz\nsome longer block\nend", " ".join(word() for _ in range(9000))]
    + ['password = "hunter22" token: abc secret=token: abcdef API_KEY:"zzzzzz"', "AKIA" + "A1" * 9 + " AKIASHORT " + "0af" * 9]
    + ["é AKIA" + "Z" * 16 + "\n" + "f" * 24 + "g" + "a" * 23, "the cat of hats in the rain and the snow on it"]
)
ROWS = [(i * 3, t, 1, "k", 2) for i, t in enumerate(TEXTS)] + [(9, "one", 1, "k", 2), (9, "one", 1, "k", 2), (None, "two words", 1, "k", 2)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def plain(text):
    return text or ""


def by_id(rows):
    """Rows of documents whose id is there once."""
    return {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 9)}


def once():
    return [(i, plain(t)) for i, t, *_ in ROWS if i not in (None, 9)]


OPERATORS = [
    pack, piece_digests, token_counts, exact_dedup, secret_digests, dedup_lines, shingle_components,
    fingerprints_with_neighbours, repeated_passages,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_empty_table(empty, operator):
    assert operator(empty).count() == 0


# --- 1 ---


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = pack(docs).collect()
    want = collections.Counter()
    for doc, text, *_ in ROWS:
        ids = tokenizer.encode(plain(text), add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    bins = []  # no more than best-fit of the longest first over all pieces at once
    for r in sorted(rows, key=lambda r: -r.length):
        room = [i for i, fill in enumerate(bins) if fill + r.length <= 1024]
        if room:
            bins[max(room, key=lambda i: bins[i])] += r.length
        else:
            bins.append(r.length)
    assert len(sequences) <= len(bins)


def test_packer_crossover_keeps_items():
    lengths = np.array([random.Random(i).randint(1, 600) for i in range(300)])
    packer = Packer(lengths, 1024, 3)
    population = packer.evolve([packer.greedy(0.1) for _ in range(4)], 20)
    for genome in population:
        assert len(genome) == 300 and np.bincount(genome, weights=lengths).max() <= 1024
    assert packer.fitness(population[0]) >= packer.fitness(packer.greedy(0.1))


# --- 2 ---


def test_pieces_are_the_librarys(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = by_id(piece_digests(docs).collect())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for doc, text in once():
        ids = model.encode(text)
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[doc].decoded_sha256 == sha(model.decode(ids))
    round_trip = by_id(decode_pieces(encode_pieces(docs)).collect())
    assert all(round_trip[doc].text == model.decode(model.encode(text)) for doc, text in once())


def test_piece_coder_on_random_texts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), PieceCoder(path), random.Random(1)
    parts = ["a", " ", "  ", "\n", "the", "é", "日", "▁", "<s>", "\t", " ing", "\U0001f600", "\x00", "...", "ﬁ", "       "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert coder.encode(text) == model.encode(text)
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(10)]
        assert coder.decode(ids) == model.decode(ids)


# --- 3 ---


def base_spans(text):
    kinds = (
        (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    found = []
    for rank, (pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(docs):
    got = by_id(secret_digests(docs).collect())
    for doc, text in once():
        assert got[doc].spans == base_spans(text)
        assert got[doc].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    assert any(r.n_assign for r in got.values()) and any(r.n_access for r in got.values()) and any(r.n_hex for r in got.values())


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") is None
    assert trigram_query("AKIA[A-Z0-9]{16,}") == {frozenset({"aki", "kia"})}
    assert trigram_query("(?:abc|xyz)+d?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert trigram_query("ab?c") is None


# --- 4 ---


def uncovered(words, rows, size=50):
    """Places of repeated word sequences that no row covers."""
    places = collections.defaultdict(list)
    for i, w in words.items():
        for j in range(len(w) - size + 1):
            places[tuple(w[j : j + size])].append((i, j))
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.first_word, r.first_word + r.n_words))
    repeated = [x for at in places.values() if len(at) > 1 for x in at]
    return repeated, [(i, j) for i, j in repeated if not any(a <= j and j + size <= b for a, b in spans[i])]


def check_passages(text, rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in text.items()}
    repeated, missed = uncovered(words, rows)
    assert not missed and {r.doc_id for r in rows} == {i for i, _ in repeated}
    for r in rows:
        mine = words[r.doc_id][r.first_word : r.first_word + r.n_words]
        there = words[r.other_doc_id]
        assert mine == there[r.other_word : r.other_word + r.n_words] and len(mine) >= 50
        assert text[r.doc_id][r.start : r.stop].split() == mine
    return repeated


def test_passages(docs):
    assert len({i for i, _ in check_passages(dict(once()), repeated_passages(docs).collect())}) > 12


def test_short_passages_beside_shared_starts(spark):
    """Passages of 50 to 64 words in two texts each, whose first 45 words four others share."""
    rng, texts = random.Random(11), []
    for _ in range(25):
        passage = [word() for _ in range(rng.randint(50, 64))]
        for n in (len(passage), len(passage), 45, 45, 45, 45):
            around = [[word() for _ in range(rng.randint(0, 60))] for _ in range(2)]
            texts.append(around[0] + passage[:n] + around[1])
    texts += [texts[0][:30] + texts[0], texts[1] * 3]
    text = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in text.items()], SCHEMA).repartition(5)
    docs = TableSpool(spark, "short-passages").cut(docs, "docs")
    assert len(check_passages(text, repeated_passages(docs).collect())) > 300


# --- 5 ---


def test_block_max_index_is_exact():
    rng = random.Random(2)
    vectors = [{t: rng.random() for t in rng.sample(range(30), rng.randint(0, 5))} for _ in range(400)]
    index = BlockMaxIndex(vectors, 30)
    for _ in range(50):
        query = {t: rng.random() for t in rng.sample(range(30), 3)}
        scores = [(round(sum(w * v.get(t, 0) for t, w in query.items()), 12), -i) for i, v in enumerate(vectors)]
        want = [(s, -i) for s, i in sorted(scores, reverse=True) if s > 0][:7]
        got = index.nearest(query, 7)
        assert [i for _, i in got] == [i for _, i in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_block_max_index_answers_many_at_once():
    """Answers don't depend on which vectors are asked for together; each may leave an example out."""
    rng = random.Random(6)
    vectors = [{t: rng.random() for t in rng.sample(range(60), rng.randint(0, 9))} for _ in range(1300)]
    index = BlockMaxIndex(vectors, 60)
    asked = rng.sample(range(1300), 40)
    queries = [(np.array(sorted(vectors[e]), np.int64), np.array([vectors[e][t] for t in sorted(vectors[e])])) for e in asked]
    got = index.nearest_to_all(queries, 5, asked)
    for e, query, found in zip(asked, queries, got):
        assert found == index.nearest_to(*query, 5, e) and e not in [i for _, i in found]
        scores = [(round(sum(w * v.get(t, 0) for t, w in vectors[e].items()), 12), -i) for i, v in enumerate(vectors) if i != e]
        want = [(s, -i) for s, i in sorted(scores, reverse=True) if s > 0][:5]
        assert [i for _, i in found] == [i for _, i in want] and [s for s, _ in found] == pytest.approx([s for s, _ in want])


def test_rows_that_may_match(spark):
    """All rows with a match are flagged, and hardly any other."""
    keys = spark.createDataFrame([(7 * i,) for i in range(300)] + [(None,)], "doc_id long")
    rows = spark.createDataFrame([(i, "t") for i in range(-2000, 2100)] + [(None, "t")] * 2, "doc_id long, text string")
    got = may_match(rows, keys, "doc_id").collect()
    flagged = {r.doc_id for r in got if r.may}
    assert len(got) == rows.count() and flagged >= {7 * i for i in range(300)} and len(flagged) < 310 and None not in flagged
    assert not any(r.may for r in may_match(rows, keys.limit(0), "doc_id").collect())
    other = {r.doc_id for r in may_match(rows, keys.selectExpr("cast(doc_id AS int) AS doc_id"), "doc_id").where("may").collect()}
    assert other >= {7 * i for i in range(300)}


def test_toxicity_shuffles_labelled_texts_only(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(toxicity, "_term_counts", lambda rows, sent, count=toxicity._term_counts: joined.append(rows) or count(rows, sent))
    docs = spark.createDataFrame([(i, f"{word()} {word()}", 1, "k", 2) for i in range(400)], SCHEMA)
    learn(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    trained = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(30))
    assert [x.count() for x in joined] == [trained, 400]
    assert "bitmap" in joined[0]._jdf.queryExecution().toString()


def test_toxicity_held_out(spark):
    rng, bad = random.Random(4), ["vile", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        words = [word() for _ in range(40)] + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, None if i == 7 else " ".join(words), 1, "k", 2))
        labels.append((i, 0 if i == 7 else int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, learn(docs, known)).collect()}
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_knows_all_words_of_examples(spark):
    """Toxic words of their own in every few texts are terms too, however few texts have them."""
    rng, rows, labels = random.Random(8), [], []
    bad = [f"bad{word()}{i}" for i in range(40)]
    for i in range(1200):
        toxic = i % 4 == 0
        words = [word() for _ in range(40)] + (rng.sample(bad, 3) if toxic else [])
        rows.append((i, " ".join(words), 1, "k", 2))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    trained = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5]
    assert set(model.terms) == {w for i in trained for w in rows[i][1].split()}
    texts = collections.Counter(w for r in rows for w in set(r[1].split()))
    training = collections.Counter(w for i in trained for w in set(rows[i][1].split()))
    toxic = collections.Counter(w for i in trained if labels[i][1] for w in set(rows[i][1].split()))
    rate = (sum(labels[i][1] for i in trained) + 0.5) / (len(trained) + 1)
    weights = []
    for w in model.terms:
        share = (toxic[w] + 5 * rate) / (training[w] + 5)
        tells = abs(np.log(share / (1 - share)) - np.log(rate / (1 - rate)))
        weights.append((np.log(1201 / (1 + texts[w])) + 1) * tells**2)
    assert model._weights == pytest.approx(weights)
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_toxicity_without_labels(docs, empty):
    model = learn(docs, empty.select("doc_id", F.lit(1).alias("toxic")))
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)


# --- 6 ---


def test_lines(docs):
    table = sorted([(i, t) for i, t in once()])
    keep = {9}
    got = {r.doc_id: r for r in dedup_lines(docs.where("doc_id IS NOT NULL AND doc_id <> 9")).collect()}
    gone, size = collections.defaultdict(set), 1
    while size < 64:
        seen = set()
        for doc, text in table:
            lines = text.split("\n")
            for at in range(len(lines) - size + 1):
                run = tuple(lines[at : at + size])
                if run in seen and sum(map(len, run)) >= 10:
                    gone[doc].update(range(at, at + size))
                seen.add(run)
        size *= 2
    assert any(gone.values()) and not keep & set(got)
    for doc, text in table:
        lines = text.split("\n")
        assert got[doc].kept_text == "\n".join(x for i, x in enumerate(lines) if i not in gone[doc])
        assert got[doc].deleted == ",".join(map(str, sorted(gone[doc]))) and got[doc].n_lines == len(lines)


# --- 7 ---


def test_token_counts(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = by_id(token_counts(docs).collect())
    for doc, text in once():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (got[doc].n_tokens, got[doc].n_bytes, got[doc].over_limit) == (n, len(text.encode()), n > 512)
        assert len(tokenizer.encode(text[: got[doc].fit_chars], add_special_tokens=False).ids) <= 512


def test_prefix_counts_are_exact():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(6)
    tokenizer, counter = Tokenizer.from_file(path), PrefixCounter(path)
    parts = ["a", " ", "\n", "'s", "é", "日", "!", "1", "the", "<|endoftext|>", "\t", " ing"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(20))
        want = [len(tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == want


# --- 8 ---


def test_fingerprints(docs):
    table = docs.where("doc_id IS NOT NULL AND doc_id <> 9")
    got = {r.doc_id: r for r in fingerprints_with_neighbours(table).collect()}
    order = sorted(once())
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = collections.defaultdict(set)
    for at, (doc, text) in enumerate(order):
        after, following = order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, next_one = (set(x.split()) for x in (row.fingerprint, row.edited_fingerprint, got[after].fingerprint))
        assert row.near_edited == pytest.approx(likeness(own, changed))
        assert row.near_next == pytest.approx(likeness(own, next_one))
        prints[text].add(row.fingerprint)
    assert all(len(found) == 1 for found in prints.values())


def test_similar_pairs_lose_none(docs):
    table = docs.where("doc_id IS NOT NULL AND doc_id <> 9")
    pairs, members = similar_pairs(table, 0.8)
    sets = {r["class"]: set() for r in members.collect()}
    prints = {r.doc_id: set(r.fingerprint.split()) for r in fingerprints_with_neighbours(table).collect()}
    for r in members.collect():
        sets[r["class"]] = prints[r.doc_id]
    names = [c for c in sorted(sets) if sets[c]]
    want = {
        (a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == want


# --- 9 ---


@pytest.mark.parametrize("local", [256, 8])
def test_components(docs, local, monkeypatch):
    monkeypatch.setattr(shingle_join, "LOCAL", local)
    sets = {}
    for doc, text in once():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    head = {doc: doc for doc in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                head[y] = x
    table = docs.where("doc_id IS NOT NULL AND doc_id <> 9")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(table).collect()}
    assert got == {doc: (len(sets[doc]), find(doc)) for doc in sets}
    assert len(set(map(find, sets))) < len(sets)


def test_sketches_bound_shared_shingles(monkeypatch):
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 70_000, np.uint64) * np.uint64(2)
    sets = [np.unique(pool[a : a + n]) for n in (1, 70, 260, 1000, 1100, 60_000) for a in (0, n // 10, n // 2)]
    # all in one class, so that counters of one byte are too narrow
    sets += [np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)]
    sketches = [shingle_join._sketch(x) for x in sets]
    assert {x[0] for x in sketches} == {1, 4} and len({len(x) for x in sketches}) > 4
    want, alike = set(), set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both, either = shingle_join._at_most_shared(sketches[i], sketches[j])
            n = len(np.intersect1d(a, b))
            assert n <= both and either <= len(a) + len(b) - n and both + either == len(a) + len(b)
            if 100 * both >= 80 * either:
                want.add((j, i))
            if 100 * n >= 80 * (len(a) + len(b) - n):
                alike.add((j, i))
    assert alike <= want and len(alike) > 4
    monkeypatch.setattr(shingle_join, "GRID", 1 << 16)
    frame = pd.DataFrame({"x": range(len(sets)), "label": range(len(sets)), "sketch": sketches})
    met = shingle_join._may_link(frame, 80)
    assert sorted(zip(met["x"], met["pivot"])) == sorted(want)
    side = np.arange(len(sets)) % 2 == 0
    met = shingle_join._may_link(frame.assign(label=frame["x"] // 3), 80, side)
    assert sorted(zip(met["x"], met["pivot"])) == sorted((a, b) for a, b in want if a // 3 != b // 3 and side[a] != side[b])


def test_long_texts_that_share_a_passage_are_not_measured_exactly(spark, tmp_path, monkeypatch):
    """Of texts of one length only alike ones have their sets read and moved, and no front is written twice."""
    rng = random.Random(9)
    hub = [f"h{i}" for i in range(12_000)]
    long = [[f"d{i}x{rng.random()}" for _ in range(11_940)] + hub[100 * i : 100 * i + 60] for i in range(10)]
    near = [w if j % 4000 else "other" for j, w in enumerate(long[3])]
    rows = [(i, " ".join(words)) for i, words in enumerate([hub, *long, near])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    cuts = []

    def cut(spool, df, name, write=shingle_join.TableSpool.cut):
        cuts.append((name, write(spool, df, name)))
        return cuts[-1][1]

    monkeypatch.setattr(shingle_join.TableSpool, "cut", cut)
    got = {r.doc_id: r.component_id for r in shingle_components(spark.read.parquet(f"{tmp_path}/docs"), 5, 80).collect()}
    assert got == {i: i for i in range(11)} | {11: 4}
    assert {r.row for name, df in cuts if name == "held" for r in df.collect()}
    assert sum(df.count() for name, df in cuts if name == "exact") == 1
    assert sum("front" in df.columns for _, df in cuts) == 1


def test_shingles_of_one_text_stay_out_of_the_frequencies(spark):
    """Else they fill all counters of a large table, and hot shingles look like any other."""
    shared = " ".join(f"license{i}" for i in range(50))
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) + " " + shared for i in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = shingle_join._frequencies(rows, 4)
    held = shingle_join.shingles(shared, 4)
    assert (counts[(held % np.uint64(shingle_join.COUNTERS)).astype(int)] >= 400).all()
    assert np.count_nonzero(counts) <= len(held)


def test_large_regions_take_few_rounds(spark, tmp_path, monkeypatch):
    """Members that link with few others ask in rounds that grow, not so many at a time however many there are."""
    monkeypatch.setattr(shingle_join, "LOCAL", 4)
    rng = random.Random(31)
    sets = {i: frozenset(rng.sample(range(18), 12)) for i in range(220)}
    rows = [(i, " ".join(f"w{x}" for x in held)) for i, held in sets.items()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    cuts = []

    def cut(spool, df, name, write=shingle_join.TableSpool.cut):
        cuts.append(name)
        return write(spool, df, name)

    monkeypatch.setattr(shingle_join.TableSpool, "cut", cut)
    got = shingle_components(spark.read.parquet(f"{tmp_path}/docs"), 1, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert 1 <= cuts.count("asking") <= 5


# --- 10 ---


def test_exact_dedup(docs):
    rows = exact_dedup(docs).collect()
    same = collections.defaultdict(list)
    for doc, text, *_ in ROWS:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", plain(text))].append(doc)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows)
    want = collections.Counter()
    for text, ids in same.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert sum(r.kept for r in rows) == len(same)


def test_changes(spark):
    log = [(1, False, 5, "a  b"), (2, False, 3, "a b"), (3, True, 3, "a b"), (4, False, 8, "c"), (5, True, 8, "c"), (6, None, None, "d")]
    rows = apply_changes(spark.createDataFrame(log, "seq long, deleted boolean, doc_id long, text string")).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in rows} == {(sha("a b"), 5, 1), (sha("d"), None, 1)}


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = CuckooIndex(lambda a, b: a, room=16), set()
    rng = random.Random(9)
    for i in range(3000):
        digest = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if rng.random() < 0.7:
            index.insert(digest, (1,))
            live.add(digest)
        else:
            assert index.delete(digest) == (digest in live)
            live.discard(digest)
    assert {d for d, _ in index.items()} == live and all(index.maybe(d) for d in live)
    assert index.resizes > 0 and len(index) == len(live)


def test_text_ids_are_the_library_s():
    from tokenizers import Tokenizer

    draw = random.Random(4)
    signs = "ab Z's9\t\n\r\u0085 　é٣中😀.,\x00\x1c"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(500)]
    texts += ["", "x<|endoftext|> y<|endoftext", "a" * 50_000, " " * 200_000 + "x", "\n" * 70_000]
    for name, ranked in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        library, ids = Tokenizer.from_file(tokenizer_path(name)), TextIds(tokenizer_path(name))
        assert bool(ids._by_rank) == ranked
        for text in texts:
            expected = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids(text), "<u4").tolist() == expected
