"""Collocations, quality and token alignment against brute force, on small tables with every odd case."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancia.llm import alignment, quality
from vacancia.llm.common import tokenizer_path
from vacancia.llm.phrases import best_of_each, collocations

RNG = random.Random(11)
COMMON = ["new", "york", "city", "of", "the", "and", "big", "apple", "pie"]


def sentence():
    """Words with a few fixed phrases among them."""
    words = []
    for _ in range(RNG.randint(1, 14)):
        words += RNG.choice([["new", "york", "city"], ["big", "apple"], [RNG.choice(COMMON)], ["la", "la", "la"], ["x%d" % RNG.randint(0, 40)]])
    return " ".join(words)


TEXTS = [None, "", " \t ", "...", "new york café CAFÉ", "New  YORK\tcity.New york city;new york", "a\x00b a\x00b", "日本 語 日本 語 日本 語"]
TEXTS += [RNG.choice([". ", "\n", ", "]).join(sentence() for _ in range(RNG.randint(1, 12))) for _ in range(60)]
TEXTS += [" ".join(["la"] * 500), TEXTS[9], TEXTS[9]]
SCHEMA = "doc_id long, text string, lang string, gram string, n int, score double, label int"
ROWS = [(i, t, RNG.choice(["en", "en", "fr", None]), "g", 1, 0.5, 1) for i, t in enumerate(TEXTS)]
ROWS += [(None, "new york city", "en", "g", 1, 0.5, 1), (4, "big apple", "", "g", 1, 0.5, 1)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(ROWS, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_phrases(rows, longest, least, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = {
            (q[i : i + size], n) for q, n in often.items() for size in range(2, len(q)) for i in range(len(q) - size + 1)
        }
        scored = []
        for p, a in often.items():
            if (p, a) not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, _, phrase, a, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest, least, top", [(5, 4, 1000), (5, 12, 7), (3, 2, 1000), (2, 3, 50)])
def test_phrases(docs, longest, least, top):
    found = sorted(tuple(r) for r in collocations(docs, longest, least, top).collect())
    assert found == brute_phrases(ROWS, longest, least, top)


def test_phrases_with_a_full_map(docs, monkeypatch):
    """A map in which every bit is set lets all pairs through and changes nothing."""
    from vacancia.llm import phrases

    monkeypatch.setattr(phrases, "_map_of", lambda frequent, count: np.full(1 << 13, 255, np.uint8))
    found = sorted(tuple(r) for r in collocations(docs, 5, 6, 1000).collect())
    assert found == brute_phrases(ROWS, 5, 6, 1000)


def test_phrase_scores_beyond_64_bits(spark):
    """Products of counts pass 64 bits and are exact."""
    from vacancia.llm.phrases import _scored

    graph = spark.createDataFrame(
        [("en", 2, "a b", 3 * 10**12 + 7, False), ("en", 1, "a", 4 * 10**12 + 1, True), ("en", 1, "b", 5 * 10**12 + 3, True)],
        "lang string, size int, gram string, f long, merged boolean",
    )
    n = 9 * 10**13 + 11
    row = _scored(graph, spark.createDataFrame([("en", n)], "lang string, n long"), 100).first()
    assert row["score"] == 1000 * (3 * 10**12 + 7) * n // ((4 * 10**12 + 1) * (5 * 10**12 + 3))


def test_first_rows_of_each_language(spark):
    rows = [("en", f"p{i:04d}", i % 7, 1, 1, 1, i % 3) for i in range(900)] + [("de", "x", 1, 1, 1, 1, 5)]
    scored = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    found = [(r["lang"], r["rank"], r["phrase"]) for r in best_of_each(scored, 40).collect()]
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[6], -r[2], r[1]))[:40]
    assert sorted(found) == sorted([("de", 1, "x")] + [("en", i, r[1]) for i, r in enumerate(want, 1)])


def test_phrases_of_nothing(nothing):
    assert collocations(nothing).collect() == []


# --- quality -----------------------------------------------------------------------------------


def brute_statistics(text):
    """The statistics by their names, one by one."""
    import unicodedata

    stops = ".,;:!?'\"()-"
    kind = Counter()
    for c in text:
        category = unicodedata.category(c) if ord(c) < 1 << 16 else "So"
        if c.isspace():
            kind["blank"] += 1
        elif c in stops:
            kind["stop"] += 1
        elif category in ("Lu", "Lt"):
            kind["upper"] += 1
        elif category[0] in "LM":
            kind["lower"] += 1
        else:
            kind["digit" if category[0] == "N" else "symbol"] += 1
    odds = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    words, size = text.split(), len(text)
    n = len(words)
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [m / size for m in Counter(text).values()]
    return {
        "words": math.log(1 + n),
        "word_length": math.log(1 + mean),
        "word_length_spread": math.log(1 + math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))),
        "longest_word": math.log(1 + max(lengths)),
        "upper": odds(kind["upper"], kind["upper"] + kind["lower"]),
        "digits": odds(kind["digit"], size),
        "stops": odds(kind["stop"], size),
        "symbols": odds(kind["symbol"], size),
        "blanks": odds(kind["blank"], size),
        "distinct_words": odds(len(set(words)), n),
        "top_word": odds(max(Counter(words).values(), default=0), n),
        "short_words": odds(sum(len(w) <= 3 for w in words), n),
        "marked_words": odds(sum(not w[-1].isalnum() and w[-1] not in stops for w in words), n),
        "lettered_words": odds(sum(any(c.isalpha() for c in w) for w in words), n),
        "repeated_triples": odds(len(triples) - len(set(triples)), len(triples)),
        "lines": math.log(1 + len(lines)),
        "repeated_lines": odds(len(lines) - len(set(lines)), len(lines)),
        "closed_lines": odds(sum(x.rstrip()[-1] in '.!?:;"' for x in lines), len(lines)),
        "sentence_length": math.log(1 + n / (1 + sum(text.count(c) for c in ".!?"))),
        "letter_entropy": -sum(s * math.log(s) for s in shares),
    }


@pytest.mark.parametrize("text", [t or "" for t in TEXTS[:30]] + ["ÀÉ 12 ٣ \U0001f600!! a-b\n\nx|y\nx|y", "x" * 50_000])
def test_statistics(text):
    want = brute_statistics(text)
    assert list(want) == list(quality.STATISTICS)
    assert quality.statistics(text) == pytest.approx(list(want.values()), abs=1e-9)


def test_discriminant_is_the_difference_of_normal_densities():
    rng = np.random.default_rng(3)
    p = len(quality.STATISTICS)
    groups = [rng.normal(y, 1 + y, (60 + 40 * y, p)) @ rng.normal(0, 1, (p, p)) for y in (0, 1)]
    moments = np.array([np.r_[len(g), g.sum(0), (g.T @ g).ravel()] for g in groups])
    common, sphere = 0.3, 0.1
    found = quality.Discriminant(moments, common, sphere).differences(groups[0][:5])
    scale = np.sqrt(np.diag(sum(np.cov(g.T, bias=True) * len(g) for g in groups) / 160) + 1e-6)
    pooled = sum(np.cov((g / scale).T, bias=True) * len(g) for g in groups) / 160
    want = np.full(5, math.log(100 / 60))
    for y, sign in ((0, -1), (1, 1)):
        own = (1 - common) * np.cov((groups[y] / scale).T, bias=True) + common * pooled
        own = (1 - sphere) * own + sphere * (np.trace(own) / p + 1e-3) * np.eye(p)
        off = groups[0][:5] / scale - groups[y].mean(0) / scale
        want += sign * -0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(own), off) + np.linalg.slogdet(own)[1])
    assert found == pytest.approx(want, rel=1e-6)


def clean():
    return " ".join(RNG.choice(COMMON) + RNG.choice(["", "", "."]) for _ in range(RNG.randint(30, 90)))


def junk():
    return " ".join(RNG.choice(COMMON).upper() + RNG.choice(["!!", "###", "%%"]) for _ in range(RNG.randint(30, 90)))


@pytest.fixture(scope="module")
def rated(spark):
    data = [(i, junk() if i % 4 == 0 else clean(), i % 4 != 0) for i in range(400)]
    extra = [(1000, None, None), (1001, "", None), (None, clean(), None), (1002, clean(), None), (1002, clean(), None), (1003, "w" * 9000, None)]
    docs = spark.createDataFrame(
        [(i, t, 0.5, 1, "s") for i, t, _ in data + extra], "doc_id long, text string, score double, predicted int, stats string"
    )
    labels = [(i, int(y), 0) for i, _, y in data] + [(3, 0, 0), (None, 0, 0), (5, None, 0), (1, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (t, int(y)) for i, t, y in data}


def test_quality_is_found_on_held_out_rows(rated):
    docs, labels, known = rated
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50
    assert sum(r["predicted"] == known[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0)
    same = {r["score"] for r in rows if r["doc_id"] in (1000, 1001)}
    assert len(same) == 1


def test_quality_scores_against_plain_moments(rated, spark):
    """The query's scores are those of a discriminant over moments and a curve made without Spark."""
    docs, labels, known = rated
    data = [(quality.statistics(t), 0 if i == 3 else y) for i, (t, y) in known.items() if crc32(str(i).encode()) % 5 and i != 5]
    data += [(quality.statistics(known[5][0]), 1)] if crc32(b"5") % 5 else []
    x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    moments = np.array([np.r_[(y == v).sum(), x[y == v].sum(0), (x[y == v].T @ x[y == v]).ravel()] for v in (0, 1)])
    stats = quality.document_statistics(docs)
    model = quality.learn_quality(stats, labels)
    rows = np.array([quality.statistics(t or "") for t in ("", "new york", known[8][0], known[9][0])])
    fits = [
        np.allclose(model.discriminant.differences(rows), quality.Discriminant(moments, c, s).differences(rows))
        for c in quality.COMMON
        for s in quality.SPHERE
    ]
    assert sum(fits) == 1
    a, b = model.curve
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    for i, row in ((8, rows[2]), (9, rows[3])):
        far = np.clip(model.discriminant.differences(row[None]), -quality.FARTHEST, quality.FARTHEST)[0]
        assert found[i] == pytest.approx(1 / (1 + math.exp(-np.clip(a + b * far, -30, 30))), abs=1e-6)


def test_quality_never_sees_held_out_labels(rated):
    docs, labels, _ = rated
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda y: sorted((r["doc_id"] or -1, r["score"]) for r in quality.score_quality(docs, y).collect())
    assert [s for _, s in scores(labels)] == pytest.approx([s for _, s in scores(turned)], abs=1e-8)


def test_quality_without_both_labels(rated, nothing):
    docs, labels, _ = rated
    few = docs.where("doc_id < 6")
    assert {r["score"] for r in quality.score_quality(few, labels.where("doc_id < 0")).collect()} == {0.5}
    ones = {r["score"] for r in quality.score_quality(docs, labels.where("quality = 1 AND doc_id > 5")).collect()}
    assert len(ones) == 1 and ones.pop() > 0.95
    assert quality.score_quality(nothing.select("doc_id", "text"), labels).collect() == []


# --- alignment ---------------------------------------------------------------------------------

ODD = ["▁ sign", "a  b   c ", "  lead", "tab\t x\n\n y \n", "<|endoftext|> in <s> text", "\u0085 nel 　wide", "é ﬁ ½", "\x00 \x1f x"]


def spans(ids, data):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(data[i]), i))
        at += len(data[i])
    return out


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    first, second = Tokenizer.from_file(path), SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as file:
        a_bytes = {i: bytes(byte[c] for c in name) for name, i in json.load(file)["model"]["vocab"].items() if all(c in byte for c in name)}
    b_bytes = {}
    for i in range(second.get_piece_size()):
        name = second.id_to_piece(i)
        b_bytes[i] = bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()
    counts, parts = Counter(), []
    for doc_id, text, *_ in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        whole = f" {text}".encode()
        if not text or any(b"".join(by[i] for i in ids) != whole for ids, by in ((a, a_bytes), (b, b_bytes))):
            parts.append((doc_id, 0, 0, [], []))
            continue
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        ends, low, groups, links = sorted({s[1] for s in sa} & {s[1] for s in sb}), 0, [], []
        for end in ends:
            ga, gb = [s for s in sa if low <= s[0] < end], [s for s in sb if low <= s[0] < end]
            groups.append("|".join(",".join(str(s[2]) for s in g) for g in (ga, gb)))
            links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
            low = end
        counts.update(links)
        parts.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (doc_id, a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, a, b, groups, links in parts
    ]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_alignment(spark, sent):
    rows = [r[:2] for r in ROWS[:40] + ROWS[-2:]] + [(100 + i, t) for i, t in enumerate(ODD + ["q" * 3000, ODD[1], ODD[1]])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, links string").repartition(4)
    found = [tuple(r) for r in alignment.alignments(frame, sent_pairs=sent).collect()]
    assert sorted(found, key=str) == sorted(brute_alignment(rows), key=str)


def test_alignment_of_random_texts(spark):
    signs = "aab e1.,!'\n\té日▁ ​\U0001f600<>s"
    rows = [(i, "".join(RNG.choice(signs) for _ in range(RNG.randint(1, 60)))) for i in range(300)]
    found = [tuple(r) for r in alignment.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(brute_alignment(rows))


def test_chunks_join_to_the_text():
    for text in ODD + [t or "" for t in TEXTS]:
        assert " ".join(alignment.chunks(text)) == text


def test_equal_cuts_need_no_search(monkeypatch):
    """A chunk that both sides cut alike gets its groups without looking for common ends."""
    aligner = alignment.Aligner(*alignment._paths(None, None))
    chunk = next(x for x in ("time", "people", "water") if len(aligner.second.encode([x])[0]) == len(aligner.first.encode(f" {x}")) == 1)
    monkeypatch.setattr(alignment, "slices", lambda *a: pytest.fail("searched"))
    (a,), (b,) = aligner.first.encode(f" {chunk}"), aligner.second.encode([chunk])[0]
    n_a, n_b, groups, links, written, packed = aligner.align([chunk])[0]
    assert (n_a, n_b, groups, links, written) == (1, 1, 1, 1, f"{a}|{b}")
    assert np.frombuffer(packed, aligner.kind).tolist() == [a * aligner.second.size + b]


def test_links_of_a_group_are_all_overlaps():
    for _ in range(200):
        size = RNG.randint(1, 20)
        cut = lambda: sorted({size, *(RNG.randint(1, size) for _ in range(RNG.randint(0, 6)))})
        ends = cut(), cut()
        first, second = ([e - s for s, e in zip([0, *side], side)] for side in ends)
        want = {(i, j) for i, (s, e) in enumerate(zip([0, *ends[0]], ends[0])) for j, (t, u) in enumerate(zip([0, *ends[1]], ends[1])) if s < u and t < e}
        found = set()
        for a0, a1, b0, b1 in alignment.slices(first, second):
            found |= {(a0 + i, b0 + j) for i, j in alignment.overlaps(first[a0:a1], second[b0:b1])}
        assert found == want


def test_alignment_of_nothing(nothing):
    assert alignment.alignments(nothing).collect() == []
