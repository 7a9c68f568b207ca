"""The pipeline's stages, and all of them in a row, against brute force."""

import collections
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from vacancia.llm.common import tokenizer_path  # noqa: E402
from vacancia.llm.toxicity import learn  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)


def word():
    return "".join(RNG.choice("bcdfghaeiou") for _ in range(RNG.randint(3, 8)))


def changed(words, *places):
    return " ".join(f"x{word()}" if i in places else w for i, w in enumerate(words))


PLAIN = [f"w{i}" for i in range(100)]
NEAR = [word() for _ in range(120)]


def _texts():
    # 86 of 106 shingles of five words are shared, but only 89 of 105 of four words
    texts = [" ".join(PLAIN), changed(PLAIN, 30, 60)]
    texts += [changed(NEAR, *RNG.sample(range(120), RNG.randint(0, 5))) for _ in range(12)]
    texts += [None, "", "\n", "one", "two words", "Two  Words"]
    texts += ["\n".join([" ".join(word() for _ in range(12)), "a line that many documents share", word()]) for _ in range(6)]
    texts += [f'{word()} {word()} password = "hunter{i}22x" {"0af" * 9} AKIA{"A1" * 9}' for i in range(3)]
    for i in range(160):
        words = [word() for _ in range(25)]
        words[3:5] = ["vile", "scum"] if i % 4 == 0 else words[3:5]
        texts.append(" ".join(words))
    return texts


TEXTS = _texts()
ROWS = [(3 * i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
LABELS = [(3 * i, int("vile scum" in (t or ""))) for i, t in enumerate(TEXTS) if i % 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").withColumnRenamed("quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return P.documents(spark, folder)


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.select(*P.COLUMNS).collect())


def toxic_out(rows, model):
    return [r for r in rows if model.score(r[1] or "")[0] < 0.5]


def lines_out(rows):
    """Later copies of runs of 1, 2, 4, ... lines with ten characters or more, in the order of ids."""
    gone, size = collections.defaultdict(set), 1
    split = {r[0]: (r[1] or "").split("\n") for r in sorted(rows)}
    while size <= max(map(len, split.values())):
        seen = set()
        for doc, lines in split.items():
            for at in range(len(lines) - size + 1):
                run = tuple(lines[at : at + size])
                if run in seen and sum(map(len, run)) >= 10:
                    gone[doc].update(range(at, at + size))
                seen.add(run)
        size *= 2
    out = []
    for doc, text, lang, source, n in rows:
        if len(gone[doc]) < len(split[doc]):
            kept = "\n".join(x for i, x in enumerate(split[doc]) if i not in gone[doc])
            out.append((doc, kept, lang, source, len(kept)) if gone[doc] else (doc, text, lang, source, n))
    return out


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


def copies_out(rows):
    """One row of each group that links of 80 % of five-word shingles reach: the smallest id, nulls last."""
    sets = [shingle_set(r[1]) for r in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


SECRETS = (
    (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
)


def secrets_out(rows):
    out = []
    for doc, text, lang, source, n in rows:
        found = sorted(m.span() for p, group, least in SECRETS for m in re.finditer(p, text or "") if len(m[group]) >= least)
        if found:
            parts, at = [], 0
            for start, stop in found:
                if start >= at:
                    parts += [text[at:start], P.MASK]
                at = max(at, stop)
            text = "".join(parts) + text[at:]
            n = len(text)
        out.append((doc, text, lang, source, n))
    return out


def pieces(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


def packed(frame):
    return collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())


def plain(rows):
    """Null texts as the stages give them to the next one."""
    return collections.Counter((d, t or "", *rest[:2], rest[2] or 0) for d, t, *rest in rows)


def test_stage_toxicity(spark, folder, docs):
    model = learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = toxic_out(ROWS, model)
    assert plain(rows_of(P.drop_toxic(spark, docs, folder)).elements()) == plain(want)
    assert len(ROWS) > len(want) > 100


def test_stage_lines(spark, folder, docs):
    want = lines_out(ROWS)
    assert plain(rows_of(P.drop_repeated_lines(spark, docs, folder)).elements()) == plain(want)
    assert set(want) != set(ROWS)


def test_stage_near_copies(spark, folder, docs):
    got = rows_of(P.drop_near_copies(spark, docs, folder))
    assert got == collections.Counter(copies_out(ROWS))
    assert 0 in {r[0] for r in got} and 3 not in {r[0] for r in got}


def test_stage_secrets(spark, folder, docs):
    want = secrets_out(ROWS)
    assert plain(rows_of(P.mask_secrets(spark, docs, folder)).elements()) == plain(want)
    assert sum(P.MASK in (r[1] or "") for r in want) == 3


def test_stage_packing(spark, folder, docs):
    assert packed(P.pack_sequences(spark, docs, folder)) == pieces(ROWS)


def test_run(spark, folder, docs):
    model = learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = secrets_out(copies_out(lines_out(toxic_out(ROWS, model))))
    assert packed(P.run(spark, folder)) == pieces(want)


def test_near_copies_shuffle_dropped_texts_only(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "may_match", lambda *a, match=P.may_match: seen.append(match(*a)) or seen[-1])
    left = P.drop_near_copies(spark, docs, "").count()
    assert len(seen) == 1 and seen[0].count() == len(ROWS)
    assert len(ROWS) - left <= seen[0].where("may").count() < len(ROWS) - left + 3


def test_stages_carry_a_text_once(spark, docs):
    """Shuffled rows of line dedup and secret scans hold one copy of the text, and scans shuffle candidates only."""
    for stage in (P.drop_repeated_lines, P.mask_secrets):
        plan = stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
        inputs = [line for line in plan.split("\n") if "Project" in line and "AS kept_" in line]
        assert inputs and not any(re.search(r"text#\d+ AS kept_", line) for line in inputs)
    assert " may#" in plan or "bits#" in plan


def test_near_copies_of_repeated_and_null_ids(spark, tmp_path):
    near, other = changed(NEAR, 7), " ".join(word() for _ in range(30))
    ids = [(5, " ".join(NEAR)), (5, other), (2, near), (7, " ".join(PLAIN)), (7, " ".join(PLAIN)), (None, other), (None, "a lone text here")]
    ids += [(None, f"{NEAR[0]} alone"), (None, f"{NEAR[0]} alone"), (9, None), (9, ""), (None, " ")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in ids]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    wordless = [r for r in rows if not shingle_set(r[1])]
    want = collections.Counter(copies_out([r for r in rows if shingle_set(r[1])]) + wordless)
    assert rows_of(P.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), "")) == want
