import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusq.llm import lattice_lm as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def segmentations(text, pieces):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in pieces:
            for rest in segmentations(text[k:], pieces):
                yield [head, *rest]
        elif k == 1:
            for rest in segmentations(text[1:], pieces):
                yield [*(f"<{b}>" for b in head.encode()), *rest]


@pytest.fixture(scope="module")
def lattice():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab", "c", "abc"]
    fallback = [f"<{b}>" for b in range(256)]
    weights = np.array([random.Random(7).random() + 0.01 for _ in range(len(pieces) + 257)])
    return op.Lattice(pieces, fallback, 3, weights), pieces, fallback, weights / weights.sum()


@pytest.mark.parametrize("word", ["a", "abab", "babc", "é", "aéb", "abcabcab", "zz"])
def test_forward_and_expectation_equal_enumeration(lattice, word):
    model, pieces, fallback, p = lattice
    number = {x: i for i, x in enumerate([*pieces, *fallback])}
    paths = [[number[x] for x in s] for s in segmentations("▁" + word, set(pieces))]
    mass = [math.prod(p[i] for i in path) for path in paths]
    assert model.forward(word) == pytest.approx(math.log(sum(mass)), abs=1e-9)
    uses = Counter()
    for path, m in zip(paths, mass):
        for i in path:
            uses[i] += 3 * m / sum(mass)
    got = [0.0] * (len(p))
    model.expect(word, 3.0, got)
    assert {i: v for i, v in enumerate(got) if v > 1e-12} == pytest.approx(dict(uses))


def test_long_words_do_not_underflow(lattice):
    model, _, _, p = lattice
    assert math.isfinite(model.forward("ab" * 5000)) and model.forward("q" * 3000) < -5000
    got = [0.0] * len(p)
    model.expect("ab" * 3000, 1.0, got)
    assert all(map(math.isfinite, got)) and sum(got) > 1000


def test_base_scores_equal_plain_ones(spark):
    rng = random.Random(2)
    texts = [None, "", "A b", "é É", "x" * 500] + [" ".join(rng.choices("Aa bb cc dd ee zz".split(), k=rng.randint(0, 30))) for _ in range(40)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "again again", "c", 2), (None, "bb none", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row int")
    docs = [(i, WORD.findall(low(t)), zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    counts = Counter(w for _, ws, held in docs if not held for w in ws)
    ends = sum(not held for *_, held in docs)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, ws, held in docs:
        score = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws) + math.log10((ends + 1) / (total + kinds + 1))
        want.append((i, held, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total, round(score, 6)))
    got = op.lm_scores(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert op.lm_scores(df.limit(0)).count() == 0


def test_scores_prefer_text_like_the_training_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = docs.where("length(text) > 500").orderBy("doc_id").first()
    letters = list(one.text)
    random.Random(1).shuffle(letters)
    more = spark.createDataFrame([(-1, "".join(letters)), (-2, one.text)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.lm_scores(docs.union(more)).collect()}
    assert got[-2].score / got[-2].n_tokens > got[-1].score / got[-1].n_tokens


def test_many_words_at_once_equal_one_by_one(lattice):
    model, _, _, p = lattice
    rng = random.Random(3)
    words = ["".join(rng.choices("abcéz\U0001f600", k=rng.randint(1, 75))) for _ in range(400)] + ["a", "a"]
    counts = np.array([rng.randint(1, 9) for _ in words])
    assert op.log_scores(model, words) == pytest.approx([model.forward(w) for w in words])
    want, got = [0.0] * len(p), np.zeros(len(p))
    for w, c in zip(words, counts.tolist()):
        model.expect(w, float(c), want)
    op.add_expected(model, words, counts, got)
    assert got == pytest.approx(np.array(want), rel=1e-9, abs=1e-9)
    assert len(op.log_scores(model, [])) == 0


def test_many_lattices_cost_a_fraction_of_as_many_single_ones():
    """Arcs of many words are those of each word alone, and finding them does not step through places one by one."""
    pieces, fallback, longest = op.vocabulary()
    model = op.Lattice(pieces, fallback, longest, 1.0 / np.arange(1, len(pieces) + 258))
    rng = random.Random(5)
    words = ["".join(rng.choices(pieces, k=rng.randint(1, 4)))[:60] + rng.choice(["", "é", "\U0001f600", "\0"]) for _ in range(20_000)]
    some = op.Lattices(model, words[:300])
    got = sorted(zip(some.word.tolist(), some.start.tolist(), some.end.tolist()))
    assert got == [(k, i, j) for k, w in enumerate(words[:300]) for t in [op.SPACE + w] for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in model.ids or j == i + 1]
    seconds = []
    for score in (lambda: op.log_scores(model, words), lambda: np.array([model.forward(w) for w in words])):
        best = math.inf
        for _ in range(2):
            began = time.process_time()
            found = score()
            best = min(best, time.process_time() - began)
        seconds.append((best, found))
    (many, got), (single, want) = seconds
    assert got == pytest.approx(want)
    assert many < 0.4 * single, (many, single)


def test_scores_equal_a_plain_version(spark, sf_dir):
    """Every text's score by word-by-word recursions with weights learned word by word."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    docs = [(r.doc_id, WORD.findall(low(r.text)), zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in df.collect()]
    counts = Counter(w for _, ws, held in docs if not held for w in ws)
    pieces, fallback, longest = op.vocabulary()
    size = len(pieces) + 257
    weights = 1.0 / np.arange(1, size + 1)
    weights[-1] = 0.01
    for _ in range(op.ROUNDS):
        model, into = op.Lattice(pieces, fallback, longest, weights), [0.0] * size
        for w, c in counts.items():
            model.expect(w, float(c), into)
        weights = np.full(size, op.PRIOR) + into
        weights[-1] += sum(not held for *_, held in docs)
    model = op.Lattice(pieces, fallback, longest, weights)
    want = {i: (sum(map(model.forward, ws)) + model.end) / math.log(10) for i, ws, _ in docs}
    got = {r.doc_id: r.score for r in op.lm_scores(df).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_very_long_words_clashing_columns_and_batches_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(op, "BATCH_BYTES", 1000)
    texts = [" " * 2_000_000, " " * 200_000, "y" * 500_000, "word " * 200_000, "a b", "a b"]
    df = spark.createDataFrame([(i, t, *[1] * 6) for i, t in enumerate(texts)], "doc_id long, text string, hot int, word int, m int, c int, held int, n int")
    got = {r.doc_id: r for r in op.lm_scores(df).collect()}
    assert [got[i].n_tokens for i in range(6)] == [1, 2, 2, 200_001, 3, 3] and got[4].score == got[5].score
