import hashlib
import random

import numpy as np
import pytest

from corpusq.llm import suffix_dedup as op


def plain(texts, window):
    """Mark every byte of every window that starts in two places or more."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - window + 1):
            seen.setdefault(b[s : s + window], []).append((i, s))
    marks = [np.zeros(len(b) + 1, bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                marks[i][s : s + window] = True
    out = []
    for b, m in zip(raw, marks):
        m = m[: len(b)]
        spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(m.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return out


def texts_with_repeats(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé ", k=rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(8)]
    out = [None, "", "x" * 39, "y" * 40, "z" * 41, "z" * 500, "ab" * 90]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool) if rng.random() < 0.6 else word() * rng.randint(1, 20)
            a = rng.randint(0, len(p) // 2)
            p = p[a : rng.randint(a, len(p))]
            if rng.random() < 0.5 and len(p) > 30:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts.append(p)
        out.append("".join(parts))
    out += rng.sample(out, 5)
    return out


@pytest.mark.parametrize("most", [20_000, 6])
def test_digests_equal_brute_force(spark, most):
    for seed in (1, 2):
        texts = texts_with_repeats(seed)
        rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, key string, pos long")
        got = [tuple(r)[1:5] for r in op.suffix_dedup(df, window=40, gram=8, most=most).collect()]
        assert sorted(got) == sorted(plain(texts, 40))


def test_groups_are_maximal_and_whole(spark):
    a, b = "q" + "".join(random.Random(5).choices("abcdefgh", k=70)), "".join(random.Random(6).choices("ijklmnop", k=60))
    texts = ["1" + a + b + "2", "3" + a + "4", "5" + b + "6", "7" + a + b + "8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in op.repeat_groups(df, window=40, gram=8).collect():
        groups.setdefault(r.repeat, []).append(r)
    assert groups
    for rows in groups.values():
        found = {texts[r.doc_id][r.start : r.start + r.n_bytes] for r in rows}
        assert len(found) == 1 and rows[0].n_occurrences == len(rows)
        s = found.pop()
        assert len(rows) == sum(t.count(s) for t in texts)


def test_intervals_of_a_known_array():
    assert sorted(op.intervals([1, 3, 0, 2])) == [(0, 0, 4), (1, 0, 2), (2, 3, 4), (3, 1, 2)]


def test_empty_table(spark):
    assert op.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {(r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows], 400))}
    got = {tuple(r)[:5] for r in op.suffix_dedup(docs).collect()}
    assert got == want and any(w[2] for w in want)
