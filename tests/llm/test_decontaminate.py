import random
import re

import numpy as np
import pyarrow as pa

from corpusq.llm import decontaminate as op

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]


def plain(a, b):
    """Smith-Waterman by cells."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_words_equal_plain_ones():
    texts = ["A-b, c.D é", "", None, "x", "É1 ?", "...", "end"]
    h, row = op.words_of(*op.text_buffer(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert row.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    assert [flat.index(w) for w in flat] == [h.tolist().index(x) for x in h.tolist()]


def test_alignment_scores_equal_plain_ones():
    rng = random.Random(1)
    pairs = []
    for _ in range(60):
        a = [rng.randrange(8) for _ in range(rng.randint(1, 30))]
        b = [rng.randrange(8) for _ in range(rng.randint(1, 40))] + (a[3:] if rng.random() < 0.5 else [])
        pairs.append((a, b))
    score, begin, stop = op.align_all([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    for (a, b), s, x, y in zip(pairs, score, begin, stop):
        assert s == plain(a, b) and s == plain(a, b[x:y])


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(800)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, make(rng.randint(14, 50))) for i in range(12)]
    docs, leaks = [], set()
    for d in range(80):
        body = make(rng.randint(0, 200))
        if d % 4 == 0:
            i, passage = rng.choice(items)
            passage = list(passage)
            for _ in range(len(passage) // 10 if d % 8 else 0):
                k = rng.randrange(len(passage))
                passage[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [passage[k], rng.choice(vocabulary)]])
            at = rng.randint(0, len(body))
            body[at:at] = passage
            leaks.add((d, i))
        docs.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in body)))
    return docs, [(i, ", ".join(w)) for i, w in items], leaks


def test_planted_copies_are_found_and_nothing_else(spark):
    docs, items, leaks = corpus()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "short text")], "doc_id long, text string").selectExpr("*", "'x' as item", "1 as score")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in op.leaks(d, b).collect()}
    assert set(got) == leaks
    for (i, j), r in got.items():
        text, item = words(dict(docs)[i]), words(dict(items)[j])
        assert abs(r.score - plain(item, text) / (2 * len(item))) < 1e-9
        assert plain(item, text[r.first_word : r.end_word]) == plain(item, text)
    kept = op.keep_clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in leaks} | {900, 901, 902}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, leaks = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = op.build_indexes
    monkeypatch.setattr(op, "build_indexes", lambda *a: whole(*a, most=4))
    assert {(r.doc_id, r.item_id) for r in op.leaks(d, b).collect()} == leaks


def test_empty_tables_and_short_items(spark):
    d = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "six one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.leaks(d, none).count() == 0 and op.keep_clean(d, none).count() == 3
    assert op.leaks(d.limit(0), none).count() == 0
    short = spark.createDataFrame([(7, "Two, three!")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in op.leaks(d, short).collect()] == [(1, 7, 1.0)] * 2


def test_every_alignment_at_the_threshold_is_found(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [make(16), *(make(n) for n in [1, 2, 3, 4, 5, 6, 7, 15, 15, 25, 40, 59])]
    spaced = list(items[0])
    for k in (4, 9, 14):
        spaced[k] = "other"
    texts = [make(10) + spaced + make(10)]
    assert not {tuple(spaced[i : i + 5]) for i in range(12)} & {tuple(items[0][i : i + 5]) for i in range(12)}
    for i in range(240):
        passage = list(items[i % len(items)])
        kinds = rng.choice(["s", "i", "d", "sid"])
        for _ in range(rng.randint(0, 1 + (len(passage) * 3) // (4 if kinds == "i" else 8))):
            k, kind = rng.randrange(len(passage)), rng.choice(kinds)
            passage[k : k + 1] = {"s": make(1), "i": [passage[k], *make(1)], "d": []}[kind] or passage[k : k + 1][: len(passage) == 1]
        texts.append(make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30)))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in op.leaks(d, b).collect()}
    want = {(i, j): plain(item, t) / (2 * len(item)) for i, t in enumerate(texts) for j, item in enumerate(items)}
    assert (0, 0) in got and got == {k: x for k, x in want.items() if x >= 0.6}


def test_whole_table_equals_brute_force(spark, sf_dir):
    """All items against all texts under 6,000 characters; only what shares too few words to reach the threshold is not aligned."""
    from collections import Counter

    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    texts = {r.doc_id: words(r.text) for r in docs.where("length(text) < 6000").collect()}
    asked = {r.item_id: words(r.text) for r in items.collect()}
    bags = {i: Counter(w) for i, w in texts.items()}
    want = set()
    for item, w in asked.items():
        bag = Counter(w)
        for i, own in bags.items():
            if sum(min(n, own[x]) for x, n in bag.items() if x in own) >= 0.6 * len(w) and plain(w, texts[i]) >= 0.6 * 2 * len(w):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in op.leaks(docs, items).collect() if r.doc_id in texts}
    assert want and got == want
