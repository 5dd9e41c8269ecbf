import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from corpusq.llm import covering_simhash as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_the_plain_ones():
    texts = [None, "", " \t", "One", "one two", "A b  C\nd\x0be", "Üb ÉÀ z A", "x " * 3000, "a b c a b c", "\x1cq \x85 r"] + [
        " ".join(random.Random(i).choices("AB cd efg HIJ é".split(), k=i)) for i in range(40)
    ]
    got = op.fingerprint_batch(pa.array(texts)).view(np.uint64).tolist()
    assert got == [plain_fingerprint(t) for t in texts]


def test_every_pair_within_the_radius_shares_a_table():
    masks, rng = op.covering_masks(3), random.Random(1)
    assert len(masks) == 15
    for _ in range(20000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(flip & m == 0 for m in masks)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id string")
    return {(r.doc_id, r.component_id) for r in op.near_duplicates(df, **more).collect()}


def test_edge_rows_and_clashing_columns(spark):
    rows = [(5, None, 1, "x"), (4, "", 2, "y"), (4, "", 2, "y"), (None, "a b c d", 3, None), (9, "A B c d", 3, None), (7, "q r s t u v w", 1, None)]
    assert run(spark, rows) == {(5, 4), (4, 4), (None, 9), (9, 9), (7, 7)}
    assert run(spark, []) == set()


def test_links_with_hot_buckets_equal_brute_force(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(150)}
    fps = sorted(op.signed(f) for f in fps)
    want = plain_components([f & (1 << 64) - 1 for f in fps])
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (1024, 8):
        links = op.near_links(nodes, bucket=bucket)
        found = {r.node: r.root for r in op.connected_components(links).collect()}
        assert [fps.index(found.get(f, f)) for f in fps] == want


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, plain_components(fps))}
    assert {tuple(r) for r in op.near_duplicates(docs).collect()} == want
    kept = {r.doc_id for r in op.keep_one(docs).select("doc_id").collect()}
    texts = [(r.doc_id, r.text) for r in rows]
    assert kept == kept_by_brute_force(texts)
    twice = docs.union(docs).withColumn("_kept", F.lit(1))
    assert op.keep_one(twice).count() == len(kept)


def shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows):
    """Ids that stay if all pairs of texts are compared by their five-word shingles; ids differ and are in order."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}


def test_near_copies_by_five_words_and_similarity(spark):
    """Recall of pairs at 0.8 and above, and nothing below it; one hot group of near copies; short and clashing rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = []
    for i in range(150):
        base = [word() for _ in range(rng.randint(5, 300))]
        near = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 45))):
            near[rng.randrange(len(near))] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    hot = [word() for _ in range(80)]
    rows += [(1000 + i, " ".join([*hot[: rng.randrange(75, 80)], word()])) for i in range(120)]
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "two one"), (2003, None), (2004, " "), (2005, "x" * 2_000_000), (2006, " " * 2_000_000)]
    df = spark.createDataFrame([(i, t, *[1] * 6) for i, t in rows], "doc_id long, text string, h int, n int, key int, least int, _id int, k0 int")
    want, got = kept_by_brute_force(rows), {r.doc_id for r in op.keep_one(df).select("doc_id").collect()}
    assert got >= want  # nothing goes that has no like text
    missed, pairs = len(got) - len(want), len(rows) - len(want)
    assert missed <= 0.1 * pairs, (missed, pairs)


def test_covering_tables_bring_every_pair_within_the_radius(spark, monkeypatch):
    """With no block fingerprints at all, keep_one still finds the like texts whose fingerprints differ in three bits or fewer."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-1] + ["other"]))]
    _, of, grams = op.shingle_sets(pa.array([t for _, t in rows]))
    fps = op.majority(grams.astype(">u8"), of, np.zeros(len(rows), np.int64)).view(np.uint64).tolist()
    want = {i for i, _ in rows if i % 2 == 0 or bin(fps[i] ^ fps[i - 1]).count("1") > 3}
    none = lambda n, of, grams: (np.zeros((n, 5), np.uint64), np.zeros((n, 5), bool))
    monkeypatch.setattr(op, "block_prints", none)
    assert {r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()} == want
    assert len(want) < 90


def test_keep_one_keeps_a_row_of_every_group(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue black white", "north east south west"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[2]), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _th int")
    out = op.keep_one(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, "")], key=repr)
