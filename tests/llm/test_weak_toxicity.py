import random
import zlib

import numpy as np

from corpusq.llm import weak_toxicity as op


def rows(n=500, seed=3):
    """Texts whose label follows invented insults, with some labels wrong."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zorgle", "zorglent", "Zorglin,", "vexplat", "idiot"])
        out.append((i, " ".join(words), int(toxic) ^ (rng.random() < 0.03), toxic))
    return out


def tables(spark, data):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, *_ in data] + [(None, None, "en", "s"), (9000, "", "en", "s"), (9001, "", "en", "s")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    data = rows()
    got = {r.doc_id: r for r in op.toxicity(*tables(spark, data)).collect() if r.doc_id is not None and r.doc_id < 9000}
    truth = {i: toxic for i, _, _, toxic in data}
    held = [i for i, r in got.items() if r.held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    data = rows(200)
    docs, labels = tables(spark, data)
    flipped = labels.selectExpr("doc_id", f"case when pmod(crc32(cast(cast(doc_id as string) as binary)), {op.FOLDS}) = 0 then 1 - toxic else toxic end as toxic")
    score = lambda l: {(r.doc_id, r.score) for r in op.toxicity(docs, l).collect()}
    assert score(labels) == score(flipped)


def test_without_labels_the_given_lexicons_decide(spark):
    docs = spark.createDataFrame([(1, "you IDIOT"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in op.toxicity(docs, none).collect()} == {1: 1, 2: 0, 3: 0}
    kept = op.keep_civil(docs, none)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert op.toxicity(docs.limit(0), none).count() == 0


def made_votes(seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.random(4000) < 0.3
    some = lambda p, q: np.where(truth, rng.random(4000) < p, rng.random(4000) < q)
    noisy = some(0.5, 0.4)
    return truth, np.c_[some(0.8, 0.05), some(0.7, 0.1), some(0.6, 0.05), noisy, noisy, noisy, noisy].astype(bool)  # four copies of one weak voter


def test_label_model_weighs_correlated_voters_once():
    truth, votes = made_votes()
    post = op.label_model(votes, np.ones(7), 0.3)
    right = ((post > 0.5) == truth).mean()
    assert right > 0.88  # a linear rule fitted to the truth itself reaches 0.926
    counted = votes.sum(axis=1)
    assert right > 0.05 + max(((counted > t) == truth).mean() for t in range(7))


def test_posterior_does_not_follow_wrong_labels(spark, monkeypatch):
    """With a tenth of the labels flipped, posteriors stay with the truth; and the result comes through them."""
    seen = []
    model = op.label_model
    monkeypatch.setattr(op, "label_model", lambda *a: seen.append(model(*a)) or seen[-1])
    data = rows(600)
    docs, labels = tables(spark, data)
    flipped = labels.selectExpr("doc_id", "case when pmod(xxhash64(doc_id), 10) = 0 then 1 - toxic else toxic end as toxic")
    score = lambda l: {r.doc_id: r.predicted for r in op.toxicity(docs, l).collect() if r.doc_id is not None and r.doc_id < 9000}
    right, wrong = score(labels), score(flipped)
    truth = {i: toxic for i, _, _, toxic in data}
    assert np.mean([wrong[i] == t for i, t in truth.items()]) > 0.92
    assert np.mean([wrong[i] == right[i] for i in truth]) > 0.95
    monkeypatch.setattr(op, "label_model", lambda votes, sides, share: 1 - model(votes, sides, share))
    turned = score(labels)
    assert np.mean([turned[i] != right[i] for i in truth]) > 0.9


def test_scores_equal_a_plain_version(spark):
    """Every text's score is the logistic of its terms' weights and the constant."""
    import math
    import re

    docs, labels = tables(spark, rows(300))
    terms, weights = op.fit(docs, labels)
    got = {r.doc_id: r for r in op.toxicity(docs, labels).collect() if r.doc_id is not None}
    for r in docs.where("doc_id is not null").collect():
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", r.text.lower())}
        held = {t for t in terms if t in words or (t.endswith("-") and any(w.startswith(t[:-1]) and len(w) > len(t) - 1 for w in words))}
        z = weights[-1] + sum(weights[terms.index(t)] for t in held)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-9


def test_clashing_columns_repeats_and_long_texts(spark):
    texts = ["idiot " * 400_000, " " * 2_000_000, "x" * 5_000_000, "a fine day", "a fine day"]
    df = spark.createDataFrame([(7 if i > 2 else i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, toxic int, _toxic int, id int")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(9)], "doc_id long, toxic int, id int")
    assert len(op.toxicity(df, labels).collect()) == 5
    assert op.keep_civil(df, labels).columns == df.columns
