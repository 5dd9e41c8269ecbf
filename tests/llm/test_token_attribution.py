import random

import numpy as np
import pytest

from corpusq.llm import token_attribution as op

TEXTS = [None, "", "\n", "a\n\n\nb", "one line", "x\ny\n", "été\n\U0001f600\U0001f600\n日本\n", "  \n\t\n  deep\n", "word " * 5000 + "\n" + "tail"]


def plain(text, rule):
    """Tokens by decoding one after another; a token's characters by its bytes."""
    coder, sizes = op.load(op.TOKENIZERS)
    text = text or ""
    owner, place = [], []
    section = 0
    for i, c in enumerate(text):
        owner += [section]
        place += [i] * len(c.encode())
        section += c == "\n"
    sections = max(owner) + 1 if owner else 1
    counts, at = [0] * sections, 0
    for t in coder.encode_ordinary(text):
        chars = list(dict.fromkeys(place[at : at + sizes[t]]))
        at += sizes[t]
        own = [owner[c] for c in chars]
        pick = own[0] if rule == "first" else own[-1] if rule == "last" else max(dict.fromkeys(own), key=own.count)
        counts[pick] += 1
    return counts


@pytest.mark.parametrize("rule", op.RULES)
def test_counts_equal_plain_ones(spark, rule):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("ab \n\né\U0001f600", k=60)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, section long")
    got = {}
    for r in op.token_counts(df, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        assert [r.n_tokens for r in got[i]] == plain(t, rule)
        assert [(r.start, r.end) for r in got[i]] == list(zip([0, *np.cumsum([len(x) for x in (t or "").splitlines(keepends=True)])[:-1]], np.cumsum([len(x) for x in (t or "").splitlines(keepends=True)]))) or not t


def test_crossing_tokens_go_by_the_rule():
    raw = np.frombuffer(b"abcdef", np.uint8)
    for rule, want in (("first", [2, 1]), ("last", [1, 2]), ("most", [1, 2])):
        assert op.attribute(raw, np.array([1, 4, 6]), np.array([0, 2]), rule)[0].tolist() == want
    with pytest.raises(ValueError):
        op.attribute(raw, np.array([6]), np.array([0]), "none")


def test_empty_table_and_repeats(spark):
    assert op.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op.token_counts(spark.createDataFrame([(None, "a\nb")] * 2, "doc_id long, text string")).count() == 4


def test_cut_runs_give_the_same_tokens():
    """Pieces cut at runs encode as the whole text does, wherever the runs are."""
    coder, _ = op.load(op.TOKENIZERS)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "\u00a0", "\n", "1", "!", "  ", " " * 12, "\t" * 9, "\u00a0" * 11]) for _ in range(30))
        pieces = [x for x in op.whole_pieces(text, 10_000)]
        assert pieces == [text]
        for run in (8, 40):
            pieces = list(op.whole_pieces(text, run))
            assert "".join(pieces) == text
    text = "one" + " " * 90 + "two"
    assert [t for x in op.whole_pieces(text, 89) for t in coder.encode_ordinary(x)] == coder.encode_ordinary(text)


def test_very_long_runs_and_clashing_columns(spark):
    texts = [" " * 2_000_000 + "x", "\u00a0" * 2_000_000, "y" * 5_000_000, "word " * 1_000_000]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, id int, section int, n_tokens int")
    rows = op.token_counts(df).collect()
    assert [(r.start, r.end) for r in sorted(rows, key=lambda r: r.doc_id)] == [(0, len(t)) for t in texts] and all(r.n_tokens > 0 for r in rows)


@pytest.mark.parametrize("rule", op.RULES)
def test_fields_equal_plain_counts(spark, rule):
    """Fields are sections of one document; tokens across them go by the rule, none to empty ones."""
    rng = random.Random(12)
    part = lambda: rng.choice([None, "", "".join(rng.choices("ab é\U0001f600", k=rng.randint(1, 9)))])
    rows = [(i, part(), part(), part()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, sizes string")
    got = {}
    for r in op.token_counts(df, rule=rule, fields=("title", "body", "sizes")).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    coder, sizes = op.load(op.TOKENIZERS)
    for i, *fields in rows:
        owner, place = [], []
        for f, text in enumerate(fields):
            for c in text or "":
                owner.append(f)
                place += [len(owner) - 1] * len(c.encode())
        counts, at = [0, 0, 0], 0
        for t in coder.encode_ordinary("".join(x or "" for x in fields)):
            own = [owner[c] for c in dict.fromkeys(place[at : at + sizes[t]])]
            at += sizes[t]
            counts[own[0] if rule == "first" else own[-1] if rule == "last" else max(dict.fromkeys(own), key=own.count)] += 1
        assert [r.n_tokens for r in got[i]] == counts and [r.end - r.start for r in got[i]] == [len(x or "") for x in fields]
