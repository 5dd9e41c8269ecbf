import re

from pyspark.sql import functions as F

from corpusq.llm import fertility as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


TEXTS = [None, "", "\n\n", "a", "a b c d e a b c d e", "a\nb\na\n\n \n \nb", "é ü\x85x\x1c y", "<b>#%</b>|", "one two three four five six seven eight nine ten",
         "x\n" * 50, "w " * 4000, "\ta\n\ta\n a", "日本語 テキスト です " * 10, "a" * 50_000, "end\n"]


def test_base_counts_equal_plain_ones(spark):
    rows = [(i, t, "xx" if i % 3 else None, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = {r.doc_id: tuple(r)[1:7] for r in op.quality_rules(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_token_counts_equal_those_of_each_word(spark):
    coder = op.Encoder(op.TOKENIZERS)
    rows = {r.id: r for r in op.measure(spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")).collect()}
    for i, text in enumerate(TEXTS):
        ids = [x for w in WORD.findall(text or "") for x in coder.pieces.encode(w)]
        assert rows[i].n_tokens == len(ids)
        assert rows[i].n_fallback == sum(coder.pieces.is_byte(x) or coder.pieces.is_unknown(x) for x in ids)
        assert rows[i].n_byte_tokens == sum(len(coder.bytes.encode_ordinary(" " + w)) for w in WORD.findall(text or ""))


def test_odd_documents_leave_their_language_band(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, " ".join(f"\U0001f9ffᚠ{chr(0x1780 + i % 90)}" for i in range(200)), "en"), (-2, " ".join(f"x{i * 7919 % 9973}q9z8" for i in range(300)), "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in op.quality_rules(docs.union(odd)).collect()}
    assert not out[-1].kept and "fallback_share" in out[-1].reasons
    assert not out[-2].kept and not out[-2].base_failed
    kept = [r.kept for i, r in out.items() if i >= 0 and not r.base_failed]
    assert sum(kept) > 0.85 * len(kept)


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.quality_rules(empty).count() == 0
    twice = spark.createDataFrame([(None, "a b c", "en")] * 2, "doc_id long, text string, lang string")
    assert op.quality_rules(twice).where(F.col("base_failed")).count() == 2


def test_very_long_runs_and_clashing_columns(spark):
    texts = ["\u00a0" * 2_000_000, " " * 2_000_000, "z" * 5_000_000, "word " * 500_000]
    df = spark.createDataFrame([(i, t, "xx", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, id int, q_entropy_gap int, reasons int")
    got = {r.doc_id: r for r in op.quality_rules(df).collect()}
    assert [got[i].n_words for i in range(4)] == [1, 0, 1, 500_000] and not any(r.kept for r in got.values())


def test_verdicts_equal_plain_ones(spark):
    """Entropy, bands and verdicts of a table against a version in plain Python."""
    import math
    import random
    from collections import Counter

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else word() for _ in range(rng.randint(12, 400))), rng.choice(["aa", None])) for i in range(120)]
    rows += [(200, " ".join(chr(0x1200 + rng.randrange(80)) * 3 for _ in range(60)), "aa"), (201, " ".join(f"{word()}#{i}" for i in range(60)) + " \u2603" * 80, "aa"), (202, "tiny", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    coder = op.Encoder(op.TOKENIZERS)
    measured = {}
    for i, text, lang in rows:
        n, chars, _, _, repeated, failed = plain(text)
        ids = [t for w in WORD.findall(text) for t in coder.pieces.encode(w)]
        n_bytes = sum(len(coder.bytes.encode_ordinary(" " + w)) for w in WORD.findall(text))
        h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        m = {"chars_per_token": chars / len(ids), "bytes_per_token": chars / n_bytes, "fallback_share": sum(bool(coder.fallback[t]) for t in ids) / len(ids), "entropy_gap": 1 - h / math.log2(len(ids)) if len(ids) > 1 else None}
        measured[i] = lang or "", n, failed, m
    want = {}
    for i, (lang, n, failed, m) in measured.items():
        reasons = []
        for name, floor in op.FLOORS.items():
            values = sorted(x[3][name] for x in measured.values() if x[0] == lang and not x[2] and x[3][name] is not None)
            low, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.75))
            width = max(op.REACH * (high - low), floor) * max(1.0, math.sqrt(op.STEADY_WORDS / max(n, 1)))
            if m[name] is not None and (m[name] > high + width or (name not in ("fallback_share", "entropy_gap") and m[name] < low - width)):
                reasons.append(name)
        want[i] = (not failed and not reasons, reasons)
    got = {r.doc_id: (r.kept, list(r.reasons)) for r in op.quality_rules(df).collect()}
    assert got == want and len({k for k, _ in want.values()}) == 2
