import os
import sys

from corpusq.llm import chat_rotation, poisson_mix

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import rows_of  # noqa: E402


def test_rotation_equals_sql(spark, sf_dir, duck):
    got = chat_rotation.render(spark.read.parquet(f"{sf_dir}/conversations.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(chat_rotation.ORACLE).df())


def test_rotation_of_odd_turns(spark):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|end|>", 2), (1, 2, "bob", None, 3), (1, 2, "bob", None, 3), (1, None, None, "x", 4), (None, 0, "cy", "alone", 5), (2, 0, "system", "no one", 6), (1, 600, "ann", "late", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat_rotation.render(df).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (-1, 0, 2)} | {(None, "cy", 0)}
    r = got[1, "ann", 0]
    assert r.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2
    a, b = map(int, r.mask.split("-"))
    assert r.text[a:b] == "hi < |end|><|end|>" and r.n_masked == 1 and r.n_turns == 4
    assert got[1, "bob", 0].mask.count(",") == 1
    assert chat_rotation.render(df.limit(0)).count() == 0


def test_mix_equals_sql(spark, sf_dir, duck):
    sql = poisson_mix.ORACLE.format(docs="documents", columns="doc_id, text, lang, source, n_chars")
    got = poisson_mix.poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert rows_of(got.toPandas()) == rows_of(duck.execute(sql).df())


def test_mix_reaches_its_weights_and_is_stable(spark):
    rows = [(i, "x" * 100, "big" if i < 3000 else "small" if i < 4000 else None) for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = poisson_mix.poisson_mix(df, weights={"big": 0.25, "small": 0.75})
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert None not in counts and abs(counts["small"] / (counts["small"] + counts["big"]) - 0.75) < 0.03
    assert got.exceptAll(poisson_mix.poisson_mix(df.repartition(7), weights={"big": 0.25, "small": 0.75})).count() == 0


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 2), (1, "", "a", 2)], "doc_id long, text string, source string, _n int")
    out = poisson_mix.poisson_mix(df)
    assert out.columns[:4] == df.columns and poisson_mix.poisson_mix(df.limit(0)).count() == 0
    same = {}
    for r in out.collect():
        same.setdefault((r.doc_id, r.mix_copy), []).append(r)
    assert all(len(v) == 2 for k, v in same.items() if k[0] == 1)


def test_large_means_are_drawn_right(spark):
    rated = spark.createDataFrame([("a", 0.0), ("b", 2.5), ("c", 900.0)], "mix_source string, rate double")
    cdf = {r.mix_source: r.cdf for r in poisson_mix.cumulative(rated).collect()}
    assert cdf["a"][0] == 1.0 and abs(cdf["b"][2] - 0.5438131158833297) < 1e-12
    assert abs(cdf["c"][900] - 0.5088) < 1e-3 and all(abs(c[-1] - 1) < 1e-9 for c in cdf.values())
