import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from corpusq.llm import poisson_mix, weak_toxicity  # noqa: E402

from ..conftest import rows_of  # noqa: E402
from . import test_covering_simhash as near  # noqa: E402
from . import test_decontaminate as leak  # noqa: E402
from . import test_fuzzy_lines as lines  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What goes into each stage, and what comes out of it."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        after = spark.read.parquet(f"{base}/{i}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    columns = steps[0][0].columns
    assert all(after.columns == columns for _, after in steps[:-1]) and steps[-1][1].columns == [*columns, "mix_copy", "mix_key"]
    assert all(after.count() for _, after in steps)


def test_toxic_documents_go(steps, spark, sf_dir):
    before, after = steps[0]
    verdict = {r.doc_id: r.predicted for r in weak_toxicity.toxicity(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert ids(after) == {i for i, p in verdict.items() if not p}


def test_lines_equal_brute_force(steps, spark):
    before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    want = lines.plain(rows)
    texts = dict(rows)
    assert {(r.doc_id, r.text) for r in after.collect()} == {(i, t) for i, t in want.items() if t.strip(" \t\n\v\f\r") or t == texts[i]}


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    assert ids(after) == near.kept_by_brute_force(rows)


def test_leaking_documents_go(steps, spark, sf_dir):
    before, after = steps[3]
    items = [leak.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in items]
    bad = set()
    for r in before.select("doc_id", "text").collect():
        w = leak.words(r.text)
        own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if any(len(g & own) >= 0.3 * len(g) and leak.plain(item, w) >= 0.6 * 2 * len(item) for g, item in zip(grams, items)):
            bad.add(r.doc_id)
    assert ids(after) == ids(before) - bad


def test_mix_equals_sql(steps, duck):
    before, after = steps[4]
    duck.register("kept", before.toPandas())
    want = duck.execute(poisson_mix.ORACLE.format(docs="kept", columns="doc_id, text, lang, source, n_chars")).df()
    assert rows_of(after.toPandas()) == rows_of(want)


def test_empty_documents(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
