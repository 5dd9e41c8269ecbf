import pytest

import __spark_entry__ as entry
from corpusq import catalog_queries

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalog_queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_point(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rate_limit_equals_a_plain_walk(spark, sf_dir):
    rows = catalog_queries.rate_limit_fixed_window(spark, sf_dir).toPandas().sort_values(["user_id", "ts"])
    want, now, start, used = [], None, None, 0
    for user, at in zip(rows.user_id, rows.ts):
        if user != now or (at - start).total_seconds() >= 86400:
            now, start, used = user, at, 0
        used += 1
        want.append(used <= 1)
    assert rows.allowed.tolist() == want and not all(want)


def test_roundtrip_gives_the_same_ranking(spark, sf_dir):
    """What is loaded ranks chunks as the tables do that were not published."""
    from corpusq.operators import retrieval

    got = [(r.id, r.chunk_id, r.bm25) for r in catalog_queries.publish_roundtrip(spark, sf_dir).collect()]
    chunks = catalog_queries.window_chunks(spark, sf_dir)
    p = catalog_queries.postings_of(chunks, "text")
    scores = retrieval.bm25_chunks(p, catalog_queries.frequencies(p), catalog_queries.statistics(chunks, "text"), retrieval.query_terms(spark, catalog_queries.TERMS))
    best = {}
    for r in scores.join(chunks.select("chunk_id", "doc_id"), "chunk_id").collect():
        best[str(r.doc_id)] = max(best.get(str(r.doc_id), (0.0, "")), (round(r.bm25, 6), r.chunk_id))
    assert len(got) == 10 and [g[2] for g in got] == sorted((s for s, _ in best.values()), reverse=True)[:10]
    assert all(best[i][0] == s for i, _, s in got)


def test_postings_by_row_are_those_counted_by_group_and_nothing_moves(spark, sf_dir):
    from corpusq.operators.index import postings_by_row, postings_of

    extra = spark.createDataFrame([("e", 1, 1, ""), ("n", 2, 2, None), ("k", 3, 3, "가나 가나다 S_{0} x x X")], "chunk_id string, doc_id long, ord long, text string")
    chunks = catalog_queries.window_chunks(spark, sf_dir).select(*extra.columns).union(extra)
    got = postings_by_row(chunks, "text")
    want = postings_of(chunks, "text").select(*got.columns)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0 and {r.tf for r in got.where("chunk_id = 'k' and token = 'x'").collect()} == {3}


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_recall_moves_no_score_of_an_item_and_a_document(spark, sf_dir):
    """Scores are as many as items times documents; each is summed where its document's tokens stand."""
    import re

    plan = _final_plan(catalog_queries.recall_at_k(spark, sf_dir))
    assert "partial_sum" in plan and not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, doc_id[^\n]*\n[^\n]*HashAggregate[^\n]*partial_sum", plan)


def test_attachment_matches_read_the_texts_twice(spark, sf_dir):
    """Once for the statistics and once for all scores."""
    assert _final_plan(catalog_queries.attachment_top5_fold(spark, sf_dir)).count("FileScan parquet") == 2
