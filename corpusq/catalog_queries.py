"""The engine's own operators as queries over the shared tables, and the SQL that restates them.

Tables stand in for a corpus: documents with a title (first line), category (source)
and dates from their ids; labels gate what is searchable; pages are attachments;
conversations are ordered chunks; events are a request log.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import assets, entities, text
from .operators import chunker, evaluation, filters, lexicon, listing, quality, retrieval
from .operators.index import frequencies, postings_by_row, postings_of, statistics

TERMS = {"the": 1.0, "and": 1.0, "schen": 1.0}
QUERY = "the and schen"
LEXICON = [
    {"id": "articles", "canonical": "definite article", "aliases": ["the", "der", "les"], "expansions": ["determiner", "une", "una"]},
    {"id": "acronym", "canonical": "ETF", "aliases": ["exchange traded fund"], "expansions": ["fund units", "net asset value"]},
    {"id": "link", "canonical": "conjunction", "aliases": ["and", "und"], "expansions": ["que", "avec"]},
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus; see CORPUS for the same in SQL."""
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("category"), F.col("lang").alias("language"), F.col("text").alias("body"),
        F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 5 == 0, "notice").otherwise("rule").alias("document_type"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(day).alias("effective_date"), F.lit("").alias("published_date"), F.lit("2025-01-01").cast("timestamp").alias("collected_at"),
    )


CORPUS = """corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS category, lang AS language, text AS body, split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 5 = 0 THEN 'notice' ELSE 'rule' END AS document_type,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS effective_date
  FROM documents)"""
WORDS = "regexp_extract_all(lower({}), '[0-9A-Za-z가-힣]+')"
TOKENS = f"toks AS (SELECT doc_id, {WORDS.format('text')} AS ts FROM documents)"
POSTINGS = f"""{TOKENS},
p AS (SELECT doc_id, token, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS token FROM toks) GROUP BY doc_id, token),
st AS (SELECT count(*) AS nc, avg(len(ts)) AS al FROM toks)"""
BM25 = """s AS (
  SELECT p.doc_id, sum(q.w * ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * n / al))) AS score
  FROM p JOIN q USING (token) JOIN (SELECT token, count(*) AS df FROM p GROUP BY token) USING (token), st GROUP BY p.doc_id)"""
PLAIN_Q = "q AS (SELECT unnest(['the', 'and', 'schen']) AS token, 1.0 AS w)"


def doc_postings(spark: SparkSession, sf_dir: str, terms: list[str] | None = None) -> DataFrame:
    """Postings of whole documents; given terms are a filter below the aggregate, so only theirs are shuffled."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("doc_id").alias("ord"), "text")
    p = postings_of(d, "text")
    return p if terms is None else p.where(F.col("token").isin(terms))


def doc_scores(spark: SparkSession, sf_dir: str, weights: dict[str, float]) -> DataFrame:
    p = doc_postings(spark, sf_dir, list(weights))
    stats = statistics(table(spark, sf_dir, "documents"), "text")
    return retrieval.bm25_chunks(p, frequencies(p), stats, retrieval.query_terms(spark, weights))


# --- tokens and chunks ---


@query(f"WITH {TOKENS} SELECT doc_id, CAST(len(list_distinct(ts)) AS INTEGER) AS n_tokens, array_to_string(list_sort(list_distinct(ts)), ' ') AS tokens FROM toks")
def tok_unique(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("ts"))
    return t.select("doc_id", F.size("ts").alias("n_tokens"), F.array_join(F.array_sort("ts"), " ").alias("tokens"))


@query(f"WITH {POSTINGS} SELECT token, doc_id, CAST(tf AS BIGINT) AS tf FROM p")
def tok_index_tf(spark, sf_dir):
    return doc_postings(spark, sf_dir).select("token", "doc_id", "tf")


@query(f"""SELECT doc_id, array_to_string(list_concat(list_transform({WORDS.format("text")}, lambda w: w || doc_id), list_transform({WORDS.format("text")}, lambda w: w || '2')), ' ') AS aliases
FROM documents""")
def tok_script_alias(spark, sf_dir):
    noted = lambda w: F.concat(F.lit("x <b>"), w, F.lit("</b> "), w, F.lit("<SUP>2)</SUP> "), w, F.lit("_{"), F.col("doc_id"), F.lit("}"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(text.index_tokens("text"), noted), " ").alias("noted"))
    return d.select("doc_id", F.array_join(text.script_aliases("noted"), " ").alias("aliases"))


HANGUL = "가나다라마바사아자차카타파하"


@query(f"""WITH h AS (SELECT doc_id, lang, substr('{HANGUL}', CAST(doc_id % 12 + 1 AS BIGINT), 3) AS w FROM documents)
SELECT doc_id, array_to_string([w, substr(w, 1, 2), substr(w, 2, 2), w, substr(w, 1, 2), substr(w, 1, 2), 'x', lang, w || doc_id], ' ') AS tokens FROM h""")
def tok_hangul(spark, sf_dir):
    """An all-Hangul word, one of two syllables (its own 2-gram), single characters of both kinds, a mixed word."""
    w = F.substring(F.lit(HANGUL), (F.col("doc_id") % 12 + 1).cast("int"), F.lit(3))
    said = F.concat_ws(" ", w, F.substring(w, 1, 2), F.substring(w, 1, 1), F.lit("X"), F.col("lang"), F.concat(w, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.index_tokens(said), " ").alias("tokens"))


@query(f"WITH {POSTINGS} SELECT token, count(*) AS df FROM p GROUP BY token")
def doc_freq(spark, sf_dir):
    return frequencies(doc_postings(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT count(*) AS n_chunks, round(avg(len(ts)), 6) AS avg_len FROM toks")
def chunk_stats(spark, sf_dir):
    return statistics(table(spark, sf_dir, "documents"), "text").select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


WINDOWS = """SELECT doc_id, CAST(i AS INTEGER) AS idx, regexp_replace(substr(text, CAST(i * 1600 + 1 AS BIGINT), 1600), '^\\s+|\\s+$', '', 'g') AS text
FROM documents, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 1600)) AS g(i) WHERE length(text) > 0"""


@query(WINDOWS)
def chunk_fixed_window(spark, sf_dir):
    return chunker.fixed_windows(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, idx, text, '' AS article_id, '' AS path FROM (" + WINDOWS + ")")
def chunk_structured(spark, sf_dir):
    got = chunker.chunks(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "idx", "text", "article_id", F.array_join("heading_path", " > ").alias("path"))


@query("""WITH c AS (SELECT doc_id, source, lang, unnest(range(6)) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS idx,
  CASE i WHEN 0 THEN '# 규정 ' || doc_id WHEN 1 THEN '## 제1장 총칙' WHEN 2 THEN '제1조(목적) ' || source || ' ' || lang
    WHEN 3 THEN '| 이름 | 값 |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || ' | ' || lang || ' |'
    WHEN 4 THEN '제2조(정의) 제9조(다른 것)에 따라 ' || doc_id ELSE '```math' || chr(10) || doc_id || chr(10) || '```' END AS text,
  CASE WHEN i < 2 THEN '' WHEN i < 4 THEN '제1조' ELSE '제2조' END AS article_id,
  '규정 ' || doc_id || CASE WHEN i > 0 THEN ' > 제1장 총칙' ELSE '' END || CASE WHEN i < 2 THEN '' WHEN i < 4 THEN ' > 제1조(목적)' ELSE ' > 제2조(정의)' END AS path
FROM c""")
def chunk_articles(spark, sf_dir):
    """Title, chapter, articles, a citation that opens no article, a Markdown table and a fence; headings run on."""
    parts = [
        F.concat(F.lit("# 규정 "), F.col("doc_id"), F.lit("\n## 제1장 총칙\n제1조(목적) "), F.col("source"), F.lit(" "), F.col("lang")),
        F.concat(F.lit("| 이름 | 값 |\n|---|---|\n| "), F.col("source"), F.lit(" | "), F.col("lang"), F.lit(" |")),
        F.concat(F.lit("제2조(정의) 제9조(다른 것)에 따라 "), F.col("doc_id")),
        F.concat(F.lit("```math\n"), F.col("doc_id"), F.lit("\n```\n")),
    ]
    got = chunker.chunks(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n\n", *parts).alias("text")))
    return got.select("doc_id", "idx", "text", "article_id", F.array_join("heading_path", " > ").alias("path"))


@query("""WITH r AS (SELECT doc_id, unnest([source, lang, CAST(doc_id AS VARCHAR)]) AS x, unnest(range(3)) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS idx, '<table>' || chr(10) || '<tr><th>h</th></tr>' || chr(10) || '<tr><td>' || x || '</td></tr>' || chr(10) || '</table>' AS text FROM r
UNION ALL
SELECT doc_id, CAST(i + 3 AS INTEGER), '| 이름 | 값 |' || chr(10) || '|---|---|' || chr(10) || '| ' || x || ' | row ' || i || ' |' FROM r""")
def chunk_table_rows(spark, sf_dir):
    """Rows of an HTML and of a Markdown table, packed whole under a limit that takes one at a time; heads are repeated."""
    cells = ["source", "lang", F.col("doc_id").cast("string")]
    html = F.concat(F.lit("<table>\n<tr><th>h</th></tr>\n"), *[F.concat(F.lit("<tr><td>"), c if not isinstance(c, str) else F.col(c), F.lit("</td></tr>\n")) for c in cells], F.lit("</table>"))
    rows = [F.concat(F.lit("| "), c if not isinstance(c, str) else F.col(c), F.lit(f" | row {i} |")) for i, c in enumerate(cells)]
    joined = F.concat(html, F.lit("\n\n| 이름 | 값 |\n|---|---|\n"), F.concat_ws("\n", *rows))
    got = chunker.chunks(table(spark, sf_dir, "documents").select("doc_id", joined.alias("text")), 45)
    return got.select("doc_id", "idx", "text")


# --- retrieval ---


@query(f"WITH {POSTINGS}, {PLAIN_Q}, {BM25} SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    s = doc_scores(spark, sf_dir, TERMS).select("doc_id", F.round("bm25", 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"WITH {POSTINGS}, {PLAIN_Q}, {BM25} SELECT doc_id, round(score, 6) AS score FROM s JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND d.doc_id % 5 <> 0 AND score > 0")
def bm25_filtered_global_stats(spark, sf_dir):
    kept = corpus(spark, sf_dir).where(filters.matches(filters.Filter(document_type="rule"))).where(F.col("language") == "en").select("doc_id")
    return doc_scores(spark, sf_dir, TERMS).join(kept, "doc_id").select("doc_id", F.round("bm25", 6).alias("score"))


EXPANDED = {"the": 1.0, "definite": 0.4, "article": 0.4, "determiner": 0.4, "une": 0.4, "una": 0.4}


@query(f"""WITH {POSTINGS}, q AS (SELECT * FROM (VALUES ('the', 1.0), ('definite', 0.4), ('article', 0.4), ('determiner', 0.4), ('une', 0.4), ('una', 0.4)) v(token, w)), {BM25}
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0""")
def bm25_weighted_expansion(spark, sf_dir):
    weights = lexicon.expand("the", lexicon.entries(LEXICON)).token_weights()
    return doc_scores(spark, sf_dir, weights).select("doc_id", F.round("bm25", 6).alias("score"))


CHUNK_BM25 = f"""w AS ({WINDOWS}),
toks AS (SELECT doc_id, idx, {WORDS.format("text")} AS ts FROM w),
p AS (SELECT doc_id, idx, token, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, idx, len(ts) AS n, unnest(ts) AS token FROM toks) GROUP BY doc_id, idx, token),
st AS (SELECT count(*) AS nc, avg(len(ts)) AS al FROM toks), {PLAIN_Q},
s AS (SELECT p.doc_id, p.idx, sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * n / al))) AS score
      FROM p JOIN q USING (token) JOIN (SELECT token, count(*) AS df FROM p GROUP BY token) USING (token), st GROUP BY p.doc_id, p.idx)"""


def window_chunks(spark, sf_dir):
    w = chunker.fixed_windows(table(spark, sf_dir, "documents"))
    return w.select(F.concat_ws("#", "doc_id", "idx").alias("chunk_id"), "doc_id", (F.col("doc_id") * (1 << 24) + F.col("idx")).alias("ord"), "idx", "text")


def window_scores(spark, sf_dir):
    chunks = window_chunks(spark, sf_dir)
    p = postings_of(chunks, "text").where(F.col("token").isin(list(TERMS)))
    return retrieval.bm25_chunks(p, frequencies(p), statistics(chunks, "text"), retrieval.query_terms(spark, TERMS))


@query(f"""WITH {CHUNK_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS k FROM s)
SELECT doc_id, doc_id || '#' || idx AS chunk_id, round(score, 6) AS score FROM r WHERE k = 1""")
def bm25_best_chunk_per_doc(spark, sf_dir):
    s = window_scores(spark, sf_dir).withColumn("bm25", F.round("bm25", 9))
    return retrieval.best_chunks(s, "bm25").select("doc_id", "chunk_id", F.round("bm25", 6).alias("score"))


@query(f"""WITH {CHUNK_BM25},
c AS (SELECT doc_id, idx, round(score, 9) AS score, idx > 0 AS att, 'a' || (idx % 3) AS aid FROM s),
b AS (SELECT doc_id, idx AS bidx, att AS batt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS k FROM c) WHERE k = 1),
e AS (SELECT c.* FROM c JOIN b USING (doc_id) WHERE att AND (NOT batt OR idx >= bidx)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, aid ORDER BY score DESC, idx) AS k FROM e) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS place FROM m)
SELECT doc_id, string_agg(aid || ':' || doc_id || '#' || idx, ',' ORDER BY place) AS matches FROM r WHERE place <= 5 GROUP BY doc_id""")
def attachment_top5_fold(spark, sf_dir):
    idx = F.col("ord") % (1 << 24)
    s = window_scores(spark, sf_dir).withColumn("bm25", F.round("bm25", 9)).withColumn("source", F.when(idx > 0, "attachment").otherwise("body")).withColumn("attachment_id", F.concat(F.lit("a"), idx % 3))
    m = retrieval.attachment_matches(s, "bm25")
    return m.select("doc_id", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["attachment_id"], x["chunk_id"])), ",").alias("matches"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS t FROM documents),
f AS (SELECT doc_id, t, greatest(coalesce(nullif(instr(lower(t), 'the'), 0), nullif(instr(lower(t), 'and'), 0), nullif(instr(lower(t), 'schen'), 0), 1) - 1, 0) AS hit FROM t),
g AS (SELECT doc_id, t, CASE WHEN hit > 40 THEN hit - 40 ELSE 0 END AS s FROM f)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(t, CAST(s + 1 AS BIGINT), 300) || CASE WHEN s + 300 < length(t) THEN '...' ELSE '' END END AS snippet FROM g""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text", text.tokens(F.lit(QUERY))).alias("snippet"))


VECTOR = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in VECTOR) + "]"
COSINE = f"c AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VECTOR_SQL}) AS s FROM embeddings)"


def cosine_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", retrieval.cosine(F.col("embedding"), VECTOR).alias("s"))


@query(f"WITH {COSINE} SELECT vec_id, round(s, 6) AS score FROM c ORDER BY round(s, 6) DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return cosine_scores(spark, sf_dir).select("vec_id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH {COSINE} SELECT vec_id, round(s, 6) AS score FROM c WHERE s > 0")
def cosine_positive_only(spark, sf_dir):
    return cosine_scores(spark, sf_dir).where("s > 0").select("vec_id", F.round("s", 6).alias("score"))


@query("SELECT vec_id, vec_id % 5 NOT IN (0, 1, 2) AS valid FROM embeddings")
def vector_validate(spark, sf_dir):
    k, e = F.col("vec_id") % 5, F.col("embedding")
    spoilt = F.when(k == 0, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(k == 1, F.concat(e, F.array(F.lit(float("nan")).cast("float")))).when(k == 2, F.array().cast("array<float>")).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", retrieval.valid_vector(spoilt).alias("valid"))


FUSED = f"""{POSTINGS}, {PLAIN_Q}, {BM25}, {COSINE},
b AS (SELECT doc_id, score AS bm25, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rb FROM s WHERE score > 0),
v AS (SELECT vec_id AS doc_id, s AS vector_score, row_number() OVER (ORDER BY round(s, 12) DESC, vec_id) AS rv FROM c WHERE s > 0),
f AS (SELECT doc_id, coalesce(bm25, 0) AS bm25, coalesce(vector_score, 0) AS vector_score, coalesce(1.0 / (60 + rb), 0) + coalesce(1.0 / (60 + rv), 0) AS rrf FROM b FULL JOIN v USING (doc_id))"""


def fused(spark, sf_dir):
    b = doc_scores(spark, sf_dir, TERMS).select("doc_id", "bm25")
    v = cosine_scores(spark, sf_dir).where("s > 0").select(F.col("vec_id").alias("doc_id"), F.col("s").alias("vector_score"))
    return retrieval.fuse(b, v, [F.col("doc_id").asc()])


@query(f"WITH {FUSED} SELECT doc_id, round(bm25, 6) AS bm25, round(vector_score, 6) AS vector_score, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("vector_score", 6).alias("vector_score"), F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {FUSED}, page AS (SELECT * FROM f ORDER BY round(rrf, 12) DESC, round(bm25, 12) DESC, round(vector_score, 12) DESC, doc_id LIMIT 10)
SELECT CASE WHEN max(CAST(bm25 > 0 AS INTEGER)) = 1 AND max(CAST(vector_score > 0 AS INTEGER)) = 1 THEN 'bm25+vector-rrf' WHEN max(CAST(vector_score > 0 AS INTEGER)) = 1 THEN 'vector' ELSE 'bm25' END || '+domain-expansion' AS mode FROM page""")
def search_dispatch_mode(spark, sf_dir):
    return retrieval.mode(retrieval.ranked(fused(spark, sf_dir), ["rrf", "bm25", "vector_score"], [F.col("doc_id")], 10), True)


LEX_TERMS = "terms AS (SELECT * FROM (VALUES ('articles', 'definite article'), ('articles', 'the'), ('articles', 'der'), ('articles', 'les'), ('acronym', 'ETF'), ('acronym', 'exchange traded fund'), ('link', 'conjunction'), ('link', 'and'), ('link', 'und')) v(entry_id, term))"


@query(f"""WITH {LEX_TERMS}, q AS (SELECT item_id, text AS t, regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS k, {WORDS.format("text")} AS ts FROM benchmark)
SELECT item_id, entry_id, string_agg(term, ',' ORDER BY term) AS matched FROM q, terms
WHERE CASE WHEN regexp_full_match(term, '[A-Z]{{2,4}}') THEN list_contains(ts, lower(term)) ELSE contains(k, regexp_replace(lower(term), '[^a-z0-9]', '', 'g')) END GROUP BY item_id, entry_id""")
def lexicon_match(spark, sf_dir):
    from .sources.lexicons import to_table

    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return lexicon.matches(q, to_table(spark, lexicon.entries(LEXICON))).select("item_id", "entry_id", F.array_join("matched", ",").alias("matched"))


@query("SELECT 'the fund of THE ETF' AS query, 'the fund of THE ETF definite article determiner une una fund units net asset value conjunction que avec' AS expanded, 'articles,acronym,link' AS applied")
def lexicon_expand(spark, sf_dir):
    e = lexicon.expand("the fund of THE ETF", lexicon.entries(LEXICON))
    return spark.createDataFrame([(e.original, e.expanded, ",".join(a.entry.id for a in e.applied))], "query string, expanded string, applied string")


# --- filters and listings ---


@query(f"WITH {CORPUS} SELECT doc_id, effective_date FROM corpus WHERE effective_date = '' OR (effective_date >= '2024-02-01' AND effective_date <= '2024-06-30')")
def filter_date_missing_passes(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.matches(filters.Filter(effective_from="2024-02-01", effective_to="2024-06-30"))).select("doc_id", "effective_date")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_language_normalized(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.matches(filters.Filter(language="EN_us"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(source) = 'src3'")
def filter_category_casefold(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.matches(filters.Filter(category="SRC3"))).select("doc_id")


LISTED = f"""WITH {CORPUS}, r AS (SELECT id, coalesce(try_strptime(nullif(effective_date, ''), '%Y-%m-%d'), TIMESTAMP '2025-01-01') AS d FROM corpus WHERE document_type = 'rule')"""


@query(LISTED + " SELECT id, (SELECT count(*) FROM r) AS total FROM (SELECT id FROM r ORDER BY d DESC, id LIMIT 20 OFFSET 40)")
def list_page_total(spark, sf_dir):
    page, total = listing.documents_page(corpus(spark, sf_dir), filters.Filter(document_type="rule"), 20, 40)
    return page.select("id").join(F.broadcast(total))


@query(LISTED.replace("WHERE document_type = 'rule'", "") + " SELECT id FROM r ORDER BY d DESC, id LIMIT 50")
def list_recent(spark, sf_dir):
    return listing.documents_page(corpus(spark, sf_dir), filters.Filter())[0].select("id")


@query("SELECT DISTINCT trim(source) AS category FROM documents WHERE trim(coalesce(source, '')) <> ''")
def list_categories(spark, sf_dir):
    return listing.categories(corpus(spark, sf_dir))


@query("""SELECT doc_id, substr(text, 101, 200) AS content, CAST(length(text) AS INTEGER) AS total, length(text) > 300 AS truncated, CAST(CASE WHEN length(text) > 300 THEN 300 ELSE 0 END AS INTEGER) AS next_offset FROM documents""")
def get_text_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.page("text", 100, 200).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || chr(10) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def limit_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.limited("text", 80).alias("text"))


TURNS = "t AS (SELECT conv_id, turn, conv_id || '#' || turn AS chunk_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("idx"), F.lit("body").alias("source"), F.lit("").alias("attachment_id"), "text", "conv_id")


@query(f"WITH {TURNS}, h AS (SELECT conv_id, k AS here FROM t WHERE chunk_id = '3#2') SELECT chunk_id, text FROM t JOIN h USING (conv_id) WHERE k BETWEEN here - 1 AND here + 2")
def context_window(spark, sf_dir):
    return listing.context_around(turns(spark, sf_dir), "3#2", 1, 2).select("chunk_id", "text")


@query("SELECT conv_id || '#' || turn AS chunk_id, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), ',') AS around FROM conversations")
def context_neighbours(spark, sf_dir):
    n = listing.neighbours(turns(spark, sf_dir), 1, 2, ["doc_id"], "idx", F.col("idx"))
    return n.select("chunk_id", F.array_join(F.transform("around", lambda x: x.cast("string")), ",").alias("around"))


@query("SELECT conv_id, string_agg('<!-- chunk_id: ' || conv_id || '#' || turn || ' source: body -->' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def context_content(spark, sf_dir):
    return listing.context_text(turns(spark, sf_dir), "idx", ["conv_id"])


@query("""WITH t AS (SELECT conv_id, turn, text, 500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM conversations)
SELECT conv_id, turn AS idx, length(text) > rest AS truncated, substr(text, 1, CAST(rest AS BIGINT)) AS text FROM t WHERE rest > 0 OR length(text) = 0""")
def char_budget(spark, sf_dir):
    return listing.with_budget(turns(spark, sf_dir), 500, "idx", ["conv_id"]).select("conv_id", "idx", "truncated", "text")


# --- notices and scalar functions ---


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hwp_formula_latex_best_effort:true:false:2' WHEN 2 THEN 'hwp_formula_latex_best_effort:false:true:1' ELSE 'hwp_formula_latex_best_effort:true:true:9' END AS notice FROM pages""")
def formula_notice(spark, sf_dir):
    k, body = F.col("page_id") % 4, F.col("html")
    source, math = F.lit("\n```hwp-equation\nx\n```\n"), F.lit("\n```math\nx\n```\n")
    noted = F.when(k == 0, body).when(k == 1, F.concat(source, body, source)).when(k == 2, F.concat(body, math)).otherwise(F.concat(source, body, math))
    n = entities.formula_notice(noted, F.when(k == 3, 9).cast("long"))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n")).select("page_id", F.when(F.col("n").isNotNull(), F.concat_ws(":", "n.code", "n.source_equation_available", "n.generated_latex_available", "n.formula_count")).alias("notice"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN quality = 0 THEN 'document_text_unreliable' WHEN toxic = 1 THEN 'document_text_degraded' END AS notice
FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_notice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    searchable = F.when(F.col("quality") == 0, False).when(F.col("quality") == 1, True)
    n = entities.document_notice(searchable, F.when(F.col("toxic") == 1, "warn").otherwise("ok"), F.array().cast("array<string>"))
    return d.select("doc_id", n["code"].alias("notice"))


@query("""SELECT page_id, CASE WHEN page_id % 6 IN (0, 1) THEN 'attachment_text_unreliable:false' WHEN page_id % 6 = 2 THEN 'attachment_text_degraded:true' WHEN page_id % 6 = 3 THEN 'attachment_text_unreliable:false' END AS notice FROM pages""")
def attachment_quality_notice(spark, sf_dir):
    k = F.col("page_id") % 6
    status, quality_status = F.when(k == 0, "failed").otherwise("converted"), F.when(k == 2, "warn").when(k == 3, "fail").otherwise("ok")
    n = entities.attachment_notice(F.when(k == 1, False), F.lit(""), status, quality_status, F.array().cast("array<string>"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(n.isNotNull(), F.concat_ws(":", n["code"], n["searchable"])).alias("notice"))


@query("SELECT doc_id, regexp_replace(text, '" + assets.IMAGE.replace("'", "''") + r"', '\1', 'g') || ' alt ' || doc_id || ' and ' AS search FROM documents")
def asset_search_text(spark, sf_dir):
    marked = F.concat("text", F.lit(" ![alt "), F.col("doc_id"), F.lit("](images/a.png) and ![](x)"))
    return table(spark, sf_dir, "documents").select("doc_id", assets.without_images(marked).alias("search"))


@query(f"""WITH {CORPUS}, a AS (SELECT doc_id, trim(lower(title)) AS t FROM corpus), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[/\\\\ _.:]', '-', 'g'), '[^0-9a-z가-힣-]', '', 'g'), '-+', '-', 'g') AS t FROM a)
SELECT doc_id, CASE WHEN trim(t, '-') = '' THEN 'untitled' ELSE trim(t, '-') END AS slug FROM b""")
def slugify(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.slug("title").alias("slug"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE url END AS safe FROM pages""")
def safe_url(spark, sf_dir):
    k, u = F.col("page_id") % 5, F.col("url")
    spoilt = F.when(k == 0, F.replace(u, F.lit("://"), F.lit("://me:pw@"))).when(k == 1, F.concat(u, F.lit("%0a"))).when(k == 2, F.concat(F.lit("ftp"), u)).otherwise(F.concat(F.lit(" "), u, F.lit(" ")))
    return table(spark, sf_dir, "pages").select("page_id", entities.safe_url(spoilt).alias("safe"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/Download.do?id=1' WHEN 1 THEN '' WHEN 2 THEN url ELSE NULL END AS safe, CASE page_id % 4 WHEN 3 THEN NULL ELSE 'f.txt' END AS file FROM pages""")
def safe_attachment(spark, sf_dir):
    k = F.col("page_id") % 4
    u = F.when(k == 0, "/Download.do?id=1").when(k == 1, " ").when(k == 2, F.col("url")).otherwise("/etc/passwd")
    name = F.when(k == 3, "../f.txt").otherwise("f.txt")
    return table(spark, sf_dir, "pages").select("page_id", entities.safe_attachment_url(u).alias("safe"), entities.portable_file_name(name).alias("file"))


@query("""SELECT doc_id, sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g')) AS hash FROM documents""")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_hash("text").alias("hash"))


@query(f"""WITH {CORPUS} SELECT doc_id, sha256(CAST(json_object('body_hash', sha256(body), 'category', category, 'id', id, 'language', language) AS VARCHAR)) AS hash FROM corpus""")
def index_source_hash(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("body_hash", F.sha2("body", 256))
    return c.select("doc_id", F.sha2(F.to_json(F.struct("body_hash", "category", "id", "language")), 256).alias("hash"))


@query("SELECT source, sha256(to_json(list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR)))) AS digest FROM documents GROUP BY source")
def id_set_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(text.set_digest(F.col("doc_id").cast("string")).alias("digest"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'ko' END AS language, CASE WHEN doc_id % 5 = 0 THEN 'corpus://notices/' ELSE 'corpus://rules/' END || doc_id AS uri FROM documents")
def language_and_uri(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.stored_language("language").alias("language"), text.uri("document_type", "id").alias("uri"))


DATED = "CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '20' || doc_id % 29 || '-' || (doc_id % 14) || '-' || (doc_id % 33) ELSE '20' || lpad(CAST(doc_id % 29 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') END"


@query(f"""WITH d AS (SELECT doc_id, {DATED} AS day FROM documents)
SELECT doc_id, day = '' OR (length(day) = 10 AND try_cast(day AS DATE) IS NOT NULL) AS ok FROM d""")
def iso_date(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_iso_date(F.expr(DATED.replace("AS VARCHAR", "AS STRING"))).alias("ok"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS first FROM documents")
def first_non_empty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_non_empty(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("source"))).otherwise("\t "), F.col("lang")).alias("first"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_extract(url, '^https?://[^/]+') || '/out/index.do' END AS page, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_extract(url, '^https?://[^/]+') || '/api/get.do' END AS endpoint,
CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'Menuid=m,bookid=' || page_id END AS parameters FROM pages""")
def official_source(spark, sf_dir):
    blank = F.lit(" ")
    r = F.struct(F.when(F.col("page_id") % 3 == 0, "").otherwise("/api/get.do").alias("endpoint"), F.col("page_id").cast("string").alias("bookid"), blank.alias("noformyn"), blank.alias("statehistoryid"), blank.alias("bbsid"), F.lit(" m").alias("menuid"), F.lit("h").alias("source_content_hash"))
    o = table(spark, sf_dir, "pages").select("page_id", entities.official_source(r, F.col("url")).alias("o"))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("o.parameters"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return o.select("page_id", F.col("o.source_page_url").alias("page"), F.col("o.endpoint").alias("endpoint"), listed.alias("parameters"))


# --- corpus quality ---


@query("SELECT source AS id, count(*) AS n, 'duplicate_document_id' AS code FROM documents GROUP BY source HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "documents"), "source", "duplicate_document_id")


@query("""SELECT (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM embeddings) AS stored, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS unknown,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, round((SELECT count(*) FROM embeddings) / (SELECT count(*) FROM documents), 6) AS coverage, 'sample' AS scope""")
def vector_coverage_anti(spark, sf_dir):
    c = quality.vector_coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))
    return c.withColumn("coverage", F.round("coverage", 6))


@query("""WITH a AS (SELECT doc_id AS key, source AS x FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id AS key, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE source END AS y FROM documents WHERE doc_id % 17 <> 0)
SELECT * FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_in_first' WHEN a.key IS NULL THEN 'only_in_second' WHEN x IS DISTINCT FROM y THEN 'differs' END AS code FROM a FULL JOIN b ON a.key = b.key) WHERE code IS NOT NULL""")
def manifest_parity_full_outer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    b = d.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("source")).alias("source"))
    return quality.parity(d.where("doc_id % 11 <> 0"), b, "doc_id", "source")


@query("""SELECT page_id AS id, 'failure_not_allowed' AS code FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 1 UNION ALL SELECT page_id, 'allowed_without_failure' FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0""")
def allowlist_anti(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    a = p.select(F.col("page_id").alias("id"), F.lit("").alias("conversion_status"), F.when(F.col("page_id") % 3 == 0, "failed").otherwise("converted").alias("status"))
    return quality.allow_list(a, p.where("page_id % 2 = 0").select(F.col("page_id").alias("id")))


@query("""WITH s AS (SELECT doc_id, ['pending', 'converted', 'failed', 'odd'][doc_id % 4 + 1] AS c, ['preserved', 'gone', ''][doc_id % 3 + 1] AS p, doc_id % 2 = 0 AS f, ['ok', 'fail', 'bad', 'warn', ''][doc_id % 5 + 1] AS q FROM documents)
SELECT doc_id, code FROM (SELECT doc_id, unnest([CASE WHEN c = 'odd' THEN 'invalid_conversion_status' END, CASE WHEN p = 'gone' THEN 'invalid_preservation_status' END, CASE WHEN q = 'bad' THEN 'invalid_quality_status' END,
CASE WHEN f AND c = 'failed' THEN 'failed_conversion_searchable' END, CASE WHEN f AND q = 'fail' THEN 'failed_quality_searchable' END]) AS code FROM s) WHERE code IS NOT NULL""")
def status_matrix_violations(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", pick(["pending", "converted", "failed", "odd"]).alias("c"), pick(["preserved", "gone", ""]).alias("p"), (F.col("doc_id") % 2 == 0).alias("f"), pick(["ok", "fail", "bad", "warn", ""]).alias("q"))
    return quality.violations(d, quality.status_rules(F.col("c"), F.col("p"), F.col("f"), F.col("q")), ["doc_id"], "document").select("doc_id", "code")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'empty_text,very_short_text' WHEN doc_id % 3 = 1 THEN 'conversion_failed' ELSE '' END AS codes, doc_id % 2 = 0 AS searchable FROM documents""")
def effective_fallbacks(spark, sf_dir):
    k = F.col("doc_id") % 3
    codes = F.when(k == 0, F.array(F.lit("very_short_text "), F.lit("empty_text"), F.lit("empty_text"))).otherwise(F.array().cast("array<string>"))
    flags = F.when(k == 1, "conversion_failed,").otherwise("")
    status = F.when(F.col("doc_id") % 2 == 0, "converted").otherwise("pending")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(entities.quality_codes(codes, flags), ",").alias("codes"), entities.attachment_searchable(F.lit(None).cast("boolean"), F.lit(""), status).alias("searchable"))


@query("""WITH d AS (SELECT doc_id, source FROM documents), x AS (SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN 'x' ELSE source END AS source FROM documents)
SELECT 'changed' AS which, NOT EXISTS (FROM d EXCEPT ALL FROM x) AND NOT EXISTS (FROM x EXCEPT ALL FROM d) AS equal
UNION ALL SELECT 'doubled', NOT EXISTS (FROM d EXCEPT ALL (FROM d UNION ALL FROM d)) AND NOT EXISTS ((FROM d UNION ALL FROM d) EXCEPT ALL FROM d)
UNION ALL SELECT 'shuffled', NOT EXISTS (FROM d EXCEPT ALL (FROM d ORDER BY source)) AND NOT EXISTS ((FROM d ORDER BY source) EXCEPT ALL FROM d)""")
def snapshot_documents_equal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    others = {"changed": d.withColumn("source", F.when(F.col("doc_id") % 100 == 1, "x").otherwise(F.col("source"))), "doubled": d.union(d), "shuffled": d.repartition("source")}
    found = [quality.same_documents(d, other, ["doc_id", "source"]).select(F.lit(name).alias("which"), "equal") for name, other in others.items()]
    return found[0].union(found[1]).union(found[2])


# --- evaluation and logs ---


@query(f"""WITH {POSTINGS}, h AS (SELECT doc_id, count(DISTINCT token) AS n FROM p WHERE token IN ('the', 'and', 'schen') GROUP BY doc_id), a AS (SELECT doc_id FROM h ORDER BY n DESC, doc_id LIMIT 5),
g AS (SELECT doc_id, count(DISTINCT token) AS n FROM p WHERE token IN ('der', 'the', 'les') GROUP BY doc_id), b AS (SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n DESC, doc_id LIMIT 5)
SELECT doc_id AS chunk_id, CAST(0 AS INTEGER) AS query FROM a UNION ALL SELECT doc_id, CAST(1 AS INTEGER) FROM b""")
def sample_chunks_by_query(spark, sf_dir):
    got = evaluation.select_chunks(doc_postings(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")), evaluation.split_queries("the and schen| der the les | "), 5, 100)
    return got.select(F.col("chunk_id").cast("long").alias("chunk_id"), "query")


@query(f"""WITH rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), {POSTINGS},
qt AS (SELECT item_id, unnest(list_distinct({WORDS.format("text")})) AS token FROM benchmark WHERE item_id IN (SELECT item_id FROM rel)),
s AS (SELECT item_id, doc_id, sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * n / al))) AS score FROM p JOIN qt USING (token) JOIN (SELECT token, count(*) AS df FROM p GROUP BY token) USING (token), st GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
hit AS (SELECT DISTINCT item_id FROM rel JOIN r USING (item_id, doc_id) WHERE rank <= 5)
SELECT (SELECT count(DISTINCT item_id) FROM rel) AS cases, (SELECT count(*) FROM hit) AS hits, round((SELECT count(*) FROM hit) / (SELECT count(DISTINCT item_id) FROM rel), 6) AS recall""")
def recall_at_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark")
    rel = evaluation.containing(d, b.select("item_id", F.col("text").alias("item"))).select(F.col("item_id").alias("query_id"), "doc_id")
    asked = b.join(rel.select(F.col("query_id").alias("item_id")).distinct(), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), F.explode(text.tokens("text")).alias("token"))
    # a token has a character, so the items' characters bound the rows
    small = F.broadcast if 64 * (b.agg(F.sum(F.length("text"))).first()[0] or 0) <= 24 << 20 else lambda x: x
    # dealt by document once: its tokens are counted and its scores summed where it stands, and only each query's first ranks move again
    one = d.repartition("doc_id").select("doc_id", text.index_tokens("text").alias("toks")).select("doc_id", F.size("toks").alias("n_tokens"), F.explode("toks").alias("token"))
    p = one.join(small(asked.select("token").distinct()), "token", "left_semi").groupBy("token", "doc_id", "n_tokens").agg(F.count("*").alias("tf"))
    wanted = asked.join(frequencies(p), "token")
    parts = p.join(small(wanted), "token").join(F.broadcast(statistics(d, "text")))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("n_tokens") / F.col("avg_len")))
    s = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return evaluation.recall_at(r, rel, 5).withColumn("recall", F.round("recall", 6))


@query("SELECT event_type AS tool, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY event_type")
def tool_metrics(spark, sf_dir):
    return evaluation.tool_metrics(table(spark, sf_dir, "events"), "event_type", F.col("value")).select(F.col("event_type").alias("tool"), "calls", F.round("seconds", 4).alias("seconds"))


@query("""SELECT 'requests_total{tool="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf_dir):
    return evaluation.exposition(evaluation.request_counts(table(spark, sf_dir, "events"), "event_type"), "requests_total", "tool", "event_type", "n")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY user_id, start")
def rate_windows(spark, sf_dir):
    return evaluation.rate_windows(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH r AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT event_id, recent FROM r WHERE recent > 2""")
def over_rate(spark, sf_dir):
    return evaluation.over_rate(table(spark, sf_dir, "events"), "user_id", "ts", 2, 86400).select("event_id", "recent")


@query()
def rate_limit_fixed_window(spark, sf_dir):
    return evaluation.rate_limited(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1, 86400)


@query()
def publish_roundtrip(spark, sf_dir):
    """Build, publish and reload an index, then search it."""
    from .plans.service import Service
    from .sources import generation
    from .operators.index import Index

    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not os.path.isdir(shared) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder that the driver sees")
    root = tempfile.mkdtemp(prefix="corpusq-generation-", dir=shared if os.path.isdir(shared) else None)
    chunks = window_chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "ord", "idx", "text", F.lit("body").alias("source"), *[F.lit("").alias(c) for c in ("attachment_id", "attachment_title", "attachment_file", "attachment_status", "article_id")], F.array().cast("array<string>").alias("heading_path"))
    docs = corpus(spark, sf_dir).drop("doc_id")
    p = postings_by_row(chunks, "text")
    generation.publish(root, Index(chunks, p, frequencies(p), statistics(chunks, "text"), docs))
    index, _ = generation.load(spark, root)
    return Service(index).search("the and schen").select("id", F.round("bm25", 6).alias("bm25"), "chunk_id")
