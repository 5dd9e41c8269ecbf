"""Sampling of chunks for embedding, retrieval quality, and request logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .lexicon import tokenize


def split_queries(text: str) -> list[str]:
    return [q for q in map(str.strip, text.split("|")) if q]


def select_chunks(postings: DataFrame, queries: list[str], per_query: int, limit: int) -> DataFrame:
    """(chunk_id, ord, query): for each query its chunks with most distinct query tokens, earlier ones if tied, that no earlier query took.

    A query needs at most per_query chunks beyond those taken before it, so each
    query keeps a top list of that bounded length and the lists are merged on the
    driver; the index itself is only scanned.
    """
    taken: dict[str, tuple[int, int]] = {}
    for i, query in enumerate(queries):
        words = tokenize(query)
        if not words or len(taken) >= limit:
            continue
        hit = postings.where(F.col("token").isin(words)).groupBy("chunk_id", "ord").agg(F.countDistinct("token").alias("n"))
        # at most len(taken) of the best are gone, so this many hold per_query fresh ones
        for r in hit.orderBy(F.desc("n"), "ord").limit(per_query + len(taken)).collect():
            if sum(q == i for _, q in taken.values()) >= per_query or len(taken) >= limit:
                break
            taken.setdefault(r.chunk_id, (r.ord, i))
    rows = [(k, o, q) for k, (o, q) in taken.items()]
    return postings.sparkSession.createDataFrame(rows, "chunk_id string, ord long, query int")


def containing(docs: DataFrame, items: DataFrame, seed: int = 3) -> DataFrame:
    """(item_id, doc_id) where a text of ``docs(doc_id, text)`` contains an ``items(item_id, item)`` whole.

    The inner words of an item stand between blanks in every text that holds it, so
    its words from the second on are a seed; texts join on their runs of words, and only
    what shares a seed is searched. Items of too few words for a seed are searched in all
    texts, as containment has no key then.
    """
    words = F.split("item", " ")
    long = F.size(words) >= seed + 2
    key = lambda w, at: F.xxhash64(*[F.element_at(w, at + k) for k in range(seed)])
    seeded = items.where(long).select("item_id", "item", key(words, 2).alias("seed"))
    split = docs.select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= seed)
    runs = split.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (seed - 1)), lambda i: key(F.col("w"), i)))).alias("seed"))
    met = runs.join(seeded.select("item_id", "seed"), "seed").select("item_id", "doc_id")
    found = met.join(docs, "doc_id").join(seeded.select("item_id", "item"), "item_id")
    rest = docs.join(items.where(~long), F.contains("text", "item"))
    both = [x.where(F.contains("text", "item")).select("item_id", "doc_id") for x in (found, rest)]
    return both[0].union(both[1])


def recall_at(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: cases, hits, recall. ``results(query_id, doc_id, rank)``, ``relevant(query_id, doc_id)``; queries without relevant documents do not count."""
    hit = relevant.join(results.where(F.col("rank") <= k), ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    cases = relevant.select("query_id").distinct().join(hit, "query_id", "left")
    summed = cases.agg(F.count("*").alias("cases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return summed.withColumn("recall", F.when(F.col("cases") > 0, F.col("hits") / F.col("cases")).otherwise(0.0))


def request_counts(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n"))


def tool_metrics(log: DataFrame, key: str, seconds: Column) -> DataFrame:
    """(key, calls, seconds)."""
    return log.groupBy(key).agg(F.count("*").alias("calls"), F.sum(seconds).alias("seconds"))


def exposition(metrics: DataFrame, name: str, label: str, key: str, value: str) -> DataFrame:
    """Lines of the text exposition format; ``label`` names what ``key`` holds."""
    text = F.replace(F.replace(F.replace(F.col(key).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return metrics.select(F.concat(F.lit(f'{name}{{{label}="'), text, F.lit('"} '), F.col(value).cast("string")).alias("line"))


def rate_limited(log: DataFrame, host: str, at: str, most: int, seconds: int) -> DataFrame:
    """The log with ``allowed``: ``most`` requests of a host in windows that start at its first request after the last window.

    Window starts depend on the requests before them. Hosts are walked in order
    inside sorted partitions, one row at a time and with one counter, so a host
    that makes most requests needs no more memory than another.
    """
    names = log.columns
    schema = StructType([*log.schema.fields, StructField("allowed", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, used = None, None, 0
        for pdf in batches:
            out = []
            for h, t in zip(pdf[host], pdf[at]):
                if h != now or t >= start + pd.Timedelta(seconds=seconds):
                    now, start, used = h, t, 0
                used += 1
                out.append(used <= most)
            yield pdf[names].assign(allowed=out)

    return log.repartition(host).sortWithinPartitions(host, at).mapInPandas(run, schema)


def rate_windows(log: DataFrame, host: str, at: str, seconds: int) -> DataFrame:
    """Requests by host and epoch-aligned window: the form that needs no order."""
    return log.groupBy(host, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(host, F.col("w.start").alias("start"), "n")


def over_rate(log: DataFrame, host: str, at: str, most: int, seconds: int) -> DataFrame:
    """Requests with more than ``most`` of their host in the ``seconds`` up to them: a range frame."""
    w = Window.partitionBy(host).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("recent", F.count("*").over(w)).where(F.col("recent") > most)
