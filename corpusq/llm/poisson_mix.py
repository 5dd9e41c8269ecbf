"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target bytes over its bytes. A document's
count inverts the Poisson distribution of that mean at a uniform number hashed
from its id and a seed: rerun tasks draw the same counts, and no state is kept.
Copies are then dealt to partitions and put in order by a hash of id and copy,
which is a shuffle of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

SEED = "mix-1"
#: Target weight of a source: its bytes to this power (1: as it is, 0: all sources alike).
ALPHA = 0.5
#: Bytes wanted in all, as a multiple of the bytes there are.
EPOCHS = 1.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest; other engines can restate it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, source: str = "source", text: str = "text") -> DataFrame:
    """(mix_source, bytes, rate) for each source; a null source is one of its own.

    ``weights`` gives target shares by source (others, and null, 0); without it
    shares go by bytes to the power ``alpha``. A source of no bytes has rate 1.
    """
    size = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        share = F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(float(alpha)))).otherwise(0.0)
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (weights or {"": 0.0}).items() for x in (kv[0], float(kv[1]))]), F.coalesce(F.col("mix_source"), F.lit("\0null"))), F.lit(0.0))
    shared = size.withColumn("share", share)
    total = shared.agg(F.sum("bytes").alias("all_bytes"), F.sum("share").alias("all_shares"))
    rate = F.when(F.col("bytes") == 0, 1.0).when(F.col("all_shares") == 0, 0.0).otherwise(F.col("share") / F.col("all_shares") * F.col("all_bytes") * epochs / F.col("bytes"))
    return shared.join(F.broadcast(total)).select("mix_source", "bytes", rate.alias("rate"))  # total: one row


def cumulative(rated: DataFrame) -> DataFrame:
    """Adds ``cdf``: the Poisson distribution function at 0, 1, ... up to where it rounds to 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rated.select("mix_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("mix_source", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = -F.col("rate") + F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.log("rate")) - F.col("lf")
    masses = steps.withColumn("lf", F.sum(F.log(F.greatest(F.col("k"), F.lit(1)))).over(upto))
    masses = masses.withColumn("p", F.when(F.col("rate") == 0, F.when(F.col("k") == 0, 1.0).otherwise(0.0)).otherwise(F.exp(log_p)))
    summed = masses.withColumn("c", F.sum("p").over(upto))
    return summed.groupBy("mix_source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every column of ``docs``, each row as often as drawn, with ``mix_copy`` (0, 1, ...) and ``mix_key``; shuffled.

    Rows that share an id draw the same count; a null id draws as "null". Rows of
    an empty table give none. Null and very long texts come out as they are; input
    columns called mix_copy or mix_key are replaced. A hot source costs nothing: sizes
    combine on the map side and rates join as one row for each source.
    """
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    rated = materialize(cumulative(rates(docs, weights, alpha, epochs, source, text)).select("mix_source", "cdf"), "rates")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"))
    drawn = given.join(broadcast_if_small(rated, 256), F.col("source").eqNullSafe(F.col("mix_source")))
    counted = drawn.withColumn("u", uniform(F.lit(seed), F.col("id"))).withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string")).cast("binary"))
    keyed = copies.select("row", "mix_copy", key.alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", "mix_copy", "mix_key")


ORACLE = """
WITH size AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM {docs} GROUP BY source),
shared AS (SELECT *, CASE WHEN bytes > 0 THEN pow(CAST(bytes AS DOUBLE), 0.5) ELSE 0 END AS share FROM size),
rated AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE share / sum(share) OVER () * sum(bytes) OVER () * 1.0 / bytes END AS rate FROM shared),
mass AS (
  SELECT source, k, CASE WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END
                         ELSE exp(-rate + CASE WHEN k = 0 THEN 0.0 ELSE k * ln(rate) END - lgamma(k + 1)) END AS p
  FROM rated, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS g(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM mass),
listed AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda x: x <= CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
  FROM {docs} d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source)
SELECT {columns}, CAST(mix_copy AS INTEGER) AS mix_copy, md5('mix-1|order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || mix_copy) AS mix_key
FROM drawn, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS g(mix_copy) WHERE n > 0
"""
