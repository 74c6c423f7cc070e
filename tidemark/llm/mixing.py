"""Mixing sources to target weights by Poisson replication.

Each document is repeated K times, where K inverts the Poisson distribution whose mean
is the repetition rate its source needs (target weight x target size / source size) at a
uniform number hashed from the seed and the document id. Copies are then put in a global
random order given by a hash of (seed, id, copy). Both numbers are functions of the row
alone, so a recomputed task gives the same rows.

Semantics
* ``weights`` names target shares by source, normalised over the sources present; without
  it the share of a source is its size to the power ``temperature``. A source that the
  weights omit has share 0. The null source is a source of its own.
* ``rate_scale`` multiplies all rates (1.0: the output has, in expectation, as many
  documents as the input).
* Rates above ``MAX_MEAN`` are drawn as a sum of independent Poisson variables, so no rate
  is capped; a null id draws as the empty id. Rows repeating a doc_id draw the same K. An empty table gives no rows.
  All columns of the input stay; ``copy_no`` and ``order_key`` are added (a column of the
  input with such a name is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inversion adds up exp(-mean) terms, which stay far above the smallest double up to here.
MAX_MEAN = 500.0
#: The per-source table is broadcast up to this many rows (about 2 MB); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"
TWO52 = float(2**52)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, the same in any engine that has MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(TWO52)


def poisson_count(u: Column, mean: Column) -> Column:
    """The smallest k with u < P(X <= k), for mean up to MAX_MEAN.

    The terms are cut where what remains is under 2**-60, below the grain of ``u``.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).cast("int").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(
            p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + F.when(u >= acc["cdf"], 1).otherwise(0)).cast("int").alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def replication(rate: Column, *key: Column) -> Column:
    """Poisson(rate) copies for the row of ``key``."""
    draws = F.greatest(F.ceil(rate / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), draws), F.lit(0), lambda acc, i: acc + poisson_count(unit_hash(F.lit(SEED), *key, i), rate / draws)
    )
    return F.when(rate > 0, drawn).otherwise(0)


def source_rates(docs: DataFrame, weights: dict | None, temperature: float, rate_scale: float, source_col: str) -> DataFrame:
    """``mix_source, mix_rate``: pre-aggregated counts, one row per source."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    totals = sizes.select("mix_source", "n", share.alias("share"))
    everything = totals.agg(F.sum("share").alias("s"), F.sum("n").alias("total")).first()
    s, total = (everything["s"] or 0.0), (everything["total"] or 0)
    return totals.select("mix_source", (F.lit(rate_scale * total / s if s else 0.0) * F.col("share") / F.col("n")).alias("mix_rate"))


def mix(
    docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, rate_scale: float = 1.0,
    id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None,
) -> DataFrame:
    """Documents repeated to their source's target weight, in global random order."""
    if not (rate_scale >= 0 and math.isfinite(rate_scale)):
        raise ValueError("rate_scale must be a finite number, 0 or more")
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("copy_no", "order_key")]
    rates = source_rates(docs, weights, temperature, rate_scale, source_col)
    n_sources = rates.count()
    rates = F.broadcast(rates) if n_sources <= BROADCAST_SOURCES else rates
    # The row travels as one struct, so that none of its names can clash with those used here.
    left = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs[source_col].alias("source"), docs[id_col].alias("key"))
    joined = left.join(rates, left["source"].eqNullSafe(rates["mix_source"]))
    copies = joined.select("doc", "key", replication(F.col("mix_rate"), F.col("key")).alias("copies")).filter("copies > 0")
    rows = copies.select("doc", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    keyed = rows.withColumn("order_key", unit_hash(F.lit(SEED + "-order"), F.col("key"), F.col("copy_no")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The key is uniform by construction, so its ranges are known without sampling the data.
    dealt = keyed.repartitionById(n, F.floor(F.col("order_key") * n).cast("int"))
    return dealt.sortWithinPartitions("order_key", "key", "copy_no").select("doc.*", "copy_no", "order_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, ((SELECT sum(n) FROM sizes) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes)) * sqrt(n::DOUBLE) / n AS rate FROM sizes),
terms AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
          FROM rates, generate_series(0, 200) AS g(k)),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (
           SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms) GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(c.cdf, lambda x: x <= u)) AS n
          FROM (SELECT *, ('0x' || substr(md5('mix-1:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u
                FROM documents) d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('mix-1-order:' || doc_id || ':' || copy_no), 1, 13))::BIGINT / 4503599627370496.0 AS order_key
FROM (SELECT *, unnest(generate_series(1, n)) AS copy_no FROM drawn WHERE n > 0)
"""
