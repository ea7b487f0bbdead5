"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small, stored

#: Above it, the first probability nears what a double can hold: distribution functions start near the mean instead.
MOST_RATE = 500.0


def hash_uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of seed and the columns as text; null counts as empty."""
    key = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_start(rate: Column) -> Column:
    """The least count that poisson_cdf tells from 0: 0 up to MOST_RATE, else 12 standard deviations and 20 below the mean (a tail of under 2**-100)."""
    return F.when(rate <= MOST_RATE, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 20).cast("int"))


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at poisson_start(rate) and on, as far as a number of 52 bits can tell it from 1. For any mean."""
    low = poisson_start(rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    k = F.greatest(low, F.lit(1)).cast("double")
    d = rate - k  # the log of the first probability: Stirling's series, without taking large numbers from each other
    log_first = k * F.log1p(d / k) - d - F.log(2 * math.pi * k) / 2 - 1 / (12.0 * k) + 1 / (360.0 * k * k * k)
    first = F.when(rate <= MOST_RATE, F.exp(-rate)).otherwise(F.exp(log_first))
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(s, k):
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(low + 1, last), start, step, lambda s: s["c"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5) -> DataFrame:
    """source and rate: how often, in the mean, its documents are to be repeated so that sources have their target weights.

    weights(source, weight) are shares of the bytes, in any unit; a source that it lacks gets none. Without weights, the
    target is the source's bytes to the power, which lifts small sources. The mixture has as many bytes as docs, in the
    mean. A source without bytes keeps rate 1 where its weight isn't 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        target = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(power)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        target = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    totals = target.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.when(F.col("bytes") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")).otherwise(F.when(F.col("weight").isNotNull(), F.lit(1.0)))
    return target.crossJoin(F.broadcast(totals)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) repeated to the target weights and shuffled globally, with mix_copy and mix_key.

    A document has Poisson(rate) copies: the inverse of the distribution function at a hash of its doc_id. Copies are
    dealt to partitions by the hash mix_key and sorted by it, so any run of output rows is a random sample.

    A null source is a source of its own. Null and empty texts have no bytes and are repeated at their source's rate.
    Rows that repeat a doc_id draw alike; rows without doc_id draw alike. An empty table gives an empty one. Other columns
    are kept, whatever their names; columns named mix_copy or mix_key (in any case) are replaced. Rates may have any size.
    """
    spark = docs.sparkSession
    rates = stored(source_rates(docs, weights, power), "rates")
    names = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    own = "_"  # a beginning that no column's name has, so that none can clash with those of the drawing
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    u, n, low, cdf, source = (f"{own}{x}" for x in ("u", "n", "low", "cdf", "source"))
    kept = [F.col(f"`{c}`") for c in names]
    table = small(stored(rates.select(F.col("source").alias(source), poisson_start(F.col("rate")).alias(low), poisson_cdf(F.col("rate")).alias(cdf)), "distributions"))
    drawn = docs.select(*kept, hash_uniform(seed, F.col("doc_id")).alias(u)).join(table, F.col("source").eqNullSafe(F.col(source)))
    count = F.col(low) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    copies = drawn.select(*kept, count.alias(n)).filter(F.col(n) > 0).select(*kept, F.explode(F.sequence(F.lit(1), F.col(n))).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_copy"))))
    return keyed.repartition(partitions(spark), "mix_key").sortWithinPartitions("mix_key", "doc_id")
