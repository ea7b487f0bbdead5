"""Sensitivity, resampling and statistics. Randomness is the MD5 of id and replica, so results repeat anywhere."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.operators.identity import global_rank
from lorespan.sources.folders import stored, tables

Z95 = 1.959963984540054


def hash_share(ident: Column, replica: Column) -> Column:
    """A number in [0, 1) of 32 bits from id and replica."""
    return F.conv(F.substring(F.md5(F.concat(ident.cast("string"), F.lit(":"), replica.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def threshold_sweep(df: DataFrame, column: str, thresholds: list[float], value: str, chosen: float, tolerance: float = 0.1) -> DataFrame:
    """threshold, n, mean of value among rows at or above each threshold, chosen, stable (within tolerance of the chosen one's mean); one scan for all thresholds."""
    at = thresholds.index(chosen)
    aggs = [x for k, t in enumerate(thresholds) for x in (F.count_if(F.col(column) >= t).alias(f"n{k}"), F.avg(F.when(F.col(column) >= t, F.col(value))).alias(f"m{k}"))]
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n"), F.round(f"m{k}", 6).alias("mean"), F.lit(t == chosen).alias("chosen"), (F.abs(F.col(f"m{k}") - F.col(f"m{at}")) <= tolerance * F.abs(F.col(f"m{at}"))).alias("stable")) for k, t in enumerate(thresholds)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def method_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, adjusted Rand index and Jaccard (of the pairs that each puts together) of two labelings, from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    x = both.crossJoin(side(a, "sa")).crossJoin(side(b, "sb"))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    return x.select(F.col("t").alias("n"), F.round((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected), 6).alias("ari"), F.round(F.col("s") / (F.col("sa") + F.col("sb") - F.col("s")), 6).alias("jaccard"))


def preprocessing_sweep(df: DataFrame, variants: dict[str, Column], value: str) -> DataFrame:
    """variant, n, mean: each filter's result, all in one pass."""
    aggs = [x for k, c in variants.items() for x in (F.count_if(c).alias(f"n_{k}"), F.avg(F.when(c, F.col(value))).alias(f"m_{k}"))]
    rows = F.array(*(F.struct(F.lit(k).alias("variant"), F.col(f"n_{k}").alias("n"), F.round(f"m_{k}", 6).alias("mean")) for k in variants))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def subsample_stability(df: DataFrame, ident: str, value: str, label: Column, n: int = 5, share: float = 0.8) -> DataFrame:
    """replica, diff (mean of value where label, less the others) in n hash-drawn parts; one scan, no copies of rows."""
    on = [hash_share(F.col(ident), F.lit(k)) < share for k in range(n)]
    aggs = [x for k in range(n) for x in (F.avg(F.when(on[k] & label, F.col(value))).alias(f"a{k}"), F.avg(F.when(on[k] & ~label, F.col(value))).alias(f"b{k}"))]
    rows = F.array(*(F.struct(F.lit(k).alias("replica"), F.round(F.col(f"a{k}") - F.col(f"b{k}"), 6).alias("diff")) for k in range(n)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def stability_verdict(replicas: DataFrame, observed: DataFrame, least: float = 0.8) -> DataFrame:
    """n, holds (the share of replicas(diff) with the sign of observed(diff)), fragile (below least)."""
    x = replicas.crossJoin(F.broadcast(observed.select(F.col("diff").alias("_o")))).agg(F.count("*").alias("n"), F.round(F.avg((F.signum("diff") == F.signum("_o")).cast("double")), 6).alias("holds"))  # one row of observed
    return x.withColumn("fragile", F.col("holds") < least)


def seed_stability(df: DataFrame, ident: str, value: str, label: Column, seeds: tuple[int, ...] = (42, 123, 456, 789, 2024), share: float = 0.5) -> DataFrame:
    """n, mean, sd, low, high of the label's effect in parts drawn by the hash of id and each seed: one scan."""
    on = [hash_share(F.col(ident), F.lit(k)) < share for k in seeds]
    x = df.agg(*(F.avg(F.when(o & c, F.col(value))).alias(f"{n}{k}") for k, o in enumerate(on) for n, c in (("a", label), ("b", ~label))))
    rows = x.select(F.explode(F.array(*(F.col(f"a{k}") - F.col(f"b{k}") for k in range(len(seeds))))).alias("d"))
    return rows.agg(F.count("d").alias("n"), *(F.round(f("d"), 6).alias(k) for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))))


#: A prime: hashes are polynomials modulo it, so all products fit 64 bits.
PRIME = 2**31 - 1
#: Replicas whose sums a task holds at once, with all their bins.
REPLICAS_AT_ONCE = 250


def unit_place(ident: Column) -> Column:
    """A number below PRIME from the MD5 of a unit's id."""
    return F.conv(F.substring(F.md5(ident.cast("string")), 1, 13), 16, 10).cast("long") % PRIME


def coefficients(seed: str, replica: int) -> list[int]:
    """Four numbers below PRIME from the MD5 of seed and replica."""
    digest = hashlib.md5(f"{seed}:{replica}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) % PRIME for k in range(4)]


def replica_hashes(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """A hash below PRIME for each replica (rows) and unit: a cubic polynomial of the unit's number, so any four units are independent over replicas."""
    h = np.broadcast_to(coef[:, :1], (len(coef), len(x)))
    for k in (1, 2, 3):
        h = (h * x[None, :] + coef[:, k : k + 1]) % PRIME
    return h


def _hash_sums(units: DataFrame, coef: np.ndarray, bits: int, above: int, within: dict[int, int] | None = None) -> DataFrame:
    """rep, bin, n, s, c: sums of units(x, s, c) by bins of each replica's hash: `bits` bits of it, below `above` others, which are within[rep] where given.

    A task adds up all replicas of its units in arrays; what leaves it is a row for each replica and bin, however many units there are.
    """
    shift = 31 - above - bits
    reps = sorted(within) if within is not None else list(range(len(coef)))
    want = None if within is None else np.array([within[r] for r in reps], np.int64)

    def add(batches):
        held = [b.to_pandas() for b in batches]
        rows = {c: np.concatenate([h[c].to_numpy() for h in held]) if held else np.zeros(0) for c in ("x", "s", "c")}
        x, s, c = rows["x"].astype(np.int64), rows["s"].astype(np.float64), rows["c"].astype(np.float64)
        for at in range(0, len(reps) if len(x) else 0, REPLICAS_AT_ONCE):
            some = np.array(reps[at : at + REPLICAS_AT_ONCE])
            total = np.zeros((3, len(some) << bits))
            for i in range(0, len(x), 2_000):
                part = slice(i, i + 2_000)
                h = replica_hashes(x[part], coef[some])
                r, u = np.nonzero((h >> (31 - above)) == want[at : at + REPLICAS_AT_ONCE, None]) if above else np.nonzero(h >= 0)
                where = (r << bits) + ((h[r, u] >> shift) & ((1 << bits) - 1))
                for k, w in enumerate((None, s[part][u], c[part][u])):
                    total[k] += np.bincount(where, w, len(some) << bits)
            full = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(some[full >> bits].astype(np.int32)), pa.array((full & ((1 << bits) - 1)).astype(np.int64)), pa.array(total[0][full].astype(np.int64)), pa.array(total[1][full]), pa.array(total[2][full])], names=["rep", "bin", "n", "s", "c"])

    sums = units.select("x", "s", "c").mapInArrow(add, "rep int, bin long, n long, s double, c double")
    return sums.groupBy("rep", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def _least_hashes(sums: DataFrame, need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of _hash_sums(), what the bins that are wholly among the need(rep, k) least hashes add up to (rep, s, c), and the bin at the border (rep, bin, k: how many of it)."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("rep").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = stored(sums.withColumn("before", before).join(need, "rep"), "hash-bins")
    whole = bins.filter(F.col("before") + F.col("n") <= F.col("k")).groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    border = bins.filter((F.col("before") < F.col("k")) & (F.col("before") + F.col("n") > F.col("k"))).select("rep", "bin", (F.col("k") - F.col("before")).alias("k"))
    return whole, border


def permutation_test(df: DataFrame, unit: str, value: str, label: Column, n: int = 1_000) -> DataFrame:
    """observed, p_value, n: labels dealt anew by the order of hashes within each replica, at the level of units.

    Rows are first summed to units. The units with the least hashes of a replica get the label, as many as have it. Which
    these are is found by sums over ranges of the hash: 256 of all, then 4,096 of the one at the border, then the few units
    of that border by their order (ties by id). So tasks send replicas times ranges, and not units times replicas.
    """
    with tables(df.sparkSession) as scope:
        units = df.groupBy(unit).agg(F.sum(value).cast("double").alias("s"), F.count("*").cast("double").alias("c"), F.max(label).alias("l"))
        units = stored(units.withColumn("x", unit_place(F.col(unit))), "units")
        coef = np.array([coefficients("perm", r) for r in range(n)], np.int64).reshape(n, 4)
        k = units.agg(F.count_if("l").alias("k"))
        reps = df.sparkSession.range(n).select(F.col("id").cast("int").alias("rep"))
        parts, border = _least_hashes(_hash_sums(units, coef, 8, 0), reps.crossJoin(F.broadcast(k)))  # one row
        chosen = [parts]
        border = stored(border, "border")
        top = {r.rep: r.bin for r in border.collect()}  # a row for each replica
        parts, below = _least_hashes(_hash_sums(units, coef, 12, 8, top), border.select("rep", "k"))
        chosen.append(parts)
        below = stored(below, "border")
        last = {r.rep: (top[r.rep] << 12) | r.bin for r in below.collect()}

        def few(batches):
            some = np.array(sorted(last), np.int64)
            want = np.array([last[r] for r in some.tolist()], np.int64)
            for batch in batches:
                x, ident = batch.column("x").to_numpy(), batch.column("ident")
                h = replica_hashes(x, coef[some]) if len(some) else np.zeros((0, len(x)), np.int64)
                r, u = np.nonzero((h >> 11) == want[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(some[r].astype(np.int32)), pa.array(h[r, u]), ident.take(pa.array(u)), batch.column("s").take(pa.array(u)), batch.column("c").take(pa.array(u))], names=["rep", "h", "ident", "s", "c"])

        kind = units.schema[unit].dataType.simpleString()
        rows = units.select("x", F.col(unit).alias("ident"), "s", "c").mapInArrow(few, f"rep int, h long, ident {kind}, s double, c double")
        order = F.row_number().over(W.partitionBy("rep").orderBy("h", "ident"))
        chosen.append(rows.withColumn("o", order).join(below.select("rep", "k"), "rep").filter(F.col("o") <= F.col("k")).select("rep", "s", "c"))
        sums = reduce(DataFrame.unionByName, chosen).groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        whole = units.agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"))
        mean = lambda c: F.sum(F.when(c, F.col("s"))) / F.sum(F.when(c, F.col("c")))
        seen = units.agg((mean(F.col("l")) - mean(~F.col("l"))).alias("obs"))
        null = sums.crossJoin(F.broadcast(whole)).select((F.col("s") / F.col("c") - (F.col("_s") - F.col("s")) / F.nullif(F.col("_c") - F.col("c"), F.lit(0.0))).alias("d"))
        out = null.crossJoin(F.broadcast(seen)).groupBy("obs").agg(F.avg((F.abs("d") >= F.abs("obs") - 1e-12).cast("double")).alias("p"), F.count("*").alias("n"))
        return scope.keep(out.select(F.round("obs", 6).alias("observed"), F.round("p", 6).alias("p_value"), "n"), "permutation")


#: The distribution function of Poisson(1) at 0, 1, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


def poisson_bootstrap(df: DataFrame, unit: str, value: str, n: int = 2_000) -> DataFrame:
    """replica and mean under Poisson(1) weights of the units, drawn by hash: the scalable bootstrap, which is not the fixed-size one.

    Rows are first summed to units. Every unit has a draw of its own in every replica, from the MD5 of both, which is held
    against the distribution's steps as hexadecimal digits. Tasks add up by replica before anything leaves them.
    """
    session = df.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    units = df.groupBy(unit).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("c"))
    units = units.repartition(parts)  # few bytes, but n draws a row: they are not to be coalesced
    drawn = units.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("h", F.md5(F.concat(F.col(unit).cast("string"), F.lit(":"), F.col("replica").cast("string"))))
    steps = [f"{math.ceil(c * 2**32):08x}" for c in POISSON]  # the digest's first 32 bits, by 2 ** 32, reach c
    weight = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        weight = F.when(F.col("h") < steps[k], k).otherwise(weight)
    sums = drawn.withColumn("w", weight).groupBy("replica").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("c")).alias("c"))
    return sums.select("replica", F.round(F.col("s") / F.nullif(F.col("c"), F.lit(0.0)), 6).alias("mean"))


def bootstrap_ci(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """lo, hi: percentiles (nearest rank) of replicas' means."""
    w = W.orderBy("mean", "replica")
    ranked = means.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy()))  # as many rows as replicas
    at = lambda q: F.min(F.when(F.col("r") >= F.ceil(F.col("n") * q), F.col("mean")))
    return ranked.agg(at(low).alias("lo"), at(high).alias("hi"))


def outlier_removed_rerun(df: DataFrame, label: Column, value: str, sds: float = 3.0) -> DataFrame:
    """effect_size() of the rows whose value lies within so many standard deviations of the mean, and how many others (and rows without value) there were."""
    c = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    marked = df.crossJoin(F.broadcast(c)).withColumn("_in", F.coalesce(F.abs(F.col(value) - F.col("_m")) <= sds * F.col("_s"), F.lit(False)))  # one row
    return effect_size(marked.filter("_in"), label, value).crossJoin(marked.agg(F.count_if(~F.col("_in")).alias("n_removed")))


def effect_size(df: DataFrame, label: Column, value: str) -> DataFrame:
    """mean_diff, cohens_d, hedges_g, log2_fc of value where label, against the others."""
    a, b = F.when(label, F.col(value)), F.when(~label, F.col(value))
    x = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    free = F.col("na") + F.col("nb") - 2
    d = (F.col("ma") - F.col("mb")) / F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / free)
    return x.select(F.round(F.col("ma") - F.col("mb"), 6).alias("mean_diff"), F.round(d, 6).alias("cohens_d"), F.round(d * (1 - 3 / (4 * free - 1)), 6).alias("hedges_g"), F.round(F.log2(F.col("ma") / F.col("mb")), 6).alias("log2_fc"))


def adjust_pvalues(df: DataFrame, ident: str, p: str) -> DataFrame:
    """ident, p, bonferroni, bh (Benjamini-Hochberg) of all tests; in ranges of p, so no task holds all of them."""
    ranked = stored(global_rank(df.select(ident, F.col(p).alias("p")).filter("p is not null"), [F.col("p"), F.col(ident)], "rank"), "ranked")
    total = ranked.agg(F.count("*").alias("m"))
    rows = ranked.crossJoin(F.broadcast(total)).withColumn("q", F.col("p") * F.col("m") / F.col("rank")).repartitionByRange(F.col("rank")).withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "rank-ranges")
    least = rows.groupBy("_part").agg(F.min("q").alias("_q"))
    after = least.select("_part", F.min("_q").over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    inner = rows.withColumn("_own", F.min("q").over(W.partitionBy("_part").orderBy(F.desc("rank"))))
    out = inner.join(F.broadcast(after), "_part")
    return out.select(ident, "p", F.round(F.least(F.lit(1.0), F.col("p") * F.col("m")), 9).alias("bonferroni"), F.round(F.least(F.lit(1.0), F.col("_own"), F.coalesce("_after", F.lit(1.0))), 9).alias("bh"))


def confidence_interval(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean, lo, hi by the normal approximation."""
    x = df.groupBy(group).agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("e"))
    return x.select(group, F.round("m", 6).alias("mean"), F.round(F.col("m") - Z95 * F.col("e"), 6).alias("lo"), F.round(F.col("m") + Z95 * F.col("e"), 6).alias("hi"))


def outliers(df: DataFrame, ident: str, metric: str, n: int = 5) -> DataFrame:
    """ident, metric, side: the n least and n greatest."""
    low = df.select(ident, metric).filter(F.col(metric).isNotNull()).orderBy(metric, ident).limit(n).withColumn("side", F.lit("bottom"))
    return low.unionByName(df.select(ident, metric).orderBy(F.desc(metric), ident).limit(n).withColumn("side", F.lit("top")))


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, median, n of the values that are there, exactly: rows are ranked in ranges, so no task holds a whole group."""
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    ranked = stored(global_rank(rows, [*(F.col(g) for g in group), F.col("_v")], "_r"), "ranked")
    first = ranked.groupBy(*group).agg(F.min("_r").alias("_first"), F.count("*").alias("n"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    first = first.select(*(F.col(g).alias(f"_{g}") for g in group), "_first", "n")
    place = F.col("_r") - F.col("_first") + 1
    mid = ranked.join(F.broadcast(first) if not group else first, on).filter((place >= F.col("n") / 2) & (place <= F.col("n") / 2 + 1))
    return mid.groupBy(*group).agg(F.avg("_v").alias("median"), F.max("n").alias("n"))


def near_median(df: DataFrame, ident: str, metric: str, n: int = 5) -> DataFrame:
    """ident, metric, distance of the n members nearest to the median."""
    m = medians(df, [], metric).select(F.col("median").alias("_m"))
    return df.crossJoin(F.broadcast(m)).select(ident, metric, F.round(F.abs(F.col(metric) - F.col("_m")), 6).alias("distance")).orderBy("distance", ident).limit(n)


def means_in_order(df: DataFrame, group: str, means: dict[str, str], order: tuple[str, ...]) -> DataFrame:
    """group, n (rows) and the means named in means(name: column), added up row by row in order: floats give another last digit in
    another order, and a mean that is compared with a bound shows it. Sums run along a sorted window, so no group is held."""
    w = W.partitionBy(group).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.select(group, F.row_number().over(w).alias("_k"), *(F.avg(c).over(upto).alias(m) for m, c in means.items()))
    last = rows.groupBy(group).agg(F.max_by(F.struct(F.col("_k").cast("long").alias("n"), *means), "_k").alias("_m"))
    return last.select(group, "_m.*")


def beyond_sd(df: DataFrame, ident: str, metric: str, k: float = 3.0) -> DataFrame:
    """ident, metric, z of members more than k standard deviations from the mean."""
    m = df.agg(F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s"))
    z = (F.col(metric) - F.col("_m")) / F.col("_s")
    return df.crossJoin(F.broadcast(m)).withColumn("z", z).filter(F.abs("z") > k).select(ident, metric, F.round("z", 6).alias("z"))


def group_spotcheck(df: DataFrame, group: str, ident: str, value: str) -> DataFrame:
    """Of each group the greatest member, the median one (the lower of two), and the group's mean without the greatest."""
    x = df.groupBy(group).agg(F.max_by(ident, F.struct(F.col(value), -F.col(ident))).alias("extreme"), F.max(value).alias("v"), F.sum(value).alias("s"), F.count(value).alias("n"))
    ranked = stored(global_rank(df.filter(F.col(value).isNotNull()).select(group, value, ident), [F.col(group), F.col(value), F.col(ident)], "_r"), "ranked")
    first = ranked.groupBy(group).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    mid = ranked.join(first, group).filter(F.col("_r") - F.col("_first") + 1 == F.ceil(F.col("_n") / 2)).select(group, F.col(ident).alias("median"))
    return x.join(mid, group).select(group, "extreme", "median", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.when(F.col("n") > 1, (F.col("s") - F.col("v")) / (F.col("n") - 1)), 6).alias("mean_without"))


def association(df: DataFrame, label: Column, outcome: Column, value: str) -> DataFrame:
    """odds_ratio, risk_ratio and phi of outcome by label, and r between label and value."""
    yes, no = label.cast("int"), (~label).cast("int")
    x = df.agg(*(F.sum(p * q).cast("double").alias(k) for k, p, q in (("a", yes, outcome.cast("int")), ("b", yes, (~outcome).cast("int")), ("c", no, outcome.cast("int")), ("d", no, (~outcome).cast("int")))), F.corr(yes.cast("double"), F.col(value)).alias("r"))
    a, b, c, d = (F.col(k) for k in "abcd")
    phi = (a * d - b * c) / F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return x.select(F.round(F.try_divide(a * d, b * c), 6).alias("odds_ratio"), F.round(F.try_divide(a / (a + b), c / (c + d)), 6).alias("risk_ratio"), F.round(phi, 6).alias("phi"), F.round("r", 6).alias("r"))


def significance_counts(adjusted: DataFrame) -> DataFrame:
    """n tests of adjust_pvalues(), and how many are below 0.05 and 0.01, as they are, by Bonferroni and by Benjamini-Hochberg."""
    return adjusted.agg(F.count("*").alias("n"), *(F.count_if(F.col(c) < t).alias(f"{c}_{k}") for c in ("p", "bonferroni", "bh") for k, t in (("05", 0.05), ("01", 0.01))))


def proportion_interval(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """group, n, share, lo, hi by the normal approximation, within 0 and 1."""
    x = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("p"))
    e = Z95 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return x.select(group, "n", F.round("p", 6).alias("share"), F.round(F.greatest(F.lit(0.0), F.col("p") - e), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.col("p") + e), 6).alias("hi"))


def correlation_interval(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, n, r, lo, hi: by Fisher's transformation; null with fewer than four rows."""
    a = df.groupBy(group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    z, e = F.atanh("r"), F.when(F.col("n") > 3, Z95 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)).cast("double")))
    return a.select(group, "n", F.round("r", 6).alias("r"), F.round(F.tanh(z - e), 6).alias("lo"), F.round(F.tanh(z + e), 6).alias("hi"))


def negative_controls(df: DataFrame, control: str, value: str, baseline: float, tolerance: float) -> DataFrame:
    """control, n, mean, near: whether negative controls lie within tolerance of the baseline."""
    x = df.groupBy(control).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return x.select(control, "n", F.round("m", 6).alias("mean"), (F.abs(F.col("m") - baseline) <= tolerance).alias("near"))


def variance_ratio(df: DataFrame, group: str, value: str, most: float = 4.0) -> DataFrame:
    """ratio of the greatest to the least variance of groups of two rows and more, and unequal (above most)."""
    v = df.groupBy(group).agg(F.var_samp(value).alias("v")).filter(F.col("v").isNotNull())
    x = v.agg((F.max("v") / F.min("v")).alias("x"))
    return x.select(F.round("x", 6).alias("ratio"), (F.col("x") > most).alias("unequal"))


def stratified_effect(df: DataFrame, strata: list[str], label: Column, value: str) -> DataFrame:
    """n_strata, crude and stratified effect: the label's mean difference over all rows, and within strata, weighted by their rows; strata without both sides are left out."""
    part = lambda c: (F.avg(F.when(c, F.col(value))), F.count_if(c))
    (a, n), (b, m) = part(label), part(~label)
    x = df.groupBy(*strata).agg((a - b).alias("e"), (n + m).alias("n"), n.alias("_a"), m.alias("_b")).filter("_a > 0 and _b > 0").agg(F.count("*").alias("n_strata"), (F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("w"))
    return x.crossJoin(df.agg((a - b).alias("c"))).select("n_strata", F.round("c", 6).alias("crude"), F.round("w", 6).alias("stratified"))


def fold_scores(df: DataFrame, fold: Column, truth: str, guess: str) -> DataFrame:
    """n_folds, mean and sd of the folds' mean absolute errors."""
    x = df.groupBy(fold.alias("_f")).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("e"))
    return x.agg(F.count("*").alias("n_folds"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.stddev_samp("e"), 6).alias("sd"))


def calibration_bins(df: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """bin (0 to bins - 1, the last with 1), n, predicted and observed share."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("predicted"), F.round(F.avg(F.col(outcome).cast("double")), 6).alias("observed"))


def characterize_failures(df: DataFrame, failed: Column, numeric: list[str], category: str) -> DataFrame:
    """feature, level, failing, passing: means of numeric features, and shares of the category's levels, in each class."""
    f = df.withColumn("_f", F.coalesce(failed, F.lit(False)))
    nums = f.agg(*(x for c in numeric for x in (F.avg(F.when(F.col("_f"), F.col(c))).alias(f"a_{c}"), F.avg(F.when(~F.col("_f"), F.col(c))).alias(f"b_{c}"))))
    rows = nums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("level"), F.round(f"a_{c}", 6).alias("failing"), F.round(f"b_{c}", 6).alias("passing")) for c in numeric))).alias("r")).select("r.*")
    total = f.agg(F.count_if("_f").alias("_nf"), F.count_if(~F.col("_f")).alias("_np"))
    cats = f.groupBy(category).agg(F.count_if("_f").alias("_a"), F.count_if(~F.col("_f")).alias("_b")).crossJoin(F.broadcast(total))
    return rows.unionByName(cats.select(F.lit(category).alias("feature"), F.col(category).cast("string").alias("level"), F.round(F.col("_a") / F.col("_nf"), 6).alias("failing"), F.round(F.col("_b") / F.col("_np"), 6).alias("passing")))


def failure_impact(df: DataFrame, failed: Column, value: str, group: str) -> DataFrame:
    """group, rate, with_failures, without: how much failures move each group's mean."""
    x = df.groupBy(group).agg(F.avg(failed.cast("double")).alias("r"), F.avg(value).alias("w"), F.avg(F.when(~failed, F.col(value))).alias("o"))
    return x.select(group, F.round("r", 6).alias("rate"), F.round("w", 6).alias("with_failures"), F.round("o", 6).alias("without"))


def breaking_subset(df: DataFrame, covariates: list[str], value: str, label: Column) -> DataFrame:
    """covariate, level, effect, verdict (holds, reverses, vanishes below a tenth of the whole): all covariates in one job of grouping sets."""
    a, b = F.avg(F.when(label, F.col(value))), F.avg(F.when(~label, F.col(value)))
    whole = df.agg((a - b).alias("_main"))
    sets = df.groupingSets([[F.col(c)] for c in covariates], *(F.col(c) for c in covariates)).agg(F.grouping_id().alias("_g"), (a - b).alias("_e"))
    width = len(covariates)
    name = F
    level = F
    for k, c in enumerate(covariates):
        only = (1 << width) - 1 - (1 << (width - 1 - k))
        name, level = name.when(F.col("_g") == only, c), level.when(F.col("_g") == only, F.col(c).cast("string"))
    out = sets.select(name.alias("covariate"), level.alias("level"), "_e").crossJoin(F.broadcast(whole)).filter("_e is not null")
    verdict = F.when(F.abs("_e") < 0.1 * F.abs("_main"), "vanishes").when(F.signum("_e") * F.signum("_main") < 0, "reverses").otherwise("holds")
    return out.select("covariate", "level", F.round("_e", 6).alias("effect"), verdict.alias("verdict"))


def direction_check(df: DataFrame, key: str, value: str, label: Column, reported: DataFrame) -> DataFrame:
    """key, direct (log2 ratio of means), reported, agrees in sign."""
    x = df.groupBy(key).agg(F.log2(F.avg(F.when(label, F.col(value))) / F.avg(F.when(~label, F.col(value)))).alias("d"))
    return x.join(reported.select(key, F.col("effect").alias("_r")), key).select(key, F.round("d", 6).alias("direct"), F.col("_r").alias("reported"), (F.signum("d") == F.signum("_r")).alias("agrees"))


def control_check(df: DataFrame, control: str, value: str, max_cv: float = 0.05) -> DataFrame:
    x = df.groupBy(control).agg((F.stddev_samp(value) / F.avg(value)).alias("c"), F.count("*").alias("n"))
    return x.select(control, "n", F.round("c", 6).alias("cv"), (F.col("c") < max_cv).alias("steady"))


def assumption_diagnostics(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """group, skewness, excess_kurtosis, lag1 (correlation with the row before)."""
    x = df.withColumn("_lag", F.lag(value).over(W.partitionBy(group).orderBy(*order)))
    return x.groupBy(group).agg(F.round(F.skewness(value), 5).alias("skewness"), F.round(F.kurtosis(value), 5).alias("excess_kurtosis"), F.round(F.corr(value, "_lag"), 5).alias("lag1"))


def pseudoreplication_check(df: DataFrame, unit: str, value: str, label: Column) -> DataFrame:
    """rows_per_unit, effect_rows, effect_units: the effect over rows, and over the units' means."""
    units = df.groupBy(unit, label.alias("_l")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("n"))
    w = lambda c: F.sum(F.when(c, F.col("s"))) / F.sum(F.when(c, F.col("n")))
    m = lambda c: F.avg(F.when(c, F.col("m")))
    yes, no = F.col("_l"), ~F.col("_l")
    return units.agg(F.round(F.sum("n") / F.count("*"), 6).alias("rows_per_unit"), F.round(w(yes) - w(no), 6).alias("effect_rows"), F.round(m(yes) - m(no), 6).alias("effect_units"))


def baseline_model_check(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """group, mae_mean, mae_previous: errors of the group's mean, and of the value before, as predictions."""
    m = df.groupBy(group).agg(F.avg(value).alias("_m"))
    x = df.withColumn("_p", F.lag(value).over(W.partitionBy(group).orderBy(*order))).join(m, group)
    return x.groupBy(group).agg(F.round(F.avg(F.abs(F.col(value) - F.col("_m"))), 6).alias("mae_mean"), F.round(F.avg(F.abs(F.col(value) - F.col("_p"))), 6).alias("mae_previous"))
