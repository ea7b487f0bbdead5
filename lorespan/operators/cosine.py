"""Pairs of weighted term vectors with a cosine above a bound: blocks of vectors that meet, and an inverted index with residual bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.operators.blocks import block_pairs, in_blocks, parts
from lorespan.sources.folders import stored, tables

#: Rows of a list that one task pairs, parts of a longer one at most, rows of a key from which on products are by blocks,
#: pairs weighed at once, terms of a block of whole vectors on average, and how many of the commonest order the vectors.
LIST_ROWS, LIST_PARTS, DENSE_ROWS, PAIRS_AT_ONCE, BLOCK_TERMS, COMMONEST = 2_000, 12, 128, 2_000_000, 1_200_000, 3
#: Slack for sums in another order.
EPS = 1e-9


def unit_vectors(weights: DataFrame) -> DataFrame:
    """id, h (the term's 64-bit hash), df, u (weight by the vector's length), after (the length of what follows in the order from rare to common) of weights(id, term, df, weight)."""
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy("id")))
    unit = weights.select("id", F.xxhash64("term").alias("h"), "df", (F.col("weight") / norm).alias("u"))
    rest = F.sum(F.col("u") ** 2).over(W.partitionBy("id").orderBy(F.desc("df"), F.desc("h")).rowsBetween(W.unboundedPreceding, -1))  # a running sum: linear in the terms
    return unit.withColumn("after", F.sqrt(F.coalesce(rest, F.lit(0.0))))


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tags two rows of padded tag hashes (0: none) share."""
    n = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):
        n += ((a[:, k, None] == b) & (a[:, k, None] != 0)).any(axis=1)
    return n


def _pairs_of(batches, need: float, low: float, high: float, twice: float, dense: int):
    """Candidates among rows that come sorted by key, then by reach from high to low: id pairs that may reach their bound at this term, were it their first in common.

    Before the first term in common nothing adds to the product, so it is at most u * u' + after * after', which the
    product of the reaches, the lengths of (u, after), bounds in turn: a row meets its key's rows down to the reach that
    it needs of them. A pair of enough likeness passes this at its first term, whatever it does at others.
    """

    def emit(rows: pd.DataFrame):
        key, num, u, after, side = (rows[c].to_numpy() for c in ("key", "num", "u", "after", "side"))
        tags = None
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.repeat(np.r_[begin[1:], len(key)], np.diff(np.r_[begin, len(key)]))
        reach, segment = np.sqrt(u**2 + after**2), 2.0 * np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(key)]))
        feasible = np.searchsorted(segment - reach, segment - need / reach + EPS, "right")
        ends = np.minimum(end, feasible)
        both_ = np.stack([u, after], axis=1)

        def by_blocks(first: int, last: int):
            """Pairs of one key's rows that pass, from products of blocks of them."""
            rows_, at_once = 512, []
            for s in range(first, last, rows_):
                e, stop = min(s + rows_, last), int(ends[s])  # later rows reach no further
                for c in range(s, stop, 4096):
                    i, j = np.nonzero(both_[s:e] @ both_[c : min(c + 4096, stop)].T >= need - EPS)
                    i, j = i + s, j + c
                    ok = (j > i) & (j < ends[i]) & (num[i] != num[j]) & ((side[i] != side[j]) | (side[i] == 2))
                    at_once.append((i[ok], j[ok]))
                    if sum(len(x) for x, _ in at_once) > PAIRS_AT_ONCE // 4:
                        yield tuple(np.concatenate(x) for x in zip(*at_once, strict=True))
                        at_once = []
            if at_once:
                yield tuple(np.concatenate(x) for x in zip(*at_once, strict=True))

        def weighed():
            """Places i < j of pairs that pass at a key."""
            long = np.diff(np.r_[begin, len(key)]) > dense
            for first, last in zip(begin[long], np.r_[begin[1:], len(key)][long], strict=True):
                yield from by_blocks(int(first), int(last))
            many = np.where(np.repeat(long, np.diff(np.r_[begin, len(key)])), 0, np.maximum(ends - np.arange(len(key)) - 1, 0))
            at = np.r_[0, np.cumsum(many)]
            s = 0
            while s < len(key):
                e = max(s + 1, int(np.searchsorted(at, at[s] + PAIRS_AT_ONCE, "right")) - 1)
                i = np.repeat(np.arange(s, e), many[s:e])
                j = i + 1 + np.arange(len(i)) - np.repeat(at[s:e] - at[s], many[s:e])
                ok = (u[i] * u[j] + after[i] * after[j] >= need - EPS) & (num[i] != num[j]) & ((side[i] != side[j]) | (side[i] == 2))
                yield i[ok], j[ok]
                s = e

        for i, j in weighed():
            if twice and len(i):
                if tags is None:
                    size = rows["tags"].map(len).to_numpy()
                    tags = np.zeros((len(rows), max(1, size.max())), np.int64)
                    for k, t in enumerate(rows["tags"]):
                        tags[k, : len(t)] = t
                both = np.concatenate([_overlap(tags[i[x : x + 200_000]], tags[j[x : x + 200_000]]) for x in range(0, len(i), 200_000)])
                all_ = size[i] + size[j] - both
                alike = np.where(all_ > 0, both / np.maximum(all_, 1), 0.0)
                ok = (u[i] * u[j] + after[i] * after[j] >= twice - alike - EPS) & (alike > low) & (alike <= high)
                i, j = i[ok], j[ok]
            if len(i):
                a, b = np.minimum(num[i], num[j]), np.maximum(num[i], num[j])
                if key[i[0]] != key[i[-1]]:  # within one key no pair comes twice, but for equal hashes, and those go later
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                    a, b = a[new], b[new]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch.to_pandas())
        last = held[-1]["key"].to_numpy()
        if len(last) and last[0] != last[-1]:  # the last key may go on in the next batch
            rows = pd.concat(held) if len(held) > 1 else held[0]
            cut = int(np.flatnonzero(rows["key"].to_numpy() != last[-1])[-1]) + 1
            yield from emit(rows.iloc[:cut].reset_index(drop=True))
            held = [rows.iloc[cut:]]
    rows = pd.concat(held) if held else pd.DataFrame()
    if len(rows):
        yield from emit(rows.reset_index(drop=True))


def candidates(postings: DataFrame, need: float, low: float = -1.0, high: float = 2.0, twice: float = 0.0) -> DataFrame:
    """a < b (numbers), distinct: of postings(key, num, u, after, tags), rows of one key that may reach a cosine of need.

    With twice, a pair's own bound is twice less the Jaccard of its tags, and only pairs with one in (low, high] count.
    Rows go sorted by key and reach through tasks that pair them; only pairs that pass leave a task. Lists of more than LIST_ROWS
    rows are dealt to parts, LIST_PARTS at most, and each two parts meet in a task: a row goes to no more tasks than that,
    and its task works by blocks.
    """
    reach = postings.filter(F.sqrt(F.col("u") ** 2 + F.col("after") ** 2) >= need - EPS)
    rows = stored(reach.select("key", "num", "u", "after", "tags"), "postings")
    long = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST_ROWS).select("key", F.least(F.ceil(F.col("n") / LIST_ROWS), F.lit(LIST_PARTS)).cast("int").alias("parts")), "long-lists")
    if long.limit(1).count():
        mine = F.pmod(F.xxhash64("num"), F.col("parts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
        dealt = rows.join(long, "key").withColumn("mine", mine).withColumn("t", F.explode(others))
        side = F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("mine") == F.col("t.i"), 0).otherwise(1)
        dealt = dealt.select(F.xxhash64("key", "t.i", "t.j").alias("key"), "num", "u", "after", "tags", side.alias("side"))
        rows = rows.join(long, "key", "left_anti").withColumn("side", F.lit(2)).unionByName(dealt)
    else:
        rows = rows.withColumn("side", F.lit(2))
    dense = DENSE_ROWS
    ordered = rows.repartition("key").sortWithinPartitions("key", F.desc(F.sqrt(F.col("u") ** 2 + F.col("after") ** 2)))
    return ordered.mapInArrow(lambda b: _pairs_of(b, need, low, high, twice, dense), "a long, b long").distinct()


def cosine_pairs(weights: DataFrame, at_least: float) -> DataFrame:
    """a < b and cosine of all pairs of weights(id, term, df, weight) with a cosine of at least at_least (above 0), exactly.

    Every two blocks of vectors meet in a task (blocks.block_pairs); vectors with the same commonest terms are in one block,
    so that most vectors of two blocks of other languages can't reach the bound. Candidates and pairs are neither shuffled nor stored, so
    asking twice finds the pairs twice. Terms are told apart by 64-bit hashes.
    """
    with tables(weights.sparkSession) as scope:
        held = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", F.xxhash64("term").alias("h"), "weight")), False).alias("v"))
        columns = (F.col(f"v.{c}").alias(x) for c, x in (("h", "h"), ("weight", "w")))
        vectors = stored(held.select("id", *columns).withColumn("order", F.slice("h", 1, COMMONEST)), "vectors")
        n, terms = vectors.agg(F.count("*"), F.sum(F.size("h").cast("long"))).first()
        many = parts(n, terms or 0, BLOCK_TERMS)
        ordered = vectors.repartitionByRange(many, "order", "id").withColumn("tags", F.array().cast("array<long>"))
        packed = scope.keep(in_blocks(ordered, "order", "id"), "cosine-vectors")
        return block_pairs(packed, at_least, tagged=False).select("a", "b", "cosine")
