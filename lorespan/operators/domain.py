"""Long-format measurements, counts, objects and intervals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.operators.stats import PRIME, coefficients, medians
from lorespan.sources.folders import stored, tables


def low_count_filter(counts: DataFrame, gene: str, n: str, least: float = 10) -> DataFrame:
    """counts without the genes whose total is below least."""
    keep = counts.groupBy(gene).agg(F.sum(n).alias("_t")).filter(F.col("_t") >= least).select(gene)
    return counts.join(keep, gene, "left_semi")


def cell_qc(counts: DataFrame, cell: str, gene: str, n: str, mito: Column, low: int, high: int, max_mito: float) -> DataFrame:
    """cell, n_features, mito_share, reason (null: kept): too few or many features, too much mitochondrial."""
    x = counts.filter(F.col(n) > 0).groupBy(cell).agg(F.countDistinct(gene).alias("n_features"), (F.sum(F.when(mito, F.col(n)).otherwise(0)) / F.sum(n)).alias("m"))
    reason = F.when(F.col("n_features") < low, "few_features").when(F.col("n_features") > high, "many_features").when(F.col("m") > max_mito, "mitochondrial")
    return x.select(cell, "n_features", F.round("m", 6).alias("mito_share"), reason.alias("reason"))


def gene_qc(counts: DataFrame, cell: str, gene: str, n: str, least_cells: int) -> DataFrame:
    """gene, n_cells (that have it), reason (null: kept): genes of too few cells."""
    x = counts.groupBy(gene).agg(F.countDistinct(F.when(F.col(n) > 0, F.col(cell))).alias("n_cells"))
    return x.withColumn("reason", F.when(F.col("n_cells") < least_cells, "few_cells"))


def pseudobulk(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum(n).alias("total"))


def volcano_labels(df: DataFrame, gene: str, fc: str, p: str, n: int = 10, min_fc: float = 1.0, max_p: float = 0.05) -> DataFrame:
    """class, k, gene: the n surest of those up and of those down, by p, then by the size of the change, then by name."""
    sure = volcano_classes(df, fc, p, min_fc, max_p).filter(F.col("class") != "none")
    place = F.row_number().over(W.partitionBy("class").orderBy(F.col(p), F.desc(F.abs(fc)), F.col(gene)))
    return sure.withColumn("k", place).filter(F.col("k") <= n).select("class", "k", gene)


def volcano_classes(df: DataFrame, fc: str, p: str, min_fc: float = 1.0, max_p: float = 0.05) -> DataFrame:
    """df with class: up, down or none."""
    sure = F.col(p) < max_p
    return df.withColumn("class", F.when(sure & (F.col(fc) >= min_fc), "up").when(sure & (F.col(fc) <= -min_fc), "down").otherwise("none"))


def rank_sum_markers(df: DataFrame, gene: str, value: str, label: Column) -> DataFrame:
    """gene, n1, n2, u, z: Wilcoxon's rank sum with average ranks for ties, normal approximation with tie correction; log2_fc of the means (1 added to both), and the shares pct1 and pct2 above 0.

    Values are counted first, so a gene's window holds its distinct values, not its rows.
    """
    levels = df.groupBy(gene, value).agg(F.count_if(label).alias("a"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(gene).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranked = levels.withColumn("rank", F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2)
    x = ranked.groupBy(gene).agg(F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("t"), *(x for k, w in ((1, F.col("a")), (2, F.col("n") - F.col("a"))) for x in ((F.sum(F.col(value) * w) / F.sum(w)).alias(f"m{k}"), (F.sum(F.when(F.col(value) > 0, w).otherwise(0)) / F.sum(w)).alias(f"p{k}"))))
    n, u = F.col("n1") + F.col("n2"), F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("t") / (n * (n - 1)))
    return x.select(gene, "n1", "n2", F.round(u, 6).alias("u"), F.round(F.when(var > 0, (u - F.col("n1") * F.col("n2") / 2) / F.sqrt(var)), 6).alias("z"), F.round(F.log2((F.col("m1") + 1) / (F.col("m2") + 1)), 6).alias("log2_fc"), F.round("p1", 6).alias("pct1"), F.round("p2", 6).alias("pct2"))


def over_representation(sets: DataFrame, hits: DataFrame, background: DataFrame, gene: str) -> DataFrame:
    """set, k (hits in it), m (its size in the background), fold enrichment and hypergeometric p of at least k hits.

    The tail is summed from logarithms of factorials, kept as a table of prefix sums no longer than the background.
    """
    back = background.select(gene).distinct()
    own = hits.select(gene).distinct().join(back, gene, "left_semi")
    mine = sets.select("set", gene).distinct().join(back, gene, "left_semi")
    counts = mine.join(own.withColumn("_h", F.lit(1)), gene, "left").groupBy("set").agg(F.count("_h").alias("k"), F.count("*").alias("m"))
    totals = back.agg(F.count("*").alias("n_all")).crossJoin(own.agg(F.count("*").alias("n")))
    x = counts.crossJoin(F.broadcast(totals))
    ln = lambda c: _log_factorial(c)
    choose = lambda a, b: ln(a) - ln(b) - ln(a - b)
    terms = x.withColumn("i", F.explode(F.sequence(F.col("k"), F.greatest("k", F.least("m", "n")))))
    lp = choose(F.col("m"), F.col("i")) + choose(F.col("n_all") - F.col("m"), F.col("n") - F.col("i")) - choose(F.col("n_all"), F.col("n"))
    ok = (F.col("n") - F.col("i") <= F.col("n_all") - F.col("m")) & (F.col("i") <= F.col("n"))
    p = terms.groupBy("set", "k", "m", "n", "n_all").agg(F.sum(F.when(ok, F.exp(lp)).otherwise(0.0)).alias("p"))
    return p.select("set", "k", "m", F.round((F.col("k") / F.col("n")) / (F.col("m") / F.col("n_all")), 6).alias("fold"), F.round(F.least(F.lit(1.0), "p"), 6).alias("p"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, exact to 1e-10 from 10 on; below that by the product."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 15, F.log(F.factorial(F.greatest(F.lit(0), n.cast("int"))).cast("double"))).otherwise(series)


def running_enrichment(ranked: DataFrame, sets: DataFrame, gene: str) -> DataFrame:
    """set, score (the running sum's greatest excursion), at (its rank) of sets(set, gene) along ranked(rank, gene)."""
    n_all = ranked.agg(F.count("*").alias("n_all"))
    return _excursions(sets.join(ranked.select(gene, "rank"), gene).crossJoin(F.broadcast(n_all)), ["set"])  # one row


def _excursions(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, score, at of the members' rows(by, rank, n_all). Only their ranks matter: the sum falls evenly between them, so extremes are at members or just before them."""
    sized = rows.groupBy(*by).agg(F.count("*").alias("m"))
    rows = rows.join(sized, by).withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("rank")))
    after = F.col("i") / F.col("m") - (F.col("rank") - F.col("i")) / (F.col("n_all") - F.col("m"))
    before = (F.col("i") - 1) / F.col("m") - (F.col("rank") - F.col("i")) / (F.col("n_all") - F.col("m"))
    points = rows.select(*by, F.explode(F.array(F.struct(after.alias("s"), F.col("rank").alias("at")), F.struct(before.alias("s"), (F.col("rank") - 1).alias("at")))).alias("p"))
    best = points.groupBy(*by).agg(F.max_by("p", F.struct(F.round(F.abs("p.s"), 9), -F.col("p.at"))).alias("p"))
    return best.select(*by, F.round("p.s", 6).alias("score"), F.col("p.at").alias("at"))


def leading_edge(ranked: DataFrame, sets: DataFrame, gene: str, scores: DataFrame) -> DataFrame:
    """set, gene, rank of the members up to where running_enrichment() has its excursion, or after it where the score is below 0."""
    rows = sets.join(ranked.select(gene, "rank"), gene).join(scores.select("set", "score", "at"), "set")
    return rows.filter(F.when(F.col("score") >= 0, F.col("rank") <= F.col("at")).otherwise(F.col("rank") > F.col("at"))).select("set", gene, "rank")


#: Rounds in which an order's bijection swaps places.
ROUNDS = 32


def order_keys(replica: int) -> list[int]:
    """Four numbers below PRIME for each round of an order, from MD5."""
    return [x for r in range(ROUNDS) for x in coefficients("order", replica * ROUNDS + r)]


def shuffled(places: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Where an order of n things puts those at places: a bijection on 0 ... n - 1 that needs no other thing's place.

    In each round, a place and its partner (a key less it, modulo n) swap or not, by a bit of the hash of the greater of
    the two.
    """
    out = np.empty(len(places), np.int64)
    rounds = [(k % n, a, b, c) for k, a, b, c in np.array(keys, np.int64).reshape(-1, 4).tolist()]
    fold = lambda v: (v & PRIME) + (v >> 31)  # noqa: E731  # the same modulo PRIME, without division
    for at in range(0, len(places), 16_384):
        x = places[at : at + 16_384].astype(np.int64)
        for k, a, b, c in rounds:
            y = k - x
            y += n * (y < 0)
            g = np.maximum(x, y)
            h = fold(fold(fold(fold(a * g + b)) * g + c))
            x = np.where((h & 1).astype(bool) & (h != PRIME), y, x)
        out[at : at + 16_384] = x
    return out


#: Orders of one set that a task takes, and members up to which it holds the set's ranks (8 bytes each); larger sets go through a sorted window.
ORDERS_AT_ONCE, SET_ROWS = 50, 4_000_000


def _farthest(ranks: np.ndarray, n_all: int) -> float:
    """The running sum's greatest excursion along ranks in order, as in _excursions()."""
    m, i = len(ranks), np.arange(1, len(ranks) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        down = (ranks - i) / (n_all - m)
        s = np.stack([(i - 1) / m - down, i / m - down], axis=1).ravel()  # by place: just before a member, then at it
    r = np.round(np.abs(s), 9)
    return float(s[int(r.argmax())])


def enrichment_pvalues(ranked: DataFrame, sets: DataFrame, gene: str, scores: DataFrame, n: int = 1_000) -> DataFrame:
    """set, score, p: the share of n orders of the genes in which the set's score is at least as far from 0.

    An order is a keyed bijection on ranks, so the members' ranks in it follow from their own alone, and no gene outside the
    sets is moved or sorted. A task takes a set's ranks for ORDERS_AT_ONCE orders and gives a number for each; only for sets
    of more than SET_ROWS members are there rows of members times orders.
    """
    total = ranked.count()
    members = sets.join(ranked.select(gene, "rank"), gene).select("set", "rank")
    kind = members.schema["set"].dataType.simpleString()
    with tables(ranked.sparkSession) as scope:
        members = stored(members, "members")
        sizes = stored(members.groupBy("set").agg((F.count("*") > SET_ROWS).alias("large")), "set-sizes")
        rows = members.join(sizes, "set")

        def orders(key, table):
            at, low = table.column("rank").to_numpy().astype(np.int64) - 1, key[1].as_py() * ORDERS_AT_ONCE
            far = [_farthest(np.sort(shuffled(at, total, order_keys(rep))) + 1, total) for rep in range(low, min(n, low + ORDERS_AT_ONCE))]
            return pa.table({"set": pa.array([key[0].as_py()] * len(far), table.schema.field("set").type), "s": pa.array(far, pa.float64())})

        chunks = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // ORDERS_AT_ONCE))).alias("chunk")
        held = rows.filter("not large").select("set", chunks, "rank").repartition(max(len(range(0, n, ORDERS_AT_ONCE)), _tasks(ranked)), "set", "chunk")
        null = held.groupBy("set", "chunk").applyInArrow(orders, f"`set` {kind}, s double").select("set", F.round("s", 6).alias("_n"))

        def mix(batches):
            for batch in batches:
                at = batch.column("rank").to_numpy().astype(np.int64) - 1
                for rep in range(n if len(at) else 0):
                    yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(np.full(len(at), rep, np.int32)), pa.array(shuffled(at, total, order_keys(rep)) + 1)], names=["set", "rep", "rank"])

        if sizes.filter("large").limit(1).count():
            mixed = rows.filter("large").select("set", "rank").mapInArrow(mix, f"`set` {kind}, rep int, rank long").withColumn("n_all", F.lit(total))
            null = null.unionByName(_excursions(mixed, ["set", "rep"]).select("set", F.col("score").alias("_n")))
        x = scores.select("set", "score").join(null, "set")
        return scope.keep(x.groupBy("set", "score").agg(F.round(F.avg((F.abs("_n") >= F.abs("score")).cast("double")), 6).alias("p")), "pvalues")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is long for its bytes, so that it is not coalesced."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sample_qc_summary(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """sample, metric, passed of metrics(sample, metric, value) against thresholds(metric, low, high)."""
    return metrics.join(F.broadcast(thresholds), "metric").select("sample", "metric", ((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).alias("passed"))


def match_objects(pixels: DataFrame, least: float = 0.5) -> DataFrame:
    """image, n_true, n_pred, matched, f1, mean_iou of pixels(image, t, p): labels of truth and prediction, 0 for none."""
    over = pixels.groupBy("image", "t", "p").agg(F.count("*").alias("o"))
    ta = over.filter("t <> 0").groupBy("image", "t").agg(F.sum("o").alias("ta"))
    pa = over.filter("p <> 0").groupBy("image", "p").agg(F.sum("o").alias("pa"))
    iou = over.filter("t <> 0 and p <> 0").join(ta, ["image", "t"]).join(pa, ["image", "p"]).withColumn("iou", F.col("o") / (F.col("ta") + F.col("pa") - F.col("o"))).filter(F.col("iou") > least)
    n = ta.groupBy("image").agg(F.count("*").alias("n_true")).join(pa.groupBy("image").agg(F.count("*").alias("n_pred")), "image", "full").fillna(0)
    m = iou.groupBy("image").agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("mean_iou"))
    return n.join(m, "image", "left").fillna(0, ["matched"]).select("image", "n_true", "n_pred", "matched", F.round(2 * F.col("matched") / (F.col("n_true") + F.col("n_pred")), 6).alias("f1"), "mean_iou")


def segmentation_errors(pixels: DataFrame, least: float = 0.5) -> DataFrame:
    """image, split, merged, false_positives, missed of pixels(image, t, p), 0 for none.

    split: true objects in which several predicted ones lie with over `least` of their own area; merged: predicted ones in
    which several true ones do; false positives and missed: objects that overlap none of the other side.
    """
    over = pixels.groupBy("image", "t", "p").agg(F.count("*").alias("o"))
    area = lambda c: over.filter(f"{c} <> 0").groupBy("image", c).agg(F.sum("o").alias(f"{c}a"))
    met = over.filter("t <> 0 and p <> 0").join(area("t"), ["image", "t"]).join(area("p"), ["image", "p"])
    several = lambda c, part: met.filter(part > least).groupBy("image", c).agg(F.count("*").alias("k")).filter("k > 1").groupBy("image").agg(F.count("*").alias("k"))
    alone = lambda c: area(c).join(met.select("image", c), ["image", c], "left_anti").groupBy("image").agg(F.count("*").alias("k"))
    out = pixels.select("image").distinct()
    for name, df in (("split", several("t", F.col("o") / F.col("pa"))), ("merged", several("p", F.col("o") / F.col("ta"))), ("false_positives", alone("p")), ("missed", alone("t"))):
        out = out.join(df.withColumnRenamed("k", name), "image", "left")
    return out.fillna(0)


#: Levels of the quadtree: as many as a double can tell apart, with some to spare.
DEEPEST = 48


def nearest_neighbor(points: DataFrame, image: str, ident: str, x: str, y: str, leaf: int = 32) -> DataFrame:
    """image, id, neighbor, distance of each point with another in its image (ties: the smallest id), exactly.

    Points at one place are each other's neighbours. The places of an image form a quadtree: a square of more than leaf
    places is split, so a crowded one doesn't meet itself whole. All points go down it together, level by level: each
    keeps the squares that are no farther from it than the nearest place that it knows of, or than the far corner of a
    square that holds one.

    Points without id, or with a coordinate that is null, NaN or infinite, have no row and are nobody's neighbour; of rows
    that repeat an id in an image, the one with the least place stands.
    """
    with tables(points.sparkSession) as scope:
        given = points.select(F.col(image).alias("_i"), F.col(ident).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        given = given.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("_x", "_y"))).filter("_i is not null and _id is not null")
        given = stored(given.groupBy("_i", "_id").agg(F.min(F.struct("_x", "_y")).alias("p")).select("_i", "_id", "p._x", "p._y"), "points")
        two = given.withColumn("k", F.row_number().over(W.partitionBy("_i", "_x", "_y").orderBy("_id"))).filter("k <= 2")
        places = stored(two.groupBy("_i", "_x", "_y").agg(F.min("_id").alias("_id"), F.max("_id").alias("second"), F.count("*").alias("k")), "places")
        shared = places.filter("k = 2").select("_i", "_x", "_y", F.col("_id").alias("first"), "second")
        none = F.lit(0.0).alias("d")
        found = [given.join(shared, ["_i", "_x", "_y"]).select("_i", "_id", F.struct(none, F.when(F.col("_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("o")).alias("m"))]
        box = places.groupBy("_i").agg(F.min("_x").alias("x0"), F.min("_y").alias("y0"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("side"), F.count("*").alias("n")).filter("n > 1").drop("n")
        at = places.join(box, "_i").select("_i", "_id", "_x", "_y", "k", "side", ((F.col("_x") - F.col("x0")) / F.col("side")).alias("u"), ((F.col("_y") - F.col("y0")) / F.col("side")).alias("v"))
        at = stored(at, "placed")
        levels = _quadtree(at.drop("k", "side"), leaf)
        front = at.filter("k = 1").drop("k").withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "r": F.lit(float("inf"))})
        for depth, (squares, held) in enumerate(levels):
            here = front.join(squares.select("_i", "a", "b", "leaf"), ["_i", "a", "b"])
            d = F.sqrt((F.col("_x") - F.col("_ox")) ** 2 + (F.col("_y") - F.col("_oy")) ** 2)
            met = here.filter("leaf").join(held, ["_i", "a", "b"]).filter("_id <> _o").select("_i", "_id", "side", F.struct(d.alias("d"), F.col("_o").alias("o")).alias("m"))
            met = stored(met.groupBy("_i", "_id").agg(F.min("m").alias("m"), F.first("side").alias("side")), "nearest")
            found.append(met.select("_i", "_id", "m"))
            if depth + 1 < len(levels):
                front = stored(_down(here.filter(~F.col("leaf")).drop("leaf"), levels[depth + 1][0], met, depth + 1), "front")
        best = reduce(DataFrame.unionByName, found).groupBy("_i", "_id").agg(F.min("m").alias("m"))
        return scope.keep(best.select(F.col("_i").alias(image), F.col("_id").alias(ident), F.col("m.o").alias("neighbor"), F.round("m.d", 6).alias("distance")), "neighbors")


def _quadtree(places: DataFrame, leaf: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level: its squares (_i, a, b, n, one of its ids, leaf), and the places of those that aren't split. places(_i, _id, _x, _y, u, v) has u and v from 0 to 1."""
    levels, left = [], places
    for depth in range(DEEPEST + 1):
        cell = lambda c, n=2**depth: F.least(F.floor(F.col(c) * n), F.lit(n - 1)).cast("long")
        inside = left.withColumns({"a": cell("u"), "b": cell("v")})
        squares = stored(inside.groupBy("_i", "a", "b").agg(F.count("*").alias("n"), F.min("_id").alias("one")).withColumn("leaf", (F.col("n") <= leaf) | F.lit(depth == DEEPEST)), "squares")
        known = inside.join(squares.select("_i", "a", "b", "leaf"), ["_i", "a", "b"])
        levels.append((squares, stored(known.filter("leaf").select("_i", "a", "b", F.col("_id").alias("_o"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy")), "held")))
        left = stored(known.filter(~F.col("leaf")).select(*places.columns), "crowded")
        if not left.limit(1).count():
            break
    return levels


def _down(front: DataFrame, squares: DataFrame, met: DataFrame, depth: int) -> DataFrame:
    """front one level down: of the quarters of its squares, those that may hold a nearer place than any that is known of."""
    below = squares.select("_i", F.floor(F.col("a") / 2).alias("pa"), F.floor(F.col("b") / 2).alias("pb"), "a", "b", "n", "one")
    rows = front.withColumnsRenamed({"a": "pa", "b": "pb"}).join(below, ["_i", "pa", "pb"]).filter("n > 1 or one <> _id")
    width = 2.0**-depth
    gap = lambda p, c: F.greatest(F.col(c) * width - F.col(p), F.col(p) - (F.col(c) + 1) * width, F.lit(0.0))
    far = lambda p, c: F.greatest(F.abs(F.col(p) - F.col(c) * width), F.abs(F.col(p) - (F.col(c) + 1) * width))
    known = rows.join(met.select("_i", "_id", (F.col("m.d") / F.col("side")).alias("seen")), ["_i", "_id"], "left")
    corner = F.sqrt(far("u", "a") ** 2 + far("v", "b") ** 2)
    reach = F.least("r", F.coalesce("seen", "r"), F.min(corner).over(W.partitionBy("_i", "_id")))
    kept = known.withColumn("r", reach).filter(F.sqrt(gap("u", "a") ** 2 + gap("v", "b") ** 2) <= F.col("r") + 1e-9)  # the slack is for rounding at the squares' edges
    return kept.select(*front.columns)


def focus_flags(hist: DataFrame, least: float) -> DataFrame:
    """image, contrast (standard deviation of the levels), blurred (below least) of hist(image, level, n)."""
    n, m = F.sum("n"), F.sum(F.col("level") * F.col("n"))
    x = hist.groupBy("image").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("level") * F.col("level") * F.col("n")) / n - (m / n) * (m / n))).alias("c"))
    return x.select("image", F.round("c", 6).alias("contrast"), (F.col("c") < least).alias("blurred"))


def normalize_to_control(df: DataFrame, plate: str, value: str, control: Column) -> DataFrame:
    """df with normalized: the value over its plate's control median."""
    m = medians(df.filter(control), [plate], value).select(plate, F.col("median").alias("_m"))
    return df.join(m, plate, "left").withColumn("normalized", F.round(F.col(value) / F.col("_m"), 6)).drop("_m")


def plate_effects(df: DataFrame, plate: str, edge: Column, value: str, column: str) -> DataFrame:
    """plate, edge_diff (mean of edge wells less the others), gradient (slope of the value along column)."""
    return df.groupBy(plate).agg(F.round(F.avg(F.when(edge, F.col(value))) - F.avg(F.when(~edge, F.col(value))), 6).alias("edge_diff"), F.round(F.regr_slope(value, column), 6).alias("gradient"))


def track_stats(df: DataFrame, track: str, frame: str) -> DataFrame:
    """track, length, gaps (frames missing between neighbours)."""
    x = df.withColumn("_g", F.col(frame) - F.lag(frame).over(W.partitionBy(track).orderBy(frame)) - 1)
    return x.groupBy(track).agg(F.count("*").alias("length"), F.coalesce(F.sum(F.greatest("_g", F.lit(0))), F.lit(0)).cast("long").alias("gaps"))


def saturation_flags(hist: DataFrame, most: int = 255, share: float = 0.001) -> DataFrame:
    """image, share at the greatest level, saturated of hist(image, level, n)."""
    x = hist.groupBy("image").agg((F.sum(F.when(F.col("level") >= most, F.col("n")).otherwise(0)) / F.sum("n")).alias("s"))
    return x.select("image", F.round("s", 6).alias("share"), (F.col("s") >= share).alias("saturated"))


def id_namespace_check(df: DataFrame, column: str) -> DataFrame:
    """prefixed, bare, mitochondrial_m, mitochondrial_mt, mixed: spellings of chromosome names."""
    x = F.lower(column)
    pre = x.startswith("chr")
    a = df.agg(F.count_if(pre).alias("prefixed"), F.count_if(~pre).alias("bare"), F.count_if(x.isin("chrm", "m")).alias("mitochondrial_m"), F.count_if(x.isin("chrmt", "mt")).alias("mitochondrial_mt"))
    return a.withColumn("mixed", ((F.col("prefixed") > 0) & (F.col("bare") > 0)) | ((F.col("mitochondrial_m") > 0) & (F.col("mitochondrial_mt") > 0)))


def aggregate_duplicates(df: DataFrame, ident: str, values: list[str]) -> DataFrame:
    """One row for each id, values summed, and how many rows it had."""
    return df.groupBy(ident).agg(*(F.round(F.sum(v), 6).alias(v) for v in values), F.count("*").alias("n_rows"))
