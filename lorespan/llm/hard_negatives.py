"""Hard negatives by coordinate pruning: buckets of like length hold sorted coordinate lists; feasible ranges of the anchors' largest coordinates intersect to candidates, which are verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

#: Components are multiplied by it and floored; products are those of whole numbers. Larger ones than HELD are held at it, so that products stay exact.
SCALE, HELD = 256, 1 << 22
#: Bytes of a bucket's matrix, buckets that one task takes, anchors of a chunk, and anchors multiplied at once.
BUCKET, TOGETHER, CHUNK, AT_ONCE = 512 << 10, 8, 2_048, 256
#: Products that wait before the best of them are taken.
WAITING = 500_000
#: Coordinates of an anchor whose lists are searched.
FOCUS = 3


def _pack(batches):
    """Vectors as bytes of 32-bit numbers, with their squared length."""
    for batch in batches:
        vectors = [np.asarray(v, np.float64).clip(-HELD, HELD).astype("<i4") for v in batch.column("v").to_pylist()]
        square = [float((v.astype(np.float64) ** 2).sum()) for v in vectors]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(square, pa.float64())], names=["vec_id", "label", "v", "square"])


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (32-bit numbers, as bytes), square of rows(vec_id, embedding, label) that take part, one for each vec_id."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(float(HELD))), F.lit(-float(HELD))))).alias("v"))
    packed = scaled.mapInArrow(_pack, "vec_id long, label long, v binary, square double")
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "v", "square")).alias("x")).select("vec_id", "x.label", "x.v", "x.square")


def matrix(values: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors from bytes, as exact doubles; shorter ones end in zeros."""
    rows = [np.frombuffer(v, "<i4") for v in values]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _bucket(ids, labels, values) -> dict:
    """One bucket: rows by vec_id, and for each coordinate the rows' order by its value."""
    by_id = np.argsort(ids, kind="stable")
    m = matrix([values[k] for k in by_id])
    return {
        "width": m.shape[1], "longest": float(np.sqrt((m**2).sum(axis=1).max(initial=0))), "ids": ids[by_id].astype("<i8").tobytes(), "labels": labels[by_id].astype("<i8").tobytes(),
        "rows": m.astype("<i4").tobytes(), "lists": np.argsort(m, axis=0, kind="stable").T.astype("<u2").tobytes(),
    }


_BUCKETS = "part int, width int, longest double, ids binary, labels binary, rows binary, lists binary"


def _cut(batches):
    """Buckets of rows that come by descending length."""
    held: list[tuple] = []
    size = 0

    def out():
        ids, labels, values = zip(*held, strict=True)
        b = _bucket(np.array(ids, np.int64), np.array(labels, np.int64), values)
        return pa.RecordBatch.from_pylist([{"part": 0} | b], schema=pa.schema([("part", pa.int32()), ("width", pa.int32()), ("longest", pa.float64()), *((n, pa.binary()) for n in ("ids", "labels", "rows", "lists"))]))

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("vec_id", "label", "v")), strict=True):
            if held and (size + len(row[2]) > BUCKET or len(held) >= 1 << 15):
                yield out()
                held, size = [], 0
            held.append(row)
            size += len(row[2]) + 16
    if held:
        yield out()


def length_buckets(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Buckets of vectors of like length, and in how many groups they are searched; each group has buckets of all lengths."""
    size = vectors.agg(F.coalesce(F.sum(F.octet_length("v").cast("long") + 16), F.lit(0))).first()[0]
    ranges = max(1, -(-size // (BUCKET * TOGETHER)))
    ordered = vectors.repartitionByRange(ranges, F.desc("square"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("square"), "vec_id")
    buckets = stored(ordered.select("vec_id", "label", "v").mapInArrow(_cut, _BUCKETS), "length-buckets")
    n = max(1, -(-buckets.count() // TOGETHER), min(8, buckets.count()))
    names = buckets.select(F.md5("ids").alias("name"), "longest")
    turn = F.row_number().over(W.orderBy(F.desc("longest"), "name"))  # a row for each bucket, not for each vector
    numbers = stored(names.select("name", F.pmod(turn - 1, F.lit(n)).cast("int").alias("part")), "bucket-groups")
    return stored(buckets.drop("part").withColumn("name", F.md5("ids")).join(numbers, "name").drop("name"), "grouped-buckets"), n


def feasible(q: np.ndarray, least: np.ndarray, longest: float, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each focus coordinate that a vector no longer than longest can have if its product with q is at least `least`.

    Of all vectors with the value x there, the best has the product q_f x + |rest of q| sqrt(longest^2 - x^2), a concave
    function of x: the values at which it reaches `least` are a range.
    """
    qf = np.take_along_axis(q, focus, axis=1)
    square = (q**2).sum(axis=1, keepdims=True)
    t = least[:, None]
    rest = np.sqrt(np.maximum(square - qf**2, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        root = np.sqrt(np.maximum(square * longest**2 - t**2, 0)) * rest
        low, high = (t * qf - root) / square, (t * qf + root) / square
    low = np.where(-qf * longest >= t, -longest, low)
    high = np.where(qf * longest >= t, longest, high)
    slack = 1e-6 * (1 + longest)
    free = ~np.isfinite(t) | (square == 0) | (t <= 0)
    return np.where(free, -np.inf, low - slack), np.where(free, np.inf, high + slack)


def _candidates(q: np.ndarray, least: np.ndarray, bucket: dict):
    """(anchors, rows or None for all, exact products) of all pairs of the bucket whose product can be at least `least`."""
    m = bucket["m"]
    length = np.sqrt((q**2).sum(axis=1))
    alive = np.flatnonzero(length * bucket["longest"] * (1 + 1e-9) + 1e-6 >= least)
    if not len(alive):
        return
    n, width = m.shape
    focus = np.argsort(-np.abs(q[alive]), axis=1, kind="stable")[:, : min(FOCUS, width)]
    low, high = feasible(q[alive], least[alive], bucket["longest"], focus)
    begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
    for f in np.unique(focus):
        at = focus == f
        column = m[bucket["lists"][f], f]
        begin[at], end[at] = np.searchsorted(column, low[at], "left"), np.searchsorted(column, high[at], "right")
    few = (end - begin).min(axis=1, initial=n) < n // 4
    for k in np.flatnonzero(few):
        met = np.zeros(n, np.uint8)
        for f, a, b in zip(focus[k], begin[k], end[k], strict=True):
            met[bucket["lists"][f, a:b]] += 1
        rows = np.flatnonzero(met == focus.shape[1])
        if len(rows):
            yield alive[k : k + 1], rows, (m[rows] @ q[alive[k]])[None, :]
    dense = alive[~few]
    for s in range(0, len(dense), AT_ONCE):
        yield dense[s : s + AT_ONCE], None, q[dense[s : s + AT_ONCE]] @ m.T


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query in all that is found: greatest score, then smallest id."""
    q, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return tuple(x[place < k] for x in (q, score, ids))


_NONE = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def search(anchors: dict, buckets: list[dict], k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Query, score and id of the k best rows of each query.

    anchors has vectors q, ids, labels, and for each anchor a row of queries: least and most, the scores between which
    its rows lie (nan: no query). same: rows of the anchor's label, without itself; else rows of other labels.
    """
    q, queries = anchors["q"], anchors["least"].shape[1]
    least, most = anchors["least"].copy(), anchors["most"]
    used = ~np.isnan(least)
    found = _NONE
    for b in sorted(buckets, key=lambda b: -b["longest"]):
        width = b["m"].shape[1]
        wide = q if q.shape[1] >= width else np.pad(q, ((0, 0), (0, width - q.shape[1])))
        if wide.shape[1] > width:
            b = b | {"m": np.pad(b["m"], ((0, 0), (0, wide.shape[1] - width))), "lists": np.pad(b["lists"], ((0, wide.shape[1] - width), (0, 0)))}
            b["lists"][width:] = np.arange(len(b["ids"]))
        floor = np.where(used, least, np.inf).min(axis=1, initial=np.inf)
        more, waiting = [found], 0
        for at, rows, score in _candidates(wide, floor, b):
            ids, labels = (b["ids"], b["labels"]) if rows is None else (b["ids"][rows], b["labels"][rows])
            equal = labels[None, :] == anchors["labels"][at][:, None]
            ok = (equal & (ids[None, :] != anchors["ids"][at][:, None])) if same else ~equal
            x, y = np.nonzero(ok & (score >= floor[at][:, None]))
            for j in range(queries):
                s = score[x, y]
                fit = used[at[x], j] & (s >= least[at[x], j]) & (s <= most[at[x], j])
                if fit.any():
                    more.append((at[x[fit]] * queries + j, s[fit], ids[y[fit]]))
                    waiting += len(more[-1][0])
            if waiting > WAITING:
                more, waiting = [_best(more, k)], 0
        found = _best(more, k)
        last = np.flatnonzero(np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == k - 1)
        i, j = found[0][last] // queries, found[0][last] % queries
        least[i, j] = np.maximum(least[i, j], found[1][last])
    return found


def _pass(anchors: DataFrame, buckets: DataFrame, parts: range, chunks: int, k: int, same: bool) -> DataFrame:
    """query (place in least), vec_id, id, score: the k best rows that each group of buckets has for each query of anchors(chunk, vec_id, label, v, least, most)."""
    if not len(parts):
        parts = range(-1, 0)
    every = F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[-1])))
    asked = anchors.select(every.alias("part"), "chunk", "vec_id", "label", "v", "least", "most")
    dealt = buckets.filter(F.col("part").between(parts[0], parts[-1])).select("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "width", "longest", "ids", "labels", "rows", "lists")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("vec_id", pa.int64()), ("query", pa.int32()), ("id", pa.int64()), ("score", pa.int64()))})
        a = left.to_pydict()
        ask = {"q": matrix(a["v"]), "ids": np.array(a["vec_id"], np.int64), "labels": np.array(a["label"], np.int64)}
        ask |= {n: np.array(a[n], np.float64).reshape(len(a[n]), -1) for n in ("least", "most")}
        have = []
        for r in right.to_pylist():
            n = len(r["ids"]) // 8
            have.append({"longest": r["longest"], "ids": np.frombuffer(r["ids"], "<i8"), "labels": np.frombuffer(r["labels"], "<i8"), "m": np.frombuffer(r["rows"], "<i4").reshape(n, -1).astype(np.float64) if r["width"] else np.zeros((n, 0)), "lists": np.frombuffer(r["lists"], "<u2").reshape(r["width"], n)})
        query, score, ids = search(ask, have, k, same)
        wide = ask["least"].shape[1]
        return pa.table({"vec_id": ask["ids"][query // wide], "query": (query % wide).astype(np.int32), "id": ids, "score": score.astype(np.int64)})

    return asked.groupBy("part", "chunk").cogroup(dealt.groupBy("part", "chunk")).applyInArrow(near, "vec_id long, query int, id long, score long")


def _two_passes(anchors: DataFrame, buckets: DataFrame, n: int, chunks: int, k: int, same: bool) -> DataFrame:
    """The k best rows of each query, with their rank: the first group of buckets gives each query the score that rows of the others must reach."""
    first = stored(_pass(anchors, buckets, range(1), chunks, k, same), "first-found")
    place = W.partitionBy("vec_id", "query").orderBy(F.desc("score"), "id")
    kth = first.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k)
    raised = kth.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("query", F.col("score").cast("double")))).alias("_m"))
    least = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_m", i), x)))
    asked = stored(anchors.join(raised, "vec_id", "left").withColumn("least", F.when(F.col("_m").isNull(), F.col("least")).otherwise(least)).drop("_m"), "asked")
    both = first.unionByName(_pass(asked, buckets, range(1, n), chunks, k, same))
    return both.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, embedding, label).

    Anchors are the rows where is_anchor holds (vec_id divisible by 100 unless given). An anchor's positives are the other
    rows of its label of greatest product; for each, its negatives are the first rows of other labels whose product is
    between low and high percent of the positive's. Ties go to the smaller vec_id.

    Anchors go in chunks against groups of length buckets, each pair in one task of bounded size, which gives the few best
    rows of each query. Within it, buckets come by descending length. A bucket is skipped if its longest vector can't reach
    the score that a query needs. Else ranges of the query's largest coordinates, found in the bucket's sorted lists, are
    intersected, and only rows in all of them are multiplied; where the ranges are wide, all rows are.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a
    vec_id, the one with the least label (then vector) stands. Shorter vectors count as ending in zeros; components of
    16,384 and more are held there (exact products up to 512 components). Anchors without positives, and positives without negatives, have no rows. An
    empty table gives an empty one; other columns are left out.
    """
    vectors = stored(integer_vectors(rows), "vectors")
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    buckets, n = length_buckets(vectors)
    own = vectors.filter(is_anchor)
    chunks = max(1, -(-own.count() // CHUNK))
    own = own.select(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), "vec_id", "label", "v")
    none, all_ = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    near = stored(_two_passes(stored(own.withColumn("least", none).withColumn("most", all_), "anchors"), buckets, n, chunks, positives, True).select("vec_id", "rank", "id", "score"), "positives")
    lists = near.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("score").cast("double")))).alias("_p"))
    ask = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda r: F.try_element_at("_p", r))
    nan = F.lit(float("nan"))
    least = F.transform("_p", lambda p: F.coalesce(F.ceil(low * p / 100).cast("double"), nan))
    most = F.transform("_p", lambda p: F.coalesce(F.floor(high * p / 100).cast("double"), nan))
    with_positives = own.join(lists, "vec_id").withColumn("_p", ask).withColumn("least", least).withColumn("most", most).drop("_p")
    found = _two_passes(stored(with_positives, "anchors"), buckets, n, chunks, negatives, False)
    of = near.select("vec_id", (F.col("rank") - 1).alias("query"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["vec_id", "query"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
