"""N-gram Jaccard join: a blocked sparse product of the documents' shingle incidence, with bounds from set sizes.

Shared shingles alone decide overlaps, so shingles of a single document leave at the first exchange. Shingles are ordered
by how many documents hold them; of sets that are similar enough, the rarest few (how few follows from the set's size)
must share one. Documents that share such a shingle, directly or by others, form a candidate cluster. Within it the
overlap counts of blocks of documents are products of their incidence matrices. A cluster of many blocks first
multiplies each block with itself and with the cluster's first block, which joins copies of one text at a cost that is
linear in their number; then only those blocks meet that hold candidates not joined yet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .flat import flat, pieces, shingles
from .shared import first_copies, groups, lower_ascii, small, stored, trim, trimmed

#: Documents of a block.
BLOCK = 128
#: Text hashed at once, and shingles sent on together.
PIECE, HELD = 1_000_000, 600_000
#: Documents of one packet that make a shingle hot, and the place of hot shingles in the order from rare to common.
HOT_HERE, HOT = 32, 1 << 62


def _numbers(x: np.ndarray) -> bytes:
    """int64 values that mostly rise by little."""
    return zlib.compress(np.diff(x.astype("<i8"), prepend=0).tobytes(), 1)


def _back(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), "<i8"))


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers that need no more than width."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _width(n_buckets: int) -> int:
    """Bytes of a 64-bit hash divided by the number of buckets; the rest of the division is the bucket, so no bit is lost."""
    return 7 if n_buckets >= 256 else 8


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


_SENT = "bucket int, kind int, hashes binary, ids binary"
#: Kinds of rows: shingles with their documents, marks of hot shingles; and, on their way to homes (buckets below 0), set sizes and hot shingles.
SHINGLES, MARKS, SIZES, HOT_ONES = range(4)


def _send(n_buckets: int, n_homes: int, size: int):
    """Shingles to the bucket of their hash, and each document's set size on its way to its home.

    Of a shingle that many documents of a packet hold, one mark goes to the bucket, and the documents go to their homes at
    once: no task gets all documents of a very common shingle.
    """
    n, width = np.uint64(n_buckets), _width(n_buckets)

    def out(held: list) -> Iterator[pa.RecordBatch]:
        h, ids, of, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (h % n).astype(np.int32)
        order = np.lexsort((h, bucket))
        h, ids, bucket = h[order], ids[order], bucket[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        many = np.diff(first, append=len(h))
        hot = np.repeat(many >= HOT_HERE, many)
        rows = []
        marks = first[many >= HOT_HERE]
        for a, b in _cut(bucket[marks]):
            rows.append((int(bucket[marks[a]]), MARKS, _narrow(h[marks[a:b]] // n, width), b""))
        home = ids[hot] % n_homes
        by_home = np.flatnonzero(hot)[np.lexsort((ids[hot], home))]
        for a, b in _cut(ids[by_home] % n_homes):
            own = by_home[a:b]
            rows.append((-1 - int(ids[own[0]] % n_homes), HOT_ONES, h[own].astype("<u8").tobytes(), _numbers(ids[own])))
        h, ids, bucket = h[~hot], ids[~hot], bucket[~hot]
        for a, b in _cut(bucket):
            rows.append((int(bucket[a]), SHINGLES, _narrow(h[a:b] // n, width), _numbers(ids[a:b])))
        home = of % n_homes
        for k in np.unique(home).tolist():
            rows.append((-1 - k, SIZES, sizes[home == k].astype("<i8").tobytes(), _numbers(of[home == k])))
        yield _batch(_SENT, list(zip(*rows, strict=True)))

    def run(rows):
        held, count = [], 0
        for batch in rows:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column("text"))
            for a, b in pieces(offsets, PIECE):
                h, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(at)
                held.append((h, np.repeat(doc[a:b], n), doc[a:b], n))
                count += len(h) + b - a
                if count >= HELD:
                    yield from out(held)
                    held, count = [], 0
        if held:
            yield from out(held)

    return trimmed(run)


def _cut(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(x):
        return []
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True))


_HELD = "home int, kind int, ids binary, hashes binary, counts binary"


def _count(n_buckets: int, n_homes: int):
    """Of a bucket: the shingles that several documents hold, with how many, to the documents' homes. What is on its way to a home passes."""
    width = _width(n_buckets)

    def run(key, table):
        bucket = key[0].as_py()
        kind = table.column("kind").to_numpy()
        if bucket < 0:
            return pa.table([pa.array(np.full(len(kind), -1 - bucket, np.int32)), table.column("kind"), table.column("ids"), table.column("hashes"), pa.array([b""] * len(kind), pa.binary())], names=[x.split()[0] for x in _HELD.split(", ")])
        hashes, packed = table.column("hashes").to_pylist(), table.column("ids").to_pylist()
        marks = [_wide(hashes[k], width) for k in np.flatnonzero(kind == MARKS)]
        parts = [(_wide(hashes[k], width), _back(packed[k])) for k in np.flatnonzero(kind == SHINGLES)]
        del hashes, packed
        if not parts:
            return pa.Table.from_batches([_batch(_HELD, [[]] * 5)])
        h, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        h, ids = h[new], ids[new]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        n = np.diff(first, append=len(h))
        df = np.repeat(n, n)
        if marks:
            df[np.isin(h, np.concatenate(marks))] = HOT
        h, ids, df = h[df > 1], ids[df > 1], df[df > 1]
        full = h * np.uint64(n_buckets) + np.uint64(bucket)
        home = ids % n_homes
        order = np.lexsort((ids, home))
        full, ids, df, home = full[order], ids[order], df[order], home[order]
        out = [(int(home[a]), SHINGLES, _numbers(ids[a:b]), full[a:b].astype("<u8").tobytes(), df[a:b].astype("<i8").tobytes()) for a, b in _cut(home)]
        del h, ids, df, full, order
        trim()
        return pa.Table.from_batches([_batch(_HELD, list(zip(*out, strict=True)) or [[]] * 5)])

    return run


_PROFILE = "cid long, n_shingles long, prefix array<long>, shared binary"


def _profile(percent: int):
    """Of each document: its set's size, the shingles of which similar sets must share one, and all shingles that others hold."""

    def run(key, table):
        sizes, parts = {}, []
        for kind, ids, h, df in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "hashes", "counts")), strict=True):
            own = _back(ids)
            if kind == SHINGLES:
                parts.append((own, np.frombuffer(h, "<u8"), np.frombuffer(df, "<i8")))
            elif kind == HOT_ONES:
                parts.append((own, np.frombuffer(h, "<u8"), np.full(len(own), HOT)))
            else:
                for i, n in zip(own.tolist(), np.frombuffer(h, "<i8").tolist(), strict=True):
                    sizes[i] = max(n, sizes.get(i, 0))
        held = {}
        if parts:
            ids, h, df = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h, df, ids))
            ids, h = ids[order], h[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])]  # texts that share a doc_id can bring a shingle twice
            ids, h = ids[new], h[new]
            cuts = np.flatnonzero(np.diff(ids, prepend=~ids[:1]))
            held = {int(ids[a]): h[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True)}
        out = []
        for i, n in sizes.items():
            own = held.get(i, np.empty(0, "<u8"))
            # the n - len(own) shingles of this document alone come first in the order
            reach = n - -(-percent * n // 100) + 1 - (n - len(own))
            out.append((i, n, own[:reach].view("<i8").tolist() if reach > 0 else [], np.sort(own).tobytes() if reach > 0 else None))
        return pa.Table.from_batches([_batch(_PROFILE, list(zip(*out, strict=True)) or [[]] * 4)])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The counts of common elements of all pairs of sorted sets: a product of the sparse incidence matrix with itself."""
    k = len(sets)
    h, of = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    first = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.empty(0, np.int64)
    n = np.diff(first, append=len(h))
    out = np.zeros(k * k, np.int64)
    for width in np.unique(n[(n > 1) & (n < 12)]).tolist():  # columns of few documents: their pairs
        at = first[n == width]
        for i in range(width):
            for j in range(i + 1, width):
                out += np.bincount(of[at + i] * k + of[at + j], minlength=k * k)
    out = out.reshape(k, k)
    out = out + out.T
    wide = np.flatnonzero(n >= 12)
    for a in range(0, len(wide), 4096):  # the others: dense products of some columns at a time
        own = wide[a : a + 4096]
        rows = np.concatenate([of[first[c] : first[c] + n[c]] for c in own])
        m = np.zeros((k, len(own)), np.float32)
        m[rows, np.repeat(np.arange(len(own)), n[own])] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def block_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links within a block or two: each document that links join to a smaller id, with that id."""
    if len(ids) < 2:
        return []
    both = sizes[:, None] + sizes[None, :]
    near = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    common = overlaps(sets)
    linked = near & (100 * common >= percent * (both - common))
    np.fill_diagonal(linked, False)
    root, out = np.full(len(ids), -1), []
    for i in np.argsort(ids, kind="stable").tolist():
        if root[i] >= 0:
            continue
        root[i], front = i, [i]
        while front:
            found = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[found] = i
            front = found.tolist()
            out += [(int(ids[x]), int(ids[i])) for x in front]
    return out


def _multiply(percent: int):
    def run(key, table):
        cluster, ids, n = (table.column(c).to_numpy() for c in ("cluster", "cid", "n_shingles"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("shared").to_pylist()]
        order = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(np.diff(cluster[order], prepend=~cluster[order][:1]))
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            out += block_links(ids[own], n[own], [sets[i] for i in own], percent)
        return pa.Table.from_batches([_batch("a long, b long", list(zip(*out, strict=True)) or [[]] * 2)])

    return run


def _links(profiles: DataFrame, percent: int, n_groups: int) -> DataFrame:
    """a, b: links whose components are those of all links between documents of profiles. Clusters of one block are dealt to n_groups tasks."""
    lists = profiles.select("cid", F.explode("prefix").alias("h"))
    centres = stored(lists.groupBy("h").agg(F.min("cid").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n"), "centres")
    lists = stored(lists.join(centres, "h"), "lists")
    clusters = components(lists.select(F.col("cid").alias("a"), F.col("centre").alias("b"))).select(F.col("id").alias("cid"), F.col("root").alias("cluster"))
    sizes = stored(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks")), "cluster-sizes")
    placed = profiles.select("cid", "n_shingles", "shared").join(clusters.join(small(sizes), "cluster"), "cid")
    placed = stored(placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "blocks")
    one = placed.filter("blocks = 1").select(F.lit(-1).cast("long").alias("k"), F.pmod(F.xxhash64("cluster"), F.lit(n_groups)).cast("int").alias("i"), F.lit(0).alias("j"), "cluster", "cid", "n_shingles", "shared")
    many = placed.filter("blocks > 1")
    first = F.when(F.col("block") == 0, F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j"))))
    own = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")))
    tasks = F.concat(own, F.coalesce(first, F.array(F.struct(F.lit(0).alias("i"), F.col("block").alias("j")))))
    some = many.select("cluster", "cid", "n_shingles", "shared", F.explode(tasks).alias("t"))
    some = some.select(F.col("cluster").alias("k"), "t.i", "t.j", "cluster", "cid", "n_shingles", "shared")
    links = stored(one.unionByName(some).groupBy("k", "i", "j").applyInArrow(_multiply(percent), "a long, b long"), "links")
    if not many.limit(1).count():
        return links
    # clusters of many blocks: candidates that are not in one component yet
    known = components(links)
    labelled = many.select("cluster", "cid", "block").join(known.select(F.col("id").alias("cid"), "root"), "cid", "left")
    held = lists.select("h", "cid").join(labelled.withColumn("root", F.coalesce("root", "cid")), "cid")
    counts = held.groupBy("h", "cluster", "root", "block").agg(F.count("*").alias("n"))
    by_root = counts.groupBy("h", "root").agg(F.sum("n").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    open_lists = stored(counts.join(by_root.drop("roots"), "h").select("h", "cluster", "block", "root", "main"), "open-lists")
    loose = open_lists.filter("root <> main").select("h", F.col("block").alias("x"), F.col("root").alias("rx")).distinct()
    meet = loose.join(open_lists.select("h", "cluster", "block", "root"), "h").filter("rx <> root and x <> block and x > 0 and block > 0")
    pairs = meet.select("cluster", F.least("x", "block").alias("i"), F.greatest("x", "block").alias("j")).distinct()
    sides = pairs.select("cluster", "i", "j", F.explode(F.array("i", "j")).alias("block"))
    rest = many.select("cluster", "cid", "n_shingles", "shared", "block").join(sides, ["cluster", "block"])
    rest = rest.select(F.col("cluster").alias("k"), "i", "j", "cluster", "cid", "n_shingles", "shared")
    return links.unionByName(rest.groupBy("k", "i", "j").applyInArrow(_multiply(percent), "a long, b long"))


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Of each row of docs(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach), and text_digest.

    A document's set holds its distinct runs of size words (fewer words: all of them as one), A-Z in lower case. Two
    documents link if 100 * intersection >= percent * union. Sets are compared by all 64 bits of their
    shingles' hashes.

    Null, empty and blank texts have the empty set and are linked with nothing. Equal texts (repeated rows too) are one
    candidate, and each row gets the result. Rows without doc_id are not documents and are left out; a doc_id is taken as
    one document, and if it has several texts, their sets are joined and the largest set's size counts. An empty table
    gives an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    text = lower_ascii(F.coalesce("text", F.lit("")))
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.md5(text).alias("text_digest"))
    slim = stored(docs.select("doc_id", "text_digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "texts")
    reps = first_copies(docs, slim.drop("n_bytes"), "text_digest").select("doc_id", "text")
    n_homes = groups(spark, slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    n_buckets = 4 * n_homes
    sent = reps.mapInArrow(_send(n_buckets, n_homes, size), _SENT)
    counted = sent.groupBy("bucket").applyInArrow(_count(n_buckets, n_homes), _HELD)
    profiles = stored(counted.groupBy("home").applyInArrow(_profile(percent), _PROFILE), "profiles")
    roots = components(_links(profiles.filter("size(prefix) > 0"), percent, n_buckets)).select(F.col("id").alias("cid"), "root")
    sets = profiles.select("cid", "n_shingles").join(roots, "cid", "left")
    # stored before the join, so that a join by the digest of very many copies can be split
    first = stored(slim.groupBy("text_digest").agg(F.min("doc_id").alias("cid")).join(sets, "cid"), "classes")
    out = slim.join(small(first), "text_digest")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "cid")).alias("component_id"), "text_digest")
