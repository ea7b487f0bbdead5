"""Token ids in binary shards: each id in the fewest bits that hold the vocabulary.

A shard file is, all numbers little-endian:
    b"TKB1", bits u8, 3 zero bytes
    blocks: BLOCK ids each (the last one fewer), packed lowest bit first, each padded to whole bytes
    block offsets from the start of the file, u64 each, one more than blocks
    documents: doc_id i64 (null: the least), first id within the shard u64, number of ids u64
    trailer: ids u64, documents u64, blocks u64, where the block offsets start u64, b"TKB1"
Blocks can be unpacked on their own, so any run of ids is read by seeking to the blocks that hold it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoder import batches, encoder
from .files import make_dir, written
from .shared import arrow_rows, new_dir, small, stored

MAGIC = b"TKB1"
BLOCK = 65_536
#: Bytes of text whose ids go to one shard, on average, and shards at most, as the driver keeps a bound for each: beyond so
#: many, each holds more. A task writes its shard block by block and file by file, whatever its size.
SHARD_TEXT, MOST_SHARDS = 24_000_000, 20_000
#: Bytes of packed ids at which a shard goes on in another file, before its next document: files stay small enough to be read whole.
FILE_BYTES = 32_000_000
NO_ID = -(2**63)
_DOCS = np.dtype([("doc_id", "<i8"), ("first", "<u8"), ("n", "<u8")])


def bits_for(n_vocab: int) -> int:
    return max(1, int(n_vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    grid = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return grid.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, 0
        self.offsets, self.docs, self.ids, self.held, self.n_held = [], [], 0, [], 0
        self._put(MAGIC + bytes([bits, 0, 0, 0]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.offsets.append(self.at)
            self._put(pack(ids[i : min(i + BLOCK, whole)], self.bits))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(last=True)
        at = self.at
        self._put(np.asarray([*self.offsets, at], "<u8").tobytes())
        self._put(np.asarray(self.docs, _DOCS).tobytes())
        self._put(np.asarray([self.ids, len(self.docs), len(self.offsets), at], "<u8").tobytes() + MAGIC)


class ShardReader:
    """Random access to the ids of a shard held in memory (or in a memory map)."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC or bytes(data[-4:]) != MAGIC:
            raise ValueError("not a token shard")
        self.data, self.bits = data, data[4]
        self.n_ids, n_docs, n_blocks, at = (int(x) for x in np.frombuffer(data, "<u8", 4, len(data) - 36))
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at)
        self.docs = np.frombuffer(data, _DOCS, n_docs, at + 8 * (n_blocks + 1))

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the first-th on; reads only the blocks that hold them."""
        if n <= 0:
            return np.empty(0, "<u4")
        a, b = first // BLOCK, (first + n - 1) // BLOCK
        parts = [unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], min(BLOCK, self.n_ids - k * BLOCK), self.bits) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * BLOCK : first - a * BLOCK + n]


def _encode(tokenizer: str, end_id: int | None, bounds: list[int], first: int, width: str):
    """Shard, doc_id and ids of each row. Rows without doc_id have their shard already; the others' shards start at first."""

    def run(rows):
        enc = encoder(tokenizer)
        tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        for batch in rows:
            ids, texts, shards = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], batch.column("shard").to_pylist()
            done = 0
            for part in batches(texts):
                out = [np.frombuffer(x + tail, "<u4").astype(width).tobytes() for x in enc.encode(part)]
                own = ids[done : done + len(part)]
                done += len(part)
                shard = [s if i is None else first + bisect_left(bounds, i) for i, s in zip(own, shards[done - len(part) : done], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(own, pa.int64()), pa.array(out, pa.binary())], names=["shard", "doc_id", "ids"])

    return run


def _write(folder: str, bits: int, width: str, file_bytes: int):
    def run(rows):
        rows = ((s, i, x) for b in rows for s, i, x in zip(*(b.column(k).to_pylist() for k in ("shard", "doc_id", "ids")), strict=True))
        row, done, part = next(rows, None), [], 0
        while row is not None:
            shard = row[0]
            part = part + 1 if done and done[-1][0] == shard else 0
            with written(f"{folder}/shard-{shard:07d}-{part:06d}.tkb") as out:
                w = ShardWriter(out, bits)
                while row is not None and row[0] == shard and w.ids * bits < 8 * file_bytes:
                    w.add(row[1], np.frombuffer(row[2], width))
                    row = next(rows, None)
                w.close()
            done.append((shard, part, w.ids, len(w.docs)))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["shard", "part", "n_ids", "n_docs"])

    return run


def write_token_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, shard_text: int = SHARD_TEXT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes docs(doc_id, text) and writes shards of ascending doc_id to folder. Returns shard, part, n_ids, n_docs of each file (an action has run).

    The scan encodes; only packed ids are shuffled, to the shard of their doc_id's range. Ranges come from approximate
    quantiles of doc_id over all rows, by a sketch whose size follows from the number of shards. Rows of equal doc_id lie
    together in byte order of their ids. Rows without doc_id come first, in shards of their own: dealt by a hash of the
    text, in byte order within each. A shard is one file or several, each of about file_bytes at most or one document: so
    files stay bounded where shards grow, and the rows of one doc_id may go on in the next file. Shards that folder holds from before are removed.
    """
    n_vocab = encoder(tokenizer).n_vocab
    bits = bits_for(max(n_vocab, (end_id or 0) + 1))
    width = "<u2" if bits <= 16 else "<u4"
    size = F.octet_length("text").cast("long")
    total, nameless, least = docs.agg(F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size)), F.min("doc_id")).first()
    n = min(MOST_SHARDS, max(1, -(-(total or 0) // shard_text)))
    first = max(1, n * (nameless or 0) // (total or 1)) if nameless is not None else 0
    bounds = []
    if n > 1 and least is not None:
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]))
    make_dir(folder, without=".tkb")
    shard_of_nameless = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(max(1, first))).cast("int"))
    encoded = docs.select("doc_id", "text", shard_of_nameless.alias("shard")).mapInArrow(_encode(tokenizer, end_id, bounds, first, width), "shard int, doc_id long, ids binary")
    dealt = encoded.repartition(len(bounds) + 1 + first, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    with arrow_rows(docs.sparkSession, 1_000):
        return stored(dealt.mapInArrow(_write(folder, bits, width, file_bytes), "shard int, part int, n_ids long, n_docs long"), "shards")


def _read(rows):
    for batch in rows:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = data.as_buffer()
            r = ShardReader(memoryview(data))
            shard, part = (int(x) for x in path.rsplit("/", 1)[1].removesuffix(".tkb").split("-")[1:])
            for k in range(0, len(r.docs), 4096):
                docs = r.docs[k : k + 4096]
                first = int(docs["first"][0])
                ids = r.ids(first, int(docs["n"].sum()))
                at = (docs["first"] - first).tolist()
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at, docs["n"].tolist(), strict=True)]
                own = [None if i == NO_ID else i for i in docs["doc_id"].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array([part] * len(docs), pa.int32()), pa.array(own, pa.int64()), pa.array(docs["first"].astype("i8")), pa.array(docs["n"].astype("i8")), pa.array(crc, pa.int64())],
                    names=["shard", "part", "doc_id", "first", "n_tokens", "ids_crc32"],
                )


def read_token_shards(spark, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards of folder, read back from the files.

    start counts the ids of all documents before it; the totals come from shards, one row for each file. Files that shards doesn't list, left by another job, give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tkb").load(folder)
    rows = files.select("path", "content").mapInArrow(_read, "shard int, part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    base = shards.select("shard", "part", (F.sum("n_ids").over(W.orderBy("shard", "part")) - F.col("n_ids")).alias("base"))
    return rows.join(small(base), ["shard", "part"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as token shards and returns what the files hold: doc_id, start, n_tokens, ids_crc32.

    Null and empty text: only the end id. Repeated rows, and several texts of one doc_id, are documents of their own,
    in byte order of their ids. Rows without doc_id come first, in an order of their own that hangs on their texts alone.
    An empty table writes no shard and gives no row. Other columns are left out. One document's ids are in one
    file; the rows of one doc_id are written by one task, file by file.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), "text")
    shards = write_token_shards(docs, tokenizer, folder, end_id)
    return read_token_shards(spark, folder, shards)
