"""WARC archives: writing with revisit records, reading back, and an external merge of the files' capture runs."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import make_dir, written
from .shared import arrow_rows, new_dir, partitions, small, stored

#: Bytes of payload in one archive file; a file ends with the record that reaches it.
FILE_PAYLOAD = 64_000_000
#: Payloads below this are always written whole.
LEAST_REVISIT = 1_000
#: Captures of a range of the merged index, those of a packet, packets that go to a Python worker at once, and runs of one merge.
RANGE_ROWS, READ, PACKETS, FAN_IN = 1_000_000, 1_000, 64, 64
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN_SCHEMA = "run string, urlkey string, ts string, page_id long, offset long, length long"


def url_key(url):
    """Host labels from the top, then ')' and the rest in lower case: captures of a site sort together. Null: '-'."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^www\.|:\d+$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?#]*", ""))
    return F.when(F.length(bare) > 0, key).otherwise("-")


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the HTTP header only, and names the record it refers to and the payload's digest and size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>", f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    at = 0
    while at < len(data):
        z, end, out = zlib.decompressobj(31), at, []
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"record at {at} is cut off")
            chunk = data[end : end + 65_536]
            out.append(z.decompress(chunk))
            end += len(chunk)
        end -= len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    ident = lambda x: None if x in (None, "<urn:page:->") else int(x[len("<urn:page:") : -1])
    out = {"page_id": ident(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")), "payload": None}
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        return out | {"payload_bytes": len(out["payload"]), "payload_digest": hashlib.sha1(out["payload"]).hexdigest()}
    return out | {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}


def _write(folder: str):
    def run(rows):
        context = TaskContext.get()
        # named by attempt: what a lost attempt has left is in no index, and is not read
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId():x}-{uuid.uuid4().hex[:8]}"
        rows = (x for b in rows for x in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "urlkey")), strict=True))
        row, n = next(rows, None), 0
        while row is not None:
            name, index, size, at = f"captures-{attempt}-{n:04d}.warc.gz", [], 0, 0
            with written(f"{folder}/{name}") as out:
                while row is not None and size < FILE_PAYLOAD:
                    page_id, url, html, digest, refers_to, key = row
                    payload = (html or "").encode()
                    ts = (EPOCH + timedelta(seconds=(page_id or 0) % 2_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                    data = record(page_id, url, ts, payload, digest, refers_to)
                    out.write(data)
                    index.append((name, key, ts, page_id, at, len(data)))
                    at, size, row = at + len(data), size + len(payload), next(rows, None)
            n += 1
            index.sort(key=lambda x: (x[1], x[2], -1 if x[3] is None else x[3], x[4]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _RUN_KINDS, strict=True)], names=_RUN_NAMES)

    return run


_RUN_NAMES = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
_RUN_KINDS = [pa.string() if x.endswith("string") else pa.int64() for x in RUN_SCHEMA.split(", ")]


class LoserTree:
    """Merges sorted runs, any iterables: the root's winner is taken, and only the path of its run is played again. Of each run one item is held."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.top = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k  # the loser of each match; [0] is the overall winner
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.top[i], self.top[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # the first to arrive waits here for its opponent
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs and (top := self.top[i := self.tree[0]]) is not None:
            yield top
            self.top[i] = next(self.runs[i], None)
            self._play(i)


def merge_tree(runs: list[Iterable[tuple]], fan_in: int) -> LoserTree:
    """One loser tree over at most fan_in runs; where there are more, over trees of at most fan_in each."""
    while len(runs) > fan_in:
        runs = [LoserTree(runs[k : k + fan_in]) for k in range(0, len(runs), fan_in)]
    return LoserTree(runs)


_PACKET = "source string, slot long, urlkey array<string>, ts array<string>, page_id array<long>, run array<string>, offset array<long>, length array<long>"
_FIELDS = ("urlkey", "ts", "page_id", "run", "offset", "length")
_FIELD_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _cut(source: str, captures: Iterable[tuple], bounds: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """Packets of at most READ sorted captures of one run, none over the edge of a slot: width ranges side by side."""

    def packet():
        lists = [pa.array([c], pa.list_(t)) for c, t in zip(zip(*held, strict=True), _FIELD_KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([source]), pa.array([slot], pa.int64()), *lists], names=["source", "slot", *_FIELDS])

    held, slot = [], 0
    for x in captures:
        here = bisect_right(bounds, x) // width
        if held and (here != slot or len(held) == READ):
            yield packet()
            held = []
        slot = here
        held.append(x)
    if held:
        yield packet()


def _pack(bounds: list[tuple], width: int):
    """The runs as the archives' writers left them, rows of a run in order, as packets."""

    def captures(rows):
        for b in rows:
            for run, key, ts, page_id, offset, length in zip(*(b.column(k).to_pylist() for k in _RUN_NAMES), strict=True):
                yield key, ts, -1 if page_id is None else page_id, run, offset, length

    def work(rows):
        for run, own in groupby(captures(rows), key=lambda x: x[3]):
            yield from _cut(run, own, bounds, width)

    return work


class _Run:
    """One run's share of a slot: packets, of which one at a time is turned to Python values."""

    def __init__(self):
        self.packets: list[pa.RecordBatch] = []

    def __iter__(self):
        for p in self.packets:
            yield from zip(*(p.column(k)[0].as_py() for k in _FIELDS), strict=True)


def _merged(rows, fan_in: int) -> Iterator[tuple[int, int, LoserTree]]:
    """group, slot and the merged captures of each slot of a group, whose packets come run by run, each run in order."""
    one = ((b.column("group")[k].as_py(), b.column("slot")[k].as_py(), b.column("source")[k].as_py(), b.slice(k, 1)) for b in rows for k in range(b.num_rows))
    for (group, slot), packets in groupby(one, key=lambda x: x[:2]):
        runs = []
        for _, own in groupby(packets, key=lambda x: x[2]):
            runs.append(_Run())
            runs[-1].packets += [x[3] for x in own]
        yield group, slot, merge_tree(runs, fan_in)


def _merge_pass(bounds: list[tuple], width: int, fan_in: int):
    """A pass: each group's runs become one run, named by the group, cut for the next pass."""

    def work(rows):
        for group, _, captures in _merged(rows, fan_in):
            yield from _cut(str(group), captures, bounds, width)

    return work


def _last_pass(fan_in: int):
    """The last pass: each range's captures in order, numbered within it."""

    def work(rows):
        for _, slot, captures in _merged(rows, fan_in):
            numbered = enumerate(captures)
            while out := list(islice(numbered, 10_000)):
                cols = list(zip(*(x for _, x in out), strict=True))
                kept = [pa.array(cols[k], _FIELD_KINDS[k]) for k in (0, 1, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([slot] * len(out), pa.int64()), pa.array([n for n, _ in out], pa.int64()), *kept], names=["part", "row", "urlkey", "ts", "run", "offset", "length"])

    return work


def range_bounds(runs: DataFrame, n: int, total: int) -> list[tuple]:
    """Where n ranges of about equally many captures begin, but the first: from a sample of 200 a range, one row of each range to the driver."""
    keys = ("urlkey", "ts", "page_id", "run", "offset")
    some = runs.select("urlkey", "ts", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "run", "offset").sample(fraction=min(1.0, 200 * n / max(1, total)), seed=7)
    firsts = some.repartitionByRange(n, *keys).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys)).alias("first")).select("first.*").collect()
    return sorted(tuple(r) for r in firsts)[1:]


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one global order of URL key, time and page: position, urlkey, ts, run, offset, length.

    An external merge in passes over stored runs. The order is cut to ranges of about range_rows captures (a URL with very
    many captures is cut by time, page and place, so none grows with it). In each pass groups of at most fan_in runs become
    one run each; a task merges what a group has of as many neighbouring ranges as make about range_rows captures, so
    its rows from each run are about range_rows / fan_in however many runs there are. Runs are grouped by a hash of their
    names, so that a group's captures spread over the ranges as all do. Only packets of up to READ captures are shuffled
    and sorted, never single captures; a task holds its packets and unpacks one of each run at a time. The rows
    of a run must come in order, as write_archives gives them. Runs without rows, and no runs, give no rows.
    """
    spark = runs.sparkSession
    total, n_runs = runs.agg(F.count("*"), F.count_distinct("run")).head()
    n, passes = max(partitions(spark), -(-total // range_rows)), 1
    while fan_in**passes < 2 * n_runs:  # twice: groups by hash differ in size in the first pass, later ones have fan_in runs each
        passes += 1
    bounds = range_bounds(runs, n, total)
    group = F.xxhash64("source")
    packets = stored(runs.select(*_RUN_NAMES).mapInArrow(_pack(bounds, fan_in ** (passes - 1)), _PACKET), "packets")
    for left in range(passes - 1, -1, -1):
        n_groups = fan_in**left  # each has that share of the captures, and a slot as many ranges
        keys = [F.get(k, F.lit(0)) for k in _FIELDS[:5]]
        dealt = packets.withColumn("group", F.pmod(group, F.lit(n_groups))).repartition(n_groups * -(-n // n_groups), "group", "slot").sortWithinPartitions("group", "slot", "source", *keys)
        with arrow_rows(spark, PACKETS):
            if left:
                packets, group = stored(dealt.mapInArrow(_merge_pass(bounds, fan_in ** (left - 1), fan_in), _PACKET), "runs"), F.col("source").cast("long")
            else:
                merged = stored(dealt.mapInArrow(_last_pass(fan_in), "part long, row long, urlkey string, ts string, run string, offset long, length long"), "captures")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))  # a row for each range
    return merged.join(F.broadcast(base), "part").select((F.col("base") + F.col("row")).alias("position"), "urlkey", "ts", "run", "offset", "length")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the files' capture runs, each sorted (an action has run).

    Which payloads repeat is settled on digests alone, before any payload moves; payloads are never shuffled.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    slim = stored(pages.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest", F.octet_length("html").alias("n_bytes")), "payloads")
    # stored before the join, and nothing grouped after it, so that a join by the digest of very many copies can be split
    kept = stored(slim.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "kept")
    revisits = stored(slim.join(small(kept), ["digest", "n_bytes"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to"), "revisits")
    if revisits.groupBy("page_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():  # rows that repeat a page
        revisits = stored(revisits.distinct(), "revisits")
    make_dir(folder)
    rows = pages.join(small(revisits), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", url_key(F.col("url")).alias("urlkey"))
    rows.mapInArrow(_write(folder), RUN_SCHEMA).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/index")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, payload binary"


def _read(with_payload: bool):
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.binary() if x.endswith("binary") else pa.int64() for x in _READ.split(", ")]

    def run(rows):
        for batch in rows:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out, held, name = [], 0, path.rsplit("/", 1)[1]
                view = memoryview(data.as_buffer())
                for at, _, content in members(view):
                    x = parse(content)
                    out.append((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], name, at, x["payload"] if with_payload else None))
                    held += len(content) if with_payload else 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives that folder's index lists: page_id, payload_bytes, payload_digest, record_type, refers_to, run, offset, payload (null for revisits)."""
    listed = spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/index").select("run").distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("run", F.substring_index("path", "/", -1)).join(F.broadcast(listed), "run", "left_semi")  # a row for each file
    return files.select("path", "content").mapInArrow(_read(with_payload), _READ)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC, merges the capture index, reads the archives back: a row for each record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, then urlkey, ts and position in the merged index.
    The table has no capture time, so a page is taken as captured page_id seconds after EPOCH. Null html: an empty
    payload. Null url: the key '-'. Rows that repeat a page_id are records of their own; those of the largest page_id of
    a payload are all responses. A row without page_id is a response, and its page_id is null again. An empty table
    writes no file and gives no row. Other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    index = merge_runs(write_archives(pages, folder))
    records = read_archives(spark, folder, with_payload=False).drop("payload")
    return records.join(index.drop("length"), ["run", "offset"]).drop("run", "offset")
