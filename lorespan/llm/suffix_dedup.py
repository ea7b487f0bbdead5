"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes contains the least hash of its grams of GRAM bytes at a place that depends on its bytes alone,
so equal strings meet at equal grams. Only grams that occur twice anywhere (a few hundredths to tenths of them) keep the
text around them. Their suffixes are dealt out by the gram. In each share, every batch of texts gets a suffix array, in
the order of the suffixes' bytes; neighbours with LENGTH bytes in common are repeats. It is scanned against the arrays of
earlier batches, a later occurrence is noted for removal and leaves, and arrays of equal size are merged, so there are
never more arrays than the logarithm of the number of batches. A stored family does the same from call to call.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.operators.identity import global_rank

from .flat import BASE, BYTE, flat, mix, pieces, powers
from .ngram_join import _back, _cut, _narrow, _numbers, _wide
from .shared import arrow_rows, first_copies, groups, small, stored, trim, trimmed

LENGTH, GRAM = 100, 40
REACH = LENGTH - GRAM + 1
#: Bytes hashed at once (2 to the bits of a place), text of a piece, grams sent on together, suffixes of a batch.
PLACE_BITS = 19
PIECE, HELD, BATCH = 2_000_000, 500_000, 60_000
#: Live grams of a home whose text is cut out at once, and suffixes whose bytes are compared at once.
RUNS, STEP = 6_000, 20_000
MARK = 255
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        down = np.full(n, BACK, np.uint64)
        down[:1] = 1
        _powers.update(up=powers(n), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size bytes of data."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all strings of LENGTH bytes within a value, by the gram that each chooses: the value, the gram's hash, the first
    string's start in the value, how far the gram is from it, and how many more strings follow."""
    found = []
    step = (1 << PLACE_BITS) - LENGTH
    for s in range(0, max(0, len(data) - LENGTH + 1), step):
        own = data[s : s + step + LENGTH - 1]
        g = gram_hashes(own, GRAM)
        key = (g >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < REACH:
            key = np.minimum(key[: len(key) - (REACH - width)], key[REACH - width :])
        start = np.arange(len(key)) + s
        value = np.searchsorted(offsets, start, "right") - 1
        inside = start + LENGTH <= offsets[value + 1]
        start, value, key = start[inside], value[inside], key[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        place = (key[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        more = np.diff(first, append=len(start)) - 1
        found.append((value[first], g[place], start[first] - offsets[value[first]], place + s - start[first], more))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    # chosen grams have small hashes, so these are mixed once more before they are dealt out
    return ((mix(h) >> np.uint64(48)) * np.uint64(n) >> np.uint64(16)).astype(np.int32)


_GRAMS = "bucket int, hashes binary, ids binary, starts binary, near binary, more binary"


def _pack(bucket: int, h: np.ndarray, ids: np.ndarray, start: np.ndarray, near: np.ndarray, more: np.ndarray) -> tuple:
    return (bucket, _narrow(h, 6), _numbers(ids), start.astype("<u4").tobytes(), near.astype(np.uint8).tobytes(), more.astype(np.uint8).tobytes())


def _unpack(table: pa.Table) -> list[np.ndarray]:
    cols = [table.column(c).to_pylist() for c in ("hashes", "ids", "starts", "near", "more")]
    readers = (lambda x: _wide(x, 6), _back, lambda x: np.frombuffer(x, "<u4").astype(np.int64), lambda x: np.frombuffer(x, np.uint8), lambda x: np.frombuffer(x, np.uint8))
    return [np.concatenate([read(x) for x in c]) for read, c in zip(readers, cols, strict=True)]


def _send(n_buckets: int, n_homes: int):
    """Grams to the buckets of their hashes. Of grams that repeat here, one goes as a mark, and all go (buckets below 0) to their texts' homes."""

    def out(held: list) -> Iterator[pa.RecordBatch]:
        ids, h, start, near, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, h))
        ids, h, start, near, more = (x[order] for x in (ids, h, start, near, more))
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        last = np.r_[new[1:], True] if len(h) else new
        again = ~(new & last)
        home = np.where(again, ids % n_homes, 0)
        rows = []
        live = np.flatnonzero(again)
        live = live[np.argsort(home[live], kind="stable")]
        for a, b in _cut(home[live]):
            own = live[a:b]
            rows.append(_pack(-1 - int(home[own[0]]), h[own], ids[own], start[own], near[own], more[own]))
        near = np.where(again, MARK, near)
        sent = np.flatnonzero(new)
        bucket = _bucket(h[sent], n_buckets)
        order = np.argsort(bucket, kind="stable")  # ids rise within equal hashes only, so deltas may be negative
        sent, bucket = sent[order], bucket[order]
        for a, b in _cut(bucket):
            own = sent[a:b][np.argsort(ids[sent[a:b]], kind="stable")]
            rows.append(_pack(int(bucket[a]), h[own], ids[own], start[own], near[own], more[own]))
        yield _rows(_GRAMS, rows)

    def run(rows):
        held, count = [], 0
        for batch in rows:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column("text"))
            for a, b in pieces(offsets, PIECE):
                value, *rest = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((doc[a:b][value], *rest))
                count += len(value)
                if count >= HELD:
                    yield from out(held)
                    held, count = [], 0
        if count:
            yield from out(held)

    return trimmed(run)


_LIVE = "home int, ids binary, starts binary, near binary, more binary, bucket int, hashes binary"
#: Instead of a home: rows for the grams table of a stored family.
KEPT = -1


def _repeated(n_homes: int, keep: bool):
    """Of a bucket: the grams that occur twice, here or in earlier batches, to their texts' homes; so do earlier batches' grams that were alone until now.

    With keep also the bucket's row of the grams table: each gram once, with near MARK where it is alive already.
    """
    names = [x.split()[0] for x in _LIVE.split(", ")]

    def to_homes(ids, start, near, more):
        home = ids % n_homes
        order = np.lexsort((ids, home))
        ids, start, near, more, home = (x[order] for x in (ids, start, near, more, home))
        return [(int(home[a]), _numbers(ids[a:b]), start[a:b].astype("<u4").tobytes(), near[a:b].tobytes(), more[a:b].tobytes(), None, None) for a, b in _cut(home)]

    def run(key, table, before=None):
        bucket = key[0].as_py()
        if bucket < 0:
            many = table.num_rows
            return pa.table([pa.array([-1 - bucket] * many, pa.int32()), *(table.column(c) for c in ("ids", "starts", "near", "more")), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary())], names=names)
        if not table.num_rows:
            return pa.Table.from_batches([_rows(_LIVE, [])])
        h, ids, start, near, more = _unpack(table)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]))
        each = np.diff(first, append=len(h))
        n = np.empty(len(h), np.int64)
        n[order] = np.repeat(each, each)
        alive = n > 1
        alive[np.isin(h, h[near == MARK])] = True
        rows = []
        if before is not None and before.num_rows:
            oh, oi, os, on, om = _unpack(before)
            alive[np.isin(h, oh)] = True
            woken = np.isin(oh, h) & (on != MARK) & ~np.isin(oh, oh[on == MARK])
            rows += to_homes(oi[woken], os[woken], on[woken], om[woken])
        own = alive & (near != MARK)
        rows += to_homes(ids[own], start[own], near[own], more[own])
        if keep:
            at = order[first]
            rows.append((KEPT, _numbers(ids[at]), start[at].astype("<u4").tobytes(), np.where(alive[at], MARK, near[at]).astype(np.uint8).tobytes(), more[at].tobytes(), bucket, _narrow(h[at], 6)))
        return pa.Table.from_batches([_rows(_LIVE, rows)])

    return run if keep else lambda key, table: run(key, table)


class Suffixes:
    """A suffix array: texts, places and bytes of suffixes in the order of their first LENGTH bytes; key is the first eight of them as a number."""

    def __init__(self, ids, start, at, text, key=None):
        self.ids, self.start, self.at, self.text = ids, start, at, text
        if key is None:
            key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[at]).view(">u8").ravel().astype(np.uint64) if len(at) else np.empty(0, np.uint64)
        self.key = key

    def __len__(self):
        return len(self.at)

    def bytes_at(self, i) -> np.ndarray:
        """The first LENGTH bytes of suffixes, as values that compare as bytes do (all have one length)."""
        if not len(self.at[i]):
            return np.empty(0, f"S{LENGTH}")
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.at[i]]).view(f"S{LENGTH}").ravel()

    def keep(self, chosen: np.ndarray) -> Suffixes:
        return Suffixes(self.ids[chosen], self.start[chosen], self.at[chosen], self.text, self.key[chosen])

    def find(self, other: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Where other's suffixes belong in this array, and whether the suffix there begins with the same LENGTH bytes."""
        lo, hi = np.searchsorted(self.key, other.key, "left"), np.searchsorted(self.key, other.key, "right")
        for a in range(0, len(other), STEP):
            part = slice(a, a + STEP)
            left, right, asked = lo[part], hi[part], other.bytes_at(np.arange(a, min(a + STEP, len(other))))
            while len(on := np.flatnonzero(left < right)):
                mid = (left[on] + right[on]) // 2
                less = self.bytes_at(mid) < asked[on]
                left[on[less]], right[on[~less]] = mid[less] + 1, mid[~less]
        same = (lo < len(self)) & (lo < np.searchsorted(self.key, other.key, "right"))
        for a in range(0, len(other), STEP):
            own = a + np.flatnonzero(same[a : a + STEP])
            same[own] = self.bytes_at(lo[own]) == other.bytes_at(own)
        return lo, same


def merged(a: Suffixes, b: Suffixes) -> Suffixes:
    """Two arrays without a common suffix as one."""
    to_b = a.find(b)[0] + np.arange(len(b))
    to_a = np.setdiff1d(np.arange(len(a) + len(b)), to_b, assume_unique=True)

    def both(x, y):
        out = np.empty(len(x) + len(y), x.dtype)
        out[to_a], out[to_b] = x, y
        return out

    return Suffixes(both(a.ids, b.ids), both(a.start, b.start), both(a.at, b.at + len(a.text)), np.concatenate([a.text, b.text]), both(a.key, b.key))


def suffix_array(ids: np.ndarray, start: np.ndarray, more: np.ndarray, text: np.ndarray, note) -> Suffixes:
    """The array of a batch. Runs of more + 1 suffixes lie one after the other in text, each with LENGTH - 1 bytes after it.
    Suffixes that begin with the same LENGTH bytes as another stay with their first place; note gets the others."""
    n = more + 1
    base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids, start, at = np.repeat(ids, n), np.repeat(start, n) + inner, np.repeat(base, n) + inner
    order = np.lexsort((start, ids))
    x = Suffixes(ids[order], start[order], at[order], text)
    order = np.argsort(x.bytes_at(slice(None)), kind="stable")
    x = x.keep(order)
    # neighbours in the array with a common prefix of LENGTH bytes
    again = np.zeros(len(x), bool)
    for a in range(1, len(x), STEP):
        own = np.arange(a, min(a + STEP, len(x)))
        near = own[x.key[own] == x.key[own - 1]]
        again[near] = x.bytes_at(near) == x.bytes_at(near - 1)
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(x))))
    other = again & ((x.ids != x.ids[first]) | (x.start != x.start[first]))
    note(x.ids[other], x.start[other])
    return x.keep(~again)


class LevelFamily:
    """insert(array) scans it against all levels and adds it; levels of about equal size merge, each level at least doubling the next.

    older are levels of earlier batches: they are scanned too, and never change, as all that is in them comes before.
    """

    def __init__(self, note, older: list[Suffixes] | None = None):
        self.levels: list[Suffixes] = []
        self.older, self.note = older or [], note

    def insert(self, new: Suffixes) -> None:
        for level in (*self.older, *self.levels):
            i, same = level.find(new)
            j = np.flatnonzero(same)
            i = i[j]
            here = (new.ids[j] == level.ids[i]) & (new.start[j] == level.start[i])
            earlier = (new.ids[j] < level.ids[i]) | ((new.ids[j] == level.ids[i]) & (new.start[j] < level.start[i]))
            self.note(new.ids[j[~earlier & ~here]], new.start[j[~earlier & ~here]])
            i, k = i[earlier], j[earlier]  # the level's place becomes the repeat, and the new one the first
            self.note(level.ids[i], level.start[i])
            level.ids[i], level.start[i] = new.ids[k], new.start[k]
            new = new.keep(~same)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b))

    def whole(self) -> Suffixes | None:
        """All own levels as one."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b))
        return self.levels[0] if self.levels else None


class Notes:
    """Noted suffixes, turned to ranges of bytes."""

    def __init__(self):
        self.parts = []

    def __call__(self, ids: np.ndarray, start: np.ndarray) -> None:
        if len(ids):
            self.parts.append((ids.copy(), start.copy()))

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, begins and ends of the bytes that the noted suffixes' first LENGTH bytes cover, runs together."""
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        ids, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((start, ids))
        ids, start = ids[order], start[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + 1)]
        first = np.flatnonzero(new)
        return ids[first], start[first], start[np.r_[first[1:] - 1, len(ids) - 1]] + LENGTH


_SLICES = "bucket int, ids binary, starts binary, more binary, text binary"


def _range_rows(notes: Notes, n_homes: int) -> list[tuple]:
    ids, a, b = notes.ranges()
    home = ids % n_homes
    order = np.argsort(home, kind="stable")
    ids, a, b, home = ids[order], a[order], b[order], home[order]
    return [(-1 - int(home[x]), _numbers(ids[x:y]), a[x:y].astype("<i8").tobytes(), b[x:y].astype("<i8").tobytes(), None) for x, y in _cut(home)]


def _all_text(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a table's texts, with offsets of 64 bits from the start: a group may hold more than 2 GB."""
    return flat(texts.column("text").cast(pa.large_binary()).combine_chunks())


def _slices(n_buckets: int, n_homes: int):
    """Of the texts of a home, the bytes of live suffixes, to the buckets of their grams; repeats within the home are settled at once."""

    def run(key, texts, live):
        if not texts.num_rows or not live.num_rows:
            return pa.Table.from_batches([_rows(_SLICES, [])])
        data, offsets = _all_text(texts)
        doc = texts.column("doc_id").to_numpy()
        order = np.argsort(doc, kind="stable")
        cols = [live.column(c).to_pylist() for c in ("ids", "starts", "near", "more")]
        ids = np.concatenate([_back(x) for x in cols[0]])
        start = np.concatenate([np.frombuffer(x, "<u4") for x in cols[1]]).astype(np.int64)
        near, more = (np.concatenate([np.frombuffer(x, np.uint8) for x in c]).astype(np.int64) for c in cols[2:])
        base = offsets[:-1][order][np.searchsorted(doc[order], ids)]
        notes = Notes()
        rows = []
        for a in range(0, len(ids), RUNS):
            s = slice(a, a + RUNS)
            n = more[s] + LENGTH
            at = np.repeat(base[s] + start[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = data[at]
            array = suffix_array(ids[s], start[s], more[s], text, notes)
            # the runs that still have a suffix of their own, from its first to its last
            run_of = np.searchsorted(np.cumsum(n), array.at, "right")
            lo, hi = np.full(len(n), 1 << 40), np.full(len(n), -1)
            inner = array.at - (np.cumsum(n) - n)[run_of]
            np.minimum.at(lo, run_of, inner)
            np.maximum.at(hi, run_of, inner)
            left = np.flatnonzero(hi >= 0)
            gram = data[(base[s] + start[s] + near[s])[left][:, None] + np.arange(GRAM)]
            h = mix((BYTE[gram] * _power(GRAM + 1)[0][:-1]).sum(axis=1, dtype=np.uint64))
            bucket = _bucket(h, n_buckets)
            order_b = np.lexsort((ids[s][left], bucket))
            left, bucket = left[order_b], bucket[order_b]
            begin = base[s] + start[s] + lo
            for x, y in _cut(bucket):
                own = left[x:y]
                body = b"".join(data[p : p + w].tobytes() for p, w in zip(begin[own].tolist(), (hi[own] - lo[own] + LENGTH).tolist(), strict=True))
                rows.append((int(bucket[x]), _numbers(ids[s][own]), (start[s] + lo)[own].astype("<u4").tobytes(), (hi - lo)[own].astype(np.uint8).tobytes(), body))
        out = pa.Table.from_batches([_rows(_SLICES, rows + _range_rows(notes, n_homes))])
        rows.clear()
        trim()
        return out

    return run


_RANGES = "home int, ids binary, begins binary, ends binary, bucket int, text binary"
_LEVEL = "bucket int, ids binary, begins binary, ends binary, text binary"


def _level_row(x: Suffixes, bucket: int) -> tuple:
    return (bucket, _numbers(x.ids), x.start.astype("<i8").tobytes(), x.at.astype("<i8").tobytes(), x.text.tobytes())


def _levels(table: pa.Table) -> list[Suffixes]:
    """The stored arrays of a bucket."""
    rows = zip(*(table.column(c).to_pylist() for c in ("ids", "begins", "ends", "text")), strict=True)
    return [Suffixes(_back(i), np.frombuffer(a, "<i8").copy(), np.frombuffer(b, "<i8"), np.frombuffer(t, np.uint8)) for i, a, b, t in rows]


def _scan(n_homes: int, keep: bool):
    """Of a bucket: its batches go through the level family; out come the ranges of bytes to remove. Ranges found before pass.
    With keep also the bucket's array, for the stored family (home KEPT)."""

    def run(key, table, stored_levels=None):
        bucket = key[0].as_py()
        if bucket < 0:
            many = table.num_rows
            return pa.table([pa.array([-1 - bucket] * many, pa.int32()), *(table.column(c) for c in ("ids", "starts", "more")), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary())], names=[x.split()[0] for x in _RANGES.split(", ")])
        notes = Notes()
        family, held, count = LevelFamily(notes, _levels(stored_levels) if stored_levels is not None else None), [], 0

        def add():
            ids, start, more, text = (np.concatenate(x) for x in zip(*held, strict=True))
            family.insert(suffix_array(ids, start, more, text, notes))
            held.clear()

        for ids, start, more, text in zip(*(table.column(c).to_pylist() for c in ("ids", "starts", "more", "text")), strict=True):
            more = np.frombuffer(more, np.uint8).astype(np.int64)
            held.append((_back(ids), np.frombuffer(start, "<u4").astype(np.int64), more, np.frombuffer(text, np.uint8)))
            count += int(more.sum()) + len(more)
            if count >= BATCH:
                add()
                count = 0
        if held:
            add()
        rows = [(-1 - h, i, a, b, None, None) for h, i, a, b, _ in _range_rows(notes, n_homes)]
        if keep and (x := family.whole()) is not None and len(x):
            b, *level, text = _level_row(x, bucket)
            rows.append((KEPT, *level, b, text))
        family.levels.clear()
        trim()
        return pa.Table.from_batches([_rows(_RANGES, rows)])

    return run if keep else lambda key, table: run(key, table)


def _merge_levels(key, table):
    """The stored arrays of a bucket, two levels of them, as one."""
    out = None
    for x in _levels(table):
        out = x if out is None else merged(out, x)
    return pa.Table.from_batches([_rows(_LEVEL, [_level_row(out, key[0].as_py())])])


_STEP = "number int, n_buckets int, n_homes int, level string, suffixes long, bytes long, since int"


class StoredFamily:
    """Texts, grams and suffix arrays of earlier batches in a folder that all executors reach.

    Each batch adds its own tables. The newest table of steps names the level tables in use; a batch that fails before it
    leaves no trace in them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        steps = self.read("step=*", _STEP)
        last = [] if steps is None else steps.collect()  # a row for each level of each step: a logarithm of the batches each
        self.number = max((r.number for r in last), default=0)
        now = [r for r in last if r.number == self.number]
        self.n_homes = now[0].n_homes if now else None
        #: Bytes of text so far, and the batch since which grams count.
        self.bytes, self.since = (now[0].bytes, now[0].since) if now else (0, 1)
        self.levels = sorted(((r.level, r.suffixes) for r in now), key=lambda x: -x[1])

    def read(self, what: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}") if found is not None and len(found) else None

    def batches(self, what: str, schema: str, since: int = 1) -> DataFrame | None:
        """The tables of that name of all finished batches, or of those since one, as one."""
        names = [f"{k:06d}" for k in range(since, self.number + 1)]
        return self.read(f"{what}-{{{','.join(names)}}}", schema) if names else None

    def regroup(self) -> None:
        """From here on earlier grams and levels don't count: the batch under way makes both anew, of all texts."""
        self.levels, self.since = [], self.number + 1

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """A table of the batch under way; what an unfinished attempt at it has left is replaced."""
        path = f"{self.folder}/{what}-{self.number + 1:06d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, n_buckets: int, n_homes: int, level: str, suffixes: int, n_bytes: int) -> None:
        """Takes the batch's level in; levels of about equal size merge, bucket by bucket, each level at least doubling the next."""
        levels = [*self.levels, (level, suffixes)]
        while len(levels) > 1 and levels[-1][1] * 2 > levels[-2][1]:
            (b, n), (a, m) = levels.pop(), levels.pop()
            both = self.spark.read.schema(_LEVEL).parquet(a, b)
            path = f"{self.folder}/merged-{self.number + 1:06d}-{len(levels)}"
            both.groupBy("bucket").applyInArrow(_merge_levels, _LEVEL).write.mode("overwrite").parquet(path)
            levels.append((path, n + m))
        rows = [(self.number + 1, n_buckets, n_homes, path, n, self.bytes + n_bytes, self.since) for path, n in levels]
        self.spark.createDataFrame(rows, _STEP).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/step={self.number + 1}")


_RESULT = "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(with_text: bool):
    def run(key, texts, ranges):
        found: dict[int, list] = {}
        if ranges.num_rows:
            cols = [ranges.column(c).to_pylist() for c in ("ids", "begins", "ends")]
            ids = np.concatenate([_back(x) for x in cols[0]])
            a, b = (np.concatenate([np.frombuffer(x, "<i8") for x in c]) for c in cols[1:])
            order = np.lexsort((a, ids))
            ids, a, b = ids[order], a[order], b[order]
            for x, y in _cut(ids):
                found[int(ids[x])] = (a[x:y], np.maximum.accumulate(b[x:y]))
        rows = []
        data, offsets = _all_text(texts) if texts.num_rows else (None, None)
        for k, i in enumerate(texts.column("doc_id").to_pylist()):
            own, removed, spans = data[offsets[k] : offsets[k + 1]], 0, 0
            if i in found:
                a, b = found[i]
                new = np.r_[True, a[1:] > b[:-1]]
                first = np.flatnonzero(new)
                a, b = a[first], b[np.r_[first[1:] - 1, len(b) - 1]]
                gone = np.zeros(len(own) + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                own = own[np.cumsum(gone[:-1]) == 0]
                removed, spans = int((b - a).sum()), len(a)
            kept = own.tobytes()
            rows.append((i, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_batches([_rows(_RESULT, rows)])

    return run


def suffix_dedup(docs: DataFrame, with_text: bool = False, family: str | None = None) -> DataFrame:
    """Of each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also kept (the bytes left).

    Each byte that a string of 100 bytes covers goes, if the string also starts earlier: in a smaller doc_id, or before in
    the same text. Texts are their UTF-8 bytes; strings never cross texts and are judged on the input.

    family is a folder in which the suffix arrays of this batch are kept. A later call with it judges its docs against all
    batches before as well, as if all had been one table. Their doc_ids must be there, have one text each, and be above
    those of earlier batches (else ValueError). Once the texts of a family would fill more than twice the groups that it
    has, the call deals all of them to as many groups as they then need and makes grams and arrays anew, so no group grows
    with the family, and texts are dealt again only as often as they double. Without it, the arrays are gone after the call.

    Null, empty and short texts lose nothing. Of equal texts, which are settled by their digests at the start, the
    smallest doc_id counts as first and all others lose every byte; rows that repeat a doc_id and its text get that
    document's result each. If a doc_id is missing or has several texts, documents are ordered by doc_id (missing first),
    then by digest. An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("own_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    slim = stored(docs.select("own_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    total = slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    odd = slim.groupBy("own_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("own_id is null or a <> b")
    odd = odd.limit(1).count() > 0
    past = StoredFamily(spark, family) if family else None
    n_homes = 2 * groups(spark, total + (past.bytes if past else 0)) | 1
    regroup = bool(past and past.n_homes and n_homes > 2 * past.n_homes)
    if past and past.n_homes and not regroup:
        n_homes = past.n_homes
    n_buckets = n_homes - 1
    if odd and past:
        raise ValueError("a batch for a stored family needs a doc_id for each text")
    if odd:
        ids = stored(global_rank(slim.select("own_id", "digest").distinct(), [F.col("own_id").asc_nulls_first(), F.col("digest")], "doc_id").select(F.col("own_id").alias("_id"), F.col("digest").alias("_d"), F.col("doc_id").cast("long")), "ranks")
        on = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d"))
        docs, slim = (x.join(small(ids), on).drop("_id", "_d") for x in (docs, slim))
        slim = stored(slim, "texts")
    else:
        docs, slim = docs.withColumn("doc_id", F.col("own_id")), slim.withColumn("doc_id", F.col("own_id"))
    reps = first_copies(docs, slim.select("doc_id", "digest"), "digest").filter(F.octet_length("text") >= LENGTH)
    if slim.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        reps = reps.dropDuplicates(["doc_id"])
    known = None
    if past:
        known = past.batches("digests", "doc_id long, digest string")
        if known is not None:
            if (slim.agg(F.min("doc_id")).first()[0] or 1 << 62) <= known.agg(F.max("doc_id")).first()[0]:
                raise ValueError("doc_ids must rise from batch to batch")
            reps = reps.join(small(stored(known.select("digest").join(slim.select("digest"), "digest", "left_semi").distinct(), "known")), "digest", "left_anti")
    reps = reps.select("doc_id", "text")
    sent = reps.mapInArrow(_send(n_buckets, n_homes), _GRAMS)
    texts = reps
    levels = None
    if past:
        reps = texts = past.write(reps, "texts")
        old = past.batches("texts", "doc_id long, text string")
        if regroup:
            past.regroup()
            texts, old = reps.unionByName(old), None
        sent = stored(texts.mapInArrow(_send(n_buckets, n_homes), _GRAMS), "sent")
        grams = past.batches("grams", _GRAMS, past.since)
        if grams is None:
            grams = spark.createDataFrame([], _GRAMS)
        live = stored(sent.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(_repeated(n_homes, True), _LIVE), "live")
        past.write(live.filter(F.col("home") == KEPT).select("bucket", "hashes", "ids", "starts", "near", "more"), "grams")
        live = live.filter(F.col("home") != KEPT)
        if old is not None:  # of earlier batches, the texts that a gram of this one has woken
            woken = stored(live.mapInArrow(_ids, "doc_id long").distinct(), "woken")
            texts = reps.unionByName(old.join(small(woken), "doc_id", "left_semi"))
        levels = spark.read.schema(_LEVEL).parquet(*(path for path, _ in past.levels)) if past.levels else spark.createDataFrame([], _LEVEL)
    else:
        live = sent.groupBy("bucket").applyInArrow(_repeated(n_homes, False), _LIVE)
    # one exchange of the texts serves both uses
    by_home = lambda x: x.select("doc_id", "text", F.pmod("doc_id", F.lit(n_homes)).cast("int").alias("home")).groupBy("home")
    homes = by_home(texts)
    slices = homes.cogroup(live.drop("bucket", "hashes").groupBy("home")).applyInArrow(_slices(n_buckets, n_homes), _SLICES)
    if past:
        ranges = stored(slices.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_scan(n_homes, True), _RANGES), "ranges")
        level = past.write(ranges.filter(F.col("home") == KEPT).select("bucket", "ids", "begins", "ends", "text"), "level")
        suffixes = level.agg(F.coalesce(F.sum(F.octet_length("begins") / 8), F.lit(0)).cast("long")).first()[0]
        homes = by_home(reps)
    else:
        ranges = slices.groupBy("bucket").applyInArrow(_scan(n_homes, False), _RANGES)
    ranges = ranges.filter(F.col("home") != KEPT).drop("bucket", "text")
    result = homes.cogroup(ranges.groupBy("home")).applyInArrow(_remove(with_text), _RESULT)
    with arrow_rows(spark, 1_000):
        result = stored(result if with_text else result.drop("kept"), "removed")
    if past:
        past.write(slim.select("doc_id", "digest").distinct(), "digests")
        past.finish(n_buckets, n_homes, f"{past.folder}/level-{past.number + 1:06d}", suffixes, total)
    # stored before the join, so that a join by the digest of very many copies can be split
    all_ids = slim.select("doc_id", "digest") if known is None else slim.select("doc_id", "digest").unionByName(known)
    first = all_ids.groupBy("digest").agg(F.min("doc_id").alias("_first")).join(result.withColumnRenamed("doc_id", "_first"), "_first", "left")
    out = slim.join(small(stored(first, "classes")), "digest")
    own = F.col("doc_id") == F.col("_first")
    long = F.col("n_bytes") >= LENGTH
    cols = [
        F.when(~long, 0).when(own, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(~long, 0).when(own, F.col("n_spans")).otherwise(1).cast("long").alias("n_spans"),
        F.when(~long, F.col("digest")).when(own, F.col("kept_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(own & long, F.col("kept")).alias("kept"))
    return out.select(F.col("own_id").alias("doc_id"), "n_bytes", *cols)


def _ids(rows):
    for batch in rows:
        for x in batch.column("ids").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_back(x)))], names=["doc_id"])
