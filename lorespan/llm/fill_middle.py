"""Fill-in-middle by secondary sort: pieces of documents, keyed by document and place in the output, stream into digests."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups

#: The marks before prefix, suffix and middle, by the place of what they mark in the text.
MARKS = {"P": "<P>", "M": "<M>", "S": "<S>"}
PLACE = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
ORDER = {"psm": "PSM", "spm": "SPM"}
#: Characters of a piece: whole units as long as they fit, or a part of a longer unit.
PIECE = 32_768
#: Documents of a task of which repeats are counted together.
COUNTED = 100_000
#: Places of what isn't text: what is known of a document, and how many rows of a task repeat it.
HEAD, COPIES = -1, 1 << 62


def _home(key: tuple[bytes, int]) -> int:
    """Where a document's pieces go: by the digest alone, so that every order of them has one partitioner."""
    return int.from_bytes(key[0][:7], "big")


def unit_ends(text: str) -> list[int]:
    """Where the units (lines with their ends) of text end."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return ends if not text or ends[-1:] == [len(text)] else [*ends, len(text)]


def plan(doc_id: int | None, text: str, ends: list[int], rate: int, spm: int, seed: int) -> tuple[str, int, int]:
    """Form, and where prefix and middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= rate:
        return "plain", 0, 0
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return "spm" if h4 % 100 < spm else "psm", ends[a - 1] if a else 0, ends[b - 1] if b else 0


def cut(text: str, ends: list[int], start: int, stop: int) -> Iterator[str]:
    """text[start:stop] in pieces."""
    while start < stop:
        at = stop
        if stop - start > PIECE:
            k = bisect_right(ends, start + PIECE)
            at = ends[k - 1] if k and ends[k - 1] > start else start + PIECE
        yield text[start:at]
        start = at


def _emit(split: int, rows, rate: int, spm: int, seed: int):
    """((digest, place in the output), piece) of each document, its head, and its number of copies in this task where that isn't one.

    The digest is that of doc_id and text, with the task's number, so an attempt that runs again makes the same keys, and
    very many copies of one row are sent once from each task.
    """
    seen: dict[bytes, int] = {}
    turn = 0
    for row in rows:
        text = row["text"] or ""
        data = text.encode()
        key = hashlib.blake2b(f"{split}:{turn}:{row['doc_id']}:".encode() + data, digest_size=16).digest()
        seen[key] = seen.get(key, 0) + 1
        if seen[key] > 1:
            continue
        ends = unit_ends(text)
        form, a, b = plan(row["doc_id"], text, ends, rate, spm, seed)
        plain = form == "plain"
        yield (key, HEAD), (row["doc_id"], len(ends), form, None if plain else a, None if plain else b - a)
        spans = {"P": (0, a), "M": (a, b), "S": (b, len(text))}
        pieces = cut(text, ends, 0, len(text)) if plain else (x for part in ORDER[form] for x in (MARKS[part], *cut(text, ends, *spans[part])))
        for place, piece in enumerate(pieces):
            yield (key, place), zlib.compress(piece.encode(), 1)
        if len(seen) >= COUNTED:
            yield from (((k, COPIES), n) for k, n in seen.items() if n > 1)
            seen, turn = {}, turn + 1
    yield from (((k, COPIES), n) for k, n in seen.items() if n > 1)


def _assembled(records, texts: bool):
    """Pieces in the order of the output pass through its digest and leave keyed by their place in the text, which follows from the marks alone."""
    for key, own in groupby(records, lambda r: r[0][0]):
        digest, head, whole, part, k = hashlib.sha256(), None, [], 0, 0
        for (_, place), value in own:
            if place == HEAD:
                head = value
            elif place == COPIES:
                yield (key, COPIES), value
            else:
                data = zlib.decompress(value)
                digest.update(data)
                if texts:
                    whole.append(data)
                if head[2] != "plain" and data in PLACE:
                    part, k = PLACE[data], 0
                else:
                    yield (key, (part << 40) + k), value
                    k += 1
        yield (key, HEAD), (*head, digest.hexdigest(), *([b"".join(whole).decode()] if texts else []))


def _restored(records, texts: bool):
    """Pieces in the order of the text pass through its digest: the head, the digest, and the text if wanted, once for each copy."""
    for _, own in groupby(records, lambda r: r[0][0]):
        digest, head, whole, n = hashlib.sha256(), None, [], 1
        for (_, place), value in own:
            if place == HEAD:
                head = value
            elif place == COPIES:
                n = value
            else:
                data = zlib.decompress(value)
                digest.update(data)
                if texts:
                    whole.append(data)
        row = (*head, digest.hexdigest(), *([b"".join(whole).decode()] if texts else []))
        for _ in range(n):
            yield row


def _homes(docs: DataFrame, text: str) -> int:
    return groups(docs.sparkSession, docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def fill_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, texts: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of docs(doc_id, text); with texts also output and restored.

    Each text is cut into lines; two hashes of the doc_id choose where prefix and middle end. rate percent of the documents
    are rearranged (psm: prefix, suffix, middle; spm: suffix first, for spm percent of them), each part after its mark.

    Pieces of whole lines travel once, keyed by document and place in the output. repartitionAndSortWithinPartitions
    streams them in that order into an incremental digest; then they are sorted anew by their place in the text, which
    the marks tell, and stream into the digest of the restored text. Both orders have one partitioner, so the second
    sort moves nothing between tasks. A task holds one piece at a time besides what it sorts, and Spark's sort spills.

    Null and empty text: plain, no units, the digest of nothing. Texts that hold a mark stay plain. A null doc_id hashes
    as an empty one. Repeated rows and rows of one doc_id keep a row each. An empty table gives an empty one; other
    columns are left out. Very long lines are cut inside, and very long texts pass through piece by piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = _homes(rows, "text")
    pieces = rows.rdd.mapPartitionsWithIndex(lambda i, it: _emit(i, it, rate, spm, seed))
    output = pieces.repartitionAndSortWithinPartitions(n, _home).mapPartitions(lambda it: _assembled(it, texts), preservesPartitioning=True)
    restored = output.repartitionAndSortWithinPartitions(n, _home).mapPartitions(lambda it: _restored(it, texts))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    if texts:
        restored = restored.map(lambda r: (*r[:6], r[7], r[6], r[8]))
        schema += ", output string, restored string"
    return docs.sparkSession.createDataFrame(restored, schema, verifySchema=False)


def _parse(split: int, rows):
    """((digest, place in the text), piece) of outputs. Rows that are alike have keys of their own, by their number in the task."""
    seen: dict[bytes, int] = {}
    for row in rows:
        text, form = row["output"] or "", row["form"]
        same = hashlib.blake2b(f"{row['doc_id']}:{form}:{text}".encode(), digest_size=16).digest()
        seen[same] = seen.get(same, 0) + 1
        key = hashlib.blake2b(f"{split}:{seen[same]}:".encode() + same, digest_size=16).digest()
        parts = re.split("<([PSM])>", text) if form in ORDER else ["", "P", text]
        whole = form not in ORDER or "".join(parts[1::2]) == ORDER[form] and not parts[0]
        yield (key, HEAD), (row["doc_id"], whole)
        for name, part in zip(parts[1::2], parts[2::2], strict=True) if whole else ():
            for k, piece in enumerate(cut(part, unit_ends(part), 0, len(part))):
                yield (key, ("PMS".index(name) << 40) + k), zlib.compress(piece.encode(), 1)


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id, restored_sha256 and text of outputs(doc_id, form, output), by the same sort of pieces.

    An output of form psm or spm without the three marks in their order has neither digest nor text. Null output counts as
    empty. Rows that are alike in all three columns keep a row each.
    """
    rows = outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output")
    pieces = rows.rdd.mapPartitionsWithIndex(_parse)
    sorted_ = pieces.repartitionAndSortWithinPartitions(_homes(rows, "output"), _home)
    found = sorted_.mapPartitions(lambda it: _restored(it, True)).map(lambda r: (r[0], r[2], r[3]) if r[1] else (r[0], None, None))
    return outputs.sparkSession.createDataFrame(found, "doc_id long, restored_sha256 string, text string", verifySchema=False)
