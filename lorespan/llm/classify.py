"""What the classifiers share: folds, bounded training samples, and scoring of whole texts in batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import flat, pieces
from .shared import trimmed

#: Bytes of text, and texts, turned to features at once.
PIECE, TEXTS = 1_000_000, 2_000


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of doc_id as text (null: as empty text), modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def known_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and y of the rows from which labels may be learnt. Of several labels of a doc_id the largest counts; nulls none."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def some(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, those whose hash of doc_id is least: the same on each run, and spread over all rows."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def features(docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """schema's columns for each row of docs(doc_id, text): doc_id, and what make(data, offsets) gives for a piece of texts. A column text_digest of docs passes."""
    passed = [c for c in ("text_digest",) if c in docs.columns]
    names = [x.split()[0] for x in schema.split(", ")] + passed

    def run(rows):
        for batch in rows:
            ids = batch.column("doc_id")
            data, offsets = flat(batch.column("text"))
            for a, b in ((k, min(k + TEXTS, b)) for a, b in pieces(offsets, PIECE) for k in range(a, b, TEXTS)):
                out = make(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *out, *(batch.column(c).slice(a, b - a) for c in passed)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", *passed).mapInArrow(trimmed(run), schema + "".join(f", {c} string" for c in passed))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], folds: int, held_out: int, at_least: float) -> DataFrame:
    """doc_id, held_out, score, predicted (and text_digest, if docs has it) of each row of docs."""
    rows = features(docs, lambda data, offsets: [pa.array(np.clip(score(data, offsets), 0, 1).astype(np.float64))], "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"), *rows.columns[2:])
