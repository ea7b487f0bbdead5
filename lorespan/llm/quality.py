"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words and pairs of words (hashed to buckets), the shapes of its words (runs of letters, digits and
signs), pairs of shapes, and how often words repeat. Labelled texts give the terms' weights and, by a singular value
decomposition, the latent space. Labelled vectors are broadcast (their number is bounded); every document's cosines with
all of them are one product per block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import features, known_labels, scored, some
from .flat import BYTE, mix, word_hashes

#: Buckets of each kind of terms: shapes, pairs of shapes, words, pairs of words, and three of repetition.
KINDS = (512, 512, 1024, 512, 3)
SHAPES, PAIRS, WORDS, WORD_PAIRS, REPEATS = KINDS
STARTS = np.cumsum([0, *KINDS])
TERMS = int(STARTS[-1])
#: Bound of the labelled sample for each label, latent dimensions, neighbours that vote.
N_EACH, DIMENSIONS, NEIGHBOURS = 2_000, 48, 15
FOLDS, HELD_OUT, AT_LEAST = 5, 0, 0.3
#: Documents whose cosines are computed at once.
BLOCK = 512

_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")
_KIND[[0x20, *range(0x09, 0x0E)]] = ord(" ")
_SHAPE_BYTE = BYTE.copy()
_SHAPE_BYTE[ord(" ")] = 0


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative frequencies of TERMS terms of each value."""
    n = len(offsets) - 1
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][offsets[:-1] < len(kind)]] = True
    short = np.r_[0, np.cumsum(keep)][offsets]
    shapes, at = word_hashes(kind[keep], short, _SHAPE_BYTE)
    shape_owner = np.repeat(np.arange(n), np.diff(at))
    words, at = word_hashes(data, offsets)
    many = np.diff(at)
    owner = np.repeat(np.arange(n), many)
    cells = []

    def add(k: int, own: np.ndarray, h: np.ndarray) -> None:
        cells.append(own * TERMS + int(STARTS[k]) + (h % np.uint64(KINDS[k])).astype(np.int64))

    def pairs(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = own[:-1] == own[1:]
        return own[:-1][inside], mix(h[:-1] * np.uint64(3) + h[1:])[inside]

    add(0, shape_owner, shapes)
    add(1, *pairs(shape_owner, shapes))
    add(2, owner, words)
    add(3, *pairs(owner, words))
    out = np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    for back in (1, 2):
        same = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
        out[:, STARTS[4] + back - 1] = np.bincount(owner[back:][same], minlength=n)
    order = np.lexsort((words, owner))
    again = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out[:, TERMS - 1] = np.bincount(owner[order][1:][again], minlength=n)
    return out / np.maximum(many, 1).astype(np.float32)[:, None]


def main_axes(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of v of the k greatest singular values, by subspace iteration from a fixed start."""
    k = min(k, *v.shape)
    q = np.random.default_rng(1).standard_normal((v.shape[1], min(k + 16, v.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(v.T @ (v @ q))
    _, _, axes = np.linalg.svd(v @ q, full_matrices=False)
    return (q @ axes.T)[:, :k]


class LatentVotes:
    """Fitted to labelled term vectors, in the order in which ties are settled; score(terms) votes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(y.mean()) if len(y) else 0.0
        seen = (x > 0).mean(axis=0)
        self.weight = np.where(seen > 0, np.log((1 + 1e-3) / (seen + 1e-3)) + 1, 0).astype(np.float32)
        v = np.sqrt(x)
        v *= self.weight
        self.mean = v.mean(axis=0)
        v -= self.mean
        # no kind of terms may drown the others: each is scaled to a greatest singular value of 1
        scale = np.ones(TERMS, np.float32)
        for a, b in zip(STARTS[:-1], STARTS[1:], strict=True):
            top = np.linalg.norm(v[:, a:b] @ main_axes(v[:, a:b], 1))
            scale[a:b] = 1 / top if top > 1e-9 else 0
        v *= scale
        self.weight, self.mean = self.weight * scale, self.mean * scale
        self.axes = main_axes(v, DIMENSIONS)
        self.known, self.y = self.unit(v @ self.axes), y.astype(np.float32)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.unit((np.sqrt(x) * self.weight - self.mean) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The neighbours' labels, weighted by cosine (to six digits; below 0 counts as 0). Of equally near ones the first in order votes."""
        out = np.empty(len(x))
        n = len(self.y)
        k = min(NEIGHBOURS, n)
        for a in range(0, len(x), BLOCK):
            cos = np.rint((self.latent(x[a : a + BLOCK]) @ self.known.T) * 1e6).astype(np.int64)
            near = np.argpartition(-(cos * n + np.arange(n - 1, -1, -1)), k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cos, near, axis=1), 0) / 1e6 + 1e-6
            out[a : a + BLOCK] = (vote * self.y[near]).sum(axis=1) / vote.sum(axis=1)
        out[x.sum(axis=1) == 0] = self.base
        return out


def _packed(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [pa.array([zlib.compress(r.tobytes(), 1) for r in terms(data, offsets)], pa.binary())]


def quality(docs: DataFrame, labels: DataFrame, digests: bool = False) -> DataFrame:
    """Of each row of docs(doc_id, text): doc_id, held_out, score (0 to 1, higher: likelier good), predicted (1 from a score of 0.3); with digests also text_digest.

    Learns from labels(doc_id, quality) outside the held-out fold: at most N_EACH texts of each label fix term weights,
    latent space and voters. Only the text is an input. Every whole text is scored.

    Null, empty and blank texts have no terms and get the voters' mean label. Null labels don't count; without any label
    all scores are 0. Of voters with equal cosines, to six digits, the smallest doc_id votes. A doc_id that labelled rows
    repeat votes once, with any of its texts. Repeated rows and rows without doc_id are scored each (an empty id decides
    the fold). An empty table gives an empty result; other columns are left out.
    """
    docs = docs.select("doc_id", "text")
    known = known_labels(labels, "quality", FOLDS, HELD_OUT)
    sample = some(known.filter("y = 1"), N_EACH).unionByName(some(known.filter("y = 0"), N_EACH))
    texts = docs.join(F.broadcast(sample), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = features(texts, _packed, "doc_id long, x binary").join(F.broadcast(sample), "doc_id").orderBy("doc_id").toArrow()  # bounded by the sample
    if digests:
        docs = docs.withColumn("text_digest", F.md5(F.coalesce("text", F.lit(""))))
    if not rows.num_rows:
        return scored(docs, lambda data, offsets: np.zeros(len(offsets) - 1), FOLDS, HELD_OUT, AT_LEAST)
    x = np.empty((rows.num_rows, TERMS), np.float32)
    for k, b in enumerate(rows.column("x")):
        x[k] = np.frombuffer(zlib.decompress(b.as_py()), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(LatentVotes(x, rows.column("y").to_numpy()))
    return scored(docs, lambda data, offsets: shared.value.score(terms(data, offsets)), FOLDS, HELD_OUT, AT_LEAST)
