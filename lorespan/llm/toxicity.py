"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any texts, unlabelled, are the rest. With the class prior p, the risk of a
linear classifier g is p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)]): the second term is the
negatives' risk, which cannot be negative, and where a batch makes it so its step is turned round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import features, fold, known_labels, scored, some
from .flat import BYTE, mix, powers, words_at

#: Bits of the table that turns features away.
BITS = 18
#: Bytes from a word's start that are features besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: Bounds of the training sample, and features kept.
N_POSITIVE, N_UNLABELLED, N_FEATURES = 4_000, 10_000, 4_096
#: Positive texts, and their share, that must hold a feature, and standard errors by which it must stand out.
LEAST_TEXTS, LEAST_SHARE, LEAST_ERRORS = 3, 0.004, 8
STEEPER = 2.5
FOLDS, HELD_OUT, AT_LEAST = 4, 2, 0.3

_TABLE = np.where([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], BYTE, np.uint64(0))
_TABLE[65:91] = BYTE[97:123]


class Chosen:
    """Chosen features and their weights. A table of bits turns most other features away before the exact look-up."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[features & ((1 << BITS) - 1)] = True

    def find(self, f: np.ndarray) -> np.ndarray:
        """The column of each feature, or -1."""
        out = np.full(len(f), -1)
        on = np.flatnonzero(self.bits[f & ((1 << BITS) - 1)])
        at = np.minimum(np.searchsorted(self.features, f[on]), len(self.features) - 1)
        same = self.features[at] == f[on]
        out[on[same]] = at[same]
        return out


def word_features(data: np.ndarray, offsets: np.ndarray, chosen: Chosen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Value and feature (a hash) of each word and of its beginnings, distinct within a value, by value; with chosen, those alone, as columns."""
    starts = words_at(data, offsets, _TABLE != 0)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.searchsorted(offsets, starts, "right") - 1
    own = _TABLE[data]
    inside = own != 0
    gaps = np.r_[np.flatnonzero(~inside), len(data)]
    ends = np.minimum(gaps[np.searchsorted(gaps, starts)], offsets[value + 1])
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    sums = np.r_[np.uint64(0), np.cumsum(own * powers(int(place.max()) + 1)[place])]
    values, found = [], []
    for k in (*PREFIXES, None):
        long = slice(None) if k is None else ends - starts > k
        a, b = starts[long], ends[long] if k is None else starts[long] + k
        f = (mix((sums[b] - sums[a]) ^ BYTE[k or 0]) >> np.uint64(1)).astype(np.int64)
        own_values = value[long]
        if chosen is not None:
            f = chosen.find(f)
            own_values, f = own_values[f >= 0], f[f >= 0]
        values.append(own_values)
        found.append(f)
    value, f = np.concatenate(values), np.concatenate(found)
    order = np.lexsort((f, value))
    value, f = value[order], f[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (f[1:] != f[:-1])] if len(f) else np.empty(0, bool)
    return value[new], f[new]


def _lists(data, offsets):
    value, f = word_features(data, offsets)
    at = np.searchsorted(value, np.arange(len(offsets)))
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f, pa.int64()))]


def nnpu_step(sets: list[tuple], owns: list[np.ndarray], w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray]:
    """The risk of the linear classifier (w, b) with logistic loss over parts of the positive and the unlabelled texts, and the step (of w, then b) against it.

    sets has (number of texts, rows, columns) of both kinds, owns the texts that take part. Where the negatives' risk is
    below 0, the risk leaves it out, and the step is the way that raises it again.
    """
    found = []
    for (n, row, col), own in zip(sets, owns, strict=True):
        on, many = own[row], max(1, own.sum())
        g = np.bincount(row, w[col], minlength=n) + b
        s = 1 / (1 + np.exp(-g))
        slope = lambda d: np.r_[np.bincount(col[on], d[row[on]], minlength=len(w)), d[own].sum()] / many  # noqa: B023, E731
        found.append((slope(s - 1), slope(s), np.logaddexp(0, -g)[own].sum() / many, np.logaddexp(0, g)[own].sum() / many))
    (pos_up, pos_down, as_positive, pos_loss), (_, unl_down, _, unl_loss) = found
    down, negatives = unl_down - prior * pos_down, unl_loss - prior * pos_loss
    return prior * as_positive + max(0.0, negatives), prior * pos_up + down if negatives >= 0 else -down


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 150, rate: float = 0.05, seed: int = 1) -> Chosen:
    """Weights of the chosen features, none below 0, and the bias. Each text is its distinct features."""
    names, n_pos = np.unique(np.concatenate(positive), return_counts=True)
    often = n_pos >= max(LEAST_TEXTS, LEAST_SHARE * len(positive))
    names, n_pos = names[often], n_pos[often]
    start = Chosen(names, np.zeros(len(names)), 0.0)
    n_unl = np.zeros(len(names))
    if len(names):
        for x in unlabelled:
            col = start.find(x)
            n_unl[col[col >= 0]] += 1
    p, u = n_pos / len(positive), n_unl / len(unlabelled)
    # how far the positives' share is from the share in all texts, in standard errors
    z = (p - u) / np.sqrt((u + 1 / len(unlabelled)) * (1 / len(positive) + 1 / len(unlabelled)))
    best = np.argsort(-z, kind="stable")[:N_FEATURES]
    best = np.sort(best[z[best] > LEAST_ERRORS])
    chosen = Chosen(names[best], np.zeros(len(best)), float(np.log(prior / (1 - prior))))
    if not len(best):
        return chosen

    def pairs(texts):
        col = chosen.find(np.concatenate(texts))
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return row[col >= 0], col[col >= 0]

    sets = [(len(x), *pairs(x)) for x in (positive, unlabelled)]
    w, b = np.zeros(len(best)), -2.0
    m, v = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    rng = np.random.default_rng(seed)
    t, parts = 0, 8
    for _ in range(rounds):
        shares = [rng.integers(0, parts, n) for n, _, _ in sets]
        for k in range(parts):
            _, step = nnpu_step(sets, [share == k for share in shares], w, b, prior)
            step[:-1] += 1e-5 * w
            t += 1
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    # the risk flattens scores where it was held at 0: steeper ones, shifted until their mean over all texts is the prior
    n, row, col = sets[1]
    g, w = STEEPER * np.bincount(row, w[col], minlength=n), STEEPER * w
    low, high = -50.0, 50.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if (1 / (1 + np.exp(-np.clip(g + b, -500, 500)))).mean() > prior else (b, high)
    return Chosen(chosen.features[w > 0], w[w > 0], b)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each row of docs(doc_id, text): doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 from a score of 0.3).

    Learns from labels(doc_id, toxic) outside the held-out fold: at most N_POSITIVE toxic texts, and at most N_UNLABELLED
    texts of any kind outside that fold; the class prior is the share of toxic among all labels outside it. Only the text
    is an input. Every whole text is scored.

    Null and empty texts have no features and get the score of the bias. Null labels don't count; without any toxic label
    all scores are 0. Repeated rows and rows without doc_id are scored each (an empty id decides the fold). An empty
    table gives an empty result; other columns are left out.
    """
    known = known_labels(labels, "toxic", FOLDS, HELD_OUT)
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    docs = docs.select("doc_id", "text")
    if prior > 0:
        ids = some(known.filter("y = 1"), N_POSITIVE).select("doc_id")
        pool = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
        any_ids = some(pool.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).distinct(), N_UNLABELLED).select("doc_id")
        sample = ids.withColumn("kind", F.lit(1)).unionByName(any_ids.withColumn("kind", F.lit(0))).groupBy("doc_id").agg(F.max("kind").alias("pos"), F.min("kind").alias("unl"))
        texts = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
        rows = features(texts, _lists, "doc_id long, f array<long>").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()  # bounded by the sample
        f = [np.asarray(x, np.int64) for x in rows.column("f").to_numpy()]
        pos = [x for x, y in zip(f, rows.column("pos").to_pylist(), strict=True) if y == 1]
        unl = [x for x, y in zip(f, rows.column("unl").to_pylist(), strict=True) if y == 0]
    if not prior or not pos or not unl:
        return scored(docs, lambda data, offsets: np.zeros(len(offsets) - 1), FOLDS, HELD_OUT, AT_LEAST)
    shared = docs.sparkSession.sparkContext.broadcast(train_nnpu(pos, unl, min(prior, 0.99)))

    def score(data, offsets):
        model = shared.value
        if not len(model.features):
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-model.bias)))
        value, f = word_features(data, offsets, model)
        g = np.bincount(value, model.weights[f], minlength=len(offsets) - 1) + model.bias
        return 1 / (1 + np.exp(-np.clip(g, -500, 500)))

    return scored(docs, score, FOLDS, HELD_OUT, AT_LEAST)
