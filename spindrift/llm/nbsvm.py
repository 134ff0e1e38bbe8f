"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: of bytes (three and four) and of words (one
and two, with a mark for a word that repeats the one before), hashed to
``2**BITS`` places. Each is scaled by its class log-count ratio, rows are
scaled to length one, and a linear model with hinge loss is fitted by dual
coordinate descent and drawn towards the mean weight. A logistic curve
over margins of texts left out of the fit (two halves, crossed) gives the
score, with the intercept shifted to the labels' true shares.

Training takes at most ``per_class`` labelled texts of each class and
``sample_bytes`` in all, in the order of a hash of the id, texts of over
``long_bytes`` only where a class has too few others: a bound that does not grow
with the table. All texts are scored whole. Without a labelled text of
each class the score is the share of good labels.

Null text: empty, without features. Null or repeated ids are scored row by
row; of a document with several labels, good wins. Null labels are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructType

from spindrift.llm.shared import Words, labelled_sample, mix64, remainder, text_chunks

BITS = 18
PER_CLASS, SAMPLE_BYTES, LONG_BYTES = 1_200, 8 << 20, 128 << 10
SMOOTH, COST, EPOCHS, KEEP = 1.0, 1.0, 15, 0.75
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


class Grams:
    """Distinct hashed n-grams of the texts of a chunk, one text at a time."""

    def __init__(self) -> None:
        self.mark = np.zeros(1 << BITS, dtype=np.int32)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words = Words(data, offsets)
        hashes = words.hashes()
        pair = np.zeros(0, np.uint64)
        if len(hashes) > 1:
            pair = np.where(hashes[1:] == hashes[:-1], _SALT[3], mix64(hashes[:-1] * _SALT[2] + hashes[1:]))
        wide = data.astype(np.uint64)
        three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16) if len(wide) > 2 else np.zeros(0, np.uint64)
        four = three[:-1] | wide[3:] << np.uint64(24) if len(wide) > 3 else np.zeros(0, np.uint64)
        three, four = _places(three * _SALT[0]), _places(mix64(four + _SALT[1]))
        one, two = _places(mix64(hashes + _SALT[2])), _places(mix64(pair + _SALT[3]))
        for i in range(len(offsets) - 1):
            a, b, c, d = offsets[i], offsets[i + 1], words.first[i], words.first[i + 1]
            every = np.concatenate([three[a : max(a, b - 2)], four[a : max(a, b - 3)], one[c:d], two[c : max(c, d - 1)]])
            n = np.arange(len(every), dtype=np.int32)
            self.mark[every] = n
            yield every[self.mark[every] == n]


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each place."""
    counts = [np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias): hinge loss by dual coordinate descent over sparse rows (places, values); a row's dual lies from 0 to its cost."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[at] += step * sign[i] * v
                bias += step * sign[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


class Model:
    """Weight of each place (ratio and support-vector weight multiplied), bias, logistic curve."""

    def __init__(self, ratio: np.ndarray | None, weight: np.ndarray | None, bias: float, slope: float, level: float):
        self.ratio, self.weight, self.bias, self.slope, self.level = ratio, weight, bias, slope, level

    def margins(self, rows: Iterator[np.ndarray] | list[np.ndarray]) -> np.ndarray:
        out = []
        for x in rows:
            length = math.sqrt(float(np.square(self.ratio[x]).sum())) or 1.0
            out.append(float(self.weight[x].sum()) / length + self.bias)
        return np.array(out)

    def score(self, column: pa.Array, grams: Grams) -> np.ndarray:
        if self.ratio is None:
            return np.full(len(column), 1 / (1 + math.exp(-self.level)))
        out = [np.zeros(0)]
        for _, _, data, offsets in text_chunks(column, 1 << 20):
            out.append(self.margins(grams.texts(data, offsets)))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(out) + self.level, -30, 30)))


def _fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = ratios(rows, y).astype(np.float32)
    scaled = []
    for x in rows:
        v = ratio[x]
        scaled.append((x, v / (np.linalg.norm(v) or 1.0)))
    n = np.bincount(y.astype(int), minlength=2)
    cost = COST * len(y) / (2 * n[y.astype(int)])
    w, bias = descend(scaled, 2 * y - 1, 1 << BITS, cost)
    mean = np.abs(w).mean()
    w = KEEP * w + (1 - KEEP) * mean
    return Model(ratio, (w * ratio).astype(np.float32), bias, 1.0, 0.0)


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve, by Newton's method with a weak ridge."""
    x, w = np.stack([m, np.ones(len(m))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(texts: list[bytes], labels: list[int], share: float | None = None) -> Model:
    """Fit on texts and their labels; ``share``: true share of label 1 (default: that of the sample)."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        rate = ((y.sum() if share is None else share * len(y)) + 0.5) / (len(y) + 1)
        return Model(None, None, 0.0, 0.0, math.log(rate / (1 - rate)))
    grams, rows = Grams(), []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.binary()), 1 << 20):
        rows += list(grams.texts(data, offsets))
    half = np.arange(len(y)) % 2 == 1
    left_out = np.zeros(len(y))
    if all(0 < y[h].sum() < h.sum() for h in (half, ~half)):
        for h in (half, ~half):
            model = _fit([rows[i] for i in np.flatnonzero(h)], y[h])
            left_out[~h] = model.margins([rows[i] for i in np.flatnonzero(~h)])
        model = _fit(rows, y)
    else:
        model = _fit(rows, y)
        left_out = model.margins(rows)
    model.slope, model.level = _curve(left_out, y)
    if share is not None and 0 < share < 1:
        model.level += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, long_bytes: int = LONG_BYTES) -> Model:
    """Train on a bounded sample of labelled texts whose crc32(id) mod 4 is not 2."""
    rows, share = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, sample_bytes, long_bytes)
    return train([t for t, _ in rows], [y for _, y in rows], share)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Columns: id, held_out, score, predicted."""
    docs = docs.select(id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams = shipped.value, Grams()
        for batch in batches:
            found = own.score(batch.column(1), grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    schema = StructType([docs.schema[id_col]]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(run, schema).select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "score", "predicted")
