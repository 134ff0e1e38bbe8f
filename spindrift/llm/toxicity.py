"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text,
both by zstandard's cover trainer. The ordinary one is trained on the words of
ordinary labelled texts, up to ``BASE_BYTES``. The toxic one is trained on what the
toxic texts have and ordinary ones have not: each text gives its segments (starts
of words and whole words) that stand in significantly more toxic texts, by the
likelihood ratio; its size is that of all such segments, so that none is left out. It is laid behind
the ordinary one, so that text common to both classes costs the same under
either. Trained on whole texts, or laid apart, the dictionaries tell less (the
README has figures): a toxic word is a few bytes among hundreds of others.

A window is a word with the blanks around it: wider ones drown a short match in
the noise of their neighbours (measured on the labelled table). Each byte is
spread to ``WIDTH`` bytes before compression, so that a match outweighs the cost of its
encoding. A window's distance is its compressed length under the ordinary
dictionary less that under the toxic one; equal windows are compressed once. A
calibrated threshold turns distances into hits, and a logistic curve fitted on
the training texts turns hits and windows into a score from 0 to 1.

Training takes at most ``per_class`` labelled texts of each class and
``sample_bytes`` of text in all, in the order of a hash of the id, texts of over
``long_bytes`` only where a class has too few others: a bound that does not grow
with the table. Everything else covers all rows and whole texts. Without a
labelled text of each class the score is the share of toxic labels.

Null text: empty; it has no window and gets the score of no hits. Null or
repeated ids are scored row by row; of a document with several labels, toxic
wins. Null labels are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from spindrift.llm.shared import LOWER, Words, labelled_sample, mix64, ragged, remainder, text_chunks

WIDTH = 3
PER_CLASS, SAMPLE_BYTES, LONG_BYTES = 3_000, 24 << 20, 32 << 10
#: Bytes of the ordinary dictionary; the toxic one's own part has no bound.
BASE_BYTES = 4_000
#: Least likelihood-ratio statistic of a segment.
SIGNIFICANT = 20.0
#: Length of the pieces that zstandard's trainer picks.
SEGMENT = 64
#: Fewest toxic texts that a segment stands in.
LEAST = 5
#: The bytes that a byte is spread to.
SPREAD = np.ascontiguousarray(mix64(np.arange(1, 257, dtype=np.uint64)).astype("<u8").view(np.uint8).reshape(256, 8)[:, :WIDTH])


def segments(text: bytes) -> set[bytes]:
    """Starts of words (4 to 11 bytes) and whole words, with the blank before them."""
    out = set()
    for word in set(text.lower().split()):
        out.update(b" " + word[:k] for k in range(4, min(len(word), 11) + 1))
        out.add(b" " + word + b" ")
    return out


def _contrast(own: Counter, n: int, other: Counter, m: int) -> list[bytes]:
    """Segments that significantly more texts of one class have, the most telling last."""
    score = {}
    for s, k in own.items():
        o = other[s]
        if k >= LEAST and k / n > 3 * (o + 0.5) / (m + 1):
            share = (k + o) / (n + m)
            score[s] = 2 * (k * math.log(k / (n * share)) + (o * math.log(o / (m * share)) if o else 0))
    out, known = [], []
    for s in sorted(score, key=lambda s: (-score[s], s)):
        if score[s] < SIGNIFICANT:
            break
        at = bisect_left(known, s)
        if at < len(known) and known[at].startswith(s):  # a blank only begins or ends a segment: it is held as a start
            continue
        known.insert(at, s)
        out.append(s)
    return out[::-1]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about ``size`` bytes trained by zstandard; too few samples to train on are taken as they are."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(max(256, size), samples, k=SEGMENT, d=6, level=3, dict_id=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sorted(set(samples)))[-size:] if size else b""


class Model:
    """Dictionaries (as bytes), threshold and logistic weights."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", threshold: int = 1, weights: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.toxic, self.ordinary, self.threshold, self.weights = toxic, ordinary, threshold, weights
        self._made: list | None = None

    def __getstate__(self) -> tuple:
        return self.toxic, self.ordinary, self.threshold, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _compressors(self) -> list:
        if self._made is None:
            self._made = []
            log = (WIDTH * max(len(self.ordinary), len(self.toxic))).bit_length()  # all of a dictionary stays in reach
            for content in (self.ordinary, self.toxic):
                wide = SPREAD[np.frombuffer(content, np.uint8)].tobytes()
                own = zstandard.ZstdCompressionDict(wide, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                setting = zstandard.ZstdCompressionParameters(window_log=max(17, log + 1), hash_log=max(16, log), chain_log=max(16, log), search_log=9, min_match=6, target_length=256, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
                self._made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=setting))
        return self._made

    def distances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance of each window, first window of each text)."""
        low = LOWER[data]
        words = Words(low, offsets)
        n = len(words.starts)
        if not n:
            return np.zeros(0, np.int64), words.first
        lengths = words.ends - words.starts
        pool = low[ragged(words.starts, lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(pool)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        size = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) + 2
        found = np.zeros(len(distinct), dtype=np.int64)
        for at in range(0, len(distinct), 20_000):
            own = size[at : at + 20_000] * WIDTH
            wide = SPREAD[np.frombuffer(b" " + b"  ".join(distinct[at : at + 20_000]) + b" ", np.uint8)].tobytes()
            places = np.stack([np.cumsum(own) - own, own], axis=1).astype(np.uint64)
            parts = zstandard.BufferWithSegments(wide, places.tobytes())
            plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(parts, threads=0)), dtype=np.int64, count=len(own)) for c in self._compressors())
            found[at : at + 20_000] = plain - toxic
        return found[coded.indices.to_numpy()], words.first

    def features(self, distance: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Per text: log of one plus hits, and hits per window."""
        hits = np.concatenate([[0], np.cumsum(distance >= self.threshold)])
        hits = hits[edges[1:]] - hits[edges[:-1]]
        return np.stack([np.log1p(hits), hits / np.maximum(1, np.diff(edges))], axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        w = np.array(self.weights)
        if not self.toxic:
            return np.full(len(column), 1 / (1 + math.exp(-w[0])))
        out = [np.zeros(0)]
        for _, _, data, offsets in text_chunks(column, 1 << 20):
            out.append(w[0] + self.features(*self.distances(data, offsets)) @ w[1:])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """(weights, loss) by Newton's method with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(rows: list[tuple[bytes, int]]) -> Model:
    """Fit on (text, label) pairs."""
    toxic, ordinary, common = Counter(), Counter(), Counter()
    for text, label in rows:
        if label:
            toxic.update(segments(text))
    toxic = Counter({s: k for s, k in toxic.items() if k >= LEAST})
    for text, label in rows:
        if not label:
            ordinary.update(segments(text) & toxic.keys())
            common.update(set(text.lower().split()))
    sizes = [sum(not label for _, label in rows), sum(bool(label) for _, label in rows)]
    if not min(sizes):
        share = (sizes[1] + 0.5) / (sum(sizes) + 1)
        return Model(weights=(math.log(share / (1 - share)), 0.0, 0.0))
    telling = _contrast(toxic, sizes[1], ordinary, sizes[0])
    marks, starts = set(telling), tuple(range(4, 12))
    usual = [w for w, k in sorted(common.items(), key=lambda x: (x[1], x[0])) if k >= LEAST and not any(p in marks for p in (b" " + w + b" ", *(b" " + w[:k] for k in starts)))]
    rank = {w: i for i, w in enumerate(usual)}
    # in one order in all texts, the most telling last, so that runs of what is frequent recur
    plain, own = [], []
    for text, label in rows:
        if label:
            has = segments(text)
            own.append(b"".join(s for s in telling if s in has))
        else:
            plain.append(b" ".join([b"", *sorted(rank.keys() & set(text.lower().split()), key=rank.get), b""]))
    base = dictionary(plain, BASE_BYTES)
    held = dictionary(own, sum(map(len, telling)) + 512)
    held += b"".join(s for s in telling if s not in held)  # what the trainer's pieces cut
    model = Model(base + held + b" ", base)
    y = np.array([label for _, label in rows], dtype=float)
    parts = [model.distances(data, offsets) for _, _, data, offsets in text_chunks(pa.array([t for t, _ in rows], pa.binary()), 1 << 20)]
    best = None
    for model.threshold in range(4, 16):
        weights, loss = _logistic(np.concatenate([model.features(*x) for x in parts]), y)
        if best is None or loss < best[0] - 1e-9:
            best = loss, model.threshold, tuple(weights.tolist())
    _, model.threshold, model.weights = best
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, long_bytes: int = LONG_BYTES) -> Model:
    """Train on a bounded sample of labelled texts whose crc32(id) mod 4 is not 2."""
    return train(labelled_sample(docs, labels, id_col, text_col, label_col, per_class, sample_bytes, long_bytes)[0])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns: id, held_out, score, predicted."""
    return _scored(docs.select(id_col, text_col), model, text_col, threshold).select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "score", "predicted")


def _scored(docs: DataFrame, model: Model, text_col: str, threshold: float) -> DataFrame:
    place = docs.columns.index(text_col)
    names = docs.columns
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            found = own.score(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with their columns, that score below the threshold."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = _scored(plain, model, f"c{docs.columns.index(text_col)}", threshold).where("predicted = 0")
    return kept.drop("score", "predicted").toDF(*docs.columns)
