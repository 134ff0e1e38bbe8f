"""Benchmark decontamination by greedy string tiling.

Words are compared lower-cased (A-Z) and without punctuation at their ends.
Shared seeds (hashes of ``SEED`` consecutive words) join texts with benchmark
items; a pair goes on only if the item's words under shared seeds could reach
the threshold, which bounds what tiles can cover. For such a pair the longest
non-overlapping matches are marked again and again by running Karp-Rabin,
longest first, down to ``SEED`` words. The item is contaminated if tiles cover
at least ``COVERAGE`` of its words, whatever their order in the text.

The benchmark is a stated query set: it is taken in blocks of at most about
``BLOCK_BYTES`` of text, each of them broadcast and run against all texts.

Items of fewer than ``SEED`` words (null and empty ones too) match nothing.
Null or empty texts have no seeds. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from spindrift.llm.shared import LOWER, Words, text_chunks

SEED, COVERAGE, BLOCK_BYTES = 5, 0.5, 32 << 20
#: Fixed value: ASCII punctuation, stripped from the ends of words.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words without punctuation at their ends; words of punctuation only are left out."""
    w = Words(LOWER[data], offsets)
    solid = np.append(np.flatnonzero(~_MARKS[w.data]), len(data))
    starts = solid[np.searchsorted(solid, w.starts)]
    ends = solid[np.searchsorted(solid, w.ends) - 1] + 1
    keep = starts < w.ends
    w.starts, w.ends, w.doc = starts[keep], ends[keep], w.doc[keep]
    w.first = np.searchsorted(w.doc, np.arange(len(offsets)))
    return w


def tile(item: list[bytes], text: list[bytes], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of non-overlapping matches, the longest first.

    Each round finds, by rolling hashes of unmarked runs of ``length`` words, all matches of at least that
    length and marks them longest first (ties: by place in item, then in text); what a mark leaves of the
    head of a match waits its turn by its new length, later starts have entries of their own. The length
    falls until it is ``least``.
    """
    of = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [of[w] for w in item], [of.get(w, 0) for w in text]
    free_a, free_b = [True] * len(a), [x > 0 for x in b]
    base, modulus = 1_000_003, (1 << 61) - 1
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(a), len(b)))

    def rolling(row: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
        """(hash, place) of the unmarked runs of n words."""
        top, h, run = pow(base, n, modulus), 0, 0
        for i, x in enumerate(row):
            if not free[i]:
                h = run = 0
                continue
            h = (h * base + x) % modulus
            run += 1
            if run > n:
                h = (h - row[i - n] * top) % modulus
            if run >= n:
                yield h, i - n + 1

    while True:
        places = defaultdict(list)
        for h, i in rolling(a, free_a, length):
            places[h].append(i)
        found = []
        if places:
            for h, j in rolling(b, free_b, length):
                for i in places.get(h, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n >= length:
                        found.append((-n, i, j))
        heapify(found)
        while found:
            n, i, j = heappop(found)
            free = next((k for k in range(-n) if not (free_a[i + k] and free_b[j + k])), -n)
            if free == -n:
                free_a[i : i + free] = free_b[j : j + free] = [False] * free
                out.append((i, j, free))
            elif free >= length:
                heappush(found, (-free, i, j))
        if length == least:
            return out
        length = max(least, length // 2)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, texts: list[str]):
        column = pa.array(texts, pa.string())
        keys, items, places = [], [], []
        self.words: list[list[bytes]] = []
        for first, end, data, offsets in text_chunks(column):
            w = words_of(data, offsets)
            raw = w.data.tobytes()
            hashes, at = w.shingles(w.hashes(), SEED)
            keys.append(hashes)
            items.append(w.doc[at] + first)
            places.append(at - w.first[w.doc[at]])
            for i in range(end - first):
                a, b = w.first[i], w.first[i + 1]
                self.words.append([raw[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        key, item, place = join(keys, np.uint64), join(items, np.int64), join(places, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.distinct = np.unique(self.key)
        self.size = np.array([len(x) for x in self.words], dtype=np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray, coverage: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, covered share, tiles, words) of the contaminated pairs of a chunk of texts."""
        if not len(self.key):
            return []
        w = words_of(data, offsets)
        hashes, at = w.shingles(w.hashes(), SEED)
        if not len(hashes):
            return []
        near = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
        hit = self.distinct[near] == hashes
        hashes, at = hashes[hit], at[hit]
        if not len(hashes):
            return []
        lo, hi = np.searchsorted(self.key, hashes), np.searchsorted(self.key, hashes, side="right")
        n = hi - lo
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(lo, n) + nth
        place, row, item = np.repeat(at, n), np.repeat(w.doc[at], n), self.item[entry]
        pair = row * len(self.size) + item
        # words of the item under shared seeds, counted once
        seeds = np.unique(np.stack([pair, self.place[entry]]), axis=1)
        gap = np.minimum(SEED, np.diff(seeds[1], append=0))
        last = np.append(seeds[0][1:] != seeds[0][:-1], True)
        gap[last] = SEED
        pairs, begin = np.unique(seeds[0], return_index=True)
        bound = np.add.reduceat(gap, begin)
        pairs = pairs[bound >= coverage * self.size[pairs % len(self.size)]]
        if not len(pairs):
            return []
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], place[order]
        raw, out = w.data.tobytes(), []
        for p in pairs.tolist():
            row, item = divmod(p, len(self.size))
            spots = np.unique(place[np.searchsorted(pair, p) : np.searchsorted(pair, p, side="right")])
            under = np.unique((spots[:, None] + np.arange(SEED)).ravel())
            text: list[bytes] = []
            before = -2
            for k in under.tolist():
                if k != before + 1:
                    text.append(b"\0 gap")  # no word has a blank
                text.append(raw[w.starts[k] : w.ends[k]])
                before = k
            tiles = tile(self.words[item], text)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * self.size[item]:
                out.append((row, item, covered / int(self.size[item]), len(tiles), covered))
        return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> Iterator[tuple[pa.Array, Index]]:
    """(ids, seeds) of the benchmark, a bounded block at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        rows = sorted(own.collect(), key=lambda r: (r.item is None, r.item or 0, r.t))
        yield pa.array([r.item for r in rows]), Index([r.t for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated pair: id, item, coverage, n_tiles, n_words."""
    schema = StructType([docs.schema[id_col], StructField(item_col, benchmark.schema[item_col].dataType), StructField("coverage", DoubleType()), StructField("n_tiles", IntegerType()), StructField("n_words", IntegerType())])
    out = None
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, index = shipped.value
            for batch in batches:
                for first, _, data, offsets in text_chunks(batch.column(1)):
                    if found := index.matches(data, offsets, coverage):
                        row, item, share, tiles, words = (list(x) for x in zip(*found, strict=True))
                        columns = [batch.column(0).take(pa.array([first + r for r in row])), names.take(pa.array(item)), pa.array(share), pa.array(tiles, pa.int32()), pa.array(words, pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with their columns, that hold no benchmark item."""
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value[1]
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, _, data, offsets in text_chunks(batch.column(at)):
                    keep[[first + m[0] for m in index.matches(data, offsets, coverage)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*docs.columns)
