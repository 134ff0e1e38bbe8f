"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is a bigram model with a Dirichlet prior from the add-one unigram
model: p(w | u) = a(w | u) + m(u) p1(w), with a(w | u) = c(u w) / (c(u) + MU), the
back-off mass m(u) = MU / (c(u) + MU) and p1(w) = (c(w) + 1) / (N + V + 1). All
counts are of the whole training part; nothing is cut off.

1. A word count gives N, V, a code table of the ``CODED`` most frequent words
   and the words too frequent for one shard (both of bounded size).
2. Rows are dealt into blocks by id and text, so that neither null ids nor a
   repeated one fill a block. A block sends its distinct pairs
   (word, next word) with their training counts to shards by word; pairs of a
   very frequent word go to shards by pair, and its count is known from 1.
3. A shard adds the counts up and builds a trie with the words at the root and
   the words that follow them as successors: sorted keys, pointers and
   successors are monotone sequences in Elias-Fano form, successors coded
   relative to their word's place. The root level holds the quantised smoothed
   probability and back-off mass of each word, the second level the quantised
   discounted probability of each pair. All of it is one memory-mapped file in
   the worker's temporary folder, without a name, that lives as long as the
   task. The blocks' pairs are looked up by successor search, a slice at a time,
   and codes go back in the order they came.
4. A block adds up logarithms per document. The texts move once: the plan
   reuses the exchange by block.

A block takes ``block_bytes`` and a shard ``shard_tokens``, whatever the size of
the corpus, so a worker's memory is bounded. A block writes one message for
each shard that it has pairs for, never more than it has pairs.

Null or empty text: the end token only. A null id takes part in training and is
scored like others. Repeated rows count and are returned each. A text longer
than a block is a block of its own. With an empty training part N = V = 0 and
every token has probability one.
"""

from __future__ import annotations

import math
import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import LOWER, Words, mix64, remainder, text_chunks, text_or_empty, written

MU = 200.0
BLOCK_BYTES, SHARD_TOKENS, CODED = 4 << 20, 1_000_000, 65_535
#: Pairs that a shard looks up at once.
SLICE = 100_000
END, BEGIN = np.uint64(0x8E51_73A0_44C1_9B25), np.uint64(0x3D0F_61B2_97E8_5C4B)
#: Bits of a successor's hash.
SUCCESSOR_BITS = 44
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_BYTE_ZERO, _BYTE_ONE = (np.full((256, 8), 8, dtype=np.int64) for _ in range(2))  # place of the nth zero or one of a byte, lowest bit first
for _i in range(256):
    for _table, _bit in ((_BYTE_ZERO, 0), (_BYTE_ONE, 1)):
        _z = [b for b in range(8) if _i >> b & 1 == _bit]
        _table[_i, : len(_z)] = _z


class EliasFano:
    """A monotone sequence of 64-bit numbers: low bits packed, high bits in unary with a directory."""

    def __init__(self, values: np.ndarray, bits: int):
        n = len(values)
        self.n, self.bits = n, bits
        self.low_bits = max(0, bits - max(1, n).bit_length())
        low = np.uint64(self.low_bits)
        high = (values >> low).astype(np.int64) if self.low_bits else values.astype(np.int64)
        self.buckets = (1 << (bits - self.low_bits)) if n else 1
        ones = np.zeros(n + self.buckets + 8, dtype=np.uint8)
        ones[high + np.arange(n)] = 1
        self.high = np.packbits(ones, bitorder="little")
        zeros = 8 - _BYTE_ONES[self.high]
        self.directory = (np.cumsum(zeros) - zeros).astype(np.int32)  # zeros before each byte
        self.ones = (np.arange(len(zeros)) * 8 - self.directory).astype(np.int32)
        packed = []
        for at in range(0, n, 1 << 16):
            part = values[at : at + (1 << 16)]
            packed.append(((part[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
        low_stream = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        self.low = np.concatenate([np.packbits(low_stream, bitorder="little"), np.zeros(16, np.uint8)])

    def parts(self) -> list[str]:
        return ["high", "directory", "ones", "low"]

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        out = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            piece = self.low[byte + k].astype(np.uint64)
            out |= (piece << np.uint64(8 * k)) >> shift if k < 8 else piece << (np.uint64(64) - shift)
        return out & np.uint64((1 << self.low_bits) - 1)

    def starts(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values in the buckets before each one: select on the zeros."""
        nth = bucket - 1
        first = nth < 0
        nth = np.maximum(nth, 0)
        byte = np.searchsorted(self.directory, nth, side="right") - 1
        place = byte * 8 + _BYTE_ZERO[self.high[byte], nth - self.directory[byte]]
        return np.where(first, 0, place - nth)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value by successor search in its bucket, or -1."""
        if not self.n:
            return np.full(len(x), -1)
        bucket = (x >> np.uint64(self.low_bits)).astype(np.int64)
        want = x & np.uint64((1 << self.low_bits) - 1)
        at, end = self.starts(bucket), self.starts(bucket + 1)
        top = end.copy()
        live = np.flatnonzero(at < end)
        while len(live):  # halve what is left of each bucket: a frequent word's successors crowd theirs
            middle = (at[live] + end[live]) >> 1
            less = self.lows(middle) < want[live]
            at[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[at[live] < end[live]]
        out = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(at < top)
        hit = inside[self.lows(at[inside]) == want[inside]]
        out[hit] = at[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``: select on the ones."""
        byte = np.searchsorted(self.ones, i, side="right") - 1
        place = _BYTE_ONE[self.high[byte], i - self.ones[byte]]
        return ((byte * 8 + place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)


class Trie:
    """Words with their smoothed probability and back-off mass, and for each the words that follow it."""

    def __init__(self, word: np.ndarray, after: np.ndarray, count: np.ndarray, total: np.ndarray, whole: int):
        """Pairs sorted by (word, cut hash of the next word), their counts, each one's count of the word; N + V + 1."""
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.words = EliasFano(word[begin], 64)
        self.pointers = EliasFano(np.append(begin, len(word)).astype(np.uint64), max(1, len(word)).bit_length())
        place = np.repeat(np.arange(len(begin), dtype=np.uint64), np.diff(np.append(begin, len(word))))
        self.successors = EliasFano(place << np.uint64(SUCCESSOR_BITS) | after, SUCCESSOR_BITS + max(1, len(begin)).bit_length())
        self.chance = quantise((total + MU) / count, whole)
        self.mass = quantise((total[begin] + MU) / MU, whole)
        self.alone = quantise(whole / (total[begin] + 1), whole)
        self._map()

    def _map(self) -> None:
        """Move the levels into one memory-mapped file without a name."""
        slots = [(o, p) for o in (self.words, self.pointers, self.successors) for p in o.parts()] + [(self, p) for p in ("chance", "mass", "alone")]
        with tempfile.TemporaryFile() as file:
            places = []
            for owner, name in slots:
                array = np.ascontiguousarray(getattr(owner, name))
                file.write(b"\0" * (-file.tell() % 8))
                places.append((file.tell(), array.dtype, len(array)))
                file.write(array.tobytes())
            file.write(b"\0" * 8)
            file.flush()
            whole = mmap.mmap(file.fileno(), os.fstat(file.fileno()).st_size, access=mmap.ACCESS_READ)
        for (owner, name), (at, kind, n) in zip(slots, places, strict=True):
            setattr(owner, name, np.frombuffer(whole, dtype=kind, count=n, offset=at))

    def roots(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each word's smoothed probability and back-off mass, 0 if the trie lacks it."""
        out = np.zeros((2, len(word)), np.uint16)
        at = self.words.find(word)
        known = np.flatnonzero(at >= 0)
        out[0, known], out[1, known] = self.alone[at[known]], self.mass[at[known]]
        return out[0], out[1]

    def look_up(self, word: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 if the trie lacks it."""
        out = np.zeros(len(word), np.uint16)
        for first in range(0, len(word), SLICE):
            w, a = word[first : first + SLICE], after[first : first + SLICE]
            at = self.words.find(w)
            known = np.flatnonzero(at >= 0)
            if not len(known):
                continue
            place = self.successors.find(at[known].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | a[known])
            found = place >= 0
            hit, place = known[found], place[found]
            inside = (self.pointers.get(at[hit]).astype(np.int64) <= place) & (place < self.pointers.get(at[hit] + 1).astype(np.int64))
            out[first + hit[inside]] = self.chance[place[inside]]
        return out


def quantise(inverse: np.ndarray, whole: int) -> np.ndarray:
    """16-bit codes from 1 of the logarithms of inverse probabilities, in equal steps from 1 to the least unigram's."""
    return np.clip(np.rint(np.log10(inverse) / math.log10(whole + MU + 1) * 65_534) + 1, 1, 65_535).astype(np.uint16)


def restore(code: np.ndarray, whole: int) -> np.ndarray:
    """The probabilities."""
    return np.power(10.0, (1 - code.astype(np.float64)) / 65_534 * math.log10(whole + MU + 1))


def _cut(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - SUCCESSOR_BITS)


def _pack(*arrays: np.ndarray) -> bytes:
    """Sizes and arrays, compressed if there is enough to gain."""
    raw = np.array([a.nbytes for a in arrays], dtype=np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)
    return b"z" + zstandard.compress(raw, 1) if len(raw) > 64 else b"r" + raw


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    out, at = [], 4 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, np.uint32, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before, row): the words of each text and its end."""
    words = Words(LOWER[data], offsets)
    hashes, rows = words.hashes(), len(offsets) - 1
    n = np.diff(words.first) + 1
    ends = np.cumsum(n) - 1
    token = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - n + 1] = BEGIN
    return token, before, np.repeat(np.arange(rows), n)


class _Setup:
    """What blocks and shards need of the whole corpus: bounded tables and two numbers."""

    def __init__(self, n: int, v: int, shards: int, common: np.ndarray, counts: np.ndarray):
        self.n, self.v, self.whole, self.shards, self.texts = n, v, n + v + 1, shards, int(counts[common == END].sum())
        common, counts = np.append(common, BEGIN), np.append(counts, self.texts)
        order = np.argsort(common, kind="stable")
        self.common, self.counts = common[order], counts[order]
        self.hot = self.counts > max(1, n) / (2 * shards) if shards > 1 else np.zeros(len(order), bool)

    def code(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(16-bit codes, hashes of the words without one)."""
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        known = self.common[at] == hashes
        return np.where(known, at, CODED).astype(np.uint16), hashes[~known]

    def decode(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        known = codes < CODED
        out[known] = self.common[codes[known]]
        out[~known] = rest
        return out

    def hot_count(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each very frequent word, else -1."""
        if not self.hot.any():
            return np.full(len(hashes), -1)
        names, counts = self.common[self.hot], self.counts[self.hot]
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        return np.where(names[at] == hashes, counts[at], -1)

    def shard(self, word: np.ndarray, after: np.ndarray) -> np.ndarray:
        spread = np.where(self.hot_count(word) >= 0, mix64(word + after * np.uint64(0xD6E8FEB86659FD93)), mix64(word))
        return (spread % np.uint64(self.shards)).astype(np.int32)


class _Block:
    """Distinct pairs of a block, by shard, word and next word; ``every`` holds its distinct words."""

    def __init__(self, table: pa.Table, setup: _Setup):
        token, before, row, first = [], [], [], 0
        for text in table.column("text").chunks:
            for at, _, data, offsets in text_chunks(text):
                t, b, r = _tokens(data, offsets)
                token.append(t)
                before.append(b)
                row.append((r + (first + at)).astype(np.int32))
            first += len(text)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        token, self.row, self.rows = join(token, np.uint64), join(row, np.int32), table.num_rows
        before = join(before, np.uint64)
        every, n = np.unique(token), len(token)
        self.every = np.unique(np.append(every, BEGIN))
        del every
        self.w, self.u = (np.searchsorted(self.every, x).astype(np.int32) for x in (token, before))
        del token, before
        pair, of = np.unique(self.u.astype(np.int64) << 32 | self.w, return_inverse=True)
        self.of = of.astype(np.int32)
        train = table.column("train").to_numpy()[self.row] if n else np.zeros(0)
        count = np.bincount(self.of, weights=train, minlength=len(pair)).astype(np.uint32)
        word, after = self.every[pair >> 32], self.every[pair & 0xFFFFFFFF]
        shard = setup.shard(word, after)
        self.order = np.lexsort((after, word, shard)).astype(np.int32)
        self.word, self.after, self.count, self.shard = word[self.order], after[self.order], count[self.order], shard[self.order]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _send(shipped):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        setup = shipped.value
        b = _Block(table, setup)
        begin = _edges(b.shard)
        blobs = []
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(b.shard)], strict=False):
            word = b.word[s:e]
            new = _edges(word)
            blobs.append(_pack(*setup.code(word[new]), np.diff(np.append(new, len(word))).astype(np.uint32), *setup.code(b.after[s:e]), b.count[s:e]))
        return pa.table({"shard": pa.array(b.shard[begin]), "block": pa.array(np.full(len(blobs), key[0].as_py(), np.int32)), "pairs": pa.array(blobs, pa.binary())})

    return run


def _answer(shipped):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        setup = shipped.value
        heads, sizes, after, count = [], [], [], []
        for blob in table.column("pairs"):
            code, rest, size, code_w, rest_w, n = _unpack(blob.as_py(), np.uint16, np.uint64, np.uint32, np.uint16, np.uint64, np.uint32)
            heads.append(setup.decode(code, rest))
            sizes.append(size)
            after.append(_cut(setup.decode(code_w, rest_w)))
            count.append(n)
        names, head = np.unique(np.concatenate(heads), return_inverse=True)
        of = np.repeat(head.astype(np.int32), np.concatenate(sizes))
        ends = np.cumsum([len(c) for c in count]).tolist()
        after, count = np.concatenate(after), np.concatenate(count)
        total = np.bincount(of, weights=count, minlength=len(names)).astype(np.int64)
        hot = setup.hot_count(names)
        total = np.where(hot >= 0, hot, total)
        order = np.flatnonzero(count)  # pairs of the training part
        order = order[np.lexsort((after[order], of[order]))]
        o, a = of[order], after[order]
        begin = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (a[1:] != a[:-1])])) if len(order) else np.zeros(0, np.int64)
        sums = np.add.reduceat(count[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        o, a = o[begin], a[begin]
        del order, begin, count
        trie = Trie(names[o], a, sums, total[o], setup.whole)
        del o, a, sums
        alone, mass = trie.roots(names)
        codes = np.concatenate([trie.look_up(names[of[s : s + SLICE]], after[s : s + SLICE]) for s in range(0, len(of), SLICE)])
        blobs, at, first = [], 0, 0
        for size, end in zip(sizes, ends, strict=True):
            own = head[at : at + len(size)]
            blobs.append(_pack(total[own], alone[own], mass[own], codes[first:end]))
            at, first = at + len(size), end
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "found": pa.array(blobs, pa.binary())})

    return run


def _score(shipped, id_col: str):
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        setup = shipped.value
        b = _Block(table, setup)
        total, alone, mass, codes = np.zeros(len(b.every), np.int64), *(np.zeros(n, np.uint16) for n in (len(b.every), len(b.every), len(b.order)))
        for shard, blob in zip(told.column("shard"), told.column("found"), strict=True):
            s, e = np.searchsorted(b.shard, shard.as_py()), np.searchsorted(b.shard, shard.as_py(), side="right")
            count, one, back, own = _unpack(blob.as_py(), np.int64, np.uint16, np.uint16, np.uint16)
            head = np.searchsorted(b.every, b.word[s:e][_edges(b.word[s:e])])
            total[head] = count
            alone[head], mass[head] = np.maximum(alone[head], one), np.maximum(mass[head], back)  # only shards with training pairs of a word know it
            codes[b.order[s:e]] = own
        whole = setup.whole
        total[b.every == END] = setup.texts
        p1 = np.where(alone > 0, restore(alone, whole), (total + 1) / whole)
        back = np.where(mass > 0, restore(mass, whole), MU / (total + MU))
        chance = np.where(codes > 0, restore(codes, whole), 0.0)
        add = lambda x: np.bincount(b.row, weights=x, minlength=b.rows)
        c, base = total[b.w], np.log10((total + 1) / whole)
        return pa.table({id_col: table.column("id"), "held_out": table.column("held_out"), "n_tokens": pa.array(np.bincount(b.row, minlength=b.rows).astype(np.int64)), "n_known": pa.array(add(c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(b.rows, setup.n, np.int64)), "base_score": pa.array(add(base[b.w])), "score": pa.array(add(np.log10(chance[b.of] + back[b.u] * p1[b.w])))})

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of training texts with their counts, merged as far as memory allows."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["w", "c"])

    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            new, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
            keys, of = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(of, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1_500_000:
                yield out()
                keys, sums = keys[:0], sums[:0]
    if len(keys):
        yield out()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts with crc32(id) mod 7 = 2 are held out."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), (remainder(id_col, 7) == 2).alias("held_out"))
    counts = written(docs.where("not held_out").select("text").mapInArrow(_counts, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-(size[0] + 8 * size[1]) // block_bytes))
    shards = max(1, -(-n // shard_tokens))
    top = counts.orderBy(F.col("c").desc(), "w").limit(CODED - 2).union(counts.where(F.col("w") == int(END.astype(np.int64)))).distinct().collect()
    setup = _Setup(n, v, shards, np.array([r.w for r in top], dtype=np.int64).view(np.uint64), np.array([r.c for r in top], dtype=np.int64))
    shipped = spark.sparkContext.broadcast(setup)
    by_block = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text", "held_out", (~F.col("held_out")).cast("int").alias("train"))
    sent = by_block.groupBy("block").applyInArrow(_send(shipped), "shard int, block int, pairs binary")
    told = sent.groupBy("shard").applyInArrow(_answer(shipped), "block int, shard int, found binary")
    schema = f"{id_col} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(shipped, id_col), schema)
