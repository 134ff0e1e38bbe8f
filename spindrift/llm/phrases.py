"""Phrase collocation mining with count tries of limited depth.

Texts are lower-cased (A-Z), split at punctuation into pieces and those into
words. A phrase is 1 to ``depth`` words that stand together in a piece. All
counts are per language.

Method. A shard (at least ``SHARD_BYTES`` of text, whole texts) builds a count trie: language,
then up to ``depth`` words from every position. It is serialised in the order of
the words' bytes, one blob for each prefix range; a range lies between two cuts,
which are whole paths from a sample, so that one common first word or pair is
split over many ranges. Per range the shards' sorted tries are merged (numpy's
stable sort merges the runs that it finds), counts are summed, and a walk through the merged
trie gives each phrase the counts of its first 1, 2, ... words. A node that a cut
runs through has words in several ranges: every blob brings the shard's whole
count of the few nodes on its range's two cuts, so each range knows them in full,
and the range that holds the node's own path returns it. Phrases under
``least`` end here. Suffix links lead from a phrase to the one without its first
word: one join a length gives the counts of the last 1, 2, ... words.

What moves: each shard's distinct paths once, compressed. Memory: a shard's or a
range's paths; the number of ranges follows the bytes of text. The driver holds
the cuts, ``SAMPLES`` sampled paths for each range. Every shard sends a blob to
every range that it has paths in, so blobs grow faster than the text; at some
hundred terabytes ranges and shards would have to be larger.

Null texts are empty, null languages ``und``. Repeated rows count each time. An
empty table, or one without a frequent phrase, gives no rows. Ids are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import LOWER, ragged, text_or_empty, written

#: Bytes of text of a shard and of a range; sampled paths for each range.
SHARD_BYTES, RANGE_BYTES, SAMPLES = 6 << 20, 6 << 20, 32
#: Punctuation that ends a piece, white space that ends a word.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = np.isin(np.arange(256), list(ENDS))
_SOLID = ~(_END | np.isin(np.arange(256), list(BLANKS)))
Path = tuple[bytes, ...]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, piece) of the words of a chunk of texts; a text's end ends a piece."""
    n = len(data)
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[offsets] = True
    solid = _SOLID[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | text_start[1:n]
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:] = solid & np.append(~solid[1:] | text_start[1:n], True)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    breaks = np.cumsum(_END[data] | text_start[:n])
    return starts, ends, breaks[starts]


def _texts(lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(lower-cased bytes, offsets, languages)."""
    text = text.cast(pa.large_binary())
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return LOWER[raw], off - off[0], lang.to_pylist()


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the distinct ones, the distinct ones in order): hashed first, so that only distinct keys are sorted."""
    coded = pa.array(key).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank[coded.indices.to_numpy()], values[order]


def distinct(paths: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts (how often they stand there without counts).

    Columns are packed into as few keys of 62 bits as they need, keys into ranks, until two are left; these make one
    key that is sorted. With counts, of tries that are sorted runs, the sort is a merge of the runs.
    """
    if not len(paths):
        return np.empty((0, paths.shape[1]), np.int32), np.zeros(0, np.int64)
    bits = max(1, int(paths.max()).bit_length())
    wide = max(1, 62 // bits)
    columns, groups, tables = list(paths.T), [], []
    for i in range(0, len(columns), wide):
        key = np.zeros(len(paths), np.int64)
        for col in columns[i : i + wide]:
            key = key << bits | col
        code, values = _dense(key)
        groups.append(code)
        tables.append(np.stack([values >> bits * k & (1 << bits) - 1 for k in reversed(range(len(columns[i : i + wide])))], axis=1))
    while len(groups) > 2:  # the two last become one
        right, left = groups.pop(), groups.pop()
        code, values = _dense(left * len(tables[-1]) + right)
        n = len(tables[-1])
        last, before = tables.pop(), tables.pop()
        groups.append(code)
        tables.append(np.concatenate([before[values // n], last[values % n]], axis=1))
    n = len(tables[1]) if len(tables) > 1 else 1
    key = groups[0] * n + (groups[1] if len(groups) > 1 else 0)
    if counts is None:
        key = np.sort(key)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.diff(np.append(first, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(counts[order], first)
    one = key[first]
    out = np.empty((len(one), paths.shape[1]), np.int32, order="F")  # columns are searched one at a time
    at = 0
    for place, values in zip((one // n, one % n), tables, strict=False):
        for col in values.T:
            out[:, at] = col[place]
            at += 1
    return out, sums.astype(np.int64)


class Trie:
    """Distinct padded paths in order: ``paths`` (rows x depth + 1: language, words; 0 is no word), ``counts``, ``names``.

    Words and languages are numbered from 1 in the order of their bytes, so paths in
    order are the trie's leaves from left to right, and a node is a run of paths.
    """

    def __init__(self, names: pa.Array, paths: np.ndarray, counts: np.ndarray):
        self.names, self.paths, self.counts = names, paths, counts
        self.listed = names.to_pylist()

    @staticmethod
    def build(names: pa.Array, paths: np.ndarray, counts: np.ndarray | None) -> Trie:
        """From paths in any order over ``names`` (numbered from 1 as they stand)."""
        order = pc.sort_indices(names).to_numpy()
        rank = np.zeros(len(order) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(order) + 1)
        ranked = np.empty(paths.shape, np.int32, order="F")
        for d in range(paths.shape[1]):
            ranked[:, d] = rank[paths[:, d]]
        return Trie(names.take(pa.array(order)), *distinct(ranked, counts))

    def place(self, path: Path) -> tuple[int, int]:
        """First leaf not before ``path``, and the end of the run of leaves that begin with it."""
        low, high = 0, len(self.paths)
        for d, name in enumerate(path):
            at = bisect.bisect_left(self.listed, name)
            there = at < len(self.listed) and self.listed[at] == name
            column, own = self.paths[low:high, d], np.int32(at + 1)  # of the column's type, or it would be copied
            end = low + int(np.searchsorted(column, own, "right" if there else "left"))
            low += int(np.searchsorted(column, own, "left"))
            if not there:
                return low, low
            high = end
        return low, high

    def count(self, path: Path) -> int:
        low, high = self.place(path)
        return int(self.counts[low:high].sum())

    def dump(self, low: int, high: int, whole: list[int]) -> bytes:
        """The leaves [low, high) level by level: how often each node's name changes, and the names used; ``whole`` as it is."""
        part = self.paths[low:high]
        seen = np.zeros(len(self.listed) + 1, bool)
        seen[part] = True
        seen[0] = False
        used = np.flatnonzero(seen)
        number = np.zeros(len(seen), np.int32)
        number[used] = np.arange(1, len(used) + 1)
        local = number[part]
        own = pa.concat_arrays([self.names.take(pa.array(used - 1))])
        ends = np.frombuffer(own.buffers()[1], np.int64, len(used) + 1) if len(used) else np.zeros(1, np.int64)
        names = own.buffers()[2].to_pybytes()[: int(ends[-1])] if ends[-1] else b""
        new, levels = np.zeros(len(part), bool), []
        if len(part):
            new[0] = True
        for d in range(part.shape[1]):
            new = new | (np.diff(local[:, d], prepend=-1) != 0)
            at = np.flatnonzero(new)
            levels += [at.astype(np.uint32), local[at, d].astype(np.uint32)]
        # nodes at a level are places where a run begins; gaps and names compress well
        arrays = [np.array(whole, np.int64), np.diff(ends).astype(np.uint32), self.counts[low:high].astype(np.int64)]
        arrays += [np.diff(x, prepend=np.uint32(0)) if i % 2 == 0 else x for i, x in enumerate(levels)]
        head = np.array([len(names), *map(len, arrays)], np.int64).tobytes()
        planes = b"".join(a.reshape(-1, 1).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
        return zstandard.compress(head + names + planes, 3)


def load(blob: bytes, depth: int) -> tuple[list[int], pa.Array, np.ndarray, np.ndarray]:
    """(whole counts, names, paths, counts) of a dumped range; names are numbered from 1."""
    data = zstandard.decompress(blob)
    kinds = [np.int64, np.uint32, np.int64] + [np.uint32] * (2 * (depth + 1))
    head = np.frombuffer(data, np.int64, 1 + len(kinds))
    at = head.nbytes
    text, at = data[at : at + int(head[0])], at + int(head[0])
    arrays = []
    for n, kind in zip(head[1:].tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    whole, sizes, counts, *levels = arrays
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int64)), pa.py_buffer(text)])
    paths = np.zeros((len(counts), depth + 1), np.int32, order="F")
    for d in range(depth + 1):
        starts, values = np.cumsum(levels[2 * d], dtype=np.int64), levels[2 * d + 1]
        paths[:, d] = np.repeat(values.astype(np.int32), np.diff(np.append(starts, len(counts))))
    return whole.tolist(), names, paths, counts


def _cut_nodes(cuts: list[Path], i: int) -> list[Path]:
    """The nodes on the two cuts of range ``i``, from the top, without repeats."""
    sides = [cuts[j] for j in (i - 1, i) if 0 <= j < len(cuts)]
    return list(dict.fromkeys(c[:d] for c in sides for d in range(1, len(c) + 1)))


def shard_trie(langs: list[str], data: np.ndarray, offsets: np.ndarray, depth: int) -> Trie:
    """The count trie of some texts."""
    starts, ends, piece = _words(data, offsets)
    sizes = ends - starts
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, sizes)]))])
    words = binary.dictionary_encode()
    kinds = pa.array([x.encode() for x in langs], pa.large_binary()).dictionary_encode()
    # one numbering for both; a language and a word may have one name
    names = pa.concat_arrays([words.dictionary, kinds.dictionary]).dictionary_encode()
    number = names.indices.to_numpy().astype(np.int32) + 1
    ids = number[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
    lang = number[len(words.dictionary) + kinds.indices.to_numpy()]
    n = len(ids)
    paths = np.zeros((n, depth + 1), np.int32, order="F")
    paths[:, 0] = lang[np.searchsorted(offsets, starts, "right") - 1]
    for d in range(depth):
        same = piece[d:] == piece[: n - d] if d < n else np.zeros(0, bool)
        paths[: len(same), d + 1][same] = ids[d:][same]
    return Trie.build(names.dictionary, paths, None)


def _shards(cuts: list[Path], depth: int):
    """Task function: (lang, text) batches to (range, blob)."""
    nodes = [_cut_nodes(cuts, i) for i in range(len(cuts) + 1)]

    def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, text = (table.column(i).chunk(0) if table.num_rows else pa.array([], pa.string()) for i in (0, 1))
        data, offsets, langs = _texts(lang, text)
        trie = shard_trie(langs, data, offsets, depth)
        memo: dict[Path, int] = {}
        total = lambda p: memo[p] if p in memo else memo.setdefault(p, trie.count(p))
        bounds = [0, *(trie.place(c)[0] for c in cuts), len(trie.paths)]
        for i, (low, high) in enumerate(itertools.pairwise(bounds)):
            whole = [total(p) for p in nodes[i]]
            if high > low or any(whole):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([trie.dump(low, high, whole)], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # a batch can hold many shards of long texts
                held.append(batch.slice(i, 1))
                size += pc.binary_length(held[-1].column(1))[0].as_py()
                if size >= SHARD_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


NODES = "lang string, phrase string, rest string, len int, f bigint, firsts array<bigint>"


def merge(blobs: list[bytes], i: int, cuts: list[Path], depth: int, least: int) -> list[tuple]:
    """Rows of NODES of range ``i``: the phrases of at least ``least``, and languages with their words (len 0)."""
    loaded = [load(b, depth) for b in blobs]
    names = pa.concat_arrays([x[1] for x in loaded]).dictionary_encode()
    number = names.indices.to_numpy().astype(np.int32) + 1
    paths, at = [], 0
    for _, words, local, _ in loaded:
        paths.append(np.append(np.int32(0), number[at : at + len(words)])[local])
        at += len(words)
    trie = Trie.build(names.dictionary, np.concatenate(paths), np.concatenate([x[3] for x in loaded]))
    nodes = _cut_nodes(cuts, i)
    whole = dict(zip(nodes, np.sum([x[0] for x in loaded], axis=0).tolist() if nodes else [], strict=True))
    low, high = cuts[i - 1] if i else (), cuts[i] if i < len(cuts) else None
    inside = lambda p: p >= low and (high is None or p < high)
    rows: list[tuple] = []

    def emit(path: Path, firsts: list[int]) -> None:
        text = [w.decode("utf-8", "replace") for w in path]
        rows.append((text[0], " ".join(text[1:]), " ".join(text[2:]), len(path) - 1, firsts[-1], firsts[1:-1]))

    walk = np.zeros((len(trie.paths), depth + 1), np.int64)
    new = np.zeros(len(trie.paths), bool)
    new[:1] = True
    for d in range(depth + 1):
        new = new | (np.diff(trie.paths[:, d], prepend=-1) != 0)
        first = np.flatnonzero(new)
        if not len(first):
            break
        sums = np.add.reduceat(trie.counts, first)
        own = np.ones(len(first), bool)
        for p in nodes:  # nodes on a cut have their whole count
            if len(p) == d + 1:
                a, b = trie.place(p)
                if b > a:
                    k = int(np.searchsorted(first, a))
                    sums[k], own[k] = whole[p], False
        walk[:, d] = np.repeat(sums, np.diff(np.append(first, len(trie.paths))))
        good = own & (trie.paths[first, d] > 0) & ((sums >= least) if d else True)
        for k in first[good].tolist():
            emit(tuple(trie.listed[j - 1] for j in trie.paths[k, : d + 1]), walk[k, : d + 1].tolist())
    for p in nodes:
        if inside(p) and (len(p) == 1 or whole[p] >= least) and whole[p]:
            emit(p, [whole[p[:d]] for d in range(1, len(p) + 1)])
    return rows


def _merges(cuts: list[Path], depth: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        rows = merge(table.column("blob").to_pylist(), table.column("part")[0].as_py(), cuts, depth, least)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["lang", "phrase", "rest", "len", "f", "firsts"])

    return run


def _sampler(every: int, depth: int):
    """Task function: the path after each ``every``-th byte of a task's texts, as (lang, words joined by a blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = every // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off, langs = _texts(batch.column(0), batch.column(1))
            rows = []
            while at < len(data):
                doc = int(np.searchsorted(off, at, "right")) - 1
                piece = data[at : min(int(off[doc + 1]), at + 512)]
                starts, ends, breaks = _words(piece, np.array([0, len(piece)]))
                path = [piece[s:e].tobytes() for s, e, b in zip(starts[1:], ends[1:], breaks[1:], strict=True) if b == breaks[1]][:depth]
                rows.append((langs[doc], b" ".join(path)))
                at += every
            at -= len(data)
            lang, words = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.binary())], ["lang", "words"])

    return run


def find_cuts(texts: DataFrame, depth: int, range_bytes: int | None = None) -> list[Path]:
    """Paths that cut (lang, text) into ranges of about ``range_bytes``; what is counted does not depend on them."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = -(-size // (range_bytes or RANGE_BYTES))
    if ranges < 2:
        return []
    every = max(1, size // (ranges * SAMPLES))
    found = texts.mapInArrow(_sampler(every, depth), "lang string, words binary").collect()  # about SAMPLES a range
    paths = sorted((r.lang.encode(), *bytes(r.words).split()) for r in found)
    picked = [paths[len(paths) * k // ranges] for k in range(1, ranges)] if paths else []
    return sorted(set(p for p in picked if len(p) > 1))


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = 4, least: int = 30, range_bytes: int | None = None) -> DataFrame:
    """(lang, phrase, rest, len, f, firsts) of all phrases of at least ``least``, and len 0 for a language's words.

    ``firsts`` are the counts of the first 1, 2, ... words but for the phrase itself, ``rest`` is the phrase without its first word.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    cuts = find_cuts(texts, depth, range_bytes)
    return texts.mapInArrow(_shards(cuts, depth), "part int, blob binary").groupBy("part").applyInArrow(_merges(cuts, depth, least), NODES)


def suffix_counts(found: DataFrame, depth: int = 4) -> DataFrame:
    """``found`` of 2 words and more with ``lasts``: the counts of the phrase without its first 1, 2, ... words, by suffix links."""
    link = found.where(F.col("len") == 1).select(F.col("lang").alias("l"), F.col("phrase").alias("p"), F.array("f").alias("chain"))
    out = []
    for n in range(2, depth + 1):
        mine = found.where(F.col("len") == n)
        mine = mine.join(link, (F.col("lang") == F.col("l")) & (F.col("rest") == F.col("p"))).drop("l", "p").withColumnRenamed("chain", "lasts")
        out.append(mine)
        link = mine.select(F.col("lang").alias("l"), F.col("phrase").alias("p"), F.concat(F.array("f"), "lasts").alias("chain"))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _inner(phrase: Column, n: Column) -> Column:
    """The phrases of 2 words and more within a longer one."""
    words = F.split(phrase, " ")
    sizes = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = 4, least: int = 30, covered: int = 80, top: int = 2000, scale: int = 2_000_000, range_bytes: int | None = None) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``depth`` words.

    A phrase's score is floor(scale * a / (l + r)) at its worst cut (the first of equals). Phrases go that stand inside a longer
    one with at least ``covered`` hundredths of their count. Order: score, count (falling), phrase (bytes).
    """
    found = written(count_phrases(docs, text_col, lang_col, depth, least, range_bytes), codec="zstd")
    words = found.where(F.col("len") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    # the k-th cut: the first k words, and the phrase without them; decimals hold the products
    cuts = "transform(arrays_zip(firsts, lasts), (c, k) -> struct(cast(f as decimal(20,0)) * cast(%d as decimal(10,0)) div cast(c.firsts + c.lasts as decimal(20,0)) as score, k, c.firsts as l, c.lasts as r))" % scale
    worst = suffix_counts(found, depth).select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.expr(cuts)).alias("w"))
    longer = found.where(F.col("len") > 2).select("lang", F.explode(_inner(F.col("phrase"), F.col("len"))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("salt"))
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
