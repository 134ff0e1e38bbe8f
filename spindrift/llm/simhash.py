"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint bit is 1 if over half of the text's shingle hashes have it.
Two texts are linked if their fingerprints differ in at most four bits, and
each text gets the smallest id that links reach.

Candidates. The 64 bits are cut into segments of 22, 21 and 21 bits, each read
as a word of the perfect (23, 12, 7) Golay code. At most four errors over three
segments leave, by the pigeonhole principle, either a segment without error
(key: the segment), or two segments with at most one error each. For those, a
fingerprint is filed under the pair of nearest codewords and looked up under
all pairs of codewords within distance four: if x and y differ in one bit and c
is nearest to y (distance three at most), c lies within four of x.

Only distinct fingerprints take part, so copies collapse first. Keys meet in
cells that are sorted streams; a cell gives a spanning forest of its verified
links, not all pairs, and keys with many fingerprints are dealt over cells of
chunk against chunk. Components come from alternating large and small stars
over written tables.

Similar texts (``first_of_similar``) share 0.8 of their five-word shingles, whatever their
fingerprints. They come from an exact join by prefixes: in one order of all shingles,
common ones last, two such texts share one of the first fifth of theirs. Cells with
many texts are verified by stars first, then by forests of the likeliest pairs, then all
pairs that are not in one group yet.

Null text: empty, fingerprint zero. Null ids: rows of their own, ignored as
smallest id unless all are null. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from spindrift.llm.shared import ragged, written

SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: the code's generator polynomial.
GENERATOR = 0xC75
#: Fingerprints of one key that a cell holds at most, before it is dealt over several.
CELL = 4_096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = 256 * np.arange(8)


def _shingles(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of the k-word shingles, repeats included; of fewer words the whole sequence."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """64 bits, 1 where over half of the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, k: int = 4) -> int:
    """64-bit SimHash of the k-word shingles."""
    return _majority(_shingles(text.lower().split(), k))  # bytes: ASCII letters and white space only


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: eleven bits."""
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GENERATOR << bit - 11), word)
    return word


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how many) by remainder: errors of weight at most four, the lightest first."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for p, r in zip(patterns.tolist(), _remainder(patterns).tolist(), strict=True):
            found[r].append(p)
    size = np.array([len(x) for x in found])
    table = np.zeros((2048, size.max()), dtype=np.int64)
    for r, x in enumerate(found):
        table[r, : len(x)] = x
    return table, size


def nearby(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codeword numbers within distance four, how many); the first is the nearest."""
    table, size = golay()
    r = _remainder(segment)
    return (segment[:, None] ^ table[r]) >> 11, size[r]


def keys_of(prints: np.ndarray, near: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, whether filed, row) of all keys of an array of fingerprints; without ``near`` only the segments as they are."""
    parts = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows = np.arange(len(prints))
    keys, filed, of = [], [], []

    def add(family: int, key: np.ndarray, row: np.ndarray, build: bool) -> None:
        keys.append(key | family << 32)
        filed.append(np.full(len(key), build))
        of.append(row)

    for i, part in enumerate(parts):
        add(i, part, rows, True)
    around = [nearby(part) for part in parts] if near else []
    for f, (i, j) in enumerate(PAIRS if near else ()):
        (a, n), (b, m) = around[i], around[j]
        add(3 + f, a[:, 0] << 12 | b[:, 0], rows, True)
        both = n * m
        row = np.repeat(rows, both)
        nth = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        nth, row = nth[nth > 0], row[nth > 0]  # the first pair is the filed one
        add(3 + f, a[row, nth // m[row]] << 12 | b[row, nth % m[row]], row, False)
    return np.concatenate(keys), np.concatenate(filed), np.concatenate(of)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc (the id) and fp (the fingerprint's 64 bits as a long)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((x.as_py() or "").encode()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc {kind}, fp bigint")


def _forest(prints: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    out, rest = [], prints
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[0], front[1:]
            linked = np.bitwise_count(rest ^ head) <= most
            if linked.any():
                new, rest = rest[linked], rest[~linked]
                out.append((np.full(len(new), head), new))
                front = np.concatenate([front, new])
    return out


def _cell_links(cell: np.ndarray, fp: np.ndarray, filed: np.ndarray, most: int, pairwise: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal, sorted cells: all of up to ``pairwise`` rows, a spanning forest of more."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    useful = (size > 1) & (np.add.reduceat(filed.astype(np.int64), begin) > 0)
    a, b = [], []
    small = useful & (size <= pairwise)
    starts, sizes = begin[small], size[small]
    step = 200_000
    for at in range(0, len(starts), step):
        s, n = starts[at : at + step], sizes[at : at + step]
        left = ragged(s, n)  # each row against the later ones of its cell
        later = np.repeat(s + n, n) - left - 1
        x = fp[np.repeat(left, later)]
        y = fp[ragged(left + 1, later)]
        hit = (np.bitwise_count(x ^ y) <= most) & (x != y)
        a.append(x[hit])
        b.append(y[hit])
    for s, n in zip(begin[useful & ~small].tolist(), size[useful & ~small].tolist(), strict=True):
        for x, y in _forest(np.unique(fp[s : s + n]), most):
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pair = np.unique(np.stack([np.minimum(x := np.concatenate(a), y := np.concatenate(b)), np.maximum(x, y)]), axis=1)
    return pair[0], pair[1]


def links(distinct: DataFrame, most: int = 4, cell_size: int = CELL, near: bool = True) -> DataFrame:
    """Links (a, b) of the distinct fingerprints in column fp, enough to connect all that differ in ``most`` bits.

    Up to four bits none is missed; beyond, and without ``near`` keys, those are found that share a key all the same.
    """
    if most < 0:
        raise ValueError("a negative number of bits")

    def make(only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = np.asarray(batch.column(0)).view(np.uint64)
                for at in range(0, len(whole), 2_000):
                    prints = whole[at : at + 2_000]
                    key, filed, row = keys_of(prints, near)
                    if only:
                        yield pa.RecordBatch.from_arrays([pa.array(key[filed])], names=["key"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row].view(np.int64)), pa.array(filed)], names=["key", "fp", "filed"])

        return run

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _cell_links(*parts, most, 64 if near else 2)  # whole segments bring large groups together
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last cell may go on
            if cut > 50_000:
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield out(held)

    keys = distinct.mapInArrow(make(False), "key bigint, fp bigint, filed boolean")
    hot = distinct.mapInArrow(make(True), "key bigint").groupBy("key").count().where(F.col("count") > cell_size)
    # written first: Spark sees its size, and only a large one makes the keys move for this join
    hot = written(hot.select("key", F.ceil(F.col("count") / cell_size).cast("int").alias("chunks")))
    dealt = keys.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
    places = F.when(F.col("chunks").isNull(), F.array(F.xxhash64("key"))).otherwise(others)
    cells = dealt.select(F.explode(places).alias("cell"), "fp", "filed")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(match, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): the label is the smallest node reached."""
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        # large star: a node's larger neighbours move to its smallest one
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("m"))
        large = now.toDF("u", "v").select(F.col("v").alias("s"), F.col("u").alias("t")).join(low, F.col("s") == F.col("k")).select(F.col("t").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large["u"] == low["k"]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _grouped(prints: DataFrame, most: int) -> DataFrame:
    """From (doc, fp) rows: (print, component_id, keeper): the component's smallest id and that id's fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc").alias("low")))
    found = components(links(distinct.select("fp"), most))
    labelled = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label")))
    first = F.min(F.struct(F.col("low").isNull().alias("missing"), "low", "fp"))
    lowest = labelled.groupBy("label").agg(first.alias("first")).select("label", F.col("first.low").alias("component_id"), F.col("first.fp").alias("keeper"))
    return written(labelled.join(lowest, "label").select(F.col("fp").alias("print"), "component_id", "keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id reached)."""
    prints = written(fingerprints(docs, id_col, text_col))
    by_print = _grouped(prints, most)
    out = prints.join(by_print, prints["fp"] == by_print["print"])
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """The rows, with their columns, of the smallest id of each group; of rows equal in id and fingerprint, one."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    grouped = _grouped(written(fingerprints(docs, id_col, text_col)), most)
    keepers = written(grouped.where(F.col("print") == F.col("keeper")).select(F.col("print").alias("keeper_fp"), F.col("component_id").alias("keeper_id")))
    names = [*plain.columns, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((x.as_py() or "").encode()) for x in batch.column(text_at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=names)

    with_print = plain.mapInArrow(run, StructType([*plain.schema.fields]).add("fp", LongType()))
    kept = with_print.join(keepers, (F.col("fp") == F.col("keeper_fp")) & F.col(f"c{id_at}").eqNullSafe(F.col("keeper_id")), "left_semi")
    return kept.dropDuplicates([f"c{id_at}", "fp"]).drop("fp").toDF(*docs.columns)


#: Words of a shingle and least similarity of similar texts.
SHINGLE, SIMILAR = 5, 0.8
#: Nodes of a shingle's cell that meet pair by pair at once; those of a larger one meet after a first search by stars.
PAIRWISE = 16
#: Of one in ``OF`` texts, shingles that stand in ``COMMON`` or more are common; at most ``MOST`` of them are told apart. They only shape the order.
OF, COMMON, MOST = 16, 8, 100_000
#: Least bits of a set's marks; larger sets have as many as they have shingles, up to the next power of two.
MARKS = 64
#: Most rows of a table of ids or hashes that is broadcast (some tens of megabytes).
FEW = 1_000_000


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _node(text: bytes) -> int:
    """Hash of the words of a text."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, distinct shingles, sorted) of each text."""
    for x in texts:
        text = (x.as_py() or "").encode()
        yield _node(text), np.unique(_shingles(text.lower().split(), k))


def _with_node(plain: DataFrame, text_at: int, text: bool = True) -> DataFrame:
    """Rows with ``node``, the hash of their words; without the text itself if it is not wanted."""
    kept = [i for i in range(len(plain.columns)) if text or i != text_at]
    names = [*[plain.columns[i] for i in kept], "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [_node((x.as_py() or "").encode()) for x in part.column(text_at)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], _signed(found)], names=names)

    return plain.mapInArrow(run, StructType([plain.schema.fields[i] for i in kept]).add("node", LongType()))


def _near(table: DataFrame) -> DataFrame:
    """A table of few columns, broadcast if it has at most ``FEW`` rows; a larger one is joined by key."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles (unsigned) that many texts of a sample have, the rarer first. Whatever they are, the groups are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([_signed(found)], names=["s"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(OF)) == 0).mapInArrow(run, "s bigint")
    rows = some.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "s").limit(MOST).collect()
    return np.array([r.s for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set: in one order for all sets, of two sets of similarity ``least`` or more they share one.

    Rare ones come first, by their hash, then the common ones. Of n shingles a similar set has ``least`` * n or more, so it cannot lack the first
    n - ceil(``least`` * n) + 1 of them, and neither can the other way round; of what both have the first is among both's.
    """
    size = len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1 if len(found) else 0
    if not len(common):
        return found[:size]
    by_value = np.argsort(common)
    at = np.minimum(np.searchsorted(common, found, sorter=by_value), len(common) - 1)
    is_common = common[by_value[at]] == found
    rare = found[~is_common]
    return np.concatenate([rare[:size], common[np.sort(by_value[at[is_common]])][: max(0, size - len(rare))]])


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one is at these places can be similar."""
    needed = np.ceil(least / (1 + least) * (n + m) - 1e-9)
    return 1 + np.minimum(n - at - 1, m - to - 1) >= needed


def _marks(found: np.ndarray) -> bytes:
    """The size of a set and its marks: bits, each the parity of the shingles that fall on it.

    Their number grows with the set, for those of a fixed number say nothing about a large one. Half of them over the other half gives
    the marks of half as many bits.
    """
    width = max(MARKS, 1 << (len(found) - 1).bit_length()) if len(found) else MARKS
    bits = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return len(found).to_bytes(8, "little") + np.packbits(bits.astype(np.uint8)).tobytes()


def _spare(marks: tuple[list[bytes], list[bytes]], least: float) -> np.ndarray:
    """How many more bits could differ, pair by pair, between the marks of similar sets; below zero the sets are not similar.

    Marks, and sizes, differ in no more than the sets in shingles.
    """
    wide = np.array([[len(x) for x in side] for side in marks])
    spare = np.zeros(wide.shape[1], np.int64)
    for widths in np.unique(wide, axis=1).T:
        at = np.flatnonzero((wide == widths[:, None]).all(axis=0))
        both = [np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), -1) for side in marks]
        n, m = (x[:, :8].copy().view(np.int64).ravel() for x in both)
        x, y = (x[:, 8:] for x in both)
        while x.shape[1] != y.shape[1]:  # the wider marks fold
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (z[:, :half] ^ z[:, half:] if z.shape[1] > half else z for z in (x, y))
        apart = np.maximum(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), np.abs(n - m))
        spare[at] = n + m - 2 * np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64) - apart
    return spare


def _may_by_marks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, ma, mb) that can be similar by their marks."""
    for batch in batches:
        if batch.num_rows:
            close = pa.array(_spare((batch.column("ma").to_pylist(), batch.column("mb").to_pylist()), least) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(close) for c in ("a", "b")], names=["a", "b"])


def _cell_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, least: float, open_key: int | None) -> pa.RecordBatch:
    """Of sorted cells: pairs (a, b) that may be similar of small ones; of large ones stars, and all their rows (a, key, n, at)."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    large = size > PAIRWISE
    if open_key is not None and len(key):
        large = large | (key[begin] == open_key)
    s, c = begin[~large & (size > 1)], size[~large & (size > 1)]
    left = ragged(s, c)
    later = np.repeat(s + c, c) - left - 1
    x, y = np.repeat(left, later), ragged(left + 1, later)
    hit = (node[x] != node[y]) & _may(n[x], at[x], n[y], at[y], least)
    rows, head = ragged(begin[large], size[large]), np.repeat(begin[large], size[large])
    x, y = np.concatenate([x[hit], rows, rows[1:]]), np.concatenate([y[hit], head, rows[:-1]])  # stars, and each with the one before
    star = (node[x] != node[y]) & (key[x] == key[y]) & _may(n[x], 0, n[y], 0, least)  # of sizes that can be similar
    pair = np.unique(np.stack([np.minimum(node[x[star]], node[y[star]]), np.maximum(node[x[star]], node[y[star]])]), axis=1)
    none, k = pa.nulls(pair.shape[1], pa.int64()), len(rows)
    columns = [(pair[0], node[rows]), (pair[1], None), (none, key[rows]), (none, n[rows]), (none, at[rows])]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(u, pa.int64()), pa.nulls(k, pa.int64()) if v is None else pa.array(v, pa.int64())]) for u, v in columns], names=["a", "b", "key", "n", "at"])


def prefix_pairs(texts: DataFrame, k: int, least: float, common: np.ndarray) -> DataFrame:
    """Written: (a, b) pairs of nodes that share a shingle of their prefixes, but of cells of over ``PAIRWISE`` nodes only stars, and such cells' rows (a, key, n, at; b null)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                sets = [(node, len(found), prefix(found, common, least)) for node, found in _sets(batch.column(0).slice(first, 500), k)]
                sizes = [len(p) for _, _, p in sets]
                keys = np.concatenate([p for _, _, p in sets] or [np.zeros(0, np.uint64)])
                of = np.repeat(np.arange(len(sets)), sizes)
                numbers = np.array([n for _, n, _ in sets], dtype=np.int64)[of] if len(sets) else np.zeros(0, np.int64)
                nodes = np.array([x for x, _, _ in sets], dtype=np.uint64)[of] if len(sets) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(keys), _signed(nodes), pa.array(numbers), pa.array(ragged(np.zeros(len(sets), np.int64), np.array(sizes, dtype=np.int64)))], names=["key", "node", "n", "at"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = [np.zeros(0, np.int64)] * 4, None
        for batch in batches:
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last cell may go on
            if not cut and len(held[0]) > 50_000:  # one cell alone: its rows leave as they come
                cut, goes_on = len(held[0]), int(held[0][-1])
            elif cut <= 50_000:
                continue
            else:
                goes_on = None
            yield _cell_pairs(*[x[:cut] for x in held], least, open_key)
            held, open_key = [x[cut:] for x in held], goes_on if goes_on is not None else open_key
        if len(held[0]):
            yield _cell_pairs(*held, least, open_key)

    keys = texts.mapInArrow(make, "key bigint, node bigint, n bigint, at bigint")
    return written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(match, "a bigint, b bigint, key bigint, n bigint, at bigint"))


def cell_rest(rows: DataFrame, labels: DataFrame, least: float, cell_size: int = CELL, forest: bool = False) -> DataFrame:
    """(a, b) that may be similar, by places and marks, among the rows (key, node, n, at, marks) of large cells: all pairs of nodes that ``labels``
    (node, label) do not connect yet, or with ``forest`` only enough of them, those with the closest marks, to connect what all would.

    A cell is dealt in chunks, chunk against chunk, so that a task holds two of them, however large the cell.
    """
    chunks = written(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell_size).cast("int").alias("chunks")))
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(_near(chunks), "key")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    dealt = named.select("key", F.explode(places).alias("c"), "node", "label", "n", "at", "marks").select("key", "c.i", "c.j", "node", "label", "n", "at", "marks")

    def pairs(node, label, n, at, marks) -> Iterator[pa.RecordBatch]:
        order = np.argsort(label, kind="stable")
        node, label, n, at, marks = node[order], label[order], n[order], at[order], marks[order]
        after = np.searchsorted(label, label, side="right")  # of other components only later ones, so each pair once
        root = np.unique(label, return_inverse=True)[1]
        step, fine = (max(1, (1 << bits) // len(node)) for bits in (21, 18))  # rows whose pairs are chosen from together, and looked at together
        for first in range(0, len(node), step):
            parts = []
            for begin in range(first, min(first + step, len(node)), fine):
                x = np.arange(begin, min(begin + fine, first + step, len(node)))
                later = len(node) - after[x]
                x, y = np.repeat(x, later), ragged(after[x], later)
                hit = _may(n[x], at[x], n[y], at[y], least)
                if forest:
                    hit &= root[x] != root[y]
                parts.append((x[hit], y[hit]))
            x, y = (np.concatenate(z) for z in zip(*parts, strict=True))
            spare = np.concatenate([np.zeros(0, np.int64), *[_spare((marks[x[i : i + 4_096]].tolist(), marks[y[i : i + 4_096]].tolist()), least) for i in range(0, len(x), 4_096)]])
            x, y, spare = (z[spare >= 0] for z in (x, y, spare))
            if forest:
                chosen = []
                for i in np.argsort(-spare, kind="stable").tolist():
                    u, v = root[x[i]], root[y[i]]
                    if u != v:
                        root[root == v] = u
                        chosen.append(i)
                x, y = x[chosen], y[chosen]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*[np.zeros(0, np.int64)] * 7, np.zeros(0, object)]

        def cells(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            change = np.any([p[1:] != p[:-1] for p in parts[:3]], axis=0)
            ends = [0, *(np.flatnonzero(change) + 1).tolist(), len(parts[0])]
            for u, v in zip(ends, ends[1:], strict=False):
                yield from pairs(*[p[u:v] for p in parts[3:]])

        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False).astype(x.dtype)]) for x, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero(np.any([p != p[-1] for p in held[:3]], axis=0)) if len(held[0]) else ()
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut > 50_000:
                yield from cells([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield from cells(held)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(match, "a bigint, b bigint")


def _ids(plain: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: (node, id, n), how many rows have the words and the id."""
    return written(_with_node(plain.select(F.col(id_col).alias("id"), text_col), 1, False).groupBy("node", "id").agg(F.count(F.lit(1)).alias("n")))


def _without(plain: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not in the one column of ``ids``."""
    return plain.join(_near(ids.toDF("without")), F.col(id_col).eqNullSafe(F.col("without")), "left_anti")


def similar_groups(plain: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, least: float = SIMILAR, cell_size: int = CELL, ids: DataFrame | None = None) -> DataFrame:
    """(node, low, keeper, copies, own): for each distinct sequence of words its group's smallest id, the node of that id, and how many rows have
    the node, and the node and its own smallest id. ``ids``: what ``_ids`` gives, if it is there already.

    Groups are what links of similarity ``least`` or more over distinct ``k``-word shingles connect, all of them: the join is exact, by prefixes of
    the sets. Of cells with many nodes stars are verified first, then forests of the pairs with the closest marks, then all pairs that these leave in
    different groups. No stage has two steps in Python: Spark keeps a worker process for each, with what it has grown to.
    """
    ids = ids or _ids(plain, id_col, text_col)
    lowest = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "n"))
    nodes = written(ids.groupBy("node").agg(lowest.alias("x"), F.sum("n").alias("copies")).select("node", F.col("x.id").alias("low"), F.col("x.n").alias("own"), "copies"))
    # of copies those of the smallest id speak for all; an id goes if it is the smallest of none of its nodes
    copied = nodes.where("copies > 1").select(F.col("node").alias("copied"), F.col("low").alias("of"))
    others = ids.join(_near(copied), F.col("node") == F.col("copied")).where(~F.col("id").eqNullSafe(F.col("of"))).select("id").distinct()
    silent = written(others.join(nodes.select("low"), F.col("id").eqNullSafe(F.col("low")), "left_anti"))
    texts = _without(plain, id_col, silent).select(F.col(text_col).alias("text"))
    found = prefix_pairs(texts, k, least, common_shingles(plain.select(F.col(text_col).alias("text")), k))

    def of_texts(asked: DataFrame, made: str, make: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
        """What ``make`` makes of the set of each node asked for (repeats allowed), as (node, x), written."""
        asked = written(asked.distinct().join(nodes.select("node", "low"), "node").select("low").distinct())
        own = plain.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(_near(asked), F.col("id").eqNullSafe(F.col("low")), "left_semi").select("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    sets = list(_sets(batch.column(0).slice(first, 500), k))
                    yield pa.RecordBatch.from_arrays([_signed([x for x, _ in sets]), pa.array([make(f) for _, f in sets], kind)], names=["node", "x"])

        return written(own.mapInArrow(run, f"node bigint, x {made}").groupBy("node").agg(F.first("x").alias("x")))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    def sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """The pairs with what ``of`` has for either node, xa and xb."""
        left, right = (of.select(F.col("node").alias(c), F.col("x").alias(f"x{c}")) for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b")

    def alike(pairs: DataFrame) -> DataFrame:
        """The similar ones of the written pairs (a, b), written."""
        shared = F.size(F.array_intersect("xa", "xb"))
        sets = of_texts(both(pairs), "array<bigint>", lambda f: f.view(np.int64), pa.list_(pa.int64()))
        return written(sides(pairs, sets).where(shared >= least * (F.size("xa") + F.size("xb") - shared)).select("a", "b"))

    # marks first, a bit or two for each shingle; only sets of pairs that these leave move
    pairs = written(found.where("b is not null and a <> b").select("a", "b").distinct())
    marked = sides(pairs, of_texts(both(pairs), "binary", _marks, pa.binary())).select("a", "b", F.col("xa").alias("ma"), F.col("xb").alias("mb"))
    links_found = alike(written(marked.mapInArrow(lambda batches: _may_by_marks(batches, least), "a bigint, b bigint")))
    rest = found.where("b is null").select("key", F.col("a").alias("node"), "n", "at")
    if rest.limit(1).count():
        rest = rest.join(of_texts(rest.select("node"), "binary", _marks, pa.binary()).withColumnRenamed("x", "marks"), "node")
        for forest in (True, False):  # the likeliest first, so that few groups are left for all pairs
            more = alike(written(cell_rest(rest, written(components(links_found)), least, cell_size, forest).distinct()))
            links_found = links_found.union(more)
    linked = components(links_found)
    labelled = written(nodes.join(linked.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "low", "own", "copies", F.coalesce("label", "node").alias("label")))
    best = F.min(F.struct(F.col("low").isNull().alias("missing"), "low", "node"))
    heads = labelled.groupBy("label").agg(best.alias("x")).select("label", F.col("x.low").alias("least"), F.col("x.node").alias("keeper"))
    return written(labelled.join(heads, "label").select("node", F.col("least").alias("low"), "keeper", "copies", "own"))


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The rows, with their columns, of the smallest id of each group of similar texts; of rows equal in id and words, one.

    Ids decide, so texts are not read into Python again; only rows of ids that stay in part (repeated rows, texts of one id) are looked at one by one.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    ids = _ids(plain, own, text)
    groups = similar_groups(plain, own, text, k, least, ids=ids)
    judged = groups.where("copies > 1 or node <> keeper").select(F.col("node").alias("judged"), (F.col("node") == F.col("keeper")).alias("stays"), F.col("low").alias("keeps"))
    judged = _near(written(judged))

    def stay(rows: DataFrame, id_col: str) -> DataFrame:
        """The rows with ``stay``."""
        return rows.join(judged, F.col("node") == F.col("judged"), "left").withColumn("stay", F.col("judged").isNull() | (F.col("stays") & F.col(id_col).eqNullSafe(F.col("keeps"))))

    by_id = stay(ids, "id").groupBy("id").agg(F.max("stay").alias("some"), F.min(F.col("stay") & (F.col("n") == 1)).alias("every"))
    changed = written(by_id.where("not every").select("id", "some"))
    kept = _without(plain, own, changed.select("id"))
    in_part = changed.where("some").select(F.col("id").alias("in_part"))
    if in_part.limit(1).count():
        rows = _with_node(plain.join(_near(in_part), F.col(own).eqNullSafe(F.col("in_part")), "left_semi"), plain.columns.index(text))
        kept = kept.union(stay(rows, own).where("stay").dropDuplicates([own, "node"]).select(*plain.columns))
    return kept.toDF(*docs.columns)
