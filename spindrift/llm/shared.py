"""Helpers that the operators share: checkpoints, byte-level text access, hashing.

Conventions of every operator here: a null text counts as an empty one, a null
id as an id of its own, other columns of the input are neither read nor
returned, and an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds at once (a longer single text is held whole).
CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, cols: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift-{uuid.uuid4().hex}"
    (df.select(*cols) if cols else df).write.parquet(path, compression=codec)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.select(*cols).schema if cols else df.schema).parquet(path)


#: Tables that ``written`` made, by application, in order.
_WRITTEN: dict[str, list[str]] = {}


def tables_written(spark: SparkSession) -> list[str]:
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN[spark.sparkContext.applicationId].remove(path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, sample_bytes: int, long_bytes: int) -> tuple[list[tuple[bytes, int]], float]:
    """((text, label) pairs whose crc32(id) mod 4 is not 2, share of label 1 among all such labels).

    The sample is bounded before it leaves the executors: at most ``per_class``
    texts and half of ``sample_bytes`` of each class, in the order of a hash of
    the id; texts of over ``long_bytes`` come last, the shorter first, so that they
    are used only where a class has too few others. Of twice ``per_class`` ids
    of each class those not in ``docs`` fall out. Of an id with several labels the
    largest counts, of one with several texts the least; null labels and null
    ids are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, 4) != 2)).groupBy(F.col(id_col).alias("k")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = [known.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(2 * per_class) for c in (0, 1)]
    chosen = F.broadcast(each[0].union(each[1]))  # at most 4 * per_class ids
    texts = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).join(chosen, F.col("i") == F.col("k"))
    texts = texts.groupBy("i", "y").agg(F.min("t").alias("t")).select("i", "y", "t", F.xxhash64("i").alias("h"), F.octet_length("t").alias("n"))
    order = Window.partitionBy("y").orderBy(F.greatest("n", F.lit(long_bytes)), "h", "i")
    ranked = texts.select("h", "i", "y", "t", F.row_number().over(order).alias("nth"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    rows = ranked.where((F.col("nth") <= per_class) & (F.col("bytes") <= sample_bytes // 2)).collect()
    return [(r.t.encode(), r.y) for r in sorted(rows, key=lambda r: (r.h, r.i))], totals.get(1, 0) / max(1, sum(totals.values()))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of runs of rows whose texts hold about ``limit`` bytes."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=width, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


class Words:
    """Words (runs without ASCII white space) of a chunk of texts, as arrays.

    starts, ends: byte positions; doc: row in the chunk; first: number of the
    first word of each row (length rows + 1).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(data)
        solid = ~_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] = solid[cuts]
        self.starts = np.flatnonzero(begin)
        stop = np.zeros(n + 1, dtype=bool)
        stop[1:n] = solid[:-1] & (~solid[1:] | begin[1:])
        if n:
            stop[n] = solid[-1]
        self.ends = np.flatnonzero(stop)
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = _power(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * down[self.starts])

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and the number of each one's first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out, factor = np.zeros(n, np.uint64), 1
        for j in range(k):
            out += hashes[j : j + n] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix64(out[at]), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    if not len(starts) or not (total := int(lengths.sum())):
        return np.zeros(0, np.int64)
    lead = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - lead, lengths)
