"""Balanced partitions of token counts, and weighted resampling."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k-way largest differencing (Karmarkar-Karp): join the two states of the largest spread, heavy against light.

    Ties: the state whose heaviest part has the larger sum, then more items, then larger items.
    """
    if equal and len(lengths) % k:
        raise ValueError("the parts must divide the items")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    step = k if equal else 1

    def entry(parts: list[tuple[int, int, tuple]]) -> tuple:
        parts = sorted(parts, reverse=True)
        total, size, items = parts[0]
        return parts[-1][0] - total, -total, -size, tuple((-i, -n) for i, n in items), parts

    heap = []
    for at in range(0, len(order), step):
        own = [(lengths[i], 1, ((i, lengths[i]),)) for i in order[at : at + step]]
        heapq.heappush(heap, entry(own + [(0, 0, ())] * (k - len(own))))
    while len(heap) > 1:
        heavy, light = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        heapq.heappush(heap, entry([(a + b, m + n, x + y) for (a, m, x), (b, n, y) in zip(heavy, reversed(light), strict=True)]))
    return [[i for i, _ in items] for _, _, items in heap[0][-1]] if heap else [[] for _ in range(k)]


def lightest(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item in turn to the lightest part, the first of equals; with ``equal`` a bias keeps sizes level."""
    bias = sum(lengths) + 1 if equal else 0
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i, n in enumerate(lengths):
        total, j = heap[0]
        parts[j].append(i)
        heapq.heapreplace(heap, (total + n + bias, j))
    return parts


def balanced(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Differencing with checks; items sorted within parts."""
    if len(lengths) < k:
        raise ValueError("fewer items than parts")
    parts = [sorted(p) for p in differencing(lengths, k, equal)]
    if not all(parts) or sorted(i for p in parts for i in p) != list(range(len(lengths))):
        raise ValueError("a part is empty or an item is lost")
    return parts


def micro(lengths: list[int], budget: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """As many parts as the token budget asks for, at most one a row."""
    n = min(len(lengths), -(-sum(lengths) // budget))
    n = max(least, n)
    return balanced(lengths, -(-n // multiple) * multiple)


def partition(df: DataFrame, kind: str, k: int = 4, budget: int = 200) -> DataFrame:
    """(batch, item, len) to (batch, item, part), each batch in one group: a batch is one training step's rows."""
    ways = {"kk": lambda n: differencing(n, min(k, len(n))), "greedy": lambda n: lightest(n, k), "balanced": lambda n: balanced(n, min(k, len(n))), "micro": lambda n: micro(n, budget)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        part = np.zeros(len(rows), np.int64)
        for p, items in enumerate(ways[kind](rows["len"].tolist())):
            part[items] = p
        return pd.DataFrame({"batch": rows["batch"], "item": rows["item"], "part": part})

    return df.groupBy("batch").applyInPandas(run, "batch bigint, item bigint, part bigint")


#: Rows of a block of ``resample``, about, and most copies that one task makes of a row at once.
BLOCK, PIECE = 32_768, 65_536


def multinomial(weights: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of n draws with replacement by weight: a tree of sums, each node's draws split by a binomial draw between its halves."""
    size = 1 << max(0, len(weights) - 1).bit_length()
    sums = [np.concatenate([np.asarray(weights, dtype=float), np.zeros(size - len(weights))])]
    while len(sums[-1]) > 1:
        sums.append(sums[-1][::2] + sums[-1][1::2])
    counts = np.array([n], dtype=np.int64)
    for below, total in zip(sums[-2::-1], sums[:0:-1], strict=True):
        left = rng.binomial(counts, np.divide(below[::2], total, out=np.zeros(len(total)), where=total > 0))
        counts = np.stack([left, counts - left], axis=1).ravel()
    return counts[: len(weights)]


def resample(df: DataFrame, weight: str, order: list[str], seed: int) -> DataFrame:
    """As many rows as came in, drawn with replacement by weight; ``copy`` numbers the draws of a row from 1.

    Rows are dealt to blocks by a hash of ``order``, a key. The driver deals the
    draws to blocks by their weights (one number a block), each block deals its
    own to rows: exact multinomial counts without a bound. A row drawn more often
    than ``PIECE`` is copied in pieces by several tasks. A null weight is 0; a
    negative, infinite or undefined one, or none above 0, is an error.
    """
    n = df.count()
    parts = max(1, -(-n // BLOCK))
    blocked = df.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(parts)).cast("long"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    stats = blocked.groupBy("_block").agg(F.sum(w).alias("w"), F.min(w).alias("low"), F.max(F.isnan(w)).alias("nan")).collect()
    total = sum(r.w for r in stats)
    if n and (not 0 < total < float("inf") or any(r.low < 0 or r.nan for r in stats)):
        raise ValueError("weights must be finite, not negative and not all 0")
    sums = np.zeros(parts)
    for r in stats:
        sums[r["_block"]] = r.w
    draws = multinomial(sums, n, np.random.default_rng(seed))

    def deal(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in order])
        own = block["_block"][0].as_py()
        weights = block[weight].cast(pa.float64()).fill_null(0.0).to_numpy()
        times = multinomial(weights, int(draws[own]), np.random.default_rng([seed, own]))
        return block.append_column("_times", pa.array(times)).filter(pa.array(times > 0))

    schema = StructType([*blocked.schema.fields]).add("_times", LongType())
    dealt = blocked.groupBy("_block").applyInArrow(deal, schema)
    pieces = dealt.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / PIECE)))).repartition(*order, "_piece")
    first = F.col("_piece") * PIECE + 1
    return pieces.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("_times"), first + PIECE - 1)))).drop("_block", "_times", "_piece")


def imbalance(df: DataFrame, k: int = 4) -> DataFrame:
    """(batch, item, len) to the spread of token sums over k pieces, as they come and after differencing.

    A batch of fewer than k items goes in as many parts as it has items.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows.sort_values("item")["len"].tolist()
        parts = min(k, len(lengths))
        size = len(lengths) // parts
        plain = [sum(lengths[i : i + size]) for i in range(0, len(lengths), size)]
        even = [sum(lengths[i] for i in p) for p in balanced(lengths, parts)]
        return pd.DataFrame({"batch": [rows["batch"].iloc[0]], "min": [min(plain)], "max": [max(plain)], "minmax_diff": [max(plain) - min(plain)], "balanced_min": [min(even)], "balanced_max": [max(even)], "balance_minmax_diff": [max(even) - min(even)], "mean": [sum(lengths) / parts]})

    return df.groupBy("batch").applyInPandas(run, "batch bigint, min bigint, max bigint, minmax_diff bigint, balanced_min bigint, balanced_max bigint, balance_minmax_diff bigint, mean double")
