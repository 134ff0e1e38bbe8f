"""Batch algebra. Every positional operator takes an explicit order column ``rn`` (0, 1, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task numbers, and the most ranges that numbering cuts an order into.
RANGE_ROWS, MOST_RANGES = 100_000, 16_384


def range_of(bounds: Column, steps: int, key: Column) -> Column:
    """How many of at most ``2**steps - 1`` sorted bounds are not above the key, by halving."""
    sizes = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(sizes, F.lit(0), lambda at, size: F.when(F.get(bounds, at + size - 1) <= key, at + size).otherwise(at))


def numbered(df: DataFrame, *order: str, by: list[str] | None = None, name: str = "rn", rows: int = RANGE_ROWS) -> DataFrame:
    """Number rows from 0 in a total order, within groups if ``by`` is given.

    Without groups the order is cut into ranges of about ``rows`` rows, at
    bounds taken from a sample and then fixed in the plan. A row's range depends
    on its key alone, so its number is its place in the range plus the rows of
    earlier ranges, however Spark lays out or repeats a stage. Rows of equal
    keys are numbered in any order; nulls come first.
    """
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    n = df.count()
    ranges = min(-(-n // rows), MOST_RANGES)
    if ranges <= 1:  # at most ``rows`` rows
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    kinds = [df.schema[c].dataType for c in order]
    sample = df.select(*order).sample(min(1.0, 32 * ranges / n), 7).orderBy(*order).collect()
    cuts = sorted({len(sample) * k // ranges for k in range(1, ranges)}) if sample else []
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(sample[k], kinds, order, strict=True)]) for k in cuts])
    inner = f"_range_{name}"
    ranged = df.withColumn(inner, range_of(bounds, len(cuts).bit_length(), F.struct(*order)) if cuts else F.lit(0))
    sizes = ranged.groupBy(F.col(inner).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(inner).orderBy(*order)) - 1
    out = ranged.withColumn(name, place).join(F.broadcast(sizes.select("_q", before.alias("_before"))), F.col(inner) == F.col("_q"))
    return out.withColumn(name, (F.col("_before") + F.col(name)).cast("long")).drop(inner, "_q", "_before")


def running_sum(df: DataFrame, value: Column, *order: str, name: str = "total", rows: int = RANGE_ROWS) -> DataFrame:
    """The sum of ``value`` up to each row in a total order: within ranges of ``rows`` rows, on top of the sums of the ranges before."""
    place = numbered(df.withColumn("_v", value), *order, name="_rn", rows=rows).withColumn("_range", F.floor(F.col("_rn") / rows))
    whole = place.groupBy(F.col("_range").alias("_r")).agg(F.sum("_v").alias("_s"))  # one row a range
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.sum("_v").over(Window.partitionBy("_range").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0))
    out = place.withColumn(name, inside).join(F.broadcast(whole.select("_r", before.alias("_before"))), F.col("_range") == F.col("_r"))
    return out.withColumn(name, F.col("_before") + F.col(name)).drop("_v", "_rn", "_range", "_r", "_before")


def pop(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(*columns), df.drop(*columns)


def keys(df: DataFrame) -> DataFrame:
    """(name, n): the columns and how many rows have a value in each."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("n")) for i, c in enumerate(df.columns)])).alias("k")).select("k.*")


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("lists must have equal length")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        if set(p.columns) != set(out.columns):
            raise ValueError("columns differ")
        out = out.unionByName(p)
    return out


def chunk_id(rn: Column, n: Column | int, parts: int) -> Column:
    """Which of ``parts`` equal contiguous pieces a row falls in."""
    return F.floor(rn * parts / n).cast("long")


def pad_to_multiple(df: DataFrame, multiple: int, rn: str = "rn") -> DataFrame:
    """Repeat rows from the start, cyclically, up to a multiple; an empty input is unchanged."""
    n = df.count()
    if not n or n % multiple == 0:
        return df
    need = multiple - n % multiple
    copies = F.floor((F.lit(need - 1) - F.col(rn)) / n) + 1
    extra = df.where(F.col(rn) < need).withColumn("_k", F.explode(F.sequence(F.lit(1), copies.cast("int")))).withColumn(rn, F.col(rn) + F.col("_k") * n).drop("_k")
    return df.unionByName(extra)


def unpad(df: DataFrame, size: int, rn: str = "rn") -> DataFrame:
    """Drop the last ``size`` rows."""
    return df.where(F.col(rn) < df.count() - size)


def pad_edge(df: DataFrame, size: int, which: str, rn: str = "rn") -> DataFrame:
    """Repeat the first row ("first") or the last one (anything else) ``size`` times."""
    n = df.count()
    edge = 0 if which == "first" else n - 1
    extra = df.where(F.col(rn) == edge).withColumn(rn, F.explode(F.sequence(F.lit(n), F.lit(n + size - 1)).cast("array<bigint>")))
    return df.unionByName(extra)


def repeat(df: DataFrame, times: int, interleave: bool = True, rn: str = "rn") -> DataFrame:
    """Each row ``times`` times: aabb (interleaved) or abab (tiled)."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(rn) * times + F.col("_k") if interleave else F.col("_k") * F.lit(df.count()) + F.col(rn)
    return out.withColumn(rn, place.cast("long")).drop("_k")


def repeat_by(df: DataFrame, times: Column) -> DataFrame:
    """Rows by their own count; 0 drops the row. Adds ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int = 1, rn: str = "rn") -> DataFrame:
    """Python's slice; negative bounds count from the end."""
    first, end, step = slice(start, stop, step).indices(df.count())
    inside = (F.col(rn) >= first) & (F.col(rn) < end) if step > 0 else (F.col(rn) <= first) & (F.col(rn) > end)
    return df.where(inside & (F.pmod(F.col(rn) - first, F.lit(abs(step))) == 0))


def reorder(df: DataFrame, order: DataFrame, rn: str = "rn") -> DataFrame:
    """``order`` (pos, idx): the row at ``idx`` goes to ``pos``."""
    return df.join(order, df[rn] == order["idx"]).drop("idx", rn).withColumnRenamed("pos", rn)


def inverse(order: DataFrame) -> DataFrame:
    return order.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Column union by row key; a shared column must agree (null-safe) on every row."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(r, key)
    for c in shared:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")))).drop(f"_r_{c}")
    return out


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as one aggregate with a map-side half."""
    rest = [c for c in df.columns if c != key]
    best = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_r")))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b._r.*")


def minibatches(df: DataFrame, size: int, epochs: int, rn: str = "rn") -> DataFrame:
    """Rows with (epoch, batch); the size must divide the number of rows."""
    if df.count() % size:
        raise ValueError("the size must divide the number of rows")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(rn) / size).cast("long"))


def dispatch(df: DataFrame, mode: str, ranks: int, rn: str = "rn") -> DataFrame:
    """Rows with the ``rank`` that gets them: "all" copies them to every rank, "zero" gives them to the first, "split" cuts
    them into equal contiguous pieces (an error if the ranks do not divide them), "split_padded" repeats rows from the start first.
    """
    if mode == "all":
        return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)).cast("array<bigint>")))
    if mode == "zero":
        return df.withColumn("rank", F.lit(0).cast("long"))
    if mode not in ("split", "split_padded"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "split_padded":
        df = pad_to_multiple(df, ranks, rn)
    n = df.count()
    if n % ranks:
        raise ValueError("the ranks must divide the rows")
    return df.withColumn("rank", chunk_id(F.col(rn), max(n, 1), ranks))
