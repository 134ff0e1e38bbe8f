"""Analytics within prompt groups. A group of one has mean 0 and deviation 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def statistics(score: str, by: str) -> tuple[Column, Column, Column]:
    """(count, mean, sample deviation) over the group, singletons guarded."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    return n, F.when(n == 1, 0.0).otherwise(F.avg(score).over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp(score).over(w))


def grpo(df: DataFrame, score: str = "score", by: str = "uid", scale: bool = True) -> DataFrame:
    _, mean, std = statistics(score, by)
    diff = F.col(score) - mean
    return df.withColumn("advantage", diff / (std + EPS) if scale else diff)


def dgrpo(df: DataFrame, score: str = "score", by: str = "uid") -> DataFrame:
    """Weighted by difficulty: 1 up to a mean of 1, falling to a half at 2."""
    _, mean, std = statistics(score, by)
    weight = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - mean)) + 1) / 2
    return df.withColumn("advantage", (F.col(score) - mean) / (std + EPS) * weight)


def pass_k(df: DataFrame, order: list[str], score: str = "score", by: str = "uid", scale: bool = True) -> DataFrame:
    """Only the best row of a group gets the lead over the second; a group of one is an error."""
    w = Window.partitionBy(by)
    ranked = w.orderBy(F.col(score).desc(), *order)
    n, std = F.count(F.lit(1)).over(w), F.stddev_samp(score).over(w)
    lead = F.col(score) - F.lead(score).over(ranked)
    value = F.when(F.row_number().over(ranked) == 1, lead / (std + EPS) if scale else lead).otherwise(0.0)
    return df.withColumn("advantage", F.when(n < 2, F.raise_error(F.lit("a group has fewer than two rows")).cast("double")).otherwise(value))


def rloo(df: DataFrame, score: str = "score", by: str = "uid") -> DataFrame:
    w = Window.partitionBy(by)
    n, mean = F.count(F.lit(1)).over(w), F.avg(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col(score)))


def opo(df: DataFrame, score: str = "score", length: str = "len", by: str = "uid") -> DataFrame:
    """Length-weighted baseline."""
    w = Window.partitionBy(by)
    base = F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w))
    return df.withColumn("advantage", F.col(score) - base)


def keep_spread(df: DataFrame, score: str = "score", by: str = "uid") -> DataFrame:
    """Groups whose scores differ, or of one row."""
    kept = df.groupBy(by).agg(F.min(score).alias("a"), F.max(score).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b or n = 1").select(by)
    return df.join(kept, by, "left_semi")


def whiten(df: DataFrame, x: str, mask: str, shift: bool = True) -> DataFrame:
    """Batch-wide whitening of all rows by the masked mean and variance: one aggregate row meets every row."""
    m, v = F.col(mask).cast("double"), F.col(x)
    s = df.agg(F.sum(m).alias("_n"), F.sum(v * m).alias("_s"), F.sum(v * v * m).alias("_q"))
    mean = F.col("_s") / (F.col("_n") + 1e-8)
    centred = (F.col("_q") - 2 * mean * F.col("_s") + mean * mean * F.col("_n")) / (F.col("_n") + 1e-8)
    s = s.select(mean.alias("_mean"), (centred * F.col("_n") / (F.col("_n") - 1)).alias("_var"))
    out = df.crossJoin(F.broadcast(s))  # a single row
    white = (v - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)
    return out.withColumn("white", white if shift else white + F.col("_mean")).drop("_mean", "_var")


def merge_adjacent(df: DataFrame, by: str, order: str, role: str, merged: str) -> DataFrame:
    """Number turns so that runs of the role ``merged`` share a number."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when((F.col(role) == merged) & (F.lag(role).over(w) == merged), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
