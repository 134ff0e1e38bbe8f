"""Filters, pairs and token rewards of policy training, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import arrays as A

from spindrift.operators.batch import numbered


def refuse(bad: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``bad``."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def preference_pairs(df: DataFrame, by: str = "uid", order: str = "sample", score: str = "score") -> DataFrame:
    """Adjacent rows of a group as pairs: ``pair`` and ``chosen`` (the larger score, the first of equals); an odd group is an error."""
    w = Window.partitionBy(by)
    df = df.withColumn("pair", F.floor((F.row_number().over(w.orderBy(order)) - 1) / 2).cast("long"))
    rank = F.row_number().over(Window.partitionBy(by, "pair").orderBy(F.col(score).desc(), order))
    return df.withColumn("chosen", refuse(F.count(F.lit(1)).over(w) % 2 == 1, "a group has an odd number of rows", (rank == 1).cast("double")).cast("int"))


def split_pairs(df: DataFrame, columns: list[str], by: str = "uid") -> DataFrame:
    """Pairs to one row each: every column as chosen_<name> and rejected_<name>."""
    side = lambda c, k: F.max(F.when(F.col("chosen") == k, F.col(c)))
    return df.groupBy(by, "pair").agg(*[side(c, k).alias(f"{n}_{c}") for n, k in (("chosen", 1), ("rejected", 0)) for c in columns])


def fill_groups(df: DataFrame, size: int, per_group: int, most_batches: int, batch: str = "batch", by: str = "uid", order: str = "sample", score: str = "score") -> DataFrame:
    """Groups whose scores differ (or of one row), batch after batch until there are ``size`` of them, cut to ``size * per_group`` rows; too few in ``most_batches`` is an error."""
    kept = df.groupBy(batch, by).agg((F.min(score) < F.max(score)).alias("a"), F.count(F.lit(1)).alias("n")).where("a or n = 1")
    first = kept.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).join(df.select(batch).distinct().orderBy(batch).limit(most_batches), batch, "right")
    seen, end = 0, None
    for r in first.orderBy(batch).collect():  # at most ``most_batches`` rows
        seen, end = seen + (r.n or 0), r[batch]
        if seen >= size:
            break
    else:
        raise ValueError(f"{seen} groups in {most_batches} batches, {size} are needed")
    rows = df.join(kept.where(F.col(batch) <= end).select(by), by, "left_semi").where(F.col(batch) <= end)
    return rows.orderBy(batch, by, order).limit(size * per_group)


def oversampled(df: DataFrame, low: float, high: float, longest: int, factor: int, by: str = "uid", order: str = "sample", right: str = "acc", length: str = "len") -> DataFrame:
    """The rows of groups of middling accuracy and no overlong text first, then others, by group: the first ``1 / factor`` of all rows, with ``ok``."""
    w = Window.partitionBy(by)
    ok = F.avg(right).over(w).between(low, high) & (F.max(length).over(w) < longest - 1)
    out = df.withColumn("_after", (~ok).cast("int"))
    return numbered(out, "_after", by, order).where(F.col("rn") < df.count() // factor).withColumn("ok", 1 - F.col("_after")).drop("_after", "rn")


def interleave(df: DataFrame, kind: str, kinds: tuple[str, str], order: list[str]) -> DataFrame:
    """Rows of two kinds in turn, each in the given (shuffled) order; the longer kind is cut; if one is missing, the other as it is. ``place`` from 0."""
    parts = [numbered(df.where(F.col(kind) == k), *order, name="_i").withColumn("place", F.col("_i") * 2 + j) for j, k in enumerate(kinds)]
    sizes = [p.count() for p in parts]
    if not min(sizes):
        return parts[sizes.index(max(sizes))].withColumn("place", F.col("_i")).drop("_i")
    return parts[0].unionByName(parts[1]).where(F.col("_i") < min(sizes)).drop("_i")


def soft_mean(df: DataFrame, beta: float, score: str = "score") -> DataFrame:
    """Advantage over the batch's soft mean, log(mean(exp(beta x))) / beta; the mean at beta 0."""
    if beta == 0:
        one = df.agg(F.avg(score).alias("_m"))
    else:
        x = F.col(score) * beta
        top = df.agg(F.max(x).alias("_t"))
        one = df.crossJoin(F.broadcast(top)).groupBy("_t").agg(F.avg(F.exp(x - F.col("_t"))).alias("_e")).select(((F.col("_t") + F.log("_e")) / beta).alias("_m"))
    return df.crossJoin(F.broadcast(one)).withColumn("advantage", F.col(score) - F.col("_m")).drop("_m")  # a single row


def later(by: str, order: str) -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def implicit_rewards(df: DataFrame, beta: float, lam: float = 0.0, use_truth: bool = False, granularity: str = "token", by: str = "uid", pos: str = "pos") -> DataFrame:
    """Token rewards from ``new_lp`` and ``old_lp`` where ``mask`` is 1 (a prefix of the sequence).

    q is the difference; beyond the response it is 0. With ``lam`` the reward is
    the sum of lam**j * q over later tokens; ``use_truth`` sets the last token's q so that
    all add up to ``acc``. "token": every token but the last; "whole": the last token alone, with its own reward.
    """
    w = Window.partitionBy(by)
    n = F.sum("mask").over(w)
    out = df.withColumns({"_q": (F.col("new_lp") - F.col("old_lp")) * F.col("mask") * beta, "_n": n})
    if lam:
        if use_truth:
            before = F.sum(F.when(F.col(pos) < F.col("_n"), F.col("_q")).otherwise(0.0)).over(w)
            out = out.withColumn("_q", F.when((F.col(pos) == F.col("_n")), F.col("acc") - before).otherwise(F.col("_q")))
        # one fold from the end over a sequence's rows
        held = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_at"), F.struct(*out.columns).alias("_row"))))
        whole = out.groupBy(F.col(by).alias("_by")).agg(F.transform(held, lambda x: x["_row"]).alias("_row"))
        sums = A.fold_back(F.transform("_row", lambda r: r["_q"]), F.lit(0.0), lambda carry, x: x + lam * carry)
        each = whole.select(F.explode(F.arrays_zip("_row", sums.alias("_sum"))).alias("_x"))
        out = each.select("_x._row.*", F.col("_x._sum").alias("_folded")).drop("_q").withColumnRenamed("_folded", "_q")
    if granularity == "token":
        keep = F.col(pos) < F.col("_n")
    elif granularity == "whole":
        keep = F.col(pos) == F.col("_n")
    else:
        raise ValueError(granularity)
    return out.withColumn("reward_token", F.when(keep, F.col("_q")).otherwise(0.0)).drop("_q", "_n")


def prime_rloo(df: DataFrame, model: float, truth: float, group: str = "group", by: str = "uid", pos: str = "pos") -> DataFrame:
    """Returns of two reward sources, each less its leave-one-out baseline within a group, weighted and summed from the end.

    ``rm`` stands on every token of the mask, ``acc`` on the last one. A source's
    value x becomes x * n / (n - 1) less the sum of the sequences' means over n - 1.
    """
    w, g = Window.partitionBy(by), Window.partitionBy(group)
    out = df.withColumns({"_n": F.sum("mask").over(w)})
    last = (F.col(pos) == F.col("_n")).cast("int")
    out = out.withColumns({"_last": last, "_rm": F.sum(F.col("rm") * F.col("mask")).over(w) / F.col("_n")})
    out = out.withColumn("_k", F.sum(last).over(g))  # sequences of the group
    less = lambda x, total, on: (x * F.col("_k") / (F.col("_k") - 1) - total / (F.col("_k") - 1)) * on
    a = less(F.col("rm"), F.sum(F.col("_rm") * F.col("_last")).over(g), F.col("mask")) * model
    b = less(F.col("acc"), F.sum(F.col("acc") * F.col("_last")).over(g), F.col("_last")) * truth
    out = out.withColumn("_x", (a + b) * F.col("mask"))
    return out.withColumn("returns", F.sum("_x").over(later(by, pos))).drop("_n", "_last", "_rm", "_k", "_x")
