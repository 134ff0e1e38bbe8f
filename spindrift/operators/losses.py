"""Losses and penalties of whole batches of token rows (uid, ...): what is one number for a batch is one aggregate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import arrays as A

EPS = 1e-8


def mean_of_sequences(rows: DataFrame, x: Column, mask: str = "mask", by: str = "uid") -> DataFrame:
    """One row: the mean over sequences of their masked means (``mean``), and how many there are (``n``)."""
    each = rows.groupBy(by).agg((F.sum(x * F.col(mask)) / (F.sum(mask) + EPS)).alias("m"))
    return each.agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("n"))


def next_coefficient(value: Column | float, kl: Column, n: Column, target: float, horizon: float) -> Column:
    """The adaptive controller's step; see ``streaming.turns.adaptive_kl`` for many."""
    value = F.lit(value) if isinstance(value, float) else value
    return value * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), kl / target - 1)) * n / horizon)


def kl_penalised(rows: DataFrame, beta: float, kind: str = "k1", score: str = "reward", old: str = "old_lp", ref: str = "new_lp", mask: str = "mask", by: str = "uid", target: float | None = None, horizon: float = 10_000.0) -> DataFrame:
    """Rows with ``penalised``, the score less beta times the masked KL, and of the batch ``batch_kl`` and the coefficient it leaves.

    Without a target the coefficient is fixed.
    """
    kl = A.kl(F.col(old), F.col(ref), kind) * F.col(mask)
    whole = mean_of_sequences(rows, kl, mask, by)
    after = F.lit(beta) if target is None else next_coefficient(beta, F.col("mean"), F.col("n"), target, horizon)
    whole = whole.select(F.col("mean").alias("batch_kl"), after.alias("next_beta"))
    return rows.withColumn("penalised", F.col(score) - beta * kl).crossJoin(F.broadcast(whole))  # one row


def value_loss(rows: DataFrame, predicted: Column, values: Column, returns: Column, clip: float, mask: str = "mask") -> DataFrame:
    """One row: half the masked mean of the larger of the plain and the clipped squared error, and the share where clipping is larger."""
    cut = F.greatest(values - clip, F.least(values + clip, predicted))
    plain, clipped = (predicted - returns) * (predicted - returns), (cut - returns) * (cut - returns)
    n, m = F.sum(mask) + EPS, F.col(mask)
    return rows.agg((0.5 * F.sum(F.greatest(plain, clipped) * m) / F.sum(mask)).alias("loss"), (F.sum((clipped > plain).cast("int") * m) / n).alias("clipped"))


def sft_step(rows: DataFrame, loss: Column, mask: str, worker: str, micro: str, balanced: bool = False) -> DataFrame:
    """One row: a training step's loss, the mean over micro-batches and then over workers.

    A micro-batch's loss is the sum over its masked tokens by their number, or if ``balanced`` by their number on all
    workers and times the workers.
    """
    parts = rows.groupBy(worker, micro).agg(F.sum(loss * F.col(mask)).alias("s"), F.sum(mask).alias("n"))
    if balanced:
        every = rows.groupBy(F.col(micro).alias("_micro")).agg(F.sum(mask).alias("all"))
        workers = rows.agg(F.count_distinct(worker).alias("workers"))
        parts = parts.join(every, F.col(micro) == F.col("_micro")).crossJoin(F.broadcast(workers))  # one row
        each = F.col("s") / (F.col("all") + EPS) * F.col("workers")
    else:
        each = F.col("s") / (F.col("n") + EPS)
    return parts.groupBy(worker).agg(F.avg(each).alias("l")).agg(F.avg("l").alias("loss"))


def pair_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0, reference_free: bool = False) -> Column:
    """Loss of a preference pair; without a reference its ratio counts as 0."""
    ratio = chosen - rejected
    return A.dpo_loss(ratio if reference_free else ratio - (ref_chosen - ref_rejected), beta, kind, smoothing)


def sequence_logp(logp: Column, labels: Column, average: bool = False, ignored: int = -100) -> Column:
    """Sum (or mean) of the log-probabilities of a sequence's labels after the first; ignored labels count nowhere."""
    n = F.size(labels) - 1
    kept = F.zip_with(F.slice(logp, F.lit(2), F.greatest(n, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(n, F.lit(0))), lambda p, y: F.when(y != ignored, p))
    kept = F.filter(kept, lambda p: p.isNotNull())
    return A.total(kept) / F.greatest(F.size(kept), F.lit(1)) if average else A.total(kept)
