"""Temporal spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4


def overlap(ps: Column, pe: Column, gs: Column, ge: Column) -> tuple[Column, Column, Column]:
    """(IoU, precision, recall); -2 for a bad truth, -1 for a bad prediction. The epsilons are part of the result."""
    inter = F.greatest(F.lit(0.0), F.least(pe, ge) - F.greatest(ps, gs))
    lp, lg = F.greatest(pe - ps, F.lit(0.0)) + EPS, F.greatest(ge - gs, F.lit(0.0)) + EPS
    union = lp + lg - inter + EPS
    guard = lambda x: F.when(gs > ge, -2.0).when((pe == -1) | (ps > pe), -1.0).otherwise(x)
    return guard(inter / union), guard(inter / lp), guard(inter / lg)


def cut_linear(x: Column, lo: float = 0.2, hi: float = 0.8) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def recall_at(iou: Column, t: float) -> Column:
    return (iou >= t).cast("int")
