"""A sampler class: dear orders first in even epochs, cheap ones in odd epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.operators.plugins import Sampler


class DearFirst(Sampler):
    def order(self, epoch: int) -> Column:
        return F.col("o_totalprice") * (1 if epoch % 2 else -1)
