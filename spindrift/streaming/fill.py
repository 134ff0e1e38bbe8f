"""Training batches filled from batches of generated groups, as a batch and as keyed state over micro-batches.

A log has a row for each group of answers to a prompt: run, gen (number of the generated batch), place (within it), uid,
scores. A group is kept if its scores differ or if it has one alone. When a generated batch is whole (``gen_size``
groups), kept groups fill training batches of ``size`` groups, in order.

As shipped (``carry=False``) the first ``size`` groups make a training batch as soon as there are that many, and those
left over are dropped; with ``carry`` they begin the next one. A generated batch that is not whole fills nothing.
``max_gens`` over 0: a training batch that is not full after so many generated batches is an error.
Result: run, step, slot, uid, gen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

TOO_MANY = "too many generated batches for one training batch: are the data too hard?"


def keeps(scores: Column) -> Column:
    """Whether a group's scores say anything: they differ, or there is one."""
    return F.coalesce((F.size(scores) == 1) | (F.array_min(scores) != F.array_max(scores)), F.lit(False))


def filled(log: DataFrame, size: int, gen_size: int, carry: bool = False, max_gens: int = 0) -> DataFrame:
    """All training batches that a log fills. Groups meet by run and generated batch; what is sequential has a row a generated batch."""
    good = F.sum(F.col("keep").cast("long"))
    marked = log.withColumn("keep", keeps(F.col("scores")))
    gens = marked.groupBy("run", "gen").agg(F.count(F.lit(1)).alias("n"), good.alias("kept")).where(F.col("n") == gen_size)

    def step(acc: Column, g: Column) -> Column:
        have = acc["have"] + g["kept"]
        full = F.floor(have / size) if carry else (have >= size).cast("long")
        used = acc["used"] + 1
        left = F.when(full == 0, have).otherwise(have - full * size if carry else F.lit(0).cast("long"))
        place = F.struct(g["gen"].alias("gen"), acc["step"].alias("step"), acc["have"].alias("before"))
        tries = F.when(full > 0, 0).otherwise(used).cast("long")
        return F.struct(left.cast("long").alias("have"), (acc["step"] + full).cast("long").alias("step"), tries.alias("used"), F.greatest(acc["most"], tries).alias("most"), F.array_append(acc["at"], place).alias("at"))

    zero = F.lit(0).cast("long")
    kind = log.schema["gen"].dataType.simpleString()
    start = F.struct(zero.alias("have"), zero.alias("step"), zero.alias("used"), zero.alias("most"), F.array().cast(f"array<struct<gen:{kind},step:bigint,before:bigint>>").alias("at"))
    order = F.sort_array(F.collect_list(F.struct("gen", "kept")))
    folded = gens.groupBy("run").agg(F.aggregate(order, start, step).alias("x")).select(F.col("run").alias("r"), "x.*")
    if max_gens > 0 and (folded.agg(F.max("most")).first()[0] or 0) >= max_gens:
        raise ValueError(TOO_MANY)
    folded = folded.select("r", F.col("step").alias("steps"), F.explode("at").alias("at")).select("r", "steps", "at.*")
    before = F.row_number().over(Window.partitionBy("run", "gen").orderBy("place")) - 1
    rows = marked.where("keep").select("run", "gen", "uid", before.alias("nth")).join(folded.withColumnRenamed("gen", "g"), (F.col("run") == F.col("r")) & (F.col("gen") == F.col("g")))
    rows = rows.withColumn("at", F.col("before") + F.col("nth"))
    rows = rows.withColumns({"slot": F.col("at") % size, "own": F.col("step") + F.floor(F.col("at") / size)} if carry else {"slot": F.col("at"), "own": F.col("step")})
    return rows.where((F.col("own") < F.col("steps")) & (F.col("slot") < size)).select("run", F.col("own").cast("long").alias("step"), F.col("slot").cast("long").alias("slot"), "uid", "gen")


class _Fill(StatefulProcessor):
    """State of a run: (training batch, generated batches used, groups seen of the open one) and a list of the kept groups that wait."""

    def __init__(self, size: int, gen_size: int, carry: bool, max_gens: int):
        self.size, self.gen_size, self.carry, self.max_gens = size, gen_size, carry, max_gens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "step bigint, used bigint, seen bigint")
        self.waiting = handle.getListState("waiting", "uid bigint, gen bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, used, seen = self.at.get() if self.at.exists() else (0, 0, 0)
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for e in pd.concat(rows).sort_values(["gen", "place"]).itertuples():
            if e.keep:
                held.append((int(e.uid), int(e.gen)))
            seen += 1
            if seen < self.gen_size:
                continue
            seen, used = 0, used + 1
            if self.max_gens > 0 and used >= self.max_gens and len(held) < self.size:
                raise ValueError(TOO_MANY)
            while len(held) >= self.size:
                out += [(key[0], step, i, *g) for i, g in enumerate(held[: self.size])]
                held, step, used = held[self.size :] if self.carry else [], step + 1, 0
        self.at.update((step, used, seen))
        self.waiting.put(held) if held else self.waiting.clear()
        yield pd.DataFrame(out, columns=["run", "step", "slot", "uid", "gen"])

    def close(self) -> None:
        pass


def stream(log: DataFrame, size: int, gen_size: int, carry: bool = False, max_gens: int = 0) -> DataFrame:
    """The same on a stream of the log (uid and gen bigint); a run's groups must arrive in order of gen and place."""
    out = StructType([log.schema["run"], *[StructField(c, LongType()) for c in ("step", "slot", "uid", "gen")]])
    marked = log.select("run", "gen", "place", "uid", keeps(F.col("scores")).alias("keep"))
    return marked.groupBy("run").transformWithStateInPandas(_Fill(size, gen_size, carry, max_gens), out, "append", "None")
