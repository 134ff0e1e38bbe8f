"""Views derived from the test tables; registry.VIEWS has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.plans.registry import table


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.row_number().over(w).cast("long").alias("sample"), (F.col("l_quantity") / 25).alias("score"), (F.col("l_linenumber") * 10).alias("len"), (F.col("l_returnflag") == "R").cast("int").alias("acc"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("uid"), F.row_number().over(w).cast("long").alias("pos"), (F.col("value") / 100).alias("reward"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("v"),
        (F.col("event_type") != "error").cast("int").alias("mask"), (-(F.col("event_id") % 7) / 10.0).alias("old_lp"), (-(F.col("event_id") % 5) / 10.0).alias("new_lp"), "event_type",
    )


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Array layout of ``tokens``: one row per uid."""
    items = F.sort_array(F.collect_list(F.struct("pos", "reward", "v", "mask", "old_lp", "new_lp")))
    out = tokens(spark, d).groupBy("uid").agg(items.alias("x"))
    return out.select("uid", *[F.col(f"x.{c}").alias(c) for c in ("reward", "v", "mask", "old_lp", "new_lp")])


def row_id() -> F.Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def spans(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        row_id().alias("id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", q.alias("gs"), (q + F.round(F.col("l_tax") * 100) - 1).alias("ge"),
        (q + n - 3).alias("ps"), (q + n - 3 + F.round(F.col("l_discount") * 100) - 1).alias("pe"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("long").cast("string")
    p, e, kind = whole("ps"), whole("pe"), F.col("l_partkey") % 5
    shape = (
        F.when(kind == 0, F.concat(F.lit("happens in "), p, F.lit(" - "), e)).when(kind == 1, F.concat(F.lit("From "), p, F.lit(" to "), e)).when(kind == 2, F.lit("unknown"))
        .when(kind == 3, F.concat(p, F.lit(".50s then "), e, F.lit(" end"))).otherwise(F.concat(F.lit("start "), p, F.lit("\nend "), e))
    )
    lead = F.when(F.col("l_suppkey") % 2 == 0, "<answer>").otherwise("")
    return spans(spark, d).withColumns({"answer": F.concat(F.lit("["), whole("gs"), F.lit(", "), whole("ge"), F.lit("]")), "pred": F.concat(lead, shape)})


def choices(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.substring(F.lit("ABCD"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    kind = F.col("l_linenumber") % 4
    said = F.when(kind == 0, F.concat(F.lit("The answer is "), of("l_suppkey"))).when(kind == 1, F.concat(F.lit("  Best option: "), of("l_partkey"), F.lit("."))).when(kind == 2, F.lit("one two three four five six seven eight nine ten eleven")).otherwise(F.lit("From the list Answer B"))
    return table(spark, d, "lineitem").select(row_id().alias("id"), F.col("l_returnflag").alias("kind"), of("l_partkey").alias("gold"), said.alias("said"))
