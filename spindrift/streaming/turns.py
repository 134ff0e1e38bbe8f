"""Replay of recorded turns, as a batch fold and as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from spindrift.functions import text as T
from spindrift.operators.batch import running_sum

COUNTERS = "uid bigint, turns bigint, valid bigint, calls bigint, answered boolean"


def replay(log: DataFrame, limit: int = 1 << 30) -> DataFrame:
    """Counters per uid of a log (uid, pos, kind): turns up to the first answer or the limit."""
    before = F.sum((F.col("kind") == "answer").cast("int")).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    live = log.withColumn("_done", F.coalesce(before, F.lit(0))).where((F.col("_done") == 0) & (F.col("pos") <= limit))
    n = lambda c: F.sum(c.cast("long"))
    kind = F.col("kind")
    return live.groupBy("uid").agg(F.count(F.lit(1)).alias("turns"), n(kind != "error").alias("valid"), n(kind == "tool").alias("calls"), F.max(kind == "answer").alias("answered"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turns, valid, calls, answered = state.get if state.exists else (0, 0, 0, False)
    for frame in frames:
        for kind in frame.sort_values("pos")["kind"]:
            if answered:
                break
            turns += 1
            valid += kind != "error"
            calls += kind == "tool"
            answered = kind == "answer"
    state.update((int(turns), int(valid), int(calls), bool(answered)))
    yield pd.DataFrame([[key[0], turns, valid, calls, answered]], columns=["uid", "turns", "valid", "calls", "answered"])


def stream(log: DataFrame) -> DataFrame:
    """The same on a stream of the log; rows of a uid must arrive in order of pos."""
    return log.groupBy("uid").applyInPandasWithState(_advance, COUNTERS, "turns bigint, valid bigint, calls bigint, answered boolean", "update", GroupStateTimeout.NoTimeout)


#: Counters of an evaluated conversation, in the order of the state.
EVALUATED = ("turns", "actions", "calls", "runs", "repeats")


def read_reply(reply: Column, duration: Column) -> list[Column]:
    """kind of a reply ("tool", "answer", "error"), the range of its call, and whether the tool takes it: 0 <= s < e <= duration, over a second long."""
    body = T.whole_json(F.regexp_extract(reply, r"(?s)<tool_call>(.*?)</tool_call>", 1))
    s, e = (F.try_variant_get(body, f"$.arguments.{c}", "double") for c in ("start_time", "end_time"))
    valid = F.coalesce((s >= 0) & (s < e) & (e <= duration) & (e - s > 1.0), F.lit(False))
    return [T.parse_output(reply).alias("kind"), s.alias("s"), e.alias("e"), valid.alias("valid")]


def evaluate(log: DataFrame, max_turns: int = 2) -> DataFrame:
    """Counters of logged conversations (uid, pos, reply, duration) as the evaluation's loop counts them.

    Replies are taken up to an answer, but ``max_turns`` + 1 of them at most; the last one of those is not read any more.
    actions: answers and calls; calls: well-formed calls; runs: calls whose range the tool takes; repeats: calls for the
    range of the call before. ended: "answer", "limit" (no answer in the replies that are read) or "open" (the log ends before).
    """
    rows = log.select("uid", "pos", *read_reply(F.col("reply"), F.col("duration")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    start = F.struct(*[zero.alias(c) for c in EVALUATED], F.lit("open").alias("ended"), none.alias("s"), none.alias("e"))

    def step(acc: Column, x: Column) -> Column:
        read, call = acc["turns"] < max_turns, x["kind"] == "tool"
        add = lambda c, k: (acc[c] + F.when(k, 1).otherwise(0)).cast("long").alias(c)
        same = call & acc["s"].eqNullSafe(x["s"]) & acc["e"].eqNullSafe(x["e"]) & (acc["calls"] > 0)
        ended = F.when(~read, "limit").when(x["kind"] == "answer", "answer").otherwise("open")
        moved = lambda c: F.when(read & call, x[c]).otherwise(acc[c]).alias(c)
        new = F.struct(add("turns", F.lit(True)), add("actions", read & x["kind"].isin("tool", "answer")), add("calls", read & call), add("runs", read & call & x["valid"]), add("repeats", read & same), ended.alias("ended"), moved("s"), moved("e"))
        return F.when(acc["ended"] == "open", new).otherwise(acc)

    turns = F.sort_array(F.collect_list(F.struct("pos", "kind", "s", "e", "valid")))
    return rows.groupBy("uid").agg(F.aggregate(turns, start, step).alias("x")).select("uid", *[F.col(f"x.{c}").alias(c) for c in (*EVALUATED, "ended")])


class _Evaluate(StatefulProcessor):
    """The same counters as keyed state; one row a conversation and micro-batch."""

    def __init__(self, max_turns: int):
        self.max_turns = max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", StructType([*[StructField(c, LongType()) for c in EVALUATED], StructField("ended", StringType()), StructField("s", DoubleType()), StructField("e", DoubleType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, actions, calls, runs, repeats, ended, s, e = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, "open", None, None)
        plain = lambda v: None if v is None or pd.isna(v) else float(v)
        for frame in rows:
            for x in frame.sort_values("pos").itertuples():
                if ended != "open":
                    break
                turns += 1
                if turns > self.max_turns:
                    ended = "limit"
                    continue
                actions += x.kind in ("tool", "answer")
                ended = "answer" if x.kind == "answer" else "open"
                if x.kind == "tool":
                    repeats += calls > 0 and (s, e) == (plain(x.s), plain(x.e))
                    calls, runs, s, e = calls + 1, runs + bool(x.valid), plain(x.s), plain(x.e)
        counters = [int(v) for v in (turns, actions, calls, runs, repeats)]
        self.state.update((*counters, ended, s, e))
        yield pd.DataFrame([[key[0], *counters, ended]], columns=["uid", *EVALUATED, "ended"])

    def close(self) -> None:
        pass


def stream_evaluate(log: DataFrame, max_turns: int = 2) -> DataFrame:
    """``evaluate`` on a stream of the log; rows of a uid must arrive in order of pos. Each row replaces its uid's last one."""
    out = StructType([log.schema["uid"], *[StructField(c, LongType()) for c in EVALUATED], StructField("ended", StringType())])
    rows = log.select("uid", "pos", *read_reply(F.col("reply"), F.col("duration")))
    return rows.groupBy("uid").transformWithStateInPandas(_Evaluate(max_turns), out, "update", "None")


def tool_rewards(log: DataFrame, first: float = 0.0, penalty: float = -0.05) -> DataFrame:
    """(instance, pos, reward, tool_reward) of the executions in a log (instance, pos, kind, score) of tool instances.

    kind is create, execute or release. An instance begins with ``first`` as its reward; an execution that does not better
    it costs the penalty, and its score is the reward from then on. An execution outside an instance's life is an error.
    """
    own = Window.partitionBy("instance").orderBy("pos")
    life = F.sum(F.col("kind").isin("create", "release").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(F.col("kind").isin("create", "release"), F.col("kind")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    runs = log.select("*", life.alias("_life"), last.alias("_last")).where("kind = 'execute'")
    before = F.lag("score", 1).over(Window.partitionBy("instance", "_life").orderBy("pos"))
    dead = F.raise_error(F.concat(F.lit("no such instance: "), F.col("instance").cast("string"))).cast("double")
    alive = F.coalesce(F.col("_last") == "create", F.lit(False))
    return runs.select("instance", "pos", F.when(alive, F.col("score")).otherwise(dead).alias("reward"), F.when(F.col("score") > F.coalesce(before, F.lit(first)), 0.0).otherwise(penalty).alias("tool_reward"))


class _Tool(StatefulProcessor):
    """The reward of a tool's instance that lives."""

    def __init__(self, first: float, penalty: float):
        self.first, self.penalty = first, penalty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reward = handle.getValueState("reward", StructType([StructField("score", DoubleType()), StructField("alive", BooleanType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        score, alive = self.reward.get() if self.reward.exists() else (self.first, False)
        out = []
        for frame in rows:
            for x in frame.sort_values("pos").itertuples():
                if x.kind == "execute":
                    if not alive:
                        raise ValueError(f"no such instance: {key[0]}")
                    out.append((key[0], x.pos, float(x.score), 0.0 if x.score > score else self.penalty))
                    score = float(x.score)
                else:
                    score, alive = self.first, x.kind == "create"
        self.reward.update((score, True)) if alive else self.reward.clear()
        yield pd.DataFrame(out, columns=["instance", "pos", "reward", "tool_reward"])

    def close(self) -> None:
        pass


def stream_tool_rewards(log: DataFrame, first: float = 0.0, penalty: float = -0.05) -> DataFrame:
    """``tool_rewards`` on a stream of the log; rows of an instance must arrive in order of pos."""
    out = StructType([log.schema["instance"], log.schema["pos"], StructField("reward", DoubleType()), StructField("tool_reward", DoubleType())])
    return log.select("instance", "pos", "kind", "score").groupBy("instance").transformWithStateInPandas(_Tool(first, penalty), out, "append", "None")


def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """(step, coefficient): value *= 1 + clip(kl / target - 1, +-0.2) * n / horizon, in the order of steps.

    A running product as the exponential of a running sum of logarithms, over ranges of steps.
    """
    factor = 1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / target - 1)) * F.col("n") / horizon
    return running_sum(steps, F.log(factor), "step", name="_log").select("step", (start * F.exp("_log")).alias("coefficient"))
