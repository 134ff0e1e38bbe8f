"""Requests of a multi-turn rollout: tokens appended with loss masks, finished and cut, as a batch fold and as keyed state.

A log has a row for each event: request, pos (its order), kind, ids, reason.

prompt      the rendered prompt with its generation prompt; later ones of a request and events before it are ignored
generate    the generation prompt goes to the end, unless the ids end with it
assistant   ids that count in the loss; ``call`` the same, and the request waits for a tool
tool        ids that do not count
fail        ends the request as failed
finish      ends it as completed; reason is stop or length, another one is an error

A request that ends loses a generation prompt at its end; its ids are cut to ``max_model``, those after the prompt to
``max_response``. Events after the end are ignored. A request that never ends is failed: in a batch at the end of the
log, in a stream by a timer, ``idle_ms`` after its last event. Null ids are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

REASONS = ("stop", "length")


@dataclass(frozen=True)
class Limits:
    generation: tuple[int, ...] = ()
    max_model: int = 32_768
    max_response: int = 8_192


def _output(log: DataFrame) -> StructType:
    ids = ArrayType(IntegerType())
    return StructType([log.schema["request"], StructField("state", StringType()), StructField("reason", StringType()), *[StructField(c, ids) for c in ("prompt_ids", "response_ids", "loss_mask", "position_ids")]])


def _cut(ids: Column, loss: Column, prompt: Column, limits: Limits) -> list[Column]:
    """prompt_ids, response_ids, loss_mask and position_ids of a request that has ended."""
    n = len(limits.generation)
    whole = F.array(*[F.lit(x) for x in limits.generation]).cast("array<int>")
    kept = F.size(ids) - (F.when(F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 1), n) == whole, n).otherwise(0) if n else F.lit(0))
    size = F.greatest(F.lit(0), F.least(kept, F.lit(limits.max_model)) - prompt)
    size = F.least(size, F.lit(limits.max_response))
    places = F.when(size > 0, F.sequence(prompt, prompt + size - 1)).otherwise(F.array().cast("array<int>"))
    return [F.slice(ids, F.lit(1), prompt).alias("prompt_ids"), F.slice(ids, prompt + 1, size).alias("response_ids"), F.slice(loss, prompt + 1, size).alias("loss_mask"), places.alias("position_ids")]


def replay(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a request that has a prompt: request, state, reason, prompt_ids, response_ids, loss_mask, position_ids."""
    none = F.array().cast("array<int>")
    tail = F.array(*[F.lit(x) for x in limits.generation]).cast("array<int>")
    start = F.struct(F.lit("pending").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(-1).alias("prompt"), none.alias("ids"), none.alias("loss"))
    bad = lambda r: F.raise_error(F.concat(F.lit("unknown reason: "), F.coalesce(r, F.lit("null")))).cast("string")

    def step(acc: Column, e: Column) -> Column:
        kind, own = e["kind"], F.coalesce(e["ids"], none)
        n = len(limits.generation)
        ready = (F.slice(acc["ids"], F.greatest(F.lit(1), F.size(acc["ids"]) - n + 1), n) == tail) if n else F.lit(True)
        more = F.when(kind == "generate", F.when(ready, none).otherwise(tail)).when(kind.isin("assistant", "call", "tool"), own).otherwise(none)
        state = F.when(kind.isin("generate", "assistant", "tool"), "running").when(kind == "call", "tool_calling").when(kind == "fail", "failed").when(kind == "finish", F.when(e["reason"].isin(*REASONS), "completed").otherwise(bad(e["reason"]))).otherwise(acc["state"])
        reason = F.when(kind == "finish", e["reason"]).otherwise(acc["reason"])
        loss = F.array_repeat(kind.isin("assistant", "call").cast("int"), F.size(more))
        going = F.struct(state.alias("state"), reason.alias("reason"), acc["prompt"].alias("prompt"), F.concat(acc["ids"], more).alias("ids"), F.concat(acc["loss"], loss).alias("loss"))
        first = F.struct(F.lit("running").alias("state"), acc["reason"].alias("reason"), F.size(own).alias("prompt"), own.alias("ids"), F.array_repeat(F.lit(0), F.size(own)).alias("loss"))
        return F.when(acc["state"] == "pending", F.when(kind == "prompt", first).otherwise(acc)).when(acc["state"].isin("completed", "failed"), acc).otherwise(going)

    events = F.sort_array(F.collect_list(F.struct("pos", "kind", "ids", "reason")))
    out = log.groupBy("request").agg(events.alias("events")).select("request", F.aggregate("events", start, step).alias("x")).where("x.state <> 'pending'")
    state = F.when(F.col("x.state") == "completed", "completed").otherwise("failed")
    return out.select("request", state.alias("state"), F.col("x.reason").alias("reason"), *_cut(F.col("x.ids"), F.col("x.loss"), F.col("x.prompt"), limits))


class _Requests(StatefulProcessor):
    """Keyed state: a value (state, prompt's length, last ids), a list of (id, loss), a timer for idle requests."""

    def __init__(self, limits: Limits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "state string, prompt int, tail array<int>")
        self.tokens = handle.getListState("tokens", "id int, loss int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation = list(self.limits.generation)
        state, prompt, tail = self.head.get() if self.head.exists() else ("pending", -1, [])
        if state in ("completed", "failed"):
            return
        tail, fresh, reason = list(tail), [], None
        for frame in rows:
            for e in frame.sort_values("pos").itertuples():
                if state in ("completed", "failed"):
                    break
                own = [] if e.ids is None else [int(x) for x in e.ids]
                if state == "pending":
                    if e.kind == "prompt":
                        state, prompt, more, loss = "running", len(own), own, 0
                    else:
                        continue
                elif e.kind == "generate":
                    state, loss, more = "running", 0, [] if not generation or tail == generation else generation
                elif e.kind in ("assistant", "call"):
                    state, loss, more = "running" if e.kind == "assistant" else "tool_calling", 1, own
                elif e.kind == "tool":
                    state, loss, more = "running", 0, own
                elif e.kind == "finish":
                    if e.reason not in REASONS:
                        raise ValueError(f"unknown reason: {e.reason}")
                    state, reason, loss, more = "completed", e.reason, 0, []
                elif e.kind == "fail":
                    state, loss, more = "failed", 0, []
                else:
                    loss, more = 0, []
                fresh += [(x, loss) for x in more]
                tail = (tail + more)[-len(generation) :] if generation else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state in ("completed", "failed"):
            yield self._end(key, state, reason, prompt, [*(tuple(x) for x in self.tokens.get()), *fresh] if self.tokens.exists() else fresh)
            self.tokens.clear()
            self.head.update((state, prompt, []))  # later events of this request are ignored
            return
        if fresh:
            self.tokens.appendList(fresh)
        self.head.update((state, prompt, tail))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, prompt, _ = self.head.get()
        if state not in ("pending", "completed", "failed"):
            yield self._end(key, "failed", None, prompt, [tuple(x) for x in self.tokens.get()] if self.tokens.exists() else [])
        self.tokens.clear()
        self.head.update(("failed", prompt, []))

    def _end(self, key: tuple, state: str, reason: str | None, prompt: int, tokens: list[tuple[int, int]]) -> pd.DataFrame:
        ids, loss = [int(x) for x, _ in tokens], [int(y) for _, y in tokens]
        n = len(self.limits.generation)
        kept = len(ids) - (n if n and ids[-n:] == list(self.limits.generation) else 0)
        size = min(max(0, min(kept, self.limits.max_model) - prompt), self.limits.max_response)
        return pd.DataFrame([[key[0], state, reason, ids[:prompt], ids[prompt : prompt + size], loss[prompt : prompt + size], list(range(prompt, prompt + size))]], columns=["request", "state", "reason", "prompt_ids", "response_ids", "loss_mask", "position_ids"])

    def close(self) -> None:
        pass


def stream(log: DataFrame, limits: Limits = Limits(), idle_ms: int = 600_000) -> DataFrame:
    """The same on a stream of the log (state in RocksDB); a request's events must arrive in order of pos."""
    return log.groupBy("request").transformWithStateInPandas(_Requests(limits, idle_ms), _output(log), "append", "ProcessingTime")
