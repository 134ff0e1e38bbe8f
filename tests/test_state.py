"""Keyed state over streams gives the rows of the batch forms; ends, cuts, timers and errors."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from spindrift.streaming import fill, requests, turns

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "request bigint, pos bigint, kind string, ids array<int>, reason string"
G = (7, 8)


@pytest.fixture(autouse=True, scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files_of(spark, folder, parts, schema):
    """A file for each micro-batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(frame, name, folder, mode, **trigger):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck-{name}").trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        assert q.awaitTermination(120)
    return q


def request_events(n=12):
    rng, out = random.Random(3), []
    for r in range(n):
        words = lambda: [rng.randint(1, 9) for _ in range(rng.randint(0, 9))]
        log = [("assistant", [1], None)] * (r % 2) + [("prompt", words() + list(G), None)]
        for _ in range(rng.randint(0, 5)):
            log += rng.choice([[("generate", None, None), ("assistant", words(), None)], [("generate", None, None), ("call", words(), None), ("tool", words(), None)], [("generate", [], None)], [("prompt", [1, 2], None)], [("other", [5], None)], [("assistant", [3, *G], None)]])
        log += [[("finish", None, "stop")], [("finish", None, "length")], [("fail", None, None)], []][r % 4]
        log += [("assistant", [9, 9], None), ("fail", None, None)] if r % 3 == 0 and r % 4 != 3 else []
        out += [(r, p, *e) for p, e in enumerate(log)]
    return out


def plain_request(events, limits):
    """The rules, one event after another."""
    ids = loss = None
    prompt, state, reason = 0, "failed", None
    tail = list(limits.generation)
    for _, _, kind, own, why in events:
        if ids is None:
            if kind == "prompt":
                ids, loss, prompt = list(own), [0] * len(own), len(own)
        elif kind == "generate" and ids[-len(tail) :] != tail:
            ids, loss = ids + tail, loss + [0] * len(tail)
        elif kind in ("assistant", "call", "tool"):
            ids, loss = ids + list(own or []), loss + [int(kind != "tool")] * len(own or [])
        elif kind in ("finish", "fail"):
            state, reason = ("completed", why) if kind == "finish" else ("failed", None)
            break
    if ids is None:
        return None
    if ids[-len(tail) :] == tail:
        ids, loss = ids[: -len(tail)], loss[: -len(tail)]
    full = list(range(len(ids)))
    cut = lambda x: tuple(x[: limits.max_model][prompt:][: limits.max_response])
    return state, reason, tuple(events[[e[2] for e in events].index("prompt")][3]), cut(ids), cut(loss), cut(full)


def as_rows(df):
    return sorted((r.request, r.state, r.reason, tuple(r.prompt_ids), tuple(r.response_ids), tuple(r.loss_mask), tuple(r.position_ids)) for r in df.collect())


LIMITS = requests.Limits(G, max_model=22, max_response=9)


def test_requests_against_plain(spark):
    rows = request_events(40)
    for limits in (LIMITS, requests.Limits(G), requests.Limits(G, 5, 3)):
        want = sorted((r, *plain_request([e for e in rows if e[0] == r], limits)) for r in {e[0] for e in rows})
        assert as_rows(requests.replay(spark.createDataFrame(rows, EVENTS).repartition(3), limits)) == want
    bare = requests.Limits((), 9, 9)
    got = as_rows(requests.replay(spark.createDataFrame([(1, 0, "prompt", [1], None), (1, 1, "generate", None, None), (1, 2, "assistant", [7, 8], None), (2, 0, "assistant", [1], None)], EVENTS), bare))
    assert got == [(1, "failed", None, (1,), (7, 8), (1, 1), (1, 2))]
    assert requests.replay(spark.createDataFrame([], EVENTS)).collect() == []
    with pytest.raises(Exception, match="unknown reason: tired"):
        requests.replay(spark.createDataFrame([(1, 0, "prompt", [1], None), (1, 1, "finish", None, "tired")], EVENTS)).collect()


def test_request_stream_equals_batch(spark, tmp_path):
    """Events of a request over several micro-batches; those that never end are failed by their timer."""
    rows = request_events()
    parts = [[e for e in rows if e[1] < 3], [e for e in rows if 3 <= e[1] < 6], [e for e in rows if e[1] >= 6]]
    log = files_of(spark, tmp_path / "in", parts, EVENTS)
    q = run(requests.stream(log, LIMITS, idle_ms=1_500), "requests", tmp_path, "append", processingTime="300 milliseconds")
    want = as_rows(requests.replay(spark.createDataFrame(rows, EVENTS), LIMITS))
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("requests").count() < len(want):
            time.sleep(0.5)
    finally:
        q.stop()
    assert as_rows(spark.table("requests")) == want
    assert {r[0] for r in want if r[1] == "failed"} >= {3, 7, 11}


def replies():
    rng = random.Random(4)
    call = lambda s, e: f'<tool_call>{{"name": "zoom", "arguments": {{"start_time": {s}, "end_time": {e}}}}}</tool_call>'
    kinds = [lambda: call(1, 4), lambda: call(1, 4), lambda: call(2, 2.5), lambda: call(0, 99), lambda: call('"x"', 3), lambda: "<answer>a</answer>", lambda: '<tool_call>{"name": 1}</tool_call><answer>a</answer>', lambda: "plain", lambda: None]
    return [(u, p, rng.choice(kinds)() if u else None, 8.0 if u % 5 else None) for u in range(30) for p in range(rng.randint(1, 7))]


def test_evaluated_conversations(spark, tmp_path):
    schema = "uid bigint, pos bigint, reply string, duration double"
    rows = replies()
    log = spark.createDataFrame(rows, schema)
    batch = {r.uid: tuple(r) for r in turns.evaluate(log.repartition(3), 3).collect()}
    assert {r[-1] for r in batch.values()} == {"answer", "limit", "open"} and any(r[5] for r in batch.values())
    for u, turn_count, actions, calls, runs, repeats, ended in batch.values():
        own = [r[2] or "" for r in rows if r[0] == u]
        read = own[: min(turn_count, 3)]
        tools = [x for x in read if x.startswith("<tool_call>") and "zoom" in x]
        assert calls == len(tools) and actions == calls + (ended == "answer") and runs <= calls and repeats <= max(0, calls - 1)
        assert ended == ("answer" if read[-1].startswith("<answer>") else "limit" if len(own) > 3 else "open") and turn_count <= 4
    parts = [[r for r in rows if r[1] < 2], [r for r in rows if r[1] >= 2]]
    q = run(turns.stream_evaluate(files_of(spark, tmp_path / "in", parts, schema), 3), "evaluated", tmp_path, "update")
    assert q.exception() is None
    last = {}
    for r in spark.table("evaluated").collect():
        last[r.uid] = max(last.get(r.uid, tuple(r)), tuple(r), key=lambda x: x[1])
    assert last == batch


def test_tool_state(spark, tmp_path):
    schema = "instance bigint, pos bigint, kind string, score double"
    rows = [(1, 0, "create", None), (1, 1, "execute", 0.2), (1, 2, "execute", 0.2), (1, 3, "execute", 0.9), (1, 4, "release", None), (1, 5, "create", None), (1, 6, "execute", 0.1), (2, 0, "create", None), (2, 1, "execute", 0.0)]
    want = {(1, 1, 0.2, 0.0), (1, 2, 0.2, -0.05), (1, 3, 0.9, 0.0), (1, 6, 0.1, 0.0), (2, 1, 0.0, -0.05)}
    assert {tuple(r) for r in turns.tool_rewards(spark.createDataFrame(rows, schema)).collect()} == want
    q = run(turns.stream_tool_rewards(files_of(spark, tmp_path / "in", [rows[:2] + rows[7:], rows[2:4], rows[4:7]], schema)), "tools", tmp_path, "append")
    assert q.exception() is None and {tuple(r) for r in spark.table("tools").collect()} == want
    for bad in ([(1, 0, "execute", 1.0)], [(1, 0, "create", None), (1, 1, "release", None), (1, 2, "execute", 1.0)]):
        with pytest.raises(Exception, match="no such instance: 1"):
            turns.tool_rewards(spark.createDataFrame(bad, schema)).collect()


GROUPS = "run bigint, gen bigint, place bigint, uid bigint, scores array<double>"


def group_rows(runs=3, gens=9, size=4):
    rng = random.Random(6)
    return [(r, g, p, r * 1_000 + g * 10 + p, rng.choice([[1.0, 0.0], [1.0, 1.0], [0.5], [0.0, 0.0, 0.0]])) for r in range(runs) for g in range(gens) for p in range(size) if not (r == 2 and g == gens - 1 and p == 3)]


def plain_fill(rows, size, gen_size, carry):
    out = []
    for run_id in sorted({r[0] for r in rows}):
        step, held = 0, []
        for g in sorted({r[1] for r in rows if r[0] == run_id}):
            own = [r for r in rows if r[:2] == (run_id, g)]
            if len(own) < gen_size:
                continue
            held += [r[3] for r in own if len(r[4]) == 1 or len(set(r[4])) > 1]
            while len(held) >= size:
                out += [(run_id, step, i, u, u % 1_000 // 10) for i, u in enumerate(held[:size])]
                held, step = held[size:] if carry else [], step + 1
    return sorted(out)


@pytest.mark.parametrize("carry", [False, True])
def test_filled_batches(spark, tmp_path, carry):
    rows = group_rows()
    log = spark.createDataFrame(rows, GROUPS)
    for size in (1, 3, 5):
        assert sorted(map(tuple, fill.filled(log.repartition(3), size, 4, carry).collect())) == plain_fill(rows, size, 4, carry)
    parts = [[r for r in rows if r[1] * 4 + r[2] < 7], [r for r in rows if 7 <= r[1] * 4 + r[2] < 20], [r for r in rows if r[1] * 4 + r[2] >= 20]]
    q = run(fill.stream(files_of(spark, tmp_path / "in", parts, GROUPS), 3, 4, carry), f"filled_{carry}", tmp_path, "append")
    assert q.exception() is None and sorted(map(tuple, spark.table(f"filled_{carry}").collect())) == plain_fill(rows, 3, 4, carry)


def test_too_many_generated_batches(spark):
    rows = [(1, g, 0, g, [1.0, 1.0]) for g in range(5)]
    with pytest.raises(Exception, match="too many generated batches"):
        fill.filled(spark.createDataFrame(rows, GROUPS), 1, 1, max_gens=3).collect()
    assert fill.filled(spark.createDataFrame(rows, GROUPS), 1, 1, max_gens=6).collect() == []
    assert fill.filled(spark.createDataFrame([], GROUPS), 2, 2).collect() == []
    kept = spark.createDataFrame([([1.0],), ([1.0, 1.0],), ([],), (None,), ([0.0, 1.0],)], "s array<double>").select(fill.keeps(F.col("s")).alias("k"))
    assert [r.k for r in kept.collect()] == [True, False, False, False, True]
