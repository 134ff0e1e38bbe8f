"""Replays with state: requests, evaluated conversations, tool instances, filled training batches. Streams give the same rows (tests/test_state.py)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.plans import views as V
from spindrift.plans.registry import query, table
from spindrift.streaming import fill, requests, turns

LIMITS = requests.Limits(generation=(1001, 1002), max_model=90, max_response=40)


def request_log(spark, d):
    """Conversations as requests; a word's token is its length.

    The first turn is the prompt, an assistant's turn is generated, another one is a tool's answer with a new generation
    prompt. A quarter each stops, reaches its length, fails, and never ends.
    """
    none = F.array().cast("array<int>")
    c = table(spark, d, "conversations").withColumn("ids", F.transform(F.split("text", " "), lambda w: F.length(w)))
    event = lambda j, kind, ids=none: F.struct((F.col("turn") * 10 + j).alias("pos"), F.lit(kind).alias("kind"), ids.alias("ids"), F.lit(None).cast("string").alias("reason"))
    first = F.concat("ids", F.array(*map(F.lit, LIMITS.generation)))
    said = F.when(F.col("turn") == 0, F.array(event(0, "prompt", first), event(1, "generate"))).when(F.col("role") == "assistant", F.array(event(0, "generate"), event(1, "assistant", F.col("ids"))))
    each = c.select(F.col("conv_id").alias("request"), F.explode(said.otherwise(F.array(event(0, "tool", F.col("ids")), event(1, "generate")))).alias("x")).select("request", "x.*")
    k = F.col("conv_id") % 4
    ends = c.groupBy("conv_id").agg((F.max("turn") * 10 + 5).alias("pos")).where(k < 3)
    return each.union(ends.select("conv_id", "pos", F.when(k == 2, "fail").otherwise("finish"), none, F.when(k == 0, "stop").when(k == 1, "length")))


@query("stf_request", f"""WITH w AS (SELECT conv_id, turn, role, list_transform(string_split(text, ' '), lambda x: length(x)::INTEGER) AS l FROM conversations),
  s AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 OR role <> 'assistant' THEN list_concat(l, {list(LIMITS.generation)}::INTEGER[]) ELSE l END AS ids FROM w),
  g AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(list_transform(ids, lambda x: CASE WHEN turn > 0 AND role = 'assistant' THEN 1 ELSE 0 END::INTEGER) ORDER BY turn)) AS loss, min_by(len(ids), turn) AS p, max_by(turn = 0 OR role <> 'assistant', turn) AS open_end FROM s GROUP BY conv_id),
  n AS (SELECT *, greatest(0, least(least(len(ids) - CASE WHEN open_end THEN 2 ELSE 0 END, {LIMITS.max_model}) - p, {LIMITS.max_response})) AS n FROM g)
  SELECT conv_id AS request, CASE WHEN conv_id % 4 < 2 THEN 'completed' ELSE 'failed' END AS state, CASE conv_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END AS reason,
    ids[1:p] AS prompt_ids, ids[p + 1:p + n] AS response_ids, loss[p + 1:p + n] AS loss_mask, list_transform(range(p, p + n), lambda x: x::INTEGER) AS position_ids FROM n""")
def stf_request(spark, d):
    return requests.replay(request_log(spark, d), LIMITS)


TURNS = 4
_REPLY = "pos % 7 AS s, pos % 7 + pos % 3 AS e, 8.0 AS duration, CASE event_type WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'answer' ELSE 'error' END AS kind"


def reply_log(spark, d):
    """Replies of users' events: calls for a range, answers, malformed calls before an answer, and plain text."""
    s, kind = F.col("pos") % 7, F.col("event_type")
    call = F.concat(F.lit('<think>look</think><tool_call>{"name": "zoom", "arguments": {"start_time": '), s.cast("string"), F.lit(', "end_time": '), (s + F.col("pos") % 3).cast("string"), F.lit("}}</tool_call>"))
    reply = F.when(kind == "view", call).when(kind == "purchase", "<answer>yes</answer>").when(kind == "error", '<tool_call>{"name": 1}</tool_call><answer>no</answer>').otherwise("plain")
    return V.tokens(spark, d).select("uid", "pos", reply.alias("reply"), F.lit(8.0).alias("duration"))


@query("stf_rollout_eval", f"""WITH r AS (SELECT uid, pos, {_REPLY} FROM tokens),
  f AS (SELECT uid, max(pos) AS n, min(pos) FILTER (WHERE kind = 'answer' AND pos <= {TURNS}) AS a FROM r GROUP BY uid),
  t AS (SELECT uid, coalesce(a, least(n, {TURNS + 1})) AS turns, CASE WHEN a IS NOT NULL THEN 'answer' WHEN n > {TURNS} THEN 'limit' ELSE 'open' END AS ended FROM f),
  x AS (SELECT r.*, turns, ended FROM r JOIN t USING (uid) WHERE pos <= least(turns, {TURNS})),
  c AS (SELECT uid, s = lag(s) OVER w AND e = lag(e) OVER w AS same, s < e AND e <= duration AND e - s > 1 AS ok FROM x WHERE kind = 'tool' WINDOW w AS (PARTITION BY uid ORDER BY pos)),
  k AS (SELECT uid, count(*) AS calls, count(*) FILTER (WHERE ok) AS runs, count(*) FILTER (WHERE same) AS repeats FROM c GROUP BY uid)
  SELECT uid, turns::BIGINT AS turns, coalesce(calls, 0) + CASE WHEN ended = 'answer' THEN 1 ELSE 0 END AS actions, coalesce(calls, 0) AS calls, coalesce(runs, 0) AS runs, coalesce(repeats, 0) AS repeats, ended FROM t LEFT JOIN k USING (uid)""", "tokens")
def stf_rollout_eval(spark, d):
    return turns.evaluate(reply_log(spark, d), TURNS)


def tool_log(spark, d):
    """Lines of an order as executions of its tool, which is released and made anew after every three."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance"), (F.row_number().over(w) - 1).alias("k"), (F.col("l_quantity") / 50).alias("score"))
    fresh, event = F.col("k") % 3 == 0, lambda j, kind: F.struct((F.col("k") * 4 + j).cast("long").alias("pos"), F.lit(kind).alias("kind"))
    runs = F.when(fresh & (F.col("k") > 0), F.array(event(0, "release"), event(1, "create"), event(2, "execute"))).when(fresh, F.array(event(1, "create"), event(2, "execute"))).otherwise(F.array(event(2, "execute")))
    return x.select("instance", F.explode(runs).alias("e"), "score").select("instance", "e.pos", "e.kind", F.when(F.col("e.kind") == "execute", F.col("score")).alias("score"))


@query("stf_tool_state", "WITH x AS (SELECT l_orderkey AS instance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, l_quantity / 50 AS score FROM lineitem) SELECT instance, k * 4 + 2 AS pos, score AS reward, CASE WHEN score > coalesce(lag(score) OVER (PARTITION BY instance, k // 3 ORDER BY k), 0) THEN 0.0 ELSE -0.05 END::DOUBLE AS tool_reward FROM x")
def stf_tool_state(spark, d):
    return turns.tool_rewards(tool_log(spark, d))


GROUPS, GENERATED = 10, 8


def group_log(spark, d):
    """Answers of 256 orders as a run's groups, in generated batches of eight."""
    g = V.rollouts(spark, d).groupBy("uid").agg(F.collect_list("score").alias("scores")).withColumn("run", F.floor(F.col("uid") / 256))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("uid")) - 1
    return g.select("run", F.floor(nth / GENERATED).alias("gen"), (nth % GENERATED).alias("place"), "uid", "scores")


@query("stf_fill", f"""WITH RECURSIVE g AS (SELECT uid, floor(uid / 256)::BIGINT AS run, (count(*) = 1 OR min(score) <> max(score))::INTEGER AS keep, row_number() OVER (PARTITION BY floor(uid / 256) ORDER BY uid) - 1 AS nth FROM rollouts GROUP BY uid),
  x AS (SELECT run, nth // {GENERATED} AS gen, uid, keep, sum(keep) OVER (PARTITION BY run, nth // {GENERATED} ORDER BY uid) - 1 AS k FROM g),
  b AS (SELECT run, gen, sum(keep) AS kept FROM x GROUP BY run, gen HAVING count(*) = {GENERATED}),
  f AS (SELECT run, gen, kept, 0::HUGEINT AS before, 0 AS step, kept AS have FROM b WHERE gen = 0
    UNION ALL SELECT b.run, b.gen, b.kept, CASE WHEN have >= {GROUPS} THEN 0 ELSE have END, step + (have >= {GROUPS})::INTEGER, CASE WHEN have >= {GROUPS} THEN 0 ELSE have END + b.kept FROM f JOIN b ON b.run = f.run AND b.gen = f.gen + 1),
  shipped AS (SELECT f.run, step, before + k AS slot, uid, gen FROM f JOIN x USING (run, gen) WHERE keep = 1 AND before + k < {GROUPS} AND step < (SELECT count(*) FROM f AS h WHERE h.run = f.run AND h.have >= {GROUPS})),
  r AS (SELECT x.run, gen, uid, row_number() OVER (PARTITION BY x.run ORDER BY gen, k) - 1 AS nth, count(*) OVER (PARTITION BY x.run) AS total FROM x JOIN b USING (run, gen) WHERE keep = 1),
  carried AS (SELECT run, nth // {GROUPS} AS step, nth % {GROUPS} AS slot, uid, gen FROM r WHERE nth < total // {GROUPS} * {GROUPS})
  SELECT 'shipped' AS kind, run, step::BIGINT AS step, slot::BIGINT AS slot, uid, gen::BIGINT AS gen FROM shipped UNION ALL SELECT 'carried', run, step, slot, uid, gen FROM carried""", "rollouts")
def stf_fill(spark, d):
    """As shipped, where what is left of a batch is dropped, and with it carried on."""
    log = group_log(spark, d)
    both = [fill.filled(log, GROUPS, GENERATED, carry).select(F.lit(kind).alias("kind"), "*") for kind, carry in (("shipped", False), ("carried", True))]
    return both[0].union(both[1])
