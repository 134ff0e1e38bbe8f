"""Group analytics over the rollouts and tokens views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.operators import groups as G
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table

_STATS = "s AS (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS m, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END AS sd FROM rollouts WINDOW w AS (PARTITION BY uid))"
def _out():
    return "uid", "sample", r6("advantage").alias("advantage")


@query("win_grpo", f"WITH {_STATS} SELECT uid, sample, round((score - m) / (sd + 1e-6), 6) + 0.0 AS advantage FROM s", "rollouts")
def win_grpo(spark, d):
    return G.grpo(V.rollouts(spark, d)).select(*_out())


@query("win_grpo_unscaled", f"WITH {_STATS} SELECT uid, sample, round(score - m, 6) + 0.0 AS advantage FROM s", "rollouts")
def win_grpo_unscaled(spark, d):
    return G.grpo(V.rollouts(spark, d), scale=False).select(*_out())


@query("win_dgrpo", f"WITH {_STATS} SELECT uid, sample, round((score - m) / (sd + 1e-6) * (greatest(0, least(1, 2 - m)) + 1) / 2, 6) + 0.0 AS advantage FROM s", "rollouts")
def win_dgrpo(spark, d):
    return G.dgrpo(V.rollouts(spark, d)).select(*_out())


@query("win_rloo", "SELECT uid, sample, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) * count(*) OVER w / greatest(count(*) OVER w - 1, 1) ELSE score END, 6) + 0.0 AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)", "rollouts")
def win_rloo(spark, d):
    return G.rloo(V.rollouts(spark, d)).select(*_out())


@query("win_opo", "SELECT uid, sample, round(score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE sum(score * len) OVER w / sum(len) OVER w END, 6) + 0.0 AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)", "rollouts")
def win_opo(spark, d):
    return G.opo(V.rollouts(spark, d)).select(*_out())


@query("win_rfpp_base", "WITH g AS (SELECT uid, sample, len, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS x FROM rollouts WINDOW w AS (PARTITION BY uid)), a AS (SELECT sum(len)::DOUBLE AS n, sum(x * len) AS s, sum(x * x * len) AS q FROM g), b AS (SELECT n, s / (n + 1e-8) AS m, s, q FROM a) SELECT uid, sample, round((x - m) / sqrt((q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) + 1e-8), 6) + 0.0 AS advantage FROM g, b", "rollouts")
def win_rfpp_base(spark, d):
    df = V.rollouts(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    df = df.withColumn("x", F.col("score") - F.when(n == 1, 0.0).otherwise(F.avg("score").over(Window.partitionBy("uid"))))
    return G.whiten(df, "x", "len").select("uid", "sample", r6("white").alias("advantage"))


_GAE = "WITH RECURSIVE x(uid, pos, v, a) AS (SELECT uid, pos, v, reward - v FROM tokens t WHERE pos = (SELECT max(pos) FROM tokens u WHERE u.uid = t.uid) UNION ALL SELECT t.uid, t.pos, t.v, t.reward + 0.99 * x.v - t.v + 0.99 * 0.95 * x.a FROM x JOIN tokens t ON t.uid = x.uid AND t.pos = x.pos - 1)"


def _recursive(body: str) -> str:
    """A recursive body with the tokens view among its clauses."""
    from spindrift.plans.registry import VIEWS

    return body.replace("WITH RECURSIVE ", f"WITH RECURSIVE tokens AS MATERIALIZED ({VIEWS['tokens']}), ", 1)


@query("win_gae", _recursive(_GAE + ", j AS (SELECT x.uid, x.pos, x.a, x.a + x.v AS ret, mask FROM x JOIN tokens USING (uid, pos)), s AS (SELECT sum(mask)::DOUBLE AS n, sum(a * mask) AS s, sum(a * a * mask) AS q FROM j), b AS (SELECT *, s / (n + 1e-8) AS m FROM s) SELECT uid, pos, round(ret, 6) + 0.0 AS returns, round((a - m) / sqrt((q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) + 1e-8), 6) + 0.0 AS advantage FROM j, b"))
def win_gae(spark, d):
    s = V.sequences(spark, d).withColumn("a", A.gae(F.col("reward"), F.col("v"), 0.99, 0.95))
    t = s.select("uid", F.posexplode(F.arrays_zip("a", "v", "mask")).alias("i", "x")).select("uid", (F.col("i") + 1).cast("long").alias("pos"), "x.a", (F.col("x.a") + F.col("x.v")).alias("ret"), "x.mask")
    return G.whiten(t, "a", "mask").select("uid", "pos", r6("ret").alias("returns"), r6("white").alias("advantage"))


@query("win_prime_norm", "WITH t AS (SELECT uid, pos, reward, sum(reward * mask) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tokens) SELECT uid, pos, round(reward / ((SELECT max(abs(ret)) FROM t) + 1e-6), 8) + 0.0 AS x FROM t", "tokens")
def win_prime_norm(spark, d):
    ret = F.sum(F.col("reward") * F.col("mask")).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(0, Window.unboundedFollowing))
    t = V.tokens(spark, d).withColumn("ret", ret)
    top = F.broadcast(t.agg(F.max(F.abs("ret")).alias("top")))
    return t.crossJoin(top).select("uid", "pos", (F.round(F.col("reward") / (F.col("top") + 1e-6), 8) + 0.0).alias("x"))


@query("win_dpo_acc", "WITH p AS (SELECT a.uid, abs(a.acc - b.acc) AS wt, CASE WHEN (a.score > b.score) = (a.acc > b.acc) THEN 1.0 ELSE 0.0 END AS ok FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.sample < b.sample) SELECT uid, round(CASE WHEN sum(wt) = 0 THEN 0.5 ELSE sum(ok * wt) / sum(wt) END, 6) + 0.0 AS x FROM p GROUP BY uid", "rollouts")
def win_dpo_acc(spark, d):
    a = V.rollouts(spark, d).select("uid", "sample", "score", "acc")
    b = a.toDF("uid", "s2", "score2", "acc2")
    p = a.join(b, "uid").where("sample < s2")
    wt = F.abs(F.col("acc") - F.col("acc2"))
    ok = ((F.col("score") > F.col("score2")) == (F.col("acc") > F.col("acc2"))).cast("double")
    return p.groupBy("uid").agg(r6(F.when(F.sum(wt) == 0, 0.5).otherwise(F.sum(ok * wt) / F.nullif(F.sum(wt), F.lit(0)))).alias("x"))


@query("win_tool_delta", "SELECT uid, pos, CASE WHEN reward > lag(reward, 1, 0) OVER (PARTITION BY uid ORDER BY pos) THEN 0.0 ELSE -0.05 END::DOUBLE AS penalty FROM tokens", "tokens")
def win_tool_delta(spark, d):
    before = F.lag("reward", 1, 0.0).over(Window.partitionBy("uid").orderBy("pos"))
    return V.tokens(spark, d).select("uid", "pos", F.when(F.col("reward") > before, 0.0).otherwise(-0.05).alias("penalty"))


@query("win_adjacent", "WITH x AS (SELECT uid, pos, event_type, CASE WHEN event_type = 'click' AND lag(event_type) OVER w = 'click' THEN 0 ELSE 1 END AS fresh FROM tokens WINDOW w AS (PARTITION BY uid ORDER BY pos)), y AS (SELECT uid, event_type, sum(fresh) OVER (PARTITION BY uid ORDER BY pos) AS run FROM x) SELECT uid, run::BIGINT AS run, min(event_type) AS role, count(*) AS n FROM y GROUP BY uid, run", "tokens")
def win_adjacent(spark, d):
    return G.merge_adjacent(V.tokens(spark, d), "uid", "pos", "event_type", "click").groupBy("uid", "run").agg(F.min("event_type").alias("role"), F.count(F.lit(1)).alias("n"))


@query("jn_vote", "SELECT uid, sample, round(avg(score) OVER w, 6) + 0.0 AS mean, count(*) OVER w AS n FROM rollouts WINDOW w AS (PARTITION BY uid)", "rollouts")
def jn_vote(spark, d):
    w = Window.partitionBy("uid")
    return V.rollouts(spark, d).select("uid", "sample", r6(F.avg("score").over(w)).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))


@query("srt_top2", "SELECT uid, k, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample) AS k FROM rollouts) WHERE k <= 2", "rollouts")
def srt_top2(spark, d):
    k = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "sample")).cast("long")
    return V.rollouts(spark, d).select("uid", k.alias("k"), "score").where("k <= 2")


@query("flt_group_std", "SELECT uid, sample, score FROM rollouts WHERE uid IN (SELECT uid FROM rollouts GROUP BY uid HAVING min(score) <> max(score) OR count(*) = 1)", "rollouts")
def flt_group_std(spark, d):
    return G.keep_spread(V.rollouts(spark, d)).select("uid", "sample", "score")


@query("agg_majority", "WITH v AS (SELECT uid, acc AS vote, count(*) AS c, min(sample) AS f, min_by(score, sample) AS s FROM rollouts GROUP BY uid, acc) SELECT uid, vote, s AS value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY c DESC, f) AS k FROM v) WHERE k = 1", "rollouts")
def agg_majority(spark, d):
    v = V.rollouts(spark, d).groupBy("uid", "acc").agg(F.count(F.lit(1)).alias("c"), F.min("sample").alias("f"), F.min_by("score", "sample").alias("s"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "f", F.col("acc").alias("vote"), "s"))
    return v.groupBy("uid").agg(best.alias("b")).select("uid", "b.vote", F.col("b.s").alias("value"))


@query("agg_source_mean", "WITH p AS (SELECT uid, avg(score) AS m, max(acc) AS source FROM rollouts GROUP BY uid) SELECT source, round(avg(m), 6) AS mean, count(*) AS n FROM p GROUP BY source", "rollouts")
def agg_source_mean(spark, d):
    p = V.rollouts(spark, d).groupBy("uid").agg(F.avg("score").alias("m"), F.max("acc").alias("source"))
    return p.groupBy("source").agg(r6(F.avg("m")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("agg_acc_mean", "SELECT round(avg(acc), 6) AS acc FROM rollouts", "rollouts")
def agg_acc_mean(spark, d):
    return V.rollouts(spark, d).agg(r6(F.avg("acc")).alias("acc"))


@query("agg_reduce", "SELECT 'score/max' AS name, round(max(score), 6) AS value FROM rollouts UNION ALL SELECT 'score/min', round(min(score), 6) FROM rollouts UNION ALL SELECT 'score', round(avg(score), 6) FROM rollouts", "rollouts")
def agg_reduce(spark, d):
    named = V.rollouts(spark, d).select(F.explode(F.array(F.lit("score/max"), F.lit("score/min"), F.lit("score"))).alias("name"), "score")
    return named.groupBy("name").agg(F.max("score").alias("a"), F.min("score").alias("b"), F.avg("score").alias("c")).select("name", r6(F.when(F.col("name").contains("max"), F.col("a")).when(F.col("name").contains("min"), F.col("b")).otherwise(F.col("c"))).alias("value"))


@query("agg_reward", "SELECT coalesce(l_returnflag, 'all') AS name, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))")
def agg_reward(spark, d):
    return table(spark, d, "lineitem").groupingSets([[], ["l_returnflag"]], "l_returnflag").agg(r6(F.avg("l_quantity")).alias("mean")).select(F.coalesce("l_returnflag", F.lit("all")).alias("name"), "mean")


@query("agg_dist_stats", "SELECT round(avg(score), 6) AS mean, round(max(score), 6) AS top, round(min(score), 6) AS low, round(stddev_samp(score), 6) AS std FROM rollouts", "rollouts")
def agg_dist_stats(spark, d):
    return V.rollouts(spark, d).agg(r6(F.avg("score")).alias("mean"), r6(F.max("score")).alias("top"), r6(F.min("score")).alias("low"), r6(F.stddev_samp("score")).alias("std"))


@query("agg_dist_masked_mean", "SELECT round(sum(reward * mask) / sum(mask), 6) + 0.0 AS mean FROM tokens", "tokens")
def agg_dist_masked_mean(spark, d):
    return V.tokens(spark, d).agg(r6(F.sum(F.col("reward") * F.col("mask")) / F.sum("mask")).alias("mean"))


@query("agg_probs_diff", "SELECT round(max(x), 6) AS top, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT abs(exp(old_lp) - exp(new_lp)) AS x FROM tokens WHERE mask = 1)", "tokens")
def agg_probs_diff(spark, d):
    x = F.abs(F.exp("old_lp") - F.exp("new_lp"))
    return V.tokens(spark, d).where("mask = 1").agg(r6(F.max(x)).alias("top"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"))


@query("agg_timing_reduce", "SELECT event_type AS stage, round(avg(value), 6) AS seconds FROM events GROUP BY 1")
def agg_timing_reduce(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(r6(F.avg("value")).alias("seconds"))


@query("agg_turns", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def agg_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
