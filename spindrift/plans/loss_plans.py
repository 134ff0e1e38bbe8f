"""Lengths, sequence log-probabilities, penalties and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.operators import losses as L
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6


@query("arr_lengths", "SELECT uid, sum(CASE WHEN pos <= 10 THEN mask ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN pos > 10 THEN mask ELSE 0 END)::BIGINT AS response FROM tokens GROUP BY uid", "tokens")
def arr_lengths(spark, d):
    n = lambda x: A.total(x.cast("array<double>")).cast("long")
    response = F.slice("mask", F.lit(11), F.greatest(F.size("mask") - 10, F.lit(0)))
    return V.sequences(spark, d).select("uid", n(F.slice("mask", 1, 10)).alias("prompt"), n(response).alias("response"))


@query("arr_seq_logp", "SELECT uid, round(coalesce(sum(new_lp) FILTER (WHERE mask = 1 AND pos > 1), 0), 6) + 0.0 AS total, round(coalesce(sum(new_lp) FILTER (WHERE mask = 1 AND pos > 1), 0) / greatest(count(*) FILTER (WHERE mask = 1 AND pos > 1), 1), 6) + 0.0 AS mean FROM tokens GROUP BY uid", "tokens")
def arr_seq_logp(spark, d):
    """Labels without a mask are ignored."""
    labels = F.transform("mask", lambda m: F.when(m == 1, 5).otherwise(-100))
    x = V.sequences(spark, d).withColumn("labels", labels)
    return x.select("uid", r6(L.sequence_logp(F.col("new_lp"), F.col("labels"))).alias("total"), r6(L.sequence_logp(F.col("new_lp"), F.col("labels"), average=True)).alias("mean"))


@query("arr_kl_reward", """WITH k AS (SELECT *, (old_lp - new_lp) * mask AS kl FROM tokens), b AS (SELECT avg(m) AS kl, count(*) AS n FROM (SELECT sum(kl * mask) / (sum(mask) + 1e-8) AS m FROM k GROUP BY uid))
  SELECT uid, pos, round(reward - 0.1 * k.kl, 6) + 0.0 AS r, round(b.kl, 6) + 0.0 AS batch_kl, round(0.1 * (1 + greatest(-0.2, least(0.2, b.kl / 0.05 - 1)) * n / 10000.0), 8) AS next_beta FROM k, b""", "tokens")
def arr_kl_reward(spark, d):
    """Penalised rewards, the batch's KL, and the coefficient that the controller sets for the next batch."""
    x = L.kl_penalised(V.tokens(spark, d), 0.1, target=0.05)
    return x.select("uid", "pos", r6("penalised").alias("r"), r6("batch_kl").alias("batch_kl"), F.round("next_beta", 8).alias("next_beta"))


@query("arr_value_loss", "WITH t AS (SELECT mask, reward AS ret, greatest(v - 0.1, least(v + 0.1, v + old_lp)) AS vc, v + old_lp AS vp FROM tokens) SELECT round(0.5 * sum(greatest((vp - ret) ** 2, (vc - ret) ** 2) * mask) / sum(mask), 6) + 0.0 AS loss, round(sum(CASE WHEN (vc - ret) ** 2 > (vp - ret) ** 2 THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipped FROM t", "tokens")
def arr_value_loss(spark, d):
    out = L.value_loss(V.tokens(spark, d), F.col("v") + F.col("old_lp"), F.col("v"), F.col("reward"), 0.1)
    return out.select(r6("loss").alias("loss"), r6("clipped").alias("clipped"))


_LS = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"


@query("arr_dpo_loss", f"""WITH s AS (SELECT uid % 5 AS pair, sum(new_lp) FILTER (WHERE uid % 10 < 5) AS c, sum(new_lp) FILTER (WHERE uid % 10 >= 5) AS j, sum(old_lp) FILTER (WHERE uid % 10 < 5) AS rc, sum(old_lp) FILTER (WHERE uid % 10 >= 5) AS rj FROM tokens GROUP BY 1),
  x AS (SELECT pair, c - j - (rc - rj) AS d, c - j AS f FROM s WHERE c IS NOT NULL AND j IS NOT NULL)
  SELECT pair, round(-{_LS.format('(0.1 * d)')}, 6) + 0.0 AS sigmoid, round(-{_LS.format('(0.1 * d)')} * 0.8 - {_LS.format('(-0.1 * d)')} * 0.2, 6) + 0.0 AS smoothed, round((d - 5) ** 2, 6) + 0.0 AS ipo, round(-{_LS.format('(0.1 * f)')}, 6) + 0.0 AS free FROM x""", "tokens")
def arr_dpo_loss(spark, d):
    """Pairs of users: plain, with smoothed labels, squared, and without a reference."""
    first = F.col("uid") % 10 < 5
    side = lambda c, k: F.sum(F.when(k, F.col(c)))
    s = V.tokens(spark, d).groupBy((F.col("uid") % 5).alias("pair")).agg(side("new_lp", first).alias("c"), side("new_lp", ~first).alias("j"), side("old_lp", first).alias("rc"), side("old_lp", ~first).alias("rj")).where("c is not null and j is not null")
    loss = lambda **k: r6(L.pair_loss(F.col("c"), F.col("j"), F.col("rc"), F.col("rj"), 0.1, **k))
    return s.select("pair", loss().alias("sigmoid"), loss(smoothing=0.2).alias("smoothed"), loss(kind="ipo").alias("ipo"), loss(reference_free=True).alias("free"))


@query("arr_sft_loss", """WITH t AS (SELECT uid, new_lp, lead(mask) OVER (PARTITION BY uid ORDER BY pos) AS m FROM tokens), p AS (SELECT uid % 2 AS worker, uid // 2 % 4 AS micro, sum(-new_lp * m) AS s, sum(m) AS n FROM t WHERE m IS NOT NULL GROUP BY ALL),
  w AS (SELECT worker, avg(s / (n + 1e-8)) AS l, avg(s / (a + 1e-8) * 2) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY micro) AS a FROM p) GROUP BY worker)
  SELECT round(avg(l), 6) + 0.0 AS loss, round(avg(b), 6) + 0.0 AS balanced FROM w""", "tokens")
def arr_sft_loss(spark, d):
    """Two workers of four micro-batches; a token's loss counts by the mask of the next one."""
    s = V.sequences(spark, d)
    n = F.size("mask") - 1
    pairs = F.arrays_zip(F.slice("new_lp", F.lit(1), n).alias("lp"), F.slice("mask", F.lit(2), n).alias("m"))
    rows = s.where(F.size("mask") > 1).select((F.col("uid") % 2).alias("worker"), (F.floor(F.col("uid") / 2) % 4).alias("micro"), F.explode(pairs).alias("x")).select("worker", "micro", (-F.col("x.lp")).alias("nll"), F.col("x.m").alias("m"))
    plain, balanced = (L.sft_step(rows, F.col("nll"), "m", "worker", "micro", b).select(r6("loss").alias(name)) for b, name in ((False, "loss"), (True, "balanced")))
    return plain.crossJoin(F.broadcast(balanced))  # one row each
