"""Policy training over the rollouts and tokens views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import groups as G
from spindrift.operators import policies as L
from spindrift.plans import views as V
from spindrift.plans.group_plans import _recursive
from spindrift.plans.registry import query, r6, table

#: Groups that the operators take: of more than one row, or of an even number.
_EVEN = "e AS (SELECT *, (sample - 1) // 2 AS pair FROM rollouts WHERE uid IN (SELECT uid FROM rollouts GROUP BY uid HAVING count(*) % 2 = 0)), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY uid, pair ORDER BY score DESC, sample) = 1 THEN 1 ELSE 0 END AS chosen FROM e)"


def even(spark, d):
    r = V.rollouts(spark, d)
    return r.join(r.groupBy("uid").count().where("count % 2 = 0"), "uid", "left_semi")


@query("win_pref_pair", f"WITH {_EVEN} SELECT uid, sample, chosen FROM p", "rollouts")
def win_pref_pair(spark, d):
    return L.preference_pairs(even(spark, d)).select("uid", "sample", "chosen")


@query("flt_pref_split", f"WITH {_EVEN} SELECT uid, pair, max(CASE WHEN chosen = 1 THEN score END) AS chosen_score, max(CASE WHEN chosen = 1 THEN len END) AS chosen_len, max(CASE WHEN chosen = 0 THEN score END) AS rejected_score, max(CASE WHEN chosen = 0 THEN len END) AS rejected_len FROM p GROUP BY uid, pair", "rollouts")
def flt_pref_split(spark, d):
    return L.split_pairs(L.preference_pairs(even(spark, d)), ["score", "len"])


@query("win_passk", "WITH r AS (SELECT *, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, row_number() OVER o AS k, lead(score) OVER o AS second FROM rollouts WINDOW w AS (PARTITION BY uid), o AS (PARTITION BY uid ORDER BY score DESC, sample)) SELECT uid, sample, round(CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage FROM r WHERE n > 1", "rollouts")
def win_passk(spark, d):
    r = V.rollouts(spark, d)
    r = r.join(r.groupBy("uid").count().where("count > 1"), "uid", "left_semi")
    return G.pass_k(r, ["sample"]).select("uid", "sample", r6("advantage").alias("advantage"))


@query("flt_group_fill", "WITH r AS (SELECT *, uid // 100 AS batch FROM rollouts), k AS (SELECT batch, uid FROM r GROUP BY batch, uid HAVING min(score) <> max(score) OR count(*) = 1), c AS (SELECT batch, sum(count(*)) OVER (ORDER BY batch) AS seen FROM k GROUP BY batch), e AS (SELECT min(batch) AS last FROM c WHERE seen >= 512) SELECT uid, sample FROM (SELECT r.*, row_number() OVER (ORDER BY r.batch, r.uid, sample) AS n FROM r JOIN k USING (batch, uid), e WHERE r.batch <= last) WHERE n <= 1024", "rollouts")
def flt_group_fill(spark, d):
    """512 prompts of two rows, from batches of a hundred prompts."""
    return L.fill_groups(V.rollouts(spark, d).withColumn("batch", F.floor(F.col("uid") / 100)), 512, 2, 100).select("uid", "sample")


@query("flt_prime", "WITH g AS (SELECT *, CASE WHEN avg(acc) OVER w BETWEEN 0.2 AND 0.8 AND max(len) OVER w < 69 THEN 1 ELSE 0 END AS ok FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT uid, sample, ok FROM (SELECT *, row_number() OVER (ORDER BY ok DESC, uid, sample) AS k FROM g) WHERE k <= (SELECT count(*) // 4 FROM g)", "rollouts")
def flt_prime(spark, d):
    return L.oversampled(V.rollouts(spark, d), 0.2, 0.8, 70, 4).select("uid", "sample", "ok")


@query("flt_interleave", "WITH s AS (SELECT o_orderkey, o_orderstatus AS kind, (o_orderkey * 7919 + 13) % 104729 AS h FROM orders WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, o_orderkey) - 1 AS i FROM s), m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM s GROUP BY kind)) SELECT kind, o_orderkey, i * 2 + CASE kind WHEN 'F' THEN 0 ELSE 1 END AS place FROM n, m WHERE i < c")
def flt_interleave(spark, d):
    """Two kinds in turn, each in a seeded order (an arithmetic hash, so that both engines agree)."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), ((F.col("o_orderkey") * 7919 + 13) % 104729).alias("h"))
    return L.interleave(o, "kind", ("F", "O"), ["h", "o_orderkey"]).select("kind", "o_orderkey", "place")


@query("flt_label", "SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN '' WHEN toxic = 0 THEN CAST(quality AS VARCHAR) END AS label FROM labels) WHERE label <> ''")
def flt_label(spark, d):
    """Rows with a label: neither null nor empty."""
    label = F.when(F.col("toxic") == 1, "").when(F.col("toxic") == 0, F.col("quality").cast("string"))
    return table(spark, d, "labels").select("doc_id", label.alias("label")).where("label <> ''")


@query("flt_sft_budget", "SELECT id FROM spans WHERE l_partkey % 3000 + 4096 + 2048 <= 8192 AND NOT gs >= ge", "spans")
def flt_sft_budget(spark, d):
    """Room for the tokens (l_partkey stands for their number), the video and the answer; then a true span that is not empty."""
    return V.spans(spark, d).where("l_partkey % 3000 + 4096 + 2048 <= 8192 and not gs >= ge").select("id")


@query("win_remax", "WITH t AS (SELECT *, sum(reward * mask) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret, first_value(v) OVER (PARTITION BY uid ORDER BY pos) AS base FROM tokens) SELECT uid, pos, round(ret, 6) + 0.0 AS returns, round(ret - base * mask, 6) + 0.0 AS advantage FROM t", "tokens")
def win_remax(spark, d):
    """The baseline is each sequence's own (here its first value)."""
    ret = F.sum(F.col("reward") * F.col("mask")).over(L.later("uid", "pos"))
    base = F.first("v").over(Window.partitionBy("uid").orderBy("pos"))
    return V.tokens(spark, d).select("uid", "pos", r6(ret).alias("returns"), r6(ret - base * F.col("mask")).alias("advantage"))


_RFPP = "WITH RECURSIVE x(uid, pos, ret, carry, mask) AS (SELECT uid, pos, reward, reward * mask, mask FROM tokens t WHERE pos = (SELECT max(pos) FROM tokens u WHERE u.uid = t.uid) UNION ALL SELECT t.uid, t.pos, t.reward + 0.99 * x.carry, (t.reward + 0.99 * x.carry) * t.mask, t.mask FROM x JOIN tokens t ON t.uid = x.uid AND t.pos = x.pos - 1), a AS (SELECT sum(mask)::DOUBLE AS n, sum(ret * mask) / (sum(mask) + 1e-8) AS m FROM x), b AS (SELECT n, m, (SELECT sum((ret - m) * (ret - m) * mask) FROM x, a) / (n + 1e-8) * n / (n - 1) AS v FROM a) SELECT uid, pos, round(ret, 6) + 0.0 AS returns, round((ret - m) / sqrt(v + 1e-8) * mask, 6) + 0.0 AS advantage FROM x, b"


@query("win_rfpp", _recursive(_RFPP))
def win_rfpp(spark, d):
    """Discounted returns that stop at masked tokens; whitened over the batch and masked again."""
    both = F.arrays_zip(F.col("reward").alias("r"), F.col("mask").alias("m"))
    empty = F.array().cast("array<double>")
    fold = F.aggregate(F.reverse(both), F.struct(F.lit(0.0).alias("c"), empty.alias("o")), lambda a, x: F.struct(((x["r"] + 0.99 * a["c"]) * x["m"]).alias("c"), F.array_append(a["o"], x["r"] + 0.99 * a["c"]).alias("o")))
    s = V.sequences(spark, d).select("uid", F.posexplode(F.arrays_zip(F.reverse(fold["o"]).alias("ret"), "mask")).alias("i", "x"))
    t = G.whiten(s.select("uid", (F.col("i") + 1).cast("long").alias("pos"), "x.ret", "x.mask"), "ret", "mask")
    return t.select("uid", "pos", r6("ret").alias("returns"), r6(F.col("white") * F.col("mask")).alias("advantage"))


@query("win_softmean", "WITH m AS (SELECT max(score) AS top, avg(score) AS mean FROM rollouts), s AS (SELECT top + ln(avg(exp(2 * (score - top)))) / 2 AS sm, any_value(mean) AS mean FROM rollouts, m GROUP BY top) SELECT uid, sample, round(score - sm, 6) + 0.0 AS advantage, round(score - mean, 6) + 0.0 AS plain FROM rollouts, s", "rollouts")
def win_softmean(spark, d):
    soft = L.soft_mean(V.rollouts(spark, d), 2.0)
    return L.soft_mean(soft.withColumnRenamed("advantage", "soft"), 0.0).select("uid", "sample", r6("soft").alias("advantage"), r6("advantage").alias("plain"))


@query("win_dpo_abs", "SELECT uid, CASE WHEN sign(sum(reward * mask)) = sign(2 * (uid % 2) - 1) THEN 1 ELSE 0 END AS x FROM tokens GROUP BY uid", "tokens")
def win_dpo_abs(spark, d):
    s = V.tokens(spark, d).groupBy("uid").agg(F.signum(F.sum(F.col("reward") * F.col("mask"))).alias("s"))
    return s.select("uid", (F.col("s") == F.signum(2.0 * (F.col("uid") % 2) - 1)).cast("int").alias("x"))


@query("win_prime_dpo", "WITH c AS (SELECT *, coalesce(CASE WHEN acc = 1 THEN avg(CASE WHEN acc = 0 THEN score END) OVER w ELSE avg(CASE WHEN acc = 1 THEN score END) OVER w END, 0) AS other, count(*) OVER w AS n, cume_dist() OVER (PARTITION BY uid ORDER BY score) AS cdf FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT uid, sample, round(score - other, 6) + 0.0 AS contrast, round(-ln(1 / (1 + exp(-0.5 * (score - other) * (2 * acc - 1)))), 6) + 0.0 AS loss, round(n * power(cdf, n - 1), 6) + 0.0 AS weight FROM c", "rollouts")
def win_prime_dpo(spark, d):
    """Contrast with the mean of the other rows of the group, its loss, and the best-of-n weight from the group's distribution of scores."""
    w = Window.partitionBy("uid")
    of = lambda k: F.avg(F.when(F.col("acc") == k, F.col("score"))).over(w)
    other, n = F.coalesce(F.when(F.col("acc") == 1, of(0)).otherwise(of(1)), F.lit(0.0)), F.count(F.lit(1)).over(w)
    x = V.rollouts(spark, d).withColumns({"contrast": F.col("score") - other, "weight": n * F.pow(F.cume_dist().over(w.orderBy("score")), n - 1)})
    loss = F.log1p(F.exp(-0.5 * F.col("contrast") * (2 * F.col("acc") - 1)))
    return x.select("uid", "sample", r6("contrast").alias("contrast"), r6(loss).alias("loss"), r6("weight").alias("weight"))


def responses(spark, d):
    """Sequences of tokens whose mask is a prefix: all but the last two tokens, and one at least."""
    t = V.tokens(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    return t.withColumns({"mask": (F.col("pos") <= F.greatest(n - 2, F.lit(1))).cast("int"), "rm": F.col("reward"), "acc": (F.col("uid") % 2).cast("double"), "group": F.floor(F.col("uid") / 4)})


_RESPONSES = "q AS MATERIALIZED (SELECT uid, pos, reward AS rm, new_lp, old_lp, uid % 2 AS acc, uid // 4 AS grp, CASE WHEN pos <= greatest(count(*) OVER (PARTITION BY uid) - 2, 1) THEN 1 ELSE 0 END AS mask FROM tokens), z AS MATERIALIZED (SELECT *, sum(mask) OVER (PARTITION BY uid) AS n FROM q)"


@query("win_prime_implicit", f"WITH {_RESPONSES}, b AS MATERIALIZED (SELECT *, 0.05 * (new_lp - old_lp) * mask AS q FROM z), f AS MATERIALIZED (SELECT *, CASE WHEN pos = n THEN acc - sum(CASE WHEN pos < n THEN q ELSE 0 END) OVER (PARTITION BY uid) ELSE q END AS fixed FROM b), l AS (SELECT a.uid, a.pos, sum(power(0.9, c.pos - a.pos) * c.fixed) AS r FROM f a JOIN f c ON a.uid = c.uid AND c.pos >= a.pos GROUP BY a.uid, a.pos) SELECT uid, pos, round(CASE WHEN pos < n THEN q ELSE 0 END, 8) + 0.0 AS plain, round(CASE WHEN pos = n THEN r ELSE 0 END, 8) + 0.0 AS folded FROM f JOIN l USING (uid, pos)", "tokens")
def win_prime_implicit(spark, d):
    r = L.implicit_rewards(responses(spark, d), 0.05).withColumnRenamed("reward_token", "plain")
    r = L.implicit_rewards(r, 0.05, lam=0.9, use_truth=True, granularity="whole")
    return r.select("uid", "pos", (F.round("plain", 8) + 0.0).alias("plain"), (F.round("reward_token", 8) + 0.0).alias("folded"))


@query("win_prime_rloo", f"WITH {_RESPONSES}, m AS (SELECT grp, count(*) AS k, sum(rm) AS rms, sum(acc) AS accs FROM (SELECT grp, uid, sum(rm * mask) / any_value(n) AS rm, any_value(acc) AS acc FROM z GROUP BY grp, uid) GROUP BY grp), x AS (SELECT uid, pos, mask, (5.0 * (rm * k / (k - 1) - rms / (k - 1)) + CASE WHEN pos = n THEN 3.0 * (acc * k / (k - 1) - accs / (k - 1)) ELSE 0 END) * mask AS x FROM z JOIN m USING (grp) WHERE k > 1) SELECT uid, pos, round(sum(x) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS returns FROM x", "tokens")
def win_prime_rloo(spark, d):
    """Groups of one have no baseline and are not part of the contract's fixed blocks."""
    r = responses(spark, d)
    blocks = r.select("group", "uid").distinct().groupBy("group").count().where("count > 1").select("group")
    return L.prime_rloo(r.join(blocks, "group", "left_semi"), 5.0, 3.0).select("uid", "pos", r6("returns").alias("returns"))
