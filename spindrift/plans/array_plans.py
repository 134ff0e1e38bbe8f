"""Token-array functions over the sequences view; most oracles use the long layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.operators import groups as G
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table


def col(*names):
    return [F.col(n) for n in names]


def exploded(s, *cols):
    """Back to rows (uid, pos, ...)."""
    return s.select("uid", F.posexplode(F.arrays_zip(*cols)).alias("i", "x")).select("uid", (F.col("i") + 1).cast("long").alias("pos"), *[F.col(f"x.{c}").alias(c) for c in cols])


@query("arr_masked_sum", "SELECT uid, round(sum(reward * mask), 6) + 0.0 AS s FROM tokens GROUP BY uid", "tokens")
def arr_masked_sum(spark, d):
    return V.sequences(spark, d).select("uid", r6(A.masked_sum(*col("reward", "mask"))).alias("s"))


@query("arr_masked_mean", "SELECT uid, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS m FROM tokens GROUP BY uid", "tokens")
def arr_masked_mean(spark, d):
    return V.sequences(spark, d).select("uid", r6(A.masked_mean(*col("reward", "mask"))).alias("m"))


@query("arr_masked_var", "WITH m AS (SELECT uid, sum(reward * mask) / (sum(mask) + 1e-8) AS m, sum(mask)::DOUBLE AS n FROM tokens GROUP BY uid) SELECT uid, round(sum((reward - m) * (reward - m) * mask) / (n + 1e-8) * n / (n - 1), 6) + 0.0 AS v FROM tokens JOIN m USING (uid) WHERE n > 1 GROUP BY uid, n", "tokens")
def arr_masked_var(spark, d):
    s = V.sequences(spark, d).where(A.total(F.col("mask").cast("array<double>")) > 1)
    return s.select("uid", r6(A.masked_var(*col("reward", "mask"))).alias("v"))


@query("arr_whiten", "WITH a AS (SELECT sum(mask)::DOUBLE AS n, sum(reward * mask) AS s, sum(reward * reward * mask) AS q FROM tokens), b AS (SELECT *, s / (n + 1e-8) AS m FROM a) SELECT uid, pos, round((reward - m) / sqrt((q - 2 * m * s + m * m * n) / (n + 1e-8) * n / (n - 1) + 1e-8), 6) + 0.0 AS white FROM tokens, b", "tokens")
def arr_whiten(spark, d):
    return G.whiten(V.tokens(spark, d), "reward", "mask").select("uid", "pos", r6("white").alias("white"))


_IDS = "WITH s AS (SELECT uid, list(event_id % 7 ORDER BY pos) AS ids FROM (SELECT user_id AS uid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY uid)"


def ids(spark, d):
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("x"))
    return x.select("uid", F.transform("x.event_id", lambda e: e % 7).alias("ids"))


@query("arr_eos_mask", _IDS + " SELECT uid, CASE WHEN list_contains(ids, 3) THEN list_transform(ids, lambda x, i: CASE WHEN i <= len(ids) + 1 - list_position(list_reverse(ids), 3) THEN 1 ELSE 0 END) ELSE list_transform(ids, lambda x: 1) END AS mask FROM s")
def arr_eos_mask(spark, d):
    return ids(spark, d).select("uid", A.eos_mask(F.col("ids"), 3).alias("mask"))


@query("arr_pad", _IDS + " SELECT uid, list_concat(ids, list_transform(range(0, greatest(0, 80 - len(ids))), lambda x: 0)) AS r, list_concat(list_transform(range(0, greatest(0, 80 - len(ids))), lambda x: 0), ids) AS l FROM s")
def arr_pad(spark, d):
    zero = F.lit(0).cast("long")
    return ids(spark, d).select("uid", A.pad(F.col("ids"), 80, zero).alias("r"), A.pad(F.col("ids"), 80, zero, left=True).alias("l"))


@query("arr_pad_mask", _IDS + " SELECT uid, list_transform(range(0, greatest(80, len(ids))), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS mask FROM s")
def arr_pad_mask(spark, d):
    return ids(spark, d).select("uid", A.pad(F.transform("ids", lambda x: F.lit(1)), 80, 0).alias("mask"))


@query("arr_postprocess", _IDS + " SELECT uid, list_concat(list_transform(range(0, greatest(0, 64 - len(ids))), lambda x: 0), ids[greatest(1, len(ids) - 63):]) AS ids FROM s")
def arr_postprocess(spark, d):
    return ids(spark, d).select("uid", A.pad(A.truncate(F.col("ids"), 64, "left"), 64, F.lit(0).cast("long"), left=True).alias("ids"))


@query("lim_truncate", _IDS + " SELECT uid, ids[greatest(1, len(ids) - 9):] AS l, ids[1:10] AS r, CASE WHEN len(ids) > 10 THEN list_concat(ids[1:5], ids[len(ids) - 4:]) ELSE ids END AS m FROM s")
def lim_truncate(spark, d):
    x = F.col("ids")
    return ids(spark, d).select("uid", A.truncate(x, 10, "left").alias("l"), A.truncate(x, 10, "right").alias("r"), A.truncate(x, 10, "middle").alias("m"))


@query("arr_unpad", _IDS + " SELECT uid, ids AS ids FROM s")
def arr_unpad(spark, d):
    padded = ids(spark, d).select("uid", A.pad(F.col("ids"), 100, F.lit(0).cast("long"), left=True).alias("p"), F.size("ids").alias("n"))
    return padded.select("uid", F.slice("p", F.size("p") - F.col("n") + 1, F.col("n")).alias("ids"))


@query("arr_position_ids", "SELECT uid, pos, greatest(0, sum(mask) OVER (PARTITION BY uid ORDER BY pos) - 1)::BIGINT AS p FROM tokens", "tokens")
def arr_position_ids(spark, d):
    s = V.sequences(spark, d).withColumn("p", A.position_ids(F.col("mask")))
    return exploded(s, "p").select("uid", "pos", F.col("p").cast("long").alias("p"))


@query("arr_response_mask", "SELECT uid, list(mask ORDER BY pos)[-10:] AS m FROM tokens GROUP BY uid", "tokens")
def arr_response_mask(spark, d):
    return V.sequences(spark, d).select("uid", F.slice("mask", -10, 10).alias("m"))


@query("arr_overlong", "SELECT uid, sample, round(score + least(-(len - (40 - 20)) / 20.0 * 1.0, 0), 6) + 0.0 AS r FROM rollouts", "rollouts")
def arr_overlong(spark, d):
    return V.rollouts(spark, d).select("uid", "sample", r6(F.col("score") + F.least(-(F.col("len") - (40 - 20)) / 20.0, F.lit(0.0))).alias("r"))


@query("arr_kl", "SELECT uid, pos, round(old_lp - new_lp, 6) + 0.0 AS k1, round(abs(old_lp - new_lp), 6) + 0.0 AS ab, round(0.5 * (old_lp - new_lp) ** 2, 6) + 0.0 AS k2, round(greatest(-10, least(10, exp(new_lp - old_lp) - (new_lp - old_lp) - 1)), 6) + 0.0 AS k3 FROM tokens", "tokens")
def arr_kl(spark, d):
    a, b = col("old_lp", "new_lp")
    return V.tokens(spark, d).select("uid", "pos", *[r6(A.kl(a, b, k)).alias(n) for k, n in (("k1", "k1"), ("abs", "ab"), ("k2", "k2"), ("k3", "k3"))])


@query("arr_agg_loss", "WITH s AS (SELECT uid, sum(reward * mask) AS t, sum(mask) AS n FROM tokens GROUP BY uid) SELECT round(sum(t) / sum(n), 6) + 0.0 AS token_mean, round(avg(t), 6) + 0.0 AS seq_sum, round(avg(t / n), 6) + 0.0 AS seq_mean, round(sum(t) / 100, 6) + 0.0 AS seq_norm FROM s", "tokens")
def arr_agg_loss(spark, d):
    s = V.tokens(spark, d).groupBy("uid").agg(F.sum(F.col("reward") * F.col("mask")).alias("t"), F.sum("mask").alias("n"))
    return s.agg(r6(F.sum("t") / F.sum("n")).alias("token_mean"), r6(F.avg("t")).alias("seq_sum"), r6(F.avg(F.col("t") / F.col("n"))).alias("seq_mean"), r6(F.sum("t") / 100).alias("seq_norm"))


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), z AS (SELECT vec_id, label, x, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS z FROM e)"


def logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("arr_entropy", _E + " SELECT vec_id, round(z - list_sum(list_transform(x, lambda v: exp(v - z) * v)), 6) AS h FROM z")
def arr_entropy(spark, d):
    return logits(spark, d).select("vec_id", r6(A.entropy(F.col("x"))).alias("h"))


@query("arr_logprob", _E + " SELECT vec_id, round(x[label % 64 + 1] - z, 6) AS lp FROM z")
def arr_logprob(spark, d):
    return logits(spark, d).select("vec_id", r6(A.log_prob(F.col("x"), (F.col("label") % 64).cast("int"))).alias("lp"))


@query("arr_sppo_loss", "WITH s AS (SELECT uid, sum((new_lp - old_lp) * mask) AS x, sum(reward * mask) AS r, sum(mask) AS n FROM tokens GROUP BY uid) SELECT round(avg((x - r) ** 2), 6) + 0.0 AS loss FROM s WHERE n > 0", "tokens")
def arr_sppo_loss(spark, d):
    m = F.col("mask")
    s = V.tokens(spark, d).groupBy("uid").agg(F.sum((F.col("new_lp") - F.col("old_lp")) * m).alias("x"), F.sum(F.col("reward") * m).alias("r"), F.sum(m).alias("n"))
    return s.where("n > 0").agg(r6(F.avg((F.col("x") - F.col("r")) * (F.col("x") - F.col("r")))).alias("loss"))


@query("arr_dpo_rm_ce", "SELECT round(avg(-(acc * ln(1 / (1 + exp(-0.05 * score))) + (1 - acc) * ln(1 - 1 / (1 + exp(-0.05 * score))))), 6) AS ce FROM rollouts", "rollouts")
def arr_dpo_rm_ce(spark, d):
    x, y = 0.05 * F.col("score"), F.col("acc")
    return V.rollouts(spark, d).agg(r6(F.avg(-(y * A.log_sigmoid(x) + (1 - y) * A.log_sigmoid(-x)))).alias("ce"))


@query("arr_clip", "SELECT uid, pos, greatest(-0.3, least(0.3, old_lp))::DOUBLE AS x FROM tokens", "tokens")
def arr_clip(spark, d):
    s = V.sequences(spark, d).withColumn("x", F.transform("old_lp", lambda v: F.greatest(F.lit(-0.3), F.least(F.lit(0.3), v))))
    return exploded(s, "x")


@query("arr_sft_mask", "SELECT uid, pos, CASE WHEN pos < 10 OR pos = max(pos) OVER (PARTITION BY uid) THEN 0 ELSE 1 END AS m FROM tokens", "tokens")
def arr_sft_mask(spark, d):
    s = V.sequences(spark, d)
    return exploded(s.withColumn("m", F.transform("mask", lambda x, i: F.when((i < 9) | (i == F.size("mask") - 1), 0).otherwise(1))), "m")


@query("arr_label_mask", _IDS + " SELECT uid, list_transform(ids, lambda x, i: CASE WHEN i <= 5 THEN -100 ELSE x END) AS labels FROM s")
def arr_label_mask(spark, d):
    return ids(spark, d).select("uid", F.transform("ids", lambda x, i: F.when(i < 5, F.lit(-100).cast("long")).otherwise(x)).alias("labels"))


@query("arr_pair_encode", _IDS + " SELECT uid, list_concat(ids[1:3], list_concat(ids, list_transform(range(0, 20), lambda x: 0))[1:20])[1:20] AS x FROM s")
def arr_pair_encode(spark, d):
    x = F.concat(F.slice("ids", 1, 3), F.slice(A.pad(F.col("ids"), 20, F.lit(0).cast("long")), 1, 20))
    return ids(spark, d).select("uid", F.slice(x, 1, 20).alias("x"))


@query("arr_linspace", "SELECT id, list_transform(range(0, 8), lambda i: CAST(round_even(gs + i * (30.0 / 7), 0) AS BIGINT)) AS x FROM spans", "spans")
def arr_linspace(spark, d):
    return V.spans(spark, d).select("id", A.linspace(F.col("gs"), F.col("gs") + 30, F.lit(8)).alias("x"))


@query("arr_pad_even", _IDS + " SELECT uid, CASE WHEN len(ids) % 2 = 1 THEN list_append(ids, ids[-1]) ELSE ids END AS x FROM s")
def arr_pad_even(spark, d):
    return ids(spark, d).select("uid", F.when(F.size("ids") % 2 == 1, F.array_append("ids", F.element_at("ids", -1))).otherwise(F.col("ids")).alias("x"))


@query("arr_timestamps", "SELECT id, list_transform(range(0, 4), lambda i: printf('%.2f', gs + i / 2.0)) AS x FROM spans", "spans")
def arr_timestamps(spark, d):
    return V.spans(spark, d).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.format_string("%.2f", F.col("gs") + i / 2.0)).alias("x"))


@query("arr_zoom_slice", _IDS + " SELECT uid, ids[3:CAST(floor(len(ids) * 0.5) AS BIGINT)] AS x FROM s")
def arr_zoom_slice(spark, d):
    return ids(spark, d).select("uid", F.slice("ids", 3, F.greatest(F.lit(0), F.floor(F.size("ids") * 0.5).cast("int") - 2)).alias("x"))


@query("ret_dense", "WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) AS k FROM s) SELECT qid, k, vec_id, round(s, 6) + 0.0 AS score FROM r WHERE k <= 5")
def ret_dense(spark, d):
    from spindrift.operators.retrieval import dense

    e = table(spark, d, "embeddings")
    return dense(e.where("vec_id % 20 = 0"), e, 5).select("qid", F.col("k").cast("long").alias("k"), "vec_id", (F.col("score") + 0.0).alias("score"))


_BM = "WITH t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS f FROM t WHERE w <> '' GROUP BY ALL), dl AS (SELECT doc_id, sum(f) AS n FROM tf GROUP BY 1), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT item_id, w FROM (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark WHERE item_id % 20 = 0) WHERE w <> ''), s AS (SELECT item_id, doc_id, sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM dl)))) AS s FROM q JOIN tf USING (w) JOIN df USING (w) JOIN dl USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS k FROM s) SELECT item_id, k, doc_id, round(s, 6) AS score FROM r WHERE k <= 3"


@query("ret_bm25", _BM)
def ret_bm25(spark, d):
    from spindrift.operators.retrieval import bm25

    return bm25(table(spark, d, "benchmark").where("item_id % 20 = 0"), table(spark, d, "documents"), 3)


@query("ret_format", _BM.replace("SELECT item_id, k, doc_id, round(s, 6) AS score FROM r WHERE k <= 3", "SELECT item_id, list(doc_id ORDER BY k) AS docs FROM r WHERE k <= 3 GROUP BY item_id"))
def ret_format(spark, d):
    found = ret_bm25(spark, d)
    return found.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("k", "doc_id"))).getField("doc_id").alias("docs"))


@query("srt_topk_vec", "SELECT vec_id FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS s FROM embeddings) ORDER BY round(s, 6) DESC, vec_id LIMIT 10")
def srt_topk_vec(spark, d):
    from spindrift.operators.retrieval import dense

    e = table(spark, d, "embeddings")
    return dense(e.where("vec_id = 0"), e, 10).select("vec_id")
