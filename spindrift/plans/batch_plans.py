"""Batch algebra, joins, filters, order and sampling over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import batch as B
from spindrift.operators import records as R
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table

_R = "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"
_N = "(SELECT count(*) FROM r)"


def rows(spark, d) -> DataFrame:
    """Orders numbered from 0."""
    return B.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("prj_select", "SELECT o_orderkey, o_totalprice FROM orders")
def prj_select(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("prj_pop", "SELECT o_orderkey, o_custkey FROM orders")
def prj_pop(spark, d):
    return B.pop(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])[0]


@query("prj_rename", "SELECT o_orderkey AS k, o_custkey AS c FROM orders")
def prj_rename(spark, d):
    return B.rename(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], ["k", "c"])


@query("prj_len", "SELECT count(*) AS n FROM orders")
def prj_len(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))


@query("prj_keys", "SELECT name, n FROM (SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(CASE WHEN o_custkey % 3 = 0 THEN 1 END) AS extra FROM orders) UNPIVOT (n FOR name IN (o_orderkey, o_custkey, extra))")
def prj_keys(spark, d):
    """The keys of a batch, each with how many of its rows have a value."""
    return B.keys(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 3 == 0, "x").alias("extra")))


@query("prj_collate", "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1")
def prj_collate(spark, d):
    x = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(x.getField("l_quantity").alias("q"))


@query("prj_response_suffix", "SELECT conv_id, turn, substr(role || ': ' || text, len(role) + 3) AS response FROM conversations")
def prj_response_suffix(spark, d):
    whole, head = F.concat("role", F.lit(": "), "text"), F.concat("role", F.lit(": "))
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring(whole, F.char_length(head) + 1, F.char_length(whole)).alias("response"))


@query("flt_mask", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def flt_mask(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query("flt_slice", _R + f" SELECT o_orderkey FROM r WHERE rn >= 10 AND rn < {_N} - 5 AND (rn - 10) % 3 = 0")
def flt_slice(spark, d):
    return B.slice_rows(rows(spark, d), 10, -5, 3).select("o_orderkey")


@query("flt_overlong", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 100")
def flt_overlong(spark, d):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, d, "documents").where(n <= 100).select("doc_id")


@query("flt_gt_span", "SELECT id FROM spans WHERE NOT gs >= ge", "spans")
def flt_gt_span(spark, d):
    return V.spans(spark, d).where("not gs >= ge").select("id")


@query("flt_date", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1994-01-00' AND strftime(o_orderdate, '%Y-%m-%d') < '1995-06-00'")
def flt_date(spark, d):
    day = F.col("o_orderdate")  # months as whole days, so that the filter reaches the file
    return table(spark, d, "orders").where((day >= F.lit("1994-01-01").cast("timestamp")) & (day < F.lit("1995-06-01").cast("timestamp"))).select("o_orderkey")


@query("flt_modality", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'image' WHEN o_orderstatus = 'O' THEN 'video' END AS kind FROM orders")
def flt_modality(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "image").when(F.col("o_orderstatus") == "O", "video").alias("kind"))


@query("jn_semi", "SELECT id FROM predictions SEMI JOIN (SELECT id FROM spans WHERE l_partkey % 10 <> 0) t USING (id)", "predictions")
def jn_semi(spark, d):
    truth = V.spans(spark, d).where("l_partkey % 10 <> 0").select("id")
    return V.predictions(spark, d).select("id").join(truth, "id", "left_semi")


@query("jn_anti", "SELECT id FROM predictions ANTI JOIN (SELECT id FROM spans WHERE l_partkey % 10 <> 0) t USING (id)", "predictions")
def jn_anti(spark, d):
    truth = V.spans(spark, d).where("l_partkey % 10 <> 0").select("id")
    return V.predictions(spark, d).select("id").join(truth, "id", "left_anti")


@query("jn_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def jn_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


@query("jn_last_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def jn_last_wins(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return B.last_wins(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("jn_zip", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def jn_zip(spark, d):
    o = table(spark, d, "orders")
    return B.union_columns(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("jn_broadcast", "SELECT o_orderkey, n FROM orders, (SELECT count(*) AS n FROM nation)")
def jn_broadcast(spark, d):
    one = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").select("o_orderkey").crossJoin(F.broadcast(one))


@query("srt_reorder", _R + f" SELECT ({_N} - 1 - rn) AS rn, o_orderkey FROM r")
def srt_reorder(spark, d):
    r = rows(spark, d)
    order = r.select(F.col("rn").alias("idx"), (F.lit(r.count() - 1) - F.col("rn")).alias("pos"))
    return B.reorder(r, order).select("rn", "o_orderkey")


@query("srt_inverse", _R + f" SELECT (rn * 7) % 15001 AS pos, rn AS idx FROM r")
def srt_inverse(spark, d):
    return B.inverse(rows(spark, d).select(F.col("rn").alias("pos"), (F.col("rn") * 7 % 15001).alias("idx")))


@query("srt_num_suffix", "SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT), name) AS k FROM (SELECT DISTINCT 'frame_' || o_custkey AS name FROM orders)")
def srt_num_suffix(spark, d):
    names = table(spark, d, "orders").select(F.concat(F.lit("frame_"), "o_custkey").alias("name")).distinct()
    n = B.numbered(names.withColumn("s", F.regexp_extract("name", r"(\d+)$", 1).cast("long")), "s", "name")
    return n.select("name", (F.col("rn") + 1).alias("k"))


@query("srt_first_n_group", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def srt_first_n_group(spark, d):
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", k.alias("k")).where("k <= 3").drop("k")


@query("lim_align", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1024")
def lim_align(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(1024)


@query("set_concat", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def set_concat(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return B.concat(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")).select("o_orderkey")


@query("set_concat_ds", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def set_concat_ds(spark, d):
    return B.concat(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("set_chunk", _R + f" SELECT o_orderkey, (rn * 4 // {_N})::BIGINT AS part FROM r")
def set_chunk(spark, d):
    r = rows(spark, d)
    return r.select("o_orderkey", B.chunk_id(F.col("rn"), r.count(), 4).alias("part"))


@query("set_pad", _R + f", p AS (SELECT (4096 - {_N} % 4096) % 4096 AS need) SELECT rn, o_orderkey FROM r UNION ALL SELECT rn + k * {_N}, o_orderkey FROM r, p, range(1, 3) t(k) WHERE rn + (k - 1) * {_N} < need")
def set_pad(spark, d):
    return B.pad_to_multiple(rows(spark, d), 4096).select("rn", "o_orderkey")


@query("set_unpad", _R + f" SELECT o_orderkey FROM r WHERE rn < {_N} - 7")
def set_unpad(spark, d):
    return B.unpad(rows(spark, d), 7).select("o_orderkey")


@query("set_pad_edge", _R + f" SELECT rn, o_orderkey FROM r UNION ALL SELECT {_N} + k, (SELECT max(o_orderkey) FROM r) FROM range(0, 3) t(k)")
def set_pad_edge(spark, d):
    return B.pad_edge(rows(spark, d), 3, "last").select("rn", "o_orderkey")


@query("set_repeat", _R + " SELECT rn * 2 + k AS rn, o_orderkey FROM r, range(0, 2) t(k)")
def set_repeat(spark, d):
    return B.repeat(rows(spark, d), 2).select("rn", "o_orderkey")


@query("set_repeat_tiled", _R + f" SELECT k * {_N} + rn AS rn, o_orderkey FROM r, range(0, 2) t(k)")
def set_repeat_tiled(spark, d):
    return B.repeat(rows(spark, d), 2, interleave=False).select("rn", "o_orderkey")


@query("set_repeat_n", "SELECT o_orderkey, k::INTEGER AS copy FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 3)) AS k FROM orders)")
def set_repeat_n(spark, d):
    return B.repeat_by(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") % 3)


@query("set_fold", _R + " SELECT rn // 5 AS g, list(o_orderkey ORDER BY rn) AS xs FROM r GROUP BY 1")
def set_fold(spark, d):
    r = rows(spark, d).groupBy(F.floor(F.col("rn") / 5).cast("long").alias("g"))
    return r.agg(F.sort_array(F.collect_list(F.struct("rn", "o_orderkey"))).getField("o_orderkey").alias("xs"))


@query("set_unfold", _R + " SELECT rn // 5 AS g, rn % 5 AS i, o_orderkey FROM r")
def set_unfold(spark, d):
    return set_fold(spark, d).select("g", F.posexplode("xs").alias("i", "o_orderkey")).select("g", F.col("i").cast("long").alias("i"), "o_orderkey")


@query("set_unfold_cols", "SELECT vec_id, k, embedding[k * 16 + 1:k * 16 + 16] AS part FROM embeddings, range(0, 4) t(k)")
def set_unfold_cols(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(parts).alias("k", "part")).select("vec_id", F.col("k").cast("long").alias("k"), "part")


@query("set_minibatch", _R + " SELECT e::INTEGER AS epoch, rn // 100 AS batch, o_orderkey FROM r, range(0, 2) t(e)")
def set_minibatch(spark, d):
    return B.minibatches(rows(spark, d), 100, 2).select("epoch", "batch", "o_orderkey")


@query("set_allgather", "SELECT r_regionkey, n_nationkey FROM region, nation")
def set_allgather(spark, d):
    return table(spark, d, "region").select("r_regionkey").crossJoin(F.broadcast(table(spark, d, "nation").select("n_nationkey")))  # 25 rows by the benchmark's definition


@query("set_prompt_responses", "SELECT uid, list(score ORDER BY sample) AS responses FROM rollouts GROUP BY uid", "rollouts")
def set_prompt_responses(spark, d):
    return V.rollouts(spark, d).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("sample", "score"))).getField("score").alias("responses"))


@query("smp_round_robin", _R + " SELECT o_orderkey, rn % 7 AS part FROM r")
def smp_round_robin(spark, d):
    return rows(spark, d).select("o_orderkey", (F.col("rn") % 7).alias("part"))


@query("smp_reweight_weights", "SELECT uid, sample, round(abs(score) ** 2 + 1e-8, 6) AS pow, CASE WHEN score = max(score) OVER () THEN 1.0 ELSE 0.0 END::DOUBLE AS top, CASE WHEN score > 0.5 THEN 0.4 ELSE 0.1 END::DOUBLE AS split FROM rollouts", "rollouts")
def smp_reweight_weights(spark, d):
    r = V.rollouts(spark, d)
    top = F.broadcast(r.agg(F.max("score").alias("m")))
    return r.crossJoin(top).select("uid", "sample", r6(F.abs("score") * F.abs("score") + 1e-8).alias("pow"), (F.col("score") == F.col("m")).cast("double").alias("top"), F.when(F.col("score") > 0.5, 0.4).otherwise(0.1).alias("split"))


@query("smp_random", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS rn FROM orders")
def smp_random(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", R.seeded(42, "o_orderkey").alias("h"))
    return B.numbered(r, "h", "o_orderkey").select("o_orderkey", "rn")


@query("smp_seq", _R + " SELECT o_orderkey, rn FROM r")
def smp_seq(spark, d):
    return rows(spark, d).select("o_orderkey", "rn")


@query("smp_distributed", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS rn FROM orders) SELECT o_orderkey, rn % 8 AS rank FROM r WHERE rn < (SELECT count(*) // 8 * 8 FROM orders)")
def smp_distributed(spark, d):
    """Seeded order cut to a multiple of the ranks, dealt by remainder."""
    r = B.numbered(table(spark, d, "orders").select("o_orderkey", R.seeded(7, "o_orderkey").alias("h")), "h", "o_orderkey")
    n = r.count()
    return r.where(F.col("rn") < n - n % 8).select("o_orderkey", (F.col("rn") % 8).alias("rank"))


@query("smp_reweight")
def smp_reweight(spark, d):
    """n of n with replacement by weight: seeded multinomial counts, over blocks and then within them."""
    from spindrift.operators.packing import resample

    return resample(V.rollouts(spark, d).select("uid", "sample", (F.abs("score") + 1e-8).alias("w")), "w", ["uid", "sample"], seed=42)


@query("prt_modal_balance", _R + ", k AS (SELECT *, (rn // 5) % 4 = 0 AS image FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY rn) - 1 AS i FROM k) SELECT o_orderkey, i % 8 AS part, image FROM n")
def prt_modal_balance(spark, d):
    r = rows(spark, d).withColumn("image", F.floor(F.col("rn") / 5) % 4 == 0)
    parts = [B.numbered(r.where(F.col("image") == k).withColumnRenamed("rn", "old"), "old") for k in (True, False)]
    return parts[0].unionByName(parts[1]).select("o_orderkey", (F.col("rn") % 8).alias("part"), "image")


for _name, _kind in (("prt_kk", "kk"), ("prt_greedy", "greedy"), ("prt_balanced", "balanced"), ("prt_micro", "micro")):

    @query(_name)
    def _packed(spark, d, kind=_kind):
        """Rows of every batch (by order of item) dealt into parts of even token counts."""
        from spindrift.operators.packing import partition

        df = V.rollouts(spark, d).select(F.floor(F.col("uid") / 40).alias("batch"), (F.col("uid") * 100 + F.col("sample")).alias("item"), "len")
        return partition(df, kind)
