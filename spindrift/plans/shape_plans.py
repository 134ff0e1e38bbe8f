"""Record shaping, sources and sinks, stateful replay, and scores checked by golden values."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import scores as P
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.operators import records as R
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table
from spindrift.sources import files
from spindrift.streaming import turns


@query("shp_gsm8k", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'Q' || l_partkey || ' Let''s think step by step and output the final answer after \"####\".' AS prompt, CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) AS truth FROM lineitem")
def shp_gsm8k(spark, d):
    x = table(spark, d, "lineitem")
    raw = F.concat(F.lit("so it is #### "), F.format_number(F.rint("l_extendedprice").cast("long"), 0))
    ask = F.concat(F.lit("Q"), F.col("l_partkey").cast("string"), F.lit(" Let's think step by step and output the final answer after \"####\"."))
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ask.alias("prompt"), T.gsm8k_strict(raw).alias("truth"))


@query("shp_hh_sft", "SELECT item_id, unnest(['c' || text, 'r' || text]) AS response, unnest([0, 1]) AS k FROM benchmark")
def shp_hh_sft(spark, d):
    both = F.array(F.concat(F.lit("c"), "text"), F.concat(F.lit("r"), "text"))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(both).alias("k", "response"))


@query("shp_hh_rm", "SELECT item_id, 'p' AS prompt, text AS chosen, reverse(text) AS rejected, CASE WHEN row_number() OVER (ORDER BY item_id) - 1 < (SELECT count(*) FROM benchmark) * 3 // 4 THEN 'train' ELSE 'test' END AS split FROM benchmark")
def shp_hh_rm(spark, d):
    b = B.numbered(table(spark, d, "benchmark"), "item_id")
    cut = b.count() * 3 // 4
    return b.select("item_id", F.lit("p").alias("prompt"), F.col("text").alias("chosen"), F.reverse("text").alias("rejected"), F.when(F.col("rn") < cut, "train").otherwise("test").alias("split"))


@query("shp_vqa_norm", "SELECT id, coalesce(CASE WHEN kind = 'A' THEN said END, gold) AS question, CAST(gold AS VARCHAR) AS answer FROM choices", "choices")
def shp_vqa_norm(spark, d):
    return V.choices(spark, d).select("id", F.coalesce(F.when(F.col("kind") == "A", F.col("said")), F.col("gold")).alias("question"), F.col("gold").alias("answer"))


_ASK = R.VIDEO_LINE + "\nUser Question: \n{input_text}\n"


@query("shp_template", "SELECT id, CASE WHEN l_suppkey % 2 = 0 THEN 'This is a video with duration ' || printf('%.1f', gs) || ' seconds.' ELSE 'This is an image.' END || chr(10) || 'User Question: ' || chr(10) || l_returnflag || ' {duration}' || chr(10) AS t FROM spans", "spans")
def shp_template(spark, d):
    """Videos for even suppliers, images for odd ones; a question may hold braces."""
    duration = F.when(F.col("l_suppkey") % 2 == 0, F.format_string("%.1f", "gs"))
    return V.spans(spark, d).select("id", R.fill_template(_ASK, F.concat("l_returnflag", F.lit(" {duration}")), duration).alias("t"))


@query("shp_mm_segments", "SELECT item_id, to_json([{'type': 'text', 'text': ''}, {'type': 'image', 'text': ''}, {'type': 'text', 'text': 'a' || item_id}, {'type': 'video', 'text': ''}, {'type': 'text', 'text': ''}])::VARCHAR AS parts FROM benchmark")
def shp_mm_segments(spark, d):
    """Text cut at media tags; the tags stay as typed parts and empty text parts too."""
    t = F.concat(F.lit("<image>a"), F.col("item_id").cast("string"), F.lit("<video>"))
    texts, tags = F.split(t, "<image>|<video>"), F.regexp_extract_all(t, F.lit("<(image|video)>"), 1)
    part = lambda k, v: F.struct(k.alias("type"), v.alias("text"))
    mixed = F.flatten(F.transform(texts, lambda x, i: F.when(i < F.size(tags), F.array(part(F.lit("text"), x), part(F.get(tags, i), F.lit("")))).otherwise(F.array(part(F.lit("text"), x)))))
    return table(spark, d, "benchmark").select("item_id", F.to_json(mixed).alias("parts"))


@query("shp_nested_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def shp_nested_key(spark, d):
    """Through a map, a struct and arrays of one element."""
    turns = F.array(F.array(F.from_json("props", "k bigint")))
    x = table(spark, d, "events").select("event_id", F.array(F.create_map(F.lit("turns"), turns)).alias("chat"))
    return x.select("event_id", R.follow(x, "chat", "turns", "k").alias("k"))


@query("src_parquet", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders")
def src_parquet(spark, d):
    return files.read_parquet(spark, f"{d}/orders.parquet", f"{d}/orders.parquet").select("o_orderkey")


def _folder(spark, name: str) -> str:
    """A shared folder for the round trips of the file queries."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/spindrift-{spark.sparkContext.applicationId}-{name}"


@query("src_jsonl", "SELECT id, answer FROM predictions", "predictions")
def src_jsonl(spark, d):
    to = _folder(spark, "jsonl")
    V.predictions(spark, d).select("id", "answer", "pred").write.mode("overwrite").json(to)
    return files.read_jsonl(spark, to).select("id", "answer")


@query("src_jsonl_strict", "SELECT id, pred FROM predictions", "predictions")
def src_jsonl_strict(spark, d):
    src_jsonl(spark, d)
    return files.read_jsonl(spark, _folder(spark, "jsonl"), strict=True).select("id", "pred")


@query("src_json_array", "SELECT r_regionkey, r_name FROM region")
def src_json_array(spark, d):
    to = _folder(spark, "array")
    row = F.to_json(F.collect_list(F.struct("r_regionkey", "r_name")))
    table(spark, d, "region").agg(row).write.mode("overwrite").text(to)
    return files.read_json_array(spark, to, "r_regionkey bigint, r_name string").select(F.col("r_regionkey").cast(table(spark, d, "region").schema["r_regionkey"].dataType), "r_name")


@query("src_jsonl_chunks", "SELECT id, answer FROM predictions", "predictions")
def src_jsonl_chunks(spark, d):
    """Four chunks of a run beside one of an older run of two, which is not read."""
    to = _folder(spark, "chunks")
    p = V.predictions(spark, d).select("id", "answer")
    for i, path in enumerate(files.chunk_paths(to, 4)):
        p.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i).write.mode("overwrite").json(path)
    p.write.mode("overwrite").json(files.chunk_paths(to, 2)[0])
    return files.read_jsonl(spark, *files.chunk_paths(to, 4)).select("id", "answer")


@query("src_hub", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) * 3 // 4 FROM orders)")
def src_hub(spark, d):
    r = B.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return r.where(F.col("rn") < r.count() * 3 // 4).select("o_orderkey")


@query("src_corpus", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text AS contents FROM documents")
def src_corpus(spark, d):
    """Documents written in the order of their ids; positions are given by the reader."""
    to = _folder(spark, "corpus")
    table(spark, d, "documents").orderBy("doc_id").select(F.col("text").alias("contents")).write.mode("overwrite").json(to)
    return files.read_corpus(spark, to)


@query("src_console", "SELECT uid, round(score, 3) AS score FROM rollouts", "rollouts")
def src_console(spark, d):
    lines = V.rollouts(spark, d).select("uid", files.console_line("uid", ["score", "len"]).alias("line"))
    return lines.select("uid", files.parse_console(F.col("line"), "score").alias("score"))


@query("snk_console", "SELECT 'step:' || uid || ' - score:' || printf('%.3f', score) AS line FROM rollouts", "rollouts")
def snk_console(spark, d):
    return V.rollouts(spark, d).select(files.console_line("uid", ["score"]).alias("line"))


@query("snk_parquet", "SELECT o_orderkey, o_custkey FROM orders")
def snk_parquet(spark, d):
    to = _folder(spark, "parquet")
    table(spark, d, "orders").select("o_orderkey", "o_custkey").write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


@query("snk_jsonl_append", "SELECT id FROM predictions", "predictions")
def snk_jsonl_append(spark, d):
    to = _folder(spark, "append")
    p = V.predictions(spark, d).select("id", "answer")
    p.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).write.mode("overwrite").json(to)
    done = spark.read.schema("id string").json(to)
    files.append_jsonl(p, to, done)
    return spark.read.schema("id string").json(to)


@query("snk_val_table", "SELECT * FROM benchmark ORDER BY md5('42:' || item_id), item_id LIMIT 10")
def snk_val_table(spark, d):
    """A report of ten samples by definition, in a seeded order."""
    return table(spark, d, "benchmark").orderBy(R.seeded(42, "item_id"), "item_id").limit(10)


_LOG = "WITH l AS (SELECT uid, pos, CASE event_type WHEN 'view' THEN 'tool' WHEN 'click' THEN 'result' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'error' ELSE 'new' END AS kind FROM tokens), x AS (SELECT *, coalesce(sum(CASE WHEN kind = 'answer' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l)"


def turn_log(spark, d):
    kind = F.coalesce(F.create_map(*[F.lit(x) for x in ("view", "tool", "click", "result", "purchase", "answer", "error", "error")])[F.col("event_type")], F.lit("new"))
    return V.tokens(spark, d).select("uid", "pos", kind.alias("kind"))


@query("stf_rollout", _LOG + " SELECT uid, count(*) AS turns, sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END)::BIGINT AS valid, sum(CASE WHEN kind = 'tool' THEN 1 ELSE 0 END)::BIGINT AS calls, bool_or(kind = 'answer') AS answered FROM x WHERE done = 0 GROUP BY uid", "tokens")
def stf_rollout(spark, d):
    return turns.replay(turn_log(spark, d))


@query("stf_kl", "WITH s AS (SELECT l_linenumber AS step, avg(l_discount) AS kl, count(*) AS n FROM lineitem GROUP BY 1) SELECT step, round(0.1 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.05 - 1)) * n / 100000.0)) OVER (ORDER BY step)), 8) AS coefficient FROM s")
def stf_kl(spark, d):
    steps = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.avg("l_discount").alias("kl"), F.count(F.lit(1)).alias("n"))
    return turns.adaptive_kl(steps, 0.1, 0.05, 100_000.0).select("step", F.round("coefficient", 8).alias("coefficient"))


@query("arr_kl_ctrl", "WITH s AS (SELECT user_id AS step, avg(value) / 1000 AS kl, count(*) AS n FROM events GROUP BY 1) SELECT step, round(0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.05 - 1)) * n / 10000.0)) OVER (ORDER BY step)), 8) AS coefficient FROM s")
def arr_kl_ctrl(spark, d):
    steps = table(spark, d, "events").groupBy(F.col("user_id").alias("step")).agg((F.avg("value") / 1000).alias("kl"), F.count(F.lit(1)).alias("n"))
    return turns.adaptive_kl(steps, 0.2, 0.05, 10_000.0).select("step", F.round("coefficient", 8).alias("coefficient"))


@query("stf_resume", "SELECT id FROM predictions WHERE l_suppkey % 2 = 1", "predictions")
def stf_resume(spark, d):
    p = V.predictions(spark, d)
    return p.select("id").join(p.where("l_suppkey % 2 = 0").select("id"), "id", "left_anti")


def _neighbours(spark, d):
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")


@query("fn_wer")
def fn_wer(spark, d):
    """Word error rate of whole texts against the next text of the language and source."""
    return _neighbours(spark, d).select("doc_id", P.wer("a", "b").alias("wer"))


@query("fn_rouge")
def fn_rouge(spark, d):
    return _neighbours(spark, d).select("doc_id", P.rouge("a", "b").alias("rouge"))


@query("fn_num", "SELECT l_orderkey, l_linenumber, CASE WHEN round_even(l_quantity, 1) = round_even(l_quantity + l_discount * 7 + 0.003, 1) THEN 1.0 WHEN round_even(l_quantity, 0) = round_even(l_quantity + l_discount * 7 + 0.003, 0) THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM lineitem")
def fn_num(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.numeric("l_quantity", F.col("l_quantity") + F.col("l_discount") * 7 + 0.003).alias("score"))


@query("fn_format", "SELECT id, l_suppkey % 2 = 0 AS ok FROM spans", "spans")
def fn_format(spark, d):
    t = F.when(F.col("l_suppkey") % 2 == 0, "<think>a</think> <answer>b</answer>").otherwise("<answer>b</answer>")
    return V.spans(spark, d).select("id", P.format_ok(t).alias("ok"))


@query("agg_bootstrap")
def agg_bootstrap(spark, d):
    """best@k and worst@k of every prompt with more than one sample, k = 2, 4, ... and all: mean and deviation over 1000 seeded draws."""
    def run(batches):
        for rows in batches:
            parts = []
            for n, same in rows.groupby(rows["scores"].map(len)):
                x = np.stack(same["scores"].to_list()).astype(float)
                for k in P.subset_sizes(n):
                    parts.append(pd.DataFrame(P.bootstrap_extremes(x, k), columns=["best", "best_std", "worst", "worst_std"]).assign(uid=same["uid"].to_numpy(), k=k))
            if parts:
                yield pd.concat(parts)[["uid", "k", "best", "best_std", "worst", "worst_std"]]

    groups = V.rollouts(spark, d).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("sample", "score"))).getField("score").alias("scores"))
    return groups.where("size(scores) > 1").mapInPandas(run, "uid bigint, k bigint, best double, best_std double, worst double, worst_std double")


@query("udf_batch_score", "SELECT id, CASE WHEN said = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM choices", "choices")
def udf_batch_score(spark, d):
    from spindrift.operators.registries import batch_scorer

    score = batch_scorer(lambda texts, truths: [float(a == b) for a, b in zip(texts, truths, strict=True)])
    return V.choices(spark, d).select("id", score("said", "gold").alias("score"))


@query("udf_adv", "WITH s AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT uid, sample, round((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) + 0.0 AS grpo, round(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END, 6) + 0.0 AS rloo FROM s", "rollouts")
def udf_adv(spark, d):
    """Two of the registered advantages by their names."""
    from spindrift.operators.registries import ADVANTAGES

    x = ADVANTAGES.get("grpo")(V.rollouts(spark, d)).withColumnRenamed("advantage", "grpo")
    return ADVANTAGES.get("rloo")(x).select("uid", "sample", r6("grpo").alias("grpo"), r6("advantage").alias("rloo"))
