"""Reward managers by name; datasets, samplers and tools as classes of source files; tables that grow, frames, whole batches."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from spindrift import plugins
from spindrift.operators import managers, registries
from spindrift.operators import plugins as U
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table
from spindrift.plans.reward_plans import replies
from spindrift.plans.shape_plans import _folder
from spindrift.sources import files

PLUGINS = Path(plugins.__file__).parent
PADDED = 12


def token_rows(spark, d):
    """Replies as tokens (words with the blank after them), padded to twelve; every third of them is a tool's."""
    words, n = F.slice(F.split("said", "(?<= )"), 1, PADDED), F.size("words")
    mask = lambda f: F.transform(F.sequence(F.lit(0), F.lit(PADDED - 1)), lambda i: F.when(f(i), 1).otherwise(0))
    x = replies(spark, d).select("id", F.substring_index("id", "-", 1).cast("long").alias("uid"), F.lit("own").alias("data_source"), "truth", words.alias("words"))
    return x.select("id", "uid", "data_source", "truth", F.concat("words", F.array_repeat(F.lit(""), F.lit(PADDED) - n)).alias("tokens"), mask(lambda i: i < n).alias("attention"), mask(lambda i: (i < n) & (i % 3 != 1)).alias("loss"))


def length_score(source, text, truth):
    """A made-up scorer: a tenth of the length, and whether the truth is in the text."""
    return F.struct((F.length(text) / 10).alias("score"), F.contains(text, truth).cast("int").alias("hit"))


def group_scores(sources, texts, truths):
    """A scorer of whole groups: each text's length as a share of the longest one's."""
    most = max(max(map(len, texts)), 1)
    return [{"score": len(t) / most, "size": len(texts)} for t in texts]


_TOKENS = """WITH w AS (SELECT id, CAST(split_part(id, '-', 1) AS BIGINT) AS uid, truth, string_split(said, ' ') AS p FROM replies),
  t AS (SELECT id, uid, truth, list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || ' ' ELSE x END)[1:12] AS ws FROM w),
  k AS (SELECT *, len(ws) AS n, array_to_string(ws, '') AS whole, list_filter(ws, lambda x, i: (i - 1) % 3 <> 1) AS own FROM t), o AS (SELECT *, array_to_string(own, '') AS mine FROM k)"""


@query("udf_reward_mgr", f"""{_TOKENS},
  s AS (SELECT 'naive' AS manager, id, length(whole) / 10.0 AS r, n - 1 AS place, contains(whole, truth)::INTEGER::DOUBLE AS hit, NULL::DOUBLE AS other FROM o
    UNION ALL SELECT 'naive_multiturn', id, length(mine) / 10.0, n - 2, contains(mine, truth)::INTEGER, NULL FROM o
    UNION ALL SELECT 'dapo', id, length(CASE WHEN suffix(whole, '</answer>') THEN whole[:-10] ELSE whole END) / 10.0 + least(-(n - 3) / 4.0 * 0.5, 0), n - 1, contains(CASE WHEN suffix(whole, '</answer>') THEN whole[:-10] ELSE whole END, truth)::INTEGER, least(-(n - 3) / 4.0 * 0.5, 0) FROM o
    UNION ALL SELECT 'prime', id, length(whole) / 10.0, n - 1, NULL, length(whole) / 10.0 FROM o
    UNION ALL SELECT 'prime_multiturn', id, length(mine) / 10.0, len(own) - 1, contains(mine, truth)::INTEGER, NULL FROM o
    UNION ALL SELECT 'batch', id, length(whole) / greatest(max(length(whole)) OVER (PARTITION BY uid), 1), n - 1, NULL, count(*) OVER (PARTITION BY uid) FROM o)
  SELECT manager, id, round(r, 6) AS reward, place::INTEGER AS place, hit::DOUBLE AS hit, round(other, 6)::DOUBLE + 0.0 AS other FROM s""", "replies")
def udf_reward_mgr(spark, d):
    """Each of the six managers over the same replies."""
    rows, out = token_rows(spark, d), None
    options = {"dapo": {"end": "</answer>", "longest": 7, "buffer": 4, "factor": 0.5, "log": True}, "batch": {"by": "uid"}}
    scorers = {"batch": group_scores, "prime": lambda *x: length_score(*x)["score"]}
    other = {"dapo": F.col("extras")["overlong_reward"], "batch": F.col("extras")["size"], "prime": F.col("acc")}
    for name in sorted(registries.REWARD_MANAGERS.known):
        done = managers.manage(name, rows, scorers.get(name, length_score), **options.get(name, {}))
        part = done.select(F.lit(name).alias("manager"), "id", r6("reward").alias("reward"), F.col("place").cast("int").alias("place"), F.col("extras")["hit"].alias("hit"), (F.round(other.get(name, F.lit(None).cast("double")), 6) + 0.0).alias("other"))
        out = part if out is None else out.union(part)
    return out


@query("udf_dataset", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def udf_dataset(spark, d):
    """Orders through a data source class of a source file."""
    return U.read_dataset(spark, str(PLUGINS / "row_groups.py"), "RowGroups", path=f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("udf_sampler", "WITH e AS (SELECT 0 AS epoch, o_orderkey, row_number() OVER (ORDER BY -o_totalprice, o_orderkey) - 1 AS rn FROM orders UNION ALL SELECT 1, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 FROM orders) SELECT epoch, rn, o_orderkey FROM e WHERE epoch = 0 OR rn < (SELECT count(*) // 2 FROM orders)")
def udf_sampler(spark, d):
    """An epoch and a half by a sampler of a source file that is stopped and resumed after every half epoch."""
    orders, to, out = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _folder(spark, "sampler"), None
    half = orders.count() // 2
    for i, n in enumerate((half, half + 1, half)):
        sampler = U.make_sampler(orders, "o_orderkey", path=str(PLUGINS / "dear_first.py"), name="DearFirst")
        if i:
            sampler.restore(U.load_state(spark, to))
        part = sampler.take(n).select("epoch", "rn", "o_orderkey")
        U.save_state(spark, sampler.state(), to)
        out = part if out is None else out.union(part)
    return out


@query("udf_tool", """WITH c AS (SELECT l_orderkey AS instance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_suppkey % 5 AS k, 1 - least(1, abs(l_quantity - 25.0) / 25.0) AS worth FROM lineitem),
  g AS (SELECT *, CASE WHEN k < 3 THEN worth > coalesce(lag(worth) OVER (PARTITION BY instance, k < 3 ORDER BY pos), 0) END AS better FROM c)
  SELECT instance, pos, CASE WHEN k < 3 THEN 'worth ' || printf('%.3f', worth) WHEN k = 3 THEN 'Tool nope not found in tools list' ELSE 'answer' END AS reply, CASE WHEN k < 3 AND NOT better THEN -0.05 ELSE 0.0 END::DOUBLE AS reward FROM g""")
def udf_tool(spark, d):
    """Logged calls of a tool that a YAML file names, of one that it does not, and without an answer."""
    from pyspark.sql import Window

    k = F.col("l_suppkey") % 5
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    given = F.when(k < 4, F.format_string('{"answer": %s}', F.col("l_quantity").cast("string"))).otherwise("{}")
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance"), F.row_number().over(w).cast("long").alias("pos"), F.lit("25").alias("truth"), F.when(k == 3, "nope").otherwise("grade").alias("tool"), given.alias("parameters"))
    return U.run_tools(calls, U.load_tools(str(PLUGINS / "tools.yaml")))


def _samples(spark, d, step):
    """A step's samples: answers of the orders whose key ends in the step, as many as the step allows."""
    x = V.predictions(spark, d).where((F.col("l_orderkey") % 64 == step) & (F.col("l_linenumber") <= step))
    return x.groupBy("l_linenumber").agg(F.max("answer").alias("input"), F.max("pred").alias("output"), F.max("gs").alias("score")).withColumnRenamed("l_linenumber", "nth")


@query("snk_gen_table", "WITH s AS (SELECT step, l_linenumber AS nth, max(answer) AS i, max(pred) AS o, max(gs) AS s FROM predictions, (SELECT unnest([1, 2, 3]) AS step) WHERE l_orderkey % 64 = step AND l_linenumber <= CASE step WHEN 2 THEN 1 ELSE step END GROUP BY step, l_linenumber) SELECT step::INTEGER AS step, " + ", ".join(f"max(CASE WHEN nth = {k} THEN {c[0]} END) AS {c}_{k}" for k in (1, 2, 3) for c in ("input", "output", "score")) + " FROM s GROUP BY step", "predictions")
def snk_gen_table(spark, d):
    """Three steps with one, two and three samples; the second is logged again with one sample and replaced."""
    import uuid

    to = f"{_folder(spark, 'generations')}-{uuid.uuid4().hex}"
    for step in (1, 2, 3):
        files.log_generations(_samples(spark, d, step), step, to)
    files.log_generations(_samples(spark, d, 2).where("nth = 1"), 2, to)
    return files.generations_table(spark, to)


@query("snk_rollouts", "SELECT l_linenumber AS step, id, answer AS input, pred AS output, gs AS score, CASE WHEN l_linenumber % 2 = 0 THEN ge END AS extra FROM predictions", "predictions")
def snk_rollouts(spark, d):
    """An extra that some samples of a step lack is left out of that step."""
    to = _folder(spark, "rollouts")
    p = V.predictions(spark, d).select(F.col("l_linenumber").alias("step"), F.concat_ws("|", "id", "answer").alias("input"), F.col("pred").alias("output"), F.col("gs").alias("score"), "ge", "id")
    lacking = (F.col("step") % 2 == 1) & (F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    files.dump_rollouts(p, to, {"extra": F.when(~lacking, F.col("ge"))})
    back = spark.read.schema("step bigint, input string, output string, score double, extra double").json(to)
    return back.select(F.col("step").cast(p.schema["step"].dataType).alias("step"), F.substring_index("input", "|", 1).alias("id"), F.substring_index("input", "|", -1).alias("input"), "output", "score", "extra")


@query("src_frames", "SELECT 'video' || (l_orderkey % 8) AS video, count(DISTINCT l_linenumber * 3) AS n, list(DISTINCT l_linenumber * 3 ORDER BY l_linenumber * 3)::BIGINT[] AS frames FROM lineitem GROUP BY 1")
def src_frames(spark, d):
    """Frame files written by their numbers (3 to 21, so not in the order of their names) and listed in number order."""
    to = _folder(spark, "frames")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("video"), (F.col("l_orderkey") % 8).cast("string")).alias("video"), (F.col("l_linenumber") * 3).alias("n")).distinct()
    made = rows.repartition("video", "n").select("video", "n", F.lit("x").alias("value"))
    made.write.mode("overwrite").partitionBy("video", "n").text(to)
    listed = files.read_frames(spark, to)
    # partition folders spell the names: .../video=video3/n=9/part-....txt
    named = listed.select(F.concat(F.regexp_extract("path", "video=([^/]+)/", 1), F.lit("/f_"), F.regexp_extract("path", "/n=([0-9]+)/", 1), F.lit(".txt")).alias("path"))
    frames = named.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), F.regexp_extract("path", r"_(\d+)\.[^./]*$", 1).try_cast("long").alias("frame"))
    lists = files.frame_lists(frames)
    return lists.select("video", F.size("paths").cast("long").alias("n"), F.transform("paths", lambda p: F.regexp_extract(p, r"_(\d+)\.", 1).cast("long")).alias("frames"))


@query("snk_pickle", "SELECT n_nationkey, n_name, 0.7::DOUBLE AS temperature, 2 AS epoch FROM nation")
def snk_pickle(spark, d):
    """A batch with its metadata, to disk and back."""
    to = _folder(spark, "batch")
    files.save_batch(table(spark, d, "nation").select("n_nationkey", "n_name"), {"temperature": 0.7, "epoch": 2}, to)
    rows, meta = files.load_batch(spark, to)
    return rows.select("n_nationkey", "n_name", F.lit(meta["temperature"]).alias("temperature"), F.lit(meta["epoch"]).alias("epoch"))
