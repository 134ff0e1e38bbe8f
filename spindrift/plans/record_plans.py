"""Records, result files, token masks by turn, losses, pooling and plug-ins: each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.functions import flops
from spindrift.functions import maths as M
from spindrift.functions import scores as P
from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.operators import packing
from spindrift.operators import records as R
from spindrift.operators.registries import Curriculum, custom_scorer, timed_scorer
from spindrift.plans import views as V
from spindrift.plans.array_plans import _IDS, exploded, ids
from spindrift.plans.registry import query, r6, table
from spindrift.plans.shape_plans import _folder
from spindrift.sources import files


@query("shp_add_tool", "SELECT item_id, item_id % 7 AS index, true AS need_tools_kwargs, reverse(text) AS ground_truth FROM benchmark")
def shp_add_tool(spark, d):
    extra = R.with_tool(F.struct((F.col("item_id") % 7).alias("index")), F.reverse("text"), "code_interpreter")
    x = table(spark, d, "benchmark").select("item_id", extra.alias("x"))
    return x.select("item_id", "x.index", "x.need_tools_kwargs", F.col("x.tools_kwargs.code_interpreter.create_kwargs.ground_truth").alias("ground_truth"))


@query("shp_multiturn", "WITH m AS (SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id) SELECT conv_id, messages, CASE WHEN row_number() OVER (ORDER BY conv_id) - 1 < (SELECT count(*) FROM m) * 2 // 3 THEN 'train' ELSE 'test' END AS split FROM m")
def shp_multiturn(spark, d):
    """Messages of whole conversations as JSON, the first two thirds for training."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))
    rows = B.numbered(table(spark, d, "conversations").select("conv_id").distinct(), "conv_id")
    split = rows.select("conv_id", F.when(F.col("rn") < rows.count() * 2 // 3, "train").otherwise("test").alias("split"))
    return whole.join(split, "conv_id")


@query("shp_sysprompt", "WITH x AS (SELECT item_id, list_transform(range(0, item_id % 3), lambda i: '{\"name\": \"t' || i || '\"}') AS s FROM benchmark) SELECT item_id, 'You are a helpful assistant.' || CASE WHEN len(s) > 0 THEN chr(10) || '" + (R.TOOL_BLOCK[0] + "' || array_to_string(s, chr(10)) || '" + R.TOOL_BLOCK[1]).replace("\n", "' || chr(10) || '") + "' ELSE '' END AS prompt FROM x")
def shp_sysprompt(spark, d):
    n = (F.col("item_id") % 3).cast("int")
    schemas = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), n), lambda i: F.format_string('{"name": "t%d"}', i))
    return table(spark, d, "benchmark").select("item_id", R.system_prompt("You are a helpful assistant.", schemas).alias("prompt"))


_ASKED = "'Add the numbers of order ' || o_orderkey || '.'"
_FORM = lambda form: "'" + form.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("shp_r1_lcb", f"""WITH c AS (SELECT l_orderkey, list({{'input': l_partkey || ' ' || l_suppkey, 'output': CAST(l_partkey + l_suppkey AS VARCHAR)}} ORDER BY l_linenumber > 2, l_linenumber, l_partkey, l_suppkey) AS cases FROM lineitem GROUP BY 1)
  SELECT o_orderkey, replace({_FORM(R.CONTEST)}, '{{question}}', {_ASKED}) || CASE WHEN o_orderkey % 2 = 0 THEN replace({_FORM(R.STARTER)}, '{{starter}}', 'def solve(a, b):') ELSE {_FORM(R.STDIN)} END AS prompt, 'livecodebench/code_generation_lite' AS data_source, 'Code' AS ability,
    to_json({{'inputs': coalesce(list_transform(cases, lambda c: c.input), []), 'outputs': coalesce(list_transform(cases, lambda c: c.output), []), 'fn_name': CASE WHEN o_orderkey % 2 = 0 THEN 'solve' END}}) AS tests
  FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1996-08-00T00:00:00' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1999-01-00T00:00:00'""")
def shp_r1_lcb(spark, d):
    """Prompts with and without starter code; public cases (lines 1 and 2) and private ones as JSON lists, joined; contests between two dates."""
    case = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.concat_ws(" ", "l_partkey", "l_suppkey").alias("input"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string").alias("output")).alias("case"))
    listed = lambda keep: F.to_json(F.transform(F.sort_array(F.collect_list(F.when(keep, case))), lambda x: x["case"]))
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(listed(F.col("l_linenumber") <= 2).alias("public"), listed(F.col("l_linenumber") > 2).alias("private"))
    held = table(spark, d, "orders").where((F.col("o_orderdate") >= "1996-08-01") & (F.col("o_orderdate") < "1999-01-01"))
    even = F.col("o_orderkey") % 2 == 0
    metadata = F.when(even, '{"func_name": "solve"}').otherwise("{}")
    asked = F.concat(F.lit("Add the numbers of order "), F.col("o_orderkey").cast("string"), F.lit("."))
    tests = R.test_cases(F.col("public"), F.col("private"), metadata)
    record = R.rl_record("livecodebench/code_generation_lite", R.contest_prompt(asked, F.when(even, "def solve(a, b):")), "Code", "rule", tests, F.lit("test"), F.col("o_orderkey"))
    x = held.join(cases, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", *record)
    return x.select("o_orderkey", F.col("prompt")[0]["content"].alias("prompt"), "data_source", "ability", F.col("reward_model.ground_truth").alias("tests"))


@query("shp_char_reward", r"WITH x AS (SELECT id, l_partkey % 4 AS truth, 'so \boxed{' || l_linenumber || '}, no: \boxed{' || (l_suppkey % 4) || CASE WHEN gs > 40 THEN '' ELSE '}' END AS said FROM spans) SELECT id, CASE WHEN regexp_extract(said, '.*\\boxed\{([0-9]+)\}$', 1) = CAST(truth AS VARCHAR) THEN 1 ELSE 0 END AS reward FROM x", "spans")
def shp_char_reward(spark, d):
    """1 where the last boxed text is the truth; a box that does not close is none."""
    said = F.concat(F.lit("so \\boxed{"), F.col("l_linenumber").cast("string"), F.lit("}, no: \\boxed{"), (F.col("l_suppkey") % 4).cast("string"), F.when(F.col("gs") > 40, "").otherwise("}"))
    x = V.spans(spark, d).select("id", (F.col("l_partkey") % 4).cast("string").alias("truth"), P.boxed(said).alias("got"))
    return x.select("id", F.coalesce((F.col("got") == F.col("truth")).cast("int"), F.lit(0)).alias("reward"))


_INTER = "greatest(0, least(pe, ge) - greatest(ps, gs))"
_SPANS = {"iou": "greatest(pe - ps, 0) + 1e-4 + greatest(ge - gs, 0) + 1e-4 - {i} + 1e-4", "precision": "pe - ps + 1e-4", "recall": "ge - gs + 1e-4"}


@query("snk_result_json", "SELECT id, " + ", ".join(f"round(CASE WHEN gs > ge THEN -2 WHEN pe = -1 OR ps > pe THEN -1 ELSE {_INTER} / ({x.replace('{i}', _INTER)}) END, 6) + 0.0 AS {n}" for n, x in _SPANS.items()) + ", CASE WHEN l_suppkey % 2 = 0 THEN 'sample' ELSE 'metric' END AS source, answer, pred, 6 AS keys FROM predictions", "predictions")
def snk_result_json(spark, d):
    """All metrics of a sample and its own fields, written as JSON and read again; a sample's field wins over the metric of that name."""
    p = V.predictions(spark, d)
    values = S.overlap(*[F.col(c) for c in ("ps", "pe", "gs", "ge")])
    metrics = F.create_map(*[x for n, v in zip(_SPANS, values, strict=True) for x in (F.lit(n), v.cast("string"))], F.lit("source"), F.lit("metric"))
    sample = F.create_map(F.lit("answer"), F.col("answer"), F.lit("pred"), F.col("pred"))
    sample = F.when(F.col("l_suppkey") % 2 == 0, F.map_concat(sample, F.create_map(F.lit("source"), F.lit("sample")))).otherwise(sample)
    to = _folder(spark, "results")
    files.write_results(p.select("id", R.merged(metrics, sample).alias("fields")), to)
    fields = F.col("fields")
    return files.read_results(spark, to).select("id", *[r6(fields[n].cast("double")).alias(n) for n in _SPANS], *[fields[n].alias(n) for n in ("source", "answer", "pred")], F.size(fields).alias("keys"))


@query("snk_metric_json", "SELECT l_linenumber AS step, round(avg(l_quantity), 6) AS q, max(l_discount) AS top FROM lineitem GROUP BY 1")
def snk_metric_json(spark, d):
    """One flat object a step, in a folder a step, read again."""
    to = _folder(spark, "metrics")
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(r6(F.avg("l_quantity")).alias("q"), F.max("l_discount").alias("top"))
    files.write_rollouts(m, to)
    return spark.read.schema("q double, top double, step int").json(to).select("step", "q", "top")


@query("snk_tracking", "WITH m AS (SELECT l_linenumber AS step, avg(l_quantity) AS q, max(l_discount) AS top FROM lineitem GROUP BY 1) SELECT step, 'q' AS metric, round(q, 6) AS value FROM m UNION ALL SELECT step, 'top', top FROM m")
def snk_tracking(spark, d):
    """Sent to the table back-end twice, as a batch run again is, and read back."""
    to = _folder(spark, "tracking")
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(r6(F.avg("l_quantity")).alias("q"), F.max("l_discount").alias("top"))
    log = files.tracker("step", ["q", "top"], to, ("table",))
    log(m)
    log(m)
    return spark.read.parquet(to).select("step", "metric", "value")


@query("snk_ckpt_marker", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def snk_ckpt_marker(spark, d):
    """Three iterations written, the second one marked last; the marker names what is read."""
    to = _folder(spark, "iterations")
    for i in (1, 3, 2):
        table(spark, d, "nation").where(F.col("n_regionkey") == i).select("n_nationkey", "n_name").write.mode("overwrite").parquet(f"{to}/global_step_{i}")
        files.mark_iteration(spark, to, i)
    return spark.read.parquet(files.latest_checkpoint(spark, to))


@query("snk_vidi", "SELECT l_orderkey AS query_id, l_returnflag AS query, [[ps, pe]] AS answer FROM spans", "spans")
def snk_vidi(spark, d):
    to = _folder(spark, "vidi")
    V.spans(spark, d).select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("query"), F.array(F.array("ps", "pe")).alias("answer")).write.mode("overwrite").json(to)
    return spark.read.schema("query_id bigint, query string, answer array<array<double>>").json(to)


@query("src_shm", "SELECT n_nationkey, n_name FROM nation")
def src_shm(spark, d):
    return files.cached(table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("arr_pad_to", _IDS + " SELECT uid, CASE WHEN len(ids) < 24 THEN list_concat(list_transform(range(0, 24 - len(ids)), lambda x: 0), ids) ELSE ids END AS ids FROM s")
def arr_pad_to(spark, d):
    return ids(spark, d).select("uid", A.pad(F.col("ids"), 24, F.lit(0).cast("long"), left=True).alias("ids"))


@query("arr_reward_place", """WITH s AS (SELECT uid, pos, max(CASE WHEN mask = 1 THEN pos END) OVER w AS last, count(*) OVER w AS n, sum(mask) OVER w AS learnt FROM tokens WINDOW w AS (PARTITION BY uid))
  SELECT uid, pos, CASE WHEN pos = last THEN 1.5 ELSE 0.0 END::DOUBLE AS attended, CASE WHEN pos = CASE WHEN learnt = 0 THEN n ELSE learnt END THEN 1.5 ELSE 0.0 END::DOUBLE AS learnt,
  CASE WHEN pos = CASE WHEN last = 1 THEN n ELSE last - 1 END THEN 1.5 ELSE 0.0 END::DOUBLE AS before FROM s WHERE last IS NOT NULL""", "tokens")
def arr_reward_place(spark, d):
    """The score at the last attended token, at the count of learnt tokens, or one before the last; below 0 from the end."""
    s = V.sequences(spark, d).where(F.array_contains("mask", 1))
    last = F.size("mask") - F.array_position(F.reverse("mask"), 1).cast("int")
    learnt = A.total(F.col("mask").cast("array<double>")).cast("int") - 1
    places = {"attended": last, "learnt": learnt, "before": last - 1}
    return exploded(s.withColumns({n: A.reward_at(F.size("mask"), p, F.lit(1.5)) for n, p in places.items()}), *places)


@query("arr_policy_loss", """WITH t AS (SELECT uid, mask, reward - 1 AS a, greatest(-20, least(20, new_lp - old_lp)) AS k FROM tokens),
  l AS (SELECT *, -a * exp(k) AS p, -a * greatest(0.8, least(1.28, exp(k))) AS c, -a * 1.1 AS f FROM t),
  x AS (SELECT uid, mask, k, CASE WHEN a < 0 THEN least(f, greatest(p, c)) ELSE greatest(p, c) END AS v, CASE WHEN c > p THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN a < 0 AND greatest(p, c) > f THEN 1.0 ELSE 0.0 END AS low FROM l),
  s AS (SELECT uid, sum(v * mask) AS v, sum(mask) AS n, count(*) AS width, sum(hit * mask) AS hit, sum(low * mask) AS low, sum(-k * mask) AS kl FROM x GROUP BY uid)
  SELECT round(sum(v) / (sum(n) + 1e-8), 6) + 0.0 AS token_mean, round(avg(v), 6) + 0.0 AS seq_sum, round(avg(v / nullif(n, 0)), 6) + 0.0 AS seq_mean, round(sum(v) / max(width), 6) + 0.0 AS seq_norm,
  round(sum(hit) / (sum(n) + 1e-8), 6) + 0.0 AS clip_fraction, round(sum(low) / (sum(n) + 1e-8), 6) + 0.0 AS clip_fraction_low, round(sum(kl) / (sum(n) + 1e-8), 6) + 0.0 AS kl FROM s""", "tokens")
def arr_policy_loss(spark, d):
    """Clipped loss with the second clip of negative advantages, in four aggregations, with its fractions and KL."""
    terms = A.policy_terms(F.col("old_lp"), F.col("new_lp"), F.col("reward") - 1, 0.2, 0.28, 1.1)
    of = lambda x: F.sum(x * F.col("mask"))
    s = V.tokens(spark, d).groupBy("uid").agg(F.sum("mask").alias("n"), F.count(F.lit(1)).alias("width"), *[of(x).alias(k) for k, x in terms.items()])
    mean = lambda c: r6(F.sum(c) / (F.sum("n") + A.EPS))
    return s.agg(
        mean("loss").alias("token_mean"), r6(F.avg("loss")).alias("seq_sum"), r6(F.avg(F.try_divide("loss", "n"))).alias("seq_mean"), r6(F.sum("loss") / F.max("width")).alias("seq_norm"),
        mean("clipped").alias("clip_fraction"), mean("clipped_low").alias("clip_fraction_low"), mean("kl").alias("kl"),
    )


@query("arr_turn_mask", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) + 1 ELSE 0 END)::BIGINT AS learnt, sum(len(string_split(text, ' ')) + 4)::BIGINT AS tokens, (sum(CASE WHEN role = 'assistant' THEN (len(string_split(text, ' ')) + 1) * turn ELSE 0 END))::BIGINT AS by_turn FROM conversations GROUP BY conv_id")
def arr_turn_mask(spark, d):
    """Messages rendered as three tokens of head, words and an end token; an assistant's head is not learnt."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", (F.size(F.split("text", " ")) + 4).alias("n")))).alias("turns"))
    turn = F.flatten(F.transform("turns", lambda x: F.array_repeat(x["turn"], x["n"])))
    m = t.select("conv_id", A.turn_mask(F.col("turns"), 3).alias("mask"), turn.alias("turn"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("conv_id", total(F.col("mask")).alias("learnt"), F.size("mask").cast("long").alias("tokens"), total(F.zip_with("mask", "turn", lambda a, b: a * b)).alias("by_turn"))


@query("arr_tool_mask", """WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM tokens),
  n AS (SELECT uid, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n FROM tokens GROUP BY uid),
  raw AS (SELECT uid, unnest(range(0, n::BIGINT)) AS j FROM n), role AS (SELECT uid, j, CASE WHEN (uid + j) % 4 IN (1, 2) THEN 'tool' ELSE 'assistant' END AS role FROM raw),
  kept AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY uid ORDER BY j), '') AS before FROM role), turns AS (SELECT uid, role, row_number() OVER (PARTITION BY uid ORDER BY j) - 1 AS turn FROM kept WHERE role <> 'tool' OR before <> 'tool')
  SELECT e.uid, e.pos, CASE WHEN turns.role = 'tool' THEN 0 ELSE e.mask END AS m FROM e LEFT JOIN turns ON turns.uid = e.uid AND turns.turn = e.turn""", "tokens")
def arr_tool_mask(spark, d):
    """Purchases end turns; two of four messages are a tool's and, in a row, one turn."""
    s = V.tokens(spark, d).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "mask", (F.col("event_type") == "purchase").cast("int").alias("id")))).alias("x")).select("uid", "x.id", "x.mask")
    n = F.size(F.filter("id", lambda x: x == 1))
    roles = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.when(((F.col("uid") + j) % 4).isin(1, 2), "tool").otherwise("assistant"))
    masked = s.select("uid", "id", "mask", roles.alias("roles")).withColumn("m", A.tool_mask(F.col("id"), 1, F.col("roles"), F.col("mask")))
    return exploded(masked, "m")


#: Shapes of three public models.
_MODELS = {
    "qwen2": {"model_type": "qwen2", "hidden_size": 3584, "vocab_size": 152064, "num_hidden_layers": 28, "num_attention_heads": 28, "num_key_value_heads": 4, "intermediate_size": 18944},
    "qwen3_moe": {"model_type": "qwen3_moe", "hidden_size": 2048, "vocab_size": 151936, "num_hidden_layers": 48, "num_attention_heads": 32, "num_key_value_heads": 4, "head_dim": 128, "moe_intermediate_size": 768, "num_experts_per_tok": 8, "num_experts": 128},
    "deepseek_v3": {"model_type": "deepseek_v3", "hidden_size": 7168, "vocab_size": 129280, "num_hidden_layers": 61, "num_attention_heads": 128, "intermediate_size": 18432, "moe_intermediate_size": 2048, "first_k_dense_replace": 3, "n_routed_experts": 256, "num_experts_per_tok": 8, "n_shared_experts": 1, "q_lora_rank": 1536, "kv_lora_rank": 512, "qk_nope_head_dim": 128, "qk_rope_head_dim": 64, "v_head_dim": 128},
    "other": {"model_type": "other"},
}


@query("agg_flops", """WITH s AS (SELECT sum(len)::DOUBLE AS t, sum(len * len)::DOUBLE AS q FROM rollouts), f AS (
  SELECT 'qwen2' AS model, 6.0 * ((3.0 * 3584 * 18944 + 3584.0 * (28 * 128 + 4 * 128 + 4 * 128 + 28 * 128)) * 28 + 152064.0 * 3584 * 2) * t + 12.0 * q * 128 * 28 * 28 AS f FROM s
  UNION ALL SELECT 'qwen3_moe', 6.0 * ((2048.0 * 8 * 768 * 3 + 2048.0 * 128 + 2048.0 * (32 * 128 + 4 * 128 + 4 * 128 + 32 * 128)) * 48 + 151936.0 * 2048 * 2) * t + 12.0 * q * 128 * 32 * 48 FROM s
  UNION ALL SELECT 'deepseek_v3', 6.0 * ((7168.0 * 256 + 7168.0 * 2048 * 9 * 3 + a) * 58 + (7168.0 * 18432 * 3 + a) * 3 + 129280.0 * 7168 * 2) * t + 12.0 * q * 61 * 192 * 128 FROM s, (SELECT 7168.0 * 1536 + 128.0 * 192 * 1536 + 7168.0 * (512 + 64) + 128.0 * (192 - 64 + 128) * 512 + 128.0 * 128 * 7168 AS a)
  UNION ALL SELECT 'other', 0.0 FROM s) SELECT model, round(f / 10 / 1e12, 3) + 0.0 AS tflops, round(f / 10 / 989e12, 6) + 0.0 AS mfu FROM f""", "rollouts")
def agg_flops(spark, d):
    """Achieved trillions of operations a second of a step of ten seconds, and the share of an H100's peak."""
    n = F.col("len").cast("double")
    s = V.rollouts(spark, d).agg(F.sum(n).alias("t"), F.sum(n * n).alias("q"))
    per = {name: flops.costs(c) for name, c in _MODELS.items()}
    each = F.array(*[F.struct(F.lit(name).alias("model"), (F.lit(float(a)) * F.col("t") + F.lit(float(b)) * F.col("q")).alias("f")) for name, (a, b) in per.items()])
    rows = s.select(F.inline(each))
    return rows.select("model", (F.round(F.col("f") / 10 / 1e12, 3) + 0.0).alias("tflops"), r6(F.col("f") / 10 / flops.peak("H100")).alias("mfu"))


@query("agg_seqlen_balance")
def agg_seqlen_balance(spark, d):
    """Spread of token sums over four workers in each batch of 40 groups, before and after balancing."""
    return packing.imbalance(V.rollouts(spark, d).select(F.floor(F.col("uid") / 40).alias("batch"), (F.col("uid") * 100 + F.col("sample")).alias("item"), "len"))


@query("fn_time_range_lmms", r"""WITH p AS (SELECT id, replace(replace(lower(CASE WHEN regexp_matches(pred, '<answer>(.*?)</answer>') THEN trim(regexp_extract(pred, '<answer>(.*?)</answer>', 1)) ELSE pred END), 'a specific example is : 20.8 - 30.0 seconds', ''), 'to', '-') AS t FROM predictions),
  s AS (SELECT id, t, list_filter(list_transform(list_filter(string_split_regex(t, '[!?\n]'), lambda s: regexp_matches(s, 'start|end|happen')), lambda s: regexp_extract(s, '\b(\d+\.\d+\b|\b\d+)\b', 1)), lambda n: n <> '') AS n FROM p),
  d AS (SELECT id, CASE WHEN regexp_matches(t, '(\d+\.*\d*)\s*-\s*(\d+\.*\d*)') THEN [regexp_extract(t, '(\d+\.*\d*)\s*-\s*(\d+\.*\d*)', 1)::DOUBLE, regexp_extract(t, '(\d+\.*\d*)\s*-\s*(\d+\.*\d*)', 2)::DOUBLE] WHEN len(n) >= 2 THEN [n[1]::DOUBLE, n[2]::DOUBLE] ELSE [-1.0, -1.0]::DOUBLE[] END AS x FROM s)
  SELECT id, least(x[1], x[2]) AS s, greatest(x[1], x[2]) AS e FROM d""", "predictions")
def fn_time_range_lmms(spark, d):
    return V.predictions(spark, d).select("id", T.time_range_spoken(F.col("pred")).alias("x")).select("id", "x.s", "x.e")


@query("fn_math_verify", "SELECT id, CASE WHEN l_linenumber = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM spans", "spans")
def fn_math_verify(spark, d):
    """With this package's own comparison in the verifier's place."""
    own = M.verified(lambda truths, texts: M.same_answer(P.last_boxed(texts[0]), P.last_boxed(truths[0])))
    said = F.concat(F.lit("so \\boxed{\\frac{"), F.col("l_linenumber").cast("string"), F.lit("}{2}}"))
    return V.spans(spark, d).select("id", own(said, F.lit("\\frac{3}{2}")).alias("score"))


@query("udf_custom_score", "SELECT id, CASE WHEN said LIKE '%' || gold || '%' THEN 2.5 ELSE 0.0 END::DOUBLE AS score FROM choices", "choices")
def udf_custom_score(spark, d):
    """A scorer from a source file that the driver writes first."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # read here and shipped as text, so no executor needs it
        path = Path(folder) / "own.py"
        path.write_text("def score(text, truth, scale):\n    return scale * (truth in text)\n")
        score = custom_scorer(str(path), "score", scale=2.5)
    return V.choices(spark, d).select("id", score("said", "gold").alias("score"))


@query("udf_parallel_score", "SELECT id, CASE WHEN kind = 'A' THEN 0.0 WHEN said LIKE '%' || gold || '%' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM choices", "choices")
def udf_parallel_score(spark, d):
    """Rows of kind A fail in the scorer and score 0."""

    def score(text: str, truth: str) -> float:
        return float(truth in text) if truth else 1 / 0

    return V.choices(spark, d).select("id", timed_scorer(score)("said", F.when(F.col("kind") != "A", F.col("gold"))).alias("score"))


@query("smp_curriculum", "WITH m AS (SELECT len AS level, row_number() OVER (ORDER BY abs(sum(score) / count(*) - 1), len) AS place FROM rollouts WHERE uid % 2 = 0 GROUP BY len) SELECT uid, sample, row_number() OVER (ORDER BY coalesce(place, 0), uid, sample) - 1 AS rn FROM rollouts LEFT JOIN m ON level = len", "rollouts")
def smp_curriculum(spark, d):
    """After a step on the even groups: rows of levels with a mean score near 1 first."""
    r = V.rollouts(spark, d)
    order = Curriculum("len", "score", 1.0)
    order.update(r.where("uid % 2 = 0"))
    return B.numbered(r.select("uid", "sample", order.rank().alias("place")), "place", "uid", "sample").select("uid", "sample", "rn")


@query("prt_dispatch", "WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn, count(*) OVER () AS n FROM nation), p AS (SELECT n_nationkey, rn, n FROM r UNION ALL SELECT n_nationkey, rn + n, n FROM r WHERE rn < 4 * ((n + 3) // 4) - n) SELECT 'all' AS mode, n_nationkey, unnest([0, 1, 2, 3])::BIGINT AS rank FROM r UNION ALL SELECT 'zero', n_nationkey, 0 FROM r UNION ALL SELECT 'split_padded', n_nationkey, rn // ((n + 3) // 4) FROM p")
def prt_dispatch(spark, d):
    r = B.numbered(table(spark, d, "nation").select("n_nationkey"), "n_nationkey")
    return B.concat(*[B.dispatch(r, mode, 4).select(F.lit(mode).alias("mode"), "n_nationkey", "rank") for mode in ("all", "zero", "split_padded")])
