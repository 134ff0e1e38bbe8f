"""Batch, timing and evaluation metrics, and records whose shape follows from their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table
from spindrift.plans.text_plans import _iou


def long(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of metrics to (name, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r6(F.col(f"`{n}`").cast("double")).alias("value")) for n in names])).alias("m")).select("m.*")


def _long_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return f"SELECT unnest([{', '.join(repr(n) for n, _ in pairs)}]) AS name, unnest([{', '.join(f'round(({x})::DOUBLE, 6) + 0.0' for _, x in pairs)}]) AS value FROM {source}"


#: Token and sequence columns of a batch: scores and rewards, advantages, returns and values where the mask is set, lengths, counters of turns.
_BATCH = "t AS (SELECT *, reward * 0.9 AS paid, reward - v AS adv, reward + v AS ret FROM tokens), s AS (SELECT uid, sum(reward) AS score, sum(paid) AS paid, sum(mask) AS n, uid % 10 + 1 AS p, count(*) AS turns, sum(mask) / count(*) AS active, count(*) FILTER (WHERE event_type <> 'error') AS actions, count(*) FILTER (WHERE event_type = 'view') AS calls, count(*) FILTER (WHERE event_type = 'click') AS runs FROM t GROUP BY uid)"
_OF_TOKENS = {"critic/advantages": "adv", "critic/returns": "ret", "critic/values": "v"}
_OF_TEXTS = {"critic/score": "score", "critic/rewards": "paid", "response_length": "n", "prompt_length": "p"}
_COUNTERS = {"active_mask": "active", "turns_stats": "turns", "valid_action_stats": "actions", "valid_tool_call_stats": "calls", "valid_tool_exec_stats": "runs"}
_ENDS = {"mean": "avg", "max": "max", "min": "min"}
#: Longest response and prompt of the batch.
LONGEST, LONGEST_PROMPT = 60, 10


def batch(spark, d):
    """(tokens, sequences) of the batch."""
    t = V.tokens(spark, d).withColumns({"paid": F.col("reward") * 0.9, "adv": F.col("reward") - F.col("v"), "ret": F.col("reward") + F.col("v")})
    kind = lambda c: F.sum(c.cast("int"))
    s = t.groupBy("uid").agg(
        F.sum("reward").alias("score"), F.sum("paid").alias("paid"), F.sum("mask").alias("n"), F.count(F.lit(1)).alias("turns"), (F.sum("mask") / F.count(F.lit(1))).alias("active"),
        kind(F.col("event_type") != "error").alias("actions"), kind(F.col("event_type") == "view").alias("calls"), kind(F.col("event_type") == "click").alias("runs"),
    )
    return t, s.withColumn("p", F.col("uid") % 10 + 1)


def _ends(fields: dict[str, str]) -> list[Column]:
    return [getattr(F, f)(c).alias(f"{n}/{e}") for n, c in fields.items() for e, f in _ENDS.items()]


def _ends_sql(fields: dict[str, str]) -> list[tuple[str, str]]:
    return [(f"{n}/{e}", f"{f}({c})") for n, c in fields.items() for e, f in _ENDS.items()]


_CLIPS = {"response_length/clip_ratio": f"avg(CASE WHEN n = {LONGEST} THEN 1e0 ELSE 0e0 END)", "prompt_length/clip_ratio": f"avg(CASE WHEN p = {LONGEST_PROMPT} THEN 1e0 ELSE 0e0 END)"}
_EXPLAINED = "1 - var_samp(ret - v) / (var_samp(ret) + 1e-5)"
_TEXT_SQL = [*_ends_sql(_OF_TEXTS), *_CLIPS.items(), *((f"multi_turn/{n}/mean", f"avg({c})") for n, c in _COUNTERS.items()), ("critic/rewards/custom_reward_func/mean", "avg(score)"), ("critic/rewards/iou_reward_func/mean", "avg(score) FILTER (WHERE uid % 2 = 0)"), ("critic/rewards/mcq_reward_func/mean", "avg(score) FILTER (WHERE uid % 2 = 1)")]
_TOKEN_SQL = [*_ends_sql(_OF_TOKENS), ("critic/vf_explained_var", _EXPLAINED)]


@query("agg_data", f"WITH {_BATCH} {_long_sql('(SELECT * FROM t WHERE mask = 1)', _TOKEN_SQL)} UNION ALL {_long_sql('s', _TEXT_SQL)}", "tokens")
def agg_data(spark, d):
    """All statistics of a batch, one row each: one aggregate over tokens and one over sequences."""
    t, s = batch(spark, d)
    tokens = t.where("mask = 1").agg(*_ends(_OF_TOKENS), F.expr(_EXPLAINED).alias("critic/vf_explained_var"))
    texts = s.agg(
        *_ends(_OF_TEXTS), *[F.expr(x).alias(n) for n, x in _CLIPS.items()], *[F.avg(c).alias(f"multi_turn/{n}/mean") for n, c in _COUNTERS.items()],
        F.avg("score").alias("critic/rewards/custom_reward_func/mean"), *[F.avg(F.when(F.col("uid") % 2 == k, F.col("score"))).alias(f"critic/rewards/{n}_reward_func/mean") for k, n in ((0, "iou"), (1, "mcq"))],
    )
    return long(tokens, [n for n, _ in _TOKEN_SQL]).unionByName(long(texts, [n for n, _ in _TEXT_SQL]))


_LENGTHS = {k: v for k, v in _OF_TEXTS.items() if "length" in k}


@query("agg_prime_data", f"WITH {_BATCH} {_long_sql('(SELECT * FROM t WHERE mask = 1)', _TOKEN_SQL)} UNION ALL {_long_sql('s', [*_ends_sql(_LENGTHS), *_CLIPS.items()])}", "tokens")
def agg_prime_data(spark, d):
    """Advantages, returns, values and lengths, without scores."""
    t, s = batch(spark, d)
    tokens = t.where("mask = 1").agg(*_ends(_OF_TOKENS), F.expr(_EXPLAINED).alias("critic/vf_explained_var"))
    return long(tokens, [n for n, _ in _TOKEN_SQL]).unionByName(long(s.agg(*_ends(_LENGTHS), *[F.expr(x).alias(n) for n, x in _CLIPS.items()]), [*(f"{n}/{e}" for n in _LENGTHS for e in _ENDS), *_CLIPS]))


_DPO = [*_ends_sql(_OF_TEXTS), *_CLIPS.items(), *((f"multi_turn/{n}/mean", f"avg({c})") for n, c in _COUNTERS.items())]


@query("agg_dpo_data", f"WITH {_BATCH} {_long_sql('s', _DPO)}", "tokens")
def agg_dpo_data(spark, d):
    """Scores, rewards and lengths, and the means of the optional columns that the batch has."""
    s = batch(spark, d)[1]
    optional = [F.avg(c).alias(f"multi_turn/{n}/mean") for n, c in _COUNTERS.items() if c in s.columns]
    return long(s.agg(*_ends(_OF_TEXTS), *[F.expr(x).alias(n) for n, x in _CLIPS.items()], *optional), [n for n, _ in _DPO])


#: Stages whose time is taken by token, and which tokens count.
BY_RESPONSE, BY_ALL = ["gen"], ["ref", "values", "adv", "update_critic", "update_actor"]
_STAGES = "CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'purchase' THEN 'update_actor' ELSE 'testing' END"


@query("agg_timing", f"WITH {_BATCH}, n AS (SELECT sum(n) AS said, sum(n + p) AS every FROM s), g AS (SELECT {_STAGES} AS stage, sum(value) AS seconds FROM events GROUP BY 1) SELECT 'timing_s/' || stage AS name, round(seconds, 6) AS value FROM g UNION ALL SELECT 'timing_per_token_ms/' || stage, round(seconds * 1000 / CASE stage WHEN 'gen' THEN said ELSE every END, 6) FROM g, n WHERE stage IN ('gen', 'ref', 'update_actor')", "tokens")
def agg_timing(spark, d):
    """Seconds of every stage; milliseconds a token of those with a token base."""
    kind = F.col("event_type")
    stage = F.when(kind == "view", "gen").when(kind == "click", "ref").when(kind == "purchase", "update_actor").otherwise("testing")
    g = table(spark, d, "events").groupBy(stage.alias("stage")).agg(F.sum("value").alias("seconds"))
    n = batch(spark, d)[1].agg(F.sum("n").alias("said"), F.sum(F.col("n") + F.col("p")).alias("every"))
    base = F.when(F.col("stage").isin(*BY_RESPONSE), F.col("said")).when(F.col("stage").isin(*BY_ALL), F.col("every"))
    both = F.array(F.struct(F.concat(F.lit("timing_s/"), "stage").alias("name"), r6("seconds").alias("value")), F.struct(F.concat(F.lit("timing_per_token_ms/"), "stage").alias("name"), r6(F.col("seconds") * 1000 / base).alias("value")))
    return g.crossJoin(F.broadcast(n)).select(F.explode(both).alias("m")).select("m.*").where("value is not null")  # one row of totals


@query("agg_throughput", f"WITH {_BATCH}, x AS (SELECT (SELECT sum(n + p) FROM s) AS tokens, (SELECT sum(value) FROM events) AS seconds, 8 AS gpus) SELECT tokens::BIGINT AS total_num_tokens, round(seconds, 6) AS time_per_step, round(tokens / (seconds * gpus), 6) AS throughput FROM x", "tokens")
def agg_throughput(spark, d):
    """Tokens of the batch, the step's time, and tokens a second of each of eight devices."""
    n = batch(spark, d)[1].agg(F.sum(F.col("n") + F.col("p")).cast("long").alias("total_num_tokens"))
    time = table(spark, d, "events").agg(F.sum("value").alias("s"))
    return n.crossJoin(time).select("total_num_tokens", r6("s").alias("time_per_step"), r6(F.col("total_num_tokens") / (F.col("s") * 8)).alias("throughput"))  # a row each


@query("agg_meter", "WITH m AS (SELECT l_returnflag AS name, round(l_quantity / 50, 1) AS score, CASE l_suppkey % 3 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'no' ELSE 'perhaps' END AS pred FROM lineitem) SELECT name, 'average' AS part, NULL::DOUBLE AS score, round(avg(score) * 100, 6) AS value FROM m GROUP BY name UNION ALL SELECT name, 'yes', NULL, round(count(*) FILTER (WHERE lower(pred) LIKE '%yes%') * 100.0 / count(*), 6) FROM m GROUP BY name UNION ALL SELECT name, 'no', NULL, round(count(*) FILTER (WHERE lower(pred) NOT LIKE '%yes%' AND lower(pred) LIKE '%no%') * 100.0 / count(*), 6) FROM m GROUP BY name UNION ALL SELECT name, 'histogram of ' || CASE WHEN lower(pred) LIKE '%yes%' THEN 'yes' ELSE 'no' END, score, count(*)::DOUBLE FROM m WHERE lower(pred) LIKE '%yes%' OR lower(pred) LIKE '%no%' GROUP BY ALL")
def agg_meter(spark, d):
    """Average, shares of yes and no answers, and the histogram of scores of each."""
    k = F.col("l_suppkey") % 3
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.round(F.col("l_quantity") / 50, 1).alias("score"), F.when(k == 0, "Yes, it is").when(k == 1, "no").otherwise("perhaps").alias("pred"))
    return meter(m)


def meter(m: DataFrame) -> DataFrame:
    """``m`` (name, score, pred) to (name, part, score, value)."""
    low = F.lower("pred")
    m = m.withColumn("said", F.when(low.contains("yes"), "yes").when(low.contains("no"), "no"))
    share = lambda k: r6(F.count(F.when(F.col("said") == k, 1)) * 100 / F.count(F.lit(1))).alias(k)
    g = m.groupBy("name").agg(r6(F.avg("score") * 100).alias("average"), share("yes"), share("no"))
    flat = g.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.lit(None).cast("double").alias("score"), F.col(c).alias("value")) for c in ("average", "yes", "no")])).alias("x")).select("name", "x.*")
    return flat.unionByName(m.where("said is not null").groupBy("name", F.concat(F.lit("histogram of "), "said").alias("part"), "score").agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("agg_tg_zoom", f"WITH z AS (SELECT unnest(range(0, l_linenumber % 4)) AS k, gs, ge, ps, pe FROM spans), x AS (SELECT k, {_iou('gs', 'ge', '(ps + k)', '(pe + k)')} AS x FROM z) SELECT k, round(sum(x) * 100 / (SELECT count(*) FROM spans), 6) + 0.0 AS whole, round(avg(x) * 100, 6) + 0.0 AS part, count(*) AS n FROM x GROUP BY k", "spans")
def agg_tg_zoom(spark, d):
    """Overlap by tool round: over all samples, a missing round counting 0, and over those that have the round."""
    s = V.spans(spark, d).withColumn("rounds", (F.col("l_linenumber") % 4).cast("int"))
    z = s.where("rounds > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    x = z.select(F.col("k").cast("long").alias("k"), S.overlap(F.col("ps") + F.col("k"), F.col("pe") + F.col("k"), F.col("gs"), F.col("ge"))[0].alias("x"))
    g = x.groupBy("k").agg(F.sum("x").alias("t"), F.avg("x").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("every")))).select("k", r6(F.col("t") * 100 / F.col("every")).alias("whole"), r6(F.col("a") * 100).alias("part"), "n")  # one row


_KEYS = "'{\"active_mask\": ' || l_quantity || CASE WHEN l_linenumber % 2 = 0 THEN ', \"calls_' || l_returnflag || '\": ' || l_linenumber ELSE '' END || '}'"


@query("agg_meta", f"WITH m AS (SELECT {_KEYS} AS meta FROM lineitem), k AS (SELECT unnest(json_keys(meta)) AS key, meta FROM m) SELECT key, count(*) AS n, round(avg(CAST(json_extract(meta, '$.' || key) AS DOUBLE)) * 100, 6) AS value FROM k GROUP BY key")
def agg_meta(spark, d):
    """A meter for each key that any row's meta information has."""
    more = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(', "calls_'), "l_returnflag", F.lit('": '), F.col("l_linenumber").cast("string"))).otherwise("")
    meta = F.concat(F.lit('{"active_mask": '), F.col("l_quantity").cast("string"), more, F.lit("}"))
    return table(spark, d, "lineitem").select(F.explode(F.from_json(meta, "map<string,double>"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value") * 100).alias("value"))


@query("agg_val_section", "WITH u AS (SELECT uid % 3 AS source, uid, count(*) AS n FROM rollouts GROUP BY uid), k AS (SELECT DISTINCT source, unnest([n, 2]) AS n FROM u WHERE n > 1), m AS (SELECT source, n, unnest(['mean@', 'std@', 'best@', 'worst@', 'maj@']) AS name FROM k), v AS (SELECT *, unnest(CASE WHEN source = 0 THEN ['acc', 'reward'] ELSE ['reward', 'score'] END) AS variable FROM m) SELECT source, variable, name || n AS metric, CASE WHEN variable = CASE WHEN source = 0 THEN 'acc' ELSE 'reward' END AND name IN ('mean@', 'maj@', 'best@') AND starts_with(n::VARCHAR, (max(n) OVER (PARTITION BY source, variable))::VARCHAR) THEN 'val-core' ELSE 'val-aux' END AS section FROM v", "rollouts")
def agg_val_section(spark, d):
    n = V.rollouts(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    k = n.select((F.col("uid") % 3).alias("source"), F.explode(F.array(F.col("n"), F.lit(2).cast("long"))).alias("n")).distinct()
    v = F.when(F.col("source") == 0, F.array(F.lit("acc"), F.lit("reward"))).otherwise(F.array(F.lit("reward"), F.lit("score")))
    m = k.select("source", F.explode(v).alias("variable"), "n").select("source", "variable", F.explode(F.transform(F.array(*map(F.lit, ("mean@", "std@", "best@", "worst@", "maj@"))), lambda x: F.concat(x, F.col("n").cast("string")))).alias("metric"))
    return sections(m)


def sections(m: DataFrame) -> DataFrame:
    """``m`` (source, variable, metric) with its section: core for the mean, majority and best of the most samples of accuracy, or of the reward where a source has no accuracy."""
    w = Window.partitionBy("source")
    core = F.when(F.max((F.col("variable") == "acc").cast("int")).over(w) == 1, "acc").otherwise("reward")
    size = F.regexp_extract("metric", r"@(\d+)[^@]*$", 1).cast("long")
    most = F.max(size).over(Window.partitionBy("source", "variable"))
    wanted = (F.col("variable") == core) & F.col("metric").rlike("^(mean|maj|best)") & F.contains("metric", F.concat(F.lit("@"), most.cast("string")))
    return m.withColumn("section", F.when(wanted, "val-core").otherwise("val-aux"))


@query("shp_hellaswag", r"WITH x AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(lang, '') || ' [title] [step] B  C' AS b, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) SELECT doc_id, replace(regexp_replace(replace(regexp_replace('Act: ' || a || ' ' || upper(left(b, 1)) || lower(substr(b, 2)), '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS query, label AS ground_truth FROM x")
def shp_hellaswag(spark, d):
    """First half, and second half with a capital; only rows with a label."""
    x = table(spark, d, "documents").join(table(spark, d, "labels").where("quality is not null"), "doc_id")
    b = F.concat(F.coalesce("lang", F.lit("")), F.lit(" [title] [step] B  C"))
    t = T.strip(F.concat(F.lit("Act: "), F.coalesce("text", F.lit("")), F.lit(" "), T.capitalize(b)))
    t = F.replace(F.regexp_replace(F.replace(t, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))
    return x.select("doc_id", t.alias("query"), F.col("quality").alias("ground_truth"))


@query("shp_search", "WITH x AS (SELECT item_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'nq' ELSE 'hotpotqa' END AS source, CASE WHEN item_id % 3 = 0 THEN ['model ' || item_id] ELSE ['a' || item_id, 'b'] END AS truth, 'searchR1_' || CASE WHEN item_id % 2 = 0 THEN 'nq' ELSE 'hotpotqa' END AS tag FROM benchmark) SELECT item_id, tag AS data_source, 'Search. ' || question AS user_content, array_to_string(truth, '|') AS ground_truth, array_to_string(truth, '|') || '#' || question || '#' || tag AS create_kwargs FROM x")
def shp_search(spark, d):
    """Ground truth from the reward model, else the golden answers; the search tool's arguments carry truth, question and source."""
    own = F.when(F.col("item_id") % 3 == 0, F.struct(F.array(F.concat(F.lit("model "), F.col("item_id").cast("string"))).alias("ground_truth")))
    x = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "nq").otherwise("hotpotqa").alias("source"), own.alias("reward_model"), F.array(F.concat(F.lit("a"), F.col("item_id").cast("string")), F.lit("b")).alias("golden_answers"))
    truth, tag = F.coalesce("reward_model.ground_truth", "golden_answers"), F.concat(F.lit("searchR1_"), "source")
    kwargs = F.struct(truth.alias("ground_truth"), F.col("question"), tag.alias("data_source"))
    x = x.select("item_id", tag.alias("data_source"), F.array(F.struct(F.lit("system").alias("role"), F.lit("Use search.").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("Search. "), "question").alias("content"))).alias("prompt"), truth.alias("truth"), F.struct(F.struct(kwargs.alias("create_kwargs")).alias("search")).alias("tools_kwargs"))
    k = F.col("tools_kwargs.search.create_kwargs")
    return x.select("item_id", "data_source", F.col("prompt")[1]["content"].alias("user_content"), F.array_join("truth", "|").alias("ground_truth"), F.concat_ws("#", F.array_join(k["ground_truth"], "|"), k["question"], k["data_source"]).alias("create_kwargs"))


@query("shp_passages", "WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS xs FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(xs, lambda x, i: 'Doc ' || i || ' (Title: ' || string_split(x, chr(10))[1] || ')' || chr(10) || substr(x, strpos(x || chr(10), chr(10)) + 1)), chr(10)) AS t FROM t")
def shp_passages(spark, d):
    """Numbered passages, the first line of each its title."""
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(x, "\n", 1), F.lit(")\n"), F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x)))
    xs = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(xs.alias("xs")).select("conv_id", F.array_join(F.transform("xs", one), "\n").alias("t"))
