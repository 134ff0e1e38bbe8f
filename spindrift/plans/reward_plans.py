"""Rewards end to end: replies of every problem type and data source, scored by their own scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import maths as M
from spindrift.functions import rewards as R
from spindrift.functions import scores as P
from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.plans import views as V
from spindrift.plans.registry import VIEWS, query, r6, table
from spindrift.plans.text_plans import _PARSED, _iou, _letter_sql

_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id"
VIEWS["replies"] = f"""SELECT *, CASE l_partkey % 3 WHEN 0 THEN answer WHEN 1 THEN '<think>t</think><answer>' || answer || '</answer>' ELSE '<answer>' || answer || '</answer>' END AS said FROM (
  SELECT {_ID}, l_partkey, l_suppkey, l_linenumber, l_linenumber % 4 AS runs, l_linenumber % 5 AS lost,
    CASE l_suppkey % 5 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'numerical' WHEN 2 THEN 'regression' WHEN 3 THEN 'OCR' ELSE 'free_form' END AS kind,
    CASE l_suppkey % 5 WHEN 0 THEN 'The answer is ' || substr('ABCD', CAST((l_partkey + l_linenumber % 2) % 4 + 1 AS INTEGER), 1) WHEN 1 THEN CAST(l_quantity AS BIGINT) || '.' || l_linenumber || ' units' WHEN 2 THEN CAST(l_quantity AS BIGINT) || '.' || l_linenumber || ' units'
      ELSE array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i < 4 - l_linenumber % 5 THEN ['river', 'mill', 'stone', 'tower'][i + 1] ELSE 'x' || i END), ' ') END AS answer,
    CASE l_suppkey % 5 WHEN 0 THEN ' ' || substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) || ' ' WHEN 1 THEN CAST(l_quantity AS BIGINT) || '.' || (l_partkey % 10) WHEN 2 THEN CAST(l_quantity AS BIGINT) || '.' || (l_partkey % 10) ELSE 'river mill stone tower' END AS truth
  FROM lineitem)"""


def replies(spark, d):
    """What ``VIEWS["replies"]`` says in SQL."""
    k, s = F.col("l_suppkey") % 5, lambda c: c.cast("string")
    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))
    whole, words = s(F.col("l_quantity").cast("long")), F.array(*map(F.lit, ("river", "mill", "stone", "tower")))
    worn = F.array_join(F.transform(words, lambda w, i: F.when(i < 4 - F.col("l_linenumber") % 5, w).otherwise(F.concat(F.lit("x"), s(i)))), " ")
    number = F.concat(whole, F.lit("."), s(F.col("l_linenumber")), F.lit(" units"))
    answer = F.when(k == 0, F.concat(F.lit("The answer is "), letter(F.col("l_partkey") + F.col("l_linenumber") % 2))).when(k <= 2, number).otherwise(worn)
    truth = F.when(k == 0, F.concat(F.lit(" "), letter(F.col("l_partkey")), F.lit(" "))).when(k <= 2, F.concat(whole, F.lit("."), s(F.col("l_partkey") % 10))).otherwise("river mill stone tower")
    out = table(spark, d, "lineitem").select(
        V.row_id().alias("id"), "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("runs"), F.element_at(F.array(*map(F.lit, ("multiple_choice", "numerical", "regression", "OCR", "free_form"))), (k + 1).cast("int")).alias("kind"),
        answer.alias("answer"), truth.alias("truth"),
    )
    p = F.col("l_partkey") % 3
    tagged = F.concat(F.lit("<answer>"), "answer", F.lit("</answer>"))
    return out.withColumn("said", F.when(p == 0, F.col("answer")).when(p == 1, F.concat(F.lit("<think>t</think>"), tagged)).otherwise(tagged))


_FORMAT = "(CASE WHEN l_partkey % 3 = 1 THEN 1.0 ELSE 0.0 END + CASE WHEN l_linenumber % 4 >= 1 THEN least(l_linenumber % 4, 2) * 0.5 ELSE 0.0 END)"
_A, _B = (rf"TRY_CAST(nullif(regexp_extract({c}, '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE)" for c in ("answer", "truth"))
_LETTER = _letter_sql("answer", T.PHRASES_A)
#: Words lost at the end of four: word errors are their share, overlaps are known.
_KINDS = {
    "multiple_choice": f"CASE WHEN {_LETTER} = trim(truth) THEN 1.0 ELSE 0.0 END",
    "numerical": f"CASE WHEN round_even({_A}, 1) = round_even({_B}, 1) THEN 1.0 WHEN round_even({_A}, 0) = round_even({_B}, 0) THEN 0.5 ELSE 0.0 END",
    "regression": f"greatest(0, least(1, 1 - (abs({_A} - {_B}) + 1e-9) / (abs({_B}) + 1e-9)))",
    "OCR": "1 - lost / 4.0",
    "free_form": "((4 - lost) / 4.0 + greatest(0, 3 - lost) / 3.0 + (4 - lost) / 4.0) / 3",
}
_VIDEO = "CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in _KINDS.items()) + " END"


@query("fn_format_reward", f"SELECT id, {_FORMAT}::DOUBLE AS r FROM replies", "replies")
def fn_format_reward(spark, d):
    return replies(spark, d).select("id", R.format_reward(F.col("said"), F.col("runs")).alias("r"))


@query("fn_mcq", f"SELECT id, (CASE WHEN {_LETTER} = trim(truth) THEN 1 ELSE 0 END)::DOUBLE AS raw, (CASE WHEN {_LETTER} = {_letter_sql('truth', T.PHRASES_A)} THEN 1 ELSE 0 END)::DOUBLE AS both FROM replies", "replies")
def fn_mcq(spark, d):
    said, truth = F.col("said"), F.col("truth")
    return replies(spark, d).select("id", R.mcq(said, truth).alias("raw"), R.mcq(said, truth, of_truth=True).alias("both"))


@query("fn_score_video", f"SELECT id, round({_FORMAT} + {_VIDEO}, 6)::DOUBLE AS score FROM replies", "replies")
def fn_score_video(spark, d):
    x = R.format_reward(F.col("said"), F.col("runs")) + R.video(F.col("said"), F.col("truth"), F.col("kind"))
    return replies(spark, d).select("id", r6(x).alias("score"))


_TYPE = "CASE l_suppkey % 3 WHEN 0 THEN 'object_counting' WHEN 1 THEN 'open-ended' ELSE 'route' END"
_TASKS = f"WITH q AS (SELECT {_ID}, {_TYPE} AS type, CASE WHEN l_linenumber = 1 THEN ['first', {_TYPE}] ELSE [{_TYPE}] END AS types, CASE WHEN l_suppkey % 3 = 2 THEN 'Answer B' WHEN l_linenumber = 7 THEN 'none' ELSE 'it is ' || l_linenumber || '.5' END AS said, CASE WHEN l_suppkey % 3 = 2 THEN substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) ELSE CAST(l_partkey % 8 AS VARCHAR) END AS truth FROM lineitem)"
_LIMITS = "[" + ", ".join(f"{float(x)!r}e0" for x in 1 - np.linspace(0.5, 0.95, 10)) + "]"
_SAID, _TRUE = r"TRY_CAST(nullif(regexp_extract(said, '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE)", "TRY_CAST(truth AS DOUBLE)"
_VQA = f"CASE WHEN type <> 'route' THEN CASE WHEN {_SAID} IS NULL THEN 0.0 WHEN {_TRUE} <> 0 THEN len(list_filter({_LIMITS}, lambda x: abs({_SAID} - {_TRUE}) / {_TRUE} <= x)) / 10.0 END WHEN {_letter_sql('said', T.PHRASES_C)} = {_letter_sql('truth', T.PHRASES_C)} THEN 1.0 ELSE 0.0 END::DOUBLE"


def tasks(spark, d):
    """Questions of numeric types and one with letters; a first line has a list of two types."""
    s = F.col("l_suppkey") % 3
    kind = F.when(s == 0, "object_counting").when(s == 1, "open-ended").otherwise("route")
    said = F.when(s == 2, "Answer B").when(F.col("l_linenumber") == 7, "none").otherwise(F.concat(F.lit("it is "), F.col("l_linenumber").cast("string"), F.lit(".5")))
    truth = F.when(s == 2, F.substring(F.lit("ABCD"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))).otherwise((F.col("l_partkey") % 8).cast("string"))
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), kind.alias("type"), F.when(F.col("l_linenumber") == 1, F.array(F.lit("first"), kind)).otherwise(F.array(kind)).alias("types"), said.alias("said"), truth.alias("truth"))


@query("fn_mra", _TASKS + f" SELECT id, round(CASE WHEN {_TRUE} <> 0 THEN len(list_filter({_LIMITS}, lambda x: abs({_SAID} - {_TRUE}) / {_TRUE} <= x)) / 10.0 END, 6)::DOUBLE AS mra FROM q WHERE type <> 'route' AND {_SAID} IS NOT NULL")
def fn_mra(spark, d):
    said = T.number(F.col("said"))
    return tasks(spark, d).where((F.col("type") != "route") & said.isNotNull()).select("id", r6(R.relative_accuracy(said, F.col("truth").try_cast("double"))).alias("mra"))


@query("fn_vqa", _TASKS + f" SELECT id, {_VQA} AS score FROM q")
def fn_vqa(spark, d):
    return tasks(spark, d).select("id", R.vqa(F.col("said"), F.col("truth"), F.col("type")).alias("score"))


@query("agg_vqa", _TASKS + f", s AS (SELECT types, {_VQA} AS acc FROM q) SELECT kind, count(*) AS n, round(avg(acc) * 100, 6) AS acc FROM (SELECT unnest(list_append(types, 'all')) AS kind, acc FROM s) WHERE acc IS NOT NULL GROUP BY kind")
def agg_vqa(spark, d):
    """Rows that cannot be scored (a truth of zero) count nowhere; a list of types counts once for each."""
    s = tasks(spark, d).select("types", R.vqa(F.col("said"), F.col("truth"), F.col("type")).alias("acc")).where("acc is not null")
    s = s.select(F.explode(F.array_append("types", F.lit("all"))).alias("kind"), "acc")
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("acc") * 100).alias("acc"))


_WRAPPED = "WITH wrapped AS (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 1 THEN '<think>t</think><answer>' || p || '</answer>' ELSE p END AS pred), p AS inner_text FROM (SELECT *, replace(pred, '<answer>', '') AS p FROM predictions)), " + _PARSED.replace("FROM predictions", "FROM (SELECT * REPLACE (inner_text AS pred) FROM wrapped)")
_CUT = f"least(1, greatest(0, {_iou('gs', 'ge', 't1[1]', 't1[2]')}) / 0.5)"
_GOLD = "substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1)"
_BONUS = "CASE WHEN l_linenumber % 4 >= 1 THEN least(l_linenumber % 4, 2) * 0.5 ELSE 0.0 END"


def wrapped(spark, d):
    """Predictions, a third of them in well-formed blocks."""
    p = V.predictions(spark, d).withColumn("pred", F.replace("pred", F.lit("<answer>"), F.lit("")))
    return p.withColumns({"pred": F.when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("<think>t</think><answer>"), "pred", F.lit("</answer>"))).otherwise(F.col("pred")), "runs": F.col("l_linenumber") % 4})


@query("fn_score_gqa", f"{_WRAPPED} SELECT id, round(CASE WHEN l_partkey % 3 = 1 THEN 1.0 ELSE 0.0 END + {_BONUS} + {_CUT}, 6) + 0.0 AS score, round({_CUT} + CASE WHEN {_letter_sql('pred', T.PHRASES_A)} = {_GOLD} THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS custom_reward_func FROM parsed", "predictions")
def fn_score_gqa(spark, d):
    """Format and overlap make the score; the choice enters only the logged composite."""
    gold = F.substring(F.lit("ABCD"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    x = wrapped(spark, d).select("id", "pred", "runs", gold.alias("gold"), R.overlap_reward(F.col("pred"), F.col("gs"), F.col("ge"), cut=True).alias("iou"))
    return x.select("id", r6(R.format_reward(F.col("pred"), F.col("runs")) + F.col("iou")).alias("score"), r6(F.col("iou") + R.mcq(F.col("pred"), F.col("gold"))).alias("custom_reward_func"))


@query("fn_score_tg", f"{_WRAPPED} SELECT id, round(CASE WHEN l_linenumber % 3 <> 1 THEN greatest(0, {_iou('gs', 'ge', 't1[1]', 't1[2]')}) ELSE 0 END + CASE WHEN l_linenumber % 3 <> 0 THEN CASE WHEN l_partkey % 3 = 1 THEN 1.0 ELSE 0.0 END + {_BONUS} ELSE 0 END, 6) + 0.0 AS score FROM parsed", "predictions")
def fn_score_tg(spark, d):
    """The sum over a row's list of rewards; without a list the overlap alone."""
    k = F.col("l_linenumber") % 3
    wanted = F.coalesce(F.when(k == 1, F.array(F.lit("format"))).when(k == 2, F.array(F.lit("iou"), F.lit("format"))), F.array(F.lit("iou")))
    of = lambda name, x: F.when(F.array_contains(wanted, name), x).otherwise(0.0)
    return wrapped(spark, d).select("id", r6(of("iou", R.overlap_reward(F.col("pred"), F.col("gs"), F.col("ge"))) + of("format", R.format_reward(F.col("pred"), F.col("runs")))).alias("score"))


@query("agg_gqa", f"SELECT l_returnflag AS kind, count(*) AS n, {', '.join(f'round(avg(CASE WHEN greatest(0, x) >= 0.{t} THEN 1 ELSE 0 END) * 100, 6) AS recall_{t}' for t in (3, 5, 7))}, round(avg(greatest(0, x)) * 100, 6) AS miou, round(avg(ok) * 100, 6) AS acc FROM (SELECT l_returnflag, {_iou('gs', 'ge', 'ps', 'pe')} AS x, CASE WHEN l_partkey % 4 = l_suppkey % 4 THEN 1.0 ELSE 0.0 END AS ok FROM spans) GROUP BY 1", "spans")
def agg_gqa(spark, d):
    x = F.greatest(F.lit(0.0), S.overlap(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge"))[0])
    s = V.spans(spark, d).select(F.col("l_returnflag").alias("kind"), x.alias("x"), (F.col("l_partkey") % 4 == F.col("l_suppkey") % 4).cast("double").alias("ok"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(S.recall_at(F.col("x"), t / 10)) * 100).alias(f"recall_{t}") for t in (3, 5, 7)], r6(F.avg("x") * 100).alias("miou"), r6(F.avg("ok") * 100).alias("acc"))


_GSM = f"WITH x AS (SELECT {_ID}, CASE l_suppkey % 3 WHEN 0 THEN 'is 12. #### 1,' || CAST(l_quantity AS BIGINT) WHEN 1 THEN 'so ' || CAST(l_quantity AS BIGINT) || ' .' ELSE 'no number' END AS t, CASE WHEN l_partkey % 2 = 0 THEN '1' ELSE '' END || CAST(l_quantity AS BIGINT) AS truth FROM lineitem)"


@query("fn_gsm8k", _GSM + r" SELECT id, (CASE WHEN coalesce(replace(replace(nullif(regexp_extract(t, '#### (\-?[0-9\.\,]+)', 1), ''), ',', ''), '$', '') = truth, false) THEN 1 ELSE 0 END)::DOUBLE AS strict, (CASE WHEN coalesce(list_filter(regexp_extract_all(t, '(\-?[0-9\.\,]+)', 1), lambda v: v NOT IN ('', '.'))[-1] = truth, false) THEN 1 ELSE 0 END)::DOUBLE AS flexible FROM x")
def fn_gsm8k(spark, d):
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_suppkey") % 3
    t = F.when(k == 0, F.concat(F.lit("is 12. #### 1,"), q)).when(k == 1, F.concat(F.lit("so "), q, F.lit(" ."))).otherwise("no number")
    x = table(spark, d, "lineitem").select(V.row_id().alias("id"), t.alias("t"), F.concat(F.when(F.col("l_partkey") % 2 == 0, "1").otherwise(""), q).alias("truth"))
    return x.select("id", R.gsm8k(F.col("t"), F.col("truth")).alias("strict"), R.gsm8k(F.col("t"), F.col("truth"), flexible=True).alias("flexible"))


@query("fn_gpqa", f"SELECT {_ID}, (CASE WHEN l_linenumber > 1 AND l_suppkey % 4 = l_partkey % 4 THEN 1 ELSE 0 END)::DOUBLE AS score FROM lineitem")
def fn_gpqa(spark, d):
    letter = lambda c: F.substring(F.lit("ABCD"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("hence answer: $"), letter("l_suppkey"), F.lit("$ ok"))).otherwise("answer unknown")
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), R.gpqa(said, letter("l_partkey")).alias("score"))


@query("fn_r1_dispatch", f"SELECT {_ID}, (CASE l_suppkey % 2 WHEN 0 THEN CASE WHEN l_linenumber = l_partkey % 7 + 1 THEN 1 ELSE 0 END ELSE CASE WHEN l_linenumber % 4 = l_partkey % 7 % 4 THEN 1 ELSE 0 END END)::DOUBLE AS score FROM lineitem")
def fn_r1_dispatch(spark, d):
    """Maths sources by the boxed answer, the science source by its letter; another source is an error."""
    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))
    x = table(spark, d, "lineitem").withColumns({"even": F.col("l_suppkey") % 2 == 0, "m": F.col("l_partkey") % 7})
    source = F.when(F.col("even"), "AIME2024").otherwise("gpqa_diamond")
    said = F.when(F.col("even"), F.concat(F.lit("\\boxed{"), F.col("l_linenumber").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("Answer: "), letter(F.col("l_linenumber"))))
    truth = F.when(F.col("even"), (F.col("m") + 1).cast("string")).otherwise(letter(F.col("m")))
    maths = M.prime(F.when(F.col("even"), said), F.when(F.col("even"), truth))
    score = F.when(source.isin("AIME2024", "CNMO2024", "MATH-500"), maths).when(source == "gpqa_diamond", R.gpqa(said, truth)).otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))
    return x.select(V.row_id().alias("id"), score.alias("score"))


_SOURCES = ["openai/gsm8k", "lighteval/MATH", "aime2024", "numina_cn_k12", "hiyouga/geometry3k", "searchR1_nq", "video_r1/regression"]
_EQ = "CASE WHEN l_linenumber = l_partkey % 7 + 1 THEN 1.0 ELSE 0.0 END"


@query("fn_dispatch", f"SELECT {_ID}, round(CASE l_suppkey % 7 WHEN 2 THEN 2 * {_EQ} - 1 WHEN 4 THEN 0.9 * {_EQ} + 0.1 WHEN 6 THEN 1 + greatest(0, least(1, 1 - (abs(l_linenumber - l_partkey % 7 - 1) + 1e-9) / (l_partkey % 7 + 1 + 1e-9))) ELSE {_EQ} END, 6)::DOUBLE AS score FROM lineitem")
def fn_dispatch(spark, d):
    """Every row by the scorer of its source."""
    x = table(spark, d, "lineitem").withColumns({"k": F.col("l_suppkey") % 7, "n": F.col("l_linenumber").cast("string"), "m": (F.col("l_partkey") % 7 + 1).cast("string")})
    put = lambda a, b, c="n": F.concat(F.lit(a), c, F.lit(b))
    k = F.col("k")
    said = F.when(k == 0, put("so #### ", " it is")).when(k == 1, put("\\boxed{", "/2}")).when(k == 2, put("thus\nAnswer: ", "")).when(k == 3, put("\\boxed{", "}")).when(k == 4, put("<think>t</think> \\boxed{", "}")).when(k == 5, put("<answer>The ", ".</answer>")).otherwise(put("<think>t</think><answer>", "</answer>"))
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (k + 1).cast("int"))
    x = x.select(V.row_id().alias("id"), source.alias("source"), said.alias("said"), F.when(k == 1, put("\\frac{", "}{2}", "m")).otherwise(F.col("m")).alias("truth"))
    return x.select("id", r6(R.dispatch(F.col("source"), F.col("said"), F.col("truth"), F.lit(0))).alias("score"))


_EM = f"WITH x AS (SELECT {_ID}, l_linenumber AS n, l_partkey % 7 + 1 AS m, CASE l_suppkey % 4 WHEN 0 THEN 'The ' || l_linenumber || ' mills!' WHEN 1 THEN '<answer>no</answer> <answer> The ' || l_linenumber || '  Mills! </answer>' WHEN 2 THEN repeat('<answer>x</answer>', 10) || '<answer>a ' || l_linenumber || ' mills</answer>' ELSE '<answer>so the ' || l_linenumber || ' mills it is</answer>' END AS t, l_suppkey % 4 AS k FROM lineitem)"


@query("fn_em", _EM + " SELECT id, (CASE WHEN n = m AND k = 1 THEN 1.0 WHEN n = m AND k = 2 THEN 0.25 ELSE 0.0 END)::DOUBLE AS em FROM x")
def fn_em(spark, d):
    return _answers(spark, d).select("id", R.match(F.col("t"), F.col("golden")).alias("em"))


@query("fn_subem", _EM + " SELECT id, (CASE WHEN n = m AND k > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS sub FROM x")
def fn_subem(spark, d):
    return _answers(spark, d).select("id", R.match(F.col("t"), F.col("golden"), within=True).alias("sub"))


def _answers(spark, d):
    n, k = F.col("l_linenumber").cast("string"), F.col("l_suppkey") % 4
    t = F.when(k == 0, F.concat(F.lit("The "), n, F.lit(" mills!"))).when(k == 1, F.concat(F.lit("<answer>no</answer> <answer> The "), n, F.lit("  Mills! </answer>"))).when(k == 2, F.concat(F.lit("<answer>x</answer>" * 10 + "<answer>a "), n, F.lit(" mills</answer>"))).otherwise(F.concat(F.lit("<answer>so the "), n, F.lit(" mills it is</answer>")))
    golden = F.array(F.lit("none of these"), F.concat((F.col("l_partkey") % 7 + 1).cast("string"), F.lit(" mills")))
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), t.alias("t"), golden.alias("golden"))


def _formulas(spark, d):
    n, m = F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 7 + 1).cast("string")
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), n.alias("n"), m.alias("m"), (F.col("l_suppkey") % 3).alias("k"))


_MATHS = f"WITH x AS (SELECT {_ID}, l_linenumber AS n, l_partkey % 7 + 1 AS m, l_suppkey % 3 AS k FROM lineitem)"


@query("fn_boxed", _MATHS + r" SELECT id, CASE k WHEN 0 THEN '\sqrt{' || n || '}' WHEN 1 THEN '' || n ELSE NULL END AS got FROM x")
def fn_boxed(spark, d):
    x = _formulas(spark, d)
    t = F.when(F.col("k") == 0, F.concat(F.lit("x \\boxed{1} then \\boxed{\\sqrt{"), "n", F.lit("}} or \\fbox{2}"))).when(F.col("k") == 1, F.concat(F.lit("\\boxed "), "n", F.lit("$ and \\boxed{4}"))).otherwise("\\boxed{1")
    return x.select("id", P.boxed(t).alias("got"))


@query("fn_boxed_dapo", _MATHS + r" SELECT id, CASE k WHEN 0 THEN '\boxed{\sqrt{' || n || '}}' END AS got FROM x")
def fn_boxed_dapo(spark, d):
    t = F.when(F.col("k") == 0, F.concat(F.lit("\\boxed{\\sqrt{"), "n", F.lit("}} or \\fbox{2}"))).when(F.col("k") == 1, F.concat(F.lit("\\fbox{"), "n", F.lit("}"))).otherwise("\\boxed{1")
    return _formulas(spark, d).select("id", M.read_dapo(t).alias("got"))


@query("fn_boxed_prime", _MATHS + r" SELECT id, CASE k WHEN 0 THEN '\sqrt{' || n || '}' WHEN 1 THEN '' || n END AS got FROM x")
def fn_boxed_prime(spark, d):
    t = F.when(F.col("k") == 0, F.concat(F.lit("\\boxed{ \\sqrt{"), "n", F.lit("} } or \\fbox{2}"))).when(F.col("k") == 1, F.concat(F.lit("\\fbox{"), "n", F.lit("}"))).otherwise("\\boxed{1")
    return _formulas(spark, d).select("id", M.read_prime(t).alias("got"))


@query("fn_math_dapo", _MATHS + " SELECT id, CASE WHEN k < 2 AND n = m THEN 1.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN k = 2 AND n = m THEN 1.0 ELSE -1.0 END::DOUBLE AS strict FROM x")
def fn_math_dapo(spark, d):
    k = F.col("k")
    t = F.when(k == 0, F.concat(F.lit("Answer: 9\nso\nAnswer: $x="), "n", F.lit("$ dollars"))).when(k == 1, F.concat(F.lit("answer : \\text{"), "n", F.lit("} cm"))).otherwise(F.concat(F.lit("so \\boxed{"), "n", F.lit("}")))
    return _formulas(spark, d).select("id", M.dapo(t, F.col("m")).alias("score"), M.dapo_strict(t, F.col("m")).alias("strict"))


@query("agg_val")
def agg_val(spark, d):
    """Per source and variable: mean@N, std@N, best@n, worst@n, maj@n (n = 2, 4, ..., N) of each prompt, then means over prompts times 100."""
    return val_metrics(V.rollouts(spark, d).select((F.col("uid") % 3).alias("source"), F.col("uid").alias("prompt"), "sample", "score", F.col("acc").alias("vote")))


def val_metrics(df, as_shipped: bool = False, n: int = 1_000, seed: int = 42):
    """``df`` (source, prompt, sample, score, vote) to (source, metric, value, prompts). ``as_shipped``: every sample is a prompt of its own, as the reference's run-time suffix makes it."""
    key = ["source", "prompt", "sample"] if as_shipped else ["source", "prompt"]
    x = F.sort_array(F.collect_list(F.struct("sample", "score", "vote")))
    groups = df.groupBy(*key).agg(x.alias("x")).select("source", F.col("x.score").alias("scores"), F.col("x.vote").alias("votes"))

    def run(batches):
        for rows in batches:
            for size, same in rows.groupby(rows["scores"].map(len)):
                v, votes = np.stack(same["scores"].to_list()).astype(float), np.stack(same["votes"].to_list())
                out = {f"mean@{size}": v.mean(axis=1)}
                if size > 1:
                    out[f"std@{size}"] = v.std(axis=1)
                for k in P.subset_sizes(size):
                    names = [f"best@{k}/mean", f"best@{k}/std", f"worst@{k}/mean", f"worst@{k}/std", f"maj@{k}/mean", f"maj@{k}/std"]
                    out |= dict(zip(names, np.concatenate([P.bootstrap_extremes(v, k, n, seed), P.bootstrap_majority(v, votes, k, n, seed)], axis=1).T, strict=True))
                wide = pd.DataFrame(out).assign(source=same["source"].to_numpy())
                part = wide.groupby("source").agg(["sum", "count"]).stack(level=0, future_stack=True).reset_index()
                part.columns = ["source", "metric", "total", "n"]
                yield part

    kind = dict(df.dtypes)["source"]
    parts = groups.mapInPandas(run, f"source {kind}, metric string, total double, n bigint")
    return parts.groupBy("source", "metric").agg((F.sum("total") / F.sum("n") * 100).alias("value"), F.sum("n").alias("prompts"))
