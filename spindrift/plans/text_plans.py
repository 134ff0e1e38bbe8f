"""Answer parsing and scoring over the predictions, choices and spans views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table
from spindrift.plans.shape_plans import _folder
from spindrift.sources import files

_NUM = r"regexp_extract_all({0}, '\b(\d+\.\d+\b|\b\d+)\b', 1)"
#: Pairs of numbers of each sentence, the last ordered one wins; then all numbers paired from the end.
_PARSED = r"""
parts AS (SELECT *, list_transform(regexp_split_to_array(pred, '[!?\n]'), lambda p: list_transform(regexp_extract_all(p, '\b(\d+\.\d+\b|\b\d+)\b', 1), lambda x: CAST(x AS DOUBLE))) AS ns FROM predictions),
paired AS (SELECT *, flatten(list_transform(ns, lambda n: list_transform(range(0, len(n) // 2), lambda i: [n[2 * i + 1], n[2 * i + 2]]))) AS pr, flatten(ns) AS every FROM parts),
one AS (SELECT *, list_filter(pr, lambda x: x[1] <= x[2]) AS good, list_filter(list_transform(range(0, len(every) // 2), lambda i: [every[len(every) % 2 + 2 * i + 1], every[len(every) % 2 + 2 * i + 2]]), lambda x: x[1] <= x[2]) AS tail FROM paired),
parsed AS (SELECT *, CASE WHEN len(good) > 0 THEN good[-1] ELSE [-1.0, -1.0] END AS t1, CASE WHEN len(good) > 0 THEN good[-1] WHEN len(tail) > 0 THEN tail[-1] ELSE [-1.0, -1.0] END AS t2 FROM one)"""
_IOU = """CASE WHEN {gs} > {ge} THEN -2.0 WHEN {pe} = -1 OR {ps} > {pe} THEN -1.0 ELSE {top} END"""


def _iou(gs: str, ge: str, ps: str, pe: str, what: str = "iou") -> str:
    inter = f"greatest(0, least({pe}, {ge}) - greatest({ps}, {gs}))"
    lp, lg = f"({pe} - {ps} + 1e-4)", f"({ge} - {gs} + 1e-4)"
    under = {"iou": f"({lp} + {lg} - {inter} + 1e-4)", "precision": lp, "recall": lg}[what]
    return _IOU.format(gs=gs, ge=ge, ps=ps, pe=pe, top=f"{inter} / {under}")


@query("fn_time_range", f"WITH {_PARSED} SELECT id, t1[1] AS s, t1[2] AS e FROM parsed", "predictions")
def fn_time_range(spark, d):
    return V.predictions(spark, d).select("id", T.time_range(F.col("pred")).alias("t")).select("id", "t.s", "t.e")


@query("fn_time_range2", f"WITH {_PARSED} SELECT id, t2[1] AS s, t2[2] AS e FROM parsed", "predictions")
def fn_time_range2(spark, d):
    return V.predictions(spark, d).select("id", T.time_range2(F.col("pred")).alias("t")).select("id", "t.s", "t.e")


@query("fn_time_range_old", r"SELECT id, TRY_CAST(nullif(regexp_extract(pred, 'From (\d+) to (\d+)', 1), '') AS BIGINT) AS s, TRY_CAST(nullif(regexp_extract(pred, 'From (\d+) to (\d+)', 2), '') AS BIGINT) AS e FROM predictions", "predictions")
def fn_time_range_old(spark, d):
    get = lambda k: F.regexp_extract("pred", r"From (\d+) to (\d+)", k).try_cast("long")
    return V.predictions(spark, d).select("id", get(1).alias("s"), get(2).alias("e"))


def _spans(spark, d):
    return V.spans(spark, d).withColumns(dict(zip(("iou", "precision", "recall"), S.overlap(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")), strict=True)))


@query("fn_iou", f"SELECT id, round({_iou('gs', 'ge', 'ps', 'pe')}, 6) + 0.0 AS iou, round({_iou('gs', 'ge', 'ps', 'pe', 'precision')}, 6) + 0.0 AS precision, round({_iou('gs', 'ge', 'ps', 'pe', 'recall')}, 6) + 0.0 AS recall FROM spans", "spans")
def fn_iou(spark, d):
    return _spans(spark, d).select("id", r6("iou").alias("iou"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("fn_iou_reward", f"SELECT id, round(greatest(0, {_iou('gs', 'ge', 'ps', 'pe')}), 6) + 0.0 AS reward FROM spans", "spans")
def fn_iou_reward(spark, d):
    return _spans(spark, d).select("id", r6(F.greatest(F.lit(0.0), F.col("iou"))).alias("reward"))


@query("fn_cut_linear", f"SELECT id, round(greatest(0, least(1, ({_iou('gs', 'ge', 'ps', 'pe')} - 0.2) / (0.8 - 0.2))), 6) + 0.0 AS cut FROM spans", "spans")
def fn_cut_linear(spark, d):
    return _spans(spark, d).select("id", r6(S.cut_linear(F.col("iou"))).alias("cut"))


@query("fn_iou_cut_reward", f"SELECT id, round(greatest(0, least(1, greatest(0, {_iou('gs', 'ge', 'ps', 'pe')}) / 0.5)), 6) + 0.0 AS reward FROM spans", "spans")
def fn_iou_cut_reward(spark, d):
    return _spans(spark, d).select("id", r6(S.cut_linear(F.greatest(F.lit(0.0), F.col("iou")), 0.0, 0.5)).alias("reward"))


@query("fn_recall_at", "SELECT id, CASE WHEN x >= 0.3 THEN 1 ELSE 0 END AS r3, CASE WHEN x >= 0.5 THEN 1 ELSE 0 END AS r5, CASE WHEN x >= 0.7 THEN 1 ELSE 0 END AS r7 FROM (SELECT id, " + _iou("gs", "ge", "ps", "pe") + " AS x FROM spans)", "spans")
def fn_recall_at(spark, d):
    return _spans(spark, d).select("id", *[S.recall_at(F.col("iou"), t / 10).alias(f"r{t}") for t in (3, 5, 7)])


def report(spark, d):
    """The temporal-grounding report: semi join, last wins, parse, overlap, thresholds, aggregate."""
    p = V.predictions(spark, d)
    truth = V.spans(spark, d).where("l_partkey % 10 <> 0").select("id", F.col("gs").alias("tgs"), F.col("ge").alias("tge"))
    last = B.last_wins(p.select("id", "pred"), "id", ["pred"])
    # parsed below the join, so that the projections above it do not repeat the parsing
    t = last.select("id", T.time_range2(F.col("pred")).alias("t")).join(B.last_wins(truth, "id", ["tgs", "tge"]), "id")
    iou, precision, recall = S.overlap(F.col("t.s"), F.col("t.e"), F.col("tgs"), F.col("tge"))
    t = t.withColumns({"iou": iou, "precision": precision, "recall": recall}).where("iou <> -2")
    zero = lambda c: F.greatest(F.lit(0.0), F.col(c))
    return t.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("iou") == -1).cast("int")).alias("failures"), *[r6(F.avg(S.recall_at(F.col("iou"), x / 10)) * 100).alias(f"recall_{x}") for x in (3, 5, 7)],
        r6(F.avg(zero("iou")) * 100).alias("miou"), r6(F.avg(zero("precision")) * 100).alias("precision"), r6(F.avg(zero("recall")) * 100).alias("recall"),
    )


#: The last prediction and the last truth of an id, in the order of their values.
_KEPT = "kept AS (SELECT id, pred, t.gs AS gs, t.ge AS ge FROM (SELECT id, max(pred) AS pred FROM predictions GROUP BY id) JOIN (SELECT id, max({'gs': gs, 'ge': ge}) AS t FROM spans WHERE l_partkey % 10 <> 0 GROUP BY id) USING (id)), "
_TG = "WITH " + _KEPT + _PARSED.replace("FROM predictions", "FROM kept") + f", j AS (SELECT {_iou('gs', 'ge', 't2[1]', 't2[2]')} AS iou, {_iou('gs', 'ge', 't2[1]', 't2[2]', 'precision')} AS p, {_iou('gs', 'ge', 't2[1]', 't2[2]', 'recall')} AS r FROM parsed) SELECT count(*) AS n, count(*) FILTER (WHERE iou = -1) AS failures, round(avg(CASE WHEN iou >= 0.3 THEN 1 ELSE 0 END) * 100, 6) AS recall_3, round(avg(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END) * 100, 6) AS recall_5, round(avg(CASE WHEN iou >= 0.7 THEN 1 ELSE 0 END) * 100, 6) AS recall_7, round(avg(greatest(0, iou)) * 100, 6) AS miou, round(avg(greatest(0, p)) * 100, 6) AS precision, round(avg(greatest(0, r)) * 100, 6) AS recall FROM j WHERE iou <> -2"
query("agg_tg", _TG, "predictions")(report)


@query("snk_report", f"WITH r AS ({_TG.replace('WITH ', 'WITH __VIEWS__', 1)}) SELECT unnest(['recall_3', 'recall_5', 'recall_7', 'miou']) AS name, unnest([printf('%.6f', recall_3), printf('%.6f', recall_5), printf('%.6f', recall_7), printf('%.6f', miou)]) AS value FROM r".replace("__VIEWS__", ""), "predictions")
def snk_report(spark, d):
    """Written as lines of text and read again."""
    r, to = report(spark, d), _folder(spark, "report")
    names = ["recall_3", "recall_5", "recall_7", "miou"]
    files.write_report(r.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in names])).alias("m")).select("m.*"), to)
    parts = F.split("value", ", ")
    return spark.read.text(to).select(parts[0].alias("name"), parts[1].alias("value"))


_PHRASES = {"a": T.PHRASES_A, "b": T.PHRASES_B, "c": T.PHRASES_C}


def _letter_sql(c: str, phrases: list[str]) -> str:
    s = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    for p in phrases:
        s = f"replace({s}, '{p}', '')"
    return f"(CASE WHEN len(list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> '')) > 10 AND NOT regexp_matches({s}, '[A-Z]') THEN '' ELSE regexp_extract({s}, '[A-Z]') END)"


@query("fn_letter", f"SELECT id, {_letter_sql('said', T.PHRASES_A)} AS a, {_letter_sql('said', T.PHRASES_B)} AS b, {_letter_sql('said', T.PHRASES_C)} AS c FROM choices", "choices")
def fn_letter(spark, d):
    return V.choices(spark, d).select("id", *[T.letter(F.col("said"), p).alias(k) for k, p in _PHRASES.items()])


@query("fn_letter_idx", "SELECT id, CASE WHEN regexp_matches(said, '[A-E]') THEN ascii(regexp_extract(said, '[A-E]')) - 65 END AS idx FROM choices", "choices")
def fn_letter_idx(spark, d):
    return V.choices(spark, d).select("id", (F.ascii(F.nullif(F.regexp_extract("said", "[A-E]", 0), F.lit(""))) - 65).alias("idx"))


_TAGGED = "WITH x AS (SELECT id, CASE l_suppkey % 4 WHEN 0 THEN '<think>t</think><answer> ' || l_quantity || ' </answer>' WHEN 1 THEN 'so <answer>a</answer> or <answer>b' || chr(10) || l_linenumber || '</answer>' WHEN 2 THEN '<answer></answer>' ELSE 'none ' || -l_linenumber END AS t FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem))"


def _tagged(spark, d):
    q = F.col("l_quantity").cast("string")
    k = F.col("l_suppkey") % 4
    t = F.when(k == 0, F.concat(F.lit("<think>t</think><answer> "), q, F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("so <answer>a</answer> or <answer>b\n"), F.col("l_linenumber").cast("string"), F.lit("</answer>"))).when(k == 2, "<answer></answer>").otherwise(F.concat(F.lit("none "), (-F.col("l_linenumber")).cast("string")))
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), t.alias("t"))


@query("fn_answer_tag", _TAGGED + r" SELECT id, CASE WHEN regexp_matches(t, '(?s)<answer>.*?</answer>') THEN regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1) ELSE t END AS a FROM x")
def fn_answer_tag(spark, d):
    return _tagged(spark, d).select("id", T.answer_tag(F.col("t")).alias("a"))


@query("fn_answer_last", _TAGGED + r" SELECT id, regexp_replace(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\s+|\s+$', '', 'g') AS a FROM x")
def fn_answer_last(spark, d):
    return _tagged(spark, d).select("id", T.answer_last(F.col("t")).alias("a"))


@query("fn_float", _TAGGED + r" SELECT id, TRY_CAST(nullif(regexp_extract(t, '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE) AS v FROM x")
def fn_float(spark, d):
    return _tagged(spark, d).select("id", T.number(F.col("t")).alias("v"))


@query("fn_tag_pairs", _TAGGED + r" SELECT id, len(regexp_extract_all(t, '(?s)<answer>.*?</answer>')) AS n FROM x")
def fn_tag_pairs(spark, d):
    return _tagged(spark, d).select("id", T.tag_pairs(F.col("t"), "answer").alias("n"))


@query("fn_regression", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(greatest(0, least(1, 1 - (abs(l_linenumber - 4) + 1e-9) / (abs(l_quantity) + 1e-9))), 6) + 0.0 AS r FROM lineitem")
def fn_regression(spark, d):
    err = (F.abs(F.col("l_linenumber") - 4) + 1e-9) / (F.abs("l_quantity") + 1e-9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - err))).alias("r"))


@query("fn_capitalize", "SELECT doc_id, upper(left(text, 1)) || lower(substr(text, 2)) AS t FROM docs", "docs")
def fn_capitalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.capitalize(F.col("text")).alias("t"))


@query("fn_strip", r"SELECT conv_id, turn, regexp_replace('  ' || text || chr(9) || chr(10), '^\s+|\s+$', '', 'g') AS t FROM conversations")
def fn_strip(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip(F.concat(F.lit("  "), F.col("text"), F.lit("\t\n"))).alias("t"))


@query("fn_parse_output", "SELECT id, CASE l_suppkey % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'error' WHEN 2 THEN 'answer' ELSE 'error' END AS kind FROM spans", "spans")
def fn_parse_output(spark, d):
    k = F.col("l_suppkey") % 4
    t = F.when(k == 0, '<tool_call>{"name": "zoom", "arguments": {"start": 1}}</tool_call>').when(k == 1, '<tool_call>{"name": 1}</tool_call><answer>x</answer>').when(k == 2, "<answer>y</answer>").otherwise("nothing")
    return V.spans(spark, d).select("id", T.parse_output(t).alias("kind"))


@query("fn_zoom_valid", "SELECT id, CASE WHEN 0 <= ps AND ps < pe AND pe <= gs + 10 AND pe - ps > 1.0 THEN 1 ELSE 0 END AS ok FROM spans", "spans")
def fn_zoom_valid(spark, d):
    ok = (F.col("ps") >= 0) & (F.col("ps") < F.col("pe")) & (F.col("pe") <= F.col("gs") + 10) & (F.col("pe") - F.col("ps") > 1.0)
    return V.spans(spark, d).select("id", ok.cast("int").alias("ok"))


_TESTS = "WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CASE l_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 - l_suppkey % 6 END AS status FROM lineitem)"


def _tests(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    s = F.col("l_suppkey") % 6
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("i"), F.when(s == 0, 1).when(s == 1, 0).otherwise(1 - s).alias("status"))


@query("fn_lcb", _TESTS + " SELECT k, bool_and(status = 1) AS passed FROM t GROUP BY k")
def fn_lcb(spark, d):
    return _tests(spark, d).groupBy("k").agg(F.bool_and(F.col("status") == 1).alias("passed"))


@query("udf_bypass", "SELECT id, coalesce(CASE WHEN kind = 'A' THEN 0.25 END, CASE WHEN gold = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM choices", "choices")
def udf_bypass(spark, d):
    ready = F.when(F.col("kind") == "A", 0.25)
    return V.choices(spark, d).select("id", F.coalesce(ready, (F.col("gold") == "A").cast("double")).alias("score"))
