"""Formulas of all forms: normal forms, equality of answers, code answers scored from result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import maths as M
from spindrift.functions import rewards as R
from spindrift.functions import scores as P
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table

#: (said, truth, whether the normal forms are equal, whether the answers are): {n} and {m} stand for numbers of the row, which may differ.
FORMS = [
    ("\\dfrac{n}7", "\\frac{m}{7}", "false", "n = m"), ("\\frac{n}{7}", "\\tfrac{m}{7}", "n = m", "n = m"), ("\\sqrt{n}", "\\sqrt{m}", "n = m", "n = m"), ("x = {n}", "{m}", "n = m", "n = m"),
    ("{n}\\text{ cm} long", "{m}", "n = m", "n = m"), ("{n}/7", "\\frac{m}{7}", "n = m", "n = m"), (".5", "\\frac12", "true", "true"), ("{n}^\\circ", "{m}", "n = m", "n = m"),
    ("\\left(x+{n}\\right)^2", "x^2+2\\cdot {m}x+{m}^2", "false", "n = m"), ("(x-{n})(x+{n})", "x^2-{m}^2", "false", "n = m"), ("\\begin{pmatrix}{n}&1\\\\2&3\\end{pmatrix}", "\\begin{bmatrix} {m} & 1 \\\\ 2 & 3 \\end{bmatrix}", "false", "n = m"),
    ("[0, {n})", "[0,{m}.0)", "false", "n = m"), ("(1,{n})", "(1,{m}]", "false", "false"), ("{n} hours", "{m}", "false", "n = m"), ("{n}\\pi", "{m}*3.14159265", "false", "n = m"), ("\\sqrt{{n}^2}", "{m}", "false", "n = m"),
    ("\\frac{x^2-{n}^2}{x-{n}}", "x+{m}", "false", "n = m"), ("{n}\\%", "{m}", "n = m", "n = m"), ("\\sin^2 x+\\cos^2 x+{n}", "1+{m}", "false", "n = m"), ("{n}+x", "x+{m}", "false", "n = m"),
]


def _put(form: str, name: str) -> F.Column:
    """The form with the row's number; a brace that is TeX's stays."""
    braced = form.replace("{n}", "\0").replace("{m}", "\0")
    parts = braced.split("\0")
    tex = ("frac", "tfrac", "dfrac", "sqrt")  # of these {n} keeps its braces
    out = [F.lit(parts[0])]
    for before, after in zip(parts, parts[1:], strict=False):
        keep = any(before.endswith(t) for t in tex) and not after.startswith("^")
        out += [F.lit("{" if keep else ""), F.col(name).cast("string"), F.lit("}" if keep else ""), F.lit(after)]
    return F.concat(*out)


_CASE = "WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber AS n, l_partkey % 2 + l_linenumber AS m, l_suppkey % %d AS k FROM lineitem)".replace("% %d", f"% {len(FORMS)}")


def forms(spark, d):
    """Every kind of formula with the row's numbers, a half of them equal."""
    x = table(spark, d, "lineitem").select(V.row_id().alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 2 + F.col("l_linenumber")).alias("m"), (F.col("l_suppkey") % len(FORMS)).alias("k"))
    said = truth = F.lit(None).cast("string")
    for k, (a, b, _, _) in enumerate(FORMS):
        said, truth = (F.when(F.col("k") == k, _put(f, c)).otherwise(o) for f, c, o in ((a, "n", said), (b, "m", truth)))
    return x.select("id", said.alias("said"), truth.alias("truth"), "k")


def _which(place: int) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {f[place]}" for k, f in enumerate(FORMS)) + " END"


@query("fn_math", f"{_CASE} SELECT id, ({_which(2)})::INTEGER::DOUBLE AS score FROM x")
def fn_math(spark, d):
    x = forms(spark, d)
    return x.select("id", P.math_equal(F.concat(F.lit("so \\boxed{"), "said", F.lit("}.")), F.col("truth")).alias("score"))


#: A form of each rewriting, and what it becomes.
NORMAL = [
    ("\\frac{n}b", "\\frac{{n}}{b}"), ("\\frac1{{n}}", "\\frac{1}{{n}}"), ("{n}\\text{ m} per s", "{n}"), ("\\sqrt{n}x", "\\sqrt{{n}}x"), ("k = {n}", "{n}"), ("{n}^{\\circ}", "{n}"), ("\\$1{n}\\%", "1{n}"),
    (".2{n}", "0.2{n}"), ("-{n}/3", "\\frac{-{n}}{3}"), ("0{n}/3", "0{n}/3"), ("\\left( {n},\\! 2\\right)", "({n},2)"), ("\\dfrac{{n}}{2}", "\\frac{{n}}{2}"), ("xyz={n}", "xyz={n}"), ("\\sqrt\\pi {n}", "\\sqrt{\\}pi{n}"),
]


@query("fn_math_norm", "WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, '' || l_linenumber AS n, l_suppkey % " + str(len(NORMAL)) + " AS k FROM lineitem) SELECT id, CASE k " + " ".join(f"WHEN {k} THEN replace('{b}', '{{n}}', n)" for k, (_, b) in enumerate(NORMAL)) + " END AS form FROM x")
def fn_math_norm(spark, d):
    """One form of each rewriting."""
    k, n = F.col("l_suppkey") % len(NORMAL), F.col("l_linenumber").cast("string")
    said = F.lit(None).cast("string")
    for i, (a, _) in enumerate(NORMAL):
        said = F.when(k == i, F.replace(F.lit(a), F.lit("{n}"), n)).otherwise(said)
    return table(spark, d, "lineitem").select(V.row_id().alias("id"), M.reader(P.normal_math)(said).alias("form"))


@query("fn_math_prime", f"{_CASE} SELECT id, ({_which(3)})::INTEGER::DOUBLE AS score FROM x")
def fn_math_prime(spark, d):
    """Marked in the text in two ways."""
    said = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Thus \\boxed{"), "said", F.lit("}"))).otherwise(F.concat(F.lit("I think.\nThe answer is "), "said"))
    return forms(spark, d).select("id", M.prime(said, F.col("truth")).alias("score"))


@query("fn_geo3k", f"{_CASE} SELECT id, round(0.9 * ({_which(3)})::INTEGER + CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0.0 END, 6)::DOUBLE AS score FROM x")
def fn_geo3k(spark, d):
    t = F.concat(F.when(F.col("k") % 3 == 0, "<think>t</think> ").otherwise("<think>t "), F.lit("so \\boxed{"), "said", F.lit("}"))
    return forms(spark, d).select("id", r6(M.geo3k(t, F.col("truth"))).alias("score"))


#: 1 passed, 0 failed, -1 to -4 what kept a case from ending; every fourth part passes all.
_TESTS = "WITH t AS (SELECT l_partkey AS k, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS i, CASE WHEN l_partkey % 4 = 1 OR (l_orderkey + l_linenumber) % 5 > 1 THEN 1 ELSE -((l_orderkey + l_suppkey) % 5) END::INTEGER AS status FROM lineitem)"
_N = "p_partkey"


def replies(spark, d):
    """A reply a part: without a block, two blocks of Python, a block without a language, another language's, a block that does not end."""
    n = F.col("p_partkey").cast("string")
    block = lambda lang, name, end="```": F.concat(F.lit(f"```{lang}\n{name} = "), n, F.lit("\n" + end))
    forms = [F.concat(F.lit("c = "), n), F.concat(block("python", "a"), F.lit(" better "), block("python", "b"), F.lit(" done")), F.concat(F.lit("see "), block("", "a")), F.concat(block("py", "a"), F.lit(" and "), block("", "b")), block("python", "a", "")]
    said = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        said = F.when(F.col("p_partkey") % 5 == k, f).otherwise(said)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), said.alias("said"))


def results(spark, d):
    """Results of a part's cases, a line each, in order."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    status = F.when((F.col("l_partkey") % 4 == 1) | ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 > 1), 1).otherwise(-((F.col("l_orderkey") + F.col("l_suppkey")) % 5)).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.row_number().over(w).alias("i"), status.alias("status"))


_ALL, _TEN = "bool_and(status = 1)", "avg((status = 1)::INTEGER) FILTER (WHERE i <= 10)"


@query("fn_code", _TESTS + f""", r AS (SELECT k, {_ALL} AS passed, {_TEN} AS share FROM t GROUP BY k)
  SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'c = ' || {_N} WHEN 1 THEN chr(10) || 'b = ' || {_N} || chr(10) WHEN 2 THEN 'see ' WHEN 3 THEN '' ELSE chr(10) || 'a = ' || {_N} || chr(10) END AS code,
    coalesce(passed, true)::INTEGER::DOUBLE AS score, round(CASE WHEN passed IS NULL OR passed THEN 1 ELSE share END, 6)::DOUBLE AS continuous FROM part LEFT JOIN r ON k = p_partkey""")
def fn_code(spark, d):
    """1 if all cases passed (also of none), else 0, or the share of the first ten where scores are continuous."""
    x = replies(spark, d).withColumn("code", R.python_code(F.col("said")))
    return R.code_scores(x, results(spark, d), "k").select("k", "code", r6("score").alias("score"), r6("continuous").alias("continuous"))


@query("fn_code_remote", _TESTS + f""", c AS (SELECT k, min(i) FILTER (WHERE status = -4) AS first FROM t GROUP BY k), s AS (SELECT k, i, CASE WHEN i >= first THEN -4 ELSE status END AS status FROM t JOIN c USING (k)),
  r AS (SELECT k, avg((status = 1)::INTEGER) AS rate, {_TEN} AS share, count(*) FILTER (WHERE status = -4) AS uncompiled FROM s GROUP BY k)
  SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 1 THEN chr(10) || 'b = ' || {_N} || chr(10) WHEN 2 THEN chr(10) || 'a = ' || {_N} || chr(10) WHEN 3 THEN 'a = ' || {_N} || chr(10) WHEN 4 THEN chr(10) || 'a = ' || {_N} || chr(10) END AS code,
    round(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE coalesce(rate, 0) END, 6)::DOUBLE AS score, round(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE coalesce(share, 0) END, 6)::DOUBLE AS continuous, coalesce(uncompiled, 0) AS uncompiled FROM part LEFT JOIN r ON k = p_partkey""")
def fn_code_remote(spark, d):
    """0 without code or cases; a case that does not compile spreads to the later ones; share of all cases, or of the first ten."""
    x = replies(spark, d).withColumn("code", R.fenced_code(F.col("said")))
    return R.remote_scores(x, results(spark, d), "k").select("k", "code", r6("score").alias("score"), r6("continuous").alias("continuous"), "uncompiled")
