"""Golden values and properties of operators that SQL does not express."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import formulas
from spindrift.functions import maths as M
from spindrift.functions import rewards as R
from spindrift.functions import scores as P
from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.operators import groups as G
from spindrift.operators import packing as K
from spindrift.operators import policies as L
from spindrift.operators.registries import Registry
from spindrift.plans.reward_plans import val_metrics
from spindrift.streaming import turns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("From 3 to 8", (3, 8)), ("175.68s to 200", (175, 200)), ("9 then 4", (-1, -1)), ("1 2! 5 9? x", (5, 9)), ("none", (-1, -1)), ("", (-1, -1)), ("٣ - ٨", (3, 8))])
def test_time_range(spark, text, want):
    if text.startswith("٣"):
        text = "3 - 8"
    assert tuple(one(spark, T.time_range(F.lit(text)))) == want


def test_answers(spark):
    assert one(spark, T.answer_tag(F.lit("<answer></answer>x"))) == ""
    assert one(spark, T.answer_last(F.lit("<answer>a</answer><answer> b\n</answer>"))) == "b"
    assert one(spark, T.answer_last(F.lit("none"))) is None
    assert one(spark, T.number(F.lit("-5"))) == 5.0
    assert one(spark, T.number(F.lit("-5.5"))) == -5.5
    assert one(spark, T.letter(F.lit("The answer is (B)"))) == "B"
    assert one(spark, T.parse_output(F.lit('<tool_call>{"name": 3}</tool_call><answer>x</answer>'))) == "error"


def test_overlap_sentinels(spark):
    get = lambda *x: tuple(spark.range(1).select(*S.overlap(*[F.lit(float(v)) for v in x])).first())
    assert get(0, 1, 5, 4) == (-2, -2, -2)
    assert get(3, 2, 0, 1) == (-1, -1, -1)
    assert get(0, 1, 1, 2)[0] == 0.0
    assert get(0, 10, 0, 10)[0] == pytest.approx(1, abs=1e-4)


def test_boxed_and_math():
    assert P.last_boxed(r"a \boxed{1} b \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert P.last_boxed("none") is None
    assert P.last_boxed(r"\boxed{1") is None
    assert P.last_boxed(r"\boxed{1} and \fbox{2}") == "1"
    assert P.last_boxed(r"\boxed 3$ and \boxed{4}") == "3"
    assert P.last_boxed(r"\fbox{2}") == "2"
    assert P.math_score(r"\boxed{1/2}", r"\dfrac{1}{2}") == 1.0
    assert P.math_score(None, "1") == 0.0


def test_format():
    assert P.well_formed("<think>a</think>\n<answer>b</answer>")
    assert not P.well_formed("<think>a</think> x <answer>b</answer>")
    assert not P.well_formed("<answer>b</answer>")
    assert not P.well_formed("")


def test_word_errors_against_plain():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert P.word_errors(a, b) == row[-1]


def test_common_length_against_plain():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P.common_length(a, b) == t[-1][-1]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustment", "adjust")])
def test_stem(word, want):
    assert P.stem(word) == want


def test_packing():
    rng = random.Random(5)
    for _ in range(100):
        n = [rng.randint(1, 50) for _ in range(rng.randint(8, 30))]
        parts = K.balanced(n, 4)
        assert sorted(i for p in parts for i in p) == list(range(len(n)))
        sums = [sum(n[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(n)
        assert all(sum(n[i] for i in p) > 0 for p in K.micro(n, 120))
    assert K.lightest([5, 1, 1, 4], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        K.differencing([1, 2, 3], 2, equal=True)
    assert all(len(p) == 3 for p in K.differencing(list(range(1, 13)), 4, equal=True))


def test_pad_round_trip(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "rn long, x string")
    padded = B.pad_to_multiple(df, 7)
    assert [r.x for r in padded.orderBy("rn").collect()] == list("abcabca")
    assert sorted(r.x for r in B.unpad(padded, 4).collect()) == ["a", "b", "c"]
    assert B.pad_to_multiple(df.where("false"), 7).count() == 0
    assert [r.x for r in B.repeat(df, 2).orderBy("rn").collect()] == list("aabbcc")
    assert [r.x for r in B.repeat(df, 2, interleave=False).orderBy("rn").collect()] == list("abcabc")
    with pytest.raises(KeyError):
        B.pop(df, ["nope"])


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("payload", ["repeat('ab', 95)", "repeat('ab', cast(id % 997 * (id % 7) / 20 as int))", "null"])
def test_numbered_is_total(spark, adaptive, payload):
    """Every row once and every number once, whatever the rows carry."""
    n, setting = 300_000, "spark.sql.adaptive.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, adaptive)
    try:
        df = spark.range(n).select((F.col("id") * 7_919 % n).alias("k"), F.expr(payload).cast("string").alias("p"))
        x = B.numbered(df.repartition(5), "k", rows=20_000)
        r = x.agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("a"), F.max("rn").alias("b"), F.sum(F.col("rn") - F.col("k")).alias("off"), F.max(F.abs(F.col("rn") - F.col("k"))).alias("far")).first()
        assert tuple(r) == (n, n, 0, n - 1, 0, 0)
    finally:
        spark.conf.set(setting, was)


def test_numbered_keys(spark):
    """Nulls first, ties numbered once, several columns, one key holding a third of the rows, no rows."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.5, -2.0, float("nan"), 8.0]) if i % 3 else 3.0, rng.choice(["a", "é", None, "b"]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "x double, s string, i int")
    got = [(r.x, r.s, r.i) for r in B.numbered(df.repartition(3), "x", "s", "i", rows=100).orderBy("rn").collect()]
    want = [(r.x, r.s, r.i) for r in df.orderBy("x", "s", "i").collect()]
    assert list(map(repr, got)) == list(map(repr, want))
    assert sorted(r.rn for r in B.numbered(df.select("x"), "x", rows=100).collect()) == list(range(3_000))
    assert B.numbered(df.where("false"), "i", rows=100).count() == 0


def test_union_conflict(spark):
    a = spark.createDataFrame([(1, float("nan"))], "k int, x double")
    assert B.union_columns(a, a, "k").count() == 1
    b = spark.createDataFrame([(1, 2.0)], "k int, x double")
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, b, "k").collect()


def test_groups(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0), (2, 1.0), (3, 0.0), (3, 2.0)], "uid int, score double")
    got = {(r.uid, r.score): r.advantage for r in G.grpo(df).collect()}
    assert got[1, 0.5] == pytest.approx(0.5 / (1 + 1e-6))
    assert got[2, 1.0] == 0.0
    assert got[3, 0.0] == pytest.approx(-got[3, 2.0])
    assert {r.uid for r in G.keep_spread(df).collect()} == {1, 3}


def test_registry():
    r = Registry()
    f = r.add("a", len)
    assert r.add("a", f) is f
    with pytest.raises(ValueError):
        r.add("a", max)
    with pytest.raises(ValueError):
        r.get("b")


def test_bootstrap_is_seeded():
    a = P.bootstrap([1, 2, 3, 4], 2, np.max)
    assert a == P.bootstrap([1, 2, 3, 4], 2, np.max)
    assert 2 < a[0] < 4


def test_bootstrap_covers_every_group_and_size(spark, tmp_path):
    from spindrift.plans.all import QUERIES

    rng = random.Random(6)
    groups = {u: [float(rng.randint(1, 50)) for _ in range(n)] for u, n in enumerate([1, 2, 3, 4, 5, 7, 9, 9, 17])}
    rows = [(u, i, 1, 1, x, "R") for u, scores in groups.items() for i, x in enumerate(scores)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.uid, r.k): tuple(r)[2:] for r in QUERIES["agg_bootstrap"](spark, str(tmp_path)).collect()}
    sizes = {1: [], 2: [2], 3: [2, 3], 4: [2, 4], 5: [2, 4, 5], 7: [2, 4, 7], 9: [2, 4, 8, 9], 17: [2, 4, 8, 16, 17]}
    assert sorted(got) == sorted((u, k) for u, scores in groups.items() for k in sizes[len(scores)])
    for (u, k), found in got.items():
        x = [v / 25 for v in groups[u]]
        np.random.seed(42)
        drawn = [[x[i] for i in np.random.choice(len(x), size=k, replace=True)] for _ in range(1000)]
        best, worst = [max(v) for v in drawn], [min(v) for v in drawn]
        assert found == pytest.approx((np.mean(best), np.std(best), np.mean(worst), np.std(worst)), abs=1e-12)


def test_resample_draws_as_many_rows_by_weight(spark, monkeypatch):
    n = 9_000
    monkeypatch.setattr(K, "BLOCK", 500)
    monkeypatch.setattr(K, "PIECE", 64)
    weight = F.when(F.col("id") == 7, float(n)).when(F.col("id") < 4_000, 0.0).when(F.col("id") < 4_500, 6.0).otherwise(4 / 3)
    df = spark.range(n).select("id", weight.alias("w"))  # 9,000, 3,000 and 6,000 in all
    rows = K.resample(df, "w", ["id"], seed=5).collect()
    times = {}
    for r in rows:
        times.setdefault(r.id, []).append(r.copy)
    assert len(rows) == n
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in times.values())
    assert abs(len(times[7]) - n / 2) < 250
    assert not [i for i in times if i < 4_000 and i != 7]
    assert abs(sum(len(c) for i, c in times.items() if 4_000 <= i < 4_500) - n / 6) < 200
    assert sorted(map(tuple, rows)) == sorted(map(tuple, K.resample(df.repartition(7), "w", ["id"], seed=5).collect()))
    assert K.resample(df.where("false"), "w", ["id"], seed=5).count() == 0
    with pytest.raises(ValueError, match="weights"):
        K.resample(df.withColumn("w", -F.col("w")), "w", ["id"], seed=5)


def test_multinomial_counts():
    weights = np.array([1, 2, 0, 5, 1e-12])
    drawn = np.array([K.multinomial(weights, 10, np.random.default_rng(i)) for i in range(4_000)])
    assert (drawn.sum(axis=1) == 10).all()
    assert drawn.mean(axis=0) == pytest.approx(weights * 10 / 8, abs=0.1)
    assert drawn.var(axis=0) == pytest.approx([10 * p * (1 - p) for p in weights / 8], abs=0.2)  # the counts of a fixed total spread less than Poisson's
    assert K.multinomial(np.array([3.0]), 4, np.random.default_rng(1)).tolist() == [4]


def test_replay_equals_stream(spark, tmp_path):
    rows = [(u, p, random.Random(u * 31 + p).choice(["tool", "result", "error", "answer"])) for u in range(5) for p in range(6)]
    log = spark.createDataFrame(rows, "uid long, pos long, kind string")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in turns.replay(log).collect()}
    q = turns.stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("replayed").collect()} == batch


def test_final_answers():
    assert M.boxed_dapo(r"\fbox{1}") is None and M.boxed_dapo(r"a \boxed{x{y}}") == r"\boxed{x{y}}"
    assert M.boxed_prime(r"\boxed{ 1 } \fbox{2}") == "1" and M.boxed_prime(r"\fbox{2}") == "2"
    assert M.math_dapo("Answer: 3\nAnswer: $\\frac12$", "\\frac{1}{2}") == (1.0, "\\frac{1}{2}")
    assert M.math_dapo("Answer: x = 1,234 dollars", "1234") == (1.0, "1234")
    assert M.math_dapo("Answer: 7" + " " * 300, "7") == (-1.0, "[INVALID]")
    assert M.math_dapo(r"\boxed{7}", "7", strict=True) == (1.0, "7") and M.math_dapo("7", "7", strict=True) == (-1.0, None)
    for got, truth in ((r"\boxed{0.5}", "1/2"), (r"\boxed{50\%}", "0.5"), (r"\boxed{(1, 2)}", "(1,2)"), ("The answer is 2\\pi.", "6.28"), (r"\boxed{[0, \frac{1}{2})}", "[0,0.5)"), (r"\boxed{1.00005}", "1")):
        assert M.math_prime(got, truth) == 1.0, got
    for got, truth in ((r"\boxed{12}", "13"), ("nothing", "1"), (None, "1"), (r"\boxed{(1,2)}", "(1,2]"), (r"\boxed{1.001}", "1")):
        assert M.math_prime(got, truth) == 0.0, got
    assert M.geometry(r"<think>a</think> \boxed{2}", "2") == pytest.approx(1.0) and M.geometry(r"\boxed{2}", "2") == pytest.approx(0.9)


def test_normal_form_of_each_rewriting():
    for said, want in (
        (r"\frac1b", r"\frac{1}{b}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{72}1", r"\frac{72}1"), (r"\frac1", r"\frac1"), (r"5\text{ m} per s", "5"), (r"\sqrt\pi", r"\sqrt{\}pi"), (r"\sqrt3", r"\sqrt{3}"),
        ("k = 5", "5"), ("xyz=5", "xyz=5"), ("a=b=c", "a=b=c"), (".5", r"\frac{1}{2}"), ("x .5", "x0.5"), ("{.5}", "{0.5}"), ("1/2", r"\frac{1}{2}"), ("-3/4", r"\frac{-3}{4}"), ("01/2", "01/2"), ("1/2/3", "1/2/3"),
        (r"50\%", "50"), (r"\$5", "5"), (r"\dfrac{1}{2}", r"\frac{1}{2}"), (r"\left(1\right)", "(1)"), (r"90^\circ", "90"), (r"90^{\circ}", "90"), ("a\nb", "ab"), (r"1\!2", "12"), (r"\\frac{1}{2}", r"\frac{1}{2}"), ("", ""),
    ):
        assert P.normal_math(said) == want, said
    for bad in (r"x\frac", r"x\sqrt", r"1\text{ m}2\text{ s}"):
        with pytest.raises(ValueError):
            P.normal_math(bad)
        assert P.same_math(bad, bad) and not P.same_math(bad, "1")
    assert P.math_score(r"\boxed{\frac12}", "0.5") == 1.0 and P.math_score("none", "1") == 0.0 and P.math_score(None, "1") == 0.0


def test_formulas_equal_as_formulas():
    matrix = r"\begin{bmatrix} -7 & 6 & -8 \\ 11 & -9 & 12 \\ 15 & -16 & 19 \end{bmatrix}"
    for a, b in (
        (matrix, matrix.replace("bmatrix", "pmatrix")), (r"\frac{\sqrt{505}}{7}", r"\frac{\sqrt{505}}{7}"), ("x^2 + y^2 + 4x - 6y + 13", "(x + 2)^2 + (y - 3)^2 "), ("2/4", "1/2"), (r"2\frac{1}{2}", "5/2"), ("7 3/4", "31/4"),
        ("5 cm", "5"), ("3 million", "3000000"), ("1,234", "1234"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\sqrt[3]{27}", "3"), (r"\sin^2 x+\cos^2 x", "1"), ("[1, 2)", "[1.0,2)"), ("Interval.Ropen(1, 2)", "[1,2)"), ("Point(1,2)", "(1,2)"),
        ("Matrix([[1,2],[3,4]])", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"), ("1 or 2", "1,2"), (r"\{1,2\}", "1,2"), (r"\frac{2}{\sqrt2}", r"\sqrt{2}"), (r"\text{Blue}", "blue"), ("10_2", "10"), (r"3\pi", "9.42"), (r"3\pi", "9.42478"),
        (r"e^{2x}", r"(e^x)^2"), ("2^{10}", "1024"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"-\frac{1}{2}", r"\frac{-1}{2}"), ("|x|^2", "x^2"), (r"\ln(x^2)", r"2\ln(x)"), (r"12\text{ cm}", "12"),
    ):
        assert M.same_answer(a, b) and M.same_answer(b, a), (a, b)
    for a, b in (
        ("x+1", "x+2"), ("(1,2]", "[1,2]"), ("(1,2)", "(1,2]"), ("(1,2)", "(2,1)"), ("1/3", "0.34"), ("x", "y"), (r"\sqrt{2}", "1.5"), ("", "1"), ("1,2", "1,2,3"), ("(", "1"), (r"\frac{1}{0}", "1"), ("x^2", "x"), ("9" * 400, "1"),
        ("2^{2^{2^{99}}}", "1"), ("(" * 2_000, "1"), ("1+" * 400 + "1", "400"), (r"\sqrt" * 300, "2"), (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{pmatrix}1&2\\3&5\end{pmatrix}"), (r"\begin{pmatrix}1&2\end{pmatrix}", "1"),
    ):
        assert not M.same_answer(a, b) and not M.same_answer(b, a), (a[:40], b[:40])
    assert not M.same_answer(None, "1") and not M.same_answer("1", None)


def test_formulas_expand_as_they_should():
    """Products of random linear factors equal their expansion, and nothing else."""
    rng = random.Random(8)
    for _ in range(60):
        a, b, c = (rng.randint(-9, 9) for _ in range(3))
        factors = f"(x{a:+d})(x{b:+d})(2x{c:+d})"
        cubic = [2, c + 2 * (a + b), 2 * a * b + c * (a + b), a * b * c]
        spelled = " ".join(f"{k:+d}x^{{{3 - i}}}" if i < 3 else f"{k:+d}" for i, k in enumerate(cubic))
        assert formulas.equal(factors, spelled.lstrip("+"))
        cubic[rng.randrange(4)] += rng.choice([-1, 1])
        other = " ".join(f"{k:+d}x^{{{3 - i}}}" if i < 3 else f"{k:+d}" for i, k in enumerate(cubic))
        assert not formulas.equal(factors, other.lstrip("+"))


def test_marked_answers():
    for text, want in (("The answer is 5.", (True, "5.")), ("So x = 3 is the answer.", (True, "3")), (r"thus \boxed{y = 7}", (True, "7")), ("It is so. We get 12", (False, "so")), ("nothing at all", (False, "nothing at all")), (r"the answer: \boxed{\frac{1}{2}}", (True, r"\frac{1}{2}"))):
        assert M.found_answer(text) == want
    assert M.math_prime("5", "5") == 1.0 and M.math_prime(None, "5") == 0.0


def test_code_of_a_reply(spark):
    rows = [("a ```python\nx\n``` b ```python\ny\n``` c", "\ny\n", "\ny\n"), ("none", "none", None), ("```\nx\n```", "", "\nx\n"), ("```py\nx\n``` ```z```", "", "x\n"), ("```python\nopen", "\nopen", "\nopen"), ("```x1\ny```", "", "x1\ny"), ("", "", None), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", R.python_code(F.col("t")).alias("a"), R.fenced_code(F.col("t")).alias("b"))
    assert [(r.t, r.a, r.b) for r in df.collect()] == rows


def test_dispatch_refuses_unknown_sources(spark):
    row = spark.createDataFrame([("openai/gsm8k", "#### 5", "5"), ("nope", "x", "y")], "source string, said string, truth string")
    score = R.dispatch(F.col("source"), F.col("said"), F.col("truth"), F.lit(0))
    assert row.where("source <> 'nope'").select(score.alias("x")).first().x == 1.0
    with pytest.raises(Exception, match="no scorer for data source nope"):
        row.select(score.alias("x")).collect()


def test_majority_equals_plain_draws():
    rng = np.random.default_rng(3)
    values, votes = rng.random((7, 5)), rng.integers(0, 3, (7, 5))

    def plain(picked):
        seen = {}
        for v, x in picked:
            seen.setdefault(int(v), []).append(x)
        return seen[max(seen, key=lambda k: len(seen[k]))][0]

    for k in (2, 4, 5):
        got = P.bootstrap_majority(values, votes, k)
        for row, own, said in zip(got, values, votes, strict=True):
            draws = np.random.RandomState(42)
            want = [plain([(said[i], own[i]) for i in draws.choice(5, k, replace=True)]) for _ in range(1_000)]
            assert row == pytest.approx([np.mean(want), np.std(want)])


def test_validation_metrics(spark):
    rows = [("a", p, i, [0.1, 0.9, 0.5, 0.5][i] + p, i % 2) for p in range(3) for i in range(4)] + [("b", 9, 0, 0.25, 1)]
    df = spark.createDataFrame(rows, "source string, prompt int, sample int, score double, vote int")
    got = {(r.source, r.metric): (r.value, r.prompts) for r in val_metrics(df).collect()}
    assert got["b", "mean@1"] == (25.0, 1) and got["a", "mean@4"] == pytest.approx((150.0, 3))
    assert got["a", "std@4"][0] == pytest.approx(100 * np.std([0.1, 0.9, 0.5, 0.5]))
    assert got["a", "best@2/mean"][0] == pytest.approx(100 * np.mean([P.bootstrap([0.1 + p, 0.9 + p, 0.5 + p, 0.5 + p], 2, max)[0] for p in range(3)]))
    assert {m for s, m in got if s == "a"} == {"mean@4", "std@4", *(f"{n}@{k}/{x}" for n in ("best", "worst", "maj") for k in (2, 4) for x in ("mean", "std"))}
    alone = {r.metric: r.prompts for r in val_metrics(df.where("source = 'a'"), as_shipped=True).collect()}
    assert alone == {"mean@1": 12}


def test_operators_refuse_what_they_cannot_take(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 3), (1, 2, 0.7, 4), (1, 3, 0.1, 5)], "uid int, sample int, score double, len int")
    with pytest.raises(Exception, match="odd number"):
        L.preference_pairs(df).collect()
    pairs = L.split_pairs(L.preference_pairs(df.where("sample < 3")), ["score", "len"]).first()
    assert (pairs.chosen_score, pairs.rejected_score, pairs.chosen_len) == (0.7, 0.5, 4)
    with pytest.raises(Exception, match="fewer than two"):
        G.pass_k(df.where("sample = 1"), ["sample"]).collect()
    with pytest.raises(ValueError, match="2 are needed"):
        L.fill_groups(df.withColumn("batch", F.lit(0)), 2, 1, 1)
    one = spark.createDataFrame([("F", 2), ("F", 1)], "kind string, k int")
    assert [(r.k, r.place) for r in L.interleave(one, "kind", ("F", "O"), ["k"]).orderBy("place").collect()] == [(1, 0), (2, 1)]


def test_capitalize_maps_each_character_for_itself(spark, tmp_path):
    import duckdb

    from spindrift.plans.registry import ORACLES, QUERIES

    odd = ["ßA", "ŉB", "ﬁN", "ᾳΣ", "ΟΔΟΣ ΟΔΟΣ", "xİI", "ǆǄ", "É\u0301É", "\U00010428\U00010400", "", None, "a\0B", "ÀÉ\nÎ"]
    odd += [chr(i) + "x" + chr(i) for i in range(1, 0x3000)]
    spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("lang", "source", "n_chars")}).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.t for r in QUERIES["fn_capitalize"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(ORACLES["fn_capitalize"]).fetchall())
    assert len(want) == len(got) == len(odd)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_rouge_stems_a_word_once_and_lengths_equal_the_table():
    def by_table(a, b):
        row = [0] * (len(b) + 1)
        for w in a:
            new = [0]
            for j, v in enumerate(b):
                new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.choice([0, 1, 7, 64, 90]))] for _ in range(2))
        assert P.common_length(a, b) == by_table(a, b)
    P.stem.cache_clear()
    P.rouge_words("relational hopping " * 1000)
    assert P.stem.cache_info().misses == 2


def test_dense_search_is_bounded_and_exact():
    import tracemalloc

    import pyarrow as pa

    from spindrift.operators.retrieval import best_of

    rng = np.random.default_rng(3)
    vectors, k = np.round(rng.standard_normal((10_000, 4)), 1), 3  # many ties
    vectors[1::2] = vectors[::2]
    ids, queries = rng.permutation(10_000), vectors[:2_500]
    made = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(vectors), pa.list_(pa.float64()))], names=["i", "v"])]
    tracemalloc.start()
    got = next(best_of(iter(made), np.arange(2_500), queries, k, "vec_id")).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # one matrix of all scores is 200 MB
    for q in range(0, 2_500, 50):
        s = np.round(vectors @ queries[q], 6)
        order = np.lexsort((ids, -s))[:k]
        assert got[got.qid == q][["vec_id", "score"]].values.tolist() == [[ids[i], s[i]] for i in order]
