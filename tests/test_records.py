"""Properties and golden values of record shaping, masks by turn, plug-ins and model costs."""

from __future__ import annotations

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindrift.functions import arrays as A
from spindrift.functions import flops
from spindrift.functions import maths as M
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.operators import packing
from spindrift.operators import records as R
from spindrift.operators.registries import Curriculum, custom_scorer, timed_scorer
from spindrift.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_char_count(spark):
    rows = R.as_rl(R.char_count(spark, 1_000, 3, 6)).collect()
    assert len({r.id for r in rows}) == 1_000
    assert sum(r.split == "train" for r in rows) == 900
    for r in rows:
        asked, word = r.prompt[0].content.removeprefix("How many ").removesuffix("?").split(" are there in word ")
        letters = word.split("-")
        assert 3 <= len(letters) <= 6 and 1 <= letters.count(asked)
        lines = [f"{c} {'=' if c == asked else '!='} {asked}." for c in letters]
        assert r.extra_info.response == "\n".join([*lines, f"\\boxed{{{letters.count(asked)}}} {asked} in {word}."])
        assert r.reward_model.ground_truth == str(letters.count(asked))
    assert len({r.prompt[0].content.split()[2] for r in rows}) == 26
    assert R.char_count(spark, 50).collect() == R.char_count(spark, 50).collect() != R.char_count(spark, 50, seed=1).collect()
    assert R.char_count(spark, 0).count() == 0


def test_options(spark):
    shown, label = R.options(F.array(F.lit("x"), F.lit("x"), F.lit("y")), F.lit("right"), F.col("id"), 7)
    rows = spark.range(400).select(shown.alias("o"), label.alias("l")).collect()
    assert all(sorted(r.o) == ["right", "x", "x", "y"] and r.o["ABCD".index(r.l)] == "right" for r in rows)
    assert {r.l for r in rows} == set("ABCD")
    assert len({tuple(x for x in r.o if x != "right") for r in rows}) == 3


def test_tests_of_bad_json(spark):
    got = one(spark, R.test_cases(F.lit('[{"input": "1", "output": "2"}]'), F.lit("eJx packed"), F.lit("{}")))
    assert got == '{"inputs":["1"],"outputs":["2"],"fn_name":null}'
    assert one(spark, R.test_cases(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == '{"inputs":[],"outputs":[],"fn_name":null}'


def test_system_prompt(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, R.system_prompt("base", empty)) == "base" == one(spark, R.system_prompt("base", F.lit(None).cast("array<string>")))
    assert "<tools>\n{a}\n{b}\n</tools>" in one(spark, R.system_prompt("base", F.array(F.lit("{a}"), F.lit("{b}"))))


def test_merged(spark, tmp_path):
    both = R.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    files.write_results(spark.range(2).select(F.col("id").cast("string").alias("id"), both.alias("fields")), str(tmp_path / "r"))
    assert sorted((r.id, sorted(r.fields.items())) for r in files.read_results(spark, str(tmp_path / "r")).collect()) == [(i, [("a", "1"), ("b", "3")]) for i in "01"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def names(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_tool_mask(spark):
    mask = lambda ids, roles: one(spark, A.tool_mask(ints(*ids), 9, names(*roles), ints(*[1] * len(ids))))
    assert mask([1, 9, 2, 2, 9, 3, 9, 4], ["assistant", "tool", "tool", "assistant"]) == [1, 1, 0, 0, 0, 1, 1, 1]
    assert mask([1, 9, 2], ["tool"]) == [0, 0, 1]
    assert mask([1, 9, 9], ["assistant", "tool"]) == [1, 1, 0]
    assert mask([1, 2], ["assistant"]) == [1, 1] and mask([], []) == []
    with pytest.raises(PySparkException, match="no end token"):
        mask([1, 9, 2], ["assistant", "tool"])


def test_turn_mask(spark):
    turns = lambda *xs: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("n")) for r, n in xs])
    assert one(spark, A.turn_mask(turns(("system", 2), ("user", 1), ("assistant", 4), ("tool", 2), ("assistant", 1)), 2)) == [0] * 3 + [0, 0, 1, 1] + [0, 0] + [0]
    for bad, why in (([("user", 1), ("system", 1)], "must be the first"), ([("judge", 1)], "unknown role: judge")):
        with pytest.raises(PySparkException, match=why):
            one(spark, A.turn_mask(turns(*bad), 2))


@pytest.mark.parametrize(("place", "want"), [(1, [0.0, 2.0, 0.0]), (-1, [0.0, 0.0, 2.0]), (5, [0.0] * 3)])
def test_reward_at(spark, place, want):
    assert one(spark, A.reward_at(F.lit(3), F.lit(place), F.lit(2.0))) == want


def test_policy_terms(spark):
    terms = lambda a, new: spark.range(1).select(*[c.alias(k) for k, c in A.policy_terms(F.lit(0.0), F.lit(new), F.lit(a), 0.2, 0.2).items()]).first().asDict()
    assert terms(1.0, 1.0) == {"loss": pytest.approx(-1.2), "clipped": 1.0, "clipped_low": 0.0, "kl": -1.0}
    assert terms(-1.0, 2.0) == {"loss": 3.0, "clipped": 0.0, "clipped_low": 1.0, "kl": -2.0}
    assert terms(-1.0, 100.0)["kl"] == -20.0
    with pytest.raises(ValueError, match="over 1"):
        A.policy_terms(F.lit(0.0), F.lit(0.0), F.lit(0.0), 0.2, 0.2, 1.0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It happens in 20.8 - 30 seconds", (20.8, 30.0)), ("from 9 to 4", (4.0, 9.0)), ("a specific example is : 20.8 - 30.0 seconds! 3 - 5", (3.0, 5.0)),
        ("Start time: 0.8 seconds\nEnding time: 1.1 seconds", (0.8, 1.1)), ("start 7", (-1.0, -1.0)), ("one 3\ntwo 5", (-1.0, -1.0)), ("", (-1.0, -1.0)),
        ("starts at 00:00:18\nends at 00:00:23", (0.0, 0.0)), ("<answer> 1 - 2 </answer> 5 - 6", (1.0, 2.0)), ("<answer>1\n- 2</answer>", (1.0, 2.0)),
    ],
)
def test_time_range_spoken(spark, text, want):
    assert tuple(one(spark, T.time_range_spoken(F.lit(text)))) == want


def test_verified(spark):
    score = M.verified(lambda truths, texts: {"\\boxed{1}": 1.0, "\\boxed{2}": 0.5}[truths[0]])
    assert [r[0] for r in spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, None)], "t string, g string").select(score("t", "g")).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_custom_scorer(spark, tmp_path):
    path = tmp_path / "own.py"
    path.write_text("import math\n\ndef helper(x):\n    return math.floor(x)\n\ndef score(text, truth, more):\n    return helper(len(text) + more)\n")
    score = custom_scorer(str(path), "score", more=0.5)
    path.unlink()  # the text has gone with the plan
    assert [r[0] for r in spark.createDataFrame([("ab", ""), ("", "")], "t string, g string").select(score("t", "g")).collect()] == [2.0, 0.0]
    with pytest.raises(FileNotFoundError):
        custom_scorer(str(path), "score")
    path.write_text("score = 1 / 0")
    with pytest.raises(RuntimeError, match="cannot load"):
        custom_scorer(str(path), "score")
    path.write_text("x = 1")
    with pytest.raises(AttributeError, match="has no score"):
        custom_scorer(str(path), "score")


def test_timed_scorer(spark):
    def score(text, truth):
        if text == "slow":
            time.sleep(30)
        return {"list": [0.25, 9], "dict": {"score": 0.75}, "none": None, "yes": True}[text]

    texts = ["list", "slow", "dict", "none", "yes", "fails"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    began = time.monotonic()
    assert [r.x for r in rows.select("i", timed_scorer(score, 0.5)("t", "t").alias("x")).orderBy("i").collect()] == [0.25, 0.0, 0.75, 0.0, 1.0, 0.0]
    assert time.monotonic() - began < 20
    with pytest.raises(PySparkException, match="not a score"):
        rows.select(timed_scorer(lambda a, b: "x")("t", "t")).collect()


def test_curriculum(spark):
    rows = spark.createDataFrame([("easy", 0.9), ("hard", 0.1), ("even", 0.5), ("even", None), (None, 0.5)], "level string, score double")
    order = Curriculum("level", "score", 0.5)
    assert {r[0] for r in rows.select(order.rank()).collect()} == {0}
    order.update(rows)
    new = spark.createDataFrame([("hard",), ("new",), ("easy",), ("even",), (None,)], "level string")
    assert {r.level: r.p for r in new.select("level", order.rank().alias("p")).collect()} == {"even": 1, "easy": 2, "hard": 3, "new": 0, None: 0}
    order.update(spark.createDataFrame([("hard", 0.9)], "level string, score double"))
    assert order.seen["hard"] == (1.0, 2)
    with pytest.raises(ValueError, match="over 2 levels"):
        Curriculum("level", "score", 0.5, most=2).update(rows)


def test_dispatch(spark):
    rows = spark.range(5).withColumnRenamed("id", "rn")
    assert B.dispatch(rows, "all", 3).count() == 15 and B.dispatch(rows, "zero", 3).select("rank").distinct().count() == 1
    assert [r.rank for r in B.dispatch(rows, "split_padded", 3).orderBy("rn").collect()] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError, match="divide"):
        B.dispatch(rows, "split", 3)
    with pytest.raises(ValueError, match="unknown mode"):
        B.dispatch(rows, "ring", 3)


def test_imbalance(spark):
    rows = [(0, i, n) for i, n in enumerate([9, 1, 8, 2, 7, 3, 6, 4])] + [(1, 0, 5), (1, 1, 5)]
    got = {r.batch: r for r in packing.imbalance(spark.createDataFrame(rows, "batch bigint, item bigint, len bigint")).collect()}
    assert tuple(got[0])[1:] == (10, 10, 0, 10, 10, 0, 10.0)
    assert tuple(got[1])[1:] == (5, 5, 0, 5, 5, 0, 5.0)
    skew = spark.createDataFrame([(0, i, n) for i, n in enumerate([8, 8, 1, 1, 1, 1, 8, 8])], "batch bigint, item bigint, len bigint")
    assert tuple(packing.imbalance(skew).first())[1:] == (2, 16, 14, 9, 9, 0, 9.0)


def test_flops():
    small = {"model_type": "llama", "hidden_size": 8, "vocab_size": 10, "num_hidden_layers": 2, "num_attention_heads": 4, "num_key_value_heads": 2, "intermediate_size": 16}
    assert flops.costs(small) == (6 * (2 * (3 * 8 * 16 + 8 * (8 + 4 + 4 + 8)) + 160), 12 * 2 * 4 * 2)
    assert flops.costs({"model_type": "other"}) == (0, 0)
    assert [flops.peak(n) for n in ("NVIDIA H20", "NVIDIA H200", "NVIDIA L40S", "cpu")] == [148e12, 989e12, 181.05e12, float("inf")]


def test_digit(spark):
    rows = R.digit_prompts(spark, 20, 5, 5).select("prompt", R.digit_truth(F.col("prompt")).alias("t")).collect()
    assert len({r.prompt for r in rows}) == len(rows) == 21 * 6 * 6
    truth = {r.prompt: r.t for r in rows}
    assert truth["5,8:20,4"] == "11,14,17,0"
    assert truth["19,1:20,0"] == ""
    reward = lambda t, said: one(spark, R.digit_rewards(F.lit(t), F.lit(said)))
    assert reward("1,2", "1,3,2") == [0.25, 0.25, 0.0, 0.0, 0.0]
    assert reward("1,2", "1,2xx") == [0.25, 0.25, 0.25, 0.0, 0.0]
    assert reward("1,2", "") == []
    assert reward("", "9") == [0.0]


def test_template(spark):
    fill = lambda text, duration: one(spark, R.fill_template(R.VIDEO_LINE + " {input_text}", F.lit(text), F.lit(duration).cast("string")))
    assert fill("why {duration}?", "2.5") == "This is a video with duration 2.5 seconds. why {duration}?"
    assert fill("why?", None) == "This is an image. why?"


def test_follow(spark):
    df = spark.createDataFrame([(1, [{"a": [[("x",)]]}]), (2, None)], "id int, chat array<map<string,array<array<struct<k:string>>>>>")
    assert [r.x for r in df.orderBy("id").select(R.follow(df, "chat", "a", "k").alias("x")).collect()] == ["x", None]
    two = spark.createDataFrame([([("x",), ("y",)],)], "chat array<struct<k:string>>")
    with pytest.raises(PySparkException, match="one element"):
        two.select(R.follow(two, "chat", "k")).collect()
    with pytest.raises(KeyError):
        R.follow(two, "chat", "absent")


def test_corpus_positions(spark, tmp_path):
    """Files of several splits, blank lines, an empty file, a line without contents and repeated ones."""
    want = []
    for name, n in (("a", 3_000), ("b", 0), ("c", 1_500)):
        lines = [f'{{"contents": "{name} {i % 700}"}}' for i in range(n)] + ["", '{"other": 1}'] * (name == "c")
        want += [f"{name} {i % 700}" for i in range(n)] + [None] * (name == "c")
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = files.read_corpus(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.contents for r in sorted(rows, key=lambda r: r.doc_id)] == want
    assert sorted(r.doc_id for r in rows) == list(range(len(want)))


def test_tracker(spark, tmp_path):
    said = []
    rows = spark.createDataFrame([(2, 0.5, None), (1, 1.25, 3)], "step int, q double, n int")
    log = files.tracker("step", ["q", "n"], str(tmp_path / "t"), out=said.append)
    log(rows, 0)
    log(rows, 0)
    assert [x.split(" - ")[:2] for x in said[:2]] == [["step:1", "q:1.250"], ["step:2", "q:0.500"]]
    kept = spark.read.parquet(str(tmp_path / "t")).select("step", "metric", "value").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "q", 1.25), (1, "n", 3.0), (2, "q", 0.5), (2, "n", None)], key=str)
    with pytest.raises(ValueError):
        files.tracker("step", ["q"], backends=("elsewhere",))
    with pytest.raises(ValueError):
        files.tracker("step", ["q"])


def test_tracker_of_a_stream(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("step"), (F.col("id") / 2).alias("q"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    log = files.tracker("step", ["q"], str(tmp_path / "out"), ("table",))
    stream.writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.step for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))


def test_latest_checkpoint(spark, tmp_path):
    folder = str(tmp_path)
    assert files.latest_checkpoint(spark, None) is None
    assert files.latest_checkpoint(spark, folder) is None
    files.mark_iteration(spark, folder, 7)
    assert files.latest_checkpoint(spark, folder) is None
    (tmp_path / "global_step_12").mkdir()
    files.mark_iteration(spark, folder, 12)
    assert files.latest_checkpoint(spark, folder) == f"{folder}/global_step_12"
