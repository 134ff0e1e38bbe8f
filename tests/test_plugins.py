"""Reward managers, classes loaded by path, tables that grow, video records: edges and errors beside what SQL checks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import frames as N
from spindrift.operators import losses as L
from spindrift.operators import managers
from spindrift.operators import plugins as U
from spindrift.operators import records as R
from spindrift.operators import search as S
from spindrift.operators import videos as W
from spindrift.operators.registries import REWARD_MANAGERS, Registry
from spindrift.plans.plugin_plans import PLUGINS
from spindrift.sources import files


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# reward managers ------------------------------------------------------------------------------


def test_manager_registry():
    assert set(REWARD_MANAGERS.known) == {"naive", "naive_multiturn", "batch", "dapo", "prime", "prime_multiturn"}
    known = Registry()
    f = known.add("mine", lambda rows: rows)
    assert known.add("mine", f) is f and known.get("mine") is f
    with pytest.raises(ValueError, match="mine is taken"):
        known.add("mine", lambda rows: rows)
    with pytest.raises(ValueError, match="unknown name yours"):
        known.get("yours")


@pytest.fixture(scope="module")
def replies(spark):
    rows = [("g", "5", ["#### ", "5", ""], [1, 1, 0], [1, 0, 0], 1), ("g", "6", ["#### 5", "", ""], [1, 0, 0], [1, 0, 0], 1), ("g", "7", ["", "", ""], [0, 0, 0], [0, 0, 0], 2), ("g", None, ["a", "b", "c"], [1, 1, 1], [0, 1, 1], 2)]
    return spark.createDataFrame(rows, "data_source string, truth string, tokens array<string>, attention array<int>, loss array<int>, uid int").replace("g", "openai/gsm8k", ["data_source"])


def test_managers_with_the_default_scorer(spark, replies):
    got = [(r.reward, r.place, r.extras) for r in managers.manage("naive", replies).collect()]
    assert got == [(1.0, 1, {}), (0.0, 0, {}), (0.0, -1, {}), (0.0, 2, {})]
    assert [(r.reward, r.place) for r in managers.manage("naive_multiturn", replies).collect()] == [(0.0, 0), (0.0, -1), (0.0, -1), (0.0, 1)]
    assert [r.place for r in managers.manage("prime_multiturn", replies).collect()] == [0, 0, -1, 1]
    assert [r.acc for r in managers.manage("prime", replies).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_manager_options(spark, replies):
    flat = lambda source, text, truth: F.lit(1.0)
    got = managers.manage("dapo", replies, flat, longest=3, buffer=2, factor=2.0, log=True).collect()
    assert [r.reward for r in got] == [0.0, 1.0, 1.0, -1.0] and [r.extras["overlong"] for r in got] == [1.0, 0.0, 0.0, 1.0]
    ends = managers.manage("dapo", replies, lambda s, text, t: F.struct(F.length(text).alias("score")), end="5").collect()
    assert [r.reward for r in ends] == [5.0, 5.0, 0.0, 3.0]
    with pytest.raises(ValueError, match="longest"):
        managers.manage("dapo", replies, flat, buffer=2)
    with pytest.raises(ValueError, match="field score"):
        managers.manage("naive", replies, lambda s, text, t: F.struct(F.lit(1).alias("other")))
    with pytest.raises(KeyError):
        managers.manage("naive", replies.drop("loss"), flat)
    with pytest.raises(ValueError, match="unknown name best"):
        managers.manage("best", replies, flat)
    ready = replies.withColumn("rm_score", F.lit(0.5))
    for name in REWARD_MANAGERS.known:
        assert {r.reward for r in managers.manage(name, ready, None if name != "batch" else (lambda *x: [])).collect()} == {0.5}


def test_batch_manager_sees_groups(spark, replies):
    sizes = managers.manage("batch", replies, lambda sources, texts, truths: [{"score": len(texts), "first": float(t == texts[0])} for t in texts], by="uid").collect()
    assert {(r.uid, r.reward) for r in sizes} == {(1, 2.0), (2, 2.0)} and all(r.acc == r.reward for r in sizes)
    with pytest.raises(Exception, match="a score for each row"):
        managers.manage("batch", replies, lambda *x: [], by="uid").collect()
    assert managers.manage("batch", replies.limit(0), lambda *x: [], by="uid").collect() == []


def test_batch_manager_scores_many_groups_in_a_batch(spark, replies):
    places = lambda sources, texts, truths: [{"score": i, "of": len(texts)} for i in range(len(texts))]
    many = spark.range(20_000).select((F.col("id") % 7_000).alias("g"), "id").crossJoin(F.broadcast(replies.drop("uid").limit(1)))
    for by, rows in (("g", many), ("g", many.withColumn("g", F.lit(None).cast("long")).limit(5))):
        done = managers.manage("batch", rows, places, by=by)
        assert "InPandas" not in done._jdf.queryExecution().toString()  # no frame for each group
        got = done.groupBy("g").agg(F.count("id").alias("n"), F.max("reward").alias("r"), F.max(F.col("extras")["of"]).alias("o")).collect()
        assert done.columns == [*rows.columns, "place", "reward", "extras", "acc"] and sum(r.n for r in got) == rows.count()
        assert all(r.r == r.n - 1 and r.o == r.n for r in got)


def test_token_rewards(spark):
    tokens = F.array(*[F.lit("x")] * 4)
    assert one(spark, managers.token_rewards(F.lit(2.0), F.lit(1), tokens), managers.token_rewards(F.lit(2.0), F.lit(-1), tokens)) == ([0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0, 2.0])


# classes by path ------------------------------------------------------------------------------

SOURCE = '''
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

class Squares(DataSource):
    @classmethod
    def name(cls):
        return "squares"
    def schema(self):
        return "n int, square int"
    def reader(self, schema):
        return Reader(int(self.options["upto"]))

class Reader(DataSourceReader):
    def __init__(self, upto):
        self.upto = upto
    def partitions(self):
        return [InputPartition(i) for i in range(2)]
    def read(self, partition):
        for n in range(partition.value, self.upto, 2):
            yield n, n * n

class Other:
    pass
'''


def test_dataset_class_of_a_file(spark, tmp_path):
    path = tmp_path / "squares.py"
    path.write_text(SOURCE)
    df = U.read_dataset(spark, str(path), "Squares", upto="5")
    assert df.dtypes == [("n", "int"), ("square", "int")] and sorted(map(tuple, df.collect())) == [(n, n * n) for n in range(5)] and df.rdd.getNumPartitions() == 2
    with pytest.raises(FileNotFoundError):
        U.load_class(str(tmp_path / "none.py"), "Squares", object)
    with pytest.raises(AttributeError, match="has no Cubes"):
        U.load_class(str(path), "Cubes", object)
    with pytest.raises(TypeError, match="must inherit from DataSource"):
        U.read_dataset(spark, str(path), "Other")
    (tmp_path / "bad.py").write_text("1 +")
    with pytest.raises(RuntimeError, match="cannot load"):
        U.load_class(str(tmp_path / "bad.py"), "X", object)


def test_dataset_class_as_a_resumed_stream(spark, tmp_path):
    rows = spark.range(60).selectExpr("id", "id * 2 as twice")
    rows.coalesce(1).write.option("parquet.block.row.count.limit", "10").parquet(str(tmp_path / "t"))
    plain = sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect()))
    plugin = str(PLUGINS / "row_groups.py")
    assert sorted(map(tuple, U.read_dataset(spark, plugin, "RowGroups", path=str(tmp_path / "t")).collect())) == plain

    def run():
        q = U.stream_dataset(spark, plugin, "RowGroups", path=str(tmp_path / "t")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        q.stop()

    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == plain
    run()  # what is read is not read again
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(plain)


def test_sampler_stops_and_resumes(spark, tmp_path):
    data = spark.range(101).withColumnRenamed("id", "k")
    order = lambda frames: [r.k for f in frames for r in f.orderBy("epoch", "rn").collect()]
    whole = U.Shuffled(data, "k", 3)
    want = order([whole.take(101), whole.take(40)])
    assert sorted(want[:101]) == list(range(101)) and want[:40] != want[101:]
    first = U.make_sampler(data, "k", 3)
    got = order([first.take(30)])
    U.save_state(spark, first.state(), str(tmp_path / "state"))
    again = U.make_sampler(data, "k", 3)
    again.restore(U.load_state(spark, str(tmp_path / "state")))
    assert got + order([again.take(50), again.take(50), again.take(40)]) == want
    assert order([U.make_sampler(data, "k", shuffle=False).take(5)]) == [0, 1, 2, 3, 4]
    assert U.Sequential(data.limit(0), "k").take(5).collect() == []
    with pytest.raises(TypeError, match="must inherit from Sampler"):
        U.make_sampler(data, "k", path=str(PLUGINS / "grading.py"), name="Grading")


def test_tools_of_a_file(spark, tmp_path):
    tools = U.load_tools(str(PLUGINS / "tools.yaml"))
    assert list(tools) == ["grade"] and tools["grade"].config == {"penalty": -0.05}
    calls = [(1, 1, "10", "grade", '{"answer": 5}'), (1, 2, "10", "grade", '{"answer": 5}'), (1, 3, "10", "grade", '{"answer": 9}'), (1, 4, "10", "none", "{}"), (1, 5, "10", "grade", "{"), (2, 1, "0", "grade", '{"answer": 1}'), (3, 1, "8", "grade", '{"answer": "x"}')]
    got = {(r.instance, r.pos): (r.reply, r.reward) for r in U.run_tools(spark.createDataFrame(calls, "instance int, pos int, truth string, tool string, parameters string"), tools).collect()}
    assert got[1, 1] == ("worth 0.500", 0.0) and got[1, 2] == ("worth 0.500", -0.05) and got[1, 3] == ("worth 0.900", 0.0)
    assert got[1, 4] == ("Tool none not found in tools list", 0.0) and got[2, 1][1] == got[1, 5][1] == 0.0 and "division" in got[2, 1][0]
    assert "could not convert" in got[3, 1][0]
    two = tmp_path / "two.yaml"
    (tmp_path / "grading.py").write_text((PLUGINS / "grading.py").read_text())
    two.write_text("tools:\n" + "  - {class_name: 'grading.py:Grading', config: {penalty: 0}}\n" * 2)
    with pytest.raises(ValueError, match="two tools of the name Grading"):
        U.load_tools(str(two))


def test_tools_keep_instances_apart_in_one_pass(spark):
    class Own(U.Tool):
        def create(self, truth):
            self.seen = getattr(self, "seen", 0) + 1  # on the tool itself
            self.config["n"] = self.config.get("n", 0) + 1
            return 0

        def execute(self, state, parameters):
            return state + 1, f"{self.seen} {self.config['n']} {state}", 0.0

    calls = spark.range(60_000).select((F.col("id") % 20_000).alias("instance"), F.floor(F.col("id") / 20_000).alias("pos"), F.lit("1").alias("truth"), F.lit("own").alias("tool"), F.lit("{}").alias("parameters"))
    done = U.run_tools(calls, {"own": Own({}, None)})
    assert {(r.pos, r.reply) for r in done.select("pos", "reply").distinct().collect()} == {(i, f"1 1 {i}") for i in range(3)} and done.count() == 60_000
    assert "InPandas" not in done._jdf.queryExecution().toString()  # no frame for each instance
    one = U.run_tools(calls.withColumn("instance", F.lit(7)).withColumn("pos", F.col("pos") * 20_000 + F.monotonically_increasing_id()), {"own": Own({}, None)})
    assert one.agg(F.max(F.substring_index("reply", " ", -1).cast("int"))).first()[0] == 59_999  # over batches


# tables and files -----------------------------------------------------------------------------


def test_generations_grow_and_repeat(spark, tmp_path):
    to = f"file://{tmp_path}/gen"
    sample = lambda *rows: spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "nth int, input string, output string, score double")
    assert files.generations_table(spark, to).count() == 0
    assert files.log_generations(sample(("a", "b", 1.0)), 1, to) == 1
    assert files.log_generations(sample(("c", "d", 2.0), ("e", "f", 3.0)), 2, to) == 2
    wide = {r.step: tuple(r)[1:] for r in files.generations_table(spark, to).collect()}
    assert wide == {1: ("a", "b", 1.0, None, None, None), 2: ("c", "d", 2.0, "e", "f", 3.0)}
    assert files.log_generations(sample(("g", "h", 4.0)), 2, to) == 3
    assert {r.step: tuple(r)[1:] for r in files.generations_table(spark, to).collect()} == {1: ("a", "b", 1.0), 2: ("g", "h", 4.0)}
    assert files.read_generations(spark, to, version=2).count() == 3 and len(files.generations_table(spark, to, version=2).columns) == 7


def test_frames_in_number_order(spark, tmp_path):
    for video, names in {"v1": ["f_2.jpg", "f_10.jpg", "f_1.jpg"], "v_2": ["a_b_3.png"]}.items():
        (tmp_path / video).mkdir()
        for n in names:
            (tmp_path / video / n).write_bytes(b"x")
    frames = files.read_frames(spark, str(tmp_path))
    lists = {r.video: [p.rsplit("/", 1)[1] for p in r.paths] for r in files.frame_lists(frames).collect()}
    assert lists == {"v1": ["f_1.jpg", "f_2.jpg", "f_10.jpg"], "v_2": ["a_b_3.png"]}
    (tmp_path / "v1" / "cover.jpg").write_bytes(b"x")
    with pytest.raises(Exception, match="no frame number in"):
        files.frame_lists(files.read_frames(spark, str(tmp_path))).collect()


def test_whole_batches(spark, tmp_path):
    to = f"file://{tmp_path}/batch"
    files.save_batch(spark.range(3), {"a": [1, {"b": "é"}]}, to)
    rows, meta = files.load_batch(spark, to)
    assert rows.count() == 3 and meta == {"a": [1, {"b": "é"}]}


# videos ---------------------------------------------------------------------------------------

QUESTION = "id int, text string, solution string, video string, image string, duration double, video_kwargs string, tool_params string, answer string"


def test_options_in_layers(spark):
    layers = W.overlaid(W.options({"a": 1, "b": "x", "c": 2.5}), W.options({"b": 7}), W.parsed_options(F.lit('{"c": [1, 2], "d": true}')), W.parsed_options(F.lit(None).cast("string")))
    got = one(spark, F.to_json(layers))[0]
    assert json.loads(got) == {"a": 1, "b": 7, "c": [1, 2], "d": True}
    assert one(spark, W.option(layers, "a", "bigint"), W.option(layers, "b", "string"), W.option(layers, "z", "string")) == (1, "7", None)
    with pytest.raises(Exception, match="options must be an object"):
        one(spark, W.parsed_options(F.lit("[1]")))


@pytest.mark.parametrize(
    ("row", "why"),
    [
        ((1, "q", '["a"]', "v", None, 9.0, None, "(1, 2)", "x"), "only two rounds"), ((1, "q", '["a", "b", "c"]', "v", None, 9.0, None, "(1, 2)", "x"), "only two rounds"), ((1, "q", '["a", "b"]', None, "i", 9.0, None, "(1, 2)", "x"), "needs a video"),
        ((1, "q", '["a", "b"]', "v", None, 9.0, None, None, "x"), "the range of its clip"), ((1, "q", '["a", "b"]', "v", None, 9.0, None, "(1, 2)", None), "needs an answer"), ((1, "q", "3", "v", None, 9.0, None, None, "x"), "a string or a list"), ((1, "q", '"a"', None, None, 9.0, None, None, "x"), "neither a video nor an image"),
    ],
)
def test_records_refuse(spark, row, why):
    with pytest.raises(Exception, match=why):
        W.sft_records(spark.createDataFrame([row], QUESTION), "{input_text}", "s").collect()


def test_clip_of_a_second_turn(spark):
    row = (1, "q", '["call", "done"]', "v.mp4", None, 9.126, '{"max_frames": 8, "fps": 1}', "(-1.5, 20)", "x")
    out = W.sft_records(spark.createDataFrame([row], QUESTION), "Long {duration}: {input_text}", "s", "/m/").select("*", F.to_json("media").alias("j")).first()
    assert [m.role for m in out.messages] == ["system", "user", "assistant", "tool", "assistant"] and out.messages[1].content[1].text == "Long 9.13: q" and out.messages[3].content[1].text == "Video clip from -1.50 to 20.00 seconds."
    first, second = json.loads(out.j)
    assert first["max_frames"] == 8 and second["max_frames"] == 64 and second["fps"] == 1 and (second["video_start"], second["video_end"]) == (-1.5, 20.0) and second["path"] == "/m/v.mp4"


def test_sizes_refuse(spark):
    n = lambda *x: [F.lit(v) for v in x]
    size = lambda h, w, **k: tuple(one(spark, *N.smart_size(*n(h, w), **k)))
    assert size(28, 28, least=1) == (28, 28) and size(1, 1) == (56, 56) and size(42, 70, least=1) == (56, 56) and size(14, 2800, least=1, most=10**6) == (28, 2800)
    assert size(10_000, 10_000) == (3556, 3556) and size(9_999, 4_321) == (5432, 2352) and size(3584, 3584) == (3584, 3584)
    with pytest.raises(Exception, match="ratio of the sides must be at most 200"):
        size(1, 201)
    count = lambda total, rate, **k: one(spark, N.frame_count(*n(total), F.lit(float(rate)), **k))[0]
    assert count(100, 25) == 8 and count(100, 1) == 100 and count(3, 30) == 2 and count(10_000, 1) == 768 and count(100, 25, frames=7) == 8 and count(100, 25, frames=5) == 4
    for bad in ({"frames": 0}, {"frames": 200}, {"frames": 1}):
        with pytest.raises(Exception, match="must be from 2 to 100"):
            count(100, 25, **bad)
    with pytest.raises(Exception, match="must be from 2 to 1"):
        count(1, 25)
    with pytest.raises(ValueError):
        N.frame_count(F.lit(1), F.lit(1.0), fps=1.0, frames=2)
    clip = lambda s, e, rate=2.0, total=10: tuple(one(spark, *N.clip_frames(F.lit(s).cast("double"), F.lit(e).cast("double"), rate, F.lit(total))))
    assert clip(None, None) == (0, 9, 10) and clip(1.1, None) == (3, 9, 7) and clip(None, 2.3) == (0, 4, 5) and clip(-3, 99) == (0, 9, 10)
    for bad in ((3, 3), (4, 1), (5, None), (1, 2, 0.0), (None, None, 2.0, 0)):
        with pytest.raises(Exception, match="must begin before it ends"):
            clip(*bad)


# records, losses, search ----------------------------------------------------------------------


def test_call_arguments(spark):
    raw = ['{"a": 1}', "{}", "[1]", "1", "", "{", '{"a": 1} x', '{}],[{}', '{}},{', None]
    df = spark.createDataFrame([(x,) for x in raw], "r string")
    args, bad = R.call_arguments(F.col("r"))
    assert [(r.n, r.bad) for r in df.select(F.size(args).alias("n"), bad.alias("bad")).collect()] == [(1, False), (0, False)] + [(0, True)] * 8


def test_seeded_split(spark):
    df = spark.range(37).withColumnRenamed("id", "k")
    rows = R.split_at(df, 0.9, 42, "k").collect()
    assert sum(r.split == "train" for r in rows) == 33 and sorted(r["index"] for r in rows if r.split == "test") == [0, 1, 2, 3]
    assert {r.k for r in rows if r.split == "test"} != {r.k for r in R.split_at(df, 0.9, 1, "k").where("split = 'test'").collect()}
    assert R.split_at(df.limit(0), 0.9, 42, "k").count() == 0


def test_batch_losses(spark):
    rows = spark.createDataFrame([(1, 0.5, -1.0, -2.0, 1), (1, 0.5, -1.0, -1.0, 0), (2, 1.0, 0.0, -3.0, 1)], "uid int, reward double, old_lp double, new_lp double, mask int")
    got = L.kl_penalised(rows, 0.1, target=1.0, horizon=10.0).orderBy("uid", "new_lp").collect()
    assert [round(r.penalised, 6) for r in got] == [0.4, 0.5, 0.7] and {round(r.batch_kl, 6) for r in got} == {2.0} and {round(r.next_beta, 6) for r in got} == {round(0.1 * (1 + 0.2 * 2 / 10), 6)}
    assert L.kl_penalised(rows, 0.1).first().next_beta == 0.1
    p = lambda **k: round(one(spark, L.pair_loss(F.lit(-1.0), F.lit(-3.0), F.lit(-2.0), F.lit(-2.5), 0.1, **k))[0], 6)
    assert p(reference_free=True) < p() and p(smoothing=0.5) > p() and p(kind="ipo") == (1.5 - 5) ** 2
    lp = lambda labels, average=False: one(spark, L.sequence_logp(F.array(*[F.lit(-float(i)) for i in range(len(labels))]), F.array(*map(F.lit, labels)), average))[0]
    assert lp([1, 2, 3]) == -3.0 and lp([1, -100, 3]) == -2.0 and lp([1, 2, 3], True) == -1.5 and lp([-100, -100], True) == 0.0 and lp([5]) == 0.0


def test_search_records(spark):
    made = lambda error, results: one(spark, *S.search_record(F.array(F.lit("q"), F.lit("r")), error, results).values())
    none, kind = F.lit(None).cast("string"), "array<array<string>>"
    assert made(F.lit("x"), F.lit(None).cast(kind)) == (2, "api_error", 0, None, '{"result":"Search error: x"}')
    assert made(none, F.lit(None).cast(kind))[1] == "unknown_api_state" and made(none, F.array().cast(kind))[1:4] == ("no_results", 0, None)
    good = made(none, F.array(F.array(F.lit("T\nbody\nmore"), F.lit("U")), F.array().cast("array<string>")))
    assert good[1:4] == ("success", 2, "Doc 1 (Title: T)\nbody\nmore\n\nDoc 2 (Title: U)\n---\n") and json.loads(good[4])["result"] == good[3]
    assert one(spark, S.prefixed("a-E5-bge", F.lit("t")), S.prefixed("e5", F.lit("t"), False), S.prefixed("x", F.lit("t"))) == ("Represent this sentence for searching relevant passages: query: t", "passage: t", "t")
    lists = spark.createDataFrame([(1, [3, 1, 3])], "q int, ids array<int>")
    docs = spark.createDataFrame([(1, "a"), (3, "c")], "doc_id int, text string")
    assert [r.text for r in S.documents_of(lists, docs, "q", "ids", "doc_id", ["text"]).first().found] == ["c", "a", "c"]
    with pytest.raises(Exception, match="no document 9"):
        S.documents_of(spark.createDataFrame([(1, [9])], "q int, ids array<int>"), docs, "q", "ids", "doc_id", ["text"]).collect()
    for how in ("pooler", "sum"):
        with pytest.raises((ValueError, NotImplementedError)):
            S.pooled(lists, how, "e5")
