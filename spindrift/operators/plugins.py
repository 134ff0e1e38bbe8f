"""Datasets, samplers and tools as classes of source files: loaded by path and name, checked, and run on Spark."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from spindrift.operators.batch import numbered


def load_class(path: str, name: str, base: type) -> type:
    """Class ``name`` of a source file. The driver reads the file; the class goes to the executors by value, so they need no copy."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    space: dict = {"__name__": f"plugin_{Path(path).stem}", "__file__": path}
    try:
        exec(compile(Path(path).read_text(), path, "exec"), space)
    except Exception as e:
        raise RuntimeError(f"cannot load {path}: {e}") from e
    if name not in space:
        raise AttributeError(f"{path} has no {name}")
    if not (isinstance(space[name], type) and issubclass(space[name], base)):
        raise TypeError(f"{name} of {path} must inherit from {base.__name__}")
    return space[name]


def register_dataset(spark: SparkSession, source: str, name: str) -> str:
    """Make a data source class known to Spark; its format's name."""
    cls = load_class(source, name, DataSource)
    spark.dataSource.register(cls)
    return cls.name()


def read_dataset(spark: SparkSession, source: str, name: str, **options: str) -> DataFrame:
    """The rows of a data source class: its schema, one task for each of its partitions."""
    return spark.read.format(register_dataset(spark, source, name)).options(**options).load()


def stream_dataset(spark: SparkSession, source: str, name: str, **options: str) -> DataFrame:
    """The same as a stream, from where the query's checkpoint left its offsets."""
    return spark.readStream.format(register_dataset(spark, source, name)).options(**options).load()


class Sampler:
    """Order of a table in epochs, given out in slices; all that it is is its state, so it can be stopped and resumed.

    A class of one's own gives ``order``: the key of a row in an epoch. Ties go by the id.
    """

    def __init__(self, data: DataFrame, id_col: str, seed: int = 1):
        self.data, self.id_col, self.seed, self.epoch, self.position = data, id_col, seed, 0, 0
        self._size: int | None = None
        self._numbered: tuple[int, DataFrame] | None = None

    def order(self, epoch: int) -> Column:
        raise NotImplementedError

    def size(self) -> int:
        if self._size is None:
            self._size = self.data.count()
        return self._size

    def ordered(self) -> DataFrame:
        """The table with ``rn``, its places in the open epoch."""
        if self._numbered is None or self._numbered[0] != self.epoch:
            self._numbered = (self.epoch, numbered(self.data.withColumn("_key", self.order(self.epoch)), "_key", self.id_col).drop("_key"))
        return self._numbered[1]

    def take(self, n: int) -> DataFrame:
        """The next ``n`` rows of the epoch with their places, fewer at its end; then the next epoch begins."""
        first = self.position
        out = self.ordered().where((F.col("rn") >= first) & (F.col("rn") < first + n)).withColumn("epoch", F.lit(self.epoch))
        self.position += n
        if self.position >= self.size():
            self.epoch, self.position = self.epoch + 1, 0
        return out

    def state(self) -> dict:
        return {"seed": self.seed, "epoch": self.epoch, "position": self.position}

    def restore(self, state: dict) -> None:
        self.seed, self.epoch, self.position = state["seed"], state["epoch"], state["position"]
        self._numbered = None


class Shuffled(Sampler):
    """Another order each epoch."""

    def order(self, epoch: int) -> Column:
        return F.xxhash64(F.col(self.id_col), F.lit(self.seed), F.lit(epoch))


class Sequential(Sampler):
    """By id."""

    def order(self, epoch: int) -> Column:
        return F.col(self.id_col)


def make_sampler(data: DataFrame, id_col: str, seed: int = 1, shuffle: bool = True, path: str | None = None, name: str | None = None) -> Sampler:
    """The class of a source file if a path is given, else shuffled or sequential."""
    cls = load_class(path, name or "", Sampler) if path else Shuffled if shuffle else Sequential
    return cls(data, id_col, seed)


def save_state(spark: SparkSession, state: dict, folder: str) -> None:
    """One row of JSON in the shared folder, in place of the last."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load_state(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first().value)


class Tool:
    """A tool of a conversation: ``create``, ``execute`` and ``release`` an instance. ``config`` and ``schema`` come from the file."""

    def __init__(self, config: dict, schema: dict | None):
        self.config, self.schema = config, schema

    def name(self) -> str:
        return (self.schema or {}).get("function", {}).get("name", type(self).__name__)

    def create(self, truth):
        """The state of a new instance."""
        return None

    def execute(self, state, parameters: dict) -> tuple:
        """(state, reply, reward) of a call."""
        raise NotImplementedError

    def release(self, state) -> None:
        """The end of an instance."""


def load_tools(path: str) -> dict[str, Tool]:
    """The tools of a YAML file: a list ``tools`` of class_name (file.py:Class, beside the file), config and tool_schema."""
    import yaml

    out: dict[str, Tool] = {}
    for t in yaml.safe_load(Path(path).read_text())["tools"]:
        file, _, name = t["class_name"].rpartition(":")
        tool = load_class(str(Path(path).parent / file), name, Tool)(t.get("config") or {}, t.get("tool_schema"))
        if tool.name() in out:
            raise ValueError(f"two tools of the name {tool.name()}")
        out[tool.name()] = tool
    return out


def run_tools(calls: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """(instance, pos, reply, reward) of logged calls (instance, pos, truth, tool, parameters as JSON): an instance's calls in order, its own state for each tool.

    A call of an unknown tool, of bad JSON, or one that fails is answered by its error and costs nothing.
    """
    held = cloudpickle.dumps(tools)
    fields = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    names = ["instance", "pos", "truth", "tool", "parameters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted calls, an instance at a time; one may go on over batches."""
        fresh, own, states, now = cloudpickle.loads(held), {}, {}, []

        def end() -> None:
            for t, s in states.items():
                own[t].release(s)

        for batch in batches:
            replies, rewards = [], []
            for instance, tool, truth, parameters in zip(*(batch.column(c).to_pylist() for c in ("instance", "tool", "truth", "parameters")), strict=True):
                if now != [instance]:
                    end()
                    own, states, now = {}, {}, [instance]
                try:
                    if tool not in fresh:
                        raise KeyError(f"Tool {tool} not found in tools list")
                    if tool not in own:
                        own[tool] = copy.deepcopy(fresh[tool])  # what an instance does to its tool stays with it
                    if tool not in states:
                        states[tool] = own[tool].create(truth)
                    states[tool], reply, reward = own[tool].execute(states[tool], json.loads(parameters))
                except Exception as e:  # by contract a failing tool answers with its error
                    reply, reward = str(e.args[0] if e.args else e), 0.0
                replies.append(str(reply))
                rewards.append(float(reward))
            yield pa.RecordBatch.from_arrays([batch.column("instance"), batch.column("pos"), pa.array(replies, pa.string()), pa.array(rewards, pa.float64())], names=["instance", "pos", "reply", "reward"])
        end()

    dealt = calls.select(*names).repartition("instance").sortWithinPartitions("instance", F.col("pos").asc_nulls_last())
    return dealt.mapInArrow(run, f"instance {fields['instance']}, pos {fields['pos']}, reply string, reward double")
