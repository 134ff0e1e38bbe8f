"""Readers and writers of records, predictions and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.batch import numbered

#: Fixed schema of a prediction.
PREDICTION = "id string, repeat_id int, question string, answer string, pred string, text string, question_type array<string>, meta_info map<string,double>"


def read_parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, *paths: str, schema: str = PREDICTION, strict: bool = False) -> DataFrame:
    """One object a line; a bad line is an error if ``strict``, else kept in _corrupt_record."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.schema(schema if strict else schema + ", _corrupt_record string").json(list(paths))


def chunk_paths(folder: str, n: int) -> list[str]:
    """Files of a run in n chunks; chunks of another n are not among them."""
    return [f"{folder}/pred.json"] if n == 1 else [f"{folder}/{n}_{i}.json" for i in range(n)]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus of {contents}; doc_id is the line's position, files by name and blank lines left out, from 0.

    A file is read in splits; a line's key is its file, its split's first byte and its order within the task.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    contents = F.from_json("value", "contents string")["contents"]
    keyed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), contents.alias("contents"))
    return numbered(keyed, "file", "start", "nth", name="doc_id").select("doc_id", "contents")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame files below a folder (path, video, frame): a video is a folder, its frames are numbered after the last underscore.

    A file without such a number has a null frame.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return listed.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), F.regexp_extract("path", r"_(\d+)\.[^./]*$", 1).try_cast("long").alias("frame"))


def frame_lists(frames: DataFrame) -> DataFrame:
    """(video, paths) with the paths in the order of their numbers; a file without a number is an error."""
    number = F.coalesce("frame", F.raise_error(F.concat(F.lit("no frame number in "), F.col("path"))).cast("long"))
    return frames.groupBy("video").agg(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), "path"))), lambda x: x["path"]).alias("paths"))


def append_jsonl(new: DataFrame, path: str, done: DataFrame | None = None, key: str = "id") -> None:
    """Append predictions whose key is not yet written."""
    fresh = new if done is None else new.join(done.select(key), key, "left_anti")
    fresh.write.mode("append").json(path)


def console_line(step: str, metrics: list[str]) -> F.Column:
    """'step:N - key:val - ...' with three decimals."""
    parts = [F.format_string(f"{m}:%.3f", F.col(m).cast("double")) for m in metrics]
    return F.concat_ws(" - ", F.concat(F.lit("step:"), F.col(step).cast("string")), *parts)


def parse_console(line: F.Column, metric: str) -> F.Column:
    """The value of a metric in such a line."""
    return F.try_element_at(F.str_to_map(line, F.lit(" - "), F.lit(":")), F.lit(metric)).try_cast("double")


def write_rollouts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("step").json(path)


def dump_rollouts(samples: DataFrame, path: str, extras: dict[str, F.Column] | None = None) -> None:
    """(step, input, output, score) to a folder of JSON lines a step, each line with its step.

    An extra column counts only if every sample of its step has it, as a list of another length than the samples would not.
    """
    extras = extras or {}
    wide = samples.select("step", "input", "output", "score", *[c.alias(k) for k, c in extras.items()])
    if extras:
        have = wide.groupBy(F.col("step").alias("_s")).agg(*[F.bool_and(F.col(k).isNotNull()).alias(f"_{k}") for k in extras])
        wide = wide.join(have, F.col("step") == F.col("_s")).select("step", "input", "output", "score", *[F.when(F.col(f"_{k}"), F.col(k)).alias(k) for k in extras])
    wide.withColumn("folder", F.col("step")).write.mode("overwrite").partitionBy("folder").json(path)


#: What a generations table has for each sample of a step.
SAMPLE = ("input", "output", "score")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _place(spark, folder)
    if not fs.exists(at):
        return []
    found = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in found if n.startswith("manifest-") and n.endswith(".json"))


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(latest version, step to its part and its number of samples); version 0 is an empty table."""
    version = max(_versions(spark, folder), default=0)
    if not version:
        return 0, {}
    return version, json.loads(spark.read.text(f"{folder}/manifest-{version}.json", wholetext=True).first().value)


def log_generations(samples: DataFrame, step: int, folder: str, tries: int = 20) -> int:
    """Put a step's samples (nth, input, output, score) into the table of a folder; a step that is logged again is replaced.

    The rows are written first; then a manifest of the next version names them, made by a create that fails if it is
    there, so that of two writers one begins again and no reader sees half a step. The version is returned.
    """
    spark = samples.sparkSession
    part = f"step-{step}-{uuid.uuid4().hex}"
    samples.select("nth", *SAMPLE).write.parquet(f"{folder}/{part}")
    most = spark.read.parquet(f"{folder}/{part}").agg(F.max("nth")).first()[0]
    for _ in range(tries):
        version, steps = _manifest(spark, folder)
        steps[str(step)] = {"part": part, "samples": int(most or 0)}
        fs, at = _place(spark, f"{folder}/manifest-{version + 1}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:  # another writer was first
            if "already exists" not in str(e):
                raise
            continue
        stream.write(bytearray(json.dumps(steps).encode()))
        stream.close()
        return version + 1
    raise RuntimeError(f"the table {folder} has too many writers")


def read_generations(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as rows (step, nth, input, output, score), of the latest version or an earlier one."""
    steps = _manifest(spark, folder)[1] if version is None else json.loads(spark.read.text(f"{folder}/manifest-{version}.json", wholetext=True).first().value)
    if not steps:
        return spark.createDataFrame([], "step int, nth bigint, input string, output string, score double")
    paths = [f"{folder}/{x['part']}" for x in steps.values()]
    step = F.regexp_extract(F.col("_metadata.file_path"), r"/step-(\d+)-[0-9a-f]+/[^/]*$", 1).cast("int")
    return spark.read.parquet(*paths).select(step.alias("step"), F.col("nth").cast("bigint").alias("nth"), "input", "output", F.col("score").cast("double").alias("score"))


def generations_table(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One wide row a step: step, input_1, output_1, score_1, input_2, ...; columns grow with the most samples of a step, earlier rows have nulls."""
    long = read_generations(spark, folder, version)
    most = max((x["samples"] for x in _manifest(spark, folder)[1].values()), default=0) if version is None else long.agg(F.max("nth")).first()[0] or 0
    cells = [F.max(F.when(F.col("nth") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, most + 1) for c in SAMPLE]
    return long.groupBy("step").agg(*cells) if cells else long.select("step").distinct()


def save_batch(df: DataFrame, meta: dict, path: str) -> None:
    """A whole batch: its rows, and its metadata as JSON beside them."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    fs, at = _place(spark, f"{path}/meta.json")
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps(meta).encode()))
    stream.close()


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first().value)


def tracker(step: str, metrics: list[str], path: str | None = None, backends: tuple[str, ...] = ("console", "table"), out: Callable[[str], None] = print) -> Callable[..., None]:
    """A function of (rows, batch number) that sends metrics to each back-end; fit for ``foreachBatch``.

    console: one line a step, in order of the steps. table: (step, metric, value) in a folder a batch under
    ``path``, so a batch that is run again replaces its rows.
    """
    if unknown := set(backends) - {"console", "table"}:
        raise ValueError(f"unknown back-ends {sorted(unknown)}")
    if "table" in backends and not path:
        raise ValueError("a table needs a path")

    def log(rows: DataFrame, batch: int = 0) -> None:
        if "table" in backends:
            pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
            rows.select(F.col(step).alias("step"), F.explode(pairs).alias("p")).select("step", "p.*").write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if "console" in backends:
            for row in rows.orderBy(step).select(console_line(step, metrics)).toLocalIterator():
                out(row[0])

    return log


#: Fixed value: the file that names the latest iteration.
MARKER = "latest_checkpointed_iteration.txt"


def _place(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def mark_iteration(spark: SparkSession, folder: str, iteration: int) -> None:
    fs, at = _place(spark, f"{folder}/{MARKER}")
    stream = fs.create(at, True)
    stream.writeBytes(str(iteration))
    stream.close()


def latest_checkpoint(spark: SparkSession, folder: str | None, form: str = "global_step_{}") -> str | None:
    """Folder of the marked iteration; None without a folder, a marker, or the folder that it names."""
    if folder is None:
        return None
    fs, at = _place(spark, f"{folder}/{MARKER}")
    if not fs.exists(at):
        return None
    path = f"{folder}/{form.format(int(spark.read.text(f'{folder}/{MARKER}').first().value))}"
    return path if fs.exists(_place(spark, path)[1]) else None


def write_report(long: DataFrame, path: str) -> None:
    """name, value lines with six decimals."""
    long.select(F.concat_ws(", ", "name", F.format_string("%.6f", F.coalesce("value", F.lit(0.0))))).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str) -> None:
    """(id, fields as a map of strings) to one object {id: fields} a line."""
    df.select(F.to_json(F.create_map("id", "fields"))).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Those lines as (id, fields)."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("id", "fields"))


def cached(df: DataFrame) -> DataFrame:
    """Kept in the executors' memory, on their disks beyond it; ``unpersist`` frees it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
