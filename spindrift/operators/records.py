"""Shaping of training records: tools, options, test cases, counted letters, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from spindrift.functions import text as T
from spindrift.operators import batch as B

#: Fixed value: the block that names the tools of a system prompt.
TOOL_BLOCK = (
    "\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>\n",
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>\n',
)
#: Fixed value: a test case.
CASES = "array<struct<input:string,output:string>>"


def with_tool(extra: Column, truth: Column, tool: str) -> Column:
    """The struct with what a tool needs to be set up for the row; its other fields stay."""
    kwargs = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))
    return extra.withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", kwargs)


def system_prompt(base: str, schemas: Column) -> Column:
    """The base text, and after a line break the block of tools if there is a schema that is not empty."""
    listed = F.array_join(schemas, "\n")
    return F.when(F.coalesce(listed, F.lit("")) != "", F.concat(F.lit(base + "\n" + TOOL_BLOCK[0]), listed, F.lit(TOOL_BLOCK[1]))).otherwise(base)


def options(wrong: Column, right: Column, key: Column, seed: int) -> tuple[Column, Column]:
    """(options, letter of the right one): the wrong ones in an order and the right one at a place drawn by the key."""
    drawn = F.array_sort(F.transform(wrong, lambda w, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), w.alias("w"))))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.size(wrong) + 1).cast("int")
    return F.array_insert(F.transform(drawn, lambda x: x["w"]), place + 1, right), F.char(F.lit(65) + place)


def test_cases(public: Column, private: Column, metadata: Column) -> Column:
    """JSON of inputs, outputs and fn_name of the public cases and then the private ones, both JSON lists.

    A list that is no JSON gives no cases: packed Python objects are never loaded.
    """
    both = F.concat(*[F.coalesce(F.from_json(c, CASES), F.array().cast(CASES)) for c in (public, private)])
    whole = lambda cs: F.struct(F.transform(cs, lambda c: c["input"]).alias("inputs"), F.transform(cs, lambda c: c["output"]).alias("outputs"), F.get_json_object(metadata, "$.func_name").alias("fn_name"))
    return F.to_json(T.once(both, whole), {"ignoreNullFields": "false"})


#: The prompt of a code contest, with starter code and without.
CONTEST = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\nQuestion: {question}\n\n"
STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n{starter}\n```"
STDIN = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. "
    "Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.```python\n# YOUR CODE HERE\n```"
)


def contest_prompt(question: Column, starter: Column) -> Column:
    """The prompt of a contest's problem; null or empty starter code makes it a program that reads its input."""
    put = lambda form, name, c: F.replace(F.lit(form), F.lit("{" + name + "}"), c)
    rest = F.when(F.coalesce(starter, F.lit("")) != "", put(STARTER, "starter", starter)).otherwise(STDIN)
    return F.concat(put(CONTEST, "question", question), rest)


def merged(metrics: Column, sample: Column) -> Column:
    """Two maps in one; where both have a key the sample's value stays."""
    return F.map_concat(F.map_filter(metrics, lambda k, _: ~F.array_contains(F.map_keys(sample), k)), sample)


def char_count(spark: SparkSession, total: int, low: int = 3, high: int = 5, seed: int = 42) -> DataFrame:
    """``total`` made-up tasks of counting a letter: id, prompt, response (worked, the answer boxed), split (nine tenths train).

    A word has ``low`` to ``high`` letters joined by hyphens, 1 to all of them the letter asked for. Every draw is a hash
    of the row's id, so a repeated task makes the same rows.
    """
    draw = lambda what, n, *more: F.pmod(F.xxhash64("id", F.lit(f"{seed} {what}"), *more), n).cast("int")
    plan = spark.range(total).withColumns({"size": F.lit(low) + draw("size", F.lit(high - low + 1)), "which": draw("letter", F.lit(26))})
    plan = plan.withColumn("hits", F.lit(1) + draw("hits", F.col("size")))
    other = lambda i: (F.col("which") + 1 + draw("other", F.lit(25), i)) % 26
    place = lambda i: F.struct(F.xxhash64("id", F.lit(f"{seed} order"), i).alias("h"), F.char(F.lit(97) + F.when(i <= F.col("hits"), F.col("which")).otherwise(other(i))).alias("c"))
    letters = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), F.col("size")), place)), lambda x: x["c"])
    tasks = plan.select("id", F.char(F.lit(97) + F.col("which")).alias("asked"), letters.alias("letters"))
    worked = count_letters(tasks.select("id", "asked", "letters"))
    rows = worked.select("id", "prompt", "response", F.xxhash64("id", F.lit(f"{seed} split")).alias("h"))
    split = F.when(F.col("rn") < int(0.9 * total), "train").otherwise("test")
    return B.numbered(rows, "h", "id").select("id", "prompt", "response", split.alias("split"))


def count_letters(tasks: DataFrame) -> DataFrame:
    """Tasks (with ``letters`` and the letter ``asked``) with prompt and worked response: each letter compared, the number boxed."""
    asked, word = F.col("asked"), F.array_join("letters", "-")
    hits = F.size(F.filter("letters", lambda c: c == asked))
    steps = F.transform("letters", lambda c: F.concat(c, F.when(c == asked, " = ").otherwise(" != "), asked, F.lit(".\n")))
    response = F.concat(F.array_join(steps, ""), F.lit("\\boxed{"), hits.cast("string"), F.lit("} "), asked, F.lit(" in "), word, F.lit("."))
    prompt = F.concat(F.lit("How many "), asked, F.lit(" are there in word "), word, F.lit("?"))
    return tasks.select(*[c for c in tasks.columns if c not in ("asked", "letters")], prompt.alias("prompt"), response.alias("response"))


def as_rl(tasks: DataFrame, *keys: str) -> DataFrame:
    """Those tasks as records of reinforcement learning; the truth is the last boxed text of the response."""
    from spindrift.functions.scores import boxed

    turn = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    rule = F.struct(F.lit("rule").alias("style"), boxed("response").alias("ground_truth"))
    return tasks.select(*(keys or ("id", "split")), F.array(turn).alias("prompt"), F.lit("char_count").alias("data_source"), F.lit("other").alias("ability"), rule.alias("reward_model"), F.struct("response").alias("extra_info"))


def digit_prompts(spark: SparkSession, max_number: int, max_diff: int, max_count: int) -> DataFrame:
    """Every prompt 'first,second:max_number,count' of an arithmetic sequence modulo ``max_number``."""
    upto = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n))).alias(name)
    rows = spark.range(max_number + 1).select(F.col("id").alias("first"), upto(max_diff, "diff")).select("*", upto(max_count, "count"))
    second = (F.col("first") + F.col("diff")) % max_number
    return rows.select("first", "diff", "count", F.format_string(f"%d,%d:{max_number},%d", "first", second, "count").alias("prompt"))


def digit_truth(prompt: Column) -> Column:
    """The numbers that continue such a prompt, joined by commas."""
    first, second, top, count = (F.element_at(F.split(prompt, "[,:]"), i).cast("long") for i in range(1, 5))
    step = F.pmod(second - first, top)
    numbers = F.transform(F.sequence(F.lit(1).cast("long"), count), lambda i: F.pmod(second + i * step, top).cast("string"))
    return F.when(count > 0, F.array_join(numbers, ",")).when(count == 0, "")


def digit_rewards(truth: Column, response: Column, total: float = 1.0) -> Column:
    """Reward of each character: an equal share while it continues the truth, 0 from the first one that does not; one share is the end's."""
    same = lambda i: F.substring(truth, i, F.lit(1)) == F.substring(response, i, F.lit(1))
    places = F.when(F.length(truth) > 0, F.sequence(F.lit(1), F.length(truth))).otherwise(F.array().cast("array<int>"))
    reach = F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & same(i), i).otherwise(n))
    share = F.lit(total) / (F.length(truth) + 1)
    each = F.transform(F.sequence(F.lit(1), F.length(response)), lambda i: F.when(i <= reach, share).otherwise(F.lit(0.0)))
    return F.when(F.length(response) > 0, each).otherwise(F.array().cast("array<double>"))


#: The sentence of a template that tells of a video, and the one for an image.
VIDEO_LINE, IMAGE_LINE = "This is a video with duration {duration} seconds.", "This is an image."


def fill_template(template: str, text: Column, duration: Column) -> Column:
    """The template with text and duration; a null duration makes it an image's. Braces in the text stay as they are."""
    seen = F.replace(F.lit(template), F.lit("{duration}"), duration)
    shape = F.when(duration.isNull(), F.lit(template.replace(VIDEO_LINE, IMAGE_LINE))).otherwise(seen)
    return F.replace(shape, F.lit("{input_text}"), text)


def follow(df: DataFrame, column: str, *keys: str) -> Column:
    """The value under nested keys of structs and maps; arrays on the way must have one element, else it is an error."""
    at, kind = F.col(column), df.schema[column].dataType
    for key in keys:
        while isinstance(kind, ArrayType):
            at = F.when(F.size(at) == 1, F.get(at, F.lit(0))).when(at.isNotNull(), F.raise_error(F.lit(f"more or fewer than one element before {key}")))
            kind = kind.elementType
        at, kind = (at[key], kind.valueType) if isinstance(kind, MapType) else (at.getField(key), kind[key].dataType)
    return at


def rl_record(source: str, content: Column, ability: str, style: str, truth: Column, split: Column, index: Column, system: str | None = None, **extra: Column) -> list[Column]:
    """Columns of a record of reinforcement learning: data_source, prompt, ability, reward_model, extra_info (split, index and more)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [turn("system", F.lit(system))] if system else []
    return [
        F.lit(source).alias("data_source"), F.array(*turns, turn("user", content)).alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(split.alias("split"), index.alias("index"), *[c.alias(k) for k, c in extra.items()]).alias("extra_info"),
    ]


def seeded(seed: int, *columns: str) -> Column:
    """A key to order rows by: a digest of the seed and the columns, which any SQL engine can make too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def split_at(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """Rows with ``index`` (from 0 within its part) and ``split``: the first ``int(n * share)`` in a seeded order are train, the others test."""
    rows = B.numbered(df.withColumn("_key", seeded(seed, key)), "_key", key, name="_rn").drop("_key")
    cut = int(df.count() * share)
    test = F.col("_rn") >= cut
    return rows.withColumns({"split": F.when(test, "test").otherwise("train"), "index": F.when(test, F.col("_rn") - cut).otherwise(F.col("_rn"))}).drop("_rn")


def call_arguments(raw: Column) -> tuple[Column, Column]:
    """(arguments of a tool's call as a map of variants, whether they could not be read): what is no JSON object is an empty map and an error."""
    bad = ~F.coalesce(F.schema_of_variant(T.whole_json(raw)).startswith("OBJECT"), F.lit(False))
    return F.when(bad, F.from_json(F.lit("{}"), "map<string,variant>")).otherwise(F.from_json(raw, "map<string,variant>")), bad
