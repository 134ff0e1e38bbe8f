"""Records of video and image questions: options in layers, messages, clips of a second turn."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.arrays import once
from spindrift.operators import records as R

#: Options of a medium: every value keeps the type that it came with.
OPTIONS = "map<string,variant>"
#: Defaults of a video and of an image.
VIDEO, IMAGE = {"min_pixels": 4 * 28 * 28, "max_pixels": 224 * 224, "max_frames": 64}, {"min_pixels": 4 * 28 * 28, "max_pixels": 448 * 448}
PART = f"struct<type:string,text:string,options:{OPTIONS}>"
MESSAGE = f"struct<role:string,content:array<{PART}>>"


def options(values: dict) -> Column:
    """A layer of options from plain values or columns."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("variant"))]
    return F.create_map(*pairs).cast(OPTIONS) if pairs else F.from_json(F.lit("{}"), OPTIONS)


def parsed_options(json: Column) -> Column:
    """A layer of options from a JSON object; null for none, an error for what is no object."""
    bad = F.raise_error(F.concat(F.lit("options must be an object: "), json)).cast(OPTIONS)
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(json.isNotNull(), F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.from_json(json, OPTIONS)).otherwise(bad))


def overlaid(*layers: Column) -> Column:
    """Layers in one map; a later layer's value wins, a null layer is empty."""
    def over(under: Column, top: Column) -> Column:
        return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(top, k)), top)

    return functools.reduce(over, [F.coalesce(x, F.from_json(F.lit("{}"), OPTIONS)) for x in layers])


def option(opts: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(F.try_element_at(opts, F.lit(name)), "$", kind)


def _part(kind: str | Column, text: Column | None = None, opts: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast(OPTIONS) if opts is None else opts).alias("options")).cast(PART)


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content")).cast(MESSAGE)


def _medium(given: dict | None) -> tuple[Column, Column, Column, Column]:
    """(kind, path, options, duration) of a row: a video if it has one, else an image; neither is an error."""
    kind = F.when(F.col("video").isNotNull(), "video").when(F.col("image").isNotNull(), "image").otherwise(F.raise_error(F.lit("neither a video nor an image")))
    path = F.concat(F.lit(given["base"].rstrip("/") + "/") if given and given.get("base") else F.lit(""), F.coalesce("video", "image"))
    video = overlaid(options(VIDEO), options((given or {}).get("kwargs", {})), parsed_options(F.col("video_kwargs")))
    return kind, path, F.when(F.col("video").isNotNull(), video).otherwise(options(IMAGE)), F.when(F.col("video").isNotNull(), F.round("duration", 2))


def rl_records(rows: DataFrame, template: str, system: str, system_without_tools: str, base: str = "", kwargs: dict | None = None, rewards: list[str] | None = None) -> DataFrame:
    """(id, prompt, media, reward_model, extra_info) of rows (id, text, solution, video, image, duration, video_kwargs).

    A video's options are the defaults, then ``kwargs``, then the row's; an image has its own defaults, no tools, no
    options of others and a duration of 0. Durations are rounded to hundredths.
    """
    kind, path, opts, duration = _medium({"base": base, "kwargs": kwargs or {}})
    x = rows.select("*", kind.alias("_kind"), path.alias("_path"), opts.alias("_opts"), duration.alias("_long"))
    video = F.col("_kind") == "video"
    own = overlaid(options({"path": F.col("_path")}), F.col("_opts"))
    text = R.fill_template(template, F.col("text"), F.col("_long").cast("string"))
    prompt = F.array(_message("system", _part("text", F.when(video, system).otherwise(system_without_tools))), _message("user", _part(F.col("_kind"), opts=own), _part("text", text)))
    tools = overlaid(options({"duration": F.coalesce("_long", F.lit(0.0))}), F.when(video, options({"video_path": F.col("_path")})), options(kwargs or {}))
    extra = F.struct(F.lit("train").alias("split"), F.col("solution").alias("answer"), F.col("text").alias("question"), tools.alias("tools_kwargs"), F.array(*map(F.lit, rewards or [])).cast("array<string>").alias("reward_list"))
    return x.select("id", prompt.alias("prompt"), F.array(own).alias("media"), F.struct(F.lit("rule").alias("style"), F.col("solution").alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"))


def sft_records(rows: DataFrame, template: str, system: str, base: str = "", kwargs: dict | None = None) -> DataFrame:
    """(id, messages, media) of rows (id, text, solution, video, image, duration, video_kwargs, tool_params, answer).

    ``solution`` is JSON: a string is one turn; a list is a call, the clip that the tool gives for ``tool_params`` ("(start, end)"
    in seconds), and the answer. A list must have two strings, a video, parameters and an answer, or it is an error.
    """
    kind, path, opts, duration = _medium({"base": base, "kwargs": kwargs or {}})
    said = F.try_parse_json("solution")
    shape = F.schema_of_variant(said)
    x = rows.select("*", kind.alias("_kind"), path.alias("_path"), opts.alias("_opts"), duration.alias("_long"), F.coalesce(shape, F.lit("")).alias("_shape"), F.try_variant_get(said, "$", "string").alias("_one"), F.try_variant_get(said, "$", "array<string>").alias("_two"), F.regexp_extract_all(F.coalesce("tool_params", F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), 1).cast("array<double>").alias("_clip"))
    own = overlaid(options({"path": F.col("_path")}), F.col("_opts"))
    fail = lambda why: F.raise_error(F.lit(why)).cast(f"array<{MESSAGE}>")
    start, end = F.get("_clip", F.lit(0)), F.get("_clip", F.lit(1))
    clip = overlaid(own, options({"video_start": start, "video_end": end, "max_frames": VIDEO["max_frames"]}))
    text = R.fill_template(template, F.col("text"), F.col("_long").cast("string"))
    asked = [_message("system", _part("text", F.lit(system))), _message("user", _part(F.col("_kind"), opts=own), _part("text", text))]
    turn = lambda c: _message("assistant", _part("text", c))
    shown = _message("tool", _part("video", opts=clip), _part("text", F.format_string("Video clip from %.2f to %.2f seconds.", start, end)))
    two = F.array(*asked, turn(F.get("_two", F.lit(0))), shown, turn(F.get("_two", F.lit(1))))
    checked = (
        F.when(F.size("_two") != 2, fail("only two rounds are supported")).when(F.col("_kind") != "video", fail("a list of answers needs a video")).when(F.size("_clip") != 2, fail("a list of answers needs the range of its clip"))
        .when(F.col("answer").isNull(), fail("a list of answers needs an answer")).otherwise(two)
    )
    messages = F.when(F.col("_shape") == "STRING", F.array(*asked, turn(F.col("_one")))).when(F.col("_shape").startswith("ARRAY"), checked).otherwise(fail("a solution is a string or a list"))
    listed = lambda m: F.filter(F.flatten(F.transform(m, lambda t: F.transform(t["content"], lambda p: p["options"]))), lambda o: o.isNotNull())
    return x.select("id", messages.alias("messages")).select("id", "messages", once(F.col("messages"), listed).alias("media"))
