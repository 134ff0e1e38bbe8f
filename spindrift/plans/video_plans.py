"""Video and image records, sizes and frame counts at and beyond their bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import frames as N
from spindrift.operators import records as R
from spindrift.operators import videos as W
from spindrift.plans import views as V
from spindrift.plans.registry import query

_ASK = R.VIDEO_LINE + "\n{input_text}"
_K = {"fps": 2.0, "max_pixels": 40_000}


def questions(spark, d):
    """Videos of every second supplier, images of the others; rows' own options on a third of the lines; two turns on every fourth part's videos."""
    video, s = F.col("l_suppkey") % 2 == 0, lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("v"), s("l_partkey"))
    two = video & (F.col("l_partkey") % 4 == 0)
    return V.predictions(spark, d).select(
        "id", F.concat(F.lit("find {x} "), "l_returnflag").alias("text"), "answer", F.when(video, name).alias("video"), F.when(~video, name).alias("image"), (F.col("ge") + F.col("l_linenumber") * 0.0013).alias("duration"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('{"max_frames": '), s("l_linenumber"), F.lit(', "note": "own", "fps": 1}'))).alias("video_kwargs"),
        F.when(two, F.concat(F.lit('["call", "'), "l_returnflag", F.lit('"]'))).otherwise(F.concat(F.lit('"'), "l_returnflag", F.lit('"'))).alias("solution"), F.when(two, F.format_string("(%s, %s)", s("gs"), s("ge"))).alias("tool_params"),
    )


_Q = "WITH q AS (SELECT id, l_suppkey % 2 = 0 AS video, l_suppkey % 2 = 0 AND l_partkey % 4 = 0 AS two, l_linenumber % 3 = 0 AS own, l_linenumber, l_returnflag, gs, ge, answer, '/media/v' || l_partkey AS path, CASE WHEN l_suppkey % 2 = 0 THEN 'This is a video with duration ' || round(ge + l_linenumber * 0.0013, 2) || ' seconds.' ELSE 'This is an image.' END || chr(10) || 'find {x} ' || l_returnflag AS ask FROM predictions)"
_OWN = "CASE WHEN NOT video THEN {image} WHEN own THEN {own} ELSE {plain} END"


@query("shp_video_rl", f"{_Q} SELECT id, CASE WHEN video THEN 'tools' ELSE 'no tools' END AS system, ask, CASE WHEN video THEN 'video' ELSE 'image' END AS kind, path, {_OWN.format(image='200704', own='40000', plain='40000')}::BIGINT AS max_pixels, {_OWN.format(image='NULL', own='l_linenumber', plain='64')}::BIGINT AS max_frames, {_OWN.format(image='NULL', own='1', plain='2')}::DOUBLE AS fps, {_OWN.format(image='NULL', own=chr(39) + 'own' + chr(39), plain='NULL')} AS note, {_OWN.format(image='2', own='2', plain='2')}::DOUBLE AS tool_fps, CASE WHEN video THEN path END AS tool_path, CASE WHEN video THEN round(ge + l_linenumber * 0.0013, 2) ELSE 0 END::DOUBLE AS duration, answer AS truth FROM q", "predictions")
def shp_video_rl(spark, d):
    rows = questions(spark, d).withColumn("solution", F.col("answer"))
    x = W.rl_records(rows, _ASK, "tools", "no tools", "/media", _K, ["iou"])
    user, tools = F.col("prompt")[1]["content"], F.col("extra_info.tools_kwargs")
    opts = F.col("media")[0]
    return x.select(
        "id", F.col("prompt")[0]["content"][0]["text"].alias("system"), user[1]["text"].alias("ask"), user[0]["type"].alias("kind"), W.option(opts, "path", "string").alias("path"), W.option(opts, "max_pixels", "bigint").alias("max_pixels"), W.option(opts, "max_frames", "bigint").alias("max_frames"),
        W.option(opts, "fps", "double").alias("fps"), W.option(opts, "note", "string").alias("note"), W.option(tools, "fps", "double").alias("tool_fps"), W.option(tools, "video_path", "string").alias("tool_path"), W.option(tools, "duration", "double").alias("duration"), F.col("reward_model.ground_truth").alias("truth"),
    )


@query("shp_video_sft", f"{_Q} SELECT id, CASE WHEN two THEN ['system', 'user', 'assistant', 'tool', 'assistant'] ELSE ['system', 'user', 'assistant'] END AS roles, CASE WHEN two THEN ['rules', ask, 'call', 'Video clip from ' || printf('%.2f', gs) || ' to ' || printf('%.2f', ge) || ' seconds.', l_returnflag] ELSE ['rules', ask, l_returnflag] END AS texts, CASE WHEN two THEN 2 ELSE 1 END AS media, CASE WHEN two THEN gs END AS video_start, CASE WHEN two THEN ge END AS video_end, CASE WHEN two THEN 64 END::BIGINT AS clip_frames, CASE WHEN two THEN CASE WHEN own THEN 1 ELSE 2 END END::DOUBLE AS clip_fps FROM q", "predictions")
def shp_video_sft(spark, d):
    x = W.sft_records(questions(spark, d), _ASK, "rules", "/media", _K)
    texts = F.flatten(F.transform("messages", lambda m: F.filter(F.transform(m["content"], lambda p: p["text"]), lambda t: t.isNotNull())))
    clip = F.get("media", F.lit(1))
    return x.select("id", F.transform("messages", lambda m: m["role"]).alias("roles"), texts.alias("texts"), F.size("media").alias("media"), W.option(clip, "video_start", "double").alias("video_start"), W.option(clip, "video_end", "double").alias("video_end"), W.option(clip, "max_frames", "bigint").alias("clip_frames"), W.option(clip, "fps", "double").alias("clip_fps"))


_H, _W = "(l_partkey % 60 + 1) * (l_linenumber * l_linenumber * 13 + 1)", "(l_suppkey % 90 + 1) * 11"


@query("arr_smart_resize", f"""WITH s AS (SELECT id, {_H} AS h, {_W} AS w FROM spans), r AS (SELECT *, greatest(28, round_even(h / 28.0, 0)::BIGINT * 28) AS h0, greatest(28, round_even(w / 28.0, 0)::BIGINT * 28) AS w0, sqrt(h * w / 250880.0::DOUBLE) AS b, sqrt(3136.0::DOUBLE / (h * w)) AS g FROM s)
  SELECT id, CASE WHEN greatest(h, w) / least(h, w)::DOUBLE <= 200 THEN CASE WHEN h0 * w0 > 250880 THEN floor(h / b / 28)::BIGINT * 28 WHEN h0 * w0 < 3136 THEN ceil(h * g / 28)::BIGINT * 28 ELSE h0 END END AS height,
    CASE WHEN greatest(h, w) / least(h, w)::DOUBLE <= 200 THEN CASE WHEN h0 * w0 > 250880 THEN floor(w / b / 28)::BIGINT * 28 WHEN h0 * w0 < 3136 THEN ceil(w * g / 28)::BIGINT * 28 ELSE w0 END END AS width FROM r""", "spans")
def arr_smart_resize(spark, d):
    """Under and over the bounds of pixels; null over the ratio of 200."""
    h, w = (F.col("l_partkey") % 60 + 1) * (F.col("l_linenumber") * F.col("l_linenumber") * 13 + 1), (F.col("l_suppkey") % 90 + 1) * 11
    height, width = N.smart_size(h, w, most=320 * 28 * 28, strict=False)
    return V.spans(spark, d).select("id", height.alias("height"), width.alias("width"))


@query("arr_nframes", """WITH s AS (SELECT id, l_partkey % 150 AS total, 1 + l_linenumber * 4.0::DOUBLE AS rate, l_suppkey % 40 AS wanted FROM spans), c AS (SELECT *, (floor(least(least(greatest(total / rate * 2.0, 4), floor(least(768, total) / 2.0) * 2), total) / 2) * 2)::BIGINT AS a, (floor(least(least(greatest(total / rate * 3.0, 6), 64), total) / 2) * 2)::BIGINT AS b, (round_even(wanted / 2.0, 0) * 2)::BIGINT AS e FROM s)
  SELECT id, CASE WHEN a >= 2 AND a <= total THEN a END AS plain, CASE WHEN b >= 2 AND b <= total THEN b END AS bounded, CASE WHEN e >= 2 AND e <= total THEN e END AS given, greatest(least(602112, (90316800 / nullif(CASE WHEN a >= 2 AND a <= total THEN a END, 0)) * 2.0), 105369)::DOUBLE AS pixels FROM c""", "spans")
def arr_nframes(spark, d):
    """By the default rate, by another one within bounds, and by a given number; null where the reference refuses. A frame's budget of pixels."""
    total, rate = F.col("l_partkey") % 150, 1 + F.col("l_linenumber") * 4.0
    plain = N.frame_count(total, rate, strict=False)
    x = V.spans(spark, d).select("id", plain.alias("plain"), N.frame_count(total, rate, fps=3.0, least=5, most=65, strict=False).alias("bounded"), N.frame_count(total, rate, frames=F.col("l_suppkey") % 40, strict=False).alias("given"))
    return x.withColumn("pixels", N.frame_pixels(F.col("plain")))


@query("arr_frame_range", """WITH s AS (SELECT id, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE ps END AS s, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE ge END AS e FROM spans), f AS (SELECT id, s IS NULL AND e IS NULL AS whole, CASE WHEN s IS NULL THEN 0 ELSE ceil(greatest(0, least(s, 40)) * 2.5) END::BIGINT AS a, CASE WHEN e IS NULL THEN 99 ELSE least(floor(greatest(0, least(e, 40)) * 2.5), 99) END::BIGINT AS z FROM s)
  SELECT id, CASE WHEN whole OR a < z THEN a END AS first, CASE WHEN whole OR a < z THEN z END AS last, CASE WHEN whole OR a < z THEN z - a + 1 END AS n FROM f""", "spans")
def arr_frame_range(spark, d):
    """Of a video of 100 frames at 2.5 a second; a start or an end may be missing; null where the reference refuses."""
    start, end = F.when(F.col("l_suppkey") % 5 != 0, F.col("ps")), F.when(F.col("l_suppkey") % 7 != 0, F.col("ge"))
    first, last, n = N.clip_frames(start, end, 2.5, F.lit(100), strict=False)
    return V.spans(spark, d).select("id", first.alias("first"), last.alias("last"), n.alias("n"))
