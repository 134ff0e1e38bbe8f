"""Rewards composed of parsers and scorers, as column expressions; one scorer's Python runs only on its own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import maths as M
from spindrift.functions import scores as P
from spindrift.functions import span as S
from spindrift.functions import text as T
from spindrift.functions.arrays import once

#: Question types whose answer is a number.
NUMBER_TYPES = ["object_abs_distance", "object_counting", "object_size_estimation", "room_size_estimation", "open-ended"]
#: Data sources by scorer.
SOURCES = {
    "gsm8k": ["openai/gsm8k"],
    "math": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"],
    "dapo": ["math_dapo"],  # and all that begin with aime
    "prime": ["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"],
    "geo3k": ["hiyouga/geometry3k", "./data/geometry3k"],
    "match": ["searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"],
    "video": ["video_r1/multiple_choice", "video_r1/numerical", "video_r1/free_form", "video_r1/regression", "video_r1/OCR"],
}


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def format_reward(text: Column, executions: Column) -> Column:
    """One for well-formed blocks, and a half for each of the first two tool executions."""
    return F.when(P.format_ok(text), 1.0).otherwise(0.0) + F.when(executions >= 1, F.least(executions, F.lit(2)) * 0.5).otherwise(0.0)


def mcq(text: Column, truth: Column, of_truth: bool = False) -> Column:
    """Letter of the answer against the stripped truth, or against the truth's letter (two without a letter are equal)."""
    got = T.letter(T.answer_tag(text))
    return F.coalesce((got == (T.letter(truth) if of_truth else T.strip(truth))).cast("double"), F.lit(0.0))


def regression(said: Column, truth: Column) -> Column:
    return F.coalesce(unit(1 - (F.abs(said - truth) + 1e-9) / (F.abs(truth) + 1e-9)), F.lit(0.0))


def relative_accuracy(said: Column, truth: Column) -> Column:
    """Share of the tolerances 0.5, 0.45, ..., 0.05 that hold the relative error; null for a truth of zero, which is no number to be relative to."""
    import numpy as np

    limits = F.array(*[F.lit(float(x)) for x in 1 - np.linspace(0.5, 0.95, 10)])
    return once(F.try_divide(F.abs(said - truth), truth), lambda error: F.when(error.isNotNull(), F.size(F.filter(limits, lambda x: error <= x)) / 10.0))


def vqa(text: Column, truth: Column, kind: Column) -> Column:
    """By relative accuracy for question types with a number (none read: 0; null where it cannot be taken), else by letter."""
    numbers = once(T.number(T.answer_tag(text)), lambda said: F.when(said.isNull(), 0.0).otherwise(relative_accuracy(said, truth.try_cast("double"))))
    letters = (T.letter(T.answer_tag(text), T.PHRASES_C) == T.letter(truth, T.PHRASES_C)).cast("double")
    return F.when(kind.isin(*NUMBER_TYPES), numbers).otherwise(letters)


def video(text: Column, truth: Column, kind: Column) -> Column:
    """The scorer of a problem type; another type is an error."""
    answer, own = T.answer_tag(text), lambda k, c: F.when(kind == k, c)
    a, b = T.number(answer), T.number(truth)
    return (
        F.when(kind == "multiple_choice", mcq(text, truth))
        .when(kind == "numerical", P.numeric(own("numerical", a), own("numerical", b)))
        .when(kind == "regression", regression(a, b))
        .when(kind == "OCR", unit(1 - P.wer(own("OCR", truth), own("OCR", answer))))
        .when(kind == "free_form", unit(P.rouge(own("free_form", truth), own("free_form", answer))))
        .otherwise(F.raise_error(F.concat(F.lit("no scorer for problem type "), F.coalesce(kind, F.lit("null")))).cast("double"))
    )


def overlap_reward(text: Column, start: Column, end: Column, cut: bool = False) -> Column:
    """Overlap of the answer's range with the true one, at least 0; ``cut`` stretches 0 to 0.5 to 0 to 1."""
    t = T.time_range(T.answer_tag(text))
    x = F.greatest(F.lit(0.0), S.overlap(t["s"], t["e"], start, end)[0])
    return S.cut_linear(x, 0.0, 0.5) if cut else x


def gsm8k(text: Column, truth: Column, flexible: bool = False) -> Column:
    got = T.gsm8k_flexible(text) if flexible else T.gsm8k_strict(text)
    return F.coalesce((got == truth).cast("double"), F.lit(0.0))


def match(text: Column, golden: Column, within: bool = False) -> Column:
    """1 if the last answer tag equals (or contains) a golden answer; an exact one among more than ten tags counts a quarter; 0 without a tag."""
    answer = T.answer_last(text)
    hit = T.sub_match(answer, golden) if within else T.exact_match(answer, golden)
    many = (F.size(F.regexp_extract_all(text, F.lit("<answer>"), 0)) > 10) | (F.size(F.regexp_extract_all(text, F.lit("</answer>"), 0)) > 10)
    return F.coalesce(hit.cast("double"), F.lit(0.0)) * (F.lit(1.0) if within else F.when(many, 0.25).otherwise(1.0))


def python_code(text: Column) -> Column:
    """What follows the last mark of a Python block, up to the next fence; without such a mark what is before the first fence."""
    return F.get(F.split(F.element_at(F.split(text, "```python"), -1), "```"), F.lit(0))


def fenced_code(text: Column) -> Column:
    """``python_code`` if there is such a block, else the first fenced part without a first line of letters alone; null without a fence."""
    part = F.get(F.split(text, "```"), F.lit(1))
    bare = F.when(part.rlike(r"^[^\S\n]*\p{L}+[^\S\n]*\n"), F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise(part)
    return F.when(text.contains("```python"), python_code(text)).when(text.contains("```"), bare)


#: Cases that count where a code's score is continuous.
FIRST_CASES = 10


def code_scores(replies: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Replies with ``score`` (1 if all cases of ``results`` (key, i, status) passed) and ``continuous`` (else the share of the first ten)."""
    passed = F.col("status") == 1
    r = results.groupBy(key).agg(F.bool_and(passed).alias("all"), F.avg(F.when(F.col("i") <= FIRST_CASES, passed.cast("int"))).alias("share"))
    every = F.coalesce(F.col("all"), F.lit(True))
    return replies.join(r, key, "left").withColumns({"score": every.cast("double"), "continuous": F.when(every, 1.0).otherwise(F.col("share"))}).drop("all", "share")


def remote_scores(replies: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Replies (with ``code``) with ``score``, ``continuous`` and ``uncompiled`` cases; status -4 spreads to the cases after it."""
    first = F.min(F.when(F.col("status") == -4, F.col("i"))).over(Window.partitionBy(key))
    spread = results.withColumn("_first", first).withColumn("status", F.when(F.col("i") >= F.col("_first"), -4).otherwise(F.col("status")))
    passed = (F.col("status") == 1).cast("int")
    r = spread.groupBy(key).agg(F.avg(passed).alias("rate"), F.avg(F.when(F.col("i") <= FIRST_CASES, passed)).alias("share"), F.count_if(F.col("status") == -4).alias("uncompiled"))
    own = lambda c: F.when(F.col("code").isNotNull(), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return replies.join(r, key, "left").withColumns({"score": own("rate"), "continuous": own("share"), "uncompiled": F.coalesce("uncompiled", F.lit(0).cast("long"))}).drop("rate", "share")


def gpqa(text: Column, truth: Column) -> Column:
    return F.coalesce((T.gpqa(text) == truth).cast("double"), F.lit(0.0))


def dispatch(source: Column, text: Column, truth: Column, executions: Column) -> Column:
    """The score of a row by its data source; another source is an error."""
    is_of = {k: source.isin(*v) | (source.startswith("aime") if k == "dapo" else F.lit(False)) for k, v in SOURCES.items()}
    own = lambda k, c: F.when(is_of[k], c)
    kind = own("video", F.substring_index(source, "/", -1))
    found = F.when(is_of["gsm8k"], gsm8k(text, truth))
    for k, f in (("math", P.math_equal), ("dapo", M.dapo), ("prime", M.prime), ("geo3k", M.geo3k)):
        found = found.when(is_of[k], f(own(k, text), own(k, truth)))
    found = found.when(is_of["match"], match(text, F.array(truth)))
    found = found.when(is_of["video"], format_reward(text, executions) + video(own("video", text), own("video", truth), F.coalesce(kind, F.lit("multiple_choice"))))
    return found.otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), F.coalesce(source, F.lit("null")))).cast("double"))
