"""Reward managers: the step from scored replies to token rewards, chosen by name.

A manager takes rows with data_source, truth and the reply as ``tokens`` (texts, padded with empty ones), ``attention``
and ``loss`` (0 or 1 for each token), and a scorer. It adds

reward   the score, with what the manager adds to it
place    the token that gets it, from 0; below 0 from the end, as indexing has it
extras   what the manager reports besides, as a map of numbers

A scorer is a function of the columns (source, text, truth) that gives a number or a struct with a field ``score``; all
its numbers are reported. ``batch`` takes instead a function of lists (sources, texts, truths) -> list of numbers or
dictionaries. Rows that bring a column ``rm_score`` keep it as their reward and nothing is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from spindrift.functions import arrays as A
from spindrift.functions import rewards as R
from spindrift.operators.registries import REWARD_MANAGERS

EXTRAS = MapType(StringType(), DoubleType())


def default_scorer(source: Column, text: Column, truth: Column) -> Column:
    """By the row's data source; no tool was run."""
    return R.dispatch(source, text, truth, F.lit(0))


def joined(tokens: Column, mask: Column | None = None) -> Column:
    """The text of the tokens that a mask leaves."""
    kept = tokens if mask is None else F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["t"])
    return F.array_join(kept, "")


def ones(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))


def token_rewards(reward: Column, place: Column, tokens: Column) -> Column:
    """Zeros with the reward at its place."""
    return A.reward_at(F.size(tokens), place, reward)


def _bypass(rows: DataFrame, place: Column, scored: Callable[[], DataFrame]) -> DataFrame:
    if "rm_score" not in rows.columns:
        return scored()
    return rows.withColumns({"reward": F.col("rm_score").cast("double"), "place": place, "extras": F.create_map().cast(EXTRAS)})


def _scored(rows: DataFrame, found: Column, place: Column, more: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Rows with reward, place and extras from a number or a struct of numbers."""
    out = rows.withColumn("_found", found)
    kind = out.schema["_found"].dataType
    fields = {f.name: F.col("_found")[f.name].cast("double") for f in kind.fields} if isinstance(kind, StructType) else {}
    score = fields.get("score", F.col("_found").cast("double") if not fields else None)
    if score is None:
        raise ValueError("a scorer's struct needs a field score")
    added = more(score) if more else {}
    reward = added.pop("reward", score)
    extras = F.create_map(*[x for k, v in (fields | added).items() for x in (F.lit(k), v.cast("double"))]) if fields or added else F.create_map()
    return out.withColumns({"reward": reward, "place": place, "extras": extras.cast(EXTRAS)}).drop("_found")


def naive(rows: DataFrame, scorer: Callable = default_scorer, **_) -> DataFrame:
    """The score of the attended reply at its last token."""
    n = ones(F.col("attention"))
    text = joined(F.col("tokens"), F.col("attention"))
    return _bypass(rows, n - 1, lambda: _scored(rows, scorer(F.col("data_source"), text, F.col("truth")), n - 1))


def naive_multiturn(rows: DataFrame, scorer: Callable = default_scorer, **_) -> DataFrame:
    """The score of the reply's own tokens (of the loss mask), one place before the last attended token, as shipped."""
    last = F.when(F.array_contains("attention", 1), F.size("attention") - F.array_position(F.reverse("attention"), 1)).otherwise(0)  # from 0
    text = joined(F.col("tokens"), F.col("loss"))
    place = (last - 1).cast("int")
    return _bypass(rows, place, lambda: _scored(rows, scorer(F.col("data_source"), text, F.col("truth")), place))


def dapo(rows: DataFrame, scorer: Callable = default_scorer, end: str = "", longest: int | None = None, buffer: int = 0, factor: float = 1.0, log: bool = False, **_) -> DataFrame:
    """``naive`` without the end token; with a ``buffer`` replies lose up to ``factor`` a buffer by which they pass ``longest`` - ``buffer``."""
    if buffer and longest is None:
        raise ValueError("a buffer needs the longest reply")
    n = ones(F.col("attention"))
    whole = joined(F.col("tokens"), F.col("attention"))
    text = F.when(whole.endswith(end), F.substring(whole, F.lit(1), F.length(whole) - len(end))).otherwise(whole) if end else whole

    def penalised(score: Column) -> dict[str, Column]:
        if not buffer:
            return {}
        over = F.least(-(n - (longest - buffer)) / buffer * factor, F.lit(0.0))
        return {"reward": score + over} | ({"overlong_reward": over, "overlong": (over < 0).cast("int")} if log else {})

    return _bypass(rows, n - 1, lambda: _scored(rows, scorer(F.col("data_source"), text, F.col("truth")), n - 1, penalised))


def prime(rows: DataFrame, scorer: Callable = default_scorer, **_) -> DataFrame:
    """The score of all tokens; what cannot be scored is 0. ``acc`` has the score too."""
    n = ones(F.col("attention"))
    score = F.coalesce(scorer(F.col("data_source"), joined(F.col("tokens")), F.col("truth")).cast("double"), F.lit(0.0))
    return _bypass(rows, n - 1, lambda: _scored(rows, score, n - 1).withColumn("acc", F.col("reward")))


def prime_multiturn(rows: DataFrame, scorer: Callable = default_scorer, **_) -> DataFrame:
    """The score of the reply's own tokens, at the place that their number gives."""
    n = ones(F.col("loss"))
    return _bypass(rows, n - 1, lambda: _scored(rows, scorer(F.col("data_source"), joined(F.col("tokens"), F.col("loss")), F.col("truth")), n - 1))


def batch(rows: DataFrame, scorer: Callable[[list, list, list], list], by: str | None = None, **_) -> DataFrame:
    """A scorer of lists: of whole groups of equal ``by``, or of Arrow batches. ``acc`` has the reward too."""
    n = ones(F.col("attention"))

    def numbers(sources: list, texts: list, truths: list) -> list[tuple[float, dict[str, float]]]:
        got = scorer(sources, texts, truths)
        if len(got) != len(texts):
            raise ValueError("a score for each row")
        return [(float(g["score"]), {k: float(v) for k, v in g.items()}) if isinstance(g, dict) else (float(g), {}) for g in got]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = numbers(*(x.column(c).to_pylist() for c in ("data_source", "_text", "truth")))
            more = [pa.array([f[0] for f in found], pa.float64()), pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.float64()))]
            keep = [c for c in x.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in keep), *more], names=[*keep, "reward", "extras"])

    @arrow_udf(ArrayType(StructType([StructField("reward", DoubleType()), StructField("extras", EXTRAS)])))
    def whole(sources: pa.Array, texts: pa.Array, truths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("reward", pa.float64()), ("extras", pa.map_(pa.string(), pa.float64()))]))
        groups = zip(sources.to_pylist(), texts.to_pylist(), truths.to_pylist(), strict=True)
        return pa.array([[{"reward": r, "extras": list(e.items())} for r, e in numbers(*g)] for g in groups], kind)

    def scored() -> DataFrame:
        text = rows.withColumns({"_text": joined(F.col("tokens"), F.col("attention")), "place": n - 1})
        kept = [c for c in text.columns if c != "_text"]
        if by:  # only what the scorer reads goes to Python, many groups in a batch; the rows wait in their group
            groups = text.groupBy(F.col(by).alias("_by")).agg(F.collect_list(F.struct(*text.columns)).alias("_rows"))
            pairs = F.arrays_zip("_rows", whole(*(F.col("_rows")[c] for c in ("data_source", "_text", "truth"))).alias("_found"))
            done = groups.select(F.explode(pairs).alias("_x")).select(*[F.col("_x._rows")[c].alias(c) for c in kept], "_x._found.reward", "_x._found.extras")
        else:
            out = StructType([*[f for f in text.schema.fields if f.name != "_text"], StructField("reward", DoubleType()), StructField("extras", EXTRAS)])
            done = text.mapInArrow(each, out)
        return done.withColumn("acc", F.col("reward"))

    return _bypass(rows, n - 1, scored)


for _manager in (naive, naive_multiturn, batch, dapo, prime, prime_multiturn):
    REWARD_MANAGERS.add(_manager.__name__, _manager)

#: Schema of what a manager needs of a row.
NEEDED = {"data_source": StringType(), "truth": StringType(), "tokens": ArrayType(StringType()), "attention": ArrayType(IntegerType()), "loss": ArrayType(IntegerType())}


def manage(name: str, rows: DataFrame, scorer: Callable | None = None, **options) -> DataFrame:
    """The manager of that name; an unknown name or a missing column is an error."""
    f = REWARD_MANAGERS.get(name)
    if missing := [c for c in NEEDED if c not in rows.columns]:
        raise KeyError(missing)
    return f(rows, scorer, **options) if scorer else f(rows, **options)
