"""Registries of advantage functions, reward managers and batch scorers."""

from __future__ import annotations

import signal
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import groups


class Registry:
    """Names to functions; the same function twice is fine, another one under a taken name is an error."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def add(self, name: str, f: Callable) -> Callable:
        if self.known.get(name, f) is not f:
            raise ValueError(f"{name} is taken")
        self.known[name] = f
        return f

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise ValueError(f"unknown name {name}; there are {sorted(self.known)}")
        return self.known[name]


ADVANTAGES, REWARD_MANAGERS = Registry(), Registry()
for _name in ("grpo", "dgrpo", "pass_k", "rloo", "opo"):
    ADVANTAGES.add(_name, getattr(groups, _name))


def batch_scorer(f: Callable[[list, list], list]):
    """A vectorised scorer (texts, truths) -> scores as a function of two columns."""

    @F.pandas_udf("double")
    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series(f(texts.tolist(), truths.tolist()), dtype=float)

    return run


def custom_scorer(path: str, name: str, **fixed):
    """The function ``name`` of a source file, with fixed keywords, as a function of two columns.

    The driver reads the file and the text goes with the plan, so executors need no copy. It is run once a batch.
    """
    if not Path(path).exists():
        raise FileNotFoundError(path)
    source = Path(path).read_text()

    def load() -> Callable:
        space: dict = {"__name__": "custom_scorer"}
        try:
            exec(compile(source, path, "exec"), space)
        except Exception as e:
            raise RuntimeError(f"cannot load {path}: {e}") from e
        if name not in space:
            raise AttributeError(f"{path} has no {name}")
        return space[name]

    load()

    @F.pandas_udf("double")
    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        f = load()
        return pd.Series([f(a, b, **fixed) for a, b in zip(texts, truths, strict=True)], dtype=float)

    return run


def timed_scorer(f: Callable, seconds: float = 300.0):
    """A scorer of one row as a function of two columns; a row that fails or takes longer scores 0.

    Of a list the first score counts, of a dictionary "score". Rows run side by side as Spark's tasks. The timer is the
    worker's alarm signal: it ends Python code, not one long call into compiled code.
    """

    def late(*_) -> None:
        raise TimeoutError

    def score(text, truth) -> float:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            out = f(text, truth)
        except Exception:  # by contract any failure is a 0
            return 0.0
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
        out = 0.0 if out is None else out[0] if isinstance(out, list) else out["score"] if isinstance(out, dict) else out
        if not isinstance(out, int | float):
            raise ValueError(f"not a score: {out!r}")
        return float(out)

    @F.pandas_udf("double")
    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        before = signal.signal(signal.SIGALRM, late)
        try:
            return pd.Series([score(a, b) for a, b in zip(texts, truths, strict=True)], dtype=float)
        finally:
            signal.signal(signal.SIGALRM, before)

    return run


class Curriculum:
    """Orders rows by level: first the levels whose mean score so far is nearest to ``aim``, unseen ones before all.

    ``update`` adds a batch's sums by level; levels are few (an error over ``most``), so the state is small.
    """

    def __init__(self, level: str, score: str, aim: float, most: int = 1_000):
        self.level, self.score, self.aim, self.most = level, score, aim, most
        self.seen: dict = {}

    def update(self, batch: DataFrame) -> None:
        sums = batch.groupBy(self.level).agg(F.sum(self.score).alias("t"), F.count(self.score).alias("n"))
        rows = sums.limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"over {self.most} levels")
        for level, t, n in rows:
            total, count = self.seen.get(level, (0.0, 0))
            self.seen[level] = (total + (t or 0.0), count + n)

    def rank(self) -> Column:
        """Place of a row's level, to sort by."""
        far = {k: abs(t / n - self.aim) for k, (t, n) in self.seen.items() if n and k is not None}
        if not far:
            return F.lit(0)
        places = [x for i, k in enumerate(sorted(far, key=lambda k: (far[k], k))) for x in (F.lit(k), F.lit(i + 1))]
        return F.coalesce(F.try_element_at(F.create_map(*places), F.col(self.level)), F.lit(0))
