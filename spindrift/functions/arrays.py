"""Masked arithmetic on token arrays (array layout: one row per sequence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def masked(xs: Column, mask: Column) -> Column:
    return F.zip_with(xs, mask, lambda x, m: x * m)


def masked_sum(xs: Column, mask: Column) -> Column:
    return total(masked(xs, mask))


def masked_mean(xs: Column, mask: Column) -> Column:
    return masked_sum(xs, mask) / (total(mask.cast("array<double>")) + EPS)


def masked_var(xs: Column, mask: Column) -> Column:
    """Unbiased variance over the mask (two or more set places)."""
    mean, n = masked_mean(xs, mask), total(mask.cast("array<double>"))
    return masked_mean(F.transform(xs, lambda x: (x - mean) * (x - mean)), mask) * n / (n - 1)


def suffix_sum(xs: Column) -> Column:
    """Sum from each place to the end, in one reverse fold."""
    return fold_back(xs, F.lit(0.0), lambda carry, x: carry + x)


def fold_back(xs: Column, start: Column, step) -> Column:
    """``out[i] = step(out[i + 1], xs[i])`` from the end; arrays of a few thousand places."""
    empty = F.array().cast("array<double>")
    out = F.aggregate(F.reverse(xs), F.struct(start.alias("c"), empty.alias("o")), lambda a, x: F.struct(step(a["c"], x).alias("c"), F.array_append(a["o"], step(a["c"], x)).alias("o")))
    return F.reverse(out["o"])


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; the value after the end is 0 and the mask plays no part."""
    both = F.arrays_zip(rewards.alias("r"), values.alias("v"))
    empty = F.array().cast("array<double>")
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"), empty.alias("o"))

    def step(acc: Column, x: Column) -> Column:
        a = x["r"] + gamma * acc["v"] - x["v"] + gamma * lam * acc["a"]
        return F.struct(a.alias("a"), x["v"].alias("v"), F.array_append(acc["o"], a).alias("o"))

    return F.reverse(F.aggregate(F.reverse(both), zero, step)["o"])


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimate: k1, abs, k2 (mse) or k3 (low variance)."""
    if kind in ("kl", "k1"):
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (logp - ref) * (logp - ref)
    if kind in ("low_var_kl", "k3"):
        d = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), ref - logp))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(d) - d - 1))
    raise NotImplementedError(kind)


def eos_mask(ids: Column, eos: int, which: str = "last") -> Column:
    """1 up to the last (or first) end token; all ones without one."""
    place = F.size(ids) - F.array_position(F.reverse(ids), eos) if which == "last" else F.array_position(ids, eos) - 1
    return F.when(F.array_contains(ids, eos), F.transform(ids, lambda x, i: (i <= place).cast("int"))).otherwise(F.transform(ids, lambda x: F.lit(1)))


def pad(xs: Column, n: int | Column, value, left: bool = False) -> Column:
    """Fill up to ``n`` places; longer arrays are left alone."""
    n = F.lit(n) if isinstance(n, int) else n
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), n - F.size(xs)).cast("int"))
    return F.concat(fill, xs) if left else F.concat(xs, fill)


def truncate(xs: Column, n: int, how: str) -> Column:
    """At most ``n`` places: 'left' keeps the end, 'right' the start, 'middle' both ends."""
    if how == "left":
        cut = F.slice(xs, F.greatest(F.lit(1), F.size(xs) - n + 1), n)
    elif how == "right":
        cut = F.slice(xs, 1, n)
    elif how == "middle":
        cut = F.when(F.size(xs) > n, F.concat(F.slice(xs, 1, n // 2), F.slice(xs, F.greatest(F.lit(1), F.size(xs) - (n - n // 2) + 1), n - n // 2))).otherwise(xs)
    else:
        raise ValueError(how)
    return cut


def position_ids(mask: Column) -> Column:
    """max(0, running count - 1)."""
    return F.transform(mask, lambda m, i: F.greatest(F.lit(0), F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1))


def linspace(a: Column, b: Column, n: Column) -> Column:
    """Rounded (ties to even) equally spaced indices."""
    step = (b - a) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.rint(a + i * step).cast("long"))


def reward_at(n: Column, place: Column, score: Column) -> Column:
    """Array of length ``n`` with the score at ``place`` (from 0; below 0 from the end)."""
    whole = lambda at: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.when(i == at, score).otherwise(F.lit(0.0)))
    return once(F.when(place < 0, place + n).otherwise(place), whole)


def tool_mask(ids: Column, eos: int, roles: Column, attention: Column) -> Column:
    """Attention without the turns of tools.

    A turn ends with an end token; tool messages in a row are one turn. A tool's turn without an end token is an error,
    turns without a role are left alone.
    """
    turns = F.filter(roles, lambda r, i: (i == 0) | (r != "tool") | (F.get(roles, i - 1) != "tool"))
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == eos, i)), lambda i: i.isNotNull())
    open_turn = F.raise_error(F.lit("a tool's turn has no end token")).cast("int")

    def cuts(x: Column) -> Column:
        cut = lambda r, j: F.when(r == "tool", F.struct(F.when(j == 0, 0).otherwise(F.get(x["ends"], j - 1) + 1).alias("first"), F.coalesce(F.get(x["ends"], j), open_turn).alias("last")))
        return F.filter(F.transform(x["turns"], cut), lambda c: c.isNotNull())

    keep = lambda tools: F.transform(attention, lambda m, i: F.when(F.exists(tools, lambda c: i.between(c["first"], c["last"])), 0).otherwise(m))
    return once(once(F.struct(turns.alias("turns"), ends.alias("ends")), cuts), keep)


def turn_mask(turns: Column, prefix: int) -> Column:
    """1 for an assistant's tokens after its ``prefix`` tokens of generation prompt, else 0.

    ``turns`` are structs of role and n, the rendered tokens of a message. An unknown role and a system message that is
    not the first are errors.
    """
    role = lambda t, i: F.when(t["role"] == "assistant", F.concat(F.array_repeat(F.lit(0), F.least(F.lit(prefix), t["n"])), F.array_repeat(F.lit(1), F.greatest(F.lit(0), t["n"] - prefix)))).when(
        (t["role"] == "system") & (i > 0), F.raise_error(F.lit("a system message must be the first")).cast("array<int>")
    ).when(t["role"].isin("user", "system", "tool"), F.array_repeat(F.lit(0), t["n"])).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(t["role"], F.lit("null")))).cast("array<int>"))
    return F.flatten(F.transform(turns, role))


def policy_terms(old: Column, new: Column, advantage: Column, low: float, high: float, dual: float = 3.0) -> dict[str, Column]:
    """Per token: loss (clipped, from below too where the advantage is negative), clipped and clipped_low (0 or 1), kl."""
    if dual <= 1:
        raise ValueError("the lower bound of the ratio must be over 1")
    step = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), new - old))
    plain, cut, floor = -advantage * F.exp(step), -advantage * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), F.exp(step))), -advantage * dual
    upper = F.greatest(plain, cut)
    return {
        "loss": F.when(advantage < 0, F.least(floor, upper)).otherwise(upper),
        "clipped": (cut > plain).cast("double"),
        "clipped_low": ((upper > floor) & (advantage < 0)).cast("double"),
        "kl": -step,
    }


def log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.log(total(F.transform(xs, lambda x: F.exp(x - top))))


def entropy(xs: Column) -> Column:
    """Entropy of the softmax of logits."""
    z = log_sum_exp(xs)
    return z - total(F.transform(xs, lambda x: F.exp(x - z) * x))


def log_prob(xs: Column, label: Column) -> Column:
    return F.element_at(xs, label + 1) - log_sum_exp(xs)


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(delta: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0) -> Column:
    """Loss of a preference pair from the difference of its log ratios."""
    if kind == "sigmoid":
        return -log_sigmoid(beta * delta) * (1 - smoothing) - log_sigmoid(-beta * delta) * smoothing
    if kind == "ipo":
        return (delta - 1 / (2 * beta)) * (delta - 1 / (2 * beta))
    raise ValueError(kind)
