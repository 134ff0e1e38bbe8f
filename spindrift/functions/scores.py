"""Scores that no column expression gives: vectorised over Arrow batches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType


def balanced(s: str, at: int) -> str | None:
    """Between the first brace from ``at`` on and the one that closes it."""
    depth, start = 0, None
    for i in range(at, len(s)):
        if s[i] == "{":
            start = i + 1 if start is None else start
            depth += 1
        elif s[i] == "}":
            depth -= 1
            if depth == 0 and start is not None:
                return s[start:i]
    return None


def last_boxed(s: str | None) -> str | None:
    r"""Text after the last '\boxed ' up to a dollar if there is one; else content of the last \boxed{...}, or without one of \fbox{...}, with balanced braces."""
    if not s:
        return None
    if "\\boxed " in s:
        return s.rpartition("\\boxed ")[2].split("$")[0]
    at = s.rfind("\\boxed")
    at = at if at >= 0 else s.rfind("\\fbox")
    return balanced(s, at) if at >= 0 else None


def braced_fractions(s: str) -> str:
    r"""Both parts of a \frac in braces where the first has none; a fraction cut short leaves all as it was, an empty one is an error."""
    head, *rest = s.split("\\frac")
    if "" in rest:
        raise ValueError("an empty fraction")
    if any(len(x) == 1 and x != "{" for x in rest):
        return s
    put = lambda x: x if x[0] == "{" else f"{{{x[0]}}}{x[1:]}" if x[1] == "{" else f"{{{x[0]}}}{{{x[1]}}}{x[2:]}"
    return "\\frac".join([head, *map(put, rest)])


def braced_roots(s: str) -> str:
    r"""The character after a \sqrt in braces where it has none; a root of nothing is an error."""
    head, *rest = s.split("\\sqrt")
    if "" in rest:
        raise ValueError("an empty root")
    return "\\sqrt".join([head, *(x if x[0] == "{" else f"{{{x[0]}}}{x[1:]}" for x in rest)])


#: What is replaced in a short formula, in this order: line breaks, thin spaces, doubled backslashes, kinds of fractions, sizes of brackets, degrees, dollars.
SPELLINGS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
#: What begins a unit; then per cent signs and leading zeros of decimals.
UNIT, DECIMALS = "\\text{ ", [("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def normal_math(s: str) -> str:
    """Spelling variants of a short formula brought to one form; an error for two units, an empty fraction or root."""
    for old, new in SPELLINGS:
        s = s.replace(old, new)
    s, *more = s.split(UNIT)
    if len(more) > 1:
        raise ValueError("two units")
    for old, new in DECIMALS:
        s = s.replace(old, new)
    if not s:
        return s
    s = "0" + s if s[0] == "." else s
    left, *right = s.split("=")
    if len(right) == 1 and len(left) <= 2:
        s = right[0]
    s = braced_fractions(braced_roots(s).replace(" ", ""))
    s = "\\frac{1}{2}" if s == "0.5" else s
    whole = re.fullmatch(r"(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)", s)
    return f"\\frac{{{whole[1]}}}{{{whole[2]}}}" if whole else s


def same_math(a: str, b: str) -> bool:
    """Equal in normal form; as they are, where one has none."""
    try:
        return normal_math(a) == normal_math(b)
    except ValueError:
        return a == b


def math_score(text: str | None, truth: str | None) -> float:
    """1 if the last boxed answer equals the truth in normal form; 0 on any failure."""
    got = last_boxed(text)
    return float(got is not None and truth is not None and same_math(got, truth))


def word_errors(reference: list[str], said: list[str]) -> int:
    """Edit distance in words; each row of the table is one vector step."""
    row = np.arange(len(said) + 1)
    codes = {w: i for i, w in enumerate(dict.fromkeys(said))}
    b = np.array([codes[w] for w in said], dtype=np.int64)
    steps = np.arange(len(said) + 1)
    for i, w in enumerate(reference):
        change = row[:-1] + (b != codes.get(w, -1))
        new = np.concatenate([[i + 1], np.minimum(change, row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


@pandas_udf(DoubleType())
def wer(reference: pd.Series, said: pd.Series) -> pd.Series:
    """Word errors over the reference's words (at least one)."""
    out = []
    for r, h in zip(reference, said, strict=True):
        r = (r or "").split()
        out.append(word_errors(r, (h or "").split()) / max(1, len(r)))
    return pd.Series(out, dtype=float)


_VOWELS = "aeiou"


def _shape(w: str) -> str:
    return "".join("v" if c in _VOWELS or c == "y" and i and w[i - 1] not in _VOWELS else "c" for i, c in enumerate(w))


@lru_cache(1 << 17)
def stem(w: str) -> str:
    """Porter's stemmer (1980), steps 1a to 5b, for words of more than three letters."""
    if len(w) <= 3:
        return w
    measure = lambda x: len(re.findall(r"v+c+", _shape(x)))
    double = lambda x: len(x) > 1 and x[-1] == x[-2] and _shape(x)[-1] == "c"
    short = lambda x: len(x) > 2 and _shape(x)[-3:] == "cvc" and x[-1] not in "wxy"
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    # The endings of steps 2, 3 and 4
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    four = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
    for table in (two, three):
        for end, to in sorted((x.split(":") for x in table.split(" ")), key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(four.split(), key=lambda x: -len(x)):
        if w.endswith(end):
            root = w[: -len(end)]
            if measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def rouge_words(s: str | None) -> list[str]:
    return [stem(w) for w in re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).split()]


def common_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence: places of the longer list are bits of whole numbers, a word of the shorter one is a few operations on them."""
    a, b = sorted((a, b), key=len)
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    all_set = left = (1 << len(b)) - 1  # a bit that is gone: the length grows there
    for w in a:
        hit = left & places.get(w, 0)
        left = (left + hit | left - hit) & all_set
    return len(b) - left.bit_count()


def _f(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if n and m and hits else 0.0


@pandas_udf(DoubleType())
def rouge(reference: pd.Series, said: pd.Series) -> pd.Series:
    """Mean F of one-word, two-word and longest-common-subsequence overlap, stemmed."""
    from collections import Counter

    out = []
    for r, h in zip(reference, said, strict=True):
        r, h = rouge_words(r), rouge_words(h)
        parts = []
        for n in (1, 2):
            x, y = (Counter(zip(*[t[i:] for i in range(n)], strict=False)) for t in (r, h))
            parts.append(_f(sum((x & y).values()), sum(x.values()), sum(y.values())))
        parts.append(_f(common_length(r, h), len(r), len(h)))
        out.append(sum(parts) / 3)
    return pd.Series(out, dtype=float)


@pandas_udf(DoubleType())
def numeric(said: pd.Series, truth: pd.Series) -> pd.Series:
    """1 if equal at one decimal, 0.5 at none, as Python rounds; else 0."""
    out = []
    for a, b in zip(said, truth, strict=True):
        if a is None or b is None or math.isnan(a) or math.isnan(b):
            out.append(0.0)
        else:
            out.append(1.0 if round(a, 1) == round(b, 1) else 0.5 if round(a) == round(b) else 0.0)
    return pd.Series(out, dtype=float)


@pandas_udf(StringType())
def boxed(text: pd.Series) -> pd.Series:
    return text.map(last_boxed)


@pandas_udf(DoubleType())
def math_equal(text: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([math_score(a, b) for a, b in zip(text, truth, strict=True)], dtype=float)


_BLOCK = re.compile(r"<(think|tool_call|answer)>.*?</\1>", re.S)


def well_formed(s: str | None) -> bool:
    """Blocks of think, tool call and answer: white space only between, no equal neighbours, think first, answer last."""
    found = list(_BLOCK.finditer(s or ""))
    names = [m[1] for m in found]
    if not names or names[0] != "think" or names[-1] != "answer":
        return False
    if any(a == b for a, b in zip(names, names[1:], strict=False)):
        return False
    return all(not s[a.end() : b.start()].strip() for a, b in zip(found, found[1:], strict=False))


@pandas_udf(BooleanType())
def format_ok(text: pd.Series) -> pd.Series:
    return text.map(well_formed).astype(bool)


def bootstrap(values: list[float], k: int, reducer, n: int = 1_000, seed: int = 42) -> tuple[float, float]:
    """(mean, population deviation) of ``reducer`` over n draws of k with replacement; the seed is set anew each call."""
    rng = np.random.RandomState(seed)
    x = np.asarray(values, dtype=float)
    got = np.array([reducer(x[rng.choice(len(x), k, replace=True)]) for _ in range(n)])
    return float(got.mean()), float(got.std())


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n; a single value has none."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


#: Numbers held at once by ``bootstrap_extremes``.
_HELD = 1 << 20


@lru_cache(64)
def _kept_draws(n: int, k: int, times: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, (times, k), replace=True)


def _draws(n: int, k: int, times: int, seed: int) -> Iterator[np.ndarray]:
    """The places that ``bootstrap`` draws, k a row: with the seed set anew each call they depend on nothing else. Small ones are kept."""
    if times * k <= _HELD // 8:
        yield _kept_draws(n, k, times, seed)
        return
    rng, step = np.random.RandomState(seed), max(1, _HELD // k)
    for at in range(0, times, step):
        yield rng.choice(n, (min(step, times - at), k), replace=True)


def bootstrap_extremes(values: np.ndarray, k: int, n: int = 1_000, seed: int = 42) -> np.ndarray:
    """Rows of groups of one length to (mean, deviation) of ``bootstrap`` with the maximum, then with the minimum: four columns."""
    out, step = np.empty((len(values), 4)), max(1, _HELD // (n * k))
    for at in range(0, len(values), step):
        own = values[at : at + step]
        drawn = (own[:, places] for places in _draws(values.shape[1], k, n, seed))
        best, worst = (np.concatenate(x, axis=1) for x in zip(*((x.max(axis=2), x.min(axis=2)) for x in drawn), strict=True))
        out[at : at + step] = np.stack([best.mean(axis=1), best.std(axis=1), worst.mean(axis=1), worst.std(axis=1)], axis=1)
    return out


def bootstrap_majority(values: np.ndarray, votes: np.ndarray, k: int, n: int = 1_000, seed: int = 42) -> np.ndarray:
    """(mean, deviation) of ``bootstrap`` with the first value of the commonest vote (the first of equals), rows of groups of one length."""
    out, step = np.empty((len(values), 2)), max(1, _HELD // (n * k * k))
    for at in range(0, len(values), step):
        got = []
        for places in _draws(values.shape[1], k, n, seed):
            said = votes[at : at + step][:, places]
            count = (said[..., :, None] == said[..., None, :]).sum(axis=3)
            first = np.take_along_axis(np.broadcast_to(places, said.shape), count.argmax(axis=2)[..., None], axis=2)[..., 0]
            got.append(np.take_along_axis(values[at : at + step], first, axis=1))
        got = np.concatenate(got, axis=1)
        out[at : at + step] = np.stack([got.mean(axis=1), got.std(axis=1)], axis=1)
    return out
