"""Maths answers: boxed formulas, final answers in normal form, comparison by text and by number."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from spindrift.functions import formulas
from spindrift.functions.scores import balanced, last_boxed

#: What is replaced in a final answer, in this order.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
#: What is deleted from a final answer, in this order.
DELETED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: Patterns of a final answer and what they become, in this order: the first formula alone, wrappers off, braces put.
PATTERNS = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"),
    (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"),
]
#: The line that holds the answer, the text in place of a missing one, the end of a solution that is read.
ANSWER_LINE, MISSING, TAIL, STRICT_TAIL = r"(?i)Answer\s*:\s*([^\n]+)", "[INVALID]", 300, 100


def boxed_dapo(s: str | None) -> str | None:
    r"""The last \boxed{...} with balanced braces, command and all; no other form counts."""
    at = (s or "").rfind("\\boxed{")
    inner = balanced(s, at) if at >= 0 else None
    return None if inner is None else "\\boxed{" + inner + "}"


def boxed_prime(s: str | None) -> str | None:
    r"""Stripped content of the last \boxed, or without one \fbox, with balanced braces."""
    at = (s or "").rfind("\\boxed")
    at = at if at >= 0 else (s or "").rfind("\\fbox")
    inner = balanced(s, at) if at >= 0 else None
    return None if inner is None else inner.strip()


def final_form(s: str) -> str:
    """A final answer after the last equals sign, in the normal form of the fixed tables; digits lose their commas."""
    s = s.rpartition("=")[2]
    for old, new in [*REPLACED, *((x, "") for x in DELETED)]:
        s = s.replace(old, new)
    for pattern, new in PATTERNS:
        s = re.sub(pattern, new, s)
    s = s.replace("$", "")
    bare = s.replace(",", "")
    return (bare if bare.isdigit() else s).strip()


def math_dapo(text: str | None, truth: str | None, strict: bool = False) -> tuple[float, str | None]:
    """(1 or -1, the answer read): the last answer line of the text's end; strict: the boxed text of a shorter end, as it is."""
    tail = (text or "")[-TAIL:]
    if strict:
        whole = boxed_dapo(tail[-STRICT_TAIL:])
        got = None if whole is None else whole[len("\\boxed{") : -1]
        return (1.0 if got is not None and got == truth else -1.0), got
    lines = re.findall(ANSWER_LINE, tail)
    got = final_form(lines[-1] if lines else MISSING)
    return (1.0 if truth is not None and got == final_form(truth) else -1.0), got


#: Units and words that a prime answer loses, each with its plural and power; number words; words between answers.
UNITS = "degree cm centimeter meter mile second minute hour day week month year foot feet inch yard liter".split()
TIMES, BETWEEN = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")], [" or ", " and "]
#: Marks after which, before which and again after which the answer of a text stands.
AFTER, BEFORE = ["answer:", "answer is", "answers are"], ["is answer", "is the answer", "are answers", "are the answers"]
LAST = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
_UNIT = re.compile("|".join(f"{u}(?:es)?s? *(?:\\^[0-9]+)?" for u in sorted(UNITS, key=len, reverse=True)))
_MATRIX = re.compile(r"\\begin\{([a-zA-Z]*matrix|array)\}(?:\{[lcr|]*\})?(.*)\\end\{\1\}", re.S)
#: Names of intervals and points and the brackets that they stand for.
_BRACKETS = {"Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()", "Interval": "[]", "Point": "()"}


def found_answer(text: str) -> tuple[bool, str]:
    """(whether an answer is marked and has a digit, the answer): after marks, from the last box, before the last full stop, after a verb or sign."""
    found = False
    for marks, after in ((AFTER, True), (BEFORE, False)):
        for mark in marks:
            if (at := text.lower().rfind(mark)) >= 0:
                found, text = True, (text[at + len(mark) :] if after else text[:at]).strip()
    if box := boxed_prime(text):
        found, text = True, box
    if (at := text.rfind(". ")) >= 0:
        text = text[:at].strip()
    for mark in LAST:
        if (at := text.lower().rfind(mark)) >= 0:
            found, text = True, text[at + len(mark) :].strip()
    return found and any(c.isdigit() for c in text), text


def plain_answer(s: str) -> str:
    """An answer without text wrapper, signs of money and per cent, units and words; commas within numbers go."""
    wrapped = re.fullmatch(r"\\text\{(.+?)\}", s.strip())
    s = wrapped[1] if wrapped else s.strip()
    for old in ("\\%", "%", "\\$", "$", "\\!"):
        s = s.replace(old, "")
    s = s.replace("\\{", "{").replace("\\}", "}")
    for word in BETWEEN:
        s = s.replace(word, " , ")
    for old, new in TIMES:
        s = s.replace(old, new)
    s = re.sub(r"\^ *(\{ *\\circ *\}|\\circ)", "", _UNIT.sub("", s))
    s = re.sub(r"\\text\{\s*\}", "", s).replace("{,}", ",").strip()
    s = s[1:-1] if s.startswith("{") and s.endswith("}") else s
    while (shorter := re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", s)) != s:
        s = shorter
    return re.sub(r"(?<=\d) +(?=\d)", "+", re.sub(r"- +", "-", s)).strip().rstrip(".")


def as_number(s: str) -> float | None:
    """A plain number; digits before a base's underscore."""
    head, base, _ = s.partition("_")
    try:
        out = float(head.replace(",", ""))
    except ValueError:
        return None
    return float(int(out)) if base and math.isfinite(out) else out


def close(a: float, b: float, tolerance: float = 1e-4) -> bool:
    """Equal up to the relative tolerance, also if one is a hundred times the other (a percentage)."""
    return any(math.isclose(a, b * k, rel_tol=tolerance) for k in (1.0, 100.0, 0.01))


def matrix_of(s: str) -> list[list[str]] | None:
    """Entries of a matrix, by command, as nested lists or as Matrix([[...]])."""
    if m := _MATRIX.search(s):
        return [[x.strip() for x in row.split("&")] for row in re.split(r"\\\\|\\(?=\s)", m[2]) if row.strip()]
    m = re.fullmatch(r"(?:Matrix\()?\[(\s*\[.*\]\s*)\]\)?", s.strip(), re.S)
    return [[x.strip() for x in row.split(",")] for row in re.findall(r"\[([^\[\]]*)\]", m[1])] if m else None


def parts_of(s: str) -> list[str]:
    """Elements of a tuple, an interval or a point at its outermost commas, its brackets first and last; else the text at its outermost commas."""
    for name, marks in _BRACKETS.items():
        if s.startswith(f"{name}(") and s.endswith(")"):
            s = f"{marks[0]}{s[len(name) + 1 : -1]}{marks[1]}"
            break
    wrapped = len(s) > 1 and s[0] in "([" and s[-1] in ")]"
    inner, out, depth, at = s[1:-1] if wrapped else s, [], 0, 0
    for i, c in enumerate(inner):
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return [s]  # (a)(b) is no tuple
        if c == "," and not depth:
            out.append(inner[at:i].strip())
            at = i + 1
    out.append(inner[at:].strip())
    return [s[0], *out, s[-1]] if wrapped and len(out) > 1 else out


def same_answer(got: str | None, truth: str | None, level: int = 0) -> bool:
    """By text in normal form, by number, element by element, or as formulas (pi as 3.14 or exact)."""
    from spindrift.functions.scores import same_math

    if got is None or truth is None:
        return False
    if same_math(got.strip(), truth.strip()):
        return True
    a, b = plain_answer(got), plain_answer(truth)
    bare = lambda s: re.sub(r"\\left|\\right|\s", "", s).lower()
    ends = [(x[0], x[-1]) for x in (bare(a), bare(b)) if x and x[0] in "([" and x[-1] in ")]"]
    loose = [re.sub(r"[\[\](){}]", "", bare(x)) for x in (a, b)]
    if a and (bare(a) == bare(b) or loose[0] == loose[1] != "" and len(set(ends)) < 2):
        return True
    if not a or not b or level > 3:
        return False
    u, v = as_number(a), as_number(b)
    if u is not None and v is not None:
        return close(u, v)
    x, y = matrix_of(a), matrix_of(b)
    if x or y:
        return bool(x and y) and [len(r) for r in x] == [len(r) for r in y] and all(same_answer(p, q, level + 1) for r, s in zip(x, y, strict=True) for p, q in zip(r, s, strict=True))
    a, b = (re.sub(r"\\left|\\right", "", t).strip() for t in (a, b))
    x, y = parts_of(a), parts_of(b)
    if len(x) > 1 or len(y) > 1:
        return len(x) == len(y) and all(p == q if p in ("(", ")", "[", "]") else same_answer(p, q, level + 1) for p, q in zip(x, y, strict=True))
    return any(formulas.equal(a, b, pi=pi) for pi in ((math.pi, 3.14) if "pi" in a + b else (math.pi,)))


def math_prime(text: str | None, truth: str | None) -> float:
    """1 if the answer that a text marks (the whole text without a mark) is the truth."""
    return float(text is not None and same_answer(found_answer(text)[1], truth))


def geometry(text: str | None, truth: str | None) -> float:
    """Nine tenths for the boxed answer, one tenth for thinking before a boxed answer."""
    form = re.fullmatch(r"<think>.*</think>.*\\boxed\{.*\}.*", text or "", re.S) is not None
    return 0.9 * float(same_answer(last_boxed(text), truth)) + 0.1 * form


def verified(verify=None):
    """Scorer by a verifier of (boxed truths, texts), of the package ``math_verify`` if none is given; its failure scores 0."""
    if verify is None:
        from math_verify.metric import math_metric
        from math_verify.parser import ExprExtractionConfig, LatexExtractionConfig

        metric = math_metric(gold_extraction_target=(LatexExtractionConfig(),), pred_extraction_target=(ExprExtractionConfig(), LatexExtractionConfig()))
        verify = lambda truths, texts: metric(truths, texts)[0]

    def score(text: str | None, truth: str | None) -> float:
        try:
            return float(verify([f"\\boxed{{{truth}}}"], [text]))
        except Exception:  # whatever a plug-in raises is a wrong answer
            return 0.0

    return scorer(score)


def scorer(f):
    """A function of (text, truth) as a vectorised column function."""

    @pandas_udf(DoubleType())
    def run(text: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([f(a, b) for a, b in zip(text, truth, strict=True)], dtype=float)

    return run


def reader(f):
    """A function of a text as a vectorised column function."""

    @pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(f)

    return run


dapo = scorer(lambda text, truth: math_dapo(text, truth)[0])
dapo_strict = scorer(lambda text, truth: math_dapo(text, truth, strict=True)[0])
prime, geo3k = scorer(math_prime), scorer(geometry)
read_dapo, read_prime = reader(boxed_dapo), reader(boxed_prime)
