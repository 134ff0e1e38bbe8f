"""Whether two formulas are equal: read as trees and evaluated, exactly modulo a prime where they are rational, else in numbers."""

from __future__ import annotations

import cmath
import math
import random
import re

#: A Mersenne prime; places at which two formulas are compared; longest formula that is read in characters and in signs, deepest nesting, largest power.
PRIME, PLACES, LONGEST, SIGNS, DEEPEST, LARGEST = (1 << 61) - 1, 5, 1_000, 300, 40, 10_000
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sqrt": cmath.sqrt, "abs": abs}
_TOKEN = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+|\\[a-zA-Z]+|\\.|[a-zA-Z]+|\*\*|.)", re.S)
_SPACING = re.compile(r"\\[,;:! ]|\\(?:left|right|displaystyle|quad|qquad)(?![a-zA-Z])|~")
_AS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\tfrac": "\\frac", "\\dfrac": "\\frac", "\\lvert": "|", "\\rvert": "|", "\\{": "{", "\\}": "}"}
_OPEN = {"(": ")", "{": "}", "[": "]"}


class Unreadable(ValueError):
    """Not a formula that can be read."""


class Reader:
    """Recursive descent: sums, products (signs left out too), powers, fractions, roots, functions, names of one letter."""

    def __init__(self, text: str):
        if len(text) > LONGEST:
            raise Unreadable("too long")
        tokens: list[str] = []
        for t in _TOKEN.findall(_SPACING.sub(" ", text)):
            t = _AS.get(t, t)
            bare = t.lstrip("\\")
            # a run of letters is a known name or a product of names
            tokens += [t] if t[0] == "\\" or not t.isalpha() or bare in FUNCTIONS or bare == "pi" else list(t)
        self.tokens, self.at, self.depth = [t for t in tokens if not t.isspace()], 0, 0
        if len(self.tokens) > SIGNS:
            raise Unreadable("too long")

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise Unreadable(f"{want or 'more'} expected")
        self.at += 1
        return t

    def whole(self) -> tuple:
        tree = self.sum()
        if self.peek():
            raise Unreadable(f"{self.peek()} is left over")
        return tree

    def sum(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("too deep")
        tree = self.product()
        while self.peek() in ("+", "-"):
            tree = ("+" if self.take() == "+" else "-", tree, self.product())
        self.depth -= 1
        return tree

    def product(self) -> tuple:
        tree = self.signed()
        while (t := self.peek()) and t not in "+-)}]|,=&":
            if t in ("*", "/"):
                self.take()
                tree = (t, tree, self.signed())
                continue
            mixed = t == "\\frac" and tree[0] == "number"
            right = self.power()
            # a whole number before a fraction of numbers is a mixed number
            tree = ("+" if mixed and right[0] == "/" and right[1][0] == right[2][0] == "number" else "*", tree, right)
        return tree

    def signed(self) -> tuple:
        if self.peek() in ("+", "-"):
            return ("-", ("number", "0"), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        if self.peek() == "^":
            self.take()
            if self.peek() == "\\circ" or (self.peek() == "{" and self.tokens[self.at + 1 : self.at + 3] == ["\\circ", "}"]):
                self.at += 1 if self.peek() == "\\circ" else 3
                return base
            return ("^", base, self.signed())
        return base

    def argument(self) -> tuple:
        """What stands in braces, or one digit or name."""
        if self.peek() == "{":
            return self.atom()
        t = self.take()
        if t[0].isdigit() and len(t) > 1:
            self.tokens[self.at - 1 : self.at] = [t[0], t[1:]]
            t = t[0]
        else:
            self.at -= 1
            return self.atom()
        return ("number", t)

    def atom(self) -> tuple:
        t = self.take()
        if t in _OPEN:
            tree = self.sum()
            self.take(_OPEN[t])
            return tree
        if t == "|":
            tree = self.sum()
            self.take("|")
            return ("call", "abs", tree)
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            return ("number", t)
        name = t.lstrip("\\")
        if t == "\\frac":
            top = self.argument()
            return ("/", top, self.argument())
        if name == "sqrt":
            if self.peek() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
                return ("^", self.argument(), ("/", ("number", "1"), degree))
            return ("call", "sqrt", self.argument())
        if name in FUNCTIONS:
            if self.peek() == "^":
                self.take()
                n = self.argument()
                return ("^", ("call", name, self.power()), n)
            return ("call", name, self.power())
        if name == "pi":
            return ("pi",)
        if t.isalpha() and len(t) == 1 or t[0] == "\\" and name.isalpha() and name not in ("begin", "end", "text", "circ", "infty"):
            return ("name", name)
        raise Unreadable(t)


def read(text: str) -> tuple | None:
    """The tree of a formula; None if it cannot be read."""
    try:
        return Reader(text).whole()
    except (Unreadable, RecursionError):
        return None


def names(tree: tuple) -> set[str]:
    out, stack = set(), [tree]
    while stack:
        t = stack.pop()
        if t[0] == "name":
            out.add(t[1])
        stack += [x for x in t[1:] if isinstance(x, tuple)]
    return out


def _integer(tree: tuple) -> int:
    """A whole number that a tree without names spells, as far as exponents need it."""
    value = number(tree)
    if value is None or abs(value.imag) > 0 or value.real != int(value.real) or abs(value.real) > LARGEST:
        raise Unreadable("not a small whole number")
    return int(value.real)


def modulo(tree: tuple, at: dict[str, int]) -> int:
    """Value modulo the prime; an error if the formula is not rational."""
    kind = tree[0]
    if kind == "number":
        whole, _, part = tree[1].partition(".")
        return int(whole + part or "0") * pow(pow(10, len(part), PRIME), -1, PRIME) % PRIME
    if kind == "name":
        return at[tree[1]]
    if kind == "^":
        return pow(modulo(tree[1], at), _integer(tree[2]), PRIME)
    if kind not in ("+", "-", "*", "/"):
        raise Unreadable("not rational")
    a, b = modulo(tree[1], at), modulo(tree[2], at)
    return (a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a * pow(b, -1, PRIME)) % PRIME


def value(tree: tuple, at: dict[str, float], pi: float = math.pi) -> complex:
    """Value in complex numbers."""
    kind = tree[0]
    if kind == "number":
        return complex(float(tree[1]))
    if kind == "pi":
        return complex(pi)
    if kind == "name":
        return complex(at[tree[1]])
    if kind == "call":
        return complex(FUNCTIONS[tree[1]](value(tree[2], at, pi)))
    a, b = value(tree[1], at, pi), value(tree[2], at, pi)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else a**b


def number(tree: tuple | None, pi: float = math.pi) -> complex | None:
    """The finite number that a formula without names stands for."""
    if tree is None or names(tree):
        return None
    try:
        out = value(tree, {}, pi)
    except (ArithmeticError, ValueError):
        return None
    return out if cmath.isfinite(out) else None


def identical(a: tuple, b: tuple) -> bool:
    """Equal for all values of their names: modulo the prime if both are rational, else at places over the positive numbers."""
    both, rng = sorted(names(a) | names(b)), random.Random(20)
    try:
        for _ in range(PLACES):
            at = {x: rng.randrange(1, PRIME) for x in both}
            if modulo(a, at) != modulo(b, at):
                return False
        return True
    except (Unreadable, ValueError):  # a root, a function, or a denominator that is zero
        pass
    seen = 0
    for _ in range(2 * PLACES):
        at = {x: rng.uniform(0.4, 2.6) for x in both}
        try:
            x, y = value(a, at), value(b, at)
        except (ArithmeticError, ValueError):
            continue
        if not (cmath.isfinite(x) and cmath.isfinite(y)):
            continue
        if abs(x - y) > 1e-9 * max(1.0, abs(x), abs(y)):
            return False
        seen += 1
    return seen >= PLACES


def equal(a: str, b: str, tolerance: float = 1e-4, pi: float = math.pi) -> bool:
    """Identical formulas, or numbers within the relative tolerance."""
    x, y = read(a), read(b)
    if x is None or y is None:
        return False
    u, v = number(x, pi), number(y, pi)
    if u is not None and v is not None:
        return abs(u - v) <= tolerance * max(abs(u), abs(v))
    return identical(x, y)
