"""Secret scans through a trigram inverted index, with DataFrame functions only.

``trigram_query`` turns a rule's pattern into a Boolean query: an OR of clauses,
each an AND of the lower-case trigrams that any match must hold. The index has a
row (trigram, block, mask) for each trigram of each block of 64 documents; the
mask says which of them have it. A clause's postings are intersected by AND of
masks, clauses are united by OR, and only documents that are left are verified by
the pattern itself. Rules without mandatory trigrams scan every document.

Plan: documents are numbered once and written, so that numbers hold however a
stage is repeated. Texts are cut into overlapping pieces, pieces into distinct
trigrams, and trigrams are summed up as masks before and after one exchange; no
key has more rows than map tasks that saw its block. Postings are written sorted
by trigram, so that a query reads few row groups. The candidates (at most a row
a block) are written too; Spark broadcasts them under its own size threshold and
else merges by block. Regexes run once a candidate.

Spans are (rule, start, end) in code points, end exclusive, leftmost and without
overlap by rule. Null text: empty, no spans. Rows of one id, and null ids, are
documents of their own. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass
from re import _constants as C  # the syntax tree of the standard library's regexes
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import text_or_empty, written

#: Most strings of one literal part, members of a class that is spelled out, and clauses of a query.
MOST_STRINGS, MOST_MEMBERS, MOST_CLAUSES = 64, 8, 256
#: Code points of a piece of a text.
PIECE = 4096


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Python and Java share; a match counts if its ``group`` has ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


def either(word: str) -> str:
    """A pattern for the word's letters in either case (ASCII alone, other than a flag in some engines)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base rules; a run of 24 hexadecimal digits or more is found as such, which gives the same spans.
BASE = [
    Rule("assign", "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
]
#: Further kinds of credentials. Quantifiers have bounds, so that no text makes a search quadratic.
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,500}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{1,64}@"),
]


def _product(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST_STRINGS else None


def _parts(tree) -> list[set[str] | list]:
    """A sequence's parts: a set of lower-case strings of which one stands there, or a list of queries (clauses) about what is there."""
    out: list = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append({chr(arg).lower()})
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 2 * MOST_MEMBERS:
                    chars |= {chr(v).lower() for v in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            out.append(chars if chars and len(chars) <= MOST_MEMBERS else [])
        elif op is C.SUBPATTERN:
            out += _parts(arg[-1])
        elif op is C.BRANCH:
            options = [_parts(x) for x in arg[1]]
            strings = [_joined(x) for x in options]
            if all(s is not None for s in strings) and len(set().union(*strings)) <= MOST_STRINGS:
                out.append(set().union(*strings))
            else:
                out.append([[clause for x in options for clause in _clauses(x)]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            parts = _parts(inner)
            strings = _joined(parts)
            if strings is not None and (low, high) == (0, 1) and len(strings) < MOST_STRINGS:
                out.append(strings | {""})
            elif low == high and low <= 16:
                out += parts * low
            else:
                out += [*parts * min(low, 3), []]
        elif op is C.AT:
            continue
        else:
            out.append([])
    return out


def _joined(parts: list) -> set[str] | None:
    """All strings that the parts can spell, if they are few."""
    out: set[str] | None = {""}
    for p in parts:
        out = _product(out, p) if isinstance(p, set) and out is not None else None
    return out


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2) if all(" " <= c <= "~" for c in text[i : i + 3]))


def _clauses(parts: list) -> list[frozenset[str]]:
    """OR of ANDs; a clause without trigrams says nothing."""
    factors, run = [], {""}
    for p in [*parts, []]:
        if isinstance(p, set):
            joined = _product(run, p)
            if joined is None:
                factors.append([_grams(s) for s in run])
                joined = p
            run = joined
        else:
            factors += [[_grams(s) for s in run], *p]
            run = {""}
    out = [frozenset()]
    for f in sorted((f for f in factors if all(f)), key=len):
        if len(out) * len(f) <= MOST_CLAUSES:  # leaving a factor out only adds candidates
            out = list({a | b for a, b in itertools.product(out, f)})
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of mandatory lower-case trigrams; empty if a match may hold none."""
    found = _clauses(_parts(_parser.parse(pattern)))
    return sorted((c for c in found if not any(o < c for o in found)), key=sorted) if all(found) else []


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n, id, text) with a number for each row, written to the shared folder."""
    return written(docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), codec="zstd")


def build_index(held: DataFrame) -> DataFrame:
    """Postings (trigram, block, mask) of all trigrams of printable ASCII, lower-case, written to the shared folder."""
    pieces = held.select("n", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))).alias("piece"))
    grams = pieces.select("n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("piece"), F.lit(r"(?=([\x20-\x7e]{3}))"), F.lit(1)))).alias("trigram"))
    postings = grams.groupBy("trigram", F.shiftright("n", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(n & 63 as int))")).alias("mask"))
    return written(postings.sortWithinPartitions("trigram", "block"), codec="zstd")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(block, m0, m1, ...): for each rule with mandatory trigrams (by its place) the documents of a block that may match."""
    terms = [(i, k, len(clause), gram) for i, r in enumerate(rules) for k, clause in enumerate(trigram_query(r.pattern)) for gram in sorted(clause)]
    places = sorted({t[0] for t in terms})
    if not terms:
        return index.select("block").where(F.lit(False))
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(k).alias("clause"), F.lit(size).alias("size"), F.lit(gram).alias("trigram")) for i, k, size, gram in terms])
    wanted = index.sparkSession.range(1).select(F.inline(rows))
    hits = index.where(F.col("trigram").isin(sorted({t[3] for t in terms}))).join(F.broadcast(wanted), "trigram")  # as many rows as the rules have trigrams
    both = hits.groupBy("block", "rule", "clause", "size").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("had"))
    return both.where((F.col("had") == F.col("size")) & (F.col("mask") != 0)).groupBy("block").agg(*[F.bit_or(F.when(F.col("rule") == i, F.col("mask"))).alias(f"m{i}") for i in places])


def _running(lengths: Column, step: int = 256) -> Column:
    """Sums of the items before each item of an array, by pieces of ``step`` so that no array is copied once an item."""
    grow = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda i: F.slice(lengths, i * step + 1, F.lit(step)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    before = F.aggregate(F.transform(pieces, total), none, grow, lambda acc: acc["all"])
    inside = F.transform(pieces, lambda x: F.aggregate(x, none, grow, lambda acc: acc["all"]))
    return F.flatten(F.zip_with(inside, before, lambda x, base: F.transform(x, lambda v: v + base)))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of the rule's matches."""
    pattern = F.lit(rule.pattern)
    length = lambda x: F.char_length(x).cast("long")
    hits, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.transform(gaps, length), F.transform(hits, length), lambda gap, hit: gap + F.coalesce(hit, F.lit(0)))
    found = F.zip_with(F.arrays_zip(_running(steps).alias("at"), F.transform(gaps, length).alias("gap")), F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda a, b: F.struct((a["at"] + a["gap"]).alias("start"), F.lit(place).alias("place"), (a["at"] + a["gap"] + length(b["hit"])).alias("end"), F.char_length(b["value"]).alias("n")))
    good = F.filter(found, lambda s: s["n"] >= rule.least)  # the last gap has no match: its n is null
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and, for each rule, its name with an array of (start, place, end): one row a row of ``docs``."""
    rules = [*BASE, *MORE] if rules is None else rules
    held = store(docs, id_col, text_col)
    found = written(candidates(build_index(held), rules), codec="zstd")
    indexed = {int(c[1:]) for c in found.columns if c != "block"}
    slot = F.expr("cast(n & 63 as int)")
    joined = held.withColumn("block", F.shiftright("n", 6)).join(found, "block", "left")
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint>>")
    cols = []
    for i, r in enumerate(rules):
        hit = spans(F.col("text"), r, i)
        if i in indexed:
            bit = F.expr(f"shiftright(m{i}, cast(n & 63 as int)) & 1")
            hit = F.when(F.coalesce(bit, F.lit(0)) == 1, hit).otherwise(none)
        else:
            hit = F.when(F.regexp_like("text", F.lit(r.pattern)), hit).otherwise(none)
        cols.append(hit.alias(r.name))
    return joined.select(F.col("id").alias(id_col), *cols)


def spelled(rules: list[Rule], *columns: str) -> Column:
    """name:start:end of the spans of several rules by start, then rule, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    each = F.sort_array(functools.reduce(F.concat, [F.col(c) for c in columns]))
    return F.array_join(F.transform(each, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
