"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Derived views in SQL, in the order of their dependence; plans.views has them as DataFrames.
VIEWS: dict[str, str] = {
    "rollouts": "SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS sample, l_quantity / 25 AS score, l_linenumber * 10 AS len, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS acc FROM lineitem",
    "tokens": "SELECT user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value / 100 AS reward, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS v, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask, -(event_id % 7) / 10.0::DOUBLE AS old_lp, -(event_id % 5) / 10.0::DOUBLE AS new_lp, event_type FROM events",
    "spans": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS gs, l_quantity + round(l_tax * 100) - 1 AS ge, l_quantity + l_linenumber - 3 AS ps, l_quantity + l_linenumber - 3 + round(l_discount * 100) - 1 AS pe FROM lineitem",
    "predictions": """SELECT *, '[' || CAST(gs AS BIGINT) || ', ' || CAST(ge AS BIGINT) || ']' AS answer,
      CASE WHEN l_suppkey % 2 = 0 THEN '<answer>' ELSE '' END || CASE l_partkey % 5
        WHEN 0 THEN 'happens in ' || CAST(ps AS BIGINT) || ' - ' || CAST(pe AS BIGINT)
        WHEN 1 THEN 'From ' || CAST(ps AS BIGINT) || ' to ' || CAST(pe AS BIGINT)
        WHEN 2 THEN 'unknown'
        WHEN 3 THEN CAST(ps AS BIGINT) || '.50s then ' || CAST(pe AS BIGINT) || ' end'
        ELSE 'start ' || CAST(ps AS BIGINT) || chr(10) || 'end ' || CAST(pe AS BIGINT) END AS pred FROM spans""",
    "choices": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_returnflag AS kind, substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS gold, CASE l_linenumber % 4 WHEN 0 THEN 'The answer is ' || substr('ABCD', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) WHEN 1 THEN '  Best option: ' || substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) || '.' WHEN 2 THEN 'one two three four five six seven eight nine ten eleven' ELSE 'From the list Answer B' END AS said FROM lineitem",
    "docs": "SELECT doc_id, lang, source, text, n_chars FROM documents",
}
_NEEDS = {"predictions": ["spans"]}


def sql(body: str, *views: str) -> str:
    """``body`` after WITH clauses for the views it names."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*_NEEDS.get(v, []), v) if x not in names]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    text = body.strip()
    if not head:
        return text
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{head}, {text[len(start) :]}"
    return f"WITH {head} {text}"


def query(name: str, oracle: str | None = None, *views: str):
    """Register a query and, if given, its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, *views)
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
