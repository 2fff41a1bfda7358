"""A pre-parser that turns streaming-SQL constructs Spark doesn't know into ones it does."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lattica.functions.scalars import similar_to_pattern
from lattica.plans import validation

_INTERVAL = r"INTERVAL\s+'(\d+)'\s+([A-Za-z]+)"
_COLUMN = r"([A-Za-z_][\w.]*)"


def _length(n: str, unit: str) -> str:
    return f"{n} {unit.lower()}"


def _quoted(sql: str) -> list[str]:
    """Alternating pieces outside and inside string literals."""
    return re.split(r"('(?:[^']|'')*')", sql)


def rewrite(sql: str) -> str:
    """TUMBLE, HOP and SESSION with their auxiliary functions, FLOOR/CEIL ... TO, SIMILAR TO, CENTURY and MILLENNIUM."""
    if re.search(rf"\b(TUMBLE|HOP|SESSION)\s*\(\s*{_COLUMN}\s*(,\s*{_INTERVAL}\s*){{1,2}},\s*TIME\b", sql, re.I):
        raise ValueError("windows with an offset are not supported in SQL; use window(..., startTime)")
    windows: dict[str, str] = {}

    def remember(kind: str, m: re.Match) -> str:
        column = m[1]
        if kind == "session":
            windows["session"] = call = f"session_window({column}, '{_length(m[2], m[3])}')"
        elif kind == "hop":
            windows["hop"] = call = f"window({column}, '{_length(m[4], m[5])}', '{_length(m[2], m[3])}')"
        else:
            windows["tumble"] = call = f"window({column}, '{_length(m[2], m[3])}')"
        return call

    patterns = {"tumble": rf"TUMBLE(?P<aux>_START|_END|_ROWTIME)?\s*\(\s*{_COLUMN}\s*,\s*{_INTERVAL}\s*\)", "hop": rf"HOP(?P<aux>_START|_END|_ROWTIME)?\s*\(\s*{_COLUMN}\s*,\s*{_INTERVAL}\s*,\s*{_INTERVAL}\s*\)", "session": rf"SESSION(?P<aux>_START|_END|_ROWTIME)?\s*\(\s*{_COLUMN}\s*,\s*{_INTERVAL}\s*\)"}

    def call(kind: str, m: re.Match) -> str:
        aux = (m["aux"] or "").upper()
        groups = [g for g in m.groups()[1:]]
        fake = _Groups(groups)
        window = remember(kind, fake)
        name = "session_window" if kind == "session" else "window"
        return {"": window, "_START": f"{name}.start", "_END": f"{name}.end", "_ROWTIME": f"({name}.end - INTERVAL '0.001' SECOND)"}[aux]

    for kind, pattern in patterns.items():
        sql = re.sub(rf"\b{pattern}", lambda m, kind=kind: call(kind, m), sql, flags=re.I)
    sql = re.sub(rf"\bFLOOR\s*\(\s*{_COLUMN}\s+TO\s+(\w+)\s*\)", r"date_trunc('\2', \1)", sql, flags=re.I)
    sql = re.sub(rf"\bCEIL(?:ING)?\s*\(\s*{_COLUMN}\s+TO\s+(\w+)\s*\)", r"(CASE WHEN date_trunc('\2', \1) = \1 THEN \1 ELSE date_trunc('\2', date_trunc('\2', \1) + INTERVAL 1 \2) END)", sql, flags=re.I)
    sql = re.sub(rf"\bEXTRACT\s*\(\s*CENTURY\s+FROM\s+{_COLUMN}\s*\)", r"ceil(year(\1) / 100)", sql, flags=re.I)
    sql = re.sub(rf"\bEXTRACT\s*\(\s*MILLENNIUM\s+FROM\s+{_COLUMN}\s*\)", r"ceil(year(\1) / 1000)", sql, flags=re.I)
    sql = re.sub(rf"{_COLUMN}\s+SIMILAR\s+TO\s+'((?:[^']|'')*)'(?:\s+ESCAPE\s+'(.)')?", lambda m: f"{m[1]} RLIKE r'{similar_to_pattern(m[2].replace(chr(39) * 2, chr(39)), m[3])}'", sql, flags=re.I)
    return sql


class _Groups:
    """The groups of a match without its first, counted from 1."""

    def __init__(self, groups: list[str]):
        self.groups = groups

    def __getitem__(self, i: int) -> str:
        return self.groups[i - 1]


#: What the strict rules call an operation, and how it looks in SQL.
_OPERATIONS = {
    "intersect": r"\bINTERSECT\b(?!\s+ALL)", "intersect_all": r"\bINTERSECT\s+ALL\b", "minus": r"\b(EXCEPT|MINUS)\b(?!\s+ALL)", "minus_all": r"\b(EXCEPT|MINUS)\s+ALL\b",
    "union_distinct": r"\bUNION\b(?!\s+ALL)", "in_subquery": r"\bIN\s*\(\s*SELECT\b", "distinct_aggregate": r"\w\s*\(\s*DISTINCT\b", "grouping_sets": r"\b(GROUPING\s+SETS|CUBE|ROLLUP)\s*\(",
    "fetch": r"\b(LIMIT|FETCH)\b", "offset": r"\bOFFSET\b",
}


def operations(text: str) -> set[str]:
    """The operations of a query that the rules for streaming tables name."""
    plain = "''".join(_quoted(text)[::2])
    return {name for name, pattern in _OPERATIONS.items() if re.search(pattern, plain, re.I)}


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run a query in this dialect over named frames; raises for what streaming tables don't support."""
    for operation in sorted(operations(text)):
        validation.check(operation, *tables.values())
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(rewrite(text))
