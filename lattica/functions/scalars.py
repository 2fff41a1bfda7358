"""Scalar functions whose reference semantics differ from the built-in ones, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_divide(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.when(F.signum(a.cast("double")) * F.signum(b.cast("double")) < 0, -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b))).cast("long")


def log(base: Column, x: Column) -> Column:
    """log of ``x`` to ``base``; raises for x <= 0 or base <= 1."""
    bad = F.when(x <= 0, F.raise_error(F.lit("log: x must be positive"))).when(base <= 1, F.raise_error(F.lit("log: base must be above 1")))
    return F.coalesce(bad.cast("double"), F.ln(x) / F.ln(base))


def lpad(s: Column, n: int, pad: str) -> Column:
    """Null for a negative length; truncates when longer."""
    return F.lit(None).cast("string") if n < 0 else F.lpad(s, n, pad)


def rpad(s: Column, n: int, pad: str) -> Column:
    return F.lit(None).cast("string") if n < 0 else F.rpad(s, n, pad)


def similar_to_pattern(pattern: str, escape: str | None = None) -> str:
    """A SQL ``SIMILAR TO`` pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append({"%": ".*", "_": "."}.get(c) or (c if c in "|*+?(){}[]^-," or c.isalnum() else re.escape(c)))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


def similar_to(s: Column, pattern: str, escape: str | None = None) -> Column:
    return s.rlike(similar_to_pattern(pattern, escape))


def floor_to(ts: Column, unit: str) -> Column:
    """``FLOOR(ts TO unit)``."""
    return F.date_trunc(unit, ts)


def ceil_to(ts: Column, unit: str) -> Column:
    """``CEIL(ts TO unit)``: the instant itself if it is on a boundary, else the next boundary."""
    low = F.date_trunc(unit, ts)
    return F.when(low == ts, low).otherwise(F.date_trunc(unit, low + F.expr(f"INTERVAL 1 {unit}")))


def century(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 100)


def millennium(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 1000)


# Format codes of MySQL's DATE_FORMAT and the pattern letters that mean the same.
DATE_CODES = {"%a": "EEE", "%b": "MMM", "%c": "M", "%d": "dd", "%e": "d", "%f": "SSSSSS", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm", "%j": "DDD", "%k": "H", "%l": "h", "%M": "MMMM", "%m": "MM", "%p": "a", "%r": "hh:mm:ss a", "%S": "ss", "%s": "ss", "%T": "HH:mm:ss", "%W": "EEEE", "%Y": "yyyy", "%y": "yy"}
UNSUPPORTED_CODES = frozenset("wUuVXD")


def date_format(ts: Column, pattern: str) -> Column:
    """MySQL-style ``DATE_FORMAT`` for a literal pattern; ``%v`` and ``%x`` are the ISO week and its year."""
    parts, text, i = [], "", 0

    def close() -> None:
        nonlocal text
        if text:
            parts.append(F.date_format(ts, text))
            text = ""

    while i < len(pattern):
        if pattern[i] != "%":
            c = pattern[i]
            text += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
            continue
        code = pattern[i : i + 2]
        if len(code) < 2:
            raise ValueError("a date pattern can't end with %")
        if code[1] in UNSUPPORTED_CODES:
            raise ValueError(f"date pattern {code} is not supported")
        if code in ("%v", "%x"):
            close()
            parts.append(F.lpad(F.weekofyear(ts).cast("string"), 2, "0") if code == "%v" else F.extract(F.lit("YEAROFWEEK"), ts).cast("string"))
        else:
            text += DATE_CODES.get(code, f"'{code[1]}'" if code[1].isalpha() else code[1])
        i += 2
    close()
    return F.concat(*parts) if parts else F.lit("")


def element(array: Column) -> Column:
    """The only element of an array; null if empty, an error if there are more."""
    return F.when(F.size(array) > 1, F.raise_error(F.lit("element: more than one"))).otherwise(F.get(array, F.lit(0)))


def at(array: Column, i: int) -> Column:
    """1-based array access; null past the end."""
    return F.get(array, F.lit(i - 1))


def temporal_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """SQL ``OVERLAPS`` of two periods given in either order."""
    lo1, hi1, lo2, hi2 = F.least(a_start, a_end), F.greatest(a_start, a_end), F.least(b_start, b_end), F.greatest(b_start, b_end)
    return ((lo1 < hi2) & (lo2 < hi1)) | (lo1 == lo2)


# distances of equal-length arrays
def _terms(a: Column, b: Column, f) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_terms(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_sum(_terms(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))


def dot(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tanimoto(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (dot(a, a) + dot(b, b) - dot(a, b))
