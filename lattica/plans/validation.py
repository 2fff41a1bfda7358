"""Optional strict rules for what batch and streaming tables support."""

from __future__ import annotations

from pyspark.sql import DataFrame


class UnsupportedStreamingOp(ValueError):
    """An operation that streaming tables don't support."""


class InvalidQuery(ValueError):
    """A query that the strict mode rejects."""


STREAM_FORBIDDEN = frozenset({"intersect", "intersect_all", "minus", "minus_all", "union_distinct", "in_subquery", "distinct_aggregate", "grouping_sets", "fetch", "offset", "outer_join_unbounded"})


def check(operation: str, *inputs: DataFrame) -> None:
    """Raise for an operation that isn't supported on a streaming input."""
    if operation in STREAM_FORBIDDEN and any(d.isStreaming for d in inputs):
        raise UnsupportedStreamingOp(f"{operation} is not supported on streaming tables")


def check_limit(ordered: bool, strict: bool = False) -> None:
    if strict and not ordered:
        raise InvalidQuery("a limit needs ORDER BY")


def check_stream_sort(columns: list[tuple[str, bool]], time_column: str) -> None:
    """``columns``: (name, ascending); a streaming sort starts ascending on time."""
    if not columns or columns[0] != (time_column, True):
        raise UnsupportedStreamingOp("a streaming sort must start ascending on the time attribute")


def check_join(equality: bool, time_bounded: bool, inner: bool, streaming: bool) -> None:
    if not equality:
        raise InvalidQuery("a join needs at least one equality predicate")
    if streaming and not time_bounded and not inner:
        raise UnsupportedStreamingOp("an unbounded streaming join must be an inner join")


def check_over(windows: list[tuple], streaming: bool) -> None:
    """All OVER aggregates of one streaming select share one window; bounds are not negative."""
    if streaming and len(set(windows)) > 1:
        raise UnsupportedStreamingOp("all OVER aggregates must share one window")


def check_set_operation(a: DataFrame, b: DataFrame) -> None:
    if len(a.columns) != len(b.columns):
        raise InvalidQuery("set operations need equal numbers of columns")
    if any(x != y for (_, x), (_, y) in zip(a.dtypes, b.dtypes, strict=True)):
        raise InvalidQuery("set operations need equal column types")
