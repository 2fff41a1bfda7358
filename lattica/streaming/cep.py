"""Event patterns over keyed, ordered events: sequences, quantifiers, negation, time limits and skip strategies.

The matcher is a list of partial matches per key. It runs per key over a whole batch (:func:`match`), or inside a stateful
processor whose state is that list (:func:`match_stream`). Plain sequences, whose steps are conditions on columns, need no
matcher: :func:`sequence` is one window per step in the JVM.
"""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Event = dict[str, Any]
Condition = Callable[[Event, dict[str, list[Event]]], bool]


@dataclasses.dataclass
class Step:
    name: str
    follow: str  # strict, relaxed, any, not_next, not_follow
    condition: Condition = lambda e, m: True
    least: int = 1
    most: int | None = 1
    optional: bool = False
    greedy: bool = False
    consecutive: bool = False
    combinations: bool = False
    until: Condition | None = None


class Pattern:
    """``Pattern.begin("a").where(...).followed_by("b")...``; methods change the last step."""

    def __init__(self, steps: list[Step], within: float | None = None, skip: tuple[str, str | None] = ("no_skip", None)):
        self.steps, self.limit, self.skip = steps, within, skip

    @classmethod
    def begin(cls, name: str) -> Pattern:
        return cls([Step(name, "relaxed")])

    def _add(self, name: str, follow: str) -> Pattern:
        if any(s.name == name for s in self.steps):
            raise ValueError(f"two steps are named {name}")
        if self.steps[-1].follow == "not_follow" and follow.startswith("not"):
            raise ValueError("a negative step can't follow a negative step")
        self.steps.append(Step(name, follow))
        return self

    def next(self, name: str) -> Pattern:
        return self._add(name, "strict")

    def followed_by(self, name: str) -> Pattern:
        return self._add(name, "relaxed")

    def followed_by_any(self, name: str) -> Pattern:
        return self._add(name, "any")

    def not_next(self, name: str) -> Pattern:
        return self._add(name, "not_next")

    def not_followed_by(self, name: str) -> Pattern:
        return self._add(name, "not_follow")

    def where(self, condition: Callable) -> Pattern:
        """AND with a condition of the event, or of the event and the match so far."""
        old, new = self.steps[-1].condition, _two(condition)
        self.steps[-1].condition = lambda e, m: old(e, m) and new(e, m)
        return self

    def or_where(self, condition: Callable) -> Pattern:
        old, new = self.steps[-1].condition, _two(condition)
        self.steps[-1].condition = lambda e, m: old(e, m) or new(e, m)
        return self

    def one_or_more(self) -> Pattern:
        return self.times(1, None)

    def times(self, least: int, most: int | None = 0) -> Pattern:
        s = self.steps[-1]
        s.least, s.most = least, least if most == 0 else most
        return self

    def optional(self) -> Pattern:
        self.steps[-1].optional = True
        return self

    def greedy(self) -> Pattern:
        self.steps[-1].greedy = True
        return self

    def consecutive(self) -> Pattern:
        self.steps[-1].consecutive = True
        return self

    def allow_combinations(self) -> Pattern:
        self.steps[-1].combinations = True
        return self

    def until(self, condition: Callable) -> Pattern:
        self.steps[-1].until = _two(condition)
        return self

    def within(self, seconds: float) -> Pattern:
        self.limit = seconds
        return self

    def after_match(self, strategy: str, step: str | None = None) -> Pattern:
        if strategy not in ("no_skip", "skip_past_last_event", "skip_to_first", "skip_to_last"):
            raise ValueError(strategy)
        self.skip = (strategy, step)
        return self

    def validate(self) -> None:
        if self.steps[-1].follow == "not_follow":
            raise ValueError("a pattern can't end with a negative step that may follow anywhere")
        if self.steps[0].follow.startswith("not"):
            raise ValueError("a pattern can't begin with a negative step")


def _two(condition: Callable) -> Condition:
    needed = condition.__code__.co_argcount - len(condition.__defaults__ or ())
    return condition if needed >= 2 else lambda e, m: condition(e)


@dataclasses.dataclass
class Run:
    """A partial match: the step it is in, how often that was met, events by step name, start time and event numbers."""

    at: int
    count: int
    events: dict[str, list[Event]]
    start: float | None
    numbers: tuple[int, ...]
    last: int
    stopped: bool = False

    def taken(self, step: Step, at: int, event: Event, time: float, n: int) -> Run:
        events = {k: list(v) for k, v in self.events.items()}
        events.setdefault(step.name, []).append(event)
        return Run(at, self.count + 1 if at == self.at else 1, events, time if self.start is None else self.start, (*self.numbers, n), n)


class Matcher:
    """Feeds ordered events of one key; ``feed`` returns the finished matches and the timed-out partial matches."""

    def __init__(self, pattern: Pattern):
        pattern.validate()
        self.pattern, self.runs, self.n, self.blocked = pattern, [], 0, -1

    def _ready(self, run: Run) -> list[tuple[int, str | None]]:
        """Positive steps that may come next, past optional ones, with the follow kind that leads there."""
        steps, out = self.pattern.steps, []
        i = run.at + 1 if run.at >= 0 else 0
        while i < len(steps):
            if steps[i].follow.startswith("not"):
                i += 1
                continue
            out.append((i, "any" if run.at < 0 else steps[i].follow))
            if not steps[i].optional:
                break
            i += 1
        return out

    def _complete(self, run: Run) -> bool:
        steps = self.pattern.steps
        if run.at < 0 or run.count < steps[run.at].least:
            return False
        return all(s.optional or s.follow.startswith("not") for s in steps[run.at + 1 :])

    def _negated(self, run: Run, event: Event, n: int) -> bool:
        """Whether a negative step between the run and its next positive step meets this event."""
        for step in self.pattern.steps[run.at + 1 :]:
            if step.follow == "not_next" and n == run.last + 1 and step.condition(event, run.events):
                return True
            if step.follow == "not_follow" and step.condition(event, run.events):
                return True
            if not step.follow.startswith("not"):
                break
        return False

    def feed(self, event: Event, time: float) -> tuple[list[Run], list[Run]]:
        steps, limit, n = self.pattern.steps, self.pattern.limit, self.n
        self.n += 1
        expired = [r for r in self.runs if limit is not None and time - r.start >= limit]
        alive = [r for r in self.runs if not (limit is not None and time - r.start >= limit)]
        new: list[Run] = []
        done: list[Run] = []
        for run in [*alive, Run(-1, 0, {}, None, (), n - 1)]:
            fresh = run.at < 0
            step = None if fresh else steps[run.at]
            took = False
            satisfied = fresh or run.count >= step.least
            if not fresh and step.until and not run.stopped and step.until(event, run.events):
                run = dataclasses.replace(run, stopped=True)
            if satisfied and not fresh and self._negated(run, event, n):
                continue
            if not fresh and not run.stopped and (step.most is None or run.count < step.most):
                near = n == run.last + 1
                if (near or not step.consecutive) and step.condition(event, run.events):
                    new.append(run.taken(step, run.at, event, time, n))
                    took = True
                elif step.consecutive and not satisfied:
                    continue
            if satisfied and not (took and not fresh and step.greedy):
                for i, follow in self._ready(run):
                    near = n == run.last + 1
                    if (follow != "strict" or near) and steps[i].condition(event, run.events):
                        new.append(run.taken(steps[i], i, event, time, n))
                        took = took or follow != "any"
            if fresh:
                continue
            more = step.most is None or run.count < step.most
            can_wait = any(f != "strict" for _, f in self._ready(run)) if satisfied else True
            loop_wait = more and not step.consecutive and not run.stopped
            if (not took or (loop_wait and step.combinations) or any(f == "any" for _, f in self._ready(run)) and satisfied) and (can_wait or loop_wait):
                if satisfied and not self._ready(run) and not loop_wait:
                    continue
                new.append(run)
        done = [r for r in new if r.last == n and self._complete(r)]
        self.runs = [r for r in new if not (self._complete(r) and not self._open(r))]
        done = self._skip(done)
        return done, expired

    def _open(self, run: Run) -> bool:
        step = self.pattern.steps[run.at]
        return (step.most is None or run.count < step.most) and not run.stopped or bool(self._ready(run))

    def _skip(self, done: list[Run]) -> list[Run]:
        strategy, name = self.pattern.skip
        if strategy == "no_skip" or not done:
            return done
        done = [r for r in sorted(done, key=lambda r: r.numbers) if r.numbers[0] > self.blocked]
        out = []
        for run in done:
            if run.numbers[0] <= self.blocked:
                continue
            out.append(run)
            if strategy == "skip_past_last_event":
                self.blocked = run.numbers[-1]
            else:
                order = [k for k, v in run.events.items() for _ in v]
                at = [n for n, k in zip(run.numbers, order, strict=True) if k == name]
                if at:
                    self.blocked = (at[0] if strategy == "skip_to_first" else at[-1]) - 1
        self.runs = [r for r in self.runs if r.numbers[0] > self.blocked]
        return out


def find(pattern: Pattern, events: Iterator[Event] | list[Event], time: str) -> tuple[list[Run], list[Run]]:
    """All matches and timeouts over the ordered events of one key."""
    matcher, matches, timeouts = Matcher(pattern), [], []
    for event in events:
        found, expired = matcher.feed(event, event[time])
        matches += found
        timeouts += expired
    return matches, timeouts


def match(df: DataFrame, pattern: Pattern, key: str, order: str, select: Callable[[dict[str, list[Event]]], tuple | list[tuple]], schema: str, timeouts: bool = False) -> DataFrame:
    """Matches (or timed-out partial matches) of every key over a batch.

    ``select`` maps step names to events and gives a row or a list of rows. ``order`` must be numeric or a timestamp
    (then in seconds).
    """
    columns = [part.strip().split()[0] for part in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        seconds = frame[order].astype("int64") / 1e9 if str(frame[order].dtype).startswith("datetime64[ns") else frame[order].astype("datetime64[ns]").astype("int64") / 1e9 if str(frame[order].dtype).startswith("datetime64") else frame[order]
        events = frame.assign(__time=seconds).to_dict("records")
        found = find(pattern, events, "__time")[1 if timeouts else 0]
        rows = []
        for r in found:
            row = select(r.events)
            rows += row if isinstance(row, list) else [row]
        return pd.DataFrame(rows, columns=columns)

    return df.groupBy(key).applyInPandas(run, schema)


def sequence(df: DataFrame, key: str, order: list[str], steps: list[tuple[str, Column, str]]) -> DataFrame:
    """Matches of a plain sequence: one struct column per step, from its name, condition and follow kind.

    ``strict`` asks for the very next event, ``relaxed`` for the next one that meets the condition; the kind of the first
    step doesn't matter. All steps share one shuffle and one sort, and each is a running function of it.
    """
    back = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    event = F.struct(*df.columns)
    rows = df.withColumn("__tail", F.array(event))
    for i in range(len(steps) - 1, 0, -1):
        _, condition, follow = steps[i]
        here = F.when(condition, F.col("__tail"))
        after = F.lag(here).over(back) if follow == "strict" else F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__tail", F.concat(F.array(event), F.coalesce(after, F.array().cast(f"array<{_struct_type(df)}>"))))
    found = rows.where(steps[0][1] & (F.size("__tail") == len(steps)))
    return found.select(*[F.col("__tail")[i].alias(name) for i, (name, _, _) in enumerate(steps)])


def _struct_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{name}`:{kind}" for name, kind in df.dtypes) + ">"


class _Stream(StatefulProcessor):
    """The matcher of each key, kept as bytes; rows of a micro-batch are fed in (time, id) order."""

    def __init__(self, pattern: bytes, select: bytes, columns: list[str], timeouts: bool):
        self.pattern, self.select, self.columns, self.timeouts = pattern, select, columns, timeouts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("matcher", "runs binary, n bigint, blocked bigint, last double")
        self.made, self.row = pickle.loads(self.pattern), pickle.loads(self.select)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        matcher, last = Matcher(self.made), float("-inf")
        if self.state.exists():
            runs, matcher.n, matcher.blocked, last = self.state.get()
            matcher.runs = [Run(*r) for r in pickle.loads(runs)]
        frame = pd.concat(list(rows)).sort_values(["in_time", "in_id"], kind="stable")
        out = []
        times = frame["in_time"].tolist()
        frame = frame[[c for c in frame.columns if c.startswith("e_")]].rename(columns=lambda c: c[2:])
        for time, event in zip(times, frame.to_dict("records"), strict=True):
            if time < last:  # behind what was matched already
                continue
            last = time
            found, expired = matcher.feed(event, last)
            for run in expired if self.timeouts else found:
                made = self.row(run.events)
                out += made if isinstance(made, list) else [made]
        self.state.update((pickle.dumps([(r.at, r.count, r.events, r.start, r.numbers, r.last, r.stopped) for r in matcher.runs]), matcher.n, matcher.blocked, last))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def match_stream(stream: DataFrame, pattern: Pattern, key: str, ts: str, ident: str, select: Callable[[dict[str, list[Event]]], tuple | list[tuple]], schema: str, timeouts: bool = False) -> DataFrame:
    """Matches (or partial matches that ran out of time) of every key of a stream, as they are found.

    Rows of a key count in order of ``ts`` and ``ident`` within a micro-batch; a row that is older than one of an earlier
    micro-batch is dropped. State per key is its partial matches, which ``within`` bounds.
    """
    from lattica.streaming.stateful import _key

    pattern.validate()
    _key(stream, key)
    time = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = stream.select(F.col(key).alias("key"), time.alias("in_time"), F.col(ident).alias("in_id"), *[F.col(c).alias(f"e_{c}") for c in stream.columns if c != key], F.coalesce(key, key).alias(f"e_{key}"))  # not the key's own column, which workers don't get twice
    processor = _Stream(cloudpickle.dumps(pattern), cloudpickle.dumps(select), [part.strip().split()[0] for part in schema.split(",")], timeouts)
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "None")
