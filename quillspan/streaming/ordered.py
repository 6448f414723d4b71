"""Step functions over a stream of frames that may arrive in any order: a reorder buffer, look-ahead and timers for each key.

A frame is (key, i, x), with i counting from 0 and x a number or a list of them. It may come in any file, batch or order; the state keeps what has come too
early and hands frames on in the order of i. `last` marks the final frame of a key, after which its pending rows are given
out and its state is dropped. With an event time `ts` and a watermark on the stream, a key from which nothing has come for
`patience` is closed as well: frames that never came count as not detected and give no row. Frames that come again, or after
their place has been passed, are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOLD = 8
#: Groups into which keys without timers are dealt: a call, and a batch of rows between Spark and Python, serves one of them.
BUCKETS = 1024
#: Rows that leave a call in one batch.
ROWS = 1 << 16


class Steps:
    """A plain step function as a walker: one row (i, y) for each frame, at once."""

    value, columns = "double", "y double"

    def __init__(self, step: Callable):
        self.step = step

    def push(self, state, i: int, x: float | None):
        state, y = self.step(tuple(state) if isinstance(state, list) else state, x)
        return state, [(i, y)]

    def close(self, state) -> list[tuple]:
        return []


class GapBridge:
    """The bridged value and its weight; a frame without a value waits until what lies after the gap is known.

    Waiting are at most `hold` frames: before the first value those that it can still reach, after a value those that it
    reaches. What waits is faded in, glides to the next value, or fades out when the key ends.
    """

    value, columns = "double", "y double, alpha double"

    def __init__(self, hold: int = HOLD):
        self.hold = hold

    def push(self, state, i: int, x: float | None):
        seen, waiting = state or (None, [])
        if x is not None:
            rows = [self._reached(seen, j, i, x) for j in waiting]
            return ((i, x), []), [*rows, (i, x, 1.0)]
        if seen is not None and i - seen[0] > self.hold:
            return (seen, waiting), [(i, None, 0.0)]
        waiting = [*waiting, i]
        n = 0 if seen is not None else sum(i + 1 - j > self.hold for j in waiting)  # the next value comes after i at the earliest
        return (seen, waiting[n:]), [(j, None, 0.0) for j in waiting[:n]]

    def _reached(self, seen, j: int, i: int, x: float) -> tuple:
        if seen is None:
            return (j, x, 1.0 - (i - j) / float(self.hold))
        return (j, self.glide(seen[1], x, (j - seen[0]) / (i - seen[0])), 1.0)

    def glide(self, a, b, t: float):
        return a + ((a * (1 - t) + b * t) - a)

    def close(self, state) -> list[tuple]:
        seen, waiting = state or (None, [])
        return [(j, None, 0.0) if seen is None else (j, seen[1], 1.0 - (j - seen[0]) / float(self.hold)) for j in waiting]


class HandBridge(GapBridge):
    """The same for a hand, a list of coordinates x, y, x, y and so on with the wrist first: in a gap the last hand seen keeps
    its shape and moves with the wrist, which slides to where the next hand has it."""

    value, columns = "array<double>", "hand array<double>, alpha double"

    def glide(self, a: list[float], b: list[float], t: float) -> list[float]:
        shift = [(a[c] * (1 - t) + b[c] * t) - a[c] for c in (0, 1)]
        return [p + shift[k % 2] for k, p in enumerate(a)]


class Walk:
    """What a key has so far: the next place, the walker's state, frames that came too early, the place of the final one."""

    def __init__(self, walker, kept: tuple | None = None):
        self.walker = walker
        self.next, state, at, x, self.last = kept or (0, "null", [], [], -1)
        self.state, self.early = json.loads(state), dict(zip(at, map(json.loads, x), strict=True))

    def add(self, i: int, x: float | None, last: bool) -> None:
        if i >= self.next:
            self.early.setdefault(i, x)
        if last:
            self.last = i

    def go(self) -> list[tuple]:
        rows: list[tuple] = []
        while self.next in self.early:
            self.state, more = self.walker.push(self.state, self.next, self.early.pop(self.next))
            rows += more
            self.next += 1
        return rows

    @property
    def over(self) -> bool:
        return 0 <= self.last < self.next

    def end(self) -> list[tuple]:
        """All that is left, in order, with the frames between as not detected."""
        rows, missing = [], []
        for i in sorted(self.early):
            missing.append(range(self.next, i))
            for j in missing[-1]:
                self.state, more = self.walker.push(self.state, j, None)
                rows += more
            self.next = max(self.next, i)
            rows += self.go()
        return [r for r in rows + self.walker.close(self.state) if not any(r[0] in m for m in missing)]

    def kept(self) -> tuple:
        at = sorted(self.early)
        return self.next, json.dumps(self.state), at, [json.dumps(self.early[i]) for i in at], self.last


class OrderedProcessor(StatefulProcessor):
    def __init__(self, walker, patience_ms: int | None = None):
        self.walker, self.patience_ms = walker, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("walk", "next long, state string, at array<long>, x array<string>, last long")

    def _value(self, x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return list(map(float, x)) if self.walker.value != "double" else x

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            kinds = dict(c.split() for c in self.walker.columns.split(", "))
            out = pd.DataFrame(rows, columns=["i", *kinds]).astype({n: "float64" for n, kind in kinds.items() if kind == "double"})
            out.insert(0, "key", key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk, latest = Walk(self.walker, self.state.get() if self.state.exists() else None), None
        for pdf in rows:
            for i, x, last in zip(pdf["i"].tolist(), pdf["x"].tolist(), pdf["last"].tolist(), strict=True):
                walk.add(i, self._value(x), bool(last))
            if self.patience_ms is not None and len(pdf):
                latest = max(latest or 0, int(pdf["ts"].max().timestamp() * 1000))
        out = walk.go()
        if walk.over:
            out += walk.walker.close(walk.state)
            self.state.clear()
        else:
            self.state.update(walk.kept())
        if latest is not None:
            due = max([latest + self.patience_ms, *(old := list(self.handle.listTimers()))])
            for t in old:
                self.handle.deleteTimer(t)
            if not walk.over:
                self.handle.registerTimer(due)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            rows = Walk(self.walker, self.state.get()).end()
            self.state.clear()
            yield from self._rows(key, rows)

    def close(self) -> None:
        pass


class BucketProcessor(OrderedProcessor):
    """The same without timers for all keys of a bucket at once; each key has its own entry in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("walks", "key string", "next long, state string, at array<long>, x array<string>, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walks: dict = {}
        for pdf in rows:
            for k, i, x, last in zip(pdf["key"].tolist(), pdf["i"].tolist(), pdf["x"].tolist(), pdf["last"].tolist(), strict=True):
                if (walk := walks.get(k)) is None:
                    walk = walks[k] = Walk(self.walker, self.state.getValue(self._name(k)))
                walk.add(i, self._value(x), bool(last))
        out: list[tuple] = []
        for k, walk in walks.items():
            done = walk.go()
            if walk.over:
                done += walk.walker.close(walk.state)
                self.state.removeKey(self._name(k))
            else:
                self.state.updateValue(self._name(k), walk.kept())
            out += [(k, *r) for r in done]
            if len(out) >= ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    def _name(self, k: str | None) -> tuple[str]:
        return ("" if k is None else "=" + k,)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = dict(c.split() for c in self.walker.columns.split(", "))
        return pd.DataFrame(rows, columns=["key", "i", *kinds]).astype({n: "float64" for n, kind in kinds.items() if kind == "double"})


def walk_stream(stream: DataFrame, walker, patience: str | None = None) -> DataFrame:
    """key, i and the walker's columns in append mode, of a stream of (key, i, x) and, where it has them, last and ts.

    patience: how long after its latest ts a key is closed, like "30 seconds"; needs ts. A stream with patience gets a
    watermark without delay unless it has one.
    """
    d = stream if "last" in stream.columns else stream.withColumn("last", F.lit(False))
    if patience is not None and not d._jdf.queryExecution().analyzed().toString().count("EventTimeWatermark"):
        d = d.withWatermark("ts", "0 seconds")
    ms = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)
    if ms is None:
        d = d.select("key", "i", "x", "last", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        return d.groupBy("bucket").transformWithStateInPandas(statefulProcessor=BucketProcessor(walker), outputStructType=f"key string, i long, {walker.columns}", outputMode="Append", timeMode="None")
    columns = ["key", "i", "x", "last", "ts"]
    return d.select(*columns).groupBy("key").transformWithStateInPandas(
        statefulProcessor=OrderedProcessor(walker, ms), outputStructType=f"key string, i long, {walker.columns}", outputMode="Append", timeMode="EventTime"
    )


def gap_bridge_stream(stream: DataFrame, hold: int = HOLD, patience: str | None = None) -> DataFrame:
    """key, i, y, alpha: what series.gap_bridge() gives, for frames that come in any order."""
    return walk_stream(stream, GapBridge(hold), patience)


def hand_bridge_stream(stream: DataFrame, hold: int = HOLD, patience: str | None = None) -> DataFrame:
    """key, i, hand, alpha: what landmarks.hand_bridge() gives, of hands x as lists of coordinates that come in any order."""
    return walk_stream(stream, HandBridge(hold), patience)
