"""Running state over streams of frames, in frame order although rows arrive out of order.

Rows wait in a map state, one entry a row, until the watermark has passed them; a timer then takes
what is due in order and hands it to the same step functions that the batch operators use. Entries
are added and removed one by one, never rewritten. State ends: a key that has been silent for long
enough in event time is removed by its timer.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

IDLE_MS = 60_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(x):
    x = x.item() if hasattr(x, "item") else x
    return None if isinstance(x, float) and math.isnan(x) else x


class _Ordered(StatefulProcessor):
    """``step(state, rows) -> (state, tuples)`` for the rows of each value of ``order`` in turn."""

    def __init__(self, keys, order, time, cols, types, state_types, start, step, finish, idle_ms, names, late):
        self.keys, self.order, self.time, self.cols, self.types = keys, order, time, cols, types
        self.state_types, self.start, self.step, self.finish = state_types, start, step, finish
        self.idle_ms, self.names, self.late = idle_ms, names, late

    def init(self, handle):
        self.handle = handle
        at = ", ".join(f"{c} bigint" for c in self.order)
        self.waiting = handle.getMapState("waiting", at, ", ".join(["at_us bigint", *[f"c{i} {t}" for i, t in enumerate(self.types)]]))
        self.state = handle.getValueState("state", self.state_types)
        # the last value of the first order column that was decided, its time, and the pending timer
        self.mark = handle.getValueState("mark", "last bigint, at_us bigint, timer bigint")

    def _marks(self):
        return tuple(self.mark.get()) if self.mark.exists() else (None, None, None)

    def _set_timer(self, old, new):
        if old is not None and new is not None and old <= new:
            return old
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)
        return new

    def _frame(self, key, rows):
        out = pd.DataFrame(rows, columns=[self.order[0], self.time, *self.names, *(["late"] if self.late else [])])
        for k, v in zip(reversed(self.keys), reversed(key)):
            out.insert(0, k, v)
        return out

    def handleInputRows(self, key, rows, timerValues):
        last, at_us, timer = self._marks()
        late, first = [], None
        for pdf in rows:
            for r in pdf[[*self.order, self.time, *self.cols]].itertuples(index=False):
                n = len(self.order)
                place, t = tuple(int(x) for x in r[:n]), int(pd.Timestamp(r[n]).value // 1000)
                if last is not None and place[0] <= last:
                    late.append((place[0], pd.Timestamp(t, unit="us"), *[None] * len(self.names), True))
                elif not self.waiting.containsKey(place):  # else a repeat: the first one counts
                    self.waiting.updateValue(place, (t, *map(_plain, r[n + 1:])))
                    first = t if first is None else min(first, t)
        due = None if first is None else first // 1000 + 1
        # a timer for the end of a silent key gives way to one for waiting rows
        if due is not None and (timer is None or due < timer):
            timer = self._set_timer(timer, due)
        self.mark.update((last, at_us, timer))
        if self.late and late:
            yield self._frame(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, at_us, _ = self._marks()
        due, ahead = {}, None
        for place, value in self.waiting.iterator():
            if value[0] <= now:
                due.setdefault(int(place[0]), []).append((tuple(place), tuple(value)))
            else:
                ahead = value[0] if ahead is None else min(ahead, value[0])
        state, out = (tuple(self.state.get()) if self.state.exists() else self.start), []
        for at in sorted(due):
            rows = sorted(due[at])
            for place, _ in rows:
                self.waiting.removeKey(place)
            t = pd.Timestamp(rows[0][1][0], unit="us")
            if last is not None and at <= last:  # rows of a frame that came apart
                out += [(at, t, *[None] * len(self.names), True)] * len(rows) if self.late else []
                continue
            last, at_us = at, rows[0][1][0]
            named = [dict(zip((*self.order, *self.cols), (*place, *value[1:]))) for place, value in rows]
            state, found = self.step(state, named)
            out += [(at, t, *f, *([False] if self.late else [])) for f in found]
        if ahead is None and at_us is not None and now >= at_us + 1000 * self.idle_ms:
            row = self.finish(state) if self.finish and state is not None else None
            if row is not None:
                out.append((last, pd.Timestamp(at_us, unit="us"), *row, *([False] if self.late else [])))
            for s in (self.state, self.mark, self.waiting):
                s.clear()
        else:
            if state is not None:
                self.state.update(state)
            soon = timerValues.getCurrentWatermarkInMs() + 1
            timer = max(soon, ahead // 1000 + 1 if ahead is not None else at_us // 1000 + self.idle_ms)
            self.handle.registerTimer(timer)
            self.mark.update((last, at_us, timer))
        if out:
            yield self._frame(key, out)

    def close(self):
        pass


def ordered_state(stream: DataFrame, keys, cols, start, state_types: str, step, output: str, delay: str, order="frame_id",
                  time="event_time", finish=None, idle_ms: int = IDLE_MS, late=False, whole_frames=False) -> DataFrame:
    """Apply ``step(state, row) -> (state, tuple or None)`` to each key's rows in ``order``; a tuple is
    a row of output. A key without rows for ``idle_ms`` (in event time) has ended: its state is
    removed, after ``finish(state)`` has given a last tuple or None.

    stream: keys, ``order`` (one column, or several of which the first is the frame), ``time``
    (timestamp) and ``cols``. States are tuples of ``state_types``, ``start`` the first (None: none
    yet). With ``whole_frames`` a step gets all rows of a frame and gives a list of tuples. ``output``
    names the tuple's fields with types; keys, frame and time are put before them.

    Of repeated rows the first that arrives counts. A row whose frame is not after the last one
    decided is late: with ``late`` it comes out marked so (column late, other fields NULL), else it
    is left out. Rows behind the watermark never arrive here; Spark counts them
    (``rows_behind_watermark``). The session needs the RocksDB state store (``ROCKSDB``).
    """
    keys, cols = list(keys), list(cols)
    order = [order] if isinstance(order, str) else list(order)
    names = [f.strip().split()[0] for f in output.split(",")]
    head = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{head}, {order[0]} bigint, {time} timestamp, {output}" + (", late boolean" if late else "")

    def by_row(state, rows):
        out = []
        for r in rows:
            state, row = step(state, r)
            if row is not None:
                out.append(row)
        return state, out

    types = [stream.schema[c].dataType.simpleString() for c in cols]
    p = _Ordered(keys, order, time, cols, types, state_types, start, step if whole_frames else by_row, finish, idle_ms, names, late)
    s = stream.select(*keys, *order, time, *cols).withWatermark(time, delay)
    return s.groupBy(*keys).transformWithStateInPandas(p, schema, "Append", "eventTime")


def rows_behind_watermark(query) -> int:
    """Rows that the query's stateful operators have dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
