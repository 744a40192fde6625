"""Stateful operators over the event log that give the same rows however the log is cut into micro-batches.

Events wait in state until the watermark has passed them and are then applied in the order of (created_at, seq), so a
result depends on the events and the last watermark alone. Timers of event time wake a cell of keys for its next waiting
event and for its next deadline. State that expires by itself (TTL) goes by the clock of the machine, which would make results
depend on when a batch runs; what is done with is removed by the operators instead.

Rows of equal (created_at, seq) in a group are one event; rows without a time, or behind the watermark, do not count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from speechlake.operators.operations import STALE_SECONDS

Row = tuple
#: Groups that keys are dealt to.
CELLS = 2048


class InOrder(StatefulProcessor):
    """Applies the events of every key of a cell in order. A subclass says what an event does to what is known of its key, what silence up to a time means, and when a key next wants to be woken.

    Keys are dealt to cells by hash, and a cell is what Spark groups by: what waits in it and what is known of its keys
    are one value each, read and written once a batch. A value for each key or event would be a call to the state store for each.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str], more: Sequence[str] = ()):
        self.keys, self.columns, self.more = tuple(keys), tuple(columns), tuple(more)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")
        self.known = handle.getValueState("known", "keys binary")
        self.alarm = handle.getValueState("alarm", "ms long")

    def first(self, more: Row) -> list:
        """What is known of a key with its first event, as a list that events change."""
        raise NotImplementedError

    def apply(self, state: list, at: int, seq: int, kind: str, item: str | None) -> list[Row]:
        raise NotImplementedError

    def quiet(self, state: list, now_us: int) -> list[Row]:
        return []

    def deadline_us(self, state: list) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...

    def _advance(self, frames: list[pd.DataFrame], now_ms: int) -> Iterator[pd.DataFrame]:
        held: dict = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        known: dict = pickle.loads(self.known.get()[0]) if self.known.exists() else {}
        for frame in frames:
            keys = zip(frame["none"].tolist(), *[frame[k].tolist() for k in self.keys])
            more = zip(*[frame[c].tolist() for c in self.more]) if self.more else repeat(())
            items = frame["item"].astype(object).where(frame["item"].notna(), None).tolist()
            for key, own, at, seq, kind, item in zip(keys, more, frame["at"].tolist(), frame["seq"].tolist(), frame["kind"].tolist(), items):
                if key not in known:
                    known[key] = self.first(own)
                held.setdefault(key, {})[at, seq] = (kind, item)
        now_us, out, wakes = now_ms * 1000, [], []
        for key, waiting in list(held.items()):
            ready = sorted(e for e in waiting if e[0] <= now_us)
            for at, seq in ready:
                out += [(key, row) for row in self.apply(known[key], at, seq, *waiting.pop((at, seq)))]
            if waiting:
                wakes.append(-(-min(waiting)[0] // 1000))
            else:
                del held[key]
        for key, state in known.items():
            out += [(key, row) for row in self.quiet(state, now_us)]
            if (due := self.deadline_us(state)) is not None:
                wakes.append(due // 1000 + 1)
        self.held.update((pickle.dumps(held),))
        self.known.update((pickle.dumps(known),))
        before = self.alarm.get()[0] if self.alarm.exists() else None
        after = min(wakes, default=None)
        if before != after:
            if before is not None and before > now_ms:
                self.handle.deleteTimer(before)
            if after is None:
                self.alarm.clear()
            else:
                self.alarm.update((after,))
                self.handle.registerTimer(after)
        if out:
            rows = [(*[None if none >> i & 1 else k for i, k in enumerate(key)], *row) for (none, *key), row in out]
            yield pd.DataFrame(rows, columns=list(self.columns), dtype=object)


class StaleSteps(InOrder):
    """Leases of steps: a heartbeat takes one, an end closes it, silence loses it and uses up an attempt. Known of a step: state, beat, seq, attempt, most, optional."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], ends: Sequence[str], seconds: int):
        super().__init__(keys, columns, ["attempt", "max_attempts", "optional"])
        self.ends, self.limit = tuple(ends), seconds * 1_000_000

    def first(self, more: Row) -> list:
        attempt, most, optional = more
        return ["pending", 0, 0, int(attempt), int(most), bool(optional)]

    def apply(self, state: list, at: int, seq: int, kind: str, item: str | None) -> list[Row]:
        out = self.quiet(state, at)
        if state[0] in ("pending", "running") and kind not in self.ends:
            state[:3] = "running", at, seq
        elif state[0] == "running":
            state[:3] = "done", 0, 0
        return out

    def quiet(self, state: list, now_us: int) -> list[Row]:
        if state[0] != "running" or now_us - state[1] <= self.limit:
            return []
        _, _, seq, attempt, most, optional = state
        attempt += 1
        outcome = ("skipped" if optional else "dead") if attempt >= most else "pending"
        state[:4] = outcome, 0, 0, attempt
        return [(seq, attempt, outcome)]

    def deadline_us(self, state: list) -> int | None:
        return state[1] + self.limit if state[0] == "running" else None


class CancelledItems(InOrder):
    """Work of a run that waits, and the run's first cancel: what waits then, or is queued later, is cancelled once; what had started stays. Known of a run: its cancel, what is open by item, items that have gone."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], queues: Sequence[str], starts: Sequence[str], cancels: Sequence[str]):
        super().__init__(keys, columns)
        self.queues, self.starts, self.cancels = tuple(queues), tuple(starts), tuple(cancels)

    def first(self, more: Row) -> list:
        return [None, {}, set()]

    def apply(self, state: list, at: int, seq: int, kind: str, item: str | None) -> list[Row]:
        cancel, waits, gone = state
        if kind in self.cancels and cancel is None:
            out = sorted((i, s, seq) for i, s in waits.items())
            state[:] = seq, {}, set(waits)
            return out
        if item is None:
            return []
        if kind in self.queues and cancel is not None:
            if item not in gone:
                gone.add(item)
                return [(item, seq, cancel)]
        elif kind in self.queues:
            waits.setdefault(item, seq)
        elif kind in self.starts and cancel is None:
            waits.pop(item, None)
        return []


def _events(events: DataFrame, keys: Sequence[str], late: str, item: Column, more: Sequence[str] = ()) -> DataFrame:
    timed = events.where(F.col("created_at").isNotNull()).withWatermark("created_at", late)
    # a null in a column of numbers would make them all floats in pandas, so nulls of keys are told by bits
    none = reduce(lambda a, b: a + b, [F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)])
    filled = [F.coalesce(F.col(k), F.lit(0).cast(events.schema[k].dataType)).alias(k) for k in keys]
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("cell")
    return timed.select(cell, none.alias("none"), *filled, F.unix_micros("created_at").alias("at"), F.col("seq").cast("long").alias("seq"), "kind", item.cast("string").alias("item"), *more, "created_at")


def _typed(frame: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in columns)


def stale_steps(events: DataFrame, keys: Sequence[str], ends: Sequence[str], late: str = "0 seconds", seconds: int = STALE_SECONDS) -> DataFrame:
    """keys, seq, attempt, outcome for each lease that was lost: the heartbeat ``seq`` was followed by more than ``seconds`` of silence.

    events: keys, created_at, seq, kind, and of the step attempt, max_attempts, optional, equal in all its rows. A kind
    in ``ends`` ends a running step, any other is a heartbeat and takes the lease of a pending one. A lost lease uses up
    an attempt; the outcome is pending, or when attempts are used up dead, or skipped if the step is optional. A step
    that is done, dead or skipped stays so. Told is what is lost at the watermark.
    """
    rows = _events(events, keys, late, F.lit(None), ["attempt", "max_attempts", "optional"])
    out = [*keys, "seq", "attempt", "outcome"]
    return rows.groupBy("cell").transformWithStateInPandas(StaleSteps(keys, out, ends, seconds), f"{_typed(events, keys)}, seq long, attempt int, outcome string", "Append", "EventTime")


def cancelled_items(events: DataFrame, keys: Sequence[str], queues: Sequence[str], starts: Sequence[str], cancels: Sequence[str], late: str = "0 seconds") -> DataFrame:
    """keys, item, seq, cancel: work that a cancel of its run keeps from starting, however long before the cancel came.

    events: keys, created_at, seq, kind, item. Each item counts once; ``seq`` is what queued it, ``cancel`` the run's
    first cancel. An item that had started by then stays, unless it is queued again.
    """
    rows = _events(events, keys, late, F.col("item"))
    out = [*keys, "item", "seq", "cancel"]
    return rows.groupBy("cell").transformWithStateInPandas(CancelledItems(keys, out, queues, starts, cancels), f"{_typed(events, keys)}, item string, seq long, cancel long", "Append", "EventTime")
