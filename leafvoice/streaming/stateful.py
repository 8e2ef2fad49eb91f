"""Structured Streaming forms of the playback rules.

State is kept per key in the RocksDB state store; timers run on event time, and the watermark bounds how
late an update may be. Output of a key that has gone quiet appears when the watermark passes its timer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from leafvoice.functions import fixed
from leafvoice.operators.playback import IDLE_MS

#: Groups of keys whose rows are put in order together.
PARTS = 2048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class CoalesceUpdates(StatefulProcessor):
    """The first update of a key starts a wait of ``delay_ms``; its end writes the latest value."""

    FIELDS = "ms bigint, event_id bigint, kind string, value double"
    OUTPUT = "key string, fired_at_ms bigint, updates bigint, event_id bigint, value double"

    def __init__(self, delay_ms: int = fixed.DEBOUNCE_MS):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.FIELDS)

    def _rows(self) -> list[tuple]:
        return sorted((tuple(r) for r in self.pending.get()), key=lambda r: r[:2])

    def _keep(self, rows: list[tuple]) -> None:
        """Store what still waits and keep exactly one timer, at the end of the first wait."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rows:
            self.pending.put(rows)
            self.handle.registerTimer(rows[0][0] + self.delay_ms)
        else:
            self.pending.clear()

    def _write(self, key, fired: int, wait: list[tuple]) -> dict:
        last = wait[-1]
        return {"key": key[0], "fired_at_ms": fired, "updates": len(wait), "event_id": last[1], "value": last[3]}

    def _fire(self, key, rows: list[tuple], upto: int) -> tuple[list[dict], list[tuple]]:
        """Write every wait that has ended by ``upto`` and return the rest."""
        out, begin = [], 0
        while begin < len(rows):
            if rows[begin][2] == "close":
                if rows[begin][0] > upto:
                    break
                begin += 1
                continue
            end, at = rows[begin][0] + self.delay_ms, begin + 1
            while at < len(rows) and rows[at][0] < end and rows[at][2] != "close":
                at += 1
            closed = at < len(rows) and rows[at][0] < end
            fired = rows[at][0] if closed else end
            if fired > upto:
                break
            out.append(self._write(key, fired, rows[begin:at]))
            begin = at + closed
        return out, rows[begin:]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._rows()
        for pdf in rows:
            waiting += [
                (int(m), int(e), str(k), float(v)) for m, e, k, v in zip(pdf["ms"], pdf["event_id"], pdf["kind"], pdf["value"])
            ]
        waiting.sort(key=lambda r: r[:2])
        # Rows of a later batch may still be older than these: only what the watermark has passed is final.
        out, rest = self._fire(key, waiting, timerValues.getCurrentWatermarkInMs())
        self._keep(rest)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, rest = self._fire(key, self._rows(), timerValues.getCurrentWatermarkInMs())
        self._keep(rest)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def coalesce_updates(updates: DataFrame, delay_ms: int = fixed.DEBOUNCE_MS, lateness: str = "10 seconds") -> DataFrame:
    """``updates`` is a stream of (key string, event_id, ts, kind, value). An event of kind ``close``
    writes what is pending at once."""
    rows = updates.withWatermark("ts", lateness).select(
        "key", "event_id", "kind", "value", "ts", F.unix_millis("ts").alias("ms")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        CoalesceUpdates(delay_ms), outputStructType=CoalesceUpdates.OUTPUT, outputMode="Append", timeMode="EventTime"
    )


class WatchStalls(StatefulProcessor):
    """Report a session that plays and has gone silent for longer than its limit."""

    OUTPUT = "key string, stalled_from_ms bigint, limit_ms bigint"

    def __init__(self, seen_ms: int = fixed.STALL_SEEN_MS, unseen_ms: int = fixed.STALL_UNSEEN_MS):
        self.seen_ms, self.unseen_ms = seen_ms, unseen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "ms bigint, event_id bigint, kind string")
        self.seen = handle.getValueState("seen", "seen boolean")

    def _limit(self, seen: bool) -> int:
        return self.seen_ms if seen else self.unseen_ms

    def _settle(self, key, rows: list[tuple], watermark: int) -> list[dict]:
        """Judge the silence after every event the watermark has passed; keep the ones still open."""
        out, seen = [], bool(self.seen.exists() and self.seen.get()[0])
        rows, at = sorted(rows, key=lambda r: r[:2]), 0
        while at < len(rows):
            ms, _, kind = rows[at]
            heard = seen or kind == "boundary"
            limit = self._limit(heard)
            until = rows[at + 1][0] if at + 1 < len(rows) and rows[at + 1][0] <= watermark else None
            if until is None and ms + limit >= watermark:
                break
            if kind in ("play", "boundary") and (until is None or until - ms > limit):
                out.append({"key": key[0], "stalled_from_ms": ms, "limit_ms": limit})
            seen, at = heard, at + 1
        rows = rows[at:]
        self.seen.update((seen,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rows:
            self.recent.put(rows)
            self.handle.registerTimer(rows[0][0] + self._limit(seen or rows[0][2] == "boundary") + 1)
        else:
            self.recent.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.recent.get()]
        for pdf in rows:
            kept += [(int(m), int(e), str(k)) for m, e, k in zip(pdf["ms"], pdf["event_id"], pdf["kind"])]
        out = self._settle(key, kept, timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._settle(key, [tuple(r) for r in self.recent.get()], timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def watch_stalls(events: DataFrame, lateness: str = "1 second", **limits) -> DataFrame:
    """``events`` is a stream of (key string, event_id, ts, kind)."""
    rows = events.withWatermark("ts", lateness).select("key", "event_id", "kind", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(
        WatchStalls(**limits), outputStructType=WatchStalls.OUTPUT, outputMode="Append", timeMode="EventTime"
    )


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time, whatever order they arrive in.

    A row waits in the state until the watermark has passed it; then nothing older can come any more, and the rows that
    are due go through ``step`` one by one. After a silence of more than ``idle_ms`` the key starts anew: ``end`` says what is
    written then, and a timer drops the state of a key that sends no more. Without ``idle_ms`` a key never ends.

    A call to the state store costs far more than a step, and most keys have a few rows. So a group is a part of the keys,
    chosen by hash; its rows and states are read and written at once, and it keeps one timer, the first of its keys'.
    """

    #: Fields of a row, ``ms`` and ``event_id`` first, and of the state, with the last row's ``ms`` first.
    EVENT = STATE = ""

    def __init__(self, keys: list[str], idle_ms: int | None):
        self.keys, self.idle_ms = keys, idle_ms
        self.key_types: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = ", ".join(f"k{i} {t}" for i, t in enumerate(self.key_types))
        self.waiting = handle.getListState("waiting", f"{own}, {self.EVENT}")
        self.state = handle.getListState("state", f"{own}, {self.STATE}")

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, dict | None]:
        """The state after ``row``, and what the row writes."""
        raise NotImplementedError

    def end(self, state: tuple) -> dict | None:
        """What is written when the key falls silent."""
        return None

    def _advance(self, come: list[tuple], watermark: int) -> Iterator[Row]:
        n, due, rest = len(self.keys), {}, []
        for row in chain(self.waiting.get(), come):
            if row[n] >= watermark:
                rest.append(row)
            else:
                due.setdefault(row[:n], []).append(row[n:])
        # Without rows that are due only a silence changes a state.
        states = {r[:n]: r[n:] for r in self.state.get()} if due or self.idle_ms is not None else {}
        changed = bool(due)
        for key, rows in due.items():
            state = states.pop(key, None)
            for row in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
                if self._over(state, row[0]):
                    yield from self._written(key, self.end(state))
                    state = None
                state, written = self.step(state, row)
                yield from self._written(key, written)
            if state is not None:
                states[key] = state
        # Whatever is still to come is not older than the watermark.
        for key in [k for k, state in states.items() if self._over(state, watermark)]:
            yield from self._written(key, self.end(states.pop(key)))
            changed = True
        if due:
            self._store(self.waiting, rest)
        elif come:
            self.waiting.appendList(come)
        if changed:
            self._store(self.state, [key + state for key, state in states.items()])
        self._wake([r[n] + 1 for r in rest] + [s[0] + self.idle_ms + 1 for s in states.values() if self.idle_ms is not None])

    def _written(self, key: tuple, row: dict | None) -> list[Row]:
        return [] if row is None else [Row(**dict(zip(self.keys, key)), **row)]

    def _over(self, state: tuple | None, ms: int) -> bool:
        return state is not None and self.idle_ms is not None and ms - state[0] > self.idle_ms

    def _store(self, kept: ListState, rows: list[tuple]) -> None:
        if rows:
            kept.put(rows)
        else:
            kept.clear()

    def _wake(self, moments: list[int]) -> None:
        """Keep exactly one timer, at the first of ``moments``."""
        next_, timers = min(moments, default=None), list(self.handle.listTimers())
        for at in timers:
            if at != next_:
                self.handle.deleteTimer(at)
        if next_ is not None and next_ not in timers:
            self.handle.registerTimer(next_)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A NaN is no value.
        come = [tuple(None if v != v else v for v in row[2:]) for row in rows]
        yield from self._advance(come, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, processor: InOrder, lateness: str, output: str, parts: int) -> DataFrame:
    """``events`` through ``processor``; rows that come more than ``lateness`` after newer ones are dropped by Spark. The keys
    are dealt into ``parts``: take more where a part's keys and waiting rows would be too many for a task; the number is part
    of the checkpoint."""
    keys = processor.keys
    processor.key_types = [events.schema[k].dataType.simpleString() for k in keys]
    types = ", ".join([f"`{k}` {t}" for k, t in zip(keys, processor.key_types)] + [output])
    fields = [f.split()[0] for f in processor.EVENT.split(", ")[1:]]
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("_part")
    rows = events.where("ts is not null").withWatermark("ts", lateness).select(
        part, "ts", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.unix_millis("ts").alias("ms"), *(F.col(f) for f in fields))
    return rows.groupBy("_part").transformWithState(processor, outputStructType=types, outputMode="Append", timeMode="EventTime")


class InterpolatePosition(InOrder):
    """The last start or boundary is the anchor; a tick runs on from it."""

    EVENT = "ms bigint, event_id bigint, kind string, char bigint, rate double, text_len bigint"
    STATE = "last_ms bigint, anchor_ms bigint, anchor bigint, seen boolean, position bigint"
    OUTPUT = "event_id bigint, position bigint"

    def __init__(self, keys: list[str], idle_ms: int | None, chars_per_sec: int, drift: int):
        super().__init__(keys, idle_ms)
        self.chars_per_sec, self.drift = chars_per_sec, drift

    def step(self, state, row):
        ms, event_id, kind, char, rate, text_len = row
        if kind == "start":
            return (ms, ms, char, False, char), None
        if state is None:
            return None, None
        _, anchor_ms, anchor, seen, position = state
        if kind != "tick":
            return (ms, ms, char, seen or kind == "boundary", max(position, char)), None
        ahead = None if rate is None else anchor + (ms - anchor_ms) / 1000 * self.chars_per_sec * rate
        ends = [x for x in (ahead, anchor + self.drift if seen else None, text_len) if x is not None]
        if ends:
            position = max(position, math.floor(min(ends) + 0.5))
        return (ms, anchor_ms, anchor, seen, position), {"event_id": event_id, "position": position}


def interpolate_position(
    events: DataFrame, keys: list[str], chars_per_sec: int = fixed.CHARS_PER_SEC, drift: int = fixed.MAX_DRIFT_CHARS,
    idle_ms: int | None = IDLE_MS, lateness: str = "10 seconds", parts: int = PARTS,
) -> DataFrame:
    """Stream form of ``playback.interpolate_position``: keys, ``event_id`` and ``position`` of each tick, once the watermark has
    passed it. State per key: its rows of the last ``lateness``, and one anchor until it has been silent for ``idle_ms``."""
    rows = events.where("kind = 'tick' or char is not null").withColumn("char", F.col("char").cast("bigint")).withColumn("text_len", F.col("text_len").cast("bigint"))
    return _in_order(rows, InterpolatePosition(keys, idle_ms, chars_per_sec, drift), lateness, InterpolatePosition.OUTPUT, parts)


class FurthestSoFar(InOrder):
    """The furthest reported offset up to each row."""

    EVENT = "ms bigint, event_id bigint, reported bigint"
    STATE = "last_ms bigint, position bigint"
    OUTPUT = "event_id bigint, position bigint"

    def step(self, state, row):
        ms, event_id, reported = row
        known = [x for x in (state and state[1], reported) if x is not None]
        position = max(known, default=None)
        return (ms, position), {"event_id": event_id, "position": position}


def monotonic_position(boundaries: DataFrame, keys: list[str], idle_ms: int | None = IDLE_MS, lateness: str = "10 seconds", parts: int = PARTS) -> DataFrame:
    """Stream form of ``playback.monotonic_position``: one row per boundary with the furthest offset so far in event time."""
    rows = boundaries.withColumn("reported", F.col("reported").cast("bigint"))
    return _in_order(rows, FurthestSoFar(keys, idle_ms), lateness, FurthestSoFar.OUTPUT, parts)


class PlaybackSessions(InOrder):
    """A clock that a play starts and a pause stops; the session ends with a silence."""

    EVENT = "ms bigint, event_id bigint, kind string, position bigint"
    STATE = "last_ms bigint, started_ms bigint, events bigint, plays bigint, playing boolean, listened_ms bigint, furthest bigint"
    OUTPUT = "started_ms bigint, ended_ms bigint, events bigint, plays bigint, listened_sec double, furthest bigint"

    def step(self, state, row):
        ms, _, kind, position = row
        last, started, events, plays, playing, listened, furthest = state or (ms, ms, 0, 0, False, 0, None)
        listened += ms - last if playing else 0
        playing = kind == "play" or (playing and kind != "pause")
        furthest = max((x for x in (furthest, position) if x is not None), default=None)
        return (ms, started, events + 1, plays + (kind == "play"), playing, listened, furthest), None

    def end(self, state):
        last, started, events, plays, _, listened, furthest = state
        return {"started_ms": started, "ended_ms": last, "events": events, "plays": plays, "listened_sec": listened / 1000, "furthest": furthest}


def playback_sessions(events: DataFrame, keys: list[str], gap_ms: int = IDLE_MS, lateness: str = "10 seconds", parts: int = PARTS) -> DataFrame:
    """Stream form of ``playback.playback_sessions``: a session is written when the watermark is ``gap_ms`` past its last event. A
    pause that comes late, but within ``lateness``, is counted in its place."""
    rows = events.withColumn("position", F.col("position").cast("bigint"))
    return _in_order(rows, PlaybackSessions(keys, gap_ms), lateness, PlaybackSessions.OUTPUT, parts)
