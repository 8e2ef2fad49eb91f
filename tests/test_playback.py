import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from leafvoice import schema
from leafvoice.operators import playback as P
from leafvoice.sources import library as B
from leafvoice.streaming import queries as SQ, stateful as ST
from tests import fixtures, loops

T0 = dt.datetime(2024, 1, 1)
BASE = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def update_events(rng, keys=15):
    out, n = {}, 0
    for k in range(keys):
        ms, rows = 0, []
        for _ in range(rng.randint(1, 60)):
            ms += rng.choice([0, 1, 200, 900, 1000, 1500, 2999, 3000, 3001, 9000])
            rows.append((ms, n, "close" if rng.random() < 0.1 else "save", float(n)))
            n += 1
        out[f"k{k}"] = rows
    return out


@pytest.mark.parametrize("slice_ms", [None, 2000])
def test_coalesce_batch(spark, slice_ms):
    ev = update_events(random.Random(1))
    df = spark.createDataFrame([(k, at(m), i, kind, v) for k, rows in ev.items() for m, i, kind, v in rows],
                               "key string, ts timestamp, event_id long, kind string, value double").repartition(4)
    got = {}
    for r in P.coalesce_updates(df, ["key"], 3000, slice_ms).orderBy("key", "fired_at_ms", "event_id").collect():
        got.setdefault(r.key, []).append((r.fired_at_ms - BASE, r.updates, r.event_id, r.value))
    assert got == {k: w for k, rows in ev.items() if (w := loops.debounced(rows, 3000))}


@pytest.mark.parametrize("slice_ms", [None, 1500])
def test_positions_and_stalls(spark, slice_ms):
    rng = random.Random(2)
    ticks, plays, n = {}, {}, 0
    for k in range(12):
        ms, rows, other = 0, [], []
        n_chars, rate = rng.randint(20, 400), rng.choice([0.5, 1.0, 2.0])
        first = rng.choice(["start", "tick"])
        rows.append((0, n, first, rng.randint(0, 10) if first == "start" else None, rate, n_chars))
        for _ in range(rng.randint(1, 60)):
            n += 1
            ms += rng.choice([120, 120, 500, 1499, 1501, 2499, 2501, 8000])
            kind = rng.choice(["tick"] * 6 + ["boundary"] * 2 + ["start"])
            rows.append((ms, n, kind, rng.randint(0, n_chars) if kind != "tick" else None, rate, n_chars))
            other.append((ms, n, rng.choice(["play", "boundary", "pause", "seek"]), rng.randint(0, 99)))
        ticks[f"k{k}"], plays[f"k{k}"] = rows, other
        n += 1
    df = spark.createDataFrame([(k, i, at(m), kind, c, r, t) for k, rows in ticks.items() for m, i, kind, c, r, t in rows],
                               "key string, event_id long, ts timestamp, kind string, char int, rate double, text_len int")
    got = {(r.key, r.event_id): r.position for r in P.interpolate_position(df, ["key"], slice_ms=slice_ms).collect()}
    assert got == {(k, i): p for k, rows in ticks.items() for i, p in loops.positions(rows).items()}
    df = spark.createDataFrame([(k, i, at(m), kind, p) for k, rows in plays.items() for m, i, kind, p in rows],
                               "key string, event_id long, ts timestamp, kind string, position int")
    got = {}
    for r in P.detect_stalls(df, ["key"], slice_ms=slice_ms).orderBy("stalled_from_ms").collect():
        got.setdefault(r.key, []).append(r.stalled_from_ms - BASE)
    assert got == {k: w for k, rows in plays.items() if (w := loops.stalls(rows))}
    got = {r.key: (r.plays, round(r.listened_sec, 3), r.furthest) for r in P.sessionize_playback(df, ["key"], slice_ms).collect()}
    for k, rows in plays.items():
        total, on = 0, False
        for a, b in zip(rows, rows[1:]):
            on = a[2] == "play" or (on and a[2] != "pause")
            total += (b[0] - a[0]) if on else 0
        assert got[k] == (sum(r[2] == "play" for r in rows), total / 1000, max(r[3] for r in rows))


def test_slices_fit(spark):
    """A burst makes a hot key's slices shorter until none is overfull; other keys aren't cut."""
    rows = [("hot", 1000 * i) for i in range(400)] + [("hot", 200_000 + i) for i in range(300)] + [("cold", 5)] + [("even", 500 * i) for i in range(100)]
    df = spark.createDataFrame([(k, at(m)) for k, m in rows], "key string, ts timestamp")
    assert P.fit_slices(df, ["key"], "ts").collect() == []
    slices = P.fit_slices(df, ["key"], "ts", 50)
    assert sorted(r.key for r in slices.collect()) == ["even", "hot"]
    n = df.join(slices, "key").groupBy("key", F.floor(P.millis("ts") / F.col("slice_ms")).alias("s")).count().agg(F.max("count")).first()[0]
    assert n <= 50 and slices.agg(F.min("slice_ms")).first()[0] >= 1


def test_hot_and_cold_keys_in_one_plan(spark, monkeypatch):
    """Some keys are cut into slices and others aren't: results are those of the loops."""
    monkeypatch.setattr(P, "ROWS_PER_SLICE", 10)
    ev = update_events(random.Random(21))
    df = spark.createDataFrame([(k, at(m), i, kind, v) for k, rows in ev.items() for m, i, kind, v in rows],
                               "key string, ts timestamp, event_id long, kind string, value double").repartition(4)
    assert 0 < P.fit_slices(df, ["key"], "ts").count() < len(ev)
    got = {}
    for r in P.coalesce_updates(df, ["key"], 3000).orderBy("key", "fired_at_ms", "event_id").collect():
        got.setdefault(r.key, []).append((r.fired_at_ms - BASE, r.updates, r.event_id, r.value))
    assert got == {k: w for k, rows in ev.items() if (w := loops.debounced(rows, 3000))}
    plays = late_rows(random.Random(22))
    df = spark.createDataFrame([(k, i, at(m), r[0], r[-1]) for k, rows in plays.items() for m, i, *r in rows],
                               "key string, event_id long, ts timestamp, kind string, position int")
    row = lambda r: (r.key, r.started_ms - BASE, r.ended_ms - BASE, r.events, r.plays, r.listened_sec, r.furthest)
    want = sorted((k, *s) for k, rows in plays.items() for s in loops.sessions([(m, i, kind, p) for m, i, kind, *_, p in rows], 8000))
    assert sorted(row(r) for r in P.playback_sessions(df, ["key"], 8000).collect()) == want


def test_monotonic(spark):
    df = spark.createDataFrame([("s", i, at(i * 700), v) for i, v in enumerate([3, 1, 7, 5, 9])],
                               "key string, event_id long, ts timestamp, reported int")
    got = [r.position for r in P.monotonic_position(df, ["key"], 1000).orderBy("event_id").collect()]
    assert got == [3, 3, 7, 7, 9]


def write_json(path, batches):
    """One file per micro-batch, oldest first."""
    import os
    import time

    os.makedirs(path, exist_ok=True)
    for k, rows in enumerate(batches):
        with open(f"{path}/{k:04d}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(f"{path}/{k:04d}.json", (time.time() - 1000 + k, time.time() - 1000 + k))


def drain(spark, df, mode, tmp, name):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def in_batches(rows, size):
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def test_coalesce_stream(spark, tmp):
    ST.use_rocksdb(spark)
    ev = update_events(random.Random(4), keys=6)
    rows = sorted((m, i, k, kind, v) for k, es in ev.items() for m, i, kind, v in es)
    rows = [{"key": k, "event_id": i, "ts": at(m).isoformat(timespec="milliseconds"), "kind": kind, "value": v} for m, i, k, kind, v in rows]
    # A last event far ahead moves the watermark past every timer.
    rows.append({"key": "end", "event_id": -1, "ts": at(10**8).isoformat(timespec="milliseconds"), "kind": "close", "value": 0.0})
    write_json(f"{tmp}/in", in_batches(rows, 60))
    src = spark.readStream.schema("key string, event_id long, ts timestamp, kind string, value double").option(
        "maxFilesPerTrigger", 1).json(f"{tmp}/in")
    out = drain(spark, ST.coalesce_updates(src, 3000, "1 second"), "append", tmp, "saves")
    got = {}
    for r in out.orderBy("key", "fired_at_ms", "event_id").collect():
        got.setdefault(r.key, []).append((r.fired_at_ms - BASE, r.updates, r.event_id, r.value))
    assert got == {k: w for k, es in ev.items() if (w := loops.debounced(es, 3000))}


def test_stall_stream(spark, tmp):
    ST.use_rocksdb(spark)
    rng = random.Random(5)
    ev, n = {}, 0
    for k in range(5):
        ms, rows = 0, []
        for _ in range(30):
            ms += rng.choice([100, 1499, 1501, 2499, 2501, 8000])
            rows.append((ms, n, rng.choice(["play", "boundary", "pause"])))
            n += 1
        ev[f"k{k}"] = rows
    rows = sorted((m, i, k, kind) for k, es in ev.items() for m, i, kind in es)
    rows = [{"key": k, "event_id": i, "ts": at(m).isoformat(timespec="milliseconds"), "kind": kind} for m, i, k, kind in rows]
    rows.append({"key": "end", "event_id": -1, "ts": at(10**8).isoformat(timespec="milliseconds"), "kind": "pause"})
    write_json(f"{tmp}/in", in_batches(rows, 40))
    src = spark.readStream.schema("key string, event_id long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).json(f"{tmp}/in")
    got = {}
    for r in drain(spark, ST.watch_stalls(src), "append", tmp, "stalls").orderBy("stalled_from_ms").collect():
        got.setdefault(r.key, []).append(r.stalled_from_ms - BASE)
    # The stream also sees the silence after a session's last event.
    assert got == {k: w for k, es in ev.items() if (w := loops.stalls(es + [(10**9, 0, "pause")]))}


def test_native_streams(spark, tmp):
    rows = [{"book_id": f"b{i % 3}", "event_id": i, "updated_at": at(1000 * (i % 7)).isoformat(timespec="milliseconds"), "v": i} for i in range(40)]
    write_json(f"{tmp}/in", in_batches(rows, 10))
    ddl = "book_id string, event_id long, updated_at timestamp, v int"
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(f"{tmp}/in")
    got = drain(spark, SQ.latest_position(src), "complete", tmp, "latest")
    want = B.latest_progress(spark.read.schema(ddl).json(f"{tmp}/in"))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    ev = [{"session_id": "s", "ts": at(m * 60000).isoformat(), "kind": k, "position": p} for m, k, p in
          [(0, "play", 1), (10, "boundary", 9), (20, "pause", 5), (70, "play", 3), (500, "play", 0)]]
    write_json(f"{tmp}/ev", in_batches(ev, 2))
    src = spark.readStream.schema("session_id string, ts timestamp, kind string, position int").option("maxFilesPerTrigger", 1).json(f"{tmp}/ev")
    got = drain(spark, SQ.listening_sessions(src), "append", tmp, "sessions").orderBy("started").collect()
    assert [(r.events, r.plays, r.furthest) for r in got] == [(3, 1, 9), (1, 1, 3)]


def test_incremental(spark, tmp):
    one = spark.createDataFrame(fixtures.book_runs("b1", fixtures.HARBOUR_BOOK), schema.RUNS)
    one.coalesce(1).write.parquet(f"{tmp}/runs")
    seen = []
    src = spark.readStream.schema(schema.RUNS).parquet(f"{tmp}/runs")
    q = SQ.incremental_chapters(src, lambda books, n: seen.append(books.chapters.count()), f"{tmp}/cp")
    q.awaitTermination(240)
    assert seen == [5]


SPEECH = "key string, event_id long, ts timestamp, kind string, char int, rate double, text_len int, position int, reported int"


def late_rows(rng, keys=6, most=60):
    """Rows (ms, id, kind, char, rate, length, position) of each key, in order."""
    out, n = {}, 0
    for k in range(keys):
        ms, rows = rng.randint(0, 5000), []
        for _ in range(rng.randint(1, most)):
            ms += rng.choice([0, 120, 500, 2400, 7999, 8000, 8001, 20_000])
            kind = rng.choice(["tick"] * 5 + ["boundary"] * 2 + ["start", "play", "pause"])
            char = None if kind == "tick" or rng.random() < 0.05 else rng.randint(0, 300)
            rows.append((ms, n, kind, char, rng.choice([0.5, 1.0, None]), rng.choice([300, None]), rng.choice([None, rng.randint(0, 99)])))
            n += 1
        out[f"k{k}"] = rows
    return out


def arriving(spark, tmp, events, lateness, batches, seed):
    """The rows as a stream in micro-batches, each up to ``lateness`` ms late; a last one passes every timer."""
    rng = random.Random(seed)
    rows = [(m + rng.randint(0, lateness - 1), k, m, i, *r) for k, es in events.items() for m, i, *r in es]
    rows.sort()
    size = -(-len(rows) // batches)
    asdict = lambda k, m, i, kind, c, rate, n, p: {"key": k, "event_id": i, "ts": at(m).isoformat(timespec="milliseconds"), "kind": kind, "char": c,
                                                   "rate": rate, "text_len": n, "position": p, "reported": p}
    files = [[asdict(*r[1:]) for r in part] for part in in_batches(rows, size)]
    files.append([asdict("end", 10**9, -1, "tick", None, None, None, None)])
    write_json(f"{tmp}/late", files)
    return spark.readStream.schema(SPEECH).option("maxFilesPerTrigger", 1).json(f"{tmp}/late")


@pytest.mark.parametrize("idle", [None, 8000])
def test_position_stream_equals_batch_and_loop(spark, tmp, idle):
    ST.use_rocksdb(spark)
    ev = late_rows(random.Random(11))
    src = arriving(spark, tmp, ev, 30_000, 4, 1).where("kind in ('tick', 'boundary', 'start')")
    # Without lateness left over the order is the stream's own doing.
    out = drain(spark, ST.interpolate_position(src, ["key"], idle_ms=idle, lateness="30 seconds"), "append", tmp, f"p{idle}")
    got = {(r.key, r.event_id): r.position for r in out.collect()}
    want = {}
    for k, rows in ev.items():
        spoken = [r[:6] for r in rows if r[2] == "tick" or (r[2] in ("boundary", "start") and r[3] is not None)]
        for spell in loops.spells(spoken, idle):
            first = next((i for i, r in enumerate(spell) if r[2] == "start"), len(spell))
            want |= {(k, i): p for i, p in plain_positions(spell[first:]).items()}
    assert got == want and (idle is None or len(want) < sum(r[2] == "tick" for rows in ev.values() for r in rows))
    df = spark.createDataFrame([(k, i, at(m), *r) for k, rows in ev.items() for m, i, *r in rows if r[0] in ("tick", "boundary", "start")],
                               "key string, event_id long, ts timestamp, kind string, char int, rate double, text_len int, position int")
    for slice_ms in (None, 3000):
        batch = P.interpolate_position(df, ["key"], slice_ms=slice_ms, idle_ms=idle)
        assert {(r.key, r.event_id): r.position for r in batch.collect()} == want


def plain_positions(rows):
    out, anchor, since, seen, position = {}, None, None, False, None
    for ms, i, kind, char, rate, n in rows:
        if kind == "start":
            anchor, since, seen, position = char, ms, False, char
        elif kind == "boundary":
            anchor, since, seen, position = char, ms, True, max(position, char)
        else:
            limits = [x for x in (None if rate is None else anchor + (ms - since) / 1000 * 14 * rate, anchor + 90 if seen else None, n) if x is not None]
            position = max([position] + [int(min(limits) + 0.5)] if limits else [position])
            out[i] = position
    return out


@pytest.mark.parametrize("idle", [None, 8000])
def test_monotonic_stream_has_a_row_per_boundary(spark, tmp, idle):
    ST.use_rocksdb(spark)
    ev = late_rows(random.Random(12))
    out = drain(spark, ST.monotonic_position(arriving(spark, tmp, ev, 30_000, 4, 2), ["key"], idle, "30 seconds"), "append", tmp, f"m{idle}")
    want = {}
    for k, rows in ev.items():
        for spell in loops.spells(rows, idle):
            for n, r in enumerate(spell):
                want[k, r[1]] = max((x[6] for x in spell[: n + 1] if x[6] is not None), default=None)
    assert {(r.key, r.event_id): r.position for r in out.collect() if r.key != "end"} == want
    df = spark.createDataFrame([(k, i, at(m), r[-1]) for k, rows in ev.items() for m, i, *r in rows], "key string, event_id long, ts timestamp, reported int")
    assert {(r.key, r.event_id): r.position for r in P.monotonic_position(df, ["key"], 2500, idle).collect()} == want


def test_session_stream_counts_late_pauses(spark, tmp):
    ST.use_rocksdb(spark)
    ev = late_rows(random.Random(13))
    ev["late"] = [(0, -5, "play", None, None, None, 1), (4000, -4, "pause", None, None, None, 2), (9000, -3, "boundary", None, None, None, 3)]
    out = drain(spark, ST.playback_sessions(arriving(spark, tmp, ev, 30_000, 5, 3), ["key"], 8000, "30 seconds"), "append", tmp, "spells")
    row = lambda r: (r.key, r.started_ms - BASE, r.ended_ms - BASE, r.events, r.plays, r.listened_sec, r.furthest)
    want = sorted((k, *s) for k, rows in ev.items() for s in loops.sessions([(m, i, kind, p) for m, i, kind, *_, p in rows], 8000))
    assert sorted(row(r) for r in out.collect() if r.key != "end") == want
    assert ("late", 0, 9000, 3, 1, 4.0, 3) in want
    df = spark.createDataFrame([(k, i, at(m), r[0], r[-1]) for k, rows in ev.items() for m, i, *r in rows],
                               "key string, event_id long, ts timestamp, kind string, position int")
    for slice_ms in (None, 2500):
        assert sorted(row(r) for r in P.playback_sessions(df, ["key"], 8000, slice_ms).collect()) == want


def test_silent_keys_leave_no_state(spark, tmp):
    """After the last timer only the key that moved the watermark is still there."""
    ST.use_rocksdb(spark)
    ev = late_rows(random.Random(14))
    src = arriving(spark, tmp, ev, 30_000, 3, 4)
    drain(spark, ST.playback_sessions(src, ["key"], 8000, "30 seconds"), "append", tmp, "left")
    left = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp}/cp-left")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp}/cp-left")
    assert left.count() == 0 and waiting.select("key").distinct().count() == 1


def test_many_keys_share_a_group(spark, tmp):
    """Thousands of keys of a few rows each are a few groups of the state store, a null key is one of its own."""
    ST.use_rocksdb(spark)
    ev = {k: [(1000 * i, 10 * n + i, "boundary", None, None, None, (7 * n + 3 * i) % 11) for i in range(2)] for n, k in enumerate([None, *map(str, range(60))])}
    src = arriving(spark, tmp, ev, 30_000, 2, 5)
    out = drain(spark, ST.monotonic_position(src, ["key"], None, "30 seconds", parts=4), "append", tmp, "parts")
    want = {(k, r[1]): max(x[6] for x in rows[: n + 1]) for k, rows in ev.items() for n, r in enumerate(rows)}
    assert {(r.key, r.event_id): r.position for r in out.collect()} == want
    kept = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp}/cp-parts")
    assert kept.count() == 61 and kept.select("key").distinct().count() <= 4
