"""Playback events in batch: the rules of the streaming operators over stored events.

A session or a reader may be of any size, so events are ordered within slices of time and only the last
state of a slice is carried to the next. A hot key's slices are chosen so that none has more than
``ROWS_PER_SLICE`` of its events, which is counted, not assumed; other keys are one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafvoice.functions import fixed
from leafvoice.functions.measures import round_half_up
from leafvoice.plans.anchored import anchored_marks
from leafvoice.plans.blocks import materialize, previous, running

ROWS_PER_SLICE = 8192
#: A key that is silent for longer starts anew.
IDLE_MS = 6 * 3600 * 1000


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def fit_slices(df: DataFrame, keys: list[str], ts: str, max_rows: int | None = None) -> DataFrame:
    """Keys with more than ``max_rows`` events, and the length ``slice_ms`` of slices of time that hold no more each. A key's
    slices become shorter until its fullest one fits; what one instant holds can't be cut."""
    max_rows = max_rows or ROWS_PER_SLICE
    rows = df.select(*keys, millis(ts).alias("ms"))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ms").alias("lo"), F.max("ms").alias("hi")).where(F.col("n") > max_rows)
    even = F.floor((F.col("hi") - F.col("lo")) / F.col("n") * max_rows)
    hot = materialize(per_key.select(*keys, F.greatest(F.lit(1), even).cast("bigint").alias("slice_ms")), "hot")
    while True:
        slices = rows.join(hot, keys).groupBy(*keys, "slice_ms", F.floor(F.col("ms") / F.col("slice_ms")).alias("s")).count()
        fullest = slices.groupBy(*keys, "slice_ms").agg(F.max("count").alias("n"))
        over = (F.col("n") > max_rows) & (F.col("slice_ms") > 1)
        if fullest.where(over).limit(1).isEmpty():
            return hot
        # Events come in bursts: shrink by how far the fullest slice is over.
        shorter = F.greatest(F.lit(1), F.floor(F.col("slice_ms") * max_rows / (2 * F.col("n"))))
        hot = materialize(fullest.select(*keys, F.when(over, shorter).otherwise(F.col("slice_ms")).cast("bigint").alias("slice_ms")), "hot")


def _sliced(df: DataFrame, keys: list[str], ts: str, slice_ms: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``ms`` and ``block``, and the keys that may have several blocks (None: all). Only hot keys are cut, each into
    slices of its own length; ``slice_ms`` cuts all."""
    rows = df.withColumn("ms", millis(ts))
    if slice_ms:
        return rows.withColumn("block", F.floor(F.col("ms") / slice_ms).cast("bigint")), None
    hot = fit_slices(df, keys, ts)
    own = hot.withColumnRenamed("slice_ms", "_slice_ms")
    block = F.coalesce(F.floor(F.col("ms") / F.col("_slice_ms")), F.lit(0)).cast("bigint")
    return rows.join(own, keys, "left").withColumn("block", block).drop("_slice_ms").select(*df.columns, "ms", "block"), hot.select(*keys)


def coalesce_updates(
    updates: DataFrame, keys: list[str], delay_ms: int = fixed.DEBOUNCE_MS, slice_ms: int | None = None
) -> DataFrame:
    """Save at most once per ``delay_ms`` and key: the first update starts the wait, its end writes the
    latest value. ``updates`` has ``ts``, a unique ``event_id`` and ``kind``; an event of kind ``close``
    writes what is pending at once. Returns keys, ``fired_at_ms``, ``updates`` and the fields of the
    update written.
    """
    rows, long = _sliced(updates, keys, "ts", slice_ms)
    rest = [c for c in updates.columns if c not in keys]
    # A close starts a new life of the key; what was pending cannot outlast it.
    close = F.col("kind") == "close"
    rows = running(rows, keys, "block", ["ms", "event_id"], {"closes": ("sum", close.cast("int"))}, long)
    life = [*keys, "life"]
    closed = rows.where(close).select(*keys, (F.col("closes") - 1).alias("life"), F.col("ms").alias("closed_ms"))
    live = rows.where(~close).withColumn("life", F.col("closes"))
    # Rows of one instant are ordered by their id.
    live = live.withColumn("at", F.struct("ms", "event_id"))
    marked = anchored_marks(live, life, "block", "at", F.col("ms"), delay_ms, None, [c for c in rest if c != "event_id"], long)
    waits = (
        marked.withColumn("wait", F.col("marks_before") + F.col("marked").cast("int"))
        .withColumn("event_id", F.col("at.event_id"))
        .groupBy(*life, "wait")
        .agg(F.min("at.ms").alias("first_ms"), F.count("*").alias("updates"), F.max_by(F.struct(*rest), F.col("at")).alias("value"))
    )
    return waits.join(closed, life, "left").select(
        *keys, F.least(F.col("first_ms") + delay_ms, F.col("closed_ms")).alias("fired_at_ms"), "updates", "value.*"
    )


def _after_silence(rows: DataFrame, keys: list[str], idle_ms: int | None, long: DataFrame | None) -> DataFrame:
    """Adds ``fresh``: 1 at a row that comes more than ``idle_ms`` after the one before it, else 0."""
    if idle_ms is None:
        return rows.withColumn("fresh", F.lit(0))
    rows = previous(rows, keys, "block", ["ms", "event_id"], ["ms"], "before", long)
    return rows.withColumn("fresh", F.coalesce((F.col("ms") - F.col("before.ms") > idle_ms).cast("int"), F.lit(0))).drop("before")


def monotonic_position(boundaries: DataFrame, keys: list[str], slice_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Adds ``position``: the furthest ``reported`` offset so far in the utterance. With ``idle_ms`` an utterance ends with a
    longer silence, as in the stream."""
    rows, long = _sliced(boundaries, keys, "ts", slice_ms)
    rows, own = _after_silence(rows, keys, idle_ms, long), keys
    if idle_ms is not None:
        rows, own = running(rows, keys, "block", ["ms", "event_id"], {"_spell": ("sum", F.col("fresh"))}, long), [*keys, "_spell"]
    return running(rows, own, "block", ["ms", "event_id"], {"position": ("max", F.col("reported"))}, long).drop("block", "ms", "fresh", "_spell")


def interpolate_position(
    events: DataFrame, keys: list[str], chars_per_sec: int = fixed.CHARS_PER_SEC,
    drift: int = fixed.MAX_DRIFT_CHARS, slice_ms: int | None = None, idle_ms: int | None = None,
) -> DataFrame:
    """Position at every ``tick`` of an utterance.

    ``events`` is (keys, event_id, ts, kind, char, rate, text_len) with kinds ``start`` (``char`` is
    where speaking began), ``boundary`` (``char`` is where the engine says it is) and ``tick``. Each start begins
    an utterance of its own; what comes before the first start is left out. The estimate runs on from the last start or boundary, at most ``drift`` characters past a boundary, never
    past the text, and never goes back. With ``idle_ms`` a longer silence ends the utterance: ticks after it wait for the
    next start. Starts and boundaries without ``char`` are left out.
    """
    rows, long = _sliced(events.where("kind = 'tick' or char is not null"), keys, "ts", slice_ms)
    order = ["ms", "event_id"]
    known, start = F.col("kind") != "tick", F.col("kind") == "start"
    rows = _after_silence(rows, keys, idle_ms, long)
    rows = running(rows, keys, "block", order, {"utterance": ("sum", F.when(start | (F.col("fresh") == 1), 1))}, long).where("utterance > 0")
    own = [*keys, "utterance"]
    if idle_ms is not None:
        # Only a start opens an utterance.
        rows = running(rows, own, "block", order, {"opened": ("max", F.when(start, 1))}, long).where("opened = 1")
    rows = running(rows, own, "block", order, {
        "anchor": ("max", F.when(known, F.struct("ms", "event_id", F.col("char").cast("double").alias("char")))),
        "seen": ("max", F.when(F.col("kind") == "boundary", 1)),
    }, long)
    ahead = F.col("anchor.char") + (F.col("ms") - F.col("anchor.ms")) / 1000 * chars_per_sec * F.col("rate")
    capped = F.least(
        ahead, F.when(F.col("seen") == 1, F.col("anchor.char") + drift), F.col("text_len").cast("double")
    )
    rows = rows.withColumn("estimate", F.when(known, F.col("char").cast("bigint")).otherwise(round_half_up(capped)))
    rows = running(rows, own, "block", order, {"position": ("max", F.col("estimate"))}, long)
    return rows.where("kind = 'tick'").select(*keys, "event_id", "ts", F.col("position").cast("bigint").alias("position"))


def detect_stalls(
    events: DataFrame, keys: list[str], seen_ms: int = fixed.STALL_SEEN_MS, unseen_ms: int = fixed.STALL_UNSEEN_MS,
    slice_ms: int | None = None,
) -> DataFrame:
    """Silences while playing: no event for longer than ``seen_ms`` after a boundary was heard, or
    ``unseen_ms`` before one. ``kind`` is play, boundary, or anything else, which stops playing. The last
    event of a session is not judged: nothing after it says how long the silence was."""
    rows, long = _sliced(events, keys, "ts", slice_ms)
    order = ["ms", "event_id"]
    rows = running(rows, keys, "block", order, {"seen": ("max", (F.col("kind") == "boundary").cast("int"))}, long)
    rows = previous(rows, keys, "block", order, ["ms", "kind", "seen"], "before", long)
    limit = F.when(F.col("before.seen") == 1, seen_ms).otherwise(unseen_ms)
    silence = F.col("ms") - F.col("before.ms")
    return rows.where(F.col("before.kind").isin("play", "boundary") & (silence > limit)).select(
        *keys, "event_id", F.col("before.ms").alias("stalled_from_ms"), silence.alias("silence_ms")
    )


def sessionize_playback(events: DataFrame, keys: list[str], slice_ms: int | None = None) -> DataFrame:
    """Per session: times played, seconds listened (from a play to the next pause) and the furthest
    position reached. ``events`` is (keys, event_id, ts, kind, position)."""
    rows, long = _sliced(events, keys, "ts", slice_ms)
    order = ["ms", "event_id"]
    switch = F.when(F.col("kind").isin("play", "pause"), F.struct("ms", "event_id", (F.col("kind") == "play").alias("on")))
    rows = running(rows, keys, "block", order, {"state": ("max", switch)}, long)
    rows = rows.withColumn("playing", F.coalesce("state.on", F.lit(False)))
    rows = previous(rows, keys, "block", order, ["ms", "playing"], "before", long)
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "play").alias("plays"),
        (F.sum(F.when(F.col("before.playing"), F.col("ms") - F.col("before.ms")).otherwise(0)) / 1000).alias("listened_sec"),
        F.max("position").alias("furthest"),
    )


def playback_sessions(events: DataFrame, keys: list[str], gap_ms: int = IDLE_MS, slice_ms: int | None = None) -> DataFrame:
    """Sessions of a key: they end with a silence of more than ``gap_ms``, which also stops the clock. Keys, ``started_ms``,
    ``ended_ms``, ``events``, ``plays``, ``listened_sec`` and ``furthest``; ``events`` as for :func:`sessionize_playback`."""
    rows, long = _sliced(events.where("ts is not null"), keys, "ts", slice_ms)
    order, own = ["ms", "event_id"], [*keys, "session"]
    rows = _after_silence(rows, keys, gap_ms, long)
    rows = running(rows, keys, "block", order, {"session": ("sum", F.col("fresh"))}, long)
    switch = F.when(F.col("kind").isin("play", "pause"), F.struct("ms", "event_id", (F.col("kind") == "play").alias("on")))
    rows = running(rows, own, "block", order, {"state": ("max", switch)}, long)
    rows = rows.withColumn("playing", F.coalesce("state.on", F.lit(False)))
    rows = previous(rows, own, "block", order, ["ms", "playing"], "before", long)
    return rows.groupBy(*own).agg(
        F.min("ms").alias("started_ms"), F.max("ms").alias("ended_ms"), F.count("*").alias("events"),
        F.count_if(F.col("kind") == "play").alias("plays"),
        (F.sum(F.when(F.col("before.playing"), F.col("ms") - F.col("before.ms")).otherwise(0)) / 1000).alias("listened_sec"),
        F.max("position").alias("furthest"),
    ).drop("session")
