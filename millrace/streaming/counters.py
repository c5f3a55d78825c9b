"""Counters of running streams: frame numbers, samples of every n-th frame, requests in flight."""

from pyspark.sql import Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timing import micros, tick_of
from ..operators.metrics import ACTIVE_DIMS


class _Numbers(StatefulProcessor):
    """The number a stream has come to, and frames whose event time the watermark has yet to pass."""

    def __init__(self, schema, time, order, factor):
        self.schema, self.factor = schema, factor
        self.time, self.order = schema.names.index(time), schema.names.index(order)

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.count = handle.getValueState("count", "n long")

    def close(self):
        pass

    def due(self, row):
        """First millisecond at which nothing earlier than this frame can come any more."""
        return -(-row[self.time] // 1000)

    def handleInputRows(self, key, rows, timerValues):
        # a row without a place in its stream only moves the watermark
        picked = (tuple(r[c] for c in self.schema.names) for r in rows)
        new = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in picked if r[self.order] is not None]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(map(self.due, new)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the first timer that fires settles all frames the watermark has passed
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if self.due(r) <= now), key=lambda r: (r[self.time], r[self.order]))
        if not ready:
            return
        rest = [r for r in held if self.due(r) > now]
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self.handle.registerTimer(min(map(self.due, rest)))
        n = self.count.get()[0] if self.count.exists() else 0
        named = Row(*self.schema.names, "frame_num")
        for row in ready:
            n += 1
            if n % self.factor == 0:
                yield named(*row, n)
        self.count.update((n,))


def live_frame_numbers(df, key="url", order="seq", factor=1, delay="10 seconds"):
    """``number_frames`` of a running stream, or with ``factor`` its ``sample_every``.

    Frames wait in state until the watermark has passed their event time ``ts`` and leave in order
    of it, ``order`` within one instant, so batches may hold them in any order. The two must agree,
    as arrival numbers do. The number belongs to ``key`` and goes on over connections, batches and
    restarts. State of a stream: its number, and the frames of the last ``delay``. A stream is one
    key; a table at rest whose streams are too large for one task goes through ``number_frames``.
    """
    if factor < 1:
        raise ValueError("processing_factor must be >= 1")
    # instants pass Python as numbers, whatever the session time zone is
    timed = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    # null keys are a stream like any other; the watermark's own column must stay a timestamp
    rows = df.withWatermark("ts", delay).withColumns({f"__{c}": F.unix_micros(c) for c in timed})
    carried = T.StructType(
        [T.StructField(f"__{f.name}", T.LongType()) if f.name in timed else T.StructField(f.name, f.dataType) for f in df.schema]
    )
    out = T.StructType([*carried.fields, T.StructField("frame_num", T.LongType())])
    numbered = (
        rows.select(*carried.names, "ts")
        .groupBy(key)
        .transformWithState(_Numbers(carried, "__ts", order, factor), out, "append", "eventTime")
    )
    return numbered.select(
        *[F.timestamp_micros(f"__{c}").alias(c) if c in timed else F.col(c) for c in df.columns], "frame_num"
    )


class _Level(StatefulProcessor):
    """Requests in flight of one set of dimensions."""

    def __init__(self, names):
        self.names = names

    def init(self, handle):
        self.level = handle.getValueState("level", "active long")

    def close(self):
        pass

    def handleInputRows(self, key, rows, timerValues):
        # ticks come out of the sums as they close: those of later batches are later
        active = self.level.get()[0] if self.level.exists() else 0
        named = Row(*self.names)
        for tick, delta in sorted((r["tick_us"], r["delta"]) for r in rows):
            active += delta
            yield named(*key, tick, active)
        self.level.update((active,))


def live_active_requests(changes, dims=ACTIVE_DIMS, interval="1 minute", delay="10 seconds"):
    """Requests in flight at the end of every tick in which something started or ended.

    ``changes`` is a stream of :func:`~millrace.operators.metrics.request_changes`, one row a start
    or end. They are summed up per tick in the JVM with partial aggregation, so a busy dimension is
    not one task; only its ticks, one row each, pass the state that adds them up, which is one
    number per set of dimensions. ``delay`` must cover how late a start is told: the longest request,
    where both are told at the end.
    """
    sums = (
        changes.withWatermark("ts", delay)
        .groupBy(*dims, F.window("ts", interval).alias("__w"))
        .agg(F.sum("delta").cast("long").alias("delta"))
        .filter("delta is not null")
        .select(*dims, F.unix_micros("__w.end").alias("tick_us"), "delta")
    )
    schema = T.StructType(
        [changes.schema[d] for d in dims] + [T.StructField(c, T.LongType()) for c in ("tick_us", "active")]
    )
    levels = sums.groupBy(*dims).transformWithState(_Level(schema.names), schema, "append", "none")
    return levels.select(*dims, F.timestamp_micros("tick_us").alias("tick"), "active")


def active_at_ticks(active, dims=ACTIVE_DIMS, interval="1 minute"):
    """What ``active_requests`` says at the end of every tick that had a change: the batch form of the above."""
    tick = ((tick_of(F.col("ts"), interval) + 1) * micros(interval)).cast("long")
    return (
        active.groupBy(*dims, F.timestamp_micros(tick).alias("tick"))
        .agg(F.max_by("active", "ts").alias("active"))
    )
