"""HTTP exchanges on a stream: one row per exchange, its bodies put together afterwards."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..envelope import (
    REQUEST_BODY,
    REQUEST_HEADERS,
    RESPONSE_BODY,
    RESPONSE_HEADERS,
    RESPONSE_TRAILERS,
)
from ..functions.headers import without
from ..functions.timing import micros
from ..operators.bodies import assemble_bodies


def _headers_of(phase):
    own = F.when(F.col("phase") == phase, F.struct(F.col("seq"), F.col("headers")))
    return F.max_by(F.col("headers"), F.when(own.isNotNull(), F.col("seq")))


def _marked(stream):
    """Messages with what an exchange needs of them: plain headers, end flags and the time spent."""
    ends = F.coalesce("end_of_stream", F.lit(False))
    phase = F.col("phase")
    trailers = phase == RESPONSE_TRAILERS
    plain = F.coalesce(without(F.col("headers"), prefix=":"), F.expr("cast(map() as map<string,string>)"))
    return stream.withColumns(
        {
            "headers": F.when(phase.isin(REQUEST_HEADERS, RESPONSE_HEADERS), plain),
            "answered": (ends & phase.isin(RESPONSE_HEADERS, RESPONSE_BODY)) | trailers,
            "sent": ends & phase.isin(REQUEST_HEADERS, REQUEST_BODY),
            "spent": F.when(~trailers, F.col("duration_ns")),
        }
    )


def exchange_state(stream, timeout="1 hour", delay="10 minutes"):
    """One row per exchange: outcome, header sets, completeness, message count and duration.

    An exchange ``ended`` if an end flag came on the response's headers or body, or response
    trailers, which follow a body without one. One that has no message for ``timeout`` is a
    ``timeout``. In batch, messages after the end belong to the exchange and are counted.

    On a stream an ended exchange is given out by the micro-batch that holds its end, with what
    came up to then. It is remembered until nothing has followed for ``timeout``, so later
    messages never make a second row; then its state is dropped. Body bytes stay where they are,
    see :func:`with_bodies`.
    """
    rows = _marked(stream)
    if rows.isStreaming:
        return _live(rows, micros(timeout), delay)
    return (
        rows.groupBy("stream_id", F.session_window("ts", timeout).alias("__s"))
        .agg(
            F.max("answered").alias("response_complete"),
            _headers_of(REQUEST_HEADERS).alias("request_headers"),
            _headers_of(RESPONSE_HEADERS).alias("response_headers"),
            F.max("sent").alias("request_complete"),
            F.count("*").alias("messages"),
            F.coalesce(F.sum("spent"), F.lit(0)).cast("bigint").alias("duration_ns"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select("stream_id", F.when(F.col("response_complete"), "ended").otherwise("timeout").alias("outcome"), *_SHOWN)
    )


_SHOWN = (
    "request_headers", "response_headers", "request_complete", "response_complete", "messages", "duration_ns",
    "first_ts", "last_ts",
)
#: What is known of an exchange; the headers are those of the highest ``seq``, as JSON.
_PART = (
    "request_seq bigint, request_headers string, response_seq bigint, response_headers string, request_complete boolean, "
    "response_complete boolean, messages bigint, duration_ns bigint, first_us bigint, last_us bigint"
)
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _folded(batch):
    """One row per exchange of a batch of messages; sums before the shuffle, so a hot exchange does not travel."""
    rows = pa.Table.from_batches([batch]).sort_by("seq")
    for side, phase in (("request", REQUEST_HEADERS), ("response", RESPONSE_HEADERS)):
        own = pc.fill_null(pc.equal(rows["phase"], phase), False)
        for name in ("seq", "headers"):
            rows = rows.append_column(f"{side}_{name}", pc.if_else(own, rows[name], pa.scalar(None, rows[name].type)))
    wanted = {
        "request_seq": ("request_seq", "last"), "request_headers": ("request_headers", "last"),
        "response_seq": ("response_seq", "last"), "response_headers": ("response_headers", "last"),
        "request_complete": ("sent", "any"), "response_complete": ("answered", "any"), "messages": ("us", "count"),
        "duration_ns": ("spent", "sum"), "first_us": ("us", "min"), "last_us": ("us", "max"),
    }
    out = rows.group_by("stream_id", use_threads=False).aggregate(list(wanted.values()))
    names = {name: f"{column}_{how}" for name, (column, how) in wanted.items()}
    columns = [out["stream_id"], *[out[names[name]] for name in _PART_NAMES]]
    return pa.Table.from_arrays(columns, ["stream_id", *_PART_NAMES]).combine_chunks().to_batches()


def _newer(seq, headers, seq_b, headers_b):
    return (seq_b, headers_b) if seq_b is not None and (seq is None or seq_b >= seq) else (seq, headers)


def _merged(a, b):
    if a is None:
        return b
    return (
        *_newer(a[0], a[1], b[0], b[1]), *_newer(a[2], a[3], b[2], b[3]),
        a[4] or b[4], a[5] or b[5], a[6] + b[6], a[7] + b[7], min(a[8], b[8]), max(a[9], b[9]),
    )


class _Exchange(StatefulProcessor):
    """What is known of one exchange, whether it was given out, and a timer for its last message."""

    def __init__(self, timeout_us):
        self.timeout_us = timeout_us

    def init(self, handle):
        self.handle = handle
        self.known = handle.getValueState("known", f"{_PART}, given boolean")

    def close(self):
        pass

    def shown(self, key, known):
        outcome = "ended" if known[5] else "timeout"
        return Row(**dict(zip(("stream_id", "outcome", *_PART_NAMES), (key[0], outcome, *known))))

    def handleInputRows(self, key, rows, timerValues):
        held, now = self.known.get(), 1000 * timerValues.getCurrentWatermarkInMs()
        known, given = (tuple(held[:-1]), held[-1]) if held else (None, False)
        if known and known[9] + self.timeout_us <= now:  # its time has passed, and this batch holds the next of that id
            if not given:
                yield self.shown(key, known)
            known, given = None, False
        for row in rows:
            known = _merged(known, tuple(row[name] for name in _PART_NAMES))
        if known[5] and not given:
            yield self.shown(key, known)
        self.known.update((*known, given or bool(known[5])))
        self.handle.registerTimer(max(known[9] + self.timeout_us, now + 1000) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.known.get()
        # a timer that a later message has put off finds the exchange still open
        if held and held[9] + self.timeout_us <= 1000 * timerValues.getCurrentWatermarkInMs():
            if not held[-1]:
                yield self.shown(key, tuple(held[:-1]))
            self.known.clear()


def _live(rows, timeout_us, delay):
    def fold(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _folded(batch)

    part = rows.select(
        "stream_id", "seq", "phase", F.to_json("headers").alias("headers"), "answered", "sent", F.coalesce("spent", F.lit(0)).alias("spent"),
        F.unix_micros("ts").alias("us"),
    ).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("answered", "sent")})
    kind = rows.schema["stream_id"].dataType.simpleString()
    folded = part.mapInArrow(fold, f"stream_id {kind}, {_PART}")
    live = (
        folded.withColumn("ts", F.timestamp_micros("last_us"))
        .withWatermark("ts", delay)
        .groupBy("stream_id")
        .transformWithState(_Exchange(timeout_us), f"stream_id {kind}, outcome string, {_PART}", "append", "eventTime")
    )
    headers = {c: F.from_json(c, "map<string,string>") for c in ("request_headers", "response_headers")}
    times = {"first_ts": F.timestamp_micros("first_us"), "last_ts": F.timestamp_micros("last_us")}
    return live.withColumns(headers | times).select("stream_id", "outcome", *_SHOWN)


def with_bodies(closed, chunks):
    """Append ``request_body`` and ``response_body`` to closed exchanges, empty where there is none.

    ``chunks`` is the table of the same messages. The bytes are shuffled once and put together
    in the JVM; a body of several segments is put together only here, for bodies that fit one value.
    """
    sent = chunks.filter(F.col("phase").isin(REQUEST_BODY, RESPONSE_BODY))
    segments = assemble_bodies(sent.select("stream_id", "phase", "seq", "chunk", "end_of_stream"))
    side = lambda phase: F.coalesce(
        F.expr(f"listagg(if(phase = {phase}, body, null)) within group (order by segment)"), F.lit(b"")
    )
    bodies = segments.groupBy("stream_id").agg(
        side(REQUEST_BODY).alias("request_body"), side(RESPONSE_BODY).alias("response_body")
    )
    return (
        closed.join(bodies, "stream_id", "left")
        .withColumn("request_body", F.coalesce("request_body", F.lit(b"")))
        .withColumn("response_body", F.coalesce("response_body", F.lit(b"")))
    )
