"""Rolling byte snapshots: a stream cut into chunks, kept in a trimmed buffer, emitted per tick."""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.numbers import divided
from ..functions.timing import micros, tick_of
from ..operators.scans import SLICE_ROWS, running, running_sum

# Default chunk, limit and trim in bytes of the two sources (fixed values).
MESSAGE_BUFFER = (160_000, 1_440_000, 1_120_000)
MEDIA_BUFFER = (16_000, 1_440_000, 1_120_000)
DEFAULT_INTERVAL = "2 seconds"

#: Columns of the snapshots that a running stream gives out, and their bytes after which they leave Python.
SNAPSHOT, OUT_BYTES = ["stream_id", "tick_ms", "buffer_start", "buffer_end", "body"], 8 << 20


def _check(chunk_bytes, max_bytes, trim_bytes):
    if min(chunk_bytes, max_bytes, trim_bytes) < 1:
        raise ValueError("chunk_bytes, max_bytes and trim_bytes must be positive")
    if trim_bytes > max(max_bytes, chunk_bytes):
        # a buffer just over its limit may then be shorter than what is to be cut off
        raise ValueError("trim_bytes must not exceed max_bytes")


def buffer_start(chunks, chunk_bytes, max_bytes, trim_bytes):
    """Stream offset at which the buffer begins after so many whole chunks.

    A trim of at least a chunk brings the buffer under its limit again, so the number of
    trims follows from the bytes alone; with a smaller trim every chunk after the first
    overflow trims once.
    """
    if trim_bytes >= chunk_bytes:
        over = chunks * chunk_bytes - max_bytes
        trims = divided(over + F.pmod(-over, F.lit(trim_bytes)), trim_bytes)
    else:
        trims = chunks - max_bytes // chunk_bytes
    return (F.greatest(trims.cast("long"), F.lit(0).cast("long")) * trim_bytes).cast("long")


def rolling_snapshots(
    df,
    chunk_bytes=MESSAGE_BUFFER[0],
    max_bytes=MESSAGE_BUFFER[1],
    trim_bytes=MESSAGE_BUFFER[2],
    interval=DEFAULT_INTERVAL,
):
    """Buffer content at every tick that saw at least one new whole chunk.

    Batch form: which bytes of the stream a snapshot holds follows from the byte counts, so
    only offsets are accumulated. Messages are then cut at block borders (a block is
    ``max_bytes`` long), put together per block, and joined to the snapshots on (stream,
    block): a busy stream is spread over its blocks, a snapshot meets two or three of them,
    and no buffer is carried from row to row.
    """
    _check(chunk_bytes, max_bytes, trim_bytes)
    placed, sums = _placed(df, interval)
    snapshots = _grown(sums, chunk_bytes).select(
        "stream_id",
        F.timestamp_micros((F.col("tick") + 1) * micros(interval)).alias("tick"),
        buffer_start(F.col("chunks"), chunk_bytes, max_bytes, trim_bytes).alias("start"),
        (F.col("chunks") * chunk_bytes).alias("end"),
    )
    return _with_content(snapshots, placed, max_bytes)


def _placed(df, interval):
    """Messages with the stream offsets (from, upto) of their bytes, and the slice sums."""
    messages = df.filter(F.octet_length("data") > 0).select(
        "stream_id",
        "seq",
        "data",
        tick_of(F.col("ts"), interval).alias("tick"),
        F.octet_length("data").cast("long").alias("n"),
    )

    placed, sums = running(
        messages,
        ["stream_id"],
        "seq",
        {"upto": running_sum(F.col("n"))},
        slices={
            "__tick": F.col("tick"),
            "__slice": divided(F.col("seq"), SLICE_ROWS),
        },
        with_summaries=True,
    )
    return placed.withColumn("from", F.col("upto") - F.col("n")), sums


def _with_content(snapshots, placed, max_bytes):
    """The bytes of each snapshot (stream_id, tick, start, end), block by block."""

    def blocks(start, end):
        return F.explode(
            F.sequence(divided(start, max_bytes), divided(end - 1, max_bytes))
        )

    low = F.greatest(F.col("from"), F.col("block") * max_bytes)
    high = F.least(F.col("upto"), (F.col("block") + 1) * max_bytes)
    pieces = placed.select(
        "stream_id", "data", "from", "upto", blocks(F.col("from"), F.col("upto")).alias("block")
    ).select(
        "stream_id",
        "block",
        low.alias("low"),
        high.alias("high"),
        F.substring(F.col("data"), (low - F.col("from") + 1).cast("int"), (high - low).cast("int")).alias(
            "piece"
        ),
    )

    content = pieces.groupBy("stream_id", "block").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.expr("listagg(piece) within group (order by low)").alias("content"),
    )

    wanted = snapshots.filter(F.col("end") > F.col("start")).select(
        "*", blocks(F.col("start"), F.col("end")).alias("block")
    )
    cut_from = F.greatest(F.col("low"), F.col("start"))
    cut_to = F.least(F.col("high"), F.col("end"))
    parts = (
        wanted.join(content, ["stream_id", "block"])
        .filter(cut_to > cut_from)
        .select(
            "stream_id",
            "tick",
            cut_from.alias("at"),
            F.substring(
                F.col("content"), (cut_from - F.col("low") + 1).cast("int"), (cut_to - cut_from).cast("int")
            ).alias("part"),
        )
    )
    bodies = parts.groupBy("stream_id", "tick").agg(
        F.expr("listagg(part) within group (order by at)").alias("body")
    )
    return snapshots.join(bodies, ["stream_id", "tick"], "left").select(
        "stream_id",
        "tick",
        F.col("start").alias("buffer_start"),
        F.col("end").alias("buffer_end"),
        F.coalesce("body", F.lit(b"")).alias("body"),
    )


def _grown(sums, chunk_bytes):
    """(stream, tick, chunks) of the ticks that completed a chunk, from the slice sums."""
    history = Window.partitionBy("stream_id").orderBy("tick")
    total = F.max(F.coalesce("__pre_upto", F.lit(0)) + F.col("__own_upto"))
    counted = (
        sums.groupBy("stream_id", F.col("__tick").alias("tick"))
        .agg(divided(total, chunk_bytes).alias("chunks"))
        .withColumn("before", F.lag("chunks", 1, 0).over(history))
    )
    return counted.filter(F.col("chunks") > F.col("before"))


def stream_tick_bytes(df, interval=DEFAULT_INTERVAL, delay="10 seconds"):
    """(stream_id, tick, bytes): what every tick of a stream received, given out as ticks close.

    This is all a snapshot needs of the stream: sums, kept in the JVM with partial aggregation,
    so that one busy stream is not one task. The bytes stay in the table of messages.
    """
    rows = df.withWatermark("ts", delay) if df.isStreaming else df
    return (
        rows.groupBy("stream_id", F.window("ts", interval).alias("__w"))
        .agg(F.sum(F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")).alias("bytes"))
        .select("stream_id", F.col("__w.end").alias("tick"), "bytes")
    )


def ranges_of_ticks(
    ticks,
    chunk_bytes=MESSAGE_BUFFER[0],
    max_bytes=MESSAGE_BUFFER[1],
    trim_bytes=MESSAGE_BUFFER[2],
):
    """(stream_id, tick, buffer_start, buffer_end) of the ticks that completed a chunk.

    Ordered per stream are the ticks, one row each, however many messages they had.
    """
    _check(chunk_bytes, max_bytes, trim_bytes)
    history = Window.partitionBy("stream_id").orderBy("tick")
    counted = ticks.withColumn("chunks", divided(F.sum("bytes").over(history), chunk_bytes)).withColumn(
        "before", F.lag("chunks", 1, 0).over(history)
    )
    return counted.filter(F.col("chunks") > F.col("before")).select(
        "stream_id",
        "tick",
        buffer_start(F.col("chunks"), chunk_bytes, max_bytes, trim_bytes).alias("buffer_start"),
        (F.col("chunks") * chunk_bytes).alias("buffer_end"),
    )


def snapshots_of_ticks(
    ticks,
    messages,
    chunk_bytes=MESSAGE_BUFFER[0],
    max_bytes=MESSAGE_BUFFER[1],
    trim_bytes=MESSAGE_BUFFER[2],
    interval=DEFAULT_INTERVAL,
):
    """The snapshots of closed ticks, their bytes read from the table of messages."""
    ranges = ranges_of_ticks(ticks, chunk_bytes, max_bytes, trim_bytes).select(
        "stream_id", "tick", F.col("buffer_start").alias("start"), F.col("buffer_end").alias("end")
    )
    placed, _ = _placed(messages, interval)
    return _with_content(ranges, placed, max_bytes)


class _Ring(StatefulProcessor):
    """The buffer of one stream: blocks of its last bytes, and the messages of every tick still open.

    Messages wait in pages, one for each tick of a frame of rows, and are read again tick by tick; snapshots
    leave after ``OUT_BYTES``. So what is in memory is a frame, a tick, the buffer and some snapshots,
    however many rows a micro-batch has.
    """

    def __init__(self, chunk_bytes, max_bytes, trim_bytes):
        self.chunk, self.most, self.trim = chunk_bytes, max_bytes, trim_bytes
        self.block = max(chunk_bytes, -(-max_bytes // 16))

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "ticks binary, pages binary")
        self.waiting = handle.getMapState("waiting", "tick long, page long", "seqs binary, sizes binary, data binary")
        self.place = handle.getValueState("place", "total long, chunks long")
        self.blocks = handle.getMapState("blocks", "block long", "data binary")

    def close(self):
        pass

    def start(self, chunks):
        """As :func:`buffer_start`."""
        if self.trim >= self.chunk:
            return max(0, -(-(chunks * self.chunk - self.most) // self.trim)) * self.trim
        return max(0, chunks - self.most // self.chunk) * self.trim

    def open_ticks(self):
        """The number of pages of every open tick."""
        if not self.open.exists():
            return {}
        ticks, pages = (np.frombuffer(x, np.int64).tolist() for x in self.open.get())
        return dict(zip(ticks, pages))

    def keep_open(self, pages):
        if not pages:
            self.open.clear()
            return
        self.open.update(tuple(np.array(list(x), np.int64).tobytes() for x in (pages.keys(), pages.values())))
        self.handle.registerTimer(min(pages))

    def messages(self, tick, pages):
        """The messages of a tick by number, which are forgotten."""
        found = []
        for page in range(pages):
            seqs, sizes, data = self.waiting.getValue((tick, page))
            self.waiting.removeKey((tick, page))
            at = 0
            for seq, size in zip(np.frombuffer(seqs, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist()):
                found.append((seq, data[at : at + size]))
                at += size
        return sorted(found)

    def handleInputRows(self, key, rows, timerValues):
        pages, new = self.open_ticks(), False
        for frame in rows:
            data, seqs, places = frame["data"].tolist(), frame["seq"].to_numpy(np.int64), {}
            for k, tick in enumerate(frame["tick"].tolist()):
                if data[k]:
                    places.setdefault(tick, []).append(k)
            for tick, at in places.items():
                page = pages.get(tick, 0)
                found = [data[k] for k in at]
                sizes = np.array([len(x) for x in found], np.int64)
                self.waiting.updateValue((tick, page), (seqs[at].tobytes(), sizes.tobytes(), b"".join(found)))
                pages[tick], new = page + 1, True
        if new:
            self.keep_open(pages)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the first timer that fires settles all ticks the watermark has passed
        now, pages = timerValues.getCurrentWatermarkInMs(), self.open_ticks()
        due = sorted(tick for tick in pages if tick <= now)
        if not due:
            return
        total, chunks = self.place.get() if self.place.exists() else (0, 0)
        first = self.start(chunks) // self.block
        kept = [bytes(self.blocks.getValue((k,))[0]) for k in range(first, -(-total // self.block))]
        base, buffer, written = first * self.block, bytearray(b"".join(kept)), total
        made, held = [], 0
        for tick in due:
            for _, data in self.messages(tick, pages.pop(tick)):
                buffer += data
                total += len(data)
            if total // self.chunk == chunks:
                continue
            chunks = total // self.chunk
            low, high = self.start(chunks), chunks * self.chunk
            made.append((key[0], tick, low, high, bytes(buffer[low - base : high - base])))
            held += high - low
            gone = low // self.block * self.block - base
            if gone >= self.most:
                del buffer[:gone]
                base += gone
            if held >= OUT_BYTES:
                yield pd.DataFrame(made, columns=SNAPSHOT)
                made, held = [], 0
        low = self.start(chunks) // self.block
        for k in range(first, min(low, -(-written // self.block))):
            self.blocks.removeKey((k,))
        for k in range(max(low, written // self.block), -(-total // self.block)):
            self.blocks.updateValue((k,), (bytes(buffer[k * self.block - base : (k + 1) * self.block - base]),))
        self.place.update((total, chunks))
        self.keep_open(pages)
        if made:
            yield pd.DataFrame(made, columns=SNAPSHOT)


def live_snapshots(
    df,
    chunk_bytes=MESSAGE_BUFFER[0],
    max_bytes=MESSAGE_BUFFER[1],
    trim_bytes=MESSAGE_BUFFER[2],
    interval=DEFAULT_INTERVAL,
    delay="10 seconds",
):
    """The snapshots of :func:`rolling_snapshots` from a running stream, each given out as its tick closes.

    State of a stream: its buffer in blocks of which only new ones are written and trimmed ones
    removed, at most ``max_bytes``, a chunk and a block; and the messages that came before the
    watermark passed their tick, which wait in the store tick by tick. Within a tick messages are
    ordered by ``seq``, those without one last; a task holds the messages of one tick at once.
    ``interval`` is whole milliseconds. Messages without an event time are left out. A stream is one
    key, and its bytes pass one task in order; a table at rest whose streams are too large for that
    goes through :func:`rolling_snapshots`.
    """
    _check(chunk_bytes, max_bytes, trim_bytes)
    step = micros(interval)
    if step % 1000:
        raise ValueError("interval must be whole milliseconds")
    # empty messages move the watermark too: a filter here would be pushed below it
    rows = df.withWatermark("ts", delay)
    kind, tick = df.schema["stream_id"].dataType, (tick_of(F.col("ts"), interval) + 1) * (step // 1000)
    # frames of rows turn numbers with a null among them to doubles: there are none of these, and keys are text
    text = isinstance(kind, (T.StringType, T.BinaryType))
    out = (
        rows.select(
            F.col("stream_id") if text else F.col("stream_id").cast("string").alias("stream_id"),
            "ts",
            F.coalesce(tick.cast("long"), F.lit(0)).alias("tick"),
            F.coalesce(F.col("seq").cast("long"), F.lit((1 << 63) - 1)).alias("seq"),
            F.when(F.col("ts").isNotNull(), F.col("data")).alias("data"),
        )
        .groupBy("stream_id")
        .transformWithStateInPandas(
            _Ring(chunk_bytes, max_bytes, trim_bytes),
            f"stream_id {kind.simpleString() if text else 'string'}, tick_ms long, buffer_start long, buffer_end long, body binary",
            "append",
            "eventTime",
        )
    )
    return out.select(
        F.col("stream_id").cast(kind).alias("stream_id"),
        F.timestamp_millis("tick_ms").alias("tick"),
        "buffer_start",
        "buffer_end",
        "body",
    )
