"""Latest value per tick, and connection sessions; the same call in batch and on a stream.

A ticker becomes an epoch-aligned event-time window. Rows later than the watermark are
dropped by Spark, which the ticker, having no late data, never had to; a table at rest is
streamed without loss by :mod:`.at_rest`.
"""

from pyspark.sql import Window, functions as F

from ..functions.timing import micros, tick_of


def _watermarked(df, delay):
    return df.withWatermark("ts", delay) if df.isStreaming else df


def conflate_latest(df, interval, keep_empty=False, delay="10 minutes"):
    """Per stream and tick, the newest message; an empty newest message gives nothing.

    Partial aggregation keeps one message per stream and tick on the map side, so a busy
    stream does not travel.
    """
    latest = (
        _watermarked(df, delay)
        .groupBy("stream_id", F.window("ts", interval))
        .agg(
            F.max_by(F.struct("seq", "data"), F.struct("ts", "seq")).alias("__m"),
            F.count("*").alias("messages"),
        )
        .select(
            "stream_id",
            F.col("window.end").alias("tick"),
            F.col("__m.seq").alias("seq"),
            F.col("__m.data").alias("data"),
            "messages",
        )
    )
    return latest if keep_empty else latest.filter(F.octet_length("data") > 0)


def keep_latest_frame(df, interval, delay="10 minutes"):
    """Per stream and tick, the newest frame, empty or not."""
    return conflate_latest(df, interval, keep_empty=True, delay=delay)


def connection_sessions(df, gap="5 seconds", delay="10 minutes"):
    """Group the frames of a stream into sessions: a pause longer than ``gap`` starts a new one.

    In batch, frames are first folded into gap-wide cells: two frames of a cell are closer
    than the gap, so a cell never splits, and what is ordered per stream is at most one row
    per cell instead of one per frame.
    """
    if df.isStreaming:
        return (
            _watermarked(df, delay)
            .groupBy("stream_id", F.session_window("ts", gap).alias("__s"))
            .agg(F.count("*").alias("frames"))
            .select(
                "stream_id",
                F.col("__s.start").alias("session_start"),
                F.col("__s.end").alias("session_end"),
                "frames",
            )
        )
    width = micros(gap)
    cells = (
        df.select("stream_id", "ts", tick_of(F.col("ts"), gap).alias("cell"))
        .groupBy("stream_id", "cell")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("frames"))
    )
    ordered = Window.partitionBy("stream_id").orderBy("cell")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(ordered))
    return (
        cells.withColumn("opens", F.coalesce((pause > width).cast("int"), F.lit(1)))
        .withColumn("session", F.sum("opens").over(ordered))
        .groupBy("stream_id", "session")
        .agg(
            F.min("first").alias("session_start"),
            F.timestamp_micros(F.unix_micros(F.max("last")) + width).alias("session_end"),
            F.sum("frames").alias("frames"),
        )
        .drop("session")
    )
