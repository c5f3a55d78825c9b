"""Frames and media packets."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from ..functions.text import acknowledgement, is_jpeg, standard_base64
from .scans import running, running_count, salted_join

#: Bytes of a frame shown as its thumbnail (fixed value).
THUMBNAIL_BYTES = 1000


def number_frames(df, key="url", order="seq"):
    """Append the 1-based number of each frame in its stream; ``order`` is the arrival number."""
    return running(df, [key], order, {"frame_num": running_count()})


def sample_every(df, factor, key="url", order="seq"):
    """Keep the frames whose number is a multiple of ``factor``."""
    if factor < 1:
        raise ValueError("processing_factor must be >= 1")
    numbered = df if "frame_num" in df.columns else number_frames(df, key, order)
    return numbered.filter(F.col("frame_num") % factor == 0)


def has_keyframe(nalus):
    """Whether an access unit holds a unit of type 5."""
    opens = lambda n: F.conv(F.hex(F.substring(n, F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(
        F.exists(nalus, lambda n: (F.octet_length(n) > 0) & (opens(n).bitwiseAND(31) == 5)),
        F.lit(False),
    )


def gate_until_keyframe(packets):
    """Drop access units before the first keyframe of their (stream, payload type)."""
    key = ["stream_id", "payload_type"]
    opened = (
        packets.filter(has_keyframe(F.col("nalus")))
        .groupBy(*key)
        .agg(F.min("seq").alias("__open"))
    )
    return (
        salted_join(packets, opened, key, ["seq"])
        .filter(F.col("seq") >= F.col("__open"))
        .drop("__open")
    )


def jpeg_only(df, body="body"):
    """Keep non-empty bodies that start like a JPEG."""
    return df.filter(is_jpeg(F.col(body)))


def iso_instant(ts):
    """``2024-01-01T00:00:07.179575Z``, independent of the session time zone."""
    value = F.unix_micros(ts)
    local = F.timestamp_add("MICROSECOND", value, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    text = F.replace(F.substring(local.cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    rest = F.pmod(value, F.lit(1_000_000))
    fraction = F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(text, F.coalesce(fraction, F.lit("")), F.lit("Z"))


def frame_payload(df, out="payload"):
    """Append the JSON report of a frame."""
    size = F.octet_length("body")
    thumbnail = F.when(
        size > THUMBNAIL_BYTES,
        standard_base64(F.substring(F.col("body"), F.lit(1), F.lit(THUMBNAIL_BYTES))),
    )
    return df.withColumn(
        out,
        F.to_json(
            F.struct(
                F.col("frame_num").alias("frame_number"),
                iso_instant(F.col("ts")).alias("timestamp"),
                F.col("url").alias("source_url"),
                size.alias("frame_size_bytes"),
                F.struct(F.lit(True).alias("processed")).alias("analysis"),
                thumbnail.alias("thumbnail"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )


def ack_text(df, data="data", out="ack"):
    """Append the acknowledgement text of a message."""
    return df.withColumn(out, acknowledgement(F.col(data)))


@F.arrow_udf(T.BinaryType())
def _swapped(pcm: pa.Array) -> pa.Array:
    # every buffer is filled up to whole samples; of a swapped last byte only the 00 is kept
    rows = pcm.to_pylist()
    filled = b"".join((b if len(b) % 2 == 0 else b + b"\0") for b in rows if b is not None)
    swapped = np.frombuffer(filled, dtype=">u2").astype("<u2").tobytes()
    out, at = [], 0
    for b in rows:
        out.append(None if b is None else swapped[at : at + len(b)])
        at += 0 if b is None else len(b) + len(b) % 2
    return pa.array(out, pa.binary())


def swap_pcm(df, pcm="pcm"):
    """16-bit samples from big to little endian; an odd last byte becomes 00."""
    return df.withColumn(pcm, _swapped(F.col(pcm)))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _samples(pcm: pa.Array) -> pa.Array:
    # two bytes a sample: a buffer with an odd tail holds none that can be read
    lengths = pc.fill_null(pc.binary_length(pcm), 0).to_numpy(zero_copy_only=False)
    readable = pc.is_valid(pcm).to_numpy(zero_copy_only=False) & (lengths % 2 == 0)
    kept = pcm.take(pa.array(np.nonzero(readable)[0])).to_pylist()
    values = np.frombuffer(b"".join(kept), dtype="<i2").astype(np.float32) / np.float32(32768.0)
    ends = np.concatenate([[0], np.cumsum(np.where(readable, lengths // 2, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~readable))


def pcm_to_float(df, pcm="pcm", out="samples"):
    """Little-endian 16-bit samples to numbers in [-1, 1); null for an odd number of bytes."""
    return df.withColumn(out, _samples(F.col(pcm)))


def attach_frame_metadata(outputs, frames):
    """Handler outputs with frame_number, timestamp and url of their frame."""
    meta = frames.select("url", "frame_num", F.col("ts").alias("timestamp"))
    return outputs.join(meta, ["url", "frame_num"]).withColumnRenamed("frame_num", "frame_number")
