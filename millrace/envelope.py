"""Schemas shared by the operators."""

from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

#: One row per event, whatever trigger it came from.
ENVELOPE = T.StructType(
    [
        T.StructField("trigger", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("headers", TEXT_MAP),
        T.StructField("fields", TEXT_MAP),
        T.StructField("body", T.BinaryType()),
    ]
)

EXCHANGE = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("headers", TEXT_MAP),
        T.StructField("raw_headers", T.MapType(T.StringType(), T.BinaryType())),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("end_of_stream", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("duration_ns", T.LongType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("conn_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("data", T.BinaryType()),
    ]
)

PACKET = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("payload_type", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("nalus", T.ArrayType(T.BinaryType())),
        T.StructField("pcm", T.BinaryType()),
    ]
)

JOB_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("headers", TEXT_MAP),
        T.StructField("fields", TEXT_MAP),
        T.StructField("body", T.BinaryType()),
    ]
)

# Exchange phases (fixed values).
REQUEST_HEADERS = 1
REQUEST_BODY = 2
REQUEST_TRAILERS = 3
RESPONSE_HEADERS = 4
RESPONSE_BODY = 5
RESPONSE_TRAILERS = 6
