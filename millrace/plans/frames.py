"""Frames, captures, packets, samples."""

from pyspark.sql import functions as F

from ..operators import frames
from ..sources.captures import load_packets
from ..sources.multipart import demux_frames, mux_frames
from .inputs import PAGE_FRAMES, digest, map_text, page_frames, table
from .registry import query


def _packets(spark, folder):
    """Documents as access units of their source: every word a unit, its bytes the samples."""
    return load_packets(
        spark,
        f"{folder}/documents.parquet",
        {
            "stream_id": "source",
            "payload_type": "if(lang = 'en', 96, 97)",
            "seq": "doc_id",
            "ts": "timestamp_micros((1704067200 + doc_id) * 1000000)",
            "nalus": "transform(split(text, ' '), w -> cast(w as binary))",
            "pcm": "cast(text as binary)",
        },
    )


@query(
    "s3_load_packets",
    """
    SELECT source AS stream_id, CASE WHEN lang = 'en' THEN 96 ELSE 97 END AS payload_type, doc_id AS seq,
           (1704067200 + doc_id) * 1000000 AS ts_us, CAST(len(string_split(text, ' ')) AS INTEGER) AS nalus,
           md5(text) AS pcm
    FROM documents
    """,
)
def load_packets_query(spark, folder):
    return _packets(spark, folder).select(
        "stream_id",
        "payload_type",
        "seq",
        F.unix_micros("ts").alias("ts_us"),
        F.size("nalus").alias("nalus"),
        digest("pcm").alias("pcm"),
    )


@query(
    "n3_gate_until_keyframe",
    """
    WITH p AS (
      SELECT doc_id, source, lang = 'en' AS en,
             len(list_filter(string_split(text, ' '), lambda w: length(w) > 0 AND ascii(w) < 128
                 AND ascii(w) % 32 = 5)) > 0 AS opens
      FROM documents),
    g AS (SELECT *, max(opens) OVER (PARTITION BY source, en ORDER BY doc_id) AS open FROM p)
    SELECT source AS stream_id, CASE WHEN en THEN 96 ELSE 97 END AS payload_type, doc_id AS seq FROM g WHERE open
    """,
)
def gate_query(spark, folder):
    return frames.gate_until_keyframe(_packets(spark, folder)).select("stream_id", "payload_type", "seq")


@query(
    "k4_mux_frames",
    f"""
    WITH {PAGE_FRAMES}
    SELECT url, (frame_num - 1) // 16 AS segment, count(*) AS frames,
           md5(unhex(string_agg(hex(encode(concat('--frame', chr(13), chr(10), 'Content-Type: image/jpeg', chr(13), chr(10),
               'Content-Length: ', octet_length(encode(html)), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10)))),
               '' ORDER BY frame_num))) AS content
    FROM page_frames GROUP BY ALL
    """,
)
def mux_query(spark, folder):
    muxed = mux_frames(frames.number_frames(page_frames(spark, folder)), segment_frames=16)
    return muxed.withColumn("content", digest("content"))


_DEMUXED = f"""
WITH {PAGE_FRAMES}
SELECT url, frame_num, 'Content-Length=' || octet_length(encode(html)) || '&Content-Type=image/jpeg' AS headers,
       md5(html) AS body
FROM page_frames
"""


def _captures(spark, folder):
    muxed = mux_frames(
        frames.number_frames(page_frames(spark, folder)), boundary="cut here", segment_frames=16
    )
    return muxed.select(
        F.col("url").alias("path"),
        "segment",
        "frames",
        "content",
        F.lit("multipart/x-mixed-replace; boundary = cut here").alias("content_type"),
    )


def _frame_columns(df):
    return df.select("url", "frame_num", map_text("headers").alias("headers"), digest("body").alias("body"))


@query("s4_demux_captures", _DEMUXED)
def demux_query(spark, folder):
    """Captures written by the multipart sink, taken apart again segment by segment."""
    return _frame_columns(demux_frames(_captures(spark, folder)))


@query("s4_demux_recordings", _DEMUXED)
def demux_recordings_query(spark, folder):
    """The same bytes as raw recordings, of which nobody knows where a part begins."""
    return _frame_columns(demux_frames(_captures(spark, folder).drop("frames")))


def _images(spark, folder):
    """Documents as frame bodies: English ones open like a JPEG, some others are empty."""
    text = F.col("text").cast("binary")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(F.lit(b"\xff\xd8"), text))
        .when(F.col("doc_id") % 4 == 0, F.lit(b""))
        .otherwise(text)
        .alias("body"),
    )


@query(
    "p20_jpeg_only",
    "SELECT doc_id, md5(unhex('FFD8' || hex(encode(text)))) AS body FROM documents WHERE lang = 'en'",
)
def jpeg_query(spark, folder):
    return frames.jpeg_only(_images(spark, folder)).withColumn("body", digest("body"))


@query(
    "p21_frame_payload",
    f"""
    WITH {PAGE_FRAMES}
    SELECT seq, '{{"frame_number":' || frame_num || ',"timestamp":"' ||
           strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN seq % 2 = 0 THEN 'Z' ELSE '.179500Z' END
           || '","source_url":"' || url || '","frame_size_bytes":' || octet_length(encode(html))
           || ',"analysis":{{"processed":true}},"thumbnail":'
           || CASE WHEN octet_length(encode(html)) > 1000
                   THEN '"' || to_base64(unhex(substr(hex(encode(html)), 1, 2000))) || '"' ELSE 'null' END || '}}' AS payload
    FROM page_frames
    """,
)
def payload_query(spark, folder):
    shot = F.timestamp_micros(F.unix_micros("ts") + F.when(F.col("seq") % 2 == 0, 0).otherwise(179500))
    numbered = frames.number_frames(page_frames(spark, folder)).withColumn("ts", shot)
    return frames.frame_payload(numbered).select("seq", "payload")


@query(
    "p23_swap_pcm",
    r"""
    SELECT doc_id, md5(unhex(regexp_replace(substr(h, 1, CAST(n // 2 * 4 AS BIGINT)), '(..)(..)', '\2\1', 'g')
                             || CASE WHEN n % 2 = 1 THEN '00' ELSE '' END)) AS pcm
    FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)
    """,
)
def swap_query(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return frames.swap_pcm(df).withColumn("pcm", digest("pcm"))


@query(
    "p24_pcm_to_float",
    """
    WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(h, '....')) AS h FROM d WHERE n % 2 = 0),
    s AS (SELECT doc_id, CAST('0x' || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS u FROM w),
    t AS (SELECT doc_id, CAST(sum(CASE WHEN u > 32767 THEN u - 65536 ELSE u END) AS BIGINT) AS total,
                 min(CASE WHEN u > 32767 THEN u - 65536 ELSE u END) / 32768 AS low FROM s GROUP BY 1)
    SELECT doc_id, CASE WHEN n % 2 = 0 THEN CAST(n // 2 AS INTEGER) END AS samples,
           CASE WHEN n % 2 = 0 THEN coalesce(total, 0) END AS total, low
    FROM d LEFT JOIN t USING (doc_id)
    """,
)
def samples_query(spark, folder):
    """Whole texts; an odd number of bytes gives no samples."""
    df = table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    heard = frames.pcm_to_float(df)
    steps = F.transform("samples", lambda v: (v.cast("double") * 32768).cast("bigint"))
    return heard.select(
        "doc_id",
        F.when(F.col("samples").isNotNull(), F.size("samples")).alias("samples"),
        F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.array_min("samples").cast("double").alias("low"),
    )
