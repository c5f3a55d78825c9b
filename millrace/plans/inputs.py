"""Captured traffic derived from the given tables, in Spark and, for the checks, in SQL."""

from pyspark.sql import functions as F

from ..functions.timing import as_instant
from ..sources.captures import load_exchanges, load_messages

CHUNK = 1024


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", as_instant(F.col("ts")))


MESSAGE_COLUMNS = {
    "stream_id": "cast(user_id as string)",
    "conn_id": "concat(cast(user_id as string), '-', event_type)",
    "seq": "event_id",
    "data": "cast(event_type as binary)",
}


def messages(spark, folder):
    """Every event as a message of its user's stream."""
    return load_messages(spark, f"{folder}/events.parquet", columns=MESSAGE_COLUMNS)


def weighted(values):
    """One number that every value of a list and its place count in."""
    parts = F.transform(values, lambda v, i: F.floor(v.cast("double") * 1000).cast("bigint") * (i + 1))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def weighted_sql(values):
    """The same in SQL."""
    return (
        f"CAST(coalesce(list_sum(list_transform({values}, lambda v, i:"
        f" CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) * i)), 0) AS BIGINT)"
    )


def digest(body):
    """Bytes as text of fixed size, comparable with SQL."""
    return F.md5(body)


def map_text(mapping):
    """A map as sorted ``name=value`` text, whatever its order."""
    return F.array_join(
        F.array_sort(
            F.transform(
                F.map_entries(mapping), lambda e: F.concat(e["key"], F.lit("="), e["value"])
            )
        ),
        "&",
    )


def doc_chunks(spark, folder):
    """Documents as streamed bodies: even ones requests, odd ones responses.

    A document number ending in 3 is a stream that was cut before its end.
    """
    text = F.col("text").cast("binary")
    pieces = F.greatest(F.ceil(F.octet_length(text) / F.lit(CHUNK)), F.lit(1)).cast("long")
    return (
        table(spark, folder, "documents")
        .select(
            F.col("doc_id").cast("string").alias("stream_id"),
            F.when(F.col("doc_id") % 2 == 0, 2).otherwise(5).alias("phase"),
            (F.col("doc_id") % 10 != 3).alias("ends"),
            text.alias("bytes"),
            pieces.alias("pieces"),
            F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("seq"),
        )
        .select(
            "stream_id",
            "phase",
            "seq",
            F.substring(F.col("bytes"), (F.col("seq") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("chunk"),
            (F.col("ends") & (F.col("seq") == F.col("pieces") - 1)).alias("end_of_stream"),
        )
    )


DOC_CHUNKS = f"""
doc_chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS stream_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END AS phase, s AS seq,
         substr(h, CAST(s * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK}) AS chunk_hex,
         (doc_id % 10 <> 3 AND s = pieces - 1) AS end_of_stream
  FROM (SELECT *, unnest(range(0, pieces)) AS s
        FROM (SELECT doc_id, hex(encode(text)) AS h,
                     CAST(greatest(ceil(octet_length(encode(text)) / {CHUNK}.0), 1) AS BIGINT) AS pieces
              FROM documents))
)
"""


def phases(spark, folder):
    """Conversations as exchanges: a user turn is a request, the next assistant turn its response.

    Every turn is a header message and a body message; a system turn is a request without
    a body. Nothing answers a last user turn.
    """
    reply = "role = 'assistant'"
    turn = load_exchanges(
        spark,
        f"{folder}/conversations.parquet",
        columns={
            "stream_id": f"concat(conv_id, '-', if({reply}, turn - 1, turn))",
            "seq": f"if({reply}, 2, 0)",
            "phase": f"if({reply}, 4, 1)",
            "headers": f"""if({reply},
                map(':status', if(turn % 4 = 1, '200', '0xc8'), 'content-type', 'text/plain'),
                map(':method', 'POST', ':scheme', 'https', ':authority', 'chat.example',
                    ':path', concat('/', role, '/', conv_id, '?turn=', turn),
                    'content-length', if(role = 'system', '0', cast(octet_length(text) as string)),
                    'x-request-id', concat('r', conv_id, '-', turn)))""",
            "chunk": "cast(text as binary)",
            "end_of_stream": "role = 'system'",
            "ts": "timestamp_micros((1704067200 + conv_id * 60 + turn) * 1000000)",
            "duration_ns": "octet_length(text) * 1000",
        },
    )
    header = F.struct(
        "seq", "phase", "headers", F.lit(None).cast("binary").alias("chunk"), "end_of_stream", "duration_ns"
    )
    body = F.struct(
        (F.col("seq") + 1).alias("seq"),
        (F.col("phase") + 1).alias("phase"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        "chunk",
        F.lit(True).alias("end_of_stream"),
        (F.col("duration_ns") * 2).alias("duration_ns"),
    )
    both = F.when(F.col("end_of_stream"), F.array(header)).otherwise(F.array(header, body))
    return turn.select("stream_id", "ts", F.inline(both)).withColumn(
        "raw_headers", F.lit(None).cast("map<string,binary>")
    )


PHASES = """
turns AS (
  SELECT *, role = 'assistant' AS reply,
         conv_id || '-' || CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS stream_id,
         octet_length(encode(text)) AS n,
         (1704067200 + conv_id * 60 + turn) * 1000000 AS ts_us
  FROM conversations
),
phases AS (
  SELECT stream_id, CASE WHEN reply THEN 2::BIGINT ELSE 0 END AS seq, CASE WHEN reply THEN 4 ELSE 1 END AS phase,
         CASE WHEN reply
              THEN ':status=' || CASE WHEN turn % 4 = 1 THEN '200' ELSE '0xc8' END || '&content-type=text/plain'
              ELSE ':authority=chat.example&:method=POST&:path=/' || role || '/' || conv_id || '?turn=' || turn
                   || '&:scheme=https&content-length=' || CASE WHEN role = 'system' THEN '0' ELSE CAST(n AS VARCHAR) END
                   || '&x-request-id=r' || conv_id || '-' || turn END AS headers,
         NULL AS body, role = 'system' AS end_of_stream, n * 1000 AS duration_ns, ts_us
  FROM turns
  UNION ALL
  SELECT stream_id, CASE WHEN reply THEN 3 ELSE 1 END, CASE WHEN reply THEN 5 ELSE 2 END,
         NULL, text, true, n * 2000, ts_us
  FROM turns WHERE role <> 'system'
)
"""


def plain_headers(column):
    """SQL for a header text without its pseudo headers (names that begin with a colon)."""
    return f"array_to_string(list_filter(string_split({column}, '&'), lambda h: h NOT LIKE ':%'), '&')"


def page_frames(spark, folder):
    """Pages as frames of their host's stream."""
    return table(spark, folder, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("url"),
        F.col("page_id").alias("seq"),
        F.timestamp_micros((F.lit(1704067200) + F.col("page_id")) * 1000000).alias("ts"),
        F.col("html").cast("binary").alias("body"),
    )


PAGE_FRAMES = """
page_frames AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS url, page_id AS seq,
         (1704067200 + page_id) * 1000000 AS ts_us, html,
         row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS frame_num
  FROM pages
)
"""


def invocations(spark, folder):
    """Events as invocations: value/100 seconds long, one user a run, errors with status 500."""
    kind, value = F.col("event_type"), F.col("value")
    size = F.length("props")
    return events(spark, folder).select(
        "event_id",
        F.element_at(
            F.create_map(
                *[
                    F.lit(part)
                    for pair in (
                        ("click", "websocket"),
                        ("view", "mjpeg"),
                        ("purchase", "openinference"),
                        ("signup", "extproc"),
                        ("error", "job"),
                    )
                    for part in pair
                ]
            ),
            kind,
        ).alias("trigger"),
        F.col("user_id").cast("string").alias("run_id"),
        F.col("ts").alias("start"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(value * 10000).cast("long")).alias("end"),
        (value / 100).alias("duration"),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        F.lit("http").alias("scheme"),
        F.concat(F.lit("/"), kind).alias("route"),
        F.concat(F.lit("host-"), F.col("user_id") % 3).alias("server_address"),
        F.when(F.col("user_id") % 2 == 0, F.lit(8080)).alias("server_port"),
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        F.when(kind == "view", F.lit(None)).otherwise(size).alias("request_size"),
        (size * 3).alias("response_size"),
        F.when((kind == "purchase") & (value < 10), "no worker").alias("submit_error"),
        F.when((kind == "signup") & (value > 100), "failed").alias("process_error"),
        (value > 200).alias("timed_out"),
    )


INVOCATIONS = """
invocations AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'websocket' WHEN 'view' THEN 'mjpeg' WHEN 'purchase' THEN 'openinference'
                         WHEN 'signup' THEN 'extproc' ELSE 'job' END AS trigger,
         CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(round(value * 10000) AS BIGINT) AS end_us, value / 100 AS duration,
         CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, 'http' AS scheme,
         '/' || event_type AS route, 'host-' || (user_id % 3) AS server_address,
         CASE WHEN user_id % 2 = 0 THEN 8080 END AS server_port,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CASE WHEN event_type <> 'view' THEN length(props) END AS request_size,
         length(props) * 3 AS response_size,
         CASE WHEN event_type = 'purchase' AND value < 10 THEN 'no worker' END AS submit_error,
         CASE WHEN event_type = 'signup' AND value > 100 THEN 'failed' END AS process_error,
         value > 200 AS timed_out
  FROM events
)
"""


def requests(spark, folder):
    """Embeddings as inference requests: one FP32 tensor, the label as model version."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("model-"), F.col("label") % 4).alias("model_name"),
        F.when(F.col("label") % 3 == 0, "").otherwise(F.col("label").cast("string")).alias("model_version"),
        F.col("vec_id"),
        F.col("label"),
        F.col("embedding"),
    )


def models(spark, folder):
    """Model table out of the labels in use; odd labels declare a wrong shape, and a mask tensor."""
    label = F.col("label")
    seen = table(spark, folder, "embeddings").select("label").distinct().filter(label % 4 != 3)
    return seen.groupBy((label % 4).alias("m")).agg(F.max("label").alias("label")).select(
        F.concat(F.lit("model-"), F.col("m")).alias("model_name"),
        label.cast("string").alias("model_version"),
        F.lit("inputs").alias("side"),
        F.explode(F.array(F.lit("embedding"), F.lit("mask"))).alias("tensor"),
        F.lit("FP32").alias("datatype"),
        F.when(F.col("m") == 1, F.array(F.lit(32).cast("long")))
        .when(F.col("m") == 2, F.array(F.lit(-1).cast("long")))
        .otherwise(F.array(F.lit(64).cast("long")))
        .alias("shape"),
    )


MODELS = """
asked AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, 'model-' || (label % 4) AS model_name,
         CASE WHEN label % 3 = 0 THEN '' ELSE CAST(label AS VARCHAR) END AS model_version, *
  FROM embeddings
),
models AS (
  SELECT 'model-' || (label % 4) AS model_name, CAST(max(label) AS VARCHAR) AS model_version,
         CASE label % 4 WHEN 1 THEN 32 WHEN 2 THEN -1 ELSE 64 END AS dim
  FROM embeddings WHERE label % 4 <> 3 GROUP BY label % 4
)
"""
