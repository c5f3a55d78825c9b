"""Messages, events, windows, subscribers."""

from pyspark.sql import functions as F

from ..operators import delivery, events as ev, frames
from ..operators.http import parse_query
from ..sources.captures import job_events, load_messages
from ..session import scratch_path
from ..streaming import at_rest, counters, rolling, windows
from ..streaming.at_rest import KEYED_STATE, run_table_as_stream
from .inputs import digest, events, invocations, map_text, messages, page_frames, requests, table
from .inputs import INVOCATIONS, PAGE_FRAMES
from .registry import query


@query(
    "flagship_hourly_acknowledgements",
    """
    WITH latest AS (
      SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, arg_max(event_type, event_id) AS data, count(*) AS n
      FROM events GROUP BY 1, 2
    )
    SELECT epoch_us(w) + 3600000000 AS tick_us, 'ACK: ' || data AS ack, count(*) AS streams,
           CAST(sum(n) AS BIGINT) AS messages
    FROM latest GROUP BY 1, 2
    """,
)
def flagship(spark, folder):
    latest = windows.conflate_latest(messages(spark, folder), "1 hour")
    return (
        frames.ack_text(latest)
        .groupBy(F.unix_micros("tick").alias("tick_us"), "ack")
        .agg(F.count("*").alias("streams"), F.sum("messages").alias("messages"))
    )


@query(
    "s2_load_messages",
    """
    SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(user_id AS VARCHAR) || '-' || event_type AS conn_id,
           event_id AS seq, epoch_us(ts) AS ts_us, event_type AS data
    FROM events
    """,
)
def load_messages_query(spark, folder):
    return messages(spark, folder).select(
        "stream_id", "conn_id", "seq", F.unix_micros("ts").alias("ts_us"), F.col("data").cast("string").alias("data")
    )


@query(
    "s6_job_events",
    """
    SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderkey AS seq, epoch_us(o_orderdate) AS ts_us,
           'POST' AS method, '/jobs/' || o_orderstatus AS path, 'priority=' || o_orderpriority AS headers,
           'total=' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS fields,
           '{"order": ' || o_orderkey || '}' AS body
    FROM orders
    """,
)
def job_events_query(spark, folder):
    jobs = job_events(
        spark,
        table(spark, folder, "orders"),
        {
            "run_id": "cast(o_custkey as string)",
            "seq": "o_orderkey",
            "ts": "o_orderdate",
            "method": "'POST'",
            "path": "concat('/jobs/', o_orderstatus)",
            "headers": "map('priority', o_orderpriority)",
            "fields": "map('total', cast(cast(round(o_totalprice * 100) as bigint) as string))",
            "body": "cast(concat('{\"order\": ', o_orderkey, '}') as binary)",
        },
    )
    return jobs.select(
        "run_id",
        "seq",
        F.unix_micros("ts").alias("ts_us"),
        "method",
        "path",
        map_text("headers").alias("headers"),
        map_text("fields").alias("fields"),
        F.col("body").cast("string").alias("body"),
    )


_EVENT_SQL = f"""
WITH {PAGE_FRAMES}
SELECT 'websocket' AS trigger, 'async' AS class, CAST(user_id AS VARCHAR) AS stream_id, event_id AS seq,
       'websocket' AS method, '' AS path, NULL AS url, 'application/octet-stream' AS content_type,
       NULL AS headers, NULL AS fields, md5(event_type) AS body
FROM events
UNION ALL
SELECT 'rtsp', 'async', source, doc_id, 'rtsp', '', NULL, 'application/octet-stream', NULL, NULL, md5(text)
FROM documents
UNION ALL
SELECT 'mjpeg', 'async', url, frame_num, '', url, url, 'image/jpeg', NULL,
       'frame_num=' || frame_num || '&timestamp=' || ts_us || '&url=' || url, md5(html)
FROM page_frames
UNION ALL
SELECT 'job', 'async', CAST(o_custkey AS VARCHAR), o_orderkey, 'POST', '/jobs', '', '',
       'priority=' || o_orderpriority, '', md5(o_orderstatus)
FROM orders
UNION ALL
SELECT 'openinference', 'sync', CAST(vec_id AS VARCHAR), vec_id, 'POST',
       '/v2/models/model-' || (label % 4) || '/infer', '', 'application/json',
       'X-Model-Name=model-' || (label % 4) || '&X-Model-Version='
         || CASE WHEN label % 3 = 0 THEN '' ELSE CAST(label AS VARCHAR) END
         || CASE WHEN vec_id % 2 = 0 THEN '&X-Protocol=grpc' ELSE '' END || '&X-Request-ID=' || vec_id,
       'label=' || label || '&rate=0.5', md5(CAST(vec_id AS VARCHAR))
FROM embeddings
UNION ALL
SELECT 'extproc', 'sync', CAST(conv_id AS VARCHAR), turn, 'POST', '/' || role, NULL, 'text/plain',
       'Content-Type=text/plain&x-bin=ok', 'turn=' || turn || ',last', md5(text)
FROM conversations
"""


def all_events(spark, folder):
    """Envelopes of all six triggers."""
    socket = ev.normalize_events(messages(spark, folder), "websocket")
    media = ev.normalize_events(
        table(spark, folder, "documents").select(
            F.col("source").alias("stream_id"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("body")
        ),
        "rtsp",
    )
    video = ev.normalize_events(frames.number_frames(page_frames(spark, folder)), "mjpeg")
    jobs = ev.normalize_events(
        job_events(
            spark,
            table(spark, folder, "orders"),
            {
                "run_id": "cast(o_custkey as string)",
                "seq": "o_orderkey",
                "ts": "o_orderdate",
                "method": "'POST'",
                "path": "'/jobs'",
                "headers": "map('priority', o_orderpriority)",
                "fields": "cast(map() as map<string,string>)",
                "body": "cast(o_orderstatus as binary)",
            },
        ),
        "job",
    )
    infer = ev.normalize_events(
        requests(spark, folder).select(
            "id",
            "model_name",
            "model_version",
            F.col("vec_id").alias("seq"),
            F.when(F.col("vec_id") % 2 == 0, "grpc").otherwise("rest").alias("protocol"),
            F.create_map(
                F.lit("label"),
                F.parse_json(F.col("label").cast("string")),
                F.lit("rate"),
                F.parse_json(F.lit("0.5")),
            ).alias("parameters"),
            F.col("id").cast("binary").alias("body"),
        ),
        "openinference",
    )
    proxy = ev.normalize_events(
        table(spark, folder, "conversations").select(
            F.col("conv_id").cast("string").alias("stream_id"),
            F.col("turn").alias("seq"),
            F.lit("POST").alias("method"),
            F.concat(F.lit("/"), "role").alias("path"),
            F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("x-bin"), F.lit("ok")).alias("headers"),
            F.create_map(F.lit("Content-Type"), F.lit(b"text/plain")).alias("raw_headers"),
            F.create_map(F.lit("turn"), F.array(F.col("turn").cast("string"), F.lit("last"))).alias("query"),
            F.col("text").cast("binary").alias("body"),
        ),
        "extproc",
    )
    return ev.union_events(socket, media, video, jobs, infer, proxy)


def _shown(envelope):
    return envelope.select(
        "trigger",
        "class",
        "stream_id",
        "seq",
        "method",
        "path",
        "url",
        "content_type",
        map_text("headers").alias("headers"),
        map_text("fields").alias("fields"),
        digest("body").alias("body"),
    )


@query("p1_normalize_events", _EVENT_SQL)
def normalize_query(spark, folder):
    return _shown(all_events(spark, folder))


@query(
    "o1_union_events",
    f"""
    SELECT trigger, class, count(*) AS events, count(DISTINCT stream_id) AS streams
    FROM ({_EVENT_SQL}) GROUP BY ALL
    """,
)
def union_query(spark, folder):
    return all_events(spark, folder).groupBy("trigger", "class").agg(
        F.count("*").alias("events"), F.count_distinct("stream_id").alias("streams")
    )


@query(
    "j5_unrouted",
    """
    SELECT event_id, event_type AS trigger FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
    """,
)
def unrouted_query(spark, folder):
    seen = events(spark, folder).select("event_id", F.col("event_type").alias("trigger"))
    return ev.unrouted(seen, ["click", "view", "purchase"])


@query(
    "j5_unrouted_by_table",
    f"""
    WITH {INVOCATIONS}
    SELECT i.event_id, i.trigger FROM invocations i
    WHERE i.trigger NOT IN (
      SELECT CASE n_nationkey % 3 WHEN 0 THEN 'websocket' WHEN 1 THEN 'job' ELSE 'mjpeg' END FROM nation)
    """,
)
def unrouted_table_query(spark, folder):
    kinds = table(spark, folder, "nation").select(
        F.when(F.col("n_nationkey") % 3 == 0, "websocket")
        .when(F.col("n_nationkey") % 3 == 1, "job")
        .otherwise("mjpeg")
        .alias("trigger")
    )
    return ev.unrouted(
        invocations(spark, folder).select("event_id", "trigger"), kinds, ["event_id"]
    )


_FIELDS = """
v AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CAST(round(value * 100) AS BIGINT) AS cents, event_type
      FROM events)
"""


def _with_fields(spark, folder):
    """Events with a document of one field of every type."""
    k = F.get_json_object("props", "$.k")
    return events(spark, folder).select(
        "event_id",
        F.parse_json(
            F.concat(
                F.lit('{"n": '), k,
                F.lit(', "f": '), F.col("value").cast("string"),
                F.lit(', "b": '), (k.cast("bigint") % 2 == 0).cast("string"),
                F.lit(', "d": "'), k,
                F.lit('", "t": "'), F.col("event_type"), F.lit('"}'),
            )
        ).alias("fields"),
    )


def _read_fields(df, as_, reads):
    return ev.typed_fields(df, [(key, as_, trigger, out) for key, trigger, out in reads]).drop("fields")


@query(
    "p2_typed_field_text",
    f"""
    WITH {_FIELDS}
    SELECT event_id,
           CAST(k AS VARCHAR) AS job_int,
           CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR)
                WHEN cents % 10 = 0 THEN (cents // 100) || '.' || ((cents % 100) // 10)
                ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS job_float,
           CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS job_bool, event_type AS job_text, '' AS job_missing,
           event_type AS frame_text, '' AS frame_of_number, event_type AS infer_text
    FROM v
    """,
)
def typed_text_query(spark, folder):
    return _read_fields(
        _with_fields(spark, folder),
        "string",
        (
            ("n", "job", "job_int"),
            ("f", "job", "job_float"),
            ("b", "job", "job_bool"),
            ("t", "job", "job_text"),
            ("none", "job", "job_missing"),
            ("t", "mjpeg", "frame_text"),
            ("n", "mjpeg", "frame_of_number"),
            ("t", "openinference", "infer_text"),
        ),
    )


@query(
    "p2_typed_field_int",
    f"""
    WITH {_FIELDS}
    SELECT event_id, cents // 100 AS frame_int, 0::BIGINT AS frame_int_of_text,
           k AS socket_int, k AS socket_int_of_text, NULL::BIGINT AS socket_int_of_word, 0::BIGINT AS socket_missing,
           0::BIGINT AS infer_int
    FROM v
    """,
)
def typed_int_query(spark, folder):
    return _read_fields(
        _with_fields(spark, folder),
        "int",
        (
            ("f", "mjpeg", "frame_int"),
            ("d", "mjpeg", "frame_int_of_text"),
            ("n", "websocket", "socket_int"),
            ("d", "rtsp", "socket_int_of_text"),
            ("t", "websocket", "socket_int_of_word"),
            ("none", "rtsp", "socket_missing"),
            ("n", "openinference", "infer_int"),
        ),
    )


@query(
    "p2_typed_field_bytes",
    f"""
    WITH {_FIELDS}
    SELECT event_id, md5(event_type) AS frame_text, NULL::VARCHAR AS frame_of_number, md5(CAST(k AS VARCHAR)) AS socket_digits,
           NULL::VARCHAR AS infer_missing
    FROM v
    """,
)
def typed_bytes_query(spark, folder):
    reads = (
        ("t", "mjpeg", "frame_text"),
        ("n", "mjpeg", "frame_of_number"),
        ("d", "websocket", "socket_digits"),
        ("none", "openinference", "infer_missing"),
    )
    df = _read_fields(_with_fields(spark, folder), "bytes", reads)
    return df.select("event_id", *[F.md5(out).alias(out) for _, _, out in reads])


@query(
    "p2_typed_field_query",
    """
    SELECT page_id, CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([0-9]+)', 1)::BIGINT ELSE 0::BIGINT END AS page,
           CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([0-9]+)', 1) || ',' || page_id ELSE '' END AS pages,
           CASE WHEN url LIKE '%ref=%' THEN NULL ELSE 0::BIGINT END AS ref
    FROM pages
    """,
)
def typed_query_query(spark, folder):
    target = F.when(
        F.col("url").contains("page="), F.concat("url", F.lit("&page="), "page_id")
    ).otherwise(F.col("url"))
    df = parse_query(
        table(spark, folder, "pages").select("page_id", target.alias("target")), "target", "fields"
    ).drop("target")
    for key, as_, out in (("page", "int", "page"), ("page", "string", "pages"), ("ref", "int", "ref")):
        df = ev.typed_field(df, key, as_, "extproc", out=out)
    return df.drop("fields")


_LATEST = """
SELECT CAST(user_id AS VARCHAR) AS stream_id,
       epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 AS tick_us,
       max(event_id) AS seq, arg_max(event_type, event_id) AS data, count(*) AS messages
FROM events GROUP BY 1, 2
"""


def _latest_columns(df):
    return df.select(
        "stream_id",
        F.unix_micros("tick").alias("tick_us"),
        "seq",
        F.col("data").cast("string").alias("data"),
        "messages",
    )


@query("w1_conflate_latest", _LATEST)
def conflate_query(spark, folder):
    return _latest_columns(windows.conflate_latest(messages(spark, folder), "1 hour"))


@query("w1_conflate_latest_stream", _LATEST)
def conflate_stream_query(spark, folder):
    """The same windows from a stream: all of them, whatever files the table has."""
    return _latest_columns(
        run_table_as_stream(
            messages(spark, folder),
            lambda stream: windows.conflate_latest(stream, "1 hour", delay="1 second"),
            "conflated",
            ("1 hour", "1 second"),
        )
    )


@query(
    "w3_keep_latest_frame",
    """
    SELECT source AS stream_id, (1704067200 + doc_id // 60 * 60 + 60) * 1000000 AS tick_us,
           max(doc_id) AS seq, md5(arg_max(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END, doc_id)) AS data
    FROM documents GROUP BY source, doc_id // 60
    """,
)
def latest_frame_query(spark, folder):
    frames_ = table(spark, folder, "documents").select(
        F.col("source").alias("stream_id"),
        F.col("doc_id").alias("seq"),
        F.timestamp_micros((F.lit(1704067200) + F.col("doc_id")) * 1000000).alias("ts"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("data"),
    )
    return windows.keep_latest_frame(frames_, "1 minute").select(
        "stream_id", F.unix_micros("tick").alias("tick_us"), "seq", digest("data").alias("data")
    )


@query(
    "w4_connection_sessions",
    """
    WITH o AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p
               FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 7200000000 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY t) AS session FROM o)
    SELECT CAST(user_id AS VARCHAR) AS stream_id, min(t) AS start_us, max(t) + 7200000000 AS end_us,
           count(*) AS frames
    FROM s GROUP BY user_id, session
    """,
)
def sessions_query(spark, folder):
    return windows.connection_sessions(messages(spark, folder), "2 hours").select(
        "stream_id",
        F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"),
        "frames",
    )


# chunk, limit and trim of the snapshot queries
_CHUNK, _LIMIT, _TRIM = 1024, 16384, 12288

_SNAPSHOTS = f"""
WITH m AS (
  SELECT source, doc_id, doc_id // 20 AS tick, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents
),
offsets AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM m),
ticks AS (
  SELECT source, tick, CAST(max(upto) // {_CHUNK} AS BIGINT) AS chunks FROM offsets GROUP BY 1, 2
),
grown AS (
  SELECT *, lag(chunks, 1, 0) OVER (PARTITION BY source ORDER BY tick) AS before FROM ticks
),
cuts AS (
  SELECT source, tick, chunks * {_CHUNK} AS e,
         CAST(greatest(0, ceil((chunks * {_CHUNK} - {_LIMIT}) / {_TRIM}.0)) AS BIGINT) * {_TRIM} AS s
  FROM grown WHERE chunks > before
)
SELECT c.source AS stream_id, (1704067200 + (c.tick + 1) * 20) * 1000000 AS tick_us,
       c.s AS buffer_start, c.e AS buffer_end,
       md5(unhex(string_agg(substr(o.h, CAST(greatest(c.s - (o.upto - o.n), 0) * 2 + 1 AS BIGINT),
                  CAST((least(c.e, o.upto) - greatest(c.s, o.upto - o.n)) * 2 AS BIGINT)), '' ORDER BY o.doc_id))) AS body
FROM cuts c JOIN offsets o ON o.source = c.source AND o.upto > c.s AND o.upto - o.n < c.e
GROUP BY ALL
"""


def _byte_streams(spark, folder):
    return load_messages(
        spark,
        f"{folder}/documents.parquet",
        columns={
            "stream_id": "source",
            "seq": "doc_id",
            "ts": "timestamp_micros((1704067200 + doc_id) * 1000000)",
            "data": "cast(text as binary)",
        },
    )


def _snapshot_columns(df):
    return df.select(
        "stream_id",
        F.unix_micros("tick").alias("tick_us"),
        "buffer_start",
        "buffer_end",
        digest("body").alias("body"),
    )


@query("w2_rolling_snapshots", _SNAPSHOTS)
def snapshots_query(spark, folder):
    return _snapshot_columns(
        rolling.rolling_snapshots(_byte_streams(spark, folder), _CHUNK, _LIMIT, _TRIM, "20 seconds")
    )


@query("w2_rolling_snapshots_stream", _SNAPSHOTS)
def snapshots_stream_query(spark, folder):
    """The same snapshots, written by the stream itself as its ticks close."""
    return _snapshot_columns(
        run_table_as_stream(
            _byte_streams(spark, folder).select("stream_id", "seq", "ts", "data"),
            lambda stream: rolling.live_snapshots(stream, _CHUNK, _LIMIT, _TRIM, "20 seconds", "1 second"),
            "snapshots",
            ("20 seconds", "1 second"),
            settings=at_rest.HEAVY_STATE,
            bytes_a_core=at_rest.BYTES_A_CORE,
        )
    )


@query(
    "p22_ack_text",
    """
    SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'decode error' ELSE 'ACK: ' || event_type END AS ack
    FROM events
    """,
)
def ack_query(spark, folder):
    df = messages(spark, folder).withColumn(
        "data", F.when(F.col("seq") % 9 == 0, F.concat(F.lit(b"\xff\xfe"), "data")).otherwise(F.col("data"))
    )
    return frames.ack_text(df).select("seq", "ack")


_NUMBERED = """
    SELECT event_id AS seq, 'cam-' || user_id AS url,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_num
    FROM events
    """


@query("n1_number_frames", _NUMBERED)
def number_query(spark, folder):
    return _cameras(spark, folder).select("seq", "url", "frame_num")


@query("n1_number_frames_stream", _NUMBERED)
def number_stream_query(spark, folder):
    """The same numbers, given out by a running stream."""
    return _live_cameras(spark, folder).select("seq", "url", "frame_num")


def _frames_seen(spark, folder):
    return events(spark, folder).select(
        F.concat(F.lit("cam-"), "user_id").alias("url"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").cast("binary").alias("body"),
    )


def _cameras(spark, folder):
    return frames.number_frames(_frames_seen(spark, folder))


def _live_cameras(spark, folder, factor=1):
    """Frames without an event time or number come last, as in the SQL; a stream would leave them out."""
    seen = _frames_seen(spark, folder)
    # watermarks begin at the epoch: without any event time, a second after it
    behind = seen.agg(F.timestamp_micros(F.coalesce(F.unix_micros(F.max("ts")) + 1, F.lit(1_000_000)))).scalar()
    placed = seen.withColumns({"ts": F.coalesce("ts", behind), "place": F.coalesce("seq", F.lit((1 << 63) - 1))})
    return run_table_as_stream(
        placed,
        lambda stream: counters.live_frame_numbers(stream, order="place", factor=factor, delay="1 second"),
        "frames",
        ("1 second",),
        order="place",
        settings=KEYED_STATE,
    )


_EVERY_FIFTH = f"SELECT seq, url, frame_num FROM ({_NUMBERED}) WHERE frame_num % 5 = 0"


@query("n2_sample_every", _EVERY_FIFTH)
def sample_query(spark, folder):
    return frames.sample_every(_cameras(spark, folder), 5).select("seq", "url", "frame_num")


@query("n2_sample_every_stream", _EVERY_FIFTH)
def sample_stream_query(spark, folder):
    """The same frames, given out by a running stream."""
    return _live_cameras(spark, folder, 5).select("seq", "url", "frame_num")


@query(
    "j4_attach_frame_metadata",
    f"""
    WITH {PAGE_FRAMES}
    SELECT url, frame_num AS frame_number, ts_us, upper(md5(html)) AS output FROM page_frames
    """,
)
def metadata_query(spark, folder):
    numbered = frames.number_frames(page_frames(spark, folder))
    outputs = numbered.select(
        "url", "frame_num", F.upper(F.md5("body")).alias("output")
    )
    return frames.attach_frame_metadata(outputs, numbered).select(
        "url", "frame_number", F.unix_micros("timestamp").alias("ts_us"), "output"
    )


_ROUTED = """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'webhook' WHEN 'view' THEN 'websocket'
                                     WHEN 'purchase' THEN 'mjpeg' ELSE 'rtsp' END AS sink_kind
    FROM events WHERE event_type <> 'error'
    """
_SINKS = ["mjpeg", "rtsp", "webhook", "websocket"]


def _routed(spark, folder):
    kind = F.col("event_type")
    return events(spark, folder).select(
        "event_id",
        F.when(kind == "click", "webhook")
        .when(kind == "view", "websocket")
        .when(kind == "purchase", "mjpeg")
        .when(kind == "signup", "rtsp")
        .alias("sink_kind"),
        "ts",
    )


@query("k1_route_outputs", _ROUTED)
def route_query(spark, folder):
    """Written in one pass, a folder per sink, and read back."""
    df = _routed(spark, folder).drop("ts")
    path = scratch_path(spark, "routed")
    delivery.save_outputs(df, path, _SINKS)
    return spark.read.schema(df.schema).parquet(path)


@query("k1_route_outputs_stream", _ROUTED)
def route_stream_query(spark, folder):
    """The same from a stream, a micro-batch at a time."""
    df = _routed(spark, folder)
    source, path = scratch_path(spark, "sent"), scratch_path(spark, "routed")
    df.write.parquet(source)
    stream = at_rest.read_staged(spark, source, df.schema)
    delivery.save_stream(stream, path, _SINKS, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "sink_kind")


@query(
    "k3_delivery_outcomes",
    """
    WITH a AS (
      SELECT l_orderkey, l_linenumber AS attempt,
             CASE l_returnflag WHEN 'A' THEN 503 WHEN 'R' THEN 200 END AS status,
             CASE l_returnflag WHEN 'A' THEN 'status 503' WHEN 'N' THEN 'no answer' END AS error
      FROM lineitem WHERE l_linenumber <= 4),
    f AS (
      SELECT l_orderkey, min(CASE WHEN status BETWEEN 200 AND 299 THEN attempt END) AS good, max(attempt) AS last
      FROM a GROUP BY 1)
    SELECT f.l_orderkey AS delivery_id, good IS NOT NULL AS delivered, coalesce(good, last) AS attempts,
           CASE WHEN good IS NULL THEN
             (SELECT max(error) FROM a WHERE a.l_orderkey = f.l_orderkey AND a.attempt = f.last) END AS error
    FROM f
    """,
)
def outcomes_query(spark, folder):
    flag = F.col("l_returnflag")
    attempts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("delivery_id"),
        F.col("l_linenumber").alias("attempt"),
        F.when(flag == "A", 503).when(flag == "R", 200).alias("status"),
        F.when(flag == "A", "status 503").when(flag == "N", "no answer").alias("error"),
    )
    return delivery.delivery_outcomes(attempts)


@query(
    "k5_fan_out",
    """
    WITH c AS (
      SELECT event_id AS client_id, user_id, epoch_us(ts) AS c0,
             CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) * 10 END AS c1
      FROM events WHERE event_type = 'signup')
    SELECT e.event_id AS seq, CAST(e.user_id AS VARCHAR) AS stream_id, CAST(c.client_id AS VARCHAR) AS client_id
    FROM events e JOIN c ON c.user_id = e.user_id AND epoch_us(e.ts) >= c0 AND (c1 IS NULL OR epoch_us(e.ts) < c1)
    """,
)
def fan_out_query(spark, folder):
    seen = events(spark, folder)
    stay = F.round(F.col("value") * 60000000).cast("long") * 10
    clients = seen.filter("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("client_id"),
        F.col("user_id").cast("string").alias("stream_id"),
        F.col("ts").alias("connect_ts"),
        F.when(F.col("event_id") % 4 > 0, F.timestamp_micros(F.unix_micros("ts") + stay)).alias("disconnect_ts"),
    )
    sent = messages(spark, folder).select("stream_id", "seq", "ts")
    return delivery.fan_out(sent, clients, "1 day").select("seq", "stream_id", "client_id")
