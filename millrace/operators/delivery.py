"""Delivery of results: routing, retries, outcomes, fan-out."""

import time

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from ..functions.timing import tick_of
from .scans import salted_join

UNKNOWN_SINK = "sink factory not found: "

_DELIVERY = T.StructType(
    [
        T.StructField("delivered", T.BooleanType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("last_status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

# Content type sent when none is given (fixed value).
DEFAULT_TYPE = "application/octet-stream"


def checked_kinds(df, kinds):
    """Rows that have a sink; one of an unknown kind fails the query that reads it."""
    kind = F.col("sink_kind")
    known = F.when(kind.isin(list(kinds)), kind).otherwise(
        F.raise_error(F.concat(F.lit(UNKNOWN_SINK), kind)).cast("string")
    )
    return df.filter(kind.isNotNull()).withColumn("sink_kind", known)


def route_outputs(df, routes):
    """Give the rows of each sink kind to its writer, ``routes[kind](rows)``.

    Rows without a sink are dropped; an unknown kind raises before anything is written. The
    rows are read once for the check and once per kind, so give a table that is kept, such as
    a micro-batch in :func:`stream_outputs`; a batch is written in one pass by
    :func:`save_outputs`.
    """
    unknown = (
        df.filter(F.col("sink_kind").isNotNull() & ~F.col("sink_kind").isin(list(routes)))
        .select("sink_kind")
        .first()
    )
    if unknown is not None:
        raise ValueError(UNKNOWN_SINK + unknown["sink_kind"])
    for kind, write in routes.items():
        write(df.filter(F.col("sink_kind") == kind))


def save_outputs(df, path, kinds, mode="append"):
    """Write all routed rows in one pass, a folder per sink kind."""
    checked_kinds(df, kinds).write.mode(mode).partitionBy("sink_kind").parquet(path)


def save_stream(df, path, kinds, checkpoint):
    """Write all routed rows of a stream, each micro-batch in one pass; returns the unstarted writer.

    A micro-batch has a folder of its own, with one for each sink kind in it, and is committed as a
    whole: an unknown kind fails it before any of its rows is there, and a batch that is given
    again replaces what it wrote. Read the folder back with its ``batch`` and ``sink_kind``.
    """

    def write(batch, batch_id):
        save_outputs(batch, f"{path}/batch={batch_id}", kinds, "overwrite")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_outputs(df, routes, checkpoint):
    """Route every micro-batch of a stream; returns the unstarted writer.

    A micro-batch may be given again after a failure, so a writer gets the batch number as
    well, ``routes[kind](rows, batch_id)``, to replace what it wrote under that number.
    """

    def write(batch, batch_id):
        batch.persist()
        try:
            route_outputs(
                batch,
                {k: (lambda rows, w=w: w(rows, batch_id)) for k, w in routes.items()},
            )
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _deliver_one(send, payload, headers, max_retries, retry_delay):
    status, error = None, None
    for attempt in range(1, max_retries + 2):
        if attempt > 1 and retry_delay:
            time.sleep(retry_delay)
        try:
            status = int(send(payload, headers))
        except Exception as exc:
            status, error = None, f"failed to send request: {exc}"
            continue
        if 200 <= status < 300:
            return True, attempt, status, None
        error = f"webhook returned status {status}"
    return False, max_retries + 1, status, f"webhook failed after {max_retries + 1} attempts: {error}"


def deliver(
    df, send, max_retries=3, retry_delay=1.0, message_type="binary", headers=None, payload="payload"
):
    """Send every payload and append how it went.

    ``send(payload, headers)`` returns a status; 2xx is success, anything else (or an
    exception) is tried again up to ``max_retries`` times. Delivery is at least once: a task
    that is run again sends again. ``max_retries=0`` sends at most once per run. ``text``
    decodes the payload as UTF-8.
    """
    if message_type not in ("binary", "text"):
        raise ValueError(f"invalid message type: {message_type} (must be 'text' or 'binary')")
    sent = dict(headers or {})
    if not any(name.lower() == "content-type" for name in sent):
        sent["Content-Type"] = DEFAULT_TYPE

    @F.arrow_udf(_DELIVERY)
    def told(payloads: pa.Array) -> pa.Array:
        results = []
        for data in payloads.to_pylist():
            message = (data or b"").decode("utf-8") if message_type == "text" else (data or b"")
            results.append(_deliver_one(send, message, dict(sent), max_retries, retry_delay))
        kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.string())
        columns = zip(*results) if results else ([],) * 4
        return pa.StructArray.from_arrays(
            [pa.array(list(column), kind) for column, kind in zip(columns, kinds)],
            names=["delivered", "attempts", "last_status", "error"],
        )

    # calls have effects: none is repeated by the optimizer, and the filter, true of every
    # row, keeps them in the plan when nobody reads how they went
    outcome = told.asNondeterministic()(F.col(payload))
    parts = ("delivered", "attempts", "last_status", "error")
    return (
        df.withColumn("__told", outcome)
        .filter(F.col("__told").isNotNull())
        .select(*df.columns, *[F.col(f"__told.{name}").alias(name) for name in parts])
    )


def stream_deliveries(df, send, log, checkpoint, **options):
    """Deliver every micro-batch of a stream and keep its outcomes under ``log``.

    The log of a batch appears as a whole once all its rows were sent, so a batch that comes
    again after that is not sent again. Returns the unstarted writer.
    """

    def write(batch, batch_id):
        path = f"{log}/batch_id={batch_id}"
        try:
            batch.sparkSession.read.parquet(path)
        except AnalysisException:
            deliver(batch, send, **options).write.mode("overwrite").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def delivery_outcomes(attempts, max_retries=3):
    """One row per delivery from its attempt log.

    Only the first ``max_retries + 1`` attempts count; a first success ends a delivery, else
    all its attempts were used and the last error stands.
    """
    counted = attempts.filter(F.col("attempt") <= max_retries + 1)
    success = F.col("status").between(200, 299)
    folded = counted.groupBy("delivery_id").agg(
        F.min(F.when(success, F.col("attempt"))).alias("__first"),
        F.max("attempt").alias("__last"),
        F.max(F.when(~F.coalesce(success, F.lit(False)), F.struct("attempt", "error"))).alias("__error"),
    )
    return folded.select(
        "delivery_id",
        F.col("__first").isNotNull().alias("delivered"),
        F.coalesce("__first", "__last").alias("attempts"),
        F.when(F.col("__first").isNull(), F.col("__error.error")).alias("error"),
    )


def fan_out(frames, clients, bucket="1 hour"):
    """Every frame with every client connected to its stream at that time.

    A client is connected from ``connect_ts`` up to but not including ``disconnect_ts`` (null
    while it still is). Connections that ended are cut at bucket borders, so frames meet only
    clients of their own stream and bucket. Open ones are not cut, they would reach into every
    bucket to come: they meet the frames of their stream, nearly all of which they get. A busy
    stream or bucket is spread by frame time.
    """
    until = frames.groupBy("stream_id").agg(F.max("ts").alias("__until"))
    first = tick_of(F.col("connect_ts"), bucket)
    last = tick_of(F.least("disconnect_ts", "__until"), bucket)
    open_ = F.col("disconnect_ts").isNull()
    present = (
        salted_join(clients.filter(~open_), until, ["stream_id"], ["client_id"])
        .filter(last >= first)
        .select(
            "stream_id",
            "client_id",
            "connect_ts",
            "disconnect_ts",
            F.explode(F.sequence(first, last)).alias("__bucket"),
        )
    )
    seen = frames.withColumn("__bucket", tick_of(F.col("ts"), bucket))
    connected = (F.col("ts") >= F.col("connect_ts")) & (F.col("ts") < F.col("disconnect_ts"))
    ended = (
        salted_join(seen, present, ["stream_id", "__bucket"], ["ts"])
        .filter(connected)
        .drop("__bucket")
    )
    staying = clients.filter(open_).select("stream_id", "client_id", "connect_ts", "disconnect_ts")
    still = salted_join(frames, staying, ["stream_id"], ["ts"]).filter(
        F.col("ts") >= F.col("connect_ts")
    )
    return ended.unionByName(still)
