"""User functions over events."""

import asyncio
import hashlib
import inspect
import json
import logging
import sys
import time
import traceback
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from types import SimpleNamespace
from typing import Any, Iterator, Tuple

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F, types as T

from ..functions.batches import bounded
from .bodies import PIECE_ERROR
from .http import apply_response, handles_phase, resolve_status
from .metrics import request_attributes, response_attributes

_RESPONSE = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("content_type", T.StringType()),
    ]
)
_ANSWER = T.StructType(
    [
        T.StructField("responses", T.ArrayType(_RESPONSE)),
        T.StructField("start", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
    ]
)


_STATUS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("ended", T.TimestampType()),
        T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class Response:
    """What a handler may return besides text, bytes and JSON values."""

    body: Any = None
    headers: dict = field(default_factory=dict)
    content_type: str = "text/plain"
    status_code: int = 200


class Context:
    """Given to ``init`` and to every call; a handler may keep its own state on it."""

    Response = Response

    def __init__(self):
        self.logger = logging.getLogger("millrace.handler")
        self.user_data = SimpleNamespace()


def as_response(value):
    """Response of any returned value: (status, body) pairs, text, bytes or JSON."""
    if isinstance(value, Response):
        return value
    if isinstance(value, tuple) and len(value) == 2:
        return Response(body=value[1], status_code=value[0])
    if isinstance(value, (str, bytes)):
        return Response(body=value)
    if value is None:
        return Response(body=b"")
    return Response(body=json.dumps(value), content_type="application/json")


def _body_bytes(body):
    if body is None:
        return b""
    if isinstance(body, bytes):
        return body
    return (body if isinstance(body, str) else json.dumps(body)).encode()


def _row(response):
    return {
        "status": int(response.status_code),
        "headers": [(str(k), str(v)) for k, v in (response.headers or {}).items()],
        "body": _body_bytes(response.body),
        "content_type": response.content_type or "",
    }


def _failure(exc):
    text = 'Exception caught in handler - "{0}": {1}'.format(exc, traceback.format_exc())
    return _row(Response(body=text, status_code=500))


def call_handler(fn, context, event):
    """(responses, start, duration) of one call; an exception becomes one response 500."""
    start = time.time()
    try:
        value = fn(context, event)
        if inspect.iscoroutine(value):
            value = asyncio.run(value)
        rows = [_row(as_response(v)) for v in (value if isinstance(value, list) else [value])]
    except Exception as exc:
        rows = [_failure(exc)]
    # a clock too coarse for the call still gives a positive duration
    duration = max(time.time() - start, 0.0) or sys.float_info.min
    return rows, start, duration


def _calls(fn, init):
    """Arrow iterator UDF: ``init`` runs once per task, before its first event."""
    response_type = pa.struct(
        [
            ("status", pa.int32()),
            ("headers", pa.map_(pa.string(), pa.string())),
            ("body", pa.binary()),
            ("content_type", pa.string()),
        ]
    )
    answer_type = pa.struct(
        [
            ("responses", pa.list_(response_type)),
            ("start", pa.timestamp("us", "UTC")),
            ("duration", pa.float64()),
        ]
    )

    def run(batches):
        context = Context()
        if init is not None:
            init(context)
        for events, called in batches:
            # a batch is neither taken apart nor answered whole: its events and answers come one by one
            for answers in bounded(answered(context, events, called), answer_size):
                yield pa.array(answers, answer_type)

    def answered(context, events, called):
        for seen, wanted in zip(events, called.to_pylist()):
            if not wanted:
                yield None
                continue
            event = seen.as_py()
            for name in ("headers", "fields"):
                event[name] = dict(event.get(name) or {})
            rows, start, duration = call_handler(fn, context, SimpleNamespace(**event))
            yield {"responses": rows, "start": int(start * 1e6), "duration": duration}

    def answer_size(answer):
        return sum(len(row["body"]) for row in answer["responses"]) if answer else 0

    def annotated(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    # the calls may have effects: the optimizer must not repeat them
    return F.arrow_udf(annotated, _ANSWER).asNondeterministic()


# Columns of a row a handler sees as attributes of its event, where the table has them.
EVENT_COLUMNS = (
    "trigger",
    "stream_id",
    "seq",
    "ts",
    "phase",
    "method",
    "path",
    "url",
    "content_type",
    "headers",
    "fields",
    "body",
)


def _answered(df, fn, init, only=None):
    seen = [F.col(c) for c in EVENT_COLUMNS if c in df.columns]
    called = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    # only what the handler sees goes to Python; the row's other columns stay in the JVM
    event = F.when(called, F.struct(*seen))
    answered = df.withColumn("__answer", _calls(fn, init)(event, called))
    # true of every row; it keeps the calls in the plan when nobody reads their answers
    return answered.filter(F.col("__answer").isNotNull() | ~called)


def _spread(df, prefix=""):
    """Columns of the first response."""
    first = F.get(F.col("__answer.responses"), F.lit(0))
    return df.withColumns(
        {
            "status": first["status"],
            "response_headers": first["headers"],
            "response_body": first["body"],
            "response_type": first["content_type"],
            "start": F.col("__answer.start"),
            "duration": F.col("__answer.duration"),
        }
    ).drop("__answer")


def apply_handler(df, fn, init=None):
    """Call ``fn(context, event)`` on every row and append its response.

    Text, bytes, JSON values and ``Response`` are accepted; a list is answered by
    :func:`apply_batched`. Filters belong before this call: none is pushed through it.
    """
    return _spread(_answered(df, fn, init))


def apply_batched(df, fn, init=None):
    """As :func:`apply_handler` for handlers that may return a list: an array of responses."""
    answered = _answered(df, fn, init)
    return answered.withColumns(
        {
            "responses": F.col("__answer.responses"),
            "start": F.col("__answer.start"),
            "duration": F.col("__answer.duration"),
        }
    ).drop("__answer")


def flatten_batched(df, responses="responses"):
    """One row per response of a batched answer, in order; an empty answer gives none."""
    others = [c for c in df.columns if c != responses]
    flat = df.select(*others, F.posexplode(responses).alias("response_pos", "__r"))
    return flat.select(
        *others,
        "response_pos",
        F.col("__r.status").alias("status"),
        F.col("__r.headers").alias("response_headers"),
        F.col("__r.body").alias("response_body"),
        F.col("__r.content_type").alias("response_type"),
    )


#: Answers that are given out together, and about how many bytes of them.
ANSWERS_AT_ONCE, ANSWER_BYTES = 1 << 12, 8 << 20


def apply_answers(df, fn, init=None):
    """One row per answer of ``fn(context, event)``, given out as the handler makes them.

    A handler may return one value or a list, or be a generator: its answers are passed on a few
    thousand at a time, so one event may have any number of them. Appended are ``response_pos``
    from 0 and the response's columns; an empty answer gives no row. An exception becomes a
    response 500 behind the answers that came before it. All columns of the table pass through
    Python; drop those that are not needed before the call.
    """
    names = [f.name for f in df.schema]
    seen = [c for c in EVENT_COLUMNS if c in names]
    added = pa.schema(
        [
            ("response_pos", pa.int32()), ("status", pa.int32()), ("response_headers", pa.map_(pa.string(), pa.string())),
            ("response_body", pa.binary()), ("response_type", pa.string()),
        ]
    )

    def run(batches):
        context = Context()
        if init is not None:
            init(context)
        for batch in batches:
            held, size = [], 0
            for k, event in enumerate(batch.select(seen).to_pylist()):
                for name in ("headers", "fields"):
                    event[name] = dict(event.get(name) or {})
                for at, row in enumerate(_answers(fn, context, SimpleNamespace(**event))):
                    held.append((k, at, row["status"], row["headers"], row["body"], row["content_type"]))
                    size += len(row["body"])
                    if len(held) == ANSWERS_AT_ONCE or size >= ANSWER_BYTES:
                        yield given(batch, held)
                        held, size = [], 0
            if held:
                yield given(batch, held)

    def given(batch, held):
        place, *columns = zip(*held)
        own = batch.take(pa.array(place, pa.int64()))
        answers = [pa.array(c, f.type) for c, f in zip(columns, added)]
        return pa.RecordBatch.from_arrays([*own.columns, *answers], [*names, *added.names])

    schema = T.StructType(
        [
            *df.schema.fields, T.StructField("response_pos", T.IntegerType()), T.StructField("status", T.IntegerType()),
            T.StructField("response_headers", T.MapType(T.StringType(), T.StringType())),
            T.StructField("response_body", T.BinaryType()), T.StructField("response_type", T.StringType()),
        ]
    )
    return df.mapInArrow(run, schema)


def _answers(fn, context, event):
    """Response rows of one call, one after another."""
    try:
        value = fn(context, event)
        if inspect.iscoroutine(value):
            value = asyncio.run(value)
        for one in value if isinstance(value, list) or inspect.isgenerator(value) else [value]:
            yield _row(as_response(one))
    except Exception as exc:
        yield _failure(exc)


def _by_name(fn):
    """Call with ``context`` and ``event`` where the function names them."""
    wanted = [p for p in inspect.signature(fn).parameters if p in ("context", "event")]

    def call(context, event):
        given = {"context": context, "event": event}
        return fn(**{name: given[name] for name in wanted})

    return call


def apply_serve(df, fn, init=None):
    """User function whose arguments are injected by name; its return value passes through."""
    return apply_handler(df, _by_name(fn), init)


def apply_operator(df, fn, mode, init=None):
    """Call a handler on the phases its mode handles and apply its answers to the flow.

    Reads the event columns, ``phase`` and ``has_body``; other phases continue untouched and
    are not sent to the handler. A body the table says is cut into several ``segments`` is an
    error: a handler never sees a piece unnoticed.
    """
    if "segments" in df.columns:
        whole = F.when(F.col("segments") > 1, F.raise_error(F.lit(PIECE_ERROR)).cast("binary")).otherwise(F.col("body"))
        df = df.withColumn("body", whole)
    answered = _spread(_answered(df, fn, init, handles_phase(mode)))
    resolved = resolve_status(answered, "status", "response_headers")
    return apply_response(resolved, mode)


def observe(df, fn, content=False, init=None):
    """Call a handler and append start, end and the request and response attributes.

    The result is kept beside the attributes; an exception shows as status 500.
    """
    called = apply_handler(df, fn, init)
    timed = called.withColumn(
        "end", F.timestamp_micros(F.unix_micros("start") + (F.col("duration") * 1e6).cast("long"))
    )
    attributed = response_attributes(
        request_attributes(timed, content, "__request"), content, out="__response"
    )
    return attributed.withColumn("attributes", F.map_concat("__request", "__response")).drop(
        "__request", "__response"
    )


def stored_statuses(spark, path):
    """The status table at ``path``: one row a run, empty where no run has ended yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_STATUS).parquet(path) if there else spark.createDataFrame([], _STATUS)


def store_status(spark, path, status):
    """Add a run's status to the table at ``path`` and return what is stored of that run.

    A run has one file, named by its id. The row is written aside and renamed, which fails where
    the file is there already: of two runs with one id the status stored first stays, and no
    reader sees half a row.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = hashlib.sha256(status["run_id"].encode()).hexdigest()
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    status_row(spark, status).coalesce(1).write.parquet(aside)
    here = jvm.org.apache.hadoop.fs.Path(aside)
    fs = here.getFileSystem(conf)
    (written,) = [f.getPath() for f in fs.listStatus(here) if f.getPath().getName().startswith("part-")]
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    try:
        files.rename(fs.makeQualified(written), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")), options)
    except Py4JJavaError as exc:
        if "FileAlreadyExistsException" not in str(exc.java_exception):
            raise
    finally:
        fs.delete(here, True)
    row = stored_statuses(spark, path).filter(F.col("run_id") == status["run_id"]).first().asDict()
    return {k: v for k, v in row.items() if v is not None}


def run_job(fn, inputs, save, params=None, run_id="job", stored_status=None, status_path=None):
    """Run a batch job: named input tables and parameters to named output tables.

    ``fn`` gets what it names of the inputs and parameters and returns a dict of DataFrames
    (or one DataFrame, named ``output``). ``save(name, df)`` writes an output and returns it
    read back; writing is part of the run, so COMPLETED means that everything was computed.
    Returns (outputs, status); the status already stored wins over the new one. An exception,
    in ``fn`` or while an output is computed, fails the run: it is raised with the status as
    its ``status`` attribute, end time included. With ``status_path`` the status of a run, also
    of one that fails, goes to the table there, see :func:`store_status`.
    """
    now = lambda: datetime.now(timezone.utc)
    status = {"run_id": run_id, "state": "RUNNING", "started": now()}
    outputs = {}
    try:
        available = {**(params or {}), **inputs}
        names = inspect.signature(fn).parameters
        takes_any = any(p.kind is p.VAR_KEYWORD for p in names.values())
        value = fn(**{k: v for k, v in available.items() if takes_any or k in names})
        made = value if isinstance(value, dict) else {"output": value}
        outputs = {name: save(name, df) for name, df in made.items()}
        status.update(state="COMPLETED", outputs=sorted(outputs))
    except Exception as exc:
        status.update(state="ERROR", error=str(exc))
        exc.status = status
        raise
    finally:
        status["ended"] = now()
        if status_path:
            spark = next(iter(inputs.values())).sparkSession
            status.update(store_status(spark, status_path, {**status, **(stored_status or {})}))
    return outputs, {**status, **(stored_status or {})}


def status_row(spark, status):
    """A run's status as a one-row table, to be appended to the status table."""
    row = {name: status.get(name) for name in _STATUS.fieldNames()}
    return spark.createDataFrame([row], _STATUS)
