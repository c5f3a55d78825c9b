"""Event envelope, field access, union, unknown triggers."""

from functools import reduce

from pyspark.sql import functions as F

from ..envelope import ENVELOPE
from ..functions.headers import EMPTY_TEXT, merge_maps
from ..functions.text import (
    number_digits,
    number_exponent,
    number_text,
    parse_integer,
    plain_number,
    short_number,
)
from ..functions.variants import (
    as_bool,
    as_double,
    as_long,
    as_text,
    field_integer,
    field_text,
    kind_of_schema,
    member,
    with_kind,
)
from .scans import salted_join

# Trigger kinds and their class (fixed values).
TRIGGER_CLASS = {
    "job": "async",
    "mjpeg": "async",
    "websocket": "async",
    "rtsp": "async",
    "openinference": "sync",
    "extproc": "sync",
}


def _texts_of(mapping):
    """VARIANT values as text, for the envelope's text-only field map."""

    def text(value, kind):
        return (
            F.when(kind == "string", as_text(value))
            .when(kind == "int", as_long(value).cast("string"))
            .when(kind == "float", number_text(as_double(value)))
            .when(kind == "bool", as_bool(value).cast("string"))
            .when(kind == "other", F.to_json(value))
        )

    return F.transform_values(with_kind(mapping), lambda _, v: text(v["value"], v["kind"]))


def _job(has):
    return {
        "stream_id": F.col("run_id") if has("run_id") else F.col("stream_id"),
        "method": F.col("method"),
        "path": F.col("path"),
        "url": F.lit(""),
        "content_type": F.lit(""),
        "headers": F.col("headers"),
        "fields": F.col("fields"),
        "body": F.col("body"),
    }


def _mjpeg(has):
    return {
        "stream_id": F.col("url"),
        "seq": F.col("frame_num"),
        "method": F.lit(""),
        "path": F.col("url"),
        "url": F.col("url"),
        "content_type": F.lit("image/jpeg"),
        "fields": F.create_map(
            F.lit("frame_num"),
            F.col("frame_num").cast("string"),
            F.lit("url"),
            F.col("url"),
            F.lit("timestamp"),
            F.unix_micros("ts").cast("string"),
        ),
        "body": F.col("body"),
    }


def _message(method):
    def columns(has):
        return {
            "method": F.lit(method),
            "path": F.lit(""),
            "content_type": F.lit("application/octet-stream"),
            "headers": F.col("attributes") if has("attributes") else F.lit(None),
            "fields": F.col("attributes") if has("attributes") else F.lit(None),
            "body": F.col("data") if has("data") else F.col("body"),
        }

    return columns


def _openinference(has):
    headers = F.create_map(
        F.lit("X-Model-Name"),
        F.col("model_name"),
        F.lit("X-Model-Version"),
        F.col("model_version"),
        F.lit("X-Request-ID"),
        F.col("id"),
    )
    if has("protocol"):
        headers = F.when(
            F.col("protocol") == "grpc",
            F.map_concat(headers, F.create_map(F.lit("X-Protocol"), F.lit("grpc"))),
        ).otherwise(headers)
    return {
        "stream_id": F.col("id"),
        "method": F.lit("POST"),
        "path": F.concat(F.lit("/v2/models/"), F.col("model_name"), F.lit("/infer")),
        "url": F.lit(""),
        "content_type": F.lit("application/json"),
        "headers": headers,
        "fields": _texts_of(F.col("parameters")),
        "body": F.col("body"),
    }


def _extproc(has):
    text = F.coalesce(F.col("headers"), F.expr(EMPTY_TEXT))
    if has("raw_headers"):
        # header bytes are taken as they are: raw wins over text
        raw = F.transform_values(
            F.coalesce("raw_headers", F.expr("cast(map() as map<string,binary>)")),
            lambda _, v: v.cast("string"),
        )
        text = merge_maps(text, raw)
    return {
        "method": F.coalesce("method", F.lit("")),
        "path": F.coalesce("path", F.lit("")),
        "content_type": F.coalesce(F.try_element_at(text, F.lit("Content-Type")), F.lit("")),
        "headers": text,
        "fields": F.transform_values("query", lambda _, v: F.array_join(v, ",")),
        "body": F.col("body"),
    }


_SHAPES = {
    "job": _job,
    "mjpeg": _mjpeg,
    "websocket": _message("websocket"),
    "rtsp": _message("rtsp"),
    "openinference": _openinference,
    "extproc": _extproc,
}


def normalize_events(df, trigger):
    """Trigger rows to the event envelope."""
    if trigger not in _SHAPES:
        raise ValueError(f"unknown trigger: {trigger}")
    has = set(df.columns).__contains__
    shape = {
        "trigger": F.lit(trigger),
        "class": F.lit(TRIGGER_CLASS[trigger]),
        **_SHAPES[trigger](has),
    }
    columns = []
    for field in ENVELOPE:
        if field.name in shape:
            source = shape[field.name]
        else:
            source = F.col(field.name) if has(field.name) else F.lit(None)
        columns.append(source.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _query_field(column, key, as_):
    """A field of a query map (name to list of text values)."""
    values = F.try_element_at(F.col(column), F.lit(key))
    if as_ == "string":
        return F.coalesce(F.array_join(values, ","), F.lit(""))
    return F.when(
        F.coalesce(F.size(values), F.lit(0)) > 0, parse_integer(F.get(values, F.lit(0)))
    ).otherwise(F.lit(0).cast("bigint"))


def typed_field(df, key, as_, trigger, column="fields", out="field"):
    """Append one event field, coerced by its trigger's rule; see :func:`typed_fields`."""
    return typed_fields(df, [(key, as_, trigger, out)], column)


def typed_fields(df, reads, column="fields"):
    """Append event fields ``(key, as_, trigger, out)``, each coerced by its trigger's rule.

    ``as_`` is string, int or bytes: the UTF-8 of a text, null for what is none. ``column`` is a VARIANT object or a map of
    VARIANT or of text; for *extproc* it is the query map (name to list of text values).

    A key is read once however many fields are made of it, its kind is found once, and only
    floats that become text are spelled out. Each step is one projection for all keys, so what
    later steps use several times is computed once.
    """
    for _, as_, trigger, _ in reads:
        if as_ not in ("string", "int", "bytes"):
            raise ValueError(f"as_ must be 'string', 'int' or 'bytes': {as_}")
        if trigger not in _SHAPES:
            raise ValueError(f"unknown trigger: {trigger}")
    kind_of_column = df.schema[column].dataType
    is_map = kind_of_column.typeName() == "map"

    def source(key):
        if not is_map:
            return member(F.col(column), key)
        found = F.try_element_at(F.col(column), F.lit(key))
        # a field map of texts only, as the envelope has it
        return found.cast("variant") if kind_of_column.valueType.typeName() == "string" else found

    plain = [r for r in reads if r[2] != "extproc"]
    keys = list(dict.fromkeys(r[0] for r in plain))
    spelled = [k for k, key in enumerate(keys) if any(r[0] == key and r[1] == "string" and r[2] == "job" for r in plain)]
    every = range(len(keys))
    name = "__{}_{}".format
    steps = [
        {name("value", k): source(keys[k]) for k in every},
        {name("schema", k): F.schema_of_variant(name("value", k)) for k in every},
        {name("kind", k): kind_of_schema(F.col(name("schema", k))) for k in every},
        {name("double", k): F.when(F.col(name("kind", k)) == "float", as_double(F.col(name("value", k)))) for k in spelled},
        {name("short", k): short_number(F.col(name("double", k))) for k in spelled},
        {
            name(part, k): make(F.col(name("short", k)))
            for k in spelled
            for part, make in (("digits", number_digits), ("exponent", number_exponent))
        },
    ]
    found = df
    for step in steps:
        if step:
            found = found.withColumns(step)

    def result(key, as_, trigger):
        if trigger == "extproc":
            value = _query_field(column, key, "int" if as_ == "int" else "string")
            return value.cast("binary") if as_ == "bytes" else value
        k = keys.index(key)
        own = lambda part: F.col(name(part, k))
        if as_ == "int":
            return field_integer(own("value"), own("kind"), trigger)
        if as_ == "bytes":
            return F.when(own("kind") == "string", as_text(own("value")).cast("binary"))
        number = plain_number(own("short"), own("digits"), own("exponent")) if trigger == "job" else None
        return field_text(own("value"), own("kind"), trigger, number)

    made = found.withColumns({out: result(key, as_, trigger) for key, as_, trigger, out in reads})
    return made.drop(*[c for step in steps for c in step])


def union_events(*dfs):
    """Envelopes of several triggers as one table: all triggers feed the same handler."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unrouted(events, kinds, salt_by=("seq",)):
    """Events whose trigger kind is not known.

    ``kinds`` is a short list of names, or a DataFrame with a ``trigger`` column.
    """
    if not hasattr(kinds, "select"):
        return events.filter(F.col("trigger").isNull() | ~F.col("trigger").isin(list(kinds)))
    known = kinds.select("trigger").distinct()
    return salted_join(events, known, ["trigger"], salt_by, "left_anti")
