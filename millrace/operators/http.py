"""HTTP exchanges: headers, targets, phases, statuses, mutations."""

from pyspark.sql import functions as F

from ..envelope import (
    REQUEST_BODY,
    REQUEST_HEADERS,
    REQUEST_TRAILERS,
    RESPONSE_BODY,
    RESPONSE_HEADERS,
    RESPONSE_TRAILERS,
)
from ..functions import headers as H, targets
from ..functions.text import parse_integer
from ..functions.variants import as_long, as_text, is_number, kind_of
from .scans import running, running_last

# Message kinds and their phase numbers (fixed values).
PHASES = {
    "request_headers": REQUEST_HEADERS,
    "request_body": REQUEST_BODY,
    "request_trailers": REQUEST_TRAILERS,
    "response_headers": RESPONSE_HEADERS,
    "response_body": RESPONSE_BODY,
    "response_trailers": RESPONSE_TRAILERS,
}

# Header mutation actions (fixed values).
APPEND = "APPEND_IF_EXISTS_OR_ADD"
ADD = "ADD_IF_ABSENT"
OVERWRITE = "OVERWRITE_IF_EXISTS_OR_ADD"
ACTIONS = (APPEND, ADD, OVERWRITE)

PHASE_HEADER = "processing-phase"
STATUS_HEADER = "X-Processing-Status"
NAMES_HEADER = "x-extproc-names"
DURATION_HEADER = "x-extproc-duration-ns"


def split_headers(df, pairs="pairs"):
    """Pairs (name, value, raw) to the text map and the raw map."""
    text, raw = H.split_pairs(F.col(pairs))
    return df.withColumns({"headers": text, "raw_headers": raw})


def stringify_headers(df, out="all_headers"):
    """One text map of both header maps."""
    return df.withColumn(out, H.stringified(F.col("headers"), F.col("raw_headers")))


def header(df, name, out=None):
    """Append one header as text."""
    return df.withColumn(out or name, H.header_text(name))


def drop_headers(df, names=(), prefix=None, suffix=None, where=None):
    """Remove headers from both maps by name, prefix, suffix or a predicate on the name."""
    return df.withColumns(
        {
            column: H.without(F.col(column), names, prefix, suffix, where)
            for column in ("headers", "raw_headers")
        }
    )


def request_target(df):
    """Scheme, authority, method, full path, path and query of the pseudo headers, then drop those."""
    pseudo = {
        out: F.coalesce(H.header_text(name), F.lit(""))
        for out, name in (
            ("scheme", ":scheme"),
            ("authority", ":authority"),
            ("method", ":method"),
            ("full_path", ":path"),
        )
    }
    read = df.withColumns(pseudo).withColumn("path", targets.path_of(F.col("full_path")))
    return drop_headers(parse_query(read, "full_path"), prefix=":")


def parse_query(df, target, out="query"):
    """Append the query map of a request target (name to list of values).

    Only the text up to a second ``?`` counts; null without a ``?`` and when any pair is bad.
    """
    # a projection a step: the pairs are decoded once, however often the last step uses them
    return (
        df.withColumn("__text", targets.query_text(F.col(target)))
        .withColumn("__pairs", targets.query_pairs(F.col("__text")))
        .withColumn(out, targets.query_map(F.col("__text"), F.col("__pairs")))
        .drop("__text", "__pairs")
    )


def request_id(df, header="x-request-id", fallback=""):
    """Append the request id header, or the fallback when there is none."""
    return df.withColumn("request_id", F.coalesce(H.header_text(header), F.lit(fallback)))


def has_body(df):
    """Append whether the headers announce a body."""
    length = H.header_text("content-length")
    return df.withColumn(
        "has_body", F.coalesce(~length.isin("", "0"), F.lit(False))
    )


def response_status(df):
    """Append the ``:status`` header as a number, 0 when unusable."""
    raw = F.try_element_at(F.col("raw_headers"), F.lit(":status")).cast("string")
    text = F.coalesce(F.try_element_at(F.col("headers"), F.lit(":status")), raw)
    return df.withColumn("status", targets.status_number(text))


def body_type(df):
    """Append content type, encoding, and the chunked and compressed flags."""
    read = lambda name: F.coalesce(H.header_text(name), F.lit(""))
    content, transfer = read("content-encoding"), read("transfer-encoding")
    chunked = transfer == "chunked"
    encoding = (
        F.when(content != "", content)
        .when((transfer != "") & ~chunked, transfer)
        .otherwise(F.lit("none"))
    )
    return df.withColumns(
        {
            "content_type": read("content-type"),
            "encoding": encoding,
            "chunked": chunked,
            "compressed": (content != "") | ((transfer != "") & ~chunked),
        }
    )


def tag_phase(df, kind="kind"):
    """Phase number of a message kind, and the phase header where the proxy sets it."""
    phase = F.lit(None)
    for name, number in PHASES.items():
        phase = F.when(F.col(kind) == name, F.lit(number)).otherwise(phase)
    phase = F.coalesce(
        phase,
        F.raise_error(F.concat(F.lit("unknown request phase: "), F.coalesce(F.col(kind), F.lit("null")))).cast("int"),
    )
    tagged = df.withColumn("phase", phase.cast("int"))
    marked = H.merge_maps(
        H.text_map(F.col("headers")),
        F.create_map(F.lit(PHASE_HEADER), F.col("phase").cast("string")),
    )
    carries = F.col("phase").isin(
        REQUEST_HEADERS, REQUEST_BODY, REQUEST_TRAILERS, RESPONSE_BODY
    )
    return tagged.withColumn("headers", F.when(carries, marked).otherwise(F.col("headers")))


def resolve_status(df, status="status", headers="headers"):
    """Handler status to flow status: the status header overrides and is removed, 200 means 0.

    The header value may be text (digits) or, in a VARIANT map, a number cut toward zero.
    """
    value = F.try_element_at(F.col(headers), F.lit(STATUS_HEADER))
    if df.schema[headers].dataType.valueType.typeName() == "variant":
        override = F.when(is_number(value), as_long(value)).when(
            kind_of(value) == "string", parse_integer(as_text(value))
        )
    else:
        override = parse_integer(value)
    resolved = F.coalesce(override.try_cast("int"), F.col(status))
    return df.withColumns(
        {
            status: F.when(resolved == 200, F.lit(0)).otherwise(resolved).cast("int"),
            headers: H.without(F.col(headers), [STATUS_HEADER]),
        }
    )


def handles_phase(mode, phase=None, body=None):
    """Whether an operator mode calls its handler on a row."""
    phase = F.col("phase") if phase is None else phase
    body = F.col("has_body") if body is None else body
    request = (phase == REQUEST_BODY) | ((phase == REQUEST_HEADERS) & ~body)
    response = phase == RESPONSE_BODY
    rules = {
        "preprocessor": request,
        "postprocessor": response,
        "wrapprocessor": request | response,
        "observeprocessor": request | response,
    }
    if mode not in rules:
        raise ValueError(f"unknown operator type: {mode}")
    return F.coalesce(rules[mode], F.lit(False))


def apply_response(df, mode):
    """What a handler's answer does to the flow.

    Reads phase, has_body, status (flow status), response_body, error and body; appends
    ``decision`` (continue, replace or immediate), ``immediate_status``, ``immediate_body``
    and ``new_body``. The immediate response carries no handler headers.
    """
    called = handles_phase(mode)
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    answered = called & ~failed
    stops = answered & (F.coalesce(F.col("status"), F.lit(0)) > 0)
    body_phase = F.col("phase").isin(REQUEST_BODY, RESPONSE_BODY)
    replaces = answered & body_phase & (F.coalesce(F.octet_length("response_body"), F.lit(0)) > 0)
    if mode == "wrapprocessor":
        stops = stops & (F.col("phase") != RESPONSE_BODY)
    if mode == "observeprocessor":
        stops = replaces = F.lit(False)
    decision = F.when(stops, "immediate").when(replaces, "replace").otherwise("continue")
    return df.withColumn("decision", decision).withColumns(
        {
            "immediate_status": F.when(F.col("decision") == "immediate", F.col("status")),
            "immediate_body": F.when(F.col("decision") == "immediate", F.col("response_body")),
            "new_body": F.when(F.col("decision") == "replace", F.col("response_body")).otherwise(
                F.col("body")
            ),
        }
    )


def header_mutations(ops):
    """Header operations to mutation records, one row per kept record.

    ``ops`` has (stream_id, phase, op_seq, op, name, value, raw_value) with op one of the
    three actions or ``remove``. The records of a phase in ``position`` order are its set
    list and its remove list; the remove list keeps the first mention of a name. A record
    stays a row of its own, so a phase with very many operations is no wide value.
    """
    both = (F.coalesce(F.length("value"), F.lit(0)) > 0) & F.col("raw_value").isNotNull()
    sets = ops.filter(F.col("op") != "remove").select(
        "stream_id",
        "phase",
        F.col("op_seq").alias("position"),
        F.lit("set").alias("kind"),
        "name",
        "value",
        "raw_value",
        F.when(
            F.col("op").isin(*ACTIONS), F.col("op")
        )
        .otherwise(F.lit(APPEND))
        .alias("action"),
        F.when(both, F.lit("only one of 'value' or 'raw_value' can be set")).alias("error"),
    )
    removes = (
        ops.filter(F.col("op") == "remove")
        .groupBy("stream_id", "phase", "name")
        .agg(F.min("op_seq").alias("position"))
        .select("stream_id", "phase", "position", F.lit("remove").alias("kind"), "name")
    )
    return sets.unionByName(removes, allowMissingColumns=True)


def replace_body(df, replacement="replacement", body="body", clear=None):
    """Body replaced unless the replacement is empty, with the length header that goes with it.

    ``clear`` names a column of flags: where it is true the body is emptied instead, and its
    length header stays as it is.
    """
    size = F.octet_length(F.col(replacement))
    cleared = F.lit(False) if clear is None else F.coalesce(F.col(clear), F.lit(False))
    changed = (F.coalesce(size, F.lit(0)) > 0) & ~cleared
    return df.withColumns(
        {
            body: F.when(cleared, F.lit(b"")).when(changed, F.col(replacement)).otherwise(F.col(body)),
            "content_length": F.when(changed, size),
            "length_action": F.when(changed, F.lit(OVERWRITE)),
        }
    )


def classify_route(df, model_name, model_version=""):
    """Append endpoint and status of a model-serving path."""
    endpoint, status = targets.route_of(
        F.col("method"), F.col("path"), model_name, model_version
    )
    return df.withColumns({"endpoint": endpoint, "route_status": status})


def annotate_headers(phases, name=None, durations=None):
    """Mutation records an operator adds by itself; both kinds are off unless asked for.

    ``name`` appends the operator name on phase 4. ``durations`` (stream_id, duration_ns)
    appends the total processing time on the phase that ends the response.
    """
    columns = ["stream_id", "phase", "seq"]
    made = []
    if name is not None:
        made.append(
            phases.filter(F.col("phase") == RESPONSE_HEADERS).select(
                *columns,
                F.lit(NAMES_HEADER).alias("name"),
                F.lit(name.encode()).alias("raw_value"),
                F.lit(APPEND).alias("action"),
            )
        )
    if durations is not None:
        ends = phases.filter(
            F.col("phase").isin(RESPONSE_HEADERS, RESPONSE_BODY) & F.col("end_of_stream")
        ).select(*columns)
        made.append(
            ends.join(durations.select("stream_id", "duration_ns"), "stream_id").select(
                *columns,
                F.lit(DURATION_HEADER).alias("name"),
                F.col("duration_ns").cast("string").cast("binary").alias("raw_value"),
                F.lit(APPEND).alias("action"),
            )
        )
    if not made:
        return phases.select(*columns).filter(F.lit(False)).select(
            *columns,
            F.lit("").alias("name"),
            F.lit(b"").alias("raw_value"),
            F.lit(APPEND).alias("action"),
        )
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def current_headers(phases):
    """Header set in force at each phase: the request's until the response's replace them.

    Pseudo headers (names that begin with a colon) are not part of it.
    """
    own = F.when(
        F.col("phase").isin(REQUEST_HEADERS, RESPONSE_HEADERS),
        F.struct(
            H.without(F.col("headers"), prefix=":").alias("headers"),
            H.without(F.col("raw_headers"), prefix=":").alias("raw_headers"),
        ),
    )
    found = running(phases, ["stream_id"], "seq", {"__force": running_last(own)})
    return found.withColumns(
        {"headers": F.col("__force.headers"), "raw_headers": F.col("__force.raw_headers")}
    ).drop("__force")
