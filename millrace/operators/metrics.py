"""Request metrics from exchange and invocation logs."""

from pyspark.sql import functions as F

from ..envelope import RESPONSE_BODY, RESPONSE_HEADERS, RESPONSE_TRAILERS
from ..functions.headers import lower_keys, merge_maps, text_map
from ..functions.targets import url_parts
from ..functions.text import parse_integer
from ..functions.timing import tick_of
from .scans import running, running_sum

# Upper bounds of the duration buckets in seconds, inclusive (fixed values).
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10)

DURATION_DIMS = ("method", "scheme", "route", "server_address", "server_port", "status")
ACTIVE_DIMS = ("method", "scheme", "server_address", "server_port")

# Attribute names (fixed values).
_ATTRIBUTE = {
    "method": "http.request.method",
    "scheme": "url.scheme",
    "route": "http.route",
    "server_address": "server.address",
    "server_port": "server.port",
    "status": "http.response.status_code",
}


def exchange_duration(phases):
    """Processing time of every exchange whose response has ended, in ns."""
    ends = F.col("phase").isin(RESPONSE_HEADERS, RESPONSE_BODY) & F.col("end_of_stream")
    counted = F.when(F.col("phase") != RESPONSE_TRAILERS, F.col("duration_ns"))
    return (
        phases.groupBy("stream_id")
        .agg(F.sum(counted).alias("duration_ns"), F.max(F.coalesce(ends, F.lit(False))).alias("ended"))
        .filter("ended")
        .drop("ended")
    )


def _buckets(value, bounds):
    """One count per bucket; the last bucket is everything above the last bound."""
    edges = [None, *bounds, None]
    counts = []
    for low, high in zip(edges, edges[1:]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value > F.lit(float(low)))
        if high is not None:
            inside = inside & (value <= F.lit(float(high)))
        counts.append(F.count_if(inside))
    return F.array(*counts)


def _histogram(grouped, value, bounds):
    # the sum is exact decimal arithmetic, so it does not depend on how rows are spread
    return grouped.agg(
        _buckets(value, bounds).alias("buckets"),
        F.count(value).alias("count"),
        F.sum(value.cast("decimal(28,9)")).cast("double").alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def duration_histogram(df, dims=DURATION_DIMS, bounds=DURATION_BOUNDS):
    """Request durations in seconds, by the request dimensions."""
    return _histogram(
        df.filter(F.col("duration").isNotNull()).groupBy(*dims), F.col("duration"), bounds
    )


def size_histograms(df, bounds, dims=DURATION_DIMS):
    """Request and response body sizes in bytes, by the request dimensions."""
    sizes = df.select(
        *dims,
        F.inline(
            F.array(
                F.struct(F.lit("request").alias("body"), F.col("request_size").cast("double").alias("size")),
                F.struct(F.lit("response").alias("body"), F.col("response_size").cast("double").alias("size")),
            )
        ),
    ).filter(F.col("size").isNotNull())
    return _histogram(sizes.groupBy(*dims, "body"), F.col("size"), bounds)


def dimensions(df, attributes="attributes"):
    """Metric dimensions out of an attribute map."""
    return df.withColumns(
        {
            name: F.try_element_at(F.col(attributes), F.lit(key)).cast(
                "int" if name in ("server_port", "status") else "string"
            )
            for name, key in _ATTRIBUTE.items()
        }
    )


def request_changes(df, dims=ACTIVE_DIMS):
    """(dimensions, ts, delta): a row for every start, 1, and every end, -1."""
    return df.select(
        *dims,
        F.inline(
            F.array(
                F.struct(F.col("start").alias("ts"), F.lit(1).alias("delta")),
                F.struct(F.col("end").alias("ts"), F.lit(-1).alias("delta")),
            )
        ),
    ).filter(F.col("ts").isNotNull())


def active_requests(df, dims=ACTIVE_DIMS, slice_width="1 minute"):
    """Requests in flight after every instant something started or ended, by dimensions.

    Starts and ends are netted per instant before anything is ordered, so a slice of time
    holds at most one row per microsecond however busy a dimension is.
    """
    net = (
        request_changes(df, dims)
        .groupBy(*dims, "ts")
        .agg(F.sum("delta").cast("long").alias("delta"))
        .withColumn("__at", F.unix_micros("ts"))
    )
    return running(
        net,
        list(dims),
        "__at",
        {"active": running_sum(F.col("delta"))},
        slices={"__slice": tick_of(F.col("ts"), slice_width)},
    ).drop("__at", "delta")


def job_status(runs):
    """One row per run: failed when any of its events was not answered with 200."""
    failed = (
        F.col("submit_error").isNotNull()
        | F.col("process_error").isNotNull()
        | (F.coalesce(F.col("status"), F.lit(200)) != 200)
    )
    return runs.groupBy("run_id").agg(
        F.count("*").alias("events"), F.max(failed).alias("failed")
    )


def invocation_stats(df):
    """Invocations per trigger by outcome."""
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    submit = ~timed_out & F.col("submit_error").isNotNull()
    process = ~timed_out & F.col("submit_error").isNull() & F.col("process_error").isNotNull()
    return df.groupBy("trigger").agg(
        F.count("*").alias("total"),
        F.count_if(~timed_out & F.col("submit_error").isNull() & F.col("process_error").isNull()).alias("ok"),
        F.count_if(submit).alias("submit_errors"),
        F.count_if(process).alias("process_errors"),
        F.count_if(timed_out).alias("timed_out"),
    )


def stored_values(ops):
    """The value each name ends up with in an exchange."""
    return ops.groupBy("stream_id", "name").agg(F.max_by("value", "seq").alias("value"))


def _present(pairs):
    """Map of the entries that have a value."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _filled(text):
    """Text, null when empty."""
    return F.when(text != "", text)


def request_attributes(df, content=False, out="attributes"):
    """Append the flat request attributes of an event."""
    has = set(df.columns).__contains__
    headers = text_map(F.col("headers"))
    get = lambda name: _filled(F.try_element_at(headers, F.lit(name)))
    url = _filled(F.col("url"))
    part = url_parts(url)
    path = F.coalesce(F.col("path"), F.lit(""))
    client = F.trim(
        F.split_part(F.coalesce(get("X-Forwarded-For"), get("X-Real-IP")), F.lit(","), F.lit(1))
    )
    size = F.octet_length("body")
    pairs = {
        "http.request.method": F.col("method"),
        "url.path": F.when(url.isNotNull(), part["path"]).otherwise(path),
        "url.scheme": F.when(url.isNotNull(), part["scheme"]).otherwise(F.lit("http")),
        "url.full": F.coalesce(url, F.lit("")),
        "server.address": _filled(part["host"]),
        "server.port": F.when(part["port"] > 0, part["port"]),
        "url.query": _filled(part["query"]),
        "http.route": path,
        "http.request.size": F.col("size") if has("size") else F.lit(None),
        "http.request.body.size": F.when(size > 0, size),
        "http.request.body.value": F.when(size > 0, F.col("body").cast("string"))
        if content
        else F.lit(None),
        "user_agent.original": F.coalesce(get("User-Agent"), get("user-agent")),
        "client.address": client,
        "network.peer.address": client,
        "network.protocol.version": get("X-Forwarded-Proto"),
        "network.peer.port": parse_integer(F.trim(get("X-Forwarded-Port"))),
    }
    named = lower_keys(headers, "http.request.header.")
    return df.withColumn(out, merge_maps(named, _present(pairs)))


def response_attributes(
    df, content=False, status="status", headers="response_headers", body="response_body", out="response_attributes"
):
    """Append the flat response attributes; a null status is a bare value, reported as 200."""
    bare = F.col(status).isNull()
    size = F.octet_length(F.col(body))
    shown = bare | (size > 0)
    pairs = {
        "http.response.status_code": F.coalesce(F.col(status), F.lit(200)),
        "http.response.size": F.col("response_size") if "response_size" in df.columns else F.lit(None),
        "http.response.body.size": F.when(shown, size),
        "http.response.body.value": F.when(shown, F.col(body).cast("string"))
        if content
        else F.lit(None),
    }
    named = F.when(
        ~bare, lower_keys(text_map(F.col(headers)), "http.response.header.")
    ).otherwise(text_map(F.lit(None).cast("map<string,string>")))
    return df.withColumn(out, merge_maps(named, _present(pairs)))
