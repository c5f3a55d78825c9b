"""Request metrics over invocation logs."""

from pyspark.sql import functions as F

from ..operators import metrics
from ..streaming import counters
from ..streaming.at_rest import KEYED_STATE, run_table_as_stream
from .inputs import INVOCATIONS, invocations
from .registry import query

_SIZES = (10.0, 20.0, 30.0)


def _bucket_sql(value, bounds):
    """Count per bucket as text: upper bounds inclusive, the last bucket open."""
    edges = [None, *bounds, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        inside = " AND ".join(
            ([f"{value} > {low}"] if low is not None else [])
            + ([f"{value} <= {high}"] if high is not None else [])
        )
        parts.append(f"count(*) FILTER ({inside})")
    return " || ',' || ".join(parts)


_DIMS = "method, scheme, route, server_address, server_port, status"


@query(
    "a3_duration_histogram",
    f"""
    WITH {INVOCATIONS}
    SELECT {_DIMS}, {_bucket_sql("duration", metrics.DURATION_BOUNDS)} AS buckets, count(*) AS count,
           CAST(sum(CAST(duration AS DECIMAL(28, 9))) AS DOUBLE) AS sum, min(duration) AS min, max(duration) AS max
    FROM invocations GROUP BY {_DIMS}
    """,
)
def duration_query(spark, folder):
    told = metrics.duration_histogram(invocations(spark, folder))
    return told.withColumn("buckets", F.array_join(F.col("buckets").cast("array<string>"), ","))


@query(
    "a4_size_histograms",
    f"""
    WITH {INVOCATIONS},
    s AS (SELECT *, 'request' AS body, CAST(request_size AS DOUBLE) AS size FROM invocations
          UNION ALL SELECT *, 'response', CAST(response_size AS DOUBLE) FROM invocations)
    SELECT {_DIMS}, body, {_bucket_sql("size", _SIZES)} AS buckets, count(*) AS count,
           sum(size) AS sum, min(size) AS min, max(size) AS max
    FROM s WHERE size IS NOT NULL GROUP BY {_DIMS}, body
    """,
)
def sizes_query(spark, folder):
    told = metrics.size_histograms(invocations(spark, folder), _SIZES)
    return told.withColumn("buckets", F.array_join(F.col("buckets").cast("array<string>"), ","))


@query(
    "a5_job_status",
    f"""
    WITH {INVOCATIONS}
    SELECT run_id, count(*) AS events, bool_or(submit_error IS NOT NULL OR process_error IS NOT NULL OR status <> 200) AS failed
    FROM invocations GROUP BY run_id
    """,
)
def job_status_query(spark, folder):
    return metrics.job_status(invocations(spark, folder))


@query(
    "a6_invocation_stats",
    f"""
    WITH {INVOCATIONS}
    SELECT trigger, count(*) AS total,
           count(*) FILTER (NOT timed_out AND submit_error IS NULL AND process_error IS NULL) AS ok,
           count(*) FILTER (NOT timed_out AND submit_error IS NOT NULL) AS submit_errors,
           count(*) FILTER (NOT timed_out AND submit_error IS NULL AND process_error IS NOT NULL) AS process_errors,
           count(*) FILTER (timed_out) AS timed_out
    FROM invocations GROUP BY trigger
    """,
)
def stats_query(spark, folder):
    return metrics.invocation_stats(invocations(spark, folder))


_ACTIVE = f"""
    WITH {INVOCATIONS},
    d AS (SELECT method, scheme, server_address, server_port, start_us AS ts_us, 1 AS delta FROM invocations
          UNION ALL SELECT method, scheme, server_address, server_port, end_us, -1 FROM invocations),
    n AS (SELECT method, scheme, server_address, server_port, ts_us, sum(delta) AS delta FROM d GROUP BY ALL)
    SELECT method, scheme, server_address, server_port, ts_us,
           CAST(sum(delta) OVER (PARTITION BY method, scheme, server_address, server_port ORDER BY ts_us) AS BIGINT) AS active
    FROM n
    """


@query("n5_active_requests", _ACTIVE)
def active_query(spark, folder):
    told = metrics.active_requests(invocations(spark, folder))
    return told.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


_ACTIVE_AT_TICKS = f"""
    SELECT method, scheme, server_address, server_port, (ts_us // 60000000 + 1) * 60000000 AS tick_us,
           arg_max(active, ts_us) AS active
    FROM ({_ACTIVE}) WHERE ts_us IS NOT NULL GROUP BY ALL
    """


@query("n5_active_at_ticks", _ACTIVE_AT_TICKS)
def active_ticks_query(spark, folder):
    told = counters.active_at_ticks(metrics.active_requests(invocations(spark, folder)))
    return told.withColumn("tick_us", F.unix_micros("tick")).drop("tick")


@query("n5_active_at_ticks_stream", _ACTIVE_AT_TICKS)
def active_stream_query(spark, folder):
    """The same levels, given out by a running stream as its ticks close."""
    told = run_table_as_stream(
        metrics.request_changes(invocations(spark, folder)),
        lambda stream: counters.live_active_requests(stream, delay="1 second"),
        "active",
        ("1 minute", "1 second"),
        order="delta",
        settings=KEYED_STATE,
    )
    return told.withColumn("tick_us", F.unix_micros("tick")).drop("tick")
