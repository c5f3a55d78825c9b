"""User functions over events."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import handlers
from ..session import scratch_path
from .inputs import digest, map_text, table
from .registry import query


def _turns(spark, folder):
    """Conversation turns as events."""
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("/"), "role").alias("path"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("http://chat.example:8080/"), "role").alias("url"),
        F.create_map(F.lit("User-Agent"), F.lit("probe")).alias("headers"),
        F.col("text").cast("binary").alias("body"),
    )


def greet(context, event):
    """Text, JSON, a response of its own, or an exception, by the role that asks."""
    if event.path == "/system":
        raise ValueError("no system turns")
    if event.path == "/assistant":
        return {"size": len(event.body)}
    return context.Response(body="Hello, " + event.body.decode(), status_code=201, headers={"x-greeter": "yes"})


@query(
    "u1_apply_handler",
    """
    SELECT conv_id, turn, CASE role WHEN 'system' THEN 500 WHEN 'assistant' THEN 200 ELSE 201 END AS status,
           CASE role WHEN 'system' THEN md5('Exception caught in handler - "no system turns"')
                WHEN 'assistant' THEN md5('{"size": ' || octet_length(encode(text)) || '}')
                ELSE md5('Hello, ' || text) END AS body,
           CASE role WHEN 'assistant' THEN 'application/json' ELSE 'text/plain' END AS type,
           CASE role WHEN 'user' THEN 'x-greeter=yes' ELSE '' END AS headers, true AS timed
    FROM conversations
    """,
)
def apply_query(spark, folder):
    answered = handlers.apply_handler(_turns(spark, folder), greet)
    # the rest of an error text is a trace, which names files and lines
    body = F.when(
        F.col("status") == 500, F.split_part(F.col("response_body").cast("string"), F.lit(": "), F.lit(1)).cast("binary")
    ).otherwise(F.col("response_body"))
    return answered.select(
        "conv_id",
        "turn",
        "status",
        digest(body).alias("body"),
        F.col("response_type").alias("type"),
        map_text("response_headers").alias("headers"),
        (F.col("duration") > 0).alias("timed"),
    )


def _sentences(context, event):
    """One response per sentence, as it is found."""
    for part in event.body.decode().split("."):
        if part.strip():
            yield part


@query(
    "u2_flatten_batched",
    r"""
    SELECT conv_id, turn, CAST(p - 1 AS INTEGER) AS response_pos, 200 AS status, md5(parts[p]) AS body
    FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS p FROM
           (SELECT *, list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '\S')) AS parts FROM conversations))
    """,
)
def batched_query(spark, folder):
    return handlers.apply_answers(_turns(spark, folder), _sentences).select(
        "conv_id", "turn", "response_pos", "status", digest("response_body").alias("body")
    )


def shout(event):
    return event.body.decode("ascii", "ignore").upper()


@query(
    "u3_apply_serve",
    r"""
    SELECT conv_id, turn, md5(upper(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) AS body FROM conversations
    """,
)
def serve_query(spark, folder):
    served = handlers.apply_serve(_turns(spark, folder), shout)
    return served.select("conv_id", "turn", digest("response_body").alias("body"))


def orders_by_segment(orders, customers, state):
    """Orders of one state and what they cost, by market segment."""
    placed = orders.filter(F.col("o_orderstatus") == state)
    return (
        placed.join(customers, placed["o_custkey"] == customers["c_custkey"])
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(
            F.count("*").alias("orders"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
    )


def _broken(orders):
    """Plans well and fails when it is computed."""
    return orders.select(F.raise_error(F.lit("no such order")).cast("string").alias("segment"))


@query(
    "u5_run_job",
    """
    SELECT 'by-segment' AS run_id, 'COMPLETED' AS state, 'output' AS outputs, c_mktsegment AS segment, count(*) AS orders,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment
    UNION ALL SELECT 'broken', 'ERROR', NULL, NULL, NULL, NULL
    """,
)
def job_query(spark, folder):
    """A run with its status beside every row it wrote, and one that fails while it is computed.

    Both are in the status table. The one that failed is run again under its id and
    succeeds, which changes nothing of what is stored.
    """
    path = scratch_path(spark, "job")

    def save(name, df):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    tables = {"orders": table(spark, folder, "orders"), "customers": table(spark, folder, "customer")}
    known = {"status_path": f"{path}/runs"}
    outputs, _ = handlers.run_job(
        orders_by_segment, tables, save, {"state": "F", "unused": 1}, run_id="by-segment", **known
    )
    try:
        handlers.run_job(_broken, tables, lambda name, df: save("broken", df), run_id="broken", **known)
        raise AssertionError("the broken run must fail")
    except PySparkException:
        pass
    handlers.run_job(lambda customers: {"regions": customers.limit(0)}, tables, save, run_id="broken", **known)
    runs = handlers.stored_statuses(spark, f"{path}/runs").select(
        "run_id", "state", F.array_join("outputs", ",").alias("outputs")
    )
    written = outputs["output"].withColumn("run_id", F.lit("by-segment"))
    return runs.join(written, "run_id", "left").select("run_id", "state", "outputs", "segment", "orders", "cents")


@query(
    "u6_observe",
    """
    SELECT conv_id, turn,
           'http.request.body.size=' || octet_length(encode(text)) || '&http.request.header.user-agent=probe'
           || '&http.request.method=POST'
           || CASE role WHEN 'user' THEN '&http.response.body.size=' || (octet_length(encode(text)) + 7)
                                         || '&http.response.header.x-greeter=yes'
                        WHEN 'assistant' THEN '&http.response.body.size=' || length('{"size": ' || octet_length(encode(text)) || '}')
                        ELSE '' END
           || '&http.response.status_code=' || CASE role WHEN 'system' THEN 500 WHEN 'assistant' THEN 200 ELSE 201 END
           || '&http.route=/' || role || '&server.address=chat.example&server.port=8080&url.full=http://chat.example:8080/' || role
           || '&url.path=/' || role || '&url.scheme=http&user_agent.original=probe' AS attributes
    FROM conversations
    """,
)
def observe_query(spark, folder):
    seen = handlers.observe(_turns(spark, folder), greet)
    # an error text holds a trace: its size is not the same everywhere
    told = F.when(
        F.col("status") == 500, F.map_filter("attributes", lambda k, _: k != "http.response.body.size")
    ).otherwise(F.col("attributes"))
    return seen.select("conv_id", "turn", map_text(told).alias("attributes"))
