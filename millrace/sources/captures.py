"""Captured exchanges, messages, packets and job events.

Captures rarely come in the library's own layout: ``columns`` maps target columns to SQL
expressions over the file's columns, so column pruning and filters still reach the scan.
"""

from pyspark.sql import functions as F, types as T

from ..envelope import EXCHANGE, JOB_EVENT, MESSAGE, PACKET
from ..functions.timing import as_instant


def read_files(spark, path, streaming=False, schema=None, **options):
    """Parquet or JSON files (by suffix, parquet otherwise), batch or stream."""
    kind = "json" if str(path).rstrip("/*").endswith((".json", ".jsonl")) else "parquet"
    if streaming and schema is None:
        schema = spark.read.format(kind).load(path).schema
    reader = (spark.readStream if streaming else spark.read).format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def conform(df, schema, columns=None):
    """Select ``schema`` from ``df``; absent columns become null, local times become UTC."""
    columns = columns or {}
    picked = []
    for field in schema:
        if field.name in columns:
            source = F.expr(columns[field.name])
        elif field.name in df.columns:
            source = F.col(field.name)
        else:
            source = F.lit(None)
        picked.append(source.alias(field.name))
    shaped = df.select(*picked)
    result = []
    for field in schema:
        source = F.col(field.name)
        if isinstance(shaped.schema[field.name].dataType, T.TimestampNTZType):
            source = as_instant(source)
        result.append(source.cast(field.dataType).alias(field.name))
    return shaped.select(*result)


def load_exchanges(spark, path, streaming=False, columns=None, **options):
    """HTTP exchange messages: one row per phase message, one stream per exchange."""
    return conform(read_files(spark, path, streaming, **options), EXCHANGE, columns)


def load_messages(spark, path, streaming=False, columns=None, **options):
    """Websocket messages. All connections of a stream feed one state, keyed by stream_id."""
    return conform(read_files(spark, path, streaming, **options), MESSAGE, columns)


def load_kafka_messages(spark, servers, topic, streaming=True, **options):
    """Messages from a topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(
        F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("stream_id"),
        F.col("partition").cast("string").alias("conn_id"),
        F.col("offset").alias("seq"),
        F.col("timestamp").alias("ts"),
        F.col("value").alias("data"),
    )


def load_packets(spark, path, columns=None):
    """Media packets that are already depacketised."""
    return conform(read_files(spark, path), PACKET, columns)


def job_events(spark, rows, columns=None):
    """A one-shot batch of predefined events: a table, or a short list of rows."""
    df = rows if hasattr(rows, "select") else spark.createDataFrame(rows, JOB_EVENT)
    return conform(df, JOB_EVENT, columns)
