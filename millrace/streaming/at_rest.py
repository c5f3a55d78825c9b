"""A table at rest read as a stream, with a result that does not depend on its files.

A file stream takes files in the order of their modification times, and a watermark drops
what comes too late. A table written by Spark has its rows in any order, so it is first put
in event-time order: range-partitioned by ``ts`` into files whose times rise with the range.
A last row far behind all others moves the watermark past everything, which closes what the
stream still holds open. Rows dropped all the same are counted, and any is an error.
"""

import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions.timing import micros
from ..session import DEFAULTS, remove_path, scratch_path

#: Files that a core reads in one micro-batch.
FILES_A_CORE = 8

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: What operators with states of their own by key (``transformWithState``) need of the session they start in.
#: Spark's default store keeps one state an operator and fails at their start.
KEYED_STATE = {_STORE: DEFAULTS[_STORE]}
#: For operators whose state holds the bytes of messages too. What a run has done with leaves memory and disk, as nothing
#: goes back to it: shuffles, versions of the state, and stores between micro-batches. Rows go to Python some megabytes at a time.
HEAVY_STATE = KEYED_STATE | {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.execution.arrow.maxRecordsPerBatch": DEFAULTS["spark.sql.execution.arrow.maxRecordsPerBatch"],
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
#: Bytes of files that a core reads in one micro-batch for such operators.
BYTES_A_CORE = 32 << 20


def _data_files(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)]
    return fs, {p.getName(): p for p in found if p.getName().startswith("part-")}


def stage(df, label, wait, order="seq", files=None):
    """Write ``df`` in event-time order to the shared folder; (path, schema).

    ``wait`` is how far behind the last event the watermark must come to close everything:
    the operator's interval, gap or timeout and its delay. The closing row has the event time
    only, all its other columns are null; no operator gives it out, as nothing follows it.
    Rows without an event time have no place in a stream and are left out. How many files there
    are follows from the size of the table, unless ``files`` says it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{label}-staged")
    timed = df.filter(F.col("ts").isNotNull())
    # without a number adaptive execution joins small ranges: a small table is one micro-batch
    ranged = timed.repartitionByRange(files, "ts") if files else timed.repartitionByRange("ts")
    ranged.sortWithinPartitions("ts", order).write.parquet(path)
    fs, first = _data_files(spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    closing = staged.agg(F.max("ts").alias("ts")).filter("ts is not null").select(
        *[
            (F.timestamp_micros(F.unix_micros("ts") + wait + 1000) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in df.schema
        ]
    )
    closing.coalesce(1).write.mode("append").parquet(path)
    _, every = _data_files(spark, path)
    names = sorted(first) + sorted(set(every) - set(first))
    begin = int(time.time() * 1000) - 1000 * len(names)
    for k, name in enumerate(names):
        fs.setTimes(every[name], begin + 1000 * k, -1)
    return path, df.schema


def read_staged(spark, path, schema, bytes_a_core=None):
    """The staged files as a stream; a micro-batch gives every core of the cluster its share of files.

    With ``bytes_a_core`` that share is counted in bytes, a file at least in all, and files that have been read are deleted.
    """
    reader, cores = spark.readStream.schema(schema), spark.sparkContext.defaultParallelism
    if bytes_a_core:
        reader = reader.option("maxBytesPerTrigger", bytes_a_core * cores).option("cleanSource", "delete")
    else:
        reader = reader.option("maxFilesPerTrigger", FILES_A_CORE * cores)
    return reader.parquet(path)


def dropped_rows(progress):
    """Rows the watermark dropped, over all progress reports of a query."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])


@contextmanager
def _settings(spark, wanted):
    """Session settings for as long as the block runs; afterwards they are as before, unset ones unset."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_table(stream, label, mode="append", settings=None):
    """Run a stream over everything there is and read what it wrote.

    ``settings`` hold for this run only: :data:`KEYED_STATE` for operators that need it.
    Raises if the watermark dropped rows. The stream's state is removed when it has ended; its
    output stays in the shared folder for whoever reads the returned table.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    with _settings(spark, {"spark.sql.streaming.numRecentProgressUpdates": str(1 << 30)} | (settings or {})):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    lost = dropped_rows(query.recentProgress)
    if lost:
        raise RuntimeError(f"{label}: {lost} rows came behind the watermark and were dropped")
    remove_path(spark, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def run_table_as_stream(df, operator, label, wait, order="seq", files=None, settings=None, bytes_a_core=None):
    """``operator(stream)`` over all rows of a table, complete.

    ``wait`` lists the intervals that must pass after the last event, as texts; ``settings`` as
    :func:`run_to_table`, ``bytes_a_core`` as :func:`read_staged`.
    """
    spark = df.sparkSession
    with _settings(spark, settings or {}):
        path, schema = stage(df, label, sum(micros(w) for w in wait), order, files)
    result = run_to_table(operator(read_staged(spark, path, schema, bytes_a_core)), label, settings=settings)
    remove_path(spark, path)
    return result
