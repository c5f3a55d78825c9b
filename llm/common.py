"""Scratch tables in the shared folder, and whole groups out of sorted Arrow batches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, or the checkpoint folder of the context.

    Only a local session that names none gets a temporary folder of its own; on a cluster
    the executors could not read it, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def once_per_process(key, make):
    """What ``make`` gives, kept for the life of a Python worker.

    Code travels to the executors by value, so a cache in one of these modules would be
    empty again in every task; this one is kept beside the interpreter's modules.
    """
    store = sys.modules.setdefault("_llm_kept", types.ModuleType("_llm_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive lost executors.

    ``keep`` writes and reads back; ``drop`` deletes what no later plan reads. What a
    returned DataFrame still reads stays until the folder is cleaned up by its owner.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read back, with a folder for each value of ``by`` if one is named."""
        path = f"{self.root}/{self.made:03d}-{name}"
        self.made += 1
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if df is not None:
                path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
                fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
                fs.delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join of two large tables in which neither side may be broadcast.

    Spark sizes a table that comes straight from files or from Python by its compressed files and
    by the width of its rows, however many rows are made of one; a broadcast of what it takes for
    small then goes through the driver. Behind a shuffle sizes are measured.
    """
    return df.hint("merge")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, exactly; null where there are fewer.

    Histograms of ever narrower ranges, so the driver sees at most ``bins`` rows a pass.
    """
    known = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    low, high, n = known.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / bins
        bin_of = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        rows = (
            known.filter(F.col("x").between(low, high))
            .groupBy(bin_of.alias("bin"))
            .agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for row in rows:
            if k <= row.n:
                low, high = row.low, row.high
                break
            k -= row.n
    return low


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (texts, lists, or a struct with ``text``) has about ``most`` bytes in each.

    A batch may hold ten thousand long texts; what a worker makes of them should not all be
    there at once. A single longer value is a slice of its own.
    """
    for batch in batches:
        values = batch.column(column)
        if pa.types.is_struct(values.type):
            values = values.field("text")
        if pa.types.is_list(values.type):
            size = pc.multiply(pc.list_value_length(values), 4)
        else:
            size = pc.binary_length(values)
        done = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            before = done[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(done, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Re-cut batches sorted by ``keys`` so that no group is split between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = _starts(batch, keys)
        if held and all(
            held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys
        ):
            if len(new) == 1:  # the open group goes on past this batch
                held.append(batch)
                continue
            yield pa.concat_batches([*held, batch.slice(0, new[1])])
            if len(new) > 2:
                yield batch.slice(new[1], new[-1] - new[1])
        else:
            if held:
                yield pa.concat_batches(held)
            if len(new) > 1:
                yield batch.slice(0, new[-1])
        held = [batch.slice(new[-1])]
    if held:
        yield pa.concat_batches(held)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins (the first row always does)."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def group_ids(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """0, 1, ... for the groups of a sorted batch, one number a row."""
    ids = np.zeros(batch.num_rows, np.int64)
    ids[_starts(batch, keys)] = 1
    return np.cumsum(ids) - 1
