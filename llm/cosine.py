"""Embedding near-duplicates: sign hashes in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .linking import cell_blocks, components, scan_units


def table_plan(rows: int, cosine: float, miss: float = 1e-5) -> tuple[int, int]:
    """(bits a table, tables): buckets of unrelated vectors stay small, a pair at the bound is missed
    with probability ``miss`` at most.

    A hyperplane separates vectors at angle t with probability t / pi.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(rows, 2)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector can link: label known; no null, non-finite or all-zero vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    return embeddings.filter(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    ).filter(~bad & ~zero)


def _signatures(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Add ``signs``: one packed sign pattern for each table. Hyperplanes follow from seed and dimension."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            signs = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                rows = np.flatnonzero(sizes == d)
                x = _matrix(lists.take(pa.array(rows)))
                on = (x @ planes[d] >= 0).reshape(len(rows), tables, bits)
                signs[rows] = on @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            out = pa.ListArray.from_arrays(
                pa.array(np.arange(0, signs.size + 1, tables), pa.int32()), pa.array(signs.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "weight", "embedding")), out],
                ["node", "label", "weight", "embedding", "signs"],
            )

    kinds = dict(nodes.dtypes)
    return nodes.mapInArrow(
        run, f"node long, label {kinds['label']}, weight long, embedding {kinds['embedding']}, signs array<long>"
    )


def _close(cosine: float):
    def check(batch, left, right):
        # the first pairs of a batch prepare what all its pairs read
        if batch is not state.get("batch"):
            lists = batch.column("embedding")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            width = int(sizes.max())
            x = np.zeros((batch.num_rows, width))
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x[rows[:, None], np.arange(d)] = _matrix(lists.take(pa.array(rows)))
            signs = batch.column("signs").flatten().to_numpy().reshape(batch.num_rows, -1)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            state.update(
                batch=batch, x=x, norm=np.sqrt((x * x).sum(1)), sizes=sizes, signs=signs, label=label,
                table=batch.column("table").to_numpy(), node=batch.column("node").to_numpy(),
            )
        x, norm, sizes, signs, label = (state[k] for k in ("x", "norm", "sizes", "signs", "label"))
        dot = np.einsum("ij,ij->i", x[left], x[right])
        table, node = state["table"], state["node"]
        linked = dot / (norm[left] * norm[right]) >= cosine
        for v in (label, sizes, table):
            linked &= v[left] == v[right]
        linked &= node[left] != node[right]
        # a pair that meets in several tables is counted in the first of them
        near = np.flatnonzero(linked)
        a, b, table = left[near], right[near], table[left[near]]
        same = signs[a] == signs[b]
        earlier = same & (np.arange(signs.shape[1]) < table[:, None])
        in_table = same[np.arange(len(a)), table]
        linked[near[~in_table]] = False  # strangers that share a cell by chance; they meet in their own
        return linked, (~earlier.any(1))[in_table]

    state: dict = {}
    return check


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, seed: int = 20, miss: float = 1e-5) -> DataFrame:
    """Near-duplicate vectors: ``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors of equal, known label whose cosine in double precision is at least ``cosine`` are
    linked, when they share a bucket in one of the sign-hash tables; the plan of tables follows
    from the row count and leaves a pair at the bound unfound with probability ``miss``.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest
    vec_id reachable, ``kept`` says whether that is the row's own.

    Equal vectors of one label are one node with a weight. A row without vec_id or label, or
    with a null, empty, zero or non-finite vector links with nothing (its component is its own
    id; without an id, null and not kept). Vectors of different lengths never link. Repeated
    rows (one id, one vector) count as one vector and come out repeated; rows that give one id
    several vectors count as several. Extra columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "cosine")
    rows = embeddings.select("vec_id", "label", "embedding")
    nodes = (
        valid_vectors(rows)
        .groupBy("label", "embedding", "vec_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("one").alias("weight"))
        # one id may name several vectors, so a node has a number of its own
        .withColumn("node", F.monotonically_increasing_id())
        .select("node", "least", "label", "weight", "embedding")
    )
    nodes = scratch.keep(nodes, "nodes")
    total = nodes.count()
    bits, tables = table_plan(total, cosine, miss)
    signed = scratch.keep(_signatures(nodes.drop("least"), bits, tables, seed), "signed")
    members = signed.select("node", "label", F.posexplode("signs").alias("table", "sign")).select(
        F.xxhash64("label", "table", "sign").alias("cell"), "table", "node"
    )
    units = cell_blocks(members.select("cell", F.struct("node", "table").alias("node")))
    carried = units.select("cell", "i", "j", "side", "node.node", "node.table").join(
        signed.select("node", "label", "weight", "embedding", "signs"), "node"
    )
    found = scratch.keep(scan_units(carried, _close(cosine)), "links")
    label = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("c"))
    named = (
        grouped.join(smallest, "component")
        .join(counts, "node", "left")
        .select(
            F.col("label").alias("l"),
            F.col("embedding").alias("e"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
            "c",
        )
    )
    mine = rows.join(named, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    own = F.coalesce("c", "vec_id")
    return mine.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
