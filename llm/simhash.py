"""SimHash near-duplicates found by a grid over per-segment bit counts.

A fingerprint's 32 two-bit segments are mapped to their bit counts (0, 1 or 2). The Manhattan
distance of two such vectors is a lower bound of the Hamming distance of the fingerprints, as
flipping one bit moves one count by one. Written in unary code (00, 01, 11) the counts fit 64
bits again and the Manhattan distance is the number of differing bits.

The grid: the segments are cut into ``g`` axes. Vectors within distance ``r`` agree on all
but at most ``r`` axes, so they share the cell of some choice of ``g - r`` axes. Each distinct
fingerprint is put into one cell for each choice; pairs in a cell are held to the Manhattan
bound and then verified exactly. Nothing is missed, whatever ``g`` is; a larger ``g`` costs
more cells a row and leaves fewer strangers in each.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shuffled
from .linking import cell_blocks, components, scan_units

_LOW = np.uint64(0x5555555555555555)
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash over word shingles; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hashed(line, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(tokens) - words + 1
    h = np.array(
        [hashed(line[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[words - 1 :].tolist())], np.uint64
    )
    return _vote(h)


def _vote(h: np.ndarray) -> int:
    out, by_byte = 0, h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        ones = np.bincount(by_byte[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * ones > len(h)):
            out |= 1 << (8 * k + int(bit))
    return out


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 4, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (long, the 64 bits), and the columns of ``also``. Null texts count as empty."""
    rows = docs.select("doc_id", "text", *[c.alias(name) for name, c in (also or {}).items()])
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        for batch in batches:
            fps = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows
            )
            kept = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], [*[f.name for f in others], "fp"])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField("fp", T.LongType())]))


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary code."""
    a, b = fp & _LOW, (fp >> np.uint64(1)) & _LOW
    return (a | b) | ((a & b) << np.uint64(1))


def axes_for(rows: int, distance: int) -> int:
    """Axes for which about four strangers or fewer share a cell (0.75 bits of choice a bit)."""
    for g in range(distance + 2, distance + 7):
        if rows <= 4 * 2.0 ** (48 * (g - distance) / g):
            return g
    return distance + 7


def _axis_masks(g: int) -> list[int]:
    edges = [round(32 * k / g) for k in range(g + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def grid_cells(nodes: DataFrame, distance: int, g: int) -> DataFrame:
    """(node) -> (cell, node) for every choice of g - distance axes."""
    masks = _axis_masks(g)
    choices = [np.uint64(sum(c)) for c in combinations(masks, g - distance)]
    salts = [np.uint64(xxhash.xxh64_intdigest(bytes([k % 256, k // 256]), 7)) for k in range(len(choices))]
    assert len(choices) == comb(g, distance)

    def run(batches):
        for batch in batches:
            fp = batch.column("node").to_numpy().view(np.uint64)
            u = unary_counts(fp)
            cells = np.concatenate([_mix((u & m) ^ s) for m, s in zip(choices, salts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.view(np.int64)), pa.array(np.tile(fp, len(choices)).view(np.int64))], ["cell", "node"]
            )

    return nodes.mapInArrow(run, "cell long, node long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit keys; cells of different choices differ by their salt."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(distance: int):
    def check(batch, left, right):
        fp = batch.column("node").to_numpy().view(np.uint64)
        a, b = fp[left], fp[right]
        near = np.flatnonzero(np.bitwise_count(unary_counts(a) ^ unary_counts(b)) <= distance)
        linked = np.zeros(len(left), bool)
        linked[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
        return linked, None

    return check


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Near-duplicate groups: ``doc_id, fp, fingerprint, component_id``, one row per input row.

    Fingerprints at ``distance`` or fewer differing bits are linked; ``component_id`` is the
    smallest doc_id reachable. Equal fingerprints are one node, so copies cost nothing beyond
    their own row. Null texts count as empty; a text without words has fingerprint zero and is
    linked like any other; rows without a doc_id take part and never give the component its id
    unless all of it lacks one. Repeated rows come out repeated. Extra columns are not read.
    """
    fps, grouped = _grouped(docs, words, distance)
    smallest = grouped.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = shuffled(grouped).join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    return shuffled(fps).join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, words: int, distance: int, also: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and (node, least_doc, component) of the distinct ones; a component goes by its least node."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, words, also), "fingerprints")
    nodes = scratch.keep(fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_doc")), "nodes")
    g = axes_for(nodes.count(), distance)
    units = cell_blocks(grid_cells(nodes.select("node"), distance, g))
    links = scan_units(units, _within(distance)).filter("node <> root").select(
        F.col("node").alias("a"), F.col("root").alias("b")
    )
    label = components(links, scratch)
    grouped = shuffled(nodes).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return fps, scratch.keep(grouped, "grouped")


def keep_one_per_group(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The documents table without near-duplicates: one row of each group stays, with all its columns.

    That is the row of the smallest doc_id. Rows without a doc_id stay only where their whole group
    lacks one. Of rows that share the doc_id, the one whose text has the smallest SHA-256 stays, and
    of rows alike in both any one. Null texts count as empty. An empty table gives no rows.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    fps, grouped = _grouped(docs, words, distance, {"__digest": digest})
    row = {"__unnamed": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)).cast("long")}
    order = F.struct(*[c.alias(name) for name, c in row.items()], "__digest")
    first = (
        fps.groupBy("fp")  # copies meet in partial sums, not in a join
        .agg(F.min(order).alias("first"))
        .join(shuffled(grouped.select(F.col("node").alias("fp"), "component")), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select("first.*")
    )
    # a row has one group, so what stays is named by its doc_id and text; copies have ids of their own
    own = [*row, "__digest"]
    # a semi join, in which the documents can't be the side that is broadcast
    known = docs.withColumns(row | {"__digest": digest}).join(first, own, "left_semi")
    turn = F.row_number().over(Window.partitionBy(*own).orderBy(F.monotonically_increasing_id()))
    return known.withColumn("__turn", turn).filter("__turn = 1").select(*docs.columns)
