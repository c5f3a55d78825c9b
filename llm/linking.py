"""Pairs inside cells without writing pairs out, and connected components over the links.

Both near-duplicate operators reduce their search to *cells*: two rows can only be linked if
they share a cell. A cell may hold a third of all rows, so it is cut into blocks and every
pair of blocks is one unit of work; a unit hands on a spanning forest of its links (fewer
rows than it read) instead of the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, group_ids, shuffled, whole_groups

#: Rows of a cell that one block holds.
BLOCK = 2048


def cell_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, node) -> (cell, i, j, side, node): units of work of at most two blocks.

    Cells with one member are dropped, as they hold no pair. A node of block ``side`` goes to
    every unit that pairs its block with another one.
    """
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return (
        shuffled(members).join(sizes, "cell")
        .withColumn("blocks", F.ceil(F.col("size") / F.lit(float(block))).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cell",
            F.least("side", "other").alias("i"),
            F.greatest("side", "other").alias("j"),
            "side",
            "node",
        )
    )


def scan_units(
    units: DataFrame,
    check: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]],
) -> DataFrame:
    """Look at every pair of a unit once; return (node, root, links).

    ``check(batch, left, right)`` says which row pairs are linked and, if links are counted,
    which of these links this unit has to count. ``root`` is the smallest node the unit
    reaches from ``node`` through its own links, ``links`` the weight counted here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["cell", "i", "j"]):
            yield from _linked_rows(batch, check)

    ordered = units.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    return ordered.mapInArrow(run, "node long, root long, links long")


def _linked_rows(batch, check):
    n = batch.num_rows
    unit = group_ids(batch, ["cell", "i", "j"])
    first = np.searchsorted(unit, unit, "left")
    size = np.searchsorted(unit, unit, "right") - first
    place = np.arange(n) - first
    side, mixed = batch.column("side").to_numpy(), batch.column("i").to_numpy() != batch.column("j").to_numpy()
    node = batch.column("node").to_numpy()
    weight = batch.column("weight").to_numpy() if "weight" in batch.schema.names else np.ones(n, np.int64)
    links = np.zeros(n, np.int64)
    found: list[np.ndarray] = []
    active, shift = np.arange(n), 1
    while len(active):
        # pairs (row, row + shift) of one unit; many shifts at once while units are small
        active = active[place[active] + shift < size[active]]
        left = active
        right = left + shift
        shift += 1
        if not len(left):
            break
        apart = ~mixed[left] | (side[left] != side[right])
        left, right = left[apart], right[apart]
        for at in range(0, len(left), 1 << 16):
            a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
            linked, counted = check(batch, a, b)
            a, b = a[linked], b[linked]
            if len(a):
                found.append(np.stack([a, b]))
                if counted is not None:
                    np.add.at(links, a[counted], weight[b[counted]])
                    np.add.at(links, b[counted], weight[a[counted]])
    if not found:
        return
    a, b = np.concatenate(found, axis=1)
    root = _roots(n, a, b)
    touched = np.zeros(n, bool)
    touched[a] = touched[b] = True
    rows = np.flatnonzero(touched)
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[rows]), pa.array(node[root[rows]]), pa.array(links[rows])], ["node", "root", "links"]
    )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row through the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != (up := root[root])).any():
            root = up


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) -> (node, component): the smallest node each node reaches; nodes without edges are absent.

    Every round points each node at its smallest neighbour, follows the pointers to their
    roots by doubling, and contracts the edges onto the roots. Each root has a neighbour that
    is none, so a round at least halves the nodes of a component. Only counts reach the
    driver; every table is cut off in the shared folder, and hot roots meet in joins that
    adaptive execution can split, never in a window.
    """
    live = scratch.keep(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    label: DataFrame | None = None
    while True:
        up = scratch.keep(
            live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
            .groupBy(F.col("e.a").alias("node"))
            .agg(F.min("e.b").alias("least"))
            .select("node", F.least("node", "least").alias("root")),
            "pointers",
        )
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nxt = scratch.keep(
                shuffled(up).join(over, "root").select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")),
                "pointers",
            )
            moved = nxt.filter("moved").limit(1).count()
            scratch.drop(up)
            up = nxt
            if not moved:
                break
        roots = up.select("node", "root")
        if label is None:
            new = scratch.keep(roots.select("node", F.col("root").alias("component")), "labels")
        else:
            step = roots.select(F.col("node").alias("component"), "root")
            new = scratch.keep(
                shuffled(label).join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
                "labels",
            )
            scratch.drop(label)
        label = new
        rest = scratch.keep(
            shuffled(live)
            .join(shuffled(roots.select(F.col("node").alias("a"), F.col("root").alias("x"))), "a")
            .join(shuffled(roots.select(F.col("node").alias("b"), F.col("root").alias("y"))), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
        scratch.drop(live, up)
        live = rest
        if not live.limit(1).count():
            scratch.drop(live)
            return label
