"""A Merkle manifest of a dataset: a leaf for each row, a ternary tree for each source, one root.

Leaves of a source ascend by doc_id; every three consecutive nodes become one until one is
left, the source's subroot. The subroots, ordered by source, make the root in the same way.

A source may hold a third of all rows, so nothing is done per source. A tree is cut into
*superblocks* of 3^height consecutive nodes. A superblock is reduced by one task to its top
node, and the tops are the nodes of the next round, until every tree has one node left. Going
down again, a superblock meets its *outer nodes*, the siblings on the way from its top to the
root, in a cogroup: there its own nodes are reduced once more, each node's siblings inside are
joined with those outside, and the way from the node to the root is digested and folded at once.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FAN = 3
#: Levels that a superblock takes in: 3^7 = 2,187 nodes.
HEIGHT = 7


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """Digest of a row's fields, so written that no two lists of fields are written alike."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


_WAY = "array<struct<left:string,right:string>>"


def _levels(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def ranked(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``idx``, their place in their ``tree`` by ``order``, and ``n``, the tree's nodes.

    Rows are dealt by range over (tree, order), so a large tree lies in many parts. Each row is
    numbered within its part; what a tree has in the parts before is a running sum over at most
    one count a part. ``order`` should end in a column without repeats.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    schema = dealt.withColumn("at", F.lit(0).cast("long")).schema

    def number(batches):
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            new = np.append(True, tree[1:] != tree[:-1])
            start = np.flatnonzero(new)
            at = np.arange(len(tree)) - np.repeat(start, np.diff(np.append(start, len(tree))))
            if tree[0] == last:
                head = start[1] if len(start) > 1 else len(tree)
                at[:head] += count
            last, count = tree[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], schema=_names(batch, "at"))

    placed = scratch.keep(dealt.mapInArrow(number, schema).withColumn("part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("tree", "part").agg((F.max("at") + 1).alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "tree",
        "part",
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("first"),
        F.sum("here").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = placed.join(firsts, ["tree", "part"])
    return joined.withColumn("idx", F.col("at") + F.col("first")).drop("at", "part", "first")


def _names(batch, extra):
    return pa.schema([*batch.schema, pa.field(extra, pa.int64())])


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` with ``block``, the group a node's superblock is dealt to.

    Superblocks of large trees have a group each; whole small trees share as many groups as their
    nodes fill.
    """
    size = FAN**height
    few = nodes.filter(F.col("n") <= size).count()
    shared = F.pmod(F.xxhash64("tree"), F.lit(max(1, few // size)))
    own = F.xxhash64("tree", F.expr(f"idx div {size}"))
    return nodes.withColumn("block", F.when(F.col("n") > size, own).otherwise(shared))


def _superblocks(df: pd.DataFrame, height: int):
    """(columns, first row, end, levels) of every superblock of a group; ``levels`` are its nodes, level by level."""
    columns = {name: df[name].to_numpy() for name in df.columns}
    order = np.lexsort((columns["idx"], pd.factorize(columns["tree"])[0]))
    columns = {name: values[order] for name, values in columns.items()}
    tree, number = columns["tree"], columns["idx"] // FAN**height
    new = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (number[1:] != number[:-1])))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(tree)]):
        levels = [columns["node"][a:b].tolist()]
        for _ in range(min(height, _levels(int(columns["n"][a])))):
            below = levels[-1]
            levels.append([_h("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
        yield columns, a, b, levels


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The next round's nodes: the top of every superblock, and the group it came from as ``under``."""
    size = FAN**height

    def reduce(df: pd.DataFrame) -> pd.DataFrame:
        out = [
            (c["tree"][a], c["idx"][a] // size, -(-c["n"][a] // size), levels[-1][0], c["block"][a])
            for c, a, _, levels in _superblocks(df, height)
        ]
        return pd.DataFrame(out, columns=["tree", "idx", "n", "node", "under"])

    return (
        nodes.select("tree", "idx", "n", "node", "block")
        .groupBy("block")
        .applyInPandas(reduce, "tree string, idx long, n long, node string, under long")
    )


def _rounds(nodes: DataFrame, height: int, scratch: Scratch) -> list[DataFrame]:
    """``nodes`` and the tables of the rounds above it; the last has one node a tree."""
    rounds = [scratch.keep(_blocked(nodes, height), "nodes")]
    while len(rounds) < 2 or (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(scratch.keep(_blocked(_tops(rounds[-1], height), height), "nodes"))
    return rounds


def _inner(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
    """What stands left and right of the node's way through its superblock, level by level."""
    way = []
    for nodes in levels[:-1]:
        run = k - k % FAN
        way.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + FAN])))
        k //= FAN
    return way


def _meet(nodes: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """Superblocks of ``nodes`` cogrouped with the outer nodes of their tops.

    ``outer``: (tree, idx, under, way, subroot, root) of the nodes of the round above.
    ``finish(columns, a, b, ways, subroot, root)`` gives what is known of the rows a to b.
    """
    size = FAN**height

    def exchange(own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        known = {
            (tree, idx): ([(x["left"], x["right"]) for x in way], subroot, root)
            for tree, idx, way, subroot, root in zip(*(outside[c] for c in ("tree", "idx", "way", "subroot", "root")))
        }
        out = []
        for c, a, b, levels in _superblocks(own, height):
            beyond, subroot, root = known[c["tree"][a], c["idx"][a] // size]
            out.append(finish(c, a, b, [_inner(levels, k) + beyond for k in range(b - a)], subroot, root))
        return pd.concat(out, ignore_index=True)

    return nodes.groupBy("block").cogroup(outer.groupBy("under")).applyInPandas(exchange, schema)


def _ways(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """The outer nodes of every node of a round, from those of the round above."""

    def finish(c, a, b, ways, subroot, root):
        listed = [[{"left": x, "right": y} for x, y in way] for way in ways]
        known = {"way": listed, "subroot": subroot, "root": root}
        return pd.DataFrame({name: c[name][a:b] for name in ("tree", "idx", "under")} | known)

    return _meet(nodes, outer, height, finish, f"tree string, idx long, under long, way {_WAY}, subroot string, root string")


def _verified(leaves: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """Proofs and folded roots of all leaves."""

    def finish(c, a, b, ways, subroot, root):
        proofs, folded = [], []
        for node, claimed, way in zip(c["node"][a:b], c["claimed"][a:b], ways):
            proofs.append(_h("".join(x + y for x, y in way)))
            at = node if claimed is None else claimed
            for x, y in way:
                at = _h(x + at + y)
            folded.append(at)
        known = {"subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded}
        return pd.DataFrame({"doc": c["doc"][a:b], "leaf": c["node"][a:b]} | known)

    schema = "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _meet(leaves, outer, height, finish, schema)


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and where the proof leads from a second leaf.

    ``rows`` has ``tree`` (string, not null; trees are ordered bytewise), ``doc_id``, ``leaf`` and
    ``claimed``, the leaf that is folded with the row's proof (null: ``leaf`` itself). Out come
    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, a row per row. Rows of a
    tree ascend by doc_id, those without one first; rows that share one are ordered by leaf. An
    empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    # rows alike in all else are told apart by a number, so that they can lie in several parts
    rows = rows.select("tree", "doc_id", "leaf", "claimed", F.monotonically_increasing_id().alias("row"))
    leaves = ranked(scratch.keep(rows, "leaves"), ["doc_id", "leaf", "row"], scratch)
    # ids go through pandas as text: a column of numbers with a null in it would turn to doubles
    leaves = leaves.select("tree", "idx", "n", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("doc"), "claimed")
    below = _rounds(leaves, height, scratch)
    subroots = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node", F.col("under").alias("from"))
    above = _rounds(ranked(subroots, ["source"], scratch), height, scratch)

    root = F.col("node").alias("root")
    outer = above[-1].select("tree", "idx", "under", F.array().cast(_WAY).alias("way"), F.lit("").alias("subroot"), root)
    for nodes in reversed(above[1:-1]):
        outer = scratch.keep(_ways(nodes, outer, height), "ways")
    # the way on from a source's only node is that of its place among the sources
    members = above[0].withColumn("under", F.col("idx"))
    outer = scratch.keep(_ways(members, outer, height), "ways").drop("tree", "subroot")
    outer = above[0].join(outer, "idx").select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("from").alias("under"), "way",
        F.col("node").alias("subroot"), "root",
    )
    for nodes in reversed(below[1:-1]):
        outer = scratch.keep(_ways(nodes, outer, height), "ways")
    return _verified(below[0], outer, height).select(
        F.col("doc").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, claimed) of the documents table, a tree for each source.

    The source null has a tree of its own, which comes first. A document of which 2 divides the
    CRC-32 of its id (in decimal) claims the leaf it would have without its line breaks. Every
    column may be null; other columns are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    bare = F.translate("text", "\n", "")
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        "doc_id",
        leaf(*fields).alias("leaf"),
        F.when(changed, leaf(*fields[:-1], bare)).alias("claimed"),
    )
