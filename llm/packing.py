"""Sequences packed by minimum bin slack over a histogram of piece lengths.

A document's ids are cut into full pieces of the capacity and one rest. Only the histogram of
lengths, at most ``capacity`` counts, reaches the driver. There each step takes the longest
length left, finds with a bitset subset-sum which multiset of the remaining lengths fills the
window closest to capacity, backtracks how many of each length it takes, and uses that
pattern as often as the counts allow. Pieces find their place from their rank among the
pieces of their length, counted in two levels, so that one common length is spread over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_vocabulary, text_batches, vocabulary
from .common import Scratch, slices


def closest_fill(counts: dict[int, int], room: int, floor: int = 0) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, as {length: count}.

    If ``room`` cannot be met exactly and ``floor`` (what the window already holds) plus some
    sum is a power of two, the largest such sum is taken: that sequence needs no padding.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length) if length <= room else 0, 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room:
        powers = [p - floor for p in (1 << k for k in range((floor + room).bit_length())) if p >= floor]
        whole = [s for s in powers if s <= room and reach >> s & 1]
        total = max(whole) if whole else total
    picked: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            picked[length] = picked.get(length, 0) + take
            total -= length * take
    return picked


def plan_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns {length: count} and how many windows use each; together they use every piece once."""
    left = {n: c for n, c in counts.items() if c}
    while left:
        seed = max(left)
        others = {n: c - (n == seed) for n, c in left.items() if c > (n == seed)}
        pattern = closest_fill(others, capacity - seed, seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        yield pattern, times
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]


def placements(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces a window, first sequence, offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in plan_windows(counts, capacity):
        offset = 0
        for n in sorted(pattern, reverse=True):
            rows[n].append((used[n], pattern[n], sequence, offset))
            used[n] += pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    return {n: np.array(r, np.int64).reshape(-1, 4) for n, r in rows.items()}


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full pieces and one rest for each document.

    A document is its ids and ``end_id``; a null text counts as empty and has the end alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        v = vocabulary(shared.value)
        for batch in slices(batches, "text"):
            ids, at = v.encode(text_batches(batch))
            size = np.diff(at) + 1
            # every document's ids with the end put behind them
            whole = np.full(len(ids) + batch.num_rows, end_id, "<u4")
            gap = np.zeros(len(whole), bool)
            gap[np.cumsum(size) - 1] = True
            whole[~gap] = ids
            begin = np.cumsum(size) - size
            n = -(-size // capacity)
            doc = np.repeat(np.arange(batch.num_rows), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, size[doc] - start)
            first = begin[doc] + start
            view = memoryview(whole).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(size[doc]),
            ]
            if with_ids:
                at = np.append(first, len(whole)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(whole.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(run, kind + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``doc_id, start, length``.

    Sequences are gapless from offset 0. Which of several pieces of one length lands where
    follows from doc_id and start; rows that repeat both are interchangeable. The pieces are
    read three times: give a written table.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("piece lengths must be between 1 and the capacity")
    shared = spark.sparkContext.broadcast(placements(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start"))
    ranked = (
        salted.withColumn("turn", turn)
        .join(before, ["length", "salt"])
        .select(*pieces.columns, (F.col("before") + F.col("turn") - 1).alias("rank"))
    )

    names = list(pieces.columns)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                plan = shared.value[n]
                p = plan[np.searchsorted(plan[:, 0], rank[rows], "right") - 1]
                copy, nth = np.divmod(rank[rows] - p[:, 0], p[:, 1])
                sequence[rows], offset[rows] = p[:, 2] + copy, p[:, 3] + nth * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` ids, one row per piece.

    Every id of every document lies in exactly one piece, every piece in one sequence. Null
    and empty texts are packed as their end mark; repeated rows are packed each; a missing
    doc_id stays null. Extra columns are not read; an empty table has no pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences of a table packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
