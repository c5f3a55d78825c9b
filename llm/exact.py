"""Exact duplicates by two passes over a Bloom filter of text hashes.

Texts are equal when they agree after all white space is deleted. The first pass marks every
text's positions in a filter that tells positions met once from those met again; the second
pass asks it about every row. A row of which some position was met only once has no equal and
passes straight through. Only the others, the copies and about one row in four hundred
besides, are shuffled to their hash, where the whole SHA-256 decides.

The filter has 16 bits a row, in segments of 2^16 bits; a text has all its four positions in
one segment. It is built without the driver: a task hands on the positions it has met, sorted
and once each, and they meet by segment. Tables whose filter would pass ``filter_bytes`` are
cut into classes of segments; each class has a filter of its own, so what is broadcast at
once is bounded whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, whole_groups

_WHITE = "\t\n\x0b\x0c\r "
SEGMENT_BITS = 1 << 16
ROWS_A_SEGMENT = SEGMENT_BITS // 16
POSITIONS = 4
#: Largest filter that is broadcast at once.
FILTER_BYTES = 256 << 20
#: Groups of more than this share of the rows meet their result by broadcast (so at most as many groups).
HEAVY_SHARE = 4096
#: Rows of which a task holds the positions at once.
_HELD = 1 << 20


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def _marks(batches):
    """(segment, positions met once, positions met again) of the rows of a task."""

    def fragments(codes):
        # equal codes of one row (two positions that coincide) only add a row to those that shuffle
        code, count = np.unique(codes, return_counts=True)
        segment = (code >> 16).astype(np.int64)
        place = (code & 0xFFFF).astype("<u2")
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(first[1:], len(code))
        rows = [
            (int(segment[a]), place[a:b].tobytes(), place[a:b][count[a:b] > 1].tobytes()) for a, b in zip(first, ends)
        ]
        for at in range(0, len(rows), 1 << 14):
            part = rows[at : at + (1 << 14)]
            columns = [pa.array([r[k] for r in part], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "met", "again"])

    held, n = [], 0
    for batch in batches:
        segment = batch.column("segment").to_numpy().astype(np.int64)
        bits = batch.column("bits").to_numpy().view(np.uint64)
        for k in range(POSITIONS):
            held.append(segment << 16 | (bits >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64))
        n += batch.num_rows
        if n >= _HELD:
            yield from fragments(np.concatenate(held))
            held, n = [], 0
    if n:
        yield from fragments(np.concatenate(held))


def _merged(batches):
    """(segment, words): the bits of positions that were met more than once, 64 a word."""
    for batch in whole_groups(batches, ["segment"]):
        ids = batch.column("segment").to_numpy()
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        for a, b in zip(first, np.append(first[1:], len(ids))):
            met = np.zeros(SEGMENT_BITS, np.int64)
            for part in batch.column("met").slice(a, b - a):
                met[np.frombuffer(part.as_py(), "<u2")] += 1
            again = met > 1
            for part in batch.column("again").slice(a, b - a):
                again[np.frombuffer(part.as_py(), "<u2")] = True
            if again.any():
                words = np.packbits(again, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a]], pa.int64()), pa.array([words], pa.list_(pa.int64()))], ["segment", "words"]
                )


def repeat_filter(hashed: DataFrame) -> DataFrame:
    """(segment, words) for the segments in which any position was met twice; from (segment, bits)."""
    parts = hashed.select("segment", "bits").mapInArrow(_marks, "segment long, met binary, again binary")
    ordered = parts.repartition("segment").sortWithinPartitions("segment")
    return ordered.mapInArrow(_merged, "segment long, words array<long>")


def _met_again() -> Column:
    """Whether all positions of a row are marked in the words of its segment."""
    found = F.lit(True)
    for k in range(POSITIONS):
        at = F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(SEGMENT_BITS - 1)).cast("int")
        word = F.get("words", F.shiftright(at, 6))
        found = found & (F.getbit(word, at.bitwiseAND(F.lit(63))) == 1)
    return F.coalesce(found, F.lit(False))


def possibly_repeated(digests: DataFrame, scratch: Scratch, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``digests`` (with a binary ``digest``) with a column ``again``: false only where no other row is equal."""
    rows = digests.count()
    segments = max(1, -(-rows // ROWS_A_SEGMENT))
    a_class = max(1, filter_bytes * 8 // SEGMENT_BITS)
    hashed = digests.withColumn("segment", F.pmod(F.xxhash64("digest"), F.lit(segments))).withColumn(
        "bits", F.xxhash64("digest", F.lit(1))
    )
    classes = -(-segments // a_class)
    if classes > 1:
        # one folder a class, so that each is read once a pass and nothing is shuffled for it
        hashed = scratch.keep(hashed.withColumn("class", F.expr(f"cast(segment div {a_class} as int)")), "classes", by="class")
    out = None
    for k in range(classes):
        own = hashed.filter(F.col("class") == k).drop("class") if classes > 1 else hashed
        words = scratch.keep(repeat_filter(own), "filter")
        asked = own.join(F.broadcast(words), "segment", "left").withColumn("again", _met_again())
        asked = asked.select(*digests.columns, "again")
        out = asked if out is None else out.unionByName(asked)
    return out


def _order() -> Column:
    """The row of a group that sorts first stays: most code points, smallest doc_id (null last), first row."""
    return F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def duplicates(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Group of equal texts of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. One row comes out per row.
    Of equal texts the one with the most code points stays, then the smallest doc_id, and one row
    of those that are still alike, so ``kept`` is true once a group. Null texts count as empty and
    equal the empty ones and those of white space only. Rows without a doc_id take part and stay
    only where no row as long has one; ``keep_id`` is then null. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce("text", F.lit(""))
    digests = scratch.keep(
        docs.select(
            "doc_id",
            F.length(text).cast("long").alias("n_chars"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    asked = possibly_repeated(digests, scratch, filter_bytes)
    asked = scratch.keep(asked, "asked")
    alone = asked.filter("not again").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    again = asked.filter("again").drop("again")
    groups = scratch.keep(
        again.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("first")), "groups"
    )
    most = max(64, digests.count() // HEAVY_SHARE)
    heavy = F.broadcast(groups.filter(F.col("group_size") > most))  # at most HEAVY_SHARE rows
    light = groups.filter(F.col("group_size") <= most)
    # a heavy group is in no shuffle: its rows meet the result where they are
    joined = again.join(heavy, "digest").unionByName(
        again.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest")
    )
    grouped = joined.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows as in :func:`duplicates`.

    Whole rows move only where the filter says that another may be equal, and of those each task
    hands on one a text. Of rows alike in length, doc_id and text any one stays.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    asked = possibly_repeated(docs.select(F.struct("*").alias("whole"), digest.alias("digest")), scratch, filter_bytes)
    text, doc_id = F.col("whole.text"), F.col("whole.doc_id")
    order = F.struct(-F.length(F.coalesce(text, F.lit(""))), doc_id.isNull(), doc_id, text)
    first = asked.filter("again").groupBy("digest").agg(F.min_by("whole", order).alias("whole"))
    return asked.filter("not again").select("whole.*").unionByName(first.select("whole.*"))
