"""Streamed bodies: assembly, running view, decompression."""

import hashlib
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..functions.batches import bounded
from ..functions.numbers import divided
from ..session import scratch_path
from .scans import running, running_sum

SIZE_ERROR = "appending chunk would violate size limit"
INCOMPLETE_ERROR = "cannot decompress an incomplete body"
GZIP_ERROR = "gzip decompression failed"
ENCODING_ERROR = "unsupported encoding/compression strategy"
PIECE_ERROR = "the body is cut into several segments, of which a handler must not see one alone"

#: Bytes of a body that are one row; larger bodies are cut into segments.
SEGMENT_BYTES = 64 << 20
#: Inflated bytes that are one row: a small gzip body may inflate a thousandfold.
INFLATED_BYTES = 64 << 20

_KEY = ["stream_id", "phase"]


def _accepted(chunks, max_size):
    """(stream_id, phase, seq) of the chunks that fit, besides empty ones, which always do.

    Until the first refusal the buffered size is the running size, so a running sum settles
    most chunks in parallel. Only later chunks no larger than the space left then are still
    open; they are walked in order, sizes only, with one number of state per body.
    """
    sizes = chunks.select(*_KEY, "seq", F.octet_length("chunk").cast("long").alias("n")).filter(
        (F.col("n") > 0) & (F.col("n") <= max_size)
    )
    summed = running(sizes, _KEY, "seq", {"upto": running_sum(F.col("n"))})
    fits = summed.filter(F.col("upto") <= max_size)
    taken = fits.groupBy(*_KEY).agg(F.max("upto").alias("taken"))
    open_ = (
        summed.filter(F.col("upto") > max_size)
        .join(taken, _KEY)
        .filter(F.col("n") <= max_size - F.col("taken"))
        .select(*_KEY, "seq", "n", "taken")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "seq")
    )

    def walk(batches):
        key, size = None, 0
        for batch in batches:
            keep = []
            for stream, phase, n, taken_ in zip(
                batch["stream_id"], batch["phase"], batch["n"], batch["taken"]
            ):
                if (stream, phase) != key:
                    key, size = (stream, phase), taken_
                keep.append(size + n <= max_size)
                if keep[-1]:
                    size += n
            yield batch.loc[keep, ["stream_id", "phase", "seq"]]

    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    late = open_.mapInPandas(
        walk, ", ".join(f"{c} {types[c]}" for c in (*_KEY, "seq"))
    )
    return fits.select(*_KEY, "seq").unionByName(late)


def _segments(chunks, segment_bytes):
    """(stream_id, phase, seq, segment) of the chunks of bodies larger than one segment, None if there is none.

    A segment begins with the first chunk past a multiple of ``segment_bytes`` of its own body.
    Only sizes are looked at, and only those of large bodies are summed up in order.
    """
    sizes = chunks.select(*_KEY, "seq", F.coalesce(F.octet_length("chunk"), F.lit(0)).cast("long").alias("n"))
    large = sizes.groupBy(*_KEY).agg(F.sum("n").alias("total")).filter(F.col("total") > segment_bytes)
    if large.isEmpty():
        return None
    summed = running(
        sizes.join(large.select(*_KEY), _KEY, "left_semi"), _KEY, "seq", {"upto": running_sum(F.col("n"))}
    )
    return summed.select(*_KEY, "seq", divided(F.col("upto") - F.col("n"), segment_bytes).alias("segment"))


def assemble_bodies(chunks, max_size=-1, segment_bytes=SEGMENT_BYTES):
    """Body of every (stream_id, phase), its chunks joined in ``seq`` order.

    A body of up to ``segment_bytes`` is one row, wherever its chunks stand in the exchange; a
    larger one is several ``segments``, cut between chunks by its own bytes. One pass sums up the
    sizes. Where no body is larger than a segment, the bytes are read and shuffled once after
    that, by body. Where one is, they are joined with their segments, which shuffles them by
    chunk and then by segment, as a large body must not travel whole, and the segments are
    written to the shared folder.

    ``complete`` tells that the end_of_stream chunk was accepted. With ``max_size`` > 0 a
    chunk that would exceed it is refused, and chunks after it that still fit are kept.
    """
    size = F.coalesce(F.octet_length("chunk"), F.lit(0)).cast("long")
    cut = chunks.select(*_KEY, "seq", "chunk", F.coalesce("end_of_stream", F.lit(False)).alias("ends"), size.alias("n"))
    placed = _segments(chunks, segment_bytes)
    if placed is None:
        cut = cut.withColumn("segment", F.lit(0).cast("long"))
    else:
        cut = cut.join(placed, [*_KEY, "seq"], "left").withColumn("segment", F.coalesce("segment", F.lit(0).cast("long")))
    if max_size > 0:
        kept = _accepted(chunks, max_size).withColumn("kept", F.lit(True))
        cut = cut.join(kept, [*_KEY, "seq"], "left").withColumn(
            "refused", (F.col("n") > 0) & F.col("kept").isNull()
        )
    else:
        cut = cut.withColumn("refused", F.lit(False))
    accepted = ~F.col("refused")

    # the filter sits inside the aggregate: a segment of empty chunks still is a row
    parts = cut.groupBy(*_KEY, *([] if placed is None else ["segment"])).agg(
        F.coalesce(
            F.expr("listagg(if(n > 0 and not refused, chunk, null)) within group (order by seq)"),
            F.lit(b""),
        ).alias("body"),
        # a sum of its own, so that who needs the sizes only moves no bytes
        F.sum(F.when(accepted, F.col("n")).otherwise(0)).alias("own"),
        F.max(F.col("ends") & accepted).alias("segment_ends"),
        F.sum(F.col("refused").cast("long")).alias("segment_refused"),
    )
    error = lambda refused: F.when(refused > 0, F.lit(SIZE_ERROR)).alias("error")
    if placed is None:
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        return parts.select(
            *_KEY, zero.alias("segment"), "body", zero.alias("offset"), F.col("own").alias("body_size"),
            F.col("segment_ends").alias("complete"), error(F.col("segment_refused")), one.alias("segments"),
        )
    # the segments of large bodies are written: what is known of a body comes from rows without bytes
    path = scratch_path(chunks.sparkSession, "segments")
    parts.write.parquet(path)
    parts = chunks.sparkSession.read.schema(parts.schema).parquet(path)
    body = Window.partitionBy(*_KEY)
    before = body.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    told = parts.drop("body").select(
        *_KEY,
        "segment",
        F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"),
        F.sum("own").over(body).alias("body_size"),
        F.max("segment_ends").over(body).alias("complete"),
        error(F.sum("segment_refused").over(body)),
        F.count("*").over(body).alias("segments"),
    )
    known = parts.select(*_KEY, "segment", "body").join(told, [*_KEY, "segment"])
    return known.select(*_KEY, "segment", "body", "offset", "body_size", "complete", "error", "segments")


def running_bodies(chunks, buffered=True):
    """What the handler sees at each chunk: the first ``body_end`` bytes of the body.

    Without buffering that is the chunk itself. With buffering it is everything so far, given
    as the end offset into the assembled body; :func:`body_so_far` cuts it out.
    """
    size = F.coalesce(F.octet_length("chunk"), F.lit(0)).cast("long")
    if not buffered:
        return chunks.withColumns({"body_end": size, "body": F.col("chunk")})
    return running(chunks, _KEY, "seq", {"body_end": running_sum(size)})


def body_so_far(seen, bodies):
    """Append ``body``, the bytes up to ``body_end``, to the chunks of :func:`running_bodies`.

    ``bodies`` are the assembled bodies, each one segment. The result holds every prefix of
    every body: that is quadratic in the chunks of a body, and meant for bodies of few chunks.
    """
    whole = bodies.select(
        *_KEY,
        F.when(F.col("segments") == 1, F.col("body"))
        .otherwise(F.raise_error(F.lit(PIECE_ERROR)).cast("binary"))
        .alias("__whole"),
    )
    return (
        seen.join(whole, _KEY)
        .withColumn("body", F.substring(F.col("__whole"), F.lit(1), F.col("body_end").cast("int")))
        .drop("__whole")
    )


def prefix_digests(chunks):
    """(stream_id, phase, seq, body_end, digest): length and MD5 of the body up to every chunk.

    What tells one prefix from another without writing prefixes out: a body's chunks pass one
    task in order, which holds the digest's state only, so every byte is moved and hashed once.
    """
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in (*_KEY, "seq")) + ", body_end long, digest string"

    def walk(batches):
        key, state, end = None, None, 0
        for batch in batches:
            ends, digests = [], []
            for stream, phase, chunk in zip(*(batch.column(c) for c in (*_KEY, "chunk"))):
                here = (stream.as_py(), phase.as_py())
                if here != key or state is None:
                    key, state, end = here, hashlib.md5(usedforsecurity=False), 0
                if chunk.is_valid:
                    state.update(chunk.as_buffer())
                    end += len(chunk.as_buffer())
                ends.append(end)
                digests.append(state.hexdigest())
            known = [batch.column(c) for c in (*_KEY, "seq")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(ends, pa.int64()), pa.array(digests)], [*_KEY, "seq", "body_end", "digest"])

    ordered = chunks.select(*_KEY, "seq", "chunk").repartition(*_KEY).sortWithinPartitions(*_KEY, "seq")
    return ordered.mapInArrow(walk, schema)


class Inflater:
    """Inflates a gzip stream piece by piece, member after member."""

    def __init__(self):
        self.member, self.good, self.started = None, True, False

    def pieces(self, data, limit=INFLATED_BYTES):
        """What ``data`` adds to the output, in pieces of at most ``limit`` bytes."""
        while data and self.good:
            if self.member is None:
                self.member = zlib.decompressobj(wbits=31)
                self.started = True
            try:
                out = self.member.decompress(data, limit)
                data = self.member.unconsumed_tail
                yield out
                # output may be left when all input is taken
                while not data and not self.member.eof and len(out) == limit:
                    out = self.member.decompress(b"", limit)
                    yield out
            except zlib.error:
                self.good = False
                return
            if self.member.eof:
                data = self.member.unused_data
                self.member = None

    def finished(self):
        """Whether everything fed was whole members, at least one."""
        return self.good and self.started and self.member is None


def gunzip(data, limit=INFLATED_BYTES):
    """(bytes, outcome): the inflated bytes with ``good``, none with ``bad`` or ``large``.

    ``large`` are bodies that inflate to more than ``limit`` bytes; they are not inflated whole.
    """
    inflater, out, size = Inflater(), [], 0
    for piece in inflater.pieces(data, limit):
        size += len(piece)
        if size > limit:
            return None, "large"
        out.append(piece)
    return (b"".join(out), "good") if inflater.finished() else (None, "bad")


def _inflate(limit):
    @F.arrow_udf("body binary, outcome string")
    def inflate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bodies in batches:
            opened = (gunzip(b.as_py(), limit) if b.is_valid else (None, None) for b in bodies)
            for found in bounded(opened, lambda one: len(one[0] or b"")):
                yield pa.StructArray.from_arrays(
                    [pa.array([b for b, _ in found], pa.binary()), pa.array([o for _, o in found], pa.string())],
                    names=["body", "outcome"],
                )

    return inflate


def _outcome():
    needs = F.col("compressed") & F.col("complete") & (F.col("encoding") == "gzip")
    early = (
        F.when(~F.col("compressed"), F.lit(None))
        .when(~F.col("complete"), F.lit(INCOMPLETE_ERROR))
        .when(F.col("encoding") != "gzip", F.lit(ENCODING_ERROR))
    )
    return needs, early


def inflate_segments(df, piece_bytes=INFLATED_BYTES):
    """Inflate gzip bodies of one or several segments, each walked in order with bounded memory.

    Deflate data can only be entered at its start, so the segments of one body pass through
    one task one after another. Rows are (stream_id, phase, segment, piece, body, ok): a
    segment gives as many pieces of at most ``piece_bytes`` as it inflates to, one at least;
    ``ok`` on the last of a body tells whether the whole body was good.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def walk(batches):
        for held in bounded(rows_of(batches), lambda row: len(row[4])):
            yield block(held)

    def rows_of(batches):
        key, inflater = None, None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("stream_id", "phase", "segment")]
            for k, at in enumerate(zip(*columns)):
                if at[:2] != key:
                    key, inflater = at[:2], Inflater()
                n, last = 0, b""
                for piece in inflater.pieces(batch.column("body")[k].as_py() or b"", piece_bytes):
                    if n:
                        yield (*at, n - 1, last, False)
                    n, last = n + 1, piece
                yield (*at, max(n - 1, 0), last, inflater.finished())

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    names = ["stream_id", "phase", "segment", "piece", "body", "ok"]
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    kinds = [arrow[types["stream_id"]], arrow[types["phase"]], pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return (
        df.select(*_KEY, F.col("segment").cast("bigint"), "body")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "segment")
        .mapInArrow(
            walk,
            f"stream_id {types['stream_id']}, phase {types['phase']}, segment bigint, piece bigint, "
            "body binary, ok boolean",
        )
    )


def _decode_whole(df, limit):
    needs, early = _outcome()
    # rows that are not gzip send a null to Python and stay in the JVM otherwise
    opened = df.withColumn("__in", _inflate(limit)(F.when(needs, F.col("body"))))
    outcome = F.col("__in.outcome")
    too_large = F.raise_error(F.lit(f"a body inflates to more than {limit} bytes: give it with its segments")).cast("string")
    return (
        opened.withColumn(
            "decode_error",
            F.when(outcome == "bad", F.lit(GZIP_ERROR)).when(outcome == "large", too_large).otherwise(early),
        )
        .withColumns(
            {
                "body": F.coalesce("__in.body", "body"),
                "decompressed": F.col("decode_error").isNull(),
            }
        )
        .drop("__in")
    )


def decode_bodies(df, piece_bytes=INFLATED_BYTES):
    """Decompress complete gzip bodies; on any failure the raw bytes go on.

    Reads body, complete, compressed and encoding; appends ``decompressed`` and
    ``decode_error``. Without segments a body that inflates to more than ``piece_bytes`` is an
    error. Bodies that come with stream_id, phase, segment and segments are inflated in order
    and come out in ``piece`` rows, ordered by (segment, piece), however large they become.
    """
    if "segments" not in df.columns:
        return _decode_whole(df, piece_bytes)
    needs, early = _outcome()
    zipped, others = df.filter(needs), df.filter(~F.coalesce(needs, F.lit(False)))
    untouched = others.withColumns(
        {"piece": F.lit(0).cast("long"), "decode_error": early, "decompressed": early.isNull()}
    )
    # the last piece knows whether the whole was good; where it was bad, one row a segment stays
    whole = F.max_by("ok", F.struct("segment", "piece")).over(Window.partitionBy(*_KEY))
    opened = (
        inflate_segments(zipped, piece_bytes)
        .withColumn("ok", whole)
        .withColumnRenamed("body", "__out")
        .filter("ok or piece = 0")
        .join(zipped.withColumn("segment", F.col("segment").cast("bigint")), [*_KEY, "segment"])
        .withColumns(
            {
                "body": F.when(F.col("ok"), F.col("__out")).otherwise(F.col("body")),
                "decode_error": F.when(~F.col("ok"), F.lit(GZIP_ERROR)),
                "decompressed": F.col("ok"),
            }
        )
        .select(*untouched.columns)
    )
    return untouched.unionByName(opened)


def decode_report(decoded):
    """Bodies by encoding and outcome."""
    return decoded.groupBy("encoding", F.coalesce("decode_error", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("bodies")
    )
