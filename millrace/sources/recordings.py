"""Raw multipart recordings of any length, taken apart by ranges.

Nobody knows where a part of a recording begins: a range may open inside a header or inside a
body, and a body may hold what looks like a boundary. A reader that skips, however, only waits
for the next boundary, wherever it has come from; so what it does there depends on the
boundary's place alone. Every range lists its boundaries with the place its part leads to, and
only that list is walked in order: a boundary before the place reached so far lies in a body. The
walk settles which parts are there and their numbers; the bytes are cut out by range again.
"""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.numbers import divided
from ..operators.scans import running, running_sum
from .multipart import DEFAULT_BOUNDARY, boundary_of, declared_length, header_field

#: Bytes of a recording that one task looks through at once, and the longest header.
RANGE_BYTES, HEADER_BYTES = 8 << 20, 64 << 10
HEADER_ERROR = "a part's header is longer than the reader looks ahead"


def read_recordings(spark, glob, segment_bytes=8 << 20):
    """Recording files as a table of segments (path, segment, content), whatever their size.

    Files are split like text: Spark deals ranges of a file to tasks, cut after line feeds, and
    the lines of a range are put together again to segments of about ``segment_bytes``.
    """
    lines = spark.read.option("lineSep", "\n").text(glob).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"),
    )

    def glue(batches):
        at, held, n, part = None, [], 0, 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]]), pa.array([at[1] + part], pa.int64()), pa.array([b"\n".join([*held, b""])], pa.binary()),
                    pa.array([at[2]], pa.int64()),
                ],
                ["path", "segment", "content", "size"],
            )

        for batch in batches:
            for path, block, size, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size", "line"))):
                if at != (path, block, size) or n >= segment_bytes:
                    if held:
                        yield segment()
                    part = part + 1 if at == (path, block, size) else 0
                    at, held, n = (path, block, size), [], 0
                held.append(line)
                n += len(line) + 1
        if held:
            yield segment()

    cut = lines.mapInArrow(glue, "path string, segment long, content binary, size long")
    # the last line of a file may lack the line feed that every line was given
    sizes = cut.select("path", "segment", "size", F.octet_length("content").cast("long").alias("n"))
    over = sizes.groupBy("path").agg((F.sum("n") - F.max("size")).alias("over"), F.max("segment").alias("segment")).filter("over > 0")
    short = F.octet_length("content") - F.coalesce("over", F.lit(0)).cast("int")
    return cut.join(over, ["path", "segment"], "left").select("path", "segment", F.substring("content", F.lit(1), short).alias("content"))


def _ranges(segments, range_bytes, header_bytes):
    """(key, range, content, kind): the bytes of each range and some of the next, and the size of each recording."""
    size = F.octet_length("content").cast("long")
    sizes = segments.select("key", "segment", size.alias("n"))
    placed = running(sizes, ["key"], "segment", {"upto": running_sum(F.col("n"))})
    whole = placed.groupBy("key").agg(F.max("upto").alias("at"))
    first, last = F.col("upto") - F.col("n"), F.col("upto")
    spans = F.sequence(divided(F.greatest(first - header_bytes, F.lit(0).cast("long")), range_bytes), divided(last - 1, range_bytes))
    low = F.greatest(first, F.col("range") * range_bytes)
    high = F.least(last, (F.col("range") + 1) * range_bytes + header_bytes)
    pieces = (
        segments.join(placed.filter("n > 0"), ["key", "segment"])
        .select("key", "content", "kind", "upto", "n", F.explode(spans).alias("range"))
        .filter(high > low)
        .select("key", "range", "kind", low.alias("low"), F.substring("content", (low - first + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    )
    ranges = pieces.groupBy("key", "range").agg(
        F.expr("listagg(piece) within group (order by low)").alias("content"), F.max("kind").alias("kind")
    )
    return ranges, whole


def _boundaries(data, mark, own):
    """(place, end of its header, headers) of every boundary that begins in the first ``own`` bytes.

    The end is None where the header goes on beyond ``data``.
    """
    at = data.find(mark)
    while 0 <= at < own:
        headers, end = {}, None
        line = data.find(b"\n", at) + 1
        while line:
            stop = data.find(b"\n", line) + 1
            if not stop:
                break
            text = data[line:stop].strip()
            if not text:
                end = stop
                break
            header_field(headers, text)
            line = stop
        yield at, end, headers
        at = data.find(mark, at + 1)


def demux_ranges(captures, boundary=None, range_bytes=RANGE_BYTES, header_bytes=HEADER_BYTES):
    """Frames (url, frame_num, headers, body) of recordings given as segments, read by many tasks.

    ``captures`` has path, segment, content and maybe content_type, one for a recording. The
    frames are those a reader finds that goes through a recording from its start: see
    :func:`.multipart.demux_frames`. Shuffled are the bytes, once to their ranges and once to
    their frames; what is walked in order is one row for a boundary.
    """
    kind = F.col("content_type") if "content_type" in captures.columns else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), "path"), F.lit(""))  # a path may be null
    segments = captures.select(key.alias("key"), F.col("segment").cast("long").alias("segment"), "content", kind.alias("kind"))
    ranges, whole = _ranges(segments, range_bytes, header_bytes)

    def find(batches):
        for batch in batches:
            rows = []
            for key_, number, data, type_ in zip(*(batch.column(c) for c in ("key", "range", "content", "kind"))):
                data, base = data.as_py(), number.as_py() * range_bytes
                mark = b"--" + (boundary or boundary_of(type_.as_py()) or DEFAULT_BOUNDARY).encode()
                for at, end, headers in _boundaries(data, mark, range_bytes):
                    length = declared_length(headers) if end else 0
                    rows.append((key_.as_py(), base + at, None if end is None else base + end, length, json.dumps(headers)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, t) for column, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names
            )

    names = ["key", "at", "start", "length", "headers"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = "key string, at long, start long, length long, headers string"
    found = ranges.select("key", "range", "content", "kind").mapInArrow(find, schema)
    # the end of a recording comes after its boundaries and has no header
    ends = whole.select("key", "at", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("length", "long"), ("headers", "string"))])
    listed = found.unionByName(ends).repartition("key").sortWithinPartitions("key", "at", F.asc_nulls_first("headers"))

    def walk(batches):
        now, reached, number, waiting = None, 0, 0, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] != now:
                    now, reached, number, waiting = row[0], 0, 0, None
                key_, at, start, length, headers = row
                if at < reached:
                    continue
                if waiting:  # whole, as something comes after it
                    number += 1
                    out.append((key_, number, *waiting))
                    waiting = None
                if headers is None:
                    reached = float("inf")
                elif start is None:
                    # whatever follows is in this header
                    reached = float("inf")
                    out.append((key_, None, at, None, headers))
                else:
                    reached = start + length
                    waiting = (start, length, headers) if length else None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], part_names)

    part_names = ["key", "frame_num", "start", "length", "headers"]
    parts = listed.mapInArrow(walk, "key string, frame_num long, start long, length long, headers string")
    # a header without an end is a truncated tail only where the recording ends within the look-ahead
    cut_off = parts.filter("frame_num is null").join(whole.withColumnRenamed("at", "size"), "key")
    checked = cut_off.filter(F.col("start") + header_bytes < F.col("size")).select(
        "key", F.raise_error(F.lit(HEADER_ERROR)).cast("long").alias("frame_num"), "start", "length", "headers"
    )
    wanted = parts.filter("frame_num is not null").unionByName(checked)
    stop = F.col("start") + F.col("length")
    asked = wanted.select("*", F.explode(F.sequence(divided(F.col("start"), range_bytes), divided(stop - 1, range_bytes))).alias("range"))
    low, high = F.greatest("start", F.col("range") * range_bytes), F.least(stop, (F.col("range") + 1) * range_bytes)
    pieces = asked.join(ranges.select("key", "range", "content"), ["key", "range"]).select(
        "key", "frame_num", "headers", "range",
        F.substring("content", (low - F.col("range") * range_bytes + 1).cast("int"), (high - low).cast("int")).alias("piece"),
    )
    return (
        pieces.groupBy("key", "frame_num")
        .agg(F.max("headers").alias("headers"), F.expr("listagg(piece) within group (order by range)").alias("body"))
        .select(
            F.when(F.col("key") != "", F.substring("key", F.lit(2), F.length("key"))).alias("url"),
            "frame_num", F.from_json("headers", "map<string,string>").alias("headers"), "body",
        )
    )
