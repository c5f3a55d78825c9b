"""Recorded multipart streams to frames, and frames back to multipart segments."""

import re

import pandas as pd
from pyspark.sql import functions as F

from ..functions.numbers import divided
from ..operators.scans import running, running_sum

FRAME_COLUMNS = ["url", "frame_num", "headers", "body"]
FRAMES = "url string, frame_num bigint, headers map<string,string>, body binary"

#: Used when a capture's content type names no boundary (fixed value).
DEFAULT_BOUNDARY = "myboundary"

# Accepted spellings of the length header, in order of preference (fixed values).
LENGTH_NAMES = ("Content-Length", "content-length", "Content-length")


def boundary_of(content_type):
    """Boundary named by a content type, '' when there is none."""
    match = re.search(r"boundary[^=]*=(.*)", content_type or "", re.DOTALL)
    return match.group(1).strip() if match else ""


def declared_length(headers):
    """Positive length from the headers, 0 when missing or unusable."""
    for name in LENGTH_NAMES:
        text = headers.get(name, "")
        if re.fullmatch(r"[+-]?[0-9]+", text) and int(text) > 0:
            return int(text)
    return 0


def header_field(headers, line):
    """Take one header line into ``headers``; a line without a colon says nothing."""
    name, colon, value = line.partition(b":")
    if colon:
        headers[_text(name)] = _text(value)


class PartReader:
    """Takes a multipart stream apart as its bytes come in, holding at most one part."""

    def __init__(self, boundary):
        self.mark = b"--" + boundary.encode()
        self.rest = bytearray()
        self.headers = None  # not None while inside a part's header
        self.length = 0  # not 0 while inside a part's body

    def feed(self, data):
        """Yield (headers, body) of every part that is whole now."""
        self.rest += data
        at = 0
        while True:
            if self.length:
                if len(self.rest) - at < self.length:
                    break
                body = bytes(self.rest[at : at + self.length])
                at += self.length
                yield self.headers, body
                self.headers, self.length = None, 0
                continue
            end = self.rest.find(b"\n", at) + 1
            if not end:
                break
            line = bytes(self.rest[at:end])
            at = end
            if self.headers is None:
                # anything before a line that contains the mark is skipped
                self.headers = {} if self.mark in line else None
            elif line.strip():
                header_field(self.headers, line.strip())
            else:
                self.length = declared_length(self.headers)
                if not self.length:
                    self.headers = None
        del self.rest[:at]


def _text(raw):
    return raw.strip().decode("utf-8", "replace")


def demux_frames(captures, boundary=None):
    """Frame rows of a table (path, content[, content_type]) of recorded captures.

    Frames are numbered from 1 per capture; a part without a valid length has no number and
    a truncated tail ends the capture. With a ``segment`` column a capture is the segments
    of its path in order, however long.

    Segments that come with their number of ``frames``, as :func:`mux_frames` writes them,
    begin at a part: they are read each on its own, by any task, and numbered from the frames
    before them. Raw recordings may be cut anywhere: :func:`.recordings.demux_ranges` reads
    them by ranges, so a long one is no single task.
    """
    named, counted = "content_type" in captures.columns, {"segment", "frames"} <= set(captures.columns)
    if "segment" in captures.columns and not counted:
        from .recordings import demux_ranges

        return demux_ranges(captures, boundary)
    columns = ["path", "content"] + (["content_type"] if named else [])
    if counted:
        sizes = captures.select("path", "segment", F.col("frames").cast("long").alias("frames"))
        summed = running(sizes, ["path"], "segment", {"upto": running_sum(F.col("frames"))})
        before = summed.select("path", "segment", (F.col("upto") - F.col("frames")).alias("before"))
        rows = captures.join(before, ["path", "segment"]).select(*columns, "before")
    else:
        rows = captures.select(*columns)

    def run(batches):
        block = []
        for batch in batches:
            types = batch["content_type"] if named else [None] * len(batch)
            starts = batch["before"] if counted else [0] * len(batch)
            for path, content, kind, start in zip(batch["path"], batch["content"], types, starts):
                reader = PartReader(boundary or boundary_of(kind) or DEFAULT_BOUNDARY)
                for number, (headers, body) in enumerate(reader.feed(content), int(start) + 1):
                    block.append((path, number, headers, body))
                    # a few frames at a time: a capture may be larger than one Arrow batch
                    if len(block) == 256:
                        yield pd.DataFrame(block, columns=FRAME_COLUMNS)
                        block = []
        if block:
            yield pd.DataFrame(block, columns=FRAME_COLUMNS)

    return rows.mapInPandas(run, FRAMES)


def demux_captures(spark, glob, boundary=None):
    """Frames of capture files, one file per row and files spread over the tasks.

    Spark reads a file as one value, so a file may hold up to 2 GB; longer recordings are read
    in ranges by :func:`.recordings.read_recordings`.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return demux_frames(files, boundary)


def multipart_part(body, boundary="frame"):
    """One frame with its multipart header and trailing line break."""
    opening = f"--{boundary}\r\nContent-Type: image/jpeg\r\nContent-Length: "
    return F.concat(
        F.lit(opening.encode()),
        F.octet_length(body).cast("string").cast("binary"),
        F.lit(b"\r\n\r\n"),
        body,
        F.lit(b"\r\n"),
    )


def mux_frames(df, boundary="frame", segment_frames=64):
    """The multipart byte stream of every url, as consecutive segments.

    A stream has no largest size, so it is not put into one value: a segment holds the parts
    of at most ``segment_frames`` frame numbers, and the segments of a url in ``segment``
    order are its stream.
    """
    parts = df.select(
        "url",
        divided(F.col("frame_num") - 1, segment_frames).alias("segment"),
        "frame_num",
        multipart_part(F.col("body"), boundary).alias("part"),
    )
    return parts.groupBy("url", "segment").agg(
        F.count("*").alias("frames"),
        F.expr("listagg(part) within group (order by frame_num)").alias("content"),
    )
