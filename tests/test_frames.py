import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import frames
from millrace.sources import multipart


@pytest.mark.parametrize(
    "text,found",
    [
        ("multipart/x-mixed-replace;boundary=myboundary", "myboundary"),
        ("multipart/x-mixed-replace; boundary = myboundary ", "myboundary"),
        ("multipart/x-mixed-replace", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_boundary(text, found):
    assert multipart.boundary_of(text) == found


@pytest.mark.parametrize(
    "headers,length",
    [
        ({"Content-Length": "1234"}, 1234),
        ({"content-length": "5678"}, 5678),
        ({"Content-length": "9"}, 9),
        ({"CONTENT-LENGTH": "9"}, 0),
        ({"Content-Length": "x", "content-length": "5"}, 5),
        ({"Content-Length": "-4"}, 0),
        ({}, 0),
    ],
)
def test_length(headers, length):
    assert multipart.declared_length(headers) == length


def test_part_headers():
    reader = multipart.PartReader("b")
    data = b"--b\r\nContent-Type: image/jpeg\r\nContent-Length: 3\r\n\r\nabc"
    # byte by byte gives what one piece gives
    found = [part for i in range(len(data)) for part in reader.feed(data[i : i + 1])]
    assert found == [({"Content-Type": "image/jpeg", "Content-Length": "3"}, b"abc")]
    assert list(multipart.PartReader("b").feed(data)) == found


def part(body, headers=None):
    lines = headers if headers is not None else f"Content-Length: {len(body)}\r\n"
    return b"--b\r\n" + lines.encode() + b"\r\n" + body + b"\r\n"


def test_parts_without_length_are_not_numbered(spark, tmp_path):
    capture = (
        b"some data\nbefore delimiter\n"
        + part(b"one")
        + part(b"skipped", "Content-Type: image/jpeg\r\n")
        + part(b"two\n--b\nstill two")
        + b"--b\r\nContent-Length: 99\r\n\r\ncut short"
    )
    (tmp_path / "c1.bin").write_bytes(capture)
    (tmp_path / "c2.bin").write_bytes(b"no parts at all")
    got = multipart.demux_captures(spark, str(tmp_path / "*.bin"), "b").collect()
    assert [(r.url.rsplit("/", 1)[1], r.frame_num, bytes(r.body)) for r in got] == [
        ("c1.bin", 1, b"one"),
        ("c1.bin", 2, b"two\n--b\nstill two"),
    ]


def test_default_boundary(spark):
    df = spark.createDataFrame([("u", b"--myboundary\r\nContent-Length: 2\r\n\r\nok")], "path string, content binary")
    assert bytes(multipart.demux_frames(df).first().body) == b"ok"


def test_mux_then_demux_is_the_identity(spark):
    rows = [("u", n, bytes([n % 256]) * (n * 7 % 50 + 1)) for n in range(1, 600)]
    df = spark.createDataFrame(rows, "url string, frame_num bigint, body binary")
    segments = multipart.mux_frames(df)
    assert [r.frames for r in segments.orderBy("segment").collect()] == [64] * 9 + [23]
    whole = b"".join(bytes(r.content) for r in segments.orderBy("segment").collect())
    back = multipart.demux_frames(spark.createDataFrame([("u", whole)], "path string, content binary"), "frame")
    assert [(r.frame_num, bytes(r.body)) for r in back.orderBy("frame_num").collect()] == [(n, b) for _, n, b in rows]
    # and from segments cut anywhere
    pieces = [("u", i, whole[at : at + 100]) for i, at in enumerate(range(0, len(whole), 100))]
    cut = spark.createDataFrame(pieces, "path string, segment bigint, content binary")
    back = multipart.demux_frames(cut, "frame")
    assert [(r.frame_num, bytes(r.body)) for r in back.orderBy("frame_num").collect()] == [(n, b) for _, n, b in rows]


def test_ranges_give_the_frames_of_one_pass(spark, tmp_path):
    """Whatever lies at a range's border, frames and numbers are those of a reader that starts at the first byte."""
    import random

    from millrace.sources import recordings

    rng = random.Random(3)
    parts = [b"some data\nbefore --x\n"]
    for n in range(120):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 90))) + rng.choice([b"", b"\n--b\nContent-Length: 5\n\n", b"--b\r\n\r\n", b"\n"])
        extra = rng.choice(["", "Content-Type: image/jpeg\r\n", f"X-N: {n}\r\nno colon\r\n", "--b: 1\r\n"])
        parts.append(part(body, f"{extra}Content-Length: {len(body)}\r\n" if n % 9 else "Content-Length: none\r\n"))
        if n % 11 == 0:
            parts.append(b"noise --b in a line --b\r\nContent-length: 3\r\n\r\n--b--b\r\n")
    ends = [b"", b"--b\r\nContent-Length: 99\r\n\r\ncut short", b"--b\r\nContent-Length: 3", b"--b\r\nContent-Length: 3\r\n\r\nabc", b"--b"]
    whole = {f"c{k}": b"".join(parts[: 20 + 25 * k]) + end for k, end in enumerate(ends)} | {"none": b"\n\n", "empty": b""}
    expected = sorted(
        (path, n, body, headers)
        for path, data in whole.items()
        for n, (headers, body) in enumerate(multipart.PartReader("b").feed(data), 1)
    )
    size = -(-max(map(len, whole.values())) // 16)
    rows = [(p, i, d[at : at + size]) for p, d in whole.items() for i, at in enumerate(range(0, max(len(d), 1), size))]
    table = spark.createDataFrame(rows, "path string, segment bigint, content binary").repartition(5)
    for range_bytes in (97, 1000, 1 << 20):
        got = recordings.demux_ranges(table, "b", range_bytes, 300).collect()
        assert sorted((r.url, r.frame_num, bytes(r.body), r.headers) for r in got) == expected
    # the same files, split by Spark inside of bodies and headers
    for path, data in whole.items():
        (tmp_path / path).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        segments = recordings.read_recordings(spark, str(tmp_path / "*"), 200)
        found = {}
        for r in segments.orderBy("path", "segment").collect():
            found.setdefault(r.path.rsplit("/", 1)[1], []).append(bytes(r.content))
        assert {p: b"".join(x) for p, x in found.items()} == {p: d for p, d in whole.items() if d}
        assert max(map(len, found.values())) >= 16
        got = multipart.demux_frames(segments, "b").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.url.rsplit("/", 1)[1], r.frame_num, bytes(r.body), r.headers) for r in got) == expected


def test_header_beyond_the_look_ahead_is_an_error(spark):
    from millrace.sources import recordings

    data = b"--b\r\nX: " + b"y" * 500 + b"\r\nContent-Length: 2\r\n\r\nok" + b"z" * 500
    table = spark.createDataFrame([("u", 0, data)], "path string, segment bigint, content binary")
    assert bytes(recordings.demux_ranges(table, "b", 100, 600).first().body) == b"ok"
    with pytest.raises(Exception, match="looks ahead"):
        recordings.demux_ranges(table, "b", 100, 50).collect()


def test_factor(spark):
    df = spark.createDataFrame([("u", 10 * i) for i in range(11)], "url string, seq bigint")
    for factor in (1, 2, 10):
        kept = frames.sample_every(df, factor).orderBy("frame_num").collect()
        assert [r.frame_num for r in kept] == list(range(factor, 12, factor))
    for factor in (0, -1):
        with pytest.raises(ValueError, match="processing_factor must be >= 1"):
            frames.sample_every(df, factor)


def test_numbers_do_not_depend_on_slices(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"u{i % 5}", i) for i in range(300)], "url string, seq bigint")
    from millrace.operators.scans import running, running_count

    whole = sorted(map(tuple, running(df, ["url"], "seq", {"n": running_count()}).collect()))
    cut = sorted(map(tuple, running(df, ["url"], "seq", {"n": running_count()}, slice_rows=7).collect()))
    assert whole == cut


def test_running_values_keep_rows_with_null_keys(spark):
    from millrace.operators.scans import running, running_last, running_max, running_sum

    df = spark.createDataFrame(
        [(None, 0, 5, None), (None, 9, 2, "x"), ("a", 3, 1, "y"), (None, 11, 1, None), (None, 30, 9, None)],
        "k string, seq bigint, n int, t string",
    )
    made = running(
        df, ["k"], "seq",
        {"s": running_sum(F.col("n")), "m": running_max(F.col("n")), "l": running_last(F.col("t"))},
        slice_rows=4,
    ).orderBy("k", "seq").select("k", "s", "m", "l").collect()
    assert [tuple(r) for r in made] == [
        (None, 5, 5, None), (None, 7, 5, "x"), (None, 8, 5, "x"), (None, 17, 9, "x"), ("a", 1, 1, "y"),
    ]


def test_keyframe_gate(spark):
    rows = [
        ("s", 96, 0, [b"\x41x"]),
        ("s", 96, 1, [b"", b"\x65key"]),
        ("s", 96, 2, [b"\x41x"]),
        ("s", 97, 0, [b"\x65"]),
        ("t", 96, 0, [b"\x41"]),
        ("t", 96, 1, None),
    ]
    df = spark.createDataFrame(rows, "stream_id string, payload_type int, seq bigint, nalus array<binary>")
    kept = frames.gate_until_keyframe(df).collect()
    assert sorted((r.stream_id, r.payload_type, r.seq) for r in kept) == [("s", 96, 1), ("s", 96, 2), ("s", 97, 0)]


def test_samples(spark):
    df = spark.createDataFrame([(b"\x01\x00\x00\x80\xff\x7f",), (b"",), (None,), (b"odd",)], "pcm binary")
    got = [r.samples for r in frames.pcm_to_float(df).collect()]
    assert got == [[1 / 32768, -1.0, 32767 / 32768], [], None, None]
    swapped = spark.createDataFrame([(b"\x12\x34\x56",), (b"",)], "pcm binary")
    assert [bytes(r.pcm) for r in frames.swap_pcm(swapped).collect()] == [b"\x34\x12\x00", b""]


def test_payload_and_filters(spark):
    df = spark.createDataFrame(
        [("http://cam", 3, datetime(2024, 1, 1, 0, 0, 1), b"\xff\xd8" + b"x" * 1200), ("http://cam", 4, datetime(2024, 1, 1), b"small")],
        "url string, frame_num bigint, ts timestamp, body binary",
    )
    first, second = [json.loads(r.payload) for r in frames.frame_payload(df).orderBy("frame_num").collect()]
    assert first["frame_number"] == 3 and first["source_url"] == "http://cam" and first["analysis"] == {"processed": True}
    assert first["timestamp"] == "2024-01-01T00:00:01Z" and first["frame_size_bytes"] == 1202
    assert len(first["thumbnail"]) == 1336 and second["thumbnail"] is None
    assert frames.jpeg_only(df).count() == 1
    acks = frames.ack_text(spark.createDataFrame([(b"state = A",), (b"\xff",)], "data binary")).collect()
    assert [r.ack for r in acks] == ["ACK: state = A", "decode error"]
