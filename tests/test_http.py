import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from millrace.functions.batches import BYTES_AT_ONCE
from millrace.operators import bodies, handlers, http
from millrace.plans import http as queries


def exchange(spark, headers, raw=None):
    return spark.createDataFrame(
        [(headers, raw)], "headers map<string,string>, raw_headers map<string,binary>"
    )


CONTEXT = {
    ":scheme": "https",
    ":authority": "example.com",
    ":method": "POST",
    ":path": "/api/data?key1=value1&key2=value2",
    "x-request-id": "req-1",
    "content-type": "application/json",
    "content-length": "10",
}


def test_request_context(spark):
    df = exchange(spark, CONTEXT, {"x-binary": b"\xff\xfe\xfd"})
    row = http.has_body(http.request_id(http.request_target(df))).first()
    assert (row.scheme, row.authority, row.method, row.path) == ("https", "example.com", "POST", "/api/data")
    assert row.query == {"key1": ["value1"], "key2": ["value2"]}
    assert row.request_id == "req-1" and row.has_body
    assert not any(name.startswith(":") for name in row.headers)
    text = http.stringify_headers(df).first().all_headers
    assert text["x-binary"] == "//79"
    assert http.header(df, "X-Request-Id", "other").first().other is None


@pytest.mark.parametrize(
    "path,plain,query",
    [
        ("/a", "/a", None),
        ("/a?", "/a", {}),
        ("/a?x=1?y=2", "/a", {"x": ["1"]}),
        ("/a?x=1&x=2&z", "/a", {"x": ["1", "2"], "z": [""]}),
        ("/a?x=a+b%21&=v", "/a", {"x": ["a b!"], "": ["v"]}),
        ("/a?x=%zz&y=1", "/a", None),
        ("/a?x=1;y=2", "/a", None),
        ("/a?x=b=c&&", "/a", {"x": ["b=c"]}),
    ],
)
def test_query_string(spark, path, plain, query):
    row = http.request_target(exchange(spark, {":path": path})).first()
    assert row.path == plain
    assert row.query == query


def test_missing_pseudo_headers_are_empty(spark):
    row = http.request_id(http.request_target(exchange(spark, {})), fallback="none").first()
    assert (row.scheme, row.path, row.query, row.request_id) == ("", "", None, "none")


@pytest.mark.parametrize(
    "headers,encoding,compressed,chunked",
    [
        ({}, "none", False, False),
        ({"content-encoding": "gzip"}, "gzip", True, False),
        ({"transfer-encoding": "gzip"}, "gzip", True, False),
        ({"transfer-encoding": "chunked"}, "none", False, True),
        ({"content-encoding": "br", "transfer-encoding": "chunked"}, "br", True, True),
    ],
)
def test_encodings(spark, headers, encoding, compressed, chunked):
    row = http.body_type(exchange(spark, headers)).first()
    assert (row.encoding, row.compressed, row.chunked) == (encoding, compressed, chunked)


@pytest.mark.parametrize("text,number", [("200", 200), ("200\n", 0), (" 200", 0), ("0", 0), ("0x7fff", 32767), ("0x8000", 0), ("-0x8000", 32768)])
def test_status_texts(spark, text, number):
    assert http.response_status(exchange(spark, {":status": text})).first().status == number


def test_unknown_phase_fails(spark):
    df = spark.createDataFrame([("999", {})], "kind string, headers map<string,string>")
    with pytest.raises(Exception, match="unknown request phase: 999"):
        http.tag_phase(df).collect()


def test_split_keeps_the_later_duplicate(spark):
    pairs = [("a", "1", None), ("a", "2", None), ("b", "", b"x"), ("b", None, b"y"), ("a", "", b"raw")]
    df = spark.createDataFrame([(pairs,)], "pairs array<struct<name:string,value:string,raw:binary>>")
    row = http.split_headers(df).first()
    assert row.headers == {"a": "2"}
    assert {k: bytes(v) for k, v in row.raw_headers.items()} == {"b": b"y", "a": b"raw"}


def chunks(spark, rows):
    return spark.createDataFrame(
        rows, "stream_id string, phase int, seq bigint, chunk binary, end_of_stream boolean"
    )


def test_size_limit(spark):
    df = chunks(
        spark,
        [
            ("s", 2, 0, b"existing", False),
            ("s", 2, 1, b"this exceeds the max limit", False),
            ("s", 2, 2, b"ok", True),
            ("t", 2, 0, b"a", False),
            ("t", 2, 1, b"much too long for it", True),
        ],
    )
    got = {
        r.stream_id: (bytes(r.body), r.complete, r.error)
        for r in bodies.assemble_bodies(df, max_size=10).collect()
    }
    assert got == {
        "s": (b"existingok", True, bodies.SIZE_ERROR),
        "t": (b"a", False, bodies.SIZE_ERROR),
    }


def test_size_limit_equals_a_walk(spark):
    import random

    rng = random.Random(5)
    rows, expected = [], {}
    for stream in range(40):
        size, body, refused, done = 0, b"", 0, False
        limit = 20
        count = rng.randint(1, 25)
        for seq in range(count):
            data = None if rng.random() < 0.1 else bytes([65 + seq % 26]) * rng.choice([0, 1, 2, 3, 5, 9, 14, 30])
            last = seq == count - 1
            rows.append((str(stream), 5, seq, data, last))
            if data and size + len(data) > limit:
                refused += 1
            else:
                body, size, done = body + (data or b""), size + len(data or b""), last
        expected[str(stream)] = (body, done, bool(refused))
    for segment_bytes in (4, 1000):
        made = bodies.assemble_bodies(chunks(spark, rows), 20, segment_bytes)
        got = {}
        for r in sorted(made.collect(), key=lambda r: r.segment):
            body = got.get(r.stream_id, (b"",))[0]
            assert len(body) == r.offset
            got[r.stream_id] = (body + bytes(r.body), r.complete, r.error is not None)
        assert got == expected


def test_running_body_is_cumulative(spark):
    df = chunks(spark, [("s", 2, i, c, i == 2) for i, c in enumerate([b"ab", None, b"c"])])
    seen = bodies.body_so_far(bodies.running_bodies(df), bodies.assemble_bodies(df))
    rows = seen.orderBy("seq").collect()
    assert [(r.body_end, bytes(r.body)) for r in rows] == [(2, b"ab"), (2, b"ab"), (3, b"abc")]


def test_segments_follow_the_body(spark):
    """Where its chunks stand in the exchange does not cut a body; its own size does."""
    df = chunks(spark, [("s", 5, 250 + i, b"0123456789", i == 19) for i in range(20)])
    (row,) = bodies.assemble_bodies(df).collect()
    assert (row.segments, row.body_size, bytes(row.body)) == (1, 200, b"0123456789" * 20)
    cut = bodies.assemble_bodies(df, segment_bytes=60).orderBy("segment").collect()
    assert [(r.segment, r.offset, len(r.body), r.segments) for r in cut] == [
        (0, 0, 60, 4), (1, 60, 60, 4), (2, 120, 60, 4), (3, 180, 20, 4),
    ]
    seen = bodies.assemble_bodies(df, segment_bytes=60).withColumn("has_body", F.lit(True)).withColumn("seq", F.lit(0))
    with pytest.raises(Exception, match="several segments"):
        handlers.apply_operator(seen, lambda c, e: b"x", "postprocessor").collect()


def test_inflated_pieces_are_bounded(spark):
    data = gzip.compress(b"a" * 5_000_000 + b"b", mtime=0)
    rows = [("s", 5, i, data[at : at + 1000], at + 1000 >= len(data)) for i, at in enumerate(range(0, len(data), 1000))]
    whole = bodies.assemble_bodies(chunks(spark, rows), segment_bytes=2000).withColumns(
        {"encoding": F.lit("gzip"), "compressed": F.lit(True)}
    )
    found = bodies.decode_bodies(whole, piece_bytes=100_000).orderBy("segment", "piece").collect()
    assert max(len(r.body) for r in found) <= 100_000 and len(found) >= 50
    assert b"".join(bytes(r.body) for r in found) == b"a" * 5_000_000 + b"b"
    assert bodies.gunzip(data, 1000) == (None, "large")
    assert bodies.gunzip(data)[1] == "good"
    with pytest.raises(Exception, match="inflates to more"):
        bodies.decode_bodies(whole.drop("segments", "segment").limit(1).withColumn("body", F.lit(data)), 1000).collect()


class _Handed:
    """A table that hands back the function it is given."""

    schema = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("phase", T.IntegerType())])
    select = repartition = sortWithinPartitions = lambda self, *_: self

    def mapInArrow(self, fn, schema):
        return fn


def test_inflated_bodies_leave_python_a_few_at_a_time(spark):
    """40 MB inflated out of one small batch never stand in one."""
    texts = [b"%03d" % k * 350_000 for k in range(40)]
    packed = pa.array([gzip.compress(t) for t in texts], pa.binary())
    keys = [pa.array([f"s{k:02}" for k in range(40)]), pa.array([2] * 40, pa.int32()), pa.array([0] * 40, pa.int64())]
    batch = pa.RecordBatch.from_arrays([*keys, packed], ["stream_id", "phase", "segment", "body"])
    most = BYTES_AT_ONCE + len(texts[0]) + 4096
    pieces = list(bodies.inflate_segments(_Handed())(iter([batch])))
    assert [b for p in pieces for b in p["body"].to_pylist()] == texts and all(v for p in pieces for v in p["ok"].to_pylist())
    assert max(p.nbytes for p in pieces) <= most
    pieces = list(bodies._inflate(1 << 20 << 3).func(iter([packed])))
    assert [r["body"] for p in pieces for r in p.to_pylist()] == texts
    assert max(p.nbytes for p in pieces) <= most


def test_packed_texts_leave_python_a_few_at_a_time():
    rng = random.Random(59)
    texts = ["".join(map(chr, rng.choices(range(32, 1 << 15), k=400_000))) for _ in range(16)]
    pieces = list(queries._pack.func(iter([pa.array(texts)])))
    packed = [b for p in pieces for b in p.to_pylist()]
    assert packed == [gzip.compress(t.encode(), mtime=0) for t in texts] and len(pieces) > 1
    assert max(p.nbytes for p in pieces) <= BYTES_AT_ONCE + max(map(len, packed)) + 4096


def test_decompression_outcomes(spark):
    whole = gzip.compress(b"test")
    cases = [
        ("plain", b"test", True, "none", False, b"test", None),
        ("incomplete", whole, False, "gzip", True, whole, bodies.INCOMPLETE_ERROR),
        ("good", whole, True, "gzip", True, b"test", None),
        ("two members", whole + whole, True, "gzip", True, b"testtest", None),
        ("truncated", whole[:-3], True, "gzip", True, whole[:-3], bodies.GZIP_ERROR),
        ("trailing", whole + b"x", True, "gzip", True, whole + b"x", bodies.GZIP_ERROR),
        ("empty", b"", True, "gzip", True, b"", bodies.GZIP_ERROR),
        ("bad", b"not gzipped", True, "gzip", True, b"not gzipped", bodies.GZIP_ERROR),
        ("other", b"test", True, "br", True, b"test", bodies.ENCODING_ERROR),
    ]
    df = spark.createDataFrame(
        [c[:5] for c in cases], "name string, body binary, complete boolean, encoding string, compressed boolean"
    )
    got = {r.name: (bytes(r.body), r.decode_error, r.decompressed) for r in bodies.decode_bodies(df).collect()}
    assert got == {c[0]: (c[5], c[6], c[6] is None) for c in cases}


def test_bad_gzip_in_segments_keeps_its_bytes(spark):
    data = gzip.compress(bytes(range(256)) * 8, mtime=0)
    broken = data[:40] + b"\0\0\0" + data[43:]
    rows = []
    for name, body in (("good", data), ("bad", broken)):
        pieces = [body[i : i + 16] for i in range(0, len(body), 16)]
        rows += [(name, 2, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    made = bodies.assemble_bodies(chunks(spark, rows), segment_bytes=32).withColumns(
        {"encoding": F.lit("gzip"), "compressed": F.lit(True)}
    )
    found = {}
    for r in sorted(bodies.decode_bodies(made).collect(), key=lambda r: (r.segment, r.piece)):
        found.setdefault(r.stream_id, [b"", r.decode_error])[0] += bytes(r.body)
    assert found == {"good": [bytes(range(256)) * 8, None], "bad": [broken, bodies.GZIP_ERROR]}


def phase_rows(spark, body=b"test body"):
    return spark.createDataFrame(
        [("s", i, p, h, body if p in (2, 5) else None, True) for i, (p, h) in enumerate([(1, {}), (2, None), (4, {}), (5, None)])],
        "stream_id string, seq bigint, phase int, headers map<string,string>, body binary, has_body boolean",
    )


def decisions(df):
    return {r.phase: (r.decision, r.immediate_status, None if r.new_body is None else bytes(r.new_body)) for r in df.collect()}


def test_handler_replaces_bodies(spark):
    def handler(context, event):
        return b"processed body"

    got = decisions(handlers.apply_operator(phase_rows(spark), handler, "preprocessor"))
    assert got[2] == ("replace", None, b"processed body") and got[5][0] == "continue"
    got = decisions(handlers.apply_operator(phase_rows(spark), handler, "postprocessor"))
    assert got[5] == ("replace", None, b"processed body") and got[2][0] == "continue"
    got = decisions(handlers.apply_operator(phase_rows(spark), handler, "observeprocessor"))
    assert {d for d, _, _ in got.values()} == {"continue"}


def test_empty_answer_and_failure_leave_the_body(spark):
    got = decisions(handlers.apply_operator(phase_rows(spark), lambda c, e: b"", "wrapprocessor"))
    assert got[2] == ("continue", None, b"test body") and got[5] == ("continue", None, b"test body")
    answered = phase_rows(spark).withColumns(
        {"status": F.lit(403), "response_body": F.lit(b"no"), "error": F.lit("worker lost")}
    )
    got = decisions(http.apply_response(answered, "preprocessor"))
    assert got[2] == ("continue", None, b"test body")


def test_immediate_response(spark):
    def handler(context, event):
        return context.Response(body="error message", status_code=403, headers={"x-error": "1"})

    got = decisions(handlers.apply_operator(phase_rows(spark), handler, "preprocessor"))
    assert got[2] == ("immediate", 403, b"test body")
    # the response phase of a wrapping operator ignores the status
    got = decisions(handlers.apply_operator(phase_rows(spark), handler, "wrapprocessor"))
    assert got[5] == ("replace", None, b"error message")


def test_bodyless_request_is_called_on_its_headers(spark):
    df = phase_rows(spark).withColumn("has_body", F.lit(False))
    got = decisions(handlers.apply_operator(df, lambda c, e: (401, "no"), "preprocessor"))
    assert got[1][:2] == ("immediate", 401)


def test_status_header_may_be_a_number(spark):
    df = spark.sql(
        """select id, 200 as status, map('X-Processing-Status', parse_json(v)) as headers
           from values (1, '403.9'), (2, '"404"'), (3, '"4x"'), (4, 'true') as t(id, v)"""
    )
    got = {r.id: (r.status, len(r.headers)) for r in http.resolve_status(df).select("id", "status", "headers").withColumn("headers", F.map_keys("headers")).collect()}
    assert got == {1: (403, 0), 2: (404, 0), 3: (0, 0), 4: (0, 0)}


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown operator type"):
        handlers.apply_operator(phase_rows(spark), lambda c, e: "", "sideprocessor")


def test_annotations_are_off_by_default(spark):
    seen = spark.createDataFrame(
        [("s", 0, 4, True), ("t", 0, 4, False), ("t", 1, 5, True)],
        "stream_id string, seq bigint, phase int, end_of_stream boolean",
    )
    assert http.annotate_headers(seen).count() == 0
    spent = spark.createDataFrame([("s", 7), ("t", 9)], "stream_id string, duration_ns bigint")
    made = http.annotate_headers(seen, "op", spent).collect()
    assert sorted((r.stream_id, r.phase, r.name, bytes(r.raw_value)) for r in made) == [
        ("s", 4, "x-extproc-duration-ns", b"7"),
        ("s", 4, "x-extproc-names", b"op"),
        ("t", 4, "x-extproc-names", b"op"),
        ("t", 5, "x-extproc-duration-ns", b"9"),
    ]
