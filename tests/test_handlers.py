from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.batches import BYTES_AT_ONCE
from millrace.operators import delivery, events, handlers, metrics
from millrace.sources.captures import job_events

AT = datetime(2024, 1, 1)


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "seq bigint, body binary")


def test_answers_leave_python_a_few_at_a_time():
    """Answers to one batch of 40 MB never stand in one; rows that are not handled keep their places."""
    sent = [bytes([k]) * (1 << 20) for k in range(40)]
    events = pa.array([{"seq": k, "body": b} for k, b in enumerate(sent)], pa.struct([("seq", pa.int64()), ("body", pa.binary())]))
    called = pa.array([k % 8 != 3 for k in range(40)])
    calls = handlers._calls(lambda context, event: event.body, None).func
    pieces = list(calls(iter([(events, called)])))
    got = [a and a["responses"][0]["body"] for p in pieces for a in p.to_pylist()]
    assert got == [b if k % 8 != 3 else None for k, b in enumerate(sent)]
    assert max(p.nbytes for p in pieces) <= BYTES_AT_ONCE + (1 << 20) + 4096


def test_text_and_json_echo(spark):
    greeted = handlers.apply_handler(bodies(spark, "John"), lambda c, e: f"Hello, {e.body.decode()}!")
    row = greeted.first()
    assert (bytes(row.response_body), row.status, row.response_type) == (b"Hello, John!", 200, "text/plain")
    assert row.duration > 0

    def echo(context, event):
        import json

        return {"body": json.loads(event.body)}

    row = handlers.apply_handler(bodies(spark, '{"id": 0, "country": "Italy"}'), echo).first()
    assert bytes(row.response_body) == b'{"body": {"id": 0, "country": "Italy"}}'
    assert row.response_type == "application/json"


def test_exception_becomes_500(spark):
    def fail(context, event):
        raise KeyError("gone")

    row = handlers.apply_handler(bodies(spark, "x"), fail).first()
    assert row.status == 500 and row.response_type == "text/plain"
    assert bytes(row.response_body).startswith(b"Exception caught in handler - \"'gone'\": Traceback")


def test_init_runs_once_per_task(spark):
    def init(context):
        context.user_data.count = 0

    def count(context, event):
        context.user_data.count += 1
        return str(context.user_data.count)

    rows = handlers.apply_handler(bodies(spark, *"abcdef").coalesce(1), count, init).orderBy("seq").collect()
    assert [bytes(r.response_body) for r in rows] == [b"1", b"2", b"3", b"4", b"5", b"6"]


def test_async_handler_and_injected_arguments(spark):
    async def later(context, event):
        return event.body

    assert bytes(handlers.apply_handler(bodies(spark, "x"), later).first().response_body) == b"x"

    def both(event, context):
        return context.Response(body=event.body * 2, status_code=202)

    row = handlers.apply_serve(bodies(spark, "ab"), both).first()
    assert (bytes(row.response_body), row.status) == (b"abab", 202)


def test_batched_answers(spark):
    answered = handlers.apply_batched(bodies(spark, "a b", "c", ""), lambda c, e: e.body.decode().split())
    rows = handlers.flatten_batched(answered).orderBy("seq", "response_pos").collect()
    assert [(r.seq, r.response_pos, r.response_body and bytes(r.response_body)) for r in rows] == [
        (0, 0, b"a"), (0, 1, b"b"), (1, 0, b"c"),
    ]


def test_answers_as_they_come(spark):
    def words(context, event):
        for word in event.body.decode().split():
            if word == "!":
                raise ValueError("no more")
            yield word

    table = bodies(spark, "a b", "c ! d", "").withColumn("status", F.lit("own"))
    with pytest.raises(Exception, match="status"):
        handlers.apply_answers(table, words).select("status").collect()
    rows = handlers.apply_answers(table.drop("status"), words).orderBy("seq", "response_pos").collect()
    assert [(r.seq, r.response_pos, r.status, bytes(r.response_body)[:9]) for r in rows] == [
        (0, 0, 200, b"a"), (0, 1, 200, b"b"), (1, 0, 200, b"c"), (1, 1, 500, b"Exception"),
    ]
    listed = handlers.apply_answers(bodies(spark, "x"), lambda c, e: [c.Response(body=b"1", status_code=202, headers={"k": "v"}), "2"])
    assert [(r.status, r.response_headers, bytes(r.response_body)) for r in listed.collect()] == [(202, {"k": "v"}, b"1"), (200, {}, b"2")]


def test_a_million_answers_are_never_held_together(spark):
    def many(context, event):
        import gc

        live = 0
        for k in range(1_000_000):
            if k % 100_000 == 50_000:
                live = max(live, sum(isinstance(x, dict) and "content_type" in x for x in gc.get_objects()))
            yield f"{k} {live}"

    made = handlers.apply_answers(bodies(spark, "go"), many)
    row = made.select("response_pos", F.split(F.col("response_body").cast("string"), " ").cast("array<int>").alias("x")).agg(
        F.count("*").alias("n"), F.max("response_pos").alias("last"), F.sum(F.col("x")[0]).alias("total"), F.max(F.col("x")[1]).alias("live")
    ).first()
    assert (row.n, row.last, row.total) == (1_000_000, 999_999, 499_999_500_000) and row.live <= handlers.ANSWERS_AT_ONCE


def test_status_table(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert handlers.stored_statuses(spark, path).count() == 0
    tables, save = {"numbers": spark.range(3)}, lambda name, df: df
    first = {"status_path": path, "run_id": "a/b c"}
    _, done = handlers.run_job(lambda numbers: numbers, tables, save, **first)

    def fail(numbers):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError) as caught:
        handlers.run_job(fail, tables, save, **first)
    assert caught.value.status["state"] == "COMPLETED"  # what is stored wins
    with pytest.raises(RuntimeError):
        handlers.run_job(fail, tables, save, status_path=path, run_id="other")
    rows = {r.run_id: r for r in handlers.stored_statuses(spark, path).collect()}
    assert {k: r.state for k, r in rows.items()} == {"a/b c": "COMPLETED", "other": "ERROR"}
    assert rows["a/b c"].outputs == done["outputs"] and rows["other"].error == "no"
    assert sorted(x.name for x in (tmp_path / "runs").iterdir() if not x.name.startswith(".")) == sorted(
        x.name for x in (tmp_path / "runs").glob("*.parquet")
    )


def test_job_run(spark):
    table = spark.range(5)
    saved = {}

    def work(numbers, factor):
        return {"scaled": numbers.select((F.col("id") * factor).alias("id"))}

    def save(name, df):
        saved[name] = spark.createDataFrame(df.collect(), df.schema)
        return saved[name]

    outputs, status = handlers.run_job(work, {"numbers": table}, save, {"factor": 3, "other": 1})
    assert outputs["scaled"].agg(F.sum("id")).first()[0] == 30 and "scaled" in saved
    assert status["state"] == "COMPLETED" and status["ended"] >= status["started"]
    _, status = handlers.run_job(work, {"numbers": table}, save, {"factor": 3}, stored_status={"state": "STOPPED"})
    assert status["state"] == "STOPPED"

    def late(numbers):
        return numbers.select(F.raise_error(F.lit("too late")))

    with pytest.raises(Exception, match="too late") as caught:
        handlers.run_job(late, {"numbers": table}, save)
    assert caught.value.status["state"] == "ERROR" and "outputs" not in caught.value.status

    def fail(numbers):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError) as caught:
        handlers.run_job(fail, {"numbers": table}, save)
    assert caught.value.status["state"] == "ERROR" and "ended" in caught.value.status
    row = handlers.status_row(spark, caught.value.status).first()
    assert (row.run_id, row.state, row.error) == ("job", "ERROR", "no") and row.ended >= row.started


def test_observed_attributes_feed_the_metrics(spark):
    df = spark.createDataFrame(
        [
            (
                "GET", "http://Example.com/path;p?query=value", "/path",
                {"User-Agent": "probe", "X-Forwarded-For": " 1.2.3.4 , 5.6.7.8", "X-Forwarded-Port": "x"}, b"x" * 100,
            )
        ],
        "method string, url string, path string, headers map<string,string>, body binary",
    )
    seen = handlers.observe(df, lambda c, e: "four", content=True)
    a = seen.first().attributes
    assert a["http.request.method"] == "GET" and a["url.full"] == "http://Example.com/path;p?query=value"
    assert a["server.address"] == "example.com" and a["url.path"] == "/path" and a["url.query"] == "query=value"
    assert a["user_agent.original"] == "probe" and a["client.address"] == a["network.peer.address"] == "1.2.3.4"
    assert a["http.request.body.size"] == "100" and a["http.response.body.size"] == "4"
    assert a["http.response.body.value"] == "four" and a["http.response.status_code"] == "200"
    assert "network.peer.port" not in a and "server.port" not in a
    told = metrics.duration_histogram(metrics.dimensions(seen)).first()
    assert told.method == "GET" and told.status == 200 and told["count"] == 1 and sum(told.buckets) == 1


def test_duration_buckets_include_their_bound(spark):
    df = spark.createDataFrame([(d,) for d in (0.005, 0.0051, 1.0, 10.0, 10.1)], "duration double")
    told = metrics.duration_histogram(df, dims=[]).first()
    assert told.buckets[0] == 1 and told.buckets[1] == 1 and told.buckets[9] == 1
    assert told.buckets[13] == 1 and told.buckets[14] == 1 and len(told.buckets) == 15


def test_active_requests_over_slices(spark):
    rows = [("GET", AT + timedelta(seconds=s), AT + timedelta(seconds=e)) for s, e in ((0, 100), (10, 70), (70, 200))]
    df = spark.createDataFrame(rows, "method string, start timestamp, end timestamp")
    told = metrics.active_requests(df, dims=["method"]).orderBy("ts").collect()
    # at 70 one ends and one starts
    assert [((r.ts - AT).seconds, r.active) for r in told] == [(0, 1), (10, 2), (70, 2), (100, 1), (200, 0)]


def test_delivery(spark):
    df = spark.createDataFrame([(1, b"test webhook data"), (2, None)], "id int, payload binary")

    def send(payload, headers):
        assert headers == {"Authorization": "token", "Content-Type": "application/octet-stream"}
        return 200 if payload else 404

    rows = delivery.deliver(df, send, 1, 0, headers={"Authorization": "token"}).orderBy("id").collect()
    assert [(r.delivered, r.attempts, r.last_status, r.error) for r in rows] == [
        (True, 1, 200, None),
        (False, 2, 404, "webhook failed after 2 attempts: webhook returned status 404"),
    ]
    text = delivery.deliver(df.filter("id = 1"), lambda p, h: 200 if isinstance(p, str) else 500, 0, message_type="text")
    assert text.first().delivered
    with pytest.raises(ValueError, match="invalid message type"):
        delivery.deliver(df, send, message_type="invalid")


def test_stream_delivery_sends_a_finished_batch_once(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(payload, headers):
        import uuid

        (sent / uuid.uuid4().hex).write_bytes(payload)
        return 200

    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(i, b"%d" % i) for i in range(5)], "id int, payload binary").write.parquet(path)
    for attempt in ("first", "again"):
        # a new checkpoint gives the same batch again
        stream = spark.readStream.schema("id int, payload binary").parquet(path)
        writer = delivery.stream_deliveries(stream, send, log, str(tmp_path / attempt), retry_delay=0)
        writer.trigger(availableNow=True).start().awaitTermination()
    assert len(list(sent.iterdir())) == 5
    assert spark.read.parquet(log).filter("delivered").count() == 5


def test_outcomes(spark):
    rows = [(1, 1, 500, "a"), (1, 2, 201, None), (1, 3, 500, "late"), (2, 1, None, "x"), (2, 2, 503, "y"), (3, 5, 200, None), (3, 1, 500, "z")]
    df = spark.createDataFrame(rows, "delivery_id bigint, attempt int, status int, error string")
    got = {r.delivery_id: tuple(r)[1:] for r in delivery.delivery_outcomes(df).collect()}
    assert got == {1: (True, 2, None), 2: (False, 2, "y"), 3: (False, 1, "z")}


def test_routing(spark, tmp_path):
    df = spark.createDataFrame([(1, "webhook"), (2, "mjpeg"), (3, None)], "id int, sink_kind string")
    written = {}
    routes = {kind: (lambda rows, kind=kind: written.__setitem__(kind, [r.id for r in rows.collect()])) for kind in ("webhook", "mjpeg")}
    delivery.route_outputs(df, routes)
    assert written == {"webhook": [1], "mjpeg": [2]}
    with pytest.raises(ValueError, match="sink factory not found: mjpeg"):
        delivery.route_outputs(df, {"webhook": print})
    with pytest.raises(Exception, match="sink factory not found: mjpeg"):
        delivery.checked_kinds(df, ["webhook"]).collect()
    delivery.save_outputs(df, str(tmp_path / "saved"), ["webhook", "mjpeg"])
    saved = spark.read.parquet(str(tmp_path / "saved")).collect()
    assert sorted((r.id, r.sink_kind) for r in saved) == [(1, "webhook"), (2, "mjpeg")]
    # the same on a stream
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    delivery.stream_outputs(stream, {"webhook": write, "mjpeg": lambda rows, batch: None}, str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert [r.id for r in spark.read.parquet(out).collect()] == [1]


def test_routed_stream_is_written_once(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame([(k, ["webhook", "mjpeg", None][k % 3]) for k in range(30)], "id int, sink_kind string")
    for k in range(3):
        df.filter(F.floor(F.col("id") % 10 / 4) == k).coalesce(1).write.mode("append").parquet(path)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = lambda kinds: delivery.save_stream(read(), out, kinds, checkpoint).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="sink factory not found: mjpeg"):
        run(["webhook"])
    assert not list((tmp_path / "out").rglob("*.parquet"))  # nothing of the failed batch is there
    run(["webhook", "mjpeg"])
    saved = lambda: sorted((r.id, r.sink_kind) for r in spark.read.parquet(out).collect())
    expected = sorted((r.id, r.sink_kind) for r in df.filter("sink_kind is not null").collect())
    assert saved() == expected and spark.read.parquet(out).select("batch").distinct().count() == 3
    # a batch that is given again replaces what it wrote
    for name in ("commits/2", "commits/.2.crc"):
        (tmp_path / "cp" / name).unlink(missing_ok=True)
    run(["webhook", "mjpeg"])
    assert saved() == expected


def test_fan_out(spark):
    frames = spark.createDataFrame([("s", i, AT + timedelta(minutes=10 * i)) for i in range(30)] + [("t", 99, AT)], "stream_id string, seq bigint, ts timestamp")
    clients = spark.createDataFrame(
        [
            ("a", "s", AT + timedelta(minutes=20), AT + timedelta(minutes=100)),
            ("b", "s", AT + timedelta(minutes=265), None),
            ("c", "u", AT, None),
            ("d", "s", AT + timedelta(days=9), None),
        ],
        "client_id string, stream_id string, connect_ts timestamp, disconnect_ts timestamp",
    )
    got = sorted((r.client_id, r.seq) for r in delivery.fan_out(frames, clients).collect())
    assert got == [("a", i) for i in range(2, 10)] + [("b", i) for i in range(27, 30)]


def test_job_events_and_unknown_triggers(spark):
    rows = [("run", 0, AT, "POST", "/test/path", {"a": "1", "b": "2"}, {}, b"body")]
    jobs = events.normalize_events(job_events(spark, rows), "job")
    row = jobs.first()
    assert (row.method, row.path, row.url, row.content_type, row.headers) == ("POST", "/test/path", "", "", {"a": "1", "b": "2"})
    assert row["class"] == "async" and row.trigger == "job"
    assert events.unrouted(jobs, ["http"]).count() == 1 and events.unrouted(jobs, ["job"]).count() == 0
    with pytest.raises(ValueError, match="unknown trigger"):
        events.normalize_events(jobs, "cron")


def test_job_number_texts(spark):
    df = spark.sql("""select parse_json('{"a": 1e21, "b": 1.50, "c": 1e-7, "d": null, "e": [1], "f": 12345678.25}') as fields""")
    got = [events.typed_field(df, key, "string", "job").first().field for key in "abcdef"]
    assert got == ["1000000000000000000000", "1.5", "0.0000001", "", "", "12345678.25"]
    with pytest.raises(ValueError):
        events.typed_field(df, "a", "int", "job")


def test_fields_of_an_envelope_are_texts(spark):
    df = spark.createDataFrame([({"n": "7", "w": "x7", "l": "7\n"},)], "fields map<string,string>")
    read = lambda key, as_, trigger: events.typed_field(df, key, as_, trigger).first().field
    assert read("n", "string", "job") == "7" and read("n", "int", "websocket") == 7
    assert read("n", "int", "mjpeg") == 0 and read("w", "int", "rtsp") is None
    assert read("l", "int", "rtsp") is None and read("none", "int", "rtsp") == 0


def test_addresses(spark):
    from millrace.functions.targets import url_parts

    df = spark.createDataFrame(
        [("http://u:p@Host:80/a/b;c?d=e#f",), ("HTTPS://[::1]:8443/x",), ("//h/p",), ("/only/path?q",)], "url string"
    ).select(url_parts(F.col("url")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [
        ("http", "host", 80, "/a/b", "d=e"),
        ("https", "::1", 8443, "/x", ""),
        ("", "h", None, "/p", ""),
        ("", "", None, "/only/path", "q"),
    ]


def test_job_status_and_stats(spark):
    df = spark.createDataFrame(
        [("r1", "job", 200, None, None, False), ("r1", "job", 201, None, None, False), ("r2", "job", None, None, None, None), ("r3", "mjpeg", 200, "s", None, False), ("r4", "mjpeg", 200, None, "p", True)],
        "run_id string, trigger string, status int, submit_error string, process_error string, timed_out boolean",
    )
    assert {r.run_id: r.failed for r in metrics.job_status(df).collect()} == {"r1": True, "r2": False, "r3": True, "r4": True}
    got = {r.trigger: tuple(r)[1:] for r in metrics.invocation_stats(df).collect()}
    assert got == {"job": (3, 3, 0, 0, 0), "mjpeg": (2, 0, 1, 0, 1)}
