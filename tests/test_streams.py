import hashlib
import pickle
import random
import tracemalloc
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from millrace.envelope import MESSAGE
from millrace.operators.joins import correlate, correlate_streams
from millrace.sources.captures import load_messages
from millrace.operators import frames, metrics
from millrace.streaming import at_rest, counters, rolling, windows
from millrace.streaming.at_rest import run_table_as_stream, run_to_table
from millrace.streaming.exchanges import exchange_state, with_bodies
from tests.oracle import compare, connect

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def messages(spark, rows):
    """Rows (stream, seq, seconds, data)."""
    return spark.createDataFrame([(s, s, q, at(t), d) for s, q, t, d in rows], MESSAGE)


def as_stream(spark, df, tmp_path, files=3):
    """The same rows as a file stream, in time order, a file a batch."""
    path = str(tmp_path / "in")
    ordered = df.orderBy("ts", "seq").toPandas()
    size = -(-len(ordered) // files)
    for i in range(files):
        part = ordered.iloc[i * size : (i + 1) * size]
        if len(part):
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def fold(rows, chunk, limit, trim, interval):
    """The buffer as the ticker sees it, message after message."""
    out = []
    for stream in sorted({r[0] for r in rows}):
        waiting, buffer, fresh, tick = b"", b"", 0, None
        mine = sorted((r for r in rows if r[0] == stream), key=lambda r: r[1])
        for _, _, t, data in mine + [(stream, None, float("inf"), None)]:
            now = None if t == float("inf") else int(t // interval)
            if tick is not None and now != tick and fresh >= chunk:
                out.append((stream, tick, buffer))
                fresh = 0
            if now is None:
                break
            tick = now
            waiting += data or b""
            while len(waiting) >= chunk:
                buffer, waiting = buffer + waiting[:chunk], waiting[chunk:]
                if len(buffer) > limit:
                    buffer = buffer[trim:]
                fresh += chunk
    return sorted(out)


def shown(df, interval):
    rows = df.select("stream_id", F.unix_micros("tick").alias("us"), "body").collect()
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    return sorted((r.stream_id, r.us // 1_000_000 // interval - 1 - base // interval, bytes(r.body)) for r in rows)


@pytest.mark.parametrize(
    "pushes,settings,expected",
    [
        ([(0, b"abcd")], (4, 32, 4), [b"abcd"]),
        ([(0, b"ab")], (4, 32, 4), []),
        ([(0, b"abcd"), (0, b"efgh"), (10, b"ijkl")], (4, 8, 4), [b"abcdefgh", b"efghijkl"]),
        ([(0, b"abcdefgh")], (4, 32, 4), [b"abcdefgh"]),
    ],
)
def test_rolling_vectors(spark, pushes, settings, expected):
    df = messages(spark, [("s", i, t, d) for i, (t, d) in enumerate(pushes)])
    rows = rolling.rolling_snapshots(df, *settings, "2 seconds").orderBy("tick").collect()
    assert [bytes(r.body) for r in rows] == expected


def random_rows(rng, streams=3, count=40):
    rows = []
    for s in range(streams):
        t = 0.0
        for i in range(count):
            t = round(t + rng.choice([0, 0, 0.4, 1.1, 3, 9]), 1)
            data = bytes(rng.randrange(97, 123) for _ in range(rng.choice([0, 1, 2, 5, 11, 30])))
            rows.append((f"s{s}", i, t, data))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    chunk = rng.randint(1, 9)
    limit = rng.randint(chunk, 40)
    trim = rng.randint(1, limit)
    rows = random_rows(rng)
    made = rolling.rolling_snapshots(messages(spark, rows), chunk, limit, trim, "2 seconds")
    assert shown(made, 2) == fold(rows, chunk, limit, trim, 2), (chunk, limit, trim)


def test_chunk_larger_than_the_limit(spark):
    rows = random_rows(random.Random(11))
    for trim in (7, 3):
        made = rolling.rolling_snapshots(messages(spark, rows), 7, 5, trim, "2 seconds")
        assert shown(made, 2) == fold(rows, 7, 5, trim, 2)


def test_trim_beyond_the_buffer(spark):
    with pytest.raises(ValueError, match="trim_bytes"):
        rolling.rolling_snapshots(messages(spark, []), 4, 8, 9)


def test_rolling_stream_equals_batch(spark, tmp_path):
    rows = random_rows(random.Random(3))
    # a late message of every stream closes what came before
    end = max(t for _, _, t, _ in rows)
    rows += [(s, 10_000, end + 600, b"") for s in ("s0", "s1", "s2")]
    df = messages(spark, rows)
    ticks = run_to_table(rolling.stream_tick_bytes(as_stream(spark, df, tmp_path), "2 seconds"), "rolling")
    got = rolling.snapshots_of_ticks(ticks, df, 5, 20, 12, "2 seconds")
    assert shown(got, 2) == fold(rows, 5, 20, 12, 2)


def test_snapshots_of_a_running_stream(spark, tmp_path):
    """The stream itself writes the buffers, and keeps no more of a stream than its buffer."""
    rows = random_rows(random.Random(5))
    end = max(t for _, _, t, _ in rows)
    rows += [(s, 10_000, end + 600, b"") for s in ("s0", "s1", "s2")]
    df = messages(spark, rows)
    for settings in ((5, 20, 12), (7, 5, 3)):
        got = run_to_table(rolling.live_snapshots(as_stream(spark, df, tmp_path / f"in{settings[0]}", 6), *settings, "2 seconds", "1 second"), "live")
        assert shown(got, 2) == fold(rows, *settings, 2)
        # a tick is given out by the micro-batch after which the watermark has passed it
        assert got.schema.simpleString() == rolling.rolling_snapshots(df, *settings, "2 seconds").schema.simpleString()
    with pytest.raises(ValueError, match="milliseconds"):
        rolling.live_snapshots(as_stream(spark, df, tmp_path / "x"), 5, 20, 12, "2500 microseconds")


class Stored:
    """States of one key, kept in files."""

    def __init__(self, folder):
        self.folder, self.timers = folder, set()

    def getValueState(self, name, schema):
        kept = Stored(self.folder / name)
        kept.exists = (self.folder / name / "()").exists
        kept.get, kept.update, kept.clear = (lambda: kept.getValue(())), (lambda v: kept.updateValue((), v)), (lambda: kept.removeKey(()))
        return kept

    def getMapState(self, name, key, value):
        return Stored(self.folder / name)

    def registerTimer(self, at):
        self.timers.add(at)

    def updateValue(self, key, value):
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / str(key)).write_bytes(pickle.dumps(value))

    def getValue(self, key):
        return pickle.loads((self.folder / str(key)).read_bytes())

    def removeKey(self, key):
        (self.folder / str(key)).unlink(missing_ok=True)


def test_snapshots_of_a_large_micro_batch_in_little_memory(tmp_path):
    """Neither the messages of a stream in one micro-batch nor its snapshots are held at once."""
    rng, n, size = random.Random(71), 1500, 32 << 10
    body = lambda k: bytes([k % 251]) * (size - k % 7)
    when = list(range(n))
    rng.shuffle(when)  # any order within the micro-batch

    def frames():
        for at in range(0, n, 50):
            part = when[at : at + 50]
            yield pd.DataFrame({"stream_id": "s", "tick": [(k // 3 + 1) * 2000 for k in part], "seq": part, "data": [body(k) for k in part]})

    store = Stored(tmp_path)
    ring = rolling._Ring(20_000, 200_000, 120_000)
    ring.init(store)
    due = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    got, parts = [], 0
    tracemalloc.start()
    assert list(ring.handleInputRows(("s",), frames(), due)) == []
    for timer in sorted(store.timers):
        for made in ring.handleExpiredTimer(("s",), due, None):
            parts += 1
            got += [(r.stream_id, r.tick_ms // 2000 - 1, hashlib.md5(r.body).digest()) for r in made.itertuples()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 49 MB of messages, 100 MB of snapshots
    assert peak < 40 << 20 and parts > 5
    expected = fold([("s", k, k // 3 * 2, body(k)) for k in range(n)], 20_000, 200_000, 120_000, 2)
    assert got == [(s, tick, hashlib.md5(b).digest()) for s, tick, b in expected]
    assert not [*(tmp_path / "waiting").iterdir()] and not (tmp_path / "open" / "()").exists()
    kept = sum(len(pickle.loads(p.read_bytes())[0]) for p in (tmp_path / "blocks").iterdir())
    assert kept < 200_000 + 2 * 20_000


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_snapshots_of_streams_and_messages_without_name_or_number(spark, tmp_path, kind):
    """A stream without a name is one like any other; a message without a number is the last of its tick; 2^53 + 1 is no double."""
    big = (1 << 53) + 1
    rows = [
        (None, big, 0, b"bb"), (None, big - 1, 0, b"aa"), (None, None, 1, b"cc"), (7, None, 0, b"zz"), (7, 5, 0, b"yy"),
        (None, 1, 2, b"dd"), (7, 3, 2, None), (None, None, 600, None),
    ]
    df = spark.createDataFrame([(s, q, at(t), d) for s, q, t, d in rows], "stream_id bigint, seq bigint, ts timestamp, data binary")
    df = df.withColumn("stream_id", F.col("stream_id").cast(kind))
    got = run_table_as_stream(
        df, lambda s: rolling.live_snapshots(s, 2, 8, 2, "2 seconds", "1 second"), "odd", ("2 seconds", "1 second"),
        settings=at_rest.HEAVY_STATE, bytes_a_core=at_rest.BYTES_A_CORE,
    )
    assert dict(got.dtypes)["stream_id"] == kind
    assert sorted((str(r.stream_id), r.buffer_end, bytes(r.body)) for r in got.collect()) == [
        ("7", 4, b"yyzz"), ("None", 6, b"aabbcc"), ("None", 8, b"aabbccdd"),
    ]


def test_a_byte_limited_stream_takes_all_files_in_small_batches(spark, tmp_path):
    rows = [(f"s{i % 3}", i, i * 7, b"x" * (i % 9)) for i in range(400)]
    df = messages(spark, rows)
    path, schema = at_rest.stage(df, "few", 30_000_000, files=12)
    batches = []
    query = (
        at_rest.read_staged(spark, path, schema, bytes_a_core=1)
        .writeStream.foreachBatch(lambda part, k: batches.append(part.count()))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(batches) == 401 and len(batches) >= 12 and max(batches) < 100


def scattered(spark, df, tmp_path, files=40):
    """The same rows in many files, in no order."""
    path = str(tmp_path / "scattered")
    df.repartition(files, F.rand(seed=5)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def test_streams_over_forty_files_are_complete(spark, tmp_path):
    """Nothing is lost and nothing stays open, whatever files a table has."""
    rng = random.Random(4)
    rows = [(f"s{i % 5}", i, i * 40 + rng.randrange(2000), b"x" * rng.randrange(9)) for i in range(400)]
    df = messages(spark, rows)
    table = scattered(spark, df, tmp_path)
    key = lambda r: (r.stream_id, r.tick, r.seq, bytes(r.data), r.messages)
    latest = run_table_as_stream(
        table, lambda s: windows.conflate_latest(s, "1 hour", delay="1 second"), "latest", ("1 hour", "1 second"), files=30
    )
    assert sorted(map(key, latest.collect())) == sorted(map(key, windows.conflate_latest(df, "1 hour").collect()))
    ticks = run_table_as_stream(
        table, lambda s: rolling.stream_tick_bytes(s, "1 minute", "1 second"), "ticks", ("1 minute", "1 second"), files=30
    )
    ordered = [(s, q, t, d) for s, q, t, d in sorted(rows, key=lambda r: (r[2], r[1]))]
    renumbered = messages(spark, [(s, k, t, d) for k, (s, _, t, d) in enumerate(ordered)])
    live = run_table_as_stream(
        scattered(spark, renumbered, tmp_path / "again"),
        lambda s: rolling.live_snapshots(s, 5, 20, 12, "1 minute", "1 second"), "live", ("1 minute", "1 second"), files=30,
    )
    assert shown(live, 60) == fold([(s, k, t, d) for k, (s, _, t, d) in enumerate(ordered)], 5, 20, 12, 60)
    got = rolling.snapshots_of_ticks(ticks, renumbered, 5, 20, 12, "1 minute")
    assert shown(got, 60) == fold([(s, k, t, d) for k, (s, _, t, d) in enumerate(ordered)], 5, 20, 12, 60)


def test_dropped_rows_are_an_error(spark, tmp_path):
    df = messages(spark, [("s", i, t, b"x") for i, t in enumerate([0, 10_000, 20_000, 1, 2, 30_000])])
    path = str(tmp_path / "in")
    for lo, hi in ((9_999, 20_001), (29_999, 30_001), (0, 2)):
        df.filter(F.col("ts").between(at(lo), at(hi))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(RuntimeError, match="3 rows came behind"):
        run_to_table(windows.conflate_latest(stream, "1 second", delay="1 second"), "late")


def test_numbers_of_a_running_stream(spark, tmp_path):
    """Frames shuffled over files, some behind others by less than the delay; numbers go on over connections and batches."""
    rng = random.Random(31)
    rows = [(rng.choice(["a", "b", None]), f"c{k // 70}", k, at(k * 0.37), bytes([k % 256])) for k in range(210)]
    schema = "url string, conn string, seq long, ts timestamp, body binary"
    df = spark.createDataFrame(rows, schema)
    late = sorted(rows, key=lambda r: r[2] + rng.random() * 20)  # by up to 7.4 seconds
    path = str(tmp_path / "shuffled")
    for k in range(0, 210, 30):
        spark.createDataFrame(late[k : k + 30], schema).coalesce(1).write.mode("append").parquet(path)
    end = [(None, None, None, at(10_000), None)]
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    numbered = run_to_table(counters.live_frame_numbers(stream(), delay="10 seconds"), "numbers")
    assert numbered.columns == [*df.columns, "frame_num"]
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, frames.number_frames(df).collect()))
    every = run_to_table(counters.live_frame_numbers(stream(), factor=7, delay="10 seconds"), "seventh")
    assert sorted(map(repr, every.collect())) == sorted(map(repr, frames.sample_every(df, 7).collect()))
    with pytest.raises(ValueError):
        counters.live_frame_numbers(stream(), factor=0)


def test_requests_in_flight_of_a_running_stream(spark):
    rng = random.Random(37)
    rows = []
    for _ in range(300):
        start = rng.randrange(4000)
        end = None if rng.random() < 0.1 else at(start + rng.randrange(200))
        rows.append((rng.choice(["GET", "PUT", None]), "https", rng.choice(["x", "y"]), 443, at(start), end))
    df = spark.createDataFrame(
        rows, "method string, scheme string, server_address string, server_port int, start timestamp, end timestamp"
    )
    told = run_table_as_stream(
        metrics.request_changes(df),
        lambda s: counters.live_active_requests(s, delay="1 second"), "active", ("1 minute", "1 second"), order="delta", files=20,
    )
    levels = {}
    for dims in {r[:4] for r in rows}:
        mine = [r for r in rows if r[:4] == dims]
        moments = [t for r in mine for t in r[4:] if t is not None]
        for tick in {at(60 * (int((t - START).total_seconds()) // 60 + 1)) for t in moments}:
            levels[*dims, tick] = sum(r[4] < tick for r in mine) - sum(r[5] is not None and r[5] < tick for r in mine)
    assert {tuple(r)[:5]: r.active for r in told.collect()} == levels
    batch = counters.active_at_ticks(metrics.active_requests(df)).select(told.columns)
    assert sorted(map(repr, batch.collect())) == sorted(map(repr, told.collect()))


def test_latest_per_tick(spark):
    df = messages(
        spark,
        [
            ("s", 0, 0, b"old"),
            ("s", 1, 0.5, b"new"),
            ("s", 2, 12, b"msg"),
            ("s", 3, 21, b"text"),
            ("s", 4, 22, b""),
        ],
    )
    latest = windows.conflate_latest(df, "5 seconds").orderBy("tick").collect()
    assert [bytes(r.data) for r in latest] == [b"new", b"msg"]
    kept = windows.keep_latest_frame(df, "5 seconds").orderBy("tick").collect()
    assert [bytes(r.data) for r in kept] == [b"new", b"msg", b""]


def test_latest_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"s{i % 3}", i, i * 2 + rng.random(), b"m%d" % i) for i in range(60)]
    rows.append(("s0", 99, 5000, b"end"))
    df = messages(spark, rows)
    batch = windows.conflate_latest(df, "10 seconds").collect()
    stream = windows.conflate_latest(as_stream(spark, df, tmp_path), "10 seconds", delay="5 seconds")
    got = run_to_table(stream, "latest").collect()
    last = max(r.tick for r in batch)
    key = lambda r: (r.stream_id, r.tick, bytes(r.data), r.messages)
    assert sorted(map(key, got)) == sorted(key(r) for r in batch if r.tick < last)


def test_sessions(spark, tmp_path):
    rows = [("s", i, t, b"f") for i, t in enumerate([0, 1, 6, 11.1, 30, 34.9])]
    df = messages(spark, rows)
    batch = windows.connection_sessions(df).orderBy("session_start").collect()
    # exactly one gap apart still is the same session
    assert [(r.session_start, r.session_end, r.frames) for r in batch] == [
        (at(0), at(11), 3),
        (at(11.1), at(16.1), 1),
        (at(30), at(39.9), 2),
    ]
    more = messages(spark, rows + [("s", 99, 9000, b"f")])
    stream = windows.connection_sessions(as_stream(spark, more, tmp_path), delay="1 second")
    got = run_to_table(stream, "sessions").orderBy("session_start").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in batch]


def exchange_rows(spark):
    head = {":path": "/a"}
    rows = [
        ("a", 0, 1, head, None, False, at(0), 5),
        ("a", 1, 2, None, b"he", False, at(1), 5),
        ("a", 2, 2, None, b"llo", True, at(2), 5),
        ("a", 3, 4, {":status": "200"}, None, False, at(3), 5),
        ("a", 4, 5, None, b"bye", True, at(4), 5),
        ("b", 0, 1, head, None, True, at(1), 7),
        ("c", 0, 1, head, None, True, at(5000), 7),
    ]
    return spark.createDataFrame(
        rows,
        "stream_id string, seq bigint, phase int, headers map<string,string>, chunk binary, "
        "end_of_stream boolean, ts timestamp, duration_ns bigint",
    )


def test_exchange_state(spark, tmp_path):
    seen = exchange_rows(spark)
    columns = [c for c in seen.columns if c != "chunk"]
    closed = run_table_as_stream(
        scattered(spark, seen.select(*columns), tmp_path, 5),
        lambda s: exchange_state(s, "1 minute", "1 second"),
        "closed",
        ("1 minute", "1 second"),
    )
    got = {r.stream_id: r for r in with_bodies(closed, seen).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b = got["a"], got["b"]
    assert (a.outcome, bytes(a.request_body), bytes(a.response_body), a.duration_ns, a.messages) == (
        "ended", b"hello", b"bye", 25, 5,
    )
    # pseudo headers are in no header set
    assert a.request_complete and a.response_complete and a.response_headers == {} and a.request_headers == {}
    assert (b.outcome, b.response_headers, bytes(b.request_body)) == ("timeout", None, b"")


def test_an_ended_exchange_leaves_in_the_batch_of_its_end(spark, tmp_path):
    """Rows by micro-batch: an end is given out at once, a late message gives no second row, state expires."""
    schema = exchange_rows(spark).schema
    head, reply = {":path": "/a", "x-a": "1"}, {":status": "200", "x-b": "2"}
    batches = [
        [("a", 0, 1, head, None, False, at(0), 5), ("b", 0, 1, head, None, True, at(1), 7)],
        [("a", 1, 4, reply, None, False, at(2), 5), ("a", 2, 5, None, b"x", True, at(3), 5)],
        [("a", 3, 6, None, None, False, at(4), 9)],  # a trailer after the end
        [("z", 0, 1, head, None, True, at(200), 1)],  # the watermark passes all before
        [("a", 4, 1, head, None, True, at(205), 1), ("a", 5, 4, reply, None, True, at(206), 1)],  # the id is free again
    ]
    path, seen = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).drop("chunk").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        exchange_state(stream.drop("chunk"), "1 minute", "1 second")
        .writeStream.foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = [(n, r.stream_id, r.outcome, r.messages, r.duration_ns) for n, r in seen]
    a, again = [x for x in found if x[1] == "a"]
    assert a == (1, "a", "ended", 3, 15) and again[2:] == ("ended", 2, 2)
    assert [x[1:] for x in found if x[1] == "b"] == [("b", "timeout", 1, 7)] and {x[1] for x in found} == {"a", "b"}
    (row,) = [r for n, r in seen if n == 1]
    assert (row.request_headers, row.response_headers, row.first_ts, row.last_ts) == ({"x-a": "1"}, {"x-b": "2"}, at(0), at(3))
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2  # "z" and the later "a"


def test_trailers_end_an_exchange_and_late_messages_join_it(spark):
    rows = [
        ("t", 0, 1, {":path": "/", "x-a": "1"}, None, False, at(0), 5),
        ("t", 1, 4, {":status": "200", "x-b": "2"}, None, False, at(1), 5),
        ("t", 2, 5, None, b"part", False, at(2), 5),
        ("t", 3, 6, None, None, False, at(3), 9),
        ("t", 4, 5, None, b" late", False, at(30), 5),
    ]
    seen = spark.createDataFrame(rows, exchange_rows(spark).schema)
    (row,) = with_bodies(exchange_state(seen, "1 minute"), seen).collect()
    assert (row.outcome, row.messages, row.duration_ns, bytes(row.response_body)) == ("ended", 5, 20, b"part late")
    assert (row.request_headers, row.response_headers) == ({"x-a": "1"}, {"x-b": "2"})


def test_correlation_stream_keeps_unanswered(spark, tmp_path):
    seen = exchange_rows(spark).select("stream_id", "phase", "ts")
    batch = correlate(
        seen.filter("phase = 1").select("stream_id", "ts"), seen.filter("phase = 4").select("stream_id", "ts")
    )
    assert {r.stream_id: r.answered for r in batch.collect()} == {"a": True, "b": False, "c": False}
    more = seen.unionByName(
        spark.createDataFrame([("z", 1, at(90000)), ("z", 4, at(90001)), ("y", 1, at(99000)), ("y", 4, at(99001))], seen.schema)
    )
    path = str(tmp_path / "in")
    for lo, hi in ((0, 10), (11, 91000), (91001, 99999)):
        more.filter(F.col("ts").between(at(lo), at(hi))).coalesce(1).write.mode("append").parquet(path)
    source = lambda phase: (
        spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(path)
        .filter(F.col("phase") == phase).select("stream_id", "ts")
    )
    joined = correlate_streams(source(1), source(4), "1 minute", "1 second")
    got = {r.stream_id: r.answered for r in run_to_table(joined, "joined").collect()}
    assert got == {"a": True, "b": False, "c": False, "z": True, "y": True}


def test_message_loader_streams_and_maps_columns(spark, tmp_path):
    path = str(tmp_path / "raw.json")
    spark.createDataFrame([("x", 1, "2024-01-01 00:00:01", "hello")], "who string, n int, t string, m string").write.json(path)
    columns = {"stream_id": "who", "seq": "n", "ts": "cast(t as timestamp)", "data": "cast(m as binary)"}
    batch = load_messages(spark, path, columns=columns)
    assert batch.schema.simpleString() == MESSAGE.simpleString()
    stream = load_messages(spark, path, streaming=True, columns=columns)
    assert stream.isStreaming
    assert run_to_table(stream, "loaded").first().stream_id == "x"


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """A few events, documents and conversations of their own."""
    folder, rng = str(tmp_path_factory.mktemp("small")), random.Random(53)
    events = [
        (k, at(rng.randrange(4000)), rng.randrange(5), rng.choice(["click", "view", "error"]), float(rng.randrange(9000)), "{}")
        for k in range(300)
    ]
    texts = [(k, "word " * rng.randrange(400), "en", rng.choice(["web", "book"]), 0) for k in range(60)]
    turns = [
        (c, t, role, f"turn {t} of {c}")
        for c in range(12)
        for t, role in enumerate(["system", "user", "assistant", "user"][: rng.randrange(2, 5)])
    ]
    for name, rows, schema in (
        ("events", events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
        ("documents", texts, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("conversations", turns, "conv_id bigint, turn bigint, role string, text string"),
    ):
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["n1_number_frames_stream", "n2_sample_every_stream", "n5_active_at_ticks_stream", "w2_rolling_snapshots_stream", "w5_exchange_state"])
def test_keyed_state_in_a_session_with_default_settings(spark, small_tables, name):
    """The queries bring the state store they need and leave the session's setting as it was."""
    session, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    session.conf.set(key, default)
    query, sql = driver.queries()[name], driver.oracle_sql()[name]
    assert compare(session, connect(small_tables), small_tables, query, sql) == []
    assert query(session, small_tables).count() > 0
    assert session.conf.get(key) == default


@pytest.mark.parametrize("timed", [True, False])
@pytest.mark.parametrize("name", ["n1_number_frames_stream", "n2_sample_every_stream"])
def test_numbers_of_frames_without_event_time_or_number(spark, tmp_path, name, timed):
    """They are the last of their stream, as in the SQL, and none is left out."""
    rng = random.Random(67)
    events = [
        (
            None if k % 17 == 0 else k,
            at(rng.randrange(60)) if timed and k % 7 else None,
            rng.choice([None, 1, 2, 3]),
            "view", 1.0, "{}",
        )
        for k in range(400)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    pq.write_table(spark.createDataFrame(events, schema).toArrow(), f"{tmp_path}/events.parquet")
    query, sql = driver.queries()[name], driver.oracle_sql()[name]
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), query, sql) == []
    assert name.startswith("n2") or query(spark, str(tmp_path)).count() == len(events)
