"""What the plans must not hold, and what must reach the scans."""

import re

import pytest

from millrace.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.endswith(("_stream", "_state", "_job")))


@pytest.fixture
def no_broadcast(spark):
    """Plans as large tables get them: nothing is small enough to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_pairs_rows_without_a_key(spark, no_broadcast):
    for name in BATCH:
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert not re.search("Cartesian|NestedLoop|BroadcastExchange|SinglePartition", plan), name


@pytest.mark.parametrize(
    "name,columns",
    [
        ("flagship_hourly_acknowledgements", {"event_id", "ts", "user_id", "event_type"}),
        ("n1_number_frames", {"event_id", "user_id"}),
        ("k3_delivery_outcomes", {"l_orderkey", "l_linenumber", "l_returnflag"}),
        ("a7_stored_values", {"event_id", "user_id", "event_type", "value"}),
        ("p17_classify_route", {"p_partkey", "p_type", "p_brand", "p_size", "p_retailprice"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        read |= {part.split(":")[0] for part in schema.split(",")}
    assert read == columns


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("k3_delivery_outcomes", "LessThanOrEqual(l_linenumber,4)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert pushed in plan.replace(" ", "")


def test_job_filter_reaches_the_scan(spark):
    from millrace.plans.handlers import orders_by_segment

    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    plan = plan_of(orders_by_segment(read("orders"), read("customer"), "F"))
    assert "EqualTo(o_orderstatus,F)" in plan.replace(" ", "")


def test_running_scan_shuffles_rows_once(spark, no_broadcast):
    """Two exchanges by (stream, slice), rows and carry; the others hold slice sums only."""
    plan = plan_of(QUERIES["n1_number_frames"](spark, FOLDER))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan)
    assert len(exchanges) == 4
    assert sum("seq" in e for e in exchanges) == 0
    assert len(re.findall(r"Sort \[", plan)) <= 4


def test_a_hot_stream_is_spread(spark, no_broadcast):
    """A third of all rows in one stream: no task gets more than a few slices of it."""
    from pyspark.sql import functions as F

    from millrace.operators.scans import running, running_count

    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("url"),
        F.col("id").alias("seq"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        made = running(rows, ["url"], "seq", {"n": running_count()}, slice_rows=1000)
        placed = made.select("seq", "n", F.spark_partition_id().alias("p"))
        sizes = placed.groupBy("p").agg(F.count("*").alias("count"), F.sum("n")).collect()
        assert made.filter("url = 'hot'").agg(F.max("n")).first()[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 60_000 / 4


def spread(spark, make, partitions=16):
    """Rows in each partition of what ``make()`` gives, with so many shuffle partitions."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        placed = make().select(F.spark_partition_id().alias("p"))
        return [r["count"] for r in placed.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot(spark, rows=60_000):
    from pyspark.sql import functions as F

    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("stream_id"),
        F.col("id").alias("seq"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"),
    )


def test_a_hot_lookup_key_is_spread(spark, no_broadcast):
    from millrace.operators.scans import salted_join

    rows = hot(spark)
    lookup = rows.select("stream_id").distinct()
    sizes = spread(spark, lambda: salted_join(rows, lookup, ["stream_id"], ["seq"]))
    assert sum(sizes) == 60_000 and max(sizes) < 60_000 / 4


@pytest.mark.parametrize("share, copies", [(0, 1), (3, 2)])
def test_lookup_rows_are_copied_by_need(spark, no_broadcast, share, copies):
    """2,000 partitions: no copies where no key is hot, at most one a partition and row where one is."""
    from pyspark.sql import functions as F

    from millrace.operators.scans import heavy_keys, salted_join

    key = F.concat(F.lit("u"), F.col("id") % 20_000)
    rows = spark.range(60_000).select((F.when(F.col("id") % share == 0, "u1").otherwise(key) if share else key).alias("k"), "id")
    lookup = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("k"), F.col("id").alias("v"))
    heavy = heavy_keys(rows, ["k"], 2000)
    made = lookup.count() + sum(heavy.values()) - len(heavy)
    assert bool(heavy) == bool(share) and made <= copies * 20_000
    joined = salted_join(rows, lookup, ["k"], ["id"], salts=2000)
    assert joined.count() == 60_000 and joined.filter(F.col("k") != F.concat(F.lit("u"), "v")).count() == 0
    if share:
        sizes = spread(spark, lambda: salted_join(rows, lookup, ["k"], ["id"], salts=2000), 200)
        assert max(sizes) < 3 * 60_000 / 200


def test_salted_join_keeps_rows_without_a_match_or_a_key(spark, no_broadcast):
    from pyspark.sql import functions as F

    from millrace.operators.scans import salted_join

    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "d")], "k long, v string")
    for how in ("inner", "left", "left_anti"):
        plain = rows.join(lookup, "k", how)
        got = salted_join(rows, lookup, ["k"], ["id"], how)
        assert got.columns == plain.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_a_hot_capture_is_spread(spark, no_broadcast):
    """All segments of one path: written ones are read by many tasks."""
    from pyspark.sql import functions as F

    from millrace.sources.multipart import demux_frames, mux_frames

    frames = hot(spark, 4_000).select(
        F.lit("one").alias("url"), (F.col("seq") + 1).alias("frame_num"), F.lit(b"\xff\xd8").alias("body")
    )
    captures = mux_frames(frames, segment_frames=16).withColumnRenamed("url", "path")
    sizes = spread(spark, lambda: demux_frames(captures, "frame"))
    assert sum(sizes) == 4_000 and len(sizes) == 16 and max(sizes) < 1_000
    got = demux_frames(captures, "frame").agg(F.min("frame_num"), F.max("frame_num"), F.countDistinct("frame_num")).first()
    assert tuple(got) == (1, 4_000, 4_000)


def test_open_connections_are_not_cut_into_buckets(spark, no_broadcast):
    """A client that stays for years meets its frames, not a row for every bucket."""
    from pyspark.sql import functions as F

    from millrace.operators.delivery import fan_out

    frames = hot(spark, 3_000).withColumn("ts", F.timestamp_micros(F.col("seq") * 86_400_000_000))
    clients = spark.createDataFrame([("hot", "a")], "stream_id string, client_id string").select(
        "*", F.timestamp_micros(F.lit(0)).alias("connect_ts"), F.lit(None).cast("timestamp").alias("disconnect_ts")
    )
    sent = fan_out(frames, clients, "1 second")
    assert sent.count() == 1_000
