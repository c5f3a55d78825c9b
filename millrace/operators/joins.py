"""Exchange correlation and model tables."""

from pyspark.sql import functions as F

from .scans import salted_join


def declared_metadata(models):
    """A model's answer to a metadata request: its versions, and its inputs and outputs by name."""
    tensor = F.struct(F.col("tensor").alias("name"), "datatype", "shape")
    return models.groupBy("model_name").agg(
        F.sort_array(F.collect_set("model_version")).alias("versions"),
        *[
            F.sort_array(F.collect_set(F.when(F.col("side") == side, tensor))).alias(side)
            for side in ("inputs", "outputs")
        ],
    )


def correlate(requests, responses, key="stream_id"):
    """One row per request with its response; unanswered requests are kept.

    Columns other than the key are prefixed ``request_`` and ``response_``.
    """
    rename = lambda df, side: df.select(
        key, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key]
    )
    answered = rename(responses, "response").withColumn("answered", F.lit(True))
    return (
        rename(requests, "request")
        .join(answered, key, "left")
        .withColumn("answered", F.coalesce("answered", F.lit(False)))
    )


def correlate_streams(requests, responses, within="1 hour", delay="10 minutes", key="stream_id"):
    """As :func:`correlate` for two streams with a ``ts`` column each.

    A response counts when it comes ``within`` the given time after its request, so that
    unanswered requests can be given out once the watermark has passed that point.
    """
    left = requests.select(
        *[F.col(c).alias(f"request_{c}") for c in requests.columns]
    ).withWatermark("request_ts", delay)
    right = responses.select(
        *[F.col(c).alias(f"response_{c}") for c in responses.columns]
    ).withWatermark("response_ts", delay)
    pair = (
        (F.col(f"request_{key}") == F.col(f"response_{key}"))
        & (F.col("response_ts") >= F.col("request_ts"))
        & (F.col("response_ts") <= F.col("request_ts") + F.expr(f"interval {within}"))
    )
    joined = left.join(right, pair, "leftOuter")
    return (
        joined.withColumn("answered", F.col(f"response_{key}").isNotNull())
        .withColumnRenamed(f"request_{key}", key)
        .drop(f"response_{key}")
    )


def model_readiness(requests, models, key):
    """Append ``ready``: the model exists, and in the asked version unless none was asked.

    ``key`` names a row id of the request that is never empty (its own ``id`` may be): a model
    that everybody asks for is spread by it.
    """
    # a model answers to its version and to the empty version, which keeps this an equi join
    known = (
        models.select(
            "model_name",
            F.explode(F.array(F.col("model_version"), F.lit(""))).alias("model_version"),
        )
        .distinct()
        .withColumn("ready", F.lit(True))
    )
    asked = requests.withColumn("model_version", F.coalesce("model_version", F.lit("")))
    return salted_join(
        asked, known, ["model_name", "model_version"], [key], "left"
    ).withColumn("ready", F.coalesce("ready", F.lit(False)))


def model_metadata(tensors, models, key, side="inputs"):
    """Request tensors beside the declared ones.

    ``tensors`` has (key, id, model_name, name, datatype, shape), ``models`` (model_name, tensor,
    datatype, shape, side). ``key`` names a row id of the request; ``id``, which requests may
    leave empty, is carried along. ``verdict`` is ok, datatype, shape, missing or undeclared.
    A declared dimension of -1 matches any size.
    """
    declared = models.filter(F.col("side") == side).select(
        "model_name",
        F.col("tensor").alias("name"),
        F.col("datatype").alias("declared_datatype"),
        F.col("shape").alias("declared_shape"),
    )
    asked = tensors.select(key, "id", "model_name").distinct()
    expected = salted_join(asked, declared, ["model_name"], [key])
    found = tensors.select(key, "id", "model_name", "name", "datatype", "shape").withColumn(
        "__found", F.lit(True)
    )
    both = found.join(
        expected.withColumn("__declared", F.lit(True)), [key, "id", "model_name", "name"], "full"
    )
    shape_ok = (F.size("shape") == F.size("declared_shape")) & F.forall(
        F.arrays_zip("shape", "declared_shape"),
        lambda p: (p["declared_shape"] == -1) | (p["declared_shape"] == p["shape"]),
    )
    return both.withColumn(
        "verdict",
        F.when(F.col("__found").isNull(), "missing")
        .when(F.col("__declared").isNull(), "undeclared")
        .when(F.col("datatype") != F.col("declared_datatype"), "datatype")
        .when(~F.coalesce(shape_ok, F.lit(False)), "shape")
        .otherwise("ok"),
    ).drop("__found", "__declared")
