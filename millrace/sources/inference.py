"""Inference requests from JSON."""

from pyspark.sql import functions as F

_TENSOR = (
    "struct<name:string,shape:array<bigint>,datatype:string,"
    "parameters:map<string,variant>,data:variant>"
)
REQUEST = (
    "id string, parameters map<string,variant>, "
    f"inputs array<{_TENSOR}>, outputs array<{_TENSOR}>, _corrupt string"
)


def parse_infer_requests(df, text="value"):
    """Requests of a JSON text column; a row that does not parse keeps its text in ``rejected``."""
    parsed = F.from_json(
        F.col(text), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    others = [c for c in df.columns if c != text]
    return (
        df.select(*others, F.col(text).alias("__text"), parsed.alias("__request"))
        .select(
            *others,
            F.coalesce("__request.id", F.lit("")).alias("id"),
            "__request.parameters",
            "__request.inputs",
            "__request.outputs",
            F.when(
                F.col("__request").isNull() | F.col("__request._corrupt").isNotNull(),
                F.col("__text"),
            ).alias("rejected"),
        )
    )


def load_infer_requests(spark, path):
    """Requests of JSON files, one request a line."""
    return parse_infer_requests(spark.read.text(path))
