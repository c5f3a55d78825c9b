"""Inference requests, tensors and models."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..operators import joins, tensors
from ..sources.inference import parse_infer_requests
from .inputs import MODELS, models, requests, table, weighted, weighted_sql
from .registry import query


def _request_texts(spark, folder):
    """Embeddings as JSON requests; an id ending in 7 lost its last characters."""
    body = F.to_json(
        F.struct(
            F.col("id"),
            F.struct(
                F.col("label"), (F.col("label") / 4).alias("rate"), (F.col("label") % 2 == 0).alias("flag")
            ).alias("parameters"),
            F.array(
                F.struct(
                    F.lit("embedding").alias("name"),
                    F.array(F.size("embedding")).alias("shape"),
                    F.lit("FP64").alias("datatype"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("data"),
                )
            ).alias("inputs"),
        )
    )
    return requests(spark, folder).select(
        "vec_id",
        F.when(F.col("vec_id") % 10 == 7, F.substring(body, F.lit(1), F.length(body) - 3))
        .otherwise(body)
        .alias("value"),
    )


@query(
    "s5_load_infer_requests",
    f"""
    SELECT vec_id, CASE WHEN vec_id % 10 = 7 THEN '' ELSE CAST(vec_id AS VARCHAR) END AS id, vec_id % 10 = 7 AS rejected,
           CASE WHEN vec_id % 10 <> 7 THEN CAST(label AS BIGINT) END AS label,
           CASE WHEN vec_id % 10 <> 7 THEN 'FP64' END AS datatype,
           CASE WHEN vec_id % 10 <> 7 THEN CAST(len(embedding) AS BIGINT) END AS size,
           CASE WHEN vec_id % 10 <> 7 THEN {weighted_sql("embedding")} END AS data
    FROM embeddings
    """,
)
def load_requests_query(spark, folder):
    parsed = parse_infer_requests(_request_texts(spark, folder))
    rejected = F.col("rejected").isNotNull()
    tensor = F.get(F.col("inputs"), F.lit(0))
    return parsed.select(
        "vec_id",
        "id",
        rejected.alias("rejected"),
        F.when(~rejected, F.try_variant_get(F.try_element_at("parameters", F.lit("label")), "$", "bigint")).alias("label"),
        F.when(~rejected, tensor["datatype"]).alias("datatype"),
        F.when(~rejected, F.get(tensor["shape"], F.lit(0))).alias("size"),
        F.when(~rejected, weighted(F.try_variant_get(tensor["data"], "$", "array<double>"))).alias("data"),
    )


def _tensor_table(spark, folder):
    """Embedding tensors with their values in the float family."""
    return requests(spark, folder).select(
        "id",
        "vec_id",
        "model_name",
        F.lit("embedding").alias("name"),
        F.array(F.lit(4).cast("long"), F.when(F.col("vec_id") % 5 == 0, 15).otherwise(16).cast("long")).alias("shape"),
        F.lit("FP32").alias("datatype"),
        F.struct(
            F.lit(None).cast("array<boolean>").alias("bools"),
            F.lit(None).cast("array<bigint>").alias("ints"),
            F.lit(None).cast("array<decimal(20,0)>").alias("uints"),
            F.transform("embedding", lambda v: v.cast("double")).alias("floats"),
            F.lit(None).cast("array<binary>").alias("bytes"),
        ).alias("tensor"),
    )


@query(
    "t1_explode_tensors",
    r"""
    SELECT CAST(doc_id AS VARCHAR) AS id, p AS position, 'line' || p AS name,
           CAST(len(string_split(lines[p + 1], ' ')) AS BIGINT) AS size, 'BYTES' AS datatype, lang AS parameter
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines, unnest(range(0, len(string_split(text, chr(10))))) AS p
          FROM documents)
    """,
)
def explode_query(spark, folder):
    """A document as one request, a tensor for every line."""
    lines = F.split("text", "\n")
    asked = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.transform(
            lines,
            lambda line, i: F.struct(
                F.concat(F.lit("line"), i).alias("name"),
                F.array(F.size(F.split(line, " ")).cast("long")).alias("shape"),
                F.lit("BYTES").alias("datatype"),
                F.create_map(F.lit("lang"), F.col("lang")).alias("parameters"),
            ),
        ).alias("inputs"),
    )
    return tensors.explode_tensors(asked).select(
        "id",
        F.col("position").cast("bigint"),
        "name",
        F.get("shape", F.lit(0)).alias("size"),
        "datatype",
        F.element_at("parameters", F.lit("lang")).alias("parameter"),
    )


def _bytes_of(kind):
    """Lists of numbers as little-endian bytes of one numpy type, from the flat Arrow values."""

    @F.arrow_udf(T.BinaryType())
    def packed(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(kind)
        raw, width = flat.tobytes(), flat.dtype.itemsize
        ends = np.cumsum([len(v) if v.is_valid else 0 for v in values]) * width
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return pa.array([raw[a:b] for a, b in zip(starts, ends)], pa.binary())

    return packed


# Every data type with values made of an embedding: steps of an eighth for the float types,
# whole tenths for the others, and no sign where the type has none.
_ALL_TYPES = tensors.SUPPORTED.split(", ")


def _typed_vectors(spark, folder):
    """Embeddings with the data type of their turn and the family lists of their values."""
    turn = (F.col("vec_id") % len(_ALL_TYPES)).cast("int")
    kind = F.col("datatype")
    tenths = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("bigint"))
    unsigned = kind.startswith("UINT")
    small = F.transform("tenths", lambda v: F.when(unsigned, F.abs(v)).otherwise(v) % 128)
    lists = {
        "bools": (kind == "BOOL", F.transform("tenths", lambda v: v % 2 == 0)),
        "ints": (kind.startswith("INT") | (unsigned & (kind != "UINT64")), small),
        "uints": (
            kind == "UINT64",
            F.transform("tenths", lambda v: (F.abs(v) + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")),
        ),
        "floats": (kind.startswith("FP"), F.transform("tenths", lambda v: v / 8)),
        "bytes": (kind == "BYTES", F.transform("tenths", lambda v: F.concat(F.lit("b"), v).cast("binary"))),
    }
    return (
        requests(spark, folder)
        .withColumn("datatype", F.get(F.array(*[F.lit(t) for t in _ALL_TYPES]), turn))
        .withColumn("tenths", tenths)
        .withColumn("tensor", F.struct(*[F.when(w, v).alias(n) for n, (w, v) in lists.items()]))
    )


_TYPED = f"""
typed AS (
  SELECT *, list_extract({_ALL_TYPES}, CAST(vec_id % {len(_ALL_TYPES)} + 1 AS BIGINT)) AS datatype,
         list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 10) AS BIGINT)) AS tenths
  FROM embeddings),
listed AS (
  SELECT *, CASE WHEN datatype = 'BOOL' THEN list_transform(tenths, lambda v: CASE WHEN v % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END)
                 WHEN datatype = 'UINT64' THEN list_transform(tenths, lambda v: abs(v)::DOUBLE)
                 WHEN datatype LIKE 'UINT%' THEN list_transform(tenths, lambda v: (abs(v) % 128)::DOUBLE)
                 WHEN datatype LIKE 'INT%' THEN list_transform(tenths, lambda v: (v % 128)::DOUBLE)
                 WHEN datatype LIKE 'FP%' THEN list_transform(tenths, lambda v: v / 8)
                 ELSE list_transform(tenths, lambda v: length('b' || v)::DOUBLE) END AS numbers
  FROM typed)
"""


def _numbers(tensor):
    """The values of any family as numbers; UINT64 less 2^63, texts by their length."""
    return F.coalesce(
        F.transform(tensor["bools"], lambda v: v.cast("int").cast("double")),
        F.transform(tensor["ints"], lambda v: v.cast("double")),
        F.transform(tensor["uints"], lambda v: (v - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("double")),
        tensor["floats"],
        F.transform(tensor["bytes"], lambda v: F.octet_length(v).cast("double")),
    )


def _raw_bytes(df):
    """The bytes each type's values have on the wire; a BYTES tensor is one text."""
    raw = F.when(F.col("datatype") == "BYTES", F.array_join(F.transform("tensor.bytes", lambda b: b.cast("string")), "").cast("binary"))
    for name, (kind, family) in tensors.LAYOUT.items():
        values = F.col(f"tensor.{family}")
        if family == "uints":
            # numpy reads no decimals: the upper bit is set in the bytes
            values = F.transform("tenths", lambda v: F.abs(v).cast("bigint"))
        elif family == "bools":
            values = F.transform(values, lambda v: v.cast("int"))
        coded = _bytes_of(kind)(F.when(F.col("datatype") == name, values))
        if family == "uints":
            coded = _with_upper_bit(coded)
        raw = raw.when(F.col("datatype") == name, coded)
    return raw


@F.arrow_udf(T.BinaryType())
def _with_upper_bit(raw: pa.Array) -> pa.Array:
    bit = np.uint64(1 << 63)
    return pa.array(
        [(np.frombuffer(b, "<u8") | bit).tobytes() for b in (x or b"" for x in raw.to_pylist())], pa.binary()
    )


@query(
    "t2_decode_raw_tensors",
    f"""
    WITH {_TYPED}
    SELECT vec_id, datatype, CASE WHEN datatype = 'BYTES' THEN 1 ELSE len(numbers) END::INTEGER AS elements,
           CASE WHEN datatype = 'BYTES' THEN CAST(list_sum(numbers) * 1000 AS BIGINT) ELSE {weighted_sql("numbers")} END AS data,
           NULL::VARCHAR AS error
    FROM listed
    """,
)
def decode_all_query(spark, folder):
    """All thirteen types, names in lower case, every value counted."""
    typed = _typed_vectors(spark, folder)
    df = typed.select("vec_id", F.lower("datatype").alias("datatype"), _raw_bytes(typed).alias("raw"))
    decoded = tensors.decode_raw_tensors(df)
    numbers = _numbers(F.col("tensor"))
    return decoded.select(
        "vec_id",
        F.upper("datatype").alias("datatype"),
        F.size(numbers).alias("elements"),
        weighted(numbers).alias("data"),
        F.col("tensor_error").alias("error"),
    )


# Data types cycled over the documents, whose bytes are taken as they come.
_CYCLE = ("UINT8", "INT8", "UINT16", "INT16", "UINT32", "INT32", "INT64", "BOOL", "BYTES", "COMPLEX")
_WIDTH = {"UINT8": 1, "INT8": 1, "UINT16": 2, "INT16": 2, "UINT32": 4, "INT32": 4, "INT64": 8}


def _decoded_sql():
    """Every data type by arithmetic on the hex digits of the bytes."""
    names = list(_CYCLE)
    width = "CASE dt " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WIDTH.items()) + " ELSE 1 END"
    return f"""
    WITH d AS (
      SELECT doc_id, list_extract({names}, CAST(doc_id % {len(names)} + 1 AS BIGINT)) AS dt, hex(encode(text)) AS h,
             octet_length(encode(text)) AS n
      FROM documents),
    w AS (SELECT *, {width} AS width FROM d),
    b AS (
      SELECT doc_id, dt, width, i, CAST('0x' || x AS BIGINT) AS byte
      FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i, unnest(regexp_extract_all(h, '..')) AS x
            FROM w WHERE n % width = 0 AND dt NOT IN ('BOOL', 'BYTES', 'COMPLEX'))),
    v AS (
      SELECT doc_id, dt, width, i // width AS pos,
             CAST(sum(CASE WHEN i % width = width - 1 AND dt LIKE 'INT%' AND byte > 127 THEN byte - 256 ELSE byte END
                      * CAST(power(256, i % width) AS HUGEINT)) AS HUGEINT) AS value
      FROM b GROUP BY ALL),
    s AS (SELECT doc_id, CAST(sum(value % 1000003) AS BIGINT) AS total, count(*) AS elements FROM v GROUP BY 1)
    SELECT w.doc_id, dt AS datatype,
           CAST(CASE WHEN dt = 'COMPLEX' OR n % width > 0 THEN NULL WHEN dt = 'BYTES' THEN 1 WHEN dt = 'BOOL' THEN n
                ELSE coalesce(elements, 0) END AS INTEGER) AS elements,
           CASE WHEN dt NOT IN ('BOOL', 'BYTES', 'COMPLEX') AND n % width = 0 THEN coalesce(total, 0) END AS total,
           CASE WHEN dt = 'COMPLEX' THEN 'tensor: unsupported data type ''COMPLEX''. Supported types: {tensors.SUPPORTED}'
                WHEN n % width > 0 THEN 'tensor: data length ' || n || ' is not a multiple of ' || width || ' for ' || dt
                END AS error
    FROM w LEFT JOIN s ON s.doc_id = w.doc_id
    """


@query("t2_decode_raw_types", _decoded_sql())
def decode_types_query(spark, folder):
    names = F.array(*[F.lit(name) for name in _CYCLE])
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.get(names, (F.col("doc_id") % len(_CYCLE)).cast("int")).alias("datatype"),
        F.col("text").cast("binary").alias("raw"),
    )
    value = F.col("tensor")
    counts = [F.when(value[f].isNotNull(), F.size(value[f])) for f in tensors.FAMILIES]
    return tensors.decode_raw_tensors(df).select(
        "doc_id",
        "datatype",
        F.coalesce(*counts).alias("elements"),
        F.aggregate(value["ints"], F.lit(0).cast("bigint"), lambda a, x: a + x % 1000003).alias("total"),
        F.col("tensor_error").alias("error"),
    )


@query(
    "t3_select_contents",
    f"""
    WITH {_TYPED}
    SELECT vec_id, datatype,
           CASE WHEN vec_id % 3 = 2 OR (vec_id % 3 = 0 AND datatype = 'FP16') THEN NULL
                WHEN vec_id % 3 = 1 AND datatype = 'BYTES' THEN CAST(list_sum(numbers) * 1000 AS BIGINT)
                ELSE {weighted_sql("numbers")} END AS data
    FROM listed
    """,
)
def select_contents_query(spark, folder):
    """All thirteen types by id: typed contents (FP16 has none), raw bytes, a raw list that is too short."""
    pick = F.col("vec_id") % 3
    value = F.col("tensor")
    contents = F.struct(
        value["bools"].alias("bool_contents"),
        value["ints"].cast("array<int>").alias("int_contents"),
        value["ints"].alias("int64_contents"),
        value["ints"].alias("uint_contents"),
        value["uints"].alias("uint64_contents"),
        value["floats"].cast("array<float>").alias("fp32_contents"),
        value["floats"].alias("fp64_contents"),
        value["bytes"].alias("bytes_contents"),
    )
    typed = _typed_vectors(spark, folder)
    df = typed.select(
        "vec_id",
        "datatype",
        F.when(pick == 0, contents).alias("contents"),
        F.array(_raw_bytes(typed)).alias("raw"),
        F.when(pick == 2, 5).otherwise(0).alias("position"),
    )
    return tensors.select_contents(df).select("vec_id", "datatype", weighted(_numbers(F.col("tensor"))).alias("data"))


def _coerced_sql():
    """What becomes of -0.5, -3.7, 2.9, vec_id * 1.5, 3000000000.75, -5000000000, a text and true."""
    cut = "(vec_id * 3 // 2)"
    whole = {
        "('INT8', 'INT16', 'INT32')": f"'0,-3,2,' || {cut} || ',none,none,0,0'",
        "('UINT8', 'UINT16', 'UINT32')": f"'0,none,2,' || {cut} || ',3000000000,none,0,0'",
        "('INT64')": f"'0,-3,2,' || {cut} || ',3000000000,-5000000000,0,0'",
        "('UINT64')": f"'0,none,2,' || {cut} || ',3000000000,none,0,0'",
        "('BYTES')": "'none,none,none,none,none,none,word,none'",
    }
    cases = " ".join(f"WHEN datatype IN {kinds} THEN {text}" for kinds, text in whole.items())
    numbers = "[-0.5::DOUBLE, -3.7, 2.9, vec_id * 1.5, 3000000000.75, -5000000000, 0, 0]"
    singles = f"list_transform({numbers}, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))"
    return f"""
    WITH {_TYPED}
    SELECT vec_id, datatype, CASE {cases} END AS listed,
           CASE datatype WHEN 'FP64' THEN {weighted_sql(numbers)} WHEN 'FP32' THEN {weighted_sql(singles)} END AS floats
    FROM typed
    """


@query("t4_coerce_outputs", _coerced_sql())
def coerce_query(spark, folder):
    """All thirteen types with negative, fractional, far too large and no numbers; BOOL and FP16 stay empty."""
    df = _typed_vectors(spark, folder).select(
        "vec_id",
        "datatype",
        F.parse_json(
            F.concat(
                F.lit("[-0.5, -3.7, 2.9, "), (F.col("vec_id") * 1.5).cast("decimal(20,1)").cast("string"),
                F.lit(', 3000000000.75, -5000000000, "word", true]'),
            )
        ).alias("data"),
    )
    value = F.col("tensor")
    shown = lambda family: F.array_join(value[family].cast("array<string>"), ",", "none")
    return tensors.coerce_outputs(df).select(
        "vec_id",
        "datatype",
        F.coalesce(shown("ints"), shown("uints"), shown("bytes")).alias("listed"),
        weighted(value["floats"]).alias("floats"),
    )


@query(
    "t5_encode_bytes_tensors",
    """
    SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN md5(to_base64(encode(text)) || ',' || to_base64(encode(lang))) END AS data
    FROM documents
    """,
)
def encode_query(spark, folder):
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 > 0, "BYTES").otherwise("FP32").alias("datatype"),
        F.array(F.col("text").cast("binary"), F.col("lang").cast("binary")).alias("bytes"),
    )
    coded = tensors.encode_bytes_tensors(df)
    return coded.select("doc_id", F.md5(F.array_join("data", ",").cast("binary")).alias("data"))


@query(
    "t5_decode_bytes_tensors",
    """
    SELECT doc_id, CASE WHEN pick = 0 OR (pick = 4 AND n % 3 = 0) THEN md5(text) END AS decoded,
           CASE WHEN pick = 1 OR (pick = 4 AND n % 3 > 0) OR (pick = 5 AND n > 0) THEN 'illegal base64 data' END AS error,
           pick = 2 AS still_a_list
    FROM (SELECT *, doc_id % 6 AS pick, octet_length(encode(text)) AS n FROM documents)
    """,
)
def decode_bytes_query(spark, folder):
    """By id: one text, a broken text, a list, another data type, no padding, inner blanks."""
    pick = F.col("doc_id") % 6
    coded = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.when(pick == 3, "FP32").otherwise("BYTES").alias("datatype"),
        F.parse_json(
            F.when(pick == 1, quoted(F.concat(F.lit("%"), coded)))
            .when(pick == 2, F.concat(F.lit("["), quoted(coded), F.lit("]")))
            .when(pick == 4, quoted(F.rtrim(coded, F.lit("="))))
            .when(pick == 5, quoted(F.concat(F.left(coded, F.lit(1)), F.lit(" "), F.substring(coded, 2, 1 << 30))))
            .otherwise(quoted(coded))
        ).alias("data"),
    )
    return tensors.decode_bytes_tensors(df).select(
        "doc_id",
        F.md5("decoded").alias("decoded"),
        F.col("decoded_error").alias("error"),
        F.schema_of_variant("data").startswith("ARRAY").alias("still_a_list"),
    )


@query(
    "t6_map_parameters",
    """
    SELECT event_id, user_id % 2 = 0 AS flag, user_id AS whole, CAST(trunc(value) AS BIGINT) AS cut, event_type AS text,
           CAST(4 AS INTEGER) AS kept
    FROM events
    """,
)
def parameters_query(spark, folder):
    """Choices to values and back; a parameter without a choice and a list are lost on the way."""
    choice = lambda b=None, i=None, s=None: F.struct(
        (F.lit(None) if b is None else b).cast("boolean").alias("b"),
        (F.lit(None) if i is None else i).cast("bigint").alias("i"),
        (F.lit(None) if s is None else s).cast("string").alias("s"),
    )
    df = table(spark, folder, "events").select(
        "event_id",
        "value",
        F.create_map(
            F.lit("flag"), choice(b=F.col("user_id") % 2 == 0),
            F.lit("whole"), choice(i=F.col("user_id")),
            F.lit("text"), choice(s=F.col("event_type")),
            F.lit("none"), choice(),
        ).alias("parameters"),
    )
    values = tensors.map_parameters(df, "to_values")
    extra = F.create_map(
        F.lit("cut"), F.parse_json(F.col("value").cast("string")), F.lit("list"), F.parse_json(F.lit("[1]"))
    )
    back = tensors.map_parameters(
        values.withColumn("parameters", F.map_concat("parameters", extra)), "to_choices"
    )
    get = lambda name, part: F.element_at("parameters", F.lit(name))[part].alias(name)
    return back.select(
        "event_id", get("flag", "b"), get("whole", "i"), get("cut", "i"), get("text", "s"),
        F.size("parameters").alias("kept"),
    )


@query(
    "t7_elementwise_model",
    f"""
    WITH {_TYPED},
    answered AS (
      SELECT vec_id, datatype,
             CASE WHEN datatype = 'BOOL' THEN list_transform(numbers, lambda v: 1 - v)
                  WHEN datatype = 'BYTES' THEN numbers
                  WHEN datatype = 'UINT64' THEN NULL
                  WHEN datatype = 'FP16' THEN numbers
                  ELSE list_transform(numbers, lambda v: v * 2) END AS numbers,
             CASE WHEN datatype = 'BYTES' THEN md5(upper(array_to_string(list_transform(tenths, lambda v: 'b' || v), ''))) END AS texts
      FROM listed)
    SELECT vec_id, 'output_embedding' AS name, datatype,
           CASE WHEN datatype <> 'UINT64' THEN {weighted_sql("numbers")} END AS data, texts
    FROM answered
    """,
)
def model_query(spark, folder):
    """All thirteen types; twice a UINT64 above 2^63 fits no UINT64, and FP16 stays as it is."""
    answered = tensors.elementwise_model(_typed_vectors(spark, folder).withColumn("name", F.lit("embedding")))
    value = F.col("tensor")
    return answered.select(
        "vec_id",
        "name",
        "datatype",
        F.when(F.col("datatype") != "UINT64", weighted(_numbers(value))).alias("data"),
        F.md5(F.array_join(F.transform(value["bytes"], lambda b: b.cast("string")), "").cast("binary")).alias("texts"),
    )


@query(
    "t8_default_response",
    """
    SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'given' ELSE 'm' END AS model_name,
           CASE WHEN label % 2 = 0 THEN CAST(label AS VARCHAR) ELSE '1' END AS model_version,
           CASE WHEN vec_id % 3 = 0 THEN 'own' ELSE CAST(vec_id AS VARCHAR) END AS id
    FROM embeddings
    """,
)
def default_response_query(spark, folder):
    vec, label = F.col("vec_id"), F.col("label")
    df = table(spark, folder, "embeddings").select(
        "vec_id",
        vec.cast("string").alias("request_id"),
        F.when(vec % 2 == 0, "given").otherwise("").alias("model_name"),
        F.when(label % 2 == 0, label.cast("string")).alias("model_version"),
        F.when(vec % 3 == 0, "own").otherwise("").alias("id"),
    )
    return tensors.default_response(df, "m", "1").drop("request_id")


@query(
    "t9_check_shapes",
    """
    SELECT vec_id, CAST(len(embedding) AS BIGINT) AS elements, CASE WHEN vec_id % 5 = 0 THEN 60 ELSE 64 END::BIGINT AS expected,
           vec_id % 5 > 0 AS shape_ok
    FROM embeddings
    """,
)
def shapes_query(spark, folder):
    return tensors.check_shapes(_tensor_table(spark, folder)).select("vec_id", "elements", "expected", "shape_ok")


@query(
    "t9_shape_report",
    """
    SELECT 'model-' || (label % 4) AS model_name, count(*) AS tensors, count(*) FILTER (vec_id % 5 = 0) AS mismatches
    FROM embeddings GROUP BY 1
    """,
)
def shape_report_query(spark, folder):
    return tensors.shape_report(tensors.check_shapes(_tensor_table(spark, folder)))


@query(
    "j2_model_readiness",
    f"""
    WITH {MODELS}
    SELECT a.id, a.model_name, a.model_version,
           EXISTS (SELECT 1 FROM models m WHERE m.model_name = a.model_name
                   AND (a.model_version = '' OR a.model_version = m.model_version)) AS ready
    FROM asked a
    """,
)
def readiness_query(spark, folder):
    return joins.model_readiness(requests(spark, folder), models(spark, folder), "vec_id").select(
        "id", "model_name", "model_version", "ready"
    )


@query(
    "j3_model_metadata",
    f"""
    WITH {MODELS},
    r AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN '' ELSE id END AS id, model_name FROM asked),
    t AS (SELECT vec_id, id, model_name, 'embedding' AS name FROM r
          UNION ALL SELECT vec_id, id, model_name, 'extra' FROM r WHERE vec_id % 7 = 0),
    d AS (SELECT r.vec_id, r.id, r.model_name, n.name, m.dim FROM r JOIN models m USING (model_name)
          CROSS JOIN (VALUES ('embedding'), ('mask')) n(name))
    SELECT vec_id, id, model_name, name,
           CASE WHEN t.name IS NULL THEN 'missing' WHEN d.name IS NULL THEN 'undeclared'
                WHEN d.dim NOT IN (-1, 64) THEN 'shape' ELSE 'ok' END AS verdict
    FROM t FULL JOIN d USING (vec_id, id, model_name, name)
    """,
)
def metadata_query(spark, folder):
    """A tenth of the requests have no id; they are told apart by their row."""
    names = F.when(
        F.col("vec_id") % 7 == 0, F.array(F.lit("embedding"), F.lit("extra"))
    ).otherwise(F.array(F.lit("embedding")))
    sent = requests(spark, folder).select(
        "vec_id",
        F.when(F.col("vec_id") % 10 == 3, "").otherwise(F.col("id")).alias("id"),
        "model_name",
        F.explode(names).alias("name"),
        F.lit("FP32").alias("datatype"),
        F.array(F.size("embedding").cast("long")).alias("shape"),
    )
    return joins.model_metadata(sent, models(spark, folder), "vec_id").select(
        "vec_id", "id", "model_name", "name", "verdict"
    )


@query(
    "j3_declared_metadata",
    f"""
    WITH {MODELS}
    SELECT model_name, model_version AS versions, 'embedding:FP32:' || dim || ',mask:FP32:' || dim AS inputs, '' AS outputs
    FROM models
    """,
)
def declared_query(spark, folder):
    """What a model answers when asked for its metadata."""
    shown = lambda side: F.array_join(
        F.transform(side, lambda t: F.concat_ws(":", t["name"], t["datatype"], F.array_join(t["shape"].cast("array<string>"), "x"))), ","
    ).alias(side)
    told = joins.declared_metadata(models(spark, folder))
    return told.select("model_name", F.array_join("versions", ",").alias("versions"), shown("inputs"), shown("outputs"))


@query(
    "inference_round_trip",
    f"""
    SELECT CASE WHEN vec_id % 10 = 7 THEN '' ELSE CAST(vec_id AS VARCHAR) END AS id, vec_id,
           CASE WHEN vec_id % 10 = 7 THEN 400 ELSE 200 END AS status, 'm' AS model_name, '1' AS model_version,
           CASE WHEN vec_id % 10 <> 7 THEN 'output_embedding' END AS name,
           CASE WHEN vec_id % 10 <> 7 THEN CAST(len(embedding) AS BIGINT) END AS elements,
           CASE WHEN vec_id % 10 <> 7 THEN true END AS shape_ok,
           CASE WHEN vec_id % 10 <> 7 THEN {weighted_sql("list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 2)")} END AS data
    FROM embeddings
    """,
)
def round_trip_query(spark, folder):
    """JSON requests through the demo model: parsed, exploded, typed, answered, checked; bad ones answer 400."""
    parsed = parse_infer_requests(_request_texts(spark, folder))
    typed = tensors.coerce_outputs(tensors.explode_tensors(parsed))
    answered = tensors.check_shapes(tensors.elementwise_model(typed))
    named = answered.withColumns(
        {"request_id": F.col("id"), "model_name": F.lit(""), "model_version": F.lit(None).cast("string")}
    )
    good = F.col("rejected").isNull()
    return tensors.default_response(named, "m", "1").select(
        "id",
        "vec_id",
        F.when(good, 200).otherwise(400).alias("status"),
        "model_name",
        "model_version",
        "name",
        F.when(good, F.col("elements")).alias("elements"),
        F.when(good, F.col("shape_ok")).alias("shape_ok"),
        F.when(good, weighted(F.col("tensor.floats"))).alias("data"),
    )
