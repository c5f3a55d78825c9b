import math
import struct

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, tensors
from millrace.sources.inference import parse_infer_requests


def values(row):
    found = [row[f] for f in tensors.FAMILIES if row[f] is not None]
    return None if not found else [bytes(v) if isinstance(v, bytearray) else v for v in found[0]]


def decode(spark, cases):
    df = spark.createDataFrame([(i, d, r) for i, (d, r) in enumerate(cases)], "i int, datatype string, raw binary")
    return [
        (None if r.tensor is None else values(r.tensor), r.tensor_error)
        for r in tensors.decode_raw_tensors(df).orderBy("i").collect()
    ]


def test_every_data_type(spark):
    cases = [
        ("BOOL", bytes([1, 0, 1]), [True, False, True]),
        ("bool", bytes([2]), [True]),
        ("UINT8", bytes([10, 236, 30]), [10, 236, 30]),
        ("INT8", bytes([0x0A, 0xEC, 0x1E]), [10, -20, 30]),
        ("UINT16", struct.pack("<3H", 100, 65535, 300), [100, 65535, 300]),
        ("INT16", struct.pack("<3h", 100, -200, 300), [100, -200, 300]),
        ("UINT32", struct.pack("<2I", 1000, 4294967295), [1000, 4294967295]),
        ("INT32", struct.pack("<3i", 1000, -2000, 3000), [1000, -2000, 3000]),
        ("UINT64", struct.pack("<2Q", 10000, 2**64 - 1), [10000, 2**64 - 1]),
        ("INT64", struct.pack("<3q", 10000, -20000, 30000), [10000, -20000, 30000]),
        ("FP16", bytes.fromhex("003c00400042"), [1.0, 2.0, 3.0]),
        ("FP32", struct.pack("<3f", 1.5, 2.5, 3.5), [1.5, 2.5, 3.5]),
        ("FP64", struct.pack("<3d", 1.123, 2.456, 3.789), [1.123, 2.456, 3.789]),
        ("BYTES", b"hello", [b"hello"]),
        ("FP32", b"", []),
    ]
    got = decode(spark, [c[:2] for c in cases])
    assert got == [(c[2], None) for c in cases]


def test_half_precision_corners(spark):
    raw = struct.pack("<6H", 0x0001, 0x03FF, 0x7C00, 0xFC00, 0x8000, 0x7E00)
    (numbers, _), = decode(spark, [("FP16", raw)])
    assert numbers[:4] == [2.0**-24, 1023 * 2.0**-24, math.inf, -math.inf]
    assert math.copysign(1, numbers[4]) == -1 and math.isnan(numbers[5])


@pytest.mark.parametrize("kind,size,width", [("INT16", 3, 2), ("INT32", 3, 4), ("FP16", 3, 2), ("FP32", 3, 4), ("INT64", 5, 8), ("FP64", 5, 8), ("uint64", 9, 8)])
def test_bad_length(spark, kind, size, width):
    (numbers, error), = decode(spark, [(kind, bytes(size))])
    assert numbers is None
    assert error == f"tensor: data length {size} is not a multiple of {width} for {kind.upper()}"


def test_unknown_type_and_missing_bytes(spark):
    got = decode(spark, [("INVALID_TYPE", b"x"), ("FP32", None)])
    assert got[0][1].startswith("tensor: unsupported data type 'INVALID_TYPE'. Supported types: BOOL")
    assert got[1] == (None, None)


CONTENTS = (
    "struct<bool_contents:array<boolean>,int_contents:array<int>,int64_contents:array<bigint>,"
    "uint_contents:array<bigint>,uint64_contents:array<decimal(20,0)>,fp32_contents:array<float>,"
    "fp64_contents:array<double>,bytes_contents:array<binary>>"
)


def test_contents_win_over_raw(spark):
    raw = [struct.pack("<2f", 1.0, 2.0)]
    none = dict.fromkeys([part.split(":")[0] for part in CONTENTS[7:-1].split(",") if ":" in part])
    ints, floats = {**none, "int_contents": [7]}, {**none, "fp32_contents": [0.5]}
    cases = [
        ("typed", "INT8", ints, raw, 0, [7]),
        ("typed floats", "FP32", floats, raw, 0, [0.5]),
        ("raw", "fp32", None, raw, 0, [1.0, 2.0]),
        ("case", "int8", ints, raw, 0, None),
        ("half with typed", "FP16", floats, raw, 0, None),
        ("out of range", "FP32", None, raw, 5, None),
        ("nothing", "FP32", None, None, 0, None),
        ("raw error", "FP64", None, [b"123"], 0, None),
    ]
    df = spark.createDataFrame(
        [c[:5] for c in cases],
        f"name string, datatype string, contents {CONTENTS}, raw array<binary>, position int",
    )
    got = {r.name: None if r.tensor is None else values(r.tensor) for r in tensors.select_contents(df).collect()}
    assert got == {c[0]: c[5] for c in cases}


def test_output_coercion(spark):
    cases = [
        ("INT32", "[1.9, -1.9, \"x\", null, true, 1e2]", [1, -1, 0, 0, 0, 100]),
        ("UINT8", "[1.9, 2]", [1, 2]),
        ("INT64", "[9007199254740993]", [9007199254740993]),
        ("UINT64", "[18446744073709551615, 2.7]", [2**64 - 1, 2]),
        ("FP32", "[0.5, \"x\"]", [0.5, 0.0]),
        ("FP64", "[1, 2.25]", [1.0, 2.25]),
        ("BYTES", "[\"hello\", 1]", [b"hello", None]),
        ("BOOL", "[true, false]", None),
        ("INT32", "5", None),
        ("FP16", "[1.0]", None),
    ]
    df = spark.createDataFrame([(i, d, j) for i, (d, j, _) in enumerate(cases)], "i int, datatype string, j string")
    made = tensors.coerce_outputs(df.withColumn("data", F.parse_json("j"))).orderBy("i").select("tensor").collect()
    assert [values(r.tensor) for r in made] == [c[2] for c in cases]


def test_base64_of_bytes_tensors(spark):
    df = spark.createDataFrame([("BYTES", [b"hello", b"\xff" * 90]), ("FP32", [b"x"])], "datatype string, bytes array<binary>")
    coded = [r.data for r in tensors.encode_bytes_tensors(df).collect()]
    assert coded[0][0] == "aGVsbG8=" and "\n" not in coded[0][1] and coded[1] is None
    df = spark.sql(
        """select d as datatype, parse_json(j) as data from values
           ('BYTES', '"aGVsbG8="'), ('BYTES', '"%%"'), ('BYTES', '["aGVsbG8="]'), ('FP32', '"aGVsbG8="') as t(d, j)"""
    )
    rows = tensors.decode_bytes_tensors(df).drop("data").collect()
    assert [(r.decoded and bytes(r.decoded), r.decoded_error) for r in rows] == [
        (b"hello", None), (None, "illegal base64 data"), (None, None), (None, None),
    ]


def test_parameters(spark):
    df = spark.sql(
        """select map('a', parse_json('0.7'), 'b', parse_json('true'), 'c', parse_json('"t"'),
                      'd', parse_json('100'), 'e', parse_json('[1]'), 'f', parse_json('null')) as parameters"""
    )
    row = tensors.map_parameters(df, "to_choices").first().parameters
    assert {k: tuple(v) for k, v in row.items()} == {
        "a": (None, 0, None), "b": (True, None, None), "c": (None, None, "t"), "d": (None, 100, None),
    }
    with pytest.raises(ValueError):
        tensors.map_parameters(df, "sideways")


def test_demo_model(spark):
    df = spark.sql(
        f"""select name, datatype, array(1L) as shape, cast(t as {tensors.TENSOR}) as tensor from values
            ('x', 'FP32', struct(null, null, null, array(1.0D, 2.0D, 3.0D), null)),
            ('y', 'INT64', struct(null, array(10L, -50L), null, null, null)),
            ('z', 'UINT8', struct(null, array(5L), null, null, null)),
            ('b', 'BOOL', struct(array(true, false), null, null, null, null)),
            ('s', 'BYTES', struct(null, null, null, null, array(X'68656c6c6f'))),
            ('h', 'FP16', struct(null, null, null, array(1.0D), null)) as v(name, datatype, t)"""
    )
    got = {r.name: values(r.tensor) for r in tensors.elementwise_model(df).collect()}
    assert got == {
        "output_x": [2.0, 4.0, 6.0], "output_y": [20, -100], "output_z": [10], "output_b": [False, True],
        "output_s": [b"HELLO"], "output_h": [1.0],
    }


def test_shape_check(spark):
    df = spark.sql(
        f"""select shape, cast(t as {tensors.TENSOR}) as tensor from values
            (array(2L, 2L), struct(null, null, null, array(1D, 2D, 3D, 4D), null)),
            (array(3L), struct(null, array(1L), null, null, null)),
            (cast(array() as array<bigint>), struct(null, array(1L), null, null, null)) as v(shape, t)"""
    )
    assert [r.shape_ok for r in tensors.check_shapes(df).collect()] == [True, False, True]


REQUEST = (
    '{"id":"1","parameters":{"temperature":0.7,"max_tokens":100},"inputs":['
    '{"name":"a","shape":[1,2],"datatype":"FP32","data":[1.0,2.0]},'
    '{"name":"b","shape":[1,3],"datatype":"INT64","data":[10,20,30]},'
    '{"name":"c","shape":[1,2],"datatype":"BOOL","data":[true,false]}]}'
)


def test_requests_from_json(spark):
    df = spark.createDataFrame([(REQUEST,), ('{"id": "2", "inputs": [',), ("no json",)], "value string")
    parsed = parse_infer_requests(df)
    good, bad = parsed.filter("rejected is null"), parsed.filter("rejected is not null")
    assert bad.count() == 2
    rows = tensors.explode_tensors(good).select("id", "position", "name", "datatype", "shape", F.to_json("data").alias("data")).collect()
    assert [(r.id, r.position, r.name, r.datatype, r.shape, r.data) for r in rows] == [
        ("1", 0, "a", "FP32", [1, 2], "[1,2]"),
        ("1", 1, "b", "INT64", [1, 3], "[10,20,30]"),
        ("1", 2, "c", "BOOL", [1, 2], "[true,false]"),
    ]


def test_request_files(spark, tmp_path):
    (tmp_path / "requests.jsonl").write_text(REQUEST + "\n{broken\n")
    from millrace.sources.inference import load_infer_requests

    rows = load_infer_requests(spark, str(tmp_path)).select("id", "rejected").collect()
    assert sorted((r.id, r.rejected) for r in rows) == [("", "{broken"), ("1", None)]


def test_request_without_tensors_keeps_its_row(spark):
    df = parse_infer_requests(spark.createDataFrame([('{"id":"1","inputs":[]}',)], "value string"))
    assert tensors.explode_tensors(df).select("id", "position").collect() == [("1", None)]


def test_readiness(spark):
    models = spark.createDataFrame([("test-model", "1.0"), ("test-model", "2.0")], "model_name string, model_version string")
    asked = spark.createDataFrame(
        [("1", "test-model", "1.0"), ("2", "wrong-model", "1.0"), ("3", "test-model", ""), ("4", "test-model", "9"), ("5", "test-model", None)],
        "id string, model_name string, model_version string",
    )
    got = {r.id: r.ready for r in joins.model_readiness(asked, models, "id").collect()}
    assert got == {"1": True, "2": False, "3": True, "4": False, "5": True}


def test_declared_tensors(spark):
    models = spark.createDataFrame(
        [("m", "inputs", "a", "FP32", [1, -1]), ("m", "inputs", "b", "INT8", [2]), ("m", "outputs", "z", "FP32", [1])],
        "model_name string, side string, tensor string, datatype string, shape array<bigint>",
    )
    sent = spark.createDataFrame(
        [("1", "m", "a", "FP32", [1, 7]), ("1", "m", "x", "FP32", [1]), ("2", "m", "a", "FP64", [1, 7]), ("2", "m", "b", "INT8", [3])],
        "id string, model_name string, name string, datatype string, shape array<bigint>",
    )
    rows = sent.withColumn("row", F.col("id")).withColumn("id", F.lit(""))
    got = {(r.row, r.name): r.verdict for r in joins.model_metadata(rows, models, "row").collect()}
    assert got == {
        ("1", "a"): "ok", ("1", "x"): "undeclared", ("1", "b"): "missing", ("2", "a"): "datatype", ("2", "b"): "shape",
    }


def coerced(spark, datatype, data):
    df = spark.createDataFrame([(datatype, data)], "datatype string, json string")
    return tensors.coerce_outputs(df.select("datatype", F.parse_json("json").alias("data"))).first().tensor


@pytest.mark.parametrize(
    "datatype,family,expected",
    [
        ("INT8", "ints", [0, -3, 2, None, None, 0]),
        ("UINT16", "ints", [0, None, 2, 3_000_000_000, None, 0]),
        ("INT64", "ints", [0, -3, 2, 3_000_000_000, None, 0]),
        ("UINT64", "uints", [0, None, 2, 3_000_000_000, 18446744073709551615, 0]),
    ],
)
def test_numbers_are_cut_toward_zero_and_held_to_their_list(spark, datatype, family, expected):
    found = coerced(spark, datatype, '[-0.5, -3.7, 2.9, 3000000000.5, 18446744073709551615, "7"]')
    assert [None if v is None else int(v) for v in found[family]] == expected


@pytest.mark.parametrize(
    "text,expected",
    [("YQ==", b"a"), ("YWI=", b"ab"), ("YWJj", b"abc"), ("", b""), ("YW\\r\\nJj", b"abc"),
     ("YQ", None), ("Y Q==", None), ("YQ=", None), ("=YQ=", None), ("YQ-_", None)],
)
def test_base64_is_standard(spark, text, expected):
    df = spark.createDataFrame([("BYTES", f'"{text}"')], "datatype string, json string")
    row = tensors.decode_bytes_tensors(df.select("datatype", F.parse_json("json").alias("data"))).first()
    assert (row.decoded if row.decoded is None else bytes(row.decoded)) == expected
    assert (row.decoded_error is None) == (expected is not None)
