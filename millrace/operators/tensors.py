"""Inference tensors of thirteen data types.

Typed values travel as one struct with a list per family (``TENSOR``): bools, ints (all
signed types and unsigned up to 32 bits), uints (UINT64), floats (FP16, FP32, FP64) and
bytes. The list of the tensor's own family is set, the others are null.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from ..functions.text import standard_base64
from ..functions.variants import (
    as_bool,
    as_double,
    as_long,
    as_text,
    elements,
    is_number,
    with_kind,
)

TENSOR = (
    "struct<bools:array<boolean>,ints:array<bigint>,uints:array<decimal(20,0)>,"
    "floats:array<double>,bytes:array<binary>>"
)
_FAMILY_TYPES = {
    "bools": T.BooleanType(),
    "ints": T.LongType(),
    "uints": T.DecimalType(20, 0),
    "floats": T.DoubleType(),
    "bytes": T.BinaryType(),
}
_DECODED = T.StructType(
    [T.StructField(name, T.ArrayType(kind)) for name, kind in _FAMILY_TYPES.items()]
    + [T.StructField("error", T.StringType())]
)

# Data types and their layout, little-endian: numpy type and family (fixed values).
LAYOUT = {
    "BOOL": ("u1", "bools"),
    "UINT8": ("u1", "ints"),
    "INT8": ("i1", "ints"),
    "UINT16": ("<u2", "ints"),
    "INT16": ("<i2", "ints"),
    "UINT32": ("<u4", "ints"),
    "INT32": ("<i4", "ints"),
    "UINT64": ("<u8", "uints"),
    "INT64": ("<i8", "ints"),
    "FP16": ("<f2", "floats"),
    "FP32": ("<f4", "floats"),
    "FP64": ("<f8", "floats"),
}
FAMILIES = ("bools", "ints", "uints", "floats", "bytes")
SUPPORTED = "BOOL, UINT8, INT8, UINT16, INT16, UINT32, INT32, UINT64, INT64, FP16, FP32, FP64, BYTES"

INT_TYPES = ("INT8", "INT16", "INT32")
UINT_TYPES = ("UINT8", "UINT16", "UINT32")


def explode_tensors(requests, side="inputs"):
    """One row per tensor of a request; a request without tensors keeps one row."""
    others = [c for c in requests.columns if c not in ("inputs", "outputs")]
    exploded = requests.select(*others, F.posexplode_outer(side).alias("position", "__t"))
    members = [f.name for f in exploded.schema["__t"].dataType]
    kept = [
        F.col(c).alias(f"request_{c}" if c in members else c) for c in [*others, "position"]
    ]
    return exploded.select(*kept, *[F.col(f"__t.{m}").alias(m) for m in members])


@F.arrow_udf(_DECODED)
def _decode(datatypes: pa.Array, raw: pa.Array) -> pa.Array:
    """Whole Arrow columns at a time: one numpy view per data type present in the batch."""
    rows = len(raw)
    names = pc.utf8_upper(datatypes).to_numpy(zero_copy_only=False)
    lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    given = pc.is_valid(raw).to_numpy(zero_copy_only=False)
    errors = np.full(rows, None, dtype=object)
    target = {
        "bools": pa.bool_(),
        "ints": pa.int64(),
        "uints": pa.decimal128(20, 0),
        "floats": pa.float64(),
        "bytes": pa.binary(),
    }
    found = {family: [] for family in FAMILIES}

    for name in set(names[given]):
        picked = given & (names == name)
        if name == "BYTES":
            index = np.nonzero(picked)[0]
            values = raw.take(pa.array(index)).cast(pa.binary())
            ends = np.arange(len(index) + 1, dtype=np.int32)
            found["bytes"].append((index, pa.ListArray.from_arrays(pa.array(ends), values)))
            continue
        if name not in LAYOUT:
            errors[picked] = (
                f"tensor: unsupported data type '{name}'. Supported types: {SUPPORTED}"
            )
            continue
        numeric, family = LAYOUT[name]
        width = np.dtype(numeric).itemsize
        uneven = np.zeros(rows, dtype=bool)
        uneven[picked] = lengths[picked].astype("int64") % width != 0
        for i in np.nonzero(uneven)[0]:
            errors[i] = f"tensor: data length {int(lengths[i])} is not a multiple of {width} for {name}"
        index = np.nonzero(picked & ~uneven)[0]
        joined = b"".join(raw.take(pa.array(index)).to_pylist())
        values = np.frombuffer(joined, dtype=numeric)
        ends = np.concatenate([[0], np.cumsum(lengths[index].astype("int64") // width)])
        if family == "bools":
            items = pa.array(values != 0)
        elif family == "uints":
            items = pa.array(values).cast(target[family])
        else:
            items = pa.array(values.astype("f8" if family == "floats" else "i8"))
        found[family].append(
            (index, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items))
        )

    columns = []
    for family in FAMILIES:
        if not found[family]:
            columns.append(pa.nulls(rows, pa.list_(target[family])))
            continue
        where = np.zeros(rows, dtype=np.int64)
        hit = np.zeros(rows, dtype=bool)
        start = 0
        for index, lists in found[family]:
            where[index] = np.arange(start, start + len(index))
            hit[index] = True
            start += len(index)
        lists = pa.concat_arrays([part for _, part in found[family]])
        columns.append(lists.take(pa.array(where, mask=~hit)))
    columns.append(pa.array(errors, pa.string()))
    return pa.StructArray.from_arrays(
        columns, names=[*FAMILIES, "error"], mask=pc.is_null(raw)
    )


def decode_raw_tensors(df, datatype="datatype", raw="raw", out="tensor"):
    """Little-endian bytes to typed values; ``<out>_error`` says why a row has none."""
    coded = df.withColumn("__d", _decode(F.col(datatype), F.col(raw)))
    good = F.col("__d").isNotNull() & F.col("__d.error").isNull()
    return coded.withColumns(
        {out: F.when(good, _family_struct("__d")), f"{out}_error": F.col("__d.error")}
    ).drop("__d")


def _family_struct(prefix):
    return F.struct(*[F.col(f"{prefix}.{family}").alias(family) for family in FAMILIES])


def _family(**lists):
    """TENSOR struct with the given family set."""
    return F.struct(*[lists.get(family, F.lit(None)).alias(family) for family in FAMILIES]).cast(
        TENSOR
    )


def select_contents(df, out="tensor"):
    """Typed contents of a tensor, else its raw bytes; null when neither gives values.

    ``contents`` is a struct of typed lists, ``raw`` the request's list of byte strings and
    ``position`` the tensor's place in it. The data type is matched exactly for typed
    contents and without regard to case for raw bytes.
    """
    kind, typed = F.col("datatype"), F.col("contents")
    by_type = (
        F.when(kind == "BOOL", _family(bools=typed["bool_contents"]))
        .when(kind.isin(*INT_TYPES), _family(ints=typed["int_contents"]))
        .when(kind == "INT64", _family(ints=typed["int64_contents"]))
        .when(kind.isin(*UINT_TYPES), _family(ints=typed["uint_contents"]))
        .when(kind == "UINT64", _family(uints=typed["uint64_contents"]))
        .when(kind == "FP32", _family(floats=typed["fp32_contents"]))
        .when(kind == "FP64", _family(floats=typed["fp64_contents"]))
        .when(kind == "BYTES", _family(bytes=typed["bytes_contents"]))
    )
    # rows with typed contents send no bytes to Python
    raw = F.when(typed.isNull(), F.get(F.col("raw"), F.col("position")))
    decoded = decode_raw_tensors(df.withColumn("__raw", raw), "datatype", "__raw", "__from_raw")
    return decoded.withColumn(
        out, F.when(typed.isNotNull(), by_type).otherwise(F.col("__from_raw"))
    ).drop("__raw", "__from_raw", "__from_raw_error")


def coerce_outputs(df, data="data", out="tensor"):
    """JSON output data to its data type's family.

    Numbers are cut toward zero, elements that are no numbers become 0. A number its list
    cannot hold is null: the lists are of 32 bits for the types up to 32 bits, signed or
    unsigned, and of 64 bits for INT64 and UINT64. Data that is not a list gives an empty
    tensor, and so does every BOOL list: JSON never yields the native list of booleans that is
    asked for.
    """
    kind, items = F.col("datatype"), elements(F.col(data))
    zero = F.lit(0).cast("bigint")
    low = F.when(kind.isin(*INT_TYPES), -(1 << 31)).when(kind.isin(*UINT_TYPES), 0).otherwise(-(1 << 63))
    high = F.when(kind.isin(*INT_TYPES), (1 << 31) - 1).when(kind.isin(*UINT_TYPES), (1 << 32) - 1).otherwise((1 << 63) - 1)
    longs = F.transform(items, lambda v: F.when(is_number(v), as_long(v)).otherwise(zero))
    ints = F.transform(longs, lambda v: F.when(v.between(low.cast("bigint"), high.cast("bigint")), v))
    exact = F.transform(
        items,
        lambda v: F.when(is_number(v), F.try_variant_get(v, "$", "decimal(38,10)")).otherwise(
            F.lit(0).cast("decimal(38,10)")
        ),
    )
    # the floor is the cut toward zero for all that may be kept
    uints = F.transform(
        exact,
        lambda v: F.when(
            (v > -1) & (v < F.lit(str(1 << 64)).cast("decimal(38,10)")),
            F.floor(F.greatest(v, F.lit(0).cast("decimal(38,10)"))).cast("decimal(20,0)"),
        ),
    )
    doubles = F.transform(
        items, lambda v: F.when(is_number(v), as_double(v)).otherwise(F.lit(0.0))
    )
    singles = F.transform(doubles, lambda v: v.cast("float").cast("double"))
    texts = F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", as_text(v).cast("binary")),
    )
    return df.withColumn(
        out,
        F.when(kind.isin(*INT_TYPES, "INT64", *UINT_TYPES), _family(ints=ints))
        .when(kind == "UINT64", _family(uints=uints))
        .when(kind == "FP32", _family(floats=singles))
        .when(kind == "FP64", _family(floats=doubles))
        .when(kind == "BYTES", _family(bytes=texts))
        .otherwise(_family()),
    )


def encode_bytes_tensors(df, bytes_="bytes", out="data"):
    """Base64 texts for the byte strings of BYTES tensors, null for other data types."""
    source = F.col(bytes_)
    if df.schema[bytes_].dataType.typeName() == "array":
        text = F.transform(source, standard_base64)
    else:
        text = standard_base64(source)
    return df.withColumn(out, F.when(F.col("datatype") == "BYTES", text))


def decode_bytes_tensors(df, data="data", out="decoded"):
    """Base64 of a BYTES output that is one text; a list stays as it is.

    Bad base64 fails the row: ``<out>_error`` is set and the value is null. Bad is whatever the
    standard alphabet with padding does not allow; only line breaks are passed over.
    """
    scalar = (F.col("datatype") == "BYTES") & (F.schema_of_variant(F.col(data)) == "STRING")
    text = F.translate(as_text(F.col(data)), "\r\n", "")
    standard = (F.length(text) % 4 == 0) & text.rlike("\\A[A-Za-z0-9+/]*={0,2}\\z")
    value = F.when(standard, F.try_to_binary(text, F.lit("base64")))
    return df.withColumns(
        {
            out: F.when(scalar, value),
            f"{out}_error": F.when(scalar & value.isNull(), F.lit("illegal base64 data")),
        }
    )


def map_parameters(df, direction, column="parameters"):
    """Parameter choices (b, i, s) to values, or values to choices.

    ``to_values`` drops parameters with no choice set; ``to_choices`` keeps booleans, whole
    numbers and texts, cuts other numbers toward zero and drops the rest.
    """
    source = F.col(column)
    if direction == "to_values":
        chosen = F.map_filter(
            source, lambda _, p: p["b"].isNotNull() | p["i"].isNotNull() | p["s"].isNotNull()
        )
        result = F.transform_values(
            chosen,
            lambda _, p: F.coalesce(
                p["b"].cast("variant"), p["i"].cast("variant"), p["s"].cast("variant")
            ),
        )
    elif direction == "to_choices":
        known = F.map_filter(
            with_kind(source), lambda _, v: v["kind"].isin("bool", "int", "float", "string")
        )
        result = F.transform_values(
            known,
            lambda _, v: F.struct(
                F.when(v["kind"] == "bool", as_bool(v["value"])).alias("b"),
                F.when(v["kind"].isin("int", "float"), as_long(v["value"])).alias("i"),
                F.when(v["kind"] == "string", as_text(v["value"])).alias("s"),
            ),
        )
    else:
        raise ValueError(f"direction must be 'to_values' or 'to_choices': {direction}")
    return df.withColumn(column, result)


def elementwise_model(df, tensor="tensor"):
    """The demo model: numbers doubled (unsigned ones made positive), booleans negated,
    bytes in upper case; name prefixed, shape and data type kept."""
    kind, value = F.col("datatype"), F.col(tensor)
    unsigned = kind.startswith("UINT")
    doubled = F.transform(
        value["ints"], lambda v: F.when(unsigned, F.abs(v * 2)).otherwise(v * 2)
    )
    result = (
        F.when(kind.isin("FP32", "FP64"), _family(floats=F.transform(value["floats"], lambda v: v * 2.0)))
        .when(kind.isin(*INT_TYPES, "INT64", *UINT_TYPES), _family(ints=doubled))
        .when(
            kind == "UINT64",
            _family(uints=F.transform(value["uints"], lambda v: (v * 2).try_cast("decimal(20,0)"))),
        )
        .when(kind == "BOOL", _family(bools=F.transform(value["bools"], lambda v: ~v)))
        .when(
            kind == "BYTES",
            _family(
                bytes=F.transform(
                    value["bytes"], lambda v: F.upper(v.cast("string")).cast("binary")
                )
            ),
        )
        .otherwise(value)
    )
    return df.withColumns({"name": F.concat(F.lit("output_"), F.col("name")), tensor: result})


def default_response(df, model_name, model_version):
    """Fill empty model name, version and id of a response from the model and the request."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.withColumns(
        {
            "model_name": F.coalesce(given("model_name"), F.lit(model_name)),
            "model_version": F.coalesce(given("model_version"), F.lit(model_version)),
            "id": F.coalesce(given("id"), F.col("request_id"), F.lit("")),
        }
    )


def check_shapes(df, tensor="tensor"):
    """Append the element count, the count the shape asks for, and whether they agree."""
    value = F.col(tensor)
    size = F.coalesce(*[F.when(value[f].isNotNull(), F.size(value[f])) for f in FAMILIES])
    expected = F.aggregate(F.col("shape"), F.lit(1).cast("bigint"), lambda a, x: a * x)
    return df.withColumns(
        {
            "elements": size.cast("bigint"),
            "expected": expected,
            "shape_ok": size.cast("bigint").eqNullSafe(expected),
        }
    )


def shape_report(checked):
    """Tensors and shape mismatches per model."""
    return checked.groupBy("model_name").agg(
        F.count("*").alias("tensors"), F.count_if(~F.col("shape_ok")).alias("mismatches")
    )
