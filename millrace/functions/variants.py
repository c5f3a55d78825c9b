"""Values whose type is only known per row (VARIANT)."""

from pyspark.sql import functions as F

from .text import parse_integer

def kind_of_schema(schema):
    """Kind of a VARIANT from its ``schema_of_variant`` text.

    JSON 1.5 is stored as a decimal, so decimals count as floats.
    """
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "BIGINT", "int")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
        .when(schema == "BOOLEAN", "bool")
        .when(schema != "VOID", "other")
    )


def kind_of(value):
    """string / bool / int / float / other, null for an absent value or a JSON null."""
    return kind_of_schema(F.schema_of_variant(value))


def member(document, key):
    """One member of a VARIANT object."""
    return F.try_variant_get(document, "$['" + key.replace("'", "\\'") + "']", "variant")


def as_text(value):
    return F.try_variant_get(value, "$", "string")


def as_double(value):
    return F.try_variant_get(value, "$", "double")


def as_long(value):
    """BIGINT of a number, cut toward zero; null where it does not fit."""
    return F.try_variant_get(value, "$", "bigint")


def as_bool(value):
    return F.try_variant_get(value, "$", "boolean")


def elements(value):
    """ARRAY<VARIANT> of a JSON array, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_number(value):
    return F.coalesce(
        F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False)
    )


def with_kind(mapping):
    """Map values as structs (kind, value), so that a kind is read once per value."""
    named = F.transform_values(
        mapping, lambda _, v: F.struct(F.schema_of_variant(v).alias("schema"), v.alias("value"))
    )
    return F.transform_values(
        named,
        lambda _, v: F.struct(
            kind_of_schema(v["schema"]).alias("kind"), v["value"].alias("value")
        ),
    )


def field_text(value, kind, trigger, number):
    """Field as text by the trigger's rule; '' when the rule gives nothing.

    ``number`` is the plain text of a field that is a float.
    """
    text = F.when(kind == "string", as_text(value))
    if trigger == "job":
        text = (
            text.when(kind == "int", as_long(value).cast("string"))
            .when(kind == "float", number)
            .when(kind == "bool", as_bool(value).cast("string"))
        )
    return F.coalesce(text, F.lit(""))


def field_integer(value, kind, trigger):
    """Field as BIGINT by the trigger's rule; null where the rule raises."""
    if trigger == "job":
        raise ValueError("job events have no integer fields")
    if trigger == "openinference":
        # only a native integer counts, and neither JSON nor a protobuf map holds one
        return F.lit(0).cast("bigint")
    number = F.when(kind.isin("int", "float"), as_long(value))
    if trigger != "mjpeg":
        number = number.when(kind == "string", parse_integer(as_text(value)))
    return number.when(kind.isNull() | kind.isin("string", "bool", "other"), F.lit(0).cast("bigint"))
