"""Bytes and number texts."""

from pyspark.sql import functions as F

INTEGER_TEXT = r"\A[+-]?[0-9]+\z"


def standard_base64(raw):
    """Base64 in one line; depending on its settings Spark breaks lines after 76 characters."""
    return F.translate(F.base64(raw), "\r\n", "")


def text_or_base64(raw):
    """UTF-8 text of the bytes, base64 when they are not valid UTF-8, '' for null."""
    raw = F.coalesce(raw, F.lit(b""))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        standard_base64(raw)
    )


def parse_integer(text):
    """BIGINT from an optional sign and digits only; null for anything else."""
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def short_number(value):
    """DOUBLE as its shortest digits, possibly with an exponent."""
    short = value.cast("string")
    # Java before 19 sometimes gives 17 digits where 16 say the same number
    sixteen = F.format_string("%.15E", value)
    exact = F.when(F.contains(short, F.lit("E")), sixteen.cast("double") == value)
    return F.when(exact, sixteen).otherwise(short)


def number_digits(short):
    """Significant digits of a number text with an exponent, without trailing zeros."""
    return F.concat(
        F.regexp_extract(short, "([0-9])\\.", 1), F.regexp_extract(short, "\\.([0-9]*?)0*E", 1)
    )


def number_exponent(short):
    """Exponent of a number text, null when it has none."""
    # no failing cast: Spark answers each with a caught exception
    return F.when(
        F.contains(short, F.lit("E")), F.split_part(short, F.lit("E"), F.lit(2)).cast("int")
    )


def plain_number(short, digits, exponent):
    """Number text without its exponent: the digits padded with zeros, the point put in."""
    large = F.when(F.length(digits) <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(
        F.concat(F.left(digits, exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    sign = F.when(F.startswith(short, F.lit("-")), "-").otherwise("")
    return (
        F.when(exponent.isNull(), F.regexp_replace(short, "\\.0$", ""))
        .when(exponent >= 0, F.concat(sign, large))
        .otherwise(F.concat(sign, small))
    )


def number_text(value):
    """DOUBLE as its shortest digits without an exponent, in one expression."""
    short = short_number(value)
    return plain_number(short, number_digits(short), number_exponent(short))


def acknowledgement(data):
    """``ACK: <text>`` for valid UTF-8, ``decode error`` otherwise."""
    return F.when(
        F.is_valid_utf8(data.cast("string")), F.concat(F.lit("ACK: "), data.cast("string"))
    ).otherwise(F.lit("decode error"))


def is_jpeg(body):
    """Non-empty and opening with the JPEG start-of-image marker."""
    return F.coalesce(F.startswith(body, F.lit(b"\xff\xd8")), F.lit(False))
