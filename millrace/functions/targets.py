"""Request targets, routes, status numbers and URLs."""

from pyspark.sql import functions as F

# URL reference split of RFC 3986, appendix B (fixed value).
_URL = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

_QUERY_TYPE = "map<string,array<string>>"


def path_of(target):
    return F.split_part(F.coalesce(target, F.lit("")), F.lit("?"), F.lit(1))


def query_text(target):
    """Text between the first and the second ``?``, null without a ``?``."""
    return F.when(F.contains(target, F.lit("?")), F.split_part(target, F.lit("?"), F.lit(2)))


def query_pairs(text):
    """Decoded (k, v) pairs of a query text; a part that does not decode is null."""
    return F.transform(
        F.filter(F.split(text, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            F.when(
                F.contains(p, F.lit("=")),
                F.try_url_decode(F.substring(p, F.locate("=", p) + 1, F.length(p))),
            )
            .otherwise(F.lit(""))
            .alias("v"),
        ),
    )


def query_map(text, pairs):
    """Name to list of values; null for a bad pair (broken escape, or a ``;``)."""
    bad = F.contains(text, F.lit(";")) | F.exists(
        pairs, lambda p: p["k"].isNull() | p["v"].isNull()
    )
    # one pass over the pairs in order of name: a name's values stand together then
    ordered = F.array_sort(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    )
    entry = lambda acc: F.struct(acc["k"].alias("k"), acc["vs"].alias("vs"))
    start = F.struct(
        F.expr("cast(array() as array<struct<k:string,vs:array<string>>>)").alias("done"),
        F.lit(None).cast("string").alias("k"),
        F.expr("cast(array() as array<string>)").alias("vs"),
    )

    def closed(acc):
        return F.when(acc["k"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], entry(acc)))

    def step(acc, p):
        same = acc["k"].eqNullSafe(p["k"])
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
            p["k"].alias("k"),
            F.when(same, F.array_append(acc["vs"], p["v"])).otherwise(F.array(p["v"])).alias("vs"),
        )

    entries = F.aggregate(ordered, start, step, closed)
    return F.when(~bad, F.map_from_entries(entries)).cast(_QUERY_TYPE)


def status_number(text):
    """Status as a 16-bit number; base prefixes and digit separators accepted, 0 on failure."""
    body = F.lower(F.regexp_replace(text, "^[+-]", ""))

    def digits(pattern, strip, base, longest):
        # the pattern decides; over-long digit runs are out of range anyway
        run = F.regexp_replace(F.regexp_replace(body, strip, ""), "_", "")
        run = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(
            body.rlike(pattern),
            F.when(F.length(run) <= longest, F.conv(run, base, 10).try_cast("int")),
        )

    size = F.coalesce(
        digits(r"^[1-9](_?[0-9])*\z", "^$", 10, 5),
        digits(r"^0x(_?[0-9a-f])+\z", "^0x", 16, 4),
        digits(r"^0b(_?[01])+\z", "^0b", 2, 16),
        digits(r"^0o(_?[0-7])+\z", "^0o", 8, 6),
        digits(r"^0(_?[0-7])*\z", "^$", 8, 6),
    )
    value = F.when(text.startswith("-"), -size).otherwise(size)
    return (
        F.when((value < -32768) | (value > 32767), F.lit(0))
        .when(value < 0, value + 65536)
        .otherwise(F.coalesce(value, F.lit(0)))
        .cast("int")
    )


def route_of(method, path, model_name, model_version):
    """(endpoint, status) of a model-serving request."""
    is_infer = path.endswith("/infer")
    is_model = path.endswith(f"/models/{model_name}") | path.endswith(
        f"/models/{model_name}/versions/{model_version}"
    )
    under_models = path.startswith("/v2/models/")
    endpoint = (
        F.when(under_models & path.endswith("/ready"), "model_ready")
        .when(under_models & is_infer, "model_infer")
        .when(under_models & is_model, "model_metadata")
        .when(path == "/v2", "server_metadata")
        .when(path == "/v2/health/live", "server_live")
        .when(path == "/v2/health/ready", "server_ready")
        .otherwise("not_found")
    )
    status = (
        F.when(endpoint == "not_found", 404)
        .when((endpoint == "model_infer") & (method != "POST"), 405)
        .otherwise(200)
    )
    return endpoint, status


def url_parts(url):
    """Struct (scheme, host, port, path, query); empty parts are ''."""
    piece = lambda i: F.regexp_extract(url, _URL, i)
    authority = F.regexp_replace(piece(4), "^.*@", "")
    return F.struct(
        F.lower(piece(2)).alias("scheme"),
        F.lower(
            F.regexp_replace(F.regexp_replace(authority, ":[0-9]*$", ""), r"^\[(.*)\]$", "$1")
        ).alias("host"),
        F.when(
            authority.rlike(":[0-9]+$"), F.regexp_extract(authority, ":([0-9]+)$", 1).cast("bigint")
        ).alias("port"),
        F.regexp_replace(piece(5), ";[^/]*$", "").alias("path"),
        piece(7).alias("query"),
    )
