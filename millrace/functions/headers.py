"""Header maps: MAP<STRING,STRING> beside MAP<STRING,BINARY>.

Names are case-sensitive throughout. Nothing relies on the session's duplicate-key policy.
"""

from pyspark.sql import functions as F

from .text import text_or_base64

EMPTY_TEXT = "cast(map() as map<string,string>)"
EMPTY_RAW = "cast(map() as map<string,binary>)"


def text_map(column):
    return F.coalesce(column, F.expr(EMPTY_TEXT))


def raw_map(column):
    return F.coalesce(column, F.expr(EMPTY_RAW))


def merge_maps(base, override):
    """Entries of both maps; ``override`` wins."""
    return F.map_zip_with(base, override, lambda _, b, o: F.coalesce(o, b))


def last_wins(entries, kind="string"):
    """Map from an array of (key, value) structs, the later duplicate winning."""
    empty = F.expr(f"cast(map() as map<string,{kind}>)")
    return F.aggregate(
        entries,
        empty,
        lambda found, e: F.map_concat(
            F.map_filter(found, lambda k, _: k != e["key"]),
            F.create_map(e["key"], e["value"]),
        ),
    )


def lower_keys(mapping, prefix=""):
    """Keys lower-cased and prefixed; of keys that fall together the later one wins."""
    return last_wins(
        F.transform(
            F.map_entries(mapping),
            lambda e: F.struct(
                F.concat(F.lit(prefix), F.lower(e["key"])).alias("key"), e["value"].alias("value")
            ),
        )
    )


def split_pairs(pairs):
    """(text map, raw map) of an array of (name, value, raw): raw only where value is empty."""
    has_text = lambda p: F.coalesce(F.length(p["value"]) > 0, F.lit(False))
    text = F.transform(
        F.filter(pairs, has_text),
        lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")),
    )
    raw = F.transform(
        F.filter(pairs, lambda p: ~has_text(p)),
        lambda p: F.struct(p["name"].alias("key"), p["raw"].alias("value")),
    )
    return text_map(last_wins(text)), raw_map(last_wins(raw, "binary"))


def stringified(headers, raw_headers):
    """One text map; raw values as UTF-8 or base64, overriding text values."""
    raw = F.transform_values(raw_map(raw_headers), lambda _, v: text_or_base64(v))
    return merge_maps(text_map(headers), raw)


def header_text(name, headers="headers", raw_headers="raw_headers"):
    """Header value as text, null when there is none."""
    raw = F.try_element_at(F.col(raw_headers), F.lit(name))
    return F.coalesce(
        F.try_element_at(F.col(headers), F.lit(name)),
        F.when(raw.isNotNull(), text_or_base64(raw)),
    )


def without(mapping, names=(), prefix=None, suffix=None, where=None):
    """The map less the headers picked by any of the conditions."""

    def dropped(name):
        hit = name.isin(list(names)) if names else F.lit(False)
        if prefix is not None:
            hit = hit | name.startswith(prefix)
        if suffix is not None:
            hit = hit | name.endswith(suffix)
        if where is not None:
            hit = hit | where(name)
        return hit

    return F.map_filter(mapping, lambda name, _: ~dropped(name))
