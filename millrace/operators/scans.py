"""Running values inside ordered streams, without one task per stream.

A plain window over ``partitionBy(stream)`` sends a whole stream to one task. Here a stream
is cut into slices; every slice is summarised by a partial aggregation, the summaries are
accumulated per stream, and each slice is then scanned on its own with the value carried in
from the slices before it. The rows themselves are shuffled once, by (stream, slice), so a
stream holding a third of the table is spread over as many tasks as it has slices.
"""

from dataclasses import dataclass

from pyspark.sql import Column, Window, functions as F, types as T

from ..functions.numbers import divided

#: Rows of one stream a slice may hold when it is cut by sequence number.
SLICE_ROWS = 1 << 20


@dataclass(frozen=True)
class Running:
    """A running value: ``how`` is sum, max or last (last non-null)."""

    how: str
    value: Column


def running_count():
    return Running("sum", F.lit(1).cast("long"))


def running_sum(value):
    return Running("sum", value.cast("long"))


def running_max(value):
    return Running("max", value)


def running_last(value):
    return Running("last", value)


def running(
    df, keys, order, values, slices=None, slice_rows=SLICE_ROWS, with_summaries=False
):
    """Append running values, current row included.

    ``order`` must be unique within ``keys`` and numeric when ``slices`` is not given;
    sequence slices then hold at most ``slice_rows`` rows of one stream each. ``slices``
    replaces them by named columns that sort the same way as ``order`` does.

    A row without ``order`` has no place in a stream and is an error.

    ``with_summaries`` returns the slice summaries too: (keys, slice columns, and for every
    value ``__own_<name>`` of the slice and ``__pre_<name>`` of all slices before it).
    """
    if slices is None:
        slices = {"__slice": divided(F.col(order), slice_rows)}
    part = [*keys, "__nulls", *slices]
    known = F.when(
        F.col(order).isNull(), F.raise_error(F.lit(f"{order} is null")).cast(df.schema[order].dataType)
    ).otherwise(F.col(order))
    df = df.withColumn(order, known)
    cut = _solid(df, keys).select(
        *df.columns,
        "__nulls",
        *[column.alias(name) for name, column in slices.items()],
        *[spec.value.alias(f"__in_{out}") for out, spec in values.items()],
    )
    summaries = _summaries(cut, [*keys, "__nulls"], list(slices), order, values)

    # values inside a slice come before the join: its rows are then sorted only once
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = cut.select(
        *df.columns,
        "__nulls",
        *slices,
        *[_over(spec, F.col(f"__in_{out}"), inside).alias(f"__loc_{out}") for out, spec in values.items()],
    )
    carry = summaries.select(*part, *[f"__pre_{out}" for out in values])

    def total(out, spec):
        here, before = F.col(f"__loc_{out}"), F.col(f"__pre_{out}")
        if spec.how == "last":
            return F.coalesce(here, before)
        if spec.how == "max":
            return F.greatest(here, before)
        return here + F.coalesce(before, F.lit(0))

    joined = local.join(carry, part, "left")
    result = joined.select(
        *_hollow(df.columns, keys),
        *[total(out, spec).alias(out) for out, spec in values.items()],
    )
    if not with_summaries:
        return result
    return result, summaries.select(
        *_hollow(keys, keys), *[c for c in summaries.columns if c not in part[: len(keys) + 1]]
    )


def _solid(df, keys):
    """Keys without nulls, which no equi join would match, and a mask of where they were."""
    mask, filled = F.lit(0), {}
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        if isinstance(kind, T.StringType):
            zero = F.lit("")
        elif isinstance(kind, T.NumericType):
            zero = F.lit(0).cast(kind)
        else:
            raise TypeError(f"key {key} must be text or a number, not {kind.simpleString()}")
        mask = mask + F.when(F.col(key).isNull(), 1 << i).otherwise(0)
        filled[key] = F.coalesce(F.col(key), zero)
    return df.withColumn("__nulls", mask).withColumns(filled)


def _hollow(columns, keys):
    """The columns with the nulls of the keys put back."""
    return [
        F.when(F.col("__nulls").bitwiseAND(1 << keys.index(c)) == 0, F.col(c)).alias(c)
        if c in keys
        else F.col(c)
        for c in columns
    ]


def _over(spec, value, window):
    if spec.how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return (F.max if spec.how == "max" else F.sum)(value).over(window)


def _summaries(cut, keys, names, order, values):
    """One row per slice: its own value, and the value carried in from the slices before."""

    def own(out, spec):
        value = F.col(f"__in_{out}")
        if spec.how == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        return (F.max if spec.how == "max" else F.sum)(value)

    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1
    )
    folded = cut.groupBy(*keys, *names).agg(
        *[own(out, spec).alias(f"__own_{out}") for out, spec in values.items()]
    )
    return folded.select(
        "*",
        *[_over(spec, F.col(f"__own_{out}"), before).alias(f"__pre_{out}") for out, spec in values.items()],
    )


#: Keys whose share of the facts is looked for, and counters of the sketch that finds them.
HEAVY_KEYS, SKETCH_COUNTERS = 512, 1 << 14


def heavy_keys(facts, keys, parts):
    """{hash of the key: salts} for the keys that hold more than a ``parts``-th of the facts.

    A frequent-items sketch of the hashed keys, one row with at most ``HEAVY_KEYS`` items, so
    what it costs is a pass over the key columns. The salts are a key's share in ``parts``.
    """
    sketch = facts.select(F.xxhash64(*keys).alias("__key")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(__key, {HEAVY_KEYS}, {SKETCH_COUNTERS})").alias("top")
    )
    found = sketch.first()
    return {
        item["item"]: -(-item["count"] * parts // found["n"]) for item in found["top"] or [] if item["count"] * parts > found["n"]
    }


def salted_join(facts, lookup, keys, salt_by, how="inner", salts=None):
    """Equi join of a large table with a smaller one on keys that may be hot.

    Only lookup rows of heavy keys are copied, as often as the key's share of the facts fills
    shuffle partitions, and the facts of that key are spread over the copies by ``salt_by``; all
    copies together are at most twice the partitions times the rows a heavy key has. Where no key
    is heavy this is a plain join. Which keys are heavy only decides where rows go, so a sketch is
    enough to tell. ``salts`` says how many partitions to spread over, else as many as there are
    for a shuffle. No broadcast is forced on the lookup: adaptive execution turns this into one
    by itself when its measured size allows it.
    """
    parts = salts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(facts, keys, parts) if parts > 1 else {}
    if not heavy:
        return facts.join(lookup, keys, how)

    def numbers(values):  # one literal, not an expression for each
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    one = F.lit(1).cast("long")
    place = F.array_position(numbers(heavy), F.xxhash64(*keys)).cast("int")
    copies = F.when(place > 0, F.get(numbers(heavy.values()), place - 1)).otherwise(one)
    spread = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - one)))
    salted = facts.withColumn("__salt", F.when(place > 0, F.pmod(F.xxhash64(*salt_by), copies)).otherwise(F.lit(0).cast("long")))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
