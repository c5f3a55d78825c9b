"""Secrets in texts: strong patterns, and weak parts reported where complementary parts meet.

Everything is SQL expressions: no Python runs on the executors. Positions are code points,
ends exclusive; they follow from the lengths of matches and of the text between them.

Strong kinds are reported wherever they stand. Weak kinds are *parts*: an access identifier
(``user = ...``), a credential (a long token of mixed characters) or an endpoint (a URL). A
part alone means little. Parts are joined by intervals inside their scope, one document and
``reach`` characters around them, and a weak part is reported only beside its complement: an
identifier beside a secret, a credential beside an identifier, an endpoint beside both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: (kind, pattern, group whose length counts, least length); kinds of one start are listed in this order.
STRONG = (
    ("assign", f"({_any_case('password|passwd|secret|token|api_?key')}){_SEP}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    ("identifier", f"({_any_case('access_?key_?id|client_?id|user_?name|user|login|account')}){_SEP}([A-Za-z0-9+/_.@-]+)", 2, 3),
    ("credential", "[A-Za-z0-9+/]{20,}", 0, 20),
    ("endpoint", "https?://[A-Za-z0-9.-]+(:[0-9]+)?", 0, 8),
)
KINDS = (*STRONG, *WEAK)
_IDENTIFIER, _SECRET, _ENDPOINT = (1, 3), (0, 2, 4), 5
_SPAN = "struct<start:int,rank:int,stop:int>"


def _found(rank: int) -> Column:
    """Spans of one kind in the column ``t``: leftmost, non-overlapping, long enough."""
    kind, pattern, group, least = KINDS[rank]
    p = F.lit(pattern)
    whole = F.regexp_extract_all("t", p, F.lit(0))
    counted = F.regexp_extract_all("t", p, F.lit(group))
    gaps = F.split("t", pattern, -1)
    rows = F.arrays_zip(
        F.transform(whole, F.length).alias("n"), F.transform(counted, F.length).alias("c"), F.transform(gaps, F.length).alias("gap"), whole.alias("m")
    )
    # the text behind the last match has no match of its own
    rows = F.filter(rows, lambda r: r["n"].isNotNull())
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, r):
        at = acc["at"] + r["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + r["n"]).cast("int").alias("stop"))
        good = r["c"] >= least
        if kind == "credential":
            for must in ("[0-9]", "[a-z]", "[A-Z]"):
                good = good & r["m"].rlike(must)
        return F.struct(
            (at + r["n"]).cast("int").alias("at"),
            F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(rows, start, step, lambda acc: acc["spans"])
    return F.when(F.col("t").rlike(pattern), spans).otherwise(empty)


def _named(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["stop"])), ","
    )


def _linked(scanned: DataFrame, reach: int) -> DataFrame:
    """(row, id, linked): the weak spans of a document that stand beside their complement."""
    weak = scanned.filter(F.size("weak") > 0)
    parts = weak.select("row", "id", F.explode(F.concat("strong", "weak")).alias("s"))
    role = (
        F.when(F.col("s.rank").isin(*_IDENTIFIER), F.lit("identifier")).when(F.col("s.rank").isin(*_SECRET), F.lit("secret"))
    )
    # a part lies in every cell of the grid that it covers; per cell the outermost ends are enough,
    # as a scope is wider than a cell and so cuts each cell from one side at most
    cells = (
        parts.withColumn("role", role)
        .filter("role is not null")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("s.start") / reach), F.floor((F.col("s.stop") - 1) / reach))))
        .groupBy("row", "id", "cell", "role")
        .agg(F.min("s.start").alias("first"), F.max("s.stop").alias("last"))
    )
    scopes = weak.select("row", "id", F.explode("weak").alias("s")).withColumn(
        "cell",
        F.explode(F.sequence(F.floor(F.greatest(F.col("s.start") - reach, F.lit(0)) / reach), F.floor((F.col("s.stop") + reach) / reach))),
    )
    met = (F.col("first") <= F.col("s.stop") + reach) & (F.col("last") >= F.col("s.start") - reach)
    pairs = (
        scopes.join(cells, ["row", "id", "cell"])
        .filter(met)
        .groupBy("row", "id", "s")
        .agg(
            F.max((F.col("role") == "identifier").cast("int")).alias("identifier"),
            F.max((F.col("role") == "secret").cast("int")).alias("secret"),
        )
    )
    beside = (
        F.when(F.col("s.rank") == _ENDPOINT, (F.col("identifier") == 1) & (F.col("secret") == 1))
        .when(F.col("s.rank").isin(*_IDENTIFIER), F.col("secret") == 1)
        .otherwise(F.col("identifier") == 1)
    )
    return pairs.filter(beside).groupBy("row", "id").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """``row, doc_id, strong, spans``, one row per input row.

    ``strong`` and ``spans`` are arrays of (start, rank, stop) in order of start and kind; rank
    is the place of the kind in ``KINDS``. ``spans`` are the strong ones and the weak ones that
    stand within ``reach`` code points of their complement. ``row`` is a hash of the text, by
    which a document is told from others of its doc_id.

    Null texts count as empty and have no spans. Repeated rows have the same spans. Rows
    without a doc_id are searched like any other. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    strong = F.sort_array(F.concat(*[_found(k) for k in range(len(STRONG))]))
    weak = F.concat(*[_found(k) for k in range(len(STRONG), len(KINDS))])
    scanned = scratch.keep(
        text.select(
            "doc_id",
            F.xxhash64("t").alias("row"),
            F.coalesce("doc_id", F.lit(-1)).alias("id"),
            strong.alias("strong"),
            weak.alias("weak"),
        ),
        "scanned",
    )
    return (
        scanned.join(_linked(scanned, reach), ["row", "id"], "left")
        .select(
            "row",
            "doc_id",
            "strong",
            F.when(F.col("linked").isNull(), F.col("strong"))
            .otherwise(F.sort_array(F.concat("strong", "linked")))
            .alias("spans"),
        )
    )


def _count(rank: int) -> Column:
    return F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long")


def describe(found: DataFrame) -> DataFrame:
    """Counts of the strong kinds, their digest, and all spans as text."""
    counts = [_count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(STRONG))]
    return found.select(
        "doc_id", *counts, F.sha2(_named(F.col("strong")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The documents table with every reported span replaced by a mark; ``n_chars`` follows if it is there.

    Spans that overlap or touch become one mark. Texts without spans, null ones too, stay as they are.
    """
    found = find_secrets(docs, reach).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("row").alias("__found_row"), F.coalesce("doc_id", F.lit(-1)).alias("__found_id")).agg(
        F.first("spans").alias("__spans")
    )
    keyed = docs.withColumns(
        {"__row": F.xxhash64(F.coalesce("text", F.lit(""))), "__id": F.coalesce("doc_id", F.lit(-1))}
    )
    joined = keyed.join(found, (F.col("__row") == F.col("__found_row")) & (F.col("__id") == F.col("__found_id")), "left")
    # what is left of the text: between the farthest end so far and the next start
    far = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,n:int>>)").alias("keep")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(
                (s["start"] > acc["at"]) | (F.size(acc["keep"]) == 0),
                F.array_append(
                    acc["keep"], F.struct((acc["at"] + 1).alias("at"), F.greatest(s["start"] - acc["at"], F.lit(0)).alias("n"))
                ),
            ).otherwise(acc["keep"]).alias("keep"),
        ),
        lambda acc: F.array_append(acc["keep"], F.struct((acc["at"] + 1).alias("at"), F.lit((1 << 31) - 1).alias("n"))),
    )
    clean = F.array_join(F.transform(far, lambda k: F.substring(F.col("text"), k["at"], k["n"])), mark)
    # a column of its own first: beside an alias ``text`` the name would mean that alias inside a lambda
    joined = joined.withColumn("__clean", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean))
    out = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
