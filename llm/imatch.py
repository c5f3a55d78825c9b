"""I-Match fingerprints: distinct terms of a document-frequency band, hashed per lexicon subset.

Everything is SQL expressions: no Python runs on the executors. The lexicon holds the terms
that occur in a share of the documents between ``rarest`` and ``commonest``; as a document
has D distinct terms on average, it holds at most D / rarest of them however many documents
there are, which is what makes it fit for a broadcast. Every subset takes a term by a hash of
its own: ``REPEATS`` subsets for each of several rates, so that short and long texts both have
subsets in which they have few terms and which an edit elsewhere leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subsets take a term with probability 2 ** -r.
RATES = (2, 4, 6, 8, 10)
REPEATS = 8
RAREST, COMMONEST = 1 / 4000, 1 / 20
_SUBSETS = [(rate, n) for rate in RATES for n in range(REPEATS)]
_EMPTY = "00000000"


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, lower case; the empty one may be among them."""
    return F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))


def _drawn() -> Column:
    """The parts of a fingerprint a term counts in: 0, the whole list, and the subsets that draw it."""

    def subset(k: int, rate: int, n: int) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{rate}.{n}:"), "term")), 1, 4), 16, 10).cast("int")
        return F.when(number < (1 << 16 >> rate), F.lit(k + 1))

    drawn = [subset(k, rate, n) for k, (rate, n) in enumerate(_SUBSETS)]
    return F.array_compact(F.array(F.lit(0), *drawn))


def lexicon(texts: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """(term, drawn) of the terms whose share of the rows of ``texts`` (column ``t``) lies in the band."""
    n = texts.count()
    counted = texts.select(F.explode(terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    least, most = max(2, n * rarest), max(2, n * commonest)
    return counted.filter(F.col("df").between(F.lit(least), F.lit(most)) & (F.col("term") != "")).select(
        "term", _drawn().alias("drawn")
    )


def likeness(a: Column, b: Column) -> Column:
    """1 if the whole lists are equal, else the largest share of equal subsets among those of one rate.

    Subsets that are empty on both sides say nothing and are left out. At some rate a text has
    about one term a subset, whatever its length; there an edit changes subsets in proportion.
    """

    def rate(k: int) -> Column:
        pairs = F.arrays_zip(
            F.slice(a, 2 + k * REPEATS, REPEATS).alias("a"), F.slice(b, 2 + k * REPEATS, REPEATS).alias("b")
        )
        some = F.filter(pairs, lambda p: (p["a"] != _EMPTY) | (p["b"] != _EMPTY))
        same = F.filter(some, lambda p: p["a"] == p["b"])
        return F.size(same) / F.greatest(F.size(some), F.lit(1))

    whole = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("double")
    return F.greatest(whole, *[rate(k) for k in range(len(RATES))])


def _numbers(values: list[int]) -> Column:
    """An array of numbers as one literal, not an expression for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _blocks(docs: DataFrame, count: int) -> tuple[DataFrame, list[int], list[int]]:
    """(rows with ``block``, highest id of each block, block above it).

    Blocks are ranges of ids of about equal size; only one id a block reaches the driver.
    """
    shares = [k / count for k in range(1, count)]
    edges = docs.agg(F.percentile_approx("id", shares, max(10_000, 10 * count))).first()[0] if count > 1 else []
    edges = sorted(set(edges or []))
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    if edges:
        table = _numbers(edges)
        block = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) < F.col("id"), F.lit(False)), at + s).otherwise(at),
        )
    else:
        block = F.lit(0)
    rows = docs.withColumn("block", block)
    top = {r.block: r.top for r in rows.groupBy("block").agg(F.max("id").alias("top")).collect()}
    filled = sorted(top)
    above = {b: filled[(k + 1) % len(filled)] for k, b in enumerate(filled)}
    numbers = range(len(edges) + 1)
    # blocks without rows are never looked up
    return rows, [top.get(b, 0) for b in numbers], [above.get(b, 0) for b in numbers]


def with_next(docs: DataFrame) -> DataFrame:
    """(block, place, guest, doc_id, t, next): each text and that of the next smaller doc_id.

    After the smallest comes the largest. Rows that share a doc_id are ordered by text, rows
    without one come last. ``guest`` rows are the heads of the block below, one a block or as
    many as repeat its doc_id; they stand behind the rows of their block.
    """
    rows = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("text", F.lit("")).alias("t")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, top, above = _blocks(rows, 4 * parts)  # several a partition, so that partitions are alike
    head = F.col("id") == F.get(_numbers(top), F.col("block"))
    up = F.get(_numbers(above), F.col("block")).cast("int")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    places = F.when(head, F.array(own, F.struct(up.alias("block"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    order = Window.partitionBy("block").orderBy("guest", F.desc("id"), "t")
    return (
        rows.withColumn("places", places)
        .select("doc_id", "id", "t", F.inline("places"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("next", F.lead("t").over(order))
        .select("block", "place", "guest", "doc_id", "t", F.coalesce("next", F.lit("")).alias("next"))
    )


def _by_part(found: str) -> Column:
    """(part, term) in order, out of a list of terms and the parts that draw them."""
    pairs = F.transform(
        found, lambda x: F.transform(x["drawn"], lambda part: F.struct(part.alias("part"), x["term"].alias("term")))
    )
    return F.sort_array(F.flatten(pairs))


def _terms_of_parts(pairs: str) -> Column:
    """A map of each part to its terms, joined by a blank, out of the column of :func:`_by_part`."""

    def written(x: Column, at: Column) -> Column:
        again = F.get(pairs, at - 1)["part"] == x["part"]
        return F.concat(F.when(again, F.lit(" ")).otherwise(F.concat(F.lit("\n"), x["part"], F.lit(":"))), x["term"])

    # terms are letters and digits: neither line break nor colon is in one
    lines = F.substr(F.array_join(F.transform(pairs, written), ""), F.lit(2))
    return F.str_to_map(lines, F.lit("\n"), F.lit(":"))


def fingerprint_edits(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Fingerprints of texts and of their edited forms, one row per input row.

    The edited text is the text with its last third replaced by as many code points from the
    start of the next document. Columns: ``doc_id, n_chars, edited_sha256, parts,
    edited_parts, near_edited, near_next``; ``parts`` holds 8 hex digits for the band's terms
    as a whole and for each lexicon subset, zeros for a subset without terms.

    Null texts count as empty. A text without terms in the band has the hash of the whole text
    as its first part, so only equal texts are alike then. Equal texts have equal parts.
    Repeated rows come out repeated; extra columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("t"))
    band = lexicon(texts, rarest, commonest)
    third = F.floor(F.length("t") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("t"), F.lit(1), F.length("t") - third), F.substring(F.col("next"), F.lit(1), third)
    )
    rows = with_next(docs).withColumn("edited", edited)
    # what is known of the row itself leads the list of its terms; no term has a bar in it
    about = F.concat_ws(
        "|",
        F.col("guest").cast("string"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.length("t").cast("string"),
        F.sha2("edited", 256),
        F.substring(F.md5("t"), 1, 8),
        F.substring(F.md5("edited"), 1, 8),
    )
    listed = rows.select("block", "place", about.alias("about"), terms(F.col("t")).alias("own"), terms(F.col("edited")).alias("changed"))
    said = listed.select(
        "block", "place", F.size("own").alias("n"), F.posexplode(F.concat(F.array("about"), "own", "changed")).alias("pos", "term")
    )
    first, drawn = F.col("pos") == 0, F.struct("term", "drawn")
    # one row a term until here: its parts are told apart inside the list of its text
    rows = (
        said.join(F.broadcast(band), "term", "left")
        .filter(first | F.col("drawn").isNotNull())
        .groupBy("block", "place")
        .agg(
            F.split(F.max(F.when(first, F.col("term"))), "\\|").alias("about"),
            F.collect_list(F.when(~first & (F.col("pos") <= F.col("n")), drawn)).alias("own"),
            F.collect_list(F.when(~first & (F.col("pos") > F.col("n")), drawn)).alias("changed"),
        )
    )

    # each step is a column of its own, as an expression used by others would be worked out anew by each
    for step in (_by_part, _terms_of_parts):
        rows = rows.select("block", "place", "about", step("own").alias("own"), step("changed").alias("changed"))

    def parts(found: str, fallback: int) -> Column:
        def digest(part: Column) -> Column:
            return F.substring(F.md5(F.try_element_at(found, part)), 1, 8)

        whole = F.coalesce(digest(F.lit("0")), F.get("about", F.lit(fallback)))
        numbers = F.split(F.lit(",".join(str(k + 1) for k in range(len(_SUBSETS)))), ",")
        return F.concat(F.array(whole), F.transform(numbers, lambda k: F.coalesce(digest(k), F.lit(_EMPTY))))

    parted = rows.select(
        "block",
        "place",
        (F.get("about", F.lit(0)) == "true").alias("guest"),
        F.when(F.get("about", F.lit(1)) != "", F.get("about", F.lit(1)).cast("long")).alias("doc_id"),
        F.get("about", F.lit(2)).cast("long").alias("n_chars"),
        F.get("about", F.lit(3)).alias("edited_sha256"),
        parts("own", 4).alias("parts"),
        parts("changed", 5).alias("edited_parts"),
    )
    following = F.lead("parts").over(Window.partitionBy("block").orderBy("place"))
    return (
        parted.withColumn("next_parts", following)
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "parts",
            "edited_parts",
            likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
            likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
        )
    )
