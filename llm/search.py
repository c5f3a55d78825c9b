"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

The documents become blocks, each with the posting lists of the terms that are asked for; a
block is one row of a table, so nothing is shuffled to search it. For every item the lists that
are short in the whole corpus are summed, term at a time, into accumulators. These are written
beside the long lists, and their best sums give a score that the item's last hit reaches at
least. After that the accumulators are one more list with an upper bound: the second pass goes
through the documents in windows, skips every window whose bounds cannot reach that score, and
in the others drops documents as soon as what they have and what may still come falls short.
Only the hits of each block leave it.

Scores are whole numbers. A block's own statistics are added up first: documents with terms,
terms, and the documents that hold each term asked for.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Bytes of text of a block, about.
BLOCK_BYTES = 1 << 24
#: Documents that one bound covers.
WINDOW = 128
#: Windows that are scored together.
STRIDE = 8
#: An item's short lists hold at most this share of the documents together.
SHORT_SHARE = 1 / 64
#: Distinct terms that are searched for at once; more items take another pass.
TERMS_AT_ONCE = 1 << 20

_KEEP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_BLOCK = "doc_ids array<long>, sizes array<long>, terms array<int>, dfs array<int>, places binary, tfs binary"


def _block_index(docs: DataFrame, vocabulary, block_bytes: int) -> DataFrame:
    """One row a block: its documents and, for the terms asked for, the documents that hold them."""

    def run(batches):
        number = {t: k for k, t in enumerate(vocabulary.value)}
        for batch in slices(batches, "text", block_bytes):
            sizes, found = [], []
            for place, text in enumerate(batch.column("text")):
                words = terms(text.as_py())
                sizes.append(len(words))
                counts = Counter(words)
                found += [(number[t], place, counts[t]) for t in counts.keys() & number.keys()]
            flat = np.array(found, np.int64).reshape(-1, 3)
            flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
            term, df = np.unique(flat[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("doc_id")], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([term], pa.list_(pa.int32())),
                    pa.array([df], pa.list_(pa.int32())),
                    pa.array([flat[:, 1].astype("<u4").tobytes()], pa.binary()),
                    pa.array([flat[:, 2].astype("<u4").tobytes()], pa.binary()),
                ],
                ["doc_ids", "sizes", "terms", "dfs", "places", "tfs"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _norms(sizes: list[int], n: int, total: int) -> np.ndarray:
    return np.array([75 + 25 * size * n // total for size in sizes], np.int64)


def _summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, once each, with the sums of their values."""
    order = np.argsort(places, kind="stable")
    places, values = places[order], values[order]
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return places[first], np.add.reduceat(values, first) if len(first) else values


_PARTLY = (
    "doc_ids array<long>, terms array<int>, ends array<int>, places binary, values binary, "
    "items array<int>, item_ends array<int>, item_places binary, sums binary, best_items array<int>, best_sums array<long>"
)


def _accumulated(blocks: DataFrame, asked, k: int) -> DataFrame:
    """Blocks with the short lists of every item summed, term at a time, and their best ``k`` sums."""

    def run(batches):
        plan = asked.value
        for batch in batches:
            for row in batch.to_pylist():
                term = np.array(row["terms"], np.int64)
                ends = np.cumsum(np.array(row["dfs"], np.int64))
                place = np.frombuffer(row["places"], "<u4").astype(np.int64)
                tf = np.frombuffer(row["tfs"], "<u4").astype(np.int64)
                norm = _norms(row["sizes"], plan["n"], plan["total"])[place] if len(place) else place
                weight = np.repeat(plan["weights"][term], row["dfs"])
                value = weight * (1_000_000_000 * tf // (1000 * tf + 12 * norm))
                span = {t: (e - d, e) for t, d, e in zip(row["terms"], row["dfs"], ends.tolist())}
                items, sizes, places, sums, best_items, best_sums = [], [], [], [], [], []
                for item, (short, _) in enumerate(plan["items"]):
                    lists = [(span[t], q) for t, q in short if t in span]
                    if not lists:
                        continue
                    at, got = _summed(
                        np.concatenate([place[a:b] for (a, b), _ in lists]),
                        np.concatenate([value[a:b] * q for (a, b), q in lists]),
                    )
                    items.append(item)
                    sizes.append(len(at))
                    places.append(at.astype("<u4"))
                    sums.append(got.astype("<i8"))
                    top = got if len(got) <= k else np.partition(got, len(got) - k)[-k:]
                    best_items += [item] * len(top)
                    best_sums += top.tolist()
                long = np.isin(term, plan["long"])
                keep = np.repeat(long, row["dfs"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"]], pa.list_(pa.int64())),
                        pa.array([term[long]], pa.list_(pa.int32())),
                        pa.array([np.cumsum(np.array(row["dfs"], np.int64)[long])], pa.list_(pa.int32())),
                        pa.array([place[keep].astype("<u4").tobytes()], pa.binary()),
                        pa.array([value[keep].astype("<i8").tobytes()], pa.binary()),
                        pa.array([items], pa.list_(pa.int32())),
                        pa.array([np.cumsum(sizes, dtype=np.int64)], pa.list_(pa.int32())),
                        pa.array([b"".join(x.tobytes() for x in places)], pa.binary()),
                        pa.array([b"".join(x.tobytes() for x in sums)], pa.binary()),
                        pa.array([best_items], pa.list_(pa.int32())),
                        pa.array([best_sums], pa.list_(pa.int64())),
                    ],
                    [x.split()[0] for x in _PARTLY.split(", ")],
                )

    return blocks.mapInArrow(run, _PARTLY)


class _Bounded:
    """A list of (place, value) in order, with the largest value of each window."""

    def __init__(self, places: np.ndarray, values: np.ndarray, windows: int):
        self.places, self.values = places, values
        self.most = np.zeros(windows, np.int64)
        np.maximum.at(self.most, places // WINDOW, values)

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """Values of the wanted places (in order), 0 where the list has none."""
        a, b = np.searchsorted(self.places, (wanted[0], wanted[-1] + 1))
        out = np.zeros(len(wanted), np.int64)
        if a < b:
            near = np.minimum(np.searchsorted(self.places[a:b], wanted), b - a - 1) + a
            hit = self.places[near] == wanted
            out[hit] = self.values[near[hit]]
        return out


def _hits(lists: list[tuple[_Bounded, int]], ids: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` best documents of a block with at least ``least``, best first.

    Of equal scores the smaller ``ids`` come first.
    """
    lists = sorted(lists, key=lambda x: -int(x[0].most.max() * x[1]))
    bounds = [x.most * q for x, q in lists]
    # what the lists from here on may still add, window by window
    rest = np.cumsum(np.stack(bounds)[::-1], axis=0)[::-1]
    best_places, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.flatnonzero(rest[0] >= least)
    for start in range(0, len(windows), STRIDE):
        here = windows[start : start + STRIDE]
        here = here[rest[0][here] >= least]
        if not len(here):
            continue
        places = (here[:, None] * WINDOW + np.arange(WINDOW)).ravel()
        scores = np.zeros(len(places), np.int64)
        for depth, (x, q) in enumerate(lists):
            scores += x.at(places) * q
            if depth + 1 < len(lists):
                alive = scores + rest[depth + 1][places // WINDOW] >= least
                places, scores = places[alive], scores[alive]
                if not len(places):
                    break
        good = scores >= least
        if good.any():
            best_places = np.concatenate([best_places, places[good]])
            best_scores = np.concatenate([best_scores, scores[good]])
            first = np.lexsort((ids[best_places], -best_scores))[:k]
            best_places, best_scores = best_places[first], best_scores[first]
            if len(best_scores) == k:
                least = max(least, int(best_scores[-1]))
    return best_places, best_scores


def _searched(partly: DataFrame, asked, least, k: int) -> DataFrame:
    """(item, doc_id, score): the hits of every block that may be among an item's best ``k``."""

    def run(batches):
        plan, reach = asked.value, least.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = pa.array(row["doc_ids"], pa.int64())
                order = ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
                windows = -(-len(ids) // WINDOW)
                place = np.frombuffer(row["places"], "<u4").astype(np.int64)
                value = np.frombuffer(row["values"], "<i8")
                begins = dict(zip(row["terms"], zip([0, *row["ends"]], row["ends"])))
                made: dict[int, _Bounded] = {}
                summed = dict(zip(row["items"], zip([0, *row["item_ends"]], row["item_ends"])))
                at, sums = np.frombuffer(row["item_places"], "<u4").astype(np.int64), np.frombuffer(row["sums"], "<i8")
                out: list[tuple] = []
                for item, (_, long) in enumerate(plan["items"]):
                    lists = []
                    for t, q in long:
                        if t in begins:
                            if t not in made:
                                a, b = begins[t]
                                made[t] = _Bounded(place[a:b], value[a:b], windows)
                            lists.append((made[t], q))
                    if item in summed:
                        a, b = summed[item]
                        lists.append((_Bounded(at[a:b], sums[a:b], windows), 1))
                    if lists:
                        found, scores = _hits(lists, order, max(1, reach.get(item, 1)), k)
                        out += [(item, p, s) for p, s in zip(found.tolist(), scores.tolist())]
                if out:
                    item, p, s = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.int32()), ids.take(pa.array(p, pa.int64())), pa.array(s, pa.int64())],
                        ["item", "doc_id", "score"],
                    )

    return partly.mapInArrow(run, "item int, doc_id long, score long")


def _plan(wanted: list[Counter], dfs: dict[int, int], n: int, total: int, number: dict[bytes, int], short_share: float) -> dict:
    """Weights of the terms, and the short and long lists of every item, each with its repeats."""
    weights = np.zeros(len(number), np.int64)
    for t, df in dfs.items():
        weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    items = []
    for counts in wanted:
        known = sorted((dfs[number[t]], number[t], q) for t, q in counts.items() if number[t] in dfs)
        room, short, long = int(n * short_share), [], []
        for df, t, q in known:
            room -= df
            (short if room >= 0 else long).append((t, q))
        items.append((short, long))
    return {"n": n, "total": total, "weights": weights, "items": items, "long": sorted({t for _, long in items for t, _ in long})}


def _best(rows: DataFrame, by: list, k: int) -> DataFrame:
    """The first ``k`` rows of each item; every task hands on ``k`` an item at most."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(*by))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    short_share: float = SHORT_SHARE,
    block_bytes: int = BLOCK_BYTES,
    terms_at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` (whole numbers) and ``text``, ``items`` has ``item_id`` and ``text``;
    other columns are not read. All documents are ranked; those with score 0 are left out, so an
    item may have fewer hits or none. Equal scores are ranked by doc_id, documents without one
    last. Null and empty texts have no terms: such documents count nowhere and such items find
    nothing. Rows that repeat are documents, or items, of their own. Items are searched for in as
    many passes as their distinct terms need at ``terms_at_once``; only these and three numbers a
    term reach the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")

    def read(batches):
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.binary()))], ["key", "terms"])

    keyed = scratch.keep(items.select("item_id", "text", F.monotonically_increasing_id().alias("key")), "items")
    asked_terms = scratch.keep(keyed.select("key", "text").mapInArrow(read, "key long, terms array<binary>"), "terms")
    total = asked_terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // terms_at_once))
    hits = None
    for part in range(passes):
        own = asked_terms.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == part)
        found = _search(docs, own.filter(F.size("terms") > 0).collect(), k, short_share, block_bytes, scratch)
        hits = found if hits is None else hits.unionByName(found)
    return keyed.join(hits, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(docs, asked_rows, k, short_share, block_bytes, scratch) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    nothing = spark.createDataFrame([], "key long, rank int, doc_id long, score long")
    wanted = [Counter(bytes(t) for t in row["terms"]) for row in asked_rows]
    vocabulary = sorted(set().union(*wanted)) if wanted else []
    if not vocabulary:
        return nothing
    blocks = scratch.keep(_block_index(docs, context.broadcast(vocabulary), block_bytes), "blocks")
    some = F.filter("sizes", lambda x: x > 0)
    sums = blocks.select(F.size(some).alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    n, total = sums.agg(F.sum("n"), F.sum("t")).first()
    if not total:
        return nothing
    held = blocks.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy("terms").agg(F.sum("dfs").alias("df"))
    dfs = {row["terms"]: row["df"] for row in held.collect()}
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = context.broadcast(_plan(wanted, dfs, n, total, number, short_share))

    partly = scratch.keep(_accumulated(blocks, asked, k), "partly")
    scratch.drop(blocks)
    sums = partly.select(F.inline(F.arrays_zip(F.col("best_items").alias("item"), F.col("best_sums").alias("score"))))
    # what a document has from some lists is at most its score: the item's k-th best reaches this at least
    reach = _best(sums, [F.desc("score")], k).filter(F.col("rank") == k)
    least = context.broadcast({row["item"]: row["score"] for row in reach.collect()})
    hits = _best(_searched(partly.drop("best_items", "best_sums"), asked, least, k), [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    keys = F.lit(",".join(str(row["key"]) for row in asked_rows))
    return hits.select(F.get(F.split(keys, ",").cast("array<long>"), F.col("item")).alias("key"), "rank", "doc_id", "score")
