"""Importance resampling: a ratio of hashed n-gram models, sampled by Gumbel top-k.

The models count hashed features of texts: byte 4-grams, and for every word how far back it
stood last (which tells prose from text that repeats itself). The raw model counts all
documents, labelled or not, and the target model the labelled good rows. A ratio of the two is
smoothed in two steps, target to labelled rows and labelled rows to raw text: what labels hold
a little less of by chance costs little, what they hold nothing of counts against a document.
The features of a text depend on each other, so a long text counts as ``units`` of them.

Rows that are good but for being toxic differ from the target by a few words only, which the sum
over a whole text would drown. They have a model of their own: the target's words, of which some
are more frequent. Those are the words that far more toxic rows hold than the target's rates
explain, beyond what chance does to any of all buckets. What a document is weighed against is
the mixture of the raw model and this one. Its log ratio is perturbed by Gumbel noise of its
doc_id, and the k largest stay, where k is the number of documents the models expect to be of
the target: the sum of min(1, share of the target * ratio).
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kth_largest, slices
from .words import mix, word_hashes

_GRAM = 4
#: Independent features a text counts as, at most.
UNITS = 256
#: What words are made of: letters in lower case, digits, anything beyond ASCII.
_PLAIN = bytes(c | 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class Models(NamedTuple):
    """What documents are scored with.

    ``ratio`` is the log ratio of target to raw text by bucket, ``odds`` that of toxic rows to the
    target by word bucket. ``step`` is what a word without odds speaks against toxic, ``lead`` how
    much more frequent the target is, infinite without toxic rows. ``share`` is the target's share
    of the labelled rows.
    """

    ratio: np.ndarray
    odds: np.ndarray
    step: float
    lead: float
    share: float


def features(text: bytes, bits: int = 18) -> np.ndarray:
    """Buckets of a text's features; none for a text without words."""
    h, _ = word_hashes([text])
    if not len(h):
        return np.zeros(0, np.int64)
    data = np.frombuffer(b"  " + text + b"  ", np.uint8).astype(np.uint64)
    gram = np.zeros(len(data) - _GRAM + 1, np.uint64)
    for k in range(_GRAM):
        gram |= data[k : len(data) - _GRAM + 1 + k] << np.uint64(8 * k)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    back = np.full(len(h), 255, np.uint64)
    back[order[1:][again]] = np.log2(order[1:][again] - order[:-1][again]).astype(np.uint64)
    every = np.concatenate([2 * gram, 2 * back + 1])
    return (mix(every) >> np.uint64(64 - bits)).astype(np.int64)


def vocabulary(text: bytes, bits: int = 18) -> np.ndarray:
    """Buckets of a text's distinct words, without case and punctuation of ASCII."""
    h, _ = word_hashes([text.translate(_PLAIN)])
    return np.unique((mix(h) >> np.uint64(64 - bits)).astype(np.int64))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


#: Kinds of labelled rows; a doc_id labelled twice counts by the smaller.
_BAD, _TOXIC, _GOOD = range(3)


def _counts(rows: DataFrame, bits: int, words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(counts by bucket, rows by kind) of a table of ``text, kind``.

    The counts have four columns: features of all rows and of good rows, words of toxic rows and of
    good rows (once a row). Tasks sum up before the shuffle, so a task sends 2 ** bits rows at most
    and no text.
    """
    size = 1 << bits

    def run(batches):
        sums = np.zeros((size, 4), np.int64)
        n = np.zeros(3, np.int64)
        for batch in slices(batches, "text"):
            for text, kind in zip(_texts(batch.column("text")), batch.column("kind").to_pylist()):
                f = features(text, bits)
                if len(f) > 1 << 14:
                    counted = np.bincount(f, minlength=size)
                    sums[:, 0] += counted
                    sums[:, 1] += counted * (kind == _GOOD)
                else:
                    np.add.at(sums[:, 0], f, 1)
                    if kind == _GOOD:
                        np.add.at(sums[:, 1], f, 1)
                if words and kind != _BAD:
                    sums[vocabulary(text, bits), 2 if kind == _TOXIC else 3] += 1
                n[kind] += 1
        found = np.flatnonzero(sums.any(axis=1))
        columns = [np.append(found, -1)] + [np.append(sums[found, c], n[c] if c < 3 else 0) for c in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", *names])

    names = ["every", "good", "toxic_words", "good_words"]
    found = (
        rows.mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in names])
        .toArrow()
    )
    bucket = found.column("bucket").to_numpy()
    values = np.stack([found.column(c).to_numpy() for c in names], axis=1).reshape(-1, 4)
    sums = np.zeros((size, 4))
    sums[bucket[bucket >= 0]] = values[bucket >= 0]
    return sums, values[bucket < 0].sum(axis=0)[:3]


def _toxic_odds(toxic: np.ndarray, good: np.ndarray, bits: int) -> tuple[np.ndarray, float]:
    """(log odds of each word bucket, log of what they sum to over the target's words).

    Expected is the weighted median rate of toxic to good rows over the words of toxic ones, which
    is that of ordinary words in whatever languages toxic rows are in. A bucket stands out if its
    deviance from that is beyond what one in 2 ** bits buckets has by chance.
    """
    both = np.flatnonzero((toxic > 0) & (good > 0))
    odds = np.zeros(len(toxic))
    if not len(both):
        return odds, 0.0
    rate = toxic[both] / good[both]
    order = np.argsort(rate, kind="stable")
    mass = np.cumsum(toxic[both][order])
    expected = rate[order][np.searchsorted(mass, mass[-1] / 2)] * (good + 1)
    deviance = 2 * (toxic * np.log(np.maximum(toxic, 1) / expected) - (toxic - expected))
    out = (toxic > expected) & (deviance > 2 * bits * math.log(2))
    odds[out] = np.log((toxic[out] + 1) / (expected[out] + 1))
    return odds, float(np.log1p((good / good.sum() * np.expm1(odds)).sum()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 18,
    prior: float = 4.0,
    sample: int | None = None,
    raw_prior: float = 1000.0,
) -> Models:
    """The models of a corpus and its labels.

    The raw model counts every row of ``docs``. The labelled rows are all counted too, or about
    ``sample`` of them, chosen by a hash of doc_id. ``prior`` smooths target to labelled rows,
    ``raw_prior`` labelled rows to raw text; both are counts a bucket.

    ``labels`` has doc_id, quality and toxic; the target are rows of quality 1 that are not
    toxic. Rows without a label, or whose quality is null, count for the raw model alone; a doc_id
    labelled twice counts by its worse label. Without good rows every ratio is 1. What reaches the
    driver are twice 2 ** bits rows of counts, whatever the size of the table.
    """
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    mark = F.when(F.col("quality") != 1, _BAD).when(toxic, _TOXIC).otherwise(_GOOD)
    kind = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(mark).alias("kind"))
    if sample is not None:
        share = min(1.0, sample / max(kind.count(), 1))
        kind = kind.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    # the labels are hashed, so that texts are not sorted
    marked = docs.select("doc_id", "text").join(kind.hint("shuffle_hash"), "doc_id").select("text", "kind")
    sums, n = _counts(marked, bits)
    labelled, target, toxic_words, good_words = sums.T
    if not target.sum():
        return Models(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, math.inf, n[_GOOD] / n.sum() if n.sum() else 1.0)
    raw = _counts(docs.select("text", F.lit(_BAD).alias("kind")), bits, words=False)[0][:, 0]
    of_good, of_raw = target.sum() / labelled.sum(), labelled.sum() / raw.sum()
    ratio = np.log((target + prior * of_good) / ((labelled + prior) * of_good))
    ratio += np.log((labelled + raw_prior * of_raw) / ((raw + raw_prior) * of_raw))
    odds, step = _toxic_odds(toxic_words, good_words, bits)
    lead = math.log(n[_GOOD] / n[_TOXIC]) if n[_TOXIC] else math.inf
    return Models(ratio, odds, step, lead, n[_GOOD] / n.sum())


def log_ratio(text: bytes, models: Models) -> float | None:
    """Log ratio of the target to the mixture of raw and toxic text; null without words."""
    bits = len(models.ratio).bit_length() - 1
    f = features(text, bits)
    if not len(f):
        return None
    raw = float(models.ratio[f].sum()) * min(1.0, UNITS / len(f))
    if models.lead == math.inf:
        return raw
    words = vocabulary(text, bits)
    toxic = models.lead + models.step * len(words) - float(models.odds[words].sum())
    return float(-np.logaddexp(-raw, -toxic))


def _scores(texts: pa.Array, models: Models) -> pa.Array:
    return pa.array([log_ratio(t, models) for t in _texts(texts)], pa.float64())


def score(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, log_ratio), one row per input row: null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in slices(batches, "text"):
            out = _scores(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "log_ratio"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_ratio double")


def with_score(docs: DataFrame, models: Models) -> DataFrame:
    """(row, log_ratio): ``row`` is the whole input row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in slices(batches, "row"):
            out = _scores(batch.column("row").field("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), out], ["row", "log_ratio"])

    return rows.mapInArrow(run, rows.select("row").schema.add("log_ratio", "double"))


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that follows from a key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _key(doc_id: str, seed: int) -> Column:
    return F.col("log_ratio") + gumbel(F.coalesce(doc_id, F.lit(-1)), seed)


def _at_least(key: Column, least: float | None) -> Column:
    return F.lit(False) if least is None else F.coalesce(key >= F.lit(least), F.lit(False))


def _sampled(docs, labels, bits, prior, seed, share, sample):
    """(models, table of log ratios and keys, smallest key that is kept, scratch)."""
    models = fit(docs, labels, bits, prior, sample)
    scratch = Scratch(docs.sparkSession, "quality")
    keyed = scratch.keep(score(docs, models).withColumn("gumbel_key", _key("doc_id", seed)), "keys")
    likely = F.least(F.lit(1.0), F.lit(float(models.share)) * F.exp(F.least("log_ratio", F.lit(50.0))))
    n, expected = keyed.agg(F.count(F.lit(1)), F.sum(likely)).first()
    k = round(share * n) if share is not None else round(expected or 0)
    return models, keyed, kth_largest(keyed, "gumbel_key", k), scratch


def resample(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 18,
    prior: float = 4.0,
    seed: int = 11,
    share: float | None = None,
    sample: int | None = None,
) -> DataFrame:
    """``doc_id, log_ratio, gumbel_key, kept``, one row per input row.

    Kept are the k largest of log ratio + Gumbel noise; k follows from the models, or is
    ``share`` of the rows. ``sample`` is that of :func:`fit`. The noise hangs on the doc_id alone:
    repeated rows are kept or rejected together, and all rows tied with the k-th are kept. Null texts and texts without
    words have a null log_ratio and are rejected. Rows without a doc_id are scored, share one
    noise and are kept like any other. Extra columns are not read.
    """
    _, keyed, least, _ = _sampled(docs, labels, bits, prior, seed, share, sample)
    return keyed.withColumn("kept", _at_least(F.col("gumbel_key"), least))


def keep_target(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 18,
    prior: float = 4.0,
    seed: int = 11,
    share: float | None = None,
    sample: int | None = None,
) -> DataFrame:
    """The documents that :func:`resample` keeps, with all their columns.

    The texts are scored again where they lie, which costs less than to shuffle them to their keys.
    """
    models, keyed, least, scratch = _sampled(docs, labels, bits, prior, seed, share, sample)
    scratch.drop(keyed)
    return with_score(docs, models).filter(_at_least(_key("row.doc_id", seed), least)).select("row.*")
