"""Repeated word spans by a sparse de Bruijn graph over token k-mers.

Edges of the graph are windows of ``window`` words. A window is filed under its smallest
k-mer of ``anchor`` words, so equal windows always meet under the same k-mer, and the windows
of one k-mer lie next to each other: a row of the shuffle is a k-mer with the run of windows
filed under it, not a window.

1. *Edges.* Each task hashes its texts, settles what repeats inside a chunk of texts (the
   earliest stays), and packs the rest by k-mer into buckets. A passage that a third of all
   texts share is thus one row a chunk, not one a text.
2. *Sources.* A bucket finds for each window its first occurrence (smallest doc_id, then
   start). Later ones become path pieces: neighbours in one text whose sources are
   neighbours too, (text, start, count, source text, source start).
3. *Compaction.* Pieces of one text that go on along the same source are joined to maximal
   nonbranching paths; where the source changes, a path ends. Their union is what goes.

A path carries the coordinates of its source, so a run of windows is only taken for one path
where text and source advance together. Windows are equal if the 64-bit hash of their k-mer and 32 further bits of the whole window
agree: at 10^13 windows fewer than one accidental match is expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .words import chunks, mix, shingle_hashes, word_hashes

#: Stands for a missing doc_id: such rows come after all others.
LAST = (1 << 63) - 1
_PIECE = np.dtype(
    [("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("count", "<i4"), ("source", "<i8"), ("source_start", "<i4")]
)


def _windows(texts: list[bytes], window: int, anchor: int):
    """(anchor hash, window hash, text number, start) of all windows of some texts."""
    h, text = word_hashes(texts)
    if len(h) < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    begins = np.searchsorted(text, np.arange(len(texts)))
    least = shingle_hashes(h, anchor)
    # smallest of the window's k-mers, by doubling
    width, span = window - anchor + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    whole = shingle_hashes(h, window)
    inside = text[: len(whole)] == text[window - 1 :]
    text = text[: len(whole)][inside]
    start = np.flatnonzero(inside) - begins[text]
    return least[inside], whole[inside], text, start


def _later_copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that have an equal key before them, position of the first one with that key)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = ~new
    at = order[late]
    back = np.argsort(at, kind="stable")
    return at[back], first[late][back]


def _pieces(doc, text, start, source, source_start) -> np.ndarray:
    """Runs of windows that follow each other in the text and in the source."""
    if not len(doc):
        return np.zeros(0, _PIECE)
    new = np.ones(len(doc), bool)
    new[1:] = (
        (doc[1:] != doc[:-1])
        | (text[1:] != text[:-1])
        | (source[1:] != source[:-1])
        | (start[1:] != start[:-1] + 1)
        | (source_start[1:] != source_start[:-1] + 1)
    )
    at = np.flatnonzero(new)
    out = np.zeros(len(at), _PIECE)
    out["doc"], out["text"], out["start"] = doc[at], text[at], start[at]
    out["count"] = np.diff(np.append(at, len(doc)))
    out["source"], out["source_start"] = source[at], source_start[at]
    return out


def _pack(anchor, check, doc_no, start, doc, text) -> bytes:
    """Rows of one bucket: a k-mer, where its run of windows begins, and their check hashes."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc_no[1:] != doc_no[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(anchor))).astype("<i4")
    docs, place = np.unique(doc_no[at], return_inverse=True)
    head = np.array([len(docs), len(at), len(anchor)], "<i4")
    parts = (doc[docs], text[docs], place.astype("<i4"), start[at].astype("<i4"), count, anchor[at], check)
    return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])


def _unpack(blob: bytes):
    docs, runs, rows = np.frombuffer(blob, "<i4", 3).tolist()
    at, out = 12, []
    for n, kind in ((docs, "<i8"), (docs, "<i8"), (runs, "<i4"), (runs, "<i4"), (runs, "<i4"), (runs, "<u8"), (rows, "<u4")):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc, text, place, start, count, anchor, check = out
    first = np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(start, count) + (np.arange(rows) - first)
    return np.repeat(anchor, count), check, np.repeat(doc[place], count), np.repeat(text[place], count), starts


def _edges(buckets: int, window: int, anchor: int):
    def run(batches):
        for batch in slices(batches, "text", 1 << 23):
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = batch.column("text").cast(pa.binary())
            data = [texts[int(k)].as_py() or b"" for k in order]
            name = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in data), np.uint64, len(data)).view(np.int64)
            ids = ids[order]
            for a, b in chunks(data):
                yield from chunk(data[a:b], ids[a:b], name[a:b])

    def chunk(data, ids, name):
        least, whole, no, start = _windows(data, window, anchor)
        if not len(whole):
            return
        late, first = _later_copies(whole)
        # rows that repeat a doc_id and a text are one document, so nothing in them is later
        earlier = (ids[no[late]] != ids[no[first]]) | (start[late] != start[first])
        late, first = late[earlier], first[earlier]
        own = _pieces(ids[no[late]], name[no[late]], start[late], ids[no[first]], start[first])
        alone = np.ones(len(whole), bool)
        alone[late] = False
        least, check, no, start = least[alone], whole[alone].astype(np.uint32), no[alone], start[alone]
        bucket = (mix(least) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        holder = int(name[0]) % len(cuts)  # any bucket may pass on what the chunk settled itself
        numbers, edges, pieces = [], [], []
        for k, (at, to) in enumerate(zip(cuts, np.append(cuts[1:], len(order)))):
            rows = order[at:to]
            numbers.append(int(bucket[rows[0]]))
            edges.append(_pack(least[rows], check[rows], no[rows], start[rows], ids, name))
            pieces.append(own.tobytes() if k == holder and len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(edges, pa.binary()), pa.array(pieces, pa.binary())],
            ["bucket", "edges", "pieces"],
        )

    return run


def _sources(table: pa.Table) -> pa.Table:
    """Later occurrences in one bucket as path pieces, with what the tasks had settled before."""
    found = [np.frombuffer(p.as_py(), _PIECE) for p in table.column("pieces") if p.is_valid]
    parts = [_unpack(b.as_py()) for b in table.column("edges") if b.is_valid]
    anchor, check, doc, text, start = (np.concatenate(x) for x in zip(*parts))
    key = mix(anchor + mix(check.astype(np.uint64)))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    rows = order[same[1:] | same[:-1]]  # of keys that occur more than once
    rows = rows[np.lexsort((start[rows], doc[rows], check[rows], anchor[rows]))]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (anchor[rows[1:]] != anchor[rows[:-1]]) | (check[rows[1:]] != check[rows[:-1]])
        first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = (doc[rows] != doc[first]) | (start[rows] != start[first])
        rows, first = rows[late], first[late]
        order = np.lexsort((start[rows], text[rows], doc[rows]))
        rows, first = rows[order], first[order]
        found.append(_pieces(doc[rows], text[rows], start[rows], doc[first], start[first]))
    out = np.concatenate(found) if found else np.zeros(0, _PIECE)
    return pa.table({n: np.ascontiguousarray(out[n]) for n in _PIECE.names})


def repeated_paths(docs: DataFrame, window: int = 20, anchor: int = 8) -> DataFrame:
    """(doc, text, start, words, source, source_start): maximal spans that also start earlier.

    ``doc`` is the doc_id (the largest long if missing), ``text`` the xxhash64 of the text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.select("doc_id", "text").mapInArrow(
        _edges(4 * parts, window, anchor), "bucket int, edges binary, pieces binary"
    )
    pieces = edges.groupBy("bucket").applyInArrow(
        _sources, "doc long, text long, start int, count int, source long, source_start int"
    )
    along = Window.partitionBy("doc", "text").orderBy("start")
    goes_on = (
        (F.lag("source").over(along) == F.col("source"))
        & (F.lag(F.col("start") + F.col("count")).over(along) == F.col("start"))
        & (F.lag(F.col("source_start") + F.col("count")).over(along) == F.col("source_start"))
    )
    return (
        pieces.withColumn("path", F.when(goes_on, 0).otherwise(1))
        .withColumn("path", F.sum("path").over(along))
        .groupBy("doc", "text", "path")
        .agg(
            F.min("start").alias("start"),
            (F.sum("count") + (window - 1)).cast("int").alias("words"),
            F.first("source").alias("source"),
            F.min("source_start").alias("source_start"),
        )
        .drop("path")
    )


def _cut(batches):
    for batch in slices(batches, "t"):
        texts = batch.column("t").cast(pa.binary())
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts, batch.column("spans")):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            if spans.is_valid:
                start, count = (spans.values.field(k).to_numpy() for k in (0, 1))
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + count, -1)
                stay = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, stay.tolist()) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("spans"), pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["row", "spans", "n_words", "n_removed", "kept_text"],
        )


def _removed(docs: DataFrame, carry: list[str], window: int, anchor: int) -> DataFrame:
    """(row, spans, n_words, n_removed, kept_text); ``row`` holds the columns to carry along."""
    paths = repeated_paths(docs, window, anchor)
    spans = paths.groupBy("doc", "text").agg(
        F.sort_array(F.collect_list(F.struct("start", "words", "source", "source_start"))).alias("spans")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col("text").alias("t"),
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"),
    )
    joined = rows.join(spans, ["doc", "text"], "left").select("row", "t", "spans")
    schema = joined.drop("t").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(_cut, schema)


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 8) -> DataFrame:
    """``doc_id, spans, n_words, n_removed, kept_text``, one row per input row.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also
    starts earlier: in a document of smaller doc_id, or earlier in the same one. Windows are
    judged on the input. ``spans`` are the paths (start, words, source, source_start) that
    cover what goes, null if nothing does; ``kept_text`` is the rest joined by one space.

    A null text has no words. Texts shorter than a window lose nothing. Rows without doc_id
    count as one document that comes after all others. Rows that share a doc_id are one
    document: the same start in two of them is not earlier, so repeated rows are treated
    alike. Extra columns are not read.
    """
    return _removed(docs, ["doc_id"], window, anchor).select("row.doc_id", "spans", "n_words", "n_removed", "kept_text")


def clean_documents(docs: DataFrame, window: int = 20, anchor: int = 8) -> DataFrame:
    """The documents table with repeated spans cut out of the texts; ``n_chars`` follows if it is there.

    Texts that lose nothing, null ones too, stay as they are, white space included. A document
    that loses all its words stays with an empty text.
    """
    # null texts and untouched ones are told apart by n_removed, so the text itself is carried once
    found = _removed(docs, docs.columns, window, anchor)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    out = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
