"""Byte-level BPE over whole texts: frequent words from a transducer, the rest merged exactly.

Texts are cut into words, codes and classes as arrays; a word is looked up once for each
chunk of texts, not once for each occurrence. The lexicon only saves time: which words it
holds changes no id.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kth_largest, once_per_process, slices
from .transducer import Lexicon, build
from .words import chunks, mix, powers

_EDGE = 0x110000  # stands between texts, outside of Unicode
_LETTER, _NUMBER, _OTHER, _SPACE, _BORDER = range(5)
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_LONG = 1 << 21
_CHUNK = 1 << 21  # characters looked at together; arrays take some 50 bytes a character


def _classes() -> np.ndarray:
    return once_per_process("character classes", _make_classes)


def _make_classes() -> np.ndarray:
    table = np.full(_EDGE + 1, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, _EDGE)]))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    table[_EDGE] = _BORDER
    return table


def word_starts(code: np.ndarray) -> np.ndarray:
    """Where words begin: contractions, letters, numbers and signs with one space before, white space.

    White space before a word leaves its last character to it: a space joins the word, any
    other character stands alone.
    """
    kind = _classes()[code]
    start = np.ones(len(code), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _BORDER)
    after = np.flatnonzero(start[1:] & (kind[1:] < _SPACE) & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 0x20]] = False
    quote = np.flatnonzero(start & (code == 0x27))
    padded = np.append(code, [_EDGE, _EDGE])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, n in ((quote[short], 2), (quote[long], 3)):
        start[at + 1] = False
        end = at + n
        start[end[end < len(code)]] = True
    return start


class Vocabulary:
    """A byte-level BPE file of the tokenizers library (regular splitting, no normalizer)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        as_bytes = {c: b for b, c in enumerate(letters)}
        model = spec["model"]
        self.ranks = {bytes(as_bytes[c] for c in t): i for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        self.merges = {
            (model["vocab"][a], model["vocab"][b]): (k, i) for k, ((a, b), i) in enumerate(zip(pairs, order))
        }
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        # where ids follow the order of merges, tiktoken's merge loop gives the same ids
        self.quick = (
            tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
            if all(a < b for a, b in zip(order, order[1:])) and max(self.single) < order[0]
            else None
        )
        pieces = {**{i: b for b, i in self.ranks.items()}, **{i: t.encode() for t, i in self.specials.items()}}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_bytes = np.frombuffer(b"".join(table), np.uint8)
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.piece_size, self.piece_at = sizes, np.cumsum(sizes) - sizes
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the merge of lowest rank goes first, the leftmost of equals."""
        if self.quick is not None:
            return self.quick._encode_single_piece(word)
        return self.merge_plainly(word)

    def merge_plainly(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [
            (self.merges[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges
        ]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            r = after[k] if k < len(after) else len(ids)
            if ids[k] != a or r >= len(ids) or ids[r] != b:
                continue
            ids[k], ids[r] = self.merges[(a, b)][1], -1
            after[k] = after[r]
            if after[k] < len(ids):
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < len(ids) and (p := (ids[left], ids[right])) in self.merges:
                    heapq.heappush(queue, (self.merges[p][0], left, *p))
        return [i for i in ids if i >= 0]

    def words(self, texts: list[str]):
        """Distinct words of some texts: (words, number of the word at each place, first place of each text)."""
        joined = "\0".join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        code[edges] = _EDGE
        start = np.flatnonzero(word_starts(code))
        at = np.arange(len(code), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(code))))
        hashed = np.add.reduceat(mix(code.astype(np.uint64)) * powers(int(at.max()) + 1)[at], start)
        size = np.diff(np.append(start, len(code)))
        inside = code[start] != _EDGE
        start, size, hashed = start[inside], size[inside], mix(hashed[inside])
        _, one, which = np.unique(hashed, return_index=True, return_inverse=True)
        a = start[one]
        words = [joined[i:j].encode("utf-8", "surrogatepass") for i, j in zip(a.tolist(), (a + size[one]).tolist())]
        first = np.searchsorted(start, np.concatenate([[0], edges]))
        return words, which, first

    def encode(self, texts: list[str], lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins; one more entry for the end)."""
        parts: list[str | int] = []
        last = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            parts.extend(self._parts(t))
            last[k + 1] = len(parts)
        plain = [p for p in parts if isinstance(p, str)]
        ids, bounds = self._encode_plain(plain, lexicon)
        if len(plain) == len(parts):
            return ids, bounds[last]
        out, size, nth = [], [], 0
        for p in parts:
            if isinstance(p, str):
                out.append(ids[bounds[nth] : bounds[nth + 1]])
                nth += 1
            else:
                out.append(np.array([p], np.uint32))
            size.append(len(out[-1]))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(size)])[last]

    def _parts(self, text: str):
        if self.split_specials is not None and any(s in text for s in self.specials):
            for p in self.split_specials.split(text):
                if p in self.specials:
                    yield self.specials[p]
                elif p:
                    yield from _cut(p)
        else:
            yield from _cut(text)

    def _encode_plain(self, texts, lexicon):
        ids, bounds, base = [], [np.zeros(1, np.int64)], 0
        for a, b in chunks(texts, _CHUNK):
            some, where = self._encode_chunk(texts[a:b], lexicon)
            ids.append(some)
            bounds.append(where[1:] + base)
            base += len(some)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate(bounds)

    def _encode_chunk(self, texts, lexicon):
        words, which, first = self.words(texts)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        number = lexicon.numbers(words) if lexicon is not None else np.full(len(words), -1)
        unseen = np.flatnonzero(number < 0)
        merged = [self.merge(words[k]) for k in unseen.tolist()]
        size = np.zeros(len(words), np.int64)
        size[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.array([i for m in merged for i in m], np.uint32)
        at = np.zeros(len(words), np.int64)
        at[unseen] = np.cumsum(size[unseen]) - size[unseen]
        if lexicon is not None:
            seen = number >= 0
            at[seen] = lexicon.offsets[number[seen]] + len(flat)
            size[seen] = lexicon.offsets[number[seen] + 1] - lexicon.offsets[number[seen]]
            flat = np.concatenate([flat, lexicon.ids.astype(np.uint32)])
        n = size[which]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at[which] - done[:-1], n) + np.arange(done[-1])]
        return ids, done[first]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.piece_size[ids]
        done = np.cumsum(n) - n
        total = int(n.sum())
        return self.piece_bytes[np.repeat(self.piece_at[ids] - done, n) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _cut(text: str):
    """A very long text in pieces; before a single space between word characters a word always begins."""
    at = 0
    while len(text) - at > 2 * _LONG:
        cut = _SAFE_CUT.search(text, at + _LONG)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _byte_letters() -> list[str]:
    """The characters that stand for the 256 bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def vocabulary(text: str) -> Vocabulary:
    return once_per_process(("vocabulary", text), lambda: Vocabulary(text))


def _lexicon(block: bytes) -> Lexicon:
    return once_per_process(("lexicon", block), lambda: Lexicon.mapped(block))


def read_vocabulary(path: str) -> str:
    """The file's content; it travels to the executors, which need not have the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_batches(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def frequent_words(docs: DataFrame, file: str, words: int = 1 << 16, least: int = 8) -> list[tuple[bytes, int]]:
    """The most frequent words of all texts, counted where they occur ``least`` times in a chunk of 2 MB.

    A word that makes up some four millionths of the characters of all texts is counted in at least one chunk.
    At most ``words`` rows reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches):
        v = vocabulary(shared.value)
        for batch in slices(batches, "text"):
            texts = [p for t in text_batches(batch) for p in _cut(t)]
            for a, b in chunks(texts, _CHUNK):
                found, which, _ = v.words(texts[a:b])
                count = np.bincount(which, minlength=len(found))
                rows = np.flatnonzero(count >= least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[k] for k in rows.tolist()], pa.binary()), pa.array(count[rows], pa.int64())],
                    ["word", "n"],
                )

    scratch = Scratch(docs.sparkSession, "words")
    counted = scratch.keep(
        docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts"
    )
    # more than the count just beyond the last place: at most so many words, without sorting them all
    beyond = kth_largest(counted, "n", words + 1)
    top = counted if beyond is None else counted.filter(F.col("n") > beyond)
    rows = [(bytes(r.word), r.n) for r in top.collect()]
    scratch.drop(counted)
    return rows


def compile_lexicon(docs: DataFrame, file: str, words: int = 1 << 16) -> bytes:
    """The frequent words of a table with their ids, as a transducer of bounded size."""
    v = vocabulary(file)
    return build({w: v.merge(w) for w, _ in frequent_words(docs, file, words)})


def encode(docs: DataFrame, path: str, lexicon_words: int = 1 << 16) -> DataFrame:
    """(doc_id, ids): ids of every whole text, one row per input row.

    Special strings of the file become their ids wherever they stand in a text, as the
    tokenizers library has it by default. Null texts count as empty and have no ids. Repeated
    rows come out repeated, extra columns are not read.
    """
    file = read_vocabulary(path)
    block = compile_lexicon(docs, file, lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast((file, block))

    def run(batches):
        v, lexicon = vocabulary(shared.value[0]), _lexicon(shared.value[1])
        for batch in slices(batches, "text"):
            ids, at = v.encode(text_batches(batch), lexicon)
            out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``text`` to a table with ``ids``; bytes that are no UTF-8 become U+FFFD. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*names).schema

    def run(batches):
        v = vocabulary(shared.value)
        for batch in slices(batches, "ids"):
            texts = [
                v.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"]
            )

    return encoded.select(*names).mapInArrow(run, schema.add("text", "string"))
