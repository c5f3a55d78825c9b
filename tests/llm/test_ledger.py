"""Exact duplicates, the Merkle manifest and ranked search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import exact, merkle, search
from llm.common import Scratch


def brute_groups(rows):
    """(doc_id, keep_id, group_size, digest) of every row; (longest, least id, null last) stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for key, members in groups.items():
        first = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, first[0], len(members), digest) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bytes", [exact.FILTER_BYTES, exact.SEGMENT_BITS // 8])
def test_exact_duplicates(spark, docs, no_docs, filter_bytes):
    copies = [(1000 + k, f"text {k % 1700} is\there", "en", "hot", 1, "r", "s", 1, 2.0) for k in range(9000)]
    copies += [(20_000 + k, "one\nhot text", "en", "hot", 1, "r", "s", 1, 2.0) for k in range(5000)]
    copies += [(19_999, "  one hot text  ", "en", "hot", 1, "r", "s", 1, 2.0), (None, "one hot text ", "en", "x", 1, "r", "s", 1, 2.0)]
    table = docs.unionByName(spark.createDataFrame(copies, docs.schema)).repartition(7)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = exact.duplicates(table, filter_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = exact.keep_first(table, filter_bytes)
    assert stay.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stay.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert exact.duplicates(no_docs, filter_bytes).count() == exact.keep_first(no_docs, filter_bytes).count() == 0


def test_filter_lets_texts_that_stand_alone_pass(spark, tmp_path):
    scratch = Scratch(spark, "filter-test")
    rows = spark.range(40_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    rows = rows.union(rows.filter("id < 500")).repartition(9)
    for filter_bytes in (exact.FILTER_BYTES, exact.SEGMENT_BITS // 4):
        asked = exact.possibly_repeated(rows, scratch, filter_bytes)
        assert asked.count() == 40_500 and asked.filter("id < 500 and not again").count() == 0
        assert asked.filter("id >= 500 and again").count() < 400


def test_rows_that_stand_alone_are_not_shuffled(docs):
    """In the plan that keeps whole rows, only rows the filter holds back meet an exchange."""
    plan = exact.keep_first(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" in plan and "Window" not in plan


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes):
    """Root of a list of nodes and, for each, the siblings (left, right) on its way there."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(places):
            run = place - place % 3
            ways[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
            places[k] = place // 3
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def digest(row):
        return h("".join(map(field, row)))

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for source in order:
        members = sorted(trees[source], key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        inner[source] = (members, *reduced([digest(r) for r in members]))
    root, outer = reduced([inner[s][1] for s in order])
    out = []
    for source, beyond in zip(order, outer):
        members, subroot, ways = inner[source]
        for row, way in zip(members, ways):
            way = way + beyond
            at = digest(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                at = digest((*row[:4], row[4].replace("\n", "")))
            for a, b in way:
                at = h(a + at + b)
            out.append((row[0], digest(row), subroot, root, h("".join(a + b for a, b in way)), at, at == root))
    return sorted(out, key=repr)


SIZES = {None: 4, "": 1, "a": 27, "b": 82, "ü": 3, "Z": 1, "hot": 200}


def ledger_rows():
    rows = []
    for source, size in SIZES.items():
        for k in range(size):
            rows.append((len(rows) * 37 % 1009, source, None if k % 5 == 0 else "en", k if k % 7 else None, f"line {k}\nend é" if k % 3 else "plain"))
    # repeated rows, null texts, null and repeated ids
    rows += [(None, "a", "en", 1, None), (None, "a", "en", 1, None), (5000, "b", None, None, None), rows[3], rows[3], (7, "only", "x", 0, "")]
    return rows


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    rows = ledger_rows()
    kind = "doc_id long, source string, lang string, n_chars int, text string, tree int, row string, node string"
    table = spark.createDataFrame([(*r, 1, "r", "n") for r in rows], kind).repartition(5)
    got = merkle.manifest(merkle.document_leaves(table), height)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)
    assert {r.verified for r in got.collect()} == {True, False}


def test_manifest_of_few_rows(spark, no_docs):
    assert merkle.manifest(merkle.document_leaves(no_docs)).count() == 0
    for rows in ([(3, None, None, None, "x")], [(3, "a", "en", 2, "x"), (4, "b", "en", 2, "y\n")]):
        table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
        got = merkle.manifest(merkle.document_leaves(table)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_large_tree_lies_in_many_groups(spark):
    """A source of nearly all rows is spread over tasks, and small ones share a group."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4500, "=hot").otherwise(F.concat(F.lit("="), "id")).alias("tree"), "id")
    scratch = Scratch(spark, "ledger-test")
    nodes = merkle.ranked(rows, ["id"], scratch)
    assert nodes.filter("tree = '=hot'").agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.max("n")).first()[:] == (0, 4499, 4500, 4500)
    sizes = [r["count"] for r in merkle._blocked(nodes, 3).groupBy("block").count().collect()]
    assert max(sizes) <= 3 * 27 and len(sizes) < 200


WORDS = [f"w{k}" for k in range(400)]


def brute_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_rank(docs, items, k):
    held = [(i, Counter(brute_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in held:
            n = sum(counts.values())
            m = 75 + (25 * n * n_docs) // total if total else 0
            score = 0
            for t in brute_terms(text):
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for place, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k]):
            out.append((item, place + 1, doc, -s))
    return sorted(out, key=repr)


def corpus(seed=11, n=700):
    """Texts with a few very common words, many rare ones, ties and odd rows."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(WORDS) + 1)
    rows = []
    for k in range(n):
        words = rng.choice(WORDS, int(rng.integers(1, 60)), p=share / share.sum())
        rows.append((k, " ".join(words)))
    rows += [(n + k, rows[5][1]) for k in range(40)]  # ties
    rows += [(None, rows[5][1]), (n + 50, None), (n + 51, ""), (n + 52, " .;! "), (n + 53, "w1 " * 20_000), (n + 54, "É W7é-W7É_w7")]
    rows += [rows[9], rows[9]]
    items = [(k, " ".join(rng.choice(WORDS, int(rng.integers(1, 25))))) for k in range(12)]
    items += [(100, rows[5][1] + " " + rows[5][1]), (101, None), (102, ""), (103, "nowhere"), (104, "w0"), (104, "w0"), (None, "W3 w3 É w7é")]
    return rows, items


@pytest.mark.parametrize("share, block_bytes, at_once", [(1 / 64, 1 << 24, 1 << 20), (0, 900, 64), (0.3, 9000, 1 << 20), (10, 2000, 1 << 20)])
def test_ranked_search(spark, share, block_bytes, at_once):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item int, score string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, rank int")
    got = search.rank(docs, asked, 20, share, block_bytes, at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rank(rows, items, 20)


def test_search_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in search.rank(docs, items).collect()] == [(1, 1, 1)]
    assert search.rank(docs.filter("false"), items).count() == 0
    assert search.rank(docs, items.filter("false")).count() == 0
    assert search.rank(docs.filter("doc_id = 2"), items).count() == 0


def test_windows_that_cannot_reach_are_skipped(monkeypatch):
    """Lists are asked only for windows whose bounds reach what is needed."""
    places = np.arange(0, 128 * 64)
    values = np.ones(len(places), np.int64)
    values[128 * 40 + 3] = 50
    long = search._Bounded(places, values, 64)
    short = search._Bounded(np.array([128 * 40 + 3, 128 * 50]), np.array([100, 100]), 64)
    asked = []
    at = search._Bounded.at
    monkeypatch.setattr(search._Bounded, "at", lambda self, w: asked.append(len(w)) or at(self, w))
    found, scores = search._hits([(long, 2), (short, 1)], places, 101, 20)
    assert found.tolist() == [128 * 40 + 3, 128 * 50] and scores.tolist() == [200, 102]
    assert sum(asked) <= 4 * search.WINDOW
