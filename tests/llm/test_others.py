"""Vectors, quality, pages, shards, the pipeline and the package's place in the repository."""

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from llm import cosine, extraction, linking, quality, sharding
from llm.common import Scratch
from llm.queries import SHARDS

from .test_texts import smallest_reachable

REPO = Path(__file__).resolve().parents[2]


def vectors(seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        rows.append((len(rows), k % 4, base))
        for _ in range(int(rng.integers(0, 6))):
            near = base / np.linalg.norm(base) + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.045, 0.06])
            rows.append((len(rows), int(rng.integers(0, 2)) * (k % 4), near * 3))
    out = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    n = len(out)
    odd = [
        (n, None, out[0][2]), (n + 1, 0, None), (n + 2, 0, [0.0] * 16), (n + 3, 0, [float("nan")] + [1.0] * 15),
        (n + 4, 0, [None] + [1.0] * 15), (n + 5, 0, []), (n + 6, 0, [float("inf")] + [1.0] * 15), (n + 7, 0, [1.0, 2.0]),
        (n + 8, 0, [2.0, 4.0]), (None, 0, out[0][2]), out[3], out[3],
    ]
    return out + odd


def test_near_vectors(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, node string, weight int")
    got = cosine.near_vectors(table, miss=1e-9).collect()
    ids = [r[0] for r in rows]

    def vector(k):
        v = rows[k][2]
        ok = rows[k][0] is not None and rows[k][1] is not None and v and None not in v and np.isfinite(v).all() and any(v)
        return np.array(v, float) if ok else None

    known = [vector(k) for k in range(len(rows))]

    def linked(a, b):
        x, y = known[a], known[b]
        if x is None or y is None or len(x) != len(y) or rows[a][1] != rows[b][1]:
            return False
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98

    component = smallest_reachable(ids, linked)
    expected = []
    for a in range(len(rows)):
        near = {ids[b] for b in range(len(rows)) if a != b and linked(a, b) and ids[b] != ids[a]}
        c = component[a] if known[a] is not None else ids[a]
        expected.append((ids[a], len(near), c, ids[a] is not None and c == ids[a]))
    assert sum(n for _, n, _, _ in expected) > 50
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert cosine.near_vectors(table.filter("false")).count() == 0


def test_tables_leave_few_pairs_unfound():
    for rows in (10, 10**5, 10**9):
        bits, tables = cosine.table_plan(rows, 0.98, 1e-5)
        same = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - same) ** tables <= 1e-5
        assert rows / 2.0**bits <= 1


def test_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    """One cell holds everything: units stay small, and the links are those of brute force."""
    rng = random.Random(1)
    values = sorted({rng.randrange(4000) for _ in range(700)})
    members = spark.createDataFrame([(1, v) for v in values], "cell long, node long")
    units = linking.cell_blocks(members, block=64)
    sizes = [r["count"] for r in units.groupBy("cell", "i", "j").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 3 * 64

    def close(batch, left, right):
        node = batch.column("node").to_numpy()
        near = abs(node[left] - node[right]) <= 3
        return near, np.ones(int(near.sum()), bool)

    found = linking.scan_units(units, close)
    links = {r.node: r.n for r in found.groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    assert links == {v: n for v in values if (n := sum(0 < abs(v - w) <= 3 for w in values))}
    label = linking.components(found.selectExpr("node as a", "root as b"), Scratch(spark, "test"))
    expected = dict(zip(values, smallest_reachable(values, lambda a, b: abs(values[a] - values[b]) <= 3)))
    assert {r.node: r.component for r in label.collect()} == {v: expected[v] for v in links}


@pytest.mark.parametrize("kind", ["path", "shuffled path", "star", "cycle"])
def test_components_of_long_shapes(spark, kind):
    n = 300
    name = list(range(n))
    if "shuffled" in kind:
        random.Random(2).shuffle(name)
    edges = [(name[0], name[k]) if kind == "star" else (name[k - 1], name[k]) for k in range(1, n)]
    edges += [(name[-1], name[0])] * (kind == "cycle") + [(1000, 1001), (1001, 1000), (2000, 2000)]
    table = spark.createDataFrame(edges, "a long, b long")
    rows = {r.node: r.component for r in linking.components(table, Scratch(spark, "test")).collect()}
    assert rows == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def quality_rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 200)))
        bad = k % 5 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if k % 2 else (text.split()[0] + " ") * 50
        docs.append((k, text))
        if k % 10 < 6:
            labels.append((k, int(not bad), 0))
    return docs, labels


def test_resampling_keeps_the_good(spark):
    docs, labels = quality_rows()
    extra = [(1000, None), (1001, ""), (1002, " \t "), (3, docs[3][1]), (None, docs[6][1])]
    table = spark.createDataFrame([(*r, 7, "x") for r in docs + extra], "doc_id long, text string, kept int, log_ratio string")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.resample(table, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    good = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5]
    bad = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    held = [r for r in good if r.doc_id % 10 >= 6]
    assert np.mean([r.kept for r in held]) > 0.98 and np.mean([r.kept for r in bad]) < 0.05
    assert [r for r in rows if r.log_ratio is None and r.kept] == []
    # the sample is the k largest keys
    keys = sorted((r.gumbel_key for r in rows if r.gumbel_key is not None), reverse=True)
    kept = sum(r.kept for r in rows)
    assert {r.gumbel_key >= keys[kept - 1] for r in rows if r.kept} == {True}
    share = quality.resample(table, marks, share=0.25).filter("kept").count()
    assert abs(share - 0.25 * len(rows)) <= 2  # rows tied with the last one stay
    stay = quality.keep_target(table, marks)
    assert stay.columns == table.columns and stay.count() == kept
    assert quality.resample(table.filter("false"), marks).count() == 0
    assert quality.resample(table, marks.filter("false")).count() == len(rows)


def test_raw_model_counts_unlabelled_documents(spark):
    docs, labels = quality_rows()
    rng = random.Random(4)
    words = ["".join(rng.choice("uvwxyzåäö") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    other = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(50, 200)))) for k in range(1000, 1100)]
    table = spark.createDataFrame(docs + other, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.resample(table, marks).collect()}
    assert max(rows[k].log_ratio for k, _ in other) < -10 and not any(rows[k].kept for k, _ in other)
    assert np.mean([rows[k].kept for k in range(400) if k % 5]) > 0.98
    # all labelled rows are counted unless a sample is asked for
    every, some = quality.fit(table, marks), quality.fit(table, marks, sample=60)
    assert np.abs(every.ratio - some.ratio).max() > 0.1
    sampled = {r.doc_id: r.log_ratio for r in quality.resample(table, marks, sample=60).collect()}
    f = quality.features(docs[3][1].encode())
    assert sampled[3] == pytest.approx(some.ratio[f].sum() * min(1, quality.UNITS / len(f)))


def test_toxic_rows_and_the_sample_against_plain_python(spark):
    """Models, ratios, k and keys counted one by one; held-out toxic rows go, good ones stay."""
    docs, labels = quality_rows()
    rng = random.Random(21)
    toxic = set(rng.sample([k for k, _ in docs if k % 5], 90))
    docs = [(k, t + " Zounds! " + t[:9] + (" ZOUNDS" if k % 2 else " gadzooks,") if k in toxic else t) for k, t in docs]
    labels = [(k, q, int(k in toxic)) for k, q, _ in labels] + [(7, None, 1), (None, 1, 1), (12, 1, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.resample(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    from collections import Counter
    from math import exp, inf, log

    text = {k: t.encode() for k, t in docs}
    kinds = {}
    for k, q, x in labels:
        if k is not None and q is not None:
            kinds[k] = min(kinds.get(k, 2), 0 if q != 1 else 1 if x else 2)
    grams = {k: quality.features(t).tolist() for k, t in text.items()}
    words = {k: set(quality.vocabulary(t).tolist()) for k, t in text.items()}
    raw, labelled, target, wx, wg = (Counter() for _ in range(5))
    for k in text:
        raw.update(grams[k])
        if k in kinds:
            labelled.update(grams[k])
            target.update(grams[k] if kinds[k] == 2 else [])
            wx.update(words[k] if kinds[k] == 1 else [])
            wg.update(words[k] if kinds[k] == 2 else [])
    of_good, of_raw = target.total() / labelled.total(), labelled.total() / raw.total()
    n = Counter(kinds.values())

    def ratio(b):
        first = (target[b] + 4 * of_good) / ((labelled[b] + 4) * of_good)
        return log(first) + log((labelled[b] + 1000 * of_raw) / ((raw[b] + 1000) * of_raw))

    rates, half, rate = sorted((wx[b] / wg[b], wx[b]) for b in wx if wg[b]), 0, None
    for rate, c in rates:
        half += c
        if half >= sum(c for _, c in rates) / 2:
            break
    odds = {}
    for b, c in wx.items():
        e = rate * (wg[b] + 1)
        if c > e and 2 * (c * log(c / e) - (c - e)) > 36 * log(2):
            odds[b] = log((c + 1) / (e + 1))
    assert 1 <= len(odds) < 10
    step = log(1 + sum(wg[b] / wg.total() * (exp(o) - 1) for b, o in odds.items()))
    keys, expected = {}, 0.0
    for k in text:
        s = sum(map(ratio, grams[k])) * min(1, quality.UNITS / len(grams[k]))
        t = log(n[2] / n[1]) + step * len(words[k]) - sum(odds.get(b, 0) for b in words[k])
        value = -log(exp(-s) + exp(-t))
        assert rows[k].log_ratio == pytest.approx(value, abs=1e-6)
        expected += min(1, n[2] / n.total() * exp(min(value, 50)))
        keys[k] = rows[k].gumbel_key
        assert -4 < keys[k] - value < inf
    largest = sorted(keys, key=keys.get, reverse=True)[: round(expected)]
    assert {k for k, r in rows.items() if r.kept} == set(largest)
    held = [k for k in text if k not in kinds]
    assert np.mean([rows[k].kept for k in held if k in toxic]) < 0.2
    assert np.mean([rows[k].kept for k in held if k not in toxic and k % 5]) > 0.95


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.standard_normal(500), [1e9, -1e9, 0.0, 0.0, 0.0], rng.standard_normal(50) * 1e-9])
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 250, 300, len(values)):
        assert quality.kth_largest(table, "x", k, bins=16) == ordered[k - 1]
    assert quality.kth_largest(table, "x", len(values) + 1) is None


def brute_cut(odds, edges):
    best, side = None, None
    for k in range(1 << len(odds)):
        on = [bool(k >> i & 1) for i in range(len(odds))]
        cost = sum(max(x, 0) for x, s in zip(odds, on) if not s) + sum(max(-x, 0) for x, s in zip(odds, on) if s)
        cost += sum(c for a, b, c in edges if on[a] != on[b])
        if best is None or cost < best - 1e-9:
            best, side = cost, on
    return best, side


def test_minimum_cut():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        best, side = brute_cut(odds, edges)
        assert extraction.cut_content(odds, edges) == side, (odds, edges, best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><a href=/>Site</a><p>Welcome to the best site of the world, enjoy it.</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- <p>not this</p> --><div id="cookie-notice"><p>We use cookies to improve your experience here. By going on you agree.</p></div>
<article><h1>The &eacute;vent &amp; more</h1><p><b>First   paragraph,\n with <a href="x>y">a link</a>.<br><p>Short.
<div class="advert">Buy now! Great offers are waiting for you, really great offers.</div><ul><li>point<li>two</ul>
<form><p>Sign up to our letter</p><input name=q></form><p>Last.</p></article>
<aside><p>Related reading that is long enough to look like text. It has sentences too.</p></aside>
<section id="comments"><article class="comment"><p>I really liked the story, it was great. Really.</p></article></section>
<footer>&copy; all of us</footer></body></html>"""


def test_main_text(spark):
    many = [(k, f"http://x/{k}", PAGE.replace("Short", f"Short {k}"), "t") for k in range(20)]
    odd = [(100, None, None, "t"), (101, "u", "", "t"), (None, "u", "no tags at all", "t"), (0, many[0][1], many[0][2], "t")]
    table = spark.createDataFrame(many + odd, "page_id long, url string, html string, text string")
    rows = extraction.extract(table).collect()
    assert len(rows) == 24
    expected = "The évent & more\nFirst paragraph, with a link.\nShort 0.\npoint\ntwo\nLast."
    assert {r.text for r in rows if r.page_id == 0} == {expected}
    assert {(r.text, r.n_chars) for r in rows if r.page_id in (100, 101)} == {("", 0)}
    assert extraction.extract(table.filter("false")).count() == 0


PARAGRAPHS = [f"This is paragraph {k} of the article, and it has words enough. It says two things." for k in range(4)]
BODY = "<h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
NAV = "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>"
FOOT = "<footer>&copy; us all, since ever.</footer>"
TALK = (
    "<section id=comments><article class=comment><p>I liked it. It was long though, was it not? Yes it was.</p></article>"
    "<div class=reply><p>No it was not. I read it all in one go.</p></div></section>"
)
LAYOUTS = {
    "form around all": f"<form id=aspnet>{NAV}<article>{BODY}</article>{TALK}{FOOT}</form>",
    "form, no article": f"<form>{NAV}{BODY}{TALK}{FOOT}</form>",
    "with-banner": f"<div class='site with-banner'>{NAV}<main><article>{BODY}</article></main>{TALK}{FOOT}</div>",
    "banner": f"<div class=banner><div class=page>{NAV}<article>{BODY}</article>{TALK}</div></div>{FOOT}",
    "comments-open": f"{NAV}<article class='post comments-open'>{BODY}</article>{TALK}{FOOT}",
    "widget": f"{NAV}<div class='elementor-widget'>{BODY}</div>{TALK}{FOOT}",
    "overflow-hidden": f"{NAV}<div class='overflow-hidden'>{BODY}</div>{TALK}{FOOT}",
    "header-fixed": f"<div class='layout header-fixed'>{NAV}<div>{BODY}</div>{TALK}{FOOT}</div>",
    "menu wrapper": f"<div id='menu-wrapper-main'>{NAV}<article>{BODY}</article>{TALK}{FOOT}</div>",
    "search page": f"<div class=search>{NAV}<div class=x>{BODY}</div>{FOOT}</div>",
    "hidden until loaded": f"<div style='display:none'>{NAV}<main>{BODY}</main>{TALK}{FOOT}</div>",
    "wrapped menu": f"<div><div class='main-menu'><div><a href=x>Home</a> <a href=y>About</a></div></div><div>{BODY}</div>{TALK}{FOOT}</div>",
    "wrapped comments": f"{NAV}<div class=page><div>{BODY}</div><div class='comments-area'><div><div>{TALK}</div></div></div></div>{FOOT}",
    "sidebar": f"<div class='has-sidebar'>{NAV}<div class=post>{BODY}</div><div class='left-sidebar'><p>We write about all things. Read us on every day.</p></div></div>",
    "cookies": f"<div id=cookie-notice><p>We use cookies to improve your time here. By going on you agree to all of them.</p></div>{NAV}{BODY}{FOOT}",
    "no names": f"{NAV}<div>{BODY}</div>{FOOT}",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_keep_their_article(layout):
    """Whatever a page's containers are called its article stays, and menus and comments go."""
    page = f"<html><body class='with-comments'>{LAYOUTS[layout]}</body></html>"
    assert extraction.main_text(page, extraction.UNFITTED)[0].split("\n") == ["Title of it", *PARAGRAPHS]


def test_classifier_is_fitted_by_tags(spark):
    """Fitted on articles and menus it tells text from links where no container has a name."""
    rows = [(k, f"u{k}", f"<html><body>{NAV}<header><a href=/>Home</a></header><article>{BODY}</article>{FOOT}</body></html>") for k in range(50)]
    weights = extraction.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    page = f"<div><div><a href=/x>One</a> <a href=/y>Two</a></div><div>{BODY}</div></div>"
    assert extraction.main_text(page, weights)[0].split("\n")[-4:] == PARAGRAPHS
    blocks, containers = extraction.read_blocks(rows[0][2])
    assert set(extraction.taught(blocks, containers)) == {0, 1}
    nothing = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    assert (extraction.fit(nothing) == extraction.UNFITTED).all()


def test_unclosed_tags_cost_no_more_than_closed_ones():
    import time
    import tracemalloc

    for page in ("<div>text one. And two, as it is. " * 20_000, "<div>a" * 20_000 + "</span></p></li>" * 20_000):
        began = time.process_time()
        _, blocks, _ = extraction.main_text(page, extraction.UNFITTED)
        assert blocks == 20_000 and time.process_time() - began < 4
    tracemalloc.start()
    extraction.main_text("<div>text one. And two, as it is. " * 20_000, extraction.UNFITTED)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_edges_join_neighbours_and_children_of_one_container():
    blocks, containers = extraction.read_blocks("<div><p>a</p><div class=ad>b</div><p>c</p></div><div><p>d</p></div>")
    edges = extraction.smoothness_edges(blocks, containers, extraction.evidence(blocks, containers))
    assert {(a, b): w for a, b, w in edges} == {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 2.0, (2, 3): 0.5}


def brute_table(names, slots):
    """Every shard's whole preference list, claimed in turns."""
    import xxhash

    lists = []
    for s in names:
        at, skip = xxhash.xxh64_intdigest(s.encode(), 1) % slots, xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1
        lists.append([(at + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, wishes in enumerate(lists):
            slot = next((s for s in wishes if s not in owner), None)
            if slot is not None:
                owner[slot] = k
    return [owner[s] for s in range(slots)]


def test_slot_table():
    names = [f"s{k}" for k in range(7)]
    owner = sharding.slot_table(names, 251).tolist()
    assert owner == brute_table(names, 251)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    large = sharding.slot_table(SHARDS)
    fewer = sharding.slot_table(SHARDS[:-1])
    moved = np.mean([SHARDS[a] != SHARDS[b] for a, b in zip(large, fewer)])
    assert moved < 0.05  # one of 96 has to move
    with pytest.raises(ValueError):
        sharding.slot_table(names, 250)


def test_shards_of_rows(spark, docs, no_docs, tmp_path):
    import hashlib

    rows = sharding.assign_shards(docs, "doc_id", SHARDS)
    assert rows.columns == [*docs.columns, "slot", "shard"] and rows.count() == docs.count()
    owner = sharding.slot_table(SHARDS)
    for r in rows.collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, SHARDS[owner[slot]])
    assert sharding.assign_shards(no_docs, "doc_id", SHARDS).count() == 0
    sharding.write_shards(docs, "doc_id", SHARDS[:4], str(tmp_path / "out"), files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    columns = docs.columns
    scratch = Scratch(spark, "pipeline-test")
    good = scratch.keep(c.good_documents(spark, docs, folder), "a")
    expected = quality.resample(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").select("doc_id")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in expected.collect())

    from .test_texts import brute_fingerprint, brute_repeats, brute_secrets

    one = scratch.keep(c.one_per_group(spark, good, folder), "b")
    ids = sorted(r.doc_id for r in good.collect())
    fps = [brute_fingerprint(texts[i]) for i in ids]
    reach = smallest_reachable(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(reach))

    rest = scratch.keep(c.without_repeats(spark, one, folder), "c")
    plain = brute_repeats([(i, texts[i]) for i in set(reach)])
    left = {i: kept if gone else texts[i] for i, (_, gone, kept) in plain.items()}
    assert {r.doc_id: r.text for r in rest.collect()} == left

    clean = scratch.keep(c.without_secrets(spark, rest, folder), "d")
    assert good.columns == one.columns == rest.columns == clean.columns == columns
    for r in clean.collect():
        found, _ = brute_secrets(left[r.doc_id])
        assert not found and r.text == left[r.doc_id] or (found and not brute_secrets(r.text)[0] and r.n_chars == len(r.text))

    packed = c.packed(spark, clean, folder)
    assert sorted({r.doc_id for r in packed.collect()}) == sorted(left)
    whole = c.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, packed.collect()))


def test_the_rest_stands_without_the_package(tmp_path):
    """Nothing else imports the package, and the entry goes on without it."""
    for path in REPO.rglob("*.py"):
        inside = path.relative_to(REPO)
        if inside.parts[0] == "llm" or inside.parts[:2] == ("tests", "llm") or str(inside) == "corpus_pipeline.py":
            continue
        found = [line for line in path.read_text().splitlines() if re.match(r"\s*(from|import)\s+(llm|corpus_pipeline)\b", line)]
        assert not found or str(inside) == "__spark_entry__.py", path
    for name in ("__spark_entry__.py", "millrace"):
        (tmp_path / name).symlink_to(REPO / name)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
        cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"},
    )
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr
