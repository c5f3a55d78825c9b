"""Main text of web pages by a minimum cut over their blocks.

A page is read into blocks of text with the containers they stand in. A linear classifier,
fitted here on blocks whose containers' tags tell what they are (an article, a menu), gives each
block the log odds of being content. What the names of its containers say is added, and the sum
becomes the capacity of the block's terminal edge. Neighbouring blocks and blocks that are
children of one container are joined by smoothness edges, weaker the farther apart they stand
in the tree and across the border of a named container. The maximum flow then separates
content from boilerplate, so a short paragraph goes with the article around it and a long
advert between two menus does not.

Names are hints, not verdicts. A name counts by its last word (``site-footer`` is a footer,
``header-fixed`` no header) and not at all where the container holds an article that is most of
the page; a doubtful one counts less than the classifier and the edges may.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object", "select", "button"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
#: An element that begins closes the open element of these names first.
_CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: Words that name what stands beside the main text, those that may, and those that name the text.
_TALK_NAMES = set("comment comments reply replies respond discussion disqus related recommended recommendations".split())
_BESIDE_NAMES = _TALK_NAMES | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside share sharing cookie cookies consent gdpr newsletter subscribe "
    "signup pagination pager copyright complementary contentinfo".split()
)
_MAYBE_NAMES = set(
    "form header widget widgets login search social follow notice alert popup modal dialog overlay legal toolbar topbar "
    "masthead skip tags".split()
)
_MAIN_NAMES = set("article content main post entry story body text".split())
#: Words at the end of a name that say nothing, and words that begin a name of a state.
_PLAIN = set(
    "wrapper wrap container inner outer area box block section list item items row col column group panel left right top "
    "bottom primary secondary slot unit holder region zone module".split()
)
_STATES = {"has", "is", "with", "no", "not", "js", "can", "show"}
_PLAIN_KIND, _MAIN, _NAMED, _MAYBE, _BESIDE, _TALK, _ASIDE = range(7)
_BY_TAG = {
    "article": _MAIN, "main": _MAIN, "nav": _ASIDE, "footer": _ASIDE, "aside": _ASIDE, "menu": _ASIDE, "dialog": _ASIDE,
    "form": _MAYBE, "header": _MAYBE,
}
#: Log odds that a container adds. The classifier gives 4 at most, the edges of a block about as much.
_EVIDENCE = {_MAIN: 5.0, _NAMED: 3.0, _MAYBE: -2.5, _BESIDE: -7.5, _TALK: -7.5, _ASIDE: -7.5}
SHAPE = 4.0
SMOOTHNESS = 2.0
#: Weights of the block features where there are no pages to fit them to: long texts without links are content.
UNFITTED = np.array([-6.0, 1.5, -4.0, 0.5, 0.5, 1.5, 1.0, -1.0, 0.0])
N_FEATURES = len(UNFITTED)


def _kind_of_name(name: str) -> int:
    """What one class, id or role says."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _STATES:
        return _PLAIN_KIND
    if words == ["hidden"]:  # not overflow-hidden and the like
        return _MAYBE
    while len(words) > 1 and words[-1] in _PLAIN:
        words.pop()
    head, before = words[-1], set(words[:-1])
    if head in _MAIN_NAMES:
        return _TALK if before & _TALK_NAMES else _PLAIN_KIND if before & (_BESIDE_NAMES | _MAYBE_NAMES) else _NAMED
    if head in _TALK_NAMES:
        return _TALK
    if head in _BESIDE_NAMES or head in _MAYBE_NAMES and before & _BESIDE_NAMES:
        return _BESIDE
    return _MAYBE if head in _MAYBE_NAMES else _PLAIN_KIND


def _kind(tag: str, attributes: str) -> int:
    """What a container's tag and names say about the text in it."""
    kind = _BY_TAG.get(tag, _PLAIN_KIND)
    if not attributes or tag in ("html", "body"):
        return kind
    if _HIDDEN.search(attributes):
        return _BESIDE
    names = {
        _kind_of_name(name)
        for found in _NAMES.finditer(attributes)
        for name in (found.group(1) or found.group(2) or found.group(3) or "").split()
    }
    worst = max(names & {_MAYBE, _BESIDE, _TALK}, default=_PLAIN_KIND)
    if kind == _MAIN:
        return worst if worst in (_BESIDE, _TALK) else kind
    return max(kind, worst) or max(names, default=_PLAIN_KIND)


class Container:
    """An element that holds blocks ``first`` to ``end``; ``parent`` is its place in the list of containers."""

    __slots__ = ("parent", "tag", "kind", "first", "end")

    def __init__(self, parent, tag, kind, first):
        self.parent, self.tag, self.kind, self.first, self.end = parent, tag, kind, first, first


class Block:
    """A run of text between block-level tags.

    ``inside`` is its container, ``depth`` how deep that stands and ``shared`` how deep the
    containers go that it shares with the block before it.
    """

    __slots__ = ("text", "tag", "inside", "depth", "shared", "linked")

    def __init__(self, text, tag, inside, depth, shared, linked):
        self.text, self.tag, self.inside, self.depth, self.shared, self.linked = text, tag, inside, depth, shared, linked


def read_blocks(page: str) -> tuple[list[Block], list[Container]]:
    """Blocks in page order and their containers; white space is one space, character references are decoded."""
    blocks: list[Block] = []
    containers = [Container(-1, "", _PLAIN_KIND, 0)]
    stack = [0]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, in_link, skip, shared = 0, 0, False, "", 0

    def end_block():
        nonlocal linked, shared
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            depth = len(stack) - 1
            blocks.append(Block(text, containers[stack[-1]].tag, stack[-1], depth, min(shared, depth), min(linked, len(text))))
            shared = depth
        linked = 0

    def close():
        nonlocal shared
        c = containers[stack.pop()]
        c.end = len(blocks)
        open_tags[c.tag] -= 1
        shared = min(shared, len(stack) - 1)

    def add(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    head = False
    for token in _TOKEN.finditer(page):
        if skip:
            if (token.group(2) or token.group(5) or "").lower() == skip and (token.group(1) or token.group(4)):
                skip, at = "", token.end()
            continue
        if not head:
            add(page[at : token.start()])
        at = token.end()
        name = token.group(2) or token.group(5)
        if not name:
            continue
        tag, closing, attributes = name.lower(), token.group(1) or token.group(4), token.group(3) or token.group(6) or ""
        if tag == "head":
            head = not closing
        elif tag == "body" and not closing:
            head = False
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                skip = tag
        elif tag == "br":
            parts.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                in_link = not closing
        elif closing:
            end_block()
            in_link = False
            if open_tags[tag] > 0:
                while containers[stack[-1]].tag != tag:
                    close()
                close()
        else:
            end_block()
            shut = _CLOSES.get(tag)
            while shut and len(stack) > 1 and containers[stack[-1]].tag in shut:
                close()
            if containers[stack[-1]].tag == "p" and tag not in _VOID:
                close()
            if tag not in _VOID:
                containers.append(Container(stack[-1], tag, _kind(tag, attributes), len(blocks)))
                stack.append(len(containers) - 1)
                open_tags[tag] += 1
    if not skip and not head:
        add(page[at:])
    end_block()
    for k in stack:
        containers[k].end = len(blocks)
    return blocks, containers


def evidence(blocks: list[Block], containers: list[Container], names: bool = True) -> list[float]:
    """Log odds that containers add to the blocks in them, a number for each container.

    What stands beside the text takes all inside it along, but a name that most of the page
    stands under names no side part: one that holds ``main``, the page's heading, an article of more
    than half of the text, or nearly all of it. Within a container that is only doubtful an
    article is still one. Without ``names`` only tags count, and the names of comments.
    """
    chars = [0]
    for b in blocks:
        chars.append(chars[-1] + len(b.text))
    total = max(chars[-1], 1)

    def share(c: Container) -> float:
        return (chars[c.end] - chars[c.first]) / total

    holds: list[set[str]] = [set() for _ in containers]
    for k in range(len(containers) - 1, 0, -1):  # a container comes after the one around it
        c, around = containers[k], holds[containers[k].parent]
        around |= holds[k]
        if c.tag in ("main", "h1") or c.tag == "article" and share(c) > 0.5:
            around.add(c.tag)
    out = [0.0] * len(containers)
    for k in range(1, len(containers)):
        c, outer = containers[k], out[containers[k].parent]
        kind = c.kind if names or c.kind == _TALK else _BY_TAG.get(c.tag, _PLAIN_KIND)
        most = c.end - c.first >= 3 and share(c) > (0.9 if kind == _TALK else 0.8)
        if kind == _ASIDE and "main" in holds[k]:
            kind = _PLAIN_KIND
        elif kind in (_BESIDE, _TALK) and (holds[k] or most):
            kind = _PLAIN_KIND
        elif kind == _MAYBE and (holds[k] - ({"h1"} if c.tag == "header" else set()) or most):
            kind = _PLAIN_KIND
        if outer <= _EVIDENCE[_BESIDE] or kind == _PLAIN_KIND or kind == _MAYBE and c.tag == "header" and outer > 0:
            out[k] = outer
        elif kind == _NAMED:
            out[k] = max(outer, 0.0 if outer < 0 else _EVIDENCE[kind])
        else:
            out[k] = _EVIDENCE[kind]
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    """What a block's text looks like, whatever its containers are called."""
    out = np.zeros((len(blocks), N_FEATURES))
    for k, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
        heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
        out[k] = (
            1.0, np.log1p(n), b.linked / n, min(words, 60) / 20, min(stops, 6) / 3, b.tag == "p", heading,
            b.tag in ("li", "td", "th", "dt", "dd"), min(b.depth + 1, 24) / 8,
        )
    return out


def cut_content(log_odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of the minimum cut.

    A node is joined to the source by its positive, to the sink by its negative log odds.
    Flow is sent from one source edge at a time along shortest residual paths. Nodes from
    which no path to the sink is left never get one again, so none is searched twice in vain.
    """
    n = len(log_odds)
    source = [max(x, 0.0) for x in log_odds]
    sink = [max(-x, 0.0) for x in log_odds]
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:  # both ways, each the other's residual
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends += [b, a]
        room += [c, c]
    least, stuck = 1e-9, [False] * n
    for start in range(n):
        while source[start] > least and not stuck[start]:
            came: dict[int, int] = {start: -1}
            queue, goal = deque([start]), -1
            while queue:
                v = queue.popleft()
                if sink[v] > least:
                    goal = v
                    break
                for e in out[v]:
                    w = ends[e]
                    if room[e] > least and w not in came and not stuck[w]:
                        came[w] = e
                        queue.append(w)
            if goal < 0:
                for v in came:
                    stuck[v] = True
                break
            flow, v = min(source[start], sink[goal]), goal
            while v != start:
                flow = min(flow, room[came[v]])
                v = ends[came[v] ^ 1]
            source[start] -= flow
            sink[goal] -= flow
            v = goal
            while v != start:
                e = came[v]
                room[e] -= flow
                room[e ^ 1] += flow
                v = ends[e ^ 1]
    return stuck


def smoothness_edges(
    blocks: list[Block], containers: list[Container], said: list[float], weight: float = SMOOTHNESS
) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, and between blocks that are children of one container and of one tag.

    Halved with every step in the tree beyond siblings, and where the blocks' containers are named
    differently (``said`` is the evidence of each container).
    """
    edges = []
    last: dict[tuple[int, str], int] = {}
    for k, b in enumerate(blocks):
        own = (containers[b.inside].parent, b.tag)
        near = {last[own]: 2} if own in last else {}
        if k:
            near[k - 1] = min(near.get(k - 1, 99), blocks[k - 1].depth + b.depth - 2 * b.shared)
        for j, steps in near.items():
            border = 0.5 if said[blocks[j].inside] != said[b.inside] else 1.0
            edges.append((j, k, border * weight * 2.0 ** -max(steps - 2, 0) if steps < 30 else 0.0))
        last[own] = k
    return edges


def main_text(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """(text, blocks on the page, blocks kept).

    Where the names leave nothing of a page that has text outside of menus and footers, they are
    wrong about it: then tags and the texts themselves decide.
    """
    blocks, containers = read_blocks(page or "")
    if not blocks:
        return "", 0, 0
    shape = np.clip(block_features(blocks) @ weights, -SHAPE, SHAPE)
    for names in (True, False):
        said = evidence(blocks, containers, names)
        odds = [float(s) + said[b.inside] for s, b in zip(shape, blocks)]
        kept = cut_content(odds, smoothness_edges(blocks, containers, said))
        if any(kept):
            break
    texts = [b.text for b, k in zip(blocks, kept) if k]
    return "\n".join(texts), len(blocks), len(texts)


def taught(blocks: list[Block], containers: list[Container]) -> list[int]:
    """1 for blocks in an article, 0 for blocks in a menu, footer or the like, by tags; -1 for those nothing is known of."""
    known = [-1] * len(containers)
    for k in range(1, len(containers)):
        c, outer = containers[k], known[containers[k].parent]
        own = {_MAIN: 1, _ASIDE: 0}.get(_BY_TAG.get(c.tag, _PLAIN_KIND), 0 if c.tag == "header" and outer < 0 else outer)
        known[k] = 0 if outer == 0 else -2 if outer == -2 or c.kind in (_BESIDE, _TALK) and own == 1 else own
    return [known[b.inside] for b in blocks]


def fit(pages: DataFrame, sample: int = 2000, ridge: float = 0.1) -> np.ndarray:
    """Weights of the block classifier, a linear discriminant.

    Fitted on blocks that stand in an article, or in a menu, footer and the like, by their tags
    (no names), of about ``sample`` pages chosen by a hash of page_id (all pages if there are fewer). Sums and
    products of the features reach the driver, two small matrices. Where one of the two kinds
    is missing the weights are :data:`UNFITTED`.
    """
    n = pages.count()
    some = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20))))

    def run(batches):
        total = np.zeros((2, N_FEATURES, N_FEATURES))
        for batch in slices(batches, "html"):
            for page in batch.column("html").to_pylist():
                blocks, containers = read_blocks(page or "")
                if blocks:
                    x, good = block_features(blocks), np.array(taught(blocks, containers))
                    for k in (0, 1):
                        total[k] += x[good == k].T @ x[good == k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["place", "x"]
        )

    sums = some.select("html").mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(2 * N_FEATURES * N_FEATURES)
    total[sums.column("place").to_numpy()] = sums.column("x").to_numpy()
    other, good = total.reshape(2, N_FEATURES, N_FEATURES)
    count = good[0, 0], other[0, 0]
    if min(count) < 1:
        return UNFITTED
    mean = good[0, 1:] / count[0], other[0, 1:] / count[1]
    spread = sum(m[1:, 1:] - c * np.outer(u, u) for m, c, u in zip((good, other), count, mean)) / sum(count)
    w = np.linalg.solve(spread + ridge * np.eye(N_FEATURES - 1), mean[0] - mean[1])
    return np.concatenate([[-w @ (mean[0] + mean[1]) / 2], w])


def extract(pages: DataFrame, sample: int = 2000) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_content``, one row per input row.

    ``text`` is the main text: blocks in page order joined by a line break, empty if there are
    none. Null and empty pages have an empty text. Nothing is cut off: a long page is read
    whole, and unclosed tags cost no more than closed ones. Repeated rows come out repeated, null ids and urls stay null, extra columns are not
    read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))

    def run(batches):
        for batch in slices(batches, "html"):
            found = [main_text(page, shared.value) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"),
                    pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()),
                    pa.array([b for _, b, _ in found], pa.int64()), pa.array([k for _, _, k in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
            )

    kind = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long"
    return pages.select("page_id", "url", "html").mapInArrow(run, kind)
