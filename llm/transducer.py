"""A minimal acyclic transducer: words to numbers, shared suffixes, one memory-mapped block.

Words are added in order and equal right-hand sides become one state (the incremental
construction for sorted input). Each transition puts out how many words lie before it, so the
outputs along a word add up to its number, which points into a table of id sequences.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import xxhash


def build(words: dict[bytes, list[int]]) -> bytes:
    """Compile a lexicon into one block of bytes. The empty word has no place in it."""
    ordered = sorted(w for w in words if w)
    states = _minimal(ordered)
    base, check, target, output, final = _placed(states)
    lengths = np.array([len(words[w]) for w in ordered], np.int32)
    ids = np.array([i for w in ordered for i in words[w]], np.int32)
    parts = [base, check, target, output, final, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), ids]
    head = np.array([len(p) for p in parts], np.int32)
    return b"".join([head.tobytes(), *(p.astype(np.int32).tobytes() for p in parts)])


def _minimal(ordered: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States as (final, ((byte, state), ...)), children before parents; the last is the root."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def close(final, edges):
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    open_states: list[list] = [[False, []]]  # along the last word; an edge is added when its end closes
    last = b""
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        while len(open_states) > shared + 1:
            final, edges = open_states.pop()
            open_states[-1][1].append((last[len(open_states) - 1], close(final, edges)))
        open_states.extend([False, []] for _ in word[shared:])
        open_states[-1][0] = True
        last = word
    while len(open_states) > 1:
        final, edges = open_states.pop()
        open_states[-1][1].append((last[len(open_states) - 1], close(final, edges)))
    states.append((open_states[0][0], tuple(open_states[0][1])))
    return states


def _placed(states):
    """Row displacement: the edge of state s by byte b lies at base[s] + b where check says s."""
    n = len(states)
    below = np.zeros(n, np.int64)  # words that end in or after a state
    edges = sum(len(e) for _, e in states)
    room = edges + 512
    check, target, output = (np.full(room, -1, np.int32) for _ in range(3))
    taken = bytearray(room)
    base, final = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for s, (is_final, out) in enumerate(states):
        final[s] = is_final
        below[s] = is_final + sum(int(below[t]) for _, t in out)
    low = 0
    single = False
    for s in sorted(range(n), key=lambda s: -len(states[s][1])):
        out = states[s][1]
        if not out:
            continue
        if len(out) == 1 and not single:  # these fit every gap
            single, low = True, 0
        first, rest = out[0][0], [b for b, _ in out[1:]]
        at, tries = taken.find(0, max(low, first)), 0
        while True:
            if at < 0 or at + 256 >= room:
                grow = max(room // 4, 1024)
                check, target, output = (np.append(x, np.full(grow, -1, np.int32)) for x in (check, target, output))
                at = at if at >= 0 else room
                taken.extend(bytes(grow))
                room += grow
            if not any(taken[at - first + b] for b in rest):
                break
            at, tries = taken.find(0, at + 1), tries + 1
            if tries == 64:  # full enough below: begin the next searches here
                low = at
        base[s] = at - first
        before = int(final[s])
        for b, t in out:
            taken[base[s] + b] = 1
            check[base[s] + b], target[base[s] + b], output[base[s] + b] = s, t, before
            before += int(below[t])
        if len(out) == 1:
            low = at  # single edges fill the first gap, so none is left before it
    return base, check, target, output, final


class Lexicon:
    """Looks words up in a compiled block."""

    def __init__(self, block):
        head = np.frombuffer(block, np.int32, 7)
        at = head.nbytes
        parts = []
        for n in head.tolist():
            parts.append(np.frombuffer(block, np.int32, n, at))
            at += 4 * n
        self.base, self.check, self.target, self.output, self.final, self.offsets, self.ids = parts
        self.root = len(self.base) - 1

    @classmethod
    def mapped(cls, block: bytes) -> "Lexicon":
        """From a file in the worker's own temporary folder, so that its workers share the pages."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{xxhash.xxh3_128_hexdigest(block)}")
        if not os.path.exists(path):
            own = f"{path}.{os.getpid()}"
            with open(own, "wb") as f:
                f.write(block)
            os.replace(own, path)
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that are not in the lexicon. All words step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state = np.full(len(words), self.root, np.int32)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            slot = self.base[state[live]] + text[begin[live] + step]
            ok = (slot < len(self.check)) & (self.check[np.minimum(slot, len(self.check) - 1)] == state[live])
            number[live[~ok]] = -1
            live, slot = live[ok], slot[ok]
            state[live] = self.target[slot]
            number[live] += self.output[slot]
            step += 1
            ended = size[live] == step
            done = live[ended]
            number[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        number[size == 0] = -1
        return number
