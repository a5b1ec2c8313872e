"""Hashes of all words of many texts at once, in numpy.

Texts are laid end to end with a line break between them and cut into blocks at
white space, so memory is bounded by the block and not by the longest text. A
word's hash is a polynomial in its bytes, so it does not depend on its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)

#: ASCII white space ends a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """The words of some texts, or of a piece of one long text."""

    data: np.ndarray  # bytes, as given
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    hashes: np.ndarray
    docs: np.ndarray  # the text that each word is in
    first: int  # number of the first text with bytes here
    edges: np.ndarray  # where the texts first, first + 1, ... begin in data


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + _ONE) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks(texts: list[str | None], fold: np.ndarray = LOWER, inside: np.ndarray = ~SPACE) -> Iterator[Block]:
    """Blocks over all texts, in order. A word is a run of bytes in ``inside``
    after folding by ``fold``; bytes outside it must include white space."""
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    group: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(coded):
        if size + len(text) > BLOCK and group:
            yield from _cut(group, first, fold, inside)
            group, size, first = [], 0, i
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _cut(group, first, fold, inside)


def _cut(group: list[bytes], first: int, fold: np.ndarray, inside: np.ndarray) -> Iterator[Block]:
    lengths = np.fromiter((len(x) + 1 for x in group), dtype=np.int64, count=len(group))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK + (1 << 15))
        if hi < len(data):  # only a single text is longer than a block
            gaps = np.flatnonzero(SPACE[data[lo:hi]])
            if len(gaps) and gaps[-1] > 0:
                hi = lo + int(gaps[-1])
            else:
                later = np.flatnonzero(SPACE[data[hi:]])
                hi += int(later[0])
        part = data[lo:hi]
        folded = fold[part]
        starts, ends = spans(inside[folded])
        docs = np.searchsorted(begins, starts + lo, side="right") - 1 + first
        at = int(np.searchsorted(begins, lo, side="right")) - 1
        stop = int(np.searchsorted(begins, hi, side="left"))
        yield Block(part, starts, ends, hash_spans(folded, starts, ends), docs, first + at, begins[at:stop] - lo)
        lo = hi


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, ASCII letters in lower case."""
    at, held = 0, []
    for block in blocks(texts):
        if not len(block.docs):
            continue
        changes = np.flatnonzero(np.diff(block.docs)) + 1
        for lo, hi in zip(np.concatenate([[0], changes]), np.concatenate([changes, [len(block.docs)]])):
            doc = int(block.docs[lo])
            while at < doc:
                yield _joined(held)
                held, at = [], at + 1
            held.append(block.hashes[lo:hi])
    while at < len(texts):
        yield _joined(held)
        held, at = [], at + 1


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | _ONE


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words (of all words, if there are fewer)."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out += words[j : j + n] * _PLACES[j]
    return mix(out)
