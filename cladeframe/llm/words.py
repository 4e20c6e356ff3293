"""Words of many texts at once, as arrays.

Words are the maximal runs of letters and digits, compared without regard to
case.  Texts are joined into chunks of code points, so that finding, lowering
and hashing words are array operations without a loop over words.  A text is
never cut: one longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

CHUNK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the code points below 65536: in a word, a digit, lower case."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(65536)]
    word = np.array([c.isalnum() for c in every])
    digit = np.array([c.isdigit() or c.isnumeric() for c in every])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.uint32)
    return word, digit, lower


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 2:
            _POWERS.clear()
        up = np.full(size, _BASE)
        down = np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of a public hash)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Words of several texts: their 64-bit hashes, places in ``text`` and the index of their text."""

    text: str
    first: np.ndarray  # of each text, its start in ``text``
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    digit: np.ndarray  # does the word hold a digit
    of: np.ndarray


def words_of(texts: list[str]) -> Chunk:
    """All words of ``texts``; a text that is empty has none."""
    text = "\n".join(texts)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word, digit, lower = _tables()
    small = code if not len(code) or code.max() < 65536 else np.where(code < 65536, code, 32)
    inside, digits, low = word[small], digit[small], lower[small]
    if small is not code:
        far = np.flatnonzero(code >= 65536)
        for c in np.unique(code[far]):
            at = far[code[far] == c]
            ch = chr(int(c))
            inside[at], digits[at] = ch.isalnum(), ch.isnumeric()
            low[at] = ord(ch.lower()) if len(ch.lower()) == 1 else int(c)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    count = np.zeros(len(code) + 1, np.int32)
    np.cumsum(digits, out=count[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    of = np.searchsorted(first, start, "right") - 1
    return Chunk(text, first, start, end, h, count[end] > count[start], of)


def chunks(rows: Iterable[tuple[int, str]], size: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Rows ``(id, text)`` in runs of about ``size`` characters; a null text counts as empty."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for i, t in rows:
        t = t or ""
        ids.append(i)
        texts.append(t)
        held += len(t) + 1
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
