"""Token counts of whole texts under a byte-level BPE vocabulary.

A vocabulary splits text into pieces before it merges bytes, and the number of
tokens of a text is the sum over its pieces.  Finding the pieces is done with arrays for many
texts at once; only pieces not met before go through the merges.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import cache
from pathlib import Path

import numpy as np

from cladeframe.llm.words import _powers, mix

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern of the vocabulary that splits text before the merges, which `pieces` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Unicode white space.
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


def _kind(c: int) -> int:
    if c in SPACES:
        return _SPACE
    if 0xD800 <= c < 0xE000:
        return _OTHER
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)


@cache
def _kinds() -> np.ndarray:
    return np.array([_kind(c) for c in range(65536)], np.int8)


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text, and of every piece its start, end, text and 64-bit hash."""
    text = "\0".join(texts) + "\0"
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths) - 1
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.where(code < 65536, code, 0)] if len(code) and code.max() >= 65536 else _kinds()[code]
    for at in np.flatnonzero(code >= 65536):
        kind[at] = _kind(int(code[at]))
    kind[ends] = _END
    turn = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _END)]))
    start, end, of = turn, np.append(turn[1:], len(code)), kind[turn]
    after = np.append(of[1:], _END)
    # A run of white space before other text gives up its last character: a blank goes to what follows, any other stands alone.
    gives = (of == _SPACE) & (after != _END)
    blank = gives & (code[end - 1] == 32)
    joined = np.concatenate([[False], blank[:-1]])
    body = start - joined
    # Contractions: an apostrophe that begins a piece takes the letters after it.
    quote = np.flatnonzero((of == _OTHER) & (end - start == 1) & (code[start] == 39) & ~joined & (after == _LETTER))
    taken = np.zeros(len(turn), np.int64)
    if len(quote):
        one = code[end[quote]]
        two = np.where(end[quote] + 1 < end[quote + 1], code[np.minimum(end[quote] + 1, len(code) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken[quote] = np.where(short, 1, np.where(long, 2, 0))
    body = body + np.concatenate([[0], taken[:-1]])
    stop = end + taken
    first = np.where(of == _SPACE, start, body)
    stop = np.where(gives, end - 1, stop)
    alone = gives & ~blank
    begin = np.concatenate([first, end[alone] - 1])
    close = np.concatenate([stop, end[alone]])
    real = (close > begin) & np.concatenate([of != _END, np.ones(alone.sum(), bool)])
    begin, close = begin[real], close[real]
    up, down = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    h = mix((sums[close] - sums[begin]) * down[begin] + (close - begin).astype(np.uint64))
    return text, begin, close, np.searchsorted(ends, begin), h


class TokenCounter:
    """Counts tokens; ``path`` is a rank file (one base64 token and its rank a line)."""

    def __init__(self, path: str = DEFAULT, remember: int = 2_000_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = np.zeros(0, np.uint64)
        self.tokens = np.zeros(0, np.int64)
        self.remember = remember

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an empty text has none."""
        if not texts:
            return np.zeros(0, np.int64)
        text, begin, close, of, h = pieces(texts)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        n = np.zeros(len(distinct), np.int64)
        if not new.all():
            n[~new] = self.tokens[at[~new]]
        fresh = np.flatnonzero(new)
        n[fresh] = [len(self.encoding.encode_ordinary(text[begin[i] : close[i]])) for i in first[fresh]]
        if len(self.known) + len(fresh) > self.remember:
            self.known, self.tokens = distinct, n
        elif len(fresh):
            known = np.concatenate([self.known, distinct[fresh]])
            order = np.argsort(known, kind="stable")
            self.known, self.tokens = known[order], np.concatenate([self.tokens, n[fresh]])[order]
        return np.bincount(of, n[which.ravel()], len(texts)).astype(np.int64)
