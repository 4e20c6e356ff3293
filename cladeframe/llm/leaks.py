"""Held-out passages inside a corpus.

Item texts are cut into windows of ``width`` words at every position, and documents
are searched from every position.  A random walk embeds each window: step j emits the word under the
pointer and moves on by a random bit of (j, word), so that few word edits make
few differing symbols in the walks (CGK embedding of edit into Hamming
distance).  Repeated bit-sampling LSH joins windows that agree on random
positions of their walks; every hit is verified by exact edit distance.  The items are a stated query set: they are
broadcast in blocks of bounded size, and each block is one pass over all
documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.words import chunks, mix, words_of


@dataclass(frozen=True)
class LeakSpec:
    """``width`` words a window, at most ``edits`` word edits between windows.

    ``walks`` independent embeddings, each with ``repeats`` tables of ``sampled`` walk
    positions among the first ``reach`` times ``width`` steps (later ones often lie behind the end of the window, where all
    walks agree): after an edit two walks may stay out of step for long, so few
    embeddings would lose some pairs in all their tables.  ``block`` characters of item
    text are broadcast at once.  A text's passage of ``width - edits`` to ``width + edits``
    words is met by the walk that starts at its first word.  For equal windows every table hits, so
    recall is 1; the tests measure it for one and two replaced, left out and inserted words.
    """

    width: int = 20
    edits: int = 2
    walks: int = 10
    repeats: int = 2
    sampled: int = 7
    reach: float = 1.5
    seed: int = 11
    block: int = 4_000_000


class Lookup:
    """Places of 64-bit hashes in a sorted list without repeats; a bit map turns most strangers away."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(16, min(26, len(known).bit_length() + 4))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._slot(known)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``asked`` are known, and the place of each of these."""
        may = np.flatnonzero(self.map[self._slot(asked)])
        near = np.searchsorted(self.known, asked[may])
        near[near == len(self.known)] = 0
        same = self.known[near] == asked[may] if len(self.known) else np.zeros(len(may), bool)
        return may[same], near[same]


class WindowIndex:
    """Distinct windows of items and their LSH tables."""

    def __init__(self, items: list[tuple[int, str]], spec: LeakSpec):
        self.spec = spec
        rng = np.random.default_rng(spec.seed)
        steps = 3 * spec.width
        self.looked = None
        self.salt = rng.integers(0, 1 << 63, (spec.walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.at = [[np.sort(rng.choice(int(spec.reach * spec.width), spec.sampled, replace=False)) for _ in range(spec.repeats)] for _ in range(spec.walks)]
        self.tone = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        c = words_of([t or "" for _, t in items])
        self.vocabulary = np.unique(c.hash)
        self.words = Lookup(self.vocabulary)
        ids = np.searchsorted(self.vocabulary, c.hash).astype(np.int32)
        start = self._starts(c.of)
        windows = ids[start[:, None] + np.arange(spec.width)] if len(start) else np.zeros((0, spec.width), np.int32)
        self.windows, which = np.unique(windows, axis=0, return_inverse=True) if len(windows) else (windows, np.zeros(0, np.int64))
        item = np.array([i for i, _ in items], np.int64)[c.of[start]] if len(start) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.tables = []
        for sign in self.signatures(self.windows):
            order = np.argsort(sign, kind="stable")
            known, first = np.unique(sign[order], return_index=True)
            self.tables.append((Lookup(known), np.append(first, len(order)), order))

    def _starts(self, of: np.ndarray) -> np.ndarray:
        """First words of the windows that lie in one text."""
        w = self.spec.width
        return np.flatnonzero(of[w - 1 :] == of[: len(of) - w + 1]) if len(of) >= w else np.zeros(0, np.int64)

    def signatures(self, windows: np.ndarray) -> list[np.ndarray]:
        """For every table, the hashed symbols at its walk positions.

        Word ids are small (-2 pads a finished walk, -1 is a word of no item), so the
        random bits and the hashes of (step, word) are looked up.
        """
        n, w = windows.shape
        words = np.arange(-2, len(self.vocabulary)).astype(np.uint64)
        if self.looked is None:
            step = [[(mix(words ^ x) & np.uint64(1)).astype(np.int32) for x in salt] for salt in self.salt]
            self.looked = step, [mix(words * x + x) for x in self.tone]
        steps, hashes = self.looked
        padded = np.zeros((n, 3 * w + 1), np.int32)
        padded[:, :w] = windows + 2
        flat = padded.ravel()
        every = []
        for bits, tables in zip(steps, self.at):
            out = [np.zeros(n, np.uint64) for _ in tables]
            place = np.arange(n, dtype=np.int64) * padded.shape[1]
            for j in range(1 + max(int(at[-1]) for at in tables)):
                symbol = flat[place]
                for r, at in enumerate(tables):
                    if j in at:
                        out[r] += hashes[j][symbol]
                place += bits[j][symbol]
            every += [mix(x) for x in out]
        return every

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index of text, item, edits)``, the least edits of each pair."""
        none = (np.zeros(0, np.int64),) * 3
        c = words_of(texts)
        w, k = self.spec.width, self.spec.edits
        if len(c.hash) < w - k or not len(self.windows):
            return none
        ids = np.full(len(c.hash) + w + k, -2, np.int32)
        ids[: len(c.hash)] = -1
        known, place = self.words.find(c.hash)
        ids[known] = place
        # Of a passage within k edits of an item's window, all but k of the window's words stand in the first ``width``.
        total = np.concatenate([[0], np.cumsum(ids >= 0)])
        ends = np.searchsorted(c.of, c.of, "right")
        start = np.arange(len(c.hash))
        start = start[total[np.minimum(start + w, ends)] - total[start] >= w - k]
        if not len(start):
            return none
        # Up to k words more are looked at, since inserted words make a passage longer; what lies behind a text's end is no word.
        place = start[:, None] + np.arange(w + k)
        windows = np.where(place < ends[start][:, None], ids[place], -2)
        found = []
        for sign, (table, first, order) in zip(self.signatures(np.ascontiguousarray(windows[:, :w])), self.tables):
            hit, place = table.find(sign)
            low, n = first[place], first[place + 1] - first[place]
            a = np.repeat(hit, n)
            b = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(a * len(self.windows) + b)
        pair = np.sort(np.concatenate(found))
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        a, b = pair // len(self.windows), pair % len(self.windows)
        edits = self.distance(windows[a], self.windows[b])
        a, b, edits = (x[edits <= k] for x in (a, b, edits))
        n = self.first[b + 1] - self.first[b]
        doc = np.repeat(c.of[start[a]], n)
        item = self.item[np.repeat(self.first[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        edits = np.repeat(edits, n)
        order = np.lexsort((edits, item, doc))
        doc, item, edits = doc[order], item[order], edits[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[new], item[new], edits[new]

    def distance(self, a: np.ndarray, b: np.ndarray, block: int = 50_000) -> np.ndarray:
        """Least word edits (insert, delete, replace) that make the start of a row of ``a``, of any length, the row of ``b``; ``edits + 1`` if more.

        Rows of ``a`` are ``edits`` words longer than those of ``b``.
        """
        k, w = self.spec.edits, b.shape[1]
        out = np.where((a[:, :w] == b).all(1), 0, k + 1)
        todo = np.flatnonzero(out)
        for at in (todo[i : i + block] for i in range(0, len(todo), block)):
            x, y = a[at], b[at]
            # Within k edits all but k words of the window stand at most k places away in the text.
            meets = np.zeros(y.shape, bool)
            for s in range(-k, k + 1):
                i = slice(max(0, -s), w)
                meets[:, i] |= y[:, i] == x[:, max(0, s) : w + s]
            near = (~meets).sum(1) <= k
            out[at[near]] = self._edits(x[near], y[near])
        return out

    def _edits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Edits within the band that ``edits`` allows, all rows at once; the end in ``x`` is free."""
        k, (n, w) = self.spec.edits, y.shape
        far = k + 1
        row = np.full((n, w + k + 1), far, np.int16)
        row[:, :far] = np.arange(far)
        for i in range(1, w + 1):
            new = np.full((n, w + k + 1), far, np.int16)
            if i <= k:
                new[:, 0] = i
            for j in range(max(1, i - k), i + k + 1):
                if j > w + k:
                    break
                step = row[:, j - 1] + (y[:, i - 1] != x[:, j - 1])
                new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, step)
            row = new
        return np.minimum(row[:, w - k : w + k + 1].min(1), far).astype(np.int64)


def _blocks(items: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in runs of at most ``most`` characters (one item at least), read one partition at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("i"), F.col(text_column).alias("t")).toLocalIterator():
        text = r.t or ""
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((r.i, text))
        held += len(text)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc_id, item_id, edits)``: documents with a window within ``spec.edits`` word edits of one of the item's.

    ``edits`` is the least over all windows that met; 0 means ``width``
    consecutive words of the item stand in the document.  Null and empty texts,
    texts of fewer than ``width - edits`` words and items of fewer than ``width``, have no window.  Rows are kept
    apart by ``doc_id``; repeated ids give one row per item.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, edits int"
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for block in _blocks(items, item_id, item_text, spec.block):
        held = spark.sparkContext.broadcast(WindowIndex(block, spec))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for ids, texts in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    doc, item, edits = index.hits(texts)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[i] for i in doc], pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"]
                        )

        parts.append(rows.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
