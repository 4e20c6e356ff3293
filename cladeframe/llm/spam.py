"""Keyword-stuffed pages, link lists and tag lists.

Sentences and programs are made of collocations; a list of keywords is not.  For
neighbouring words x, y the pointwise mutual information
PMI(x, y) = log2 c(xy) N / c(x) c(y) is taken from counts over the whole corpus.  It is put
on its normal scale, divided by -log2 c(xy) / N (1 for words that only stand together, 0 for
words that stand together by chance), where multiples of all counts fall out of it; and it is discounted by
c(xy) / (c(xy) + 1) and m / (m + 1), m the rarer word's count, since a pair seen once is no evidence of a collocation.
A passage of low mean PMI is salad.  Keywords of one subject are rare elsewhere and meet often, which
raises their PMI up to that of sentences; such a passage is told by its collocations, which recur in it, or in other passages of the
document, copies of the same words aside: it is excessive repetition.  The rarer such a subject is in the corpus, the higher its PMI;
so a passage is salad too if its pairs stand as often the other way round, by the mean of (c(xy) - c(yx)) / (c(xy) + c(yx) + 1).
A passage made of addresses, or of tags, is a list of these.  A document comes out if
more than half of its words stand in such passages.

A passage is a line, or a run of lines of up to ``SHORT`` words each.  Two steps read the
texts once: every batch gives its counts of words and pairs, and the passages of those
documents that could come out at all if every passage that may be judged were
spam.  Only their distinct pairs and words are looked up in the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.words import chunks, mix, words_of
from cladeframe.workspace import Workspace

ADDRESS = re.compile(r"""(?:https?://|www\.)[^\s<>"')\]]+""")
# Last labels of addresses that stand without http or www.
DOMAINS = "com org net edu gov info biz io co shop store online site xyz club example test invalid de fr es pt it uk eu ru cn jp us".split()
_DOMAIN = re.compile(rf"\.(?:{'|'.join(DOMAINS)})(?=[/:?,;]|\s|$)")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*$")
# What separates the items of an enumeration, and what code has and such a list has not.
SEPARATORS, MARKS = ",;|/\u00b7\u2022\n", "'\"()[]{}=<>\\"
#: Most words of a line that is read together with its like.
SHORT = 3
_SCHEMA = "kind tinyint, a bigint, b bigint, c bigint, d bigint"
_COUNT, _PAIR, _SEEN, _LINE, _DOC, _TOTAL = range(6)


@dataclass(frozen=True)
class SpamSpec:
    """Thresholds; all are shares, normalised PMI, or counts within one passage or document: the same for all counts of the corpus multiplied.

    ``words``/``pairs``: least letter words and neighbouring pairs of a passage to be judged.
    ``links``: share of a passage's words in addresses that makes it a link list; ``tags``: the same for tags, two at least.
    ``items``: parts of at most two words on average, without a mark of code, that make a passage an enumeration: it is judged for salad whether its words recur or not.
    ``often``: times a word must occur in its document to recur; ``recur``/``strong``: share of a passage's words that recur, for salad and for repetition.
    ``salad``: mean PMI below which a passage is salad; ``stuffed``: the same for one of recurring words; ``order``: mean share of one order below which it is salad too;
    ``loose``: mean PMI below which a passage is repetition, if its collocations recur: at least ``again`` of its pairs
    stand twice in the document and ``whole`` of its words recur; or one word stands in the passage ``inline`` times, is at least the
    share ``keyword`` of the words, and its words recur (a keyword put into fixed phrases); or the share ``template`` of its words stand in pairs of
    two words that stand there ``inline`` times. If ``whole`` of its words do and there is no mark of code, it is repetition whatever the PMI.
    ``share``: share of the document's words.
    """

    words: int = 5
    pairs: int = 3
    links: float = 0.4
    tags: float = 0.6
    items: int = 8
    often: int = 3
    recur: float = 0.6
    strong: float = 0.8
    salad: float = 0.36
    stuffed: float = 0.42
    order: float = 0.55
    loose: float = 0.62
    again: float = 0.6
    whole: float = 0.95
    inline: int = 3
    template: float = 0.5
    keyword: float = 0.33
    share: float = 0.5


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of equal runs."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.append(first, len(sorted_keys)))


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    order = np.argsort(keys, kind="stable")
    first, n = _runs(keys[order])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(n, n)
    return out


class _Counts:
    """Counts of 64-bit keys of one task, merged now and then and handed on when many."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.held, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first, n = _runs(keys)
        self.held.append((keys[first], n))
        self.size += len(first)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.held])
        n = np.concatenate([c for _, c in self.held])
        order = np.argsort(keys, kind="stable")
        first, _ = _runs(keys[order])
        keys, n = keys[order][first], np.add.reduceat(n[order], first) if len(first) else n
        self.held, self.size = [(keys, n)], len(keys)
        return keys, n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.held, self.size = [], 0
        return out

    def full(self) -> bool:
        if self.size > self.most:
            self.merged()
        return self.size > self.most // 2 and len(self.held) == 1


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    every = [np.asarray(c).astype(np.int64, copy=False) if np.asarray(c).dtype != np.uint64 else np.asarray(c).view(np.int64) for c in columns]
    every += [np.zeros(n, np.int64)] * (4 - len(every))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *map(pa.array, every)], ["kind", "a", "b", "c", "d"])


def _addresses(text: str, blank: np.ndarray) -> np.ndarray:
    """Spans of addresses: with http or www, or a word that ends in a domain, perhaps with a path."""
    spans = [m.span() for m in ADDRESS.finditer(text)]
    at = np.flatnonzero(blank)
    for m in _DOMAIN.finditer(text):
        k = int(np.searchsorted(at, m.start()))
        start = int(at[k - 1]) + 1 if k else 0
        end = int(at[k]) if k < len(at) else len(text)
        word = text[start : m.start()]
        host = _HOST.search(word)
        if host and not word[: host.start()].strip("*-([<"):
            spans.append((start, end))
    spans.sort()
    return np.array(spans, np.int64).reshape(-1, 2)


def _codes(characters: str, n: int = 65536) -> np.ndarray:
    out = np.zeros(n, bool)
    out[[ord(c) for c in characters]] = True
    return out


_IS_MARK, _IS_SEPARATOR = _codes(MARKS), _codes(SEPARATORS)
_IS_BLANK = _codes("".join(chr(i) for i in range(65536) if not 0xD800 <= i < 0xE000 and chr(i).isspace()))


def _count(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights, minlength=n).astype(np.int64)


def _twice(pair: np.ndarray, line: np.ndarray, of: np.ndarray, n_lines: int) -> np.ndarray:
    """Of each passage, the pairs that stand twice in its text, where passages of the same pairs are taken once."""
    first, n = _runs(line)
    _, one, same = np.unique(mix(np.add.reduceat(pair, first) ^ mix(of[first].astype(np.uint64))), return_index=True, return_inverse=True)
    kept = np.zeros(len(first), bool)
    kept[one] = True
    kept = np.repeat(kept, n)
    pair, of, where = pair[kept], of[kept], line[kept]
    twice = _count(where[_times(mix(pair ^ mix(of.astype(np.uint64)))) >= 2], n_lines)
    twice[line[first]] = twice[line[first[one]]][same]
    return twice


def _analyse(ids: list[int], texts: list[str], spec: SpamSpec, counts: _Counts) -> Iterator[pa.RecordBatch]:
    c = words_of(texts)
    if not len(c.hash):
        return
    code = np.frombuffer(c.text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 65536, code, 0x4E00)
    blank = _IS_BLANK[code]
    breaks = np.flatnonzero(code == 10)
    line, n_lines = np.searchsorted(breaks, c.start), len(breaks) + 1
    spans = _addresses(c.text, blank)
    which = np.searchsorted(spans[:, 0], c.start, "right") - 1
    linked = (which >= 0) & (c.start < spans[np.maximum(which, 0), 1]) if len(spans) else np.zeros(len(c.start), bool)
    # A tag is a # before a letter and after a blank or a comma, up to the next blank.
    sharp = np.flatnonzero(code == 35)
    before, after = np.where(sharp > 0, code[sharp - 1], 32), code[np.minimum(sharp + 1, len(code) - 1)]
    sharp = sharp[(_IS_BLANK[before] | (before == 44)) & ~_IS_BLANK[after]]
    blanks = np.cumsum(blank)
    tag = np.searchsorted(sharp, c.start, "right") - 1
    tagged = (tag >= 0) & ~linked
    if len(sharp):
        tagged &= blanks[sharp[np.maximum(tag, 0)]] == blanks[c.start]
        first_of_tag = tagged & (c.start == sharp[np.maximum(tag, 0)] + 1)
    else:
        first_of_tag = tagged
    letter = ~linked & ~c.digit

    # Short lines of plain words that follow one another are one passage.
    line_start = np.concatenate([[0], breaks + 1])
    line_of_char = np.searchsorted(breaks, np.flatnonzero(_IS_MARK[code]))
    marks = _count(line_of_char, n_lines)
    words, letters = _count(line, n_lines), _count(line[letter], n_lines)
    short = (words > 0) & (words <= SHORT) & (letters == words) & (marks == 0)
    doc_of_line = np.searchsorted(c.first, line_start, "right") - 1
    joins = short & np.concatenate([[False], short[:-1] & (doc_of_line[1:] == doc_of_line[:-1])])
    passage = np.cumsum(~joins) - 1
    line, n_lines = passage[line], int(passage[-1]) + 1
    marks, doc_of_line = _count(passage, n_lines, marks), doc_of_line[~joins]
    words, letters = _count(line, n_lines), _count(line[letter], n_lines)

    line_words, link_words, doc_words = words, _count(line[linked], n_lines), _count(c.of, len(ids))
    # An address, and a word with a digit, part their neighbours: each stands as one break in the row of letter words.
    follows = letter[1:] & letter[:-1] & (line[1:] == line[:-1])
    at = np.flatnonzero(follows)
    x, y = c.hash[at], c.hash[at + 1]
    forward = mix(x + np.uint64(3) * mix(y))
    counts.add(forward)

    where = np.flatnonzero(letter)
    counts.add(c.hash[where])
    yield _rows(_TOTAL, np.array([len(where)]))
    often = _times(mix(c.hash[where] ^ mix(c.of[where].astype(np.uint64)))) >= spec.often
    recurring, pairs = _count(line[where[often]], n_lines), _count(line[at], n_lines)
    separators = np.cumsum(_IS_SEPARATOR[code])
    parts = 1 + _count(line[at], n_lines, separators[c.start[at + 1]] > separators[c.end[at] - 1])
    listing = (parts >= spec.items) & (letters <= 2 * parts) & (marks == 0)
    is_link = (link_words >= spec.links * np.maximum(line_words, 1)) & (link_words > 0)
    is_link |= (_count(line[tagged], n_lines) >= spec.tags * np.maximum(line_words, 1)) & (_count(line[first_of_tag], n_lines) >= 2)
    judged = ~is_link & (letters >= spec.words) & (pairs >= spec.pairs) & ((recurring >= spec.recur * letters) | listing)
    linked_of = _count(doc_of_line, len(ids), is_link * line_words)
    judged_of = _count(doc_of_line, len(ids), judged * line_words)
    chosen = linked_of + judged_of > spec.share * doc_words
    docs = np.flatnonzero(chosen)
    if not len(docs):
        return
    name = np.array(ids, np.int64)
    yield _rows(_DOC, name[docs], doc_words[docs], linked_of[docs])
    lines = np.flatnonzero(judged & chosen[doc_of_line])
    if not len(lines):
        return
    same = np.zeros(n_lines, np.int64)
    np.maximum.at(same, line[where], _times(mix(c.hash[where] ^ mix(line[where].astype(np.uint64)))))
    keyed = (same >= spec.inline) & (same >= spec.keyword * letters)
    in_line = at[(_times(mix(forward ^ mix(line[at].astype(np.uint64)))) >= spec.inline) & (x != y)]
    covered = np.zeros(len(line), bool)
    covered[in_line] = covered[in_line + 1] = True
    covered = _count(line[covered], n_lines)
    strong = recurring >= spec.strong * letters
    again = (recurring >= spec.whole * letters) & (_twice(forward, line[at], c.of[at], n_lines) >= spec.again * pairs)
    flags = strong + 2 * (again | (strong & keyed) | (covered >= spec.template * letters)) + 4 * ((covered >= spec.whole * letters) & (marks == 0))
    yield _rows(_LINE, name[doc_of_line[lines]], lines, line_words[lines], flags[lines])
    keep = (judged & chosen[doc_of_line])[line[at]]
    yield _rows(_SEEN, name[c.of[at[keep]]], line[at[keep]], forward[keep])
    x, y, f = x[keep], y[keep], forward[keep]
    f, one = np.unique(f, return_index=True)
    x, y = x[one], y[one]
    yield _rows(_PAIR, f, x, y, mix(y + np.uint64(3) * mix(x)))


def scan(documents: DataFrame, spec: SpamSpec, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: counts, and what the later steps need of documents that could come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for ids, texts in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                yield from _analyse(ids, texts, spec, counts)
                if counts.full():
                    yield _rows(_COUNT, *counts.take())
        if counts.held:
            yield _rows(_COUNT, *counts.take())

    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(text))
    return work.save(rows.mapInArrow(run, _SCHEMA), "scan")


def judged_lines(scanned: DataFrame, spec: SpamSpec, work: Workspace) -> DataFrame:
    """``(doc_id, line, line_words, mean_pmi, mean_order, spam)`` of the judged passages; ``mean_pmi`` is normalised and discounted.

    ``line`` counts within the batch, so (doc_id, line) is a key of a passage.
    """
    kind = lambda k, *names: scanned.where(F.col("kind") == k).select(*[F.col(c).alias(n) for c, n in zip("abcd", names)])
    total = kind(_TOTAL, "n").agg(F.sum("n")).first()[0] or 0
    pairs = kind(_PAIR, "xy", "x", "y", "yx").distinct()
    asked = pairs.select(F.explode(F.array("xy", "x", "y", "yx")).alias("k")).distinct()
    counts = kind(_COUNT, "key", "n").join(asked, F.col("key") == F.col("k"), "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    counts = work.save(counts, "counts")
    for of in ("xy", "x", "y", "yx"):
        pairs = pairs.join(counts.select(F.col("key").alias(f"k_{of}"), F.col("n").alias(f"n_{of}")), F.col(of) == F.col(f"k_{of}"), "left")
    log = lambda n: F.log2(F.col(n))
    every, least = F.log2(F.lit(float(total))), F.least("n_x", "n_y")
    pmi = (log("n_xy") + every - log("n_x") - log("n_y")) / (every - log("n_xy"))
    back = F.coalesce("n_yx", F.lit(0))
    order = (F.col("n_xy") - back) / (F.col("n_xy") + back + 1)
    known = pairs.select("xy", (pmi * F.col("n_xy") / (F.col("n_xy") + 1) * least / (least + 1)).alias("pmi"), order.alias("order"))
    seen = kind(_SEEN, "doc_id", "line", "seen").groupBy("doc_id", "line", "seen").agg(F.count(F.lit(1)).alias("times"))
    mean = lambda v: (F.sum(F.col(v) * F.col("times")) / F.sum("times")).alias(f"mean_{v}")
    means = seen.join(known, F.col("seen") == F.col("xy")).groupBy("doc_id", "line").agg(mean("pmi"), mean("order"))
    lines = kind(_LINE, "l_doc", "l_line", "line_words", "flags")
    both = lines.join(means, (F.col("l_doc") == F.col("doc_id")) & (F.col("l_line") == F.col("line")))
    strong, repeated, nothing_else = (F.col("flags").bitwiseAND(bit) > 0 for bit in (1, 2, 4))
    below = lambda most: F.col("mean_pmi") < most
    spam = below(spec.salad) | (F.col("mean_order") < spec.order) | (strong & below(spec.stuffed)) | (repeated & below(spec.loose)) | nothing_else
    return both.select("doc_id", "line", "line_words", "mean_pmi", "mean_order", spam.alias("spam"))


def spam_pages(documents: DataFrame, work: Workspace, spec: SpamSpec = SpamSpec()) -> DataFrame:
    """``(doc_id, n_words, link_words, listed_words, share)`` of documents of which more than ``spec.share`` is links, lists or tags.

    Null and empty texts, and texts without words, never come out.  Ids are
    taken as unique; a repeated id is judged by the lines of all its texts.
    """
    scanned = scan(documents, spec, work)
    lines = judged_lines(scanned, spec, work)
    listed = lines.where("spam").groupBy("doc_id").agg(F.sum("line_words").alias("listed_words"))
    docs = scanned.where(F.col("kind") == _DOC).groupBy(F.col("a").alias("doc")).agg(F.sum("b").alias("n_words"), F.sum("c").alias("link_words"))
    every = docs.join(listed, F.col("doc") == F.col("doc_id"), "left").select(
        F.col("doc").alias("doc_id"), "n_words", "link_words", F.coalesce("listed_words", F.lit(0)).alias("listed_words")
    )
    every = every.withColumn("share", (F.col("link_words") + F.col("listed_words")) / F.col("n_words"))
    return every.where(F.col("share") > spec.share)
