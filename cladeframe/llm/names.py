"""Free-entered names to the entries of a reference list.

Distinct values only are mapped, in Arrow batches over all tasks, by an index that every
worker process builds once from the reference list (bounded: see ``MOST_ENTRIES``):

1. A multi-pattern automaton holds the canonical names and their aliases (parts
   in reverse order, joined, genus abbreviated).  Of all mentions in the cleaned
   value the longest non-overlapping ones win, from the left.
2. What is left goes to token-set similarity: the set of tokens of the value is
   compared with the set (genus, epithet) of every entry that the deletion
   neighbourhoods of the tokens reach, wherever and in whatever order these stand.
   Tokens meet softly, by their letters: the similarity is the share of the
   entry's letters that the two best tokens keep.

A value means an entry only if that entry alone is closest; ties, a genus
alone, and names too far from any entry mean none (-1).
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.workspace import spread

#: The reference list is sent to every worker; a longer one is refused.
MOST_ENTRIES = 200_000
NONE = -1
#: The index of the last reference list, kept by each worker process between its tasks.
_HELD: dict[str, NameIndex] = {}

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("абвеіјкмнорстухѕԁһԛԝѵαβεικνορτυχ", "abbeijkmhopctyxsdhqwvabeiknoptux")
# Words that express certainty, rank or state and are no part of a name.
QUALIFIERS = frozenset("cf aff nr near prope sp spp ssp subsp var f forma indet nov gen affinis confer ex".split())
# Letters that do not decompose.
LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "þ": "th"})


def clean(value: str) -> str:
    """Lower-case ASCII-like words with single blanks: entities, escapes, marks, lookalikes and invisible characters resolved."""
    text = html.unescape(unquote(value))
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = text.lower().translate(LETTERS).translate(LOOKALIKES)
    return " ".join(re.findall(r"[^\W\d_]+", text))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, or ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def shortened(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` letters left out."""
    every = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        every = every | last
    return every


class Words:
    """Words of the list that are within some edits of a given word."""

    def __init__(self, words: set[str], most: int):
        self.most, self.words = most, words
        self.longest = max(map(len, words), default=0)
        self.by: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for s in shortened(w, most):
                self.by[s].append(w)
        self.known: dict[str, dict[str, int]] = {}

    def near(self, word: str) -> dict[str, int]:
        if word not in self.known:
            if len(word) > self.longest + self.most:  # farther than that from every word of the list
                return {}
            if len(self.known) > 100_000:
                self.known.clear()
            seen = {w for s in shortened(word, self.most) for w in self.by.get(s, ())}
            near = {w: distance(word, w, self.most) for w in seen}
            self.known[word] = {w: d for w, d in near.items() if d <= self.most}
        return self.known[word]


class NameIndex:
    """The automaton and the token index over ``(taxon_id, canonical_name)`` entries.

    ``edits``: most edits in one token; ``both``: most edits in the two tokens
    together; ``share``: most edits as a share of a token's letters; ``short``: most letters of an abbreviated genus.
    """

    def __init__(self, entries: list[tuple[int, str]], edits: int = 2, both: int = 3, share: float = 0.34, short: int = 4):
        import ahocorasick

        self.both, self.share, self.short = both, share, short
        self.entry: dict[tuple[str, str], int] = {}
        patterns: dict[str, set[int]] = defaultdict(set)
        self.by_epithet: dict[str, set[str]] = defaultdict(set)
        for taxon, name in entries:
            words = clean(name).split()
            if len(words) < 2:
                continue
            g, e = words[0], words[-1]
            self.entry[g, e] = taxon
            self.by_epithet[e].add(g)
            for alias in (f" {g} {e} ", f" {e} {g} ", f" {g}{e} "):
                patterns[alias].add(taxon)
            for k in range(1, min(short + 1, len(g))):
                patterns[f" {g[:k]} {e} "].add(taxon)
        self.automaton = ahocorasick.Automaton()
        for alias, taxa in patterns.items():
            self.automaton.add_word(alias, (len(alias), tuple(sorted(taxa))))
        if patterns:
            self.automaton.make_automaton()
        self.some = bool(patterns)
        self.genera = Words({g for g, _ in self.entry}, edits)
        self.epithets = Words({e for _, e in self.entry}, edits)

    def mentions(self, text: str) -> list[tuple[int, ...]]:
        """Entries of the longest non-overlapping mentions in cleaned text, from the left."""
        if not self.some or not text:
            return []
        found = [(end - n + 1, -n, taxa) for end, (n, taxa) in self.automaton.iter(f" {text} ")]
        found.sort(key=lambda x: (x[1], x[0]))  # longest first, then leftmost
        covered, taken = bytearray(len(text) + 2), []
        for start, minus, taxa in found:
            end = start - minus - 1  # the blank at an end may be shared
            if covered.find(1, start, end) < 0:
                covered[start:end] = b"\1" * (end - start)
                taken.append((start, taxa))
        return [taxa for _, taxa in sorted(taken)]

    def similar(self, words: list[str]) -> int:
        """The entry of greatest token-set similarity to the words, or -1 where none is near or several are equally so.

        An abbreviated genus keeps all letters it has, and must stand beside the epithet.
        """
        fits = lambda d, w: d <= max(1, int(len(w) * self.share))
        epithets: dict[str, list[tuple[int, int]]] = defaultdict(list)
        genera: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, x in enumerate(words):
            for e, d in self.epithets.near(x).items():
                if fits(d, e):
                    epithets[e].append((d, i))
            for g, d in self.genera.near(x).items():
                if fits(d, g):
                    genera[g].append((d, i))
        best, at = (0, 0.0), set()
        for e, ends in epithets.items():
            for g in self.by_epithet[e]:
                # The least in two different places: of three candidates each, some pair stands apart.
                total = min((d + f for d, i in sorted(ends)[:3] for f, j in sorted(genera.get(g, ()))[:3] if i != j), default=self.both + 1)
                for d, i in ends if total > 0 else ():
                    if d < total and any(len(y) <= self.short and g.startswith(y) for y in words[max(0, i - 1) : i] + words[i + 1 : i + 2]):
                        total = d
                if total <= self.both:
                    score = (self.both + 1 - total, 1 - total / (len(g) + len(e)))  # fewer edits first, then the share of letters kept
                    if score > best:
                        best, at = score, {self.entry[g, e]}
                    elif score == best:
                        at.add(self.entry[g, e])
        return at.pop() if len(at) == 1 else NONE

    def find(self, value: str) -> int:
        """The entry that ``value`` means, or -1."""
        text = clean(value)
        for kept in (text, " ".join(w for w in text.split() if w not in QUALIFIERS)):
            for taxa in self.mentions(kept):
                if len(taxa) == 1:
                    return taxa[0]
        words = [w for w in text.split() if w not in QUALIFIERS]
        found = self.similar(words)
        if found == NONE and words:
            joined = self._joined(words)
            found = joined if joined is not None else NONE
        return found

    def _joined(self, words: list[str]) -> int | None:
        """Both parts written as one word, perhaps misspelt: every cut of a word of fitting length is tried as two words."""
        hits = set()
        longest = self.genera.longest + self.epithets.longest + self.both
        for w in words:
            if len(w) <= longest:
                for k in range(1, len(w)):
                    if w[:k] in self.genera.words or w[k:] in self.epithets.words:
                        hit = self.similar([w[:k], w[k:]])
                        if hit != NONE:
                            hits.add(hit)
        return hits.pop() if len(hits) == 1 else None


def map_names(values: DataFrame, column: str, reference: DataFrame, id_column: str = "taxon_id", name_column: str = "canonical_name") -> DataFrame:
    """``(value, taxon_id)`` of every distinct non-null value of ``column``; -1 where it means no entry.

    Refuses a reference list of more than ``MOST_ENTRIES`` entries, since each
    worker holds it.  Entries with a null id or name are left out; the same name
    under two ids goes to the smaller.
    """
    rows = (
        reference.where(F.col(id_column).isNotNull() & F.col(name_column).isNotNull())
        .groupBy(F.col(name_column).alias("n")).agg(F.min(id_column).cast("bigint").alias("i")).select("i", "n").orderBy(F.desc("i")).limit(MOST_ENTRIES + 1).collect()
    )
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    spark = values.sparkSession
    held, name = spark.sparkContext.broadcast([(r.i, r.n) for r in rows]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                if name not in _HELD:
                    _HELD.clear()
                    _HELD[name] = NameIndex(held.value)
                index = _HELD[name]
                texts = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.find(t) for t in texts], pa.int64())], ["value", "taxon_id"])

    distinct = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return spread(distinct, "value").mapInArrow(run, "value string, taxon_id bigint")


def free_entered(rows: DataFrame, column: str, reference: DataFrame, name_column: str = "canonical_name", reserved: tuple[str, ...] = ("internal",)) -> DataFrame:
    """Rows whose value is not null, not reserved and not exactly a canonical name."""
    rows = rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*reserved))
    names = reference.where(F.col(name_column).isNotNull()).select(F.col(name_column).alias("__name")).distinct()
    return rows.join(names, F.col(column) == F.col("__name"), "left_anti")
