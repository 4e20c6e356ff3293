"""Operators of the subpackage against brute force, exact results and edge cases."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import components, leaks, mixing, names, percentiles, spam
from cladeframe.llm.tokens import TokenCounter
from cladeframe.llm.words import words_of
from cladeframe.workspace import Workspace

GROUPS = "row_id long, study_id string, species string, genus string"
FOLDS = "row_id long, study_id string, fold_id string, genus string"


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    return {x: root(x) for x in list(up)}


def test_contraction_equals_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)] + [("hub", f"h{i}") for i in range(40)] + [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("v1", None), ("x", "x")]
    got = {r.vertex: r.component for r in components.contract(spark.createDataFrame(pairs, "a string, b string"), Workspace(spark, "t")).collect()}
    want = union_find([(a, b) for a, b in pairs if a and b and a != b])
    assert set(got) == set(want)
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in want for b in want if want[a] == want[b]}


def test_splits_keep_links_together(spark):
    rng = random.Random(1)
    rows = [(i, f"s{rng.randrange(2)}", rng.choice([None, f"sp{rng.randrange(300)}"]), rng.choice([None, *[f"g{rng.randrange(150)}"] * 9])) for i in range(600)]
    folds = [(i, f"s{rng.randrange(2)}", rng.choice([None, f"f{rng.randrange(120)}"]), rng.choice([None, f"g{rng.randrange(150)}"])) for i in range(80)]
    g, f = spark.createDataFrame(rows + rows[:20], GROUPS), spark.createDataFrame(folds, FOLDS)
    out = components.split_rows(g, f, Workspace(spark, "t")).collect()
    assert len(out) == 620 + 80
    split = {(r.table_name, r.row_id): r.split for r in out}
    links = {}
    for name, table in (("taxon_groups", rows), ("folds", folds)):
        for i, study, link, genus in table:
            for key in [("l", name, study, link)] * (link is not None) + [("g", study, genus)] * (genus is not None):
                links.setdefault(key, set()).add(split[name, i])
    assert all(len(v) == 1 for v in links.values())
    empty = components.genus_components(g.limit(0), f.limit(0), Workspace(spark, "t"))
    assert empty.count() == 0
    pairs = components.same_split_pairs(components.genus_components(g, f, Workspace(spark, "t"))).collect()
    assert all(r.genus_a < r.genus_b for r in pairs)


def test_split_shares(spark):
    members = spark.createDataFrame([("s", f"c{i}") for i in range(3000)] + [("s", "big")] * 300, "study_id string, component string")
    placed = components.assign_splits(members, F.lit(1))
    got = {r.split: r.n for r in placed.groupBy("split").agg(F.sum("weight").alias("n")).collect()}
    assert sum(got.values()) == 3300 and abs(got["train"] / 3300 - 0.8) < 0.01 and abs(got["test"] / 3300 - 0.1) < 0.01


def _values(spark, rows):
    return spark.createDataFrame(rows, "gene_id string, coordinate_id string, day int, value double")


def _quantile(x, p):
    x, h = np.sort(x), (len(x) - 1) * p
    a = int(np.floor(h))
    return x[a] + (h - a) * (x[min(a + 1, len(x) - 1)] - x[a])


def test_percentiles_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.choice(["g1", "g1", "g2"]).item(), rng.choice(["b1", "b2"]).item(), int(rng.integers(5)), float(x)) for x in np.concatenate([np.zeros(300), rng.lognormal(0, 6, 900), np.full(200, 7.5)])]
    rows += [(None, "b1", 1, 2.0), ("g3", None, 1, -5.0)]
    want = {}
    for g, b, _, v in rows:
        for key in (("gene", g, None), ("coordinate", None, b), ("pair", g, b)):
            want.setdefault(key, []).append(v)
    for direct, chunk in ((10**6, 10**6), (20, 100)):
        out = percentiles.percentiles(percentiles.summarise(_values(spark, rows), chunk=chunk), Workspace(spark, "t"), direct=direct).collect()
        assert len(out) == len(want)
        for r in out:
            x = want[r.grouping, r.gene_id, r.coordinate_id]
            assert r.n == len(x) and r.rank_error == 0
            assert [r[n] for n in percentiles.NAMES] == [_quantile(x, p) for p in percentiles.PROBABILITIES]


def test_percentiles_bounded(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    out = percentiles.percentiles(percentiles.summarise(_values(spark, [("g", "b", i % 3, float(v)) for i, v in enumerate(x)]), points=64), Workspace(spark, "t"), cap=64, direct=50).where("grouping = 'gene'").first()
    assert 0 < out.rank_error < 0.05 * 4000
    for n, p in zip(percentiles.NAMES, percentiles.PROBABILITIES):
        assert abs((x < out[n]).sum() - p * 3999) <= out.rank_error + 1


def test_percentiles_filter_and_empty(spark):
    t = dt.date(2024, 1, 1)
    rows = [("g", "b", t, True, 1.0), ("g", "b", None, True, 3.0), ("g", "b", t, True, float("nan")), ("g", "b", t, True, float("inf")), ("g", "b", t, False, 9.0), ("g", "b", t, None, 9.0), ("g", "b", t, True, None)]
    ledger = spark.createDataFrame(rows, "gene_id string, coordinate_id string, run_day date, numeric_available boolean, numeric_value double")
    out = percentiles.percentiles(percentiles.summarise(percentiles.finite_values(ledger)), Workspace(spark, "t")).collect()
    assert {(r.grouping, r.n, r.p50) for r in out} == {(g, 2, 2.0) for g in ("gene", "coordinate", "pair")}
    days = percentiles.day_summaries(percentiles.summarise(percentiles.finite_values(ledger))).collect()
    assert {(r.run_day, r.n) for r in days} == {(t, 1), (None, 1)}
    assert percentiles.percentiles(percentiles.summarise(percentiles.finite_values(ledger.limit(0))), Workspace(spark, "t")).count() == 0


REFERENCE = [(1, "Zadops_styraelna"), (2, "Zadops_cepaenthae"), (3, "Brulomys_miomdrumii"), (4, "Brulomys_zesfixii"), (5, "Vylzuma_styraelna")]
MEANT = {
    "zadops styraelna": 1, "Zadops-styraelna": 1, "Zadops&nbsp;styraelna": 1, "Zadops%20styraelna": 1, "styraelna, Zadops": 1, "Zadops​_styraelna": 1, "Zаdops_styraelna": 1, "Zadops styraëlna": 1,
    "Zadops cf. styraelna (Author, 1804)": 1, "Zadops_styraelna_voucher12": 1, "Zadpos_styraelna": 1, "Zadops stryaelna Author": 1, "Z. styraelna": 1, "ZADOPS STYRAELNA": 1, "Zadopsstyraelna": 1, "B. zesfixii": 4, "Vyl. styraelna": 5,
    "Zadops": -1, "Zadops sp.": -1, "styraelna": -1, "Zadops_unlisted": -1, "???": -1, "": -1, "x" * 100_000: -1, "Q. styraelna": -1, "Brulomys miomdrumii var. alba": 3,
    "Zadops (coll. Author) styraelna": 1, "styraelno voucher 12 of Zadopz": 1, "Zadopsstyraelno": 1, "Zadops unlisted with many words of no name": -1, "y" * 61 + " Zadpos styraelna": 1, "": -1,
}


def test_names(spark):
    index = names.NameIndex(REFERENCE)
    assert {v: index.find(v) for v in MEANT} == MEANT
    ref = spark.createDataFrame([*REFERENCE, (9, None), (None, "A_b")], "taxon_id long, canonical_name string")
    rows = spark.createDataFrame([(v,) for v in [*MEANT, "internal", "Zadops_styraelna", None, "Z. styraelna"]], "species string")
    free = names.free_entered(rows, "species", ref)
    assert free.count() == len(MEANT) + 1
    assert {r.value: r.taxon_id for r in names.map_names(free, "species", ref).collect()} == MEANT
    assert {r.taxon_id for r in names.map_names(free, "species", ref.limit(0)).collect()} == {-1}
    many = spark.range(2000).selectExpr("concat('Zadops styraelna ', id) AS species")
    mapped = names.map_names(many, "species", ref)
    assert mapped.groupBy("taxon_id").count().collect()[0][:] == (1, 2000) and mapped.select(F.spark_partition_id()).distinct().count() > 1


def _passage(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(7)
    items = [(i, _passage(rng, 40)) for i in range(30)]
    docs, exact, near = [], set(), set()
    for d in range(120):
        words, (i, passage) = _passage(rng, rng.randrange(200)), items[d % 30]
        kind = d % 4
        if kind == 0:
            words[10:10] = [w.upper() for w in passage[5:25]]
            exact.add((d, i))
        elif kind == 1:
            piece = passage[3:28]
            piece[12] = "changed"
            words += piece
            near.add((d, i))
        elif kind == 2:
            words += passage[:19]  # one word too few
        docs.append((d, " ,\n".join(words)))
    docs += [(900, ""), (901, None), (902, "one " * 100_000)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(p)) for i, p in items] + [(99, "short item"), (98, None)], "item_id long, item_text string")
    out = {(r.doc_id, r.item_id): r.edits for r in leaks.find_leaks(d, t).collect()}
    assert {k for k, v in out.items() if v == 0} == exact
    assert len(near & set(out)) >= 0.95 * len(near)
    small = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, t, leaks.LeakSpec(block=500)).where("edits = 0").collect()}
    assert small == exact
    assert leaks.find_leaks(d, t.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), t).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(0)
    index = leaks.WindowIndex([(1, " ".join(f"a{i}" for i in range(30)))], leaks.LeakSpec(width=8, edits=2))
    a, b = rng.integers(0, 3, (400, 10)), rng.integers(0, 3, (400, 8))

    def plain(x, y):
        """Of ``y`` against every start of ``x``, the least."""
        row = list(range(len(x) + 1))
        for i, p in enumerate(y, 1):
            new = [i]
            for j, q in enumerate(x, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return min(*row, 3)

    assert index.distance(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]


EDITS = {"replace": (1, 0, 0), "two replaced": (2, 0, 0), "left out": (0, 1, 0), "two left out": (0, 2, 0), "inserted": (0, 0, 1), "two inserted": (0, 0, 2), "left out and inserted": (0, 1, 1), "replaced and left out": (1, 1, 0)}


@pytest.mark.parametrize("kind", EDITS)
def test_recall_of_edited_passages(kind):
    """Items of exactly one window, edited in the middle of other words and at the end of a text: at least nine in ten are found, none falsely."""
    rng, n = random.Random(13), 400
    items = [(i, _passage(rng, 20)) for i in range(n)]
    texts = []
    for i, p in items:
        p = list(p)
        replaced, left_out, inserted = EDITS[kind]
        for _ in range(left_out):
            p.pop(rng.randrange(len(p)))
        for at in rng.sample(range(len(p)), replaced):
            p[at] = "changed"
        for _ in range(inserted):
            p.insert(rng.randrange(1, len(p)), "added")
        texts.append(" ".join(_passage(rng, rng.randrange(30)) + p + _passage(rng, rng.choice([0, 0, 25]))))
    index = leaks.WindowIndex([(i, " ".join(p)) for i, p in items], leaks.LeakSpec())
    doc, item, edits = index.hits(texts)
    assert (doc == item).all() and (edits <= sum(EDITS[kind])).all()
    assert len(set(doc.tolist())) >= 0.9 * n, len(set(doc.tolist())) / n


def test_words():
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ9_ é中😀𝒳-İß\n.") for _ in range(rng.randrange(40))) for _ in range(300)] + [""]
    c = words_of(texts)
    want = [[w for w in re.findall(r"[^\W_]+", t)] for t in texts]
    got = [[] for _ in texts]
    for s, e, i in zip(c.start, c.end, c.of):
        got[i].append(c.text[s:e])
    assert got == want
    same = words_of(["Straße ABC abc"])
    assert same.hash[1] == same.hash[2]


def test_token_counts_are_exact():
    counter = TokenCounter()
    rng = random.Random(0)
    texts = ["".join(rng.choice("aB'sstrevmld1² \n\t é中😀.,𝒳\x1c") for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "don't we'll I'm 'sample ''s  's"]
    assert counter.count(texts).tolist() == [len(counter.encoding.encode_ordinary(t)) for t in texts]


def test_sainte_lague():
    def plain(w, seats, most):
        got = [0] * len(w)
        for _ in range(seats):
            open_ = [i for i in range(len(w)) if got[i] < most[i] and w[i] > 0]
            if not open_:
                break
            got[max(open_, key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        return got

    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 8))]
        seats, most = rng.randrange(0, 40), [rng.randrange(0, 20) for _ in w]
        assert mixing.sainte_lague(w, seats, most) == plain(w, min(seats, sum(m for m, x in zip(most, w) if x)), most)
    assert sum(mixing.sainte_lague([1, 2, 3], 10**9)) == 10**9


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "z", None]), "word " * rng.randrange(1, 60)) for i in range(900)] + [(9001, "a", ""), (9002, "b", None)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 4), ("c", 0.2, 2), ("none", 0.0, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    counts = Workspace(spark, "t").save(mixing.token_counts(d, targets), "c")
    used, quotas = mixing.mix(counts, targets, Workspace(spark, "t"))
    limit = {"a": 1, "b": 4, "c": 2}
    rows = used.collect()
    assert all(1 <= r.uses <= limit[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(used, quotas, targets).collect()}
    assert all(abs(got[s].reached_share - w) < 0.01 for s, w in (("a", 0.3), ("b", 0.5), ("c", 0.2))) and got["absent"].used_tokens == 0
    again, _ = mixing.mix(counts, targets, Workspace(spark, "t"))
    assert sorted(again.collect()) == sorted(rows)
    # Many shards in many bunches: the quotas of a source still add up, and the shares hold.
    used, quotas = mixing.mix(counts, targets, Workspace(spark, "t"), mixing.MixSpec(shard=300, bunch=4, block=20))
    many = {r.source: r for r in mixing.shares(used, quotas, targets).collect()}
    assert all(abs(many[s].reached_share - w) < 0.02 for s, w in (("a", 0.3), ("b", 0.5), ("c", 0.2)))
    assert all(1 <= r.uses <= limit[r.source] for r in used.collect())
    none, _ = mixing.mix(counts.limit(0), targets, Workspace(spark, "t"))
    assert none.count() == 0


def test_spam(spark):
    rng = random.Random(8)
    nouns, ends = [f"noun{chr(97 + i)}x" for i in range(20)], ["because the index is not unique", "although the gauge failed twice", "before the model is fitted well"]
    plain = lambda: ". ".join(f"We export the {rng.choice(nouns)} with the {rng.choice(nouns)} and look at it again {rng.choice(ends)}" for _ in range(6))
    stuff = lambda: "\n".join(", ".join(rng.choice(["cheap", "deal", "best", "online", "free"]) for _ in range(12)) for _ in range(8))
    links = lambda: "\n".join(f"* [deal](http://a{rng.randrange(99)}.example/x/{rng.randrange(999)})" for _ in range(12))
    code = "\n".join("frame = pd.read_csv('table.csv')\nframe.head(11)\nax.plot(frame['a'], frame['b'], lw=0.5)" for _ in range(6))
    docs = [(i, plain()) for i in range(80)] + [(100 + i, stuff()) for i in range(8)] + [(200 + i, links()) for i in range(4)] + [(300 + i, code) for i in range(30)]
    docs += [(400, plain() + "\n" + "\n".join(stuff().split("\n")[:2])), (401, ""), (402, None), (403, "..."), (404, "http://a.example/b")]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(docs, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == {*range(100, 108), *range(200, 204), 404}
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "t")).count() == 0


def test_spam_lists_without_sentences(spark):
    """A keyword a line, lists of words that do not recur, addresses without http, tags with digits; and what looks alike but is code or output."""
    rng = random.Random(3)
    words = [a + b for a in ("ke", "so", "dri", "wal", "lam", "per") for b in ("ttle", "fa", "ll", "let", "pa", "fume")]
    plain = lambda: "\n".join(f"We export the {rng.choice(words)} with the {rng.choice(words)} before the model is fitted and look at it again." for _ in range(6))
    docs = [(i, plain()) for i in range(60)]
    spam_docs = {
        100: "\n".join(rng.choice(words[:8]) for _ in range(200)), 101: "\n".join(", ".join(rng.sample(words, 12)) for _ in range(10)),
        102: "\n".join(f"shop{rng.randrange(9)}.example/deal/{i}" for i in range(60)), 103: "\n".join(" ".join(f"#{rng.choice(words)}{rng.randrange(99)}" for _ in range(8)) for _ in range(12)),
        104: "\n".join(f"[{rng.choice(words)}](http://a{i}.example/x)" for i in range(20)), 105: ", ".join(f"#{w}_sale" for w in words),
    }
    other = {
        200: "\n".join(f"colors = ['#ff00{i:02d}', '#00ff{i:02d}', '#0000{i:02d}']" for i in range(20)), 201: "stop = {" + ", ".join(f"'{w}'" for w in words) + "}", 202: "\n".join(f"frame.{w}.test()" for w in words),
        203: "\n".join(f"import {w}\n{w}.show()" for w in words), 204: "\n".join(f"{w}  {i}  {i / 7:.3f}" for i, w in enumerate(words)), 205: "# Title\n\n" + plain() + "\n#todo #later",
    }
    every = spark.createDataFrame(docs + [*spam_docs.items(), *other.items()], "doc_id long, text string")
    assert {r.doc_id for r in spam.spam_pages(every, Workspace(spark, "t")).collect()} == set(spam_docs)


@pytest.mark.parametrize("times", [1, 10, 100])
def test_spam_does_not_depend_on_the_size_of_the_corpus(spark, times):
    words = ["kettle", "sofa", "drill", "wallet"]
    phrases = lambda x: "\n".join([f"Looking for {x}? {x} here, {x} today, {x} near you and more {x}", f"{x} is the best {x} because {x} means {x}"] * 3)
    plain = [f"We export the {a} with the {b} before the model is fitted well and look at the {a} again because the {b} failed" for a in words for b in words]
    docs = [(i, phrases(words[i % 4])) for i in range(40)] + [(100 + i, "\n".join([text] * 3)) for i, text in enumerate(plain)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    # The same documents so many times over: every count is multiplied.
    every = docs.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).selectExpr("doc_id + 1000 * copy AS doc_id", "text")
    got = {r.doc_id for r in spam.spam_pages(every, Workspace(spark, "t")).select("doc_id").collect()}
    assert got == {i + 1000 * k for i in range(40) for k in range(times)}


def test_spam_by_mean_pmi(spark):
    """The mean PMI of a passage against counts by hand; lists in alphabetical order, whose words never stand the other way round,
    and a page of one collocation, but not a sentence that is there five times."""
    rng = random.Random(5)
    words = [a + b for a in ("ke", "so", "dri", "wal", "lam", "per") for b in ("ttle", "fa", "ll", "let", "pa", "fume")]
    plain = lambda: "\n".join(f"We export the {rng.choice(words)} with the {rng.choice(words)} before the model is fitted and look at it again." for _ in range(6))
    lists = lambda: "\n".join(" ".join(sorted(rng.sample(words, 12))) for _ in range(10))
    texts = {i: plain() for i in range(200)} | {200: "\n".join([plain().split("\n")[0]] * 5)} | {1000 + i: lists() for i in range(20)}
    texts[2000] = "\n".join(["gift offer bargain " * 5] * 10)  # words that stand together only, many times in a line
    work = Workspace(spark, "t")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    lines = spam.judged_lines(spam.scan(docs, spam.SpamSpec(), work), spam.SpamSpec(), work).where("doc_id between 1000 and 1999").collect()

    split = [[line.lower().rstrip(".").split() for line in text.split("\n")] for text in texts.values()]
    single = Counter(w for text in split for line in text for w in line)
    double = Counter(xy for text in split for line in text for xy in zip(line, line[1:]))
    n = sum(single.values())

    def pmi(x, y):
        both, least = double[x, y], min(single[x], single[y])
        return math.log(both * n / (single[x] * single[y])) / -math.log(both / n) * both / (both + 1) * least / (least + 1)

    want = [sum(map(pmi, line, line[1:])) / 11 for text in split[201:221] for line in text]
    got = [r.mean_pmi for r in sorted(lines, key=lambda r: (r.doc_id, r.line))]
    assert got == pytest.approx(want, rel=1e-9)
    assert {r.doc_id for r in spam.spam_pages(docs, work).collect()} == {i for i in texts if i >= 1000}


@pytest.mark.parametrize("name", ["p1_found", "p2_percentiles", "p5_found", "p6_found", "p7_records", "p8_found"])
def test_registered(name):
    from cladeframe.llm import catalog

    assert name in catalog.queries()
