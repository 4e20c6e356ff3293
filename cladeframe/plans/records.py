"""Queries of raw lines (problem 3) and references (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import delimited, orphans
from cladeframe.plans.registry import Registry
from cladeframe.sources.tables import table

R = Registry()

_FIELD = r"""([^"\t]*|"([^"]|"")*")"""
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def _sql_lines(name: str, n: int, check: str) -> str:
    """Common SQL of problem 3: every data line of ``name`` with its reason."""
    fields = r"\t".join([f"({_FIELD[1:-1]})"] * n)
    groups = [1 + 2 * i for i in range(n)]

    def value(i: int) -> str:
        g = f"regexp_extract(line, '^{fields}$', {groups[i]}, 's')"
        return f"CASE WHEN {g} LIKE '\"%' THEN replace(substring({g}, 2, greatest(length({g}) - 2, 0)), '\"\"', '\"') ELSE {g} END"

    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
    blank = " OR ".join(f"{trim(f'f{i}')} = ''" for i in range(n - 1))
    return f"""
      SELECT '{name}' AS table_name, line_id, file_name, line_no, received_at, {", ".join(f"f{i}" for i in range(n))}, last_text,
        CASE WHEN NOT quoted_ok THEN 'broken quoting' WHEN NOT counted_ok THEN 'wrong column count'
             WHEN ({blank}) OR NOT coalesce({check}, false) THEN 'invalid value' END AS reason
      FROM (SELECT *, {trim(f"f{n - 1}")} AS last_text FROM (
        SELECT *, regexp_full_match(line, '{_FIELD}(\\t{_FIELD})*', 's') AS quoted_ok,
          regexp_full_match(line, '{fields}', 's') AS counted_ok, {", ".join(f"{value(i)} AS f{i}" for i in range(n))}
        FROM (SELECT *, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line
              FROM {name} WHERE line_no <> 1)))"""


_NUMBER = r"regexp_full_match(last_text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
_HALVES = f"{_NUMBER} AND try_cast(last_text AS DOUBLE) IN (0, 0.5, 1)"
_SEEDS = f"{_NUMBER} AND abs(try_cast(last_text AS DOUBLE)) <= 2147483647 AND try_cast(last_text AS DOUBLE) = floor(try_cast(last_text AS DOUBLE))"
_TRAIT_SQL, _FOLD_SQL = _sql_lines("trait_lines", 2, _HALVES), _sql_lines("fold_lines", 3, _SEEDS)


def _parsed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    fields = delimited.TRAIT if name == "trait_lines" else delimited.FOLDS
    return delimited.parse_lines(delimited.data_lines(table(spark, folder, name)), fields)


@R.add("p3_found", f"SELECT table_name, line_id FROM ({_TRAIT_SQL}) WHERE reason IS NOT NULL UNION ALL SELECT table_name, line_id FROM ({_FOLD_SQL}) WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that fail, of both raw tables."""
    bad = [
        delimited.rejects(_parsed(spark, folder, n)).select(F.lit(n).alias("table_name"), "line_id")
        for n in ("trait_lines", "fold_lines")
    ]
    return bad[0].unionByName(bad[1])


@R.add("p3_rejects", f"SELECT table_name, line_id, reason FROM ({_TRAIT_SQL}) WHERE reason IS NOT NULL UNION ALL SELECT table_name, line_id, reason FROM ({_FOLD_SQL}) WHERE reason IS NOT NULL")
def p3_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that fail, with the reason."""
    bad = [
        delimited.rejects(_parsed(spark, folder, n)).select(F.lit(n).alias("table_name"), "line_id", "reason")
        for n in ("trait_lines", "fold_lines")
    ]
    return bad[0].unionByName(bad[1])


@R.add("p3_trait_rows", f"SELECT line_id, f0 AS species, try_cast(last_text AS DOUBLE) + 0.0 AS binary_trait FROM ({_TRAIT_SQL}) WHERE reason IS NULL")
def p3_trait_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Typed trait rows of the valid lines."""
    return delimited.valid_rows(_parsed(spark, folder, "trait_lines")).select("line_id", "species", "binary_trait")


@R.add("p3_fold_rows", f"SELECT line_id, f0 AS fold_id, f1 AS genus, CAST(try_cast(last_text AS DOUBLE) AS INT) AS seed FROM ({_FOLD_SQL}) WHERE reason IS NULL")
def p3_fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Typed folds rows of the valid lines."""
    return delimited.valid_rows(_parsed(spark, folder, "fold_lines")).select("line_id", "fold_id", "genus", "seed")


def _sql_orphans(ref: orphans.Reference) -> str:
    return f"""
      SELECT '{ref.table}' AS table_name, CAST(r.{ref.row_id} AS BIGINT) AS row_id, r.{ref.scope} AS scope, r.{ref.key} AS key, r.{ref.loaded} AS seen_at,
        NOT EXISTS (SELECT 1 FROM {ref.parent_table} p WHERE p.{ref.scope} = r.{ref.scope} AND p.{ref.parent_key} = r.{ref.key}
          AND p.{ref.loaded} <= r.{ref.loaded} AND (p.{ref.retired} IS NULL OR p.{ref.retired} > r.{ref.loaded})) AS lost
      FROM {ref.table} r WHERE r.{ref.key} IS NOT NULL"""


_ALL_REFS = " UNION ALL ".join(f"({_sql_orphans(r)})" for r in orphans.REFERENCES)


@R.add("p4_found", f"SELECT table_name, row_id FROM ({_ALL_REFS}) WHERE lost")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all referring tables whose reference is not in force."""
    parts = [
        orphans.orphan_rows(table(spark, folder, r.table), table(spark, folder, r.parent_table), r).select("table_name", "row_id")
        for r in orphans.REFERENCES
    ]
    return reduce(DataFrame.unionByName, parts)


@R.add("p4_orphans_by_period", f"""
  SELECT table_name, strftime(timezone('UTC', seen_at), '%Y-%m') AS period, count(*) AS rows_with_key, CAST(sum(lost::INT) AS BIGINT) AS orphan_rows,
    count(DISTINCT CASE WHEN lost THEN (scope, key) END) AS orphan_keys FROM ({_ALL_REFS}) GROUP BY 1, 2""")
def p4_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans counted per referring table and month."""
    parts = [
        orphans.orphan_counts(table(spark, folder, r.table), table(spark, folder, r.parent_table), r) for r in orphans.REFERENCES
    ]
    return reduce(DataFrame.unionByName, parts)
