"""References to records that do not exist, are retired, or were not loaded yet.

The referring table is first reduced to its distinct ``(scope, key, time)``
triples, so a key that holds a third of all rows is tested once per moment.
They are anti-joined against the distinct validity intervals of the parents,
and the orphan triples are joined back to their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``table.key`` refers to ``parent_table.parent_key`` within the same ``scope``."""

    table: str
    row_id: str
    key: str
    parent_table: str
    parent_key: str
    scope: str = "study_id"
    loaded: str = "loaded_at"
    retired: str = "retired_at"


REFERENCES = (
    Reference("trait", "row_id", "species", "taxon_groups", "species"),
    Reference("folds", "row_id", "genus", "taxon_groups", "genus"),
    Reference("branches", "row_id", "branch", "coordinates", "branch_id"),
    Reference("state_ledger", "cell_id", "coordinate_id", "branches", "branch"),
)


def _referring(rows: DataFrame, ref: Reference, *extra: str) -> DataFrame:
    return rows.where(F.col(ref.key).isNotNull()).select(
        *extra, F.col(ref.scope).alias("scope"), F.col(ref.key).alias("key"), F.col(ref.loaded).alias("at")
    )


def orphan_keys(rows: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """Distinct ``(scope, key, at)`` of ``rows`` with no parent in force.

    Intervals of one key that begin at the same moment are merged to the one
    that ends last.  A parent without ``loaded_at`` is never in force; a row
    without ``loaded_at`` finds none in force; a null scope equals only a null.
    """
    asked = _referring(rows, ref).distinct()
    end = F.max(F.coalesce(F.col(ref.retired), F.lit("9999-12-31 23:59:59").cast("timestamp")))
    held = (
        parents.where(F.col(ref.parent_key).isNotNull() & F.col(ref.loaded).isNotNull())
        .groupBy(F.col(ref.scope).alias("p_scope"), F.col(ref.parent_key).alias("p_key"), F.col(ref.loaded).alias("p_from"))
        .agg(end.alias("p_to"))
    )
    on = (
        F.col("scope").eqNullSafe(F.col("p_scope")) & (F.col("key") == F.col("p_key"))
        & (F.col("p_from") <= F.col("at")) & (F.col("p_to") > F.col("at"))
    )
    return asked.join(held, on, "left_anti")


def orphan_rows(rows: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """``(table_name, row_id, scope, key, at)`` of every referring row whose reference is an orphan."""
    lost = orphan_keys(rows, parents, ref).select(F.col("scope").alias("o_scope"), F.col("key").alias("o_key"), F.col("at").alias("o_at"))
    told = _referring(rows, ref, F.col(ref.row_id).cast("bigint").alias("row_id"))
    on = F.col("scope").eqNullSafe(F.col("o_scope")) & (F.col("key") == F.col("o_key")) & F.col("at").eqNullSafe(F.col("o_at"))
    return told.join(lost, on, "left_semi").select(F.lit(ref.table).alias("table_name"), "row_id", "scope", "key", "at")


def orphan_counts(rows: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """Per referring table and month of ``loaded_at``: rows with a key, orphans, distinct orphan keys.

    Rows are counted per distinct triple first, so the join back moves counts
    and not rows.  A null ``loaded_at`` has the null month.
    """
    triples = _referring(rows, ref).groupBy("scope", "key", "at").agg(F.count(F.lit(1)).alias("n"))
    lost = orphan_keys(rows, parents, ref).select(
        F.col("scope").alias("o_scope"), F.col("key").alias("o_key"), F.col("at").alias("o_at"), F.lit(True).alias("lost")
    )
    on = F.col("scope").eqNullSafe(F.col("o_scope")) & (F.col("key") == F.col("o_key")) & F.col("at").eqNullSafe(F.col("o_at"))
    lost_n = F.when(F.col("lost"), F.col("n")).otherwise(0)
    per_key = (
        triples.join(lost, on, "left").withColumn("period", F.date_format("at", "yyyy-MM"))
        .groupBy("period", "scope", "key").agg(F.sum("n").alias("n"), F.sum(lost_n).alias("lost_n"))
    )
    return per_key.groupBy("period").agg(
        F.sum("n").alias("rows_with_key"), F.sum("lost_n").alias("orphan_rows"),
        F.sum(F.when(F.col("lost_n") > 0, 1).otherwise(0)).cast("bigint").alias("orphan_keys"),
    ).select(F.lit(ref.table).alias("table_name"), "period", "rows_with_key", "orphan_rows", "orphan_keys")
