"""Traits, groups, folds and branch states as keyed tables, and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import DomainError
from cladeframe.operators.cells import newest
from cladeframe.workspace import unbroadcast

STATES = (0.0, 0.5, 1.0)


def in_force(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key that is not retired; rows with a null key are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return newest(rows.where(F.col("retired_at").isNull()), keys, ["loaded_at", "row_id"])


def trait_values(trait: DataFrame) -> DataFrame:
    """``(study_id, species, value)``: the newest row of a species; null where its value is not 0, 0.5 or 1."""
    last = newest(trait.where(F.col("species").isNotNull() & F.col("study_id").isNotNull()), ["study_id", "species"], ["loaded_at", "row_id"])
    return last.select("study_id", "species", F.when(F.col("binary_trait").isin(*STATES), F.col("binary_trait")).alias("value"))


def trait_issues(trait: DataFrame) -> DataFrame:
    """Per study: rows outside 0 / 0.5 / 1, repeated species, and whether both classes occur."""
    v = F.col("binary_trait")
    n = trait.groupBy("study_id").agg(
        F.count_if(v.isNull() | F.isnan(v) | ~v.isin(*STATES)).cast("bigint").alias("outside_vocabulary"),
        (F.count("species") - F.count_distinct("species")).cast("bigint").alias("repeated_species"),
        F.count_if(v == 0).cast("bigint").alias("n_reference"), F.count_if(v == 1).cast("bigint").alias("n_focal"),
    )
    return n.withColumn("both_classes", (F.col("n_reference") > 0) & (F.col("n_focal") > 0))


def group_issues(groups: DataFrame) -> DataFrame:
    """Species of a study that are declared more than once, or under several genera, among rows in force."""
    rows = groups.where(F.col("retired_at").isNull() & F.col("species").isNotNull())
    n = rows.groupBy("study_id", "species").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("genus").alias("n_genera"))
    return n.where("n_rows > 1")


def ordered_folds(folds: DataFrame) -> DataFrame:
    """``(study_id, fold_ord, fold_id, genus, seed)``: one row per genus (its newest), in the order of fold, genus."""
    from pyspark.sql import Window as W

    last = newest(folds.where(F.col("genus").isNotNull() & F.col("fold_id").isNotNull()), ["study_id", "genus"], ["loaded_at", "row_id"])
    order = F.row_number().over(W.partitionBy("study_id").orderBy("fold_id", "genus"))
    return last.select("study_id", order.alias("fold_ord"), "fold_id", "genus", "seed")


def fold_issues(folds: DataFrame) -> DataFrame:
    """Per study: fold ids shared by several genera, genera in several folds, rows without a seed or key."""
    a = folds.where("fold_id IS NOT NULL AND genus IS NOT NULL").groupBy("study_id", "fold_id").agg(F.count_distinct("genus").alias("n")).where("n > 1")
    b = folds.where("fold_id IS NOT NULL AND genus IS NOT NULL").groupBy("study_id", "genus").agg(F.count_distinct("fold_id").alias("n")).where("n > 1")
    c = folds.groupBy("study_id").agg(F.count_if(F.col("seed").isNull() | F.col("fold_id").isNull() | F.col("genus").isNull()).alias("n_incomplete"))
    a = a.groupBy("study_id").agg(F.count(F.lit(1)).alias("shared_folds"))
    b = b.groupBy("study_id").agg(F.count(F.lit(1)).alias("split_genera"))
    every = c.join(a, "study_id", "left").join(b, "study_id", "left")
    return every.select("study_id", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x) for x in ("shared_folds", "split_genera", "n_incomplete")])


def terminals(coordinates: DataFrame) -> DataFrame:
    """``(study_id, branch_id, species)`` of terminal branches in force; a missing taxon leaves the branch out."""
    last = in_force(coordinates, ["study_id", "branch_id"])
    return last.where((F.col("branch_type") == "terminal") & F.col("terminal_taxon").isNotNull()).select("study_id", "branch_id", F.col("terminal_taxon").alias("species"))


def terminal_states(coordinates: DataFrame, trait: DataFrame, groups: DataFrame) -> DataFrame:
    """``(study_id, branch_id, species, genus, state)`` of terminal branches whose species has a trait value; genus may be null."""
    genus = in_force(groups, ["study_id", "species"]).select("study_id", "species", "genus")
    rows = terminals(coordinates).join(unbroadcast(trait_values(trait)), ["study_id", "species"]).join(unbroadcast(genus), ["study_id", "species"], "left")
    return rows.where(F.col("value").isNotNull()).select("study_id", "branch_id", "species", "genus", F.col("value").alias("state"))


def branch_states(cells: DataFrame, states: DataFrame) -> DataFrame:
    """Every branch of the matrices with ``state``, ``availability`` and ``reason``: intermediate states are unresolved, others without a trait unavailable."""
    branches = cells.select("study_id", "branch_id").distinct().join(states.select("study_id", "branch_id", "state"), ["study_id", "branch_id"], "left")
    s = F.col("state")
    return branches.withColumn("availability", F.when(s.isin(0.0, 1.0), "available").when(s == 0.5, "unresolved").otherwise("unavailable")).withColumn(
        "reason", F.when(s == 0.5, "intermediate_excluded").when(s.isNull(), "no_trait")
    )


def key_agreement(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str) -> DataFrame:
    """Keys on one side only: ``(keys, side)``; no row says that both sides hold the same keys."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_a = a.join(b, keys, "left_anti").withColumn("side", F.lit(left_name))
    return only_a.unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit(right_name)))


def level_key(value: Column, numeric: bool) -> Column:
    """A typed key of a level: numbers compare by value, texts exactly, and the two never meet."""
    return F.concat(F.lit("numeric:"), (value.cast("double") + F.lit(0.0)).cast("string")) if numeric else F.concat(F.lit("character:"), value)


def require_agreement(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str) -> None:
    """``DomainError`` with up to five keys if the sides differ."""
    some = key_agreement(left, right, keys, left_name, right_name).limit(5).collect()
    if some:
        raise DomainError("; ".join(f"only in {r.side}: {', '.join(str(r[k]) for k in keys)}" for r in some))
