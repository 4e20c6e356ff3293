"""Model variants: one trait coded in several ways, with groups of species left out or alone kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fourteen variants: axis, and which of the focal genera (in bytewise order) are left out or alone kept; 0 is none.
VARIANTS = tuple(
    [("declared", "baseline", 0)] + [("declared", "drop", k) for k in range(1, 5)] + [("declared", "only", k) for k in range(1, 3)]
    + [("wide", "baseline", 0)] + [("wide", "drop", k) for k in range(1, 7)]
)


def name(axis: str, rule: str, place: int) -> str:
    return f"{axis}_{rule}" + (f"_{place}" if place else "")


def model_variants(terminals: DataFrame) -> DataFrame:
    """``(study_id, model, trait_axis, drop_rule, branch_id, species, genus, state)`` of all variants in one table.

    The axis ``declared`` takes the trait as it is; ``wide`` counts intermediate states as focal.  ``drop`` makes the focal
    species of the k-th focal genus intermediate, that is excluded; ``only`` those of all other genera.  A study with fewer
    focal genera has the same states as its baseline.  A focal species without a genus is never left out alone.
    """
    focal = terminals.where("state = 1 AND genus IS NOT NULL").select("study_id", "genus").distinct()
    focal = focal.withColumn("place", F.row_number().over(W.partitionBy("study_id").orderBy("genus")))
    count = focal.groupBy("study_id").agg(F.max("place").alias("n_focal"))
    rows = terminals.join(focal, ["study_id", "genus"], "left").join(count, "study_id", "left")
    each = F.array(*[F.struct(F.lit(name(*v)).alias("model"), F.lit(v[0]).alias("trait_axis"), F.lit(v[1]).alias("drop_rule"), F.lit(v[2]).alias("k")) for v in VARIANTS])
    rows = rows.withColumn("v", F.explode(each)).select("study_id", "branch_id", "species", "genus", "state", "place", "n_focal", "v.*")
    here = F.coalesce(F.col("place") == F.col("k"), F.lit(False))
    known = F.coalesce(F.col("n_focal") >= F.col("k"), F.lit(False))
    out = known & (((F.col("drop_rule") == "drop") & here) | ((F.col("drop_rule") == "only") & ~here)) & (F.col("state") == 1)
    state = F.when(out, 0.5).when((F.col("trait_axis") == "wide") & (F.col("state") == 0.5), 1.0).otherwise(F.col("state"))
    return rows.select("study_id", "model", "trait_axis", "drop_rule", "branch_id", "species", "genus", state.alias("state"))
