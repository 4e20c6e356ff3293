"""The multiplicative sensitivity baseline: two-way least squares of ln y on positive cells, within connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.graphs import components
from cladeframe.operators.c3 import LOCAL_EDGES, vertex_components
from cladeframe.workspace import Workspace, spread

# Tolerance of a step, most sweeps, tolerance of the normal equations.
TOLERANCE, SWEEPS, NORMAL = 1e-10, 1000, 4e-10
_EFFECT = "study_id string, axis string, id string, component string, effect double, certified boolean"


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["gene_id", "branch_id"], kind="stable")
    g, genes = pd.factorize(rows.gene_id)
    b, branches = pd.factorize(rows.branch_id)
    x = np.log(rows.y.to_numpy(float))
    ng, nb = len(genes), len(branches)
    of = components(ng + nb, g, b + ng)
    dg, db = np.bincount(g, minlength=ng), np.bincount(b, minlength=nb)
    left, right = np.zeros(ng), np.zeros(nb)
    n_b = np.bincount(of[ng:], minlength=of.max() + 1)
    for _ in range(SWEEPS):
        new = np.bincount(g, x - right[b], ng) / dg
        r = np.bincount(b, x - new[g], nb) / db
        # The gauge: branch effects of a component have mean 0.
        shift = np.bincount(of[ng:], r, of.max() + 1) / np.maximum(n_b, 1)
        r, new = r - shift[of[ng:]], new + shift[of[:ng]]
        step = max(np.abs(new - left).max(), np.abs(r - right).max())
        left, right = new, r
        if step < TOLERANCE:
            break
    rest = x - left[g] - right[b]
    size = max(1.0, np.abs(x).max())
    good = bool(max(np.abs(np.bincount(g, rest, ng) / dg).max(), np.abs(np.bincount(b, rest, nb) / db).max()) <= NORMAL * size)
    study = rows.study_id.iloc[0]
    least = np.full(of.max() + 1, ng)  # a component is named by its least gene
    np.minimum.at(least, of[:ng], np.arange(ng))
    return pd.DataFrame({
        "study_id": study, "axis": ["gene"] * ng + ["branch"] * nb, "id": [*genes, *branches], "component": np.asarray(genes)[least[of]],
        "effect": np.concatenate([left, right]) if good else np.nan, "certified": good,
    })


def effects(edges: DataFrame, work: Workspace | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Gene and branch effects on the log scale, from the positive cells of each study.

    Studies of up to ``local_edges`` positive cells are solved in a task each, larger ones by joins to the same tolerances; effects are
    null where the normal equations are not met.
    """
    positive = edges.where("y > 0").select("study_id", "gene_id", "branch_id", "y")
    work = work or Workspace(edges.sparkSession, "c2")
    size = positive.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    large = work.save(size.where(F.col("n") > local_edges).select("study_id"), "large")
    out = spread(positive.join(large, "study_id", "left_anti"), "study_id").groupBy("study_id").applyInPandas(_solve, _EFFECT)
    out = out.withColumn("effect", F.when(~F.isnan("effect"), F.col("effect")))
    return out if large.isEmpty() else out.unionByName(effects_joined(positive.join(large, "study_id"), work))


def effects_joined(positive: DataFrame, work: Workspace, every: int = 4, sweeps: int = SWEEPS) -> DataFrame:
    """The same effects by alternating means over joins, a table every few sweeps, until no effect of any study moves."""
    x = work.save(positive.select("study_id", "gene_id", "branch_id", F.ln("y").alias("x")), "logs")
    of = work.save(vertex_components(x.select("study_id", "gene_id", "branch_id"), Workspace(work.spark, "c2-components")), "of")
    home = of.where("axis = 'branch'").select("study_id", F.col("id").alias("branch_id"), "component")
    right = home.select("study_id", "branch_id", F.lit(0.0).alias("r"))
    before, sweep = None, 0
    while sweep < sweeps:
        for _ in range(every):
            left = x.join(right, ["study_id", "branch_id"]).groupBy("study_id", "gene_id").agg(F.avg(F.col("x") - F.col("r")).alias("g"))
            right = x.join(left, ["study_id", "gene_id"]).groupBy("study_id", "branch_id").agg(F.avg(F.col("x") - F.col("g")).alias("r"))
            sweep += 1
        left, right = work.save(left, f"left-{sweep}"), work.save(right, f"right-{sweep}")
        if before is not None:
            moved = right.join(before.withColumnRenamed("r", "b"), ["study_id", "branch_id"]).agg(F.max(F.abs(F.col("r") - F.col("b")))).first()[0]
            work.drop(f"left-{sweep - every}", f"right-{sweep - every}")
            if moved is None or moved < TOLERANCE:
                break
        before = right
    # The gauge: branch effects of a component have mean 0.
    shift = right.join(home, ["study_id", "branch_id"]).groupBy("study_id", "component").agg(F.avg("r").alias("shift"))
    rest = x.join(left, ["study_id", "gene_id"]).join(right, ["study_id", "branch_id"]).withColumn("e", F.col("x") - F.col("g") - F.col("r"))
    off = [rest.groupBy("study_id", c).agg(F.abs(F.avg("e")).alias("off"), F.max(F.abs("x")).alias("top")).select("study_id", "off", "top") for c in ("gene_id", "branch_id")]
    good = off[0].unionByName(off[1]).groupBy("study_id").agg((F.max("off") <= NORMAL * F.greatest(F.lit(1.0), F.max("top"))).alias("certified"))
    genes = left.select("study_id", F.lit("gene").alias("axis"), F.col("gene_id").alias("id"), F.col("g").alias("e"), F.lit(1.0).alias("sign"))
    both = genes.unionByName(right.select("study_id", F.lit("branch").alias("axis"), F.col("branch_id").alias("id"), F.col("r").alias("e"), F.lit(-1.0).alias("sign")))
    rows = both.join(of, ["study_id", "axis", "id"]).join(shift, ["study_id", "component"]).join(good, "study_id")
    return rows.select("study_id", "axis", "id", "component", F.when(F.col("certified"), F.col("e") + F.col("sign") * F.col("shift")).alias("effect"), "certified")


def evaluate(edges: DataFrame, fitted: DataFrame) -> DataFrame:
    """``mu`` of every cell with y >= 0 whose gene and branch are supported in one component, else the reason."""
    gene = fitted.where("axis = 'gene'").select("study_id", F.col("id").alias("gene_id"), F.col("component").alias("cg"), F.col("effect").alias("eg"))
    branch = fitted.where("axis = 'branch'").select("study_id", F.col("id").alias("branch_id"), F.col("component").alias("cb"), F.col("effect").alias("eb"))
    rows = edges.join(gene, ["study_id", "gene_id"], "left").join(branch, ["study_id", "branch_id"], "left")
    no_g, no_b = F.col("cg").isNull(), F.col("cb").isNull()
    state = F.when(no_g & no_b, "unsupported_both").when(no_g, "unsupported_gene").when(no_b, "unsupported_branch").when(F.col("cg") != F.col("cb"), "cross_component").otherwise("available")
    return rows.select("study_id", "gene_id", "branch_id", "y", state.alias("c2_state"), F.when(state == "available", F.exp(F.col("eg") + F.col("eb"))).alias("mu"))
