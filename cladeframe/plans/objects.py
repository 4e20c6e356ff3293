"""Queries of constructors, validators, sensitivity rates, tree matching, and whole runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import association, c2, cells, objects, pipeline, rates, reporting, sets, traits, tree, variants
from cladeframe.plans.matrix import digits, matrix, states
from cladeframe.plans.models import assoc_cells, boundary_cells, closed_form, edges, fitted, labelled
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, STATES, with_
from cladeframe.plans.validation import _edges as tree_edges
from cladeframe.plans.validation import _full_fits, internal_projection
from cladeframe.plans.validation import rates as study_rates
from cladeframe.sources.tables import table
from cladeframe.workspace import Workspace, unbroadcast

R = Registry()

_NONE = "SELECT NULL::VARCHAR AS study_id, NULL::VARCHAR AS rule, NULL::BIGINT AS n WHERE false"


@R.add("c04_eligibility_violations", with_(CELLS) + """SELECT study_id, rule, n FROM (SELECT study_id, 'not_applicable_where_observed' AS rule, count(*) FILTER (WHERE coord_state = 'observed' AND value > 1000) AS n FROM cells GROUP BY 1
  UNION ALL SELECT study_id, 'not_applicable_reason', count(*) FILTER (WHERE coord_state = 'observed' AND value > 1000) FROM cells GROUP BY 1 UNION ALL SELECT study_id, 'exclusion_reason_missing', count(*) FILTER (WHERE coord_state = 'observed' AND value = 0) FROM cells GROUP BY 1) WHERE n > 0""")
def c04_eligibility_violations(spark, folder):
    """The validator on a supplied layer with two faults: values above 1000 called not applicable, zeros excluded without a reason."""
    e = cells.eligibility(matrix(spark, folder))
    high, zero = F.coalesce(F.col("value") > 1000, F.lit(False)), F.coalesce(F.col("value") == 0, F.lit(False))
    return objects.eligibility_violations(e.withColumn("elig_status", F.when(high, "not_applicable").when(zero, "ineligible").otherwise(F.col("elig_status"))))


@R.add("c07_state_violations", with_(CELLS, STATES) + """SELECT study_id, rule, n FROM (
    SELECT study_id, 'value_where_not_available' AS rule, count(*) FILTER (WHERE state = 0.5) AS n FROM (SELECT DISTINCT study_id, branch_id FROM cells) LEFT JOIN states USING (study_id, branch_id) GROUP BY 1) WHERE n > 0""")
def c07_state_violations(spark, folder):
    """Branch states that keep the number of an unresolved trait: told by the validator."""
    return objects.branch_state_violations(traits.branch_states(matrix(spark, folder), states(spark, folder)))


@R.add("c17_ensemble", with_(CELLS, STATES) + """, own AS (SELECT study_id, branch_id FROM states WHERE state IN (0, 1) AND (study_id, branch_id) IN (SELECT study_id, branch_id FROM cells))
  SELECT study_id, replicate, count(*) AS n_branches, count(*) FILTER (WHERE length(branch_id) % 2 = 0) AS n_available FROM own CROSS JOIN range(1, 6) t(replicate) GROUP BY 1, 2""")
def c17_ensemble(spark, folder):
    """Supplied worlds with one availability per branch, expanded over the replicates."""
    own = labelled(spark, folder)
    available = own.where(F.col("state").isin(0.0, 1.0)).select("study_id", "branch_id", F.when(F.length("branch_id") % 2 == 0, "available").otherwise("unavailable").alias("availability"))
    worlds = association.permuted_worlds(own, 5).withColumn("state", F.when(F.length("branch_id") % 2 == 0, F.col("state")))
    out = objects.ensemble(worlds, available)
    return out.groupBy("study_id", F.col("replicate").cast("bigint").alias("replicate")).agg(F.count(F.lit(1)).alias("n_branches"), F.count_if(F.col("availability") == "available").cast("bigint").alias("n_available"))


@R.add("c12_dependency_status", with_(CELLS) + """SELECT study_id, CASE WHEN bool_or(coord_state = 'observed' AND value IS NOT NULL AND value <> 0) AND count(*) FILTER (WHERE value = 0) > 0 THEN 'STALE_DEPENDENCY' ELSE 'CURRENT' END AS dependency_status FROM (SELECT * FROM cells WHERE value IS NOT NULL) GROUP BY 1""")
def c12_dependency_status(spark, folder):
    """Objects derived from all available cells, against a source that has lost its zeros since."""
    m = matrix(spark, folder).where("value IS NOT NULL")
    before = cells.mask_hash(m, F.lit(True)).withColumnRenamed("mask_sha256", "sha256")
    return objects.dependency_status(before, cells.mask_hash(m, F.col("value") != 0).withColumnRenamed("mask_sha256", "sha256"))


@R.add("c13_object_violations", _NONE)
def c13_object_violations(spark, folder):
    """All validators on what this package computes: fit, rates, boundary object, association. None is broken."""
    f = Workspace(spark, "c13").save(fitted(spark, folder), "fit")
    m = matrix(spark, folder)
    every = [objects.fit_violations(f)] + [objects.rate_violations(rates.rate(m, f, method), method) for method in rates.METHODS]
    every += [objects.boundary_violations(rates.log_relative(rates.rate(m, f, "GBI"))), objects.association_violations(association.binary(assoc_cells(spark, folder))), objects.eligibility_violations(cells.eligibility(m))]
    return reduce(DataFrame.unionByName, every)


@R.add("b13_c2_rates")
def b13_c2_rates(spark, folder):
    """Reasons of the three rates on the sensitivity baseline."""
    e = edges(spark, folder)
    done = Workspace(spark, "b13").save(c2.evaluate(e, c2.effects(e)), "evaluated")
    parts = [rates.c2_rate(matrix(spark, folder), done, method).groupBy("study_id", "reason", "support").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("total")).withColumn("method", F.lit(method)) for method in rates.C2_METHODS]
    return reduce(DataFrame.unionByName, parts)


@R.add("b11_encoded_replay", "SELECT NULL::VARCHAR AS study_id, NULL::VARCHAR AS gene_id, NULL::VARCHAR AS branch_id, NULL::VARCHAR AS issue WHERE false")
def b11_encoded_replay(spark, folder):
    """An encoded view of some genes, given again by its source cell by cell."""
    b = Workspace(spark, "b11").save(boundary_cells(spark, folder), "boundary")
    some = b.groupBy("study_id").agg(F.min("gene_id").alias("gene_id"))
    return rates.encoded_mismatches(rates.encoded(b, some), b)


@R.add("f09_module_display", with_(CELLS) + """SELECT study_id, count(*) AS union_predictors, count(*) FILTER (WHERE length(gene_id) > 0 AND n % 2 = 0) AS counted, count(*) FILTER (WHERE n % 2 <> 0) AS not_counted, count(DISTINCT CASE WHEN n % 2 = 0 THEN right(gene_id, 1) END) AS display_modules
  FROM (SELECT study_id, gene_id, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1""")
def f09_module_display(spark, folder):
    """Genes of a study as predictors, modules by their last character, counted where their number of cells is even."""
    g = matrix(spark, folder).groupBy("study_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    return sets.module_display(g.select("study_id", "gene_id", F.right("gene_id", F.lit(1)).alias("display_module"), (F.col("n") % 2 == 0).alias("counted")), g)


@R.add("i04_mapped_states")
def i04_mapped_states(spark, folder):
    """States on the tree without its repeated splits, carried over to the full tree by matched clades, with the branches that have no partner."""
    e = tree_edges(spark, folder)
    other = e.groupBy("study_id", "clade").agg(F.min("branch_id").alias("branch_id"), F.min_by("parent_branch", "branch_id").alias("parent_branch"))
    pairs, ledger = tree.match_edges(e, other)
    mapped = tree.map_states(tree.parsimony_states(e, states(spark, folder)), pairs)
    n = mapped.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_mapped"))
    lost = ledger.groupBy("study_id").agg(F.count_if(F.col("side") == "main").cast("bigint").alias("n_main_unmatched"), F.count_if(F.col("side") == "other").cast("bigint").alias("n_other_unmatched"))
    return n.join(lost, "study_id", "left").na.fill(0)


def _inputs(spark, folder):
    return pipeline.Inputs(matrix(spark, folder), *(table(spark, folder, n) for n in ("coordinates", "trait", "taxon_groups")))


def _sizes(tables):
    return reduce(DataFrame.unionByName, [d.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("stage", F.lit(n)) for n, d in tables.items()])


@R.add("r03_study_run")
def r03_study_run(spark, folder):
    """The whole study run in one call: rows of every stage's table."""
    return _sizes(pipeline.run_study(spark, _inputs(spark, folder), pipeline.AnalysisSpec("submitted_S2", "nested_phase12B")))


@R.add("r04_models_run")
def r04_models_run(spark, folder):
    """States and screens of all variants in one call: rows of every stage's table."""
    return _sizes(pipeline.run_models(spark, _inputs(spark, folder)))


@R.add("r05_multi_run")
def r05_multi_run(spark, folder):
    """The multi-model study in one call: rows of every stage's table."""
    return _sizes(pipeline.run_multi(spark, _inputs(spark, folder)))


@R.add("r06_screening_table")
def r06_screening_table(spark, folder):
    """Genes tested and selected, and their directions, of all variants."""
    return pipeline.run_models(spark, _inputs(spark, folder))["screening_table"]


@R.add("r08_projection_profile")
def r08_projection_profile(spark, folder):
    """Terminal and internal branches with the logits of both baselines side by side."""
    from cladeframe.operators import validation

    fit, _, r, t = _full_fits(spark, folder)
    usable = fit.where("status = 'fit' AND sd IS NOT NULL")
    own = t.where("drop_rule = 'baseline'")
    ends = [validation.project(r.join(unbroadcast(own.where(F.col("model") == m).select("study_id", "branch_id")), ["study_id", "branch_id"], "left_semi"), usable.where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in ("declared_baseline", "wide_baseline")]
    terminal = ends[0].unionByName(ends[1]).select("study_id", "model", "branch_id", "logit").withColumn("branch_type", F.lit("terminal"))
    internal = internal_projection(r, own).select("study_id", "model", "branch_id", "logit").withColumn("branch_type", F.lit("internal"))
    return terminal.unionByName(internal).groupBy("study_id", "branch_id", "branch_type").pivot("model", ["declared_baseline", "wide_baseline"]).agg(F.first("logit"))
