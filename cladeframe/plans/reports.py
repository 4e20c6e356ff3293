"""Queries of contracts, boundary calibration, contributions and report tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.functions.stats import adjust
from cladeframe.operators import association, baseline, reporting, traits
from cladeframe.plans.matrix import digits, matrix, rates, states
from cladeframe.plans.models import _BOUNDARY, _CLOSED, _EDGES, _ONLY_WORLDS, _WORLDS, boundary_cells, closed_form, fitted, kept_fit, labelled
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, GBI, STATES, TRIM, sig, with_
from cladeframe.plans.validation import _COEF
from cladeframe.sources.tables import table
from cladeframe.workspace import Workspace

R = Registry()


@R.add("a08_ledger_agreement", with_(CELLS, STATES) + """
  SELECT study_id, branch_id, 'matrix' AS side FROM (SELECT DISTINCT study_id, branch_id FROM cells) c WHERE NOT EXISTS (SELECT 1 FROM coords o WHERE o.study_id = c.study_id AND o.branch_id = c.branch_id)
  UNION ALL SELECT study_id, branch_id, 'ledger' FROM coords c WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.study_id = c.study_id AND o.branch_id = c.branch_id)""")
def a08_ledger_agreement(spark, folder):
    return traits.key_agreement(matrix(spark, folder), traits.in_force(table(spark, folder, "coordinates"), ["study_id", "branch_id"]), ["study_id", "branch_id"], "matrix", "ledger")


@R.add("a08_preserved_rows", """
  WITH v AS (SELECT *, row_number() OVER (PARTITION BY study_id, gene_id, coordinate_id ORDER BY run_day DESC NULLS LAST, loaded_at DESC NULLS LAST, cell_id DESC) AS late, row_number() OVER (PARTITION BY study_id, gene_id, coordinate_id ORDER BY run_day, loaded_at, cell_id) AS early
    FROM state_ledger WHERE study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL AND run_day IS NOT NULL AND loaded_at IS NOT NULL)
  SELECT 'first' AS side, * FROM (SELECT study_id, gene_id, coordinate_id AS branch_id, state FROM v WHERE early = 1 EXCEPT ALL SELECT study_id, gene_id, coordinate_id, state FROM v WHERE late = 1)
  UNION ALL SELECT 'second', * FROM (SELECT study_id, gene_id, coordinate_id, state FROM v WHERE late = 1 EXCEPT ALL SELECT study_id, gene_id, coordinate_id, state FROM v WHERE early = 1)""")
def a08_preserved_rows(spark, folder):
    """States that the first and the last export of a cell do not have in common."""
    rows = table(spark, folder, "state_ledger").where("study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL AND run_day IS NOT NULL AND loaded_at IS NOT NULL")
    order = F.struct("run_day", "loaded_at", "cell_id")
    ends = rows.groupBy("study_id", "gene_id", F.col("coordinate_id").alias("branch_id")).agg(F.min_by("state", order).alias("a"), F.max_by("state", order).alias("b"))
    side = lambda c: ends.select("study_id", "gene_id", "branch_id", F.col(c).alias("state"))
    return reporting.same_cells(side("a"), side("b"), ["study_id", "gene_id", "branch_id", "state"])


@R.add("b06_accessors", with_(CELLS, _EDGES, _CLOSED, _BOUNDARY) + """SELECT study_id, gene_id, branch_id, CASE ratio_state WHEN 'EXACT_ZERO_BOUNDARY' THEN true WHEN 'POSITIVE' THEN false END AS exact_zero, ratio_state <> 'UNAVAILABLE' AS ratio_available, positive_log IS NOT NULL AS log_available FROM boundary""")
def b06_accessors(spark, folder):
    """Three-valued exact zero, and availability of ratio and logarithm."""
    return _boundary_flags(boundary_cells(spark, folder))


def _boundary_flags(b):
    s = F.col("ratio_state")
    return b.select("study_id", "gene_id", "branch_id", F.when(s == "EXACT_ZERO_BOUNDARY", True).when(s == "POSITIVE", False).alias("exact_zero"), (s != "UNAVAILABLE").alias("ratio_available"), F.col("positive_log").isNotNull().alias("log_available"))


@R.add("b06_accessors_c3")
def b06_accessors_c3(spark, folder):
    return _boundary_flags(boundary_cells(spark, folder, fitted))


@R.add("b08_zero_origin", with_(CELLS, _EDGES, _CLOSED) + "SELECT study_id, CASE WHEN y > 0 AND mu > 0 THEN 'positive' WHEN y = 0 AND mu > 0 THEN 'numerator_zero' END AS zero_origin, count(*) AS n FROM cells LEFT JOIN fit USING (study_id, gene_id, branch_id) GROUP BY 1, 2")
def b08_zero_origin(spark, folder):
    from cladeframe.operators.rates import rate

    return rate(matrix(spark, folder), closed_form(spark, folder), "GBI").groupBy("study_id", "zero_origin").agg(F.count(F.lit(1)).alias("n"))


@R.add("b08_zero_origin_c3")
def b08_zero_origin_c3(spark, folder):
    from cladeframe.operators.rates import rate

    return rate(matrix(spark, folder), fitted(spark, folder), "GBI").groupBy("study_id", "zero_origin").agg(F.count(F.lit(1)).alias("n"))


@R.add("b16_quadrants", with_(CELLS, STATES) + """SELECT study_id, species, CASE WHEN state IS NULL OR share IS NULL THEN 'undefined' WHEN state >= 0.5 AND share >= 0.5 THEN 'both_high' WHEN state >= 0.5 THEN 'first_high' WHEN share >= 0.5 THEN 'second_high' ELSE 'both_low' END AS quadrant
  FROM states LEFT JOIN (SELECT study_id, branch_id, count(value)::DOUBLE / count(*) AS share FROM cells GROUP BY 1, 2) USING (study_id, branch_id)""")
def b16_quadrants(spark, folder):
    share = matrix(spark, folder).groupBy("study_id", "branch_id").agg((F.count("value") / F.count(F.lit(1))).alias("share"))
    return states(spark, folder).join(share, ["study_id", "branch_id"], "left").select("study_id", "species", reporting.quadrant(F.col("state"), F.col("share"), 0.5).alias("quadrant"))


@R.add("c15_model_contract", with_(CELLS, TRIM, GBI, STATES) + """
  SELECT study_id, 'negative_value' AS issue, gene_id || ' ' || branch_id AS key FROM rates WHERE gbi < 0
  UNION ALL SELECT study_id, 'terminal_off_matrix', branch_id FROM states s WHERE NOT EXISTS (SELECT 1 FROM rates r WHERE r.study_id = s.study_id AND r.branch_id = s.branch_id)
  UNION ALL SELECT study_id, 'genus_without_fold', genus FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL) s WHERE NOT EXISTS (SELECT 1 FROM folds f WHERE f.study_id = s.study_id AND f.genus = s.genus AND f.fold_id IS NOT NULL)""")
def c15_model_contract(spark, folder):
    return reporting.model_contract(rates(spark, folder), states(spark, folder), traits.ordered_folds(table(spark, folder, "folds")), "gbi")


@R.add("f08_crosswalk_issues", with_(STATES) + """
  SELECT study_id, 'left' AS side, branch_id AS key, count(DISTINCT canonical_split_key) AS n_partners FROM coords WHERE canonical_split_key IS NOT NULL GROUP BY 1, 3 HAVING count(DISTINCT canonical_split_key) > 1
  UNION ALL SELECT study_id, 'right', canonical_split_key, count(DISTINCT branch_id) FROM coords WHERE canonical_split_key IS NOT NULL GROUP BY 1, 3 HAVING count(DISTINCT branch_id) > 1""")
def f08_crosswalk_issues(spark, folder):
    return reporting.bijection_issues(traits.in_force(table(spark, folder, "coordinates"), ["study_id", "branch_id"]), ["study_id"], "branch_id", "canonical_split_key")


@R.add("l10_contributions", with_(CELLS, TRIM, GBI, _COEF) + f"""SELECT b.study_id, b.branch_id, gene_id, {sig("round(coefficient * coalesce((r.gbi - mean) / sd, 0), 6)", 5)} AS contribution, r.gbi IS NULL AS imputed
  FROM (SELECT DISTINCT study_id, branch_id FROM rates) b JOIN coef USING (study_id) LEFT JOIN rates r USING (study_id, branch_id, gene_id)""")
def l10_contributions(spark, folder):
    r = rates(spark, folder)
    c = r.groupBy("study_id", "gene_id").agg(F.avg("gbi").alias("mean"), F.stddev_samp("gbi").alias("sd"))
    c = c.withColumn("coefficient", 1.0 / F.row_number().over(W.partitionBy("study_id").orderBy("gene_id"))).where("sd > 0")
    return reporting.contributions(r, c, "gbi").withColumn("contribution", digits(F.round("contribution", 6), 5))


@R.add("r10_run_diagnostics", with_(CELLS, TRIM, GBI) + """SELECT study_id, n_genes, n_trimmed, n_ratio, n_without FROM (SELECT study_id, count(DISTINCT gene_id) AS n_genes, count(*) FILTER (WHERE trimmed) AS n_trimmed FROM trim_rows GROUP BY 1)
  JOIN (SELECT study_id, count(gbi) AS n_ratio, count(*) FILTER (WHERE gbi IS NULL) AS n_without FROM rates GROUP BY 1) USING (study_id)""")
def r10_run_diagnostics(spark, folder):
    t = baseline.trim(matrix(spark, folder))
    return reporting.run_diagnostics(t, baseline.ratio(t))


_FOOT = "'inclusive gene q0.975/type7; arithmetic GE/BE; divide BE then GE; historical castor ASR; reference-minus-focal Welch; strict-prefix FDR0.01'"


@R.add("r01_recipes", f"""SELECT 'submitted_S2' AS recipe, 'S2' AS version, validation_recipe, selection, {_FOOT} AS footprint FROM (VALUES ('nested_phase12B', 'fold-held branches excluded; nested_multiply arithmetic'), ('nested_phase13', 'fold-held branches excluded; phase13_power arithmetic'),
  ('global_screen_foldwise', 'global supervised screen reused; not nested feature selection')) t(validation_recipe, selection)""")
def r01_recipes(spark, folder):
    return spark.createDataFrame(reporting.recipes(), "recipe string, version string, validation_recipe string, selection string, footprint string")


@R.add("b16_habitat", with_(STATES) + """SELECT study_id, species, CASE WHEN state = 1 THEN 'marine' WHEN wide = 1 THEN 'non-marine aquatic' WHEN wide = 0.5 THEN 'semi-aquatic' WHEN wide = 0 THEN 'terrestrial' END AS category
  FROM (SELECT study_id, species, state, CASE WHEN genus IS NULL THEN NULL WHEN length(species) % 3 = 0 THEN 1 ELSE state END AS wide FROM states)""")
def b16_habitat(spark, folder):
    """Four categories from two codings: the trait, and one that counts names of a third of all lengths as focal too."""
    s = states(spark, folder)
    wide = F.when(F.col("genus").isNotNull(), F.when(F.length("species") % 3 == 0, 1.0).otherwise(F.col("state")))
    return s.select("study_id", "species", reporting.habitat(F.col("state"), wide).alias("category"))


_BOUND_NULLS = f"""part AS (
  SELECT b.study_id, b.gene_id, b.branch_id, component, v, state FROM (
    SELECT study_id, gene_id, branch_id, 'ZERO_MASS' AS component, CASE ratio_state WHEN 'EXACT_ZERO_BOUNDARY' THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM boundary WHERE ratio_state <> 'UNAVAILABLE'
    UNION ALL SELECT study_id, gene_id, branch_id, 'POSITIVE_LOG', positive_log FROM boundary WHERE ratio_state = 'POSITIVE') b JOIN states s ON s.study_id = b.study_id AND s.branch_id = b.branch_id AND state IN (0, 1)),
obs AS (SELECT study_id, gene_id, component, count(*) AS n, avg(v) FILTER (WHERE state = 1) - avg(v) FILTER (WHERE state = 0) AS d FROM part GROUP BY 1, 2, 3),
nul AS (SELECT study_id, gene_id, component, replicate, CASE WHEN n1 > 0 AND n1 < n THEN s1 / n1 - (s - s1) / (n - n1) END AS score FROM (
  SELECT study_id, gene_id, component, replicate, count(*) AS n, count(*) FILTER (WHERE w.state = 1) AS n1, sum(v) AS s, coalesce(sum(v) FILTER (WHERE w.state = 1), 0) AS s1 FROM part JOIN worlds w USING (study_id, branch_id) GROUP BY 1, 2, 3, 4))"""


@R.add("k05_boundary_calibration", with_(CELLS, _EDGES, _CLOSED, _BOUNDARY, STATES, _ONLY_WORLDS, _BOUND_NULLS) + f"""
  SELECT study_id, gene_id, component, status, n_null, CASE WHEN status IN ('CALIBRATED', 'TOO_FEW_LABELLINGS') THEN hits END AS exceedances, CASE WHEN status = 'CALIBRATED' THEN (hits + 1) / {_WORLDS + 1}.0::DOUBLE END AS p FROM (
    SELECT study_id, gene_id, component, n_null, hits, CASE WHEN d IS NULL OR n < 3 THEN 'OBSERVED_DIAGNOSTIC_NONESTIMABLE' WHEN n_null < {_WORLDS} THEN 'NULL_CALIBRATION_INCOMPLETE' WHEN round(n_labellings) <= {_WORLDS} THEN 'TOO_FEW_LABELLINGS' ELSE 'CALIBRATED' END AS status FROM obs LEFT JOIN ways USING (study_id) JOIN (
      SELECT u.study_id, u.gene_id, u.component, count(score) AS n_null, count(*) FILTER (WHERE abs(score) >= abs(d) - 1e-10 * greatest(1, abs(d))) AS hits FROM nul u JOIN obs USING (study_id, gene_id, component) GROUP BY 1, 2, 3) USING (study_id, gene_id, component))""")
def k05_boundary_calibration(spark, folder):
    """Both boundary components against the same null worlds; never one joint p."""
    return _boundary_calibration(spark, folder).select("study_id", "gene_id", "component", "status", "n_null", "exceedances", "p")


def _boundary_calibration(spark, folder, fit=closed_form, null_names=("permutation",)):
    """Per gene, component and named null; the worlds of a null serve both components."""
    work = Workspace(spark, "k05")
    b = boundary_cells(spark, folder, fit).withColumn("available", F.col("ratio_state") != "UNAVAILABLE")
    d = work.save(association.domain(b, traits.branch_states(matrix(spark, folder), states(spark, folder))).where("eligible"), "cells")
    own = work.save(labelled(spark, folder), "own")
    return association.calibrate_boundary(d, {name: association.permuted_worlds(own, _WORLDS, 3 + i) for i, name in enumerate(null_names)}, association.labellings(own), _WORLDS)


@R.add("k05_boundary_calibration_c3")
def k05_boundary_calibration_c3(spark, folder):
    """On the fit itself, against two named nulls."""
    return _boundary_calibration(spark, folder, kept_fit, ("permutation", "permutation_2"))


@R.add("k07_boundary_adjusted", f"""SELECT study_id, gene_id, component, 'permutation' AS null_family, p, n AS n_tests, {sig("least(1.0, min(p * n / k) OVER (PARTITION BY study_id, component ORDER BY k DESC))", 6)} AS p_bh, {sig("least(1.0, min(p * n * h / k) OVER (PARTITION BY study_id, component ORDER BY k DESC))", 6)} AS p_by
  FROM (SELECT *, sum(1.0 / k) OVER (PARTITION BY study_id, component) AS h FROM (SELECT *, row_number() OVER (PARTITION BY study_id, component ORDER BY p, gene_id) AS k, count(*) OVER (PARTITION BY study_id, component) AS n FROM ({R.sql["k05_boundary_calibration"]}) WHERE p IS NOT NULL))""")
def k07_boundary_adjusted(spark, folder):
    """Adjustment within each component and null family."""
    rows = adjust(_boundary_calibration(spark, folder), "p", ["study_id", "component", "null_family"], ["gene_id"]).where("p IS NOT NULL")
    return rows.select("study_id", "gene_id", "component", "null_family", "p", "n_tests", digits("p_bh", 6).alias("p_bh"), digits("p_by", 6).alias("p_by"))


@R.add("k07_boundary_adjusted_c3")
def k07_boundary_adjusted_c3(spark, folder):
    rows = _boundary_calibration(spark, folder, kept_fit, ("permutation", "permutation_2"))
    return adjust(rows, "p", ["study_id", "component", "null_family"], ["gene_id"]).select("study_id", "gene_id", "component", "null_family", "p", "p_bh", "p_by", "n_tests")
