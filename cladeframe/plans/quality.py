"""Queries of the quality profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import cells, qc
from cladeframe.plans.matrix import digits, matrix, rates
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, GBI, TRIM, sig, with_

R = Registry()
_HAVE = "have AS (SELECT * FROM cells WHERE coord_state = 'observed' AND value IS NOT NULL)"
_Q = with_(CELLS, _HAVE)


def _summary_sql(by: str) -> str:
    qs = ", ".join(f"{sig(f'quantile_cont(value, {p})')} AS {n}" for n, p in qc.QUANTILES)
    return _Q + f"""SELECT {by}, available_count, exact_zero_count, positive_count, negative_count, min, max, mean, sd, sum_abs, {", ".join(n for n, _ in qc.QUANTILES)}, {sig("mad")} AS mad_raw, {sig("pl")} AS positive_log_median
      FROM (SELECT {by}, count(*) AS available_count, count(*) FILTER (WHERE value = 0) AS exact_zero_count, count(*) FILTER (WHERE value > 0) AS positive_count, count(*) FILTER (WHERE value < 0) AS negative_count,
        min(value) AS min, max(value) AS max, {sig("avg(value)")} AS mean, {sig("stddev_samp(value)", 6)} AS sd, {sig("sum(abs(value))")} AS sum_abs, {qs}, median(ln(CASE WHEN value > 0 THEN value END)) AS pl FROM have GROUP BY {by})
      JOIN (SELECT {by}, median(abs(value - m)) AS mad FROM have JOIN (SELECT {by}, median(value) AS m FROM have GROUP BY {by}) USING ({by}) GROUP BY {by}) USING ({by})"""


def _summary(spark, folder, by):
    s = qc.value_summary(matrix(spark, folder), by)
    cols = [digits(n).alias(n) for n, _ in qc.QUANTILES] + [digits("mean").alias("mean"), digits("sd", 6).alias("sd"), digits("sum_abs").alias("sum_abs"), digits("mad_raw").alias("mad_raw"), digits("positive_log_median").alias("positive_log_median")]
    return s.select(*by, "available_count", "exact_zero_count", "positive_count", "negative_count", "min", "max", *cols)


@R.add("g01_value_summary", _summary_sql("study_id"))
def g01_value_summary(spark, folder):
    return _summary(spark, folder, ["study_id"])


@R.add("g02_gene_summary", _summary_sql("study_id, gene_id"))
def g02_gene_summary(spark, folder):
    return _summary(spark, folder, ["study_id", "gene_id"])


@R.add("g02_branch_summary", _summary_sql("study_id, branch_id"))
def g02_branch_summary(spark, folder):
    return _summary(spark, folder, ["study_id", "branch_id"])


@R.add("g02_axis_coverage", _Q.rstrip() + """ SELECT study_id, gene_id, count(*) AS total_coordinates, count(*) FILTER (WHERE coord_state = 'observed') AS observed_count, count(value) AS payload_count,
    count(*) FILTER (WHERE coord_state = 'observed')::DOUBLE / count(*) AS observed_fraction, CASE WHEN count(*) FILTER (WHERE coord_state = 'observed') > 0 THEN count(value)::DOUBLE / count(*) FILTER (WHERE coord_state = 'observed') END AS available_of_observed FROM cells GROUP BY 1, 2""")
def g02_axis_coverage(spark, folder):
    return qc.axis_summary(matrix(spark, folder), "gene_id").select("study_id", "gene_id", "total_coordinates", "observed_count", "payload_count", "observed_fraction", "available_of_observed")


@R.add("g03_state_crosstab", _Q + """SELECT study_id, coord_state, CASE WHEN coord_state <> 'observed' OR value IS NULL THEN 'coordinate_no_payload' WHEN value < 0 THEN 'negative' WHEN value = 0 THEN 'exact_zero' ELSE 'finite_positive' END AS payload_state, count(*) AS n FROM cells GROUP BY 1, 2, 3""")
def g03_state_crosstab(spark, folder):
    return qc.state_crosstab(matrix(spark, folder))


@R.add("g04_point_masses", _Q + """SELECT study_id, CAST(rank AS INT) AS rank, value, count, count::DOUBLE / total AS fraction FROM (
    SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY count DESC, value) AS rank FROM (SELECT study_id, value, count(*) AS count FROM have GROUP BY 1, 2 HAVING count(*) > 1)) JOIN (SELECT study_id, count(*) AS total FROM have GROUP BY 1) USING (study_id) WHERE rank <= 10""")
def g04_point_masses(spark, folder):
    return qc.point_masses(matrix(spark, folder))


@R.add("g05_extreme_repetition", _Q + """SELECT study_id, lo AS minimum, count(*) FILTER (WHERE value = lo) AS minimum_count, hi AS maximum, count(*) FILTER (WHERE value = hi) AS maximum_count, count(*) AS total
  FROM have JOIN (SELECT study_id, min(value) AS lo, max(value) AS hi FROM have GROUP BY 1) USING (study_id) GROUP BY 1, 2, 4""")
def g05_extreme_repetition(spark, folder):
    return qc.extreme_repetition(matrix(spark, folder))


def _leverage_sql() -> str:
    units = {"cell": "SELECT study_id, gene_id || ' ' || branch_id AS unit, abs(value) AS mass FROM have", "gene_margin": "SELECT study_id, gene_id AS unit, abs(sum(value)) AS mass FROM have GROUP BY 1, 2", "branch_margin": "SELECT study_id, branch_id AS unit, abs(sum(value)) AS mass FROM have GROUP BY 1, 2"}
    parts = []
    for t, u in units.items():
        ranked = f"(SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY mass DESC, unit) AS r, count(*) OVER (PARTITION BY study_id) AS n FROM ({u}))"
        for s, p, k in [("top_k", k, f"least({k}, n)") for k in (1, 5, 10)] + [("top_fraction", f, f"least(n, greatest(1, ceil(n * {f}::DOUBLE)))") for f in (0.01, 0.05)]:
            parts.append(f"SELECT study_id, '{t}' AS target, '{s}' AS selection, {p}::DOUBLE AS parameter, CAST(max({k}) AS BIGINT) AS selected_count, {sig(f'CASE WHEN sum(mass) > 0 THEN sum(mass) FILTER (WHERE r <= {k}) / sum(mass) END', 6)} AS contribution FROM {ranked} GROUP BY 1")
    return _Q + " UNION ALL ".join(parts)


@R.add("g06_leverage", _leverage_sql())
def g06_leverage(spark, folder):
    return qc.leverage(matrix(spark, folder)).withColumn("contribution", digits("contribution", 6))


@R.add("g07_tail_concentration", _Q + " UNION ALL ".join(
    f"SELECT study_id, '{side}' AS side, {f}::DOUBLE AS tail_fraction, {sig('max(t)')} AS threshold, count(*) FILTER (WHERE value {op} t) AS cell_count, {sig(f'CASE WHEN sum(abs(value)) > 0 THEN sum(abs(value)) FILTER (WHERE value {op} t) / sum(abs(value)) END', 6)} AS contribution FROM have JOIN (SELECT study_id, quantile_cont(value, {p}) AS t FROM have GROUP BY 1) USING (study_id) GROUP BY 1"
    for f in (0.01, 0.05) for side, op, p in (("lower", "<=", f), ("upper", ">=", 1 - f))))
def g07_tail_concentration(spark, folder):
    return qc.tail_concentration(matrix(spark, folder)).withColumn("threshold", digits("threshold")).withColumn("contribution", digits("contribution", 6))


@R.add("g08_flags_iqr", _Q + f"""SELECT study_id, gene_id, branch_id, value AS diagnostic_value, {sig("CASE WHEN q3 > q1 THEN (value - m) / (q3 - q1) END", 6)} AS robust_score FROM have JOIN (
    SELECT study_id, gene_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM have GROUP BY 1, 2) USING (study_id, gene_id) WHERE value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)""")
def g08_flags_iqr(spark, folder):
    told, _ = qc.flags(matrix(spark, folder), qc.Rule("iqr", "iqr", "within_gene"))
    return told.select("study_id", "gene_id", "branch_id", "diagnostic_value", digits("robust_score", 6).alias("robust_score"))


@R.add("g08_flags_quantile", _Q + """SELECT study_id, gene_id, branch_id, value AS diagnostic_value FROM have JOIN (SELECT study_id, branch_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM have GROUP BY 1, 2) USING (study_id, branch_id) WHERE value >= hi OR value <= lo""")
def g08_flags_quantile(spark, folder):
    told, _ = qc.flags(matrix(spark, folder), qc.Rule("q", "quantile", "within_branch", ties="inclusive", lower_probability=0.05, upper_probability=0.95))
    return told.select("study_id", "gene_id", "branch_id", "diagnostic_value")


_MAD = "mads AS (SELECT study_id, gene_id, max(m) AS m, median(abs(value - m)) AS s FROM have JOIN (SELECT study_id, gene_id, median(value) AS m FROM have GROUP BY 1, 2) USING (study_id, gene_id) GROUP BY 1, 2)"


@R.add("g08_flags_mad", with_(CELLS, _HAVE, _MAD) + "SELECT study_id, gene_id, branch_id, value AS diagnostic_value FROM have JOIN mads USING (study_id, gene_id) WHERE s > 0 AND abs((value - m) / s) > 5")
def g08_flags_mad(spark, folder):
    return qc.flags(matrix(spark, folder), qc.Rule("mad", "mad", "within_gene", multiplier=5.0))[0].select("study_id", "gene_id", "branch_id", "diagnostic_value")


@R.add("g08_warnings_mad", with_(CELLS, _HAVE, _MAD) + "SELECT study_id, gene_id AS scope_id, 'MAD_ZERO_UNDEFINED' AS warning_code FROM mads WHERE s = 0")
def g08_warnings_mad(spark, folder):
    return qc.flags(matrix(spark, folder), qc.Rule("mad", "mad", "within_gene", multiplier=5.0))[1]


@R.add("g08_flags_absolute", _Q + "SELECT study_id, gene_id, branch_id, value AS diagnostic_value FROM have WHERE value > 1e6 OR value < 1e-6")
def g08_flags_absolute(spark, folder):
    return qc.flags(matrix(spark, folder), qc.Rule("abs", "absolute", lower=1e-6, upper=1e6))[0].select("study_id", "gene_id", "branch_id", "diagnostic_value")


@R.add("g09_top_cells", _Q + f"""SELECT study_id, gene_id, branch_id, CAST(rank AS INT) AS rank, value, {sig("CASE WHEN total > 0 THEN abs(value) / total END", 6)} AS contribution, (n - upto + 1)::DOUBLE / n AS upper_tail_rank_fraction FROM (
    SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY abs(value) DESC, gene_id, branch_id) AS rank, count(*) OVER (PARTITION BY study_id ORDER BY value) AS upto FROM have) JOIN (SELECT study_id, sum(abs(value)) AS total, count(*) AS n FROM have GROUP BY 1) USING (study_id) WHERE rank <= 10""")
def g09_top_cells(spark, folder):
    return qc.top_cells(matrix(spark, folder)).select("study_id", "gene_id", "branch_id", "rank", "value", digits("contribution", 6).alias("contribution"), "upper_tail_rank_fraction")


@R.add("g12_apply_qc", with_(CELLS, _HAVE, _MAD) + """SELECT study_id, status_before, status_after, count(*) AS n FROM (SELECT c.study_id, CASE WHEN coord_state = 'observed' AND value >= 0 THEN 'eligible' WHEN coord_state = 'observed' THEN 'unresolved' ELSE 'not_applicable' END AS status_before,
    CASE WHEN coord_state = 'observed' AND value IS NOT NULL AND s > 0 AND abs((value - m) / s) > 5 THEN 'ineligible' WHEN coord_state = 'observed' AND value >= 0 THEN 'eligible' WHEN coord_state = 'observed' THEN 'unresolved' ELSE 'not_applicable' END AS status_after
  FROM cells c LEFT JOIN mads USING (study_id, gene_id)) GROUP BY 1, 2, 3""")
def g12_apply_qc(spark, folder):
    m = matrix(spark, folder)
    told, _ = qc.flags(m, qc.Rule("mad", "mad", "within_gene", multiplier=5.0))
    return qc.apply_qc(cells.eligibility(m), told)[1]


@R.add("g13_diagnose_rate", with_(CELLS, TRIM, GBI) + f"""SELECT study_id, n, {sig("q", 6)} AS q050, {sig("d", 6)} AS mean_departure, n_above, {sig("mad", 6)} AS mad FROM (
    SELECT study_id, count(gbi) AS n, median(gbi) AS q, avg(abs(gbi - 1)) AS d, count(*) FILTER (WHERE gbi > 1) AS n_above FROM (SELECT study_id, {sig("gbi", 9)} AS gbi FROM rates) GROUP BY 1)
  JOIN (SELECT study_id, 1.4826 * median(abs(gbi - m)) AS mad FROM (SELECT study_id, {sig("gbi", 9)} AS gbi FROM rates) JOIN (SELECT study_id, median(gbi) AS m FROM (SELECT study_id, {sig("gbi", 9)} AS gbi FROM rates) GROUP BY 1) USING (study_id) GROUP BY 1) USING (study_id)""")
def g13_diagnose_rate(spark, folder):
    r = rates(spark, folder).withColumn("gbi", digits("gbi", 9))
    return qc.diagnose_rate(r, "gbi", 1.0, ["study_id"]).select("study_id", "n", digits("q050", 6).alias("q050"), digits("mean_departure", 6).alias("mean_departure"), "n_above", digits("mad", 6).alias("mad"))


@R.add("g14_extreme_ledger", with_(CELLS, TRIM, GBI, f"r9 AS (SELECT study_id, gene_id, branch_id, {sig('gbi', 9)} AS rate FROM rates WHERE gbi IS NOT NULL)") + " UNION ALL ".join(
    f"SELECT study_id, '{n}' AS ledger, CAST(k AS INT) AS rank, gene_id, branch_id, {sig('rate')} AS rate FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY {o}, gene_id, branch_id) AS k FROM r9) WHERE k <= 5"
    for n, o in (("highest", "rate DESC"), ("lowest", "rate"), ("largest_departure", "abs(rate - 1) DESC"))))
def g14_extreme_ledger(spark, folder):
    r = rates(spark, folder).withColumn("gbi", digits("gbi", 9))
    return qc.extreme_ledger(r, "gbi", 1.0).withColumn("rate", digits("rate"))


_OVERALL = """whole AS (SELECT study_id, count(DISTINCT gene_id) AS gene_count, count(DISTINCT branch_id) AS branch_count, count(*) AS cell_count, count(*) FILTER (WHERE coord_state = 'observed') AS observed, count(*) FILTER (WHERE coord_state = 'observed' AND value IS NOT NULL) AS available,
  count(*) FILTER (WHERE value = 0) AS zero, count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value < 0) AS negative FROM cells GROUP BY 1)"""


@R.add("g10_overall", with_(CELLS, _OVERALL) + """SELECT study_id, gene_count, branch_count, cell_count, observed AS coordinate_observed_count, available AS payload_available_count, observed - available AS observed_payload_unavailable_count, zero AS exact_zero_count,
  CASE WHEN negative > 0 THEN 'signed' ELSE 'nonnegative' END AS resolved_value_domain, CASE WHEN negative > 0 THEN 'absolute_value' ELSE 'nonnegative_value' END AS concentration_measure, CASE WHEN available > 0 THEN zero::DOUBLE / available END AS exact_zero_fraction FROM whole""")
def g10_overall(spark, folder):
    return qc.overall(matrix(spark, folder)).select("study_id", "gene_count", "branch_count", "cell_count", "coordinate_observed_count", "payload_available_count", "observed_payload_unavailable_count", "exact_zero_count", "resolved_value_domain", "concentration_measure", "exact_zero_fraction")


@R.add("g10_holds", with_(CELLS, _OVERALL) + "SELECT study_id, 'HOLD' AS severity, 'DECLARED_POSITIVE_DOMAIN_VIOLATION' AS hold_code, zero + negative AS n FROM whole WHERE zero + negative > 0")
def g10_holds(spark, folder):
    """Studies that hold when their values are declared positive."""
    return qc.holds(qc.overall(matrix(spark, folder), "positive"))


@R.add("g10_metric_domains", with_(CELLS, _OVERALL) + """SELECT study_id, 'raw_distribution' AS metric, 'finite_signed' AS mathematical_domain, available AS admitted_count, 0::BIGINT AS domain_loss_count, 'retained' AS zero_handling FROM whole
  UNION ALL SELECT study_id, 'contribution_concentration', CASE WHEN negative > 0 THEN 'absolute_finite_value' ELSE 'finite_nonnegative_value' END, available, 0, 'retained' FROM whole
  UNION ALL SELECT study_id, 'positive_log_distribution', 'strictly_positive_finite_value', positive, zero + negative, 'outside_metric_domain_no_pseudocount' FROM whole""")
def g10_metric_domains(spark, folder):
    return qc.metric_domains(qc.overall(matrix(spark, folder)))


@R.add("g10_warnings", with_(CELLS, _OVERALL, _HAVE) + """SELECT study_id, 'INFO' AS severity, 'EXACT_POINT_MASS_PRESENT' AS warning_code, 'whole_matrix' AS scope_id, least(10, count(*)) AS n FROM (SELECT study_id, value FROM have GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT study_id, 'INFO', 'POSITIVE_ONLY_METRIC_DOMAIN_LOSS', 'whole_matrix', zero + negative FROM whole WHERE zero + negative > 0
  UNION ALL SELECT study_id, 'WARNING', 'DIAGNOSTIC_FLAGS_PRESENT', 'high', count(*) FROM have WHERE value > 1000 GROUP BY 1""")
def g10_warnings(spark, folder):
    """Warnings of the profile with one rule, values above 1000."""
    return qc.profile(matrix(spark, folder), rules=(qc.Rule("high", "absolute", direction="upper", upper=1000.0),))["warnings"]


@R.add("g02_mass_fractions", _Q + f"""SELECT study_id, gene_id, {sig("CASE WHEN t > 0 THEN s / t END", 6)} AS mass_fraction, n AS positive_log_count, l AS positive_log_domain_loss FROM (
    SELECT study_id, gene_id, sum(abs(value)) AS s, count(*) FILTER (WHERE value > 0) AS n, count(*) FILTER (WHERE value <= 0) AS l FROM have GROUP BY 1, 2) JOIN (SELECT study_id, sum(abs(value)) AS t FROM have GROUP BY 1) USING (study_id)""")
def g02_mass_fractions(spark, folder):
    """Share of a gene in its study's absolute mass, and its cells inside and outside the positive logarithm."""
    return qc.axis_summary(matrix(spark, folder), "gene_id").where("available_count > 0").select("study_id", "gene_id", digits("mass_fraction", 6).alias("mass_fraction"), "positive_log_count", "positive_log_domain_loss")
