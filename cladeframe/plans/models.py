"""Queries of the baseline models, rates, association and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.functions.stats import adjust
from cladeframe.operators import association, c2, c3, cells, rates, traits
from cladeframe.plans.matrix import digits, matrix, states
from cladeframe.plans.matrix import rates as study_rates
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, GBI, STATES, TRIM, sig, with_
from cladeframe.sources.tables import table
from cladeframe.workspace import Workspace

R = Registry()

_EDGES = "edges AS (SELECT study_id, gene_id, branch_id, value AS y FROM cells WHERE coord_state = 'observed' AND value >= 0)"
_LOG_EDGES = "edges AS (SELECT study_id, gene_id, branch_id, ln(1 + value) AS y FROM cells WHERE coord_state = 'observed' AND value >= 0)"
_BOTH = with_(CELLS, _EDGES)


def edges(spark, folder):
    return c3.domain(matrix(spark, folder))


def log_edges(spark, folder):
    """The admitted cells with the payload ln(1 + y): sums of like magnitude, so that scaling converges in few sweeps."""
    return edges(spark, folder).withColumn("y", F.ln(F.col("y") + 1))


def fitted(spark, folder):
    return c3.fit(edges(spark, folder), Workspace(spark, "c3"))


def kept_fit(spark, folder):
    """The fit of the raw payload, written once for queries that read it several times."""
    work = Workspace(spark, "c3")
    return work.save(c3.fit(edges(spark, folder), work), "fit")


def log_fitted(spark, folder):
    return c3.fit(log_edges(spark, folder), Workspace(spark, "c3"))


@R.add("d01_domain", _BOTH + "SELECT * FROM edges")
def d01_domain(spark, folder):
    return edges(spark, folder)


@R.add("d04_margins", _BOTH + f"""
  SELECT study_id, 'gene' AS axis, gene_id AS id, {sig("sum(y)")} AS total, count(*) AS n_edges FROM edges GROUP BY 1, 2, 3
  UNION ALL SELECT study_id, 'branch', branch_id, {sig("sum(y)")}, count(*) FROM edges GROUP BY 1, 2, 3
  UNION ALL SELECT study_id, 'study', NULL, {sig("sum(y)")}, count(*) FROM edges GROUP BY 1""")
def d04_margins(spark, folder):
    return c3.margins(edges(spark, folder)).withColumn("total", digits("total"))


@R.add("d03_components", _BOTH.replace("WITH ", "WITH RECURSIVE ") .rstrip() + """, reach AS (
    SELECT DISTINCT study_id, gene_id AS root, gene_id AS g FROM edges WHERE y > 0
    UNION SELECT r.study_id, r.root, c.gene_id FROM reach r JOIN edges b ON b.study_id = r.study_id AND b.gene_id = r.g AND b.y > 0 JOIN edges c ON c.study_id = b.study_id AND c.branch_id = b.branch_id AND c.y > 0),
  low AS (SELECT study_id, g, min(root) AS component FROM reach GROUP BY 1, 2)
  SELECT study_id, 'gene' AS axis, g AS id, component FROM low
  UNION ALL SELECT e.study_id, 'branch', e.branch_id, min(l.component) FROM edges e JOIN low l ON l.study_id = e.study_id AND l.g = e.gene_id WHERE e.y > 0 GROUP BY 1, 2, 3""")
def d03_components(spark, folder):
    return c3.vertex_components(edges(spark, folder).where("y > 0"), Workspace(spark, "d03"))


@R.add("d08_support_certificate")
def d08_support_certificate(spark, folder):
    """Support states, sweeps, margin errors, objective and sign checks of every study's fit, each solved twice."""
    return c3.certificates(c3.fit(edges(spark, folder), Workspace(spark, "c3"), c3.C3Control(replay=True)))


# Components of all edges, mass, blocks of positive edges, and whether a way leads back from the end of a zero edge to its start.
_SUPPORT = """WITH RECURSIVE """ + ", ".join((CELLS, _EDGES)) + """,
  w AS (SELECT DISTINCT study_id, gene_id AS root, gene_id AS g FROM edges UNION SELECT w.study_id, w.root, c.gene_id FROM w JOIN edges b ON b.study_id = w.study_id AND b.gene_id = w.g JOIN edges c ON c.study_id = b.study_id AND c.branch_id = b.branch_id),
  whole AS (SELECT study_id, g AS gene_id, min(root) AS component FROM w GROUP BY 1, 2),
  r AS (SELECT study_id, gene_id, sum(y) AS r FROM edges GROUP BY 1, 2), c AS (SELECT study_id, branch_id, sum(y) AS c FROM edges GROUP BY 1, 2),
  mass AS (SELECT study_id, component, sum(r) AS mass FROM r JOIN whole USING (study_id, gene_id) GROUP BY 1, 2),
  m AS (SELECT e.*, CASE WHEN mass = 0 THEN 'ZERO_TOTAL_COMPONENT' WHEN r = 0 OR c = 0 THEN 'ZERO_MARGIN_BOUNDARY' END AS state FROM edges e JOIN r USING (study_id, gene_id) JOIN c USING (study_id, branch_id) JOIN whole USING (study_id, gene_id) JOIN mass USING (study_id, component)),
  p AS (SELECT study_id, gene_id, branch_id FROM m WHERE state IS NULL AND y > 0),
  q AS (SELECT DISTINCT study_id, gene_id AS root, gene_id AS g FROM p UNION SELECT q.study_id, q.root, c.gene_id FROM q JOIN p b ON b.study_id = q.study_id AND b.gene_id = q.g JOIN p c ON c.study_id = b.study_id AND c.branch_id = b.branch_id),
  bg AS (SELECT study_id, g AS gene_id, min(root) AS block FROM q GROUP BY 1, 2), bb AS (SELECT p.study_id, p.branch_id, min(block) AS block FROM p JOIN bg USING (study_id, gene_id) GROUP BY 1, 2),
  z AS (SELECT m.study_id, m.gene_id, m.branch_id, bg.block AS o, bb.block AS i FROM m JOIN bg ON bg.study_id = m.study_id AND bg.gene_id = m.gene_id JOIN bb ON bb.study_id = m.study_id AND bb.branch_id = m.branch_id WHERE m.state IS NULL AND m.y = 0 AND bg.block <> bb.block),
  way AS (SELECT DISTINCT study_id, o, i FROM z UNION SELECT w.study_id, w.o, z.i FROM way w JOIN z ON z.study_id = w.study_id AND z.o = w.i),
  face AS (SELECT study_id, gene_id, branch_id FROM z WHERE NOT EXISTS (SELECT 1 FROM way w WHERE w.study_id = z.study_id AND w.o = z.i AND w.i = z.o)),
  s AS (SELECT m.study_id, m.gene_id, m.branch_id, coalesce(m.state, CASE WHEN f.gene_id IS NOT NULL THEN 'FACIAL_BOUNDARY' ELSE 'FINITE_INTERIOR' END) AS support_state FROM m LEFT JOIN face f USING (study_id, gene_id, branch_id)) """


@R.add("d08_support_states", _SUPPORT + "SELECT study_id, gene_id, branch_id, support_state FROM s")
def d08_support_states(spark, folder):
    """Where every admitted cell of the raw payload stands: on the support of the fit, or off it and why."""
    return fitted(spark, folder).select("study_id", "gene_id", "branch_id", "support_state")


@R.add("d07_dual_exposer", _SUPPORT + "SELECT study_id, gene_id, branch_id, true AS exposed FROM face")
def d07_dual_exposer(spark, folder):
    """The forced edges, and whether the integer dual coefficient is above 0 there (it is 0 on the face; see the certificate)."""
    return fitted(spark, folder).where("support_state = 'FACIAL_BOUNDARY' OR dual <> 0").select("study_id", "gene_id", "branch_id", (F.col("dual") > 0).alias("exposed"))


@R.add("d05_component_margins", "WITH RECURSIVE " + ", ".join((CELLS, _EDGES)) + f""", w AS (SELECT DISTINCT study_id, gene_id AS root, gene_id AS g FROM edges UNION SELECT w.study_id, w.root, c.gene_id FROM w JOIN edges b ON b.study_id = w.study_id AND b.gene_id = w.g JOIN edges c ON c.study_id = b.study_id AND c.branch_id = b.branch_id),
  whole AS (SELECT study_id, g AS gene_id, min(root) AS component FROM w GROUP BY 1, 2),
  g AS (SELECT study_id, gene_id, component, sum(y) AS m, count(*) AS n FROM edges JOIN whole USING (study_id, gene_id) GROUP BY 1, 2, 3),
  b AS (SELECT study_id, component, sum(m) AS mb FROM (SELECT study_id, component, branch_id, sum(y) AS m FROM edges JOIN whole USING (study_id, gene_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT study_id, component, n AS edge_count, {sig("t")} AS total, low >= 0 AS nonnegative, abs(t - mb) <= 64 * 2.220446049250313e-16 * greatest(1, abs(t)) * greatest(1, ceil(log2(n))) AS pass FROM (SELECT study_id, component, sum(n)::BIGINT AS n, sum(m) AS t, min(m) AS low FROM g GROUP BY 1, 2) JOIN b USING (study_id, component)""")
def d05_component_margins(spark, folder):
    return c3.component_margins(edges(spark, folder), Workspace(spark, "d05")).withColumn("total", digits("total"))


@R.add("d08_unsupported", _BOTH + """
  SELECT study_id, 'gene' AS vertex_type, gene_id AS vertex_id, 'UNSUPPORTED_VERTEX' AS state FROM (SELECT DISTINCT study_id, gene_id FROM cells) a WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.study_id = a.study_id AND e.gene_id = a.gene_id)
  UNION ALL SELECT study_id, 'branch', branch_id, 'UNSUPPORTED_VERTEX' FROM (SELECT DISTINCT study_id, branch_id FROM cells) a WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.study_id = a.study_id AND e.branch_id = a.branch_id)""")
def d08_unsupported(spark, folder):
    return c3.unsupported(matrix(spark, folder), edges(spark, folder))


def _unrolled(sweeps: int) -> str:
    parts = [CELLS, _LOG_EDGES,
        "m AS MATERIALIZED (SELECT * FROM edges JOIN (SELECT study_id, gene_id, sum(y) AS r FROM edges GROUP BY 1, 2) USING (study_id, gene_id) JOIN (SELECT study_id, branch_id, sum(y) AS c FROM edges GROUP BY 1, 2) USING (study_id, branch_id) WHERE r > 0 AND c > 0)",
        "b0 AS MATERIALIZED (SELECT DISTINCT study_id, branch_id, 1.0::DOUBLE AS b FROM m)"]
    for k in range(1, sweeps + 1):
        parts += [f"g{k} AS MATERIALIZED (SELECT study_id, gene_id, max(r) / sum(b) AS g FROM m JOIN b{k - 1} USING (study_id, branch_id) GROUP BY 1, 2)",
            f"b{k} AS MATERIALIZED (SELECT study_id, branch_id, max(c) / sum(g) AS b FROM m JOIN g{k} USING (study_id, gene_id) GROUP BY 1, 2)"]
    return with_(*parts) + f"SELECT e.study_id, e.gene_id, e.branch_id, {sig('coalesce(g * b, 0)', 5)} AS mu FROM edges e LEFT JOIN g{sweeps} USING (study_id, gene_id) LEFT JOIN b{sweeps} USING (study_id, branch_id)"


@R.add("d09_c3_fit")
def d09_c3_fit(spark, folder):
    """Fitted values of the raw payload (compared with scaling by hand in tests; its identities are d12)."""
    return fitted(spark, folder)


@R.add("d09_c3_fit_log", _unrolled(32))
def d09_c3_fit_log(spark, folder):
    """The solver on the log payload, for which 32 sweeps suffice in SQL."""
    return log_fitted(spark, folder).select("study_id", "gene_id", "branch_id", digits("mu", 5).alias("mu"))


@R.add("d12_identities", _BOTH + "SELECT study_id, true AS gene_residuals_vanish, true AS branch_residuals_vanish, true AS ratio_means_are_one FROM edges GROUP BY 1")
def d12_identities(spark, folder):
    """What every fit of the raw payload must satisfy: residuals sum to 0 per gene and branch, fitted-weighted mean ratios are 1.

    A study that is not certified has no fitted value that could break them.
    """
    f = kept_fit(spark, folder)
    top = f.groupBy("study_id").agg((1e-11 * F.greatest(F.lit(1.0), F.max("y"))).alias("slack"))
    parts = []
    for c in ("gene_id", "branch_id"):
        a = f.groupBy("study_id", c).agg(F.sum(F.col("y") - F.col("mu")).alias("d"), F.sum("mu").alias("m")).join(top, "study_id")
        off = F.abs("d") / (1e-9 * F.col("m") + F.col("slack"))  # the fit stops at 1e-10 of a margin and 1e-12 of the mean cell
        ratio = F.when(F.col("m") > 1e6 * F.col("slack"), F.abs(F.col("d") / F.col("m")))  # weighted mean of y / mu, less 1
        parts.append(a.groupBy("study_id").agg(F.coalesce(F.max(off) <= 1, F.lit(True)).alias(c), F.coalesce(F.max(ratio) <= 1e-6, F.lit(True)).alias(f"ok_{c}")))
    both = parts[0].join(parts[1], "study_id")
    return both.select("study_id", F.col("gene_id").alias("gene_residuals_vanish"), F.col("branch_id").alias("branch_residuals_vanish"), (F.col("ok_gene_id") & F.col("ok_branch_id")).alias("ratio_means_are_one"))


@R.add("e03_c2_effects")
def e03_c2_effects(spark, folder):
    """Log effects of genes and branches on positive cells."""
    return c2.effects(edges(spark, folder))


@R.add("e04_c2_evaluation")
def e04_c2_evaluation(spark, folder):
    e = edges(spark, folder)
    return c2.evaluate(e, c2.effects(e))


@R.add("e05_c3_c2_compare")
def e05_c3_c2_compare(spark, folder):
    """Agreement of the two baselines' ratios of the raw payload on their common positive cells."""
    e = edges(spark, folder)
    a = kept_fit(spark, folder).where("y > 0").select("study_id", "gene_id", "branch_id", F.try_divide("y", "mu").alias("rate"), F.col("mu").isNotNull().alias("available"))
    b = c2.evaluate(e, c2.effects(e)).where("y > 0").select("study_id", "gene_id", "branch_id", F.try_divide("y", "mu").alias("rate"), F.col("mu").isNotNull().alias("available"))
    return rates.compare_pair(a, b)


# A baseline with a closed form: row sum times column sum over the total.  Rates on it have SQL.  It is the fit of
# complete tables only: the queries named ..._c3 below give the same on the fit itself.
_CLOSED = """fit AS (
  SELECT e.*, CASE WHEN t > 0 THEN r * c / t END AS mu, CASE WHEN r = 0 OR c = 0 THEN 'ZERO_MARGIN_BOUNDARY' ELSE 'FINITE_INTERIOR' END AS support_state FROM edges e JOIN (SELECT study_id, gene_id, sum(y) AS r FROM edges GROUP BY 1, 2) USING (study_id, gene_id)
    JOIN (SELECT study_id, branch_id, sum(y) AS c FROM edges GROUP BY 1, 2) USING (study_id, branch_id) JOIN (SELECT study_id, sum(y) AS t FROM edges GROUP BY 1) USING (study_id))"""


def closed_form(spark, folder):
    """mu = r c / T, the fit of a complete table, here taken for all tables."""
    e = edges(spark, folder)
    r = e.groupBy("study_id", "gene_id").agg(F.sum("y").alias("r"))
    c = e.groupBy("study_id", "branch_id").agg(F.sum("y").alias("c"))
    t = e.groupBy("study_id").agg(F.sum("y").alias("t"))
    rows = e.join(r, ["study_id", "gene_id"]).join(c, ["study_id", "branch_id"]).join(t, "study_id")
    state = F.when((F.col("r") == 0) | (F.col("c") == 0), "ZERO_MARGIN_BOUNDARY").otherwise("FINITE_INTERIOR")
    return rows.select("study_id", "gene_id", "branch_id", "y", F.try_divide(F.col("r") * F.col("c"), F.col("t")).alias("mu"), state.alias("support_state"))


def _rate_sql(value: str, ok: str) -> str:
    return with_(CELLS, _EDGES, _CLOSED) + f"""
      SELECT c.study_id, c.gene_id, c.branch_id, {sig(f"CASE WHEN {ok} THEN {value} END", 6)} AS rate, coalesce({ok}, false) AS available,
        CASE WHEN {ok} THEN 'available' WHEN mu = 0 THEN 'baseline_zero' WHEN y IS NOT NULL THEN 'input_zero_log_undefined' WHEN coord_state <> 'observed' THEN 'coordinate_unavailable' ELSE 'measurement_unresolved' END AS reason,
        coalesce(support_state, 'BASELINE_UNAVAILABLE') AS support FROM cells c LEFT JOIN fit USING (study_id, gene_id, branch_id)"""


def _rate(spark, folder, method, fit=closed_form):
    out = rates.rate(matrix(spark, folder), fit(spark, folder), method)
    return out.select("study_id", "gene_id", "branch_id", digits("rate", 6).alias("rate"), "available", "reason", "support")


@R.add("b02_ratio_contract", with_(CELLS, _EDGES, _CLOSED) + "SELECT study_id, count(*) FILTER (WHERE y > 0 AND mu = 0) AS fatal, count(*) FILTER (WHERE mu = 0) AS baseline_zero, count(*) FILTER (WHERE mu > 0) AS ratio_available FROM fit GROUP BY 1")
def b02_ratio_contract(spark, folder):
    return rates.ratio_contract(closed_form(spark, folder))


@R.add("b03_rate_gbi", _rate_sql("y / mu", "mu > 0"))
def b03_rate_gbi(spark, folder):
    return _rate(spark, folder, "GBI")


@R.add("b03_rate_log_strict", _rate_sql("ln(y / mu)", "(mu > 0 AND y > 0)"))
def b03_rate_log_strict(spark, folder):
    return _rate(spark, folder, "logGBI_strict")


@R.add("b03_rate_add", with_(CELLS, _EDGES, _CLOSED) + """
  SELECT c.study_id, reason, count(*) AS n FROM (SELECT c.study_id, CASE WHEN mu IS NOT NULL THEN 'available' WHEN coord_state <> 'observed' THEN 'coordinate_unavailable' ELSE 'measurement_unresolved' END AS reason FROM cells c LEFT JOIN fit USING (study_id, gene_id, branch_id)) c GROUP BY 1, 2""")
def b03_rate_add(spark, folder):
    """Reasons of the additive rate; its values cancel, so they are compared in tests."""
    return rates.rate(matrix(spark, folder), closed_form(spark, folder), "ADD_LT").groupBy("study_id", "reason").agg(F.count(F.lit(1)).alias("n"))


_BOUNDARY = """boundary AS (
  SELECT c.study_id, c.gene_id, c.branch_id, CASE WHEN y > 0 AND mu > 0 THEN 'POSITIVE' WHEN y = 0 AND mu > 0 THEN 'EXACT_ZERO_BOUNDARY' ELSE 'UNAVAILABLE' END AS ratio_state,
    CASE WHEN y > 0 AND mu > 0 THEN ln(y / mu) END AS positive_log FROM cells c LEFT JOIN fit USING (study_id, gene_id, branch_id))"""


def boundary_cells(spark, folder, fit=closed_form):
    return rates.log_relative(rates.rate(matrix(spark, folder), fit(spark, folder), "GBI"))


@R.add("b05_log_relative", with_(CELLS, _EDGES, _CLOSED, _BOUNDARY) + f"SELECT study_id, gene_id, branch_id, ratio_state, {sig('positive_log', 6)} AS positive_log FROM boundary")
def b05_log_relative(spark, folder):
    return boundary_cells(spark, folder).select("study_id", "gene_id", "branch_id", "ratio_state", digits("positive_log", 6).alias("positive_log"))


@R.add("b10_encoded", with_(CELLS, _EDGES, _CLOSED, _BOUNDARY) + f"""
  SELECT study_id, gene_id, branch_id, {sig("CASE WHEN ratio_state = 'POSITIVE' THEN positive_log WHEN ratio_state = 'EXACT_ZERO_BOUNDARY' THEN low - 10 END", 6)} AS encoded, ratio_state = 'EXACT_ZERO_BOUNDARY' AND low IS NOT NULL AS zero_encoded
  FROM boundary JOIN (SELECT study_id, min(positive_log) AS low FROM boundary GROUP BY 1) USING (study_id)""")
def b10_encoded(spark, folder):
    return rates.encoded(boundary_cells(spark, folder)).select("study_id", "gene_id", "branch_id", digits("encoded", 6).alias("encoded"), "zero_encoded")


@R.add("f04_common_domain", with_(CELLS, _EDGES, _CLOSED) + """
  SELECT study_id, count(*) FILTER (WHERE mu > 0 AND y > 0) AS n_common, count(*) FILTER (WHERE mu > 0) AS n_union,
    CASE WHEN count(*) FILTER (WHERE mu > 0) > 0 THEN (count(*) FILTER (WHERE mu > 0) - count(*) FILTER (WHERE mu > 0 AND y > 0))::DOUBLE / count(*) FILTER (WHERE mu > 0) END AS loss,
    CASE WHEN count(*) FILTER (WHERE mu > 0) = count(*) FILTER (WHERE mu > 0 AND y > 0) THEN 'EQUAL' ELSE 'UNEQUAL' END AS label
  FROM cells LEFT JOIN fit USING (study_id, gene_id, branch_id) GROUP BY 1""")
def f04_common_domain(spark, folder):
    m, f = matrix(spark, folder), closed_form(spark, folder)
    return rates.common_domain({"GBI": rates.rate(m, f, "GBI"), "logGBI_strict": rates.rate(m, f, "logGBI_strict")})


@R.add("f05_compare_pair", with_(CELLS, _EDGES, _CLOSED, TRIM, GBI, f"""pairs AS (
    SELECT study_id, y / mu AS a, gbi AS b FROM fit JOIN rates USING (study_id, gene_id, branch_id) WHERE mu > 0 AND gbi IS NOT NULL)""") + f"""
  SELECT study_id, count(*) AS n, {sig("CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END", 6)} AS spearman, {sig("median(abs(b - a))", 6)} AS median_abs_difference, {sig("max(abs(b - a))", 6)} AS max_abs_difference,
    {", ".join(sig(f"quantile_cont(b - a, {q})", 5) + f" AS difference_{n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")))},
    count(*) FILTER (WHERE a > 0 AND b > 0) AS positive_ratio_count, {", ".join(sig(f"round(quantile_cont(CASE WHEN a > 0 AND b > 0 THEN ln(b / a) END, {q}), 6)", 5) + f" AS {n}" for q, n in ((0.05, "log_ratio_q05"), (0.5, "median_log_ratio"), (0.95, "log_ratio_q95")))}
  FROM (SELECT *, rank() OVER (PARTITION BY study_id ORDER BY a) + (count(*) OVER (PARTITION BY study_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY study_id ORDER BY b) + (count(*) OVER (PARTITION BY study_id, b) - 1) / 2.0 AS rb
    FROM (SELECT study_id, {sig("a", 9)} AS a, {sig("b", 9)} AS b FROM pairs)) GROUP BY 1""")
def f05_compare_pair(spark, folder):
    """The study ratio less the closed-form ratio, values to nine digits so that ties agree."""
    return _compare_pair(spark, folder, closed_form)


def _compare_pair(spark, folder, fit):
    a = rates.rate(matrix(spark, folder), fit(spark, folder), "GBI").withColumn("rate", digits("rate", 9))
    b = study_rates(spark, folder).select("study_id", "gene_id", "branch_id", digits("gbi", 9).alias("rate"), F.col("gbi").isNotNull().alias("available"))
    out = rates.compare_pair(a, b, positive_ratio=True)
    names = ("spearman", "median_abs_difference", "max_abs_difference")
    return out.select("study_id", "n", *[digits(c, 6).alias(c) for c in names], *[digits(f"difference_{q}", 5).alias(f"difference_{q}") for q in ("q05", "q25", "q50", "q75", "q95")], "positive_ratio_count", *[digits(F.round(c, 6), 5).alias(c) for c in ("log_ratio_q05", "median_log_ratio", "log_ratio_q95")])


# The rate that is associated in the queries with SQL: the logarithm of the study ratio where it is positive.
_ASSOC = """assoc AS (
  SELECT r.study_id, r.gene_id, r.branch_id, CASE WHEN gbi > 0 THEN ln(gbi) END AS rate, s.state, CASE WHEN gbi IS NULL OR gbi <= 0 THEN 'rate_unavailable' WHEN s.state IS NULL OR s.state = 0.5 THEN 'trait_unavailable' ELSE 'eligible' END AS reason
  FROM rates r LEFT JOIN states s USING (study_id, branch_id))"""
_LOG_RATES = (CELLS, TRIM, GBI)


def assoc_cells(spark, folder):
    """The logarithm of the study ratio of every cell with its branch's state."""
    r = study_rates(spark, folder).withColumn("available", F.coalesce(F.col("gbi") > 0, F.lit(False))).withColumn("rate", F.ln(F.when(F.col("gbi") > 0, F.col("gbi"))))
    return association.domain(r.select("study_id", "gene_id", "branch_id", "rate", "available"), traits.branch_states(matrix(spark, folder), states(spark, folder)))


def c3_cells(spark, folder, method="logGBI_strict", fit=None):
    """A rate on the additive-margin fit with the states of the branches."""
    r = rates.rate(matrix(spark, folder), fit if fit is not None else fitted(spark, folder), method)
    return association.domain(r.select("study_id", "gene_id", "branch_id", "rate", "available"), traits.branch_states(matrix(spark, folder), states(spark, folder)))


@R.add("f01_association_domain", with_(*_LOG_RATES, STATES, _ASSOC) + "SELECT study_id, reason, count(*) AS n FROM assoc GROUP BY 1, 2")
def f01_association_domain(spark, folder):
    return association.domain_counts(assoc_cells(spark, folder))


_BINARY = f"""bin AS (
  SELECT *, CASE WHEN status = 'ESTIMABLE' THEN f - r END AS difference, CASE WHEN status = 'ESTIMABLE' AND sd > 0 THEN (f - r) * sx / sd END AS pb FROM (
    SELECT *, CASE WHEN n = 0 THEN 'NO_ELIGIBLE_BRANCHES' WHEN n_reference = 0 THEN 'BINARY_REFERENCE_ABSENT' WHEN n_focal = 0 THEN 'BINARY_FOCAL_ABSENT' WHEN n < 3 THEN 'INSUFFICIENT_BRANCHES' ELSE 'ESTIMABLE' END AS status FROM (
      SELECT study_id, gene_id, count(*) FILTER (WHERE reason = 'eligible') AS n, count(*) FILTER (WHERE reason = 'eligible' AND state = 0) AS n_reference, count(*) FILTER (WHERE reason = 'eligible' AND state = 1) AS n_focal,
        avg(rate) FILTER (WHERE reason = 'eligible' AND state = 1) AS f, avg(rate) FILTER (WHERE reason = 'eligible' AND state = 0) AS r, stddev_pop(rate) FILTER (WHERE reason = 'eligible') AS sd, stddev_pop(state) FILTER (WHERE reason = 'eligible') AS sx
      FROM assoc GROUP BY 1, 2)))"""


@R.add("j06_binary_association", with_(*_LOG_RATES, STATES, _ASSOC, _BINARY) + f"SELECT study_id, gene_id, n, n_reference, n_focal, status, {sig('difference', 6)} AS difference, {sig('pb', 6)} AS r FROM bin")
def j06_binary_association(spark, folder):
    return association.binary(assoc_cells(spark, folder)).select("study_id", "gene_id", "n", "n_reference", "n_focal", "status", digits("difference", 6).alias("difference"), digits("r", 6).alias("r"))


@R.add("j07_continuous_association", with_(*_LOG_RATES, STATES, _ASSOC) + f"""
  SELECT study_id, gene_id, n, {sig("CASE WHEN n >= 3 AND vx > 0 THEN cxy / vx END", 6)} AS slope, {sig("round(CASE WHEN n >= 3 AND vrx > 0 AND vry > 0 THEN crxy / (sqrt(vrx) * sqrt(vry)) END, 9)", 6)} AS spearman FROM (
    SELECT study_id, gene_id, count(*) AS n, var_pop(x) AS vx, covar_pop(x, y) AS cxy, var_pop(rx) AS vrx, var_pop(ry) AS vry, covar_pop(rx, ry) AS crxy FROM (
      SELECT *, rank() OVER (PARTITION BY study_id, gene_id ORDER BY x) + (count(*) OVER (PARTITION BY study_id, gene_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY study_id, gene_id ORDER BY y) + (count(*) OVER (PARTITION BY study_id, gene_id, y) - 1) / 2.0 AS ry
      FROM (SELECT study_id, gene_id, length(branch_id)::DOUBLE + state AS x, {sig("rate", 9)} AS y FROM assoc WHERE reason = 'eligible')) GROUP BY 1, 2)""")
def j07_continuous_association(spark, folder):
    """Against a graded predictor of the branch (length of its label plus its state)."""
    rows = assoc_cells(spark, folder).withColumn("x", F.length("branch_id") + F.col("state")).withColumn("rate", digits("rate", 9))
    return association.continuous(rows, "x").select("study_id", "gene_id", "n", digits("slope", 6).alias("slope"), digits(F.round("spearman", 9), 6).alias("spearman"))


@R.add("j08_boundary_association", with_(CELLS, _EDGES, _CLOSED, _BOUNDARY, STATES) + f"""
  SELECT study_id, gene_id, 'ZERO_MASS' AS component, count(z) FILTER (WHERE state = 0) AS n_reference, count(z) FILTER (WHERE state = 1) AS n_focal, {sig("avg(z) FILTER (WHERE state = 1) - avg(z) FILTER (WHERE state = 0)", 6)} AS statistic
  FROM (SELECT b.*, state, CASE ratio_state WHEN 'EXACT_ZERO_BOUNDARY' THEN 1.0 WHEN 'POSITIVE' THEN 0.0 END AS z FROM boundary b LEFT JOIN (SELECT * FROM states WHERE state IN (0, 1)) USING (study_id, branch_id)) GROUP BY 1, 2
  UNION ALL SELECT study_id, gene_id, 'POSITIVE_LOG', count(positive_log) FILTER (WHERE state = 0), count(positive_log) FILTER (WHERE state = 1), {sig("avg(positive_log) FILTER (WHERE state = 1) - avg(positive_log) FILTER (WHERE state = 0)", 6)}
  FROM boundary b LEFT JOIN (SELECT * FROM states WHERE state IN (0, 1)) USING (study_id, branch_id) GROUP BY 1, 2""")
def j08_boundary_association(spark, folder):
    return _boundary_association(spark, folder, closed_form)


def _boundary_association(spark, folder, fit):
    b = boundary_cells(spark, folder, fit).withColumn("available", F.col("ratio_state") != "UNAVAILABLE")
    rows = association.domain(b, traits.branch_states(matrix(spark, folder), states(spark, folder)))
    return association.boundary(rows).withColumn("statistic", digits("statistic", 6))


@R.add("b02_ratio_contract_c3")
def b02_ratio_contract_c3(spark, folder):
    return rates.ratio_contract(fitted(spark, folder))


@R.add("b03_rate_gbi_c3")
def b03_rate_gbi_c3(spark, folder):
    """y / mu on the additive-margin fit of the raw payload, with the fit's support states."""
    return _rate(spark, folder, "GBI", fitted)


@R.add("b03_rate_log_strict_c3")
def b03_rate_log_strict_c3(spark, folder):
    return _rate(spark, folder, "logGBI_strict", fitted)


@R.add("b03_rate_add_c3")
def b03_rate_add_c3(spark, folder):
    return rates.rate(matrix(spark, folder), fitted(spark, folder), "ADD_LT").select("study_id", "gene_id", "branch_id", "rate", "available", "reason", "support")


@R.add("b05_log_relative_c3")
def b05_log_relative_c3(spark, folder):
    return boundary_cells(spark, folder, fitted)


@R.add("b10_encoded_c3")
def b10_encoded_c3(spark, folder):
    return rates.encoded(boundary_cells(spark, folder, kept_fit)).select("study_id", "gene_id", "branch_id", "encoded", "zero_encoded")


@R.add("f04_common_domain_c3")
def f04_common_domain_c3(spark, folder):
    m, f = matrix(spark, folder), kept_fit(spark, folder)
    return rates.common_domain({"GBI": rates.rate(m, f, "GBI"), "logGBI_strict": rates.rate(m, f, "logGBI_strict")})


@R.add("f05_compare_pair_c3")
def f05_compare_pair_c3(spark, folder):
    """The fitted ratio against the study ratio."""
    return _compare_pair(spark, folder, fitted)


@R.add("j08_boundary_association_c3")
def j08_boundary_association_c3(spark, folder):
    return _boundary_association(spark, folder, fitted)


@R.add("f01_association_domain_c3")
def f01_association_domain_c3(spark, folder):
    return association.domain_counts(c3_cells(spark, folder))


@R.add("j06_binary_association_c3")
def j06_binary_association_c3(spark, folder):
    return association.binary(c3_cells(spark, folder))


@R.add("j07_continuous_association_c3")
def j07_continuous_association_c3(spark, folder):
    return association.continuous(c3_cells(spark, folder).withColumn("x", F.length("branch_id") + F.col("state")), "x")


@R.add("f02_common_association_domain", with_(*_LOG_RATES, STATES, _ASSOC) + """
  SELECT a.study_id, count(*) FILTER (WHERE reason = 'eligible') AS n_first, count(*) FILTER (WHERE value > 0 AND state IN (0, 1)) AS n_second, count(*) FILTER (WHERE reason = 'eligible' AND value > 0) AS n_common
  FROM assoc a JOIN cells c USING (study_id, gene_id, branch_id) GROUP BY 1""")
def f02_common_association_domain(spark, folder):
    """Cells eligible for the study ratio, for the raw positive payload, and for both."""
    first = assoc_cells(spark, folder)
    raw = matrix(spark, folder).withColumn("available", F.coalesce(F.col("value") > 0, F.lit(False))).withColumn("rate", F.col("value"))
    second = association.domain(raw.select("study_id", "gene_id", "branch_id", "rate", "available"), traits.branch_states(matrix(spark, folder), states(spark, folder)))
    n = lambda d, name: d.groupBy("study_id").agg(F.count_if("eligible").cast("bigint").alias(name))
    return n(first, "n_first").join(n(second, "n_second"), "study_id").join(n(association.common([first, second]), "n_common"), "study_id")


@R.add("f03_compatible_axes", with_(CELLS, _EDGES, _CLOSED) + "SELECT study_id, count(*) AS n_cells, true AS same_cells, true AS same_states, true AS same_baseline FROM cells GROUP BY 1")
def f03_compatible_axes(spark, folder):
    """The gate before rates are compared: the same cells, coordinate states and baseline on both sides."""
    m, f = matrix(spark, folder), closed_form(spark, folder)
    of = lambda method: rates.rate(m, f, method).join(f.select("study_id", "gene_id", "branch_id", "mu"), ["study_id", "gene_id", "branch_id"], "left").join(m.select("study_id", "gene_id", "branch_id", "coord_state"), ["study_id", "gene_id", "branch_id"])
    return rates.compatible(of("GBI"), of("logGBI_strict"))


# As many worlds as the reference: permutations of a study's labels by a portable key.
_WORLDS = 200
_PERMUTED = lambda stream: "((kb * kb + replicate * 17 + place) % 1000003)".replace("kb", f"((ka * ka + place * 31 + {stream}) % 1000003)").replace("ka", f"((place * 7919 + replicate * 104729 + {stream} * 15485863) % 1000003)")
_ONLY_WORLDS = f"""own AS (SELECT study_id, branch_id, state, row_number() OVER (PARTITION BY study_id ORDER BY branch_id) AS place, sum(state) OVER (PARTITION BY study_id) AS k, count(*) OVER (PARTITION BY study_id) AS m FROM states WHERE state IN (0, 1) AND (study_id, branch_id) IN (SELECT study_id, branch_id FROM cells)),
worlds AS (SELECT study_id, replicate, branch_id, CASE WHEN pos <= k THEN 1.0::DOUBLE ELSE 0.0 END AS state FROM (SELECT *, row_number() OVER (PARTITION BY study_id, replicate ORDER BY {_PERMUTED(3)}, place) AS pos FROM own CROSS JOIN range(1, {_WORLDS + 1}) t(replicate))),
ways AS (SELECT study_id, coalesce(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)), 1) AS n_labellings FROM (SELECT DISTINCT study_id, m, k FROM own))"""
_STATUS = f"CASE WHEN status <> 'ESTIMABLE' THEN 'OBSERVED_ASSOCIATION_NONESTIMABLE' WHEN coalesce(n_null, 0) < {_WORLDS} THEN 'NULL_CALIBRATION_INCOMPLETE' WHEN round(n_labellings) <= {_WORLDS} THEN 'TOO_FEW_LABELLINGS' ELSE 'CALIBRATED' END"
_NULLS = _ONLY_WORLDS + f""",
nulls AS (SELECT *, CASE WHEN n1 > 0 AND n1 < n THEN s1 / n1 - (s - s1) / (n - n1) END AS score FROM (
  SELECT study_id, gene_id, replicate, count(*) AS n, count(*) FILTER (WHERE w.state = 1) AS n1, sum(rate) AS s, coalesce(sum(rate) FILTER (WHERE w.state = 1), 0) AS s1
  FROM (SELECT * FROM assoc WHERE reason = 'eligible') a JOIN worlds w USING (study_id, branch_id) GROUP BY 1, 2, 3)),
cal AS (SELECT b.study_id, b.gene_id, {_STATUS} AS status, coalesce(n_null, 0) AS n_null, exceed
  FROM bin b LEFT JOIN ways USING (study_id) LEFT JOIN (SELECT n.study_id, n.gene_id, count(score) AS n_null, count(*) FILTER (WHERE abs(score) >= abs(difference) - 1e-10 * greatest(1, abs(difference))) AS exceed FROM nulls n JOIN bin USING (study_id, gene_id) GROUP BY 1, 2) USING (study_id, gene_id))"""
_NULL_SQL = with_(*_LOG_RATES, STATES, _ASSOC, _BINARY, _NULLS)


def labelled(spark, folder):
    """The labelled terminal branches that the matrices have."""
    return states(spark, folder).join(matrix(spark, folder).select("study_id", "branch_id").distinct(), ["study_id", "branch_id"], "left_semi")


def _null_parts(spark, folder, rows_of=assoc_cells, statistic="beta"):
    """Null scores, written once, and the calibration that stands on them."""
    work = Workspace(spark, "k")
    rows, own = work.save(rows_of(spark, folder), "cells"), work.save(labelled(spark, folder), "own")
    nulls = work.save(association.null_scores(rows, association.permuted_worlds(own, _WORLDS), statistic=statistic), "nulls")
    observed = association.binary(rows)
    calibrated = association.calibrate(observed, nulls, _WORLDS, statistic="difference" if statistic == "beta" else "r")
    return nulls, association.mark_few(calibrated, association.labellings(own), _WORLDS)


@R.add("k02_null_scores", _NULL_SQL + f"SELECT study_id, gene_id, replicate, {sig('round(score, 9)', 6)} AS score FROM nulls")
def k02_null_scores(spark, folder):
    return _null_parts(spark, folder)[0].select("study_id", "gene_id", "replicate", digits(F.round("score", 9), 6).alias("score"))


@R.add("k03_calibrate", _NULL_SQL + f"""
  SELECT study_id, gene_id, status, n_null, CASE WHEN status IN ('CALIBRATED', 'TOO_FEW_LABELLINGS') THEN exceed END AS exceedances, CASE WHEN status = 'CALIBRATED' THEN (exceed + 1) / {_WORLDS + 1}.0::DOUBLE END AS p FROM cal""")
def k03_calibrate(spark, folder):
    return _null_parts(spark, folder)[1].select("study_id", "gene_id", "status", "n_null", "exceedances", "p")


@R.add("k03_replicate_status", _NULL_SQL + """
  SELECT study_id, replicate, n AS nonestimable_gene_count, CASE WHEN n = 0 THEN 'ESTIMABLE_FOR_ALL_ACTIVE_GENES' ELSE 'NULL_REPLICATE_NONESTIMABLE' END AS status FROM (
    SELECT study_id, replicate, count(*) FILTER (WHERE score IS NULL) AS n FROM nulls JOIN cal USING (study_id, gene_id) WHERE status IN ('CALIBRATED', 'TOO_FEW_LABELLINGS', 'NULL_CALIBRATION_INCOMPLETE') GROUP BY 1, 2)""")
def k03_replicate_status(spark, folder):
    """Per world, the genes that it leaves without a score."""
    nulls, calibrated = _null_parts(spark, folder)
    return association.replicate_status(nulls, calibrated.replace({"TOO_FEW_LABELLINGS": "CALIBRATED"}, subset=["status"]))


@R.add("k04_joint_maximum", _NULL_SQL + f"""
  SELECT study_id, replicate, {sig("max(abs(round(score, 9)))", 6)} AS max_abs, count(score) AS n_genes FROM nulls WHERE (study_id, gene_id) IN (SELECT study_id, gene_id FROM cal WHERE status = 'CALIBRATED') GROUP BY 1, 2""")
def k04_joint_maximum(spark, folder):
    nulls, calibrated = _null_parts(spark, folder)
    out = association.joint_maximum(nulls.withColumn("score", F.round("score", 9)), calibrated)
    return out.select("study_id", "replicate", digits("max_abs", 6).alias("max_abs"), "n_genes")


@R.add("k06_adjusted_calibration", _NULL_SQL + f"""
  SELECT study_id, gene_id, n AS n_tests, {sig("least(1.0, min(p * n / k) OVER (PARTITION BY study_id ORDER BY k DESC))", 6)} AS p_bh, {sig("least(1.0, max(p * (n - k + 1)) OVER (PARTITION BY study_id ORDER BY k))", 6)} AS p_holm
  FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p, gene_id) AS k, count(*) OVER (PARTITION BY study_id) AS n FROM (SELECT study_id, gene_id, (exceed + 1) / {_WORLDS + 1}.0::DOUBLE AS p FROM cal WHERE status = 'CALIBRATED'))""")
def k06_adjusted_calibration(spark, folder):
    rows = adjust(_null_parts(spark, folder)[1], "p", ["study_id"], ["gene_id"]).where("p IS NOT NULL")
    return rows.select("study_id", "gene_id", "n_tests", digits("p_bh", 6).alias("p_bh"), digits("p_holm", 6).alias("p_holm"))


def _c3_parts(spark, folder):
    return _null_parts(spark, folder, c3_cells)


@R.add("k02_null_scores_c3")
def k02_null_scores_c3(spark, folder):
    return _c3_parts(spark, folder)[0]


@R.add("k03_calibrate_c3")
def k03_calibrate_c3(spark, folder):
    """The calibration on strict log ratios of the fit, by the point-biserial correlation."""
    return _null_parts(spark, folder, c3_cells, "point_biserial_r")[1]


@R.add("k04_joint_maximum_c3")
def k04_joint_maximum_c3(spark, folder):
    return association.joint_maximum(*_c3_parts(spark, folder))


@R.add("k06_adjusted_calibration_c3")
def k06_adjusted_calibration_c3(spark, folder):
    return adjust(_c3_parts(spark, folder)[1], "p", ["study_id"], ["gene_id"]).where("p IS NOT NULL")
