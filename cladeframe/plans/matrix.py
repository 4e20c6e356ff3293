"""Queries of the cell table, its contracts, the study baseline and the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.stats import adjust, auc
from cladeframe.operators import baseline, cells, traits
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, GBI, NUDGE, STATES, TRIM, sig, with_
from cladeframe.sources.tables import table

R = Registry()


def digits(x: str | Column, n: int = 7) -> Column:
    """To some significant digits; see ``sig``."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.format_string(f"%.{n - 1}e", c.cast("double") * F.lit(float(NUDGE))).cast("double") + F.lit(0.0))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of every study."""
    return cells.ledger_cells(table(spark, folder, "state_ledger"))


def states(spark: SparkSession, folder: str) -> DataFrame:
    return traits.terminal_states(table(spark, folder, "coordinates"), table(spark, folder, "trait"), table(spark, folder, "taxon_groups"))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """The study ratio of every cell."""
    return baseline.ratio(baseline.trim(matrix(spark, folder)))


@R.add("a01_matrix_cells", with_(CELLS) + "SELECT study_id, gene_id, branch_id, coord_state, value, value_reason FROM cells")
def a01_matrix_cells(spark, folder):
    return matrix(spark, folder)


@R.add("a01_densify", with_(CELLS) + """
  SELECT g.study_id, g.gene_id, b.branch_id, coalesce(c.coord_state, 'NA_struct') AS coord_state, c.value
  FROM (SELECT DISTINCT study_id, gene_id FROM cells) g JOIN (SELECT DISTINCT study_id, branch_id FROM cells) b USING (study_id)
    LEFT JOIN cells c ON c.study_id = g.study_id AND c.gene_id = g.gene_id AND c.branch_id = b.branch_id""")
def a01_densify(spark, folder):
    return cells.densify(matrix(spark, folder)).select("study_id", "gene_id", "branch_id", "coord_state", "value")


@R.add("a04_trait_contract", """
  SELECT study_id, count(*) FILTER (WHERE binary_trait IS NULL OR isnan(binary_trait) OR binary_trait NOT IN (0, 0.5, 1)) AS outside_vocabulary,
    count(species) - count(DISTINCT species) AS repeated_species, count(*) FILTER (WHERE binary_trait = 0) AS n_reference,
    count(*) FILTER (WHERE binary_trait = 1) AS n_focal, count(*) FILTER (WHERE binary_trait = 0) > 0 AND count(*) FILTER (WHERE binary_trait = 1) > 0 AS both_classes
  FROM trait GROUP BY 1""")
def a04_trait_contract(spark, folder):
    return traits.trait_issues(table(spark, folder, "trait"))


@R.add("a05_group_contract", """
  SELECT study_id, species, count(*) AS n_rows, count(DISTINCT genus) AS n_genera FROM taxon_groups
  WHERE retired_at IS NULL AND species IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def a05_group_contract(spark, folder):
    return traits.group_issues(table(spark, folder, "taxon_groups"))


@R.add("a06_ordered_folds", """
  SELECT study_id, CAST(row_number() OVER (PARTITION BY study_id ORDER BY fold_id, genus) AS INT) AS fold_ord, fold_id, genus, seed
  FROM (SELECT *, row_number() OVER (PARTITION BY study_id, genus ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS version
    FROM folds WHERE genus IS NOT NULL AND fold_id IS NOT NULL) WHERE version = 1""")
def a06_ordered_folds(spark, folder):
    return traits.ordered_folds(table(spark, folder, "folds"))


@R.add("a06_fold_contract", """
  SELECT study_id, coalesce(a.n, 0) AS shared_folds, coalesce(b.n, 0) AS split_genera, c.n AS n_incomplete
  FROM (SELECT study_id, count(*) FILTER (WHERE seed IS NULL OR fold_id IS NULL OR genus IS NULL) AS n FROM folds GROUP BY 1) c
    LEFT JOIN (SELECT study_id, count(*) AS n FROM (SELECT study_id, fold_id FROM folds WHERE genus IS NOT NULL AND fold_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT genus) > 1) GROUP BY 1) a USING (study_id)
    LEFT JOIN (SELECT study_id, count(*) AS n FROM (SELECT study_id, genus FROM folds WHERE genus IS NOT NULL AND fold_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT fold_id) > 1) GROUP BY 1) b USING (study_id)""")
def a06_fold_contract(spark, folder):
    return traits.fold_issues(table(spark, folder, "folds"))


_TOKEN = "CASE WHEN numeric_status = 'finite_numeric' THEN CAST(numeric_value AS VARCHAR) ELSE coalesce(nullif(numeric_status, 'NA'), state) END"


@R.add("a09_parse_tokens", f"""
  SELECT study_id, CASE WHEN token = 'mapped' OR token IS NULL THEN 'unknown' WHEN token IN ('NA', 'NA_fuse', 'NA_struct', 'NA_topo', 'residual_NA', 'NaN', 'Inf', '-Inf', 'empty') THEN CASE WHEN token = 'empty' THEN 'unknown' ELSE token END
      ELSE 'finite_numeric' END AS token_class, count(*) AS n FROM (SELECT study_id, {_TOKEN} AS token FROM state_ledger) GROUP BY 1, 2""")
def a09_parse_tokens(spark, folder):
    """Raw export tokens of the ledger classed; the words ``mapped`` and ``empty`` are no tokens of a file."""
    raw = table(spark, folder, "state_ledger")
    status = F.col("numeric_status")
    token = F.when(status == "finite_numeric", F.col("numeric_value").cast("string")).otherwise(F.coalesce(F.nullif(status, F.lit("NA")), F.col("state")))
    return cells.parse_tokens(raw.select("study_id", token.alias("token"))).groupBy("study_id", "token_class").agg(F.count(F.lit(1)).alias("n"))


_RAW = f"""raw AS (SELECT study_id, gene_id, branch_id, CASE WHEN token IN ('NA', 'NA_fuse', 'NA_struct', 'NA_topo', 'residual_NA', 'NaN', 'Inf', '-Inf') THEN token WHEN token IN ('mapped', 'empty') OR token IS NULL THEN 'unknown' ELSE 'finite_numeric' END AS token_class
  FROM (SELECT study_id, gene_id, coordinate_id AS branch_id, {_TOKEN} AS token, row_number() OVER (PARTITION BY study_id, gene_id, coordinate_id ORDER BY loaded_at, cell_id) AS v FROM state_ledger WHERE study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL AND loaded_at IS NOT NULL) WHERE v = 1)"""


@R.add("a11_reconcile", with_(CELLS, _RAW) + """
  SELECT study_id, issue, count(*) AS n FROM (SELECT study_id, CASE WHEN coord_state IS NULL THEN 'raw_only' WHEN token_class IS NULL THEN 'state_only' WHEN token_class = 'finite_numeric' AND coord_state <> 'observed' THEN 'number_off_observed'
    WHEN token_class <> 'finite_numeric' AND coord_state = 'observed' THEN 'observed_without_number' END AS issue FROM raw FULL JOIN cells USING (study_id, gene_id, branch_id)) WHERE issue IS NOT NULL GROUP BY 1, 2""")
def a11_reconcile(spark, folder):
    """The tokens of the first export of every cell against the states of the last."""
    first = table(spark, folder, "state_ledger").where("study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL AND loaded_at IS NOT NULL")
    status = F.col("numeric_status")
    token = F.when(status == "finite_numeric", F.col("numeric_value").cast("string")).otherwise(F.coalesce(F.nullif(status, F.lit("NA")), F.col("state")))
    order = F.struct("loaded_at", "cell_id")
    raw = first.withColumn("token", token).groupBy("study_id", "gene_id", F.col("coordinate_id").alias("branch_id")).agg(F.min_by("token", order).alias("token"))
    return cells.reconcile(cells.parse_tokens(raw), matrix(spark, folder)).groupBy("study_id", "issue").agg(F.count(F.lit(1)).alias("n"))


@R.add("a13_keyed_projection", """
  SELECT study_id, branch_id, canonical_split_key FROM (SELECT *, row_number() OVER (PARTITION BY study_id, branch_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS v
    FROM coordinates WHERE retired_at IS NULL AND study_id IS NOT NULL AND branch_id IS NOT NULL) WHERE v = 1""")
def a13_keyed_projection(spark, folder):
    return traits.in_force(table(spark, folder, "coordinates"), ["study_id", "branch_id"]).select("study_id", "branch_id", "canonical_split_key")


@R.add("a23_numeric_roundtrip", with_(CELLS) + "SELECT study_id, gene_id, branch_id, CAST(printf('%.14e', value) AS DOUBLE) AS value FROM cells WHERE value IS NOT NULL")
def a23_numeric_roundtrip(spark, folder):
    """Values as a text file with 15 significant digits would give them back."""
    return matrix(spark, folder).where("value IS NOT NULL").select("study_id", "gene_id", "branch_id", F.format_string("%.14e", "value").cast("double").alias("value"))


@R.add("c01_cell_violations", with_(CELLS) + """
  SELECT study_id, rule, n FROM (
    SELECT study_id, 'unknown_state' AS rule, count(*) FILTER (WHERE coord_state IS NULL OR coord_state NOT IN ('observed', 'NA_struct', 'NA_fuse', 'NA_topo', 'residual_NA')) AS n FROM cells GROUP BY 1
    UNION ALL SELECT study_id, 'payload_off_observed', count(*) FILTER (WHERE coord_state <> 'observed' AND value IS NOT NULL) FROM cells GROUP BY 1
    UNION ALL SELECT study_id, 'reason_missing', count(*) FILTER (WHERE coord_state = 'observed' AND value IS NULL AND value_reason IS NULL) FROM cells GROUP BY 1) WHERE n > 0""")
def c01_cell_violations(spark, folder):
    return cells.violations(matrix(spark, folder))


@R.add("c02_display_labels", with_(CELLS) + "SELECT DISTINCT study_id, gene_id, CASE WHEN gene_id = (SELECT max(gene_id) FROM cells) THEN 'last' ELSE gene_id END AS label FROM cells")
def c02_display_labels(spark, folder):
    genes = matrix(spark, folder).select("study_id", "gene_id").distinct().withColumn("label", F.col("gene_id"))
    new = genes.agg(F.max("gene_id").alias("gene_id")).withColumn("label", F.lit("last"))
    return cells.relabel(genes, new, "gene_id").select("study_id", "gene_id", "label")


@R.add("c03_eligibility", with_(CELLS) + """
  SELECT study_id, elig_status, elig_reason, count(*) AS n FROM (SELECT study_id, CASE WHEN coord_state = 'observed' AND value >= 0 THEN 'eligible' WHEN coord_state = 'observed' THEN 'unresolved' ELSE 'not_applicable' END AS elig_status,
    CASE WHEN coord_state = 'observed' AND value >= 0 THEN 'eligible_declared' WHEN coord_state = 'observed' THEN 'authority_unresolved' ELSE 'coordinate_not_observed' END AS elig_reason
    FROM cells) GROUP BY 1, 2, 3""")
def c03_eligibility(spark, folder):
    return cells.eligibility(matrix(spark, folder)).groupBy("study_id", "elig_status", "elig_reason").agg(F.count(F.lit(1)).alias("n"))


@R.add("c05_payload_state", with_(CELLS) + """
  SELECT study_id, coord_state, payload_state, count(*) AS n FROM (SELECT study_id, coord_state, CASE WHEN coord_state <> 'observed' OR value IS NULL THEN 'coordinate_no_payload' WHEN value < 0 THEN 'negative'
    WHEN value = 0 THEN 'exact_zero' ELSE 'finite_positive' END AS payload_state FROM cells) GROUP BY 1, 2, 3""")
def c05_payload_state(spark, folder):
    return matrix(spark, folder).withColumn("payload_state", cells.payload_state()).groupBy("study_id", "coord_state", "payload_state").agg(F.count(F.lit(1)).alias("n"))


@R.add("c06_trait_domain", with_(STATES) + """
  SELECT study_id, species, 'trait' AS side FROM traits WHERE (study_id, species) NOT IN (SELECT study_id, species FROM genera)
  UNION ALL SELECT study_id, species, 'groups' FROM genera WHERE (study_id, species) NOT IN (SELECT study_id, species FROM traits)""")
def c06_trait_domain(spark, folder):
    t = traits.trait_values(table(spark, folder, "trait"))
    return traits.key_agreement(t, traits.in_force(table(spark, folder, "taxon_groups"), ["study_id", "species"]), ["study_id", "species"], "trait", "groups")


@R.add("c07_branch_states", with_(CELLS, STATES) + """
  SELECT b.study_id, b.branch_id, s.state, CASE WHEN s.state IN (0, 1) THEN 'available' WHEN s.state = 0.5 THEN 'unresolved' ELSE 'unavailable' END AS availability,
    CASE WHEN s.state = 0.5 THEN 'intermediate_excluded' WHEN s.state IS NULL THEN 'no_trait' END AS reason
  FROM (SELECT DISTINCT study_id, branch_id FROM cells) b LEFT JOIN states s USING (study_id, branch_id)""")
def c07_branch_states(spark, folder):
    return traits.branch_states(matrix(spark, folder), states(spark, folder))


@R.add("c08_level_key", "SELECT DISTINCT study_id, 'numeric:' || CAST(binary_trait + 0.0 AS VARCHAR) AS as_number, 'character:' || species AS as_text FROM trait WHERE binary_trait IN (0, 0.5, 1) AND species IS NOT NULL")
def c08_level_key(spark, folder):
    rows = table(spark, folder, "trait").where(F.col("binary_trait").isin(0.0, 0.5, 1.0) & F.col("species").isNotNull())
    return rows.select("study_id", traits.level_key(F.col("binary_trait"), True).alias("as_number"), traits.level_key(F.col("species"), False).alias("as_text")).distinct()


@R.add("c09_mask_hash", with_(CELLS) + r"""
  SELECT study_id, sha256(string_agg(gene_id || ' ' || h, chr(10) ORDER BY gene_id || ' ' || h)) AS mask_sha256 FROM (
    SELECT study_id, gene_id, sha256(string_agg(branch_id, chr(10) ORDER BY branch_id)) AS h FROM cells WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def c09_mask_hash(spark, folder):
    return cells.mask_hash(matrix(spark, folder), F.col("value").isNotNull())


@R.add("h01_trim", with_(CELLS, TRIM) + "SELECT study_id, gene_id, branch_id, value, cutoff, trimmed FROM trim_rows WHERE trimmed")
def h01_trim(spark, folder):
    rows = baseline.trim(matrix(spark, folder))
    return rows.where("trimmed").select("study_id", "gene_id", "branch_id", "value", "cutoff", "trimmed")


def _effects_sql(by: str) -> str:
    return with_(CELLS, TRIM) + f"""
      SELECT study_id, {by}, {sig("median(kept)")} AS effect_median, {sig("avg(kept)")} AS effect_mean, count(value) AS n_before, count(kept) AS n_after, count(*) FILTER (WHERE trimmed) AS n_trimmed,
        count(*) FILTER (WHERE value = 0) AS zeros_before, count(*) FILTER (WHERE kept = 0) AS zeros_after, {sig("CASE WHEN avg(kept) <> 0 THEN median(kept) / avg(kept) END")} AS median_over_mean
      FROM trim_rows GROUP BY 1, 2"""


def _effects(spark, folder, by):
    rows = baseline.effects(baseline.trim(matrix(spark, folder)), by)
    for c in ("effect_median", "effect_mean", "median_over_mean"):
        rows = rows.withColumn(c, digits(c))
    return rows


@R.add("h02_gene_effects", _effects_sql("gene_id"))
def h02_gene_effects(spark, folder):
    return _effects(spark, folder, "gene_id")


@R.add("h04_branch_effects", _effects_sql("branch_id"))
def h04_branch_effects(spark, folder):
    return _effects(spark, folder, "branch_id")


@R.add("h03_gbi", with_(CELLS, TRIM, GBI) + f"SELECT study_id, gene_id, branch_id, {sig('gbi')} AS gbi FROM rates")
def h03_gbi(spark, folder):
    return rates(spark, folder).select("study_id", "gene_id", "branch_id", digits("gbi").alias("gbi"))


_WELCH = f"""welch AS (
  SELECT *, CASE WHEN v0 / n0 + v1 / n1 > 0 AND sqrt(v0 / n0 + v1 / n1) >= 2.220446049250313e-15 * greatest(abs(m0), abs(m1)) AND n0 >= 2 AND n1 >= 2 THEN (m0 - m1) / sqrt(v0 / n0 + v1 / n1) END AS t,
    CASE WHEN v0 / n0 + v1 / n1 > 0 AND sqrt(v0 / n0 + v1 / n1) >= 2.220446049250313e-15 * greatest(abs(m0), abs(m1)) AND n0 >= 2 AND n1 >= 2 THEN (v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / ((v0 / n0) * (v0 / n0) / (n0 - 1) + (v1 / n1) * (v1 / n1) / (n1 - 1)) END AS df
  FROM (SELECT r.study_id, r.gene_id, count(gbi) FILTER (WHERE state = 0) AS n0, count(gbi) FILTER (WHERE state = 1) AS n1, avg(gbi) FILTER (WHERE state = 0) AS m0, avg(gbi) FILTER (WHERE state = 1) AS m1,
      CASE WHEN count(gbi) FILTER (WHERE state = 0) > 1 THEN var_samp(gbi) FILTER (WHERE state = 0) END AS v0, CASE WHEN count(gbi) FILTER (WHERE state = 1) > 1 THEN var_samp(gbi) FILTER (WHERE state = 1) END AS v1
    FROM rates r JOIN states s USING (study_id, branch_id) WHERE state IN (0, 1) GROUP BY 1, 2))"""


@R.add("j01_welch_screen", with_(CELLS, TRIM, GBI, STATES, _WELCH) + f"""
  SELECT study_id, gene_id, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, {sig("t")} AS t, {sig("df")} AS df, CASE WHEN t > 0 THEN 'slow' WHEN t < 0 THEN 'fast' WHEN t = 0 THEN 'zero' END AS direction,
    CASE WHEN coalesce(least(n0, n1), 0) < 2 THEN 'insufficient_finite_group_size' WHEN t IS NULL THEN 'welch_refused_constant_data' END AS reason
  FROM (SELECT DISTINCT study_id, gene_id FROM rates) LEFT JOIN welch USING (study_id, gene_id)""")
def j01_welch_screen(spark, folder):
    return baseline.screen(rates(spark, folder), states(spark, folder)).select("study_id", "gene_id", "n0", "n1", digits("t").alias("t"), digits("df").alias("df"), "direction", "reason")


@R.add("j01_welch_p")
def j01_welch_p(spark, folder):
    """The screen with p and the strict-prefix selection (the t distribution has no SQL)."""
    return baseline.screen(rates(spark, folder), states(spark, folder)).select("study_id", "gene_id", "t", "df", "p", "selected", "direction", "reason")


@R.add("j01_screen_summary")
def j01_screen_summary(spark, folder):
    return baseline.screen_summary(baseline.screen(rates(spark, folder), states(spark, folder)))


@R.add("j02_sufficient_welch", with_(CELLS, TRIM, GBI, STATES) + f"""
  SELECT study_id, gene_id, n0, n1, {sig("s0")} AS s0, {sig("s1")} AS s1, {sig("q0")} AS q0, {sig("q1")} AS q1 FROM (
    SELECT study_id, gene_id, count(gbi) FILTER (WHERE state = 0) AS n0, count(gbi) FILTER (WHERE state = 1) AS n1, coalesce(sum(gbi) FILTER (WHERE state = 0), 0) AS s0, coalesce(sum(gbi) FILTER (WHERE state = 1), 0) AS s1,
      coalesce(sum(gbi * gbi) FILTER (WHERE state = 0), 0) AS q0, coalesce(sum(gbi * gbi) FILTER (WHERE state = 1), 0) AS q1
    FROM rates JOIN states USING (study_id, branch_id) WHERE state IN (0, 1) GROUP BY 1, 2)""")
def j02_sufficient_welch(spark, folder):
    stats = baseline.group_statistics(rates(spark, folder), states(spark, folder))
    return stats.select("study_id", "gene_id", "n0", "n1", *[digits(c).alias(c) for c in ("s0", "s1", "q0", "q1")])


@R.add("j03_held_out", with_(CELLS, TRIM, GBI, STATES) + f"""
  SELECT f.study_id, f.genus, g.gene_id, count(gbi) FILTER (WHERE state = 0) AS n0, count(gbi) FILTER (WHERE state = 1) AS n1
  FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL) f
    JOIN (SELECT DISTINCT study_id, gene_id FROM rates JOIN states USING (study_id, branch_id) WHERE state IN (0, 1)) g USING (study_id)
    LEFT JOIN (SELECT study_id, gene_id, gbi, state, genus AS own FROM rates JOIN states USING (study_id, branch_id)) r ON r.study_id = f.study_id AND r.gene_id = g.gene_id AND (own IS NULL OR own <> f.genus)
  GROUP BY 1, 2, 3""")
def j03_held_out(spark, folder):
    s = states(spark, folder)
    held = baseline.held_out_statistics(rates(spark, folder), s.drop("genus"), s)
    return held.select("study_id", "genus", "gene_id", F.col("n0").cast("bigint").alias("n0"), F.col("n1").cast("bigint").alias("n1"))


@R.add("j05_permutation_screen", with_(CELLS, TRIM, GBI, STATES) + f"""
  SELECT study_id, gene_id, n0, n1, {sig("(m1 - m0) / sqrt(v0 / n0 + v1 / n1)", 5)} AS t FROM (
    SELECT study_id, gene_id, n0, n1, m0, m1, CASE WHEN v0 < 0 AND v0 > -1e-10 THEN 0 ELSE v0 END AS v0, CASE WHEN v1 < 0 AND v1 > -1e-10 THEN 0 ELSE v1 END AS v1 FROM (
      SELECT study_id, gene_id, n0, n1, s0 / n0 AS m0, s1 / n1 AS m1, (q0 - s0 * s0 / n0) / (n0 - 1) AS v0, (q1 - s1 * s1 / n1) / (n1 - 1) AS v1 FROM (
        SELECT study_id, gene_id, count(gbi) FILTER (WHERE state = 0) AS n0, count(gbi) FILTER (WHERE state = 1) AS n1, sum(gbi) FILTER (WHERE state = 0) AS s0, sum(gbi) FILTER (WHERE state = 1) AS s1, sum(gbi * gbi) FILTER (WHERE state = 0) AS q0, sum(gbi * gbi) FILTER (WHERE state = 1) AS q1
        FROM rates JOIN states USING (study_id, branch_id) WHERE state IN (0, 1) GROUP BY 1, 2) WHERE n0 > 1 AND n1 > 1)) WHERE v0 / n0 + v1 / n1 > 0""")
def j05_permutation_screen(spark, folder):
    """t as focal minus background from the mergeable statistics, as the permuted worlds are screened."""
    tested = baseline.welch(baseline.group_statistics(rates(spark, folder), states(spark, folder)), focal_first=True).where("t IS NOT NULL")
    return tested.select("study_id", "gene_id", "n0", "n1", digits("t", 5).alias("t"))


_P = "p_rows AS (SELECT study_id, gene_id, branch_id, CASE WHEN value > 0 THEN 1.0 / (1.0 + floor(value)) END AS p FROM cells)"


def _p_rows(spark, folder):
    """An arithmetic p-like column with ties and nulls, by which selection and adjustment are compared with SQL."""
    v = F.col("value")
    return matrix(spark, folder).select("study_id", "gene_id", "branch_id", F.when(v > 0, 1.0 / (1.0 + F.floor(v))).alias("p"))


@R.add("j04_strict_prefix", with_(CELLS, _P) + """
  SELECT study_id, gene_id, branch_id, k < coalesce(min(CASE WHEN NOT ok THEN k END) OVER (PARTITION BY study_id), n + 1) AS selected FROM (
    SELECT *, p < k::DOUBLE / n * 0.01 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p, gene_id, branch_id) AS k, count(*) OVER (PARTITION BY study_id) AS n FROM p_rows WHERE p IS NOT NULL))""")
def j04_strict_prefix(spark, folder):
    rows = baseline.strict_prefix(_p_rows(spark, folder), "p", ["study_id"], ["gene_id", "branch_id"])
    return rows.where("p IS NOT NULL").select("study_id", "gene_id", "branch_id", "selected")


@R.add("j09_k06_adjust", with_(CELLS, _P) + f"""
  SELECT study_id, gene_id, branch_id, n AS n_tests, {sig("least(1.0, min(p * n / k) OVER (PARTITION BY study_id ORDER BY k DESC))")} AS p_bh,
    {sig("least(1.0, min(p * n * h / k) OVER (PARTITION BY study_id ORDER BY k DESC))")} AS p_by,
    {sig("least(1.0, max(p * (n - k + 1)) OVER (PARTITION BY study_id ORDER BY k))")} AS p_holm, {sig("least(1.0, p * n)")} AS p_bonferroni
  FROM (SELECT *, sum(1.0 / k) OVER (PARTITION BY study_id) AS h FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p, gene_id, branch_id) AS k, count(*) OVER (PARTITION BY study_id) AS n FROM p_rows WHERE p IS NOT NULL))""")
def j09_k06_adjust(spark, folder):
    rows = adjust(_p_rows(spark, folder), "p", ["study_id"], ["gene_id", "branch_id"]).where("p IS NOT NULL")
    return rows.select("study_id", "gene_id", "branch_id", "n_tests", *[digits(c).alias(c) for c in ("p_bh", "p_by", "p_holm", "p_bonferroni")])


@R.add("l06_auc", with_(CELLS, STATES) + f"""
  SELECT study_id, gene_id, count(*) FILTER (WHERE state = 0) AS n0, count(*) FILTER (WHERE state = 1) AS n1,
    {sig("CASE WHEN count(*) FILTER (WHERE state = 1) > 0 AND count(*) FILTER (WHERE state = 0) > 0 THEN (sum(r) FILTER (WHERE state = 1) - count(*) FILTER (WHERE state = 1) * (count(*) FILTER (WHERE state = 1) + 1) / 2.0) / (count(*) FILTER (WHERE state = 1) * count(*) FILTER (WHERE state = 0)) END")} AS auc
  FROM (SELECT study_id, gene_id, state, rank() OVER (PARTITION BY study_id, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY study_id, gene_id, value) - 1) / 2.0 AS r
    FROM cells JOIN states USING (study_id, branch_id) WHERE value IS NOT NULL AND state IN (0, 1)) GROUP BY 1, 2""")
def l06_auc(spark, folder):
    rows = matrix(spark, folder).join(states(spark, folder), ["study_id", "branch_id"]).where(F.col("state").isin(0.0, 1.0))
    return auc(rows, "value", "state", ["study_id", "gene_id"]).withColumn("auc", digits("auc"))
