"""Common parts of the SQL with which queries are compared."""

#: Moves a number by far less than the digits compared.
NUDGE = "1.0000000000003e0"

CELLS = """cells AS (
  SELECT study_id, gene_id, branch_id, coord_state, value,
    CASE WHEN coord_state = 'observed' AND value IS NULL THEN coalesce(numeric_status, 'unstated') END AS value_reason
  FROM (SELECT study_id, gene_id, coordinate_id AS branch_id, numeric_status, CASE WHEN state = 'mapped' THEN 'observed' ELSE state END AS coord_state,
      CASE WHEN state = 'mapped' AND numeric_available AND isfinite(numeric_value) THEN numeric_value END AS value,
      row_number() OVER (PARTITION BY study_id, gene_id, coordinate_id ORDER BY run_day DESC NULLS LAST, loaded_at DESC NULLS LAST, cell_id DESC) AS version
    FROM state_ledger WHERE study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL) WHERE version = 1)"""

STATES = """coords AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, branch_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS version
    FROM coordinates WHERE retired_at IS NULL AND study_id IS NOT NULL AND branch_id IS NOT NULL) WHERE version = 1),
traits AS (
  SELECT study_id, species, CASE WHEN binary_trait IN (0, 0.5, 1) THEN binary_trait END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY study_id, species ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS version
    FROM trait WHERE study_id IS NOT NULL AND species IS NOT NULL) WHERE version = 1),
genera AS (
  SELECT study_id, species, genus FROM (SELECT *, row_number() OVER (PARTITION BY study_id, species ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS version
    FROM taxon_groups WHERE retired_at IS NULL AND study_id IS NOT NULL AND species IS NOT NULL) WHERE version = 1),
states AS (
  SELECT c.study_id, c.branch_id, c.terminal_taxon AS species, g.genus, t.value AS state
  FROM coords c JOIN traits t ON t.study_id = c.study_id AND t.species = c.terminal_taxon
    LEFT JOIN genera g ON g.study_id = c.study_id AND g.species = c.terminal_taxon
  WHERE c.branch_type = 'terminal' AND t.value IS NOT NULL)"""

TRIM = """trim_rows AS (
  SELECT c.*, cutoff, coalesce(value >= cutoff, false) AS trimmed, CASE WHEN value >= cutoff THEN NULL ELSE value END AS kept
  FROM cells c JOIN (SELECT study_id, gene_id, quantile_cont(value, 0.975) AS cutoff FROM cells GROUP BY 1, 2) USING (study_id, gene_id))"""

GBI = """rates AS (
  SELECT t.study_id, t.gene_id, t.branch_id, t.kept, CASE WHEN be <> 0 AND ge <> 0 THEN t.kept / be / ge END AS gbi
  FROM trim_rows t JOIN (SELECT study_id, branch_id, avg(kept) AS be FROM trim_rows GROUP BY 1, 2) USING (study_id, branch_id)
    JOIN (SELECT study_id, gene_id, avg(kept) AS ge FROM trim_rows GROUP BY 1, 2) USING (study_id, gene_id))"""


def sig(x: str, digits: int = 7) -> str:
    """``x`` to some significant digits: sums are not associative, and engines add in different orders.

    The factor keeps decimal ties, which engines round differently, off the half.
    """
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(printf('%.{digits - 1}e', CAST({x} AS DOUBLE) * {NUDGE}) AS DOUBLE) + 0.0 END"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
