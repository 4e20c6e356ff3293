"""The cell table: one row per (study, gene, branch), with coordinate state, payload and eligibility.

A zero is a measurement; an absence is a null with a state that says why.  All
operators carry ``study_id``, so many matrices are worked on in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.vocab import COORD_STATES

KEY = ("study_id", "gene_id", "branch_id")


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first), as one aggregation with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return last.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def ledger_cells(ledger: DataFrame) -> DataFrame:
    """Cells of a state ledger: the newest export of every coordinate of every gene of a study.

    ``mapped`` is the observed state.  A payload is kept only where the ledger
    calls it available and it is finite; an observed cell without one carries
    the ledger's numeric status as its reason.  Rows without a key are left out.
    """
    keyed = ledger.where(F.col("gene_id").isNotNull() & F.col("coordinate_id").isNotNull() & F.col("study_id").isNotNull())
    keyed = keyed.select("study_id", "gene_id", F.col("coordinate_id").alias("branch_id"), "state", "numeric_available", "numeric_value", "numeric_status", "run_day", "loaded_at", "cell_id")
    last = newest(keyed, list(KEY), ["run_day", "loaded_at", "cell_id"])
    v = F.col("numeric_value")
    state = F.when(F.col("state") == "mapped", "observed").otherwise(F.col("state"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    value = F.when((state == "observed") & F.col("numeric_available") & finite, v)
    reason = F.when((state == "observed") & value.isNull(), F.coalesce("numeric_status", F.lit("unstated")))
    return last.select(*KEY, state.alias("coord_state"), value.alias("value"), reason.alias("value_reason"))


def densify(cells: DataFrame, absent: str = "NA_struct") -> DataFrame:
    """Every gene by every branch of a study; pairs without a row get the state ``absent``."""
    genes, branches = cells.select("study_id", "gene_id").distinct(), cells.select("study_id", "branch_id").distinct()
    return genes.join(branches, "study_id").join(cells, list(KEY), "left").withColumn("coord_state", F.coalesce("coord_state", F.lit(absent)))


def from_wide(rows: DataFrame, gene: str, branches: list[str], study: str) -> DataFrame:
    """A wide matrix (one column per branch, values as raw tokens) to long ``(study_id, gene_id, branch_id, token)``."""
    return rows.unpivot([gene], branches, "branch_id", "token").select(F.lit(study).alias("study_id"), F.col(gene).alias("gene_id"), "branch_id", "token")


def parse_tokens(rows: DataFrame, token: str = "token") -> DataFrame:
    """Raw tokens to ``token_class`` and ``value``; a token outside the vocabulary has the class ``unknown``.

    Absence codes are kept as they are; NaN and infinities are classes without a value; a blank is ``empty``.
    """
    t = F.trim(F.col(token))
    number = t.try_cast("double")
    plain = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    kind = (
        F.when(F.col(token).isNull() | (t == ""), "empty").when(t.isin("NA", "NA_fuse", "NA_struct", "NA_topo", "residual_NA", "NaN", "Inf", "-Inf"), t)
        .when(plain & (F.abs(number) < float("inf")), "finite_numeric").otherwise("unknown")
    )
    return rows.withColumn("token_class", kind).withColumn("value", F.when(kind == "finite_numeric", number))


def payload_state() -> Column:
    """What a cell's payload is, for admission: absent, non-finite, negative, zero or positive."""
    v = F.col("value")
    return (
        F.when((F.col("coord_state") != "observed") | v.isNull(), "coordinate_no_payload").when(F.isnan(v) | (F.abs(v) == float("inf")), "nonfinite")
        .when(v < 0, "negative").when(v == 0, "exact_zero").otherwise("finite_positive")
    )


def eligibility(cells: DataFrame) -> DataFrame:
    """Default measurement eligibility: observed, finite and not negative is eligible; other observed cells are unresolved."""
    observed = F.col("coord_state") == "observed"
    good = observed & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf"))
    status = F.when(good, "eligible").when(observed, "unresolved").otherwise("not_applicable")
    reason = F.when(good, "eligible_declared").when(observed, "authority_unresolved").otherwise("coordinate_not_observed")
    return cells.withColumn("elig_status", status).withColumn("elig_reason", reason)


def violations(cells: DataFrame) -> DataFrame:
    """Rows per rule and study that break the invariants of a cell; no row says that all hold.

    Rules: known state, no payload or reason off observed cells, finite payload,
    no reason beside a payload, a reason where an observed cell has none, unique key.
    """
    observed, v, why = F.col("coord_state") == "observed", F.col("value"), F.col("value_reason")
    rules = {
        "unknown_state": ~F.coalesce(F.col("coord_state").isin(*COORD_STATES), F.lit(False)),
        "payload_off_observed": ~observed & v.isNotNull(),
        "reason_off_observed": ~observed & why.isNotNull(),
        "payload_not_finite": F.isnan(v) | (F.abs(v) == float("inf")),
        "reason_beside_payload": observed & v.isNotNull() & why.isNotNull(),
        "reason_missing": observed & v.isNull() & (F.coalesce(F.trim(why), F.lit("")) == ""),
    }
    broken = cells.groupBy("study_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    long = broken.unpivot(["study_id"], list(rules), "rule", "n")
    again = cells.groupBy(*KEY).count().where("count > 1").groupBy("study_id").agg(F.sum("count").alias("n")).select("study_id", F.lit("repeated_key").alias("rule"), "n")
    return long.unionByName(again).where("n > 0")


def require_valid(cells: DataFrame) -> DataFrame:
    """``cells``, or ``ContractError`` naming some broken rules."""
    broken = violations(cells).limit(5).collect()
    if broken:
        raise ContractError("; ".join(f"{r.study_id}: {r.rule} in {r.n} cells" for r in broken))
    return cells


def relabel(dimension: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Set display labels of a dimension table; keys, and with them identity, stay."""
    new = labels.select(F.col(key).alias("__k"), F.col(label).alias("__l"))
    return dimension.join(new, F.col(key) == F.col("__k"), "left").withColumn(label, F.coalesce("__l", label)).drop("__k", "__l")


def mask_hash(cells: DataFrame, mask: Column) -> DataFrame:
    """SHA-256 per study of the sorted keys under ``mask``: equal for equal sets of cells, whatever their order.

    Keys are hashed per gene first, so no task holds a whole study's keys.
    """
    part = cells.where(mask).groupBy("study_id", "gene_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("branch_id")), "\n"), 256).alias("h"))
    return part.groupBy("study_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "gene_id", "h"))), "\n"), 256).alias("mask_sha256"))


def reconcile(raw: DataFrame, complete: DataFrame) -> DataFrame:
    """Cells where the raw tokens and a complete state ledger disagree: a number must stand exactly where the state is observed.

    ``issue`` is ``raw_only``, ``state_only``, ``number_off_observed`` or ``observed_without_number``.
    """
    a, b = raw.select(*KEY, "token_class"), complete.select(*KEY, "coord_state")
    both = a.join(b, list(KEY), "full")
    number, observed = F.col("token_class") == "finite_numeric", F.col("coord_state") == "observed"
    issue = (
        F.when(F.col("coord_state").isNull(), "raw_only").when(F.col("token_class").isNull(), "state_only")
        .when(number & ~observed, "number_off_observed").when(~number & observed, "observed_without_number")
    )
    return both.withColumn("issue", issue).where(F.col("issue").isNotNull())
