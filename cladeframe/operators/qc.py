"""Quality profiles of matrices, threshold flags, and their explicit application.

Profiles and flags never change a cell; ``apply_qc`` moves chosen cells to
ineligible and reports every transition.  All summaries are per study; gene and
branch scopes are the same functions with one more key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.errors import ContractError, RefusedError
from cladeframe.operators.cells import KEY, payload_state

QUANTILES = (("q01", 0.01), ("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99))
SCOPES = {"whole_matrix": ["study_id"], "within_gene": ["study_id", "gene_id"], "within_branch": ["study_id", "branch_id"]}
METHODS = ("none", "quantile", "iqr", "mad", "absolute", "custom_mask")


@dataclass(frozen=True)
class Rule:
    """A flag rule.  ``direction`` is upper, lower or two_sided; ``ties`` strict or inclusive (quantile rules only)."""

    rule_id: str
    method: str
    scope: str = "whole_matrix"
    direction: str = "two_sided"
    ties: str = "strict"
    multiplier: float = 1.5
    lower_probability: float = 0.01
    upper_probability: float = 0.99
    lower: float | None = None
    upper: float | None = None
    severity: str = "WARNING"
    reason: str = "threshold"

    def __post_init__(self) -> None:
        if self.ties == "exact_rank":
            raise RefusedError("exact-rank ties are not offered")
        if self.method not in METHODS or self.scope not in SCOPES or self.direction not in ("upper", "lower", "two_sided") or self.ties not in ("strict", "inclusive"):
            raise ContractError(f"rule {self.rule_id} lies outside the vocabulary")
        if self.method == "absolute" and ((self.direction != "lower" and self.upper is None) or (self.direction != "upper" and self.lower is None)):
            raise ContractError(f"rule {self.rule_id} lacks a bound")


def available(cells: DataFrame) -> DataFrame:
    """Observed cells with a finite payload."""
    return cells.where((F.col("coord_state") == "observed") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def value_summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts by sign, extremes, quantiles of linear interpolation, mean, sd, raw median absolute deviation, sums, and the positive log range."""
    v = F.col("value")
    rows = available(cells)
    center = rows.groupBy(*by).agg(F.median("value").alias("__m"))
    spread = rows.join(center, by).groupBy(*by).agg(F.median(F.abs(v - F.col("__m"))).alias("mad_raw"))
    n = lambda c: F.count_if(c).cast("bigint")
    log = F.ln(F.when(v > 0, v))
    out = rows.groupBy(*by).agg(
        F.count("value").alias("available_count"), n(v == 0).alias("exact_zero_count"), n(v > 0).alias("positive_count"), n(v < 0).alias("negative_count"), F.min("value").alias("min"),
        F.percentile("value", [p for _, p in QUANTILES]).alias("__q"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum("value").alias("sum"),
        F.sum(F.abs(v)).alias("sum_abs"), F.max(F.abs(v)).alias("max_abs"), F.count(log).cast("bigint").alias("positive_log_count"), n(v <= 0).alias("positive_log_domain_loss"), F.min(log).alias("positive_log_min"), F.median(log).alias("positive_log_median"), F.max(log).alias("positive_log_max"),
    )
    for i, (name, _) in enumerate(QUANTILES):
        out = out.withColumn(name, F.get("__q", F.lit(i)))
    return out.drop("__q").join(spread, by)


def axis_summary(cells: DataFrame, axis: str) -> DataFrame:
    """Per gene or branch: coordinates, observed and available shares, and the value summary (null where nothing is available)."""
    by = ["study_id", axis]
    has = (F.col("coord_state") == "observed") & F.col("value").isNotNull()
    total = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("total_coordinates"), F.count_if(F.col("coord_state") == "observed").cast("bigint").alias("observed_count"), F.count_if(has).cast("bigint").alias("payload_count"))
    total = total.withColumn("observed_fraction", F.col("observed_count") / F.col("total_coordinates")).withColumn("available_of_observed", F.try_divide("payload_count", "observed_count"))
    out = total.join(value_summary(cells, by), by, "left")
    # Shares of the study: of its absolute mass, and of the absolute sums over all units of the axis.
    whole = out.groupBy("study_id").agg(F.sum("sum_abs").alias("__mass"), F.sum(F.abs("sum")).alias("__margin"))
    out = out.join(whole, "study_id").withColumn("mass_fraction", F.try_divide("sum_abs", "__mass")).withColumn("margin_fraction", F.try_divide(F.abs("sum"), F.col("__margin")))
    return out.drop("__mass", "__margin")


def state_crosstab(cells: DataFrame) -> DataFrame:
    """Cells by coordinate state and payload state."""
    return cells.withColumn("payload_state", payload_state()).groupBy("study_id", "coord_state", "payload_state").agg(F.count(F.lit(1)).alias("n"))


def point_masses(cells: DataFrame, top: int = 10) -> DataFrame:
    """The values of a study that occur more than once: the ``top`` by count, then by value."""
    rows = available(cells)
    total = rows.groupBy("study_id").agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy("study_id", "value").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    order = W.partitionBy("study_id").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "study_id").select("study_id", "rank", "value", "count", (F.col("count") / F.col("total")).alias("fraction"))


def extreme_repetition(cells: DataFrame) -> DataFrame:
    """How often the least and the greatest value of a study occur exactly; one aggregation over value counts."""
    counts = available(cells).groupBy("study_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("study_id").agg(
        F.min("value").alias("minimum"), F.min_by("n", "value").alias("minimum_count"), F.max("value").alias("maximum"), F.max_by("n", "value").alias("maximum_count"), F.sum("n").alias("total")
    )


def leverage(cells: DataFrame, top_k: tuple[int, ...] = (1, 5, 10), fractions: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Share of the absolute mass that the heaviest cells, genes and branches hold, for counts ``top_k`` and ``fractions`` of the units (one at least)."""
    rows = available(cells)
    units = {
        "cell": rows.select("study_id", F.concat_ws(" ", "gene_id", "branch_id").alias("unit"), F.abs("value").alias("mass")),
        "gene_margin": rows.groupBy("study_id", F.col("gene_id").alias("unit")).agg(F.abs(F.sum("value")).alias("mass")),
        "branch_margin": rows.groupBy("study_id", F.col("branch_id").alias("unit")).agg(F.abs(F.sum("value")).alias("mass")),
    }
    out = None
    for target, u in units.items():
        order = W.partitionBy("study_id").orderBy(F.desc("mass"), "unit")
        r = u.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("study_id")))
        wanted = [("top_k", float(k), F.least(F.lit(k), F.col("n"))) for k in top_k]
        wanted += [("top_fraction", f, F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(f))))) for f in fractions]
        a = r.groupBy("study_id").agg(F.sum("mass").alias("total"), *[F.sum(F.when(F.col("r") <= k, F.col("mass"))).alias(f"m{i}") for i, (_, _, k) in enumerate(wanted)], *[F.first(k).cast("bigint").alias(f"k{i}") for i, (_, _, k) in enumerate(wanted)])
        each = [F.struct(F.lit(s).alias("selection"), F.lit(p).alias("parameter"), F.col(f"k{i}").alias("selected_count"), F.try_divide(F.col(f"m{i}"), F.col("total")).alias("contribution")) for i, (s, p, _) in enumerate(wanted)]
        part = a.select("study_id", F.lit(target).alias("target"), F.explode(F.array(*each)).alias("x")).select("study_id", "target", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def tail_concentration(cells: DataFrame, fractions: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Cells and share of absolute mass at or beyond the lower and upper quantiles."""
    rows = available(cells)
    ps = [x for f in fractions for x in (f, 1 - f)]
    q = rows.groupBy("study_id").agg(F.percentile("value", ps).alias("q"), F.sum(F.abs("value")).alias("total"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(q, "study_id")
    aggs, each = [], []
    for i, p in enumerate(ps):
        side = "lower" if i % 2 == 0 else "upper"
        inside = (F.col("value") <= F.get("q", F.lit(i))) if side == "lower" else (F.col("value") >= F.get("q", F.lit(i)))
        aggs += [F.count_if(inside).cast("bigint").alias(f"c{i}"), F.sum(F.when(inside, F.abs("value"))).alias(f"m{i}"), F.first(F.get("q", F.lit(i))).alias(f"t{i}")]
        each.append(F.struct(F.lit(side).alias("side"), F.lit(fractions[i // 2]).alias("tail_fraction"), F.col(f"t{i}").alias("threshold"), F.col(f"c{i}").alias("cell_count"), F.try_divide(F.col(f"m{i}"), F.col("total")).alias("contribution")))
    a = joined.groupBy("study_id").agg(F.first("total").alias("total"), *aggs)
    return a.select("study_id", F.explode(F.array(*each)).alias("x")).select("study_id", "x.*")


def flags(cells: DataFrame, rule: Rule, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(flags, warnings)`` of a rule: flagged cells with their robust score, and scopes whose spread is zero.

    A custom mask is a table of cell keys; it may name only observed cells with
    a finite payload (``ContractError`` else).  A median absolute deviation of 0
    flags nothing and warns.
    """
    rows, by, v = available(cells), SCOPES[rule.scope], F.col("value")
    no_warning = rows.select("study_id", F.lit("").alias("scope_id"), F.lit("").alias("warning_code")).where("false")
    score: Column = F.lit(None).cast("double")
    if rule.method == "none":
        hit = rows.where("false")
    elif rule.method == "custom_mask":
        if mask is None or mask.join(rows, list(KEY), "left_anti").limit(1).count():
            raise ContractError("a mask names observed cells with a finite payload")
        hit = rows.join(mask.select(*KEY).distinct(), list(KEY), "left_semi")
    else:
        if rule.method == "quantile":
            bounds = rows.groupBy(*by).agg(F.percentile("value", [rule.lower_probability, rule.upper_probability]).alias("q")).select(*by, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("spread"))
        elif rule.method == "iqr":
            q = rows.groupBy(*by).agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
            spread = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
            bounds = q.select(*by, (F.get("q", F.lit(0)) - rule.multiplier * spread).alias("lo"), (F.get("q", F.lit(2)) + rule.multiplier * spread).alias("hi"), F.get("q", F.lit(1)).alias("center"), spread.alias("spread"))
        elif rule.method == "mad":
            m = rows.groupBy(*by).agg(F.median("value").alias("center"))
            s = rows.join(m, by).groupBy(*by).agg(F.first("center").alias("center"), F.median(F.abs(v - F.col("center"))).alias("spread"))
            bounds = s.select(*by, (F.col("center") - rule.multiplier * F.col("spread")).alias("lo"), (F.col("center") + rule.multiplier * F.col("spread")).alias("hi"), "center", "spread")
            scope_id = F.col(by[-1]) if len(by) > 1 else F.lit("whole_matrix")
            no_warning = s.where("spread = 0").select("study_id", scope_id.alias("scope_id"), F.lit("MAD_ZERO_UNDEFINED").alias("warning_code"))
        else:
            bounds = rows.select(*by).distinct().select(*by, F.lit(rule.lower).cast("double").alias("lo"), F.lit(rule.upper).cast("double").alias("hi"), F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("spread"))
        rows = rows.join(bounds, by)
        score = F.try_divide(v - F.col("center"), F.when(F.col("spread") > 0, F.col("spread")))
        if rule.method == "mad":
            above, below = score > rule.multiplier, score < -rule.multiplier
        elif rule.method == "quantile" and rule.ties == "inclusive":
            above, below = v >= F.col("hi"), v <= F.col("lo")
        else:
            above, below = v > F.col("hi"), v < F.col("lo")
        out = {"upper": above, "lower": below, "two_sided": F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False))}[rule.direction]
        hit = rows.where(out)
    told = hit.select(*KEY, F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.method).alias("method"), F.lit(rule.scope).alias("scope"), v.alias("diagnostic_value"), score.alias("robust_score") if rule.method not in ("none", "custom_mask") else F.lit(None).cast("double").alias("robust_score"), F.lit(rule.severity).alias("severity"), F.lit(rule.reason).alias("reason"))
    return told, no_warning


def top_cells(cells: DataFrame, top: int = 10) -> DataFrame:
    """A study's heaviest cells with their share, upper-tail rank fraction (n - #{x <= v} + 1) / n and robust score."""
    rows = available(cells)
    center = rows.groupBy("study_id").agg(F.median("value").alias("center"), F.sum(F.abs("value")).alias("total"), F.count(F.lit(1)).alias("n"))
    spread = rows.join(center, "study_id").groupBy("study_id").agg(F.median(F.abs(F.col("value") - F.col("center"))).alias("spread"))
    order = W.partitionBy("study_id").orderBy(F.desc(F.abs("value")), "gene_id", "branch_id")
    upto = F.count(F.lit(1)).over(W.partitionBy("study_id").orderBy("value").rangeBetween(W.unboundedPreceding, 0))
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("upto", upto).where(F.col("rank") <= top)
    ranked = ranked.join(center, "study_id").join(spread, "study_id")
    return ranked.select(
        *KEY, "rank", "value", F.try_divide(F.abs("value"), F.col("total")).alias("contribution"), ((F.col("n") - F.col("upto") + 1) / F.col("n")).alias("upper_tail_rank_fraction"),
        F.try_divide(F.col("value") - F.col("center"), F.when(F.col("spread") > 0, F.col("spread"))).alias("robust_score"),
    )


def extreme_ledger(rates: DataFrame, value: str, neutral: float, top: int = 5) -> DataFrame:
    """A study's highest, lowest and farthest-from-neutral cells, ties by gene then branch."""
    rows = rates.where(F.col(value).isNotNull()).select(*KEY, F.col(value).alias("rate")).withColumn("departure", F.abs(F.col("rate") - neutral))
    out = None
    for name, key in (("highest", F.desc("rate")), ("lowest", F.asc("rate")), ("largest_departure", F.desc("departure"))):
        r = rows.withColumn("rank", F.row_number().over(W.partitionBy("study_id").orderBy(key, "gene_id", "branch_id"))).where(F.col("rank") <= top).select("study_id", F.lit(name).alias("ledger"), "rank", "gene_id", "branch_id", "rate")
        out = r if out is None else out.unionByName(r)
    return out


def diagnose_rate(rates: DataFrame, value: str, neutral: float, by: list[str]) -> DataFrame:
    """Quantiles, interquartile range, scaled median absolute deviation and mean departure from the neutral value."""
    rows = rates.where(F.col(value).isNotNull()).withColumn("__v", F.col(value))
    ps = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    a = rows.groupBy(*by).agg(F.count("__v").alias("n"), F.percentile("__v", ps).alias("q"), F.avg("__v").alias("mean"), F.avg(F.abs(F.col("__v") - neutral)).alias("mean_departure"), F.count_if(F.col("__v") > neutral).cast("bigint").alias("n_above"), F.count_if(F.col("__v") < neutral).cast("bigint").alias("n_below"))
    m = rows.join(a.select(*by, F.get("q", F.lit(5)).alias("__m")), by).groupBy(*by).agg((F.median(F.abs(F.col("__v") - F.col("__m"))) * 1.4826).alias("mad"))
    return a.join(m, by).select(*by, "n", "mean", "mean_departure", "n_above", "n_below", *[F.get("q", F.lit(i)).alias(f"q{round(p * 100):03d}") for i, p in enumerate(ps)], (F.get("q", F.lit(6)) - F.get("q", F.lit(4))).alias("iqr"), "mad")


def apply_qc(cells: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with chosen ones made ineligible, and the ledger of transitions.

    ``cells`` carries ``elig_status`` and ``elig_reason``; ``chosen`` names cell
    keys.  Eligible and unresolved cells become ineligible; cells that already
    are keep their reason; values are never rewritten.
    """
    picked = chosen.select(*KEY).distinct().withColumn("__x", F.lit(True))
    rows = cells.join(picked, list(KEY), "left")
    move = F.coalesce("__x", F.lit(False)) & F.col("elig_status").isin("eligible", "unresolved")
    after = rows.withColumn("__before", F.col("elig_status")).withColumn("__move", move)
    after = after.withColumn("elig_status", F.when(F.col("__move"), "ineligible").otherwise(F.col("elig_status"))).withColumn("elig_reason", F.when(F.col("__move"), "measurement_qc_excluded").otherwise(F.col("elig_reason")))
    ledger = after.groupBy("study_id", F.col("__before").alias("status_before"), F.col("elig_status").alias("status_after")).agg(F.count(F.lit(1)).alias("n"))
    return after.drop("__x", "__before", "__move"), ledger


DOMAINS = ("auto", "signed", "nonnegative", "positive")


def overall(cells: DataFrame, value_domain: str = "auto") -> DataFrame:
    """Per study: genes, branches, cells by availability and sign, and the value domain asked for and resolved (``auto``: signed if any value is negative)."""
    if value_domain not in DOMAINS:
        raise ContractError(f"unknown value domain {value_domain}")
    observed, v = F.col("coord_state") == "observed", F.col("value")
    has = observed & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    a = cells.groupBy("study_id").agg(
        F.count_distinct("gene_id").alias("gene_count"), F.count_distinct("branch_id").alias("branch_count"), F.count(F.lit(1)).alias("cell_count"), n(observed).alias("coordinate_observed_count"), n(~observed).alias("coordinate_unavailable_count"),
        n(has).alias("payload_available_count"), n(observed & ~has).alias("observed_payload_unavailable_count"), n(has & (v == 0)).alias("exact_zero_count"), n(has & (v > 0)).alias("positive_count"), n(has & (v < 0)).alias("negative_count"))
    resolved = F.when(F.col("negative_count") > 0, "signed").otherwise("nonnegative") if value_domain == "auto" else F.lit(value_domain)
    a = a.withColumn("requested_value_domain", F.lit(value_domain)).withColumn("resolved_value_domain", resolved)
    a = a.withColumn("coordinate_observed_fraction", F.col("coordinate_observed_count") / F.col("cell_count")).withColumn("payload_available_fraction", F.try_divide("payload_available_count", "coordinate_observed_count"))
    return a.withColumn("exact_zero_fraction", F.try_divide("exact_zero_count", "payload_available_count")).withColumn("concentration_measure", F.when(F.col("resolved_value_domain") == "signed", "absolute_value").otherwise("nonnegative_value"))


def holds(profile: DataFrame) -> DataFrame:
    """Studies whose values contradict the declared domain: a HOLD with its code and the number of cells."""
    d, low, zero = F.col("requested_value_domain"), F.col("negative_count"), F.col("exact_zero_count")
    code = F.when((d == "nonnegative") & (low > 0), "DECLARED_NONNEGATIVE_DOMAIN_VIOLATION").when((d == "positive") & (low + zero > 0), "DECLARED_POSITIVE_DOMAIN_VIOLATION")
    return profile.select("study_id", F.lit("HOLD").alias("severity"), code.alias("hold_code"), F.when(d == "nonnegative", low).otherwise(low + zero).alias("n")).where("hold_code IS NOT NULL")


def metric_domains(profile: DataFrame) -> DataFrame:
    """Per study and metric: its mathematical domain, the cells admitted and lost, and what becomes of zeros."""
    n, loss = F.col("payload_available_count"), F.col("exact_zero_count") + F.col("negative_count")
    row = lambda m, d, a, l, z: F.struct(F.lit(m).alias("metric"), d.alias("mathematical_domain"), a.alias("admitted_count"), l.cast("bigint").alias("domain_loss_count"), F.lit(z).alias("zero_handling"))
    each = F.array(
        row("raw_distribution", F.lit("finite_signed"), n, F.lit(0), "retained"),
        row("contribution_concentration", F.when(F.col("resolved_value_domain") == "signed", "absolute_finite_value").otherwise("finite_nonnegative_value"), n, F.lit(0), "retained"),
        row("positive_log_distribution", F.lit("strictly_positive_finite_value"), F.col("positive_count"), loss, "outside_metric_domain_no_pseudocount"))
    return profile.select("study_id", F.explode(each).alias("x")).select("study_id", "x.*")


def profile(cells: DataFrame, value_domain: str = "auto", rules: tuple[Rule, ...] = (), top: int = 10) -> dict[str, DataFrame]:
    """All tables of the profile of every study: it diagnoses only, no value and no eligibility is changed.

    ``warnings`` has INFO rows for repeated values and for cells outside the positive logarithm, those of the rules, and one
    per rule and severity that flagged cells.  The standard profile has no rules, hence no threshold.
    """
    whole = overall(cells, value_domain)
    masses = point_masses(cells, top)
    note = lambda d, severity, code, scope_id, n: d.select("study_id", severity.alias("severity"), code.alias("warning_code"), scope_id.alias("scope_id"), n.cast("bigint").alias("n"))
    told = [
        note(masses.groupBy("study_id").agg(F.count(F.lit(1)).alias("c")), F.lit("INFO"), F.lit("EXACT_POINT_MASS_PRESENT"), F.lit("whole_matrix"), F.col("c")),
        note(whole.where("exact_zero_count + negative_count > 0"), F.lit("INFO"), F.lit("POSITIVE_ONLY_METRIC_DOMAIN_LOSS"), F.lit("whole_matrix"), F.col("exact_zero_count") + F.col("negative_count")),
    ]
    flagged = None
    for rule in rules:
        hit, warned = flags(cells, rule)
        flagged = hit if flagged is None else flagged.unionByName(hit)
        told.append(note(warned, F.lit("WARNING"), F.col("warning_code"), F.col("scope_id"), F.lit(1)))
        told.append(note(hit.groupBy("study_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("c")), F.col("severity"), F.lit("DIAGNOSTIC_FLAGS_PRESENT"), F.col("rule_id"), F.col("c")))
    warnings = told[0]
    for t in told[1:]:
        warnings = warnings.unionByName(t)
    out = {
        "overall": whole, "holds": holds(whole), "metric_domains": metric_domains(whole), "warnings": warnings, "state_counts": state_crosstab(cells), "value_distribution": value_summary(cells, ["study_id"]),
        "gene_summary": axis_summary(cells, "gene_id"), "branch_summary": axis_summary(cells, "branch_id"), "point_masses": masses, "extreme_repetition": extreme_repetition(cells), "tail_concentration": tail_concentration(cells),
        "leverage": leverage(cells), "top_cells": top_cells(cells, top),
    }
    return out if flagged is None else out | {"flags": flagged}
