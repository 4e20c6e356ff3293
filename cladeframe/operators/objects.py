"""Constructors and validators of the keyed objects: branch states, null ensembles, eligibility, rates, associations, calibrations.

A validator gives ``(study_id, rule, n)``, one row per rule that a study's rows break; no row says that all hold.
``require`` turns such rows into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.operators.cells import KEY
from cladeframe.vocab import ASSOCIATION_STATUSES, CALIBRATION_STATUSES, ELIGIBILITY, ELIGIBILITY_REASONS, RATE_REASONS, RATIO_STATES

AVAILABILITY = ("available", "unavailable", "unresolved")


def _broken(rows: DataFrame, rules: dict[str, Column], key: tuple[str, ...] = ()) -> DataFrame:
    """Rows per rule and study; ``key`` adds the rule that a key stands once and is not null."""
    told = rows.groupBy("study_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()]).unpivot(["study_id"], list(rules), "rule", "n")
    if key:
        again = rows.groupBy("study_id", *key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("study_id").agg(F.sum("c").alias("n")).select("study_id", F.lit("repeated_key").alias("rule"), "n")
        lost = F.lit(False)
        for k in key:
            lost = lost | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
        empty = rows.where(lost).groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).select("study_id", F.lit("empty_key").alias("rule"), "n")
        told = told.unionByName(again).unionByName(empty)
    return told.where("n > 0")


def require(broken: DataFrame) -> None:
    """``ContractError`` naming up to five broken rules."""
    some = broken.orderBy("study_id", "rule").limit(5).collect()
    if some:
        raise ContractError("; ".join(f"{r.study_id}: {r.rule} in {r.n} rows" for r in some))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def branch_state_violations(states: DataFrame, kind: str = "binary", levels: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Of ``(study_id, branch_id, state, availability, reason)``: availability is known; a value stands exactly where it is available; a reason exactly where it is not.

    Available values of ``continuous`` states are finite; those of ``binary`` ones are one of the two distinct ``levels`` (reference, focal).
    """
    if kind == "binary" and (levels is None or levels[0] == levels[1]):
        raise ContractError("binary states need distinct reference and focal levels")
    has, v, a = F.col("availability") == "available", F.col("state"), F.col("availability")
    rules = {
        "unknown_availability": a.isNull() | ~a.isin(*AVAILABILITY), "value_missing": has & v.isNull(), "value_where_not_available": ~has & v.isNotNull(),
        "reason_where_available": has & F.col("reason").isNotNull(), "reason_missing": ~has & _blank(F.col("reason")),
    }
    if kind == "continuous":
        rules["value_not_finite"] = has & (F.isnan(v) | (F.abs(v) == float("inf")))
    elif kind == "binary":
        rules["value_off_coding"] = has & v.isNotNull() & ~v.isin(*levels)
    return _broken(states, rules, ("branch_id",))


def branch_states(states: DataFrame, kind: str = "binary", levels: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """``states`` if they are valid."""
    require(branch_state_violations(states, kind, levels))
    return states


def ensemble_violations(worlds: DataFrame, observed: DataFrame | None = None, kind: str = "binary", levels: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Of null worlds ``(study_id, replicate, branch_id, state, availability)``: as for branch states, and every world has every branch of its study.

    With ``observed`` states, a world that repeats them exactly is told: the observed realisation is no null replicate.
    """
    has, v = F.col("availability") == "available", F.col("state")
    rules = {"unknown_availability": F.col("availability").isNull() | ~F.col("availability").isin(*AVAILABILITY), "value_missing": has & v.isNull(), "value_where_not_available": ~has & v.isNotNull()}
    if kind == "binary":
        rules["value_off_coding"] = has & v.isNotNull() & ~v.isin(*levels)
    else:
        rules["value_not_finite"] = has & (F.isnan(v) | (F.abs(v) == float("inf")))
    out = _broken(worlds, rules, ("replicate", "branch_id"))
    n = worlds.groupBy("study_id").agg(F.count_distinct("branch_id").alias("branches"))
    gaps = worlds.groupBy("study_id", "replicate").agg(F.count_distinct("branch_id").alias("own")).join(n, "study_id").where(F.col("own") < F.col("branches"))
    out = out.unionByName(gaps.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).select("study_id", F.lit("world_lacks_branches").alias("rule"), "n"))
    if observed is not None:
        same = worlds.join(observed.select("study_id", "branch_id", F.col("state").alias("__o")), ["study_id", "branch_id"]).groupBy("study_id", "replicate").agg(F.every(v.eqNullSafe(F.col("__o"))).alias("same")).where("same")
        out = out.unionByName(same.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).select("study_id", F.lit("observed_realisation_included").alias("rule"), "n"))
    return out


def ensemble(values: DataFrame, availability: DataFrame, kind: str = "binary", levels: tuple[float, float] = (0.0, 1.0), observed_included: bool = False) -> DataFrame:
    """A null ensemble ``(study_id, replicate, branch_id, state, availability)`` from supplied worlds; refused unless valid.

    ``availability`` has one row per branch, which holds in every world, or one per world and branch.  The observed
    realisation must not be among the worlds.
    """
    if observed_included:
        raise ContractError("the observed branch state must not be inserted into the null ensemble")
    on = ["study_id", "branch_id"] + (["replicate"] if "replicate" in availability.columns else [])
    worlds = values.select("study_id", "replicate", "branch_id", "state").join(availability.select(*on, "availability"), on, "left")
    require(ensemble_violations(worlds, None, kind, levels))
    return worlds


def eligibility_violations(cells: DataFrame) -> DataFrame:
    """Of cells with ``elig_status`` and ``elig_reason``: known labels, and each status with the reasons and coordinates that it may have."""
    s, r, observed = F.col("elig_status"), F.col("elig_reason"), F.col("coord_state") == "observed"
    return _broken(cells, {
        "label_missing": _blank(s) | _blank(r), "unknown_status": s.isNotNull() & ~s.isin(*ELIGIBILITY), "unknown_reason": r.isNotNull() & ~r.isin(*ELIGIBILITY_REASONS),
        "status_off_observed": ~observed & (s != "not_applicable"), "not_applicable_where_observed": observed & (s == "not_applicable"),
        "not_applicable_reason": (s == "not_applicable") != (r == "coordinate_not_observed"), "eligible_reason": (s == "eligible") & (r != "eligible_declared"),
        "unresolved_reason": (s == "unresolved") & (r != "authority_unresolved"), "exclusion_reason_missing": (s == "ineligible") & r.isin("eligible_declared", "authority_unresolved", "coordinate_not_observed"),
    }, ("gene_id", "branch_id"))


def rate_violations(rates: DataFrame, method: str) -> DataFrame:
    """Of a rate: known reasons; a finite value exactly where it is available; the reason agrees; no negative ratio; the zero origin stands with the value."""
    v, a, r = F.col("rate"), F.col("available"), F.col("reason")
    rules = {
        "unknown_reason": r.isNull() | ~r.isin(*RATE_REASONS), "value_missing": a & v.isNull(), "value_where_not_available": ~a & v.isNotNull(), "value_not_finite": F.isnan(v) | (F.abs(v) == float("inf")), "reason_disagrees": a != (r == "available"),
    }
    if method == "GBI":
        o = F.col("zero_origin")
        rules |= {"negative_ratio": v < 0, "zero_origin_disagrees": a & ~F.coalesce(F.when(v == 0, o == "numerator_zero").otherwise(o == "positive"), F.lit(False)), "zero_origin_where_not_available": ~a & o.isNotNull()}
    return _broken(rates, rules, ("gene_id", "branch_id"))


def boundary_violations(boundary: DataFrame) -> DataFrame:
    """Of the boundary object: known states; a finite logarithm exactly where it is positive; a reason exactly where it is unavailable."""
    s, v, r = F.col("ratio_state"), F.col("positive_log"), F.col("unavailability_reason")
    return _broken(boundary, {
        "unknown_state": s.isNull() | ~s.isin(*RATIO_STATES), "log_missing": (s == "POSITIVE") & v.isNull(), "log_off_positive": (s != "POSITIVE") & v.isNotNull(), "log_not_finite": F.isnan(v) | (F.abs(v) == float("inf")),
        "reason_missing": (s == "UNAVAILABLE") & (_blank(r) | (r == "not_applicable")), "reason_off_unavailable": (s != "UNAVAILABLE") & (r != "not_applicable"),
    }, ("gene_id", "branch_id"))


def association_violations(associated: DataFrame) -> DataFrame:
    """Of a binary association: known status; an effect exactly where it is estimable; counts that add up; correlations within 1."""
    s, n = F.col("status"), F.col("n")
    return _broken(associated, {
        "unknown_status": s.isNull() | ~s.isin(*ASSOCIATION_STATUSES), "effect_missing": (s == "ESTIMABLE") & F.col("difference").isNull(), "effect_where_not_estimable": (s != "ESTIMABLE") & F.col("difference").isNotNull(),
        "counts_disagree": n != F.col("n_reference") + F.col("n_focal"), "correlation_off_range": F.abs("r") > 1 + 1e-9, "too_few_branches": (s == "ESTIMABLE") & (n < 3),
    }, ("gene_id",))


def calibration_violations(calibrated: DataFrame, n_worlds: int, component: tuple[str, ...] = ()) -> DataFrame:
    """Of a calibration: known status; p, exceedances, resolution and error exactly where it is calibrated; p as the counts say."""
    s, p, e = F.col("status"), F.col("p"), F.col("exceedances")
    done = s == "CALIBRATED"
    return _broken(calibrated, {
        "unknown_status": s.isNull() | ~s.isin(*CALIBRATION_STATUSES), "p_missing": done & p.isNull(), "p_where_not_calibrated": ~done & p.isNotNull(), "exceedances_off_range": (e < 0) | (e > n_worlds),
        "worlds_missing": done & (F.col("n_null") != n_worlds), "p_disagrees": done & (F.abs(p - (e + 1) / (n_worlds + 1)) > 1e-12),
    }, (*component, "gene_id"))


def adjustment_violations(adjusted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of adjusted p: between p and 1, present exactly with p, and as many tests as p in the family."""
    p = F.col("p")
    names = [c for c in ("p_bh", "p_by", "p_holm", "p_bonferroni") if c in adjusted.columns]
    rules = {}
    for c in names:
        rules |= {f"{c}_presence": p.isNull() != F.col(c).isNull(), f"{c}_off_range": (F.col(c) < p - 1e-12) | (F.col(c) > 1 + 1e-12)}
    return _broken(adjusted, rules, (*by, "gene_id"))


def fit_violations(fitted: DataFrame) -> DataFrame:
    """Of a fit: mu where certified and nowhere else, above 0 on the support and 0 off it, never 0 under a positive value."""
    mu, y, inside = F.col("mu"), F.col("y"), F.col("support_state") == "FINITE_INTERIOR"
    return _broken(fitted, {
        "mu_missing": F.col("certified") & mu.isNull(), "mu_where_not_certified": ~F.col("certified") & mu.isNotNull(), "mu_not_positive_on_support": inside & (mu <= 0), "mu_off_support": ~inside & (mu != 0), "positive_value_on_zero": (y > 0) & (mu == 0), "negative_value": y < 0,
    }, KEY[1:])


def dependency_status(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Per study: CURRENT, or STALE_DEPENDENCY where the hash that an object was derived from is no longer that of its source.

    Both have ``(study_id, sha256)``; a study without a source is stale, one that was never derived does not come out.
    """
    rows = stored.select("study_id", F.col("sha256").alias("a")).join(current.select("study_id", F.col("sha256").alias("b")), "study_id", "left")
    return rows.select("study_id", F.when(F.col("a").eqNullSafe(F.col("b")) & F.col("b").isNotNull(), "CURRENT").otherwise("STALE_DEPENDENCY").alias("dependency_status"))
