"""Rate representations of cells against a fitted baseline, and the three-state boundary object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import AxisError, ContractError, RefusedError
from cladeframe.operators.cells import KEY

METHODS = ("ADD_LT", "GBI", "logGBI_strict")
FORBIDDEN = ("pseudocount", "floor", "trim", "winsorize", "trait", "baseline")


def rate_spec(method: str, **parameters) -> str:
    """The method, if it may be used; parameters that would alter values are refused."""
    if method == "logGBI":
        raise RefusedError("logGBI is not constructed anew: use the boundary object, or logGBI_strict on positive cells")
    if method.startswith(("ADD_C2", "GBI_C2", "logGBI_C2")):
        raise RefusedError("the sensitivity baseline is never selected as the production baseline")
    if method not in METHODS:
        raise ContractError(f"unknown rate method {method}")
    bad = sorted(set(parameters) & set(FORBIDDEN))
    if bad:
        raise RefusedError(f"parameters that change values are not taken: {', '.join(bad)}")
    return method


def ratio_contract(fitted: DataFrame) -> DataFrame:
    """Per study: edges with a positive value on a zero baseline (fatal if any), and edges on a zero baseline."""
    zero = F.col("mu") == 0
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    return fitted.groupBy("study_id").agg(n((F.col("y") > 0) & zero).alias("fatal"), n(zero).alias("baseline_zero"), n(F.col("mu") > 0).alias("ratio_available"))


def rate(cells: DataFrame, fitted: DataFrame, method: str) -> DataFrame:
    """Every cell with ``rate``, ``available``, ``reason``, ``support`` and ``zero_origin`` under one representation.

    ADD_LT is y - mu, GBI is y / mu, logGBI_strict its natural logarithm where y > 0.
    ``zero_origin`` says of a ratio whether it is positive or an exact zero of the numerator.
    """
    rate_spec(method)
    f = fitted.select(*KEY, F.col("y").alias("__y"), F.col("mu").alias("__mu"), F.col("support_state").alias("__s"))
    rows = cells.join(f, list(KEY), "left")
    y, mu = F.col("__y"), F.col("__mu")
    edge, positive, zero = y.isNotNull(), (y > 0) & (mu > 0), (y == 0) & (mu > 0)
    available = {"ADD_LT": edge & mu.isNotNull(), "GBI": edge & (mu > 0), "logGBI_strict": positive}[method]
    available = F.coalesce(available, F.lit(False))
    value = {"ADD_LT": y - mu, "GBI": F.try_divide(y, mu), "logGBI_strict": F.ln(F.when(positive, y / mu))}[method]
    observed = F.col("coord_state") == "observed"
    elig = F.col("elig_status") if "elig_status" in cells.columns else F.when(edge, "eligible").when(observed, "unresolved").otherwise("not_applicable")
    reason = (
        F.when(available, "available").when(edge & mu.isNull(), "numeric_indeterminate").when(edge & (mu == 0), "baseline_zero").when(edge, "input_zero_log_undefined")
        .when(~observed, "coordinate_unavailable").when(elig == "ineligible", "measurement_ineligible").when(F.col("value").isNull() & (elig == "eligible"), "observed_payload_unavailable")
        .otherwise("measurement_unresolved")
    )
    origin = F.when(positive, "positive").when(zero, "numerator_zero")
    return rows.select(
        *KEY, F.when(available, value).alias("rate"), available.alias("available"), reason.alias("reason"), F.coalesce("__s", F.lit("BASELINE_UNAVAILABLE")).alias("support"),
        (origin if method == "GBI" else F.lit(None).cast("string")).alias("zero_origin"),
    )


C2_METHODS = ("ADD_C2", "GBI_C2", "logGBI_C2")


def c2_rate(cells: DataFrame, evaluated: DataFrame, method: str) -> DataFrame:
    """A rate on the sensitivity baseline, never a production rate: as ``rate``, with the support labels of that baseline.

    ``evaluated`` is ``c2.evaluate``: cells with their ``c2_state`` and ``mu``.
    """
    if method not in C2_METHODS:
        raise ContractError(f"unknown sensitivity rate {method}")
    f = evaluated.select(*KEY, F.col("y").alias("__y"), F.col("mu").alias("__mu"), F.col("c2_state").alias("__s"))
    rows = cells.join(f, list(KEY), "left")
    y, mu, state, observed = F.col("__y"), F.col("__mu"), F.col("__s"), F.col("coord_state") == "observed"
    edge, base = y.isNotNull(), mu.isNotNull()
    available = F.coalesce(base & (y > 0) if method == "logGBI_C2" else base, F.lit(False))
    value = {"ADD_C2": y - mu, "GBI_C2": F.try_divide(y, mu), "logGBI_C2": F.ln(F.when(y > 0, y / mu))}[method]
    elig = F.col("elig_status") if "elig_status" in cells.columns else F.when(edge, "eligible").when(observed, "unresolved").otherwise("not_applicable")
    reason = (
        F.when(available, "available").when(edge & base, "input_zero_log_undefined").when(edge & (state == "cross_component"), "cross_component_baseline_unavailable").when(edge, "baseline_unavailable")
        .when(~observed, "coordinate_unavailable").when(elig == "ineligible", "measurement_ineligible").when(F.col("value").isNull() & (elig == "eligible"), "observed_payload_unavailable").otherwise("measurement_unresolved")
    )
    support = F.when(base, "C2_SUPPORTED").when(state == "cross_component", "C2_CROSS_COMPONENT").when(edge, "C2_UNSUPPORTED_VERTEX").otherwise("BASELINE_UNAVAILABLE")
    return rows.select(*KEY, F.when(available, value).alias("rate"), available.alias("available"), reason.alias("reason"), support.alias("support"))


def encoded_mismatches(view: DataFrame, boundary: DataFrame, depth: float = 10.0) -> DataFrame:
    """Cells of an encoded view that its source boundary object does not give again: ``issue`` is ``view_only``, ``source_only``, ``value`` or ``zero_flag``.

    A subset view is compared on its own cells, with the sentinel of the full source.
    """
    again = encoded(boundary, None, depth).select(*KEY, F.col("encoded").alias("__e"), F.col("zero_encoded").alias("__z"), F.lit(True).alias("__s"))
    rows = view.select(*KEY, "encoded", "zero_encoded", F.lit(True).alias("__v")).join(again, list(KEY), "left")
    issue = F.when(F.col("__s").isNull(), "view_only").when(~F.col("encoded").eqNullSafe(F.col("__e")), "value").when(~F.col("zero_encoded").eqNullSafe(F.col("__z")), "zero_flag")
    return rows.select(*KEY, issue.alias("issue")).where("issue IS NOT NULL")


def log_relative(gbi: DataFrame) -> DataFrame:
    """The boundary object of a GBI rate: POSITIVE with its logarithm, EXACT_ZERO_BOUNDARY, or UNAVAILABLE with the reason.

    A zero counts only if its numerator is an exact zero; any other zero is numerically indeterminate.  No number stands for a zero.
    """
    pos = F.col("available") & (F.col("rate") > 0)
    zero = F.col("available") & (F.col("rate") == 0)
    sure = zero & (F.col("zero_origin") == "numerator_zero")
    state = F.when(pos, "POSITIVE").when(F.coalesce(sure, F.lit(False)), "EXACT_ZERO_BOUNDARY").otherwise("UNAVAILABLE")
    reason = F.when(state != "UNAVAILABLE", "not_applicable").when(zero, "numeric_indeterminate").otherwise(F.col("reason"))
    return gbi.select(*KEY, state.alias("ratio_state"), reason.alias("unavailability_reason"), F.when(pos, F.ln("rate")).alias("positive_log"))


def encoded(boundary: DataFrame, subset: DataFrame | None = None, depth: float = 10.0) -> DataFrame:
    """The diagnostic finite view: zeros at the least positive logarithm of the *whole* study minus ``depth``.

    A subset keeps the sentinel of the full source.  A study without a positive cell is NONESTIMABLE.
    """
    low = boundary.groupBy("study_id").agg(F.min("positive_log").alias("low"))
    rows = boundary if subset is None else boundary.join(subset, [c for c in KEY if c in subset.columns], "left_semi")
    rows = rows.join(low, "study_id")
    zero = F.col("ratio_state") == "EXACT_ZERO_BOUNDARY"
    value = F.when(F.col("ratio_state") == "POSITIVE", F.col("positive_log")).when(zero, F.col("low") - depth)
    return rows.select(*KEY, "ratio_state", value.alias("encoded"), (zero & value.isNotNull()).alias("zero_encoded"), F.when(F.col("low").isNull(), "NONESTIMABLE").otherwise("DIAGNOSTIC_ONLY").alias("use_status"))


def refuse_inference(kind: str) -> None:
    """Encoded and historical objects take part in no inference."""
    if kind in ("encoded", "legacy"):
        raise RefusedError(f"{kind} objects are for display and replay only")


def migrate(old: DataFrame, gbi: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """A historical log rate to the boundary object of its source GBI; positives must equal ln GBI, and a zero is never read from a sentinel."""
    both = old.select(*KEY, F.col("rate").alias("__old")).join(gbi.select(*KEY, F.col("rate").alias("__new")), list(KEY), "full")
    off = both.where((F.col("__new") > 0) & ~F.coalesce(F.abs(F.col("__old") - F.ln(F.when(F.col("__new") > 0, F.col("__new")))) <= tolerance, F.lit(False)))
    n = off.count()
    if n:
        raise ContractError(f"{n} positive cells differ from the logarithm of their source")
    return log_relative(gbi)


def common_domain(rates: dict[str, DataFrame]) -> DataFrame:
    """Per study: cells available in all and in any of the rates, the share lost, and whether the domains are equal."""
    parts = [r.select(*KEY, F.lit(n).alias("name"), "available") for n, r in rates.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cell = every.groupBy(*KEY).agg(F.every("available").alias("all"), F.some("available").alias("any"), F.count(F.lit(1)).alias("n"))
    inside = F.count_if(F.col("all") & (F.col("n") == len(rates)))
    out = cell.groupBy("study_id").agg(inside.cast("bigint").alias("n_common"), F.count_if("any").cast("bigint").alias("n_union"))
    return out.withColumn("loss", F.try_divide(F.col("n_union") - F.col("n_common"), F.col("n_union"))).withColumn("label", F.when(F.col("n_common") == F.col("n_union"), "EQUAL").otherwise("UNEQUAL"))


def compatible(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per study, whether two rates may be compared: the same cells (each once), coordinate states and fitted baseline (a null on both sides is the same).

    Both have ``coord_state`` and ``mu`` beside the cell keys; ``n_cells`` counts the cells of either.
    """
    rows = first.select(*KEY, F.lit(1).alias("a"), F.col("coord_state").alias("sa"), F.col("mu").alias("ma")).join(
        second.select(*KEY, F.lit(1).alias("b"), F.col("coord_state").alias("sb"), F.col("mu").alias("mb")), list(KEY), "full")
    return rows.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.every(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same_cells"),
        F.every(F.col("sa").eqNullSafe(F.col("sb"))).alias("same_states"), F.every(F.col("ma").eqNullSafe(F.col("mb"))).alias("same_baseline"))


def require_compatible(first: DataFrame, second: DataFrame, same_baseline: bool = True) -> None:
    """``AxisError`` naming up to five studies whose rates may not be compared."""
    ok = F.col("same_cells") & F.col("same_states") & (F.col("same_baseline") if same_baseline else F.lit(True))
    some = compatible(first, second).where(~ok).limit(5).collect()
    if some:
        raise AxisError("rates are not compatible: " + ", ".join(str(r.study_id) for r in some))


def compare_pair(first: DataFrame, second: DataFrame, positive_ratio: bool = False) -> DataFrame:
    """Per study, on cells available in both: n, Pearson and Spearman correlation, quantiles of second minus first, and of ln(second / first).

    The logarithm is taken of positive pairs and only where ``positive_ratio`` says that ratios mean something.
    """
    from cladeframe.functions.stats import average_rank

    a = first.where("available").select(*KEY, F.col("rate").alias("a"))
    rows = a.join(second.where("available").select(*KEY, F.col("rate").alias("b")), list(KEY))
    both = (F.col("a") > 0) & (F.col("b") > 0) & F.lit(positive_ratio)
    rows = rows.withColumn("ra", average_rank("a", ["study_id"])).withColumn("rb", average_rank("b", ["study_id"])).withColumn("d", F.col("b") - F.col("a")).withColumn("l", F.when(both, F.ln(F.col("b") / F.col("a"))))
    varied = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    out = rows.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n"), F.when(varied, F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("pearson"),
        F.when(varied, F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))).alias("spearman"),
        F.median(F.abs("d")).alias("median_abs_difference"), F.max(F.abs("d")).alias("max_abs_difference"),
        F.percentile("d", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"), F.count("l").alias("positive_ratio_count"), F.percentile("l", [0.05, 0.5, 0.95]).alias("ql"),
    )
    at = lambda c, i, n: F.get(c, F.lit(i)).alias(n)
    return out.select(
        "study_id", "n", "pearson", "spearman", at("q", 2, "median_difference"), "median_abs_difference", *[at("q", i, f"difference_{n}") for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))],
        "max_abs_difference", "positive_ratio_count", *[at("ql", i, n) for i, n in enumerate(("log_ratio_q05", "median_log_ratio", "log_ratio_q95"))])
