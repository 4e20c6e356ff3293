"""Association of rates with branch states, its calibration by null worlds, and multiple testing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.errors import AxisError, ContractError
from cladeframe.functions.stats import average_rank
from cladeframe.operators.sets import draw_key


def domain(rates: DataFrame, states: DataFrame, excluded: DataFrame | None = None, mismatch: str = "warn") -> DataFrame:
    """Every rate cell with the state of its branch, ``eligible`` and the reason: rate, then trait, then user exclusion.

    ``rates`` has ``rate`` and ``available``; ``states`` has ``state`` and
    ``availability``.  With ``mismatch='error'`` branches on one side only are refused.
    """
    if mismatch == "error":
        a, b = rates.select("study_id", "branch_id").distinct(), states.select("study_id", "branch_id").distinct()
        if a.join(b, ["study_id", "branch_id"], "left_anti").limit(1).count() or b.join(a, ["study_id", "branch_id"], "left_anti").limit(1).count():
            raise AxisError("rates and states have different branches")
    s = states.select("study_id", "branch_id", "state", "availability")
    rows = rates.join(s, ["study_id", "branch_id"], "left")
    out = F.lit(False)
    if excluded is not None:
        rows = rows.join(excluded.select("study_id", "branch_id").distinct().withColumn("__out", F.lit(True)), ["study_id", "branch_id"], "left")
        out = F.coalesce("__out", F.lit(False))
    reason = F.when(~F.col("available"), "rate_unavailable").when(F.coalesce(F.col("availability"), F.lit("")) != "available", "trait_unavailable").when(out, "branch_user_excluded").otherwise("eligible")
    rows = rows.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")
    return rows.drop("__out") if excluded is not None else rows


def common(domains: list[DataFrame]) -> DataFrame:
    """``(study_id, gene_id, branch_id, eligible)`` over two or more association domains of the same cells: eligible where all are.

    Domains whose cells differ are refused, since counts would not be of one domain.
    """
    if len(domains) < 2:
        raise ContractError("a common domain takes two or more domains")
    key = ["study_id", "gene_id", "branch_id"]
    every = domains[0].select(*key, F.col("eligible"), F.lit(0).alias("__d"))
    for i, d in enumerate(domains[1:], 1):
        every = every.unionByName(d.select(*key, "eligible", F.lit(i).alias("__d")))
    rows = every.groupBy(*key).agg(F.every("eligible").alias("eligible"), F.count_distinct("__d").alias("n"))
    if rows.where(F.col("n") < len(domains)).limit(1).count():
        raise AxisError("the domains have different cells")
    return rows.drop("n")


def domain_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("study_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def _status(n: str, n0: str, n1: str) -> Column:
    return (
        F.when(F.col(n) == 0, "NO_ELIGIBLE_BRANCHES").when(F.col(n0) == 0, "BINARY_REFERENCE_ABSENT").when(F.col(n1) == 0, "BINARY_FOCAL_ABSENT")
        .when(F.col(n) < 3, "INSUFFICIENT_BRANCHES").otherwise("ESTIMABLE")
    )


def binary(cells: DataFrame, value: str = "rate") -> DataFrame:
    """Per gene: focal mean minus reference mean, point-biserial r and its square, counts and status; null where not estimable."""
    own = F.when(F.col("eligible"), F.col(value))
    x = F.when(F.col("eligible"), F.col("state"))
    rows = cells.groupBy("study_id", "gene_id").agg(
        F.count(own).cast("bigint").alias("n"), F.count_if(F.col("eligible") & (F.col("state") == 0)).cast("bigint").alias("n_reference"),
        F.count_if(F.col("eligible") & (F.col("state") == 1)).cast("bigint").alias("n_focal"),
        F.avg(F.when(F.col("state") == 1, own)).alias("focal_mean"), F.avg(F.when(F.col("state") == 0, own)).alias("reference_mean"),
        F.stddev_pop(own).alias("sd"), F.stddev_pop(x).alias("sx"),
    )
    rows = rows.withColumn("status", _status("n", "n_reference", "n_focal"))
    ok = F.col("status") == "ESTIMABLE"
    effect = F.col("focal_mean") - F.col("reference_mean")
    r = F.try_divide(effect * F.col("sx"), F.when(F.col("sd") > 0, F.col("sd")))
    rows = rows.withColumn("difference", F.when(ok, effect)).withColumn("r", F.when(ok, r))
    return rows.select("study_id", "gene_id", "n", "n_reference", "n_focal", "status", "difference", "r", (F.col("r") * F.col("r")).alias("r_squared"))


def continuous(cells: DataFrame, predictor: str, value: str = "rate") -> DataFrame:
    """Per gene: least-squares slope and intercept, Pearson and Spearman correlation, r squared; null without variation or under 3 branches."""
    rows = cells.where(F.col("eligible") & F.col(predictor).isNotNull()).withColumn("__x", F.col(predictor).cast("double")).withColumn("__y", F.col(value))
    by = ["study_id", "gene_id"]
    rows = rows.withColumn("__rx", average_rank("__x", by)).withColumn("__ry", average_rank("__y", by))
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.var_pop("__x").alias("vx"), F.var_pop("__y").alias("vy"), F.covar_pop("__x", "__y").alias("cxy"),
        F.var_pop("__rx").alias("vrx"), F.var_pop("__ry").alias("vry"), F.covar_pop("__rx", "__ry").alias("crxy"),
    )
    ok = (F.col("n") >= 3) & (F.col("vrx") > 0)
    both = ok & (F.col("vry") > 0)
    status = F.when(F.col("n") < 3, "INSUFFICIENT_BRANCHES").when(F.col("vrx") == 0, "NO_TRAIT_VARIATION").otherwise("ESTIMABLE")
    slope = F.when(ok, F.try_divide(F.col("cxy"), F.col("vx")))
    pearson = F.when(both, F.try_divide(F.col("cxy"), F.sqrt("vx") * F.sqrt("vy")))
    return a.select(
        *by, "n", status.alias("status"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), pearson.alias("pearson"),
        F.when(both, F.try_divide(F.col("crxy"), F.sqrt("vrx") * F.sqrt("vry"))).alias("spearman"), (pearson * pearson).alias("r_squared"),
    )


def boundary(cells: DataFrame) -> DataFrame:
    """Two components per gene, never one joint p: difference in the share of exact zeros, and in the mean log ratio of positives.

    ``cells`` has ``ratio_state``, ``positive_log``, ``state`` and ``eligible``.
    """
    e, zero = F.col("eligible"), F.when(F.col("ratio_state") == "EXACT_ZERO_BOUNDARY", 1.0).when(F.col("ratio_state") == "POSITIVE", 0.0)
    aggs = []
    for name, g in (("reference", 0), ("focal", 1)):
        s = e & (F.col("state") == g)
        aggs += [F.count(F.when(s, zero)).alias(f"n_{name}"), F.avg(F.when(s, zero)).alias(f"z_{name}"), F.count(F.when(s, F.col("positive_log"))).alias(f"p_{name}"), F.avg(F.when(s, F.col("positive_log"))).alias(f"l_{name}")]
    a = cells.groupBy("study_id", "gene_id").agg(*aggs)
    mass = a.select("study_id", "gene_id", F.lit("ZERO_MASS").alias("component"), "n_reference", "n_focal", (F.col("z_focal") - F.col("z_reference")).alias("statistic"))
    logs = a.select("study_id", "gene_id", F.lit("POSITIVE_LOG").alias("component"), F.col("p_reference").alias("n_reference"), F.col("p_focal").alias("n_focal"), (F.col("l_focal") - F.col("l_reference")).alias("statistic"))
    return mass.unionByName(logs)


STATISTICS = {"binary": ("beta", "point_biserial_r"), "continuous": ("beta", "pearson_r", "spearman_rho")}
_SCORES = "study_id string, gene_id string, replicate bigint, score double, missing bigint"
#: Cells and scores of one block of a study's genes, about.
_BLOCK = 400_000


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks down the columns."""
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, 0)
    new = np.ones(x.shape, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new, axis=0) - 1
    out = np.empty(x.shape)
    for j in range(x.shape[1]):
        first = np.flatnonzero(new[:, j])
        out[order[:, j], j] = (first + (np.diff(np.append(first, len(x))) - 1) / 2 + 1)[group[:, j]]
    return out


def _scores(values: np.ndarray, has: np.ndarray, worlds: np.ndarray, statistic: str, kind: str) -> np.ndarray:
    """Statistics (genes x worlds) of values (genes x branches; 0 where ``has`` is not) against worlds (branches x worlds); NaN where not estimable."""
    m = has.astype(float)
    n, y, yy = m.sum(1)[:, None], values.sum(1)[:, None], (values * values).sum(1)[:, None]
    with np.errstate(all="ignore"):
        if kind == "binary":
            n1, y1 = m @ worlds, values @ worlds
            score = y1 / n1 - (y - y1) / (n - n1)
            if statistic == "point_biserial_r":
                score = score * np.sqrt(n1 * (n - n1)) / np.sqrt(n * np.maximum(yy - y * y / n, 0))
            return np.where((n1 > 0) & (n1 < n), score, np.nan)
        if statistic == "spearman_rho":
            out = np.full((len(values), worlds.shape[1]), np.nan)
            for i in range(len(values)):
                if has[i].sum() >= 2:
                    x, v = _ranks(worlds[has[i]]), _ranks(values[i, has[i]][:, None])
                    x, v = x - x.mean(0), v - v.mean(0)
                    out[i] = (x * v).sum(0) / np.sqrt((x * x).sum(0) * (v * v).sum(0))
        else:
            x, xx, xy = m @ worlds, m @ (worlds * worlds), values @ worlds
            cxy, vx, vy = xy - x * y / n, xx - x * x / n, yy - y * y / n
            vx = np.where(vx > 1e-12 * np.maximum(xx, 1e-300), vx, 0)
            out = cxy / vx if statistic == "beta" else cxy / np.sqrt(vx * vy)
        return np.where(np.isfinite(out), out, np.nan)


def null_scores(cells: DataFrame, worlds: DataFrame, value: str = "rate", statistic: str = "beta", kind: str = "binary") -> DataFrame:
    """The statistic of every gene in every null world: ``worlds`` has ``(study_id, replicate, branch_id, state)``.

    The domain is frozen: a world that lacks a state for one of a gene's eligible
    branches is counted in ``missing`` and has no score.  A study's genes are worked on in blocks, each a product of
    a matrix of values with the matrix of worlds; cells are shuffled once, not once per world, and a study of
    many cells has many blocks.
    """
    if statistic not in STATISTICS.get(kind, ()):
        raise ContractError(f"{statistic} is not defined for {kind} states")
    rows = cells.where("eligible").select("study_id", "gene_id", "branch_id", F.col(value).cast("double").alias("__v"))
    given = worlds.groupBy("study_id").agg(F.count_distinct("replicate").alias("r"))
    size = rows.groupBy("study_id", "gene_id").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g")).join(given, "study_id")
    size = size.select("study_id", F.ceil((F.col("n") + F.col("g") * F.col("r")) / _BLOCK).cast("int").alias("__blocks"))
    left = rows.join(size, "study_id").withColumn("__block", F.pmod(F.xxhash64("gene_id"), F.col("__blocks")).cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("replicate").cast("bigint").alias("r"), F.col("state").cast("double").alias("s"))))
    table = worlds.groupBy("study_id", "branch_id").agg(pairs.alias("__w")).select("study_id", "branch_id", F.col("__w.r").alias("__r"), F.transform("__w", lambda x: F.coalesce(x["s"], F.lit(float("nan")))).alias("__s"))
    right = table.join(size, "study_id").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).select("study_id", "__block", "branch_id", "__r", "__s")

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(given):
            return pd.DataFrame(columns=["study_id", "gene_id", "replicate", "score", "missing"])
        genes, g = np.unique(own.gene_id.to_numpy(str), return_inverse=True)
        branches, b = np.unique(np.concatenate([own.branch_id.to_numpy(str), given.branch_id.to_numpy(str)]), return_inverse=True)
        b, wb = b[: len(own)], b[len(own) :]
        replicates = np.unique(np.concatenate([np.asarray(r) for r in given["__r"]]))
        w = np.full((len(branches), len(replicates)), np.nan)
        for i, r, x in zip(wb, given["__r"], given["__s"]):
            w[i, slice(None) if len(r) == len(replicates) else np.searchsorted(replicates, r)] = x
        values, has = np.zeros((len(genes), len(branches))), np.zeros((len(genes), len(branches)), bool)
        values[g, b], has[g, b] = own["__v"].to_numpy(float), True
        lacks = has.astype(float) @ np.isnan(w)
        score = np.where(lacks > 0, np.nan, _scores(values, has, np.nan_to_num(w), statistic, kind))
        k = len(replicates)
        return pd.DataFrame({"study_id": own.study_id.iloc[0], "gene_id": np.repeat(genes, k), "replicate": np.tile(replicates, len(genes)), "score": score.ravel(), "missing": lacks.ravel().astype(np.int64)})

    out = left.drop("__blocks").groupBy("study_id", "__block").cogroup(right.groupBy("study_id", "__block")).applyInPandas(run, _SCORES)
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


#: Scores that differ by less, relative to the observed one (or to 1), are ties: sums are not associative.
TIE = 1e-10


def calibrate(observed: DataFrame, nulls: DataFrame, n_worlds: int, alternative: str = "two_sided", statistic: str = "difference", nonestimable: str = "OBSERVED_ASSOCIATION_NONESTIMABLE") -> DataFrame:
    """p = (1 + exceedances) / (1 + worlds) with inclusive ties, its resolution and Monte Carlo error.

    A gene with any world missing or not estimable is not calibrated: no exceedances, no p.  ``reason`` says why.
    """
    if alternative not in ("two_sided", "greater", "less"):
        raise ContractError(f"unknown alternative {alternative}")
    o = observed.select("study_id", "gene_id", F.col("status").alias("observed_status"), F.col(statistic).alias("observed"))
    score, own = F.col("score"), F.col("observed")
    slack = TIE * F.greatest(F.lit(1.0), F.abs(own))
    hit = {"two_sided": F.abs(score) >= F.abs(own) - slack, "greater": score >= own - slack, "less": score <= own + slack}[alternative]
    rows = o.join(nulls, ["study_id", "gene_id"], "left")
    a = rows.groupBy("study_id", "gene_id").agg(
        F.first("observed_status").alias("observed_status"), F.first("observed").alias("observed"), F.count("score").cast("bigint").alias("n_null"),
        F.sum(F.coalesce("missing", F.lit(0))).alias("missing"), F.count_if(hit).cast("bigint").alias("hits"),
    )
    finite = F.coalesce(F.abs("observed") < float("inf"), F.lit(False))
    status = (
        F.when(F.col("observed_status") != "ESTIMABLE", nonestimable).when(~finite, "NUMERICALLY_INDETERMINATE").when(F.col("missing") > 0, "NULL_DOMAIN_MISMATCH")
        .when(F.col("n_null") < n_worlds, "NULL_CALIBRATION_INCOMPLETE").otherwise("CALIBRATED")
    )
    a = a.withColumn("status", status).withColumn("reason", (
        F.when(F.col("status") == nonestimable, F.col("observed_status")).when(F.col("status") == "NUMERICALLY_INDETERMINATE", "selected_observed_statistic_is_nonfinite")
        .when(F.col("status") == "NULL_DOMAIN_MISMATCH", "null_availability_does_not_cover_gene_frozen_association_domain")
        .when(F.col("status") == "NULL_CALIBRATION_INCOMPLETE", F.concat(F.lit("NULL_REPLICATE_NONESTIMABLE_count_"), (F.lit(n_worlds) - F.col("n_null")).cast("string")))
        .otherwise("empirical_null_calibration_complete")))
    done = F.col("status") == "CALIBRATED"
    p = F.when(done, (F.col("hits") + 1) / F.lit(n_worlds + 1.0))
    return a.select("study_id", "gene_id", "status", "reason", "observed", "n_null", F.when(done, F.col("hits")).alias("exceedances"), p.alias("p"), F.when(done, F.lit(1.0 / (n_worlds + 1))).alias("resolution"), F.sqrt(p * (1 - p) / (n_worlds + 1)).alias("mcse"))


def replicate_status(nulls: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Per study and world: genes whose calibration was open (calibrated or incomplete) and that the world leaves without a score."""
    active = calibrated.where(F.col("status").isin("CALIBRATED", "NULL_CALIBRATION_INCOMPLETE")).select("study_id", "gene_id")
    n = nulls.join(active, ["study_id", "gene_id"], "left_semi").groupBy("study_id", "replicate").agg(F.count_if(F.col("score").isNull()).cast("bigint").alias("nonestimable_gene_count"))
    return n.withColumn("status", F.when(F.col("nonestimable_gene_count") == 0, "ESTIMABLE_FOR_ALL_ACTIVE_GENES").otherwise("NULL_REPLICATE_NONESTIMABLE"))


def calibrate_boundary(cells: DataFrame, nulls: dict[str, DataFrame], ways: DataFrame | None, n_worlds: int) -> DataFrame:
    """Both components of the boundary association (zero mass, mean log ratio of positives) against each named null; no joint p is formed.

    ``cells`` are eligible boundary cells with their state; the worlds of one null serve both components.
    """
    zero = F.when(F.col("ratio_state") == "EXACT_ZERO_BOUNDARY", 1.0).otherwise(0.0)
    out = None
    for name, value, rows in (("ZERO_MASS", zero, cells), ("POSITIVE_LOG", F.col("positive_log"), cells.where("ratio_state = 'POSITIVE'"))):
        part = rows.withColumn("rate", value)
        observed = binary(part)
        for family, worlds in nulls.items():
            done = calibrate(observed, null_scores(part, worlds), n_worlds, nonestimable="OBSERVED_DIAGNOSTIC_NONESTIMABLE")
            done = done.withColumn("component", F.lit(name)).withColumn("null_family", F.lit(family))
            out = done if out is None else out.unionByName(done)
    return out if ways is None else mark_few(out, ways, n_worlds)


def joint_maximum(nulls: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Per study and world, the greatest absolute score over the calibrated genes."""
    genes = calibrated.where("status = 'CALIBRATED'").select("study_id", "gene_id")
    return nulls.join(genes, ["study_id", "gene_id"], "left_semi").groupBy("study_id", "replicate").agg(F.max(F.abs("score")).alias("max_abs"), F.count("score").alias("n_genes"))


def worlds_as_arrays(worlds: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """``(study_id, branch_id, states)`` of ``(study_id, replicate, branch_id, state)``, in the order of the replicates; ``first`` puts the observed states before them."""
    rows = worlds.select("study_id", "branch_id", F.struct(F.col("replicate").cast("bigint").alias("r"), "state").alias("x"))
    if first is not None:
        rows = rows.unionByName(first.select("study_id", "branch_id", F.struct(F.lit(-(2**62)).cast("bigint").alias("r"), "state").alias("x")))
    return rows.groupBy("study_id", "branch_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["state"]).alias("states"))


_SUMS = "study_id string, gene_id string, replicate int, n0 bigint, s0 double, q0 double, n1 bigint, s1 double, q1 double"


def group_sums(rates: DataFrame, arrays: DataFrame, value: str) -> DataFrame:
    """Mergeable statistics of both groups per gene and world: ``replicate`` is the place in the arrays, from 0.

    As in ``null_scores`` a block of a study's genes is one product of matrices; a branch counts in a world where its state is 0 or 1.
    """
    rows = rates.where(F.col(value).isNotNull()).select("study_id", "gene_id", "branch_id", F.col(value).cast("double").alias("__v"))
    size = rows.groupBy("study_id", "gene_id").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    size = size.join(arrays.groupBy("study_id").agg(F.max(F.size("states")).alias("r")), "study_id").select("study_id", F.ceil((F.col("n") + F.col("g") * F.col("r")) / _BLOCK).cast("int").alias("__blocks"))
    left = rows.join(size, "study_id").withColumn("__block", F.pmod(F.xxhash64("gene_id"), F.col("__blocks")).cast("int")).drop("__blocks")
    right = arrays.join(size, "study_id").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(given):
            return pd.DataFrame(columns=[c.split()[0] for c in _SUMS.split(", ")])
        genes, g = np.unique(own.gene_id.to_numpy(str), return_inverse=True)
        at = pd.Index(given.branch_id).get_indexer(own.branch_id)
        values, has = np.zeros((len(genes), len(given))), np.zeros((len(genes), len(given)))
        ok = at >= 0
        values[g[ok], at[ok]], has[g[ok], at[ok]] = own["__v"].to_numpy(float)[ok], 1.0
        w = np.stack([np.array(x, float) for x in given.states])
        k = w.shape[1]
        out = {"study_id": own.study_id.iloc[0], "gene_id": np.repeat(genes, k), "replicate": np.tile(np.arange(k, dtype=np.int32), len(genes))}
        for name, state in (("0", 0.0), ("1", 1.0)):
            m = (w == state).astype(float)
            out[f"n{name}"], out[f"s{name}"], out[f"q{name}"] = (has @ m).ravel().astype(np.int64), (values @ m).ravel(), ((values * values) @ m).ravel()
        return pd.DataFrame(out)

    return left.groupBy("study_id", "__block").cogroup(right.groupBy("study_id", "__block")).applyInPandas(run, _SUMS)


def permuted_worlds(states: DataFrame, n_worlds: int, stream: int = 3) -> DataFrame:
    """Null worlds that give the focal labels of a study to as many branches drawn without replacement.

    World r orders the branches by a portable key of (r, place, stream), so the worlds are the same on every engine and run.
    """
    rows = states.where(F.col("state").isin(0.0, 1.0)).select("study_id", "branch_id", "state")
    whole = W.partitionBy("study_id")
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy("branch_id")).cast("bigint")).withColumn("focal", F.sum("state").over(whole))
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_worlds))))
    k = F.row_number().over(W.partitionBy("study_id", "replicate").orderBy(draw_key(F.col("replicate").cast("bigint"), F.col("place"), stream), "place"))
    return rows.withColumn("k", k).select("study_id", "replicate", "branch_id", F.when(F.col("k") <= F.col("focal"), 1.0).otherwise(0.0).alias("state"))


def labellings(states: DataFrame) -> DataFrame:
    """Per study, in how many ways its focal labels can be given to its branches."""
    a = states.where(F.col("state").isin(0.0, 1.0)).groupBy("study_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("state") == 1).alias("k"))
    steps = F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("bigint"), "k")).otherwise(F.array().cast("array<bigint>"))
    ways = F.aggregate(steps, F.lit(1.0), lambda n, i: n * (F.col("m") - F.col("k") + i) / i)
    return a.select("study_id", F.round(ways).alias("n_labellings"))


def mark_few(calibrated: DataFrame, ways: DataFrame, n_worlds: int) -> DataFrame:
    """Calibrated rows of studies with no more labellings than worlds become TOO_FEW_LABELLINGS, without p: worlds repeat one another there."""
    rows = calibrated.join(ways, "study_id", "left")
    few = (F.col("status") == "CALIBRATED") & (F.coalesce("n_labellings", F.lit(0.0)) <= n_worlds)
    return rows.withColumn("p", F.when(~few, F.col("p"))).withColumn("status", F.when(few, "TOO_FEW_LABELLINGS").otherwise(F.col("status"))).drop("n_labellings")
