"""Grouped validation: folds, roles, train-only design, lasso fits, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.operators.baseline import held_out_statistics, strict_prefix, welch
from cladeframe.workspace import spread, unbroadcast


def make_folds(terminals: DataFrame, base: int, offset: int = 0) -> DataFrame:
    """One fold per genus in bytewise order, seed = base + place + offset."""
    genera = terminals.where("genus IS NOT NULL").select("study_id", "genus").distinct()
    place = F.row_number().over(W.partitionBy("study_id").orderBy("genus"))
    return genera.select("study_id", place.alias("fold_ord"), F.concat(F.lit("fold_"), F.lpad(place.cast("string"), 3, "0")).alias("fold_id"), "genus", (F.lit(base + offset) + place).cast("bigint").alias("seed"))


def roles(terminals: DataFrame, folds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The role of every terminal in every fold of its study: intermediate states are excluded, the fold's genus is held out.

    ``keep`` names further columns of ``folds`` that come out too.
    """
    rows = folds.select("study_id", "fold_id", *keep, F.col("genus").alias("__held_out")).join(unbroadcast(terminals), "study_id")
    role = F.when(F.col("state") == 0.5, "excluded").when(F.col("genus") == F.col("__held_out"), "test").otherwise("train")
    return rows.select("study_id", "fold_id", "branch_id", "species", "genus", "state", role.alias("role"), *keep)


def role_counts(assigned: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("role") == r).cast("bigint").alias(f"n_{r}")
    return assigned.groupBy("study_id", "fold_id").agg(n("train"), n("test"), n("excluded"))


def design(rates: DataFrame, terminals: DataFrame, value: str = "gbi") -> DataFrame:
    """Per held-out genus and gene, from training rows only: values, mean, and the standard deviation after mean imputation.

    ``n_train`` counts the training terminals; genes without a training value or without variance are marked as dropped.
    Statistics are a gene's totals minus the held-out genus', so the cells are read once for all folds.
    """
    both = terminals.where(F.col("state").isin(0.0, 1.0))
    stats = held_out_statistics(rates, both.drop("genus"), both, value)
    n, s, q = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1"), F.col("q0") + F.col("q1")
    total = both.groupBy("study_id").agg(F.count(F.lit(1)).alias("all_n"))
    held = both.groupBy("study_id", "genus").agg(F.count(F.lit(1)).alias("own"))
    rows = stats.join(total, "study_id").join(held, ["study_id", "genus"], "left").withColumn("n_train", F.col("all_n") - F.coalesce("own", F.lit(0)))
    mean = F.try_divide(s, n)
    sd = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), q - F.try_divide(s * s, n)), F.col("n_train") - 1))
    drop = F.when(n == 0, "all_missing").when(~(sd > 1e-12), "zero_variance")
    return rows.select("study_id", "genus", "gene_id", n.cast("bigint").alias("n_values"), F.col("n_train").cast("bigint").alias("n_train"), mean.alias("mean"), sd.alias("sd"), drop.alias("dropped"))


def fold_features(rates: DataFrame, terminals: DataFrame, value: str = "gbi", level: float = 0.01, branches: DataFrame | None = None) -> DataFrame:
    """Genes selected in each fold by the Welch screen on training branches: ``(study_id, genus, gene_id, t, p)``, strict prefix at ``level``.

    ``branches`` has the states of all screened branches (internal ones by reconstruction); only the held-out genus' terminals
    are taken out of the statistics.  Without it the terminals alone are screened.
    """
    return fold_screen(rates, terminals, value, level, branches).where("selected").select("study_id", "genus", "gene_id", "t", "p")


def fold_screen(rates: DataFrame, terminals: DataFrame, value: str = "gbi", level: float = 0.01, branches: DataFrame | None = None) -> DataFrame:
    """Every tested gene of every fold with t, p and ``selected``."""
    known = terminals.where(F.col("state").isin(0.0, 1.0))
    states = known.select("study_id", "branch_id", "state") if branches is None else branches.where(F.col("state").isin(0.0, 1.0)).select("study_id", "branch_id", "state")
    named = states.join(unbroadcast(known.select("study_id", "branch_id", "genus")), ["study_id", "branch_id"], "left")
    # A gene without a value in the study is tested in no fold.
    tested = welch(held_out_statistics(rates.where(F.col(value).isNotNull()), states, named, value)).where("p IS NOT NULL")
    return strict_prefix(tested, "p", ["study_id", "genus"], ["gene_id"], level)


def lasso_paths(x: np.ndarray, y: np.ndarray, weights: np.ndarray, lambdas: np.ndarray, tolerance: float = 1e-7, rounds: int = 30, sweeps: int = 300, stop=None) -> np.ndarray:
    """L1-penalised logistic regressions of several weightings of the same rows at once: (weightings, lambdas, 1 + features), intercepts first.

    Each row of ``weights`` sums to 1.  Every lambda starts from the one before; each quadratic approximation is reduced to its
    weighted moments and solved by coordinate descent until no step moves the objective by more than ``tolerance``.
    ``stop``, asked after every lambda with the coefficients so far, may end the path.
    """
    k, a = len(weights), np.column_stack([np.ones(len(x)), x])
    m = np.clip(weights @ y, 1e-9, 1 - 1e-9)
    b = np.zeros((k, a.shape[1]))
    b[:, 0] = np.log(m / (1 - m))
    out = np.empty((k, len(lambdas), a.shape[1]))
    pairs = np.einsum("np,nq->npq", a, a).reshape(len(a), -1) if a.shape[1] <= 65 else None
    for i, lam in enumerate(lambdas):
        for _ in range(rounds):
            eta = np.clip(b @ a.T, -30, 30)
            mu = 1 / (1 + np.exp(-eta))
            v = weights * np.maximum(mu * (1 - mu), 1e-5)
            gram = (v @ pairs).reshape(k, a.shape[1], -1) if pairs is not None else np.stack([(a * w[:, None]).T @ a for w in v])
            curve = np.maximum(np.einsum("kjj->kj", gram), 1e-12)
            slope = (weights * (y - mu)) @ a  # of the log-likelihood at b, kept up below
            start = b.copy()
            for _ in range(sweeps):
                moved = 0.0
                for j in range(a.shape[1]):
                    u = slope[:, j] + curve[:, j] * b[:, j]
                    new = (u if j == 0 else np.sign(u) * np.maximum(np.abs(u) - lam, 0)) / curve[:, j]
                    step = new - b[:, j]
                    if step.any():
                        b[:, j] = new
                        slope -= step[:, None] * gram[:, j]
                        moved = max(moved, float((curve[:, j] * step * step).max()))
                if moved < tolerance:
                    break
            if float((curve * (b - start) ** 2).max()) < tolerance:
                break
        out[:, i] = b
        if stop is not None and stop(out[:, : i + 1]):
            return out[:, : i + 1]
    return out


def _deviance(eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(1 / (1 + np.exp(-np.clip(eta, -30, 30))), 1e-5, 1 - 1e-5)
    return -2 * (y * np.log(p) + (1 - y) * np.log(1 - p))


def _lanes(x: np.ndarray, y: np.ndarray, lambdas: np.ndarray, left: np.ndarray, start: np.ndarray, times: np.ndarray | None = None, tolerance: float = 1e-7, rounds: int = 200, sweeps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The regressions of ``lasso_paths`` side by side, each (a lane) with a lambda, a row left out (-1: none) and start values of its own.

    ``start`` and the first result are (1 + features, lanes), intercepts first; a ``start`` of fewer columns is taken again and again.
    ``times`` says how often each row stands, of which a lane leaves one out.  The second result names the lanes that still move after
    all ``rounds``.  The intercept is solved exactly within each quadratic approximation, so one feature takes a single sweep.
    A step that would move a row's linear predictor by more than ``LANE_STEP`` (within the bounds of 30) is shortened, since the approximation does not reach as far.
    """
    n, p = x.shape
    times = np.ones(n) if times is None else times
    a = np.column_stack([np.ones(n), x])
    i, j = np.triu_indices(p + 1)
    pairs = a[:, i] * a[:, j]
    own, counted = np.ascontiguousarray(pairs.T), np.ascontiguousarray((pairs * times[:, None]).T)
    widest, weighed = np.abs(a).max(0), np.ascontiguousarray((a * times[:, None]).T)
    todo = np.arange(len(left))
    at = todo % start.shape[1]
    b = start[:, at]
    for turn in range(rounds):
        c, lam, out = b[:, todo], lambdas[todo], left[todo]
        mu = a @ (c if turn else start)
        np.clip(mu, -30, 30, out=mu)
        np.negative(mu, out=mu)
        np.exp(mu, out=mu)
        mu += 1
        np.reciprocal(mu, out=mu)
        v = 1 - mu
        v *= mu
        np.maximum(v, 1e-10, out=v)
        np.subtract(y[:, None], mu, out=mu)
        slope, packed = weighed @ mu, counted @ v
        if not turn:
            slope, packed = slope[:, at], packed[:, at]
        lane = np.flatnonzero(out >= 0)
        if len(lane):
            row, of = out[lane], lane if turn else at[lane]
            slope[:, lane] -= a[row].T * mu[row, of]
            packed[:, lane] -= own[:, row] * v[row, of]
        weight = 1 / (times.sum() - (out >= 0))
        slope *= weight
        packed *= weight
        gram = np.empty((p + 1, p + 1, len(todo)))
        gram[i, j] = gram[j, i] = packed
        across = gram[0, 1:] / gram[0, 0]
        inner = gram[1:, 1:] - gram[1:, :1] * across
        pull = slope[1:] - across * slope[0]
        curve = np.maximum(np.einsum("jjk->jk", inner), 1e-12)
        new = c[1:].copy()
        for _ in range(sweeps):
            moved = 0.0
            for k in range(p):
                u = pull[k] + curve[k] * new[k]
                step = np.sign(u) * np.maximum(np.abs(u) - lam, 0) / curve[k] - new[k]
                if step.any():
                    new[k] += step
                    if p > 1:
                        pull -= inner[k] * step
                        moved = max(moved, float((curve[k] * step * step).max()))
            if moved < tolerance:
                break
        if p > 1 and turn >= LANE_TURNS:
            new = _settled(inner, pull, new, lam)
        step = np.concatenate([slope[:1] / gram[0, 0] - (across * (new - c[1:])).sum(0, keepdims=True), new - c[1:]])
        # No row moves by more than this; only where it may be too far are the rows looked at.
        long = np.flatnonzero(widest @ np.abs(step) > LANE_STEP)
        if len(long):
            here = c[:, long]
            far = np.abs(np.clip(a @ (here + step[:, long]), -30, 30) - np.clip(a @ here, -30, 30)).max(0)
            step[:, long] *= LANE_STEP / np.maximum(far, LANE_STEP)
        b[:, todo] = c + step
        todo = todo[(np.einsum("jjk->jk", gram) * step * step).max(0) >= tolerance]
        if not len(todo):
            break
    return b, todo


def _settled(inner: np.ndarray, pull: np.ndarray, near: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The exact optimum of each lane's quadratic approximation, given the signs of the solution ``near`` it; where the signs do not hold, ``near``.

    Steps along one coordinate after another come to rest too early where features nearly tell the same.
    """
    sign = np.sign(near)
    on = sign != 0
    goal = pull + np.einsum("jik,ik->jk", inner, near)
    part = np.where(on[:, None] & on[None], inner, 0)
    diagonal = np.arange(len(near))
    part[diagonal, diagonal] = np.where(on, part[diagonal, diagonal] * (1 + 1e-12), 1)
    z = np.linalg.solve(part.transpose(2, 0, 1), np.where(on, goal - lam * sign, 0).T[:, :, None])[:, :, 0].T
    rest = np.abs(goal - np.einsum("jik,ik->jk", inner, z))
    return np.where((np.isfinite(z) & (np.sign(z) == sign) & (on | (rest <= lam * (1 + 1e-9)))).all(0), z, near)


#: Numbers of a block of lanes in one array of ``_lanes`` (they stay in the processor's cache), the most features of a fit that is solved in lanes, the longest step, and the rounds after which lanes are settled.
LANE_NUMBERS, LANE_FEATURES, LANE_STEP, LANE_TURNS = 200_000, 64, 2.0, 6


def _path_lanes(x: np.ndarray, y: np.ndarray, lambdas: np.ndarray, ended) -> tuple[np.ndarray, np.ndarray] | None:
    """The path on all rows up to the first lambda at which it has ``ended``, (lambdas, 1 + features), and the linear predictor of each row by the paths without it, (rows, lambdas).

    Equal rows have the same path without one of them, which is found once.
    A row without which a fit still moves after all rounds is gone through from lambda to lambda instead; None where the path on all rows has such a fit.
    """
    p = x.shape[1]
    m, begin = y.mean(), np.zeros((p + 1, len(lambdas)))
    begin[0] = np.log(m / (1 - m))
    rows, which, times = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True, return_counts=True)
    x, y, times, n = np.ascontiguousarray(rows[:, :-1]), rows[:, -1].copy(), times.astype(float), len(rows)
    full, moving = _lanes(x, y, lambdas, np.full(len(lambdas), -1), begin, times, tolerance=1e-11)
    full[:, 0] = begin[:, 0]  # the greatest lambda has no coefficient; rounding may leave one
    over = ended(full.T)
    length = int(np.argmax(over)) + 1 if over.any() else len(lambdas)
    if (moving < length).any():
        return None
    eta = np.empty((n, length))
    at = max(1, LANE_NUMBERS // max(n, (p + 1) ** 2) // length)
    for k in range(0, n, at):
        rows = np.arange(k, min(k + at, n))
        left = np.repeat(rows, length)
        b, moving = _lanes(x, y, np.tile(lambdas[:length], len(rows)), left, full[:, :length], times)
        eta[rows] = (b[0] + (b[1:] * x[left].T).sum(0)).reshape(len(rows), length)
        for row in np.unique(left[moving]):
            path = lasso_paths(x, y, ((times - (np.arange(n) == row)) / (times.sum() - 1))[None], lambdas[:length])[0]
            eta[row] = path[:, 0] + path[:, 1:] @ x[row]
    return full[:, :length].T, eta[which.reshape(-1)]


def fit_lasso(x: np.ndarray, y: np.ndarray, n_lambdas: int = 100) -> tuple[float, np.ndarray, float]:
    """Intercept, coefficients and lambda of least leave-one-out deviance, refitted on all rows.

    The path has 100 values from the least lambda without a coefficient down to 0.01 (fewer rows than features) or 0.0001 of
    it, and ends early once the deviance no longer falls.  One row is left out at a time, whatever the number of rows.
    Fits of few features are solved for all lambdas and rows at once, others from lambda to lambda; the optimum is the same.
    """
    n, p = x.shape
    top = np.abs(x.T @ (y - y.mean())).max() / n if p else 0.0
    if top <= 0:
        m = y.mean()
        return float(np.log(m / (1 - m))), np.zeros(p), 0.0
    lambdas = top * np.geomspace(1, 0.01 if n < p else 1e-4, n_lambdas)
    none = _deviance(np.full(n, np.log(y.mean() / (1 - y.mean()))), y).mean()

    def ended(path: np.ndarray) -> np.ndarray:
        """At which lambdas of ``path`` the deviance no longer falls."""
        told = 1 - _deviance(path[:, :1] + path[:, 1:] @ x.T, y).mean(1) / none
        out = told > 0.999
        out[5:] |= told[5:] - told[4:-1] < 1e-5 * told[5:]
        return out

    solved = _path_lanes(x, y, lambdas, ended) if p <= LANE_FEATURES else None
    if solved is not None:
        path, eta = solved
        best = int(np.argmin(_deviance(eta, y[:, None]).mean(0)))
        return float(path[best, 0]), path[best, 1:].copy(), float(lambdas[best])
    lambdas = lambdas[: lasso_paths(x, y, np.full((1, n), 1 / n), lambdas, stop=lambda path: ended(path[0])[-1]).shape[1]]
    left_out = (1 - np.eye(n)) / (n - 1)
    paths = lasso_paths(x, y, left_out, lambdas)
    eta = paths[:, :, 0] + np.einsum("klj,kj->kl", paths[:, :, 1:], x)
    best = int(np.argmin(_deviance(eta, y[:, None]).mean(0)))
    b = lasso_paths(x, y, np.full((1, n), 1 / n), lambdas[best : best + 1], tolerance=1e-11, rounds=60)[0, 0]
    if not best:
        b[1:] = 0
    return float(b[0]), b[1:], float(lambdas[best])


def _wide(rows: pd.DataFrame, branches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gene names and values (branches x genes; NaN where there is none) of long rows."""
    named = rows.gene_id.notna().to_numpy()
    genes, g = np.unique(rows.gene_id.to_numpy()[named].astype(str), return_inverse=True)
    at = pd.Index(branches).get_indexer(rows.branch_id.to_numpy()[named])
    out = np.full((len(branches), len(genes)), np.nan)
    out[at[at >= 0], g[at >= 0]] = rows.value.to_numpy(float)[named][at >= 0]
    return genes, out


def prepare_design(x: np.ndarray, u: np.ndarray) -> tuple[str | None, np.ndarray, np.ndarray, dict]:
    """Training and other rows after the training transforms: genes without a value dropped, means imputed, genes without variance dropped, scaled by the sample deviation.

    The first value is the reason where nothing is left; ``kept``, ``mean``, ``sd``, ``n_all`` and ``n_zero`` come last.
    """
    kept = np.flatnonzero(~np.isnan(x).all(0)) if len(x) else np.zeros(0, int)
    told = {"kept": kept, "mean": np.zeros(0), "sd": np.zeros(0), "n_all": x.shape[1] - len(kept), "n_zero": 0}
    if not len(kept):
        return "no_features_after_all_missing_drop", x[:, kept], u[:, kept], told
    mean = np.nanmean(x[:, kept], 0)
    x, u = (np.where(np.isnan(d[:, kept]), mean, d[:, kept]) for d in (x, u))
    sd = x.std(0, ddof=1) if len(x) > 1 else np.zeros(len(kept))
    varied = sd > 1e-12 * np.maximum(np.abs(mean), 1e-300)
    told.update(kept=kept[varied], mean=mean[varied], sd=sd[varied], n_zero=int((~varied).sum()))
    if not varied.any():
        return "no_features_after_zero_variance_drop", x[:, varied], u[:, varied], told
    return None, (x[:, varied] - mean[varied]) / sd[varied], (u[:, varied] - mean[varied]) / sd[varied], told


#: Least rows of the smaller class for a fit: leaving one out must leave two.
LEAST_CLASS = 3
_OOF = ("study_id string, fold_id string, held_out string, status string, species string, branch_id string, state double, prediction double, n_candidates int, n_features int, n_nonzero int, "
        "lambda double, n_train int, n_train_positive int, n_dropped_all int, n_dropped_zero int, genes array<string>, coefficients array<double>")


def _fit_fold(rows: pd.DataFrame, nested: bool = True) -> pd.DataFrame:
    branches, first = np.unique(rows.branch_id.to_numpy().astype(str), return_index=True)
    role, state = rows.role.to_numpy()[first], rows.state.to_numpy(float)[first]
    train, test = role == "train", np.flatnonzero(role == "test")
    y = state[train]
    told = {"lambda": np.nan, "n_features": 0, "n_nonzero": 0, "n_dropped_all": 0, "n_dropped_zero": 0, "genes": [], "coefficients": []}
    genes, wide = _wide(rows, branches)
    if not len(test):
        status, p = "no_evaluable_test_species_after_exclusion", np.zeros(0)
    elif not len(y) or y.min() == y.max():
        status, p = "null_intercept_only_training_one_class", np.full(len(test), y.mean() if len(y) else np.nan)
    elif not len(genes) and nested:
        status, p = "null_intercept_only_no_FDR_features_in_training_ttest", np.full(len(test), y.mean())
    else:
        why, x, u, kept = prepare_design(wide[train], wide[test])
        told.update(n_dropped_all=kept["n_all"], n_dropped_zero=kept["n_zero"])
        if why:
            status, p = f"null_intercept_only_{why}", np.full(len(test), y.mean())
        elif min(y.sum(), len(y) - y.sum()) < LEAST_CLASS:
            status, p = "refused_class_of_fewer_than_three", np.full(len(test), np.nan)
        else:
            b0, b, lam = fit_lasso(x, y)
            p = 1 / (1 + np.exp(-np.clip(b0 + u @ b, -30, 30)))
            some = np.flatnonzero(b)
            told.update({"lambda": lam, "n_features": x.shape[1], "n_nonzero": len(some), "genes": genes[kept["kept"][some]].tolist(), "coefficients": b[some].tolist()})
            status = "fit_nonzero_predictors" if len(some) else "fit_no_selected_predictors"
    head = {"study_id": rows.study_id.iloc[0], "fold_id": rows.fold_id.iloc[0], "held_out": rows.held_out.iloc[0], "status": status, "n_candidates": len(genes), "n_train": len(y), "n_train_positive": int(y.sum()), **told}
    if not len(test):
        return pd.DataFrame([{**head, "species": None, "branch_id": None, "state": np.nan, "prediction": np.nan}])
    return pd.DataFrame({**{k: [v] * len(test) for k, v in head.items()}, "species": rows.species.to_numpy()[first[test]], "branch_id": branches[test], "state": state[test], "prediction": p})


RECIPES = ("nested_phase12B", "nested_phase13", "global_screen_foldwise")


def out_of_fold(rates: DataFrame, terminals: DataFrame, folds: DataFrame, features: DataFrame, value: str = "gbi", recipe: str = "nested_phase12B") -> DataFrame:
    """Held-out predictions of every fold, each fitted in its own task on its selected genes only.

    ``features`` has ``(study_id, genus, gene_id)`` of a nested recipe, or ``(study_id, gene_id)`` of ``global_screen_foldwise``, which screens once on all
    data.  The two nested recipes differ in the order of a multiplication only, which the sums here do not have.
    A fold that cannot be fitted predicts the training mean and says why; one with a class too small for leaving one out predicts nothing.
    """
    if recipe not in RECIPES:
        raise ContractError(f"choose a validation recipe of {', '.join(RECIPES)}")
    nested = recipe != "global_screen_foldwise"
    held_out = folds.select("study_id", "fold_id", F.col("genus").alias("held_out"))
    if nested:
        chosen = features.select("study_id", F.col("genus").alias("held_out"), "gene_id")
    else:
        chosen = folds.select("study_id", F.col("genus").alias("held_out")).distinct().join(features.select("study_id", "gene_id").distinct(), "study_id")
    v = rates.where(F.col(value).isNotNull()).select("study_id", "branch_id", "gene_id", F.col(value).alias("value"))
    # Folds without any candidate are settled by counts; of the others candidates are kept with every person, so that a gene without any value in the fold counts as one.
    with_genes = held_out.join(chosen, ["study_id", "held_out"], "left_semi").select("study_id", "fold_id").distinct()
    named = folds.select("study_id", "fold_id", "genus").join(unbroadcast(held_out), ["study_id", "fold_id"])
    assigned = lambda how: roles(terminals, named.join(unbroadcast(with_genes), ["study_id", "fold_id"], how), ("held_out",))
    rows = assigned("left_semi").join(chosen, ["study_id", "held_out"], "left").join(v, ["study_id", "branch_id", "gene_id"], "left")
    fitted = spread(rows, "study_id", "fold_id").groupBy("study_id", "fold_id").applyInPandas(lambda d: _fit_fold(d, nested), _OOF)
    return fitted.unionByName(_without_candidates(assigned("left_anti"), nested))


def _without_candidates(assigned: DataFrame, nested: bool) -> DataFrame:
    """What ``_fit_fold`` says of folds without a candidate gene: the training mean, or no prediction."""
    people = assigned.groupBy("study_id", "fold_id", "branch_id").agg(F.first(F.struct("held_out", "species", "role", "state")).alias("r")).select("study_id", "fold_id", "branch_id", "r.*")
    train, test = F.col("role") == "train", F.col("role") == "test"
    g = people.groupBy("study_id", "fold_id").agg(
        F.first("held_out").alias("held_out"), F.count_if(train).cast("int").alias("n_train"), F.coalesce(F.sum(F.when(train, F.col("state"))), F.lit(0.0)).alias("positive"),
        F.min(F.when(train, F.col("state"))).alias("least"), F.max(F.when(train, F.col("state"))).alias("most"), F.collect_list(F.when(test, F.struct("species", "branch_id", "state"))).alias("test"))
    none = "no_FDR_features_in_training_ttest" if nested else "no_features_after_all_missing_drop"
    status = F.when(F.size("test") == 0, "no_evaluable_test_species_after_exclusion").when((F.col("n_train") == 0) | (F.col("least") == F.col("most")), "null_intercept_only_training_one_class").otherwise(f"null_intercept_only_{none}")
    rows = g.withColumn("status", status).withColumn("t", F.explode_outer("test"))
    prediction = F.when(F.col("t.branch_id").isNotNull(), F.try_divide("positive", "n_train"))
    constant = {"n_candidates": F.lit(0), "n_features": F.lit(0), "n_nonzero": F.lit(0), "lambda": F.lit(None).cast("double"), "n_dropped_all": F.lit(0), "n_dropped_zero": F.lit(0), "genes": F.array().cast("array<string>"), "coefficients": F.array().cast("array<double>")}
    made = {"species": F.col("t.species"), "branch_id": F.col("t.branch_id"), "state": F.col("t.state"), "prediction": prediction, "n_train_positive": F.col("positive").cast("int")}
    return rows.withColumns(made | constant).select(*[c.split()[0] for c in _OOF.split(", ")])


_FULL = "study_id string, model string, gene_id string, status string, coefficient double, mean double, sd double, intercept double, lambda double, n_rows int, n_positive int, n_candidates int, n_dropped_all int, n_dropped_zero int"


def _fit_full(rows: pd.DataFrame) -> pd.DataFrame:
    people = rows.drop_duplicates("branch_id").sort_values("branch_id")
    y = people.state.to_numpy(float)
    genes, wide = _wide(rows, people.branch_id.to_numpy(str))
    why, x, _, kept = prepare_design(wide, wide[:0])
    b, mean, sd, b0, lam = np.zeros(len(genes)), np.full(len(genes), np.nan), np.full(len(genes), np.nan), np.nan, np.nan
    if why == "no_features_after_all_missing_drop" or not len(y) or y.min() == y.max():
        status = "null_no_usable_features_or_one_class"
    elif why:
        status = "null_no_usable_nonzero_variance_features"
    elif min(y.sum(), len(y) - y.sum()) < LEAST_CLASS:
        status = "refused_class_of_fewer_than_three"
    else:
        status = "fit"
        b0, b[kept["kept"]], lam = fit_lasso(x, y)
        mean[kept["kept"]], sd[kept["kept"]] = kept["mean"], kept["sd"]
    n = max(len(genes), 1)
    return pd.DataFrame({
        "study_id": [rows.study_id.iloc[0]] * n, "model": [rows.model.iloc[0]] * n, "gene_id": genes.tolist() or [None], "status": status, "coefficient": b if len(genes) else [np.nan], "mean": mean if len(genes) else [np.nan],
        "sd": sd if len(genes) else [np.nan], "intercept": b0, "lambda": lam, "n_rows": len(y), "n_positive": int(y.sum()), "n_candidates": len(genes), "n_dropped_all": kept["n_all"], "n_dropped_zero": kept["n_zero"],
    })


def full_fit(rates: DataFrame, terminals: DataFrame, features: DataFrame, value: str = "gbi") -> DataFrame:
    """Coefficients of the fit on all labelled terminals of each study and model: one row per candidate gene, 0 where it is not selected.

    ``terminals`` and ``features`` have a ``model`` column; a full-data fit is no validation.  A model without candidates has one row without a gene.
    """
    people = terminals.where(F.col("state").isin(0.0, 1.0)).select("study_id", "model", "branch_id", "state")
    chosen = features.select("study_id", "model", "gene_id").distinct()
    rows = unbroadcast(people).join(chosen, ["study_id", "model"]).join(rates.where(F.col(value).isNotNull()).select("study_id", "branch_id", "gene_id", F.col(value).alias("value")), ["study_id", "branch_id", "gene_id"], "left")
    out = spread(rows, "study_id", "model").groupBy("study_id", "model").applyInPandas(_fit_full, _FULL)
    # Most models have no candidate: they are settled by counts.
    counts = people.groupBy("study_id", "model").agg(F.count_distinct("branch_id").cast("int").alias("n_rows"), F.count_distinct(F.when(F.col("state") == 1, F.col("branch_id"))).cast("int").alias("n_positive"))
    rest = counts.join(chosen, ["study_id", "model"], "left_anti").withColumns({"status": F.lit("null_no_usable_features_or_one_class"), "n_candidates": F.lit(0), "n_dropped_all": F.lit(0), "n_dropped_zero": F.lit(0)})
    rest = rest.withColumns({"gene_id": F.lit(None).cast("string")} | {c: F.lit(None).cast("double") for c in ("coefficient", "mean", "sd", "intercept", "lambda")})
    out = out.unionByName(rest.select(*[c.split()[0] for c in _FULL.split(", ")]))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("coefficient", "mean", "sd", "intercept", "lambda")})


def full_summary(fitted: DataFrame) -> DataFrame:
    """Per model: candidates, rows, selected predictors by sign, the largest coefficient, and notes."""
    c = F.col("coefficient")
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False))).cast("bigint")
    out = fitted.groupBy("study_id", "model").agg(
        F.first("status").alias("status"), F.first("n_candidates").alias("n_candidates"), F.first("n_rows").alias("n_rows"), F.first("n_positive").alias("n_positive"), n(c != 0).alias("n_selected"), n(c > 0).alias("n_positive_coefficients"),
        n(c < 0).alias("n_negative_coefficients"), F.max_by(F.struct("gene_id", "coefficient"), F.struct(F.abs(c), F.col("gene_id"))).alias("top"), F.first("lambda").alias("lambda_used"))
    some = F.col("n_selected") > 0
    return out.select("*", F.when(some, F.col("top.gene_id")).otherwise("").alias("max_abs_coef_gene"), F.when(some, F.abs("top.coefficient")).otherwise(0.0).alias("max_abs_coef")).drop("top")


def partition(fitted: DataFrame, first: str, second: str) -> DataFrame:
    """Selected genes of two models of a study as ``first_only``, ``second_only`` and ``shared``: counts and the genes in order."""
    own = fitted.where((F.col("coefficient") != 0) & F.col("model").isin(first, second)).groupBy("study_id", "gene_id").agg(F.max(F.col("model") == first).alias("a"), F.max(F.col("model") == second).alias("b"))
    part = F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "first_only").otherwise("second_only")
    found = own.groupBy("study_id", part.alias("partition")).agg(F.count(F.lit(1)).alias("n_genes"), F.array_join(F.array_sort(F.collect_list("gene_id")), ";").alias("genes"))
    every = fitted.select("study_id").distinct().withColumn("partition", F.explode(F.array(*map(F.lit, ("first_only", "second_only", "shared")))))
    return every.join(found, ["study_id", "partition"], "left").select("study_id", "partition", F.coalesce("n_genes", F.lit(0).cast("bigint")).alias("n_genes"), F.coalesce("genes", F.lit("")).alias("genes"))


def fold_table(oof: DataFrame, screen: DataFrame | None = None, global_features: DataFrame | None = None) -> DataFrame:
    """One row per fold: rows and classes, genes tested and selected, overlap with the global selection, features used and selected, lambda and status."""
    f = oof.groupBy("study_id", "fold_id", "held_out").agg(
        F.first("n_train").alias("n_training_samples"), F.count("branch_id").alias("n_test_samples"), F.first("n_train_positive").alias("n_train_positive"), F.count_if(F.col("state") == 1).cast("bigint").alias("n_test_positive"),
        F.first("n_candidates").alias("n_fold_candidate_genes"), F.first("n_dropped_all").alias("n_features_dropped_all_missing"), F.first("n_dropped_zero").alias("n_features_dropped_zero_variance"),
        F.first("n_features").alias("n_features_used_for_lasso"), F.first("n_nonzero").alias("n_selected_predictors"), F.first("lambda").alias("lambda_min"), F.first("status").alias("fold_model_status"))
    f = f.withColumn("n_train_negative", F.col("n_training_samples") - F.col("n_train_positive")).withColumn("n_test_negative", F.col("n_test_samples") - F.col("n_test_positive"))
    if screen is not None:
        own = screen.groupBy("study_id", F.col("genus").alias("held_out")).agg(F.count(F.lit(1)).alias("n_genes_tested"), F.collect_set(F.when(F.col("selected"), F.col("gene_id"))).alias("chosen"))
        f = f.join(own, ["study_id", "held_out"], "left")
        if global_features is not None:
            g = global_features.groupBy("study_id").agg(F.collect_set("gene_id").alias("everywhere"))
            f = f.join(g, "study_id", "left")
            both = F.size(F.array_intersect(F.coalesce("chosen", F.array().cast("array<string>")), F.coalesce("everywhere", F.array().cast("array<string>"))))
            f = f.withColumn("n_overlap_with_global", both).withColumn("share_of_fold_in_global", F.try_divide("n_overlap_with_global", F.size("chosen"))).withColumn("share_of_global_in_fold", F.try_divide("n_overlap_with_global", F.size("everywhere"))).drop("everywhere")
        f = f.drop("chosen")
    return f


def selected_table(oof: DataFrame) -> DataFrame:
    """The predictors that each fold selected, with coefficient and sign."""
    per = oof.groupBy("study_id", "fold_id", "held_out").agg(F.first(F.arrays_zip("genes", "coefficients")).alias("z"), F.first("lambda").alias("lambda_min"))
    rows = per.select("study_id", "fold_id", "held_out", "lambda_min", F.explode("z").alias("z"))
    return rows.select("study_id", "fold_id", "held_out", F.col("z.genes").alias("gene_id"), F.col("z.coefficients").alias("coefficient"), F.when(F.col("z.coefficients") > 0, "positive").otherwise("negative").alias("coefficient_sign"), "lambda_min")


def validation_summary(oof: DataFrame) -> DataFrame:
    """Per study: area under the curve of the held-out predictions, folds by outcome, medians and quartile texts of candidates and selected predictors, and the decision label."""
    from cladeframe.functions.stats import auc

    a = auc(oof.where("branch_id IS NOT NULL"), "prediction", "state", ["study_id"])
    f = fold_table(oof).withColumn("counts", F.col("n_test_samples") > 0)
    ok = F.col("counts")
    q = lambda c: F.percentile(F.when(ok, F.col(c)), [0.25, 0.5, 0.75])
    n = f.groupBy("study_id").agg(
        F.count_if(ok).cast("bigint").alias("n_folds"), F.count_if(~ok).cast("bigint").alias("n_folds_without_test"), F.count_if(ok & F.col("fold_model_status").startswith("null_intercept_only")).cast("bigint").alias("n_null_intercept_only"),
        F.count_if(ok & (F.col("n_selected_predictors") == 0)).cast("bigint").alias("n_no_selected"), F.count_if(ok & (F.col("n_fold_candidate_genes") == 0)).cast("bigint").alias("n_zero_candidates"), q("n_fold_candidate_genes").alias("c"), q("n_selected_predictors").alias("s"))
    out = n.join(a, "study_id", "left")
    text = lambda c: F.format_string("%.0f-%.0f", F.rint(F.get(c, F.lit(0))), F.rint(F.get(c, F.lit(2))))
    share = F.try_divide("n_no_selected", "n_folds")
    return out.select(
        "study_id", "n0", "n1", "auc", "n_folds", "n_folds_without_test", "n_null_intercept_only", "n_no_selected", "n_zero_candidates", F.get("c", F.lit(1)).alias("median_candidates"), text("c").alias("iqr_candidates"),
        F.get("s", F.lit(1)).alias("median_selected"), text("s").alias("iqr_selected"), decision(F.col("auc"), share).alias("decision"))


def decision(auc: Column, none_selected: Column) -> Column:
    """The label of a validation by its area under the curve and the share of evaluated folds that selected nothing; null where either is."""
    return F.when(auc.isNull() | none_selected.isNull(), None).when((auc >= 0.48) & (auc <= 0.52) & (none_selected >= 0.95), "strict_null_collapse").when((auc < 0.60) | (none_selected >= 0.80), "near_collapse").when(auc < 0.75, "strong_attenuation").otherwise("retained_sparse_prediction")


def taxon_roles(assigned: DataFrame) -> DataFrame:
    """The ledger of roles: per fold and species train, test or excluded, with its group."""
    return assigned.select("study_id", "fold_id", F.col("species").alias("taxon_id"), "role", F.col("genus").alias("group"))


def project(rates: DataFrame, coefficients: DataFrame, value: str = "gbi") -> DataFrame:
    """Logit and probability of every branch under fitted coefficients, with the training transforms; a missing value is imputed by the mean.

    ``coefficients`` has ``(study_id, gene_id, coefficient, mean, sd, intercept)``.
    """
    branches = rates.select("study_id", "branch_id").distinct().join(coefficients, "study_id")
    rows = branches.join(rates.select("study_id", "branch_id", "gene_id", F.col(value).alias("__v")), ["study_id", "branch_id", "gene_id"], "left")
    scaled = F.coalesce((F.col("__v") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    out = rows.groupBy("study_id", "branch_id").agg((F.first("intercept") + F.sum(F.col("coefficient") * scaled)).alias("logit"), F.count_if(F.col("__v").isNull()).cast("bigint").alias("n_imputed"))
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))


def roc_points(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Points of the ROC curve, one per distinct score from high to low."""
    y = F.col(label) == 1
    at = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    run = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    return at.select(*by, F.col(score).alias("threshold"), F.try_divide(F.sum("p").over(run), F.sum("p").over(whole)).alias("tpr"), F.try_divide(F.sum("n").over(run), F.sum("n").over(whole)).alias("fpr"))
