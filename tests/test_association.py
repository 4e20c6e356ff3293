"""Null scores, calibration, worlds as arrays, validators, sets and whole runs against brute force and hand-made cases."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeframe.errors import AxisError, ContractError
from cladeframe.functions.graphs import condensation_rank, strong_components
from cladeframe.operators import association, baseline, c2, cells, objects, pipeline, rates, sets, tree, validation, variants
from cladeframe.workspace import Workspace, spread
from tests.test_matrix import grid


def _domain(spark, rng, n_genes=5, n_branches=9, studies=("s", "t")):
    rows = []
    for s, g, b in itertools.product(studies, range(n_genes), range(n_branches)):
        ok = rng.random() > 0.2
        rows.append((s, f"g{g}", f"b{b}", float(rng.normal()) if ok else None, ok))
    return spark.createDataFrame(rows, "study_id string, gene_id string, branch_id string, rate double, eligible boolean"), rows


def _plain(values, x, statistic, kind):
    v, x = np.array(values), np.array(x)
    if kind == "binary":
        if not 0 < x.sum() < len(x):
            return None
        return v[x == 1].mean() - v[x == 0].mean() if statistic == "beta" else np.corrcoef(v, x)[0, 1]
    if len(v) < 2 or len(set(x)) < 2:
        return None
    if statistic == "spearman_rho":
        v, x = pd.Series(v).rank().to_numpy(), pd.Series(x).rank().to_numpy()
    if statistic == "beta":
        return np.cov(v, x)[0, 1] / np.var(x, ddof=1)
    return np.corrcoef(v, x)[0, 1]


@pytest.mark.parametrize("kind,statistic", [(k, s) for k, names in association.STATISTICS.items() for s in names])
def test_null_scores_by_hand(spark, kind, statistic, monkeypatch):
    monkeypatch.setattr(association, "_BLOCK", 60)  # several blocks a study
    rng = np.random.default_rng(7)
    d, rows = _domain(spark, rng)
    world = {(s, r, b): float(rng.integers(0, 2)) if kind == "binary" else float(rng.integers(0, 4)) for s in "st" for r in range(1, 7) for b in range(9)}
    del world["t", 3, 2]
    w = spark.createDataFrame([(s, r, f"b{b}", x) for (s, r, b), x in world.items()], "study_id string, replicate int, branch_id string, state double")
    got = {(r.study_id, r.gene_id, r.replicate): r for r in association.null_scores(d, w, statistic=statistic, kind=kind).collect()}
    assert len(got) == 2 * 5 * 6
    for s, g, r in itertools.product("st", range(5), range(1, 7)):
        own = [(x[3], int(x[2][1:])) for x in rows if x[0] == s and x[1] == f"g{g}" and x[4]]
        lacks = [b for _, b in own if (s, r, b) not in world]
        o = got[s, f"g{g}", r]
        assert o.missing == len(lacks)
        want = None if lacks else _plain([v for v, _ in own], [world[s, r, b] for _, b in own], statistic, kind)
        assert (o.score is None) == (want is None) and (want is None or o.score == pytest.approx(want, abs=1e-9))
    with pytest.raises(ContractError):
        association.null_scores(d, w, statistic="pearson_r", kind="binary")
    assert association.null_scores(d.limit(0), w).count() == 0 and association.null_scores(d, w.limit(0)).count() == 0


def test_calibration_statuses(spark):
    o = spark.createDataFrame([("s", "a", "ESTIMABLE", 2.0), ("s", "b", "BINARY_FOCAL_ABSENT", None), ("s", "c", "ESTIMABLE", 1.0), ("s", "d", "ESTIMABLE", 1.0), ("s", "e", "ESTIMABLE", float("nan"))], "study_id string, gene_id string, status string, difference double")
    n = spark.createDataFrame([("s", "a", 1, 2.0, 0), ("s", "a", 2, -2.0, 0), ("s", "a", 3, 1.9, 0), ("s", "b", 1, 1.0, 0), ("s", "c", 1, 1.0, 0), ("s", "c", 2, None, 2), ("s", "c", 3, 1.0, 0), ("s", "d", 1, 3.0, 0), ("s", "d", 2, None, 0), ("s", "d", 3, 1.0, 0)],
                              "study_id string, gene_id string, replicate long, score double, missing long")
    got = {r.gene_id: r for r in association.calibrate(o, n, 3).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "CALIBRATED", "b": "OBSERVED_ASSOCIATION_NONESTIMABLE", "c": "NULL_DOMAIN_MISMATCH", "d": "NULL_CALIBRATION_INCOMPLETE", "e": "NUMERICALLY_INDETERMINATE"}
    assert got["a"].exceedances == 2 and got["a"].p == 0.75 and got["b"].reason == "BINARY_FOCAL_ABSENT" and got["d"].reason == "NULL_REPLICATE_NONESTIMABLE_count_1" and got["d"].exceedances is None
    assert association.calibrate(o, n, 3, "greater").where("gene_id = 'a'").first().p == 0.5
    told = {r.replicate: (r.nonestimable_gene_count, r.status) for r in association.replicate_status(n, association.calibrate(o, n, 3)).collect()}
    assert told == {1: (0, "ESTIMABLE_FOR_ALL_ACTIVE_GENES"), 2: (1, "NULL_REPLICATE_NONESTIMABLE"), 3: (0, "ESTIMABLE_FOR_ALL_ACTIVE_GENES")}


def test_worlds_as_arrays(spark):
    """States of many worlds at once are those of each world alone, and sums by world those of a join."""
    rng = np.random.default_rng(2)
    tips = "abcdefgh"
    sides = ["ab", "cd", "abcd", "ef", *tips]
    split = spark.createDataFrame([(s, f"B{i:02d}", ";".join(x), ";".join(t for t in tips if t not in x)) for s in "st" for i, x in enumerate(sides)], "study_id string, branch_id string, a string, b string")
    edges = tree.rooted_edges(split)
    leaf = {x: f"B{i:02d}" for i, x in enumerate(sides)}
    worlds = spark.createDataFrame([(s, r, leaf[t], float(rng.choice([0, 0.5, 1]))) for s in "st" for r in range(1, 5) for t in tips[:-1]], "study_id string, replicate int, branch_id string, state double")
    alone = {(r.study_id, r.replicate, r.branch_id): r.state for r in tree.parsimony_states(edges, worlds, ("replicate",)).collect()}
    arrays = tree.parsimony_arrays(edges, association.worlds_as_arrays(worlds))
    assert {(r.study_id, k + 1, r.branch_id): x for r in arrays.collect() for k, x in enumerate(r.states)} == alone
    values = spark.createDataFrame([(s, f"g{g}", leaf[t], float(rng.integers(1, 9))) for s in "st" for g in range(3) for t in tips if rng.random() > 0.2], "study_id string, gene_id string, branch_id string, gbi double")
    got = {(r.study_id, r.gene_id, r.replicate): tuple(r)[3:] for r in association.group_sums(values, arrays, "gbi").collect()}
    long = arrays.select("study_id", "branch_id", F.posexplode("states").alias("replicate", "state"))
    want = {(r.study_id, r.gene_id, r.replicate): (r.n0, r.s0, r.q0, r.n1, r.s1, r.q1) for r in baseline.group_statistics(values, long, "gbi", ("replicate",)).collect()}
    assert all(got[k] == v for k, v in want.items()) and all(v[0] + v[3] == 0 for k, v in got.items() if k not in want)
    pairs, ledger = tree.match_edges(edges, edges.where("branch_id <> 'B00'"))
    assert pairs.count() == 2 * (len(sides) - 1) and {(r.side, r.branch_id, r.n_partners) for r in ledger.collect()} == {("main", "B00", 0)}


def test_strong_components_and_rank_by_closure():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        m = int(rng.integers(0, 2 * n + 1))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        reach = np.eye(n, dtype=bool)
        reach[a, b] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k]]
        scc = strong_components(n, a, b)
        assert all((scc[i] == scc[j]) == (reach[i, j] and reach[j, i]) for i in range(n) for j in range(n))
        rank = condensation_rank(scc, a, b)
        assert all(rank[scc[j]] > rank[scc[i]] for i, j in zip(a, b) if scc[i] != scc[j])
        tops = [c for c in range(scc.max() + 1) if not any(scc[j] == c and scc[i] != c for i, j in zip(a, b))]
        assert all(rank[c] == 0 for c in tops)
    chain = np.arange(20_000)
    assert len(set(strong_components(20_001, chain, chain + 1).tolist())) == 20_001


def test_ensembles_and_validators(spark):
    values = spark.createDataFrame([("s", r, f"b{j}", float((j + r) % 2) if j < 3 else None) for r in (1, 2) for j in range(4)], "study_id string, replicate int, branch_id string, state double")
    per_branch = spark.createDataFrame([("s", f"b{j}", "available" if j < 3 else "unresolved") for j in range(4)], "study_id string, branch_id string, availability string")
    worlds = objects.ensemble(values, per_branch)
    assert worlds.count() == 8 and worlds.where("availability = 'unresolved'").count() == 2
    observed = worlds.where("replicate = 1").select("study_id", "branch_id", "state")
    assert {(r.rule, r.n) for r in objects.ensemble_violations(worlds, observed).collect()} == {("observed_realisation_included", 1)}
    assert {r.rule for r in objects.ensemble_violations(worlds.where("replicate = 1 OR branch_id <> 'b0'").withColumn("state", F.when(F.col("branch_id") == "b1", 7.0).otherwise(F.col("state")))).collect()} == {"world_lacks_branches", "value_off_coding"}
    with pytest.raises(ContractError):
        objects.ensemble(values, per_branch, observed_included=True)
    with pytest.raises(ContractError):
        objects.ensemble(values, per_branch.withColumn("availability", F.lit("available")))
    bad = spark.createDataFrame([("s", "b0", 1.0, "unresolved", None), ("s", "b1", None, "available", "why"), ("s", "b1", 0.0, "odd", " ")], "study_id string, branch_id string, state double, availability string, reason string")
    assert {r.rule for r in objects.branch_state_violations(bad).collect()} == {"unknown_availability", "value_missing", "value_where_not_available", "reason_where_available", "reason_missing", "repeated_key"}
    m = grid(spark, [[1, 0, None], [2, 3, 4]])
    assert objects.eligibility_violations(cells.eligibility(m)).count() == 0
    cal = association.mark_few(association.calibrate(spark.createDataFrame([("s", "a", "ESTIMABLE", 2.0)], "study_id string, gene_id string, status string, difference double"), spark.createDataFrame([("s", "a", 1, 1.0, 0)], "study_id string, gene_id string, replicate long, score double, missing long"), 1), spark.createDataFrame([("s", 9.0)], "study_id string, n_labellings double"), 1)
    assert objects.calibration_violations(cal, 1).count() == 0 and {r.rule for r in objects.calibration_violations(cal.withColumn("p", F.lit(0.3)), 1).collect()} == {"p_disagrees"}


def test_c2_rates_and_encoded_replay(spark):
    m = grid(spark, [[1, 2, None], [0, 4, None], [None, None, 5]])
    e = cells.eligibility(m).where("elig_status = 'eligible'").select("study_id", "gene_id", "branch_id", F.col("value").alias("y"))
    done = c2.evaluate(e, c2.effects(e))
    got = {(r.gene_id, r.branch_id): r for r in rates.c2_rate(m, done, "logGBI_C2").collect()}
    assert got["g1", "b0"].reason == "input_zero_log_undefined" and got["g0", "b2"].reason == "coordinate_unavailable" and got["g0", "b0"].support == "C2_SUPPORTED"
    assert got["g2", "b2"].rate == pytest.approx(0) and rates.c2_rate(m, done, "GBI_C2").where("gene_id = 'g1' AND branch_id = 'b0'").first().rate == 0
    b = spark.createDataFrame([("s", "g", "b0", "POSITIVE", 1.0), ("s", "g", "b1", "EXACT_ZERO_BOUNDARY", None), ("s", "h", "b0", "POSITIVE", -2.0)], "study_id string, gene_id string, branch_id string, ratio_state string, positive_log double")
    view = rates.encoded(b, b.where("gene_id = 'g'").select("study_id", "gene_id", "branch_id"))
    assert rates.encoded_mismatches(view, b).count() == 0
    off = view.withColumn("encoded", F.when(F.col("branch_id") == "b0", F.col("encoded") + 1e-9).otherwise(F.col("encoded")))
    assert [r.issue for r in rates.encoded_mismatches(off, b).collect()] == ["value"]


def test_pairs_of_rates(spark):
    schema = "study_id string, gene_id string, branch_id string, rate double, available boolean"
    a = spark.createDataFrame([("s", "g", f"b{i}", float(x), True) for i, x in enumerate([1, 2, 3, 4])] + [("s", "g", "b9", 1.0, False)], schema)
    b = spark.createDataFrame([("s", "g", f"b{i}", float(x), True) for i, x in enumerate([2, 2, 5, 12])], schema)
    r = rates.compare_pair(a, b, positive_ratio=True).first()
    assert (r.n, r.median_difference, r.difference_q25, r.max_abs_difference, r.positive_ratio_count) == (4, 1.5, 0.75, 8.0, 4) and r.median_log_ratio == pytest.approx(np.median(np.log([2, 1, 5 / 3, 3])))
    with pytest.raises(AxisError):
        rates.require_compatible(a.withColumn("coord_state", F.lit("observed")).withColumn("mu", F.lit(1.0)), b.withColumn("coord_state", F.lit("observed")).withColumn("mu", F.lit(1.0)))


def test_overlap_display_and_module_draws(spark):
    s = spark.createDataFrame([("s", "a", 2.0, True), ("s", "b", -1.0, True), ("s", "c", 0.5, False), ("s", "d", None, False)], "study_id string, gene_id string, t double, selected boolean")
    o = spark.createDataFrame([("s", "a", 3.0, True), ("s", "b", 1.5, True), ("s", "c", -0.5, False)], "study_id string, gene_id string, t double, selected boolean")
    got = {r.metric: r for r in sets.overlap_table(s, o).collect()}
    assert set(got) == set(sets.OVERLAP) and len(sets.OVERLAP) == 22
    assert (got["first_tested"].value, got["shared_slow"].value, got["slow_jaccard"].value, got["discordant"].value, got["first_slow_shared_percent"].value) == (3, 1, 0.5, 1, 100)
    assert got["discordant"].denominator == 2 and got["discordant"].percent == 50 and got["first_selected"].percent == 66.67
    note = spark.createDataFrame([("s", "a", "m1", True), ("s", "b", "m2", False)], "study_id string, gene_id string, display_module string, counted boolean")
    assert tuple(sets.module_display(note, note).first())[1:] == (2, 1, 1, 1)
    with pytest.raises(AxisError):
        sets.module_display(note, note.where("gene_id = 'a'"))
    universe = spark.createDataFrame([("s", f"m{i}", ["x", "y", "z"][i % 3] if i < 9 else None) for i in range(12)], "study_id string, member string, module string")
    draws = sets.turnover_modules(universe, spark.createDataFrame([("s", 4, 9)], "study_id string, n_first_annotated long, n_second_annotated long"), 600).collect()
    assert len(draws) == 600 and all(r.module_jaccard in (2 / 3, 1.0) and 0 < r.module_cosine <= 1 + 1e-12 for r in draws)
    whole = sets.turnover_modules(universe, spark.createDataFrame([("s", 9, 9)], "study_id string, n_first_annotated long, n_second_annotated long"), 3).collect()
    assert all(r.module_jaccard == 1 and r.module_cosine == pytest.approx(1) for r in whole)


def test_variants(spark):
    t = spark.createDataFrame([("s", "b0", "a", "G1", 1.0), ("s", "b1", "b", "G2", 1.0), ("s", "b2", "c", "G3", 0.0), ("s", "b3", "d", None, 0.5), ("s", "b4", "e", None, 1.0)], "study_id string, branch_id string, species string, genus string, state double")
    got = {}
    for r in variants.model_variants(t).collect():
        got.setdefault(r.model, {})[r.branch_id] = r.state
    assert len(got) == 14 and got["declared_baseline"] == {"b0": 1, "b1": 1, "b2": 0, "b3": 0.5, "b4": 1} and got["wide_baseline"]["b3"] == 1
    assert got["declared_drop_1"] == {"b0": 0.5, "b1": 1, "b2": 0, "b3": 0.5, "b4": 1} and got["declared_only_2"] == {"b0": 0.5, "b1": 1, "b2": 0, "b3": 0.5, "b4": 0.5} and got["declared_drop_4"] == got["declared_baseline"]


def test_lasso_is_left_one_out_at_every_size():
    """The chosen lambda has the least leave-one-out deviance on the path, by fitting each without its row, beyond 25 rows too."""
    rng = np.random.default_rng(4)
    n = 32
    x = rng.normal(size=(n, 3))
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    b0, b, lam = validation.fit_lasso(x, y)
    top = np.abs(x.T @ (y - y.mean())).max() / n
    assert 1e-4 * top <= lam <= top
    g = x.T @ (y - 1 / (1 + np.exp(-(b0 + x @ b)))) / n
    assert all(abs(g[j] - lam * np.sign(b[j])) < 1e-5 if b[j] else abs(g[j]) <= lam + 1e-5 for j in range(3))

    def deviance(lam):
        total = 0.0
        for i in range(n):
            keep = np.arange(n) != i
            f = validation.lasso_paths(x[keep], y[keep], np.full((1, n - 1), 1 / (n - 1)), np.array([lam]), tolerance=1e-12, rounds=200)[0, 0]
            p = np.clip(1 / (1 + np.exp(-(f[0] + x[i] @ f[1:]))), 1e-5, 1 - 1e-5)
            total -= 2 * (y[i] * np.log(p) + (1 - y[i]) * np.log(1 - p))
        return total / n

    best = deviance(lam)
    assert all(best <= deviance(other) + 1e-4 for other in top * np.geomspace(1, 1e-3, 12))


def test_folds_that_cannot_be_fitted():
    rows = lambda states, values: pd.DataFrame([{"study_id": "s", "fold_id": "f", "held_out": "G", "branch_id": f"b{i}", "species": f"x{i}", "role": "test" if i == 0 else "train", "state": s, "gene_id": "g" if values else None, "value": v} for i, (s, v) in enumerate(zip(states, values or [None] * len(states)))])
    status = lambda *a, **k: validation._fit_fold(rows(*a), **k).status.iloc[0]
    assert status([1, 0, 0, 0], [1, 2, 3, 4]) == "null_intercept_only_training_one_class"
    assert status([1, 0, 1, 0], None) == "null_intercept_only_no_FDR_features_in_training_ttest"
    assert status([1, 0, 1, 0], [5, None, None, None]) == "null_intercept_only_no_features_after_all_missing_drop"
    assert status([1, 0, 1, 0], [5, 2, 2, 2]) == "null_intercept_only_no_features_after_zero_variance_drop"
    assert status([1, 0, 1, 0, 1], [5, 1, 2, 3, 4]) == "refused_class_of_fewer_than_three"
    out = validation._fit_fold(rows([1, 0, 1, 0, 1, 0, 1], [9.0, 1, 8, 2, 9, 1, 7]))
    assert out.status.iloc[0] == "fit_nonzero_predictors" and out.prediction.iloc[0] > 0.5 and out.genes.iloc[0] == ["g"]


def test_decisions_and_refused_screen(spark):
    bad = spark.createDataFrame([("s", "g", "b0", 1.0), ("s", "g", "b1", 1.0), ("s", "g", "b2", 1.0), ("s", "g", "b3", 1.0)], "study_id string, gene_id string, branch_id string, gbi double")
    states = spark.createDataFrame([("s", f"b{i}", float(i % 2)) for i in range(4)], "study_id string, branch_id string, state double")
    with pytest.raises(ContractError):
        baseline.require_screen(baseline.screen(bad, states))


def test_whole_run(spark, tmp_path):
    """A small study from tables to a saved and reopened run."""
    from cladeframe.sources.runs import Run, reopen

    rng = np.random.default_rng(1)
    tips = [f"G{i // 3}_s{i}" for i in range(12)]
    sides = [tips[:6], tips[:3], tips[3:6], tips[6:9], *[[t] for t in tips]]
    t = dt.datetime(2024, 1, 1)
    coordinates = spark.createDataFrame([(i, "s", f"B{i:02d}", "k", ";".join(x), ";".join(y for y in tips if y not in x), "terminal" if len(x) == 1 else "internal", x[0] if len(x) == 1 else None, t, None) for i, x in enumerate(sides)],
                                        "row_id long, study_id string, branch_id string, canonical_split_key string, side_a_taxa string, side_b_taxa string, branch_type string, terminal_taxon string, loaded_at timestamp, retired_at timestamp")
    state = {x: float(i % 3 == 0) for i, x in enumerate(tips)}
    trait = spark.createDataFrame([(i, "s", x, state[x], t) for i, x in enumerate(tips)], "row_id long, study_id string, species string, binary_trait double, loaded_at timestamp")
    groups = spark.createDataFrame([(i, "s", x, x.split("_")[0], t, None) for i, x in enumerate(tips)], "row_id long, study_id string, species string, genus string, loaded_at timestamp, retired_at timestamp")
    m = grid(spark, [[float(1 + (5 if len(x) == 1 and state[x[0]] and g == 0 else 0) + rng.random()) for x in sides] for g in range(4)]).withColumn("branch_id", F.concat(F.lit("B"), F.lpad(F.substring("branch_id", 2, 5), 2, "0")))
    inputs = pipeline.Inputs(m, coordinates, trait, groups)
    with pytest.raises(ContractError):
        pipeline.AnalysisSpec("other", "nested_phase12B")
    run = Run(spark, str(tmp_path / "run"))
    tables = pipeline.run_study(spark, inputs, pipeline.AnalysisSpec("submitted_S2", "nested_phase12B"), run)
    run.finish()
    again = reopen(spark, str(tmp_path / "run"))
    assert set(again) == set(tables) and again["oof_predictions"].count() == 12 and again["screen_gene_ledger"].count() == 4 and again["fold_ledger"].count() == 4
    other = pipeline.run_multi(spark, inputs, draws=20)
    assert other["screening_table"].count() == 14 and other["overlap"].count() == 22 and other["sensitivity"].count() == 1 and other["partition"].count() == 3


def test_spread_keeps_its_tasks(spark):
    """Rows that lie by the key already are spread all the same."""
    d = spread(spark.range(1000).withColumn("k", F.col("id").cast("string")).select("k").distinct(), "k")
    assert d.select(F.spark_partition_id()).distinct().count() > 1


def test_common_domains(spark):
    d, _ = _domain(spark, np.random.default_rng(1))
    other = d.withColumn("eligible", F.col("eligible") & (F.col("branch_id") < "b5"))
    assert association.common([d, other]).where("eligible").count() == other.where("eligible").count()
    with pytest.raises(AxisError):
        association.common([d, other.where("gene_id <> 'g0'")])
    with pytest.raises(ContractError):
        association.common([d])


def test_profile(spark):
    """Declared domains, holds and warnings; the standard profile has no flags, and nothing is changed."""
    from cladeframe.operators import qc

    m = grid(spark, [[0, 1, None], [2, 2, 50]])
    told = qc.profile(m, "positive", (qc.Rule("high", "absolute", direction="upper", upper=10.0), qc.Rule("mad", "mad", scope="within_gene")))
    assert [(r.hold_code, r.n) for r in told["holds"].collect()] == [("DECLARED_POSITIVE_DOMAIN_VIOLATION", 1)]
    assert {(r.severity, r.warning_code, r.scope_id, r.n) for r in told["warnings"].collect()} == {
        ("INFO", "EXACT_POINT_MASS_PRESENT", "whole_matrix", 1), ("INFO", "POSITIVE_ONLY_METRIC_DOMAIN_LOSS", "whole_matrix", 1), ("WARNING", "DIAGNOSTIC_FLAGS_PRESENT", "high", 1), ("WARNING", "MAD_ZERO_UNDEFINED", "g1", 1)}
    standard = qc.profile(m)
    assert "flags" not in standard and standard["holds"].count() == 0 and standard["overall"].first().resolved_value_domain == "nonnegative"
    shares = {r.gene_id: r.mass_fraction for r in standard["gene_summary"].collect()}
    assert shares == {"g0": 1 / 55, "g1": 54 / 55}
    assert qc.overall(grid(spark, [[-1, 2]])).first().resolved_value_domain == "signed"
    with pytest.raises(ContractError):
        qc.overall(m, "odd")
    assert qc.profile(m.limit(0))["warnings"].count() == 0


def test_sensitivity_baseline_by_joins_equals_local(spark):
    """Two components, one of them with gaps, and zeros that take no part."""
    rng = np.random.default_rng(6)
    rows = [[float(np.exp(rng.normal(0, 3))) if rng.random() > 0.2 else (0.0 if rng.random() > 0.5 else None) for _ in range(5)] + [None, None] for _ in range(4)] + [[None] * 5 + [2.0, 8.0], [None] * 5 + [3.0, None]]
    e = cells.eligibility(grid(spark, rows)).where("elig_status = 'eligible'").select("study_id", "gene_id", "branch_id", F.col("value").alias("y"))
    key = lambda d: {(r.axis, r.id): r for r in d.collect()}
    local, joined = key(c2.effects(e)), key(c2.effects(e, Workspace(spark, "t"), local_edges=0))
    assert set(local) == set(joined) and len({r.component for r in local.values()}) == 2
    assert all(joined[k].component == r.component and joined[k].certified == r.certified and joined[k].effect == pytest.approx(r.effect, abs=1e-7) for k, r in local.items())
    assert c2.effects(e.limit(0)).count() == 0


def test_lasso_chooses_by_solved_fits():
    """A short path solved loosely chose another lambda here; the chosen one has the least deviance of tightly solved fits without a row."""
    rng = np.random.default_rng(31)
    n = 22
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + rng.normal(size=n) > 0.9).astype(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    lam = validation.fit_lasso(x, y)[2]
    lambdas = np.abs(x.T @ (y - y.mean())).max() / n * np.geomspace(1, 1e-4, 100)
    near = lambdas[(lambdas > lam / 2) & (lambdas < lam * 2)]
    paths = validation.lasso_paths(x, y, (1 - np.eye(n)) / (n - 1), near, tolerance=1e-13, rounds=200, sweeps=3000)
    p = np.clip(1 / (1 + np.exp(-(paths[:, :, 0] + np.einsum("klj,kj->kl", paths[:, :, 1:], x)))), 1e-5, 1 - 1e-5)
    deviance = -(y[:, None] * np.log(p) + (1 - y[:, None]) * np.log(1 - p)).mean(0)
    assert near[deviance.argmin()] == lam


def test_fits_without_candidates_need_no_python(spark, monkeypatch):
    """Folds and models without a candidate gene come out as the fit itself would say, and none is handed to a fit."""
    rows = [("s", f"b{j}", f"sp{j}", f"gen{j % 3}", float(j % 2) if j < 8 else 0.5) for j in range(9)]
    t = spark.createDataFrame(rows, "study_id string, branch_id string, species string, genus string, state double")
    r = spark.createDataFrame([("s", "g0", f"b{j}", float(j)) for j in range(9)], "study_id string, gene_id string, branch_id string, gbi double")
    folds = validation.make_folds(t, 1)
    none = folds.select("study_id", "genus", F.lit("g0").alias("gene_id")).where("false")
    frame = validation.roles(t, folds).join(folds.select("study_id", "fold_id", F.col("genus").alias("held_out")), ["study_id", "fold_id"]).withColumn("gene_id", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("double")).toPandas()
    expected = {(q.fold_id, q.branch_id): (q.status, q.prediction, q.n_train, q.n_train_positive) for _, d in frame.groupby("fold_id") for q in validation._fit_fold(d).itertuples()}

    def refuse(rows, nested=True):
        raise AssertionError("handed to a fit")

    monkeypatch.setattr(validation, "_fit_fold", refuse)
    monkeypatch.setattr(validation, "_fit_full", lambda rows: refuse(rows))
    got = {(q.fold_id, q.branch_id): (q.status, q.prediction, q.n_train, q.n_train_positive) for q in validation.out_of_fold(r, t, folds, none).collect()}
    assert got == expected and len(got) == 8
    full = validation.full_fit(r, t.withColumn("model", F.lit("m")), none.withColumn("model", F.lit("m"))).collect()
    assert [(q.gene_id, q.status, q.n_rows, q.n_positive, q.n_candidates) for q in full] == [(None, "null_no_usable_features_or_one_class", 8, 4, 0)]


def test_states_of_variants_are_not_broadcast(spark, tmp_path):
    """Rows of variants, which take next to nothing in files, are joined without going through the driver, though their files are below the bound."""
    states = spark.range(2000).selectExpr("'s' AS study_id", "CAST(id AS STRING) AS branch_id", "'m' AS model", "CAST(id % 2 AS DOUBLE) AS state")
    states.write.parquet(str(tmp_path / "states"))
    spark.range(4000).selectExpr("'s' AS study_id", "CAST(id AS STRING) AS branch_id", "'g' AS gene_id", "CAST(id AS DOUBLE) AS gbi").write.parquet(str(tmp_path / "rates"))
    b, r = spark.read.parquet(str(tmp_path / "states")), spark.read.parquet(str(tmp_path / "rates"))
    joins = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().split("\n") if "Join " in x]
    assert "BroadcastHashJoin" in joins(r.join(b, ["study_id", "branch_id"]))[0]  # what Spark does by itself
    assert "SortMergeJoin" in joins(baseline.group_statistics(r, b, "gbi", ("model",)))[0]
    assert any("SortMergeJoin" in x and "branch_id" in x for x in joins(baseline.screen(r, b, extra=("model",))))
    fit = validation.full_fit(r, b, b.selectExpr("study_id", "model", "branch_id AS gene_id").limit(1))
    assert any("SortMergeJoin" in x and "model" in x for x in joins(fit)) and not any("BroadcastHashJoin" in x and "branch_id" in x and "model" in x for x in joins(fit))


def test_hard_folds_are_solved_in_lanes(monkeypatch):
    """l12: steps along coordinates left such a fold moving, and the whole of it was fitted again from lambda to lambda."""
    x = np.array([[-1.279, -0.805], [0.884, 0.0], [-1.275, -0.797], [1.248, 0.573], [0.0, -0.691], [0.0, -0.805], [0.674, 0.623], [-1.279, -0.805], [0.699, 2.678], [1.472, 0.589], [0.0, 0.0], [-1.279, -0.805], [0.134, 0.244]])
    y = np.array([0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0.0])

    def refuse(*a, **k):
        raise AssertionError("fitted again")

    monkeypatch.setattr(validation, "lasso_paths", refuse)
    b0, b, lam = validation.fit_lasso(x, y)
    # Conditions of the optimum: the slope of the likelihood is the penalty's where a feature is in, and within it elsewhere.
    slope = x.T @ (y - 1 / (1 + np.exp(-(b0 + x @ b)))) / len(y)
    assert b.any() and np.abs(np.where(b != 0, slope - lam * np.sign(b), np.maximum(np.abs(slope) - lam, 0))).max() < 1e-6


def test_equal_rows_are_left_out_once_each():
    """Repeated rows give the same choice and coefficients as the slow way, which knows nothing of them; at the greatest lambda there is no coefficient, not even by rounding."""
    rng = np.random.default_rng(9)
    x, y = np.repeat(rng.normal(size=(9, 2)), 3, 0), np.repeat(np.array([0, 1, 0, 1, 1, 0, 0, 1, 0.0]), 3)
    y[[0, 4]] = 1 - y[[0, 4]]
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    b0, b, lam = validation.fit_lasso(x, y)
    lanes, validation.LANE_FEATURES = validation.LANE_FEATURES, 0
    try:
        c0, c, slow = validation.fit_lasso(x, y)
    finally:
        validation.LANE_FEATURES = lanes
    assert lam == slow and np.allclose([b0, *b], [c0, *c], atol=1e-4)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x, y = rng.normal(size=(20, 1)), rng.integers(0, 2, 20).astype(float)
        _, b, lam = validation.fit_lasso(x, y)
        assert lam < np.abs(x.T @ (y - y.mean())).max() / 20 * (1 - 1e-9) or not b.any()


def test_study_ratio_equals_ratio_of_trim(spark):
    m = spark.createDataFrame([("s", f"g{i % 3}", f"b{i // 3}", None if i % 7 == 0 else float(i * i % 23)) for i in range(60)], "study_id string, gene_id string, branch_id string, value double")
    key = lambda d: {(r.study_id, r.gene_id, r.branch_id): r.gbi for r in d.collect()}
    old, new = key(baseline.ratio(baseline.trim(m))), key(baseline.study_ratio(m))
    assert set(old) == set(new) and all((old[k] is None) == (v is None) and (v is None or abs(v - old[k]) < 1e-12) for k, v in new.items())


def test_out_of_fold_makes_no_screen_that_is_not_asked_for(spark, monkeypatch):
    """l12_sensitivity and l10_fingerprints: no global screen for the nested recipe, no fits of variants for the fitted baseline."""
    from cladeframe.plans import validation as plans

    def refuse(*a, **k):
        raise AssertionError("not needed")

    monkeypatch.setattr(plans, "_full_fits", refuse)
    got = {(r.study_id, r.branch_id): r for r in plans.l10_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.undo()
    fit = plans._full_fits(spark, "/root/testdata/sf0.001")[0].where("model = 'declared_baseline' AND coefficient <> 0")
    n = {r.study_id: r["count"] for r in fit.groupBy("study_id").count().collect()}
    assert {r.study_id for r in got.values()} == set(n) and all(r.n_predictors == n[s] for (s, _), r in got.items())
    monkeypatch.setattr(plans.baseline, "screen", refuse)
    assert plans.l12_sensitivity(spark, "/root/testdata/sf0.001").count() > 0


def test_tables_of_studies_stay_out_of_the_driver(spark, tmp_path):
    """r05_multi_run: Parquet files are far smaller than their rows, and draws far more than the blocks they are made from; none of them is broadcast."""
    from cladeframe.operators import traits

    def saved(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    at = "row_id bigint, study_id string, {}, loaded_at timestamp, retired_at timestamp"
    c = saved("c", [(i, "s", f"b{i}", "terminal", f"t{i}", None, None) for i in range(9)], at.format("branch_id string, branch_type string, terminal_taxon string"))
    trait = saved("t", [(i, "s", f"t{i}", float(i % 2), None, None) for i in range(9)], at.format("species string, binary_trait double"))
    g = saved("g", [(i, "s", f"t{i}", f"g{i // 3}", None, None) for i in range(9)], at.format("species string, genus string"))
    t = traits.terminal_states(c, trait, g)
    assert len(t.collect()) == 9 and "Broadcast" not in plan(t)
    t.write.parquet(str(tmp_path / "terminals"))
    t = spark.read.parquet(str(tmp_path / "terminals"))
    assert "Broadcast" not in plan(validation.roles(t, validation.make_folds(t, 1)))

    universe = spark.createDataFrame([("s", f"m{j:02d}") for j in range(12)] + [("t", "a"), ("t", "b")], "study_id string, member string")
    observed = saved("o", [("s", 5, 4, 0.5), ("t", 2, 2, 1.0)], "study_id string, n_first bigint, n_second bigint, jaccard double")
    draws = sets.turnover_draws(universe, observed.select("study_id", "n_first", "n_second"), 400)
    x = np.array([r.jaccard for r in draws.where("study_id = 's'").collect()])
    draws.write.parquet(str(tmp_path / "draws"))
    summary = sets.turnover_summary(observed, spark.read.parquet(str(tmp_path / "draws")))
    got = {r.study_id: r for r in summary.collect()}
    assert "Broadcast" not in plan(summary)
    s, t = got["s"], got["t"]
    assert s.n_draws == 400 and (s.null_low, s.null_median, s.null_high) == pytest.approx(tuple(np.quantile(x, [0.025, 0.5, 0.975])))
    assert s.p == pytest.approx(((x >= 0.5).sum() + 1) / 401) and s.z == pytest.approx((0.5 - x.mean()) / x.std(ddof=1))
    assert (t.null_median, t.p, t.z, t.enrichment, t.n_draws) == (1.0, 1.0, None, 1.0, 400)


def test_fingerprints_of_both_baselines(spark, tmp_path):
    """l10_fingerprints: every predictor of either coding with every terminal, and the held-out prediction of that coding."""
    from cladeframe.plans import validation as plans

    own = F.col("study_id").isin("ST00000012", "ST00000026")
    for n in ("state_ledger", "coordinates", "trait", "taxon_groups"):
        spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet").where(own).write.parquet(str(tmp_path / f"{n}.parquet"))
    got = plans.l10_fingerprints(spark, str(tmp_path)).toPandas()
    fit = plans._full_fits(spark, str(tmp_path))[0].where("coefficient <> 0 AND model IN ('declared_baseline', 'wide_baseline')").toPandas()
    tips = plans.states(spark, str(tmp_path)).groupBy("study_id").count().toPandas().set_index("study_id")["count"]
    assert set(got.model) == {"declared_baseline", "wide_baseline"} and len(got) == sum(tips[s] for s in fit.study_id)
    beta = fit.set_index(["study_id", "model", "gene_id"]).coefficient
    assert np.allclose(got.coefficient, beta.loc[list(zip(got.study_id, got.model, got.gene_id))]) and np.allclose(got.contribution, got.coefficient * got.scaled)
    for _, d in got.groupby(["study_id", "model", "branch_id"]):
        assert (d.n_predictors == len(d)).all() and (d.n_imputed == d.imputed.sum()).all() and np.allclose(d.logit, d.intercept + d.contribution.sum())
    wide = variants.model_variants(plans.states(spark, str(tmp_path))).where("model = 'wide_baseline'").drop("model")
    r, b = plans.rates(spark, str(tmp_path)), tree.parsimony_states(plans._edges(spark, str(tmp_path)), wide)
    oof = validation.out_of_fold(r, wide, validation.make_folds(wide, 20260523), validation.fold_features(r, wide, branches=b)).toPandas().set_index(["study_id", "branch_id"]).prediction
    d = got[(got.model == "wide_baseline") & got.held_out_probability.notna()]
    assert len(d) and np.allclose(d.held_out_probability, oof.loc[list(zip(d.study_id, d.branch_id))], atol=1e-6)
