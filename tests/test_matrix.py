"""Cells, baseline, models, rates, quality, association and trees: hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.errors import ContractError, RefusedError
from cladeframe.functions.graphs import components, strong_components
from cladeframe.functions.stats import adjust, auc, incomplete_beta
from cladeframe.operators import association, baseline, c2, c3, cells, qc, rates, sets, tree, validation
from cladeframe.workspace import Workspace

SCHEMA = "study_id string, gene_id string, branch_id string, coord_state string, value double, value_reason string"


def grid(spark, rows, study="s"):
    """A matrix as a list of rows of values; None is structurally absent."""
    out = [(study, f"g{i}", f"b{j}", "observed" if v is not None else "NA_struct", None if v is None else float(v), None) for i, row in enumerate(rows) for j, v in enumerate(row)]
    return spark.createDataFrame(out, SCHEMA)


def fitted(spark, rows, **k):
    f = c3.fit(c3.domain(grid(spark, rows)), Workspace(spark, "t"), **k)
    return {(r.gene_id, r.branch_id): r for r in f.collect()}


def test_closed_form_and_interior_zeros(spark):
    got = fitted(spark, [[1, 2, 3], [4, 5, 6]])
    for (g, b), r in got.items():
        row, col = ([6, 15][int(g[1])], [5, 7, 9][int(b[1])])
        assert r.mu == pytest.approx(row * col / 21) and r.certified
    assert all(r.mu == pytest.approx(0.5) for r in fitted(spark, [[1, 0], [0, 1]]).values())


def test_boundaries(spark):
    got = fitted(spark, [[0, 0, 0], [1, 2, 3]])
    assert got["g0", "b0"].support_state == "ZERO_MARGIN_BOUNDARY" and got["g0", "b0"].mu == 0
    got = fitted(spark, [[0, None], [None, 3]])
    assert got["g0", "b0"].support_state == "ZERO_TOTAL_COMPONENT" and got["g1", "b1"].mu == pytest.approx(3)
    # A zero that joins two blocks of positive cells one way only cannot carry flow.
    got = fitted(spark, [[2, 0], [None, 3]])
    assert got["g0", "b1"].support_state == "FACIAL_BOUNDARY" and got["g0", "b1"].mu == 0 and got["g0", "b0"].mu == pytest.approx(2)
    assert c3.fit(c3.domain(grid(spark, [[None]])), Workspace(spark, "t")).count() == 0


def test_joined_way_equals_local(spark):
    """Both ways give the same states, dual coefficients and values, with facial edges, empty components and margins of 0."""
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in r] for r in rng.integers(1, 9, (4, 5))]
    rows[0][1] = None
    four, chain = [[1, 0], [None, 1]], [[2, 0, None, None], [None, 3, 0, None], [None, None, 5, 0], [None, None, None, 7]]
    mixed = [[0, None, None], [None, 3, 0], [None, 0, 0]]
    cycle = [[2, 0, None], [None, 3, 0], [0, None, 4]]
    every = grid(spark, rows, "a")
    for name, r in (("b", four), ("c", chain), ("d", mixed), ("e", cycle), ("f", [[0, 0]])):
        every = every.unionByName(grid(spark, r, name))
    edges = c3.domain(every)
    key = lambda f: {(r.study_id, r.gene_id, r.branch_id): r for r in f.collect()}
    local, joined = key(c3.fit(edges, Workspace(spark, "t"), c3.C3Control(replay=True))), key(c3.fit(edges, Workspace(spark, "t"), local_edges=0))
    assert set(local) == set(joined) and len(local) > 30
    for k, r in local.items():
        o = joined[k]
        assert (r.support_state, r.dual, r.certified) == (o.support_state, o.dual, o.certified) and o.mu == pytest.approx(r.mu, rel=1e-8)
    assert {k[0]: v.support_state for k, v in local.items() if v.dual} == {"b": "FACIAL_BOUNDARY", "c": "FACIAL_BOUNDARY"}
    assert all(v.support_state == "FINITE_INTERIOR" for k, v in local.items() if k[0] == "e") and [v.support_state for k, v in local.items() if k[0] == "f"] == ["ZERO_TOTAL_COMPONENT"] * 2
    # A component above the ceiling fails closed, in both ways.
    small = c3.C3Control(certificate_max_edges=3)
    for way in (c3.LOCAL_EDGES, 0):
        got = key(c3.fit(edges, Workspace(spark, "t"), small, local_edges=way))
        assert {k[0]: r.certified for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": True} and all((r.mu is None) == (not r.certified) for r in got.values())
    told = {r.study_id: r for r in c3.certificates(c3.fit(edges, Workspace(spark, "t"))).collect()}
    assert told["b"].state == "FACIAL_BOUNDARY" and told["a"].state == "FINITE_INTERIOR" and told["f"].state == "ZERO_TOTAL_COMPONENT"
    assert all(r.negative_terms + r.positive_y_with_zero_mu + r.interior_without_mu + r.mu_off_face + r.dual_not_positive + r.dual_on_face == 0 for r in told.values())
    assert all(r["pass"] and r.nonnegative for r in c3.component_margins(edges, Workspace(spark, "t")).collect())


def test_sweeps_that_do_not_end_release_nothing(spark):
    edges = c3.domain(grid(spark, [[1e-9, 1, None], [1, 1, 5], [None, 1e9, 3]]))
    for way in (c3.LOCAL_EDGES, 0):
        got = c3.fit(edges, Workspace(spark, "t"), c3.C3Control(most_sweeps=2), local_edges=way).collect()
        assert all(not r.certified and r.mu is None and r.support_state == "FINITE_INTERIOR" and r.sweeps == 2 for r in got)


def test_registered_rates_stand_on_the_fit(spark, monkeypatch):
    """A table with holes, a facial zero and a component without mass, against scaling by hand."""
    from cladeframe.plans import models

    y = [[1, 200, None], [3, 4, 5], [6, 0, 8000]]
    m = grid(spark, y).unionByName(grid(spark, [[2, 0], [None, 3]], "facial")).unionByName(grid(spark, [[0, None], [None, 3]], "empty"))
    monkeypatch.setattr(models, "matrix", lambda *_: m)
    a = np.array([[np.nan if v is None else v for v in row] for row in y], dtype=float)
    mu = np.where(np.isnan(a), 0.0, 1.0)
    for _ in range(5000):
        mu *= (np.nansum(a, 1) / mu.sum(1))[:, None]
        mu *= np.nansum(a, 0) / mu.sum(0)
    queries = models.R.queries
    got = {(r.study_id, r.gene_id, r.branch_id): r for r in queries["b03_rate_gbi_c3"](spark, "").collect()}
    add = {(r.study_id, r.gene_id, r.branch_id): r.rate for r in queries["b03_rate_add_c3"](spark, "").collect()}
    for i in range(3):
        for j in range(3):
            if y[i][j] is not None:
                assert got["s", f"g{i}", f"b{j}"].rate == pytest.approx(y[i][j] / mu[i, j], rel=1e-4)
                assert add["s", f"g{i}", f"b{j}"] == pytest.approx(y[i][j] - mu[i, j], rel=1e-4, abs=1e-4)
    assert got["facial", "g0", "b1"].support == "FACIAL_BOUNDARY" and got["facial", "g0", "b1"].reason == "baseline_zero"
    assert got["empty", "g0", "b0"].support == "ZERO_TOTAL_COMPONENT"
    assert {r.fatal for r in queries["b02_ratio_contract_c3"](spark, "").collect()} == {0}
    domains = {r.study_id: (r.n_common, r.n_union) for r in queries["f04_common_domain_c3"](spark, "").collect()}
    assert domains == {"s": (7, 8), "facial": (2, 2), "empty": (1, 1)}


def test_c2_complete_table(spark):
    y = np.array([[1.0, 2, 4], [3, 5, 9]])
    f = c2.effects(c3.domain(grid(spark, y.tolist())))
    mu = {(r.gene_id, r.branch_id): r.mu for r in c2.evaluate(c3.domain(grid(spark, y.tolist())), f).collect()}
    x = np.log(y)
    want = np.exp(x.mean(1)[:, None] + x.mean(0)[None] - x.mean())
    assert all(mu[f"g{i}", f"b{j}"] == pytest.approx(want[i, j]) for i in range(2) for j in range(3))


def test_rates_and_boundary(spark):
    m = grid(spark, [[1, 0, 3], [4, 5, None]])
    f = c3.fit(c3.domain(m), Workspace(spark, "t"))
    gbi = rates.rate(m, f, "GBI")
    add = rates.rate(m, f, "ADD_LT").groupBy("gene_id").agg(F.sum("rate").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in add)
    b = {(r.gene_id, r.branch_id): r for r in rates.log_relative(gbi).collect()}
    assert b["g0", "b1"].ratio_state == "EXACT_ZERO_BOUNDARY" and b["g0", "b1"].positive_log is None
    assert b["g1", "b2"].unavailability_reason == "coordinate_unavailable" and b["g0", "b0"].ratio_state == "POSITIVE"
    e = {(r.gene_id, r.branch_id): r for r in rates.encoded(rates.log_relative(gbi), spark.createDataFrame([("s", "g0")], "study_id string, gene_id string")).collect()}
    low = min(r.positive_log for r in b.values() if r.positive_log is not None)
    assert set(k[0] for k in e) == {"g0"} and e["g0", "b1"].encoded == pytest.approx(low - 10)
    for bad in ("logGBI", "GBI_C2"):
        with pytest.raises(RefusedError):
            rates.rate_spec(bad)
    with pytest.raises(RefusedError):
        rates.rate_spec("GBI", pseudocount=1)


def test_trim_and_gbi(spark):
    m = grid(spark, [[*range(1, 18), 40, 40, 40], [0] * 20, [3] + [None] * 19, [None] * 20])
    t = baseline.trim(m)
    n = {r.gene_id: r.n for r in t.where("trimmed").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"g0": 3, "g1": 20, "g2": 1}
    assert baseline.ratio(t).where("gene_id = 'g1' AND gbi IS NOT NULL").count() == 0


def test_strict_prefix(spark):
    for ps, want in (((0.006, 0.006), []), ((0.005, 0.009), []), ((0.001, 0.02, 0.021), [0.001]), ((0.0001, 0.001), [0.0001, 0.001]), ((None,), [])):
        rows = spark.createDataFrame([("s", f"g{i}", p) for i, p in enumerate(ps)], "study_id string, gene_id string, p double")
        got = baseline.strict_prefix(rows, "p", ["study_id"], ["gene_id"]).where("selected").orderBy("p").collect()
        assert [r.p for r in got] == want


def test_welch_and_t(spark):
    assert incomplete_beta(np.array([5.0]), np.array([0.5]), np.array([10 / (10 + 2.228139**2)]))[0] == pytest.approx(0.05, abs=1e-6)
    m = grid(spark, [[1, 2, 3, 4, 6, 8, 10, 12], [1, None, None, None, 2, 3, 4, 5], [2] * 8]).withColumnRenamed("value", "gbi")
    states = spark.createDataFrame([("s", f"b{j}", float(j >= 4)) for j in range(8)], "study_id string, branch_id string, state double")
    got = {r.gene_id: r for r in baseline.screen(m, states).collect()}
    assert got["g0"].t == pytest.approx(-6.5 / np.sqrt(5 / 12 + 20 / 12)) and got["g0"].direction == "fast" and 0 < got["g0"].p < 0.05
    assert got["g1"].reason == "insufficient_finite_group_size" and got["g2"].reason == baseline.REFUSED
    stats = baseline.welch(baseline.group_statistics(m, states))
    assert {r.gene_id: r.t for r in stats.collect()}["g0"] == pytest.approx(got["g0"].t)


def test_adjust_and_auc(spark):
    rows = spark.createDataFrame([("s", f"g{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, None])], "study_id string, gene_id string, p double")
    got = {r.gene_id: r for r in adjust(rows, "p", ["study_id"], ["gene_id"]).collect()}
    assert [got[f"g{i}"].p_bh for i in range(3)] == pytest.approx([0.03, 0.04, 0.04])
    assert [got[f"g{i}"].p_holm for i in range(3)] == pytest.approx([0.03, 0.06, 0.06]) and got["g3"].p_bh is None and got["g0"].n_tests == 3
    pairs = spark.createDataFrame([("s", 0.1, 0.0), ("s", 0.5, 1.0), ("s", 0.5, 0.0), ("s", 0.9, 1.0), ("t", 0.3, 1.0)], "study_id string, x double, y double")
    assert {r.study_id: r.auc for r in auc(pairs, "x", "y", ["study_id"]).collect()} == {"s": 0.875, "t": None}


def test_qc(spark):
    m = grid(spark, [[1, 1, 1, 1, 100], [1, 2, 3, 4, 5]])
    told, warned = qc.flags(m, qc.Rule("r", "mad", "within_gene", multiplier=3.0))
    assert told.count() == 0 and [r.scope_id for r in warned.collect()] == ["g0"]
    strict = qc.flags(m, qc.Rule("r", "quantile", "within_gene", upper_probability=1.0, lower_probability=0.0))[0].count()
    inclusive = qc.flags(m, qc.Rule("r", "quantile", "within_gene", ties="inclusive", upper_probability=1.0, lower_probability=0.0))[0].count()
    assert (strict, inclusive) == (0, 7)
    e = cells.eligibility(m)
    after, ledger = qc.apply_qc(e, qc.flags(m, qc.Rule("r", "absolute", direction="upper", upper=50.0))[0])
    assert after.where("elig_status = 'ineligible'").count() == 1 and ledger.agg(F.sum("n")).first()[0] == 10
    with pytest.raises(RefusedError):
        qc.Rule("r", "quantile", ties="exact_rank")
    with pytest.raises(ContractError):
        qc.flags(m, qc.Rule("r", "custom_mask"), grid(spark, [[None] * 6]))


def test_association_and_calibration(spark):
    m = grid(spark, [[1, 3, 5, 7], [7, 5, 3, 1]]).withColumn("rate", F.col("value")).withColumn("available", F.lit(True))
    states = spark.createDataFrame([("s", f"b{j}", float(j >= 2), "available") for j in range(4)], "study_id string, branch_id string, state double, availability string")
    d = association.domain(m, states)
    got = {r.gene_id: r for r in association.binary(d).collect()}
    assert got["g0"].difference == 4 and got["g1"].difference == -4 and got["g0"].r == pytest.approx(np.corrcoef([1, 3, 5, 7], [0, 0, 1, 1])[0, 1])
    x = association.continuous(d.withColumn("x", F.substring("branch_id", 2, 1).cast("double")), "x")
    got = {r.gene_id: r for r in x.collect()}
    assert got["g0"].slope == pytest.approx(2) and got["g1"].spearman == pytest.approx(-1) and got["g0"].intercept == pytest.approx(1)
    worlds = spark.createDataFrame([("s", r, f"b{j}", float((j - r) % 4 >= 2)) for r in (1, 2, 3) for j in range(4)], "study_id string, replicate int, branch_id string, state double")
    cal = {r.gene_id: r for r in association.calibrate(association.binary(d), association.null_scores(d, worlds), 3).collect()}
    assert cal["g0"].status == "CALIBRATED" and cal["g0"].p == pytest.approx(2 / 4) and cal["g0"].resolution == 0.25
    short = {r.gene_id: r for r in association.calibrate(association.binary(d), association.null_scores(d, worlds), 5).collect()}
    assert short["g0"].status == "NULL_CALIBRATION_INCOMPLETE" and short["g0"].p is None


def test_permuted_worlds(spark):
    rows = [(s, f"b{j:02d}", float(j < k)) for s, m, k in (("few", 6, 2), ("many", 15, 5)) for j in range(m)]
    states = spark.createDataFrame(rows, "study_id string, branch_id string, state double")
    got = {}
    for r in association.permuted_worlds(states, 200).where("state = 1").collect():
        got.setdefault((r.study_id, r.replicate), set()).add(r.branch_id)
    many = [frozenset(got["many", i]) for i in range(1, 201)]
    assert {len(x) for x in many} == {5} and len(set(many)) > 180
    share = [sum(f"b{j:02d}" in x for x in many) / 200 for j in range(15)]
    assert all(abs(x - 1 / 3) < 0.12 for x in share)
    ways = association.labellings(states)
    assert {r.study_id: r.n_labellings for r in ways.collect()} == {"few": 15, "many": 3003}
    cal = spark.createDataFrame([("few", "CALIBRATED", 0.1), ("many", "CALIBRATED", 0.1)], "study_id string, status string, p double")
    assert {r.study_id: (r.status, r.p) for r in association.mark_few(cal, ways, 200).collect()} == {"few": ("TOO_FEW_LABELLINGS", None), "many": ("CALIBRATED", 0.1)}


def test_violations_and_empty(spark):
    bad = spark.createDataFrame([("s", "g", "b", "observed", None, None), ("s", "g", "b", "NA_fuse", 1.0, None), ("s", "h", "b", "odd", None, None), ("s", "h", "c", "observed", float("inf"), None)], SCHEMA)
    got = {r.rule for r in cells.violations(bad).collect()}
    assert got == {"reason_missing", "payload_off_observed", "unknown_state", "payload_not_finite", "repeated_key"}
    with pytest.raises(ContractError):
        cells.require_valid(bad)
    empty = bad.limit(0)
    assert cells.violations(empty).count() == baseline.ratio(baseline.trim(empty)).count() == qc.value_summary(empty, ["study_id"]).count() == 0


def test_mask_hash_ignores_order(spark):
    m = grid(spark, [[1, 2], [3, None]])
    a = cells.mask_hash(m, F.col("value").isNotNull()).first().mask_sha256
    assert a == cells.mask_hash(m.orderBy(F.desc("branch_id")).repartition(3), F.col("value").isNotNull()).first().mask_sha256
    assert a != cells.mask_hash(m, F.col("value") > 1).first().mask_sha256


def test_newick():
    edges, labels = tree.parse_newick("((a:1,'b c':2)x:0.5,d[note]:3);")
    assert [(p, c) for p, c, _ in edges] == [(0, 1), (1, 2), (1, 3), (0, 4)] and labels == {2: "a", 3: "b c", 1: "x", 4: "d"}
    assert [w for *_, w in edges] == [0.5, 1.0, 2.0, 3.0]
    for bad in ("((a,b);", "(a,b));", "a,b;"):
        with pytest.raises(ContractError):
            tree.parse_newick(bad)


def test_tree_and_parsimony(spark):
    sides = [("B1", "terminal", "a", "b;c;d"), ("B2", "terminal", "b", "a;c;d"), ("B3", "terminal", "c", "a;b;d"), ("B4", "terminal", "d", "c;b;a"), ("B5", "internal", "b;a", "d;c")]
    s = spark.createDataFrame([("s", *x) for x in sides], "study_id string, branch_id string, branch_type string, a string, b string")
    s = s.withColumn("a", tree.side_key(F.col("a"))).withColumn("b", tree.side_key(F.col("b")))
    assert tree.split_issues(s).count() == 0
    e = tree.rooted_edges(s)
    assert {r.branch_id: r.parent_branch for r in e.collect()} == {"B1": "B5", "B2": "B5", "B3": "B4", "B4": None, "B5": "B4"}
    assert all(r.n_matches == 1 and r.split_branch == r.branch_id for r in tree.join_edges(e, s).collect())
    tips = spark.createDataFrame([("s", "B1", 1.0), ("s", "B2", 1.0), ("s", "B3", 0.0)], "study_id string, branch_id string, state double")
    got = {r.branch_id: r.state for r in tree.parsimony_states(e, tips).collect()}
    assert got["B5"] == 1.0 and got["B3"] == 0.0 and got["B1"] == 1.0
    assert tree.split_issues(s.withColumn("b", F.concat("b", F.lit(";a")))).count() >= 1


def test_graph_routines():
    assert components(5, np.array([0, 3]), np.array([1, 4])).tolist() == [0, 0, 1, 2, 2]
    got = strong_components(4, np.array([0, 1, 2]), np.array([1, 0, 3]))
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3


def test_lasso_optimality():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    y = (x[:, 0] + rng.normal(size=40) > 0).astype(float)
    b0, b, lam = validation.fit_lasso(x, y)
    g = x.T @ (y - 1 / (1 + np.exp(-(b0 + x @ b)))) / 40
    assert all(abs(g[j] - lam * np.sign(b[j])) < 1e-5 if b[j] else abs(g[j]) <= lam + 1e-5 for j in range(4))


def test_fold_subtraction_and_fits(spark):
    rng = np.random.default_rng(5)
    m = grid(spark, rng.normal(size=(3, 9)).tolist()).withColumnRenamed("value", "gbi")
    t = spark.createDataFrame([("s", f"b{j}", f"sp{j}", f"gen{j % 3}", [0.0, 1.0, 0.5][j % 3] if j > 6 else float(j % 2)) for j in range(9)], "study_id string, branch_id string, species string, genus string, state double")
    both = t.where("state <> 0.5")
    held = {(r.genus, r.gene_id): (r.n0, r.n1) for r in baseline.held_out_statistics(m, both.drop("genus"), both).collect()}
    direct = {(g, r.gene_id): (r.n0, r.n1) for g in ("gen0", "gen1", "gen2") for r in baseline.group_statistics(m, both.where(F.col("genus") != g)).collect()}
    assert {k: v for k, v in held.items() if k in direct} == direct
    folds = validation.make_folds(t, 100)
    features = folds.select("study_id", "genus", F.lit("g0").alias("gene_id")).where("genus <> 'gen2'")
    out = validation.out_of_fold(m, t, folds, features).collect()
    assert {r.status for r in out if r.held_out == "gen2"} == {"null_intercept_only_no_FDR_features_in_training_ttest"}
    # A class too small to leave one out is refused and predicts nothing; every other row has a prediction.
    assert all((r.prediction is None) == (r.status == "refused_class_of_fewer_than_three") for r in out if r.branch_id) and all(0 <= r.prediction <= 1 for r in out if r.prediction is not None)


def test_sets(spark):
    rows = spark.createDataFrame([("s", n, m) for n, ms in (("A", "aab"), ("B", "bcd")) for m in ms] + [("s", "A", "u")], "study_id string, name string, member string")
    got = sets.compare_sets(rows, ["study_id"], "name", "member", "A", "B").first()
    assert (got.n_first, got.n_second, got.n_both, got.jaccard) == (3, 3, 1, 0.2)
    modules = spark.createDataFrame([(x, "m1" if x in "ab" else "m2") for x in "abcd"], "member string, module string")
    m = sets.module_metrics(rows, modules, ["study_id"], "name", "member", "A", "B").first()
    # Members without a module count among the members and in no module metric, as in the reference's fixture (1/5, 1/2, 1/sqrt 2).
    assert (m.n_first, m.n_first_annotated, m.n_second_annotated) == (3, 2, 3)
    assert m.gene_jaccard == pytest.approx(1 / 5) and m.module_jaccard == pytest.approx(1 / 2) and m.module_cosine == pytest.approx(1 / np.sqrt(5))
    m = sets.module_metrics(rows, modules.where("member <> 'd'"), ["study_id"], "name", "member", "A", "B").first()
    assert m.gene_jaccard == pytest.approx(1 / 5) and m.module_jaccard == pytest.approx(1 / 2) and m.module_cosine == pytest.approx(1 / np.sqrt(2))


def test_turnover_draws(spark):
    """50 draws against brute force, and as many draws in the registered query as the reference takes."""
    from cladeframe.plans import validation as plans

    universe = spark.createDataFrame([("s", f"m{j:02d}") for j in range(12)] + [("t", "a"), ("t", "a"), ("t", "b")], "study_id string, member string")
    sizes = spark.createDataFrame([("s", 5, 4), ("t", 1, 0)], "study_id string, n_first bigint, n_second bigint")

    def key(draw, place, stream):
        x = (place * 7919 + draw * 104729 + stream * 15485863) % 1000003
        x = (x * x + place * 31 + stream) % 1000003
        return (x * x + draw * 17 + place) % 1000003

    got = {(r.study_id, r.draw): (r.n_both, r.n_union) for r in sets.turnover_draws(universe, sizes, 50).collect()}
    assert len(got) == 100
    for study, n, k1, k2 in (("s", 12, 5, 4), ("t", 2, 1, 0)):
        for d in range(1, 51):
            a, b = ({*sorted(range(1, n + 1), key=lambda p: (key(d, p, stream), p))[:k]} for k, stream in ((k1, 1), (k2, 2)))
            assert got[study, d] == (len(a & b), len(a | b))
    assert plans._DRAWS == 10_000
    assert sets.turnover_draws(universe, sizes, 10_000).count() == 20_000


def test_tokens(spark):
    rows = spark.createDataFrame([("1.5",), ("NA_fuse",), ("NaN",), ("",), (None,), ("1e5",), ("abc",), ("1d",), (" 2 ",)], "token string")
    assert [(r.token_class, r.value) for r in cells.parse_tokens(rows).collect()] == [("finite_numeric", 1.5), ("NA_fuse", None), ("NaN", None), ("empty", None), ("empty", None), ("finite_numeric", 1e5), ("unknown", None), ("unknown", None), ("finite_numeric", 2.0)]
