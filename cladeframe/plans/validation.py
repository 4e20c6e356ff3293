"""Queries of trees, grouped validation, sets and turnover."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import baseline, reporting, sets, tree, validation, variants
from cladeframe.plans.matrix import digits, matrix, rates, states
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import CELLS, GBI, STATES, TRIM, sig, with_
from cladeframe.sources.tables import table
from cladeframe.workspace import Workspace, unbroadcast

R = Registry()

_SPLITS = """splits AS (SELECT study_id, branch_id, branch_type, array_to_string(list_sort(string_split(side_a_taxa, ';')), ';') AS a, array_to_string(list_sort(string_split(side_b_taxa, ';')), ';') AS b FROM coords)"""


def _splits(spark, folder):
    return tree.splits(table(spark, folder, "coordinates"))


def _edges(spark, folder):
    return Workspace(spark, "tree").save(tree.rooted_edges(_splits(spark, folder)), "edges")


@R.add("b17_side_keys", with_(STATES, _SPLITS) + "SELECT study_id, branch_id, a AS side_a, b AS side_b FROM splits")
def b17_side_keys(spark, folder):
    return _splits(spark, folder).select("study_id", "branch_id", F.col("a").alias("side_a"), F.col("b").alias("side_b"))


@R.add("c14_split_issues", with_(STATES, _SPLITS) + """
  SELECT study_id, branch_id, issue FROM (SELECT s.study_id, branch_id, CASE WHEN a IS NULL OR b IS NULL OR a = '' OR b = '' THEN 'missing_side'
    WHEN len(list_intersect(string_split(a, ';'), string_split(b, ';'))) > 0 THEN 'overlap' WHEN len(list_distinct(list_concat(string_split(a, ';'), string_split(b, ';')))) <> n_tips THEN 'not_all_tips'
    WHEN (len(string_split(a, ';')) = 1 OR len(string_split(b, ';')) = 1) <> (branch_type = 'terminal') THEN 'type' END AS issue
  FROM splits s LEFT JOIN (SELECT study_id, max(len(list_distinct(list_concat(string_split(a, ';'), string_split(b, ';'))))) AS n_tips FROM splits WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) t ON s.study_id = t.study_id) WHERE issue IS NOT NULL""")
def c14_split_issues(spark, folder):
    return tree.split_issues(_splits(spark, folder))


@R.add("f06_edge_split_join", with_(STATES, _SPLITS) + """, own AS (SELECT * FROM splits WHERE a IS NOT NULL AND b IS NOT NULL),
  root AS (SELECT study_id, max(t) AS root FROM (SELECT study_id, unnest(string_split(a, ';')) AS t FROM own UNION ALL SELECT study_id, unnest(string_split(b, ';')) FROM own) GROUP BY 1),
  e AS (SELECT study_id, branch_id, array_to_string(list_sort(list_distinct(CASE WHEN NOT list_contains(string_split(a, ';'), root) THEN string_split(a, ';') WHEN NOT list_contains(string_split(b, ';'), root) THEN string_split(b, ';') ELSE [] END)), ';') AS clade FROM own JOIN root USING (study_id)),
  side AS (SELECT study_id, branch_id AS split_branch, a AS key FROM splits UNION SELECT study_id, branch_id, b FROM splits)
  SELECT e.study_id, branch_id, clade, count(split_branch) AS n_matches, min(split_branch) AS split_branch FROM e LEFT JOIN side s ON s.study_id = e.study_id AND s.key = e.clade GROUP BY 1, 2, 3""")
def f06_edge_split_join(spark, folder):
    """Rooted tree edges joined to the split side that equals their clade."""
    return tree.join_edges(_edges(spark, folder), _splits(spark, folder))


@R.add("i01_parsimony_states")
def i01_parsimony_states(spark, folder):
    """States of all branches by maximum parsimony from the terminal states."""
    return tree.parsimony_states(_edges(spark, folder), states(spark, folder))


_VARIANTS = ", ".join(f"('{variants.name(*v)}', '{v[0]}', '{v[1]}', {v[2]})" for v in variants.VARIANTS)


@R.add("i03_model_variants", with_(STATES) + f"""
  SELECT s.study_id, model, branch_id, CASE WHEN coalesce(n_focal >= k, false) AND s.state = 1 AND ((rule = 'drop' AND coalesce(place = k, false)) OR (rule = 'only' AND NOT coalesce(place = k, false))) THEN 0.5::DOUBLE WHEN axis = 'wide' AND s.state = 0.5 THEN 1.0 ELSE s.state END AS state
  FROM states s CROSS JOIN (VALUES {_VARIANTS}) v(model, axis, rule, k) LEFT JOIN (SELECT study_id, genus, row_number() OVER (PARTITION BY study_id ORDER BY genus) AS place FROM (SELECT DISTINCT study_id, genus FROM states WHERE state = 1 AND genus IS NOT NULL)) f ON f.study_id = s.study_id AND f.genus = s.genus
    LEFT JOIN (SELECT study_id, count(DISTINCT genus) AS n_focal FROM states WHERE state = 1 GROUP BY 1) n ON n.study_id = s.study_id""")
def i03_model_variants(spark, folder):
    """The fourteen codings of the trait, terminal by terminal."""
    return variants.model_variants(states(spark, folder)).select("study_id", "model", "branch_id", "state")


def _variant_states(spark, folder, work):
    """Terminals and reconstructed branch states of all variants; the arrays have a variant at every place."""
    t = work.save(variants.model_variants(states(spark, folder)), "terminals")
    names = [variants.name(*v) for v in variants.VARIANTS]
    tips = t.groupBy("study_id", "branch_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "state"))).alias("m")).select("study_id", "branch_id", F.array(*[F.col("m")[n] for n in names]).alias("states"))
    arrays = tree.parsimony_arrays(_edges(spark, folder), tips)
    rows = arrays.select("study_id", "branch_id", F.posexplode("states").alias("i", "state"))
    return t, work.save(rows.select("study_id", "branch_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("model"), "state"), "states")


@R.add("i03_model_states")
def i03_model_states(spark, folder):
    """Branches by reconstructed state in every variant."""
    _, b = _variant_states(spark, folder, Workspace(spark, "i03"))
    return b.groupBy("study_id", "model", "state").agg(F.count(F.lit(1)).alias("n_branches"))


_PERMUTATIONS = 200


@R.add("k09_permutation_worlds")
def k09_permutation_worlds(spark, folder):
    """Worlds of relabelled terminals: reconstruct, screen, and compare the observed screen with the worlds."""
    return permutation_worlds(_edges(spark, folder), states(spark, folder), rates(spark, folder), _PERMUTATIONS)


def permutation_worlds(edges, s, r, n_worlds):
    """Genes selected (strict prefix at 0.01), and the share of them with t > 0, against ``n_worlds`` worlds.

    The observed screen has t as background minus focal, the worlds have it as focal minus background; both call t > 0 slow.  This
    mismatch of direction is the historical one and kept.  A world that selects nothing counts as 0 and has no share.
    """
    from cladeframe.operators.association import group_sums, labellings, permuted_worlds, worlds_as_arrays

    work = Workspace(edges.sparkSession, "k09")
    s = work.save(s.where(F.col("state").isin(0.0, 1.0)), "labelled")
    r = work.save(r.where("gbi IS NOT NULL").select("study_id", "gene_id", "branch_id", "gbi"), "rates")
    arrays = work.save(tree.parsimony_arrays(edges, worlds_as_arrays(permuted_worlds(s, n_worlds), s)), "worlds")
    observed = arrays.select("study_id", "branch_id", F.get("states", F.lit(0)).alias("state"))
    own = baseline.screen(r, observed).where("selected").groupBy("study_id").agg(F.count(F.lit(1)).alias("observed_n"), F.avg(F.when(F.col("t") > 0, 1.0).otherwise(0.0)).alias("observed_slow"))
    tested = baseline.welch(group_sums(r, arrays, "gbi").where("replicate > 0"), focal_first=True).where("p IS NOT NULL").select("study_id", "gene_id", "replicate", "t", "p")
    chosen = baseline.strict_prefix(tested, "p", ["study_id", "replicate"], ["gene_id"]).where("selected")
    chosen = chosen.groupBy("study_id", "replicate").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("t") > 0, 1.0).otherwise(0.0)).alias("slow"))
    every = s.select("study_id").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_worlds))))
    per = work.save(every.join(chosen, ["study_id", "replicate"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))), "screens")
    rows = per.join(own, "study_id", "left").withColumn("observed_n", F.coalesce("observed_n", F.lit(0).cast("bigint")))
    few = F.first("n_labellings") <= n_worlds
    return rows.join(labellings(s), "study_id").groupBy("study_id").agg(
        F.first("observed_n").alias("observed_n"), F.first("observed_slow").alias("observed_slow"), F.median("n").alias("null_median"), F.min("n").alias("null_min"), F.max("n").alias("null_max"),
        F.count("slow").alias("n_defined"), F.median("slow").alias("null_median_slow"), F.min("slow").alias("null_min_slow"), F.max("slow").alias("null_max_slow"),
        F.when(~few, (F.count_if(F.col("n") >= F.col("observed_n")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
        F.when(~few & F.first("observed_slow").isNotNull() & (F.count("slow") > 0), (F.count_if(F.col("slow") >= F.col("observed_slow")) + 1) / (F.count("slow") + 1)).alias("slow_p"),
        F.count(F.lit(1)).alias("n_worlds"), F.when(few, "TOO_FEW_LABELLINGS").otherwise("CALIBRATED").alias("status"))


@R.add("f07_terminal_frame", with_(STATES) + "SELECT study_id, branch_id, species, genus, state FROM states")
def f07_terminal_frame(spark, folder):
    return states(spark, folder)


@R.add("f10_gene_annotation", with_(CELLS, STATES) + """SELECT c.study_id, c.branch_id, CASE WHEN m.coord_state IS NULL THEN 'absent' WHEN m.coord_state <> 'observed' THEN m.coord_state WHEN m.value IS NULL THEN 'no payload' WHEN m.value = 0 THEN 'zero' ELSE 'value' END AS label
  FROM coords c LEFT JOIN (SELECT * FROM cells WHERE gene_id = (SELECT gene_id FROM cells GROUP BY 1 ORDER BY count(*) DESC, gene_id LIMIT 1)) m USING (study_id, branch_id) WHERE c.side_a_taxa IS NOT NULL AND c.side_b_taxa IS NOT NULL""")
def f10_gene_annotation(spark, folder):
    """The rooted tree edges of every study with the cells of the gene that has most of them."""
    m = matrix(spark, folder)
    gene = m.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("gene_id", F.struct("n", F.transform(F.split("gene_id", ""), lambda c: -F.ascii(c)))).alias("gene_id"))
    return tree.annotate_gene(m.join(gene, "gene_id", "left_semi"), _edges(spark, folder)).select("study_id", "branch_id", "label")


@R.add("l01_folds", with_(STATES) + """SELECT study_id, CAST(k AS INT) AS fold_ord, 'fold_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, genus, 20260523 + k AS seed FROM (
    SELECT study_id, genus, row_number() OVER (PARTITION BY study_id ORDER BY genus) AS k FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL))""")
def l01_folds(spark, folder):
    return validation.make_folds(states(spark, folder), 20260523)


@R.add("l13_role_provenance", with_(STATES) + """SELECT f.study_id, fold_id, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role = 'excluded') AS n_excluded FROM (
    SELECT f.study_id, fold_id, CASE WHEN s.state = 0.5 THEN 'excluded' WHEN s.genus = f.genus THEN 'test' ELSE 'train' END AS role FROM (
      SELECT study_id, genus, 'fold_' || lpad(CAST(row_number() OVER (PARTITION BY study_id ORDER BY genus) AS VARCHAR), 3, '0') AS fold_id FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL)) f JOIN states s ON s.study_id = f.study_id) f GROUP BY 1, 2""")
def l13_role_provenance(spark, folder):
    s = states(spark, folder)
    return validation.role_counts(validation.roles(s, validation.make_folds(s, 20260523)))


@R.add("l04_design", with_(CELLS, TRIM, GBI, STATES) + f"""
  SELECT study_id, genus, gene_id, n_values, n_train, {sig("mean", 6)} AS mean, {sig("CASE WHEN n_train > 1 THEN sqrt(n_values * v / (n_train - 1)) END", 5)} AS sd, CASE WHEN n_values = 0 THEN 'all_missing' WHEN sqrt(n_values * v / (n_train - 1)) <= 1e-12 THEN 'zero_variance' END AS dropped
  FROM (SELECT f.study_id, f.genus, g.gene_id, count(gbi) AS n_values, avg(gbi) AS mean, var_pop(gbi) AS v
    FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL AND state IN (0, 1)) f JOIN (SELECT DISTINCT study_id, gene_id FROM rates JOIN states USING (study_id, branch_id) WHERE state IN (0, 1)) g USING (study_id)
      LEFT JOIN (SELECT study_id, gene_id, gbi, genus AS own FROM rates JOIN states USING (study_id, branch_id) WHERE state IN (0, 1)) r ON r.study_id = f.study_id AND r.gene_id = g.gene_id AND (own IS NULL OR own <> f.genus) GROUP BY 1, 2, 3)
  JOIN (SELECT f.study_id, f.genus, count(*) AS n_train FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL AND state IN (0, 1)) f JOIN states s ON s.study_id = f.study_id AND s.state IN (0, 1) AND (s.genus IS NULL OR s.genus <> f.genus) GROUP BY 1, 2) USING (study_id, genus)""")
def l04_design(spark, folder):
    d = validation.design(rates(spark, folder), states(spark, folder))
    return d.withColumn("mean", digits("mean", 6)).withColumn("sd", digits("sd", 5))


def _fold_inputs(spark, folder):
    """Rates, terminals, states of all branches (terminals as declared, internal ones by parsimony), and their workspace."""
    work = Workspace(spark, "folds")
    r = work.save(baseline.study_ratio(matrix(spark, folder)), "rates")
    s = work.save(states(spark, folder), "terminals")
    b = work.save(tree.parsimony_states(_edges(spark, folder), s).select("study_id", "branch_id", "state"), "branches")
    return r, s, b, work


@R.add("l03_fold_features")
def l03_fold_features(spark, folder):
    """Genes selected in each fold by the training screen over all branches, strict prefix at 0.01."""
    r, s, b, _ = _fold_inputs(spark, folder)
    return validation.fold_features(r, s, branches=b)


def _everywhere(inputs):
    """The features of one screen on all data."""
    r, _, b, work = inputs
    return work.save(baseline.screen(r, b), "screen").where("selected").select("study_id", "gene_id")


def _out_of_fold(spark, folder, recipe="nested_phase12B", inputs=None, everywhere=None):
    """Held-out predictions, the screen of each fold (nested recipes) and the features of the global screen (``everywhere``, or as the global recipe makes them)."""
    inputs = inputs or _fold_inputs(spark, folder)
    r, s, b, work = inputs
    folds = validation.make_folds(s, 20260523)
    screen = None
    if recipe == "global_screen_foldwise":
        features = everywhere = _everywhere(inputs) if everywhere is None else everywhere
    else:
        screen = work.save(validation.fold_screen(r, s, branches=b), "fold-screen")
        features = screen.where("selected")
    return work.save(validation.out_of_fold(r, s, folds, features, recipe=recipe), f"oof-{recipe}"), screen, everywhere


@R.add("l05_out_of_fold")
def l05_out_of_fold(spark, folder):
    """Held-out lasso predictions of every fold of every study, features selected within the fold."""
    return _out_of_fold(spark, folder)[0]


@R.add("l05_global_screen")
def l05_global_screen(spark, folder):
    """The same with the features of one screen on all data."""
    return _out_of_fold(spark, folder, "global_screen_foldwise")[0]


@R.add("l11_fold_table")
def l11_fold_table(spark, folder):
    """One row per fold, with the overlap of its selection with the global one."""
    inputs = _fold_inputs(spark, folder)
    oof, screen, everywhere = _out_of_fold(spark, folder, inputs=inputs, everywhere=_everywhere(inputs))
    return validation.fold_table(oof, screen, everywhere)


@R.add("l11_selected_predictors")
def l11_selected_predictors(spark, folder):
    return validation.selected_table(_out_of_fold(spark, folder)[0])


@R.add("l11_recipe_delta")
def l11_recipe_delta(spark, folder):
    """Nested predictions beside those of the global screen, and their difference, species by species."""
    inputs = _fold_inputs(spark, folder)
    a, _, everywhere = _out_of_fold(spark, folder, inputs=inputs, everywhere=_everywhere(inputs))
    b = _out_of_fold(spark, folder, "global_screen_foldwise", inputs, everywhere)[0]
    both = a.where("branch_id IS NOT NULL").select("study_id", "species", "branch_id", "state", F.col("prediction").alias("nested")).join(b.where("branch_id IS NOT NULL").select("study_id", "branch_id", F.col("prediction").alias("global")), ["study_id", "branch_id"], "left")
    return both.withColumn("prediction_delta", F.col("nested") - F.col("global"))


@R.add("l12_sensitivity")
def l12_sensitivity(spark, folder):
    """Area under the curve, folds by outcome and decision label of every study."""
    return validation.validation_summary(_out_of_fold(spark, folder)[0])


_DECISIONS = "(VALUES (0.50, 0.96), (0.52, 0.95), (0.53, 0.95), (0.50, 0.94), (0.59, 0.10), (0.60, 0.10), (0.70, 0.80), (0.74, 0.79), (0.75, 0.10), (0.99, 0.00), (NULL, 0.5), (0.9, NULL)) t(auc, none_selected)"


@R.add("l12_decision_labels", f"""SELECT auc::DOUBLE AS auc, none_selected::DOUBLE AS none_selected, CASE WHEN auc IS NULL OR none_selected IS NULL THEN NULL WHEN auc BETWEEN 0.48 AND 0.52 AND none_selected >= 0.95 THEN 'strict_null_collapse'
  WHEN auc < 0.60 OR none_selected >= 0.80 THEN 'near_collapse' WHEN auc < 0.75 THEN 'strong_attenuation' ELSE 'retained_sparse_prediction' END AS decision FROM {_DECISIONS}""")
def l12_decision_labels(spark, folder):
    """The thresholds of the decision label, at and beside each of them."""
    rows = [(0.50, 0.96), (0.52, 0.95), (0.53, 0.95), (0.50, 0.94), (0.59, 0.10), (0.60, 0.10), (0.70, 0.80), (0.74, 0.79), (0.75, 0.10), (0.99, 0.00), (None, 0.5), (0.9, None)]
    d = spark.createDataFrame(rows, "auc double, none_selected double")
    return d.withColumn("decision", validation.decision(F.col("auc"), F.col("none_selected")))


@R.add("l13_taxon_roles", with_(STATES) + """SELECT f.study_id, fold_id, species AS taxon_id, CASE WHEN s.state = 0.5 THEN 'excluded' WHEN s.genus = f.genus THEN 'test' ELSE 'train' END AS role, s.genus AS "group" FROM (
      SELECT study_id, genus, 'fold_' || lpad(CAST(row_number() OVER (PARTITION BY study_id ORDER BY genus) AS VARCHAR), 3, '0') AS fold_id FROM (SELECT DISTINCT study_id, genus FROM states WHERE genus IS NOT NULL)) f JOIN states s ON s.study_id = f.study_id""")
def l13_taxon_roles(spark, folder):
    """The role of every species in every fold."""
    s = states(spark, folder)
    return validation.taxon_roles(validation.roles(s, validation.make_folds(s, 20260523)))


def _full_fits(spark, folder):
    """The fourteen full-data fits of every study, on the features of their own global screens."""
    work = Workspace(spark, "full")
    t, b = _variant_states(spark, folder, work)
    r = work.save(rates(spark, folder).select("study_id", "gene_id", "branch_id", "gbi"), "rates")
    screen = work.save(baseline.screen(r, b, extra=("model",)), "screen")
    return work.save(validation.full_fit(r, t, screen.where("selected")), "fit"), screen, r, t


@R.add("l07_full_coefficients")
def l07_full_coefficients(spark, folder):
    f = _full_fits(spark, folder)[0].where("gene_id IS NOT NULL")
    sign = F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative").otherwise("zero")
    return f.select("study_id", "model", "gene_id", "status", "coefficient", (F.col("coefficient") != 0).alias("selected"), sign.alias("coefficient_sign"), "lambda")


@R.add("l07_full_summary")
def l07_full_summary(spark, folder):
    return validation.full_summary(_full_fits(spark, folder)[0])


@R.add("l07_partition")
def l07_partition(spark, folder):
    """Predictors of the two baselines: of one only, of the other only, of both."""
    return validation.partition(_full_fits(spark, folder)[0], "declared_baseline", "wide_baseline")


@R.add("l09_internal_projection")
def l09_internal_projection(spark, folder):
    """Terminal-only screen and fit of both baselines, projected onto the internal branches."""
    return internal_projection(rates(spark, folder), variants.model_variants(states(spark, folder)).where("drop_rule = 'baseline'"))


def internal_projection(r, t):
    """Screen and fit on terminals alone, projection onto all other branches with the training transforms; a study without a fit does not come out."""
    work = Workspace(r.sparkSession, "l09")
    r, t = work.save(r.select("study_id", "gene_id", "branch_id", "gbi"), "rates"), work.save(t, "terminals")
    tested = baseline.welch(baseline.group_statistics(r.where("gbi IS NOT NULL"), t.select("study_id", "model", "branch_id", "state"), "gbi", ("model",))).where("p IS NOT NULL")
    chosen = baseline.strict_prefix(tested, "p", ["study_id", "model"], ["gene_id"]).where("selected")
    fit = work.save(validation.full_fit(r, t, chosen), "fit").where("status = 'fit' AND sd IS NOT NULL")
    targets = r.join(unbroadcast(t.select("study_id", "branch_id").distinct()), ["study_id", "branch_id"], "left_anti")
    parts = [validation.project(targets, fit.where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in ("declared_baseline", "wide_baseline")]
    return parts[0].unionByName(parts[1]).select("study_id", "model", "branch_id", "logit", "probability", "n_imputed")


@R.add("l10_fingerprints")
def l10_fingerprints(spark, folder):
    """Contribution of every selected predictor to every terminal under the full-data fits of both baselines, with the terminal's logit, fitted and held-out probability beside it.

    Each baseline has its own states, screen, fit and nested held-out predictions.  A missing value is imputed by the training mean and
    contributes nothing.  ``gene_order`` goes by coefficient.  A baseline without a selected predictor has no contributions.
    """
    work = Workspace(spark, "l10")
    r = work.save(baseline.study_ratio(matrix(spark, folder)), "rates")
    t = work.save(variants.model_variants(states(spark, folder)).where("drop_rule = 'baseline'"), "terminals")
    b = work.save(tree.parsimony_states(_edges(spark, folder), t, ("model",)).select("study_id", "model", "branch_id", "state"), "branches")
    screen = work.save(baseline.screen(r, b, extra=("model",)), "screen")
    fit = work.save(validation.full_fit(r, t, screen.where("selected")), "fit")
    oof = []
    for m in ("declared_baseline", "wide_baseline"):
        own, branches = (d.where(F.col("model") == m).drop("model") for d in (t, b))
        features = work.save(validation.fold_screen(r, own, branches=branches), f"fold-screen-{m}").where("selected")
        oof.append(work.save(validation.out_of_fold(r, own, validation.make_folds(own, 20260523), features), f"oof-{m}").withColumn("model", F.lit(m)))
    held_out = oof[0].unionByName(oof[1]).where("branch_id IS NOT NULL").select("study_id", "model", "branch_id", F.col("prediction").alias("held_out_probability"))
    return fingerprints(r, t, fit).join(held_out, ["study_id", "model", "branch_id"], "left").withColumn("fitted_minus_held_out", F.col("fitted_probability") - F.col("held_out_probability"))


def fingerprints(r, t, fit):
    """One row per model, terminal and selected predictor; the sums of the terminal stand in each of its rows."""
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("study_id", "model").orderBy("coefficient", "gene_id"))
    c = fit.where("coefficient <> 0").select("study_id", "model", "gene_id", order.alias("gene_order"), "coefficient", "mean", "sd", "intercept")
    rows = unbroadcast(t.select("study_id", "model", "branch_id", "species", "state")).join(c, ["study_id", "model"]).join(r.select("study_id", "branch_id", "gene_id", F.col("gbi").alias("raw")), ["study_id", "branch_id", "gene_id"], "left")
    rows = rows.withColumn("scaled", F.coalesce((F.col("raw") - F.col("mean")) / F.col("sd"), F.lit(0.0))).withColumn("imputed", F.col("raw").isNull()).withColumn("contribution", F.col("coefficient") * F.col("scaled"))
    own = W.partitionBy("study_id", "model", "branch_id")
    rows = rows.withColumn("contribution_sum", F.sum("contribution").over(own)).withColumn("n_predictors", F.count(F.lit(1)).over(own)).withColumn("n_imputed", F.count_if("imputed").over(own).cast("bigint"))
    rows = rows.withColumn("logit", F.col("intercept") + F.col("contribution_sum")).withColumn("fitted_probability", 1 / (1 + F.exp(-F.col("logit"))))
    sign = F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative").otherwise("zero")
    return rows.select(
        "study_id", "model", "branch_id", "species", "state", "gene_id", "gene_order", "coefficient", "raw", "imputed", "scaled", "contribution", F.abs("contribution").alias("abs_contribution"), sign.alias("contribution_sign"),
        "n_predictors", "n_imputed", "intercept", "contribution_sum", "logit", "fitted_probability")


_COEF = """coef AS (SELECT study_id, gene_id, mean, sd, 1.0 / k AS coefficient, -0.5::DOUBLE AS intercept FROM (SELECT study_id, gene_id, avg(gbi) AS mean, stddev_samp(gbi) AS sd, row_number() OVER (PARTITION BY study_id ORDER BY gene_id) AS k FROM rates GROUP BY 1, 2) WHERE sd > 0)"""


@R.add("l08_projection", with_(CELLS, TRIM, GBI, _COEF) + f"""SELECT study_id, branch_id, {sig("round(logit, 6)", 5)} AS logit, n_imputed, {sig("1 / (1 + exp(-logit))", 5)} AS probability FROM (
  SELECT b.study_id, b.branch_id, max(intercept) + sum(coefficient * coalesce((gbi - mean) / sd, 0)) AS logit, count(*) FILTER (WHERE gbi IS NULL) AS n_imputed
  FROM (SELECT DISTINCT study_id, branch_id FROM rates) b JOIN coef USING (study_id) LEFT JOIN rates r ON r.study_id = b.study_id AND r.branch_id = b.branch_id AND r.gene_id = coef.gene_id GROUP BY 1, 2)""")
def l08_projection(spark, folder):
    """Projection of given coefficients (1 / place of the gene) onto all branches."""
    from pyspark.sql import Window as W

    r = rates(spark, folder)
    c = r.groupBy("study_id", "gene_id").agg(F.avg("gbi").alias("mean"), F.stddev_samp("gbi").alias("sd"))
    c = c.withColumn("coefficient", 1.0 / F.row_number().over(W.partitionBy("study_id").orderBy("gene_id"))).where("sd > 0").withColumn("intercept", F.lit(-0.5))
    out = validation.project(r, c)
    return out.select("study_id", "branch_id", digits(F.round("logit", 6), 5).alias("logit"), "n_imputed", digits("probability", 5).alias("probability"))


@R.add("o01_roc_points", with_(CELLS, STATES) + """SELECT study_id, gene_id, value AS threshold, CASE WHEN tp > 0 THEN sum(p) OVER w / tp END AS tpr, CASE WHEN tn > 0 THEN sum(n) OVER w / tn END AS fpr FROM (
    SELECT study_id, gene_id, value, count(*) FILTER (WHERE state = 1) AS p, count(*) FILTER (WHERE state = 0) AS n FROM cells JOIN states USING (study_id, branch_id) WHERE value IS NOT NULL AND state IN (0, 1) GROUP BY 1, 2, 3)
  JOIN (SELECT study_id, gene_id, count(*) FILTER (WHERE state = 1) AS tp, count(*) FILTER (WHERE state = 0) AS tn FROM cells JOIN states USING (study_id, branch_id) WHERE value IS NOT NULL AND state IN (0, 1) GROUP BY 1, 2) USING (study_id, gene_id) WINDOW w AS (PARTITION BY study_id, gene_id ORDER BY value DESC)""")
def o01_roc_points(spark, folder):
    rows = matrix(spark, folder).join(states(spark, folder), ["study_id", "branch_id"]).where(F.col("state").isin(0.0, 1.0))
    return validation.roc_points(rows, "value", "state", ["study_id", "gene_id"])




def _sets(spark, folder):
    m = matrix(spark, folder).where((F.col("coord_state") == "observed") & ((F.col("value") > 100) | (F.col("value") < 1)))
    return m.select("study_id", F.col("branch_id").alias("member"), F.when(F.col("value") > 100, "high").otherwise("low").alias("name"))


_BSETS = "sets AS (SELECT DISTINCT study_id, branch_id AS member, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS name FROM cells WHERE coord_state = 'observed' AND (value > 100 OR value < 1)), ab AS (SELECT study_id, member, bool_or(name = 'high') AS a, bool_or(name = 'low') AS b FROM sets GROUP BY 1, 2)"


@R.add("n01_set_operations", with_(CELLS, _BSETS) + "SELECT study_id, member, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_high' ELSE 'only_low' END AS part FROM ab")
def n01_set_operations(spark, folder):
    s = _sets(spark, folder)
    high, low = (s.where(F.col("name") == n).select("study_id", "member") for n in ("high", "low"))
    part = lambda d, n: d.withColumn("part", F.lit(n))
    return part(high.intersect(low), "both").unionByName(part(high.subtract(low), "only_high")).unionByName(part(low.subtract(high), "only_low"))


@R.add("n02_overlap", with_(CELLS, _BSETS) + """SELECT study_id, count(*) FILTER (WHERE a) AS n_first, count(*) FILTER (WHERE b) AS n_second, count(*) FILTER (WHERE a AND b) AS n_both, count(*) AS n_union, count(*) FILTER (WHERE a AND NOT b) AS only_first,
  count(*) FILTER (WHERE b AND NOT a) AS only_second, round(count(*) FILTER (WHERE a AND b)::DOUBLE / count(*), 4) AS jaccard FROM ab GROUP BY 1""")
def n02_overlap(spark, folder):
    return sets.compare_sets(_sets(spark, folder), ["study_id"], "name", "member", "high", "low")


@R.add("n03_module_metrics", with_(CELLS, _BSETS) + f"""SELECT study_id, n_first, n_second, gene_jaccard, coalesce(n_first_annotated, 0) AS n_first_annotated, coalesce(n_second_annotated, 0) AS n_second_annotated, module_jaccard, module_cosine FROM (
    SELECT study_id, count(*) FILTER (WHERE a) AS n_first, count(*) FILTER (WHERE b) AS n_second, count(*) FILTER (WHERE a AND b)::DOUBLE / count(*) AS gene_jaccard FROM ab GROUP BY 1) LEFT JOIN (
    SELECT study_id, sum(x)::BIGINT AS n_first_annotated, sum(y)::BIGINT AS n_second_annotated, count(*) FILTER (WHERE x > 0 AND y > 0)::DOUBLE / count(*) AS module_jaccard, {sig("CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END", 6)} AS module_cosine FROM (
      SELECT study_id, left(member, 2) AS module, count(*) FILTER (WHERE name = 'high')::DOUBLE AS x, count(*) FILTER (WHERE name = 'low')::DOUBLE AS y FROM sets WHERE length(member) <= 3 GROUP BY 1, 2) GROUP BY 1) USING (study_id)""")
def n03_module_metrics(spark, folder):
    """Modules of branches by the first two characters of labels of up to three characters; longer labels have none."""
    return sets.module_metrics(_sets(spark, folder), _modules(spark, folder), ["study_id"], "name", "member", "high", "low").withColumn("module_cosine", digits("module_cosine", 6))


def _modules(spark, folder):
    return _sets(spark, folder).where(F.length("member") <= 3).select("member", F.left("member", F.lit(2)).alias("module")).distinct()


_SCREENS = f"""welch AS (
  SELECT study_id, model, gene_id, CASE WHEN v0 / n0 + v1 / n1 > 0 AND sqrt(v0 / n0 + v1 / n1) >= 2.220446049250313e-15 * greatest(abs(m0), abs(m1)) AND n0 >= 2 AND n1 >= 2 THEN (m0 - m1) / sqrt(v0 / n0 + v1 / n1) END AS t FROM (
    SELECT study_id, model, gene_id, count(gbi) FILTER (WHERE state = 0) AS n0, count(gbi) FILTER (WHERE state = 1) AS n1, avg(gbi) FILTER (WHERE state = 0) AS m0, avg(gbi) FILTER (WHERE state = 1) AS m1,
      CASE WHEN count(gbi) FILTER (WHERE state = 0) > 1 THEN var_samp(gbi) FILTER (WHERE state = 0) END AS v0, CASE WHEN count(gbi) FILTER (WHERE state = 1) > 1 THEN var_samp(gbi) FILTER (WHERE state = 1) END AS v1
    FROM rates JOIN (SELECT study_id, branch_id, state, 'a' AS model FROM states WHERE state IN (0, 1) UNION ALL SELECT study_id, branch_id, CASE WHEN state = 0.5 THEN 1 ELSE state END, 'b' FROM states) USING (study_id, branch_id) GROUP BY 1, 2, 3)),
x AS (SELECT study_id, gene_id, coalesce(bool_or(model = 'a' AND t IS NOT NULL), false) AS ta, coalesce(bool_or(model = 'a' AND abs(t) > 1), false) AS sa, coalesce(bool_or(model = 'a' AND t > 1), false) AS la,
  coalesce(bool_or(model = 'b' AND t IS NOT NULL), false) AS tb, coalesce(bool_or(model = 'b' AND abs(t) > 1), false) AS sb, coalesce(bool_or(model = 'b' AND t > 1), false) AS lb FROM welch WHERE t IS NOT NULL GROUP BY 1, 2),
c AS (SELECT study_id, {", ".join(f"count(*) FILTER (WHERE {w})::DOUBLE AS {k}" for k, w in {"first_tested": "ta", "second_tested": "tb", "first_selected": "sa", "first_slow": "la", "first_fast": "sa AND NOT la", "second_selected": "sb", "second_slow": "lb", "second_fast": "sb AND NOT lb", "shared_slow": "la AND lb", "first_only_slow": "la AND NOT lb", "second_only_slow": "lb AND NOT la", "slow_union": "la OR lb", "first_slow_second_fast": "la AND sb AND NOT lb", "first_fast_second_slow": "sa AND NOT la AND lb", "fast_both": "sa AND NOT la AND sb AND NOT lb", "selected_both": "sa AND sb", "selected_union": "sa OR sb", "concordant": "(la AND lb) OR (sa AND NOT la AND sb AND NOT lb)", "discordant": "(la AND sb AND NOT lb) OR (sa AND NOT la AND lb)"}.items())} FROM x GROUP BY 1)"""
_OVER = {"first_selected": "first_tested", "first_slow": "first_selected", "first_fast": "first_selected", "second_selected": "second_tested", "second_slow": "second_selected", "second_fast": "second_selected", "concordant": "selected_both", "discordant": "selected_both"}
_DERIVED = {"first_slow_shared_percent": ("shared_slow", "first_slow", 2, 100), "second_slow_shared_percent": ("shared_slow", "second_slow", 2, 100), "slow_jaccard": ("shared_slow", "slow_union", 4, 1), "selected_jaccard": ("selected_both", "selected_union", 4, 1)}


def _overlap_sql() -> str:
    part = lambda x, y, places, by: f"CASE WHEN {y} > 0 THEN round({by} * {x} / {y}, {places}) END"
    rows = []
    for m in sets.OVERLAP:
        value = part(*_DERIVED[m][:2], *_DERIVED[m][2:]) if m in _DERIVED else m
        under = _OVER.get(m) or ({"first_slow_shared_percent": "first_slow", "second_slow_shared_percent": "second_slow"}.get(m) or "NULL")
        rows.append(f"SELECT study_id, '{m}' AS metric, {value} AS value, {under}::DOUBLE AS denominator, {part(m, _OVER[m], 2, 100) if m in _OVER else 'NULL::DOUBLE'} AS percent FROM c")
    return " UNION ALL ".join(rows)


@R.add("n02_overlap_table", with_(CELLS, TRIM, GBI, STATES, _SCREENS) + _overlap_sql())
def n02_overlap_table(spark, folder):
    """The 22 metrics of the screens of two codings (intermediates left out, intermediates focal); genes with |t| > 1 taken as selected, since p has no SQL."""
    s = states(spark, folder)
    wide = s.withColumn("state", F.when(F.col("state") == 0.5, 1.0).otherwise(F.col("state")))
    r = rates(spark, folder)
    of = lambda d: baseline.screen(r, d).withColumn("selected", F.coalesce(F.abs("t") > 1, F.lit(False)))
    return sets.overlap_table(of(s), of(wide))


_DRAWS = 10_000
_KEY = lambda stream: f"(((({{0}} * {{0}} + place * 31 + {stream}) % 1000003) * (({{0}} * {{0}} + place * 31 + {stream}) % 1000003) + draw * 17 + place) % 1000003)".replace("{0}", f"((place * 7919 + draw * 104729 + {stream} * 15485863) % 1000003)")
_TURN = f"""turn AS (SELECT study_id, draw, count(*) FILTER (WHERE k1 <= n_first AND k2 <= n_second) AS n_both, count(*) FILTER (WHERE k1 <= n_first OR k2 <= n_second) AS n_union FROM (
  SELECT *, row_number() OVER (PARTITION BY study_id, draw ORDER BY {_KEY(1)}, place) AS k1, row_number() OVER (PARTITION BY study_id, draw ORDER BY {_KEY(2)}, place) AS k2
  FROM (SELECT study_id, member, row_number() OVER (PARTITION BY study_id ORDER BY member) AS place FROM (SELECT DISTINCT study_id, branch_id AS member FROM cells)) CROSS JOIN range(1, {_DRAWS + 1}) t(draw)
    JOIN (SELECT study_id, count(*) FILTER (WHERE a) AS n_first, count(*) FILTER (WHERE b) AS n_second FROM ab GROUP BY 1) USING (study_id)) GROUP BY 1, 2)"""


def _turnover(spark, folder):
    observed = sets.compare_sets(_sets(spark, folder), ["study_id"], "name", "member", "high", "low")
    universe = matrix(spark, folder).select("study_id", F.col("branch_id").alias("member"))
    return observed, sets.turnover_draws(universe, observed.select("study_id", "n_first", "n_second"), _DRAWS)


@R.add("n04_turnover_draws", with_(CELLS, _BSETS, _TURN) + "SELECT study_id, draw, n_both, n_union, CASE WHEN n_union > 0 THEN n_both::DOUBLE / n_union END AS jaccard FROM turn")
def n04_turnover_draws(spark, folder):
    return _turnover(spark, folder)[1]


@R.add("n04_module_draws")
def n04_module_draws(spark, folder):
    """Module metrics of 10,000 draws among the branches with a module."""
    return _module_turnover(spark, folder)[1]


def _module_turnover(spark, folder):
    modules = _modules(spark, folder)
    observed = sets.module_metrics(_sets(spark, folder), modules, ["study_id"], "name", "member", "high", "low")
    universe = matrix(spark, folder).select("study_id", F.col("branch_id").alias("member")).distinct().join(modules, "member", "left")
    return observed, sets.turnover_modules(universe, observed.select("study_id", "n_first_annotated", "n_second_annotated"), _DRAWS)


@R.add("n05_module_summary")
def n05_module_summary(spark, folder):
    """Both module metrics against their draws."""
    observed, draws = _module_turnover(spark, folder)
    return sets.turnover_summary(observed, draws, "module_jaccard").unionByName(sets.turnover_summary(observed, draws, "module_cosine"))


@R.add("n05_turnover_summary", with_(CELLS, _BSETS, _TURN) + f"""SELECT study_id, {sig("max(o)", 6)} AS observed, {sig("quantile_cont(j, 0.5)", 6)} AS null_median, {sig("quantile_cont(j, 0.025)", 5)} AS null_low, {sig("quantile_cont(j, 0.975)", 5)} AS null_high, (count(*) FILTER (WHERE j >= o) + 1)::DOUBLE / (count(*) + 1) AS p,
    {sig("round(CASE WHEN stddev_samp(j) > 0 THEN (max(o) - avg(j)) / stddev_samp(j) END, 6)", 5)} AS z, {sig("CASE WHEN quantile_cont(j, 0.5) > 0 THEN max(o) / quantile_cont(j, 0.5) END", 6)} AS enrichment, count(*) AS n_draws FROM (
    SELECT study_id, n_both::DOUBLE / n_union AS j FROM turn) JOIN (SELECT study_id, round(count(*) FILTER (WHERE a AND b)::DOUBLE / count(*), 4) AS o FROM ab GROUP BY 1) USING (study_id) GROUP BY 1""")
def n05_turnover_summary(spark, folder):
    out = sets.turnover_summary(*_turnover(spark, folder))
    return out.select("study_id", digits("observed", 6).alias("observed"), digits("null_median", 6).alias("null_median"), digits("null_low", 5).alias("null_low"), digits("null_high", 5).alias("null_high"), "p", digits(F.round("z", 6), 5).alias("z"), digits("enrichment", 6).alias("enrichment"), "n_draws")


@R.add("o02_ordered_listing", with_(CELLS) + "SELECT study_id, gene_id, string_agg(branch_id, '; ' ORDER BY value, branch_id) AS listing, count(*) AS n FROM cells WHERE value > 1000 GROUP BY 1, 2")
def o02_ordered_listing(spark, folder):
    rows = matrix(spark, folder).where("value > 1000").withColumn("b", F.col("branch_id"))
    return sets.ordered_listing(rows, ["study_id", "gene_id"], "branch_id", ["value", "b"])


@R.add("b15_logit", with_(CELLS) + f"SELECT study_id, gene_id, branch_id, {sig('ln(p / (1 - p))', 6)} AS logit FROM (SELECT *, least(greatest(value / (1 + value), 1e-12), 1 - 1e-12) AS p FROM cells WHERE value >= 0)")
def b15_logit(spark, folder):
    from cladeframe.functions.text import logit

    m = matrix(spark, folder).where("value >= 0")
    return m.select("study_id", "gene_id", "branch_id", digits(logit(F.col("value") / (1 + F.col("value"))), 6).alias("logit"))


@R.add("b14_formats", with_(CELLS) + "SELECT study_id, gene_id, printf('%.1f%%', 100.0 * count(value) / count(*)) AS available_percent, CASE WHEN count(value) = count(*) THEN 'True' ELSE 'False' END AS complete FROM cells GROUP BY 1, 2")
def b14_formats(spark, folder):
    from cladeframe.functions.text import percent, truth

    g = matrix(spark, folder).groupBy("study_id", "gene_id").agg(F.count("value").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("study_id", "gene_id", percent(F.col("k") / F.col("n")).alias("available_percent"), truth(F.col("k") == F.col("n")).alias("complete"))
