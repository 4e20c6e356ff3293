"""One call from tables to report: the study run and its multi-model extension, stage by stage.

Every stage is a table; with a run folder (``sources.runs.Run``) each is saved before the next begins and a failure leaves
the status with the stage, else the tables stand in the shared folder.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.functions.stats import auc
from cladeframe.operators import baseline, reporting, sets, traits, tree, validation, variants
from cladeframe.workspace import Workspace

RECIPE = "submitted_S2"


@dataclass(frozen=True)
class Inputs:
    """The tables of a run: cells, coordinates, trait, groups, and folds (null: one fold per genus from ``fold_seed``)."""

    cells: DataFrame
    coordinates: DataFrame
    trait: DataFrame
    groups: DataFrame
    folds: DataFrame | None = None
    fold_seed: int = 20260523


@dataclass(frozen=True)
class AnalysisSpec:
    """What a run is asked to do; both recipes are chosen by the caller, there is no default."""

    recipe: str
    validation_recipe: str
    level: float = 0.01
    trim_probability: float = 0.975

    def __post_init__(self) -> None:
        if self.recipe != RECIPE:
            raise ContractError(f"choose the recipe {RECIPE} explicitly")
        if self.validation_recipe not in validation.RECIPES:
            raise ContractError(f"choose a validation recipe of {', '.join(validation.RECIPES)}")
        if not (0 < self.level < 1 and 0 < self.trim_probability < 1):
            raise ContractError("level and trim probability lie between 0 and 1")


Stage = Callable[[str, DataFrame], DataFrame]


def stages(spark: SparkSession, run=None, job: str = "run") -> tuple[dict[str, DataFrame], Stage]:
    """The growing tables of a run, and the function that saves a stage and returns its reader."""
    tables: dict[str, DataFrame] = {}
    work = None if run is not None else Workspace(spark, job)

    def save(name: str, df: DataFrame) -> DataFrame:
        tables[name] = run.stage(name, lambda: df) if run is not None else work.save(df, name)
        return tables[name]

    return tables, save


def run_study(spark: SparkSession, inputs: Inputs, spec: AnalysisSpec, run=None) -> dict[str, DataFrame]:
    """Trim, ratio, reconstructed states, screen, grouped validation and its summary, of all studies side by side."""
    tables, save = stages(spark, run, "study")
    _study(inputs, spec, save)
    return tables


def _study(inputs: Inputs, spec: AnalysisSpec, save: Stage) -> None:
    terminals = save("terminals", traits.terminal_states(inputs.coordinates, inputs.trait, inputs.groups))
    edges = save("branch_ledger", tree.rooted_edges(tree.splits(inputs.coordinates)))
    states = save("branch_states", tree.parsimony_states(edges, terminals))
    trimmed = baseline.trim(inputs.cells, spec.trim_probability)
    rates = save("ratio", baseline.ratio(trimmed).select("study_id", "gene_id", "branch_id", "value", "cutoff", "trimmed", "kept", "branch_mean", "gene_mean", "gbi"))
    save("gene_effect", baseline.effects(rates, "gene_id"))
    save("branch_effect", baseline.effects(rates, "branch_id"))
    screened = save("screen_gene_ledger", baseline.screen(rates, states.select("study_id", "branch_id", "state")))
    save("screen_significant", screened.where("selected"))
    save("screen_summary", baseline.screen_summary(screened))
    folds = save("fold_ledger", validation.make_folds(terminals, inputs.fold_seed) if inputs.folds is None else inputs.folds)
    save("fold_roles", validation.taxon_roles(validation.roles(terminals, folds)))
    if spec.validation_recipe == "global_screen_foldwise":
        features = screened.where("selected")
    else:
        features = save("fold_screen", validation.fold_screen(rates, terminals, "gbi", spec.level, states.select("study_id", "branch_id", "state"))).where("selected")
    oof = save("validation", validation.out_of_fold(rates, terminals, folds, features, "gbi", spec.validation_recipe))
    held = save("oof_predictions", oof.where("branch_id IS NOT NULL").select("study_id", "species", "branch_id", "fold_id", F.col("held_out").alias("genus"), F.col("state").alias("response"), F.col("prediction").alias("probability"), "status"))
    save("validation_summary", auc(held, "probability", "response", ["study_id"]))


def run_models(spark: SparkSession, inputs: Inputs, run=None) -> dict[str, DataFrame]:
    """The first stage of a multi-model study: ratio, and states and screen of all variants of the trait in one job."""
    tables, save = stages(spark, run, "models")
    _models(inputs, save)
    return tables


def _models(inputs: Inputs, save: Stage) -> dict[str, DataFrame]:
    t = save("terminals", variants.model_variants(traits.terminal_states(inputs.coordinates, inputs.trait, inputs.groups)))
    edges = save("branch_ledger", tree.rooted_edges(tree.splits(inputs.coordinates)))
    names = [variants.name(*v) for v in variants.VARIANTS]
    tips = t.groupBy("study_id", "branch_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "state"))).alias("m")).select("study_id", "branch_id", F.array(*[F.col("m")[n] for n in names]).alias("states"))
    rows = tree.parsimony_arrays(edges, tips).select("study_id", "branch_id", F.posexplode("states").alias("i", "state"))
    b = save("branch_states", rows.select("study_id", "branch_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("model"), "state"))
    r = save("ratio", baseline.ratio(baseline.trim(inputs.cells)).select("study_id", "gene_id", "branch_id", "gbi"))
    s = save("screen", baseline.screen(r, b, extra=("model",)))
    save("screening_table", reporting.screening_table(s, b))
    return {"terminals": t, "branch_states": b, "ratio": r, "screen": s}


def run_multi(spark: SparkSession, inputs: Inputs, run=None, draws: int = 10_000) -> dict[str, DataFrame]:
    """The whole multi-model study: all of ``run_models``, full-data fits, their partition, overlap and turnover of the two baselines, and validation of the first."""
    tables, save = stages(spark, run, "multi")
    m = _models(inputs, save)
    fit = save("coefficients", validation.full_fit(m["ratio"], m["terminals"], m["screen"].where("selected")))
    save("model_summary", validation.full_summary(fit))
    save("partition", validation.partition(fit, "declared_baseline", "wide_baseline"))
    of = lambda name: m["screen"].where(F.col("model") == name).select("study_id", "gene_id", "t", "selected")
    save("overlap", sets.overlap_table(of("declared_baseline"), of("wide_baseline")))
    chosen = fit.where("coefficient <> 0 AND model IN ('declared_baseline', 'wide_baseline')").select("study_id", F.col("model").alias("name"), F.col("gene_id").alias("member"))
    observed = sets.compare_sets(chosen, ["study_id"], "name", "member", "declared_baseline", "wide_baseline")
    universe = m["screen"].where("selected AND model IN ('declared_baseline', 'wide_baseline')").select("study_id", F.col("gene_id").alias("member"))
    save("turnover", sets.turnover_summary(observed, sets.turnover_draws(universe, observed.select("study_id", "n_first", "n_second"), draws)))
    t = m["terminals"].where("model = 'declared_baseline'")
    states = m["branch_states"].where("model = 'declared_baseline'").select("study_id", "branch_id", "state")
    folds = save("fold_ledger", validation.make_folds(t, inputs.fold_seed) if inputs.folds is None else inputs.folds)
    oof = save("validation", validation.out_of_fold(m["ratio"], t, folds, validation.fold_features(m["ratio"], t, branches=states)))
    save("fold_table", validation.fold_table(oof))
    save("selected", validation.selected_table(oof))
    save("sensitivity", validation.validation_summary(oof))
    return tables
