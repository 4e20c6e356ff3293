"""Contracts between tables, report tables and keyed assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import AxisError
from cladeframe.operators.cells import KEY
from cladeframe.operators.traits import key_agreement


def same_cells(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted; no row says that both are equal."""
    a, b = first.select(*columns), second.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def model_contract(rates: DataFrame, terminals: DataFrame, folds: DataFrame, value: str) -> DataFrame:
    """What the grouped validation needs and a study lacks: negative values, terminals off the matrix, genera without a fold."""
    negative = rates.where(F.col(value) < 0).select("study_id", F.lit("negative_value").alias("issue"), F.concat_ws(" ", "gene_id", "branch_id").alias("key"))
    off = terminals.join(rates.select("study_id", "branch_id").distinct(), ["study_id", "branch_id"], "left_anti").select("study_id", F.lit("terminal_off_matrix").alias("issue"), F.col("branch_id").alias("key"))
    lost = terminals.where("genus IS NOT NULL").select("study_id", "genus").distinct().join(folds.select("study_id", "genus").distinct(), ["study_id", "genus"], "left_anti")
    return negative.unionByName(off).unionByName(lost.select("study_id", F.lit("genus_without_fold").alias("issue"), F.col("genus").alias("key")))


def bijection_issues(rows: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Keys of a crosswalk that meet several partners, on either side."""
    pairs = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*by, left, right).distinct()
    out = []
    for key, other, side in ((left, right, "left"), (right, left, "right")):
        n = pairs.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n_partners")).where("n_partners > 1")
        out.append(n.select(*by, F.lit(side).alias("side"), F.col(key).alias("key"), "n_partners"))
    return out[0].unionByName(out[1])


def assemble(computed: DataFrame, expected: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Computed rows in the expected order; refused unless both hold exactly the same keys."""
    some = key_agreement(computed, expected, keys, "computed", "expected").limit(5).collect()
    if some:
        raise AxisError("; ".join(f"only {r.side}: {[r[k] for k in keys]}" for r in some))
    return expected.select(*keys, order).join(computed, keys).orderBy(order)


def quadrant(x: Column, y: Column, cut: float) -> Column:
    """Both high, one high, or both low."""
    return F.when(x.isNull() | y.isNull(), "undefined").when((x >= cut) & (y >= cut), "both_high").when(x >= cut, "first_high").when(y >= cut, "second_high").otherwise("both_low")


def contributions(rates: DataFrame, coefficients: DataFrame, value: str) -> DataFrame:
    """Per branch and predictor: coefficient times the scaled value, and whether it was imputed; they sum to the logit less the intercept."""
    branches = rates.select("study_id", "branch_id").distinct().join(coefficients, "study_id")
    rows = branches.join(rates.select(*KEY, F.col(value).alias("__v")), ["study_id", "branch_id", "gene_id"], "left")
    scaled = F.coalesce((F.col("__v") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    return rows.select("study_id", "branch_id", "gene_id", (F.col("coefficient") * scaled).alias("contribution"), F.col("__v").isNull().alias("imputed"))


def run_diagnostics(trimmed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per study: genes, cells trimmed, cells with and without a ratio."""
    t = trimmed.groupBy("study_id").agg(F.count_distinct("gene_id").alias("n_genes"), F.count_if("trimmed").cast("bigint").alias("n_trimmed"))
    r = rates.groupBy("study_id").agg(F.count("gbi").alias("n_ratio"), F.count_if(F.col("gbi").isNull()).cast("bigint").alias("n_without"))
    return t.join(r, "study_id")


def recipes() -> list[tuple[str, str, str, str, str]]:
    """The recipes offered: recipe, version, validation recipe, selection, footprint.

    Fixed values: the texts are part of the results.
    """
    footprint = "inclusive gene q0.975/type7; arithmetic GE/BE; divide BE then GE; historical castor ASR; reference-minus-focal Welch; strict-prefix FDR0.01"
    return [
        ("submitted_S2", "S2", "nested_phase12B", "fold-held branches excluded; nested_multiply arithmetic", footprint),
        ("submitted_S2", "S2", "nested_phase13", "fold-held branches excluded; phase13_power arithmetic", footprint),
        ("submitted_S2", "S2", "global_screen_foldwise", "global supervised screen reused; not nested feature selection", footprint),
    ]


def screening_table(screened: DataFrame, states: DataFrame) -> DataFrame:
    """Per study and model: genes in, tested and skipped, branches screened, genes selected, slow and fast ones and their shares."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    s, t = F.col("selected"), F.col("t")
    genes = screened.groupBy("study_id", "model").agg(F.count(F.lit(1)).alias("n_input_genes"), F.count("t").alias("n_tested_genes"), n(t.isNull()).alias("n_skipped_genes"), n(s).alias("n_significant"), n(s & (t > 0)).alias("n_slow"), n(s & (t < 0)).alias("n_fast"))
    branches = states.groupBy("study_id", "model").agg(n(F.col("state").isin(0.0, 1.0)).alias("n_branches_screened"))
    out = genes.join(branches, ["study_id", "model"])
    return out.withColumn("slow_proportion", F.try_divide("n_slow", "n_significant")).withColumn("fast_proportion", F.try_divide("n_fast", "n_significant"))


def habitat(first: Column, second: Column) -> Column:
    """Four categories of two codings of a trait: ``marine`` where the first is 1, else by the second (1, 0.5, 0); null where it is missing."""
    return F.when(first == 1, "marine").when(second == 1, "non-marine aquatic").when(second == 0.5, "semi-aquatic").when(second == 0, "terrestrial")
