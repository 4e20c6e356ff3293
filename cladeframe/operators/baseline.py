"""The study baseline (trim, marginal means, ratio) and the two-group screen on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.functions.stats import student_t_two_sided
from cladeframe.operators.cells import KEY
from cladeframe.workspace import unbroadcast


def trim(cells: DataFrame, probability: float = 0.975) -> DataFrame:
    """Adds the gene's ``cutoff`` (quantile of linear interpolation), ``trimmed`` (value at or above it) and ``kept`` (the value left).

    A gene without a value has no cutoff and loses nothing.
    """
    cut = cells.groupBy("study_id", "gene_id").agg(F.percentile("value", F.lit(probability)).alias("cutoff"))
    t = F.col("value").isNotNull() & F.col("cutoff").isNotNull() & (F.col("value") >= F.col("cutoff"))
    rows = cells.join(cut, ["study_id", "gene_id"]).withColumn("trimmed", t)
    return rows.withColumn("kept", F.when(~F.col("trimmed"), F.col("value")))


def effects(trimmed: DataFrame, by: str) -> DataFrame:
    """Per gene or branch: mean and median of what is left, counts before and after, zeros, ratio of median to mean."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    rows = trimmed.groupBy("study_id", by).agg(
        F.median("kept").alias("effect_median"), F.avg("kept").alias("effect_mean"), F.count("value").alias("n_before"), F.count("kept").alias("n_after"),
        n(F.col("trimmed")).alias("n_trimmed"), n(F.col("value") == 0).alias("zeros_before"), n(F.col("kept") == 0).alias("zeros_after"),
    )
    return rows.withColumn("median_over_mean", F.try_divide("effect_median", "effect_mean"))


def ratio(trimmed: DataFrame) -> DataFrame:
    """``gbi`` = (kept / branch mean) / gene mean, in this order; null where a mean is 0 or missing."""
    be = trimmed.groupBy("study_id", "branch_id").agg(F.avg("kept").alias("branch_mean"))
    ge = trimmed.groupBy("study_id", "gene_id").agg(F.avg("kept").alias("gene_mean"))
    rows = trimmed.join(be, ["study_id", "branch_id"]).join(ge, ["study_id", "gene_id"])
    gbi = F.try_divide(F.try_divide(F.col("kept"), F.col("branch_mean")), F.col("gene_mean"))
    return rows.withColumn("gbi", gbi)


def study_ratio(cells: DataFrame, probability: float = 0.975) -> DataFrame:
    """``(study_id, gene_id, branch_id, gbi)``: ``ratio`` of ``trim`` in two passes over the cells, one by gene and one by branch, where nothing else of them is wanted."""
    gene, branch = W.partitionBy("study_id", "gene_id"), W.partitionBy("study_id", "branch_id")
    v = F.col("value")
    rows = cells.select(*KEY, "value").withColumn("cutoff", F.percentile("value", F.lit(probability)).over(gene))
    rows = rows.select(*KEY, F.when(~(v.isNotNull() & F.col("cutoff").isNotNull() & (v >= F.col("cutoff"))), v).alias("kept"))
    rows = rows.withColumn("gene_mean", F.avg("kept").over(gene)).withColumn("branch_mean", F.avg("kept").over(branch))
    return rows.select(*KEY, F.try_divide(F.try_divide(F.col("kept"), F.col("branch_mean")), F.col("gene_mean")).alias("gbi"))


def group_statistics(rates: DataFrame, states: DataFrame, value: str = "gbi", extra: tuple[str, ...] = ()) -> DataFrame:
    """Mergeable statistics per gene (and ``extra`` keys) of both groups: n, sum and sum of squares for states 0 and 1."""
    rows = rates.join(unbroadcast(states.where(F.col("state").isin(0.0, 1.0))), ["study_id", "branch_id"])
    v = F.col(value)
    aggs = []
    for g in (0, 1):
        own = F.when(F.col("state") == g, v)
        aggs += [F.count(own).alias(f"n{g}"), F.coalesce(F.sum(own), F.lit(0.0)).alias(f"s{g}"), F.coalesce(F.sum(own * own), F.lit(0.0)).alias(f"q{g}")]
    return rows.groupBy("study_id", "gene_id", *extra).agg(*aggs)


def welch(stats: DataFrame, focal_first: bool = False) -> DataFrame:
    """Welch's t, df and two-sided p from the statistics; null with a reason where a group has under 2 values or no variance is left.

    t is background (state 0) minus focal (state 1), variances floored at 0; or, for permuted worlds, focal minus background, variances
    between -1e-10 and 0 taken as 0 and smaller ones as they are, so that such a gene is not tested.
    """
    for g in (0, 1):
        n, s, q = F.col(f"n{g}"), F.col(f"s{g}"), F.col(f"q{g}")
        var = (q - F.try_divide(s * s, n)) / (n - 1)
        var = F.when((var < 0) & (var > -1e-10), 0.0).otherwise(var) if focal_first else F.greatest(F.lit(0.0), var)
        stats = stats.withColumn(f"mean{g}", F.try_divide(s, n)).withColumn(f"var{g}", F.when(n > 1, var))
    return _welch(stats, focal_first)


def _welch(stats: DataFrame, focal_first: bool, constant: float = 0.0) -> DataFrame:
    """``constant``: least standard error as a share of the greater mean; data below it are constant and refused."""
    enough = F.least("n0", "n1") >= 2
    a, b = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    stats = stats.withColumn("se2", F.when(enough, a + b)).withColumn("__a", F.when(enough, a)).withColumn("__b", F.when(enough, b))
    usable = F.col("se2") > 0
    if constant:
        usable = usable & (F.sqrt("se2") >= constant * F.greatest(F.abs("mean0"), F.abs("mean1")))
    diff = F.col("mean1") - F.col("mean0") if focal_first else F.col("mean0") - F.col("mean1")
    df = F.col("se2") * F.col("se2") / (F.col("__a") * F.col("__a") / (F.col("n0") - 1) + F.col("__b") * F.col("__b") / (F.col("n1") - 1))
    stats = stats.withColumn("t", F.when(usable, diff / F.sqrt("se2"))).withColumn("df", F.when(usable, df))
    reason = F.when(~enough, "insufficient_finite_group_size").when(~F.coalesce(usable, F.lit(False)), REFUSED)
    return stats.withColumn("p", student_t_two_sided("t", "df")).withColumn("reason", reason).drop("__a", "__b")


#: The reason of a gene whose values are constant: the test is refused, see ``require_screen``.
REFUSED = "welch_refused_constant_data"
#: Ten times the machine's precision: a standard error below this share of the greater mean is none.
CONSTANT = 10 * 2.0**-52


def screen(rates: DataFrame, states: DataFrame, value: str = "gbi", extra: tuple[str, ...] = ()) -> DataFrame:
    """Welch screen per gene with variances of two-pass accuracy, direction, and the leading genes under strict-prefix selection.

    ``extra`` names further keys of ``states`` (a model), each screened on its own.
    A gene whose values are constant is refused with that reason; ``require_screen`` stops the run over it.
    """
    by = ["study_id", "gene_id", *extra]
    rows = rates.join(unbroadcast(states.where(F.col("state").isin(0.0, 1.0))), ["study_id", "branch_id"])
    aggs = []
    for g in (0, 1):
        own = F.when(F.col("state") == g, F.col(value))
        aggs += [F.count(own).alias(f"n{g}"), F.avg(own).alias(f"mean{g}"), F.var_samp(own).alias(f"var{g}")]
    tested = _welch(rows.groupBy(*by).agg(*aggs), False, CONSTANT)
    genes = rates.select("study_id", "gene_id").distinct()
    if extra:
        genes = genes.join(unbroadcast(states.select("study_id", *extra).distinct()), "study_id")
    every = genes.join(tested, by, "left").withColumn("reason", F.when(F.col("n0").isNull(), "insufficient_finite_group_size").otherwise(F.col("reason")))
    every = every.na.fill(0, ["n0", "n1"]).withColumn("direction", F.when(F.col("t") > 0, "slow").when(F.col("t") < 0, "fast").when(F.col("t") == 0, "zero"))
    return strict_prefix(every, "p", ["study_id", *extra], ["gene_id"])


def strict_prefix(rows: DataFrame, p: str, by: list[str], ties: list[str], level: float = 0.01, out: str = "selected") -> DataFrame:
    """Marks the leading rows by p while p_k < k / n * level; the first failure ends the selection.  Null p is never selected."""
    tested = F.col(p).isNotNull()
    part = W.partitionBy(*by, tested)
    k = F.row_number().over(part.orderBy(p, *ties))
    rows = rows.withColumn("__k", k).withColumn("__n", F.count(F.lit(1)).over(part))
    fails = F.when(tested & ~(F.col(p) < F.col("__k") / F.col("__n") * level), F.col("__k"))
    rows = rows.withColumn("__stop", F.min(fails).over(part))
    return rows.withColumn(out, tested & (F.col("__k") < F.coalesce("__stop", F.col("__n") + 1))).drop("__k", "__n", "__stop")


def require_screen(screened: DataFrame) -> DataFrame:
    """``screened``, or ``ContractError`` with up to five genes that could not be tested: no silent skip and no other test."""
    some = screened.where(F.col("reason") == REFUSED).limit(5).collect()
    if some:
        raise ContractError("Welch failed, data are constant: " + ", ".join(f"{r.study_id} {r.gene_id}" for r in some))
    return screened


def screen_summary(screened: DataFrame) -> DataFrame:
    """Per study: genes tested and selected, and signs of t among both."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    t, s = F.col("t"), F.col("selected")
    return screened.groupBy("study_id").agg(
        F.count("t").alias("n_tested"), n(s).alias("n_selected"), n(t > 0).alias("positive_t"), n(t < 0).alias("negative_t"),
        n(s & (t > 0)).alias("positive_selected"), n(s & (t < 0)).alias("negative_selected"),
    )


def held_out_statistics(rates: DataFrame, states: DataFrame, terminals: DataFrame, value: str = "gbi") -> DataFrame:
    """Training statistics of every leave-one-genus-out fold at once: a gene's totals minus those of the held-out genus.

    ``terminals`` has ``(study_id, branch_id, genus)``; a null genus is in the totals and never held out.  The data are aggregated once; folds are a join.
    """
    named = unbroadcast(states).join(terminals.select("study_id", "branch_id", "genus"), ["study_id", "branch_id"])
    per = group_statistics(rates, named, value, ("genus",))
    columns = [f"{c}{g}" for g in (0, 1) for c in "nsq"]
    total = per.groupBy("study_id", "gene_id").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    folds = terminals.where(F.col("genus").isNotNull()).select("study_id", "genus").distinct()
    every = total.join(folds, "study_id").join(per, ["study_id", "gene_id", "genus"], "left")
    return every.select("study_id", "genus", "gene_id", *[(F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns])
