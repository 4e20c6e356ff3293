"""Set metrics of gene selections, and turnover against draws of random sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import AxisError
from cladeframe.workspace import spread, unbroadcast


def compare_sets(sets: DataFrame, by: list[str], name: str, member: str, first: str, second: str) -> DataFrame:
    """Sizes, intersection, union, differences and Jaccard index of two named sets; repeated members count once."""
    rows = sets.where(F.col(name).isin(first, second) & F.col(member).isNotNull()).groupBy(*by, member).agg(F.max(F.col(name) == first).alias("a"), F.max(F.col(name) == second).alias("b"))
    n = lambda c: F.count_if(c).cast("bigint")
    a, b = F.col("a"), F.col("b")
    out = rows.groupBy(*by).agg(n(a).alias("n_first"), n(b).alias("n_second"), n(a & b).alias("n_both"), n(a | b).alias("n_union"), n(a & ~b).alias("only_first"), n(b & ~a).alias("only_second"))
    return out.withColumn("jaccard", F.round(F.try_divide("n_both", "n_union"), 4))


def module_metrics(sets: DataFrame, modules: DataFrame, by: list[str], name: str, member: str, first: str, second: str) -> DataFrame:
    """Sizes of two named sets, all and with a module; Jaccard of the members; Jaccard of the modules present and cosine of the module counts.

    A member without a module is REVIEW_UNANNOTATED: it counts among the members and in no module metric.
    """
    rows = sets.where(F.col(name).isin(first, second) & F.col(member).isNotNull()).select(*by, name, member).distinct().join(modules.select(member, "module"), member, "left").withColumn("module", F.coalesce("module", F.lit("REVIEW_UNANNOTATED")))
    whole = compare_sets(sets, by, name, member, first, second).select(*by, F.col("n_first").alias("n_first"), F.col("n_second").alias("n_second"), F.try_divide("n_both", "n_union").alias("gene_jaccard"))
    per = rows.where("module <> 'REVIEW_UNANNOTATED'").groupBy(*by, "module").agg(F.count_if(F.col(name) == first).cast("double").alias("a"), F.count_if(F.col(name) == second).cast("double").alias("b"))
    both, some = F.count_if((F.col("a") > 0) & (F.col("b") > 0)), F.count(F.lit(1))
    cosine = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))
    known = per.groupBy(*by).agg(F.sum("a").cast("bigint").alias("n_first_annotated"), F.sum("b").cast("bigint").alias("n_second_annotated"), F.try_divide(both, some).alias("module_jaccard"), cosine.alias("module_cosine"))
    return whole.join(known, by, "left").na.fill(0, ["n_first_annotated", "n_second_annotated"])


OVERLAP = (
    "first_tested", "second_tested", "first_selected", "first_slow", "first_fast", "second_selected", "second_slow", "second_fast", "shared_slow", "first_only_slow", "second_only_slow", "slow_union",
    "first_slow_shared_percent", "second_slow_shared_percent", "slow_jaccard", "first_slow_second_fast", "first_fast_second_slow", "fast_both", "selected_both", "selected_jaccard", "concordant", "discordant",
)


def overlap_table(first: DataFrame, second: DataFrame) -> DataFrame:
    """The 22 metrics of two screens of the same genes, long: ``(study_id, metric, value, denominator, percent)``.

    Screens have ``(study_id, gene_id, t, selected)``, tested where t is not null; slow is t > 0 among the selected, fast the rest of them.
    Percents have two places, Jaccard indices four; a ratio without a denominator is null.
    """
    a = first.where("t IS NOT NULL").select("study_id", "gene_id", F.lit(True).alias("ta"), F.col("selected").alias("sa"), (F.col("selected") & (F.col("t") > 0)).alias("la"))
    b = second.where("t IS NOT NULL").select("study_id", "gene_id", F.lit(True).alias("tb"), F.col("selected").alias("sb"), (F.col("selected") & (F.col("t") > 0)).alias("lb"))
    rows = a.join(b, ["study_id", "gene_id"], "full").na.fill(False, ["ta", "sa", "la", "tb", "sb", "lb"])
    c = {x: F.col(x) for x in ("ta", "sa", "la", "tb", "sb", "lb")}
    fa, fb = c["sa"] & ~c["la"], c["sb"] & ~c["lb"]
    counts = {
        "first_tested": c["ta"], "second_tested": c["tb"], "first_selected": c["sa"], "first_slow": c["la"], "first_fast": fa, "second_selected": c["sb"], "second_slow": c["lb"], "second_fast": fb, "shared_slow": c["la"] & c["lb"],
        "first_only_slow": c["la"] & ~c["lb"], "second_only_slow": c["lb"] & ~c["la"], "slow_union": c["la"] | c["lb"], "first_slow_second_fast": c["la"] & fb, "first_fast_second_slow": fa & c["lb"], "fast_both": fa & fb,
        "selected_both": c["sa"] & c["sb"], "selected_union": c["sa"] | c["sb"], "concordant": (c["la"] & c["lb"]) | (fa & fb), "discordant": (c["la"] & fb) | (fa & c["lb"]),
    }
    n = rows.groupBy("study_id").agg(*[F.count_if(x).cast("double").alias(k) for k, x in counts.items()])
    ratio = lambda x, y, places, by=1.0: F.round(F.try_divide(F.col(x) * by, F.col(y)), places)
    n = n.withColumn("first_slow_shared_percent", ratio("shared_slow", "first_slow", 2, 100.0)).withColumn("second_slow_shared_percent", ratio("shared_slow", "second_slow", 2, 100.0))
    n = n.withColumn("slow_jaccard", ratio("shared_slow", "slow_union", 4)).withColumn("selected_jaccard", ratio("selected_both", "selected_union", 4))
    over = {"first_selected": "first_tested", "first_slow": "first_selected", "first_fast": "first_selected", "second_selected": "second_tested", "second_slow": "second_selected", "second_fast": "second_selected", "concordant": "selected_both", "discordant": "selected_both"}
    shown = over | {"first_slow_shared_percent": "first_slow", "second_slow_shared_percent": "second_slow"}
    none = F.lit(None).cast("double")
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(shown[m]) if m in shown else none).alias("denominator"), (ratio(m, over[m], 2, 100.0) if m in over else none).alias("percent")) for m in OVERLAP]
    return n.select("study_id", F.explode(F.array(*each)).alias("x")).select("study_id", "x.*")


def module_display(annotation: DataFrame, predictors: DataFrame) -> DataFrame:
    """Per study: predictors, how many are counted in the display, how many not, and the modules shown; refused unless annotation and predictors have the same genes.

    ``annotation`` has ``(study_id, gene_id, display_module, counted)``, one row per gene.
    """
    own = predictors.select("study_id", "gene_id").distinct()
    off = annotation.join(own, ["study_id", "gene_id"], "left_anti").select("study_id").unionByName(own.join(annotation, ["study_id", "gene_id"], "left_anti").select("study_id"))
    if off.limit(1).count() or annotation.groupBy("study_id", "gene_id").count().where("count > 1").limit(1).count():
        raise AxisError("annotation and predictors have different genes, or a gene twice")
    return annotation.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("union_predictors"), F.count_if("counted").cast("bigint").alias("counted"), F.count_if(~F.col("counted")).cast("bigint").alias("not_counted"), F.count_distinct(F.when(F.col("counted"), F.col("display_module"))).alias("display_modules"))


def turnover_modules(universe: DataFrame, sizes: DataFrame, n_draws: int) -> DataFrame:
    """Module metrics of pairs of random subsets of the annotated members: ``(study_id, draw, module_jaccard, module_cosine)``.

    ``universe`` has ``(study_id, member, module)``, modules null where a member has none; ``sizes`` has ``(study_id, n_first_annotated,
    n_second_annotated)``.  Members are placed in bytewise order and drawn as in ``turnover_draws``, by streams of their own.
    """
    known = universe.where("module IS NOT NULL").groupBy("study_id", "member").agg(F.min("module").alias("module")).groupBy("study_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "module"))), lambda x: x["module"]).alias("modules"))
    rows = known.join(sizes, "study_id").withColumn("first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_draws).cast("bigint"), F.lit(_BLOCK).cast("bigint"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for study, modules, a, b, first in batch[["study_id", "modules", "n_first_annotated", "n_second_annotated", "first"]].itertuples(index=False):
                names, code = np.unique(np.array(modules, str), return_inverse=True)
                hot = np.eye(len(names))[code]
                step = max(1, 1_000_000 // len(code))
                for start in range(first, min(first + _BLOCK, n_draws + 1), step):
                    draws = np.arange(start, min(start + step, first + _BLOCK, n_draws + 1), dtype=np.int64)
                    x, y = (_drawn(draws, len(code), int(k), stream) @ hot for k, stream in ((a, 3), (b, 4)))
                    either, both = ((x > 0) | (y > 0)).sum(1), ((x > 0) & (y > 0)).sum(1)
                    norm = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
                    with np.errstate(all="ignore"):
                        yield pd.DataFrame({"study_id": study, "draw": draws, "module_jaccard": np.where(either > 0, both / either, np.nan), "module_cosine": np.where(norm > 0, (x * y).sum(1) / norm, np.nan)})

    out = spread(rows, "study_id", "first").mapInPandas(run, "study_id string, draw bigint, module_jaccard double, module_cosine double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("module_jaccard", "module_cosine")})


_BLOCK = 500


def draw_key(draw: Column | np.ndarray, place: Column | np.ndarray, stream: int) -> Column | np.ndarray:
    """A portable pseudo-random key of (draw, place): integer arithmetic only, so that any engine gives the same."""
    x = (place * 7919 + draw * 104729 + stream * 15485863) % 1000003
    x = (x * x + place * 31 + stream) % 1000003
    return (x * x + draw * 17 + place) % 1000003


def turnover_draws(universe: DataFrame, sizes: DataFrame, n_draws: int) -> DataFrame:
    """Jaccard indices of pairs of random subsets drawn without replacement.

    ``universe`` has ``(study_id, member)``; ``sizes`` has ``(study_id, n_first, n_second)``.  Each draw orders the
    universe twice by a portable key and takes the first members.  Only the number of members enters the draws,
    so they are made in blocks of draws, a row each, over all tasks; no member is shuffled once per draw.
    """
    n = universe.select("study_id", "member").distinct().groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(sizes, "study_id").withColumn("first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_draws).cast("bigint"), F.lit(_BLOCK).cast("bigint"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for study, n, n_first, n_second, first in batch[["study_id", "n", "n_first", "n_second", "first"]].itertuples(index=False):
                # As many draws at a time as keep the keys small.
                step = max(1, 1_000_000 // n)
                for start in range(first, min(first + _BLOCK, n_draws + 1), step):
                    draws = np.arange(start, min(start + step, first + _BLOCK, n_draws + 1), dtype=np.int64)
                    a, b = (_drawn(draws, n, k, stream) for k, stream in ((n_first, 1), (n_second, 2)))
                    yield pd.DataFrame({"study_id": study, "draw": draws, "n_both": (a & b).sum(1), "n_union": (a | b).sum(1)})

    out = spread(rows, "study_id", "first").mapInPandas(run, "study_id string, draw bigint, n_both bigint, n_union bigint")
    return out.withColumn("jaccard", F.try_divide("n_both", "n_union"))


def _drawn(draws: np.ndarray, n: int, k: int, stream: int) -> np.ndarray:
    """Which of the places 1..n are among the first k by key, per draw; equal keys go by place."""
    place = np.arange(1, n + 1, dtype=np.int64)
    order = np.argsort(draw_key(draws[:, None], place[None], stream), axis=1, kind="stable")
    out = np.zeros((len(draws), n), bool)
    np.put_along_axis(out, order[:, :k], True, axis=1)
    return out


def turnover_summary(observed: DataFrame, draws: DataFrame, metric: str = "jaccard") -> DataFrame:
    """Of one metric: null median, 95 % interval and its text, p = (1 + draws at or above) / (1 + defined draws), z, and enrichment over the null median."""
    # Draws are counted by value before anything is joined: adaptive execution takes them for as few as the blocks they are made from, and would send them through the driver.
    values = draws.where(F.col(metric).isNotNull()).groupBy("study_id", F.col(metric).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    a = values.groupBy("study_id").agg(F.percentile("x", [0.025, 0.5, 0.975], F.col("n")).alias("q"), F.array_sort(F.collect_list(F.struct("x", "n"))).alias("v"), F.sum("n").alias("n_draws"))
    a = a.join(unbroadcast(observed.select("study_id", F.col(metric).alias("observed"))), "study_id")
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, v: s + v["n"] * f(v["x"]))
    least = F.get("v", F.lit(0))["x"]  # moments about a value of the draws: equal draws deviate by nothing
    a = a.withColumn("mean", least + total(lambda x: x - least) / F.col("n_draws"))
    a = a.withColumn("sd", F.sqrt(F.try_divide(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.col("n_draws") - 1)))
    a = a.withColumn("hits", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, v: s + F.when(v["x"] >= F.col("observed"), v["n"]).otherwise(0)))
    low, middle, high = (F.get("q", F.lit(i)) for i in range(3))
    return a.select("study_id", F.lit(metric).alias("metric"), "observed", middle.alias("null_median"), low.alias("null_low"), high.alias("null_high"), F.format_string("%.4f-%.4f", low, high).alias("null_95_interval"),
        ((F.col("hits") + 1) / (F.col("n_draws") + 1)).alias("p"), F.try_divide(F.col("observed") - F.col("mean"), F.when(F.col("sd") > 0, F.col("sd"))).alias("z"), F.try_divide(F.col("observed"), middle).alias("enrichment"), "n_draws")


def ordered_listing(rows: DataFrame, by: list[str], member: str, order: list[str], sep: str = "; ") -> DataFrame:
    """The members of each group as one text in the given order."""
    item = F.struct(*order, F.col(member).alias("__m"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__m"]), sep).alias("listing"), F.count(F.lit(1)).alias("n"))
