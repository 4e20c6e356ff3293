"""The additive-margin baseline: fitted values with the observed gene and branch sums, and where it exists.

A study's admitted cells are the edges of a graph between genes and branches.
Components without mass, vertices without mass, and zero edges that no flow with
the observed margins can use are set aside with their state (fitted 0); on the
rest the fit mu = G_gene * B_branch is found by proportional scaling.
Studies of up to ``LOCAL_EDGES`` edges are solved whole in one task each, many at
a time; a larger study is solved by joins and aggregations over its edges.  Both
ways have the same states, tolerances and certificates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.functions.graphs import components, condensation_rank, strong_components
from cladeframe.operators.cells import KEY
from cladeframe.workspace import Workspace, spread

LOCAL_EDGES = 2_000_000


@dataclass(frozen=True)
class C3Control:
    """Relative tolerance, absolute tolerance scale, most sweeps, most edges of a component that is certified.

    A component of more edges fails closed: its study has no fitted value.  ``replay`` solves every study a second time
    and certifies it only if all fitted values are the same bits.
    """

    rtol: float = 1e-10
    atol_scale: float = 1e-12
    most_sweeps: int = 10_000
    certificate_max_edges: float = 2e7
    replay: bool = False

    def __post_init__(self) -> None:
        if not (0 < self.rtol < float("inf") and 0 < self.atol_scale < float("inf") and self.most_sweeps >= 1 and self.certificate_max_edges >= 0):
            raise ContractError("a tolerance or limit of the fit lies outside its range")


def domain(cells: DataFrame) -> DataFrame:
    """Admitted edges ``(study_id, gene_id, branch_id, y)``: eligible observed cells with a finite value of 0 or more."""
    good = (F.col("coord_state") == "observed") & F.col("value").isNotNull() & (F.col("value") >= 0) & (F.col("value") < float("inf"))
    if "elig_status" in cells.columns:
        good = good & (F.col("elig_status") == "eligible")
    return cells.where(good).select(*KEY, F.col("value").alias("y"))


def margins(edges: DataFrame) -> DataFrame:
    """Sums per gene, per branch and per study (``axis``, ``id``), from one pass with grouping sets."""
    sums = edges.groupingSets([["study_id", "gene_id"], ["study_id", "branch_id"], ["study_id"]], "study_id", "gene_id", "branch_id")
    rows = sums.agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n_edges"), F.grouping("gene_id").alias("g"), F.grouping("branch_id").alias("b"))
    axis = F.when(F.col("g") == 0, "gene").when(F.col("b") == 0, "branch").otherwise("study")
    return rows.select("study_id", axis.alias("axis"), F.coalesce("gene_id", "branch_id").alias("id"), "total", "n_edges")


def vertex_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(study_id, axis, id, component)``: least-label propagation between genes and branches, a table per round.

    The component is named by its least gene.  Two aggregations a round; the
    rounds are as many as the graph is deep, which for matrices is few.
    """
    edges = work.save(edges.select(*KEY).distinct(), "edges")
    genes = work.save(edges.select("study_id", "gene_id").distinct().withColumn("label", F.col("gene_id")), "genes-0")
    k = 0
    while True:
        k += 1
        branches = edges.join(genes, ["study_id", "gene_id"]).groupBy("study_id", "branch_id").agg(F.min("label").alias("label"))
        new = edges.join(branches, ["study_id", "branch_id"]).groupBy("study_id", "gene_id").agg(F.min("label").alias("new"))
        new = work.save(new.join(genes, ["study_id", "gene_id"]), f"genes-{k}")
        changed = new.where(F.col("new") < F.col("label")).limit(1).count()
        genes = new.select("study_id", "gene_id", F.col("new").alias("label"))
        if not changed:
            break
    branches = edges.join(genes, ["study_id", "gene_id"]).groupBy("study_id", "branch_id").agg(F.min("label").alias("component"))
    return genes.select("study_id", F.lit("gene").alias("axis"), F.col("gene_id").alias("id"), F.col("label").alias("component")).unionByName(
        branches.select("study_id", F.lit("branch").alias("axis"), F.col("branch_id").alias("id"), "component")
    )


def support(y: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State of each edge in the order of precedence (no mass in the component, none at a vertex, off the face, interior), its dual
    coefficient (0 on the face), and the number of edges of its component once edges without mass are gone (0 for these)."""
    ng, nb = int(g.max()) + 1, int(b.max()) + 1
    state, dual, size = np.full(len(y), "FINITE_INTERIOR", dtype=object), np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    of = components(ng + nb, g, b + ng)
    total = np.bincount(of[g], y, of.max() + 1)
    empty = total[of[g]] == 0
    state[empty] = "ZERO_TOTAL_COMPONENT"
    edge = (np.bincount(g, y, ng)[g] == 0) | (np.bincount(b, y, nb)[b] == 0)
    state[edge & ~empty] = "ZERO_MARGIN_BOUNDARY"
    left = ~edge & ~empty
    reduced = components(ng + nb, g[left], b[left] + ng)[g[left]]
    size[left] = np.bincount(reduced)[reduced] if left.any() else 0
    positive = left & (y > 0)
    # An edge of value 0 can carry flow only along a cycle through blocks of positive edges.
    block = components(ng + nb, g[positive], b[positive] + ng)
    zero = np.flatnonzero(left & (y == 0))
    if len(zero):
        out, into = block[g[zero]], block[b[zero] + ng]
        arcs = np.unique(np.stack([out, into], 1)[out != into], axis=0)
        scc = strong_components(int(block.max()) + 1, arcs[:, 0], arcs[:, 1])
        state[zero[scc[out] != scc[into]]] = "FACIAL_BOUNDARY"
        # The rank of the condensation exposes the face: it grows along every forced edge and along no other.
        rank = condensation_rank(scc, arcs[:, 0], arcs[:, 1])
        dual[zero] = np.where(scc[out] != scc[into], rank[scc[into]] - rank[scc[out]], 0)
    return state, dual, size


def scale(y: np.ndarray, g: np.ndarray, b: np.ndarray, control: C3Control) -> tuple[np.ndarray, int, float, bool]:
    """Fitted values of edges with interior support, sweeps, greatest relative error of a margin, and whether all margins meet the tolerance."""
    ng, nb = int(g.max()) + 1, int(b.max()) + 1
    rows, cols = np.bincount(g, y, ng), np.bincount(b, y, nb)
    of = components(ng + nb, g, b + ng)
    per = np.bincount(of[g], y) / np.bincount(of[g])
    atol = control.atol_scale * np.maximum(1, per)
    left, right = np.ones(ng), np.ones(nb)
    error = np.inf
    with np.errstate(all="ignore"):
        for sweep in range(1, control.most_sweeps + 1):
            left = rows / np.bincount(g, right[b], ng)
            right = cols / np.bincount(b, left[g], nb)
            mu = left[g] * right[b]
            if not np.isfinite(mu).all() or (mu == 0).any():
                return mu, sweep, np.inf, False
            eg, eb = np.abs(np.bincount(g, mu, ng) - rows), np.abs(np.bincount(b, mu, nb) - cols)
            error = max((eg / rows).max(), (eb / cols).max())
            if (eg <= atol[of[:ng]] + control.rtol * rows).all() and (eb <= atol[of[ng:]] + control.rtol * cols).all():
                return mu, sweep, float(error), True
    return mu, sweep, float(error), False


_FIT = "study_id string, gene_id string, branch_id string, y double, mu double, support_state string, dual bigint, sweeps int, margin_error double, certified boolean"
_COLUMNS = [c.split()[0] for c in _FIT.split(", ")]


def _fit_study(control: C3Control):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["gene_id", "branch_id"], kind="stable").reset_index(drop=True)
        g, b = pd.factorize(rows.gene_id)[0], pd.factorize(rows.branch_id)[0]
        y = rows.y.to_numpy(float)
        state, dual, size = support(y, g, b)
        inside = np.flatnonzero(state == "FINITE_INTERIOR")
        mu, sweeps, error, good = np.zeros(len(y)), 0, 0.0, bool(size.max(initial=0) <= control.certificate_max_edges)
        if len(inside) and good:
            gi, bi = np.unique(g[inside], return_inverse=True)[1].ravel(), np.unique(b[inside], return_inverse=True)[1].ravel()
            mu[inside], sweeps, error, good = scale(y[inside], gi, bi, control)
            if good and control.replay:
                good = bool((scale(y[inside], gi, bi, control)[0] == mu[inside]).all())
        # Fail closed: a study that does not meet its margins releases no fitted value.
        rows["mu"] = mu if good else np.nan
        rows["support_state"], rows["dual"], rows["sweeps"], rows["margin_error"], rows["certified"] = state, dual, sweeps, error, good
        return rows[_COLUMNS]

    return run


def fit(edges: DataFrame, work: Workspace, control: C3Control = C3Control(), local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Every admitted edge with its fitted value ``mu``, support state and dual coefficient; ``mu`` is null where nothing is certified.

    The support state tells where an edge stands whether its study is certified or not.
    A study without edges does not come out.
    """
    size = edges.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    large = work.save(size.where(F.col("n") > local_edges).select("study_id"), "large")
    out = spread(edges.join(large, "study_id", "left_anti"), "study_id").groupBy("study_id").applyInPandas(_fit_study(control), _FIT)
    out = out.withColumn("mu", F.when(~F.isnan("mu"), F.col("mu")))
    if not large.isEmpty():
        out = out.unionByName(fit_joined(edges.join(large, "study_id"), work, control))
    return out


_SCC = "study_id string, block string, scc string, rank bigint"


def _blocks_of_study(rows: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of a study's distinct block arcs, named by their least block, and their ranks."""
    names, codes = np.unique(np.concatenate([rows.out.to_numpy(str), rows.into.to_numpy(str)]), return_inverse=True)
    a, b = codes.ravel()[: len(rows)], codes.ravel()[len(rows) :]
    scc = strong_components(len(names), a, b)
    least = np.full(scc.max() + 1, len(names))
    np.minimum.at(least, scc, np.arange(len(names)))
    return pd.DataFrame({"study_id": rows.study_id.iloc[0], "block": names, "scc": names[least[scc]], "rank": condensation_rank(scc, a, b)[scc]})


def support_joined(edges: DataFrame, work: Workspace) -> DataFrame:
    """The edges with margins ``r`` and ``c``, support state, dual coefficient and edges of the reduced component, by joins.

    Only the distinct arcs between a study's blocks of positive edges meet in one task.
    """
    rows = edges.groupBy("study_id", "gene_id").agg(F.sum("y").alias("r"))
    cols = edges.groupBy("study_id", "branch_id").agg(F.sum("y").alias("c"))
    of = lambda d, name: vertex_components(d, Workspace(work.spark, f"c3-{name}"))
    gene = lambda d, name: d.where("axis = 'gene'").select("study_id", F.col("id").alias("gene_id"), F.col("component").alias(name))
    branch = lambda d, name: d.where("axis = 'branch'").select("study_id", F.col("id").alias("branch_id"), F.col("component").alias(name))
    whole = gene(of(edges, "all"), "whole")
    mass = rows.join(whole, ["study_id", "gene_id"]).groupBy("study_id", "whole").agg(F.sum("r").alias("mass"))
    marked = edges.join(rows, ["study_id", "gene_id"]).join(cols, ["study_id", "branch_id"]).join(whole, ["study_id", "gene_id"]).join(mass, ["study_id", "whole"])
    marked = marked.withColumn("state", F.when(F.col("mass") == 0, "ZERO_TOTAL_COMPONENT").when((F.col("r") == 0) | (F.col("c") == 0), "ZERO_MARGIN_BOUNDARY"))
    marked = work.save(marked.drop("whole", "mass"), "marked")
    left = marked.where("state IS NULL").select(*KEY, "y")
    reduced, block = gene(of(left, "reduced"), "reduced"), of(left.where("y > 0"), "positive")
    sizes = left.join(reduced, ["study_id", "gene_id"]).groupBy("study_id", "reduced").agg(F.count(F.lit(1)).alias("n_reduced"))
    sizes = reduced.join(sizes, ["study_id", "reduced"]).select("study_id", "gene_id", "n_reduced")
    zero = left.where("y = 0").join(gene(block, "out"), ["study_id", "gene_id"]).join(branch(block, "into"), ["study_id", "branch_id"]).where(F.col("out") != F.col("into"))
    zero = work.save(zero.select(*KEY, "out", "into"), "zero")
    scc = zero.select("study_id", "out", "into").distinct().groupBy("study_id").applyInPandas(_blocks_of_study, _SCC)
    scc = work.save(scc, "scc")
    end = lambda name: scc.select("study_id", F.col("block").alias(name), F.col("scc").alias(f"s_{name}"), F.col("rank").alias(f"r_{name}"))
    forced = zero.join(end("out"), ["study_id", "out"]).join(end("into"), ["study_id", "into"]).where(F.col("s_out") != F.col("s_into"))
    forced = forced.select(*KEY, (F.col("r_into") - F.col("r_out")).alias("dual"))
    every = marked.join(forced, list(KEY), "left").join(sizes, ["study_id", "gene_id"], "left")
    state = F.coalesce("state", F.when(F.col("dual").isNotNull(), "FACIAL_BOUNDARY").otherwise("FINITE_INTERIOR"))
    size = F.when(F.col("state").isNull(), F.col("n_reduced")).otherwise(0)
    return work.save(every.select(*KEY, "y", "r", "c", state.alias("support_state"), F.coalesce("dual", F.lit(0)).cast("bigint").alias("dual"), size.alias("n_reduced")), "support")


def fit_joined(edges: DataFrame, work: Workspace, control: C3Control = C3Control(), every: int = 4) -> DataFrame:
    """The same fit by joins, for studies that no task should hold: a table of factors every few sweeps, until each study meets its margins.

    Values may differ from those of the local way within the tolerances.  A study that is done leaves the sweeps.
    """
    marked = support_joined(edges, work)
    over = marked.groupBy("study_id").agg(F.max("n_reduced").alias("n")).where(F.col("n") > control.certificate_max_edges).select("study_id")
    base = inside = marked.where("support_state = 'FINITE_INTERIOR'").join(over, "study_id", "left_anti")
    of = work.save(vertex_components(inside.select(*KEY), Workspace(work.spark, "c3-final")), "final")
    per = inside.join(of.where("axis = 'gene'").select("study_id", F.col("id").alias("gene_id"), "component"), ["study_id", "gene_id"])
    per = per.groupBy("study_id", "component").agg((control.atol_scale * F.greatest(F.lit(1.0), F.avg("y"))).alias("atol"))
    atol = work.save(of.join(per, ["study_id", "component"]).select("study_id", "axis", "id", "atol"), "atol")
    right = inside.select("study_id", "branch_id", F.lit(1.0).alias("b")).distinct()
    done: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    sweep = 0
    while sweep < control.most_sweeps:
        for _ in range(min(every, control.most_sweeps - sweep)):
            left = inside.join(right, ["study_id", "branch_id"]).groupBy("study_id", "gene_id").agg((F.first("r") / F.sum("b")).alias("g"))
            right = inside.join(left, ["study_id", "gene_id"]).groupBy("study_id", "branch_id").agg((F.first("c") / F.sum("g")).alias("b"))
            sweep += 1
        left, right = work.save(left, f"left-{sweep}"), work.save(right, f"right-{sweep}")
        mu = inside.join(left, ["study_id", "gene_id"]).join(right, ["study_id", "branch_id"]).withColumn("mu", F.col("g") * F.col("b"))
        off = []
        for axis, column, goal in (("gene", "gene_id", "r"), ("branch", "branch_id", "c")):
            sums = mu.groupBy("study_id", F.col(column).alias("id")).agg(F.sum("mu").alias("m"), F.first(goal).alias("goal")).join(atol.where(F.col("axis") == axis), ["study_id", "id"])
            gap = F.abs(F.col("m") - F.col("goal"))
            off.append(sums.select("study_id", (gap / F.col("goal")).alias("error"), (gap <= F.col("atol") + control.rtol * F.col("goal")).alias("ok")))
        told = off[0].unionByName(off[1]).groupBy("study_id").agg(F.max("error").alias("margin_error"), F.every(F.coalesce("ok", F.lit(False))).alias("ok"))
        told = work.save(told.withColumn("sweeps", F.lit(sweep)), f"told-{sweep}")
        n = told.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("open")).first()
        if n.ok or not n.open or sweep >= control.most_sweeps:
            done.append((left, right, told if sweep >= control.most_sweeps else told.where("ok")))
        if not n.open:
            break
        ready = told.where("NOT ok").select("study_id")
        inside, right = base.join(ready, "study_id", "left_semi"), right.join(ready, "study_id", "left_semi")
    factors = [reduce(DataFrame.unionByName, [d[i].join(d[2].select("study_id"), "study_id", "left_semi") for d in done]) for i in (0, 1)]
    verdict = reduce(DataFrame.unionByName, [d[2] for d in done])
    rows = marked.join(factors[0], ["study_id", "gene_id"], "left").join(factors[1], ["study_id", "branch_id"], "left").join(verdict, "study_id", "left").join(over.withColumn("over", F.lit(True)), "study_id", "left")
    good = F.coalesce("ok", F.lit(True)) & F.col("over").isNull()
    mu = F.when(F.col("support_state") == "FINITE_INTERIOR", F.col("g") * F.col("b")).otherwise(0.0)
    return rows.select(*KEY, "y", F.when(good, mu).alias("mu"), "support_state", "dual", F.coalesce("sweeps", F.lit(0)).alias("sweeps"), F.coalesce("margin_error", F.lit(0.0)).alias("margin_error"), good.alias("certified"))


def certificates(fitted: DataFrame) -> DataFrame:
    """Per study: edges by state, sweeps, margin error, the generalised Kullback-Leibler objective, the sign checks of the fit, and its state.

    ``state`` is NUMERICALLY_INDETERMINATE where nothing is certified, else the least interior of what its edges have.
    """
    y, mu, s = F.col("y"), F.col("mu"), F.col("support_state")
    d = (y - mu) / mu
    series = mu * (d * d / 2 - d * d * d / 6 + d * d * d * d / 12 - d**5 / 20 + d**6 / 30)
    bound = 64 * 2.0**-52 * F.greatest(F.lit(1.0), y, mu)
    term = F.when(F.abs(d) < 1e-4, series).otherwise(y * F.ln(y / mu) - y + mu)
    term = F.when(mu.isNull(), F.lit(None)).when((mu == 0) | (y == 0), mu).otherwise(F.when((term < 0) & (F.abs(term) <= bound), 0.0).otherwise(term))
    n = lambda x: F.count_if(s == x).cast("bigint").alias(x.lower())
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    out = fitted.withColumn("__t", term).groupBy("study_id").agg(
        n("FINITE_INTERIOR"), n("ZERO_MARGIN_BOUNDARY"), n("ZERO_TOTAL_COMPONENT"), n("FACIAL_BOUNDARY"),
        F.max("sweeps").alias("sweeps"), F.max("margin_error").alias("margin_error"), F.sum("__t").alias("objective"), F.every("certified").alias("certified"),
        count(F.col("__t") < 0).alias("negative_terms"), count((y > 0) & (mu == 0)).alias("positive_y_with_zero_mu"), count((s == "FINITE_INTERIOR") & ~(mu > 0)).alias("interior_without_mu"),
        count((s != "FINITE_INTERIOR") & (mu != 0)).alias("mu_off_face"), count((s == "FACIAL_BOUNDARY") & (F.col("dual") <= 0)).alias("dual_not_positive"), count((s != "FACIAL_BOUNDARY") & (F.col("dual") != 0)).alias("dual_on_face"),
    )
    state = F.when(~F.col("certified"), "NUMERICALLY_INDETERMINATE").when(F.col("facial_boundary") > 0, "FACIAL_BOUNDARY").when(F.col("finite_interior") > 0, "FINITE_INTERIOR").when(F.col("zero_total_component") > 0, "ZERO_TOTAL_COMPONENT").otherwise("ZERO_MARGIN_BOUNDARY")
    return out.withColumn("state", state)


def component_margins(edges: DataFrame, work: Workspace) -> DataFrame:
    """Per component: edges, total, and whether the sums of its gene and of its branch margins meet the total within the summation tolerance.

    The tolerance is 64 eps max(1, |total|) ceil(log2 edges).  The component is named by its least gene.
    """
    of = work.save(vertex_components(edges, Workspace(work.spark, "c3-margins")), "of")
    own = edges.join(of.where("axis = 'gene'").select("study_id", F.col("id").alias("gene_id"), "component"), ["study_id", "gene_id"])
    total = own.groupBy("study_id", "component").agg(F.count(F.lit(1)).alias("edge_count"), F.sum("y").alias("total"))
    sums = margins(edges).where("axis <> 'study'").select("study_id", "axis", "id", F.col("total").alias("m")).join(of, ["study_id", "axis", "id"])
    sums = sums.groupBy("study_id", "component").agg(F.sum(F.when(F.col("axis") == "gene", F.col("m"))).alias("g"), F.sum(F.when(F.col("axis") == "branch", F.col("m"))).alias("b"), F.every(F.coalesce((F.col("m") >= 0) & (F.col("m") < float("inf")), F.lit(False))).alias("nonnegative"))
    atol = 64 * 2.0**-52 * F.greatest(F.lit(1.0), F.abs("total")) * F.greatest(F.lit(1.0), F.ceil(F.log2(F.col("edge_count").cast("double"))))
    ok = (F.abs(F.col("g") - F.col("total")) <= atol) & (F.abs(F.col("b") - F.col("total")) <= atol)
    return total.join(sums, ["study_id", "component"]).select("study_id", "component", "edge_count", "total", "nonnegative", ok.alias("pass"))


def unsupported(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Genes and branches of the matrices without an admitted cell."""
    out = []
    for axis, c in (("gene", "gene_id"), ("branch", "branch_id")):
        lost = cells.select("study_id", c).distinct().join(edges.select("study_id", c).distinct(), ["study_id", c], "left_anti")
        out.append(lost.select("study_id", F.lit(axis).alias("vertex_type"), F.col(c).alias("vertex_id"), F.lit("UNSUPPORTED_VERTEX").alias("state")))
    return out[0].unionByName(out[1])
