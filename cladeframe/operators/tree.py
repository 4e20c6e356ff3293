"""Trees of studies: Newick text, splits, rooted edges, joins of edges to split sides, parsimony states.

A tree belongs to one study and fits one task (it has as many tips as the study
has taxa); studies are worked on side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.errors import ContractError
from cladeframe.operators.cells import newest
from cladeframe.workspace import spread


def parse_newick(text: str) -> tuple[list[tuple[int, int, float | None]], dict[int, str]]:
    """Edges ``(parent, child, length)`` in reading order and labels of nodes; node 0 is the root.

    Quoted labels keep their blanks; comments in brackets are dropped.  Unbalanced text is refused.
    """
    edges: list[list] = []
    labels: dict[int, str] = {}
    stack: list[int] = []
    node, nodes, i = 0, 1, 0
    current = 0

    def child(parent: int) -> int:
        nonlocal nodes
        nodes += 1
        edges.append([parent, nodes - 1, None])
        return nodes - 1

    where: dict[int, int] = {}
    text = text.strip()
    while i < len(text):
        c = text[i]
        if c == "(":
            stack.append(current)
            current = child(current)
            where[current] = len(edges) - 1
        elif c == ",":
            if not stack:
                raise ContractError("Newick: a comma outside brackets")
            current = child(stack[-1])
            where[current] = len(edges) - 1
        elif c == ")":
            if not stack:
                raise ContractError("Newick: too many closing brackets")
            current = stack.pop()
        elif c == "[":
            i = text.find("]", i)
            if i < 0:
                raise ContractError("Newick: an open comment")
        elif c == ":":
            j = i + 1
            while j < len(text) and text[j] not in ",();[":
                j += 1
            if current in where:
                edges[where[current]][2] = float(text[i + 1 : j])
            i = j - 1
        elif c == ";":
            break
        elif c == "'":
            j = i + 1
            while True:
                j = text.index("'", j)
                if text[j : j + 2] != "''":
                    break
                j += 2
            labels[current] = text[i + 1 : j].replace("''", "'")
            i = j
        elif not c.isspace():
            j = i
            while j < len(text) and text[j] not in ",():;[":
                j += 1
            labels[current] = text[i:j].strip()
            i = j - 1
        i += 1
    if stack:
        raise ContractError("Newick: too few closing brackets")
    return [tuple(e) for e in edges], labels


def side_key(side: Column) -> Column:
    """The canonical text of a split side: its taxa sorted bytewise, joined by ``;``."""
    return F.array_join(F.array_sort(F.split(side, ";")), ";")


def splits(coordinates: DataFrame) -> DataFrame:
    """``(study_id, branch_id, branch_type, a, b, terminal_taxon)``: in-force coordinates with their canonical sides."""
    rows = newest(coordinates.where("retired_at IS NULL AND study_id IS NOT NULL AND branch_id IS NOT NULL"), ["study_id", "branch_id"], ["loaded_at", "row_id"])
    return rows.select("study_id", "branch_id", "branch_type", side_key(F.col("side_a_taxa")).alias("a"), side_key(F.col("side_b_taxa")).alias("b"), "terminal_taxon")


def split_issues(split: DataFrame) -> DataFrame:
    """Branches whose sides do not part the study's tips, or whose type does not fit their sides.

    Issues: ``missing_side``, ``overlap``, ``not_all_tips``, ``type``; several may hold, the first is told.
    """
    a, b = F.split("a", ";"), F.split("b", ";")
    tips = split.where("a IS NOT NULL AND b IS NOT NULL").select("study_id", (F.size(F.array_union(a, b))).alias("n")).groupBy("study_id").agg(F.max("n").alias("n_tips"))
    rows = split.join(tips, "study_id", "left")
    terminal = (F.size(a) == 1) | (F.size(b) == 1)
    issue = (
        F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == "") | (F.col("b") == ""), "missing_side").when(F.size(F.array_intersect(a, b)) > 0, "overlap")
        .when(F.size(F.array_union(a, b)) != F.col("n_tips"), "not_all_tips").when(terminal != (F.col("branch_type") == "terminal"), "type")
    )
    return rows.select("study_id", "branch_id", issue.alias("issue")).where("issue IS NOT NULL")


_EDGES = "study_id string, branch_id string, parent_branch string, clade string, n_tips int, depth int"


def _root(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges of the tree rooted at the last tip: each split's clade is its side without that tip, its parent the least clade around it."""
    rows = rows.sort_values("branch_id", kind="stable")
    sides = [(set(a.split(";")), set(b.split(";"))) for a, b in zip(rows.a, rows.b)]
    tips = sorted(set().union(*(x | y for x, y in sides)))
    root = tips[-1]
    clades = [y if root in x else x for x, y in sides]
    clades = [c if c and root not in c else set() for c in clades]
    bit = {t: 1 << i for i, t in enumerate(tips)}
    bits = [sum(bit[t] for t in c) for c in clades]
    size = np.array([len(c) for c in clades])
    order = np.lexsort((rows.branch_id.to_numpy(), size)).tolist()
    above = np.searchsorted(size[order], size, "right").tolist()  # the first place in order of a larger clade
    parent: list[str | None] = [None] * len(clades)
    depth = np.zeros(len(clades), int)
    names = rows.branch_id.to_list()
    for i, own in enumerate(bits):
        if own:
            parent[i] = next((names[k] for k in order[above[i] :] if bits[k] & own == own), None)
    at = {n: i for i, n in enumerate(names)}
    for i in order[::-1]:
        depth[i] = depth[at[parent[i]]] + 1 if parent[i] is not None else 1
    return pd.DataFrame({"study_id": rows.study_id.to_numpy(), "branch_id": names, "parent_branch": parent, "clade": [";".join(sorted(c)) for c in clades], "n_tips": size, "depth": depth})


def rooted_edges(split: DataFrame) -> DataFrame:
    """The rooted tree of each study from its splits; a repeated split gives parallel edges, a missing side is left out."""
    return spread(split.where("a IS NOT NULL AND b IS NOT NULL"), "study_id").groupBy("study_id").applyInPandas(_root, _EDGES)


def join_edges(edges: DataFrame, split: DataFrame) -> DataFrame:
    """Tree edges with the branches whose side A or B is exactly their clade; ``n_matches`` must be 1 for a sound ledger."""
    side = split.select("study_id", F.col("branch_id").alias("split_branch"), F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
    rows = edges.join(side, (edges.clade == side.key) & (edges.study_id == side.study_id), "left").select(edges.study_id, "branch_id", "clade", "split_branch")
    return rows.groupBy("study_id", "branch_id", "clade").agg(F.count("split_branch").alias("n_matches"), F.min("split_branch").alias("split_branch"))


def _parsimony(children: dict, roots: list, tips: dict, states: list[float]) -> dict:
    """Cost of each state at each node given all tips (unit changes), by one pass up and one down without recursion."""
    order, todo = [], list(roots)
    while todo:
        n = todo.pop()
        order.append(n)
        todo += children.get(n, [])
    up: dict = {}
    reach = lambda cost: [min(x, min(cost) + 1) for x in cost]
    from_child: dict = {}
    for n in reversed(order):
        cost = [0.0 if x == tips[n] else np.inf for x in states] if n in tips else [0.0] * len(states)
        for c in children.get(n, []):
            cost = [x + y for x, y in zip(cost, from_child[c])]
        up[n], from_child[n] = cost, reach(cost)
    total = {}
    for n in order:
        total.setdefault(n, up[n])
        for c in children.get(n, []):
            total[c] = [x + y for x, y in zip(up[c], reach([x - y for x, y in zip(total[n], from_child[c])]))]
    return total


def _reconstruct(rows: pd.DataFrame) -> pd.DataFrame:
    states = sorted(rows.state.dropna().unique())
    children: dict = {}
    for b, p in zip(rows.branch_id, rows.parent_branch):
        children.setdefault(p if isinstance(p, str) else None, []).append(b)
    tips = {b: s for b, s in zip(rows.branch_id, rows.state) if not pd.isna(s)}
    out = rows[["study_id", "branch_id", "parent_branch"]].copy()
    if not states:
        return out.assign(state=np.nan, observed=False)
    total = _parsimony({k: v for k, v in children.items() if k is not None}, children.get(None, []), tips, states)
    best = [states[total[b].index(min(total[b]))] for b in rows.branch_id]
    observed = rows.branch_id.isin(list(tips)).to_numpy()
    return out.assign(state=best, observed=observed)


def parsimony_states(edges: DataFrame, tips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """State of every branch (of its descendant node) by maximum parsimony from the states of terminal branches.

    Ties go to the least state.  ``tips`` has ``(study_id, branch_id, state)`` and any ``by`` columns (trait, world): each
    combination is reconstructed on its own, so many worlds are one job.  A study without tip states gives nulls.
    """
    rows = edges.select("study_id", "branch_id", "parent_branch")
    if by:
        rows = rows.join(tips.select("study_id", *by).distinct(), "study_id")
    rows = rows.join(tips.select("study_id", "branch_id", *by, "state"), ["study_id", *by, "branch_id"], "left")
    extra = "".join(f", {c} {dict(tips.dtypes)[c]}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _reconstruct(pdf)
        for c in by:
            out[c] = pdf[c].to_numpy()
        return out

    out = spread(rows, "study_id", *by).groupBy("study_id", *by).applyInPandas(run, "study_id string, branch_id string, parent_branch string, state double, observed boolean" + extra)
    s = F.when(~F.isnan("state"), F.col("state"))
    return out.withColumn("state", s).withColumn("screened", F.coalesce(s.isin(0.0, 1.0), F.lit(False))).withColumn("reason", F.when(s == 0.5, "intermediate_excluded"))


def match_edges(main: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of two rooted trees of a study with the same clade, ``(study_id, branch_id, other_branch, clade)``, and the ledger of those that have none or several.

    Both have ``(study_id, branch_id, clade)``.  The ledger says ``main`` or ``other`` for the side and how many partners there are.
    """
    a, b = main.select("study_id", "branch_id", "clade"), other.select("study_id", F.col("branch_id").alias("other_branch"), "clade")
    pairs = a.join(b, ["study_id", "clade"])
    ledger = []
    for side, own, name in (("main", a, "branch_id"), ("other", b, "other_branch")):
        n = own.join(pairs.groupBy("study_id", name).agg(F.count(F.lit(1)).alias("n")), ["study_id", name], "left")
        ledger.append(n.select("study_id", F.lit(side).alias("side"), F.col(name).alias("branch_id"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_partners")).where("n_partners <> 1"))
    once = pairs.join(ledger[0].select("study_id", "branch_id"), ["study_id", "branch_id"], "left_anti").join(ledger[1].select("study_id", F.col("branch_id").alias("other_branch")), ["study_id", "other_branch"], "left_anti")
    return once.select("study_id", "branch_id", "other_branch", "clade"), ledger[0].unionByName(ledger[1])


def map_states(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """States reconstructed on another tree carried over to the branches of the main one, by matched edges; ``pairs`` as ``match_edges`` gives them."""
    own = states.select("study_id", F.col("branch_id").alias("other_branch"), "state")
    return pairs.join(own, ["study_id", "other_branch"]).select("study_id", "branch_id", "state")


_ARRAYS = "study_id string, branch_id string, states array<double>"


def _reconstruct_arrays(edges: pd.DataFrame, tips: pd.DataFrame) -> pd.DataFrame:
    """States of all branches in many worlds at once: the costs of a node are an array (states x worlds)."""
    names = edges.branch_id.to_numpy(str)
    at = {b: i for i, b in enumerate(names)}
    parent = np.array([at.get(p, -1) if isinstance(p, str) else -1 for p in edges.parent_branch], np.int64)
    own = tips[tips.branch_id.isin(at)]
    if not len(own) or not len(edges):
        return pd.DataFrame(columns=["study_id", "branch_id", "states"])
    given = np.stack([np.array(x, float) for x in own.states])
    values = np.unique(given[~np.isnan(given)])
    k, worlds = len(values), given.shape[1]
    children: list[list[int]] = [[] for _ in names]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    order, todo = [], [i for i, p in enumerate(parent) if p < 0]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += children[n]
    up = np.zeros((len(names), k, worlds))
    tip = {at[b]: x for b, x in zip(own.branch_id, given)}
    for n in reversed(order):
        if n in tip:
            up[n] = np.where(np.isnan(tip[n]), 0.0, np.where(values[:, None] == tip[n], 0.0, np.inf))
        for c in children[n]:
            up[n] += np.minimum(up[c], up[c].min(0) + 1)
    total = up.copy()
    for n in order:
        for c in children[n]:
            rest = total[n] - np.minimum(up[c], up[c].min(0) + 1)
            total[c] = up[c] + np.minimum(rest, rest.min(0) + 1)
    out = values[total.argmin(1)]
    return pd.DataFrame({"study_id": edges.study_id.iloc[0], "branch_id": names, "states": list(out)})


def parsimony_arrays(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """``(study_id, branch_id, states)``: as ``parsimony_states``, with a world at every place of the arrays ``states``, so that a tree is read once for all worlds.

    ``tips`` has ``(study_id, branch_id, states)``, arrays of one length within a study; a null leaves a tip open in that world.  Ties go to the least state.
    A study without tips does not come out.
    """
    given = tips.withColumn("states", F.transform("states", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))))
    return spread(edges.select("study_id", "branch_id", "parent_branch"), "study_id").groupBy("study_id").cogroup(given.groupBy("study_id")).applyInPandas(_reconstruct_arrays, _ARRAYS)


def annotate_gene(cells: DataFrame, edges: DataFrame, gene: str | None = None) -> DataFrame:
    """The tree edges of every study with the cells of one gene (all of ``cells`` where none is named), and a label for each edge."""
    own = (cells if gene is None else cells.where(F.col("gene_id") == gene)).select("study_id", "branch_id", "coord_state", "value")
    label = F.when(F.col("coord_state").isNull(), "absent").when(F.col("coord_state") != "observed", F.col("coord_state")).when(F.col("value").isNull(), "no payload").when(F.col("value") == 0, "zero").otherwise("value")
    return edges.select("study_id", "branch_id", "parent_branch").join(own, ["study_id", "branch_id"], "left").withColumn("label", label)
