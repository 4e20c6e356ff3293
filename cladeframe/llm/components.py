"""Connected components by random-mate contraction, and splits that keep components whole.

Each round every vertex tosses a coin (a seeded hash of the vertex and the
round).  A vertex that shows tails and has a neighbour that shows heads is
collapsed into one such neighbour; the edges are renamed, loops and repeats
fall away.  A quarter or more of the vertices that still have edges is expected to vanish
per round, whatever the shape of the graph, so a hub or a component that holds
a third of all rows needs no more rounds than a path.  When no edge is left the
collapses are unwound by jumping along them.  All steps are SQL
joins; each round's tables are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.workspace import Workspace

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _coin(vertex: Column, seed: int) -> Column:
    """True for heads."""
    return F.xxhash64(vertex, F.lit(seed)) % 2 == 0


def contract(edges: DataFrame, work: Workspace, seed: int = 17, most_rounds: int = 500) -> DataFrame:
    """``(vertex, component)`` of every vertex of ``edges(a, b)``; the component is named by one of its vertices.

    Null ends, loops and repeated edges are dropped; a vertex only in loops
    does not come out.  No edges give no rows.
    """
    spark = work.spark
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    live = work.save(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    rounds: list[DataFrame] = []
    for k in range(most_rounds):
        if live.isEmpty():
            break
        s = seed * 1000 + k
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = (
            both.where(~_coin(F.col("a"), s) & _coin(F.col("b"), s))
            .groupBy(F.col("a").alias("vertex"))
            .agg(F.min_by("b", F.xxhash64("b", F.lit(s + 1))).alias("parent"))
        )
        moves = work.save(moves, f"moves-{k}")
        rounds.append(moves)
        ma, mb = (moves.select(F.col("vertex").alias(v), F.col("parent").alias(p)) for v, p in (("va", "pa"), ("vb", "pb")))
        moved = live.join(ma, F.col("a") == F.col("va"), "left").join(mb, F.col("b") == F.col("vb"), "left")
        moved = moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where(F.col("a") != F.col("b"))
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = work.save(moved, f"edges-{k + 1}")
        work.drop(f"edges-{k}")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    return _unwind(spark, rounds, work)


def _unwind(spark: SparkSession, rounds: list[DataFrame], work: Workspace) -> DataFrame:
    """Labels of all vertices by pointer jumping over the rounds' moves.

    A vertex moved at most once, to one that lived on; so the moves are a forest
    as deep as there are rounds at most, and every jump halves what is left:
    log2(rounds) joins of one small plan each, written to the shared folder.
    """
    if not rounds:
        return spark.createDataFrame([], "vertex string, component string")
    known = work.save(reduce(DataFrame.unionByName, rounds).withColumnRenamed("parent", "component"), "labels-0")
    step = 1
    while step < len(rounds):
        up = known.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
        known = work.save(known.join(up, F.col("component") == F.col("v"), "left").select("vertex", F.coalesce("c", "component").alias("component")), f"labels-{step}")
        work.drop(f"labels-{step // 2}")
        step *= 2
    roots = known.select(F.col("component").alias("vertex"), "component").distinct()
    return work.save(known.unionByName(roots), "labels")


def _key(kind: str, *columns: str) -> Column:
    """An exact, collision-free text of a vertex: kind, then each part with its length."""
    parts = [F.concat(F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c)) for c in columns]
    return F.concat(F.lit(kind), *parts)


def genus_edges(groups: DataFrame, folds: DataFrame) -> DataFrame:
    """Edges between genera and what links them: species in ``groups``, fold ids in ``folds``, each within a study.

    Every linking value becomes a star around its least genus, so a value with
    n genera gives n - 1 edges between genera and none is a pair of all.
    Vertices with a null part give no edge.
    """
    pairs = []
    for rows, link in ((groups, "species"), (folds, "fold_id")):
        seen = rows.where(F.col("study_id").isNotNull() & F.col("genus").isNotNull() & F.col(link).isNotNull())
        seen = seen.select("study_id", F.col(link).alias("link"), "genus").distinct()
        hub = seen.groupBy("study_id", "link").agg(F.min("genus").alias("hub"))
        star = seen.join(hub, ["study_id", "link"]).where(F.col("genus") != F.col("hub"))
        pairs.append(star.select(_key("g", "study_id", "genus").alias("a"), _key("g", "study_id", "hub").alias("b")))
    return pairs[0].unionByName(pairs[1])


def genus_components(groups: DataFrame, folds: DataFrame, work: Workspace) -> DataFrame:
    """``(study_id, genus, component)`` of every distinct genus of a study; an unlinked genus is its own component."""
    labels = contract(genus_edges(groups, folds), work)
    genera = groups.select("study_id", "genus").unionByName(folds.select("study_id", "genus"))
    genera = genera.where(F.col("study_id").isNotNull() & F.col("genus").isNotNull()).distinct().withColumn("vertex", _key("g", "study_id", "genus"))
    return genera.join(labels, "vertex", "left").select("study_id", "genus", F.coalesce("component", "vertex").alias("component"))


def same_split_pairs(components: DataFrame) -> DataFrame:
    """All pairs of genera of a study in one component, the smaller (in byte order) first."""
    a, b = components.alias("a"), components.alias("b")
    on = (F.col("a.component") == F.col("b.component")) & (F.col("a.study_id") == F.col("b.study_id")) & (F.col("a.genus") < F.col("b.genus"))
    return a.join(b, on).select(F.col("a.study_id").alias("study_id"), F.col("a.genus").alias("genus_a"), F.col("b.genus").alias("genus_b"))


def row_components(groups: DataFrame, folds: DataFrame, components: DataFrame) -> DataFrame:
    """``(table_name, row_id, study_id, component)`` of every row of both tables.

    A row belongs to its genus; without one, to the genera of its species (or
    fold); a value that never occurs with a genus is a component of its own, and
    a row with neither is alone.  Rows without a study are alone.
    """
    out = []
    for name, rows, link in (("taxon_groups", groups, "species"), ("folds", folds, "fold_id")):
        rows = rows.select("row_id", "study_id", "genus", F.col(link).alias("link"))
        of_link = rows.where(F.col("genus").isNotNull() & F.col("link").isNotNull()).groupBy("study_id", "link").agg(F.min("genus").alias("hub"))
        named = rows.where(F.col("genus").isNotNull()).withColumn("by", F.col("genus"))
        other = rows.where(F.col("genus").isNull()).join(of_link, ["study_id", "link"], "left").withColumn("by", F.col("hub")).drop("hub")
        every = named.unionByName(other.select(named.columns))
        comp = components.select("study_id", F.col("genus").alias("by"), "component")
        alone = F.when(
            F.col("link").isNotNull() & F.col("study_id").isNotNull(), _key(f"l:{name}:", "study_id", "link")
        ).otherwise(F.concat(F.lit(f"r:{name}:"), F.col("row_id").cast("string")))
        every = every.join(comp, ["study_id", "by"], "left")
        out.append(every.select(F.lit(name).alias("table_name"), "row_id", "study_id", F.coalesce("component", alone).alias("component")))
    return reduce(DataFrame.unionByName, out)


def assign_splits(members: DataFrame, weight: Column, splits: tuple[tuple[str, float], ...] = SPLITS, seed: int = 17, slots: int = 64) -> DataFrame:
    """``(study_id, component, weight, split)``: components of a study go to splits by cumulative weight.

    Heavy components come first (by power of two), then seeded order.  A
    component goes to the split in which the middle of its weight falls.  The
    cumulative sum has two levels, at most ``64 * slots`` slots per study and
    the components inside one slot, so no task holds a whole study.
    """
    from pyspark.sql import Window as W

    size = members.groupBy("study_id", "component").agg(F.sum(weight).cast("bigint").alias("weight"))
    level = F.lit(64) - F.floor(F.log2(F.greatest(F.col("weight"), F.lit(1)).cast("double"))).cast("int")
    size = size.withColumn("hash", F.xxhash64("component", F.lit(seed)))
    size = size.withColumn("slot", level * slots + F.pmod(F.col("hash"), F.lit(slots)).cast("int"))
    per_slot = size.groupBy("study_id", "slot").agg(F.sum("weight").alias("w"))
    over = W.partitionBy("study_id").orderBy("slot")
    per_slot = per_slot.select(
        F.col("study_id").alias("s"), F.col("slot").alias("t"), (F.sum("w").over(over) - F.col("w")).alias("before"),
        F.sum("w").over(W.partitionBy("study_id")).alias("total"),
    )
    inside = W.partitionBy("study_id", "slot").orderBy("hash", "component")
    placed = size.withColumn("here", F.sum("weight").over(inside) - F.col("weight"))
    placed = placed.join(per_slot, F.col("study_id").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t")))
    middle = (F.col("before") + F.col("here") + F.col("weight") / 2) / F.greatest(F.col("total"), F.lit(1))
    choice, edge = F.lit(None).cast("string"), 0.0
    bounds = []
    for name, share in splits:
        edge += share
        bounds.append((name, edge))
    choice = F.lit(bounds[-1][0])
    for name, edge in reversed(bounds[:-1]):
        choice = F.when(middle < edge, name).otherwise(choice)
    return placed.select("study_id", "component", "weight", choice.alias("split"))


def split_rows(groups: DataFrame, folds: DataFrame, work: Workspace, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """``(table_name, row_id, study_id, split)`` of all rows of both tables; proportions count rows of ``groups``, folds follow."""
    members = work.save(row_components(groups, folds, genus_components(groups, folds, work)), "members")
    placed = assign_splits(members, F.when(F.col("table_name") == "taxon_groups", 1).otherwise(0), splits)
    placed = placed.select(F.col("study_id").alias("s"), F.col("component").alias("c"), "split")
    on = F.col("study_id").eqNullSafe(F.col("s")) & (F.col("component") == F.col("c"))
    return members.join(placed, on).select("table_name", "row_id", "study_id", "component", "split")


def split_shares(rows: DataFrame) -> DataFrame:
    """Shares reached per study and overall (null study): rows of ``taxon_groups`` per split."""
    own = rows.where(F.col("table_name") == "taxon_groups")
    n = own.groupBy("study_id", "split").agg(F.count(F.lit(1)).alias("n"))
    both = n.select(F.lit("study").alias("level"), "study_id", "split", "n").unionByName(
        n.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("study_id"), "split", "n")
    )
    total = both.groupBy(F.col("level").alias("l"), F.col("study_id").alias("s")).agg(F.sum("n").alias("rows"))
    on = (F.col("level") == F.col("l")) & F.col("study_id").eqNullSafe(F.col("s"))
    return both.join(total, on).select("level", "study_id", "split", "n", "rows", (F.col("n") / F.col("rows")).alias("share"))
