"""Queries of problems 1, 2, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm import components, leaks, mixing, names, percentiles, spam
from cladeframe.plans.registry import Registry
from cladeframe.sources.tables import table
from cladeframe.workspace import Workspace

R = Registry()

_PAIRS_SQL = """
  WITH RECURSIVE link AS (
    SELECT study_id, genus, 's' || species AS l FROM taxon_groups WHERE genus IS NOT NULL AND species IS NOT NULL AND study_id IS NOT NULL
    UNION SELECT study_id, genus, 'f' || fold_id FROM folds WHERE genus IS NOT NULL AND fold_id IS NOT NULL AND study_id IS NOT NULL),
  edge AS (SELECT DISTINCT a.study_id, a.genus AS x, b.genus AS y FROM link a JOIN link b ON a.study_id = b.study_id AND a.l = b.l AND a.genus <> b.genus),
  reach AS (SELECT study_id, x, y FROM edge UNION SELECT r.study_id, r.x, e.y FROM reach r JOIN edge e ON r.study_id = e.study_id AND r.y = e.x)
  SELECT study_id, x AS genus_a, y AS genus_b FROM reach WHERE x < y"""


@R.add("p1_found", _PAIRS_SQL)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of genera of a study that must land in the same split."""
    groups, folds = table(spark, folder, "taxon_groups"), table(spark, folder, "folds")
    return components.same_split_pairs(components.genus_components(groups, folds, Workspace(spark, "p1")))


@R.add("p1_rows")
def p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every row of taxon_groups and folds."""
    groups, folds = table(spark, folder, "taxon_groups"), table(spark, folder, "folds")
    return components.split_rows(groups, folds, Workspace(spark, "p1"))


@R.add("p1_shares")
def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached per study and overall."""
    return components.split_shares(p1_rows(spark, folder)).select("level", "study_id", "split", "n", F.col("rows").alias("of_rows"), "share")


_PARTED = ", ".join(f"0::BIGINT AS {name}_parted" for name in ("genera", "species", "folds"))


@R.add("p1_kept_together", f"""SELECT study_id, n_rows, {_PARTED}, true AS train_within_largest FROM (
    SELECT study_id, count(*) AS n_rows FROM (SELECT study_id FROM taxon_groups UNION ALL SELECT study_id FROM folds) GROUP BY 1)""")
def p1_kept_together(spark: SparkSession, folder: str) -> DataFrame:
    """What the splits must hold: every row has one, no genus, species or fold id of a study is parted, and the share of the
    training split is off by no more than the study's heaviest component."""
    groups, folds = table(spark, folder, "taxon_groups"), table(spark, folder, "folds")
    rows = Workspace(spark, "p1").save(components.split_rows(groups, folds, Workspace(spark, "p1")), "rows")
    keyed = rows.join(
        groups.select(F.lit("taxon_groups").alias("table_name"), "row_id", "genus", "species", F.lit(None).cast("string").alias("fold_id")).unionByName(folds.select(F.lit("folds").alias("table_name"), "row_id", "genus", F.lit(None).cast("string").alias("species"), "fold_id")),
        ["table_name", "row_id"])
    out = rows.groupBy("study_id").agg(F.count("split").alias("n_rows"))
    for name, key in (("genera", "genus"), ("species", "species"), ("folds", "fold_id")):
        parted = keyed.where(F.col(key).isNotNull()).groupBy("study_id", key).agg(F.count_distinct("split").alias("n")).groupBy("study_id").agg(F.count_if(F.col("n") > 1).cast("bigint").alias(f"{name}_parted"))
        out = out.join(parted.withColumnRenamed("study_id", f"s_{name}"), F.col("study_id").eqNullSafe(F.col(f"s_{name}")), "left").drop(f"s_{name}")
    own = rows.where("table_name = 'taxon_groups'")
    heavy = own.groupBy("study_id", "component", "split").agg(F.count(F.lit(1)).alias("w")).groupBy(F.col("study_id").alias("s")).agg(F.max("w").alias("most"), F.sum("w").alias("n"), F.sum(F.when(F.col("split") == "train", F.col("w")).otherwise(0)).alias("train"))
    out = out.join(heavy, F.col("study_id").eqNullSafe(F.col("s")), "left").drop("s")
    near = F.coalesce(F.abs(F.col("train") - 0.8 * F.col("n")) <= F.col("most"), F.lit(True))
    return out.select("study_id", "n_rows", *[F.coalesce(f"{n}_parted", F.lit(0)).cast("bigint").alias(f"{n}_parted") for n in ("genera", "species", "folds")], near.alias("train_within_largest"))


def _free(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    reference = table(spark, folder, "taxon_reference")
    rows = [
        table(spark, folder, n).select(F.lit(n).alias("table_name"), F.col("row_id"), F.col("species")) for n in ("trait", "branches")
    ]
    return names.free_entered(rows[0].unionByName(rows[1]), "species", reference), reference


@R.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Free-entered species with the entry that they mean, or -1."""
    rows, reference = _free(spark, folder)
    known = names.map_names(rows, "species", reference)
    return rows.join(known, F.col("species") == F.col("value")).select("table_name", "row_id", "taxon_id")


@R.add("p5_unmatched")
def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with their rows per table."""
    rows, reference = _free(spark, folder)
    none = names.map_names(rows, "species", reference).where(F.col("taxon_id") == names.NONE)
    lost = rows.join(none, F.col("species") == F.col("value"), "left_semi")
    return lost.groupBy("table_name", "species").agg(F.count(F.lit(1)).alias("n_rows"))


_LEAKS_SQL = """
  WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE text IS NOT NULL),
  i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS l FROM eval_items),
  dw AS (SELECT DISTINCT doc_id, array_to_string(l[k:k + 19], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS k FROM w)),
  iw AS (SELECT DISTINCT item_id, array_to_string(l[k:k + 19], ' ') AS s FROM (SELECT item_id, l, unnest(range(1, len(l) - 18)) AS k FROM i))
  SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)"""


@R.add("p6_found", _LEAKS_SQL)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 20 consecutive words of an item."""
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.where(F.col("edits") == 0).select("doc_id", "item_id")


@R.add("p6_near")
def p6_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 20 words of an item, whole or with up to two word edits."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@R.add("p6_items")
def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them exactly and nearly."""
    found = p6_near(spark, folder)
    return found.groupBy("item_id").agg(F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("n_exact"), F.count(F.lit(1)).alias("n_near"))


@R.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that mostly repeat keywords, list links or list tags."""
    return spam.spam_pages(table(spark, folder, "documents"), Workspace(spark, "p8")).select("doc_id")


@R.add("p8_pages")
def p8_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents with their words, words in link lines, words in listed lines and share."""
    return spam.spam_pages(table(spark, folder, "documents"), Workspace(spark, "p8"))


def _p2_sql() -> str:
    def one(grouping: str, keys: tuple[str, ...]) -> str:
        name = lambda k: k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}"
        ps = ", ".join(
            f"v[CAST(floor({p} * (n - 1)) AS BIGINT) + 1] + ({p} * (n - 1) - floor({p} * (n - 1))) * (v[least(CAST(floor({p} * (n - 1)) AS BIGINT) + 2, n)] - v[CAST(floor({p} * (n - 1)) AS BIGINT) + 1]) AS {x}"
            for p, x in zip(map(lambda p: f"CAST({p} AS DOUBLE)", percentiles.PROBABILITIES), percentiles.NAMES)
        )
        return f"""SELECT '{grouping}' AS grouping, {name("gene_id")}, {name("coordinate_id")}, n, CAST(0 AS BIGINT) AS rank_error, {ps}
          FROM (SELECT {", ".join(keys)}, count(*) AS n, list_sort(list(numeric_value)) AS v FROM state_ledger
                WHERE numeric_available AND isfinite(numeric_value) GROUP BY {", ".join(keys)})"""

    return " UNION ALL ".join(one(g, k) for g, k in (("gene", ("gene_id",)), ("coordinate", ("coordinate_id",)), ("pair", ("gene_id", "coordinate_id"))))


@R.add("p2_percentiles", _p2_sql())
def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and outer percentiles per gene, per coordinate and per pair."""
    values = percentiles.finite_values(table(spark, folder, "state_ledger"))
    return percentiles.percentiles(percentiles.summarise(values), Workspace(spark, "p2"))


@R.add("p2_multi_select", _p2_sql())
def p2_multi_select(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with every group and rank found by multi-select to the end: none is finished by sorting."""
    values = percentiles.finite_values(table(spark, folder, "state_ledger"))
    return percentiles.percentiles(percentiles.summarise(values), Workspace(spark, "p2"), direct=0)


@R.add("p2_day_summaries", """
  SELECT gene_id, coordinate_id, run_day, count(*) AS n, min(numeric_value) AS least, max(numeric_value) AS most
  FROM state_ledger WHERE numeric_available AND isfinite(numeric_value) GROUP BY 1, 2, 3""")
def p2_day_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The daily summaries from which the percentiles come: rows, least and greatest value of each pair and day."""
    return percentiles.day_summaries(percentiles.summarise(percentiles.finite_values(table(spark, folder, "state_ledger"))))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    work, targets = Workspace(spark, "p7"), table(spark, folder, "mix_targets")
    spec = mixing.MixSpec(vocabulary=spark.conf.get("spark.cladeframe.vocabulary", mixing.DEFAULT))
    counts = work.save(mixing.token_counts(table(spark, folder, "documents"), targets, spec), "counts")
    return *mixing.mix(counts, targets, work, spec), targets


@R.add("p7_records")
def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the mixture and how often each is used."""
    return _mixed(spark, folder)[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached beside the targets."""
    return mixing.shares(*_mixed(spark, folder))


@R.add("p7_limits", """WITH have AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND source IS NOT NULL GROUP BY 1),
  t AS (SELECT m.*, n, target_share / (SELECT sum(target_share) FROM mix_targets JOIN have USING (source)) AS goal FROM mix_targets m JOIN have USING (source))
  SELECT source, true AS within_repeats, true AS own_records, true AS share_reached FROM t""")
def p7_limits(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixture must hold for every target with documents: no record beyond its repeats, records of the source only, the share within 0.01 of its part."""
    used, quotas, targets = _mixed(spark, folder)
    used = Workspace(spark, "p7").save(used, "used")
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("__own"))
    checked = used.join(docs, "doc_id").join(targets.select("source", "max_repeats", "target_share"), "source")
    a = checked.groupBy("source").agg(F.every(F.col("uses").between(1, F.col("max_repeats"))).alias("within_repeats"), F.every(F.col("__own") == F.col("source")).alias("own_records"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.first("target_share").alias("share"))
    whole = W.partitionBy()  # over one row per target
    reached = F.abs(F.col("tokens") / F.sum("tokens").over(whole) - F.col("share") / F.sum("share").over(whole)) < 0.01
    return a.select("source", "within_repeats", "own_records", reached.alias("share_reached"))
