"""Queries of sources, saved runs and streams."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from cladeframe.plans.matrix import digits, matrix
from cladeframe.plans.registry import Registry
from cladeframe.plans.sql import sig
from cladeframe.sources.tables import table
from cladeframe.streaming import statistics
from cladeframe.workspace import Workspace

R = Registry()

_STATS = f"""SELECT study_id, gene_id, count(*) AS n, {sig("sum(numeric_value)", 6)} AS s, min(numeric_value) AS least, max(numeric_value) AS most FROM state_ledger WHERE numeric_available AND isfinite(numeric_value) GROUP BY 1, 2"""


@R.add("s01_stream_statistics", _STATS)
def s01_stream_statistics(spark, folder):
    """Group statistics kept up by a stream over the ledger's files."""
    ledger, work = table(spark, folder, "state_ledger"), Workspace(spark, "stream")
    path = f"{folder}/state_ledger.parquet"
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 8).parquet(path if os.path.isdir(path) else _folder_of(path))
    statistics.keep_statistics(stream, f"{work.base}/statistics", f"{work.base}/checkpoint").awaitTermination()
    return statistics.read_statistics(spark, f"{work.base}/statistics").select("study_id", "gene_id", "n", digits("s", 6).alias("s"), "least", "most")


def _folder_of(path: str) -> str:
    """A folder that holds just this file, since a stream reads folders."""
    folder = tempfile.mkdtemp(prefix="cladeframe-stream-")
    os.symlink(path, os.path.join(folder, os.path.basename(path)))
    return folder


@R.add("s02_batch_statistics", _STATS)
def s02_batch_statistics(spark, folder):
    return statistics.partial_statistics(table(spark, folder, "state_ledger")).select("study_id", "gene_id", "n", digits("s", 6).alias("s"), "least", "most")


@R.add("a20_object_roundtrip", """SELECT count(*) AS n_before, count(*) AS n_after, 0::BIGINT AS n_off, true AS refused_twice FROM (SELECT DISTINCT study_id, gene_id, coordinate_id FROM state_ledger WHERE study_id IS NOT NULL AND gene_id IS NOT NULL AND coordinate_id IS NOT NULL)""")
def a20_object_roundtrip(spark, folder):
    """Cells written as an object and read back: counts on both sides, rows that only one side has, and that a second write is refused."""
    from pyspark.errors import AnalysisException

    from cladeframe.operators.reporting import same_cells
    from cladeframe.sources.runs import read_object, write_object

    m, path = matrix(spark, folder), f"{Workspace(spark, 'object').base}/cells"
    write_object(m, path)
    back = read_object(spark, path)
    try:
        write_object(m.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    rows = [count(m, "n"), count(back, "n"), count(same_cells(m, back, m.columns), "n")]
    every = rows[0].withColumn("k", F.lit(0)).unionByName(rows[1].withColumn("k", F.lit(1))).unionByName(rows[2].withColumn("k", F.lit(2)))
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col("n"))).alias(name)
    return every.agg(at(0, "n_before"), at(1, "n_after"), at(2, "n_off"), F.lit(refused).alias("refused_twice"))
