"""Tables between the steps of a job, in the folder that all executors share.

A table written there cuts lineage and outlives any executor: a lost executor
costs its running tasks, never a finished step.  The folder is the one named by
``spark.checkpoint.dir``; only where that is unset and the session is a local
one (tests, a laptop) a local folder of the process is used.  On a cluster without that setting
the job is refused, since every executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cladeframe.errors import ContractError

_OWN: dict[str, str] = {}
_MADE: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="cladeframe-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return "file://" + _OWN["dir"]


class Workspace:
    """Named Parquet tables of one job below the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self)

    def remove(self) -> None:
        """Delete all tables of the job; results that were not read yet are lost with them."""
        self.drop("")
        _MADE.remove(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def clean_up() -> None:
    """Remove the folders of all jobs of this process; to be called once their results are written or read."""
    for work in list(_MADE):
        work.remove()


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent to every task by way of the driver.

    Spark goes by the size of files, and a table of states of few values takes a byte for several rows there: 15.7 million rows of
    the fourteen variants are 2.2 MB, far below the usual bound of 10 MB, and beyond the driver's memory as rows.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over somewhat more tasks than the session shuffles into, for groups whose work is heavy and whose rows are few.

    Adaptive execution would put such small partitions together into one task; and where the rows lie by
    the same key in as many partitions already, Spark would drop this step, hence one partition more.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) + 1
    return df.repartition(n, *keys)
