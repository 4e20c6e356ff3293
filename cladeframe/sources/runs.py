"""Saved objects and run folders: atomic writes, stages, status, hash inventory, reopening, reports.

A run folder is written by the driver on a file system it can see; its tables are Parquet.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.errors import ContractError, StaleError, TamperedError
from cladeframe.sources.text import sha256_file

CONFIG_SECTIONS = ("study", "inputs", "baseline", "screen", "validation")


def write_object(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table at ``path``; an existing one is kept unless ``overwrite`` is said."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_object(spark: SparkSession, path: str, validate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return validate(df) if validate else df


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text without quotes, nulls as ``NA``, one file per partition; a value with a tab or line end is refused."""
    text = [c for c, t in df.dtypes if t == "string"]
    if text:
        bad = F.lit(False)
        for c in text:
            bad = bad | F.coalesce(F.col(c).rlike("[\t\r\n]"), F.lit(False))
        if df.where(bad).limit(1).count():
            raise ContractError("a value holds a tab or a line end")
    df.write.mode("errorifexists").option("sep", "\t").option("header", "true").option("nullValue", "NA").option("emptyValue", "").option("quote", "").csv(path)


def write_json(value: object, path: str) -> None:
    """JSON by a temporary file in the same folder and a rename."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)
    os.replace(temporary, path)


def read_config(path: str) -> dict:
    """A configuration; unknown or missing sections are refused."""
    with open(path) as f:
        config = json.load(f)
    odd, missing = set(config) - set(CONFIG_SECTIONS), set(CONFIG_SECTIONS) - set(config)
    if odd or missing:
        raise ContractError(f"configuration: unknown {sorted(odd)}, missing {sorted(missing)}")
    return config


class Run:
    """A run folder: ``stage`` computes and saves tables in order; a failure leaves the status FAILED with the stage, and what was saved."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None):
        if os.path.exists(folder):
            raise ContractError("the run folder exists")
        os.makedirs(folder)
        self.spark, self.folder, self.stages = spark, folder, []
        write_json(config or {}, os.path.join(folder, "config.json"))
        self._status("running", None)

    def _status(self, status: str, stage: str | None, error: str | None = None) -> None:
        write_json({"status": status, "stage": stage, "error": error, "stages": self.stages, "at": time.time()}, os.path.join(self.folder, "status.json"))

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        try:
            build().write.mode("errorifexists").parquet("file://" + os.path.join(os.path.abspath(self.folder), "tables", name))
        except Exception as error:
            self._status("FAILED", name, str(error)[:2000])
            raise
        self.stages.append(name)
        self._status("running", name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet("file://" + os.path.join(os.path.abspath(self.folder), "tables", name))

    def finish(self) -> None:
        """Status completed, and the inventory of hashes of all files."""
        self._status("completed", None)
        write_json(_inventory(self.folder), os.path.join(self.folder, "SHA256SUMS.json"))


def _inventory(folder: str) -> dict[str, str]:
    out = {}
    for root, _, files in os.walk(folder):
        for f in files:
            path = os.path.join(root, f)
            if f != "SHA256SUMS.json" and not f.endswith(".crc"):
                out[os.path.relpath(path, folder)] = sha256_file(path)
    return out


def reopen(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a completed run; a file that is missing, new or changed is refused."""
    with open(os.path.join(folder, "status.json")) as f:
        status = json.load(f)
    if status["status"] != "completed":
        raise ContractError(f"the run is {status['status']}")
    if verify:
        with open(os.path.join(folder, "SHA256SUMS.json")) as f:
            kept = json.load(f)
        if kept != _inventory(folder):
            raise TamperedError("files differ from the inventory")
    return {n: spark.read.parquet("file://" + os.path.join(os.path.abspath(folder), "tables", n)) for n in status["stages"]}


def content_hash(df: DataFrame, labels: tuple[str, ...] = ()) -> str:
    """A hash of the rows as a set with repeats, whatever their order or partitioning; display ``labels`` do not count."""
    columns = sorted(c for c in df.columns if c not in labels)
    a, b = (F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns], F.lit(s)).cast("decimal(38,0)") for s in (1, 2))
    r = df.agg(F.sum(a), F.sum(b), F.count(F.lit(1))).first()
    return f"{','.join(columns)}|{r[0]}|{r[1]}|{r[2]}"


def dependency_status(stored: dict[str, str], current: dict[str, str]) -> tuple[str, list[str]]:
    """CURRENT, or STALE_RECOMPUTE_REQUIRED with what differs, of the hashes a result was made from."""
    off = sorted(k for k in {*stored, *current} if stored.get(k) != current.get(k))
    return ("STALE_RECOMPUTE_REQUIRED" if off else "CURRENT"), off


def require_current(stored: dict[str, str], current: dict[str, str]) -> None:
    status, off = dependency_status(stored, current)
    if off:
        raise StaleError(f"{status}: {', '.join(off)}")


def report(tables: dict[str, DataFrame], folder: str, run_folder: str) -> str:
    """A Markdown summary of saved tables (rows and columns of each) outside the run folder; nothing is fitted again."""
    if os.path.realpath(folder).startswith(os.path.realpath(run_folder)):
        raise ContractError("a report does not go into the run folder")
    os.makedirs(folder, exist_ok=True)
    lines = ["# Run report", "", "| table | rows | columns |", "|---|---|---|"]
    lines += [f"| {n} | {d.count()} | {', '.join(d.columns)} |" for n, d in sorted(tables.items())]
    path = os.path.join(folder, "report.md")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path
