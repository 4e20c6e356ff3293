"""Strict readers of tab-separated text, matrices in text, and saved objects."""

from __future__ import annotations

import hashlib
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.errors import AxisError, ContractError, DomainError, TamperedError
from cladeframe.operators.cells import from_wide, parse_tokens
from cladeframe.operators.traits import STATES


def sha256_file(path: str) -> str:
    """SHA-256 of a local file, read in parts."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def header(path: str) -> list[str]:
    """The column names in the first line; blank or repeated names are refused."""
    with open(path, encoding="utf-8", newline="") as f:
        names = f.readline().rstrip("\r\n").split("\t")
    if any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise ContractError("header with blank or repeated names")
    return names


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A text table with every column as it stands: no quoting, no null strings, no type is guessed.

    ``001``, ``NA`` and ``TRUE`` stay text, an empty field stays empty.  Lines with another number of fields,
    missing required columns and tables without a row are refused; so is a file that changes while it is read.
    """
    before, names = sha256_file(path), header(path)
    missing = [c for c in required if c not in names]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    lines = spark.read.text(f"file://{os.path.abspath(path)}").select(F.rtrim("value", F.lit("\r")).alias("v"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    rows = lines.where(~((F.col("__b") == 0) & (F.col("__i") == 0))).select(F.split("v", "\t", -1).alias("f"))
    bad = rows.where(F.size("f") != len(names)).limit(1).count()
    if bad:
        raise ContractError("a line has another number of fields than the header")
    if rows.limit(1).count() == 0:
        raise ContractError("a table without a row")
    if sha256_file(path) != before:
        raise TamperedError("the file changed while it was read")
    return rows.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def strict_number(rows: DataFrame, column: str) -> DataFrame:
    """``column`` as DOUBLE; blank, NA, text and non-finite values are refused."""
    x = F.col(column).try_cast("double")
    bad = rows.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).limit(1).count()
    if bad:
        raise DomainError(f"{column} holds a value that is no finite number")
    return rows.withColumn(column, x)


def _unique(rows: DataFrame, column: str) -> None:
    if rows.where(F.coalesce(F.trim(column), F.lit("")) == "").limit(1).count():
        raise AxisError(f"{column} holds a blank")
    if rows.groupBy(column).count().where("count > 1").limit(1).count():
        raise AxisError(f"{column} holds a value twice")


def read_trait(spark: SparkSession, path: str, trait: str, taxon: str = "species") -> DataFrame:
    """``(species, value)`` of a binary trait file: values 0, 0.5 or 1, both classes, unique species."""
    rows = strict_number(read_tsv(spark, path, (taxon, trait)).select(F.col(taxon).alias("species"), F.col(trait).alias("value")), "value")
    _unique(rows, "species")
    seen = {r.value for r in rows.select("value").distinct().limit(4).collect()}
    if not seen <= set(STATES) or not {0.0, 1.0} <= seen:
        raise DomainError("trait values are 0, 0.5 and 1, and both classes must occur")
    return rows


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(species, genus)``: unique species, no blank genus."""
    rows = read_tsv(spark, path, ("species", "genus")).select("species", "genus")
    _unique(rows, "species")
    if rows.where(F.trim("genus") == "").limit(1).count():
        raise DomainError("genus holds a blank")
    return rows


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """``(fold_ord, fold_id, genus, seed)`` in the order of the file: unique fold ids and genera, integer seeds."""
    rows = read_tsv(spark, path, ("fold_id", "genus", "seed")).select((F.monotonically_increasing_id()).alias("fold_ord"), "fold_id", "genus", F.col("seed").try_cast("int").alias("seed"))
    _unique(rows, "fold_id")
    _unique(rows, "genus")
    if rows.where("seed IS NULL").limit(1).count():
        raise DomainError("a seed is no integer")
    return rows


def read_matrix(spark: SparkSession, path: str, study: str, gene: str = "gene") -> DataFrame:
    """A wide matrix file as long cells with ``token_class`` and ``value``; an unknown token is refused."""
    wide = read_tsv(spark, path, (gene,))
    _unique(wide, gene)
    rows = parse_tokens(from_wide(wide, gene, [c for c in wide.columns if c != gene], study))
    if rows.where("token_class = 'unknown'").limit(1).count():
        raise DomainError("a token outside the vocabulary")
    return rows


def keyed_columns(spark: SparkSession, path: str, columns: tuple[str, ...], key: str) -> DataFrame:
    """The declared columns only, as text; the key must be unique."""
    rows = read_tsv(spark, path, columns).select(*columns)
    _unique(rows, key)
    return rows


def extract_members(archive: str, wanted: dict[str, str], folder: str) -> list[str]:
    """Named members of a tar archive to ``folder``, each with the SHA-256 it must have; paths that leave the folder are refused."""
    out = []
    with tarfile.open(archive) as tar:
        for name, digest in wanted.items():
            target = os.path.realpath(os.path.join(folder, name))
            if not target.startswith(os.path.realpath(folder) + os.sep):
                raise ContractError(f"member {name} leaves the folder")
            source = tar.extractfile(name)
            if source is None:
                raise ContractError(f"member {name} is no file")
            data = source.read()
            if hashlib.sha256(data).hexdigest() != digest:
                raise TamperedError(f"member {name} has another hash")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(data)
            out.append(target)
    return out


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
