"""Text readers, run folders and streams."""

import hashlib
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from cladeframe.errors import AxisError, ContractError, DomainError, StaleError, TamperedError
from cladeframe.functions.text import percent, six_significant
from cladeframe.sources import runs, text
from cladeframe.streaming import statistics


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_read_tsv(spark, tmp_path):
    p = put(tmp_path / "a.tsv", 'id\tx\n001\tNA\nTRUE\t"q"\r\n\t\n')
    assert [tuple(r) for r in text.read_tsv(spark, p, ("id",)).collect()] == [("001", "NA"), ("TRUE", '"q"'), ("", "")]
    for bad in ("id\tid\n1\t2\n", "id\tx\n1\n", "id\tx\n"):
        with pytest.raises(ContractError):
            text.read_tsv(spark, put(tmp_path / "b.tsv", bad))
    with pytest.raises(ContractError):
        text.read_tsv(spark, p, ("missing",))


def test_read_trait_groups_folds(spark, tmp_path):
    t = put(tmp_path / "t.tsv", "species\tbin\na\t0\nb\t1\nc\t0.5\n")
    assert {r.species: r.value for r in text.read_trait(spark, t, "bin").collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}
    with pytest.raises(DomainError):
        text.read_trait(spark, put(tmp_path / "u.tsv", "species\tbin\na\t0\nb\t0\n"), "bin")
    with pytest.raises(AxisError):
        text.read_trait(spark, put(tmp_path / "v.tsv", "species\tbin\na\t0\na\t1\n"), "bin")
    with pytest.raises(DomainError):
        text.read_trait(spark, put(tmp_path / "w.tsv", "species\tbin\na\tNA\nb\t1\n"), "bin")
    f = put(tmp_path / "f.tsv", "fold_id\tgenus\tseed\nf2\tB\t7\nf1\tA\t9\n")
    assert [r.fold_id for r in text.read_folds(spark, f).orderBy("fold_ord").collect()] == ["f2", "f1"]
    with pytest.raises(DomainError):
        text.read_groups(spark, put(tmp_path / "g.tsv", "species\tgenus\na\t \n"))


def test_read_matrix(spark, tmp_path):
    rows = text.read_matrix(spark, put(tmp_path / "m.tsv", "gene\tB1\tB2\ng\t0\tNA_fuse\nh\t2.5\tNaN\n"), "s").collect()
    assert {(r.gene_id, r.branch_id): (r.token_class, r.value) for r in rows} == {("g", "B1"): ("finite_numeric", 0.0), ("g", "B2"): ("NA_fuse", None), ("h", "B1"): ("finite_numeric", 2.5), ("h", "B2"): ("NaN", None)}
    with pytest.raises(DomainError):
        text.read_matrix(spark, put(tmp_path / "n.tsv", "gene\tB1\ng\tx\n"), "s")


def test_archive(tmp_path):
    put(tmp_path / "x.txt", "hello")
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.add(tmp_path / "x.txt", "in/x.txt")
        tar.add(tmp_path / "x.txt", "../y.txt")
    digest = hashlib.sha256(b"hello").hexdigest()
    out = text.extract_members(str(tmp_path / "a.tar"), {"in/x.txt": digest}, str(tmp_path / "o"))
    assert open(out[0]).read() == "hello"
    with pytest.raises(ContractError):
        text.extract_members(str(tmp_path / "a.tar"), {"../y.txt": digest}, str(tmp_path / "o"))
    with pytest.raises(TamperedError):
        text.extract_members(str(tmp_path / "a.tar"), {"in/x.txt": "0" * 64}, str(tmp_path / "o"))


def test_run_folder(spark, tmp_path):
    folder = str(tmp_path / "run")
    run = runs.Run(spark, folder, {"a": 1})
    run.stage("one", lambda: spark.range(3))
    run.finish()
    tables = runs.reopen(spark, folder)
    assert tables["one"].count() == 3
    assert "| one | 3 | id |" in open(runs.report(tables, str(tmp_path / "report"), folder)).read()
    with pytest.raises(ContractError):
        runs.report(tables, os.path.join(folder, "r"), folder)
    put(tmp_path / "run" / "config.json", "{}")
    with pytest.raises(TamperedError):
        runs.reopen(spark, folder)
    failed = runs.Run(spark, str(tmp_path / "bad"))
    failed.stage("good", lambda: spark.range(1))
    with pytest.raises(Exception):
        failed.stage("boom", lambda: spark.range(1).select(F.raise_error(F.lit("no"))))
    status = json.load(open(tmp_path / "bad" / "status.json"))
    assert (status["status"], status["stage"], status["stages"]) == ("FAILED", "boom", ["good"])
    with pytest.raises(ContractError):
        runs.reopen(spark, str(tmp_path / "bad"))


def test_hashes_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k int, v string, label string")
    assert runs.content_hash(df, ("label",)) == runs.content_hash(df.orderBy(F.desc("k")).withColumn("label", F.lit("z")), ("label",))
    assert runs.content_hash(df) != runs.content_hash(df.unionAll(df))
    assert runs.dependency_status({"a": "1"}, {"a": "1"})[0] == "CURRENT"
    with pytest.raises(StaleError):
        runs.require_current({"a": "1"}, {"a": "2"})
    runs.write_tsv(df.coalesce(1), f"file://{tmp_path}/t")
    body = "".join(open(tmp_path / "t" / f).read() for f in os.listdir(tmp_path / "t") if f.startswith("part"))
    assert body == "k\tv\tlabel\n1\ta\tx\n2\tNA\ty\n"
    with pytest.raises(ContractError):
        runs.write_tsv(df.withColumn("v", F.lit("a\tb")), f"file://{tmp_path}/u")


def test_stream_statistics(spark, tmp_path):
    schema = "study_id string, gene_id string, numeric_value double, numeric_available boolean"
    rows = [("s", "g", float(i), i % 5 > 0) for i in range(40)] + [("s", "h", None, True), ("s", "h", float("nan"), True)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    statistics.keep_statistics(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    got = statistics.read_statistics(spark, f"file://{tmp_path}/out").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in statistics.partial_statistics(df).collect()]


def test_formats(spark):
    r = spark.createDataFrame([(0.125, 1234567.0), (0.5, 0.000012345678), (1.0, 3.14159265), (0.0, 100.0)], "p double, x double")
    assert [x.a for x in r.select(percent(F.col("p")).alias("a")).collect()] == ["12.5%", "50.0%", "100.0%", "0.0%"]
    assert [x.a for x in r.select(six_significant(F.col("x")).alias("a")).collect()] == ["1.23457e+06", "1.23457e-05", "3.14159", "100"]
