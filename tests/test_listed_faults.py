"""Cases that once gave wrong answers: each states what is right."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankloom.operators import contracts as K
from rankloom.operators import decisions as D
from rankloom.operators import leakage as L
from rankloom.operators import models as M
from rankloom.sources import tables as S
from rankloom.sources import texts as X


def test_criterion_of_several_rows_is_an_error(spark):
    rows = spark.createDataFrame([(0.5, None, 0.9, 4, 2), (None, 0.4, 0.9, 4, 2)], "estimate double, ci_low double, ci_high double, n_rows long, n_clusters long")
    with pytest.raises(PySparkException, match="one estimate expected"):
        D.criterion(rows, "c", 0.02).collect()
    assert D.criterion(rows.where("ci_low IS NULL"), "c", 0.02).first()["status"] == "FAIL"


def test_mark_inside_a_fasta_header(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one some>thing\nMK\nTA\n>db|v1|two/3-9\r\nac d\r\n>three\n")
    got = {r["id"]: r["sequence"] for r in X.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"one": "MKTA", "two": "ACD", "three": ""}


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.range(3), path)
    S.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(PySparkException):
        S.write_table(spark.range(9).selectExpr("raise_error('no') AS id"), path)
    assert spark.read.parquet(path).count() == 5
    S.write_table(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(K.ContractError):
        S.write_table(spark.range(1), path, "xls")


def test_exact_relations_fold_case_and_name_one_row(spark):
    train = spark.createDataFrame([("a", "1ABC", "A"), ("b", "2xyz", "B"), ("c", " ", "B")], "domain_id string, pdb_id string, chain string")
    bench = spark.createDataFrame([(9, "1abc", "A"), (4, "1aBc", "A"), (5, "2xyz", "b"), (6, " ", "B")], "benchmark_id int, pdb_id string, chain string")
    rel = L.leakage_relations(train, bench, train_id="domain_id", bench_id="benchmark_id", exact=[("exact_id", ["pdb_id", "chain"])], caseless=["pdb_id"])
    assert [(r.domain_id, r.benchmark_id, r.reason) for r in rel.collect()] == [("a", "4", "exact_id")]


def test_state_key_format(spark):
    r = spark.range(1).selectExpr("'d1' AS e", "'random_mask' AS k", "0.15D AS level", "7 AS rep").select(K.state_id("e", "k", "level", "rep").alias("s")).first()
    assert r["s"] == "d1:random_mask:c150:r007"


def test_controls_train_on_all_other_folds(spark):
    rows = [(g, i, [float(i % 5), float(i % 3)], [float(i % 7)]) for i, g in enumerate("aabbccddee" * 4)]
    df = spark.createDataFrame(rows, "g string, id int, x array<double>, y array<double>")
    out = M.cross_fit(df, "g", "x", "y", 2, 1, 5, 1.0, key=["id"], repeats=2, numeric=F.col("id"), seed=1)
    counts = {(r["control"], r["repeat"]): r["count"] for r in out.groupBy("control", "repeat").count().collect()}
    assert counts == {("observed", 0): 40, ("shuffled", 1): 40, ("shuffled", 2): 40} and out.where("prediction IS NULL").count() == 0
