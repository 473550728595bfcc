import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import aggregates as A
from rankloom.operators import inference as I
from rankloom.operators import resampling as R


def test_equal_cluster_mean_case(spark):
    df = spark.createDataFrame([("large", 1.0)] * 100 + [("small", 3.0), ("small", float("nan"))], "c string, v double")
    r = I.cluster_bootstrap(df, [], "v", "c", 200).first()
    assert r["estimate"] == 2.0 and r["n_clusters"] == 2 and r["n_rows"] == 101
    assert r["ci_low"] == 1.0 and r["ci_high"] == 3.0


def test_single_cluster_has_no_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c string, v double")
    assert I.cluster_bootstrap(df, [], "v", "c", 50).first()["ci_low"] is None
    one = I.stratified_bootstrap(df.selectExpr("c", "v", "'s' AS st"), [], "v", "c", "st", 50).first()
    assert one["ci_low"] == 1.5 and one["loo_min"] is None


def test_stratified_estimate(spark):
    df = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 3.0), ("c", "t", 0.0)], "c string, st string, v double")
    r = I.stratified_bootstrap(df, [], "v", "c", "st", 100).first()
    assert np.isclose(r["estimate"], 4 / 3) and (r["positive_clusters"], r["zero_clusters"]) == (2, 1)
    assert np.isclose(r["loo_min"], 0.5) and np.isclose(r["loo_max"], 2.0)


def test_bootstrap_spread_is_right(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame({"c": range(40), "v": v}))
    r = I.cluster_bootstrap(df, [], "v", "c", 4000, 0.68, 5).first()
    half = (r["ci_high"] - r["ci_low"]) / 2
    assert abs(half / (v.std() / np.sqrt(40)) - 1) < 0.1


def test_wild_cluster_matches_formula(spark):
    v = np.array([0.1, -0.2, 0.5, 0.3, 0.0])
    r = I.wild_cluster(spark.createDataFrame(pd.DataFrame({"c": range(5), "v": v})), [], "v", "c", 100).first()
    loo = np.array([np.delete(v, i).mean() for i in range(5)])
    assert np.isclose(r["jackknife_se"], np.sqrt(4 / 5 * ((loo - loo.mean()) ** 2).sum()))
    assert np.isclose(r["loo_min"], loo.min()) and (r["positive_clusters"], r["negative_clusters"], r["zero_clusters"]) == (3, 1, 1)


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"c": rng.integers(0, 30, 500), "st": rng.integers(0, 3, 500), "v": rng.normal(size=500).round(3)}))
    df = df.withColumn("st", df.c % 3)
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(I.stratified_bootstrap(df.repartition(int(n)), [], "v", "c", "st", 100, rows_per_split=7).first().asDict())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0].keys() == out[1].keys()
    for k in out[0]:
        assert np.isclose(out[0][k], out[1][k]), k


def test_group_bootstrap_case(spark):
    rows = [("e", p, float(p * 3 + j), float(-(p * 3 + j)), float(p * 3 + j)) for p in range(4) for j in range(3)]
    df = spark.createDataFrame(rows, "e string, p int, rank double, reverse double, y double")
    f = lambda: I.group_bootstrap_diff(df, ["e"], "p", "rank", "reverse", "y", 20).first()
    a, b = f(), f()
    assert np.isclose(a["estimate"], 2.0) and a["n_clusters"] == 4 and a == b


def test_weighted_spearman_equals_repeated_rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": 0, "x": rng.integers(0, 5, 30).astype(float), "y": rng.integers(0, 6, 30).astype(float), "w": rng.integers(1, 5, 30)})
    got = I.weighted_spearman(spark.createDataFrame(pdf), ["g"], "x", "y", "w").first()
    full = pdf.loc[pdf.index.repeat(pdf["w"])]
    assert np.isclose(got["stat"], np.corrcoef(full["x"].rank(), full["y"].rank())[0, 1]) and got["n_rows"] == len(full)


def test_shapley_values_sum_to_gain(spark):
    rng = np.random.default_rng(5)
    value = rng.normal(size=8)
    df = spark.createDataFrame([(m, float(value[m])) for m in range(8)], "mask int, value double")
    got = {r["scorer"]: r["shapley"] for r in A.shapley(df, ["a", "b", "c"]).collect()}
    assert np.isclose(sum(got.values()), value[7] - value[0])
    want = sum(w * (value[m | 1] - value[m]) for m, w in ((0, 1 / 3), (2, 1 / 6), (4, 1 / 6), (6, 1 / 3)))
    assert np.isclose(got["a"], want)


@pytest.mark.parametrize("lo,want", [(0.05, 0.3), (-0.1, 0.0)])
def test_radius_takes_largest_passing_level(spark, lo, want):
    rows = [("r", "x", "e", 0.05, 0.1, lo), ("r", "x", "e", 0.15, 0.0, lo), ("r", "x", "e", 0.3, 0.1, lo)]
    df = spark.createDataFrame(rows, "a string, axis string, env string, level double, estimate double, ci_low double")
    assert A.valid_radius(df, ["a", "axis", "env"]).first()["valid_radius"] == want


@pytest.mark.parametrize("strata", [False, True])
def test_array_replicates_equal_row_replicates(spark, strata):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, 400), "c": rng.integers(0, 25, 400), "v": rng.normal(size=400).round(3)}))
    df = df.selectExpr("IF(g = 2, NULL, g) AS g", "c", "c % 3 AS st", "v")
    whole = (lambda **k: I.stratified_bootstrap(df, ["g"], "v", "c", "st", 60, 0.9, 3, **k)) if strata else (lambda **k: I.cluster_bootstrap(df, ["g"], "v", "c", 60, 0.9, 3, **k))
    for f in (whole, lambda **k: I.wild_cluster(df, ["g"], "v", "c", 60, 0.9, 3, **k)):
        a, b = (f(**k).toPandas().sort_values("g").reset_index(drop=True) for k in ({}, {"rows_per_split": 2}))
        pd.testing.assert_frame_equal(a, b, atol=1e-9)


def test_sums_of_draws_split_anywhere():
    values = np.arange(1.0, 41.0)
    for add in (R.drawn_sums, R.signed_sums):
        whole = add(values, 1, 40, 30, 5)
        assert np.allclose(add(values, 1, 13, 30, 5) + add(values, 14, 40, 30, 5), whole) and len(whole) == 30
    assert (R.mixed(np.arange(1, 4), np.arange(1, 6), -7) < R.PRIME).all()


def test_rank_sweep_equals_row_replicates(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"e": rng.integers(0, 3, n), "p": rng.integers(0, 9, n), "a": rng.integers(0, 6, n).astype(float), "b": rng.normal(size=n).round(1), "y": rng.integers(0, 12, n).astype(float)})
    pdf.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("p") > 0, F.col("p")))
    for f in (lambda **k: I.group_bootstrap_diff(df, ["e"], "p", "a", "b", "y", 40, 0.9, 2, **k), lambda **k: I.cluster_bootstrap_stat(df, [], "p", I.spearman_stat("a", "y"), 40, 0.9, 2, **k)):
        a, b = (f(**k).toPandas().sort_values("n_rows").reset_index(drop=True) for k in ({}, {"rows_per_split": 5}))
        pd.testing.assert_frame_equal(a[b.columns], b, atol=1e-9)
        assert (a["ci_low"] < a["ci_high"]).all()


def test_replicates_of_large_groups_are_dealt_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"c": range(50), "x": rng.normal(size=50), "y": rng.normal(size=50)}))
    f = lambda: (I.cluster_bootstrap(df, [], "x", "c", 30), I.cluster_bootstrap_stat(df, [], "c", I.spearman_stat("x", "y"), 30))
    want = [x.first() for x in f()]
    for name, value in (("SLOTS", 7), ("SWEEP_CELLS", 100), ("STEP_CELLS", 60), ("TASK_DRAWS", 50), ("HELD_KEYS", 1)):
        monkeypatch.setattr(R, name, value)
    for x, y in zip(f(), want, strict=True):
        got = x.first().asDict()
        assert all(np.isclose(got[k], v) for k, v in y.asDict().items())


@pytest.mark.parametrize("rows", [1_000_000, 20])
def test_rank_correlation_folds_no_pairs(spark, monkeypatch, rows):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": rng.integers(0, 5, 300) * 1.0, "y": rng.normal(size=300).round(2), "w": 1})
    written = []
    kept = I.settle
    monkeypatch.setattr(I, "settle", lambda df: written.append(df.count()) or kept(df))
    got = {r["g"]: r["stat"] for r in I.weighted_spearman(spark.createDataFrame(pdf), ["g"], "x", "y", "w", rows_per_split=rows).collect()}
    for g, part in pdf.groupby("g"):
        assert np.isclose(got[g], part[["x", "y"]].rank().corr().iloc[0, 1])
    # Distinct values are written, never distinct pairs of them.
    assert sum(written) <= (0 if rows > 300 else len(pdf[["g", "x"]].drop_duplicates()) + len(pdf[["g", "y"]].drop_duplicates()))
