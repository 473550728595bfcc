import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ordering as O
from rankloom.operators import ranking as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 600
    # One group holds most rows, and its values repeat a lot.
    g = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n))
    pdf = pd.DataFrame({"g": g, "k": np.arange(n), "s": rng.integers(0, 12, n).astype(float), "y": rng.normal(size=n).round(1)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 20}])
def test_ordinals_match_sort(table, kw):
    pdf, df = table
    got = O.ordinals(df, ["g"], [O.desc("s"), "k"], **kw).toPandas().sort_values("k")
    want = pdf.sort_values(["s", "k"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (got["pos"].to_numpy() == want.sort_index().to_numpy()).all()
    assert (got["n_group"].to_numpy() == pdf.groupby("g")["k"].transform("size").to_numpy()).all()


def test_ordinals_split_is_used(table):
    _, df = table
    plan = O.ordinals(df, ["g"], ["s", "k"], rows_per_split=20)._jdf.queryExecution().toString()
    assert "_cuts" in plan


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 15}])
def test_spearman_with_ties(table, kw):
    pdf, df = table
    got = {r["g"]: r["spearman"] for r in R.spearman(df, ["g"], "s", "y", **kw).collect()}
    for g, part in pdf.groupby("g"):
        assert np.isclose(got[g], np.corrcoef(part["s"].rank(), part["y"].rank())[0, 1])


def test_spearman_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "g int, x double, y double")
    assert R.spearman(df, ["g"], "x", "y").first()["spearman"] is None


def brute_metrics(part, f):
    n = len(part)
    y, s = part["y"].to_numpy(), part["s"].to_numpy()
    gain = y - y.min()
    k = max(1, int(np.ceil(f * n)))
    order = np.lexsort((part["k"], -s))
    disc = np.empty(n)
    disc[order] = 1 / np.log2(np.arange(n) + 2)
    cut = np.empty(n)
    cut[order] = np.where(np.arange(n) < k, 1 / np.log2(np.arange(n) + 2), 0)
    tie = lambda d: pd.Series(d).groupby(s).transform("mean").to_numpy()
    best = np.sort(gain)[::-1] / np.log2(np.arange(n) + 2)
    hits = (y[order][:k] > 0).sum()
    most = min(k, (y > 0).sum())
    return {
        "spearman": np.corrcoef(part["s"].rank(), part["y"].rank())[0, 1], "full_ndcg": (tie(disc) * gain).sum() / best.sum(),
        "top_ndcg": (tie(cut) * gain).sum() / best[:k].sum(), "top_recall": hits / most, "slope": np.cov(s, y, ddof=0)[0, 1] / s.var(),
    }


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 25}])
def test_entity_metrics_brute_force(table, kw):
    pdf, df = table
    got = R.entity_metrics(df, ["g"], ["s"], "y", ["k"], 0.1, **kw).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, want in brute_metrics(part, 0.1).items():
            assert np.isclose(got.loc[g, name], want), (g, name)
    alone = R.ndcg(df, ["g"], "s", "y", ["k"], **kw).toPandas().set_index("g")["ndcg"]
    assert np.allclose(alone.sort_index(), got["full_ndcg"].sort_index())


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 25}])
def test_missing_scores_count_for_their_method_alone(table, kw):
    pdf, df = table
    df = df.withColumns({"t": F.when(F.col("k") % 3 > 0, F.col("s")), "u": F.when(F.col("k") % 4 > 1, -F.col("s")), "none": F.lit(None).cast("double")})
    got = R.entity_metrics(df, ["g"], ["s", "t", "u", "none"], "y", ["k"], 0.1, **kw).toPandas().set_index(["g", "method"])
    assert set(got.index.get_level_values("method")) == {"s", "t", "u"}
    for g, part in pdf.groupby("g"):
        for m, rows in (("s", part), ("t", part[part["k"] % 3 > 0]), ("u", part[part["k"] % 4 > 1].assign(s=lambda p: -p["s"]))):
            assert got.loc[(g, m), "n_rows"] == len(rows)
            for name, want in brute_metrics(rows, 0.1).items():
                assert np.isclose(got.loc[(g, m), name], want), (g, m, name)


def test_perfect_beats_reversed(spark):
    df = spark.createDataFrame([(0, i, float(i), float(-i), float(i) - 3) for i in range(10)], "g int, k int, good double, bad double, y double")
    m = {r["method"]: r for r in R.entity_metrics(df, ["g"], ["good", "bad"], "y", ["k"]).collect()}
    assert m["good"]["spearman"] == 1 and m["bad"]["spearman"] == -1
    assert m["good"]["full_ndcg"] > m["bad"]["full_ndcg"] and m["good"]["top_recall"] == 1 and np.isclose(m["good"]["slope"], 1)


def test_tertile_sizes(spark):
    t = O.tertiles(spark.range(5).withColumn("g", F.lit(1)), ["g"], ["id"])
    assert {r["tertile"]: r["count"] for r in t.groupBy("tertile").count().collect()} == {"low": 2, "middle": 1, "high": 2}


def test_equal_width_sample(spark):
    got = O.equal_width_sample(spark.range(17).withColumn("g", F.lit(1)), ["g"], ["id"], 5).toPandas()["id"].tolist()
    assert sorted(got) == [int(np.floor((k + 0.5) * 17 / 5)) for k in range(5)]


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 20}])
def test_shuffle_keeps_group_contents(table, kw):
    pdf, df = table
    out = O.shuffle_within(df.select("g", "k", "y"), ["g"], ["k"], ["y"], F.xxhash64("k"), **kw).toPandas()
    for g, part in pdf.groupby("g"):
        assert sorted(out.loc[out["g"] == g, "y"]) == sorted(part["y"])
    assert out["moved"].mean() > 0.9


def test_rolling_mean_blocks(spark):
    pdf = pd.DataFrame({"g": 1, "p": range(50), "v": np.random.default_rng(0).integers(0, 2, 50)})
    got = O.rolling_mean(spark.createDataFrame(pdf), ["g"], "p", ["v"], 3, block=7).toPandas().sort_values("p")["v_mean"]
    assert np.allclose(got, pdf["v"].rolling(7, center=True, min_periods=1).mean())


def test_strict_quota_fails(spark):
    with pytest.raises(Exception, match="quota of 4"):
        O.quota_head(spark.range(3).withColumn("g", F.lit(1)), ["g"], ["id"], 4, strict=True).collect()


@pytest.mark.parametrize("kw", [{}, {"rows_per_split": 10}])
def test_quantiles_match_numpy(table, kw):
    pdf, df = table
    got = O.quantiles(df, ["g"], "y", {"a": 0.25, "b": 0.5, "c": 0.9}, **kw).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(part["y"], [0.25, 0.5, 0.9]))
