import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import models as M

RNG = np.random.default_rng(11)
X = RNG.normal(size=(60, 3)) * [1, 5, 0.1] + [0, 10, 1]
Y = X @ RNG.normal(size=(3, 4)) + RNG.normal(size=(60, 4))
G = np.arange(60) % 6


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, int(G[i]), X[i].tolist(), Y[i].tolist(), float(Y[i][0])) for i in range(60)], "id int, g int, x array<double>, y array<double>, t double").repartition(3)


def ridge(x, y, alpha, xt):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0)))
    return (xt - mu) / sd @ w + y.mean(0)


def pred(df, col="prediction"):
    return np.array([r[0] for r in df.orderBy("id").select(col).collect()])


def test_ridge_closed_form(rows):
    assert np.allclose(pred(M.ridge_fit(rows, "x", "y", 3, 4, 2.0).transform(rows, "x")), ridge(X, Y, 2.0, X))


def test_reduced_rank_equals_latent_fit(rows):
    got = pred(M.rrr_fit(rows, "x", "y", 3, 4, 2, 2.0).transform(rows, "x"))
    centred = Y - Y.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.allclose(got, ridge(X, centred @ v, 2.0, X) @ v.T + Y.mean(0))


def test_leave_one_out_refits(rows):
    out = M.leave_one_out(rows, "g", "x", "t", 3, {"a": [0], "ab": [0, 1]}, 1.0).toPandas()
    for name, keep in (("a", [0]), ("ab", [0, 1])):
        got = out[out["method"] == name].sort_values("id")["predicted"].to_numpy()
        want = np.empty(60)
        for g in range(6):
            tr, te = G != g, G == g
            want[te] = ridge(X[tr][:, keep], Y[tr][:, :1], 1.0, X[te][:, keep])[:, 0]
        assert np.allclose(got, want)


def test_cross_fit_separates_groups(rows):
    out = M.cross_fit(rows, "g", "x", "y", 3, 4, 3, 1.0, key=["id"], repeats=2, numeric=F.col("id"), seed=1)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty()
    obs = out.where("control = 'observed'").toPandas().sort_values("id")
    for f, part in obs.groupby("fold"):
        tr = ~np.isin(np.arange(60), part["id"])
        assert np.allclose(np.stack(part["prediction"]), ridge(X[tr], Y[tr], 1.0, X[part["id"]]))
    err = out.groupBy("control").agg(F.avg(V.vsumsq(V.subtract("prediction", "y"))).alias("e")).toPandas().set_index("control")["e"]
    assert err["observed"] < err["shuffled"]


def test_group_folds_balance(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3)) for _ in range(n)], "g string")
    got = {r["g"]: r["fold"] for r in M.group_folds(df, "g", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_sse_from_sums(rows):
    m = M.moments(rows, "x", "y", 3, 4)[()]
    model = M.solve_ridge(m, 3.0)
    assert np.isclose(M._sse(model, m), ((ridge(X, Y, 3.0, X) - Y) ** 2).sum())


def test_decomposition_adds_up(spark):
    n = 90
    act = RNG.normal(size=(n, 5))
    nat = RNG.integers(1, 6, n)
    act -= act[np.arange(n), nat - 1][:, None]
    df = spark.createDataFrame([(i, RNG.normal(size=2).tolist(), act[i].tolist(), int(nat[i]), ["train", "validation", "panel"][i % 3]) for i in range(n)], "id int, x array<double>, a array<double>, nat int, split string")
    out, grid = M.decompose(df, x="x", action="a", native="nat", split="split", p=2, n=5, ranks=(1, 2), alphas=(1.0, 10.0))
    gap = out.select(V.subtract(V.subtract(V.subtract("a", "g"), "c"), "u").alias("d"), *[F.element_at(c, F.col("nat")).alias(c) for c in "gcu"]).toPandas()
    assert np.abs(np.stack(gap["d"])).max() < 1e-9 and np.abs(gap[["g", "c", "u"]].to_numpy()).max() < 1e-9
    assert grid.where("chosen").count() == 1 and grid.count() == 4


def test_temperature_improves_likelihood(spark):
    df = spark.createDataFrame([(0, [3.0, 0.0, 0.0], 1), (1, [3.0, 0.0, 0.0], 2), (2, [3.0, 0.0, 0.0], 1)], "id int, v array<double>, idx int")
    t, nll = M.fit_temperature(df, "v", "idx")
    base = df.agg(F.avg(-F.element_at(V.log_normalize("v"), F.col("idx"))).alias("b")).first()["b"]
    assert nll < base and 2.0 < t < 4.0
    grid = np.linspace(0.25, 4, 4001)
    z = np.array([3.0, 0, 0])
    cost = [np.mean([np.log(np.exp(z / g).sum()) - z[k] / g for k in (0, 1, 0)]) for g in grid]
    assert abs(t - grid[np.argmin(cost)]) < 0.01


def test_pca_explains_like_svd(rows):
    _, table, out = M.residual_pca(rows, "y", 4, 2)
    s = np.linalg.svd(Y - Y.mean(0), compute_uv=False) ** 2
    assert np.allclose([r["explained"] for r in table.orderBy("component").collect()], (s / s.sum())[:2])
    u, d, v = np.linalg.svd(Y - Y.mean(0), full_matrices=False)
    assert np.allclose(pred(out, "projection"), (u[:, :2] * d[:2]) @ v[:2] + Y.mean(0))


def test_class_probabilities_learn(spark):
    df = spark.createDataFrame([(i, [float(i % 2) + 0.01 * (i % 7), 1.0], "ab"[i % 2]) for i in range(40)], "id int, x array<double>, c string")
    for out in (M.class_probabilities(df, "x", "c", F.col("id") < 30, ["a", "b"]), M.ridge_class_probabilities(df, "x", "c", F.col("id") < 30, ["a", "b"], 2)):
        assert M.accuracy(out.where("id >= 30"), [], "c", ["a", "b"]).first()["accuracy"] == 1.0
        assert np.allclose(pred(out, "probabilities").sum(1), 1)


def test_physchem_equals_row_fit(spark):
    syms, n = "ACD", 30
    y, wild = RNG.normal(size=(n, 3)), RNG.integers(1, 4, n)
    p = RNG.normal(size=(3, 2))
    props = spark.createDataFrame([(s, p[i].tolist()) for i, s in enumerate(syms)], "symbol string, values array<double>")
    mat = {(a, b): float(RNG.normal()) for a in syms for b in syms}
    matrix = spark.createDataFrame([(a, b, v) for (a, b), v in mat.items()], "wild string, mut string, score double")
    df = spark.createDataFrame([(y[i].tolist(), int(wild[i])) for i in range(n)], "a array<double>, w int")
    got = {(r["wild"], r["mut"]): r["prediction"] for r in M.physchem_model(df, "a", "w", props, matrix, syms, 1.5).collect()}
    feat = lambda i, j: [*(p[j] - p[i]), *np.abs(p[j] - p[i]), mat[syms[i], syms[j]], float(i == j)]
    f = np.array([feat(w - 1, j) for w in wild for j in range(3)])
    all_ = np.array([feat(i, j) for i in range(3) for j in range(3)])
    want = ridge(f, y.reshape(-1, 1), 1.5, all_)[:, 0]
    assert np.allclose([got[a, b] for a in syms for b in syms], want)


def test_grid_losses_equal_direct_computation(spark):
    rng = np.random.default_rng(9)
    base, u, idx = rng.normal(size=(30, 5)), rng.normal(size=(2, 30, 5)), rng.integers(1, 6, 30)
    rows = spark.createDataFrame([(base[i].tolist(), u[0, i].tolist(), u[1, i].tolist(), int(idx[i])) for i in range(30)] + [(None, [0.0] * 5, [0.0] * 5, 1)], "b array<double>, u array<double>, w array<double>, idx int")
    grid = np.array([[0.0, 0.0], [0.5, 1.0], [-1.0, 3.0]])
    got, n = M.grid_losses(rows.repartition(5), "b", ["u", "w"], "idx", grid)
    z = base + np.einsum("gk,kij->gij", grid, u)
    want = (np.log(np.exp(z).sum(2)) - np.take_along_axis(z, (idx - 1)[None, :, None].repeat(3, 0), 2)[..., 0]).mean(1)
    assert n == 30 and np.allclose(got, want)


def test_calibration_is_chosen_on_validation_rows(spark):
    """Two signals whose right temperatures differ; the locked rows follow another law and must not matter."""
    rng = np.random.default_rng(10)
    n = 600
    a, b = rng.normal(size=(2, n, 4)) * np.array([1.0, 4.0])[:, None, None]
    z = a / 2 + b / 8
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    idx = np.array([rng.choice(4, p=q) for q in p])
    split = np.array(["train", "validation", "locked_test"])[np.arange(n) % 3]
    rows = [([0.0] * 4, a[i].tolist(), a[i].tolist(), b[i].tolist(), int(idx[i]) + 1, split[i]) for i in range(n)]
    schema = "base array<double>, act array<double>, a array<double>, b array<double>, idx int, split string"
    choose = lambda r: M.select_calibration(spark.createDataFrame(r, schema), "base", "act", ["a", "b"], "idx", n=4, points=7, rounds=2, sweeps=2)
    found = choose(rows)
    table = {r["scheme"]: r for r in found.validation.collect()}
    assert len(table) == 4 and table[found.scheme]["chosen"] and min(table.values(), key=lambda r: r["native_nll"])["scheme"] == found.scheme
    fitted = dict(found.train["joint_temperature_native_nll"])
    assert 0.5 < fitted["a"] < 2 and fitted["b"] > 2
    audit = {r["evaluation_split"]: r["n_rows"] for r in found.audit.collect()}
    assert audit == {"development_train_plus_validation": 400, "locked_test": 200}
    other = choose([(*r[:4], r[4] % 4 + 1, r[5]) if r[5] == "locked_test" else r for r in rows])
    assert other.scheme == found.scheme and other.final == found.final
    with pytest.raises(ValueError):
        choose([r for r in rows if r[5] != "validation"])


def test_folds_are_dealt_to_the_lightest_at_any_number_of_groups():
    import random

    from rankloom.operators.models import deal

    rng = random.Random(5)
    for case in range(300):
        folds = rng.randint(1, 6)
        sizes = sorted({rng.choice([rng.randint(1, 9), rng.randint(1, 400)]) for _ in range(rng.randint(1, 6))}, reverse=True)
        counts = [(n, rng.choice([1, 2, 7, 60])) for n in sizes]
        load, want = [0] * folds, []
        for n, k in counts:
            for i in range(k):
                f = load.index(min(load))
                load[f] += n
                want.append((n, i, f))
        runs = deal(counts, folds)
        got = [(n, first + i, turn[i % len(turn)]) for n, first, length, turn in runs for i in range(length)]
        assert got == want, (case, counts, folds)
    # A size that very many groups share takes no more runs.
    assert len(deal([(10**9, 3), (7, 10**12), (1, 10**12 + 1)], 5)) <= 75


def test_group_folds_equal_the_sequential_deal(spark):
    rows = [(f"g{i:03d}", j) for i in range(60) for j in range(1 + (i * 7) % 5)] + [(None, 0)]
    df = spark.createDataFrame(rows, "g string, j int")
    sizes: dict[str, int] = {}
    for g, _ in rows:
        if g is not None:
            sizes[g] = sizes.get(g, 0) + 1
    load, want = [0] * 4, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = load.index(min(load))
        load[f] += sizes[g]
        want[g] = f
    from rankloom.operators.models import group_folds

    assert {r["g"]: r["fold"] for r in group_folds(df, "g", 4).collect()} == want
    assert group_folds(df.where("j < 0"), "g", 4).count() == 0
