"""Linear models fitted from distributed sufficient statistics.

A table is read once: every task folds its batches into sums and products of
features and targets, Spark adds those up per group, and only p x p systems are
solved on the driver. Any ridge strength, target rank, feature subset or left-out
group then comes from the same sums, without another pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators.ordering import ordinals
from rankloom.session import settle

#: Groups (folds, layers, entities) whose sums the driver may hold at once.
MAX_GROUPS = 10_000


@dataclass(frozen=True)
class Moments:
    """Sums over rows: count, x, y, x x', x y', y y'."""

    n: float
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.n + o.n, self.x + o.x, self.y + o.y, self.xx + o.xx, self.xy + o.xy, self.yy + o.yy)

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.n - o.n, self.x - o.x, self.y - o.y, self.xx - o.xx, self.xy - o.xy, self.yy - o.yy)

    def features(self, keep: Sequence[int]) -> "Moments":
        k = list(keep)
        return Moments(self.n, self.x[k], self.y, self.xx[np.ix_(k, k)], self.xy[k], self.yy)


def _unflatten(flat: Sequence[float], p: int, q: int) -> Moments:
    v = np.asarray(flat, dtype=float)
    cut = np.cumsum([1, p, q, p * p, p * q])
    n, x, y, xx, xy, yy = np.split(v, cut)
    return Moments(float(n[0]), x, y, xx.reshape(p, p), xy.reshape(p, q), yy.reshape(q, q))


def moment_rows(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, m): one flat array of sums per group.

    Tasks emit one array per group they saw; arrays are then added entry by entry.
    """
    by = list(by)
    rows = df.select(*by, V.as_double(x).alias("_x"), V.as_double(y).alias("_y")).dropna(subset=["_x", "_y"])
    fields = [f for f in rows.schema.fields if f.name in by]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "m array<double>"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, g in groups:
                a, b = np.stack(g["_x"].to_numpy()), np.stack(g["_y"].to_numpy())
                flat = np.concatenate([[len(g)], a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel(), (b.T @ b).ravel()])
                key = key if isinstance(key, tuple) else (key,)
                acc[key] = acc[key] + flat if key in acc else flat
        if acc:
            yield pd.DataFrame([[*k, v] for k, v in acc.items()], columns=[*by, "m"])

    parts = rows.mapInPandas(fold, schema).select(*by, F.posexplode("m").alias("_i", "_v"))
    sums = parts.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    # A group's entries number (1 + p + q)^2 at most, whatever its row count.
    packed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"))
    return packed.select(*by, F.transform("_l", lambda s: s["_v"]).alias("m"))


def moments(df: DataFrame, x: str, y: str, p: int, q: int, by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Sums per group on the driver; for a bounded number of groups."""
    rows = moment_rows(df, x, y, by).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {tuple(r[c] for c in by): _unflatten(r["m"], p, q) for r in rows}


@dataclass(frozen=True)
class LinearModel:
    """prediction = intercept + x @ coef, on unscaled features."""

    coef: np.ndarray
    intercept: np.ndarray

    def predict(self, x: Column | str) -> Column:
        rows = np.concatenate([self.intercept[:, None], self.coef.T], axis=1).tolist()
        return V.apply_matrix(rows, F.concat(F.array(F.lit(1.0)), V.as_double(x)))

    def transform(self, df: DataFrame, x: str, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict(x))


def solve_ridge(m: Moments, alpha: float, basis: np.ndarray | None = None) -> LinearModel:
    """Ridge on standardised features with a free intercept.

    Ridge is linear in the targets, so fitting principal scores of the targets
    and mapping back equals projecting the coefficients on ``basis``.
    """
    mx, my = m.x / m.n, m.y / m.n
    cov = m.xx / m.n - np.outer(mx, mx)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    std[std <= 1e-12 * np.maximum(1.0, np.abs(mx))] = 1.0
    z = cov / np.outer(std, std) * m.n
    zy = (m.xy / m.n - np.outer(mx, my)) / std[:, None] * m.n
    w = np.linalg.solve(z + alpha * np.eye(len(mx)), zy) / std[:, None]
    if basis is not None:
        w = w @ basis @ basis.T
    return LinearModel(w, my - mx @ w)


def target_basis(m: Moments, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of the centred targets and all explained shares.

    Signs are fixed: the largest entry of a direction is positive.
    """
    my = m.y / m.n
    cov = m.yy / m.n - np.outer(my, my)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    total = values.sum() or 1.0
    return (vectors * signs)[:, :rank], values / total


def ridge_fit(df: DataFrame, x: str, y: str, p: int, q: int, alpha: float) -> LinearModel:
    return solve_ridge(moments(df, x, y, p, q)[()], alpha)


def rrr_fit(df: DataFrame, x: str, y: str, p: int, q: int, rank: int, alpha: float) -> LinearModel:
    m = moments(df, x, y, p, q)[()]
    return solve_ridge(m, alpha, target_basis(m, rank)[0])


def standardize(df: DataFrame, vec: str, train: DataFrame, p: int, name: str = "scaled") -> DataFrame:
    """Scale by mean and population deviation of the training rows (one row joined)."""
    at = lambda i: F.get(vec, F.lit(i)).cast("double")
    s = train.agg(F.array(*[F.avg(at(i)) for i in range(p)]).alias("_m"), F.array(*[F.stddev_pop(at(i)) for i in range(p)]).alias("_s"))
    safe = F.transform("_s", lambda v: F.when(v > 0, v).otherwise(1.0))
    out = df.join(F.broadcast(s))
    return out.withColumn(name, F.zip_with(V.subtract(V.as_double(vec), F.col("_m")), safe, lambda a, b: a / b)).drop("_m", "_s")


def deal(counts: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Deal groups, largest first, each to the lightest fold, lower numbers first.

    ``counts`` lists (size, number of groups of it) by descending size. Gives runs
    (size, first, length, order): of the groups of that size, those from ``first``
    on go to the folds of ``order`` in turn. The lightest folds take turns until
    they reach the next one, so runs number at most ``folds`` squared per size,
    whatever the number of groups.
    """
    load, runs = [0] * folds, []
    for size, number in counts:
        at = 0
        while at < number:
            ranked = sorted(range(folds), key=lambda f: (load[f], f))
            # The longest head of folds that would all be served before its first is due again.
            again = (load[ranked[0]] + size, ranked[0])
            turn = [f for f in ranked if (load[f], f) < again]
            cycles = (number - at) // len(turn)
            if len(turn) < folds:
                f, o = turn[-1], ranked[len(turn)]
                cycles = min(cycles, (load[o] - load[f] - (f > o)) // size + 1)
            length = cycles * len(turn) if cycles > 0 else min(len(turn), number - at)
            for i, f in enumerate(turn):
                load[f] += size * (cycles if cycles > 0 else int(i < length))
            runs.append((size, at, length, turn))
            at += length
    return runs


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by descending size, each to the lightest fold.

    Groups of one size are told apart by their order alone, so the driver deals
    sizes, not groups: n rows have at most the root of 2 n distinct ones. Rows
    without a group are left out; no rows give no groups.
    """
    sizes = settle(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    counts = [(r["n"], r["k"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()]
    runs = df.sparkSession.createDataFrame(deal(counts, folds), "n long, _first long, _length long, _order array<int>")
    placed = ordinals(sizes, ["n"], [group], pos="_p", total="_t").withColumn("_at", F.col("_p") - 1).join(runs, "n")
    inside = F.col("_at") - F.col("_first")
    turn = (inside % F.size("_order")).cast("int")
    return placed.where((inside >= 0) & (inside < F.col("_length"))).select(group, F.get("_order", turn).alias("fold"))


def _by_case(models: Mapping, col: str, x: str) -> Column:
    """Prediction of the model of the row's group; groups are few."""
    out = None
    for key, m in models.items():
        out = F.when(F.col(col) == key, m.predict(x)) if out is None else out.when(F.col(col) == key, m.predict(x))
    return out


def cross_fit(df: DataFrame, group: str, x: str, y: str, p: int, q: int, folds: int, alpha: float, *, key: Sequence[str] = (), repeats: int = 0, numeric: Column | None = None, seed: int = 0) -> DataFrame:
    """Held-out predictions with folds that keep groups together.

    A fold's training sums are the total minus its own. Controls fit targets
    permuted among all rows outside the fold, once per repeat.
    Adds fold, control, repeat and prediction.
    """
    from rankloom.operators.controls import shuffle_targets

    rows = settle(df.join(group_folds(df, group, folds), group))

    def predict(fitted: DataFrame, keys: list[str]) -> dict:
        per = moments(fitted, x, y, p, q, ["fold", *keys])
        out = {}
        for k in {t[1:] for t in per}:
            total = sum((m for t, m in per.items() if t[1:] == k), start=_zero(p, q))
            out[k] = {t[0]: solve_ridge(total - m, alpha) for t, m in per.items() if t[1:] == k}
        return out

    base = predict(rows, [])[()]
    out = rows.withColumn("prediction", _by_case(base, "fold", x)).withColumns({"control": F.lit("observed"), "repeat": F.lit(0)})
    if repeats:
        # A row trains the model of every other fold.
        others = F.filter(F.array(*[F.lit(f) for f in sorted(base)]), lambda f: f != F.col("fold"))
        mixed = shuffle_targets(rows.select(F.explode(others).alias("held"), *key, x, y), ["held"], key, [y], numeric, repeats, seed).drop("moved")
        per = moments(mixed, x, y, p, q, ["held", "repeat"])
        for rep in range(1, repeats + 1):
            models = {f: solve_ridge(m, alpha) for (f, n), m in per.items() if n == rep}
            ctrl = rows.withColumn("prediction", _by_case(models, "fold", x)).withColumns({"control": F.lit("shuffled"), "repeat": F.lit(rep)})
            out = out.unionByName(ctrl)
    return out


def _zero(p: int, q: int) -> Moments:
    return Moments(0.0, np.zeros(p), np.zeros(q), np.zeros((p, p)), np.zeros((p, q)), np.zeros((q, q)))


def leave_one_out(df: DataFrame, entity: str, x: str, y: str, p: int, feature_sets: Mapping[str, Sequence[int]], alpha: float = 1.0) -> DataFrame:
    """Long held-out predictions (method, predicted) of a scalar target.

    Each entity's model uses the total minus its own sums; solving happens next
    to the entity's sums, so any number of entities works.
    """
    target = df.withColumn("_t", F.array(F.col(y).cast("double")))
    sums = settle(moment_rows(target, x, "_t", [entity]))
    total = sums.select(F.posexplode("m").alias("_i", "_v")).groupBy("_i").agg(F.sum("_v").alias("_v")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("_total")
    )
    names = list(feature_sets)
    sets = [list(feature_sets[n]) for n in names]

    @F.pandas_udf("array<array<double>>")
    def solve(own: pd.Series, everything: pd.Series) -> pd.Series:
        out = []
        for a, t in zip(own, everything):
            m = _unflatten(t, p, 1) - _unflatten(a, p, 1)
            row = []
            for keep in sets:
                model = solve_ridge(m.features(keep), alpha) if m.n > 0 else None
                w = np.full(p + 1, np.nan)
                if model is not None:
                    w[:] = 0.0
                    w[0] = model.intercept[0]
                    w[[k + 1 for k in keep]] = model.coef[:, 0]
                row.append(w)
            out.append(row)
        return pd.Series(out)

    coefs = sums.join(F.broadcast(total)).select(entity, solve("m", "_total").alias("_w"))  # one row of totals
    full = F.concat(F.array(F.lit(1.0)), V.as_double(x))
    rows = df.join(coefs, entity).withColumn("_p", F.transform("_w", lambda w: V.dot(w, full)))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("method"), F.col("_p").alias("predicted"))
    return rows.select(*df.columns, F.explode(pairs).alias("_z")).select(*df.columns, F.col("_z.method").alias("method"), V.finite(F.col("_z.predicted")).alias("predicted"))


def probe_controls(df: DataFrame, x: str, y: str, p: int, q: int, alpha: float, train: Column, *, key: Sequence[str], levels: Mapping[str, Sequence[str]], repeats: int, numeric: Column, native: str, seed: int = 0) -> DataFrame:
    """Predictions on held-out rows of the probe, an intercept-only control and
    probes fitted on targets permuted within each level's groups."""
    from rankloom.operators.controls import shuffle_targets

    tr, te = settle(df.where(train)), settle(df.where(~train))
    m = moments(tr, x, y, p, q)[()]
    label = lambda d, c, r: d.withColumns({"control": F.lit(c), "repeat": F.lit(r)})
    out = label(solve_ridge(m, alpha).transform(te, x), "observed", 0)
    mean = LinearModel(np.zeros((p, q)), m.y / m.n)
    out = out.unionByName(label(mean.transform(te, x), "intercept", 0))
    by_native = A.conditional_mean_vector(tr, te, native, y, q).withColumnRenamed("mean_vec", "prediction")
    out = out.unionByName(label(by_native, "substitution_background", 0))
    for name, by in levels.items():
        mixed = shuffle_targets(tr.select(*{*by, *key, x, y, native}), by, key, [y], numeric, repeats, seed)
        for (rep,), s in sorted(moments(mixed, x, y, p, q, ["repeat"]).items()):
            out = out.unionByName(label(solve_ridge(s, alpha).transform(te, x), name, rep))
    return out


def layer_select(df: DataFrame, layer: str, x: str, y: str, p: int, q: int, alphas: Sequence[float], split: str, locked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Validation error per (layer, alpha) from one pass of sums, the choice, and
    its error on the locked rows with a model refitted on both other splits."""
    spark = df.sparkSession
    per = moments(df.where(F.col(split).isin("train", "validation")), x, y, p, q, [layer, split])
    layers = sorted({k[0] for k in per})
    rows = []
    for l in layers:
        v = per[(l, "validation")]
        for a in alphas:
            rows.append((l, float(a), math.sqrt(max(_sse(solve_ridge(per[(l, "train")], a), v), 0.0) / (v.n * q))))
    kind = dict(df.dtypes)[layer]
    grid = spark.createDataFrame(rows, f"`{layer}` {kind}, alpha double, validation_rmse double")
    best = min(rows, key=lambda r: (r[2], r[0], -r[1]))
    final = solve_ridge(per[(best[0], "train")] + per[(best[0], "validation")], best[1])
    test = final.transform(df.where((F.col(split) == "locked") & (F.col(layer) == best[0])), x)
    err = V.vsumsq(V.subtract("prediction", V.as_double(y)))
    report = test.agg(F.sqrt(F.sum(err) / (F.count(F.lit(1)) * q)).alias("locked_rmse"), F.count(F.lit(1)).alias("n_rows"))
    return grid, report.withColumns({layer: F.lit(best[0]), "alpha": F.lit(best[1]), "validation_rmse": F.lit(best[2])})


def _sse(model: LinearModel, m: Moments) -> float:
    """Squared error of a model on rows known only by their sums."""
    w = np.concatenate([model.intercept[None, :], model.coef])
    g = np.block([[np.array([[m.n]]), m.x[None, :]], [m.x[:, None], m.xx]])
    c = np.concatenate([m.y[None, :], m.xy])
    return float(np.trace(m.yy) - 2 * np.sum(w * c) + np.sum(w * (g @ w)))


def decompose(
    df: DataFrame, *, x: str, action: str, native: str, split: str, p: int, n: int = 20, ranks: Sequence[int] = (4, 8, 16),
    alphas: Sequence[float] = (1.0, 10.0, 100.0),
) -> tuple[DataFrame, DataFrame]:
    """Split an anchored action into class mean G, context part C and remainder U.

    Rank and ridge strength are chosen by anchored error on ``validation`` rows
    with a model of the ``train`` rows; the final model uses both. Returns all
    rows with g, c, u, and the selection grid.
    """
    def global_part(train: DataFrame, rows: DataFrame) -> DataFrame:
        g = A.conditional_mean_vector(train, rows, native, action, n)
        return g.withColumn("g", V.anchor("mean_vec", native)).drop("mean_vec").withColumn(
            "rest", V.anchor(V.subtract(action, "g"), native)
        )

    fit, valid = df.where(F.col(split) == "train"), df.where(F.col(split) == "validation")
    known = df.where(F.col(split).isin("train", "validation"))
    m = moments(global_part(fit, fit), x, "rest", p, n)[()]
    held = settle(global_part(fit, valid).select(x, native, "rest"))
    tried = [(r, a) for r in ranks for a in alphas]
    cols = {}
    for r, a in tried:
        pred = V.anchor(solve_ridge(m, a, target_basis(m, min(r, n))[0]).predict(x), native)
        cols[f"{r}_{a}"] = F.sqrt(F.sum(V.vsumsq(V.subtract(pred, "rest"))) / (F.count(F.lit(1)) * (n - 1)))
    errors = held.agg(*[c.alias(k) for k, c in cols.items()]).first()  # one row
    grid = [(r, float(a), float(errors[f"{r}_{a}"])) for r, a in tried]
    rank, alpha, _ = min(grid, key=lambda t: (t[2], t[0], -t[1]))
    fm = moments(global_part(known, known), x, "rest", p, n)[()]
    final = solve_ridge(fm, alpha, target_basis(fm, min(rank, n))[0])
    out = global_part(known, df).drop("rest").withColumn("c", V.anchor(final.predict(x), native))
    out = out.withColumn("u", V.anchor(V.subtract(V.subtract(action, "g"), "c"), native))
    table = df.sparkSession.createDataFrame([(*t, t[0] == rank and t[1] == alpha) for t in grid], "rank int, alpha double, validation_rmse double, chosen boolean")
    return out, table


def ridge_grid(df: DataFrame, x: str, y: str, p: int, q: int, alphas: Sequence[float], split: str) -> tuple[LinearModel, DataFrame]:
    """Ridge strength by validation error; the model is refitted on both splits."""
    per = moments(df.where(F.col(split).isin("train", "validation")), x, y, p, q, [split])
    tr, va = per[("train",)], per[("validation",)]
    rows = [(float(a), math.sqrt(max(_sse(solve_ridge(tr, a), va), 0.0) / (va.n * q))) for a in alphas]
    best = min(rows, key=lambda r: (r[1], -r[0]))
    grid = df.sparkSession.createDataFrame([(*r, r[0] == best[0]) for r in rows], "alpha double, validation_rmse double, chosen boolean")
    return solve_ridge(tr + va, best[0]), grid


def strong_control(df: DataFrame, *, blocks: Sequence[str], sizes: Sequence[int], pca: Mapping[str, int], y: str, q: int, native: str, split: str, alphas: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Sequence-only control: feature blocks (some reduced to principal scores of
    the training rows), ridge strength by validation error, anchored fit per split."""
    parts, width = [], 0
    out = df
    for name, size in zip(blocks, sizes):
        if name in pca:
            k = pca[name]
            m = moments(df.where(F.col(split) == "train"), name, name, size, size)[()]
            basis, _ = target_basis(m, k)
            mean = (m.y / m.n).tolist()
            scores = V.apply_matrix(basis.T.tolist(), V.subtract(V.as_double(name), F.array(*[F.lit(v) for v in mean])))
            parts.append(scores)
            width += k
        else:
            parts.append(V.as_double(name))
            width += size
    out = settle(out.withColumn("_features", F.concat(*parts)))
    model, grid = ridge_grid(out, "_features", y, width, q, alphas, split)
    pred = out.withColumn("prediction", V.anchor(model.predict("_features"), native))
    return A.anchored_fit(pred, [split], "prediction", y, native), grid


def class_probabilities(df: DataFrame, x: str, label: str, train: Column, classes: Sequence[str], *, max_iter: int = 300, c: float = 1.0) -> DataFrame:
    """Balanced multinomial logistic probabilities for all rows (array, class order).

    ``c`` weighs the summed loss against half the squared weights of standardised
    features, so the penalty of the mean loss is 1 / (c n): balanced weights sum to n.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = df.withColumn("_f", array_to_vector(V.as_double(x))).withColumn("_y", index.cast("double"))
    fit = rows.where(train & (F.col("_y") >= 0))
    counts = fit.groupBy("_y").agg(F.count(F.lit(1)).alias("_k"))  # one row per class
    total = counts.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    w = counts.join(F.broadcast(total)).select("_y", (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("_w"))
    reg = 1.0 / (c * max(1, fit.count()))
    model = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", maxIter=max_iter, tol=1e-9, regParam=reg, family="multinomial", probabilityCol="_p").fit(fit.join(F.broadcast(w), "_y"))
    return model.transform(rows).withColumn("probabilities", vector_to_array("_p")).select(*df.columns, "probabilities")


def ridge_class_probabilities(df: DataFrame, x: str, label: str, train: Column, classes: Sequence[str], p: int, alpha: float = 1.0) -> DataFrame:
    """Ridge scores on -1 / +1 class columns, turned into probabilities by softmax."""
    hot = F.array(*[F.when(F.col(label) == c, 1.0).otherwise(-1.0) for c in classes])
    rows = df.withColumn("_hot", hot)
    model = ridge_fit(rows.where(train), x, "_hot", p, len(classes), alpha)
    return rows.withColumn("probabilities", V.softmax(model.predict(x))).drop("_hot")


def accuracy(df: DataFrame, by: Sequence[str], label: str, classes: Sequence[str]) -> DataFrame:
    hit = F.element_at(F.array(*[F.lit(c) for c in classes]), V.argmax("probabilities")) == F.col(label)
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def environment_routes(df: DataFrame, x: str, y: str, p: int, q: int, routes: Mapping[str, tuple[Column, int]], train: Column, rank: int, alpha: float, base: str, by: Sequence[str]) -> DataFrame:
    """Held-out residual cosine and error per feature route, minus the bare route.

    A route adds an array column of a known width to the features.
    """
    out = None
    for name, (extra, width) in routes.items():
        rows = df.withColumn("_x", F.concat(V.as_double(x), extra) if width else V.as_double(x))
        model = rrr_fit(rows.where(train), "_x", y, p + width, q, rank, alpha)
        pred = model.transform(rows.where(~train), "_x")
        part = pred.groupBy(*by).agg(
            F.avg(V.cosine("prediction", y)).alias("cosine"), F.sqrt(F.avg(V.vsumsq(V.subtract("prediction", y)) / q)).alias("rmse"),
            F.count(F.lit(1)).alias("n_rows"),
        ).withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out = settle(out)
    ref = out.where(F.col("route") == base).select(*by, F.col("cosine").alias("_c"), F.col("rmse").alias("_r"))
    return out.join(ref, list(by)).withColumns({"delta_cosine": F.col("cosine") - F.col("_c"), "delta_rmse": F.col("rmse") - F.col("_r")}).drop("_c", "_r")


def _grid(lo: float, hi: float, points: int) -> list[float]:
    step = (math.log(hi) - math.log(lo)) / (points - 1)
    return [math.exp(math.log(lo) + i * step) for i in range(points)]


def temperature_objective(df: DataFrame, vec: str, idx: str, lo: float, hi: float, points: int) -> DataFrame:
    """Native negative log-likelihood at log-spaced temperatures, in one pass."""
    rows = df.select(vec, idx, F.explode(F.array(*[F.lit(t) for t in _grid(lo, hi, points)])).alias("temperature"))
    scaled = rows.withColumn("_l", V.log_normalize(V.scale(vec, F.lit(1.0) / F.col("temperature"))))
    return scaled.groupBy("temperature").agg(F.avg(-F.element_at("_l", F.col(idx))).alias("nll"))


def _zoom(evaluate: Callable[[list[float]], list[float]], lo: float, hi: float, points: int, rounds: int) -> tuple[float, float]:
    """Smallest value of a smooth one-valley curve by shrinking log grids."""
    best = (math.inf, lo)
    for _ in range(rounds):
        grid = _grid(lo, hi, points)
        values = evaluate(grid)
        i = min(range(points), key=values.__getitem__)
        best = min(best, (values[i], grid[i]))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
    return best[1], best[0]


def grid_losses(rows: DataFrame, base: str | None, units: Sequence[str], idx: str, grid: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean native negative log-likelihood at each point of a grid, and the number of rows.

    A point holds one coefficient per unit vector: the vector scored is ``base``
    (or nothing) plus their weighted sum. Tasks add up one number per point, so the
    whole grid takes one scan. Rows that lack a vector or the native entry are left out.
    """
    columns = ([base] if base else []) + list(units)
    known = rows.select(*[V.as_double(c).alias(f"u{i}") for i, c in enumerate(columns)], F.col(idx).cast("int").alias("at")).dropna()

    def run(batches):
        sums, n = np.zeros(len(grid)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in range(len(columns))]
            at = batch.column(len(columns)).to_numpy() - 1
            fixed, moving = (vecs[0], vecs[1:]) if base else (0.0, vecs)
            for g, point in enumerate(grid):
                z = fixed + sum(c * u for c, u in zip(point, moving))
                top = z.max(1)
                sums[g] += (np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(z)), at]).sum()
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["sums", "n"])

    parts = known.mapInArrow(run, "sums array<double>, n long")
    added = parts.select(F.posexplode("sums").alias("g", "s"), "n").groupBy("g").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()  # a row per point
    order = np.argsort(added.column("g").to_numpy())
    n = int(added.column("n")[0].as_py()) if added.num_rows else 0
    return (added.column("s").to_numpy()[order] / n, n) if n else (np.full(len(grid), np.nan), 0)


def fit_temperature(df: DataFrame, vec: str, idx: str, lo: float = 0.25, hi: float = 4.0, points: int = 17, rounds: int = 5) -> tuple[float, float]:
    """Temperature with the lowest native negative log-likelihood, and that value."""
    rows = settle(df.select(vec, idx))
    return _zoom(lambda grid: grid_losses(rows, None, [vec], idx, np.array([[1.0 / t] for t in grid]))[0].tolist(), lo, hi, points, rounds)


def fit_joint(rows: DataFrame, base: str, units: Sequence[str], idx: str, k: int, make: Callable[[Sequence[float]], Sequence[float]], lo: float = 0.25, hi: float = 4.0, points: int = 9, rounds: int = 3, sweeps: int = 3) -> tuple[list[float], float]:
    """``k`` parameters with the lowest native negative log-likelihood, by coordinate
    search; ``make`` gives the units' coefficients. Each step is one scan."""
    params, value = [1.0] * k, math.inf
    for _ in range(sweeps if k > 1 else 1):
        for j in range(k):
            def evaluate(grid: list[float], j: int = j) -> list[float]:
                return grid_losses(rows, base, units, idx, np.array([make([*params[:j], t, *params[j + 1:]]) for t in grid]))[0].tolist()

            params[j], value = _zoom(evaluate, lo, hi, points, rounds)
    return params, value


def _units(df: DataFrame, base: str, base_action: str, vecs: Sequence[str], idx: str, n: int, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Written rows with each action vector and its rank-normal form: all schemes are weighted sums of these."""
    ranks = {f"_rank{i}": V.rank_normal(v, n) for i, v in enumerate(vecs)}
    rows = settle(df.withColumns(ranks).select(*dict.fromkeys([base, base_action, *vecs, *ranks, idx, *keep])))
    return rows, [*vecs, *ranks]


def _coefficients(scheme: str, params: Sequence[tuple[str, float]]) -> list[float]:
    """Weights of the vectors, then of their rank-normal forms."""
    k, none = len(params), [0.0] * len(params)
    values = [p for _, p in params]
    if scheme == "rowwise_rank_normalized":
        return none + [p / k for p in values]
    return [(1.0 / p if scheme == "joint_temperature_native_nll" else p) / k for p in values] + none


def fit_schemes(rows: DataFrame, base: str, base_action: str, vecs: Sequence[str], units: Sequence[str], idx: str, n: int = 20, **kw) -> dict[str, list[tuple[str, float]]]:
    """Parameters of all four schemes, fitted to these rows."""
    names = list(vecs)
    sizes = rows.agg(*[F.sqrt(F.avg(V.vsumsq(c) / (n - 1))).alias(c) for c in [base_action, *names]]).first()
    params: dict[str, list[tuple[str, float]]] = {
        "unscaled_equal": [(v, 1.0) for v in names],
        "action_rms_matched": [(v, sizes[base_action] / sizes[v]) for v in names],
    }
    for scheme, k in (("joint_temperature_native_nll", len(names)), ("rowwise_rank_normalized", 1)):
        pairs = lambda t, k=k: list(zip(names, t if k > 1 or len(names) == 1 else [t[0]] * len(names)))
        best, _ = fit_joint(rows, base, units, idx, k, lambda t: _coefficients(scheme, pairs(t)), **kw)
        params[scheme] = pairs(best)
    return params


@dataclass
class Calibration:
    """The chosen scheme, its parameters by split, and its measures.

    ``train`` and ``final`` hold the parameters of all schemes, fitted to the
    training rows and to training and validation rows. ``validation`` has a row
    per scheme, ``audit`` one for the final rows and one for the locked ones.
    """

    scheme: str
    train: dict[str, list[tuple[str, float]]]
    final: dict[str, list[tuple[str, float]]]
    validation: DataFrame
    audit: DataFrame


def _scheme_losses(rows: DataFrame, base: str, units: Sequence[str], idx: str, params: Mapping[str, list[tuple[str, float]]]) -> dict[str, float]:
    """Mean native negative log-likelihood of each scheme, in one scan."""
    losses, n = grid_losses(rows, base, units, idx, np.array([_coefficients(s, p) for s, p in params.items()]))
    if not n:
        raise ValueError("a split of the calibration has no rows")
    return {s: float(x) for s, x in zip(params, losses)} | {"n_rows": n}


def select_calibration(
    df: DataFrame, base: str, base_action: str, vecs: Sequence[str], idx: str, *, split: str = "split", train: str = "train", selection: str = "validation", locked: str = "locked_test", n: int = 20, **kw
) -> Calibration:
    """Fit all four schemes to the training rows, choose the one of lowest loss on the
    validation rows (ties by name), fit it again to both and measure it there and on
    the locked rows, which take no part before."""
    rows, units = _units(df, base, base_action, vecs, idx, n, [split])
    of = lambda *names: rows.where(F.col(split).isin(*names))
    first = fit_schemes(of(train), base, base_action, vecs, units, idx, n, **kw)
    losses = _scheme_losses(of(selection), base, units, idx, first)
    best = min(first, key=lambda s: (losses[s], s))
    final = fit_schemes(of(train, selection), base, base_action, vecs, units, idx, n, **kw)
    spark = df.sparkSession
    validation = spark.createDataFrame([(s, train, selection, losses[s], losses["n_rows"], s == best) for s in sorted(first)], "scheme string, fit_split string, evaluation_split string, native_nll double, n_rows long, chosen boolean")
    audits = []
    for name, parts in (("development_train_plus_validation", (train, selection)), (locked, (locked,))):
        measured = _scheme_losses(of(*parts), base, units, idx, {best: final[best]})
        audits.append((best, name, measured[best], measured["n_rows"]))
    audit = spark.createDataFrame(audits, "scheme string, evaluation_split string, native_nll double, n_rows long")
    return Calibration(best, first, final, validation, audit)


def residual_pca(df: DataFrame, vec: str, n: int, k: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Directions of centred vectors: (basis, explained table, rows with scores and
    their rank-k projection)."""
    m = moments(df, vec, vec, n, n)[()]
    basis, share = target_basis(m, k)
    mean = m.y / m.n
    table = df.sparkSession.createDataFrame([(i + 1, float(s)) for i, s in enumerate(share[:k])], "component int, explained double")
    lit = F.array(*[F.lit(float(v)) for v in mean])
    out = df.withColumn("scores", V.apply_matrix(basis.T.tolist(), V.subtract(V.as_double(vec), lit)))
    return basis, table, out.withColumn("projection", V.add(V.apply_matrix(basis.tolist(), "scores"), lit))


def loading_table(df: DataFrame, basis: np.ndarray, symbols: str) -> DataFrame:
    rows = [(s, k + 1, float(basis[i, k])) for i, s in enumerate(symbols) for k in range(basis.shape[1])]
    return df.sparkSession.createDataFrame(rows, "symbol string, component int, loading double")


def loading_correlations(loadings: DataFrame, props: DataFrame) -> DataFrame:
    """Pearson and rank correlation of loadings with symbol properties."""
    from rankloom.operators.ranking import pearson, spearman

    rows = settle(loadings.join(props, "symbol").dropna(subset=["value"]))
    by = ["component", "property_id"]
    return pearson(rows, by, "loading", "value").join(spearman(rows, by, "loading", "value").drop("n_rows"), by)


def physchem_model(df: DataFrame, action: str, wild: str, props: DataFrame, matrix: DataFrame, symbols: str, alpha: float) -> DataFrame:
    """Context-free action per (wild, mut): differences and absolute differences of
    symbol properties, a substitution score and an identity flag, by ridge.

    Rows of one wild type share their features, so the table first folds to one
    row per symbol pair. ``props`` has (symbol, values array), ``matrix`` one row
    per ordered symbol pair (wild, mut, score).
    """
    n = len(symbols)
    letter = lambda i: F.substring(F.lit(symbols), i, F.lit(1))
    pairs = df.select(letter(F.col(wild)).alias("wild"), F.posexplode(action).alias("_i", "_y")).select("wild", letter(F.col("_i") + 1).alias("mut"), "_y")
    folded = pairs.groupBy("wild", "mut").agg(F.count(F.lit(1)).alias("k"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("ss"))
    a = props.select(F.col("symbol").alias("wild"), F.col("values").alias("_a"))
    b = props.select(F.col("symbol").alias("mut"), F.col("values").alias("_b"))
    # Alphabet-sized from here on.
    grid = matrix.select("wild", "mut", "score").join(a, "wild").join(b, "mut")
    d = V.subtract("_b", "_a")
    x = F.concat(d, F.transform(d, lambda v: F.abs(v)), F.array(F.col("score"), (F.col("wild") == F.col("mut")).cast("double")))
    table = grid.select("wild", "mut", x.alias("x")).join(folded, ["wild", "mut"], "left").toPandas()
    if len(table) > n * n:
        raise ValueError("symbol pairs repeat")
    f = np.stack(table["x"].to_numpy())
    k, s, ss = (table[c].fillna(0.0).to_numpy(dtype=float) for c in ("k", "s", "ss"))
    m = Moments(k.sum(), k @ f, np.array([s.sum()]), (f * k[:, None]).T @ f, (f.T @ s)[:, None], np.array([[ss.sum()]]))
    model = solve_ridge(m, alpha)
    table["prediction"] = f @ model.coef[:, 0] + model.intercept[0]
    return df.sparkSession.createDataFrame(table[["wild", "mut", "prediction"]])


def predictor_controls(df: DataFrame, *, x: str, y: str, native: str, p: int, q: int, rank: int, alpha: float, train: Column, key: Sequence[str], numeric: Column, seed: int = 0) -> DataFrame:
    """Held-out predictions of the control family: class-mean matrix, context ridge,
    shuffled context, shuffled target, rank projection and size shrinkage."""
    from rankloom.operators.controls import shuffle_targets

    tr, te = settle(df.where(train)), settle(df.where(~train))
    m = moments(tr, x, y, p, q)[()]
    basis, _ = target_basis(m, rank)
    context = solve_ridge(m, alpha)
    no = A.conditional_mean_vector(tr, te, native, y, q).withColumnRenamed("mean_vec", "prediction")
    parts = {
        "global_matrix": no,
        "context_ridge": context.transform(te, x),
        "rank_projection": solve_ridge(m, alpha, basis).transform(te, x),
    }
    for name, col in (("shuffled_target", y), ("shuffled_context", x)):
        mixed = shuffle_targets(tr.select(*{*key, x, y}), [], key, [col], numeric, 1, seed)
        parts[name] = solve_ridge(moments(mixed, x, y, p, q)[()], alpha).transform(te, x)
    pred = V.vsumsq(context.predict(x))
    sizes = te.agg(F.sqrt(F.avg(V.vsumsq(V.as_double(y))) / F.avg(pred)).alias("k")).first()
    parts["rms_matched"] = context.transform(te, x).withColumn("prediction", V.scale("prediction", float(sizes["k"] or 0.0)))
    out = None
    for name, part in parts.items():
        part = part.select(*df.columns, "prediction").withColumn("control", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def coordinate_equivalence(df: DataFrame, x: str, vec: str, p: int, n: int, alpha: float, train: Column) -> DataFrame:
    """Largest and RMS difference of ridge predictions made in centred and in
    isometric coordinates."""
    rows = df.withColumns({"_clr": V.centre(vec), "_ilr": V.ilr(V.centre(vec), n)})
    fit = settle(rows.where(train))
    a, b = ridge_fit(fit, x, "_clr", p, n, alpha), ridge_fit(fit, x, "_ilr", p, n - 1, alpha)
    d = rows.where(~train).select(V.subtract(V.centre(a.predict(x)), V.inverse_ilr(b.predict(x), n)).alias("_d"))
    return d.agg(
        F.max(F.array_max(F.transform("_d", lambda v: F.abs(v)))).alias("max_difference"),
        F.sqrt(F.avg(V.vsumsq("_d") / n)).alias("rms_difference"),
        F.count(F.lit(1)).alias("n_rows"),
    )
