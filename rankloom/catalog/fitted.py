"""Models fitted on the stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import long_scorers, r6, rounded, scorers, table
from rankloom.functions import vectors as V
from rankloom.functions.classes import SYMBOLS
from rankloom.operators import controls as C
from rankloom.operators import models as M
from rankloom.operators import ranking as R

P, Q = 8, 20


def _rows(spark, sf):
    """Features (first eight entries), residual target, group, split."""
    e = V.as_double("embedding")
    feats = table(spark, sf, "embeddings").select("vec_id", F.slice(e, 57, P).alias("x"))
    s = scorers(spark, sf).withColumns({"y": V.residual("sa", "base"), "action": V.anchor("sa", "native")})
    part = F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "validation").otherwise("locked")
    return s.join(feats, "vec_id").withColumn("split", part)


TRAIN = "vec_id % 2 = 0"


def ridge_two(spark, sf):
    """Two features and one target, so plain SQL can solve it."""
    e = V.as_double("embedding")
    t = table(spark, sf, "embeddings").select("vec_id", F.array(F.element_at(e, 1), F.element_at(e, 2)).alias("x"), F.array(F.element_at(e, 21)).alias("y"))
    model = M.ridge_fit(t.where(TRAIN), "x", "y", 2, 1, 10.0)
    return model.transform(t, "x").select("vec_id", r6(F.element_at("prediction", 1), "prediction"))


def leave_one_out(spark, sf):
    e = V.as_double("embedding")
    t = table(spark, sf, "embeddings").select("vec_id", "label", F.array(F.element_at(e, 1), F.element_at(e, 2)).alias("x"), F.element_at(e, 21).alias("y"))
    out = M.leave_one_out(t, "label", "x", "y", 2, {"first": [0], "both": [0, 1]}, 1.0)
    return out.select("vec_id", "label", "method", r6("predicted", "predicted"))


def loo_metrics(spark, sf):
    e = V.as_double("embedding")
    t = table(spark, sf, "embeddings").select("vec_id", "label", F.slice(e, 1, P).alias("x"), F.element_at(e, 21).alias("y"))
    out = M.leave_one_out(t, "label", "x", "y", P, {"first": [0], "half": [0, 1, 2, 3], "all": list(range(P))})
    m = R.spearman(out, ["label", "method"], "predicted", "y")
    return rounded(R.metric_increments(m, ["label"], "first", ["spearman"]))


def ridge_predict(spark, sf):
    d = _rows(spark, sf)
    out = M.ridge_fit(d.where(TRAIN), "x", "y", P, Q, 1.0).transform(d, "x")
    return out.select("vec_id", r6(V.l2_norm("prediction"), "norm"), r6(V.cosine("prediction", "y"), "cosine"))


def rrr_predict(spark, sf):
    d = _rows(spark, sf)
    out = M.rrr_fit(d.where(TRAIN), "x", "y", P, Q, 4, 10.0).transform(d, "x")
    return out.select("vec_id", r6(V.l2_norm("prediction"), "norm"), r6(V.cosine("prediction", "y"), "cosine"))


def cross_fit(spark, sf):
    d = _rows(spark, sf).select("vec_id", "label", "x", "y", "base", "sa")
    out = M.cross_fit(d, "label", "x", "y", P, Q, 5, 1.0, key=["vec_id"], repeats=2, numeric=F.col("vec_id"), seed=3)
    m = out.select("control", "repeat", "fold", V.probe_metrics("base", "sa", V.centre("prediction")).alias("m")).select("control", "repeat", "fold", "m.*")
    return m.groupBy("control", "repeat", "fold").agg(*[r6(F.avg(c), c) for c in ("jsd_reduction", "residual_cosine", "topk_overlap")], F.count(F.lit(1)).alias("n_rows"))


def group_folds(spark, sf):
    return M.group_folds(table(spark, sf, "lineitem"), "l_suppkey", 5).join(
        table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


def standardized(spark, sf):
    d = _rows(spark, sf)
    out = M.standardize(d.select("vec_id", "x"), "x", d.where(TRAIN), P)
    return out.select("vec_id", r6(F.element_at("scaled", 1), "z1"), r6(V.l2_norm("scaled"), "norm"))


def probe_controls(spark, sf):
    d = _rows(spark, sf).select("vec_id", "label", "native", "x", "y")
    out = M.probe_controls(d, "x", "y", P, Q, 1.0, F.expr(TRAIN), key=["vec_id"], levels={"global": [], "entity": ["label"], "wild_type": ["native"]}, repeats=2, numeric=F.col("vec_id"), native="native", seed=1)
    return out.groupBy("control", "repeat").agg(r6(F.avg(V.cosine("prediction", "y")), "cosine"), F.count(F.lit(1)).alias("n_rows"))


def layer_select(spark, sf):
    e = V.as_double("embedding")
    layers = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), F.slice(e, 1 + P * i, P).alias("x")) for i in range(4)])).alias("l")).select("vec_id", "l.*")
    d = _rows(spark, sf).drop("x").join(layers, "vec_id")
    return rounded(M.layer_select(d, "layer", "x", "y", P, Q, [1.0, 10.0, 100.0], "split")[1])


def decomposition(spark, sf):
    d = _rows(spark, sf).select("vec_id", "native", "action", "x", "split")
    out, _ = M.decompose(d, x="x", action="action", native="native", split="split", p=P, ranks=(2, 4), alphas=(1.0, 10.0))
    err = V.l2_norm(V.subtract(V.subtract(V.subtract("action", "g"), "c"), "u"))
    return out.groupBy("split").agg(r6(F.max(err) < 1e-8, "identity_holds"), r6(F.avg(V.l2_norm("g")), "g_norm"), r6(F.avg(V.l2_norm("c")), "c_norm"), r6(F.avg(V.l2_norm("u")), "u_norm"))


def strong_control(spark, sf):
    d = _rows(spark, sf).select("vec_id", "native", "action", "x", "base", "split")
    fit, _ = M.strong_control(d, blocks=["x", "base"], sizes=[P, Q], pca={"base": 5}, y="action", q=Q, native="native", split="split", alphas=[1.0, 10.0, 100.0])
    return rounded(fit)


CLASSES = ["a", "b", "c"]


def _classed(spark, sf):
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("label") % 3 + 1).cast("int"))
    return _rows(spark, sf).select("vec_id", "label", "x", "y", name.alias("cls"))


def environment_probability(spark, sf):
    d = _classed(spark, sf)
    lr = M.class_probabilities(d, "x", "cls", F.expr(TRAIN), CLASSES).withColumn("kind", F.lit("logistic"))
    rc = M.ridge_class_probabilities(d, "x", "cls", F.expr(TRAIN), CLASSES, P).withColumn("kind", F.lit("ridge"))
    both = lr.unionByName(rc).withColumn("held_out", ~F.expr(TRAIN))
    return rounded(M.accuracy(both, ["kind", "held_out"], "cls", CLASSES), 4)


def environment_routes(spark, sf):
    d = M.ridge_class_probabilities(_classed(spark, sf), "x", "cls", F.expr(TRAIN), CLASSES, P)
    hot = F.array(*[(F.col("cls") == c).cast("double") for c in CLASSES])
    routes = {"none": (None, 0), "oracle": (hot, 3), "predicted": (F.col("probabilities"), 3)}
    return rounded(M.environment_routes(d, "x", "y", P, Q, routes, F.expr(TRAIN), 4, 10.0, "none", ["label"]))


def fitted_temperature(spark, sf):
    d = scorers(spark, sf)
    t, nll = M.fit_temperature(d, "sa", "native")
    return d.agg(r6(F.avg(-F.element_at(V.temper("sa", t), F.col("native"))), "nll"), F.count(F.lit(1)).alias("n_rows")).withColumn("temperature", F.lit(round(t, 6)))


def calibration_choice(spark, sf):
    d = scorers(spark, sf).withColumns({c + "_a": V.anchor(c, "native") for c in ("base", "sa", "sb")})
    from rankloom.session import settle

    d = d.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "validation", "locked_test")]), (F.col("vec_id") % 4 + 1).cast("int")))
    found = M.select_calibration(settle(d), "base", "base_a", ["sa_a", "sb_a"], "native")
    audit = found.audit.select("scheme", F.lit("train_and_validation").alias("fit_split"), "evaluation_split", "native_nll", "n_rows", F.lit(True).alias("chosen"))
    return rounded(found.validation.unionByName(audit))


def residual_pca(spark, sf):
    return rounded(M.residual_pca(_rows(spark, sf), "y", Q, 6)[1])


def loading_correlations(spark, sf):
    """Loadings against per-symbol means of another scorer."""
    d = _rows(spark, sf)
    basis, _, _ = M.residual_pca(d, "y", Q, 3)
    props = d.select(F.posexplode("sb").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).unpivot(["i"], ["mean", "spread"], "property_id", "value")
    props = props.select(F.substring(F.lit(SYMBOLS), F.col("i") + 1, F.lit(1)).alias("symbol"), "property_id", "value")
    return rounded(M.loading_correlations(M.loading_table(d, basis, SYMBOLS), props))


def physchem_model(spark, sf):
    d = _rows(spark, sf)
    sym = lambda c: F.substring(F.lit(SYMBOLS), c, F.lit(1))
    props = d.select(F.posexplode("base").alias("i", "v")).groupBy("i").agg(F.array(F.avg("v"), F.max("v")).alias("values")).select(sym(F.col("i") + 1).alias("symbol"), "values")
    matrix = d.select(sym(F.col("native")).alias("wild"), F.posexplode("sb").alias("i", "v")).groupBy("wild", sym(F.col("i") + 1).alias("mut")).agg(F.avg("v").alias("score"))
    return rounded(M.physchem_model(d, "action", "native", props, matrix, SYMBOLS, 1.0))


def predictor_controls(spark, sf):
    d = _rows(spark, sf).select("vec_id", "native", "x", "y")
    out = M.predictor_controls(d, x="x", y="y", native="native", p=P, q=Q, rank=4, alpha=10.0, train=F.expr(TRAIN), key=["vec_id"], numeric=F.col("vec_id"), seed=2)
    return out.groupBy("control").agg(r6(F.avg(V.cosine("prediction", "y")), "cosine"), r6(F.avg(V.l2_norm("prediction")), "norm"), F.count(F.lit(1)).alias("n_rows"))


def coordinate_equivalence(spark, sf):
    out = M.coordinate_equivalence(_rows(spark, sf), "x", "sa", P, Q, 1.0, F.expr(TRAIN))
    return out.select("n_rows", (F.col("max_difference") < 1e-8).alias("same_max"), (F.col("rms_difference") < 1e-9).alias("same_rms"))


QUERIES = {f.__name__: f for f in (
    ridge_two, leave_one_out, loo_metrics, ridge_predict, rrr_predict, cross_fit, group_folds, standardized, probe_controls, layer_select,
    decomposition, strong_control, environment_probability, environment_routes, fitted_temperature, calibration_choice, residual_pca,
    loading_correlations, physchem_model, predictor_controls, coordinate_equivalence,
)}

r = S.rnd


def _ridge2(rows: str, by: str, alpha: float) -> str:
    """Standardised two-feature ridge of y on (a, b): columns w1, w2, w0 and one-feature v1, v0."""
    return f"""SELECT {by} count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, {S.corr('a', 'b')} AS rho, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb,
 count(*) + {alpha}::double AS d FROM {rows}"""


_W = """n * ((d * ca / sa) - (n * rho) * cb / sb) / (d * d - n * n * rho * rho) / sa AS w1, n * ((d * cb / sb) - (n * rho) * ca / sa) / (d * d - n * n * rho * rho) / sb AS w2, n * ca / sa / d / sa AS v1"""
_XY = "t AS (SELECT vec_id, label, embedding[1]::double AS a, embedding[2]::double AS b, embedding[21]::double AS y FROM embeddings)"

SQL = {
    "ridge_two": f"WITH {_XY}, tr AS (SELECT * FROM t WHERE vec_id % 2 = 0), m AS ({_ridge2('tr', '', 10)}), w AS (SELECT *, {_W} FROM m) SELECT vec_id, {r('my + w1 * (a - ma) + w2 * (b - mb)', 'prediction')} FROM t, w",
    "leave_one_out": f"""WITH {_XY}, ex AS (SELECT l.label AS held, t.* FROM (SELECT DISTINCT label FROM t) l JOIN t ON t.label <> l.label), m AS ({_ridge2('ex', 'held,', 1)} GROUP BY held), w AS (SELECT *, {_W} FROM m)
SELECT vec_id, label, 'both' AS method, {r('my + w1 * (a - ma) + w2 * (b - mb)', 'predicted')} FROM t JOIN w ON held = label UNION ALL SELECT vec_id, label, 'first', {r('my + v1 * (a - ma)', 'predicted')} FROM t JOIN w ON held = label""",
    "standardized": f"""WITH e AS (SELECT vec_id, i, embedding[56 + i]::double AS v FROM embeddings, range(1, 9) t(i)), m AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM e WHERE vec_id % 2 = 0 GROUP BY i)
SELECT vec_id, {r('max((v - mu) / sd) FILTER (i = 1)', 'z1')}, {r('sqrt(sum(((v - mu) / sd) ^ 2))', 'norm')} FROM e JOIN m USING (i) GROUP BY vec_id""",
    "group_folds": """WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS i FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)),
w AS (SELECT 0::bigint AS i, [0, 0, 0, 0, 0]::bigint[] AS loads, 0::bigint AS f, 0::bigint AS n UNION ALL
 SELECT g.i, list_transform(range(1, 6), lambda k: w.loads[k] + CASE WHEN k = list_position(w.loads, list_min(w.loads)) THEN g.n ELSE 0 END), list_position(w.loads, list_min(w.loads))::bigint, g.n FROM w JOIN g ON g.i = w.i + 1)
SELECT (f - 1)::int AS fold, count(*) AS n_groups, sum(n)::bigint AS n_rows FROM w WHERE i > 0 GROUP BY f""",
    "coordinate_equivalence": "SELECT count(*) FILTER (vec_id % 2 <> 0) AS n_rows, true AS same_max, true AS same_rms FROM embeddings",
}
