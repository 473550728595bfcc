"""Ranking metrics, increments and resampling intervals, over line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import KEY, observed, r6, rounded, table
from rankloom.operators import aggregates as A
from rankloom.operators import inference as I
from rankloom.operators import joins as J
from rankloom.operators import methods as M
from rankloom.operators import ordering as O
from rankloom.operators import ranking as R
from rankloom.session import settle

ENTITY = ["l_suppkey"]


def supplier_spearman(spark, sf):
    return rounded(R.spearman(observed(spark, sf), ENTITY, "l_quantity", "y"))


def supplier_pearson(spark, sf):
    o = observed(spark, sf)
    return rounded(R.pearson(o, ENTITY, "l_quantity", "y").join(
        R.sign_agreement(o.withColumn("q", F.col("l_quantity") - 25), ENTITY, "q", "y"), ENTITY))


def supplier_ndcg(spark, sf):
    full = R.ndcg(observed(spark, sf), ENTITY, "l_quantity", "y", KEY)
    top = R.ndcg(observed(spark, sf), ENTITY, "l_quantity", "y", KEY, k=10).withColumnRenamed("ndcg", "ndcg_10")
    return rounded(full.join(top, ENTITY))


def supplier_topk_recall(spark, sf):
    return rounded(R.topk_recall(observed(spark, sf), ENTITY, "l_quantity", "y", KEY, 0.1))


def supplier_slope(spark, sf):
    o = observed(spark, sf)
    base = R.calibration_slope(o, ENTITY, "l_quantity", "y")
    other = R.calibration_slope(o.withColumn("q2", F.col("l_quantity") * (1 - F.col("l_discount"))), ENTITY, "q2", "y").select(
        *ENTITY, F.col("slope").alias("other_slope"))
    return rounded(base.join(other, ENTITY).withColumn("error_reduction", R.slope_error_reduction(F.col("slope"), F.col("other_slope"))), 4)


METHODS = M.subsets("q", ["d", "t"])


def _method_rows(spark, sf):
    o = observed(spark, sf).withColumns({
        "q": F.col("l_quantity"), "d": F.col("l_discount") * 100, "t": F.col("l_tax") * 100, "st": F.col("l_suppkey") % 3})
    return M.method_predictions(o, METHODS, [*ENTITY, "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_tax", "y"])


def _metrics(spark, sf):
    return settle(R.entity_metrics(_method_rows(spark, sf), ENTITY, list(METHODS), "y", KEY))


def method_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


def sparse_method_metrics(spark, sf):
    """Each method lacks the scores of other rows."""
    rows = _method_rows(spark, sf)
    rows = rows.withColumns({m: F.when((F.col("l_linenumber") + len(m)) % 3 != 0, F.col(m)) for m in METHODS})
    return rounded(R.entity_metrics(rows, ENTITY, list(METHODS), "y", KEY))


def metric_increments(spark, sf):
    return rounded(R.metric_increments(_metrics(spark, sf), ENTITY, "q"))


def contrast_summary(spark, sf):
    reg = M.registry(spark, [("d_over_base", "q+d", "q"), ("t_over_base", "q+t", "q"), ("both_over_d", "q+d+t", "q+d")],
                     ["contrast", "method", "comparator"])
    gaps = J.contrast_gaps(_metrics(spark, sf), reg, ENTITY, ["spearman", "full_ndcg"]).withColumn(
        "stratum", F.concat(F.lit("s"), F.col("l_suppkey") % 3))
    scoped = I.with_scopes(gaps, "stratum")
    return rounded(I.summarize(scoped, ["contrast", "scope"], ["spearman", "full_ndcg"], "l_suppkey",
                               method="stratified", st="stratum", replicates=200, seed=11))


def subgroup_metrics(spark, sf):
    o = observed(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    out = R.subgroup_metrics(o, ENTITY, ["p_type", "l_linestatus"], ["l_quantity"], "y", KEY, min_rows=50)
    return rounded(out)


def role_concordance(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return rounded(R.concordance(o, ["l_suppkey"], "l_returnflag", "A", ["l_partkey"], "v"))


def assay_spearman(spark, sf):
    o = observed(spark, sf)
    return rounded(R.assay_spearman(o, ["l_returnflag", "l_suppkey"], "l_quantity", "y", 200))


def correlation_table(spark, sf):
    o = observed(spark, sf)
    return rounded(R.correlation_table(o, ["l_returnflag"], ["l_quantity", "l_discount"], ["y", "l_tax"], 10))


def cluster_means(spark, sf):
    return rounded(I.cluster_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_suppkey"))


def stratified_bootstrap(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("st", F.col("l_suppkey") % 4)
    return rounded(I.stratified_bootstrap(li.withColumn("gap", F.col("l_quantity") - 25.5), ["l_returnflag"], "gap", "l_suppkey", "st", 300, 0.95, 3))


def wild_cluster(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("gap", F.col("l_quantity") - 25.5)
    return rounded(I.wild_cluster(li, ["l_returnflag"], "gap", "l_suppkey", 300, 0.95, 5))


def group_bootstrap(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(I.group_bootstrap_diff(li, ["l_returnflag"], "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", 500, 0.9, 2))


def bootstrap_spearman(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderstatus", "c_nationkey", "o_totalprice", "c_acctbal")
    return rounded(I.cluster_bootstrap_stat(o, ["o_orderstatus"], "c_nationkey", I.spearman_stat("c_acctbal", "o_totalprice"), 500, 0.9, 4))


def environment_summary(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("gap", F.col("l_quantity") - 25.5)
    return rounded(A.environment_summary(li, ["l_linenumber"], ["l_returnflag", "l_linestatus"], "gap", "l_suppkey", replicates=50, seed=9))


def supplier_order(spark, sf):
    o = O.ordinals(table(spark, sf, "lineitem"), ENTITY, [O.desc("l_extendedprice"), *KEY])
    return o.where(F.col("pos") <= 3).select("l_suppkey", "pos", "n_group", "l_orderkey", "l_extendedprice")


QUERIES = {f.__name__: f for f in (
    supplier_spearman, supplier_pearson, supplier_ndcg, supplier_topk_recall, supplier_slope, method_metrics, sparse_method_metrics, metric_increments,
    contrast_summary, subgroup_metrics, role_concordance, assay_spearman, correlation_table, cluster_means, stratified_bootstrap,
    wild_cluster, group_bootstrap, bootstrap_spearman, environment_summary, supplier_order,
)}

r = S.rnd


def _spearman(rows: str, by: str, x: str, y: str) -> str:
    return f"""SELECT {by}, count(*) AS n_rows, {r(S.corr('rx', 'ry'), 'spearman')} FROM (
  SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2 AS rx,
   rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2 AS ry FROM {rows}) GROUP BY {by}"""


def _ndcg(rows: str, by: str, s: str, y: str, cut: str, name: str) -> str:
    d = f"CASE WHEN p <= {cut} THEN 1 / log2(p + 1) ELSE 0 END"
    return f"""SELECT {by}, {r('sum(dbar * (yy - low)) / nullif(sum(CASE WHEN q <= ' + cut + ' THEN (yy - low) / log2(q + 1) END), 0)', name)} FROM (
  SELECT *, avg({d}) OVER (PARTITION BY {by}, sc) AS dbar FROM (
   SELECT {by}, {s} AS sc, {y} AS yy, count(*) OVER (PARTITION BY {by}) AS n, min({y}) OVER (PARTITION BY {by}) AS low,
    row_number() OVER (PARTITION BY {by} ORDER BY {s} DESC, {S.KEY}) AS p, row_number() OVER (PARTITION BY {by} ORDER BY {y} DESC, {S.KEY}) AS q FROM {rows})) GROUP BY {by}"""


def entity_metrics_ctes(rows: str, by: str) -> str:
    """CTEs ending in ``em``; ``rows`` has (by, method, s, y, key)."""
    k = "greatest(1, ceil(n * 0.1::double))"
    g = f"{by}, method"
    return f"""
e1 AS (SELECT {g}, s, y, count(*) OVER w AS n, min(y) OVER w AS low, row_number() OVER (PARTITION BY {g} ORDER BY s DESC, {S.KEY}) AS p,
  row_number() OVER (PARTITION BY {g} ORDER BY y DESC, {S.KEY}) AS q,
  rank() OVER (PARTITION BY {g} ORDER BY s) + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2 AS rs,
  rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2 AS ry FROM {rows} WINDOW w AS (PARTITION BY {g})),
e2 AS (SELECT *, avg(1 / log2(p + 1)) OVER (PARTITION BY {g}, s) AS d, avg(CASE WHEN p <= {k} THEN 1 / log2(p + 1) ELSE 0 END) OVER (PARTITION BY {g}, s) AS dk FROM e1),
em AS (SELECT {g}, count(*) AS n_rows, {S.corr('rs', 'ry')} AS spearman, sum(d * (y - low)) / nullif(sum((y - low) / log2(q + 1)), 0) AS full_ndcg,
  sum(dk * (y - low)) / nullif(sum(CASE WHEN q <= {k} THEN (y - low) / log2(q + 1) END), 0) AS top_ndcg,
  count(*) FILTER (p <= {k} AND y > 0) / nullif(least(max({k}), count(*) FILTER (y > 0)), 0) AS top_recall,
  covar_pop(s, y) / nullif(var_pop(s), 0) AS slope FROM e2 GROUP BY {g})
"""


_ALL_METHODS = S.OBSERVED + """,
comp AS (SELECT *, l_quantity AS cq, l_discount * 100 AS cd, l_tax * 100 AS ct FROM obs),
ml AS (SELECT l_suppkey, y, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_tax, m.method, CASE m.method WHEN 'q' THEN cq WHEN 'q+d' THEN cq + cd WHEN 'q+t' THEN cq + ct ELSE cq + cd * 0.5::double + ct * 0.5::double END AS s
 FROM comp, (VALUES ('q'), ('q+d'), ('q+t'), ('q+d+t')) m(method))"""
_METHOD_SQL = _ALL_METHODS + "," + entity_metrics_ctes("ml", "l_suppkey")
_COLS = ("spearman", "full_ndcg", "top_ndcg", "top_recall")


def _strat(means: str, by: str, cl: str, st: str, b: int, seed: int, level: float = 0.95) -> str:
    """CTEs ending in ``ci`` for draws inside strata, from (by, cl, st, value)."""
    a = (1 - level) / 2
    return f"""
so AS (SELECT {by}, {st}, value, row_number() OVER (PARTITION BY {by}, {st} ORDER BY {cl}) AS j, count(*) OVER (PARTITION BY {by}, {st}) AS n FROM {means}),
sg AS (SELECT {by}, {st}, r, {S.mix('r', 'j', seed)} % n + 1 AS j FROM so, range(1, {b + 1}) t(r)),
sr AS (SELECT {by}, r, avg(value) AS m FROM sg JOIN so USING ({by}, {st}, j) GROUP BY ALL),
ci AS (SELECT {by}, quantile_cont(m, {a}) AS ci_low, quantile_cont(m, {1 - a}) AS ci_high FROM sr GROUP BY ALL),
pt AS (SELECT {by}, avg(value) AS estimate, avg((value > 0)::int) AS positive_fraction, count(*) FILTER (value > 0) AS positive_clusters,
 count(*) FILTER (value < 0) AS negative_clusters, count(*) FILTER (value = 0) AS zero_clusters, count(*) AS n_clusters,
 CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) END AS loo_min, CASE WHEN count(*) > 1 THEN (sum(value) - min(value)) / (count(*) - 1) END AS loo_max FROM {means} GROUP BY ALL)"""


_STRAT_OUT = ", ".join(r(c, c) for c in ("estimate", "positive_fraction", "loo_min", "loo_max", "ci_low", "ci_high")) + ", positive_clusters, negative_clusters, zero_clusters, n_clusters"


def _draws(names: str, by: str, cl: str, b: int, seed: int) -> str:
    """CTE ``dw``: (by, replicate, cl, w), replicate 0 being the data."""
    return f"""
dn AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {cl}) AS j, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {cl} FROM {names})),
dx AS (SELECT {by}, r AS replicate, {S.mix('r', 'j', seed)} % n + 1 AS j FROM dn, range(1, {b + 1}) t(r)),
dw AS (SELECT dx.{by}, replicate, {cl}, count(*) AS w FROM dx JOIN dn ON dx.{by} = dn.{by} AND dx.j = dn.j GROUP BY ALL UNION ALL SELECT {by}, 0, {cl}, 1 FROM dn)"""


def _wspear(rows: str, by: str, x: str, y: str, out: str) -> str:
    """CTE ``out``: weighted rank correlation of (by, replicate)."""
    g = f"{by}, replicate"
    rk = lambda c: (f"sum(w) OVER (PARTITION BY {g} ORDER BY {c} RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY {g}, {c}) - 1) / 2")
    return f"""
{out}k AS (SELECT {g}, w, {rk(x)} AS rx, {rk(y)} AS ry, sum(w) OVER (PARTITION BY {g}) AS tot FROM {rows}),
{out} AS (SELECT {g}, sum(w * (rx - (tot + 1) / 2) * (ry - (tot + 1) / 2)) / nullif(sqrt(sum(w * (rx - (tot + 1) / 2) ^ 2) * sum(w * (ry - (tot + 1) / 2) ^ 2)), 0) AS stat FROM {out}k GROUP BY ALL)"""


SQL = {
    "supplier_spearman": f"WITH {S.OBSERVED} " + _spearman("obs", "l_suppkey", "l_quantity", "y"),
    "supplier_pearson": f"WITH {S.OBSERVED} SELECT l_suppkey, {r(S.corr('l_quantity', 'y'), 'pearson')}, count(*) AS n_rows, {r('avg((sign(l_quantity - 25) = sign(y))::int)', 'sign_agreement')} FROM obs GROUP BY l_suppkey",
    "supplier_ndcg": f"WITH {S.OBSERVED}, a AS ({_ndcg('obs', 'l_suppkey', 'l_quantity', 'y', 'n', 'ndcg')}), b AS ({_ndcg('obs', 'l_suppkey', 'l_quantity', 'y', '10', 'ndcg_10')}) SELECT * FROM a JOIN b USING (l_suppkey)",
    "supplier_topk_recall": f"""WITH {S.OBSERVED}, t AS (SELECT l_suppkey, y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, {S.KEY}) AS p, greatest(1, ceil(count(*) OVER (PARTITION BY l_suppkey) * 0.1::double)) AS k FROM obs)
SELECT l_suppkey, {r('count(*) FILTER (p <= k AND y > 0) / nullif(least(max(k), count(*) FILTER (y > 0)), 0)', 'topk_recall')} FROM t GROUP BY l_suppkey""",
    "supplier_slope": f"""WITH {S.OBSERVED}, t AS (SELECT l_suppkey, regr_slope(y, l_quantity) AS a, regr_slope(y, l_quantity * (1 - l_discount)) AS b, {S.corr('l_quantity', 'y')} AS c FROM obs GROUP BY l_suppkey)
SELECT l_suppkey, {r('a', 'slope', 4)}, {r('c', 'standardized_slope', 4)}, {r('b', 'other_slope', 4)}, {r('abs(a - 1) - abs(b - 1)', 'error_reduction', 4)} FROM t""",
    "method_metrics": f"WITH {_METHOD_SQL} SELECT l_suppkey, method, n_rows, {', '.join(r(c, c) for c in (*_COLS, 'slope'))} FROM em",
    "sparse_method_metrics": f"WITH {_ALL_METHODS}, sl AS (SELECT * FROM ml WHERE (l_linenumber + length(method)) % 3 <> 0), {entity_metrics_ctes('sl', 'l_suppkey')} SELECT l_suppkey, method, n_rows, {', '.join(r(c, c) for c in (*_COLS, 'slope'))} FROM em",
    "metric_increments": f"WITH {_METHOD_SQL} SELECT a.l_suppkey, a.method, {', '.join(r(f'a.{c} - b.{c}', c) for c in _COLS)} FROM em a JOIN em b ON a.l_suppkey = b.l_suppkey AND b.method = 'q' WHERE a.method <> 'q'",
    "contrast_summary": f"""WITH {_METHOD_SQL},
reg AS (SELECT * FROM (VALUES ('d_over_base', 'q+d', 'q'), ('t_over_base', 'q+t', 'q'), ('both_over_d', 'q+d+t', 'q+d')) t(contrast, method, comparator)),
mg AS (SELECT contrast, a.l_suppkey, 's' || (a.l_suppkey % 3) AS stratum, a.spearman - b.spearman AS spearman, a.full_ndcg - b.full_ndcg AS full_ndcg FROM reg JOIN em a USING (method) JOIN em b ON a.l_suppkey = b.l_suppkey AND b.method = reg.comparator),
sc AS (SELECT *, 'all' AS scope FROM mg UNION ALL SELECT *, stratum FROM mg),
lm AS (SELECT contrast, scope, l_suppkey, stratum, 'spearman' AS metric, spearman AS value FROM sc UNION ALL SELECT contrast, scope, l_suppkey, stratum, 'full_ndcg', full_ndcg FROM sc),
{_strat('lm', 'contrast, scope, metric', 'l_suppkey', 'stratum', 200, 11)}
SELECT contrast, scope, metric, {_STRAT_OUT} FROM pt JOIN ci USING (contrast, scope, metric)""",
    "subgroup_metrics": f"""WITH {S.OBSERVED}, j AS (SELECT obs.*, p_type FROM obs JOIN part ON l_partkey = p_partkey),
ml AS (SELECT l_suppkey, 'p_type' AS dimension, p_type AS level, 'l_quantity' AS method, l_quantity AS s, y, {S.KEY} FROM j UNION ALL SELECT l_suppkey, 'l_linestatus', l_linestatus, 'l_quantity', l_quantity, y, {S.KEY} FROM j),
{entity_metrics_ctes('ml', 'l_suppkey, dimension, level')}
SELECT l_suppkey, dimension, level, method, n_rows, {', '.join(r(c, c) for c in (*_COLS, 'slope'))} FROM em WHERE n_rows >= 50""",
    "role_concordance": f"""WITH v AS (SELECT l_suppkey, l_partkey, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT a.l_suppkey, a.l_returnflag, a.v, b.v AS ref FROM v a JOIN v b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND b.l_returnflag = 'A' WHERE a.l_returnflag <> 'A'),
s AS ({_spearman('p', 'l_suppkey, l_returnflag', 'v', 'ref')}) SELECT s.*, m.mae FROM s JOIN (SELECT l_suppkey, l_returnflag, {r('avg(abs(v - ref))', 'mae')} FROM p GROUP BY ALL) m USING (l_suppkey, l_returnflag)""",
    "assay_spearman": f"WITH {S.OBSERVED}, s AS ({_spearman('obs', 'l_returnflag, l_suppkey', 'l_quantity', 'y')}) SELECT * FROM s WHERE n_rows >= 200",
    "correlation_table": f"""WITH {S.OBSERVED}, l AS (SELECT l_returnflag, xn AS x_name, yn AS y_name, CASE xn WHEN 'l_quantity' THEN l_quantity ELSE l_discount END AS x, CASE yn WHEN 'y' THEN y ELSE l_tax END AS yv
 FROM obs, (VALUES ('l_quantity'), ('l_discount')) a(xn), (VALUES ('y'), ('l_tax')) b(yn)) {_spearman('l', 'l_returnflag, x_name, y_name', 'x', 'yv')}""",
    "cluster_means": f"WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS v, count(*) AS k FROM lineitem GROUP BY ALL) SELECT l_returnflag, {r('avg(v)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters FROM m GROUP BY l_returnflag",
    "stratified_bootstrap": f"""WITH m AS (SELECT l_returnflag, l_suppkey, l_suppkey % 4 AS st, avg(l_quantity - 25.5::double) AS value FROM lineitem GROUP BY ALL),
{_strat('m', 'l_returnflag', 'l_suppkey', 'st', 300, 3)} SELECT l_returnflag, {_STRAT_OUT} FROM pt JOIN ci USING (l_returnflag)""",
    "wild_cluster": f"""WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity - 25.5::double) AS value, count(*) AS k FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) AS j, avg(value) OVER (PARTITION BY l_returnflag) AS mu FROM m),
f AS (SELECT l_returnflag, r, any_value(mu) + avg(CASE WHEN {S.mix('r', 'j', 5)} % 2 = 0 THEN value - mu ELSE mu - value END) AS v FROM o, range(1, 301) t(r) GROUP BY ALL),
ci AS (SELECT l_returnflag, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM f GROUP BY ALL),
loo AS (SELECT a.l_returnflag, a.l_suppkey, avg(b.value) AS v FROM m a JOIN m b ON a.l_returnflag = b.l_returnflag AND a.l_suppkey <> b.l_suppkey GROUP BY ALL),
jk AS (SELECT l_returnflag, sqrt((count(*) - 1) * var_pop(v)) AS se, min(v) AS a, max(v) AS b FROM loo GROUP BY ALL)
SELECT l_returnflag, {r('avg(value)', 'estimate')}, {r('any_value(se)', 'jackknife_se')}, {r('any_value(a)', 'loo_min')}, {r('any_value(b)', 'loo_max')}, {r('any_value(lo)', 'wild_ci_low')}, {r('any_value(hi)', 'wild_ci_high')},
 count(*) FILTER (value > 0) AS positive_clusters, count(*) FILTER (value < 0) AS negative_clusters, count(*) FILTER (value = 0) AS zero_clusters, count(*) AS n_clusters, sum(k)::bigint AS n_rows
FROM m JOIN ci USING (l_returnflag) JOIN jk USING (l_returnflag) GROUP BY l_returnflag""",
    "group_bootstrap": f"""WITH {_draws('lineitem', 'l_returnflag', 'l_suppkey', 500, 2)},
rw AS (SELECT l.l_returnflag, replicate, l_quantity, l_discount, l_extendedprice, w FROM lineitem l JOIN dw USING (l_returnflag, l_suppkey)),
{_wspear('rw', 'l_returnflag', 'l_quantity', 'l_extendedprice', 'sa')}, {_wspear('rw', 'l_returnflag', 'l_discount', 'l_extendedprice', 'sb')},
d AS (SELECT l_returnflag, replicate, sa.stat - sb.stat AS v FROM sa JOIN sb USING (l_returnflag, replicate))
SELECT l_returnflag, {r('max(v) FILTER (replicate = 0)', 'estimate')}, {r('quantile_cont(v, 0.05) FILTER (replicate > 0)', 'ci_low')}, {r('quantile_cont(v, 0.95) FILTER (replicate > 0)', 'ci_high')},
 any_value(n) AS n_rows, any_value(c) AS n_clusters FROM d JOIN (SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY ALL) USING (l_returnflag) GROUP BY l_returnflag""",
    "bootstrap_spearman": f"""WITH o AS (SELECT o_orderstatus, c_nationkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey), {_draws('o', 'o_orderstatus', 'c_nationkey', 500, 4)},
rw AS (SELECT o.*, replicate, w FROM o JOIN dw USING (o_orderstatus, c_nationkey)), {_wspear('rw', 'o_orderstatus', 'c_acctbal', 'o_totalprice', 'sa')}
SELECT o_orderstatus, {r('max(stat) FILTER (replicate = 0)', 'estimate')}, {r('quantile_cont(stat, 0.05) FILTER (replicate > 0)', 'ci_low')}, {r('quantile_cont(stat, 0.95) FILTER (replicate > 0)', 'ci_high')},
 any_value(n) AS n_rows, any_value(c) AS n_clusters FROM sa JOIN (SELECT o_orderstatus, count(*) AS n, count(DISTINCT c_nationkey) AS c FROM o GROUP BY ALL) USING (o_orderstatus) GROUP BY o_orderstatus""",
    "environment_summary": f"""WITH l AS (SELECT l_linenumber, l_suppkey, l_quantity - 25.5::double AS gap, 'l_returnflag' AS environment_axis, l_returnflag AS environment FROM lineitem
 UNION ALL SELECT l_linenumber, l_suppkey, l_quantity - 25.5::double, 'l_linestatus', l_linestatus FROM lineitem),
m AS (SELECT l_linenumber || '|' || environment_axis || '|' || environment AS g, l_linenumber, environment_axis, environment, l_suppkey, avg(gap) AS value, count(*) AS k FROM l GROUP BY ALL), {S.bootstrap('m', 'g', 'l_suppkey', 50, 9)}
SELECT l_linenumber, environment_axis, environment, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters, {r('any_value(ci_low)', 'ci_low')}, {r('any_value(ci_high)', 'ci_high')} FROM m JOIN ci USING (g) GROUP BY ALL""",
    "supplier_order": f"""SELECT l_suppkey, pos, n_group, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {S.KEY}) AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n_group FROM lineitem) WHERE pos <= 3""",
}
