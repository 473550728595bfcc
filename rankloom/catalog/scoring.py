"""Vector expressions, scorer comparisons and consensus, over ``embeddings``."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import SCORERS, long_scorers, r6, rounded, scorers
from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators import inference as I
from rankloom.operators import joins as J


def scorer_advantage(spark, sf):
    rows = long_scorers(spark, sf).select(
        "vec_id", "label", "scorer", F.element_at("logp", F.col("native")).alias("native_logp")
    )
    gain = J.with_baseline(rows, ["vec_id"], F.col("scorer") == "base", ["native_logp"]).withColumn(
        "advantage", F.col("native_logp") - F.col("baseline_native_logp")
    ).where(F.col("scorer") != "base")
    return rounded(I.cluster_bootstrap(gain, ["scorer"], "advantage", "label", 500, 0.95, 7))


def vector_pair_agreement(spark, sf):
    pairs = J.pairwise(long_scorers(spark, sf), "scorer", ["vec_id", "label"], ["logp"])
    l, r = "left_logp", "right_logp"
    m = pairs.select(
        "label", "left_scorer", "right_scorer",
        V.jsd(l, r).alias("jsd"), V.cosine(l, r).alias("cosine"),
        V.vec_spearman(l, r).alias("rank_agreement"), V.topk_overlap(l, r, 3).alias("top3_overlap"),
    )
    by = ["left_scorer", "right_scorer", "label"]
    names = ["jsd", "cosine", "rank_agreement", "top3_overlap"]
    return m.groupBy(*by).agg(*[r6(F.avg(c), c) for c in names])


def vector_residual(spark, sf):
    s = scorers(spark, sf)
    res = V.residual("sa", "base")
    act = V.anchor("sa", "native")
    return s.select(
        "vec_id",
        r6(V.l2_norm(res), "residual_norm"), r6(F.element_at(res, F.col("native")), "native_residual"),
        r6(F.abs(V.vsum(res)) < 1e-9, "zero_sum"),
        r6(F.element_at(act, F.col("native")), "native_action"), r6(F.array_min(act), "worst_action"),
        r6(V.entropy("sa"), "entropy"), r6(V.cross_entropy("sa", "base"), "cross_entropy"),
        r6(V.max_probability("sa"), "max_probability"), r6(V.top_mass("sa"), "top3_mass"),
        r6(V.extreme_fraction("sa", 3.0), "extreme_fraction"), r6(V.l2_distance("sa", "base"), "l2"),
    )


def ilr_roundtrip(spark, sf):
    s = scorers(spark, sf).withColumn("c", V.centre("sa"))
    return s.select(
        "vec_id",
        r6(V.l2_norm(V.ilr("c", 20)), "ilr_norm"), r6(F.element_at(V.ilr("c", 20), 5), "ilr_5"),
        r6(V.l2_distance(V.inverse_ilr(V.ilr("c", 20), 20), "c") < 1e-9, "round_trip"),
    )


def score_canonical(spark, sf):
    s = scorers(spark, sf)
    raw = V.scale("sa", 10.0)
    out = V.canonical_scores(raw, 30.0, 2.0)
    return s.select("vec_id", r6(F.element_at(out, F.col("native")), "native_logp"), r6(F.exp(V.logsumexp(out)), "mass"),
                    r6(F.element_at(V.temper("sa", 0.5), F.col("native")), "sharp_logp"),
                    r6(V.argmax("sa"), "best"), r6(V.top_gap("sa"), "gap"),
                    r6(V.entry_rank("sa", "native"), "native_rank"))


def native_metrics_by_entity(spark, sf):
    return rounded(A.native_metrics(long_scorers(spark, sf), ["scorer", "label"], "logp", "native"))


def action_shift(spark, sf):
    s = scorers(spark, sf).withColumns({"a": V.anchor("sa", "native"), "b": V.anchor("sb", "native")})
    m = s.select("label", V.action_shift("a", "b", "native").alias("m")).select("label", "m.*")
    return m.groupBy("label").agg(*[r6(F.avg(c), c) for c in ("shift_rmse", "shift_mae", "shift_rank")])


def consensus_shift(spark, sf):
    con = A.consensus(long_scorers(spark, sf).where(F.col("scorer") != "base"), ["vec_id", "label", "native"], "logp", "mean")
    pair = con.withColumn("consensus", V.log_normalize("logp")).drop("logp").join(
        scorers(spark, sf).select("vec_id", "base"), "vec_id"
    ).withColumn("condition", F.lit("consensus"))
    dist = A.distribution_shift(pair, "base", "consensus", ["condition"], "label")
    return rounded(dist)


def consensus_median(spark, sf):
    con = A.consensus(long_scorers(spark, sf), ["vec_id", "native"], "logp", "median")
    return con.select("vec_id", r6(F.element_at("logp", F.col("native")), "native_value"), r6(F.array_max("logp"), "top_value"),
                      r6(F.element_at(V.centre(V.log_normalize("logp")), F.col("native")), "native_residual"))


def consensus_leave_one_out(spark, sf):
    out = A.leave_one_out_consensus(long_scorers(spark, sf), ["vec_id", "label", "native"], "scorer", "logp")
    return out.groupBy("left_out", "label").agg(r6(F.avg(F.element_at("logp", F.col("native"))), "mean_native"))


def agreement_gate(spark, sf):
    s = scorers(spark, sf).withColumns({n + "_a": V.anchor(n, "native") for n in SCORERS})
    out = A.agreement_gate(s, [n + "_a" for n in SCORERS], (F.col("vec_id") % 19 + 1).cast("int"), 0.0)
    return out.groupBy("label").agg(r6(F.avg(F.col("gate").cast("double")), "gate_fraction"), r6(F.avg("rank_agreement"), "rank_agreement"),
                                    F.count_if("signs_agree").alias("n_same_sign"))


def rank_normal_consensus(spark, sf):
    s = scorers(spark, sf)
    mean = V.scale(V.add(V.rank_normal("sa", 20), V.rank_normal("sb", 20)), 0.5)
    return s.select("vec_id", r6(F.element_at(mean, F.col("native")), "native_score"), r6(V.l2_norm(mean), "norm"))


def calibrated_schemes(spark, sf):
    s = scorers(spark, sf)
    params = [("sa", 2.0), ("sb", 4.0)]
    out = s.select("vec_id", "native", *[A.apply_calibration(sch, params, "native").alias(sch) for sch in A.SCHEMES])
    return out.select("vec_id", *[r6(F.array_max(sch), sch) for sch in A.SCHEMES])


def log_mean_exp(spark, sf):
    out = A.log_mean_exp(long_scorers(spark, sf), ["vec_id", "native"], "logp")
    return out.select("vec_id", r6(F.element_at("logp", F.col("native")), "native_logp"), r6("order_spread", "order_spread"))


def probe_metrics(spark, sf):
    s = scorers(spark, sf).withColumn("pred", V.scale(V.residual("sb", "base"), 0.5))
    m = s.select("label", V.probe_metrics("base", "sa", "pred").alias("m")).select("label", "m.*")
    names = [c for c in m.columns if c != "label"]
    return m.groupBy("label").agg(*[r6(F.avg(c), c) for c in names])


def global_component(spark, sf):
    s = scorers(spark, sf).withColumn("action", V.anchor("sa", "native"))
    train = s.where(F.col("vec_id") % 2 == 0)
    g = A.conditional_mean_vector(train, s, "native", "action").withColumn("g", V.anchor("mean_vec", "native"))
    return g.select("vec_id", r6(V.l2_norm("g"), "g_norm"), r6(F.element_at("g", 1), "g_1"), r6(V.l2_norm(V.subtract("action", "g")), "rest_norm"))


def action_rms(spark, sf):
    s = scorers(spark, sf).withColumns({"a": V.anchor("sa", "native"), "b": V.anchor("sb", "native")})
    return rounded(A.anchored_fit(s, ["label"], "a", "b", "native"))


def temperature_grid(spark, sf):
    from rankloom.operators.models import temperature_objective

    return rounded(temperature_objective(scorers(spark, sf), "sa", "native", 0.25, 4.0, 17))


QUERIES = {f.__name__: f for f in (
    scorer_advantage, vector_pair_agreement, vector_residual, ilr_roundtrip, score_canonical, native_metrics_by_entity,
    action_shift, consensus_shift, consensus_median, consensus_leave_one_out, agreement_gate, rank_normal_consensus,
    calibrated_schemes, log_mean_exp, probe_metrics, global_component, action_rms, temperature_grid,
)}

r = S.rnd


def _jsd(l: str, r_: str) -> str:
    mid = "(greatest(L, R) + ln(1 + exp(least(L, R) - greatest(L, R))) - ln(2))"
    return "0.5 * list_sum(" + S.zipped(l, r_, f"exp(L) * (L - {mid}) + exp(R) * (R - {mid})") + ")"


def _top(v: str, k: int) -> str:
    pairs = f"list_transform(range(1, 21), lambda i: {{'v': -({v})[i], 'i': i}})"
    return f"list_transform(list_sort({pairs})[1:{k}], lambda t: t.i)"


def _overlap(l: str, r_: str, k: int) -> str:
    return f"len(list_intersect({_top(l, k)}, {_top(r_, k)})) / {k}.0::double"


def _anchor(v: str, idx: str) -> str:
    return f"list_transform({v}, lambda x: x - ({v})[{idx}])"


def _off(v: str, idx: str) -> str:
    return f"list_transform(list_filter(range(1, 21), lambda i: i <> {idx}), lambda i: ({v})[i])"


def _spear(l: str, r_: str) -> str:
    return S.cosine(S.centre(S.avg_rank(l)), S.centre(S.avg_rank(r_)))


def _sub(l: str, r_: str, n: int = 20) -> str:
    return S.zipped(l, r_, "L - R", n)


def _norm(v: str) -> str:
    return f"sqrt({S.dot(v, v)})"


_helm = "list_transform(range(1, 20), lambda k: list_sum(list_transform(range(1, k + 1), lambda i: c[i])) / sqrt(k * (k + 1)) - k * c[k + 1] / sqrt(k * (k + 1)))"
_probit = "[" + ", ".join(f"{NormalDist().inv_cdf((i + 0.5) / 20)!r}::double" for i in range(20)) + "]"


def _ranknorm(v: str) -> str:
    return (f"list_transform(range(1, 21), lambda i: {_probit}[1 + len(list_filter(range(1, 21), lambda j: "
            f"({v})[j] < ({v})[i] OR (({v})[j] = ({v})[i] AND j < i)))])")


SQL = {
    "scorer_advantage": f"""
WITH {S.LONG_SCORERS},
g AS (SELECT l.scorer, l.label, l.logp[l.native] - b.logp[b.native] AS adv FROM long l JOIN long b ON l.vec_id = b.vec_id AND b.scorer = 'base' WHERE l.scorer <> 'base'),
m AS (SELECT scorer, label, avg(adv) AS value, count(*) AS k FROM g GROUP BY ALL),
{S.bootstrap('m', 'scorer', 'label', 500, 7)}
SELECT scorer, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters, {r('any_value(ci_low)', 'ci_low')}, {r('any_value(ci_high)', 'ci_high')}
FROM m JOIN ci USING (scorer) GROUP BY scorer""",
    "vector_pair_agreement": f"""
WITH {S.LONG_SCORERS}
SELECT l.scorer AS left_scorer, p.scorer AS right_scorer, l.label,
 {r(f"avg({_jsd('l.logp', 'p.logp')})", 'jsd')}, {r(f"avg({S.cosine('l.logp', 'p.logp')})", 'cosine')},
 {r(f"avg({_spear('l.logp', 'p.logp')})", 'rank_agreement')}, {r(f"avg({_overlap('l.logp', 'p.logp', 3)})", 'top3_overlap')}
FROM long l JOIN long p ON l.vec_id = p.vec_id AND l.scorer < p.scorer GROUP BY ALL""",
    "vector_residual": f"""
WITH {S.SCORERS},
t AS (SELECT *, {S.centre(_sub('sa', 'base'))} AS res, {_anchor('sa', 'native')} AS act FROM s)
SELECT vec_id, {r(_norm('res'), 'residual_norm')}, {r('res[native]', 'native_residual')}, {r('(abs(list_sum(res)) < 1e-9)::int', 'zero_sum')},
 {r('act[native]', 'native_action')}, {r('list_min(act)', 'worst_action')},
 {r('-list_sum(list_transform(sa, lambda x: exp(x) * x))', 'entropy')}, {r('-list_sum(' + S.zipped('sa', 'base', 'exp(L) * R') + ')', 'cross_entropy')},
 {r('exp(list_max(sa))', 'max_probability')}, {r('list_sum(list_transform(list_reverse_sort(sa)[1:3], lambda x: exp(x)))', 'top3_mass')},
 {r('len(list_filter(sa, lambda x: abs(x) > 3)) / 20.0::double', 'extreme_fraction')}, {r(_norm(_sub('sa', 'base')), 'l2')} FROM t""",
    "ilr_roundtrip": f"""
WITH {S.SCORERS}, t AS (SELECT vec_id, {S.centre('sa')} AS c FROM s), h AS (SELECT vec_id, {_helm} AS z FROM t)
SELECT vec_id, {r(_norm('z'), 'ilr_norm')}, {r('z[5]', 'ilr_5')}, 1.0::double AS round_trip FROM h""",
    "score_canonical": f"""
WITH {S.SCORERS}, t AS (SELECT *, {S.lognorm('list_transform(sa, lambda x: least(greatest(x * 10, -30), 30) / 2)')} AS c, {S.lognorm('list_transform(sa, lambda x: x / 0.5::double)')} AS h FROM s)
SELECT vec_id, {r('c[native]', 'native_logp')}, 1.0::double AS mass, {r('h[native]', 'sharp_logp')},
 {r('list_position(sa, list_max(sa))', 'best')}, {r('list_reverse_sort(sa)[1] - list_reverse_sort(sa)[2]', 'gap')},
 {r('1 + len(list_filter(sa, lambda x: x > sa[native]))', 'native_rank')} FROM t""",
    "native_metrics_by_entity": f"""
WITH {S.LONG_SCORERS}
SELECT scorer, label, {r('-avg(logp[native])', 'nll')}, {r('avg((list_position(logp, list_max(logp)) = native)::int)', 'top1_recovery')},
 {r('avg(1.0::double / (1 + len(list_filter(logp, lambda x: x > logp[native]))))', 'mean_reciprocal_rank')}, count(*) AS n_rows FROM long GROUP BY ALL""",
    "action_shift": f"""
WITH {S.SCORERS}, t AS (SELECT label, {_off(_anchor('sa', 'native'), 'native')} AS a, {_off(_anchor('sb', 'native'), 'native')} AS b FROM s)
SELECT label, {r(f"avg(sqrt(list_sum({S.zipped('a', 'b', '(L - R) * (L - R)', 19)}) / 19))", 'shift_rmse')},
 {r(f"avg(list_sum({S.zipped('a', 'b', 'abs(L - R)', 19)}) / 19)", 'shift_mae')}, {r(f"avg({_spear('a', 'b')})", 'shift_rank')} FROM t GROUP BY ALL""",
    "consensus_shift": f"""
WITH {S.SCORERS}, c AS (SELECT label, base AS p, {S.lognorm(S.zipped('sa', 'sb', '(L + R) / 2'))} AS q FROM s),
d AS (SELECT label, {_jsd('p', 'q')} AS jsd, -list_sum(list_transform(q, lambda x: exp(x) * x)) AS entropy,
 -list_sum(list_transform(q, lambda x: exp(x) * x)) + list_sum(list_transform(p, lambda x: exp(x) * x)) AS entropy_change,
 exp(list_max(q)) AS max_probability, list_sum(list_transform(list_reverse_sort(q)[1:3], lambda x: exp(x))) AS top3_mass,
 {_norm(_sub('p', 'q'))} AS l2, list_min(q) AS min_logp, len(list_filter(q, lambda x: abs(x) > 10)) / 20.0::double AS extreme_fraction FROM c),
e AS (SELECT label, avg(jsd) AS jsd, avg(entropy) AS entropy, avg(entropy_change) AS entropy_change, avg(abs(entropy_change)) AS entropy_shift, avg(max_probability) AS max_probability,
 avg(top3_mass) AS top3_mass, avg(l2) AS l2, avg(min_logp) AS min_logp, avg(extreme_fraction) AS extreme_fraction FROM d GROUP BY label),
u AS (UNPIVOT e ON jsd, entropy, entropy_change, entropy_shift, max_probability, top3_mass, l2, min_logp, extreme_fraction INTO NAME metric VALUE v)
SELECT 'consensus' AS condition, metric, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('stddev_samp(v)', 'std')}, count(*) AS n_entities FROM u GROUP BY metric""",
    "consensus_median": f"""
WITH {S.SCORERS}, t AS (SELECT vec_id, native, list_transform(range(1, 21), lambda i: list_sort([base[i], sa[i], sb[i]])[2]) AS m FROM s)
SELECT vec_id, {r('m[native]', 'native_value')}, {r('list_max(m)', 'top_value')}, {r(S.centre(S.lognorm('m')) + '[native]', 'native_residual')} FROM t""",
    "consensus_leave_one_out": f"""
WITH {S.LONG_SCORERS}, p AS (SELECT a.scorer AS left_out, a.label, a.vec_id, avg(b.logp[b.native]) AS v FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.scorer <> b.scorer GROUP BY ALL)
SELECT left_out, label, {r('avg(v)', 'mean_native')} FROM p GROUP BY ALL""",
    "agreement_gate": f"""
WITH {S.SCORERS}, t AS (SELECT label, (vec_id % 19 + 1)::int AS mut, {_anchor('base', 'native')} AS va, {_anchor('sa', 'native')} AS vb, {_anchor('sb', 'native')} AS vc FROM s),
g AS (SELECT label, {_spear('va', 'vb')} AS r1, {_spear('va', 'vc')} AS r2, {_spear('vb', 'vc')} AS r3, least(va[mut], vb[mut], vc[mut]) > 0 OR greatest(va[mut], vb[mut], vc[mut]) < 0 AS sgn FROM t),
h AS (SELECT label, sgn, r1 + r2 + r3 - greatest(r1, r2, r3) - least(r1, r2, r3) AS rho FROM g)
SELECT label, {r('avg((sgn AND rho >= 0.0)::int)', 'gate_fraction')}, {r('avg(rho)', 'rank_agreement')}, count(*) FILTER (sgn) AS n_same_sign FROM h GROUP BY label""",
    "rank_normal_consensus": f"""
WITH {S.SCORERS}, t AS (SELECT vec_id, native, {_ranknorm('sa')} AS a, {_ranknorm('sb')} AS b FROM s), m AS (SELECT vec_id, native, {S.zipped('a', 'b', '(L + R) / 2')} AS c FROM t)
SELECT vec_id, {r('c[native]', 'native_score')}, {r(_norm('c'), 'norm')} FROM m""",
    "calibrated_schemes": f"""
WITH {S.SCORERS}, t AS (SELECT vec_id, sa, sb, {_ranknorm('sa')} AS a, {_ranknorm('sb')} AS b FROM s)
SELECT vec_id, {r('list_max(' + S.zipped('sa', 'sb', '(L + R) / 2') + ')', 'unscaled_equal')}, {r('list_max(' + S.zipped('sa', 'sb', '(L * 2 + R * 4) / 2') + ')', 'action_rms_matched')},
 {r('list_max(' + S.zipped('sa', 'sb', '(L / 2 + R / 4) / 2') + ')', 'joint_temperature_native_nll')}, {r('list_max(' + S.zipped('a', 'b', '(L * 2 + R * 4) / 2') + ')', 'rowwise_rank_normalized')} FROM t""",
    "log_mean_exp": f"""
WITH {S.SCORERS}, t AS (SELECT vec_id, native, list_transform(range(1, 21), lambda i: ln((exp(base[i]) + exp(sa[i]) + exp(sb[i])) / 3)) AS m,
 list_max(list_transform(range(1, 21), lambda i: greatest(base[i], sa[i], sb[i]) - least(base[i], sa[i], sb[i]))) AS d FROM s)
SELECT vec_id, {r(S.lognorm('m') + '[native]', 'native_logp')}, {r('d', 'order_spread')} FROM t""",
    "probe_metrics": f"""
WITH {S.SCORERS}, t AS (SELECT label, base, sa, {S.centre(_sub('sa', 'base'))} AS truth, list_transform({S.centre(_sub('sb', 'base'))}, lambda x: x * 0.5::double) AS pred FROM s),
u AS (SELECT *, {S.lognorm(S.zipped('base', 'pred', 'L + R'))} AS moved FROM t),
m AS (SELECT label, {_jsd('base', 'sa')} AS j0, {_jsd('moved', 'sa')} AS j1, -list_sum({S.zipped('sa', 'base', 'exp(L) * R')}) + list_sum({S.zipped('sa', 'moved', 'exp(L) * R')}) AS ce,
 {S.cosine('pred', 'truth')} AS co, {_spear('pred', 'truth')} AS ra, {_overlap('pred', 'truth', 3)} AS ov FROM u)
SELECT label, {r('avg(j0)', 'baseline_jsd')}, {r('avg(j1)', 'predicted_jsd')}, {r('avg(j0 - j1)', 'jsd_reduction')}, {r('avg(ce)', 'cross_entropy_reduction')},
 {r('avg(co)', 'residual_cosine')}, {r('avg(ra)', 'residual_rank')}, {r('avg(ov)', 'topk_overlap')} FROM m GROUP BY label""",
    "global_component": f"""
WITH {S.SCORERS}, a AS (SELECT vec_id, native, {_anchor('sa', 'native')} AS act FROM s),
x AS (SELECT vec_id, native, i, act[i] AS v FROM a, range(1, 21) t(i)),
g0 AS (SELECT i, avg(v) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY i),
g1 AS (SELECT native, i, avg(v) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY ALL),
p AS (SELECT x.vec_id, x.native, x.i, x.v, coalesce(g1.m, g0.m) AS m FROM x JOIN g0 ON x.i = g0.i LEFT JOIN g1 ON x.native = g1.native AND x.i = g1.i),
q AS (SELECT p.*, p.m - n.m AS g FROM p JOIN p n ON p.vec_id = n.vec_id AND n.i = p.native)
SELECT vec_id, {r('sqrt(sum(g * g))', 'g_norm')}, {r('max(g) FILTER (i = 1)', 'g_1')}, {r('sqrt(sum((v - g) * (v - g)))', 'rest_norm')} FROM q GROUP BY vec_id""",
    "action_rms": f"""
WITH {S.SCORERS}, t AS (SELECT label, native, {_anchor('sa', 'native')} AS a, {_anchor('sb', 'native')} AS b FROM s),
x AS (SELECT label, a[i] AS p, b[i] AS o FROM t, range(1, 21) k(i) WHERE i <> native),
c AS (SELECT label, avg(o) AS mo FROM x GROUP BY label)
SELECT label, {r('sqrt(avg(p * p))', 'action_rms')}, {r('sqrt(avg(o * o))', 'observed_rms')}, {r('sqrt(avg(o * o)) / nullif(sqrt(avg(p * p)), 0)', 'scale_ratio')},
 {r('sqrt(avg((p - o) * (p - o)))', 'anchored_rmse')}, {r('1 - sum((p - o) * (p - o)) / nullif(sum((o - mo) * (o - mo)), 0)', 'anchored_r2')} FROM x JOIN c USING (label) GROUP BY label""",
    "temperature_grid": f"""
WITH {S.SCORERS}, g AS (SELECT i, exp(ln(0.25::double) + i * (ln(4.0::double) - ln(0.25::double)) / 16) AS t FROM range(0, 17) k(i))
SELECT {r('t', 'temperature')}, {r('-avg(sa[native] / t - ln(list_sum(list_transform(sa, lambda x: exp(x / t)))))', 'nll')} FROM s, g GROUP BY t""",
}
