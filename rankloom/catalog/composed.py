"""Whole jobs on the driver tables. The stored vectors stand for scores: three
slices are scorers, the label is the entity, the row order the position."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.ranked import _strat, entity_metrics_ctes
from rankloom.catalog.scoring import _jsd, _spear
from rankloom.catalog.data import long_scorers, r6, rounded, scorers, table
from rankloom.catalog.fitted import P, Q, _rows
from rankloom.catalog.selection import _similar
from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators import contracts as K
from rankloom.operators import inference as I
from rankloom.operators.similarity import similarity_join
from rankloom.plans import jobs as Jb
from rankloom.session import settle

# Replicate counts of the job queries.
FAST = dict(replicates=500, seed=1)


def _positions(spark, sf):
    cls = lambda m, names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("vec_id") % m + 1).cast("int"))
    return scorers(spark, sf).select(
        F.col("vec_id").alias("state_id"), (F.col("vec_id") % 50).alias("position"), F.col("label").alias("domain_id"), F.col("native").alias("native_idx"),
        F.lit("main").alias("analysis_role"), F.when(F.col("vec_id") % 2 == 0, "on_policy").otherwise("model_aware").alias("state_kind"),
        (F.col("vec_id") % 3 * 0.05 + 0.05).alias("level"), cls(3, ["buried", "intermediate", "exposed"]).alias("burial"), cls(4, ["helix", "strand", "turn_or_coil", "helix"]).alias("secondary_structure"))


def _scores(spark, sf):
    paired = long_scorers(spark, sf).select(F.col("vec_id").alias("state_id"), (F.col("vec_id") % 50).alias("position"), F.col("scorer").alias("teacher_id"), F.lit("paired").alias("structure_role"), "logp")
    decoy = paired.where("teacher_id <> 'base'").withColumn("structure_role", F.lit("matched")).withColumn("logp", V.temper("logp", 2.0))
    # Another decoy role, which decides nothing.
    other = paired.where("teacher_id <> 'base'").withColumn("structure_role", F.lit("global")).withColumn("logp", V.temper("logp", 8.0))
    return paired.unionByName(decoy).unionByName(other)


AX = ["burial", "secondary_structure"]


def _value(spark, sf):
    return Jb.job_teacher_value(_scores(spark, sf).where("teacher_id <> 'base' OR structure_role = 'paired'"), _positions(spark, sf), "base", decoys=["matched", "global"], axes=AX, **FAST)


def registry_job(spark, sf):
    d = table(spark, sf, "documents").withColumn("class_h", F.concat("lang", "source")).withColumnRenamed("doc_id", "domain_id").select("domain_id", "text", "class_h", "n_chars")
    b = d.join(table(spark, sf, "labels").where("toxic = 1").withColumnRenamed("doc_id", "domain_id"), "domain_id", "left_semi").withColumnRenamed("domain_id", "benchmark_id")
    hits = similarity_join(b, d, qid="benchmark_id", tid="domain_id", qseq="text", tseq="text", k=8, min_fraction=0.5)
    out = Jb.job_registry(d, b, hits.select("domain_id", "benchmark_id", "sequence_identity", "query_coverage", "target_coverage"), [("short", F.col("n_chars") >= 300)], exact=[("exact_sequence", ["text"])], classes=[("same_class", "class_h")])
    return out["summary"]


def teacher_value_job(spark, sf):
    return rounded(_value(spark, sf)["environment_summary"])


def scorer_agreement_job(spark, sf):
    return rounded(_value(spark, sf)["agreement"])


def _observability(spark, sf):
    d = _rows(spark, sf).select("vec_id", F.col("label").alias("domain_id"), "x", "base", "sa").join(
        _positions(spark, sf).select(F.col("state_id").alias("vec_id"), "analysis_role", "state_kind", "level", *AX), "vec_id")
    return Jb.job_observability(d, "domain_id", features="x", sequence="base", teacher="sa", p=P, q=Q, folds=5, alpha=1.0, key=["vec_id"], numeric=F.col("vec_id"),
                                repeats=1, labels=["analysis_role", "state_kind", "level"], axes=AX, **FAST)


def observability_job(spark, sf):
    return rounded(_observability(spark, sf)["summary"])


def _on_policy(spark, sf):
    pos = Jb._scored_positions(_scores(spark, sf).where("structure_role = 'paired'"), _positions(spark, sf), "base").where("teacher_id = 'sa'").withColumn("student_top1_gap", V.top_gap("logp"))
    st = scorers(spark, sf).select(F.col("vec_id").alias("state_id"), F.col("label").alias("domain_id"), F.when(F.col("vec_id") % 2 == 0, "on_policy").otherwise("model_aware").alias("state_kind"),
                                   F.lit(0.05).alias("level"), V.entropy("base").alias("student_entropy"))
    return Jb.job_on_policy(pos, st, treat_kind="on_policy", control_kind="model_aware", match=["student_entropy"], edited=F.lit(True), **FAST)


def on_policy_job(spark, sf):
    return rounded(_on_policy(spark, sf)["effects"])


def foundation_job(spark, sf):
    val, obs, pol = _value(spark, sf), _observability(spark, sf), _on_policy(spark, sf)
    long = A.melt(_positions(spark, sf), ["analysis_role", "state_kind", "level"], AX)
    rel = long.groupBy(*A.MAP_KEYS).agg(F.avg("level").alias("scaffold_reliability"))
    pooled = settle(I.cluster_bootstrap(val["position_metrics"].where("structure_role = 'paired'"), ["teacher_id"], "native_logp", "domain_id", **FAST))
    cover = pooled.select("teacher_id", F.lit("complete").alias("status"))
    out = Jb.job_foundation(val, obs, pol, rel, cover, pooled, primary="sa", baseline="base", matched="matched", **FAST)
    return out["decision"]


def _variants(spark, sf):
    mut = (F.col("vec_id") * 7 % 20 + 1).cast("int")
    return scorers(spark, sf).select("vec_id", "label", (F.col("label") % 2).alias("stratum"), F.col("native").alias("wild_idx"), mut.alias("mut_idx"),
                                     (F.element_at("sb", mut) - F.element_at("sb", F.col("native"))).alias("observed")).where("mut_idx <> wild_idx")


def panel_job(spark, sf):
    p = table(spark, sf, "part")
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("position"))
    hits = p.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") + 1).alias("target_id"), F.lit(0.9).alias("sequence_identity"), F.lit(1.0).alias("query_coverage"), (F.col("p_size") / 50).alias("target_coverage"))
    out = Jb.job_panel(p, v, hits, id="p_partkey", sequence="p_name", rules=[("size", F.col("p_size") > 5), ("price", F.col("p_retailprice") > 905)], stratum="p_type", cluster=None,
                       order=["p_retailprice"], quota=10)
    return out["queries"]


def transfer_job(spark, sf):
    d = _rows(spark, sf).withColumn("base_action", V.anchor("base", "native"))
    out = Jb.job_transfer(d.where("vec_id % 2 = 0"), d.select("vec_id", "x", "base_action"), _variants(spark, sf), x="x", target="y", base="base_action", p=P, q=Q, rank=4, alpha=10.0,
                          key=["vec_id"], entity="label", on=["vec_id"], **FAST)
    return rounded(out["summary"])


def counterfactual_job(spark, sf):
    vec = scorers(spark, sf).withColumn("rewired", V.temper("sa", 1.5))
    out = Jb.job_counterfactual(vec.select("vec_id", "label", "base", "sa", "rewired"), _variants(spark, sf).drop("label_"), paired="sa", conditions=["rewired"], base="base", key=["vec_id"],
                                entity="label", position="vec_id", stratum="stratum", numeric=F.col("vec_id"), repeats=2, on=["vec_id"], **FAST)
    return rounded(out["summary"])


def action_validation_job(spark, sf):
    d = _rows(spark, sf).withColumn("base_action", V.anchor("base", "native"))
    panel = d.where("split = 'locked'")
    out = Jb.job_action_validation(d.where("split <> 'locked'"), panel, _variants(spark, sf), x="x", action="action", base_action="base_action", native="native", split="split", p=P,
                                   key=["vec_id"], entity="label", stratum="stratum", on=["vec_id"], ranks=(2, 4), alphas=(1.0, 10.0), **FAST)
    return rounded(out["summary"])


def stability_job(spark, sf):
    s = scorers(spark, sf).withColumns({c + "_a": V.anchor(c, "native") for c in ("base", "sa", "sb")})
    parts = F.element_at(F.array(*[F.lit(p) for p in ("train", "validation", "locked_test")]), (F.col("vec_id") % 3 + 1).cast("int"))
    out = Jb.job_stability(s.withColumn("split", parts), s.select("vec_id", "base_a", "sa_a", "sb_a"), _variants(spark, sf).withColumn("pos", F.col("vec_id") % 10), base="base", base_action="base_a",
                           scorers=["sa_a", "sb_a"], native="native", key=["vec_id"], entity="label", stratum="stratum", position="pos", on=["vec_id"], group_replicates=500, **FAST)
    return rounded(out["summary"])


def external_job(spark, sf):
    li = table(spark, sf, "lineitem")
    meas = li.select("l_suppkey", "l_partkey", (-F.col("l_extendedprice")).alias("ddg"))
    pred = li.groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    out = Jb.job_external(pred, meas, {"q": {"q": 1.0}, "qd": {"q": 1.0, "d": 100.0}}, [("d_over_q", "qd", "q")], entity="l_suppkey", key=["l_partkey"], value="ddg",
                          min_entities=10, primary="d_over_q", **FAST)
    return rounded(out["gates"])


def structure_job(spark, sf):
    s = scorers(spark, sf)
    acts = s.select("label", F.col("vec_id").alias("position"), F.explode(F.array(F.struct(F.lit("experimental").alias("role"), V.anchor("sa", "native").alias("v")),
                    F.struct(F.lit("predicted").alias("role"), V.anchor(V.temper("sa", 1.3), "native").alias("v")))).alias("r")).select("label", "position", "r.*")
    e = V.as_double("embedding")
    xyz = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("position"), F.lit("predicted").alias("role"),
                                                *[(F.element_at(e, i + 1) * 20).alias("a" + a) for i, a in enumerate("xyz")], *[(F.element_at(e, i + 1) * 20 + F.element_at(e, i + 4)).alias("b" + a) for i, a in enumerate("xyz")])
    out = Jb.job_structure(acts, _variants(spark, sf).withColumnRenamed("vec_id", "position").drop("stratum"), xyz, role="role", ref="experimental", entity="label", position="position", vec="v", key=["position"], **FAST)
    return rounded(out["geometry_summary"])


QUERIES = {f.__name__: f for f in (
    registry_job, teacher_value_job, scorer_agreement_job, observability_job, on_policy_job, foundation_job, panel_job, transfer_job, counterfactual_job,
    action_validation_job, stability_job, external_job, structure_job,
)}
r = S.rnd
_EXT = f"""p AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS q, avg(l_discount) AS d, quantile_cont(l_extendedprice, 0.5) AS y FROM lineitem GROUP BY ALL),
ml AS (SELECT l_suppkey, l_partkey, 0 AS l_orderkey, 0 AS l_linenumber, 0 AS l_shipdate, 0 AS l_tax, y, method, CASE method WHEN 'q' THEN q ELSE q + d * 100 END AS s FROM p, (VALUES ('q'), ('qd')) v(method)),
{entity_metrics_ctes('ml', 'l_suppkey')},
mg AS (SELECT a.l_suppkey, 'all' AS st, a.spearman - b.spearman AS sp, a.top_ndcg - b.top_ndcg AS tn FROM em a JOIN em b ON a.l_suppkey = b.l_suppkey AND a.method = 'qd' AND b.method = 'q'),
lm AS (SELECT metric, l_suppkey, st, value FROM (SELECT 'spearman' AS metric, l_suppkey, st, sp AS value FROM mg UNION ALL SELECT 'top_ndcg', l_suppkey, st, tn FROM mg) WHERE value IS NOT NULL),
{_strat('lm', 'metric', 'l_suppkey', 'st', 500, 1)}"""
_ENVROWS = """ps AS (SELECT vec_id, label, vec_id % 3 * 0.05::double + 0.05::double AS level, CASE WHEN vec_id % 2 = 0 THEN 'on_policy' ELSE 'model_aware' END AS state_kind, ['buried', 'intermediate', 'exposed'][vec_id % 3 + 1] AS burial, ['helix', 'strand', 'turn_or_coil', 'helix'][vec_id % 4 + 1] AS ss FROM embeddings)"""

SQL = {
    "registry_job": """WITH t AS (SELECT doc_id, text, lang || source AS h, n_chars FROM documents), k AS (SELECT * FROM t WHERE n_chars >= 300), b AS (SELECT t.* FROM t JOIN labels USING (doc_id) WHERE toxic = 1),
bq AS (SELECT doc_id AS id, text FROM b), dt AS (SELECT doc_id AS id, text FROM documents),""" + _similar("bq", "dt", 8, 0.5) + """,
rl AS (SELECT doc_id, 'exact' AS b, 'exact_sequence' AS reason FROM k WHERE text IN (SELECT text FROM b) AND trim(text) <> '' UNION ALL SELECT t, q::varchar, 'sequence_identity' FROM hit WHERE sequence_identity >= 0.3 AND t IN (SELECT doc_id FROM k) UNION ALL SELECT doc_id, '*', 'same_class' FROM k WHERE h IN (SELECT h FROM b))
SELECT 'total' AS measure, count(*) AS n FROM k UNION ALL SELECT 'excluded', count(DISTINCT doc_id) FROM rl UNION ALL SELECT 'eligible', (SELECT count(*) FROM k) - (SELECT count(DISTINCT doc_id) FROM rl) UNION ALL SELECT 'relations_' || reason, count(*) FROM rl GROUP BY reason""",
    "teacher_value_job": f"""WITH {S.LONG_SCORERS}, {_ENVROWS}, a AS (SELECT l.scorer AS teacher_id, l.vec_id, l.label, l.logp[l.native] - b.logp[b.native] AS adv FROM long l JOIN long b ON l.vec_id = b.vec_id AND b.scorer = 'base' WHERE l.scorer <> 'base'),
x AS (SELECT a.*, level, state_kind, ax AS environment_axis, CASE ax WHEN 'burial' THEN burial ELSE ss END AS environment FROM a JOIN ps USING (vec_id), (VALUES ('burial'), ('secondary_structure')) v(ax)),
m AS (SELECT teacher_id || '|' || state_kind || '|' || round(level, 2) || '|' || environment_axis || '|' || environment AS g, teacher_id, state_kind, round(level, 2) AS lv, environment_axis, environment, label, avg(adv) AS value, count(*) AS k FROM x GROUP BY ALL), {S.bootstrap('m', 'g', 'label', 500, 1)}
SELECT 'main' AS analysis_role, teacher_id, 'paired' AS structure_role, state_kind, {r('lv', 'level')}, environment_axis, environment, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters,
 CASE WHEN count(*) > 1 THEN {r('any_value(ci_low)', 'x').rsplit(' AS ', 1)[0]} END AS ci_low, CASE WHEN count(*) > 1 THEN {r('any_value(ci_high)', 'x').rsplit(' AS ', 1)[0]} END AS ci_high FROM m JOIN ci USING (g) GROUP BY teacher_id, state_kind, lv, environment_axis, environment""",
    "scorer_agreement_job": f"""WITH {S.LONG_SCORERS}, x AS (SELECT l.scorer AS left_teacher_id, p.scorer AS right_teacher_id, l.label, {_jsd('l.logp', 'p.logp')} AS jsd, {_spear('l.logp', 'p.logp')} AS rank_agreement FROM long l JOIN long p ON l.vec_id = p.vec_id AND l.scorer < p.scorer),
u AS (UNPIVOT x ON jsd, rank_agreement INTO NAME metric VALUE v), m AS (SELECT left_teacher_id || right_teacher_id || metric AS g, left_teacher_id, right_teacher_id, metric, label, avg(v) AS value, count(*) AS k FROM u GROUP BY ALL), {S.bootstrap('m', 'g', 'label', 500, 1)}
SELECT left_teacher_id, right_teacher_id, metric, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters, {r('any_value(ci_low)', 'ci_low')}, {r('any_value(ci_high)', 'ci_high')} FROM m JOIN ci USING (g) GROUP BY ALL""",
    "external_job": f"""WITH {_EXT}, gt AS (SELECT * FROM (VALUES ('minimum_evaluable_domains', 'spearman', 'n_clusters', '>=', 10.0::double), ('spearman_gap_ci_lower_positive', 'spearman', 'ci_low', '>', 0.0), ('positive_spearman_domain_fraction', 'spearman', 'positive_fraction', '>=', 0.5), ('ndcg10_gap_point_positive', 'top_ndcg', 'estimate', '>', 0.0)) v(gate, metric, field, op, threshold)),
gv AS (SELECT gt.*, CASE field WHEN 'n_clusters' THEN n_clusters WHEN 'ci_low' THEN ci_low WHEN 'positive_fraction' THEN positive_fraction ELSE estimate END AS value FROM gt JOIN pt USING (metric) JOIN ci USING (metric))
SELECT gate, 'd_over_q' AS contrast, metric, field, op, {r('threshold', 'threshold')}, {r('value', 'value')}, CASE op WHEN '>' THEN value > threshold ELSE value >= threshold END AS passed FROM gv""",
}
