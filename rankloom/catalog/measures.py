"""Contracts, comparisons, summaries and decisions over the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import KEY, SCORERS, long_scorers, observed, r6, rounded, scorers, table
from rankloom.catalog.ranked import ENTITY, _METHOD_SQL, _metrics, entity_metrics_ctes
from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators import contracts as K
from rankloom.operators import decisions as D
from rankloom.operators import inference as I
from rankloom.operators import joins as J
from rankloom.operators import methods as M
from rankloom.session import settle
from rankloom.sources import tables as T


def contract_violations(spark, sf):
    li = table(spark, sf, "lineitem")
    s = scorers(spark, sf)
    a = K.violations(li, {"quantity_range": K.range_rule("l_quantity", 1, 40, True), "discount_range": K.range_rule("l_discount", 0, 0.05),
                          "flag_alphabet": K.alphabet_rule("l_returnflag", "AR")})
    b = K.violations(s, {"normalised": K.logp_rule("sa", 20)})
    c = K.violations(table(spark, sf, "documents"), {"length_column": K.length_rule("text", "n_chars")})
    return a.unionByName(b).unionByName(c)


def repeated_keys(spark, sf):
    return K.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def sequence_rows(spark, sf):
    t = table(spark, sf, "conversations").select(F.expr("conv_id * 100 + turn").alias("id"), "text")
    rows = t.select("id", "text", F.explode(F.expr("sequence(0, length(text) - 1)")).alias("position"))
    letter = F.substring("text", F.col("position") + 1, F.lit(1))
    bad = rows.select("id", "position", F.when((F.col("id") % 7 == 0) & (F.col("position") == 3), "#").otherwise(letter).alias("symbol")).where(
        ~((F.col("id") % 11 == 0) & (F.col("position") == 0)))
    return K.check_sequence_rows(t, bad, "id", "text", "position", "symbol")


def key_coverage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return K.check_coverage(o, li, ["k"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def request_coverage(spark, sf):
    req = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), (F.col("o_custkey") % 4 + 2).alias("len"))
    raw = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rid"), (F.col("l_linenumber") - 1).alias("pos"))
    return K.check_request_coverage(raw, req, "rid", "pos", "len")


def coverage_audit(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("teacher_id"), F.col("l_linestatus").alias("structure_role"), "l_orderkey")
    req = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("structure_role"), F.lit(2).alias("len"))
    sup = spark.createDataFrame([(t, s, t == "A") for t in "ANRX" for s in "OF"], "teacher_id string, structure_role string, required boolean")
    return rounded(K.coverage_audit(li, req, sup, ["structure_role"], "len", 0.9))


def resume_requests(spark, sf):
    req = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
    parts = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("request_id"))
    left = T.pending_requests(req, parts)
    both = T.finalize_parts(req, req.withColumn("score", F.col("request_id") % 7))
    return left.withColumn("state", F.lit("pending")).withColumn("score", F.lit(None).cast("long")).unionByName(both.withColumn("state", F.lit("final")))


def decoy_rules(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("decoy_id"), F.col("o_custkey").alias("domain_id"), (F.col("o_orderstatus") != "P").alias("has_coordinates"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("decoy_id"), F.col("l_linenumber").alias("position"))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id"), (F.col("c_nationkey") % 5 + 1).alias("length"))
    return K.validate_decoys(d, rows, e)


def request_roles(spark, sf):
    return K.validate_requests(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O"])


def table_differences(spark, sf):
    a = table(spark, sf, "part")
    b = a.where("p_size <> 7").withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_size") == 9, 0.5).otherwise(1e-14))
    return K.tables_equal(a, b, ["p_partkey"], 1e-9)


def table_digest(spark, sf):
    """The digest does not change with row order or partitioning, and does with content."""
    t = table(spark, sf, "orders")
    m = lambda d: T.table_manifest(d, "p").select("rows", "digest")
    a, b = m(t), m(t.repartition(7).orderBy("o_custkey")).withColumnRenamed("digest", "other")
    c = m(t.withColumn("o_orderstatus", F.lower("o_orderstatus"))).withColumnRenamed("digest", "changed")
    return a.join(b, "rows").join(c, "rows").select("rows", (F.col("digest") == F.col("other")).alias("same"), (F.col("digest") != F.col("changed")).alias("differs"))


def paired_lift(spark, sf):
    rows = long_scorers(spark, sf).select("vec_id", "label", F.col("scorer").alias("role"), F.element_at("logp", F.col("native")).alias("v"))
    out = J.paired_lift(rows, ["vec_id", "label"], "role", "sa", ["base", "sb"], "v")
    return rounded(I.cluster_bootstrap(out, ["decoy_role"], "lift", "label", 100, 0.95, 21))


def role_deltas(spark, sf):
    m = A.native_metrics(long_scorers(spark, sf), ["scorer", "label"], "logp", "native")
    return rounded(J.role_deltas(m, "scorer", "base", ["label"], ["nll", "top1_recovery"]))


def star_assembly(spark, sf):
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    out = J.assemble(li, [(part, ["l_partkey"]), (sup, ["l_suppkey"])])
    return out.groupBy("p_type", "nation").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("p_size"), "mean_size"))


def split_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    sp = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return J.split_overlap(d, sp, "doc_id").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


def opened_registry(spark, sf):
    d = table(spark, sf, "documents")
    out = J.opened_registry({"even": d.where("doc_id % 2 = 0"), "odd": d.where("doc_id % 2 = 1"), "benchmark": table(spark, sf, "benchmark")}, "text")
    return out.groupBy("source", "n_sources").agg(F.count(F.lit(1)).alias("n"))


def request_fanout(spark, sf):
    st = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("state_id"), "o_custkey")
    c = table(spark, sf, "customer")
    roles = c.select(F.col("c_custkey").alias("o_custkey"), F.lit("paired").alias("structure_role"), F.col("c_custkey").cast("string").alias("structure_id")).unionByName(
        c.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("matched").alias("structure_role"), F.col("c_nationkey").cast("string").alias("structure_id")))
    return J.build_requests(st, roles, "o_custkey").select("request_id", "structure_role")


def variant_actions(spark, sf):
    s = scorers(spark, sf)
    v = s.select("vec_id", "native", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("mut")).where("mut <> native")
    out = J.variant_action(v, s, ["vec_id"], "sa", "mut", "native")
    return out.select("vec_id", "mut", r6("action", "action"))


def lookup_actions(spark, sf):
    """Matrix and profile log-odds actions; the matrix is another scorer's class mean."""
    s = scorers(spark, sf)
    m = s.select(F.col("native").alias("wild"), F.posexplode("sb").alias("i", "v")).groupBy("wild", (F.col("i") + 1).alias("mut")).agg(F.avg("v").alias("score"))
    v = s.select("vec_id", "native", (F.col("vec_id") * 3 % 20 + 1).cast("int").alias("mutant"), F.transform("sa", lambda x: F.exp(x)).alias("profile"))
    out = M.matrix_action(v, m, "native", "mutant").withColumn("profile_action", M.profile_action("profile", F.col("native"), F.col("mutant")))
    return out.select("vec_id", r6("matrix_action", "matrix_action"), r6("profile_action", "profile_action"))


def conservation_attach(spark, sf):
    res = table(spark, sf, "part").select("p_partkey", "p_type")
    cons = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("conservation_score"))
    return J.attach_conservation(res, cons, ["p_partkey"]).groupBy("conservation_class").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("conservation_score"), "mean_score"))


def remapped_effects(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_discount").alias("effect"))
    nb = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("position"))
    return J.remap_positions(li, nb, ["l_partkey"], "position", "effect").groupBy("position").agg(r6(F.avg("effect"), "mean_effect"), F.count(F.lit(1)).alias("n"))


def routing_diagnostic(spark, sf):
    return rounded(J.routing_diagnostic(_metrics(spark, sf), {"base": "q", "gated": "q+d", "full": "q+d+t"}, ENTITY, ["spearman", "top_ndcg"]))


def state_metrics(spark, sf):
    s = scorers(spark, sf).withColumns({"gain": F.element_at("sa", F.col("native")) - F.element_at("base", F.col("native")), "gap": V.top_gap("base")})
    return rounded(A.state_metrics(s, ["label"], V.argmax("base") != F.col("native"), "gain", "gap", 0.1))


def cost_audit(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return rounded(A.cost_summary(e.withColumn("calls", F.lit(1)).withColumn("res", F.col("event_id") % 50 + 1), ["day"], "user_id", ["event_type"], "value", "calls", "res"))


def variant_coverage(spark, sf):
    li = table(spark, sf, "lineitem")
    known = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    done = table(spark, sf, "part").where("p_size <= 30 OR p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return rounded(A.variant_coverage(li, known, done, ["l_returnflag", "l_linestatus"], ["l_partkey"]))


def collapse_measurements(spark, sf):
    return rounded(A.collapse_measurements(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"], "l_discount"))


def condition_validity(spark, sf):
    s = scorers(spark, sf)
    per = s.select("label", *[F.struct(F.lit(n).alias("condition"), V.jsd("base", n).alias("jsd"), F.abs(V.entropy(n) - V.entropy("base")).alias("entropy_shift"), V.vec_spearman("base", n).alias("rho")).alias(n) for n in ("sa", "sb")])
    long = per.select("label", F.explode(F.array("sa", "sb")).alias("c")).select("label", "c.*").groupBy("condition", "label").agg(*[F.avg(c).alias(c) for c in ("jsd", "entropy_shift", "rho")])
    return rounded(A.condition_validity(long, ["condition"], "label", "rho", 0.1, 0.25, 0.8, -0.5))


def control_gaps(spark, sf):
    m = settle(_metrics(spark, sf)).select("l_suppkey", F.when(F.col("method") == "q", "observed").otherwise(F.col("method")).alias("control"), "full_ndcg", (F.length("method") % 2).alias("rep"), F.lit("all").alias("model"))
    return rounded(A.control_gaps(m, ["model"], "l_suppkey", "control", "observed", "full_ndcg", "rep"))


def geometry_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.geometry_summary(li, ["l_returnflag"], "l_suppkey", ["l_quantity", "l_tax"], replicates=50, seed=6))


def role_availability(spark, sf):
    return A.role_availability(table(spark, sf, "documents"), ["source", "lang"], "n_chars", 6)


def figure_source(spark, sf):
    li = table(spark, sf, "lineitem")
    q = A.figure_source(li, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    wide = A.pivot_first(li.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v")), ["l_returnflag"], "l_linestatus", "v", ["F", "O"])
    return rounded(K.union_loose([q, wide]))


SUBSETS = ["q", "d", "t"]


def shapley(spark, sf):
    """Value of each component to the mean rank gain over all component sets."""
    o = observed(spark, sf).withColumns({"q": F.col("l_quantity"), "d": F.col("l_discount") * 100, "t": F.col("l_tax") * 100})
    value = {m: sum((F.col(SUBSETS[i]) for i in range(3) if m >> i & 1), F.lit(0.0)) * F.col("y") for m in range(8)}
    means = o.groupBy("l_returnflag").agg(*[(F.avg(value[m]) / 1e4).alias(str(m)) for m in range(8)]).unpivot(["l_returnflag"], [str(m) for m in range(8)], "mask", "value").withColumn("mask", F.col("mask").cast("int"))
    return rounded(A.shapley(means, SUBSETS, ["l_returnflag"]))


def _map(spark, sf):
    """Value, specificity, observability and reliability per line-item class."""
    li = table(spark, sf, "lineitem").withColumns({"analysis_role": F.lit("main"), "state_kind": F.col("l_linestatus"), "level": F.col("l_tax").cast("double"), "environment_axis": F.lit("flag"), "environment": F.col("l_returnflag")})
    k = A.MAP_KEYS
    g = settle(li.groupBy(*k).agg((F.avg("l_quantity") - 25.5).alias("estimate"), (F.avg("l_quantity") - 25.4).alias("ci_low"), (F.avg("l_discount") * 10 - 0.5).alias("lift"), (F.avg("l_linenumber") - 4).alias("jsd_reduction"), F.avg("l_discount").alias("residual_cosine"), F.count(F.lit(1)).cast("double").alias("scaffold_reliability")))
    return A.distillability_map(g.select(*k, "estimate", "ci_low"), g.select(*k, "lift").where("lift > -0.05"), g.select(*k, "jsd_reduction", "residual_cosine").where("level > 0.01"), g.select(*k, "scaffold_reliability"), min_cosine=0.05)


def distillability_map(spark, sf):
    return rounded(_map(spark, sf))


def valid_radius(spark, sf):
    return rounded(A.valid_radius(settle(_map(spark, sf)), ["analysis_role", "environment_axis", "environment"]))


def identity_checks(spark, sf):
    s = scorers(spark, sf).withColumns({"res": V.residual("sa", "base"), "act": V.anchor("sa", "native")})
    out = K.quality_controls(s, {"zero_sum": V.vsum("res"), "anchored": F.element_at("act", F.col("native")), "not_an_identity": F.array_max("act")})
    return out.select("check", "passed", "threshold")


def action_gates(spark, sf):
    m = settle(_metrics(spark, sf))
    inc = settle(I.summarize(m, ["method"], ["spearman", "full_ndcg"], "l_suppkey", replicates=100, seed=2))
    reg = D.gate_registry(spark, ["method", "metric"], [
        ("q_rank_positive", "q", "spearman", "estimate", ">", 0.0), ("d_gain_high", "q+d", "full_ndcg", "estimate", ">=", 0.85),
        ("t_ci", "q+t", "full_ndcg", "ci_low", ">", 0.8), ("unknown", "none", "spearman", "estimate", ">", 0.0)])
    return rounded(D.gate_table(inc, reg, ["method", "metric"], ["estimate", "ci_low", "n_clusters"]))


def gate_outcome(spark, sf):
    return D.gate_decision(action_gates(spark, sf), "CONFIRMED", "PARTIAL", "NOT_CONFIRMED", ["d_gain_high"])


def branch_outcome(spark, sf):
    """Criteria from line-item classes, then the ordered branch."""
    li = table(spark, sf, "lineitem").withColumn("gap", F.col("l_quantity") - 25.0)
    flags = settle(I.cluster_bootstrap(li, ["l_returnflag"], "gap", "l_suppkey", 100, 0.95, 4))
    pick = lambda f: flags.where(F.col("l_returnflag") == f)
    rad = settle(A.valid_radius(_map(spark, sf), ["analysis_role", "environment_axis", "environment"])).select(
        F.lit("burial").alias("environment_axis"), F.when(F.col("environment") == "A", "buried").otherwise("x").alias("environment"), "valid_radius")
    access = flags.select(F.when(F.col("l_returnflag") == "A", "observed").otherwise("shuffled").alias("control"), F.lit("jsd_reduction").alias("metric"), (F.col("estimate") - F.when(F.col("l_returnflag") == "A", 0.0).otherwise(9.0)).alias("estimate"), "ci_low", "ci_high", "n_rows", "n_clusters").unionByName(
        pick("A").select(F.lit("observed").alias("control"), F.lit("residual_cosine").alias("metric"), F.lit(0.5).alias("estimate"), "ci_low", "ci_high", "n_rows", "n_clusters"))
    crit = D.union_criteria([
        D.criterion(pick("A"), D.CORE, 0.02), D.criterion(pick("N"), D.REGULAR, 0.02), D.criterion(pick("R"), D.SPECIFIC, 0.02),
        D.criterion(pick("A"), D.ASSAY, 0.05), D.access_criterion(access), D.count_criterion(flags, D.ENVIRONMENT, F.col("estimate") > 0.02, 1),
        D.radius_criterion(rad), D.consistency_criterion(flags), D.criterion(pick("Z"), D.ON_POLICY, 0.01)])
    return D.decide(settle(crit))


def probe_status(spark, sf):
    s = scorers(spark, sf)
    rows = None
    for control, rep, col in (("observed", 0, "sa"), ("shuffled", 1, "sb"), ("shuffled", 2, "base"), ("intercept", 1, "base"), ("intercept", 2, "sb")):
        m = s.select("label", F.lit(control).alias("control"), F.lit(rep).alias("repeat"), V.probe_metrics("base", "sa", V.scale(V.residual(col, "base"), 0.5)).alias("m")).select("label", "control", "repeat", "m.jsd_reduction", "m.residual_cosine")
        rows = m if rows is None else rows.unionByName(m)
    w = I.summarize(settle(rows).withColumn("cl", F.col("label")), ["label", "control", "repeat"], ["jsd_reduction", "residual_cosine"], "cl", method="wild", replicates=10)
    summ = w.withColumn("wild_ci_low", F.coalesce("wild_ci_low", "estimate"))
    out = D.probe_decision(summ, ["label"], ["shuffled", "intercept"], 2)
    return rounded(out.drop("jsd_ci_low"))


def environment_overview(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linestatus").alias("state_kind"), (F.col("l_quantity") - 25.5).alias("gap"), F.lit("flag").alias("environment_axis"), F.col("l_returnflag").alias("environment"))
    envs = spark.createDataFrame([("e1", "F", "flag", "A"), ("e2", "O", "flag", "R"), ("e3", "O", "flag", "Q")], "environment_id string, state_kind string, environment_axis string, environment string")
    return rounded(D.environment_overview(li, envs, ["state_kind"], "l_suppkey", "gap", replicates=50, seed=3))


def completion_record(spark, sf):
    m = settle(A.native_metrics(long_scorers(spark, sf), ["scorer"], "logp", "native"))
    picks = {f"{s}_nll": (F.col("scorer") == s, "nll") for s in SCORERS}
    return rounded(D.completion_state(m, picks, decision="COMPLETE"))


def criterion_export(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("gap", F.col("l_quantity") - 25.0)
    c = D.criterion(I.cluster_bootstrap(li, [], "gap", "l_suppkey", 100, 0.95, 4), D.CORE, 0.02)
    out = T.result_table(c.select("criterion", "status", F.round("estimate", 4).alias("estimate"), "n_rows"), {"data_mode": "real"}, ["n_rows"])
    return out


def assay_scan(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("protein"), F.when(F.col("l_linenumber") == 1, "wt").when(F.col("l_linenumber") == 2, "insA").otherwise(F.concat(F.lit("A"), F.col("l_partkey").cast("string"), F.lit("G"))).alias("mut"),
                     "l_partkey", F.when(F.col("l_tax") == 0, "NA").otherwise(F.col("l_discount").cast("string")).alias("effect"), F.col("l_returnflag").alias("seq"), F.col("l_linestatus").alias("cluster"))
    return T.scan_assay(rows, "protein", "mut", "l_partkey", "effect", "seq", "cluster")


def packed_scores(spark, sf):
    wide = T.unpack(scorers(spark, sf).select("vec_id", "sa"), "sa", "logp_", [str(i) for i in range(20)])
    back = T.pack(wide, "logp_", [str(i) for i in range(20)], "sa")
    return back.select("vec_id", r6(V.vsum("sa"), "total"), r6(F.element_at("sa", 20), "last"))


def scope_filter(spark, sf):
    d = table(spark, sf, "orders")
    a = K.decision_scope(d, "F", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("F"))
    b = K.decision_scope(d, "all", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("all"))
    c = K.decision_scope(d, "F", "absent").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("absent"))
    return a.unionByName(b).unionByName(c)


def state_keys(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", K.state_id(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderkey") % 40 / 40, F.col("o_orderkey") % 12).alias("state_id"))


QUERIES = {f.__name__: f for f in (
    contract_violations, repeated_keys, sequence_rows, key_coverage, request_coverage, coverage_audit, resume_requests, decoy_rules, request_roles,
    table_differences, table_digest, paired_lift, role_deltas, star_assembly, split_overlap, opened_registry, request_fanout, variant_actions,
    lookup_actions, conservation_attach, remapped_effects, routing_diagnostic, state_metrics, cost_audit, variant_coverage, collapse_measurements,
    condition_validity, control_gaps, geometry_summary, role_availability, figure_source, shapley, distillability_map, valid_radius,
    identity_checks, action_gates, gate_outcome, branch_outcome, probe_status, environment_overview, completion_record, criterion_export, assay_scan,
    packed_scores, scope_filter, state_keys,
)}

r = S.rnd


def _jsd(l: str, q: str) -> str:
    mid = "(greatest(L, R) + ln(1 + exp(least(L, R) - greatest(L, R))) - ln(2))"
    return "0.5 * list_sum(" + S.zipped(l, q, f"exp(L) * (L - {mid}) + exp(R) * (R - {mid})") + ")"


_ENT = "-list_sum(list_transform({v}, lambda x: exp(x) * x))"
_GK = "'main' AS analysis_role, l_linestatus AS state_kind, l_tax AS level, 'flag' AS environment_axis, l_returnflag AS environment"
_MAPSQL = f"""g AS (SELECT {_GK}, avg(l_quantity) - 25.5::double AS estimate, avg(l_quantity) - 25.4::double AS ci_low, avg(l_discount) * 10 - 0.5::double AS lift0, avg(l_linenumber) - 4 AS jr, avg(l_discount) AS rc, count(*)::double AS scaffold_reliability FROM lineitem GROUP BY ALL),
mp0 AS (SELECT analysis_role, state_kind, level, environment_axis, environment, estimate, ci_low, CASE WHEN lift0 > -0.05::double THEN lift0 END AS lift, CASE WHEN level > 0.01::double THEN jr END AS jsd_reduction, CASE WHEN level > 0.01::double THEN rc END AS residual_cosine, scaffold_reliability FROM g),
mp AS (SELECT *, estimate >= 0.02::double AND ci_low > 0 AS high_action_value, coalesce(lift >= 0.02::double, false) AS target_specific, coalesce(jsd_reduction >= 0.01::double AND residual_cosine >= 0.05::double, false) AS sequence_observable FROM mp0)"""


def _boot_means(by: str, expr: str, b: int, seed: int, src: str = "lineitem", cl: str = "l_suppkey") -> str:
    return f"m AS (SELECT {by}, {cl}, avg({expr}) AS value, count(*) AS k FROM {src} GROUP BY ALL), {S.bootstrap('m', by, cl, b, seed)}"


_FLAGS = _boot_means("l_returnflag", "l_quantity - 25.0::double", 100, 4) + ", fl AS (SELECT l_returnflag AS f, avg(value) AS e, any_value(ci_low) AS lo FROM m JOIN ci USING (l_returnflag) GROUP BY ALL)"
_METS = [("spearman", "spearman"), ("full_ndcg", "full_ndcg")]
_SUMM = f"""{_METHOD_SQL}, lm AS (SELECT method || '|' || metric AS g, method, metric, l_suppkey, value FROM (SELECT method, l_suppkey, 'spearman' AS metric, spearman AS value FROM em UNION ALL SELECT method, l_suppkey, 'full_ndcg', full_ndcg FROM em) WHERE value IS NOT NULL),
{S.bootstrap('lm', 'g', 'l_suppkey', 100, 2)}, sm AS (SELECT method, metric, avg(value) AS estimate, any_value(ci_low) AS ci_low FROM lm JOIN ci USING (g) GROUP BY ALL),
gt AS (SELECT * FROM (VALUES ('q_rank_positive', 'q', 'spearman', 'estimate', '>', 0.0::double), ('d_gain_high', 'q+d', 'full_ndcg', 'estimate', '>=', 0.85), ('t_ci', 'q+t', 'full_ndcg', 'ci_low', '>', 0.8), ('unknown', 'none', 'spearman', 'estimate', '>', 0.0)) v(gate, method, metric, field, op, threshold)),
gv AS (SELECT gate, gt.method, gt.metric, field, op, threshold, CASE field WHEN 'estimate' THEN estimate ELSE ci_low END AS value FROM gt LEFT JOIN sm ON gt.method = sm.method AND gt.metric = sm.metric),
gp AS (SELECT *, coalesce(CASE op WHEN '>' THEN value > threshold ELSE value >= threshold END, false) AS passed FROM gv)"""
_SHAP = "sv AS (SELECT l_returnflag, " + ", ".join(f"avg(({' + '.join((['cq', 'cd', 'ct'][i] for i in range(3) if m >> i & 1)) or '0'}) * y) / 1e4 AS v{m}" for m in range(8)) + " FROM (SELECT *, l_quantity AS cq, l_discount * 100 AS cd, l_tax * 100 AS ct FROM obs) GROUP BY l_returnflag)"


def _shap(i: int, name: str) -> str:
    terms = []
    for m in range(8):
        if not m >> i & 1:
            k = bin(m).count("1")
            w = {0: 2, 1: 1, 2: 2}[k]
            terms.append(f"{w} * (v{m | 1 << i} - v{m})")
    return f"SELECT l_returnflag, '{name}' AS scorer, {r('(' + ' + '.join(terms) + ') / 6', 'shapley')} FROM sv"


SQL = {
    "contract_violations": f"""WITH {S.SCORERS} SELECT 'quantity_range' AS rule, count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 40 AND floor(l_quantity) = l_quantity)) AS n_violations FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05::double) FROM lineitem
UNION ALL SELECT 'flag_alphabet', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM lineitem UNION ALL SELECT 'normalised', count(*) FILTER (abs(ln(list_sum(list_transform(sa, lambda x: exp(x))))) > 1e-5) FROM s UNION ALL SELECT 'length_column', count(*) FILTER (length(text) <> n_chars) FROM documents""",
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "sequence_rows": """WITH t AS (SELECT conv_id * 100 + turn AS id, text FROM conversations)
SELECT id, CASE WHEN id % 11 = 0 THEN 'not_contiguous' ELSE 'letters_differ' END AS reason FROM t WHERE id % 11 = 0 OR (id % 7 = 0 AND substr(text, 4, 1) <> '#')""",
    "key_coverage": """WITH o AS (SELECT o_orderkey AS k, count(*) AS a FROM orders GROUP BY ALL), l AS (SELECT l_orderkey AS k, count(*) AS f FROM lineitem GROUP BY ALL), b AS (SELECT CASE WHEN f IS NULL THEN 'missing' WHEN a IS NULL THEN 'unrequested' WHEN f > a THEN 'repeated' END AS problem FROM o FULL JOIN l USING (k))
SELECT problem, count(*) AS n FROM b WHERE problem IS NOT NULL GROUP BY ALL""",
    "request_coverage": """WITH q AS (SELECT o_orderkey AS rid, o_custkey % 4 + 2 AS len FROM orders), w AS (SELECT l_orderkey AS rid, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) - 1 AS lo, max(l_linenumber) - 1 AS hi FROM lineitem GROUP BY ALL)
SELECT rid, coalesce(n, 0) AS n_rows, CASE WHEN len IS NULL THEN 'unrequested' WHEN n IS NULL THEN 'missing' WHEN n <> len OR d <> n THEN 'wrong_rows' WHEN lo <> 0 OR hi <> len - 1 THEN 'wrong_positions' ELSE 'complete' END AS status FROM q FULL JOIN w USING (rid)""",
    "coverage_audit": f"""WITH q AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS structure_role, count(*) * 2 AS e, count(*) AS k FROM orders GROUP BY ALL), w AS (SELECT l_returnflag AS t, l_linestatus AS s, count(*) AS o FROM lineitem GROUP BY ALL),
x AS (SELECT t.t AS teacher_id, s.s AS structure_role, t.t = 'A' AS required FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(t), (VALUES ('O'), ('F')) s(s))
SELECT teacher_id, structure_role, required, coalesce(e, 0)::bigint AS expected_rows, coalesce(k, 0) AS expected_requests, coalesce(o, 0) AS observed_rows, {r('coalesce(o, 0) / e', 'fraction')}, CASE WHEN coalesce(o, 0) / e >= 0.9::double THEN 'complete' WHEN required THEN 'fail' ELSE 'partial' END AS status
FROM x LEFT JOIN q USING (structure_role) LEFT JOIN w ON w.t = teacher_id AND w.s = structure_role""",
    "resume_requests": "SELECT o_orderkey AS request_id, 'pending' AS state, NULL::bigint AS score FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT o_orderkey, 'final', o_orderkey % 7 FROM orders",
    "decoy_rules": """WITH n AS (SELECT l_orderkey AS k, count(*) AS c, count(DISTINCT l_linenumber) AS p FROM lineitem GROUP BY ALL), j AS (SELECT o_orderstatus <> 'P' AS h, c_nationkey % 5 + 1 AS len, coalesce(c, 0) AS c, coalesce(p, 0) AS p FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON k = o_orderkey)
SELECT 'rows_per_position' AS rule, count(*) FILTER (NOT CASE WHEN h THEN c = len AND p = len ELSE c = 0 END) AS n_violations FROM j UNION ALL SELECT 'unique_id', 0 UNION ALL SELECT 'known_decoy', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "request_roles": """SELECT o_custkey, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_unknown, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O" FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) > 0 OR count(*) FILTER (o_orderstatus = 'F') = 0 OR count(*) FILTER (o_orderstatus = 'O') = 0""",
    "table_differences": "SELECT count(*) FILTER (p_size = 7) AS only_left, 0 AS only_right, 0 AS diff_p_name, 0 AS diff_p_brand, 0 AS diff_p_type, 0 AS diff_p_size, count(*) FILTER (p_size = 9) AS diff_p_retailprice FROM part",
    "table_digest": "SELECT count(*) AS rows, true AS same, true AS differs FROM orders",
    "paired_lift": f"""WITH {S.SCORERS}, x AS (SELECT 'base' AS decoy_role, label, sa[native] - base[native] AS v FROM s UNION ALL SELECT 'sb', label, sa[native] - sb[native] FROM s), m AS (SELECT decoy_role, label, avg(v) AS value, count(*) AS k FROM x GROUP BY ALL), {S.bootstrap('m', 'decoy_role', 'label', 100, 21)}
SELECT decoy_role, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters, {r('any_value(ci_low)', 'ci_low')}, {r('any_value(ci_high)', 'ci_high')} FROM m JOIN ci USING (decoy_role) GROUP BY ALL""",
    "role_deltas": f"""WITH {S.LONG_SCORERS}, m AS (SELECT scorer, label, -avg(logp[native]) AS nll, avg((list_position(logp, list_max(logp)) = native)::int) AS t1 FROM long GROUP BY ALL)
SELECT a.label, a.scorer, {r('a.nll - b.nll', 'delta_nll')}, {r('a.t1 - b.t1', 'delta_top1_recovery')} FROM m a JOIN m b ON a.label = b.label AND b.scorer = 'base' WHERE a.scorer <> 'base'""",
    "star_assembly": f"SELECT p_type, s_nationkey AS nation, count(*) AS n_rows, {r('avg(p_size)', 'mean_size')} FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "split_overlap": "SELECT lang, CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'test' ELSE 'not_listed' END AS split, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "opened_registry": """WITH u AS (SELECT upper(text) AS t, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS s FROM documents UNION ALL SELECT upper(text), 'benchmark' FROM benchmark), g AS (SELECT t, min(s) AS source, count(DISTINCT s) AS n_sources FROM u GROUP BY t) SELECT source, n_sources, count(*) AS n FROM g GROUP BY ALL""",
    "request_fanout": """SELECT o_orderkey || '__paired__' || o_custkey AS request_id, 'paired' AS structure_role FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey || '__matched__' || c_nationkey, 'matched' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0""",
    "variant_actions": f"WITH {S.SCORERS} SELECT vec_id, mut::int AS mut, {r('sa[mut] - sa[native]', 'action')} FROM s, range(1, 21) t(mut) WHERE mut <> native",
    "lookup_actions": f"""WITH {S.SCORERS}, m AS (SELECT native AS w, i, avg(sb[i]) AS sc FROM s, range(1, 21) t(i) GROUP BY ALL)
SELECT vec_id, {r('a.sc - b.sc', 'matrix_action')}, {r('sa[vec_id * 3 % 20 + 1] - sa[native]', 'profile_action')} FROM s LEFT JOIN m a ON a.w = native AND a.i = vec_id * 3 % 20 + 1 LEFT JOIN m b ON b.w = native AND b.i = native""",
    "conservation_attach": f"SELECT CASE WHEN p_size / 50.0::double >= 0.8::double THEN 'conserved' WHEN p_size / 50.0::double <= 0.3::double THEN 'variable' ELSE 'intermediate' END AS conservation_class, count(*) AS n, {r('avg(p_size / 50.0::double)', 'mean_score')} FROM part GROUP BY ALL",
    "remapped_effects": f"SELECT p_size AS position, {r('avg(-l_discount)', 'mean_effect')}, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "routing_diagnostic": f"WITH {_METHOD_SQL} SELECT a.l_suppkey, " + ", ".join(f"{r(f'a.{c}', f'base_{c}')}, {r(f'b.{c}', f'gated_{c}')}, {r(f'f.{c}', f'full_{c}')}, {r(f'b.{c} - a.{c}', f'gated_minus_base_{c}')}, {r(f'b.{c} - f.{c}', f'gated_minus_full_{c}')}" for c in ("spearman", "top_ndcg")) + " FROM em a JOIN em b ON a.l_suppkey = b.l_suppkey AND a.method = 'q' AND b.method = 'q+d' JOIN em f ON a.l_suppkey = f.l_suppkey AND f.method = 'q+d+t'",
    "state_metrics": f"""WITH {S.SCORERS} SELECT label, {r('avg(sa[native] - base[native])', 'mean_value')}, {r('avg((list_reverse_sort(base)[1] - list_reverse_sort(base)[2] >= 0.1::double)::int)', 'confident_error_fraction')}, count(*) AS n_edited FROM s WHERE list_position(base, list_max(base)) <> native GROUP BY label""",
    "cost_audit": f"""WITH q AS (SELECT event_type, user_id, ts::date AS d, max(value) AS s, max(event_id % 50 + 1) AS rs FROM events GROUP BY ALL), p AS (SELECT event_type, user_id, sum(s) AS s, count(*) AS c, sum(rs) AS rs FROM q GROUP BY ALL)
SELECT event_type, sum(c)::bigint AS n_requests, count(*) AS n_entities, sum(c)::bigint AS calls, {r('sum(s)', 'seconds_total')}, {r('quantile_cont(s, 0.5)', 'median_seconds_per_entity')}, {r('sum(s) / sum(rs)', 'seconds_per_residue')} FROM p GROUP BY ALL""",
    "variant_coverage": f"""SELECT l_returnflag, l_linestatus, count(*) AS total_variants, count(*) FILTER (p_size <= 40) AS known_position_variants, count(*) FILTER (p_size <= 40 AND (p_size <= 30 OR p_type = 'ECONOMY')) AS scored_variants, {r("count(*) FILTER (p_size <= 40 AND (p_size <= 30 OR p_type = 'ECONOMY')) / count(*)", 'coverage_fraction')}, 'partial' AS status
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "collapse_measurements": f"SELECT l_suppkey, l_partkey, {r('quantile_cont(-l_discount, 0.5)', 'effect')}, count(*) AS n_measurements, {r('min(-l_discount)', 'effect_min')}, {r('max(-l_discount)', 'effect_max')} FROM lineitem GROUP BY ALL",
    "condition_validity": f"""WITH {S.SCORERS}, x AS (SELECT 'sa' AS condition, label, base AS p, sa AS q FROM s UNION ALL SELECT 'sb', label, base, sb FROM s),
e AS (SELECT condition, label, avg({_jsd('p', 'q')}) AS j, avg(abs({_ENT.format(v='q')} - {_ENT.format(v='p')})) AS h, avg({S.cosine(S.centre(S.avg_rank('p')), S.centre(S.avg_rank('q')))}) AS rho FROM x GROUP BY ALL),
t AS (SELECT condition, quantile_cont(j, 0.5) AS mj, quantile_cont(h, 0.5) AS mh, avg((j <= 0.1::double AND h <= 0.25::double)::int) AS f, quantile_cont(rho, 0.5) AS mr, count(DISTINCT label) AS n_entities FROM e GROUP BY ALL)
SELECT condition, {r('mj', 'median_jsd')}, {r('mh', 'median_entropy_shift')}, {r('f', 'passing_fraction')}, {r('mr', 'median_reliability')}, n_entities, mj <= 0.1 AND mh <= 0.25 AND f >= 0.8 AND mr >= -0.5 AS valid FROM t""",
    "control_gaps": f"""WITH {_METHOD_SQL}, b AS (SELECT method FROM em WHERE method <> 'q' GROUP BY method ORDER BY avg(full_ndcg) DESC, method LIMIT 1)
SELECT 'all' AS model, a.l_suppkey, c.method AS strongest_control, {r('a.full_ndcg', 'observed_value')}, {r('c.full_ndcg', 'control_value')}, {r('a.full_ndcg - c.full_ndcg', 'gap')} FROM em a JOIN em c ON a.l_suppkey = c.l_suppkey AND c.method = (SELECT method FROM b) WHERE a.method = 'q'""",
    "geometry_summary": f"""WITH x AS (SELECT l_returnflag || '|' || metric AS g, l_returnflag, metric, l_suppkey, v FROM (SELECT l_returnflag, l_suppkey, 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, l_suppkey, 'l_tax', l_tax FROM lineitem)),
m AS (SELECT g, l_returnflag, metric, l_suppkey, avg(v) AS value, count(*) AS k FROM x GROUP BY ALL), {S.bootstrap('m', 'g', 'l_suppkey', 50, 6)}, pq AS (SELECT g, quantile_cont(v, 0.5) AS p5, quantile_cont(v, 0.9) AS p9 FROM x GROUP BY g)
SELECT l_returnflag, metric, {r('avg(value)', 'estimate')}, sum(k)::bigint AS n_rows, count(*) AS n_clusters, {r('any_value(ci_low)', 'ci_low')}, {r('any_value(ci_high)', 'ci_high')}, {r('any_value(p5)', 'pooled_p50')}, {r('any_value(p9)', 'pooled_p90')} FROM m JOIN ci USING (g) JOIN pq USING (g) GROUP BY ALL""",
    "role_availability": "SELECT source, lang, count(*) AS n_rows, count(DISTINCT n_chars) AS n_entities, count(DISTINCT n_chars) >= 6 AS available FROM documents GROUP BY ALL",
    "figure_source": f"""SELECT l_returnflag, l_linestatus, {r('quantile_cont(l_extendedprice, 0.25)', 'q25')}, {r('quantile_cont(l_extendedprice, 0.5)', 'median')}, {r('quantile_cont(l_extendedprice, 0.75)', 'q75')}, count(*) AS n_rows, NULL::double AS "F", NULL::double AS "O" FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, NULL, NULL, NULL, NULL, NULL, {r("avg(l_quantity) FILTER (l_linestatus = 'F')", '"F"')}, {r("avg(l_quantity) FILTER (l_linestatus = 'O')", '"O"')} FROM lineitem GROUP BY l_returnflag""",
    "shapley": f"WITH {S.OBSERVED}, {_SHAP} " + " UNION ALL ".join(_shap(i, n) for i, n in enumerate(SUBSETS)),
    "distillability_map": f"""WITH {_MAPSQL} SELECT analysis_role, state_kind, {r('level', 'level')}, environment_axis, environment, {', '.join(r(c, c) for c in ('estimate', 'ci_low', 'lift', 'jsd_reduction', 'residual_cosine', 'scaffold_reliability'))}, high_action_value, target_specific, sequence_observable,
 high_action_value AND target_specific AND sequence_observable AS distillable, CASE WHEN high_action_value AND target_specific AND sequence_observable THEN 'distillable' WHEN high_action_value AND NOT sequence_observable THEN 'valuable_but_unobservable' WHEN NOT target_specific THEN 'nonspecific' ELSE 'low_value' END AS map_class FROM mp""",
    "valid_radius": f"""WITH {_MAPSQL}, p AS (SELECT analysis_role, environment_axis, environment, level, avg(estimate) >= 0.02::double AND min(ci_low) > 0 AS ok FROM mp GROUP BY ALL)
SELECT analysis_role, environment_axis, environment, {r('coalesce(max(level) FILTER (ok), 0)', 'valid_radius')}, {r('max(level)', 'tested_maximum')}, count(*) FILTER (ok) AS passing_levels, count(*) AS tested_levels FROM p GROUP BY ALL""",
    "identity_checks": """SELECT 'zero_sum' AS "check", count(*) > 0 AS passed, 1e-8::double AS threshold FROM embeddings UNION ALL SELECT 'anchored', count(*) > 0, 1e-8 FROM embeddings UNION ALL SELECT 'not_an_identity', count(*) < 0, 1e-8 FROM embeddings""",
    "action_gates": f"WITH {_SUMM} SELECT gate, method, metric, field, op, {r('threshold', 'threshold')}, {r('value', 'value')}, passed FROM gp",
    "gate_outcome": f"WITH {_SUMM} SELECT CASE WHEN bool_and(passed) THEN 'CONFIRMED' WHEN bool_or(passed) FILTER (gate = 'd_gain_high') THEN 'PARTIAL' ELSE 'NOT_CONFIRMED' END AS decision, count(*) FILTER (passed) AS gates_passed, count(*) AS gates FROM gp",
    "branch_outcome": f"""WITH {_FLAGS}, {_MAPSQL.replace('g AS (SELECT', 'mg AS (SELECT', 1).replace('FROM g)', 'FROM mg)')}, lv AS (SELECT level, avg(estimate) >= 0.02::double AND min(ci_low) > 0 AS ok FROM mp WHERE environment = 'A' GROUP BY level),
c AS (SELECT max(CASE WHEN e >= 0.02 AND lo > 0 THEN 'PASS' ELSE 'FAIL' END) FILTER (f = 'A') AS core_action_value, max(CASE WHEN e >= 0.02 AND lo > 0 THEN 'PASS' ELSE 'FAIL' END) FILTER (f = 'N') AS regular_secondary_structure_action_value,
 max(CASE WHEN e >= 0.02 AND lo > 0 THEN 'PASS' ELSE 'FAIL' END) FILTER (f = 'R') AS paired_beats_matched_decoy, max(CASE WHEN e >= 0.05 AND lo > 0 THEN 'PASS' ELSE 'FAIL' END) FILTER (f = 'A') AS independent_dms_ranking,
 CASE WHEN max(e) FILTER (f = 'A') >= 0.01 AND max(lo) FILTER (f = 'A') > 0 AND max(e) FILTER (f = 'A') > max(e - 9) FILTER (f <> 'A') THEN 'PASS' ELSE 'FAIL' END AS cath_h_frozen_linear_residual_accessibility,
 CASE WHEN count(*) FILTER (e > 0.02) >= 1 THEN 'PASS' ELSE 'FAIL' END AS high_value_high_observability_environment, 'FAIL' AS teacher_action_valid_radius, CASE WHEN count(*) FILTER (e > 0 AND lo > 0) >= 2 THEN 'PASS' ELSE 'FAIL' END AS structure_teacher_directional_consistency, 'INCOMPLETE' AS on_policy_incremental_value FROM fl),
u AS (SELECT list_value(core_action_value, regular_secondary_structure_action_value, paired_beats_matched_decoy, independent_dms_ranking, cath_h_frozen_linear_residual_accessibility, high_value_high_observability_environment, teacher_action_valid_radius, structure_teacher_directional_consistency, on_policy_incremental_value) AS a, * FROM c)
SELECT CASE WHEN list_contains(a[1:4], 'FAIL') THEN 'NO_GO' WHEN list_contains(a[5:6], 'FAIL') THEN 'PIVOT_STRUCTURE_CONDITIONED' ELSE 'NO_GO' END AS decision, len(list_filter(a, lambda x: x = 'PASS')) AS criteria_passed, len(list_filter(a, lambda x: x = 'FAIL')) AS criteria_failed, len(list_filter(a, lambda x: x = 'INCOMPLETE')) AS criteria_incomplete, * EXCLUDE (a) FROM u""",
    "probe_status": f"""WITH {S.SCORERS}, t AS (SELECT label, base, sa, {S.zipped('sa', 'base', 'L - R')} AS da, {S.zipped('sb', 'base', 'L - R')} AS db FROM s),
u AS (SELECT label, base, sa, {S.centre('da')} AS ra, {S.zipped('base', S.centre('db').replace('lambda x: x', 'lambda z: z'), 'L + R / 2')} AS wb FROM t),
v AS (SELECT label, base, sa, ra, wb, {S.zipped('base', 'ra', 'L + R / 2')} AS wa FROM u), w AS (SELECT label, base, sa, ra, {S.lognorm('wa')} AS ma, {S.lognorm('wb')} AS mb FROM v),
p AS (SELECT label, avg({_jsd('base', 'sa')} - {_jsd('ma', 'sa')}) AS jo, avg({S.cosine('ra', 'ra')}) AS co, avg({_jsd('base', 'sa')} - {_jsd('mb', 'sa')}) AS jb FROM w GROUP BY label)
SELECT label, {r('jo', 'jsd_reduction')}, {r('co', 'residual_cosine')}, {r('greatest(jb, 0)', 'maximum_control')}, true AS controls_complete, CASE WHEN jo >= 0.01::double AND co >= 0.1::double AND jo > 0 AND jo > greatest(jb, 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM p""",
    "environment_overview": f"""WITH ev AS (SELECT * FROM (VALUES ('e1', 'F', 'flag', 'A'), ('e2', 'O', 'flag', 'R'), ('e3', 'O', 'flag', 'Q')) v(environment_id, state_kind, environment_axis, environment)),
m AS (SELECT environment_id, l_suppkey, avg(l_quantity - 25.5::double) AS value, count(*) AS k FROM lineitem JOIN ev ON l_linestatus = state_kind AND l_returnflag = environment GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY l_suppkey) AS j, avg(value) OVER (PARTITION BY environment_id) AS mu FROM m),
fl AS (SELECT environment_id, rr, any_value(mu) + avg(CASE WHEN {S.mix('rr', 'j', 3)} % 2 = 0 THEN value - mu ELSE mu - value END) AS v FROM o, range(1, 51) t(rr) GROUP BY ALL),
ci AS (SELECT environment_id, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM fl GROUP BY ALL),
s AS (SELECT environment_id, avg(value) AS e, sqrt(var_samp(value) / count(*)) AS se, (sum(value) - max(value)) / (count(*) - 1) AS l0, (sum(value) - min(value)) / (count(*) - 1) AS l1, count(*) FILTER (value > 0) AS p, count(*) FILTER (value < 0) AS q, count(*) FILTER (value = 0) AS z, sum(k)::bigint AS k, count(*) AS c FROM m GROUP BY ALL)
SELECT ev.*, coalesce(k, 0) AS observed_rows, coalesce(c, 0) AS observed_entities, {r('e', 'estimate')}, {r('se', 'jackknife_se')}, {r('l0', 'loo_min')}, {r('l1', 'loo_max')}, p AS positive_clusters, q AS negative_clusters, z AS zero_clusters, {r('lo', 'wild_ci_low')}, {r('hi', 'wild_ci_high')}
FROM ev LEFT JOIN s USING (environment_id) LEFT JOIN ci USING (environment_id)""",
    "completion_record": f"WITH {S.SCORERS} SELECT {r('-avg(base[native])', 'base_nll')}, {r('-avg(sa[native])', 'sa_nll')}, {r('-avg(sb[native])', 'sb_nll')}, 'COMPLETE' AS decision FROM s",
    "criterion_export": """WITH m AS (SELECT l_suppkey, avg(l_quantity - 25.0::double) AS v FROM lineitem GROUP BY ALL) SELECT 'core_action_value' AS criterion, CASE WHEN avg(v) >= 0.02 THEN 'PASS' ELSE 'FAIL' END AS status, round(avg(v), 4) AS estimate, '{"n_rows":' || (SELECT count(*) FROM lineitem) || '}' AS details, 'real' AS data_mode FROM m""",
    "assay_scan": """SELECT l_suppkey AS protein, count(*) FILTER (l_linenumber = 1) AS wt_rows, count(*) FILTER (l_linenumber > 2) AS single_rows, count(*) FILTER (l_linenumber = 2) AS other_rows, count(DISTINCT l_partkey) FILTER (l_linenumber > 2) AS positions, count(*) FILTER (l_linenumber > 2 AND l_tax = 0) AS missing_effects,
 max(l_returnflag) FILTER (l_linenumber = 1) AS sequence, max(l_linestatus) FILTER (l_linenumber = 1) AS cluster, count(DISTINCT l_linestatus) AS n_clusters FROM lineitem GROUP BY l_suppkey""",
    "packed_scores": f"WITH {S.SCORERS} SELECT vec_id, {r('list_sum(sa)', 'total')}, {r('sa[20]', 'last')} FROM s",
    "scope_filter": "SELECT 'F' AS scope, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'all', count(*) FROM orders UNION ALL SELECT 'absent', 0",
    "state_keys": "SELECT o_orderkey, o_custkey || ':' || o_orderstatus || ':c' || lpad(round(o_orderkey % 40 / 40 * 1000, 0)::int::varchar, 3, '0') || ':r' || lpad((o_orderkey % 12)::varchar, 3, '0') AS state_id FROM orders",
}
