"""Jobs users run, composed from the operators.

Each takes tables and parameters and returns named lazy tables. Intermediates
that several outputs read are settled once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators import contracts as K
from rankloom.operators import controls as C
from rankloom.operators import decisions as D
from rankloom.operators import geometry as G
from rankloom.operators import inference as I
from rankloom.operators import joins as J
from rankloom.operators import leakage as L
from rankloom.operators import matching as X
from rankloom.operators import methods as M
from rankloom.operators import models as F_
from rankloom.operators import ordering as O
from rankloom.operators import ranking as R
from rankloom.session import settle

Tables = dict[str, DataFrame]
# Environment axes and final state names.
AXES = ("burial", "secondary_structure", "contact_class", "conservation_class")
ACTION_STATES = (
    "MULTI_TEACHER_STRUCTURE_UNIQUE_ACTION_CONFIRMED",
    "TEACHER_SPECIFIC_STRUCTURE_INCREMENT_WITHOUT_CONSENSUS",
    "NO_STABILITY_RELEVANT_UNIQUE_STRUCTURE_ACTION_AFTER_GC",
)
EXTERNAL_STATES = (
    "CROSS_PLATFORM_STRUCTURE_ACTION_BEYOND_CPLUS_CONFIRMED",
    "CROSS_PLATFORM_STRUCTURE_ACTION_BEYOND_CPLUS_NOT_CONFIRMED",
)


def job_registry(
    domains: DataFrame, benchmarks: DataFrame, hits: DataFrame, rules: Sequence[tuple[str, Column]], audit: DataFrame | None = None,
    *, exact: Sequence[tuple[str, Sequence[str]]], classes: Sequence[tuple[str, str]], threshold: float = 0.30, id: str = "domain_id", bench_id: str = "benchmark_id",
) -> Tables:
    """Quality filter, leakage relations, eligibility, and union with the audit set."""
    kept, excluded = K.quality_filter(domains, rules)
    kept = settle(kept)
    # Hits of rows that the filter took out are no relations of the registry.
    hits = hits.join(kept.select(id), id, "left_semi")
    relations = settle(L.leakage_relations(kept, benchmarks, hits, train_id=id, bench_id=bench_id, exact=exact, classes=classes, threshold=threshold))
    eligible = L.leakage_eligibility(kept, relations, id)
    out = {"excluded": excluded, "relations": relations, "eligibility": eligible, "summary": L.leakage_summary(kept, relations, id)}
    out["registry"] = eligible if audit is None else K.union_checked(
        [K.tag(eligible, analysis_role="train"), K.tag(audit.withColumns({"eligible_for_training": F.lit(False), "exclusion_reasons": F.array().cast("array<string>")}), analysis_role="audit")], [id], "registry")
    return out


def _scored_positions(scores: DataFrame, positions: DataFrame, baseline: str) -> DataFrame:
    """Score rows with native measures, environments and the advantage over the baseline."""
    rows = J.assemble(scores, [(positions, ["state_id", "position"])])
    rows = rows.withColumns({
        "native_logp": F.element_at("logp", F.col("native_idx")),
        "native_rank": V.entry_rank("logp", "native_idx"),
    })
    base = F.col("teacher_id") == baseline
    out = J.with_baseline(rows, ["state_id", "position"], base, ["native_logp"])
    return out.withColumn("advantage", F.col("native_logp") - F.col("baseline_native_logp"))


def job_teacher_value(
    scores: DataFrame, positions: DataFrame, baseline: str, *, paired: str = "paired", decoys: Sequence[str] = (), axes: Sequence[str] = AXES,
    cluster: str = "domain_id", **kw,
) -> Tables:
    """Native metrics, advantage by environment, paired-decoy lift and scorer agreement."""
    pos = settle(_scored_positions(scores, positions, baseline))
    ids = ["analysis_role", "teacher_id", "structure_role", "state_kind", "level"]
    own = pos.where(F.col("teacher_id") != baseline)
    out = {
        "position_metrics": pos,
        "native_metrics": A.native_metrics(pos, ids, "logp", "native_idx"),
        "advantage": I.cluster_bootstrap(own, ids, "advantage", cluster, **kw),
        "environment_summary": A.environment_summary(own.where(F.col("structure_role") == paired), ids, axes, "advantage", cluster, **kw),
    }
    if decoys:
        lift = settle(J.paired_lift(own, ["teacher_id", "state_id", "position", cluster, "analysis_role", "state_kind", "level", *axes], "structure_role", paired, decoys, "native_logp"))
        dids = ["analysis_role", "teacher_id", "decoy_role", "state_kind", "level"]
        out["specificity_summary"] = A.environment_summary(lift, dids, axes, "lift", cluster, **kw)
        out["specificity"] = I.cluster_bootstrap(lift, ["teacher_id", "decoy_role"], "lift", cluster, **kw)
    pairs = J.pairwise(pos.where(F.col("structure_role") == paired), "teacher_id", ["state_id", "position", cluster], ["logp"])
    agreement = pairs.select("left_teacher_id", "right_teacher_id", cluster, V.jsd("left_logp", "right_logp").alias("jsd"), V.vec_spearman("left_logp", "right_logp").alias("rank_agreement"))
    out["agreement"] = I.summarize(agreement, ["left_teacher_id", "right_teacher_id"], ["jsd", "rank_agreement"], cluster, **kw)
    return out


def job_observability(
    examples: DataFrame, group: str, *, features: str, sequence: str, teacher: str, p: int, q: int, folds: int, alpha: float, key: Sequence[str],
    numeric: Column, repeats: int = 1, labels: Sequence[str] = (), axes: Sequence[str] = (), cluster: str = "domain_id", top_k: int = 3, **kw,
) -> Tables:
    """Cross-fitted residual prediction against shuffled targets, overall and by environment."""
    rows = examples.withColumn("_target", V.residual(teacher, sequence))
    fitted = F_.cross_fit(rows, group, features, "_target", p, q, folds, alpha, key=key, repeats=repeats, numeric=numeric)
    measured = fitted.withColumn("_m", V.probe_metrics(sequence, teacher, V.centre("prediction"), top_k)).select(
        *[c for c in dict.fromkeys([*key, cluster, *labels, *axes])], "fold", "control", "repeat", "_m.*")
    measured = settle(measured)
    metrics = ["jsd_reduction", "residual_cosine", "cross_entropy_reduction", "residual_rank", "topk_overlap"]
    out = {
        "predictions": measured,
        "summary": I.summarize(measured, [*labels, "control"], metrics, cluster, **kw),
        "sensitivity": I.summarize(measured, [*labels, "control", "repeat"], metrics, cluster, method="wild", **kw),
    }
    if axes:
        seen = measured.where(F.col("control") == "observed")
        long = A.melt(seen, [*labels, cluster, *metrics], axes)
        out["environment_summary"] = I.summarize(long, [*labels, "environment_axis", "environment"], metrics, cluster, **kw)
    return out


def job_on_policy(
    positions: DataFrame, states: DataFrame, *, treat_kind: str, control_kind: str, match: Sequence[str], edited: Column, value: str = "advantage",
    gap: str = "student_top1_gap", cluster: str = "domain_id", caliper: float = 1.0, **kw,
) -> Tables:
    """State roll-up, caliper matching, balance before and after, matched effects."""
    per = A.state_metrics(positions, ["state_id"], edited, value, gap)
    full = settle(states.join(per, "state_id"))
    left, right = full.where(F.col("state_kind") == treat_kind), full.where(F.col("state_kind") == control_kind)
    pairs = settle(X.caliper_match(left, right, "state_id", [cluster, "level"], match, caliper))
    side = lambda d, k, pre: d.select(F.col("state_id").alias(k), *[F.col(c).alias(pre + c) for c in [*match, "mean_value", "confident_error_fraction"]])
    rows = settle(pairs.join(side(left, "left_id", "on_"), "left_id").join(side(right, "right_id", "control_"), "right_id"))
    rows = rows.withColumns({
        "comparison": F.lit(f"{treat_kind}_vs_{control_kind}"),
        "value_difference": F.col("on_mean_value") - F.col("control_mean_value"),
        "error_fraction_difference": F.col("on_confident_error_fraction") - F.col("control_confident_error_fraction"),
    })
    named = lambda pre: rows.select("comparison", *[F.col(pre + c).alias(c) for c in match])
    after = A.smd_table(named("on_"), named("control_"), ["comparison"], match)
    tagged = lambda d: K.tag(d, comparison=f"{treat_kind}_vs_{control_kind}")
    before = A.smd_table(tagged(left), tagged(right), ["comparison"], match)
    return {
        "state_metrics": full,
        "matches": rows,
        "balance": K.tag(before, stage="before").unionByName(K.tag(after, stage="after")),
        "effects": A.matched_effects(rows, ["comparison"], "value_difference", cluster, tagged(left), after, **kw),
    }


def job_foundation(
    value: Tables, observability: Tables, on_policy: Tables, reliability: DataFrame, coverage: DataFrame, pooled: DataFrame, *, primary: str, baseline: str,
    paired: str = "paired", cluster: str = "domain_id", max_level: float = 0.15, scope: str | None = None, real: bool = True,
    matched: str = "matched_cath", **kw,
) -> Tables:
    """Map of environments, valid radius, nine criteria and the branch.

    Specificity is the lift over the decoys of role ``matched``; others take no part.
    """
    pos = value["position_metrics"].where((F.col("structure_role") == paired))
    own = pos.where((F.col("teacher_id") == primary) & (F.col("level") <= max_level + 1e-12))
    env = lambda axis, names: I.cluster_bootstrap(own.where(F.col(axis).isin(*names)), [], "advantage", cluster, **kw)
    k = A.MAP_KEYS
    val = value["environment_summary"].where(F.col("teacher_id") == primary).select(*k, "estimate", "ci_low", "ci_high", "n_rows")
    of_role = (F.col("teacher_id") == primary) & (F.col("decoy_role") == matched)
    spec = value["specificity_summary"].where(of_role).select(*k, F.col("estimate").alias("lift"))
    obs = A.pivot_first(observability["environment_summary"], k, "metric", "estimate", ["jsd_reduction", "residual_cosine"])
    table = settle(A.distillability_map(val, spec, obs, reliability))
    radius = settle(A.valid_radius(table, ["analysis_role", "environment_axis", "environment"]))
    per_scorer = I.cluster_bootstrap(pos.where(F.col("teacher_id") != baseline), ["teacher_id"], "advantage", cluster, **kw)
    criteria = settle(D.union_criteria([
        D.criterion(env("burial", ["buried"]), D.CORE, 0.02),
        D.criterion(env("secondary_structure", ["helix", "strand"]), D.REGULAR, 0.02),
        D.criterion(value["specificity"].where(of_role), D.SPECIFIC, 0.02),
        D.assay_criterion(coverage, pooled, primary, baseline),
        D.access_criterion(observability["summary"]),
        D.count_criterion(table, D.ENVIRONMENT, F.col("distillable"), 1),
        D.radius_criterion(radius),
        D.consistency_criterion(per_scorer),
        D.on_policy_criterion(on_policy["effects"]),
    ]))
    return {"map": table, "radius": radius, "criteria": criteria, "decision": D.decide(criteria, scope=scope, real=real)}


def job_panel(
    candidates: DataFrame, variants: DataFrame, hits: DataFrame, *, id: str, sequence: str, rules: Sequence[tuple[str, Column]], stratum: str, cluster: str | None,
    order: Sequence[str], quota: int, identity: float = 0.80, coverage: float = 0.90,
) -> Tables:
    """Ledger, near-duplicate edges, independent selection, variants and query rows."""
    ledger = K.exclusion_ledger(candidates, rules)
    ok = settle(K.eligible(candidates, rules))
    near = L.near_duplicates(hits, identity, coverage).select(F.col("query_id").alias("a"), F.col("target_id").alias("b"))
    panel = settle(X.select_independent(ok, near, id, order, stratum=stratum, quota=quota, cluster=cluster).drop("pos"))
    kept = variants.join(panel.select(id, stratum), id)
    return {"ledger": ledger, "panel": panel, "variants": kept, "queries": K.query_rows(kept, panel, id, "position", [sequence]),
            "availability": A.role_availability(panel, [stratum], id, quota)}


def _variant_scores(variants: DataFrame, vectors: DataFrame, cols: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Mutant minus wild-type entry of each vector column, from one join."""
    at = lambda c, i: F.element_at(F.col("_v_" + c), F.col(i).cast("int"))
    rows = J.join_checked(variants, vectors.select(*on, *[F.col(c).alias("_v_" + c) for c in cols]), on)
    return rows.withColumns({c: at(c, "mut_idx") - at(c, "wild_idx") for c in cols}).drop(*["_v_" + c for c in cols])


def job_transfer(
    train: DataFrame, queries: DataFrame, variants: DataFrame, *, x: str, target: str, base: str, p: int, q: int, rank: int, alpha: float,
    key: Sequence[str], entity: str, on: Sequence[str], **kw,
) -> Tables:
    """Predict the residual on assay positions and test what it adds to the base score."""
    model = F_.rrr_fit(train, x, target, p, q, rank, alpha)
    vec = model.transform(queries, x, "residual_hat")
    rows = _variant_scores(variants, vec, [base, "residual_hat"], on)
    methods = {"sequence": {base: 1.0}, "sequence_plus_residual": {base: 1.0, "residual_hat": 1.0}}
    table = M.method_predictions(rows, methods, [entity, *key, "observed"])
    metrics = settle(R.entity_metrics(table, [entity], list(methods), "observed", key))
    inc = settle(R.metric_increments(metrics, [entity], "sequence"))
    return {"metrics": metrics, "increments": inc, "summary": I.summarize(inc, ["method"], list(R.METRICS), entity, method="wild", **kw)}


def job_counterfactual(
    vectors: DataFrame, variants: DataFrame, *, paired: str, conditions: Sequence[str], base: str, key: Sequence[str], entity: str, position: str, stratum: str,
    numeric: Column, repeats: int = 20, on: Sequence[str], **kw,
) -> Tables:
    """Methods per condition, increments with stratified intervals, position shuffling,
    distribution shift and validity of every condition."""
    cols = [base, paired, *conditions]
    rows = settle(_variant_scores(variants, vectors, cols, on))
    methods = {base: {base: 1.0}, **{f"{base}_plus_{c}": {base: 1.0, c: 1.0} for c in [paired, *conditions]}}
    table = M.method_predictions(rows, methods, [entity, *key, "observed", stratum])
    metrics = settle(R.entity_metrics(table, [entity], list(methods), "observed", key))
    strata = variants.select(entity, stratum).distinct()
    inc = settle(R.metric_increments(metrics, [entity], base).join(strata, entity))
    shift = None
    for c in conditions:
        part = A.distribution_shift(vectors.withColumn("condition", F.lit(c)), paired, c, ["condition"], entity)
        shift = part if shift is None else shift.unionByName(part)
    per = None
    for c in conditions:
        part = vectors.groupBy(entity).agg(F.avg(V.jsd(paired, c)).alias("jsd"), F.avg(F.abs(V.entropy(c) - V.entropy(paired))).alias("entropy_shift"), F.avg(V.vec_spearman(paired, c)).alias("rho")).withColumn("condition", F.lit(c))
        per = part if per is None else per.unionByName(part)
    control = C.position_shuffle_control(variants, vectors, entity, position, paired, wild="wild_idx", mut="mut_idx", observed="observed", numeric=numeric, repeats=repeats)
    return {
        "metrics": metrics, "increments": inc,
        "summary": I.summarize(I.with_scopes(inc, stratum), ["method", "scope"], list(R.METRICS), entity, method="stratified", st=stratum, **kw),
        "shift": shift, "validity": A.condition_validity(per, ["condition"], entity, "rho"), "shuffle": control,
    }


def job_action_validation(
    train: DataFrame, panel: DataFrame, variants: DataFrame, *, x: str, action: str, base_action: str, native: str, split: str, p: int, key: Sequence[str],
    entity: str, stratum: str, on: Sequence[str], n: int = 20, ranks: Sequence[int] = (4, 8, 16), alphas: Sequence[float] = (1.0, 10.0, 100.0), **kw,
) -> Tables:
    """Decompose panel actions with a model of other rows, then rank variants by the
    base plus each set of parts; gates on what the remainder adds."""
    both = train.select(*on, x, action, base_action, native, split).unionByName(panel.select(*on, x, action, base_action, native).withColumn(split, F.lit("panel")))
    parts, grid = F_.decompose(both, x=x, action=action, native=native, split=split, p=p, n=n, ranks=ranks, alphas=alphas)
    parts = settle(parts.where(F.col(split) == "panel"))
    checks = K.quality_controls(parts, {"decomposition_identity": F.array_max(F.transform(V.subtract(V.subtract(V.subtract(action, "g"), "c"), "u"), lambda v: F.abs(v)))})
    scale = train.agg((F.sqrt(F.avg(V.vsumsq(base_action))) / F.sqrt(F.avg(V.vsumsq(action)))).alias("k")).first()["k"]
    rows = _variant_scores(variants, parts.select(*on, base_action, "g", "c", "u"), [base_action, "g", "c", "u"], on)
    methods = {"base": {base_action: 1.0}, "plus_g": {base_action: 1.0, "g": scale}, "plus_gc": {base_action: 1.0, "g": scale, "c": scale},
               "plus_gcu": {base_action: 1.0, "g": scale, "c": scale, "u": scale}}
    metrics = settle(R.entity_metrics(M.method_predictions(rows, methods, [entity, *key, "observed"]), [entity], list(methods), "observed", key))
    reg = M.registry(train.sparkSession, [("u_over_gc", "plus_gcu", "plus_gc"), ("gc_over_base", "plus_gc", "base")], ["contrast", "method", "comparator"])
    gaps = J.contrast_gaps(metrics, reg, [entity], ["spearman", "top_ndcg"]).join(variants.select(entity, stratum).distinct(), entity)
    summary = settle(I.summarize(I.with_scopes(gaps, stratum), ["contrast", "scope"], ["spearman", "top_ndcg"], entity, method="stratified", st=stratum, **kw))
    gates = D.gate_registry(train.sparkSession, ["contrast", "scope", "metric"], [
        ("rank_gap_ci_positive", "u_over_gc", "all", "spearman", "ci_low", ">", 0.0), ("gain_gap_ci_positive", "u_over_gc", "all", "top_ndcg", "ci_low", ">", 0.0)])
    passed = settle(D.gate_table(summary, gates, ["contrast", "scope", "metric"], ["estimate", "ci_low"]))
    return {
        "selection": grid, "checks": checks, "metrics": metrics, "summary": summary, "gates": passed,
        "decision": D.gate_decision(passed, *ACTION_STATES, ["rank_gap_ci_positive", "gain_gap_ci_positive"]),
    }


def job_stability(
    calibration: DataFrame, panel: DataFrame, variants: DataFrame, *, base: str, base_action: str, scorers: Sequence[str], native: str, key: Sequence[str], entity: str,
    stratum: str, position: str, on: Sequence[str], group_replicates: int = 50, search: Mapping | None = None, split: str = "split", **kw,
) -> Tables:
    """Choose a calibration on other rows, rank by every scorer subset, contrasts with
    stratified and position-group intervals, and Shapley values of the scorers."""
    chosen = F_.select_calibration(settle(calibration), base, base_action, scorers, native, split=split, **(search or {}))
    best, params, schemes = chosen.scheme, chosen.final, chosen.validation
    scaled = {name: A.apply_calibration(best, [(name, dict(params[best])[name])]) for name in scorers}
    vec = panel.select(*on, F.col(base_action).alias("sequence_action"), *[scaled[s].alias(s) for s in scorers])
    rows = settle(_variant_scores(variants, vec, ["sequence_action", *scorers], on))
    methods = M.subsets("sequence_action", scorers)
    table = settle(M.method_predictions(rows, methods, [entity, *key, "observed", stratum, position]))
    metrics = settle(R.entity_metrics(table, [entity], list(methods), "observed", key))
    full = "+".join(("sequence_action", *scorers))
    gaps = R.metric_increments(metrics, [entity], "sequence_action").join(variants.select(entity, stratum).distinct(), entity)
    masks = {m: sum(1 << scorers.index(s) for s in m.split("+")[1:]) for m in methods}
    mask = F.create_map(*[v for m, b in masks.items() for v in (F.lit(m), F.lit(b))])
    means = metrics.groupBy("method").agg(F.avg("spearman").alias("value")).select(F.element_at(mask, F.col("method")).alias("mask"), "value")
    return {
        "schemes": schemes, "calibration_audit": chosen.audit, "metrics": metrics,
        "summary": I.summarize(I.with_scopes(gaps, stratum), ["method", "scope"], list(R.METRICS), entity, method="stratified", st=stratum, **kw),
        "group_intervals": I.group_bootstrap_diff(table, [entity], position, full, "sequence_action", "observed", group_replicates),
        "shapley": A.shapley(means, list(scorers)),
    }


def job_external(
    predictions: DataFrame, measurements: DataFrame, methods: Mapping[str, Mapping[str, float]], contrasts: Sequence[tuple[str, str, str]], *, entity: str,
    key: Sequence[str], value: str, min_entities: int, primary: str, **kw,
) -> Tables:
    """Open outcomes after scoring: collapse replicates, join, rank, contrast, gate."""
    # Written, so that a task does not hold the sorts of both sides at once.
    effects = settle(A.collapse_measurements(measurements, [entity, *key], value).select(entity, *key, "effect"))
    scored = settle(M.method_predictions(predictions, methods, [entity, *key]))
    rows = J.join_checked(scored, effects.withColumnRenamed("effect", "observed"), [entity, *key], "inner", "1:1")
    metrics = settle(R.entity_metrics(rows, [entity], list(methods), "observed", key))
    reg = M.registry(predictions.sparkSession, contrasts, ["contrast", "method", "comparator"])
    gaps = settle(J.contrast_gaps(metrics, reg, [entity], ["spearman", "top_ndcg"]).withColumn("st", F.lit("all")))
    summary = settle(I.summarize(gaps, ["contrast"], ["spearman", "top_ndcg"], entity, method="stratified", st="st", **kw))
    gates = D.gate_registry(predictions.sparkSession, ["contrast", "metric"], [
        ("minimum_evaluable_domains", primary, "spearman", "n_clusters", ">=", float(min_entities)), ("spearman_gap_ci_lower_positive", primary, "spearman", "ci_low", ">", 0.0),
        ("positive_spearman_domain_fraction", primary, "spearman", "positive_fraction", ">=", 0.5), ("ndcg10_gap_point_positive", primary, "top_ndcg", "estimate", ">", 0.0)])
    passed = settle(D.gate_table(summary, gates, ["contrast", "metric"], ["estimate", "ci_low", "positive_fraction", "n_clusters"]))
    return {"metrics": metrics, "gaps": gaps, "summary": summary, "gates": passed,
            "decision": D.gate_decision(passed, EXTERNAL_STATES[0], EXTERNAL_STATES[1], EXTERNAL_STATES[1])}


def job_structure(
    actions: DataFrame, variants: DataFrame, coordinates: DataFrame | None = None, *, role: str, ref: str, entity: str, position: str, vec: str, key: Sequence[str],
    min_entities: int = 2, **kw,
) -> Tables:
    """Role metrics and deltas, concordance with the reference role, action shift, and
    local geometry where coordinates (ax..az reference, bx..bz role) are given."""
    acts = settle(actions)
    at = lambda i: F.element_at(vec, F.col(i).cast("int"))
    rows = settle(variants.join(acts, [entity, position]).withColumn("score", at("mut_idx") - at("wild_idx")))
    metrics = settle(R.entity_metrics(rows, [entity, role], ["score"], "observed", key).drop("method"))
    ref_vec = acts.where(F.col(role) == ref).select(entity, position, F.col(vec).alias("_ref"))
    native = variants.select(entity, position, "wild_idx").distinct()
    shifted = acts.where(F.col(role) != ref).join(ref_vec, [entity, position]).join(native, [entity, position]).select(
        entity, position, role, V.action_shift(vec, "_ref", "wild_idx").alias("_s")).select(entity, position, role, "_s.*")
    out = {
        "metrics": metrics, "availability": A.role_availability(metrics, [role], entity, min_entities),
        "deltas": J.role_deltas(metrics, role, ref, [entity], ["spearman", "top_ndcg"]),
        "concordance": R.concordance(rows, [entity], role, ref, key, "score"), "action_shift": shifted,
        "summary": I.summarize(metrics, [role], ["spearman", "top_ndcg"], entity, **kw),
    }
    if coordinates is not None:
        pairs = settle(coordinates)
        fit = settle(G.superpose(pairs, [entity, role]))
        local = settle(G.local_geometry(G.transform_back(pairs, fit, [entity, role]), [entity, role], position))
        out["superposition"] = fit
        out["geometry"] = local
        out["geometry_summary"] = A.geometry_summary(local, [role], entity, ["local_rmsd", "lddt", "displacement"], **kw)
        both = local.join(shifted, [entity, role, position])
        out["geometry_vs_action"] = R.correlation_table(both, [entity, role], ["local_rmsd", "lddt"], ["shift_rmse"], 3)
    return out
