"""Criteria, gates and branch decisions as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.operators.contracts import tag

# Criterion names in report order.
CORE = "core_action_value"
REGULAR = "regular_secondary_structure_action_value"
SPECIFIC = "paired_beats_matched_decoy"
ASSAY = "independent_dms_ranking"
ACCESS = "cath_h_frozen_linear_residual_accessibility"
ENVIRONMENT = "high_value_high_observability_environment"
RADIUS = "teacher_action_valid_radius"
CONSISTENT = "structure_teacher_directional_consistency"
ON_POLICY = "on_policy_incremental_value"
MANDATORY = (CORE, REGULAR, SPECIFIC, ASSAY, ACCESS, ENVIRONMENT, RADIUS, CONSISTENT)
STABILITY_ASSAYS = ("stability", "ddg", "folding_stability")

COLUMNS = ("criterion", "status", "estimate", "ci_low", "ci_high", "threshold", "n_rows", "n_clusters")


def _status(known: Column, passed: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "INCOMPLETE").when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")


def criterion(summary: DataFrame, name: str, threshold: float, *, positive_ci: bool = True, also: Column | None = None, detail: Sequence[str] = ()) -> DataFrame:
    """Status row of a one-row estimate. No rows, or an empty table, is INCOMPLETE;
    several rows are an error, since no one of them is the estimate."""
    ok = F.col("estimate") >= threshold
    if positive_ci:
        ok = ok & (F.col("ci_low") > 0)
    if also is not None:
        ok = ok & also
    # A global aggregate gives one row even when the summary is empty.
    one = summary.agg(
        *[F.first(c).alias(c) for c in ("estimate", "ci_low", "ci_high", "n_rows", "n_clusters", *detail)], F.count(F.lit(1)).alias("_k")
    )
    several = F.raise_error(F.concat(F.lit(f"{name}: one estimate expected, found "), F.col("_k").cast("string"))).cast("long")
    one = one.withColumn("n_rows", F.when(F.col("_k") > 1, several).otherwise(F.col("n_rows")))
    return one.select(
        F.lit(name).alias("criterion"), _status(F.coalesce("n_rows", F.lit(0)) > 0, ok).alias("status"),
        "estimate", "ci_low", "ci_high", F.lit(float(threshold)).alias("threshold"), "n_rows", "n_clusters",
        (F.to_json(F.struct(*detail)) if detail else F.lit("{}")).alias("details"),
    )


def count_criterion(df: DataFrame, name: str, passing: Column, threshold: float, *, known: Column | None = None, rows: Column | None = None) -> DataFrame:
    """Status by a count of passing rows; ``known`` tells whether the evidence is complete."""
    n = F.count(F.lit(1))
    agg = df.agg(F.count_if(passing).cast("double").alias("estimate"), n.alias("n_rows"), (known if known is not None else n > 0).alias("_known"))
    none = F.lit(None).cast("double")
    return agg.select(
        F.lit(name).alias("criterion"), _status(F.col("_known"), F.col("estimate") >= threshold).alias("status"), "estimate",
        none.alias("ci_low"), none.alias("ci_high"), F.lit(float(threshold)).alias("threshold"), "n_rows",
        F.lit(None).cast("long").alias("n_clusters"), F.lit("{}").alias("details"),
    )


def assay_criterion(coverage: DataFrame, pooled: DataFrame, primary: str, baseline: str, threshold: float = 0.05) -> DataFrame:
    """Complete coverage of both scorers, then the pooled rank correlation: over the
    threshold, over the baseline, with a positive lower bound."""
    need = coverage.where(F.col("teacher_id").isin(primary, baseline)).agg(
        (F.count_distinct("teacher_id") == 2).alias("_both"), F.bool_and(F.col("status") == "complete").alias("_all")
    )
    pick = lambda t, c: F.max(F.when(F.col("teacher_id") == t, F.col(c)))
    one = pooled.agg(
        *[pick(primary, c).alias(c) for c in ("estimate", "ci_low", "ci_high", "n_rows", "n_clusters")],
        F.count_if(F.col("teacher_id") == baseline).alias("_base"), pick(baseline, "estimate").alias("sequence_estimate"),
    ).join(F.broadcast(need))  # one row each
    ok = (F.col("estimate") >= threshold) & (F.col("ci_low") > 0)
    ok = ok & (F.col("sequence_estimate").isNull() | (F.col("estimate") > F.col("sequence_estimate")))
    known = F.col("_both") & F.col("_all") & F.col("estimate").isNotNull() & (F.col("_base") > 0)
    return one.select(
        F.lit(ASSAY).alias("criterion"), _status(known, ok).alias("status"), "estimate", "ci_low", "ci_high", F.lit(threshold).alias("threshold"),
        "n_rows", "n_clusters", F.to_json(F.struct("sequence_estimate")).alias("details"),
    )


def access_criterion(summary: DataFrame, min_jsd: float = 0.01, min_cosine: float = 0.10) -> DataFrame:
    """Observed gain against the shuffled control, with the residual cosine."""
    pick = lambda control, metric, c: F.max(F.when((F.col("control") == control) & (F.col("metric") == metric), F.col(c)))
    one = summary.agg(
        *[pick("observed", "jsd_reduction", c).alias(c) for c in ("estimate", "ci_low", "ci_high", "n_rows", "n_clusters")],
        pick("observed", "residual_cosine", "estimate").alias("residual_cosine"), pick("shuffled", "jsd_reduction", "estimate").alias("shuffled_jsd"),
    )
    ok = (F.col("estimate") >= min_jsd) & (F.col("residual_cosine") >= min_cosine) & (F.col("ci_low") > 0)
    ok = ok & (F.col("shuffled_jsd").isNull() | (F.col("estimate") > F.col("shuffled_jsd")))
    return one.select(
        F.lit(ACCESS).alias("criterion"), _status(F.col("estimate").isNotNull() & F.col("residual_cosine").isNotNull(), ok).alias("status"),
        "estimate", "ci_low", "ci_high", F.lit(min_jsd).alias("threshold"), "n_rows", "n_clusters",
        F.to_json(F.struct("residual_cosine", "shuffled_jsd")).alias("details"),
    )


def radius_criterion(radius: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Smaller of the best core radius and the best regular-structure radius."""
    core = (F.col("environment_axis") == "burial") & (F.col("environment") == "buried")
    regular = (F.col("environment_axis") == "secondary_structure") & F.col("environment").isin("helix", "strand")
    one = radius.agg(
        F.count_if(core | regular).alias("n_rows"),
        F.coalesce(F.max(F.when(core, F.col("valid_radius"))), F.lit(0.0)).alias("_c"),
        F.coalesce(F.max(F.when(regular, F.col("valid_radius"))), F.lit(0.0)).alias("_r"),
    ).withColumn("estimate", F.least("_c", "_r"))
    none = F.lit(None).cast("double")
    return one.select(
        F.lit(RADIUS).alias("criterion"), _status(F.col("n_rows") > 0, F.col("estimate") >= threshold).alias("status"), "estimate",
        none.alias("ci_low"), none.alias("ci_high"), F.lit(threshold).alias("threshold"), "n_rows", F.lit(None).cast("long").alias("n_clusters"), F.lit("{}").alias("details"),
    )


def consistency_criterion(per_scorer: DataFrame, required: int = 2) -> DataFrame:
    """Scorers whose advantage is positive with a positive lower bound."""
    return count_criterion(per_scorer, CONSISTENT, (F.col("estimate") > 0) & (F.col("ci_low") > 0), required, known=F.count(F.lit(1)) >= required)


def on_policy_criterion(effects: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Matched effect; poor matching leaves it INCOMPLETE."""
    one = effects.agg(*[F.first(c, True).alias(c) for c in ("estimate", "ci_low", "ci_high", "n_rows", "n_clusters", "matching_quality_pass", "match_fraction", "maximum_absolute_smd")])
    ok = (F.col("estimate") >= threshold) & (F.col("ci_low") > 0)
    return one.select(
        F.lit(ON_POLICY).alias("criterion"), _status(F.col("matching_quality_pass"), ok).alias("status"), "estimate", "ci_low", "ci_high",
        F.lit(threshold).alias("threshold"), "n_rows", "n_clusters", F.to_json(F.struct("match_fraction", "maximum_absolute_smd")).alias("details"),
    )


def union_criteria(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decide(criteria: DataFrame, *, scope: str | None = None, real: bool = True) -> DataFrame:
    """Ordered branch over the criteria, with counts by status (one row)."""
    names = [*MANDATORY, ON_POLICY]
    wide = criteria.agg(
        *[F.max(F.when(F.col("criterion") == n, F.col("status"))).alias(n) for n in names],
        *[F.count_if(F.col("status") == s).alias("criteria_" + t) for s, t in (("PASS", "passed"), ("FAIL", "failed"), ("INCOMPLETE", "incomplete"))],
    )

    def any_is(status: str, group: Sequence[str]) -> Column:
        out = F.lit(False)
        for n in group:
            out = out | F.coalesce(F.col(n) == status, F.lit(False))
        return out

    fail = lambda *g: any_is("FAIL", g)
    branch = (
        F.when(any_is("INCOMPLETE", MANDATORY), "INCOMPLETE")
        .when(fail(CORE, REGULAR, SPECIFIC, ASSAY), "NO_GO")
        .when(fail(ACCESS, ENVIRONMENT), "PIVOT_STRUCTURE_CONDITIONED")
        .when(fail(RADIUS, CONSISTENT), "NO_GO")
        .when(any_is("INCOMPLETE", [ON_POLICY]), "INCOMPLETE")
        .when(fail(ON_POLICY), "DROP_ON_POLICY")
        .otherwise("GO")
    )
    out = wide.withColumn("decision", branch)
    if scope == "stability_only":
        out = out.withColumn("decision", F.when(F.col("decision") == "GO", "NARROW_STABILITY").otherwise(F.col("decision")))
    if not real:
        out = out.withColumn("decision", F.lit("SYNTHETIC_ONLY"))
    return out.select("decision", "criteria_passed", "criteria_failed", "criteria_incomplete", *names)


def evidence_scope(assays: DataFrame, col: str = "assay_type") -> DataFrame:
    """Whether the independent evidence is missing, unspecified, stability only or broader."""
    v = F.lower(F.trim(col))
    named = v.isNotNull() & (v != "") & (v != "unspecified")
    return assays.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(named).alias("k"), F.count_if(named & ~v.isin(*STABILITY_ASSAYS)).alias("other")
    ).select(
        F.when(F.col("n") == 0, "missing").when(F.col("k") == 0, "unspecified").when(F.col("other") == 0, "stability_only").otherwise("multi_assay").alias("evidence_scope")
    )


def gate_registry(spark: SparkSession, keys: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Gates as data: (gate, *selector values, column, operator, threshold)."""
    cols = ", ".join(["gate string", *(f"`{k}` string" for k in keys), "field string", "op string", "threshold double"])
    return spark.createDataFrame(list(rows), cols)


def gate_table(summary: DataFrame, gates: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Value and pass flag of every gate. A missing or ambiguous summary row fails."""
    s = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *[F.max(f).cast("double").alias(f) for f in fields])
    out = gates.join(s, list(keys), "left")
    value = F.lit(None).cast("double")
    for f in fields:
        value = F.when(F.col("field") == f, F.col(f)).otherwise(value)
    out = out.withColumn("value", F.when(F.col("_k") == 1, value))
    t = F.col("threshold")
    ok = F.when(F.col("op") == ">", F.col("value") > t).when(F.col("op") == ">=", F.col("value") >= t).when(F.col("op") == "<", F.col("value") < t).when(F.col("op") == "<=", F.col("value") <= t)
    return out.select("gate", *keys, "field", "op", "threshold", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def gate_decision(gates: DataFrame, confirmed: str, partial: str, none: str, partial_gates: Sequence[str] = ()) -> DataFrame:
    """All gates pass: confirmed; any of the partial gates: partial; else none."""
    some = F.coalesce(F.bool_or(F.when(F.col("gate").isin(*partial_gates), F.col("passed"))), F.lit(False)) if partial_gates else F.lit(False)
    return gates.agg(
        F.when(F.bool_and("passed"), confirmed).when(some, partial).otherwise(none).alias("decision"),
        F.count_if("passed").alias("gates_passed"), F.count(F.lit(1)).alias("gates"),
    )


def probe_decision(
    summary: DataFrame, labels: Sequence[str], expected: Sequence[str], repeats: int, *, min_jsd: float = 0.01, min_cosine: float = 0.10
) -> DataFrame:
    """Status of each probe (a label combination; NULL labels compare equal).

    ``summary`` has control, repeat, metric, estimate, wild_ci_low. A probe passes
    when its gain, cosine and lower bound do, every expected control has all its
    repeats, and the gain exceeds the largest control.
    """
    pick = lambda metric, c: F.max(F.when((F.col("control") == "observed") & (F.col("metric") == metric), F.col(c)))
    gain = F.col("metric") == "jsd_reduction"
    agg = summary.groupBy(*labels).agg(
        pick("jsd_reduction", "estimate").alias("jsd_reduction"), pick("jsd_reduction", "wild_ci_low").alias("jsd_ci_low"),
        pick("residual_cosine", "estimate").alias("residual_cosine"),
        F.max(F.when(gain & F.col("control").isin(*expected), F.col("estimate"))).alias("maximum_control"),
        *[F.count_distinct(F.when(gain & (F.col("control") == c), F.col("repeat"))).alias("_k" + str(i)) for i, c in enumerate(expected)],
    ).where("jsd_reduction IS NOT NULL")
    complete = F.lit(True)
    for i in range(len(expected)):
        complete = complete & (F.col("_k" + str(i)) == repeats)
    ok = (F.col("jsd_reduction") >= min_jsd) & (F.col("residual_cosine") >= min_cosine) & (F.col("jsd_ci_low") > 0)
    ok = ok & (F.col("jsd_reduction") > F.col("maximum_control"))
    out = agg.withColumn("controls_complete", complete)
    return out.withColumn("status", _status(F.col("controls_complete") & F.col("residual_cosine").isNotNull(), ok)).drop(*["_k" + str(i) for i in range(len(expected))])


def route_decision(probes: DataFrame, environments: DataFrame, eligible: Column, primary: Column) -> DataFrame:
    """Global primary route, then any eligible route, then an environment, else retain."""
    g = probes.agg(
        F.coalesce(F.bool_or(eligible & (F.col("status") == "PASS")), F.lit(False)).alias("_any"),
        F.coalesce(F.bool_or(eligible & primary & (F.col("status") == "PASS")), F.lit(False)).alias("_main"),
    )
    e = environments.agg(F.coalesce(F.bool_or(F.col("status") == "PASS"), F.lit(False)).alias("_env"))
    return g.join(F.broadcast(e)).select(  # one row each
        F.when(F.col("_main"), "NEW_INDEPENDENT_SEQUENCE_ONLY_PROTOCOL_REQUIRED")
        .when(F.col("_any"), "REPRESENTATION_ACCESSIBILITY_LIMITATION")
        .when(F.col("_env"), "SELECTIVE_HYBRID")
        .otherwise("RETAIN_STRUCTURE_AS_INFERENCE_MODALITY").alias("decision")
    )


def environment_slices(df: DataFrame, envs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the registered environments. The registry (environment_id, keys,
    environment_axis, environment) is a short literal table."""
    return df.join(envs, [*keys, "environment_axis", "environment"])


def environment_overview(df: DataFrame, envs: DataFrame, keys: Sequence[str], entity: str, value: str, **kw) -> DataFrame:
    """Coverage and interval per registered environment; absent ones show zero rows."""
    from rankloom.operators.inference import wild_cluster

    rows = environment_slices(df, envs, keys)
    cover = rows.groupBy("environment_id").agg(F.count(F.lit(1)).alias("observed_rows"), F.count_distinct(entity).alias("observed_entities"))
    s = wild_cluster(rows, ["environment_id"], value, entity, **kw).drop("n_rows", "n_clusters")
    return envs.join(cover, "environment_id", "left").fillna(0, ["observed_rows", "observed_entities"]).join(s, "environment_id", "left")


def completion_state(summary: DataFrame, picks: Mapping[str, tuple[Column, str]], **labels: str) -> DataFrame:
    """One record with chosen values from summary rows and constant labels."""
    out = summary.agg(*[F.max(F.when(c, F.col(f))).alias(n) for n, (c, f) in picks.items()])
    return tag(out, **labels)
