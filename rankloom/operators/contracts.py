"""Table contracts: keys, ranges, coverage, and ledgers of excluded rows.

Checks are either schema lookups, guards inside the plan (a bad row fails the
job that reads it) or small one-row report tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.functions import vectors as V


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str], label: str = "table") -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns: {missing}")
    return df


def enforce(df: DataFrame, schema: T.StructType, label: str = "table") -> DataFrame:
    """Select and cast the contract columns; missing ones are an error."""
    require_columns(df, schema.fieldNames(), label)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offending keys with their counts; empty when the key holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _fail(message: Column | str) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))


def guard(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Fail the job on the first row that breaks ``ok`` (NULL counts as broken)."""
    return df.where(F.when(ok, True).otherwise(_fail(message).cast("boolean")))


def unique_by(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """The table itself; a repeated key fails the job.

    Written as an aggregate on the key, whose exchange a join on the same key
    then reuses.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    ok = guard(agg, F.col("_n") == 1, F.concat(F.lit(f"{label}: repeated key "), F.to_json(F.struct(*keys))))
    return ok.select(*df.columns)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it (NULL breaks it)."""
    names = list(rules)
    counts = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n) for n in names])
    return counts.unpivot([], names, "rule", "n_violations")


def alphabet_rule(col: str, symbols: str) -> Column:
    return F.col(col).rlike("^[" + symbols + "]+$")


def length_rule(col: str, length: str) -> Column:
    return F.length(col) == F.col(length)


def range_rule(col: str, lo: float | None = None, hi: float | None = None, integral: bool = False) -> Column:
    v = F.col(col).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if lo is not None:
        ok = ok & (v >= lo)
    if hi is not None:
        ok = ok & (v <= hi)
    return ok & (F.floor(v) == v) if integral else ok


def logp_rule(col: str, n: int, tol: float = 1e-5) -> Column:
    vec = F.col(col)
    clean = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(vec) == n) & clean & (F.abs(V.logsumexp(vec)) <= tol)


def check_sequence_rows(parent: DataFrame, child: DataFrame, key: str, sequence: str, position: str, symbol: str) -> DataFrame:
    """Parents whose child rows are not exactly their sequence, with the reason.

    Letters are compared position by position, so no sequence is gathered.
    """
    rows = child.join(parent.select(key, sequence), key, "left")
    letter = F.substring(sequence, F.col(position) + 1, F.lit(1))
    seen = rows.groupBy(key).agg(
        F.min(position).alias("lo"),
        F.max(position).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(position).alias("n_positions"),
        F.count_if(letter != F.col(symbol)).alias("n_wrong"),
    )
    size = F.length(sequence)
    both = parent.select(key, sequence).join(seen, key, "full")
    reason = (
        F.when(F.col(sequence).isNull(), "unknown_parent")
        .when(F.col("n").isNull(), "no_rows")
        .when(F.col("n") != F.col("n_positions"), "repeated_position")
        .when((F.col("lo") != 0) | (F.col("hi") != size - 1) | (F.col("n") != size), "not_contiguous")
        .when(F.col("n_wrong") > 0, "letters_differ")
    )
    return both.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def check_coverage(keys: DataFrame, joined: DataFrame, on: Sequence[str]) -> DataFrame:
    """Requested keys that are missing, unrequested or repeated."""
    k = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("asked"))
    j = joined.groupBy(*on).agg(F.count(F.lit(1)).alias("found"))
    both = k.join(j, list(on), "full")
    problem = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("asked").isNull(), "unrequested")
        .when(F.col("found") > F.col("asked"), "repeated")
    )
    return both.select(*on, problem.alias("problem")).where("problem IS NOT NULL")


def check_request_coverage(raw: DataFrame, req: DataFrame, rid: str, position: str, length: str) -> DataFrame:
    """Status per request: rows must be positions 0..length-1, once each."""
    r = raw.groupBy(rid).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(position).alias("n_positions"),
        F.min(position).alias("lo"), F.max(position).alias("hi"),
    )
    both = req.select(rid, length).join(r, rid, "full")
    status = (
        F.when(F.col(length).isNull(), "unrequested")
        .when(F.col("n_rows").isNull(), "missing")
        .when((F.col("n_rows") != F.col(length)) | (F.col("n_positions") != F.col("n_rows")), "wrong_rows")
        .when((F.col("lo") != 0) | (F.col("hi") != F.col(length) - 1), "wrong_positions")
        .otherwise("complete")
    )
    return both.select(rid, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))


def coverage_audit(scores: DataFrame, req: DataFrame, support: DataFrame, keys: Sequence[str], length: str, min_fraction: float = 1.0) -> DataFrame:
    """Expected and observed rows per scorer and request class.

    ``support`` lists what each scorer should cover (keys, teacher_id, required);
    only listed combinations are expected.
    """
    expected = req.groupBy(*keys).agg(F.sum(length).alias("expected_rows"), F.count(F.lit(1)).alias("expected_requests"))
    observed = scores.groupBy("teacher_id", *keys).agg(F.count(F.lit(1)).alias("observed_rows"))
    out = support.join(expected, list(keys), "left").join(observed, ["teacher_id", *keys], "left")
    out = out.fillna(0, ["expected_rows", "expected_requests", "observed_rows"])
    fraction = F.when(F.col("expected_rows") > 0, F.col("observed_rows") / F.nullif(F.col("expected_rows"), F.lit(0)))
    return out.withColumn("fraction", fraction).withColumn(
        "status",
        F.when(F.col("expected_rows") == 0, "not_requested")
        .when(F.col("fraction") >= min_fraction, "complete")
        .when(F.col("required"), "fail")
        .otherwise("partial"),
    )


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails; a NULL test fails."""
    out: Column | None = None
    for name, ok in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def quality_filter(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows passing all rules, and the rest with the first failing rule."""
    tagged = df.withColumn("reason", first_reason(rules))
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def exclusion_ledger(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per record and failing rule."""
    fails = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]))
    return df.withColumn("reason", F.explode(fails))


def eligible(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    ok = F.lit(True)
    for _, rule in rules:
        ok = ok & F.coalesce(rule, F.lit(False))
    return df.where(ok)


def candidate_funnel(
    df: DataFrame, *, key: str, members: DataFrame, prior: DataFrame, group: str, rules: Sequence[tuple[str, Column]], order: Sequence[Column | str]
) -> DataFrame:
    """Listed entities, no case-insensitive id clash, passing rules, outside the
    prior groups, first of each group."""
    from rankloom.operators.ordering import first_per

    listed = df.join(members.select(key).distinct(), key, "left_semi")
    folded = listed.withColumn("_fold", F.lower(key))
    clashes = folded.groupBy("_fold").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    single = folded.join(clashes, "_fold", "left_anti").drop("_fold")
    fresh = eligible(single, rules).join(prior.select(group).distinct(), group, "left_anti")
    return first_per(fresh.select(*df.columns), [group], order)


def decision_scope(df: DataFrame, role: str, col: str = "analysis_role") -> DataFrame:
    if role == "all":
        return df
    if col not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col(col) == role)


def make_key(*parts: Column | str) -> Column:
    return F.concat_ws("__", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def state_id(entity: Column | str, kind: Column | str, ratio: Column | str, replicate: Column | str) -> Column:
    """Key of a state: entity, kind, level in thousandths and replicate, with at least three digits."""
    code = F.bround((F.col(ratio) if isinstance(ratio, str) else ratio) * 1000).cast("int")
    rep = (F.col(replicate) if isinstance(replicate, str) else replicate).cast("int")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.concat_ws(":", text(entity), text(kind), F.format_string("c%03d", code), F.format_string("r%03d", rep))


def validate_decoys(decoys: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Broken decoy rules with counts: ids unique, coordinate decoys carry one row
    per position of their target, other decoys carry none."""
    repeated = check_unique(decoys, ["decoy_id"]).agg(F.count(F.lit(1)).alias("n_violations")).withColumn("rule", F.lit("unique_id"))
    n = rows.groupBy("decoy_id").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("position").alias("_positions"))
    d = (
        decoys.select("decoy_id", "domain_id", "has_coordinates")
        .join(entities.select("domain_id", "length"), "domain_id", "left")
        .join(n, "decoy_id", "left")
        .fillna(0, ["_rows", "_positions"])
    )
    ok = F.when(
        F.col("has_coordinates"), (F.col("_rows") == F.col("length")) & (F.col("_positions") == F.col("length"))
    ).otherwise(F.col("_rows") == 0)
    shape = violations(d, {"rows_per_position": ok})
    orphan = rows.join(decoys, "decoy_id", "left_anti").agg(F.count(F.lit(1)).alias("n_violations")).withColumn("rule", F.lit("known_decoy"))
    return shape.unionByName(repeated).unionByName(orphan)


def validate_requests(req: DataFrame, entity: str, role: str, roles: Sequence[str], counts: Mapping[str, int] | None = None) -> DataFrame:
    """Entities whose set of structure roles is not the required one."""
    per = req.groupBy(entity).agg(
        F.array_sort(F.collect_set(F.when(F.col(role).isin(*roles), F.col(role)))).alias("known"),
        F.count_if(~F.col(role).isin(*roles)).alias("n_unknown"),
        *[F.count_if(F.col(role) == r).alias("n_" + r) for r in roles],
    )
    bad = (F.size("known") != len(roles)) | (F.col("n_unknown") > 0)
    for r, n in (counts or {}).items():
        bad = bad | (F.col("n_" + r) != n)
    return per.where(bad).drop("known")


def quality_controls(df: DataFrame, identities: Mapping[str, Column], tol: float = 1e-8) -> DataFrame:
    """Largest absolute error of each identity, with a pass flag.

    A non-finite or missing error fails.
    """
    names = list(identities)
    worst = df.agg(*[
        F.max(F.coalesce(V.finite(F.abs(identities[n])), F.lit(float("inf")))).alias(n) for n in names
    ]).unpivot([], names, "check", "estimate")
    return worst.withColumn("threshold", F.lit(tol)).withColumn("passed", F.col("estimate") <= tol)


def tag(df: DataFrame, **labels: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


def union_checked(dfs: Sequence[DataFrame], keys: Sequence[str], label: str = "union") -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return unique_by(out, keys, label)


def union_loose(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def set_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    l, r = a.select(*keys).distinct(), b.select(*keys).distinct()
    return l.join(r, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(
        r.join(l, list(keys), "left_anti").withColumn("side", F.lit("right"))
    )


def check_disjoint(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys found on both sides; empty when the populations are disjoint."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_semi")


def tables_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 1e-12) -> DataFrame:
    """One row: keys on one side only and, per column, keys whose values differ.

    Numbers may differ by ``atol``; NULL equals NULL.
    """
    types = dict(a.dtypes)
    cols = [c for c in a.columns if c not in keys]
    l = a.select(*keys, F.struct(*cols).alias("_l"))
    r = b.select(*keys, F.struct(*cols).alias("_r"))
    both = l.join(r, list(keys), "full")

    def differs(c: str) -> Column:
        x, y = F.col("_l")[c], F.col("_r")[c]
        if types[c] in ("double", "float"):
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol, F.lit(False)))
        return ~x.eqNullSafe(y)

    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        *[F.count_if(matched & differs(c)).alias("diff_" + c) for c in cols],
    )


def query_rows(variants: DataFrame, entities: DataFrame, entity: str, position: str, cols: Sequence[str]) -> DataFrame:
    """Distinct positions to score, with the parent's columns."""
    return variants.select(entity, position).distinct().join(entities.select(entity, *cols), entity)
