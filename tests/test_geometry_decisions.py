import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import classes as K
from rankloom.operators import aggregates as A
from rankloom.operators import decisions as D
from rankloom.operators import geometry as G

RNG = np.random.default_rng(5)


def rotation():
    q, r = np.linalg.qr(RNG.normal(size=(3, 3)))
    q *= np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


def test_superpose_recovers_rotation(spark):
    a = RNG.normal(size=(12, 3)) * 5
    b = (a - 3) @ rotation().T + [7, -2, 1]
    rows = [("e", i, *map(float, a[i]), *map(float, b[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "e string, position int, ax double, ay double, az double, bx double, by double, bz double")
    fit = G.superpose(df, ["e"])
    assert fit.first()["rmsd"] < 1e-6
    back = G.transform_back(df, fit, ["e"]).toPandas().sort_values("position")
    assert np.allclose(back[["mx", "my", "mz"]], a)
    local = G.local_geometry(G.transform_back(df, fit, ["e"]), ["e"], "position").toPandas()
    assert np.allclose(local["local_rmsd"], 0, atol=1e-6) and (local["lddt"].dropna() == 1).all()


def test_contact_edges_brute_force(spark):
    x = RNG.normal(size=(40, 3)) * 6
    df = spark.createDataFrame([(i % 2, i // 2, *map(float, x[i])) for i in range(40)], "e int, position int, x double, y double, z double")
    got = {(r["e"], r["source"], r["target"]) for r in G.contact_edges(df, ["e"], "position", 8.0, 3).collect()}
    want = {(e, p, q) for e in (0, 1) for p in range(20) for q in range(p + 3, 20) if np.linalg.norm(x[2 * p + e] - x[2 * q + e]) <= 8.0}
    assert got == want and want


def test_dihedral_and_angle(spark):
    v = lambda *c: F.array(*[F.lit(float(i)) for i in c])
    r = spark.range(1).select(
        G.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0), v(0, 1, 1)).alias("d"), G.angle(v(1, 0, 0), v(0, 0, 0), v(0, 2, 0)).alias("a")
    ).first()
    assert np.isclose(abs(r["d"]), 90) and np.isclose(r["a"], 90)


def test_maps(spark):
    df = spark.range(8).select(F.col("id").cast("int").alias("position"), F.lit(1).alias("e"), F.lit(8).alias("n"), F.lit(10).alias("s"))
    c = G.circular_map(df, "e", "position", "n", F.col("e"), 0.25, 3).toPandas()
    shift = int(c["shift"].iloc[0])
    assert 2 <= shift <= 6 and sorted(c["source_position"]) == list(range(8))
    m = G.length_map(df, "position", "n", "s").toPandas().sort_values("position")["source_position"].tolist()
    assert m == np.rint(np.linspace(0, 9, 8)).astype(int).tolist()


@pytest.mark.parametrize("w,m,want", [("G", "A", "involves_glycine_or_proline"), ("K", "D", "charge_reversal"), ("A", "V", "within_hydrophobic"),
                                      ("A", "S", "hydrophobic_to_nonhydrophobic"), ("S", "A", "nonhydrophobic_to_hydrophobic"), ("S", "T", "other_polar_or_charged")])
def test_substitution_classes(spark, w, m, want):
    assert spark.range(1).select(K.substitution_class(F.lit(w), F.lit(m)).alias("c")).first()["c"] == want


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.3,), (float("nan"),)], "v double")
    assert [r["c"] for r in df.select(K.burial("v").alias("c")).collect()] == ["buried", "exposed", "intermediate", "missing"]


CASES = [
    ({}, "GO"), ({D.CORE: "FAIL"}, "NO_GO"), ({D.REGULAR: "FAIL"}, "NO_GO"), ({D.SPECIFIC: "FAIL"}, "NO_GO"), ({D.ASSAY: "FAIL"}, "NO_GO"),
    ({D.ACCESS: "FAIL"}, "PIVOT_STRUCTURE_CONDITIONED"), ({D.ENVIRONMENT: "FAIL"}, "PIVOT_STRUCTURE_CONDITIONED"), ({D.RADIUS: "FAIL"}, "NO_GO"),
    ({D.CONSISTENT: "FAIL"}, "NO_GO"), ({D.ON_POLICY: "INCOMPLETE"}, "INCOMPLETE"), ({D.ON_POLICY: "FAIL"}, "DROP_ON_POLICY"),
    ({D.ACCESS: "INCOMPLETE", D.CORE: "FAIL"}, "INCOMPLETE"), ({D.ACCESS: "FAIL", D.RADIUS: "FAIL"}, "PIVOT_STRUCTURE_CONDITIONED"),
]


@pytest.mark.parametrize("changes,want", CASES)
def test_branches(spark, changes, want):
    rows = [(n, changes.get(n, "PASS")) for n in (*D.MANDATORY, D.ON_POLICY)]
    df = spark.createDataFrame(rows, "criterion string, status string")
    assert D.decide(df).first()["decision"] == want


def test_branch_overrides(spark):
    df = spark.createDataFrame([(n, "PASS") for n in (*D.MANDATORY, D.ON_POLICY)], "criterion string, status string")
    assert D.decide(df, scope="stability_only").first()["decision"] == "NARROW_STABILITY"
    assert D.decide(df, real=False).first()["decision"] == "SYNTHETIC_ONLY"


def test_empty_summary_is_incomplete(spark):
    empty = spark.createDataFrame([], "estimate double, ci_low double, ci_high double, n_rows long, n_clusters long")
    assert D.criterion(empty, "c", 0.02).first()["status"] == "INCOMPLETE"


@pytest.mark.parametrize("types,want", [([], "missing"), (["unspecified"], "unspecified"), (["ddG", "Stability"], "stability_only"), (["ddG", "binding"], "multi_assay")])
def test_evidence_scope(spark, types, want):
    df = spark.createDataFrame([(t,) for t in types], "assay_type string")
    assert D.evidence_scope(df).first()["evidence_scope"] == want


def test_missing_gate_row_fails(spark):
    s = spark.createDataFrame([("m", 1.0)], "k string, estimate double")
    g = D.gate_registry(spark, ["k"], [("a", "m", "estimate", ">", 0.0), ("b", "x", "estimate", ">", 0.0)])
    assert {r["gate"]: r["passed"] for r in D.gate_table(s, g, ["k"], ["estimate"]).collect()} == {"a": True, "b": False}


def test_probe_needs_all_controls(spark):
    rows = [("p", "observed", 0, "jsd_reduction", 0.05, 0.01), ("p", "observed", 0, "residual_cosine", 0.5, 0.4), ("p", "shuffled", 1, "jsd_reduction", 0.0, 0.0)]
    df = lambda r: spark.createDataFrame(r, "probe string, control string, repeat int, metric string, estimate double, wild_ci_low double")
    assert D.probe_decision(df(rows), ["probe"], ["shuffled"], 2).first()["status"] == "INCOMPLETE"
    rows.append(("p", "shuffled", 2, "jsd_reduction", 0.01, 0.0))
    assert D.probe_decision(df(rows), ["probe"], ["shuffled"], 2).first()["status"] == "PASS"
    rows.append(("p", "shuffled", 2, "jsd_reduction", 0.06, 0.0))
    assert D.probe_decision(df(rows), ["probe"], ["shuffled"], 2).first()["status"] == "FAIL"


def test_map_class_order(spark):
    rows = [("a", 0.05, 0.01, 0.05, 0.05, 0.5), ("b", 0.05, 0.01, 0.05, None, None), ("c", 0.0, -1.0, None, 0.05, 0.5), ("d", 0.0, -1.0, 0.05, 0.05, 0.5)]
    t = spark.createDataFrame(rows, "k string, estimate double, ci_low double, lift double, jsd_reduction double, residual_cosine double")
    out = A.distillability_map(t.select("k", "estimate", "ci_low"), t.select("k", "lift"), t.select("k", "jsd_reduction", "residual_cosine"), t.select("k"), ["k"])
    assert {r["k"]: r["map_class"] for r in out.collect()} == {"a": "distillable", "b": "valuable_but_unobservable", "c": "nonspecific", "d": "low_value"}


def test_crop_descriptors_equal_direct_computation(spark):
    rng = np.random.default_rng(11)
    rows, edges = [], []
    for e, n in (("a", 12), ("b", 7), ("c", 1)):
        for i in range(n):
            if not (e == "a" and i in (3, 4)):
                rows.append((e, i, *(float(v) for v in rng.normal(size=3) + 1000), ["helix", "strand", "coil", None][rng.integers(4)]))
        edges += [(e, i, j) for i in range(n) for j in range(i + 3, n) if rng.random() < 0.4]
    rows[5] = (*rows[5][:2], None, *rows[5][3:])
    res = spark.createDataFrame(rows, "e string, position int, x double, y double, z double, ss string")
    got = {(r.e, r.crop_length, r.crop_start): tuple(r)[3:] for r in G.window_descriptors(res, spark.createDataFrame(edges, "e string, source int, target int"), ["e"], "position", spark.createDataFrame([(1,), (2,), (5,), (7,), (12,), (40,)], "crop_length int"), "ss").collect()}
    want = {}
    for e, n in (("a", 12), ("b", 7), ("c", 1)):
        for length in (1, 2, 5, 7, 12):
            for s in range(n - length + 1):
                part = [r for r in rows if r[0] == e and s <= r[1] < s + length]
                inside = [j - i for x, i, j in edges if x == e and s <= i and j < s + length]
                if part:
                    axes = [[r[k] for r in part if r[k] is not None] for k in (2, 3, 4)]
                    named = [r[5] for r in part if r[5] is not None]
                    share = lambda c: sum(x == c for x in named) / len(named) if named else None  # noqa: B023, E731
                    want[e, length, s] = (np.sqrt(sum(np.var(a) for a in axes)) if all(axes) else None, share("helix"), share("strand"), np.mean(inside) / length if inside else 0.0, 2 * len(inside) / length)
    assert got.keys() == want.keys() and len(want) > 30
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (k, got[k], values)
