"""Queries do their whole job, and their steps stay bounded."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.catalog import selection as S
from rankloom.catalog import structures as T
from rankloom.operators import aggregates as A
from rankloom.operators import corruption as C
from rankloom.operators import geometry as G
from rankloom.operators import inference as I
from rankloom.operators import matching as X
from rankloom.operators import ranking as R
from rankloom.operators.resampling import mixed
from rankloom.plans import jobs as Jb


@pytest.fixture
def copies(spark, tmp_path):
    """Documents 1, 2 and 4 are copies, 2 and 4 of them benchmarks; 3 and 5 are blank benchmarks."""
    docs = [(1, "same", "en", "a"), (2, "same", "en", "b"), (3, " ", "en", "b"), (4, "same", "de", "b"), (5, None, "de", "b"), (6, "other", "fr", "c")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in (2, 3, 4, 5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_exact_leakage_names_every_benchmark_row(spark, copies):
    rows = S.leakage_exact(spark, copies).where("reason = 'exact_sequence'").collect()
    assert sorted((r["doc_id"], r["bench_id"]) for r in rows) == [(d, b) for d in (1, 2, 4) for b in ("2", "4")]


def test_leakage_summary_counts_every_relation(spark, copies):
    counts = {r["measure"]: r["n"] for r in S.leakage_summary(spark, copies).collect()}
    assert counts["relations_exact_sequence"] == 6 and counts["total"] == 6


def test_a_passage_is_found_behind_earlier_copies_of_its_words(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts = {1: passage[30:] + " and " + passage[:40] + " then " + passage, 2: passage + passage, 3: passage[1:], 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("p", passage), ("q", "aa"), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {(r["item_id"], r["doc_id"]): r["start"] for r in T.unique_substring(spark, str(tmp_path)).collect()}
    assert rows == {("p", 1): texts[1].index(passage), ("p", 2): None}


def _cloud(spark, n=600, entities=2):
    """Points of which most lie in few cells, in blocks of their own; (rows, table)."""
    rng = np.random.default_rng(5)
    rows = [(e, i, *(float(v) for v in rng.normal(size=3) * 0.2), ["helix", "strand", "turn_or_coil"][(i * 7 + e) % 3]) for e in range(entities) for i in range(n)]
    return rows, spark.createDataFrame(rows, "label int, position long, x double, y double, z double, ss string")


def _contacts(rows, cutoff=0.25, sep=3):
    out = []
    for e in sorted({r[0] for r in rows}):
        at = np.array([r[2:5] for r in rows if r[0] == e])
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        out += [(e, int(i), int(j), d[i, j]) for i, j in zip(*np.nonzero(d <= cutoff)) if j - i >= sep]
    return out


def test_degrees_are_counted_without_a_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 32)
    rows, table = _cloud(spark)
    out = G.degrees_within(table, ["label"], "position", 0.25, 3)
    want = Counter(k for e, i, j, _ in _contacts(rows) for k in ((e, i), (e, j)))
    assert {(r["label"], r["position"]): r["contact_degree"] for r in out.collect()} == want


def test_contact_sums_equal_those_of_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 32)
    rows, table = _cloud(spark)
    found = _contacts(rows)
    totals = {r["label"]: (r["_gap"], r["_e"]) for r in G.contact_totals(table, ["label"], "position", 0.25, 3).collect()}
    for e in (0, 1):
        gaps = [j - i for k, i, j, _ in found if k == e]
        assert totals[e] == (pytest.approx(np.mean(gaps)), len(gaps))
    cls = {(r[0], r[1]): r[5] for r in rows}
    length = spark.createDataFrame([(0, 600), (1, 600)], "label int, length long")
    got = {(r["label"], r["separation"], r["classes"], r["contact_order"]): r["n_edges"] for r in G.signature_counts(table, ["label"], "position", length, "ss", 0.25, 3).collect()}
    sign = lambda g: ("3_to_5" if g <= 5 else "6_to_11" if g <= 11 else "12_to_23" if g <= 23 else "24_plus", "local" if g / 600 <= 0.1 else "mesoscale" if g / 600 <= 0.25 else "long_range")
    want = Counter((e, sign(j - i)[0], "__".join(sorted((cls[e, i], cls[e, j]))), sign(j - i)[1]) for e, i, j, _ in found)
    assert got == want


def test_local_geometry_makes_no_row_per_pair(spark):
    rows, table = _cloud(spark, 40)
    pairs = table.select("label", "position", *[F.col(a).alias("a" + a) for a in "xyz"], *[(F.col(a) * 1.1).alias("m" + a) for a in "xyz"])
    out = G.local_geometry(pairs, ["label"], "position", local=0.2, lddt=0.3, thresholds=(0.02,), contact=0.25)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and out.count() == len(rows)
    edges = G.contact_edges(table, ["label"], "position", 0.25, 3)
    assert "MapInArrow" in edges._jdf.queryExecution().toString()
    assert {(r["label"], r["source"], r["target"]) for r in edges.collect()} == {c[:3] for c in _contacts(rows)}


def test_blocks_of_contacts_meet_once_and_equal_distances_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 32)
    rows, table = _cloud(spark, 200)
    every = G._near_blocks(table, ["label"], "position", 0.25).count()
    blocks = G._point_blocks(table, ["label"], "position", 0.25)
    assert G._blocks_once(blocks, ["label"]).count() == (every + blocks.count()) // 2
    out = G.contact_edges(table, ["label"], "position", 0.25, 3, digits=2)
    plain = spark.createDataFrame([(*c[:3], float(c[3])) for c in _contacts(rows)], "label int, source long, target long, d double").withColumn("d", F.round("d", 2))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    runs = out.select("label", "distance").rdd.glom().map(lambda part: sum((a["label"], a["distance"]) != (b["label"], b["distance"]) for a, b in zip(part, part[1:])))
    assert sum(runs.collect()) < plain.count() / 3


@pytest.mark.parametrize("far", [0, 1 << 40])
def test_contacts_are_ordered_as_numbers_or_by_place(far):
    rng = np.random.default_rng(2)
    step, ends = rng.integers(0, 50, 300).astype(float), rng.integers(0, 1000, (2, 300)) + np.array([[0], [far]])
    got = G.by_step(step, *ends)
    assert sorted(zip(*got)) == sorted(zip(step, *ends)) and (np.diff(got[0]) >= 0).all()


def test_steps_are_rounded_as_decimals(spark):
    x = np.array([0.0, 0.0000005, 0.1234565, 0.2499995, 0.0000015, 0.24999949999999999, 7.1234565])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert (G.decimal_steps(x, 6) / 1e6).tolist() == want


def test_sampled_edges_sort_one_bucket_alone(spark):
    edges = spark.range(400).select((F.col("id") % 2).alias("e"), F.col("id").alias("source"), (F.col("id") + 3).alias("target"))
    out = G.sample_edges(edges, ["e"], 0.25, [1, 2])
    kept = {(r["seed"], r["e"], r["source"]) for r in out.collect()}
    for seed in (1, 2):
        x = {i: int(mixed(np.array([i * 100003 + i + 3]), np.array([seed]), 17)[0, 0]) for i in range(400)}
        for e in (0, 1):
            own = sorted(range(e, 400, 2), key=lambda i: (x[i], i))
            assert {i for s, k, i in kept if (s, k) == (seed, e)} == set(own[50:])
    assert "shiftright" in out._jdf.queryExecution().toString() or "_bucket" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("frac", [0.25, 0.0, 1.0])
def test_contacts_are_sampled_where_points_meet(spark, monkeypatch, frac):
    monkeypatch.setattr(G, "BLOCK", 32)
    rows, table = _cloud(spark, 80)
    held, plain = [], G.ordinals
    monkeypatch.setattr(G, "ordinals", lambda df, *a, **kw: held.append(df.count()) or plain(df, *a, **kw))
    out = G.sample_contacts(table, ["label"], "position", 0.25, 3, frac, [1, 2])
    edges = spark.createDataFrame([c[:3] for c in _contacts(rows)], "label int, source long, target long")
    want = G.sample_edges(edges, ["label"], frac, [1, 2]).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert held[0] < edges.count() / 20
    assert out.columns == ["label", "source", "target", "seed"]


def test_crops_count_contacts_where_points_meet(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    rows, table = _cloud(spark, 60)
    lengths = spark.createDataFrame([(50,), (59,), (60,)], "crop_length int")
    out = G.window_descriptors(table, None, ["label"], "position", lengths, "ss", cutoff=0.25, sep=3)
    got = {(r["label"], r["crop_length"], r["crop_start"]): r["mean_contact_degree"] for r in out.collect()}
    found = _contacts(rows)
    want = {(e, n, s): 2 * sum(k == e and s <= i and j < s + n for k, i, j, _ in found) / n for e in (0, 1) for n in (50, 59, 60) for s in range(61 - n)}
    assert got == pytest.approx(want)


def test_windows_meet_targets_without_their_letters(spark, monkeypatch):
    monkeypatch.setattr(X, "RUN_STARTS", 2)
    whole = {1: "abcde", 2: "abxdeabcdz", 3: "zzzzzzzz"}
    crops = [(d, s, 5, d % 2, float(s * d)) for d in (2, 3) for s in range(len(whole[d]) - 4)]
    targets = spark.createDataFrame([(1, 1, whole[1], 4.0)], "target_id int, stratum int, sequence string, v double")
    windows = spark.createDataFrame(crops, "donor_id int, crop_start int, crop_length int, stratum int, v double")
    sequences = spark.createDataFrame(list(whole.items()), "donor_id int, sequence string")
    out = X.match_windows(targets, windows, sequences, descriptors=["v"], scales={"v": 2.0}, n=2)
    assert "_tq" not in out.columns and not any("sequence" in c and "identity" not in c for c in out.columns)
    got = {r["donor_id"]: (r["crop_start"], r["sequence_identity"], r["descriptor_distance"], r["objective"]) for r in out.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(a, b)) / 5
    want = {}
    for d, s, _, st, v in crops:
        i, far = same(whole[1], whole[d][s : s + 5]), abs(v - 4.0) / 2
        if i < 0.3:
            one = (far + 0.25 * (st != 1), i, s, far)
            want[d] = min(want.get(d, one), one)
    assert got == {d: (s, i, far, o) for d, (o, i, s, far) in want.items()} and len(got) == 2


def test_contacts_inside_every_crop_are_counted_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    source = rng.integers(0, 190, 3000)
    target = np.minimum(source + rng.integers(3, 100, 3000), 199)
    plain, met = G.crop_steps, []
    monkeypatch.setattr(G, "crop_steps", lambda s, *a: met.append(len(s)) or plain(s, *a))
    steps = {n: np.zeros((2, 202 - n)) for n in (195, 198, 200)}
    G.add_crop_steps(steps, source, target, 200)
    for n, got in steps.items():
        assert (got == plain(source, target, 200, n)).all()
    assert max(met) < 1000


def test_caliper_match_holds_few_pairs_at_once(spark, monkeypatch):
    """Pairs in the caliper are many; what a step holds is bounded and the result is the greedy one, with copies and ties."""
    rng = np.random.default_rng(3)
    l = [(i, 0, float(u), float(v)) for i, (u, v) in enumerate(np.repeat(rng.integers(0, 60, (80, 2)), 3, 0))]
    r = [(1000 + i, 0, float(u), float(v)) for i, (u, v) in enumerate(np.repeat(rng.integers(0, 60, (90, 2)), 3, 0))]
    lt, rt = (spark.createDataFrame(d, "id long, st int, u double, v double") for d in (l, r))
    edges = X.caliper_edges(lt, rt, "id", ["st"], ["u", "v"], 1.0).collect()
    monkeypatch.setattr(X, "HELD_PAIRS", 10)
    monkeypatch.setattr(X, "PAIRS_PER_ROW", 2)
    held = []
    plain = X.settle
    monkeypatch.setattr(X, "settle", lambda d: (held.append(d.count() if "distance" in d.columns else 0), plain(d))[1])
    got = X.caliper_match(lt, rt, "id", ["st"], ["u", "v"], 1.0).collect()
    monkeypatch.setattr(X, "settle", plain)
    used_l, used_r, want = set(), set(), []
    for d, a, b in sorted((e["distance"], e["l"], e["r"]) for e in edges):
        if a not in used_l and b not in used_r:
            used_l.add(a), used_r.add(b), want.append((a, b))
    assert sorted((g["left_id"], g["right_id"]) for g in got) == sorted(want)
    assert max(held) < len(edges) / 4


def test_large_groups_are_swept_in_ranges_without_a_row_per_draw(spark, monkeypatch):
    """Groups beyond a sweep give the same interval when one side has few levels; ties, gaps and copies included."""
    rng = np.random.default_rng(11)
    rows = [(i % 2, int(rng.integers(0, 40)), float(rng.integers(0, 6)), float(rng.integers(0, 4)), None if i % 17 == 0 else float(rng.integers(0, 300))) for i in range(900)]
    rows = [(g, c, None if i % 23 == 0 else q, d, y) for i, (g, c, q, d, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g int, c int, q double, d double, y double")
    run = lambda **kw: sorted(I.group_bootstrap_diff(df, ["g"], "c", "q", "d", "y", 20, 0.9, 2, **kw).collect())
    whole = run()
    monkeypatch.setattr(I, "cluster_draws", None)
    assert [tuple(r) for r in run(rows_per_split=100)] == [pytest.approx(tuple(r)) for r in whole]


def test_large_groups_of_few_clusters_keep_counts_instead_of_draws(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i % 2, int(rng.integers(0, 5 + i % 2)), float(rng.integers(0, 200)), None if i % 17 == 0 else float(rng.integers(0, 300))) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, c int, x double, y double")
    run = lambda **kw: sorted(I.cluster_bootstrap_stat(df, ["g"], "c", I.spearman_stat("x", "y"), 20, 0.9, 2, **kw).collect())
    whole = run()
    monkeypatch.setattr(I, "cluster_draws", None)
    assert [tuple(r) for r in run(rows_per_split=100)] == [pytest.approx(tuple(r)) for r in whole]


def test_nearest_controls_start_at_a_width_that_meets_few(spark, monkeypatch):
    rows = [(i, i % 2, i % 5, i * 0.01) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, t int, g int, x double")
    met = []
    near = X._near
    monkeypatch.setattr(X, "_near", lambda *a: (met.append(near(*a).count()), near(*a))[1])
    got = X.matched_candidates(df, df, "id", exact=["g"], differ=["t"], tolerances={"x": 20.0}, n=2).collect()
    assert sum(met) < 100 * len(rows) and len(got) == 2 * len(rows)
    assert {(r["target_id"], r["source_id"]) for r in got if r["target_id"] == 1000} == {(1000, 995), (1000, 1005)}


TEXTS = [(1, "acdefghi klmno"), (2, "z"), (3, ""), (4, None), (5, "日本語 abc" * 9), (9_000_000, "ab" * 700)]


def test_bank_draws_texts_at_once(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "id long, seq string")
    symbols = "abcdefghij語"
    for letters in (C.LETTERS_AT_ONCE, 20):
        monkeypatch.setattr(C, "LETTERS_AT_ONCE", letters)
        bank = C.build_bank(df, "id", "seq", F.col("id"), [0.05, 0.4], 2, 3, symbols, "#")
        draw = F.col("id") * 97 + F.rint(F.col("level") * 1000).cast("long") * 7 + F.col("replicate")
        mask, swap = C.mask_random("reference_sequence", draw, F.col("level"), 3, "#"), C.substitute_uniform("reference_sequence", draw, F.col("level"), 13, symbols)
        want = F.when(F.col("state_kind") == "random_mask", mask).when(F.col("state_kind") == "random_substitution", swap).otherwise(F.col("reference_sequence"))
        assert bank.count() == len(TEXTS) * 9 and bank.where(~F.col("state_sequence").eqNullSafe(want)).isEmpty()
    assert "MapInArrow" in bank._jdf.queryExecution().executedPlan().toString()


def plain_spans(key, n, ratio, mean, seed):
    count = min(n, max(1, round(n * ratio)))
    first = {}
    for s in range(2 * count + 1):
        a, u = int(mixed(np.array([key]), np.array([s]), seed)[0, 0]) % n, mixed(np.array([key]), np.array([s]), seed + 1)[0, 0] / 2147483647.0
        for p in range(a, min(n, a + max(1, sum(c < u for c in C._poisson_steps(mean))))):
            first.setdefault(p, s)
    for p in range(n):
        first.setdefault(p, 2 * count + 1)
    last = sorted((s, p) for p, s in first.items())[count - 1][0]
    return sorted(p for p, s in first.items() if s <= last)[:count]


def test_spans_are_laid_out_without_a_row_per_letter(spark, monkeypatch):
    lengths = [(1, 40), (2, 1), (3, 0), (4, None), (5, 333), (6, 7), (6, 7)]
    df = spark.createDataFrame(lengths, "id long, n int")
    for letters in (C.LETTERS_AT_ONCE, 20):
        monkeypatch.setattr(C, "LETTERS_AT_ONCE", letters)
        for ratio in (0.15, 0.9):
            out = C.span_positions(df, "id", "n", F.col("id"), ratio, 4.0, 5)
            got = sorted((r["id"], r["position"]) for r in out.collect())
            assert got == [(i, p) for i, n in lengths[:-1] if n for p in plain_spans(i, n, ratio, 4.0, 5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_measurements_are_grouped_once(spark):
    rows = [(1, 1, 0.5), (1, 1, 0.1), (1, 1, 0.1), (1, 1, 0.9), (1, 2, 0.3), (2, 1, None), (2, 2, float("nan")), (None, 1, 0.2)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    out = A.collapse_measurements(df, ["a", "b"], "v")
    assert out.columns == ["a", "b", "n_measurements", "effect_min", "effect_max", "effect"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 4, -0.9, -0.1, -0.3), (1, 2, 1, -0.3, -0.3, -0.3)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [10_000, 40])
@pytest.mark.parametrize("gaps", [False, True])
def test_a_correlation_table_sorts_folded_values_alone(spark, monkeypatch, rows, gaps):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 400), "a": rng.integers(0, 7, 400) * 1.0, "b": rng.normal(size=400), "c": rng.normal(size=400).round(1), "d": rng.integers(0, 3, 400) * 1.0})
    if gaps:
        pdf.loc[::9, "a"] = np.nan
        pdf.loc[::7, "c"] = np.inf
    sorted_rows, kept = [], I.ordinals
    monkeypatch.setattr(I, "ordinals", lambda df, *args, **kw: sorted_rows.append(df.count()) or kept(df, *args, **kw))
    got = {(r["g"], r["x_name"], r["y_name"]): (r["n_rows"], r["spearman"]) for r in R.correlation_table(spark.createDataFrame(pdf), ["g"], ["a", "b"], ["c", "d"], rows_per_split=rows).collect()}
    clean = pdf.replace(np.inf, np.nan)
    for g, part in clean.groupby("g"):
        for x in "ab":
            for y in "cd":
                both = part[[x, y]].dropna()
                n, rho = got.pop((g, x, y))
                assert n == len(both) and np.isclose(rho, both.rank().corr().iloc[0, 1])
    assert not got
    # No row per pair is sorted, and in small groups nothing is folded first.
    assert sum(sorted_rows) <= (0 if rows > 400 else 2 * len(pdf))


@pytest.mark.parametrize("split", [1_000_000, 30])
def test_subgroups_of_few_rows_are_not_measured(spark, tmp_path, monkeypatch, split):
    rows = [(1, i, "many" if i < 45 else f"few{i // 3}", float(i * 7 % 11), None if i % 9 == 0 else float(i * i % 13)) for i in range(60)]
    df = spark.createDataFrame(rows, "e long, i long, d string, m double, y double")
    kept = R.measures

    def noted(score, outcome, fraction):
        (tmp_path / f"{len(score)}-{outcome.sum()}").touch()
        return kept(score, outcome, fraction)

    monkeypatch.setattr(R, "measures", noted)
    got = R.subgroup_metrics(df, ["e"], ["d"], ["m"], "y", ["i"], min_rows=40, rows_per_split=split).collect()
    assert [(r["level"], r["n_rows"]) for r in got] == [("many", 40)]
    assert R.subgroup_metrics(df, ["e"], ["d"], ["m"], "y", ["i"], min_rows=41, rows_per_split=split).count() == 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == (["40"] if split > 40 else [])


def test_an_external_job_writes_both_sides_before_they_meet(spark, monkeypatch):
    written, kept = [], Jb.settle
    monkeypatch.setattr(Jb, "settle", lambda df: written.append(df.columns) or kept(df))
    pred = spark.createDataFrame([(e, k, float(k * e % 5), 1.0) for e in (1, 2) for k in range(6)], "e long, k long, q double, d double")
    meas = spark.createDataFrame([(e, k, float(-k - i)) for e in (1, 2) for k in range(6) for i in range(3)], "e long, k long, v double")
    out = Jb.job_external(pred, meas, {"a": {"q": 1.0}, "b": {"q": 1.0, "d": 2.0}}, [("b_over_a", "b", "a")], entity="e", key=["k"], value="v", min_entities=1, primary="b_over_a", replicates=20, seed=1)
    assert written[:2] == [["e", "k", "effect"], ["e", "k", "a", "b"]]
    assert {(r["e"], r["method"], r["n_rows"]) for r in out["metrics"].collect()} == {(e, m, 6) for e in (1, 2) for m in "ab"}
