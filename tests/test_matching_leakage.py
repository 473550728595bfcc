import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rankloom.operators import leakage as L
from rankloom.operators import matching as X
from rankloom.operators import similarity
from rankloom.sources.texts import normalize_hits


def test_matched_candidates_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 120
    pdf = pd.DataFrame({"id": range(n), "size": rng.integers(0, 3, n), "cls": rng.integers(0, 3, n).astype(str), "a": rng.integers(0, 60, n) / 10.0, "b": rng.integers(0, 5, n) / 1.0})
    df = spark.createDataFrame(pdf)
    got = X.matched_candidates(df, df, "id", exact=["size"], differ=["cls"], tolerances={"a": 1.5, "b": 2.0}, n=3).toPandas()
    want = []
    for t in pdf.itertuples():
        c = pdf[(pdf["id"] != t.id) & (pdf["size"] == t.size) & (pdf["cls"] != t.cls)].copy() if not callable(t.size) else None
        c["d1"], c["d2"] = (c["a"] - t.a).abs(), (c["b"] - t.b).abs()
        c = c[(c["d1"] <= 1.5) & (c["d2"] <= 2.0)].sort_values(["d1", "d2", "id"]).head(3)
        want += [(t.id, s) for s in c["id"]]
    assert sorted(zip(got["target_id"], got["source_id"])) == sorted(want)


def greedy(edges):
    used_l, used_r, out = set(), set(), []
    for d, l, r in sorted(edges):
        if l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), out.append((l, r))
    return out


@pytest.mark.parametrize("digits", [6])
def test_caliper_match_equals_greedy(spark, digits):
    rng = np.random.default_rng(7)
    l = pd.DataFrame({"id": range(40), "st": rng.integers(0, 2, 40), "u": rng.normal(size=40).round(digits), "v": rng.normal(size=40).round(digits)})
    r = pd.DataFrame({"id": range(100, 150), "st": rng.integers(0, 2, 50), "u": rng.normal(size=50).round(digits), "v": rng.normal(size=50).round(digits)})
    got = X.caliper_match(spark.createDataFrame(l), spark.createDataFrame(r), "id", ["st"], ["u", "v"], 0.8).toPandas()
    both = pd.concat([l, r])
    z = lambda d: (d[["u", "v"]] - both[["u", "v"]].mean()) / both[["u", "v"]].std(ddof=0)
    zl, zr = z(l).to_numpy(), z(r).to_numpy()
    want = []
    for s in (0, 1):
        edges = [(float(np.sqrt(((zl[i] - zr[j]) ** 2).sum())), l["id"][i], r["id"][j]) for i in range(40) for j in range(50) if l["st"][i] == s == r["st"][j]]
        edges = [(round(d, 12), a, b) for d, a, b in edges if d <= 0.8]
        want += greedy(edges)
    assert sorted(zip(got["left_id"], got["right_id"])) == sorted(want)


def test_caliper_match_with_tied_distances(spark):
    """Few distinct covariates, so classes repeat and distances tie; the greedy scan
    runs over the very distances Spark computed."""
    rng = np.random.default_rng(1)
    l = spark.createDataFrame(pd.DataFrame({"id": range(30), "st": 0, "u": rng.integers(0, 4, 30) * 2.0}))
    r = spark.createDataFrame(pd.DataFrame({"id": range(100, 125), "st": 0, "u": rng.integers(0, 4, 25) * 2.0 + 1.0}))
    got = X.caliper_match(l, r, "id", ["st"], ["u"], 1.0).toPandas()
    edges = X.caliper_edges(l, r, "id", ["st"], ["u"], 1.0).toPandas()
    want = greedy(list(zip(edges["distance"], edges["l"], edges["r"])))
    assert sorted(zip(got["left_id"], got["right_id"])) == sorted(want)


def test_equal_rows_pair_by_id(spark):
    """Many equal rows pair off in id order without meeting as all pairs."""
    l = pd.DataFrame({"id": range(300), "st": 0, "u": 1.0})
    r = pd.DataFrame({"id": range(1000, 1250), "st": 0, "u": [1.0] * 200 + [1.5] * 50})
    got = X.caliper_match(spark.createDataFrame(l), spark.createDataFrame(r), "id", ["st"], ["u"], 5.0).toPandas().sort_values("left_id")
    assert got["right_id"].tolist() == list(range(1000, 1250)) and got["left_id"].tolist() == list(range(250))


def test_select_independent_equals_scan(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(60), "st": ["n"] * 60, "cl": rng.integers(0, 25, 60), "o": rng.integers(0, 10, 60)})
    e = pd.DataFrame(rng.integers(0, 60, (50, 2)), columns=["a", "b"]).query("a != b")
    got = X.select_independent(spark.createDataFrame(pdf), spark.createDataFrame(e), "id", ["o"], stratum="st", quota=12, cluster="cl").toPandas()["id"].tolist()
    near = {}
    for a, b in e.itertuples(index=False):
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    chosen, clusters = [], set()
    for row in pdf.sort_values(["o", "id"]).itertuples():
        if row.cl in clusters or near.get(row.id, set()) & set(chosen):
            continue
        chosen.append(row.id), clusters.add(row.cl)
    assert sorted(got) == sorted(chosen[:12])


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _seeds(text, k):
    out, seen = {}, Counter()
    for i in range(max(len(text) - k + 1, 1) if text else 0):
        w = text[i:i + k]
        out[w, seen[w]] = i
        seen[w] += 1
    return out


def _brute_pairs(queries, targets, k, fraction, band=32):
    out = []
    for qi, qs in queries:
        own = _seeds(qs, k)
        for ti, ts in targets:
            other = _seeds(ts, k)
            shared = sorted((own[s], other[s]) for s in own if s in other)
            if not shared or len(shared) < max(1, math.ceil(len(own) * fraction - 1e-9)):
                continue
            support = lambda d: sum(d <= t - q <= d + band for q, t in shared)
            d = max(sorted({t - q for q, t in shared}), key=support)
            parts = [[]]
            for q, t in shared:
                if d <= t - q <= d + band:
                    if parts[-1] and q - parts[-1][-1][0] > band:
                        parts.append([])
                    parts[-1].append((q, t))
            best = max(parts, key=len)
            q0, q1 = best[0][0], best[-1][0] + min(k, len(qs))
            t0, t1 = min(t for _, t in best), max(t for _, t in best) + min(k, len(ts))
            e = _edits(qs[q0:q1], ts[t0:t1])
            out.append((qi, ti, len(shared), len(own), d, len(best), q0, q1, t0, t1, e, 1 - e / max(q1 - q0, t1 - t0), (q1 - q0) / len(qs), (t1 - t0) / len(ts)))
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_similarity_join_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_SEEDS", block)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))

    def edited(s):
        s = list(s)
        for _ in range(3):
            i = rng.randrange(len(s))
            s[i:i + rng.choice([0, 1])] = word(rng.choice([0, 1, 2]))
        return "".join(s)

    q = [(i, word(rng.choice([2, 3, 30, 60]))) for i in range(12)] + [(20, "ab" * 30), (21, "a" * 40), (20, "ba" * 20)]
    t = [(i, word(rng.randrange(40)) + edited(q[i % 12][1]) + word(15)) for i in range(40)] + [(90, "x" * 9 + "ab" * 25), (91, "a" * 33), (92, q[0][1]), (93, "ab"), (94, None), (95, "")]
    got = L.similarity_join(spark.createDataFrame([*q, (30, None), (31, "")], "q int, qs string"), spark.createDataFrame(t, "t int, ts string"), qid="q", tid="t", qseq="qs", tseq="ts", k=4, min_fraction=0.3)
    want = _brute_pairs(q, [(i, s) for i, s in t if s], 4, 0.3)
    assert len(want) >= 25 and any(r[-4] > 0 for r in want)
    for a, b in zip(sorted(tuple(r) for r in got.collect()), want, strict=True):
        assert a[:11] == b[:11] and np.allclose(a[11:], b[11:])


def test_similarity_join_of_repeated_and_short_texts(spark):
    q = spark.createDataFrame([(1, "ABABABABABABAB"), (2, "ABC"), (3, "")], "q int, qs string")
    t = q.selectExpr("q AS t", "qs AS ts")
    got = L.similarity_join(q, t, qid="q", tid="t", qseq="qs", tseq="ts", k=5).collect()
    assert sorted((r.q, r.t, r.shared_seeds, r.n_seeds, r.diagonal, r.sequence_identity) for r in got) == [(1, 1, 10, 10, 0, 1.0), (2, 2, 1, 1, 0, 1.0)]
    assert L.similarity_join(q.where("q > 5"), t, qid="q", tid="t", qseq="qs", tseq="ts").count() == 0


def test_insertion_keeps_the_hit(spark):
    text = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQ"
    q = spark.createDataFrame([(1, text)], "q int, qs string")
    t = spark.createDataFrame([(1, text[:30] + "W" + text[30:])], "t int, ts string")
    r = L.similarity_join(q, t, qid="q", tid="t", qseq="qs", tseq="ts", k=5).first()
    assert r.edits == 1 and r.query_coverage == 1.0 and r.target_coverage == 1.0 and abs(r.sequence_identity - len(text) / (len(text) + 1)) < 1e-12
    assert L.near_duplicates(spark.createDataFrame([r])).count() == 1


def test_edit_costs_of_any_distance():
    rng = random.Random(4)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))), "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for _ in range(150)] + [("", "abc"), ("abc", ""), ("", ""), ("a" * 300, "b" * 200)]
    assert similarity.edit_costs([(similarity.letters(a), similarity.letters(b)) for a, b in pairs]).tolist() == [_edits(a, b) for a, b in pairs]


def test_one_shared_word_is_no_candidate():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    queries = [text(400) for _ in range(5)]
    block = similarity.QueryBlock(queries, 8, 0.5)
    block.index(np.zeros(len(block.words), np.int64))
    seeds = lambda s: similarity.seeds_of(similarity.letters(s), 8)
    assert block.candidates(seeds(text(300) + queries[1][:8] + queries[1][20:28] + queries[1][40:48] + text(300))).tolist() == []
    assert block.candidates(seeds(queries[2][100:])).tolist() == [2]
    assert block.candidates(seeds(queries[3][:100])).tolist() == []
    for i, q in enumerate(queries):
        assert [c[0] for c in block.chains(similarity.letters(text(50) + q[150:360] + text(80)))] == [i]


def test_equal_ends_are_not_aligned(monkeypatch):
    banded, met = similarity._banded, []
    monkeypatch.setattr(similarity, "_banded", lambda pairs, band: met.extend(len(a) + len(b) for a, b in pairs) or banded(pairs, band))
    same, other = "the quick brown fox " * 4000, "the quick brown fox " * 2000 + "or " + "the quick brown fox " * 2000
    ls = similarity.letters
    assert similarity.edit_costs([(ls(same), ls(same)), (ls(same), ls(other)), (ls("aXb" + same), ls("aYYb" + same))]).tolist() == [0, 3, 2]
    assert max(met) < 10


def test_distant_texts_fill_no_wide_band(monkeypatch):
    banded, widths = similarity._banded, []
    monkeypatch.setattr(similarity, "_banded", lambda pairs, band: widths.append(band) or banded(pairs, band))
    rng = random.Random(8)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(200, 500))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 500)))) for _ in range(12)]
    assert similarity.edit_costs([(similarity.letters(a), similarity.letters(b)) for a, b in pairs]).tolist() == [_edits(a, b) for a, b in pairs]
    assert max(widths, default=0) <= similarity.WIDEST


def test_equal_texts_are_aligned_once(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog"
    q = spark.createDataFrame([(i, text) for i in range(4)] + [(9, text[:20] + "XY" + text[20:])], "q int, qs string")
    t = spark.createDataFrame([(i, text) for i in range(50)] + [(None, text)], "t int, ts string")
    folded, counts = similarity._folded, []
    monkeypatch.setattr(similarity, "_folded", lambda *a: counts.append((out := folded(*a)).count()) or out)
    got = L.similarity_join(q, t, qid="q", tid="t", qseq="qs", tseq="ts", k=5)
    assert sorted(((r.q, r.t, r.edits) for r in got.collect()), key=str) == sorted(((i, j, 2 * (i == 9)) for i in (0, 1, 2, 3, 9) for j in [*range(50), None]), key=str)
    assert counts == [2, 1]


def test_words_of_a_target_are_made_once_for_the_blocks_of_a_scan(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SEEDS", 20)
    monkeypatch.setattr(similarity, "SCAN_BLOCKS", 3)
    plain, scans = similarity._aligner, []
    monkeypatch.setattr(similarity, "_aligner", lambda held, *a: scans.append(len(held)) or plain(held, *a))
    q = spark.createDataFrame([(i, "abcdefgh" + "xyz"[i % 3] * 3 + str(i) * 4) for i in range(10)], "q int, qs string")
    got = L.similarity_join(q, q.toDF("t", "ts"), qid="q", tid="t", qseq="qs", tseq="ts", k=4, min_fraction=0.9).collect()
    assert sorted((r.q, r.t) for r in got) == [(i, i) for i in range(10)]
    assert max(scans) == 3 and all(n == 3 for n in scans[:-1])


def test_best_hit_and_percent_rescale(spark):
    rows = [("D1", "B1", 42.0, 90.0, 80.0), ("D1", "B1", 35.0, 100.0, 100.0), ("D2", "B2", 0.5, 0.7, 0.6)]
    out = normalize_hits(spark.createDataFrame(rows, "domain_id string, benchmark_id string, sequence_identity double, query_coverage double, target_coverage double")).toPandas()
    assert len(out) == 2 and out.set_index("domain_id").loc["D1", "sequence_identity"] == 0.42


def test_eligibility_reasons(spark):
    train = spark.createDataFrame([("a", "S1", "h1"), ("b", "S2", "h2"), ("c", "S3", "h3"), ("d", "S4", None)], "domain_id string, sequence string, cath_h string")
    bench = spark.createDataFrame([("x", "S1", "h9"), ("y", "S9", "h2")], "benchmark_id string, sequence string, cath_h string")
    hits = spark.createDataFrame([("c", "x", 0.31, 0.1, 0.1), ("d", "x", 0.2, 1.0, 1.0)], "domain_id string, benchmark_id string, sequence_identity double, query_coverage double, target_coverage double")
    rel = L.leakage_relations(train, bench, hits, train_id="domain_id", bench_id="benchmark_id", exact=[("exact_sequence", ["sequence"])], classes=[("same_cath_h", "cath_h")])
    got = {r["domain_id"]: r["exclusion_reasons"] for r in L.leakage_eligibility(train, rel, "domain_id").collect()}
    assert got == {"a": ["exact_sequence"], "b": ["same_cath_h"], "c": ["sequence_identity"], "d": []}
