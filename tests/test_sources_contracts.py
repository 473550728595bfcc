import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import sequences as Q
from rankloom.operators import contracts as K
from rankloom.operators import corruption as C
from rankloom.operators import joins as J
from rankloom.operators import profiles as P
from rankloom.sources import bundles as B
from rankloom.sources import tables as T
from rankloom.sources import texts as X
from rankloom.streaming.pending import score_new_requests


def test_read_table_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "x"')], "k int, s string")
    for fmt in ("parquet", "csv", "tsv"):
        T.write_table(df, f"{tmp_path}/t.{fmt}", fmt)
        back = T.read_table(spark, f"{tmp_path}/t.{fmt}", "k int, s string")
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, 'say "x"')]
    assert T.read_table(spark, None) is None
    with pytest.raises(K.ContractError, match="suffix"):
        T.read_table(spark, "x.json")


def test_outcome_column_is_not_scanned(spark, tmp_path):
    T.write_table(spark.createDataFrame([(1, 2.0)], "k int, ddG double"), f"{tmp_path}/t.parquet")
    df = T.read_without(spark, f"{tmp_path}/t.parquet", ["ddG"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ddG" not in plan and df.columns == ["k"]
    with pytest.raises(K.ContractError, match="lacks"):
        T.read_without(spark, f"{tmp_path}/t.parquet", ["effect"])


def test_fasta_round_trip_and_duplicates(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">cath|4_4_0|1abcA00/1-9\nacde\nFG\n>plain words\nKL\n")
    got = {r["id"]: r["sequence"] for r in X.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"1abcA00": "ACDEFG", "plain": "KL"}
    X.write_fasta(spark.createDataFrame([("x", "AC"), ("y", "DE")], "id string, sequence string"), f"{tmp_path}/out")
    assert {r["id"]: r["sequence"] for r in X.read_fasta(spark, f"{tmp_path}/out").collect()} == {"x": "AC", "y": "DE"}
    (tmp_path / "b.fasta").write_text(">x\nAC\n>x\nDE\n")
    with pytest.raises(Exception, match="repeated key"):
        X.read_fasta(spark, str(tmp_path / "b.fasta")).collect()


def test_hierarchy_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\n1oaiA00 1 10 8 10 1 1 1 1 1 59 1.000\n2abcB01 2 40 50 140 1 1 1 1 1 80 999.000\n")
    rows = {r["domain_id"]: r for r in X.read_hierarchy_list(spark, str(tmp_path / "l.txt")).collect()}
    assert rows["1oaiA00"]["cath_h"] == "1.10.8.10" and rows["1oaiA00"]["cath_t"] == "1.10.8" and rows["1oaiA00"]["chain_id"] == "A"
    assert rows["2abcB01"]["resolution"] is None and rows["2abcB01"]["length"] == 80
    (tmp_path / "m.txt").write_text("1oaiA00 1 10\n")
    with pytest.raises(Exception, match="too few"):
        X.read_hierarchy_list(spark, str(tmp_path / "m.txt")).collect()


def test_property_records(spark, tmp_path):
    first = " ".join(str(i) for i in range(10))
    second = " ".join("NA" if i == 19 else str(i) for i in range(10, 20))
    (tmp_path / "p.txt").write_text(f"H TEST01\nD text\nI A/L R/K\n {first}\n {second}\n//\nH SHORT\nD x\nI A/L\n 1 2 3\n//\n")
    rows = {(r["property_id"], r["symbol"]): r["value"] for r in X.read_property_records(spark, str(tmp_path / "p.txt")).collect()}
    assert len(rows) == 20 and rows["TEST01", "A"] == 0.0 and rows["TEST01", "R"] == 1.0 and rows["TEST01", "L"] == 10.0 and rows["TEST01", "V"] is None


def test_shards_and_bundle(spark, tmp_path):
    T.write_sharded(spark.range(100).coalesce(1), f"{tmp_path}/s", 30)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 4
    good = spark.createDataFrame([("r1", "s", "d", "AC", "paired", "x", 2)], "request_id string, state_id string, domain_id string, state_sequence string, structure_role string, structure_id string, length int")
    B.save_bundle({"requests": good}, f"{tmp_path}/b", {"requests": B.REQUESTS})
    assert B.load_bundle(spark, f"{tmp_path}/b", {"requests": B.REQUESTS})["requests"].count() == 1
    with pytest.raises(K.ContractError, match="repeats"):
        B.save_bundle({"requests": good.union(good)}, f"{tmp_path}/c", {"requests": B.REQUESTS})


def test_finalize_needs_exact_ids(spark):
    req = spark.createDataFrame([("a",), ("b",)], "request_id string")
    parts = spark.createDataFrame([("a", 1)], "request_id string, v int")
    assert [r[0] for r in T.pending_requests(req, parts).collect()] == ["b"]
    with pytest.raises(Exception, match="missing 1, extra 0"):
        T.finalize_parts(req, parts).collect()


def test_stream_scores_each_request_once(spark, tmp_path):
    run = lambda: score_new_requests(spark, f"{tmp_path}/req", "request_id string, n int", lambda p: p.assign(score=p["n"] * 2.0)[["request_id", "score"]], "request_id string, score double", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    spark.createDataFrame([("a", 1), ("b", 2)], "request_id string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
    run()
    spark.createDataFrame([("c", 3)], "request_id string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("a", 2.0), ("b", 4.0), ("c", 6.0)]


def test_join_cardinality_and_missing_baseline(spark):
    l = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    r = spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    with pytest.raises(Exception, match="repeated key"):
        J.join_checked(l, r, ["k"]).collect()
    rows = spark.createDataFrame([(1, "base", 1.0), (2, "other", 2.0)], "k int, s string, v double")
    with pytest.raises(Exception, match="no baseline"):
        J.with_baseline(rows, ["k"], F.col("s") == "base", ["v"]).collect()


def test_unique_find(spark):
    df = spark.createDataFrame([("XXACDEYY", "ACDE")], "t string, p string")
    assert df.select(Q.unique_find("t", "p").alias("s")).first()["s"] == 2
    with pytest.raises(Exception, match="absent or repeated"):
        df.select(Q.unique_find(F.lit("ACAC"), F.lit("AC"))).collect()


def test_profile_skips_self_hit(spark):
    seqs = spark.createDataFrame([("q", "ACDE")], "id string, seq string")
    hits = spark.createDataFrame([("q", "q", 1, "ACDE", "ACDE"), ("q", "h", 1, "ACDE", "AFGE")], "query string, target string, qstart int, qaln string, taln string")
    rows = P.homolog_profile(seqs, hits, "id", "seq", lo=0.2, hi=0.8, coverage=0.7).toPandas().sort_values("position")
    assert (rows["accepted_hits"] == 1).all() and rows["profile"].map(sum).round(9).eq(1).all()
    cons = P.conservation(hits, seqs, "id", "seq").toPandas().sort_values("position")
    assert cons["conservation_score"].tolist() == [1.0, 0.0, 0.0, 1.0]


def test_profile_gap_and_offset(spark):
    seqs = spark.createDataFrame([("q", "ACDE")], "id string, seq string")
    hits = spark.createDataFrame([("q", "h", 2, "C-DE", "CWD-")], "query string, target string, qstart int, qaln string, taln string")
    cons = P.conservation(hits, seqs, "id", "seq").toPandas().sort_values("position")
    assert cons["homolog_observations"].tolist() == [0, 1, 1, 0] and cons["conservation_score"].tolist() == [0.5, 1.0, 1.0, 0.5]


def test_states_change_the_right_number(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY") for i in range(5)], "id int, seq string")
    bank = C.describe_states(C.build_bank(df, "id", "seq", F.col("id"), [0.05, 0.3], 2)).toPandas()
    assert len(bank) == 5 * 9
    for r in bank.itertuples():
        want = 0 if r.state_kind == "native" else round(20 * r.level)
        assert r.edit_distance == want and len(r.state_sequence) == 20
        assert r.mask_count == (want if r.state_kind == "random_mask" else 0)
    assert bank.groupby("state_kind")["state_sequence"].nunique()["random_mask"] > 15
    again = C.build_bank(df.repartition(3), "id", "seq", F.col("id"), [0.05, 0.3], 2).toPandas()
    keys = ["id", "state_kind", "level", "replicate"]
    assert bank.sort_values(keys)["state_sequence"].tolist() == again.sort_values(keys)["state_sequence"].tolist()


def test_scorer_plug_in(spark):
    req = spark.createDataFrame([("a", "ACD")], "request_id string, seq string")
    out = C.score_requests(req, lambda p: pd.DataFrame({"request_id": p["request_id"], "n": p["seq"].str.len()}), "request_id string, n long")
    assert out.first()["n"] == 3


def test_ledgers(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "k int, v double")
    rules = [("low", F.col("v") >= 10), ("odd", F.col("k") % 2 == 0)]
    assert {r["k"]: r["reason"] for r in K.quality_filter(df, rules)[1].collect()} == {1: "low", 2: "low", 3: "odd"}
    assert K.exclusion_ledger(df, rules).count() == 4 and K.eligible(df, rules).isEmpty()


def test_mutations_look_letters_up(spark):
    """A parent's letter is found without a scan of the parent for every mutation."""
    parents = spark.createDataFrame([("a", "ACDE"), ("b", "日A")], "id string, seq string")
    rows = [("a", " A1C ", "1.5"), ("a", "C2D\n", "2"), ("a", "C1D", "1"), ("a", "E4E", "1"), ("a", "E4A", "x"), ("a", "E9A", "1"), ("a", "E0A", "1"), ("a", "E99999999999A", "1"),
            ("a", "ee4A", "1"), ("a", "", "1"), ("a", None, "1"), ("b", "A2C", "3"), ("c", "A1C", "1")]
    made = spark.createDataFrame(rows, "id string, mutation string, effect string")
    out = Q.parse_mutations(made, parents, "id", "mutation", "effect", "seq")
    assert out.columns == ["id", "mutation", "effect", "wild_type", "position", "mutant", "seq"]
    assert sorted((r["id"], r["wild_type"], r["position"], r["mutant"], r["effect"], r["seq"]) for r in out.collect()) == [
        ("a", "A", 0, "C", 1.5, "ACDE"), ("a", "C", 1, "D", 2.0, "ACDE"), ("b", "A", 1, "C", 3.0, "日A")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(seq" not in plan and "_letters" in plan


def test_conservation_joins_no_letters(spark):
    seqs = spark.createDataFrame([("q", "ACDE"), ("p", "AC"), ("e", ""), ("n", None)], "id string, seq string")
    rows = [("q", "h", 1, "ACDE", "ACWE"), ("q", "q", 1, "ACDE", "ACDE"), ("q", "i", 2, "C-DEY", "CWDAY"), ("q", "j", 0, "AA", "AA"), ("x", "h", 1, "AC", "AC")]
    hits = spark.createDataFrame(rows, "query string, target string, qstart int, qaln string, taln string")
    out = P.conservation(hits, seqs, "id", "seq")
    got = sorted((r["query"], r["position"], r["native"], r["homolog_observations"], r["conservation_score"]) for r in out.collect())
    assert got == [("p", 0, "A", 0, 0.5), ("p", 1, "C", 0, 0.5), ("q", 0, "A", 2, 1.0), ("q", 1, "C", 2, 1.0), ("q", 2, "D", 2, 0.5), ("q", 3, "E", 2, 0.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_profile_counts_travel_as_a_map(spark):
    seqs = spark.createDataFrame([("q", "ACDE"), ("p", "AC")], "id string, seq string")
    hits = spark.createDataFrame([("q", "h", 1, "ACDE", "AFGE"), ("q", "i", 1, "ACDE", "AF-E")], "query string, target string, qstart int, qaln string, taln string")
    out = P.homolog_profile(seqs, hits, "id", "seq", lo=0.2, hi=0.8, coverage=0.7)
    rows = {(r["query"], r["position"]): r for r in out.collect()}
    assert len(rows) == 6 and [rows["q", i]["observed"] for i in range(4)] == [2, 2, 1, 2]
    assert rows["q", 1]["profile"][4] == 2.5 / 12 and rows["q", 2]["profile"][5] == 1.5 / 11 and rows["p", 0]["profile"] == [0.05] * 20
    assert (rows["q", 0]["accepted_hits"], rows["p", 0]["accepted_hits"]) == (2, 0)
    assert "n_W" not in out._jdf.queryExecution().optimizedPlan().toString()
