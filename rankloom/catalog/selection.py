"""Ledgers, leakage, similarity, matching and samples over the text and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import r6, rounded, scorers, table
from rankloom.functions import sequences as Q
from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A
from rankloom.operators import contracts as K
from rankloom.operators import controls as C
from rankloom.operators import joins as J
from rankloom.operators import leakage as L
from rankloom.operators import matching as X
from rankloom.operators import ordering as O
from rankloom.operators.inference import mix_value
from rankloom.session import settle


def _documents(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


RULES = [
    ("too_short", "n_chars >= 500"),
    ("unlabelled", "quality IS NOT NULL"),
    ("low_quality", "quality = 1"),
    ("toxic", "toxic = 0"),
    ("language", "lang IN ('en', 'de')"),
]


def _rules():
    return [(n, F.expr(e)) for n, e in RULES]


def quality_first_reason(spark, sf):
    kept, out = K.quality_filter(_documents(spark, sf), _rules())
    return kept.select("doc_id", F.lit("kept").alias("reason")).unionByName(out.select("doc_id", "reason"))


def quality_ledger(spark, sf):
    return K.exclusion_ledger(_documents(spark, sf), _rules()).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def candidate_funnel(spark, sf):
    d = table(spark, sf, "documents")
    toxic = _documents(spark, sf).where("toxic = 1").select(F.concat("lang", "source").alias("grp")).distinct()
    rows = d.withColumn("grp", F.concat("lang", "source")).withColumn("doc_key", F.md5("text"))
    out = K.candidate_funnel(rows, key="doc_key", members=rows.select("doc_key"), prior=toxic, group="grp",
                             rules=[("long", F.col("n_chars") >= 100)], order=["n_chars", "doc_id"])
    return out.select("doc_id", "grp", "n_chars")


def _train(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.concat("lang", "source").alias("class_h"))


def _relations(spark, sf, every=False):
    t = _train(spark, sf)
    bench = t.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").withColumnRenamed("doc_id", "bench_id")
    return L.leakage_relations(t, bench, train_id="doc_id", bench_id="bench_id",
                               exact=[("exact_sequence", ["text"])], classes=[("same_class", "class_h")], every=every)


def leakage_exact(spark, sf):
    return _relations(spark, sf, every=True).select("doc_id", "bench_id", "reason", "sequence_identity", "query_coverage")


def leakage_eligibility(spark, sf):
    e = L.leakage_eligibility(_train(spark, sf), _relations(spark, sf), "doc_id")
    return e.select("doc_id", "eligible_for_training", F.array_join("exclusion_reasons", ",").alias("reasons"))


def leakage_summary(spark, sf):
    return L.leakage_summary(_train(spark, sf), settle(_relations(spark, sf, every=True)), "doc_id")


def train_bench_overlap(spark, sf):
    t = _train(spark, sf)
    good = t.join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")
    bad = t.join(table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_semi")
    diff = K.set_diff(good, bad, ["class_h"])
    both = K.check_disjoint(good, bad, ["class_h"]).withColumn("side", F.lit("both"))
    return diff.unionByName(both)


def _hits(spark, sf):
    return L.similarity_join(table(spark, sf, "benchmark"), table(spark, sf, "documents"), qid="item_id", tid="doc_id",
                             qseq="text", tseq="text", k=8, min_fraction=0.3)


def kmer_similarity(spark, sf):
    return rounded(_hits(spark, sf))


def near_duplicates(spark, sf):
    return rounded(L.near_duplicates(L.best_hits(_hits(spark, sf), ["item_id", "doc_id"]), 0.8, 0.05))


def matched_controls(spark, sf):
    p = table(spark, sf, "part").withColumn("name_len", F.length("p_name"))
    return rounded(X.matched_candidates(p, p, "p_partkey", exact=["p_size"], differ=["p_type"],
                                        tolerances={"p_retailprice": 200.0, "name_len": 3.0}, n=3))


def _sides(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double"))
    return o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")


COVARIATES = ["o_totalprice", "day"]


def caliper_edges(spark, sf):
    l, r = _sides(spark, sf)
    return rounded(X.caliper_edges(l, r, "o_orderkey", ["o_orderpriority"], COVARIATES, 0.05))


def caliper_match(spark, sf):
    l, r = _sides(spark, sf)
    return rounded(X.caliper_match(l, r, "o_orderkey", ["o_orderpriority"], COVARIATES, 0.05))


def smd_before_matching(spark, sf):
    l, r = _sides(spark, sf)
    return rounded(A.smd_table(l, r, ["o_orderpriority"], COVARIATES, 0.10))


def matched_effects(spark, sf):
    l, r = _sides(spark, sf)
    m = settle(X.caliper_match(l, r, "o_orderkey", ["o_orderpriority"], COVARIATES, 0.05))
    lv = l.select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("left_cust"), *[F.col(c).alias("l_" + c) for c in COVARIATES])
    rv = r.select(F.col("o_orderkey").alias("right_id"), *[F.col(c).alias("r_" + c) for c in COVARIATES])
    rows = settle(m.join(lv, "left_id").join(rv, "right_id").withColumn("gap", F.col("l_o_totalprice") - F.col("r_o_totalprice")).withColumn("cl", F.col("left_cust") % 25))
    side = lambda s: rows.select("o_orderpriority", *[F.col(f"{s}_{c}").alias(c) for c in COVARIATES])
    bal = A.smd_table(side("l"), side("r"), ["o_orderpriority"], COVARIATES)
    return rounded(A.matched_effects(rows, ["o_orderpriority"], "gap", "cl", l, bal, 0.05, 0.1, replicates=100, seed=3), 4)


def select_independent(spark, sf):
    p = table(spark, sf, "part").withColumn("name_len", F.length("p_name"))
    near = X.matched_candidates(p, p, "p_partkey", exact=["p_type", "p_size"], tolerances={"p_retailprice": 50.0}, n=2)
    edges = near.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    out = X.select_independent(p, edges, "p_partkey", ["p_retailprice"], stratum="p_type", quota=20, cluster="p_brand")
    return out.select("p_partkey", "p_type", "p_brand", "pos")


def equal_width_sample(spark, sf):
    return O.equal_width_sample(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "sample_pos")


def tertiles(spark, sf):
    t = O.tertiles(table(spark, sf, "customer"), ["c_mktsegment"], ["c_acctbal", "c_custkey"])
    return t.groupBy("c_mktsegment", "tertile").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.max("c_acctbal"), "top"))


def interleave_split(spark, sf):
    s = O.interleave_split(table(spark, sf, "customer"), "c_mktsegment", ["c_custkey"], [("train", 60), ("validation", 30), ("locked", 30)])
    return s.select("c_custkey", "c_mktsegment", "deal", "split")


def quota_head(spark, sf):
    return O.quota_head(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "pos")


def first_per(spark, sf):
    return O.first_per(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", r6("value", "value"))


def shuffle_within(spark, sf):
    s = scorers(spark, sf).withColumn("own", F.element_at("sa", F.col("native")))
    out = O.shuffle_within(s.select("label", "vec_id", "own"), ["label"], ["vec_id"], ["own"], mix_value(F.col("vec_id"), F.col("label"), 5))
    return out.select("label", "vec_id", r6("own", "own"), "moved")


def moved_fraction(spark, sf):
    s = scorers(spark, sf)
    parts = None
    for level in ("global", "entity", "wild_type"):
        by = C.condition_columns(level, "label", "native", [], [])
        m = C.shuffle_targets(s.select("vec_id", "label", "native", F.col("vec_id").alias("donor")), by, ["vec_id"], ["donor"], F.col("vec_id"), 2, 8)
        part = C.moved_fraction(m, ["repeat"]).withColumn("level", F.lit(level))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts)


def position_shuffle_control(spark, sf):
    s = scorers(spark, sf)
    mut = (F.col("vec_id") * 7 % 20 + 1).cast("int")
    variants = s.select("label", "vec_id", "native", mut.alias("mut"), (F.element_at("sb", mut) - F.element_at("sb", F.col("native"))).alias("seen")).where("mut <> native")
    return rounded(C.position_shuffle_control(variants, s, "label", "vec_id", "sa", wild="native", mut="mut", observed="seen", numeric=F.col("vec_id"), repeats=5, seed=13))


TYPES = ["click", "error", "purchase", "view", "signup"]


def _event_positions(spark, sf):
    e = O.ordinals(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], pos="p", total="n")
    return e.withColumn("position", F.col("p") - 1)


def rolling_composition(spark, sf):
    e = _event_positions(spark, sf).withColumns({"is_click": (F.col("event_type") == "click").cast("int"), "is_error": (F.col("event_type") == "error").cast("int")})
    out = O.rolling_mean(e.select("user_id", "event_id", "position", "is_click", "is_error"), ["user_id"], "position", ["is_click", "is_error"], 3)
    return rounded(out.select("user_id", "event_id", "is_click_mean", "is_error_mean"))


def context_features(spark, sf):
    t = table(spark, sf, "conversations").select(F.expr("conv_id * 100 + turn").alias("id"), "text", F.explode(F.expr("sequence(0, length(text) - 1)")).alias("pos"))
    out = Q.context_features(t, "text", "pos", 4, "aeiou")
    return out.groupBy("id").agg(*[r6(F.avg(F.element_at("local_composition", i + 1)), f"share_{v}") for i, v in enumerate("aeiou")],
                                 r6(F.avg("relative_position"), "relative_position"), r6(F.avg("edge_distance"), "edge_distance"), r6(F.max("log_length"), "log_length"))


QUERIES = {f.__name__: f for f in (
    quality_first_reason, quality_ledger, candidate_funnel, leakage_exact, leakage_eligibility, leakage_summary, train_bench_overlap,
    kmer_similarity, near_duplicates, matched_controls, caliper_edges, caliper_match, smd_before_matching, matched_effects, select_independent,
    equal_width_sample, tertiles, interleave_split, quota_head, first_per, shuffle_within, moved_fraction, position_shuffle_control,
    rolling_composition, context_features,
)}

r = S.rnd
_DOCS = "d AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_CASE = "CASE " + " ".join(f"WHEN NOT coalesce({e}, false) THEN '{n}'" for n, e in RULES)
_BENCH = """t AS (SELECT doc_id, text, lang, source, lang || source AS class_h FROM documents),
b AS (SELECT t.* FROM t JOIN labels USING (doc_id) WHERE toxic = 1),
rel AS (SELECT DISTINCT t.doc_id, b.doc_id::varchar AS bench_id, 'exact_sequence' AS reason, 1.0::double AS sequence_identity, 1.0::double AS query_coverage FROM t JOIN (SELECT text, min(doc_id) AS doc_id FROM b WHERE trim(text) <> '' GROUP BY text) b ON t.text = b.text
 UNION ALL SELECT doc_id, '*', 'same_class', NULL, NULL FROM t WHERE class_h IN (SELECT class_h FROM b)),
el AS (SELECT t.doc_id, rel.doc_id IS NULL AS eligible_for_training, coalesce(rs, '') AS reasons FROM t LEFT JOIN (SELECT doc_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS rs FROM rel GROUP BY doc_id) rel ON t.doc_id = rel.doc_id)"""
#: The same with every benchmark row of a text, not the least alone.
_EVERY = _BENCH.replace("(SELECT text, min(doc_id) AS doc_id FROM b WHERE trim(text) <> '' GROUP BY text)", "(SELECT text, doc_id FROM b WHERE trim(text) <> '')")


#: Letters beyond ASCII, for an edit distance that counts bytes.
_WIDE = "ÍéèêíçÇñÑÈÊÄäóÓüÖöÜÉßáúàâî"
_NARROW = "||".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)])


def _similar(q: str, t: str, k: int, f: float, band: int = 32) -> str:
    """CTEs ending in ``hit``; q and t are (id, text) tables."""

    def words(name: str, side: str) -> str:
        shifted = ", ".join(f"cs[{j}:]" for j in range(1, k + 1))
        cut = f"list_transform(list_zip({shifted})[:greatest(len(cs) - {k - 1}, 1)], lambda z: concat({', '.join(f'z[{j}]' for j in range(1, k + 1))}))"
        lists = f"SELECT id, {cut} AS ws FROM (SELECT id, string_split(text, '') AS cs FROM {name} WHERE length(text) > 0)"
        return f"SELECT id AS {side}, unnest(ws) AS word, unnest(range(0, len(ws))) AS {side}at FROM ({lists})"

    narrow = lambda e: f"translate({e}, '{_WIDE}', {_NARROW})"
    return f"""
qr AS ({words(q, "q")}), tr AS ({words(t, "t")}),
qw AS (SELECT *, row_number() OVER (PARTITION BY q, word ORDER BY qat) AS o FROM qr),
tw AS (SELECT *, row_number() OVER (PARTITION BY t, word ORDER BY tat) AS o FROM tr WHERE word IN (SELECT word FROM qr)),
nq AS (SELECT q, count(*) AS n FROM qw GROUP BY q),
h AS (SELECT q, t, qat, tat, tat - qat AS dg FROM qw JOIN tw USING (word, o)),
sh AS (SELECT q, t, shared_seeds, n FROM (SELECT q, t, count(*) AS shared_seeds FROM h GROUP BY ALL) JOIN nq USING (q) WHERE shared_seeds >= greatest(1, ceil(n * {f}::double - 1e-9))),
hh AS (SELECT h.* FROM h JOIN sh USING (q, t)),
dk AS (SELECT q, t, dg AS diagonal FROM (SELECT a.q, a.t, a.dg, count(*) AS k FROM (SELECT DISTINCT q, t, dg FROM hh) a JOIN hh b ON a.q = b.q AND a.t = b.t AND b.dg BETWEEN a.dg AND a.dg + {band} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY k DESC, dg) = 1),
ch AS (SELECT q, t, diagonal, qat, tat, coalesce(qat - lag(qat) OVER (PARTITION BY q, t ORDER BY qat) > {band}, false) AS jump FROM hh JOIN dk USING (q, t) WHERE dg BETWEEN diagonal AND diagonal + {band}),
st AS (SELECT *, sum(jump::int) OVER (PARTITION BY q, t ORDER BY qat) AS part FROM ch),
sp AS (SELECT q, t, diagonal, count(*) AS chained_seeds, min(qat) AS query_start, max(qat) AS last_q, min(tat) AS target_start, max(tat) AS last_t FROM st GROUP BY q, t, diagonal, part QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY count(*) DESC, part) = 1),
al AS (SELECT sp.*, shared_seeds, n AS n_seeds, a.text AS qt, b.text AS tt, last_q + least({k}, length(a.text)) AS query_end, last_t + least({k}, length(b.text)) AS target_end FROM sp JOIN sh USING (q, t) JOIN {q} a ON a.id = sp.q JOIN {t} b ON b.id = sp.t),
ed AS (SELECT *, levenshtein({narrow("substr(qt, query_start + 1, query_end - query_start)")}, {narrow("substr(tt, target_start + 1, target_end - target_start)")}) AS edits FROM al),
hit AS (SELECT q, t, shared_seeds, n_seeds, diagonal, chained_seeds, query_start, query_end, target_start, target_end, edits, 1 - edits / greatest(query_end - query_start, target_end - target_start) AS sequence_identity,
  (query_end - query_start) / length(qt) AS query_coverage, (target_end - target_start) / length(tt) AS target_coverage FROM ed)"""


_HIT = "shared_seeds, n_seeds, diagonal, chained_seeds, query_start, query_end, target_start, target_end, edits"
_SIM = ", ".join(r(c, c) for c in ("sequence_identity", "query_coverage", "target_coverage"))
_SIDES = """o AS (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::date)::double AS day FROM orders)"""

SQL = {
    "quality_first_reason": f"WITH {_DOCS} SELECT doc_id, {_CASE} ELSE 'kept' END AS reason FROM d",
    "quality_ledger": f"WITH {_DOCS}, f AS (" + " UNION ALL ".join(f"SELECT source, '{n}' AS reason FROM d WHERE NOT coalesce({e}, false)" for n, e in RULES) + ") SELECT source, reason, count(*) AS n_rows FROM f GROUP BY ALL",
    "candidate_funnel": f"""WITH {_DOCS}, c AS (SELECT doc_id, lang || source AS grp, n_chars, count(*) OVER (PARTITION BY lower(md5(text))) AS k FROM documents),
p AS (SELECT DISTINCT lang || source AS grp FROM d WHERE toxic = 1)
SELECT doc_id, grp, n_chars FROM c WHERE k = 1 AND n_chars >= 100 AND grp NOT IN (SELECT grp FROM p) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n_chars, doc_id) = 1""",
    "leakage_exact": f"WITH {_EVERY} SELECT * FROM rel",
    "leakage_eligibility": f"WITH {_BENCH} SELECT * FROM el",
    "leakage_summary": f"WITH {_EVERY} SELECT 'total' AS measure, count(*) AS n FROM el UNION ALL SELECT 'eligible', count(*) FILTER (eligible_for_training) FROM el UNION ALL SELECT 'excluded', count(*) FILTER (NOT eligible_for_training) FROM el UNION ALL SELECT 'relations_' || reason, count(*) FROM rel GROUP BY reason",
    "train_bench_overlap": """WITH t AS (SELECT lang || source AS class_h, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT class_h, bool_or(quality = 1) AS g, bool_or(quality = 0) AS b FROM t GROUP BY ALL)
SELECT class_h, CASE WHEN g AND b THEN 'both' WHEN g THEN 'left' ELSE 'right' END AS side FROM s""",
    "kmer_similarity": f"WITH bq AS (SELECT item_id AS id, text FROM benchmark), dt AS (SELECT doc_id AS id, text FROM documents), {_similar('bq', 'dt', 8, 0.3)} SELECT q AS item_id, t AS doc_id, {_HIT}, {_SIM} FROM hit",
    "near_duplicates": f"WITH bq AS (SELECT item_id AS id, text FROM benchmark), dt AS (SELECT doc_id AS id, text FROM documents), {_similar('bq', 'dt', 8, 0.3)} SELECT q AS item_id, t AS doc_id, {_HIT}, {_SIM} FROM hit WHERE sequence_identity >= 0.8 AND least(query_coverage, target_coverage) >= 0.05",
    "matched_controls": f"""WITH p AS (SELECT *, length(p_name) AS nl FROM part), c AS (SELECT a.p_partkey AS target_id, b.p_partkey AS source_id, abs(a.p_retailprice - b.p_retailprice) AS d1, abs(a.nl - b.nl) AS d2
 FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_type <> b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 200 AND abs(a.nl - b.nl) <= 3)
SELECT target_id, source_id, {r('d1', 'd_p_retailprice')}, d2 AS d_name_len, row_number() OVER (PARTITION BY target_id ORDER BY d1, d2, source_id) AS match_rank FROM c QUALIFY match_rank <= 3""",
    "caliper_edges": f"""WITH {_SIDES}, m AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(day) AS m2, stddev_pop(day) AS s2 FROM o WHERE o_orderstatus IN ('F', 'O')),
z AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, (o_totalprice - m1) / s1 AS a, (day - m2) / s2 AS b FROM o, m),
e AS (SELECT l.o_orderpriority, l.o_orderkey AS l, q.o_orderkey AS r, sqrt((l.a - q.a) * (l.a - q.a) + (l.b - q.b) * (l.b - q.b)) AS d FROM z l JOIN z q ON l.o_orderpriority = q.o_orderpriority AND l.o_orderstatus = 'F' AND q.o_orderstatus = 'O' AND abs(l.a - q.a) <= 0.05)
SELECT o_orderpriority, l, r, {r('d', 'distance')} FROM e WHERE d <= 0.05""",
    "caliper_match": f"""WITH RECURSIVE {_SIDES}, m AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(day) AS m2, stddev_pop(day) AS s2 FROM o WHERE o_orderstatus IN ('F', 'O')),
z AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, (o_totalprice - m1) / s1 AS a, (day - m2) / s2 AS b FROM o, m),
e AS (SELECT l.o_orderpriority, l.o_orderkey AS l, q.o_orderkey AS r, sqrt((l.a - q.a) * (l.a - q.a) + (l.b - q.b) * (l.b - q.b)) AS d FROM z l JOIN z q ON l.o_orderpriority = q.o_orderpriority AND l.o_orderstatus = 'F' AND q.o_orderstatus = 'O' AND abs(l.a - q.a) <= 0.05),
k AS (SELECT *, row_number() OVER (ORDER BY d, l, r) AS i FROM e WHERE d <= 0.05),
w AS (SELECT 0::bigint AS i, []::bigint[] AS ul, []::bigint[] AS ur, false AS ok UNION ALL
 SELECT k.i, CASE WHEN list_contains(ul, l) OR list_contains(ur, r) THEN ul ELSE list_append(ul, l) END, CASE WHEN list_contains(ul, l) OR list_contains(ur, r) THEN ur ELSE list_append(ur, r) END, NOT (list_contains(ul, l) OR list_contains(ur, r)) FROM w JOIN k ON k.i = w.i + 1)
SELECT o_orderpriority, l AS left_id, r AS right_id, {r('d', 'distance')} FROM k JOIN (SELECT i FROM w WHERE ok) USING (i)""",
    "smd_before_matching": f"""WITH {_SIDES}, l AS (SELECT o_orderpriority, o_orderstatus, 'o_totalprice' AS covariate, o_totalprice AS v FROM o UNION ALL SELECT o_orderpriority, o_orderstatus, 'day', day FROM o),
s AS (SELECT o_orderpriority, covariate, avg(v) FILTER (o_orderstatus = 'F') AS m1, avg(v) FILTER (o_orderstatus = 'O') AS m0, var_samp(v) FILTER (o_orderstatus = 'F') AS v1, var_samp(v) FILTER (o_orderstatus = 'O') AS v0 FROM l GROUP BY ALL)
SELECT o_orderpriority, covariate, {r('m1', 'mean_left')}, {r('m0', 'mean_right')}, {r('(m1 - m0) / sqrt((v1 + v0) / 2)', 'smd')}, abs((m1 - m0) / sqrt((v1 + v0) / 2)) <= 0.1 AS passed FROM s""",
    "equal_width_sample": """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, floor((k + 0.5::double) * n / 5)::bigint AS sample_pos FROM (SELECT DISTINCT user_id, n FROM o), range(0, 5) t(k)) SELECT o.user_id, event_id, o.sample_pos FROM o JOIN k USING (user_id, sample_pos)""",
    "tertiles": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, CASE WHEN p <= 1 + (n - 1) / 3 THEN 'low' WHEN p <= 1 + 2 * (n - 1) / 3 THEN 'middle' ELSE 'high' END AS tertile, count(*) AS n_rows, {r('max(c_acctbal)', 'top')} FROM o GROUP BY ALL""",
    "interleave_split": """WITH o AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS t FROM customer), d AS (SELECT *, row_number() OVER (ORDER BY t, c_mktsegment) AS deal FROM o)
SELECT c_custkey, c_mktsegment, deal, CASE WHEN deal <= 60 THEN 'train' WHEN deal <= 90 THEN 'validation' ELSE 'locked' END AS split FROM d WHERE deal <= 120""",
    "quota_head": "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer QUALIFY pos <= 3",
    "first_per": f"SELECT user_id, event_type, event_id, {r('value', 'value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "shuffle_within": f"""WITH {S.SCORERS}, o AS (SELECT label, vec_id, sa[native] AS own, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY label ORDER BY {S.mix('vec_id', 'label', 5)}, vec_id) AS j FROM s)
SELECT a.label, a.vec_id, {r('b.own', 'own')}, a.vec_id <> b.vec_id AS moved FROM o a JOIN o b ON a.label = b.label AND a.i = b.j""",
    "moved_fraction": "WITH " + ", ".join(
        f"""g{i} AS (SELECT rep, vec_id, row_number() OVER (PARTITION BY {by}rep ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY {by}rep ORDER BY {S.mix('vec_id', 'rep', 8)}, vec_id) AS j, {key} AS g FROM (SELECT vec_id, label, vec_id % 20 AS nat FROM embeddings), range(1, 3) t(rep)),
m{i} AS (SELECT '{name}' AS level, a.rep AS repeat, avg((a.vec_id <> b.vec_id)::int) AS f, count(*) AS n_rows FROM g{i} a JOIN g{i} b ON a.rep = b.rep AND a.g = b.g AND a.i = b.j GROUP BY ALL)"""
        for i, (name, by, key) in enumerate([("global", "", "0"), ("entity", "label, ", "label"), ("wild_type", "nat, ", "nat")])
    ) + f" SELECT level, repeat::int AS repeat, {r('f', 'moved_fraction')}, n_rows FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)",
    "position_shuffle_control": f"""WITH {S.SCORERS}, v AS (SELECT label, vec_id, native, (vec_id * 7 % 20 + 1)::int AS mut, sb[(vec_id * 7 % 20 + 1)::int] - sb[native] AS seen FROM s WHERE (vec_id * 7 % 20 + 1) <> native),
o AS (SELECT label, rep, vec_id, sa, row_number() OVER (PARTITION BY label, rep ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY label, rep ORDER BY {S.mix('vec_id', 'rep', 13)}, vec_id) AS j FROM s, range(1, 6) t(rep)),
x AS (SELECT a.label, a.rep, a.vec_id, b.sa FROM o a JOIN o b ON a.label = b.label AND a.rep = b.rep AND a.i = b.j UNION ALL SELECT label, 0, vec_id, sa FROM s),
w AS (SELECT x.label, rep, sa[mut] - sa[native] AS p, seen FROM x JOIN v USING (label, vec_id)),
k AS (SELECT label, rep, rank() OVER (PARTITION BY label, rep ORDER BY p) + (count(*) OVER (PARTITION BY label, rep, p) - 1) / 2 AS rx, rank() OVER (PARTITION BY label, rep ORDER BY seen) + (count(*) OVER (PARTITION BY label, rep, seen) - 1) / 2 AS ry FROM w),
c AS (SELECT label, rep, {S.corr('rx', 'ry')} AS rho FROM k GROUP BY ALL)
SELECT label, {r('max(rho) FILTER (rep = 0)', 'actual')}, {r('avg(rho) FILTER (rep > 0)', 'shuffled')}, count(rho) FILTER (rep > 0) AS n_repeats, {r('max(rho) FILTER (rep = 0) - avg(rho) FILTER (rep > 0)', 'gap')} FROM c GROUP BY label""",
    "rolling_composition": f"""SELECT user_id, event_id, {r("avg((event_type = 'click')::int) OVER w", 'is_click_mean')}, {r("avg((event_type = 'error')::int) OVER w", 'is_error_mean')} FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "context_features": f"""WITH t AS (SELECT conv_id * 100 + turn AS id, text, length(text) AS n, unnest(range(0, length(text))) AS p FROM conversations),
u AS (SELECT *, substr(text, greatest(p - 4, 0) + 1, least(p, 4)) || substr(text, p + 2, 4) AS near FROM t)
SELECT id, {', '.join(r(f"avg((length(near) - length(replace(near, '{v}', ''))) / greatest(length(near), 1))", f'share_{v}') for v in 'aeiou')},
 {r('avg(p / greatest(n - 1, 1))', 'relative_position')}, {r('avg(least(p, n - 1 - p))', 'edge_distance')}, {r('max(ln(n))', 'log_length')} FROM u GROUP BY id""",
}
