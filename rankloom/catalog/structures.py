"""Profiles, corrupted states and geometry over the conversation and vector tables."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from rankloom.catalog import sqlkit as S
from rankloom.catalog.data import long_scorers, r6, rounded, scorers, table
from rankloom.functions import classes as K
from rankloom.functions import sequences as Q
from rankloom.functions import vectors as V
from rankloom.operators import corruption as C
from rankloom.operators import geometry as G
from rankloom.operators import matching as X
from rankloom.operators import ordering as O
from rankloom.operators import profiles as P
from rankloom.operators import similarity as M
from rankloom.session import settle

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _turns(spark, sf):
    plain = F.regexp_replace(F.col("text"), "[^ -,.-~]", "?")
    return table(spark, sf, "conversations").select(F.expr("conv_id * 100 + turn").alias("id"), plain.alias("seq"))


def _alignments(spark, sf):
    """Each turn laid against the next one, the shorter padded with gaps."""
    t = _turns(spark, sf)
    nxt = t.select((F.col("id") - 1).alias("id"), F.col("seq").alias("other"))
    n = F.greatest(F.length("seq"), F.length("other"))
    return t.join(nxt, "id").select(
        F.col("id").alias("query"), (F.col("id") + 1).alias("target"), F.lit(1).alias("qstart"),
        F.rpad("seq", n, F.lit("-")).alias("qaln"), F.rpad("other", n, F.lit("-")).alias("taln"))


def conservation(spark, sf):
    return rounded(P.conservation(_alignments(spark, sf), _turns(spark, sf), "id", "seq", LETTERS))


def homolog_profile(spark, sf):
    out = P.homolog_profile(_turns(spark, sf), _alignments(spark, sf), "id", "seq", lo=0.03, hi=0.8, coverage=0.7, symbols=LETTERS)
    return out.select("query", "position", "observed", "accepted_hits", r6("profile_entropy", "profile_entropy"), "profile_covered",
                      r6(F.element_at("profile", 1), "profile_a"), r6(F.array_max("profile"), "profile_top"))


def alignment_stats(spark, sf):
    a = _alignments(spark, sf).join(_turns(spark, sf).withColumnRenamed("id", "query"), "query")
    s = a.withColumn("s", Q.align_stats("qaln", "taln", F.length("seq"), LETTERS))
    return s.select("query", r6("s.identity", "identity"), r6("s.query_coverage", "query_coverage"), r6(Q.hamming_identity("qaln", "taln"), "hamming"))


def corruption_bank(spark, sf):
    bank = C.build_bank(_turns(spark, sf), "id", "seq", F.col("id"), [0.05, 0.15], 1, 3, LETTERS.lower(), "#")
    out = C.describe_states(bank, mask="#")
    return out.select("id", "state_kind", r6("level", "level"), "replicate", "state_sequence", "mask_count", "edit_distance",
                      r6("edit_fraction", "edit_fraction"), r6("scaffold", "scaffold"),
                      F.array_join(F.transform("error_positions", lambda x: x.cast("string")), ",").alias("error_positions"))


def targeted_masks(spark, sf):
    t = _turns(spark, sf)
    vowels = F.transform(Q.letters("seq"), lambda c: c.isin("a", "e", "i", "o", "u"))
    out = t.withColumn("core", vowels).withColumn("state_sequence", C.mask_targeted("seq", F.col("id"), 0.3, F.col("core"), 9, "#"))
    kept = out.where("state_sequence IS NOT NULL").withColumnRenamed("seq", "reference_sequence")
    d = C.describe_states(kept, F.col("core"), "#").select("id", F.lit("made").alias("status"), "state_sequence", r6("core_fraction", "core_fraction"), r6("scaffold", "scaffold"))
    skipped = out.where("state_sequence IS NULL").select("id", F.lit("too_few_targets").alias("status"), "state_sequence", F.lit(None).cast("double").alias("core_fraction"), F.lit(None).cast("double").alias("scaffold"))
    return d.unionByName(skipped)


def _pair_matrix(spark, sf):
    """Letter-pair scores from adjacent letters of the benchmark texts."""
    b = table(spark, sf, "benchmark").select(F.explode(Q.shingles(F.lower("text"), 2)).alias("s")).select(
        F.substring("s.word", 1, 1).alias("wild"), F.substring("s.word", 2, 1).alias("mut"))
    ok = b.where(F.col("wild").rlike("^[a-z]$") & F.col("mut").rlike("^[a-z]$"))
    return ok.groupBy("wild", "mut").agg(F.log(F.count(F.lit(1)).cast("double")).alias("score"))


def matrix_substitution(spark, sf):
    out = C.substitute_matrix(_turns(spark, sf), "seq", F.col("id"), 0.2, _pair_matrix(spark, sf), 2.0, 21)
    d = C.describe_states(out.withColumnRenamed("seq", "reference_sequence"))
    return d.select("id", "edit_distance", "state_sequence")


def span_masks(spark, sf):
    t = _turns(spark, sf).withColumn("n", F.length("seq"))
    return C.span_positions(t, "id", "n", F.col("id"), 0.15, 4.0, 5)


def policy_substitution(spark, sf):
    s = scorers(spark, sf).withColumn("nat", F.substring(F.lit(K.SYMBOLS), F.col("native"), F.lit(1)))
    out = C.substitute_policy(s.select("label", "vec_id", "nat", "sa"), ["label"], "vec_id", "nat", "sa", F.col("label"), 0.3, 1.0, 4)
    return out.select("label", "vec_id", "nat", "current")


def state_scores(spark, sf):
    return rounded(C.describe_scores(long_scorers(spark, sf), ["scorer", "label"], "logp"))


def mutation_parse(spark, sf):
    """Letter changes written as text are read back and checked against the parent."""
    s = _turns(spark, sf).withColumn("seq", F.upper("seq"))
    pos = s.select("id", F.posexplode(Q.letters("seq")).alias("p", "letter"))
    made = pos.select("id", F.concat("letter", (F.col("p") + 1).cast("string"), F.when(F.col("p") % 2 == 0, "A").otherwise("G")).alias("mutation"),
                      (F.col("p") / 8).cast("string").alias("effect"))
    out = Q.parse_mutations(made, s, "id", "mutation", "effect", "seq")
    cls = K.substitution_class("wild_type", "mutant")
    return out.groupBy("id", cls.alias("substitution_class")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("effect"), "mean_effect"), F.max("position").alias("last_position"))


def unique_substring(spark, sf):
    """Where a benchmark passage starts in a document, if it occurs once."""
    return M.contained(table(spark, sf, "benchmark"), table(spark, sf, "documents"), qid="item_id", tid="doc_id", qseq="text", tseq="text")


def _points(spark, sf, start=1, prefix=""):
    e = V.as_double("embedding")
    p = table(spark, sf, "embeddings").select("label", "vec_id", *[F.element_at(e, start + i).alias(prefix + a) for i, a in enumerate("xyz")])
    o = O.ordinals(p, ["label"], ["vec_id"], pos="_p", total="_n")
    return o.withColumn("position", F.col("_p") - 1).drop("_p", "_n")


CUT = 0.25


def contact_edges(spark, sf):
    return G.contact_edges(_points(spark, sf), ["label"], "position", CUT, 3, digits=6)


def contact_degrees(spark, sf):
    return G.degrees_within(_points(spark, sf), ["label"], "position", CUT, 3)


def _with_ss(df):
    return df.withColumn("ss", F.when(F.col("vec_id") % 3 == 0, "helix").when(F.col("vec_id") % 3 == 1, "strand").otherwise("turn_or_coil"))


def structure_descriptors(spark, sf):
    p = settle(_with_ss(_points(spark, sf)))
    return rounded(G.structure_descriptors(p, None, ["label"], "position", "ss", G.contact_totals(p, ["label"], "position", CUT, 3)))


def _windows(spark, sf):
    p = settle(_with_ss(_points(spark, sf)))
    size = p.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("crop_length"))
    return p, size, G.window_descriptors(p, None, ["label"], "position", size, "ss", cutoff=CUT, sep=3)


def window_descriptors(spark, sf):
    return rounded(_windows(spark, sf)[2])


def match_windows(spark, sf):
    p, size, w = _windows(spark, sf)
    w = settle(w)
    names = ["radius_of_gyration", "helix_fraction", "strand_fraction", "mean_contact_order", "mean_contact_degree"]
    # The letter at a position follows from the label.
    spell = F.expr("array_join(transform(sequence(0, crop_length - 1), i -> cast((i * (label % 3 + 1) + label) % 7 AS string)), '')")
    sequences = size.select(F.col("label").alias("donor_id"), spell.alias("sequence"))
    full = w.withColumn("stratum", F.col("label") % 2)
    targets = full.join(size, ["label", "crop_length"]).withColumn("sequence", spell).select(F.col("label").alias("target_id"), "stratum", "sequence", *names)
    windows = full.select(F.col("label").alias("donor_id"), "crop_start", "crop_length", "stratum", *names)
    return rounded(X.match_windows(targets, windows, sequences, descriptors=names, scales={n: 0.1 for n in names}, n=2))


def edge_signatures(spark, sf):
    p = settle(_with_ss(_points(spark, sf)))
    out = G.signature_counts(p, ["label"], "position", p.groupBy("label").agg(F.count(F.lit(1)).alias("length")), "ss", CUT, 3)
    return rounded(out)


def sampled_edges(spark, sf):
    return G.sample_contacts(_points(spark, sf), ["label"], "position", CUT, 3, 0.25, [1, 2]).select("label", "seed", "source", "target")


def residue_maps(spark, sf):
    p = _points(spark, sf)
    n = p.groupBy("label").agg(F.count(F.lit(1)).alias("length"))
    c = G.circular_map(p.join(n, "label"), "label", "position", "length", F.col("label"), 0.25, 6)
    c = c.withColumn("source_length", F.col("length") + 3).withColumnRenamed("source_position", "circular")
    return G.length_map(c, "position", "length", "source_length").select("label", "position", "circular", F.col("source_position").alias("stretched"))


def mapped_rows(spark, sf):
    p = settle(_points(spark, sf))
    m = G.shuffled_map(p.select("label", "position"), ["label"], "position", C.mix_value(F.col("position"), F.col("label"), 31)).withColumn("source_id", F.col("label"))
    out = G.apply_map(m, p.drop("vec_id"), "label")
    return out.select("source_id", "position", "source_position", r6("x", "x"))


def residue_summary(spark, sf):
    p = _with_ss(_points(spark, sf)).withColumn("resolved", F.col("x") > -0.1)
    return rounded(G.residue_summary(p, ["label"], "resolved", "ss"))


def _pairs(spark, sf):
    a = _points(spark, sf, 1, "a")
    b = _points(spark, sf, 4, "b").drop("vec_id")
    return a.join(b, ["label", "position"])


def superpose(spark, sf):
    return rounded(G.superpose(_pairs(spark, sf), ["label"]).drop("rotation"))


def superposed_residuals(spark, sf):
    p = settle(_pairs(spark, sf))
    out = G.transform_back(p, G.superpose(p, ["label"]), ["label"])
    d2 = sum(((F.col("a" + a) - F.col("m" + a)) ** 2 for a in "xyz"), F.lit(0.0))
    return rounded(out.groupBy("label").agg(F.sqrt(F.avg(d2)).alias("rmsd"), F.count(F.lit(1)).alias("n")))


def local_geometry(spark, sf):
    p = settle(_pairs(spark, sf).select("label", "position", "ax", "ay", "az", *[(F.col("a" + a) + F.col("b" + a) * 0.3).alias("m" + a) for a in "xyz"]))
    return rounded(G.local_geometry(p, ["label"], "position", local=0.2, lddt=0.3, thresholds=(0.02, 0.04, 0.08, 0.16), contact=CUT, sep=3))


def _atoms(spark, sf, start):
    e = V.as_double("embedding")
    p = table(spark, sf, "embeddings").select("label", "vec_id", *[F.slice(e, start + 3 * i, 3).alias(a) for i, a in enumerate(("n", "ca", "c", "o"))])
    return O.ordinals(p, ["label"], ["vec_id"], pos="_p", total="_n").withColumn("position", F.col("_p") - 1).drop("_p", "_n")


def backbone_windows(spark, sf):
    return rounded(G.backbone_geometry(_atoms(spark, sf, 1), ["label"], "position", 0.3), 4)


def backbone_deltas(spark, sf):
    a = G.backbone_geometry(_atoms(spark, sf, 1), ["label"], "position", 0.3)
    b = G.backbone_geometry(_atoms(spark, sf, 13), ["label"], "position", 0.3)
    return rounded(G.backbone_deltas(b, a, ["label"], "position"), 4)


def frame_angles(spark, sf):
    a = _atoms(spark, sf, 1).select("vec_id", G.frame_axes(F.col("n"), F.col("ca"), F.col("c")).alias("fa"))
    b = _atoms(spark, sf, 13).select("vec_id", G.frame_axes(F.col("n"), F.col("ca"), F.col("c")).alias("fb"))
    return a.join(b, "vec_id").select("vec_id", r6(G.frame_angle(F.col("fa"), F.col("fb")), "frame_angle", 4))


def threshold_classes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        K.burial(F.col("l_discount") * 10).alias("burial"), K.conservation(F.col("l_tax") * 12).alias("conservation"),
        K.contact_class("l_linenumber", 5).alias("contact"), K.confidence("l_quantity").alias("confidence"), K.distance_bin("l_linenumber").alias("distance"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def name_classes(spark, sf):
    p = table(spark, sf, "part")
    cls = K.name_class("p_name", {"ring": "ring$", "widget": "widget$", "small": "^small"})
    return p.groupBy(cls.alias("family"), K.leading_token("p_brand", "#").alias("head")).agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (
    conservation, homolog_profile, alignment_stats, corruption_bank, targeted_masks, matrix_substitution, span_masks, policy_substitution,
    state_scores, mutation_parse, unique_substring, contact_edges, contact_degrees, structure_descriptors, window_descriptors, match_windows,
    edge_signatures, sampled_edges, residue_maps, mapped_rows, residue_summary, superpose, superposed_residuals, local_geometry,
    backbone_windows, backbone_deltas, frame_angles, threshold_classes, name_classes,
)}

r = S.rnd
_T = "tt AS (SELECT conv_id * 100 + turn AS id, regexp_replace(text, '[^ -,.-~]', '?', 'g') AS seq FROM conversations)"
_A = _T + """,
al AS (SELECT a.id AS query, b.id AS target, a.seq, rpad(a.seq, greatest(length(a.seq), length(b.seq))::int, '-') AS q, rpad(b.seq, greatest(length(a.seq), length(b.seq))::int, '-') AS t FROM tt a JOIN tt b ON b.id = a.id + 1),
gr AS (SELECT id AS query, i - 1 AS position, upper(substr(seq, i, 1)) AS native FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM tt)),
st AS (SELECT query, target, length(seq) AS n, unnest(range(1, length(q) + 1)) AS i, q, t FROM al),
cl AS (SELECT query, n, i - 1 AS position, upper(substr(q, i, 1)) AS qc, upper(substr(t, i, 1)) AS tc FROM st),
sm AS (SELECT query, count(*) FILTER (qc ~ '^[A-Z]$' AND tc ~ '^[A-Z]$' AND qc = tc) / greatest(count(*) FILTER (qc ~ '^[A-Z]$' AND tc ~ '^[A-Z]$'), 1) AS identity, count(*) FILTER (qc <> '-') / greatest(any_value(n), 1) AS cover, avg((qc = tc)::int) AS ham FROM cl GROUP BY query)"""
_CNT = "least({n}, greatest(1, round_even({n} * {f}::double, 0)::int))"


def _draws(n: str, key: str, seed: int) -> str:
    return f"list_transform(range(0, {n}), lambda i: {{'h': {S.mix(key, 'i', seed)}, 'i': i}})"


def _sub(c: str, pick: str) -> str:
    own = f"strpos('{LETTERS.lower()}', {c})"
    size = f"(CASE WHEN {own} > 0 THEN 25 ELSE 26 END)"
    k = f"(({pick}) % {size} + 1)"
    return f"substr('{LETTERS.lower()}', ({k} + CASE WHEN {own} > 0 AND {k} >= {own} THEN 1 ELSE 0 END)::bigint, 1)"


_P = "po AS (SELECT label, vec_id, embedding[{a}]::double AS {p}x, embedding[{b}]::double AS {p}y, embedding[{c}]::double AS {p}z, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position FROM embeddings)"
_PTS = _P.format(a=1, b=2, c=3, p="")
_SS = "CASE vec_id % 3 WHEN 0 THEN 'helix' WHEN 1 THEN 'strand' ELSE 'turn_or_coil' END"
_EDGES = _PTS + f""",
ed AS (SELECT a.label, a.position AS source, b.position AS target, a.vec_id AS va, b.vec_id AS vb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
 FROM po a JOIN po b ON a.label = b.label AND b.position - a.position >= 3 WHERE distance <= {CUT})"""
_DESC = """SELECT {k}, {cols}{gyr} FROM {src}"""


def _v(a: str, b: str) -> str:
    return f"list_transform(range(1, 4), lambda i: ({a})[i] - ({b})[i])"


def _nrm(v: str) -> str:
    return f"sqrt(list_inner_product({v}, {v}))"


def _cross(a: str, b: str) -> str:
    return f"[({a})[2] * ({b})[3] - ({a})[3] * ({b})[2], ({a})[3] * ({b})[1] - ({a})[1] * ({b})[3], ({a})[1] * ({b})[2] - ({a})[2] * ({b})[1]]"


def _bb(src: int, out: str) -> str:
    at = lambda k: f"embedding[{src + 3 * k}:{src + 3 * k + 2}]::double[]"
    return f"""
{out}1 AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position, {at(0)} AS n, {at(1)} AS ca, {at(2)} AS c, {at(3)} AS o FROM embeddings),
{out}2 AS (SELECT *, lead(n) OVER w IS NULL AS last, coalesce(lead(n) OVER w, ca) AS n2, coalesce(lead(ca) OVER w, o) AS ca2, {_v('n', 'ca')} AS u, {_v('c', 'ca')} AS v, {_v('o', 'ca')} AS w3 FROM {out}1 WINDOW w AS (PARTITION BY label ORDER BY position)),
{out}3 AS (SELECT *, {_v('ca', 'c')} AS b0, {_v('n2', 'c')} AS br, {_v('ca2', 'n2')} AS b2 FROM {out}2),
{out}4 AS (SELECT *, list_transform(br, lambda x: x / {_nrm('br')}) AS b1 FROM {out}3),
{out}5 AS (SELECT *, list_transform(range(1, 4), lambda i: b0[i] - list_inner_product(b0, b1) * b1[i]) AS rv, list_transform(range(1, 4), lambda i: b2[i] - list_inner_product(b2, b1) * b1[i]) AS rw FROM {out}4),
{out} AS (SELECT label, vec_id, position, {_nrm('u')} AS n_ca, {_nrm('v')} AS ca_c, {_nrm(_v('c', 'o'))} AS c_o,
 degrees(acos(least(greatest(list_inner_product(u, v) / ({_nrm('u')} * {_nrm('v')}), -1), 1))) AS n_ca_c_angle, CASE WHEN NOT last THEN {_nrm('br')} END AS peptide_cn,
 CASE WHEN NOT last THEN degrees(atan2(list_inner_product({_cross('b1', 'rv')}, rw), list_inner_product(rv, rw))) END AS omega, list_inner_product({_cross('u', 'v')}, w3) AS pseudochirality, CASE WHEN NOT last THEN {_nrm('br')} > 0.3 END AS chain_break FROM {out}5)"""


def _frame(src: int, out: str) -> str:
    at = lambda k: f"embedding[{src + 3 * k}:{src + 3 * k + 2}]::double[]"
    return f"""
{out}1 AS (SELECT vec_id, {_v(at(2), at(1))} AS x0, {_v(at(0), at(1))} AS w FROM embeddings),
{out}2 AS (SELECT vec_id, w, list_transform(x0, lambda q: q / {_nrm('x0')}) AS x FROM {out}1),
{out}3 AS (SELECT vec_id, x, list_transform(range(1, 4), lambda i: w[i] - list_inner_product(w, x) * x[i]) AS y0 FROM {out}2),
{out}4 AS (SELECT vec_id, x, list_transform(y0, lambda q: q / {_nrm('y0')}) AS y FROM {out}3),
{out} AS (SELECT vec_id, x, y, {_cross('x', 'y')} AS z FROM {out}4)"""


_POIS, _t, _acc = [], exp(-4.0), 0.0
for _k in range(64):
    _acc += _t
    _POIS.append(_acc)
    _t *= 4.0 / (_k + 1)
_POIS_SQL = "[" + ", ".join(f"{c!r}::double" for c in _POIS) + "]"
_NAMES = ("n_ca", "ca_c", "c_o", "n_ca_c_angle", "peptide_cn", "omega", "pseudochirality")
_WD = _EDGES + f""",
sz AS (SELECT label, count(*)::int AS n FROM po GROUP BY label), cr AS (SELECT sz.label, n, L.crop_length, unnest(range(0, n - L.crop_length + 1)) AS crop_start FROM sz JOIN (SELECT DISTINCT n AS crop_length FROM sz) L ON L.crop_length <= n),
ws AS (SELECT cr.label, crop_length, crop_start, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS radius_of_gyration, avg(({_SS} = 'helix')::int) AS helix_fraction, avg(({_SS} = 'strand')::int) AS strand_fraction
 FROM cr JOIN po ON po.label = cr.label AND position >= crop_start AND position < crop_start + crop_length GROUP BY ALL),
we AS (SELECT cr.label, crop_length, crop_start, avg(target - source) AS gap, count(*) AS k FROM cr JOIN ed ON ed.label = cr.label AND source >= crop_start AND target < crop_start + crop_length GROUP BY ALL)"""

SQL = {
    "conservation": f"""WITH {_A}, ag AS (SELECT query, position, count(*) AS k, count(*) FILTER (tc = qc) AS m FROM cl WHERE qc <> '-' AND tc ~ '^[A-Z]$' GROUP BY ALL)
SELECT gr.query, gr.position, native, coalesce(k, 0) AS homolog_observations, {r('coalesce(m / k, 0.5)', 'conservation_score')} FROM gr LEFT JOIN ag ON gr.query = ag.query AND gr.position = ag.position""",
    "homolog_profile": f"""WITH {_A}, ok AS (SELECT query FROM sm WHERE identity >= 0.03 AND identity < 0.8 AND cover >= 0.7),
ag AS (SELECT query, position, tc, count(*) AS k FROM cl SEMI JOIN ok USING (query) WHERE qc <> '-' AND tc ~ '^[A-Z]$' GROUP BY ALL),
al26 AS (SELECT chr(64 + i::int) AS s FROM range(1, 27) t(i)),
fr AS (SELECT gr.query, gr.position, s, coalesce(k, 0) AS k FROM gr CROSS JOIN al26 LEFT JOIN ag ON gr.query = ag.query AND gr.position = ag.position AND tc = s),
fq AS (SELECT *, (k + 0.5::double) / (sum(k) OVER (PARTITION BY query, position) + 13) AS p FROM fr)
SELECT query, position, sum(k)::bigint AS observed, (query IN (SELECT query FROM ok))::bigint AS accepted_hits, {r('-sum(p * ln(p))', 'profile_entropy')}, sum(k) > 0 AS profile_covered, {r("max(p) FILTER (s = 'A')", 'profile_a')}, {r('max(p)', 'profile_top')} FROM fq GROUP BY query, position""",
    "alignment_stats": f"WITH {_A} SELECT query, {r('identity', 'identity')}, {r('cover', 'query_coverage')}, {r('h', 'hamming')} FROM sm JOIN (SELECT query, avg((substr(q, i, 1) = substr(t, i, 1))::int) AS h FROM st GROUP BY query) USING (query)",
    "corruption_bank": f"""WITH {_T}, pl AS (SELECT * FROM (VALUES ('native', 0.0::double), ('random_mask', 0.05), ('random_mask', 0.15), ('random_substitution', 0.05), ('random_substitution', 0.15)) v(state_kind, level)),
a AS (SELECT id, seq, state_kind, level, length(seq) AS n, string_split(seq, '') AS ch, id * 97 + round_even(level * 1000, 0)::bigint * 7 AS kk FROM tt, pl),
b AS (SELECT *, {_draws('n', 'kk', 3)} AS dm, {_draws('n', 'kk', 13)} AS ds, least(n, greatest(1, round_even(n * level, 0)::int)) AS cnt FROM a),
c AS (SELECT *, list_sort(dm)[cnt] AS lm, list_sort(ds)[cnt] AS ls FROM b),
e AS (SELECT id, seq, state_kind, level, n, ch, CASE state_kind WHEN 'native' THEN ch WHEN 'random_mask' THEN list_transform(range(1, n + 1), lambda i: CASE WHEN dm[i] <= lm THEN '#' ELSE ch[i] END)
 ELSE list_transform(range(1, n + 1), lambda i: CASE WHEN ds[i] <= ls THEN {_sub('ch[i]', S.mix('kk', '(i - 1)', 14))} ELSE ch[i] END) END AS cs FROM c),
f AS (SELECT *, list_filter(range(0, n), lambda i: ch[i + 1] <> cs[i + 1]) AS er FROM e)
SELECT id, state_kind, level, 0 AS replicate, array_to_string(cs, '') AS state_sequence, len(list_filter(cs, lambda x: x = '#')) AS mask_count, len(er) AS edit_distance, {r('len(er) / n', 'edit_fraction')}, {r('exp(-3.0::double * len(er) / n)', 'scaffold')}, coalesce(array_to_string(er, ','), '') AS error_positions FROM f""",
    "targeted_masks": f"""WITH {_T}, a AS (SELECT id, seq, length(seq) AS n, string_split(seq, '') AS ch FROM tt), b AS (SELECT *, list_filter({_draws('n', 'id', 9)}, lambda d: ch[d.i + 1] IN ('a', 'e', 'i', 'o', 'u')) AS d, {_CNT.format(n='n', f='0.3')} AS cnt FROM a),
c AS (SELECT *, list_transform(list_sort(d)[1:cnt], lambda s: s.i) AS hit, len(d) >= cnt AS ok FROM b)
SELECT id, CASE WHEN ok THEN 'made' ELSE 'too_few_targets' END AS status, CASE WHEN ok THEN array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(hit, i - 1) THEN '#' ELSE ch[i] END), '') END AS state_sequence,
 {r('CASE WHEN ok THEN cnt / len(d) END', 'core_fraction')}, {r('CASE WHEN ok THEN exp(-3.0::double * cnt / n) * exp(-2.0::double * cnt / len(d)) END', 'scaffold')} FROM c""",
    "matrix_substitution": f"""WITH {_T}, bw AS (SELECT substr(lower(text), i, 1) AS wild, substr(lower(text), i + 1, 1) AS mut FROM (SELECT text, unnest(range(1, length(text))) AS i FROM benchmark)),
mx AS (SELECT wild, mut, exp(ln(count(*)) / 2) AS w FROM bw WHERE wild ~ '^[a-z]$' AND mut ~ '^[a-z]$' AND wild <> mut GROUP BY ALL),
cu AS (SELECT wild, mut, sum(w) OVER (PARTITION BY wild ORDER BY mut) / sum(w) OVER (PARTITION BY wild) AS upto, row_number() OVER (PARTITION BY wild ORDER BY mut DESC) AS back FROM mx),
ps AS (SELECT id, i - 1 AS p, substr(seq, i, 1) AS ch, n, {S.mix('id', '(i - 1)', 21)} AS h, {S.mix('id', '(i - 1)', 22)} / {S.PRIME}.0::double AS u FROM (SELECT id, seq, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS i FROM tt)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, p) <= {_CNT.format(n='n', f='0.2')} AS sel FROM ps),
pk AS (SELECT id, p, min(cu.mut) AS mut FROM rk JOIN cu ON cu.wild = ch AND (upto >= u OR back = 1) WHERE sel GROUP BY ALL),
nw AS (SELECT rk.id, rk.p, ch, coalesce(pk.mut, ch) AS c2 FROM rk LEFT JOIN pk ON rk.id = pk.id AND rk.p = pk.p)
SELECT id, count(*) FILTER (c2 <> ch)::int AS edit_distance, string_agg(c2, '' ORDER BY p) AS state_sequence FROM nw GROUP BY id""",
    "span_masks": f"""WITH {_T}, a AS (SELECT id, length(seq) AS n, {_CNT.format(n='length(seq)', f='0.15')} AS cnt FROM tt),
s AS (SELECT id, n, cnt, sk AS k, {S.mix('id', 'sk', 5)} % n AS st, greatest(1, len(list_filter({_POIS_SQL}, lambda c: c < {S.mix('id', 'sk', 6)} / {S.PRIME}.0::double))) AS w FROM (SELECT *, unnest(range(0, 2 * cnt + 1)) AS sk FROM a)),
h AS (SELECT id, cnt, k, unnest(range(st, least(n, st + w))) AS position FROM s UNION ALL SELECT id, cnt, 2 * cnt + 1, unnest(range(0, n)) FROM a),
f AS (SELECT id, cnt, position, min(k) AS k FROM h GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, position) AS rn FROM f),
l AS (SELECT id, k AS lk FROM o WHERE rn = cnt) SELECT o.id, position FROM o JOIN l USING (id) WHERE k <= lk QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY position) <= cnt""",
    "policy_substitution": f"""WITH {S.SCORERS}, a AS (SELECT label, vec_id, native, sa, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {S.mix('label', 'vec_id', 4)}, vec_id) AS p, {S.mix('label', 'vec_id', 5)} / {S.PRIME}.0::double AS u FROM s),
w AS (SELECT *, list_transform(range(1, 21), lambda i: CASE WHEN i = native THEN 0.0::double ELSE exp(sa[i]) END) AS v FROM a),
c AS (SELECT *, len(list_filter(range(1, 21), lambda i: list_sum(v[1:i]) < u * list_sum(v))) + 1 AS k FROM w)
SELECT label, vec_id, substr('{K.SYMBOLS}', native, 1) AS nat, substr('{K.SYMBOLS}', (CASE WHEN p <= {_CNT.format(n='n', f='0.3')} THEN k ELSE native END)::bigint, 1) AS current FROM c""",
    "state_scores": f"""WITH {S.LONG_SCORERS} SELECT scorer, label, {r('avg(-list_sum(list_transform(logp, lambda x: exp(x) * x)))', 'student_entropy')}, {r('avg(exp(list_reverse_sort(logp)[1]) - exp(list_reverse_sort(logp)[2]))', 'student_top1_gap')} FROM long GROUP BY ALL""",
    "mutation_parse": f"""WITH {_T}, p AS (SELECT id, i - 1 AS p, upper(substr(seq, i, 1)) AS w, CASE WHEN (i - 1) % 2 = 0 THEN 'A' ELSE 'G' END AS m FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM tt)),
g AS (SELECT * FROM p WHERE w ~ '^[A-Z]$' AND w <> m)
SELECT id, CASE WHEN w IN ('G', 'P') OR m IN ('G', 'P') THEN 'involves_glycine_or_proline' WHEN w IN ('A','V','I','L','M','F','W','Y') AND m = 'A' THEN 'within_hydrophobic' WHEN w IN ('A','V','I','L','M','F','W','Y') THEN 'hydrophobic_to_nonhydrophobic' ELSE 'nonhydrophobic_to_hydrophobic' END AS substitution_class,
 count(*) AS n, {r('avg(p / 8)', 'mean_effect')}, max(p)::int AS last_position FROM g GROUP BY ALL""",
    "unique_substring": "SELECT item_id, doc_id, CASE WHEN strpos(substr(d.text, strpos(d.text, b.text) + 1), b.text) = 0 THEN strpos(d.text, b.text) - 1 END AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "contact_edges": f"WITH {_EDGES} SELECT label, source, target, {r('distance', 'distance')} FROM ed",
    "contact_degrees": f"WITH {_EDGES} SELECT label, position, count(*) AS contact_degree FROM (SELECT label, source AS position FROM ed UNION ALL SELECT label, target FROM ed) GROUP BY ALL",
    "structure_descriptors": f"""WITH {_EDGES}, e AS (SELECT label, avg(target - source) AS gap, count(*) AS k FROM ed GROUP BY label)
SELECT label, count(*) AS length, {r('sqrt(var_pop(x) + var_pop(y) + var_pop(z))', 'radius_of_gyration')}, {r(f"avg(({_SS} = 'helix')::int)", 'helix_fraction')}, {r(f"avg(({_SS} = 'strand')::int)", 'strand_fraction')},
 {r('coalesce(any_value(gap) / count(*), 0)', 'mean_contact_order')}, {r('coalesce(2 * any_value(k) / count(*), 0)', 'mean_contact_degree')} FROM po LEFT JOIN e USING (label) GROUP BY label""",
    "window_descriptors": f"""WITH {_WD} SELECT ws.label, ws.crop_length, ws.crop_start, {r('radius_of_gyration', 'radius_of_gyration')}, {r('helix_fraction', 'helix_fraction')}, {r('strand_fraction', 'strand_fraction')},
 {r('coalesce(gap / ws.crop_length, 0)', 'mean_contact_order')}, {r('coalesce(2 * k / ws.crop_length, 0)', 'mean_contact_degree')} FROM ws LEFT JOIN we ON ws.label = we.label AND ws.crop_length = we.crop_length AND ws.crop_start = we.crop_start""",
    "match_windows": f"""WITH {_WD}, sq AS (SELECT label, n AS whole_n FROM sz),
fu AS (SELECT ws.*, coalesce(gap / ws.crop_length, 0) AS co, coalesce(2 * k / ws.crop_length, 0) AS cd, array_to_string(list_transform(range(ws.crop_start::bigint, (ws.crop_start + ws.crop_length)::bigint), lambda i: ((i * (ws.label % 3 + 1) + ws.label) % 7)::varchar), '') AS sequence, ws.label % 2 AS stratum, whole_n AS n FROM ws LEFT JOIN we ON ws.label = we.label AND ws.crop_length = we.crop_length AND ws.crop_start = we.crop_start JOIN sq ON sq.label = ws.label),
pa AS (SELECT t.label AS target_id, w.label AS donor_id, w.crop_start, len(list_filter(range(1, t.crop_length + 1), lambda i: substr(t.sequence, i, 1) = substr(w.sequence, i, 1))) / t.crop_length AS si,
 sqrt(((w.radius_of_gyration - t.radius_of_gyration) / 0.1) ^ 2 + ((w.helix_fraction - t.helix_fraction) / 0.1) ^ 2 + ((w.strand_fraction - t.strand_fraction) / 0.1) ^ 2 + ((w.co - t.co) / 0.1) ^ 2 + ((w.cd - t.cd) / 0.1) ^ 2) AS dd, CASE WHEN t.stratum = w.stratum THEN 0.0::double ELSE 0.25 END AS pen
 FROM fu t JOIN fu w ON t.n = t.crop_length AND w.crop_length = t.crop_length AND w.label <> t.label),
pb AS (SELECT *, dd + pen AS objective, count(*) FILTER (si < 0.3) OVER (PARTITION BY target_id) >= 2 AS enough FROM pa),
pc AS (SELECT * FROM pb WHERE NOT enough OR si < 0.3 QUALIFY row_number() OVER (PARTITION BY target_id, donor_id ORDER BY objective, si, crop_start) = 1)
SELECT target_id, donor_id, crop_start, {r('si', 'sequence_identity')}, {r('dd', 'descriptor_distance')}, {r('objective', 'objective')}, row_number() OVER (PARTITION BY target_id ORDER BY objective, si, donor_id) AS match_rank FROM pc QUALIFY match_rank <= 2""",
    "edge_signatures": f"""WITH {_EDGES}, n AS (SELECT label, count(*) AS length FROM po GROUP BY label), c AS (SELECT ed.label, distance, target - source AS g, length, {_SS.replace('vec_id', 'va')} AS ca, {_SS.replace('vec_id', 'vb')} AS cb FROM ed JOIN n USING (label))
SELECT label, CASE WHEN g <= 5 THEN '3_to_5' WHEN g <= 11 THEN '6_to_11' WHEN g <= 23 THEN '12_to_23' ELSE '24_plus' END AS separation, least(ca, cb) || '__' || greatest(ca, cb) AS classes, CASE WHEN g / length <= 0.1::double THEN 'local' WHEN g / length <= 0.25 THEN 'mesoscale' ELSE 'long_range' END AS contact_order,
 count(*) AS n_edges, {r('avg(distance)', 'mean_distance')} FROM c GROUP BY ALL""",
    "sampled_edges": f"""WITH {_EDGES}, o AS (SELECT label, seed::int AS seed, source, target, row_number() OVER (PARTITION BY label, seed ORDER BY {S.mix('(source * 100003 + target)', 'seed', 17)}, source, target) AS p, count(*) OVER (PARTITION BY label, seed) AS n FROM ed, range(1, 3) t(seed))
SELECT label, seed, source, target FROM o WHERE p > round_even(n * 0.25::double, 0)""",
    "residue_maps": f"""WITH {_PTS}, n AS (SELECT label, count(*) AS n, greatest(1, ceil(count(*) * 0.25::double))::bigint AS l FROM po GROUP BY label), s AS (SELECT label, n, CASE WHEN n - 2 * l + 1 > 0 THEN l + {S.mix('label', '0', 6)} % greatest(n - 2 * l + 1, 1) ELSE 1 + {S.mix('label', '0', 6)} % greatest(n - 1, 1) END AS sh FROM n)
SELECT label, position, ((position - sh) % n + n) % n AS circular, round_even(position * ((n + 2) / (n - 1)), 0)::int AS stretched FROM po JOIN s USING (label)""",
    "mapped_rows": f"""WITH {_PTS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.mix('position', 'label', 31)}, position) - 1 AS j FROM po)
SELECT a.label AS source_id, a.position, b.position AS source_position, {r('b.x', 'x')} FROM o a JOIN o b ON a.label = b.label AND a.position = b.j""",
    "residue_summary": f"""WITH {_PTS} SELECT label, count(*) FILTER (NOT x > -0.1::double) AS missing_count, {r('avg((NOT x > -0.1::double)::int)', 'missing_fraction')}, {r(f"coalesce(avg(({_SS} = 'helix')::int) FILTER (x > -0.1::double), 0)", 'helix_fraction')}, {r(f"coalesce(avg(({_SS} = 'strand')::int) FILTER (x > -0.1::double), 0)", 'strand_fraction')} FROM po GROUP BY label""",
    "local_geometry": f"""WITH pr AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, embedding[1]::double + embedding[4]::double * 0.3::double AS mx, embedding[2]::double + embedding[5]::double * 0.3::double AS my, embedding[3]::double + embedding[6]::double * 0.3::double AS mz FROM embeddings),
pp AS (SELECT a.label, a.position, b.position AS q, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS d, sqrt((a.mx - b.mx) ^ 2 + (a.my - b.my) ^ 2 + (a.mz - b.mz) ^ 2) AS m, (b.x - b.mx) ^ 2 + (b.y - b.my) ^ 2 + (b.z - b.mz) ^ 2 AS e2, sqrt((a.x - a.mx) ^ 2 + (a.y - a.my) ^ 2 + (a.z - a.mz) ^ 2) AS disp FROM pr a JOIN pr b ON a.label = b.label)
SELECT label, position, {r('sqrt(avg(e2) FILTER (d <= 0.2::double))', 'local_rmsd')}, {r('avg(((abs(m - d) < 0.02)::int + (abs(m - d) < 0.04)::int + (abs(m - d) < 0.08)::int + (abs(m - d) < 0.16)::int) / 4) FILTER (d > 0 AND d <= 0.3::double)', 'lddt')},
 {r(f'avg((m <= {CUT})::int) FILTER (d <= {CUT} AND abs(position - q) >= 3)', 'contact_retention')}, {r('any_value(disp)', 'displacement')}, count(*) FILTER (d <= 0.2::double) AS local_count FROM pp GROUP BY label, position""",
    "backbone_windows": f"WITH {_bb(1, 'g')} SELECT label, position, {', '.join(r(n, n, 4) for n in _NAMES)}, chain_break FROM g",
    "backbone_deltas": f"""WITH {_bb(1, 'g')}, {_bb(13, 'h')}
SELECT h.label, {r('avg((abs(h.n_ca - g.n_ca) + abs(h.ca_c - g.ca_c) + abs(h.c_o - g.c_o)) / 3)', 'bond_mae', 4)}, {r('avg(abs(h.n_ca_c_angle - g.n_ca_c_angle))', 'angle_mae', 4)}, {r('avg(h.peptide_cn)', 'peptide_mean', 4)}, {r('max(h.peptide_cn)', 'peptide_max', 4)},
 {r('avg(abs(h.peptide_cn - g.peptide_cn))', 'peptide_mae', 4)}, {r('avg(h.chain_break::int)', 'chain_break_fraction', 4)}, {r('avg(abs(CASE WHEN abs(h.omega - g.omega) > 180 THEN 360 - abs(h.omega - g.omega) ELSE abs(h.omega - g.omega) END))', 'omega_mae', 4)},
 {r('avg((sign(h.pseudochirality) <> sign(g.pseudochirality))::int)', 'chirality_flip_fraction', 4)} FROM h JOIN g USING (label, position) GROUP BY h.label""",
    "frame_angles": f"WITH {_frame(1, 'a')}, {_frame(13, 'b')} SELECT vec_id, {r('degrees(acos(least(greatest((list_inner_product(a.x, b.x) + list_inner_product(a.y, b.y) + list_inner_product(a.z, b.z) - 1) / 2, -1), 1)))', 'frame_angle', 4)} FROM a JOIN b USING (vec_id)",
    "threshold_classes": """SELECT CASE WHEN l_discount * 10 <= 0.2::double THEN 'buried' WHEN l_discount * 10 >= 0.5::double THEN 'exposed' ELSE 'intermediate' END AS burial, CASE WHEN l_tax * 12 >= 0.8::double THEN 'conserved' WHEN l_tax * 12 <= 0.3::double THEN 'variable' ELSE 'intermediate' END AS conservation,
 CASE WHEN l_linenumber >= 5 THEN 'high_contact' ELSE 'low_contact' END AS contact, CASE WHEN l_quantity < 70 THEN 'low' WHEN l_quantity >= 90 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN l_linenumber < 6 THEN 'under_6' WHEN l_linenumber < 7 THEN '6_to_7' WHEN l_linenumber <= 8 THEN '7_to_8' ELSE 'noncontact' END AS distance, count(*) AS n_rows FROM lineitem GROUP BY ALL""",
    "name_classes": """SELECT CASE WHEN p_name ~ 'ring$' THEN 'ring' WHEN p_name ~ 'widget$' THEN 'widget' WHEN p_name ~ '^small' THEN 'small' ELSE 'unsupported' END AS family, split_part(p_brand, '#', 1) AS head, count(*) AS n_rows FROM part GROUP BY ALL""",
}
