import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import aggregates as A

RNG = np.random.default_rng(3)
LEFT, RIGHT = RNG.normal(size=(5, 6)), RNG.normal(size=(5, 6)).round(1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, LEFT[i].tolist(), RIGHT[i].tolist(), i % 6 + 1) for i in range(5)], "id int, l array<double>, r array<double>, idx int")


def value(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


def logp(x):
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_log_normalize(rows):
    assert np.allclose(value(rows, V.log_normalize("l")), logp(LEFT))


def test_jsd_symmetric_and_zero(rows):
    a, b = V.log_normalize("l"), V.log_normalize("r")
    p, q = np.exp(logp(LEFT)), np.exp(logp(RIGHT))
    m = (p + q) / 2
    want = 0.5 * ((p * np.log(p / m)).sum(1) + (q * np.log(q / m)).sum(1))
    assert np.allclose(value(rows, V.jsd(a, b)), want)
    assert np.allclose(value(rows, V.jsd(b, a)), want)
    assert np.allclose(value(rows, V.jsd(a, a)), 0)


def test_spearman_with_ties(rows):
    want = [np.corrcoef(ranks(a), ranks(b))[0, 1] for a, b in zip(LEFT, RIGHT)]
    assert np.allclose(value(rows, V.vec_spearman("l", "r")), want)


def test_cosine_null_on_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 2.0])], "id int, l array<double>, r array<double>")
    assert value(df, V.cosine("l", "r")) == [None]


def test_topk_overlap_case(spark):
    df = spark.createDataFrame([(0, [0.5, 9.0, 7.5, -1.0, 8.0], [6.0, 2.5, 7.0, 6.5, 1.0])], "id int, l array<double>, r array<double>")
    assert value(df, V.topk_overlap("l", "r", 3)) == [pytest.approx(1 / 3)]


def test_centre_and_ilr_inverse(rows):
    c = V.centre("l")
    assert np.allclose(value(rows, V.vsum(c)), 0)
    assert np.allclose(value(rows, V.inverse_ilr(V.ilr(c, 6), 6)), LEFT - LEFT.mean(1, keepdims=True))


def test_anchor_off_index_and_rank(rows):
    want = [LEFT[i] - LEFT[i][i % 6] for i in range(5)]
    assert np.allclose(value(rows, V.anchor("l", "idx")), want)
    assert np.allclose(value(rows, V.off_index("l", "idx")), [np.delete(LEFT[i], i % 6) for i in range(5)])
    assert value(rows, V.entry_rank("l", "idx")) == [1 + int((LEFT[i] > LEFT[i][i % 6]).sum()) for i in range(5)]


def test_rank_normal_sums_to_zero(rows):
    assert np.allclose(value(rows, V.vsum(V.rank_normal("l", 6))), 0)


def test_temperature_consensus(spark):
    df = spark.createDataFrame([(0, "a", [1.5, -3.0], 0.5), (0, "b", [9.0, -18.0], 3.0), (0, "c", [4.5, -9.0], 1.5)], "id int, s string, v array<double>, t double")
    out = A.consensus(df, ["id"], "v", "temperature", "t", n=2).first()
    assert out["v"] == [3.0, -6.0]


def test_native_metrics_case(spark):
    df = spark.createDataFrame([(0, [math.log(0.75), math.log(0.25)], 1), (1, [math.log(0.75), math.log(0.25)], 1)], "id int, logp array<double>, idx int")
    m = A.native_metrics(df, [], "logp", "idx").first()
    assert math.isclose(m["nll"], -math.log(0.75)) and m["top1_recovery"] == 1 and m["mean_reciprocal_rank"] == 1


def test_cost_is_linear_in_length(spark):
    """A long vector through a chain of expressions stays quick."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda x: (x % 97).cast("double")).alias("v"))
    z = df.select(V.logsumexp(V.log_normalize(V.centre("v"))).alias("z")).first()["z"]
    assert abs(z) < 1e-9
