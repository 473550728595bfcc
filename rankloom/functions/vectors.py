"""Expressions over ``array<double>`` score vectors.

Every function takes and returns Spark columns, so a chain of them stays one
projection. Vector indexes are 1-based, as in ``element_at``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, which aggregates skip."""
    c = _col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Lambda bodies are evaluated per entry, with everything they mention; binding
    a value first keeps a vector expression linear in its length.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def as_double(vec: Column | str) -> Column:
    return _col(vec).cast("array<double>")


def vsum(vec: Column | str) -> Column:
    return F.aggregate(_col(vec), F.lit(0.0), lambda a, x: a + x)


def vsumsq(vec: Column | str) -> Column:
    return F.aggregate(_col(vec), F.lit(0.0), lambda a, x: a + x * x)


def dot(l: Column | str, r: Column | str) -> Column:
    return vsum(F.zip_with(_col(l), _col(r), lambda a, b: a * b))


def scale(vec: Column | str, k: Column | float) -> Column:
    if isinstance(k, Column):
        return let(k, lambda f: F.transform(_col(vec), lambda x: x * f))
    return F.transform(_col(vec), lambda x: x * k)


def add(l: Column | str, r: Column | str) -> Column:
    return F.zip_with(_col(l), _col(r), lambda a, b: a + b)


def subtract(l: Column | str, r: Column | str) -> Column:
    return F.zip_with(_col(l), _col(r), lambda a, b: a - b)


def vmean(vec: Column | str) -> Column:
    return let(vec, lambda v: vsum(v) / F.size(v))


def logsumexp(vec: Column | str) -> Column:
    def shifted(v: Column, top: Column) -> Column:
        return top + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))

    return let(vec, lambda v: let(F.array_max(v), lambda top: shifted(v, top)))


def log_normalize(vec: Column | str) -> Column:
    return let(vec, lambda v: let(logsumexp(v), lambda z: F.transform(v, lambda x: x - z)))


def clip(vec: Column | str, bound: float) -> Column:
    return F.transform(
        _col(vec), lambda x: F.least(F.greatest(x, F.lit(-float(bound))), F.lit(float(bound)))
    )


def canonical_scores(vec: Column | str, clip_at: float = 20.0, temperature: float = 1.0) -> Column:
    """Clip raw scores, divide by the temperature and normalise."""
    return log_normalize(scale(clip(vec, clip_at), 1.0 / temperature))


def temper(vec: Column | str, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return log_normalize(scale(vec, F.lit(1.0) / t))


def softmax(vec: Column | str) -> Column:
    return F.transform(log_normalize(vec), lambda x: F.exp(x))


def entropy(logp: Column | str) -> Column:
    return F.aggregate(_col(logp), F.lit(0.0), lambda a, x: a - F.exp(x) * x)


def cross_entropy(p_log: Column | str, q_log: Column | str) -> Column:
    return -vsum(F.zip_with(_col(p_log), _col(q_log), lambda a, b: F.exp(a) * b))


def max_probability(logp: Column | str) -> Column:
    return F.exp(F.array_max(_col(logp)))


def top_mass(logp: Column | str, k: int = 3) -> Column:
    top = F.slice(F.sort_array(_col(logp), asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + F.exp(x))


def extreme_fraction(vec: Column | str, limit: float) -> Column:
    return let(vec, lambda v: F.size(F.filter(v, lambda x: F.abs(x) > limit)) / F.size(v))


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(vsumsq(vec))


def l2_distance(l: Column | str, r: Column | str) -> Column:
    return l2_norm(subtract(l, r))


def jsd(l: Column | str, r: Column | str) -> Column:
    """Jensen-Shannon divergence in nats of two log distributions."""

    def term(a: Column, b: Column) -> Column:
        hi, lo = F.greatest(a, b), F.least(a, b)
        mid = hi + F.log1p(F.exp(lo - hi)) - math.log(2.0)
        return let(mid, lambda m: F.exp(a) * (a - m) + F.exp(b) * (b - m))

    return vsum(F.zip_with(_col(l), _col(r), term)) * 0.5


def cosine(l: Column | str, r: Column | str) -> Column:
    def ratio(a: Column, b: Column) -> Column:
        return let(F.sqrt(vsumsq(a)) * F.sqrt(vsumsq(b)), lambda n: F.when(n > 0, dot(a, b) / n))

    return let(l, lambda a: let(r, lambda b: ratio(a, b)))


def average_rank(vec: Column | str) -> Column:
    """Rank of every entry, ties sharing the mean rank."""

    def rank(v: Column, x: Column) -> Column:
        return F.aggregate(
            v,
            F.lit(0.5),
            lambda a, y: a + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0),
        )

    return let(vec, lambda v: F.transform(v, lambda x: rank(v, x)))


def centre(vec: Column | str) -> Column:
    """Remove the mean, so the entries sum to zero (centred log-ratio)."""
    return let(vec, lambda v: let(vsum(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))


clr = centre


def vec_pearson(l: Column | str, r: Column | str) -> Column:
    return cosine(centre(l), centre(r))


def vec_spearman(l: Column | str, r: Column | str) -> Column:
    """Row-wise rank correlation; NULL when a side is constant."""
    return vec_pearson(average_rank(l), average_rank(r))


def anchor(vec: Column | str, idx: Column | str) -> Column:
    """Subtract the entry at ``idx`` from every entry."""
    at = _col(idx).cast("int")
    return let(vec, lambda v: let(F.element_at(v, at), lambda b: F.transform(v, lambda x: x - b)))


def off_index(vec: Column | str, idx: Column | str) -> Column:
    """All entries except the one at ``idx``."""
    return let(_col(idx).cast("int") - 1, lambda at: F.filter(_col(vec), lambda _, i: i != at))


def residual(scorer: Column | str, base: Column | str) -> Column:
    return centre(subtract(scorer, base))


def helmert(n: int) -> list[list[float]]:
    """Orthonormal contrasts: row k compares the first k entries with the next."""
    rows = []
    for k in range(1, n):
        c = 1.0 / math.sqrt(k * (k + 1))
        rows.append([c] * k + [-k * c] + [0.0] * (n - k - 1))
    return rows


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def apply_matrix(rows: Sequence[Sequence[float]], vec: Column | str) -> Column:
    return let(vec, lambda v: F.transform(matrix(rows), lambda row: dot(row, v)))


def ilr(vec: Column | str, n: int) -> Column:
    return apply_matrix(helmert(n), vec)


def inverse_ilr(coords: Column | str, n: int) -> Column:
    return apply_matrix([list(c) for c in zip(*helmert(n))], coords)


def top_indexes(vec: Column | str, k: int) -> Column:
    """1-based indexes of the k largest entries; ties go to the lower index."""
    pairs = F.transform(_col(vec), lambda x, i: F.struct((-x).alias("v"), (i + 1).alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def topk_overlap(l: Column | str, r: Column | str, k: int) -> Column:
    return F.size(F.array_intersect(top_indexes(l, k), top_indexes(r, k))) / F.lit(float(k))


def entry_rank(vec: Column | str, idx: Column | str) -> Column:
    """1 + number of strictly larger entries than the one at ``idx``."""
    at = _col(idx).cast("int")
    return let(vec, lambda v: let(F.element_at(v, at), lambda e: F.size(F.filter(v, lambda x: x > e)) + 1))


def argmax(vec: Column | str) -> Column:
    return let(vec, lambda v: F.array_position(v, F.array_max(v)).cast("int"))


def top_gap(vec: Column | str) -> Column:
    return let(F.sort_array(_col(vec), asc=False), lambda s: F.element_at(s, 1) - F.element_at(s, 2))


def median(vec: Column | str) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.get(s, lo) + F.get(s, hi)) / 2

    return let(F.array_sort(_col(vec)), middle)


def rank_normal(vec: Column | str, n: int) -> Column:
    """Normal scores of the ranks; equal entries keep their index order."""
    quantile = F.array(*[F.lit(NormalDist().inv_cdf((r + 0.5) / n)) for r in range(n)])

    def score(v: Column, x: Column, i: Column) -> Column:
        below = F.size(F.filter(v, lambda y, j: (y < x) | ((y == x) & (j < i))))
        return F.element_at(quantile, below + 1)

    return let(vec, lambda v: F.transform(v, lambda x, i: score(v, x, i)))


def rms(vec: Column | str) -> Column:
    return let(vec, lambda v: F.sqrt(vsumsq(v) / F.size(v)))


def action_shift(l: Column | str, r: Column | str, idx: Column | str) -> Column:
    """How far two anchored vectors lie apart away from the anchor (a struct)."""

    def measures(a: Column, b: Column, d: Column) -> Column:
        return F.struct(
            rms(d).alias("shift_rmse"),
            vmean(F.transform(d, lambda x: F.abs(x))).alias("shift_mae"),
            vec_spearman(a, b).alias("shift_rank"),
        )

    return let(
        off_index(l, idx),
        lambda a: let(off_index(r, idx), lambda b: let(subtract(a, b), lambda d: measures(a, b, d))),
    )


def agreement(vecs: Sequence[Column | str]) -> Column:
    """Median over scorer pairs of the row-wise rank correlation."""
    ranks = F.array(*[centre(average_rank(v)) for v in vecs])
    n = len(vecs)

    def pairs(r: Column) -> Column:
        at = [F.get(r, F.lit(i)) for i in range(n)]
        return F.array(*[cosine(at[i], at[j]) for i in range(n) for j in range(i + 1, n)])

    return median(F.array_compact(let(ranks, pairs)))


def same_sign(values: Sequence[Column]) -> Column:
    """All values positive, or all negative."""
    return (F.least(*values) > 0) | (F.greatest(*values) < 0)


def probe_metrics(base: Column | str, target: Column | str, predicted: Column | str, k: int = 3) -> Column:
    """How much of the way from ``base`` to ``target`` a predicted residual goes.

    ``base`` and ``target`` are log distributions, ``predicted`` is a residual.
    Gives a struct.
    """

    def measures(b: Column, t: Column, p: Column, moved: Column, truth: Column) -> Column:
        before, after = jsd(b, t), jsd(moved, t)
        return F.struct(
            before.alias("baseline_jsd"),
            after.alias("predicted_jsd"),
            (before - after).alias("jsd_reduction"),
            (cross_entropy(t, b) - cross_entropy(t, moved)).alias("cross_entropy_reduction"),
            cosine(p, truth).alias("residual_cosine"),
            vec_spearman(p, truth).alias("residual_rank"),
            topk_overlap(p, truth, k).alias("topk_overlap"),
        )

    def derived(b: Column, t: Column, p: Column) -> Column:
        return let(
            log_normalize(add(b, p)),
            lambda moved: let(residual(t, b), lambda truth: measures(b, t, p, moved, truth)),
        )

    return let(base, lambda b: let(target, lambda t: let(predicted, lambda p: derived(b, t, p))))
