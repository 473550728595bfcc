"""Threshold, set and name classes as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from rankloom.functions.vectors import _col, finite

# Cut points and symbol sets.
BURIED_MAX, EXPOSED_MIN = 0.20, 0.50
HIGH_CONTACT = 8
CONSERVED_MIN, VARIABLE_MAX = 0.80, 0.30
CONFIDENCE_LOW, CONFIDENCE_HIGH = 70.0, 90.0
HELIX_CODES = ("H", "G", "I")
STRAND_CODES = ("E", "B")
POSITIVE = ("K", "R")
NEGATIVE = ("D", "E")
HYDROPHOBIC = ("A", "V", "I", "L", "M", "F", "W", "Y")
BREAKERS = ("G", "P")
SYMBOLS = "ACDEFGHIKLMNPQRSTVWY"
MASK = "X"


def classify(c: Column | str, cuts: Sequence[tuple[str, float, str]], default: str, missing: str = "missing") -> Column:
    """First matching (operator, threshold, label); NaN and NULL are ``missing``."""
    v = finite(c)
    out = F.when(v.isNull(), missing)
    for op, at, label in cuts:
        test = {"<": v < at, "<=": v <= at, ">": v > at, ">=": v >= at}[op]
        out = out.when(test, label)
    return out.otherwise(default)


def burial(c: Column | str) -> Column:
    return classify(c, [("<=", BURIED_MAX, "buried"), (">=", EXPOSED_MIN, "exposed")], "intermediate")


def conservation(c: Column | str) -> Column:
    return classify(c, [(">=", CONSERVED_MIN, "conserved"), ("<=", VARIABLE_MAX, "variable")], "intermediate")


def contact_class(c: Column | str, high: int = HIGH_CONTACT) -> Column:
    return classify(c, [(">=", high, "high_contact")], "low_contact")


def confidence(c: Column | str) -> Column:
    return classify(c, [("<", CONFIDENCE_LOW, "low"), (">=", CONFIDENCE_HIGH, "high")], "medium")


def distance_bin(c: Column | str) -> Column:
    return classify(c, [("<", 6.0, "under_6"), ("<", 7.0, "6_to_7"), ("<=", 8.0, "7_to_8")], "noncontact", "noncontact")


def secondary_structure(code: Column | str) -> Column:
    c = _col(code)
    return F.when(c.isin(*HELIX_CODES), "helix").when(c.isin(*STRAND_CODES), "strand").otherwise("turn_or_coil")


def edge_signature(left: Column, right: Column, length: Column, left_class: Column, right_class: Column) -> Column:
    """Separation bin, sorted endpoint classes and contact-order bin of an edge."""
    gap = F.abs(left - right)
    return F.struct(
        F.when(gap <= 5, "3_to_5").when(gap <= 11, "6_to_11").when(gap <= 23, "12_to_23").otherwise("24_plus").alias("separation"),
        F.array_join(F.array_sort(F.array(left_class, right_class)), "__").alias("classes"),
        F.when(gap / length <= 0.10, "local").when(gap / length <= 0.25, "mesoscale").otherwise("long_range").alias("contact_order"),
    )


def glycine_proline(wild: Column | str, mut: Column | str) -> Column:
    return _col(wild).isin(*BREAKERS) | _col(mut).isin(*BREAKERS)


def substitution_class(wild: Column | str, mut: Column | str) -> Column:
    w, m = _col(wild), _col(mut)
    w_greasy, m_greasy = w.isin(*HYDROPHOBIC), m.isin(*HYDROPHOBIC)
    reversal = (w.isin(*POSITIVE) & m.isin(*NEGATIVE)) | (w.isin(*NEGATIVE) & m.isin(*POSITIVE))
    return (
        F.when(glycine_proline(w, m), "involves_glycine_or_proline")
        .when(reversal, "charge_reversal")
        .when(w_greasy & m_greasy, "within_hydrophobic")
        .when(w_greasy, "hydrophobic_to_nonhydrophobic")
        .when(m_greasy, "nonhydrophobic_to_hydrophobic")
        .otherwise("other_polar_or_charged")
    )


def name_class(c: Column | str, patterns: Mapping[str, str], default: str = "unsupported") -> Column:
    """Label of the first regular expression that matches."""
    v, out = _col(c), None
    for label, pattern in patterns.items():
        out = F.when(v.rlike(pattern), label) if out is None else out.when(v.rlike(pattern), label)
    return out.otherwise(default)


def leading_token(c: Column | str, separators: str = "|_:") -> Column:
    """Text before the first separator."""
    return F.regexp_extract(_col(c), "^([^" + separators + "]*)", 1)
