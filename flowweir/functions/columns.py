"""Scalar rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowweir.schema import FEATURES

# Families the error analysis looks at, and the one left out.
WEAK_PATTERNS = ["Web Attack", "Bot", "PortScan"]
WEAK_EXCLUDED = ("Web Attack", "Sql Injection")
BENIGN_WORDS = ["benign", "normal", "0"]


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_null(text) -> Column:
    """Numeric value of a text column, null when it does not parse."""
    return as_column(text).try_cast("double")


def is_finite(c) -> Column:
    """True for numbers other than NaN and the infinities, null for null.

    NaN sorts above every number in Spark, so one comparison covers both.
    """
    return F.abs(as_column(c)) < F.lit(float("inf"))


def finite_or_null(c) -> Column:
    return F.when(is_finite(c), as_column(c))


def safe_number(c) -> Column:
    """Number, or 0.0 when it is missing, unparseable or not finite."""
    return F.coalesce(finite_or_null(number_or_null(c)), F.lit(0.0))


def floor_div(c, width: int) -> Column:
    """Exact integer division rounding down, also below zero."""
    c = as_column(c)
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))


def safe_divide(numerator, denominator) -> Column:
    """Ratio as double; 0.0 unless the denominator is positive."""
    n, d = as_column(numerator), as_column(denominator)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def divide_or_null(numerator, denominator) -> Column:
    n, d = as_column(numerator), as_column(denominator)
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def rounded_ratio(numerator, denominator) -> Column:
    n, d = as_column(numerator), as_column(denominator)
    return F.when(d != 0, F.round(n.cast("double") / d.cast("double"), 4)).otherwise(F.lit(0.0))


def trimmed(c) -> Column:
    """Trimmed text; a missing label is an ordinary (non-benign) word."""
    return F.coalesce(F.trim(as_column(c)), F.lit("nan"))


def label_not_benign(c) -> Column:
    """Training rule: anything but BENIGN, any case, is an attack."""
    return (F.upper(trimmed(c)) != "BENIGN").cast("tinyint")


def label_evaluation(c) -> Column:
    """Evaluation rule: benign / normal / 0 in any case are benign."""
    return F.when(F.lower(trimmed(c)).isin(BENIGN_WORDS), 0).otherwise(1)


def label_exact(c) -> Column:
    """Case-sensitive rule."""
    return F.when(trimmed(c) == "BENIGN", 0).otherwise(1)


def label_display(c) -> Column:
    """Attack name with its placeholder separator shown as a dash."""
    return F.regexp_replace(trimmed(c), r" \? ", " - ")


def severity(prediction, confidence) -> Column:
    p, c = as_column(prediction), as_column(confidence)
    attack = F.when(c >= 0.80, "HIGH").when(c >= 0.50, "MEDIUM").otherwise("SUSPICIOUS")
    return F.when(p == 1, attack).when(c < 0.75, "SUSPICIOUS").otherwise("LOW")


def error_type(label, prediction) -> Column:
    y, p = as_column(label), as_column(prediction)
    return (
        F.when((y == 0) & (p == 1), "FALSE_POSITIVE")
        .when((y == 1) & (p == 0), "FALSE_NEGATIVE")
        .otherwise("CORRECT")
    )


def error_type_strict(label, prediction) -> Column:
    """As ``error_type``, with pairs outside {0,1} reported as UNKNOWN."""
    y, p = as_column(label), as_column(prediction)
    known = y.isin(0, 1) & p.isin(0, 1)
    return F.when(known, error_type(y, p)).otherwise("UNKNOWN")


def is_weak_family(source_label) -> Column:
    c = as_column(source_label)
    family, excluded = WEAK_EXCLUDED
    tests = [
        c.contains(p) & ~c.contains(excluded) if p == family else c.contains(p)
        for p in WEAK_PATTERNS
    ]
    return reduce(lambda a, b: a | b, tests)


def shift_verdict(statistic) -> Column:
    c = as_column(statistic)
    return F.when(c < 0.2, "small").when(c < 0.5, "moderate").otherwise("large")


def sample_class(count) -> Column:
    c = as_column(count)
    return (
        F.when(c < 30, "INSUFFICIENT")
        .when(c < 100, "LIMITED_SAMPLE")
        .otherwise("ADEQUATE_FOR_DESCRIPTIVE_COMPARISON")
    )


def unpivot_features(df, ids, features=FEATURES, value="value"):
    """One row per (input row, feature)."""
    typed = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.unpivot(ids, features, "feature", value)
