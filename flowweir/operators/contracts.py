"""Row-level contracts: every violated rule is named, valid rows pass on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import as_column, is_finite, number_or_null
from flowweir.schema import FEATURES, NON_NEGATIVE_LIVE


def feature_violations(live: bool = True) -> Column:
    """Broken feature rules of a row as an array of ``feature:reason``.

    The first reason per feature counts: not_numeric, then not_finite, then
    (live only) negative; live rows also need at least one packet.
    """
    rules = []
    for f in FEATURES:
        value = number_or_null(F.col(f))
        reason = F.when(value.isNull(), "not_numeric").when(~is_finite(value), "not_finite")
        if live and f in NON_NEGATIVE_LIVE:
            reason = reason.when(value < 0, "negative")
        rules.append((reason.isNotNull(), F.concat(F.lit(f"{f}:"), reason)))
    checks = [F.when(broken, text) for broken, text in rules]
    if live:
        packets = number_or_null(F.col("total_fwd_packets")) + number_or_null(
            F.col("total_bwd_packets")
        )
        checks.append(F.when(packets < 1, F.lit("packet_count:below_one")))
    return F.filter(F.array(*checks), lambda text: text.isNotNull())


def with_feature_violations(df: DataFrame, live: bool = True) -> DataFrame:
    """Add ``violations``; boolean feature columns are refused outright."""
    booleans = sorted(c for c, t in df.dtypes if c in FEATURES and t == "boolean")
    if booleans:
        raise TypeError(f"features must be numeric, not boolean: {booleans}")
    return df.withColumn("violations", feature_violations(live))


def valid_and_quarantined(df: DataFrame, live: bool = True):
    """Rows that satisfy the contract, and the others with their reasons."""
    checked = with_feature_violations(df, live)
    clean = F.size("violations") == 0
    return checked.filter(clean).drop("violations"), checked.filter(~clean)


def score_violation(probabilities="probabilities", prediction="prediction") -> Column:
    """First broken rule of a flow score, null for a valid one."""
    p, y = as_column(probabilities), as_column(prediction)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(p.isNull() | y.isNull(), "missing")
        .when(F.size(p) != 2, "shape")
        .when(~F.forall(p, lambda x: F.coalesce(is_finite(x), F.lit(False))), "not_finite")
        .when(F.exists(p, lambda x: (x < 0.0) | (x > 1.0)), "out_of_range")
        # Relative 1e-5 and absolute 1e-8 tolerance around 1.
        .when(F.abs(total - 1.0) > 1e-8 + 1e-5, "sum")
        .when(y != F.floor(y), "prediction_not_integer")
        .when(~y.isin(0, 1), "prediction_range")
    )


def capture_violation(packet_count="packet_count", duration="capture_duration") -> Column:
    """First broken rule of a capture record, null for a valid one."""
    n, d = number_or_null(packet_count), number_or_null(duration)
    return (
        F.when(n.isNull() | ~is_finite(n) | (n != F.floor(n)), "packet_count_not_integer")
        .when(d.isNull(), "duration_not_numeric")
        .when(n < 0, "packet_count_negative")
        .when(~is_finite(d) | (d < 0), "duration_invalid")
    )


def label_window_violation() -> Column:
    return F.when(~F.col("label").isin(0, 1) | F.col("label").isNull(), "label").when(
        F.col("end_epoch") < F.col("start_epoch"), "order"
    )


def label_window_rows(windows: DataFrame) -> DataFrame:
    """Valid label windows, epochs rounded to milliseconds."""
    return windows.filter(label_window_violation().isNull()).select(
        "scenario",
        F.col("label").cast("int").alias("label"),
        F.round("start_epoch", 3).alias("start_epoch"),
        F.round("end_epoch", 3).alias("end_epoch"),
        "pcap",
    )


ALLOWED_LABELS = ["benign", "attack"]


def _clean_label() -> Column:
    return F.coalesce(F.trim("label"), F.lit(""))


def invalid_labels(df: DataFrame) -> DataFrame:
    """Labels outside the allowed set with their row counts."""
    label = _clean_label()
    bad = df.select(label.alias("label")).filter(~F.col("label").isin("", *ALLOWED_LABELS))
    return bad.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def label_file_check(df: DataFrame, order: str = "flow_id") -> DataFrame:
    """One row: size, unlabelled rows, invalid labels, PASS or FAIL.

    Rows are merged per label first, so a file with one label everywhere is as
    cheap as any other. ``invalid_labels`` lists the labels counted here.
    """
    by_label = (
        df.select(_clean_label().alias("label"), order)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"))
    )
    empty = F.col("label") == ""
    invalid = ~empty & ~F.col("label").isin(ALLOWED_LABELS)
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    report = by_label.agg(
        of(F.lit(True)).alias("rows"),
        of(F.col("label") == "benign").alias("benign"),
        of(F.col("label") == "attack").alias("attack"),
        of(empty).alias("unlabelled"),
        F.min(F.when(empty, F.col("first"))).alias("first_unlabelled"),
        F.count_if(invalid).alias("invalid_labels"),
        F.min(F.when(invalid, F.col("label"))).alias("first_invalid"),
    )
    problems = (F.col("rows") == 0) | (F.col("unlabelled") > 0) | (F.col("invalid_labels") > 0)
    return report.withColumn("status", F.when(problems, "FAIL").otherwise("PASS"))
