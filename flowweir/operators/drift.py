"""Distribution summaries and two-sample drift per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import sample_class, shift_verdict, unpivot_features
from flowweir.functions.ordered import _join_null_safe, cumulative, exact_quantiles
from flowweir.schema import FEATURES

SUMMARY_QUANTILES = {"q00": 0.0, "q50": 0.5, "q95": 0.95, "q99": 0.99, "q100": 1.0}


def distribution_summary(df: DataFrame, by=()) -> DataFrame:
    """Per feature: count, mean, population deviation, share of zeros, quantiles."""
    group = [*by, "feature"]
    long = unpivot_features(df, list(by)).filter(F.col("value").isNotNull())
    value = F.col("value")
    # Merged on the map side: one row per group and task moves.
    moments = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (F.count_if(value == 0.0) / F.count(F.lit(1))).alias("zero_fraction"),
    )
    quantiles = exact_quantiles(long, group, "value", SUMMARY_QUANTILES).drop("n")
    return _join_null_safe(moments, quantiles, group)


def distribution_comparison(train: DataFrame, live: DataFrame) -> DataFrame:
    """Medians, 95 % quantiles and zero shares of two samples side by side."""
    both = train.select(*FEATURES, F.lit("train").alias("sample")).unionByName(
        live.select(*FEATURES, F.lit("live").alias("sample"))
    )
    summary = distribution_summary(both, ["sample"])

    def of(sample, column):
        return F.max(F.when(F.col("sample") == sample, F.col(column)))

    return summary.groupBy("feature").agg(
        of("train", "q50").alias("train_median"),
        of("live", "q50").alias("live_median"),
        of("train", "q95").alias("train_p95"),
        of("live", "q95").alias("live_p95"),
        of("train", "zero_fraction").alias("train_zero_fraction"),
        of("live", "zero_fraction").alias("live_zero_fraction"),
    )


# Samples of at most this size each get the exact p-value.
EXACT_SIZE = 200


def exact_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Exact two-sided p-value of a two-sample statistic.

    All orders of the two samples are equally likely, and each is a lattice path from
    (0, 0) to (n, m). The share of paths through (i, j) that have stayed inside
    |i/n - j/m| < D follows from its two neighbours: i/(i+j) of that at (i-1, j) plus j/(i+j)
    of that at (i, j-1). Rows are folded one by one, each as an array over j.
    """
    n, m = n.cast("long"), m.cast("long")
    # D is a multiple of 1/(nm).
    reach = F.round(statistic * n * m).cast("long")

    def share(i, j, above, before):
        inside = F.abs(i * m - j * n) < reach
        total = (i + j).cast("double")
        value = F.when(total == 0, 1.0).otherwise(
            (F.coalesce(above, F.lit(0.0)) * i + F.coalesce(before, F.lit(0.0)) * j)
            / F.nullif(total, F.lit(0.0))
        )
        return F.when(inside, value).otherwise(0.0)

    def row(above, i):
        return F.aggregate(
            F.sequence(F.lit(0).cast("long"), m),
            F.array().cast("array<double>"),
            lambda done, j: F.array_append(
                done, share(i, j, F.get(above, j.cast("int")), F.get(done, j.cast("int") - 1))
            ),
        )

    last = F.aggregate(
        F.sequence(F.lit(0).cast("long"), n), F.array().cast("array<double>"), row
    )
    p = 1.0 - F.element_at(last, -1)
    return F.when(reach <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def two_sample_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Exact when neither sample has more than ``EXACT_SIZE`` values, else asymptotic."""
    small = F.greatest(n, m) <= EXACT_SIZE
    # Both sides are guarded: the fold must not run over large samples.
    exact = exact_p_value(
        statistic, F.when(small, n).otherwise(F.lit(0)), F.when(small, m).otherwise(F.lit(0))
    )
    return F.when(small, exact).otherwise(kolmogorov_p_value(statistic, n, m))


def kolmogorov_p_value(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a two-sample statistic.

    Kolmogorov series 2 * sum((-1)^(k-1) exp(-2 k^2 z^2)) with
    z = D sqrt(nm / (n+m)). Near zero the alternating series does not settle, and
    the value there is 1 to many digits. Exact small-sample tables differ.
    """
    z = statistic * F.sqrt(n.cast("double") * m.cast("double") / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z),
    )
    return F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def feature_drift(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Means, standardised difference, KS statistic, p-value and verdict per feature.

    Both samples are merged to counts per distinct value, then compared through
    running totals over range blocks: no feature is ever one task's work.
    """
    both = reference.select(*FEATURES, F.lit(True).alias("is_reference")).unionByName(
        live.select(*FEATURES, F.lit(False).alias("is_reference"))
    )
    long = unpivot_features(both, ["is_reference"])
    ref, new = F.col("is_reference"), ~F.col("is_reference")
    running = cumulative(
        long, ["feature"], "value", {"a": F.count_if(ref), "b": F.count_if(new)}
    )
    value = F.col("value")
    sums = running.groupBy("feature").agg(
        *[
            e.alias(f"_{name}_{part}")
            for name in ("a", "b")
            for part, e in (
                ("mean", F.sum(value * F.col(name)) / F.max(f"{name}_all")),
                ("rows", F.max(f"{name}_all")),
            )
        ]
    )
    # Twenty rows, one per feature.
    apart = running.join(F.broadcast(sums), "feature")
    moments = apart.groupBy("feature").agg(
        F.max("_a_mean").alias("reference_mean"),
        F.max("_b_mean").alias("live_mean"),
        *[
            (
                F.sum(F.col(name) * (value - F.col(f"_{name}_mean")) ** 2)
                / F.max(F.nullif(F.col(f"_{name}_rows") - 1, F.lit(0)))
            ).alias(alias)
            for name, alias in (("a", "_ref_var"), ("b", "_live_var"))
        ],
    )
    distance = F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))
    ks = running.groupBy("feature").agg(
        F.max(distance).alias("ks"), F.max("a_all").alias("n"), F.max("b_all").alias("m")
    )
    pooled = F.sqrt((F.col("_ref_var") + F.col("_live_var")) / 2.0)
    scale = F.when(pooled.isNull() | (pooled == 0), 1.0).otherwise(pooled)
    return (
        moments.join(ks, "feature")
        .select(
            "feature",
            "reference_mean",
            "live_mean",
            F.round(F.abs(F.col("reference_mean") - F.col("live_mean")) / scale, 3).alias(
                "standardised_difference"
            ),
            F.round("ks", 3).alias("ks_statistic"),
            two_sample_p_value(F.col("ks"), F.col("n"), F.col("m")).alias("ks_p_value"),
            shift_verdict("ks").alias("verdict"),
        )
        .orderBy(F.desc("ks_statistic"), "feature")
    )


def drift_verdict_lists(drift: DataFrame) -> DataFrame:
    """Features per verdict as comma-separated text (at most twenty names)."""
    return drift.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("features"),
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("names"),
    )


def sample_size_class(flows: DataFrame, by=()) -> DataFrame:
    counted = flows.groupBy(*by).agg(F.count(F.lit(1)).alias("flows"))
    return counted.withColumn("sample_class", sample_class("flows"))


def require_sample(flows: DataFrame) -> str:
    """Class of the sample; too small a sample stops the comparison."""
    row = sample_size_class(flows).first()
    if row["sample_class"] == "INSUFFICIENT":
        raise ValueError(f"insufficient flows for a comparison: {row['flows']}")
    return row["sample_class"]
