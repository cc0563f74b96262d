"""Error analysis of a scored, labelled flow table.

Input columns: the features, ``binary_label``, ``prediction``, ``source_label``,
``source_file``, ``attack_probability`` and a unique ``row_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowweir.functions.columns import (
    divide_or_null,
    error_type,
    is_weak_family,
    unpivot_features,
)
from flowweir.functions.ordered import exact_quantiles, order_bucket, rank_cuts
from flowweir.schema import FEATURES

# The features cut into quartile slices.
SLICE_FEATURES = [
    "flow_duration",
    "flow_packets",
    "flow_bytes",
    "packet_rate",
    "active_time",
    "idle_time",
]


def with_error_type(scored: DataFrame) -> DataFrame:
    return scored.withColumn("error_type", error_type("binary_label", "prediction"))


_ENDS = {"Q1": 0.25, "Q2": 0.5, "Q3": 0.75}


def _slice_ends(df: DataFrame, order: str, features) -> DataFrame:
    """Per feature the last row of Q1, Q2 and Q3, each as (``at``, ``last``)."""
    long = unpivot_features(df.select(order, *features), [order], features)
    end = F.struct(F.col("value").alias("at"), "last")
    return (
        rank_cuts(
            long.filter(F.col("value").isNotNull()),
            ["feature"],
            "value",
            order,
            order_bucket(df, order),
            _ENDS,
        )
        .groupBy("feature")
        .agg(*[F.max(F.when(F.col("cut") == q, end)).alias(q) for q in _ENDS])
    )


def _slice(value: Column, key: Column, ends: str) -> Column:
    """Slice of a row; ``ends`` holds its feature's last rows of slices."""

    def within(q):
        at, last = F.col(f"{ends}.{q}.at"), F.col(f"{ends}.{q}.last")
        tie = last.isNull() | F.coalesce(key <= last, key.isNull())
        return (value < at) | ((value == at) & tie)

    return (
        F.when(within("Q1"), "Q1")
        .when(within("Q2"), "Q2")
        .when(within("Q3"), "Q3")
        .when(value.isNotNull(), "Q4")
    )


def quartile_slices(df: DataFrame, order: str, features=SLICE_FEATURES) -> DataFrame:
    """(row, feature) pairs with their quartile Q1..Q4.

    Ranks break ties by ``order`` and are cut at 1 + (n-1)q, so the slices are
    not those of ``ntile``. The last row of each slice is looked up and all rows are
    compared with it in place: none gets a rank of its own.
    """
    ids = [c for c in df.columns if c not in FEATURES]
    long = unpivot_features(df, ids, features).filter(F.col("value").isNotNull())
    ends = _slice_ends(df, order, features).select("feature", F.struct(*_ENDS).alias("_ends"))
    # One row per feature: a fixed number of rows.
    joined = long.join(F.broadcast(ends), "feature")
    return joined.withColumn("slice", _slice(F.col("value"), F.col(order), "_ends")).drop("_ends")


def error_slices(scored: DataFrame, order="row_key", features=SLICE_FEATURES) -> DataFrame:
    """Per feature and quartile: rows, attacks, errors, benign FPR, attack recall."""
    narrow = scored.select(order, "binary_label", "prediction", *features)
    ends = _slice_ends(narrow, order, features)
    # One row. Rows are counted by their slices of all features before these are listed.
    row = ends.agg(
        *[F.max(F.when(F.col("feature") == f, F.struct(*_ENDS))).alias(f"_{f}") for f in features]
    )
    sliced = narrow.crossJoin(F.broadcast(row)).select(
        F.col("binary_label").alias("y"),
        F.col("prediction").alias("p"),
        *[_slice(F.col(f).cast("double"), F.col(order), f"_{f}").alias(f) for f in features],
    )
    counted = sliced.groupBy("y", "p", *features).count()
    y, p = F.col("y"), F.col("p")
    of = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0))
    grouped = (
        counted.unpivot(["y", "p", "count"], features, "feature", "slice")
        .filter(F.col("slice").isNotNull())
        .groupBy("feature", "slice")
        .agg(
            F.sum("count").alias("rows"),
            of(y == 1).alias("attacks"),
            of((y == 0) & (p == 1)).alias("false_positives"),
            of((y == 1) & (p == 0)).alias("false_negatives"),
            of(y == 0).alias("benign"),
        )
    )
    return grouped.select(
        "feature",
        "slice",
        "rows",
        "attacks",
        "false_positives",
        "false_negatives",
        divide_or_null("false_positives", "benign").alias("benign_fpr"),
        divide_or_null(F.col("attacks") - F.col("false_negatives"), "attacks").alias(
            "attack_recall"
        ),
    )


def errors_by_source(scored: DataFrame) -> DataFrame:
    """Error counts by type, by (type, label) and by (type, file), in one pass."""
    errors = with_error_type(scored).filter(F.col("error_type") != "CORRECT")
    # Merge to the finest grain first; the three views are sums over that.
    fine = errors.groupBy("error_type", "source_label", "source_file").count()
    sets = fine.groupingSets(
        [["error_type"], ["error_type", "source_label"], ["error_type", "source_file"]],
        "error_type",
        "source_label",
        "source_file",
    ).agg(F.sum("count").alias("errors"), F.grouping_id().alias("_set"))
    view = F.when(F.col("_set") == 3, "type").when(F.col("_set") == 1, "label").otherwise("file")
    return sets.select(
        view.alias("view"), "error_type", "source_label", "source_file", "errors"
    ).orderBy("view", "error_type", F.desc("errors"))


def recall_by_attack(scored: DataFrame) -> DataFrame:
    attacks = scored.filter(F.col("binary_label") == 1)
    return (
        attacks.groupBy("source_label")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("prediction") == 0).alias("false_negatives"),
        )
        .withColumn("recall", 1.0 - F.col("false_negatives") / F.col("rows"))
        .orderBy("recall", F.desc("rows"))
    )


def weak_rows(scored: DataFrame) -> DataFrame:
    """Rows of the weak families with their error type."""
    return with_error_type(scored.filter(is_weak_family("source_label")))


def weak_families(scored: DataFrame) -> DataFrame:
    return (
        weak_rows(scored)
        .groupBy("source_label", "error_type")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("source_label", "error_type")
    )


def family_feature_contrast(scored: DataFrame, top: int = 10) -> DataFrame:
    """Missed against detected rows of a family: feature medians, largest contrast first.

    Families without both groups are left out. Medians come from running value
    counts, so a family of any size is never gathered.
    """
    rows = weak_rows(scored).filter(F.col("error_type").isin("FALSE_NEGATIVE", "CORRECT"))
    long = unpivot_features(rows, ["source_label", "error_type"])
    medians = exact_quantiles(
        long, ["source_label", "feature", "error_type"], "value", {"median": 0.5}
    )
    sided = (
        medians.groupBy("source_label", "feature")
        .agg(
            F.max(F.when(F.col("error_type") == "FALSE_NEGATIVE", F.col("median"))).alias("fn_median"),
            F.max(F.when(F.col("error_type") == "CORRECT", F.col("median"))).alias("correct_median"),
        )
        .filter(F.col("fn_median").isNotNull() & F.col("correct_median").isNotNull())
    )
    fn, ok = F.col("fn_median"), F.col("correct_median")
    contrast = sided.select(
        "*",
        divide_or_null(fn, ok).alias("median_ratio"),
        F.when((fn > 0) & (ok > 0), F.abs(F.log2(fn / ok))).alias("abs_log2_ratio"),
    )
    # Twenty rows per family; equal contrasts keep the canonical feature order.
    place = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))
    largest = Window.partitionBy("source_label").orderBy(
        F.desc_nulls_last("abs_log2_ratio"), place
    )
    return (
        contrast.withColumn("rank", F.row_number().over(largest))
        .filter(F.col("rank") <= top)
        .select(
            "source_label",
            "feature",
            "fn_median",
            "correct_median",
            "median_ratio",
            "abs_log2_ratio",
            "rank",
        )
    )


# Quantiles reported for missed rows.
MISSED_QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def fn_feature_quantiles(scored: DataFrame) -> DataFrame:
    missed = weak_rows(scored).filter(F.col("error_type") == "FALSE_NEGATIVE")
    long = unpivot_features(missed, ["source_label"])
    return exact_quantiles(long, ["source_label", "feature"], "value", MISSED_QUANTILES)


def source_context(scored: DataFrame) -> DataFrame:
    """Per family and file: rows, misses, detections, rates, median probabilities."""
    rows = weak_rows(scored)
    group = ["source_label", "source_file"]
    y, p = F.col("binary_label"), F.col("prediction")
    missed, found = (y == 1) & (p == 0), (y == 1) & (p == 1)
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("attack_rows"),
        F.count_if(missed).alias("fn"),
        F.count_if(found).alias("correct"),
    )
    kinds = rows.filter(missed | found).select(
        *group, F.when(missed, "fn").otherwise("correct").alias("kind"), "attack_probability"
    )
    medians = (
        exact_quantiles(kinds, [*group, "kind"], "attack_probability", {"median": 0.5})
        .groupBy(*group)
        .agg(
            F.max(F.when(F.col("kind") == "fn", F.col("median"))).alias("fn_prob_median"),
            F.max(F.when(F.col("kind") == "correct", F.col("median"))).alias("correct_prob_median"),
        )
    )
    return (
        counts.join(medians, group, "left")
        .select(
            *group,
            "attack_rows",
            "fn",
            "correct",
            divide_or_null("correct", "attack_rows").alias("recall"),
            divide_or_null("fn", "attack_rows").alias("fn_rate"),
            "fn_prob_median",
            "correct_prob_median",
        )
        .orderBy(F.desc("fn"), F.desc("attack_rows"))
    )


def fn_concentration(scored: DataFrame) -> DataFrame:
    """Share of a family's misses that each file holds."""
    missed = weak_rows(scored).filter(F.col("error_type") == "FALSE_NEGATIVE")
    per_file = missed.groupBy("source_label", "source_file").agg(F.count(F.lit(1)).alias("fn"))
    per_family = per_file.groupBy("source_label").agg(F.sum("fn").alias("family_fn"))
    return per_file.join(per_family, "source_label").select(
        "source_label",
        "source_file",
        "fn",
        divide_or_null("fn", "family_fn").alias("concentration"),
    )


PROBABILITY_QUANTILES = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}


def probability_summary(scored: DataFrame) -> DataFrame:
    """Spread of the attack probability per family and error group."""
    rows = weak_rows(scored).filter(F.col("error_type").isin("FALSE_NEGATIVE", "CORRECT"))
    group = ["source_label", "error_type"]
    quantiles = exact_quantiles(rows, group, "attack_probability", PROBABILITY_QUANTILES)
    means = rows.groupBy(*group).agg(F.avg("attack_probability").alias("mean"))
    return quantiles.join(means, group)


def provenance_join(scored: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """Attach source label and file to scored rows by key.

    ``alignment_report`` is the check that the two tables do describe the same
    rows.
    """
    source = provenance.select(key, "source_label", "source_file")
    return scored.join(source, key)


def alignment_report(frozen: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """Rows on one side only, and rows whose features or labels differ."""
    # Features move as one array: floats take four bytes each there, eight as columns.
    left = frozen.select(key, "label", F.array(*FEATURES).alias("_l"))
    right = provenance.select(key, F.col("binary_label").alias("_label"), F.array(*FEATURES).alias("_r"))
    both = left.join(right, key, "full_outer")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    same = F.lit(True)
    for i in range(len(FEATURES)):
        same = same & F.get("_l", F.lit(i)).eqNullSafe(F.get("_r", F.lit(i)))
    return both.agg(
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("only_frozen"),
        F.count_if(F.col("_l").isNull()).alias("only_provenance"),
        F.count_if(matched & ~same).alias("feature_mismatch"),
        F.count_if(matched & ~F.col("label").eqNullSafe(F.col("_label"))).alias("label_mismatch"),
    )
