"""Binary metrics: counts first, ratios from the one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import as_column, rounded_ratio, safe_divide


def _counts(label, prediction):
    y, p = as_column(label), as_column(prediction)
    tp, tn = (y == 1) & (p == 1), (y == 0) & (p == 0)
    fp = (y == 0) & (F.coalesce(p, F.lit(-1)) != 0)
    named = {"tp": tp, "fp": fp, "tn": tn}
    counted = [F.count_if(c).alias(n) for n, c in named.items()]
    # Whatever is none of the three is a miss.
    missed = ~F.coalesce(tp, F.lit(False)) & ~F.coalesce(tn, F.lit(False))
    missed = missed & ~F.coalesce(fp, F.lit(False))
    return [*counted, F.count_if(missed).alias("fn")]


def confusion_counts(df: DataFrame, label="label", prediction="prediction", by=()) -> DataFrame:
    return df.groupBy(*by).agg(*_counts(label, prediction))


def _rounded(counts: DataFrame, by=()) -> DataFrame:
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    first = counts.select(
        *by,
        "tp",
        "fp",
        "tn",
        "fn",
        total.alias("samples"),
        rounded_ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        rounded_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rounded_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        rounded_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
    )
    # F1 comes from the rounded precision and recall.
    p, r = F.col("precision"), F.col("recall")
    return first.withColumn("f1", rounded_ratio(2 * p * r, p + r))


def binary_metrics(df: DataFrame, label="label", prediction="prediction", by=()) -> DataFrame:
    """Counts and ratios rounded to four places; all zero on empty input."""
    return _rounded(confusion_counts(df, label, prediction, by), by)


def heldout_metrics(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Unrounded accuracy, precision, recall, F1 and the 2x2 matrix."""
    counts = confusion_counts(df, label, prediction)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp",
        "fp",
        "tn",
        "fn",
        safe_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_divide(tp, tp + fp).alias("precision"),
        safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(metric, score, percentage) rows, as the metrics file holds them."""
    long = metrics.select(
        F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("f1").alias("F1-Score"),
    ).unpivot([], ["Accuracy", "Precision", "Recall", "F1-Score"], "metric", "score")
    return long.withColumn("percentage", F.col("score") * 100)


def classification_report(
    df: DataFrame, label="label", prediction="prediction", names=("Benign", "Attack")
) -> DataFrame:
    """Per-class precision, recall, F1, support; accuracy, macro and weighted rows.

    One aggregation over the data; the report rows come from its single row.
    """
    counts = confusion_counts(df, label, prediction)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def entry(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class_name"),
            safe_divide(hit, hit + wrong).alias("precision"),
            safe_divide(hit, hit + missed).alias("recall"),
            safe_divide(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = counts.select(
        entry(names[0], tn, fn, fp).alias("a"),
        entry(names[1], tp, fp, fn).alias("b"),
        safe_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        (tp + tn + fp + fn).alias("n"),
    )

    def average(name, pick):
        return F.struct(
            F.lit(name).alias("class_name"),
            *[pick(m).alias(m) for m in ("precision", "recall", "f1")],
            F.col("n").alias("support"),
        )

    def macro(m):
        return (F.col(f"a.{m}") + F.col(f"b.{m}")) / 2

    def weighted(m):
        total = F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support")
        return safe_divide(total, "n")

    rows = F.array(
        F.col("a"),
        F.col("b"),
        average("accuracy", lambda m: F.col("accuracy")),
        average("macro avg", macro),
        average("weighted avg", weighted),
    )
    return classes.select(F.inline(rows))


def scenario_report(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets, flows and predicted attacks of each scenario."""
    per_flow = flows.groupBy("scenario", "label").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("prediction").alias("predicted_attack")
    )
    per_packet = packets.groupBy("scenario").agg(F.count(F.lit(1)).alias("packets"))
    return per_flow.join(per_packet, "scenario", "left").select(
        "scenario",
        F.when(F.col("label") == 1, "attack").otherwise("benign").alias("label"),
        F.coalesce("packets", F.lit(0)).alias("packets"),
        "flows",
        "predicted_attack",
    )


def labelled_prediction_metrics(
    labels: DataFrame, predictions: DataFrame, key: str = "flow_id"
) -> DataFrame:
    """Metrics over the flows that have both a label, benign or attack, and a prediction."""
    label = F.trim("label")
    known = labels.select(
        key, F.when(label == "attack", 1).when(label == "benign", 0).alias("label")
    ).filter(F.col("label").isNotNull())
    return binary_metrics(known.join(predictions.select(key, "prediction"), key))


def two_model_fpr(benign: DataFrame, first: str, second: str) -> DataFrame:
    """False alarms of two models on benign-only flows."""
    totals = benign.agg(
        F.count(F.lit(1)).alias("flows"),
        F.coalesce(F.sum(first), F.lit(0)).alias("frozen_flagged"),
        F.coalesce(F.sum(second), F.lit(0)).alias("candidate_flagged"),
    )
    return totals.select(
        "*",
        rounded_ratio("frozen_flagged", "flows").alias("frozen_fpr"),
        rounded_ratio("candidate_flagged", "flows").alias("candidate_fpr"),
    )


def two_model_metrics(df: DataFrame, label: str, models: dict[str, str]) -> DataFrame:
    """Metrics of several prediction columns over the same rows, one row each.

    All counts come from one pass over the data.
    """
    names = list(models)
    counted = df.agg(
        *[
            c.alias(f"{name}_{part}")
            for name in names
            for c, part in zip(_counts(label, models[name]), ("tp", "fp", "tn", "fn"))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                *[F.col(f"{name}_{part}").alias(part) for part in ("tp", "fp", "tn", "fn")],
            )
            for name in names
        ]
    )
    return _rounded(counted.select(F.inline(rows)), ["model"])


def split_counts(df: DataFrame, split="split", label="label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))


