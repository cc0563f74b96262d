"""Nested run summaries: one row each, for ``write_report``.

Every part is a table that Spark has reduced to a row or a short report before it
gets here: twenty features, the scenarios or the models of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.operators.metrics import binary_metrics


def _side_by_side(**parts: DataFrame) -> DataFrame:
    """One row with a struct per one-row table."""
    rows = None
    for name, part in parts.items():
        own = part.select(F.struct("*").alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])


def _listed(*entry: Column | str) -> Column:
    """Array of the rows, ordered by their first field."""
    return F.array_sort(F.collect_list(F.struct(*entry)))


def _facts(facts: dict[str, object]) -> list[Column]:
    return [F.lit(value).alias(name) for name, value in facts.items()]


def parity_summary(
    drift: DataFrame, reference: DataFrame, live: DataFrame, packets: DataFrame, **facts
) -> DataFrame:
    """``summary`` (sizes, facts of the run, verdict per feature, shifted features) and ``features``.

    ``drift`` is the result of ``feature_drift``.
    """

    def shifted(verdict):
        return F.array_sort(F.collect_list(F.when(F.col("verdict") == verdict, F.col("feature"))))

    rows = F.count(F.lit(1))
    first = F.col("feature")
    rest = [F.col(c) for c in drift.columns if c != "feature"]
    parts = _side_by_side(
        drift=drift.agg(
            _listed(first, *rest).alias("features"),
            F.map_from_entries(_listed("feature", "verdict")).alias("feature_verdicts"),
            shifted("large").alias("large_shift"),
            shifted("small").alias("small_shift"),
        ),
        reference=reference.agg(rows.alias("rows")),
        live=live.agg(rows.alias("rows")),
        packets=packets.agg(rows.alias("rows")),
    )
    return parts.select(
        F.struct(
            F.col("reference.rows").alias("reference_rows"),
            F.col("packets.rows").alias("live_packets"),
            F.col("live.rows").alias("live_flows"),
            *_facts(facts),
            "drift.feature_verdicts",
            "drift.large_shift",
            "drift.small_shift",
        ).alias("summary"),
        "drift.features",
    )


def scenario_summary(report: DataFrame, flows: DataFrame, **facts) -> DataFrame:
    """``scenarios`` (the rows of ``scenario_report``) and ``metrics`` over all their flows."""
    rest = [c for c in report.columns if c != "scenario"]
    parts = _side_by_side(
        report=report.agg(_listed("scenario", *rest).alias("scenarios")),
        metrics=binary_metrics(flows),
    )
    return parts.select(*_facts(facts), "report.scenarios", "metrics")


def adaptation_summary(
    rows: DataFrame, label: str, frozen: str, candidate: str, split: str = "split", **facts
) -> DataFrame:
    """Rows and attacks of both sides of a split, and both models on its test rows."""
    test = F.col(split) == "test"
    attack = F.col(label) == 1
    tested = rows.filter(test)
    parts = _side_by_side(
        counts=rows.agg(
            F.count_if(F.col(split) == "train").alias("train"),
            F.count_if(test).alias("test"),
            F.count_if(attack & (F.col(split) == "train")).alias("attack_train"),
            F.count_if(attack & test).alias("attack_test"),
        ),
        candidate=binary_metrics(tested, label, candidate).select(F.struct("*").alias("metrics")),
        frozen=binary_metrics(tested, label, frozen).select(F.struct("*").alias("metrics")),
    )
    return parts.select(*_facts(facts), "counts", "candidate", "frozen")


def fpr_summary(rates: DataFrame, packets: DataFrame, candidate: bool = True, **facts) -> DataFrame:
    """Flagged benign flows per model from a ``two_model_fpr`` row; no candidate is null."""

    def model(name):
        return F.struct(
            F.col(f"rates.{name}_flagged").alias("flagged"),
            F.col(f"rates.{name}_fpr").alias("false_positive_rate"),
        )

    parts = _side_by_side(rates=rates, packets=packets.agg(F.count(F.lit(1)).alias("rows")))
    second = model("candidate")
    return parts.select(
        *_facts(facts),
        F.col("packets.rows").alias("packets"),
        F.col("rates.flows").alias("flows"),
        model("frozen").alias("frozen"),
        (second if candidate else F.when(F.lit(False), second)).alias("candidate"),
    )
