import glob
import json

from flowweir.operators import metrics as MT
from flowweir.operators import summaries as SM
from flowweir.session import stage_path
from flowweir.sources.tables import write_report


def written(spark, summary):
    path = stage_path(spark, "summary")
    write_report(summary, path)
    lines = [line for part in glob.glob(path.removeprefix("file:") + "/part-*") for line in open(part)]
    assert len(lines) == 1
    return json.loads(lines[0])


def test_parity_summary_nests_verdicts_and_features(spark):
    drift = spark.createDataFrame(
        [("b", 0.6, "large"), ("a", 0.1, "small"), ("c", 0.3, "moderate")],
        "feature string, ks_statistic double, verdict string",
    )
    got = written(spark, SM.parity_summary(drift, spark.range(5), spark.range(3), spark.range(9), interface="lo"))
    assert got["summary"] == {
        "reference_rows": 5,
        "live_packets": 9,
        "live_flows": 3,
        "interface": "lo",
        "feature_verdicts": {"a": "small", "b": "large", "c": "moderate"},
        "large_shift": ["b"],
        "small_shift": ["a"],
    }
    assert [f["feature"] for f in got["features"]] == ["a", "b", "c"]
    assert got["features"][1] == {"feature": "b", "ks_statistic": 0.6, "verdict": "large"}


def test_scenario_summary_holds_report_and_metrics(spark):
    flows = spark.createDataFrame(
        [("scan", 1, 1), ("scan", 1, 0), ("web", 0, 0)], "scenario string, label int, prediction int"
    )
    packets = spark.createDataFrame([("scan",), ("web",), ("web",)], "scenario string")
    got = written(spark, SM.scenario_summary(MT.scenario_report(flows, packets), flows, note="lab"))
    assert [s["scenario"] for s in got["scenarios"]] == ["scan", "web"]
    assert got["scenarios"][0]["predicted_attack"] == 1 and got["scenarios"][1]["packets"] == 2
    assert got["note"] == "lab" and got["metrics"]["recall"] == 0.5
    empty = written(spark, SM.scenario_summary(MT.scenario_report(flows.limit(0), packets), flows.limit(0)))
    assert empty["scenarios"] == [] and empty["metrics"]["samples"] == 0


def test_adaptation_summary_scores_test_rows_only(spark):
    rows = spark.createDataFrame(
        [("train", 1, 0, 0), ("test", 1, 0, 1), ("test", 0, 0, 0)],
        "split string, label int, old int, new int",
    )
    got = written(spark, SM.adaptation_summary(rows, "label", "old", "new", interface="lo"))
    assert got["counts"] == {"train": 1, "test": 2, "attack_train": 1, "attack_test": 1}
    assert got["candidate"]["metrics"]["f1"] == 1.0 and got["frozen"]["metrics"]["recall"] == 0.0


def test_fpr_summary_writes_a_missing_candidate_as_null(spark):
    benign = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "old int, new int")
    rates = MT.two_model_fpr(benign, "old", "new")
    both = written(spark, SM.fpr_summary(rates, spark.range(7)))
    assert both["frozen"] == {"flagged": 1, "false_positive_rate": 0.3333}
    assert both["candidate"] == {"flagged": 0, "false_positive_rate": 0.0} and both["packets"] == 7
    alone = written(spark, SM.fpr_summary(rates, spark.range(7), candidate=False))
    assert "candidate" in alone and alone["candidate"] is None
