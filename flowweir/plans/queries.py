"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Final projections round doubles only where the two engines of the check add
numbers in a different order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.functions import columns as C
from flowweir.operators import captures as CP
from flowweir.operators import contracts as CT
from flowweir.operators import drift as DR
from flowweir.operators import errors as ER
from flowweir.operators import flows as FL
from flowweir.operators import metrics as MT
from flowweir.operators import packets as PK
from flowweir.operators import prepare as PR
from flowweir.operators import proximity as PX
from flowweir.operators import scoring as SC
from flowweir.operators import splits as SP
from flowweir.operators import summaries as SM
from flowweir.operators import windows as WN
from flowweir.plans import inputs as IN
from flowweir.schema import FEATURES, FLOW, KEY
from flowweir.session import stage_path, stage_table
from flowweir.sources import captures as CF
from flowweir.sources import driver_tables as T
from flowweir.sources import tables as TB
from flowweir.streaming import capture_source as CS
from flowweir.streaming import sinks as SK
from flowweir.streaming import tracker as TK
from flowweir.streaming import verdicts as SV
from flowweir.streaming import windows as SW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int, *names) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _flows(spark, sf_dir):
    return FL.flow_features(T.packets(spark, sf_dir))


# ---- packets and flows ---------------------------------------------------


@query
def flow_features(spark, sf_dir):
    return _flows(spark, sf_dir).select(*FLOW, *FEATURES)


@query
def flow_keys(spark, sf_dir):
    return PK.flow_keys(T.packets(spark, sf_dir)).select("packet_id", *KEY, "from_lo")


@query
def packet_measures(spark, sf_dir):
    return PK.packet_measures(T.packets(spark, sf_dir)).select(
        "packet_id", "payload_bytes", "header_bytes", "syn", "ack", "rst", "fin"
    )


@query
def flow_assignment(spark, sf_dir):
    return FL.assign_flows(T.packets(spark, sf_dir)).select("packet_id", *FLOW)


@query
def active_idle(spark, sf_dir):
    flows = FL.flow_aggregates(FL.assign_flows(T.packets(spark, sf_dir)))
    return flows.select(
        *FLOW,
        C.safe_divide("active_us", "active_periods").alias("active_time"),
        C.safe_divide("idle_us", "idle_periods").alias("idle_time"),
    )


@query
def flow_groups(spark, sf_dir):
    assigned = stage_table(FL.assign_flows(T.packets(spark, sf_dir)), "assigned")
    grouped = FL.flow_groups(assigned)
    return PK.packet_listing(grouped).select(
        *FLOW, "packet_id", "packet_index", "forward_ip", "forward_port"
    )


@query
def packet_details(spark, sf_dir):
    """Packets of the first ten eligible flows of each capture."""
    # Three uses: features, forward side, listing.
    assigned = stage_table(FL.assign_flows(T.packets(spark, sf_dir)), "assigned")
    flows = FL.features_from_aggregates(FL.flow_aggregates(assigned))
    numbered = FL.with_flow_seq(FL.eligible_flows(flows))
    shown = numbered.filter(F.col("flow_seq") <= 10).select(*FLOW, "flow_seq")
    listed = PK.packet_listing(FL.flow_groups(assigned.join(shown.drop("flow_seq"), FLOW)))
    return listed.join(shown, FLOW).select(
        "capture_id",
        "flow_seq",
        "packet_index",
        "packet_id",
        "ts_us",
        "direction",
        "payload",
        "header",
        "flags",
        "source",
        "destination",
    )


@query
def eligible_flows(spark, sf_dir):
    return FL.eligible_flows(_flows(spark, sf_dir)).select(
        *FLOW, "total_fwd_packets", "total_bwd_packets"
    )


@query
def eligibility_counts(spark, sf_dir):
    return FL.eligibility_counts(_flows(spark, sf_dir))


@query
def export_flows(spark, sf_dir):
    return FL.export_rows(_flows(spark, sf_dir))


@query
def export_flow_file(spark, sf_dir):
    packets = T.packets(spark, sf_dir)
    path = stage_path(spark, "flow-file") + ".csv"
    return FL.export_flow_file(packets, FL.flow_features(packets), path)


@query
def capture_features(spark, sf_dir):
    return CP.capture_features(T.packets(spark, sf_dir))


@query
def capture_stats(spark, sf_dir):
    return CP.capture_stats(T.packets(spark, sf_dir))


@query
def label_window_rows(spark, sf_dir):
    return CT.label_window_rows(T.label_windows(spark, sf_dir))


@query
def label_window_log(spark, sf_dir):
    """Label windows appended to their log capture by capture, then read back."""
    windows = stage_table(CT.label_window_rows(T.label_windows(spark, sf_dir)), "windows")
    path = stage_path(spark, "window-log")
    odd = F.expr("cast(substring(pcap, 5, 1) AS int) % 2 = 1")
    TB.append_rows(windows.filter(~odd), path)
    TB.append_rows(windows.filter(odd), path)
    return spark.read.schema(windows.schema).parquet(path)


@query
def label_flows_by_window(spark, sf_dir):
    windows = CT.label_window_rows(T.label_windows(spark, sf_dir))
    return WN.label_flows_by_window(_flows(spark, sf_dir), windows).select(
        *FLOW, "scenario", "window_label"
    )


@query
def label_flows_once(spark, sf_dir):
    """Windows of two widths over each capture: most flows lie in two, labels often differ."""
    narrow, wide = (CT.label_window_rows(T.label_windows(spark, sf_dir, n)) for n in (10, 7))
    wide = wide.withColumn("scenario", F.concat(F.lit("wide-"), "scenario"))
    return WN.label_flows_once(_flows(spark, sf_dir), narrow.unionByName(wide)).select(
        *FLOW, "scenario", "window_label", "windows", "conflict"
    )


_DECODED = [
    "capture_id",
    "ts_us",
    "src_ip",
    "dst_ip",
    "ip_proto",
    "ip_ihl",
    "src_port",
    "dst_port",
    "tcp_dataofs",
    "tcp_flags",
    "payload_len",
    "frame_len",
]


def _written_captures(spark, sf_dir) -> str:
    """Folder with the packet table as capture files, some of each capture."""
    folder = stage_path(spark, "captures")
    IN.write_captures(T.packets(spark, sf_dir), folder)
    return folder


def _capture_of_file(path):
    return F.regexp_extract(path, r"([^/]+)_\d+_\d+\.pcap$", 1)


def _decoded(packets):
    spelled = {c: F.expr(T.client_spelling(c)) for c in ("src_ip", "dst_ip")}
    return packets.withColumns(spelled).select(*_DECODED)


@query
def pcap_ingest(spark, sf_dir):
    """Capture files, read by ranges much shorter than a file."""
    folder = _written_captures(spark, sf_dir)
    packets = CF.read_captures(spark, folder, capture_of=_capture_of_file, split_bytes=1 << 18)
    return _decoded(packets)


@query
def pcap_stream(spark, sf_dir):
    """The same files as a stream."""
    packets = CS.capture_stream(
        spark, _written_captures(spark, sf_dir), stage_path(spark, "capture-progress")
    )
    read = SK.run_available(packets, "captured")
    return _decoded(read.withColumn("capture_id", _capture_of_file(F.col("capture_id"))))


# ---- raw records and table preparation ------------------------------------


def _raw_numbers(raw):
    return [
        F.col(f"`{c}`").try_cast("double").alias(c.lower().replace(" ", "_").replace("/", "_per_"))
        for c in raw.columns
        if c not in ("source_file", "Label", "row_key", "copy")
    ]


@query
def raw_flow_scan(spark, sf_dir):
    """Raw records written as CSV in two column orders, read back as a folder of files."""
    raw = T.raw_flow_records(spark, sf_dir).drop("row_key", "copy", "source_file")
    folder = stage_path(spark, "raw-csv")
    turned = F.pmod(F.col("`Flow Duration`").cast("long"), F.lit(3)) == 0
    kept = F.coalesce(turned, F.lit(False))
    raw.filter(~kept).write.option("header", True).csv(folder)
    other = raw.filter(kept).select(F.lit("x").alias("More"), *[f"`{c}`" for c in raw.columns[::-1]])
    other.write.mode("append").option("header", True).csv(folder)
    scanned = TB.load_raw_flow_directory(spark, folder)
    return scanned.select(*_raw_numbers(scanned), F.col("Label").alias("label"))


@query
def scan_flow_csv(spark, sf_dir):
    """Labelled flow table written as one CSV dataset and loaded again."""
    table = PR.prepare_canonical(T.raw_flow_records(spark, sf_dir))
    path = stage_path(spark, "canonical") + ".csv"
    table.write.option("header", True).csv(path)
    return TB.load_csv(spark, path, table.schema)


@query
def label_normalization(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    # Spread the spellings the three rules treat differently over the rows.
    spelled = F.expr(
        "CASE WHEN `Label` = 'BENIGN' THEN CASE CAST(`Total Backward Packets` AS int) % 5 "
        "WHEN 0 THEN ' BENIGN ' WHEN 1 THEN 'Benign' WHEN 2 THEN 'normal' WHEN 3 THEN '0' "
        "ELSE `Label` END ELSE `Label` END"
    )
    return (
        raw.select(spelled.alias("source_label"))
        .groupBy("source_label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "source_label",
            "rows",
            C.label_not_benign("source_label").cast("int").alias("training_label"),
            C.label_evaluation("source_label").alias("evaluation_label"),
            C.label_exact("source_label").alias("exact_label"),
            C.label_display("source_label").alias("display_label"),
        )
    )


@query
def prepare_canonical(spark, sf_dir):
    return PR.prepare_canonical(T.raw_flow_records(spark, sf_dir))


@query
def canonical_scan(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    table = PR.canonical_text(raw, "row_key", "Label").withColumn(
        "label", C.label_not_benign("Label").cast("int")
    )
    return PR.canonical_scan(table)


@query
def provenance_dedup(spark, sf_dir):
    return PR.provenance_dedup(T.raw_flow_records(spark, sf_dir))


def _frozen_and_regenerated(spark, sf_dir):
    """Prepared table by row key, and a second build with planted differences."""
    built = PR.provenance_dedup(T.raw_flow_records(spark, sf_dir)).withColumnRenamed(
        "binary_label", "label"
    )
    bucket = F.conv(F.substring(F.md5("row_key"), 1, 6), 16, 10).cast("bigint")
    changed = built.filter(bucket % 101 != 0).select(
        "row_key",
        *[
            F.when(bucket % 97 == 0, F.col(f) + 1).otherwise(F.col(f)).cast("float").alias(f)
            if f in ("flow_bytes", "idle_time")
            else f
            for f in FEATURES
        ],
        F.when(bucket % 89 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
    )
    return built, changed


@query
def reproduction_diff(spark, sf_dir):
    built, changed = _frozen_and_regenerated(spark, sf_dir)
    return PR.reproduction_diff(changed, built.select("row_key", *FEATURES, "label"), "row_key")


@query
def reproduction_multiset(spark, sf_dir):
    once = PR.prepare_canonical(T.raw_flow_records(spark, sf_dir))
    again = PR.clean_flow_records(T.raw_flow_records(spark, sf_dir)).select(
        *FEATURES, C.label_not_benign("Label").alias("label")
    )
    return PR.multiset_diff(once, PR.stored_types(again))


@query
def clean_impute(spark, sf_dir):
    return PR.clean_impute(T.mixed_records(spark, sf_dir))


MIXED_CATEGORIES = {"flag": ["A", "N", "R"], "status": ["F", "O"]}


@query
def one_hot(spark, sf_dir):
    return PR.one_hot(T.mixed_records(spark, sf_dir), MIXED_CATEGORIES)


@query
def category_positions(spark, sf_dir):
    encoded = PR.category_positions(T.mixed_records(spark, sf_dir), "order_no")
    return encoded.withColumn("positions", F.array_join("positions", ","))


@query
def prepared_features(spark, sf_dir):
    return PR.prepared_features(T.mixed_records(spark, sf_dir), MIXED_CATEGORIES)


@query
def dataset_profile(spark, sf_dir):
    return PR.dataset_profile(T.mixed_records(spark, sf_dir))


@query
def dataset_head(spark, sf_dir):
    """The first rows of a profile."""
    return PR.dataset_head(T.scored_flows(spark, sf_dir).select("row_key", *FEATURES), "row_key")


@query
def safe_numbers(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    return raw.select(
        "row_key",
        *[
            C.safe_number(F.col(f"`{c}`")).alias(n)
            for c, n in (
                ("Flow Bytes/s", "flow_rate"),
                ("Flow Packets/s", "packet_rate"),
                ("Flow Duration", "flow_duration"),
            )
        ],
    )


@query
def benign_sample(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    table = PR.canonical_text(raw, "row_key", "Label").withColumnRenamed("Label", "label")
    return PR.benign_sample(table, "row_key")


@query
def benign_head(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    table = PR.canonical_text(raw, "row_key", "Label").withColumnRenamed("Label", "label")
    return PR.benign_sample(table, "row_key", 5_000)


# ---- contracts -------------------------------------------------------------


@query
def feature_contract_violations(spark, sf_dir):
    raw = T.raw_flow_records(spark, sf_dir)
    text = PR.canonical_text(raw, "row_key", "source_file")
    checked = CT.with_feature_violations(text)
    return (
        checked.select("source_file", F.explode("violations").alias("violation"))
        .groupBy("source_file", "violation")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query
def score_contract_violations(spark, sf_dir):
    scored = T.scored_flows(spark, sf_dir)
    p = F.col("attack_probability")
    broken = scored.select(
        "row_key",
        F.expr(
            "CASE m % 7 WHEN 1 THEN array(attack_probability) "
            "WHEN 2 THEN array(1.0D - attack_probability, double('NaN')) "
            "WHEN 3 THEN array(-0.5D, 1.5D) WHEN 4 THEN array(0.4D, 0.4D) ELSE probabilities END"
        ).alias("probabilities"),
        F.when(F.col("k") % 11 == 0, 2).otherwise((p > 0.5).cast("int")).alias("prediction"),
    )
    return broken.select("row_key", CT.score_violation().alias("violation"))


@query
def capture_contract_violations(spark, sf_dir):
    captures = T.captures(spark, sf_dir)
    slot = F.expr("cast(substring(capture_id, 5) AS int) % 6")
    broken = captures.select(
        "capture_id",
        F.when(slot == 1, F.col("packet_count") + 0.5)
        .when(slot == 2, -F.col("packet_count"))
        .otherwise(F.col("packet_count"))
        .alias("packet_count"),
        F.when(slot == 3, -F.col("capture_duration"))
        .when(slot == 4, F.lit(float("inf")))
        .when(slot == 5, F.lit(None))
        .otherwise(F.col("capture_duration"))
        .alias("capture_duration"),
    )
    return broken.select("capture_id", CT.capture_violation().alias("violation"))


def _label_file(spark, sf_dir):
    return T.scored_flows(spark, sf_dir).select(
        F.col("row_key").alias("flow_id"),
        F.expr(
            "CASE WHEN k % 13 = 0 THEN ' ' WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'unsure' "
            "WHEN k % 23 = 0 THEN 'Attack' WHEN binary_label = 1 THEN 'attack ' ELSE 'benign' END"
        ).alias("label"),
    )


@query
def label_file_check(spark, sf_dir):
    return CT.label_file_check(_label_file(spark, sf_dir))


@query
def invalid_labels(spark, sf_dir):
    return CT.invalid_labels(_label_file(spark, sf_dir))


# ---- verdicts and metrics ---------------------------------------------------


@query
def severity(spark, sf_dir):
    scored = T.scored_flows(spark, sf_dir)
    confidence = F.array_max("probabilities")
    return scored.select(
        "row_key", "prediction", C.severity("prediction", confidence).alias("severity")
    )


def _verdicts(spark, sf_dir):
    return CP.capture_verdict(T.captures(spark, sf_dir), T.scored_flows(spark, sf_dir), "row_key")


@query
def capture_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query
def display_verdict(spark, sf_dir):
    return CP.display_verdict(_verdicts(spark, sf_dir))


def _log(spark, sf_dir):
    stamp = F.timestamp_seconds(
        F.lit(1_700_000_000) + F.expr("cast(substring(capture_id, 5) AS int)") * 60
    )
    number = F.expr("cast(substring(capture_id, 5) AS int)")
    verdicts = _verdicts(spark, sf_dir).withColumns({"timestamp": stamp, "sequence": number})
    return TB.detection_log_rows(verdicts, "timestamp", "sequence")


@query
def detection_log_rows(spark, sf_dir):
    return _log(spark, sf_dir).drop("sequence")


@query
def recent_history(spark, sf_dir):
    return TB.recent_history(_log(spark, sf_dir), "sequence")


@query
def confusion_counts(spark, sf_dir):
    return MT.confusion_counts(T.label_pairs(spark, sf_dir))


@query
def binary_metrics(spark, sf_dir):
    return MT.binary_metrics(T.label_pairs(spark, sf_dir))


@query
def heldout_metrics(spark, sf_dir):
    return MT.heldout_metrics(T.scored_flows(spark, sf_dir), "binary_label")


@query
def metrics_long(spark, sf_dir):
    return MT.metrics_long(MT.heldout_metrics(T.scored_flows(spark, sf_dir), "binary_label"))


@query
def classification_report(spark, sf_dir):
    report = MT.classification_report(T.scored_flows(spark, sf_dir), "binary_label")
    return _rounded(report, 9, "precision", "recall", "f1")


@query
def two_model_fpr(spark, sf_dir):
    benign = T.scored_flows(spark, sf_dir).filter(F.col("binary_label") == 0)
    return MT.two_model_fpr(benign, "prediction", "candidate_prediction")


@query
def two_model_metrics(spark, sf_dir):
    return MT.two_model_metrics(
        T.scored_flows(spark, sf_dir),
        "binary_label",
        {"frozen": "prediction", "candidate": "candidate_prediction"},
    )


def _scenario_flows(spark, sf_dir):
    """Assembled flows of each capture, odd captures as attacks, judged by their SYN flags."""
    return _flows(spark, sf_dir).select(
        F.col("capture_id").alias("scenario"),
        F.expr("cast(cast(substring(capture_id, 5) AS int) % 2 AS int)").alias("label"),
        (F.col("syn_count") > 0).cast("int").alias("prediction"),
    )


@query
def scenario_report(spark, sf_dir):
    packets = T.packets(spark, sf_dir).select(F.col("capture_id").alias("scenario"))
    return MT.scenario_report(_scenario_flows(spark, sf_dir), packets)


@query
def scenario_overall(spark, sf_dir):
    return MT.binary_metrics(_scenario_flows(spark, sf_dir))


@query
def scenario_summary_file(spark, sf_dir):
    """The overall metrics written as JSON and read back."""
    metrics = MT.binary_metrics(_scenario_flows(spark, sf_dir))
    path = stage_path(spark, "summary")
    TB.write_report(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


def _written(spark, summary):
    """A summary as its JSON file holds it."""
    path = stage_path(spark, "summary")
    TB.write_report(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query
def nested_scenario_summary(spark, sf_dir):
    """Scenario rows beside the overall metrics, written nested and read back."""
    flows = stage_table(_scenario_flows(spark, sf_dir), "scenario-flows")
    packets = T.packets(spark, sf_dir).select(F.col("capture_id").alias("scenario"))
    summary = SM.scenario_summary(MT.scenario_report(flows, packets), flows, interface="lo")
    metrics = ["samples", "accuracy", "precision", "recall", "false_positive_rate", "f1"]
    return _written(spark, summary).select(
        "interface", *[f"metrics.{m}" for m in metrics], F.inline("scenarios")
    )


@query
def nested_parity_summary(spark, sf_dir):
    """Drift report and its verdict lists, written nested and read back."""
    reference, live = _two_samples(spark, sf_dir)
    drift = stage_table(DR.feature_drift(reference, live), "drift")
    summary = SM.parity_summary(drift, reference, live, T.packets(spark, sf_dir), interface="lo")
    rows = _written(spark, summary).select("summary", F.inline("features"))
    return rows.select(
        "feature",
        "ks_statistic",
        F.col("summary.feature_verdicts")[F.col("feature")].alias("verdict"),
        F.array_contains("summary.large_shift", F.col("feature")).alias("is_large"),
        F.array_contains("summary.small_shift", F.col("feature")).alias("is_small"),
        "summary.reference_rows",
        "summary.live_flows",
        "summary.live_packets",
    )


@query
def nested_adaptation_summary(spark, sf_dir):
    """Both models on the held-out runs, written nested and read back."""
    rows = SP.run_split(T.scored_flows(spark, sf_dir))
    summary = SM.adaptation_summary(rows, "binary_label", "prediction", "candidate_prediction")
    both = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(f"{name}.metrics").alias("m"))
            for name in ("candidate", "frozen")
        ]
    )
    return _written(spark, summary).select("counts.*", F.inline(both)).select(
        "train", "test", "attack_train", "attack_test", "model", "m.*"
    )


@query
def nested_fpr_summary(spark, sf_dir):
    """False alarms of both models, written nested and read back."""
    benign = T.scored_flows(spark, sf_dir).filter(F.col("binary_label") == 0)
    rates = MT.two_model_fpr(benign, "prediction", "candidate_prediction")
    summary = SM.fpr_summary(rates, T.packets(spark, sf_dir))
    return _written(spark, summary).select(
        "packets",
        "flows",
        *[
            F.col(f"{name}.{part}").alias(f"{name}_{part}")
            for name in ("frozen", "candidate")
            for part in ("flagged", "false_positive_rate")
        ],
    )


@query
def labelled_prediction_metrics(spark, sf_dir):
    """A label file and the scores of nearly all flows, joined by flow id."""
    scores = T.scored_flows(spark, sf_dir).filter("k % 29 <> 0").select(
        F.col("row_key").alias("flow_id"), "prediction"
    )
    return MT.labelled_prediction_metrics(_label_file(spark, sf_dir), scores)


@query
def scenario_metrics(spark, sf_dir):
    return MT.binary_metrics(T.scored_flows(spark, sf_dir), "binary_label", by=["run"])


# ---- error analysis ----------------------------------------------------------


@query
def error_types(spark, sf_dir):
    scored = T.scored_flows(spark, sf_dir)
    odd = F.when(F.col("k") % 50 == 0, 2).otherwise(F.col("prediction"))
    return scored.select(
        "row_key",
        C.error_type("binary_label", "prediction").alias("error_type"),
        C.error_type_strict("binary_label", odd).alias("strict_error_type"),
    )


@query
def error_slices(spark, sf_dir):
    return ER.error_slices(T.scored_flows(spark, sf_dir))


@query
def errors_by_source(spark, sf_dir):
    return ER.errors_by_source(T.scored_flows(spark, sf_dir))


@query
def recall_by_attack(spark, sf_dir):
    return ER.recall_by_attack(T.scored_flows(spark, sf_dir))


@query
def weak_families(spark, sf_dir):
    return ER.weak_families(T.scored_flows(spark, sf_dir))


@query
def family_feature_contrast(spark, sf_dir):
    return _rounded(
        ER.family_feature_contrast(T.scored_flows(spark, sf_dir)),
        6,
        "fn_median",
        "correct_median",
        "median_ratio",
        "abs_log2_ratio",
    )


@query
def fn_feature_quantiles(spark, sf_dir):
    return _rounded(
        ER.fn_feature_quantiles(T.scored_flows(spark, sf_dir)), 6, *ER.MISSED_QUANTILES
    )


@query
def source_context(spark, sf_dir):
    return _rounded(
        ER.source_context(T.scored_flows(spark, sf_dir)), 9, "fn_prob_median", "correct_prob_median"
    )


@query
def fn_concentration(spark, sf_dir):
    return ER.fn_concentration(T.scored_flows(spark, sf_dir))


@query
def probability_summary(spark, sf_dir):
    return _rounded(
        ER.probability_summary(T.scored_flows(spark, sf_dir)),
        9,
        *ER.PROBABILITY_QUANTILES,
        "mean",
    )


@query
def provenance_join(spark, sf_dir):
    scored = T.scored_flows(spark, sf_dir).select("row_key", "binary_label", "prediction")
    provenance = PR.provenance_dedup(T.raw_flow_records(spark, sf_dir))
    joined = ER.provenance_join(scored, provenance, "row_key")
    return joined.select(
        "row_key",
        C.error_type("binary_label", "prediction").alias("error_type"),
        "source_label",
        "source_file",
    )


@query
def alignment_report(spark, sf_dir):
    built, changed = _frozen_and_regenerated(spark, sf_dir)
    return ER.alignment_report(
        changed, built.withColumnRenamed("label", "binary_label"), "row_key"
    )


def _proximity(spark, sf_dir):
    rows = ER.weak_rows(T.leaf_rows(spark, sf_dir)).select(
        "row_key", "source_label", "error_type", "attack_probability", "leaves"
    )
    return PX.leaf_proximity(rows, T.LEAF_TREES)


@query
def leaf_proximity(spark, sf_dir):
    return _rounded(_proximity(spark, sf_dir), 9, "probability_gap")


@query
def leaf_proximity_summary(spark, sf_dir):
    measures = [f"{m}_{q}" for m in ("proximity", "probability_gap") for q in ("min", "median", "q75", "max")]
    summary = PX.leaf_proximity_summary(stage_table(_proximity(spark, sf_dir), "proximity"))
    return _rounded(summary, 9, *measures)


# ---- drift ---------------------------------------------------------------------


def _two_samples(spark, sf_dir):
    """Flows of even client users as reference, of odd ones as live."""
    flows = _flows(spark, sf_dir)
    client = F.when(F.col("lo_ip").startswith("10."), F.col("lo_ip")).otherwise(F.col("hi_ip"))
    even = F.substring_index(client, ".", -1).cast("int") % 2 == 0
    flows = stage_table(flows.select(*FEATURES, even.alias("even")), "samples")
    return flows.filter("even").drop("even"), flows.filter("NOT even").drop("even")


@query
def distribution_summary(spark, sf_dir):
    summary = DR.distribution_summary(T.scored_flows(spark, sf_dir))
    return _rounded(summary, 3, "mean", "std", *DR.SUMMARY_QUANTILES)


@query
def distribution_comparison(spark, sf_dir):
    table = DR.distribution_comparison(*_two_samples(spark, sf_dir))
    return _rounded(table, 6, "train_median", "live_median", "train_p95", "live_p95")


def _drift(spark, sf_dir):
    return DR.feature_drift(*_two_samples(spark, sf_dir))


@query
def feature_drift(spark, sf_dir):
    return _rounded(_drift(spark, sf_dir), 4, "reference_mean", "live_mean", "ks_p_value")


@query
def drift_verdict_lists(spark, sf_dir):
    return DR.drift_verdict_lists(_drift(spark, sf_dir))


@query
def sample_size_class(spark, sf_dir):
    return DR.sample_size_class(FL.eligible_flows(_flows(spark, sf_dir)), ["capture_id"])


# ---- splits and models -----------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    scored = T.scored_flows(spark, sf_dir).select("row_key", "binary_label")
    return SP.stratified_split(scored, "binary_label", "row_key")


@query
def run_split(spark, sf_dir):
    return SP.run_split(T.scored_flows(spark, sf_dir)).select("row_key", "run", "split")


@query
def split_counts(spark, sf_dir):
    split = SP.run_split(T.scored_flows(spark, sf_dir))
    return MT.split_counts(split, "split", "binary_label")


@query
def straddling_runs(spark, sf_dir):
    """Runs that a row-wise draw tears apart, unlike the split by run."""
    scored = T.scored_flows(spark, sf_dir).select("row_key", "binary_label", "source_label", "run")
    split = SP.stratified_split(scored, "binary_label", "row_key")
    return SP.straddling_runs(split, ["source_label", "run"])


@query
def class_weights(spark, sf_dir):
    return SP.class_weights(T.scored_flows(spark, sf_dir), "source_label")


@query
def heuristic_attack_score(spark, sf_dir):
    scored = SP.heuristic_attack_score(T.scored_flows(spark, sf_dir))
    return scored.select("row_key", F.round("attack_score", 6).alias("attack_score"), "label")


def _labelled_flows(spark, sf_dir):
    """Assembled flows with rule-based labels, split by digest."""
    flows = FL.eligible_flows(_flows(spark, sf_dir))
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in FLOW]), 256)
    labelled = SP.heuristic_attack_score(stage_table(flows.withColumn("flow_key", key), "flows"))
    return stage_table(SP.stratified_split(labelled, "label", "flow_key"), "labelled")


def _fit(labelled, **params):
    return SC.train_forest(labelled.filter("split = 'train'"), "label", **params)


@query
def rf_train_eval(spark, sf_dir):
    """Fit on the training part, save and load the model, evaluate on the rest.

    The votes of a forest are not determined by the data, so the row tells what
    is: the support of the parts and whether counts and ratios agree.
    """
    labelled = _labelled_flows(spark, sf_dir)
    path = stage_path(spark, "model")
    SC.save_model(_fit(labelled), path)
    model = SC.load_model(path)
    metrics = MT.heldout_metrics(SC.predict(model, labelled.filter("split = 'test'")))
    support = labelled.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.count_if((F.col("split") == "test") & (F.col("label") == 1)).alias("test_attacks"),
    )
    one = F.lit(1).alias("one")
    both = support.select("*", one).join(metrics.select("*", one), "one")
    return both.select(
        *support.columns,
        F.expr("tp + fp + tn + fn = test_rows AND tp + fn = test_attacks").alias("counts_add_up"),
        F.expr("abs(accuracy - (tp + tn) / test_rows) < 1e-9 AND f1 BETWEEN 0 AND 1").alias(
            "ratios_agree"
        ),
    )


def _all_scored(spark, sf_dir):
    """Every flow scored by a forest that is fitted on flows of more than one packet."""
    flows = stage_table(_flows(spark, sf_dir), "all-flows")
    return SC.detect_flows(_fit(_labelled_flows(spark, sf_dir)), flows, enabled=True)


@query
def detect_flows(spark, sf_dir):
    """All flows with a score record; the record's own contract stands for the votes."""
    scored = _all_scored(spark, sf_dir)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    larger = F.element_at("probabilities", F.col("prediction") + 1) == F.array_max("probabilities")
    return scored.select(
        *FLOW,
        "packet_count",
        "flow_duration",
        (F.abs(total - 1) < 1e-9).alias("pair_sums_to_one"),
        (larger & (F.col("confidence") == F.array_max("probabilities"))).alias("class_is_larger"),
    )


@query
def packets_to_verdict(spark, sf_dir):
    """Packets to flows, scores and one verdict per capture."""
    packets = T.packets(spark, sf_dir)
    scored = stage_table(
        _all_scored(spark, sf_dir).withColumn("flow_order", F.struct(*FLOW[1:])), "scored"
    )
    captures = packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packet_count"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("capture_duration"),
    )
    verdicts = CP.capture_verdict(captures, scored, "flow_order")
    worst = scored.groupBy("capture_id").agg(
        F.max("attack_probability").alias("worst"), F.max("prediction").alias("any_attack")
    )
    follows = (F.abs(F.col("worst") - F.col("attack_probability")) < 1e-12) & (
        F.col("any_attack") == F.col("prediction")
    )
    return verdicts.join(worst, "capture_id", "left").select(
        "capture_id",
        "packet_count",
        "flows",
        F.coalesce(follows, F.col("prediction") == 0).alias("follows_flows"),
    )


@query
def candidate_forest_metrics(spark, sf_dir):
    """The two forest parameter sets side by side on the same held-out rows.

    Samples and attacks per model: what the votes leave determined.
    """
    labelled = _labelled_flows(spark, sf_dir)
    train = labelled.filter("split = 'train'")
    test = labelled.filter("split = 'test'").select("flow_key", "label", *FEATURES)
    deep = SC.predict_parts(SC.forest_parts(train, **SC.FOREST_CANDIDATE), test)
    flat = SC.predict_parts(SC.forest_parts(train, **SC.FOREST_SHALLOW), test)
    both = deep.select("flow_key", "label", F.col("prediction").alias("candidate")).join(
        flat.select("flow_key", F.col("prediction").alias("shallow")), "flow_key"
    )
    metrics = MT.two_model_metrics(both, "label", {"candidate": "candidate", "shallow": "shallow"})
    return metrics.select("model", "samples", (F.col("tp") + F.col("fn")).alias("attacks"))


@query
def forest_leaf_proximity(spark, sf_dir):
    """Leaf proximity with the leaves of a fitted forest; protocols as families."""
    labelled = _labelled_flows(spark, sf_dir)
    weak = _fit(labelled, numTrees=20, maxDepth=3)
    scored = SC.predict(weak, labelled).filter("label = 1")
    rows = scored.select(
        F.col("flow_key").alias("row_key"),
        F.col("protocol").alias("source_label"),
        C.error_type("label", "prediction").alias("error_type"),
        "attack_probability",
        "leaves",
    )
    return PX.leaf_proximity(stage_table(rows, "leaves"), 20)


@query
def artifact_digest(spark, sf_dir):
    """Digest of every document's content."""
    documents = T.table(spark, sf_dir, "documents")
    return documents.select("doc_id", TB.digest(F.col("text").cast("binary")).alias("sha256"))


# ---- streams -----------------------------------------------------------------------


def _packet_stream(spark, sf_dir):
    """The packets in four micro-batches, each late by up to five seconds, and an end marker."""
    folder = stage_path(spark, "packets")
    files = IN.arrival_files(
        T.packets(spark, sf_dir), folder, batches=4, jitter_us=5_000_000, close_us=3_600_000_000
    )
    return SK.packet_stream(spark, folder, maxFilesPerTrigger=files)


@query
def stream_capture_windows(spark, sf_dir):
    return SK.run_available(SW.capture_windows(_packet_stream(spark, sf_dir)), "windows")


@query
def batch_capture_windows(spark, sf_dir):
    return SW.capture_windows(T.packets(spark, sf_dir))


def _syn_scores(flows):
    """Score of a flow by the share of its packets that carry SYN; a model in its place."""
    risk = F.col("syn_count") / F.col("flow_packets")
    return flows.select(
        "*", (risk > 0.5).cast("int").alias("prediction"), F.array(1 - risk, risk).alias("probabilities")
    )


@query
def stream_window_verdicts(spark, sf_dir):
    """Packets to flows, scores and one verdict per live window, as a stream."""
    verdicts = SV.window_verdicts(_packet_stream(spark, sf_dir), _syn_scores)
    return SK.run_available(verdicts, "verdicts")


@query
def batch_window_verdicts(spark, sf_dir):
    return SV.window_verdicts(T.packets(spark, sf_dir), _syn_scores)


@query
def stream_flow_tracker(spark, sf_dir):
    return SK.run_available(TK.track_flows(_packet_stream(spark, sf_dir)), "tracked")


@query
def stream_detection_log(spark, sf_dir):
    """Verdicts arriving as a stream, appended to the log."""
    verdicts = _verdicts(spark, sf_dir)
    folder = stage_path(spark, "verdicts")
    verdicts.write.parquet(folder)
    stream = spark.readStream.schema(verdicts.schema).parquet(folder)
    stamped = stream.withColumn(
        "timestamp",
        F.timestamp_seconds(
            F.lit(1_700_000_000) + F.expr("cast(substring(capture_id, 5) AS int)") * 60
        ),
    )
    return SK.run_detection_log(TB.detection_log_rows(stamped), "log").drop("batch_id")
