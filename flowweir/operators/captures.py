"""One row per capture: features, duration, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import safe_divide, severity
from flowweir.operators.packets import tcp_flag
from flowweir.schema import FEATURES

MIN_DURATION_S = 0.001


def capture_stats(packets: DataFrame) -> DataFrame:
    """Packet count and time span in seconds."""
    return packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("duration_s"),
    )


def capture_aggregates() -> list[Column]:
    """Aggregates behind the capture features, for batch and stream alike."""
    is_ip = F.col("src_ip").isNotNull()
    forward, backward = is_ip & (F.col("src_ip") <= F.col("dst_ip")), is_ip & (
        F.col("src_ip") > F.col("dst_ip")
    )
    length = F.coalesce(F.col("frame_len"), F.lit(0))
    return [
        F.count(F.lit(1)).alias("packets"),
        F.sum(length).alias("bytes"),
        F.count_if(forward).alias("fwd_packets"),
        F.count_if(backward).alias("bwd_packets"),
        F.sum(F.when(forward, length).otherwise(0)).alias("fwd_bytes"),
        F.sum(F.when(backward, length).otherwise(0)).alias("bwd_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count("ts_us").alias("timed"),
        F.sum(tcp_flag(0x02)).alias("syn"),
        F.sum(tcp_flag(0x10)).alias("ack"),
        F.sum(tcp_flag(0x04)).alias("rst"),
        F.sum(tcp_flag(0x01)).alias("fin"),
    ]


def features_of_capture(aggregated: DataFrame, keys, duration: Column | None = None) -> DataFrame:
    """Capture-level feature record.

    It shares the canonical names but not their meaning: whole frame lengths,
    direction by address order, duration in seconds with a floor, total bytes as
    the per-direction lengths, a flat 20-byte header, mean gap in seconds.
    """
    span = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    seconds = F.greatest(span if duration is None else duration, F.lit(MIN_DURATION_S))
    zero = F.lit(0.0)
    values = {
        "flow_duration": seconds,
        "total_fwd_packets": F.col("fwd_packets"),
        "total_bwd_packets": F.col("bwd_packets"),
        "fwd_packet_length": F.col("fwd_bytes"),
        "bwd_packet_length": F.col("bwd_bytes"),
        "flow_bytes": F.col("bytes"),
        "flow_packets": F.col("packets"),
        "flow_rate": F.col("bytes") / seconds,
        "packet_rate": F.col("packets") / seconds,
        "avg_packet_size": safe_divide("bytes", "packets"),
        "syn_count": F.col("syn"),
        "ack_count": F.col("ack"),
        "rst_count": F.col("rst"),
        "fin_count": F.col("fin"),
        "active_time": seconds,
        "idle_time": zero,
        "header_length": F.col("packets") * 20,
        "down_up_ratio": safe_divide("bwd_packets", "fwd_packets"),
        # The mean of consecutive gaps is the span over their number.
        "fwd_iat_mean": F.when(F.col("timed") > 1, span / (F.col("timed") - 1)).otherwise(zero),
        "bwd_iat_mean": zero,
    }
    return aggregated.select(*keys, *[values[f].cast("double").alias(f) for f in FEATURES])


def capture_features(packets: DataFrame) -> DataFrame:
    grouped = packets.groupBy("capture_id").agg(*capture_aggregates())
    return features_of_capture(grouped, ["capture_id"])


def capture_verdict(
    captures: DataFrame, scores: DataFrame, order: str = "flow_seq", keys=("capture_id",)
) -> DataFrame:
    """Roll flow scores up to one verdict per capture.

    The flow with the highest attack probability, the first in ``order`` on a
    tie, gives confidence and risk; one attack flow makes the capture an attack;
    a capture without flows is LOW. The flows themselves stay in ``scores``
    (join on ``keys``, what names a capture): a capture has no bound on their number.
    """
    rolled = scores.groupBy(*keys).agg(
        F.min(top_flow(order)).alias("top"),
        F.max("prediction").alias("any_attack"),
        F.count(F.lit(1)).alias("n"),
    )
    return judged(captures.join(rolled, [*keys], "left"), keys)


def top_flow(order: str) -> Column:
    """Largest risk first, then the smallest order value: the risk is negated for one minimum."""
    risk = F.element_at("probabilities", 2)
    return F.struct((-risk).alias("neg"), F.col(order), F.array_max("probabilities").alias("conf"))


def judged(rolled: DataFrame, keys) -> DataFrame:
    """Verdicts from ``top``, ``any_attack`` and ``n`` (null without flows) beside the totals."""
    prediction = F.coalesce(F.col("any_attack"), F.lit(0)).cast("int")
    confidence = F.coalesce(F.col("top.conf"), F.lit(0.0))
    return rolled.select(
        *keys,
        prediction.alias("prediction"),
        confidence.alias("confidence"),
        F.coalesce(-F.col("top.neg"), F.lit(0.0)).alias("attack_probability"),
        F.when(F.col("n").isNull(), "LOW")
        .otherwise(severity(prediction, confidence))
        .alias("severity"),
        "packet_count",
        F.col("capture_duration").alias("duration"),
        F.coalesce(F.col("n"), F.lit(0)).alias("flows"),
    )


def display_verdict(verdicts: DataFrame) -> DataFrame:
    """Verdict words and percent texts."""
    attack = F.col("prediction") == 1
    unsure = F.col("severity") == "SUSPICIOUS"

    def percent(c):
        return F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%"))

    return verdicts.select(
        "capture_id",
        F.when(attack, "ATTACK").when(unsure, "UNCERTAIN").otherwise("NORMAL").alias("verdict"),
        F.when(attack, "ATTACK DETECTED")
        .when(unsure, "SUSPICIOUS TRAFFIC")
        .otherwise("NORMAL TRAFFIC")
        .alias("result_text"),
        F.when(attack, "Suspicious network traffic detected!")
        .when(unsure, "Traffic may require further investigation.")
        .otherwise("Network traffic appears normal.")
        .alias("warning_text"),
        percent("confidence").alias("confidence_text"),
        percent("attack_probability").alias("risk_text"),
    )
