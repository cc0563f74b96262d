"""Column contracts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The twenty feature names and their order.
FEATURES = [
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "fwd_packet_length",
    "bwd_packet_length",
    "flow_bytes",
    "flow_packets",
    "flow_rate",
    "packet_rate",
    "avg_packet_size",
    "syn_count",
    "ack_count",
    "rst_count",
    "fin_count",
    "active_time",
    "idle_time",
    "header_length",
    "down_up_ratio",
    "fwd_iat_mean",
    "bwd_iat_mean",
]

# Canonical feature -> raw flow-meter column.
DIRECT_COLUMNS = {
    "flow_duration": "Flow Duration",
    "total_fwd_packets": "Total Fwd Packets",
    "total_bwd_packets": "Total Backward Packets",
    "fwd_packet_length": "Fwd Packet Length Mean",
    "bwd_packet_length": "Bwd Packet Length Mean",
    "flow_rate": "Flow Bytes/s",
    "packet_rate": "Flow Packets/s",
    "avg_packet_size": "Average Packet Size",
    "syn_count": "SYN Flag Count",
    "ack_count": "ACK Flag Count",
    "rst_count": "RST Flag Count",
    "fin_count": "FIN Flag Count",
    "active_time": "Active Mean",
    "idle_time": "Idle Mean",
    "down_up_ratio": "Down/Up Ratio",
    "fwd_iat_mean": "Fwd IAT Mean",
    "bwd_iat_mean": "Bwd IAT Mean",
}

# Canonical feature -> the two raw columns it is the sum of.
SUMMED_COLUMNS = {
    "flow_bytes": ("Total Length of Fwd Packets", "Total Length of Bwd Packets"),
    "flow_packets": ("Total Fwd Packets", "Total Backward Packets"),
    "header_length": ("Fwd Header Length", "Bwd Header Length"),
}

# The raw columns that are read.
RAW_COLUMNS = [
    *DIRECT_COLUMNS.values(),
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Header Length",
    "Bwd Header Length",
    "Label",
]

# Features that a prepared row must not carry below zero.
NON_NEGATIVE_PREPARED = [
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "flow_bytes",
    "flow_packets",
]

# Features that a live row must not carry below zero. The two mean
# packet lengths are not among them.
NON_NEGATIVE_LIVE = [
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "flow_bytes",
    "flow_packets",
    "flow_rate",
    "packet_rate",
    "avg_packet_size",
    "syn_count",
    "ack_count",
    "rst_count",
    "fin_count",
    "active_time",
    "idle_time",
    "header_length",
    "down_up_ratio",
    "fwd_iat_mean",
    "bwd_iat_mean",
]

FLOW_TIMEOUT_US = 120_000_000
ACTIVITY_GAP_US = 5_000_000

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("ip_proto", T.IntegerType()),
        T.StructField("ip_ihl", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_dataofs", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("frame_len", T.IntegerType()),
    ]
)

# A flow key inside one capture. The two endpoints are ordered by (ip, port).
KEY = ["capture_id", "protocol", "lo_ip", "lo_port", "hi_ip", "hi_port"]
FLOW = [*KEY, "flow_start_us"]

FEATURE_SCHEMA = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

LABEL_WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("start_epoch", T.DoubleType()),
        T.StructField("end_epoch", T.DoubleType()),
        T.StructField("pcap", T.StringType()),
    ]
)

DETECTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("packets_captured", T.LongType()),
        T.StructField("capture_duration", T.DoubleType()),
    ]
)


def schema_difference(columns, expected=FEATURES):
    """Missing and unexpected names against the contract, both sorted."""
    have, want = set(columns), set(expected)
    return sorted(want - have), sorted(have - want)


def require_columns(df, expected=FEATURES, exact=False):
    """Raise when ``df`` lacks a contract column (or, if exact, has another)."""
    missing, unexpected = schema_difference(df.columns, expected)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if exact and unexpected:
        raise ValueError(f"unexpected columns: {unexpected}")
    if exact and list(df.columns) != list(expected):
        raise ValueError("columns are not in canonical order")
    return df
