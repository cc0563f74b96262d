"""DuckDB statements the queries are checked against.

Each states the result directly over the driver tables. Flow assembly is written
as a recursive walk over successor times, unlike the bucketed Spark plan.
"""

from __future__ import annotations

from flowweir.schema import DIRECT_COLUMNS, FEATURES, RAW_COLUMNS

F20 = ", ".join(FEATURES)

PACKETS = """
packets AS (
  SELECT 'cap-' || (user_id % 8) AS capture_id, event_id AS packet_id, ts_us,
    CASE WHEN non_ip THEN NULL WHEN reply THEN server ELSE client END AS src_ip,
    CASE WHEN non_ip THEN NULL WHEN reply THEN client ELSE server END AS dst_ip,
    ip_proto, 5 AS ip_ihl,
    CASE WHEN ip_proto = 1 THEN NULL WHEN reply THEN sport ELSE cport END AS src_port,
    CASE WHEN ip_proto = 1 THEN NULL WHEN reply THEN cport ELSE sport END AS dst_port,
    dataofs AS tcp_dataofs, flags AS tcp_flags, payload_len,
    CAST(payload_len + 34 + CASE ip_proto WHEN 6 THEN dataofs * 4 WHEN 17 THEN 8 ELSE 0 END AS INTEGER) AS frame_len
  FROM (
    SELECT event_id, user_id, epoch_us(ts) // 5000 AS ts_us, ip_proto,
      '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client,
      '198.51.100.' || (user_id % 4) AS server,
      CAST(40000 + user_id % 1000 AS INTEGER) AS cport,
      CASE user_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 53 END AS sport,
      event_id % 3 = 0 AS reply, event_id % 97 = 0 AS non_ip,
      CAST(floor(value) AS INTEGER) AS payload_len,
      CASE WHEN ip_proto = 6 THEN CAST(5 + event_id % 4 AS INTEGER) END AS dataofs,
      CASE WHEN ip_proto = 6 THEN CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16
        WHEN 'click' THEN 24 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 END END AS flags
    FROM (SELECT *, CASE WHEN user_id % 10 = 9 THEN 1 WHEN user_id % 3 = 2 THEN 17 ELSE 6 END AS ip_proto FROM events)
  )
)"""

KEYED = (
    PACKETS
    + """,
ends AS (
  SELECT *, CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(ip_proto AS VARCHAR) END AS protocol,
    CASE WHEN ip_proto IN (6, 17) THEN src_port ELSE 0 END AS sp,
    CASE WHEN ip_proto IN (6, 17) THEN dst_port ELSE 0 END AS dp
  FROM packets WHERE src_ip IS NOT NULL
),
keyed AS (
  SELECT *, (src_ip, sp) <= (dst_ip, dp) AS src_first,
    CASE WHEN (src_ip, sp) <= (dst_ip, dp) THEN src_ip ELSE dst_ip END AS lo_ip,
    CASE WHEN (src_ip, sp) <= (dst_ip, dp) THEN sp ELSE dp END AS lo_port,
    CASE WHEN (src_ip, sp) <= (dst_ip, dp) THEN dst_ip ELSE src_ip END AS hi_ip,
    CASE WHEN (src_ip, sp) <= (dst_ip, dp) THEN dp ELSE sp END AS hi_port,
    concat_ws('|', capture_id, protocol, least(src_ip || ':' || sp, dst_ip || ':' || dp),
      greatest(src_ip || ':' || sp, dst_ip || ':' || dp)) AS k
  FROM ends
)"""
)

FLOWED = (
    KEYED
    + """,
times AS (SELECT DISTINCT k, ts_us FROM keyed),
succ AS (
  SELECT k, ts_us, min(ts_us) OVER (PARTITION BY k ORDER BY ts_us
    RANGE BETWEEN 120000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM times
),
chain AS (
  SELECT k, min(ts_us) AS s FROM times GROUP BY k
  UNION ALL
  SELECT c.k, succ.nxt FROM chain c JOIN succ ON succ.k = c.k AND succ.ts_us = c.s
  WHERE succ.nxt IS NOT NULL
),
flowed AS (
  SELECT p.*, c.s AS flow_start_us FROM keyed p ASOF JOIN chain c ON p.k = c.k AND p.ts_us >= c.s
),
heads AS (
  SELECT k, flow_start_us, src_ip AS f_ip, sp AS f_port, payload_len AS f_payload FROM (
    SELECT *, row_number() OVER (PARTITION BY k, flow_start_us ORDER BY ts_us, packet_id) AS rn FROM flowed
  ) WHERE rn = 1
),
marked AS (
  SELECT p.*, h.f_ip, h.f_port, h.f_payload,
    (p.src_ip = h.f_ip AND p.sp = h.f_port) AS fwd,
    ts_us - lag(ts_us) OVER (PARTITION BY k, flow_start_us ORDER BY ts_us, packet_id) AS gap,
    CASE ip_proto WHEN 6 THEN coalesce(nullif(tcp_dataofs, 0), 5) * 4 WHEN 17 THEN 8 ELSE ip_ihl * 4 END AS hdr
  FROM flowed p JOIN heads h USING (k, flow_start_us)
),
periods AS (
  SELECT k, flow_start_us, pid, max(ts_us) - min(ts_us) AS span,
    lead(pid) OVER (PARTITION BY k, flow_start_us ORDER BY pid) IS NOT NULL AS closed
  FROM (SELECT *, sum(CASE WHEN gap > 5000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY k, flow_start_us ORDER BY ts_us, packet_id) AS pid FROM marked)
  GROUP BY k, flow_start_us, pid
),
activity AS (
  SELECT k, flow_start_us, coalesce(avg(span) FILTER (WHERE closed AND span > 0), 0.0) AS active_time
  FROM periods GROUP BY k, flow_start_us
),
agg AS (
  SELECT capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port, k, flow_start_us,
    min(packet_id) AS first_packet_id, any_value(f_ip) AS forward_ip, any_value(f_port) AS forward_port,
    CAST(max(ts_us) - min(ts_us) AS DOUBLE) AS dur, count(*) FILTER (WHERE fwd) AS nf,
    count(*) FILTER (WHERE NOT fwd) AS nb, coalesce(sum(payload_len) FILTER (WHERE fwd), 0)::DOUBLE AS bf,
    coalesce(sum(payload_len) FILTER (WHERE NOT fwd), 0)::DOUBLE AS bb, any_value(f_payload) AS fp,
    sum(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS syn_count,
    sum(CASE WHEN tcp_flags & 16 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS ack_count,
    sum(CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS rst_count,
    sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS fin_count,
    coalesce(avg(gap) FILTER (WHERE gap > 5000000), 0.0) AS idle_time, sum(hdr)::DOUBLE AS header_length,
    (max(ts_us) FILTER (WHERE fwd) - min(ts_us) FILTER (WHERE fwd))::DOUBLE AS span_f,
    (max(ts_us) FILTER (WHERE NOT fwd) - min(ts_us) FILTER (WHERE NOT fwd))::DOUBLE AS span_b
  FROM marked GROUP BY ALL
),
flows AS (
  SELECT capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port, a.k AS k, a.flow_start_us AS flow_start_us,
    first_packet_id, forward_ip, forward_port,
    dur AS flow_duration, nf::DOUBLE AS total_fwd_packets, nb::DOUBLE AS total_bwd_packets,
    CASE WHEN nf > 0 THEN bf / nf ELSE 0.0 END AS fwd_packet_length,
    CASE WHEN nb > 0 THEN bb / nb ELSE 0.0 END AS bwd_packet_length,
    bf + bb AS flow_bytes, (nf + nb)::DOUBLE AS flow_packets,
    CASE WHEN dur > 0 THEN (bf + bb) / (dur / 1e6) ELSE 0.0 END AS flow_rate,
    CASE WHEN dur > 0 THEN (nf + nb) / (dur / 1e6) ELSE 0.0 END AS packet_rate,
    (bf + bb + fp) / (nf + nb) AS avg_packet_size, syn_count, ack_count, rst_count, fin_count,
    active_time::DOUBLE AS active_time, idle_time::DOUBLE AS idle_time, header_length,
    CASE WHEN nf > 0 THEN (nb // nf)::DOUBLE ELSE 0.0 END AS down_up_ratio,
    CASE WHEN nf > 1 THEN span_f / (nf - 1) ELSE 0.0 END AS fwd_iat_mean,
    CASE WHEN nb > 1 THEN span_b / (nb - 1) ELSE 0.0 END AS bwd_iat_mean
  FROM agg a JOIN activity b ON a.k = b.k AND a.flow_start_us = b.flow_start_us
)"""
)

FLOW_COLUMNS = "capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port, flow_start_us"

SQL: dict[str, str] = {}


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


SQL["flow_keys"] = _with(
    KEYED,
    "SELECT packet_id, capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port, src_first AS from_lo FROM keyed",
)
SQL["packet_measures"] = _with(
    PACKETS,
    """SELECT packet_id, CAST(coalesce(payload_len, 0) AS BIGINT) AS payload_bytes,
      CAST(CASE WHEN src_ip IS NULL THEN 0 WHEN ip_proto = 6 THEN tcp_dataofs * 4
        WHEN ip_proto = 17 THEN 8 ELSE ip_ihl * 4 END AS BIGINT) AS header_bytes,
      CASE WHEN tcp_flags & 2 = 2 THEN 1 ELSE 0 END AS syn, CASE WHEN tcp_flags & 16 = 16 THEN 1 ELSE 0 END AS ack,
      CASE WHEN tcp_flags & 4 = 4 THEN 1 ELSE 0 END AS rst, CASE WHEN tcp_flags & 1 = 1 THEN 1 ELSE 0 END AS fin
    FROM packets""",
)
SQL["flow_assignment"] = _with(FLOWED, f"SELECT packet_id, {FLOW_COLUMNS} FROM flowed")
SQL["flow_features"] = _with(FLOWED, f"SELECT {FLOW_COLUMNS}, {F20} FROM flows")
SQL["active_idle"] = _with(FLOWED, f"SELECT {FLOW_COLUMNS}, active_time, idle_time FROM flows")
SQL["flow_groups"] = _with(
    FLOWED,
    f"""SELECT {FLOW_COLUMNS}, packet_id, f_ip AS forward_ip, f_port AS forward_port,
      row_number() OVER (PARTITION BY k, flow_start_us ORDER BY ts_us, packet_id) AS packet_index FROM marked""",
)
_NUMBERED = """,
seen AS (SELECT k, min(packet_id) AS k_first FROM flowed GROUP BY k)"""
SQL["packet_details"] = _with(
    FLOWED + _NUMBERED + """,
numbered AS (
  SELECT f.k AS k, f.flow_start_us AS flow_start_us,
    row_number() OVER (PARTITION BY capture_id ORDER BY k_first, flow_start_us) AS flow_seq
  FROM flows f JOIN seen USING (k) WHERE total_fwd_packets + total_bwd_packets > 1
)""",
    """SELECT capture_id, flow_seq, packet_id, ts_us,
      row_number() OVER (PARTITION BY k, flow_start_us ORDER BY ts_us, packet_id) AS packet_index,
      CASE WHEN fwd THEN 'FORWARD' ELSE 'BACKWARD' END AS direction,
      CAST(payload_len AS BIGINT) AS payload,
      CAST(20 + CASE ip_proto WHEN 6 THEN tcp_dataofs * 4 WHEN 17 THEN 8 ELSE 0 END AS BIGINT) AS header,
      CASE WHEN ip_proto = 17 THEN 'UDP' WHEN ip_proto <> 6 THEN 'OTHER'
        ELSE CASE tcp_flags WHEN 2 THEN 'S' WHEN 16 THEN 'A' WHEN 24 THEN 'PA' WHEN 17 THEN 'FA' WHEN 4 THEN 'R' END END AS flags,
      src_ip || CASE WHEN ip_proto IN (6, 17) THEN ':' || src_port ELSE '' END AS source,
      dst_ip || CASE WHEN ip_proto IN (6, 17) THEN ':' || dst_port ELSE '' END AS destination
    FROM marked JOIN numbered USING (k, flow_start_us) WHERE flow_seq <= 10""",
)
SQL["eligible_flows"] = _with(
    FLOWED,
    f"SELECT {FLOW_COLUMNS}, total_fwd_packets, total_bwd_packets FROM flows WHERE flow_packets > 1",
)
SQL["eligibility_counts"] = _with(
    FLOWED,
    """SELECT capture_id, count(*) AS flows, count(*) FILTER (WHERE flow_packets > 1) AS eligible,
      count(*) FILTER (WHERE flow_packets <= 1) AS excluded FROM flows GROUP BY capture_id""",
)
SQL["export_flows"] = _with(
    FLOWED + _NUMBERED,
    f"""SELECT capture_id, 'flow-' || lpad(CAST(row_number() OVER (PARTITION BY capture_id
        ORDER BY k_first, flow_start_us) - 1 AS VARCHAR), 5, '0') AS flow_id, {F20}, '' AS label
      FROM flows JOIN seen USING (k)""",
)

_CAPTURE_FEATURES = """
    greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) AS flow_duration,
    count(*) FILTER (WHERE src_ip <= dst_ip)::DOUBLE AS total_fwd_packets,
    count(*) FILTER (WHERE src_ip > dst_ip)::DOUBLE AS total_bwd_packets,
    coalesce(sum(frame_len) FILTER (WHERE src_ip <= dst_ip), 0)::DOUBLE AS fwd_packet_length,
    coalesce(sum(frame_len) FILTER (WHERE src_ip > dst_ip), 0)::DOUBLE AS bwd_packet_length,
    sum(frame_len)::DOUBLE AS flow_bytes, count(*)::DOUBLE AS flow_packets,
    sum(frame_len)::DOUBLE / greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) AS flow_rate,
    count(*) / greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) AS packet_rate,
    sum(frame_len)::DOUBLE / count(*) AS avg_packet_size,
    count(*) FILTER (WHERE tcp_flags & 2 <> 0)::DOUBLE AS syn_count,
    count(*) FILTER (WHERE tcp_flags & 16 <> 0)::DOUBLE AS ack_count,
    count(*) FILTER (WHERE tcp_flags & 4 <> 0)::DOUBLE AS rst_count,
    count(*) FILTER (WHERE tcp_flags & 1 <> 0)::DOUBLE AS fin_count,
    greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) AS active_time, 0.0::DOUBLE AS idle_time,
    (count(*) * 20)::DOUBLE AS header_length,
    coalesce(count(*) FILTER (WHERE src_ip > dst_ip) / nullif(count(*) FILTER (WHERE src_ip <= dst_ip), 0)::DOUBLE, 0.0) AS down_up_ratio,
    CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) / 1e6 / (count(*) - 1) ELSE 0.0 END AS fwd_iat_mean,
    0.0::DOUBLE AS bwd_iat_mean"""
SQL["capture_features"] = _with(
    PACKETS, f"SELECT capture_id, {_CAPTURE_FEATURES} FROM packets GROUP BY capture_id"
)
SQL["capture_stats"] = _with(
    PACKETS,
    """SELECT capture_id, count(*) AS packets, (max(ts_us) - min(ts_us)) / 1e6 AS duration_s
    FROM packets GROUP BY capture_id""",
)
_WINDOWED = f"""SELECT ts_us // 8000000 * 8000000 AS window_start_us, ts_us // 8000000 * 8000000 + 8000000 AS window_end_us,
      capture_id, {_CAPTURE_FEATURES} FROM packets GROUP BY ALL"""
SQL["batch_capture_windows"] = _with(PACKETS, _WINDOWED)
SQL["stream_capture_windows"] = _with(
    PACKETS + f", windowed AS ({_WINDOWED})",
    "SELECT * FROM windowed",
)
SQL["batch_window_verdicts"] = _with(
    KEYED
    + """,
win AS (
  SELECT ts_us // 8000000 AS w, capture_id, count(*) AS packet_count,
    (max(ts_us) - min(ts_us)) / 1e6 AS duration
  FROM packets GROUP BY ALL
),
judged AS (
  SELECT *, CAST(risk > 0.5 AS INTEGER) AS attack FROM (
    SELECT ts_us // 8000000 AS w, capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port,
      min(packet_id) AS seq,
      sum(CASE WHEN ip_proto = 6 AND tcp_flags & 2 > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*) AS risk
    FROM keyed GROUP BY ALL HAVING count(*) > 1)
),
rolled AS (
  SELECT w, capture_id, max(attack) AS prediction, max(risk) AS attack_probability,
    arg_min(greatest(risk, 1 - risk), (-risk, seq)) AS confidence, count(*) AS flows
  FROM judged GROUP BY w, capture_id
)""",
    """SELECT w * 8000000 AS window_start_us, (w + 1) * 8000000 AS window_end_us, capture_id,
      coalesce(prediction, 0) AS prediction, coalesce(confidence, 0.0) AS confidence,
      coalesce(attack_probability, 0.0) AS attack_probability,
      CASE WHEN flows IS NULL THEN 'LOW'
        WHEN prediction = 1 THEN CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM'
          ELSE 'SUSPICIOUS' END
        WHEN confidence < 0.75 THEN 'SUSPICIOUS' ELSE 'LOW' END AS severity,
      packet_count, duration, coalesce(flows, 0) AS flows
    FROM win LEFT JOIN rolled USING (w, capture_id)""",
)
SQL["stream_window_verdicts"] = SQL["batch_window_verdicts"]
SQL["stream_flow_tracker"] = _with(
    FLOWED,
    f"SELECT {FLOW_COLUMNS}, {F20} FROM flows",
)
_WINDOWS = """,
span AS (SELECT capture_id, min(ts_us) AS lo, (max(ts_us) - min(ts_us)) // 10 AS width FROM packets GROUP BY capture_id),
label_windows AS (
  SELECT capture_id || '-' || i AS scenario, CAST((i + CAST(substr(capture_id, 5) AS INTEGER)) % 2 AS INTEGER) AS label,
    round((lo + i * width) / 1e6, 3) AS start_epoch,
    round((lo + (i + 1) * width - 1) / 1e6, 3) AS end_epoch, capture_id || '.pcap' AS pcap
  FROM span, range(10) t(i)
)"""
SQL["label_window_rows"] = _with(PACKETS + _WINDOWS, "SELECT * FROM label_windows")
SQL["label_flows_by_window"] = _with(
    FLOWED + _WINDOWS,
    f"""SELECT {FLOW_COLUMNS}, scenario, label AS window_label FROM flows LEFT JOIN label_windows
    ON pcap = capture_id || '.pcap' AND flow_start_us >= CAST(round(start_epoch * 1e6) AS BIGINT) AND flow_start_us <= CAST(round(end_epoch * 1e6) AS BIGINT)""",
)
_WIDE = _WINDOWS.replace("span", "wide_span").replace("label_windows", "wide_windows")
_WIDE = _WIDE.replace("// 10", "// 7").replace("range(10)", "range(7)")
SQL["label_flows_once"] = _with(
    FLOWED + _WINDOWS + _WIDE,
    f"""SELECT {FLOW_COLUMNS}, CASE WHEN count(label) = 1 THEN min(scenario) END AS scenario,
      CASE WHEN min(label) = max(label) THEN min(label) END AS window_label, count(label) AS windows,
      coalesce(min(label) <> max(label), false) AS conflict
    FROM flows LEFT JOIN (
      SELECT * FROM label_windows UNION ALL SELECT * REPLACE ('wide-' || scenario AS scenario) FROM wide_windows
    ) ON pcap = capture_id || '.pcap' AND flow_start_us BETWEEN CAST(round(start_epoch * 1e6) AS BIGINT)
      AND CAST(round(end_epoch * 1e6) AS BIGINT)
    GROUP BY ALL""",
)
SQL["pcap_ingest"] = _with(
    PACKETS,
    """SELECT capture_id, ts_us, src_ip, dst_ip, CASE WHEN src_ip IS NULL THEN NULL ELSE ip_proto END AS ip_proto,
      CASE WHEN src_ip IS NOT NULL THEN ip_ihl END AS ip_ihl, CASE WHEN src_ip IS NOT NULL THEN src_port END AS src_port,
      CASE WHEN src_ip IS NOT NULL THEN dst_port END AS dst_port,
      CASE WHEN src_ip IS NOT NULL THEN tcp_dataofs END AS tcp_dataofs,
      CASE WHEN src_ip IS NOT NULL THEN tcp_flags END AS tcp_flags,
      CASE WHEN src_ip IS NOT NULL THEN payload_len END AS payload_len, frame_len FROM packets""",
)

SQL["pcap_stream"] = SQL["pcap_ingest"]

MEASURED = """
measured AS (
  SELECT *, x * 10 AS dur, q * (x % 1500) AS fl, bw * ((k * 7) % 1460) AS bl FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_key,
      CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' THEN 'PortScan'
        WHEN l_linestatus = 'F' THEN 'Bot' ELSE 'Web Attack ? XSS' END AS source_label,
      'day' || (l_suppkey % 5) AS source_file, CAST(l_quantity AS BIGINT) AS q,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS x, l_partkey AS k, l_suppkey AS m,
      CAST(l_linenumber AS BIGINT) AS n, l_orderkey AS o, l_partkey % 40 AS bw
    FROM lineitem)
)"""

_VALUES = {
    "flow_duration": "dur",
    "total_fwd_packets": "q",
    "total_bwd_packets": "bw",
    "fwd_packet_length": "x % 1500",
    "bwd_packet_length": "(k * 7) % 1460",
    "flow_bytes": "fl + bl",
    "flow_packets": "q + bw",
    "flow_rate": "(fl + bl) * 1e6 / dur",
    "packet_rate": "(q + bw) * 1e6 / dur",
    "avg_packet_size": "(fl + bl) / CAST(q + bw AS DOUBLE)",
    "syn_count": "CASE WHEN n = 1 THEN 1 ELSE 0 END",
    "ack_count": "k % 2",
    "rst_count": "CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END",
    "fin_count": "CASE WHEN m % 3 = 0 THEN 1 ELSE 0 END",
    "active_time": "(x % 5000) * 100",
    "idle_time": "CASE WHEN k % 4 = 0 THEN 5000001 + x ELSE 0 END",
    "header_length": "(q + bw) * 20",
    "down_up_ratio": "bw // q",
    "fwd_iat_mean": "dur // q",
    "bwd_iat_mean": "dur // greatest(bw, 1)",
}
_FAULTY = {
    **_VALUES,
    "flow_duration": "CASE WHEN o % 71 = 0 THEN -dur ELSE dur END",
    "flow_rate": "CASE WHEN o % 50 = 0 AND n = 1 THEN 'Infinity'::DOUBLE ELSE (fl + bl) * 1e6 / dur END",
    "packet_rate": "CASE WHEN o % 53 = 0 THEN NULL ELSE (q + bw) * 1e6 / dur END",
}


def _typed(values):
    return ", ".join(f"CAST({e} AS DOUBLE) AS {f}" for f, e in values.items())


RAW = (
    MEASURED
    + f""",
raw AS (
  SELECT row_key, source_label, source_file, copy, k, m, n, o, q, bw, fl, bl, {_typed(_FAULTY)}
  FROM measured JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR o % 100 = 1
),
clean AS (
  SELECT * FROM raw WHERE packet_rate IS NOT NULL AND NOT isinf(flow_rate) AND flow_duration >= 0
)"""
)
SCORED = (
    MEASURED
    + f""",
scored AS (
  SELECT *, CAST(attack_probability > 0.5 AS INTEGER) AS prediction,
    CAST(candidate_probability > 0.5 AS INTEGER) AS candidate_prediction,
    CASE WHEN binary_label = 0 AND attack_probability > 0.5 THEN 'FALSE_POSITIVE'
      WHEN binary_label = 1 AND NOT attack_probability > 0.5 THEN 'FALSE_NEGATIVE' ELSE 'CORRECT' END AS error_type
  FROM (
    SELECT *, 0.3::DOUBLE * binary_label + 0.7::DOUBLE * (((o * 7919 + n * 104729) % 1000) / 1000.0::DOUBLE) AS attack_probability,
      0.5::DOUBLE * binary_label + 0.5::DOUBLE * (((o * 31 + k * 17) % 1000) / 1000.0::DOUBLE) AS candidate_probability
    FROM (SELECT row_key, source_label, source_file, 'cap-' || (o % 500) AS capture_id, m % 6 AS run, k, m, o, n,
        CAST(source_label <> 'BENIGN' AS INTEGER) AS binary_label, {_typed(_VALUES)} FROM measured))
)"""
)
_FLOAT20 = ", ".join(f"CAST({f} AS FLOAT) AS {f}" for f in FEATURES)
_ATTACK = "CAST(source_label <> 'BENIGN' AS TINYINT)"


def _long(source: str, ids: str, features=FEATURES) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{f}' AS feature, {f} AS value FROM {source}" for f in features
    )


def _snake(name: str) -> str:
    return name.lower().replace(" ", "_").replace("/", "_per_")


_SUM_PARTS = {
    "Total Length of Fwd Packets": "fl",
    "Total Length of Bwd Packets": "bl",
    "Fwd Header Length": "q * 20",
    "Bwd Header Length": "bw * 20",
}
_RAW_BY_NAME = {
    **{c: f for f, c in DIRECT_COLUMNS.items()},
    **_SUM_PARTS,
}
SQL["raw_flow_scan"] = _with(
    RAW,
    "SELECT "
    + ", ".join(
        f"CAST({_RAW_BY_NAME[c]} AS DOUBLE) AS {_snake(c)}" for c in RAW_COLUMNS if c != "Label"
    )
    + ", source_label AS label FROM raw",
)
SQL["prepare_canonical"] = _with(
    RAW,
    f"SELECT {_FLOAT20}, label FROM (SELECT DISTINCT {F20}, {_ATTACK} AS label FROM clean)",
)
SQL["scan_flow_csv"] = SQL["prepare_canonical"]
SQL["canonical_scan"] = _with(
    RAW,
    f"SELECT {F20}, CAST({_ATTACK} AS INTEGER) AS label FROM raw WHERE packet_rate IS NOT NULL AND NOT isinf(flow_rate)",
)
_DEDUP = f""",
firsts AS (
  SELECT {F20}, row_key, source_label, source_file, {_ATTACK} AS binary_label FROM clean
  QUALIFY row_number() OVER (PARTITION BY {F20}, {_ATTACK} ORDER BY source_file, row_key, source_label) = 1
)"""
SQL["provenance_dedup"] = _with(
    RAW + _DEDUP,
    f"SELECT {_FLOAT20}, binary_label, source_label, source_file, row_key FROM firsts",
)
SQL["label_normalization"] = _with(
    RAW + """,
spelled AS (
  SELECT CASE WHEN source_label = 'BENIGN' THEN CASE bw % 5 WHEN 0 THEN ' BENIGN ' WHEN 1 THEN 'Benign'
    WHEN 2 THEN 'normal' WHEN 3 THEN '0' ELSE source_label END ELSE source_label END AS source_label FROM raw
)""",
    """SELECT source_label, count(*) AS rows,
      CASE WHEN upper(trim(source_label)) = 'BENIGN' THEN 0 ELSE 1 END AS training_label,
      CASE WHEN lower(trim(source_label)) IN ('benign', 'normal', '0') THEN 0 ELSE 1 END AS evaluation_label,
      CASE WHEN trim(source_label) = 'BENIGN' THEN 0 ELSE 1 END AS exact_label,
      replace(trim(source_label), ' ? ', ' - ') AS display_label
    FROM spelled GROUP BY source_label""",
)
SQL["reproduction_multiset"] = _with(
    RAW,
    f"""SELECT CAST(0 AS BIGINT) AS only_left,
      (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT {F20}, {_ATTACK} FROM clean)) AS only_right""",
)
_CHANGED = (
    RAW
    + _DEDUP
    + f""",
built AS (SELECT row_key, {_FLOAT20}, binary_label AS label, ('0x' || substr(md5(row_key), 1, 6))::BIGINT AS h FROM firsts),
planted AS (
  SELECT *, h % 101 = 0 AS gone,
    CASE WHEN h % 97 = 0 THEN (CAST(flow_bytes + 1 AS FLOAT) <> flow_bytes)::INTEGER
      + (CAST(idle_time + 1 AS FLOAT) <> idle_time)::INTEGER ELSE 0 END AS cells
  FROM built
)"""
)
SQL["reproduction_diff"] = _with(
    _CHANGED,
    """SELECT count(*) FILTER (WHERE NOT gone) AS regenerated_rows, count(*) AS frozen_rows, CAST(0 AS BIGINT) AS only_regenerated,
      count(*) FILTER (WHERE gone) AS only_frozen, CAST(coalesce(sum(cells) FILTER (WHERE NOT gone), 0) AS BIGINT) AS differing_cells,
      count(*) FILTER (WHERE NOT gone AND cells > 0) AS differing_rows,
      count(*) FILTER (WHERE NOT gone AND h % 89 = 0) AS differing_labels, 'FAIL' AS status FROM planted""",
)
SQL["alignment_report"] = _with(
    _CHANGED,
    """SELECT count(*) FILTER (WHERE NOT gone) AS matched, CAST(0 AS BIGINT) AS only_frozen,
      count(*) FILTER (WHERE gone) AS only_provenance, count(*) FILTER (WHERE NOT gone AND cells > 0) AS feature_mismatch,
      count(*) FILTER (WHERE NOT gone AND h % 89 = 0) AS label_mismatch FROM planted""",
)
SQL["safe_numbers"] = _with(
    RAW,
    """SELECT row_key, CASE WHEN isinf(flow_rate) THEN 0.0 ELSE flow_rate END AS flow_rate,
      coalesce(packet_rate, 0.0) AS packet_rate, flow_duration FROM raw""",
)
SQL["benign_sample"] = _with(
    RAW,
    f"""SELECT row_key, {F20.replace("flow_rate", "CAST(flow_rate AS DOUBLE) AS flow_rate")} FROM (
      SELECT * FROM raw WHERE source_label = 'BENIGN' ORDER BY row_key LIMIT 40000)
    WHERE packet_rate IS NOT NULL""",
)
SQL["benign_head"] = SQL["benign_sample"].replace("LIMIT 40000", "LIMIT 5000")
_MIXED = """
mixed AS (
  SELECT order_no, quantity, price, flag, status FROM (
    SELECT l_orderkey AS order_no,
      CASE WHEN l_orderkey % 37 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS quantity,
      CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_extendedprice END AS price,
      CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status
    FROM lineitem) JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR order_no % 100 = 1
),
uniq AS (
  SELECT order_no, CASE WHEN isinf(quantity) THEN NULL ELSE quantity END AS quantity, price, flag, status
  FROM (SELECT DISTINCT * FROM mixed)
),
modes AS (SELECT (SELECT flag FROM uniq WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) AS flag_mode),
medians AS (SELECT quantile_cont(quantity, 0.5) AS q_med, quantile_cont(price, 0.5) AS p_med FROM uniq),
filled AS (
  SELECT CAST(order_no AS DOUBLE) AS order_no, coalesce(quantity, q_med) AS quantity, coalesce(price, p_med) AS price,
    coalesce(flag, flag_mode) AS flag, status FROM uniq, modes, medians
)"""
SQL["clean_impute"] = _with(_MIXED, "SELECT * FROM filled")
SQL["one_hot"] = _with(
    _MIXED,
    """SELECT order_no, quantity, price, CASE WHEN flag = 'N' THEN 1 ELSE 0 END AS flag_N,
      CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS flag_R, CASE WHEN status = 'O' THEN 1 ELSE 0 END AS status_O
    FROM mixed""",
)
SQL["category_positions"] = _with(
    _MIXED,
    """SELECT order_no, quantity, price, array_to_string(list_filter(
      [CASE flag WHEN 'N' THEN 0 WHEN 'R' THEN 1 END, CASE status WHEN 'O' THEN 2 END],
      lambda x: x IS NOT NULL), ',') AS positions FROM mixed""",
)
SQL["prepared_features"] = _with(
    _MIXED,
    """SELECT order_no, quantity, price, CASE WHEN flag = 'N' THEN 1 ELSE 0 END AS flag_N,
      CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS flag_R, CASE WHEN status = 'O' THEN 1 ELSE 0 END AS status_O
    FROM filled""",
)
SQL["dataset_profile"] = _with(
    _MIXED,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS missing, count(*) AS rows FROM mixed"
        for c, t in (
            ("order_no", "bigint"),
            ("quantity", "double"),
            ("price", "double"),
            ("flag", "string"),
            ("status", "string"),
        )
    ),
)
SQL["feature_contract_violations"] = _with(
    RAW,
    """SELECT source_file, violation, count(*) AS rows FROM (
      SELECT source_file, 'flow_rate:not_finite' AS violation FROM raw WHERE isinf(flow_rate)
      UNION ALL SELECT source_file, 'packet_rate:not_numeric' FROM raw WHERE packet_rate IS NULL
      UNION ALL SELECT source_file, 'flow_duration:negative' FROM raw WHERE flow_duration < 0) GROUP BY ALL""",
)
SQL["score_contract_violations"] = _with(
    SCORED,
    """SELECT row_key, CASE m % 7 WHEN 1 THEN 'shape' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'out_of_range'
      WHEN 4 THEN 'sum' ELSE CASE WHEN k % 11 = 0 THEN 'prediction_range' END END AS violation FROM scored""",
)
_CAPTURES = """
captures AS (
  SELECT 'cap-' || (o_orderkey % 520) AS capture_id, o_orderkey % 520 AS c, count(*) AS packet_count,
    count(*) * 0.25::DOUBLE AS capture_duration FROM orders GROUP BY ALL
)"""
SQL["capture_contract_violations"] = _with(
    _CAPTURES,
    """SELECT capture_id, CASE c % 6 WHEN 1 THEN 'packet_count_not_integer' WHEN 2 THEN 'packet_count_negative'
      WHEN 3 THEN 'duration_invalid' WHEN 4 THEN 'duration_invalid' WHEN 5 THEN 'duration_not_numeric' END AS violation
    FROM captures""",
)
_LABEL_FILE = (
    SCORED
    + """,
label_file AS (
  SELECT row_key AS flow_id, CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN 'unsure'
    WHEN k % 23 = 0 THEN 'Attack' WHEN binary_label = 1 THEN 'attack' ELSE 'benign' END AS label FROM scored
)"""
)
SQL["label_file_check"] = _with(
    _LABEL_FILE,
    """SELECT count(*) AS rows, count(*) FILTER (WHERE label = 'benign') AS benign,
      count(*) FILTER (WHERE label = 'attack') AS attack, count(*) FILTER (WHERE label = '') AS unlabelled,
      min(flow_id) FILTER (WHERE label = '') AS first_unlabelled,
      count(DISTINCT label) FILTER (WHERE label NOT IN ('', 'attack', 'benign')) AS invalid_labels,
      min(label) FILTER (WHERE label NOT IN ('', 'attack', 'benign')) AS first_invalid,
      CASE WHEN count(*) FILTER (WHERE label NOT IN ('attack', 'benign')) > 0 OR count(*) = 0 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM label_file""",
)
SQL["invalid_labels"] = _with(
    _LABEL_FILE,
    "SELECT label, count(*) AS rows FROM label_file WHERE label NOT IN ('', 'attack', 'benign') GROUP BY label",
)


def _severity(p: str, c: str) -> str:
    return (
        f"CASE WHEN {p} = 1 AND {c} >= 0.8 THEN 'HIGH' WHEN {p} = 1 AND {c} >= 0.5 THEN 'MEDIUM' "
        f"WHEN {p} = 1 OR {c} < 0.75 THEN 'SUSPICIOUS' ELSE 'LOW' END"
    )


SQL["severity"] = _with(
    SCORED,
    f"""SELECT row_key, prediction, {_severity("prediction", "greatest(attack_probability, 1.0 - attack_probability)")} AS severity
    FROM scored""",
)
_VERDICTS = (
    SCORED
    + ","
    + _CAPTURES
    + f""",
picked AS (
  SELECT capture_id, attack_probability, greatest(attack_probability, 1.0::DOUBLE - attack_probability) AS confidence
  FROM scored QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY attack_probability DESC, row_key) = 1
),
rolled AS (SELECT capture_id, max(prediction) AS prediction, count(*) AS flows FROM scored GROUP BY capture_id),
verdicts AS (
  SELECT c.capture_id AS capture_id, c, coalesce(r.prediction, 0) AS prediction, coalesce(confidence, 0.0) AS confidence,
    coalesce(attack_probability, 0.0) AS attack_probability,
    CASE WHEN r.flows IS NULL THEN 'LOW' ELSE {_severity("r.prediction", "confidence")} END AS severity,
    packet_count, capture_duration AS duration, coalesce(flows, 0) AS flows
  FROM captures c LEFT JOIN rolled r ON c.capture_id = r.capture_id LEFT JOIN picked p ON c.capture_id = p.capture_id
)"""
)
SQL["capture_verdict"] = _with(_VERDICTS, "SELECT * EXCLUDE (c) FROM verdicts")
SQL["display_verdict"] = _with(
    _VERDICTS,
    """SELECT capture_id,
      CASE WHEN prediction = 1 THEN 'ATTACK' WHEN severity = 'SUSPICIOUS' THEN 'UNCERTAIN' ELSE 'NORMAL' END AS verdict,
      CASE WHEN prediction = 1 THEN 'ATTACK DETECTED' WHEN severity = 'SUSPICIOUS' THEN 'SUSPICIOUS TRAFFIC' ELSE 'NORMAL TRAFFIC' END AS result_text,
      CASE WHEN prediction = 1 THEN 'Suspicious network traffic detected!'
        WHEN severity = 'SUSPICIOUS' THEN 'Traffic may require further investigation.'
        ELSE 'Network traffic appears normal.' END AS warning_text,
      printf('%.2f%%', confidence * 100) AS confidence_text, printf('%.2f%%', attack_probability * 100) AS risk_text
    FROM verdicts""",
)
_LOG = """strftime(make_timestamp(1700000000000000 + c * 60000000), '%Y-%m-%d %H:%M:%S') AS timestamp, prediction,
      round(confidence * 100, 2) AS confidence, severity, packet_count AS packets_captured, round(duration, 2) AS capture_duration"""
SQL["detection_log_rows"] = _with(_VERDICTS, f"SELECT {_LOG} FROM verdicts")
SQL["stream_detection_log"] = SQL["detection_log_rows"]
SQL["recent_history"] = _with(
    _VERDICTS,
    f"""SELECT timestamp, CASE WHEN prediction = 1 THEN 'ATTACK' ELSE 'NORMAL' END AS verdict,
      confidence || '%' AS confidence_text, severity, packets_captured,
      capture_duration || 's' AS duration_text
    FROM (SELECT c, {_LOG} FROM verdicts) ORDER BY c DESC LIMIT 10""",
)
_PAIRS = "pairs AS (SELECT toxic AS label, 1 - quality AS prediction FROM labels)"


def _count4(source, y, p, by=""):
    return (
        f"counts AS (SELECT {by} count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp, "
        f"count(*) FILTER (WHERE {y} = 0 AND {p} <> 0) AS fp, count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn, "
        f"count(*) FILTER (WHERE {y} = 1 AND {p} <> 1) AS fn FROM {source} {'GROUP BY ALL' if by else ''})"
    )


def _metric_rows(by=""):
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0.0 END AS f1
    FROM (SELECT {by} tp, fp, tn, fn, tp + fp + tn + fn AS samples,
      coalesce(round((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 4), 0.0) AS accuracy,
      coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 4), 0.0) AS precision,
      coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 4), 0.0) AS recall,
      coalesce(round(fp / nullif(fp + tn, 0)::DOUBLE, 4), 0.0) AS false_positive_rate FROM counts)"""


SQL["confusion_counts"] = _with(f"{_PAIRS}, {_count4('pairs', 'label', 'prediction')}", "SELECT * FROM counts")
SQL["binary_metrics"] = _with(f"{_PAIRS}, {_count4('pairs', 'label', 'prediction')}", _metric_rows())
SQL["scenario_metrics"] = _with(
    f"{SCORED}, {_count4('scored', 'binary_label', 'prediction', 'run,')}", _metric_rows("run,")
)
_HELDOUT = f"{SCORED}, {_count4('scored', 'binary_label', 'prediction')}"
_HELDOUT_ROW = """SELECT *, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision,
      tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM counts"""
SQL["heldout_metrics"] = _with(_HELDOUT, _HELDOUT_ROW)
SQL["metrics_long"] = _with(
    f"{_HELDOUT}, m AS ({_HELDOUT_ROW})",
    " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {c} AS score, {c} * 100 AS percentage FROM m"
        for name, c in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1-Score", "f1"))
    ),
)
SQL["classification_report"] = _with(
    SCORED + """,
classes AS (
  SELECT c, count(*) FILTER (WHERE prediction = c AND binary_label = c) / count(*) FILTER (WHERE prediction = c)::DOUBLE AS p,
    count(*) FILTER (WHERE prediction = c AND binary_label = c) / count(*) FILTER (WHERE binary_label = c)::DOUBLE AS r,
    count(*) FILTER (WHERE binary_label = c) AS s FROM scored, (VALUES (0), (1)) v(c) GROUP BY c
),
parts AS (SELECT c, p, r, 2 * p * r / (p + r) AS f, s FROM classes),
total AS (SELECT count(*) AS n, count(*) FILTER (WHERE prediction = binary_label) / count(*)::DOUBLE AS acc FROM scored)""",
    """SELECT class_name, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(s AS BIGINT) AS support FROM (
      SELECT CASE c WHEN 0 THEN 'Benign' ELSE 'Attack' END AS class_name, p, r, f, s FROM parts
      UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM total
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM parts
      UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM parts)""",
)
SQL["two_model_fpr"] = _with(
    SCORED,
    """SELECT count(*) AS flows, CAST(sum(prediction) AS BIGINT) AS frozen_flagged,
      CAST(sum(candidate_prediction) AS BIGINT) AS candidate_flagged, round(avg(prediction), 4) AS frozen_fpr,
      round(avg(candidate_prediction), 4) AS candidate_fpr FROM scored WHERE binary_label = 0""",
)
SQL["two_model_metrics"] = _with(
    SCORED
    + """,
votes AS (SELECT 'frozen' AS model, binary_label AS y, prediction AS p FROM scored
  UNION ALL SELECT 'candidate', binary_label, candidate_prediction FROM scored),"""
    + _count4("votes", "y", "p", "model,"),
    _metric_rows("model,"),
)
_SCENARIOS = (
    FLOWED
    + """,
judged AS (
  SELECT capture_id AS scenario, CAST(CAST(substr(capture_id, 5) AS INTEGER) % 2 AS INTEGER) AS label,
    CAST(syn_count > 0 AS INTEGER) AS prediction FROM flows
)"""
)
SQL["scenario_report"] = _with(
    _SCENARIOS + ", seen_packets AS (SELECT capture_id AS scenario, count(*) AS packets FROM packets GROUP BY ALL)",
    """SELECT scenario, CASE label WHEN 1 THEN 'attack' ELSE 'benign' END AS label, any_value(packets) AS packets,
      count(*) AS flows, CAST(sum(prediction) AS BIGINT) AS predicted_attack
    FROM judged JOIN seen_packets USING (scenario) GROUP BY ALL""",
)
SQL["scenario_overall"] = _with(
    f"{_SCENARIOS}, {_count4('judged', 'label', 'prediction')}", _metric_rows()
)
SQL["labelled_prediction_metrics"] = _with(
    f"""{SCORED},
paired AS (
  SELECT CASE WHEN k % 23 = 0 THEN NULL ELSE binary_label END AS label, prediction FROM scored
  WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AND k % 29 <> 0
), {_count4('paired', 'label', 'prediction')}""",
    _metric_rows(),
)
SQL["error_types"] = _with(
    SCORED,
    """SELECT row_key, error_type, CASE WHEN k % 50 = 0 THEN 'UNKNOWN' ELSE error_type END AS strict_error_type FROM scored""",
)
_SLICED = ["flow_duration", "flow_packets", "flow_bytes", "packet_rate", "active_time", "idle_time"]
SQL["error_slices"] = _with(
    SCORED + f""",
long AS ({_long("scored", "row_key, binary_label AS y, prediction AS p", _SLICED)}),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY feature ORDER BY value, row_key) - 1) / (count(*) OVER (PARTITION BY feature) - 1)::DOUBLE AS pos
  FROM long
)""",
    """SELECT feature, CASE WHEN pos <= 0.25 THEN 'Q1' WHEN pos <= 0.5 THEN 'Q2' WHEN pos <= 0.75 THEN 'Q3' ELSE 'Q4' END AS slice,
      count(*) AS rows, count(*) FILTER (WHERE y = 1) AS attacks, count(*) FILTER (WHERE y = 0 AND p = 1) AS false_positives,
      count(*) FILTER (WHERE y = 1 AND p = 0) AS false_negatives,
      count(*) FILTER (WHERE y = 0 AND p = 1) / nullif(count(*) FILTER (WHERE y = 0), 0)::DOUBLE AS benign_fpr,
      count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE AS attack_recall
    FROM ranked GROUP BY ALL""",
)
SQL["errors_by_source"] = _with(
    SCORED + ", bad AS (SELECT * FROM scored WHERE error_type <> 'CORRECT')",
    """SELECT 'type' AS view, error_type, NULL AS source_label, NULL AS source_file, count(*) AS errors FROM bad GROUP BY error_type
    UNION ALL SELECT 'label', error_type, source_label, NULL, count(*) FROM bad GROUP BY ALL
    UNION ALL SELECT 'file', error_type, NULL, source_file, count(*) FROM bad GROUP BY ALL""",
)
SQL["recall_by_attack"] = _with(
    SCORED,
    """SELECT source_label, count(*) AS rows, count(*) FILTER (WHERE prediction = 0) AS false_negatives,
      1.0 - count(*) FILTER (WHERE prediction = 0) / count(*)::DOUBLE AS recall
    FROM scored WHERE binary_label = 1 GROUP BY source_label""",
)
_WEAK = SCORED + ", weak AS (SELECT * FROM scored WHERE source_label <> 'BENIGN')"
SQL["weak_families"] = _with(
    _WEAK, "SELECT source_label, error_type, count(*) AS rows FROM weak GROUP BY ALL"
)
_PLACE = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
SQL["family_feature_contrast"] = _with(
    _WEAK + f""",
long AS ({_long("weak", "source_label, error_type")}),
med AS (
  SELECT source_label, feature, quantile_cont(value, 0.5) FILTER (WHERE error_type = 'FALSE_NEGATIVE') AS a,
    quantile_cont(value, 0.5) FILTER (WHERE error_type = 'CORRECT') AS b FROM long GROUP BY ALL
),
contrast AS (
  SELECT *, CASE WHEN b <> 0 THEN a / b END AS ratio, CASE WHEN a > 0 AND b > 0 THEN abs(log2(a / b)) END AS c FROM med
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_label ORDER BY c DESC NULLS LAST, list_position({_PLACE}, feature)) AS rank
  FROM contrast
)""",
    """SELECT source_label, feature, round(a, 6) AS fn_median, round(b, 6) AS correct_median, round(ratio, 6) AS median_ratio,
      round(c, 6) AS abs_log2_ratio, rank FROM placed WHERE rank <= 10""",
)
SQL["fn_feature_quantiles"] = _with(
    _WEAK + f""",
long AS ({_long("weak", "source_label, error_type")})""",
    """SELECT source_label, feature, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25,
      round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95
    FROM long WHERE error_type = 'FALSE_NEGATIVE' GROUP BY ALL""",
)
SQL["source_context"] = _with(
    _WEAK,
    """SELECT source_label, source_file, count(*) AS attack_rows, count(*) FILTER (WHERE prediction = 0) AS fn,
      count(*) FILTER (WHERE prediction = 1) AS correct, count(*) FILTER (WHERE prediction = 1) / count(*)::DOUBLE AS recall,
      count(*) FILTER (WHERE prediction = 0) / count(*)::DOUBLE AS fn_rate,
      round(quantile_cont(attack_probability, 0.5) FILTER (WHERE prediction = 0), 9) AS fn_prob_median,
      round(quantile_cont(attack_probability, 0.5) FILTER (WHERE prediction = 1), 9) AS correct_prob_median
    FROM weak GROUP BY ALL""",
)
SQL["fn_concentration"] = _with(
    _WEAK,
    """SELECT source_label, source_file, fn, fn / sum(fn) OVER (PARTITION BY source_label)::DOUBLE AS concentration FROM (
      SELECT source_label, source_file, count(*) AS fn FROM weak WHERE prediction = 0 GROUP BY ALL)""",
)
SQL["probability_summary"] = _with(
    _WEAK,
    """SELECT source_label, error_type, count(*) AS n, round(min(attack_probability), 9) AS min,
      round(quantile_cont(attack_probability, 0.25), 9) AS q25, round(quantile_cont(attack_probability, 0.5), 9) AS median,
      round(quantile_cont(attack_probability, 0.75), 9) AS q75, round(max(attack_probability), 9) AS max,
      round(avg(attack_probability), 9) AS mean FROM weak GROUP BY ALL""",
)
SQL["provenance_join"] = _with(
    RAW + _DEDUP + SCORED.replace(MEASURED, ""),
    """SELECT row_key, error_type, f.source_label AS source_label, f.source_file AS source_file
    FROM scored JOIN firsts f USING (row_key)""",
)
_LEAVES = [f"CAST((k // {j + 1} + {j} * m) % 17 AS INTEGER) AS t{j}" for j in range(10)]
_PROXIMITY = (
    _WEAK
    + f""",
leafed AS (SELECT row_key, source_label, error_type, attack_probability AS p, {", ".join(_LEAVES)} FROM weak),
good AS (SELECT *, row_number() OVER (ORDER BY row_key) AS rn FROM leafed WHERE error_type = 'CORRECT'),
pairs AS (
  SELECT a.row_key AS row_key, any_value(a.source_label) AS source_label, any_value(a.p) AS p,
    max(({" + ".join(f"(a.t{j} = b.t{j})::BIGINT" for j in range(10))}) * 10000000 - b.rn) AS best
  FROM leafed a JOIN good b ON a.source_label = b.source_label WHERE a.error_type = 'FALSE_NEGATIVE' GROUP BY a.row_key
),
prox AS (
  SELECT pairs.row_key AS row_key, pairs.source_label AS source_label, good.row_key AS best_key,
    ((best + rn) // 10000000) / 10.0::DOUBLE AS proximity, abs(pairs.p - good.p) AS probability_gap
  FROM pairs JOIN good ON good.rn = (10000000 - best % 10000000) % 10000000
)"""
)
SQL["leaf_proximity"] = _with(
    _PROXIMITY,
    "SELECT row_key, source_label, best_key, proximity, round(probability_gap, 9) AS probability_gap FROM prox",
)
SQL["leaf_proximity_summary"] = _with(
    _PROXIMITY,
    "SELECT source_label, count(*) AS missed, "
    + ", ".join(
        f"count(*) FILTER (WHERE proximity >= {level}) AS near_{name}"
        for level, name in ((0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90))
    )
    + ", "
    + ", ".join(
        f"round(quantile_cont({m}, {q}), 9) AS {m}_{name}"
        for m in ("proximity", "probability_gap")
        for name, q in (("min", 0.0), ("median", 0.5), ("q75", 0.75), ("max", 1.0))
    )
    + " FROM prox GROUP BY source_label",
)
SQL["distribution_summary"] = _with(
    SCORED + f", long AS ({_long('scored', '1 AS one')})",
    """SELECT feature, count(*) AS count, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std,
      avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_fraction, """
    + ", ".join(
        f"round(quantile_cont(value, {q}), 3) AS {n}"
        for n, q in (("q00", 0.0), ("q50", 0.5), ("q95", 0.95), ("q99", 0.99), ("q100", 1.0))
    )
    + " FROM long GROUP BY feature",
)
_SAMPLES = (
    FLOWED
    + f""",
sided AS (
  SELECT {F20}, CAST(split_part(CASE WHEN lo_ip LIKE '10.%' THEN lo_ip ELSE hi_ip END, '.', 4) AS INTEGER) % 2 = 0 AS ref FROM flows
),
long AS ({_long("sided", "ref")})"""
)
SQL["distribution_comparison"] = _with(
    _SAMPLES,
    "SELECT feature, "
    + ", ".join(
        f"round(quantile_cont(value, {q}) FILTER (WHERE {test}), 6) AS {side}_{n}"
        for side, test in (("train", "ref"), ("live", "NOT ref"))
        for n, q in (("median", 0.5), ("p95", 0.95))
    )
    + """, avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE ref) AS train_zero_fraction,
      avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE NOT ref) AS live_zero_fraction
    FROM long GROUP BY feature""",
)
_DRIFT = (
    _SAMPLES
    + """,
sizes AS (SELECT feature, count(*) FILTER (WHERE ref) AS n, count(*) FILTER (WHERE NOT ref) AS m,
    avg(value) FILTER (WHERE ref) AS ma, avg(value) FILTER (WHERE NOT ref) AS mb,
    sqrt((var_samp(value) FILTER (WHERE ref) + var_samp(value) FILTER (WHERE NOT ref)) / 2) AS pooled
  FROM long GROUP BY feature),
steps AS (SELECT feature, value, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS b FROM long GROUP BY ALL),
runs AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM steps
  WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(ca / n::DOUBLE - cb / m::DOUBLE)) AS d FROM runs JOIN sizes USING (feature) GROUP BY feature),
drift AS (
  SELECT feature, ma, mb, abs(ma - mb) / CASE WHEN coalesce(pooled, 0) = 0 THEN 1.0 ELSE pooled END AS sd, d,
    d * sqrt(n::DOUBLE * m / (n + m)) AS z,
    CASE WHEN d < 0.2 THEN 'small' WHEN d < 0.5 THEN 'moderate' ELSE 'large' END AS verdict
  FROM sizes JOIN ks USING (feature)
)"""
)
SQL["feature_drift"] = _with(
    _DRIFT,
    """SELECT feature, round(ma, 4) AS reference_mean, round(mb, 4) AS live_mean, round(sd, 3) AS standardised_difference,
      round(d, 3) AS ks_statistic, round(CASE WHEN z < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0,
        2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0::DOUBLE * i * i * z * z)) FROM range(1, 101) t(i)))) END, 4) AS ks_p_value,
      verdict FROM drift""",
)
SQL["drift_verdict_lists"] = _with(
    _DRIFT,
    "SELECT verdict, count(*) AS features, string_agg(feature, ',' ORDER BY feature) AS names FROM drift GROUP BY verdict",
)
SQL["sample_size_class"] = _with(
    FLOWED,
    """SELECT capture_id, count(*) AS flows, CASE WHEN count(*) < 30 THEN 'INSUFFICIENT' WHEN count(*) < 100 THEN 'LIMITED_SAMPLE'
      ELSE 'ADEQUATE_FOR_DESCRIPTIVE_COMPARISON' END AS sample_class FROM flows WHERE flow_packets > 1 GROUP BY capture_id""",
)
SQL["stratified_split"] = _with(
    SCORED,
    """SELECT row_key, binary_label, CASE WHEN row_number() OVER (PARTITION BY binary_label ORDER BY md5(row_key || '#42'), row_key)
      <= round(count(*) OVER (PARTITION BY binary_label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM scored""",
)
SQL["run_split"] = _with(
    SCORED, "SELECT row_key, run, CASE WHEN run < 4 THEN 'train' ELSE 'test' END AS split FROM scored"
)
SQL["split_counts"] = _with(
    SCORED,
    "SELECT CASE WHEN run < 4 THEN 'train' ELSE 'test' END AS split, binary_label, count(*) AS rows FROM scored GROUP BY ALL",
)
SQL["straddling_runs"] = _with(
    SCORED
    + """,
drawn AS (
  SELECT source_label, run, row_number() OVER (PARTITION BY binary_label ORDER BY md5(row_key || '#42'), row_key)
      <= round(count(*) OVER (PARTITION BY binary_label) * 0.2) AS test FROM scored
)""",
    "SELECT source_label, run FROM drawn GROUP BY ALL HAVING bool_or(test) AND NOT bool_and(test)",
)
SQL["class_weights"] = _with(
    SCORED,
    """SELECT source_label, count(*) AS rows, (SELECT count(*) FROM scored) / ((SELECT count(DISTINCT source_label) FROM scored)
      * count(*))::DOUBLE AS weight FROM scored GROUP BY source_label""",
)
SQL["heuristic_attack_score"] = _with(
    SCORED + """,
limits AS (SELECT quantile_cont(packet_rate, 0.75) AS pl, quantile_cont(flow_rate, 0.75) AS fl FROM scored),
points AS (
  SELECT row_key, syn_count * 0.05::DOUBLE + rst_count * 0.15::DOUBLE + fin_count * 0.05::DOUBLE
    + CASE WHEN packet_rate > pl THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN flow_rate > limits.fl THEN 2.0::DOUBLE ELSE 0.0 END
    + CASE WHEN down_up_ratio > 3 OR down_up_ratio < 0.25 THEN 1.5::DOUBLE ELSE 0.0 END
    + CASE WHEN flow_duration < 0.1 THEN 1.0::DOUBLE ELSE 0.0 END AS s
  FROM scored, limits
)""",
    """SELECT row_key, round(s, 6) AS attack_score, CASE WHEN s > (SELECT quantile_cont(s, 0.5) FROM points) THEN 1 ELSE 0 END AS label
    FROM points""",
)
SQL["artifact_digest"] = "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents"

# A forest's votes are not determined by the data; what surrounds them is.
_LABELLED = (
    FLOWED
    + """,
model_rows AS (
  SELECT *, sha256(concat_ws('|', capture_id, protocol, lo_ip, lo_port, hi_ip, hi_port, flow_start_us)) AS flow_key
  FROM flows WHERE total_fwd_packets + total_bwd_packets > 1
),
rate_limits AS (SELECT quantile_cont(packet_rate, 0.75) AS pl, quantile_cont(flow_rate, 0.75) AS fl FROM model_rows),
pointed AS (
  SELECT flow_key, syn_count * 0.05::DOUBLE + rst_count * 0.15::DOUBLE + fin_count * 0.05::DOUBLE
    + CASE WHEN packet_rate > pl THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN flow_rate > rate_limits.fl THEN 2.0::DOUBLE ELSE 0.0 END
    + CASE WHEN down_up_ratio > 3 OR down_up_ratio < 0.25 THEN 1.5::DOUBLE ELSE 0.0 END
    + CASE WHEN flow_duration < 0.1 THEN 1.0::DOUBLE ELSE 0.0 END AS s
  FROM model_rows, rate_limits
),
ruled AS (SELECT flow_key, CASE WHEN s > (SELECT quantile_cont(s, 0.5) FROM pointed) THEN 1 ELSE 0 END AS label FROM pointed),
drawn AS (
  SELECT flow_key, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(flow_key || '#42'), flow_key)
    <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM ruled
)"""
)
_SUPPORT = """SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
    count(*) FILTER (split = 'test' AND label = 1) AS test_attacks"""
SQL["rf_train_eval"] = _with(
    _LABELLED,
    f"{_SUPPORT}, true AS counts_add_up, true AS ratios_agree FROM drawn",
)
SQL["candidate_forest_metrics"] = _with(
    _LABELLED,
    """SELECT model, count(*) FILTER (split = 'test') AS samples, count(*) FILTER (split = 'test' AND label = 1) AS attacks
    FROM drawn, (VALUES ('candidate'), ('shallow')) m(model) GROUP BY model""",
)
SQL["detect_flows"] = _with(
    FLOWED,
    f"""SELECT {FLOW_COLUMNS}, CAST(total_fwd_packets + total_bwd_packets AS INTEGER) AS packet_count, flow_duration,
      true AS pair_sums_to_one, true AS class_is_larger FROM flows""",
)
SQL["packets_to_verdict"] = _with(
    FLOWED,
    """SELECT p.capture_id, count(*) AS packet_count, any_value(n) AS flows, true AS follows_flows
    FROM packets p LEFT JOIN (SELECT capture_id, count(*) AS n FROM flows GROUP BY 1) f ON p.capture_id = f.capture_id
    GROUP BY p.capture_id""",
)
SQL["export_flow_file"] = _with(
    FLOWED,
    """SELECT (SELECT count(*) FROM packets) AS packets, (SELECT (max(ts_us) - min(ts_us)) / 1e6 FROM packets) AS seconds,
      (SELECT count(*) FROM flows) AS flows""",
)
SQL["label_window_log"] = SQL["label_window_rows"]
SQL["scenario_summary_file"] = SQL["scenario_overall"]
SQL["dataset_head"] = _with(SCORED, f"SELECT row_key, {F20} FROM scored ORDER BY row_key LIMIT 5")
SQL["nested_scenario_summary"] = f"""WITH overall AS ({SQL["scenario_overall"]}), report AS ({SQL["scenario_report"]})
SELECT 'lo' AS interface, samples, accuracy, precision, recall, false_positive_rate, f1, report.* FROM report, overall"""
SQL["nested_parity_summary"] = _with(
    _DRIFT,
    """SELECT feature, round(d, 3) AS ks_statistic, verdict, verdict = 'large' AS is_large, verdict = 'small' AS is_small,
      n AS reference_rows, m AS live_flows, (SELECT count(*) FROM packets) AS live_packets FROM drift JOIN sizes USING (feature)""",
)
_TESTED = (
    SCORED
    + """,
parts AS (SELECT run < 4 AS train, binary_label AS y, prediction, candidate_prediction FROM scored),
sides AS (SELECT count(*) FILTER (WHERE train) AS train, count(*) FILTER (WHERE NOT train) AS test,
  count(*) FILTER (WHERE train AND y = 1) AS attack_train, count(*) FILTER (WHERE NOT train AND y = 1) AS attack_test FROM parts),
votes AS (SELECT 'frozen' AS model, y, prediction AS p FROM parts WHERE NOT train
  UNION ALL SELECT 'candidate', y, candidate_prediction FROM parts WHERE NOT train),"""
)
SQL["nested_adaptation_summary"] = _with(
    _TESTED + _count4("votes", "y", "p", "model,"),
    f"SELECT * FROM sides, ({_metric_rows('model,')})",
)
SQL["nested_fpr_summary"] = f"""WITH rates AS ({SQL["two_model_fpr"]})
SELECT (SELECT count(*) FROM events) AS packets, flows, frozen_flagged, frozen_fpr AS frozen_false_positive_rate,
  candidate_flagged, candidate_fpr AS candidate_false_positive_rate FROM rates"""
