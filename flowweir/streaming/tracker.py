"""Flow table over a packet stream, equal to the batch one.

Two stateful steps. The first is a built-in aggregation that merges the packets of
a key and microsecond and holds them back until the watermark has passed, so its
output comes complete and in the order of time, batch by batch, whatever the order
of arrival inside the lateness bound. The second keeps one small state per open flow,
in a list per share of the flow keys, and folds those rows into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowweir.operators.flows import features_from_aggregates
from flowweir.operators.packets import flow_keys, packet_measures
from flowweir.schema import ACTIVITY_GAP_US, FEATURES, FLOW, FLOW_TIMEOUT_US, KEY
from flowweir.streaming.windows import LATENESS, with_event_time

_SUMS = ["lo_packets", "hi_packets", "lo_bytes", "hi_bytes", "header_bytes", "syn", "ack", "rst", "fin"]
_ACTIVITY = ["active_us", "active_periods", "idle_us", "idle_periods"]
_STATE = [
    "flow_start_us",
    "first_us",
    "last_us",
    "period_us",
    "first_packet_id",
    "first_payload",
    "forward_is_lo",
    *[f"{side}_{end}_us" for side in ("lo", "hi") for end in ("first", "last")],
    *_SUMS,
    *_ACTIVITY,
]
_ROW = ["ts_us", "first_packet_id", "first_payload", "forward_is_lo", *_SUMS]
_KEY_SCHEMA = (
    "capture_id string, protocol string, lo_ip string, lo_port int, hi_ip string, hi_port int"
)
OUTPUT_SCHEMA = f"{_KEY_SCHEMA}, state array<bigint>"
_CLOSED = Row(*KEY, "state")
_ABSENT = -1
SHARES = 1024


def _opened(at: int, packet_id: int, payload: int, forward_is_lo: int) -> dict:
    """State of a flow that starts at ``at``, before any packet is added."""
    state = dict.fromkeys(_STATE, 0)
    state.update(
        flow_start_us=at,
        first_us=at,
        last_us=at,
        period_us=at,
        first_packet_id=packet_id,
        first_payload=payload,
        forward_is_lo=forward_is_lo,
        lo_first_us=_ABSENT,
        lo_last_us=_ABSENT,
        hi_first_us=_ABSENT,
        hi_last_us=_ABSENT,
    )
    return state


def _add(state: dict, at: int, packet_id: int, sums: list, gap_us: int) -> None:
    """Add one merged row of a flow, not before what the state holds."""
    quiet = at - state["last_us"]
    if quiet > gap_us:
        active = state["last_us"] - state["period_us"]
        state["active_us"] += active
        state["active_periods"] += active > 0
        state["idle_us"] += quiet
        state["idle_periods"] += 1
        state["period_us"] = at
    state["last_us"] = at
    state["first_packet_id"] = min(state["first_packet_id"], packet_id)
    for name, more in zip(_SUMS, sums):
        state[name] += more
    for first, last, packets in (
        ("lo_first_us", "lo_last_us", sums[0]),
        ("hi_first_us", "hi_last_us", sums[1]),
    ):
        if packets:
            if state[first] == _ABSENT:
                state[first] = at
            state[last] = at


class FlowTracker(StatefulProcessor):
    """Emits one aggregate row per closed flow; its key is a share of the flow keys.

    A share's open flows are read and written at once, as each call to the state costs more
    than many flows do. Numbers come, stay and go as one array for the same reason.
    """

    def __init__(self, timeout_us: int = FLOW_TIMEOUT_US, gap_us: int = ACTIVITY_GAP_US):
        self.timeout_us = timeout_us
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getListState("flows", OUTPUT_SCHEMA)

    def _open(self) -> dict:
        return {row[:-1]: dict(zip(_STATE, row[-1])) for row in self.flows.get()}

    def _row(self, flow, state) -> Row:
        return _CLOSED(*flow, [state[c] for c in _STATE])

    def _alarm(self, state) -> int:
        # First whole millisecond at which no packet can still join the flow.
        return (state["flow_start_us"] + self.timeout_us) // 1000 + 1

    def _first_alarm(self, held) -> int | None:
        return min(map(self._alarm, held.values()), default=None)

    def _settled(self, held, before, timerValues):
        """Rows of the flows that are over; the others are kept, with one timer for the first of them."""
        watermark = timerValues.getCurrentWatermarkInMs()
        over = [flow for flow, state in held.items() if self._alarm(state) <= watermark]
        closed = [self._row(flow, held.pop(flow)) for flow in over]
        if held:
            self.flows.put([tuple(self._row(*item)) for item in held.items()])
        else:
            self.flows.clear()
        alarm = self._first_alarm(held)
        if before != alarm:
            if before is not None:
                self.handle.deleteTimer(before)
            if alarm is not None:
                self.handle.registerTimer(alarm)
        return closed

    def handleInputRows(self, key, rows, timerValues):
        held = self._open()
        before = self._first_alarm(held)
        arrived = sorted(((r.numbers, tuple(r[1:-1])) for r in rows), key=lambda r: r[0][0])
        for (at, packet_id, payload, forward_is_lo, *sums), flow in arrived:
            state = held.get(flow)
            if state and at - state["flow_start_us"] > self.timeout_us:
                yield self._row(flow, state)
                state = None
            if state is None:
                state = held[flow] = _opened(at, packet_id, payload, forward_is_lo)
            _add(state, at, packet_id, sums, self.gap_us)
        yield from self._settled(held, before, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settled(self._open(), None, timerValues)

    def close(self) -> None:
        pass


def track_flows(
    packets: DataFrame,
    timeout_us: int = FLOW_TIMEOUT_US,
    gap_us: int = ACTIVITY_GAP_US,
    lateness: str = LATENESS,
    shares: int = SHARES,
) -> DataFrame:
    """Closed flows of a packet stream with their twenty features.

    Equals the batch operator for packets not later than ``lateness``; later ones
    are dropped. A flow is emitted when the watermark passes the end of its
    timeout; a packet of its own key with a later time closes those open at the
    end of an input. Keys are dealt to ``shares`` by a hash; a share's open flows are
    in memory together while its rows are folded. Needs the RocksDB state store, which ``run_available``
    sets for its query.
    """
    measured = packet_measures(flow_keys(with_event_time(packets)))
    lo, hi = F.col("from_lo"), ~F.col("from_lo")
    merged = (
        measured.withWatermark("ts", lateness)
        .groupBy(*KEY, "ts")
        .agg(
            F.min("ts_us").alias("ts_us"),
            F.min("packet_id").alias("first_packet_id"),
            F.min_by("payload_bytes", "packet_id").cast("long").alias("first_payload"),
            F.min_by("from_lo", "packet_id").cast("int").alias("forward_is_lo"),
            F.count_if(lo).alias("lo_packets"),
            F.count_if(hi).alias("hi_packets"),
            F.sum(F.when(lo, F.col("payload_bytes")).otherwise(0)).alias("lo_bytes"),
            F.sum(F.when(hi, F.col("payload_bytes")).otherwise(0)).alias("hi_bytes"),
            F.sum("header_bytes").alias("header_bytes"),
            *[F.sum(f).alias(f) for f in ("syn", "ack", "rst", "fin")],
        )
    )
    rows = merged.select(
        F.pmod(F.xxhash64(*KEY), F.lit(shares)).alias("share"),
        *KEY,
        F.array(*[F.col(c).cast("long") for c in _ROW]).alias("numbers"),
    )
    tracked = rows.groupBy("share").transformWithState(
        FlowTracker(timeout_us, gap_us), OUTPUT_SCHEMA, "Append", "EventTime"
    )
    closed = tracked.select(*KEY, *[F.get("state", F.lit(i)).alias(c) for i, c in enumerate(_STATE)])
    present = lambda c: F.when(F.col(c) != _ABSENT, F.col(c)).alias(c)
    bounds = [f"{side}_{end}_us" for side in ("lo", "hi") for end in ("first", "last")]
    typed = closed.select(
        *[c for c in closed.columns if c not in bounds and c != "forward_is_lo"],
        *[present(c) for c in bounds],
        (F.col("forward_is_lo") == 1).alias("forward_is_lo"),
    )
    return features_from_aggregates(typed).select(*FLOW, *FEATURES)
