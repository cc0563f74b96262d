"""Verdicts per live window: stream against batch, and batch against one capture per window."""

import random

import pytest
from conftest import packet
from pyspark.sql import functions as F

from flowweir.operators import captures as CP
from flowweir.operators import flows as FL
from flowweir.operators import scoring as SC
from flowweir.plans import inputs as IN
from flowweir.schema import FEATURES, KEY
from flowweir.streaming import sinks as SK
from flowweir.streaming import verdicts as SV


@pytest.fixture(scope="module")
def traffic():
    rng = random.Random(31)
    rows, at = [], 100.0
    for i in range(400):
        at += rng.choice([0.0, 0.01, 0.5, 2.0, 5.0, 5.000001, 7.0])
        key = rng.randrange(1, 4)
        capture = rng.choice(["a", "b"])
        if rng.random() < 0.05:
            rows.append((capture, i, round(at * 1e6), None, None, None, None, None, None, None, None, None, 60))
            continue
        ends = dict(src=f"10.0.0.{key}", dst="10.9.9.9")
        if rng.random() < 0.4:
            ends = dict(src="10.9.9.9", dst=f"10.0.0.{key}", sport=80, dport=1000)
        flags = rng.choice([2, 16, 18, 4])
        rows.append(packet(i, at, flags=flags, payload=rng.randrange(90), capture=capture, **ends))
    # A window with a lone packet, which no model may score.
    rows.append(packet(900, at + 100, capture="a"))
    return rows


def scores(flows):
    risk = F.col("syn_count") / F.col("flow_packets") / 2 + F.when(F.col("idle_time") > 0, 0.4).otherwise(0.0)
    return flows.select(
        "*", (risk > 0.5).cast("int").alias("prediction"), F.array(1 - risk, risk).alias("probabilities")
    )


def one_capture_per_window(df, width_us=SV.WINDOW_US):
    window = F.col("ts_us") - F.pmod("ts_us", F.lit(width_us))
    return df.withColumn("capture_id", F.concat_ws("@", "capture_id", window.cast("string")))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("width_us", [8_000_000, 60_000_000])
def test_flows_of_a_window_are_those_of_its_own_capture(spark, packets, traffic, width_us):
    df = packets(traffic)
    windowed = SV._windowed(df, width_us, SV.LATENESS)
    got = SV.window_flows(windowed, width_us).withColumn(
        "capture_id", F.concat_ws("@", "capture_id", F.unix_micros("window.start").cast("string"))
    )
    want = FL.flow_features(one_capture_per_window(df, width_us))
    columns = [*KEY, "flow_start_us", "first_packet_id", *FEATURES]
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert got.filter("idle_time > 0").count() > 0


def test_verdicts_equal_the_roll_up_of_single_captures(spark, packets, traffic):
    df = packets(traffic)
    got = SV.window_verdicts(df, scores)
    single = one_capture_per_window(df)
    stats = single.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packet_count"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("capture_duration"),
    )
    flows = scores(FL.eligible_flows(FL.flow_features(single)))
    want = CP.capture_verdict(stats, flows, "first_packet_id")
    named = got.withColumn("capture_id", F.concat_ws("@", "capture_id", F.col("window_start_us").cast("string")))
    assert rows_of(named, *want.columns) == rows_of(want, *want.columns)
    kinds = {r.severity for r in got.collect()}
    assert {"LOW", "SUSPICIOUS"} <= kinds and got.filter("flows = 0").count() > 0


def test_stream_verdicts_of_a_forest_equal_the_batch(spark, packets, traffic, tmp_path):
    df = packets(traffic)
    labelled = FL.flow_features(df).withColumn("label", (F.col("syn_count") > 1).cast("int"))
    model = SC.train_forest(labelled.withColumn("row", F.col("first_packet_id")), numTrees=5)
    score = lambda flows: SC.predict(model, flows)
    folder = str(tmp_path / "in")
    files = IN.arrival_files(df, folder, batches=5, jitter_us=4_000_000, close_us=3_600_000_000)
    stream = SK.packet_stream(spark, folder, maxFilesPerTrigger=files)
    got = SK.run_available(SV.window_verdicts(stream, score), "verdicts")
    want = SV.window_verdicts(df, score)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert got.filter("flows = 0 AND severity = 'LOW'").count() > 0


def test_a_window_longer_than_the_timeout_is_refused(packets, traffic):
    with pytest.raises(ValueError):
        SV.window_verdicts(packets(traffic[:2]), scores, width_us=121_000_000)


def test_verdicts_join_no_streams(spark, packets, traffic):
    plan = SV.window_verdicts(packets(traffic), scores)._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()
