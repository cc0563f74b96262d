import math
import random

import pytest

from flowweir.functions import columns as C
from flowweir.operators import contracts as CT
from flowweir.operators import prepare as PR
from flowweir.operators import windows as WN
from flowweir.schema import FEATURES, LABEL_WINDOW_SCHEMA, RAW_COLUMNS, require_columns, schema_difference
from flowweir.sources import tables as TB
from pyspark.sql import functions as F


def raw_row(label="BENIGN", **changes):
    values = dict.fromkeys(RAW_COLUMNS, "1")
    values["Label"] = label
    values.update(changes)
    return tuple(values[c] for c in RAW_COLUMNS)


@pytest.fixture(scope="module")
def raw(spark):
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    return lambda rows: spark.createDataFrame(rows, schema)


def test_preparation_drops_faults_and_repeats(raw):
    rows = [
        raw_row(),
        raw_row(),
        raw_row(" benign "),
        raw_row("Bot"),
        raw_row(**{"Flow Bytes/s": "Infinity"}),
        raw_row(**{"Flow Packets/s": ""}),
        raw_row(**{"Flow Duration": "-4"}),
        raw_row(**{"Active Mean": "NaN"}),
        raw_row(**{"Active Mean": "-4"}),
    ]
    got = PR.prepare_canonical(raw(rows))
    assert got.count() == 3
    assert [t for _, t in got.dtypes] == ["float"] * 20 + ["tinyint"]
    assert sorted(r.label for r in got.collect()) == [0, 0, 1]
    assert got.filter("active_time < 0").count() == 1
    assert got.first().header_length == 2.0


def test_provenance_keeps_the_first_source(raw):
    df = raw([raw_row("Bot"), raw_row("PortScan"), raw_row("Bot")]).withColumns(
        {"source_file": F.lit("b.csv"), "row_key": F.monotonically_increasing_id()}
    )
    first = df.limit(1).withColumn("source_file", F.lit("a.csv"))
    got = PR.provenance_dedup(df.unionByName(first)).collect()
    assert len(got) == 1 and got[0].source_file == "a.csv"


def test_provenance_sorts_behind_the_move_only(raw):
    df = raw([raw_row("Bot")]).withColumns({"source_file": F.lit("b.csv"), "row_key": F.lit(1)})
    plan = PR.provenance_dedup(df)._jdf.queryExecution().executedPlan().toString()
    behind, _, before = plan.partition("Exchange")
    assert behind.count("+- Sort [") == 1
    assert "Sort" not in before


def test_label_rules(spark):
    df = spark.createDataFrame(
        [(" BENIGN ",), ("Benign",), ("normal",), ("0",), (None,), ("Web Attack ? XSS",)], "l string"
    )
    got = df.select(
        C.label_not_benign("l").alias("a"),
        C.label_evaluation("l").alias("b"),
        C.label_exact("l").alias("c"),
        C.label_display("l").alias("d"),
    ).collect()
    assert [r.a for r in got] == [0, 0, 1, 1, 1, 1]
    assert [r.b for r in got] == [0, 0, 0, 0, 1, 1]
    assert [r.c for r in got] == [0, 1, 1, 1, 1, 1]
    assert got[-1].d == "Web Attack - XSS"


def test_clean_fills_with_median_and_mode(spark):
    rows = [(1.0, "a"), (3.0, "b"), (float("inf"), "b"), (None, None), (float("nan"), None), (8.0, "a")]
    got = PR.clean_impute(spark.createDataFrame(rows, "x double, t string")).collect()
    assert sorted((r.x, r.t) for r in got) == [(1.0, "a"), (3.0, "a"), (3.0, "b"), (3.0, "b"), (8.0, "a")]


def test_clean_without_any_text_value(spark):
    got = PR.clean_impute(spark.createDataFrame([(1.0, None), (2.0, None)], "x double, t string"))
    assert {r.t for r in got.collect()} == {"Unknown"}


def test_one_hot_drops_first_category(spark):
    df = spark.createDataFrame([("a", True, "y"), ("b", False, "n"), ("c", True, "y")], "p string, q boolean, l string")
    got = PR.one_hot(df, {"p": ["c", "a", "b"], "q": ["true", "false"]})
    assert got.columns == ["l", "p_b", "p_c", "q_true"]
    with pytest.raises(ValueError):
        PR.split_features(df, "missing")


def test_category_positions_match_the_columns(spark):
    rows = [("a", True, "y"), ("b", None, "n"), (None, False, "y"), ("c", True, "y"), ("c", True, "y")]
    df = spark.createDataFrame(rows, "p string, q boolean, l string")
    got = PR.category_positions(df, "l")
    assert got.columns == ["l", "positions"]
    wide = PR.one_hot(df, {"p": ["a", "b", "c"], "q": ["false", "true"]})
    ones = [[i for i, v in enumerate(r[1:]) if v] for r in wide.collect()]
    assert sorted(r.positions for r in got.collect()) == sorted(ones)


def test_feature_contract(spark):
    good = dict.fromkeys(FEATURES, "1")
    rows = [good, {**good, "flow_rate": "inf"}, {**good, "idle_time": "x"}, {**good, "fin_count": "-1"},
            {**good, "fwd_packet_length": "-1"}, {**good, "total_fwd_packets": "0", "total_bwd_packets": "0"}]
    df = spark.createDataFrame([tuple(r[f] for f in FEATURES) for r in rows], ", ".join(f"{f} string" for f in FEATURES))
    got = [r.violations for r in CT.with_feature_violations(df).select("violations").collect()]
    assert got == [[], ["flow_rate:not_finite"], ["idle_time:not_numeric"], ["fin_count:negative"], [],
                   ["packet_count:below_one"]]
    valid, quarantined = CT.valid_and_quarantined(df)
    assert valid.count() == 2 and quarantined.count() == 4
    with pytest.raises(TypeError):
        CT.with_feature_violations(df.withColumn("idle_time", F.lit(True)))
    assert schema_difference(["flow_duration", "zzz"])[1] == ["zzz"]
    with pytest.raises(ValueError):
        require_columns(df.drop("idle_time"))
    with pytest.raises(ValueError):
        require_columns(df.withColumn("zzz", F.lit(1)), exact=True)


def test_score_and_capture_contracts(spark):
    nan = float("nan")
    rows = [([0.4, 0.6], 1.0), ([0.4], 1.0), ([nan, 0.5], 1.0), ([-0.1, 1.1], 1.0), ([0.4, 0.4], 1.0),
            ([0.4, 0.6], 0.5), ([0.4, 0.6], 2.0), (None, 1.0), ([0.5, 0.500009], 1.0)]
    df = spark.createDataFrame(rows, "probabilities array<double>, prediction double")
    got = [r[0] for r in df.select(CT.score_violation()).collect()]
    assert got == [None, "shape", "not_finite", "out_of_range", "sum", "prediction_not_integer",
                   "prediction_range", "missing", None]
    df = spark.createDataFrame([("3", "1.5"), ("2.5", "1"), ("-1", "1"), ("1", "inf"), ("1", "x"), ("x", "1")],
                               "packet_count string, capture_duration string")
    got = [r[0] for r in df.select(CT.capture_violation()).collect()]
    assert got == [None, "packet_count_not_integer", "packet_count_negative", "duration_invalid",
                   "duration_not_numeric", "packet_count_not_integer"]


def test_label_file_and_windows(spark):
    df = spark.createDataFrame([("f0", "benign"), ("f1", " attack "), ("f2", None), ("f3", "odd")], "flow_id string, label string")
    row = CT.label_file_check(df).first()
    assert (row.rows, row.benign, row.attack, row.unlabelled, row.first_unlabelled) == (4, 1, 1, 1, "f2")
    assert (row.invalid_labels, row.first_invalid, row.status) == (1, "odd", "FAIL")
    assert CT.label_file_check(df.limit(2)).first().status == "PASS"
    assert CT.label_file_check(df.limit(0)).first().status == "FAIL"
    windows = spark.createDataFrame([("s", 1, 1.23456, 2.0, "p"), ("s", 2, 1.0, 2.0, "p"), ("s", 0, 2.0, 1.0, "p")],
                                    "scenario string, label int, start_epoch double, end_epoch double, pcap string")
    got = CT.label_window_rows(windows).collect()
    assert len(got) == 1 and got[0].start_epoch == 1.235


def test_reproduction(raw):
    df = raw([raw_row(), raw_row("Bot")]).withColumns({"source_file": F.lit("a"), "row_key": F.col("Label")})
    built = PR.provenance_dedup(df).withColumnRenamed("binary_label", "label")
    assert PR.reproduction_diff(built, built, "row_key").first().status == "PASS"
    other = built.withColumn("idle_time", F.col("idle_time") + 1)
    row = PR.reproduction_diff(other, built, "row_key").first()
    assert (row.differing_cells, row.differing_rows, row.status) == (2, 2, "FAIL")


def test_csv_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        TB.load_csv(spark, str(tmp_path / "x.parquet"))
    with pytest.raises(FileNotFoundError):
        TB.load_csv(spark, str(tmp_path / "x.csv"))
    with pytest.raises(FileNotFoundError):
        TB.load_raw_flow_directory(spark, str(tmp_path))
    names = [" " + c for c in RAW_COLUMNS] + [" Other"]
    for day in ("a", "b"):
        (tmp_path / f"{day}.csv").write_text(
            ",".join(names) + "\n" + ", ".join(raw_row() + ("9",)) + "\n"
        )
    got = TB.load_raw_flow_directory(spark, str(tmp_path))
    assert got.columns == ["source_file", *RAW_COLUMNS]
    assert sorted(r.source_file for r in got.collect()) == ["a.csv", "b.csv"]
    assert PR.prepare_canonical(got).count() == 1
    with pytest.raises(RuntimeError):
        TB.require_single_file(got)
    values = [*raw_row(), "9"]
    (tmp_path / "c.csv").write_text(",".join(reversed(names)) + "\n" + ",".join(reversed(values)) + "\n")
    rows = TB.load_raw_flow_directory(spark, str(tmp_path)).drop("source_file").collect()
    assert len(rows) == 3 and len(set(rows)) == 1


def test_repeated_header_name_binds_the_first(spark, tmp_path):
    names = [*RAW_COLUMNS, "Fwd Header Length"]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(raw_row() + ("99",)) + "\n")
    got = TB.load_raw_flow_directory(spark, str(tmp_path)).first()
    assert got["Fwd Header Length"] == "1"


def test_safe_number_and_digest(spark, tmp_path):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("inf",), ("nan",)], "t string")
    assert [r[0] for r in df.select(C.safe_number("t")).collect()] == [1.5, 0, 0, 0, 0]
    (tmp_path / "m.bin").write_bytes(b"abc")
    row = TB.artifact_digests(spark, str(tmp_path)).first()
    assert row.sha256 == "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    assert math.isclose(row.length, 3)


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X,Y,Y\n1,2,9\n")
    (tmp_path / "b.csv").write_text("\ufeffY, X ,Y\n2,1,9\n,\n")
    (tmp_path / "c.csv").write_text('extra,"Y",more,X,last\n8,4,8,3,8\n7,6,7,5\n')
    got = TB.load_raw_flow_directory(spark, str(tmp_path), ["X", "Y"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            ("a.csv", "1", "2"),
            ("b.csv", "1", "2"),
            ("b.csv", None, None),
            ("c.csv", "3", "4"),
            ("c.csv", "5", "6"),
        ],
        key=str,
    )
    (tmp_path / "d.csv").write_text("X,Z\n1,2\n")
    with pytest.raises(ValueError, match="missing columns in .*d.csv"):
        TB.load_raw_flow_directory(spark, str(tmp_path), ["X", "Y"])


def test_windows_label_flows_of_their_own_capture(spark):
    flows = spark.createDataFrame(
        [("one", 5_000_000), ("two", 5_000_000), ("one", 50_000_000)],
        "capture_id string, flow_start_us long",
    )
    windows = spark.createDataFrame(
        [("a", 1, 0.0, 10.0, "x/one.pcap"), ("b", 0, 0.0, 10.0, "two.pcapng"), ("c", 1, 0.0, 99.0, "three.pcap")],
        LABEL_WINDOW_SCHEMA,
    )
    got = WN.label_flows_by_window(flows, windows).collect()
    assert {(r.capture_id, r.flow_start_us // 10**6, r.scenario) for r in got} == {
        ("one", 5, "a"),
        ("two", 5, "b"),
        ("one", 50, None),
    }


def test_overlapping_windows_label_a_flow_once(spark):
    rng = random.Random(3)
    flows = [(c, t * 10**5) for c in ("one", "two") for t in range(-5, 1205, 7)]
    windows = []
    for n in range(60):
        start = rng.randrange(0, 110)
        windows.append((f"s{n}", rng.randrange(2), float(start), float(start + rng.randrange(0, 12)),
                        rng.choice(["one.pcap", "x/two.pcapng", "three.pcap"])))
    windows += [windows[0], ("never", 1, 9.0, 3.0, "one.pcap"), ("open", 1, 9.0, None, "one.pcap")]
    got = WN.label_flows_once(
        spark.createDataFrame(flows, "capture_id string, flow_start_us long"),
        spark.createDataFrame(windows, LABEL_WINDOW_SCHEMA),
        slot_us=5_000_000,
    ).collect()
    expected = []
    for capture, at in flows:
        over = [
            w for w in windows
            if f"{capture}.pcap" in w[4] and w[3] is not None and w[2] * 1e6 <= at <= w[3] * 1e6
        ]
        labels = {w[1] for w in over}
        expected.append((
            capture, at, over[0][0] if len(over) == 1 else None,
            labels.pop() if len(labels) == 1 else None, len(over), len({w[1] for w in over}) > 1,
        ))
    columns = ("capture_id", "flow_start_us", "scenario", "window_label", "windows", "conflict")
    key = lambda r: r[:2]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(expected, key=key)
    assert {r[4] for r in expected} >= {0, 1, 2, 3} and any(r[5] for r in expected)


def test_builds_move_their_features_as_one_array(spark):
    from flowweir.operators import errors as ER

    frozen = spark.range(2).select(
        F.col("id").cast("string").alias("row_key"),
        *[F.col("id").cast("float").alias(f) for f in FEATURES],
        F.lit(0).alias("label"),
    )
    changed = frozen.withColumn("idle_time", F.when(F.col("row_key") == "0", F.col("idle_time")))
    diff = PR.reproduction_diff(changed, frozen, "row_key")
    aligned = ER.alignment_report(changed, frozen.withColumnRenamed("label", "binary_label"), "row_key")
    assert (diff.first().differing_cells, aligned.first().feature_mismatch) == (1, 1)
    for result in (diff, aligned):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("array(") >= 2


def test_multiset_diff_moves_digests_and_tells_nulls_and_places_apart(spark):
    kinds = "a float, b float, label int"
    left = spark.createDataFrame([(1.0, None, 0), (1.0, 2.0, 1), (1.0, 2.0, 1), (0.0, 1.0, 1)], kinds)
    right = spark.createDataFrame([(None, 1.0, 0), (1.0, 2.0, 1), (2.0, 1.0, 1), (-0.0, 1.0, 1)], kinds)
    diff = PR.multiset_diff(left, right)
    assert tuple(diff.first()) == (2, 2)
    assert tuple(PR.multiset_diff(left, left).first()) == (0, 0)
    moved = diff._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_h1" in moved
