import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowweir.functions import columns as C
from flowweir.functions.ordered import order_bucket, rank_cuts
from flowweir.operators import captures as CP
from flowweir.operators import drift as DR
from flowweir.operators import errors as ER
from flowweir.operators import metrics as MT
from flowweir.operators import proximity as PX
from flowweir.operators import splits as SP
from flowweir.operators import windows as WN
from flowweir.schema import FEATURES


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def test_severity(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (1, 0.4), (0, 0.9), (0, 0.7)], "p int, c double")
    got = [r[0] for r in df.select(C.severity("p", "c")).collect()]
    assert got == ["HIGH", "MEDIUM", "SUSPICIOUS", "LOW", "SUSPICIOUS"]


def test_confusion_and_metrics(spark):
    row = MT.confusion_counts(pairs(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (0, 7), (2, 0)])).first()
    assert (row.tp, row.fn, row.tn, row.fp) == (1, 2, 1, 2)
    empty = MT.binary_metrics(pairs(spark, [])).first().asDict()
    assert set(empty.values()) == {0}


def test_metrics_match_published_matrix(spark):
    counts = {(0, 0): 337409, (0, 1): 1188, (1, 0): 650, (1, 1): 64880}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "label int, prediction int, n int")
    df = df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    row = MT.heldout_metrics(df).first()
    assert [round(row[m], 6) for m in ("accuracy", "precision", "recall", "f1")] == [
        0.995452, 0.982019, 0.990081, 0.986033]
    report = {r.class_name: r for r in MT.classification_report(df).collect()}
    assert report["Benign"].support == 338597 and report["Attack"].support == 65530
    assert report["macro avg"].support == 404127


def test_f1_uses_rounded_parts(spark):
    row = MT.binary_metrics(pairs(spark, [(1, 1)] * 2 + [(1, 0)] + [(0, 1)] * 5)).first()
    assert row.f1 == round(2 * 0.2857 * 0.6667 / (0.2857 + 0.6667), 4)


@pytest.mark.parametrize("n,expected", [(5, [2, 1, 1, 1]), (6, [2, 1, 1, 2]), (7, [2, 2, 1, 2]),
                                        (10, [3, 2, 2, 3]), (100, [25] * 4)])
def test_quartile_cut(spark, n, expected):
    df = spark.range(n).select(F.col("id").alias("row_key"), F.lit(1.0).alias("flow_bytes"))
    got = ER.quartile_slices(df, "row_key", ["flow_bytes"]).groupBy("slice").count().collect()
    assert [r["count"] for r in sorted(got)] == expected


def test_slice_rates_are_null_without_a_denominator(spark):
    df = spark.createDataFrame([(i, 1, 1, float(i)) for i in range(4)],
                               "row_key int, binary_label int, prediction int, flow_bytes double")
    got = ER.error_slices(df, features=["flow_bytes"]).collect()
    assert all(r.benign_fpr is None and r.attack_recall == 1.0 for r in got)


def test_slices_of_tied_values_follow_the_order_and_move_few_rows(spark):
    key = F.format_string("r-%04d", (F.col("id") * 379) % 1000)
    kinds = {"a": F.lit(0.0), "b": F.when(F.col("id") < 900, 1.0).otherwise(F.col("id").cast("double"))}
    kinds["c"] = F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, -0.0).otherwise(0.0)
    for value in kinds.values():
        df = spark.range(1000).select(key.alias("row_key"), value.alias("flow_bytes"))
        got = ER.quartile_slices(df, "row_key", ["flow_bytes"])
        assert "RangePartitioning" not in got._jdf.queryExecution().toString()
        ordered = df.orderBy("flow_bytes", "row_key").collect()
        slices = {r.row_key: r.slice for r in got.collect()}
        places = [1 + sum(i + 1 > 1 + 999 * q for q in (0.25, 0.5, 0.75)) for i in range(1000)]
        assert [slices[r.row_key] for r in ordered] == [f"Q{n}" for n in places]
        ends = rank_cuts(
            df.withColumn("g", F.lit(1)), ["g"], "flow_bytes", "row_key", order_bucket(df, "row_key"), {"q": 0.5}
        ).collect()
        assert [(r.cut, r.last) for r in ends] == [("q", ordered[499].row_key)]


VERDICTS = "capture_id string, flow_seq int, prediction int, probabilities array<double>"


def test_capture_verdict(spark):
    captures = spark.createDataFrame([("a", 3, 1.0), ("b", 2, 1.0), ("e", 0, 1.0)],
                                     "capture_id string, packet_count int, capture_duration double")
    scores = spark.createDataFrame(
        [("a", 1, 0, [0.9, 0.1]), ("a", 2, 1, [0.15, 0.85]), ("b", 1, 0, [0.95, 0.05]), ("b", 2, 0, [0.6, 0.4])],
        VERDICTS)
    got = {r.capture_id: r for r in CP.capture_verdict(captures, scores).collect()}
    assert (got["a"].prediction, got["a"].confidence, got["a"].severity) == (1, 0.85, "HIGH")
    assert (got["b"].attack_probability, got["b"].confidence, got["b"].severity) == (0.4, 0.6, "SUSPICIOUS")
    assert (got["e"].prediction, got["e"].confidence, got["e"].attack_probability, got["e"].severity) == (0, 0.0, 0.0, "LOW")
    shown = {r.capture_id: r for r in CP.display_verdict(CP.capture_verdict(captures, scores)).collect()}
    assert [shown[c].verdict for c in "abe"] == ["ATTACK", "UNCERTAIN", "NORMAL"]
    assert shown["a"].confidence_text == "85.00%"


def test_ks_and_difference_match_direct_computation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400).round(1), rng.normal(0.5, size=150).round(1)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double").select(
        *[F.col("x").alias(f) for f in FEATURES])
    row = DR.feature_drift(frame(a), frame(b)).first()
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert row.ks_statistic == pytest.approx(round(d, 3))
    pooled = np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert row.standardised_difference == pytest.approx(round(abs(a.mean() - b.mean()) / pooled, 3))
    assert 0 <= row.ks_p_value < 0.01


def test_small_sample_stops_comparison(spark):
    with pytest.raises(ValueError):
        DR.require_sample(spark.range(29))
    assert DR.require_sample(spark.range(30)) == "LIMITED_SAMPLE"


@pytest.mark.parametrize("trees", [1, 2, 7, 20, 100])
def test_search_steps_lose_no_partner(trees):
    rng = np.random.default_rng(trees)
    steps = PX.search_steps(trees)
    assert [s.matches for s in steps] == sorted({s.matches for s in steps}, reverse=True)
    assert steps[0].matches == trees and steps[-1].matches == 1
    for step, above in zip(steps[1:], steps):
        # What is only looked up has exactly as many equal leaves as its postings have trees.
        assert step.compared or step.matches == above.matches - 1
        for _ in range(50):
            equal = set(rng.choice(trees, step.matches, replace=False).tolist())
            assert any(equal.issuperset(posting) for posting in step.trees)


def test_proximity_comparisons_stay_below_the_product(spark):
    """Uniform leaves: every step sets far fewer vectors against each other than there are pairs."""
    trees, shares = 20, {}
    for rows in (300, 1200):
        rng = np.random.default_rng(1)
        sides = [
            spark.createDataFrame(
                [("f", [int(x) for x in rng.integers(0, 12, trees)]) for _ in range(rows)],
                "source_label string, leaves array<int>",
            )
            for _ in range(2)
        ]
        for step in PX.search_steps(trees):
            if step.compared:
                met = PX.comparisons(*sides, step).selectExpr("sum(left_rows * right_rows) AS n").first().n
                shares.setdefault(step.matches, []).append((met or 0) / rows**2)
    assert all(share < 0.75 for pair in shares.values() for share in pair)
    assert min(shares) == 3 and not any(s.compared for s in PX.search_steps(trees) if s.matches < 3)


@pytest.mark.parametrize("trees, block_rows", [(8, 4096), (20, 3), (20, 4096)])
def test_leaf_proximity_equals_brute_force(spark, trees, block_rows):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        family = "hot" if i % 3 else "cold"
        # A third of the rows are copies of one leaf vector.
        leaves = [1] * trees if i % 3 == 1 else [int(x) for x in rng.integers(0, 4 if i % 2 else 40, trees)]
        kind = "FALSE_NEGATIVE" if rng.random() < 0.4 else "CORRECT"
        rows.append((f"r{i:03d}", family, kind, float(rng.random()), leaves))
    rows.append(("x1", "lonely", "FALSE_NEGATIVE", 0.5, [9] * trees))
    rows.append(("y1", "apart", "FALSE_NEGATIVE", 0.5, [9] * trees))
    rows.append(("y3", "apart", "CORRECT", 0.75, [3] * trees))
    rows.append(("y2", "apart", "CORRECT", 1.0, [2] * trees))
    df = spark.createDataFrame(
        rows, "row_key string, source_label string, error_type string, attack_probability double, leaves array<int>")
    got = {r.row_key: r for r in PX.leaf_proximity(df, trees, block_rows).collect()}
    expected = {}
    for key, family, kind, p, leaves in rows:
        partners = sorted(r for r in rows if r[1] == family and r[2] == "CORRECT")
        if kind != "FALSE_NEGATIVE" or not partners:
            continue
        scores = [sum(a == b for a, b in zip(leaves, r[4])) for r in partners]
        best = int(np.argmax(scores))
        expected[key] = (partners[best][0], scores[best] / trees, abs(p - partners[best][3]))
    assert set(got) == set(expected)
    for key, (partner, share, gap) in expected.items():
        assert got[key].best_key == partner
        assert got[key].proximity == pytest.approx(share)
        assert got[key].probability_gap == pytest.approx(gap)
    summary = {r.source_label: r for r in PX.leaf_proximity_summary(spark.createDataFrame(list(got.values()))).collect()}
    assert summary["apart"].proximity_max == 0.0 and summary["apart"].near_25 == 0


def test_stratified_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = SP.stratified_split(df, "y", "k").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(0, "test"): 180, (0, "train"): 720,
                                                        (1, "test"): 20, (1, "train"): 80}
    again = SP.stratified_split(df.repartition(7), "y", "k")
    assert SP.stratified_split(df, "y", "k").exceptAll(again).count() == 0


def test_stratified_split_draws_the_first_digests(spark):
    rows = [(k, k % 7 if k % 50 else None) for k in range(3000)] + [(None, 1)] + [(5000, 100)]
    df = spark.createDataFrame(rows, "k long, y int").withColumn("y", F.when(F.col("y") > 1, 2).otherwise(F.col("y")))
    got = SP.stratified_split(df, "y", "k", 0.3).collect()
    classes = {}
    for k, y in ((r.k, r.y) for r in df.collect()):
        if k is not None and y is not None:
            classes.setdefault(y, []).append(k)
    test = set()
    for keys in classes.values():
        keys.sort(key=lambda k: hashlib.md5(f"{k}#42".encode()).hexdigest())
        test |= set(keys[: math.floor(len(keys) * 0.3 + 0.5)])
    assert {r.k for r in got if r.split == "test"} == test
    assert len(got) == sum(map(len, classes.values()))


def test_class_weights(spark):
    df = pairs(spark, [(0, 0)] * 3 + [(1, 0)])
    got = {r.label: r.weight for r in SP.class_weights(df, "label").collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}


def test_flows_outside_every_window_are_kept(spark):
    starts = [0, 5_000_000, 700_000_000, -3]
    flows = spark.createDataFrame([("p", t) for t in starts], "capture_id string, flow_start_us bigint")
    windows = spark.createDataFrame([("w", 1, 4.0, 650.0, "p"), ("v", 0, 0.0, 0.0, "p")],
                                    "scenario string, label int, start_epoch double, end_epoch double, pcap string")
    got = {r.flow_start_us: r.scenario for r in WN.label_flows_by_window(flows, windows).collect()}
    assert got == {0: "v", 5_000_000: "w", 700_000_000: None, -3: None}


def paths_inside(n, m, reach):
    """Number of lattice paths with |i m - j n| < reach at every point."""
    row = []
    for i in range(n + 1):
        new = []
        for j in range(m + 1):
            ways = 1 if i == j == 0 else (row[j] if i else 0) + (new[j - 1] if j else 0)
            new.append(ways if abs(i * m - j * n) < reach else 0)
        row = new
    return row[m]


def test_exact_p_value_equals_a_count_of_paths(spark):
    sizes = [(1, 1), (1, 7), (5, 5), (8, 3), (12, 18), (33, 50), (50, 50)]
    cases = [(n, m, d) for n, m in sizes for d in sorted({1, n * m // 7 + 1, n * m // 3, n * m // 2, n * m})]
    table = spark.createDataFrame([(n, m, d, d / (n * m)) for n, m, d in cases], "n long, m long, d long, ks double")
    got = table.select("n", "m", "d", DR.exact_p_value(F.col("ks"), F.col("n"), F.col("m"))).collect()
    assert len(got) == len(cases)
    for n, m, d, p in got:
        want = 1 - paths_inside(n, m, d) / math.comb(n + m, n) if d else 1.0
        assert math.isclose(p, want, rel_tol=1e-9, abs_tol=1e-12), (n, m, d)


def test_p_value_of_large_samples_is_asymptotic(spark):
    row = spark.range(1).select(
        DR.two_sample_p_value(F.lit(0.3), F.lit(40_000), F.lit(33)).alias("large"),
        DR.kolmogorov_p_value(F.lit(0.3), F.lit(40_000), F.lit(33)).alias("series"),
        DR.two_sample_p_value(F.lit(0.3), F.lit(20), F.lit(30)).alias("small"),
        DR.exact_p_value(F.lit(0.3), F.lit(20), F.lit(30)).alias("exact"),
    ).first()
    assert row.large == row.series and row.small == row.exact
