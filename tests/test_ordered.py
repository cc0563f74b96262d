import numpy as np
import pytest
from pyspark.sql import functions as F

from flowweir.functions.ordered import (
    cumulative,
    exact_quantiles,
    first_rows,
    runs_near,
    with_rank,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds most rows, half of them with one value."""
    rng = np.random.default_rng(3)
    rows = [("hot", 0.0 if rng.random() < 0.5 else float(rng.integers(0, 40)), i) for i in range(900)]
    rows += [("cold", float(rng.normal()), 1000 + i) for i in range(11)]
    return spark.createDataFrame(rows, "g string, v double, id bigint").repartition(5)


def test_rank_matches_sorted_order(skewed):
    got = with_rank(skewed, ["g"], ["v", "id"]).collect()
    for group in ("hot", "cold"):
        rows = sorted([r for r in got if r.g == group], key=lambda r: (r.v, r.id))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_rank_without_groups(skewed):
    got = with_rank(skewed.select("id"), [], ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(1, 912))


def test_running_totals(skewed):
    got = cumulative(skewed, ["g"], "v", {"n": F.count(F.lit(1))}).collect()
    for group in ("hot", "cold"):
        rows = sorted([r for r in got if r.g == group], key=lambda r: r.v)
        total = 0
        for r in rows:
            total += r.n
            assert r.n_upto == total
        assert all(r.n_all == total for r in rows)


def test_quantiles_match_numpy(skewed):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(skewed, ["g"], "v", probs).collect()}
    local = skewed.toPandas()
    for group, rows in local.groupby("g"):
        assert got[group].n == len(rows)
        for name, p in probs.items():
            assert got[group][name] == pytest.approx(np.quantile(rows["v"], p))


def test_first_rows_is_the_ordered_head(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS id")
    got = [r.id for r in first_rows(df, "id", 20).collect()]
    assert sorted(got) == list(range(20))


@pytest.mark.parametrize("n", [0, 1, 7, 400, 401, 1000])
def test_first_rows_with_nulls_ties_and_few_rows(spark, n):
    values = [None] * 5 + [v // 3 for v in range(395)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(6)
    got = [r.v for r in first_rows(df, "v", n).collect()]
    order = lambda v: (v is not None, v or 0)
    assert sorted(got, key=order) == values[:n]
    assert first_rows(df.filter("i < 0"), "v", n).collect() == []


def test_quantiles_move_only_values_near_them(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate(
        [rng.normal(size=4000) * 1e6, [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], rng.random(4000) * 1e-9]
    )
    df = spark.createDataFrame([(None, float(v)) for v in values], "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    assert runs_near(df, ["g"], "v", probs).count() < 400
    (got,) = exact_quantiles(df, ["g"], "v", probs).collect()
    assert got.n == len(values)
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    endless = spark.createDataFrame([(float(v),) for v in ("-inf", 1, 2, "inf", "nan")], "v double")
    (row,) = exact_quantiles(endless, [], "v", {"q": 0.25, "h": 0.5}).collect()
    assert (row.q, row.h, row.n) == (1.0, 2.0, 5)
