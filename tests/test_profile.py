import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from sparkelt.operators.profile import (
    aggregate_series, box_stats, chart_dataset, chart_frame, chart_payload, correlation_matrix, describe_numeric, exact_quantiles,
    histogram, kde_grid, regression_trend, rollup_first, rollup_sums, scatter_points, summary_stats)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("Electronics", 150.0, "Completed"), ("Clothing", 50.0, "Pending"), ("Electronics", 200.0, "Completed"),
         ("Home", 75.0, "Refunded"), ("Clothing", 25.0, "Completed"), ("Electronics", 100.0, "Completed")],
        "category string, amount double, status string")


def test_summary(sales):
    assert summary_stats(sales, "amount").first().asDict() == {
        "count": 6, "sum": 600.0, "mean": 100.0, "min": 25.0, "max": 200.0, "std": 65.19}


@pytest.mark.parametrize("column", ["category", "missing"])
def test_summary_of_no_numbers(sales, column):
    assert tuple(summary_stats(sales, column).first()) == (6, 0, 0, 0, 0, 0)


def test_summary_edges(spark):
    values = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert tuple(summary_stats(values, "v").first())[:3] == (2, 4.0, 2.0)
    assert tuple(summary_stats(values.limit(0), "v").first()) == (0, 0, 0, 0, 0, 0)
    assert summary_stats(spark.createDataFrame([(5,)], "v long"), "v").first()["std"] == 0.0
    flags = spark.createDataFrame([(True,)], "v boolean")
    assert tuple(summary_stats(flags, "v").first()) == (1, 0, 0, 0, 0, 0)
    big = spark.createDataFrame([(2**62,), (2**62,)], "v long")
    assert summary_stats(big, "v").first()["sum"] == float(2**63)


@pytest.mark.parametrize("x, y, measure, first", [
    ("category", "amount", "SUM", ("Electronics", 450.0)), ("category", "amount", "AVG", ("Electronics", 150.0)),
    ("status", "amount", "COUNT", ("Completed", 4.0)), ("category", "amount", "MIN", ("Electronics", 100.0)),
    ("category", "amount", "max", ("Electronics", 200.0)), ("status", "category", "SUM", ("Completed", 4.0)),
    ("category", "amount", "other", ("Electronics", 450.0)),
])
def test_series(sales, x, y, measure, first):
    assert tuple(aggregate_series(sales, x, y, measure).first()) == first


def test_series_of_raw_points(sales):
    points = aggregate_series(sales, "category", "amount", "NONE", order=[F.col("amount").desc()]).collect()
    assert len(points) == 6 and tuple(points[0]) == ("Electronics", 200.0)
    assert {r["value"] for r in aggregate_series(sales, "category", "status", "NONE", order=["amount"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        aggregate_series(sales, "category", "amount", "NONE")


def test_series_drops_nulls(spark):
    gaps = spark.createDataFrame(
        [("a", 1.0), ("a", None), (None, 5.0), ("b", float("nan")), ("b", 2.0)], "x string, y double")
    assert rows(aggregate_series(gaps, "x", "y", "COUNT")) == [("a", 1.0), ("b", 1.0)]
    assert rows(aggregate_series(gaps, "x", "y", "AVG")) == [("a", 1.0), ("b", 2.0)]
    assert aggregate_series(gaps.limit(0), "x", "y").count() == 0


def test_histogram(spark, sales):
    bins = histogram(sales, "amount", 4).orderBy("bin").collect()
    assert sum(b["n"] for b in bins) == 6 and [b["n"] for b in bins] == [2, 2, 1, 1]
    assert (bins[0]["lower"], bins[-1]["upper"]) == (25.0, 200.0)
    same = spark.createDataFrame([(10.0,)] * 3, "val double")
    assert rows(histogram(same, "val"), "bin", "lower", "n") == [(0, 10.0, 3)]
    assert histogram(same.limit(0), "val").count() == 0
    gap = spark.createDataFrame([(0,), (1,), (10,), (None,)], "v int")
    assert [r["n"] for r in histogram(gap, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert histogram(sales, "category").collect() == []


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(params=["broadcast", "shuffled"])
def either(request):
    """The joins of a plan by broadcast, and by shuffle alone."""
    if request.param == "shuffled":
        request.getfixturevalue("all_large")


def test_exact_quantiles_against_brute_force(spark, either):
    draw = random.Random(7)
    groups = {
        "normal": [draw.gauss(0, 50) for _ in range(997)],
        "skewed": [draw.lognormvariate(0, 9) for _ in range(500)],
        "copies": [3.0] * 400 + [4.0] * 3 + [-1.0],
        "one": [2.5],
        "narrow": [1.7e9 + draw.random() for _ in range(300)],
        "signs": [-1e300, -1e-300, 0.0, 1e-300, 1e300, 5.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))],
                               "g string, v double")
    chosen = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r["g"]: r for r in exact_quantiles(df, "g", "v", chosen).collect()}
    assert {g: r["n"] for g, r in got.items()} == {g: len(v) for g, v in groups.items()}
    for g, values in groups.items():
        assert [got[g][f"q{i}"] for i in range(len(chosen))] == [quantile(values, p) for p in chosen], g


def test_wide_bands_are_cut(spark, either):
    """Values so close that they share one band, and copies that no cut can part."""
    draw = random.Random(1)
    groups = {"close": [1e9 + draw.random() for _ in range(500)], "copies": [2.0] * 300 + [2.0000001] * 10,
              "wide": [draw.lognormvariate(0, 5) for _ in range(200)], "negative": [-5.0 - draw.random() / 1e6 for _ in range(100)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    chosen = (0.0, 0.3, 0.5, 0.97)
    for r in exact_quantiles(df, "g", "v", chosen).collect():
        assert [r[f"q{i}"] for i in range(4)] == [quantile(groups[r["g"]], p) for p in chosen], r["g"]


def test_box(spark, either):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100, -90]] + [("b", 7.0)], "x string, y double")
    assert rows(box_stats(df, "x", "y")) == [("a", 7, 1.5, 3.0, 4.5, 1.0, 5.0, 2), ("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)]


def test_quantiles_and_boxes_run_nothing_when_planned(spark, all_large):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planned", "")
    df = spark.range(100).selectExpr("id % 7 AS g", "CAST(id AS DOUBLE) AS v")
    planned = box_stats(df, "g", "v")
    assert not tracker.getJobIdsForGroup("planned")
    assert planned.count() == 7
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["n", "q1", "a.b", "outliers"])
def test_groups_with_awkward_names(spark, name):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], f"`{name}` string, v double")
    assert [r[name] for r in box_stats(df, name, "v").collect()] == ["a"]
    got = exact_quantiles(df, name, "v", (0.5,)).first()
    assert got[name] == "a" and 2.0 in tuple(got) and 2 in tuple(got)
    assert rollup_sums(df).count() == 1


def test_kde_against_brute_force(spark):
    values = [1.0, 2.0, 2.0, 3.5, 9.0]
    got = kde_grid(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", 9).orderBy("point").collect()
    mean = sum(values) / 5
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / 4) * 5 ** -0.2
    for r in got:
        want = sum(math.exp(-0.5 * ((r["x"] - v) / width) ** 2) for v in values) / (5 * width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=1e-12)
    assert [got[0]["x"], got[-1]["x"]] == [1.0, 9.0]
    for rows_without_density in ([(4.0,)] * 3, [(4.0,)], [(None,)], []):
        assert kde_grid(spark.createDataFrame(rows_without_density, "v double"), "v").count() == 0
    one = kde_grid(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v", 1).collect()
    assert [(r["point"], r["x"]) for r in one] == [(0, 1.0)]


def test_describe_correlation_regression_scatter(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 4.0, "b"), (3, 6.0, None), (4, None, "c")], "i int, d double, s string")
    got = {r["column"]: r for r in describe_numeric(df).collect()}
    assert got["i"]["count"] == 4 and got["i"]["q25"] == 1.75 and got["d"]["median"] == 4.0 and got["d"]["max"] == 6.0
    assert rows(correlation_matrix(df, ["i", "d"])) == [("i", "d", pytest.approx(1.0))]
    line = regression_trend(df, "i", "d").first()
    assert (line["n"], line["slope"], line["intercept"]) == (3, pytest.approx(2.0), pytest.approx(0.0))
    assert scatter_points(df, "i", "d").count() == 3
    gaps = df.withColumn("none.at.all", F.lit(None).cast("double"))
    got = {r["column"]: r for r in describe_numeric(gaps).collect()}
    assert got["none.at.all"]["count"] == 0 and got["none.at.all"]["median"] is None and got["i"]["median"] == 2.5
    assert {r["column"]: r["count"] for r in describe_numeric(df.limit(0)).collect()} == {"i": 0, "d": 0}
    assert correlation_matrix(df, ["i"]).count() == 0
    assert describe_numeric(df.select("s")).count() == 0


def test_chart(sales):
    series = aggregate_series(sales, "category", "amount")
    chart = json.loads(chart_payload(series, "BAR", "Sales").first()["payload"])
    assert chart["type"] == "bar" and chart["data"]["labels"] == ["Electronics", "Clothing", "Home"]
    assert chart["data"]["datasets"][0]["data"] == [450.0, 75.0, 75.0]
    both = chart_dataset(sales, "category", "amount")
    assert both.where("kind = 'stat'").count() == 6 and both.where("kind = 'series'").count() == 3


def test_chart_frames(sales):
    kinds = {"histogram": {"bin", "lower", "upper", "n"}, "BOX": {"category", "n", "q1", "median", "q3", "whisker_low",
             "whisker_high", "outliers"}, "scatter": {"x", "y"}, "LINE": {"label", "value"}, "bar": {"label", "value"}}
    for kind, columns in kinds.items():
        assert set(chart_frame(sales, kind, "category", "amount").columns) == columns
    assert chart_frame(sales, "HISTOGRAM", "amount", "category", bins=4).count() == 4


def test_rollups(spark, sales):
    assert rows(rollup_sums(sales)) == [("Clothing", 75.0), ("Electronics", 450.0), ("Home", 75.0)]
    assert rows(rollup_first(sales))[1] == ("Electronics", 3, 150.0, 450.0)
    assert rollup_sums(sales.select("amount")).columns[0] == "column"
    assert rows(rollup_sums(sales.select("category"))) == [("category", 6, 3, "Electronics", 3)]
    assert rows(rollup_sums(sales.select("category").limit(0))) == [("category", 0, 0, None, None)]
    assert rollup_first(sales.select("category"), order=["category"]).count() == 6
    with pytest.raises(ValueError):
        rollup_first(sales.select("category"))


def test_profiles_read_only_their_columns(tables):
    text = plan(summary_stats(tables["lineitem"], "l_tax"))
    assert "ReadSchema: struct<l_tax:double>" in text and "BatchEvalPython" not in text


def test_quantiles_of_columns_against_numpy(spark):
    import numpy as np

    from sparkelt.operators.profile import column_quantiles, _band_codes, _band_start

    draw = np.random.default_rng(5)
    columns = [draw.standard_normal(3000), draw.integers(-3, 4, 3000).astype(float), np.exp(draw.standard_normal(3000) * 40), -np.abs(draw.standard_normal(3000)) * 1e-310,
               np.full(3000, 7.5), np.where(draw.random(3000) < 0.5, 0.0, -0.0)]
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*columns)], ", ".join(f"_{i} double" for i in range(6))).repartition(7)
    got = {r["c"]: tuple(r)[1:] for r in column_quantiles(df, (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for c, values in enumerate(columns):
        assert got[c] == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist(), rel=1e-12, abs=0)
    some = np.sort(np.concatenate([*columns, [np.inf, -np.inf, 1e308, -1e308]]))
    codes = _band_codes(some)
    assert (np.diff(codes) >= 0).all() and all(_band_start(int(k)) <= v for k, v in zip(codes, some) if np.isfinite(v))
    assert column_quantiles(df.limit(0), (0.5,)).collect() == []
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "_0 double")
    assert tuple(column_quantiles(ends, (0.0, 0.5, 1.0)).first())[1:] == (float("-inf"), 1.0, float("inf"))


def test_description_has_no_row_per_value(spark):
    text = plan(describe_numeric(spark.range(100).selectExpr("id", "id * 0.5D AS half")))
    assert "Expand" not in text and "Generate" not in text.split("MapInArrow")[-1]


def test_density_is_truncated_without_loss(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    values = np.concatenate([draw.standard_normal(3000), 1e6 + draw.standard_normal(5)])
    got = kde_grid(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 50).orderBy("point").collect()
    width = values.std(ddof=1) * len(values) ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - values) / width) ** 2).sum() / (len(values) * width * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, rel=1e-12, abs=1e-300)
