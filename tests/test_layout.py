"""Tables along a curve, and tables under a tree of digests."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from sparkelt.operators.layout import BITS, CELL, _search_tree, cells_within, curve_position, read_clustered, write_clustered
from sparkelt.operators.lineage import changed_ranges, changed_rows, write_by_digest
from sparkelt.sources.files import read_kept


def test_search_tree():
    cuts = list(range(2 ** BITS - 1))
    tree = _search_tree(cuts)
    for wanted in (0, 1, 77, 254):
        node = 0
        while tree[node] != wanted:
            node = 2 * node + (1 if wanted < tree[node] else 2)
        assert tree[node] == wanted


def test_place_on_the_curve_is_the_bits_of_all_ranks(spark):
    df = spark.range(2 ** BITS * 8).selectExpr("id AS a", "-id AS b")
    for r in df.withColumn("place", curve_position(df, ["a", "b"])).where("a % 97 = 0").collect():
        first = sum((r["place"] >> (2 * i) & 1) << i for i in range(BITS))
        second = sum((r["place"] >> (2 * i + 1) & 1) << i for i in range(BITS))
        assert abs(first - r["a"] // 8) <= 1 and abs(first + second - 255) <= 2


@pytest.fixture
def mixed(spark):
    return spark.range(20_000).select(
        F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("n"),
        F.date_add(F.lit(datetime.date(2020, 1, 1)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).cast("int")).alias("d"),
        F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9000))).alias("t"),
        F.when(F.col("id") % 40 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 77).alias("x"), "id")


@pytest.mark.parametrize("ranges", [
    {"n": (100, 150)}, {"d": (datetime.date(2020, 3, 1), datetime.date(2020, 3, 31))}, {"n": (900, None)},
    {"n": (100, 300), "d": (None, datetime.date(2020, 3, 31))}])
def test_reads_few_cells_and_all_rows(spark, mixed, tmp_path, ranges):
    path = str(tmp_path / "t.parquet")
    write_clustered(mixed, path, ["n", "d"], cells=64)
    cells, total = cells_within(spark, path, ranges)
    assert total == 64 and 3 * len(cells) < total
    found = read_clustered(spark, path, ranges)
    want = mixed
    for name, (low, high) in ranges.items():
        want = want.where(F.lit(True) if low is None else F.col(name) >= F.lit(low))
        want = want.where(F.lit(True) if high is None else F.col(name) <= F.lit(high))
    assert rows(found, "id", "n", "d", "t") == rows(want, "id", "n", "d", "t") and found.columns == mixed.columns
    assert f"PartitionFilters: [{CELL}" in plan(found) or "PartitionFilters: [isnotnull" in plan(found)
    assert rows(spark.read.parquet(path).drop(CELL).select("id")) == rows(mixed.select("id"))


def test_texts_numbers_and_filters_on_other_columns(spark, mixed, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_clustered(mixed, path, ["t", "x"], cells=16)
    assert rows(read_clustered(spark, path, {"t": ("k10", "k12")}), "id") == rows(mixed.where("t >= 'k10' AND t <= 'k12'"), "id")
    assert rows(read_clustered(spark, path, {"x": (70.0, None)}), "id") == rows(mixed.where("x >= 70"), "id")
    assert cells_within(spark, path, {"id": (0, 1)})[0] == list(range(16))
    assert rows(read_clustered(spark, path, {"id": (0, 1)}), "id") == [(0,), (1,)]
    assert rows(read_clustered(spark, path, {"x": (1e9, None), "t": ("a", "b")})) == []


def test_a_place_with_half_of_the_rows_fills_many_cells(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.range(20_000).selectExpr("IF(id % 2 = 0, 7, id) AS a", "IF(id % 2 = 0, 7, id) AS b", "id")
    write_clustered(df, path, ["a", "b"], cells=20)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(CELL).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2_500


def test_layout_of_nothing(spark, tmp_path):
    for name, df in (("empty", spark.range(0).selectExpr("id AS a", "id AS b")),
                     ("null", spark.range(3).selectExpr("CAST(NULL AS INT) AS a", "id AS b"))):
        path = str(tmp_path / name)
        write_clustered(df, path, ["a", "b"], cells=4)
        assert rows(read_clustered(spark, path, {})) == rows(df)
        assert rows(read_clustered(spark, path, {"a": (1, 2)})) == []
    with pytest.raises(ValueError):
        write_clustered(spark.range(3).withColumnRenamed("id", CELL), str(tmp_path / "x"), [CELL])
    with pytest.raises(ValueError):
        curve_position(spark.range(3), [])
    with pytest.raises(TypeError):
        curve_position(spark.range(3).select(F.array("id").alias("a")), ["a"])


# -- trees of digests -------------------------------------------------------

def kept(df, folder, name, **options):
    path = str(Path(folder) / name)
    write_by_digest(df, path, **options)
    return path


def test_equal_tables_cost_their_tops(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0.0D, -0.0D) AS zero", "concat('t', id) AS t")
    old = kept(df, tmp_path, "old")
    new = kept(df.orderBy(F.desc("id")).withColumn("zero", F.lit(0.0)), tmp_path, "new")
    assert changed_ranges(spark, old, new) == []
    assert rows(changed_rows(spark, old, new)) == []
    tree = spark.read.parquet(old + "/_tree")
    assert {r["count"]: r["node"] for r in tree.groupBy(F.length("node").alias("node")).count().collect()} == {1: 1, 16: 2, 256: 3}
    assert tree.where("node = 'r'").first()["row_count"] == 3000


@pytest.mark.parametrize("digits", [1, 2])
def test_changes_are_named_and_only_their_ranges_read(spark, tmp_path, digits):
    df = spark.range(2000).selectExpr("id", "IF(id % 9 = 0, NULL, concat('t', id)) AS t")
    changed = df.where("id <> 5").withColumn("t", F.when(F.col("id") == 9, "new").otherwise(F.col("t"))).union(df.where("id = 7")).union(
        df.where("id = 7"))
    old, new = kept(df, tmp_path, "old", digits=digits), kept(changed, tmp_path, "new", digits=digits)
    found = changed_rows(spark, old, new)
    assert rows(found, "id", "t", "change", "copies") == [
        (5, "t5", "removed", 1), (7, "t7", "added", 2), (9, "new", "added", 1), (9, None, "removed", 1)]
    assert {r["range"] for r in found.collect()} == set(changed_ranges(spark, old, new))
    assert "PartitionFilters: [_range" in plan(found)


def test_a_row_with_very_many_copies(spark, tmp_path):
    df = spark.range(30_000).selectExpr("IF(id < 20000, 1, id) AS a")
    old, new = kept(df, tmp_path, "old", digits=1), kept(df.where("a > 1"), tmp_path, "new", digits=1)
    assert rows(changed_rows(spark, old, new), "change", "copies", "a") == [("removed", 20_000, 1)]


def test_trees_of_nothing(spark, tmp_path):
    df = spark.range(3)
    some, none = kept(df, tmp_path, "some"), kept(df.where("id < 0"), tmp_path, "none")
    assert rows(changed_rows(spark, none, some), "change", "id") == [("added", 0), ("added", 1), ("added", 2)]
    assert changed_ranges(spark, none, none) == [] and rows(changed_rows(spark, none, none)) == []
    assert read_kept(spark, none).count() == 0
    with pytest.raises(ValueError):
        changed_ranges(spark, some, kept(df, tmp_path, "other", digits=1))
    with pytest.raises(ValueError):
        changed_rows(spark, some, kept(df.withColumnRenamed("id", "i"), tmp_path, "named"))
    with pytest.raises(ValueError):
        write_by_digest(df.withColumnRenamed("id", "_range"), str(tmp_path / "x"))
