import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import plan, rows
from sparkelt.operators.quality import (
    append_version, batch_hashes, dedup_by_hash, dedup_by_key, latest_version, new_batches, normalise_nulls, reprocess,
    split_quarantine, try_cast_schema)
from sparkelt.sources.files import parse_lines, read_dataset, write_dataset


def test_null_words(spark):
    df = spark.createDataFrame([(1, " N/A "), (2, "NULL"), (3, ""), (4, "nan"), (5, "nah"), (6, None), (7, " x ")], "i int, t string")
    assert [r["t"] for r in normalise_nulls(df).orderBy("i").collect()] == [None, None, None, None, "nah", None, " x "]
    assert normalise_nulls(df.select("i")).columns == ["i"]


def test_try_cast(spark):
    df = spark.createDataFrame([("12", "1.5", "2024-02-29"), ("x", "y", "2024-02-30"), (None, "", "")], "a string, b string, c string")
    out = try_cast_schema(df, StructType.fromDDL("a long, b double, c date"))
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "date"}
    assert [tuple(r)[:2] for r in out.collect()] == [(12, 1.5), (None, None), (None, None)]
    with pytest.raises(ValueError):
        try_cast_schema(df, StructType.fromDDL("z int"))


def test_dedup_by_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (None, 1, "n"), (None, 1, "m"), (1, 2, "a")], "k int, t int, v string")
    assert rows(dedup_by_key(df, ["k"], ["t"])) == [(1, 2, "a"), (2, 9, "z"), (None, 1, "m")]
    assert rows(dedup_by_key(df, ["k"], ["t"], keep="last"))[0] == (1, 3, "c")
    assert dedup_by_key(df, ["k", "t", "v"], []).count() == 6
    assert dedup_by_key(df.limit(0), ["k"], ["t"]).count() == 0


def test_dedup_keeps_one_row_per_key_before_the_shuffle(tables):
    kept = dedup_by_key(tables["lineitem"], ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    before, after = plan(kept).split("Exchange hashpartitioning")
    assert "Partial" in after and "WindowGroupLimit" in after and "Final" in before


def test_dedup_by_hash(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, "a")], "i int, a string, b string")
    assert [r[0] for r in rows(dedup_by_hash(df, ["a", "b"], ["i"]))] == [1, 3, 4]


def rules():
    return {"positive": F.col("v") > 0, "named": F.col("n").isNotNull()}


def test_rows_that_differ_by_a_microsecond_are_kept(spark):
    df = spark.sql("SELECT id, timestamp_micros(1000 + id) AS t, 'x' AS `a.b` FROM range(3)")
    assert dedup_by_hash(df, ["t", "a.b"], order=["id"]).count() == 3
    assert dedup_by_key(df, ["a.b"], order=["id"]).count() == 1


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, "b"), (5, None)], "v int, n string")
    good, bad = split_quarantine(df, rules())
    assert rows(good) == [(1, "a")]
    assert rows(bad) == [(-1, None, ["positive", "named"]), (5, None, ["named"]), (None, "b", ["positive"])]
    fixed, still = reprocess(bad, lambda d: d.withColumn("n", F.coalesce("n", F.lit("?"))), rules())
    assert rows(fixed) == [(5, "?")] and rows(still, "v", "errors") == [(-1, ["positive"]), (None, ["positive"])]


def test_parse_lines(spark):
    schema = StructType.fromDDL("a long, b string")
    text = spark.createDataFrame([("a,b",), ("1,x",), ("oops,y",), ("2,z,extra",)], "value string")
    good, bad = parse_lines(text, schema, "csv", header="a,b")
    assert rows(good) == [(1, "x")] and rows(bad, "raw") == [("2,z,extra",), ("oops,y",)]
    good, bad = parse_lines(spark.createDataFrame([('{"a": 1}',), ('{"a":',)], "value string"), schema, "json")
    assert rows(good) == [(1, None)] and rows(bad) == [('{"a":', "unparseable json record")]


def test_repeated_batches(spark):
    one, two = [(1, "x"), (2, "y")], [(5, "q"), (5, "q")]
    df = spark.createDataFrame([("b1", *r) for r in one] + [("b2", *r) for r in reversed(one)] + [("b3", *r) for r in two]
                               + [("b4", 5, "q")], "batch string, k int, v string")
    hashes = dict(rows(batch_hashes(df, "batch")))
    assert hashes["b1"] == hashes["b2"] and len(set(hashes.values())) == 3
    ledger = spark.createDataFrame([(hashes["b4"],)], "content_hash string")
    accepted, entries = new_batches(df, ledger, "batch")
    assert rows(accepted.groupBy("batch").count()) == [("b1", 2), ("b3", 2)]
    assert rows(entries) == [("b1", hashes["b1"]), ("b3", hashes["b3"])]
    none, _ = new_batches(df, ledger.union(entries.select("content_hash")), "batch")
    assert none.count() == 0


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    append_version(spark.range(3), path, 1)
    append_version(spark.range(5), path, 12)
    append_version(spark.range(5), path, 12)  # as after a retry
    assert spark.read.parquet(path).count() == 8
    latest = latest_version(spark, path)
    assert latest.count() == 5 and "PartitionFilters: [isnotnull(version" in plan(latest)


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    write_dataset(spark.range(10).selectExpr("id", "id % 2 AS part"), path, partition_by=["part"], compression="zstd")
    write_dataset(spark.createDataFrame([(99, 1)], "id long, part long"), path, partition_by=["part"], replace_partitions=True)
    assert [r[0] for r in rows(read_dataset(spark, path), "id")] == [0, 2, 4, 6, 8, 99]
    assert "PartitionFilters: [isnotnull(part" in plan(read_dataset(spark, path).where("part = 1"))


def test_zeros_of_both_signs_are_one_value(spark):
    from sparkelt.operators.audit import fingerprint

    kind = "k int, v double, a array<float>, s struct<x: double>, m map<string, double>"
    plus = spark.createDataFrame([(1, 0.0, [0.0, None], (0.0,), {"x": 0.0})], kind)
    minus = spark.createDataFrame([(1, -0.0, [-0.0, None], (-0.0,), {"x": -0.0})], kind)
    assert fingerprint(plus).collect() == fingerprint(minus).collect()
    assert dedup_by_hash(plus.union(minus), ["v", "a", "s"], order=["k"]).count() == 1
    nan = spark.createDataFrame([(1, float("nan"), None, None, None)], kind)
    assert fingerprint(nan).collect() != fingerprint(plus).collect()
