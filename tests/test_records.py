"""Signed runs, capacity, sizes and fingerprints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sparkelt.operators.audit import fingerprint, lineage_signature, sign, verify
from sparkelt.operators.capacity import (
    capacity_columns, capacity_documented, size_bound_flag, size_estimate, tier_column)
from sparkelt.plans.runlog import run_transform

RUN = ("timestamp double, tenant_id string, project_id string, user_id string, engine string, code string, row_count long, "
       "duration_ms double, capacity_units double, status string")


@pytest.fixture
def run(spark):
    return spark.createDataFrame(
        [(1650000000.25, "north", "tides", "mira", "sql", "SELECT MAX(x) FROM data", 41, 7.125, 0.03206, "succeeded")], RUN)


@pytest.mark.parametrize("key", [None, "tenant-key"])
def test_sign_and_verify(run, key):
    signed = sign(run, key)
    assert verify(signed, key).first()["valid"]
    for changed in ({"row_count": F.lit(999)}, {"code_hash": F.lit("0")}, {"status": F.lit("failed")}, {"user_id": F.lit(None)}):
        assert not verify(signed.withColumns(changed), key).first()["valid"]
    assert not verify(signed, "other key").first()["valid"]


def test_signature_text(run):
    code = hashlib.sha256(b"SELECT MAX(x) FROM data").hexdigest()
    payload = f"1650000000.250000:north:tides:mira:sql:{code}:41:7.13:0.0321:succeeded"
    assert sign(run).first()["manifest_signature"] == hashlib.sha256(payload.encode()).hexdigest()


def test_a_null_field_keeps_its_place(run):
    moved = run.withColumns({"tenant_id": F.lit(None).cast("string"), "project_id": F.lit("x")})
    other = run.withColumns({"tenant_id": F.lit("x"), "project_id": F.lit(None).cast("string")})
    assert sign(moved).first()["manifest_signature"] != sign(other).first()["manifest_signature"]


def test_a_missing_signature_is_not_valid(run):
    gone = sign(run).withColumn("manifest_signature", F.lit(None).cast("string"))
    assert gone.select("status").count() == 1 and verify(gone).where("valid").count() == 0
    assert verify(gone).where("NOT valid").count() == 1


def test_fields_cannot_borrow_from_each_other_under_a_key(run):
    def signed(**fields):
        return sign(run.withColumns({k: F.lit(v).cast("string") for k, v in fields.items()}), "k").first()["manifest_signature"]
    assert signed(tenant_id="a:b", project_id="c") != signed(tenant_id="a", project_id="b:c")
    assert signed(project_id=None) != signed(project_id="")


def test_lineage_signature(spark):
    df = spark.createDataFrame([("i", "o", "c"), ("i", "o2", "c")], "i string, o string, c string")
    signed = df.select(lineage_signature(F.col("i"), F.col("o"), F.col("c"), "k").alias("s")).distinct()
    assert signed.count() == 2


def test_fingerprint(spark):
    df = spark.range(100).selectExpr("id", "id * 1.5D AS v", "concat('n', id) AS n")
    same = fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert fingerprint(df).first() == same
    changed = df.withColumn("v", F.when(F.col("id") == 50, -1.0).otherwise(F.col("v")))
    assert fingerprint(changed).first()["content_hash"] != same["content_hash"]
    assert fingerprint(df.union(df.limit(1))).first()["content_hash"] != same["content_hash"]
    assert fingerprint(df.limit(0)).first()["row_count"] == 0


def test_fingerprints_see_microseconds_in_any_time_zone(spark):
    text = "SELECT timestamp_micros({}) AS t, array(named_struct('m', map('k', timestamp_micros({}), 'a', timestamp_micros(5)))) AS deep"
    one, two = (fingerprint(spark.sql(text.format(n, m))).first() for n, m in ((10, 20), (10, 21)))
    assert one != two and one != fingerprint(spark.sql(text.format(11, 20))).first()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert fingerprint(spark.sql(text.format(10, 20))).first() == one
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_run_log_is_stored(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "log")
    for code in ("SELECT COUNT(*) AS n FROM data", "DROP TABLE data"):
        record = run_transform(df, "sql", code, tenant="t", log_path=path)[2]
        assert record.count() == 1
    assert rows(spark.read.parquet(path), "status") == [("failed",), ("succeeded",)]
    assert verify(spark.read.parquet(path)).where("valid").count() == 2


def test_capacity(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 1.0, "TIER_0_EMBEDDED"), (2, 2000.0, 50.0, "TIER_0_EMBEDDED"), (3, 1500.0, 5.0, "TIER_1_SPARK"),
         (4, 0.0, 0.0, "TIER_0_EMBEDDED")], "i int, duration_ms double, memory_mb double, tier string")
    out = [tuple(r) for r in capacity_columns(df).orderBy("i").select(
        *[F.col(c).cast("double") for c in ("capacity_units", "spark_equivalent_cu", "cost_avoidance_usd")], "governor_action").collect()]
    assert out == [
        (0.0005, 2.5, 0.0006, "ECONOMIC_TIER_0 (Saved 2.5 CU)"), (0.1, 5.0, 0.049, "ECONOMIC_TIER_0 (Saved 5 CU)"),
        (3.75, 3.75, 0.0, "SCALED_TO_DISTRIBUTED_SPARK"), (0.00001, 2.5, 0.0, "ECONOMIC_TIER_0 (Saved 2.5 CU)")]


def test_tiers(spark):
    df = spark.createDataFrame([(3, 0.1, None), (5000, 0.1, "auto"), (3, 0.1, "PySpark"), (3, 2000.0, None)],
                               "n long, mb double, engine string")
    tier = tier_column(F.col("n"), F.col("mb"), F.col("engine"), row_threshold=1000)
    assert [r[0] for r in df.select(tier).collect()] == ["TIER_0_EMBEDDED", "TIER_1_SPARK", "TIER_1_SPARK", "TIER_1_SPARK"]
    assert [r[0] for r in df.select(size_bound_flag(F.col("mb"), 900)).collect()] == [False, False, False, True]
    assert df.select(capacity_documented(F.lit(2_000_000), F.lit(120), F.lit("TIER_1_SPARK"))).first()[0] == 4.0


def test_size(spark):
    df = spark.createDataFrame([(1, "ab", True, [1, 2]), (2, None, None, None)], "i int, s string, b boolean, a array<int>")
    size = size_estimate(df).first()
    assert (size["row_count"], size["column_count"], size["bytes"]) == (2, 4, 2 * 5 + 2 + len('{"a":[1,2]}') + len("{}"))
    assert size_estimate(df.limit(0)).first()["size_mb"] == 0.01


def test_run_records(spark):
    df = spark.createDataFrame([(10.0, "Book"), (50.0, "Electronics"), (150.0, "Electronics"), (200.0, "Home")],
                               "amount double, category string")
    result, sample, record = run_transform(df, "filter", "amount > 100 and category == 'Electronics'", "t1")
    assert rows(result) == [(150.0, "Electronics")] and sample.count() == 1
    row = verify(record).first()
    assert (row["status"], row["row_count"], row["valid"], row["error"]) == ("succeeded", 1, True, None)
    result, _, record = run_transform(df, "function", "squares", "t1", function=lambda d: d.selectExpr("amount * amount AS s"))
    assert result.count() == 4 and record.first()["row_count"] == 4
    _, sample, _ = run_transform(df, "sql", "SELECT * FROM data", "t1", limit=2, order=["amount"])
    assert [r["amount"] for r in sample.collect()] == [10.0, 50.0]


def test_a_run_can_write_its_result(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    result, _, record = run_transform(spark.range(9), "filter", "id > 3", "t1", path=path)
    assert result.inputFiles()[0].startswith(f"file://{path}") and record.first()["row_count"] == 5


@pytest.mark.parametrize("engine, code", [("sql", "DELETE FROM data"), ("filter", "password == 'x'"), ("cobol", "x")])
def test_failed_run_leaves_a_record(spark, engine, code):
    result, sample, record = run_transform(spark.range(3), engine, code, "t1")
    row = verify(record).first()
    assert result is None and sample is None and row["status"] == "failed" and row["valid"]
    assert row["row_count"] == 0 and row["capacity_units"] == 0 and row["error"]
