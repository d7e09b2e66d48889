import pytest

from conftest import plan, rows
from sparkelt.operators import relational
from sparkelt.operators.relational import (
    hot_keys, join_frames, left_and_right, sample_with_total, top_k, transform_columns, union_frames)

KINDS = ("inner", "left", "right", "outer", "left_semi", "left_anti")


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "user_id long, name string")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(101, 1, 250.0), (102, 2, 150.0)], "order_id long, user_id long, amount double")


def test_transform_order_and_unknown_names(users):
    out = transform_columns(users, ["user_id", "name"], {"user_id": "id", "nothing": "x"}, ["name", "nothing"])
    assert out.columns == ["id"]
    assert transform_columns(users, rename={"user_id": "id"}, drop=["user_id"]).columns == ["id", "name"]
    with pytest.raises(ValueError, match="nothing"):
        transform_columns(users, select=["nothing"])


def test_inner_join(users, orders):
    joined = join_frames(users, orders, "user_id")
    assert rows(joined, "user_id", "name", "amount") == [(1, "Alice", 250.0), (2, "Bob", 150.0)]


@pytest.mark.parametrize("how, count", [("inner", 2), ("left", 3), ("right", 3), ("outer", 4), ("semi", 2), ("anti", 1)])
@pytest.mark.parametrize("salted", [False, True])
def test_null_and_repeated_keys(spark, how, count, salted):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "z")], "k long, v string")
    joined = join_frames(left, right, "k", how, always_salt=salted, hot_share=0.3, salts=3,
                         hot_sides=("left", "right"))
    assert joined.count() == count
    if how not in ("semi", "anti"):
        assert joined.columns == ["k", "v_x", "v_y"]


@pytest.fixture
def skewed(spark):
    """Both sides have a hot key, hot null keys, plain keys and keys of their own; the left has copies."""
    left = spark.range(3000).selectExpr(
        "CASE WHEN id < 1000 THEN 7 WHEN id < 1500 THEN NULL ELSE id % 300 END AS k", "id % 3 AS lv")
    right = spark.range(120).selectExpr(
        "CASE WHEN id < 40 THEN 9 WHEN id < 50 THEN NULL ELSE id * 5 END AS k", "id AS rv")
    return left, right.unionByName(spark.sql("SELECT 7L AS k, -1L AS rv UNION ALL SELECT 9999L, -2L"))


@pytest.mark.parametrize("how", KINDS)
def test_salting_changes_no_row(skewed, how):
    left, right = skewed
    plain = left.join(right.select("k") if how in ("left_semi", "left_anti") else right, "k", how)
    salted = join_frames(left, right, "k", how, hot_share=0.05, salts=5, always_salt=True,
                         hot_sides=("left", "right"))
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)


def test_salting_spreads_the_hot_key(skewed):
    left, right = skewed
    salted = join_frames(left, right, "k", "inner", hot_share=0.05, salts=5, always_salt=True,
                         hot_sides=("left", "right"))
    assert "_sl" in plan(salted) and rows(hot_keys(left, ["k"], 0.05)) == [(7,)]


def test_what_adaptive_execution_cannot_split_is_salted(spark, skewed, all_large):
    for how in KINDS:
        salted = "_sl" in plan(join_frames(*skewed, "k", how))
        assert salted is (how in ("left", "right", "outer"))
        assert "_sl" in plan(join_frames(*skewed, "k", how, hot_sides=("left", "right")))
        assert "_sl" not in plan(join_frames(*skewed, "k", how, hot_share=None))
    assert plan(join_frames(*skewed, "k", "semi")).count("Exchange hashpartitioning(k") == 3


@pytest.mark.parametrize("how", KINDS)
def test_default_joins_of_large_tables_change_no_row(skewed, all_large, how):
    left, right = skewed
    assert rows(join_frames(left, right, "k", how)) == rows(
        left.join(right.select("k") if how in ("left_semi", "left_anti") else right, "k", how))


@pytest.mark.parametrize("how", KINDS)
def test_small_sides_are_not_salted(skewed, how):
    assert "_sl" not in plan(join_frames(*skewed, "k", how, hot_sides=("left", "right")))


@pytest.mark.parametrize("how", KINDS)
def test_empty_sides(spark, users, orders, how):
    none = users.limit(0)
    for salted in (False, True):
        assert join_frames(none, orders, "user_id", how, always_salt=salted, hot_share=0.1).count() == {"right": 2, "outer": 2}.get(how, 0)


def test_join_errors(users, orders):
    with pytest.raises(ValueError, match="kind"):
        join_frames(users, orders, "user_id", "cross")
    with pytest.raises(ValueError, match="order_id"):
        join_frames(users, orders, "order_id")
    with pytest.raises(ValueError):
        join_frames(users, orders, [])
    with pytest.raises(ValueError):
        join_frames(users, orders, "user_id", "outer", hot_source=users)


def test_every_hot_key_is_found(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id")
    assert rows(hot_keys(df, ["k"], 0.02)) == [(-1,)]
    # 12 keys just over the share, all in the last of many partitions, behind 90,000 different ones
    last = spark.range(100_000, numPartitions=40).selectExpr("CASE WHEN id < 75400 THEN id ELSE -1 - id % 12 END AS k")
    assert rows(hot_keys(last, ["k"], 0.02)) == rows(spark.range(-12, 0).toDF("k"))
    assert rows(hot_keys(last, ["k"], 0.5)) == [] and rows(hot_keys(last.limit(0), ["k"], 0.02)) == []
    with pytest.raises(ValueError, match="share"):
        hot_keys(df, ["k"], 0)


@pytest.mark.parametrize("shown", ["CAST(k AS STRING)", "CAST(k AS DOUBLE)", "CAST(k AS DECIMAL(12,2))", "timestamp_seconds(k)", "struct(k)", "CAST(CAST(k AS STRING) AS BINARY)", "k = 0"])
def test_hot_keys_of_any_type(spark, shown):
    k = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 10 = 1 THEN NULL ELSE id END AS k")
    df = k.selectExpr(f"{shown} AS k", "k % 2 AS l")
    counts = df.where("k IS NOT NULL").groupBy("k").count()
    want = counts.where(f"count > 0.1 * {counts.selectExpr('sum(count)').first()[0]}").select("k")
    assert rows(hot_keys(df, ["k"], 0.1)) == rows(want)
    both = df.where("k IS NOT NULL AND l IS NOT NULL").groupBy("k", "l").count()
    assert rows(hot_keys(df, ["k", "l"], 0.1)) == rows(both.where(f"count > 0.1 * {both.selectExpr('sum(count)').first()[0]}").select("k", "l"))


def test_zeros_of_both_signs_are_one_hot_key(spark):
    df = spark.range(100).selectExpr("CASE WHEN id < 8 THEN 0D WHEN id < 16 THEN -0D ELSE CAST(id AS DOUBLE) END AS k")
    assert rows(hot_keys(df, ["k"], 0.1)) == [(0.0,)]


def test_the_search_for_hot_keys_shuffles_no_key(spark):
    assert "hashpartitioning(k" not in plan(hot_keys(spark.range(100).toDF("k"), ["k"], 0.02))


def test_no_hot_key_no_salt(spark, all_large):
    even = spark.range(1000).toDF("k")
    assert "_sl" not in plan(join_frames(even, even, "k", "outer", hot_share=0.02))


def test_ports():
    assert left_and_right({"right": 2, "left": 1}) == (1, 2)
    assert left_and_right({"input_0": 1, "input_1": 2}) == (1, 2)
    for bad in ({}, {"left": 1}, {"a": 1, "b": 2, "c": 3}):
        with pytest.raises(ValueError):
            left_and_right(bad)


def test_union(spark):
    one, two = spark.createDataFrame([(1,), (2,)], "value long"), spark.createDataFrame([(3,), (1,)], "value long")
    assert [r[0] for r in rows(union_frames(one, two))] == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        union_frames(one)
    other = spark.createDataFrame([(4, "c")], "value long, extra string")
    assert rows(union_frames(one, other, allow_missing=True), "value", "extra") == [(1, None), (2, None), (4, "c")]
    with pytest.raises(Exception, match="extra"):
        union_frames(other, one).collect()


def test_top_k_orders_ties_by_label(spark):
    sums = spark.createDataFrame([(f"c{i:02}", 5 if i >= 12 else 20 - i) for i in range(20)], "label string, value long")
    top = top_k(sums, "value", "label", 15).collect()
    assert [r["label"] for r in top] == [f"c{i:02}" for i in range(15)]
    assert "TakeOrderedAndProject" in plan(top_k(sums, "value", "label", 15))


def test_sample_with_total(spark):
    sample = sample_with_total(spark.range(1000), ["id"], 5)
    assert rows(sample) == [(i, 1000) for i in range(5)]
    assert sample_with_total(spark.range(0), ["id"], 5).count() == 0
