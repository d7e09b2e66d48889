"""Projections, filters, joins, unions, limits."""

from pyspark.sql import functions as F

from sparkelt.operators.conditions import safe_filter
from sparkelt.operators.relational import (
    hot_keys, join_frames, sample_with_total, top_k, transform_columns, union_frames)
from sparkelt.sources.presets import preset_over

from .registry import dec, money, query, table, total
from .sources import ECOMMERCE

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLUMNS)


@query("project_select", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def project_select(spark, sf):
    return transform_columns(table(spark, sf, "orders"), select=["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("project_rename", f"""
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderpriority
    FROM orders""")
def project_rename(spark, sf):
    return transform_columns(orders(spark, sf), rename={"o_orderkey": "order_id", "o_custkey": "customer_id",
                                                       "not_there": "ignored"})


@query("project_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project_drop(spark, sf):
    return transform_columns(orders(spark, sf), drop=["o_orderstatus", "o_orderpriority", "not_there"])


@query("project_combined", "SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders")
def project_combined(spark, sf):
    return transform_columns(
        table(spark, sf, "orders"), select=["o_orderkey", "o_custkey", "o_totalprice"],
        rename={"o_orderkey": "order_id", "o_totalprice": "amount", "o_custkey": "customer"}, drop=["customer"])


# -- filters ----------------------------------------------------------------

LINE = "l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE.split(", "))


def flagged(spark, sf):
    """Lineitem with a return flag that is null where it was N."""
    return lines(spark, sf).withColumn("flag", F.expr("nullif(l_returnflag, 'N')")).drop("l_returnflag")


FLAGGED = "(SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, nullif(l_returnflag, 'N') AS flag FROM lineitem)"


def filter_query(name, source, condition, sql):
    @query(name, sql)
    def run(spark, sf):
        return safe_filter(source(spark, sf), condition)


filter_query("filter_basic", lines, "l_quantity >= 10 and l_returnflag == 'R'",
             f"SELECT {LINE} FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R'")
filter_query("filter_eq_ne", flagged, "flag != 'A' and l_linenumber == 3",
             f"SELECT * FROM {FLAGGED} WHERE flag <> 'A' AND l_linenumber = 3")
filter_query("filter_range", lines, "l_quantity > 12.5 and l_quantity <= 40 and l_discount < 0.05",
             f"SELECT {LINE} FROM lineitem WHERE l_quantity > 12.5 AND l_quantity <= 40 AND l_discount < 0.05")
filter_query("filter_chained", lines, "10 <= l_quantity < 20 < l_partkey",
             f"SELECT {LINE} FROM lineitem WHERE 10 <= l_quantity AND l_quantity < 20 AND 20 < l_partkey")
filter_query("filter_in", lines, "l_returnflag in ['A', 'R'] and l_linenumber in (1, 2)",
             f"SELECT {LINE} FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2)")
filter_query("filter_not_in", flagged, "flag not in ['A']",
             f"SELECT * FROM {FLAGGED} WHERE flag NOT IN ('A')")
filter_query("filter_and_or", lines, "l_quantity > 45 or l_discount == 0.1 and l_returnflag == 'N' or l_partkey < 100",
             f"""SELECT {LINE} FROM lineitem
                 WHERE l_quantity > 45 OR (l_discount = 0.1::DOUBLE AND l_returnflag = 'N') OR l_partkey < 100""")
filter_query("filter_not", flagged, "not (flag == 'R' or l_quantity > 25)",
             f"SELECT * FROM {FLAGGED} WHERE NOT (flag = 'R' OR l_quantity > 25)")
filter_query("filter_null_test", flagged, "flag == None and l_quantity > 30",
             f"SELECT * FROM {FLAGGED} WHERE flag IS NULL AND l_quantity > 30")


@query("filter_signed_literal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > -500 AND c_acctbal < 250.5")
def filter_signed_literal(spark, sf):
    return safe_filter(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "-500 < c_acctbal < +250.5")


@query("filter_bool_column", """
    SELECT event_id, value, event_type = 'purchase' AS is_purchase FROM events
    WHERE event_type = 'purchase' AND value >= 5""")
def filter_bool_column(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "value", (F.col("event_type") == "purchase").alias("is_purchase"))
    return safe_filter(events, "is_purchase and value >= 5")


@query("filter_ast_starter", f"""
    SELECT * FROM ({ECOMMERCE})
    WHERE amount >= 100.0 AND category IN ('Electronics', 'Home') AND status = 'Completed'""")
def filter_ast_starter(spark, sf):
    return safe_filter(preset_over(table(spark, sf, "orders"), "o_orderkey", "ecommerce"),
                       "amount >= 100.0 and category in ['Electronics', 'Home'] and status == 'Completed'")


# -- joins ------------------------------------------------------------------
# Orders against customers whose keys were doubled: half of the customers have
# no orders and half of the orders no customer.

def placed(spark, sf):
    return orders(spark, sf).select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")


def renumbered(spark, sf):
    return table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("custkey"), "c_name", "c_acctbal")


PLACED = "(SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders)"
RENUMBERED = "(SELECT c_custkey * 2 AS custkey, c_name, c_acctbal FROM customer)"


def join_query(name, how, sql):
    @query(name, sql)
    def run(spark, sf):
        return join_frames(placed(spark, sf), renumbered(spark, sf), on="custkey", how=how)


for kind, word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    join_query(f"join_{kind}", kind, f"""
        SELECT custkey, o_orderkey, o_totalprice, c_name, c_acctbal
        FROM {PLACED} AS o {word} JOIN {RENUMBERED} AS c USING (custkey)""")
join_query("join_semi", "left_semi", f"SELECT * FROM {PLACED} AS o WHERE EXISTS (SELECT 1 FROM {RENUMBERED} AS c WHERE c.custkey = o.custkey)")
join_query("join_anti", "left_anti", f"SELECT * FROM {PLACED} AS o WHERE NOT EXISTS (SELECT 1 FROM {RENUMBERED} AS c WHERE c.custkey = o.custkey)")


@query("join_multi_key", f"""
    SELECT l_orderkey, l_suppkey, l_linenumber, supplied
    FROM lineitem JOIN (
        SELECT l_orderkey, l_suppkey, CAST(SUM({dec('l_quantity')}) AS DOUBLE) AS supplied
        FROM lineitem GROUP BY l_orderkey, l_suppkey) USING (l_orderkey, l_suppkey)""")
def join_multi_key(spark, sf):
    items = money(table(spark, sf, "lineitem"), "l_quantity")
    supplied = items.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("supplied"))
    return join_frames(items.select("l_orderkey", "l_suppkey", "l_linenumber"), supplied,
                       on=["l_orderkey", "l_suppkey"], hot_sides=("left",))


@query("join_shared_column", """
    SELECT nationkey, c.c_custkey, c.balance AS balance_x, s.s_suppkey, s.balance AS balance_y
    FROM (SELECT c_nationkey AS nationkey, c_custkey, c_acctbal AS balance FROM customer) AS c
    JOIN (SELECT s_nationkey AS nationkey, MIN(s_suppkey) AS s_suppkey, MIN(s_acctbal) AS balance
          FROM supplier GROUP BY s_nationkey) AS s USING (nationkey)""")
def join_shared_column(spark, sf):
    buyers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nationkey"), "c_custkey", F.col("c_acctbal").alias("balance"))
    sellers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.min("s_suppkey").alias("s_suppkey"), F.min("s_acctbal").alias("balance"))
    return join_frames(buyers, sellers, on="nationkey", hot_sides=("left",))


# Events by type have five keys with a fifth of the rows each; here they are
# split whatever the size of the tables. The other side lacks one type and has
# one that no event has.
KNOWN_TYPES = """(SELECT event_type, COUNT(*) AS seen FROM events WHERE event_type <> 'error' GROUP BY event_type
                  UNION ALL SELECT 'refund', COUNT(*) FROM events)"""


def hot_join_query(name, how, sql):
    @query(name, sql)
    def run(spark, sf):
        events = table(spark, sf, "events").select("event_type", "event_id", "value")
        seen = events.where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("seen"))
        other = events.agg(F.count("*").alias("seen")).select(F.lit("refund").alias("event_type"), "seen")
        return join_frames(events, seen.unionByName(other), on="event_type", how=how, hot_share=0.1,
                           hot_sides=("left", "right"), salts=8, always_salt=True)


hot_join_query("join_hot_key_inner", "inner",
               f"SELECT event_type, event_id, value, seen FROM events JOIN {KNOWN_TYPES} USING (event_type)")
hot_join_query("join_hot_key_outer", "outer",
               f"SELECT event_type, event_id, value, seen FROM events FULL JOIN {KNOWN_TYPES} USING (event_type)")
hot_join_query("join_hot_key_anti", "anti", f"""
    SELECT event_type, event_id, value FROM events
    WHERE event_type NOT IN (SELECT event_type FROM {KNOWN_TYPES})""")


SKEWED = "CASE WHEN l_orderkey % 3 = 0 THEN -1 WHEN l_orderkey % 7 = 0 THEN -2 ELSE l_orderkey END"


@query("join_hot_keys_found", f"""
    WITH k AS (SELECT {SKEWED} AS k FROM lineitem)
    SELECT k FROM k GROUP BY k HAVING COUNT(*) > 0.05 * (SELECT COUNT(*) FROM k)""")
def hot_keys_found(spark, sf):
    """What a join would split: the keys over a share of the rows, in one pass without a shuffle of keys."""
    return hot_keys(table(spark, sf, "lineitem").selectExpr(f"{SKEWED} AS k"), ["k"], 0.05)


@query("join_hot_keys_of_two", f"""
    WITH k AS (SELECT {SKEWED} AS k, l_returnflag AS flag FROM lineitem)
    SELECT k, flag FROM k GROUP BY k, flag HAVING COUNT(*) > 0.02 * (SELECT COUNT(*) FROM k)""")
def hot_keys_of_two(spark, sf):
    return hot_keys(table(spark, sf, "lineitem").selectExpr(f"{SKEWED} AS k", "l_returnflag AS flag"), ["k", "flag"], 0.02)


# -- unions -----------------------------------------------------------------

@query("union_all", """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer""")
def union_all(spark, sf):
    buyers = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance")
    sellers = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance", "s_suppkey AS key")
    return union_frames(buyers, sellers, buyers)


@query("union_missing_cols", """
    SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier""")
def union_missing_cols(spark, sf):
    buyers = table(spark, sf, "customer").selectExpr("c_name AS name", "c_mktsegment AS segment")
    sellers = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance")
    return union_frames(buyers, sellers, allow_missing=True)


# -- limits -----------------------------------------------------------------

@query("topk_categories", f"""
    SELECT o_custkey, {total('o_totalprice')} AS revenue FROM orders
    GROUP BY o_custkey ORDER BY revenue DESC, o_custkey LIMIT 15""")
def topk_categories(spark, sf):
    spent = money(orders(spark, sf), "o_totalprice").groupBy("o_custkey").agg(
        F.sum("o_totalprice").cast("double").alias("revenue"))
    return top_k(spent, "revenue", "o_custkey", 15)


@query("limit_with_total", """
    SELECT o_orderkey, o_totalprice, COUNT(*) OVER () AS row_count FROM orders ORDER BY o_orderkey LIMIT 100""")
def limit_with_total(spark, sf):
    return sample_with_total(orders(spark, sf).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)
