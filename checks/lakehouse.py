"""Catalogued tables, gold marts, signed runs, capacity and sizes."""

from pyspark.sql import functions as F

from sparkelt.functions.hashing import hmac_sha256
from sparkelt.operators.audit import fingerprint, sign, verify
from sparkelt.operators.lineage import changed_ranges, changed_rows, write_by_digest
from sparkelt.operators.capacity import (
    capacity_columns, capacity_documented, size_bound_flag, size_estimate, tier_column)
from sparkelt.operators.lakehouse import Lakehouse, star_join, with_ranks, with_running_totals

from .privacy import CONTACTS, contacts, email_sql, phone_sql
from .registry import dec, money, query, scratch, table, total


def house(spark):
    return Lakehouse(spark, scratch(spark, "lakehouse"))


def customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


CUSTOMERS = "(SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer)"
ENTRY = ["name", "stage", "row_count", "column_count", "array_join(columns, ',') AS columns", "format_type"]


@query("medallion_register", """
    SELECT 'customers' AS name, 'BRONZE' AS stage, COUNT(*) AS row_count, 4 AS column_count,
           'c_custkey,c_name,c_acctbal,c_mktsegment' AS columns, 'columnar/parquet' AS format_type FROM customer""")
def register(spark, sf):
    return house(spark).register("customers", "BRONZE", customers(spark, sf)).selectExpr(*ENTRY)


@query("medallion_get", f"SELECT * FROM {CUSTOMERS}")
def get(spark, sf):
    lake = house(spark)
    lake.register("customers", "BRONZE", customers(spark, sf).limit(0))
    lake.register("customers", "BRONZE", customers(spark, sf))
    return lake.get("BRONZE", "customers")


@query("medallion_list", """
    SELECT 'buyers' AS name, 'SILVER' AS stage, COUNT(*) AS row_count FROM customer
    UNION ALL SELECT 'sellers', 'SILVER', COUNT(*) FROM supplier""")
def listed(spark, sf):
    lake = house(spark)
    lake.register("raw", "BRONZE", customers(spark, sf))
    lake.register("buyers", "SILVER", customers(spark, sf))
    lake.register("sellers", "SILVER", table(spark, sf, "supplier"))
    return lake.entries("SILVER").select("name", "stage", "row_count")


@query("medallion_transition", f"SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM {CUSTOMERS} WHERE c_acctbal > 0")
def transition(spark, sf):
    lake = house(spark)
    lake.register("customers", "BRONZE", customers(spark, sf))
    lake.transition("BRONZE", "customers", "SILVER", "solvent",
                    lambda df: df.where("c_acctbal > 0").selectExpr("c_custkey", "c_acctbal * 2 AS c_acctbal"))
    return lake.get("SILVER", "solvent")


@query("promote_bronze", f"SELECT * FROM {CUSTOMERS}")
def bronze(spark, sf):
    lake = house(spark)
    lake.promote_bronze(customers(spark, sf))
    return lake.get("BRONZE", "raw_ingest")


@query("promote_silver", f"""
    SELECT c_custkey, {email_sql('email')} AS email, {phone_sql('phone')} AS phone, card, c_acctbal, c_mktsegment FROM {CONTACTS}""")
def silver(spark, sf):
    lake = house(spark)
    lake.promote_silver(contacts(spark, sf))
    return lake.get("SILVER", "cleansed_silver")


@query("promote_gold", f"""
    SELECT c_mktsegment, CAST(SUM(c_custkey) AS DOUBLE) AS c_custkey, {total('c_acctbal')} AS c_acctbal
    FROM customer GROUP BY c_mktsegment""")
def gold(spark, sf):
    lake = house(spark)
    lake.promote_gold(money(customers(spark, sf), "c_acctbal").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name"))
    return lake.get("GOLD", "gold_aggregates")


# -- marts ------------------------------------------------------------------


@query("gold_star_kpi", f"""
    SELECT r_name, n_name, c_mktsegment, COUNT(*) AS line_count,
           {total('l_extendedprice')} AS revenue, MAX(l_discount) AS best_discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name, c_mktsegment""")
def star_kpi(spark, sf):
    """The dimensions are joined among themselves first, so that the fact is shuffled once."""
    buyers = table(spark, sf, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey", "c_mktsegment")
    buyers = star_join(buyers, [
        (table(spark, sf, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name", "n_regionkey"), "c_nationkey"),
        (table(spark, sf, "region").selectExpr("r_regionkey AS n_regionkey", "r_name"), "n_regionkey"),
    ])
    placed = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    placed = star_join(placed, [(buyers, "o_custkey")])
    fact = money(table(spark, sf, "lineitem"), "l_extendedprice").select("l_orderkey", "l_extendedprice", "l_discount")
    wide = star_join(fact, [(placed, "l_orderkey")])
    return wide.groupBy("r_name", "n_name", "c_mktsegment").agg(
        F.count("*").alias("line_count"), F.sum("l_extendedprice").cast("double").alias("revenue"),
        F.max("l_discount").alias("best_discount"))


MONTHLY = f"""(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, SUM({dec('o_totalprice')}) AS revenue
              FROM orders GROUP BY ALL)"""


def monthly(spark, sf, fmt="yyyy-MM", name="month"):
    period = F.date_format("o_orderdate", fmt).alias(name)
    return money(table(spark, sf, "orders"), "o_totalprice").groupBy("o_orderpriority", period).agg(
        F.sum("o_totalprice").alias("revenue"))


@query("gold_window_rank", f"""
    SELECT o_orderpriority, month, CAST(revenue AS DOUBLE) AS revenue,
           RANK() OVER (PARTITION BY o_orderpriority ORDER BY revenue DESC) AS rank FROM {MONTHLY}""")
def window_rank(spark, sf):
    return with_ranks(monthly(spark, sf), ["o_orderpriority"], ["revenue"]).withColumns(
        {"revenue": F.col("revenue").cast("double"), "rank": F.col("rank").cast("long")})


DAILY = f"""(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, SUM({dec('o_totalprice')}) AS revenue
            FROM orders GROUP BY ALL)"""


@query("gold_running_total", f"""
    SELECT o_orderpriority, day, CAST(revenue AS DOUBLE) AS revenue,
           CAST(SUM(revenue) OVER w AS DOUBLE) AS running_total,
           ROUND(AVG(CAST(revenue AS DOUBLE)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_average
    FROM {DAILY} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)""")
def running_total(spark, sf):
    daily = monthly(spark, sf, "yyyy-MM-dd", "day")
    return with_running_totals(daily, ["o_orderpriority"], ["day"], "revenue").withColumns({
        "revenue": F.col("revenue").cast("double"), "running_total": F.col("running_total").cast("double"),
        "moving_average": F.round("moving_average", 4)})


# -- runs -------------------------------------------------------------------
# One run per event.

RUN = [
    "event_id", "1700000000 + event_id AS timestamp", "concat('tenant_', user_id % 10) AS tenant_id",
    "event_type AS project_id", "concat('user_', user_id) AS user_id",
    "CASE WHEN event_type = 'view' THEN NULL ELSE 'sql' END AS engine",
    "concat('SELECT ', event_id, ' FROM data') AS code", "event_id * 37 % 100000 AS row_count",
    "value AS duration_ms", "value AS capacity_units",
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status",
]
SIGNED_FIELDS = """CAST(CAST(timestamp AS DECIMAL(20,6)) AS VARCHAR), tenant_id, project_id, user_id, coalesce(engine, ''),
    sha256(code), CAST(row_count AS VARCHAR), CAST(CAST(duration_ms AS DECIMAL(20,2)) AS VARCHAR),
    CAST(CAST(capacity_units AS DECIMAL(20,4)) AS VARCHAR), status"""


def runs(spark, sf):
    return table(spark, sf, "events").selectExpr(*RUN)


@query("audit_code_hash", "SELECT event_id, sha256('SELECT ' || event_id || ' FROM data') AS code_hash FROM events")
def code_hash(spark, sf):
    signed = sign(runs(spark, sf))
    return signed.select((F.col("timestamp") - 1700000000).cast("long").alias("event_id"), "code_hash")


@query("audit_sign", f"""
    SELECT timestamp - 1700000000 AS event_id, row_count, sha256(concat_ws(':', {SIGNED_FIELDS})) AS manifest_signature
    FROM (SELECT {', '.join(RUN)} FROM events)""")
def audit_sign(spark, sf):
    return sign(runs(spark, sf)).select(
        (F.col("timestamp") - 1700000000).cast("long").alias("event_id"), "row_count", "manifest_signature")


@query("audit_verify", """
    SELECT event_id, event_type <> 'click' AS valid FROM events""")
def audit_verify(spark, sf):
    """The records of one project get another row count after they were signed."""
    tampered = F.when(F.col("project_id") == "click", F.col("row_count") + 1).otherwise(F.col("row_count"))
    checked = verify(sign(runs(spark, sf)).withColumn("row_count", tampered))
    return checked.select((F.col("timestamp") - 1700000000).cast("long").alias("event_id"), "valid")


@query("audit_verify_missing", """
    SELECT event_id, event_type NOT IN ('click', 'view') AS valid FROM events""")
def audit_verify_missing(spark, sf):
    """Some signatures are gone, others belong to another record; the rest fit, under a key."""
    signed = sign(runs(spark, sf), KEY)
    signature = F.when(F.col("project_id") == "click", F.lit(None)).when(
        F.col("project_id") == "view", F.lit("0" * 64)).otherwise(F.col("manifest_signature"))
    checked = verify(signed.withColumn("manifest_signature", signature), KEY)
    return checked.select((F.col("timestamp") - 1700000000).cast("long").alias("event_id"), "valid")


KEY = "check-key"
_PADS = ["".join(f"{b ^ pad:02x}" for b in KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("audit_hmac", f"""
    SELECT event_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(props)))) AS mac
    FROM events""")
def audit_hmac(spark, sf):
    return table(spark, sf, "events").select("event_id", hmac_sha256(F.col("props"), KEY).alias("mac"))


ROW_JSON = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
    || ',"c_mktsegment":"' || c_mktsegment || '"}'"""


@query("table_fingerprint", f"""
    WITH d AS (SELECT sha256({ROW_JSON}) AS h FROM customer),
    s AS (SELECT COUNT(*) AS row_count, SUM(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS low,
                 SUM(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS high FROM d)
    SELECT row_count, CAST(low AS VARCHAR) AS sum_low, CAST(high AS VARCHAR) AS sum_high,
           sha256(row_count || ':' || low || ':' || high) AS content_hash FROM s""")
def table_fingerprint(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return fingerprint(rows).withColumns({c: F.col(c).cast("string") for c in ("sum_low", "sum_high")})


CHANGED = f"""
    old AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer),
    new AS (SELECT c_custkey, CASE WHEN c_custkey % 75 = 1 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_mktsegment
            FROM old WHERE c_custkey % 75 <> 2 UNION ALL SELECT * FROM old WHERE c_custkey % 75 = 3),
    changes AS (SELECT 'added' AS change, * FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
                UNION ALL SELECT 'removed', * FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)),
    named AS (SELECT 'r' || substr(sha256({ROW_JSON}), 1, 2) AS range, * FROM changes)"""


def two_versions(spark, sf):
    """Customers, and the same with some renamed, some gone and some repeated."""
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    name = F.when(F.col("c_custkey") % 75 == 1, "renamed").otherwise(F.col("c_name"))
    new = old.where("c_custkey % 75 <> 2").withColumn("c_name", name).unionByName(old.where("c_custkey % 75 = 3"))
    paths = [scratch(spark, "lineage") for _ in range(2)]
    for rows, path in zip((old, new), paths):
        write_by_digest(rows, path)
    return paths


@query("lineage_changed_rows", f"""
    WITH {CHANGED}
    SELECT range, change, COUNT(*) AS copies, c_custkey, c_name, c_nationkey, c_mktsegment FROM named
    GROUP BY ALL""")
def lineage_changed_rows(spark, sf):
    return changed_rows(spark, *two_versions(spark, sf))


@query("lineage_changed_ranges", f"WITH {CHANGED} SELECT DISTINCT range FROM named")
def lineage_changed_ranges(spark, sf):
    """The ranges that differ, from the two trees alone."""
    ranges = changed_ranges(spark, *two_versions(spark, sf))
    return spark.createDataFrame([(name,) for name in ranges], "range string")


# -- capacity ---------------------------------------------------------------

LOAD = [
    "event_id", "event_id * 37 % 100000 AS row_count", "CAST(value * 25 AS DECIMAL(12,3)) AS memory_mb",
    "CAST(value * 40 AS DECIMAL(12,2)) AS duration_ms",
    "CASE WHEN event_type IN ('view', 'click', 'error') THEN 'TIER_0_EMBEDDED' ELSE 'TIER_1_SPARK' END AS tier",
]


@query("capacity_metrics", f"""
    WITH r AS (SELECT {', '.join(LOAD)} FROM events),
    s AS (SELECT *, GREATEST(duration_ms * 0.001::DECIMAL(4,3), 0.001::DECIMAL(17,5)) AS sec,
                 GREATEST(memory_mb * 0.1::DECIMAL(2,1), 1::DECIMAL(15,4)) AS load FROM r),
    u AS (SELECT *, CASE WHEN tier = 'TIER_0_EMBEDDED' THEN CAST(ROUND(sec * load * 0.01::DECIMAL(3,2), 5) AS DECIMAL(18,5))
                         ELSE CAST(ROUND(sec * 2.50::DECIMAL(3,2), 3) AS DECIMAL(18,5)) END AS cu,
                 CASE WHEN tier = 'TIER_0_EMBEDDED' THEN CAST(ROUND(GREATEST(sec, 1) * 2.50::DECIMAL(3,2), 3) AS DECIMAL(18,3))
                         ELSE CAST(ROUND(sec * 2.50::DECIMAL(3,2), 3) AS DECIMAL(18,3)) END AS eq FROM s)
    SELECT event_id, CAST(cu AS DOUBLE) AS capacity_units, CAST(eq AS DOUBLE) AS spark_equivalent_cu,
           CAST(CASE WHEN tier = 'TIER_0_EMBEDDED' THEN
               GREATEST(ROUND(CAST(eq - cu AS DECIMAL(14,5)) * CAST(sec AS DECIMAL(12,5)) * 0.005::DECIMAL(4,3), 4), 0)
               ELSE 0 END AS DOUBLE) AS cost_avoidance_usd,
           CASE WHEN tier = 'TIER_0_EMBEDDED' THEN 'ECONOMIC_TIER_0 (Saved ' || regexp_replace(CAST(eq AS VARCHAR), '\\.?0+$', '') || ' CU)'
               ELSE 'SCALED_TO_DISTRIBUTED_SPARK' END AS governor_action
    FROM u""")
def capacity(spark, sf):
    measured = capacity_columns(table(spark, sf, "events").selectExpr(*LOAD))
    return measured.select("event_id", *[F.col(c).cast("double").alias(c) for c in (
        "capacity_units", "spark_equivalent_cu", "cost_avoidance_usd")], "governor_action")


@query("capacity_documented", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE
           ELSE CAST(event_id * 37 AS DOUBLE) / 1000000.0::DOUBLE * (value / 60.0::DOUBLE) END AS units FROM events""")
def documented(spark, sf):
    tier = F.when(F.col("event_type") == "view", "TIER_0_EMBEDDED").otherwise("TIER_1_SPARK")
    return table(spark, sf, "events").select(
        "event_id", capacity_documented(F.col("event_id") * 37, F.col("value"), tier).alias("units"))


@query("tier_label", f"""
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'TIER_1_SPARK'
        WHEN event_id * 37 % 100000 < 50000 AND value * 25 < 1024 THEN 'TIER_0_EMBEDDED' ELSE 'TIER_1_SPARK' END AS tier
    FROM events""")
def tier_label(spark, sf):
    engine = F.when(F.col("event_type") == "purchase", "PySpark").when(F.col("event_type") == "view", "auto")
    return table(spark, sf, "events").select("event_id", tier_column(
        F.col("event_id") * 37 % 100000, F.col("value") * 25, engine).alias("tier"))


@query("size_bound_flag", "SELECT event_id, value * 25 > 2048 AS too_big FROM events")
def bound_flag(spark, sf):
    return table(spark, sf, "events").select("event_id", size_bound_flag(F.col("value") * 25).alias("too_big"))


@query("size_estimate", """
    SELECT COUNT(*) AS row_count, 6 AS column_count,
           CAST(SUM(8 + 8 + 8 + octet_length(encode(event_type)) + octet_length(encode(props)) + 8) AS BIGINT) AS bytes,
           ROUND(CAST(SUM(8 + 8 + 8 + octet_length(encode(event_type)) + octet_length(encode(props)) + 8) AS DOUBLE) / 1048576, 3) AS size_mb
    FROM events""")
def size(spark, sf):
    return size_estimate(table(spark, sf, "events"))
