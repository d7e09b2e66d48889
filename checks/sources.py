"""Scans, sinks, landed uploads and sample datasets."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkelt.sources.files import ingest_landing, read_dataset, write_dataset, write_through
from sparkelt.sources.memory import read_memory, write_memory
from sparkelt.sources.paths import scoped_path
from sparkelt.sources.presets import preset_over

from .registry import query, scratch, table


@query("scan_parquet", "SELECT * FROM part")
def scan_parquet(spark, sf):
    return table(spark, sf, "part")


@query("scan_scoped_parquet", "SELECT * FROM customer")
def scan_scoped_parquet(spark, sf):
    path = scoped_path(scratch(spark, "scoped"), "tenant-a", "/raw/customer.parquet", "analytics")
    write_dataset(table(spark, sf, "customer"), path)
    return read_dataset(spark, path)


@query("scan_csv_roundtrip", "SELECT * FROM customer")
def scan_csv_roundtrip(spark, sf):
    return write_through(table(spark, sf, "customer"), scratch(spark, "csv") + "/customer.csv")


@query("scan_json_roundtrip", "SELECT * FROM part")
def scan_json_roundtrip(spark, sf):
    return write_through(table(spark, sf, "part"), scratch(spark, "json") + "/part.json")


@query("scan_csv_roundtrip_text", """
    SELECT doc_id, '  ' || text || chr(10) || '"quoted", \\' || chr(13) || ' ' AS text, lang, CASE WHEN doc_id % 3 = 0 THEN '' END AS gap FROM documents""")
def scan_csv_roundtrip_text(spark, sf):
    """Texts with outer blanks, line breaks, quotes and backslashes; empty texts beside nulls."""
    awkward = F.concat(F.lit("  "), F.col("text"), F.lit('\n"quoted", \\\r '))
    rows = table(spark, sf, "documents").select(
        "doc_id", awkward.alias("text"), "lang", F.when(F.col("doc_id") % 3 == 0, "").alias("gap"))
    return write_through(rows, scratch(spark, "texts") + "/documents.csv", multiline=True)


TIMES = "SELECT event_id, epoch_us(ts) + event_id % 1000000 AS moment FROM events"


def timed(spark, sf):
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000000)
    return table(spark, sf, "events").select("event_id", at.alias("moment"))


@query("scan_json_roundtrip_time", TIMES)
def scan_json_roundtrip_time(spark, sf):
    """Times with microseconds."""
    return write_through(timed(spark, sf), scratch(spark, "times") + "/events.json").withColumn("moment", F.unix_micros("moment"))


@query("scan_csv_roundtrip_time", TIMES)
def scan_csv_roundtrip_time(spark, sf):
    return write_through(timed(spark, sf), scratch(spark, "times") + "/events.csv").withColumn("moment", F.unix_micros("moment"))


@query("scan_default_format", "SELECT * FROM customer")
def scan_default_format(spark, sf):
    path = scratch(spark, "default") + "/customer"
    write_dataset(table(spark, sf, "customer"), path)
    return read_dataset(spark, path)


@query("scan_memory_table", "SELECT event_id, user_id, event_type, value FROM events")
def scan_memory_table(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    write_memory(events, "tenant-a", "raw/events", "analytics")
    return read_memory(spark, "tenant-a", "raw/events", "analytics")


@query("scan_object_store", "SELECT * FROM supplier")
def scan_object_store(spark, sf):
    # the same reader and writer as for a bucket; only the scheme differs
    base = scratch(spark, "bucket")
    base = "file://" + base if base.startswith("/") else base
    path = scoped_path(f"{base}/lakehouse", "tenant-a", "supplier.parquet", "analytics")
    write_dataset(table(spark, sf, "supplier"), path)
    return read_dataset(spark, path)


@query("sink_parquet_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sink_parquet_roundtrip(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "sink") + "/orders.pq"
    write_dataset(orders, path, compression="zstd")
    return read_dataset(spark, path)


@query("sink_passthrough", "SELECT event_id, event_type, value, props FROM events")
def sink_passthrough(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    return write_through(events, scratch(spark, "through") + "/events.parquet")


@query("ingest_sniff", """
    SELECT format, key, name, balance
    FROM (SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer),
         (VALUES ('csv'), ('json_lines')) AS f(format)""")
def ingest_sniff(spark, sf):
    """Customers land as CSV and as JSON lines; suppliers land with a text balance and are refused."""
    landing = scratch(spark, "landing")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    broken = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("unknown").alias("balance"))
    write_dataset(rows, f"{landing}/a.csv")
    write_dataset(rows, f"{landing}/b.json")
    write_dataset(broken, f"{landing}/c.csv")
    schema = StructType.fromDDL("key long, name string, balance double")
    accepted, _ = ingest_landing(spark, landing, schema)
    return accepted.drop("source_file")


@query("ingest_report", """
    SELECT format, status, SUM(n)::BIGINT AS row_count FROM (
        SELECT 'csv' AS format, 'ingested' AS status, COUNT(*) AS n FROM customer
        UNION ALL SELECT 'csv', 'rejected', 0)
    GROUP BY format, status""")
def ingest_report(spark, sf):
    landing = scratch(spark, "landing")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    write_dataset(rows, f"{landing}/a.csv")
    write_dataset(rows.withColumn("c_custkey", F.lit("none")), f"{landing}/b.csv")
    schema = StructType.fromDDL("c_custkey long, c_name string, c_acctbal double")
    _, report = ingest_landing(spark, landing, schema)
    return report.groupBy("format", "status").agg(F.sum("row_count").cast("long").alias("row_count"))


@query("ingest_header_order", """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, 'ingested' AS status FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'ingested' FROM supplier
    UNION ALL SELECT 1, NULL, NULL, 'rejected'""")
def ingest_header_order(spark, sf):
    """Two uploads with their columns in different orders, and one with other names."""
    landing = scratch(spark, "landing")
    buyers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    sellers = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    write_dataset(buyers, f"{landing}/a.csv")
    write_dataset(sellers, f"{landing}/b.csv")
    write_dataset(sellers.withColumnRenamed("name", "title").coalesce(1), f"{landing}/c.csv")
    rows, report = ingest_landing(spark, landing, StructType.fromDDL("key long, name string, balance double"))
    # the verdicts beside the rows, as rows
    verdicts = report.where("status <> 'ingested'").groupBy("status").agg(F.count("*").alias("key"))
    return rows.select("key", "name", "balance", F.lit("ingested").alias("status")).unionByName(
        verdicts.select("key", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("balance"), "status"))


@query("ingest_inferred", """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, 'seller' FROM supplier""")
def ingest_inferred(spark, sf):
    """Uploads without a declared schema, as CSV and as JSON lines with other columns."""
    landing = scratch(spark, "landing")
    write_dataset(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), f"{landing}/a.csv")
    write_dataset(table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("seller").alias("segment")), f"{landing}/b.json")
    rows, _ = ingest_landing(spark, landing)
    return rows.select(F.col("key").cast("long").alias("key"), "name", "balance", "segment")


# -- sample datasets, indexed by the keys of a table ------------------------

def pick(i, *words):
    listed = ", ".join(f"'{word}'" for word in words)
    return f"([{listed}])[({i} % {len(words)}) + 1]"


def step(base, i, by, cycle):
    return f"ROUND({base} + fmod(CAST({i} AS DOUBLE) * CAST({by} AS DOUBLE), {cycle}), 2)"


def pad(number, width):
    return f"LPAD(CAST({number} AS VARCHAR), CAST(GREATEST({width}, LENGTH(CAST({number} AS VARCHAR))) AS INTEGER), '0')"


ECOMMERCE = f"""
    SELECT 5000 + i AS order_id, 1000 + i % 30 AS customer_id,
           {pick('i', 'USA', 'Canada', 'UK', 'Germany', 'Japan')} AS country,
           {pick('i', 'Electronics', 'Clothing', 'Home', 'Books', 'Sports')} AS category,
           {step('15.0', 'i', '7.5', '450.0')} AS amount,
           {pick('i', 'Completed', 'Completed', 'Pending', 'Cancelled')} AS status
    FROM (SELECT o_orderkey AS i FROM orders)"""


@query("gen_ecommerce", ECOMMERCE)
def gen_ecommerce(spark, sf):
    return preset_over(table(spark, sf, "orders"), "o_orderkey", "ecommerce")


@query("gen_iot", f"""
    SELECT 'sensor-' || {pad('i % 10 + 1', 3)} AS device_id,
           {step('20.0', 'i', '0.3', '15.0')} AS temperature,
           {step('45.0', 'i', '0.5', '35.0')} AS humidity,
           100 - i % 60 AS battery_pct,
           CASE WHEN i % 7 = 0 THEN 'High Temp' ELSE 'Normal' END AS alert
    FROM (SELECT event_id AS i FROM events)""")
def gen_iot(spark, sf):
    return preset_over(table(spark, sf, "events"), "event_id", "iot")


@query("gen_ledger", f"""
    SELECT 100000 + i AS txn_id, 'ACC-' || (100 + i % 25) AS account_id,
           {pick('i', 'Deposit', 'Withdrawal', 'Transfer', 'Payment')} AS txn_type,
           {step('10.0', 'i', '19.5', '2500.0')} AS amount,
           {pick('i', 'USD', 'EUR', 'GBP', 'JPY')} AS currency,
           {pick('i', 'Settled', 'Settled', 'Pending', 'Flagged')} AS status
    FROM (SELECT o_orderkey AS i FROM orders)""")
def gen_ledger(spark, sf):
    return preset_over(table(spark, sf, "orders"), "o_orderkey", "ledger")


@query("gen_healthcare", f"""
    SELECT 'PAT-' || (500 + i) AS patient_id, 20 + i % 60 AS age,
           {pick('i', 'Female', 'Male', 'Non-Binary')} AS gender,
           {pick('i', 'Hypertension', 'Diabetes', 'Asthma', 'Healthy')} AS condition,
           'patient' || i || '@example.com' AS email,
           {pad('100 + i % 900', 3)} || '-' || {pad('10 + i % 90', 2)} || '-' || {pad('1000 + i % 9000', 4)} AS ssn,
           {step('75.0', 'i', '12.3', '800.0')} AS visit_cost
    FROM (SELECT c_custkey AS i FROM customer)""")
def gen_healthcare(spark, sf):
    return preset_over(table(spark, sf, "customer"), "c_custkey", "healthcare")


@query("gen_customers", f"""
    SELECT 1000 + i AS customer_id, 18 + i % 55 AS age,
           {pick('i', 'USA', 'Germany', 'France', 'Japan', 'Brazil')} AS country,
           {pick('i', 'Basic', 'Pro', 'Enterprise')} AS plan_type,
           {step('29.0', 'i', '3.7', '300.0')} AS monthly_spend,
           CASE WHEN i % 4 = 0 THEN 'High' ELSE 'Low' END AS churn_risk
    FROM (SELECT c_custkey AS i FROM customer)""")
def gen_customers(spark, sf):
    return preset_over(table(spark, sf, "customer"), "c_custkey", "customers")
